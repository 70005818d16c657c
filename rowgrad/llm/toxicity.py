"""Toxicity by a convolutional text classifier.

Words become hashed embeddings (the word's own and those of its beginnings, so that related forms share), filters of several widths slide over them, and the
largest response of each filter anywhere in the text decides. The net is trained on all labelled rows, three in four: they are dealt into shards, each goes through
its texts in numpy from the same net, and after each epoch Spark sums the shards' changes. The rest calibrates. Every whole text is scored. Thresholds are set for each language after scoring; language is no
input of the score.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowgrad.llm.texts import Remembered, free, hinted, opened, over_texts, put, share, slices

# A shard has at most about so many texts, and bytes of word ids. Training texts are dealt into as many shards as that takes.
SHARD_ROWS, SHARD_BYTES = 10_000, 16 << 20
UNIT = 1 << 40  # changes of weights are summed in units of 1 / UNIT
GRID = 1024  # steps of a log-odd in calibration
SLOTS, DIM, FILTERS, WIDTHS = 1 << 16, 8, 8, (1, 2, 3)
EPOCHS, BATCH, RATE = 5, 64, 0.05
THRESHOLD = 0.3
WORD = re.compile(r"\w+")


def slots(word: str) -> tuple[int, int, int]:
    """Rows of the embedding table for a word, its first four and its first five characters; row 0 is kept for padding."""
    return tuple(1 + crc32(x.encode()) % (SLOTS - 1) for x in ("w" + word, "4" + word[:4], "5" + word[:5]))


def slot_ids(texts: list[bytes | None], known: Remembered) -> tuple[np.ndarray, np.ndarray]:
    """Rows for all words of all texts, two of padding after each text, and where texts begin."""
    lists = [WORD.findall((t or b"").decode("utf-8", "replace").lower()) for t in texts]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists)) + 2
    begins = np.cumsum(sizes) - sizes
    out = np.zeros((int(sizes.sum()), 3), np.int32)
    for b, ws in zip(begins.tolist(), lists, strict=True):
        if ws:
            out[b : b + len(ws)] = list(map(known.__getitem__, ws))
    return out, begins


class Net:
    """Embeddings, filters by width, and the output layer."""

    def __init__(self, seed: int = 11):
        draw = np.random.default_rng(seed)
        self.table = (draw.normal(size=(SLOTS, DIM)) * 0.05).astype(np.float32)
        self.table[0] = 0
        self.filters = [(draw.normal(size=(w, DIM, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS]
        for f in self.filters:
            f[:, 0, : FILTERS // 2] = np.abs(f[:, 0, : FILTERS // 2]) + 0.3
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = (draw.normal(size=FILTERS * len(WIDTHS)) * 0.1).astype(np.float32)
        self.const = np.float32(0)
        # Adagrad's sums of squares
        self.seen = [np.full_like(p, 1e-3) for p in self.parts()]
        self.seen_table, self.seen_const = np.full(SLOTS, 1e-3, np.float32), np.float32(1e-3)

    def parts(self) -> list[np.ndarray]:
        return [*self.filters, self.bias, self.out]

    def packed(self) -> np.ndarray:
        """All weights with their sums of squares, DIM + 1 to a row: those of the embedding table by row, then the others."""
        rest = np.concatenate([*[x.ravel() for x in (*self.parts(), *self.seen)], [self.const, self.seen_const]]).astype(np.float64)
        rest = np.pad(rest, (0, -len(rest) % (DIM + 1))).reshape(-1, DIM + 1)
        return np.vstack([np.hstack([self.table, self.seen_table[:, None]]).astype(np.float64), rest])

    def unpack(self, packed: np.ndarray) -> None:
        """Take over what ``packed`` gave."""
        self.table[:], self.seen_table[:] = packed[:SLOTS, :DIM], packed[:SLOTS, DIM]
        rest, at = packed[SLOTS:].ravel(), 0
        for x in (*self.parts(), *self.seen):
            x[...] = rest[at : at + x.size].reshape(x.shape)
            at += x.size
        self.const, self.seen_const = np.float32(rest[at]), np.float32(rest[at + 1])

    def responses(self, x: np.ndarray) -> np.ndarray:
        """All filters at all positions; windows reach into the padding."""
        n, made = len(x), []
        for f in self.filters:
            flat = x @ f.transpose(1, 0, 2).reshape(DIM, -1)
            total = flat[:, :FILTERS].copy()
            for k in range(1, len(f)):
                total[: n - k] += flat[k:, k * FILTERS : (k + 1) * FILTERS]
            made.append(total)
        return np.hstack(made)

    def score(self, ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Log-odds by text."""
        out = []
        for lo, hi in _groups(begins, len(ids), 200_000):
            end = begins[hi] if hi < len(begins) else len(ids)
            base = begins[lo]
            best = None
            parts = ids[base:end]
            x = self.table[parts[:, 0]] + self.table[parts[:, 1]] + self.table[parts[:, 2]]
            best = np.maximum.reduceat(self.responses(x), begins[lo:hi] - base, axis=0)
            out.append(np.maximum(best + self.bias, 0) @ self.out + self.const)
        return np.concatenate([np.zeros(0, np.float32), *out])


def _groups(begins: np.ndarray, end: int, limit: int):
    """Runs of texts of about ``limit`` words."""
    lo = 0
    ends = np.append(begins[1:], end)
    while lo < len(begins):
        hi = max(lo + 1, int(np.searchsorted(ends, begins[lo] + limit, side="right")))
        yield lo, hi
        lo = hi


def started(count: np.ndarray, n: np.ndarray, seed: int = 11) -> Net:
    """A net whose first dimension of a row is the log-odds of the training texts that hold it: ``count`` of each class by row, ``n`` texts of each class."""
    net = Net(seed)
    odds = np.log((count[1] + 0.5) / (n[1] + 1)) - np.log((count[0] + 0.5) / (n[0] + 1))
    net.table[:, 0] = odds * (count.sum(0) / (count.sum(0) + 5)) / 3
    net.table[0] = 0
    return net


def epoch(net: Net, docs: list[np.ndarray], y: np.ndarray, draw: np.random.Generator) -> None:
    """Adagrad over cross-entropy, every text once; gradients reach only the windows that pooling chose."""
    order = draw.permutation(len(docs))
    for lo in range(0, len(order), BATCH):
        some = order[lo : lo + BATCH]
        sizes = np.array([len(docs[i]) for i in some])
        begins = np.cumsum(sizes) - sizes
        ids = np.concatenate([docs[i] for i in some])
        x = net.table[ids[:, 0]] + net.table[ids[:, 1]] + net.table[ids[:, 2]]
        resp = net.responses(x)
        at = np.stack([b + resp[b : b + s].argmax(axis=0) for b, s in zip(begins, sizes, strict=True)])
        pool = np.take_along_axis(resp, at, axis=0) + net.bias
        act = np.maximum(pool, 0)
        p = 1 / (1 + np.exp(-np.clip(act @ net.out + net.const, -30, 30)))
        g = ((p - y[some]) / len(some)).astype(np.float32)
        d_pool = g[:, None] * net.out * (pool > 0)
        grads = []
        rows, deltas = [], []
        for k, f in enumerate(net.filters):
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            d, places = d_pool[:, cols], at[:, cols]
            grad = np.zeros_like(f)
            for j in range(len(f)):
                where = np.minimum(places + j, len(x) - 1)
                inside = (places + j < len(x))[..., None]
                grad[j] = np.einsum("bfd,bf->df", x[where] * inside, d)
                deltas.append((np.einsum("bf,df->bfd", d, f[j]) * inside).reshape(-1, DIM))
                rows.append(ids[where].reshape(-1, 3))
            grads.append(grad)
        for part, grad, s in zip(net.parts(), [*grads, d_pool.sum(0), act.T @ g], net.seen, strict=True):
            s += grad * grad
            part -= RATE * grad / np.sqrt(s)
        net.seen_const += np.float32(float(g.sum()) ** 2)
        net.const -= np.float32(RATE * g.sum() / np.sqrt(net.seen_const))
        which, back = np.unique(np.concatenate(rows).ravel(), return_inverse=True)
        grad = np.zeros((len(which), DIM), np.float32)
        np.add.at(grad, back.ravel(), np.repeat(np.concatenate(deltas), 3, axis=0))
        grad[which == 0] = 0
        net.seen_table[which] += (grad * grad).mean(axis=1)
        net.table[which] -= RATE * grad / np.sqrt(net.seen_table[which])[:, None]


def calibrated(z: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and constant of a logistic curve through log-odds (regularised Newton steps): ``y`` of the ``n`` texts at ``z`` are toxic."""
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = n * (p * (1 - p) + 1e-6)
        g = np.array([((n * p - y) * z).sum() + 0.01 * (a - 1), (n * p - y).sum() + 0.01 * b])
        h = np.array([[(w * z * z).sum() + 0.01, (w * z).sum()], [(w * z).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -2, 2))
    return a, b


def best_threshold(q: np.ndarray, y: np.ndarray, n: np.ndarray) -> float | None:
    """The threshold of best F1 where ``y`` of the ``n`` texts of score ``q`` are toxic; None where fewer than 5 of either class are known."""
    if min(y.sum(), (n - y).sum()) < 5:
        return None
    order = np.argsort(-q, kind="stable")
    q, hit = q[order], np.cumsum(y[order])
    best = int(np.argmax(2 * hit / (np.cumsum(n[order]) + y.sum())))
    below = q[best + 1] if best + 1 < len(q) else 0.0
    return float((q[best] + below) / 2)


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, y, lang, ids, checks) of every document whose label may be learned. ``ids``: its words' rows, three each; one in four checks, by a hash of the id."""
    named = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    truth = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("__id")).agg((F.avg("toxic") >= 0.5).cast("int").alias("__y"))
    truth = put(truth.where(F.crc32(F.col("__id").cast("string").cast("binary")) % 4 != 2), "truth")
    some = docs.where(named % 4 != 2).select(F.col("doc_id").alias("__id"), F.col("lang").cast("string").alias("__lang"), "text")
    some = some.join(hinted(truth, truth.count(), 64), "__id")

    def start():
        known = Remembered(slots)

        def work(texts, part):
            known.trim()
            ids, begins = slot_ids(texts, known)
            ids = ids.astype(np.uint16)
            ends = np.append(begins[1:], len(ids))
            return [[ids[b:e].tobytes() for b, e in zip(begins, ends, strict=True)]]

        return work

    rows = over_texts(some, ["__id", "__y", "__lang"], "ids binary", start)
    checks = F.crc32(F.concat(F.lit("c"), F.col("__id").cast("string")).cast("binary")) % 4 == 0
    out = put(rows.select(F.col("__id").alias("id"), F.col("__y").alias("y"), F.coalesce("__lang", F.lit("None")).alias("lang"), "ids", checks.alias("checks")), "labelled")
    free(truth)
    return out


def _shards(rows: DataFrame, n_shards: int) -> DataFrame:
    """(shard, y, sizes, ids): one row for each shard, its texts in an order of their own; a text's shard hangs on its id and words alone."""
    placed = rows.select(F.pmod(F.xxhash64("id", "ids"), F.lit(n_shards)).cast("int").alias("shard"), F.col("id").cast("string").alias("id"), "y", "ids")

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by([("shard", "ascending"), ("id", "ascending"), ("y", "ascending"), ("ids", "ascending")])
        shard = table.column("shard").to_numpy()
        for s in np.unique(shard):
            lo, hi = np.searchsorted(shard, [s, s + 1])
            part = table.slice(lo, hi - lo)
            texts = part.column("ids").to_pylist()
            sizes = np.array([len(t) // 6 for t in texts], np.int64)
            y = part.column("y").to_numpy().astype(np.int8)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([s], pa.int32()), "y": [y.tobytes()], "sizes": [sizes.tobytes()], "ids": [b"".join(texts)]})

    return put(placed.repartitionById(n_shards, F.col("shard")).mapInArrow(run, "shard int, y binary, sizes binary, ids binary"), "shards")


def _texts(batch: pa.RecordBatch):
    """Shard, word ids of its texts, and their classes, for each shard of a batch."""
    for row in range(batch.num_rows):
        shard, y, sizes, ids = (batch.column(c)[row].as_py() for c in ("shard", "y", "sizes", "ids"))
        ends = np.cumsum(np.frombuffer(sizes, np.int64))
        whole = np.frombuffer(ids, np.uint16).reshape(-1, 3)
        yield shard, np.split(whole, ends[:-1]), np.frombuffer(y, np.int8)


def _counted(shards: DataFrame) -> np.ndarray:
    """How many texts of each class hold each row of the embedding table."""

    def run(batches):
        count = np.zeros((2, SLOTS), np.int64)
        for batch in batches:
            for _, docs, y in _texts(batch):
                for d, t in zip(docs, y, strict=True):
                    count[int(t), np.unique(d)] += 1
        at = np.flatnonzero(count.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(count[0, at]), pa.array(count[1, at])], ["slot", "c0", "c1"])

    got = shards.mapInArrow(run, "slot int, c0 bigint, c1 bigint").groupBy("slot").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).toArrow()
    count = np.zeros((2, SLOTS), np.float32)
    for t in (0, 1):
        count[t, got.column("slot").to_numpy()] = got.column(f"c{t}").to_numpy()
    return count


def _trained(shards: DataFrame, net: Net) -> Net:
    """``net`` after EPOCHS over all shards. In each, every shard goes on from the same net, and the mean of the changes is added to it.

    A row of the embedding table takes the mean over the shards that changed it. Changes are summed as whole numbers, so that
    the order of tasks doesn't matter.
    """
    spark = shards.sparkSession
    names = [f"v{i}" for i in range(DIM + 1)]
    for number in range(EPOCHS):
        shared = share(spark, net)

        def run(batches, shared=shared, number=number):
            before, total = opened(shared).packed(), None
            for batch in batches:
                for shard, docs, y in _texts(batch):
                    mine = opened(shared)
                    epoch(mine, docs, y.astype(np.float32), np.random.default_rng([11, number, shard]))
                    change = np.rint((mine.packed() - before) * UNIT).astype(np.int64)
                    touched = change.any(axis=1)
                    touched[SLOTS:] = True
                    if total is None:
                        total, n = change, touched.astype(np.int64)
                    else:
                        total += change
                        n += touched
            if total is not None:
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), *[pa.array(total[at, i]) for i in range(DIM + 1)]], ["slot", "n", *names])

        made = shards.mapInArrow(run, "slot int, n bigint, " + ", ".join(f"{c} bigint" for c in names))
        got = made.groupBy("slot").agg(*[F.sum(c).alias(c) for c in ("n", *names)]).toArrow()
        packed = net.packed()
        sums = np.stack([got.column(c).to_numpy() for c in names], axis=1)
        packed[got.column("slot").to_numpy()] += sums / (got.column("n").to_numpy()[:, None] * float(UNIT))
        net.unpack(packed)
        shared.destroy()
    return net


def _curve(rows: DataFrame, net: Net) -> tuple[float, float, dict]:
    """Slope, constant and thresholds by language from all of ``rows``, log-odds taken to a thousandth or so; groups are as large as that grid."""
    spark = rows.sparkSession
    shared = share(spark, net)

    def run(batches):
        m = opened(shared)
        for batch in batches:
            texts = batch.column("ids").to_pylist()
            for lo, hi in slices(np.array([len(t) for t in texts])):
                sizes = np.array([len(t) // 6 for t in texts[lo:hi]])
                z = m.score(np.frombuffer(b"".join(texts[lo:hi]), np.uint16).reshape(-1, 3), np.cumsum(sizes) - sizes)
                at = np.rint(np.clip(z.astype(np.float64), -60, 60) * GRID).astype(np.int32)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("y"), pa.array(at)], ["lang", "y", "at"])

    counted = rows.select("lang", "y", "ids").mapInArrow(run, "lang string, y int, at int").groupBy("lang", "at").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n"))
    counted = put(counted, "calibration")
    got = counted.groupBy("at").agg(F.sum("y").alias("y"), F.sum("n").alias("n")).orderBy("at").toArrow()
    a, b = calibrated(*[got.column(c).to_numpy() / d for c, d in (("at", GRID), ("y", 1), ("n", 1))])

    def limit(key, part):
        z = part.column("at").to_numpy() / GRID
        order = np.argsort(z)
        q = 1 / (1 + np.exp(-np.clip(a * z[order] + b, -30, 30)))
        best = best_threshold(q, part.column("y").to_numpy()[order], part.column("n").to_numpy()[order])
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "best": pa.array([best], pa.float64())})

    limits = counted.groupBy("lang").applyInArrow(limit, "lang string, best double").where("best is not null").collect()
    free(counted)
    shared.destroy()
    return a, b, {r.lang: r.best for r in sorted(limits)}


def train(docs: DataFrame, labels: DataFrame) -> dict | None:
    """Net, calibration and thresholds from all labelled rows whose crc32(doc_id) mod 4 isn't 2; None without both classes.

    A document with several labels counts by the majority, ties as toxic; null labels and ids are skipped. A quarter of the rows, by a hash of the
    id, calibrates; without both classes on either side all rows do both.
    """
    rows = _labelled(docs, labels)
    groups = rows.groupBy("checks", "y").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("ids")).alias("bytes")).collect()
    if len({g.y for g in groups}) < 2:
        free(rows)
        return None
    split = len(groups) == 4
    learned = [g for g in groups if not (split and g.checks)]
    n = np.array([sum(g.n for g in learned if g.y == t) for t in (0, 1)])
    n_shards = int(max(1, -(-n.sum() // SHARD_ROWS), -(-sum(g.bytes for g in learned) // SHARD_BYTES)))
    shards = _shards(rows.where("not checks") if split else rows, n_shards)
    net = _trained(shards, started(_counted(shards), n))
    free(shards)
    a, b, thresholds = _curve(rows.where("checks") if split else rows, net)
    free(rows)
    net.seen, net.seen_table = [], None
    return {"net": net, "a": a, "b": b, "thresholds": thresholds}


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (score at least 0.3), and by the language's own threshold: lang_threshold, lang_predicted.

    Null and empty texts are scored as texts without words. Without labels of both classes every score is 0. A null doc_id isn't held out.
    """
    model = train(docs, labels)
    shared = share(docs.sparkSession, model)

    def start():
        known, m = Remembered(slots), opened(shared)

        def work(texts, part):
            known.trim()
            if m is None:
                return [[0.0] * len(texts)]
            z = m["net"].score(*slot_ids(texts, known)).astype(np.float64)
            return [(1 / (1 + np.exp(-np.clip(m["a"] * z + m["b"], -30, 30)))).tolist()]

        return work

    out = over_texts(docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text"), ["doc_id", "lang"], "score double", start)
    limits = model["thresholds"] if model else {}
    limit = F.lit(THRESHOLD)
    for lang, t in limits.items():
        limit = F.when(F.coalesce("lang", F.lit("None")) == lang, F.lit(t)).otherwise(limit)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    out = out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), limit.alias("lang_threshold"))
    return out.withColumn("lang_predicted", (F.col("score") >= F.col("lang_threshold")).cast("int"))
