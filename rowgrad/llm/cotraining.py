"""Quality classifier by co-training.

Two classifiers see a document in different ways: one its text content (hashed byte trigrams and their spread), one its page metadata (language,
source, length and line layout). Both learn from labelled rows; over some rounds each scores all unlabelled documents, labels those of which it
is most confident and hands them to the other. Each view is calibrated on labelled rows kept apart, and a small calibrated
model over both gives the score. The labelled rows are a bounded sample; a round hands over TAKE rows a view, chosen among all documents; every
document is scored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowgrad.llm.texts import over_texts

# At most about so many labelled rows are drawn (by hash, so that the draw is the same each time).
LABELLED = 6_000
# Each view hands so many rows of both classes together to the other in each round, none of a lower probability.
ROUNDS, TAKE, SURE = 4, 200, 0.98
BUCKETS, LANGS, SOURCES = 1024, 8, 32
REJECT_BELOW = 0.5


def content_view(text: bytes) -> np.ndarray:
    """Square roots of trigram counts by bucket, of length 1, and how evenly trigrams are spread."""
    out = np.zeros(BUCKETS + 3, np.float32)
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return out
    h = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(22)
    c = np.bincount(h, minlength=BUCKETS)
    out[:BUCKETS] = np.sqrt(c / len(h))
    p = c[c > 0] / len(h)
    out[BUCKETS:] = p.max(), -(p * np.log2(p)).sum() / min(10.0, np.log2(len(h) + 1)), len(p) / min(len(h), BUCKETS)
    return out


def metadata_view(text: bytes, lang, source, n_chars) -> np.ndarray:
    """Language and source (hashed), stated length, number and length of lines."""
    from zlib import crc32

    out = np.zeros(LANGS + SOURCES + 5, np.float32)
    out[crc32(str(lang).encode()) % LANGS] = 1
    out[LANGS + crc32(str(source).encode()) % SOURCES] = 1
    lines, size = text.count(b"\n") + 1, len(text)
    stated = size if n_chars is None else max(0, int(n_chars))
    blanks = text.count(b" ")
    out[LANGS + SOURCES :] = np.log1p(stated) / 10, np.log1p(lines) / 5, np.log1p(size / lines) / 10, size / (blanks + 1) / 20, (size == 0)
    return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, steps: int = 250, decay: float = 1e-5) -> np.ndarray:
    """Logistic regression by Adam; the last coefficient is the constant."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32)
    w, m, v = (np.zeros(x.shape[1], np.float32) for _ in range(3))
    weight = np.ones(len(y), np.float32) if weight is None else weight
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)).astype(np.float32) / max(1.0, float(weight.sum())) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def proba(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


Pick = Callable[[list[np.ndarray], list[np.ndarray], dict[int, int], list[set[int]]], list[tuple[int, int, int, list[np.ndarray]]]]


def cotrain(views: list[np.ndarray], y: np.ndarray, check: np.ndarray, pick: Pick) -> dict | None:
    """Both views' coefficients and the calibrated combination.

    ``views`` and ``y`` are the labelled rows', of which those in ``check`` only calibrate. ``pick`` gets both models, their calibrations, how many rows of
    each class are wanted and the keys that each view was handed before; it returns the rows of which a view is surest: (view, label, key,
    the row in both views), which go to the other view. None if one class has no labelled row.
    """
    learn = ~check
    if len(set(y[learn].tolist())) < 2:
        return None
    if len(set(y[check].tolist())) < 2:
        check = learn
    share = y[learn].mean()
    wanted = {1: int(TAKE * share), 0: TAKE - int(TAKE * share)}
    xs, ys = [[v[learn]] for v in views], [[y[learn]] for _ in views]
    handed: list[set[int]] = [set() for _ in views]
    models = []
    for r in range(ROUNDS + 1):
        models = [fit(np.vstack(x), np.concatenate(t).astype(np.float32)) for x, t in zip(xs, ys, strict=True)]
        if r == ROUNDS:
            break
        # confident by the calibrated probability, not by the raw one
        calibrated = [fit(logit(v[check], m)[:, None], y[check].astype(np.float32), steps=150) for v, m in zip(views, models, strict=True)]
        for a, label, key, row in pick(models, calibrated, wanted, handed):
            handed[1 - a].add(key)
            xs[1 - a].append(row[1 - a][None])
            ys[1 - a].append(np.array([label]))
    z = np.stack([logit(v[check], m) for v, m in zip(views, models, strict=True)], axis=1)
    each = [fit(z[:, [k]], y[check].astype(np.float32), steps=300) for k in (0, 1)]
    both = fit(np.stack([logit(z[:, [k]], each[k]) for k in (0, 1)], axis=1), y[check].astype(np.float32), steps=300)
    return {"models": models, "each": each, "both": both, "taken": [len(h) for h in handed]}


def score(views: list[np.ndarray], model: dict) -> tuple[np.ndarray, ...]:
    """Probability of good quality: combined, by content, by metadata."""
    z = [logit(logit(x, m)[:, None], e) for x, m, e in zip(views, model["models"], model["each"], strict=True)]
    return proba(logit(np.stack(z, axis=1), model["both"])), proba(z[0]), proba(z[1])


def _views(texts, part, at):
    cols = [part.column(k).to_pylist() for k in at]
    content = np.stack([content_view(t or b"") for t in texts])
    return content, np.stack([metadata_view(t or b"", *c) for t, *c in zip(texts, *cols, strict=True)])


def _rows_of_views(rows: DataFrame, keep: list[str]) -> pa.Table:
    """A bounded table's ``keep`` columns and both views, a and b, on the driver; ``rows`` has lang, source, n_chars and text as well."""

    def start():
        def work(texts, part):
            a, b = _views(texts, part, (len(keep), len(keep) + 1, len(keep) + 2))
            return [pa.array(list(a), pa.list_(pa.float32())), pa.array(list(b), pa.list_(pa.float32()))]

        return work

    made = over_texts(rows, [*keep, "lang", "source", "n_chars"], "a array<float>, b array<float>", start)
    return made.select(*keep, "a", "b").toArrow()


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).combine_chunks().values.to_numpy().reshape(table.num_rows, -1).astype(np.float32)


def picker(pool: DataFrame) -> Pick:
    """``pick`` over all rows of ``pool`` (mark, lang, source, n_chars, text): rows of equal ``mark`` are one.

    Probabilities come back as two numbers a row, the surest rows are ranked in Spark, and only those chosen reach the driver.
    """
    spark = pool.sparkSession

    def pick(models, calibrated, wanted, handed):
        shared = spark.sparkContext.broadcast((models, calibrated))

        def start():
            def work(texts, part):
                ms, cs = shared.value
                views = _views(texts, part, (1, 2, 3))
                return [proba(logit(logit(v, m)[:, None], c)).astype(np.float64).tolist() for v, m, c in zip(views, ms, cs, strict=True)]

            return work

        scored = over_texts(pool, ["mark", "lang", "source", "n_chars"], "p0 double, p1 double", start)
        each = [F.struct(F.lit(a).alias("view"), F.lit(label).alias("label"), F.round(sure, 6).alias("sure")) for a, p in ((0, F.col("p0")), (1, F.col("p1"))) for label, sure in ((1, p), (0, 1 - p))]
        rows = scored.select("mark", F.explode(F.array(*each)).alias("x")).select("mark", "x.*").where(F.col("sure") >= SURE)
        for a in (0, 1):
            rows = rows.where((F.col("view") != a) | ~F.col("mark").isin(sorted(handed[1 - a]))) if handed[1 - a] else rows
        rows = rows.groupBy("view", "label", "mark").agg(F.max("sure").alias("sure"))
        place = F.row_number().over(Window.partitionBy("view", "label").orderBy(F.desc("sure"), "mark"))
        best = rows.withColumn("at", place).where(F.col("at") <= TAKE).collect()
        best = sorted((r["view"], r["label"], r["at"], r["mark"]) for r in best if r["at"] <= wanted[r["label"]])
        shared.destroy()
        if not best:
            return []
        chosen = pool.where(F.col("mark").isin(sorted({m for *_, m in best}))).dropDuplicates(["mark"])
        got = _rows_of_views(chosen, ["mark"])
        at, both = {m: i for i, m in enumerate(got.column("mark").to_pylist())}, [_matrix(got, k) for k in ("a", "b")]
        return [(a, label, m, [v[at[m]] for v in both]) for a, label, _, m in best]

    return pick


def train(docs: DataFrame, labels: DataFrame) -> dict | None:
    """A model from labelled rows whose crc32(doc_id) mod 4 isn't 2 (those are held out), and unlabelled ones; None without both classes.

    A document with several labels counts by the majority, ties as good; null labels and ids are skipped. Of rows that repeat a labelled doc_id
    one is learnt from. Held-out rows and those learnt from aren't pseudo-labelled; of equal rows one is.
    """
    named = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    truth = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y")).where(named % 4 != 2)
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(2)), F.lit(1 << 20))
    # about LABELLED rows by construction, whatever the tables' sizes
    truth = truth.where(draw < int((1 << 20) * min(1.0, LABELLED / max(1, truth.count())))).withColumnRenamed("doc_id", "id")
    read = docs.select(F.col("doc_id").alias("id"), "lang", "source", "n_chars", F.col("text").cast("string").alias("text"))
    fields = F.struct(F.xxhash64("text").alias("h"), "lang", "source", "n_chars", "text")
    some = read.join(F.broadcast(truth), "id").groupBy("id", "y").agg(F.min(fields).alias("r")).select("id", "y", "r.*")
    got = _rows_of_views(some, ["id", "y"])
    if not got.num_rows:
        return None
    order = np.argsort(got.column("id").to_numpy(), kind="stable")  # rows arrive in any order
    views = [_matrix(got, k)[order] for k in ("a", "b")]
    y, ids = (got.column(k).to_numpy()[order] for k in ("y", "id"))
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    pool = read.where(~held).join(F.broadcast(truth.select("id")), "id", "left_anti")
    pool = pool.select(F.xxhash64("id", "lang", "source", "n_chars", "text").alias("mark"), "lang", "source", "n_chars", "text")
    return cotrain(views, y, ids * 2654435761 % 1000 < 250, picker(pool))


def classify(docs: DataFrame, model: dict | None, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of each row, then __score (probability of good quality), __content and __metadata (by view).

    Null and empty texts are scored like any other. Without a model (no labels of both classes) every score is 1: nothing is rejected.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    carried = [*keep, "lang", "source", "n_chars"]
    # a text that is kept isn't sent a second time
    whole = "text" if "text" in keep else "__whole"
    src = docs.select(*keep, *[F.col(c).alias(f"__{c}") for c in carried[len(keep) :]], *([] if "text" in keep else [F.col("text").alias("__whole")]))
    at = tuple(range(len(keep), len(keep) + 3))

    def start():
        def work(texts, part):
            if shared.value is None:
                return [[1.0] * len(texts)] * 3
            p = score(list(_views(texts, part, at)), shared.value)
            return [x.tolist() for x in p]

        return work

    return over_texts(src, [*keep, "__lang", "__source", "__n_chars"], "__score double, __content double, __metadata double", start, whole).drop("__lang", "__source", "__n_chars")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score, content_score, metadata_score, held_out (never learnt from), kept."""
    out = classify(docs, train(docs, labels), ["doc_id"])
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return out.select("doc_id", F.col("__score").alias("score"), F.col("__content").alias("content_score"), F.col("__metadata").alias("metadata_score"), F.coalesce(held, F.lit(False)).alias("held_out"), (F.col("__score") >= REJECT_BELOW).alias("kept"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier doesn't reject."""
    return classify(docs, train(docs, labels), docs.columns).where(F.col("__score") >= REJECT_BELOW).select(*docs.columns)
