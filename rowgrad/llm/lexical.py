"""Ranked lexical search over bit-sliced Bloom signatures.

Documents of similar size share a block of the index: a matrix of bits with a column for each document and a row, a slice, for each hash value. A
document sets four slices for every term, and four more for every floor (1, 2, 3, 4, 6, 9, …) that the term's count reaches. The and of a
term's slices shows all documents that hold it so often, and a few that don't. Counts rounded up to the next floor, and each document's own
length, turn these bitmaps into upper bounds: sums of weighted slices. Documents whose bound is below the exact score of an item's twentieth best
probe can't be among its best; all others are read again and scored exactly.

The index is made once for any items. Items come in blocks of bounded size; a block's terms, weights and thresholds go to all tasks.

Defined results: null texts, and texts without terms, are never found and don't count. Rows that repeat a doc_id are documents of
their own, also where it is null, which sorts first. Items without terms have no rows; rows that repeat an item's id and text count once, an
item_id with several texts has a ranking for each. Empty tables give none. Columns other than doc_id, item_id and text are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowgrad.llm.texts import C1, C2, Remembered, free, hash_word, hinted, mix, opened, over_texts, put, share, slices

TOP = 20
HASHES = 4
BITS = 10  # slices for each entry of a block's fullest documents
BLOCK_CELLS = 1 << 22  # bits of a block, but for the documents that need more by themselves
BLOCK_DOCS = 512
ITEM_BYTES = 4 << 20  # texts of items that are searched for at a time
WORK_CELLS = 1 << 21  # terms x documents whose bounds a task works out at a time
U = np.uint64

_SPLIT = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b > 127 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII; only A-Z are lower-cased."""
    return [] if text is None else text.translate(_SPLIT).split()


def _floors() -> np.ndarray:
    """Counts from which a term is entered once more; each half as large again as the one before."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return np.array(out, np.int64)


FLOORS = _floors()
# The largest count of a term that reaches so many floors; none is 0.
REACH = np.concatenate([[0], FLOORS[1:] - 1, [np.iinfo(np.int64).max]]).astype(np.float64)


def entries(hashes: np.ndarray, level: np.ndarray | int) -> np.ndarray:
    """One key for each term and floor."""
    return mix(hashes, np.atleast_1d(np.asarray(level, np.uint64)) * C1 + C2)


def slots(keys: np.ndarray, n_slices: int) -> np.ndarray:
    """The slices of each key, one row for each hash function."""
    first, step = keys >> U(32), keys & U(0xFFFFFFFF) | U(1)
    return ((first + np.arange(HASHES, dtype=np.uint64)[:, None] * step) % U(n_slices)).astype(np.int64)


def signed(held: list[tuple[int | None, int, np.ndarray]], n_slices: int) -> bytes:
    """The slices of a block, each a bitmap over its documents."""
    cells = np.zeros((n_slices, len(held)), np.uint8)
    for column, (_, _, keys) in enumerate(held):
        cells[slots(keys, n_slices).reshape(-1), column] = 1
    return np.packbits(cells, axis=1).tobytes()


INDEX = "docs array<bigint>, lengths array<bigint>, n_slices int, slices binary"


def index(docs: DataFrame) -> DataFrame:
    """Blocks of signatures of all documents with terms: their ids, their numbers of terms, and the slices.

    A task groups documents by the number of their entries, in steps of half an octave, so that long ones don't fill up the slices of others.
    """

    def block(held, n_slices):
        ids, lengths = pa.array([[d for d, _, _ in held]], pa.list_(pa.int64())), pa.array([[n for _, n, _ in held]], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([ids, lengths, pa.array([n_slices], pa.int32()), pa.array([signed(held, n_slices)], pa.binary())], ["docs", "lengths", "n_slices", "slices"])

    def run(batches):
        hashes, classes = Remembered(hash_word), {}
        for batch in batches:
            for lo, hi in slices(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()):
                part = batch.slice(lo, hi - lo)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    counts = Counter(terms_of(text))
                    if not counts:
                        continue
                    keys = np.fromiter(map(hashes.__getitem__, counts), np.uint64, len(counts))
                    hashes.trim()
                    times = np.fromiter(counts.values(), np.int64, len(counts))
                    reached = np.searchsorted(FLOORS, times, side="right")
                    levels = np.arange(reached.sum()) - np.repeat(np.cumsum(reached) - reached, reached)
                    made = entries(np.repeat(keys, reached), levels)
                    half = math.ceil(2 * math.log2(len(made)))
                    n_slices = max(16, math.ceil(BITS * 2 ** (half / 2)))
                    held = classes.setdefault(n_slices, [])
                    held.append((doc, int(times.sum()), made))
                    if len(held) >= BLOCK_DOCS or (len(held) + 1) * n_slices > BLOCK_CELLS:
                        yield block(classes.pop(n_slices), n_slices)
        for n_slices, held in classes.items():
            yield block(held, n_slices)

    return docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, INDEX)


@dataclass
class Asked:
    """A block of item texts: their terms, and for each text the terms' numbers and how often it has them."""

    terms: dict[bytes, int]
    items: list[tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def of(texts: list[bytes]) -> "Asked":
        terms, items = {}, []
        for text in texts:
            counts = Counter(terms_of(text))
            which = np.fromiter((terms.setdefault(t, len(terms)) for t in counts), np.int64, len(counts))
            items.append((which, np.fromiter(counts.values(), np.int64, len(counts))))
        return Asked(terms, items)


@dataclass
class Weighted:
    """An ``Asked`` with its terms' weights, the corpus' counts and, for the last pass, the scores that an item's best have at least."""

    asked: Asked
    weights: np.ndarray
    n_docs: int
    n_terms: int
    least: np.ndarray | None = None

    def spread(self, length: int) -> int:
        """A document's ``m``."""
        return 100 - 25 + (25 * length * self.n_docs) // self.n_terms


def frequencies(docs: DataFrame, asked: Asked) -> np.ndarray:
    """How many documents hold each of the asked terms; one number for each of them comes back."""
    shared = share(docs.sparkSession, asked)

    def run(batches):
        terms = opened(shared).terms
        found = np.zeros(len(terms), np.int64)
        for batch in batches:
            for text in batch.column(0):
                here = terms.keys() & set(terms_of(text.as_py()))
                found[[terms[t] for t in here]] += 1
        which = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(found[which], pa.int64())], ["term", "n"])

    counted = docs.select(F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, "term int, n bigint")
    out = np.zeros(len(asked.terms), np.int64)
    for r in counted.groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["term"]] = r["n"]
    shared.destroy()
    return out


def bounds(block: dict, weighted: Weighted, keys: np.ndarray):
    """For parts of a block's documents: the first of them, and an upper bound of each item's score in each, items in rows."""
    n, n_slices = len(block["docs"]), block["n_slices"]
    packed = np.frombuffer(block["slices"], np.uint8).reshape(n_slices, -1)
    step = max(8, WORK_CELLS // max(1, len(keys)) // 8 * 8)
    for lo in range(0, n, step):
        hi, part = min(n, lo + step), packed[:, lo // 8 : (lo + step) // 8]
        reached = np.zeros((len(keys), hi - lo), np.uint8)
        alive, bits = np.arange(len(keys)), None
        for level in range(len(FLOORS)):
            at = slots(entries(keys[alive], level), n_slices)
            here = part[at[0]]
            for other in at[1:]:
                here &= part[other]
            if bits is not None:
                here &= bits
            some = here.any(axis=1)
            alive, bits = alive[some], here[some]
            if not len(alive):
                break
            reached[alive] += np.unpackbits(bits, axis=1)[:, : hi - lo]
        length = np.asarray(block["lengths"][lo:hi], np.float64)
        least_m = np.floor(75 + 25.0 * length * weighted.n_docs / weighted.n_terms * (1 - 1e-12)) - 1
        times = REACH[reached]
        gain = np.floor(1e9 * times / (1000 * times + 12 * least_m)) + (times > 0)
        yield lo, np.stack([(counts * weighted.weights[which]).astype(np.float64) @ gain[which] if len(which) else np.zeros(hi - lo) for which, counts in weighted.asked.items]) * (1 + 1e-9)


def _over_blocks(blocks: DataFrame, weighted: Weighted, schema: str, work) -> DataFrame:
    """``work(parts)`` of each task, where ``parts`` yields a part's ids and bounds."""
    shared = share(blocks.sparkSession, weighted)

    def run(batches):
        mine = opened(shared)
        keys = np.fromiter(map(hash_word, mine.asked.terms), np.uint64, len(mine.asked.terms))

        def parts():
            for batch in batches:
                for i in range(batch.num_rows):
                    ids = batch.column("docs")[i].values
                    block = {"docs": ids, "n_slices": batch.column("n_slices")[i].as_py(), "slices": batch.column("slices")[i].as_buffer(), "lengths": batch.column("lengths")[i].values.to_numpy()}
                    for lo, upper in bounds(block, mine, keys):
                        yield ids.slice(lo, upper.shape[1]), upper

        yield from work(mine, parts())

    return blocks.mapInArrow(run, schema)


def probes(blocks: DataFrame, weighted: Weighted, top: int = TOP) -> DataFrame:
    """``(item, doc_id)``: the documents with each item's ``top`` highest bounds."""

    def best(mine, parts):
        # the best so far of this task, an item a row
        n = len(mine.asked.items)
        held, ids = np.zeros((n, 0)), pa.array([], pa.int64())
        places = np.zeros((n, 0), np.int64)
        for docs, upper in parts:
            both = np.concatenate([held, upper], axis=1)
            at = np.concatenate([places, np.broadcast_to(np.arange(len(docs)) + len(ids), upper.shape)], axis=1)
            ids = pa.concat_arrays([ids, docs])
            if both.shape[1] > top:
                chosen = np.argpartition(-both, top - 1, axis=1)[:, :top]
                both, at = np.take_along_axis(both, chosen, axis=1), np.take_along_axis(at, chosen, axis=1)
            used, at = np.unique(at, return_inverse=True)
            held, places, ids = both, at.reshape(both.shape), ids.take(pa.array(used))
        item, k = np.nonzero(held > 0)
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), ids.take(pa.array(places[item, k])), pa.array(held[item, k])], ["item", "doc_id", "bound"])

    rows = _over_blocks(blocks, weighted, "item int, doc_id bigint, bound double", best)
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "doc_id")
    return rows.withColumn("at", F.row_number().over(order)).where(F.col("at") <= top).select("item", "doc_id")


def possible(blocks: DataFrame, weighted: Weighted) -> DataFrame:
    """``(item, doc_id)``: all documents whose bound reaches ``weighted.least``; no other can be among an item's best."""

    def reaching(mine, parts):
        for docs, upper in parts:
            item, column = np.nonzero((upper > 0) & (upper >= mine.least[:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), docs.take(pa.array(column))], ["item", "doc_id"])

    return _over_blocks(blocks, weighted, "item int, doc_id bigint", reaching)


def rescored(docs: DataFrame, chosen: DataFrame, weighted: Weighted) -> DataFrame:
    """``(item, doc_id, score)`` of the chosen pairs with scores above 0, from whole texts. A repeated doc_id is scored in each of its rows."""
    spark = docs.sparkSession
    wanted = chosen.distinct().groupBy("doc_id").agg(F.collect_list("item").alias("items"))
    wanted = put(wanted.withColumnRenamed("doc_id", "wanted_id"), "lexical-wanted")
    size = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("items")), F.lit(0))).first()
    small = hinted(wanted, 1, 64 * size[0] + 4 * size[1])
    read = docs.select("doc_id", "text").join(small, F.col("doc_id").eqNullSafe(F.col("wanted_id"))).drop("wanted_id")
    shared = share(spark, weighted)

    def start():
        mine = opened(shared)
        terms = mine.asked.terms
        times = np.zeros(len(terms), np.int64)

        def work(texts, part):
            out = []
            for text, items in zip(texts, part.column(1).to_pylist(), strict=True):
                words = terms_of(text)
                counts = Counter(w for w in words if w in terms)
                which = np.fromiter((terms[t] for t in counts), np.int64, len(counts))
                tf = np.fromiter(counts.values(), np.int64, len(counts))
                times[which] = mine.weights[which] * ((1_000_000_000 * tf) // (1000 * tf + 12 * mine.spread(len(words)))) if words else 0
                out.append([int(mine.asked.items[i][1] @ times[mine.asked.items[i][0]]) for i in items])
                times[which] = 0
            return [out]

        return work

    scores = over_texts(read, ["doc_id", "items"], "scores array<bigint>", start)
    pairs = scores.select("doc_id", F.explode(F.arrays_zip("items", "scores")).alias("p"))
    found = put(pairs.select(F.col("p.items").alias("item"), "doc_id", F.col("p.scores").alias("score")).where("score > 0"), "lexical-scores")
    free(wanted)
    return found


def best_of(scores: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _ranked(docs: DataFrame, blocks: DataFrame, texts: list[bytes], counts: tuple[int, int], top: int) -> DataFrame:
    """``(item, rank, doc_id, score)`` for a block of item texts, which are numbered from 0."""
    asked = Asked.of(texts)
    n_docs, n_terms = counts
    held = frequencies(docs, asked)
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in held.tolist()], np.int64)
    weighted = Weighted(asked, weights, n_docs, n_terms)
    first = rescored(docs, probes(blocks, weighted, top), weighted)
    last = best_of(first, top).where(F.col("rank") == top).select("item", "score").collect()
    least = np.ones(len(texts))
    for r in last:
        least[r["item"]] = r["score"]
    weighted.least = least
    scores = rescored(docs, possible(blocks, weighted), weighted)
    out = put(best_of(scores, top).select("item", "rank", "doc_id", "score"), "lexical-ranked")
    free(first, scores)
    return out


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` best documents of every item: ``(item_id, rank, doc_id, score)``, ties by ascending doc_id."""
    spark = docs.sparkSession
    blocks = put(index(docs), "lexical-index")
    counts = blocks.agg(F.sum(F.size("docs")), F.sum(F.expr("aggregate(lengths, 0L, (s, x) -> s + x)"))).first()
    asked = items.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    texts = asked.select("text").distinct()
    n_bytes = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = 1 + n_bytes // ITEM_BYTES
    out = asked.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    if counts[0] is None:
        return out
    for b in range(n_blocks):
        # a bounded number of bytes, by hashes of distinct texts
        mine = [r["text"] for r in texts.where(F.pmod(F.xxhash64("text"), F.lit(n_blocks)) == b).collect()]
        if not mine:
            continue
        found = _ranked(docs, blocks, [t.encode() for t in mine], tuple(counts), top)
        numbers = spark.createDataFrame(list(enumerate(mine)), "item int, text string")
        named = asked.join(F.broadcast(numbers), "text").select("item_id", "item")
        out = out.unionByName(named.join(found, "item").select("item_id", "rank", "doc_id", "score"))
    out = put(out, "lexical")
    free(blocks)
    return out


_TERMS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
ORACLE = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_TERMS_SQL} AS ts FROM documents),
lens AS (SELECT r, doc_id, CAST(len(ts) AS BIGINT) AS n FROM d WHERE len(ts) > 0),
totals AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM lens),
tf AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY r, term),
q AS MATERIALIZED (SELECT item_id, term, count(*) AS k FROM (SELECT item_id, unnest({_TERMS_SQL}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY item_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM q) GROUP BY term), totals),
m AS (SELECT r, doc_id, 100 - 25 + ((25 * n * nd) // l) AS m FROM lens, totals),
s AS (SELECT q.item_id, m.doc_id, m.r, CAST(sum(q.k * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * m.m))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY q.item_id, m.doc_id, m.r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM s WHERE score > 0) WHERE rank <= 20
"""
