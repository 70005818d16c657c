"""Mixing sources to target weights: every source's words come as near to its budget as whole documents allow.

A source that is to give more words than it has gives whole copies of all its documents first; what is left of its budget is a subset-sum problem
over document lengths. Documents are counted by (source, length), so a source's problem holds one row for each of its lengths, however many
documents have it. Every length first gives its share of the budget, rounded down; then one more document of as many lengths as fit, in
seeded order; a bounded knapsack by dynamic programming over the remaining words, fewer than one document's, closes the rest. Last, documents
are picked by length count in seeded order of their ids.

Defined results: null and empty texts have size 0 and give no words; null is a source, the last one; a source without words has target 0.
Rows that repeat a doc_id are documents of their own. Which of several documents of one source, length and doc_id are taken makes no difference
to the rows returned. Empty tables have no rows. Columns other than doc_id, source and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowgrad.llm.texts import free, hinted, put
from rowgrad.operators.ranking import row_positions

# Shares of the sources in code point order, over and over; all sources together give so much of all words; none gives more than so many copies.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
COPIES = 2
SEED = 11
# Sums that the knapsack tells apart; a wider rest is first narrowed by whole documents, the longest ones that fit.
DP_WORDS = 1 << 20


def sizes(docs: DataFrame) -> DataFrame:
    """``(doc_id, src, size)``: words of every document; ``src`` is the source behind a mark that sorts null after all others."""
    src = F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1"))
    words = F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.select("doc_id", src.alias("src"), F.coalesce(words, F.lit(0)).cast("long").alias("size"))


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, copies: int = COPIES) -> DataFrame:
    """``totals`` ``(src, source_size)`` with ``target``: words by weight, capped at ``copies`` times the source, the excess shared again.

    A round shares what is left among the sources below their cap and caps those that would pass it; the tables of sources stay in Spark and a
    round brings two sums to the driver.
    """
    placed = row_positions(totals, ["src"], name="place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    open_ = placed.select("src", "source_size", weight.alias("weight"), (F.col("source_size") * copies).alias("cap"))
    open_ = put(open_, "mixing-sources")
    level, n_open = None, None
    budget = (open_.agg(F.sum("source_size")).first()[0] or 0) * share
    while True:
        # capped sources give their cap, the others level x weight
        below = F.lit(True) if level is None else F.col("weight") * F.lit(level[0]) / F.lit(level[1]) <= F.col("cap")
        got = open_.agg(
            F.sum(F.when(below, F.col("weight"))).alias("weights"), F.sum(F.when(~below, F.col("cap"))).alias("capped"), F.count_if(below).alias("n")
        ).first()
        if not got["weights"] or got["n"] == n_open:
            break
        n_open, level = got["n"], (float(budget - (got["capped"] or 0)), float(got["weights"]))
    fair = F.col("cap").cast("double") if level is None else F.least(F.col("weight") * F.lit(level[0]) / F.lit(level[1]), F.col("cap").cast("double"))
    return put(open_.select("src", "source_size", fair.alias("target")), "mixing-targets")


def fitted(lengths: np.ndarray, counts: np.ndarray, budget: int, order: np.ndarray) -> np.ndarray:
    """How many documents of each length to take, of ``counts``, so that their words come nearest to ``budget``.

    ``lengths`` are distinct and positive; ``order`` is the seeded order in which lengths give one more. A plain function of its arguments.
    """
    total = sum(int(n) * int(c) for n, c in zip(lengths, counts))
    if budget >= total:
        return counts.copy()
    taken = np.array([int(c) * budget // total for c in counts], np.int64)
    left = budget - sum(int(n) * int(k) for n, k in zip(lengths, taken))
    spare = counts - taken
    # one more of a run of lengths, as many as fit: what is left is then less than the next length
    running = np.cumsum(lengths[order])
    more = order[: int(np.searchsorted(running, left, side="right"))]
    taken[more] += 1
    spare[more] -= 1
    left -= int(lengths[more].sum())
    for i in np.argsort(-lengths, kind="stable"):
        if left < DP_WORDS:
            break
        k = min(int(spare[i]), left // int(lengths[i]))
        taken[i], spare[i], left = taken[i] + k, spare[i] - k, left - k * int(lengths[i])
    return taken + knapsack(lengths, spare, left, order)


def knapsack(lengths: np.ndarray, spare: np.ndarray, left: int, order: np.ndarray) -> np.ndarray:
    """Counts of at most ``spare`` whose words are nearest to ``left``, the smaller sum on a tie: bounded knapsack over reachable sums.

    Counts are split into powers of two, so each part is taken once or not; a sum remembers the part that first reached it, and
    the sum before was reached by earlier parts.
    """
    taken = np.zeros(len(lengths), np.int64)
    open_ = [int(i) for i in order if spare[i] > 0]
    if left <= 0 or not open_:
        return taken
    reach_to = 2 * left  # no sum beyond is nearer than taking nothing
    mask, reached = (1 << (reach_to + 1)) - 1, 1
    parts: list[tuple[int, int, int]] = []  # length index, copies, words
    came_by = np.full(reach_to + 1, -1, np.int32)
    for i in open_:
        rest, k = min(int(spare[i]), reach_to // int(lengths[i])), 1
        while rest > 0 and not reached >> left & 1:
            k = min(k, rest)
            words = k * int(lengths[i])
            new = (reached << words) & mask & ~reached
            if new:
                bits = np.frombuffer(new.to_bytes(reach_to // 8 + 1, "little"), np.uint8)
                came_by[np.flatnonzero(np.unpackbits(bits, bitorder="little"))] = len(parts)
                parts.append((i, k, words))
                reached |= new
            rest, k = rest - k, k * 2
        if reached >> left & 1:
            break
    below = (reached & ((1 << (left + 1)) - 1)).bit_length() - 1
    above = reached >> left
    over = left + (above & -above).bit_length() - 1 if above else None
    at = over if over is not None and over - left < left - below else below
    while at:
        i, k, words = parts[came_by[at]]
        taken[i] += k
        at -= words
    return taken


def seeded(column: Column, seed: int) -> Column:
    return F.xxhash64(column, F.lit(seed))


def length_counts(found: DataFrame, wanted: DataFrame, seed: int) -> DataFrame:
    """``(src, size, extra)``: how many documents of each source and length are taken once more than the source's whole copies."""
    # some rows a source and length: combined before the shuffle, so a source with a third of all documents weighs no more than another
    counts = found.where("size > 0").groupBy("src", "size").agg(F.count(F.lit(1)).alias("n"))
    asked = counts.join(wanted.select("src", "budget").where("budget > 0"), "src").withColumn("at", seeded(F.col("size"), seed))

    def fit(key, lengths):
        lengths = lengths.sort_by([("at", "ascending"), ("size", "ascending")])
        size = lengths.column("size").to_numpy()
        extra = fitted(size, lengths.column("n").to_numpy(), lengths.column("budget")[0].as_py(), np.arange(len(size)))
        return pa.table({"src": lengths.column("src"), "size": size, "extra": extra})

    return asked.groupBy("src").applyInArrow(fit, "src string, size long, extra long").where("extra > 0")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, copies: int = COPIES, seed: int = SEED) -> DataFrame:
    """How many words the mix takes of every document: ``(doc_id, size, source_size, target, taken)``, one row for each row of ``docs``."""
    found = put(sizes(docs), "mixing-sizes")
    totals = found.groupBy("src").agg(F.sum("size").alias("source_size"))
    wanted = targets(totals, weights, share, copies)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(copies))).otherwise(F.lit(0)).cast("long")
    wanted = wanted.withColumn("whole", whole)
    wanted = wanted.withColumn("budget", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    extra = put(length_counts(found, wanted, seed), "mixing-extra")

    n_extra, n_sources = extra.count(), wanted.count()
    # places by a seeded order inside a source and length, spread by ranges: equal rows are told apart by their places in the written table
    drawn = found.withColumns({"draw": seeded(F.col("doc_id"), seed), "at": F.monotonically_increasing_id()})
    drawn = drawn.join(hinted(extra, n_extra, 64), ["src", "size"], "left")
    closed, contested = drawn.where("extra is null"), drawn.where("extra is not null")
    placed = row_positions(contested, ["draw", "doc_id", "at"], ["src", "size"], name="place")
    more = placed.select("doc_id", "src", "size", (F.col("place") <= F.col("extra")).alias("more"))
    rows = more.unionByName(closed.select("doc_id", "src", "size", F.lit(False).alias("more")))
    rows = rows.join(hinted(wanted, n_sources, 128), "src")
    taken = F.col("size") * (F.col("whole") + F.col("more").cast("long"))
    out = put(rows.select("doc_id", "size", "source_size", "target", taken.alias("taken")), "mixing")
    free(found, extra)
    return out
