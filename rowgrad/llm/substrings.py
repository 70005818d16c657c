"""Exact repeated passages, by fingerprints and window minima in place of prefix doubling.

The rank of a position, a fingerprint, says which string starts there. Inside a task, ranks of length 8, 16, ... 128 come from pairs of ranks at growing
offsets; Spark doesn't sort and rerank these. It groups twice: of each 400-byte string one 200-byte position stands for it (the one of
smallest rank, so that equal strings choose alike), positions whose rank is unique are dropped, and the rest are told apart by the rank pairs of length 400: first by whole
runs of starts, then start by start where runs differ. Only strings past the threshold are left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowgrad.llm.texts import free, hinted, mix, over_texts, put

LENGTH, HALF = 400, 200
# Bytes that a task ranks at a time; a longer text goes through in overlapping stretches.
STRETCH = 1 << 20


def ranks(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of length HALF and LENGTH at every position of a byte array (at least LENGTH long)."""
    r = b.astype(np.uint64)
    for k in (1, 2, 4):
        r = (r[:-k] << np.uint64(8 * k)) | r[k:]
    for k in (8, 16, 32, 64):
        r = mix(r[:-k], r[k:])
    r = mix(r[: -(HALF - 128)], r[HALF - 128 :])
    return r, mix(r[:-HALF], r[HALF:])


def chosen(r: np.ndarray) -> np.ndarray:
    """For each start of a LENGTH string the leftmost position of smallest rank among those of HALF inside it."""
    w = LENGTH - HALF + 1
    low = np.uint64((1 << 24) - 1)
    key = (r & ~low) | np.arange(len(r), dtype=np.uint64)
    n = len(r) - w + 1
    rows = np.full(-(-len(r) // w) * w, ~np.uint64(0), np.uint64)
    rows[: len(r)] = key
    rows = rows.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.ascontiguousarray(np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1]).ravel()
    return (np.minimum(back[:n], ahead[w - 1 : w - 1 + n]) & low).astype(np.int64)


def runs(b: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """For texts [begin, end) in a byte array: text, first start, further starts, rank and context of each run of starts that choose alike."""
    long = ends - begins >= LENGTH
    if not long.any():
        z = np.zeros(0, np.int64)
        return z, z, z, z, z
    half, full = ranks(b)
    at = chosen(half)
    mark = np.zeros(len(b) + 1, np.int8)
    mark[begins[long]] = 1
    mark[ends[long] - LENGTH + 1] -= 1
    starts = np.flatnonzero(np.cumsum(mark[:-1], dtype=np.int8))
    a = at[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (a[1:] != a[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    s, e = starts[first], starts[np.append(first[1:], len(starts)) - 1]
    a = a[first]
    context = mix(mix(full[s], full[e]), ((e - s) << 32 | (a - s)).astype(np.uint64))
    text = np.searchsorted(begins, s, side="right") - 1
    return text, s - begins[text], e - s, half[a].view(np.int64), context.view(np.int64)


def stretches(sizes: list[int]):
    """Lists of (text, from, to): neighbours together, or overlapping parts of a long text, of about STRETCH bytes."""
    held, total = [], 0
    for i, n in enumerate(sizes):
        if n > STRETCH:
            for lo in range(0, n - LENGTH + 1, STRETCH):
                yield [(i, lo, min(n, lo + STRETCH + LENGTH - 1))]
        else:
            if total + n > STRETCH and held:
                yield held
                held, total = [], 0
            held.append((i, 0, n))
            total += n
    if held:
        yield held


def _anchors(docs: DataFrame) -> DataFrame:
    """(key, s, l, r, c) for each run of starts of each text (key: MD5 of the text; bytes as they are)."""

    def start():
        def work(texts, part):
            out = [([], [], [], []) for _ in texts]
            for pieces in stretches([len(t or b"") for t in texts]):
                pieces = [p for p in pieces if p[2] - p[1] >= LENGTH]
                if not pieces:
                    continue
                b = np.frombuffer(b"".join(texts[i][lo:hi] for i, lo, hi in pieces), np.uint8)
                ends = np.cumsum([hi - lo for _, lo, hi in pieces])
                begins = ends - np.array([hi - lo for _, lo, hi in pieces])
                which, s, more, r, c = runs(b, begins, ends)
                s = s + np.array([lo for _, lo, _ in pieces])[which]
                cuts = np.searchsorted(which, np.arange(len(pieces) + 1))
                for k, (i, _, _) in enumerate(pieces):
                    for into, col in zip(out[i], (s, more, r, c), strict=True):
                        into.append(col[cuts[k] : cuts[k + 1]])
            lists = [[np.concatenate(x[k]) if x[k] else np.zeros(0, np.int64) for x in out] for k in range(4)]
            return [pa.array(col, pa.list_(kind)) for col, kind in zip(lists, (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)]

        return work

    rows = over_texts(docs, ["key"], "s array<int>, l array<int>, r array<bigint>, c array<bigint>", start)
    return rows.select("key", F.explode(F.arrays_zip("s", "l", "r", "c")).alias("x")).select("key", "x.*")


def _starts(texts: DataFrame) -> DataFrame:
    """(r, g, c, k, n) for each start of the runs listed in ``texts`` (text, wanted array<struct<s,l,r,c,n>>); g: the rank of length LENGTH, k: the how-manieth start."""

    def run(batches):
        for batch in batches:
            whole, wanted = batch.column(0), batch.column(1)
            held, size = [], 0
            for i in range(batch.num_rows):
                text = None
                for x in wanted[i].as_py():
                    text = whole[i].as_py() if text is None else text
                    held.append((text[x["s"] : x["s"] + x["l"] + LENGTH], x))
                    size += len(held[-1][0])
                    if size > STRETCH:
                        yield _ranked(held)
                        held, size = [], 0
            if held:
                yield _ranked(held)

    def _ranked(held):
        sizes = np.array([len(t) for t, _ in held])
        begins = np.cumsum(sizes) - sizes
        full = ranks(np.frombuffer(b"".join(t for t, _ in held), np.uint8))[1]
        n = sizes - LENGTH + 1
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        g = full[np.repeat(begins, n) + k]
        of = [np.repeat(np.array([x[f] for _, x in held], np.int64), n) for f in ("r", "c", "n")]
        return pa.RecordBatch.from_arrays([pa.array(of[0]), pa.array(g.view(np.int64)), pa.array(of[1]), pa.array(k.astype(np.int32)), pa.array(of[2])], names=["r", "g", "c", "k", "n"])

    return texts.select("text", "wanted").mapInArrow(run, "r bigint, g bigint, c bigint, k int, n bigint")


def repeated(docs: DataFrame) -> DataFrame:
    """(key, found array<struct<s,e>>): by text, the starts (first to last, bytes) of LENGTH strings that start anywhere else too.

    ``docs`` has key and text (bytes, not null); a text that occurs twice counts twice.
    """
    anchors = put(_anchors(docs), "anchors")
    often = put(anchors.groupBy("r").count().where("count > 1").select("r"), "often")
    some = put(anchors.join(often, "r", "left_semi"), "some")
    free(anchors, often)
    groups = some.groupBy("r", "c").agg(F.count("*").alias("n"), F.min(F.struct("key", "s", "l")).alias("x"))
    groups = put(groups, "groups")
    several = groups.groupBy("r").count().where("count > 1").select("r")
    open_ = put(groups.join(several, "r").select("r", "c", "n", "x.*"), "open")
    asked = open_.groupBy("key").agg(F.collect_list(F.struct("s", "l", "r", "c", "n")).alias("wanted"))
    asked = put(asked, "asked")
    texts = docs.join(hinted(asked.select("key"), asked.count(), 40), "key", "left_semi").select("key", "text").dropDuplicates(["key"])
    starts = put(_starts(texts.join(asked, "key")), "starts")
    twice = starts.groupBy("r", "g").agg(F.sum("n").alias("total")).where("total > 1").select("r", "g")
    single = starts.where("n = 1").join(twice, ["r", "g"], "left_semi").groupBy("r", "c").agg(F.sort_array(F.collect_list("k")).alias("ks"))
    told = groups.select("r", "c", "n").join(single, ["r", "c"], "left").where("n > 1 or ks is not null")
    told = put(told, "told")
    # neighbouring starts as one span: a start opens one if the start before it isn't there
    split = "transform(filter(ks, k -> not array_contains(ks, k - 1)), k -> struct(s + k as s, s + array_min(filter(ks, j -> j >= k and not array_contains(ks, j + 1))) as e))"
    found = some.dropDuplicates(["key", "s"]).join(told, ["r", "c"]).select("key", F.expr(f"case when n > 1 then array(struct(s as s, s + l as e)) else {split} end").alias("spans"))
    out = put(found.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("found")), "found")
    free(some, groups, open_, asked, starts, told)
    return out


def without_repeats(docs: DataFrame, keep: list[str], kept_bytes: bool = True) -> DataFrame:
    """The ``keep`` columns of each row, then __bytes, __removed, __spans, __sha256 and (if asked for) __kept, the remaining bytes.

    A null text counts as empty. Rows that repeat are judged like any others: both copies go. An empty table gives an empty result.
    """
    texts = docs.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)], F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")).withColumn("key", F.unhex(F.md5("text")))
    found = repeated(texts.where(F.octet_length("text") >= LENGTH).select("key", "text"))
    both = texts.join(found, "key", "left")
    names = [f"__k{i}" for i in range(len(keep))]
    schema = "nb bigint, nr bigint, ns bigint, sha string" + ", left binary" * kept_bytes

    def start():
        from hashlib import sha256

        def work(texts, part):
            rows = []
            for text, spans in zip(texts, part.column(len(keep)).to_pylist(), strict=True):
                text = text or b""
                edge = np.zeros(len(text) + 1, np.int32)
                if spans:
                    np.add.at(edge, [x["s"] for x in spans], 1)
                    np.add.at(edge, [x["e"] + LENGTH for x in spans], -1)
                gone = np.cumsum(edge[:-1]) > 0
                left = np.frombuffer(text, np.uint8)[~gone].tobytes() if spans else text
                rows.append((len(text), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + (gone[0] if len(gone) else 0)), sha256(left).hexdigest(), left)[: 4 + kept_bytes])
            return [list(x) for x in zip(*rows, strict=True)]

        return work

    # texts are bytes here and go through as they are
    made = over_texts(both.withColumnRenamed("text", "whole"), [*names, "found"], schema, start, "whole")
    new = ["__bytes", "__removed", "__spans", "__sha256", *["__kept"] * kept_bytes]
    return made.select(*[F.col(a).alias(b) for a, b in zip([*names, "nb", "nr", "ns", "sha", *["left"] * kept_bytes], [*keep, *new], strict=True)])


def substring_removals(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    out = without_repeats(docs, ["doc_id"], kept_bytes=False)
    return out.select("doc_id", F.col("__bytes").alias("n_bytes"), F.col("__removed").alias("n_removed"), F.col("__spans").alias("n_spans"), F.col("__sha256").alias("kept_sha256"))
