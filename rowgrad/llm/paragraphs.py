"""Near-duplicate paragraphs: MinHash bands, exact Jaccard, components.

A paragraph is a line of at least 20 words. Equal ones are one class; the bands of a class are the nodes of ``linking``, which compares
what collides, confirms links on full sets of five-word shingles and joins them to components. Of each component the first paragraph stays (smallest doc_id, then
place); all others are removed.

In what is left, across its lines, a run of PASSAGE words that an earlier place has as well goes too. Such a run has the same smallest fingerprint of RUN words
wherever it stands; runs whose smallest one is shared are compared by 128 bits of all their words.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowgrad.llm.linking import SKETCH, link
from rowgrad.llm.setjoin import hash_functions, shingle_set, split_words
from rowgrad.llm.texts import Remembered, free, hash_word, hinted, mix, over_texts, put

MIN_WORDS, SHINGLE = 20, 5
RECALL, STRAY = 0.999, 0.25
PASSAGE, RUN = 50, 25
BASE = 0x9E3779B97F4A7C15  # of the polynomials over word hashes; odd
HASH_CELLS = 1 << 18  # hash values that a task works out at a time: as many as stay in its cache


def tuned(recall: float = RECALL, stray: float = STRAY, similarity: float = 0.8, background: float = 0.3) -> tuple[int, int]:
    """Bands and rows: the fewest bands that find a pair at the threshold with ``recall`` and one of background similarity at most so often."""
    for rows in range(1, 9):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if 1 - (1 - background**rows) ** bands <= stray:
            return bands, rows
    raise ValueError("no banding meets both rates")


def _word_hashes(texts: pa.Array, hashed: Remembered) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (as of ``split_words``) of all ``texts`` in a row, and how many each text has; a word is looked up once."""
    import pyarrow.compute as pc

    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    words = split.flatten()
    full = pc.greater(pc.binary_length(words), 0)  # white space at either end leaves empty ones
    upto = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    coded = words.filter(full).dictionary_encode()
    known = np.fromiter(map(hashed.__getitem__, coded.dictionary.view(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    return known[coded.indices.to_numpy()], np.diff(upto[split.offsets.to_numpy()])


def _marks(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """For paragraphs of ``sizes`` words each, at least SHINGLE, whose hashes ``h`` has: size of the shingle set, its digest, band values and sketch, a row each.

    All paragraphs of a slice are worked on together; the values are those of ``shingle_set``, ``minhashes`` and ``sketch``.
    """
    from hashlib import md5

    bands, rows = tuned()
    made = np.full(len(h) - SHINGLE + 1, np.uint64(SHINGLE))
    for i in range(SHINGLE):
        made = mix(made, h[i : len(h) - SHINGLE + 1 + i])
    of = np.repeat(np.arange(len(sizes)), sizes)[: len(made)]
    last = np.cumsum(sizes) - SHINGLE
    inside = np.flatnonzero(np.arange(len(made)) <= last[of])
    made, of = made[inside], of[inside]
    lo = 0
    for hi in np.cumsum(sizes - SHINGLE + 1).tolist():
        made[lo:hi].sort()
        lo = hi
    new = np.ones(len(made), bool)
    new[1:] = (made[1:] != made[:-1]) | (of[1:] != of[:-1])
    made, of = made[new], of[new]
    n = np.bincount(of, minlength=len(sizes))
    starts = np.cumsum(n) - n
    whole = made.tobytes()
    keys = [md5(whole[8 * lo : 8 * hi]).digest() for lo, hi in zip(starts.tolist(), (starts + n).tolist(), strict=True)]
    factors, terms = hash_functions()
    x = (made ^ (made >> np.uint64(32))).astype(np.uint32)
    values = np.empty((len(sizes), len(factors)), np.uint32)
    step = max(1, HASH_CELLS // len(x))
    for lo in range(0, len(factors), step):
        v = factors[lo : lo + step] * x
        v += terms[lo : lo + step]
        values[:, lo : lo + step] = np.minimum.reduceat(v, starts, axis=1).T
    grid = values[:, : bands * rows].reshape(len(sizes), bands, rows).astype(np.uint64)
    band = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sizes), bands))
    for k in range(rows):
        band = mix(band, grid[:, :, k])
    bits = ((values * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.uint8)
    return n, keys, band.view(np.int64), np.packbits(bits, axis=1).view(np.int64)


def _signed(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, pos, key, n, bands, s0..s3) for each paragraph of at least MIN_WORDS words."""

    def start():
        import pyarrow.compute as pc

        hashed = Remembered(hash_word)
        shape = pa.struct([("pos", pa.int32()), ("key", pa.binary()), ("n", pa.int64()), ("bands", pa.list_(pa.int64())), *[(s, pa.int64()) for s in SKETCH]])

        def work(texts, part):
            lines = pc.split_pattern(pa.array([t or b"" for t in texts], pa.binary()).view(pa.string()), "\n")
            h, sizes = _word_hashes(lines.flatten().view(pa.binary()), hashed)
            hashed.trim()
            some = sizes >= MIN_WORDS
            upto = lines.offsets.to_numpy()
            ends = np.concatenate([[0], np.cumsum(some)])[upto]
            if not some.any():
                return [pa.array([[]] * len(texts), pa.list_(shape))]
            places = (np.arange(len(sizes)) - np.repeat(upto[:-1], np.diff(upto)))[some]
            n, keys, band, bits = _marks(h[np.repeat(some, sizes)], sizes[some])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * band.shape[1]), pa.array(np.ascontiguousarray(band).reshape(-1)))
            columns = [pa.array(places, pa.int32()), pa.array(keys, pa.binary()), pa.array(n, pa.int64()), lists, *[pa.array(np.ascontiguousarray(bits[:, k])) for k in range(4)]]
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(shape)))]

        return work

    fields = "pos:int, key:binary, n:bigint, bands:array<bigint>, " + ", ".join(f"{s}:bigint" for s in SKETCH)
    return over_texts(docs, ["doc_id", "mark"], f"p array<struct<{fields}>>", start).select("doc_id", "mark", F.explode("p").alias("p")).select("doc_id", "mark", "p.*")


def _full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, set) of the paragraphs at (doc_id, mark, pos), once for each row that has the document."""
    by_doc = wanted.select(F.coalesce("doc_id", F.lit(-1)).alias("__d"), F.col("mark").alias("__m"), "pos").groupBy("__d", "__m").agg(F.collect_set("pos").alias("at"))
    by_doc = put(by_doc, "wanted")
    n, spread = by_doc.agg(F.count("*"), F.coalesce(F.sum(F.size("at")), F.lit(0))).first()
    named = docs.select("text", F.coalesce("doc_id", F.lit(-1)).alias("__d"), F.col("mark").alias("__m"))
    some = named.join(hinted(by_doc, n * 64 + spread * 8, 1), ["__d", "__m"])

    def start():
        from hashlib import md5

        hashed = Remembered(hash_word)

        def work(texts, part):
            out = []
            for text, at in zip(texts, part.column(0).to_pylist(), strict=True):
                lines = (text or b"").split(b"\n")
                sets = [shingle_set(split_words(lines[p]), SHINGLE, hashed) for p in at]
                out.append([{"id": md5(s.tobytes()).digest(), "set": s.view(np.int64).tolist()} for s in sets])
            hashed.trim()
            return [pa.array(out, pa.list_(pa.struct([("id", pa.binary()), ("set", pa.list_(pa.int64()))])))]

        return work

    rows = over_texts(some, ["at"], "p array<struct<id:binary, set:array<bigint>>>", start)
    return rows.select(F.explode("p").alias("p")).select("p.*")


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, removed array<int>, lines): by document, the lines that repeat another paragraph, and how many lines another document has too.

    ``docs`` has doc_id, text, mark (hash of the text).
    """
    signed = put(_signed(docs), "paragraphs")
    fields = F.struct("doc_id", "mark", "pos", "n", "bands", *SKETCH)
    reps = put(signed.groupBy("key").agg(F.min_by(fields, F.struct(F.coalesce("doc_id", F.lit(1 << 62)), "pos", "mark")).alias("r")).select("key", "r.*"), "reps")
    # bands move with 64 bits of the key, once; what belongs to a paragraph joins those few that collide
    short = F.xxhash64("key").alias("short")
    together = reps.select(short, F.explode("bands").alias("node")).withColumn("among", F.count("*").over(Window.partitionBy("node"))).where("among > 1")
    members = put(together.join(reps.select(short, F.col("key").alias("id"), "n", *SKETCH), "short").select("node", "id", "n", *SKETCH), "members")

    def sets_of(ids: DataFrame) -> DataFrame:
        return _full_sets(docs, reps.join(ids, reps.key == ids.id).select("doc_id", "mark", "pos"))

    labels = put(link(members, sets_of), "labels")
    told = signed.select("doc_id", "mark", "pos", "key").join(labels.withColumnRenamed("id", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    told = put(told.select("doc_id", "mark", "pos", "label"), "told")
    place = F.struct(F.coalesce("doc_id", F.lit(1 << 62)).alias("d"), "pos", "mark")
    document = F.struct(F.coalesce("doc_id", F.lit(1 << 62)).alias("d"), "mark")
    first = told.groupBy("label").agg(F.min(place).alias("first"), F.count("*").alias("size"), (F.min(document) != F.max(document)).alias("wide")).where("size > 1")
    gone = told.join(first, "label").groupBy("doc_id", "mark").agg(
        F.sort_array(F.collect_set(F.when(place != F.col("first"), F.col("pos")))).alias("removed"), F.count_distinct(F.when(F.col("wide"), F.col("pos"))).alias("lines")
    )
    out = put(gone, "removed")
    free(signed, reps, members, labels, told)
    return out


_known_powers: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """At least ``n`` powers of an odd number and of its inverse, modulo 2 ** 64; a task keeps them."""
    if not _known_powers or len(_known_powers[0]) < n:
        with np.errstate(over="ignore"):
            _known_powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, np.uint64(x))])) for x in (BASE, pow(BASE, -1, 1 << 64))]
    return _known_powers


def _runs(h: np.ndarray) -> np.ndarray:
    """Fingerprints of the RUN words from each start: differences of running polynomials, shifted to one place and mixed."""
    up, down = _powers(1 << (len(h) + 1).bit_length())
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(h * up[: len(h)])])
        found = (sums[RUN:] - sums[:-RUN]) * down[: len(h) - RUN + 1]
    return mix(found, found >> np.uint64(32))


def _smallest(runs: np.ndarray) -> np.ndarray:
    """Where the smallest run (the first of equal ones) of each PASSAGE words begins: by windows of doubling width."""
    wide, reach, at = PASSAGE - RUN + 1, 1, np.arange(len(runs))
    while 2 * reach <= wide:
        a, b = at[:-reach], at[reach:]
        at, reach = np.where(runs[b] < runs[a], b, a), 2 * reach
    a, b = at[: len(runs) - wide + 1], at[wide - reach :]
    return np.where(runs[b] < runs[a], b, a)


def _passages(docs: DataFrame) -> DataFrame:
    """(d, m, spans array<struct<s,e>>, runs): by document, what lies under PASSAGE words that an earlier place has too, in code points (end exclusive)
    of text; and how many runs of PASSAGE words another document has as well, first places included.

    ``docs`` has d, m (which tell documents apart) and text; of equal rows one counts.
    """

    def hashes(texts, hashed):
        h, sizes = _word_hashes(pa.array([t or b"" for t in texts], pa.binary()), hashed)
        hashed.trim()
        return np.split(h, np.cumsum(sizes)[:-1])

    def anchors():
        hashed = Remembered(hash_word)

        def work(texts, part):
            out = []
            for h in hashes(texts, hashed):
                if len(h) < PASSAGE:
                    out.append(None)
                    continue
                runs = _runs(h)
                at = _smallest(runs)  # ascending
                out.append(runs[at[np.append(True, at[1:] != at[:-1])]].view(np.int64))
            return [pa.array(out, pa.list_(pa.int64()))]

        return work

    def windows():
        hashed = Remembered(hash_word)

        def work(texts, part):
            out, ends = [], [0]
            for h, at in zip(hashes(texts, hashed), part.column(2).to_pylist(), strict=True):
                runs = _runs(h)
                found = np.flatnonzero(np.isin(runs[_smallest(runs)], np.array(at, np.int64).view(np.uint64)))
                other = _runs(mix(h, h ^ np.uint64(PASSAGE)))
                out.append([*(mix(r[found], r[found + RUN]).view(np.int64) for r in (runs, other)), found.astype(np.int32)])
                ends.append(ends[-1] + len(found))
            columns = [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)]
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names=["a", "b", "p"]))]

        return work

    def places():
        import re

        def work(texts, part):
            out = []
            for text, lo, hi in zip(texts, part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                ends = np.array([m.span() for m in re.finditer(rb"[^ \t-\r]+", text)])
                points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
                hi = np.array(hi) + PASSAGE - 1
                out.append([{"s": s, "e": e} for s, e in zip(points[ends[lo, 0]].tolist(), points[ends[hi, 1]].tolist(), strict=True)])
            return [pa.array(out, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))]

        return work

    mins = put(over_texts(docs, ["d", "m"], "r array<bigint>", anchors).where("r is not null").dropDuplicates(["d", "m"]), "anchors")
    each = mins.select("d", "m", F.explode("r").alias("r"))
    shared = put(each.groupBy("r").count().where("count > 1").select("r"), "shared")
    asked = put(each.join(shared, "r").groupBy("d", "m").agg(F.collect_set("r").alias("at")), "asked")
    n, spread = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("at")), F.lit(0))).first()
    some = docs.join(hinted(asked, n * 64 + spread * 8, 1), ["d", "m"])
    found = put(over_texts(some, ["d", "m", "at"], "w array<struct<a:bigint, b:bigint, p:int>>", windows).select("d", "m", F.explode("w").alias("w")).select("d", "m", "w.*"), "windows")
    place = F.struct(F.when(F.col("d") == -1, F.lit(1 << 62)).otherwise(F.col("d")).alias("d"), "m", "p")
    document = F.struct("d", "m")
    first = found.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last"), (F.min(document) != F.max(document)).alias("wide")).where("first <> last")
    first = put(first.select("a", "b", "first", "wide"), "first")
    again = found.join(first, ["a", "b"]).groupBy("d", "m")
    again = put(again.agg(F.collect_set(F.when(place != F.col("first"), F.col("p"))).alias("at"), F.count_if("wide").alias("runs")), "again")
    # of neighbouring places the first and the last
    later = again.where("size(at) > 0").select("d", "m", F.sort_array("at").alias("at"))
    later = later.selectExpr("d", "m", f"filter(at, (x, i) -> i = 0 or x - at[i - 1] > {PASSAGE}) as lo", f"filter(at, (x, i) -> i = size(at) - 1 or at[i + 1] - x > {PASSAGE}) as hi")
    n, spread = later.agg(F.count("*"), F.coalesce(F.sum(F.size("lo")), F.lit(0))).first()
    some = docs.join(hinted(later, n * 80 + spread * 16, 1), ["d", "m"])
    spans = over_texts(some, ["d", "m", "lo", "hi"], "spans array<struct<s:int, e:int>>", places).select("d", "m", "spans").dropDuplicates(["d", "m"])
    out = put(again.select("d", "m", "runs").join(spans, ["d", "m"], "left"), "passages")
    free(mins, shared, asked, found, first, again)
    return out


def without_duplicates(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of each row, then __paragraphs, __removed (line numbers from 0), __passages (spans of the lines that stay), __shared (lines
    and runs of PASSAGE words that another document has as well, where they come first too) and __kept, the text without what goes.

    Null texts count as empty. Rows that share doc_id and text are one document listed several times and get equal answers; a row without doc_id comes last.
    A text all of whose lines go becomes empty. An empty table gives an empty result.
    """
    docs = docs.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)], F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    gone = removals(docs.select("doc_id", "text", "mark"))
    n, spread = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("removed")), F.lit(0))).first()
    gone = gone.select(F.coalesce("doc_id", F.lit(-1)).alias("__d"), F.col("mark").alias("__m"), "removed", "lines")
    both = docs.withColumn("__d", F.coalesce("doc_id", F.lit(-1))).withColumnRenamed("mark", "__m").join(hinted(gone, n * 64 + spread * 8, 1), ["__d", "__m"], "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    kept = F.expr("case when removed is null or size(removed) = 0 then text else array_join(filter(split(text, r'\\n', -1), (x, i) -> not array_contains(removed, i)), '\\n') end")
    both = both.withColumn("__removed", removed).withColumn("__kept", kept)
    cut = _passages(both.select(F.col("__d").alias("d"), F.col("__m").alias("m"), F.col("__kept").alias("text")))
    n, spread = cut.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("spans").isNotNull(), F.size("spans"))), F.lit(0))).first()
    cut = cut.select(F.col("d").alias("__d"), F.col("m").alias("__m"), "spans", "runs")
    both = both.join(hinted(cut, n * 64 + spread * 16, 1), ["__d", "__m"], "left")
    # the pieces between the spans, joined once
    begin = "if(i = 0, 0, spans[i - 1].e)"
    piece = f"substr(__kept, {begin} + 1, if(i = size(spans), length(__kept), spans[i].s) - {begin})"
    left = F.expr(f"case when spans is null then __kept else array_join(transform(sequence(0, size(spans)), i -> {piece}), '') end")
    spans = F.coalesce("spans", F.array().cast("array<struct<s:int, e:int>>"))
    return both.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n", -1))).cast("bigint").alias("__paragraphs"), "__removed", spans.alias("__passages"), (F.coalesce("lines", F.lit(0)) + F.coalesce("runs", F.lit(0))).alias("__shared"), left.alias("__kept"))


def paragraph_removals(docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs (lines), n_removed, removed, kept_sha256, passages (spans of code points, removed from the lines that stay), n_shared
    (lines and runs of 50 words that another document has as well, whichever comes first)."""
    out = without_duplicates(docs, ["doc_id"])
    return out.select("doc_id", F.col("__paragraphs").alias("n_paragraphs"), F.size("__removed").cast("bigint").alias("n_removed"), F.col("__removed").alias("removed"), F.sha2(F.col("__kept").cast("binary"), 256).alias("kept_sha256"), F.col("__passages").alias("passages"), F.col("__shared").alias("n_shared"))
