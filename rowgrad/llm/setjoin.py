"""Near-duplicate documents by a chosen-path set similarity join.

Documents with equal shingle sets are one class; classes are branched in independent trees: a node sends each set to the child named by
its smallest element under a hash function of its tree and level, until a node is small or the tree ends. Similar sets
stay together with probability similarity^depth, and so many trees are grown that a pair at the threshold is missed with
probability ``1 - recall`` even at full depth; no two levels share a hash function, so trees miss independently. Small nodes are compared exhaustively and dense ones by component (``linking``);
every link is confirmed on full shingle sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowgrad.llm.linking import SKETCH, link
from rowgrad.llm.texts import Remembered, free, hash_word, hinted, mix, over_texts, put

HASHES = 256
SMALL_NODE, DEPTH, RECALL = 12, 5, 0.9999


def shingle_set(words: list[bytes], size: int, hashed: Remembered) -> np.ndarray:
    """Sorted distinct 64-bit hashes of runs of ``size`` words; shorter texts are one run, empty ones have none."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashed.__getitem__, words), np.uint64, len(words))
    k = min(size, len(words))
    out = np.full(len(h) - k + 1, np.uint64(k))
    for i in range(k):
        out = mix(out, h[i : len(h) - k + 1 + i])
    return np.unique(out)


_known_functions: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def hash_functions(seed: int = 7, count: int = HASHES) -> tuple[np.ndarray, np.ndarray]:
    """Factors and terms of ``count`` hash functions, a row each; a task keeps them."""
    if (seed, count) not in _known_functions:
        draw = np.random.default_rng(seed)
        a = (draw.integers(0, 1 << 32, count, dtype=np.uint32) | np.uint32(1))[:, None]
        _known_functions[seed, count] = a, draw.integers(0, 1 << 32, count, dtype=np.uint32)[:, None]
    return _known_functions[seed, count]


def minhashes(found: np.ndarray, seed: int = 7, count: int = HASHES) -> np.ndarray:
    """``count`` smallest values of a set under as many hash functions, 32 bits each."""
    a, b = hash_functions(seed, count)
    x = (found ^ (found >> np.uint64(32))).astype(np.uint32)
    best = np.full(count, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 1024):
        v = a * x[lo : lo + 1024]
        v += b
        np.minimum(best, v.min(axis=1), out=best)
    return best


def sketch(values: np.ndarray) -> np.ndarray:
    """One bit of each of 256 smallest values, as four 64-bit numbers."""
    bits = ((values * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


def split_words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) words between spaces and the characters 9 to 13."""
    return (text or b"").lower().split()


def signatures(docs: DataFrame, keep: list[str], size: int, n_path: int) -> DataFrame:
    """``keep`` and each document's set: n, key (128 bits of the whole set; null if empty), ``n_path`` path values and sketch."""

    def start():
        from hashlib import md5

        hashed = Remembered(hash_word)

        def work(texts, part):
            ns, keys, paths, bits = [], [], [], []
            for text in texts:
                found = shingle_set(split_words(text), size, hashed)
                ns.append(len(found))
                if len(found):
                    values = minhashes(found, count=max(HASHES, n_path))
                    keys.append(md5(found.tobytes()).digest())
                    paths.append(values[:n_path].view(np.int32))
                    bits.append(sketch(values[:HASHES]).tolist())
                else:
                    keys.append(None)
                    paths.append(np.zeros(0, np.int32))
                    bits.append([0] * 4)
                hashed.trim()
            return [ns, keys, pa.array(paths, pa.list_(pa.int32())), *map(list, zip(*bits, strict=True))]

        return work

    return over_texts(docs, keep, "n bigint, key binary, path array<int>, s0 bigint, s1 bigint, s2 bigint, s3 bigint", start)


def full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(id, set): the shingle sets of the documents named in ``wanted`` (doc_id, mark: hash of the text), once for each row that has the document."""
    wanted = put(wanted.select(F.coalesce("doc_id", F.lit(-1)).alias("__d"), F.col("mark").alias("__m")).distinct(), "wanted")
    named = docs.select("text", F.coalesce(F.col("doc_id"), F.lit(-1)).alias("__d"), F.xxhash64("text").alias("__m"))
    some = named.join(hinted(wanted, wanted.count(), 48), ["__d", "__m"], "left_semi")

    def start():
        from hashlib import md5

        hashed = Remembered(hash_word)

        def work(texts, part):
            found = [shingle_set(split_words(t), size, hashed) for t in texts]
            hashed.trim()
            return [[md5(f.tobytes()).digest() for f in found], pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))]

        return work

    return over_texts(some, ["__d"], "id binary, set array<bigint>", start).select("id", "set")


def trees(recall: float = RECALL, depth: int = DEPTH, similarity: float = 0.8) -> int:
    """How many trees find a pair at the threshold with probability ``recall`` when all branch down to ``depth``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**depth))


def leaves(reps: DataFrame, n_trees: int, depth: int, small: int) -> DataFrame:
    """Members (node, id, n, s0..s3) of the nodes where branching ended, without nodes of one member.

    ``path`` of ``reps`` has a value for each level of each tree, of which a tree's rows carry their own.
    """
    level = reps.selectExpr("key as id", "n", *SKETCH, f"explode(transform(sequence(1, {n_trees}), t -> named_struct('node', xxhash64(t), 'path', slice(path, (t - 1) * {depth} + 1, {depth})))) as t").select("id", "n", *SKETCH, "t.*")
    ended = []
    for d in range(1, depth + 1):
        level = level.withColumn("node", F.expr(f"xxhash64(node, path[{d - 1}])"))
        counts = put(level.groupBy("node").count().where("count > 1"), "nodes")
        large = counts.where(F.col("count") > small) if d < depth else counts.where("false")
        done = counts.where(F.col("count") <= small) if d < depth else counts
        n_large = large.count()
        stop = level.select("node", "id", "n", *SKETCH).join(hinted(large.select("node"), n_large, 16), "node", "left_anti")
        ended.append(stop.join(done.select("node"), "node", "left_semi"))
        if not n_large:
            break
        level = level.join(hinted(large.select("node"), n_large, 16), "node", "left_semi")
    out = ended[0]
    for more in ended[1:]:
        out = out.unionByName(more)
    return out


def near_duplicates(docs: DataFrame, size: int = 2, depth: int = DEPTH, small: int = SMALL_NODE, recall: float = RECALL) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs`` (doc_id, text; other columns are not read).

    Documents are linked at a Jaccard similarity of 0.8 or more of their sets of ``size``-word shingles. Null and empty texts have
    no shingles, are linked with nothing and are kept. Rows that repeat a doc_id are one document listed several times: they
    get the same answer if their texts agree, else each its own. A row without doc_id takes part in linking, but can't name a component: it is kept
    only if nothing it is linked with has a doc_id. An empty table gives an empty result.
    """
    marked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = signatures(marked.withColumn("mark", F.xxhash64("text")), ["doc_id", "mark"], size, trees(recall, depth) * depth)
    signed = put(signed, "signatures")
    fields = F.struct("doc_id", "mark", "n", "path", *SKETCH)
    reps = signed.where("key is not null").groupBy("key").agg(F.min_by(fields, F.struct(F.coalesce("doc_id", F.lit(1 << 62)), "mark")).alias("r"), F.min("doc_id").alias("lowest")).select("key", "r.*", "lowest")
    reps = put(reps, "reps")
    members = put(leaves(reps, trees(recall, depth), depth, small), "leaves")

    def sets_of(ids: DataFrame) -> DataFrame:
        return full_sets(marked, reps.join(ids, reps.key == ids.id).select("doc_id", "mark"), size)

    labels = link(members, sets_of)
    classes = reps.select("key", "lowest").join(labels.withColumnRenamed("id", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    classes = put(classes, "classes")
    free(members)
    lowest = classes.groupBy("label").agg(F.min("lowest").alias("component_id"))
    named = classes.join(lowest, "label").select("key", "component_id")
    out = signed.select("doc_id", "n", "key").join(named, "key", "left")
    own = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("doc_id").isNull() & F.col("component_id").isNull()))
