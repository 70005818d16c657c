"""Benchmark decontamination by multi-pattern search over words, after Wu and Manber.

Patterns are windows of 13 benchmark words (a shorter item is one window). A shift table over blocks of two words says how far a cursor may
jump because no pattern has that block there; where it may not jump, the block's hash bucket names the patterns that end so,
and comparing the words decides. Numpy moves one cursor in each stretch of 1,024 words, all at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowgrad.llm.texts import over_texts

WINDOW = 13
# Benchmark text is taken in blocks of about so many characters, one pass each, so that a task's tables stay small.
BLOCK_CHARS = 16 << 20
STRETCH, TABLE_BITS = 1024, 17

_LETTERS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def contract_words(text: bytes | None) -> list[bytes]:
    """Runs of digits, letters (A-Z lower-cased) and characters beyond ASCII."""
    return (text or b"").translate(_LETTERS).split()


def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.uint32) * np.uint32(0x9E3779B1) ^ b.astype(np.uint32) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - TABLE_BITS)


class Tables:
    """Shift table and suffix buckets for patterns (rows of word numbers) of one length."""

    def __init__(self, patterns: np.ndarray):
        self.patterns, self.length = patterns, patterns.shape[1]
        self.block = min(2, self.length)
        self.shift = np.full(1 << TABLE_BITS, self.length - self.block + 1, np.uint8)
        for end in range(self.block, self.length + 1):
            np.minimum.at(self.shift, _slot(patterns[:, end - self.block], patterns[:, end - 1]), self.length - end)
        last = _slot(patterns[:, -self.block], patterns[:, -1])
        self.order = np.argsort(last, kind="stable")
        self.first = np.concatenate([[0], np.cumsum(np.bincount(last, minlength=1 << TABLE_BITS))])

    def find(self, words: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of last words and pattern numbers of all occurrences inside the texts [begin, end)."""
        lo = begins + self.length - 1
        pieces = np.maximum(0, -(-(ends - lo) // STRETCH))
        at = np.repeat(lo, pieces) + STRETCH * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        stop = np.minimum(at + STRETCH, np.repeat(ends, pieces))
        stand = []
        while len(at):
            step = self.shift[_slot(words[at - self.block + 1], words[at])]
            stand.append(at[step == 0])
            at = at + np.maximum(step, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        places = np.concatenate([np.zeros(0, np.int64), *stand])
        slot = _slot(words[places - self.block + 1], words[places])
        size = self.first[slot + 1] - self.first[slot]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        upto = np.cumsum(size)
        cut = 0
        while cut < len(places):
            more = max(cut + 1, int(np.searchsorted(upto, (upto[cut - 1] if cut else 0) + 500_000)))
            p, s, n = places[cut:more], slot[cut:more], size[cut:more]
            which = self.order[np.repeat(self.first[s], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            p = np.repeat(p, n)
            for k in range(self.length):
                same = words[p - self.length + 1 + k] == self.patterns[which, k]
                p, which = p[same], which[same]
            found.append((p, which))
            cut = more
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def prepared(items: list[tuple[str | None, bytes | None]]) -> tuple[dict, list, list]:
    """Word numbers (from 1), (patterns, items of each pattern) by window length, and the names of the items."""
    numbers: dict[bytes, int] = {}
    windows: dict[int, dict[tuple, set]] = {}
    names = []
    for name, text in items:
        ids = [numbers.setdefault(w, len(numbers) + 1) for w in contract_words(text)]
        if ids:
            names.append(name)
            k = min(WINDOW, len(ids))
            for i in range(len(ids) - k + 1):
                windows.setdefault(k, {}).setdefault(tuple(ids[i : i + k]), set()).add(len(names) - 1)
    return numbers, [(np.array(list(w), np.int64), [sorted(x) for x in w.values()]) for _, w in sorted(windows.items())], names


def _pass(docs: DataFrame, keep: list[str], text: str, shared) -> DataFrame:
    """Adds what one block of items finds to the columns __hits (word intervals) and __items of each row."""

    def start():
        numbers, windows, names = shared.value
        tables = [(Tables(p), owners) for p, owners in windows]

        def work(texts, part):
            lists = [contract_words(t) for t in texts]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            ends = np.cumsum(sizes)
            words = np.fromiter((numbers.get(w, 0) for ws in lists for w in ws), np.int64, int(sizes.sum()))
            edge = np.zeros(len(words) + 1, np.int64)
            items = [set() for _ in lists]
            for table, owners in tables:
                at, which = table.find(words, ends - sizes, ends)
                np.add.at(edge, at - table.length + 1, 1)
                np.add.at(edge, at + 1, -1)
                doc = np.searchsorted(ends, at, side="right")
                for d, w in np.unique(np.stack([doc, which]), axis=1).T.tolist():
                    items[d].update(owners[w])
            hit = np.cumsum(edge[:-1]) > 0
            before = np.concatenate([[0], np.cumsum(hit)])
            hits, found = [], []
            old_hits, old_items = (part.column(len(keep) - 2).to_pylist(), part.column(len(keep) - 1).to_pylist())
            for d, (e, n) in enumerate(zip(ends.tolist(), sizes.tolist(), strict=True)):
                now = old_hits[d]
                if before[e] > before[e - n]:
                    own = np.zeros(n + 2, np.int8)
                    own[1:-1] = hit[e - n : e]
                    for s, t in zip(now[::2], now[1::2], strict=True):
                        own[s + 1 : t + 1] = 1
                    now = np.flatnonzero(np.diff(own)).tolist()
                hits.append(now)
                found.append(sorted({*old_items[d], *(names[i] for i in items[d] if names[i] is not None)}))
            return [sizes.tolist(), pa.array(hits, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))]

        return work

    made = over_texts(docs, keep, "__n bigint, __h array<int>, __i array<string>", start, text)
    return made.select(*keep[:-2], F.col("__n"), F.col("__h").alias("__hits"), F.col("__i").alias("__items"))


def overlaps(docs: DataFrame, items: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns of each row, then __words, __hits and __items.

    __words counts words, __hits lists begins and ends (exclusive) of runs of hit words, __items names the items (item_id as text) found, sorted.
    Null and empty texts have no words. Items without words are skipped; an item without item_id hits words but isn't named. Repeated
    items count once, repeated rows get equal answers. Without items nothing is hit.
    """
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text"))
    chars = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = 1 + chars // BLOCK_CHARS
    out = docs.select(*docs.columns, F.lit(0).cast("bigint").alias("__n"), F.array().cast("array<int>").alias("__hits"), F.array().cast("array<string>").alias("__items"))
    carried = list(dict.fromkeys([*keep, text]))
    for b in range(n_blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b).collect()
        shared = spark.sparkContext.broadcast(prepared([(r.item_id, None if r.text is None else bytes(r.text)) for r in block]))
        out = _pass(out.drop("__n"), [*(carried if b < n_blocks - 1 else keep), "__hits", "__items"], text, shared)
    return out.withColumnRenamed("__n", "__words")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and hits: the runs of hit words."""
    found = overlaps(docs.select("doc_id", "text"), items, ["doc_id"])
    n_hit = "aggregate(__hits, 0L, (s, x) -> x - s)"
    # ends minus begins: begins and ends alternate, so that folding x - s over them leaves the sum
    return found.select(
        "doc_id",
        F.col("__words").alias("n_words"),
        F.expr(n_hit).alias("n_hit"),
        F.size("__items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("__items", ",").cast("binary"), 256).alias("items_sha256"),
        F.expr(f"{n_hit} > 0 and 20 * {n_hit} >= __words").alias("contaminated"),
        F.col("__hits").alias("hits"),
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that aren't contaminated; rows with null texts stay."""
    found = overlaps(docs, items, docs.columns)
    n_hit = "aggregate(__hits, 0L, (s, x) -> x - s)"
    return found.where(f"not ({n_hit} > 0 and 20 * {n_hit} >= __words)").select(*docs.columns)


ORACLE = r"""
with w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws from documents),
i as (select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws from benchmark),
p as (select distinct item_id, least(13, len(ws)) as k, list_slice(ws, s, s + least(13, len(ws)) - 1) as win
      from (select item_id, ws, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) as s from i where len(ws) > 0)),
g as (select doc_id, k, s, list_slice(ws, s, s + k - 1) as win from (select doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) as s from w, (select distinct k from p) where len(ws) >= k)),
m as (select g.doc_id, g.s, g.k, p.item_id from g join p on g.k = p.k and g.win = p.win),
h as (select doc_id, count(distinct word) as n_hit from (select doc_id, unnest(range(s, s + k)) as word from (select distinct doc_id, s, k from m)) group by doc_id),
n as (select doc_id, count(*) as n_items, sha256(string_agg(item_id, ',' order by item_id)) as items_sha256 from (select distinct doc_id, cast(item_id as varchar) as item_id from m) group by doc_id)
select w.doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(items_sha256, sha256('')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from w left join h using (doc_id) left join n using (doc_id)
"""
