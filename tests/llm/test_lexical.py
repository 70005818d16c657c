"""Lexical search against scores of all documents, and bounds that hold."""

import math
import random
import re
from collections import Counter

import numpy as np

from rowgrad.llm import lexical
from rowgrad.llm.texts import hash_word

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return PATTERN.findall(lowered)


def plain(docs, items, top=20):
    bags = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item_id, text in set(items):
        scores = []
        for doc_id, bag in bags:
            m = 75 + (25 * sum(bag.values()) * n_docs) // n_terms
            score = 0
            for t in terms(text):
                if bag[t]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 12 * m))
            if score > 0:
                scores.append((-score, doc_id is not None, doc_id or 0, doc_id))
        out += [(item_id, rank, r[3], -r[0]) for rank, r in enumerate(sorted(scores)[:top], 1)]
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


def check(spark, docs, items, clash=()):
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    for name in clash:
        d, i = d.selectExpr("*", f"1 as `{name}`"), i.selectExpr("*", f"2 as `{name}`")
    got = [tuple(r) for r in lexical.search(d.repartition(3), i).collect()]
    assert ordered(got) == ordered(plain(docs, items))


def drawn(seed, n, vocabulary):
    rng = random.Random(seed)
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    return [" ".join(rng.choices(vocabulary, weights, k=min(4000, int(rng.paretovariate(0.9) * 8)))) for _ in range(n)]


def test_ranking_with_ties_nulls_and_repeats(spark):
    vocabulary = [f"Wort{i}" for i in range(400)] + ["é", "Ünï", "x9", "9", "ñandú"]
    texts = drawn(1, 500, vocabulary)
    docs = [(i, t) for i, t in enumerate(texts)]
    docs += [(1000 + i, texts[3]) for i in range(60)] + [(5, "other wort7 text"), (5, texts[9]), (5, texts[9])]
    docs += [(2000, None), (2001, ""), (2002, " .,-\n"), (None, texts[11]), (None, texts[11]), (2003, "rare\x00WORT3|wort3`wort3"), (2004, "wort5 " * 150_000)]
    items = [(i, t) for i, t in enumerate(drawn(2, 40, vocabulary))]
    items += [(3, "a second text wort5 wort5"), (3, "a second text wort5 wort5"), (100, None), (101, ""), (102, "!"), (103, "nowhere"), (104, "rare"), (None, "wort1 É é"), (105, texts[3])]
    check(spark, docs, items, ["item", "rank", "score", "docs", "wanted_id", "items", "at", "bound", "p"])


def test_empty_tables(spark):
    check(spark, [], [(1, "a")])
    check(spark, [(1, "a b")], [])
    check(spark, [(1, None), (2, "")], [(1, "a")])


def test_items_come_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ITEM_BYTES", 200)
    vocabulary = [f"w{i}" for i in range(60)]
    check(spark, list(enumerate(drawn(3, 120, vocabulary))), list(enumerate(drawn(4, 12, vocabulary))))


def test_bounds_are_never_too_low(spark):
    vocabulary = [f"w{i}" for i in range(300)]
    texts = drawn(5, 300, vocabulary)
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    items = [t.encode() for t in drawn(6, 15, vocabulary)]
    asked = lexical.Asked.of(items)
    held = lexical.frequencies(docs, asked)
    df = Counter(t for text in texts for t in set(terms(text)))
    assert held.tolist() == [df[t.decode()] for t in asked.terms]
    n_terms = sum(len(terms(t)) for t in texts)
    weights = np.array([math.floor(1000 * math.log((2 * len(texts) + 2) / (2 * n + 1))) for n in held])
    weighted = lexical.Weighted(asked, weights, len(texts), n_terms)
    exact = {(i, d): s for i, _, d, s in plain(list(enumerate(texts)), list(enumerate(t.decode() for t in items)), 10**6)}
    keys = np.fromiter(map(hash_word, asked.terms), np.uint64)
    seen, total, bound = 0, 0, 0.0
    for b in lexical.index(docs).collect():
        block = {"docs": b.docs, "lengths": b.lengths, "n_slices": b.n_slices, "slices": bytes(b.slices)}
        for lo, upper in lexical.bounds(block, weighted, keys):
            for i in range(len(items)):
                for k in range(upper.shape[1]):
                    score = exact.get((i, b.docs[lo + k]), 0)
                    assert upper[i, k] >= score
                    seen += 1
                    total, bound = total + score, bound + upper[i, k]
    assert seen == len(items) * len(texts)
    # bounds are of use: counts are rounded up by half at most, and few terms are seen where they aren't
    assert bound < 1.5 * total
