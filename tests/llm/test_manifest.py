"""The Merkle manifest against a plain Python version."""

import random
import zlib
from hashlib import sha256

import pytest

from rowgrad.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def fold(nodes):
    """The root of some digests, and for each of them its siblings, level by level, as (left, right)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for i, k in enumerate(at):
            run, place = runs[k // 8], k % 8
            paths[i].append(("".join(run[:place]), "".join(run[place + 1 :])))
        nodes, at = [h(*run) for run in runs], [k // 8 for k in at]
    return nodes[0], paths


def plain(rows):
    by_lang = {}
    for doc_id, text, lang, source, n_chars in rows:
        leaf = leaf_of(doc_id, text, lang, source, n_chars)
        cut = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 and text is not None
        shown = leaf_of(doc_id, lower(text), lang, source, n_chars) if cut else leaf
        by_lang.setdefault(lang, []).append((doc_id is not None, doc_id or 0, leaf, shown, doc_id))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = [fold([r[2] for r in sorted(by_lang[x])]) for x in langs]
    root, tops = fold([t[0] for t in trees])
    out = []
    for lang, (sub, paths), top in zip(langs, trees, tops):
        for (_, _, leaf, shown, doc_id), path in zip(sorted(by_lang[lang]), paths):
            path, cur = path + top, shown
            for left, right in path:
                cur = h(left, cur, right)
            out.append((doc_id, leaf, sub, root, h(*[a + b for a, b in path]), cur, cur == root))
    return out


def check(spark, rows, extra=()):
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in extra:
        docs = docs.withColumn(name, manifest.F.lit("x"))
    key = lambda r: tuple((v is not None, v if v is not None else 0) for v in r)
    got = sorted((tuple(r) for r in manifest.manifest(docs).collect()), key=key)
    assert got == sorted(plain(rows), key=key)
    return got


def test_nulls_repeats_and_clashing_names(spark):
    rows = [(i, f"Text {i}, Ünïcode É", "en", "s", i) for i in range(75)]
    rows += [(i, "Kurz", "de", None, None) for i in range(100, 109)] + [(200, "Seul", "fr", "s", 1)]
    rows += [(300, None, None, None, None), (None, "No Id", "en", "s", 1), (None, "No Id", "en", "s", 1), (None, None, "en", None, None)]
    rows += [(7, "Other Text", "en", "s", 3), (8, "Text 8, Ünïcode É", "en", "s", 8), (301, "", "Ωmega", "", 0)]
    rows += [(400 + i, "L" * i, f"lang{i}", "s", i) for i in range(9)]
    random.Random(1).shuffle(rows)
    got = check(spark, rows, ["tree", "lo", "hi", "kids", "digest", "shown", "bucket", "up", "at", "size", "pos", "_m", "_range"])
    assert not all(r[-1] for r in got) and any(r[-1] for r in got)


@pytest.mark.parametrize("n", [1, 8, 9])
def test_one_tree(spark, n):
    check(spark, [(i, "A b" * i, "en", "s", i) for i in range(n)])


def test_empty_table(spark):
    assert manifest.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_text_and_a_tree_of_four_levels(spark):
    rows = [(i, "Wort " * (i % 3), "en", "s", i) for i in range(600)] + [(1000, "Long Text " * 200_000, "en", "s", 5)]
    check(spark, rows)
