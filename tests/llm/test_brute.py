"""Near-duplicate documents and paragraphs of a whole small table against all pairs in plain Python."""

import hashlib
import re
from collections import defaultdict
from itertools import combinations

from rowgrad.llm import paragraphs, setjoin


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def shingles(ws, size):
    return {tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))} if ws else set()


def components(sets):
    """The smallest key that each key reaches over pairs of similarity 0.8 or more."""
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for (a, x), (b, y) in combinations(sets.items(), 2):
        if x and y and min(len(x), len(y)) * 100 >= 80 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    return {k: find(k) for k in sets}


def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")


def test_near_duplicates_are_those_of_all_pairs(spark, folder):
    docs = documents(spark, folder)
    sets = {r.doc_id: shingles(words(r.text), 2) for r in docs.collect()}
    want = components(sets)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in setjoin.near_duplicates(docs).collect()}
    assert got == {k: (len(s), want[k], want[k] == k) for k, s in sets.items()}
    assert any(k != v for k, v in want.items())


def test_paragraphs_are_those_of_all_pairs(spark, folder):
    docs = documents(spark, folder)
    lines = {r.doc_id: (r.text or "").split("\n") for r in docs.collect()}
    sets = {(d, p): shingles(words(line), 5) for d, ls in lines.items() for p, line in enumerate(ls) if len(words(line)) >= 20}
    label = components(sets)
    owners = defaultdict(set)
    for (d, _), first in label.items():
        owners[first].add(d)
    removed, shared = defaultdict(list), defaultdict(int)
    for (d, p), first in sorted(label.items()):
        if first != (d, p):
            removed[d].append(p)
        shared[d] += len(owners[first]) > 1
    left = {d: "\n".join(line for p, line in enumerate(ls) if p not in removed[d]) for d, ls in lines.items()}
    seen, has, spans = {}, defaultdict(set), defaultdict(list)
    for d in sorted(left):
        found = list(re.finditer(r"[^\x20\x09-\x0D]+", left[d]))
        lowered = words(left[d])
        for i in range(len(found) - 49):
            run = tuple(lowered[i : i + 50])
            has[run].add(d)
            if seen.setdefault(run, (d, i)) != (d, i):
                s, e = found[i].start(), found[i + 49].end()
                if spans[d] and spans[d][-1][1] >= s:
                    spans[d][-1][1] = e
                else:
                    spans[d].append([s, e])
    for d in left:
        lowered = words(left[d])
        shared[d] += sum(len(has[tuple(lowered[i : i + 50])]) > 1 for i in range(len(lowered) - 49))
    got = {r.doc_id: r for r in paragraphs.paragraph_removals(docs).collect()}
    assert sorted(got) == sorted(lines)
    for d, r in got.items():
        assert r.removed == removed[d] and r.n_removed == len(removed[d]), d
        assert [[x.s, x.e] for x in r.passages] == spans[d], d
        assert r.n_shared == shared[d], d
        kept, at = "", 0
        for s, e in spans[d]:
            kept, at = kept + left[d][at:s], e
        assert r.kept_sha256 == hashlib.sha256((kept + left[d][at:]).encode()).hexdigest()
    assert any(removed.values()) and any(spans.values())
