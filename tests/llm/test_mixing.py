"""Mixing against a plain version of the budgets, and the knapsack against all subsets."""

import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from rowgrad.llm import mixing

SCHEMA = "doc_id long, source string, text string"


def plain_targets(totals, weights=(5, 2, 1)):
    """Shares by weight, capped at twice the source, the excess shared again until none is above."""
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, capped = 1.5 * sum(totals.values()), {}
    while True:
        open_ = [s for s in order if s not in capped]
        rest, over = budget - sum(capped.values()), sum(weight[s] for s in open_)
        share = {s: weight[s] * rest / over for s in open_}
        beyond = [s for s in open_ if share[s] > 2 * totals[s]]
        if not beyond:
            return {**capped, **share}
        capped.update({s: 2 * totals[s] for s in beyond})


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(spark, rows, near={}):
    docs = spark.createDataFrame(rows, SCHEMA)
    docs = docs.selectExpr("*", "1 as size", "2 as src", "'a' as target", "0 as place", "0 as _m", "0 as _range", "0 as weight", "0 as extra")
    got = [tuple(r) for r in mixing.mixed(docs).select("doc_id", "size", "source_size", "target", "taken").collect()]
    totals, by_id = Counter(), defaultdict(list)
    for doc_id, source, text in rows:
        totals[source] += words(text)
        by_id[doc_id].append((words(text), source))
    want = plain_targets(totals)
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    expected = sorted(((i, words(t), totals[s], want[s]) for i, s, t in rows), key=key)
    for g, e in zip(sorted((r[:4] for r in got), key=key), expected, strict=True):
        assert g[:3] == e[:3] and g[3] == pytest.approx(e[3])
    assert all(r[4] in (0, r[1], 2 * r[1]) for r in got)
    # a target tells its source apart in these tables
    taken = Counter()
    for _, _, size, target, t in got:
        taken[size, round(target, 6)] += t
    for source in totals:
        assert abs(taken[totals[source], round(want[source], 6)] - want[source]) <= near.get(source, 0.51), source
    assert sorted(got, key=key) == sorted((tuple(r) for r in mixing.mixed(docs.repartition(7)).select("doc_id", "size", "source_size", "target", "taken").collect()), key=key)
    return got


def test_sources_nulls_repeats_and_clashing_names(spark):
    rows = [(i, "b", "w " * (i % 13 + 1)) for i in range(400)] + [(1000 + i, "é", "x\ty z " * (i % 7)) for i in range(200)]
    rows += [(2000 + i, None, "null source " * (i % 5)) for i in range(90)] + [(3000 + i, "a", "one") for i in range(17)]
    rows += [(7, "b", "same id other text")] * 3 + [(None, "b", "no id at all")] * 5 + [(None, None, None), (4000, "empty", None), (4001, "empty", " \n ")]
    rows += [(5000, "long", "word " * 100_000)]
    check(spark, rows, {"long": 50_000})


def test_budgets_are_met_to_the_word(spark):
    rows = [(s * 1000 + i, f"s{s}", "w " * (i % 29 + 1)) for s in range(7) for i in range(120 + 31 * s)]
    check(spark, rows)


def test_empty_tables(spark):
    assert mixing.mixed(spark.createDataFrame([], SCHEMA)).collect() == []
    got = mixing.mixed(spark.createDataFrame([(1, "a", None), (2, None, "")], SCHEMA)).collect()
    assert sorted((r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in got) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_knapsack_is_nearest():
    draw = np.random.default_rng(3)
    for _ in range(300):
        n = int(draw.integers(1, 5))
        lengths = draw.choice(np.arange(1, 40), n, replace=False)
        spare = draw.integers(0, 4, n)
        left = int(draw.integers(0, lengths.max() + 1))
        got = mixing.knapsack(lengths, spare, left, draw.permutation(n))
        assert (got >= 0).all() and (got <= spare).all()
        sums = [int(np.dot(c, lengths)) for c in itertools.product(*[range(s + 1) for s in spare])]
        assert abs(int(got @ lengths) - left) == min(abs(s - left) for s in sums)


def test_fitting_keeps_the_mix_of_lengths(monkeypatch):
    lengths, counts = np.array([3, 50, 400, 7000]), np.array([90_000, 10_000, 3_000, 50])
    total = int(lengths @ counts)
    for limit in (1 << 20, 64):
        monkeypatch.setattr(mixing, "DP_WORDS", limit)
        for budget in (0, 1, 999, total // 3, total - 2, total, total + 5):
            got = mixing.fitted(lengths, counts, budget, np.array([2, 0, 3, 1]))
            assert (got >= 0).all() and (got <= counts).all()
            assert abs(int(lengths @ got) - min(budget, total)) <= 2
            if 0 < budget < total:
                assert np.allclose(got / counts, budget / total, atol=0.1)
