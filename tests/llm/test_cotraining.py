"""Co-training over a whole table against the same in memory."""

import numpy as np

from rowgrad.llm import cotraining

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(n, seed):
    rng = np.random.default_rng(seed)
    out, good = [], {}
    for i in range(n):
        bad = rng.random() < 0.3
        ws = [f"w{x}" for x in rng.integers(0, 200, rng.integers(5, 60))]
        text = " ".join(w.upper() + "!!" for w in ws) if bad and rng.random() < 0.9 else " ".join(ws)
        out.append((i, text, "en", f"s{rng.integers(0, 3) + 3 * bad}", len(text)))
        good[i] = int(not bad)
    # copies of one row, null ids and texts, and a repeated id with another text
    out += [(5000, "same words here", "en", "s0", 15)] * 200 + [(None, out[3][1], "en", "s1", None), (5001, None, None, None, None), (1, "other text", "de", "s2", 3)]
    return out, good


def test_pseudo_labels_are_chosen_among_all_documents(spark, monkeypatch):
    monkeypatch.setattr(cotraining, "TAKE", 20)
    monkeypatch.setattr(cotraining, "SURE", 0.9)
    rows, good = rows_of(700, 1)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    labels = spark.createDataFrame([(i, q) for i, q in good.items() if i % 4 == 0], "doc_id long, quality int")
    calls, real = [], cotraining.picker

    def watched(pool):
        # every row that is neither learnt from nor held out
        whole = {r.mark: (r.lang, r.source, r.n_chars, r.text) for r in pool.collect()}
        pick = real(pool)

        def compared(models, calibrated, wanted, handed):
            got = pick(models, calibrated, wanted, handed)
            views = {m: [cotraining.content_view((t or "").encode()), cotraining.metadata_view((t or "").encode(), lang, source, n)] for m, (lang, source, n, t) in whole.items()}
            want = []
            for a in (0, 1):
                p = {m: float(cotraining.proba(cotraining.logit(cotraining.logit(v[a][None], models[a])[:, None], calibrated[a]))[0]) for m, v in views.items()}
                for label in (0, 1):
                    sure = sorted((-round(q if label else 1 - q, 6), m) for m, q in p.items() if m not in handed[1 - a] and round(q if label else 1 - q, 6) >= cotraining.SURE)
                    want.append((a, label, [-s for s, _ in sure[: wanted[label]]], {m for _, m in sure}))
            for a, label, best, allowed in want:
                mine = [m for x, t, m, _ in got if (x, t) == (a, label)]
                assert len(mine) == len(set(mine)) == len(best) and set(mine) <= allowed
                p = sorted((float(cotraining.proba(cotraining.logit(cotraining.logit(views[m][a][None], models[a])[:, None], calibrated[a]))[0]) for m in mine), reverse=True)
                np.testing.assert_allclose([q if label else 1 - q for q in (p if label else p[::-1])], best, atol=1e-4)
            for _, _, m, row in got:
                for v, w in zip(views[m], row, strict=True):
                    np.testing.assert_allclose(v, w, rtol=1e-5, atol=1e-6)
            calls.append(len(got))
            return got

        assert len(whole) > 300
        return compared

    monkeypatch.setattr(cotraining, "picker", watched)
    model = cotraining.train(docs, labels)
    assert len(calls) == cotraining.ROUNDS and sum(calls) == sum(model["taken"]) > 60
    out = {r.doc_id: r for r in cotraining.quality(docs, labels).collect()}
    assert np.mean([out[i].kept == bool(q) for i, q in good.items() if i % 4]) > 0.95
