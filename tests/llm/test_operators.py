"""The text operators against plain versions, on small tables with the awkward cases among them."""

import collections
import hashlib
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from rowgrad.llm import cotraining, decontaminate, linking, paragraphs, pieces, rules, sanitise, setjoin, substrings, texts, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __score double, key string, node string, n long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, "k", "n", 3) for i, t in rows], SCHEMA)


def words(n, start=0, salt=""):
    return " ".join(f"w{salt}{i}" for i in range(start, start + n))


LONG = words(6000, salt="l")
BASE = words(60, salt="b")
CASES = [
    (1, None), (2, ""), (3, "one"), (4, "one"), (5, BASE), (6, BASE), (7, BASE.replace("wb30", "other")), (8, words(60, 30, "b")), (9, LONG),
    (9, LONG), (None, BASE), (None, None), (10, "   \n\n "), (11, BASE + "\nshort line\n" + words(25, salt="z")), (12, words(25, salt="z") + "\nñandú Ünï — ok"), (13, "The End"), (14, "the end"),
]


def test_near_duplicates(spark):
    got = {}
    for r in setjoin.near_duplicates(table(spark, CASES)).collect():
        got.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id, r.kept))
    assert got[1] == {(0, 1, True)} and got[2] == {(0, 2, True)} and got[10] == {(0, 10, True)}
    assert got[3] == {(1, 3, True)} and got[4] == {(1, 3, False)} and got[14] == {(1, 13, False)}
    assert got[5] == {(59, 5, True)} and got[6] == {(59, 5, False)} and got[7] == {(59, 5, False)} and got[8] == {(59, 8, True)}
    assert got[9] == {(5999, 9, True)} and got[None] == {(59, 5, False), (0, None, True)}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "id long, other long")
    got = {r.id: r.label for r in linking.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_trees_and_bands_meet_their_recall():
    assert 1 - (1 - 0.8**setjoin.DEPTH) ** setjoin.trees() >= setjoin.RECALL
    bands, rows = paragraphs.tuned()
    assert 1 - (1 - 0.8**rows) ** bands >= paragraphs.RECALL


def test_decontamination(spark):
    items = spark.createDataFrame([(1, words(20, salt="q")), (2, "Short Item"), (3, None), (4, "..."), (None, words(14, salt="n")), (2, "Short Item"), (30, words(13, salt="q"))], "item_id long, text string")
    docs = table(spark, [(1, None), (2, ""), (3, "a short, ITEM b"), (4, "x " + words(13, salt="q") + " y"), (5, words(12, salt="q")), (6, words(14, salt="n")), (7, words(3000, salt="x") + " " + words(20, salt="q"))])
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contamination(docs, items).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == {
        1: (0, 0, 0, sha(""), False), 2: (0, 0, 0, sha(""), False), 3: (4, 2, 1, sha("2"), True), 4: (15, 13, 2, sha("1,30"), True),
        5: (12, 0, 0, sha(""), False), 6: (14, 14, 0, sha(""), True), 7: (3020, 20, 2, sha("1,30"), False),
    }
    assert sorted(r.doc_id for r in decontaminate.clean(docs, items).collect()) == [1, 2, 5, 7]
    none = decontaminate.contamination(docs, items.limit(0)).collect()
    assert len(none) == 7 and not any(r.contaminated for r in none)


def test_shift_tables_find_all_occurrences():
    rng = np.random.default_rng(3)
    for k in (1, 2, 5, 13):
        text = rng.integers(0, 3, 5000)
        patterns = np.unique(np.stack([text[i : i + k] for i in rng.integers(0, 4900, 6)]), axis=0)
        at, which = decontaminate.Tables(patterns).find(text, np.array([0, 2500]), np.array([2500, 5000]))
        want = {(e, w) for w, p in enumerate(patterns) for e in range(k - 1, 5000) if (e - k + 1 >= 2500 or e < 2500) and (text[e - k + 1 : e + 1] == p).all()}
        assert set(zip(at.tolist(), which.tolist())) == want


def test_substrings(spark, monkeypatch):
    monkeypatch.setattr(substrings, "STRETCH", 3000)
    shared, other = words(90, salt="s"), words(90, salt="o")
    rows = [(1, None), (2, ""), (3, "x" + shared + "y"), (4, "zz" + shared), (5, shared[:399]), (6, "ab" * 600), (7, LONG), (8, LONG[5000:9000]), (9, other), (9, other), (None, other[:450])]
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.substring_removals(table(spark, rows)).collect())
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(b[p : p + 400] for _, b in raw for p in range(len(b) - 399))
    want = collections.Counter()
    for i, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - 399):
            if seen[b[p : p + 400]] > 1:
                gone[p : p + 400] = b"\x01" * 400
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[(i, len(b), sum(gone), sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1])), hashlib.sha256(kept).hexdigest())] += 1
    assert got == want


def test_paragraphs(spark):
    got = {(r.doc_id, r.__getitem__("n_paragraphs")): r.removed for r in paragraphs.paragraph_removals(table(spark, CASES)).collect()}
    assert got[(5, 1)] == [] and got[(6, 1)] == [0] and got[(11, 3)] == [0] and got[(12, 2)] == [0] and got[(9, 1)] == [] and got[(1, 0)] == [] and got[(None, 1)] == [0]
    assert got[(7, 1)] == [0]  # a changed word costs five of 56 shingles on either side: 51 / 61 is over 0.8


def test_pieces_are_the_library_s(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.VOCABULARY)
    samples = [t for _, t in CASES if t] + ["  two  spaces ", "tab\tand\x00nul", "日本 語 🙂", "a" * 300, " " * 40, "   x"]
    docs = table(spark, list(enumerate(samples)) + [(98, None), (99, "a▁b")])
    got = {r.doc_id: r for r in pieces.decode(pieces.encode(docs, ["doc_id", "text"]), ["doc_id", "text", "ids", "n_pieces"]).collect()}
    for i, t in enumerate(samples):
        assert got[i].ids == library.encode(t) and got[i].decoded == t and got[i].n_pieces == len(got[i].ids)
    assert got[98].ids == [] and got[98].decoded == "" and got[99].decoded == "a▁b"


def test_archives(spark):
    big = "<p>" + "x" * 200 + "</p>"
    rows = [(5, "http://www.A.org:80/b?c#d", big), (3, "https://x.b.org/ä b", big), (9, None, None), (8, "mailto:x", "short"), (7, "http://a.org", "short"), (6, "http://a.org", big + "é\r\n\r\n"), (6, "http://a.org", big + "é\r\n\r\n"), (None, "http://a.org", big), (4, "http://u@a.org", "y" * 17_000_000)]
    got = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect())
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    want = collections.Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        again = i is not None and h in first and first[h] != i
        want[(i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h] if again else None)] += 1
    assert got == want
    assert warc.capture_key("http://www.A.org:80/b?c#d") == "org,a,www)/b?c"


def test_index_blocks_and_lookup(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 7)
    found = spark.createDataFrame([(f"k{i % 23:02d}", i // 3, "f", i, 10) for i in range(300)], "key string, page_id long, file string, at long, length long")
    blocks, directory = warc.build_index(found)
    assert len(directory) >= 40 and directory == sorted(directory)
    keys = spark.createDataFrame([("k05", 9), ("k22", 29), ("zz", 1), ("", 0)], "key string, page_id long")
    got = sorted(r["at"] for r in warc.lookup(keys, blocks, directory).collect())
    assert got == [i for i in range(300) if (f"k{i % 23:02d}", i // 3) in {("k05", 9), ("k22", 29)}]


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(t):
    def ok(k, v):
        d = re.sub(r"[^0-9]", "", v)
        if k == "ip":
            return all(int(x) <= 255 for x in v.split("."))
        if k == "card":
            return 13 <= len(d) <= 19 and sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(d[::-1])) % 10 == 0
        return k != "phone" or 9 <= len(d) <= 15

    return [f"{k}:{m.start()}:{m.end()}" for k in PLAIN for m in re.finditer(PLAIN[k], t or "") if ok(k, m[0])]


def test_personal_data(spark):
    secret = "codename Zanzibarix lives near %d, ask z@b.co or 1.2.3.4"
    rows = [(1, None), (2, ""), (3, "x@y.z_w@v.u.t a@b @c.d 300.1.1.1 1.2.3.4.5 0001.02.3.004"), (4, "🙂 4111 1111 1111 1111, 4111-1111-1111-1112 +49 (30) 123-456 7"), (5, "1" * 30_000 + "." * 20 + "a" * 30_000), (6, "9 " * 20_000)]
    rows += [(10 + i, secret % i) for i in range(4)] + [(100 + i, f"plain text number {i} lives near") for i in range(400)]
    got = {r.doc_id: r for r in sanitise.personal_data(table(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        base = plain_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert got[i].spans.split(",")[: len(base)] == (base or got[i].spans.split(",")[:0])
    assert "term:9:19" in got[10].spans and got[100].n_term == 0
    clean = {r.doc_id: r.text for r in sanitise.clean_documents(table(spark, rows)).collect()}
    assert clean[1] is None and clean[2] == "" and "Zanzibarix" not in clean[11] and "[EMAIL]" in clean[11] and "[IP]" in clean[11] and clean[105] == rows[15][1]


def test_quality_rules(spark):
    got = {r.doc_id: r for r in rules.quality_rules(table(spark, [(1, None), (2, ""), (3, "a b c d e f " * 10), (4, words(40)), (5, words(20) + "\n" + "same line\n" * 3 + " \n#$"), (6, words(20).upper() + " É"), (7, LONG)])).collect()}
    assert (got[1].n_words, got[1].base_failed, got[1].kept) == (0, True, False) and got[2].base_failed
    assert got[3].n_repeat_words == 60 and got[3].base_failed and got[4].kept and got[7].kept and got[7].n_words == 6000
    assert (got[5].n_words, got[5].n_dup_lines, got[5].n_symbols, got[5].word_chars) == (27, 2, 2, len(re.sub(r"\s", "", words(20))) + 24 + 2)
    assert not got[6].base_failed and not got[6].kept


def test_empty_tables(spark):
    none, labels = table(spark, CASES).limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    for got in (setjoin.near_duplicates(none), paragraphs.paragraph_removals(none), substrings.substring_removals(none), sanitise.personal_data(none), rules.quality_rules(none), decontaminate.contamination(none, items), cotraining.quality(none, labels), toxicity.toxicity(none, labels), pieces.encode(none, ["doc_id"]), warc.archived(spark.createDataFrame([], "page_id long, url string, html string"))):
        assert got.count() == 0


def test_classifiers_without_labels_and_held_out_accuracy(spark):
    docs = table(spark, CASES)
    labels = spark.createDataFrame([(5, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert {r.score for r in cotraining.quality(docs, labels).collect()} == {1.0}
    assert {(r.score, r.predicted) for r in toxicity.toxicity(docs, labels).collect()} == {(0.0, 0)}
    rng = np.random.default_rng(1)
    rows, marks = [(9000, None), (9001, "")], []
    for i in range(600):
        bad, rude = i % 5 == 0, i % 3 == 0
        ws = [f"w{x}" for x in rng.integers(0, 300, 40)]
        text = " ".join(w.upper() + "!!" for w in ws) if bad else " ".join(ws)
        rows.append((i, text + (" vilely" + chr(97 + i % 26) if rude else "")))
        marks.append((i, int(not bad), int(rude)))
    docs, labels = table(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in cotraining.quality(docs, labels).collect()}
    held = [m for m in marks if got[m[0]].held_out]
    assert len(held) > 100 and np.mean([got[i].kept == bool(q) for i, q, _ in held]) > 0.97 and 0 <= got[9000].score <= 1
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert np.mean([got[i].predicted == t for i, _, t in held]) > 0.95 and got[9001].predicted == 0


def test_slices_take_every_row_once():
    sizes = np.array([3, 9, 1, 1, 20, 0, 2])
    assert list(texts.slices(sizes, 5)) == [(0, 1), (1, 2), (2, 4), (4, 5), (5, 7)]
    assert not list(texts.slices(sizes[:0]))


def contaminated(text, windows):
    found = plain_words(text)
    hit = set()
    for n in {len(w) for w in windows}:
        for i in range(len(found) - n + 1):
            if tuple(found[i : i + n]) in windows:
                hit.update(range(i, i + n))
    return bool(hit) and 20 * len(hit) >= len(found)


def plain_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def test_pipeline(spark, folder):
    """Every stage on what the one before kept, with nulls, repeats and columns whose names the operators use themselves."""
    import corpus_pipeline
    from pyspark.sql import functions as F
    from tests.llm.test_brute import components, shingles
    from tests.llm.test_brute import words as split

    base = spark.read.parquet(f"{folder}/documents.parquet")
    more = [(5000, None, None, None, None), (5001, "", "en", "s", 0), (None, None, "en", "s", 3), (1, None, "de", "s", 1), (5002, "a short one", "en", "src1", 11), (5002, "a short one", "en", "src1", 11)]
    docs = base.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long"))
    clash = ["d", "__t", "__hits", "__text", "__score", "__gone", "ids", "e0"]
    docs = texts.put(docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in clash}), "start")
    names, rows = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.select("doc_id", "text").collect()
        docs = texts.put(stage(spark, docs, folder), name)
        assert set(names) <= set(docs.columns)
        rows[name] = (before, docs.collect())
        # further columns stay with their rows
        assert all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for r in rows[name][1] for c in clash if c != "ids")
    assert len(rows["quality"][1]) > 100

    before, after = rows["near_duplicates"]
    sets = {(r.doc_id, i): shingles(split(r.text), 5) for i, r in enumerate(before) if r.doc_id is not None}
    label = components(sets)
    lowest = {k: min(x[0] for x, l in label.items() if l == label[k]) for k in sets}
    # rows that repeat a doc_id stay if one of them does
    stays = {d for (d, i) in sets if not sets[d, i] or lowest[d, i] == d}
    wanted = [d for d, _ in sets if d in stays]
    assert sorted(r.doc_id for r in after if r.doc_id is not None) == sorted(wanted)

    before, after = rows["decontamination"]
    windows = set()
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        ws = plain_words(r.text)
        windows.update(tuple(ws[i : i + 13]) for i in range(max(1, len(ws) - 12)) if ws)
    key = lambda x: (x is not None, x or 0)
    assert sorted((r.doc_id for r in after), key=key) == sorted((r.doc_id for r in before if not contaminated(r.text, windows)), key=key)

    assert len(rows["personal_data"][1]) == len(rows["decontamination"][1])
    before, after = rows["token_ids"]
    assert len(after) == len(before) and all(r.same_text and r.n_pieces == len(r.ids) and bool(r.ids) == bool(r.text) for r in after)


def test_pipeline_hands_workers_small_batches(spark, folder, monkeypatch):
    """Ten thousand rows, Spark's own limit, would be one batch of 40 MB."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    def sizes(spark, docs, folder):
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "bytes": [b.nbytes]})

        rows = docs.sparkSession.range(0, 10_000, 1, 1).select(F.repeat(F.lit("word "), 800).alias("text"))
        return rows.mapInArrow(run, "n long, bytes long")

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("sizes", sizes)])
    got = corpus_pipeline.run(spark, folder).collect()
    assert sum(r.n for r in got) == 10_000 and max(r.bytes for r in got) < 2 * corpus_pipeline.BATCH_BYTES
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("broken", lambda *_: 1 / 0)])
    with pytest.raises(ZeroDivisionError):
        corpus_pipeline.run(spark, folder)
    assert spark.conf.get(name, None) == before


@pytest.mark.parametrize("name", ["op1_decontaminate", "op5_warc", "op9_rules"])
def test_queries_match_their_sql(spark, folder, name):
    import duckdb

    from rowgrad.llm.entries import ORACLES, QUERIES

    db = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        db.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want = db.execute(ORACLES[name])
    cols = [c[0] for c in want.description]
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r[c] for c in cols)) for r in QUERIES[name](spark, folder).collect())


def test_toxicity_learns_from_every_label(spark, monkeypatch):
    """A word of its own in every document: all of them are counted, dealt and learned; layout changes scores by rounding only."""
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 150)
    ids = [i for i in range(900) if crc32(str(i).encode()) % 4 != 2]
    labels = spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i in range(900)], "doc_id long, quality int, toxic int")
    docs = table(spark, [(i, f"plain words here {'vile' + chr(97 + i % 26) if i % 3 == 0 else 'kind'} only{i}") for i in range(900)])
    rows = toxicity._labelled(docs, labels)
    assert sorted(r.id for r in rows.collect()) == ids
    learned = [i for i in ids if crc32(f"c{i}".encode()) % 4 != 0]
    shards = toxicity._shards(rows.where("not checks"), 4)
    sizes = [len(np.frombuffer(r.y, np.int8)) for r in shards.collect()]
    assert len(sizes) == 4 and sum(sizes) == len(learned)
    count = toxicity._counted(shards)
    for i in learned:
        assert count[int(i % 3 == 0), toxicity.slots(f"only{i}")[0]] >= 1
    plain = toxicity.slots("plain")[0]
    assert count[1, plain] == sum(i % 3 == 0 for i in learned) and count[:, plain].sum() == len(learned)
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    again = {r.doc_id: r.score for r in toxicity.toxicity(docs.repartition(7), labels.repartition(3)).collect()}
    assert again.keys() == got.keys() and max(abs(again[i] - got[i]) for i in got) < 1e-6
    held = [i for i in range(900) if i not in set(ids)]
    assert np.mean([(got[i] >= 0.3) == (i % 3 == 0) for i in held]) > 0.95


def test_toxicity_shards_add_up():
    net = toxicity.Net()
    net.const = np.float32(0.5)
    other = toxicity.Net(3)
    other.unpack(net.packed())
    assert (other.packed() == net.packed()).all() and (other.filters[2] == net.filters[2]).all() and other.const == 0.5
    # grouped counts calibrate and choose like single rows
    z, y = np.array([-2.0, -1.0, -1.0, 1.0, 1.0, 2.0] * 9), np.array([0, 0, 1, 1, 0, 1] * 9)
    at = np.unique(z)
    n, t = np.array([(z == v).sum() for v in at]), np.array([y[z == v].sum() for v in at])
    assert np.allclose(toxicity.calibrated(at, t, n), toxicity.calibrated(z, y, np.ones(len(z))))
    assert toxicity.best_threshold(np.array([0.9, 0.6, 0.2]), np.array([8, 4, 1]), np.array([9, 5, 30])) == 0.4
