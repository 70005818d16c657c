"""Crowded nodes, stars and words of a slice: what joins emit, how many rounds are run, which words are found."""

import numpy as np
import pyarrow as pa

from rowgrad.llm import linking, paragraphs
from rowgrad.llm.setjoin import split_words
from rowgrad.llm.texts import Remembered, hash_word

NO_BIT, SIXTY_BITS = (0, 0, 0, 0), ((1 << 60) - 1, 0, 0, 0)


def counted(monkeypatch):
    """Rows of each table that linking writes, by name."""
    rows, put = {}, linking.put

    def noted(df, name):
        out = put(df, name)
        rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(linking, "put", noted)
    return rows


def test_crowded_nodes_give_links_and_no_pairs_beside(spark, monkeypatch):
    # a family round a centre, and a crowd without one: alike by sketch, similar by 0.71, but for one pair
    family = {f"a{i:03}": [*range(100), 1000 + i] for i in range(200)}
    crowd = {f"b{i:03}": [*range(200, 300), *range(2000 + 20 * i, 2020 + 20 * i)] for i in range(80)}
    crowd["b079"] = [*crowd["b078"][:-1], 9999]
    sets = family | crowd
    members = spark.createDataFrame([(7, bytearray(k, "ascii"), len(s), *(NO_BIT if k in family else SIXTY_BITS)) for k, s in sets.items()], "node long, id binary, n long, s0 long, s1 long, s2 long, s3 long")
    whole = spark.createDataFrame([(bytearray(k, "ascii"), s) for k, s in sets.items()], "id binary, set array<long>")
    rows = counted(monkeypatch)
    got = {bytes(r.id).decode(): bytes(r.label).decode() for r in linking.link(members, lambda ids: whole.join(ids, "id")).collect()}
    assert got == {k: "a000" for k in family} | {"b078": "b078", "b079": "b078"}
    assert rows["rest"][0] <= 1


def test_stars_end_after_one_round(spark, monkeypatch):
    rows = counted(monkeypatch)
    edges = spark.createDataFrame([(5, 1), (1, 7), (1, 9), (3, 4)], "id long, other long")
    got = {r.id: r.label for r in linking.components(edges).collect()}
    assert got == {1: 1, 5: 1, 7: 1, 9: 1, 3: 3, 4: 3}
    assert len(rows["small"]) == 1


def test_words_of_a_slice_are_those_of_each_text():
    texts = ["  Ab c\tÄß\x0b\x1f d\x0c", "", "x Y z \r\nab", " ", "ab"]
    whole = [t.encode() for t in texts]
    h, sizes = paragraphs._word_hashes(pa.array(whole, pa.binary()), Remembered(hash_word))
    want = [split_words(t) for t in whole]
    assert sizes.tolist() == [len(w) for w in want]
    assert np.array_equal(h, np.array([hash_word(w) for ws in want for w in ws], np.uint64))
