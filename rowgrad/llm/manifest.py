"""Merkle manifest of a corpus: digests of all documents, folded by runs of eight into one root for each language and one for all.

Every node carries the interval of leaf ranks that it covers. The tree is built level by level with one bounded group for each run, and read back
from the top: a node meets its parent by a join on (tree, bucket of the level) in which the parent's interval must contain the node's, and its
siblings are the parent's children outside the node's own interval. So each node ends with the siblings of all its ancestors, and a leaf needs
those of its own run only. No task sees more than one run, whatever the languages' sizes.

Defined results: null fields are hashed as ``-``; null languages form a tree of their own, before the others; leaves with a null doc_id come
first in their tree and are never tampered with. Rows that repeat a doc_id ascend by their leaf digests; equal rows are leaves of their own. Empty
tables have no rows. Columns other than the five hashed ones are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowgrad.llm.texts import free, put
from rowgrad.operators.ranking import row_positions

FANOUT = 8
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def framed(value: Column) -> Column:
    """A field as the leaf digest takes it: ``-`` for null, else its UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    """Digest of a documents row with ``text`` in place of its text."""
    return digest(F.concat(*[framed(text if name == "text" else F.col(name)) for name in FIELDS]))


def tampered(every: int = 3) -> Column:
    """The rows that the check alters: those of which ``every`` divides the CRC-32 of the decimal doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """``(doc_id, tree, digest, shown)``: the leaf digest of every row, and the one that its text gives now (other than the first if tampered with).

    ``tree`` is the language behind a mark that sorts null before all others; Spark compares strings bytewise.
    """
    tree = F.coalesce(F.concat(F.lit("1"), F.col("lang")), F.lit("0"))
    altered = F.when(tampered() & F.col("text").isNotNull(), leaf_digest(F.translate("text", UPPER, UPPER.lower())))
    read = docs.select(*FIELDS)
    return read.select("doc_id", tree.alias("tree"), leaf_digest(F.col("text")).alias("digest"), altered.alias("shown"))


def ranked(rows: DataFrame, order: list[str], group: list[str] | None = None) -> DataFrame:
    """``rows`` with the interval ``[lo, hi)`` of their own rank in their group."""
    placed = row_positions(rows, order, group, name="hi")
    return placed.withColumns({"lo": F.col("hi") - 1})


def run_digest(kids: Column) -> Column:
    """The digest of a run of children, in their order."""
    return digest(F.concat_ws("", F.transform(kids, lambda k: k["digest"])))


@dataclass
class Tree:
    """The levels of all trees: ``levels[0]`` are runs of leaves, each higher one runs of runs; ``tops`` has one row for each tree."""

    levels: list[DataFrame]
    tops: DataFrame


def built(nodes: DataFrame, carried: list[str]) -> Tree:
    """Fold ``(tree, lo, hi, size, digest, *carried)`` by runs until each tree, of ``size`` leaves, has one node left.

    The carried columns stay with the leaves of the lowest runs. A tree of one leaf has a run of one that passes the leaf's digest on.
    """
    levels, width, tops = [], FANOUT, None
    deepest = nodes.agg(F.max("size")).first()[0] or 0
    while not levels or FANOUT ** len(levels) < deepest:
        kept = carried if not levels else []
        child = F.struct("lo", "hi", "digest", *kept)
        grouped = nodes if not levels else nodes.where("hi - lo < size")
        runs = grouped.groupBy("tree", F.floor(F.col("lo") / width).alias("bucket")).agg(
            F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("size").alias("size"), F.sort_array(F.collect_list(child)).alias("kids")
        )
        alone = F.col("size") == 1
        runs = runs.withColumn("digest", F.when(alone, F.col("kids")[0]["digest"]).otherwise(run_digest(F.col("kids"))))
        levels.append(put(runs, f"manifest-level{len(levels)}"))
        nodes, width = levels[-1].drop("kids", "bucket"), width * FANOUT
        done = nodes.where("hi - lo = size")
        tops = done if tops is None else tops.unionByName(done)
    return Tree(levels, tops)


def outside(kids: Column, lo: Column, hi: Column) -> Column:
    """The siblings of ``[lo, hi)``: the parent's children before and after it, joined to one text on each side."""

    def side(wanted) -> Column:
        return F.concat_ws("", F.transform(F.filter(kids, wanted), lambda k: k["digest"]))

    return F.struct(side(lambda k: k["hi"] <= lo).alias("left"), side(lambda k: k["lo"] >= hi).alias("right"))


def attached(tree: Tree, above: DataFrame) -> DataFrame:
    """The lowest runs with ``up``: the siblings of all their ancestors, from the run's own level to the last root.

    ``above`` ``(tree, up, *more)`` is what each tree's top has over it; its further columns come along.
    """
    more = [c for c in above.columns if c != "tree"]
    known = None
    for at in range(len(tree.levels) - 1, -1, -1):
        level = tree.levels[at]
        tops = level.where("hi - lo = size").join(above, "tree")
        if known is not None:
            width = FANOUT ** (at + 2)
            own = level.where("hi - lo < size").withColumn("parent", F.floor(F.col("lo") / width))
            parents = known.select("tree", F.col("bucket").alias("parent"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"), F.col("kids").alias("p_kids"), *more)
            met = own.join(parents, ["tree", "parent"]).where("p_lo <= lo and hi <= p_hi")
            step = F.array(outside(F.col("p_kids"), F.col("lo"), F.col("hi")))
            met = met.withColumn("up", F.concat(step, "up")).select(*tops.columns)
            tops = tops.unionByName(met)
        known = tops
    return known


def siblings_digest(up: Column) -> Column:
    return digest(F.concat_ws("", F.transform(up, lambda s: F.concat(s["left"], s["right"]))))


def folded(leaf: Column, up: Column) -> Column:
    """The root that a leaf digest and its siblings give."""
    return F.aggregate(up, leaf, lambda so_far, s: digest(F.concat(s["left"], so_far, s["right"])))


def manifest(docs: DataFrame) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and whether its text of today still folds to the root.

    Returns ``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)``, one row for each row of ``docs``.
    """
    spark = docs.sparkSession
    found = put(leaves(docs), "manifest-leaves")
    sizes = found.groupBy("tree").agg(F.count(F.lit(1)).alias("size"))
    # equal rows would meet in one range: their places in the written table tell them apart
    found_at = found.withColumn("at", F.monotonically_increasing_id())
    placed = ranked(found_at, ["doc_id", "digest", "at"], ["tree"]).join(sizes, "tree")
    langs = built(placed, ["doc_id", "shown"])

    subroots = put(langs.tops.select(F.col("tree").alias("lang"), "digest"), "manifest-subroots")
    n_langs = subroots.count()
    placed = ranked(subroots, ["lang"]).withColumns({"tree": F.lit(""), "size": F.lit(n_langs).cast("long")})
    whole = built(placed, ["lang"])
    root = whole.tops.select("tree", F.col("digest").alias("root"))
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    over = attached(whole, root.withColumn("up", nothing))
    kid = over.select("root", "up", "size", "kids", F.explode("kids").alias("kid"))
    above = kid.select(F.col("kid.lang").alias("tree"), F.col("kid.digest").alias("subroot"), "root", with_run("up").alias("up"))
    above = put(above, "manifest-above")

    runs = attached(langs, above)
    kid = runs.select("subroot", "root", "up", "size", "kids", F.explode("kids").alias("kid"))
    rows = kid.select(F.col("kid.doc_id").alias("doc_id"), F.col("kid.digest").alias("leaf"), F.col("kid.shown").alias("shown"), "subroot", "root", with_run("up").alias("up"))
    out = rows.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        siblings_digest(F.col("up")).alias("proof_sha256"),
        folded(F.coalesce("shown", "leaf"), F.col("up")).alias("folded_root"),
    )
    out = put(out.withColumn("verified", F.col("folded_root") == F.col("root")), "manifest")
    free(found, subroots, above, *langs.levels, *whole.levels)
    return out


def with_run(up: str) -> Column:
    """``up`` with the siblings of ``kid`` in its own run before it; the one leaf of a tree has no run."""
    own = F.array(outside(F.col("kids"), F.col("kid.lo"), F.col("kid.hi")))
    return F.when(F.col("size") == 1, F.col(up)).otherwise(F.concat(own, up))


# SQL folds this many levels, enough for 8 ** 7 documents a language.
_SQL_LEVELS = 7


def _framed_sql(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _crc32_sql(value: str) -> str:
    """CRC-32 of a text of ASCII digits."""
    bits = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))"
    codes = f"list_transform(string_split({value}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: {bits}), 4294967295)"


def _fold_sql(source: str, tree: str, prefix: str) -> str:
    """CTEs ``{prefix}0 …`` of nodes ``(tree, k, digest, size)`` by level, from ``source (tree, k, digest)``."""
    out = [f"{prefix}0 AS MATERIALIZED (SELECT {tree} AS tree, k, digest, count(*) OVER (PARTITION BY {tree}) AS size FROM {source})"]
    for level in range(_SQL_LEVELS):
        out.append(
            f"""{prefix}{level + 1} AS MATERIALIZED (SELECT tree, k // 8 AS k, CASE WHEN any_value(size) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY k)) END AS digest,
            (any_value(size) + 7) // 8 AS size FROM {prefix}{level} GROUP BY tree, k // 8)"""
        )
    return ",\n".join(out)


def _climb_sql(prefix: str, level: int, rows: str, tree: str) -> str:
    """``rows`` one level up: the proof grows by the siblings, ``cur`` folds with them."""
    kids = f"SELECT tree, k // 8 AS run, list({{'k': k, 'd': digest}} ORDER BY k) AS kids, any_value(size) AS size FROM {prefix}{level} GROUP BY tree, k // 8"
    side = "array_to_string(list_transform(list_filter(kids, lambda x: x.k {op} r.k), lambda x: x.d), '')"
    left, right = side.format(op="<"), side.format(op=">")
    return f"""SELECT r.* EXCLUDE (k, proof, cur), r.k // 8 AS k, CASE WHEN n.size = 1 THEN proof ELSE proof || {left} || {right} END AS proof,
      CASE WHEN n.size = 1 THEN cur ELSE sha256({left} || cur || {right}) END AS cur
      FROM {rows} r JOIN ({kids}) n ON n.tree = {tree} AND n.run = r.k // 8"""


def _oracle() -> str:
    whole = "sha256(" + " || ".join(_framed_sql(f) for f in FIELDS) + ")"
    changed = "sha256(" + " || ".join(_framed_sql(f"translate(text, '{UPPER}', '{UPPER.lower()}')" if f == "text" else f) for f in FIELDS) + ")"
    ctes = [
        f"""read AS MATERIALIZED (SELECT doc_id, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS tree, {whole} AS leaf,
          CASE WHEN text IS NOT NULL AND {_crc32_sql('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN {changed} END AS shown FROM documents)""",
        "leaves AS MATERIALIZED (SELECT *, leaf AS digest, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k FROM read)",
        _fold_sql("leaves", "tree", "n"),
        f"subs AS MATERIALIZED (SELECT tree AS lang, digest, row_number() OVER (ORDER BY tree) - 1 AS k FROM n{_SQL_LEVELS})",
        _fold_sql("subs", "''", "t"),
        "c0 AS (SELECT doc_id, tree, leaf, k, '' AS proof, coalesce(shown, leaf) AS cur FROM leaves)",
    ]
    for level in range(_SQL_LEVELS):
        ctes.append(f"c{level + 1} AS MATERIALIZED ({_climb_sql('n', level, f'c{level}', 'r.tree')})")
    ctes.append(f"d0 AS MATERIALIZED (SELECT c.* EXCLUDE (k), s.k, s.digest AS subroot FROM c{_SQL_LEVELS} c JOIN subs s ON s.lang = c.tree)")
    for level in range(_SQL_LEVELS):
        ctes.append(f"d{level + 1} AS MATERIALIZED ({_climb_sql('t', level, f'd{level}', chr(39) * 2)})")
    return f"""WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = digest AS verified
      FROM d{_SQL_LEVELS}, (SELECT digest FROM t{_SQL_LEVELS})"""


ORACLE = _oracle()
