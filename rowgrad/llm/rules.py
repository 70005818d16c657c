"""Quality rules as a short-circuit cascade.

Base counts come from one pass of SQL functions. The method's rules are tried on a sample first: how many rows each rejects and how long it takes,
with all that it alone works out. The cascade asks them in the order of rejections per second, and a rejected row is asked no further. The order
changes the cost and never the verdict. DataFrame and SQL functions only.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowgrad.llm.texts import free, put

# The cascade's order (nothing else) is estimated on about so many rows, drawn by hash, each rule timed so many times.
SAMPLE, TIMES = 2_000, 3

_REPEATED = """
aggregate(array(if(size(w) < 5, cast(array() as array<bigint>), transform(sequence(1, size(w) - 4), i -> xxhash64(w[i - 1], w[i], w[i + 1], w[i + 2], w[i + 3])))), 0L,
  (o, hs) -> case when size(array_distinct(hs)) = size(hs) then 0L else
    aggregate(array(sort_array(transform(hs, (v, k) -> named_struct('v', v, 'k', k)))), 0L, (o2, s) ->
      aggregate(array(sort_array(filter(transform(s, (x, k) -> if(coalesce(get(s, k - 1).v = x.v, false) or coalesce(get(s, k + 1).v = x.v, false), x.k, null)), k -> k is not null))), 0L, (o3, ks) ->
        aggregate(zip_with(ks, slice(ks, 2, size(ks)), (a, b) -> bigint(least(5, coalesce(b, a + 5) - a))), 0L, (u, v) -> u + v)))
  end)
"""
_BASE = f"""
transform(array(filter(split(text, r'[\\x20\\x09-\\x0D]+'), x -> x <> '')), w -> named_struct(
  'n_words', bigint(size(w)), 'word_chars', bigint(length(array_join(w, ''))), 'n_repeat_words', {_REPEATED}))[0]
"""
_LINES = """
transform(array(filter(split(text, r'\\n'), x -> x rlike r'[^\\x20\\x09-\\x0D]')), l -> named_struct('n_lines', bigint(size(l)), 'n_dup_lines', bigint(size(l) - size(array_distinct(l)))))[0]
"""
# Name: SQL that is true for a row to reject. Each works on whole texts or on counts over them.
RULES = {
    "word_length": "word_chars < 2 * n_words or word_chars > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "n_lines >= 4 and 10 * n_dup_lines > 3 * n_lines",
    "alphabetic_words": "10 * size(filter(split(text, r'[\\x20\\x09-\\x0D]+'), x -> x rlike r'\\p{L}')) < 7 * n_words",
    "capitals": "2 * length(regexp_replace(text, r'[^\\p{Lu}]', '')) > length(regexp_replace(text, r'[^\\p{L}]', ''))",
    "bullet_lines": "10 * size(filter(split(text, r'\\n'), x -> x rlike r'^[ \\t]*[-*\\u2022]')) > 9 * greatest(n_lines, 1)",
    "ellipsis_lines": "10 * size(filter(split(text, r'\\n'), x -> x rlike r'(\\.\\.\\.|\\u2026)[ \\t\\r]*$')) > 3 * greatest(n_lines, 1)",
}
FAILED = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"


def counted(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns (renamed k0, k1, ...), text (null: empty) and the counts over it."""
    out = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = out.withColumn("b", F.expr(_BASE)).withColumn("l", F.expr(_LINES)).withColumn("n_symbols", F.expr("bigint(length(text) - length(translate(text, '#*$%&|<>', '')))"))
    return out.select(*[f"k{i}" for i in range(len(keep))], "text", "b.*", "l.*", "n_symbols")


def measured(docs: DataFrame) -> dict[str, tuple[int, float]]:
    """How many rows of the sample each rule rejects, and in how many seconds: the quickest of some runs, less what a run without a rule takes."""
    share = min(1.0, SAMPLE / max(1, docs.count()))
    some = put(counted(docs.where(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1 << 20)) < int((1 << 20) * share)), []), "sample")

    def tried(rule: str) -> tuple[int, float]:
        asked = some.selectExpr(f"count_if({rule})", "count(text)", "sum(n_words + word_chars + n_symbols + n_dup_lines + n_lines)")
        rejected, best = asked.first()[0], float("inf")  # the first run compiles it
        for _ in range(TIMES):
            began = time.perf_counter()
            asked.first()
            best = min(best, time.perf_counter() - began)
        return rejected, best

    _, empty = tried("n_words < 0")
    seen = {name: tried(rule) for name, rule in RULES.items()}
    free(some)
    return {name: (rejected, max(0.001, seconds - empty)) for name, (rejected, seconds) in seen.items()}


def cascade_order(docs: DataFrame) -> list[str]:
    """Rule names, the most rejections per second first, as a sample shows."""
    seen = measured(docs)
    return sorted(RULES, key=lambda r: -(seen[r][0] + 0.5) / seen[r][1])


def judged(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns as k0, k1, ..., the base counts, base_failed and kept.

    Null and empty texts have no words and fail. Repeated rows are judged alike; an empty table gives an empty result.
    """
    order = cascade_order(docs)
    verdict = "case when base_failed then false " + "".join(f"when {RULES[r]} then false " for r in order) + "else true end"
    return counted(docs, keep).withColumn("base_failed", F.expr(FAILED)).withColumn("kept", F.expr(verdict))


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    return judged(docs.select("doc_id", "text"), ["doc_id"]).selectExpr("k0 as doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
with t as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from t),
g as (select doc_id, s, list_slice(ws, s, s + 4) as win from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as s from w where len(ws) >= 5)),
d as (select doc_id, win from g group by doc_id, win having count(*) > 1),
r as (select doc_id, count(distinct word) as n_repeat_words from (select g.doc_id, unnest(range(s, s + 5)) as word from g join d on g.doc_id = d.doc_id and g.win = d.win) group by doc_id),
c as (select w.doc_id, text, ws, ls, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars,
    cast(length(text) - length(translate(text, '#*$%&|<>', '')) as bigint) as n_symbols, cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
  from w left join r on w.doc_id = r.doc_id),
f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from c)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or word_chars < 2 * n_words or word_chars > 20 * n_words or 10 * n_symbols > n_words or (len(ls) >= 4 and 10 * n_dup_lines > 3 * len(ls))
    or 10 * len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}'))) < 7 * n_words
    or 2 * length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) > length(regexp_replace(text, '[^\p{L}]', '', 'g'))
    or 10 * len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^[ \t]*[-*•]'))) > 9 * greatest(len(ls), 1)
    or 10 * len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '(\.\.\.|…)[ \t\r]*$'))) > 3 * greatest(len(ls), 1)) as kept
from f
"""
