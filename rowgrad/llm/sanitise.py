"""Personal data: base patterns, and terms that give protected values away.

Mail and IP addresses, card and phone numbers are found by pattern. For each such value, held by one text or by many, counts over the whole corpus
tell how strongly a term reveals it: of the value's own information, -log2 of its share of texts, the part that knowing the term gives away,
1 when all of it. Equal texts count once. In documents that hold the value, a term over one threshold is generalised, over a
higher one removed. DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowgrad.llm.texts import free, hinted, put

# Parts of a value's information.
GENERALISE, REMOVE = 0.5, 0.9
# So many texts more have the term, and hold the value as often as texts do anyway: a term seen once isn't yet proof.
PRIOR = 0.5

WORD = r"[\p{L}\p{N}]+"
# kind: (a test that is cheap and never wrong to skip by, pattern). Against the plain patterns, repeats are possessive and matches begin
# where a run begins or the match before ended; that changes no match, but long runs cost linear time and no stack.
PATTERNS = {
    "email": ("instr(text, '@') > 0", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": ("instr(text, '.') > 0", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": ("true", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": ("instr(text, '+') > 0", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_DIGITS = "translate(x.v, ' -().+', '')"
VALID = {
    "email": "true",
    "ip": r"x.v rlike r'^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$'",
    "card": f"case when length({_DIGITS}) between 13 and 19 then aggregate(sequence(1, length({_DIGITS})), 0, (s, i) -> s + case when i % 2 = 1 then int(substr(reverse({_DIGITS}), i, 1)) when substr(reverse({_DIGITS}), i, 1) >= '5' then 2 * int(substr(reverse({_DIGITS}), i, 1)) - 9 else 2 * int(substr(reverse({_DIGITS}), i, 1)) end) % 10 = 0 else false end",
    "phone": f"length({_DIGITS}) between 9 and 15",
}
SPANS = "array<struct<s:int,e:int,v:string>>"


def spans(kind: str) -> str:
    """SQL: begin, end (exclusive, code points) and value of all valid matches of a kind in ``text``.

    What lies between the matches gives their places: a fold adds up lengths.
    """
    test, pattern = PATTERNS[kind]
    none = f"cast(array() as {SPANS})"
    step = "named_struct('p', int(a.p + length(x.g) + length(x.m)), 'o', concat(a.o, array(named_struct('s', int(a.p + length(x.g)), 'e', int(a.p + length(x.g) + length(x.m)), 'v', x.m))))"
    places = f"aggregate(filter(zip_with(split(text, r'{pattern}', -1), m, (g, m) -> named_struct('g', g, 'm', m)), x -> x.m is not null), named_struct('p', 0, 'o', {none}), (a, x) -> {step}, a -> a.o)"
    return f"case when {test} then filter(aggregate(array(regexp_extract_all(text, r'{pattern}', 0)), {none}, (o, m) -> case when size(m) = 0 then o else {places} end), x -> {VALID[kind]}) else {none} end"


def _listed(kind: str) -> str:
    return f"transform({kind}, x -> concat('{kind}:', x.s, ':', x.e))"


def with_base(docs: DataFrame) -> DataFrame:
    """``docs`` (text not null) with a column of spans for each kind."""
    for kind in PATTERNS:
        docs = docs.withColumn(kind, F.expr(spans(kind)))
    return docs


def disclosing(held: DataFrame, docs: DataFrame) -> DataFrame:
    """(h, term, told): for each text with values, by its hash, the terms over the threshold and the largest part of a value's information that they tell.

    ``docs`` has all documents (h, text), ``held`` has h, vals and terms of those with values.
    """
    copies = put(docs.groupBy("h").agg(F.count("*").alias("copies")).where("copies > 1"), "copies")
    n_copied, n_more = copies.agg(F.count("*"), F.coalesce(F.sum(F.col("copies") - 1), F.lit(0))).first()
    n_texts = float(max(1, docs.count() - n_more))
    held = put(held.dropDuplicates(["h"]), "texts")
    # values that the same texts hold have the same counts with every term: they are one class
    values = held.select("h", F.explode("vals").alias("value")).groupBy("value").agg(F.count("*").alias("n_value"), F.expr("bit_xor(xxhash64(h, 1))").alias("a"), F.expr("bit_xor(xxhash64(h, 2))").alias("b"))
    values = put(values.select("value", "n_value", F.xxhash64("n_value", "a", "b").alias("class")), "values")
    classes = held.select("h", F.explode("vals").alias("value")).join(hinted(values, values.count(), 96), "value").groupBy("h").agg(F.collect_set(F.struct("class", "n_value")).alias("classes"))
    known = put(held.select("h", "terms").join(classes, "h"), "known")
    pairs = known.select("h", F.explode("classes").alias("c"), "terms").select("h", "c.*", F.explode("terms").alias("term")).where("term <> ''")
    n_both = pairs.groupBy("class", "n_value", "term").agg(F.count("*").alias("n_both"))
    wanted = put(known.select(F.explode("terms").alias("term")).distinct(), "terms")
    # all rows of a text that is listed n times are among those counted under n
    all_terms = docs.join(hinted(copies, n_copied, 24), "h", "left").select(F.coalesce("copies", F.lit(1)).alias("copies"), F.explode(F.array_distinct(F.split("text", r"[^\p{L}\p{N}]+"))).alias("term"))
    n_term = all_terms.groupBy("term", "copies").agg(F.count("*").alias("n")).join(wanted, "term").groupBy("term").agg(F.sum(F.expr("n div copies")).alias("n_term"))
    # the masked text has a document's terms without those inside values, so a term's texts are at least those of the pair
    rare = F.col("n_value") / F.lit(n_texts)
    share = (F.col("n_both") + PRIOR * rare) / (F.greatest("n_term", "n_both") + PRIOR)
    # a value that every text holds has no information to give away
    told = F.when(F.col("n_value") < n_texts, 1 - F.log2(share) / F.log2(rare)).otherwise(0.0)
    found = put(n_both.join(n_term, "term").select("class", "term", told.alias("told")).where(F.col("told") >= GENERALISE), "disclosing")
    out = put(pairs.join(hinted(found, found.count(), 64), ["class", "term"]).groupBy("h", "term").agg(F.max("told").alias("told")), "told")
    free(copies, held, values, known, wanted, found)
    return out


def sanitised(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of each row, then the spans by kind (email, ip, card, phone, term) and __clean, the text with them replaced.

    Null texts count as empty; an empty table gives an empty result. Rows count as often as they occur; those that share doc_id and text get
    equal answers. Base values become their kind in brackets, generalised terms [TERM], removed ones nothing; where spans overlap, the first one is
    replaced and what others add to it goes with it. A term span (value: how it was treated) never overlaps a base one.
    """
    docs = docs.select(*keep, F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)).alias("d"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__t")).select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)], "d", F.col("__t").alias("text"))
    docs = docs.withColumn("h", F.xxhash64("text"))
    based = with_base(docs)
    value = F.expr("array_distinct(transform(concat(email, ip, card, phone), x -> lower(x.v)))")
    masked = F.col("text")
    for _, pattern in PATTERNS.values():
        masked = F.regexp_replace(masked, pattern, " ")
    terms = F.array_distinct(F.split(masked, r"[^\p{L}\p{N}]+"))
    held = based.select("d", "h", "text", value.alias("vals")).where("size(vals) > 0").select("d", "h", "vals", terms.alias("terms"))
    held = put(held, "held")
    mine = disclosing(held.select("h", "vals", "terms"), docs.select("h", "text"))
    mine = put(held.select("d", "h").distinct().join(mine, "h"), "mine")
    asked = put(mine.select("d", "h").distinct(), "asked")
    some = docs.select("d", "h", "text").join(hinted(asked, asked.count(), 32), ["d", "h"], "left_semi").dropDuplicates(["d", "h"])
    words = some.select("d", "h", F.posexplode(F.expr(f"filter(zip_with(split(text, r'{WORD}', -1), regexp_extract_all(text, r'{WORD}', 0), (g, m) -> named_struct('g', length(g), 'm', m)), x -> x.m is not null)")))
    upto = "sum(col.g + length(col.m)) over (partition by d, h order by pos)"
    placed = words.selectExpr("d", "h", "col.m as term", f"int({upto}) as e").withColumn("s", F.expr("e - length(term)"))
    told = F.when(F.col("told") >= REMOVE, "removed").otherwise("generalised")
    term = placed.join(mine, ["d", "h", "term"]).groupBy("d", "h").agg(F.sort_array(F.collect_list(F.struct("s", "e", told.alias("v")))).alias("term"))
    term = put(term, "term_spans")
    n, spread = term.agg(F.count("*"), F.coalesce(F.sum(F.size("term")), F.lit(0))).first()
    # documents with revealing terms are joined back by their place-independent key; the others get no row there
    out = based.join(hinted(term, n * 32 + spread * 48, 1), ["d", "h"], "left")
    base = "concat(email, ip, card, phone)"
    out = out.withColumn("term", F.expr(f"coalesce(filter(term, t -> not exists({base}, b -> t.s < b.e and b.s < t.e)), cast(array() as {SPANS}))"))
    marks = "concat(transform(email, x -> named_struct('s', x.s, 'e', x.e, 'v', '[EMAIL]')), transform(ip, x -> named_struct('s', x.s, 'e', x.e, 'v', '[IP]')), transform(card, x -> named_struct('s', x.s, 'e', x.e, 'v', '[CARD]')), transform(phone, x -> named_struct('s', x.s, 'e', x.e, 'v', '[PHONE]')), transform(term, x -> named_struct('s', x.s, 'e', x.e, 'v', if(x.v = 'removed', '', '[TERM]'))))"
    clean = f"case when size({base}) + size(term) = 0 then text else aggregate(sort_array({marks}), named_struct('p', 0, 'o', ''), (a, x) -> if(x.s < a.p, named_struct('p', greatest(a.p, x.e), 'o', a.o), named_struct('p', x.e, 'o', concat(a.o, substr(text, a.p + 1, x.s - a.p), x.v))), a -> concat(a.o, substr(text, a.p + 1))) end"
    return out.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], *[F.col(k).alias(f"__{k}") for k in [*PATTERNS, "term"]], F.expr(clean).alias("__clean"))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256, spans, n_term (see the query's contract)."""
    found = sanitised(docs, ["doc_id"])
    for kind in [*PATTERNS, "term"]:
        found = found.withColumnRenamed(f"__{kind}", kind)
    base = ", ".join(_listed(k) for k in PATTERNS)
    return found.select(
        "doc_id",
        *[F.size(k).cast("bigint").alias(f"n_{k}") for k in PATTERNS],
        F.expr(f"sha2(cast(concat_ws(',', {base}) as binary), 256)").alias("base_sha256"),
        F.expr(f"concat_ws(',', {base}, {_listed('term')})").alias("spans"),
        F.size("term").cast("bigint").alias("n_term"),
    )


def clean_documents(docs: DataFrame) -> DataFrame:
    """The rows and columns of ``docs``; text has its personal data replaced (null stays null)."""
    out = sanitised(docs.withColumn("__null", F.col("text").isNull()), [*docs.columns, "__null"])
    return out.withColumn("text", F.when(~F.col("__null"), F.col("__clean"))).select(*docs.columns)
