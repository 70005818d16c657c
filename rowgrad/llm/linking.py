"""Links inside candidate nodes, confirmed on full sets, and the components they form.

Both near-duplicate operators hand over the same thing: members of nodes (bands or tree leaves), each with a set size
and a 256-bit sketch. Every member is first tried against one hub, the nearest centre of its nodes; when those links
are confirmed and joined to components, it is tried again only against members of other components. Members of one hub are compared by what each has
beyond the hub, which tells without their sets which pairs can't be similar. A family of n copies so costs n comparisons for those near
its original, and what is emitted follows the links and not the pairs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowgrad.llm.texts import free, hinted, put

SKETCH = ["s0", "s1", "s2", "s3"]
# Of 256 one-bit hashes, sets of similarity 0.8 differ in 25.6 on average (standard deviation 4.8); 50 is five deviations more.
MAX_DIFFERENT = 50
PIVOTS, PROBES, TRIES = 4, 16, 4
# Members of nodes with more of them are compared by their sets inside the join, after at most so many rounds of giving them hubs.
CROWD, HUB_ROUNDS = 64, 4


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id that each id of ``edges`` (id, other) reaches, by alternating star contraction.

    Each round links every vertex's larger, then its smaller neighbours to its smallest one, and halves the
    depth of trees; a vertex's neighbours are aggregated before they are shuffled and never gathered in one row. It ends when there are stars only.
    """
    edges = edges.where("id is not null and other is not null and id <> other")
    kept = put(edges.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct(), "edges")
    while True:
        both = kept.unionByName(kept.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        large = put(large, "large")
        free(kept)
        # now towards smaller ones: b's neighbours below it, all of them to the smallest
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select("a", "b", "m")
        small = small.select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        kept = put(small, "small")
        free(large)
        ends = kept.select(F.col("a").alias("id"), F.lit(0).alias("below")).unionByName(kept.select(F.col("b").alias("id"), F.lit(1).alias("below")))
        # a star's leaf is below its centre and nowhere else
        if not ends.groupBy("id").agg(F.sum("below").alias("below"), F.count("*").alias("n")).where("below > 0 and n > 1").count():
            return kept.select(F.col("b").alias("id"), F.col("a").alias("label")).unionByName(kept.select(F.col("a").alias("id"), F.col("a").alias("label")).distinct())


def alike(a: str, b: str) -> str:
    """SQL: could two members be similar by 0.8 or more, by their sizes (exactly) and their sketches (all but surely)?"""
    bits = " + ".join(f"bit_count({a}.{s} ^ {b}.{s})" for s in SKETCH)
    return f"100 * least({a}.n, {b}.n) >= 80 * greatest({a}.n, {b}.n) and {bits} <= {MAX_DIFFERENT}"


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (id, other) with intersection at least 0.8 of the union, written; ``sets`` has (id, set array<bigint>), ``pairs`` is cheap to read again."""
    ends = put(pairs.select("id").union(pairs.select("other")).distinct(), "ends")
    some = sets.join(hinted(ends, ends.count(), 48), "id", "left_semi")
    a = some.select("id", F.col("set").alias("__a"))
    b = some.select(F.col("id").alias("other"), F.col("set").alias("__b"))
    both = pairs.join(a, "id").join(b, "other").select("id", "other", F.size("__a").alias("na"), F.size("__b").alias("nb"), F.size(F.array_intersect("__a", "__b")).alias("common"))
    out = put(both.where("100 * common >= 80 * (na + nb - common)").select("id", "other"), "confirmed")
    free(ends)
    return out


def _once(sets: DataFrame) -> DataFrame:
    """``sets`` written, each id once: where rows repeat a document its set comes repeatedly."""
    found = put(sets, "sets")
    rows, ids = found.agg(F.count("*"), F.count_distinct("id")).first()
    if rows == ids:
        return found
    out = put(found.dropDuplicates(["id"]), "sets")
    free(found)
    return out


def _different(a: str, b: str) -> str:
    return " + ".join(f"bit_count({a}{x} ^ {b}{x})" for x in SKETCH)


def _near(members: DataFrame) -> DataFrame:
    """(id, n, s0..s3, c), written: each id with the centres of its nodes that may be similar; c has far, id, n and the sketch.

    A node's centre is the member nearest to a few of its members together: in a family of copies the text that they were made from.
    """
    pivots = members.groupBy("node").agg(*[F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("h"), *SKETCH)).alias(f"p{k}") for k in range(PIVOTS)])
    far = F.expr(" + ".join(_different("", f"p{k}.") for k in range(PIVOTS)))
    centres = members.join(pivots, "node").withColumn("far", far).groupBy("node").agg(F.min(F.struct("far", "id", "n", *SKETCH)).alias("c"))
    star = members.join(centres, "node").where("id <> c.id").where(alike("m", "c").replace("m.", ""))
    near = F.struct(F.expr(_different("", "c.")).alias("far"), "c.id", "c.n", *[f"c.{x}" for x in SKETCH])
    return put(star.withColumn("__c", F.col("c.id")).groupBy("id", "__c").agg(F.first("n").alias("n"), *[F.first(x).alias(x) for x in SKETCH], F.min(near).alias("c")).select("id", "n", *SKETCH, "c"), "near")


def _hubs(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, n, s0..s3, c): for each id the nearest node centre that may be similar. And (id, label): families, all that hangs together by such centres.

    A crowd that its node's centre doesn't resemble gets a centre of its own in the next round.
    """
    made = [_near(members)]
    all_near = made[0]
    while len(made) < HUB_ROUNDS:
        placed = all_near.select("id").union(all_near.select("c.id")).distinct()
        left = members.join(placed, "id", "left_anti")
        left = put(left.join(left.groupBy("node").count().where(F.col("count") > CROWD).select("node"), "node", "left_semi"), "left")
        more = _near(left) if left.count() else None
        free(left)
        if more is None:
            break
        made.append(more)
        all_near = all_near.unionByName(more)
    star = put(all_near.groupBy("id").agg(F.first("n").alias("n"), *[F.first(x).alias(x) for x in SKETCH], F.min("c").alias("c")), "star")
    kin = put(components(all_near.select("id", F.col("c.id").alias("other"))), "kin")
    free(*made)
    return star, kin


LINKED = "100 * common >= 80 * (n + n_hub - common)"


def _tested(tries: DataFrame, sets: DataFrame) -> DataFrame:
    """Each id with each hub that it is tried against: what they have in common, and what the id has beyond its family's main hub."""
    a, b = sets.select("id", F.col("set").alias("__a")), sets.select(F.col("id").alias("hub"), F.col("set").alias("__b"))
    both = tries.join(a, "id").join(b, "hub")
    return both.select("id", "n", *SKETCH, "hub", "n_hub", "main", F.size(F.array_intersect("__a", "__b")).alias("common"), F.when(F.col("main"), F.array_except("__a", "__b")).alias("extra"))


def link(members: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, label) of every id with a confirmed link, among the members (node, id, n, s0..s3) of each node.

    ``sets_of`` gives (id, set) for a table of ids. ``members`` must be cheap to read again.
    """
    star, kin = _hubs(members)
    centres = star.select("c.id", "c.n", *[f"c.{x}" for x in SKETCH]).dropDuplicates(["id"])
    sets = _once(sets_of(star.select("id").union(centres.select("id")).distinct()))
    # each is tried against its nearest centre, and all of a family against the hub of most members
    chosen = star.groupBy(F.col("c.id").alias("hub")).agg(F.count("*").alias("size")).join(kin, kin.id == F.col("hub")).groupBy("label").agg(F.max(F.struct("size", "hub"))["hub"].alias("hub"))
    mains = chosen.join(centres.select(F.col("id").alias("hub"), F.col("n").alias("n_hub")), "hub")
    everyone = star.select("id", "n", *SKETCH).unionByName(centres).dropDuplicates(["id"]).join(kin, "id").join(mains, "label")
    nearest = star.select("id", "n", *SKETCH, F.col("c.id").alias("hub"), F.col("c.n").alias("n_hub"), F.lit(False).alias("main"))
    tries = nearest.unionByName(everyone.select("id", "n", *SKETCH, "hub", "n_hub", F.lit(True).alias("main")))
    tries = tries.groupBy("id", "hub").agg(*[F.first(x).alias(x) for x in ("n", *SKETCH, "n_hub")], F.max("main").alias("main"))
    tried = put(_tested(tries, sets), "tried")
    tested = tried.where("main").drop("main")
    sure = put(tried.where(LINKED).where("id <> hub").select("id", F.col("hub").alias("other")).distinct(), "sure")
    free(star, kin)

    def labelled(sure: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(id, label, size) of linked ids, and all families with their members' labels and the one of most members, main."""
        labels = put(components(sure), "labels")
        sizes = put(labels.join(labels.groupBy("label").agg(F.count("*").alias("size")), "label"), "sizes")
        free(labels)
        family = tested.join(sizes.select("id", "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
        main = family.groupBy("hub", "label").agg(F.count("*").alias("size")).groupBy("hub").agg(F.max(F.struct("size", "label"))["label"].alias("main"))
        return sizes, put(family.join(main, "hub"), "family")

    sizes, family = labelled(sure)
    # who isn't linked to the most is tried against the nearest of some that are; one link is enough to join
    probes = family.where("label = main").groupBy("hub").agg(*[F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("h"), F.struct("id", "n", *SKETCH).alias("q")))["q"].alias(f"q{k}") for k in range(PROBES)])
    near = F.array(*[F.struct(F.expr(_different("", f"q{k}.")).alias("far"), F.col(f"q{k}.id").alias("other"), F.col(f"q{k}.n").alias("n_other")) for k in range(PROBES)])
    tries = family.where("label <> main").join(probes, "hub").select("id", "n", F.explode(F.slice(F.array_sort(F.array_distinct(near)), 1, TRIES)).alias("t")).select("id", "n", "t.*")
    tries = put(tries.where(f"far <= {MAX_DIFFERENT} and 100 * least(n, n_other) >= 80 * greatest(n, n_other)").select("id", "other").distinct(), "tries")
    more = confirmed(tries, sets)
    both = put(sure.unionByName(more).distinct(), "sure")
    free(sure, sizes, family, tries, more)
    sure = both
    sizes, family = labelled(sure)
    # members of one hub: what both share is in the hub, or among what each has beyond it, which bounds their similarity exactly
    x, y = family.where("label <> main").alias("x"), family.alias("y")
    shared = "(least(x.common, y.common) + size(array_intersect(x.extra, y.extra)))"
    same_hub = x.join(y, F.expr(f"x.hub = y.hub and x.label <> y.label and (y.label = y.main or x.id < y.id) and {alike('x', 'y')} and 100 * least(x.common, y.common) + 100 * least(size(x.extra), size(y.extra)) >= 80 * (x.n + y.n - least(x.common, y.common) - least(size(x.extra), size(y.extra))) and 100 * {shared} >= 80 * (x.n + y.n - {shared})"))

    # members of a node that have different hubs or none
    placed = tested.select("id", "hub").join(sizes, "id", "full")
    told = members.join(placed, "id", "left").select("node", "id", "n", *SKETCH, "hub", F.coalesce("label", "id").alias("label"), F.coalesce("size", F.lit(1)).alias("size"))
    told = put(told, "told")
    mixed = told.groupBy("node").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max(F.struct("size", "label")).alias("c"), F.count("*").alias("among"), F.expr("count(hub) < count(*) or min(hub) <> max(hub)").alias("hubs"))
    both = told.join(mixed.where("lo <> hi and hubs").select("node", F.col("c.label").alias("main"), "among"), "node")
    differ = f"x.node = y.node and x.label <> y.label and (y.label = y.main or x.id < y.id) and {alike('x', 'y')} and not coalesce(x.hub = y.hub, false) and not coalesce(x.hub = y.id, false) and not coalesce(y.hub = x.id, false)"
    few = both.where(F.col("among") <= CROWD)
    apart = few.where("label <> main").alias("x").join(few.alias("y"), F.expr(differ))
    # in crowded nodes the pairs that may be similar grow with the square of the crowd, those that are don't
    crowd = put(both.where(F.col("among") > CROWD).drop("among", "size"), "crowd")
    theirs = _once(sets_of(crowd.select("id").distinct().join(sets.select("id"), "id", "left_anti")))
    known = sets.unionByName(theirs)
    common = "size(array_intersect(x.set, y.set))"
    crowd_sets = crowd.join(known, "id")
    in_crowd = crowd_sets.where("label <> main").alias("x").join(crowd_sets.alias("y"), F.expr(f"{differ} and 100 * {common} >= 80 * (x.n + y.n - {common})"))
    pairs = [j.selectExpr("least(x.id, y.id) as id", "greatest(x.id, y.id) as other") for j in (same_hub, apart, in_crowd)]
    rest = put(pairs[0].union(pairs[1]).union(pairs[2]).distinct(), "rest")
    wanted = rest.select("id").union(rest.select("other")).distinct().join(known.select("id"), "id", "left_anti")
    more = _once(sets_of(wanted))
    also = confirmed(rest, known.unionByName(more))
    free(sets, tried, sizes, family, told, crowd, theirs, rest, more)
    out = put(components(sure.unionByName(also)), "components")
    free(sure, also)
    return out
