"""Mixing sources to target weights by Pareto order sampling.

Every source has a weight; its target is its share of all words, at most
MAX_COPIES times its own size, the excess shared again by weight until no
source is above.  A document first gets the whole copies that are certain,
floor(target / size of its source).  The rest of the target is sampled, a
sample whose size is fixed in words: with inclusion probability p, in
proportion to weight_col (unequal within a source; the queries take by_size),
and a uniform u that hashes the id, documents are ranked by
(u / (1 - u)) / (p / (1 - p)), Pareto's order, and taken from the least on
while their words stay within what is left.  The gap that the first document
not taken leaves is filled in FILLS further rounds by the documents next in
order that are small enough; last, the smallest document not taken is added if
that brings the words nearer to the target.

No group of rows is sorted in one task: ranks are counted in buckets, about as
many as the root of the number of rows, pre-aggregated before the shuffle; only
the bucket where a source's words run out is looked at document by document.
What comes out are a few thresholds for each source, so copies are a function
of a row and of its source's thresholds, and reruns agree.

Cases: a null or empty text has size 0 and is taken 0 words; a null source is a
source, last in order; rows with equal ids (repeated rows) share their rank and
are taken together; documents without words and those of a null id are ranked like
others; an empty table gives an empty result; other columns are kept, but for
mix_copies, mix_target and mix_source_size, which the results replace.  One row
for each source goes through a single task for the targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.scratch import save

MAX_COPIES = 3
FILLS = 3
WEIGHTS = (5, 2, 1)
#: Sources up to which their thresholds are broadcast; a row is under 300 bytes besides its name.
BROADCAST_SOURCES = 5_000


def n_words(text: str = "text") -> Column:
    """Number of runs without ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def by_size(size: str = "size") -> Column:
    """Inclusion odds that grow with the root of a document's words: long documents are rarer, and their words go farther."""
    return F.sqrt(F.greatest(F.col(size), F.lit(1)).cast("double"))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """(source, rows, words, target) from (source, rows, words): one row for each source.

    Weights go to the sources in order of code points, null last, and repeat.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    each = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int") + 1))
    each = each.withColumn("cap", F.col("words") * float(most)).withColumn("ratio", F.col("cap") / F.col("w"))
    # in order of ratio, those at their cap are a prefix: each is tested as if all before were at theirs
    rank = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, whole = rank.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    each = each.withColumn("left", F.sum("words").over(whole).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    each = each.withColumn("open", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    each = each.withColumn("level", F.col("left") / F.col("open")).withColumn("full", F.col("ratio") <= F.col("level"))
    each = each.withColumn("water", F.min(F.when(~F.col("full"), F.struct("ratio", "level"))).over(whole)["level"])
    return each.select("source", "rows", "words", F.when(F.col("full"), F.col("cap")).otherwise(F.col("water") * F.col("w")).alias("target"))


def _uniform(id_col: str, seed: int) -> Column:
    return (F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _rank(u: Column, share: Column, weight: Column) -> Column:
    """Pareto's order on a scale where a source's documents of mean weight lie evenly in (0, 1)."""
    tame = lambda x: F.greatest(F.lit(1e-9), F.least(x, F.lit(1 - 1e-9)))
    p, base = tame(share * weight), tame(share)
    odds = u / (1 - u) / (p / (1 - p)) * (base / (1 - base))
    return odds / (1 + odds)


def _beside(df: DataFrame, side: DataFrame, source: str = "source", how: str = "inner") -> DataFrame:
    """df with the columns of side, which has a row for each source, named s there."""
    return df.join(F.broadcast(side) if side.count() <= BROADCAST_SOURCES else side, _same(F.col(source), F.col("s")), how)


def _thresholds(rows: DataFrame, plan: DataFrame, buckets: int) -> DataFrame:
    """(s, upto, used): documents of source s with rank v < upto are taken, `used` words.

    rows: (source, v, size) of the candidates; plan: (s, gap) words to fill.
    """
    b = F.least(F.floor(F.col("v") * buckets).cast("int"), F.lit(buckets - 1))
    counted = rows.groupBy("source", b.alias("b")).agg(F.sum("size").alias("words"))
    counted = counted.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("b")))
    # the first bucket that doesn't fit whole; without one, all are taken
    over = F.min(F.when(F.col("upto") > F.col("gap"), F.struct("b", (F.col("upto") - F.col("words")).alias("before"))))
    first = _beside(counted, plan).groupBy("source").agg(over.alias("cut"), F.max("gap").alias("gap"), F.sum("words").alias("all"))
    first = save(first.select(F.col("source").alias("s"), F.col("cut.b").alias("cut"), F.col("cut.before").alias("before"), "gap", "all"), "cuts")
    inside = _beside(rows, first).where(b == F.col("cut")).groupBy("source", "v").agg(F.sum("size").alias("size"), F.max("before").alias("before"), F.max("gap").alias("gap"))
    inside = inside.withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("v")))
    ends = inside.groupBy("source").agg(F.min(F.when(F.col("upto") > F.col("gap"), F.col("v"))).alias("v"), F.max(F.when(F.col("upto") <= F.col("gap"), F.col("upto"))).alias("used"))
    found = first.join(ends, _same(F.col("s"), F.col("source")), "left")
    return save(found.select("s", F.when(F.col("cut").isNull(), 2.0).otherwise(F.col("v")).alias("upto"), F.when(F.col("cut").isNull(), F.col("all")).otherwise(F.coalesce("used", "before")).alias("used")), "thresholds")


def _taken(v: Column, size: Column, p) -> Column:
    """Whether the thresholds p(q0), p(g1), p(q1), ... take a document."""
    taken = v < p("q0")
    for i in range(1, FILLS + 1):
        taken = taken | ((v >= p(f"q{i - 1}")) & (size <= p(f"g{i}")) & (v < p(f"q{i}")))
    return taken


def plan_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size", weight_col: str | None = None, weights: tuple[float, ...] = WEIGHTS, seed: int = 11) -> DataFrame:
    """One row for each source: source, words, target, certain, share, and thresholds q0, q1, ... with size limits g1, ..."""
    weight = F.coalesce(F.col(weight_col).cast("double"), F.lit(1.0)) if weight_col else F.lit(1.0)
    base = save(docs.select(F.col(source_col).alias("source"), F.col(size_col).cast("long").alias("size"), _uniform(id_col, seed).alias("u"), weight.alias("weight")), "sizes")
    sizes = base.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("words"), (F.sum(F.col("size") * F.col("weight")) / F.greatest(F.sum("size"), F.lit(1).cast("long"))).alias("mean"))
    means = sizes.select(F.col("source").alias("s"), "mean")
    goal = targets(sizes.select("source", "rows", "words"), weights)
    plan = goal.join(means, _same(F.col("source"), F.col("s"))).select("source", "rows", "words", "target", "mean")
    plan = plan.withColumn("certain", F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(0).cast("int"))
    plan = plan.withColumn("gap", F.greatest(F.lit(0.0), F.col("target") - F.col("certain") * F.col("words")))
    plan = save(plan.withColumn("share", F.when(F.col("words") > 0, F.col("gap") / F.col("words")).otherwise(0.0)), "plan")
    total = base.count()
    buckets = 1 << max(4, (total.bit_length() + 1) // 2)
    rank = _rank(F.col("u"), F.col("share"), F.col("weight") / F.greatest("mean", F.lit(1e-12)))
    rows = save(_beside(base.where("size > 0"), plan.select(F.col("source").alias("s"), "share", "mean")).select("source", "size", rank.alias("v")), "ranks")
    for i in range(FILLS + 1):
        live = rows
        if i:
            limits = plan.select(F.col("source").alias("s"), F.col(f"q{i - 1}").alias("q"), "gap")
            live = _beside(rows, limits).where("v >= q and size <= gap").select("source", "size", "v")
        got = _thresholds(live, plan.select(F.col("source").alias("s"), "gap"), buckets)
        plan = _beside(plan.withColumn(f"g{i}", F.col("gap")), got, how="left").drop("s")
        plan = plan.withColumn(f"q{i}", F.coalesce("upto", F.col(f"q{i - 1}") if i else F.lit(0.0))).withColumn("gap", F.col("gap") - F.coalesce("used", F.lit(0))).drop("upto", "used")
        plan = save(plan, "plan")
    # one more document each, above the gap but nearer to the target than none
    left = plan.select(F.col("source").alias("s"), "gap", *[c for i in range(FILLS + 1) for c in (f"q{i}", f"g{i}")])
    spare = _beside(rows.where("size > 0"), left).where(~_taken(F.col("v"), F.col("size"), F.col) & (F.col("size") < 2 * F.col("gap")))
    lone = spare.groupBy("source", "size", "v").agg(F.count("*").alias("n")).where("n = 1").groupBy("source").agg(F.min(F.struct("size", "v")).alias("one"))
    lone = save(lone.select(F.col("source").alias("s"), F.col("one.size").alias("last_size"), F.col("one.v").alias("last_v")), "last")
    return save(_beside(plan, lone, how="left").drop("s"), "plan")


def with_copies(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size", weight_col: str | None = None, seed: int = 11) -> DataFrame:
    """docs with the columns mix_copies, mix_target and mix_source_size; rows, order and other columns are kept."""
    names = {c: f"__plan_{c}" for c in plan.columns}
    p = lambda c: F.col(names[c])
    weight = F.coalesce(F.col(weight_col).cast("double"), F.lit(1.0)) if weight_col else F.lit(1.0)
    v, size = _rank(_uniform(id_col, seed), p("share"), weight / F.greatest(p("mean"), F.lit(1e-12))), F.col(size_col)
    taken = _taken(v, size, p) | F.coalesce((size == p("last_size")) & (v == p("last_v")), F.lit(False))
    copies = F.when(size > 0, p("certain") + taken.cast("int")).otherwise(p("certain"))
    side = plan.select(*[F.col(c).alias(n) for c, n in names.items()])
    joined = docs.join(F.broadcast(side) if plan.count() <= BROADCAST_SOURCES else side, _same(F.col(source_col), p("source")))
    own = ("mix_copies", "mix_target", "mix_source_size")
    return joined.select(*[docs[c] for c in docs.columns if c not in own], copies.alias("mix_copies"), p("target").alias("mix_target"), p("words").alias("mix_source_size"))
