"""Candidate pairs: a union of selective equi-joins with a band on the day.

A posting is (family, a, b, bucket, idx, day).  For pairing, its key is two
64-bit hashes of (family, a, b), which sort and shuffle faster than strings.  A
block is a bucket that has members together with the next bucket; those of more
than max_block_size members give no pairs.  Blocks that hold more than one in
HOT of all memberships are found by counts that are pre-aggregated before their
shuffle, and their postings left out before any other; one shuffle then counts
and gathers the members of every other block.  So hot terms never meet, and a
block gives at most max_block_size^2 / 2 rows.

Many reports are taken in passes, so that what is shuffled at once has a bound.
A pass makes the pairs whose earlier report is in its range of buckets, from
the reports of these and the next bucket and, to count blocks, the one before.
So every pair comes from one pass, whatever number of blocks hold it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.config import Linkage
from caseloom.scratch import discard, save, save_all

KEY = ["h1", "h2"]
AT = [*KEY, "base"]
#: One in how many of all memberships a block must hold to be left out before the shuffle.
HOT = 10_000
#: Slots that memberships are counted in first.
SLOTS = 1 << 16
#: Reports of a pass, about, and postings whose keys are counted at once.
PASS, KEYS_AT_ONCE = 400_000, 50_000_000


def bucket(day: Column, width: int) -> Column:
    return F.floor(day / F.lit(float(max(1, width)))).cast("bigint")


def _terms(column: str) -> Column:
    return F.array_distinct(F.filter(F.transform(column, lambda t: F.lower(F.trim(t))), lambda t: t != ""))


def _keyed(reports: DataFrame, width: int, families: tuple[str, ...]) -> DataFrame:
    """(family, a, b, bucket, idx, day) of the families, in one pass over the reports."""
    sex = F.coalesce(F.nullif(F.lower(F.trim("sex")), F.lit("")), F.lit("_na_"))
    known = lambda c: F.coalesce(_terms(c), F.array().cast("array<string>")).alias(c)
    base = reports.select("idx", F.col("report_day").alias("day"), bucket(F.col("report_day"), width).alias("bucket"), known("drugs"), known("events"), sex.alias("sex"))
    key = lambda family, a, b: F.struct(F.lit(family).alias("family"), a.alias("a"), b.alias("b"))
    keys = {
        "de": F.flatten(F.transform("drugs", lambda d: F.transform("events", lambda e: key("de", d, e)))),
        "ds": F.transform("drugs", lambda d: key("ds", d, F.col("sex"))),
        "es": F.transform("events", lambda e: key("es", e, F.col("sex"))),
    }
    return base.select(F.explode(F.concat(*[keys[f] for f in families])).alias("key"), "bucket", "idx", "day").select("key.*", "bucket", "idx", "day")


def postings(reports: DataFrame, family: str, width: int = 90) -> DataFrame:
    """Postings of one key family: de (drug, event), ds (drug, sex), es (event, sex)."""
    return _keyed(reports, width, (family,))


def all_postings(reports: DataFrame, width: int = 90) -> DataFrame:
    """(h1, h2, bucket, idx, day): the postings of all families by hashed key."""
    hashed = _keyed(reports, width, ("de", "ds", "es"))
    return hashed.select(F.xxhash64("family", "a", "b").alias("h1"), F.xxhash64("b", "family", "a", F.lit(1)).alias("h2"), "bucket", "idx", "day")


def _at_bases(posts: DataFrame) -> DataFrame:
    """Each posting at the two blocks that it can be a member of."""
    return posts.select(*KEY, F.explode(F.array(F.col("bucket"), F.col("bucket") - 1)).alias("base"), "bucket", "idx", "day")


def blocks(posts: DataFrame) -> DataFrame:
    """(h1, h2, base, n): every bucket with members, and the number of members of it and the next."""
    counted = _at_bases(posts).groupBy(*AT).agg(F.count("*").alias("n"), F.max(F.col("bucket") == F.col("base")).alias("own"))
    return counted.where("own").select(*AT, "n")


def hot_blocks(posts: DataFrame, most: int) -> DataFrame:
    """(h1, h2, base): blocks of more than `most` members and more than one in HOT of all memberships, so fewer than HOT.

    Memberships are counted in SLOTS slots by hash; only blocks of slots beyond
    that size, again fewer than HOT, are counted themselves.
    """
    least = max(most, 2 * posts.count() // HOT)
    ends = _at_bases(posts).select(*AT, F.pmod(F.xxhash64(*AT), F.lit(SLOTS)).alias("slot"))
    slots = ends.groupBy("slot").agg(F.count("*").alias("n")).where(F.col("n") > least).select("slot")
    return ends.join(F.broadcast(slots), "slot", "left_semi").groupBy(*AT).agg(F.count("*").alias("n")).where(F.col("n") > least).select(*AT)


def _inside(b: Column, low: int | None, high: int | None) -> Column:
    """Whether a bucket is `low` or later and before `high`; None is no bound."""
    return (F.lit(True) if low is None else b >= low) & (F.lit(True) if high is None else b < high)


def block_pairs(posts: DataFrame, most: int, max_day_delta: int, low: int | None = None, high: int | None = None) -> DataFrame:
    """(h1, h2, base, i, j) of members of blocks of at most `most`, within the day band; a pair can come from several blocks.

    Of the pairs, those whose earlier report is in the buckets from `low` to
    before `high`; posts must hold all of one bucket before to one after.
    """
    ends = _at_bases(posts)
    if (low, high) != (None, None):
        ends = ends.where(_inside(F.col("base"), None if low is None else low - 1, high))
    members = ends.join(F.broadcast(save(hot_blocks(posts, most), "hot")), AT, "left_anti")
    # most members are alone; they go before members are gathered, which takes no further shuffle
    block = Window.partitionBy(*AT)
    members = members.withColumns({"n": F.count("*").over(block), "own": F.max(F.col("bucket") == F.col("base")).over(block)})
    gathered = members.where("own").where(F.col("n").between(2, most)).groupBy(*AT).agg(F.collect_list(F.struct("idx", "day")).alias("all"))
    each = gathered.select(*AT, "all", F.explode("all").alias("x"))
    earlier = lambda y: _inside(bucket(F.least(y["day"], F.col("x.day")), max_day_delta), low, high)
    near = F.filter("all", lambda y: (y["idx"] > F.col("x.idx")) & (F.abs(y["day"] - F.col("x.day")) <= max_day_delta) & earlier(y))
    return each.select(*AT, F.col("x.idx").alias("i"), F.explode(near["idx"]).alias("j"))


@dataclass(frozen=True)
class Part:
    """Candidate pairs whose earlier report is in the buckets from `low` to before `high`; None is no bound."""

    pairs: DataFrame
    low: int | None = None
    high: int | None = None

    def near(self, rows: DataFrame, width: int) -> DataFrame:
        """Of rows with a report_day, those that its pairs can name."""
        return rows.where(_inside(bucket(F.col("report_day"), width), self.low, None if self.high is None else self.high + 1))


def ranges(reports: DataFrame, width: int) -> list[tuple[int | None, int | None]]:
    """Bounds of the passes, from None to None: whole buckets, of about PASS reports each."""
    k = -(-reports.count() // PASS)
    if k <= 1:
        return [(None, None)]
    at = F.percentile_approx(bucket(F.col("report_day"), width), [x / k for x in range(1, k)], 100_000)
    cuts = sorted(set(reports.agg(at.alias("at")).first().at or ()))
    return list(zip([None, *cuts], [*cuts, None]))


def _postings_of(reports: DataFrame, config: Linkage, low: int | None, high: int | None) -> DataFrame:
    """The written postings that a pass takes."""
    width = config.max_day_delta
    if (low, high) != (None, None):
        reports = reports.where(_inside(bucket(F.col("report_day"), width), None if low is None else low - 1, None if high is None else high + 1))
    return save(all_postings(reports, width), "postings")


def parts(reports: DataFrame, config: Linkage = Linkage(), keep: bool = False) -> Iterator[Part]:
    """All distinct candidate pairs, without the cap on their number, pass by pass.

    The pairs of a pass are written; unless `keep`, they go when the next pass is asked for.
    """
    for low, high in ranges(reports, config.max_day_delta):
        posts = _postings_of(reports, config, low, high)
        pairs = block_pairs(posts, config.max_block_size, config.max_day_delta, low, high).select("i", "j").distinct()
        part = Part(save(pairs, "pairs"), low, high)
        discard(posts)
        yield part
        if not keep:
            discard(part.pairs)


def together(found: list[Part]) -> DataFrame:
    """The pairs of all parts, read as one table."""
    return found[0].pairs.sparkSession.read.schema("i long, j long").parquet(*sorted({f.rpartition("/")[0] for x in found for f in x.pairs.inputFiles()}))


def candidate_pairs(reports: DataFrame, config: Linkage = Linkage()) -> DataFrame:
    """(i, j): distinct candidate pairs, without the cap on their number."""
    return together(list(parts(save(reports, "reports"), config, keep=True)))


@dataclass(frozen=True)
class Blocking:
    """Pairs with the run's counts and the warnings they give rise to; the parts hold the same pairs."""

    pairs: DataFrame
    stats: dict[str, int]
    warnings: tuple[str, ...]
    parts: tuple[Part, ...] = ()


def _counts(reports: DataFrame, config: Linkage) -> tuple[int, int]:
    """The number of keys, and of blocks of more than max_block_size reports."""
    every, skipped, posts_n = save(reports, "reports"), 0, 0
    for low, high in ranges(every, config.max_day_delta):
        posts = _postings_of(every, config, low, high)
        found = blocks(posts).where(_inside(F.col("base"), low, high)).agg(F.count_if(F.col("n") > config.max_block_size).alias("over"), F.sum("n").alias("n"))
        over = save(found, "counts").first()
        skipped, posts_n = skipped + over.over, posts_n + (over.n or 0)
        discard(posts)
    # a key has blocks in many ranges; keys are counted by shares of their hashes
    k = posts_n // (2 * KEYS_AT_ONCE) + 1
    keys = all_postings(every, config.max_day_delta).where(F.col("bucket").isNotNull()).select(*KEY)
    shares = (keys.where(F.pmod("h1", F.lit(k)) == at).distinct().agg(F.count("*").alias("n")) for at in range(k))
    return save_all(shares, "keys").agg(F.sum("n").alias("n")).first().n, skipped


def block_reports(reports: DataFrame, config: Linkage = Linkage(), whole: bool = False) -> Blocking:
    """Candidate pairs in the shared folder; unless `whole`, capped at max_pairs plus what one block adds.

    Beyond the cap whole blocks are kept in an order that hashes their keys, so
    reruns agree; the flag and a warning say that the result is incomplete.
    """
    n_keys, skipped = _counts(reports, config)
    found = tuple(parts(reports, config, keep=True))
    pairs = together(list(found))
    n_pairs = pairs.count()
    truncated = not whole and n_pairs > config.max_pairs
    if truncated:
        posts = save(all_postings(reports, config.max_day_delta), "postings")
        pairs = save(_first_blocks(posts, config), "pairs")
        n_pairs, found = pairs.count(), (Part(pairs),)
    stats = {"n_reports": reports.count(), "n_blocks": n_keys, "n_candidate_pairs": n_pairs, "skipped_oversized_blocks": skipped, "truncated": int(truncated)}
    said = []
    if truncated:
        said.append(f"Candidate pairs passed the cap of {config.max_pairs:,}; pairs of further blocks are missing, so recall is unknown. Use a smaller day window or block size, or more selective keys.")
    if n_keys and skipped / n_keys > 0.05:
        said.append(f"{skipped:,} blocks ({skipped / n_keys:.1%}) hold more than {config.max_block_size} reports and were left out.")
    return Blocking(pairs, stats, tuple(said), found)


def _first_blocks(posts: DataFrame, config: Linkage) -> DataFrame:
    """Pairs of blocks in hash order while those before number at most max_pairs."""
    order = F.pmod(F.xxhash64(*KEY, "base"), F.lit(1 << 16)).cast("int")
    each = block_pairs(posts, config.max_block_size, config.max_day_delta).withColumn("slot", order)
    # a pair counts where it comes first; slots are few, so their running total is small
    first = save(each.groupBy("i", "j").agg(F.min(F.struct("slot", *KEY, "base")).alias("at")), "first_blocks")
    slots = first.groupBy("at.slot").agg(F.count("*").alias("n"))
    run = slots.withColumn("upto", F.sum("n").over(Window.orderBy("slot")))
    cut = run.where(F.col("upto") > config.max_pairs).agg(F.min("slot").alias("slot"), F.min(F.col("upto") - F.col("n")).alias("before")).first()
    inside = first.where(F.col("at.slot") == cut.slot).groupBy("at").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(Window.orderBy("at")) + cut.before)
    more = inside.where(F.col("upto") - F.col("n") <= config.max_pairs).select("at")
    whole = first.where(F.col("at.slot") < cut.slot).select("i", "j")
    return whole.unionByName(first.join(more, "at", "left_semi").select("i", "j"))
