"""Candidate pairs that can score a given value by weights, found without making the others.

A score above 0 takes a common drug and a common event and no conflict, so such
a pair is in the block of every (drug, event) it shares.  It is found under its
drugs: where all reports of a drug number at most max_block_size, or those of
two neighbouring buckets do, no block of that drug with an event is oversized,
and every such pair is a candidate.  Reports of other drugs, and those with a
blank term, which has no block, meet through the blocks themselves.

Under a drug a pair is compared by bounds before it is written.  A report's terms
set bits of 64; bits that the other lacks are terms that it lacks, so the number
of shared terms is bounded, and with the least and greatest weight of a term the
weighted overlap is.  What is left is compared exactly, by `compare`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.config import FIELDS, Linkage
from caseloom.operators.blocking import KEY, _inside, _terms, all_postings, block_pairs, bucket, ranges
from caseloom.operators.features import compare, idf, sides
from caseloom.scratch import discard, save, save_all

#: Postings of drugs that are shuffled at once, about, and rows that one task compares at once.
SHARE, ROWS = 50_000_000, 200_000
#: What bounds are raised by, as similarities are rounded to single precision.
SLACK = 1e-6


def _blank(column: str) -> Column:
    return F.coalesce(F.exists(column, lambda t: F.trim(t) == ""), F.lit(False))


def _term_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct hashes of drugs and events to their numbers and bits; the drugs' hashes stay."""
    for batch in batches:
        columns = {c: batch[c] for c in batch.schema.names if c != "events"}
        for c in ("drugs", "events"):
            n = batch[c].value_lengths().to_numpy().astype(np.int64)
            bit = np.uint64(1) << (batch[c].flatten().to_numpy() % 64).astype(np.uint64)
            columns[f"m_{c}"] = pa.array(np.bitwise_or.reduceat(bit, np.cumsum(n) - n).view(np.int64) if len(n) else np.zeros(0, np.int64))
            columns[f"n_{c}"] = pa.array(n.astype(np.int32))
        yield pa.RecordBatch.from_pydict(columns)


def _short(reports: DataFrame, width: int, blank: bool) -> DataFrame:
    """Each report of some drugs and events in fixed width, but for the hashes of its drugs; blank: whether any term is."""
    told = lambda c: F.when(F.trim(c) != "", F.xxhash64(F.lower(F.trim(c)))).alias(c)
    hashes = lambda c: F.array_distinct(F.transform(F.array_compact(c), lambda t: F.xxhash64(t))).alias(c)
    loose = (_blank("drugs") | _blank("events") if blank else F.lit(False)).alias("loose")
    day = F.col("report_day")
    rows = reports.select("idx", day.cast("double").alias("day"), bucket(day, width).alias("bucket"), F.col("age").cast("double").alias("age"), told("sex"), told("seriousness"), loose, hashes("drugs"), hashes("events"))
    rows = rows.where(F.col("day").isNotNull() & (F.size("drugs") > 0) & (F.size("events") > 0))
    return rows.mapInArrow(_term_bits, "idx long, day double, bucket long, age double, sex long, seriousness long, loose boolean, drugs array<long>, m_drugs long, n_drugs int, m_events long, n_events int")


def _most_shared(n: np.ndarray, mask: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """At least as many terms as a and b share."""
    x, y = mask[a], mask[b]
    return np.minimum(n[a] - np.bitwise_count(x & ~y), n[b] - np.bitwise_count(y & ~x))


def _finder(config: Linkage, least: float, spans: dict[str, tuple[float, float]]):
    """Pairs of rows sorted by (key, day), by shifts of the rows against themselves."""
    w = {f: float(config.weights.get(f, 1.0)) for f in FIELDS} if config.weights else {f: 1.0 for f in FIELDS}
    bounded = min(w.values()) >= 0
    width = float(max(1, config.max_day_delta))

    def find(t: pa.Table) -> pa.RecordBatch:
        got = lambda c: t[c].combine_chunks()
        flat = lambda c: got(c).fill_null(0).to_numpy(zero_copy_only=False)
        known = lambda c: got(c).is_valid().to_numpy(zero_copy_only=False)
        key, idx, day, loose = flat("key"), flat("idx"), flat("day"), got("loose").to_numpy(zero_copy_only=False).astype(bool)
        own = ~known("base") | (np.floor(day / width) == flat("base"))
        value = {c: (flat(c), known(c)) for c in ("age", "sex", "seriousness")}
        size = {c: flat(c).astype(np.int64) for c in ("n_drugs", "n_events")}
        mask = {c: flat(c).view(np.uint64) for c in ("m_drugs", "m_events")}
        found: list[np.ndarray] = []
        a, step = np.arange(len(key)), 0
        while len(a):
            step += 1
            a = a[a + step < len(key)]
            b = a + step
            near = (key[a] == key[b]) & (day[b] - day[a] <= config.max_day_delta)
            a, b = a[near], b[near]
            ok = own[a] & ~(loose[a] & loose[b]) & (idx[a] != idx[b])
            (age, has_age), (sex, has_sex), (serious, has_serious) = value.values()
            both_age, both_sex, both_serious = has_age[a] & has_age[b], has_sex[a] & has_sex[b], has_serious[a] & has_serious[b]
            gap = np.abs(age[a] - age[b])
            ok &= ~(both_age & (gap > config.age_conflict_years)) & ~(both_sex & (sex[a] != sex[b]))
            p, q, both_age, both_sex, both_serious, gap = (x[ok] for x in (a, b, both_age, both_sex, both_serious, gap))
            drugs, events = _most_shared(size["n_drugs"], mask["m_drugs"], p, q), _most_shared(size["n_events"], mask["m_events"], p, q)
            ok = (drugs > 0) & (events > 0)
            if bounded and len(p):
                top = lambda s, n, span: np.where(s > 0, s * span[1] / np.maximum(s * span[1] + (n[p] + n[q] - 2 * s) * span[0], 1e-300), 0.0)  # noqa: B023, E731
                up = w["drug_jaccard"] * top(drugs, size["n_drugs"], spans["drugs"]) + w["event_jaccard"] * top(events, size["n_events"], spans["events"])
                up += w["temporal_sim"] * np.maximum(0.0, 1.0 - np.abs(day[q] - day[p]) / float(config.max_day_delta or 1))
                up += np.where(both_age, w["age_sim"] * np.maximum(0.0, 1.0 - gap / float(config.max_age_diff)), 0.0)
                up += np.where(both_sex, w["sex_match"], 0.0) + np.where(both_serious & (serious[p] == serious[q]), w["seriousness_match"], 0.0)
                den = w["drug_jaccard"] + w["event_jaccard"] + w["temporal_sim"] + np.where(both_age, w["age_sim"], 0.0) + np.where(both_sex, w["sex_match"], 0.0) + np.where(both_serious, w["seriousness_match"], 0.0)
                ok &= ~(up < (least - SLACK) * den)
            if ok.any():
                found.append(np.stack((idx[p[ok]], idx[q[ok]])))
        ends = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ends.min(axis=0)), pa.array(ends.max(axis=0))], names=["i", "j"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n < ROWS:
                continue
            t = pa.Table.from_batches(held)
            key = t["key"].to_numpy()
            first = int(np.searchsorted(key, key[-1]))  # the last key may go on
            if first:
                yield find(t.slice(0, first))
                held, n = t.slice(first).to_batches(), len(key) - first
        if held:
            yield find(pa.Table.from_batches(held))

    return run


def _through_blocks(reports: DataFrame, held: DataFrame, config: Linkage) -> Iterator[DataFrame]:
    """(i, j): the candidate pairs of two `held` reports, by the blocks of all keys that one of them has, pass by pass."""
    width = config.max_day_delta
    for low, high in ranges(reports, width):
        near = reports.where(_inside(bucket(F.col("report_day"), width), None if low is None else low - 1, None if high is None else high + 1))
        posts = all_postings(near, width)
        keys = save(posts.join(held, "idx", "left_semi").select(*KEY).distinct(), "held_keys")
        mine = save(posts.join(keys, KEY, "left_semi"), "postings")
        pairs = block_pairs(mine, config.max_block_size, width, low, high).select("i", "j").distinct()
        for end in ("i", "j"):
            pairs = pairs.join(held.select(F.col("idx").alias(end)), end, "left_semi")
        yield pairs.select("i", "j")
        discard(mine)
        discard(keys)


def likely_pairs(reports: DataFrame, weights: dict[str, DataFrame], config: Linkage, least: float) -> DataFrame:
    """(i, j): distinct candidate pairs, all that score `least` or more by the config's weights among them.

    weights: (term, df, weight) of all drugs and events; least: above 0.
    """
    most, width = config.max_block_size, config.max_day_delta
    spans, posts_n, blank = {}, {}, False
    for column, terms in weights.items():
        row = terms.agg(F.min("weight").alias("low"), F.max("weight").alias("high"), F.sum("df").alias("n"), F.max(F.trim("term") == "").alias("blank")).first()
        spans[column], posts_n[column], blank = (row.low or 0.0, row.high or 0.0), row.n or 0, blank or bool(row.blank)
    k = max(1, -(-posts_n["drugs"] // SHARE))
    # reports of a drug are at most as many as those of all its spellings together
    spelt = weights["drugs"].withColumn("as", F.xxhash64(F.lower(F.trim("term"))))
    many = spelt.groupBy("as").agg(F.sum("df").alias("n")).where(F.col("n") > most).select("as")
    big = save(spelt.join(many, "as", "left_semi").select(F.xxhash64("term").alias("key"), "as"), "big")
    plain = big.isEmpty()
    short = _short(reports, width, blank)
    short = short if k == 1 and plain and not blank else save(short, "short")
    posts = short.select(F.explode("drugs").alias("key"), *[c for c in short.columns if c != "drugs"])
    held = short.where("loose").select("idx") if blank else None
    if plain:
        members = posts.withColumn("base", F.lit(None).cast("long"))
    else:
        flagged = posts.join(big, "key", "left")
        ends = flagged.where(F.col("as").isNotNull()).drop("key").withColumnRenamed("as", "key").distinct().withColumn("base", F.explode(F.array(F.col("bucket"), F.col("bucket") - 1)))
        wide = save(ends.groupBy("key", "base").agg(F.count("*").alias("n")).where(F.col("n") > most).select("key", "base"), "wide")
        if not wide.isEmpty():
            crowd = ends.join(wide, ["key", "base"], "left_semi").select("idx")
            held = crowd if held is None else held.unionByName(crowd)
        split = ends.join(wide, ["key", "base"], "left_anti").withColumn("key", F.xxhash64("key", "base"))
        members = flagged.where(F.col("as").isNull()).withColumn("base", F.lit(None).cast("long")).drop("as").unionByName(split)
    find = _finder(config, least, spans)

    def made() -> Iterator[DataFrame]:
        for at in range(k):
            mine = members if k == 1 else members.where(F.pmod("key", F.lit(k)) == at)
            yield mine.drop("bucket").repartition("key").sortWithinPartitions("key", "day").mapInArrow(find, "i long, j long")
        if held is not None:
            yield from _through_blocks(reports, save(held.distinct(), "held"), config)

    return save_all(made(), "likely").distinct()


def compare_likely(reports: DataFrame, config: Linkage, least: float) -> DataFrame:
    """The written comparisons of all candidate pairs that score `least` or more by the config's weights, and of some others."""
    weights = {c: save(idf(reports, c), f"idf_{c}") for c in ("drugs", "events")}
    pairs = save(likely_pairs(reports, weights, config, least), "pairs")
    named = pairs.select(F.explode(F.array("i", "j")).alias("idx")).distinct()
    # written, as all three parts of `sides` read them
    side = save(sides(save(reports.join(named, "idx", "left_semi"), "named"), weights), "sides")
    return save(compare(pairs, reports, config, side), "compared")
