"""Pairs of texts whose sets of shingles have a Jaccard index of `least` or more, none left out.

All shingles have one fixed order, those seen often last.  The prefix of a set
of n shingles is the first n - ceil(least * n) + 1 of them.  Two sets of index
`least` or more share at least ceil(least * n) shingles, n the larger size, so
their prefixes have a shingle in common.  Each set is listed under the shingles
of its prefix; pairs under one shingle are sifted by two bounds that no such
pair exceeds, before they leave the join: the ratio of the sizes, and the bits
in which the parities of the sets' shingles, dealt to BITS places, differ (each
shingle of only one of the sets turns one bit, so there are at most as many as
such shingles).

`sifted` applies the second bound once more to pairs that are named, with places
in proportion to the sets: among 512 places those of large sets differ in about
half, whatever the sets, so pairs of large sets pass the first sieve.  What it
needs of a set is about a fortieth of it, so the sets themselves go with few
pairs that aren't links.

`across` makes pairs between different groups only.  Links that another way has
found leave one group of near copies under most shingles, so those give no
pairs; under the others their number can grow with the square of the members,
as each pair of members that aren't linked has to be ruled out.

The order decides how many pairs are looked at and never which are found, so it
may rest on a sample: shingles of every SHARE-th row, by a hash of its key, that
are there twice and more, KEPT of them at most.

Cases: sets without shingles are equal to each other and to no others; repeated
rows count once; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.blocks import sliced
from caseloom.llm.shingles import SET_BYTES, shingle_set, shingle_sets
from caseloom.scratch import save

#: Of so many rows one is looked at for the shingles that are seen often, and of these at most KEPT go to the tasks.
SHARE, KEPT = 16, 1 << 17
#: Places of the parities, a multiple of 64.
BITS = 512
#: Places of the parities that named pairs are sifted by: of a set, and at most (then 4 KB for each side of a pair).
LEAST_PLACES, MOST_PLACES = 64, 1 << 15
#: Added to a bound so that rounding drops no pair.
SLACK = 1e-6


def often(rows: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of the sample that are there twice and more, ascending, and how often; bounded by KEPT.

    rows: (key, text).
    """
    some = rows.where(F.pmod(F.xxhash64("key"), F.lit(SHARE)) == 0).select(F.lit(0).cast("long").alias("node"), "text")
    seen = shingle_sets(some, size).select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    seen = save(seen, "often")
    total, floor = 0, 2
    for r in seen.groupBy(F.least("n", F.lit(1000)).alias("n")).agg(F.count("*").alias("of")).orderBy(F.desc("n")).collect():
        total += r.of
        if total > KEPT:
            floor = r.n + 1
            break
    got = seen.where(F.col("n") >= floor).limit(KEPT).toArrow()
    shingles, n = got.column("shingle").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(shingles)
    return shingles[order], n[order]


def prefix(found: np.ndarray, least: float, seen: np.ndarray, n_seen: np.ndarray) -> np.ndarray:
    """The prefix of a set of shingles; the set without any has the shingle 0."""
    if not len(found):
        return np.zeros(1, np.uint64)
    first = len(found) - math.ceil(least * len(found) - SLACK) + 1
    rank = np.zeros(len(found), np.int64)
    if len(seen):
        at = np.minimum(np.searchsorted(seen, found), len(seen) - 1)
        rank = np.where(seen[at] == found, n_seen[at], 0)
    return found[np.lexsort((found, rank))[:first]]


def parity(found: np.ndarray, places: int = BITS) -> np.ndarray:
    """As many bits as there are places, as signed longs: bit i is set if an odd number of the shingles is i modulo places."""
    odd = np.bincount((found % np.uint64(places)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefixes(rows: DataFrame, size: int, least: float, seen: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(key, n, bits, prefix) of rows (key, text): the number of distinct shingles, their parities and the prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1, SET_BYTES):
            sets = [shingle_set(t.as_py(), size) for t in batch.column(1)]
            longs = pa.list_(pa.int64())
            columns = [pa.array([len(x) for x in sets], pa.int64()), pa.array([parity(x) for x in sets], longs), pa.array([prefix(x, least, *seen).view(np.int64) for x in sets], longs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["key", "n", "bits", "prefix"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.select("key", "text").mapInArrow(run, f"key {kind}, n long, bits array<long>, prefix array<long>")


def _differing(a: str, b: str) -> Column:
    """The number of bits in which two parities differ."""
    return sum((F.bit_count(F.col(a)[j].bitwiseXOR(F.col(b)[j])) for j in range(1, BITS // 64)), F.bit_count(F.col(a)[0].bitwiseXOR(F.col(b)[0])))


def across(rows: DataFrame, groups: DataFrame, size: int, least: float) -> DataFrame:
    """(a, b, a_group, b_group), a < b: all pairs of nodes of different groups that may have an index of `least` or more.

    rows: (key, text); groups: (key, node, part), the group of each node.
    """
    index = save(prefixes(rows, size, least, often(rows, size)).join(groups, "key").drop("key"), "prefixes")
    spots = index.select(F.explode("prefix").alias("spot"), "node", "part")
    mixed = spots.groupBy("spot").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("spot")
    # neither side is broadcast: Spark takes the exploded rows for as few as the rows they are made from
    under = save(spots.join(mixed.hint("merge"), "spot").distinct(), "spots")
    under = save(under.join(index.select("node", "n", "bits").dropDuplicates(["node"]).hint("merge"), "node"), "sides")
    a, b = (under.select("spot", *[F.col(c).alias(f"{s}_{c}") for c in ("node", "part", "n", "bits")]) for s in "ab")
    both = a.join(b.hint("merge"), "spot").where("a_node < b_node and a_part <> b_part")
    x, y = F.col("a_n"), F.col("b_n")
    both = both.where(F.least(x, y) + SLACK >= least * F.greatest(x, y)).where(_differing("a_bits", "b_bits") * (1 + least) <= (1 - least) * (x + y) + SLACK)
    return save(both.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"), F.col("a_part").alias("a_group"), F.col("b_part").alias("b_group")).distinct(), "across")


def places(n: int) -> int:
    """Places for the parities of a set of n shingles: the next power of two, so that the more of two can be folded to the fewer."""
    return min(MOST_PLACES, max(LEAST_PLACES, 1 << max(n - 1, 0).bit_length()))


def differing(p: bytes, q: bytes) -> int:
    """The number of bits in which the parities of two sets differ, over as many places as both have."""
    a, b = sorted((np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)), key=len)
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)))).sum())


def parities(rows: DataFrame, size: int) -> DataFrame:
    """(node, n, odd) of rows (node, text): the number of distinct shingles and their parities over places in proportion."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1, SET_BYTES):
            sets = [shingle_set(t.as_py(), size) for t in batch.column(1)]
            odd = pa.array([parity(x, places(len(x))).tobytes() for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), odd], names=["node", "n", "odd"])

    return rows.select("node", "text").mapInArrow(run, "node long, n long, odd binary")


def sifted(pairs: DataFrame, odd: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b, ...) without those that the two bounds rule out; odd: (node, n, odd)."""
    names = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = np.fromiter((differing(p.as_py(), q.as_py()) for p, q in zip(batch.column("p"), batch.column("q"))), np.int64, batch.num_rows)
            both = batch.column("x").to_numpy() + batch.column("y").to_numpy()
            yield batch.select(names).filter(pa.array(far * (1 + least) <= (1 - least) * both + SLACK))

    # neither side of a join is broadcast: both grow with the pairs
    sides = pairs.join(odd.toDF("a", "x", "p").hint("merge"), "a").join(odd.toDF("b", "y", "q").hint("merge"), "b")
    sides = sides.where(F.least("x", "y") + SLACK >= least * F.greatest("x", "y")).select(*names, "x", "y", "p", "q")
    return sides.mapInArrow(run, pairs.schema)
