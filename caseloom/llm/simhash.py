"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has one bit per hash bit, set where over half of a text's shingle
hashes (XXH64 of the UTF-8 shingle, seed 42, unsigned) have it.  Two
fingerprints that differ in at most d bits are linked.  Cut into
floor(d / 2) + 1 segments, at least one segment differs in at most one bit, so
it has a one-bit-wildcard variant in common: each distinct fingerprint is
indexed under every (segment, wildcard position, remaining bits), equal keys
are joined, and candidates are verified by counting differing bits.

A key of three or more (a group of near copies has thousands of fingerprints
around one centre) would give all pairs of its members.  Its fingerprints go
another exact way that needs no pairs, for d = 2: each emits itself and its 64
one-bit neighbours as midpoints.  Fingerprints within 2 bits share a midpoint,
and those that share one are within 2 bits, so linking every member of a
midpoint to its least member loses no connection; a midpoint has at most 65
members.

With more than one fingerprint for each text (`prints`), each of further
scrambles of the same shingle hashes, texts are linked if any of their
fingerprints are within d bits.

For a similarity instead of a number of bits, `representatives` takes the same
one-wildcard variants of all segments of several fingerprints to propose pairs,
counts the differing bits of all fingerprints, and verifies by the exact
Jaccard index.  Links between the groups so found, which no fingerprint has
proposed, come by another exact way (`prefixes.py`), so none is left out.

Cases: a null or empty text has fingerprint zero, which links like any other;
a text with fewer words than a shingle is one shingle; repeated shingles count
each time; repeated rows and equal texts have equal fingerprints; an empty
table gives an empty result; columns other than the two named are ignored.
`representatives` takes two texts without a word as equal, and of equal rows
gives their key once; ties go to the least key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.prefixes import across, parities, sifted
from caseloom.llm.shingles import shingle_hashes, shingle_sets
from caseloom.operators.components import connected_components
from caseloom.scratch import save, save_all

#: Distinct fingerprints under one key beyond which pairs are not joined directly.
CROWD = 2
#: Fingerprints of which one task makes the variants, at most.
TASK_ROWS = 50_000
#: Share of differing bits beyond which a candidate pair is not looked at; pairs at Jaccard 0.8 differ in a tenth (at most 0.152 in 3,662).
FAR = 0.18
#: Pieces in which the sets of pairs are compared, at most, and pairs from which there is one more.
PIECES, PIECE_ROWS = 8, 10_000
#: Hashes whose bits are unpacked at once.
ROWS = 1 << 15


def majority(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Fingerprints of runs of hashes; run i is hashes[bounds[i]:bounds[i + 1]]; an empty run gives zero."""
    counts = np.zeros((len(bounds) - 1, 64), np.int64)
    for at in range(0, len(hashes), ROWS):
        part = hashes[at : at + ROWS]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        first = int(np.searchsorted(bounds, at, "right")) - 1
        last = int(np.searchsorted(bounds, at + len(part), "left"))
        cut = np.clip(bounds[first : last + 1] - at, 0, len(part))
        full = np.flatnonzero(np.diff(cut) > 0)
        # a byte sum can hold 255 ones, so sums go over short groups first
        for i in full.tolist():
            rows = bits[cut[i] : cut[i + 1]]
            counts[first + i] += rows.sum(axis=0, dtype=np.uint32)
    on = counts * 2 > np.diff(bounds)[:, None]
    return np.packbits(on.astype(np.uint8), axis=1).view(">u8").ravel().astype(np.uint64)


def _scrambled(hashes: np.ndarray, j: int) -> np.ndarray:
    """The j-th family of hashes; the first are the hashes themselves."""
    if j == 0:
        return hashes
    x = hashes ^ np.uint64(0x9E3779B97F4A7C15 * j & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, prints: int = 1) -> DataFrame:
    """(id, fp0, fp1, ...): 64-bit fingerprints as signed longs, for each row of docs."""
    names = ["id", *[f"fp{j}" for j in range(prints)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes: list[np.ndarray] = []
            marks: list[list[np.ndarray]] = [[] for _ in range(prints)]
            held = 0

            def flush() -> None:
                nonlocal hashes, held
                if hashes:
                    flat, bounds = np.concatenate(hashes), np.concatenate(([0], np.cumsum([len(h) for h in hashes])))
                    for j in range(prints):
                        marks[j].append(majority(_scrambled(flat, j), bounds))
                hashes, held = [], 0

            for text in batch.column(1):
                found = np.array(shingle_hashes((text.as_py() or "").encode(), shingle), np.uint64)
                hashes.append(found)
                held += len(found)
                if held > 1 << 18:
                    flush()
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array((np.concatenate(m) if m else np.zeros(0, np.uint64)).view(np.int64)) for m in marks]], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} long" for n in names[1:]))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def variant_index(prints: DataFrame, distance: int = 2, segments: int | None = None, name: str = "fp") -> DataFrame:
    """(key, `name`): `name` under each of the one-wildcard variants of the segments of fp.

    A key packs the variant's number (segment and wildcard) above the segment's
    bits without the wildcard, so keys are equal only if both are.
    """
    segments = segments or distance // 2 + 1
    cuts = [64 * i // segments for i in range(segments + 1)]
    variants = []
    for low, high in zip(cuts, cuts[1:]):
        part = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit(_signed((1 << (high - low)) - 1)).cast("long"))
        variants += [part.bitwiseAND(F.lit(_signed(((1 << 64) - 1) ^ (1 << bit))).cast("long")) + F.lit((len(variants) + bit) << 32) for bit in range(high - low)]
    return prints.select(F.explode(F.array(*variants)).alias("key"), name)


def _under(index: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of the index under the keys.

    Neither side is broadcast: Spark takes an index for as large as the table
    it is made from, which it is 64 times and more.
    """
    return index.join(keys.hint("merge"), "key")


def _spread(prints: DataFrame) -> DataFrame:
    """The rows dealt to enough tasks for each to be taken 64 times."""
    n = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), prints.count() // TASK_ROWS + 1)
    return prints.repartition(n)


def links(prints: DataFrame, distance: int = 2, crowd: int = CROWD) -> DataFrame:
    """(src, dst): links between distinct fingerprints whose components are those of "at most `distance` bits differ".

    prints: a column fp without repeats.  Keys that hold one fingerprint are
    dropped after a count that is pre-aggregated before its shuffle.
    """
    index = variant_index(_spread(prints), distance)
    counts = index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = save(_under(index, counts).select("key", "fp", "n"), "variants")
    calm = shared.where(F.col("n") <= crowd).select("key", "fp")
    if crowd <= 2:
        found = calm.groupBy("key").agg(F.min("fp").alias("src"), F.max("fp").alias("dst")).select("src", "dst")
    else:
        found = calm.withColumnRenamed("fp", "src").join(calm.withColumnRenamed("fp", "dst"), "key").select("src", "dst")
    found = found.where(F.col("src") < F.col("dst")).where(F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= distance)
    crowded = save(shared.where(F.col("n") > crowd).select("fp").distinct(), "crowded")
    return found.unionByName(_through_midpoints(_spread(crowded), distance)).distinct()


def _through_midpoints(prints: DataFrame, distance: int) -> DataFrame:
    """Links of distinct fingerprints by shared neighbours, without pairs within a group.

    At distance 2 a midpoint is any value within one bit; at distance 1 it must
    be one of the fingerprints.  A midpoint gathers at most 65 fingerprints.
    """
    flips = F.array(*[F.lit(x).cast("long") for x in [0] + [_signed(1 << i) for i in range(64)]])
    spots = prints.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
    near = spots.groupBy("mid").agg(F.array_sort(F.collect_set("fp")).alias("all")).where("size(all) > 1")
    if distance == 1:
        near = near.where(F.array_contains("all", F.col("mid")))
    return near.select(F.col("all")[0].alias("src"), F.explode(F.slice("all", 2, 65)).alias("dst")) if distance == 2 else near.select(F.explode("all").alias("src"), F.col("mid").alias("dst")).where("src <> dst")


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2, prints: int = 1) -> tuple[DataFrame, DataFrame]:
    """(id, fp0, ..., node) for each row, and (node, least, part) for each distinct node, least being its least id.

    Nodes of one part are connected over links of at most `distance` bits.
    """
    if distance not in (1, 2):
        raise ValueError("distance must be 1 or 2")
    names = [f"fp{j}" for j in range(prints)]
    marks = save(fingerprints(docs, id_col, text_col, shingle, prints), "fingerprints")
    groups = marks.groupBy(*names).agg(F.min("id").alias("least"))
    # numbers hold once written; with one fingerprint it names itself
    groups = save(groups.withColumn("node", F.col("fp0") if prints == 1 else F.monotonically_increasing_id()), "distinct_fingerprints")
    marks = marks.withColumn("node", F.col("fp0")) if prints == 1 else save(marks.join(groups.drop("least"), names), "numbered")
    edges = None
    for name in names:
        if prints == 1:
            found = links(groups.select(F.col(name).alias("fp")), distance)
        else:
            heads = save(groups.groupBy(F.col(name).alias("fp")).agg(F.min("node").alias("head")), "heads")
            far = save(links(heads.select("fp"), distance), "links")
            far = far.join(heads.select(F.col("fp").alias("src"), F.col("head").alias("a")), "src").join(heads.select(F.col("fp").alias("dst"), F.col("head").alias("b")), "dst").select("a", "b")
            same = groups.select(F.col(name).alias("fp"), F.col("node").alias("a")).join(heads, "fp").select("a", F.col("head").alias("b"))
            # written one by one, so that no plan holds the links of all fingerprints
            found = save(far.unionByName(same).where("a <> b").toDF("src", "dst"), "node_links")
        edges = found if edges is None else edges.unionByName(found)
    parts = connected_components(edges)
    return marks, groups.join(parts, groups["node"] == parts["node"], "left").select(groups["node"], "least", F.coalesce("component", groups["node"]).alias("part"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2, prints: int = 1) -> DataFrame:
    """(id, fp, component): component is the least id reachable over links of at most `distance` bits.

    fp is the first fingerprint.
    """
    marks, named = linked(docs, id_col, text_col, shingle, distance, prints)
    heads = named.groupBy("part").agg(F.min("least").alias("component"))
    classes = named.join(heads, "part").select("node", "component")
    return marks.join(classes, "node").select("id", F.col("fp0").alias("fp"), "component")


def candidates(nodes: DataFrame, prints: int, far: float = FAR) -> DataFrame:
    """(a, b), a < b: nodes that share a one-wildcard variant of a 32-bit segment and differ in at most `far` of all bits.

    nodes: (node, fp0, ...).  Under each key every node meets the least one, so
    a key gives as many pairs as nodes, never their square.  Nodes of one group
    share many keys with other least nodes, so the links between them hold
    together.
    """
    nodes = _spread(nodes.select("node", *[f"fp{j}" for j in range(prints)]))
    met = []
    for j in range(prints):  # written one by one, so that the variants of one fingerprint at a time are shuffled
        index = variant_index(nodes.select("node", F.col(f"fp{j}").alias("fp")), segments=2, name="node")
        heads = index.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a < last").select("key", "a")
        pairs = _under(index.withColumnRenamed("node", "b"), heads).where("a < b")
        met.append(save(pairs.select("a", "b").distinct(), "met"))
    found = met[0]
    for more in met[1:]:
        found = found.unionByName(more)
    sides = [nodes.select(F.col("node").alias(side), F.array(*[f"fp{j}" for j in range(prints)]).alias(f"{side}_bits")) for side in "ab"]
    bits = sum((F.bit_count(F.col("a_bits")[j].bitwiseXOR(F.col("b_bits")[j])) for j in range(1, prints)), F.bit_count(F.col("a_bits")[0].bitwiseXOR(F.col("b_bits")[0])))
    # as in _under, neither side is broadcast: Spark takes an array for one number
    return save(found.distinct().join(sides[0].hint("merge"), "a").join(sides[1].hint("merge"), "b").where(bits <= int(64 * prints * far)).select("a", "b"), "candidates")


def similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b, ...) whose sets have a Jaccard index of `least` or more; two empty sets are equal.

    sets: (node, n, shingles).
    """
    both = F.size(F.array_intersect("p", "q"))
    found = pairs.join(sets.toDF("a", "x", "p"), "a").join(sets.toDF("b", "y", "q"), "b")
    return found.where(F.least("x", "y") >= least * F.greatest("x", "y")).where(both >= least * (F.col("x") + F.col("y") - both)).select(*pairs.columns)


def representatives(rows: DataFrame, least: float = 0.8, size: int = 5, shingle: int = 2, prints: int = 6) -> DataFrame:
    """(key): the least key of every group of near copies, and of every text that is alone.

    rows: (key, text), key a struct that names a row; equal keys have equal
    texts.  Texts are linked if their Jaccard index on distinct shingles of
    `size` words is `least` or more; a group is what links connect.
    Fingerprints of runs of `shingle` words only propose pairs: fewer words
    than `size`, as a changed word changes fewer of those.  Between the groups
    that these make, all further links are found by common shingles.  Equal texts
    meet before, by a 128-bit hash, so copies cost no more than one row each.
    """
    spark = rows.sparkSession
    names = [f"fp{j}" for j in range(prints)]
    body = F.struct(F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("i"))
    marks = save(fingerprints(rows.select(F.struct("key", body.alias("body")).alias("id"), "text"), "id", "text", shingle, prints), "marks")
    texts = marks.groupBy("id.body").agg(F.min(F.struct("id.key", *names)).alias("first")).select("first.*")
    # numbered in the order of keys; numbers hold once written
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    nodes = save(texts.repartitionByRange(parts, "key").sortWithinPartitions("key").select(F.monotonically_increasing_id().alias("node"), "key", *names), "nodes")
    near = _near(candidates(nodes, prints), rows, nodes, size, least)
    parts_of = save(connected_components(_verified(near, rows, nodes, size, least), "a", "b").where("node <> component"), "parts")
    groups = nodes.join(parts_of, "node", "left").select("key", "node", F.coalesce("component", "node").alias("part"))
    near = _near(across(rows, groups, size, least), rows, nodes, size, least)
    more = connected_components(_verified(near, rows, nodes, size, least), "a_group", "b_group").where("node <> component")
    return nodes.join(parts_of, "node", "left_anti").join(more, "node", "left_anti").select("key")


def _texts(pairs: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the nodes in pairs (a, b, ...), a row for each row of a node's key."""
    wanted = save(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "key").hint("merge"), "node"), "wanted")
    return rows.join(wanted, "key").select("node", "text")


def _near(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, size: int, least: float) -> DataFrame:
    """The pairs (a, b, ...) of nodes that may have a Jaccard index of `least` or more, by parities of their shingles."""
    odd = save(parities(_texts(pairs, rows, nodes), size).dropDuplicates(["node"]), "parities")
    return save(sifted(pairs, odd, least), "near")


def _verified(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, size: int, least: float) -> DataFrame:
    """The pairs (a, b, ...) of nodes whose texts have a Jaccard index of `least` or more."""
    sets = save(shingle_sets(_texts(pairs, rows, nodes), size).dropDuplicates(["node"]), "shingles")
    # one piece after the other, so that the sets that go with the pairs of one piece at a time are shuffled; by b, whose sets so take part in one piece each
    n = min(PIECES, pairs.count() // PIECE_ROWS + 1)
    return save_all((similar(pairs.where(F.pmod(F.xxhash64("b"), F.lit(n)) == i), sets, least) for i in range(n)), "similar")
