import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from caseloom.llm import simhash


def brute_print(text, k):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints, d):
    parent = {i: i for i, _ in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in prints:
        for j, b in prints:
            if i < j and (a ^ b).bit_count() <= d:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in prints}


def unsigned(x):
    return x % (1 << 64)


def test_whole_query_matches_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["Über", "THE", "a"]
    texts = [None, "", " \t\n", "one", "One", "two words", "a b c", "A b c d"]
    base = [rng.choice(words) for _ in range(120)]
    for _ in range(60):
        near = list(base)
        for _ in range(rng.randrange(3)):
            near[rng.randrange(len(near))] = rng.choice(words)
        texts.append(" ".join(near))
    texts += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(60)] + texts[8:14]
    rows = [(i, t, "x", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, id long")
    got = {r.id: (unsigned(r.fp), r.component) for r in simhash.near_duplicates(docs).collect()}
    prints = [(i, brute_print(t, 3)) for i, t in enumerate(texts)]
    groups = brute_components(prints, 2)
    assert got == {i: (p, groups[i]) for i, p in prints}


def test_crowded_keys_lose_no_link(spark):
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(50)}
    for _ in range(4):
        x = rng.getrandbits(64)
        for _ in range(60):  # long chains of one- and two-bit steps
            x ^= 1 << rng.randrange(64)
            if rng.random() < 0.5:
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints], "fp long")
    for distance in (1, 2):
        want = brute_components([(x, x) for x in prints], distance)
        for crowd in (1, 4, 1000):
            found = [(unsigned(r.src), unsigned(r.dst)) for r in simhash.links(df, distance, crowd).collect()]
            assert all((a ^ b).bit_count() <= distance for a, b in found)
            parent = {x: x for x in prints}

            def find(x):
                while parent[x] != x:
                    x = parent[x]
                return x

            for a, b in found:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
            assert {x: find(x) for x in prints} == want


def test_majority_over_long_runs():
    rng = np.random.default_rng(1)
    sizes = [0, 1, 70_000, 0, 3]
    hashes = rng.integers(0, 1 << 63, sum(sizes), dtype=np.uint64)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    got = simhash.majority(hashes, bounds)
    for i in range(len(sizes)):
        part = hashes[bounds[i] : bounds[i + 1]]
        want = sum(1 << b for b in range(64) if int(((part >> np.uint64(b)) & np.uint64(1)).sum()) * 2 > len(part))
        assert int(got[i]) == want


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    twice = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (5, None)], "doc_id long, text string")
    got = simhash.near_duplicates(twice).collect()
    assert sorted((str(r.id), r.component) for r in got) == [("1", 1), ("1", 1), ("5", 5), ("None", 1)]


def test_registered_query_matches_brute_force(spark, tmp_path):
    from caseloom.llm.queries import op10_simhash

    rng = random.Random(12)
    words = [f"w{i}" for i in range(60)]
    base = [rng.choice(words) for _ in range(400)]
    texts = [None, "", "one", "two words"]
    for _ in range(150):
        near = list(base)
        for _ in range(rng.randrange(4)):
            near[rng.randrange(len(near))] = rng.choice(words)
        texts.append(" ".join(near))
    rows = [(3 * i + 5, t, "x") for i, t in enumerate(texts)] + [(2, texts[9], "x")]
    spark.createDataFrame(rows, "doc_id long, text string, component_id string").write.parquet(f"{tmp_path}/documents.parquet")
    prints = [(i, brute_print(t, 3)) for i, t, _ in rows]
    groups = brute_components(prints, 2)
    assert 1 < len(set(groups.values())) < 60
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in op10_simhash(spark, str(tmp_path)).collect()} == {(i, f"{p:016x}", groups[i]) for i, p in prints}


def test_variants_are_never_broadcast(spark):
    """A table of a few MB has variants that no driver of 1 GB can hold."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    index = simhash.variant_index(spark.range(200).select(F.xxhash64("id").alias("fp")))
    counts = index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    for one, two in ((index, counts), (index, counts.limit(5))):
        assert "Broadcast" not in simhash._under(one, two)._jdf.queryExecution().executedPlan().toString()
    assert simhash._under(index, counts).count() == index.join(counts, "key").count()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_the_variants_that_candidates_join_are_never_broadcast(spark, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    plans = []

    def saved(df, name):
        if name == "met":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(simhash, "save", saved)
    nodes = spark.range(200).select(F.col("id").alias("node"), F.xxhash64("id").alias("fp0"), F.xxhash64("id", "id").alias("fp1"))
    simhash.candidates(nodes, 2)
    assert len(plans) == 2 and not any("Broadcast" in p for p in plans)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_the_fingerprints_that_candidates_are_measured_by_are_never_broadcast(spark, tmp_path, monkeypatch):
    """Spark takes their array for one number, so they are larger than they look."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    plans = {}

    def saved(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return df

    spark.range(200).select(F.col("id").alias("node"), F.xxhash64("id").alias("fp0"), F.xxhash64("id", "id").alias("fp1")).write.parquet(f"{tmp_path}/nodes")
    monkeypatch.setattr(simhash, "save", saved)
    simhash.candidates(spark.read.parquet(f"{tmp_path}/nodes"), 2)
    assert "Broadcast" not in plans["candidates"]
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
