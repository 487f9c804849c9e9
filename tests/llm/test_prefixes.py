import random

import numpy as np
from pyspark.sql import functions as F

from caseloom.llm import simhash


def shingles(text):
    return set(simhash.shingle_hashes((text or "").encode(), 5))


def index(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def keyed(spark, texts):
    return spark.createDataFrame([((i, i), t) for i, t in enumerate(texts)], "key struct<doc_id:long,row:long>, text string")


def edges_near_the_threshold(rng, n):
    """Pairs of texts of all lengths with an index just above or below 0.8, each pair of words of its own."""
    texts = []
    for i in range(n):
        base = [f"p{i}w{rng.randrange(400)}" for _ in range(rng.randrange(25, 200))]
        near = list(base)
        for at in rng.sample(range(len(base)), max(1, round(len(base) * rng.choice([0.018, 0.021, 0.024])))):
            near[at] = f"p{i}x{at}"
        texts += [" ".join(base), " ".join(near)]
    return texts


def test_no_link_between_different_texts_is_left_out(spark):
    texts = edges_near_the_threshold(random.Random(3), 1200)
    sets = [shingles(t) for t in texts]
    linked = {2 * i for i in range(1200) if index(sets[2 * i], sets[2 * i + 1]) >= 0.8}
    assert 300 < len(linked) < 1100
    got = {r.key.doc_id for r in simhash.representatives(keyed(spark, texts)).collect()}
    assert got == set(range(2400)) - {i + 1 for i in linked}


def test_pairs_across_groups_hold_all_links_and_few_others(spark):
    from caseloom.llm import prefixes

    rng = random.Random(5)
    line = [f"line{i}" for i in range(40)]  # in half of the texts, most of a few
    texts = edges_near_the_threshold(rng, 180)
    texts = [" ".join([*line, t]) if i % 4 < 2 else t for i, t in enumerate(texts)]
    texts += [" ".join([*line, *(f"z{i}{j}" for j in range(8))]) for i in range(40)]
    texts += ["", None, " \n", "one", "one two", "One", "a b c d e f"]
    sets = [shingles(t) for t in texts]
    rows = keyed(spark, texts)
    parts = [i - i % 3 for i in range(len(texts))]
    groups = rows.select("key", F.col("key.doc_id").alias("node"), (F.col("key.doc_id") - F.col("key.doc_id") % 3).alias("part"))
    got = [tuple(r) for r in prefixes.across(rows.unionByName(rows.limit(9)), groups, 5, 0.8).collect()]
    assert len(got) == len(set(got)) and all(a < b and parts[a] == x != y == parts[b] for a, b, x, y in got)
    wanted = {(a, b) for b in range(len(texts)) for a in range(b) if parts[a] != parts[b] and index(sets[a], sets[b]) >= 0.8}
    found = {(a, b) for a, b, _, _ in got}
    assert wanted <= found and len(wanted) > 20
    assert len(found) < 2 * len(wanted) + 40  # the 780 pairs that share the line alone are sifted out
    assert prefixes.across(rows.limit(0), groups.limit(0), 5, 0.8).count() == 0


def test_bounds_hold_for_any_order_and_size():
    from caseloom.llm import prefixes

    rng = np.random.default_rng(2)
    for n in [1, 2, 4, 5, 9, 10, 31, 200, 1000]:
        for _ in range(40):
            whole = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            a = np.unique(whole[:n])
            b = np.unique(np.concatenate([a[: n - int(rng.integers(0, n // 5 + 1))], whole[n : n + int(rng.integers(0, n // 5 + 1))]]))
            seen = np.unique(rng.choice(whole, n))
            order = (seen, rng.integers(2, 50, len(seen)))
            if index(set(a.tolist()), set(b.tolist())) >= 0.8:
                assert np.intersect1d(prefixes.prefix(a, 0.8, *order), prefixes.prefix(b, 0.8, *order)).size
                differ = np.bitwise_count((prefixes.parity(a) ^ prefixes.parity(b)).view(np.uint64)).sum()
                assert differ <= len(np.setxor1d(a, b)) and differ * 1.8 <= 0.2 * (len(a) + len(b)) + prefixes.SLACK
    assert prefixes.prefix(np.zeros(0, np.uint64), 0.8, *order).tolist() == [0]


def test_a_sample_orders_shingles_that_are_often_seen_last(spark):
    from caseloom.llm import prefixes

    line = " ".join(f"line{i}" for i in range(6))
    seen, n = prefixes.often(keyed(spark, [f"{line} own{i} x{i} y{i} z{i} v{i}" for i in range(400)]), 5)
    assert set(seen.tolist()) == shingles(line) and np.all(n > 1)
    own = np.unique(np.array([*shingles(f"{line} own"), 5, 6, 7], np.uint64))
    assert set(prefixes.prefix(own, 0.5, seen, n).tolist()) >= {5, 6, 7}


def test_pairs_are_verified_in_pieces(spark, monkeypatch):
    texts = edges_near_the_threshold(random.Random(7), 40)
    rows, made = keyed(spark, texts), []
    nodes = rows.select(F.col("key.doc_id").alias("node"), "key")
    pairs = spark.createDataFrame([(2 * i, 2 * i + 1, i) for i in range(40)], "a long, b long, more long")
    monkeypatch.setattr(simhash, "PIECE_ROWS", 10)
    similar = simhash.similar
    monkeypatch.setattr(simhash, "similar", lambda *x: made.append(1) or similar(*x))
    got = {tuple(r) for r in simhash._verified(pairs, rows, nodes, 5, 0.8).collect()}
    assert len(made) == 5
    assert got == {(2 * i, 2 * i + 1, i) for i in range(40) if index(shingles(texts[2 * i]), shingles(texts[2 * i + 1])) >= 0.8}


def test_large_texts_that_share_a_passage_are_ruled_out_before_their_sets_are_compared(spark, monkeypatch):
    rng = random.Random(11)
    line = [f"line{i}" for i in range(150)]
    texts = [" ".join([*line, *(f"t{i}w{rng.randrange(5000)}" for _ in range(1350))]) for i in range(40)]
    texts += [" ".join([*t.split()[:-9], *(f"new{i}x{j}" for j in range(9))]) for i, t in enumerate(texts[:10])]
    from caseloom.llm import prefixes

    monkeypatch.setattr(prefixes, "often", lambda *x: (np.zeros(0, np.uint64), np.zeros(0, np.int64)))  # so that the passage is in the prefixes
    compared, similar = [], simhash.similar
    monkeypatch.setattr(simhash, "similar", lambda pairs, *x: compared.append(pairs.count()) or similar(pairs, *x))
    got = {r.key.doc_id for r in simhash.representatives(keyed(spark, texts)).collect()}
    assert got == set(range(40))
    assert 10 <= sum(compared) < 40  # not the 1,225 pairs that share the passage


def test_parities_in_proportion_rule_out_no_link(spark):
    from caseloom.llm import prefixes

    texts = edges_near_the_threshold(random.Random(13), 150)
    texts += [" ".join(f"w{i}" for i in range(n)) for n in (4, 5, 6, 66, 68, 69, 80, 132, 133, 160, 258, 260, 261, 310)]  # their sets cross powers of two
    texts += ["", None, " \n", "one", "One", "a b c d e f"]
    sets = [shingles(t) for t in texts]
    pairs = {(a, b, a % 3) for b in range(len(texts)) for a in range(b) if b == a + 1 or a >= 300}
    odd = prefixes.parities(keyed(spark, texts).select(F.col("key.doc_id").alias("node"), "text"), 5)
    frame = spark.createDataFrame(sorted(pairs), "a long, b long, more long")
    got = {tuple(r) for r in prefixes.sifted(frame, odd, 0.8).collect()}
    linked = {p for p in pairs if index(sets[p[0]], sets[p[1]]) >= 0.8}
    assert linked <= got <= pairs and len(linked) > 60 and len(got) < len(pairs) - 150
    assert prefixes.sifted(frame.limit(0), odd, 0.8).columns == ["a", "b", "more"]
    assert prefixes.sifted(frame.limit(0), odd, 0.8).count() == 0
    rng = np.random.default_rng(3)
    for n in [0, 1, 64, 65, 500, 513, 5000]:
        for m in [0, 1, 60, 64, 65, 600, 6000]:
            whole = np.unique(rng.integers(0, 1 << 63, n + m, dtype=np.uint64))
            a, b = whole[:n], whole[max(0, n - m // 2) : max(0, n - m // 2) + m]
            differ = prefixes.differing(*(prefixes.parity(x, prefixes.places(len(x))).tobytes() for x in (a, b)))
            assert differ <= len(np.setxor1d(a, b))
    assert prefixes.places(10**7) == prefixes.MOST_PLACES
