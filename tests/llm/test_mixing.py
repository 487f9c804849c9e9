import random

from pyspark.sql import functions as F

from caseloom.llm import mixing


def water(words, weights=(5, 2, 1), most=3):
    names = sorted(words, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, full = {}, set()
    while True:
        left = sum(words.values()) - sum(most * words[s] for s in full)
        free = [s for s in names if s not in full]
        target = {s: most * words[s] for s in full} | {s: left * w[s] / sum(w[t] for t in free) for s in free}
        above = {s for s in free if target[s] > most * words[s] or words[s] == 0}
        if not above:
            return target
        full |= above


def corpus(seed, hot=True):
    rng = random.Random(seed)
    rows = []
    for i in range(900):
        source = "hot" if hot and i % 3 == 0 else rng.choice(["a", "b", "c", "é", "Z", None, "tiny"] if i % 50 else ["tiny"])
        if source == "tiny" and rng.random() < 0.8:
            source = "a"
        n = int(rng.lognormvariate(4, 1.2)) if rng.random() < 0.97 else 0
        rows.append((i, " \t".join(["w"] * n) if n or i % 2 else None, source, "clash"))
    return rows + [(5, rows[5][1], rows[5][2], "again"), (2000, "", "nothing", ""), (2001, None, "nothing", "")]


def test_mix(spark):
    docs = spark.createDataFrame(corpus(1), "doc_id long, text string, source string, target string").withColumn("size", mixing.n_words())
    rows = mixing.with_copies(docs, mixing.plan_mix(docs)).collect()
    assert len(rows) == docs.count() and rows[0].target in ("clash", "again", "")
    words, taken = {}, {}
    for r in rows:
        assert r["size"] == len((r.text or "").split())
        words[r.source] = words.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r["size"] * r.mix_copies
        assert 0 <= r.mix_copies <= 3
    want = water(words)
    for r in rows:
        assert r.mix_source_size == words[r.source] and abs(r.mix_target - want[r.source]) < 1e-6 * max(1, want[r.source])
    for s in words:
        assert abs(taken[s] - want[s]) <= max(3, 0.01 * want[s]), (s, taken[s], want[s])
    again = mixing.with_copies(docs.repartition(7, F.rand(3)), mixing.plan_mix(docs.repartition(3))).collect()
    assert sorted((r.doc_id, r.mix_copies) for r in again) == sorted((r.doc_id, r.mix_copies) for r in rows)
    assert len({r.mix_copies for r in rows if r.doc_id == 5}) == 1


def test_inclusion_follows_the_weights(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"), F.lit(10).cast("long").alias("size"), F.when(F.col("id") % 4 < 2, 3.0).otherwise(1.0).alias("odds"))
    got = mixing.with_copies(docs, mixing.plan_mix(docs, weights=(1, 4), weight_col="odds"), weight_col="odds")
    share = {(r.source, r.odds): r.m for r in got.groupBy("source", "odds").agg(F.avg("mix_copies").alias("m")).collect()}
    assert abs(share["a", 3.0] / share["a", 1.0] - 3) < 0.6  # 0.4 of the words: 0.6 and 0.2
    assert abs((share["a", 3.0] + share["a", 1.0]) / 2 - 0.4) < 0.01 and share["b", 1.0] >= 1


def brute_copies(rows):
    """Copies of each row (doc_id, size, source, u), by the definition, document by document."""
    words = {}
    for _, size, s, _ in rows:
        words[s] = words.get(s, 0) + size
    target, out = water(words), {}
    for s in words:
        mine = [r for r in rows if r[2] == s]
        certain = int(target[s] // words[s]) if words[s] else 0
        gap = target[s] - certain * words[s]
        share = gap / words[s] if words[s] else 0.0
        mean = sum(n * max(n, 1) ** 0.5 for _, n, *_ in mine) / max(1, words[s])
        tame = lambda x: max(1e-9, min(x, 1 - 1e-9))
        rank = {}
        for i, n, _, u in mine:
            p, base = tame(share * (max(n, 1) ** 0.5 / max(mean, 1e-12))), tame(share)
            odds = u / (1 - u) / (p / (1 - p)) * (base / (1 - base))
            rank[i] = odds / (1 + odds)
        live, chosen, least = sorted((rank[i], n, i) for i, n, *_ in mine if n), set(), 0.0
        for step in range(mixing.FILLS + 1):
            some = [(v, n, i) for v, n, i in live if v >= least and (n <= gap or not step)]
            for v, n, i in some:
                least = v
                if n > gap:
                    break
                gap -= n
                chosen.add(i)
            else:
                break
        spare = sorted((n, v, i) for v, n, i in live if i not in chosen and n < 2 * gap)
        chosen.update(i for *_, i in spare[:1])
        out |= {i: certain + (i in chosen) for i, n, *_ in mine}
    return out, target, words


def test_whole_query_matches_brute_force(spark, tmp_path):
    from caseloom.llm.queries import op6_pareto

    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * int(rng.lognormvariate(4, 1.2))) if i % 40 else None, rng.choice(["a", "b", "b", "b", "é", None]), "clash") for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    u = {r.doc_id: r.u for r in docs.select("doc_id", mixing._uniform("doc_id", 11).alias("u")).collect()}
    copies, target, words = brute_copies([(i, len((t or "").split()), s, u[i]) for i, t, s, _ in rows])
    got = op6_pareto(spark, str(tmp_path)).collect()
    assert len(got) == 700
    for r in got:
        n, s = len((rows[r.doc_id][1] or "").split()), rows[r.doc_id][2]
        assert (r["size"], r.source_size, r.taken) == (n, words[s], n * copies[r.doc_id]), r
        assert abs(r.target - target[s]) < 1e-6 * max(1, target[s]) and r.taken <= 3 * n
    for s in words:
        assert abs(sum(r.taken for r in got if rows[r.doc_id][2] == s) - target[s]) <= max(3, 0.01 * target[s])


def test_clashing_columns_have_a_defined_result(spark):
    docs = spark.createDataFrame([(1, "a", 10, "x", "y"), (2, "b", 20, "x", "y")], "doc_id long, source string, size long, mix_copies string, words string")
    got = mixing.with_copies(docs, mixing.plan_mix(docs))
    assert got.columns == ["doc_id", "source", "size", "words", "mix_copies", "mix_target", "mix_source_size"]
    assert dict(got.dtypes)["mix_copies"] == "int" and {r.words for r in got.collect()} == {"y"}


def test_word_count_and_empty_table(spark):
    texts = ["a b", " a\x0b\x0cb\r\nc ", "a b 　", "", None, "\x1c x"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r.n for r in df.select(mixing.n_words().alias("n")).collect()] == [2, 3, 2, 0, 0, 2]
    docs = spark.createDataFrame([], "doc_id long, source string, size long")
    assert mixing.with_copies(docs, mixing.plan_mix(docs)).count() == 0
    none = spark.createDataFrame([(1, "a", 0), (2, None, 0)], "doc_id long, source string, size long")
    assert {r.mix_target for r in mixing.with_copies(none, mixing.plan_mix(none)).collect()} == {0.0}
