import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from caseloom.llm import mixing, quality, simhash

from .test_mixing import brute_copies
from .test_quality import corpus as quality_corpus
from .test_simhash import unsigned
from .test_winnow import brute as contamination


def tables(spark, path):
    rng = random.Random(6)
    docs, labels = quality_corpus(260, 11)
    texts = [t for _, t, _ in docs]
    benchmark = [(i, " ".join(f"bench{i}w{j}" for j in range(14))) for i in range(5)]
    for i in range(20):  # exact and near copies, benchmark passages
        words = (texts[i + 20] or "").split()
        if i % 2 and words:
            words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    for i in range(8):
        texts[40 + i] += " " + " ".join(benchmark[i % 5][1].split()[i % 3 : i % 3 + (11 if i < 6 else 8)])
    texts += ["", None, "a b"]
    rows = [(i, t, "en", rng.choice(["s1", "s2", "hot", "hot", None]), len(t or "")) for i, t in enumerate(texts)] + [(None, "no id here", "en", "s1", 10)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows, benchmark


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def brute(spark, path, rows, benchmark):
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{path}/labels.parquet"))
    score = model.score(quality.matrix([r[1] for r in rows]))
    rows = [r for r, s in zip(rows, score) if s >= 0.3]
    assert 150 < len(rows) < 290
    # near copies: all pairs of texts by the Jaccard index of their five-word shingles
    sets = [set(simhash.shingle_hashes((r[1] or "").encode(), 5)) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and jaccard(sets[i], sets[j]) >= 0.8 and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    heads = {}
    for r, g in zip(rows, group):
        if r[0] is not None:
            heads[g] = min(heads.get(g, r[0]), r[0])
    rows = [r for r, g in zip(rows, group) if r[0] is None or heads[g] == r[0]]
    rows = [r for r in rows if not contamination(r[1], benchmark)[1]]
    # the mix, document by document
    u = {r.doc_id: r.u for r in docs.select("doc_id", mixing._uniform("doc_id", 11).alias("u")).collect()}
    copies = brute_copies([(r[0], len((r[1] or "").encode().split()), r[3], u[r[0]]) for r in rows])[0]
    taken = [r for r in rows for _ in range(copies[r[0]])]
    model, start, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for r in sorted(taken, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = model.encode(r[1] or "", add_special_tokens=False).ids + [0]
        out.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_run_matches_brute_force(spark, tmp_path):
    rows, benchmark = tables(spark, tmp_path)
    got = sorted((tuple(r) for r in P.run(spark, str(tmp_path)).collect()), key=lambda r: r[1])
    assert got == brute(spark, tmp_path, rows, benchmark)


def test_stages_keep_the_columns_and_bear_odd_tables(spark, tmp_path):
    tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    odd = spark.createDataFrame([(1, "a b c d e", None, None, None), (1, "a b c d e", None, None, None), (2, None, "x", "s", 0), (2, "", "x", "s", 0), (None, None, None, None, None)], docs.schema)
    for table in (odd, docs.limit(0)):
        step = table
        for _, stage in P.STAGES[:-1]:
            step = stage(spark, step, str(tmp_path))
            assert step.columns == docs.columns
            step = spark.createDataFrame(step.collect(), docs.schema)
        P.STAGES[-1][1](spark, step, str(tmp_path)).count()
    once = P.near_dedup(spark, odd, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in once) == ["1", "2", "None"]


def test_more_fingerprints_link_more_and_only_near_texts(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(4000)]
    rows = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(250)]
        near = list(base)
        near[rng.randrange(250)] = "changed"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(near))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for prints in (1, 4):
        parts = simhash.near_duplicates(docs, shingle=5, prints=prints).collect()
        assert all(r.component in (r.id, r.id - r.id % 2) for r in parts)
        found.append(sum(r.component != r.id for r in parts))
    assert found[1] > found[0] and found[1] >= 30
    assert all(0 <= unsigned(r.fp) < 1 << 64 for r in parts)


def test_fingerprints_of_the_stage_find_nine_of_ten_pairs_from_similarity_0_8(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(5000)]
    rows, similarity = [], {}
    for i in range(500):
        base = [rng.choice(words) for _ in range(rng.randrange(60, 500))]
        near = list(base)
        for at in rng.sample(range(len(base)), max(1, int(len(base) * rng.choice([0.005, 0.01, 0.02])))):
            near[at] = "changed"
        sets = [set(simhash.shingle_hashes(" ".join(x).encode(), P.SHINGLE)) for x in (base, near)]
        similarity[i] = jaccard(*sets)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(near))]
    docs = spark.createDataFrame(rows, "node long, text string")
    marks = simhash.fingerprints(docs, "node", "text", P.WORDS, P.PRINTS).withColumnRenamed("id", "node")
    found = {(r.a, r.b) for r in simhash.candidates(marks, P.PRINTS).collect()}
    assert all(b == a + 1 and a % 2 == 0 for a, b in found)  # nothing else is proposed
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 1.0)):
        band = [i for i, j in similarity.items() if low <= j < high]
        assert len(band) > 50 and sum((2 * i, 2 * i + 1) in found for i in band) >= 0.9 * len(band)


def test_near_dedup_drops_only_verified_copies(spark, tmp_path):
    rng = random.Random(9)
    line = "the same line of the page again and again "
    texts = [line * 60 + " ".join(f"own{i}x{j}" for j in range(12)) for i in range(3)]  # one repeated line, other text
    base = [f"b{i}" for i in range(300)]
    texts += [" ".join(base), " ".join(base), " ".join([*base[:200], "changed", *base[201:]])]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    parts = {r.id: r.component for r in simhash.near_duplicates(docs, shingle=P.SHINGLE, prints=P.PRINTS).collect()}
    assert parts[0] == parts[1] == parts[2]
    got = sorted(r.doc_id for r in P.near_dedup(spark, docs, str(tmp_path)).collect())
    assert got[:4] == [0, 1, 2, 3] and 4 not in got


def test_large_groups_are_settled_without_pairs(spark):
    rng = random.Random(10)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(3):  # centres with many near copies, which differ among each other
        base = [rng.choice(words) for _ in range(200)]
        for i in range(150):
            near = list(base)
            for _ in range(i % 3):
                near[rng.randrange(200)] = f"own{i}"
            texts.append(" ".join(near))
    texts += [" ".join(rng.choice(words) for _ in range(100)) for _ in range(50)]
    texts += ["", None, " ", "one", "One", "a b", "A  b", *texts[:30]]
    rng.shuffle(texts)
    docs = spark.createDataFrame([((i, i), t) for i, t in enumerate(texts)], "key struct<doc_id:long,row:long>, text string")
    sets = [set(simhash.shingle_hashes((t or "").encode(), 5)) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if group[i] != group[j] and jaccard(sets[i], sets[j]) >= 0.8:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    assert len(set(group)) == 3 + 50 + 3
    assert {r.key.doc_id for r in simhash.representatives(docs).collect()} == set(group)


def test_rows_that_share_an_id_but_not_a_text(spark, tmp_path):
    one, two = (" ".join(f"{x}{i}" for i in range(80)) for x in "ab")
    rows = [(1, one, "en", "s", 1), (1, two, "en", "s", 2), (2, two, "en", "s", 3), (1, one, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id, r.text) for r in P.near_dedup(spark, docs, str(tmp_path)).collect())
    assert got == [(1, one), (1, two)]
    copies = spark.createDataFrame([(1, one, "en", "s", 1), (3, two, "en", "s", 2), (3, one, "en", "s", 3)], docs.schema)
    got = sorted((r.doc_id, r.text) for r in P.near_dedup(spark, copies, str(tmp_path)).collect())
    assert got == [(1, one), (3, two)]


def test_mix_keeps_columns_of_any_name(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"some words of document {i}", "en", "s", 7, f"x{i}", i, "z") for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long, mix_size string, mix_copy int, mix_copies string")
    got = P.mix(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in docs.collect()}
    more = docs.withColumn("key", docs.lang).withColumn("a.b", docs.mix_copy).withColumn("of", F.create_map(docs.lang, docs.n_chars))
    spark.createDataFrame([(1, "nothing of theirs")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for stage in (P.near_dedup, P.decontaminate, P.mix):
        kept = stage(spark, more.unionByName(more.limit(0)), str(tmp_path))
        assert kept.columns == more.columns and kept.count() == 20, stage
    assert P.near_dedup(spark, more.unionByName(more), str(tmp_path)).count() == 20  # of equal rows one stays
