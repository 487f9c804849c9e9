import hashlib
import random
import re

import pytest

from caseloom.llm import winnow

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    own, hit, seen = words(text), set(), set()
    for item_id, item in items:
        w = words(item)
        size = min(10, len(w))
        windows = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
        for i in range(len(own) - size + 1):
            if w and tuple(own[i : i + size]) in windows:
                seen.add(str(item_id))
                hit.update(range(i, i + size))
    return len(own), len(hit), sorted(seen)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "the", "été", "x1", "漢字", "No", "of"] + [f"word{i}" for i in range(30)]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "__", "-", " `"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 9, 10, 11, 25, 60]))) for i in range(24)] + [(50, None), (51, "!!! ..."), (52, "the the the the the the the the the the the the"), (3, text(12))]
    docs = [None, "", " . ", "the", "the " * 40, "Z" * 5000 + " the"]
    for _ in range(60):
        parts = [text(rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            own = (rng.choice(items)[1] or "").split(" ")
            a = rng.randrange(max(1, len(own)))
            parts += [" ".join(own[a : a + rng.randrange(30)]).upper() if rng.random() < 0.3 else " ".join(own), text(rng.randrange(20))]
        docs.append(" ".join(parts))
    return docs, items


@pytest.mark.parametrize("broadcast_words", [winnow.BROADCAST_WORDS, 0])
def test_matches_brute_force(spark, broadcast_words):
    docs, items = corpus(4)
    rows = spark.createDataFrame([(i, t, "n", [1]) for i, t in enumerate(docs + docs[:9])], "doc_id long, text string, n_words string, spans array<int>")
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = {r.id: (r.n_words, r.n, list(r["items"])) for r in winnow.contamination(rows, tests, broadcast_words=broadcast_words).withColumn("n", winnow.n_hit()).collect()}
    assert got == {i: brute(t, items) for i, t in enumerate(docs + docs[:9])}


@pytest.mark.parametrize("broadcast_words", [winnow.BROADCAST_WORDS, 0])
def test_clean_documents_stay_with_all_columns(spark, broadcast_words):
    docs, items = corpus(5)
    table = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(docs + docs[:9])], "n_words long, text string, id int, spans string")
    tests = spark.createDataFrame(items + items[:3], "item_id long, text string")
    got = winnow.without_contaminated(table, tests, broadcast_words=broadcast_words)
    assert got.columns == table.columns
    assert sorted(r.id for r in got.collect()) == [i for i, t in enumerate(docs + docs[:9]) if not brute(t, items)[1]]
    assert winnow.without_contaminated(table.limit(0), tests.limit(0), broadcast_words=broadcast_words).count() == 0


def test_repeated_items_and_hot_passages_by_the_join(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    items = [(i, passage if i % 2 else passage + f" more{i} and others here to come") for i in range(40)]
    docs = [f"own{i} {passage} tail{i}" if i % 3 else f"nothing {i}" for i in range(300)]
    rows = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    found = {r.id: (r.n_words, r.n, list(r["items"])) for r in winnow.contamination(rows, spark.createDataFrame(items, "item_id long, text string"), broadcast_words=0).withColumn("n", winnow.n_hit()).collect()}
    want = {passage_in: brute(docs[passage_in], items) for passage_in in (0, 1)}
    assert all(found[i] == want[min(i % 3, 1)] for i in range(300))


def test_guarantee_of_winnowing():
    import numpy as np

    rng = np.random.default_rng(2)
    shared = rng.integers(0, 1 << 62, 10).astype(np.uint64)
    for _ in range(200):
        a, b = (np.concatenate([rng.integers(0, 1 << 62, rng.integers(0, 20)).astype(np.uint64), shared, rng.integers(0, 1 << 62, rng.integers(0, 20)).astype(np.uint64)]) for _ in range(2))
        x, y = winnow.gram_hashes(a, 5), winnow.gram_hashes(b, 5)
        assert set(x[winnow.winnow(x, 6)].tolist()) & set(y[winnow.winnow(y, 6)].tolist())


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "the of")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    row = winnow.contamination(docs, none).withColumn("n", winnow.n_hit()).collect()[0]
    assert (row.n_words, row.n, list(row["items"])) == (2, 0, [])
    assert winnow.contamination(docs.limit(0), none).count() == 0


def test_query_contract(spark, tmp_path):
    from caseloom.llm.queries import op3_winnowing

    docs, items = corpus(9)
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for r in op3_winnowing(spark, str(tmp_path)).collect():
        n, hit, seen = brute(docs[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(seen), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(seen).encode()).hexdigest()


def test_sql_agrees(spark, tmp_path):
    import duckdb

    from caseloom.llm.queries import ORACLES, op3_winnowing

    docs, items = corpus(12)
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    found = con.sql(ORACLES["op3_winnowing"])
    rows = op3_winnowing(spark, str(tmp_path)).select(found.columns).collect()
    assert sorted(map(tuple, rows)) == sorted(found.fetchall())
