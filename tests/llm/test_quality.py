import random
import zlib

import numpy as np

from caseloom.llm import quality


def corpus(n, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéü") for _ in range(rng.randrange(2, 9))) for _ in range(800)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 200))]
        good = rng.random() > 0.2
        if not good:
            kind = rng.randrange(4)
            words = [[w.upper() + "!!" for w in words], [w + rng.choice(["###", "$$$", "&&&"]) for w in words], [x for w in words for x in (w, "|")], [w for w in words[:9] for _ in range(20)]][kind]
        docs.append((i, None if i == 7 else " ".join(words), "clash"))
        if rng.random() < 0.5:
            labels.append((i, int(good), None))
    return docs, labels + [(3, None, 1), (10**9, 1, 0)]


def test_held_out_accuracy_and_contract(spark, tmp_path):
    from caseloom.llm.queries import op7_bradley_terry

    docs, labels = corpus(1500)
    spark.createDataFrame(docs, "doc_id long, text string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = {r.doc_id: r for r in op7_bradley_terry(spark, str(tmp_path)).collect()}
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    tests = [(i, q) for i, q, _ in labels if i in rows and rows[i].held_out and q is not None]
    right = sum(rows[i].predicted == q for i, q in tests)
    assert len(tests) > 80 and right / len(tests) > 0.97


def test_held_out_labels_are_not_learnt_from(spark):
    docs, labels = corpus(400, 5)
    frame = spark.createDataFrame(docs, "doc_id long, text string, x string")
    flipped = [(i, q if q is None or zlib.crc32(str(i).encode()) % 5 else 1 - q, t) for i, q, t in labels]
    a, b = (quality.train(frame, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flipped))
    assert np.array_equal(a.weights, b.weights) and a.threshold == b.threshold


def test_without_both_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    model = quality.train(docs, none)
    assert [r.s for r in docs.select(model.column().alias("s")).collect()] == [0.5, 0.5]
    assert docs.limit(0).select(model.column().alias("s")).count() == 0


def test_strength_differences_are_log_odds():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, quality.N_FEATURES))
    label = (x[:, 0] + 0.3 * rng.normal(size=600) > -0.8).astype(int)
    model = quality.fit(x, label)
    s = model.strength(x)
    good, bad = s[label == 1], s[label == 0]
    assert (good[:, None] > bad[None, :]).mean() > 0.97
    assert abs((model.score(x) >= 0.3).sum() - label.sum()) <= 1


def test_texts_of_a_batch_are_not_copied_all_at_once(spark):
    import pyarrow as pa

    got = quality._one_by_one(pa.array(["a", None, "b c"]))
    assert iter(got) is got and list(got) == ["a", None, "b c"]
    docs, labels = corpus(200)
    table = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    model = quality.train(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    scores = {r.doc_id: r.s for r in table.select("doc_id", model.column("text").alias("s")).collect()}
    assert [scores[d[0]] for d in docs] == model.score(quality.matrix([d[1] for d in docs])).tolist()
