import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from caseloom.llm import tokenfiles as T

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "a", " a", "a ", "two  spaces", "tab \t x", "line \n\n x", "nb  sp", "x  y", "  wide", "can't  I'll", "<|endoftext|> a <|endoftext|>", "x" * 5000, "é ñ ß 漢字 🙂 \x1c q", "1 22 333", " ".join(["word"] * 4000), "a \x1cb", "\u0085 c ​ d"]


def plain(model, text):
    return model.encode(text or "", add_special_tokens=False).ids + [0]


def test_ids_equal_the_tokenizers_own():
    model, rng = Tokenizer.from_file(PATH), random.Random(2)
    encoder = T.PieceEncoder(PATH, "<u2")
    chars = "ab Z9'.,\n\t  é　漢-"
    for text in [x for x in ODD if x is not None] + ["".join(rng.choice(chars) for _ in range(rng.randrange(40))) for _ in range(3000)]:
        assert np.frombuffer(encoder.encode_many([text])[0], "<u2").tolist() == model.encode(text, add_special_tokens=False).ids, repr(text)


def test_kept_words_stay_bounded(monkeypatch):
    monkeypatch.setattr(T, "PIECES", 5)
    model, encoder = Tokenizer.from_file(PATH), T.PieceEncoder(PATH, "<u2")
    for i in range(30):
        text = f"a b{i} c{i % 3} d" + "e" * 60 + " a"
        assert np.frombuffer(encoder.encode_many([text])[0], "<u2").tolist() == model.encode(text, add_special_tokens=False).ids
        assert len(encoder.pieces.young) + len(encoder.pieces.old) <= 24


def test_round_trip(spark):
    rng = random.Random(1)
    texts = ODD + [" ".join(rng.choice("the of and thing éa.".split()) for _ in range(rng.randrange(300))) for _ in range(150)]
    rows = [(i * 3 % 1000, t, 7) for i, t in enumerate(texts)] + [(0, texts[0], 7), (None, "no id", 7)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    corpus = T.write_tokens(docs, PATH, files=5)
    model, start = Tokenizer.from_file(PATH), 0
    want = []
    for doc_id, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = plain(model, text)
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in corpus.summary().collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    asked = spark.createDataFrame([(3,), (9,), (12345,)], "doc_id long")
    found = {r.doc_id: r.ids for r in corpus.lookup(asked).collect()}
    by_id = {r[0]: r[1] for r in rows}
    assert found == {k: plain(model, by_id[k]) for k in (3, 9)}


def test_files_are_seekable_and_checked(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(20)], "doc_id long, text string")
    corpus = T.write_tokens(docs, PATH, path=f"file://{tmp_path}/out", files=1)
    (_, uri, n, n_ids), = corpus.manifest
    name = uri.removeprefix("file://")
    data = open(name, "rb").read()
    # any zstandard reader skips the two skippable frames and finds all ids
    reader = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True)
    assert len(reader.read()) == 2 * n_ids and n == 20
    store, where = T._store(uri)
    file = T.Reader(store.open_input_file(where))
    assert file.document(7).tolist() == plain(Tokenizer.from_file(PATH), "text number 7")
    broken = bytearray(data)
    broken[int(file.starts[7]) + int(file.table[7, 0]) - 6] ^= 1
    open(name, "wb").write(bytes(broken))
    file = T.Reader(store.open_input_file(where))
    file.document(6)
    with pytest.raises(Exception):
        file.document(7)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert T.write_tokens(docs, PATH, files=3).summary().count() == 0


def test_hot_ids_are_cut_and_files_stay_small(spark):
    rows = [(None, f"text {i} of no id") for i in range(300)] + [(7, "the very same text")] * 300 + [(i, f"doc {i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    corpus = T.write_tokens(docs, PATH, files=6, file_bytes=400)
    assert len(corpus.manifest) > 6 and max(n_ids for *_, n_ids in corpus.manifest) < 400
    got = sorted(tuple(r) for r in corpus.summary().select("start", "doc_id", "n_tokens").collect())
    ids = [d for _, d, _ in got]
    assert len(got) == 700 and ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    assert all(b[0] == a[0] + a[2] for a, b in zip(got, got[1:]))


def test_whole_query_matches_brute_force(spark, tmp_path):
    from caseloom.llm.queries import op9_seekable_zstd

    texts = ODD + [f"number {i}" for i in range(50)]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    model, start, want = Tokenizer.from_file(PATH), 0, []
    for i, text in enumerate(texts):
        ids = plain(model, text)
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in op9_seekable_zstd(spark, str(tmp_path)).collect()) == want


def test_a_worker_that_reads_files_back_gives_up_what_it_has_learnt():
    T.encoder_of(PATH, "<u2").encode_many(["some words"])
    assert list(T._summaries(iter([]))) == [] and not T._encoders
    assert T.encoder_of(PATH, "<u2").encode_many(["some words"])[0] == T.PieceEncoder(PATH, "<u2").whole("some words")
