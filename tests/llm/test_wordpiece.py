import random

import public_tokenizers

from caseloom.llm import wordpiece

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def greedy(word, starts, rests):
    at, n = 0, 0
    while at < len(word) or n == 0:
        vocabulary = rests if n else starts
        size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in vocabulary), 0)
        if not size:
            return 1
        at, n = at + size, n + 1
        if at == len(word):
            return n
    return n


def test_automaton_matches_greedy_cutting():
    rng = random.Random(4)
    for _ in range(300):
        make = lambda n: {bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 6))) for _ in range(n)}
        starts, rests = make(rng.randrange(1, 12)), make(rng.randrange(1, 15))
        machine = wordpiece.Automaton(starts, rests)
        for _ in range(60):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 14)))
            assert machine.count(word) == greedy(word, starts, rests), (word, starts, rests)


def test_whole_query_matches_brute_force(spark, tmp_path):
    import base64

    from caseloom.llm.queries import op5_wordpiece

    pieces = {base64.b64decode(x.split()[0]) for x in open(PATH, "rb")}
    starts, rests = {p for p in pieces if p.startswith(b" ")}, {p for p in pieces if b" " not in p}
    rng = random.Random(2)
    texts = [None, "", " \n", "one", "unbelievable  tokenization\té漢字 🙂", "x" * 3000] + ["".join(rng.choice("aeiou rstln THÉ,.9") for _ in range(rng.randrange(200))) for _ in range(80)]
    spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int").write.parquet(f"{tmp_path}/documents.parquet")
    for r in op5_wordpiece(spark, str(tmp_path)).collect():
        words = (texts[r.doc_id] or "").encode().split()
        assert (r.n_words, r.n_tokens) == (len(words), sum(greedy(b" " + w, starts, rests) for w in words))
    assert wordpiece.piece_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_kept_words_stay_bounded(monkeypatch):
    monkeypatch.setattr(wordpiece, "WORDS", 4)
    counter = wordpiece.Counter(wordpiece.automaton_of(PATH), b" ")
    for i in range(50):
        assert counter.totals([b"a b%d c" % i]) == [(3, sum(counter.count(b" " + w) for w in (b"a", b"b%d" % i, b"c")))]
        assert len(counter.words.young) <= 8
