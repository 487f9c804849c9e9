"""Benchmark decontamination by winnowing.

Words are runs of ASCII letters (capitals count as small), digits and non-ASCII
characters.  From each sliding window of w consecutive k-gram hashes the least
is kept (the rightmost on a tie), on the training and on the test side.  Any
span of k + w - 1 words that a document shares with an item then has a
fingerprint in common.  With k = 5 and w = 6 that is every shared window of 10
words.  Equal fingerprints are joined, each hit is extended along its diagonal
while the words agree, and runs of at least 10 words are confirmed on the words
themselves.  An item of fewer than 10 words is one window: for each such length
the whole item's hash is the fingerprint and every position of a document is
looked up.

Both sides are fingerprinted in the executors.  Test sides of at most
BROADCAST_WORDS words, which are counted first, are sent to all executors, and
no row of documents is shuffled.  Beyond, the fingerprints of both sides are
shuffled and joined, equal items once; only documents and items with a common
fingerprint are brought together to be confirmed.  A fingerprint that is common
among documents meets each distinct item that has it; such a join is one that
Spark splits where it is skewed.  Both ways give the same rows.

Cases: a null or empty text, or one of punctuation only, has no words, no hits
and is not contaminated; an item without words never occurs; repeated items
and rows each count; empty tables are fine; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.blocks import sliced, utf8
from caseloom.scratch import save

#: Words and ids of items up to which the test side is broadcast; under 40 bytes each.
BROADCAST_WORDS = 1_000_000
#: Bytes of text handled at once in a worker.
CHUNK = 1 << 21

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, ends) of the words in bytes."""
    low = _LOWER[data]
    inside = np.zeros(len(low) + 2, np.int8)
    inside[1:-1] = _WORD[low]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return low, edges[::2], edges[1::2]


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each word, a function of its bytes alone."""
    out = np.zeros(len(starts), np.uint64)
    sizes = ends - starts
    live = np.arange(len(starts))
    step = 0
    while len(live):  # a byte of every word at a time; long words are finished on their own
        if len(live) < 64:
            for i in live.tolist():
                h = int(out[i])
                for c in low[starts[i] + step : ends[i]].tolist():
                    h = ((h + c + 1) * int(_BASE) & 0xFFFFFFFFFFFFFFFF) ^ (h >> 32)
                out[i] = h
            break
        h = out[live]
        out[live] = ((h + low[starts[live] + step] + np.uint64(1)) * _BASE) ^ (h >> np.uint64(32))
        step += 1
        live = live[sizes[live] > step]
    return _mix(out)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * _STEP + words[i : i + n]
    return _mix(h)


def winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """Positions kept: of each window of w hashes the least, the rightmost on a tie; a shorter run is one window."""
    if len(grams) == 0:
        return np.zeros(0, np.int64)
    w = min(w, len(grams))
    n = len(grams) - w + 1
    least, at = grams[:n].copy(), np.arange(n)
    for i in range(1, w):
        other = grams[i : i + n]
        better = other <= least
        least[better] = other[better]
        at[better] = np.flatnonzero(better) + i
    return np.unique(at)


def _prints(hashes: np.ndarray, k: int, w: int, lengths: tuple[int, ...] | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, fingerprints, positions) of a run of words; n is 0 for winnowed k-grams, else the length of a whole item.

    lengths: the lengths to look for at every position of a document; None for
    an item, which has either kind.
    """
    if lengths is None and 0 < len(hashes) < k + w - 1:
        yield len(hashes), gram_hashes(hashes, len(hashes)), np.zeros(1, np.int64)
    elif len(hashes) >= k + w - 1:
        grams = gram_hashes(hashes, k)
        kept = winnow(grams, w)
        yield 0, grams[kept], kept
    for n in lengths or ():
        grams = gram_hashes(hashes, n)
        yield n, grams, np.arange(len(grams))


def _confirmed(hits: list[tuple[int, int]], own: list[bytes], word_at, size: int, span: int) -> list[tuple[int, int]]:
    """(first, end) of the runs of words that a document shares with an item, from (place, position) of equal fingerprints.

    Each hit is extended along its diagonal while the words agree; a run counts
    if it has `span` words, or all of a shorter item.
    """
    found, done = [], {}
    for place, at in sorted(hits):
        if done.get(place - at, -1) > place:
            continue
        a, b = place, place
        while a > 0 and a > place - at and word_at(a - 1) == own[a - 1 - place + at]:
            a -= 1
        while b < size and b - place + at < len(own) and word_at(b) == own[b - place + at]:
            b += 1
        done[place - at] = max(b, place + 1)
        if b - a >= min(span, len(own)):
            found.append((a, b))
    return found


class TestSide:
    """The items and their fingerprints, for documents that pass by."""

    __test__ = False

    def __init__(self, k: int, w: int, ids: list[list[str]], texts: list[bytes], prints: list[tuple[int, int, int, int]]):
        """prints: (n, fingerprint, item, position)."""
        self.k, self.w, self.ids, self.texts = k, w, ids, texts
        self.own: dict[int, list[bytes]] = {}
        columns = np.array(prints, np.int64).reshape(-1, 4)
        columns = columns[np.argsort(columns[:, 1].astype(np.uint64), kind="stable")]
        self.tables = {int(n): (rows[:, 1].astype(np.uint64), rows[:, 2], rows[:, 3]) for n in np.unique(columns[:, 0]) for rows in [columns[columns[:, 0] == n]]}
        self.lengths = tuple(n for n in self.tables if n)

    def words(self, item: int) -> list[bytes]:
        if item not in self.own:
            self.own[item] = _words(self.texts[item])
        return self.own[item]

    def spans(self, hashes: np.ndarray, word_at) -> list[tuple[int, int, int]]:
        """(first, end, item) of the shared runs in one run of words; word_at(i) gives word i's bytes."""
        hits: dict[int, list[tuple[int, int]]] = {}
        for n, prints, places in _prints(hashes, self.k, self.w, self.lengths):
            known, items, positions = self.tables.get(n, (np.zeros(0, np.uint64),) * 3)
            if not len(known):
                continue
            first = np.searchsorted(known, prints)
            hit = np.flatnonzero(known[np.minimum(first, len(known) - 1)] == prints)
            last = np.searchsorted(known, prints[hit], "right")
            for place, a, b in zip(places[hit].tolist(), first[hit].tolist(), last.tolist()):
                for j in range(a, b):
                    hits.setdefault(int(items[j]), []).append((place, int(positions[j])))
        span = self.k + self.w - 1
        return [(a, b, item) for item, found in hits.items() for a, b in _confirmed(found, self.words(item), word_at, len(hashes), span)]


def _words(text: bytes) -> list[bytes]:
    low, starts, ends = words_of(np.frombuffer(text, np.uint8))
    return [low[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())]


def _cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, word starts, word ends, first word of each text and the end)."""
    data, offsets = utf8(texts)
    low, starts, ends = words_of(_with_breaks(data, offsets))
    # text i begins after i inserted breaks
    return low, starts, ends, np.searchsorted(starts, offsets + np.arange(len(offsets)))


def _words_from(low: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    return lambda i: low[starts[i] : ends[i]].tobytes()


def _with_breaks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The texts with a zero byte after each."""
    out = np.zeros(len(data) + len(offsets) - 1, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))] = data
    return out


def _printed(texts: DataFrame, k: int, w: int, lengths: tuple[int, ...] | None) -> DataFrame:
    """(n, h, no, at): the fingerprints of rows (no, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1, CHUNK):
            low, starts, ends, firsts = _cut(batch.column(1))
            hashes = word_hashes(low, starts, ends)
            for no, a, b in zip(batch.column(0).to_pylist(), firsts[:-1].tolist(), firsts[1:].tolist()):
                for n, prints, places in _prints(hashes[a:b], k, w, lengths):
                    size = len(prints)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(size, n, np.int32)), pa.array(prints.view(np.int64)), pa.array(np.full(size, no, np.int64)), pa.array(places.astype(np.int64))], names=["n", "h", "no", "at"])

    return texts.select("no", "text").mapInArrow(run, "n int, h long, no long, at long")


def _counted(docs: DataFrame) -> DataFrame:
    """(id, text) with the column n_words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1, CHUNK):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.diff(_cut(batch.column(1))[3]).astype(np.int64))], names=["id", "text", "n_words"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, text string, n_words long")


class Items:
    """Distinct item texts with numbers, the ids of each, and their fingerprints, in the shared folder."""

    def __init__(self, items: DataFrame, id_col: str, text_col: str, k: int, w: int):
        self.k, self.w = k, w
        named = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        # numbers hold once written
        self.texts = save(_counted(named.select(F.lit(0).alias("id"), "text").distinct()).where("n_words > 0").select(F.monotonically_increasing_id().alias("no"), "text", "n_words"), "item_texts")
        self.ids = save(named.join(self.texts, "text").select("no", "id").distinct(), "item_ids")
        self.prints = save(_printed(self.texts, k, w, None), "item_prints")

    def size(self) -> int:
        """Words of the distinct texts and ids."""
        return (self.texts.agg(F.sum("n_words")).first()[0] or 0) + self.ids.count()

    def side(self) -> TestSide:
        """All in memory; for items of a checked size."""
        texts = self.texts.select("no", "text").collect()
        order = {r.no: i for i, r in enumerate(texts)}
        ids: list[list[str]] = [[] for _ in texts]
        for r in self.ids.collect():
            ids[order[r.no]].append(r.id)
        prints = [(r.n, r.h, order[r.no], r["at"]) for r in self.prints.collect()]
        return TestSide(self.k, self.w, ids, [r.text.encode() for r in texts], prints)


def _passed_by(docs: DataFrame, side) -> DataFrame:
    """(id, text, n_words, spans, items) of rows (id, text), by a test side in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: TestSide = side.value
        for batch in sliced(batches, 1, CHUNK):
            low, starts, ends, firsts = _cut(batch.column(1))
            hashes = word_hashes(low, starts, ends)
            found = [held.spans(hashes[a:b], _words_from(low, starts[a:b], ends[a:b])) for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist())]
            spans = pa.array([[x for a, b, _ in row for x in (a, b)] for row in found], pa.list_(pa.int64()))
            items = pa.array([sorted({x for i in {i for *_, i in row} for x in held.ids[i]}) for row in found], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.diff(firsts).astype(np.int64)), spans, items], names=["id", "text", "n_words", "spans", "items"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, text string, n_words long, spans array<bigint>, items array<string>")


def _joined_hits(texts: DataFrame, items: Items) -> DataFrame:
    """(no, spans, items) of those rows (no, text) that share a run with an item, by a join of fingerprints."""
    lengths = tuple(sorted(r.n for r in items.prints.where("n > 0").select("n").distinct().collect()))  # fewer than k + w - 1
    span = items.k + items.w - 1
    met = _printed(texts, items.k, items.w, lengths).join(items.prints.select("n", "h", F.col("no").alias("item"), F.col("at").alias("place")), ["n", "h"])
    hits = met.groupBy("no", "item").agg(F.collect_set(F.struct("at", "place")).alias("hits"))
    both = hits.join(texts.select("no", "text"), "no").join(items.texts.select(F.col("no").alias("item"), F.col("text").alias("own")), "item").select("no", "item", "text", "own", "hits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = _words((row["text"] or "").encode())
                runs = _confirmed([(h["at"], h["place"]) for h in row["hits"]], _words(row["own"].encode()), words.__getitem__, len(words), span)
                if runs:
                    yield pa.RecordBatch.from_arrays([pa.array([row["no"]]), pa.array([row["item"]]), pa.array([[x for r in runs for x in r]], pa.list_(pa.int64()))], names=["no", "item", "spans"])

    found = save(both.mapInArrow(run, "no long, item long, spans array<bigint>"), "runs")
    ids = found.join(items.ids.toDF("item", "id"), "item").groupBy("no").agg(F.array_sort(F.collect_set("id")).alias("items"))
    return found.groupBy("no").agg(F.flatten(F.collect_list("spans")).alias("spans")).join(ids, "no")


def _hits(docs: DataFrame, items: Items, broadcast_words: int) -> DataFrame:
    """(id, text, n_words, spans, items) of rows (id, text)."""
    if items.size() <= broadcast_words:
        return _passed_by(docs, docs.sparkSession.sparkContext.broadcast(items.side()))
    texts = save(_counted(docs).withColumn("no", F.monotonically_increasing_id()), "documents")
    found = save(_joined_hits(texts, items), "hits")
    none = lambda kind: F.expr(f"cast(array() as array<{kind}>)")
    return texts.join(found, "no", "left").select("id", "text", "n_words", F.coalesce("spans", none("bigint")).alias("spans"), F.coalesce("items", none("string")).alias("items"))


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    k: int = 5,
    w: int = 6,
    broadcast_words: int = BROADCAST_WORDS,
) -> DataFrame:
    """(id, text, n_words, spans, items) for each row of docs.

    spans: flat pairs first, end of word positions that lie in an occurring
    window, as found (they may overlap); items: ids as strings of the items
    that have an occurring window, sorted, each once.
    """
    return _hits(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), Items(items, item_id, item_text, k, w), broadcast_words)


def without_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 5, w: int = 6, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """The rows of docs, with all columns, whose text holds no window of an item.

    Null and empty texts stay, as do repeated rows; columns of any name go through.
    """
    known = Items(items, item_id, item_text, k, w)
    if known.size() <= broadcast_words:
        plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # mapInArrow takes no names with dots
        clean = plain.mapInArrow(_filter_by(docs.sparkSession.sparkContext.broadcast(known.side()), docs.columns.index(text_col)), plain.schema)
        return clean.toDF(*docs.columns)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("id"), F.col(text_col).alias("text"))
    return _hits(whole, known, broadcast_words).where("size(spans) = 0").select("id.*")


def _filter_by(side, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: TestSide = side.value
        for batch in sliced(batches, at, CHUNK):
            low, starts, ends, firsts = _cut(batch.column(at))
            hashes = word_hashes(low, starts, ends)
            clean = [not held.spans(hashes[a:b], _words_from(low, starts[a:b], ends[a:b])) for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist())]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return run


def n_hit(spans: str = "spans"):
    """How many word positions the spans cover."""
    pairs = F.array_sort(F.transform(F.sequence(F.lit(0), F.size(spans) - 2, F.lit(2)), lambda i: F.struct(F.element_at(spans, i + 1).alias("a"), F.element_at(spans, i + 2).alias("b"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    step = lambda s, p: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), p["b"] - F.greatest(p["a"], s["to"]))).alias("n"), F.greatest(s["to"], p["b"]).alias("to"))
    return F.when(F.size(spans) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(pairs, start, step, lambda s: s["n"]))
