"""Token ids in seekable zstandard files.

A file holds, in ascending id order of its documents:

* one independent zstandard frame for each document, with content checksum,
  of its token ids as little-endian unsigned integers of 2 or 4 bytes;
* a skippable frame (magic 0x184D2A51) with the document ids: a zstandard
  frame of little-endian signed 64-bit integers;
* a skippable frame (magic 0x184D2A5E) with the seek table of the public
  zstandard seekable format: compressed size, content size and the low 32 bits
  of the content's XXH64 for each frame, then the number of frames, a
  descriptor byte and the magic 0x8F92EAB1.  The id frame starts with a byte
  that gives the bytes for each token id.

A reader loads the tail, then only the frames it wants.  Documents are dealt to
tasks by ranges of (id, hash of the text, place in the input), so the order
over all files is the order of ids, and equal or null ids, however many, are
cut like any others.  There are as many tasks as the input's size asks for, and
each goes on to a new file after FILE_BYTES, so what a task holds is bounded.
A file's name holds the task attempt, and only the attempts in the manifest
count, so lost executors and repeated tasks do no harm.

Cases: a null or empty text is the end id alone; repeated rows and equal ids
are each written, those of one id in the order of their texts' hashes; a null id sorts first and is stored as a flag value; an empty
table gives no rows; columns other than the two named are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm.blocks import sliced
from caseloom.llm.kept import Kept
from caseloom.scratch import new_path

ID_MAGIC, SEEK_MAGIC, FOOT_MAGIC = 0x184D2A51, 0x184D2A5E, 0x8F92EAB1
#: Stands for a null document id in the files.
NO_ID = -(1 << 63)
#: Pieces of each of two generations kept with their ids in a worker.
PIECES = 400_000
#: Bytes of input for a task, and of ids after which a task begins a new file.
TASK_BYTES, FILE_BYTES = 1 << 27, 1 << 28
#: Tasks of one write, as estimates of a plan's size can be far too high; more bytes than this many tasks share make more files each.
MOST_TASKS = 200_000
#: Bytes of text encoded in one step.
CHUNK = 1 << 22


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class PieceEncoder:
    """A byte-level tokenizer's ids as packed bytes, with the ids of frequent pieces kept.

    Texts of ASCII and Latin letters are cut by the tokenizer's own pattern,
    written for UTF-8 bytes, and its model encodes the pieces that aren't kept.
    Texts with other characters or special tokens go to the tokenizer whole.
    """

    #: The pattern of byte-level pre-tokenizers for such texts; a byte from 128 on belongs to a letter.
    CUT = re.compile(rb" ?[A-Za-z\x80-\xff]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\sA-Za-z0-9\x80-\xff]+|\s+(?!\S)|\s+").findall
    PLAIN = re.compile("[\t\n\r\x20-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]*").fullmatch

    def __init__(self, path: str, dtype: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        setting = json.loads(self.model.to_str())
        first = setting["pre_tokenizer"] or {}
        self.cuts = first.get("type") == "ByteLevel" and not first.get("add_prefix_space") and first.get("use_regex") and not setting["normalizer"]
        self.special = tuple(t.content for t in self.model.get_added_tokens_decoder().values())
        self.dtype = np.dtype(dtype)
        self.signs = str.maketrans(_byte_signs())
        self.pieces = Kept(PIECES)
        # packers of the usual numbers of ids
        self.pack = [struct.Struct(f"<{n}{'H' if self.dtype.itemsize == 2 else 'I'}").pack for n in range(12)]

    def whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text; best for a megabyte or so at a time."""
        cuts = [self.CUT(t.encode()) if self.cuts and self.PLAIN(t) and not any(x in t for x in self.special) else None for t in texts]
        kept, tokenize, signs, pack = self.pieces.young, self.model.model.tokenize, self.signs, self.pack
        for piece in self.pieces.missing(set().union(*(c for c in cuts if c))):
            ids = [t.id for t in tokenize(piece.decode("latin-1").translate(signs))]
            kept[piece] = pack[len(ids)](*ids) if len(ids) < len(pack) else np.array(ids, self.dtype).tobytes()
        known = kept.__getitem__
        out = [self.whole(t) if c is None else b"".join(map(known, c)) for t, c in zip(texts, cuts)]
        self.pieces.turn()
        return out


def _byte_signs() -> dict[int, int]:
    """The sign that byte-level tokenizers write for each byte: itself if visible in Latin-1, else one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b if b in seen else 256 + sum(x not in seen for x in range(b)) for b in range(256)}


_encoders: dict[tuple[str, str], PieceEncoder] = {}


def encoder_of(path: str, dtype: str) -> PieceEncoder:
    """This process's encoder; workers that are used again keep what they have learnt until files are read back."""
    if (path, dtype) not in _encoders:
        _encoders[path, dtype] = PieceEncoder(path, dtype)
    return _encoders[path, dtype]


class Writer:
    """Writes one file; `add` takes documents in order."""

    def __init__(self, sink, width: int, level: int):
        import zstandard

        self.sink, self.width = sink, width
        self.frames = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.ids: list[int] = []
        self.entries = bytearray()

    def add(self, doc_id: int | None, packed: bytes) -> None:
        from xxhash import xxh64_intdigest

        frame = self.frames.compress(packed)
        self.sink.write(frame)
        self.ids.append(NO_ID if doc_id is None else doc_id)
        self.entries += struct.pack("<III", len(frame), len(packed), xxh64_intdigest(packed) & 0xFFFFFFFF)

    def close(self) -> None:
        names = self.frames.compress(np.array(self.ids, "<i8").tobytes())
        self.sink.write(struct.pack("<IIB", ID_MAGIC, len(names) + 1, self.width) + names)
        foot = struct.pack("<IBI", len(self.ids), 0x80, FOOT_MAGIC)
        self.sink.write(struct.pack("<II", SEEK_MAGIC, len(self.entries) + len(foot)) + bytes(self.entries) + foot)
        self.sink.close()


class Reader:
    """Random access to one file; reads the tail, then only the frames asked for."""

    def __init__(self, source):
        import zstandard

        self.source, self.frames = source, zstandard.ZstdDecompressor()
        size = source.size()
        n, descriptor, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
        if magic != FOOT_MAGIC or descriptor != 0x80:
            raise ValueError("no seek table")
        table = 12 * n
        at = size - 9 - table - 8
        magic, length = struct.unpack("<II", source.read_at(8, at))
        if magic != SEEK_MAGIC or length != table + 9:
            raise ValueError("damaged seek table")
        self.table = np.frombuffer(source.read_at(table, at + 8) if n else b"", "<u4").reshape(-1, 3)
        self.starts = np.concatenate(([0], np.cumsum(self.table[:, 0], dtype=np.int64)))
        body = int(self.starts[-1])
        magic, length, width = struct.unpack("<IIB", source.read_at(9, body))
        if magic != ID_MAGIC or width not in (2, 4):
            raise ValueError("no document ids")
        self.dtype = np.dtype(f"<u{width}")
        self.ids = np.frombuffer(self.frames.decompress(source.read_at(length - 1, body + 9)), "<i8")

    def __len__(self) -> int:
        return len(self.ids)

    def _checked(self, i: int, frame: bytes) -> np.ndarray:
        from xxhash import xxh64_intdigest

        packed = self.frames.decompress(frame, max_output_size=int(self.table[i, 1]))
        if len(packed) != self.table[i, 1] or xxh64_intdigest(packed) & 0xFFFFFFFF != self.table[i, 2]:
            raise ValueError(f"frame {i} is damaged")
        return np.frombuffer(packed, self.dtype)

    def document(self, i: int) -> np.ndarray:
        """Token ids of the file's i-th document."""
        return self._checked(i, self.source.read_at(int(self.table[i, 0]), int(self.starts[i])))

    def documents(self, most: int = 1 << 22) -> Iterator[np.ndarray]:
        """All documents in order, in reads of about `most` bytes."""
        i = 0
        while i < len(self):
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + most, "right")) - 1)
            part = self.source.read_at(int(self.starts[j] - self.starts[i]), int(self.starts[i]))
            for k in range(i, j):
                a = int(self.starts[k] - self.starts[i])
                yield self._checked(k, part[a : a + int(self.table[k, 0])])
            i = j


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of `summary` for files (part, path, n_docs, start).

    What a worker that is used again has learnt while the files were written is
    not needed any more: some hundred MB, which later stages may want.
    """
    _encoders.clear()
    for batch in batches:
        for row in batch.to_pylist():
            store, path = _store(row["path"])
            with store.open_input_file(path) as source:
                file = Reader(source)
                sizes = (file.table[:, 1] // file.dtype.itemsize).astype(np.int64)
                starts = row["start"] + np.concatenate(([0], np.cumsum(sizes)))[:-1]
                sums = np.fromiter((zlib.crc32(x.astype("<u4").tobytes()) for x in file.documents()), np.int64, len(file))
                none = file.ids == NO_ID
                yield pa.RecordBatch.from_arrays([pa.array(file.ids, pa.int64(), mask=none), pa.array(starts), pa.array(sizes), pa.array(sums)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


@dataclass(frozen=True)
class TokenCorpus:
    """A written corpus: one manifest row (part, path, n_docs, n_ids) for each file, in order."""

    spark: SparkSession
    manifest: list[tuple[int, str, int, int]]

    def files(self) -> DataFrame:
        """(part, path, n_docs, start): start counts the ids in all files before."""
        rows, total = [], 0
        for part, path, n_docs, n_ids in self.manifest:
            rows.append((part, path, n_docs, total))
            total += n_ids
        return self.spark.createDataFrame(rows, "part int, path string, n_docs long, start long")

    def summary(self) -> DataFrame:
        """Reads every file back: (doc_id, start, n_tokens, ids_crc32) for each document."""

        return self.files().repartitionById(max(1, len(self.manifest)), "part").mapInArrow(_summaries, "doc_id long, start long, n_tokens long, ids_crc32 long")

    def lookup(self, doc_ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
        """(doc_id, ids) of the documents asked for; only their frames are decompressed.

        doc_ids: distinct wanted ids, of any number.  They are joined with the
        positions in the files' id frames, never collected.
        """

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    store, path = _store(row["path"])
                    with store.open_input_file(path) as source:
                        ids = Reader(source).ids
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.arange(len(ids), dtype=np.int64)), pa.array([row["path"]] * len(ids), pa.string())], names=["doc_id", "pos", "path"])

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            path, file, source = None, None, None
            for batch in batches:
                for row in batch.to_pylist():
                    if row["path"] != path:
                        if source is not None:
                            source.close()
                        store, name = _store(row["path"])
                        path, source = row["path"], store.open_input_file(name)
                        file = Reader(source)
                    found = file.document(row["pos"]).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([row["doc_id"]]), pa.array([found.tolist()], pa.list_(pa.int64()))], names=["doc_id", "ids"])

        at = self.files().repartitionById(max(1, len(self.manifest)), "part").mapInArrow(places, "doc_id long, pos long, path string")
        wanted = at.join(doc_ids.select(F.col(id_col).cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
        return wanted.repartition("path").sortWithinPartitions("path", "pos").mapInArrow(fetch, "doc_id long, ids array<bigint>")


def write_tokens(
    docs: DataFrame,
    tokenizer: str,
    path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    files: int | None = None,
    level: int = 3,
    width: int | None = None,
    file_bytes: int = FILE_BYTES,
) -> TokenCorpus:
    """Encodes every text, appends end_id, and writes the files.

    tokenizer: a tokenizers JSON file that every executor can read.
    path: a new folder that all executors share; the scratch folder if unset.
    files: how many tasks write, with one file each or more; by default as many
    as shuffle partitions, or more if the input has over TASK_BYTES for each.
    width: bytes for each id; 2 if the vocabulary allows, else 4.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    folder = path or new_path(spark, "tokens")
    width = width or (2 if Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True) <= 1 << 16 and end_id < 1 << 16 else 4)
    if files is None:
        size = int(str(docs.select(id_col, text_col)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(size // TASK_BYTES, MOST_TASKS))
    kinds = pa.schema([("part", pa.int32()), ("piece", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        part, piece = task.partitionId(), 0
        encoder = end = writer = name = None
        n_docs = n_ids = 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"part": part, "piece": piece, "path": name, "n_docs": n_docs, "n_ids": n_ids}], schema=kinds)

        for batch in sliced(batches, 1, CHUNK):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            if texts and encoder is None:
                encoder = encoder_of(tokenizer, f"<u{width}")
                end = np.array([end_id], encoder.dtype).tobytes()
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode_many(texts) if texts else ()):
                if writer is None:
                    name = f"{folder}/part-{part:06d}-{task.taskAttemptId()}-{piece:04d}.zst"
                    store, where = _store(name)
                    store.create_dir(where.rpartition("/")[0], recursive=True)
                    writer, n_docs, n_ids = Writer(store.open_output_stream(where, compression=None), width, level), 0, 0
                writer.add(doc_id, ids + end)
                n_docs += 1
                n_ids += len(ids) // width + 1
                if n_ids * width >= file_bytes:
                    writer.close()
                    yield row()
                    writer, piece = None, piece + 1
        if writer is not None:
            writer.close()
            yield row()

    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text")).withColumn("n", F.monotonically_increasing_id())
    dealt = keyed.repartitionByRange(files, "id", "h", "n").sortWithinPartitions("id", "h", "n").select("id", "text")
    # one row for each file that was written
    manifest = sorted(tuple(r) for r in dealt.mapInArrow(run, "part int, piece int, path string, n_docs long, n_ids long").collect())
    return TokenCorpus(spark, [(i, *row[2:]) for i, row in enumerate(manifest)])
