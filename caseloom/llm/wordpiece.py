"""Word-piece counts by a linear longest-match automaton.

Greedy word pieces take from a word, again and again, the longest piece of the
vocabulary that the rest begins with.  The automaton (a trie of all pieces with
failure links) reads each byte once: where the trie has no edge, the failure
link leads to the node of what remains after popping the pieces that greedy
matching would have taken, and how many these are was computed with the link.
So the number of pieces comes out in time linear in the word, and no piece is
ever built.

Words are runs without ASCII white space.  A word's first piece is from the
vocabulary of beginnings, the others from that of continuations; a word that
can't be cut counts as one unknown piece.

Cases: a null or empty text has no words; repeated rows each count; very long
words are read like others, but not kept; empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.blocks import sliced, utf8
from caseloom.llm.kept import Kept

#: Words of each of two generations kept with their counts in a worker, and the longest such word.
WORDS, WORD_BYTES = 150_000, 64
#: Bytes of text counted in one step.
CHUNK = 1 << 20


class Automaton:
    """Nodes are numbers; edge[node << 8 | byte] is the next node; link[node] and popped[node] are its failure."""

    START, REST, DEAD = 0, 1, -1

    def __init__(self, starts: Iterable[bytes], rests: Iterable[bytes]):
        self.edge: dict[int, int] = {}
        ends = [False, False]
        for root, pieces in ((self.START, starts), (self.REST, rests)):
            for piece in pieces:
                if not piece:
                    continue
                node = root
                for byte in piece:
                    key = node << 8 | byte
                    if (further := self.edge.get(key)) is None:
                        further = self.edge[key] = len(ends)
                        ends.append(False)
                    node = further
                ends[node] = True
        self._links(ends)

    def _links(self, ends: list[bool]) -> None:
        children: dict[int, list[tuple[int, int]]] = {}
        for key, node in self.edge.items():
            children.setdefault(key >> 8, []).append((key & 255, node))
        link, popped, edge = [self.DEAD] * len(ends), [0] * len(ends), self.edge
        todo = deque((self.START, self.REST))
        while todo:  # nearer nodes first, so the links of what a link passes are known
            node = todo.popleft()
            for byte, child in children.get(node, ()):
                todo.append(child)
                if ends[child]:
                    link[child], popped[child] = self.REST, 1
                    continue
                at, count = link[node], popped[node]
                while at != self.DEAD and (at << 8 | byte) not in edge:
                    at, count = link[at], count + popped[at]
                if at != self.DEAD:
                    link[child], popped[child] = edge[at << 8 | byte], count
        self.link, self.popped = link, popped

    def count(self, word: bytes) -> int:
        """How many pieces greedy longest matching cuts the word into; 1 if it can't."""
        edge, link, popped = self.edge, self.link, self.popped
        node, total = self.START, 0
        for byte in word:
            while (further := edge.get(node << 8 | byte)) is None:
                total += popped[node]
                node = link[node]
                if node == self.DEAD:
                    return 1
            node = further
        while node != self.REST:
            total += popped[node]
            node = link[node]
            if node == self.DEAD:
                return 1
        return total


_automata: dict[tuple[str, bytes], Automaton] = {}


def automaton_of(path: str, mark: bytes = b" ") -> Automaton:
    """The automaton of a vocabulary file with a base64 piece and a rank on each line.

    Pieces that begin with `mark` are beginnings, without it; pieces without
    the mark in them are continuations.  A word that no marked piece begins
    starts with the mark alone, which is then a piece of its own.
    """
    if (path, mark) not in _automata:
        with open(path, "rb") as lines:
            pieces = [base64.b64decode(line.split()[0]) for line in lines if line.strip()]
        _automata[path, mark] = Automaton([p for p in pieces if p.startswith(mark)], [p for p in pieces if mark not in p])
    return _automata[path, mark]


class Counter:
    """Counts words with a vocabulary, keeping the counts of frequent ones."""

    def __init__(self, automaton: Automaton, mark: bytes):
        self.count, self.mark, self.words = automaton.count, mark, Kept(WORDS)

    def totals(self, texts: list[bytes]) -> list[tuple[int, int]]:
        """(words, pieces) of each text."""
        cut = [t.split() for t in texts]
        kept, long = self.words.young, []
        for word in self.words.missing(set().union(*cut)):
            kept[word] = self.count(self.mark + word)
            if len(word) > WORD_BYTES:
                long.append(word)
        known = kept.__getitem__
        out = [(len(words), sum(map(known, words))) for words in cut]
        for word in long:
            del kept[word]
        self.words.turn()
        return out


_counters: dict[tuple[str, bytes], Counter] = {}


def piece_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", mark: bytes = b" ") -> DataFrame:
    """(id, n_words, n_tokens) for each row.

    vocabulary: a file for automaton_of that every executor can read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (vocabulary, mark) not in _counters:
            _counters[vocabulary, mark] = Counter(automaton_of(vocabulary, mark), mark)
        counter = _counters[vocabulary, mark]
        for batch in sliced(batches, 1, CHUNK):
            data, offsets = utf8(batch.column(1))
            raw = data.tobytes()
            got = np.array(counter.totals([raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got[:, 0]), pa.array(got[:, 1])], names=["id", "n_words", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_words long, n_tokens long")
