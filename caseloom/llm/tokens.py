"""Token counts by dynamic programming over a trie of distinct pre-tokens.

A unigram model scores a pre-token by its best segmentation.  The best score of
a prefix depends on the prefix alone, so distinct pre-tokens are put into a trie
and each node is scored once: from the scores of its ancestors and the pieces
that end there.  A terminal node stores the number of pieces of the best
segmentation (fewest pieces among equal scores).

The model: pieces with a rank get the score -log(rank + 1) of Zipf's law, as
the public rank files carry no probabilities; every single byte is a piece.

Defined results: a null or empty text has no pre-tokens and no tokens; repeated
rows and rows that share an id are counted alike, each on its own; an empty table
gives no rows; further columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _pattern, load_ranks
from .common import env_path, table
from .pretokens import Book, slices

DEFAULT_RANKS = "byte_bpe_50k.tiktoken"
#: Nodes after which a worker starts a new trie; results do not depend on it.
MAX_NODES = 700_000
#: Bytes of a pre-token that can share nodes.
SHARED = 512


class SharedTrie:
    """Nodes are numbers; a node holds the score and pieces of the best segmentation of its prefix.

    A pre-token is shared down to SHARED bytes; what lies deeper is scored without nodes.
    """

    def __init__(self, scores: dict[bytes, float], max_nodes: int = MAX_NODES):
        self.scores, self.max_nodes = scores, max_nodes
        # a suffix of length n can be a piece only if its last three bytes end such a piece
        ends: dict[bytes, set[int]] = {}
        for piece in scores:
            if len(piece) > 2:
                ends.setdefault(piece[-3:], set()).add(len(piece))
        self.ends = {k: tuple(sorted(v)) for k, v in ends.items()}
        self.longest = max(map(len, scores))
        self._reset()

    def _reset(self) -> None:
        self.children: dict[int, int] = {}
        self.nodes: list[tuple[float, int]] = [(0.0, 0)]

    def _score(self, word: bytes, end: int, best: list[tuple[float, int]]) -> tuple[float, int]:
        """Of word[:end], from the scores of its shorter prefixes."""
        scores = self.scores
        score, pieces = best[-1]
        score += scores[word[end - 1 : end]]
        pieces += 1
        if end > 1:
            own = scores.get(word[end - 2 : end])
            if own is not None:
                before, k = best[end - 2]
                if before + own > score or before + own == score and k < pieces:
                    score, pieces = before + own, k + 1
            for size in self.ends.get(word[end - 3 : end], ()) if end > 2 else ():
                if size > end:
                    break
                own = scores.get(word[end - size : end])
                if own is not None:
                    before, k = best[end - size]
                    if before + own > score or before + own == score and k < pieces:
                        score, pieces = before + own, k + 1
        return score, pieces

    def count(self, word: bytes) -> int:
        if len(self.nodes) > self.max_nodes:
            self._reset()
        node, path = 0, [self.nodes[0]]
        for end, byte in enumerate(word[:SHARED], 1):
            to = self.children.get(node << 8 | byte)
            if to is None:
                to = self.children[node << 8 | byte] = len(self.nodes)
                self.nodes.append(self._score(word, end, path))
            node = to
            path.append(self.nodes[node])
        for end in range(SHARED + 1, len(word) + 1):
            path.append(self._score(word, end, path))
        return path[-1][1]


def unigram_scores(path: str) -> dict[bytes, float]:
    return {piece: -math.log(rank + 1) for piece, rank in load_ranks(path).items()}


_books: dict[tuple[str, str], Book] = {}


def _book(path: str, pattern: str) -> Book:
    """Pieces of distinct pre-tokens, counted by a trie that the worker keeps."""
    if (path, pattern) not in _books:
        trie = SharedTrie(unigram_scores(path))
        _books.clear()
        _books[path, pattern] = Book(pattern, lambda words: [np.array([trie.count(w.encode())], np.int32) for w in words], MAX_NODES)
    return _books[path, pattern]


def token_counts(docs: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id, n_pretokens, n_tokens``; one pass, no shuffle, bounded memory."""
    path, pattern = ranks or env_path(DEFAULT_RANKS), _pattern(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = _book(path, pattern)
        for batch in batches:
            for part in slices(batch):
                at = 0
                for counts, ends, n in book.of([t or "" for t in part.column(1).to_pylist()]):
                    pieces = np.diff(np.r_[0, np.cumsum(counts, dtype=np.int64)][np.r_[0, ends]])
                    cols = [part.column(0).slice(at, len(ends)), pa.array(n.astype(np.int64)), pa.array(pieces)]
                    at += len(ends)
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_pretokens", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_pretokens long, n_tokens long")


def op8_token_counts(spark, sf_dir) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


QUERIES = {"op8_token_counts": op8_token_counts}
SQL: dict[str, str] = {}
