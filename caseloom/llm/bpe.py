"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

A segmentation is the one BPE gives exactly if each token and each pair of
neighbours is left unchanged by BPE on its own.  So for every prefix of a
pre-token the last token is determined by the last tokens of shorter prefixes.
The non-deterministic machine guesses where the token that is being read began;
its live guesses are the positions from which the bytes read so far are a proper
prefix of a token.  A deterministic state holds, for each guess, the place in the
trie of tokens and the token before it, and is made when it is first reached.  A
transition names the last token of the prefix read so far; tokens leave when all
guesses share them, which is looked for every ``STRETCH`` bytes and at the end.

Defined results: a null or empty text has no ids and decodes to nothing; ids
that repeat, ties and repeated rows get equal output each; other columns of the
input are not read, so their names cannot clash.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import env_path, table
from .pretokens import Book, gathered, slices

DEFAULT_RANKS = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokens, states and pairs that a worker remembers.
MAX_WORDS, MAX_STATES, MAX_PAIRS = 500_000, 100_000, 200_000
#: Bytes after which tokens leave; the low bits of a packed number, which hold a rank.
STRETCH, LOW = 1024, (1 << 32) - 1


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    """bytes of one pre-token -> ids, one transition a byte.

    A state is a tuple of guesses, oldest first, each a number ``node << 32 | left``:
    the place in the trie of all tokens that the bytes since a possible token start
    lead to, and 1 + the token before it (0 at the start).  The last guess has just
    ended a token.
    """

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.child: dict[int, int] = {}  # node << 8 | byte -> node
        self.length = {rank: len(token) for token, rank in ranks.items()}
        self.ends, self.inner, self.depth = [-1], [True], [0]  # of nodes: the token that ends there, whether one goes on, its bytes
        for token, rank in ranks.items():
            node = 0
            for at, byte in enumerate(token, 1):
                self.inner[node] = True
                to = self.child.get(node << 8 | byte)
                if to is None:
                    to = self.child[node << 8 | byte] = len(self.ends)
                    self.ends.append(-1)
                    self.inner.append(False)
                    self.depth.append(at)
                node = to
            self.ends[node] = rank
        self._splits: dict[bytes, tuple[bytes, bytes] | None | bool] = {}
        self._pairs: dict[int, bool] = {}
        self._reset((0,))

    def _reset(self, state: tuple[int, ...]) -> int:
        """Forget all states but the start and ``state``; the number of ``state``."""
        self.ids, self.states = {(0,): 0}, [(0,)]
        self.steps: dict[int, int] = {}  # state << 8 | byte -> next state << 32 | last token
        return self._number(state)

    def _number(self, state: tuple[int, ...]) -> int:
        n = self.ids.setdefault(state, len(self.states))
        if n == len(self.states):
            self.states.append(state)
        return n

    def _split(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge makes ``token``; None for a byte; raises KeyError if BPE never makes it."""
        if token not in self._splits:
            parts, own = [token[i : i + 1] for i in range(len(token))], self.ranks[token]
            while len(parts) > 2:
                rank, i = min((self.ranks.get(a + b, own), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if rank >= own:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self._splits[token] = tuple(parts) if len(parts) == 2 else None if len(parts) == 1 else False
        if self._splits[token] is False:
            raise KeyError(token)
        return self._splits[token]

    def _kept_apart(self, x: bytes, y: bytes) -> bool:
        """Whether BPE leaves x and y as they are.

        Their merges are undone from the latest on; the ends that then touch must not
        have a merge that comes before the one undone (of equal ranks the left is first).
        """
        limit = 1 << 60
        while self.ranks.get(x + y, 1 << 60) >= limit or x + y not in self.ranks:
            rx, ry = self.ranks[x] if len(x) > 1 else -1, self.ranks[y] if len(y) > 1 else -1
            if rx < 0 and ry < 0:
                return True
            if rx > ry:
                x, limit = self._split(x)[1], rx
            else:
                y, limit = self._split(y)[0], ry + 1
        return False

    def _allowed(self, left: int, rank: int) -> bool:
        if len(self._pairs) > MAX_PAIRS:
            self._pairs.clear()
        token = self.tokens[rank]
        try:
            self._split(token)
            known = not left or self._kept_apart(self.tokens[left - 1], token)
        except KeyError:
            known = False
        self._pairs[left << 32 | rank] = known
        return known

    def _step(self, state: tuple[int, ...], byte: int) -> tuple[tuple[int, ...], int]:
        """The next state and the last token of what is read by then."""
        ended, alive, child, pairs, ends, inner = -1, [], self.child, self._pairs, self.ends, self.inner
        for guess in state:
            node = child.get(guess >> 32 << 8 | byte)
            if node is None:
                continue
            left = guess & LOW
            if ended < 0 and (rank := ends[node]) >= 0:
                known = pairs.get(left << 32 | rank)
                if self._allowed(left, rank) if known is None else known:
                    ended = rank
            if inner[node]:
                alive.append(node << 32 | left)
        if ended < 0:
            raise ValueError(f"the ranks lack byte {byte}")
        alive.append(ended + 1)
        return tuple(alive), ended

    def _shared(self, state: tuple[int, ...], last: list[int]) -> int:
        """The latest token boundary that all guesses of ``state`` have behind them."""
        at = {len(last) - self.depth[guess >> 32] for guess in state}
        while len(at) > 1:
            end = max(at)
            at.remove(end)
            at.add(end - self.length[last[end - 1]])
        return at.pop()

    def _tokens(self, last: list[int], end: int) -> list[int]:
        """The tokens up to ``end``, read backwards from the last one."""
        out = []
        while end:
            out.append(last[end - 1])
            end -= self.length[out[-1]]
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        at, last, out = 0, [], []
        for begin in range(0, len(piece), STRETCH):
            if begin:
                n = self._shared(self.states[at], last)
                out += self._tokens(last, n)
                del last[:n]
            if len(self.states) > self.max_states:
                at = self._reset(self.states[at])
            steps = self.steps
            for byte in piece[begin : begin + STRETCH]:
                key = at << 8 | byte
                step = steps.get(key)
                if step is None:
                    state, rank = self._step(self.states[at], byte)
                    step = steps[key] = self._number(state) << 32 | rank
                at = step >> 32
                last.append(step & LOW)
        return out + self._tokens(last, len(last))


class Utf8Stream:
    """An incremental UTF-8 state machine: ``feed`` returns the code points that are complete, the rest waits.

    The state is the number of continuation bytes still due and the bounds of the
    next one.  A byte that fits no sequence ends the open one at once; it and the
    bytes held so far come out as lone surrogates (U+DC80 on), so that encoding with
    ``surrogateescape`` gives the bytes back.
    """

    def __init__(self):
        self.held, self.due, self.low, self.high = b"", 0, 0x80, 0xBF

    def _step(self, byte: int) -> str:
        out = ""
        if self.due:
            if self.low <= byte <= self.high:
                self.held, self.due, self.low, self.high = self.held + bytes((byte,)), self.due - 1, 0x80, 0xBF
                return "" if self.due else self._take()
            out = self._take()
        if byte < 0x80:
            return out + chr(byte)
        if not 0xC2 <= byte <= 0xF4:
            return out + chr(0xDC00 + byte)
        self.held, self.due = bytes((byte,)), 1 + (byte >= 0xE0) + (byte >= 0xF0)
        self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(byte, 0x80)
        self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(byte, 0xBF)
        return out

    def _take(self) -> str:
        """The held bytes: a code point, or malformed ones."""
        held, whole = self.held, not self.due
        self.held, self.due, self.low, self.high = b"", 0, 0x80, 0xBF
        return held.decode() if whole else "".join(chr(0xDC00 + b) for b in held)

    @staticmethod
    def _open(tail: bytes) -> int:
        """Length of a sequence that may go on after the end of ``tail``."""
        for back in range(1, min(3, len(tail)) + 1):
            byte = tail[-back]
            if byte & 0xC0 == 0x80:
                continue
            due = 2 if byte & 0xE0 == 0xC0 else 3 if byte & 0xF0 == 0xE0 else 4 if byte & 0xF8 == 0xF0 else 1
            return back if due > back else 0
        return 0

    def feed(self, data: bytes) -> str:
        out, at = [], 0
        while self.due and at < len(data):
            out.append(self._step(data[at]))
            at += 1
        end = len(data) - self._open(data[max(at, len(data) - 3) :])
        try:
            out.append(data[at:end].decode())  # the machine's runs from code point to code point, at once
        except UnicodeDecodeError:
            out += map(self._step, data[at:end])
        out += map(self._step, data[end:])
        return "".join(out)

    def close(self) -> str:
        return self._take()


class Codec:
    """Encoder and decoder of one rank file; remembers frequent pre-tokens."""

    def __init__(self, path: str, pattern: str):
        ranks = load_ranks(path)
        by_rank = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            by_rank[rank] = token
        self.bytes = np.frombuffer(b"".join(by_rank), np.uint8)
        self.size = np.array([len(t) for t in by_rank])
        self.start = np.cumsum(self.size) - self.size
        machine = Transducer(ranks)
        self.book = Book(pattern, lambda words: [np.array(machine.encode(w.encode()), np.int32) for w in words], MAX_WORDS)

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``ids, ends`` of slices of the texts, in order."""
        for ids, ends, _ in self.book.of(texts):
            yield ids, ends

    def stream(self, ids: np.ndarray, size: int = 1 << 16) -> Iterator[str]:
        """The text of ids as it becomes complete."""
        state = Utf8Stream()
        for i in range(0, len(ids), size):
            part = ids[i : i + size]
            yield state.feed(gathered(self.bytes, self.start[part], self.size[part]).tobytes())
        yield state.close()

    def decode(self, ids: np.ndarray) -> bytes:
        return "".join(self.stream(ids)).encode("utf-8", "surrogateescape")


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs.clear()
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _pattern(pattern: str | None) -> str:
    if pattern is None:
        from public_tokenizers import PATTERN as pattern
    return pattern


def encode_documents(docs: DataFrame, ranks: str | None = None, pattern: str | None = None, decoded: bool = False) -> DataFrame:
    """``doc_id, ids array<int>``, with ``decoded`` also the bytes that the ids stand for.

    One pass without a shuffle; a worker's memory is bounded by MAX_WORDS and MAX_STATES.
    """
    path, pattern = ranks or env_path(DEFAULT_RANKS), _pattern(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, pattern)
        for batch in batches:
            for part in slices(batch):
                at = 0
                for ids, ends in tool.encode([t or "" for t in part.column(1).to_pylist()]):
                    edges = np.r_[0, ends].astype(np.int32)
                    cols = [part.column(0).slice(at, len(ends)), pa.ListArray.from_arrays(pa.array(edges), pa.array(ids))]
                    if decoded:
                        cols.append(pa.array([tool.decode(ids[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())], pa.binary()))
                    at += len(ends)
                    yield pa.RecordBatch.from_arrays(cols, names)

    names = ["doc_id", "ids", *["decoded"] * decoded]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>" + ", decoded binary" * decoded)


def decode_documents(ids: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id, ids`` -> ``doc_id, decoded binary``; null ids decode to nothing."""
    path, pattern = ranks or env_path(DEFAULT_RANKS), _pattern(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, pattern)
        for batch in batches:
            out = pa.array([tool.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), out], ["doc_id", "decoded"])

    kind = ids.schema["doc_id"].dataType.simpleString()
    return ids.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, decoded binary")


def digest(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_byte_bpe(spark, sf_dir) -> DataFrame:
    return digest(encode_documents(table(spark, sf_dir, "documents"), decoded=True))


QUERIES = {"op1_byte_bpe": op1_byte_bpe}
SQL: dict[str, str] = {}
