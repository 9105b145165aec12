"""Pre-tokens of many texts at once, and what is remembered of each distinct one.

The splitting pattern of the public rank files cuts a text by the classes of its
code points (white space, letter, number, other), so the cuts of a whole slice of
texts are found by comparing neighbours.  A pre-token is looked up by 64 bits of
hash; only distinct ones that a worker has not seen become strings.  Any other
pattern, and a text of more than ``LONGEST`` code points, is split by the pattern
itself and found by the same hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

from .hashing import prefix_sums, ranges

#: Code points of a slice of texts; a longer text is split by the pattern, in runs of PART pre-tokens.
SLICE, LONGEST, PART = 1 << 19, 1 << 22, 1 << 18
SPACE, LETTER, NUMBER, OTHER, END = range(5)

_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """Class of each code point, as the pattern's own library sees it."""
    global _classes
    if _classes is None:
        import regex

        every = "".join(map(chr, range(0xD800))) + chr(0xE000) * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
        out = np.full(0x110000, OTHER, np.uint8)
        for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, every):
                out[m.start() : m.end()] = kind
        _classes = out
    return _classes


def cut(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``joined, points, start, end, n``: the texts with a mark after each, pre-tokens as places there, their number by text."""
    joined = "\0".join([*texts, ""])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = classes()[points]
    marks = np.cumsum([len(t) + 1 for t in texts]) - 1
    kind[marks] = END
    fresh = np.r_[True, kind[1:] != kind[:-1]]
    blank = points == 32
    word = (kind != SPACE) & (kind != END)
    start = fresh.copy()
    start[1:] &= ~(word[1:] & blank[:-1])  # one blank before a word belongs to it
    start[:-1] |= (kind[:-1] == SPACE) & word[1:]  # the last of several white-space characters stands apart
    start[marks] = True
    at = np.flatnonzero(points[:-1] == 39)
    if len(at):  # 's 't 're 've 'm 'll 'd where a pre-token begins
        at = at[(kind[at + 1] == LETTER) & fresh[at] & ((at == 0) | ~blank[at - 1])]
        one, two = points[at + 1], points[np.minimum(at + 2, len(points) - 1)]
        is_ = lambda c: one == ord(c)
        short = is_("s") | is_("t") | is_("m") | is_("d")
        long = ((is_("r") | is_("v")) & (two == ord("e"))) | (is_("l") & (two == ord("l")))
        start[at[short | long] + 1] = False
        start[at[short] + 2] = True
        start[at[long] + 3] = True
    begin = np.flatnonzero(start)
    end = np.r_[begin[1:], len(points)]
    real = kind[begin] != END
    closed = np.cumsum(real)[~real]  # pre-tokens up to the end of each text
    return joined, points, begin[real], end[real], np.diff(np.r_[0, closed])


class Table:
    """Numbers by 64-bit hash: open addressing in two arrays, read and written for many hashes at once."""

    def __init__(self, bits: int = 16):
        self.bits, self.n = bits, 0
        self.keys, self.rows = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def _at(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 where it is new."""
        at = self._at(h)
        key = self.keys[at]
        hit = key == h
        out = np.where(hit, self.rows[at], -1)
        todo = np.flatnonzero(~hit & (key != 0))
        at = at[todo]
        while len(todo):
            at = (at + 1) & (len(self.keys) - 1)
            key = self.keys[at]
            hit = key == h[todo]
            out[todo[hit]] = self.rows[at[hit]]
            go = ~hit & (key != 0)
            todo, at = todo[go], at[go]
        return out

    def add(self, h: np.ndarray, rows: np.ndarray) -> None:
        """Distinct hashes that are not there."""
        if 2 * (self.n + len(h)) > len(self.keys):
            old = self.keys != 0
            bigger = Table(max(self.bits + 1, (2 * (self.n + len(h))).bit_length()))
            bigger.add(self.keys[old], self.rows[old])
            self.bits, self.keys, self.rows = bigger.bits, bigger.keys, bigger.rows
        self.n += len(h)
        at = self._at(h)
        while len(h):
            free = self.keys[at] == 0
            self.keys[at[free]] = h[free]
            won = self.keys[at] == h
            self.rows[at[won]] = rows[won]
            h, rows, at = h[~won], rows[~won], (at[~won] + 1) & (len(self.keys) - 1)


class Book:
    """Numbers (ids, counts) of distinct pre-tokens; ``make`` gives them for new ones.

    After ``limit`` of them it starts anew; results do not depend on it.
    """

    def __init__(self, pattern: str, make: Callable[[list[str]], Iterable[np.ndarray]], limit: int):
        import public_tokenizers
        import regex

        self.by_class = pattern == public_tokenizers.PATTERN
        self.finditer = regex.compile(pattern).finditer
        self.make, self.limit = make, limit
        self._clear()

    def _clear(self) -> None:
        self.table = Table()
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.size = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)

    @staticmethod
    def _grown(x: np.ndarray, n: int) -> np.ndarray:
        return x if len(x) >= n else np.concatenate([x, np.zeros(max(n, len(x) * 3 // 2) - len(x), x.dtype)])

    def _rows(self, h: np.ndarray, word: Callable[[int], str]) -> np.ndarray:
        """Place in the book of each hash; ``word(i)`` is the i-th pre-token."""
        if self.table.n > self.limit:
            self._clear()
        h = np.maximum(h, np.uint64(1))  # 0 marks a free place
        rows = self.table.find(h)
        miss = np.flatnonzero(rows < 0)
        if len(miss):
            kinds, first = np.unique(h[miss], return_index=True)
            found = list(self.make([word(i) for i in miss[first].tolist()]))
            sizes = np.array([len(x) for x in found])
            n, total = self.table.n, int(sizes.sum())
            self.pool = self._grown(self.pool, self.used + total)
            self.start, self.size = self._grown(self.start, n + len(kinds)), self._grown(self.size, n + len(kinds))
            self.pool[self.used : self.used + total] = np.concatenate(found)
            self.start[n : n + len(kinds)] = self.used + np.cumsum(sizes) - sizes
            self.size[n : n + len(kinds)] = sizes
            self.used += total
            self.table.add(kinds, np.arange(n, n + len(kinds), dtype=np.int32))
            rows[miss] = self.table.find(h[miss])
        return rows

    def _numbers(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All numbers end to end, and how many each pre-token has."""
        sizes = self.size[rows]
        return gathered(self.pool, self.start[rows], sizes), sizes

    def of(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``numbers, ends, n`` of slices of texts, in order: where each text's numbers end, its number of pre-tokens."""
        at = 0
        while at < len(texts):
            to, total = at + 1, len(texts[at])
            while to < len(texts) and total + len(texts[to]) <= SLICE:
                total += len(texts[to])
                to += 1
            if self.by_class and total <= LONGEST:
                joined, points, start, end, n = cut(texts[at:to])
                h = ranges(prefix_sums(points), start, end)
                numbers, sizes = self._numbers(self._rows(h, lambda i: joined[start[i] : end[i]]))
                yield numbers, np.r_[0, np.cumsum(sizes)][np.cumsum(n)], n
            else:
                for text in texts[at:to]:
                    numbers, n = self._long(text)
                    yield numbers, np.array([len(numbers)]), np.array([n])
            at = to

    def _long(self, text: str) -> tuple[np.ndarray, int]:
        out, n, held = [np.zeros(0, np.int32)], 0, []
        for m in self.finditer(text):
            held.append(m[0])
            if len(held) == PART:
                out.append(self._listed(held))
                n, held = n + len(held), []
        out.append(self._listed(held))
        return np.concatenate(out), n + len(held)

    def _listed(self, words: list[str]) -> np.ndarray:
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.diff(np.r_[0, ends])
        return self._numbers(self._rows(ranges(prefix_sums(points), ends - sizes, ends), words.__getitem__))[0]


def gathered(pool: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``pool[start : start + size]`` of every pair, end to end."""
    if not len(sizes):
        return pool[:0]
    ends = np.cumsum(sizes, dtype=np.int64)
    at = np.repeat(start - (ends - sizes), sizes)
    at += np.arange(ends[-1])
    return pool[at]


def slices(batch: pa.RecordBatch, column: int = 1, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of about ``size`` bytes of the text in ``column``, a row never split."""
    if not batch.num_rows:
        return
    texts = batch.column(column)
    text = texts.cast(pa.large_string()) if pa.types.is_string(texts.type) else texts
    sizes = np.diff(np.frombuffer(text.buffers()[1], np.int64, batch.num_rows + 1, text.offset * 8))
    begin = total = 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > size:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    yield batch.slice(begin)
