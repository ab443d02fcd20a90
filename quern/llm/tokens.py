"""Encoding a corpus with a public byte-level BPE vocabulary, without regular expressions.

Code points become classes, an automaton over the classes marks where pieces start, and its run over the text is an
associative scan of transition functions: blocks of characters are composed side by side, block results are scanned,
and the states then fill in. Pieces go through pair merging once and come from a cache afterwards.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import spread

IDS_SCHEMA = "doc_id bigint, ids array<int>"
OFFSETS_SCHEMA = "doc_id bigint, ids array<int>, starts array<int>"

# Character classes.
LETTER, DIGIT, OTHER, SPACE, BLANK, INNER_BLANK, SHORT_SUFFIX, LONG_SUFFIX = range(8)
# States: what the text so far left open.
NOTHING, IN_LETTERS, IN_DIGITS, IN_OTHER, AFTER_SPACE, IN_BLANKS, TWO_TO_GO, ONE_TO_GO = range(8)
# White space beyond category Z of Unicode; the letters of English contractions.
WHITE = "\t\n\x0b\x0c\r\x85"
SUFFIXES_1, SUFFIXES_2 = "stmd", ("re", "ve", "ll")


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a piece starts) by state and class; classes + 8 are those of a text's first character."""
    go, start = np.zeros((16, 8), np.uint8), np.zeros((16, 8), bool)
    for first in (False, True):
        for state in range(8):
            s = NOTHING if first else state
            plain = {LETTER: IN_LETTERS, DIGIT: IN_DIGITS, OTHER: IN_OTHER}
            for cls in range(8):
                if cls in plain:
                    to, new = plain[cls], s not in (plain[cls], AFTER_SPACE)
                    if s in (TWO_TO_GO, ONE_TO_GO):
                        to, new = (ONE_TO_GO if s == TWO_TO_GO else NOTHING), False
                elif cls == SPACE:
                    to, new = AFTER_SPACE, True
                elif cls == BLANK:
                    to, new = NOTHING, True
                elif cls == INNER_BLANK:
                    to, new = IN_BLANKS, s != IN_BLANKS
                elif s in (IN_OTHER, AFTER_SPACE):
                    to, new = IN_OTHER, False
                else:
                    to, new = (ONE_TO_GO if cls == SHORT_SUFFIX else TWO_TO_GO), True
                go[cls + 8 * first, state], start[cls + 8 * first, state] = to, new
    return go, start


GO, START = _tables()
_KINDS: np.ndarray | None = None


def _kinds() -> np.ndarray:
    """Class of every code point before its neighbours are looked at."""
    global _KINDS
    if _KINDS is None:
        by = {"L": LETTER, "N": DIGIT, "Z": BLANK}
        k = np.array([by.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)], np.uint8)
        k[[ord(c) for c in WHITE]] = BLANK
        _KINDS = k
    return _KINDS


def classes(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Automaton classes of concatenated texts; first marks where a text begins."""
    c = _kinds()[points].copy()
    n = len(c)
    ends = np.append(first[1:], True)
    blank = c == BLANK
    last = blank.copy()
    last[:-1] &= ~blank[1:] | ends[:-1]
    followed = last & ~ends
    c[blank] = INNER_BLANK
    c[followed] = BLANK
    c[followed & (points == 32)] = SPACE
    quotes = np.flatnonzero(points == 39)
    for q in (quotes[~ends[quotes]],):
        one = points[q + 1]
        c[q[np.isin(one, [ord(x) for x in SUFFIXES_1])]] = SHORT_SUFFIX
        q2 = q[q + 2 < n]
        q2 = q2[~ends[q2 + 1]]
        a, b = points[q2 + 1], points[q2 + 2]
        long = np.zeros(len(q2), bool)
        for x, y in SUFFIXES_2:
            long |= (a == ord(x)) & (b == ord(y))
        c[q2[long]] = LONG_SUFFIX
    return c + 8 * first.astype(np.uint8)


def states_before(cls: np.ndarray, block: int = 64) -> np.ndarray:
    """The automaton's state before every character: an exclusive scan of transition functions."""
    n = len(cls)
    if not n:
        return np.zeros(0, np.uint8)
    nb = -(-n // block)
    padded = np.zeros(nb * block, np.uint8)
    padded[:n] = cls
    grid = padded.reshape(nb, block)
    whole = np.tile(np.arange(8, dtype=np.uint8), (nb, 1))
    for k in range(block):
        whole = GO[grid[:, k, None], whole]
    enter = _enter(whole, block)
    out = np.empty((nb, block), np.uint8)
    for k in range(block):
        out[:, k] = enter
        enter = GO[grid[:, k], enter]
    return out.reshape(-1)[:n]


def _enter(functions: np.ndarray, block: int) -> np.ndarray:
    """State before each of the given functions (one row each), from state 0: the same scan, one level up."""
    n = len(functions)
    if n <= block:
        out, s = np.empty(n, np.uint8), 0
        for i in range(n):
            out[i] = s
            s = functions[i, s]
        return out
    nb = -(-n // block)
    padded = np.tile(np.arange(8, dtype=np.uint8), (nb * block, 1))
    padded[:n] = functions
    grid = padded.reshape(nb, block, 8)
    rows = np.arange(nb)
    whole = np.tile(np.arange(8, dtype=np.uint8), (nb, 1))
    for k in range(block):
        whole = grid[rows[:, None], k, whole]
    enter = _enter(whole, block)
    out = np.empty((nb, block), np.uint8)
    for k in range(block):
        out[:, k] = enter
        enter = grid[rows, k, enter]
    return out.reshape(-1)[:n]


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions at which a piece starts in concatenated texts."""
    cls = classes(points, first)
    return np.flatnonzero(START[cls, states_before(cls)])


def read_ranks(path: str) -> dict[bytes, int]:
    """Vocabulary of a file with one base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_pairs(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of a piece: neighbours that make the lowest ranked token merge first, the leftmost of equals.

    A heap of pairs over a linked list: a piece of n bytes takes n log n steps, whatever its length.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return (whole,)
    n = len(piece)
    ends = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    alive = [True] * n

    def pair(i: int) -> tuple[int, int, int, int] | None:
        j = ends[i]
        if j >= n:
            return None
        r = ranks.get(piece[i : ends[j]])
        return None if r is None else (r, i, j, ends[j])

    heap = [p for p in map(pair, range(n)) if p]
    heapq.heapify(heap)
    while heap:
        _, i, j, end = heapq.heappop(heap)
        if not alive[i] or ends[i] != j or j >= n or not alive[j] or ends[j] != end:
            continue
        alive[j] = False
        ends[i] = end
        if end < n:
            before[end] = i
        for k in (i, before[i]):
            if k >= 0 and (p := pair(k)):
                heapq.heappush(heap, p)
    return tuple(ranks[piece[i : ends[i]]] for i in range(n) if alive[i])


class Encoder:
    """Encodes lists of texts; keeps the ids of pieces it has seen, at most `remember` of them."""

    def __init__(self, ranks: dict[bytes, int], remember: int = 400_000):
        self.ranks, self.remember = ranks, remember
        self.cache: dict[str, tuple[int, ...]] = {}

    def ids_of(self, piece: str) -> tuple[int, ...]:
        ids = self.cache.get(piece)
        if ids is None:
            ids = merge_pairs(piece.encode(), self.ranks)
            if len(self.cache) >= self.remember:
                self.cache.clear()
            if len(piece) <= 256:
                self.cache[piece] = ids
        return ids

    def flat(self, texts: list[str | None]) -> tuple[array, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts on end, how many each piece has, the pieces' starts within all texts, pieces before each text)."""
        full = "".join(t for t in texts if t)
        sizes = np.array([len(t) if t else 0 for t in texts], np.int64)
        if not full:
            return array("i"), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        points = np.frombuffer(full.encode("utf-32-le"), np.uint32)
        at = np.append(0, np.cumsum(sizes))
        first = np.zeros(len(points), bool)
        first[at[:-1][sizes > 0]] = True
        starts = piece_starts(points, first)
        where = starts.tolist()
        pieces = [full[i:j] for i, j in zip(where, [*where[1:], len(full)])]
        found = list(map(self.cache.get, pieces))
        for k in [k for k, own in enumerate(found) if own is None]:
            found[k] = self.ids_of(pieces[k])
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return array("i", chain.from_iterable(found)), counts, starts, np.searchsorted(starts, at)

    def encode(self, texts: list[str | None]) -> Iterator[tuple[list[int], list[int]]]:
        """(ids, code point offset of the piece that each id belongs to) of each text; none for null and empty ones."""
        ids, counts, starts, pieces = self.flat(texts)
        ends = np.append(0, np.cumsum(counts))[pieces].tolist()
        base = 0
        for k, t in enumerate(texts):
            own = slice(pieces[k], pieces[k + 1])
            yield ids[ends[k] : ends[k + 1]].tolist(), np.repeat(starts[own] - base, counts[own]).tolist()
            base += len(t or "")


def decode(ids: list[int], tokens: dict[int, bytes]) -> str:
    return b"".join(tokens[i] for i in ids).decode("utf-8", "replace")


def _groups(texts: list[str | None], most: int = 1_000_000) -> Iterator[list[str | None]]:
    """Runs of texts of about `most` code points; a longer text is a run of its own."""
    run: list[str | None] = []
    size = 0
    for t in texts:
        if run and size + len(t or "") > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t or "")
    if run:
        yield run


_ENCODERS: dict[int, Encoder] = {}


def _batches(shared, key: int, offsets: bool):
    def run(batches):
        import pyarrow as pa

        encoder = _ENCODERS.get(key)
        if encoder is None:
            _ENCODERS.clear()
            encoder = _ENCODERS[key] = Encoder(shared.value)
        def lists(parts: list, ends: list):
            values = pa.array(np.concatenate([np.frombuffer(p, np.int32) if isinstance(p, array) else p.astype(np.int32) for p in parts] or [np.zeros(0, np.int32)]))
            return pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(ends)), pa.int64()), values).cast(pa.list_(pa.int32()))

        for b in batches:
            ids, starts, ends = [], [], []
            for group in _groups(b.column(1).to_pylist()):
                flat, counts, at, pieces = encoder.flat(group)
                ids.append(flat)
                ends += np.diff(np.append(0, np.cumsum(counts))[pieces]).tolist()
                if offsets:
                    base = np.repeat(np.cumsum([0, *(len(t or "") for t in group)])[:-1], np.diff(pieces))
                    starts.append(np.repeat(at - base, counts))
            columns = [pa.array(b.column(0).to_pylist(), pa.int64()), lists(ids, ends)] + ([lists(starts, ends)] if offsets else [])
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "starts"][: len(columns)])

    return run


def encode_corpus(documents: DataFrame, vocabulary: str, offsets: bool = False) -> DataFrame:
    """doc_id, ids (and starts): the ids of every document by the byte-level BPE vocabulary file.

    Strings of special tokens in a text are ordinary text. Null and empty texts give an empty list; every document has
    one row. starts has, for each id, the code point at which its piece begins in the text: the ids from one start
    to the next decode to that slice exactly. Texts of any length are encoded whole; the time of a single piece of n
    bytes grows as n log n. The vocabulary (0.8 MB here, fixed by the file) is read by the driver and broadcast. No
    shuffle but for tables of fewer splits than cores: a scan with one Arrow step.
    """
    ranks = read_ranks(vocabulary)
    shared = documents.sparkSession.sparkContext.broadcast(ranks)
    rows = spread(documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")))
    return rows.mapInArrow(_batches(shared, hash(vocabulary), offsets), OFFSETS_SCHEMA if offsets else IDS_SCHEMA)
