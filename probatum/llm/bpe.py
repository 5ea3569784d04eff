"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding by retained offsets.

Pre-tokenisation uses no regular expression. Every code point gets a class from an array; each class is a
transition function on the eight states of a small automaton, and composing such functions is associative. The
closure of the functions under composition is a table of small integers, so the state before every code point
comes from a prefix scan over table look-ups: inside blocks side by side, then over the blocks. State and class
tell where a piece begins.

A piece's ids come from a bounded cache. The pieces of a batch that are not cached are merged together: one
array row per piece, the lowest-ranked pair of each row replaced per step.

Stated cases: a null text encodes as an empty one (no ids); texts of any length are cut at places where a piece
always begins, so memory follows the cut, not the text; repeated rows give repeated rows; an empty table gives an
empty result; other columns are ignored unless named in ``keep``, and a kept column whose name clashes with an
output is dropped for the output.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StructField, StructType

from probatum.llm.common import col, slices

OTHER, LETTER, NUMBER, SPACE = range(4)

# White space of the pattern's \s, and letters and numbers assigned after the tables of this Python.
WHITE = [(0x9, 0xD), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029),
         (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
LATER_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
    (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
LATER_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
                 (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]

CUT_CHARS = 1 << 17  # a long text is scanned in cuts of about this many code points
SLICE_BYTES = 1 << 18  # of a batch, so many bytes of text or offsets are worked on at once
DECODE_IDS = 1 << 16  # ids decoded at once
MERGE_CELLS = 200_000  # bytes of pieces merged together
CACHE_PIECES = 140_000
LONG_PIECE = 256  # bytes; longer pieces are merged one by one, with a heap


@lru_cache(1)
def codepoint_classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for c in range(0x110000):
        if (k := unicodedata.category(chr(c))[0]) in kinds:
            out[c] = kinds[k]
    for ranges, k in ((LATER_LETTERS, LETTER), (LATER_NUMBERS, NUMBER), (WHITE, SPACE)):
        for a, b in ranges:
            out[a : b + 1] = k
    return out


# Symbols: what a code point does to the automaton. Two code points of look-ahead are part of the symbol.
# APO1, APO2: an apostrophe with one or two letters of a contraction behind it; BLANK: white space with white space or
# the end behind it; LEAD: a plain space with anything else behind it; LONE: any other such white space; BEGIN: the
# same as a plain code point of that class, at the start of a text.
S_OTHER, S_LETTER, S_NUMBER, S_BLANK, S_LEAD, S_LONE, S_APO1, S_APO2 = range(8)
# States: what the current piece may take up. FRESH: nothing; AFTER: anything that is not white space; ONE, TWO: that
# many letters of a contraction.
FRESH, IN_OTHER, IN_LETTER, IN_NUMBER, IN_BLANK, AFTER, ONE, TWO = range(8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether the code point begins a piece."""
    if state == TWO:
        return ONE, False
    if state == ONE:
        return FRESH, False
    if symbol == S_LETTER:
        return IN_LETTER, state not in (IN_LETTER, AFTER)
    if symbol == S_NUMBER:
        return IN_NUMBER, state not in (IN_NUMBER, AFTER)
    if symbol == S_BLANK:
        return IN_BLANK, state != IN_BLANK
    if symbol == S_LEAD:
        return AFTER, True
    if symbol == S_LONE:
        return FRESH, True
    if symbol == S_OTHER or state in (IN_OTHER, AFTER):
        return IN_OTHER, state not in (IN_OTHER, AFTER)
    return (ONE if symbol == S_APO1 else TWO), True


@lru_cache(1)
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """The closure of the symbols' transition functions under composition.

    Returns (element of a symbol, element of a symbol at a text's start, product table, element to state, one).
    The second forgets what came before: a constant function.
    """
    def plain(y: int) -> tuple[int, ...]:
        return tuple(_step(s, y)[0] for s in range(8))

    first = [(_step(FRESH, y)[0],) * 8 for y in range(8)]
    known: dict[tuple[int, ...], int] = {tuple(range(8)): 0}
    generators = [plain(y) for y in range(8)] + first
    queue = [tuple(range(8))]
    while queue:
        f = queue.pop()
        for g in generators:
            h = tuple(g[s] for s in f)  # f, then g
            if h not in known:
                known[h] = len(known)
                queue.append(h)
    functions = list(known)
    kind = np.uint8 if len(functions) <= 256 else np.uint16
    table = np.array([[known[tuple(g[s] for s in f)] for g in functions] for f in functions], kind)
    state = np.array([f[FRESH] for f in functions], np.uint8)
    return (np.array([known[g] for g in generators[:8]], kind), np.array([known[g] for g in first], kind), table, state, 0)


@lru_cache(1)
def _begins() -> np.ndarray:
    return np.array([[_step(s, y)[1] for y in range(8)] for s in range(8)])


def _scan(elements: np.ndarray, table: np.ndarray, one: int) -> np.ndarray:
    """Inclusive prefix products: blocks side by side, then the same over the blocks' products."""
    n = len(elements)
    if n <= 64:
        out = elements.copy()
        for i in range(1, n):
            out[i] = table[out[i - 1], out[i]]
        return out
    width = min(256, max(8, int(n ** 0.5)))
    blocks = -(-n // width)
    grid = np.full((blocks * width), one, elements.dtype)
    grid[:n] = elements
    grid = np.ascontiguousarray(grid.reshape(blocks, width).T)  # row i: the i-th element of every block
    flat, k = table.ravel(), table.shape[0]
    for i in range(1, width):
        grid[i] = flat[grid[i - 1].astype(np.int32) * k + grid[i]]
    before = np.empty(blocks, elements.dtype)
    before[0] = one
    if blocks > 1:
        before[1:] = _scan(np.ascontiguousarray(grid[-1, :-1]), table, one)
    grid = flat[before.astype(np.int32)[None, :] * k + grid]
    return np.ascontiguousarray(grid.T).ravel()[:n]


def piece_starts(points: np.ndarray, text_start: np.ndarray) -> np.ndarray:
    """True where a piece begins. points: code points of texts set end to end; text_start: True at a text's first."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    kinds = codepoint_classes()[points]
    last = np.empty(n, bool)  # a text's last code point
    last[:-1] = text_start[1:]
    last[-1] = True
    symbol = np.array([S_OTHER, S_LETTER, S_NUMBER, S_BLANK], np.uint8)[kinds]
    white = kinds == SPACE
    ahead = np.empty(n, bool)  # text that is not white space follows
    ahead[:-1] = ~white[1:]
    ahead[-1] = False
    ahead &= ~last & white
    symbol[ahead] = np.where(points[ahead] == 0x20, S_LEAD, S_LONE)
    apostrophe = np.flatnonzero((points == 0x27) & ~last)
    if len(apostrophe):
        a = points[apostrophe + 1]
        symbol[apostrophe[np.isin(a, [ord(c) for c in "stmd"])]] = S_APO1
        two = (apostrophe + 2 < n) & ~last[apostrophe + 1]
        b = points[np.minimum(apostrophe + 2, n - 1)]
        pair = np.zeros(len(apostrophe), bool)
        for x, y in ("re", "ve", "ll"):
            pair |= (a == ord(x)) & (b == ord(y))
        symbol[apostrophe[pair & two]] = S_APO2
    of_symbol, of_first, table, state_of, one = monoid()
    elements = np.where(text_start, of_first[symbol], of_symbol[symbol])
    after = state_of[_scan(elements, table, one)]
    before = np.empty(n, np.uint8)
    before[0] = FRESH
    before[1:] = after[:-1]
    before[text_start] = FRESH
    return _begins()[before, symbol]


class Merger:
    """Ids of byte pieces by merge ranks, with a bounded cache. Ranks: bytes to id, every single byte among them."""

    def __init__(self, ranks: dict[bytes, int], cache_pieces: int = CACHE_PIECES) -> None:
        self.ranks, self.cache, self.older, self.cache_pieces = ranks, {}, {}, cache_pieces
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.values = np.append(np.array(values, np.int64)[order], 0)
        self.none = np.int64(np.iinfo(np.int32).max)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        want = (a << 32) | b
        at = np.searchsorted(self.keys, want)
        return np.where(self.keys[at] == want, self.values[at], self.none)

    def _together(self, pieces: list[bytes]) -> list[bytes]:
        """Pieces of one length, all merged at once."""
        n, width = len(pieces), len(pieces[0])
        ids = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8).reshape(n, width)]
        size = np.full(n, width)
        if width > 1:
            ranks = np.full((n, width), self.none)
            ranks[:, :-1] = self.pair_ranks(ids[:, :-1], ids[:, 1:])
            rows = np.arange(n)
            columns = np.arange(width)
            while len(rows):
                best = ranks[rows].argmin(axis=1)
                low = ranks[rows, best]
                live = low < self.none
                rows, best, low = rows[live], best[live], low[live]
                if not len(rows):
                    break
                # drop the pair's right half: everything behind it moves one place to the left
                ids[rows, best] = low
                source = np.minimum(columns[None, :] + (columns[None, :] > best[:, None]), width - 1)
                ids[rows] = ids[rows[:, None], source]
                ranks[rows] = ranks[rows[:, None], source]
                size[rows] -= 1
                has_right = best + 1 < size[rows]
                ranks[rows, best] = np.where(
                    has_right, self.pair_ranks(low, ids[rows, np.minimum(best + 1, width - 1)]), self.none)
                left = best > 0
                ranks[rows[left], best[left] - 1] = self.pair_ranks(ids[rows[left], best[left] - 1], low[left])
                ranks[rows, size[rows] - 1] = self.none
        packed = ids.astype("<u4").tobytes()
        return [packed[4 * width * i : 4 * (width * i + s)] for i, s in enumerate(size.tolist())]

    def _alone(self, piece: bytes) -> bytes:
        """One long piece: a heap of pairs over a linked list."""
        import heapq

        ids = [self.ranks[piece[i : i + 1]] for i in range(len(piece))]
        n = len(ids)
        right, left, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        pair = {int(k): int(v) for k, v in zip(self.keys[:-1], self.values[:-1], strict=True)} if not hasattr(self, "_pair") else self._pair
        self._pair = pair
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pair.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], alive[j], right[i] = r, False, right[j]
            if right[j] < n:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (s := pair.get(ids[x] << 32 | ids[y])) is not None:
                    heapq.heappush(heap, (s, x, ids[x], ids[y]))
        return np.array([t for t, ok in zip(ids, alive, strict=True) if ok], "<u4").tobytes()

    def learn(self, pieces: Iterable[bytes]) -> dict[bytes, bytes]:
        """Ids of pieces that are not cached, as packed little-endian unsigned 32-bit integers."""
        by_length: dict[int, list[bytes]] = {}
        found: dict[bytes, bytes] = {}
        for p in pieces:
            if (whole := self.ranks.get(p)) is not None:
                found[p] = whole.to_bytes(4, "little")
            elif len(p) > LONG_PIECE:
                found[p] = self._alone(p)
            else:
                by_length.setdefault(len(p), []).append(p)
        for group in by_length.values():
            most = max(1, MERGE_CELLS // len(group[0]))
            for k in range(0, len(group), most):
                part = group[k : k + most]
                found.update(zip(part, self._together(part), strict=True))
        return found

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        wanted = set(pieces)
        missing = wanted.difference(self.cache)
        if len(self.cache) + len(missing) > self.cache_pieces // 2:  # what is still in use comes back from the older half
            self.older, self.cache, missing = self.cache, {}, wanted
        known = {p: self.older[p] for p in missing if p in self.older}
        self.cache.update(known)
        self.cache.update(self.learn(missing.difference(known)))
        cache = self.cache
        return [cache[p] for p in pieces]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _cuts(points: np.ndarray) -> list[int]:
    """Cuts of a text at plain spaces between two code points that are no white space: a piece begins at each."""
    out, n = [0], len(points)
    while n - out[-1] > CUT_CHARS:
        at = out[-1] + CUT_CHARS
        while at < n:
            window = points[at : at + 4096 + 1]
            kinds = codepoint_classes()[window]
            good = np.flatnonzero((window[:-1] == 0x20) & (kinds[1:] != SPACE))
            if len(good):
                out.append(at + int(good[0]))
                break
            at += 4096
        else:
            break
    return [*out, n]


def _encode_texts(texts: list[str], merger: Merger) -> Iterator[bytes]:
    """Packed ids of each text."""
    raw = "".join(texts).encode("utf-32-le", "surrogatepass")
    points = np.frombuffer(raw, "<u4")
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    text_start = np.zeros(len(points), bool)
    text_start[starts[:-1][lengths > 0]] = True
    begins = piece_starts(points, text_start)
    data = "".join(texts).encode("utf-8", "surrogatepass")
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    at = np.concatenate([[0], np.cumsum(width)])  # byte offset of every code point
    firsts = np.flatnonzero(begins)
    cut = at[firsts].tolist()
    pieces = [data[a:b] for a, b in zip(cut, [*cut[1:], len(data)], strict=True)] if cut else []
    packed = merger.encode(pieces)
    bounds = np.searchsorted(firsts, starts).tolist()
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield b"".join(packed[a:b])


class Vocabulary:
    """Bytes of every id, end to end, for decoding."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        top = max(ranks.values()) + 1
        by_id = [b""] * top
        for token, i in ranks.items():
            by_id[i] = token
        self.length = np.array([len(t) for t in by_id], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.data = np.frombuffer(b"".join(by_id), np.uint8)

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """End offset of every id in the decoded bytes."""
        return np.cumsum(self.length[ids])

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> bytes:
        """Every id's bytes set at its offset, ``DECODE_IDS`` ids at once."""
        out, done = [], 0
        for k in range(0, len(ids), DECODE_IDS):
            some, at = ids[k : k + DECODE_IDS], ends[k : k + DECODE_IDS].astype(np.int64)
            length = self.length[some]
            begin = at - length - done
            out.append(self.data[np.repeat(self.start[some] - begin, length) + np.arange(int(at[-1]) - done)].tobytes())
            done = int(at[-1])
        return b"".join(out)


def _ranks_on(df: DataFrame, ranks_path: str):
    """The rank file goes to the tasks as a broadcast: a vocabulary has a fixed size."""
    return df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))


_TOOLS: dict[str, object] = {}


def _tool(kind, name: str, shared):
    """One per Python worker and vocabulary, so that the cache lives as long as the worker."""
    key = f"{kind.__name__}:{name}"
    if key not in _TOOLS:
        _TOOLS[key] = kind(shared.value)
    return _TOOLS[key]


def _groups(texts: list[str]) -> Iterator[list[int]]:
    """Runs of texts of about CUT_CHARS code points; a longer text is a run of its own."""
    run, size = [], 0
    for i, t in enumerate(texts):
        if run and size + len(t) > CUT_CHARS:
            yield run
            run, size = [], 0
        run.append(i)
        size += len(t)
    if run:
        yield run


def encode(df: DataFrame, ranks_path: str, text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Columns ``keep``, ``token_ids`` and ``token_ends``.

    ``token_ids`` are the ids as packed little-endian unsigned 32-bit integers, ``token_ends`` the end of every id in
    the text's UTF-8 bytes in the same form. Two binary columns move between Python and Spark without a list per row.
    """
    shared = _ranks_on(df, ranks_path)
    names = [c for c in keep if c.lower() not in ("token_ids", "token_ends")]
    source = df.select(*map(col, names), col(text).cast("string").alias("__text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger, vocabulary = _tool(Merger, ranks_path, shared), _tool(Vocabulary, ranks_path, shared)
        for batch in slices(batches, -1, SLICE_BYTES):
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            ids: list[bytes] = []
            for run in _groups(texts):
                if len(run) == 1 and len(texts[run[0]]) > CUT_CHARS:
                    long = texts[run[0]]
                    cuts = _cuts(np.frombuffer(long.encode("utf-32-le", "surrogatepass"), "<u4"))
                    ids.append(b"".join(next(_encode_texts([long[a:b]], merger)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)))
                else:
                    ids += _encode_texts([texts[i] for i in run], merger)
            ends = [vocabulary.ends(np.frombuffer(x, "<u4")).astype("<u4").tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(ids, pa.binary()), pa.array(ends, pa.binary())],
                names=[*batch.schema.names[:-1], "token_ids", "token_ends"])

    schema = StructType([*source.schema.fields[:-1], StructField("token_ids", BinaryType()), StructField("token_ends", BinaryType())])
    return source.mapInArrow(work, schema)


def decode(df: DataFrame, ranks_path: str, keep: Sequence[str] = ()) -> DataFrame:
    """Columns ``keep`` and ``decoded``, the bytes of ``token_ids`` set at ``token_ends``; null ids give no bytes."""
    shared = _ranks_on(df, ranks_path)
    names = [c for c in keep if c.lower() not in ("decoded",)]
    source = df.select(*map(col, names), col("token_ids").alias("__ids"), col("token_ends").alias("__ends"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _tool(Vocabulary, ranks_path, shared)
        for batch in slices(batches, -1, SLICE_BYTES):
            ids, ends = (batch.column(batch.num_columns - k).to_pylist() for k in (2, 1))
            out = [vocabulary.decode(np.frombuffer(i or b"", "<u4"), np.frombuffer(e or b"", "<u4"))
                   for i, e in zip(ids, ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(out, pa.binary())], names=[*batch.schema.names[:-2], "decoded"])

    return source.mapInArrow(work, StructType([*source.schema.fields[:-2], StructField("decoded", BinaryType())]))
