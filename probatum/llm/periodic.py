"""Periodic run detection by string synchronising sets.

A run is a stretch of words with smallest period q, at least 2 * q long, that no neighbouring word extends. All runs of
all texts of a slice of rows are found together, exactly:

1. Periods under 3 * ``FIRST`` are read off directly: stretches where the words q apart are equal.
2. For each dyadic scale t (``FIRST``, twice that, ...) the words of every stretch of t get a name, equal for equal
   stretches only. Stretches of a period of at most t / 3 are taken out; they lie in runs found before. A position
   belongs to the synchronising set if the smallest hashed name among the t + 1 stretches beginning there stands first
   or last. Whether it does depends on the 2 * t words from there on alone, so copies choose the same positions, and only
   highly periodic stretches of 3 * t words are free of positions.
3. Positions with equal 2 * t words, 3 * t to 6 * t apart, propose their distance as a period. Equal stretches around a
   position are over t / 3 apart, so a position meets a bounded number of others.
4. A run of such a period that holds no such pair has two halves with one small period each: two runs found before that
   touch or overlap by less than their period. Their phases leave one remainder of the period; its members are proposed.
5. A proposal is extended both ways by names of falling length and stays if it covers two periods.

Time grows as n log n, memory as 8 bytes a word and scale, for one text at least: a text is never cut.

Stated cases: a null or empty text has no words and no run; repeated rows and ids are rows of their own; ties between
runs of one length go to the smaller start, then the smaller period; an empty table gives an empty result; clashing
column names: the kept columns stay, the operator's own (n_words, runs, collapsed) replace theirs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatum.llm.common import col, slices, without

FIRST = 4  # smallest scale
SHORTEST = 12  # words of a run at least
SLICE = 1 << 20  # bytes of text that a task looks at together, if no text is longer
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _mixed(names: np.ndarray) -> np.ndarray:
    """A one-to-one hash of names, so that the choice of positions does not follow the order of the words."""
    x = names.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _doubled(names: np.ndarray, width: int) -> np.ndarray:
    """Names of stretches twice as wide."""
    if len(names) <= width:
        return np.zeros(0, np.int64)
    pair = names[:-width] * (int(names.max()) + 1) + names[width:]
    return pd.factorize(pair)[0].astype(np.int64)


class Names:
    """Names of all stretches of 1, 2, 4, ... words; longer ones only of the leading, longer texts."""

    def __init__(self, words: np.ndarray) -> None:
        self.levels = [words]

    def extend(self, level: int, end: int) -> None:
        while len(self.levels) <= level:
            width = 1 << (len(self.levels) - 1)
            self.levels.append(_doubled(self.levels[-1][: max(0, end - width + 1)], width))

    def common(self, a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
        """Number of equal words from a and b on (before a and b, if ``back``); a < b."""
        a, b, start = a.copy(), b.copy(), a
        top = len(self.levels) - 1
        live = np.arange(len(a))
        for level in [top] * (len(a) > 0) + list(range(top - 1, -1, -1)):
            names, width = self.levels[level], 1 << level
            at = live if level == top else np.arange(len(a))
            while len(at):
                x, y = (a[at] - width, b[at] - width) if back else (a[at], b[at])
                fits = x >= 0 if back else y < len(names)
                fits[fits] = names[x[fits]] == names[y[fits]]
                at = at[fits]
                a[at] += -width if back else width
                b[at] += -width if back else width
                if level < top:
                    break
        return np.abs(a - start)


def _unique(found: np.ndarray) -> np.ndarray:
    """Rows (start, end, period): of one stretch only the smallest period, by start and end."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    return found[new]


def _direct(words: np.ndarray, period: int) -> np.ndarray:
    equal = np.zeros(max(0, len(words) - period) + 2, np.int8)
    equal[1:-1] = words[period:] == words[:-period] if len(words) > period else 0
    turns = np.flatnonzero(np.diff(equal))
    start, end = turns[::2], turns[1::2]
    long = end - start >= period
    return np.stack([start[long], end[long] + period, np.full(long.sum(), period)], axis=1)


def _positions(names: np.ndarray, scale: int, periodic: np.ndarray) -> np.ndarray:
    """The synchronising set; ``periodic``: runs with a period of at most a third of the scale."""
    ids = _mixed(names)
    marks = np.zeros(len(ids) + 1, np.int64)
    np.add.at(marks, periodic[:, 0], 1)
    np.add.at(marks, periodic[:, 1] - scale + 1, -1)
    last = np.uint64(0xFFFFFFFFFFFFFFFF)
    ids[np.cumsum(marks[:-1]) > 0] = last
    if len(ids) <= scale:
        return np.zeros(0, np.int64)
    least, width = ids, 1
    while width < scale:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:-1], least[1:])
    return np.flatnonzero((least != last) & ((ids[:-scale] == least) | (ids[scale:] == least)))


def _pairs(positions: np.ndarray, context: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, distance) of equal contexts 3 to 6 scales apart."""
    positions = positions[positions < len(context)]
    order = np.argsort(context[positions], kind="stable")
    at, key = positions[order], context[positions][order]
    out: list[list[np.ndarray]] = [[], []]
    live, step = np.arange(len(at)), 1
    while True:
        live = live[live + step < len(at)]
        gap = at[live + step] - at[live]
        near = (key[live + step] == key[live]) & (gap < 6 * scale)
        live, gap = live[near], gap[near]
        if not len(live):
            break
        far = gap >= 3 * scale
        out[0].append(at[live[far]])
        out[1].append(gap[far])
        step += 1
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *out[0]]), np.concatenate([empty, *out[1]])


def _halves(words: np.ndarray, runs: np.ndarray, scale: int) -> tuple[list[int], list[int]]:
    """(position, period) of runs whose halves lie in two touching runs of one small period."""
    long = runs[runs[:, 1] - runs[:, 0] >= 3 * scale]
    long = long[np.lexsort((long[:, 0], long[:, 2]))]
    near = np.flatnonzero((long[1:, 2] == long[:-1, 2]) & (long[1:, 0] <= long[:-1, 1]))
    places: list[int] = []
    periods: list[int] = []
    for (b, r, q), (b2, r2, _) in zip(long[near].tolist(), long[near + 1].tolist(), strict=True):
        target = words[r - q : r].tobytes()
        room, shift = words[b2 : b2 + 2 * q].tobytes(), 0
        while (shift := room.find(target, shift)) % words.itemsize and shift >= 0:
            shift += 1
        if shift < 0:
            continue
        rest = (b2 + shift // words.itemsize - (r - q)) % q
        first = 3 * scale + (rest - 3 * scale) % q
        for p in range(first, min(6 * scale - 1, r - b, r2 - b2, (r2 - b) // 2) + 1, q):
            places.append(max(b, b2 - p))
            periods.append(p)
    return places, periods


def find_runs(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All runs as rows (start, end, period).

    ``words`` holds texts one after another, longest first, each followed by a word of its own that occurs nowhere
    else; ``lengths`` their words.
    """
    found = [np.zeros((0, 3), np.int64)]
    closed = np.cumsum(lengths + 1)  # end of each text, its closing word included

    def leading(least: int) -> int:
        """Words of the texts of at least so many words."""
        many = np.searchsorted(-lengths, -least, side="right")
        return int(closed[many - 1]) if many else 0

    for period in range(1, 3 * FIRST):
        found.append(_direct(words[: leading(2 * period)], period))
    runs = _unique(np.concatenate(found))
    names, scale = Names(words), FIRST
    while len(lengths) and 6 * scale <= lengths[0]:
        end, level = leading(6 * scale), scale.bit_length() - 1
        names.extend(level + 1, end)
        own = names.levels[level][: max(0, end - scale + 1)]
        small = runs[(runs[:, 2] <= scale // 3) & (runs[:, 1] - runs[:, 0] >= scale) & (runs[:, 0] < end)]
        place, period = _pairs(_positions(own, scale, small), names.levels[level + 1], scale)
        # neighbours of one period whose 2 * scale equal words overlap stand for one stretch
        order = np.lexsort((place, period))
        place, period = place[order], period[order]
        first = np.ones(len(place), bool)
        first[1:] = (period[1:] != period[:-1]) | (place[1:] > place[:-1] + 2 * scale)
        more = _halves(words, small, scale)
        place = np.concatenate([place[first], np.array(more[0], np.int64)])
        period = np.concatenate([period[first], np.array(more[1], np.int64)])
        start = place - names.common(place, place + period, back=True)
        stop = place + period + names.common(place, place + period)
        whole = stop - start >= 2 * period
        if whole.any():
            runs = _unique(np.concatenate([runs, np.stack([start[whole], stop[whole], period[whole]], axis=1)]))
        scale *= 2
    return runs


def _slice_runs(texts: Sequence[bytes | None]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text, and the runs of at least ``SHORTEST`` words with the text that each belongs to."""
    split = [t.split() if t else [] for t in texts]  # bytes split at the six ASCII white-space characters only
    lengths = np.array([len(s) for s in split], np.int64)
    order = np.argsort(-lengths, kind="stable")
    ids = pa.array([w for k in order for w in split[k]], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    lengths = lengths[order]
    starts = np.cumsum(lengths + 1) - lengths - 1
    words = np.empty(len(ids) + len(split), np.int64)
    closing = np.zeros(len(words), bool)
    closing[starts + lengths] = True
    words[~closing] = ids
    words[closing] = len(ids) + np.arange(len(split))
    runs = find_runs(words, lengths)
    runs = runs[runs[:, 1] - runs[:, 0] >= SHORTEST]
    text = np.searchsorted(starts, runs[:, 0], side="right") - 1
    runs = np.stack([runs[:, 0] - starts[text], runs[:, 1] - starts[text], runs[:, 2]], axis=1)
    return split, runs, order[text]


def repeated_runs(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The kept columns and n_words, runs (by start, then period) and collapsed of every text.

    ``collapsed`` joins by one space the words that no run contains after its first period.
    """
    named = without(docs.select(*[col(k) for k in keep]), "n_words", "runs", "collapsed")
    rows = docs.select(*[col(c) for c in named.columns], col("text").cast("string").cast("binary").alias("__text"))
    at = len(named.columns)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices([whole], at, SLICE)):
            split, runs, owner = _slice_runs(batch.column(at).to_pylist())
            order = np.lexsort((runs[:, 2], runs[:, 0], owner))
            runs, owner = runs[order], owner[order]
            bounds = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            collapsed = []
            for k, words in enumerate(split):
                if bounds[k] < bounds[k + 1]:
                    cover = np.zeros(len(words) + 1, np.int64)
                    mine = runs[bounds[k] : bounds[k + 1]]
                    np.add.at(cover, mine[:, 0] + mine[:, 2], 1)
                    np.add.at(cover, mine[:, 1], -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]
                collapsed.append(b" ".join(words))
            flat = pa.StructArray.from_arrays(
                [pa.array(runs[:, 0]), pa.array(runs[:, 1] - runs[:, 0]), pa.array(runs[:, 2])], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:at], pa.array([len(s) for s in split], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), flat), pa.array(collapsed, pa.binary()).view(pa.string())],
                names=[*batch.schema.names[:at], "n_words", "runs", "collapsed"])

    kinds = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in named.schema.fields]
    return rows.mapInArrow(work, ", ".join([*kinds, "n_words bigint", f"runs {RUNS}", "collapsed string"]))


def longest_run(runs) -> F.Column:
    """Of an array of runs the longest one, ties to the smaller start, then period; null without a run."""
    ranked = F.transform(runs, lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"), r.alias("r")))
    return F.array_min(ranked)["r"]
