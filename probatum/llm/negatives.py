"""Hard negatives by lists that the anchors of a cluster share.

Anchors are dealt into blocks, candidates into blocks, and every anchor block meets every candidate block once. There the
anchors are clustered by direction. For each cluster the candidates are sorted once by an upper bound on their score with
any member: no candidate forms a smaller angle with a member than its angle to the centre less the widest angle of the
cluster. Every member walks the list until the bound falls below what could still enter its result.

Two such walks follow each other. The first finds an anchor's positives, its best rows of the same label; clusters and
lists are those of one label. The second takes, for each positive, the best rows of other labels whose score lies between a
share of the positive's score and that score; the share ends the walk even where too few rows qualify. Results of the
blocks are merged by rank.

Scores are inner products of floor(scale * x); higher scores come first, ties by smaller vec_id. They are exact in doubles
while products sum to less than 2^53, and are taken in 64-bit integers beyond.

Stated cases: rows without an id, a label or a vector, with an empty vector or with a null or non-finite component take no
part; vectors of different lengths do not meet; rows that share an id are rows of their own, each an anchor if its id is
one; an anchor without positives, or a positive without a row in its band (such as one of negative score), has no rows;
labels compare as text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probatum.llm.common import typed
from probatum.llm.topk import scaled
from probatum.session import cut_lineage

VALUES = 1 << 21  # components of a candidate block
ANCHORS = 1_024  # anchors of a block
MEMBERS = 64  # anchors of a cluster, about
STRIDE = 256  # rows of the list that the first step of a walk takes; every further step takes twice as many
SLACK = 1e-9  # of the product of the norms, for rounding in the bounds


def clusters(unit: np.ndarray, count: int, rounds: int = 5) -> list[np.ndarray]:
    """Rows of unit vectors in groups of similar direction."""
    centres = unit[np.linspace(0, len(unit) - 1, count).astype(int)]
    for _ in range(rounds):
        near = np.argmax(unit @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, unit)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-300), centres)
    near = np.argmax(unit @ centres.T, axis=1)
    return [np.flatnonzero(near == c) for c in np.unique(near)]


def _units(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = vectors.astype(np.float64)
    norms = np.linalg.norm(x, axis=1)
    return x / np.maximum(norms, 1e-300)[:, None], norms


def shared_lists(anchors: np.ndarray, candidates: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(members, candidate order, bounds): a member's score with order[i:] is at most its norm times bounds[i], and slack."""
    unit, _ = _units(anchors)
    other, norms = _units(candidates)
    for members in clusters(unit, max(1, len(anchors) // MEMBERS)):
        centre = unit[members].sum(axis=0)
        centre /= max(np.linalg.norm(centre), 1e-300)
        widest = np.arccos(np.clip((unit[members] @ centre).min(), -1, 1))
        angle = np.arccos(np.clip(other @ centre, -1, 1))
        # widened against rounding of the arc cosine, which is coarse near 0
        bound = norms * np.cos(np.maximum(0, angle - widest - 1e-7))
        order = np.argsort(-bound, kind="stable")
        yield members, order, bound[order]


def _best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((rows, ids, -scores))[:k]


class Kept:
    """The best k of one result while its list is walked; ``floor`` and ``ceiling`` bound the scores that count."""

    def __init__(self, k: int, floor: float = -np.inf, ceiling: float = np.inf) -> None:
        self.k, self.floor, self.ceiling = k, floor, ceiling
        self.scores, self.ids, self.rows = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def take(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        fits = (scores >= self.floor) & (scores <= self.ceiling)
        if len(self.scores) == self.k:
            fits &= scores >= self.scores[-1]
        if fits.any():
            s, i, r = np.append(self.scores, scores[fits]), np.append(self.ids, ids[fits]), np.append(self.rows, rows[fits])
            top = _best(s, i, r, self.k)
            self.scores, self.ids, self.rows = s[top], i[top], r[top]

    def needs(self) -> float:
        """No row of a smaller score can enter."""
        return max(self.floor, self.scores[-1] if len(self.scores) == self.k else -np.inf)


def walk(anchors: np.ndarray, own: np.ndarray, candidates: np.ndarray, ids: np.ndarray, rows: np.ndarray,
         results: list[list[Kept]]) -> None:
    """Fill every anchor's results; ``own`` and ``rows`` tell a row from itself."""
    _, anchor_norms = _units(anchors)
    _, norms = _units(candidates)
    slack = SLACK * anchor_norms * norms.max(initial=0) + SLACK
    top = max(float(np.abs(anchors).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * anchors.shape[1], 0)
    kind = np.float64 if top < 2**53 else np.int64
    left, right = anchors.astype(kind), candidates.astype(kind)
    for members, order, bound in shared_lists(anchors, candidates):
        live, at, step = members, 0, STRIDE
        while at < len(order):
            live = live[[any(r.needs() <= anchor_norms[m] * bound[at] + slack[m] for r in results[m]) for m in live]]
            if not len(live):
                break
            part = order[at : at + step]
            scores = left[live] @ right[part].T
            for m, s in zip(live, scores, strict=True):
                other = rows[part] != own[m]
                for r in results[m]:
                    r.take(s[other], ids[part][other], rows[part][other])
            at, step = at + step, 2 * step


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, flat values) of a list column."""
    flat = column.combine_chunks()
    return np.diff(flat.offsets.to_numpy()), flat.flatten().to_numpy()


def _blocks(anchors: DataFrame, rows: DataFrame, many: int, few: int) -> DataFrame:
    """Anchors (with ``needs``, null for candidates) and candidates of every block pair (c, q)."""
    spread = F.xxhash64("row")
    left = anchors.select("row", "vec_id", "label", "v", "needs", F.pmod(spread, F.lit(few)).alias("q"),
                          F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(many - 1).cast("bigint"))).alias("c"))
    right = rows.select("row", "vec_id", "label", "v", F.lit(None).cast("array<bigint>").alias("needs"),
                        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(few - 1).cast("bigint"))).alias("q"),
                        F.pmod(spread, F.lit(many)).alias("c"))
    return left.unionByName(right)


def _sides(table: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
    """For each length of vectors: anchor indices, candidate indices, and all vectors as a matrix by index."""
    asks = table.column("needs").is_valid().to_numpy()
    sizes, values = _matrix(table.column("v"))
    starts = np.cumsum(sizes) - sizes
    for width in np.unique(sizes):
        mine = np.flatnonzero(sizes == width)
        a, c = mine[asks[mine]], mine[~asks[mine]]
        if len(a) and len(c):
            yield a, c, values[starts[a][:, None] + np.arange(width)], values[starts[c][:, None] + np.arange(width)]


def _table(parts: list[tuple], names: list[str]) -> pa.Table:
    columns = zip(*parts, strict=True) if parts else [[]] * len(names)
    return pa.table([pa.array(np.concatenate([np.zeros(0, np.int64), *c]).astype(np.int64)) for c in columns], names=names)


def hard_negatives(
    vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, percent: int = 80, scale: int = 256
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` has vec_id, label and embedding; ``anchors`` picks the anchors. Negatives score at least ``percent`` of
    the positive's score and no more than it.
    """
    whole = typed(vectors, vec_id="bigint", label="string", embedding="array<double>")
    clean = whole.filter("vec_id is not null and label is not null").select("vec_id", "label", scaled(F.col("embedding"), scale).alias("v"))
    # the checkpoint fixes the row numbers
    rows = cut_lineage(clean.filter("v is not null and size(v) > 0").withColumn("row", F.monotonically_increasing_id()))
    count, asked, width = rows.agg(F.count(F.lit(1)), F.count_if(anchors), F.max(F.size("v"))).first()
    many = max(1, -(-count * (width or 1) // VALUES))
    few = max(1, -(-asked // ANCHORS))
    chosen = rows.filter(anchors)

    def same_label(table: pa.Table) -> pa.Table:
        ids, row = table.column("vec_id").to_numpy(), table.column("row").to_numpy()
        label = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        out = []
        for a, c, left, right in _sides(table):
            for which in np.unique(label[a]):
                x, y = np.flatnonzero(label[a] == which), np.flatnonzero(label[c] == which)
                if not len(y):
                    continue
                results = [[Kept(positives)] for _ in x]
                walk(left[x], row[a[x]], right[y], ids[c[y]], row[c[y]], results)
                out += [(np.full(len(r.ids), anchor), r.ids, r.rows, r.scores) for anchor, (r,) in zip(row[a[x]], results, strict=True)]
        return _table(out, ["anchor", "vec_id", "row", "score"])

    kind = "anchor bigint, vec_id bigint, row bigint, score bigint"
    first = _blocks(chosen.withColumn("needs", F.array().cast("array<bigint>")), rows, many, few)
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id", "row")
    near = first.groupBy("c", "q").applyInArrow(same_label, kind).withColumn("n", F.row_number().over(best))
    near = cut_lineage(near.filter(F.col("n") <= positives))

    def other_labels(table: pa.Table) -> pa.Table:
        ids, row = table.column("vec_id").to_numpy(), table.column("row").to_numpy()
        label = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        needs = table.column("needs")
        out = []
        for a, c, left, right in _sides(table):
            wanted = [sorted(set(needs[int(i)].as_py())) for i in a]
            results = [[Kept(negatives, -(-percent * p // 100), p) for p in w] for w in wanted]
            for which in np.unique(label[a]):
                x, y = np.flatnonzero(label[a] == which), np.flatnonzero(label[c] != which)
                if len(y):
                    walk(left[x], row[a[x]], right[y], ids[c[y]], row[c[y]], [results[i] for i in x])
            for anchor, w, kept in zip(row[a], wanted, results, strict=True):
                out += [(np.full(len(r.ids), anchor), np.full(len(r.ids), p), r.ids, r.rows, r.scores) for p, r in zip(w, kept, strict=True)]
        return _table(out, ["anchor", "positive_score", "vec_id", "row", "score"])

    needs = near.filter("score >= 0").groupBy("anchor").agg(F.collect_set("score").alias("needs"))
    second = _blocks(chosen.join(needs, chosen["row"] == needs["anchor"]), rows, many, few)
    best = Window.partitionBy("anchor", "positive_score").orderBy(F.desc("score"), "vec_id", "row")
    far = second.groupBy("c", "q").applyInArrow(other_labels, "anchor bigint, positive_score bigint, vec_id bigint, row bigint, score bigint")
    far = far.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
    pairs = near.select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = chosen.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return (
        pairs.join(far, ["anchor", "positive_score"]).join(named, "anchor")
        .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )
