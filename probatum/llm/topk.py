"""Exact top-k search by the threshold algorithm over sorted per-dimension lists.

Candidates are dealt into blocks, queries into blocks too, and every query block meets every candidate block once. In
a candidate block each dimension has a list of its vectors sorted by that component. A query walks all lists from the
end that its own component favours, some rows of every list at a time; each vector met for the first time is scored in
full. No vector not met yet can score more than the sum of the query's components times the values the lists have come
to, so the walk stops when that bound is below the k-th best score (equal is not enough: ties go to the smaller id).
The best k of all blocks are merged by partial aggregation.

Stated cases: vectors that are null, of another length than the first dimension count given, or hold a null or
non-finite component take no part, nor do rows without an id; rows with the same id are different candidates, but none
of them is a candidate of a query with that id; with fewer than k candidates all are returned; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probatum.llm.common import typed
from probatum.session import cut_lineage

BLOCK = 4_096  # candidates of a block
QUERIES = 1_024  # queries of a block
STRIDE = 32  # rows of every list that a step of the walk takes


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, as bigint; null where a component is null or not finite."""
    clean = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(clean, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


class Lists:
    """The sorted lists of one candidate block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order].astype(np.float64)
        self.order = np.argsort(self.vectors, axis=0, kind="stable")  # column d: rows in rising order of component d
        self.values = np.take_along_axis(self.vectors, self.order, axis=0)

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the k best, exact."""
        n = len(self.ids)
        used = np.flatnonzero(query)
        best_s, best_i = np.zeros(0), np.zeros(0, np.int64)
        met = np.zeros(n, bool)
        met[self.ids == query_id] = True
        weight, falling = query[used], query[used] > 0
        at = 0
        while at < n:
            stop = min(n, at + STRIDE)
            if len(used):
                rows = np.where(falling, self.order[n - stop : n - at, used], self.order[at:stop, used]).ravel()
            else:
                rows = np.arange(at, stop)  # every score is 0, so the smaller ids win
            new = np.unique(rows[~met[rows]])
            met[new] = True
            scores = np.append(best_s, self.vectors[new] @ query)
            ids = np.append(best_i, self.ids[new])
            top = np.lexsort((ids, -scores))[:k]
            best_s, best_i = scores[top], ids[top]
            at = stop
            if at < n:
                reached = np.where(falling, self.values[n - at - 1, used], self.values[at, used])
                if len(best_s) == k and (weight @ reached < best_s[-1] or not len(used)):
                    break
        return best_s, best_i


def top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row that meets ``queries``, its k best among all other rows.

    ``vectors`` has vec_id and embedding. Scores are inner products of the scaled integer vectors.
    """
    whole = typed(vectors, vec_id="bigint", embedding="array<double>").filter("vec_id is not null")
    clean = whole.select("vec_id", scaled(F.col("embedding"), scale).alias("v")).filter("v is not null and size(v) > 0")
    clean = cut_lineage(clean)
    rows, asked = clean.agg(F.count(F.lit(1)), F.count_if(queries)).first()
    many, few = max(1, -(-rows // BLOCK)), max(1, -(-asked // QUERIES))
    spread = F.xxhash64("vec_id", F.lit(1))
    right = clean.select("vec_id", "v", F.pmod(spread, F.lit(many)).alias("c"), F.explode(F.sequence(F.lit(0), F.lit(few - 1))).alias("q"), F.lit(False).alias("asks"))
    left = clean.filter(queries).select("vec_id", "v", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(many - 1).cast("bigint"))).alias("c"), F.pmod(spread, F.lit(few)).cast("int").alias("q"), F.lit(True).alias("asks"))

    def work(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        ids = table.column("vec_id").to_numpy()
        flat = table.column("v").combine_chunks()
        sizes = np.diff(flat.offsets.to_numpy())
        values = flat.flatten().to_numpy()
        out: list[list[np.ndarray]] = [[], [], []]
        for width in np.unique(sizes):  # vectors of different lengths don't compare
            mine = sizes == width
            block = values[np.repeat(mine, sizes)].reshape(-1, width)
            a, i = asks[mine], ids[mine]
            if a.any() and not a.all():
                lists = Lists(i[~a], block[~a])
                for query_id, query in zip(i[a], block[a].astype(np.float64), strict=True):
                    s, found = lists.search(query_id, query, k)
                    out[0].append(np.full(len(s), query_id))
                    out[1].append(found)
                    out[2].append(s.astype(np.int64))
        columns = [pa.array(np.concatenate(o) if o else np.zeros(0, np.int64), pa.int64()) for o in out]
        return pa.table(columns, names=["query_id", "vec_id", "score"])

    found = left.unionByName(right).groupBy("c", "q").applyInArrow(work, "query_id bigint, vec_id bigint, score bigint")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
