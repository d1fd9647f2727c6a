"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Rows are dealt to blocks once; queries come to every block in batches. In a block each dimension's values are cut into levels; a
level's rows are a posting segment, whose impact for a query is the largest contribution, by size, that it can make. Segments are
processed by descending impact, each adding its rows' contributions to their accumulators. What a row still lacks is bounded by the
lengths of the query and of the row in the dimensions that are not processed for that row (Cauchy and Schwarz). Processing stops
once that proves all but a few rows out; the rest, the possible members, are scored exactly.

Components are whole numbers held as doubles, which is exact at any size. Rows and queries whose squared length reaches 2**52 (and
whose scores doubles or longs might not hold) take a path of their own: sums in doubles with a proven error bound leave the possible
members, which are scored in unbounded integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._store import partitions

LEVELS, SMALLEST = 16, 4096  #: levels of a dimension; rows of which a block is not split to keep more tasks busy
STEPS = 24  #: attempts at a proof, at most
PLAIN = 2.0**52  #: squared lengths below which all scores, and their sums, are exact doubles
LONG = 2**63 - 1
SAMPLE = 64  #: rows whose exact scores are the first threshold


class ImpactIndex:
    """The posting segments of one block of integer vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        rows, values, begin, dim, reach = [], [], [], [], []
        at = 0
        for d in range(vectors.shape[1]):
            v = vectors[:, d]
            order = np.argsort(v, kind="stable")
            own = v[order]
            width = max(1, -(-(int(own[-1]) - int(own[0]) + 1) // LEVELS))
            cut = np.concatenate([[0], np.flatnonzero(np.diff((own - own[0]) // width)) + 1])
            rows.append(order)
            values.append(own)
            begin.append(at + cut)
            dim.append(np.full(len(cut), d))
            reach.append(np.maximum(np.abs(own[cut]), np.abs(own[np.append(cut[1:], len(own)) - 1])))
            at += len(own)
        self.rows, self.values = np.concatenate(rows), np.concatenate(values).astype(float)
        self.begin, self.dim, self.reach = np.concatenate(begin), np.concatenate(dim), np.concatenate(reach)
        self.end = np.append(self.begin[1:], at)
        self.squares = np.square(vectors.astype(float)).sum(1)
        self.processed = 0

    def top_k(self, query: np.ndarray, own: int | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows but those with the query's own id; all that tie for a place by smaller id."""
        n = len(self.ids)
        members = np.arange(n) if own is None else np.flatnonzero(self.ids != own)
        few = max(8 * k, n // 32)
        if len(members) > few:
            impact = np.abs(query[self.dim]) * self.reach
            order = np.argsort(-impact, kind="stable")
            weight = np.cumsum((self.end - self.begin)[order])
            some = members[:: max(1, len(members) // SAMPLE)]
            proven = np.partition(self.vectors[some] @ query, -k)[-k]
            sums, row_left, query_left = np.zeros(n), self.squares.copy(), np.full(n, float(query @ query))
            stops = np.searchsorted(weight, weight[-1] * np.arange(1, STEPS + 1) / STEPS) + 1
            for start, stop in zip(np.concatenate([[0], stops[:-1]]), stops):
                now = order[start:stop]
                size = self.end[now] - self.begin[now]
                at = np.repeat(self.begin[now] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                rows, values, q = self.rows[at], self.values[at], np.repeat(query[self.dim[now]].astype(float), size)
                self.processed += len(now)
                sums += np.bincount(rows, q * values, n)
                row_left -= np.bincount(rows, values * values, n)
                query_left -= np.bincount(rows, q * q, n)
                lead = members[np.argpartition(sums[members], -k)[-k:]]
                proven = max(proven, int((self.vectors[lead] @ query).min()))
                # the bound is widened by more than all rounding errors of the square root can be
                most = sums[members] + np.sqrt(np.maximum(row_left[members], 0) * np.maximum(query_left[members], 0)) * (1 + 1e-9) + 1e-6
                members = members[most >= proven]
                if len(members) <= few:
                    break
        score = self.vectors[members] @ query
        best = np.lexsort((self.ids[members], -score))[:k]
        return self.ids[members][best], score[best]


def exact_score(query: np.ndarray, row: np.ndarray) -> int:
    return sum(int(a) * int(b) for a, b in zip(query.tolist(), row.tolist()))


def large_top_k(ids: np.ndarray, vectors: np.ndarray, query: np.ndarray, own: int | None, k: int) -> list[tuple[int, int]]:
    """(score, id) of the k best rows, whatever the components' size. Queries and rows are scaled by powers of two, so that no product
    overflows; a sum of n products errs by less than n + 2 units in the last place of the sum of their sizes."""
    members = np.arange(len(ids)) if own is None else np.flatnonzero(ids != own)
    if not len(members):
        return []
    q = np.ldexp(query, -int(np.frexp(np.abs(query).max())[1]))
    v = np.ldexp(vectors[members], -int(np.frexp(np.abs(vectors).max())[1]))
    about, slack = v @ q, (np.abs(v) @ np.abs(q)) * ((len(q) + 2) * 2.0**-52) + 2.0**-900
    least = np.partition(about - slack, -k)[-k] if len(members) > k else -np.inf
    best = [(exact_score(query, vectors[i]), int(ids[i])) for i in members[about + slack >= least].tolist()]
    return sorted(best, key=lambda x: (-x[0], x[1]))[:k]


class Block:
    """The rows of one block: plain ones in an impact-ordered index, large ones beside it."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        plain = np.square(vectors).sum(1) < PLAIN
        self.index = ImpactIndex(ids[plain], vectors[plain].astype(np.int64)) if plain.any() else None
        self.plain, self.large, self.all = (ids[plain], vectors[plain]), (ids[~plain], vectors[~plain]), (ids, vectors)

    def top_k(self, query: np.ndarray, own: int | None, k: int) -> list[tuple[int, int]]:
        if float(np.square(query).sum()) >= PLAIN:
            return large_top_k(*self.all, query, own, k)
        best = large_top_k(*self.large, query, own, k) if len(self.large[0]) else []
        if self.index is not None:
            found, scores = self.index.top_k(query.astype(np.int64), own, k)
            best += zip(scores.tolist(), found.tolist())
        return sorted(best, key=lambda x: (-x[0], x[1]))[:k]


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 5, block: int = 1 << 16) -> DataFrame:
    """(query_id, rank, vec_id, score, digits): for each query the k rows of largest integer inner product (all, if fewer), ties to
    the smaller vec_id. vectors and queries: (vec_id long, v array of whole numbers as double or long). Ranks go by exact scores of
    any size; `digits` is the exact score as text, and `score` is it as a long (the nearest long, where it does not fit).

    Rows with a null id, a null or empty vector or a null component take no part. Only vectors of equal length are compared. Rows
    with the query's own id are no candidates. A vec_id that is repeated among the queries is asked once; repeated rows of vectors
    are candidates each. Components must be finite and whole.

    Every row goes to one block and every query to each block, so a task holds one block and a batch of queries; k rows leave it for each.
    """
    good = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull())
    doubles = F.col("v").cast("array<double>").alias("v")
    vectors = vectors.where(good).select("vec_id", doubles, F.size("v").alias("dim"))
    queries = queries.where(good).dropDuplicates(["vec_id"]).select("vec_id", doubles, F.size("v").alias("dim"))
    n = vectors.count()
    n_block = max(1, -(-n // block), min(partitions(vectors.sparkSession), -(-n // SMALLEST)))
    left = vectors.select("dim", F.pmod(F.xxhash64("vec_id"), F.lit(n_block)).alias("c"), F.lit(False).alias("asks"), "vec_id", "v")
    right = queries.select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_block - 1).cast("long"))).alias("c"), F.lit(True).alias("asks"), "vec_id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, parts, index = None, [], [], None
        for batch in batches:
            dim, c, asks, vec_id = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("dim", "c", "asks", "vec_id"))
            flat = batch.column("v").flatten().to_numpy()
            ends = np.cumsum(dim.astype(np.int64))
            edge = np.flatnonzero((np.diff(dim) != 0) | (np.diff(c) != 0) | (np.diff(asks.astype(int)) != 0)) + 1
            for a, b in zip(np.concatenate([[0], edge]), np.concatenate([edge, [len(dim)]])):
                if a == b:
                    continue
                if key != (dim[a], c[a]):
                    key, ids, parts, index = (dim[a], c[a]), [], [], None
                rows = flat[ends[a] - dim[a] : ends[b - 1]].reshape(b - a, dim[a])
                if not asks[a]:
                    ids.append(vec_id[a:b])
                    parts.append(rows)
                elif parts:
                    index = index or Block(np.concatenate(ids), np.concatenate(parts))
                    found = [(own, score, vec) for q, own in zip(rows, vec_id[a:b].tolist()) for score, vec in index.top_k(q, own, k)]
                    asked, scores, best = ([x[i] for x in found] for i in range(3))
                    longs = [min(max(x, -LONG - 1), LONG) for x in scores]
                    yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int64()), pa.array(best, pa.int64()), pa.array(longs, pa.int64()), pa.array([str(x) for x in scores], pa.string())], ["query_id", "vec_id", "score", "digits"])

    met = left.unionByName(right).repartition(n_block, "dim", "c").sortWithinPartitions("dim", "c", "asks")
    found = met.mapInArrow(run, "query_id long, vec_id long, score long, digits string")
    # by exact score: longs first, and those that a long only stands for by their digits
    size = F.when(F.abs("score") < LONG, 0).otherwise(F.length("digits"))
    sign = F.when(F.col("digits").startswith("-"), -1).otherwise(1)
    figures = F.when(size == 0, F.lit("")).otherwise(F.translate("digits", "-", ""))
    first = [F.desc("score"), F.desc(sign * size), F.desc(F.when(sign > 0, figures)), F.when(sign < 0, figures)]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*first, "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "digits")


def quantised(embeddings: DataFrame, scale: int = 256, embedding: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component x, in double precision and held as a double, which is exact. Vectors with a
    null, NaN or infinite component (also after the scaling) are left out."""
    x = F.transform(F.col(embedding), lambda x: scale * x.cast("double"))
    fine = F.col(embedding).isNotNull() & ~F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embeddings.withColumn("x", x).where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("x", lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)).alias("v"))
