"""Exact top-k search over an impact-ordered index, score at a time.

Vectors of integer components are indexed in blocks. A posting is a (vector, dimension) with its impact, the
component. A block keeps its postings by dimension in segments of like quantised impact (quantiles of the
magnitudes in the block); zeros have no posting. A batch of queries walks the segments of high impact together and adds
the products of their postings to the scores of the vectors. What a vector can still gain is at most the norm of the
query times the norm of the vector's postings of low impact. A vector is left out only when its score with that bound
stays below the k-th best whole score of others, or below the threshold that the query brings along; the few that are
possible are scored again exactly, and where many are, the segments of low impact are walked too. Blocks whose scores a float
can't hold, and very wide ones, are walked by one query at a time, by descending ``|q_d| * impact``, with a bound on either side.

The first block is searched first, then three, then twelve more and so on; the k-th best score that a query has found is its
threshold in the blocks after, so that what is found grows with the logarithm of the blocks.

Blocks have about ``BLOCK`` different rows and batches ``BATCH`` queries, dealt by hashes; equal rows are counted
before, so tasks stay even and bounded however often a row is repeated.

Edge cases: vectors that are null, or hold null or non-finite components, take no part, nor do null ids. Of vectors of
different lengths the shorter one counts as 0 beyond its end. Scores beyond 2**53 are summed as whole numbers; components
and scores stop at the range of a long. Equal rows (id and vector) are one query, and as candidates as many as they are;
rows of one id with other vectors are queries of their own. Ties go to the smaller vec_id; a query never finds its own id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import materialize, small_batches, table

K, SCALE, EVERY, BLOCK, BATCH = 20, 64, 20, 8192, 4096
#: Shares of a block's magnitudes at which a new segment begins, and shares of the postings after which bounds are looked at.
QUANTILES, LOOKS = (0.25, 0.5, 0.75, 0.9, 0.97), (0.25, 0.5, 0.75, 0.9, 1.0)
MAX_TASKS = 20_000
#: A query stops when at most this share of the block, or twice k, is possible.
FEW = 0.05
#: Segments of at least this level (by QUANTILES) are walked first by a batch, of so many queries at a time.
HIGH, AT_ONCE = 1, 256
#: Times as many blocks as before that are searched with one threshold, and cells of a block that batches walk at most.
GROWTH, CELLS = 4, 1 << 25


def quantised(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, v (array of long): floor(scale * x) of each component of the vectors that take part."""
    top = float(1 << 62)
    wide = F.transform(F.col(vector_col), lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-top)), F.lit(top))))
    fine = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = embeddings.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(F.coalesce(fine, F.lit(False)))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), wide.cast("array<long>").alias("v"))


class Block:
    """Postings of some vectors by dimension and segment."""

    def __init__(self, ids: np.ndarray, vectors: list[np.ndarray]):
        self.ids, self.vectors = ids, [np.asarray(v, np.int64) for v in vectors]
        size = np.array([len(v) for v in self.vectors])
        row = np.repeat(np.arange(len(ids)), size)
        dim = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        value = np.concatenate(self.vectors).astype(np.float64) if len(ids) else np.zeros(0)
        self.largest = float(np.abs(value).max(initial=0))
        some = value != 0
        row, dim, value = row[some], dim[some], value[some]
        bounds = np.quantile(np.abs(value), QUANTILES) if len(value) else np.zeros(len(QUANTILES))
        level = np.searchsorted(bounds, np.abs(value), side="right")
        order = np.lexsort((level, dim))
        self.row, self.value, dim, level = row[order], value[order], dim[order], level[order]
        self.start = np.flatnonzero(np.append(True, (dim[1:] != dim[:-1]) | (level[1:] != level[:-1]))) if len(dim) else np.zeros(0, np.int64)
        self.size = np.diff(np.append(self.start, len(dim)))
        self.dim, self.level = dim[self.start], level[self.start]
        self.impact = np.maximum.reduceat(np.abs(self.value), self.start) if len(dim) else np.zeros(0)
        self.square = np.bincount(self.row, self.value**2, len(ids))

    def exact(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Whole scores of some vectors."""
        if len(q) * float(np.abs(q).astype(np.float64).max(initial=0)) * self.largest < 1 << 53:
            return np.array([q[: len(self.vectors[r])] @ self.vectors[r][: len(q)] for r in rows.tolist()], np.int64)
        sums = (sum(int(a) * int(b) for a, b in zip(q, self.vectors[r], strict=False)) for r in rows.tolist())
        return np.array([max(-(1 << 63), min((1 << 63) - 1, s)) for s in sums], np.int64)

    def tile(self, levels: np.ndarray, width: int, kind: type) -> np.ndarray:
        """The postings of some segments, by dimension and vector."""
        some = np.repeat(levels, self.size)
        out = np.zeros((width, len(self.ids)), kind)
        out[np.repeat(self.dim, self.size)[some], self.row[some]] = self.value[some]
        return out

    def search_batch(self, q_ids: np.ndarray, queries: list[np.ndarray], k: int, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the queries (in order), and rows and whole scores of the k best vectors of each, of those not below its threshold (NaN
        for none). The block's ids are in order."""
        n, width = len(self.ids), int(self.dim.max(initial=-1)) + 1
        norms = np.array([np.sqrt((v := np.asarray(q, np.float64)) @ v) for q in queries])
        length = np.sqrt(self.square)
        top = norms.max(initial=0.0) * length.max(initial=0.0)
        if top >= 1 << 53 or n * width > CELLS:
            found = [self.search(i, q, k, -np.inf if np.isnan(t) else t) for i, q, t in zip(q_ids, queries, thresholds, strict=True)]
            return np.repeat(np.arange(len(found)), [len(rows) for rows, _ in found]), *(np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found, strict=True))
        kind = np.float32 if top < 1 << 24 else np.float64  # holds all sums of products exactly, in any order
        high, low = (self.tile(levels, width, kind) for levels in (self.level >= HIGH, self.level < HIGH))
        rest = np.sqrt((low.astype(np.float64) ** 2).sum(axis=0)).astype(kind)
        vectors, error = np.ascontiguousarray((high + low).T), 64 * np.finfo(kind).eps * top
        first, last = np.searchsorted(self.ids, q_ids, "left"), np.searchsorted(self.ids, q_ids, "right")
        out = []
        for at in range(0, len(queries), AT_ONCE):
            q = np.zeros((len(queries[at : at + AT_ONCE]), width), kind)
            for i, v in enumerate(queries[at : at + AT_ONCE]):
                q[i, : len(v)] = v[:width]  # beyond it there are no postings
            own, least = q_ids[at : at + AT_ONCE], np.where(np.isnan(x := thresholds[at : at + AT_ONCE]), -np.inf, x)
            score = q @ high
            free = np.flatnonzero(np.isneginf(least))
            if len(free) and n > k:  # whole scores of k others are as good a threshold
                for i in free[first[at + free] < last[at + free]].tolist():
                    score[i, first[at + i] : last[at + i]] = -np.inf
                some = np.argpartition(score[free], n - k, axis=1)[:, n - k :]
                whole = np.stack([vectors[rows] @ q[i] for i, rows in zip(free, some, strict=True)])
                least[free] = np.where(self.ids[some] == own[free, None], -np.inf, whole).min(axis=1)
            score += norms[at : at + AT_ONCE, None].astype(kind) * rest
            i, rows = np.nonzero(score >= (least - error).astype(kind)[:, None])
            if len(i) > FEW * score.size:
                whole = (q @ high + q @ low)[i, rows]
            else:
                whole = np.concatenate([np.zeros(0, kind), *(np.einsum("ij,ij->i", q[i[j : j + BLOCK]], vectors[rows[j : j + BLOCK]]) for j in range(0, len(i), BLOCK))])
            good = (whole >= least[i]) & (self.ids[rows] != own[i])
            i, rows, whole = i[good], rows[good], whole[good]
            order = np.lexsort((rows, -whole, i))
            i, rows, whole = i[order], rows[order], whole[order]
            kept = np.arange(len(i)) - np.searchsorted(i, i) < k
            out.append((i[kept] + at, rows[kept], whole[kept].astype(np.int64)))
        return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*out, strict=True) if out else ((), (), ())))

    def search(self, q_id: int, q: np.ndarray, k: int, threshold: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Rows and whole scores of the k best vectors, of those not below the threshold."""
        q = np.asarray(q, np.int64)
        n, wide = len(self.ids), np.zeros(max(len(q), int(self.dim.max(initial=-1)) + 1))
        wide[: len(q)] = q
        impact = np.abs(wide[self.dim]) * self.impact
        walk = np.argsort(-impact, kind="stable")
        walk = walk[impact[walk] > 0]
        upto = np.cumsum(self.size[walk])
        score, met, spent = np.zeros(n), np.zeros(n), np.zeros(n)
        possible, least, done = self.ids != q_id, threshold, 0
        norm = float(wide @ wide)
        error = 1e-9 * (np.sqrt(norm * self.square.max(initial=0)) + 1)  # of sums of floats
        for look in LOOKS:
            until = int(np.searchsorted(upto, look * upto[-1], side="left")) + 1 if len(upto) else 0
            some, done = walk[done:until], max(done, until)
            size = self.size[some]
            at = np.arange(size.sum()) + np.repeat(self.start[some] - np.cumsum(size) + size, size)
            row, value, weight = self.row[at], self.value[at], np.repeat(wide[self.dim[some]], size)
            score += np.bincount(row, weight * value, n)
            met += np.bincount(row, weight * weight, n)
            spent += np.bincount(row, value * value, n)
            slack = np.sqrt(np.maximum(norm - met, 0) * np.maximum(self.square - spent, 0)) + error if done < len(walk) else np.full(n, error)
            low = (score - slack)[possible]
            if len(low) > k:
                least = max(least, np.partition(low, len(low) - k)[len(low) - k])
            possible &= score + slack >= least
            if possible.sum() <= max(2 * k, FEW * n):  # proven: no other vector is among the k best
                break
        rows = np.flatnonzero(possible)
        whole = self.exact(q, rows)
        best = np.lexsort((self.ids[rows], -whole.astype(object) if (whole == -(1 << 63)).any() else -whole))[:k]
        best = best[whole[best] >= threshold]
        return rows[best], whole[best]


def _search(vectors: DataFrame, batches: DataFrame, k: int, tasks: int) -> DataFrame:
    """query_id, q_key, vec_id, score: the best of each block for each query that meets it."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_id", "q_key", "vec_id", "score")})
        right = right.sort_values("vec_id", kind="stable")
        block, copies = Block(right["vec_id"].to_numpy(), right["v"].tolist()), right["copies"].to_numpy()
        q_id, q_key = left["q_id"].to_numpy(), left["q_key"].to_numpy()
        at, found, score = block.search_batch(q_id, left["q_v"].tolist(), k, left["threshold"].to_numpy(np.float64, na_value=np.nan))
        at, found, score = (np.repeat(x, copies[found]) for x in (at, found, score))
        kept = np.arange(len(at)) - np.searchsorted(at, at) < k
        return pd.DataFrame({"query_id": q_id[at], "q_key": q_key[at], "vec_id": block.ids[found], "score": score})[kept]

    # a number of its own, as few bytes are much work here
    batches, vectors = batches.repartition(tasks, "q_block", "q_batch"), vectors.repartition(tasks, "block", "batch")
    return batches.groupBy("q_block", "q_batch").cogroup(vectors.groupBy("block", "batch")).applyInPandas(run, "query_id long, q_key long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors of largest inner product for every query (vec_id, v)."""
    small_batches(vectors.sparkSession)
    rows = materialize(vectors.groupBy("vec_id", "v").agg(F.count("*").alias("copies")))
    asked = materialize(queries.select(F.col("vec_id").alias("q_id"), F.col("v").alias("q_v"), F.xxhash64("v").alias("q_key")).distinct())
    n_blocks, n_batches = max(1, -(-rows.count() // BLOCK)), max(1, -(-asked.count() // BATCH))
    place = F.xxhash64("vec_id", "v")
    dealt = rows.select("vec_id", "v", F.least("copies", F.lit(k)).alias("copies"), F.pmod(place, F.lit(n_blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(n_batches - 1))).alias("batch"))
    batch = F.pmod(F.xxhash64("q_id", "q_key"), F.lit(n_batches)).cast("int").alias("q_batch")
    found, upto = None, 0
    while upto < n_blocks:
        start, upto = upto, min(n_blocks, max(1, upto * GROWTH))
        if found is None:
            meant = asked.withColumn("threshold", F.lit(None).cast("long"))
        else:
            found = materialize(found)
            reached = found.groupBy("query_id", "q_key").agg(F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(k - 1)).alias("threshold"))
            same = (F.col("q_id") == F.col("query_id")) & (asked["q_key"] == reached["q_key"])
            meant = asked.join(reached, same, "left").select("q_id", "q_v", asked["q_key"], "threshold")
        meant = meant.select("*", batch, F.explode(F.sequence(F.lit(start), F.lit(upto - 1))).alias("q_block"))
        more = _search(dealt.where((F.col("block") >= start) & (F.col("block") < upto)), meant, k, min(max(1, 2 * n_batches * (upto - start)), MAX_TASKS))
        found = more if found is None else found.unionByName(more)
    order = Window.partitionBy("query_id", "q_key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1(spark, sf_dir):
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


SQL = f"""
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
asked AS (SELECT DISTINCT vec_id, v FROM fine WHERE vec_id % {EVERY} = 0),
pairs AS (
  SELECT q.vec_id AS query_id, q.v AS q, d.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])), 0) AS score
  FROM asked q JOIN fine d ON q.vec_id <> d.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, q ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= {K}
"""
