"""Approximate nearest neighbours by query-aware collision counting (inner product).

Each of `tables` random projections keeps a block's vectors as a sorted array of projected values.
A query stands in the middle of its own bucket: the window around its projection is widened level
by level (virtual rehashing), each vector counts the projections whose window it stands in, and
vectors at or over the collision threshold are verified by exact inner products; no other product is
computed.  A query's widening ends when max(`least` k, `share` of the block) vectors are over the
threshold.  Every query starts at level 1, so no answer depends on another.  Inner products become
distances by the usual extension of vectors to a common norm.

The index is the sorted arrays; width, levels and share are fitted nowhere to data but the scale
(standard deviation) of each block's projections.  Every vector is indexed.  Blocks of `block_rows`
vectors meet groups of `group_rows` queries, so a vector travels once for each group and a query
once for each block.

Defined cases: vectors that are null, zero, of the wrong length, or hold null or non-finite
components take no part, nor do rows without id; equal scores are ordered by id; fewer candidates
than k give fewer rows; an empty table gives no rows.  Rows that share an id are rows of their own:
each that is a query gets its own answer, in which the other is a candidate.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import give_back, table


def usable(v: Column, dim: int) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) == dim) & fine & F.exists(v, lambda x: x != 0)


def projections(dim: int, tables: int, seed: int = 9) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim + 1, tables)).astype(np.float32)


class Block:
    """The sorted arrays of one block of vectors, and each vector's place in them."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, norm: float, a: np.ndarray):
        order = np.lexsort((rows, ids))
        self.ids, self.rows, self.v, self.a = ids[order], rows[order], vectors[order], a
        rest = np.sqrt(np.maximum(norm * norm - np.einsum("ij,ij->i", self.v, self.v), 0))
        p = (np.hstack([self.v, rest[:, None]]).astype(np.float32) @ a).T
        self.sorted = np.sort(p, axis=1)
        kind = np.uint16 if len(ids) < 1 << 16 else np.uint32
        self.place = np.empty(p.shape, kind)
        for j, x in enumerate(p):
            self.place[j, np.argsort(x, kind="stable")] = np.arange(len(x), dtype=kind)
        self.spread = max(float(p.std()), 1e-12) if p.size else 1.0

    def collisions(self, centre: np.ndarray, width: float) -> np.ndarray:
        """Of each vector, the number of projections whose window holds it."""
        n, kind = len(self.ids), self.place.dtype
        small = len(self.sorted) < 256
        counts, at, inside = np.zeros(n, np.uint8 if small else np.uint16), np.empty(n, kind), np.empty(n, bool)
        one = inside.view(np.uint8)
        bounds = np.stack([centre - width, centre + width], axis=1).astype(np.float32)
        for x, b, place in zip(self.sorted, bounds, self.place):
            lo, hi = x.searchsorted(b).tolist()
            if hi - lo >= n:
                counts += 1
                continue
            np.subtract(place, kind.type(lo), out=at)  # places below the window wrap around, beyond it
            np.less(at, kind.type(hi - lo), out=inside)
            np.add(counts, one, out=counts)
        return counts

    def search(self, row: int, q: np.ndarray, norm: float, k: int, threshold: float, wanted: int, base: float, step: float, levels: int):
        """(ids, rows, scores) of the k nearest found.  The query is scaled to the common norm."""
        scaled = q * (norm / max(np.sqrt(q @ q), 1e-300))
        centre, need = scaled.astype(np.float32) @ self.a[:-1], int(np.ceil(threshold * len(self.sorted)))
        for level in range(levels):
            found = np.flatnonzero(self.collisions(centre, (base + step * level) * self.spread if level < levels - 1 else np.inf) >= need)
            if len(found) >= min(wanted, len(self.ids)):
                break
        found = found[self.rows[found] != row]
        score = (self.v[found] * q).sum(axis=1)
        best = np.lexsort((self.rows[found], self.ids[found], -score))[:k]
        return self.ids[found][best], self.rows[found][best], score[best]


def search(vectors: DataFrame, every: int = 20, k: int = 20, tables: int = 160, threshold: float = 0.6, share: float = 0.1, least: int = 32, base: float = 1.0, step: float = 0.06, levels: int = 60, block_rows: int = 32768, group_rows: int = 8192, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score.  Queries: rows whose id is divisible by `every`."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.monotonically_increasing_id().alias("row"))
    rows = table(rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull()), "search-rows")
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dim = dims[0].d if dims else 1
    rows = rows.filter(usable(F.col("v"), dim))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("m")).first()
    blocks, norm = max(1, -(-total.n // block_rows)), float(total.m or 1.0) ** 0.5
    a = projections(dim, tables)
    queries = rows.filter(F.col("id") % every == 0)
    groups = max(1, -(-queries.count() // group_rows))
    block = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(n)).cast("int")
    left = rows.select(block(blocks, 3).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "id", "row", "v")
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), block(groups, 5).alias("group"), "id", "row", "v")

    def run(key, own: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if own.num_rows and asked.num_rows:
            matrix = lambda t: np.asarray(t.column("v").combine_chunks().flatten(), np.float64).reshape(-1, dim)
            here = Block(np.asarray(own.column("id")), np.asarray(own.column("row")), matrix(own), norm, a)
            wanted = max(least * k, int(np.ceil(share * own.num_rows)))
            for qid, row, q in zip(np.asarray(asked.column("id")).tolist(), np.asarray(asked.column("row")).tolist(), matrix(asked)):
                ids, rows_, score = here.search(row, q, norm, k, threshold, wanted, base, step, levels)
                for o, x in zip(out, ([qid] * len(ids), [row] * len(ids), ids.tolist(), rows_.tolist(), score.tolist())):
                    o += x
        give_back()
        return pa.table({n: pa.array(o, pa.float64() if n == "score" else pa.int64()) for n, o in zip(("query_id", "query_row", "vec_id", "row", "score"), out)})

    found = left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInArrow(run, "query_id long, query_row long, vec_id long, row long, score double")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
