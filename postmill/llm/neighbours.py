"""Approximate nearest neighbours: a vantage-point tree per shard, queries in blocks, one pruning factor."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 8_192
BLOCK_ROWS = 512
LEAF_ROWS = 64
FACTOR = 1.0


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): doubles; ids and vectors that are null, zero, empty or hold null or non-finite parts are left out."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0)
    )


def build_tree(x: np.ndarray, leaf_rows: int = LEAF_ROWS) -> list[tuple]:
    """Nodes (vantage row, radius, inner node, outer node, None) or (-1, 0, -1, -1, leaf rows).

    Rows within the radius, the median distance, go inside, the others outside; rows at equal distances
    can't be told apart, so a node whose rows all lie at one distance ends as a leaf.
    """
    nodes: list[tuple] = []

    def grow(rows: np.ndarray) -> int:
        k = len(nodes)
        nodes.append((-1, 0.0, -1, -1, rows))
        if len(rows) > leaf_rows:
            vantage, rest = rows[0], rows[1:]
            d = np.sqrt(((x[rest] - x[vantage]) ** 2).sum(axis=1))
            radius = float(np.median(d))
            inside = d <= radius
            if inside.all():
                inside = d < radius
                radius = float(d[inside].max()) if inside.any() else radius
            if inside.any():
                a, b = grow(rest[inside]), grow(rest[~inside])
                nodes[k] = (int(vantage), radius, a, b, None)
        return k

    if len(x):
        grow(np.arange(len(x)))
    return nodes


class _Nearest:
    """The k nearest so far of every query of a block, by (distance, id)."""

    def __init__(self, q: np.ndarray, q_ids: np.ndarray, k: int):
        self.q, self.q_ids, self.k = q, q_ids, k
        self.dist = np.full((len(q), k), np.inf)
        self.ids = np.full((len(q), k), np.iinfo(np.int64).max)
        self.tau = np.full(len(q), np.inf)
        self.visited = 0

    def offer(self, active: np.ndarray, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
        d = np.empty((len(active), len(ids)))
        for at in range(0, len(active), 64):
            d[at : at + 64] = np.sqrt(((self.q[active[at : at + 64], None, :] - x[None, :, :]) ** 2).sum(axis=2))
        self.visited += d.size
        own = np.where(self.q_ids[active, None] == ids[None, :], np.inf, d)
        hits = (own <= self.tau[active, None]).any(axis=1)
        if hits.any():
            rows = active[hits]
            dist = np.concatenate([self.dist[rows], own[hits]], axis=1)
            all_ids = np.concatenate([self.ids[rows], np.broadcast_to(ids, (len(rows), len(ids)))], axis=1)
            order = np.lexsort((all_ids, dist), axis=1)[:, : self.k]
            self.dist[rows] = np.take_along_axis(dist, order, 1)
            self.ids[rows] = np.take_along_axis(all_ids, order, 1)
            self.tau[rows] = self.dist[rows, -1]
        return d


def search_tree(nodes: list[tuple], x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int, factor: float) -> _Nearest:
    """Depth first, nearer child first. By the triangle inequality a child can't hold anything nearer than
    its gap |d - radius|; it is left out if factor * gap > the k-th distance. Factor 1 is exact, more prunes more."""
    found = _Nearest(q, q_ids, k)
    slack = 1 - 1e-9

    def visit(node: int, active: np.ndarray) -> None:
        if not len(active):
            return
        vantage, radius, inner, outer, rows = nodes[node]
        if rows is not None:
            found.offer(active, x[rows], ids[rows])
            return
        d = found.offer(active, x[[vantage]], ids[[vantage]])[:, 0]
        near = d <= radius
        for first in (True, False):
            group, gap = active[near == first], (np.abs(d - radius) * slack)[near == first]
            here, there = (inner, outer) if first else (outer, inner)
            visit(here, group)
            visit(there, group[factor * gap <= found.tau[group]])

    if nodes:
        visit(0, np.arange(len(q)))
    return found


def _pack(df: DataFrame, group: str) -> DataFrame:
    """One row per group: ids and vectors as bytes. Groups are bounded by their number, chosen from the count."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        return pd.DataFrame({
            group: [rows[group].iloc[0]], "dims": [rows["dims"].iloc[0]],
            "ids": [rows["id"].to_numpy("<i8").tobytes()], "vectors": [np.stack(rows["v"].to_list()).astype("<f8").tobytes()],
        })

    return df.groupBy(group, "dims").applyInPandas(pack, f"{group} long, dims int, ids binary, vectors binary")


def nearest(
    vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10,
    factor: float = FACTOR, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of `vectors` by Euclidean distance for each query.

    A row isn't its own neighbour: candidates with the query's id are left out. Ties go to the smaller id.
    Rows with equal ids stand for themselves. Vectors of other length than the query's aren't compared.
    Rows go to shards by hash, queries to blocks; each (shard, block) pair is one unit of work, so neither
    the index nor the queries ever meet whole. A shard gives k rows a query; the final rank also runs
    before the shuffle.
    """
    data, asked = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col)
    n, m = data.count(), asked.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-m // block_rows))

    def dealt(df: DataFrame, group: str, parts: int) -> DataFrame:
        return df.withColumns({group: F.pmod(F.xxhash64("id", "v"), F.lit(parts)).cast("long"), "dims": F.size("v")})

    packed = _pack(dealt(data, "shard", shards), "shard")
    asked = _pack(dealt(asked, "block", blocks), "block").select("block", "dims", F.col("ids").alias("q_ids"), F.col("vectors").alias("q"))
    units = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
    units = units.join(asked, ["block", "dims"]).repartition(max(shards, spark_cores(vectors)), "shard", "block")

    def search(stream):
        for frame in stream:
            for row in frame.itertuples():
                x = np.frombuffer(row.vectors, "<f8").reshape(-1, row.dims)
                q = np.frombuffer(row.q, "<f8").reshape(-1, row.dims)
                ids, q_ids = np.frombuffer(row.ids, "<i8"), np.frombuffer(row.q_ids, "<i8")
                found = search_tree(build_tree(x), x, ids, q, q_ids, k, factor)
                keep = np.isfinite(found.dist)
                yield pd.DataFrame({"query_id": np.repeat(q_ids, k)[keep.ravel()], "vec_id": found.ids[keep], "score": found.dist[keep]})

    hits = units.mapInPandas(search, "query_id long, vec_id long, score double")
    rank = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return hits.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def spark_cores(df: DataFrame) -> int:
    return df.sparkSession.sparkContext.defaultParallelism
