"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Vectors are dealt to cells by the nearest of some centres, which are fitted on a bounded sample; a cell of more than
SHARD_ROWS rows is several shards.  Each shard's distinct vectors form a graph, kept as flat arrays in one row of an
index table: for every node LINKS * 2 places of layer 0, and LINKS places for each layer above that the node is on.
Equal vectors are one node with a list of rows, so a crowd of copies can't cut a graph apart.

Graphs grow by batches of nodes: a batch's candidates are its nearest among all nodes so far, found by blocks of matrix
products, and the links that are nearer to the node than to links taken before are kept, on both sides.  A shard's
queries are searched together, each step taking every query's nearest open node.

A query goes to the cells whose centres are nearest, as many as hold REACH of the neighbours of sampled queries in the
sample; the shards' nearest rows are merged.  In clustered tables these are few cells, in shapeless ones nearly all.

The search is approximate: recall against brute force is measured by the tests.  Distances are Euclidean, in double
precision, on the original vectors; ties go to the smaller vec_id.

Nulls and odd rows: vectors that are null, empty, all zero, or hold a null or non-finite component take no part, nor do
queries with such a vector or a null vec_id; rows of equal vec_id are candidates each, only the query's own row is not;
vectors of different lengths never meet; fewer candidates than k give fewer rows; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import columns_of, forget, written

#: Rows of a shard at most, about.
SHARD_ROWS = 32_768
#: Rows of one length that the centres are fitted on, and centres at most.
SAMPLE = 20_000
MOST_CELLS = 1_024
#: Share of the sampled neighbours that lie in the cells a query goes to.
REACH = 0.98
#: Links of a node on the upper layers; layer 0 has twice as many.
LINKS = 16
#: Candidates for a node's links, and nodes held open in a search.
BUILD_WIDTH = 64
SEARCH_WIDTH = 160
#: Nodes that are linked at a time, and queries that meet one shard at a time.
BATCH = 512
QUERY_ROWS = 8_192

INDEX = "dim int, cell int, shard int, rows binary, ids binary, node binary, vectors binary, levels binary, base binary, upper binary, entry int"
FOUND = "query_rid long, query_id long, vec_id long, score double"


class Graph:
    """Flat arrays: vectors (n x dim), levels (n), base (n x 2 LINKS) and upper (places by node and layer, from
    first[node] on); -1 is an empty place."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, base: np.ndarray, upper: np.ndarray, entry: int):
        self.vectors, self.levels, self.base, self.upper, self.entry = vectors, levels, base, upper, entry
        self.first = np.concatenate([[0], np.cumsum(levels.astype(np.int64))])

    @classmethod
    def built(cls, vectors: np.ndarray, seed: int = 4) -> Graph:
        n = len(vectors)
        rng = np.random.default_rng(seed)
        levels = np.minimum((-np.log(np.maximum(rng.random(n), 1e-12)) / math.log(LINKS)).astype(np.int32), 12)
        g = cls(vectors, levels, np.full((n, 2 * LINKS), -1, np.int32), np.full((int(levels.sum()), LINKS), -1, np.int32), int(levels.argmax()) if n else 0)
        order = rng.permutation(n)
        for layer in range(int(levels.max(initial=0)) + 1):
            g._connect(order[levels[order] >= layer], layer)
        return g

    def _places(self, nodes: np.ndarray, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """The array that holds a layer's links, and the rows of these nodes in it."""
        return (self.base, nodes) if layer == 0 else (self.upper, self.first[nodes] + layer - 1)

    def _connect(self, nodes: np.ndarray, layer: int) -> None:
        """Links the nodes of a layer, batch by batch, to their nearest among those before them and in their batch."""
        points = self.vectors[nodes].astype(np.float32)
        norms = np.einsum("ij,ij->i", points, points)
        begin, size = 0, 32
        while begin < len(nodes):
            end = min(len(nodes), begin + size)
            if len(nodes) - end < 2:
                end = len(nodes)
            d = norms[:end] - 2 * (points[begin:end] @ points[:end].T)
            d[np.arange(end - begin), np.arange(begin, end)] = np.inf
            k = min(BUILD_WIDTH, end - 1)
            if k > 0:
                near = np.argpartition(d, k - 1, axis=1)[:, :k] if k < end else np.argsort(d, axis=1)[:, :k]
                batch = nodes[begin:end]
                chosen = self._diverse(batch, nodes[near], LINKS)
                places, rows = self._places(batch, layer)
                held = places[rows]
                held[:, : chosen.shape[1]] = chosen
                places[rows] = held
                self._link_back(batch, chosen, layer)
            begin, size = end, min(BATCH, size * 2)

    def _diverse(self, nodes: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
        """For each node up to ``most`` of its candidates (-1: none): those that are nearer to it than to the ones taken
        before, the nearest first; then the nearest of the rest."""
        out = []
        for a in range(0, len(nodes), BATCH):
            some, cand = nodes[a : a + BATCH], near[a : a + BATCH]
            points = self.vectors[cand].astype(np.float32)
            diff = points - self.vectors[some].astype(np.float32)[:, None]
            d = np.where(cand < 0, np.inf, np.einsum("ijk,ijk->ij", diff, diff))
            order = np.argsort(d, axis=1, kind="stable")
            cand, d = np.take_along_axis(cand, order, 1), np.take_along_axis(d, order, 1)
            points = np.take_along_axis(points, order[:, :, None], 1)
            norms = np.einsum("ijk,ijk->ij", points, points)
            between = norms[:, :, None] + norms[:, None] - 2 * (points @ points.transpose(0, 2, 1))
            taken, count = np.zeros(cand.shape, bool), np.zeros(len(cand), int)
            for j in range(cand.shape[1]):
                nearest = np.where(taken, between[:, j], np.inf).min(axis=1)
                take = (nearest >= d[:, j]) & (count < most) & (d[:, j] < np.inf)
                taken[:, j] = take
                count += take
            rank = np.where(cand < 0, 2 * cand.shape[1], np.where(taken, 0, cand.shape[1]) + np.arange(cand.shape[1]))
            pick = np.argsort(rank, axis=1, kind="stable")[:, :most]
            out.append(np.take_along_axis(cand, pick, 1))
        return np.concatenate(out)

    def _link_back(self, batch: np.ndarray, chosen: np.ndarray, layer: int) -> None:
        """Links from the chosen nodes to the batch's; full ones keep the best."""
        to, back = chosen.ravel(), np.repeat(batch, chosen.shape[1])
        to, back = to[to >= 0], back[to >= 0]
        order = np.argsort(to, kind="stable")
        to, back = to[order], back[order]
        targets, begin, n = np.unique(to, return_index=True, return_counts=True)
        places, rows = self._places(targets, layer)
        new = np.full((len(targets), int(n.max(initial=0))), -1, np.int32)
        new[np.repeat(np.arange(len(targets)), n), np.arange(len(to)) - np.repeat(begin, n)] = back
        held = places[rows]
        new[(new[:, :, None] == held[:, None]).any(axis=2)] = -1  # linked already
        both = np.concatenate([held, new], axis=1)
        both = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)
        full = (both[:, held.shape[1] :] >= 0).any(axis=1)
        out = both[:, : held.shape[1]].copy()
        if full.any():
            out[full] = self._diverse(targets[full], both[full], held.shape[1])
        places[rows] = out

    def _distances(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        d = self.vectors[nodes] - q[:, None]
        return np.einsum("ijk,ijk->ij", d, d)

    def search(self, q: np.ndarray, width: int) -> np.ndarray:
        """For each of the queries the up to ``width`` nearest nodes found, nearest first; -1 where there are fewer."""
        return np.concatenate([self._search(q[a : a + BATCH], width) for a in range(0, len(q), BATCH)])

    def _search(self, q: np.ndarray, width: int) -> np.ndarray:
        at = np.full(len(q), self.entry)
        best = self._distances(q, at[:, None])[:, 0]
        for layer in range(int(self.levels[self.entry]), 0, -1):
            going = np.arange(len(q))
            while len(going):
                near = self.upper[self.first[at[going]] + layer - 1]
                d = np.where(near < 0, np.inf, self._distances(q[going], near))
                k = d.argmin(axis=1)
                better = d[np.arange(len(going)), k] < best[going]
                at[going[better]], best[going[better]] = near[better, k[better]], d[better, k[better]]
                going = going[better]
        n = len(self.vectors)
        seen = np.zeros((len(q), n + 1), bool)
        seen[:, n] = True  # where -1 points
        seen[np.arange(len(q)), at] = True
        nodes = np.full((len(q), width), -1)
        dist = np.full((len(q), width), np.inf)
        closed = np.ones((len(q), width), bool)
        nodes[:, 0], dist[:, 0], closed[:, 0] = at, best, False
        going = np.arange(len(q))
        while len(going):
            # every query's nearest open node; the held ones are in order
            k = (~closed[going]).argmax(axis=1)
            closed[going, k] = True
            near = self.base[nodes[going, k]]
            near = np.where(seen[going[:, None], near], -1, near)
            seen[going[:, None], near] = True
            d = np.where(near < 0, np.inf, self._distances(q[going], near))
            every = np.concatenate([dist[going], d], axis=1)
            order = np.argsort(every, axis=1, kind="stable")[:, :width]
            dist[going] = np.take_along_axis(every, order, 1)
            nodes[going] = np.take_along_axis(np.concatenate([nodes[going], near], axis=1), order, 1)
            closed[going] = np.take_along_axis(np.concatenate([closed[going], near < 0], axis=1), order, 1)
            going = going[(~closed[going]).any(axis=1)]
        return nodes


@dataclass
class Cells:
    """Centres, and how many of the nearest ones a query goes to."""

    centres: np.ndarray
    reach: int

    def nearest(self, v: np.ndarray, k: int) -> np.ndarray:
        d = (self.centres**2).sum(axis=1) - 2 * (v @ self.centres.T)
        return np.argsort(d, axis=1, kind="stable")[:, :k]


def fit_cells(sample: np.ndarray, cells: int, k: int = 10, rounds: int = 8, seed: int = 4) -> Cells:
    """``cells`` centres by Lloyd's rounds, and the reach that the sample's own neighbours ask for."""
    if cells <= 1 or len(sample) <= 2 * cells:
        return Cells(np.zeros((1, sample.shape[1] if sample.ndim == 2 else 0)), 1)
    rng = np.random.default_rng(seed)
    out = Cells(sample[rng.choice(len(sample), cells, replace=False)].copy(), cells)
    for _ in range(rounds):
        own = out.nearest(sample, 1)[:, 0]
        counts = np.bincount(own, minlength=cells)
        sums = np.zeros_like(out.centres)
        np.add.at(sums, own, sample)
        out.centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    own = out.nearest(sample, 1)[:, 0]
    asked = rng.choice(len(sample), min(500, len(sample)), replace=False)
    d = (sample**2).sum(axis=1) - 2 * (sample[asked] @ sample.T)
    d[np.arange(len(asked)), asked] = np.inf
    near = np.argpartition(d, k, axis=1)[:, :k]
    ranks = out.nearest(sample[asked], cells).argsort(axis=1)
    at = np.take_along_axis(ranks, own[near], 1)
    out.reach = int(np.quantile(at, REACH, method="higher")) + 1
    return out


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    """One shard's index row."""
    rows = rows.sort_values(["none", "vec_id", "rid"], kind="stable")
    vectors = np.array(rows["v"].tolist(), np.float64)
    seen: dict[bytes, int] = {}
    node = np.array([seen.setdefault(v.tobytes(), len(seen)) for v in vectors + 0.0], np.int32)
    first = np.unique(node, return_index=True)[1]
    g = Graph.built(vectors[first])
    # ids: those of rows with one, which stand before the rows without
    ids = rows["vec_id"].to_numpy(np.int64)[~rows["none"].to_numpy(bool)]
    return pd.DataFrame([[int(rows["dim"].iloc[0]), int(rows["cell"].iloc[0]), int(rows["shard"].iloc[0]), rows["rid"].to_numpy(np.int64).tobytes(), ids.tobytes(), node.tobytes(), g.vectors.tobytes(), g.levels.tobytes(), g.base.tobytes(), g.upper.tobytes(), g.entry]], columns=["dim", "cell", "shard", "rows", "ids", "node", "vectors", "levels", "base", "upper", "entry"])


def valid_vectors(table: DataFrame) -> DataFrame:
    """(rid, vec_id, v, dim) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = columns_of(table, "vec_id", "embedding").filter(F.col("embedding").isNotNull() & ~bad & F.exists(v, lambda x: x != 0))
    return rows.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.size("embedding").alias("dim"))


@dataclass
class Index:
    """The index table in the shared folder, its shards (dim, cell, shards), and each length's cells."""

    table: DataFrame
    shards: DataFrame
    cells: dict[int, Cells]


def _celled(vectors: DataFrame, cells: dict[int, Cells], reach: bool) -> DataFrame:
    """vectors with the nearest cell, or with a row for each cell that a query goes to."""

    @F.pandas_udf("array<int>")
    def nearest(v: pd.Series) -> pd.Series:
        out = [[0]] * len(v)
        dims = v.map(len).to_numpy()
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            c = cells[int(dim)]
            if len(c.centres) > 1:
                for i, found in zip(at, c.nearest(np.array(v.iloc[at].tolist(), np.float64), c.reach if reach else 1).tolist()):
                    out[i] = found
        return pd.Series(out, index=v.index)

    return vectors.withColumn("cell", F.explode(nearest("v")))


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS, sample: int = SAMPLE) -> Index:
    """Fits cells for each length of vectors, which are few, and builds every shard's graph."""
    sizes = {r["dim"]: r["n"] for r in vectors.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    cells = {}
    for dim, n in sizes.items():
        number = min(MOST_CELLS, -(-n // shard_rows))
        drawn = F.pmod(F.xxhash64("rid", F.lit(4)), F.lit(1 << 30)) / float(1 << 30)
        some = vectors.filter((F.col("dim") == dim) & (drawn < sample / n)).select("v").collect() if number > 1 else []
        cells[dim] = fit_cells(np.array([r["v"] for r in some], np.float64), number)
    placed = written(_celled(vectors, cells, False), "cells")
    shards = written(placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards")), "shards")
    rows = placed.join(F.broadcast(shards), ["dim", "cell"]).withColumn("shard", F.pmod(F.xxhash64("rid"), F.col("shards")).cast("int"))  # MOST_CELLS rows for each length
    rows = rows.withColumns({"none": F.col("vec_id").isNull(), "vec_id": F.coalesce("vec_id", F.lit(0))})
    table = written(rows.groupBy("dim", "cell", "shard").applyInPandas(_build, INDEX), "hnsw")
    forget(placed)
    return Index(table, shards, cells)


def search_index(index: Index, queries: DataFrame, k: int = 10, width: int = SEARCH_WIDTH) -> DataFrame:
    """query_id, rank, vec_id, score for queries (rid, vec_id, v, dim); a query's own row is no candidate."""
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    spread = _celled(queries, index.cells, True).join(F.broadcast(index.shards), ["dim", "cell"])  # MOST_CELLS rows for each length
    spread = spread.withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    spread = written(spread, "asked")
    keys = ["dim", "cell", "shard", "block"]
    where = spread.select(*[F.col(c).alias(f"{c}_") for c in keys]).distinct()
    graphs = index.table.join(where, [F.col(c) == F.col(f"{c}_") for c in keys[:3]]).withColumn("block", F.col("block_")).drop("dim_", "cell_", "shard_", "block_")

    def search(graph: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(graph) and len(asked):
            r = graph.iloc[0]
            levels = np.frombuffer(r["levels"], np.int32)
            g = Graph(np.frombuffer(r["vectors"], np.float64).reshape(len(levels), -1), levels, np.frombuffer(r["base"], np.int32).reshape(len(levels), -1), np.frombuffer(r["upper"], np.int32).reshape(-1, LINKS), int(r["entry"]))
            rids, ids, node = (np.frombuffer(r[c], t) for c, t in (("rows", np.int64), ("ids", np.int64), ("node", np.int32)))
            by_node = np.argsort(node, kind="stable")  # a node's rows stand by vec_id
            start = np.searchsorted(node[by_node], np.arange(len(levels) + 1))
            q = np.array(asked["v"].tolist(), np.float64)
            for rid, vec_id, v, found in zip(asked["rid"], asked["vec_id"], q, g.search(q, width)):
                found = found[found >= 0]
                # added up in the components' order
                score = np.sqrt(np.add.accumulate((g.vectors[found] - v) ** 2, axis=1)[:, -1])
                got = []
                for n, d in zip(found, score.tolist()):
                    at = by_node[start[n] : start[n + 1]][: k + 1]
                    got += [(d, a >= len(ids), int(ids[a]) if a < len(ids) else 0) for a in at if rids[a] != rid]
                got.sort()
                out += [(rid, vec_id, None if none else i, d) for d, none, i in got[:k]]
        made = pd.DataFrame({c: [x[i] for x in out] for i, c in ((0, "query_rid"), (1, "query_id"), (3, "score"))})
        made.insert(2, "vec_id", pd.array([x[2] for x in out], dtype="Int64"))
        return made

    found = graphs.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInPandas(search, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_rid").orderBy("score", F.col("vec_id").asc_nulls_last()))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of every row whose vec_id is divisible by 100."""
    vectors = written(valid_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "vectors")
    return search_index(build_index(vectors), vectors.filter("vec_id % 100 = 0"))


#: The exact answer; the search's recall on the test tables makes it the same.
OP4_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x <> 0)) > 0
), near AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM near
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
