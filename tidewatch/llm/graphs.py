"""Operator 11, nearest neighbours: a navigable small-world graph for each shard, results merged.

Vectors are dealt into shards by a hash of their id; a shard's equal vectors are one node.
Nodes are put in one after another: each gets a top layer by a hash, is led from the entry
down to its layers, and is joined in each with near nodes that aren't nearer to one another.
Neighbours are flat arrays: SLOTS places for each node in the lowest layer, half as many in
each higher one, -1 where there is none. A shard is one row of the index. A search goes
through every shard's graph, scores what it finds on the original vectors in double
precision, and keeps the best of all shards.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, table
from .shingles import mixed

#: Rows of a shard, in the mean. Larger shards make fewer graphs to search, in longer tasks.
SHARD = 4096
#: Neighbours of a node in the lowest layer; candidates kept while a node is put in, and while a query is answered.
SLOTS, BUILD, SEEK = 32, 80, 160
#: Queries that meet a shard in one group.
QUERIES = 16_384
GRAPH = "shard int, size int, ids binary, ends binary, vectors binary, entry int, layers array<binary>"
FOUND = "query_id long, vec_id long, score double"


class Graph:
    """The graph of the rows of a matrix of distinct vectors.

    layers: of each layer the places of all nodes in its array of neighbours, -1 for nodes
    that it hasn't, and that array. Distances are half squared ones less a number that is the
    same for all nodes that are compared.
    """

    def __init__(self, vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], entry: int = -1):
        self.x, self.layers, self.entry = vectors, layers, entry
        self.half = (vectors * vectors).sum(axis=1) / 2
        self.seen, self.turn = np.zeros(len(vectors), np.int64), 0

    @classmethod
    def built(cls, vectors: np.ndarray, tops: np.ndarray, slots: int = SLOTS) -> Graph:
        """With node i in the layers 0 to tops[i]."""
        layers = []
        for k in range(int(tops.max()) + 1):
            there = tops >= k
            layers.append((np.where(there, np.cumsum(there) - 1, -1).astype(np.int32), np.full((int(there.sum()), slots if k == 0 else slots // 2), -1, np.int32)))
        graph, highest = cls(vectors, layers, 0), int(tops[0])
        for node in range(1, len(vectors)):
            graph._put(node, int(tops[node]), highest)
            if tops[node] > highest:
                graph.entry, highest = node, int(tops[node])
        return graph

    def _step_down(self, q: np.ndarray, node: int, layer: int) -> int:
        """The nearest node that steps to nearer neighbours lead to."""
        places, lists = self.layers[layer]
        best = self.half[node] - self.x[node] @ q
        while True:
            nodes = lists[places[node]]
            nodes = nodes[nodes >= 0]
            if not len(nodes):
                return node
            d = self.half[nodes] - self.x[nodes] @ q
            k = int(d.argmin())
            if d[k] >= best:
                return node
            best, node = d[k], int(nodes[k])

    def _seek(self, q: np.ndarray, node: int, layer: int, most: int) -> list[tuple[float, int]]:
        """The nearest nodes of a layer that a list of most candidates leads to, as (distance, node), nearest first."""
        self.turn += 1
        turn, seen, (places, lists) = self.turn, self.seen, self.layers[layer]
        seen[node] = turn
        d = float(self.half[node] - self.x[node] @ q)
        open_, kept = [(d, node)], [(-d, node)]
        while open_:
            d, node = heapq.heappop(open_)
            if len(kept) >= most and d > -kept[0][0]:
                break
            nodes = lists[places[node]]
            nodes = nodes[nodes >= 0]
            nodes = nodes[seen[nodes] != turn]
            if not len(nodes):
                continue
            seen[nodes] = turn
            ds = self.half[nodes] - self.x[nodes] @ q
            for d, n in zip(ds.tolist(), nodes.tolist()):
                if len(kept) < most:
                    heapq.heappush(kept, (-d, n))
                elif d < -kept[0][0]:
                    heapq.heapreplace(kept, (-d, n))
                else:
                    continue
                heapq.heappush(open_, (d, n))
        return sorted((-d, n) for d, n in kept)

    def _spread(self, base: int, d: np.ndarray, nodes: np.ndarray, most: int) -> np.ndarray:
        """Of nodes in order of their distances d to base, those that are nearer to it than to a chosen one, then the nearest others."""
        if len(nodes) <= most:
            return nodes
        half, x = self.half[nodes], self.x[nodes]
        nearer = half[:, None] + half[None, :] - x @ x.T < (d + self.half[base])[None, :]
        out = np.zeros(len(nodes), bool)
        chosen: list[int] = []
        for i in range(len(nodes)):
            if not out[i]:
                chosen.append(i)
                if len(chosen) == most:
                    return nodes[chosen]
                out |= nearer[i]
        rest = np.setdiff1d(np.arange(len(nodes)), chosen)[: most - len(chosen)]
        return nodes[np.sort(np.append(chosen, rest))]

    def _put(self, node: int, top: int, highest: int) -> None:
        q, at = self.x[node], self.entry
        for layer in range(highest, top, -1):
            at = self._step_down(q, at, layer)
        for layer in range(min(top, highest), -1, -1):
            found = self._seek(q, at, layer, BUILD)
            at = found[0][1]
            places, lists = self.layers[layer]
            slots = lists.shape[1]
            chosen = self._spread(node, np.array([d for d, _ in found]), np.array([n for _, n in found]), slots // 2)
            lists[places[node], : len(chosen)] = chosen
            for n in chosen.tolist():
                row = lists[places[n]]
                free = np.flatnonzero(row < 0)
                if len(free):
                    row[free[0]] = node
                    continue
                nodes = np.append(row, node)
                d = self.half[nodes] - self.x[nodes] @ self.x[n]
                order = d.argsort(kind="stable")
                row[:] = self._spread(n, d[order], nodes[order], slots)

    def search(self, q: np.ndarray, most: int) -> np.ndarray:
        """Up to most nodes near q."""
        at = self.entry
        for layer in range(len(self.layers) - 1, 0, -1):
            at = self._step_down(q, at, layer)
        return np.array([n for _, n in self._seek(q, at, 0, most)])


def _top_layers(ids: np.ndarray) -> np.ndarray:
    """By a hash: two in SLOTS nodes of a layer are in the next one, too."""
    share = (mixed(mixed(ids.astype(np.uint64)) + np.uint64(1)).astype(np.float64) + 1) / 2.0**64
    return np.floor(-np.log(np.minimum(share, 1.0)) / math.log(SLOTS / 2)).astype(np.int64)


def _graph_of(pdf):
    """One shard's row: nodes are its distinct vectors; ids has each node's, ends where they end."""
    import pandas as pd

    ids, vectors = pdf["vec_id"].to_numpy(np.int64), np.array(pdf["embedding"].tolist(), np.float64)
    order = np.lexsort((*vectors.T[::-1], ids))
    once = order[np.append(True, ids[order][1:] != ids[order][:-1])]
    ids = ids[once]
    nodes, of = np.unique(vectors[once] + 0.0, axis=0, return_inverse=True)  # 0.0 for -0.0
    first = np.full(len(nodes), np.iinfo(np.int64).max)
    np.minimum.at(first, of.ravel(), ids)
    # Nodes go in by a hash of their least id, not in the order of their values.
    turns = np.argsort(mixed(first.astype(np.uint64)), kind="stable")
    place = np.argsort(turns)[of.ravel()]
    graph = Graph.built(nodes[turns], _top_layers(first[turns]))
    ends = np.cumsum(np.bincount(place, minlength=len(nodes)))
    row = (int(pdf["shard"].iloc[0]), nodes.shape[1], ids[np.lexsort((ids, place))].tobytes(), ends.astype(np.int64).tobytes(), graph.x.tobytes(), graph.entry, [x.tobytes() for layer in graph.layers for x in layer])
    return pd.DataFrame([row], columns=["shard", "size", "ids", "ends", "vectors", "entry", "layers"])


def _read(row) -> tuple[Graph, np.ndarray, np.ndarray]:
    """A row's graph, ids and ends."""
    vectors = np.frombuffer(row.vectors, np.float64).reshape(-1, row.size)
    parts = [np.frombuffer(x, np.int32) for x in row.layers]
    layers = [(places, lists.reshape(int(places.max()) + 1, -1)) for places, lists in zip(parts[::2], parts[1::2])]
    return Graph(vectors, layers, row.entry), np.frombuffer(row.ids, np.int64), np.frombuffer(row.ends, np.int64)


def _nearest(k: int, most: int):
    def found(index, queries):
        import pandas as pd

        out = []
        if len(index) and len(queries):
            graph, ids, ends = _read(next(index.itertuples(index=False)))
            for own, q in zip(queries["vec_id"].tolist(), queries["embedding"].tolist()):
                q = np.asarray(q, np.float64)
                nodes = graph.search(q, max(most, k + 1))
                d = np.sqrt(((graph.x[nodes] - q) ** 2).sum(axis=1))
                best: list[tuple[float, int]] = []
                for i in np.argsort(d, kind="stable"):
                    if len(best) >= k and d[i] > best[-1][0]:
                        break
                    end = int(ends[nodes[i]])
                    same = ids[int(ends[nodes[i] - 1]) if nodes[i] else 0 : end][: k + 1]
                    best += [(float(d[i]), int(v)) for v in same if v != own]
                out += [(own, v, s) for s, v in sorted(best)[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return found


def valid(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>, size) of rows with an id and a vector of finite components that aren't all 0."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    cast = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return cast.filter(F.col("vec_id").isNotNull() & x.isNotNull() & finite & F.exists(x, lambda v: v != 0)).withColumn("size", F.size("embedding"))


def build_graphs(rows: DataFrame, scratch: Scratch, shard: int = SHARD) -> tuple[DataFrame, int]:
    """The index of rows (vec_id, embedding), a written table of a row for each shard and length, and the number of shards.

    Rows whose vec_id is null, or whose vector is null, empty, all 0, or has null or
    non-finite components, take no part. Of rows that share a vec_id the one of the least
    vector does. Vectors of different lengths are in graphs of their own. Other columns
    aren't looked at.
    """
    rows = valid(rows)
    shards = 1 + rows.count() // shard
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    # A graph takes seconds, whatever the bytes: more partitions than shards keep two from one task.
    graphs = dealt.repartition(4 * shards, "shard", "size").groupBy("shard", "size").applyInPandas(_graph_of, GRAPH)
    return scratch.keep(graphs), shards


def nearest(index: DataFrame, shards: int, queries: DataFrame, k: int = 10, most: int = SEEK) -> DataFrame:
    """query_id, rank, vec_id and score: the k rows found nearest to each of queries (vec_id, embedding), but rows of its own id.

    score is the Euclidean distance; ranks go by it, then by vec_id. Queries are checked as
    rows of the index are, one a vec_id. A query meets every shard: the work is that of
    queries times shards, in groups of a shard and up to some QUERIES queries.
    """
    asked = valid(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("size", F.size("embedding"))
    chunks = 1 + queries.count() // QUERIES
    asked = asked.select("vec_id", "embedding", "size", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("long").alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    parts = index.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"))
    keys = ["shard", "size", "chunk"]
    spread = [x.repartition(4 * shards * chunks, *keys).groupBy(*keys) for x in (parts, asked)]
    found = spread[0].cogroup(spread[1]).applyInPandas(_nearest(k, most), FOUND)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    index, shards = build_graphs(rows, Scratch(spark, "graphs"))
    return nearest(index, shards, rows.filter("vec_id % 100 = 0"))
