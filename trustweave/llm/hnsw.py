"""Approximate nearest neighbours: a navigable small-world graph per shard.

Vectors are dealt to shards of about ``SHARD_ROWS`` by a hash of their id.  A
shard's graph is hierarchical: level 0 holds every distinct vector, each level
above about one in ``LINKS`` of the level below.  A vector's links are its nearest
ones on the level, thinned so that they point in different directions, their
reverses, and one to the next vector, which keeps the graph connected.  The
index is a table with one row per shard; nodes, links and vectors are flat arrays.

A search descends from the top level and keeps the ``BREADTH`` best nodes of level
0 for a whole block of queries at once; what it finds is scored again in double
precision on the original vectors.  Every query visits every shard; shard results
are merged by a window per query.

Inner products are not distances, so for the graph each vector gets one more
coordinate that brings all of a shard to the same length.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do rows without id; of several rows with one id the
vector that sorts first counts; equal vectors are one node with many ids, and
all of these are found; vectors of different length are never compared; ties go
to the smaller id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trustweave.llm.shared import Scratch

SHARD_ROWS = 8192
QUERY_ROWS = 1024
LINKS = 16
#: Places for links per node: its own, reverses, and the next node.
DEGREE = 2 * LINKS + 1
BREADTH, ABOVE = 128, 16
INDEX = (
    "dim int, shard int, members array<long>, member_start array<int>, vectors array<double>, "
    "level_nodes array<int>, level_start array<int>, neighbours array<int>"
)
FOUND = "query_id long, vec_id long, score double"


def usable(embedding: Column) -> Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


# -- one shard's graph ----------------------------------------------------------

def _levels(n: int) -> list[np.ndarray]:
    """Nodes of each level; a node's height comes from its number."""
    draw = np.random.default_rng(n).random(n)
    height = np.floor(-np.log(np.maximum(draw, 1e-12)) / math.log(LINKS)).astype(int)
    levels = [np.arange(n)]
    while len(levels[-1]) > LINKS:
        above = np.flatnonzero(height >= len(levels))
        if not 0 < len(above) < len(levels[-1]):
            break
        levels.append(above)
    return levels


def _nearest(x: np.ndarray, block: slice, k: int) -> tuple[np.ndarray, np.ndarray]:
    near = x[block] @ x.T
    rows = np.arange(near.shape[0])
    near[rows, rows + block.start] = -np.inf
    top = np.argpartition(-near, k - 1, axis=1)[:, :k] if k < near.shape[1] else np.tile(np.arange(near.shape[1]), (len(rows), 1))
    score = np.take_along_axis(near, top, 1)
    order = np.argsort(-score, axis=1, kind="stable")
    return np.take_along_axis(top, order, 1), np.take_along_axis(score, order, 1)


def _links(x: np.ndarray) -> np.ndarray:
    """``len(x)`` rows of ``DEGREE`` links, -1 where there is none."""
    n = len(x)
    out = np.full((n, DEGREE), -1, np.int32)
    if n == 1:
        return out
    k = min(4 * LINKS, n - 1)
    chosen = np.full((n, LINKS), -1, np.int64)
    for at in range(0, n, 512):
        block = slice(at, min(at + 512, n))
        top, score = _nearest(x, block, k)
        between = np.einsum("bkd,bld->bkl", x[top], x[top])
        kept = np.zeros(top.shape, bool)
        for j in range(k):  # a link must be nearer to the node than to links kept before
            hidden = (kept[:, :j] & (between[:, j, :j] >= score[:, j, None])).any(axis=1)
            kept[:, j] = ~hidden & (kept[:, :j].sum(axis=1) < LINKS)
        order = np.argsort(~kept, axis=1, kind="stable")[:, :LINKS]  # thinned-out ones fill up
        chosen[block, :order.shape[1]] = np.take_along_axis(top, order, 1)
    own = np.repeat(np.arange(n), LINKS)
    to = chosen.ravel()
    own, to = own[to >= 0], to[to >= 0]
    # own links first, then reverses by nearness
    a, b = np.r_[own, to], np.r_[to, own]
    back = np.r_[np.zeros(len(own), int), np.ones(len(own), int)]
    order = np.lexsort((-np.einsum("ij,ij->i", x[a], x[b]), back, a))
    a, b = a[order], b[order]
    _, first = np.unique(a * n + b, return_index=True)
    again = np.ones(len(a), bool)
    again[first] = False
    a, b = a[~again], b[~again]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    fits = place < DEGREE - 1
    out[a[fits], place[fits]] = b[fits]
    out[:, -1] = (np.arange(n) + 1) % n
    return out


def build(ids: np.ndarray, vectors: np.ndarray) -> dict[str, np.ndarray]:
    """Flat arrays of a shard's graph."""
    order = np.argsort(ids, kind="stable")
    nodes, node_of = np.unique(vectors[order], axis=0, return_inverse=True)
    by_node = np.argsort(node_of.ravel(), kind="stable")
    member_start = np.r_[0, np.cumsum(np.bincount(node_of.ravel(), minlength=len(nodes)))]
    length = (nodes**2).sum(axis=1)
    x = np.column_stack([nodes, np.sqrt(np.maximum(length.max() - length, 0))]).astype(np.float32)
    levels = _levels(len(nodes))
    links = [_links(x[level]) for level in levels]
    links = [np.where(l < 0, -1, level[l]) for level, l in zip(levels, links)]
    return {
        "members": ids[order][by_node], "member_start": member_start.astype(np.int32), "vectors": nodes.ravel(),
        "level_nodes": np.concatenate(levels).astype(np.int32), "level_start": np.r_[0, np.cumsum([len(l) for l in levels])].astype(np.int32),
        "neighbours": np.concatenate(links).astype(np.int32).ravel(),
    }


# -- search -----------------------------------------------------------------------

def _beam(queries: np.ndarray, x: np.ndarray, row_of: np.ndarray, links: np.ndarray, start: np.ndarray, breadth: int) -> np.ndarray:
    """Best nodes of one level for each query, found from ``start`` (-1 fills up)."""
    q, at_once = len(queries), 4
    seen = np.zeros((q, len(row_of)), bool)
    beam = np.full((q, breadth), -1, np.int64)
    score = np.full((q, breadth), -np.inf, np.float32)
    done = np.ones((q, breadth), bool)
    rows = np.arange(q)
    new = start
    while True:
        # nodes not seen before, each once
        new = np.sort(new, axis=1)
        fresh = new >= 0
        fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
        r, c = np.nonzero(fresh)
        ids = new[r, c]
        unseen = ~seen[r, ids]
        r, c, ids = r[unseen], c[unseen], ids[unseen]
        seen[r, ids] = True
        gained = np.full(new.shape, -np.inf, np.float32)
        gained[r, c] = np.einsum("ij,ij->i", queries[r], x[ids])
        beam, score = np.concatenate([beam, new], 1), np.concatenate([score, gained], 1)
        done = np.concatenate([done, ~np.isfinite(gained)], 1)
        top = np.argpartition(-score, breadth - 1, axis=1)[:, :breadth]
        beam, score, done = (np.take_along_axis(z, top, 1) for z in (beam, score, done))
        beam[~np.isfinite(score)] = -1
        waiting = np.where(done, -np.inf, score)
        best = np.argpartition(-waiting, at_once - 1, axis=1)[:, :at_once]
        go = np.isfinite(np.take_along_axis(waiting, best, 1))
        if not go.any():
            return beam
        done[rows[:, None], best] = True
        expand = np.where(go, np.take_along_axis(beam, best, 1), -1)
        new = np.where((expand >= 0)[:, :, None], links[row_of[expand]], -1).reshape(q, -1)


def search(index: dict[str, np.ndarray], dim: int, ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its ``k`` nearest members other than itself: id, member ids, scores."""
    vectors = index["vectors"].reshape(-1, dim)
    x, q = vectors.astype(np.float32), queries.astype(np.float32)
    start, links = index["level_start"], index["neighbours"].reshape(-1, DEGREE)
    found = None
    for level in range(len(start) - 2, -1, -1):
        nodes = index["level_nodes"][start[level]:start[level + 1]]
        row_of = np.full(len(x), -1, np.int64)
        row_of[nodes] = np.arange(len(nodes))
        if found is None:
            found = np.full((len(q), 1), nodes[0])
        found = _beam(q, x, row_of, links[start[level]:start[level + 1]], found, max(BREADTH, 2 * k) if level == 0 else ABOVE)
    members, first = index["members"], index["member_start"]
    for i, own in enumerate(ids):
        near = found[i][found[i] >= 0]
        exact = vectors[near] @ queries[i]
        kept = [members[first[n]:first[n + 1]][:k + 1] for n in near]  # in order of their ids
        who, much = np.concatenate(kept), np.repeat(exact, [len(m) for m in kept])
        other = who != own
        who, much = who[other], much[other]
        best = np.lexsort((who, -much))[:k]
        yield own, who[best], much[best]


# -- as Spark jobs ----------------------------------------------------------------------

def clean(table: DataFrame) -> DataFrame:
    """``vec_id, embedding`` (doubles), once per id."""
    rows = table.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    return rows.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.col("embedding").cast("array<double>")).alias("embedding"))


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard of ``vec_id, embedding``."""
    shards = max(1, math.ceil(vectors.count() / shard_rows))

    def graph(pdf: pd.DataFrame) -> pd.DataFrame:
        arrays = build(pdf["vec_id"].to_numpy(), np.stack(pdf["embedding"].to_numpy()))
        return pd.DataFrame([{"dim": pdf["dim"].iloc[0], "shard": pdf["shard"].iloc[0], **arrays}])

    rows = vectors.select("vec_id", "embedding", F.size("embedding").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"))
    return rows.groupBy("dim", "shard").applyInPandas(graph, INDEX)


def nearest(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest of each query (``query_id, embedding``)."""
    blocks = max(1, math.ceil(queries.count() / QUERY_ROWS))
    shards = index.select(F.col("dim").alias("_dim"), F.col("shard").alias("_shard"))
    asked = queries.select("query_id", "embedding", F.size("embedding").alias("dim"), F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"))
    asked = asked.join(shards, F.col("dim") == F.col("_dim")).select("query_id", "embedding", F.col("_dim").alias("dim"), F.col("_shard").alias("shard"), "block")
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def look(graph: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(graph) or not len(rows):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        flat = {c: np.asarray(graph[c].iloc[0]) for c in graph.columns if c not in ("dim", "shard", "block")}
        hits = list(search(flat, int(graph["dim"].iloc[0]), rows["query_id"].to_numpy(), np.stack(rows["embedding"].to_numpy()), k))
        return pd.DataFrame({
            "query_id": np.repeat([h[0] for h in hits], [len(h[1]) for h in hits]).astype("int64"),
            "vec_id": np.concatenate([h[1] for h in hits]), "score": np.concatenate([h[2] for h in hits])})

    keys = ["dim", "shard", "block"]
    hits = held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(look, FOUND)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_table(table: DataFrame, is_query: Column, k: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Index a table of ``vec_id, embedding`` and search it for its own rows where ``is_query``."""
    scratch = Scratch(table.sparkSession, "hnsw")
    vectors = scratch.keep(clean(table))
    index = scratch.keep(build_index(vectors, shard_rows))
    return nearest(index, vectors.where(is_query).withColumnRenamed("vec_id", "query_id"), k)
