"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard, results merged."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Neighbours of a node in upper layers; twice as many in the ground layer.
M = 16
#: Candidates that a new node's neighbours are chosen from.
BREADTH = 64
#: Beam of a search in the ground layer.
BEAM = 160
#: Nodes that a step of a search opens for each query.
OPEN = 4
#: Bytes of the vectors of a shard, and its most rows.
SHARD_BYTES = 32 << 20
SHARD_ROWS = 16_384
#: Queries that are dealt together.
QUERIES = 8_192
_BLOCK = 256
#: Nodes that are inserted together.
BATCH = 1024


def _sims(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.concatenate([np.einsum("ij,ij->i", x[a[k : k + 65536]], x[b[k : k + 65536]]) for k in range(0, len(a), 65536)]) if len(a) else np.zeros(0, np.float32)


def _beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """A beam search of all queries at once in one layer: positions (len(x) for none) and their inner products."""
    n, nq = len(x), len(q)
    beam = min(beam, n)
    # Of what has been seen, the best; unused places hold position n.
    best = np.full((nq, beam), n, np.int64)
    sim = np.full((nq, beam), -np.inf, np.float32)
    done = np.ones((nq, beam), bool)
    best[:, 0], done[:, 0] = start, False
    sim[:, 0] = np.einsum("ij,ij->i", x[start], q)
    seen = np.zeros((nq, n + 1), bool)
    seen[:, n] = True
    seen[np.arange(nq), start] = True
    live = np.arange(nq)
    while len(live):
        value = np.where(done[live], -np.inf, sim[live])
        k = min(OPEN, beam)
        pick = np.argpartition(-value, k - 1, axis=1)[:, :k]
        ok = np.take_along_axis(value, pick, 1) > -np.inf
        some = ok.any(axis=1)
        live, pick, ok = live[some], pick[some], ok[some]
        if not len(live):
            break
        at = best[live[:, None], pick]
        done[live[:, None], pick] = True
        nb = links[np.where(ok, at, 0)].astype(np.int64)
        nb = np.where(ok[:, :, None] & (nb >= 0), nb, n).reshape(len(live), -1)
        nb = np.sort(nb, axis=1)
        fresh = ~seen[live[:, None], nb]
        fresh[:, 1:] &= nb[:, 1:] != nb[:, :-1]
        seen[live[:, None], nb] = True
        a, b = np.nonzero(fresh)
        got = np.full(nb.shape, -np.inf, np.float32)
        got[a, b] = np.einsum("ij,ij->i", x[nb[a, b]], q[live[a]])
        nb[~fresh] = n
        all_at = np.concatenate([best[live], nb], axis=1)
        all_sim = np.concatenate([sim[live], got], axis=1)
        all_done = np.concatenate([done[live], ~fresh], axis=1)
        top = np.argpartition(-all_sim, beam - 1, axis=1)[:, :beam]
        best[live], sim[live], done[live] = (np.take_along_axis(v, top, 1) for v in (all_at, all_sim, all_done))
    return best, sim


def _choose(x: np.ndarray, own: np.ndarray, cand: np.ndarray, m: int) -> np.ndarray:
    """The HNSW choice of neighbours for nodes ``own`` among ``cand``, nearest first, len(x) for none: from the nearest
    on, one is taken if none taken is nearer to it than the node; left places go to the nearest left out. -1 for none."""
    there = cand < len(x)
    v = x[np.where(there, cand, 0)]
    to_node = np.where(there, np.einsum("bcd,bd->bc", v, x[own]), -np.inf)
    between = v @ v.transpose(0, 2, 1)
    taken = np.zeros(cand.shape, bool)
    count = np.zeros(len(cand), np.int64)
    for c in range(cand.shape[1]):
        crowded = (np.where(taken, between[:, c, :], -np.inf) > to_node[:, c : c + 1]).any(axis=1)
        taken[:, c] = ~crowded & (count < m) & there[:, c]
        count += taken[:, c]
    # taken ones first, then the others, both nearest first
    order = np.argsort(np.where(there, np.where(taken, 0, 1), 2), axis=1, kind="stable")[:, :m]
    return np.where(np.take_along_axis(there, order, 1), np.take_along_axis(cand, order, 1), -1).astype(np.int32)


def _link_back(links: np.ndarray, x: np.ndarray, nodes: np.ndarray) -> None:
    """Let the neighbours of ``nodes`` point back at them; a node that then has too many chooses anew."""
    most = links.shape[1]
    b, a = links[nodes].reshape(-1).astype(np.int64), np.repeat(nodes, most)
    a, b = a[b >= 0], b[b >= 0]
    touched = np.unique(b)
    old = links[touched].reshape(-1).astype(np.int64)
    pair = np.unique(np.r_[b, np.repeat(touched, most)[old >= 0]] * len(x) + np.r_[a, old[old >= 0]])
    u, v = pair // len(x), pair % len(x)
    order = np.lexsort((-_sims(x, u, v), u))
    u, v = u[order], v[order]
    rank = np.arange(len(u)) - np.searchsorted(u, u)
    width = 2 * most
    cand = np.full((len(touched), width), len(x))
    keep = rank < width
    cand[np.searchsorted(touched, u[keep]), rank[keep]] = v[keep]
    full = cand[:, most] < len(x)
    links[touched[~full]] = np.where(cand[~full, :most] < len(x), cand[~full, :most], -1)
    for lo in range(0, int(full.sum()), _BLOCK):
        own = np.flatnonzero(full)[lo : lo + _BLOCK]
        links[touched[own]] = _choose(x, touched[own], cand[own], most)


def _insert_all(x: np.ndarray, first: np.ndarray, rest: np.ndarray, start: np.ndarray, m: int, most: int) -> np.ndarray:
    """A layer's flat neighbour arrays, by inserting its nodes in batches: each batch finds its neighbours by searching
    the graph of those before it, and among itself.

    ``first``: nodes that the layer above holds too, inserted first; ``rest``: the others, and ``start``: where the
    search of each begins, one of ``first``. A batch is no larger than what is there already, and ``BATCH`` at most.
    """
    links = np.full((len(x), most), -1, np.int32)
    order, begin = np.r_[first, rest], np.r_[np.full(len(first), -1), start]
    done = 0
    while done < len(order):
        batch = order[done : done + min(max(done, 64), BATCH)]
        cand = []
        for lo in range(0, len(batch) if done else 0, _BLOCK):
            own = batch[lo : lo + _BLOCK]
            at = begin[done + lo : done + lo + len(own)]
            cand.append(_beam(x, links, x[own], np.where(at < 0, order[0], at), BREADTH)[0])
        near = np.concatenate(cand) if cand else np.full((len(batch), 0), len(x))
        inside = x[batch] @ x[batch].T
        np.fill_diagonal(inside, -np.inf)
        k = min(m, len(batch) - 1)
        peers = batch[np.argpartition(-inside, k - 1, axis=1)[:, :k]] if k > 0 else np.full((len(batch), 0), len(x))
        both = np.concatenate([near, peers], axis=1)
        if both.shape[1]:
            sim = np.where(both < len(x), np.einsum("bcd,bd->bc", x[np.where(both < len(x), both, 0)], x[batch]), -np.inf)
            both = np.take_along_axis(both, np.argsort(-sim, axis=1, kind="stable"), 1)[:, :BREADTH]
            links[batch[:, None], np.arange(min(m, both.shape[1]))] = _choose(x, batch, both, m)
            _link_back(links, x, batch)
        done += len(batch)
    return links


class Graph:
    """A shard's graph: vectors, and for each layer its nodes and their neighbours as flat arrays.

    Inner products are searched as distances: each vector gets one more component that lifts it to the largest norm,
    so that the nearest of a query is the one with the largest inner product, whatever the norms.
    """

    def __init__(self, vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.vectors, self.layers = vectors, layers
        self.single = vectors.astype(np.float32)

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 5) -> Graph:
        """Levels are drawn as usual; layers are built from the top, each by inserting its nodes through searches that
        begin where the layer above ends."""
        norms = np.einsum("ij,ij->i", vectors, vectors)
        lifted = np.c_[vectors, np.sqrt(np.maximum(norms.max() - norms, 0))].astype(np.float32)
        n = len(vectors)
        rng = np.random.default_rng(seed)
        level = np.floor(-np.log(np.maximum(rng.random(n), 1e-12)) / math.log(M)).astype(np.int64)
        turn = rng.permutation(n)
        layers, above = [], np.zeros(0, np.int64)
        for depth in range(int(level.max()), -1, -1):
            rows = np.flatnonzero(level >= depth)
            x = lifted[rows]
            fresh = turn[level[turn] == depth]
            start = np.full(len(fresh), -1)
            for k, (upper, links) in enumerate(layers):  # from the top down
                for lo in range(0, len(fresh), 4096):
                    own = slice(lo, lo + 4096)
                    best, sim = _beam(lifted[upper], links, lifted[fresh[own]], np.maximum(start[own], 0), 8)
                    found = upper[best[np.arange(len(best)), sim.argmax(axis=1)]]
                    start[own] = np.searchsorted(layers[k + 1][0] if k + 1 < len(layers) else rows, found)
            layers.append((rows, _insert_all(x, np.searchsorted(rows, above), np.searchsorted(rows, fresh), start, M, 2 * M if depth == 0 else M)))
            above = turn[level[turn] >= depth]
        return cls(vectors, layers[::-1])

    def _walk(self, q: np.ndarray, depth: int, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        rows, links = self.layers[depth]
        return _beam(self.single[rows] if depth else self.single, links, q, start, beam)

    def search(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest found of each query: positions (-1 for none) and inner products in double precision."""
        out_at = np.full((len(queries), k), -1, np.int64)
        out_sim = np.full((len(queries), k), -np.inf)
        for lo in range(0, len(queries), _BLOCK):
            exact = queries[lo : lo + _BLOCK]
            q = exact.astype(np.float32)
            start = np.zeros(len(q), np.int64)
            for depth in range(len(self.layers) - 1, 0, -1):
                best, sim = self._walk(q, depth, start, 8)
                at = self.layers[depth][0][best[np.arange(len(q)), sim.argmax(axis=1)]]
                start = np.searchsorted(self.layers[depth - 1][0], at)
            best, sim = self._walk(q, 0, start, max(BEAM, k))
            width = min(k + 8, best.shape[1])
            top = np.argpartition(-sim, width - 1, axis=1)[:, :width]
            at = np.take_along_axis(best, top, 1)
            there = at < len(self.vectors)
            score = np.where(there, np.einsum("qkd,qd->qk", self.vectors[np.where(there, at, 0)], exact), -np.inf)
            order = np.argsort(-score, axis=1, kind="stable")[:, :k]
            at, score = np.take_along_axis(at, order, 1), np.take_along_axis(score, order, 1)
            out_at[lo : lo + len(q), : at.shape[1]] = np.where(score > -np.inf, at, -1)
            out_sim[lo : lo + len(q), : at.shape[1]] = score
        return out_at, out_sim

    def pack(self) -> dict[str, list[bytes]]:
        return {"rows": [r.astype(np.int32).tobytes() for r, _ in self.layers], "links": [v.tobytes() for _, v in self.layers], "vectors": self.vectors.tobytes()}

    @classmethod
    def unpack(cls, dim: int, rows: list[bytes], links: list[bytes], vectors: bytes) -> Graph:
        layers = []
        for r, v in zip(rows, links):
            own = np.frombuffer(r, np.int32).astype(np.int64)
            layers.append((own, np.frombuffer(v, np.int32).reshape(len(own), -1)))
        return cls(np.frombuffer(vectors, np.float64).reshape(-1, dim), layers)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id long, v array<double>) of the rows that take part, each once: a vec_id, and a vector that is neither null
    nor zero nor holds null or non-finite components. Minus zero counts as zero."""
    v = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.filter("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.coalesce(sound, F.lit(False)))


def build_index(points: DataFrame) -> DataFrame:
    """Graphs of ``points(vec_id, v)``: a row for each shard with its ids, vectors and each layer's flat arrays.

    Shards are dealt by hash within a dimension and hold about 16,384 rows, or fewer if vectors are long. They are
    dealt to as many tasks as there are shards, which adaptive execution does not merge by their few bytes.
    """
    shape = points.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"))
    rows = F.least(F.lit(SHARD_ROWS), F.greatest(F.lit(64), F.floor(F.lit(SHARD_BYTES) / (8 * F.col("dim"))).cast("int")))
    shape = shape.select("dim", F.ceil(F.col("n") / rows).cast("int").alias("shards"))
    tasks = shape.agg(F.sum("shards")).first()[0] or 1
    dealt = points.withColumn("dim", F.size("v")).join(shape, "dim").select("dim", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int").alias("shard"), "vec_id", "v")

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("vec_id").to_numpy(), kind="stable")
        ids = table.column("vec_id").to_numpy()[order]
        graph = Graph.build(_matrix(table.column("v"))[order])
        packed = graph.pack()
        return pa.table({
            "dim": table.column("dim").slice(0, 1), "shard": table.column("shard").slice(0, 1), "ids": pa.array([ids.tobytes()], pa.binary()),
            "rows": pa.array([packed["rows"]], pa.list_(pa.binary())), "links": pa.array([packed["links"]], pa.list_(pa.binary())), "vectors": pa.array([packed["vectors"]], pa.binary()),
        })

    return dealt.repartition(int(tasks), "dim", "shard").groupBy("dim", "shard").applyInArrow(run, "dim int, shard int, ids binary, rows array<binary>, links array<binary>, vectors binary")


def search_index(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, found_id, score): the k nearest found of each of ``queries(query_id, v)`` in each shard.

    The stated queries meet all shards in blocks: a task takes one shard's graph and up to some 8,192 queries.
    """
    dealt = queries.withColumn("dim", F.size("v"))
    blocks = dealt.groupBy("dim").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks"))
    shards = index.groupBy("dim").agg(F.collect_set("shard").alias("shards"))  # a number for each shard
    asked = dealt.join(blocks, "dim").join(shards, "dim").select("dim", F.explode("shards").alias("shard"), F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int").alias("block"), "query_id", "v")
    graphs = index.join(blocks, "dim").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def run(key, graph: pa.Table, asked: pa.Table) -> pa.Table:
        empty = {"query_id": pa.array([], pa.int64()), "found_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())}
        if not graph.num_rows or not asked.num_rows:
            return pa.table(empty)
        row = graph.slice(0, 1).to_pylist()[0]
        own = Graph.unpack(row["dim"], row["rows"], row["links"], row["vectors"])
        ids = np.frombuffer(row["ids"], np.int64)
        at, score = own.search(_matrix(asked.column("v")), k)
        q, c = np.nonzero(at >= 0)
        return pa.table({"query_id": pa.array(asked.column("query_id").to_numpy()[q]), "found_id": pa.array(ids[at[q, c]]), "score": pa.array(score[q, c])})

    both = graphs.groupBy("dim", "shard", "block").cogroup(asked.groupBy("dim", "shard", "block"))
    return both.applyInArrow(run, "query_id long, found_id long, score double")


def nearest(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """The k nearest others of each query row of ``vectors(vec_id, embedding)`` by inner product.

    Returns (query_id long, rank int from 1, vec_id long, score double), nearest first, ties to the smaller vec_id;
    fewer than k if there are fewer. Equal vectors are one point of the graphs and are listed behind it by vec_id (as
    many as can rank), so large groups of copies cost one search. Vectors meet those of their own dimension only.
    Vectors null, zero or with null or non-finite components and rows without a vec_id take no part; repeated rows
    count once; extra columns are ignored; an empty table gives an empty result.

    Fitting uses every vector. Scores are inner products of the original vectors in double precision.
    """
    points = usable(vectors)
    # Of each set of equal vectors only the k + 1 smallest ids can be among anyone's k nearest.
    spot = Window.partitionBy("v").orderBy("vec_id")
    members = materialize(
        points.distinct().withColumn("at", F.row_number().over(spot)).filter(F.col("at") <= k + 1), "hnsw-members"
    )
    rep = members.filter("at = 1").select(F.col("vec_id").alias("rep"), "v")
    index = materialize(build_index(rep.select(F.col("rep").alias("vec_id"), "v")), "hnsw-index")
    asked = points.filter(is_query).distinct().join(rep, "v").select(F.col("vec_id").alias("query_id"), "rep", "v")
    asked = materialize(asked, "hnsw-queries")
    each = asked.groupBy("rep").agg(F.first("v").alias("v")).select(F.col("rep").alias("query_id"), "v")
    found = search_index(index, each, k + 1)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "found_id")
    found = found.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= k + 1).select("query_id", "found_id", "score")
    ids = members.select("vec_id", "v").join(rep, "v").select("rep", "vec_id")
    listed = found.join(ids, found["found_id"] == ids["rep"]).select("query_id", "vec_id", "score")
    # All rows of one vector share this list, which holds one more than they need: each leaves itself out.
    listed = listed.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("at") <= k + 1)
    own = asked.select(F.col("query_id").alias("own"), "rep").join(listed.withColumnRenamed("query_id", "rep"), "rep").filter("own <> vec_id")
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("own").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select(F.col("own").alias("query_id"), "rank", "vec_id", "score")
