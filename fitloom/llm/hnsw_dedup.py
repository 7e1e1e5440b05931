"""Near-duplicate vectors by hierarchical navigable small-world graphs, one per shard.

Equal vectors are one node that carries the number of its copies, so a vector that makes up a
third of all rows is one row from the start. Nodes are dealt to shards by a hash of their
id; each shard's graph is built once, in its own task, and written as rows (vector and neighbour
lists per layer). Every chunk of nodes then queries every shard: tasks are (shard, chunk) pairs,
whose two sides are bounded by the shard and chunk sizes.

A graph has geometrically thinning layers. Nodes are inserted in batches: candidates come
from a beam search of the layer so far and from the batch itself; half of a node's neighbours
are its nearest (they hold dense groups together), half are chosen for diversity (a candidate
that is nearer to a chosen neighbour than to the node is passed over), which keeps dense
groups tied to the rest. A query descends the layers, searches the lowest with a beam, and then
follows every neighbour of every match, so a group larger than the beam is walked in full.

Audit: in each (shard, chunk) task ``AUDIT`` queries and ``PLANTED`` vectors made at the threshold and
nearer to nodes of the shard, which so have neighbours there, are also answered by brute force; a query's
own node is left out. While their recall is below ``RECALL``, the beam is doubled and all queries are answered again; a beam as
wide as the shard means brute force, in blocks. Matches are verified by the cosine in double
precision. A task sends, per query, the number of links, and a spanning forest of its links,
never the pairs; components are joined from the forests.

Edge cases: vectors that are NULL, empty or zero or hold NULL or non-finite numbers link with
nothing; vectors of different length do not link; repeated rows are copies of one vector and
count once per vec_id; rows with one vec_id and several vectors are one node of the component
graph; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitloom.llm.common import scratch
from fitloom.llm.components import components

THRESHOLD = 0.95
SLACK = 1e-4  # single precision search; double precision decides
LEAST_SHARDS, SHARD_NODES, CHUNK_NODES = 8, 50_000, 20_000
LINKS = 16
BUILD_BEAM, FIRST_BEAM = 48, 16
BATCH = 1024
AUDIT, PLANTED, RECALL = 64, 1000, 0.999
EXPAND = 4


class Graph:
    """HNSW over the rows of ``x`` (unit vectors, float32). ``layers[l]``: node numbers x neighbours, -1 padded."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray] | None = None, level: np.ndarray | None = None):
        self.x, self.n = x, len(x)
        if layers is not None:
            self.layers, self.level = layers, level
            return
        u = np.random.default_rng(self.n).random(self.n)
        self.level = np.floor(-np.log(1 - u) / np.log(LINKS)).astype(np.int64)
        self.level[0] = max(self.level[0], self.level.max())
        self.layers = [np.empty((0, 0), np.int32)] * (int(self.level[0]) + 1)
        for layer in range(int(self.level[0]), -1, -1):
            self._build(layer)

    def _build(self, layer: int) -> None:
        cap = LINKS * (2 if layer == 0 else 1)
        adj = np.full((self.n, cap), -1, np.int32)
        self.layers[layer] = adj
        nodes = np.flatnonzero(self.level >= layer)
        nodes = nodes[np.argsort(-self.level[nodes], kind="stable")]  # those of upper layers come first
        done = min(len(nodes), 2 * cap)
        self._link(layer, nodes[:done], nodes[:0], None)
        while done < len(nodes):
            new = nodes[done:done + min(BATCH, done)]
            # entries: what the layers above know, and they are in this layer already
            found, _ = self._beam(self.x[new], self._entries(new, layer, nodes[0]), layer, BUILD_BEAM)
            self._link(layer, new, nodes[:done], found)
            done += len(new)

    def _entries(self, new: np.ndarray, layer: int, first: int) -> np.ndarray:
        at = np.full((len(new), 1), first, np.int64)
        for upper in range(len(self.layers) - 1, layer, -1):
            at = self._beam(self.x[new], at, upper, 4)[0]
            at = np.where(at >= 0, at, first)
        # a node does not start from itself: its own lists are still empty here
        return np.where(at == new[:, None], first, at)

    def _link(self, layer: int, new: np.ndarray, old: np.ndarray, found: np.ndarray | None) -> None:
        adj = self.layers[layer]
        near = self.x[new] @ self.x[new].T
        np.fill_diagonal(near, -2)
        k = min(BUILD_BEAM, len(new))
        own = np.argpartition(-near, k - 1, 1)[:, :k] if k else np.empty((len(new), 0), int)
        candidates = np.where(np.take_along_axis(near, own, 1) > -2, new[own], -1) if k else own
        if found is not None:
            candidates = np.concatenate([candidates, found], 1)
        adj[new] = self._choose(new, candidates, LINKS if layer else LINKS, adj.shape[1])
        # links back, chosen anew where a list would overflow
        src = np.repeat(new, adj.shape[1])
        dst = adj[new].ravel().astype(np.int64)
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.lexsort((-np.einsum("kd,kd->k", self.x[src], self.x[dst]), dst))  # the nearest first
        src, dst = src[order], dst[order]
        target, start, count = np.unique(dst, return_index=True, return_counts=True)
        width = min(int(count.max()), 4 * BUILD_BEAM) if len(count) else 0
        for lo in range(0, len(target), BATCH):
            t, s, c = target[lo:lo + BATCH], start[lo:lo + BATCH], count[lo:lo + BATCH]
            take = s[:, None] + np.arange(width)
            back = np.where(np.arange(width) < c[:, None], src[np.minimum(take, len(src) - 1)], -1)
            adj[t] = self._choose(t, np.concatenate([adj[t].astype(np.int64), back], 1), adj.shape[1], adj.shape[1])

    def _choose(self, nodes: np.ndarray, candidates: np.ndarray, most: int, cap: int) -> np.ndarray:
        """Half nearest, half diverse: at most ``most`` of the candidates of each node."""
        candidates = np.sort(candidates, 1)
        candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
        candidates[candidates == nodes[:, None]] = -1
        sim = np.einsum("nd,ncd->nc", self.x[nodes], self.x[candidates])
        sim[candidates < 0] = -3
        width = min(candidates.shape[1], 2 * BUILD_BEAM)
        order = np.argsort(-sim, 1)[:, :width]
        candidates, sim = np.take_along_axis(candidates, order, 1), np.take_along_axis(sim, order, 1)
        v = self.x[candidates]
        among = np.einsum("ncd,nkd->nck", v, v)
        rows = np.arange(len(nodes))
        chosen = np.zeros(candidates.shape, bool)
        taken = np.zeros(len(nodes), np.int64)
        # diverse part: nearer to the node than to every neighbour chosen so far
        closest = np.full(candidates.shape, -3.0, np.float32)
        for c in range(candidates.shape[1]):
            ok = (candidates[:, c] >= 0) & (taken < most - most // 2) & (closest[:, c] < sim[:, c])
            chosen[ok, c] = True
            taken[ok] += 1
            closest[ok] = np.maximum(closest[ok], among[ok, c])
        for c in range(candidates.shape[1]):
            ok = (candidates[:, c] >= 0) & ~chosen[:, c] & (taken < most)
            chosen[ok, c] = True
            taken[ok] += 1
        out = np.full((len(nodes), cap), -1, np.int32)
        r, c = np.nonzero(chosen)
        place = np.cumsum(chosen, 1)[r, c] - 1
        out[rows[r], place] = candidates[r, c]
        return out

    def _beam(self, q: np.ndarray, entry: np.ndarray, layer: int, ef: int, visited: np.ndarray | None = None,
              hits: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ``ef`` best nodes found for each query (-1 padded) and their cosines. ``hits`` gets every
        (queries, nodes) at the threshold that was met, also those that the beam has no room for."""
        adj, m = self.layers[layer], len(q)
        seen = np.zeros((m, self.n), bool) if visited is None else visited
        ids = np.full((m, ef), -1, np.int64)
        sims = np.full((m, ef), -3, np.float32)
        open_ = np.zeros((m, ef), bool)

        def offer(rows: np.ndarray, nodes: np.ndarray) -> None:
            """Offer nodes (rows x k, -1: none) to the beams of ``rows``."""
            nodes = np.sort(nodes, 1)
            nodes[:, 1:][nodes[:, 1:] == nodes[:, :-1]] = -1
            nodes[seen[rows[:, None], nodes] & (nodes >= 0)] = -1
            r, c = np.nonzero(nodes >= 0)
            seen[rows[r], nodes[r, c]] = True
            sim = np.full(nodes.shape, -3, np.float32)
            sim[r, c] = near = np.einsum("kd,kd->k", q[rows[r]], self.x[nodes[r, c]])
            if hits is not None and (good := near >= THRESHOLD - SLACK).any():
                hits.append((rows[r[good]], nodes[r[good], c[good]]))
            all_ids = np.concatenate([ids[rows], nodes], 1)
            all_sims = np.concatenate([sims[rows], sim], 1)
            all_open = np.concatenate([open_[rows], nodes >= 0], 1)
            best = np.argpartition(-all_sims, ef - 1, 1)[:, :ef]
            ids[rows] = np.take_along_axis(all_ids, best, 1)
            sims[rows] = np.take_along_axis(all_sims, best, 1)
            open_[rows] = np.take_along_axis(all_open, best, 1)

        offer(np.arange(m), entry.astype(np.int64).copy())
        while True:
            rows = np.flatnonzero(open_.any(1))
            if not len(rows):
                return ids, sims
            ranked = np.where(open_[rows], sims[rows], -4)
            k = min(EXPAND, ef)
            pick = np.argpartition(-ranked, k - 1, 1)[:, :k]
            use = np.take_along_axis(ranked, pick, 1) > -4
            nodes = np.take_along_axis(ids[rows], pick, 1)
            flag = open_[rows]
            np.put_along_axis(flag, pick, False, 1)
            open_[rows] = flag
            offer(rows, np.where(use[:, :, None], adj[nodes], -1).reshape(len(rows), -1).astype(np.int64))

    def matches(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs found with cosine ``THRESHOLD - SLACK`` or more."""
        out_q, out_n = [], []
        step = max(16, min(BATCH, 50_000_000 // max(self.n, 1)))
        for lo in range(0, len(q), step):
            part = q[lo:lo + step]
            if ef >= self.n:
                r, c = np.nonzero(part @ self.x.T >= THRESHOLD - SLACK)
                out_q.append(r + lo), out_n.append(c)
                continue
            at = np.zeros((len(part), 1), np.int64)
            for layer in range(len(self.layers) - 1, 0, -1):
                at = self._beam(part, at, layer, 4)[0]
                at = np.where(at >= 0, at, 0)
            seen = np.zeros((len(part), self.n), bool)
            hits: list = []
            self._beam(part, at, 0, ef, seen, hits)
            r, node = (np.concatenate(x) if hits else np.empty(0, np.int64) for x in (zip(*hits, strict=True) if hits else ((), ())))
            while len(r):
                out_q.append(r + lo), out_n.append(node)
                near = self.layers[0][node].astype(np.int64)
                r2, n2 = np.repeat(r, near.shape[1]), near.ravel()
                key = np.unique(r2[n2 >= 0] * self.n + n2[n2 >= 0])
                r2, n2 = key // self.n, key % self.n
                fresh = ~seen[r2, n2]
                r2, n2 = r2[fresh], n2[fresh]
                seen[r2, n2] = True
                good = np.einsum("kd,kd->k", part[r2], self.x[n2]) >= THRESHOLD - SLACK
                r, node = r2[good], n2[good]
        return np.concatenate(out_q or [np.empty(0, int)]), np.concatenate(out_n or [np.empty(0, int)])


def _planted(x: np.ndarray) -> np.ndarray:
    """Unit vectors with a cosine between the threshold and 1 to nodes of the shard."""
    rng = np.random.default_rng(len(x))
    v = x[rng.permutation(len(x))[:PLANTED]].astype(np.float64)
    off = rng.normal(size=v.shape)
    off -= (off * v).sum(1, keepdims=True) * v
    off /= np.maximum(np.sqrt((off * off).sum(1, keepdims=True)), 1e-12)
    cosine = rng.uniform(THRESHOLD, 1, (len(v), 1))
    return (cosine * v + np.sqrt(1 - cosine * cosine) * off).astype(np.float32)


def audited(graph: Graph, q: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Matches of all queries with the first beam whose audit passes; and that beam. ``own``: each query's node, -1: none."""
    ef = min(FIRST_BEAM, graph.n)
    sample = np.linspace(0, len(q) - 1, min(AUDIT, len(q))).astype(int)
    planted = _planted(graph.x)
    asked = np.concatenate([q[sample], planted])
    mine = np.concatenate([np.full(len(sample), -1) if own is None else own[sample], np.full(len(planted), -1)])
    truth = 0
    for lo in range(0, len(asked), BATCH // 4):
        r, n = np.nonzero(asked[lo:lo + BATCH // 4] @ graph.x.T >= THRESHOLD - SLACK)
        truth += int((n != mine[r + lo]).sum())
    while True:
        r, n = graph.matches(asked, ef)
        if (n != mine[r]).sum() >= RECALL * truth or ef >= graph.n:
            r, n = graph.matches(q, ef)
            return r, n, ef
        ef = min(2 * ef, graph.n)


def _matrix(column: pa.ChunkedArray, dtype: type = np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def _build(t: pa.Table) -> pa.Table:
    graph = Graph(_matrix(t.column("unit")).astype(np.float32))
    lists = [b"".join(layer[i].tobytes() for layer in graph.layers[:graph.level[i] + 1]) for i in range(graph.n)]
    return t.append_column("at", pa.array(np.arange(graph.n, dtype=np.int32))).append_column("lists", pa.array(lists, pa.binary()))


def _load(t: pa.Table) -> tuple[pa.Table, Graph]:
    t = t.sort_by("at")
    lists = [np.frombuffer(b, np.int32) for b in t.column("lists").to_pylist()]
    level = np.array([(len(x) - 2 * LINKS) // LINKS for x in lists])
    layers = []
    for layer in range(int(level.max()) + 1):
        start, width = (0, 2 * LINKS) if layer == 0 else ((layer + 1) * LINKS, LINKS)
        adj = np.full((len(lists), width), -1, np.int32)
        for i in np.flatnonzero(level >= layer):
            adj[i] = lists[i][start:start + width]
        layers.append(adj)
    return t, Graph(_matrix(t.column("unit")).astype(np.float32), layers, level)


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and, for each, the smallest id it is joined to by the pairs (a, b)."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == root).all():
            return ids, ids[root]
        root = new


def _query(shard: pa.Table, chunk: pa.Table) -> pa.Table:
    empty = pa.table({"id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64()), "beam": pa.array([], pa.int32())})
    if not shard.num_rows or not chunk.num_rows:
        return empty
    shard, graph = _load(shard)
    mine, theirs = chunk.column("id").to_numpy(), shard.column("id").to_numpy()
    q, x = _matrix(chunk.column("unit")), _matrix(shard.column("unit"))
    by_id = np.argsort(theirs)
    at = by_id[np.minimum(np.searchsorted(theirs, mine, sorter=by_id), len(theirs) - 1)]
    r, n, ef = audited(graph, q.astype(np.float32), np.where(theirs[at] == mine, at, -1))
    good = (mine[r] != theirs[n]) & (np.einsum("kd,kd->k", q[r], x[n]) >= THRESHOLD)
    r, n = r[good], n[good]
    links = np.bincount(r, shard.column("weight").to_numpy()[n], len(mine)).astype(np.int64)
    ids, roots = _roots(mine[r], theirs[n])
    zero = np.zeros(len(ids), np.int64)
    return pa.table({"id": pa.array(np.concatenate([mine, ids])), "links": pa.array(np.concatenate([links, zero])),
                     "root": pa.array(np.concatenate([mine, roots])), "beam": pa.array(np.full(len(mine) + len(ids), ef, np.int32))})


def near_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of (vec_id, embedding)."""
    e = F.col("embedding").cast("array<double>")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    peak = F.array_max(F.transform(e, lambda x: F.abs(x)))  # scaled by it, no square overflows or vanishes
    rows = rows.select("vec_id", F.when((F.size(e) > 0) & ~bad & (peak > 0), F.transform(e, lambda x: x / peak)).alias("v"))
    rows = rows.withColumn("key", F.unhex(F.sha2(F.array_join(F.transform("v", lambda x: x.cast("string")), ","), 256)))
    rows = scratch(rows, "vec-rows")
    nodes = (rows.where("v is not null").groupBy("key").agg(F.min("vec_id").alias("id"), F.countDistinct("vec_id").alias("weight"), F.first("v").alias("v")))
    n = rows.where("v is not null").select("key").distinct().count()
    shards, chunks = max(LEAST_SHARDS, -(-n // SHARD_NODES)), max(1, -(-n // CHUNK_NODES))

    def unit(batches):
        for b in batches:
            out = []
            for v in b.column(2):
                x = np.array(v.values, dtype=np.float64)
                out.append((x / np.sqrt((x * x).sum())).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["id", "weight", "unit"])

    units = scratch(nodes.where("id is not null").select("id", "weight", "v").mapInArrow(unit, "id long, weight long, unit binary"), "vec-units")
    units = units.withColumn("dim", F.octet_length("unit")).withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    columns = "id long, weight long, unit binary, dim int, shard int"
    graphs = scratch(units.groupBy("dim", "shard").applyInArrow(_build, columns + ", at int, lists binary"), "vec-graphs")
    left = graphs.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = (units.drop("shard").withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(chunks)).cast("int"))
             .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))
    keys = ["dim", "shard", "chunk"]
    answered = scratch(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_query, "id long, links long, root long, beam int"), "vec-answers")
    links = answered.groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(answered.select(F.col("id").alias("a"), F.col("root").alias("b")))
    per_node = (nodes.select("key", "id", "weight").join(links, "id", "left").join(joined, F.col("id") == F.col("node"), "left")
                .select(F.col("key").alias("k"), "id", F.coalesce("component", "id").alias("component"),
                        (F.coalesce("links", F.lit(0)) + F.greatest(F.col("weight") - 1, F.lit(0))).alias("links")))
    out = rows.select("vec_id", "key").join(per_node, F.col("key") == F.col("k"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
