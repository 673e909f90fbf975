"""Embedding near-duplicates through hierarchical navigable small-world graphs, one for each shard.

Distinct vectors are dealt over shards.  A shard's task builds its graph, audits it against brute force
with a fixed set of vectors of all shards, widens the beam until the audit passes, and then lets the
vectors of all shards stream through as queries.  An audit counts links to other vectors only, and where
it meets too few of them, the nearest neighbours; where no beam passes, the shard is scanned whole.  What a beam finds above the threshold is followed through the graph
until nothing more is found, so groups larger than the beam are found whole.  Cosines near the
threshold are decided in double precision.  A shard gives counts and a forest of links, never pairs.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rankloom.operators.sizing import salted_join

from .components import components
from .shared import materialize, table

THRESHOLD = 0.9
MIN_SHARDS = 4
SHARD_ROWS = 250_000
LINKS = 12
BEAM = 24
BUILD_BEAM = 48
#: widest beam; a scan of the shard by matrix products costs less than wider ones
MAX_BEAM = 96
AUDIT_ROWS = 512
AUDIT_RECALL = 0.98
#: sampled vectors with links that an audit by links takes, and the neighbours that are looked for otherwise
AUDIT_LINKED = 64
AUDIT_NEAREST = 10
HOT_COPIES = 100_000
_STATE_BYTES = 16 << 20


class Graph:
    """A layered graph over unit vectors; rows of ``near[0]`` list up to 2 * LINKS neighbours."""

    def __init__(self, vectors: np.ndarray, seed: int = 1, batch: int = 256):
        self.x = vectors.astype(np.float32)
        size = len(vectors)
        draws = np.random.default_rng(seed).random(size)
        level = np.floor(-np.log(np.maximum(draws, 1e-12)) / np.log(LINKS)).astype(int)
        order = np.argsort(-level, kind="stable")  # upper nodes first: they are the way in for the others
        self.top = int(level.max()) if size else -1
        self.near = [np.full((size, LINKS * (2 if k == 0 else 1)), -1, np.int32) for k in range(self.top + 1)]
        self.entry = int(order[0]) if size else -1
        done = 1
        while done < size:
            # a batch is never larger than what is there to be searched
            new = order[done:done + min(batch, done)]
            self._insert(new, level)
            done += len(new)

    def _insert(self, new: np.ndarray, level: np.ndarray) -> None:
        queries = self.x[new]
        at = np.full((len(new), 1), self.entry)
        for k in range(self.top, -1, -1):
            found, sims = self._beam(queries, at, k, BUILD_BEAM if (level[new] >= k).any() else 1)
            at = found[:, :4] if k else found
            own = np.flatnonzero(level[new] >= k)
            if not len(own):
                continue
            among = queries[own] @ queries[own].T
            np.fill_diagonal(among, -2)
            ids = np.concatenate([found[own], np.broadcast_to(new[own], among.shape)], axis=1)
            sims = np.concatenate([sims[own], among], axis=1)
            self.near[k][new[own]] = self._select(ids, sims, k)
            self._link_back(new[own], k)

    def _select(self, ids: np.ndarray, sims: np.ndarray, k: int) -> np.ndarray:
        """Half of the slots for neighbours that differ from one another, the rest for the nearest."""
        slots = self.near[k].shape[1]
        width = min(ids.shape[1], 3 * slots)
        sims = np.where(ids < 0, -2, sims)
        first = np.argsort(-sims, axis=1, kind="stable")[:, :width]
        ids, sims = np.take_along_axis(ids, first, 1), np.take_along_axis(sims, first, 1)
        out = np.full((len(ids), slots), -1, np.int32)
        for start in range(0, len(ids), 256):
            own = slice(start, start + 256)
            i, s = ids[own], sims[own]
            real = s > -1.5
            points = self.x[np.maximum(i, 0)]
            among = points @ points.transpose(0, 2, 1)
            nearest = np.full(i.shape, -2, np.float32)  # to the neighbours chosen so far
            chosen = np.zeros(i.shape, bool)
            for j in range(width):
                take = real[:, j] & (nearest[:, j] < s[:, j]) & (chosen.sum(axis=1) < slots // 2)
                chosen[:, j] = take
                nearest = np.where(take[:, None], np.maximum(nearest, among[:, j]), nearest)
            rank = np.where(chosen, 0, 1) + np.where(real, 0, 2)
            best = np.argsort(rank, axis=1, kind="stable")[:, :slots]
            picked = np.take_along_axis(i, best, 1)
            picked[~np.take_along_axis(real, best, 1)] = -1
            out[own, : picked.shape[1]] = picked
        return out

    def _link_back(self, new: np.ndarray, k: int) -> None:
        slots = self.near[k].shape[1]
        to = self.near[k][new].ravel()
        back = np.repeat(new, slots)[to >= 0]
        to = to[to >= 0]
        sims = np.einsum("ij,ij->i", self.x[to], self.x[back])
        order = np.lexsort((-sims, to))
        to, back = to[order], back[order]
        target, first, many = np.unique(to, return_index=True, return_counts=True)
        rank = np.arange(len(to)) - np.repeat(first, many)
        keep = rank < slots
        more = np.full((len(target), slots), -1, np.int32)
        more[np.repeat(np.arange(len(target)), many)[keep], rank[keep]] = back[keep]
        ids = np.concatenate([self.near[k][target], more], axis=1)
        for start in range(0, len(target), 512):
            own = slice(start, start + 512)
            sims = np.einsum("ijk,ik->ij", self.x[np.maximum(ids[own], 0)], self.x[target[own]])
            self.near[k][target[own]] = self._select(ids[own], sims, k)

    def _beam(self, queries: np.ndarray, start: np.ndarray, k: int, width: int, hits=None, at_once: int = 4):
        """The best ``width`` nodes of layer ``k`` for each query, best first; ``hits`` collects all above its threshold."""
        many = len(queries)
        rows = np.arange(many)[:, None]
        seen = np.zeros((many, len(self.x)), bool)
        start = np.where(start < 0, start[:, :1], start)
        start = np.sort(start, axis=1)
        start[:, 1:][start[:, 1:] == start[:, :-1]] = -1
        seen[rows, np.where(start < 0, start[:, -1:], start)] = True
        width = max(width, start.shape[1])
        ids = np.full((many, width), -1, np.int64)
        sims = np.full((many, width), -2, np.float32)
        ids[:, : start.shape[1]] = start
        sims[:, : start.shape[1]] = np.where(
            start < 0, -2, np.einsum("ijk,ik->ij", self.x[np.maximum(start, 0)], queries)
        )
        if hits is not None:
            hits.add(rows, start, sims[:, : start.shape[1]])
        fresh = ids >= 0
        live = np.arange(many)
        while len(live):
            s = np.where(fresh[live], sims[live], -3)
            pick = np.argsort(-s, axis=1)[:, :at_once]
            good = np.take_along_axis(s, pick, 1) > -2.5
            live, pick, good = live[good[:, 0]], pick[good[:, 0]], good[good[:, 0]]
            if not len(live):
                break
            nodes = np.where(good, np.take_along_axis(ids[live], pick, 1), -1)
            fresh[live[:, None], pick] = False
            near = np.where(nodes[:, :, None] < 0, -1, self.near[k][np.maximum(nodes, 0)]).reshape(len(live), -1)
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            new = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
            r, c = np.nonzero(new)
            node = near[r, c]
            seen[live[r], node] = True
            found = np.full(near.shape, -2, np.float32)
            found[r, c] = np.einsum("ij,ij->i", self.x[node], queries[live[r]])
            if hits is not None:
                hits.add(live[r], node, found[r, c])
            all_ids = np.concatenate([ids[live], near], axis=1)
            all_sims = np.concatenate([sims[live], found], axis=1)
            all_fresh = np.concatenate([fresh[live], new], axis=1)
            best = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
            ids[live] = np.take_along_axis(all_ids, best, 1)
            sims[live] = np.take_along_axis(all_sims, best, 1)
            fresh[live] = np.take_along_axis(all_fresh, best, 1) & (sims[live] > -1.5)
        order = np.argsort(-sims, axis=1, kind="stable")
        if hits is not None:
            hits.seen = seen
        return np.where(np.take_along_axis(sims, order, 1) > -1.5, np.take_along_axis(ids, order, 1), -1), np.take_along_axis(sims, order, 1)

    def nearest(self, queries: np.ndarray, width: int, hits=None) -> np.ndarray:
        """The nodes of the last beam for each query, best first (-1: none)."""
        queries = queries.astype(np.float32)
        at = np.full((len(queries), 1), self.entry)
        for k in range(self.top, 0, -1):
            at = self._beam(queries, at, k, 4)[0][:, :4]
        return self._beam(queries, at, 0, width, hits)[0]

    def within(self, queries: np.ndarray, threshold: float, width: int):
        """(query number, node) of everything found above ``threshold``, beam first, then from hit to hit."""
        queries = queries.astype(np.float32)
        hits = _Hits(threshold)
        self.nearest(queries, width, hits)
        rows, nodes = (np.concatenate(x) for x in zip(*hits.found)) if hits.found else (np.zeros(0, int),) * 2
        out, seen = [(rows, nodes)], hits.seen
        while len(rows):
            near = self.near[0][nodes]
            r, node = np.repeat(rows, near.shape[1]), near.ravel()
            fresh = node >= 0
            fresh[fresh] = ~seen[r[fresh], node[fresh]]
            r, node = r[fresh], node[fresh]
            if len(r):
                r, node = np.divmod(np.unique(r * len(self.x) + node), len(self.x))
            seen[r, node] = True
            ok = np.concatenate([
                np.einsum("ij,ij->i", self.x[node[i:i + 65536]], queries[r[i:i + 65536]]) >= threshold
                for i in range(0, len(r), 65536)
            ] or [np.zeros(0, bool)])
            rows, nodes = r[ok], node[ok]
            out.append((rows, nodes))
        return tuple(np.concatenate(x) for x in zip(*out))


class _Hits:
    def __init__(self, threshold: float):
        self.threshold, self.found, self.seen = threshold, [], None

    def add(self, rows, nodes, sims) -> None:
        rows, nodes = np.broadcast_arrays(rows, nodes)
        good = (sims >= self.threshold) & (nodes >= 0)
        self.found.append((rows[good], nodes[good]))


class Shard:
    """A graph with the double-precision vectors, the audited beam (None: no beam passed) and the links seen so far.

    ``audit`` holds (nodes, vectors) of the audit's queries, of any shard; without it the shard's own are sampled.
    """

    def __init__(self, nodes: np.ndarray, copies: np.ndarray, vectors: np.ndarray, threshold: float, audit=None):
        self.nodes, self.copies, self.vectors, self.threshold = nodes, copies, vectors, threshold
        self.graph = Graph(vectors)
        self.root = np.arange(len(nodes))
        if audit is None:
            own = np.linspace(0, len(nodes) - 1, min(AUDIT_ROWS, len(nodes))).astype(int)
            audit = nodes[own], vectors[own]
        self.beam = self._audited(*audit)

    def _candidates(self, vectors: np.ndarray, beam: int | None):
        step = max(16, min(512, _STATE_BYTES // max(1, len(self.nodes))))
        for start in range(0, len(vectors), step):
            part = vectors[start:start + step]
            if beam is None:
                rows, found = np.nonzero(part.astype(np.float32) @ self.graph.x.T >= self.threshold - 1e-5)
            else:
                rows, found = self.graph.within(part, self.threshold - 1e-5, beam)
            yield rows + start, found

    def _audited(self, asked: np.ndarray, vectors: np.ndarray) -> int | None:
        """Double the beam until the audit's vectors find enough of what a scan finds, themselves left out."""
        links, linked, nearest = [], 0, []
        for start in range(0, len(asked), 64):
            sims = vectors[start:start + 64] @ self.vectors.T
            sims[asked[start:start + 64, None] == self.nodes] = -2
            found = (sims >= self.threshold).sum(axis=1)
            links.append(found)
            linked += (found > 0).sum()
            k = min(AUDIT_NEAREST, len(self.nodes))
            nearest.append(np.partition(sims, len(self.nodes) - k, axis=1)[:, len(self.nodes) - k])
        links, nearest = (np.concatenate(x) if x else np.zeros(0) for x in (links, nearest))
        beam = BEAM
        while beam <= MAX_BEAM:
            if self._finds_links(asked, vectors, links, beam) and (
                linked >= AUDIT_LINKED or self._finds_nearest(asked, vectors, nearest, beam)
            ):
                return beam
            beam *= 2
        return None

    def _finds_links(self, asked: np.ndarray, vectors: np.ndarray, links: np.ndarray, beam: int) -> bool:
        """Recall of all links, and its mean over the vectors that have some: large groups do not hide small ones."""
        found = np.zeros(len(asked), np.int64)
        for rows, at in self._candidates(vectors, beam):
            good = np.einsum("ij,ij->i", vectors[rows], self.vectors[at]) >= self.threshold
            good &= asked[rows] != self.nodes[at]
            found += np.bincount(rows[good], minlength=len(asked))
        some = links > 0
        return not some.any() or min(found.sum() / links.sum(), (found[some] / links[some]).mean()) >= AUDIT_RECALL

    def _finds_nearest(self, asked: np.ndarray, vectors: np.ndarray, nearest: np.ndarray, beam: int) -> bool:
        """Recall of the AUDIT_NEAREST nearest; ``nearest`` has the cosine of each vector's last one."""
        k = min(AUDIT_NEAREST, len(self.nodes) - 1)
        found, wanted = 0, 0
        for start in range(0, len(asked), 64):
            own = slice(start, start + 64)
            at = self.graph.nearest(vectors[own], beam)
            sims = np.einsum("ijk,ik->ij", self.vectors[np.maximum(at, 0)], vectors[own])
            good = (at >= 0) & (asked[own, None] != self.nodes[at]) & (sims >= nearest[own, None] - 1e-6)
            found += np.minimum(good.sum(axis=1), k).sum()
            wanted += k * len(at)
        return found >= AUDIT_RECALL * wanted

    def _find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return int(i)

    def answer(self, nodes: np.ndarray, vectors: np.ndarray):
        """(node, number of linked vectors here, one of them) of the queries that have links."""
        out = []
        for rows, at in self._candidates(vectors, self.beam):
            exact = np.concatenate([
                np.einsum("ij,ij->i", vectors[rows[i:i + 65536]], self.vectors[at[i:i + 65536]]) >= self.threshold
                for i in range(0, len(rows), 65536)
            ] or [np.zeros(0, bool)])
            linked = exact & (nodes[rows] != self.nodes[at])
            rows, at = rows[linked], at[linked]
            order = np.argsort(rows, kind="stable")
            rows, at = rows[order], at[order]
            query, first, many = np.unique(rows, return_index=True, return_counts=True)
            if not len(query):
                continue
            for a, n in zip(first.tolist(), many.tolist()):
                top = self._find(at[a])
                for other in np.unique(self.root[at[a:a + n]]).tolist():
                    other = self._find(other)
                    if other != top:
                        low, high = min(top, other), max(top, other)
                        self.root[high] = top = low
            out.append((nodes[query], np.add.reduceat(self.copies[at], first), self.nodes[at[first]]))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else None

    def forest(self):
        """(node, None, root) of the nodes that queries have joined."""
        found = np.array([self._find(i) for i in range(len(self.root))], int)
        moved = np.flatnonzero(found != np.arange(len(found)))
        return self.nodes[moved], self.nodes[found[moved]]


def _units(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    vectors = flat.reshape(len(column), -1)
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def _serve(threshold: float):
    def rows(nodes, counts, others):
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(counts, pa.int64()), pa.array(others, pa.int64())], ["node", "n", "other"])

    def serve(batches):
        """Rows come by shard, its own vectors (role 0) before the audit's (role 1) and the queries (role 2)."""
        key, shard, held, audit = None, None, [], []

        def ready():
            table_, asked = pa.Table.from_batches(held), pa.Table.from_batches(audit, held[0].schema)
            return Shard(
                table_.column("node").to_numpy(), table_.column("copies").to_numpy(),
                _units(table_.column("v").combine_chunks()), threshold,
                (asked.column("node").to_numpy(), _units(asked.column("v").combine_chunks())),
            )

        for batch in batches:
            shards, roles = batch.column("shard").to_numpy(), batch.column("role").to_numpy()
            cuts = np.flatnonzero((np.diff(shards) != 0) | (np.diff(roles) != 0)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(shards)]):
                if start == end:
                    continue
                if shards[start] != key:
                    if shard is not None:
                        nodes, others = shard.forest()
                        yield rows(nodes, np.zeros(len(nodes), np.int64), others)
                    key, shard, held, audit = shards[start], None, [], []
                part = batch.slice(start, end - start)
                if roles[start] < 2:
                    (audit if roles[start] else held).append(part)
                    continue
                if shard is None:
                    if not held:  # no vector of this length was dealt to this shard
                        continue
                    shard, held, audit = ready(), [], []
                found = shard.answer(part.column("node").to_numpy(), _units(part.column("v")))
                if found:
                    yield rows(*found)
        if shard is not None:
            nodes, others = shard.forest()
            yield rows(nodes, np.zeros(len(nodes), np.int64), others)

    return serve


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, min_shards: int = MIN_SHARDS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Equal vectors are one node with a number of copies. Vectors that are null, empty, zero or hold null
    or non-finite components have no links; vectors of different lengths are not compared. A repeated
    vec_id keeps its rows; a null vec_id is never the smallest of a component with other ids. Links are
    those the audited graphs (or scans) find, none below ``threshold``; an empty table gives an empty result.
    """
    v = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.exists("v", lambda c: c != 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select("vec_id", v.alias("v"))
    rows = rows.withColumn("v", F.when(F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)), F.col("v")))
    rows = materialize(rows, "vectors")
    nodes = rows.filter("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    shards = max(min_shards, -(-nodes.count() // shard_rows))
    # one shard number for each length of vectors and each part
    own = F.xxhash64("node")
    key = F.size("v").cast("long") * shards
    kept = nodes.select((key + F.pmod(own, F.lit(shards))).alias("shard"), F.lit(0).alias("role"), "node", "copies", "v")
    everywhere = F.explode(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: key + i)).alias("shard")
    asked = nodes.select(everywhere, F.lit(2).alias("role"), "node", "copies", "v")
    # the same vectors audit all shards of a length
    place = F.row_number().over(Window.partitionBy(F.size("v")).orderBy(F.xxhash64("node", F.lit(29)), "node"))
    chosen = nodes.select("node", "copies", "v", place.alias("place")).filter(F.col("place") <= AUDIT_ROWS)
    audit = chosen.select(everywhere, F.lit(1).alias("role"), "node", "copies", "v")
    dealt = kept.unionByName(audit).unionByName(asked).repartition(shards, F.pmod("shard", F.lit(shards))).sortWithinPartitions("shard", "role")
    found = materialize(dealt.mapInArrow(_serve(threshold), "node long, n long, other long"), "links")
    joined = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    named = materialize(
        nodes.join(counts, "node", "left").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")), "named"
    )
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = named.join(least, "component").select("v", "copies", F.coalesce("n", F.lit(0)).alias("n"), "component_id")
    linked = salted_join(rows.filter("v IS NOT NULL"), of_node, ["v"], ["vec_id"], target_rows=HOT_COPIES).select(
        "vec_id", (F.col("n") + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    alone = rows.filter("v IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op9_hnsw(spark, sf_dir):
    """Links and components of all embeddings."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
