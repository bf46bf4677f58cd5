"""Near copies among embeddings through hierarchical navigable small-world graphs.

Equal vectors of a label are one node. The nodes of a label are dealt into shards of SHARD nodes, and each shard gets a graph: nested layers of
points, each a sixteenth of the one below, with links to near points in differing directions. Every node asks every shard of its
label: down the layers with a narrow beam, through the lowest with a wide one, and from what comes near the threshold on along all links that
stay near it, so that a crowd of near copies is found whole however many they are. Queries of a block move in step, as numpy arrays.

Each block of queries is audited against its shard before its links count: some of the queries by brute force, and probes that are set at
the threshold from stored points. Where the recall is too low, the beam is doubled and the block asks again; a beam as wide as the
shard is an exact search. The cosine of each candidate is worked out in double precision, and a shard returns the number of each
query's links and a spanning forest of them, never all pairs.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffloom.llm.common import SEED, offsets, placed, saved
from diffloom.llm.simhash import _join, named_components

THRESHOLD = 0.93
#: Nodes of a graph, and queries that one task asks of it.
SHARD, GROUP = 8192, 32768
#: Links of a point when it comes in, most links in the upper layers and in the lowest, links left when those are too many.
NEW, UPPER, LOWEST, LEFT = 12, 24, 32, 20
#: Points of a layer for one of the layer above; width of the beam while the graph is built, in upper layers, and at first.
STEP, BUILD, NARROW, BEAM = 16, 48, 8, 48
#: Queries and probes of an audit, the share of their links that must be found; how far below the threshold links are followed.
AUDIT, RECALL, SLACK = 64, 0.99, 0.04
#: Queries that move together, pairs whose cosines are worked out together.
TOGETHER, PAIRS = 128, 1 << 16


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; entries of any size."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _best(sims: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest of each row, falling."""
    k = min(k, sims.shape[1])
    top = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < sims.shape[1] else np.broadcast_to(np.arange(k), sims.shape)
    order = np.argsort(-np.take_along_axis(sims, top, 1), axis=1, kind="stable")
    return np.take_along_axis(top, order, 1)


def _sims(points: np.ndarray, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Cosines of each query with its row of points; -inf where the id is -1."""
    s = np.einsum("qd,qkd->qk", queries, points[ids], optimize=True)
    return np.where(ids >= 0, s, -np.inf)


class Graph:
    """Unit vectors (rows of points, in the order in which they came in) and the links of each layer."""

    def __init__(self, points: np.ndarray, links: list[np.ndarray]):
        self.points, self.links = points, links

    @classmethod
    def build(cls, points: np.ndarray) -> Graph:
        n = len(points)
        sizes = [n]
        while sizes[-1] > 4 * STEP:
            sizes.append(-(-sizes[-1] // STEP))
        g = cls(points, [np.full((s, LOWEST if i == 0 else UPPER), -1, np.int32) for i, s in enumerate(sizes)])
        at = 0
        while at < n:
            upto = min(n, at + max(STEP, min(512, at)))
            g._insert(at, upto)
            at = upto
        return g

    def _insert(self, a: int, b: int) -> None:
        """Points a to b come in: each is linked to near ones among those before it and beside it."""
        new = self.points[a:b]
        beside = new @ new.T
        np.fill_diagonal(beside, -np.inf)
        starts = None
        for layer in range(len(self.links) - 1, -1, -1):
            m = min(b, len(self.links[layer])) - a  # so many of them are in this layer
            ids = np.full((b - a, 0), -1, np.int32)
            sims = np.full((b - a, 0), -np.inf, np.float32)
            if a:
                parts = [self._beam(new[i : i + TOGETHER], None if starts is None else starts[i : i + TOGETHER], layer, BUILD if m > 0 else NARROW, min(a, len(self.links[layer]))) for i in range(0, b - a, TOGETHER)]
                ids, sims = (np.concatenate(x) for x in zip(*parts, strict=True))
                starts = ids[:, :NARROW]
            if m <= 0:
                continue
            near = _best(beside[:m, :m], BUILD // 3)
            ids = np.c_[ids[:m], (near + a).astype(np.int32)]
            sims = np.c_[sims[:m], np.take_along_axis(beside[:m, :m], near, 1)]
            ids = np.where(np.isfinite(sims), ids, -1)
            top = _best(sims, BUILD)
            chosen = self._choose(np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1), NEW)
            self.links[layer][a : a + m, : chosen.shape[1]] = chosen
            self._answer(layer, np.repeat(np.arange(a, a + m, dtype=np.int32), chosen.shape[1]), chosen.ravel())

    def _choose(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of each row's points, nearest first, those that are nearer to the row's own point than to any chosen before; then the nearest
        others, up to `most`; -1 fills the rest."""
        v = self.points[ids]
        pair = np.einsum("bid,bjd->bij", v, v, optimize=True)
        there = ids >= 0
        keep = np.zeros(ids.shape, bool)
        for c in range(ids.shape[1]):
            hidden = ((pair[:, c, :] > sims[:, c, None]) & keep).any(1)
            keep[:, c] = there[:, c] & ~hidden & (keep.sum(1) < most)
        rank = np.where(keep, 0, np.where(there, 1, 2)) * ids.shape[1] + np.arange(ids.shape[1])
        order = np.argsort(rank, axis=1)[:, :most]
        return np.where(np.take_along_axis(there, order, 1), np.take_along_axis(ids, order, 1), -1)

    def _answer(self, layer: int, source: np.ndarray, target: np.ndarray) -> None:
        """The targets of new links link back; of too many links the best LEFT stay."""
        links = self.links[layer]
        source, target = source[target >= 0], target[target >= 0]
        order = np.lexsort((-np.einsum("id,id->i", self.points[source], self.points[target]), target))
        source, target = source[order], target[order]
        first = np.flatnonzero(np.r_[True, target[1:] != target[:-1]]) if len(target) else np.zeros(0, np.int64)
        place = np.arange(len(target)) - np.repeat(first, np.diff(np.r_[first, len(target)]))
        source, target, place = source[place < LOWEST], target[place < LOWEST], place[place < LOWEST]
        room = links.shape[1] - (links >= 0).sum(1)
        wanted = np.bincount(target, minlength=len(links))
        fits = wanted[target] <= room[target]
        t, s = target[fits], source[fits]
        links[t, links.shape[1] - room[t] + place[fits]] = s
        full = np.unique(target[~fits])
        own = np.full((len(links), 0), -1)
        if len(full):
            own = np.full((len(full), links.shape[1] + LOWEST), -1, np.int32)
            own[:, : links.shape[1]] = links[full]
            own[np.searchsorted(full, target[~fits]), links.shape[1] + place[~fits]] = source[~fits]
        for i in range(0, len(full), 512):
            part, at = own[i : i + 512], full[i : i + 512]
            sims = _sims(self.points, self.points[at], part)
            top = _best(sims, part.shape[1])
            links[at] = -1
            links[at, :LEFT] = self._choose(np.take_along_axis(part, top, 1), np.take_along_axis(sims, top, 1), LEFT)

    def _beam(self, queries: np.ndarray, starts: np.ndarray | None, layer: int, width: int, known: int):
        """(ids, cosines) of the best `width` points that each query comes by in a layer, falling; known: points that are in it."""
        links = self.links[layer]
        if starts is None:
            starts = np.broadcast_to(np.arange(min(known, NARROW), dtype=np.int32), (len(queries), min(known, NARROW)))
        width = min(width, known)
        ids = np.full((len(queries), max(width, starts.shape[1])), -1, np.int32)
        ids[:, : starts.shape[1]] = starts
        sims = _sims(self.points, queries, ids)
        top = _best(sims, width)
        ids, sims = np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1)
        opened = ids < 0
        seen = np.zeros((len(queries), known), bool)
        r, c = np.nonzero(ids >= 0)
        seen[r, ids[r, c]] = True
        act = np.arange(len(queries))
        while len(act):
            closed = np.where(opened[act], -np.inf, sims[act])
            act = act[(~opened[act]).any(1)]
            if not len(act):
                break
            closed = np.where(opened[act], -np.inf, sims[act])
            some = _best(closed, 4)
            go = np.take_along_axis(closed, some, 1) > -np.inf
            mark = np.take_along_axis(opened[act], some, 1) | go
            o = opened[act]
            np.put_along_axis(o, some, mark, 1)
            opened[act] = o
            at = np.where(go, np.take_along_axis(ids[act], some, 1), -1)
            near = np.where(at[:, :, None] >= 0, links[at], -1).reshape(len(act), -1)
            near.sort(axis=1)
            fresh = (near >= 0) & np.c_[np.ones((len(act), 1), bool), near[:, 1:] != near[:, :-1]] & (near < known)
            fresh &= ~seen[act[:, None], np.minimum(np.maximum(near, 0), known - 1)]
            near = np.where(fresh, near, -1)
            r, c = np.nonzero(fresh)
            seen[act[r], near[r, c]] = True
            s = np.full(near.shape, -np.inf, sims.dtype)
            s[r, c] = np.einsum("id,id->i", queries[act[r]], self.points[near[r, c]])
            all_s, all_i = np.c_[sims[act], s], np.c_[ids[act], near]
            all_o = np.c_[opened[act], ~fresh]
            top = _best(all_s, width)
            sims[act], ids[act] = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_i, top, 1)
            opened[act] = np.take_along_axis(all_o, top, 1)
        return ids, sims

    @cached_property
    def around(self) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, points): the lowest layer's links of each point, there or back."""
        s, c = np.nonzero(self.links[0] >= 0)
        t = self.links[0][s, c].astype(np.int64)
        both = np.unique(np.r_[s * len(self.points) + t, t * len(self.points) + s])
        return offsets(np.bincount(both // len(self.points), minlength=len(self.points))), (both % len(self.points)).astype(np.int32)

    def near(self, queries: np.ndarray, threshold: float, beam: int, own: np.ndarray | None = None):
        """(query, point) of the pairs near the threshold that the queries come by; own: the query's own point, -1 if it has none here,
        where its search of the lowest layer begins as well."""
        n = len(self.points)
        low = threshold - SLACK
        at, around = self.around
        for a in range(0, len(queries), TOGETHER):
            q = queries[a : a + TOGETHER]
            if beam >= n:
                i, j = np.nonzero(q @ self.points.T >= threshold - 1e-4)
                yield i + a, j
                continue
            ids = None
            for layer in range(len(self.links) - 1, -1, -1):
                if layer == 0 and own is not None:
                    mine = own[a : a + TOGETHER, None].astype(np.int32)
                    if ids is None:
                        ids = np.broadcast_to(np.arange(min(n, NARROW), dtype=np.int32), (len(q), min(n, NARROW)))
                    ids = np.c_[np.where(ids == mine, -1, ids), mine]
                ids, sims = self._beam(q, ids, layer, beam if layer == 0 else NARROW, len(self.links[layer]))
            seen = np.zeros((len(q), n), bool)
            i, k = np.nonzero(sims >= low)
            j = ids[i, k]
            good = sims[i, k] >= threshold - 1e-4
            seen[i, j] = True
            yield i[good] + a, j[good]
            while len(i):
                front = np.zeros((len(q), n), bool)
                for b in range(0, len(i), PAIRS):
                    x, y = i[b : b + PAIRS], j[b : b + PAIRS]
                    many = at[y + 1] - at[y]
                    places = np.arange(many.sum()) + np.repeat(at[y] - np.cumsum(many) + many, many)
                    front[np.repeat(x, many), around[places]] = True
                front &= ~seen
                seen |= front
                i, j = np.nonzero(front)
                sims = np.concatenate([np.einsum("id,id->i", q[i[b : b + PAIRS]], self.points[j[b : b + PAIRS]]) for b in range(0, len(i), PAIRS)] or [np.zeros(0)])
                good = sims >= threshold - 1e-4
                yield i[good] + a, j[good]
                i, j = i[sims >= low], j[sims >= low]

    def links_of(self, queries: np.ndarray, exact: np.ndarray, threshold: float, beam: int, own: np.ndarray | None = None):
        """The same with the cosine worked out in double precision; queries and exact are unit vectors."""
        narrow = queries.astype(np.float32)
        for i, j in self.near(narrow, threshold, beam, own):
            for b in range(0, len(i), PAIRS):
                x, y = i[b : b + PAIRS], j[b : b + PAIRS]
                good = np.einsum("id,id->i", queries[x], exact[y]) >= threshold
                yield x[good], y[good]


def audit(graph: Graph, exact: np.ndarray, queries: np.ndarray, threshold: float, beam: int) -> float:
    """The lesser of two recalls: of the links of some queries against brute force, and of stored points by probes at the threshold."""
    some = queries[np.unique(np.linspace(0, len(queries) - 1, min(AUDIT, len(queries))).astype(np.int64))]
    true = int((some @ exact.T >= threshold).sum())
    found = sum(len(i) for i, _ in graph.links_of(some, exact, threshold, beam))
    rng = np.random.default_rng(SEED)
    at = rng.choice(len(exact), min(AUDIT, len(exact)), replace=False)
    off = rng.standard_normal((len(at), exact.shape[1]))
    off -= (off * exact[at]).sum(1, keepdims=True) * exact[at]
    size = np.linalg.norm(off, axis=1, keepdims=True)
    sine = np.sqrt(max(0.0, 1 - (threshold + 1e-6) ** 2))
    probes = units((threshold + 1e-6) * exact[at] + sine * off / np.where(size > 0, size, 1))
    hits = sum(int((at[i] == j).sum()) for i, j in graph.links_of(probes, exact, threshold, beam))
    asked = int((np.einsum("id,id->i", probes, exact[at]) >= threshold).sum())
    return min(found / true if true else 1.0, hits / asked if asked else 1.0)


_ROW = "vec_id {id}, label {label}, dims int, sig binary, vec binary"
_INDEX = "at array<long>, weight array<long>, vec binary, links binary"


def _decoded(rows: DataFrame) -> DataFrame:
    """vec_id, label, dims, sig, vec of each row; the last three null for rows that link with nothing."""
    label = rows.schema["label"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            column = batch.column("v")
            kind = pa.float32() if column.type.value_type == pa.float32() else pa.float64()
            long = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = column.flatten().cast(kind).to_numpy(zero_copy_only=False) + kind.to_pandas_dtype()(0)  # no negative zeros
            at, wide = offsets(long).tolist(), values.itemsize
            raw = values.tobytes()
            vec = []
            for k, there in enumerate(batch.column("label").is_valid().to_pylist()):
                v = values[at[k] : at[k + 1]]
                vec.append(raw[at[k] * wide : at[k + 1] * wide] if there and len(v) and np.isfinite(v).all() and v.any() else None)
            sig = [None if v is None else xxhash.xxh3_128_digest(v, SEED) for v in vec]
            dims = [None if v is None else len(v) // wide for v in vec]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(dims, pa.int32()), pa.array(sig, pa.binary()), pa.array(vec, pa.binary())], names=["vec_id", "label", "dims", "sig", "vec"])

    return rows.mapInArrow(run, _ROW.format(id=rows.schema["vec_id"].dataType.simpleString(), label=label))


def _stacked(column, dtype) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype).reshape(len(rows), -1)


def _indexed(nodes: DataFrame, dtype: str, group: int) -> DataFrame:
    """g, shard, groups and the graph of each shard of nodes(g, shard, n, at, weight, vec)."""
    g = nodes.schema["g"].dataType.simpleString()

    def build(table: pa.Table) -> pa.Table:
        order = np.random.default_rng(SEED).permutation(np.argsort(table.column("at").to_numpy()))
        table = table.take(pa.array(order))
        vec = _stacked(table.column("vec").combine_chunks(), dtype)
        graph = Graph.build(units(vec).astype(np.float32))
        out = {
            "g": table.column("g").slice(0, 1),
            "shard": table.column("shard").slice(0, 1),
            "groups": pa.array([-(-table.column("n")[0].as_py() // group)], pa.int64()),
            "at": pa.array([table.column("at").to_pylist()], pa.list_(pa.int64())),
            "weight": pa.array([table.column("weight").to_pylist()], pa.list_(pa.int64())),
            "vec": pa.array([vec.tobytes()], pa.binary()),
            "links": pa.array([b"".join(x.tobytes() for x in graph.links)], pa.binary()),
        }
        return pa.table(out)

    return nodes.groupBy("g", "shard").applyInArrow(build, f"g {g}, shard long, groups long, {_INDEX}")


def _loaded(row: pa.Table, dtype: str) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    """(graph, exact unit vectors, node ids, weights)."""
    at, weight = (np.array(row.column(c)[0].as_py(), np.int64) for c in ("at", "weight"))
    exact = units(np.frombuffer(row.column("vec")[0].as_py(), dtype).reshape(len(at), -1))
    flat, links, size, a = np.frombuffer(row.column("links")[0].as_py(), np.int32), [], len(at), 0
    while a < len(flat):
        wide = LOWEST if not links else UPPER
        links.append(flat[a : a + size * wide].reshape(size, wide))
        a, size = a + size * wide, -(-size // STEP)
    return Graph(exact.astype(np.float32), links), exact, at, weight


def searched(nodes: DataFrame, dtype: str, threshold: float = THRESHOLD, shard: int = SHARD, group: int = GROUP) -> DataFrame:
    """u, v, n, recall, beam: a row (u, null, n) for each node with links in a shard, n their number by weight; rows (u, v) of a forest of
    them; and a row of nulls with recall and beam for each block of queries, as audited.

    nodes(g, pos, n, at, weight, vec): pos counts the nodes of g, n their number, at tells them apart.
    """
    dealt = nodes.withColumn("shard", F.floor(F.col("pos") / shard)).withColumn("group", F.floor(F.col("pos") / group))
    index = saved(_indexed(dealt.select("g", "shard", "n", "at", "weight", "vec"), dtype, group), "graphs")
    index = index.withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
    asks = dealt.select("g", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / shard))).alias("shard"), "group", F.col("at").alias("id"), F.col("vec").alias("query"))
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("n", pa.int64()), ("recall", pa.float64()), ("beam", pa.int64())])

    def search(asked: pa.Table, stored: pa.Table) -> pa.Table:
        graph, exact, at, weight = _loaded(stored, dtype)
        ids, queries = asked.column("id").to_numpy(), units(_stacked(asked.column("query").combine_chunks(), dtype))
        beam, recall = BEAM, 0.0
        while True:
            recall = audit(graph, exact, queries, threshold, beam)
            if recall >= RECALL or beam >= len(at):
                break
            beam *= 2
        order = np.argsort(at)
        place = order[np.minimum(np.searchsorted(at, ids, sorter=order), len(at) - 1)]
        own = np.where(at[place] == ids, place, -1)
        total, one = np.zeros(len(ids), np.int64), np.full(len(ids), -1)
        root = np.arange(len(at))
        for i, j in graph.links_of(queries, exact, threshold, beam, own):
            i, j = i[ids[i] != at[j]], j[ids[i] != at[j]]
            if not len(i):
                continue
            np.add.at(total, i, weight[j])
            one[i[one[i] < 0]] = j[one[i] < 0]
            root = _join(root, one[i], j)
        has, inner = np.flatnonzero(total), np.flatnonzero(root != np.arange(len(root)))
        u = np.concatenate([ids[has], ids[has], at[inner]])
        v = np.concatenate([np.zeros(len(has), np.int64), at[one[has]], at[root[inner]]])
        n = np.concatenate([total[has], np.zeros(len(has) + len(inner), np.int64)])
        counts = np.arange(len(u)) < len(has)
        both = pa.table([pa.array(u), pa.array(v, mask=counts), pa.array(n, mask=~counts), pa.nulls(len(u), pa.float64()), pa.nulls(len(u), pa.int64())], schema=schema)
        said = pa.table([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([recall]), pa.array([beam], pa.int64())], schema=schema)
        return pa.concat_tables([both, said])

    return asks.groupBy("g", "shard", "group").cogroup(index.groupBy("g", "shard", "group")).applyInArrow(search, "u long, v long, n long, recall double, beam long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, shard: int = SHARD, group: int = GROUP, audits: list | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vectors.

    Rows link if their labels are equal and the cosine of their vectors is `threshold` or more. Null labels, and vectors that are null,
    empty, zero or hold null or non-finite entries, link with nothing, nor do vectors of different lengths. Repeated rows are vectors
    of their own, and copies of one another; a null id takes part but names no component (null if none has one). Extra columns are
    ignored; no row in, no row out. audits: takes up a DataFrame of the recall and beam of each block of queries.
    """
    rows = _decoded(vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label")))
    dtype = "<f4" if vectors.schema[vector_col].dataType.elementType.typeName() == "float" else "<f8"
    g = F.struct("label", "dims")
    found = rows.where("sig IS NOT NULL").groupBy("label", "dims", "sig").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("vec").alias("vec"))
    nodes = placed(found.select(g.alias("g"), "sig", "least", "weight", "vec"), ("sig",))
    result = saved(searched(nodes.select("g", "pos", "n", "at", "weight", "vec"), dtype, threshold, shard, group), "graph-links")
    if audits is not None:
        audits.append(result.where("beam IS NOT NULL").select("recall", "beam"))
    links = result.where("n IS NOT NULL").groupBy("u").agg(F.sum("n").alias("links"))
    named = named_components(result.where("v IS NOT NULL").select("u", "v"), nodes.select(F.col("at").alias("node"), "least"))
    known = nodes.join(named, nodes["at"] == named["node"]).join(links, nodes["at"] == links["u"], "left")
    # only copies and linked vectors have anything to be told
    known = known.where("weight > 1 OR links IS NOT NULL").select("g.label", "g.dims", "sig", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    j = rows.drop("vec").join(known, ["label", "dims", "sig"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return j.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))
