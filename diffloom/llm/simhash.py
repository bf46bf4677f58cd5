"""SimHash near-duplicates, linked through vantage-point shards of the fingerprints.

`near_duplicates` (64 bits): the fingerprint is cut into blocks of bits; level i of the vantage-point tree holds the Hamming
distance of block i to a fixed vantage point. Block distances add up to the whole distance, so the ring numbers of two
fingerprints within `radius` differ by `radius` in sum at most (triangle bound): a fingerprint is stored in its own shard (one
ring number per level) and queries only the shards that its bound reaches, all others are pruned. The blocks get finer as the
table grows, so that a shard stays small. Inside a shard a further vantage point sorts the stored points, a query block reads only
the slice within the bound, and the exact distance decides. A shard of more than BLOCK points is dealt into blocks that
all its queries visit, so that no task holds a whole hot shard.

`similar_groups` (sets of shingles, Jaccard similarity of 0.8 or more): the same vantage-point shards search the sets' fingerprints and find
what lies within their radius (`close_sets`). The radius that the similarity asks for is wider: there no vantage point of the fingerprints
prunes anything, so what is left between those groups is found exactly by further shards, the sets that hold one of each other's rarest
shingles. Two sets of that similarity share one of the first n - ceil(0.8 n) + 1 shingles of any common order, so no pair is lost. In such a
shard the vantage point is the empty set: points are sorted by their distance to it (their size), the bound on sizes ends a search, sets that
the fingerprints' shards have joined are not asked about again, 256-bit fingerprints rule out the rest. The shingles themselves decide every link.

Equal fingerprints (or sets) are one node. A shard returns its links as a spanning forest, never all pairs; components come
from alternating large and small stars over the joined forests.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffloom.llm.common import SEED, column_unlike, lower_words, offsets, saved, text_slices

#: Points of a shard that one task holds.
BLOCK = 8192
#: Up to so many distinct fingerprints, so many blocks of bits: shards of a few hundred points each.
LEVELS = ((1 << 22, 4), (1 << 30, 8), (1 << 63, 16))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32)


def simhash(texts: list[str | None], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit fingerprints, shingle counts); a shingle's hash is XXH64 with seed 42."""
    parts, n = [], []
    for t in texts:
        w = lower_words(t)
        if not w:
            n.append(0)
            continue
        joined = b" ".join(w)
        ends = list(itertools.accumulate(map(len, w)))
        ends = [e + i for i, e in enumerate(ends)]
        if len(w) <= shingle:
            parts.append(xxhash.xxh64_digest(joined, SEED))
            n.append(1)
            continue
        starts = [0, *(e + 1 for e in ends[:-shingle])]
        parts.append(b"".join([xxhash.xxh64_digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=True)]))
        n.append(len(starts))
    count = np.array(n, np.int64)
    return majority(np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 8), count).view(">u8")[:, 0].astype(np.uint64), count


def majority(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Bytes of the fingerprints of texts with `count` hashes each; h: the hashes as big-endian bytes, text by text."""
    out = np.zeros((len(count), h.shape[1]), np.uint8)
    row = np.repeat(np.arange(len(count)), count) * 256
    for k in range(h.shape[1]):
        ones = np.bincount(row + h[:, k], minlength=len(count) * 256).reshape(-1, 256).astype(np.float32) @ _BITS
        out[:, k] = np.packbits(2 * ones > count[:, None], axis=1)[:, 0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, fp (its 64 bits as a long), n_shingles of each row of docs.

    Null and empty texts have no shingle and fingerprint zero; whole texts are read, in slices of a million characters, a longer
    text being a slice of its own; repeated rows and null ids stay as they are; extra columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            found = [simhash(texts, shingle) for _, texts in text_slices(batch.column("text"), 1 << 20)]
            fp = np.concatenate([f for f, _ in found]) if found else np.zeros(0, np.uint64)
            n = np.concatenate([n for _, n in found]) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64)), pa.array(n)], names=["doc_id", "fp", "n_shingles"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long, n_shingles long")


def _steps(radius: int, levels: int) -> np.ndarray:
    """Ring offsets within the bound, one of each opposite pair (the other side asks the other way), and the own shard."""

    def within(left: int, k: int):
        if not k:
            yield ()
            return
        for x in range(-left, left + 1):
            for rest in within(left - abs(x), k - 1):
                yield (x, *rest)

    return np.array([x for x in within(radius, levels) if x >= (0,) * levels], np.int64)


def _cells(fp: np.ndarray, radius: int, levels: int):
    """(home shard of each point, [(points, shard that they query)])."""
    width = 64 // levels
    mask = np.uint64((1 << width) - 1)
    d = np.empty((len(fp), levels), np.int64)
    for i in range(levels):
        vantage = np.uint64(xxhash.xxh64_intdigest(b"vantage", i) & int(mask))
        d[:, i] = np.bitwise_count(((fp >> np.uint64(width * i)) & mask) ^ vantage)
    scale = np.array([pow(width + 1, i) for i in range(levels)], np.int64)
    home = d @ scale
    visits = []
    for step in _steps(radius, levels):
        to = d + step
        ok = ((to >= 0) & (to <= width)).all(1)
        visits.append((np.flatnonzero(ok), home[ok] + int(step @ scale)))
    return home, visits


def _join(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Roots after the links x-y; root is flat (each entry is a root) before and after."""
    while True:
        a, b = root[x], root[y]
        apart = a != b
        if not apart.any():
            return root
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up


class Shard:
    """The stored points of a shard, sorted by distance to their first point, and the forest of the links found so far."""

    def __init__(self, points: np.ndarray, radius: int):
        self.radius, self.vantage = radius, points[0]
        far = np.bitwise_count(points ^ self.vantage).astype(np.int64)
        order = np.argsort(far, kind="stable")
        self.points, self.far = points[order], far[order]
        self.root = np.arange(len(points))

    def links(self, asks: np.ndarray):
        """Links (query, stored point), one for each query that has any; the forest of stored points takes in the others."""
        far = np.bitwise_count(asks ^ self.vantage).astype(np.int64)
        order = np.argsort(far, kind="stable")
        step = max(16, min(1024, 2_000_000 // len(self.points)))
        for a in range(0, len(order), step):
            q = order[a : a + step]
            lo, hi = np.searchsorted(self.far, far[q[0]] - self.radius, "left"), np.searchsorted(self.far, far[q[-1]] + self.radius, "right")
            i, j = np.nonzero(np.bitwise_count(asks[q, None] ^ self.points[None, lo:hi]) <= self.radius)
            j = j + lo
            if not len(i):
                continue
            first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
            head = np.repeat(j[first], np.diff(np.r_[first, len(i)]))
            self.root = _join(self.root, head, j)
            u, v = asks[q[i[first]]], self.points[j[first]]
            yield u[u != v], v[u != v]

    def forest(self):
        i = np.flatnonzero(self.root != np.arange(len(self.root)))
        return self.points[i], self.points[self.root[i]]


_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _edges(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[i] for f in found]).view(np.int64)) for i in (0, 1)], schema=_EDGES)


def links(nodes: DataFrame, radius: int, levels: int = LEVELS[0][1], block: int = BLOCK) -> DataFrame:
    """Edges u, v that connect exactly the components of `within radius`; nodes: distinct fingerprints (fp)."""

    def deal(batches, visit):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            home, visits = _cells(fp, radius, levels)
            for rows, cell in visits if visit else [(slice(None), home)]:
                if len(cell):
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(fp[rows].view(np.int64))], names=["cell", "fp"])

    stored = nodes.mapInArrow(lambda b: deal(b, False), "cell long, fp long")
    asking = nodes.mapInArrow(lambda b: deal(b, True), "cell long, fp long")
    sizes = stored.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    asking = asking.join(sizes, "cell")  # a shard without stored points has nothing to find
    hot = sizes.where("blocks > 1")
    stored = stored.join(hot, "cell", "left").select("cell", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("fp"), F.col("blocks"))).otherwise(0).cast("int").alias("block"), F.lit(False).alias("asks"), "fp")
    asking = asking.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("asks"), "fp")
    rows = stored.unionByName(asking).repartition("cell", "block").sortWithinPartitions("cell", "block", "asks")

    def search(batches):
        at, own, shard, found = None, [], None, []
        for batch in batches:
            cell, blk, asks, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            fp = fp.view(np.uint64)
            cuts = np.flatnonzero((cell[1:] != cell[:-1]) | (blk[1:] != blk[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in itertools.pairwise([0, *cuts.tolist(), len(fp)]):
                if a == b:
                    continue
                if at != (cell[a], blk[a]):
                    if shard:
                        found.append(shard.forest())
                    at, own, shard = (cell[a], blk[a]), [], None
                if not asks[a]:
                    own.append(fp[a:b])
                elif own:
                    shard = shard or Shard(np.concatenate(own), radius)
                    found += shard.links(fp[a:b])
            if found:
                yield _edges(found)
                found = []
        if shard:
            yield _edges([shard.forest()])

    return rows.mapInArrow(search, "u long, v long")


def components(edges: DataFrame, most: int = 50) -> DataFrame:
    """u, v: each node with edges and the smallest node of its component, but for that node itself.

    Large and small stars in turn. What a round joins is written to the shared folder first: minima are pre-aggregated
    on the map side, and a node with very many edges meets its one minimum in a join that Spark may split or broadcast.
    """
    e = saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(most):
        total = e.agg(F.count("*").alias("n"), F.count_distinct("u").alias("k")).first()
        if total.n == total.k and e.join(e.select(F.col("u").alias("x")), F.col("v") == F.col("x"), "left_semi").isEmpty():
            return e
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")
        large = saved(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-stars")
        low = saved(large.groupBy("u").agg(F.min("v").alias("m")), "minima")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = saved(small.where("u <> v").distinct(), "edges")
    raise RuntimeError("components: too many rounds")


def named_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, component_id (the smallest `least` of its component, null if all are) of all nodes(node, least).

    Nodes are ordered by their `least` id, so the root of a component bears its name and no component meets in one group.
    """
    label = F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("id"), F.col("node").alias("node"))
    labels = nodes.select(F.col("node").alias("x"), label.alias("label"))
    e = edges.where("u <> v").distinct()
    e = e.join(labels, e["u"] == labels["x"]).select(F.col("label").alias("a"), "v")
    e = e.join(labels, e["v"] == labels["x"]).select(F.col("a").alias("u"), F.col("label").alias("v"))
    found = components(e).select(F.col("u.node").alias("node"), F.col("v.id").alias("root"), F.lit(True).alias("linked"))
    return nodes.join(found, "node", "left").select("node", F.when(F.col("linked"), F.col("root")).otherwise(F.col("least")).alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp, n_shingles, component_id (smallest id reachable through links) of each row of docs.

    Two rows link if their fingerprints differ in `radius` bits at most. Null and empty texts have fingerprint zero and link like
    any other; very long texts are read whole; repeated rows are copies of one another; rows with a null id take part,
    but name no component (its id is null if none has one); extra columns are ignored; no row in, no row out.
    """
    fps = saved(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    n = nodes.count()
    levels = next(x for most, x in LEVELS if n <= most)
    named = named_components(links(nodes.select("fp"), radius, levels), nodes.withColumnRenamed("fp", "node"))
    return fps.join(named.withColumnRenamed("node", "fp"), "fp").select("doc_id", "fp", "n_shingles", "component_id")


#: Near copies share SIMILAR or more of their five-word shingles (a fraction: numerator, denominator). The 256-bit fingerprints
#: of two such sets differ in about 39 bits, with a standard deviation of 6; those of unrelated sets in 128, with one of 8.
SIMILAR, SHINGLE, RADIUS = (4, 5), 5, 72
#: Differing bits of the first 64 of them that the vantage-point shards search: what their bound prunes to small shards.
CLOSE = 2
#: Shingles of the sets that one block of a group holds.
BLOCK_SHINGLES = 1 << 19
#: Slots of the table that tells common shingles from rare ones.
SLOT_BITS = 16
PRINT = ["f0", "f1", "f2", "f3"]
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        v = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return v


_words = _Words()


def _mixed(h: np.ndarray, k: int = 0) -> np.ndarray:
    """The k-th of a family of mixtures of 64-bit values."""
    h = h + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles (fewer words: one shingle of the whole; none: none)."""
    words = [lower_words(t) for t in texts]
    at = offsets([len(w) for w in words])
    h = np.fromiter(map(_words.__getitem__, itertools.chain.from_iterable(words)), np.uint64, int(at[-1]))
    full = np.zeros(max(0, len(h) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        full += _mixed(h[k : len(h) - SHINGLE + 1 + k]) * _MIX[k] if len(full) else np.zeros(0, np.uint64)
    full = _mixed(full)
    out = []
    for a, b in itertools.pairwise(at.tolist()):
        if b - a >= SHINGLE:
            s = np.sort(full[a : b - SHINGLE + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif b > a:  # a sum over fewer words, told apart from five by their number
            out.append(_mixed((_mixed(h[a:b]) * _MIX[: b - a]).sum(keepdims=True, dtype=np.uint64), b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes(), SEED)


def wide_prints(sets: list[np.ndarray]) -> np.ndarray:
    """256-bit fingerprints of sets, as four 64-bit words each."""
    h = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    n = np.array([len(s) for s in sets], np.int64)
    return np.stack([majority(_mixed(h, k).view(np.uint8).reshape(-1, 8), n).view(np.uint64)[:, 0] for k in range(1, 5)], axis=1) if len(sets) else np.zeros((0, 4), np.uint64)


def prefix(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The rarest shingles of a set, as many as any set of SIMILAR or more must share one of. common: class of each slot."""
    n = len(s)
    keep = n - -(-SIMILAR[0] * n // SIMILAR[1]) + 1 if n else 0
    return s[np.argsort(common[(s >> np.uint64(64 - SLOT_BITS)).astype(np.int64)], kind="stable")[:keep]]


def _slot_classes(rows: DataFrame) -> np.ndarray:
    """How common the shingles of each slot are, over all rows: the power of two by which the slot's count passes the mean. It
    only orders the shingles of a set; the table has a fixed size."""

    def count(batches):
        n = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            for _, texts in text_slices(batch.column("text")):
                sets = shingle_sets(texts)
                n += np.bincount((np.concatenate(sets) >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=len(n))
        _words.clear()  # the worker goes on to other stages
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], names=["slot", "n"])

    found = rows.select("text").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(1 << SLOT_BITS, np.float64)
    n[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return np.floor(np.log2(np.maximum(n / max(n.mean(), 1.0), 1.0))).astype(np.int8)


def _signed(rows: DataFrame, common: np.ndarray) -> DataFrame:
    """doc_id, sig (of the text's set), n (its size), f0 to f3 (its fingerprint), keys (its prefix) of each row."""
    shared = rows.sparkSession.sparkContext.broadcast(common)  # 2^SLOT_BITS bytes

    def run(batches):
        for batch in batches:
            for start, texts in text_slices(batch.column("text"), 1 << 20):
                sets = shingle_sets(texts)
                keys, f = [prefix(s, shared.value) for s in sets], wide_prints(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(start, len(texts)),
                        pa.array([signature(s) for s in sets], pa.binary()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        *(pa.array(f[:, k]) for k in range(4)),
                        pa.ListArray.from_arrays(pa.array(offsets([len(k) for k in keys]).astype(np.int32)), pa.array(np.concatenate(keys).view(np.int64))),
                    ],
                    names=["doc_id", "sig", "n", *PRINT, "keys"],
                )
        _words.clear()

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, sig binary, n long, f0 long, f1 long, f2 long, f3 long, keys array<long>")


def _sets(rows: DataFrame) -> DataFrame:
    """sig and hashes (all of the set, in bytes) of each row."""

    def run(batches):
        for batch in batches:
            for _, texts in text_slices(batch.column("text"), 1 << 20):
                sets = shingle_sets(texts)
                yield pa.RecordBatch.from_arrays([pa.array([signature(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["sig", "hashes"])
        _words.clear()

    return rows.select("text").mapInArrow(run, "sig binary, hashes binary")


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes that a pair of SIMILAR may have; a is the smaller one."""
    return SIMILAR[1] * a >= SIMILAR[0] * b


def _whole_runs(batches, keys: int):
    """The columns as numpy arrays, cut where the first `keys` columns change, so that no run is split; with run numbers."""
    rest = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            if not batch.num_rows:
                continue
            own = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            rest = own if rest is None else [np.concatenate([a, b]) for a, b in zip(rest, own, strict=True)]
        if rest is None:
            return
        new = np.zeros(len(rest[0]), bool)
        for c in rest[:keys]:
            new[1:] |= c[1:] != c[:-1]
        cut = len(new) if batch is None else int(np.flatnonzero(new)[-1]) if new.any() else 0
        if cut:
            yield np.cumsum(new[:cut]), [c[:cut] for c in rest]
            rest = [c[cut:] for c in rest]


def candidate_links(run: np.ndarray, own: np.ndarray, cross: np.ndarray, n: np.ndarray, fp: np.ndarray, hub: np.ndarray):
    """Places (i, j) of links that connect what fingerprints within RADIUS connect in each run; rows are sorted by run and n.

    Each lag compares all rows with the one so many places on; a row leaves when the size bound ends its search. cross: only
    pairs of different `own` are asked. Rows of one hub are linked already.
    """
    order = np.lexsort((hub, run))  # stable, so the first row of a hub is its root
    starts = np.flatnonzero(np.r_[True, (run[order][1:] != run[order][:-1]) | (hub[order][1:] != hub[order][:-1])])
    root, us, vs = np.empty(len(run), np.int64), [], []
    root[order] = np.repeat(order[starts], np.diff(np.r_[starts, len(run)]))
    act, lag = np.arange(len(run)), 0
    while len(act):
        lag += 1
        act = act[act + lag < len(run)]
        act = act[(run[act] == run[act + lag]) & _alike(n[act], n[act + lag])]
        x = act[root[act] != root[act + lag]]
        x = x[~cross[x] | (own[x] != own[x + lag])]
        x = x[np.bitwise_count(fp[x] ^ fp[x + lag]).sum(1, dtype=np.int64) <= RADIUS]
        if len(x):
            us.append(x)
            vs.append(x + lag)
            root = _join(root, x, x + lag)
        if lag % 32 == 1:  # runs that are one component have no more to find
            starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
            one = np.minimum.reduceat(root, starts) == np.maximum.reduceat(root, starts)
            act = act[~one[run[act] - run[0]]]
    return (np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, np.int64),) * 2


def exact_links(sets: list[np.ndarray], own: np.ndarray):
    """Spanning forest (i, j) of the pairs of sets of SIMILAR or more; own: block of each (pairs across two blocks, or all in one).

    Shingles that a sixteenth of the sets hold are counted by a product of 0/1 matrices (together at most 16 columns for each
    shingle of a mean set), the others through the lists of sets that hold them.
    """
    m, n = len(sets), np.array([len(x) for x in sets], np.int64)
    at, cross = offsets(n), len(set(own.tolist())) > 1
    _, flat, df = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    who = np.repeat(np.arange(m), n)
    order = np.argsort(flat, kind="stable")
    who_sorted, start = who[order], offsets(df)
    heavy = df > max(1, m // 16)
    dense = np.zeros((m, int(heavy.sum())), np.float32)
    some = heavy[flat]
    dense[who[some], (np.cumsum(heavy) - 1)[flat[some]]] = 1
    light = ~heavy & (df > 1)
    root = np.arange(m)
    rows = np.flatnonzero(own == own.min()) if cross else np.arange(m)
    for a in range(0, len(rows), 256):
        part = rows[a : a + 256]
        shared = dense[part] @ dense.T
        for q, hit in zip(part.tolist(), shared, strict=True):
            v = flat[at[q] : at[q + 1]]
            v = v[light[v]]
            if len(v):
                upto = np.cumsum(df[v])
                places = np.arange(upto[-1]) + np.repeat(start[v] - upto + df[v], df[v])
                hit = hit + np.bincount(who_sorted[places], minlength=m)
            good = np.flatnonzero(SIMILAR[1] * hit >= SIMILAR[0] * (n + n[q] - hit))
            good = good[own[good] != own[q]] if cross else good[good < q]
            good = good[root[good] != root[q]]
            if len(good):
                good = good[np.unique(root[good], return_index=True)[1]]
                yield from ((int(j), q) for j in good)
                root = _join(root, good, np.full(len(good), q))


def _in_blocks(rows: DataFrame, key: str, blocks: DataFrame, by: str) -> DataFrame:
    """rows with lo, hi, own: those of a key of many rows are dealt into blocks, and each pair of blocks is a group of its own."""
    dealt = rows.join(blocks, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(by), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))


def close_sets(sets: DataFrame, radius: int = CLOSE) -> DataFrame:
    """id, hub (the smallest id of its group) of the sets(id, f0) whose first words vantage-point shards link: chains of distances of `radius` at most."""
    nodes = saved(sets.select(F.col("f0").alias("fp")).distinct(), "nodes")
    n = nodes.count()
    found = components(links(nodes, radius, next(x for most, x in LEVELS if n <= most)))
    named = saved(sets.join(found, sets["f0"] == found["u"], "left").select("id", F.coalesce("v", "f0").alias("fp")), "close")
    hubs = named.groupBy("fp").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where("n > 1")
    return saved(named.join(hubs, "fp").select("id", "hub"), "hubs")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, component_id (smallest id reachable through links) of each row of docs.

    Two rows link if their sets of shingles have a Jaccard similarity of 0.8 or more; a pair is lost only if its fingerprints
    differ by more than RADIUS bits, over five standard deviations. Null and empty texts are copies of one another; very long texts
    are read whole; repeated rows are copies; rows with a null id take part, but name no component; extra columns are
    ignored; no row in, no row out.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = saved(_signed(texts, _slot_classes(texts)), "signatures")
    sets = saved(signed.groupBy("sig").agg(F.min("doc_id").alias("least"), *(F.max(c).alias(c) for c in ("n", *PRINT, "keys"))).withColumn("id", F.xxhash64("sig")), "sets")
    close = close_sets(sets.select("id", "f0"))
    keyed = sets.select(F.explode("keys").alias("key"), F.col("n").cast("int").alias("n"), "id").repartition("key").sortWithinPartitions("key", "n")

    def met(batches):
        """Rows with a neighbour of the same key and a size within the bound; all others are alone in their shard. The last row
        waits for the next batch, so a hot key is never held."""
        last, was_near = None, False
        for batch in itertools.chain(batches, [None]):
            if batch is not None and not batch.num_rows:
                continue
            own = [c.to_numpy(zero_copy_only=False) for c in batch.columns] if batch is not None else [np.zeros(0, np.int64)] * 3
            if last is not None:
                own = [np.concatenate([a, b]).astype(a.dtype) for a, b in zip(last, own, strict=True)]
            key, n, _ = own
            if not len(key):
                return
            near = (key[1:] == key[:-1]) & _alike(n[:-1].astype(np.int64), n[1:])
            keep = np.r_[near, False] | np.r_[was_near, near]
            upto = len(key) if batch is None else len(key) - 1
            yield pa.RecordBatch.from_arrays([pa.array(c[:upto][keep[:upto]]) for c in own], names=["key", "n", "id"])
            last, was_near = [c[-1:] for c in own], bool(keep[-1])

    shards = saved(keyed.mapInArrow(met, "key long, n int, id long"), "shards")
    prints = shards.join(sets.select("id", *PRINT).join(close, "id", "left"), "id").withColumn("hub", F.coalesce("hub", "id"))
    hot = saved(shards.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 1"), "hot-keys")
    prints = _in_blocks(prints, "key", hot, "id").select("key", "lo", "hi", "own", "n", "id", "hub", *PRINT)
    prints = prints.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "n")

    def near(batches):
        for run, (_, lo, hi, own, n, ids, hub, *f) in _whole_runs(batches, 3):
            u, v = candidate_links(run, own, lo != hi, n.astype(np.int64), np.stack(f, axis=1).view(np.uint64), hub)
            if len(u):
                pairs = np.unique(np.stack([ids[u], ids[v]], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], schema=_EDGES)

    stars = components(prints.mapInArrow(near, "u long, v long").unionByName(close.select(F.col("id").alias("u"), F.col("hub").alias("v"))))
    member = saved(stars.select(F.col("u").alias("id"), F.col("v").alias("near")).unionByName(stars.select(F.col("v").alias("id"), F.col("v").alias("near")).distinct()), "members")
    member = saved(sets.join(member, "id").select("sig", "least", "n", "near"), "candidates")
    # only the texts of candidates are read again, for all of their shingles
    wanted = saved(member.select("least").distinct(), "wanted")
    some = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["least"]), "left_semi")
    held = saved(_sets(some), "held-sets").dropDuplicates(["sig"])
    grouped = held.join(member, "sig").select("near", "sig", "n", "hashes")
    hot = saved(member.groupBy("near").agg(F.ceil(F.sum("n") / block_shingles).cast("int").alias("blocks")).where("blocks > 1"), "hot-groups")
    grouped = _in_blocks(grouped, "near", hot, "sig").select("near", "lo", "hi", "own", "sig", "hashes")
    # in a pair of two blocks each asks only the other; a block's own pairs are those of (own, own)
    grouped = grouped.repartition("near", "lo", "hi").sortWithinPartitions("near", "lo", "hi", "sig")

    def check(batches):
        for run, (_, _, _, own, sigs, hashes) in _whole_runs(batches, 3):
            us, vs = [], []
            for a, b in itertools.pairwise([*np.flatnonzero(np.r_[True, run[1:] != run[:-1]]).tolist(), len(run)]):
                for i, j in exact_links([np.frombuffer(x, np.uint64) for x in hashes[a:b]], own[a:b]):
                    us.append(sigs[a + i])
                    vs.append(sigs[a + j])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], names=["u", "v"])

    named = named_components(grouped.mapInArrow(check, "u binary, v binary"), sets.select(F.col("sig").alias("node"), "least"))
    return signed.select("doc_id", "sig").join(named.withColumnRenamed("node", "sig"), "sig").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that are near copies of one with a smaller id; all columns stay.

    Candidates come from vantage-point shards of the fingerprints and, beyond their radius, from shards of rare shingles (similar_groups). A document is an id: its repeated rows stay or go together, and rows with a null id stay. Null, empty and very long texts as
    in similar_groups; an empty table stays empty.
    """
    gone = column_unlike(docs, "gone")
    ids = similar_groups(docs, id_col, text_col).where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(gone)).distinct()
    ids = saved(ids, "near-copies")
    return docs.join(ids, docs[id_col] == ids[gone], "left_anti")
