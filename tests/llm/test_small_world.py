"""Embedding near copies against brute force."""

import numpy as np
from pyspark.sql import functions as F

from diffloom.llm import small_world

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema)
    for c in ("g", "at", "n", "pos", "u", "v", "node", "least", "weight", "shard", "vec", "sig", "dims", "n_links", "component_id"):
        df = df.withColumn(c, F.lit("x"))
    return df


def brute(rows, threshold=small_world.THRESHOLD):
    """(vec_id, n_links, component_id, kept) of each row, sorted."""
    ok = lambda r: r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    count = [0] * len(rows)
    groups = {}
    for i, r in enumerate(rows):
        if ok(r):
            groups.setdefault((r[2], len(r[1])), []).append(i)
    for own in groups.values():
        u = small_world.units(np.array([rows[i][1] for i in own], np.float32))
        for a, b in zip(*np.nonzero(np.triu(u @ u.T >= threshold, 1)), strict=True):
            i, j = own[a], own[b]
            count[i] += 1
            count[j] += 1
            root[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)] = min(least.get(top(i), r[0]), r[0])
    name = lambda i: rows[i][0] if not ok(rows[i]) else least.get(top(i))
    return sorted((str(r[0]), count[i], str(name(i)), str(None if r[0] is None or name(i) is None else r[0] == name(i))) for i, r in enumerate(rows))


def crowd(rng, dims=24):
    """Vectors of four labels: unrelated ones, pairs, chains, one crowd of near copies, exact copies."""
    rows, k = [], 0

    def add(v, label):
        nonlocal k
        rows.append(((k * 7919) % 100_003, v.astype(np.float32).tolist(), label))
        k += 1

    for label in range(4):
        for _ in range(150):
            add(rng.standard_normal(dims), label)
        for _ in range(20):
            v = rng.standard_normal(dims)
            for _ in range(int(rng.integers(1, 5))):
                v = v + rng.standard_normal(dims) * rng.choice([0.05, 0.3, 0.4])
                add(v * rng.choice([1, 3, 1e-3]), label)
    centre = rng.standard_normal(dims)
    for _ in range(400):
        add(centre + rng.standard_normal(dims) * 0.15, 0)
    for _ in range(30):
        add(centre, 1)
    return rows


def test_links_are_those_of_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = crowd(rng)
    v = rows[0][1]
    rows += [(200_000, None, 0), (200_001, [], 0), (200_002, [0.0] * 24, 0), (200_003, [float("nan")] * 24, 0), (200_004, [None] + v[1:], 0), (200_005, v, None), (200_006, v, None), (200_007, v[:9], 0), (200_008, v[:9], 0), (200_009, [1.0], 3), (None, v, 0), (None, [7.0, 7.0], 9), (rows[1][0], rows[1][1], rows[1][2]), (200_010, [-0.0, 1.0], 5), (200_011, [0.0, 1.0], 5)]
    audits = []
    df = frame(spark, rows).repartition(6)
    found = small_world.near_duplicates(df, shard=128, group=300, audits=audits)
    got = sorted(tuple(str(x) if i != 1 else x for i, x in enumerate(r)) for r in found.collect())
    assert got == brute(rows)
    said = audits[0].collect()
    assert len(said) > 20 and all(r.recall >= small_world.RECALL or r.beam >= 128 for r in said)


def test_graph_recall_and_widening():
    rng = np.random.default_rng(6)
    points = small_world.units(np.r_[rng.standard_normal((2500, 64)), rng.standard_normal((1, 64)) + 0.15 * rng.standard_normal((700, 64))])
    graph = small_world.Graph.build(points.astype(np.float32))
    assert len(graph.links) == 3 and all((x < len(x)).all() for x in graph.links)
    true = points @ points.T >= 0.93
    found = np.zeros(true.shape, bool)
    for i, j in graph.links_of(points, points, 0.93, small_world.BEAM):
        assert not found[i, j].any()
        found[i, j] = True
    assert not (found & ~true).any() and (found & true).sum() >= 0.999 * true.sum()
    cut = small_world.Graph(graph.points, [np.where(np.arange(x.shape[1]) < 2, x, -1) for x in graph.links])  # a poor graph
    recall = [small_world.audit(cut, points, points, 0.93, b) for b in (8, 256, 4096)]
    assert recall[0] < small_world.RECALL and recall[0] <= recall[1] and recall[2] == 1.0


def test_no_rows_and_doubles(spark):
    df = frame(spark, [], "vec_id string, embedding array<double>, label string")
    assert small_world.near_duplicates(df).count() == 0
    rows = [("b", [1e300, 1e300], "x"), ("a", [1e-300, 1e-300], "x"), ("c", [1.0, -1.0], "x"), ("d", [1.0, 1.0], "y")]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in small_world.near_duplicates(frame(spark, rows, "vec_id string, embedding array<double>, label string")).collect()}
    assert got == {"a": (1, "a", True), "b": (1, "a", False), "c": (0, "c", True), "d": (0, "d", True)}
