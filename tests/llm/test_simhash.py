"""Fingerprints and components against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from diffloom.llm import simhash
from tests.llm.helpers import ODD, frame, prose


def plain_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = low.encode().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(points, near):
    root = list(range(len(points)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(points)):
        for j in range(i):
            if near(points[i], points[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(points))]


def test_hash_is_sparks(spark):
    words = ["a b c", "é x", ""]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")).collect()]
    assert [g % (1 << 64) for g in got] == [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, "aa", rng.randint(0, 40))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(10)] + [(120 + i, rows[i][1].upper()) for i in range(5)] + ODD + [(951, "word " * 20000)]
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    prints = [plain_print(t) for _, t in rows]
    comp = plain_components(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for (i, _), c in zip(rows, comp, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = sorted((str(i), f"{p:016x}", str(least.get(c))) for (i, _), p, c in zip(rows, prints, comp, strict=True))
    assert sorted((str(r.doc_id), f"{r.fp % (1 << 64):016x}", str(r.component_id)) for r in got) == want


@pytest.mark.parametrize("levels", [4, 8, 16])
@pytest.mark.parametrize("block", [4, 8192])
def test_links_of_near_fingerprints(spark, block, levels):
    rng = random.Random(7)
    points = set()
    for _ in range(40):
        p = rng.getrandbits(64)
        for _ in range(rng.randint(1, 8)):  # chains: each step flips up to three bits
            points.add(p)
            for _ in range(rng.randint(1, 3)):
                p ^= 1 << rng.randrange(64)
    points = sorted(p - (1 << 64) if p >> 63 else p for p in points)
    nodes = spark.createDataFrame([(p,) for p in points], "fp long")
    label = {r.u: r.v for r in simhash.components(simhash.links(nodes, 2, levels, block)).collect()}
    want = plain_components(points, lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= 2)
    assert [label.get(p, p) for p in points] == [points[c] for c in want]


@pytest.mark.parametrize("levels", [4, 8])
def test_every_close_pair_meets_in_a_shard(levels):
    rng = random.Random(3)
    for _ in range(300):
        p = rng.getrandbits(64)
        q = p
        for _ in range(rng.randint(0, 2)):
            q ^= 1 << rng.randrange(64)
        home, visits = simhash._cells(np.array([p, q], np.uint64), 2, levels)
        asked = {(int(i), int(c)) for rows, cells in visits for i, c in zip(rows, cells, strict=True)}
        assert (0, int(home[1])) in asked or (1, int(home[0])) in asked


def test_two_similar_sets_share_a_prefix_and_a_close_fingerprint():
    rng, worst = np.random.default_rng(5), 0
    common = rng.integers(0, 6, 1 << simhash.SLOT_BITS).astype(np.int8)
    for _ in range(400):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        cut = int(rng.integers(0, n // 5 + 1))
        b = np.unique(np.r_[a[rng.permutation(len(a))[cut:]], rng.integers(0, 1 << 63, int(rng.integers(0, n // 5 + 1)), dtype=np.uint64)])
        shared = len(np.intersect1d(a, b))
        if 5 * shared >= 4 * (len(a) + len(b) - shared):
            assert len(np.intersect1d(simhash.prefix(a, common), simhash.prefix(b, common)))
            x, y = simhash.wide_prints([a, b])
            worst = max(worst, int(np.bitwise_count(x ^ y).sum()))
    assert worst <= simhash.RADIUS


def test_components_of_a_path_and_a_star(spark):
    e = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 200)] + [(400, 400)]
    df = spark.createDataFrame([(a.to_bytes(4, "big"), b.to_bytes(4, "big")) for a, b in e], "u binary, v binary")
    got = {int.from_bytes(r.u, "big"): int.from_bytes(r.v, "big") for r in simhash.components(df).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {100 + i: 100 for i in range(1, 200)}


def test_one_of_each(spark):
    rng = random.Random(9)
    a, b = prose(rng, "aa", 120), prose(rng, "bb", 120)
    near = a.split()
    near[60:60] = ["inserted"]
    rows = [(1, a), (2, a), (3, " ".join(near)), (4, b), (5, None), (6, None), (None, b), (7, prose(rng, "aa", 120)), (1, a)]
    got = simhash.one_of_each(frame(spark, rows))
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "1", "4", "5", "7", "None"]
    assert got.columns == frame(spark, rows).columns
    assert simhash.one_of_each(frame(spark, [])).count() == 0


def test_simhash_tie_is_no_bit():
    f, n = simhash.simhash(["a b c d"], 3)
    h = [xxhash.xxh64_intdigest(x, 42) for x in (b"a b c", b"b c d")]
    assert int(f[0]) == h[0] & h[1] and n[0] == 2 and isinstance(f, np.ndarray)


def plain_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize(("block", "shingles"), [(3, 300), (8192, 1 << 21)])
def test_near_copies_have_exact_similarity(spark, block, shingles):
    rng = random.Random(12)
    texts = []
    for k in range(24):
        w = prose(rng, "aa", 150).split()
        texts.append(" ".join(w))
        for _ in range(3):  # edits of one word each change five shingles: similarities around 0.8, in chains too
            x = w[:]
            for i in rng.sample(range(10, 140), rng.randint(1, 5)):
                x[i] = f"edit{rng.randrange(10**6)}"
            texts.append(" ".join(x))
            if k % 3 == 0:
                w = x
    w = texts[0].split()
    texts += [texts[0] + " " + " ".join([" ".join(w[:60])] * 9)]  # the same set but for the seams, far more shingles
    rng.shuffle(texts)
    sets = [plain_set(t) for t in texts]
    near = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    want = plain_components(sets, near)
    assert sum(near(a, b) for a in sets for b in sets if a is not b) > 40
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(frame(spark, list(enumerate(texts))), block=block, block_shingles=shingles).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_one_of_each_keeps_texts_below_the_similarity(spark):
    rng = random.Random(13)
    w = prose(rng, "aa", 200).split()
    other = [f"x{i}" if i % 25 == 12 else x for i, x in enumerate(w)]  # 8 edits: similarity about 0.66
    again = w + w[:60] * 9
    assert len(plain_set(" ".join(w)) & plain_set(" ".join(other))) < 0.7 * len(plain_set(" ".join(w)) | plain_set(" ".join(other)))
    rows = [(1, " ".join(w)), (2, " ".join(other)), (3, " ".join(again))]
    assert sorted(r.doc_id for r in simhash.one_of_each(frame(spark, rows)).collect()) == [1, 2]


def test_near_copies_come_from_vantage_point_shards(spark, monkeypatch):
    """What the shards of the fingerprints link is linked, and rare shingles are asked only about the rest."""
    rng = random.Random(21)
    texts = [prose(rng, "aa", 300) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100 + i, t + " more") for i, t in enumerate(texts)]  # one shingle more: no or few bits
    rows += [(200, " ".join(f"x{i}" if i % 60 == 30 else w for i, w in enumerate(texts[0].split())))]
    sets = simhash.shingle_sets([t for _, t in rows])
    first = [int(f[0]) for f in simhash.wide_prints(sets)]
    want = plain_components(first, lambda a, b: (a ^ b).bit_count() <= simhash.CLOSE)
    assert 1 < sum(want.count(c) > 1 for c in want) < len(rows)
    frame_ = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(first)], "id long, f0 long")
    got = {r.id: r.hub for r in simhash.close_sets(frame_).collect()}
    assert got == {i: c for i, c in enumerate(want) if want.count(c) > 1}
    assert sorted(r.doc_id for r in simhash.one_of_each(frame(spark, rows)).collect()) == list(range(12))
    # what the shards have linked is not asked again
    hub, fp = np.array([7, 7, 9]), np.array([[1, 0, 0, 0], [1, 0, 0, 1], [1, 0, 0, 2]], np.uint64)
    u, v = simhash.candidate_links(np.zeros(3, np.int64), np.zeros(3, np.int64), np.zeros(3, bool), np.array([10, 10, 10]), fp, hub)
    assert len(u) == 1 and 2 in (u[0], v[0])
    asked = []
    real = simhash.links
    monkeypatch.setattr(simhash, "links", lambda *a, **b: asked.append(1) or real(*a, **b))
    simhash.one_of_each(frame(spark, rows))
    assert asked
