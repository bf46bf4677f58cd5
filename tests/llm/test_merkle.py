"""Merkle manifest against a plain tree in memory."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from diffloom.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """(root, siblings of each node as (left, right), lowest first)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, k in enumerate(at):
            run = k // 3 * 3
            paths[i].append(("".join(level[run:k]), "".join(level[k + 1 : run + 3])))
        level = [h(*level[i : i + 3]) for i in range(0, len(level), 3)]
        at = [k // 3 for k in at]
    return level[0], paths


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    own = {}
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        own[s] = tree([leaf(r) for r in by[s]])
    root, above = tree([own[s][0] for s in order])
    out = []
    for s, up in zip(order, above, strict=True):
        for r, path in zip(by[s], own[s][1], strict=True):
            t, path = r, path + up
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                t = (*r[:4], r[4].replace("\n", ""))
            f = leaf(t)
            for a, b in path:
                f = h(a, f, b)
            out.append((r[0], leaf(r), own[s][0], root, h(*(a + b for a, b in path)), f, f == root))
    return out


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("g", "pos", "n", "digest", "item", "leaf", "path", "block", "at", "_tie", "tampered", "root"):
        df = df.withColumn(c, F.lit("x"))
    return df


def corpus(seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(900):
        source = rng.choice(["hot"] * 6 + ["a", "é", "z", None, "", f"own{i % 40}"])
        rows.append((i, source, rng.choice(["en", None]), rng.choice([None, i]), rng.choice([None, "", "one line", "two\nlines\n", "é\n漢字" * 3])))
    rows += [rows[5], rows[5], (None, "hot", None, None, "no id\n"), (None, None, None, None, None), (7, "hot", "en", 1, "same id"), (1000, "long", None, 9, "wörter\n" * 60_000)]
    return rows


def test_manifest_is_the_plain_tree(spark):
    rows = corpus()
    got = merkle.tamper_check(frame(spark, rows).repartition(7)).collect()
    key = lambda r: tuple(str(x) for x in r)
    want = plain(rows)
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert any(r.verified for r in got) and any(not r.verified for r in got)


@pytest.mark.parametrize("n", [0, 1, 4, 82])
def test_small_trees(spark, n):
    rows = [(i, "s", "en", 1, f"t\n{i}") for i in range(n)]
    got = merkle.tamper_check(frame(spark, rows)).collect()
    assert sorted(map(tuple, got)) == sorted(plain(rows) if rows else [])


def test_verified_against_a_manifest(spark):
    docs = frame(spark, corpus())
    kept = merkle.manifest(merkle.leaves(docs))
    some = docs.where("doc_id < 20").withColumn("text", F.when(F.col("doc_id") == 3, "forged").otherwise(F.col("text")))
    more = some.unionByName(docs.where("doc_id = 1").withColumn("source", F.lit("nowhere")))
    got = merkle.verified(more, kept).collect()
    assert len(got) == more.count()
    assert {r.doc_id for r in got if not r.verified and r.source != "nowhere"} == {3}
    assert [(r.n_kept, r.verified) for r in got if r.source == "nowhere"] == [(0, False)]
