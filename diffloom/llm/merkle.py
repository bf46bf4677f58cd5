"""Merkle manifest of a dataset: a tree of SHA-256 digests for each source, and one over the sources' roots.

The nodes of a group are dealt into aligned blocks of 3^LEVELS. A block keeps each of its levels as one hex string of all digests in
turn: fixed-width substrings of it are the runs that hash to the parents, and the substrings that flank a node are its sibling
segments. A block's last digest is a node of the next tier, whose blocks are made alike, until every group is one digest (tiers
are few: each is 1 / 81 of the one below). On the way down a block hands the path above it to its nodes, so each leaf
ends with its whole path. Every join is on (group, block), which is unique on one side: a group that holds a third of all rows is
spread over its blocks like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffloom.llm.common import placed, saved

#: Fixed values of the format: nodes of a run, hex digits of a digest.
RUN, WIDTH = 3, 64
#: Levels of a block: 81 nodes, strings of 5184 digits at most.
LEVELS = 4
BLOCK = RUN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """H: hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(c: Column) -> Column:
    """A value as a leaf holds it: `-` if null, else its UTF-8 length, a colon, itself."""
    s = c.cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(values: dict[str, Column]) -> Column:
    return digest(*(field(values[k]) for k in FIELDS))


def _more(j: int) -> Column:
    """Whether the group of n nodes has several left on the j-th level above them."""
    return F.col("n") > RUN**j


def _levels(rows: DataFrame) -> DataFrame:
    """Blocks with l0, l1, ...: each level as one string; a group's last digest moves up as it is."""
    rows = rows.withColumn("l0", F.array_join("m.digest", ""))
    for j in range(LEVELS):
        below = F.col(f"l{j}")
        runs = F.transform(F.sequence(F.lit(0), F.expr(f"(length(l{j}) - 1) div {RUN * WIDTH}").cast("int")), lambda i: F.sha2(F.substring(below, i * RUN * WIDTH + 1, F.lit(RUN * WIDTH)), 256))  # noqa: B023
        rows = rows.withColumn(f"l{j + 1}", F.when(_more(j), F.array_join(runs, "")).otherwise(below))
    return rows


def _siblings(local: Column) -> Column:
    """(left, right) of the node at place `local` of its block and of those above it, as far as the group goes on."""
    steps = []
    for j in range(LEVELS):
        at = F.floor(local / RUN**j).cast("int")
        own = at % RUN
        left = F.substring(F.col(f"l{j}"), (at - own) * WIDTH + 1, own * WIDTH)
        right = F.substring(F.col(f"l{j}"), (at + 1) * WIDTH + 1, (RUN - 1 - own) * WIDTH)
        steps.append(F.when(_more(j), F.struct(left.alias("left"), right.alias("right"))))
    return F.filter(F.array(*steps), lambda s: s.isNotNull())


def _up(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(blocks of each tier, lowest first; g and digest of each group's root) of nodes(g, pos, n, digest, item)."""
    tiers = []
    while True:
        block = F.floor(F.col("pos") / BLOCK)
        b = nodes.groupBy("g", "n", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "item"))).alias("m"))
        tiers.append(saved(b, f"tier-{len(tiers)}"))
        most = tiers[-1].agg(F.max("n")).first()[0] or 1
        tops = _levels(tiers[-1]).select("g", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col(f"l{LEVELS}").alias("digest"), F.lit(0).alias("item"))
        if most <= BLOCK:
            return tiers, tops.select("g", "digest")
        nodes = tops


def _down(tiers: list[DataFrame], tops: DataFrame) -> DataFrame:
    """g, pos, digest, item, path (siblings from the node to the root) of the lowest tier's nodes, and what else tops(g, path, ...) has."""
    more = [c for c in tops.columns if c not in ("g", "path")]
    above = tops.withColumn("block", F.lit(0).cast("long"))
    for tier in reversed(tiers):
        rows = _levels(tier).join(above, ["g", "block"]).select("g", "n", "block", "path", *more, *(f"l{j}" for j in range(LEVELS)), F.explode("m").alias("x"))
        path = F.concat(_siblings(F.col("x.pos") - F.col("block") * BLOCK), "path")
        rows = rows.select("g", F.col("x.pos").alias("pos"), F.col("x.digest").alias("digest"), F.col("x.item").alias("item"), path.alias("path"), *more)
        above = rows.select("g", F.col("pos").alias("block"), "path", *more)
    return rows


NO_PATH = "cast(array() AS array<struct<left:string,right:string>>)"


def manifest(leaves: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, pos, leaf, path, subroot, root and the columns of `carry`, of each row of leaves(doc_id, source, leaf, ...).

    Leaves ascend by doc_id within a source (null first; repeated ids by their leaves, copies of a row in any order); a null source is
    a source of its own, before all others. path: the siblings left and right of the leaf, of its parent and so on to the root.
    A lone leaf is its subroot, a lone subroot the root. No row in, no row out.
    """
    g = F.struct(F.col("source").isNotNull().alias("known"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("name"))
    item = F.struct(F.col("doc_id"), *carry)
    rows = placed(leaves.select(g.alias("g"), "doc_id", "leaf", item.alias("item")), ("doc_id", "leaf"))
    tiers, subroots = _up(rows.select("g", "pos", "n", F.col("leaf").alias("digest"), "item"))
    sources = placed(saved(subroots.select(F.lit(0).alias("g"), F.col("g").alias("item"), "digest"), "subroots"), ("item",))
    upper, root = _up(sources)
    tops = _down(upper, root.select("g", F.expr(NO_PATH).alias("path"), F.col("digest").alias("root")))
    tops = saved(tops.select(F.col("item").alias("g"), "path", F.col("digest").alias("subroot"), "root"), "source-paths")
    rows = _down(tiers, tops)
    return rows.select("item.doc_id", F.when(F.col("g.known"), F.col("g.name")).alias("source"), "pos", F.col("digest").alias("leaf"), *(F.col(f"item.{c}").alias(c) for c in carry), "path", "subroot", "root")


def folded(leaf_digest: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf_digest, lambda h, s: digest(s["left"], h, s["right"]))


def proof_digest(path: Column) -> Column:
    """H of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def leaves(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, source, leaf of each row of docs (columns FIELDS): any of them may be null, texts are hashed whole, other
    columns are ignored."""
    values = {k: F.col(id_col if k == "doc_id" else k) for k in FIELDS}
    return docs.select(F.col(id_col).alias("doc_id"), F.col("source").cast("string").alias("source"), leaf(values).alias("leaf"))


def verified(presented: DataFrame, kept: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, source, n_kept, verified of each row of `presented` documents against a manifest: whether its leaf and the path of a kept row of its
    id and source lead to the root. Rows that the manifest doesn't know are not verified; of repeated rows any path will do; a
    null id or source is an id or source of its own. `presented` may be all documents or some; the join is by id, which spreads a
    large source."""
    p = leaves(presented, id_col).withColumn("_row", F.monotonically_increasing_id())
    k = kept.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), "path", "root")
    j = p.join(k, p["doc_id"].eqNullSafe(k["_id"]) & p["source"].eqNullSafe(k["_source"]), "left")
    good = F.coalesce(folded(F.col("leaf"), F.col("path")) == F.col("root"), F.lit(False))
    return j.groupBy("_row", "doc_id", "source").agg(F.count("root").alias("n_kept"), F.bool_or(good).alias("verified")).drop("_row")


def tamper_check(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: a manifest of docs, checked against a copy of them in which the
    texts of rows with an even crc32 of doc_id have lost their line ends. Rows with a null id are not tampered with."""
    values = {k: F.col(k) for k in FIELDS}
    hurt = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n"))
    other = leaf(values | {"text": F.replace("text", F.lit("\n"), F.lit(""))})
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), leaf(values).alias("leaf"), F.when(hurt, other).alias("tampered"))
    m = manifest(saved(rows, "leaves"), ("tampered",))
    m = m.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return m.withColumn("verified", F.col("folded_root") == F.col("root"))


def _field_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"


def _leaf_sql(text: str) -> str:
    return f"sha256({' || '.join(_field_sql(text if k == 'text' else k) for k in FIELDS)})"


def _tree_sql(name: str, nodes: str, part: str) -> str:
    """CTE name(part, lvl, pos, h, n): all levels of the trees of nodes(part, pos, h, n), a join of runs at a time."""
    return f"{name} AS (SELECT {part}, 0 AS lvl, pos, h, n FROM {nodes} UNION ALL SELECT {part}, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY {part}, lvl, pos // 3, n)"


def _steps_sql(rows: str, tree: str, part: str, key: str, first: int) -> str:
    at = "(p.pos // CAST(pow(3, u.lvl) AS BIGINT))"
    return f"""SELECT p.{key}, u.lvl + {first} AS lvl, coalesce(string_agg(CASE WHEN u.pos < {at} THEN u.h END, '' ORDER BY u.pos), '') AS l, coalesce(string_agg(CASE WHEN u.pos > {at} THEN u.h END, '' ORDER BY u.pos), '') AS r
      FROM {rows} p JOIN {tree} u ON u.{part} IS NOT DISTINCT FROM p.{part} AND u.n > 1 AND u.pos // 3 = {at} // 3 GROUP BY p.{key}, u.lvl"""


SQL = f"""WITH RECURSIVE
table8 AS (SELECT range AS n, 0 AS k, range AS c FROM range(256) UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM table8 WHERE k < 8),
ids AS (SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS s FROM documents WHERE doc_id IS NOT NULL),
crc AS (SELECT doc_id, s, 1 AS i, 4294967295 AS c FROM ids UNION ALL SELECT doc_id, s, i + 1, xor(t.c, crc.c >> 8) FROM crc JOIN (SELECT n, c FROM table8 WHERE k = 8) t ON t.n = xor(crc.c, ord(s[i])) & 255 WHERE i <= length(s)),
even AS (SELECT doc_id FROM crc WHERE i > length(s) AND xor(c, 4294967295) % 2 = 0),
leafed AS (SELECT row_number() OVER () AS rid, doc_id, source, {_leaf_sql('text')} AS h, CASE WHEN doc_id IN (SELECT doc_id FROM even) THEN {_leaf_sql("replace(text, chr(10), '')")} END AS t FROM documents),
laid AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leafed),
{_tree_sql('up', 'laid', 'source')},
subs AS (SELECT source, h, 0 AS one, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
{_tree_sql('tops', 'subs', 'one')},
low AS ({_steps_sql('laid', 'up', 'source', 'rid', 0)}),
high AS ({_steps_sql('subs', 'tops', 'one', 'source', 100)}),
steps AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY lvl) AS k FROM (SELECT * FROM low UNION ALL SELECT l.rid, high.lvl, high.l, high.r FROM laid l JOIN high ON high.source IS NOT DISTINCT FROM l.source)),
proof AS (SELECT l.rid, sha256(coalesce(string_agg(s.l || s.r, '' ORDER BY k), '')) AS p FROM laid l LEFT JOIN steps s USING (rid) GROUP BY l.rid),
fold AS (SELECT rid, 0 AS k, coalesce(t, h) AS h FROM laid UNION ALL SELECT f.rid, s.k, sha256(s.l || f.h || s.r) FROM fold f JOIN steps s ON s.rid = f.rid AND s.k = f.k + 1),
ends AS (SELECT rid, arg_max(h, k) AS h FROM fold GROUP BY rid),
root AS (SELECT h FROM tops WHERE n = 1)
SELECT doc_id, laid.h AS leaf, subs.h AS subroot, root.h AS root, proof.p AS proof_sha256, ends.h AS folded_root, ends.h = root.h AS verified
FROM laid JOIN subs ON subs.source IS NOT DISTINCT FROM laid.source JOIN proof USING (rid) JOIN ends USING (rid), root"""
