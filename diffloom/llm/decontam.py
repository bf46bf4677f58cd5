"""Benchmark decontamination: rare seeds join passages of documents to benchmark items, Smith-Waterman alignments score them.

Words are lower-cased (A-Z) and freed of ASCII punctuation. Each pair of words that are neighbours or have one word between
them is a seed. One scan of the documents counts in how many texts each seed of the benchmark stands; of every item the rarest
seeds are kept, so many that no alignment does without all of them (below). A second scan cuts out the passages around them; the
passages are joined to the items by seed, and a passage that holds enough seeds of an item is aligned with it (match 2, mismatch and
gap -1). The score is the alignment's share of the full one. Both scans look seeds up in a bit table of a fixed size first, so what is
sent to the executors does not grow with the benchmark, nor does the number of scans.

No alignment that scores half of an item of n >= 3 words is lost. Let it match m words and pay C for what lies between:
2 m - C >= n, so C <= 2 m - n <= m. Two matched words in turn with more than one word between them, on either side,
cost 2 or more; so at most C / 2 of the m - 1 steps from match to match do, and n / 2 - 1 steps or more are seeds on both
sides, one at least. They begin at as many of the item's n - 1 first words; of any n - (that many) of those, one is among them. The
alignment covers m + C <= 3 m - n <= 2 n words of the document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from diffloom.llm.common import TABLE_BITS, bit_table, column_unlike, in_table, saved, text_slices, without  # noqa: F401

#: Items of fewer words match as a whole only: half of such an item is one word, which any text may hold. With 1 all are aligned.
WHOLE_BELOW = 3
THRESHOLD = 0.5
#: Words from the first to the last seed of a passage; a longer stretch is cut into passages that overlap.
CORE = 512
_CLEAN = bytes.maketrans(bytes(range(65, 91)) + b"\t\n\r\x0b\x0c!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", bytes(range(97, 123)) + b" " * 37)
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_BASE = 0xD6E8FEB86659FD93
_VALUES = np.frombuffer(b"".join(hashlib.blake2b(bytes([b]), digest_size=8).digest() for b in range(256)), np.uint64)
#: Bytes of a text that are hashed at once.
STRETCH = 1 << 18


def clean_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_CLEAN).split() if text else []


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS = [_powers(_BASE, STRETCH), _powers(pow(_BASE, -1, 1 << 64), STRETCH)]


def _stretch(data: bytes) -> np.ndarray:
    """Hashes of the words of cleaned bytes: polynomials in the base, from differences of one running sum."""
    a = np.frombuffer(data, np.uint8)
    up, down = (x[: len(a)] if len(a) <= STRETCH else _powers(b, len(a)) for x, b in zip(_POWERS, (_BASE, pow(_BASE, -1, 1 << 64)), strict=True))
    edge = np.flatnonzero(np.diff((a != 32).astype(np.int8), prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[a] * up, dtype=np.uint64)])
    h = (upto[end] - upto[start]) * down[start]
    h = (h ^ (h >> np.uint64(32))) * _FACTORS[2]
    return h ^ (h >> np.uint64(29))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the cleaned words of a whole text, a stretch that ends at a space at a time."""
    data = text.encode("utf-8", "surrogatepass").translate(_CLEAN) if text else b""
    out, at = [np.zeros(0, np.uint64)], 0
    while at < len(data):
        cut = at + STRETCH if len(data) - at > STRETCH else len(data)
        end = data.rfind(b" ", at, cut) + 1 if cut < len(data) else cut
        if not end:  # a word that is longer than a stretch
            end = data.find(b" ", cut) + 1 or len(data)
        out.append(_stretch(data[at:end]))
        at = end
    return np.concatenate(out)


def seeds(h: np.ndarray, ones: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the pairs of words at distance 1 and 2, one hash whatever the distance, and of single words if `ones`; where they start)."""
    g = h ^ (h >> np.uint64(31))
    out = [g[:-k] * _FACTORS[0] + g[k:] * _FACTORS[1] for k in (1, 2)] + ([g * _FACTORS[2]] if ones else [])
    where = np.concatenate([np.arange(len(p)) for p in out])
    out = np.concatenate(out)
    return out ^ (out >> np.uint64(33)), where


def need(n: int) -> int:
    """Starts of seeds that an alignment of half an item of n words holds at least."""
    return max(1, -(-n // 2) - 1)


def item_seeds(x: np.ndarray, whole_below: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(seeds of an item, where they start, how many starts hold one of any match of it)."""
    n = len(x)
    if n < 3:
        whole = n < whole_below
        s, where = seeds(x, n == 1 or not whole)
        keep = slice(0, 1) if whole else slice(n - 1, None)  # the pair or the word itself, or each word
        return s[keep], where[keep], n
    s, where = seeds(x, False)
    return s, where, 1 if n < whole_below else n - need(n)


def passages(h: np.ndarray, table: np.ndarray, ones: bool, lap: int, core: int = CORE):
    """(words, seeds) of each passage of a text: what lies within `lap` words of a seed in the table."""
    s, where = seeds(h, ones)
    hit = in_table(table, s)
    s, where = s[hit], where[hit]
    order = np.argsort(where, kind="stable")
    s, where = s[order], where[order]
    run = np.r_[0, np.cumsum(np.diff(where) > 2 * lap)] if len(where) else where
    block = where // core
    cut = np.flatnonzero((np.diff(run) != 0) | (np.diff(block) != 0)) + 1
    for a, b in zip(np.r_[0, cut], np.r_[cut, len(where)], strict=True):
        if b > a:
            yield h[max(0, where[a] - lap) : where[b - 1] + lap], np.unique(s[a:b])


def windows(x: np.ndarray, h: np.ndarray, whole_below: int):
    """(words, seeds found) of each stretch of a passage that holds enough seeds of the item."""
    n = len(x)
    if n < max(3, whole_below):
        yield h, 1
        return
    s, where = seeds(h, False)
    hit = np.isin(s, seeds(x, False)[0])
    s, at = s[hit], where[hit]
    w = np.unique(at)
    k = need(n)
    full = np.flatnonzero(w[k - 1 :] - w[: len(w) - k + 1] < 2 * n) if len(w) >= k else w[:0]
    for part in np.split(full, np.flatnonzero(np.diff(w[full]) > 2 * n) + 1) if len(full) else ():
        lo, hi = max(0, w[part[0]] - 2 * n), w[part[-1] + k - 1] + 2 * n + 3
        yield h[lo:hi], len(np.unique(s[(at >= lo) & (at < hi)]))


def stands(x: np.ndarray, h: np.ndarray) -> bool:
    """Whether all words of the item stand in turn."""
    return len(h) >= len(x) and bool((np.lib.stride_tricks.sliding_window_view(h, len(x)) == x).all(1).any())


#: Cells of the matrices of one step of `align`.
CELLS = 1 << 19


def align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Best local alignment (Smith-Waterman; match 2, mismatch and gap -1) of each item with its passage.

    Pairs of like sizes move together, a row of cells at a time. What fills the shorter ones matches nothing, so it adds nothing.
    """
    best = np.zeros(len(pairs), np.int64)
    order = sorted(range(len(pairs)), key=lambda i: (len(pairs[i][0]), len(pairs[i][1])))
    while order:
        most, wide = 0, 1
        while most < len(order) and (most + 1) * max(wide, len(pairs[order[most]][1]) + 1) <= max(CELLS, wide):
            wide = max(wide, len(pairs[order[most]][1]) + 1)
            most += 1
        part, order = order[: max(1, most)], order[max(1, most) :]
        deep, wide = max(len(pairs[i][0]) for i in part), max(len(pairs[i][1]) for i in part)
        item, passage = np.zeros((len(part), deep), np.uint64), np.zeros((len(part), wide), np.uint64)
        for k, i in enumerate(part):
            item[k, : len(pairs[i][0])], passage[k, : len(pairs[i][1])] = pairs[i]
        long = np.array([[len(pairs[i][0]), len(pairs[i][1])] for i in part])
        inside = np.arange(wide) < long[:, 1:]
        at = np.arange(wide + 1, dtype=np.int32)
        row, top = np.zeros((len(part), wide + 1), np.int32), np.zeros(len(part), np.int32)
        for j in range(deep):
            new = np.zeros_like(row)
            same = (passage == item[:, j, None]) & inside & (j < long[:, :1])
            new[:, 1:] = np.maximum(0, np.maximum(row[:, :-1] + np.where(same, np.int32(2), np.int32(-1)), row[:, 1:] - 1))
            row = np.maximum.accumulate(new + at, axis=1) - at
            top = np.maximum(top, row.max(1))
        best[part] = top
    return best


def _lists(rows: list[np.ndarray]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.uint64), *rows]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))


def _arrays(column: pa.Array) -> list[np.ndarray]:
    return [np.asarray(v.values).view(np.uint64) for v in column]


def _key(h: np.ndarray) -> bytes:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, whole_below: int = WHOLE_BELOW) -> DataFrame:
    """doc_id, item_id, score, n_seeds of each document and item whose best alignment scores `threshold` (0.5 at least) or more.

    Items under `whole_below` words match where all their words stand in turn. Null and empty texts and items match nothing. Repeated
    rows of a document give one row, as do passages that repeat within it; a null id is one document; extra columns are
    ignored; an empty table on either side gives no rows. Whole texts are scanned, very long ones in stretches and passages.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct()
    kind, id_kind = docs.schema[id_col].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def hashed(batches):
        for batch in batches:
            words = [word_hashes(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array([_key(x) for x in words], pa.binary()), _lists(words)], names=["item_id", "item", "x"])

    def spread(batches):
        for batch in batches:
            for item, x in zip(batch.column("item"), _arrays(batch.column("x")), strict=True):
                s, where, k = item_seeds(x, whole_below)
                yield pa.RecordBatch.from_pydict({"item": [item.as_py()] * len(s), "seed": s.view(np.int64), "start": where, "k": [k] * len(s)})

    named = saved(items.mapInArrow(hashed, f"item_id {id_kind}, item binary, x array<long>").where("size(x) > 0"), "items")
    known = named.select("item", "x").dropDuplicates(["item"])
    all_seeds = saved(known.mapInArrow(spread, "item binary, seed long, start long, k long"), "item-seeds")
    most, fewest = named.agg(F.max(F.size("x")), F.min(F.size("x"))).first()
    ones, lap = (fewest or 3) == 1 or (fewest or 3) < 3 and whole_below < 3, 2 * (most or 0) + 3
    shared = spark.sparkContext.broadcast(bit_table(all_seeds))

    def count(batches):
        for batch in batches:
            for _, texts in text_slices(batch.column("text")):
                held = [np.zeros(0, np.uint64)]
                for t in texts:
                    s = seeds(word_hashes(t), ones)[0]
                    held.append(np.unique(s[in_table(shared.value, s)]))
                s, n = np.unique(np.concatenate(held), return_counts=True)
                if len(s):
                    yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(n.astype(np.int64))], names=["seed", "n"])

    counts = rows.select("text").mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
    seen = all_seeds.join(counts, "seed", "left").groupBy("item", "start", "k").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.collect_set("seed").alias("seeds"))
    rarest = seen.withColumn("at", F.row_number().over(W.partitionBy("item").orderBy("n", "start"))).where("at <= k")
    rare = saved(rarest.select(F.explode("seeds").alias("seed"), "item").distinct(), "rare-seeds")
    wanted = spark.sparkContext.broadcast(bit_table(rare))

    def cut(batches):
        for batch in batches:
            for start, texts in text_slices(batch.column("text")):
                at, words, held = [], [], []
                for i, t in enumerate(texts):
                    for h, s in passages(word_hashes(t), wanted.value, ones, lap):
                        at.append(start + i)
                        words.append(h)
                        held.append(s)
                if at:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), pa.array([_key(h) for h in words], pa.binary()), _lists(words), _lists(held)], names=["doc_id", "passage", "h", "seeds"])

    # equal passages, however many documents hold them, are joined and aligned once
    found = saved(rows.mapInArrow(cut, f"doc_id {kind}, passage binary, h array<long>, seeds array<long>"), "passages")
    # only distinct (passage, item) pairs move on
    pairs = found.select("passage", F.explode("seeds").alias("seed")).distinct().join(rare, "seed").select("passage", "item").distinct()
    texts = found.select("passage", "h").dropDuplicates(["passage"])

    def score(batches):
        for batch in batches:
            xs, hs = _arrays(batch.column("x")), _arrays(batch.column("h"))
            at, pairs, n_seeds, scores = [], [], [], []
            for i, (x, h) in enumerate(zip(xs, hs, strict=True)):
                if len(x) < whole_below:
                    if stands(x, h):
                        at.append(i)
                        scores.append(1.0)
                        n_seeds.append(1)
            n_whole = len(at)
            for i, (x, h) in enumerate(zip(xs, hs, strict=True)):
                if len(x) >= whole_below:
                    for part, n in windows(x, h, whole_below):
                        at.append(i)
                        pairs.append((x, part))
                        n_seeds.append(n)
            scores += [v / (2 * len(xs[i])) for i, v in zip(at[n_whole:], align(pairs).tolist(), strict=True)]
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("passage").take(take), batch.column("item").take(take), pa.array(n_seeds, pa.int64()), pa.array(scores, pa.float64())], names=["passage", "item", "n_seeds", "score"])

    scored = pairs.join(texts, "passage").join(known, "item").select("passage", "item", "h", "x").mapInArrow(score, "passage binary, item binary, n_seeds long, score double").where(F.col("score") >= threshold)
    named_docs = found.select("doc_id", "passage").distinct()
    return scored.join(named_docs, "passage").join(named.select("item", "item_id"), "item").groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("n_seeds").alias("n_seeds"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the rows whose text holds a benchmark item; all columns stay. Rows are told apart by their text, so
    null and repeated ids do no harm; null and empty texts stay; very long texts are scanned whole; an empty table stays empty."""
    key = column_unlike(docs, "text_key")
    keyed = docs.withColumn(key, F.sha2(F.col(text_col).cast("binary"), 256))
    found = saved(matches(keyed, benchmark, key, text_col).select("doc_id").distinct(), "contaminated")
    return without(keyed, key, found).drop(key)
