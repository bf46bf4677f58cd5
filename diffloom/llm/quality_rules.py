"""Quality rules: exact counts, then a logistic regression over hashed word and character n-grams.

Features are the mean weights of a text's byte 4-grams, words and word pairs, each hashed into 2**BITS slots. The
model is fitted on a bounded, documented sample of labelled rows, calibrated on a held-out part of it (Platt), and
scores all rows in Arrow batches against a fixed threshold.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffloom.llm.common import SPACES, offsets, segment_sums, text_slices, words

BITS = 18
#: The most labelled rows that the model is fitted on (those with the smallest hash of their id).
SAMPLE = 3000
#: Below even odds: the classes are uneven, and a lost good document costs more than a kept bad one.
THRESHOLD = 0.3
#: Texts of the sample whose n-grams are worked on at a time.
PART = 100
SYMBOLS = b"#*$%&|<>"
LINE_MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    data = text.encode("utf-8", "surrogatepass")
    w = data.split()
    n = len(w)
    chars = len(text) - (len(data) - len(data.translate(None, SPACES)))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip(SPACES)]
    repeated = 0
    if n > WINDOW:
        keys = list(zip(*(w[i:] for i in range(WINDOW)), strict=False))
        if len(set(keys)) < len(keys):
            often = Counter(keys)
            end = 0
            for i, k in enumerate(keys):
                if often[k] > 1:
                    repeated += i + WINDOW - max(i, end)
                    end = i + WINDOW
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        v = self[word] = xxhash.xxh32_intdigest(word)
        return v


_seen = _Hashes()


def features(texts: list[str | None], bits: int = BITS):
    """Hashed byte 4-grams, words and word pairs of each text: three (slots, offsets)."""
    blobs = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    split = [b.split() for b in blobs]
    shift = np.uint32(32 - bits)
    gap = b"\0\0\0"
    data = np.frombuffer(gap + gap.join(blobs) + gap, np.uint8).astype(np.uint32)
    size = [len(b) + 3 for b in blobs]
    gram = data[:-3] | (data[1:-2] << 8) | (data[2:-1] << 16) | (data[3:] << 24)  # each gram ends at its place, so the gaps keep texts apart
    chars = (gram * np.uint32(2654435761)) >> shift
    n = [len(x) for x in split]
    h = np.fromiter((_seen[x] for s in split for x in s), np.uint32, sum(n))
    one = (h * np.uint32(2654435761)) >> shift
    pair = np.zeros(len(h), np.uint32)
    pair[:-1] = ((h[:-1] * np.uint32(0x9E3779B1)) ^ (h[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D) >> shift
    at = offsets(n)
    ends = at[1:][at[1:] > at[:-1]] - 1
    pair[ends] = 0  # a text's last word starts no pair
    return (chars, offsets(size)), (one, at), (pair, at)


@dataclass
class Model:
    weights: np.ndarray  # one row for each kind of feature
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    scale: float = 40.0

    def margins(self, kinds) -> np.ndarray:
        out = np.full(len(kinds[0][1]) - 1, self.bias)
        for w, (slots, at) in zip(self.weights, kinds, strict=True):
            out += self.scale * segment_sums(w[slots], at) / np.maximum(1, np.diff(at))
        return out

    def probability(self, kinds) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(kinds) + self.shift, -40, 40)))


def fit(texts: list[str | None], good: np.ndarray, rounds: int = 60, bits: int = BITS) -> Model:
    """Logistic regression (Adagrad over the whole sample); every fourth row is held out for calibration."""
    held = np.arange(len(texts)) % 4 == 3
    if not len(texts) or good[~held].min(initial=1) == good[~held].max(initial=0) or held.sum() < 2:
        rate = (good.sum() + 1) / (len(good) + 2) if len(good) else 0.99
        return Model(np.zeros((3, 1 << bits), np.float32), float(np.log(rate / (1 - rate))))
    own = [t for t, h in zip(texts, held, strict=True) if not h]
    parts = [(slice(i, i + PART), features(own[i : i + PART], bits)) for i in range(0, len(own), PART)]
    y = good[~held].astype(np.float64)
    balance = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)) / len(y)
    model = Model(np.zeros((3, 1 << bits), np.float32), 0.0)
    memory, bias_memory = np.full_like(model.weights, 1e-12), 1e-12
    for _ in range(rounds):
        slope, lean = 1e-7 * model.weights.astype(np.float64), 0.0
        for rows, kinds in parts:
            p = 1 / (1 + np.exp(-np.clip(model.margins(kinds), -40, 40)))
            g = (p - y[rows]) * balance[rows]
            lean += g.sum()
            for k, (slots, at) in enumerate(kinds):
                n = np.diff(at)
                slope[k] += np.bincount(slots, weights=np.repeat(model.scale * g / np.maximum(1, n), n), minlength=1 << bits)
        memory += slope * slope
        model.weights -= 0.1 * slope / np.sqrt(memory)
        bias_memory += lean**2
        model.bias -= 0.1 * lean / bias_memory**0.5
    last = [t for t, h in zip(texts, held, strict=True) if h]
    m = np.concatenate([model.margins(features(last[i : i + PART], bits)) for i in range(0, len(last), PART)])
    z = good[held]
    pos, neg = z.sum(), len(z) - z.sum()
    t = np.where(z > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(100):  # Newton steps for the two numbers of Platt's sigmoid
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -40, 40)))
        w = np.maximum(p * (1 - p), 1e-9)
        grad = np.array([((p - t) * m).sum() + 1e-3 * (a - 1), (p - t).sum() + 1e-3 * b])
        hess = np.array([[(w * m * m).sum() + 1e-3, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-3]])
        d = np.linalg.solve(hess, grad)
        a, b = a - np.clip(d[0], -1, 1), b - np.clip(d[1], -1, 1)
    model.slope, model.shift = float(max(a, 1e-3)), float(b)
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, threshold: float = THRESHOLD) -> Model:
    """Fit on at most `sample` labelled rows, those with the smallest hashed id. Null labels and ids don't count; a
    document labelled twice counts as its lowest label; a sample with one class gives a constant verdict."""
    chosen = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("id"), "id").limit(sample)
    chosen = F.broadcast(chosen)  # `sample` rows of two numbers at most
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).join(chosen.withColumn("id", F.col("id").cast("string")), "id")
    rows = rows.groupBy("id").agg(F.min("text").alias("text"), F.first("quality").cast("long").alias("quality"))

    def run(batches):
        got = [(r["id"], r["text"], r["quality"]) for b in batches for r in b.to_pylist()]
        got.sort(key=lambda r: (xxhash.xxh32_intdigest(r[0]), r[0]))
        m = fit([t for _, t, _ in got], np.array([q for _, _, q in got], np.int64))
        yield pa.RecordBatch.from_pydict({"weights": [m.weights.tobytes()], "numbers": [[m.bias, m.slope, m.shift]]}, schema=pa.schema([("weights", pa.binary()), ("numbers", pa.list_(pa.float64()))]))

    # `sample` rows at most go to one task, which gives back the weights: their number is fixed
    row = rows.repartition(1).mapInArrow(run, "weights binary, numbers array<double>").first()
    return Model(np.frombuffer(row.weights, np.float32).reshape(3, -1), *row.numbers) if row else fit([], np.zeros(0, np.int64))


def judge(model: Model, threshold: float):
    def verdicts(column):
        base, prob = [], []
        for _, texts in text_slices(column):
            base += [base_counts(t) for t in texts]
            prob.append(model.probability(features(texts)))
        b = np.array(base, np.int64).reshape(-1, 5)
        p = np.concatenate(prob) if prob else np.zeros(0)
        failed = (b[:, 0] < LINE_MIN_WORDS) | (100 * b[:, 4] > REPEAT_PERCENT * b[:, 0])
        return b, failed, ~failed & (p >= threshold), p

    return verdicts


def quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs with the counts, base_failed, kept and probability.

    Null and empty texts have no words and fail; repeated rows are judged each on its own; other columns are ignored;
    no row in, no row out. The model has 3 * 2**BITS weights, whatever the input, and goes along with the code.
    """
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(model)  # a fixed size
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        verdicts = judge(shared.value, threshold)
        for batch in batches:
            b, failed, kept, p = verdicts(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(b[:, i]) for i in range(5)), pa.array(failed), pa.array(kept), pa.array(p)], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that the rules reject; all columns stay, whatever their names.

    Null and empty texts have no words and go; very long texts are counted and scored whole; repeated rows fare alike, null ids
    too; no row in, no row out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        verdicts = judge(shared.value, threshold)
        for batch in batches:
            yield batch.filter(pa.array(verdicts(batch.column(text_col))[2]))
        _seen.clear()  # the worker goes on to other stages

    return docs.mapInArrow(run, docs.schema)
