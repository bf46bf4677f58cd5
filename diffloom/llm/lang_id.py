"""Language identification with bit-sliced Bloom filters of character trigrams.

Each language owns one bit of a word; slot i of the table holds, for all languages at once, whether their filter has
bit i. The AND of a trigram's slots is the mask of the languages whose filter holds it. A text counts the trigrams
found for each language, less the false positives that the filter's fill leads one to expect, and the largest count
decides.

A trigram belongs to a language's filter if its share of the language's trigrams, one sighting left out, is MIN_RATE or
more, so a filter holds 1 / MIN_RATE trigrams at most, whatever the corpus. The sighting left out tells nothing in a large
corpus; in a language value of a single document it keeps most of the text's rare trigrams from passing for common ones.

Rarer trigrams belong to no filter. On 10,000 documents (2,499 held out) that costs nothing: 1.0000 of the held-out texts get
their language at 1e-3 and 1e-4, 0.9996 at 1e-5, 0.9976 at 1e-6 and 0.9896 with every trigram that was ever seen
(`learn(min_rate=0)`), since a filter then holds every foreign word of its language's texts.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffloom.llm.common import offsets, text_slices

MIN_RATE = 1e-4
HASHES = 3
#: The pipeline keeps documents whose language has hits for this share of the trigrams. The score is no measure of that: it
#: is a share of all languages' hits and sinks with each language, so it only tells languages apart.
MIN_HITS = 0.2
#: More values of lang than this are no languages: `learn` raises, since the filters of all go to every task.
MOST_LANGUAGES = 1024


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes of the trigrams around a letter, non-letters being one mark; the texts' offsets in them; letters of each text)."""
    low = [(t or "").lower() for t in texts]
    cp = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    v = np.where(_letters()[cp], cp, 0).astype(np.uint64)
    pad = np.zeros(len(v) + 2, np.uint64)
    pad[1:-1] = v
    code = (pad[:-2] << np.uint64(42)) | (v << np.uint64(21)) | pad[2:]
    at = offsets([len(t) + 1 for t in low])
    good = (v != 0) & ((pad[:-2] != 0) | (pad[2:] != 0))
    where = np.flatnonzero(good)
    letters = np.add.reduceat(v != 0, at[:-1], dtype=np.int64)
    return code[where], np.searchsorted(where, at), letters


def _slots(code: np.ndarray, bits: int) -> list[np.ndarray]:
    h = code * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    mask = np.uint64((1 << bits) - 1)
    return [((h >> np.uint64(21 * i)) & mask).astype(np.int64) for i in range(HASHES)]


@dataclass
class Filters:
    languages: list[str]
    bits: int
    table: np.ndarray  # slots x words of 64 languages
    false_rate: np.ndarray
    common: int = 0  # the language with most trigrams, for texts without a hit

    def hits(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Texts x languages: trigrams found."""
        n, out = len(at) - 1, np.zeros((len(at) - 1, len(self.languages)), np.int64)
        if not len(code) or not len(self.languages):
            return out
        slots = _slots(code, self.bits)
        full = np.flatnonzero(at[1:] > at[:-1])
        for w in range(self.table.shape[1]):
            column = self.table[:, w]
            mask = column[slots[0]] & column[slots[1]] & column[slots[2]]
            for k in range(w * 64, min(len(self.languages), w * 64 + 64)):
                bit = ((mask >> np.uint64(k % 64)) & np.uint64(1)).astype(np.uint8)
                out[full, k] = np.add.reduceat(bit, at[full], dtype=np.int64) if len(full) else 0
        return out[:n]

    def decide(self, texts: list[str | None]):
        """(language or und, score, share of trigrams found) of each text."""
        code, at, letters = trigrams(texts)
        n = np.maximum(1, np.diff(at))[:, None]
        real = np.maximum(0, (self.hits(code, at) - n * self.false_rate) / (1 - self.false_rate)) if len(self.languages) else np.zeros((len(texts), 0))
        total = real.sum(1)
        best = np.where(total > 0, real.argmax(1), self.common) if len(self.languages) else np.zeros(len(texts), int)
        top = real.max(1, initial=0)
        names = [self.languages[b] if k and len(self.languages) else "und" for b, k in zip(best, letters, strict=True)]
        score = np.where((total > 0) & (letters > 0), top / np.maximum(total, 1e-12), 0.0)
        return names, score, np.minimum(1, top / n[:, 0])


def is_held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 4 == 2


def build(grams: list[tuple[str, int]], languages: list[str], common: int = 0) -> Filters:
    """The bit-sliced table of (language, trigram) members; its size follows the largest filter, 16 slots a member."""
    number = {x: i for i, x in enumerate(languages)}
    lang = np.array([number[x] for x, _ in grams], np.int64)
    code = np.array([g for _, g in grams], np.int64).astype(np.uint64)
    most = int(np.bincount(lang, minlength=1).max()) if len(lang) else 1
    bits = max(10, (16 * most - 1).bit_length())
    table = np.zeros((1 << bits, max(1, -(-len(languages) // 64))), np.uint64)
    for s in _slots(code, bits):
        np.bitwise_or.at(table, (s, lang // 64), np.uint64(1) << (lang % 64).astype(np.uint64))
    fill = np.array([float(((table[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean()) for k in range(len(languages))])
    return Filters(languages, bits, table, np.minimum(fill**HASHES, 0.99), common)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_rate: float = MIN_RATE, most_languages: int = MOST_LANGUAGES) -> Filters:
    """Filters from all rows with text, language and a training id. Trigrams are counted over the whole corpus; only those
    over min_rate, 1 / min_rate for each language at most, come to the driver, for most_languages languages at most (more raise).

    Rows with a null text or language teach nothing; very long texts are counted whole, repeated rows each on its own; a null id counts
    as the empty text; extra columns are ignored; an empty table teaches nothing.
    """
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4)) != 2))
    rows = rows.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))

    def count(batches):
        sums: dict[str, tuple] = {}
        for batch in batches:
            lang = np.array(batch.column("lang").to_pylist(), object)
            for start, texts in text_slices(batch.column("text")):
                code, at, _ = trigrams(texts)
                for x in set(lang[start : start + len(texts)]):
                    own = np.flatnonzero(lang[start : start + len(texts)] == x)
                    c, n = np.unique(np.concatenate([code[at[i] : at[i + 1]] for i in own]), return_counts=True)
                    if x in sums:
                        c, back = np.unique(np.concatenate([sums[x][0], c]), return_inverse=True)
                        n = np.bincount(back, weights=np.concatenate([sums[x][1], n]), minlength=len(c)).astype(np.int64)
                    sums[x] = c, n
        for x, (c, n) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(c), pa.string()), pa.array(c.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    if len(total.limit(most_languages + 1).select("lang").collect()) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    members = counts.join(total, "lang").where(F.col("n") - 1 >= F.col("total") * min_rate).select("lang", "gram", "total").collect()
    size = {r.lang: r.total for r in members}
    languages = sorted(size)
    return build([(r.lang, r.gram) for r in members], languages, max(range(len(languages)), key=lambda i: size[languages[i]], default=0))


def predict(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, hit_rate of each row of docs.

    Null texts and texts without a letter are `und` with score 0; a text with letters but no hit gets the most common
    language with score 0; ties go to the first language by name; with nothing learnt all are `und`. Repeated rows are
    judged each on its own; extra columns are ignored; no row in, no row out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # 16 slots for each of 1 / MIN_RATE trigrams at most
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            names, score, rate = [], [], []
            for _, texts in text_slices(batch.column("text")):
                a, b, c = shared.value.decide(texts)
                names += a
                score += b.tolist()
                rate += c.tolist()
            held = [is_held_out(i) for i in batch.column("doc_id").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(held, pa.bool_()), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score", "hit_rate"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, hit_rate double")


def keep_known(docs: DataFrame, filters: Filters, text_col: str = "text", min_hits: float = MIN_HITS) -> DataFrame:
    """docs without the rows whose text is in no learnt language, however many languages are learnt; all columns stay.

    Null texts and texts without a letter go; very long texts are judged by all of their trigrams; repeated rows are judged alike; no row
    in, no row out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        for batch in batches:
            keep: list[bool] = []
            for _, texts in text_slices(batch.column(text_col)):
                names, _, rate = shared.value.decide(texts)
                keep += [x != "und" and r >= min_hits for x, r in zip(names, rate, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
