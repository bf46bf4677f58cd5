"""Language-model scoring with a weighted backoff automaton over n-grams (trigrams by default).

Model: p(w) = (c(w)+1) / (N+V+1), the last share for words never seen; p(w|h) = (c(hw) + K p(w|h')) / (c(h)+K), where h' is h without
its first word: Dirichlet smoothing, which sums to one for every history. As an automaton: each seen history of up to
ORDER - 1 words (the begin of a text counts as a word) is a state; a seen n-gram hw is an arc from h with weight log10 p(w|h);
the failure arc of h leads to h' with weight log10(K / (c(h)+K)), and so on down to the root, which has an arc for every word. After
an arc the state is the longest seen history that ends in the word. One pass from left to right carries the state and adds up
the weights.

No node holds the whole model. Texts are gathered into chunks; a chunk asks for the counts of its own distinct words and
n-grams, in slices by hash range; each slice is summed over all chunks, and the chunk gets the totals back and builds the part of
the automaton that its texts can reach. Words are counted as strings; n-grams by hashes of HASH_BITS more bits than the number of tokens
has, so that an n-gram shares its count with another one with a probability of 2^-HASH_BITS.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffloom.llm.common import SEED, lower_words, offsets, saved

ORDER = 3
#: Tokens of a chunk; a longer text is a chunk of its own.
CHUNK = 1_000_000
#: Characters of input for each hash range.
SLICE_CHARS = 16_000_000
#: K, the weight of the shorter history within a history.
PRIOR = 60.0
HASH_BITS = 20
#: Tokens that a text is walked by at a time; short, so that many stretches step together.
STRETCH = 256
#: Stand-ins for the begin and end of a text (no word holds these bytes).
BEGIN, END = b"\r", b"\n"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def is_held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def _pack(a: np.ndarray) -> bytes:
    """Compressed with like bytes side by side."""
    return zstandard.compress(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes(), 3) if len(a) else b""


def _unpack(data: bytes, dtype) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype)
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel()


class Grams:
    """The distinct n-grams of some texts, for n from 2 to `order`.

    keys: their hashes (of `bits` bits), sorted. place[n][t]: which distinct n-gram ends at token t (-1: the text begins later than
    that). at[n]: the key of each; last[n], rest[n], history[n]: its last word, its place among the (n-1)-grams without
    its first word, and among those without its last.
    """

    def __init__(self, stream: np.ndarray, at: np.ndarray, hashes: np.ndarray, order: int, bits: int):
        v = len(hashes)
        first = np.zeros(len(stream), bool)
        first[at[:-1]] = True
        self.place, self.last, self.rest, self.history = {1: stream}, {}, {}, {}
        own, every = {1: hashes}, []
        for k in range(2, order + 1):
            before = np.empty(len(stream), np.int64)
            before[1:] = self.place[k - 1][:-1]
            before[first] = 0 if k == 2 else -1  # the word before a text's first is BEGIN, word 0
            ok = np.flatnonzero(before >= 0).astype(np.int32)
            distinct, where, back = np.unique(before[ok] * v + stream[ok], return_index=True, return_inverse=True)
            place = np.full(len(stream), -1, np.int32)
            place[ok] = back
            self.place[k], self.last[k], self.history[k] = place, (distinct % v).astype(np.int32), (distinct // v).astype(np.int32)
            self.rest[k] = self.place[k - 1][ok[where]]
            del before, distinct, where, back
            h = own[k - 1][self.history[k]]
            key = (h * _MIX) ^ (hashes[self.last[k]] + (h << np.uint64(29)))
            own[k] = (key ^ (key >> np.uint64(32))) * _MIX
            every.append(own[k] ^ (own[k] >> np.uint64(29)))
        self.keys, inverse = np.unique(np.concatenate(every) >> np.uint64(64 - bits), return_inverse=True)
        inverse = inverse.astype(np.int32)
        cut = offsets([len(x) for x in every])
        self.at = {k: inverse[cut[k - 2] : cut[k - 1]] for k in range(2, order + 1)}

    def counts(self, tokens: np.ndarray) -> np.ndarray:
        """How often each key ends at one of the tokens (a mask)."""
        out = np.zeros(len(self.keys), np.int64)
        for k, at in self.at.items():
            own = self.place[k][tokens]
            out += np.bincount(at[own[own >= 0]], minlength=len(out))
        return out.astype(np.int32)


def _ranges(keys: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bounds of n equal ranges in sorted keys of so many bits."""
    edges = np.array([(i << bits) // n for i in range(1, n)], np.uint64) if n > 1 else np.zeros(0, np.uint64)
    return np.r_[0, np.searchsorted(keys, edges), len(keys)]


BODY = "chunk string, ids array<{}>, held array<boolean>, sizes array<int>, stream binary, words binary"


def _chunks(batches, id_type: pa.DataType):
    """A row for each chunk: its rows' ids, their tokens as numbers, and the words by number (0 and 1: BEGIN and END; then by hash)."""
    part, seq = (TaskContext.get().partitionId() if TaskContext.get() else 0), 0
    ids, held, sizes, toks = [], [], [], []
    fresh = lambda: defaultdict(count(2).__next__, {BEGIN: 0, END: 1})
    known, total = fresh(), 0
    schema = pa.schema([("chunk", pa.string()), ("ids", pa.list_(id_type)), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())), ("stream", pa.binary()), ("words", pa.binary())])

    def row():
        words = list(known)
        order = np.r_[0, 1, 2 + np.argsort(_hashes(words)[2:], kind="stable")]
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        values = [f"{part}-{seq}", ids, held, sizes, _pack(rank[np.concatenate(toks)]), zstandard.compress(b" ".join(words[i] for i in order), 3)]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            w = lower_words(text.as_py())
            if ids and total + len(w) > CHUNK:
                yield row()
                seq, total, ids, held, sizes, toks, known = seq + 1, 0, [], [], [], [], fresh()
            ids.append(doc_id)
            held.append(is_held_out(doc_id))
            sizes.append(len(w) + 1)
            toks.append(np.fromiter(map(known.__getitem__, w), np.int32, len(w)))
            toks.append(np.ones(1, np.int32))
            total += len(w) + 1
    if ids:
        yield row()


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w, SEED) for w in words], np.uint64)


class Body:
    """A chunk as read back."""

    def __init__(self, stream: bytes, sizes, held, words: bytes):
        self.stream, self.sizes = _unpack(stream, np.int32), np.array(sizes, np.int64)
        self.words = zstandard.decompress(words).split(b" ")
        self.hashes, self.at = _hashes(self.words), offsets(self.sizes)
        self.held = np.array(held, bool)
        self.trains = ~np.repeat(self.held, self.sizes)

    def word_counts(self) -> np.ndarray:
        """BEGIN's count is the number of texts."""
        n = np.bincount(self.stream[self.trains], minlength=len(self.words)).astype(np.int32)
        n[0] = np.count_nonzero(~self.held)
        return n

    def grams(self, order: int, bits: int) -> Grams:
        return Grams(self.stream, self.at, self.hashes, order, bits)


def _bodies(batches):
    for batch in batches:
        for chunk, sizes, held, stream, words in zip(*(batch.column(c).to_pylist() for c in ("chunk", "sizes", "held", "stream", "words")), strict=True):
            yield chunk, Body(stream, sizes, held, words)


ASKED = "chunk string, slice int, keys binary, counts binary"
TOTALS = "chunk string, slice int, totals binary, tokens long, types long"


def _asked(chunk: str, rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([chunk] * len(rows)), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["chunk", "slice", "keys", "counts"])


def _ask_words(batches, n_slices: int):
    for chunk, body in _bodies(batches):
        n, cuts = body.word_counts(), _ranges(body.hashes[2:], n_slices, 64) + 2
        cuts[0] = 0  # BEGIN and END go with the first slice
        rows = [(s, b" ".join(body.words[a:b]), n[a:b]) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
        yield _asked(chunk, [(s, zstandard.compress(k, 1), _pack(c)) for s, k, c in rows])


def _ask_grams(batches, n_slices: int, order: int, bits: int):
    for chunk, body in _bodies(batches):
        grams = body.grams(order, bits)
        n, cuts = grams.counts(body.trains), _ranges(grams.keys, n_slices, bits)
        for lo in range(0, n_slices, 64):
            spans = [(s, cuts[s], cuts[s + 1]) for s in range(lo, min(lo + 64, n_slices)) if cuts[s] < cuts[s + 1]]
            if spans:
                yield _asked(chunk, [(s, _pack(np.diff(grams.keys[a:b], prepend=np.uint64(0))), _pack(n[a:b])) for s, a, b in spans])


def _answered(group: pa.Table, place: list[np.ndarray], total: np.ndarray, tokens: int, types: int) -> pa.Table:
    """The totals of a slice, given to each chunk in its own order, and one row of sums."""
    n = group.num_rows
    return pa.table(
        {
            "chunk": pa.array([*group.column("chunk").to_pylist(), None], pa.string()),
            "slice": pa.array([group.column("slice")[0].as_py()] * (n + 1), pa.int32()),
            "totals": pa.array([*(_pack(total[p]) for p in place), None], pa.binary()),
            "tokens": pa.array([*[0] * n, tokens], pa.int64()),
            "types": pa.array([*[0] * n, types], pa.int64()),
        }
    )


def _total_words(group: pa.Table) -> pa.Table:
    counts = [_unpack(c.as_py(), np.int32) for c in group.column("counts")]
    seen: defaultdict = defaultdict(count().__next__)
    place = [np.fromiter(map(seen.__getitem__, zstandard.decompress(k.as_py()).split(b" ")), np.int64, len(c)) for k, c in zip(group.column("keys"), counts, strict=True)]
    total = np.bincount(np.concatenate(place), weights=np.concatenate(counts), minlength=len(seen)).astype(np.int64)
    own = total.copy()
    if BEGIN in seen:
        own[seen[BEGIN]] = 0
    return _answered(group, place, total, int(own.sum()), int((own > 0).sum()))


def _total_grams(group: pa.Table) -> pa.Table:
    keys = [np.cumsum(_unpack(k.as_py(), np.uint64), dtype=np.uint64) for k in group.column("keys")]
    every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate([_unpack(c.as_py(), np.int32) for c in group.column("counts")]), minlength=len(every)).astype(np.int64)
    at = offsets([len(k) for k in keys])
    return _answered(group, [inverse[at[i] : at[i + 1]] for i in range(len(keys))], total, 0, 0)


class Automaton:
    """The part of the model that a chunk reaches. States: -1 is the root, then the words, then the longer histories, level by level."""

    def __init__(self, grams: Grams, word: np.ndarray, found: np.ndarray, n: int, v: int, order: int = ORDER, prior: float = PRIOR):
        self.order = order
        self.root = np.log10((word + 1) / (n + v + 1))  # its arcs: the base model
        seen = {1: word, **{k: found[grams.at[k]] for k in grams.at}}
        p = {1: 10.0**self.root}
        self.arc, self.has, self.failure = {}, {}, {}
        for k in range(2, order + 1):
            history = seen[k - 1][grams.history[k]]
            p[k] = (seen[k] + prior * p[k - 1][grams.rest[k]]) / (history + prior)
            self.arc[k], self.has[k] = np.log10(p[k]), np.r_[seen[k] > 0, False]  # the last one: place -1
            self.failure[k - 1] = np.log10(prior / (seen[k - 1] + prior))
        self.known, self.grams = word > 0, grams

    def _after(self, token: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words, place) of the longest seen history that ends in each token: the state that an arc, or the root's, leads to."""
        length, state = self.known[w].astype(np.int64), w.astype(np.int64)
        for k in range(2, self.order):
            g = self.grams.place[k][token]
            up = self.has[k][g]
            length[up], state[up] = k, g[up]
        return length, state

    def traverse(self, stream: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Log10 probability of each text: all texts take a step at a time, each with its own state (words of its history, which).

        A text of more than STRETCH tokens is walked in stretches, each from the state that the one before it ends in.
        """
        upto = offsets(sizes)
        stretches = -(-sizes // STRETCH)
        first = offsets(stretches)
        at = np.repeat(upto[:-1], stretches) + STRETCH * (np.arange(first[-1]) - np.repeat(first[:-1], stretches))
        length, state = self._after(at - 1, stream[at - 1])
        length[first[:-1]], state[first[:-1]] = int(self.known[0]), 0  # BEGIN, if any text was learnt from
        size = np.minimum(STRETCH, np.repeat(upto[1:], stretches) - at)
        order = np.argsort(-size, kind="stable")
        at, size, length, state = at[order], size[order], length[order], state[order]
        steps = int(size[0]) if len(size) else 0
        live = np.searchsorted(-size, -np.arange(steps), side="left")
        score = np.zeros(len(size))
        place, rest = self.grams.place, self.grams.rest
        for t in range(steps):
            m = live[t]
            token = at[:m] + t
            w = stream[token]
            n, s, gain = length[:m].copy(), state[:m].copy(), np.zeros(m)
            on = np.arange(m)
            for k in range(self.order, 1, -1):  # down the failure arcs, until a state has an arc for the word
                here = on[n[on] == k - 1]
                g = place[k][token[here]]
                hit = self.has[k][g]
                gain[here] += np.where(hit, self.arc[k][g], self.failure[k - 1][s[here]])
                n[here] = np.where(hit, -1, k - 2)
                if k > 2:
                    down = here[~hit]
                    s[down] = rest[k - 1][s[down]]
            here = np.flatnonzero(n == 0)
            gain[here] += self.root[w[here]]
            score[:m] += gain
            length[:m], state[:m] = self._after(token, w)
        out = np.empty(len(size))
        out[order] = score
        return np.add.reduceat(out, first[:-1]) if len(sizes) else out


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, prior: float = PRIOR) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs.

    Learns from the rows whose crc32(id as text) mod 7 is not 2 (a null id counts as the empty text). Null and empty
    texts hold the end token alone; a very long text is a chunk of its own, scored whole; repeated rows are counted and scored each on its
    own; extra columns are ignored; no row in, no row out; with nothing to learn from, N and V are 0 and every token has
    probability one.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)
    chars = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_slices = max(least, chars * (order - 1) // SLICE_CHARS)
    bodies = saved(rows.mapInArrow(lambda b: _chunks(b, arrow), BODY.format(kind.simpleString())), "lm-chunks")
    made = bodies.agg(F.count("*"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    n_chunks, bits = max(least, made[0]), min(64, (made[1] or 0).bit_length() + HASH_BITS)
    word_slices = max(least, n_slices // 8)
    asked = bodies.mapInArrow(lambda b: _ask_words(b, word_slices), ASKED).repartition(word_slices, "slice")
    words = saved(asked.groupBy("slice").applyInArrow(_total_words, TOTALS), "lm-words")
    sums = words.where("chunk IS NULL").agg(F.sum("tokens"), F.sum("types")).first()
    n, v = sums[0] or 0, sums[1] or 0
    asked = bodies.mapInArrow(lambda b: _ask_grams(b, n_slices, order, bits), ASKED).repartition(n_slices, "slice")
    grams = asked.groupBy("slice").applyInArrow(_total_grams, TOTALS)
    found = words.withColumn("kind", F.lit("word")).unionByName(grams.withColumn("kind", F.lit("gram"))).where("chunk IS NOT NULL").select("chunk", "kind", "slice", "totals")
    out = pa.schema([("doc_id", arrow), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def score(body: pa.Table, found: pa.Table) -> pa.Table:
        if not body.num_rows:
            return out.empty_table()
        got = sorted(zip(found.column("kind").to_pylist(), found.column("slice").to_pylist(), range(found.num_rows), strict=True))
        counts = {k: np.concatenate([np.zeros(0, np.int64), *(_unpack(found.column("totals")[i].as_py(), np.int64) for q, _, i in got if q == k)]) for k in ("word", "gram")}
        held = body.column("held")[0]
        own = Body(body.column("stream")[0].as_py(), body.column("sizes")[0].as_py(), held.as_py(), body.column("words")[0].as_py())
        model = Automaton(own.grams(order, bits), counts["word"], counts["gram"], n, v, order, prior)
        known = np.add.reduceat((counts["word"] > 0)[own.stream].astype(np.int64), own.at[:-1])
        base = np.add.reduceat(model.root[own.stream], own.at[:-1])
        return pa.table([body.column("ids")[0].values, held.values, pa.array(own.sizes), pa.array(known), pa.array(np.full(len(own.sizes), n)), pa.array(base), pa.array(model.traverse(own.stream, own.sizes))], schema=out)

    left, right = bodies.repartition(n_chunks, "chunk"), found.repartition(n_chunks, "chunk")
    return left.groupBy("chunk").cogroup(right.groupBy("chunk")).applyInArrow(score, f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
