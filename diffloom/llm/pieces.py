"""SentencePiece encoding by sampling: forward filtering, backward sampling over the lattice of pieces.

A segmentation has a probability in proportion to exp(sharpness * sum of piece scores). Forward filtering sums, for every
place of a segment, the weights of all ways to reach it; backward sampling walks from the end and draws each piece
by its share. The draws are functions of the row key, the segment's number in the row and the step, so a row always
gets the same pieces, whatever its batch or partition. No piece goes on after a space or across a line end, so the
lattice of a text is the chain of its segments' lattices; equal segments of a batch share one.

Decoding is lossless: bytes without a piece become byte pieces, and a literal U+2581 is spelt with its three byte pieces.
"""

from __future__ import annotations

import os
import re
from collections import defaultdict
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diffloom.llm.common import SEED, offsets, text_slices

MODEL = os.environ.get("DIFFLOOM_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
SHARPNESS = 1e-3
#: Characters of the texts whose lattices are in memory at once; a longer text stands alone.
SLICE = 1 << 18
_MARK = "▁".encode()
#: Stands for a literal U+2581 in a lattice; no UTF-8 text holds this byte.
_LITERAL = b"\xfe"
_SEGMENT = re.compile(rb" +[^ \n]*|[^ \n]+|\n")


class Vocabulary:
    """Pieces as a byte trie: `child` for nodes with children, `piece` for all; `score` and bytes by piece id."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        special = {i for i in range(n) if model.is_unknown(i) or model.is_control(i) or model.is_byte(i)}
        names = {i: model.id_to_piece(i).encode() for i in range(n)}
        pieces = {names[i]: i for i in range(n) if i not in special}
        if any(_MARK in p.lstrip(_MARK) and not p.startswith(_MARK) or b"\n" in p for p in pieces):
            raise ValueError("a piece goes across a space or line end")
        self.byte = np.zeros(256, np.int32)
        for i in range(n):
            if model.is_byte(i):
                self.byte[int(names[i][3:5], 16)] = i
        self.score = np.array([model.get_score(i) for i in range(n)])
        # byte pieces and the runs of spaces that the model's maker added count as the rarest learnt piece
        low = min((x for i in pieces.values() if (x := model.get_score(i)) > -1e8), default=0.0)
        self.score[self.byte] = low
        self.score = np.maximum(self.score, low)
        prefixes = {p[:k] for p in pieces for k in range(len(p))}
        number = {p: i for i, p in enumerate(sorted(prefixes))}  # the empty prefix is 0
        for p in sorted(pieces):
            number.setdefault(p, len(number))
        self.child = np.zeros((len(prefixes), 256), np.int32)
        self.piece = np.full(len(number), -1, np.int32)
        for p, i in number.items():
            if p:
                self.child[number[p[:-1]], p[-1]] = i
            self.piece[i] = pieces.get(p, -1)
        self.inner = len(prefixes)
        self.text = [b""] * n
        for p, i in pieces.items():
            self.text[i] = p.replace(_MARK, b" ")
        for b, i in enumerate(self.byte):
            self.text[i] = bytes([b])


@cache
def vocabulary(path: str = MODEL) -> Vocabulary:
    return Vocabulary(path)


def _mix(x: np.ndarray) -> np.ndarray:
    """Uniform numbers in [0, 1) from 64-bit counters."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53


class Lattice:
    """Forward-filtered lattices of distinct segments, longest first. Places are numbered level by level (bytes from the begin)."""

    def __init__(self, segments: list[bytes], vocab: Vocabulary, sharpness: float):
        size = np.fromiter(map(len, segments), np.int64, len(segments))
        order = np.argsort(-size, kind="stable")
        self.row = np.empty(len(size), np.int64)
        self.row[order] = np.arange(len(size))
        size = size[order]
        self.size = size
        steps = int(size[0])
        wide = np.searchsorted(-size, -np.arange(steps + 1), side="right")  # segments that have a place at level t
        self.base = offsets(wide)
        begin = offsets(size)[:-1]
        data = np.frombuffer(b"".join(segments[i] for i in order) + b"\0" * 64, np.uint8)
        total = int(size.sum())
        seg = np.repeat(np.arange(len(size)), size)
        level = np.arange(total) - begin[seg]
        left = size[seg] - level
        first = np.flatnonzero((data[:total] & 0xC0) != 0x80)  # places between characters
        chars = np.diff(np.r_[first, total])
        chars = np.minimum(chars, left[first])
        sources, targets, ids = [], [], []

        def add(at, k, piece):
            sources.append(self.base[level[at]] + seg[at])
            targets.append(self.base[level[at] + k] + seg[at])
            ids.append(piece)

        at, node = first, np.zeros(len(first), np.int32)
        whole = np.zeros(total, bool)
        for k in range(1, 65):
            node = vocab.child[node, data[at + (k - 1)]]
            live = (node > 0) & (left[at] >= k)
            at, node = at[live], node[live]
            piece = vocab.piece[node]
            hit = piece >= 0
            if hit.any():
                add(at[hit], k, piece[hit])
            more = node < vocab.inner
            if k <= 4:
                own = at[hit]
                whole[own[np.isin(own, first[chars == k], assume_unique=True)]] = True
            at, node = at[more], node[more]
            if not len(at):
                break
        bare = first[~whole[first]]
        if len(bare):
            width = chars[~whole[first]]
            each = np.repeat(bare, width) + (np.arange(width.sum()) - np.repeat(offsets(width)[:-1], width))
            add(each, 1, vocab.byte[data[each]])
        source, target, piece = (np.concatenate(x) for x in (sources, targets, ids))
        by = np.argsort(target, kind="stable")
        self.source, target, self.piece = source[by], target[by], piece[by]
        weight = vocab.score[self.piece] * sharpness
        places = int(self.base[-1])
        self.first = np.searchsorted(target, np.arange(places + 1))
        forward = np.full(places, -np.inf)
        forward[: wide[0]] = 0.0
        self.share = np.zeros(len(target))
        cuts = self.first[self.base]
        for t in range(1, steps + 1):
            a, b = cuts[t], cuts[t + 1]
            if a == b:
                continue
            value = forward[self.source[a:b]] + weight[a:b]
            head = np.flatnonzero(np.r_[True, target[a + 1 : b] != target[a : b - 1]])
            many = np.diff(np.r_[head, b - a])
            top = np.maximum.reduceat(value, head)
            top[np.isinf(top)] = 0.0
            part = np.exp(value - np.repeat(top, many))
            sums = np.add.reduceat(part, head)
            with np.errstate(divide="ignore", invalid="ignore"):
                forward[target[a:b][head]] = top + np.log(sums)
                part /= np.repeat(sums, many)
            run = np.cumsum(np.nan_to_num(part))
            self.share[a:b] = run - np.repeat(run[head] - np.nan_to_num(part)[head], many)

    def sample(self, which: np.ndarray, counter: np.ndarray):
        """Pieces of segments `which`, drawn with the numbers that `counter` starts: (ids, pieces of each)."""
        row = self.row[which]
        place = self.base[self.size[row]] + row
        live = np.arange(len(which))
        n = np.zeros(len(which), np.int64)
        drawn = []
        step = 0
        start = self.base[1]
        while len(live):
            u = _mix(counter[live] + np.uint64(step * 0xD1B54A32D192ED03 % (1 << 64)))
            e, last = self.first[place], self.first[place + 1] - 1
            ahead = np.flatnonzero((u >= self.share[e]) & (e < last))
            while len(ahead):
                e[ahead] += 1
                ahead = ahead[(u[ahead] >= self.share[e[ahead]]) & (e[ahead] < last[ahead])]
            drawn.append((live, self.piece[e]))
            n[live] += 1
            place = self.source[e]
            go = place >= start
            live, place = live[go], place[go]
            step += 1
        end = offsets(n)
        out = np.empty(int(end[-1]), np.int32)
        for k, (who, piece) in enumerate(drawn):
            out[end[who + 1] - 1 - k] = piece
        return out, n


def encode(keys: list[str], texts: list[str | None], vocab: Vocabulary, sharpness: float = SHARPNESS) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, ids of each text)."""
    known: defaultdict = defaultdict(count().__next__)
    which, many = [], []
    for t in texts:
        s = _SEGMENT.findall(b" " + t.encode("utf-8", "surrogatepass").replace(_MARK, _LITERAL)) if t else []
        which.append(np.fromiter(map(known.__getitem__, s), np.int64, len(s)))
        many.append(len(s))
    at = offsets(many)
    if not at[-1]:
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    seed = np.array([xxhash.xxh64_intdigest(k.encode(), SEED) for k in keys], np.uint64)
    place = np.arange(at[-1]) - np.repeat(at[:-1], many)
    counter = np.repeat(seed, many) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    lattice = Lattice([s.replace(b" ", _MARK) for s in known], vocab, sharpness)
    ids, n = lattice.sample(np.concatenate(which), counter)
    each = np.add.reduceat(np.r_[n, 0], np.minimum(at[:-1], len(n))) if len(n) else np.zeros(len(texts), np.int64)
    each[np.array(many) == 0] = 0
    literal = ids == vocab.byte[_LITERAL[0]]
    if literal.any():
        owner = np.repeat(np.arange(len(texts)), each)
        each = each + 2 * np.bincount(owner[literal], minlength=len(texts))
        times = np.where(literal, 3, 1)
        wide = np.repeat(ids, times)
        wide[np.repeat(literal, times)] = np.tile(vocab.byte[np.frombuffer(_MARK, np.uint8)], int(literal.sum()))
        ids = wide
    return ids, each


def decode(ids, vocab: Vocabulary) -> str:
    """The text of pieces: their bytes without the leading space that encoding put before the text."""
    return b"".join(map(vocab.text.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")


def encode_pieces(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", model: str = MODEL, sharpness: float = SHARPNESS, check: bool = True) -> DataFrame:
    """doc_id, n_bytes, pieces (array of ids), lossless (decoding gave the text again; null without check).

    Null and empty texts have no pieces and are lossless; repeated rows get the same pieces; rows with a null key are
    drawn with the empty key; extra columns are ignored; no row in, no row out.
    """
    rows = docs.select(F.col(key_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        vocab = vocabulary(model)
        for batch in batches:
            keys = ["" if k is None else str(k) for k in batch.column("doc_id").to_pylist()]
            for start, texts in text_slices(batch.column("text"), SLICE):
                ids, many = encode(keys[start : start + len(texts)], texts, vocab, sharpness)
                at = offsets(many).tolist()
                flat = ids.tolist() if check else []
                same = [decode(flat[at[i] : at[i + 1]], vocab) == (t or "") for i, t in enumerate(texts)] if check else [None] * len(texts)
                size = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
                pieces = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(texts)), pa.array(size, pa.int64()), pieces, pa.array(same, pa.bool_())], names=["doc_id", "n_bytes", "pieces", "lossless"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, pieces array<int>, lossless boolean")


def decode_pieces(df: DataFrame, pieces_col: str = "pieces", model: str = MODEL) -> DataFrame:
    """df with a column `decoded` in place of any of that name; null pieces decode to null, none to the empty text.

    Repeated rows decode alike, very long ones whole; no row in, no row out.
    """
    schema = T.StructType([*[f for f in df.schema.fields if f.name != "decoded"], T.StructField("decoded", T.StringType())])

    def run(batches):
        vocab = vocabulary(model)
        for batch in batches:
            texts = [None if p is None else decode(p, vocab) for p in batch.column(pieces_col).to_pylist()]
            keep = [n for n in batch.schema.names if n != "decoded"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(texts, pa.string())], names=[*keep, "decoded"])

    return df.mapInArrow(run, schema)
