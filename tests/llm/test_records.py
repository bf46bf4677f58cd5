"""WARC archive, chat formatting, decontamination and the pipeline."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from diffloom.llm import chat_format, common, decontam, warc_archive
from tests.llm.helpers import ODD, documents, frame, prose

BIG = "<p>" + "é" * 80


def test_archive_round_trip(spark):
    rows = [(3, "u3", BIG), (1, "u1", BIG), (2, "u\r\n2", "small"), (4, "u4", "small"), (5, None, None), (6, "u6", BIG + "x"), (1, "u1", BIG), (None, "n", BIG), (7, "u7", "a\r\n\r\nWARC/1.1\r\n" * 20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x")).withColumn("owner", F.lit(1)).withColumn("payload", F.lit(2))
    records = warc_archive.read_records(spark, *warc_archive.write_archive(df))
    got = warc_archive.describe(records).collect()
    assert len(got) == len(rows)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append((r.payload_bytes, r.payload_digest, r.record_type, r.refers_to))
    assert by[3] == [(163, sha(BIG), "revisit", 1)] and by[1] == [(163, sha(BIG), "response", None)] * 2
    assert by[2] == by[4] == [(5, sha("small"), "response", None)] and by[5] == [(0, sha(""), "response", None)]
    assert by[None] == [(163, sha(BIG), "revisit", 1)]
    blobs = [bytes(r.record) for r in records.collect()]
    for b in blobs:
        head, body = b.split(b"\r\n\r\n", 1)
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert body.endswith(b"\r\n\r\n") and len(body) - 4 == int(fields["Content-Length"])
    assert sum(b"WARC-Type: revisit" in b for b in blobs) == 2


def test_archive_of_string_ids_and_long_payloads(spark):
    long = "<p>é</p>" * 40_000
    rows = [("b/2", "u", long), ("a 1", "u", long), ("c", "u", "")]
    where = warc_archive.write_archive(spark.createDataFrame(rows, "page_id string, url string, html string"))
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc_archive.describe(warc_archive.read_records(spark, *where), "string").collect()}
    assert got == {"a 1": (360_000, "response", None), "b/2": (360_000, "revisit", "a 1"), "c": (0, "response", None)}
    warc_archive.drop_archive(spark, *where)
    assert not spark.catalog.tableExists(where[0])


def test_archive_checks_payloads_and_bears_no_rows(spark):
    df = spark.createDataFrame([(1, "u", BIG)], "page_id long, url string, html string")
    name, heads = warc_archive.write_archive(df)
    spark.table(name).withColumn("payload", F.lit(b"forged")).write.saveAsTable(name + "_bad")
    with pytest.raises(Exception, match="bad payload"):
        warc_archive.describe(warc_archive.read_records(spark, name + "_bad", heads)).collect()
    assert warc_archive.describe(warc_archive.read_records(spark, *warc_archive.write_archive(df.limit(0)))).count() == 0


def test_archive_without_a_payload_raises_and_ids_may_be_odd(spark):
    rows = [("", "u", BIG), ("null", "u", BIG), (None, "u", BIG), ("x?y", "u", "other")]
    name, heads = warc_archive.write_archive(spark.createDataFrame(rows, "page_id string, url string, html string"), date="2020-02-03T04:05:06Z")
    records = warc_archive.read_records(spark, name, heads)
    got = sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in warc_archive.describe(records, "string").collect())
    assert got == [("", "response", "None"), ("None", "revisit", ""), ("null", "revisit", ""), ("x?y", "response", "None")]
    assert all(b"\r\nWARC-Date: 2020-02-03T04:05:06Z\r\n" in bytes(r.record) for r in records.collect())
    spark.table(name).where("bytes < 100").write.saveAsTable(name + "_lost")
    with pytest.raises(Exception, match="no payload"):
        warc_archive.read_records(spark, name + "_lost", heads).collect()


def test_chat_round_trip(spark):
    rng = random.Random(4)
    texts = ["", "\\b<turn x>\\l\\", "</turn>\n<turn user>", "😀é\n", "plain", None]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a>b<c\\", None]), rng.choice(texts)) for c in range(30) for t in range(rng.randint(1, 8))]
    rows += [(50, 1, "user", "same"), (50, 1, "user", "same"), (None, 0, "assistant", "x"), (51, None, "user", "late"), (51, 0, "user", "x" * 50000)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("start", F.lit(1)).withColumn("parts", F.lit(2))
    made = chat_format.format_conversations(df)
    got = {r.conv_id: r for r in chat_format.read_back(made).collect()}
    assert len(got) == 33
    for c in [*range(30), 50, 51, None]:
        own = sorted(((t if t is not None else -1, r or "", x or "") for k, t, r, x in rows if k == c))
        turns = "".join(f"{r}\n{x}\n" for _, r, x in own)
        loss = "".join(x for _, r, x in own if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.read_back(chat_format.format_conversations(df.limit(0))).count() == 0


def test_chat_parts(spark):
    part = lambda k, text=None, ref=None, units=None: (k, text, ref, units)
    rows = [(1, 0, "user", [part("text", "see <"), part("image", ref="a.png", units=2), part("audio", ref="b.wav")]), (1, 1, "assistant", [part("document", ref="c.pdf", units=3), part("text", "ok")]), (1, 2, "user", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn int, role string, content array<{chat_format.PART}>")
    r = chat_format.format_conversations(df, parts=F.col("content")).first()
    assert r.formatted == "<turn user>see \\l<image 1><audio 2></turn>\n<turn assistant><document 3>ok</turn>\n<turn user></turn>\n"
    assert [(a.n, a.type, a.ref, a.turn, a.tokens) for a in r.attachments] == [(1, "image", "a.png", 1, 512), (2, "audio", "b.wav", 1, 25), (3, "document", "c.pdf", 2, 1536)]
    assert r.media_tokens == 2073
    s = r.loss_spans[0]
    assert r.formatted[s.start : s.start + s.length] == "<document 3>ok"


def plain_align(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_matches_the_table():
    rng, pairs = np.random.default_rng(3), []
    for _ in range(50):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(0, 30))
        pairs.append((a, b))
    assert decontam.align(pairs).tolist() == [plain_align(a.tolist(), b.tolist()) for a, b in pairs]
    assert decontam.align([]).tolist() == []


def test_matches(spark):
    docs, _, bench = documents()
    rng = random.Random(6)
    rows = [(i, t) for i, t, _ in docs] + ODD + [(960, prose(rng, "bb", 20000) + " " + bench[2][1].upper() + " " + prose(rng, "cc", 20000))]
    df = frame(spark, rows)
    b = spark.createDataFrame([*bench, (90, None), (91, ""), (92, "too few words"), (93, bench[0][1])], "item_id long, text string").withColumn("n_words", F.lit(1))
    got = decontam.matches(df, b).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == sorted([*((220 + k, k) for k in range(5)), (220, 93), (960, 2)])
    assert all(r.score >= 0.8 for r in got)
    clean = decontam.drop_contaminated(df, b)
    assert clean.columns == df.columns and clean.count() == len(rows) - 6
    assert decontam.matches(df, b.limit(0)).count() == 0 and decontam.matches(df.limit(0), b).count() == 0


@pytest.mark.parametrize("whole_below", [1, 3])
def test_matches_equal_brute_force_alignment(spark, whole_below):
    rng = random.Random(14)
    vocab = [f"w{i}" for i in range(400)]
    bench = [(i, " ".join(rng.choices(vocab, k=rng.randint(4, 30)))) for i in range(12)]
    template = rng.choices(vocab, k=20)
    for i in range(5):  # templated items that differ in one word
        template[9] = f"own{i}"
        bench.append((100 + i, " ".join(template)))
    bench += [(200, "two words"), (201, "ab"), (202, "one two three")]

    def edited(words, every, how):
        out = []
        for i, w in enumerate(words):
            out += [w] if i % every != every - 1 else [] if how == "drop" else ["zz"] if how == "change" else [w, "zz"]
        return out

    rows = []
    for _, t in bench[:17]:
        for every, how in ((1000, "drop"), (4, "change"), (3, "change"), (4, "drop"), (2, "insert"), (1, "insert"), (2, "change")):
            rows.append((len(rows), " ".join([*rng.choices(vocab, k=15), *edited(t.split(), every, how), *rng.choices(vocab, k=15)])))
    template[9] = "elsewhere"
    rows += [(900, " ".join(template)), (901, "Two, words!"), (902, "two other words"), (903, "x ab"), (904, "abc"), (905, "one two"), (906, "so one two three"), (907, "zz one three"), (908, "three only")]
    items = {i: t.split() for i, t in bench}
    want = set()
    for d, t in rows:
        w = decontam.clean_words(t)
        for i, x in items.items():
            x = [y.encode() for y in x]
            if len(x) < whole_below:
                hit = any(w[k : k + len(x)] == x for k in range(len(w)))
            else:
                hit = plain_align(x, w) >= len(x)
            if hit:
                want.add((d, i))
    assert {(900, 100 + i) for i in range(5)} | {(901, 200), (903, 201), (906, 202)} <= want and len(want) > 100
    got = decontam.matches(frame(spark, rows), spark.createDataFrame(bench, "item_id long, text string"), whole_below=whole_below).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)


def test_passages_of_a_long_text_lose_no_item():
    rng = random.Random(15)
    items = [[f"i{k}q{i}" for i in range(12)] for k in range(5)]
    text = " ".join(w for _ in range(30) for k in range(5) for w in [f"x{rng.randrange(99)}" for _ in range(rng.randint(0, 40))] + items[k])
    hashes = [decontam.word_hashes(" ".join(x)) for x in items]
    table = np.zeros(1 << (decontam.TABLE_BITS - 6), np.uint64)
    for s in np.concatenate([decontam.seeds(x, False)[0] for x in hashes]):
        slot = int(s) >> (64 - decontam.TABLE_BITS)
        table[slot >> 6] |= np.uint64(1 << (slot & 63))
    for core in (5, 64, 4096):
        cut = list(decontam.passages(decontam.word_hashes(text), table, False, 27, core))
        assert all(len(h) <= core + 54 for h, _ in cut) and all(sum(decontam.stands(x, h) for h, _ in cut) for x in hashes)


def test_word_hashes_go_over_stretches(monkeypatch):
    rng = random.Random(16)
    words = ["".join(rng.choices("abcé", k=rng.randint(1, 12))) for _ in range(500)] + ["long" * 50, "a"]
    text = "  ".join(words) + "\n"
    whole = decontam.word_hashes(text)
    assert len(set(whole.tolist())) == len(set(words)) and [decontam.word_hashes(w)[0] for w in words] == whole.tolist()
    monkeypatch.setattr(decontam, "STRETCH", 64)
    assert decontam.word_hashes(text).tolist() == whole.tolist() and not len(decontam.word_hashes(" ")) and not len(decontam.word_hashes(None))


def test_only_rows_that_may_go_are_shuffled(spark):
    """Texts don't cross the joins that drop documents, however many go (those joins shuffled every text)."""
    rows = [(i, f"text {i}") for i in range(2000)] + [(None, "no id"), (7, "again")]
    docs = frame(spark, rows)
    ids = common.saved(spark.createDataFrame([(i,) for i in range(0, 2000, 50)] + [(None,)], "id long"), "ids")
    held = common.may_hold(ids)
    some = docs.where(held(docs["doc_id"])).count()
    assert 41 <= some < 60
    got = common.without(docs, "doc_id", ids)
    assert got.columns == docs.columns and sorted((str(r.doc_id), r.text) for r in got.collect()) == sorted((str(i), t) for i, t in rows if i is None or i % 50)
    assert common.without(docs, "doc_id", ids.limit(0)).count() == len(rows)
    assert common.without(docs.limit(0), "doc_id", ids).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs, labels, bench = documents()
    base = f"file://{tmp_path}"
    rows = [(i, t, lang, "s", len(t)) for i, t, lang in docs] + [(i, t, None, None, None) for i, t in ODD]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    one = spark.read.parquet(f"{base}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, one, base)
        assert out.columns == one.columns, name
        one = out
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, base).collect()}
    gone = {i for i, q, _ in labels if not q} | set(range(200, 205)) | set(range(210, 215)) | set(range(220, 225))
    want = {i for i, _, _ in docs} - gone
    assert set(got) <= want and len(want - set(got)) <= 3
    assert all(r.lossless and r.n_pieces == len(r.pieces) for r in got.values())
    empty = spark.read.parquet(f"{base}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, base).count() == 0


def test_pipeline_batches(spark, tmp_path):
    import corpus_pipeline

    base, key = f"file://{tmp_path}", "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.createDataFrame([(i, "word " * 20_000, "aa", "s", 100_000) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    docs = spark.read.parquet(f"{base}/documents.parquet")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [b.nbytes], "n": [b.num_rows]})

    was = spark.conf.getAll.get(key)
    try:
        for name, stage in corpus_pipeline.STAGES:  # each by itself, as they may run in sessions of their own
            spark.conf.unset(key)
            stage(spark, docs.limit(0), base)
            got = docs.mapInArrow(sizes, "bytes long, n long").collect()
            assert sum(r.n for r in got) == 40 and max(r.bytes for r in got) < (1 << 18) + 200_000, name
        spark.conf.set(key, "300000")  # a bound of the session's own
        stage(spark, docs.limit(0), base)
        assert max(r.n for r in docs.mapInArrow(sizes, "bytes long, n long").collect()) < 6
    finally:
        spark.conf.unset(key)
        if was:
            spark.conf.set(key, was)
