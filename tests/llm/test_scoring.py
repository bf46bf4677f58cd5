"""Language-model scores and language identification against plain models."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from diffloom.llm import lang_id, lm_scoring
from tests.llm.helpers import ODD, frame, prose


def toks(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "\n"]


def plain_model(rows, order, prior=lm_scoring.PRIOR):
    train = [t for i, t in rows if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2]
    grams, uni = Counter(), Counter()
    for t in train:
        w = toks(t)
        uni.update(w)
        grams["\r",] += 1
        w = ["\r", *w]
        grams.update(tuple(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1) if k > 1 or i)
    n, v = sum(uni.values()), len(uni)

    def prob(h, w):  # h: the words before, as many as there are
        if not h:
            return (uni[w] + 1) / (n + v + 1)
        return (grams[*h, w] + prior * prob(h[1:], w)) / (grams[h] + prior)

    return uni, n, prob


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores_match_a_plain_model(spark, order):  # the text of 5000 tokens is walked in many stretches
    assert lm_scoring.STRETCH < 1000
    rng = random.Random(3)
    rows = [(i, prose(rng, "aa", rng.randint(0, 60))) for i in range(60)] + ODD + [(950, "x " * 5000)]
    rows += [(1000 + i, rows[i][1]) for i in range(20)]  # texts that occur twice have long histories
    uni, n, prob = plain_model(rows, order)
    got = lm_scoring.lm_scores(frame(spark, rows).repartition(5), order=order).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        w = toks(t)
        before = ["\r", *w]
        score = sum(math.log10(prob(tuple(before[max(0, j - order + 2) : j + 1]), x)) for j, x in enumerate(w))
        want.setdefault(i, []).append((len(w), sum(uni[x] > 0 for x in w), sum(math.log10(prob((), x)) for x in w), score))
    for r in got:
        assert r.train_tokens == n and r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 7 == 2)
        assert any(r.n_tokens == a and r.n_known == b and r.base_score == pytest.approx(c, rel=1e-9) and r.score == pytest.approx(d, rel=1e-9) for a, b, c, d in want[r.doc_id])
    two = tuple(toks(rows[0][1])[:2])
    for h in (("\r",), ("the",), ("nowhere",), two, ("\r", two[0])):
        assert sum(prob(h[-(order - 1) :], w) for w in [*uni, "never seen"]) == pytest.approx(1.0)


def test_scores_of_an_empty_table(spark):
    assert lm_scoring.lm_scores(frame(spark, [])).count() == 0


def test_slices_cover_all_keys():
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    cuts = lm_scoring._ranges(keys, 7, 64)
    assert cuts[0] == 0 and cuts[-1] == 1000 and (np.diff(cuts) > 50).all()


def test_filters_have_no_false_negatives():
    grams = [("aa", 5), ("bb", 5), ("bb", 9), ("cc", 77)]
    f = lang_id.build(grams, ["aa", "bb", "cc"])
    code = np.array([5, 9, 77], np.uint64)
    hits = np.array([f.hits(code[i : i + 1], np.array([0, 1]))[0] for i in range(3)])
    assert (hits >= np.array([[1, 1, 0], [0, 1, 0], [0, 0, 1]])).all() and hits.sum() == 4


def test_many_languages_take_more_words():
    names = [f"l{i:03d}" for i in range(70)]
    f = lang_id.build([(n, i) for i, n in enumerate(names)], names)
    assert f.table.shape[1] == 2 and f.hits(np.array([69], np.uint64), np.array([0, 1]))[0, 69] == 1


def test_trigrams_match_a_plain_loop():
    texts = ["Ab cd", None, "", "é1 x", "12"]
    code, at, letters = lang_id.trigrams(texts)
    for k, t in enumerate(texts):
        v = [ord(c) if c.isalpha() else 0 for c in (t or "").lower()]
        p = [0, *v, 0]
        want = [p[i - 1] << 42 | p[i] << 21 | p[i + 1] for i in range(1, len(p) - 1) if p[i] and (p[i - 1] or p[i + 1])]
        assert code[at[k] : at[k + 1]].tolist() == want and letters[k] == sum(x > 0 for x in v)


def test_language_accuracy_and_odd_rows(spark):
    rng = random.Random(5)
    langs = ["aa", "bb", "cc"]
    rows = [(i, prose(rng, langs[i % 3], 30), langs[i % 3]) for i in range(240)] + [(i, t, None) for i, t in ODD]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    f = lang_id.learn(df)
    got = lang_id.predict(df, f).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert held and all(r.lang_pred == langs[r.doc_id % 3] and 0 < r.score <= 1 for r in held)
    odd = {r.doc_id: r.lang_pred for r in got}
    assert [odd[i] for i in (901, 902, 903, 907)] == ["und"] * 4
    kept = lang_id.keep_known(df, f)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= set(range(240))


def test_decisions_match_exact_sets_of_trigrams(spark):
    rng = random.Random(21)
    langs = ["aa", "bb", "cc"]
    rows = [(i, prose(rng, langs[i % 3], rng.choice([3, 20, 200])), langs[i % 3]) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def grams(text):
        v = [c if c.isalpha() else " " for c in f" {text.lower()} "]
        return [a + b + c for a, b, c in zip(v, v[1:], v[2:], strict=False) if b != " " and (a != " " or c != " ")]

    counts = {x: Counter(g for i, t, y in rows if x == y and zlib.crc32(str(i).encode()) % 4 != 2 for g in grams(t)) for x in langs}
    members = {x: {g for g, n in c.items() if n - 1 >= sum(c.values()) * lang_id.MIN_RATE} for x, c in counts.items()}
    got = {r.doc_id: r for r in lang_id.predict(df, lang_id.learn(df)).collect()}
    for i, t, _ in rows:
        found = {x: sum(g in members[x] for g in grams(t)) for x in langs}
        best = max(langs, key=found.get)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert got[i].lang_pred == best or found[best] - found[got[i].lang_pred] <= 1
        assert got[i].score == pytest.approx(found[best] / sum(found.values()), abs=0.05)
        assert got[i].hit_rate == pytest.approx(found[best] / len(grams(t)), abs=0.05)


def test_nothing_learnt(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    f = lang_id.learn(df)
    assert [r.lang_pred for r in lang_id.predict(df, f).collect()] == ["und"]
    assert lang_id.predict(df.limit(0), f).count() == 0


def test_known_texts_stay_with_twelve_languages_and_stray_labels(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    shared = [word() for _ in range(60)]  # words that all languages have
    pools = [shared + [word() for _ in range(60)] for _ in range(12)]
    text = lambda k, n=120: " ".join(rng.choices(pools[k], k=n))
    rows = [(i, text(i % 12), f"l{i % 12:02d}") for i in range(480)]
    ids = [i for i in range(1000, 1040) if not lang_id.is_held_out(i)][:6]
    rows += [(i, text(0, 400), f"stray{n}") for n, i in enumerate(ids)]  # six labels of one text each, all in language 0
    rows += [(2000, "\u4e00\u4e8c\u4e09" * 40, None)]  # in no language
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    f = lang_id.learn(df)
    assert {r.doc_id for r in lang_id.keep_known(df, f).collect()} == {i for i, _, _ in rows} - {2000}
    held = [r for r in lang_id.predict(df, f).collect() if r.held_out and r.doc_id < 480]
    assert min(r.score for r in held) < 0.3
    assert all(r.lang_pred == f"l{r.doc_id % 12:02d}" for r in held)
