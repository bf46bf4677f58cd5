"""Quality rules, HTML text, URL filters and pieces against plain loops."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from diffloom.llm import html_text, pieces, quality_rules, url_filters
from tests.llm.helpers import ODD, documents, frame, prose


def plain_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    cover = {k for i, x in enumerate(wins) if wins.count(x) > 1 for k in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), sum(x in lines[:i] for i, x in enumerate(lines)), len(cover)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n# é", max_size=80))
def test_base_counts(text):
    assert quality_rules.base_counts(text) == plain_counts(text)


def test_quality_learns_and_bears_odd_rows(spark):
    docs, labels, _ = documents()
    df = frame(spark, [(i, t) for i, t, _ in docs] + ODD)
    lab = spark.createDataFrame([*labels, (1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality_rules.train(df, lab)
    got = quality_rules.quality(df, model).collect()
    assert len(got) == len(docs) + len(ODD)
    kept = {r.doc_id: r.kept for r in got}
    right = [kept[i] == bool(q) for i, q, _ in labels]
    assert sum(right) >= 0.97 * len(right)
    assert not any(kept[i] for i in (901, 902, 903, 904))
    good = quality_rules.keep_good(df, model)
    assert good.columns == df.columns and good.count() == sum(r.kept for r in got)
    assert quality_rules.quality(df.limit(0), model).count() == 0


def test_quality_with_one_class_or_no_labels(spark):
    df = frame(spark, [(i, "one two three four five six seven eight nine ten eleven") for i in range(8)])
    for rows in ([(i, 1, 0) for i in range(8)], []):
        model = quality_rules.train(df, spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))
        assert all(r.kept for r in quality_rules.quality(df, model).collect())


def test_features_do_not_depend_on_neighbours():
    a = quality_rules.features(["abcdef x y", "zz"])
    b = quality_rules.features(["abcdef x y"])
    for (s, at), (t, bt) in zip(a, b, strict=True):
        assert s[at[0] : at[1]].tolist() == t[bt[0] : bt[1]].tolist()


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var x="</p><article>";</script></head><body class="has-sidebar">
<header>Site</header><nav><ul><li>Menu</li></ul></nav><div class='cookie-notice'>Cookies <div>deep</div></div><!-- c <p>no</p> -->
<article><header><h1>Title &amp; more</h1></header><p>One <b>bo</b>ld<br>two&nbsp;three &#233;</p><aside>side</aside><div class="ad">ad</div>
<p title="a > b">four<p>five<form>f</form><section id="comments">bad</section><ul><li>six</li></ul></article>
<footer>&copy; foot</footer></body></html>"""


def test_article_text():
    assert html_text.page_text(PAGE) == ("Title & more One bold two three é four five six", "")


@pytest.mark.parametrize(("source", "want"), [(None, ("", "")), ("", ("", "")), ("<p>a<p>b", ("", "a b")), ("<article>", ("", "")), ("<main>x</main><article>y", ("x y", "")), ("<div role=main>q</div>z", ("q", "")), ("a < b &lt;i&gt; <p", ("", "a < b <i>")), ("<nav><p>x</nav>y", ("", "y")), ("<script>never closed", ("", "")), ("<article>a<i>b</i></b>c</article>", ("abc", "")), ("<div id=site-header>h</div>x", ("", "x")), ('<div class="post comments-open"><article>a<article class="comment">no</article>b</article></div>', ("a b", ""))])
def test_small_pages(source, want):
    assert html_text.page_text(source) == want


@pytest.mark.parametrize(("source", "want"), [
    ('<div class="layout sidebar-right"><article>a b</article><div class="left-sidebar">no</div></div>', "a b"),
    ('<form id="aspnetForm"><nav>no</nav><article>a</article><input><p>no</p></form>', "a"),
    ('<div class="widget">no<div><main>a<div class="ad">no</div> b</main></div>no</div>', "a b"),
    ('<main><form><article>a</article></form></main>', "a"),
    ('<article>a<section id="related-work">b</section><section id="social-impact">c</section><div class="search-results">d</div></article>', "a b c d"),
    ('<article>a<div class="related-posts">no</div><div class="cookieBar">no</div><div id="ad-1">no</div></article>', "a"),
    ('<article>a</article><div class="sidebar"><article>no</article></div>', "a"),
    ('<main>a<section class="comments"><article>no</article></section></main>', "a"),
    ('<aside><article>no</article></aside><article>a</article>', "a"),
    # tags whose start ends what is open
    ('<article><p class="ad">x<p>Main text here</article>', "Main text here"),
    ('<article><ul><li class="share">s<li>kept item</ul></article>', "kept item"),
    ('<article><p class="ad">x<div>kept</div>too</article>', "kept too"),
    ('<article><dl><dt class="ad">x<dd>kept</dl><table><tr class="ad"><td>x<tr><td>a<td>b</table></article>', "kept a b"),
    ('<article><p class="social-history">a</p><h2 class="related-work">b</h2></article>', "a b"),
    ('<article><ul><li>a<ul><li class="ad">x</ul>b<li>c</ul></article>', "a b c"),
])
def test_wrappers_and_whole_names(source, want):
    assert html_text.page_text(source) == (want, "")


def test_a_wrapped_teaser_is_not_the_page():
    assert html_text.page_text('<div><p>the text of the page</p></div><div class="sidebar"><article>no</article></div>') == ("", "the text of the page")


def test_suffix_array_removes_a_hosts_repeated_runs(spark):
    rng = random.Random(1)
    boiler = " ".join(f"menu{i}" for i in range(12))
    rows, want = [], {}
    for i in range(6):
        own = prose(rng, "aa", 20)
        host = "h1" if i < 4 else f"solo{i}"
        rows.append((i, f"http://{host}.com/{i}", f"<div>{boiler}</div><p>{own}</p>"))
        want[i] = own if i < 4 else f"{boiler} {own}"
    rows += [(7, None, None), (8, "no host", ""), (9, "http://h1.com/9", f"<article>{boiler}</article>"), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", np_lit("x")).withColumn("tokens", np_lit("y"))
    got = [(r.page_id, r.text, r.n_chars) for r in html_text.main_text(df).collect()]
    assert len(got) == len(rows)
    for i, text, n in got:
        assert text == {**want, 7: "", 8: "", 9: boiler}[i] and n == len(text)


def test_copies_and_shared_passages_of_loose_pages_stay(spark):
    rng = random.Random(2)
    boiler, quote = (" ".join(f"{x}{i}" for i in range(12)) for x in ("menu", "quote"))
    own = [prose(rng, "aa", 20) for _ in range(40)]
    rows = [(i, f"http://h.com/{i}", f"<div>{boiler}</div><p>{t}</p>" + (f"<p>{quote}</p>" if i < 3 else "")) for i, t in enumerate(own)]
    want = {i: f"{t} {quote}" if i < 3 else t for i, t in enumerate(own)}
    copy = prose(rng, "bb", 30)
    rows += [(100, "http://c.com/a", f"<p>{copy}</p>"), (101, "http://c.com/a?print=1", f"<p>{copy}</p>"), (102, None, f"<p>{copy}</p>"), (103, "bad", f"<p>{copy}</p>")]
    rows += [(104, "http://h.com/menu", f"<div>{boiler}</div>"), (105, "http://h.com/cut", f"<p>{boiler} and more</p>")]
    want |= dict.fromkeys((100, 101, 102, 103), copy) | {104: boiler, 105: f"{boiler} and more"}
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_text.main_text(df).collect()} == want


def test_parts_in_doubt_stay_unless_they_repeat(spark):
    """Inside an article a name alone does not take text away; two distinct pages of the host with the same run do."""
    probes = ['<div class="dialog">He said hello</div>', '<p class="alert">Warn</p>', '<h2 class="search">Search</h2>', '<section class="related">work of others</section>', '<table><tr><td class="item social">sharing costs</td></tr></table>', "<object>shown instead</object>"]
    for p in probes:
        assert html_text.page_text(f"<article><p>one</p>{p}<p>two</p></article>")[0] == " ".join(re.sub("<[^>]*>", " ", f"one {p} two").split())
    boiler = " ".join(f"read{i}" for i in range(11))
    page = lambda i, part: (i, f"http://h.com/{i}", f'<article><p>text {i}</p><section class="related"><p>{part}</p></section><p>end</p><div class="ads">ad</div></article>')
    rows = [page(1, boiler), page(2, boiler + " more"), page(3, "a chapter on related work that stands on this one page"), page(4, "short"), page(5, "short")]
    rows += [(6, "http://other.com/6", page(6, boiler)[2]), (7, "http://h.com/7", f"<article><p>{boiler}</p></article>"), (8, "http://h.com/8", "<p class='alert'>\x1e \x1f</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {1: "text 1 end", 2: f"text 2 {boiler} more end", 3: "text 3 a chapter on related work that stands on this one page end", 4: "text 4 short end", 5: "text 5 short end", 6: f"text 6 {boiler} end", 7: boiler, 8: ""}
    assert {r.page_id: r.text for r in html_text.main_text(df).collect()} == want


def test_named_parts_of_pages_in_doubt_count_once_for_each_page(spark):
    """A menu that pages in doubt name is told where a page leaves it unnamed; a part that only its own page's menu repeats stays."""
    menu = "Home News Sport Culture Weather Travel Money Science Health"
    alone = "one two three four five six seven eight nine ten"
    own = ["".join(f"w{i}x{k} " for k in range(12)).strip() for i in range(5)]
    weak = [f"chapter {i} says a{i} b{i} c{i} d{i} e{i} f{i} g{i}" for i in range(3)]
    page = lambda nav, text, part: f'<nav>{nav}</nav><article><p>{text}</p><div class="related">{part}</div></article>'
    rows = [(i, f"http://h.com/{i}", page(menu, own[i], weak[i])) for i in range(3)]
    rows += [(3, "http://h.com/3", f"<div>{menu}</div><div>{own[3]}</div>"), (4, "http://other.com/4", page(alone, own[4], alone))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: f"{own[i]} {weak[i]}" for i in range(3)} | {3: own[3], 4: f"{own[4]} {alone}"}
    assert {r.page_id: r.text for r in html_text.main_text(df).collect()} == want


def test_named_parts_of_other_pages_count(spark):
    """A menu that one page leaves unnamed is told by the pages that name it; article passages and parts of other hosts tell nothing."""
    rng = random.Random(3)
    menu, foot, quote = (" ".join(f"{x}{i}" for i in range(10)) for x in ("menu", "foot", "quote"))
    own = {i: prose(rng, "aa", 20) for i in range(20)}
    named = lambda i: f"<nav><ul><li>{menu}</li></ul></nav><article><p>{own[i]}</p><p>{quote}</p></article><footer>{foot}</footer>"
    rows = [(i, f"http://h.com/{i}", named(i)) for i in range(3)]
    rows += [(3, "http://h.com/3", f"<div>{menu}</div><p>{own[3]}</p><p>{quote}</p><div>{foot}</div>")]
    rows += [(4, "http://other.com/4", f"<div>{menu}</div><p>{own[4]}</p>")]
    rows += [(5, "http://h.com/5", f"<article><p>{own[5]}</p><div class='dialog'>{foot}</div></article>")]
    # copies of one page are one page
    rows += [(i, f"http://c.com/{i}", f"<nav>{menu}</nav><article>{own[6]}</article>") for i in (6, 7, 8)] + [(9, "http://c.com/9", f"<div>{menu}</div><p>{own[9]}</p>")]
    want = {i: f"{own[i]} {quote}" for i in range(4)} | {4: f"{menu} {own[4]}", 5: own[5]} | dict.fromkeys((6, 7, 8), own[6]) | {9: f"{menu} {own[9]}"}
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_text.main_text(df).collect()} == {i: " ".join(t.split()) for i, t in want.items()}


@pytest.mark.parametrize("depth", [1, 2, 8])
def test_suffix_ranks_are_those_of_sorted_runs(spark, depth):
    rng = random.Random(depth)
    streams = {(h, f"{h}{k}"): [rng.choice("abc") for _ in range(rng.randint(1, 60))] for h in "xy" for k in range(4)}
    rows = [(h, p, i, t) for (h, p), ts in streams.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "host string, page string, pos int, token string")
    got = {(r.page, r.pos): r["rank"] for r in html_text.suffix_ranks(df, depth).collect()}
    for host in "xy":
        runs = {(p, i): tuple(ts[i : i + depth]) for (h, p), ts in streams.items() if h == host for i in range(len(ts) - depth + 1)}
        order = {r: k + 1 for k, r in enumerate(sorted(set(runs.values())))}
        assert {k: v for k, v in got.items() if k[0][0] == host} == {k: order[r] for k, r in runs.items()}


def np_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def plain_judge(url):
    host, path = url_filters.canonical(url)
    fits = [(len(h + p), f"{h}{p}", v) for v, h, p in url_filters.HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    hits = sum(bool(re.match(url_filters.like(g), host + path, re.S)) for g in url_filters.BLOCK_GLOBS)
    best = max(fits, default=None)
    return host, path, best and best[1], best[2] if best else "block" if hits else "allow", hits


URLS = ["http://WWW.Example.com/en/x", "http://example.com/en/x", "https://a.net/es/?q", "net/es/", None, "", "http://x.com", "http://evil.org/.com/", "http://my-casino-hall.org/a", "http://cheap-pills.org", "http://a.b.xxx/", "http://q.org/a/viagra/b#viagra", "http://q.org/track/1/click2", "://net/fr/", "http://net/fr?x", "http://é.org/casino/", "ftp://user@host.org/a", "http://host.org:8080/", "http://host.org/a/../b", "http://host.org/a%2fb", "http://host.org/a+b\\c", "http://10.0.0.1/", "http://long.org/" + "a/" * 20_000 + "x.zip", "http://host.org/a/../b"]


def test_urls(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("host", np_lit("x"))
    got = {r.page_id: tuple(r)[1:] for r in url_filters.judge_urls(df).collect()}
    assert got == {i: plain_judge(u) for i, u in enumerate(URLS)}
    assert url_filters.judge_urls(df.limit(0)).count() == 0


def test_a_rules_own_characters_are_no_wildcards(spark):
    df = spark.createDataFrame([(1, "http://x.org/c++/a"), (2, "http://x.org/cZZ/a"), (None, "http://x.org/a*b"), (3, "http://x.org/aZb"), (3, "http://x.org/aZb")], "page_id long, url string")
    rules = (("block", "org", "/c++/"), ("block", "org", "/a*b"))
    got = sorted((str(r.page_id), r.rule, r.verdict) for r in url_filters.judge_urls(df, host_rules=rules, globs=()).collect())
    assert got == [("1", "org/c++/", "block"), ("2", None, "allow"), ("3", None, "allow"), ("3", None, "allow"), ("None", "org/a*b", "block")]


#: URLs and verdicts, written by hand.
HARMLESS = """x.org x.org/ x.org/c++/intro x.org/cartoons/1 x.org/cartography x.org/registered-nurses x.org/loginov-biography x.org/rss-history x.org/feed/cattle
10.wiki.org/a 10.2.3.wiki.org localhostnews.org/a pornic.fr/plage pokerface.org xn--mnchen-3ya.de/rathaus x.org/wiki/Node.js x.org/100%25-cotton click.palletsprojects.com/en example.zip
x.org/a.b/research/ x.org/calendar/history x.org/a+b x.org/a*b roads.x.org/ads x.org/the..end/a""".split()
BLOCKED = """u@x.org/a x.org:8080/a 172.16.0.1/a 8.8.8.8 10.0.0.1/ localhost localhost/a a.localhost/b printer.local/a x.internal x.org/a/../b x.org/a/.. x.org/./b x.org/a//b x.org/%2e%2e/a x.org/%252fetc x.org/a%00b
x.org/a\\b x.org/a;jsessionid=1 x.org/login x.org/login.php x.org/a/login/2 x.org/cart/1 x.org/search/q x.org/a/feed/ x.org/rss.xml ads.x.org/1 eu.ads.x.org g.doubleclick.net/a x.org/out/http%3A x.org/a.zip x.org/b/c.PNG.png a.xxx/1""".split()


def test_block_globs_against_a_table_written_by_hand(spark):
    rows = [(f"{v} {u}", f"https://{u}?q=login#/cart") for v, us in (("allow", HARMLESS), ("block", BLOCKED)) for u in us]
    rows += [("block long", "http://x.org/" + "a/" * 200_000 + "/b"), ("allow long", "http://x.org/" + "b" * 400_000)]
    got = url_filters.judge_urls(spark.createDataFrame(rows, "page_id string, url string")).collect()
    assert len(got) == len(rows) and [r.page_id for r in got if not r.page_id.startswith(r.verdict)] == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="a1/*+#\\", min_size=1, max_size=6), min_size=1, max_size=25), st.lists(st.text(alphabet="a1/#", max_size=12), min_size=1, max_size=5))
def test_shift_and_matches_regular_expressions(globs, urls):
    got = url_filters.ShiftAnd(globs).run([u.encode() for u in urls])
    want = [[bool(re.match(url_filters.like(g), u)) for g in globs] for u in urls]
    assert got.tolist() == want


@pytest.fixture(scope="module")
def vocab():
    return pieces.vocabulary()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60), st.text(alphabet="the ▁\n é", max_size=60)), max_size=5))
def test_pieces_are_lossless_and_batch_free(texts):
    vocab = pieces.vocabulary()
    keys = [str(i) for i in range(len(texts))]
    ids, n = pieces.encode(keys, texts, vocab)
    at = np.r_[0, np.cumsum(n)].astype(int)
    for i, t in enumerate(texts):
        own = ids[at[i] : at[i + 1]]
        assert pieces.decode(own, vocab) == (t or "")
        assert own.tolist() == pieces.encode([keys[i]], [t], vocab)[0].tolist()


@pytest.mark.parametrize("word", ["▁the", "▁ing", "thn", "▁▁a", "ñé"])
def test_sampling_follows_the_lattice(vocab, word):
    data = word.encode()
    spell = {vocab.text[i].replace(b" ", "▁".encode()): i for i in range(259, len(vocab.text))}
    weight = {}
    cuts = range(1, len(data))
    for k in range(len(data)):
        for c in itertools.combinations(cuts, k):
            parts = [data[a:b] for a, b in itertools.pairwise([0, *c, len(data)])]
            if all(p in spell for p in parts):
                weight[tuple(spell[p] for p in parts)] = math.exp(pieces.SHARPNESS * sum(vocab.score[spell[p]] for p in parts))
    total, n = sum(weight.values()), 20000
    lattice = pieces.Lattice([data], vocab, pieces.SHARPNESS)
    ids, many = lattice.sample(np.zeros(n, np.int64), np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    seen: dict = {}
    at = np.r_[0, np.cumsum(many)]
    for i in range(n):
        key = tuple(ids[at[i] : at[i + 1]].tolist())
        seen[key] = seen.get(key, 0) + 1
    assert set(seen) <= set(weight)
    for k, w in weight.items():
        assert seen.get(k, 0) / n == pytest.approx(w / total, abs=0.02)


def test_encode_rows(spark):
    rows = [*ODD, (950, "thing " * 30000), (951, "y" * 3000)]
    df = frame(spark, rows)
    a = pieces.encode_pieces(df)
    b = pieces.encode_pieces(df.repartition(3))
    key = lambda d: sorted((str(r.doc_id), tuple(r.pieces), r.lossless) for r in d.collect())
    assert key(a) == key(b) and a.where("lossless").count() == len(rows)
    back = {r.doc_id: r.decoded for r in pieces.decode_pieces(a).collect()}
    assert back[950] == "thing " * 30000 and back[901] == ""
    assert pieces.encode_pieces(df.limit(0)).count() == 0
