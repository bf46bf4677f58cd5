"""URL filters: glob rules packed into multiword Shift-And masks, all simulated at once over each canonical URL.

A canonical URL is host + path: the host is what stands after the first `://` up to `/`, `?`, `#` or the end, A-Z
lower-cased, the path what follows up to `?`, `#` or the end. Null, or no `://`: both are empty. Since a host holds
no `/`, the first `/` ends it.

Globs are anchored at both ends: `*` stands for any characters, `+` for any without `/` (it stays inside the host), `#` for any
digits, `\\x` for the character x, anything else for itself. A host rule (host, path) becomes the two globs `host path *` and `+.host path *`, its own
characters standing for themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The host rules, in the form (verdict, host, path).
HOST_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: The rules that decide where no host rule fits: globs over the canonical URL. Any hit blocks. Names in a path are whole, so
#: that `/cart/1` is hit and `/cartoons/` is not; what a page is about is no business of a URL filter.
BLOCK_GLOBS = (
    # addresses that are no public site's: user names, ports, addresses in numbers, names inside a network
    "+@*", "+:*", "#.#.#.#", "#.#.#.#/*", "localhost", "localhost/*", "+.localhost", "+.localhost/*", "+.local", "+.local/*", "+.internal", "+.internal/*",
    # paths that are written to slip past filters
    "*/../*", "*/..", "*/./*", "+/*//*", "*%2e%2e*", "*%2E%2E*", "*%252e*", "*%252E*", "*%252f*", "*%252F*", "*%00*", "*\\\\*", "*;jsessionid=*",
    # pages that hold no text of their own: logins, carts, result lists, feeds, trackers
    "*/login", "*/login/*", "*/login.+", "*/signin", "*/signin/*", "*/signin.+", "*/logout", "*/logout/*", "*/logout.+", "*/register", "*/register/", "*/register.+",
    "*/wp-login.+", "*/wp-admin", "*/wp-admin/*", "*/xmlrpc.php", "*/cgi-bin/*", "*/cart", "*/cart/*", "*/cart.+", "*/checkout", "*/checkout/*", "*/checkout.+",
    "*/search", "*/search/*", "*/search.+", "*/feed", "*/feed/", "*/rss", "*/rss/", "*/rss.+",
    "ads.+", "ads.+/*", "+.ads.+", "+.ads.+/*", "adserver.+", "adserver.+/*", "+.doubleclick.net", "+.doubleclick.net/*", "*/out/*http*", "*/goto/*http*",
    # files that are no pages
    "+/*.exe", "+/*.zip", "+/*.gz", "+/*.tar", "+/*.apk", "+/*.dmg", "+/*.iso", "+/*.jpg", "+/*.jpeg", "+/*.png", "+/*.gif", "+/*.svg", "+/*.mp3", "+/*.mp4", "+/*.avi", "+/*.css", "+/*.json", "+/*.xml",
    # a top-level name that is for adults only
    "+.xxx", "+.xxx/*",
)
#: What a gap stands for, any number of times: as bytes, and as a regular expression. Each holds the next.
GAPS = {"*": (frozenset(range(256)), "(?s:.*)"), "+": (frozenset(range(256)) - {ord("/")}, "[^/]*"), "#": (frozenset(b"0123456789"), "[0-9]*")}


def literal(text: str) -> str:
    """A glob that stands for the text itself."""
    return "".join("\\" + c if c == "\\" or c in GAPS else c for c in text)


def symbols(glob: str):
    """(character, whether it is a gap) of the glob, without escapes."""
    escaped = False
    for c in glob:
        if c == "\\" and not escaped:
            escaped = True
            continue
        yield c, c in GAPS and not escaped
        escaped = False


class ShiftAnd:
    """Multiword Shift-And automaton with gaps. Each glob takes one bit for its start and one for each literal byte.

    `step` gives for each byte the bits that may be entered, `stay` the bits that may be kept (a gap after them).
    """

    def __init__(self, globs: Sequence[str]):
        start, final, entry, keep, bit = [], [], [], [], 0
        for g in globs:
            start.append(bit)
            for c, gap in symbols(g):
                if gap:
                    keep.append((bit, GAPS[c][0]))
                    continue
                for b in c.encode():
                    bit += 1
                    entry.append((bit, b))
            final.append(bit)
            bit += 1
        self.words = max(1, -(-bit // 64))
        self.step = np.zeros((257, self.words), np.uint64)
        self.stay = np.zeros((257, self.words), np.uint64)
        self.first = np.zeros(self.words, np.uint64)
        mask = lambda k: np.uint64(1) << np.uint64(k % 64)
        for k in start:
            self.first[k // 64] |= mask(k)
        for k, b in entry:
            self.step[b, k // 64] |= mask(k)
        for k, held in keep:
            self.stay[sorted(held), k // 64] |= mask(k)
        self.final = [(k // 64, mask(k)) for k in final]

    def run(self, urls: Sequence[bytes]) -> np.ndarray:
        """hits[i, g]: glob g matches the whole of urls[i]. All URLs of a batch move one byte at a time, longest first."""
        hits = np.zeros((len(urls), len(self.final)), bool)
        if not len(urls):
            return hits
        size = np.fromiter(map(len, urls), np.int64, len(urls))
        order = np.argsort(-size, kind="stable")
        size = size[order]
        at = np.concatenate([[0], np.cumsum(size)])[:-1]
        data = np.frombuffer(b"".join(urls[i] for i in order) + b"\0", np.uint8)
        state = np.tile(self.first, (len(urls), 1))
        live = np.searchsorted(-size, -np.arange(size[0] + 1), side="left")  # how many URLs have a byte at position t
        for t in range(int(size[0])):
            n = live[t]
            c = data[at[:n] + t]
            s = state[:n]
            moved = s << np.uint64(1)
            if self.words > 1:
                moved[:, 1:] |= s[:, :-1] >> np.uint64(63)
            state[:n] = (moved & self.step[c]) | (s & self.stay[c])
        for g, (w, m) in enumerate(self.final):
            hits[order, g] = (state[:, w] & m) != 0
        return hits


def canonical(url: str | None) -> tuple[str, str]:
    at = url.find("://") if url else -1
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    ends = [k for k in (rest.find("?"), rest.find("#")) if k >= 0]
    rest = rest[: min(ends)] if ends else rest
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"), path


def judge_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", host_rules=HOST_RULES, globs=BLOCK_GLOBS) -> DataFrame:
    """One row per row of df: id, host, path, rule, verdict, n_globs (globs that hit).

    The longest fitting host rule decides; where none fits, the verdict is block if any glob hits, else allow.
    Null and malformed urls have an empty host and path, fit no rule and are allowed; repeated rows are judged alike,
    each on its own, null ids too; very long urls are read whole, a byte of all URLs of a batch at a time; other columns are ignored; no row
    in, no row out. The automaton has a fixed size, so it is sent along with the code and nothing is shuffled.
    """
    rules = sorted(host_rules, key=lambda r: -len(r[1] + r[2]))
    texts = [g for _, host, path in rules for g in (f"{literal(host + path)}*", f"+.{literal(host + path)}*")] + list(globs)
    k = 2 * len(rules)
    spec = df.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    id_type = spec.schema["page_id"].dataType.simpleString()

    def judge(batches):
        automaton = ShiftAnd(texts)
        names = np.array([None] + [f"{h}{p}" for _, h, p in rules], object)
        says = np.array([None] + [v for v, _, _ in rules], object)
        for batch in batches:
            parts = [canonical(u) for u in batch.column("url").to_pylist()]
            hits = automaton.run([(h + p).encode("utf-8", "surrogatepass") for h, p in parts])
            fit = hits[:, 0:k:2] | hits[:, 1:k:2]
            best = np.where(fit.any(1), fit.argmax(1) + 1, 0) if k else np.zeros(len(parts), int)
            own = np.where(hits[:, k:].any(1), "block", "allow")
            verdict = np.where(best > 0, says[best], own)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array(names[best].tolist(), pa.string()), pa.array(verdict.tolist(), pa.string()), pa.array(hits[:, k:].sum(1).astype(np.int32))],
                names=["page_id", "host", "path", "rule", "verdict", "n_globs"],
            )

    return spec.mapInArrow(judge, f"page_id {id_type}, host string, path string, rule string, verdict string, n_globs int")


def like(glob: str) -> str:
    """The glob as a regular expression, for the SQL check."""
    return "^" + "".join(GAPS[c][1] if gap else "\\" + c if not c.isalnum() else c for c, gap in symbols(glob)) + "$"


def sql(host_rules=HOST_RULES, globs=BLOCK_GLOBS) -> str:
    rows = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in host_rules)
    hit = " + ".join(f"CAST(regexp_matches(host || path, '{like(g)}') AS INTEGER)" for g in globs)
    return f"""
    WITH rules(says, h, p) AS (VALUES {rows}),
    rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_replace(substr(url, strpos(url, '://') + 3), '(?s)[?#].*$', '') ELSE '' END AS r FROM pages),
    parts AS (SELECT page_id, lower(CASE WHEN strpos(r, '/') > 0 THEN substr(r, 1, strpos(r, '/') - 1) ELSE r END) AS host,
                     CASE WHEN strpos(r, '/') > 0 THEN substr(r, strpos(r, '/')) ELSE '' END AS path FROM rest),
    judged AS (SELECT *, (SELECT max_by(struct_pack(rule := h || p, says := says), length(h || p)) FROM rules
                          WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS best, {hit} AS n FROM parts)
    SELECT page_id, host, path, best.rule AS rule, coalesce(best.says, CASE WHEN n > 0 THEN 'block' ELSE 'allow' END) AS verdict, CAST(n AS INTEGER) AS n_globs FROM judged
    """
