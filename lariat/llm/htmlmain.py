"""Main text of web pages, with boilerplate found by suffix arrays over the pages of a host."""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lariat.llm.common import cut

#: Tokens of a run.
RUN = 6
#: Pages of a host, and bytes of them, whose streams one task sorts together; larger hosts are dealt out by hash.
TOGETHER, BYTES = 500, 1 << 25
#: A run that stands in more than this share of a host's different articles is boilerplate, if there are so many.
MOST, LEAST = 0.8, 10
#: Hosts that may be broadcast, and rows of runs.
SMALL = 200_000

#: Fixed values of HTML.
RAW = ("script", "style", "noscript", "template", "iframe", "svg", "object", "textarea", "title")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
LEFT_OUT = {"nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "fieldset", "canvas", "audio", "video"}
BLOCKS = {
    "address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5",
    "h6", "hgroup", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
} | LEFT_OUT
#: Elements that end where another of the same name begins beside them.
ALIKE = {"p", "li", "dt", "dd", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6"}
#: Words in a class, id or role that mark what is no part of an article.
SIGNS = {
    "ad", "ads", "advert", "advertisement", "adverts", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "consent",
    "contentinfo", "cookie", "cookies", "dialog", "disqus", "footer", "form", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar",
    "navigation", "newsletter", "notice", "notices", "notification", "pagination", "popup", "promo", "related", "replies", "respond", "search", "share",
    "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
#: Words beside which header marks the head of an article, not of a site.
OF_ARTICLES = {"article", "content", "entry", "page", "post", "section", "story"}

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_STOP = re.compile(r">|=\s*[\"']")
_CLOSING = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:\s|^)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_SIGN = re.compile(r"[a-z0-9]+")
#: The host of a URL, for Java's and Python's expressions alike.
HOST = r"^[\s]*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host(url: str | None) -> str:
    m = re.match(HOST, url or "")
    return m[1].lower() if m else ""


def tokens(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(begin, end, whether it closes, name, attributes) of each tag; what is no tag and shows no text has no name.

    One pass, whatever the page holds: each search either moves on or is never made again. A quote
    counts behind "=" only, and only if another closes it; if a tag then has no end, quotes count
    no more. A comment or script that is not closed reaches to the end of the page, so does a tag
    without ">"; a title that is not closed ends at the next tag.
    """
    at, quotes, open_quotes, open_raw = 0, True, set(), set()
    while (begin := page.find("<", at)) >= 0:
        if page.startswith(("<!", "<?"), begin):
            comment = page.startswith("<!--", begin)
            end = page.find("-->" if comment else ">", begin + (4 if comment else 2))
            at = len(page) if end < 0 else end + (3 if comment else 1)
            yield begin, at, False, "", ""
            continue
        close = page.startswith("/", begin + 1)
        name = _NAME.match(page, begin + 1 + close)
        if name is None:
            at = begin + 1  # no markup
            continue
        end, k = -1, name.end()
        while quotes and (stop := _STOP.search(page, k)):
            if stop[0] == ">":
                end = stop.end()
                break
            mark = stop[0][-1]
            k = -1 if mark in open_quotes else page.find(mark, stop.end())
            if k < 0:
                open_quotes.add(mark)
                k = stop.end()
            else:
                k += 1
        if end < 0:
            quotes = False
            end = page.find(">", name.end()) + 1
            if not end:
                yield begin, len(page), False, "", ""
                return
        tag, attrs = name[0].lower(), page[name.end() : end - 1]
        if tag not in RAW or close or (tag == "svg" and attrs.endswith("/")):
            at = end
            yield begin, end, close, tag, attrs
            continue
        shut = None if tag in open_raw else _CLOSING[tag].search(page, end)
        if shut:
            k = page.find(">", shut.end())
        else:
            open_raw.add(tag)
            k = page.find("<", end) - 1 if tag in ("title", "textarea") else -1
            k = -1 if k < end - 1 else k
        at = len(page) if k < 0 else k + 1
        yield begin, at, False, "", ""


def _left_out(tag: str, attrs: str, inside: bool) -> bool:
    """Whether an element is no part of an article.

    Inside of one, only whole names of the classes of blocks tell; elsewhere words of names do too.
    """
    if tag in LEFT_OUT and not (tag == "header" and inside):
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    if _HIDDEN.search(attrs):
        return True
    if inside and tag not in BLOCKS:
        return False
    for m in _ATTR.finditer(attrs):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            words = {*_SIGN.findall(name)}
            signs = {name} & (SIGNS - {"header"}) if inside else words & SIGNS
            if signs and not (signs == {"header"} and words & OF_ARTICLES):
                return True
    return False


class _Open:
    """The open elements: name, whether left out, whether in a main region; each step is of constant time."""

    def __init__(self):
        self.stack: list[tuple[str, bool, bool]] = []
        self.places: dict[str, list[int]] = {}
        self.regions: list[int] = []

    @property
    def top(self) -> tuple[str, bool, bool]:
        return self.stack[-1] if self.stack else ("", False, False)

    def push(self, tag: str, gone: bool, region: bool) -> None:
        _, out, inside = self.top
        self.places.setdefault(tag, []).append(len(self.stack))
        if region:
            self.regions.append(len(self.stack))
        self.stack.append((tag, out or gone, inside or region))

    def pop(self) -> str:
        tag = self.stack.pop()[0]
        self.places[tag].pop()
        if self.regions and self.regions[-1] == len(self.stack):
            self.regions.pop()
        return tag

    def has(self, tag: str) -> bool:
        """Whether an end tag has an open element; a stray one doesn't reach beyond an article."""
        places = self.places.get(tag)
        return bool(places) and (tag in ("body", "html") or not self.regions or places[-1] >= self.regions[-1])


def blocks(page: str | None) -> tuple[list[str], list[str], bool]:
    """Blocks of a page's main region, blocks of the rest, and whether an article or main element marks the region.

    Without such an element the region is all that no element or sign leaves out. Character
    references are decoded; white space in a block becomes one space; empty blocks go. Elements
    that a page does not close end with their parent; the head needs no end.
    """
    page = page or ""
    now = _Open()
    out: list[tuple[str, bool, bool]] = []
    parts: list[str] = []
    marked = False

    def flush() -> None:
        if parts:
            if text := " ".join(html.unescape("".join(parts)).split()):
                out.append((text, *now.top[1:]))
            parts.clear()

    at = 0
    for begin, end, close, tag, attrs in tokens(page):
        if begin > at:
            parts.append(page[at:begin])
        at = end
        if not tag:
            continue
        if tag in ("br", "td", "th"):
            parts.append(" ")
        _, skipped, inside = now.top
        if tag not in BLOCKS and not attrs and not skipped:
            continue  # such an element neither parts blocks nor leaves anything out
        if close:
            if now.has(tag):
                flush()
                while now.pop() != tag:
                    pass
            elif tag in BLOCKS:
                flush()
            continue
        gone = _left_out(tag, attrs, inside)
        if tag not in BLOCKS and not gone:
            if skipped and tag not in VOID:
                now.push(tag, False, False)
            continue
        flush()
        last = now.top[0]
        if last and (last == tag and tag in ALIKE or last == "p" and tag in BLOCKS):  # implied end
            now.pop()
        if tag not in VOID and not attrs.endswith("/"):
            region = tag in ("article", "main") and not gone and not now.top[1]
            marked = marked or region
            now.push(tag, gone, region)
    if at < len(page):
        parts.append(page[at:])
    flush()
    if marked:
        own = [t for t, gone, region in out if region and not gone]
        return own, [t for t, gone, region in out if gone or not region], True
    return [t for t, gone, _ in out if not gone], [t for t, gone, _ in out if gone], False


def suffix_order(codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of codes sorted by their first `depth` tokens, and their ranks: equal ranks agree in all of these.

    Ranks of a length are doubled, by sorting pairs, until they cover the depth. Equal ranks keep
    the order of their places.
    """
    rank = codes - codes.min() if len(codes) else codes
    length = 1
    while length < depth:
        step = min(length, depth - length)
        later = np.concatenate([rank[step:], np.full(min(step, len(rank)), -1)])[: len(rank)] + 1
        rank = np.unique(rank * (len(rank) + int(rank.max(initial=0)) + 2) + later, return_inverse=True)[1].astype(np.int64)
        length += step
    return np.argsort(rank, kind="stable"), rank


class Runs:
    """The runs of that many tokens in the streams of some pages.

    The streams are concatenated, each closed by a token of its own, so that no run reaches from
    one page into the next. In suffix order the runs that agree stand together, as one group.
    """

    def __init__(self, streams: list[list[int]], run: int = RUN):
        sizes = np.array([len(s) + 1 for s in streams], np.int64)
        self.run, self.edges = run, np.concatenate([[0], np.cumsum(sizes)])
        self.codes = np.concatenate([np.array([*s, -1 - i], np.int64) for i, s in enumerate(streams)] or [np.zeros(0, np.int64)])
        page = np.repeat(np.arange(len(streams)), sizes)
        self.order, rank = suffix_order(self.codes, run)
        pages, ranks = page[self.order], rank[self.order]
        fresh = np.concatenate([np.ones(min(1, len(ranks)), bool), np.diff(ranks) > 0])
        self.starts = np.flatnonzero(fresh)
        other = fresh | np.concatenate([np.ones(min(1, len(pages)), bool), np.diff(pages) > 0])
        #: In how many pages each group's run stands.
        self.pages = np.add.reduceat(other, self.starts, dtype=np.int64) if len(self.starts) else np.zeros(0, np.int64)
        room = self.edges[page + 1] - 1 - np.arange(len(page))
        self.whole = (room >= run)[self.order[self.starts]] if len(self.starts) else np.zeros(0, bool)

    def begins(self, groups: np.ndarray) -> list[np.ndarray]:
        """For each page's tokens, whether one of these groups (a mask) begins there."""
        found = np.zeros(len(self.codes), bool)
        if len(self.starts):
            found[self.order] = np.repeat(groups & self.whole, np.diff(np.append(self.starts, len(self.order))))
        return [found[a : b - 1] for a, b in zip(self.edges, self.edges[1:], strict=False)]

    def some(self, groups: np.ndarray) -> list[np.ndarray]:
        """The tokens of each of these groups' runs."""
        return [self.codes[k : k + self.run] for k in self.order[self.starts[groups & self.whole]]]


def repeats(streams: list[list[int]], run: int = RUN) -> list[np.ndarray]:
    """For each page's tokens, whether each begins a run of that length that another page has too."""
    own = Runs(streams, run)
    return own.begins(own.pages > 1)


def covered(texts: list[str], starts: np.ndarray, run: int = RUN) -> list[bool]:
    """Whether runs that begin at the marked tokens cover all of a block's tokens.

    A run may reach over the borders of blocks; so a short line is covered only together with its
    neighbours.
    """
    under = np.zeros(len(starts), bool)
    for k in range(min(run, len(starts))):
        under[k:] |= starts[: len(starts) - k]
    out, at = [], 0
    for text in texts:
        n = text.count(" ") + 1
        out.append(bool(under[at : at + n].all()))
        at += n
    return out


def unique_blocks(texts: list[str], starts: np.ndarray, run: int = RUN) -> list[str]:
    """The blocks that are not covered by repeated runs."""
    return [t for t, gone in zip(texts, covered(texts, starts, run), strict=False) if not gone]


def article_blocks(texts: list[str], known: set[str], run: int = RUN) -> list[str]:
    """An article's blocks without those that runs of its host's boilerplate cover.

    Boilerplate is the lesser part of an article: where it would be half of it or more, the
    article is a copy of others, and nothing goes.
    """
    own = [t for b in texts for t in b.split(" ")]
    gone = covered(texts, np.array([w in known for w in _windows(own, run)] + [False] * min(len(own), run - 1), bool), run)
    size = sum(b.count(" ") + 1 for b, x in zip(texts, gone, strict=True) if x)
    return texts if 2 * size >= len(own) else [b for b, x in zip(texts, gone, strict=True) if not x]


def _windows(tokens: list[str], run: int) -> list[str]:
    return ["\x1f".join(tokens[i : i + run]) for i in range(len(tokens) - run + 1)]


def _coded(lists: list[list[str]]) -> tuple[list[list[int]], list[str]]:
    known: dict[str, int] = {}
    return [[known.setdefault(t, len(known)) for t in x] for x in lists], list(known)


def _few(df: DataFrame) -> DataFrame:
    """df for a join: broadcast if it has few rows, which are bounded each."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", run: int = RUN, together: int = TOGETHER) -> DataFrame:
    """(id, url, text, n_chars, covered) for each page, of whole pages.

    A page with an article or main element gives the blocks in it that no element or sign leaves
    out, but for those that the host's boilerplate covers: runs of tokens that stand in most of the
    host's different articles. Another page gives such blocks of the whole page, without those that
    runs cover which also stand on another page of its host, be it in any block outside of
    articles. covered: how many blocks went for that. What two articles have in common is theirs,
    and copies of an article count once, so both stay whole.

    A host's streams are dealt to tasks of bounded size by a hash, and each sorts the suffixes of
    its share. What is in most articles of a host is in most articles of one share at least; so
    the shares' findings are all candidates, which are then counted in all of them, and the result
    does not depend on the dealing.

    A null page is empty, and so is a page without text; null urls are one host; repeated rows are
    pages of their own; null ids stay; further columns are ignored; no rows give no rows. Malformed
    and very long pages are read in one pass.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    url = F.col(url_col).cast("string")
    named = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))
    own = pages.select(F.col(id_col).alias("id"), url.alias("url"), named.alias("host"), F.col(html_col).cast("string").alias("html"))
    size = own.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.octet_length("html")).alias("bytes"))
    size = size.select("host", F.ceil(F.greatest(F.col("n") / together, F.coalesce(F.col("bytes"), F.lit(0)) / BYTES)).cast("int").alias("shares")).where("shares > 1")
    large = _few(cut(size))

    def articles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A page's article, or null if no element marks it; each but once from a task."""
        seen = set()
        for batch in batches:
            got = []
            for name, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                main, _, marked = blocks(x.as_py())
                text = "\n".join(main) if marked else None
                key = hashlib.blake2b(f"{name}\0{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
                if key not in seen:
                    seen.add(key)
                    got.append((name, text))
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], pa.string()) for k in range(2)], names=["host", "text"])

    found = own.select("host", "html").mapInArrow(articles, "host string, text string").join(large, "host", "left")
    found = found.withColumn("share", F.pmod(F.xxhash64("text"), F.coalesce("shares", F.lit(1)).cast("bigint")).cast("int"))
    found = found.repartition("host", "share").distinct()  # this and the groups need no further shuffle

    def frequent(x: pd.DataFrame) -> pd.DataFrame:
        """The runs in most articles of a share; a row without a run tells the number of articles, and whether a page has none."""
        texts = [t for t in x["text"] if t]
        coded, names = _coded([t.replace("\n", " ").split(" ") for t in texts])
        alone = x["shares"].isna().iloc[0]
        own = Runs(coded if not alone or len(texts) >= LEAST else [], run)
        most = own.pages > MOST * len(texts)
        rows = [("\x1f".join(names[k] for k in codes), int(n)) for codes, n in zip(own.some(most), own.pages[most & own.whole], strict=True)]
        rows.append((None, len(texts)))
        out = pd.DataFrame(rows, columns=["run", "n"])
        return out.assign(host=x["host"].iloc[0], alone=alone, articles=len(texts), open=bool(x["text"].isna().any()))

    seen = cut(found.groupBy("host", "share").applyInPandas(frequent, "run string, n bigint, host string, alone boolean, articles bigint, open boolean"))
    marks = seen.where("run is not null and alone").select("host", "run")
    maybe = seen.where("run is not null and not alone").select("host", "run").distinct()
    if not maybe.isEmpty():
        marks = marks.unionByName(_counted(found.where("text is not null").select("host", "text"), maybe, seen.where("run is null and not alone"), run))
    marks = cut(marks.groupBy("host").agg(F.collect_set("run").alias("runs")))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for x, runs in zip(batch.column(2), batch.column(3), strict=True):
                main, _, marked = blocks(x.as_py())
                known = runs.as_py()
                kept = article_blocks(main, set(known), run) if marked and known else main
                got.append(("\n\n".join(kept), len(main) - len(kept), marked))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.bool_())], names=["id", "url", "text", "covered", "marked"])

    told = own.withColumn("runs", F.lit(None).cast("array<string>")) if marks.isEmpty() else own.join(_few(marks), "host", "left")
    out = told.select("id", "url", "html", "runs").mapInArrow(parsed, f"id {kind}, url string, text string, covered bigint, marked boolean")
    out = out.where("marked").select("id", "url", "text", "covered")
    hosts = seen.where("open").select("host").distinct()
    if not hosts.isEmpty():
        out = out.unionByName(_cleaned(own.join(_few(hosts), "host", "left_semi").join(large, "host", "left"), kind, run))
    return out.select("id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), "covered")


def _counted(articles: DataFrame, maybe: DataFrame, totals: DataFrame, run: int) -> DataFrame:
    """The runs (host, run) among the candidates that most of the host's articles have."""
    runs = cut(maybe.groupBy("host").agg(F.collect_set("run").alias("runs")))  # of a host no more than some articles have

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, text, known in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                own = set(_windows(text.replace("\n", " ").split(" "), run))
                rows += [(host, w) for w in known if w in own]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(2)], names=["host", "run"])

    met = articles.join(_few(runs), "host").select("host", "text", "runs").mapInArrow(hits, "host string, run string").groupBy("host", "run").agg(F.count("*").alias("n"))
    whole = totals.groupBy("host").agg(F.sum("articles").alias("articles"))
    return met.join(_few(whole), "host").where((F.col("n") > MOST * F.col("articles")) & (F.col("articles") >= LEAST)).select("host", "run")


def _cleaned(pages: DataFrame, kind: str, run: int) -> DataFrame:
    """The pages without a marked region of hosts that have such pages; pages has id, url, host, html and shares (null: one)."""

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = pa.list_(pa.string())
        for batch in batches:
            got = [blocks(x.as_py()) for x in batch.column(4)]
            main = pa.array([None if marked else main for main, _, marked in got], lists)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], main, pa.array([rest for _, rest, _ in got], lists)], names=["id", "url", "host", "shares", "main", "rest"])

    rows = pages.select("id", "url", "host", F.coalesce("shares", F.lit(1)).alias("shares"), "html").mapInArrow(streams, f"id {kind}, url string, host string, shares int, main array<string>, rest array<string>")
    share = F.pmod(F.xxhash64("id", "url", F.to_json("main"), F.to_json("rest")), F.col("shares").cast("bigint")).cast("int")
    rows = cut(rows.withColumn("share", share).withColumn("row", F.monotonically_increasing_id()))

    def listed(x: pd.DataFrame) -> list[list[str]]:
        return [[t for b in [*(m if m is not None else []), *r] for t in b.split(" ")] for m, r in zip(x["main"], x["rest"], strict=True)]

    def runs(x: pd.DataFrame) -> pd.DataFrame:
        """The distinct runs of a share."""
        found = {w for t in listed(x) for w in _windows(t, run)}
        return pd.DataFrame({"host": x["host"].iloc[0], "run": sorted(found)})

    several = rows.where("shares > 1")
    shared = several.groupBy("host", "share").applyInPandas(runs, "host string, run string").select("host", F.xxhash64("run").alias("run"))
    shared = shared.groupBy("host", "run").count().where("count > 1").select("host", "run")

    def clean(x: pd.DataFrame, also: list[set[str]]) -> pd.DataFrame:
        lists = listed(x)
        found = repeats(_coded(lists)[0], run)
        texts, gone = [], []
        for main, own, starts, more in zip(x["main"], lists, found, also, strict=True):
            if main is None:
                continue
            for i, w in enumerate(_windows(own, run) if more else ()):
                starts[i] |= w in more
            kept = unique_blocks(list(main), starts, run)
            texts.append("\n\n".join(kept))
            gone.append(len(main) - len(kept))
        mine = x[x["main"].notna()]
        return pd.DataFrame({"id": mine["id"], "url": mine["url"], "text": texts, "covered": gone})

    def single(x: pd.DataFrame) -> pd.DataFrame:
        return clean(x, [set()] * len(x))

    def joint(x: pd.DataFrame) -> pd.DataFrame:
        x = x.reset_index(drop=True)
        return clean(x, [set(r) if r is not None else set() for r in x["runs"]])

    shape = f"id {kind}, url string, text string, covered bigint"
    out = rows.where("shares = 1").groupBy("host").applyInPandas(single, shape)
    if several.isEmpty():
        return out
    # the runs that shares have in common reach the pages that have them, never a host's task as a whole
    flat = F.flatten(F.array(F.coalesce("main", F.array().cast("array<string>")), "rest"))
    words = several.where(F.col("main").isNotNull()).select("host", "row", F.split(F.array_join(flat, " "), " ").alias("t"))
    windows = words.where(F.size("t") >= run).select("host", "row", F.explode(F.transform(F.sequence(F.lit(1), F.size("t") - (run - 1)), lambda i: F.array_join(F.slice("t", i, F.lit(run)), "\x1f"))).alias("w"))
    windows = windows.select("host", "row", "w", F.xxhash64("w").alias("run"))
    hit = windows.join(shared, ["host", "run"]).groupBy("row").agg(F.collect_set("w").alias("runs"))
    return out.unionByName(several.join(hit, "row", "left").groupBy("host", "share").applyInPandas(joint, shape))
