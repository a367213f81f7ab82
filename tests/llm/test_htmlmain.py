from __future__ import annotations

import random
import time
from html.parser import HTMLParser

from lariat.llm import htmlmain, queries


def page(body):
    return f"<!DOCTYPE html><html><head><title>t &amp; t</title><style>p{{x:1}}</style></head><body>{body}</body></html>"


ARTICLE = page(
    '<nav><ul><li><a href="/">Home</a></ul></nav><div class="ad">Buy</div><div id="cookie-notice">We use cookies</div><article><h1>A &lt;title&gt;</h1><p><b>One<br>two&nbsp;three<br>'
    '<p>Four &#233; &eacute; <script>var t="</p>";</script><i>f</i>ive</p><aside>aside</aside><div class="share">Share</div><ul><li>x<li>y</ul><form>mail</form>'
    '<section class="comments"><p>First!</p></section><p>Last &am</p></article><!-- <p>no</p> --><footer>&copy; z</footer>'
)


def test_article():
    main, rest, marked = htmlmain.blocks(ARTICLE)
    assert marked and main == ["A <title>", "One two three", "Four é é five", "x", "y", "Last &am"]
    assert "Home" in rest and "First!" in rest and "© z" in rest


def test_odd_pages():
    assert htmlmain.blocks(None) == ([], [], False) and htmlmain.blocks("") == ([], [], False)
    assert htmlmain.blocks("plain   text")[0] == ["plain text"]
    assert htmlmain.blocks("<article><p>a</div></p><p>b <em class='x'>c</em>")[0] == ["a", "b c"]
    assert htmlmain.blocks("<div><p>a<p>b</div><script>never closed <p>c")[0] == ["a", "b"]
    assert htmlmain.blocks("<span class='ad'><span>x</span> y</span><p>z</p>")[0] == ["z"]
    assert htmlmain.blocks("<p>a</p><p class=b")[0] == ["a"]
    assert htmlmain.blocks("<p>a < b and c > d</p>")[0] == ["a < b and c > d"]
    assert htmlmain.host("https://u@Www.Example.com:80/x?y") == "www.example.com" and htmlmain.host(None) == "" and htmlmain.host("x") == ""


def test_malformed_pages():
    main = lambda x: htmlmain.blocks(x)[0]
    assert main("<html><head><title>t</title><body><article><p>hello</p></article>") == ["hello"]
    assert main("<html><head><title>t<body><article><p>hello</p>") == ["hello"]
    assert main("<article><div class='entry-header'><h1>Title</h1></div><p>one <label>two</label> <math>three</math> <span class='menu'>four</span></p></article>") == ["Title", "one two three four"]
    assert main("<div class='post-header'><h1>Title</h1></div><div class='site-header'>x</div><p>y</p>") == ["Title", "y"]
    assert main("<article><p title=\"a > b\">x</p><p data-x=\"never closed>y</p></article>") == ["x", "y"]
    assert main("<article><p>a</p><!-- never closed <p>b") == ["a"] and main("a<br>b <3 c</p") == ["a b <3 c"]
    for piece in ('<a "x ', "<div>", "</x>", "<title>", "<!--", '<a b=">" ', "<a b='", "<article><section></div>", "<svg>", "< ", "&", "<p class=ad>", "<script", '<i =" > '):
        began = time.perf_counter()
        htmlmain.blocks(piece * (1_000_000 // len(piece)))
        assert time.perf_counter() - began < 8, piece


class Plain(HTMLParser):
    """The text of an article with a standard parser, for pages that close what they open."""

    def __init__(self):
        super().__init__()
        self.inside, self.skip, self.parts, self.out = 0, 0, [], []

    def flush(self):
        self.out += [x] if (x := " ".join("".join(self.parts).split())) else []
        self.parts = []

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.skip += tag in ("script", "style")
        if tag == "br":
            self.parts.append(" ")
        elif tag in ("p", "h1", "h2", "h3", "ul", "ol", "li", "div", "table", "tr", "td", "blockquote", "pre"):
            self.flush()

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "h2", "h3", "ul", "ol", "li", "div", "table", "tr", "td", "blockquote", "pre", "article"):
            self.flush()
        self.inside -= tag == "article"
        self.skip -= tag in ("script", "style")

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.parts.append(data)


def plain_text(page):
    own = Plain()
    own.feed(page or "")
    own.close()
    return "\n\n".join(own.out)


def plain_repeats(streams, run):
    where = {}
    for i, s in enumerate(streams):
        for k in range(len(s) - run + 1):
            where.setdefault(tuple(s[k : k + run]), set()).add(i)
    return [[k + run <= len(s) and len(where[tuple(s[k : k + run])]) > 1 for k in range(len(s))] for s in streams]


def test_suffix_array_by_brute_force():
    rnd = random.Random(1)
    for run in (1, 2, 3, 6):
        streams = [[rnd.randrange(3) for _ in range(rnd.randrange(30))] for _ in range(8)]
        assert [x.tolist() for x in htmlmain.repeats(streams, run)] == plain_repeats(streams, run)
    assert htmlmain.repeats([], 3) == [] and [x.tolist() for x in htmlmain.repeats([[]], 3)] == [[]]


def test_hosts(spark):
    rnd = random.Random(2)
    say = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    notice, rows, want = say(9), [], {}
    for i in range(40):
        own = [say(12), say(3), say(20)]
        host = "one.example" if i < 30 else f"h{i}.example"
        rows.append((i, f"http://{host}/{i}", page(f"<div><p>{notice}</p><p>{own[0]}</p><p>{own[1]}</p></div><p>{own[2]}</p>"), "x"))
        want[i] = "\n\n".join(own if i < 30 else [notice, *own])
    rows += [(100, "http://one.example/a", ARTICLE, "x"), (101, None, None, "x"), (None, "http://one.example/b", page(f"<article><p>{notice}</p></article>"), "x")]
    want |= {100: "A <title>\n\nOne two three\n\nFour é é five\n\nx\n\ny\n\nLast &am", 101: "", None: notice}
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    for together in (500, 7):  # one share to a host, and several
        got = htmlmain.extract(pages, together=together).collect()
        assert {r.id: r.text for r in got} == want and len(got) == len(rows)
        assert all(r.n_chars == len(r.text) for r in got)
        assert {r.id for r in got if r.covered} == set(range(30))
    assert htmlmain.extract(pages.limit(0)).collect() == []


def test_article_text_that_footers_repeat(spark):
    """A sentence may stand in a host's footers and adverts, and in its articles too; there it stays."""
    line = "one two three four five six seven eight"
    body = f'<div class="ad">{line}</div><article><h1>{line}</h1><p>own</p><p>{line}</p></article><footer>{line}</footer>'
    pages = spark.createDataFrame([(i, "http://one.example/", page(body)) for i in range(20)], "page_id bigint, url string, html string")
    assert {r.text for r in htmlmain.extract(pages, together=4).collect()} == {f"{line}\n\nown\n\n{line}"}


def plain_marks(articles, run):
    """The runs that most of a host's different articles have."""
    lists = [[t for b in x for t in b.split(" ")] for x in {tuple(x) for x in articles if x}]
    have = [{"\x1f".join(t[i : i + run]) for i in range(len(t) - run + 1)} for t in lists]
    return {w for own in have for w in own if sum(w in x for x in have) > htmlmain.MOST * len(lists)} if len(lists) >= htmlmain.LEAST else set()


def test_boilerplate_in_articles(spark):
    """What most articles of a host have goes, if no class marks it too; copies and shared passages stay. Against all runs."""
    rnd = random.Random(3)
    say = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    call, passage, rows = say(10), say(60), []
    for i in range(60):
        name = "one.example" if i < 44 else "two.example" if i < 53 else "three.example"
        body = [say(15), *([passage] if i % 2 else []), say(25), *([call, "short"] if i % 11 else []), say(8)]
        rows.append((i, f"http://{name}/", page("<article>" + "".join(f"<p>{b}</p>" for b in body) + "</article>")))
    copy = "<article>" + "".join(f"<p>{say(20)}</p>" for _ in range(4)) + "</article>"
    rows += [(100 + i, "http://three.example/", page(copy)) for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    main = {i: htmlmain.blocks(x)[0] for i, _, x in rows}
    want = {}
    for name in ("one.example", "two.example", "three.example"):
        own = [i for i, u, _ in rows if htmlmain.host(u) == name]
        marks = plain_marks([main[i] for i in own], htmlmain.RUN)
        want |= {i: "\n\n".join(htmlmain.article_blocks(main[i], marks)) for i in own}
    for together in (500, 6):
        assert {r.id: r.text for r in htmlmain.extract(pages, together=together).collect()} == want
    assert call not in want[1] and passage in want[1] and call in want[45] and want[100] == "\n\n".join(main[100])
    assert htmlmain.article_blocks(["a b c d e f", "g h i"], {"a\x1fb\x1fc\x1fd\x1fe\x1ff"}) == ["a b c d e f", "g h i"]  # more than half


def test_odd_tables(spark):
    rows = [(1, None, None, "x"), (1, None, None, "x"), (None, "http://a.example/", "<p>a</p>", None), (2, "no url", "", "y"), (3, "http://a.example/", "<article>" + "word " * 200_000 + "</article>", "z")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string").withColumnRenamed("host", "text")
    got = htmlmain.extract(pages).collect()
    assert sorted((r.id or 0, r.n_chars) for r in got) == [(0, 1), (1, 0), (1, 0), (2, 0), (3, 999_999)]


def test_query(spark, sf_dir):
    """Every page of the table against a standard parser, and the boilerplate of its host by all runs."""
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    by_host = {}
    for _, u, x in rows:
        by_host.setdefault(htmlmain.host(u), []).append(plain_text(x).split("\n\n"))
    marks = {h: plain_marks(x, htmlmain.RUN) for h, x in by_host.items()}
    want = {i: "\n\n".join(htmlmain.article_blocks(plain_text(x).split("\n\n"), marks[htmlmain.host(u)])) for i, u, x in rows}
    got = queries.op5_html(spark, sf_dir).collect()
    assert len(got) == len(rows) and {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) > 0 for r in got)
