"""Main texts: alignment against the plain recurrence, pages with and without markup that says where the article is."""

import random

import pytest

from tamis.llm import pages
from tamis.llm.pages import lines_of, main_text, main_texts, shared

OWN = ["A quiet harbour lies here.", "Boats come home at seven.", "The lamp is lit at nine."]


def plain_length(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("bits", [4, 1 << 28])
def test_alignment(monkeypatch, bits):
    monkeypatch.setattr(pages, "ALIGNED_BITS", bits)
    draw = random.Random(3)
    for _ in range(400):
        a, b = ([draw.randrange(5) for _ in range(draw.randrange(14))] for _ in range(2))
        at, rest = shared(a, b), iter(b)
        assert len(at) == plain_length(a, b) and at == sorted(set(at))
        assert all(any(y == a[i] for y in rest) for i in at)  # in the order of b, too


def test_lines():
    source = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a = "</p>";</script></head><body class="has-sidebar">
    <nav><ul><li><a href="/a">Menu</a></ul></nav><!-- <p>hidden</p> --><div class="ad">Buy</div><div id="cookieNotice">Cookies!</div>
    <article class="post"><h1>Title &amp; more</h1><p><b>one<br>two <i>th</i>ree<p>f&#xFC;nf\n\n sechs &lt;b&gt;</p><aside>Side</aside><p>last</p>
    <div class="share-buttons">Share it</div></article><article class="comment"><p>Nice!</p></article><form>Mail <input> <button>Go</button></form>
    <footer>&copy; us</footer></body>"""
    assert main_text(lines_of(source), set()) == "Title & more one two three fünf sechs <b> last"
    assert main_text(lines_of("no <b>mark</b>up"), set()) == "no markup" and lines_of("") == []
    assert main_text(lines_of('<div class="nav">m<div>x</div></div><div class="entry-content"><p>in</div><p>out'), set()) == "in"
    assert main_text(lines_of("<p class=ad>Buy<p>text</p> tail <script>never ends"), set()) == "text tail"


def test_long_and_broken_markup_takes_linear_time():
    import time

    for piece in ("<a ", "<b>", '<a "', "<script ", "</i>", "<!-", "&amp;", "<p><b>", "<div class='ad'>x"):
        took = []
        for n in (4000, 32000):
            start = time.perf_counter()
            lines_of(piece * n)
            took.append(time.perf_counter() - start)
        assert took[1] < 40 * max(took[0], 0.002), piece


def page(lines, before=("Our house", "Home | News"), after=("All rights kept", "Made by hand")):
    return "<html><body>" + "".join(f"<div>{x}</div>" for x in (*before, *lines, *after)) + "</body></html>"


def test_templates_of_a_host_go(spark):
    rows = [(i, f"https://h.example/a/{i}?x=1", page([f"{x} {i}" for x in OWN])) for i in range(20)]
    rows += [(100, "https://alone.example/a", page(OWN)), (101, None, page(OWN)), (102, "https://h.example/b", None), (103, "//x.example/", ""), (None, "https://h.example/a/3", page([f"{x} 3" for x in OWN]))]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as lines", "2 as digest", "3 as place")
    got = {r["page_id"]: r for r in main_texts(frame.repartition(3)).collect()}
    for i in range(20):
        assert got[i]["text"] == " ".join(f"{x} {i}" for x in OWN) and got[i]["n_template"] >= 4, got[i]
    whole = " ".join(("Our house", "Home | News", *OWN, "All rights kept", "Made by hand"))
    assert got[100]["text"] == got[101]["text"] == whole and got[102]["text"] == got[103]["text"] == "" and got[103]["n_chars"] == 0
    assert got[None]["text"] == got[3]["text"]
    assert main_texts(frame.limit(0)).collect() == []


def test_copies_and_quotes_stay(spark):
    quoted = "<article>" + "".join(f"<p>{x}</p>" for x in OWN) + "</article>"
    rows = [(1, "http://c.example/1", page(OWN)), (2, "http://c.example/2", page(OWN)), (3, "http://c.example/2", page(OWN))]
    rows += [(i, f"http://q.example/{i}", f"<div>top</div>{quoted}<div>own {i}</div>") for i in (4, 5)] + [(6, "http://q.example/6", f"<div>top</div><article><p>{OWN[0]}<p>new</article>")]
    got = {r["page_id"]: r["text"] for r in main_texts(spark.createDataFrame(rows * 2, "page_id long, url string, html string")).collect()}
    assert OWN[1] in got[1] and got[1] == got[2] == got[3]  # copies say nothing about each other
    assert got[4] == got[5] == " ".join(OWN) and got[6] == OWN[0] + " new"


def test_query_gives_the_articles(spark):
    """The generated pages have an article whose text, heading aside, is that of a document."""
    from tamis.llm.queries import op11_main_texts

    top = "/root/testdata/sf0.01"
    docs = {" ".join(r["text"].split()) for r in spark.read.parquet(f"{top}/documents.parquet").select("text").collect()}
    heads = {r["page_id"]: r["h"] for r in spark.read.parquet(f"{top}/pages.parquet").selectExpr("page_id", "regexp_extract(html, '<h1>(.*?)</h1>', 1) as h").collect()}
    import html

    for r in op11_main_texts(spark, top).collect():
        head = " ".join(html.unescape(heads[r["page_id"]]).split())
        assert r["text"].startswith(head) and r["text"][len(head) + 1 :] in docs and r["n_chars"] == len(r["text"])


def test_little_is_moved(spark):
    """Scripts and markup, which no text has, stay where they are read, and texts are moved compressed."""
    import time

    draw = random.Random(8)
    word = lambda n: "".join(draw.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n))
    rows = []
    for i in range(1500):
        own = " ".join(draw.choices(["harbour", "boats", "lamp", "seven", "nine"], k=150)) + f" {i}"
        rows.append((i, f"http://m.example/{i}", f"<script>{word(3000)}</script><div>Top</div><div data-x='{word(500)}'>{own}</div>", own))
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, own string").repartition(4).checkpoint()
    written = lambda: time.sleep(1) or spark._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    got = main_texts(frame).collect()
    assert 0 < written() - before < 0.4 * sum(len(r[2]) for r in rows)
    assert {r["page_id"]: (r["text"], r["n_template"]) for r in got} == {r[0]: (r[3], 1) for r in rows}
