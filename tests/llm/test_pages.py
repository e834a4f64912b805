import pytest
from pyspark.sql import functions as F

from tidemark.llm import site_style_tree as sst

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>if(a<b){"</p>"}</script></head><body class="ad">
<header><h1>Site</h1></header><nav><ul><li>m<li>n</ul></nav><div class="cookie-notice">We use</div>
<article><h1>One &amp; two</h1><p>a <b>b</b>
 c<br>d<p>e &lt; f<ul><li>g<li>h</ul><form>x</form><div id="comments"><article><p>no</p></article></div></article>
<aside>s</aside><footer>f</footer>"""


def text(page, cut=frozenset()):
    return "\n\n".join(sst.blocks(sst.parsed(page), cut))


@pytest.mark.parametrize("page, want", [
    (PAGE, "One & two\n\na b c d\n\ne < f\n\ng\n\nh"), ("", ""), ("plain  text", "plain text"), ("<p>a<p>b", "a\n\nb"),
    ("<div>a<!-- x --><script>1</script>b</div>", "ab"), ("<p>a</p></p></div>b", "a\n\nb"),
    ("<main><p>x</p></main><p>y</p>", "x"), ("a < b <c", "a < b"), ("<p title='>'>q</p>", "q"), ("<p hidden>q</p>r", "r"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n\n2\n\n3"), ("<p>x<!-- never closed", "x"), ("<div role=search>s</div>t", "t"),
    ("<article><p>1</p></article><article><p>2</p></article>", "1\n\n2"), ("<p>&#20320;&nbsp;&copy;</p>", "你 ©")])
def test_blocks(page, want):
    assert text(page) == want


STORY = "<p>A story of some length, told in a sentence</p>"


@pytest.mark.parametrize("page, want", [
    (f'<nav>m</nav><article class="post widget">{STORY}</article>', "S"), (f'<div id="content" class="has-sidebar">{STORY}</div>', "S"),
    (f'{STORY}<p>One <a class="related">link</a> inside</p>', "S\n\nOne link inside"), (f'{STORY}<div class="share-price">Up 3</div>', "S\n\nUp 3"),
    (f'{STORY}<div class="notice-of-hearing">At noon</div>', "S\n\nAt noon"), (f'{STORY}<div class="cookie-notice">We use</div>', "S"),
    (f'{STORY}<div id="top_menu">Home</div><div class="x ad-box-3">Buy</div>', "S"), (f'<div class="comments">{STORY * 3}</div>{STORY}', "S"),
    (f'<div class="menu"><a>One long link</a> <a>another long link that goes on for a while</a></div>x', "x"),
    (f'<div class="widget"><div class="promo">Buy</div>{STORY}</div>', "S"), ('<div class="ad">Buy</div><div class="ad">now</div>', ""),
    (f'<div hidden class="main">{STORY * 2}</div>{STORY}', "S")])
def test_a_class_is_evidence_and_no_verdict(page, want):
    assert text(page) == want.replace("S", STORY[3:-4])


def test_deep_and_odd_pages_end():
    for page in ("<div>" * 50_000 + "x", "<p><b>" * 20_000, "<a href=\"" * 20_000, "<" * 50_000, "</div>" * 50_000, "<li>" * 30_000,
                 "<div class=ad>x" * 20_000):
        text(page)
        sst.elements(sst.parsed(page))


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_cut", F.lit(1)).withColumn("host", F.lit(2))


def test_low_branches_of_a_site_are_cut(spark):
    rows = [(i, f"http://a.org/{i}", f"<body><div class=box>Same on all</div><div class=txt><p>Page {i} says {i * 7}</p></div></body>")
            for i in range(30)]
    rows += [(100, "http://b.org/x", "<body><div class=box>Same on all</div><p>Lone</p></body>"), (101, None, "<p>z"),
             (102, "http://a.org/9", None), (102, "http://a.org/9", None)]
    df = pages(spark, rows)
    out = sst.extracted(df)
    assert out.columns[:-2] == df.columns
    got = {r["page_id"]: r[-2] for r in out.collect()}
    assert out.count() == len(rows)
    assert got[3] == "Page 3 says 21" and got[100] == "Same on all\n\nLone" and got[101] == "z" and got[102] == ""
    assert all(r[-1] == len(r[-2]) for r in out.collect())
    assert sst.extracted(pages(spark, [])).count() == 0


def test_a_branch_on_few_pages_of_a_large_host_is_cut(spark):
    menu = "<div class=box>A section's menu</div>"
    rows = [(i, f"http://a.org/{i}", f"<body>{menu if i < 9 else ''}<div class=txt><p>Page {i} says {i * 7}</p></div></body>")
            for i in range(900)]
    got = {r["page_id"]: r[-2] for r in sst.extracted(pages(spark, rows)).collect()}
    assert got == {i: f"Page {i} says {i * 7}" for i, *_ in rows}


def test_copies_of_an_article_are_no_furniture(spark):
    rows = [(i, f"http://a.org/{i}", "<body><div class=txt>One text in many copies</div></body>") for i in range(40)]
    assert {r[-2] for r in sst.extracted(pages(spark, rows)).collect()} == {"One text in many copies"}


@pytest.mark.parametrize("url, host", [
    ("https://A.org:80/x", "a.org"), ("//u@b.c/", "b.c"), ("http://x.y?q", "x.y"), ("nothing", ""), (None, None)])
def test_host(spark, url, host):
    df = spark.createDataFrame([(url,)], "url string")
    assert df.select(sst.host_of(F.col("url"))).first()[0] == host
