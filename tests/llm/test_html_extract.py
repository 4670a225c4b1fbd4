from linewell.llm import html_extract as hx
from tests.llm.conftest import rows_of


def text(html):
    p = hx.Page(html)
    return p.text(p.choice())


def test_page_parts():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><a href="/">menu</a></nav><header><h1>Site</h1></header>
      <div class="cookie-notice">We use cookies and like to say so at length, again and again</div><aside>side text</aside>
      <article><header><h1>Head &amp; line</h1></header><p>One <b>bold</b>
      word&nbsp;here<p>Two<br>lines<ul><li>item 1<li>item <i>2</i></ul><script>var x = "</p>";</script><form><input value=x>send</form><!-- <p>no</p> -->
      <table><tr><td>a<td>b<tr><td>c</table></article><div id="comments"><p>Reader says a lot of things here, more than the article does, to be sure of that.</p></div><footer>&copy; x</footer></body></html>"""
    assert text(page) == "Head & line\nOne bold word here\nTwo lines\nitem 1\nitem 2\na\nb\nc"


def test_broken_markup():
    assert text("") == "" and text("just text") == "just text" and text("a < b & c") == "a < b & c"
    assert text("<p>open <b>never closed<p>next</i></div>") == "open never closed\nnext"
    assert text("<script>never closed <p>x") == "" and text("<!-- never closed") == ""
    assert text('<div title="a > b"><p>x</p></div>') == "x" and text("<p>&#x41;&#66;&unknown;") == "AB&unknown;"
    assert text("<article><p>" + "w " * 200_000 + "</p></article>") == " ".join(["w"] * 200_000)


def pages(spark):
    long = "<p>" + "long text of the article " * 20 + "</p>"
    body = "<html><body><div class='x'>{}</div><div class='post-{}'>{}</div></body></html>"
    rows = [(k, "http://h.org/%d" % k, body.format("other words", k, long)) for k in range(5)]
    rows += [(5, "http://H.org/5", body.format("words that are more than the short post has", 9, "<p>short</p>")),  # the host's path wins over its own choice
             (6, "http://h.org/6", "<html><body><section><p>no such path</p></section></body></html>"), (7, "http://h.org/7", body.format("only here", 1, "")),
             (8, None, "<p>no url</p>"), (9, "http://h.org/9", None), (10, "http://h.org/10", ""), (None, "x", "<p>n</p>"), (8, None, "<p>no url</p>")]
    return rows, spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, path string")


def test_consensus(spark):
    rows, df = pages(spark)
    got = {(r.page_id, r.url, r.text, r.n_chars) for r in hx.extract(df).collect()}
    article = ("long text of the article " * 20).strip()
    want = {(k, u, article if k is not None and k < 5 else {5: "short", 6: "no such path", 7: "only here", 8: "no url", None: "n"}.get(k, "")) for k, u, _ in rows}
    assert got == {(k, u, t, len(t)) for k, u, t in want} and hx.extract(df).count() == len(rows)
    assert dict(rows_of(hx.winners(df)))["h.org"] == ">html>body>div.post-"
    assert hx.extract(df.limit(0)).collect() == []


def test_articles_of_the_given_pages(spark, sf):
    import html
    import re
    out = {r.page_id: r.text for r in hx.extract(spark.read.parquet(f"{sf}/pages.parquet")).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert out[r.page_id] == "\n".join(b for b in blocks if b)
