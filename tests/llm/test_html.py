import random
from itertools import product

from quiverlake.llm import html_extract as H

LONG = "This sentence has a good number of plain words in it, as articles have. "


def test_article_only():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
    <div class="cookie-notice"><p>{LONG}</p></div><header><a href=/>Home</a> {LONG}</header><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav><!-- <p>no</p> -->
    <div class="ad">Buy a thing now.</div><article><h1>Title &amp; more</h1><p><b>{LONG}<br><p>Short.</p><p>a&nbsp;&lt;b&gt;
      c &#233;</p></article><aside><p>{LONG}</p></aside><form><p>{LONG}</p><input></form><section id="comments"><p>{LONG}</p></section><footer>&copy; me</footer></body></html>"""
    assert H.main_text(page) == f"Title & more\n{LONG.strip()}\nShort.\na <b> c é"


def test_without_article_element():
    page = f"<body><ul class=menu><li><a href=x>Home</a></ul><div><p>{LONG}<p>{LONG}<p>Brief one.<p>{LONG}</div><div class='footer'>x y</div><div><a href=a>more</a> <a href=b>links</a></div>"
    assert H.main_text(page) == "\n".join([LONG.strip(), LONG.strip(), "Brief one.", LONG.strip()])


def test_broken_markup():
    assert H.main_text(None) == "" and H.main_text("") == ""
    assert H.main_text(f"<article><p>{LONG}<p>cut <b") == f"{LONG.strip()}\ncut"
    assert H.main_text(f"<article><p>{LONG}</p><script>x") == LONG.strip()
    assert H.main_text(f"<article><p>{LONG}</p><!-- x") == LONG.strip()
    assert H.main_text(f"<article><p>{LONG} 1 < 2 <3</p>") == f"{LONG}1 < 2 <3".replace("  ", " ")
    assert H.main_text(LONG) == LONG.strip()
    assert H.main_text('<article><p title="a > b">x words here.</p>') == "x words here."
    assert H.main_text(f"<article>{'<div>' * 3000}<p>{LONG}") == LONG.strip()
    many = "".join(f"<p>{LONG}{i}.</p>" for i in range(20_000))
    assert H.main_text(f"<article>{many}</article>").count("\n") == 19_999


def test_minimum_cut_against_enumeration():
    rng = random.Random(7)
    for _ in range(150):
        n = rng.randrange(1, 9)
        scores = [rng.uniform(-2, 2) for _ in range(n)]
        edges = {(i, j): rng.uniform(0, 2) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}

        def cost(side, scores=scores, edges=edges):
            return sum(max(s, 0) if not k else max(-s, 0) for s, k in zip(scores, side, strict=True)) + sum(w for (i, j), w in edges.items() if side[i] != side[j])

        best = min(cost(x) for x in product([False, True], repeat=n))
        assert abs(cost(H.minimum_cut(scores, edges)) - best) < 1e-9


def test_the_cut_decides(small):
    """Neither the blocks' own signs nor containers alone give the articles: the cut changes labels on most given pages."""
    import pyarrow.parquet as pq

    pages = [p["html"] for p in pq.read_table(f"{small}/pages.parquet").to_pylist()]
    changed = 0
    for page in pages:
        found = H.blocks_of(page)
        scores, edges = H.graph_of(found)
        kept = H.minimum_cut(scores, edges)
        by_sign = "\n".join(b[0] for b, s in zip(found, scores, strict=False) if s > 0)
        changed += by_sign != H.main_text(page)
        assert kept == H.minimum_cut(scores, edges, 0)  # settling first changes nothing
    assert changed >= 0.8 * len(pages)
    # a fluent advert inside an article goes, a one-word paragraph stays, a container of links alone goes
    body = f"<p>{LONG}</p><p>Er.</p><div class=ad>{LONG}</div><p>x</p><p>{LONG}</p>"
    assert H.main_text(f"<article>{body}</article>") == "\n".join([LONG.strip(), "Er.", "x", LONG.strip()])
    assert H.main_text("<article>" + "<p><a href=x>Read</a></p>" * 9 + "</article>") == ""
    assert H.main_text(f"<div hidden><article><p>{LONG}</p></article></div><p>{LONG}</p>") == LONG.strip()


def test_time_grows_with_the_page():
    import time

    odd = ["<div>" * 200_000, "<div>" * 1000 + "</p>" * 200_000, "<ul><li>" + "<div>" * 1000 + "<li></li>" * 90_000, "<p \"'>x " * 100_000, "<div><p>x" * 80_000]
    for page in odd:
        began = time.process_time()
        H.main_text(page)
        assert time.process_time() - began < 30


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", f"<p>{LONG}", 3)], "page_id long, text string, html string, N_chars int")
    assert H.extract(df, ["page_id", "text", "N_chars"]).collect() == [(1, LONG.strip(), len(LONG.strip()))]


def test_query(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (1, "u", f"<article><p>{LONG}é𝒜", "x"), (2, "u", f"<article><p>{LONG}é𝒜", "x")], "page_id long, url string, html string, text string")
    rows = sorted(H.extract(df, ["page_id", "url"]).collect(), key=str)
    assert [(r.page_id, r.url, r.n_chars) for r in rows] == [(1, "u", len(LONG) + 2), (1, None, 0), (2, "u", len(LONG) + 2)] or {r.n_chars for r in rows} == {0, len(LONG) + 2}
    assert H.extract(df.limit(0), ["page_id"]).count() == 0


def test_given_pages_keep_whole_articles(spark, small):
    """The article is what stands between its tags, by a plain reading of the given pages."""
    import html
    import re

    import pyarrow.parquet as pq

    pages = pq.read_table(f"{small}/pages.parquet").to_pylist()
    for p in pages:
        body = re.search(r"<article>(.*?)(</article>|$)", p["html"], re.S)[1]
        body = re.sub(r"<[^>]*$", "", body)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", " " if "br" in x else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert H.main_text(p["html"]) == "\n".join(x for x in parts if x)
