import pytest
from helpers import with_clashes

from cadence.llm import html_text as h

LONG = "This is a sentence of the article. " * 8

CASES = [
    ("", ""), ("plain text", "plain text"), ("<p>a<b>b</b>c<br>d &amp; e&nbsp;f</p>\n\n<p>g", "abc d & e f g"),
    (f"<nav><a>menu</a></nav><article><h1>T</h1><p>{LONG}<p>x</article><footer>foot</footer>", f"T {LONG}x"),
    (f"<div class='cookie-notice'>{LONG}</div><div id=main><p>{LONG}</p><div class='comments'><p>{LONG}</p></div></div>", LONG.strip()),
    (f"<body><aside>{LONG}</aside><main><header>H</header><p>{LONG}</p><form>{LONG}</form></main></body>", LONG.strip()),
    (f"<script>var a='<p>{LONG}</p>';</script><style>p{{}}</style><p>{LONG}", LONG.strip()),
    (f"<div class=ad>{LONG}</div>", ""), (f"<article><p>{LONG}<!-- c --><p>{LONG}", f"{LONG}{LONG}".strip()),
    ("<p>&lt;tag&gt; &eacute;&#233;&#x1F600; &am</p>", "<tag> éé😀 &am"),
    (f"<ul><li><p>{LONG}<li>two</ul>", f"{LONG}two"), ("<p>a</b></i></div></p>b", "a b"),
]


@pytest.mark.parametrize("html,want", CASES)
def test_cases(html, want):
    assert h.main_text(html) == want


def test_rows(spark):
    rows = [(1, "u", CASES[3][0]), (1, "u", CASES[3][0]), (None, None, None), (2, "v", ""), (3, "w", f"<p>{'word ' * 100_000}</p>")]
    got = h.extract(with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(((i, u, t := h.main_text(x or ""), len(t)) for i, u, x in rows), key=repr)
    assert max(r["n_chars"] for r in got) == 499_999
    assert h.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_article_of_every_page(spark):
    """The pages of the table, against their markup: the article's text and nothing else."""
    import html as entities
    import re
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in h.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.search(r"(?s)<article>(.*?)(</article>|$)", r["html"])[1]
        spaced = re.sub(r"<(?!/?b>)[^>]+>", " ", article)
        assert r["text"] == " ".join(entities.unescape(re.sub(r"</?b>", "", spaced)).split())


SHORT = "A lead of the text in its own box. "

WRAPPED = [
    f"<body class='has-sidebar'><p>{LONG}</p></body>", f"<html class='no-cookies'><body id='page-header'><p>{LONG}</p></body></html>",
    f"<div class='content with-sidebar'><p>{LONG}</p><div class='sidebar'>{LONG}</div></div>",
    f"<article class='post no-comments'><p>{LONG}</p></article>", f"<main class='widget'><p>{LONG}</p></main>",
    f"<div class='two-sidebar'><article><p>{LONG}</p></article></div>", f"<div class='page_ads'><p>{LONG}</p><nav>menu</nav></div>",
    f"<div class='sidebar-left'>{SHORT}</div><div><p>{LONG}</p></div><div class='comment-list'>{SHORT}</div>",
    f"<article><p>{LONG}</p></article><div class='post-comments'>{LONG}{LONG}</div>", f"<div class='ad-free'><p>{LONG}</p></div>",
]


@pytest.mark.parametrize("html", WRAPPED)
def test_names_of_layout_are_no_furniture(html):
    assert h.main_text(html) == LONG.strip()


def test_containers_beside_the_region():
    body = "".join(f"<p>{LONG}</p>" for _ in range(24))
    page = f"<body><div><a>x</a> <a>y</a></div><div class='lead'><p>{SHORT * 16}</p></div><div>{body}</div><div><a>u</a> <a>v</a></div></body>"
    assert h.main_text(page) == f"{SHORT * 16}{LONG * 24}".strip()
    assert h.main_text(f"<article>{body}</article><div>{SHORT * 16}</div>") == (LONG * 24).strip()
