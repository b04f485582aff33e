import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultsift.llm.html_text import extract, main_text, smoothed

LONG = "A long sentence of the article that goes on for a while. " * 4
CASES = [
    (f"<body><nav><ul><li>Home</li></ul></nav><article><h1>Title</h1><p>{LONG}<p>Short.<p><b>Bold &amp; <i>it</i><br>next</b></article><footer>f</footer>",
     ["Title", LONG.strip(), "Short.", "Bold & it next"]),
    (f"<div class='top menu'>m</div><div id=content><h2>T</h2><div>{LONG}</div><ul><li>one</li><li>two</li></ul></div><div class='sidebar'>{LONG}</div>",
     ["T", LONG.strip(), "one", "two"]),
    (f"<main><header><h1>T</h1></header><p>{LONG}</p><aside>{LONG}</aside><div class='cookie-notice'>c</div><form><p>f</p></form><section id='comments'><p>{LONG}</p></section></main>",
     ["T", LONG.strip()]),
    (f"<body><header>site</header><div class=article><p>{LONG}</p><script>var a = '<p>x</p>';</script><style>p{{}}</style><!-- c --><p>&lt;b&gt; &eacute; &#8364;</p></div></body>",
     [LONG.strip(), "<b> é €"]),
    (f"<article><p>{LONG}</p><div class='ad'>buy</div><p>end", [LONG.strip(), "end"]),
    ("", []),
    ("<nav>only a menu</nav>", []),
    ("plain text", ["plain text"]),
    ("<p>a\n\t b</p>", ["a b"]),
    ("<p>unclosed <b", ["unclosed"]),
]


@pytest.mark.parametrize("html, lines", CASES)
def test_main_text(html, lines):
    assert main_text(html) == "\n".join(lines)


def test_columns(spark):
    df = spark.createDataFrame([(1, None), (2, CASES[0][0]), (2, CASES[0][0])], "page_id long, html string").withColumns({"text": F.lit(5), "n": F.lit(1)})
    got = extract(df)
    assert got.columns == ["page_id", "html", "n", "text"]
    assert sorted((r["page_id"], r["text"]) for r in got.collect()) == [(1, ""), *[(2, "\n".join(CASES[0][1]))] * 2]
    assert extract(df.limit(0)).count() == 0
    assert len(main_text("<article>" + "<p>word</p>" * 20_000)) == 20_000 * 5 - 1


PARA = f"<p>{LONG}</p>"
NAMES = [
    ("content has-sidebar", 3), ("market-share-report", 3), ("legal-history", 3), ("no-ads", 3), ("site-footer", 2), ("sidebar-left", 2),
    ("post-comments", 2), ("ad", 2), ("cookie banner", 2),
]


@pytest.mark.parametrize("name, n", NAMES)
def test_names_weigh(name, n):
    html = f"<body><div><div>{PARA}</div><div class='{name}'>{PARA}</div><div>{PARA}</div></div></body>"
    assert len(main_text(html).split("\n")) == n


def test_nested_inline_elements_stay_in_their_mark():
    html = "<article><p>Words before it <span class='ad'>buy <span>now</span> tail</span> and words after.</p></article>"
    assert main_text(html) == "Words before it and words after."


def test_region_grows_to_headings_and_siblings():
    assert main_text(f"<div id=content><h1>T</h1><div class=body>{PARA}{PARA}</div></div>").startswith("T\n")
    teaser = f"<body><div id=x><h1>Main</h1>{PARA * 3}</div><article><p>A teaser card.</p></article></body>"
    assert main_text(teaser).startswith("Main\n" + LONG.strip())


def test_ratio_and_threshold_select():
    links = "".join(f"<li><a href='{i}'>link {i}</a></li>" for i in range(12))
    html = f"<body><div><ul>{links}</ul></div><div><h2>T</h2>{PARA * 4}</div><div><ul>{links}</ul></div></body>"
    assert main_text(html) == "\n".join(["T", *[LONG.strip()] * 4])
    assert "link 3" in main_text(html, threshold=0.0)
    assert main_text(html, threshold=20.0) == ""
    # without smoothing, a short line that its name weighs down a little falls below the threshold
    weak = f"<body><div>{PARA * 2}<p class='search-note'>See it.</p>{PARA * 2}</div></body>"
    assert "See it." in main_text(weak) and "See it." not in main_text(weak, sigma=1e-3)


FRAMES = [
    "<form id='aspnetForm'>{}</form>", "<div class='layout sidebar-right'>{}<div class='sidebar'><p>Side.</p></div></div>", "<div class='text-widget'>{}</div>",
    "<div class='elementor-widget elementor-widget-theme-post-content'><div class='elementor-widget-container'>{}</div></div>",
]


@pytest.mark.parametrize("frame", FRAMES)
def test_what_frames_the_page_is_no_boilerplate(frame):
    inner = f"<div><h1>T</h1>{PARA * 3}<p>Short.</p></div><div class='comments'>{PARA * 9}</div>"
    assert main_text(f"<body><nav>menu</nav>{frame.format(inner)}<form><p>Sign up here.</p></form></body>") == "\n".join(["T", *[LONG.strip()] * 3, "Short."])


def test_paragraphs_that_are_widgets():
    assert main_text("<body>" + f"<div class='text-widget'>{PARA}</div>" * 4 + "</body>") == "\n".join([LONG.strip()] * 4)
    assert main_text("<body><div class='cookie-notice'><p>We use cookies.</p></div></body>") == ""


def test_responses_of_readers_and_titles_beside_the_body():
    assert main_text(f"<article>{PARA * 2}<section class='reader-responses'>{PARA * 5}</section></article>") == "\n".join([LONG.strip()] * 2)
    html = f"<body><header><p>Site</p></header><div class='post'><header class='entry-header'><h1>T</h1></header><div class='entry-content'>{PARA * 2}</div></div></body>"
    assert main_text(html) == "\n".join(["T", *[LONG.strip()] * 2])


def test_links_at_the_end_stay_or_go_together():
    links = "<ul><li><a href='1'>First story that is linked</a></li><li><a href='2'>Second story that is linked</a></li></ul>"
    assert main_text(f"<article>{PARA * 3}{links}</article>") == "\n".join([LONG.strip()] * 3)
    assert "linked" in main_text(f"<article>{PARA * 3}{links}{PARA}</article>")
    assert main_text(f"<article>{PARA * 3}<p><a href='1'>The whole report</a></p></article>").endswith("The whole report")


def test_smoothing_against_brute_force():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 40):
        x = rng.random(n) * 5
        want = [sum(x[j] * np.exp(-0.5 * ((i - j) / 1.5) ** 2) for j in range(n) if abs(i - j) <= 5) for i in range(n)]
        norm = [sum(np.exp(-0.5 * ((i - j) / 1.5) ** 2) for j in range(n) if abs(i - j) <= 5) for i in range(n)]
        assert np.allclose(smoothed(x, 1.5), np.array(want) / norm)


def test_work_grows_with_the_length():
    began = time.time()
    assert len(main_text("<div>x words " * 50_000).split("\n")) == 50_000
    assert main_text("<div>" * 50_000 + "</span></p></x>" * 50_000 + PARA) == LONG.strip()
    assert len(main_text("<article>" + PARA * 20_000)) > 4_000_000
    assert main_text("<b><div>" + "<i>" * 50_000 + "</u>" * 50_000 + "</b>x" * 50_000) == "x" * 50_000
    assert main_text("<table><tr><td><ul>" + "<x>" * 50_000 + "<td>y</td>" * 50_000) == "\n".join("y" * 50_000)
    assert time.time() - began < 60
