"""Main texts of pages of many layouts, the parts that stay told from those that go."""

from __future__ import annotations

import numpy as np
import pytest

from duebook.llm.main_text import Lines, content_mass, extract_main_text, main_text, smoothed
from tests.llm.conftest import CLASHING

P = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore."
MENU = "<ul><li><a href=1>Home</a></li><li><a href=2>News</a></li><li><a href=3>About</a></li></ul>"

PAGES = {
    "article": (f"<nav>{MENU}</nav><div class=ad>Buy.</div><article><h1>T</h1><p>{P}</p><p>Short.</p></article>"
                "<footer>&copy; us</footer>", ["T", P, "Short."]),
    "unclosed paragraphs": (f"<article><h1>T</h1><p><b>T<br><p>{P}<p>x</article>", ["T", "T", P, "x"]),
    "unclosed article": (f"<article><p>{P}<footer>foot</footer>", [P]),
    "article with a header, aside and footer of its own": (
        f"<header><h1>Site</h1></header><main><article><header><h1>T</h1></header><p>{P}</p><aside>Ad</aside>"
        f"<ul><li>one</li><li>two</li></ul><footer>tags</footer></article><section class='comments'><p>{P}</p></section>"
        f"</main><aside><p>{P}</p></aside>", ["T", P, "one", "two"]),
    "content by name": (f"<div id=header>Site</div><div id=nav>{MENU}</div><div id='content'><p>{P}</p><div>end</div></div>"
                        f"<div id=sidebar><p>{P}</p></div><div class=footer>(c)</div>", [P, "end"]),
    "content by its ratio": (f"<div>{MENU}</div><div class=x1><div class=x2><p>{P}</p><p>{P}</p><p>x</p></div></div>"
                             "<div><a href=4>Imprint</a></div>", [P, P, "x"]),
    "table layout": (f"<table><tr><td>{MENU}</td><td><p>{P}</p>{P}<br>line</td></tr></table>", [P, P + " line"]),
    "notice larger than the article": (f"<div class='cookie-notice'><p>{P}{P}</p></div><article><p>Hi.</p></article>", ["Hi."]),
    "comments as articles": (f"<article><p>{P}</p></article><div id=comments><article class=comment><p>{P} {P}</p></article></div>", [P]),
    "layout in a name": (f"<div class='wrapper with-sidebar'><div class=article-body><p>{P}</p></div></div>", [P]),
    "a name given to the whole page": (f"<div class=sidebar><p>{P}</p></div>", [P]),
    "scripts, styles, forms": (f"<article><p>a<script>x='</p><p>no'</script>b</p><style>p{{}}</style><form><label>N</label>"
                               "<input><button>Go</button></form><noscript>n</noscript><p>end</p></article>", ["ab", "end"]),
    "references and white space": ("<article><p> &lt;b&gt;\n\t&#233;&nbsp;&#x1F600; AT&T &copy; </p></article>", ["<b> é 😀 AT&T ©"]),
    "inline elements": ("<article><p>a<b>b</b>c <i> d </i> e</p></article>", ["abc d e"]),
    "comments of the markup": ("<article><p>a<!-- <p>x</p> -->b</p><!-- never closed <p>y</article>", ["ab"]),
    "no markup": ("just text &amp; more\n\n here", ["just text & more here"]),
    "boilerplate alone": (f"<nav>{MENU}</nav><footer>x</footer>", []),
    "empty": ("", []), "null": (None, []), "broken": ("<", ["<"]), "tags alone": ("</p></div><br><hr/>", []),
}


@pytest.mark.parametrize("name", PAGES)
def test_layout(name):
    html, blocks = PAGES[name]
    assert main_text(html) == "\n\n".join(blocks)


def test_rows(spark):
    """Nulls, repeated rows, very long and deep pages, clashing columns; an empty table."""
    long = f"<article>{'<p>word word</p>' * 30_000}</article>"
    rows = [(1, "u", long), (1, "u", long), (2, None, None), (None, "v", f"<p>{P}</p>"), (3, "w", "<div>" * 20_000 + "deep"),
            (4, "x", "<p>" + "very " * 500_000)]
    columns = f"page_id long, url string, html string, {CLASHING.replace('n long', 'text long')}"
    extra = (1, 2, 3, 4, 0.5, 6, "x", 8, "y")
    got = extract_main_text(spark.createDataFrame([(*r, *extra) for r in rows], columns))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = sorted(((r.page_id, r.url, r.text) for r in got.collect()), key=str)
    assert found == sorted(((i, u, main_text(h)) for i, u, h in rows), key=str)
    assert main_text(long) == "\n\n".join(["word word"] * 30_000)
    assert all(r.n_chars == len(r.text) for r in got.collect())
    assert extract_main_text(spark.createDataFrame([], columns)).count() == 0


def test_ratios():
    """Weights add up to one also at the ends; a long line stands out, its neighbours rise, links count for nothing."""
    assert np.allclose(smoothed(np.ones(7)), 1)
    level = smoothed(np.array([0, 0, 0, 90.0, 0, 0, 0]))
    assert level.argmax() == 3 and level[2] == level[4] > level[1] > 0 == level[0]
    page = Lines()
    page.feed(f"{MENU}<p>{P}</p><p>{P}</p>{MENU}")
    page.close()
    mass = content_mass(page.lines)
    assert (mass > 0).tolist() == [False] * 3 + [True] * 2 + [False] * 3
