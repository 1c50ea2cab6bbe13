"""Main text of pages against planted articles and plain loops."""

import math
import random
import re
from collections import defaultdict
from html import escape, unescape

import pytest

from stratoloom.llm import html_text
from stratoloom.llm.html_text import Page, kept

SCHEMA = "page_id long, url string, html string, `text` string, site string, low string, n_chars int"


def pages(spark, rows):
    """Pages with extra columns whose names clash with what the operator makes."""
    return spark.createDataFrame([(i, u, h, "x", "y", "z", 7) for i, u, h in rows], SCHEMA)


def text_of(source):
    """A page's text by itself, without a site."""
    return " ".join(kept(Page(source), set()))


def test_the_table(spark, small):
    """All pages of the smallest table: what stands between the article's tags."""
    rows = spark.read.parquet(f"{small}/pages.parquet").collect()
    got = {r["page_id"]: r for r in html_text.op12_html_text(spark, small).collect()}
    assert len(got) == len(rows)
    for r in rows:
        blocks = [unescape(re.sub(r"</?b>", "", b)) for b in re.split(r"</?(?:p|h1|br)>", re.search(r"<article>(.*)</article>", r["html"], re.S).group(1))]
        want = " ".join(" ".join(blocks).split())
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want) and got[r["page_id"]]["url"] == r["url"]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<p>a<p>b<b>c</b>d<br>e", "a bcd e"),
        ("<p>A &amp; B &lt;x&gt; &eacute;&#233;&#xe9; &copy &am;</p>", "A & B <x> ééé © &am;"),
        ("<ul><li>one<li>two</ul>three", "one two three"),
        ("<p>a <!-- <p>no</p> --> b</p><!-- never ends <p>x", "a b"),
        ("<div title=\"a > b\" class='c'>in</div> < 5 and 3 > 2", "in < 5 and 3 > 2"),
        ("<script>if (a < b) { '</p>' }</script><p>yes</p><style>p{}</style><SCRIPT>x", "yes"),
        ("<article><h1>T</h1><p>x</p><aside>no</aside><section class=\"comments\"><article>no</article></section></article><p>outside</p>", "T x"),
        ("<header>no</header><main><header><h1>T</h1></header>y<footer>no</footer></main>", "T y"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
        ("<div class='cookieNotice'>no</div><div class='has-sidebar'>yes</div><div id=side-bar><span class=\"ad\">no</span>also</div>", "yes also"),
        ("<p>one<span class='advert'>no<p>two", "one two"),
        ("<body hidden><p>x</p></body><div style='display: none'>no</div><div hidden>no</div>", "x"),
        ("<a href=x>only a link</a><p>words <a>linked</a> in a text</p>", "words linked in a text"),
        ("<head><title>no</title><p>in body", "in body"),
        ("<article><p>cut off in a ta<b", "cut off in a ta"),
        ("no markup at all", "no markup at all"),
        ("<p>\n\t a  b\r\n</p>\f<p></p>", "a b"),
        ("", ""),
    ],
)
def test_markup(source, want):
    """Wrong and odd markup, references, white space."""
    assert text_of(source) == want


def test_deep_nesting():
    """Elements beyond the last level still give their text; one node is not above itself."""
    page = Page("<div>" * 3000 + "deep" + "<p>er")
    assert kept(page, set()) == ["deep", "er"] and all(n != p for n, p, *_ in page.nodes)


def site(dice, host, many, named):
    """Pages of one host: an article in plain elements among template parts that say nothing of themselves, and the article's text."""
    words = lambda n: " ".join("".join(dice.choices("abcdefgh", k=5)) for _ in range(n))
    menu, foot, ads = [words(2) for _ in range(5)], words(8), [words(6) for _ in range(4)]
    out = []
    for k in range(many):
        title, body = words(4), [words(dice.randint(5, 40)) for _ in range(dice.randint(1, 9))]
        inner = f"<h1>{title}</h1>" + "".join(f"<p>{escape(b)} &amp; so</p>" for b in body) + ("<div class='k9'>Read more like this every day</div>" if named else "")
        article = f"<article>{inner}</article>" if named else f"<div class='k2'>{inner}</div>"
        page = f"<div class='k0'><ul>{''.join(f'<li><span>{m}</span></li>' for m in menu)}</ul></div><div class='k1'>{dice.choice(ads)}</div>{article}<div class='k3'>{foot}</div>"
        out.append((f"https://{host}:80/{k}?x#y" if k % 2 else f"http://{host.upper()}/{k}", f"<html><body>{page}</body></html>", " ".join([title, *(f"{b} & so" for b in body)])))
    return out


def test_sites(spark):
    """Template parts without telling names go by their importance, articles stay, also where they repeat."""
    dice = random.Random(3)
    rows = [*site(dice, "one.example.org", 60, False), *site(dice, "two.example.org", 40, True)]
    copies = [("http://three.example.org/", "<div><p>The same article on every page</p></div>", "The same article on every page")] * 4
    told = [("http://four.example.org/", "<article><h1>Same</h1><p>Same text</p></article>", "Same Same text")] * 12
    rows += copies + told + [(None, None, ""), ("not a url", "", ""), (None, "<p>alone</p>", "alone")]
    got = html_text.extract(pages(spark, [(k, u, h) for k, (u, h, _) in enumerate(rows)])).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["text"] == rows[r["page_id"]][2] and r["n_chars"] == len(r["text"])


def test_sites_joined(spark, monkeypatch):
    """Lists that are too long to send come by a join: same texts."""
    monkeypatch.setattr(html_text, "SENT", 0)
    test_sites(spark)


def test_repeated_ids_and_no_rows(spark):
    """Rows that repeat an id, or have none, stay; no pages give no rows."""
    got = html_text.extract(pages(spark, [(1, "http://a", "<p>x</p>"), (1, "http://a", "<p>x</p>"), (None, "http://a", "<p>y</p>")])).collect()
    assert sorted((r["page_id"] or 0, r["text"]) for r in got) == [(0, "y"), (1, "x"), (1, "x")]
    assert html_text.extract(pages(spark, [(1, "u", "h")]).limit(0)).count() == 0


def test_importance_by_hand(spark):
    """Composite importance of a small site as plain recursion finds it."""
    dice = random.Random(8)
    sources = [h for _, h, _ in site(dice, "x", 9, False)] + ["<div><p>a</p><ul><li>b</ul></div>", "<div><ul><li>b</ul><p>c</p></div>"]
    counted = html_text.statistics([(5, h) for h in sources])
    rows = [(*key, n) for key, n in counted.items()]
    got = {r["node"]: r for r in html_text.importance(spark.createDataFrame(rows, "site long, node long, kind int, value long, depth int, inside boolean, n long")).collect()}
    m, parents, texts, styles = {}, {}, defaultdict(list), defaultdict(list)
    for (_, node, kind, value, _, _), n in counted.items():
        if kind == 0:
            m[node], parents[node] = n, value
        else:
            (texts if kind == 1 else styles)[node].append(n)

    def composite(node):
        shared = lambda n: math.log(n) / math.log(m[node]) if m[node] > 1 else 0.0
        own = sum(1 - shared(n) for n in texts[node]) / len(texts[node]) if texts[node] else None
        parts = [(composite(c), m[c]) for c in m if parents[c] == node]
        parts = [(v, w) for v, w in parts if v is not None] + ([(own, m[node])] if own is not None else [])
        inner = sum(v * w for v, w in parts) / sum(w for _, w in parts) if parts else None
        if not styles[node]:
            return own
        style = sum(-n / m[node] * math.log(n / m[node]) / math.log(m[node]) for n in styles[node]) if m[node] > 1 else 1.0
        return None if inner is None else (1 - 0.9 ** len(styles[node])) * style + 0.9 ** len(styles[node]) * inner

    assert set(got) == set(m)
    for node in m:
        want = composite(node)
        assert (got[node]["composite"] is None) == (want is None) and (want is None or abs(got[node]["composite"] - want) < 1e-9)
