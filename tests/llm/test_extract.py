"""Main text of pages of many shapes: wrappers, names, lists, and a plain scorer."""

import random
import collections
import time

import pytest

from cairn.llm import tree_extract

PARAS = "<p>First paragraph, with commas, and some length to it, so that it scores.</p><p>Second paragraph, as long, as the first one, and then more words in it.</p>"


def page(body):
    return f"<html><body><header><p>Site, name</p></header><nav><a href=x>Menu</a></nav>{body}<footer>(c) me</footer></body></html>"


@pytest.mark.parametrize("name", ["has-sidebar", "no-sidebar", "content no-comments", "related-topic-page", "post-share-enabled", "sidebar", "comments-off"])
def test_wrapper_names_do_not_empty_a_page(name):
    assert tree_extract.main_text(page(f'<div class="{name}">{PARAS}</div>')).count("paragraph") == 2


@pytest.mark.parametrize("name", ["share-price", "related-work", "widget-description"])
def test_names_count_whole(name):
    assert "stays" in tree_extract.main_text(page(f'<article>{PARAS}<p class="{name}">This stays.</p></article>'))


@pytest.mark.parametrize("name", ["ad", "ad-box", "cookieBanner", "site-footer", "comment-list", "related-posts", "x share-buttons"])
def test_marked_parts_go(name):
    for tag in ("div", "section"):
        assert "gone" not in tree_extract.main_text(page(f"<div>{PARAS}<{tag} class='{name}'><p>This, is, gone</p></{tag}>{PARAS}</div>"))


def test_comments_longer_than_the_article_go():
    found = tree_extract.main_text(page(f"<div>{PARAS}</div><div id=comments>" + "<p>I agree, and so, on, and on, at some length, indeed.</p>" * 30 + "</div>"))
    assert found.count("paragraph") == 2 and "agree" not in found


def test_lists_leads_and_formulas_stay():
    body = f"<article><header><h1>Title</h1><p>Lead.</p><span>12 May</span></header>{PARAS}<ul><li><a href=x>Ref one</a><li><a href=y>Ref two</a></ul><p>a <math><mi>q</mi></math> b</p></article>"
    found = tree_extract.main_text(page(body)).split("\n\n")
    assert found[:2] == ["Title", "Lead."] and found[-3:] == ["Ref one", "Ref two", "a q b"] and len(found) == 7


def test_everything_between_kept_siblings_stays():
    body = f"<div><h2>Head</h2><section>{PARAS}</section><h3>Between</h3><ul><li>item</ul><section>{PARAS}</section></div><div><ul><li><a href=x>Elsewhere</a></ul></div>"
    found = tree_extract.main_text(page(body))
    assert found.startswith("Head") and "Between" in found and "item" in found and found.count("paragraph") == 4 and "Elsewhere" not in found


def test_rows_of_a_grid_stay_together():
    found = tree_extract.main_text(page(f"<div class=row><div class=col>{PARAS * 3}</div></div><div class=row><div class=col>{PARAS}</div></div>"))
    assert found.count("paragraph") == 8


def test_tables_with_open_cells():
    found = tree_extract.main_text("<table><tr><td>a<td>b<tr><td>c<td><table><tr><td>in</table></table>")
    assert " ".join(found.split()) == "a b c in"


def test_scores_equal_plain_sums(spark, sf_dir):
    """Points of each node, from every paragraph's own points and its distance."""

    def plain(root):
        nodes = tree_extract._nodes(root, ("hard", "name", "comment"))
        text = lambda n: "".join(c if isinstance(c, str) else text(c) for c in n.children if isinstance(c, str) or not c.unwanted)
        chars = lambda n: sum((0 if c.isspace() else len(c)) if isinstance(c, str) else 0 if c.unwanted else chars(c) for c in n.children)
        linked = lambda n: chars(n) if n.tag == "a" else sum(linked(c) for c in n.children if not isinstance(c, str) and not c.unwanted)
        points = {id(n): 0.0 for n in nodes}
        for n in nodes:
            if n.tag in tree_extract.PARAGRAPH and chars(n):
                own = (1 + text(n).count(",") + min(3, chars(n) / 100)) * (1 - linked(n) / chars(n))
                up, distance = n.parent, 1
                while up is not None:
                    points[id(up)] += own / (1 if distance == 1 else 2 if distance == 2 else 3 * (distance - 1))
                    up, distance = up.parent, distance + 1
        return nodes, points

    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").limit(30).collect()]
    for html in [*pages, page(f"<div><div><div><p>x, y <a>z</a><td>q</td>{PARAS}</div></div></div>")]:
        root = tree_extract.tree(html)
        tree_extract.kept(root)
        nodes, points = plain(root)
        for n in nodes:
            assert n.points == pytest.approx(points[id(n)])


def test_articles_stand_out_without_their_tag(spark, sf_dir):
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        want = tree_extract.main_text(r.html)
        renamed = r.html.replace("<article>", "<div>").replace("</article>", "</div>")
        assert tree_extract.main_text(renamed) == want
        wrapped = r.html.replace("<article>", '<div class="has-sidebar"><div>').replace("</article>", "</div></div>")
        assert tree_extract.main_text(wrapped) == want


@pytest.mark.parametrize("html", ["<div>" * 20000 + "</section>" * 20000, "<b>" * 20000 + "</i>" * 20000, "<i><div>" + "<b>" * 20000 + "</i>" * 20000, "<p><b>" * 10000, "<ul><li>" * 10000 + "</li>" * 20000])
def test_time_grows_with_the_page(html):
    started = time.time()
    assert tree_extract.main_text(html + "<p>end") == "end"
    assert time.time() - started < 5


LONG = "<p>" + "A long paragraph, with commas, and words, that goes on for quite some time, as articles do. " * 3 + "</p>"
BODY = " ".join("A long paragraph, with commas, and words, that goes on for quite some time, as articles do.".split())


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<body><form id='aspnetForm'><div>{LONG * 3}</div><input value=x><select><option>a</select></form></body>", ["L", "L", "L"]),
        (f"<body><form><label>Search</label><p>find it</p></form><article>{LONG}</article></body>", ["L"]),
        (f"<article><h1 class='banner'>Title</h1>{LONG}<ul class='menu'><li>Soup<li>Fish</ul><p class='related'>Short.</p>{LONG}</article>", ["Title", "L", "Soup", "Fish", "Short.", "L"]),
        (f"<body><div><section><p>Hi.</p></section><section>{LONG * 2}</section><section><p>End.</p></section></div></body>", ["Hi.", "L", "L", "End."]),
        (f"<main><article>{LONG * 3}</article><article>{LONG * 2}</article></main>", ["L"] * 5),
        (f"<article>{LONG}</article><div class='reader-comments'><p>nice, good, very, much</p></div><div id='responses'><p>yes</p></div><div class='sponsored-content'><p>Buy</p></div><div class='ads_inline'>ad</div>", ["L"]),
        (f"<article>{LONG}<p class='ad'>Buy</p><ul class='menu'><li><a href=x>Home</a></ul></article>", ["L"]),
    ],
)
def test_forms_names_and_short_sections(page, want):
    assert tree_extract.main_text(page).split("\n\n") == [x if x != "L" else " ".join([BODY] * 3) for x in want]


def test_container_equals_a_plain_choice():
    """The best container by points counted anew for each element from its paragraphs, over random trees without names."""
    chance = random.Random(6)

    def made(depth):
        if depth == 0 or chance.random() < 0.3:
            text = ", ".join("word " * chance.randint(1, 12) for _ in range(chance.randint(1, 6)))
            return f"<p>{text}</p>" if chance.random() < 0.7 else f"<p><a href=x>{text}</a> more</p>"
        return "<div>" + "".join(made(depth - 1) for _ in range(chance.randint(1, 4))) + "</div>"

    for _ in range(60):
        root = tree_extract.tree("<body>" + made(5) + made(4) + "</body>")
        nodes = tree_extract._nodes(root, ())
        tree_extract.score(nodes)
        points = collections.Counter()
        for p in (n for n in nodes if n.tag == "p" and n.chars):
            own, at, distance = (1 + p.commas + min(3, p.chars / 100)) * (1 - p.linked / p.chars), p.parent, 0
            while at is not None:
                points[at] += own / (1 if distance == 0 else 2 if distance == 1 else 3 * distance)
                at, distance = at.parent, distance + 1
        worth = {n: points[n] * (1 - (n.linked / n.chars if n.chars else 0)) for n in nodes}
        best = max(nodes, key=lambda n: round(worth[n], 9))
        chosen = tree_extract.kept(root)
        up = set()
        while best is not None:
            up.add(best)
            best = best.parent
        assert any(n in up for n in chosen)  # the best one, or what it was widened to
