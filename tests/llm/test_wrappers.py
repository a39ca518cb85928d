import json
import random
from itertools import groupby

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from findmill.llm import wrappers as H

SF = "/root/testdata/sf0.001"


def page(title: str, body: str, menu: str = "Home | About") -> str:
    return f"""<!doctype html><html><head><title>{title}</title><style>p {{ color: red }}</style></head><body>
<div class="cookie-notice">We use cookies</div><header><h1>Site</h1></header><nav><ul><li>{menu}</li></ul></nav>
<article><header><h1>{title}</h1><p>By someone</p></header>{body}<script>var x = "<p>no</p>";</script></article>
<aside class="sidebar">Related</aside><section id="comments"><p>First!</p></section><form><label>Mail</label></form>
<footer>Imprint</footer></body></html>"""


def texts(spark, rows) -> dict:
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    found = H.extract(df, H.written(H.infer(df), "test-wrappers"))
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    rows = found.collect()
    assert all(r.n_chars == len(r.text) for r in rows)
    return {r.page_id: r.text for r in rows}


def test_main_text_without_furniture(spark):
    body = "<p>One &amp; two\n\n  three&nbsp;four</p><div class=ad>Buy</div><ul><li>a<li><b>b</b>c</ul><p>x<br>y</p>"
    rows = [(i, "http://h.example/a", page(f"Title {i}", body + f"<p>Number {i}</p>")) for i in range(4)]
    found = texts(spark, rows)
    assert found[2] == "Title 2\nOne & two three four\na\nbc\nx y\nNumber 2"


def test_pages_without_an_article_use_main_then_body(spark):
    in_main = "<body><div class=menu>m</div><main><h2>A</h2><p>text {}</p></main><p>outside</p></body>"
    plain = "<body><div id=nav>m</div><p>text {}</p><div class='footer'>f</div></body>"
    rows = [(i, "http://m.example/", in_main.format(i)) for i in range(2)] + [(10 + i, "http://p.example/", plain.format(i)) for i in range(2)]
    found = texts(spark, rows)
    assert found[1] == "A\ntext 1" and found[11] == "text 1"


def test_texts_that_a_template_repeats_outside_articles_go(spark):
    rows = [(i, "http://t.example/x", f"<body><div><span>Same everywhere</span></div><p>own {i}</p></body>") for i in range(5)]
    assert set(texts(spark, rows).values()) == {f"own {i}" for i in range(5)}


def test_a_host_of_copies_keeps_its_text(spark):
    rows = [(i, "http://c.example/x", "<body><p>copied text</p></body>") for i in range(5)]
    assert set(texts(spark, rows).values()) == {"copied text"}


def test_one_hot_host_over_many_partitions_gives_one_wrapper(spark):
    df = spark.range(400).selectExpr("id AS page_id", "'http://hot.example/p' AS url", "concat('<article><p>n ', id, '</p></article>') AS html")
    wrappers = H.infer(df.repartition(40)).collect()
    assert [(r.host, r.n_pages) for r in wrappers] == [("hot.example", 400)]
    assert H.regular_expression(json.loads(wrappers[0].wrapper)) == "<article><p>#PCDATA</p></article>"


def test_nulls_empty_pages_and_empty_tables(spark):
    rows = [(1, None, None), (2, None, ""), (3, "no url", "<p>x"), (3, "no url", "<p>x"), (None, "http://h/", "<p>&lt;b&gt;")]
    found = texts(spark, rows)
    assert found[1] == found[2] == "" and found[3] == "x" and found[None] == "<b>"
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert H.extract(empty, H.written(H.infer(empty), "test-wrappers")).count() == 0


def expression_of(text: str) -> str:
    return H.regular_expression(H.expression(text, H.Place(None, "")))


def test_alignment_makes_optional_repeated_and_slots():
    root = H.Place(None, "")
    first = H.expression("<ul><li>a</li><li>b</li></ul><p>same</p>", root)
    second = H.expression("<h1>t</h1><ul><li>c</li></ul><p>same</p>", root)
    both = H.regular_expression(H.align(first, second))
    assert both.startswith("(<h1>") and "</h1>)?" in both
    assert "(<li>#PCDATA</li>)+" in both
    assert both.endswith("</p>") and "#PCDATA</p>" not in both
    assert expression_of("<dl><dt>a<dd>b<dt>c<dd>d</dl>") == "<dl>(<dt>#PCDATA</dt>)+(<dd>#PCDATA</dd>)+</dl>"


@pytest.mark.parametrize("broken", ["<p", "<", "a < b", "<!-- x", "<script>alert(1)", "<p class='x>y</p>", "</p></p>", "<a href=\"<b>\">t</a>", "&#xZZ; &bogus; &#65;", "<table><tr><td>1<td>2<tr><td>3</table>"])
def test_broken_markup_does_not_crash(broken):
    root = H.Place(None, "")
    wrapper = H.expression(broken, root)
    keys, levels, template = H.places(wrapper, 1)
    text = H.main_text(broken, dict(zip(keys, levels)), set(template), root)
    assert text == "\n".join(" ".join(line.split()) for line in text.split("\n"))


def test_query_over_the_table(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    found = H.op9_wrappers(spark, SF).collect()
    assert sorted(r.page_id for r in found) == sorted(pages)
    for row in found:
        assert row.url == pages[row.page_id].url and row.n_chars == len(row.text)
        assert "<script" not in row.text and "  " not in row.text
    assert sum(r.n_chars > 0 for r in found) > len(found) // 2


@pytest.mark.parametrize(
    "page",
    [
        "<html class='no-search'><body><p>kept</p></body></html>", "<body class='no-sidebar widget search'><p>kept</p></body>",
        "<main class='comments' id='search'><p>kept</p></main>", "<article class='post category-social related'><p>kept</p></article>",
        "<article class=header><p>kept</p></article>", "<div class='elementor-widget'><p>kept</p></div>", "<div class='hasSidebar'><p>kept</p></div>",
        "<div id=research-share-price><p>kept</p></div>",
    ],
)
def test_words_in_names_of_content_lose_no_text(page):
    furniture = "<div class='cookie-notice'>n</div><div class='x sidebar'>n</div><div id=navMenu>n</div><article hidden>n</article>"
    root = H.Place(None, "")
    for more in ("", furniture):
        text = page.replace("<p>kept", f"{more}<p>kept")
        assert H.main_text(text, None, set(), root) == "kept"


def labelled_site() -> list[tuple[str, str]]:
    """Pages of one host, each with the main text a reader would mark: what varies and is no list of links."""
    out = []
    for i in range(12):
        paragraphs = [f"Paragraph {j} of story {i} tells {'more ' * (30 + (i * j) % 7)}things." for j in range(2 + i % 3)]
        note = [f"Correction {i}: a name."] if i % 4 == 1 else []
        links = "".join(f"<li><a href=/{j}>More about topic {j + i}</a></li>" for j in range(3 + i % 2))
        teasers = "".join(f"<article><a href=/t{j}>Teaser {i + j}</a><span>{j} min</span></article>" for j in range(3))
        body = "".join(f"<p>{x}</p>" for x in paragraphs + note)
        page = f"""<html><body><div id=top><a href=/>Home</a></div><section class=story><article class=full><h1>Story {i}</h1>
<p>Filed under the paper's usual terms.</p>{body}<ul>{links}</ul><p>Write to us about this story.</p></article></section>
<section class=more>{teasers}</section><div><span>{i} readers</span></div></body></html>"""
        out.append((page, "\n".join([f"Story {i}", *paragraphs, *note])))
    return out


def test_the_wrapper_finds_what_was_marked_by_hand(spark):
    """Template sentences, link lists and teasers inside articles have no telling names: only the aligned pages show them."""
    site = labelled_site()
    found = texts(spark, [(i, "http://labelled.example/", page) for i, (page, _) in enumerate(site)])
    assert found == {i: text for i, (_, text) in enumerate(site)}
    root = H.Place(None, "")
    without = [H.main_text(page, None, set(), root) for page, _ in site]
    assert all(text != want for text, (_, want) in zip(without, site))
    assert all(H.main_text(page, {}, set(), root) == "" for page, _ in site)  # a wrapper that names no place


def test_near_copies_of_an_article_keep_their_text(spark):
    body = "".join(f"<p>Sentence {i} is the same in all of them.</p>" for i in range(20))
    found = texts(spark, [(i, "http://copies.example/", f"<article><h1>T</h1>{body}<p>Copy {i}</p></article>") for i in range(12)])
    assert all(text.count("\n") == 21 and text.endswith(f"Copy {i}") for i, text in found.items())


def test_lists_of_links_stay_where_a_host_has_little_else(spark):
    found = texts(spark, [(i, "http://links.example/", f"<article><ul><li><a href=/>a {i}</a><li><a href=/>b {i}</a></ul></article>") for i in range(5)])
    assert found[3] == "a 3\nb 3"


def test_deep_and_wide_pages_do_not_stop_the_job(spark):
    deep = "<article>" + "<div>" * 5000 + "<p>deep {}</p>" + "</div>" * 5000 + "<p>after</p></article>"
    rng = random.Random(3)
    wide = ["<article>" + "".join(f"<{t}>w{i}</{t}>" for i, t in enumerate(rng.choices(["p", "h2", "div", "blockquote"], k=12_000))) + "</article>" for _ in range(2)]
    rows = [(i, "http://deep.example/", deep.format(i)) for i in range(4)] + [(10 + i, "http://wide.example/", w) for i, w in enumerate(wide)]
    found = texts(spark, rows)
    assert found[2] == "deep 2\nafter"
    assert found[10] == "\n".join(f"w{i}" for i in range(12_000))


def brute_lcs(x: list[int], y: list[int]) -> int:
    row = [0] * (len(y) + 1)
    for a in x:
        now = [0]
        for j, b in enumerate(y):
            now.append(row[j] + 1 if a == b else max(row[j + 1], now[-1]))
        row = now
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=25), st.lists(st.integers(0, 5), max_size=25))
def test_alignment_is_a_longest_common_subsequence(x, y):
    found = H.common(np.array(x, np.int64), np.array(y, np.int64))
    assert len(found) == brute_lcs(x, y) and all(x[i] == y[j] for i, j in found)
    assert all(a < c and b < d for (a, b), (c, d) in zip(found, found[1:]))
    both = H.align([[str(i), 0, [], 1] for i in x], [[str(i), 0, [], 1] for i in y])
    assert len(both) == len(x) + len(y) - len(found)


@pytest.mark.parametrize("size", range(1, 9))
def test_groups_of_any_length_that_recur_are_folded(size):
    group = [f"g{i}" for i in range(size)]
    labels = ["before", *group * 5, "after", "after2"]
    found = H.fold([[x, 0, [], 1] for x in labels])
    assert [x[0] for x in found] == ["before", *group, "after", "after2"]
    assert [x[1] for x in found] == [0, *[H.REPEATED] * size, 0, 0] and [x[3] for x in found[1:-2]] == [5] * size


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=14))
def test_folding_leaves_no_neighbours_alike(labels):
    found = H.fold([[x, 0, [], 1] for x in labels])
    assert [k for k, _ in groupby(x[0] for x in found)] == [x[0] for x in found]
    assert sum(x[3] for x in found) == len(labels)


@pytest.mark.parametrize("depth", [0, 90, 97, 98, 99, 100, 101, 150, 3000])
def test_furniture_is_left_out_at_any_depth(depth):
    inner = "<nav>MENU <b>ITEM</b></nav><div class=x><p>real <i>text</i> here</p></div><footer><div><p>FOOT</p></div></footer><form><label>FORM</label></form><header><p>HEAD</p></header><div class=sidebar><div>SIDE</div><br>BAR</div><p>end</p>"
    for closing in ("</div>" * depth, ""):
        page = "<div>" * depth + inner + closing + ("<p>after</p>" if closing or not depth else "")
        want = ["real text here", "end", *(["after"] if closing or not depth else [])]
        assert H.main_text(page, None, set(), H.Place(None, "")).split("\n") == want, depth


@pytest.mark.parametrize("odd", ["<a ", "<!x", "<a \"", "<a '\"", "<a href=\"x' ", "<", "</", "<a b='>\"", "<p><a \">", "<!-- ", "<script>", "</script ", "<div>", "</div>", "<nav>", "<a \"'>'"])
def test_odd_markup_takes_time_in_proportion(odd):
    """Seconds of 200 and of 800 thousand characters, with and without an end; squares would take minutes."""
    import time

    for tail in ("", ">", "'>", "\">x", "' \" >"):
        for size in (200_000, 800_000):
            page = odd * (size // len(odd)) + tail
            began = time.process_time()
            for _ in H.events(page, H.Place(None, "")):
                pass
            assert time.process_time() - began < 12, (odd, tail, size)


PARTS = st.lists(st.sampled_from(["<a ", "<p>", "</p>", ">", "\"", "'", "x", " ", "<!--", "-->", "<!", "<b c='d>e'>", "</b", "<", "=", "<i\">\">"]), max_size=14)


@settings(max_examples=500, deadline=None)
@given(PARTS)
def test_tags_are_those_of_a_plain_search(parts):
    """Against a search that tries every < afresh."""
    import re

    page, found, at = "".join(parts), [], 0
    plain = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.DOTALL)
    want = [(m.start(), m.end(), m[1] or "", m[2], m[3] or "") for m in plain.finditer(page)]
    tags = H._Tags(page)
    while m := tags.next(at):
        found.append(m)
        at = m[1]
    assert found == want
