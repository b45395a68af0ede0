import itertools

import pytest

pytest.importorskip("quillspark.llm")
from quillspark.llm import wrapper  # noqa: E402


def brute_match(a, b):
    """The heaviest match by trying all order-preserving pairings of children; a pair weighs 2 where
    classes are equal, else 1."""
    if a.tag != b.tag:
        return 0
    x, y, best = a.nodes(), b.nodes(), 0
    for n in range(1, min(len(x), len(y)) + 1):
        for p in itertools.combinations(x, n):
            for q in itertools.combinations(y, n):
                best = max(best, sum(brute_match(i, j) for i, j in zip(p, q)))
    return (2 if a.names == b.names else 1) + best


def weight_of(pairs):
    return sum(2 if a.names == b.names else 1 for a, b in pairs)


def test_tree_matching_is_optimal():
    pages = ["<div><p>a<p class=x>b<ul><li>1<li>2</ul></div>", "<div class=k><h1>t</h1><p>x<ul><li>1</ul><p class=x>y</div>", "<div><ul><li>1<li>2<li>3</ul></div>", "<p>x", ""]
    for s, t in itertools.product(pages, pages):
        a, b = wrapper.parse(s), wrapper.parse(t)
        wrapper.number(a), wrapper.number(b)
        assert wrapper.weight(a, b, {}) == weight_of(wrapper.align(a, b, {})) == brute_match(a, b)


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/x">Home</a></ul></nav>
<!-- ad --><div class="ad">Buy</div><article class="post"><h1>Title &amp; more</h1><p><b>One</b>two<br>three<p>&#x41;B&nbsp;C<aside>side</aside><form>f<input></form><p>four
five</p></article><section id="comments"><article>me too</article></section><footer>&copy; x</footer>"""


def test_marked_article():
    w = wrapper.Wrapper(PAGE)
    assert w.text(PAGE) == ("Title & more Onetwo three AB C four five", "marks")
    assert [w.text(x)[0] for x in ("", "<p>plain &am", "<article>x <b")] == ["", "plain &am", "x"]
    assert w.text("<main><div class='menu'>m</div><article>a</article>rest</main>")[0] == "a rest"


@pytest.mark.parametrize("small", [1 << 20, 0])
def test_slots_of_unmarked_pages(spark, small):
    page = "<html><body><div class=top>My site</div><div><p>Follow us on every channel</p><div class='x'><h1>{0}</h1><p>{0} {1}</p></div></div><div>Terms {1}</div></body></html>"
    rows = [(i, f"http://{'a' if i % 2 else 'B.org:80'}/{i}", page.format(f"word{i} " * 30, i), "t", 5) for i in range(12)]
    rows += [(20, "http://a/none", None, "t", 5), (21, None, PAGE, "t", 5), (22, "http://a/empty", "", "t", 5), (None, "http://a/m", PAGE, "t", 5), (3, "http://a/3", rows[3][2], "t", 5)]
    got = wrapper.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int"), small=small).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    for i in range(12):
        body = ("word%d " % i * 30).strip()
        assert by[i] == f"{body} {body} {i}"
    assert by[20] == by[22] == "" and by[21] == by[None] == "Title & more Onetwo three AB C four five"
    assert all(r.n_chars == len(r.text) for r in got)
    assert wrapper.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_template_inside_a_marked_article(spark):
    page = "<html><body><article><p class=k>Read this on our app</p><h1>T{0}</h1><p>{1}</p><div><span>Tell a friend</span></div></article></body></html>"
    rows = [(i, f"http://a/{i}", page.format(i, f"word{i} " * 20)) for i in range(8)]
    rows += [(100 + i, f"http://same/{i}", page.format(1, "one text")) for i in range(4)]
    got = {r.page_id: r.text for r in wrapper.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(8):
        assert got[i] == f"T{i} " + (f"word{i} " * 20).strip()
    assert all(got[100 + i] == "Read this on our app T1 one text Tell a friend" for i in range(4))


def test_long_pages_align_like_short_ones(monkeypatch):
    import random

    rnd = random.Random(2)
    kids = ["<p>a</p>", "<div><b>b</b></div>", "<ul><li>1<li>2</ul>", "<h2>h</h2>", "<div class=x><p>x</p><b>y</b></div>"]
    flat = lambda n: "<div>" + "".join(rnd.choice(kids) for _ in range(n)) + "</div>"
    trees = [wrapper.parse(flat(n)) for n in (0, 1, 7, 30, 45)]
    for t in trees:
        wrapper.number(t)
    want = {(i, j): wrapper.weight(a, b, {}) for i, a in enumerate(trees) for j, b in enumerate(trees)}
    for cells in (1, 10**9):
        monkeypatch.setattr(wrapper, "CELLS", cells)
        for (i, j), n in want.items():
            pairs = wrapper.align(trees[i], trees[j], {})
            assert wrapper.weight(trees[i], trees[j], {}) == weight_of(pairs) == n
            own = {id(b): a.index for a, b in pairs}
            at = [own[id(k)] for k in trees[j].nodes()[0].nodes() if id(k) in own]
            assert at == sorted(set(at))
    monkeypatch.undo()
    body = "".join(rnd.choice(kids) for _ in range(2000))
    a, b = wrapper.parse(f"<div>{body}<i>z</i></div>"), wrapper.parse(f"<div><h1>new</h1>{body}<u>w</u></div>")
    n = len(wrapper.number(a))
    wrapper.number(b)
    assert len(wrapper.align(a, b, {})) == n - 1


def test_deep_pages(spark):
    deep = lambda n, tag, s: "<html><body>" + f"<{tag}>" * n + s + f"</{tag}>" * n + "</body></html>"
    rows = [(0, "http://d/0", deep(2000, "div", "<p>first one here</p>"))]
    rows += [(i, f"http://d/{i}", deep(1990 + i, "div", f"<h1>T{i}</h1><p>{'text%d ' % i * 5}</p>")) for i in range(1, 7)]
    got = {r.page_id: r for r in wrapper.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0].text == "first one here" and all(got[i].text == f"T{i} " + ("text%d " % i * 5).strip() for i in range(1, 7))


def page(host, i):
    """A page of a template of its own for each host, without any mark, and its content."""
    import random

    rnd = random.Random(f"{host}/{i}")
    words = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    title, parts = words(4), [words(rnd.randint(20, 60)) for _ in range(rnd.randint(1, 6))]
    content = "".join(f"<p>{p}</p>" for p in parts)
    if host % 2:
        body = f"<div id=a{i}><span>Our site</span><div>Start<br>Archive</div></div><div><h1>{title}</h1><div>{content}<div>Send this to a friend</div></div></div><div>All rights reserved, host {host}</div>"
    else:
        body = f"<table><tr><td>Links<td><h2>{title}</h2>{content}</table><p>Printed on paper</p>"
    return f"<html><body>{body}</body></html>", " ".join([title, *parts])


def test_wrapper_finds_planted_slots(spark):
    """Against what was put in: nothing but the alignment tells these pages' content."""
    made = {(h, i): page(h, i) for h in range(6) for i in range(3 + 2 * h)}
    rows = [(100 * h + i, f"http://h{h}/{i}", html) for (h, i), (html, _) in made.items()]
    rows += [(1000 + i, "http://h5/copy", made[5, 1][0]) for i in range(20)]
    got = {r.page_id: r for r in wrapper.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for (h, i), (_, text) in made.items():
        r = got[100 * h + i]
        if h:
            assert r.decided_by == "wrapper" and r.text == text
        else:  # two pages beside the seed are too few
            assert r.decided_by == "marks" and text in r.text
    assert all(got[1000 + i].text == made[5, 1][1] for i in range(20))


def test_sample_pages_come_through_their_wrapper(spark):
    import re
    from collections import Counter
    from pathlib import Path

    if not Path("/root/testdata/sf0.01/pages.parquet").exists():
        pytest.skip("no sample tables")
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    hosts = Counter(re.match(r"\w+://([^/]*)", r.url)[1] for r in pages.collect())
    got = wrapper.extracted(pages).collect()
    by = Counter(r.decided_by for r in got if hosts[re.match(r"\w+://([^/]*)", r.url)[1]] > 3)
    assert by["wrapper"] >= 0.95 * sum(by.values()) > 100
