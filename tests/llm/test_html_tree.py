"""The style tree against a plain version, its recall on marked templates, and hostile pages."""

import collections
import math
import random
import resource
import subprocess
import sys
import time

import pytest

from glyphlake.llm import html_extract

PAGES = "page_id long, url string, html string"


def site(rng, host, n):
    """Pages of one site without telling tags: (html, article blocks, template blocks)."""
    words = lambda k: " ".join(rng.choice("the of river stone paper light garden window winter letter music bread road house song field".split()) + str(rng.randrange(200)) for _ in range(k))
    menu, foot, box = [words(2) for _ in range(6)], words(12), words(9)
    for i in range(n):
        body = [f"{host} {i} {words(rng.randint(8, 40))}" for _ in range(rng.randint(2, 6))]
        html = f"<html><body><div class='top'><div class='m'>{''.join(f'<p>{x}</p>' for x in menu)}</div></div><div class='c'>" + "".join(f"<p>{x}</p>" for x in body) + f"</div><div class='r'><p>{box}</p></div><div class='f'><p>{foot}</p></div></body></html>"
        yield html, body, [*menu, box, foot]


def test_recall_on_marked_templates(spark):
    rng = random.Random(6)
    rows, truth = [], []
    for h in range(6):
        for html, body, template in site(rng, f"s{h}", 40):
            rows.append((len(rows), f"http://s{h}.test/{len(rows)}", html))
            truth.append((body, template))
    for tags in (True, False):
        found = {r.page_id: r.text.split("\n\n") for r in html_extract.extract(spark.createDataFrame(rows, PAGES), by_tags=tags).collect()}
        gone = sum(t not in found[i] for i, (_, template) in enumerate(truth) for t in template)
        left = sum(b in found[i] for i, (body, _) in enumerate(truth) for b in body)
        assert gone >= 0.9 * sum(len(t) for _, t in truth)
        assert left >= 0.99 * sum(len(b) for b, _ in truth)
    kept = {r.page_id: r.text.split("\n\n") for r in html_extract.extract(spark.createDataFrame(rows, PAGES), min_importance=0.0).collect()}
    assert all(t in kept[i] for i, (_, template) in enumerate(truth) for t in template)  # without pruning they stay


def plain_branches(pages, min_importance, min_pages):
    """{host: {branch: importance}} by the definitions, from parsed pages."""
    out = {}
    for host in {h for h, _ in pages}:
        style, content = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
        for h, source in pages:
            if h != host:
                continue
            page = html_extract.Page(source)
            for path in {*page.children, *(b.chain for b in page.blocks)}:
                style[path][tuple(page.children.get(path, ()))] += 1
            for path, text in {(b.chain, b.text) for b in page.blocks}:
                content[path][text] += 1
        importance, counts = {}, {p: sum(c.values()) for p, c in style.items()}
        for path, m in counts.items():
            if m <= 1:
                importance[path] = 1.0
            elif content[path]:
                importance[path] = 1 - sum(math.log(n) for n in content[path].values()) / len(content[path]) / math.log(m)
            else:
                importance[path] = -sum(n / m * math.log(n / m) for n in style[path].values()) / math.log(m)
        whole = max((v for p, v in importance.items() if counts[p] > 1), default=None)
        if whole is None or whole < min_importance:
            continue
        for path in counts:
            below = [(importance[p], 0.9 ** (len(p) - len(path))) for p in counts if p[: len(path)] == path]
            value = sum(a * w for a, w in below) / sum(w for _, w in below)
            if path and counts[path] >= min_pages and value < min_importance:
                out.setdefault(host, {})[path[-1]] = value
    return out


def test_branches_are_the_definition(spark):
    rng = random.Random(9)
    pages = [(f"s{h}.test", html) for h, n in ((0, 30), (1, 12), (2, 4)) for html, _, _ in site(rng, f"s{h}", n)]
    pages += [("copy.test", "<div><p>same</p></div>")] * 15 + [("s0.test", None), ("s0.test", ""), ("s1.test", "<p>odd" * 30)]
    df = spark.createDataFrame([(i, f"http://{h}/{i}", s) for i, (h, s) in enumerate(pages)], PAGES)
    found = collections.defaultdict(dict)
    for r in html_extract.template_branches(df, 0.3, 5).collect():
        found[r.host][r.branch] = r.importance
    want = plain_branches([(h, s or "") for h, s in pages], 0.3, 5)
    assert want and {h: set(b) for h, b in found.items()} == {h: set(b) for h, b in want.items()}
    for h, branches in want.items():
        assert found[h] == pytest.approx(branches)


HOSTILE = {
    "nested": "<div>" * 40_000 + "x", "unclosed": "<a " * 40_000, "quotes": "<a href=\"" * 40_000, "quotes and ends": "<a \">\"" * 40_000, "inline": "<b>x" * 40_000,
    "ends": "<b>" * 40_000 + "</i>" * 40_000, "lists": "<ul><li>" * 20_000, "names": "".join(f"<div class='w-1/{i}'>" for i in range(40_000)), "comment": "a<!--" * 40_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_linear_time(name):
    began = time.perf_counter()
    html_extract.Page(HOSTILE[name]).text({})
    assert time.perf_counter() - began < 10


def test_nested_pages_take_little_memory():
    code = "import resource; from glyphlake.llm.html_extract import Page; base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; Page('<div>' * 40000 + 'x').text({}); print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base)"
    used = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout)
    assert used < 500 * (1024 if resource.getpagesize() else 1)


def test_words_beside_others_are_no_sign():
    for names in ("social-history", "related-work", "share-price", "notice-period", "comment-on-hegel"):
        page = html_extract.Page(f"<body><article><h1>Title</h1><section class='{names}'><p>kept here</p></section></article></body>")
        assert page.text({}) == "Title\n\nkept here", names
    for names in ("share", "ad-slot", "site-nav", "cookie-banner", "social-share-buttons", "related-links", "main menu", "comments-list"):
        page = html_extract.Page(f"<body><article><h1>Title</h1><p>story</p><div class='{names}'><p>gone</p></div></article></body>")
        assert page.text({}) == "Title\n\nstory", names


def test_unclosed_marks_lose_no_text():
    assert html_extract.Page("<p>one <a href=\"x>two</a> three</p><p class='b'>four</p>").text({}) == "one two three\n\nfour"
    assert html_extract.Page("<p>one</p> two <a hre").text({}) == "one\n\ntwo <a hre"
    assert html_extract.Page("<p>one</p> two <!-- open").text({}) == "one\n\ntwo"


def test_clashing_columns_and_nulls(spark):
    rows = [(1, "http://a.test/1", "<p>x</p>", "h", 2, [1]), (None, None, None, None, None, None), (1, "http://a.test/1", "<p>x</p>", "h", 2, [1])]
    df = spark.createDataFrame(rows, PAGES + ", host string, branch long, pruned array<int>")
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in html_extract.extract(df).collect()) == [("1", "x", 1), ("1", "x", 1), ("None", "", 0)]
