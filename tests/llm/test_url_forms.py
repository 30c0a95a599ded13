"""Canonical forms, hostile addresses and clashing columns of the URL filter."""

import random
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from glyphlake.llm import urls

ENTRIES = ["casino-win.example.com/", "list.test/bad/", "list.test/a/b/c.html", "deep.test/x/y/", "x.y.z.test/"]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("http://casino-win.example.com:80/x", ENTRIES[0]), ("http://u:p@casino-win.example.com/", ENTRIES[0]), ("http://m.casino-win.example.com./", ENTRIES[0]),
        ("http://casino%2Dwin.example.com", ENTRIES[0]), ("http://CASINO-WIN.example.com?x", ENTRIES[0]), ("http://mycasino-win.example.com/", None),
        ("http://list.test/bad", None), ("http://list.test/bad/", ENTRIES[1]), ("http://list.test/%62ad/q", ENTRIES[1]), ("http://list.test/good/../bad/q", ENTRIES[1]),
        ("http://list.test//bad//q", ENTRIES[1]), ("http://list.test/bad/..", None), ("http://list.test/./bad/.", ENTRIES[1]), ("http://list.test/../../bad/x", ENTRIES[1]),
        ("http://list.test/a/b/c.html", ENTRIES[2]), ("http://list.test/a/b/c.html/", None), ("http://list.test/a/b/c.html/d", None), ("http://list.test/a/%zz/b", None),
        ("http://w.deep.test/x/y/z/1/2/3", ENTRIES[3]), ("http://deep.test/x/y", None), ("http://a.b.c.x.y.z.test", ENTRIES[4]), ("http://.", None), ("://", None),
    ],
)
def test_forms(spark, url, want):
    pages = spark.createDataFrame([(1, url, 2, "e")], "page_id long, url string, blocks int, entry string")
    listed = spark.createDataFrame([(e, "h") for e in ENTRIES], "entry string, host string")
    found = urls.judge(pages, listed).collect()
    assert [r.listed for r in found] == [want]


def plain_expressions(host, path, labels, depth):
    """All expressions by the rule, for a canonical host and a path."""
    steps = []
    for x in unquote(path).split("/"):
        if x == "..":
            steps[-1:] = []
        elif x not in ("", "."):
            steps.append(x)
    is_dir = path == "" or unquote(path).split("/")[-1] in ("", ".", "..")
    paths = ["/" + "".join(f"{s}/" for s in steps[:i]) for i in range(len(steps) + is_dir)] or ["/"]
    paths = paths if is_dir else [*paths, "/" + "/".join(steps)] if steps else paths
    parts = host.split(".")
    return {".".join(parts[i:]) + p for i in range(len(parts)) for p in paths if len(parts) - i <= labels and p.count("/") <= depth}


def test_expressions_are_the_plain_rule(spark):
    rng = random.Random(4)
    rows = [(".".join(rng.choice("abc") for _ in range(rng.randint(1, 5))), "".join("/" + rng.choice(["a", "b.html", "", ".", "..", "%61"]) for _ in range(rng.randint(0, 7)))) for _ in range(300)]
    df = spark.createDataFrame(rows, "h string, p string")
    for labels, depth in ((2, 1), (3, 3), (9, 9)):
        found = df.select("h", "p", urls.expressions(F.col("h"), F.col("p"), labels, depth).alias("x")).collect()
        for r in found:
            assert set(r.x) == plain_expressions(r.h, r.p, labels, depth), (r.h, r.p, labels, depth)


def test_long_addresses_take_linear_time(spark):
    import time

    pages = spark.createDataFrame([(1, "http://a.test/" + "x/" * 200_000), (2, "http://" + "a." * 50_000 + "test/"), (3, "http://a.test" + "/.." * 200_000)], "page_id long, url string")
    began = time.perf_counter()
    assert urls.judge(pages, urls.listed_sites(spark)).count() == 3
    assert time.perf_counter() - began < 60
