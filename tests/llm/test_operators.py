"""Each operator against a brute-force version, on odd rows and on an empty table."""

import collections
import hashlib
import os
import re
import zlib

import numpy as np
import pytest
from helpers import oracle_rows, spark_rows

from glyphlake.llm import decontam, html_extract, licenses, minhash, packing, quality, queries, secrets, sharding, token_files, tokenize, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def shingles(text, k=5):
    w = WORD.findall(lower(text))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def tokenizer(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def components(sets):
    """Smallest reachable id by all pairs."""
    ids = [i for i in sets if sets[i]]
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and 100 * (n := len(sets[a] & sets[b])) >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i in sets}


def test_minhash(docs, rows):
    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    want = components(sets)
    found = minhash.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    kept = sorted(x.doc_id for x in minhash.representatives(docs).collect() if x.doc_id is not None)
    assert kept == sorted(i for i in want if want[i] == i)


def test_minhash_chain_and_hot_group(spark):
    words = [f"w{i}" for i in range(400)]
    text = lambda a: " ".join(words[a : a + 100])
    rows = [(i, text(12 * i)) for i in range(20)] + [(100 + i, text(300)) for i in range(300)]
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == components({i: shingles(t) for i, t in rows})


def test_minhash_last_round_finds_what_a_star_misses(spark):
    """Many texts around one, each near to it and often not to each other."""
    import random

    rng = random.Random(3)
    base = [f"w{i}" for i in range(220)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(7):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i + 1, " ".join(w)))
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == components({i: shingles(t) for i, t in rows})


def test_parity_bound_is_exact():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 3000, rng.integers(1, 900)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        differ = int(np.bitwise_count(minhash.parities(a).view(np.uint64) ^ minhash.parities(b).view(np.uint64)).sum())
        assert differ <= len(np.setxor1d(a, b))


def test_sharding(docs, rows):
    found = sharding.byte_shards(docs, 7).collect()
    assert len(found) == len(rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in found) == collections.Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    ordered = sorted(found, key=lambda r: (r.shard, r.slot))
    key = [(r.doc_id is not None, r.doc_id or 0) for r in ordered]
    assert key == sorted(key)
    total, largest = sum(r.size for r in found), max(r.size for r in found)
    for shard in range(7):
        mine = [r for r in ordered if r.shard == shard]
        assert [r.slot for r in mine] == list(range(len(mine)))
        assert abs(sum(r.size for r in mine) - total / 7) <= largest
    assert {r.law for r in found} == {"bytes"} and {r.grown_shard for r in found} == {None}


def test_secrets(docs, rows):
    assign = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = collections.defaultdict(list)
    for r in secrets.scan(docs).collect():
        found[r.doc_id].append(r)
    for r in rows:
        t = r[1] or ""
        base = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in assign.finditer(t) if len(m[2]) >= 12]
        base += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        base += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        if r[0] is not None:
            x = found[r[0]][0]
            assert x.base_sha256 == hashlib.sha256(",".join(s for *_, s in sorted(base)).encode()).hexdigest()
            assert [x.n_assign, x.n_access, x.n_hex] == [sum(k == i for _, k, _ in base) for i in range(3)]
            assert {s for *_, s in base} <= set(x.spans.split(",")) | {""}
    assert found[1009][0].n_random == 1 and "[secret]" in found[1009][0].masked and "Zx9Qk2" not in found[1009][0].masked
    assert sum(len(v) for v in found.values()) == len(rows)


def test_random_strings():
    random = secrets.RandomStrings()
    for s in ("d41d8cd98f00b204e9800998ecf8427e", "123e4567-e89b-12d3-a456-426614174000", "internationalization-of-everything", "getElementsByTagName2ForAll", "12345678901234567890", "2024-05-01-release-notes-v2"):
        assert not random.test(s), s
    for s in ("Zx9Qk2Lp7Vt4Rw8Yb3Nm6Hd", "ghp_16C7e42F292c6912E7710c838347Ae178B4a", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY9"):
        assert random.test(s), s
    assert secrets.masked("ab cd ef", [(0, 0, 4), (3, 2, 5), (6, 1, 8)]) == "[secret] [secret]"


def test_decontamination(spark, docs, rows):
    rng = np.random.default_rng(2)
    words = [f"b{i}" for i in range(300)]
    items = [(0, " ".join(words[:40])), (1, " ".join(words[60:75])), (2, "B100 b101\nb102 b103 b104"), (3, "too few"), (4, None), (5, ""), (5, " ".join(words[200:290]))]
    extra = []
    for i, (_, t) in enumerate(items[:3] + items[6:]):
        w = t.split()
        extra += [(5000 + 10 * i, "pre " * 50 + t.upper() + " post " * 30), (5001 + 10 * i, " ".join(w[: max(5, len(w) * 85 // 100)])), (5002 + 10 * i, " ".join(w[: len(w) // 2])), (5003 + 10 * i, " ".join(rng.permutation(w)))]
    table = docs.select("doc_id", "text", "id", "leaked").union(spark.createDataFrame([(*x, 0, 0) for x in [*extra, (6000, "too few"), (6001, "Too\tfew")]], "doc_id long, text string, id int, leaked int"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = collections.Counter()
    for r in table.collect():
        for item, t in items:
            n, k = len(shingles(t)), len(shingles(t) & shingles(r.text))
            if n and 100 * k >= 75 * n:
                want[r.doc_id, item, n, k] += 1
    assert want
    found = decontam.leaks(table, bench).collect()
    assert collections.Counter((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in found) == want
    left = decontam.without_leaks(table, bench)
    clean = [r for r in table.collect() if not any(n and 100 * len(shingles(t) & shingles(r.text)) >= 75 * n for _, t in items for n in [len(shingles(t))])]
    assert collections.Counter(map(tuple, left.collect())) == collections.Counter(map(tuple, clean))


def test_token_files(docs, rows, spark, tmp_path):
    t = tokenizer("word_bpe_49k.json")
    want, at = [], 0
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want.append((r[0], at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, token_files.round_trip(docs).collect()), key=lambda r: r[1]) == want
    parts = token_files.write(docs, str(tmp_path / "ids"))
    names = os.listdir(tmp_path / "ids")
    assert not [n for n in names if n.endswith(".tmp") or n.startswith("lengths")]
    starts = np.concatenate([np.fromfile(tmp_path / "ids" / f"offsets-{p[0]:05d}.bin", "<u8")[:-1] for p in parts])
    assert starts.tolist() == [w[1] for w in want]


def test_encoder_is_exact():
    import random

    rng = random.Random(4)
    odd = ["".join(rng.choice(" \n\tabCÉ.,1é\x01'_-\u0301\u00a0ßÀİ") for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    odd += ["Foo. Bar,\nbaz .x", "A.", ".a", " lead", "trail ", "don't we'll 1.5 2,3", "ΟΔΟΣ σας", "日本 語 😀", "\x00", "\x02", "a\x02b"]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        t, e = tokenizer(name), tokenize.Encoder(name)
        for s, ids in zip(odd, e.encode_all(odd), strict=True):
            assert np.frombuffer(ids, e.dtype).tolist() == t.encode(s, add_special_tokens=False).ids, (name, s)


def test_quality_counts(docs, rows):
    found = collections.defaultdict(list)
    for r in quality.assess(docs).collect():
        found[r.doc_id].append(r)
    for r in rows:
        t = r[1] or ""
        w = WORD.findall(t)
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        twice = {k for k, n in collections.Counter(windows).items() if n > 1}
        repeat = len({i + j for i, k in enumerate(windows) if k in twice for j in range(3)})
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * repeat > 50 * len(w)
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeat, failed)
        for x in found[r[0]]:
            if r[0] is not None:
                assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == want
                assert not (x.base_failed and x.kept)
    assert sum(map(len, found.values())) == len(rows)
    good = quality.keep_good(docs)
    assert good.columns == docs.columns
    assert sorted(str(x.doc_id) for x in good.collect()) == sorted(str(k) for k, v in found.items() for x in v if x.kept)


def test_quality_fences(spark):
    """Symbols out of line with the group go; a language where they are common keeps them."""
    plain = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    rows = [(i, plain(i), "en", "a") for i in range(300)] + [(1000 + i, plain(i).replace(" ", " | "), "table", "b") for i in range(300)] + [(5000, plain(1).replace(" ", "%%% "), "en", "a"), (5001, plain(2), "en", "new")]
    kept = {r.doc_id: r.kept for r in quality.assess(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not kept.pop(5000) and all(kept.values())


def test_packing(docs, rows):
    t = tokenizer("byte_bpe_50k.json")
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.pack(docs, capacity=64).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    total = 0
    count = collections.Counter(r[0] for r in rows)
    for r in rows:
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 2]
        total += len(ids)
        if r[0] is None:
            continue
        mine = sorted(pieces[r[0]], key=lambda x: x.piece)
        first = len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids) + 1, 64)]
        want = [(i, a, b - a, crc(ids[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        assert [(x.piece, x.start, x.length, x.ids_crc32) for x in mine] == sorted(want * count[r[0]])
    for v in sequences.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= -(-total // 64) * 1.03 + 1


def test_best_two_fit():
    rng = np.random.default_rng(0)
    for _ in range(30):
        counts = np.zeros(101, np.int64)
        for n in rng.integers(1, 101, 400):
            counts[n] += 1
        plan = packing.best_two_fit(counts, 100)
        used = collections.Counter()
        for bin_, times in plan:
            assert sum(bin_) <= 100 and times > 0
            for n in bin_:
                used[n] += times
        assert used == {i: int(c) for i, c in enumerate(counts) if c}
    # 60 + 30 leaves 10; two of 20 fill the place of 30 and the gap
    counts = np.zeros(101, np.int64)
    counts[[60, 30, 20]] = [1, 1, 2]
    assert packing.best_two_fit(counts, 100)[0] == ((60, 20, 20), 1)


def test_html():
    page = html_extract.Page(
        "<html><head><title>t</title></head><body><header>Site</header><div id=menu><a>x</a></div><main><article><header><h1>T &amp; t</h1></header><p>a<b>b</b> c&nbsp;d<br>e<p>two<div class='ad-box'>buy</div>"
        "<ul><li>one<li>two</ul><section class=comments><p>hi</section><table><tr><td>1<td>2</table><p title='a>b'>x > y <3 z</p><form>f</form><script>if(a<b){'</p>'}</script></article></main><aside>s</aside>tail"
    )
    assert page.text(set()) == "T & t\n\nab c d e\n\ntwo\n\none\n\ntwo\n\n1\n\n2\n\nx > y <3 z"
    for odd in ("", "<", "</", "<a b='", "<!-- x", "<script>", "&#x110000; &amp", "</p></b>text", "<p>" * 3000, "<![CDATA[x]]>"):
        html_extract.Page(odd).text(set())


def test_html_site_tree(spark):
    """Without an article the style tree tells template from text; copies of one page keep theirs."""
    page = lambda i: f"<body><div class='top'>Welcome to the site</div><div class='x1'><p>text {i} of page</p><p>more {i * 7}</p></div><div class='low'>All rights</div></body>"
    rows = [(i, f"http://a.example/{i}", page(i)) for i in range(40)] + [(100 + i, f"http://b.example/{i}", page(1)) for i in range(40)] + [(200, None, None), (201, "x", ""), (None, "http://c.example/", "<p>y")]
    found = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[3] == "text 3 of page\n\nmore 21"
    assert found[103] == "Welcome to the site\n\ntext 1 of page\n\nmore 7\n\nAll rights"
    assert (found[200], found[201], found[None]) == ("", "", "y")


def test_urls(spark):
    rows = [(1, "http://A.b.Example.net"), (2, None), (3, "foo"), (4, "x://example.net/en/?q"), (5, "http://Casino-Win.example.com?x"), (6, "http://a/b/c/d.html#x"), (7, "://org/fr/x://y"), (8, "https://notexample.com/de/"), (9, "https://z.example.com/de/1"), (10, "http://list.test/bad/page?q=1"), (None, "http://list.test/good")]
    listed = spark.createDataFrame([("casino-win.example.com/",), ("list.test/bad/",), (None,)], "entry string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.listed) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), listed).collect()}
    assert found == {
        1: ("a.b.example.net", "", None, "allow", None), 2: ("", "", None, "allow", None), 3: ("", "", None, "allow", None), 4: ("example.net", "/en/", "example.net/en/", "allow", None),
        5: ("casino-win.example.com", "", None, "block", "casino-win.example.com/"), 6: ("a", "/b/c/d.html", None, "allow", None), 7: ("org", "/fr/x://y", "org/fr/", "allow", None),
        8: ("notexample.com", "/de/", None, "allow", None), 9: ("z.example.com", "/de/1", "example.com/de/", "block", None), 10: ("list.test", "/bad/page", None, "block", "list.test/bad/"), None: ("list.test", "/good", None, "allow", None),
    }


def test_url_list_of_many_entries(spark):
    """The filter's false positives are removed and no listed entry is lost."""
    listed = spark.range(3000).selectExpr("concat('h', id, '.test/') as entry")
    pages = spark.range(9000).selectExpr("id as page_id", "concat('http://www.h', id, '.test/p') as url")
    found = urls.judge(pages, listed)
    assert found.where("verdict = 'block'").selectExpr("count(*)", "max(page_id)").first()[:] == (3000, 2999)
    words, blocks = urls.bloom(listed, 3000)
    assert len(words.first().words) == blocks * urls.WORDS_PER_BLOCK


def test_licenses(docs, rows):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    found = {}
    for r in licenses.scan(docs).collect():
        found[r.doc_id] = r
    for r in rows:
        if r[0] is None:
            continue
        w = word.findall(lower(r[1]))
        places = [(i, label) for phrase, label in licenses.BASE_PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        x = found[r[0]]
        assert (x.n_words, x.n_base, x.first_word, x.last_word) == (len(w), len(places), min(places)[0] if places else None, max(places)[0] if places else None)
        assert x.base_labels == ",".join(sorted({b for _, b in places})) and set(x.base_labels.split(",")) - {""} <= set(x.labels.split(","))
        assert 0 <= x.score <= 1
    assert found[1010].labels == "apache-2,mit"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("This work is licensed under the GNU General Public License, version 3.", ["gpl-3"]),
        ("SPDX-License-Identifier: Apache-2.0", ["apache-2"]),
        ("see https://www.apache.org/licenses/LICENSE-2.0 for it", ["apache-2"]),
        ("Released under the terms of the GNU Lesser General Public License v2.1 or later", ["lgpl-2.1"]),
        ("the BSD 3-Clause License", ["bsd-3-clause"]),
        ("MIT is a school with a license plate", []),
        ("", []),
    ],
)
def test_license_rules(text, want):
    stream = f" {b' '.join(licenses.words(text)).decode()} "
    assert [r.label for _, _, r in licenses.Scanner().detections(stream)] == want


def test_empty_tables(spark, empty):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    bench = spark.createDataFrame([], "item_id long, text string")
    listed = spark.createDataFrame([], "entry string")
    for df in (minhash.near_duplicates(empty), minhash.representatives(empty), sharding.byte_shards(empty), secrets.scan(empty), decontam.leaks(empty, bench), token_files.round_trip(empty), quality.assess(empty), quality.keep_good(empty), html_extract.extract(pages), packing.pack(empty), urls.judge(pages, listed), licenses.scan(empty)):
        assert df.count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, sf, name):
    assert spark_rows(queries.queries()[name](spark, sf)) == oracle_rows(queries.oracle_sql()[name], sf)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_covers_its_table(spark, sf, name):
    found = queries.queries()[name](spark, sf)
    key = "page_id" if "page_id" in found.columns else "doc_id"
    table = "pages" if key == "page_id" else "documents"
    if name != "op4_decontamination":
        assert found.select(key).distinct().count() == spark.read.parquet(f"{sf}/{table}.parquet").count()
