"""Rows that share an id, or have none, in the operators and stages that leave rows out."""

import collections
import random

import pytest
from test_operators import shingles

from glyphlake.llm import decontam, minhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def text_of(rng, n=40):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    texts = [text_of(rng) for _ in range(12)]
    near = [" ".join([*t.split()[:-1], "other"]) for t in texts]
    found = [(1, texts[0]), (3, texts[1]), (3, texts[0]), (3, texts[1]), (4, texts[2]), (4, near[2]), (4, texts[3]), (5, near[3]), (2, texts[4]), (9, near[4]), (9, texts[5]), (9, texts[5]), (9, ""), (9, ""), (9, None)]
    found += [(None, texts[0]), (None, texts[6]), (None, texts[6]), (None, None), (7, texts[7]), (6, texts[7]), (6, texts[8])]
    rng.shuffle(found)
    return [(i, t, "en", None, None) for i, t in found]


def groups(rows):
    """For each row the list of rows (by place) that its text reaches; rows without id alone."""
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    sets = [shingles(r[1]) if r[0] is not None else frozenset() for r in rows]
    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                up[max(top(a), top(b))] = min(top(a), top(b))
    return [top(i) for i in range(len(rows))]


def test_near_duplicates(spark, rows):
    root = groups(rows)
    least = {g: min((r[0] for r, x in zip(rows, root, strict=True) if x == g and r[0] is not None), default=None) for g in root}
    want = collections.Counter((r[0], len(shingles(r[1])), least[g], r[0] is None or r[0] == least[g]) for r, g in zip(rows, root, strict=True))
    found = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found) == want


def test_one_row_of_each_group_stays(spark, rows):
    root = groups(rows)
    left = [(r.doc_id, r.text) for r in minhash.representatives(spark.createDataFrame(rows, SCHEMA)).collect()]
    place = collections.defaultdict(set)
    for r, g in zip(rows, root, strict=True):
        place[r[0], r[1]].add(g)
    named = [x for x in left if x[0] is not None]
    assert len(named) == len(set(named))
    worded = {g for r, g in zip(rows, root, strict=True) if r[0] is not None and shingles(r[1])}
    assert sorted(min(place[x]) for x in named if shingles(x[1])) == sorted(worded)
    for x in named:
        assert x[0] == min(r[0] for r, g in zip(rows, root, strict=True) if g in place[x] and r[0] is not None)
    assert collections.Counter(x for x in left if x[0] is None) == collections.Counter((r[0], r[1]) for r in rows if r[0] is None)


def test_only_leaking_rows_go(spark, rows):
    items = [rows[i][1] for i in range(len(rows)) if rows[i][0] == 4][:1]
    null_text = next(r[1] for r in rows if r[0] is None and r[1])
    items.append(null_text)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    leaking = lambda t: any(100 * len(shingles(i) & shingles(t)) >= 75 * len(shingles(i)) for i in items)
    want = collections.Counter((r[0], r[1]) for r in rows if not leaking(r[1]))
    assert len(rows) > sum(want.values()) > 0
    assert collections.Counter((r.doc_id, r.text) for r in decontam.without_leaks(spark.createDataFrame(rows, SCHEMA), bench).collect()) == want


def test_large_component_meets_its_outsiders(spark):
    """The last round deals a bucket's largest component against the rest, each pair once."""
    rng = random.Random(5)
    rows = [(k, r, 7 if r < 1500 else 8 + r % 3, 100, [rng.getrandbits(6) for _ in range(minhash.PARITY_BITS // 64)]) for k, top in ((0, 1510), (1, 1600), (2, 40)) for r in range(top)]
    open_ = spark.createDataFrame(rows, "key long, rep long, component long, n long, parity array<long>")
    found = collections.Counter((r.a, r.b) for r in minhash._across(open_, 1).collect())
    want = collections.Counter()
    for top in (1510, 1600):
        for r in range(1500, top):
            want.update((m, r) for m in range(1500))
            want.update((o, r) for o in range(1500, r) if o % 3 != r % 3)
    assert found == want
