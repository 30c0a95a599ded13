"""The pipeline's stages and the operators on odd tables: nulls, repeats, empty ones, clashing names."""

import collections

import corpus_pipeline as P
import numpy as np
import pytest
from test_operators import shingles

from glyphlake.llm import decontam, quality, storage


def items_of(spark, sf):
    return [shingles(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]


def key(r):
    return (r.doc_id, r.text)


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES[:-1]])
def test_stage_on_odd_rows(spark, sf, docs, rows, name):
    stage = dict(P.STAGES)[name]
    found = stage(spark, docs, sf)
    assert found.columns == docs.columns
    left = collections.Counter(map(key, found.collect()))
    given = collections.Counter((r[0], r[1]) for r in rows)
    if name == "secret_scan":  # rows stay, texts are masked
        assert collections.Counter(k[0] for k in left.elements()) == collections.Counter(k[0] for k in given.elements())
        return
    assert all(n <= given[k] for k, n in left.items())
    if name == "near_dedup":
        assert all(n == 1 for k, n in left.items() if k[0] is not None) and sum(left[k] for k in left if k[0] is None) == sum(given[k] for k in given if k[0] is None)
    if name == "decontamination":
        leaking = lambda t: any(b and 100 * len(b & shingles(t)) >= 75 * len(b) for b in items_of(spark, sf))
        assert left == collections.Counter({k: n for k, n in given.items() if not leaking(k[1])})


def test_stages_on_an_empty_table(spark, sf, empty):
    df = empty
    for _, stage in P.STAGES:
        df = stage(spark, df, sf)
        assert df.count() == 0


def test_stages_in_turn_on_odd_rows(spark, sf, docs):
    df = docs
    for _, stage in P.STAGES:
        df = stage(spark, df, sf)
    assert df.count() > 0


def test_clashing_columns_of_the_benchmark(spark, docs):
    plain = spark.createDataFrame([(1, "one two three four five six"), (None, None)], "item_id long, text string")
    clash = spark.createDataFrame([(1, "one two three four five six", 5, 6, "x", [1]), (None, None, None, None, None, None)], "item_id long, text string, doc_id int, item int, h string, hs array<int>")
    assert sorted(decontam.leaks(docs, plain).collect()) == sorted(decontam.leaks(docs, clash).collect())


def test_sketch_quantiles(spark):
    """Within half a percent of the exact quantile, for any spread of values, and the same in each run."""
    rng = np.random.default_rng(3)
    values = {"word_length": rng.lognormal(1.5, 0.3, 4000), "symbol_rate": np.where(rng.random(4000) < 0.6, 0, rng.random(4000)), "dup_line_rate": np.zeros(4000), "repeat_rate": rng.random(4000) ** 4}
    df = spark.createDataFrame([("=en", "=a", *map(float, v)) for v in zip(*values.values(), strict=True)], "g_lang string, g_source string, " + ", ".join(f"{n} double" for n in values))
    found = quality._bounds(quality._sketches(df), "g", 0.0, "g_lang", "g_source")  # without a reach the fences are the quantiles
    first, second = found.first().g, found.first().g
    assert first == second and first.n == 4000
    for n, (upper, _, _, two_sided) in quality.RATES.items():
        exact = lambda p: np.sort(values[n])[int(np.floor(p * 3999))]  # noqa: E731, B023
        assert first[n].high == pytest.approx(exact(upper), rel=0.006)
        if two_sided:
            assert first[n].low == pytest.approx(exact(1 - upper), rel=0.006)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "yarn"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(*_):
                return None

    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        storage.shared_dir(Session)


