"""The pipeline's stages, one after another, against plain versions."""

import corpus_pipeline as P
from test_operators import components, shingles, tokenizer

from glyphlake.llm import quality, secrets


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id: r for r in docs.collect()}
    bench = [shingles(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert [n for n, _ in P.STAGES] == ["quality_rules", "near_dedup", "decontamination", "secret_scan", "best_fit_packing"]
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
        rows = {r.doc_id: r for r in docs.collect()}
        if name == "quality_rules":
            assert set(rows) == {r.doc_id for r in quality.assess(spark.createDataFrame(list(kept.values()))).collect() if r.kept}
        elif name == "near_dedup":
            assert set(rows) == {i for i, c in components({i: shingles(r.text) for i, r in kept.items()}).items() if i == c}
        elif name == "decontamination":
            leaked = {i for i, r in kept.items() if any(100 * len(b & shingles(r.text)) >= 75 * len(b) for b in bench if b)}
            assert set(rows) == set(kept) - leaked
        else:
            random = secrets.RandomStrings()
            for i, r in kept.items():
                want = secrets.masked(r.text, secrets.spans(r.text, r.text.encode().lower(), random))
                assert (rows[i].text, rows[i].n_chars) == (want, len(want))
        kept = rows
    t = tokenizer("byte_bpe_50k.json")
    packed = P.run(spark, sf).collect()
    assert {r.doc_id for r in packed} == set(kept)
    assert sum(r.length for r in packed) == sum(len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in kept.values())
    assert P.ORACLE_SQL is None
