"""The pipeline: every stage's decisions take effect on what the stage before kept."""

from collections import Counter

import corpus_pipeline
from obsexp.llm import mixing, near_dedup, pieces, secrets, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_and_result(spark, small):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    assert list(stages) == ["toxicity", "near copies", "secret scans", "source mixing", "piece encoding"]

    clean = stages["toxicity"](spark, docs, small).cache()
    score = {r.doc_id: r.predicted for r in toxicity.score_documents(docs, labels).collect()}
    assert clean.columns == COLUMNS
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, p in score.items() if not p)

    single = stages["near copies"](spark, clean, small).cache()
    kept = {r.doc_id for r in near_dedup.near_duplicates(clean).where("kept").collect()}
    assert single.columns == COLUMNS and {r.doc_id for r in single.collect()} == kept and single.count() == len(kept)

    safe = stages["secret scans"](spark, single, small).cache()
    assert safe.columns == COLUMNS and safe.count() == single.count()
    assert all(r.n_assign + r.n_access + r.n_hex == 0 for r in secrets.report(safe).collect())
    found = {r.doc_id for r in secrets.report(single).where("spans <> ''").collect()}
    before = {r.doc_id: r.text for r in single.collect()}
    assert all((r.text != before[r.doc_id]) == (r.doc_id in found) for r in safe.collect())

    mixed = stages["source mixing"](spark, safe, small).cache()
    copies = {r.doc_id: r.copies for r in mixing.mix(safe).collect()}
    assert mixed.columns == COLUMNS
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in copies.items() if n})

    encoder = pieces.Encoder(pieces.Pieces.load(pieces.DEFAULT_MODEL))
    ids = {r.doc_id: encoder.encode(r.text) for r in mixed.collect()}
    rows = corpus_pipeline.run(spark, small).collect()
    assert len(rows) == mixed.count()
    assert all(r.exact and list(r.ids) == list(ids[r.doc_id]) for r in rows)


def test_no_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        assert docs.count() == 0, name
