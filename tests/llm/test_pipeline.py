"""The pipeline against a version of each stage by brute force."""

import corpus_pipeline
import pyarrow as pa
from test_operators import brute_groups, brute_repeats, check_packed, coder  # noqa: F401

from lexiforge.llm import language_id, near_dedup, pii
from lexiforge.llm.textops import flat


def test_stages_are_named_functions():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeated_passages", "personal_data", "packing"]


def test_every_stage_takes_effect(spark, data, coder):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    rows = {r["doc_id"]: r.asDict() for r in docs.collect()}
    # language
    out = corpus_pipeline.language(spark, docs, data)
    assert out.columns == columns
    rejected = {r["doc_id"] for r in language_id.language_report(docs).where("kept = 0").collect()}
    rows = {i: r for i, r in rows.items() if i not in rejected}
    # near duplicates
    groups = brute_groups({i: r["text"] for i, r in rows.items()}, near_dedup.THRESHOLD)
    kept = spark.createDataFrame(out.collect(), docs.schema)
    out = corpus_pipeline.near_duplicates(spark, kept, data)
    assert out.columns == columns
    rows = {i: r for i, r in rows.items() if groups[i] == i}
    assert {r["doc_id"] for r in out.collect()} == set(rows)
    # repeated passages
    kept = spark.createDataFrame(out.collect(), docs.schema)
    out = corpus_pipeline.repeated_passages(spark, kept, data)
    assert out.columns == columns
    gone = brute_repeats({i: r["text"].split() for i, r in rows.items()}, 50)
    got = {r["doc_id"]: r for r in out.collect()}
    assert set(got) == set(rows) and any(gone.values())
    for i, r in rows.items():
        words = r["text"].split()
        assert got[i]["text"].split() == [w for k, w in enumerate(words) if k not in gone[i]] and got[i]["n_chars"] == len(got[i]["text"])
        if not gone[i]:
            assert got[i]["text"] == r["text"]
    # personal data
    kept = spark.createDataFrame(list(got.values()), docs.schema)
    out = corpus_pipeline.personal_data(spark, kept, data)
    assert out.columns == columns
    new = {r["doc_id"]: r["text"] for r in out.collect()}
    model = pii.train()
    for i, r in got.items():
        found = pii.entities(model, *flat(pa.array([r["text"]])))
        raw = r["text"].encode()
        for _, s, e, k in reversed(found):
            raw = raw[:s] + f"[{k}]".encode() + raw[e:]
        assert new[i] == raw.decode()
    assert any(new[i] != got[i]["text"] for i in got)
    # packing, and all at once
    whole = corpus_pipeline.run(spark, data).collect()
    check_packed(whole, new, coder[1])
