"""Nulls, empty and long texts, repeated rows, ties, empty tables and clashing columns, for every operator on documents."""

import os

import pytest
from fixtures import SCHEMA, frame, messy

from lexiforge.llm import bpe, fingerprints, language_id, near_dedup, packing, pii, suffix_dedup, token_rollup
from lexiforge.llm.base import clean
from lexiforge.llm.queries import RANKS

OPERATORS = {
    "language_report": language_id.language_report,
    "keep_identified": language_id.keep_identified,
    "fingerprints": fingerprints.document_fingerprints,
    "fingerprint_pairs": fingerprints.fingerprint_pairs,
    "identify": lambda d: language_id.identify(d, language_id.train(["the", "le"], ["en", "fr"])),
    "bpe_rollup": lambda d: token_rollup.corpus_rollup(d, {"v": RANKS}),
    "groups": near_dedup.near_duplicate_groups,
    "dedup_report": near_dedup.dedup_report,
    "near_dedup": near_dedup.near_dedup,
    "pack": lambda d: packing.pack(d, RANKS),
    "bpe": lambda d: bpe.bpe_encode(d, RANKS),
    "rollup": token_rollup.corpus_rollup,
    "pii_report": pii.pii_report,
    "redact": pii.redact,
    "repeats_report": suffix_dedup.repeats_report,
    "remove_repeats": suffix_dedup.remove_repeats,
}
SAME_COLUMNS = {"keep_identified", "near_dedup", "redact", "remove_repeats"}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    out = OPERATORS[name](frame(spark, []))
    assert out.collect() == []
    if name in SAME_COLUMNS:
        assert out.columns == SCHEMA.names


@pytest.mark.parametrize("name", OPERATORS)
def test_ids_that_are_no_numbers(spark, name):
    rows = spark.createDataFrame([("a", "one two three", "en", "s"), ("7", "one two three", "en", "s"), (None, None, None, None)], "doc_id string, text string, lang string, source string")
    out = OPERATORS[name](rows).collect()
    if name in SAME_COLUMNS:
        assert {r["doc_id"] for r in out} >= {"a", "7"}


def test_the_session_stays_as_it_is(spark):
    before = dict(spark.conf.getAll)
    out = near_dedup.near_dedup(frame(spark, messy()[:2]))
    assert out.sparkSession is spark and dict(spark.conf.getAll) == before
    out.createOrReplaceTempView("kept_documents")
    assert spark.sql("select count(*) from kept_documents").first()[0] == 1


def test_what_is_saved_lies_in_the_shared_folder_and_goes(spark):
    language_id.keep_identified(frame(spark, messy()[:2]))
    packing.pack(frame(spark, messy()[:2]), RANKS).collect()
    there = os.path.join(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"), f"lexiforge-{spark.sparkContext.applicationId}")
    assert os.listdir(there)
    clean()
    assert not os.path.exists(there)


def test_decoding(spark):
    rows = [(1, [40, 716], "x"), (2, None, "x"), (3, [], "x"), (4, [None, 40, -5, 10**9], "x")]
    df = spark.createDataFrame(rows, "doc_id long, tokens array<int>, decoded string")
    out = bpe.bpe_decode(df, RANKS)
    assert out.columns == ["doc_id", "tokens", "decoded", "decoded_"]
    got = {r["doc_id"]: r["decoded_"] for r in out.collect()}
    assert got[1] == bpe.bpe_decode(df.drop("decoded"), RANKS).where("doc_id = 1").first()["decoded"] != ""
    assert got[2] == got[3] == "" and got[4] == got[1][:1]
    assert bpe.bpe_decode(df.where("false"), RANKS).collect() == []


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, messy()).repartition(3).persist()


def test_language(docs):
    rows = language_id.language_report(docs).collect()
    assert len(rows) == len(messy())
    und = {r["doc_id"] for r in rows if r["predicted"] == "und"}
    assert {4, 5, 8, 9} <= und and 1 not in und
    assert all((r["margin"] is None) == (r["predicted"] == "und") for r in rows)
    kept = language_id.keep_identified(docs)
    assert kept.columns == SCHEMA.names
    assert {4, 5, 8, 9}.isdisjoint({r["doc_id"] for r in kept.collect()})


def test_fingerprints(docs):
    rows = fingerprints.document_fingerprints(docs).collect()
    assert len(rows) == len(messy())
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[2]["match_id"] == 1 and by[2]["jaccard"] == 1.0 and by[1]["match_id"] is None and by[1]["n_copies"] == 3
    assert by[3]["match_id"] == 1 and 0.5 <= by[3]["jaccard"] < 1 and by[3]["class_id"] == 3 and by[1]["n_links"] >= 1
    assert by[13]["match_id"] == 6 and by[14]["match_id"] == 6
    for i in (4, 5, 8, 9):
        assert by[i]["n_shingles"] == 0 and by[i]["signature"] is None and by[i]["match_id"] is None and by[i]["n_links"] == 0
    assert all(r["match_id"] is None and r["class_id"] is None for r in rows if r["doc_id"] is None)


def test_near_dedup(docs):
    got = {r["doc_id"]: (r["group_id"], r["kept"]) for r in near_dedup.dedup_report(docs).collect()}
    assert got[1] == (1, 1) and got[2] == (1, 0) and got[3] == (1, 0) and got[11] == (1, 0)
    assert got[6] == (6, 1) and got[13] == (6, 0) and got[14] == (6, 0) and got[4] == (4, 1)
    kept = near_dedup.near_dedup(docs)
    assert kept.columns == SCHEMA.names
    ids = sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in kept.collect())
    assert ids == [(False, 0)] * 2 + [(True, i) for i in (1, 4, 5, 6, 7, 8, 9, 10, 12)]


def test_one_of_repeated_rows_stays(spark):
    text = messy()[0][1]
    twice = [(1, "a b c"), (1, "a b c"), (2, text), (2, text), (3, text)]
    got = near_dedup.near_dedup(spark.createDataFrame(twice, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 2]


def test_packing(docs):
    rows = packing.pack(docs, RANKS).collect()
    ids = [i for r in rows for i in r["doc_ids"]]
    assert {i for i in ids if i is not None} == {r[0] for r in messy() if r[0] is not None}
    assert ids[0] is None and all(r["n_tokens"] + r["padding"] == packing.CAPACITY for r in rows)


def test_bpe(docs):
    rows = bpe.bpe_encode(docs, RANKS)
    assert rows.count() == len(messy()) and rows.where("round_trip = 0").isEmpty()
    assert {r["n_tokens"] for r in rows.where("doc_id in (4, 5)").collect()} == {0}


def test_rollup(docs):
    got = {(r["source"], r["lang"], r["tokenizer_version"]): (r["docs"], r["tokens"]) for r in token_rollup.corpus_rollup(docs).collect()}
    # 17 rows, less the later copies: 2, 2, null or 1 of the first text, and 13 and 14 of "one"
    assert sum(d for (_, _, v), (d, _) in got.items() if v == "words-v1") == len(messy()) - 5
    assert (None, None, "words-v1") in got and got[None, None, "words-v1"][0] == 1


def test_pii(docs):
    rows = pii.pii_report(docs).collect()
    assert len(rows) == len(messy())
    by = {r["doc_id"]: r for r in rows}
    assert by[10]["text"] == "Mail to [EMAIL] or [PHONE]." and by[10]["n_entities"] == 2
    assert by[5]["text"] is None and by[5]["n_entities"] == 0 and by[4]["text"] == ""
    text = messy()[12][1]
    assert [text[e["start"] : e["end"]] for e in by[10]["entities"]] == ["anna.b@mail.org", "+1 (212) 555-7788"]
    out = pii.redact(docs)
    assert out.columns == SCHEMA.names
    r = out.where("doc_id = 10").first()
    assert r["n_chars"] == len(r["text"])


def test_repeats(docs):
    rows = suffix_dedup.repeats_report(docs).collect()
    assert len(rows) == len(messy())
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[1]["removed_words"] == 0 and by[2]["text"] == "" and by[2]["removed_words"] == 300
    assert by[11]["removed_words"] == 300 and len(by[11]["text"].split()) == 80
    assert by[5]["text"] is None and by[4]["text"] == "" and by[8]["text"] == "   \n\t "
    assert sorted(r["text"] or "" for r in rows if r["doc_id"] is None) == ["", messy()[0][1]]
    assert suffix_dedup.remove_repeats(docs).columns == SCHEMA.names


def test_ids_of_different_texts_are_not_compared(spark):
    a, b = messy()[0][1], messy()[9][1][:3000]
    got = suffix_dedup.repeats_report(spark.createDataFrame([(1, a), (2, a), (2, b), (3, a)], "doc_id int, text string")).collect()
    assert sorted((r["doc_id"], r["removed_words"]) for r in got) == [(1, 0), (2, 0), (2, 0), (3, 300)]
