import json
import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexiforge.cli import main
from lexiforge.config import DEFAULT
from lexiforge.errors import IndexConflict
from lexiforge.functions import counting
from lexiforge.functions.stems import STEMMERS
from lexiforge.operators import bm25
from lexiforge.operators.federate import Corpus, IndexEngine
from lexiforge.operators.search import Search
from lexiforge.sources.index import Analyzer, IndexStore, build
from lexiforge.streaming.index_stream import apply_changes, index_stream, latest

DOCS = [(1, "john smith"), (2, "john john john"), (3, "jane of the doe"), (4, ""), (5, None), (6, "0")]


@pytest.fixture()
def store(spark, tmp_path):
    return IndexStore(spark, str(tmp_path / "index"))


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame(DOCS, "id long, t string")


def counts(store):
    return {r["term"]: r["doc_count"] for r in store.dictionary().collect()}


def test_scores_by_hand(docs):
    index = build(docs, "id", ["t"])
    got = {r["model_id"]: r["score"] for r in bm25.scores(index, ["john"]).collect()}
    avg = (2 + 3 + 2) / 3
    idf = math.log((3 - 2 + 0.5) / (2 + 0.5) + 1)
    tf = lambda f, n: f * 2.5 / (f + 1.5 * (0.25 + 0.75 * n / avg))
    assert got == {"1": round(idf * tf(1, 2), 6), "2": round(idf * tf(3, 3), 6)}
    assert [r["model_id"] for r in bm25.search(index, ["john"], 5).collect()] == ["2", "1"]
    assert bm25.count(index, ["john", "jane"]) == 3 and bm25.count(index, []) == 0 and bm25.scores(index, []).isEmpty()
    one = bm25.scores(index, ["john"], DEFAULT.with_(max_postings=1)).collect()
    assert [r["model_id"] for r in one] == ["2"]


def test_term_frequency_wins(spark):
    df = spark.createDataFrame([(1, "python developer"), (2, "php developer python python")], "id long, t string")
    assert bm25.search(build(df, "id", ["t"]), ["python"], 2).first()["model_id"] == "2"
    rows = [(i, f"python python paginate{i}") for i in range(5)] + [(10 + i, f"paginate user {i}") for i in range(25)]
    df = spark.createDataFrame(rows, "id long, t string")
    assert bm25.count(build(df, "id", ["t"]), ["python"]) == 5


def test_lifecycle(spark, docs, store):
    assert store.read("d") is None and store.status().collect() == [] and counts(store) == {}
    store.rebuild("d", docs, "id", ["t"])
    assert counts(store) == {"john": 2, "smith": 1, "jane": 1, "doe": 1}
    assert store.upsert("d", docs, "id", ["t"]) == 3 and counts(store)["john"] == 2
    assert store.upsert("d", spark.createDataFrame([(1, "mary smith"), (4, "")], "id long, t string"), "id", ["t"]) == 1
    assert counts(store) == {"john": 1, "smith": 1, "mary": 1, "jane": 1, "doe": 1}
    store.upsert("d", spark.createDataFrame([(1, "")], "id long, t string"), "id", ["t"])
    assert counts(store)["mary"] == 1  # a row without terms leaves what was there
    store.remove("d", spark.createDataFrame([(2,)], "id long"))
    assert "john" not in counts(store)
    store.rebuild("e e/x", docs, "id", ["t"])
    assert sorted(store.model_types()) == ["d", "e e/x"] and counts(store)["smith"] == 2
    s = {r["model_type"]: r for r in store.status().collect()}
    assert s["e e/x"]["total_docs"] == 3 and s["e e/x"]["avg_doc_length"] == pytest.approx(7 / 3) and s["e e/x"]["n_terms"] == 4
    store.flush("e e/x")
    assert store.model_types() == ["d"] and "john" not in counts(store)
    store.clear()
    assert store.model_types() == []


def test_cap_on_distinct_terms(spark):
    df = spark.createDataFrame([(1, "aa bb aa cc bb aa dd"), (2, "aa bb")], "id long, t string")
    got = {(r["model_id"], r["term"]): r["frequency"] for r in build(df, "id", ["t"], Analyzer(max_tokens=3)).postings.collect()}
    assert got == {("1", "aa"): 2, ("1", "bb"): 1, ("1", "cc"): 1, ("2", "aa"): 1, ("2", "bb"): 1}


def test_stems_and_several_columns(spark):
    df = spark.createDataFrame([("u-1", "running jumps", "run"), ("u-2", "x" * 300, "of")], "id string, a string, b string")
    i = build(df, "id", ["a", "b"], Analyzer(stemmer="english"))
    assert {(r["model_id"], r["term"], r["frequency"]) for r in i.postings.collect()} == {("u-1", "run", 2), ("u-1", "jump", 1)}


def test_indexed_search(docs, store):
    store.rebuild("d", docs, "id", ["t"])
    s = Search(docs, "id", store=store, corpus="d").search("john").use_inverted_index()
    rows = s.highlight()._(weights={"t": 1}).get().collect()
    assert [(r["id"], r["_score"]) for r in rows][0] == (2, 1.0) and rows[1]["_score"] < 1 and rows[0]["_highlighted"]["t"].startswith("<em>")
    p = s.paginate(1, 2)
    assert p.total == 2 and [r["id"] for r in p.items.collect()] == [1]
    assert s.use_inverted_index(False).indexed is False and s.use_inverted_index("none").get().isEmpty()
    assert s.search("jon").did_you_mean()[0]["term"] == "john"
    assert [r["id"] for r in s._(settings=DEFAULT.with_(global_df=True)).get().collect()] == [2, 1]


def test_engine(docs, store, spark):
    e, c = IndexEngine(store), Corpus("d", docs, "id", ["t"])
    assert e.update(c) == 3
    r = e.search("d", "john")
    assert [x["model_id"] for x in e.map_ids(r).collect()] == ["2", "1"] and e.total_count(r) == 2
    assert [(x["id"], x["_score"] > 0) for x in e.map(r, c).collect()] == [(2, True), (1, True)]
    page, total = e.paginate("d", "john", 1, 2)
    assert total == 2 and page.first()["model_id"] == "1"
    e.delete("d", spark.createDataFrame([(2,)], "id long"))
    assert e.search("d", "john").count() == 1 and e.create_index("x") is None
    e.flush("d")
    assert e.search("d", "john").isEmpty()


def test_many_queries(spark, docs):
    index = build(docs, "id", ["t"])
    q = spark.createDataFrame([(1, "john"), (1, "john"), (2, "jane"), (2, "doe"), (3, "none")], "query_id int, term string")
    got = {(r["query_id"], r["rank"]): (r["model_id"], r["score"]) for r in bm25.search_many(index, q, 2).collect()}
    assert got[1, 1] == tuple(bm25.search(index, ["john"], 1).first()) and got[2, 1] == tuple(bm25.search(index, ["jane", "doe"], 1).first()) and len(got) == 3


CHANGES = "seq long, op string, id long, t string"


def test_change_batches_are_replay_safe(spark, store):
    batch = spark.createDataFrame([(1, "upsert", 1, "john smith"), (2, "upsert", 2, "jane"), (3, "upsert", 1, "john doe"), (4, "delete", 2, "jane"), (5, "upsert", 3, None)], CHANGES)
    assert {r["id"]: r["seq"] for r in latest(batch, "id", ["seq"]).collect()} == {1: 3, 2: 4, 3: 5}
    for _ in range(2):
        apply_changes(store, "d", batch, "id", ["t"])
        assert counts(store) == {"john": 1, "doe": 1}


def test_stream(spark, store, tmp_path):
    path = str(tmp_path / "in")
    run = lambda: index_stream(spark.readStream.schema(CHANGES).parquet(path), store, "d", "id", ["t"], str(tmp_path / "state")).awaitTermination()
    spark.createDataFrame([(1, "upsert", 1, "john smith"), (2, "upsert", 2, "jane")], CHANGES).write.parquet(path)
    run()
    assert counts(store) == {"john": 1, "smith": 1, "jane": 1}
    spark.createDataFrame([(3, "delete", 1, "")], CHANGES).write.mode("append").parquet(path)
    run()
    assert counts(store) == {"jane": 1}


def test_command_line(spark, tmp_path, data, capsys):
    at = str(tmp_path / "cli")
    assert main([at, "rebuild", "part", f"{data}/part.parquet", "p_partkey", "p_name"]) == 0
    assert IndexStore(spark, at).read("part").meta.first()["total_docs"] == spark.read.parquet(f"{data}/part.parquet").count()
    assert main([at, "status"]) == 0 and main([at, "explain", f"{data}/part.parquet", "p_partkey", "p_name", "ring"]) == 0
    for name in ("x", "y", "x"):
        assert main([at, "content", name, f"{data}/part.parquet", "p_partkey", "p_name,p_brand", f"{at}-c"]) == 0
    n = spark.read.parquet(f"{data}/part.parquet").count()
    assert {r["model"]: r["count"] for r in spark.read.parquet(f"{at}-c").groupBy("model").count().collect()} == {"x": n, "y": n}
    assert main([at, "shadow", f"{data}/part.parquet", "p_name", f"{at}-s"]) == 0 and "p_name_metaphone" in spark.read.parquet(f"{at}-s").columns
    assert main([at, "flush", "part"]) == 0 and main([at, "clear"]) == 0 and main([]) == 2 and main([at, "nope"]) == 2


def test_content_column(spark):
    from lexiforge.sources.index import content_table

    df = spark.createDataFrame([(1, "a", None), (2, None, "b")], "id long, x string, y string")
    assert [r["content"] for r in content_table(df, "m", "id", ["x", "y"]).orderBy("model_id").collect()] == ["a", "b"]
    assert content_table(df.withColumn("z", F.lit(3)), "m", "id", ["z"]).first()["content"] == "3"


def test_changes_are_segments(spark, docs, tmp_path):
    """What a change writes is its own size; readers keep the version they opened; merging changes nothing."""
    store = IndexStore(spark, str(tmp_path / "s"), DEFAULT.with_(merge_segments=3, keep_versions=3))
    store.rebuild("d", docs, "id", ["t"])
    before = store.read("d")
    new = lambda i, t: spark.createDataFrame([(i, t)], "id long, t string")
    assert store.upsert("d", new(1, "mary smith"), "id", ["t"]) == 1
    assert len(store._state("d")[1]["segments"]) == 2
    assert {r["term"] for r in before.postings.collect()} == {"john", "smith", "jane", "doe"}  # as it was opened
    now = store.read("d")
    want = build(new(1, "mary smith").union(spark.createDataFrame([d for d in DOCS if d[0] != 1], "id long, t string")), "id", ["t"])
    same = lambda a, b: sorted(map(tuple, a.select(*sorted(a.columns)).collect())) == sorted(map(tuple, b.select(*sorted(b.columns)).collect()))
    assert same(now.postings, want.postings) and same(now.documents, want.documents) and same(now.terms, want.terms) and same(now.meta, want.meta)
    store.remove("d", spark.createDataFrame([(3,), (99,)], "id long"))
    assert counts(store) == {"john": 1, "smith": 1, "mary": 1} and store.read("d").meta.first()["total_docs"] == 2
    for i in range(4):
        store.upsert("d", new(10 + i, f"john w{i}x"), "id", ["t"])
    assert len(store._state("d")[1]["segments"]) <= 4 and counts(store)["john"] == 5
    store.upsert("d", new(20, "zoe"), "id", ["t"])
    assert store.merge("d") != store.merge("d") and counts(store)["john"] == 5 and store.read("d").meta.first()["total_tokens"] == 14
    assert len(store.files.names("versions/d")) == 3
    used = {s["id"] for n in store.files.names("versions/d") for s in json.loads(store.files.read(f"versions/d/{n}"))["segments"]}
    assert set(store.files.names("segments")) == used


def test_two_writers(spark, docs, tmp_path, monkeypatch):
    """The second of two writers that began with one version takes up the first one's; a rebuild says so."""
    store, other = (IndexStore(spark, str(tmp_path / "w")) for _ in range(2))
    store.rebuild("d", docs, "id", ["t"])
    real = IndexStore._write

    def between(self, *a):
        monkeypatch.setattr(IndexStore, "_write", real)
        other.upsert("d", spark.createDataFrame([(7, "zoe")], "id long, t string"), "id", ["t"])
        return real(self, *a)

    monkeypatch.setattr(IndexStore, "_write", between)
    store.upsert("d", spark.createDataFrame([(8, "zoe yves")], "id long, t string"), "id", ["t"])
    assert counts(store)["zoe"] == 2 and store.read("d").meta.first()["total_docs"] == 5
    monkeypatch.setattr(IndexStore, "_write", between)
    with pytest.raises(IndexConflict):
        store.rebuild("d", docs, "id", ["t"])


def test_unchanged_rows_are_passed_over(spark, store, docs):
    store.rebuild("d", docs, "id", ["t"])
    n = store._state("d")[0]
    assert store.upsert("d", docs, "id", ["t"], skip_unchanged=True) == 0 and store._state("d")[0] == n
    more = docs.union(spark.createDataFrame([(9, "new one")], "id long, t string"))
    assert store.upsert("d", more, "id", ["t"], skip_unchanged=True) == 1 and counts(store)["john"] == 2


def test_bm25_reads_no_documents(docs, store):
    store.rebuild("d", docs, "id", ["t"])
    plan = bm25.search(store.read("d"), ["john"], 5)._jdf.queryExecution().executedPlan().toString()
    assert "/documents" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_build_holds_no_table_of_terms(spark, docs):
    """What a task of the build holds is the texts that it sorts: it has no hash table or window of its share's terms, and takes texts apart once."""
    for analyzer in (Analyzer(), Analyzer(stemmer="english")):
        plan = build(docs, "id", ["t"], analyzer).postings._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in plan and "Window" not in plan and "Join" not in plan
        assert plan.count("Exchange") == 1 and plan.count("regexp_extract_all") == 1


WORDS = ["aa", "bb", "running", "runs", "run", "the", "x", "Ünï", "y" * 256, "é" * 127, "é" * 128, "things", "thing"]


@pytest.mark.parametrize("stemmer", ["none", "english"])
@pytest.mark.parametrize("most", [None, 1, 3])
def test_build_by_brute_force(spark, stemmer, most):
    """Rows of one id are one document, each cut for itself; nulls, empty texts, stop words and long words."""
    r = random.Random(7)
    rows = [(r.choice([None, *range(12)]), r.choice([None, "", "0", *[" ".join(r.choices(WORDS, k=r.randrange(1, 9))) for _ in range(6)]]), r.choice([None, "bb run"])) for _ in range(60)]
    want = {}
    for key, *texts in rows:
        words = [w for t in texts if t not in (None, "", "0") for w in t.lower().split() if len(w) >= 2 and w != "the"]
        terms = [t for t in (words if stemmer == "none" else map(STEMMERS[stemmer], words)) if len(t.encode()) <= 255]
        for t in terms if most is None else [t for i, t in enumerate(terms) if len(set(terms[:i])) < most]:
            if key is not None:
                want[str(key), t] = want.get((str(key), t), 0) + 1
    index = build(spark.createDataFrame(rows, "id long, a string, b string"), "id", ["a", "b"], Analyzer(stemmer=stemmer, max_tokens=most))
    got = index.postings.collect()
    assert len(got) == len(want) and {(p["model_id"], p["term"]): p["frequency"] for p in got} == want
    total = lambda key: sum(n for (k, _), n in want.items() if k == key)
    assert all(p["doc_length"] == total(p["model_id"]) for p in got)
    assert {d["model_id"]: d["doc_length"] for d in index.documents.collect()} == {k: total(k) for k, _ in want}


def test_counting_across_batches(monkeypatch):
    """Documents go on over steps and batches of any size."""
    r = random.Random(3)
    rows = [(d, [r.choice(["aa", "bb", "cc", None]) for _ in range(r.randrange(5))]) for d in "abcd" for _ in range(r.randrange(1, 9))] + [("e", None), ("f", ["aa"])]
    want = {}
    for d, words in rows:
        for w in words or []:
            if w:
                want[d, w] = want.get((d, w), 0) + 1
    schema = pa.schema([("model_id", pa.string()), ("words", pa.list_(pa.string()))])
    for step in (1, 3, 1000):
        monkeypatch.setattr(counting, "STEP_WORDS", step)
        for size in (1, 4, 100):
            batches = pa.Table.from_arrays([pa.array([d for d, _ in rows]), pa.array([w for _, w in rows], schema.field(1).type)], schema=schema).to_batches(max_chunksize=size)
            got = [x for b in counting.postings(batches, (), None, None) for x in b.to_pylist()]
            assert len(got) == len(want) and {(x["model_id"], x["term"]): x["frequency"] for x in got} == want
            assert all(x["doc_length"] == sum(n for (d, _), n in want.items() if d == x["model_id"]) for x in got)
