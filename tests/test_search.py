import pytest
from pyspark.sql import functions as F

from lexiforge.cli import benchmark
from lexiforge.config import DEFAULT, SEARCH_STOP_WORDS
from lexiforge.errors import EmptySearchTerm, InvalidConfig, NoSearchableColumns, NotSupported, UnknownAlgorithm
from lexiforge.operators import matching as M
from lexiforge.operators.federate import Catalog, Corpus, Federated, MemorySearch
from lexiforge.operators.search import Search, clear_cache, likely_columns, on_search, render_highlighted

USERS = [(i, n, e + "@example.com") for i, (n, e) in enumerate([("John Doe", "john"), ("Jane Doe", "jane"), ("Jon Snow", "jon"), ("Johnny Bravo", "johnny"), ("Alice Smith", "alice"), ("Bob Johnson", "bob"), ("Charlie Brown", "charlie")], 1)]
ATTACKS = ["'; DROP TABLE users; --", "' UNION SELECT 1 --", "' OR '1'='1", "admin'--", "`id`", "a; b", "a\0b", "%%john%%", "\\'", "a" * 100, "ünï©ødé", "a\nb", "a\rb", "\\", "a\\", "[a]", "(?i).*"]


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame(USERS, "id long, name string, email string").persist()


@pytest.fixture(scope="module")
def corpus(users):
    return Corpus("users", users, "id", {"name": 10, "email": 5}, "fuzzy")


def ids(df):
    return [r["id"] for r in df.collect()]


def names(spark, *values):
    return Search(spark.createDataFrame(list(enumerate(values, 1)), "id long, name string"), "id").search_in({"name": 10})


def test_scores(corpus):
    rows = corpus.search("john").get().collect()
    assert [(r["id"], r["_raw_score"]) for r in rows] == [(1, 1200.0), (4, 1200.0), (6, 626.32), (3, 328.95)]
    assert [r["_score"] for r in rows] == [1.0, 1.0, 0.521933, 0.274125]


@pytest.mark.parametrize("algorithm", ["fuzzy", "levenshtein", "simple", "like", "soundex", "trigram", "similar_text"])
def test_algorithms_find_john(corpus, algorithm):
    assert 1 in ids(corpus.search("john").using(algorithm).get())
    assert 1 in ids(corpus.search("john").using(algorithm).options(native=True).accent_insensitive(False).search("Jon" if algorithm == "soundex" else "John Doe").get())


def test_typos(corpus):
    assert 1 in ids(corpus.search("jonh").get()) and 1 in ids(corpus.search("jhon").using("levenshtein").get())
    assert corpus.search("jonh").using("levenshtein").typo_tolerance(0).get().isEmpty()


def test_candidates_are_a_top_k(corpus):
    for s in (corpus.search("jonh"), corpus.search("john").highlight().debug_score(), corpus.search("a | b").extended()):
        plan = s.get()._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in plan and plan.count("TakeOrderedAndProject") == 2
        assert plan.index("ArrowEvalPython") < plan.rindex("TakeOrderedAndProject")


def test_rank_before_limit(spark):
    s = names(spark, *[f"johnxxx{i}" for i in range(5)], "john").search("john")
    assert ids(s.take(3).get())[0] == 6
    s = names(spark, "john", *[f"johnx{i}" for i in range(4)]).search("john")
    assert 1 not in ids(s.skip(1).take(2).get())


def test_attacks_find_nothing_they_should_not(corpus, users):
    for a in ATTACKS:
        for algorithm in ("fuzzy", "levenshtein", "simple", "soundex", "trigram"):
            corpus.search(a).using(algorithm).matched().count()
    s = corpus.search("x").using("simple")
    assert s.search("%").matched().isEmpty() and s.search("_").matched().isEmpty()
    for bad in ("name; drop", "1a", "", "a-b", "a b"):
        with pytest.raises(ValueError):
            s.search_in([bad])
        with pytest.raises(ValueError):
            users.transform(M.order_by_fuzzy(bad, "x"))


def test_guards(corpus):
    for empty in ("", "0"):
        with pytest.raises(EmptySearchTerm):
            corpus.search(empty).get()
    assert corpus.search("j").get().isEmpty() and corpus.search("j").collect() == []
    assert len(corpus.search("x")._(settings=DEFAULT.with_(allow_empty_search=True)).search("").get().collect()) == 7
    assert corpus.search("j" * 500)._guarded().term == "j" * 128
    with pytest.raises(UnknownAlgorithm):
        corpus.search("john").using("nope")
    with pytest.raises(UnknownAlgorithm):
        M.fuzzy_match("name", "x", "nope")
    M.fuzzy_match("name", "x", "nope", DEFAULT.with_(unknown_algorithm_is_levenshtein=True))
    with pytest.raises(NotSupported):
        corpus.search("john").cursor_paginate()
    with pytest.raises(NotSupported):
        corpus.search("john").extended().paginate()
    with pytest.raises(NoSearchableColumns):
        Search(corpus.df).extended("john").get()
    with pytest.raises(InvalidConfig):
        corpus.search("john").preset("nope")


def test_clamps(corpus):
    s = corpus.search("john")
    assert [s.typo_tolerance(n).typos for n in (-1, 3, 9)] == [0, 3, 5] and s.prefix_boost(0.1).boost == 1.0
    assert s.min_match_length(0).shortest_match == 1 and s.max_patterns(1).options_["max_patterns"] == 10
    assert s.search_in({"name": 3.9}).weights["name"] == 3 and s.page(3, 20).start == 40


def test_presets(corpus, spark):
    s = Search(corpus.df).search("john").preset("users")
    assert s.algorithm == "levenshtein" and s.weights == {"name": 10, "email": 8, "username": 9} and s.typos == 2
    assert Search(corpus.df).preset("blog").stop_words and Search(corpus.df).preset("ecommerce").partial
    assert Search(corpus.df).preset("phonetic").algorithm == "soundex" and Search(corpus.df).preset("exact").algorithm == "simple"


def test_tokens_synonyms_and_stop_words(corpus, spark):
    s = corpus.search("doe john").using("simple").tokenize()
    assert ids(s.match_all().get()) == [1] and set(ids(s.match_any().get())) == {1, 2, 4, 6}
    assert ids(corpus.search("jack").using("simple").with_synonyms({"Jack": ["john doe"]}).get()) == [1]
    assert set(ids(corpus.search("bravo").using("simple").synonym_group(["bravo", "brown"]).get())) == {4, 7}
    assert ids(corpus.search("the john and doe").using("simple").ignore_stop_words().get()) == [1]
    assert corpus.search("x").ignore_stop_words("xx").stop_words == () and "der" in SEARCH_STOP_WORDS["de"]
    assert corpus.search("the and").ignore_stop_words("en").get().count() == 7
    assert ids(names(spark, "cafe", "tea").search("café").using("simple").get()) == [1]
    assert ids(names(spark, "café", "tea").search("café").using("simple").accent_insensitive(False).unicode_normalize().get()) == [1]


def test_filters_and_order(corpus):
    s = corpus.search("john").using("simple")
    assert ids(s.filter("id", ">", 1).get()) == [4, 6] and ids(s.filter("id", 4).get()) == [4] and ids(s.filter_in("id", [1, 6]).get()) == [1, 6]
    assert ids(s.filter("name", "not like", "%son").get()) == [1, 4] and s.filter("name", "=", None).get().isEmpty()
    assert ids(s.order_by("id", "desc").with_relevance(False).get()) == [6, 4, 1] and ids(s.order_by("id", "desc").get()) == [4, 1, 6]
    with pytest.raises(ValueError):
        s.filter("id", "regexp", 1)
    assert s.count() == 3 and s.first()["id"] == 1
    assert s.facet("id").get_facets() == {"id": {"1": 1, "4": 1, "6": 1}} and s.get_facets() == {}


def test_pages(corpus):
    s = corpus.search("john").using("simple")
    p = s.paginate(2, 2)
    assert ids(p.items) == [6] and p.total == 3 and p.last_page == 2
    assert ids(s.simple_paginate(2, 1).items) == [1, 4] and s.simple_paginate(2, 1).has_more and not s.simple_paginate(2, 2).has_more


def test_recency_and_custom_scores(spark):
    rows = [(1, "ring", "2024-01-01"), (2, "ring", "2024-01-31"), (3, "ring", None), (4, "ring", "no date"), (5, "ring", "2024-02-10 12:00:00")]
    s = Search(spark.createDataFrame(rows, "id long, name string, created_at string")).search("ring").search_in(["name"])
    got = {r["id"]: r["_raw_score"] for r in s.boost_recent(2.0, days=20, as_of="2024-01-31 12:00:00").get().collect()}
    assert got == {1: 100.0, 2: 200.0, 3: 100.0, 4: 100.0, 5: 150.0}
    assert ids(s.custom_score(lambda raw: raw + F.col("id")).get()) == [5, 4, 3, 2, 1]
    zero = s.custom_score(lambda raw: raw * 0).get().first()
    assert zero["_score"] == 0 and zero["_raw_score"] is None


def test_highlight_and_debug(corpus):
    r = corpus.search("john").highlight("b").debug_score().get().first()
    assert r["_highlighted"] == {"name": "<b>John</b> Doe", "email": "<b>john</b>@example.com"}
    assert [(m["column"], m["indices"]) for m in r["_matches"]] == [("name", [[0, 3]]), ("email", [[0, 3]])]
    assert render_highlighted(r, "name") == "<mark>John</mark> Doe" and render_highlighted({"x": "<a>"}, "x") == "&lt;a&gt;"
    assert r["_debug"]["column_scores"] == {"name": 800.0, "email": 400.0} and r["_debug"]["final_score"] == 1.0
    assert corpus.search("john").highlight("[", "]").get().first()["_highlighted"]["name"] == "[John] Doe"
    for bad in ("<b>", "1", ""):
        with pytest.raises(ValueError):
            corpus.search("john").highlight(bad)
        with pytest.raises(ValueError):
            render_highlighted(r, "name", bad)


def test_suggestions(corpus):
    want = ["Jon", "John", "Johnny", "John Doe", "Jon Snow"]
    s = Search(corpus.df).search("jo").search_in(["name"])
    assert s.suggest() == want and [r[0] for r in s.suggestions().collect()] == want
    assert s.search("j").suggest() == [] and Search(corpus.df).search("jo").suggest() == []


def test_spelling(spark, corpus):
    d = spark.createDataFrame([("john", 100), ("jone", 5), ("jonh", 3), ("jane", 30), ("elephant", 900)], "term string, doc_count long")
    got = [(r["term"], r["distance"], r["confidence"]) for r in corpus.search("Jonh").spellings(d).collect()]
    assert got == [("john", 2, 0.5), ("jane", 2, 0.5), ("jone", 1, 0.75)]
    assert corpus.search("jonh").did_you_mean() == []


def test_cache_events_and_accounts(corpus):
    clear_cache()
    s = corpus.search("john").cache(5)
    assert s.get() is s.get() and corpus.search("john").cache(5, "k").get() is not s.get()
    assert corpus.search("john").cache(None).cached is None and s.state_key() != s.take(3).state_key()
    assert corpus.search("john").custom_score(lambda x: x).state_key() != corpus.search("john").custom_score(lambda x: x).state_key()
    clear_cache()
    seen = []
    off = on_search(seen.append)
    corpus.search("john").take(2).collect()
    corpus.search("john | jane").extended().collect()
    off()
    corpus.search("john").collect()
    assert [(e.term, e.algorithm, e.candidates) for e in seen] == [("john", "fuzzy", 4), ("john | jane", "extended", 4)]
    s = corpus.search("john")
    assert s.analytics()["limit"] == 15 and s.debug_info()["algorithm"] == "fuzzy" and "Limit" in s.plan()
    assert s.patterns()["omissions"][0] == "%ohn%"
    assert benchmark(s.using("simple"), 1)["rating"] in ("excellent", "good", "moderate", "slow")


def test_fallback(corpus):
    s = corpus.search("johnny bravo").using("levenshtein").options(native=True, max_distance=0)._(accents=False)
    assert s.search_in({"name": 1}).search("johnny").get().isEmpty()
    assert ids(s.search("johnny").fallback("simple").get()) == [4]


def test_predicates_of_their_own(users):
    assert ids(users.transform(M.where_any("name", "jonh"))) and ids(users.where(M.or_where_fuzzy(F.col("id") == 7, "name", "jane", "simple"))) == [2, 7]
    assert ids(users.transform(M.filter_fuzzy("name", "jon snaw", 1))) == [3]
    assert ids(users.transform(M.sort_by_fuzzy("name", "jon snow")))[0] == 3
    assert ids(users.transform(M.order_by_fuzzy("name", "Doe", "desc")))[:2] == [1, 2]
    with pytest.raises(ValueError):
        users.transform(M.order_by_fuzzy("name", "Doe", "up"))
    shadow = M.add_shadow_column(users, "name")
    assert ids(shadow.transform(M.where_fuzzy("name", "Jon Sno", "metaphone"))) == [3]
    with pytest.raises(InvalidConfig, match="name_metaphone"):
        users.transform(M.where_fuzzy("name", "x", "metaphone"))
    assert 1 in ids(users.transform(M.where_levenshtein(["name"], "jhn"))) and 1 in ids(users.transform(M.where_soundex(["name"], "john"))) and ids(users.transform(M.where_similar(["name", "email"], "alice"))) == [5]
    M.register_algorithm("ends", lambda c, t, o: F.col(c).endswith(t))
    assert ids(users.transform(M.where_fuzzy("name", "Snow", "ends"))) == [3]
    del M.ALGORITHMS["ends"]


def test_likely_columns(spark):
    df = spark.createDataFrame([(1, "a", "b", 2)], "id long, title string, body string, n long")
    assert likely_columns(df) == {"title": 10, "body": 5}
    assert likely_columns(df.select("id", F.col("title").alias("x"), "n")) == {"x": 1} and likely_columns(df.select("id", "n")) == {"n": 1}


def test_catalog_and_federation(corpus, users):
    c = Catalog()
    c.register(corpus)
    assert ids(c.search("users", "alice").get())[0] == 5
    plain = Corpus("plain", users.withColumnRenamed("name", "title").drop("email"), "id", searchable=False)
    f = Federated.across(corpus, None, plain).search("john").limit(5)
    rows = f.get().collect()
    assert [(r["_model_type"], r["id"]) for r in rows] == [("users", 1), ("users", 4), ("users", 6), ("users", 3), ("plain", 1)]
    assert {r["_model_type"]: r["n"] for r in f.counts().collect()} == {"users": 4, "plain": 1} and set(f.grouped()) == {"users", "plain"}
    with pytest.raises(EmptySearchTerm):
        Federated.across(corpus).get()


def test_memory(spark):
    rows = [{"name": "John Doe"}, {"name": "Jane Smith"}, {"name": "Johnny Bravo"}, {"name": "john"}]
    s = MemorySearch.on(spark, rows).search("john").search_in(["name"])
    assert [(r["name"], r["_raw_score"], r["_score"]) for r in s.get().collect()] == [("john", 100, 1.0), ("John Doe", 60, 0.6), ("Johnny Bravo", 60, 0.6)]
    assert s.take(1).skip(1).with_relevance(False).get().collect()[0].asDict() == {"name": "John Doe"}
    assert MemorySearch.on(spark, rows).get().count() == 4 and MemorySearch.on(spark, []).get().collect() == []
    with pytest.raises(ValueError):
        MemorySearch.on(spark, [{"n": 1}] * 11, DEFAULT.with_(memory_max_items=10))
    with pytest.raises(AttributeError):
        s.paginate
