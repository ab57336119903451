"""One query per operator over the driver's tables, each with its SQL counterpart where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.config import DEFAULT, INDEX_STOP_WORDS
from lexiforge.functions import expressions as X
from lexiforge.functions.phonetic import similar_text_udf
from lexiforge.operators import bm25
from lexiforge.operators import matching as M
from lexiforge.operators.federate import Corpus, Federated, IndexEngine, MemorySearch
from lexiforge.operators.search import Search, render_highlighted
from lexiforge.sources import index as I
from lexiforge.sources.shared import scratch, table
from lexiforge.streaming.index_stream import index_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
SCORE = ("_raw_score", "_score")


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def part(spark: SparkSession, d: str) -> Search:
    return Search(table(spark, d, "part"), "p_partkey")


def named(s: Search, *more: str) -> DataFrame:
    return s.get().select("p_partkey", "p_name", *more, *SCORE)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_like(column: str, patterns: list[str]) -> str:
    return "(" + " or ".join(f"{column} ilike {q(p)} escape '\\'" for p in patterns) + ")"


def has(column: str, term: str) -> str:
    return f"contains(lower({column}), {q(term.lower())})"


def ranked_sql(term: str, weights: dict[str, float], match: str, *, frm: str = "part", key: str = "p_partkey", show: str = "p_partkey, p_name", boost: float = 1.0, size: int = 15, start: int = 0, order: str = "", factor: str = "1.0", keep: str = "true") -> str:
    """A search whose candidates all contain the term in each weighted column, or score nothing there."""
    t = q(term.lower())
    recall = " + ".join(f"(case when {c} = {q(term)} then {100.0 * w} else 0 end + case when starts_with(lower({c}), {t}) then {50.0 * w * boost} else 0 end + case when contains(lower({c}), {t}) then {10.0 * w} else 0 end)" for c, w in weights.items())
    raw = " + ".join(f"(case when lower({c}) = {t} then {100.0 * w} when starts_with(lower({c}), {t}) then {80.0 * w * boost} else {60.0 * w} end)" for c, w in weights.items())
    return f"""with m as (select *, {recall} recall from {frm} where {match} and {keep}),
c as (select * from m order by {order or "recall desc"}, {key} limit {DEFAULT.max_candidates}),
s as (select *, round(cast(({raw}) * ({factor}) as double), 2) _raw_score from c),
n as (select *, round(_raw_score / max(_raw_score) over (), 6) _score from s)
select {show}, _raw_score, _score from n order by _score desc, _raw_score desc, {order or "recall desc"}, {key} limit {size} offset {start}"""


def similar_sql(pairs: str) -> str:
    """CTEs, to follow "with recursive": sim(a, b, percent) of the pairs (a, b) that a query gives.

    The longest common substring, the first in a and then in b, and again of what lies to its left and to its right.
    """
    common = "len(list_filter(range(1, least(len(x) - i, len(y) - j) + 1), lambda l: substr(x, i + 1, l) = substr(y, j + 1, l)))"
    m = f"list_max(flatten(list_transform(range(len(x)), lambda i: list_transform(range(len(y)), lambda j: {{'l': {common}, 'i': -i, 'j': -j}}))))"
    return f"""sp as (select distinct a, b from ({pairs})),
sr as (select a, b, a as x, b as y, {m} as m from sp
  union all select a, b, x, y, {m} from (select a, b, u.x, u.y from (select a, b, unnest([{{'x': left(x, -m.i), 'y': left(y, -m.j)}}, {{'x': substr(x, m.l - m.i + 1), 'y': substr(y, m.l - m.j + 1)}}]) as u from sr where m.l > 0)) where x <> '' and y <> ''),
sim as (select a, b, cast(200 as double) * coalesce(sum(m.l), 0) / (len(a) + len(b)) as percent from sr group by a, b)"""


def similar_ranked_sql(term: str, weight: float, match: str, order: str, typos: int = 2, size: int = 15) -> str:
    """A search of p_name with all tiers: equal, prefix, contained, and the better of similarity and edit distance."""
    t, v = q(term.lower()), "lower(p_name)"
    rest = f"greatest(percent / 100 * 50 * {weight}, case when levenshtein({v}, {t}) <= {typos} then greatest(0, 20 - 4 * levenshtein({v}, {t})) * {weight} else 0 end)"
    raw = f"case when {v} = {t} then {100.0 * weight} when starts_with({v}, {t}) then {80.0 * weight} when contains({v}, {t}) then {60.0 * weight} else {rest} end"
    return f"""with recursive {similar_sql(f"select {t} as a, lower(p_name) as b from part")},
c as (select *, {order} as recall from part where {match} order by recall desc, p_partkey limit {DEFAULT.max_candidates}),
s as (select *, round(cast({raw} as double), 2) as _raw_score from c join sim on b = lower(p_name)),
n as (select *, round(_raw_score / max(_raw_score) over (), 6) as _score from s)
select p_partkey, p_name, _raw_score, _score from n order by _score desc, _raw_score desc, recall desc, p_partkey limit {size}"""


# -- matching

_RING = {"p_name": 10}


@query(ranked_sql("ring", _RING, has("p_name", "ring")))
def simple_contains(spark, d):
    return named(part(spark, d).search("ring").search_in(_RING).using("simple"))


@query(ranked_sql("_1", {"n_name": 1}, has("n_name", "_1"), frm="nation", key="n_nationkey", show="n_nationkey, n_name"))
def simple_like_escape(spark, d):
    s = Search(table(spark, d, "nation"), "n_nationkey").search("_1").search_in(["n_name"]).using("like")
    return s.get().select("n_nationkey", "n_name", *SCORE)


def matches(spark: SparkSession, d: str, algorithm: str, term: str, **options) -> DataFrame:
    return table(spark, d, "part").where(M.fuzzy_match("p_name", term, algorithm, **options)).select("p_partkey", "p_name")


def _match_sql(patterns: str) -> str:
    return f"select p_partkey, p_name from part where {any_like('p_name', patterns.split())}"


#: The patterns of each algorithm, written out.
RNIG = "%rnig% rnig% %nig% %r%ig% %rn%g% %rni% %_nig% %r_ig% %rn_g% %rni_% %nrig% %ring% %rngi% r%ig rn%g"
WDGET = (
    "%wdget% %dget% %wget% %wdet% %wdgt% %wdge% %_wdget% %w_dget% %wd_get% %wdg_et% %wdge_t% %wdget_% %_dget% %w_get% %wd_et% %wdg_t% %wdge_% "
    "%get% %det% %dgt% %dge% %wet% %wgt% %wge% %wdt% %wde% %wdg% %dwget% %wgdet% %wdegt% %wdgte%"
)
PROMO = "%promo% promo% %romo% %p%omo% %pr%mo% %pro%o% %prom% %_romo% %p_omo% %pr_mo% %pro_o% %prom_% %rpomo% %pormo% %prmoo% %proom% p%mo pr%o"
RING = "%ring% ring% %ing% %r%ng% %ri%g% %rin% %_ing% %r_ng% %ri_g% %rin_% %irng% %rnig% %rign% r%ng ri%g"
SMAL = "%smal% smal% %mal% %s%al% %sm%l% %sma% %_mal% %s_al% %sm_l% %sma_% %msal% %saml% %smla% s%al sm%l"


@query(_match_sql(RNIG))
def fuzzy_patterns(spark, d):
    return matches(spark, d, "fuzzy", "rnig")


@query(_match_sql(WDGET))
def levenshtein_patterns(spark, d):
    return matches(spark, d, "levenshtein", "wdget", max_distance=2)


@query(_match_sql("%ggagadadgdgegetet% %g% %ga% %gad% %adg% %dge% %get% %et%"))
def trigram_patterns(spark, d):
    return matches(spark, d, "trigram", "gadget")


@query(_match_sql("%redd% red% %rdd%"))
def soundex_patterns(spark, d):
    return matches(spark, d, "soundex", "redd")


@query(_match_sql(" ".join(RNIG.split()[:10])))
def capped_patterns(spark, d):
    return part(spark, d).search("rnig").search_in(["p_name"]).using("fuzzy").max_patterns(10).matched().select("p_partkey", "p_name")


@query(f"select p_partkey, p_name from part where {has('p_name', 'small r')}")
def similar_text_recall(spark, d):
    return matches(spark, d, "similar_text", " Small R ")


@query("select p_partkey, p_name from part where levenshtein(p_name, 'small rng') <= 2")
def levenshtein_native(spark, d):
    return matches(spark, d, "levenshtein", "small rng", native=True, max_distance=2)


@query("select p_partkey, p_name from part where levenshtein(lower(p_name), 'red ring') <= 3")
def levenshtein_filter(spark, d):
    return table(spark, d, "part").transform(M.filter_fuzzy("p_name", "Red Ring", 3)).select("p_partkey", "p_name")


@query("select p_partkey, p_name, cast(levenshtein(lower(p_name), 'blue gear') as integer) as distance from part order by distance, p_partkey limit 25")
def levenshtein_sort_topk(spark, d):
    distance = M.levenshtein_distance(X.text("p_name"), "blue gear")
    return table(spark, d, "part").select("p_partkey", "p_name", distance.alias("distance")).orderBy("distance", "p_partkey").limit(25)


@query("select c_custkey, cast(levenshtein(lower(c_name), 'customer#00000001') as integer) as distance from customer")
def levenshtein_bytes(spark, d):
    return table(spark, d, "customer").select("c_custkey", M.levenshtein_distance(X.text("c_name"), "Customer#00000001", in_bytes=True).alias("distance"))


def _costs_sql(a: str, b: str, insert: int, replace: int, delete: int) -> str:
    """Row after row of the matrix; insertions as the least of all starts to the left."""
    step = f"list_transform(range(len({b}) + 1), lambda j: case when j = 0 then row[1] + {delete} else least(row[j] + case when substr({a}, i, 1) = substr({b}, j, 1) then 0 else {replace} end, row[j + 1] + {delete}) end)"
    least = f"list_transform(range(len({b}) + 1), lambda j: list_min(list_transform(range(j + 1), lambda k: t[k + 1] + (j - k) * {insert})))"
    return f"""with recursive n as (select distinct {a} as a, {b} as b from part),
r as (select a, b, 0 as i, list_transform(range(len(b) + 1), lambda j: j * {insert}) as row from n
  union all select a, b, i, {least.replace(b, "b")} from (select a, b, i + 1 as i, row, {step.replace(a, "a").replace(b, "b").replace("substr(a, i,", "substr(a, i + 1,")} as t from r where i < len(a)))
select a, row[len(b) + 1] as distance from r where i = len(a)"""


@query(f"select p_name, cast(distance as integer) as distance from (select distinct p_name from part) join ({_costs_sql('lower(p_name)', q('ring'), 2, 1, 2)}) on a = lower(p_name)")
def levenshtein_costs(spark, d):
    names = table(spark, d, "part").select("p_name").distinct()
    return names.select("p_name", M.levenshtein_distance(X.text("p_name"), "ring", insert=2, replace=1, delete=2).alias("distance"))


def _tri_sql(c: str) -> str:
    words = f"list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(f"""with n as (select p_partkey, p_name, {_tri_sql("p_name")} a, {_tri_sql("'ring'")} b from part)
select p_partkey, p_name, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) as similarity from n
where len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) > 0.3""")
def trigram_similarity(spark, d):
    c = F.round(X.trigram_similarity(X.text("p_name"), "ring"), 6)
    return matches(spark, d, "trigram", "ring", native=True).select("p_partkey", "p_name", c.alias("similarity"))


def _soundex_sql(w: str) -> str:
    letters, codes = "ABCDEFGIJKLMNOPQRSTUVXYZ", "012301202245501262301202"
    s = f"upper({w})"
    code = f"translate(left({s}, 1), '{letters}HW', '{codes}00') || translate(translate(substr({s}, 2), 'HW', ''), '{letters}', '{codes}')"
    for x in "123456":
        code = f"regexp_replace({code}, '{x}+', '{x}', 'g')"
    return f"left(rpad(left({s}, 1) || replace(substr({code}, 2), '0', ''), 4, '0'), 4)"


@query(f"select p_partkey, p_name from part where {_soundex_sql("split_part(p_name, ' ', 1)")} = {_soundex_sql("'smoll'")} or {_soundex_sql("split_part(p_name, ' ', -1)")} = {_soundex_sql("'smoll'")}")
def soundex_native(spark, d):
    return matches(spark, d, "soundex", "smoll", native=True)


#: The sounds of the words of part names: silent vowels; W only before a vowel; J for DG, and for G, before E and I.
_SOUNDS = """with w(word, sound) as (values ('blue', 'BL'), ('cold', 'KLT'), ('hot', 'HT'), ('large', 'LRJ'), ('new', 'N'), ('old', 'OLT'), ('red', 'RT'), ('small', 'SML'),
 ('anvil', 'NFL'), ('bolt', 'BLT'), ('gear', 'JR'), ('gizmo', 'JSM'), ('plate', 'PLT'), ('ring', 'RNK'), ('rod', 'RT'), ('widget', 'WJT')),
n as (select p_partkey, p_name, split_part(p_name, ' ', 1) as one, split_part(p_name, ' ', 2) as two from part),
s as (select p_partkey, p_name, case when ends_with(one, 'd') and starts_with(two, 'g') then left(a.sound, -1) when one = 'new' and two = 'anvil' then 'NW' else a.sound end
        || case when one = 'new' and two = 'widget' then 'JT' else b.sound end as p_name_metaphone from n join w a on a.word = one join w b on b.word = two)"""


@query(f"{_SOUNDS} select * from s where p_name_metaphone = 'SMLRNK'")
def metaphone_match(spark, d):
    parts = M.add_shadow_column(table(spark, d, "part").select("p_partkey", "p_name"), "p_name")
    return parts.where(M.fuzzy_match("p_name", "smal rink", "metaphone"))


@query(f"{_SOUNDS} select * from s")
def shadow_column(spark, d):
    return M.add_shadow_column(table(spark, d, "part").select("p_partkey", "p_name"), "p_name")


@query(f"with recursive {similar_sql(f'select {q("smal rign")} as a, lower(p_name) as b from part')} select distinct p_name, round(percent, 6) as percent from part join sim on b = lower(p_name)")
def similar_text_score(spark, d):
    names = table(spark, d, "part").select("p_name").distinct()
    return names.select("p_name", F.round(similar_text_udf(F.lit("smal rign"), F.lower("p_name")), 6).alias("percent"))


@query(similar_ranked_sql("smal rign", 10, f"({any_like('p_name', SMAL.split())} or {any_like('p_name', '%rign% rign% %ign% %r%gn% %ri%n% %rig% %_ign% %r_gn% %ri_n% %rig_% %irgn% %rgin% %ring% r%gn ri%n'.split())})", "0"))
def fuzzy_ranked(spark, d):
    return named(part(spark, d).search("smal rign").search_in(_RING).using("fuzzy").tokenize())


# -- predicates


@query(f"select p_partkey, p_name, p_type from part where {any_like('p_name', PROMO.split())} or {any_like('p_type', PROMO.split())}")
def multi_column_or(spark, d):
    return table(spark, d, "part").transform(M.where_fuzzy_multiple(["p_name", "p_type"], "promo", "fuzzy")).select("p_partkey", "p_name", "p_type")


@query(f"select p_partkey, p_name, p_size from part where p_size < 5 or {has('p_name', 'gear')}")
def or_where_fuzzy(spark, d):
    return table(spark, d, "part").where(M.or_where_fuzzy(F.col("p_size") < 5, "p_name", "gear", "simple")).select("p_partkey", "p_name", "p_size")


@query(f"select p_partkey, p_name from part where {has('p_name', 'small')} and {has('p_name', 'ring')}")
def tokens_all(spark, d):
    return part(spark, d).search("Ring  small").search_in(["p_name"]).using("simple").tokenize().match_all().matched().select("p_partkey", "p_name")


@query(f"select p_partkey, p_name from part where {has('p_name', 'small')} or {has('p_name', 'ring')}")
def tokens_any(spark, d):
    return part(spark, d).search("ring small").search_in(["p_name"]).using("simple").tokenize().match_any().matched().select("p_partkey", "p_name")


@query(f"select p_partkey, p_name from part where {has('p_name', 'tiny')} or {has('p_name', 'small')} or {has('p_name', 'ring')} or {has('p_name', 'band')}")
def synonyms(spark, d):
    s = part(spark, d).search("tiny band").search_in(["p_name"]).using("simple").tokenize()
    return s.with_synonyms({"tiny": ["small"]}).synonym_group(["band", "ring"]).matched().select("p_partkey", "p_name")


@query(f"select p_partkey, p_name from part where {has('p_name', 'red ring')}")
def stop_words(spark, d):
    return part(spark, d).search("the red ring").search_in(["p_name"]).using("simple").ignore_stop_words("en").matched().select("p_partkey", "p_name")


@query("select doc_id, lang from documents where contains(strip_accents(lower(text)), 'ete')")
def accent_fold(spark, d):
    docs = table(spark, d, "documents")
    return docs.where(M.fuzzy_match("text", "Été", "simple", native=True, accent_insensitive=True)).select("doc_id", "lang")


@query(ranked_sql("ring", {"p_name": 1}, has("p_name", "ring"), keep="p_size >= 10 and p_retailprice < 1500 and p_brand <> 'Brand#1'"))
def filter_ops(spark, d):
    s = part(spark, d).search("ring").search_in(["p_name"]).using("simple")
    return named(s.filter("p_size", ">=", 10).filter("p_retailprice", "<", 1500).filter("p_brand", "!=", "Brand#1"))


@query(ranked_sql("ring", {"p_name": 1}, has("p_name", "ring"), keep="p_size in (1, 2, 3, 5, 8, 13, 21, 34)"))
def filter_in(spark, d):
    return named(part(spark, d).search("ring").search_in(["p_name"]).using("simple").filter_in("p_size", [1, 2, 3, 5, 8, 13, 21, 34]))


# -- aggregates


@query(f"""select 'p_type' as facet, p_type as value, count(*) as n from part where {has('p_name', 'ring')} group by p_type
union all select 'p_size', cast(p_size as varchar), count(*) from part where {has('p_name', 'ring')} group by p_size""")
def facets(spark, d):
    return part(spark, d).search("ring").search_in(["p_name"]).using("simple").facet("p_type").facet("p_size").facet_counts()


@query(f"select count(*) as n from part where {any_like('p_name', RING.split())}")
def match_count(spark, d):
    return part(spark, d).search("ring").search_in(["p_name"]).using("fuzzy").matched().agg(F.count("*").alias("n"))


# -- order and scores


@query(f"select p_partkey, p_name from part where {has('p_name', 'red')} order by (case when p_name = 'red' then 100 else 0 end + case when starts_with(lower(p_name), 'red') then 50 else 0 end + 10) desc, p_partkey limit 50")
def recall_order_topk(spark, d):
    s = part(spark, d).search("red").search_in(["p_name"]).using("simple")
    return s._(settings=s.settings.with_(max_candidates=50)).candidates().select("p_partkey", "p_name")


@query(ranked_sql("red", {"p_name": 10}, has("p_name", "red"), size=3, start=2))
def rank_then_limit(spark, d):
    return named(part(spark, d).search("red").search_in({"p_name": 10}).using("simple").skip(2).take(3))


@query(ranked_sql("small", {"p_name": 7}, has("p_name", "small"), boost=2.5))
def weighted_prefix_boost(spark, d):
    return named(part(spark, d).search("small").search_in({"p_name": 7}).using("simple").prefix_boost(2.5))


_AS_OF = "1997-01-15 12:00:00"


@query(ranked_sql("urgent", {"o_orderpriority": 2}, has("o_orderpriority", "urgent"), frm="orders", key="o_orderkey", show="o_orderkey, o_orderpriority", size=40, factor=f"case when floor(abs(epoch(timestamp '{_AS_OF}') - floor(epoch(o_orderdate))) / 86400) <= 60 then 1 + 0.8 * (1 - floor(abs(epoch(timestamp '{_AS_OF}') - floor(epoch(o_orderdate))) / 86400) / 60) else 1.0 end"))
def recency_boost(spark, d):
    s = Search(table(spark, d, "orders"), "o_orderkey").search("urgent").search_in({"o_orderpriority": 2}).using("simple")
    return s.boost_recent(1.8, "o_orderdate", 60, as_of=_AS_OF).take(40).get().select("o_orderkey", "o_orderpriority", *SCORE)


@query(ranked_sql("ring", {"p_name": 1}, has("p_name", "ring"), factor="p_size"))
def custom_score(spark, d):
    return named(part(spark, d).search("ring").search_in(["p_name"]).using("simple").custom_score(lambda raw: raw * F.col("p_size")))


@query("select p_partkey, p_name, cast(instr(p_name, 'ring') as integer) as place from part order by place desc, p_partkey limit 20")
def order_by_position(spark, d):
    place = X.position(X.text("p_name"), "ring")
    return table(spark, d, "part").select("p_partkey", "p_name", place.alias("place")).orderBy(F.desc("place"), "p_partkey").limit(20)


@query("select instr(p_name, 'ring') as place from part order by place desc limit 50")
def order_by_fuzzy(spark, d):
    """The places of the first rows; which of equal ones come first is not determined."""
    return table(spark, d, "part").transform(M.order_by_fuzzy("p_name", "ring", "desc")).limit(50).select(F.instr("p_name", "ring").cast("long").alias("place"))


@query("select levenshtein(lower(p_name), 'blue gear') as distance from part order by distance limit 50")
def sort_by_fuzzy(spark, d):
    return table(spark, d, "part").transform(M.sort_by_fuzzy("p_name", "Blue Gear")).limit(50).select(F.levenshtein(F.lower("p_name"), F.lit("blue gear")).cast("long").alias("distance"))


@query(ranked_sql("ring", {"p_name": 1}, has("p_name", "ring"), order="p_retailprice desc", size=10))
def order_by_column(spark, d):
    return named(part(spark, d).search("ring").search_in(["p_name"]).using("simple").order_by("p_retailprice", "desc").take(10))


@query(ranked_sql("ring", {"p_name": 1}, has("p_name", "ring"), size=20, start=40))
def page_n(spark, d):
    return named(part(spark, d).search("ring").search_in(["p_name"]).using("simple").page(3, 20))


@query(f"with p as (select p_partkey, p_name from part where {has('p_name', 'ring')} order by case when starts_with(lower(p_name), 'ring') then 60 else 10 end desc, p_partkey limit 12 offset 12) select *, (select count(*) from part where {has('p_name', 'ring')}) as total from p")
def paginate(spark, d):
    page = part(spark, d).search("ring").search_in(["p_name"]).using("simple").paginate(12, 2)
    return page.items.select("p_partkey", "p_name").withColumn("total", F.lit(page.total).cast("long"))


@query(f"select p_partkey, p_name from part where {has('p_name', 'ring')} order by p_partkey limit 15")
def without_relevance(spark, d):
    return part(spark, d).search("ring").search_in(["p_name"]).using("simple").with_relevance(False).get().select("p_partkey", "p_name")


# -- boolean queries


@query(f"select p_partkey, p_name, p_type from part where ({has('p_name', 'ring')} or {has('p_type', 'ring')}) and (({has('p_name', 'red')} or {has('p_type', 'red')}) or ({has('p_name', 'small')} or {has('p_type', 'small')})) and not ({has('p_name', 'promo')} or {has('p_type', 'promo')})")
def ext_and_or_not(spark, d):
    return part(spark, d).search_in(["p_name", "p_type"]).extended("ring (red | small) !promo").matched().select("p_partkey", "p_name", "p_type")


@query("select p_partkey, p_name from part where lower(p_name) in ('redring', '''small''') or (starts_with(lower(p_name), 'red') and not ends_with(lower(p_name), 'ring')) or contains(lower(p_name), 'e g')")
def ext_exact_prefix_suffix(spark, d):
    return part(spark, d).search_in(["p_name"]).extended("=redring | ^red !ring$ | \"e g\" | ='small'").matched().select("p_partkey", "p_name")


@query(f"select p_partkey, p_name, p_size from part where {has('p_name', 'ring')} and p_size > 25")
def ext_filtered(spark, d):
    return part(spark, d).search_in(["p_name"]).extended("'ring").filter("p_size", ">", 25).matched().select("p_partkey", "p_name", "p_size")


@query(similar_ranked_sql("ring | ^red", 10, f"({has('p_name', 'ring')} or starts_with(lower(p_name), 'red'))", "0"))
def ext_ranked(spark, d):
    return named(part(spark, d).search_in(_RING).extended("ring | ^red"))


# -- the inverted index

_STOP = ", ".join(map(q, INDEX_STOP_WORDS["en"]))
_WORDS = f"""w as (select cast(doc_id as varchar) as model_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) as term from documents),
k as (select model_id, term from w where length(term) >= 2 and term not in ({_STOP}) and strlen(term) <= 255),
p as (select model_id, term, cast(count(*) as integer) as frequency from k group by 1, 2),
dl as (select model_id, sum(frequency) as doc_length from p group by 1), t as (select term, count(*) as doc_count from p group by 1),
me as (select count(*) as total_docs, sum(doc_length) as total_tokens, cast(sum(doc_length) as double) / count(*) as avg_doc_length from dl)"""
#: Whole documents; index_token_cap has the cap.
_ANALYZER = I.Analyzer(max_tokens=None)


def _index(spark: SparkSession, d: str) -> I.Index:
    return I.build(table(spark, d, "documents"), "doc_id", ["text"], _ANALYZER)


@query("select cast(doc_id as varchar) as model_id, len(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda t: length(t) >= 2)) as n_tokens from documents")
def tokenize(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("model_id"), F.size(I.tokenize(F.col("text"))).cast("long").alias("n_tokens"))


@query(f"with {_WORDS} select term, doc_count from t")
def index_terms(spark, d):
    return _index(spark, d).terms


@query(f"with {_WORDS} select model_id, term, frequency from p")
def index_postings(spark, d):
    return _index(spark, d).postings.drop("doc_length")


@query(f"with {_WORDS} select model_id, cast(doc_length as bigint) as doc_length from dl")
def index_documents(spark, d):
    return _index(spark, d).documents


@query(f"with {_WORDS} select total_docs, cast(total_tokens as bigint) as total_tokens, round(avg_doc_length, 6) as avg_doc_length from me")
def index_meta(spark, d):
    return _index(spark, d).meta.withColumn("avg_doc_length", F.round("avg_doc_length", 6))


def _bm25_sql(terms: list[str], frm: str = _WORDS) -> str:
    d = "cast({} as double)".format
    idf = f"ln(({d('total_docs')} - {d('doc_count')} + cast(0.5 as double)) / ({d('doc_count')} + cast(0.5 as double)) + cast(1 as double))"
    tf = f"({d('frequency')} * cast(2.5 as double)) / ({d('frequency')} + cast(1.5 as double) * (cast(0.25 as double) + cast(0.75 as double) * {d('doc_length')} / avg_doc_length))"
    return f"{frm}, s as (select model_id, round(sum({idf} * ({tf})), 6) as score from p join dl using (model_id) join t using (term), me where term in ({', '.join(map(q, terms))}) group by model_id)"


@query(f"with {_bm25_sql(['thing'])} select model_id, score from s order by score desc, model_id limit 20")
def bm25_search(spark, d):
    return bm25.search(_index(spark, d), ["thing"], 20)


_TERMS = ["tion", "thing", "les", "nicht", "erst"]


@query(f"with {_bm25_sql(_TERMS)} select model_id, score from s")
def bm25_multi_term(spark, d):
    return bm25.scores(_index(spark, d), _TERMS)


@query(f"with {_WORDS} select count(distinct model_id) as n from p where term in ({', '.join(map(q, _TERMS))})")
def bm25_count(spark, d):
    return spark.range(1).select(F.lit(bm25.count(_index(spark, d), _TERMS)).cast("long").alias("n"))


def _store(spark: SparkSession, d: str) -> I.IndexStore:
    store = I.IndexStore(spark, scratch(spark, "index"))
    store.rebuild("documents", table(spark, d, "documents"), "doc_id", ["text"], _ANALYZER)
    return store


@query(f"with {_bm25_sql(['les', 'nicht', 'erst'])} select model_id, score from s order by score desc, model_id limit 10 offset 10")
def bm25_paginate(spark, d):
    s = bm25.scores(_store(spark, d).read("documents"), ["les", "nicht", "erst"])
    return s.orderBy(F.desc("score"), "model_id").offset(10).limit(10)


@query(f"""with {_bm25_sql(['les', 'nicht', 'erst'])}, b as (select * from s order by score desc, model_id limit 20), z as (select * from b order by score desc, model_id limit 10 offset 10)
select doc_id, score as _raw_score, round(score / (select max(score) from b), 6) as _score, (select count(*) from s) as total from z join documents on cast(doc_id as varchar) = model_id""")
def indexed_page(spark, d):
    s = Search(table(spark, d, "documents"), "doc_id").search("les nicht, erst!").search_in(["text"]).use_inverted_index("documents", _store(spark, d), _ANALYZER)
    page = s.paginate(10, 2)
    return page.items.select("doc_id", *SCORE, F.lit(page.total).cast("long").alias("total"))


@query(f"""with {_bm25_sql(['les', 'nicht'])}, z as (select * from s order by score desc, model_id limit 8)
select model_id, score, (select count(*) from s) as total from z""")
def index_engine(spark, d):
    docs = Corpus("documents", table(spark, d, "documents"), "doc_id", ["text"])
    engine = IndexEngine(I.IndexStore(spark, scratch(spark, "engine")), _ANALYZER)
    engine.update(docs)
    page, total = engine.paginate("documents", "les nicht", 8, 1)
    ids = engine.map_ids(engine.search("documents", "les nicht", 8))
    return page.join(ids, "model_id").select("model_id", "score", F.lit(total).cast("long").alias("total"))


@query(f"""with {_bm25_sql(['les', 'nicht', 'erst'])}, b as (select * from s order by score desc, model_id limit 30)
select doc_id, lang, score as _raw_score, round(score / (select max(score) from b), 6) as _score from b join documents on cast(doc_id as varchar) = model_id order by score desc, model_id limit 15""")
def bm25_hydrate(spark, d):
    s = Search(table(spark, d, "documents"), "doc_id").search("les nicht, erst!").search_in(["text"])
    return s.use_inverted_index("documents", _store(spark, d), _ANALYZER).get().select("doc_id", "lang", *SCORE)


@query(f"""with {_WORDS}, qs as (select item_id as query_id, term from (select item_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) as term from benchmark) where length(term) >= 2 group by 1, 2),
x as (select query_id, model_id, round(sum(ln((cast(total_docs as double) - cast(doc_count as double) + cast(0.5 as double)) / (cast(doc_count as double) + cast(0.5 as double)) + cast(1 as double)) * ((cast(frequency as double) * cast(2.5 as double)) / (cast(frequency as double) + cast(1.5 as double) * (cast(0.25 as double) + cast(0.75 as double) * cast(doc_length as double) / avg_doc_length)))), 6) as score
      from qs join t using (term) join p using (term) join dl using (model_id), me group by 1, 2),
r as (select *, row_number() over (partition by query_id order by score desc, model_id) as n from x)
select query_id, cast(n as integer) as rank, model_id, score from r where n <= 3""")
def bm25_many(spark, d):
    words = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(I.tokenize(F.col("text"))).alias("term"))
    return bm25.search_many(_index(spark, d), words, 3)


@query()
def stemmed_bm25(spark, d):
    a = I.Analyzer(stemmer="english", max_tokens=None)
    return bm25.search(I.build(table(spark, d, "documents"), "doc_id", ["text"], a), a.terms("things running onions"), 20)


@query("""with x as (select cast(doc_id as varchar) as model_id, row_number() over (partition by 1) as z, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as words from documents),
k as (select model_id, list_filter(words, lambda t: length(t) >= 2 and not list_contains([""" + _STOP + """], t)) as words from x),
e as (select model_id, unnest(words) as term, unnest(range(1, len(words) + 1)) as pos from k),
f as (select model_id, term, min(pos) as fst from e group by 1, 2),
n as (select *, row_number() over (partition by model_id order by fst) as i from f),
l as (select model_id, fst as last from n where i = 40)
select e.model_id, term, cast(count(*) as integer) as frequency from e left join l using (model_id) where last is null or pos <= last group by 1, 2""")
def index_token_cap(spark, d):
    return I.build(table(spark, d, "documents"), "doc_id", ["text"], I.Analyzer(max_tokens=40)).postings.drop("doc_length")


@query(f"with {_WORDS} select term, count(*) as doc_count from p where model_id not in (select cast(doc_id as varchar) from labels where toxic = 1) group by term")
def index_remove(spark, d):
    return I.without(_index(spark, d), table(spark, d, "labels").where("toxic = 1").select("doc_id")).terms


@query(f"with {_WORDS} select term, doc_count from t")
def index_flush_orphans(spark, d):
    store = _store(spark, d)
    store.rebuild("conversations", table(spark, d, "conversations").withColumn("k", F.concat_ws("-", "conv_id", "turn")), "k", ["text"], _ANALYZER)
    store.flush("conversations")
    return store.dictionary()


@query(f"with {_WORDS} select total_docs, cast(total_tokens as bigint) as total_tokens, round(avg_doc_length, 6) as avg_doc_length from me")
def index_reindex_idempotent(spark, d):
    store = _store(spark, d)
    store.upsert("documents", table(spark, d, "documents"), "doc_id", ["text"], _ANALYZER)
    return store.read("documents").meta.withColumn("avg_doc_length", F.round("avg_doc_length", 6))


@query(f"with {_WORDS} select 'documents' as model_type, total_docs, cast(total_tokens as bigint) as total_tokens, round(avg_doc_length, 6) as avg_doc_length, (select count(*) from t) as n_terms from me")
def index_status(spark, d):
    return _store(spark, d).status().withColumn("avg_doc_length", F.round("avg_doc_length", 6))


_CONV = _WORDS.replace("cast(doc_id as varchar)", "conv_id || '-' || turn").replace("from documents", "from conversations")


@query(f"with {_CONV} select model_id, cast(doc_length as bigint) as doc_length from dl")
def stream_index_upsert(spark, d):
    path = f"{d}/conversations.parquet"
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = fs.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(fs).isDirectory()
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 4).parquet(f"{path}/*.parquet" if folder else path.replace(".parquet", ".parque[t]"))
    changes = stream.select(F.concat_ws("-", "conv_id", "turn").alias("k"), "text", F.lit("upsert").alias("op"), F.lit(0).alias("seq"))
    store = I.IndexStore(spark, scratch(spark, "stream"))
    index_stream(changes, store, "conversations", "k", ["text"], scratch(spark, "stream-state"), _ANALYZER).awaitTermination()
    return store.read("conversations").documents


@query(f"with {_CONV.replace('from conversations', "from conversations where turn % 3 <> 1")} select term, doc_count from t")
def stream_index_delete(spark, d):
    """Every row is indexed, then all of them come again, every third as a deletion; the others are as they were."""
    rows = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("k"), "text", "turn")
    path = scratch(spark, "changes")
    rows.select("k", "text", F.lit("upsert").alias("op"), F.lit(1).alias("seq")).coalesce(1).write.parquet(path)
    store, state = I.IndexStore(spark, scratch(spark, "stream")), scratch(spark, "stream-state")
    run = lambda: index_stream(spark.readStream.schema("k string, text string, op string, seq int").parquet(path), store, "conversations", "k", ["text"], state, _ANALYZER).awaitTermination()
    run()
    rows.select("k", "text", F.when(F.expr("turn % 3 = 1"), "delete").otherwise("upsert").alias("op"), F.lit(2).alias("seq")).coalesce(1).write.mode("append").parquet(path)
    run()
    return store.read("conversations").terms


@query(f"with {_WORDS.replace('from documents', "from (select doc_id, case when doc_id % 10 = 0 then 'new words now' else text end as text from documents where doc_id % 7 <> 0)")} select total_docs, cast(total_tokens as bigint) as total_tokens, round(avg_doc_length, 6) as avg_doc_length, (select count(*) from t) as n_terms from me")
def index_segments(spark, d):
    """A base, and segments of changes and removals that aren't merged."""
    store, docs = _store(spark, d), table(spark, d, "documents")
    store.upsert("documents", docs.where("doc_id % 10 = 0").withColumn("text", F.lit("new words now")), "doc_id", ["text"], _ANALYZER)
    store.remove("documents", docs.where("doc_id % 7 = 0").select("doc_id"))
    return store.status().select("total_docs", "total_tokens", F.round("avg_doc_length", 6).alias("avg_doc_length"), "n_terms")


@query("select cast(0 as bigint) as n")
def index_clear(spark, d):
    store = _store(spark, d)
    store.clear()
    return store.status().agg(F.count("*").alias("n"))


# -- suggestions, highlighting, several tables, memory


@query(f"""with {_WORDS}, c as (select * from t where term <> 'thta' and length(term) between 1 and 7 order by doc_count desc, term limit 300),
x as (select *, levenshtein(term, 'thta') as dist from c where length(term) = strlen(term)),
y as (select *, (select count(*) from c) as z from x where dist between 1 and 3)
select term, cast(dist as integer) as distance, round(1 - dist / greatest(length(term), 4), 2) as confidence from y order by doc_count desc, dist, confidence desc, term limit 3""")
def did_you_mean(spark, d):
    return Search(table(spark, d, "documents"), "doc_id").search("Thta").spellings(_index(spark, d).terms)


@query("""with r as (select p_partkey, p_name from part where starts_with(lower(p_name), 'sm') order by p_partkey limit 15),
e as (select p_partkey, i, s from (select p_partkey, unnest(string_split(p_name, ' ') || [p_name]) as s, unnest(range(1, len(string_split(p_name, ' ')) + 2)) as i from r)
      where starts_with(lower(s), 'sm') and length(s) > 2),
k as (select lower(s) as low, max({'k': p_partkey, 'i': i, 's': s}) as m from e group by 1)
select m.s as suggestion from k order by length(m.s), low limit 5""")
def suggest(spark, d):
    return part(spark, d).search("sm").search_in(["p_name"]).suggestions(5)


@query(ranked_sql("ring", {"p_name": 1}, has("p_name", "ring"), show="p_partkey, replace(p_name, 'ring', '<em>ring</em>') as shown, 1 as n_matches, instr(p_name, 'ring') - 1 as first_at").replace("1 as n_matches", "cast(1 as integer) as n_matches").replace("instr(p_name, 'ring') - 1", "cast(instr(p_name, 'ring') - 1 as integer)"))
def highlight_offsets(spark, d):
    out = part(spark, d).search("ring").search_in(["p_name"]).using("simple").highlight().get()
    return out.select("p_partkey", F.col("_highlighted")["p_name"].alias("shown"), F.size("_matches").alias("n_matches"), F.col("_matches")[0]["indices"][0][0].alias("first_at"), *SCORE)


def _federated(spark: SparkSession, d: str) -> Federated:
    c = Corpus("customer", table(spark, d, "customer"), "c_custkey", {"c_name": 10})
    s = Corpus("supplier", table(spark, d, "supplier"), "s_suppkey", {"s_name": 5})
    p = Corpus("part", table(spark, d, "part"), "p_partkey", ["p_name"], searchable=False)
    return Federated.across(c, None, s, p).search("00001").using("simple").limit(12)


def _source_sql(i: int, name: str, key: str, column: str, w: int) -> str:
    inner = ranked_sql("00001", {column: w}, has(column, "00001"), frm=name, key=key, show=f"'{name}' as _model_type, {key} as k", size=12)
    return f"(select _model_type, k, _score, {i} as i from ({inner}))"


_FEDERATED_SQL = f"""(select _model_type, cast(k as bigint) as k, _score, i from ({_source_sql(0, 'customer', 'c_custkey', 'c_name', 10)} union all {_source_sql(1, 'supplier', 's_suppkey', 's_name', 5)}
union all (select 'part', p_partkey, 0.0, 2 from part where {has('p_name', '00001')} order by p_partkey limit 12)) order by _score desc, i, k limit 12)"""


@query(f"select _model_type, k, _score from {_FEDERATED_SQL}")
def federated(spark, d):
    return _federated(spark, d).get().select("_model_type", F.coalesce("c_custkey", "s_suppkey", "p_partkey").cast("long").alias("k"), "_score")


@query(f"select _model_type, count(*) as n from {_FEDERATED_SQL} group by 1")
def federated_counts(spark, d):
    return _federated(spark, d).counts()


@query(f"""with recursive {similar_sql("select 'natoin_1' as a, lower(n_name) as b from nation")},
s as (select n_nationkey, n_name, case when b = 'natoin_1' then 100 when starts_with(b, 'natoin_1') then 60 when contains(b, 'natoin_1') then 30 when percent >= 60 then floor(percent) else 0 end as r from nation join sim on b = lower(n_name))
select n_nationkey, n_name, cast(r as integer) as _raw_score, round(r / (select max(r) from s), 6) as _score from s where r > 0 order by r desc, n_nationkey limit 20""")
def in_memory(spark, d):
    rows = [r.asDict() for r in table(spark, d, "nation").orderBy("n_nationkey").collect()]
    return MemorySearch.on(spark, rows).search("NATOIN_1").search_in(["n_name"]).take(20).get().select("n_nationkey", "n_name", *SCORE)


@query("select 'part' as model, cast(p_partkey as varchar) as model_id, trim(p_name || ' ' || p_brand) as content from part")
def content_table(spark, d):
    return I.content_table(table(spark, d, "part"), "part", "p_partkey", ["p_name", "p_brand"])


@query(ranked_sql("ring", {"p_name": 1}, has("p_name", "ring"), keep="p_size > 40"))
def fallback_algorithm(spark, d):
    s = part(spark, d).search("ring").search_in(["p_name"]).using("levenshtein").options(native=True, max_distance=0)
    return named(s.filter("p_size", ">", 40).fallback("simple"))


# -- what the builder adds


@query(f"select p_partkey, p_name, p_type from part where {any_like('p_name', PROMO.split())} or {any_like('p_type', PROMO.split())}")
def any_column(spark, d):
    return table(spark, d, "part").transform(M.where_any(["p_name", "p_type"], "promo")).select("p_partkey", "p_name", "p_type")


@query(f"select 'levenshtein' as f, p_partkey from part where {any_like('p_name', WDGET.split())} union all select 'soundex', p_partkey from part where {any_like('p_name', ['%redd%', 'red%', '%rdd%'])} union all select 'similar', p_partkey from part where {has('p_name', 'small r')}")
def scopes(spark, d):
    p = table(spark, d, "part")
    found = {"levenshtein": M.where_levenshtein(["p_name"], "wdget", 2), "soundex": M.where_soundex(["p_name"], "redd"), "similar": M.where_similar(["p_name"], "small r")}
    parts = [p.transform(f).select(F.lit(n).alias("f"), "p_partkey") for n, f in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("select count(*) as n from part")
def only_stop_words(spark, d):
    return part(spark, d).search("the of and").search_in(["p_name"]).using("simple").ignore_stop_words(["the", "of", "and"]).matched().agg(F.count("*").alias("n"))


@query("select p_partkey, p_name from part where levenshtein(p_name, 'small rng') <= 1")
def typo_tolerance(spark, d):
    return part(spark, d).search("small rng").search_in(["p_name"]).using("levenshtein").options(native=True).typo_tolerance(1).accent_insensitive(False).matched().select("p_partkey", "p_name")


@query(f"""with n as (select p_partkey, p_name, {_tri_sql("p_name")} a, {_tri_sql("'small rng'")} b from part)
select p_partkey, p_name from n where len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) > greatest(0.3, 1 - 5 / 9)""")
def levenshtein_similar(spark, d):
    return matches(spark, d, "levenshtein", "small rng", native="similar", max_distance=5)


@query("select doc_id from documents where contains(lower(text), nfc_normalize('e' || chr(769) || 't'))")
def unicode_normalize(spark, d):
    s = Search(table(spark, d, "documents"), "doc_id").search("e\u0301t").search_in(["text"]).using("simple").accent_insensitive(False)
    return s.unicode_normalize().matched().select("doc_id")


@query("select doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#039;') as html from documents")
def html_escape(spark, d):
    return table(spark, d, "documents").select("doc_id", X.html(F.col("text")).alias("html"))


@query(ranked_sql("ring", {"p_name": 1}, has("p_name", "ring"), size=1))
def first_row(spark, d):
    row = part(spark, d).search("ring").search_in(["p_name"]).using("simple").first()
    return spark.createDataFrame([tuple(row[c] for c in ("p_partkey", "p_name", *SCORE))], "p_partkey long, p_name string, _raw_score double, _score double")


@query(f"with p as ({ranked_sql('ring', {'p_name': 1}, has('p_name', 'ring'), size=5, start=5)}) select *, (select count(*) > 10 from part where {has('p_name', 'ring')}) as more from p")
def simple_page(spark, d):
    page = part(spark, d).search("ring").search_in(["p_name"]).using("simple").simple_paginate(5, 2)
    return page.items.select("p_partkey", "p_name", *SCORE).withColumn("more", F.lit(page.has_more))


@query(ranked_sql("ring", {"p_name": 1}, has("p_name", "ring"), size=3, show="p_partkey, replace(p_name, 'ring', '<b>ring</b>') as shown").replace(", _raw_score, _score from n order", " from n order"))
def rendered(spark, d):
    rows = part(spark, d).search("ring").search_in(["p_name"]).using("simple").highlight().take(3).get().collect()
    return spark.createDataFrame([(r["p_partkey"], render_highlighted(r, "p_name", "b")) for r in rows], "p_partkey long, shown string")


@query(ranked_sql("ring", {"p_name": 4}, has("p_name", "ring"), show="p_partkey, _raw_score as column_score, _score as final_score, 'ring' as term, 'simple' as algorithm"))
def debug_score(spark, d):
    rows = part(spark, d).search("ring").search_in({"p_name": 4}).using("simple").debug_score().get()
    g = F.col("_debug")
    return rows.select("p_partkey", g["column_scores"]["p_name"].alias("column_score"), g["final_score"].alias("final_score"), g["term"].alias("term"), g["algorithm"].alias("algorithm"), *SCORE)


@query(ranked_sql("ring", {"p_name": 10, "p_type": 2}, f"({has('p_name', 'ring')} and {has('p_type', 'ring')} or {has('p_name', 'ring')})", keep="false"))
def preset_without_hits(spark, d):
    s = part(spark, d)
    s = s._(settings=s.settings.with_(presets={"parts": {"columns": {"p_name": 10, "p_type": 2}, "algorithm": "simple", "typo_tolerance": 0}}))
    return named(s.preset("parts").search("ring").filter("p_size", "<", 0))


@query(ranked_sql("ring", {"p_name": 10}, has("p_name", "ring")))
def preset(spark, d):
    s = part(spark, d)
    s = s._(settings=s.settings.with_(presets={"parts": {"columns": {"p_name": 10}, "algorithm": "simple", "typo_tolerance": 0}}))
    return named(s.preset("parts").search("ring"))


@query(ranked_sql("ring", {"p_name": 3}, has("p_name", "ring")))
def cached_result(spark, d):
    s = part(spark, d).search("ring").search_in({"p_name": 3}).using("simple").cache(5)
    s.get().count()
    return named(s)


@query("select p_partkey, soundex_code as code from (select p_partkey, case when starts_with(p_name, 'red ') then 'R300' else '' end as soundex_code from part) where soundex_code <> ''")
def own_algorithm(spark, d):
    M.register_algorithm("sounds_like_red", lambda c, t, o: F.soundex(X.first_word(X.text(c))) == F.soundex(F.lit(t)))
    return part(spark, d).search("reed").search_in(["p_name"]).using("sounds_like_red").matched().select("p_partkey", F.soundex(X.first_word(F.col("p_name"))).alias("code"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return simple_contains(spark, d)

