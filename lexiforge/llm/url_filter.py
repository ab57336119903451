"""Operator 10, URL filters by dated lists.

Method: temporal list join. The dated entries of each (list, pattern) become validity intervals, each from an "add" to
the next entry. A capture is looked up under every pattern that its URL can match (each suffix of its host, alone and
with the first path segment) and that the lists have. An as-of join then merges captures and intervals of a pattern in
order of time: the last interval that began before the fetch is the one that can hold it. So every capture is judged by the
entries active when it was fetched, whatever came later. A pattern with over `hot` captures is salted: its captures are
spread over so many parts, to each of which its intervals go.

Patterns: a host, which also covers its subdomains, or a host and first path segment ("example.org/en"). Hosts are
compared in lower case, without user, port and final dot. The verdict is "allow" if an allow entry is active, else
"block" if a block entry is, else "none"; the rule reported is the longest pattern of the deciding list (ties: the
alphabetically first).

Defined cases: a capture with a null or unparsable URL, or a null fetch time, has verdict "none". A null page_id is kept.
Repeated rows of one capture (page, URL, time) give one row. Entries with a null list, pattern, action or time are
ignored, as are actions other than add and remove. Of entries at one time the one with the greatest entry_id counts. An
"add" while active goes on; a "remove" while inactive does nothing. Empty captures give an empty result, empty lists the
verdict "none" throughout. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiforge.llm.base import BROADCAST_KEYS, by_keys, discard, kept, operator, saved, table, with_small

#: Captures of one pattern that one task merges with its intervals, and rows that one task takes apart, about.
HOT, ROWS = 200_000, 50_000

HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)"
SEGMENT = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+/([^/?#]+)"


def host(url) -> F.Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.$", "")


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, list, since and until of the active intervals; until is exclusive, null where it is open.

    entries: entry_id, list ("allow" or "block"), pattern, action ("add" or "remove"), at.
    """
    e = entries.select("entry_id", "list", F.lower("pattern").alias("pattern"), "action", F.col("at").cast("timestamp_ntz").alias("since"))
    e = e.where("list is not null and pattern is not null and since is not null and action in ('add', 'remove')")
    e = e.withColumn("until", F.expr("lead(since) over (partition by list, pattern order by since, entry_id)"))
    return e.where("action = 'add' and (until is null or until > since)").select("pattern", "list", "since", "until")


@operator
def judged(captures: DataFrame, entries: DataFrame, limit: int = BROADCAST_KEYS // 10, hot: int = HOT) -> DataFrame:
    """page_id, url, fetched_at, verdict, rule, since, n_block and n_allow (active matching patterns) of every capture.

    The list of patterns is broadcast where there are at most `limit`, and joined by shuffling beyond.
    """
    active = saved(intervals(entries), "intervals")
    known = saved(active.select("pattern").distinct(), "patterns")
    rows = captures.select("page_id", F.col("url").cast("string").alias("url"), F.col("fetched_at").cast("timestamp_ntz").alias("fetched_at")).distinct()
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()), "captures")
    spread = max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS))
    parts = F.split(host("url"), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    segment = F.regexp_extract("url", SEGMENT, 1)
    longer = F.when(segment != "", F.transform(suffixes, lambda s: F.concat(s, F.lit("/"), F.lower(segment)))).otherwise(F.array().cast("array<string>"))
    keys = F.concat(suffixes, longer)
    # spread by number of rows: what follows is work, not bytes
    keyed = rows.where((host("url") != "") & F.col("fetched_at").isNotNull()).repartition(spread).select("row", "fetched_at", F.explode(keys).alias("pattern"))
    hits = kept(by_keys(keyed, "pattern", known, True, limit))
    many = saved(hits.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("pattern", F.ceil(F.col("n") / F.lit(hot)).cast("int").alias("parts")), "hot")
    n = F.coalesce("parts", F.lit(1))
    no = F.lit(None)
    ask = with_small(hits, "pattern", many).select("pattern", F.pmod(F.xxhash64("row"), n).cast("int").alias("salt"), F.col("fetched_at").alias("at"), F.lit(1).alias("kind"), "row", no.cast("string").alias("list"), no.cast("timestamp_ntz").alias("until"))
    had = with_small(active, "pattern", many).select("pattern", F.explode(F.sequence(F.lit(0), n - 1)).alias("salt"), F.col("since").alias("at"), F.lit(0).alias("kind"), no.cast("long").alias("row"), "list", "until")
    w = Window.partitionBy("pattern", "salt").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda kind: F.last(F.when(F.col("list") == kind, F.struct(F.col("at").alias("since"), "until")), True).over(w)
    seen = ask.unionByName(had).select("pattern", "at", "kind", "row", last("allow").alias("allow"), last("block").alias("block")).where("kind = 1")
    holds = lambda c: F.coalesce(F.col(c).isNotNull() & (F.col(f"{c}.until").isNull() | (F.col("at") < F.col(f"{c}.until"))), F.lit(False))
    pick = lambda c: F.min(F.when(holds(c), F.struct((-F.length("pattern")).alias("n"), F.col("pattern").alias("rule"), F.col(f"{c}.since").alias("since"))))
    found = seen.groupBy("row").agg(pick("allow").alias("a"), pick("block").alias("b"), F.count_if(holds("block")).alias("n_block"), F.count_if(holds("allow")).alias("n_allow"))
    found = saved(found.where("a is not null or b is not null"), "found")
    hits.unpersist()
    discard(active, known, many)
    out = rows.join(found, "row", "left")
    by = F.coalesce("a", "b")
    verdict = F.when(F.col("a").isNotNull(), "allow").when(F.col("b").isNotNull(), "block").otherwise("none")
    zero = F.lit(0).cast("long")
    return out.select("page_id", "url", "fetched_at", verdict.alias("verdict"), by["rule"].alias("rule"), by["since"].alias("since"), F.coalesce("n_block", zero).alias("n_block"), F.coalesce("n_allow", zero).alias("n_allow"))


#: How the tables give lists and captures: an event names the page whose id is its own modulo the number of pages; its type
#: says what happens to that page's domain (or, for views, to the domain with the page's first path segment).
ACTIONS = {"error": ("block", "add"), "signup": ("block", "remove"), "purchase": ("allow", "add"), "click": ("allow", "remove"), "view": ("block", "add")}


def page_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List entries from the events and pages tables."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    n = pages.count()
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", F.expr(f"pmod(event_id, {max(1, n)})").alias("page_id"))
    named = e.join(pages, "page_id")
    domain = F.regexp_replace(host("url"), r"^(www|m|blog)\.", "")
    pattern = F.when(F.col("event_type") == "view", F.concat(domain, F.lit("/"), F.regexp_extract("url", SEGMENT, 1))).otherwise(domain)
    pick = lambda i: F.create_map(*[x for k, v in ACTIONS.items() for x in (F.lit(k), F.lit(v[i]))])[F.col("event_type")]
    return named.select(F.col("event_id").alias("entry_id"), pick(0).alias("list"), pattern.alias("pattern"), pick(1).alias("action"), F.col("ts").alias("at"))


def page_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, fetched at a time of January 2024 that its id gives."""
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(pmod(page_id * 7919, 2592000) as decimal(18, 6)))")
    return table(spark, sf_dir, "pages").select("page_id", "url", at.alias("fetched_at"))


ORACLE = r"""
with p as (select page_id, url, rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '.') host,
                  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+/([^/?#]+)', 1) seg,
                  timestamp '2024-01-01 00:00:00' + to_seconds((page_id * 7919) % 2592000) fetched_at from pages),
e as (select event_id, ts as since,
             case when event_type in ('error', 'signup', 'view') then 'block' when event_type in ('purchase', 'click') then 'allow' end list,
             case when event_type in ('error', 'purchase', 'view') then 'add' when event_type in ('signup', 'click') then 'remove' end action,
             lower(regexp_replace(host, '^(www|m|blog)\.', '') || case when event_type = 'view' then '/' || seg else '' end) pattern
      from events join p on p.page_id = event_id % (select count(*) from pages)),
i as (select *, lead(since) over (partition by list, pattern order by since, event_id) till from e where list is not null and pattern is not null),
a as (select list, pattern, since, till from i where action = 'add' and (till is null or till > since)),
c as (select distinct page_id, url, fetched_at, host, lower(seg) seg from p),
s as (select *, array_to_string(string_split(host, '.')[k:], '.') suf from c, unnest(range(1, len(string_split(host, '.')) + 1)) u(k) where host <> ''),
k as (select page_id, url, fetched_at, suf pattern from s union all select page_id, url, fetched_at, suf || '/' || seg from s where seg <> ''),
m as (select k.*, a.list, a.since from k join a on a.pattern = k.pattern and a.since <= k.fetched_at and (a.till is null or k.fetched_at < a.till)),
g as (select page_id, url, fetched_at, count(*) filter (where list = 'block') n_block, count(*) filter (where list = 'allow') n_allow,
             min({'n': -length(pattern), 'rule': pattern, 'since': since}) filter (where list = 'allow') ra,
             min({'n': -length(pattern), 'rule': pattern, 'since': since}) filter (where list = 'block') rb from m group by 1, 2, 3)
select c.page_id, c.url, c.fetched_at, case when ra is not null then 'allow' when rb is not null then 'block' else 'none' end as verdict,
       coalesce(ra, rb).rule as rule, cast(coalesce(ra, rb).since as timestamp) as since,
       coalesce(n_block, 0) as n_block, coalesce(n_allow, 0) as n_allow
from c left join g on g.page_id = c.page_id and g.url is not distinct from c.url and g.fetched_at is not distinct from c.fetched_at
"""
