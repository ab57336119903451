"""Each operator against brute force, an exact round trip, held-out data or SQL."""

import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex
import tiktoken
from fixtures import prose
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import assert_same
from pyspark.sql import functions as F

from lexiforge.llm import bpe, fingerprints, language_id, near_dedup, packing, pii, queries, suffix_dedup, textops, token_rollup, topk, url_filter
from lexiforge.llm import pairs as pairs_of
from lexiforge.llm.base import by_keys, saved
from lexiforge.llm.textops import flat, mix, shingle_sets


@pytest.fixture(scope="module")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, data, name):
    assert len(assert_same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], data))


def test_all_ten_are_registered():
    assert sorted(int(m[1]) for n in queries.QUERIES if (m := re.match(r"op(\d+)_", n))) == list(range(1, 11))


# -- 1


def test_language_on_held_out_documents(documents):
    rows = sorted(documents.collect(), key=lambda r: r["doc_id"])
    a, b = rows[::2], rows[1::2]
    m = language_id.train([r["text"] for r in a], [r["lang"] for r in a])
    best, _, _ = language_id.score(m, *flat(pa.array([r["text"] for r in b])))
    assert np.mean([m.languages[i] == r["lang"] for i, r in zip(best, b)]) > 0.97


def brute_bayes(labelled, texts):
    """Naive Bayes written out: n-grams of strings, counts in dictionaries; the best language and its margin of each text."""

    def grams(t):
        import unicodedata

        t = re.sub(r"\0+", " ", "".join(c.lower() if len(c.lower()) == 1 else c for c in ("".join(c if unicodedata.category(c)[0] in "LM" else "\0" for c in t)).lstrip("\0")))
        for n in (1, 2, 3):
            for i in range(len(t) - n + 1):
                code = 0
                for c in t[i : i + n]:
                    code = code << 21 | (0 if c == " " else ord(c))
                yield n, code * 0x9E3779B97F4A7C15 % 2**64 >> 64 - language_id.BITS

    languages = sorted({l for _, l in labelled})
    counts = {l: defaultdict(int) for l in languages}
    for t, l in labelled:
        for g in grams(t):
            counts[l][g] += 1
    sums = {(l, n): sum(v for (m, _), v in counts[l].items() if m == n) for l in languages for n in (1, 2, 3)}
    prior = {l: sum(x == l for _, x in labelled) + 1 for l in languages}
    out = []
    for t in texts:
        found = list(grams(t))
        if not found:
            out.append(("und", None))
            continue
        s = {l: np.log(prior[l] / sum(prior.values())) + sum(np.log((counts[l][n, h] + 0.5) / (sums[l, n] + 0.5 * 2**language_id.BITS)) for n, h in found) for l in languages}
        rank = sorted(languages, key=lambda l: (-s[l], l))
        out.append((rank[0], s[rank[0]] - s[rank[1]]))
    return out


def test_language_report_is_naive_bayes(spark, documents):
    """All rows of a table that is its own sample, odd texts among them."""
    rows = [(r["doc_id"], r["text"][:300], r["lang"]) for r in documents.orderBy("doc_id").limit(60).collect()]
    rows += [(1000, "ÀÉÎ ÇA là ÉTÉ", "fr"), (1001, "ДОБРЫЙ день, дом", "ru"), (1002, "добрый ДЕНЬ", None), (1003, "12 34", "fr"), (1004, "", None), (1005, "été", "xx"), (1006, "İ ſ ß ẞ", None)]
    # one row per share, so that the sample takes all
    got = {r["doc_id"]: r for r in language_id.language_report(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 10**6).collect()}
    want = brute_bayes([(t, l) for _, t, l in rows if l], [t for _, t, _ in rows])
    for (i, _, _), (lang, margin) in zip(rows, want):
        assert got[i]["predicted"] == lang and (got[i]["margin"] is None if margin is None else got[i]["margin"] == pytest.approx(margin, abs=0.05, rel=1e-4)), i


def test_rare_languages_are_sampled(spark):
    rows = [(i, prose(i, 20), "en") for i in range(3000)] + [(10_000 + i, "der die und ist nicht ein zu", "de") for i in range(5)]
    m = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 100)
    assert m.languages == ("de", "en")


def test_refuted_labels_are_rejected(spark):
    rows = [(i, prose(i, 200), "en") for i in range(30)] + [(100 + i, "zu der die und ist nicht ein " * 30, "de") for i in range(30)] + [(999, prose(5, 100), "de")]
    kept = {r["doc_id"] for r in language_id.keep_identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert kept == {r[0] for r in rows} - {999}


# -- 2 and 3


def brute_sets(texts, k=3):
    """The word shingles of each text, as tuples of words."""
    out = {}
    for i, t in texts.items():
        w = [x.lower() for x in re.findall(rb"[A-Za-z0-9\x80-\xff]+", (t or "").encode())]
        out[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    return out


def brute_pairs(texts, least, k=3):
    sets = brute_sets(texts, k)
    users = defaultdict(list)
    for i in sorted(texts):
        for x in sets[i]:
            users[x].append(i)
    both = defaultdict(int)
    for us in users.values():
        for p in itertools.combinations(us, 2):
            both[p] += 1
    return {(a, b): j for (a, b), n in both.items() if (j := n / (len(sets[a]) + len(sets[b]) - n)) >= least}


def brute_groups(texts, least, linked=lambda a, b: True):
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in brute_pairs(texts, least):
        if linked(a, b):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


def test_shingles_are_those_of_the_words():
    t = ["One two, THREE four", "three FOUR one two three", "zwei", "", None, "é-x é"]
    h, at = shingle_sets(*flat(pa.array(t)), 3)
    sets = [set(h[at[i] : at[i + 1]].tolist()) for i in range(len(t))]
    want = brute_sets(dict(enumerate(t)))
    for i, j in itertools.combinations_with_replacement(range(len(t)), 2):
        assert len(sets[i] & sets[j]) == len(want[i] & want[j])


def test_fingerprints_give_every_link(documents, texts):
    """Classes, and all links between them, against sets of words; a link needs a band of the reported signatures in common."""
    sets, pairs = brute_sets(texts), brute_pairs(texts, fingerprints.THRESHOLD)
    rows = {r["doc_id"]: r for r in fingerprints.document_fingerprints(documents).collect()}
    first = {}
    for i in sorted(texts):
        first.setdefault(frozenset(sets[i]), i)
    name = {i: first[frozenset(sets[i])] for i in texts}
    bands = {i: {(k, tuple(r["signature"][k : k + 4])) for k in range(0, 128, 4)} for i, r in rows.items() if r["signature"]}
    different = {p: j for p, j in pairs.items() if name[p[0]] == p[0] and name[p[1]] == p[1]}
    want = {p: j for p, j in different.items() if bands[p[0]] & bands[p[1]]}
    got = {(r["class_a"], r["class_b"]): r["jaccard"] for r in fingerprints.fingerprint_pairs(documents).collect()}
    assert got == pytest.approx(want) and len(got) >= 0.9 * len(different) > 0
    assert all(p in got for p, j in different.items() if j >= 0.85)
    for i, r in rows.items():
        near = [(j, -a) for (a, b), j in want.items() if b == name[i]]
        if not sets[i]:
            assert (r["class_id"], r["n_copies"], r["n_links"], r["match_id"]) == (None, None, 0, None)
            continue
        assert r["class_id"] == name[i] and r["n_copies"] == sum(n == name[i] for n in name.values()) and r["n_shingles"] == len(sets[i])
        assert r["n_links"] == sum(name[i] in p for p in want)
        best = max(near, default=None)
        assert (r["match_id"], r["jaccard"]) == ((name[i], 1.0) if name[i] != i else (None, None) if best is None else (-best[1], pytest.approx(best[0])))
    sig = {i: np.array(r["signature"]) for i, r in rows.items() if r["signature"]}
    assert np.mean([abs((sig[a] == sig[b]).mean() - j) for (a, b), j in pairs.items()]) < 0.05


def test_copies_are_one_class(spark):
    base = prose(3, 200)
    near = base + " and one more word"
    rows = [(i, base) for i in range(1, 7)] + [(i, near) for i in range(7, 11)] + [(11, prose(4, 200)), (11, base), (None, base)]
    got = sorted((r["doc_id"] or 0, r["class_id"] or 0, r["n_copies"] or 0, r["n_links"], r["match_id"] or 0) for r in fingerprints.document_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = [(0, 0, 0, 0, 0), (1, 1, 7, 1, 0)] + [(i, 1, 7, 1, 1) for i in range(2, 7)] + [(7, 7, 4, 1, 1)] + [(i, 7, 4, 1, 7) for i in range(8, 11)] + [(11, 1, 7, 1, 1), (11, 11, 1, 0, 0)]
    assert got == want


def test_buckets_are_compared_in_blocks(spark):
    rows = [(i, b) for b in range(3) for i in range(b, 40)] + [(99, 5)]
    shared = pairs_of.shared_bands(spark.createDataFrame(rows + rows[:7], "set_key long, band long"))
    assert {(r["band"], r["n"]) for r in shared.collect()} == {(0, 40), (1, 39), (2, 38)}
    want = set(itertools.combinations(range(40), 2))
    roots = saved(spark.createDataFrame([(i, i % 4) for i in range(40)], "set_key long, root long"))
    reg = np.arange(128, dtype=np.uint16) + 1
    odd = np.where(np.arange(128) % 8 > 0, 5000 + np.arange(128, dtype=np.uint16), reg).astype(np.uint16)
    sketches = spark.createDataFrame([(i, bytearray((odd if i == 7 else reg).tobytes())) for i in range(40)] * 2, "set_key long, registers binary")
    for block in (1, 6, 512):
        assert sorted((r["a"], r["b"]) for r in pairs_of.band_pairs(shared, block).collect()) == sorted(want)
        across = near_dedup.across_pairs(shared, roots, sketches, 0.25, 7, block)
        assert sorted((r["a"], r["b"]) for r in across.collect()) == sorted((a, b) for a, b in want if a % 4 != b % 4 and 7 not in (a, b))


@pytest.mark.parametrize("block,cells", [(256, 1024), (2, 1), (1, 3)])
def test_verification_by_brute_force(spark, monkeypatch, block, cells):
    """All pairs of 30 texts, of which some rows are repeated, in blocks and lists of any size."""
    monkeypatch.setattr(pairs_of, "BLOCK", block)
    monkeypatch.setattr(pairs_of, "CELLS", cells)
    rng = np.random.default_rng(5)
    words = [[f"w{x}" for x in rng.integers(0, 4000, 40)] for _ in range(6)]
    texts = {i: " ".join(w if rng.random() > 0.02 * (i % 5) else "other" + str(i) for w in words[i // 5]) + f" end{i}" for i in range(30)}
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()] + [(i, texts[i]) for i in (0, 1, 1, 7)], "doc_id long, text string").withColumn("text_key", pairs_of.text_key())
    reps = spark.createDataFrame([(i + 100, i) for i in texts], "set_key long, i long").join(docs.distinct().withColumnRenamed("doc_id", "i"), "i")
    reps = reps.select("set_key", F.struct(F.col("i").alias("doc_id"), "text_key").alias("first"))
    edges = spark.createDataFrame([(a + 100, b + 100) for a in texts for b in texts if a < b], "a long, b long")
    got = {(x["a"] - 100, x["b"] - 100): x["jaccard"] for x in pairs_of.verified(docs, reps, edges, 3, 0.3).collect()}
    want = brute_pairs(texts, 0.3)
    assert got.keys() == want.keys() and len(want) > 20
    assert all(abs(got[p] - want[p]) < 1e-12 for p in want)


def test_components_by_both_ways(spark):
    r = random.Random(9)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(20)] + [(200, 200 + i) for i in range(1, 9)]
    root = {i: i for e in edges for i in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    want = {i: x for i, x in root.items() if any(i in e and e[0] != e[1] for e in edges)}
    df = spark.createDataFrame([(b, a) for a, b in edges] + edges, "a long, b long")
    for few in (1000, 0):
        assert {x["set_key"]: x["root"] for x in pairs_of.components(df, few).collect()} == want
    assert pairs_of.components(df.where("false")).collect() == []


def test_sets_of_one_key_are_told_apart(spark):
    rows = [(1, 10, 3, 7, 1), (2, 20, 3, 7, 2), (3, 30, 3, 7, 1), (4, 40, 3, 8, 1)]
    sketches, reps = pairs_of.classes(spark.createDataFrame(rows, "doc_id long, text_key long, n_shingles int, set_key long, check_key long"))
    assert {(r["first"]["doc_id"], r["n"]) for r in reps.collect()} == {(1, 2), (2, 1), (4, 1)}
    key = {r["doc_id"]: r["set_key"] for r in sketches.collect()}
    assert key[1] == key[3] != key[2] and key[4] == 8


def test_near_duplicate_groups(documents, texts):
    """Groups are the components of all verified links between sets with a band in common."""
    ids = sorted(texts)
    h, at = shingle_sets(*flat(pa.array([texts[i] for i in ids])), 3)
    reg = {i: x for i, x in zip(ids, near_dedup.registers(h, at).reshape(len(ids), -1, near_dedup.ROWS))}
    linked = lambda a, b: bool(((reg[a] == reg[b]).all(axis=1) & reg[a].any(axis=1)).any())
    want = brute_groups(texts, near_dedup.THRESHOLD, linked)
    got = {r["doc_id"]: (r["group_id"], r["kept"]) for r in near_dedup.dedup_report(documents).collect()}
    assert got == {i: (g, int(i == g)) for i, g in want.items()}
    pairs = brute_pairs(texts, near_dedup.THRESHOLD)
    assert sum(got[a][0] == got[b][0] for a, b in pairs) >= 0.9 * len(pairs) > 0 and all(got[a][0] == got[b][0] for (a, b), j in pairs.items() if j >= 0.85)


def test_different_texts_of_one_id_stay(spark):
    a, b, c = prose(1, 200), prose(2, 200), prose(3, 200)
    rows = [(1, a, "x"), (1, b, "x"), (2, b + " more", "x"), (3, c, "x"), (3, c, "w"), (3, c + " more", "x"), (4, a, "x"), (5, "", "x"), (5, "", "x"), (5, None, "x"), (None, a, "x")]
    df = spark.createDataFrame(rows, "doc_id int, text string, one string")
    got = sorted(map(str, map(tuple, near_dedup.near_dedup(df).collect())))
    stays = [r for r in rows if r[0] in (1, 5, None)]
    stays.remove((5, "", "x"))
    third = [s for s in ([(3, c, "w")], [(3, c + " more", "x")]) if sorted(map(str, stays + s)) == got]
    assert len(third) == 1  # of the two near texts of 3 the one of the smaller hash
    assert near_dedup.near_dedup(df.withColumn("doc_id", F.col("doc_id").cast("string"))).count() == len(got)


def test_near_copies_that_share_a_passage_with_others(spark):
    """Pairs of Jaccard 0.61, among documents of which any two have 0.48 from one passage."""
    r = random.Random(6)
    words = lambda n: " ".join(f"w{r.randrange(10**9)}" for _ in range(n))
    passage, texts = words(260), {}
    for i in range(300):
        pair = words(44)
        texts |= {j: f"{passage} {pair} {words(96)}" for j in (i, 1000 + i)}
    got = {r["doc_id"]: r["group_id"] for r in near_dedup.near_duplicate_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert set(brute_pairs(texts, near_dedup.THRESHOLD)) == {(i, 1000 + i) for i in range(300)}
    assert all(g == i % 1000 for i, g in got.items())
    assert sum(got.get(i) == got.get(1000 + i) == i for i in range(300)) >= 0.97 * 300


@pytest.mark.parametrize("r", [2, 10])
def test_collision_correction(r):
    rng = np.random.default_rng(5)
    plain, corrected = [], []
    for _ in range(60):
        a = rng.integers(0, 1 << 44, 900, dtype=np.uint64)
        b = np.concatenate((a[:300], rng.integers(0, 1 << 44, 600, dtype=np.uint64)))
        reg = near_dedup.registers(np.concatenate((a, b)), np.array([0, 900, 1800]), 7, r)
        plain.append((reg[0] == reg[1]).mean())
        corrected.append(near_dedup.estimate(reg[0], reg[1], 900, 900, 7, r))
    assert abs(np.mean(corrected) - 0.2) < 0.03
    assert r > 2 or np.mean(plain) - 0.2 > 2 * abs(np.mean(corrected) - 0.2)


def test_registers_keep_leading_zeros_and_mantissa():
    p, r = 7, 10
    h = np.arange(1, 400, dtype=np.uint64)
    reg = near_dedup.registers(h, np.array([0, 399]), p, r)[0]
    x = near_dedup.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    for slot in range(1 << p):
        mine = [int(v) for v in x if int(v) >> (64 - p) == slot]
        if not mine:
            assert reg[slot] == 0
            continue
        least = min((v << p) % (1 << 64) | 1 for v in mine)
        bits = least.bit_length()
        code = (min(62, bits - 1) << r) + ((least << (64 - bits)) % (1 << 64) << 1 >> (64 - r)) % (1 << r) + 1
        assert reg[slot] == code % (1 << 16)


def test_long_key_lists_are_joined_by_shuffling(spark):
    df = spark.range(100).withColumnRenamed("id", "doc_id")
    keys = saved(spark.range(0, 50, 2).withColumnRenamed("id", "x"))
    for limit in (1000, 3):
        assert by_keys(df, "doc_id", keys, True, limit).count() == 25 and by_keys(df, "doc_id", keys, False, limit).count() == 75


# -- 4


def brute_cost(sizes, ends, c, lost, inside):
    total = [0, *itertools.accumulate(sizes)]
    best = [0] + [None] * len(sizes)
    for j in range(1, len(sizes) + 1):
        s = lambda i: total[j] - total[i]  # noqa: E731, B023
        best[j] = min(best[i] + (c - s(i) if s(i) <= c else lost * (s(i) - c)) for i in range(j)) + (0 if ends[j - 1] else inside)
    return best[-1]


def cost_of(cuts, sizes, ends, c, lost, inside):
    at = total = 0
    for j in cuts:
        s = sum(sizes[at:j])
        total += (c - s if s <= c else lost * (s - c)) + (0 if ends[j - 1] else inside)
        at = j
    return total


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0, 1, 3, 7, 12, 40]), st.booleans()), min_size=1, max_size=30), st.integers(1, 40), st.integers(1, 5), st.integers(0, 9))
def test_cuts_are_the_cheapest(units, c, lost, inside):
    sizes, ends = [s for s, _ in units], [e for _, e in units[:-1]] + [True]
    cuts, cost = packing.best_cuts(sizes, ends, c, lost, inside)
    assert cuts[-1] == len(sizes) and cost == cost_of(cuts, sizes, ends, c, lost, inside) == brute_cost(sizes, ends, c, lost, inside)


PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def coder():
    ranks = bpe.load_ranks(queries.RANKS)
    return bpe.Vocabulary(ranks), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def brute_sentences(enc, t):
    """Token lists of the sentences, piece by piece."""
    t = t or ""
    cuts = {m.start() for m in re.finditer(r"(?<=[.!?])[ \t\n\v\f\r]|\n", t)} - {0}
    out = [[]]
    for m in regex.finditer(PATTERN, t):
        if m.start() and any(m.start() == c or before < c < m.start() for c in cuts):
            out.append([])
        out[-1] += enc.encode_ordinary(m.group())
        before = m.start()
    return out


@settings(max_examples=300, deadline=None)
@given(t=st.lists(st.one_of(st.none(), st.text("ab.!? \n\té1,", max_size=25)), max_size=8))
def test_sentences(coder, t):
    v, enc = coder
    data, offs = flat(pa.array(t, pa.string()))
    _, piece, number, at = bpe.encode_pieces(v, data, offs)
    sizes, to = packing.sentences(data, offs, piece, number, at)
    assert [sizes[to[i] : to[i + 1]].tolist() for i in range(len(t))] == [list(map(len, brute_sentences(enc, x))) for x in t]


def check_packed(rows, texts, enc, shard=packing.SHARD):
    """Windows cover the sentences of each shard in order, at the least cost, with their tokens."""
    by, total, want = defaultdict(list), 0, defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    for i in sorted(texts):
        z = brute_sentences(enc, texts[i])
        want[total // shard] += [(i, n, s, n + 1 == len(z)) for n, s in enumerate(z)]
        total += sum(map(len, z))
    assert set(by) == set(want)
    for s, windows in by.items():
        windows.sort(key=lambda r: r["window"])
        units = want[s]
        place = {(i, n): k for k, (i, n, _, _) in enumerate(units)}
        cuts, at = [], 0
        for w in windows:
            assert place[w["first_doc"], w["first_sentence"]] == at
            begin, at = at, place[w["last_doc"], w["last_sentence"]] + 1
            cuts.append(at)
            tokens = [x for u in units[begin:at] for x in u[2]]
            assert w["doc_ids"] == sorted({u[0] for u in units[begin:at]}) and w["tokens"] == tokens[: packing.CAPACITY]
            assert w["n_tokens"] == len(w["tokens"]) == packing.CAPACITY - w["padding"] and w["truncated"] == len(tokens) - w["n_tokens"]
        assert at == len(units)
        args = [len(u[2]) for u in units], [u[3] for u in units], packing.CAPACITY, packing.TRUNCATION, packing.INSIDE
        assert cost_of(cuts, *args) == packing.best_cuts(*args)[1]


def test_words_of_all_lengths_are_merged_in_the_same_steps(coder, monkeypatch):
    """As many lookups of pairs as the longest word has merges, whatever lengths there are beside it."""
    v, public = coder
    r = random.Random(5)
    words = ["".join(r.choice("etaoin shrdlu") for _ in range(n)).encode() for n in range(1, 200) for _ in range(3)] + ["é😀ü".encode() * 3, b"a", b"the" * 21]
    start = np.cumsum([0, *map(len, words)])[:-1]
    size, calls, pair = np.array([*map(len, words)]), [], bpe.Vocabulary.pair
    monkeypatch.setattr(bpe.Vocabulary, "pair", lambda *x: calls.append(0) or pair(*x))
    short = size <= bpe.LONG
    tokens, count = bpe.merge_words(v, np.frombuffer(b"".join(words), np.uint8), start[short], size[short])
    assert len(calls) <= bpe.LONG
    tokens, count = bpe.merge_words(v, np.frombuffer(b"".join(words), np.uint8), start, size)
    ends = np.cumsum(count)
    for w, n, end in zip(words, count, ends):
        assert tokens[end - n : end].tolist() == public._encode_single_piece(w)


def test_hashes_of_much_text_leave_small_tables(monkeypatch):
    monkeypatch.setattr(textops, "_tables", {b: np.ones(1, np.uint64) for b in (textops.BASE, textops.INVERSE)})
    r = np.random.default_rng(3)
    size = r.integers(0, 900, 12_000)
    size[5_000] = 3 * textops.BLOCK
    ends = np.cumsum(size)
    data = r.integers(0, 256, ends[-1]).astype(np.uint8)
    assert len(data) > 2 * textops.KEPT
    got = textops.span_hashes(data, ends - size, ends)
    assert all(len(t) <= textops.KEPT for t in textops._tables.values())
    for i in [*range(0, 12_000, 500), 4_999, 5_001]:
        assert got[i] == textops.span_hashes(data[ends[i] - size[i] : ends[i]], np.array([0]), size[i : i + 1])[0]
    assert textops.run_hash(textops.word_prefix(got), np.arange(3), 2).tolist() == [textops.run_hash(textops.word_prefix(got[i : i + 2]), np.zeros(1, int), 2)[0] for i in range(3)]


def test_memo_of_words_finds_what_it_has_and_no_more():
    memo = bpe.Memo()
    keys = np.arange(1, 30_001, dtype=np.uint64) * np.uint64(7)  # all want the same slot of the table
    keys[::2] = mix(keys[::2].copy())
    for lo in range(0, 3_000, 500):
        some = keys[lo : lo + 500]
        assert (memo.find(some) == -1).all()
        memo.add(some, np.repeat(np.arange(lo, lo + 500), 2), np.full(500, 2))
    assert memo.find(keys[:3_500]).tolist() == [*range(3_000), *[-1] * 500] and len(memo) == 3_000
    tokens, begin, count = memo.flat()
    assert (tokens[begin] == np.arange(3_000)).all() and (count == 2).all()


@pytest.mark.parametrize("shard,limit", [(packing.SHARD, 9), (10_000, 1000), (10_000, 0)])
def test_packing_of_the_documents(documents, texts, coder, shard, limit):
    rows = packing.pack(documents, queries.RANKS, shard=shard, limit=limit).collect()
    assert len({r["shard"] for r in rows}) > 9 or shard == packing.SHARD
    check_packed(rows, texts, coder[1], shard)


def test_windows_dont_depend_on_what_the_ids_are(documents):
    key = lambda rows: sorted((r["shard"], r["window"], r["n_tokens"], r["padding"], r["truncated"], len(r["doc_ids"]), tuple(r["tokens"])) for r in rows)
    pack = lambda d: key(packing.pack(d, queries.RANKS, shard=50_000).collect())
    want = pack(documents)
    assert want == pack(documents.withColumn("doc_id", F.col("doc_id") * 1_000_003 - 10**12).repartition(7))
    assert want == pack(documents.withColumn("doc_id", F.col("doc_id").cast("string")))
    nulls = pack(documents.withColumn("doc_id", F.lit(None)))
    assert sum(r[2] + r[4] for r in nulls) == sum(r[2] + r[4] for r in want)


def test_many_copies_of_one_row(spark):
    """Rows of one id and text are spread over the shards like others."""
    rows = spark.range(300).select(F.lit(5).alias("doc_id"), F.lit("One two. Three four five.").alias("text"))
    got = packing.pack(rows, queries.RANKS, capacity=64, shard=200).collect()
    n = len(tiktoken_count(rows.first()["text"]))
    assert sum(r["n_tokens"] + r["truncated"] for r in got) == 300 * n and len({r["shard"] for r in got}) == -(-300 * n // 200)


def tiktoken_count(t):
    ranks = bpe.load_ranks(queries.RANKS)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(t)


# -- 5


@settings(max_examples=300, deadline=None)
@given(t=st.lists(st.one_of(st.text(max_size=40), st.text("abstrelmvd'’ \n\t!?.,é中😀1२  <|>", max_size=60)), max_size=6))
def test_encoding_is_exact(coder, t):
    v, enc = coder
    t = [x.encode("utf-8", "replace").decode() for x in t]
    data, offs = flat(pa.array(t, pa.string()))
    tokens, at = bpe.encode(v, data, offs)
    assert [tokens[at[i] : at[i + 1]].tolist() for i in range(len(t))] == [enc.encode_ordinary(x) for x in t]
    back, where = bpe.decode(v, tokens, at)
    assert back.tobytes() == data.tobytes() and (where == offs).all()


def test_long_words(coder):
    v, enc = coder
    t = ["ab" * 400, "=" * 1000 + " " * 333 + "x", "Donaudampfschifffahrtsgesellschaft" * 9, "'ll" * 50]
    tokens, at = bpe.encode(v, *flat(pa.array(t)))
    assert [tokens[at[i] : at[i + 1]].tolist() for i in range(len(t))] == [enc.encode_ordinary(x) for x in t]


def test_documents_round_trip(documents, texts):
    enc = bpe.bpe_encode(documents, queries.RANKS)
    rows = bpe.bpe_decode(enc.drop("round_trip"), queries.RANKS).collect()
    assert all(r["decoded"] == texts[r["doc_id"]] for r in rows) and len(rows) == len(texts)


# -- 6


def test_batches_count_once(spark, tmp_path):
    store = token_rollup.Rollup(spark, str(tmp_path / "r"))
    rows = lambda *x: spark.createDataFrame(list(x), "source string, lang string, tokenizer_version string, tokens long")
    assert store.totals().collect() == []
    assert store.commit("b1", token_rollup.inserted(rows(("s", "en", "v", 10), ("s", "en", "v", 5), (None, "de", "v", 0))))
    assert not store.commit("b1", token_rollup.inserted(rows(("s", "en", "v", 10))))
    total = lambda: {tuple(r)[:2]: tuple(r)[3:] for r in store.totals().collect()}
    assert total() == {("s", "en"): (2, 15), (None, "de"): (1, 0)}
    rows(("s", "en", "v", 99)).withColumn("docs", F.lit(1)).write.parquet(str(tmp_path / "r/deltas/crashed"))  # no marker, no effect
    store.compact()
    change = spark.createDataFrame([("s", "en", "v", 5, 8)], "source string, lang string, tokenizer_version string, x long, y long")
    store.commit("b2", token_rollup.revised(change, "x", "y"))
    store.commit("b3", token_rollup.deleted(rows((None, "de", "v", 0))))
    assert total() == {("s", "en"): (2, 18)}
    store.compact()
    assert total() == {("s", "en"): (2, 18)} and store.committed() == ["b1", "b2", "b3"]
    assert not store.commit("b2", token_rollup.revised(change, "x", "y"))


def changes(spark, *rows):
    return token_rollup.inserted(spark.createDataFrame(list(rows), "source string, lang string, tokenizer_version string, tokens long"))


def test_an_interrupted_commit_can_be_delivered_again(spark, tmp_path, monkeypatch):
    """A crash after the part was written, after the draft was written, and in the middle of the draft."""
    store = token_rollup.Rollup(spark, str(tmp_path / "r"))
    rows = changes(spark, ("s", "en", "v", 10))
    real = token_rollup.Rollup._mark

    def crash(*a):
        raise RuntimeError

    def half(self, name, content):
        fs, p = self._at("drafts/half")
        fs.create(p, True).close()
        raise RuntimeError

    for n, broken in enumerate((crash, half)):
        monkeypatch.setattr(token_rollup.Rollup, "_mark", broken)
        with pytest.raises(RuntimeError):
            store.commit(f"b{n}", rows)
        monkeypatch.setattr(token_rollup.Rollup, "_mark", real)
        assert len(store.committed()) == n and store.totals().count() == (1 if n else 0)
        assert store.commit(f"b{n}", rows) and not store.commit(f"b{n}", rows)
        assert tuple(store.totals().first())[3:] == (n + 1, 10 * (n + 1))
    assert not store._mark("commits/b1", "other") and store._read("commits/b1") != "other"
    assert store.vacuum(0) == 3 and tuple(store.totals().first())[3:] == (2, 20)


def test_a_commit_during_a_compaction_counts_once(spark, tmp_path, monkeypatch):
    store = token_rollup.Rollup(spark, str(tmp_path / "r"))
    rows = changes(spark, ("s", "en", "v", 5))
    store.commit("b1", rows), store.commit("b2", rows)
    real = token_rollup.Rollup._write

    def between(self, sums, part):
        monkeypatch.setattr(token_rollup.Rollup, "_write", real)
        store.commit("b3", rows)
        real(self, sums, part)

    monkeypatch.setattr(token_rollup.Rollup, "_write", between)
    assert store.compact()
    for _ in range(2):
        assert tuple(store.totals().first())[3:] == (3, 15)
        store.compact()
    assert not store.compact() and store.committed() == ["b1", "b2", "b3"]


def test_commits_compact_themselves(spark, tmp_path):
    store = token_rollup.Rollup(spark, str(tmp_path / "r"), fold=3)
    for i in range(7):
        store.commit(f"b{i}", changes(spark, ("s", "en", "v", i)))
    assert len(store._state()[1]) == 1 and tuple(store.totals().first())[3:] == (7, 21)
    assert store.vacuum(0) == 7 and tuple(store.totals().first())[3:] == (7, 21)  # six batches and the first fold


def test_counts_of_the_encoding(documents, texts, coder):
    got = {(r["source"], r["lang"]): (r["docs"], r["tokens"]) for r in token_rollup.corpus_rollup(documents, {"bpe-50k": queries.RANKS}).collect()}
    want = defaultdict(lambda: [0, 0])
    seen = set()
    for r in sorted(documents.collect(), key=lambda r: r["doc_id"]):
        if r["text"] not in seen:
            seen.add(r["text"])
            want[r["source"], r["lang"]][0] += 1
            want[r["source"], r["lang"]][1] += len(coder[1].encode_ordinary("\n".join(dict.fromkeys(r["text"].split("\n")))))
    assert got == {k: tuple(v) for k, v in want.items()}


# -- 7


def test_held_out_entities():
    m = pii.train()
    pairs = pii.examples(300, seed=77)
    data, offs = flat(pa.array([t for t, _ in pairs]))
    want = {(d, int(offs[d]) + len(t[:a].encode()), int(offs[d]) + len(t[:b].encode()), k) for d, (t, s) in enumerate(pairs) for a, b, k in s}
    got = set(pii.entities(m, data, offs))
    assert len(got & want) > 0.97 * len(want) and len(got & want) > 0.97 * len(got)


def test_messages_are_exact_on_a_tree():
    m = pii.train()
    t = "call +1 (212) 555-7788 now or 10.0.0.1 or 17"
    data, offs = flat(pa.array([t]))
    g = pii.graph(data, offs, m.names)
    g.edges = g.edges[g.edges[:, 2] == 0]
    u, n = pii._unary(m, g), len(g.doc)
    marg = np.zeros((n, pii.K))
    for y in itertools.product(range(pii.K), repeat=n):
        s = sum(u[i, y[i]] for i in range(n)) + sum(m.chain[y[i], y[j]] for i, j, _ in g.edges)
        for i in range(n):
            marg[i, y[i]] += np.exp(s)
    assert pii.infer(m, g, 200).tolist() == marg.argmax(axis=1).tolist()


def brute_labels(m, g, d):
    """Damped sum-product in dictionaries, over one document: labels of its nodes and their marginals."""
    mine = np.flatnonzero(g.doc == d).tolist()
    u = {n: np.zeros(pii.K) for n in mine}
    for n, c in zip(g.rows.tolist(), g.cols.tolist()):
        if n in u:
            u[n] = u[n] + m.unary[c]
    for n in mine:
        u[n] = u[n] + g.left_free[n] * m.chain[0] + g.right_free[n] * m.chain[:, 0]
    edges = [e for e in g.edges.tolist() if e[0] in u]
    psi, msg = {}, {}
    for x, (i, j, k) in enumerate(edges):
        p = (m.chain, m.same, m.alike)[k]
        psi[i, j, x], psi[j, i, x] = p, p.T
        msg[i, j, x] = msg[j, i, x] = np.zeros(pii.K)
    into = defaultdict(list)
    for key in msg:
        into[key[1]].append(key)
    belief = lambda n: u[n] + sum((msg[k] for k in into[n]), np.zeros(pii.K))
    norm = lambda v: v - v.max() - np.log(np.exp(v - v.max()).sum())
    for _ in range(pii.ROUNDS):
        new = {}
        for (i, j, x), old in msg.items():
            h = belief(i) - msg[j, i, x]
            t = np.array([np.logaddexp.reduce(h + psi[i, j, x][:, b]) for b in range(pii.K)])
            new[i, j, x] = pii.DAMPING * old + (1 - pii.DAMPING) * norm(t)
        change = max((np.abs(new[k] - msg[k]).max() for k in msg), default=0)
        msg = new
        if change < pii.SETTLED:
            break
    marginals = {n: np.exp(norm(belief(n))) for n in mine}
    return {n: int(v.argmax()) for n, v in marginals.items()}, marginals, u, edges


def test_loopy_messages_against_dictionaries_and_enumeration():
    m = pii.train()
    r, close, nodes = random.Random(4), 0, 0
    for seed in range(40):
        t = " ".join(r.choice(["10.0.0.1", "10.0.0.1", "212-555-7788", "212-555-7788", "call", "17", "555-77", "2.0", "a@b.org"]) for _ in range(r.randint(3, 9)))
        g = pii.graph(*flat(pa.array([t])), m.names)
        if not len(g.doc) or len(g.doc) > 6:
            continue
        labels, marginals, u, edges = brute_labels(m, g, 0)
        assert pii.infer(m, g).tolist() == [labels[n] for n in range(len(g.doc))], t
        exact = np.zeros((len(g.doc), pii.K))
        for y in itertools.product(range(pii.K), repeat=len(g.doc)):
            w = np.exp(sum(u[i][y[i]] for i in u) + sum((m.chain, m.same, m.alike)[k][y[i], y[j]] for i, j, k in edges) - 60)
            for i in range(len(g.doc)):
                exact[i, y[i]] += w
        exact /= exact.sum(axis=1, keepdims=True)
        nodes += len(g.doc)
        close += sum(exact[i].argmax() == labels[i] for i in range(len(g.doc)))
    assert nodes > 60 and close >= 0.97 * nodes


def test_report_rows_by_brute_force(documents, texts):
    """Every row of the report, its labels found in one document alone and its text cut by hand."""
    m = pii.train()
    rows = {r["doc_id"]: r for r in pii.pii_report(documents).collect()}
    assert set(rows) == set(texts) and any(r["n_entities"] for r in rows.values())
    for i, t in texts.items():
        data, offs = flat(pa.array([t]))
        g = pii.graph(data, offs, m.names)
        labels, raw, spans = brute_labels(m, g, 0)[0], t.encode(), []
        for n in range(len(g.doc)):
            token = raw[g.start[n] : g.end[n]]
            lo = len(token) - len(token.lstrip(b"\"'`!#$%&*|,;:<>[]{}=?"))
            hi = lo + len(token[lo:].rstrip(b"\"'`!#$%&*|,;:<>[]{}=?."))
            k = pii.LABELS[labels[n]]
            if k == "O" or lo == hi:
                continue
            joined = n and not g.left_free[n] and labels[n - 1] == labels[n] and spans and token[:1] != b"+" and (k == "PHONE" or k == "CARD" and hi - lo <= 4)
            if joined:
                spans[-1][1] = int(g.start[n]) + hi
            else:
                spans.append([int(g.start[n]) + lo, int(g.start[n]) + hi, k])
        want = [(k, len(raw[:a].decode()), len(raw[:b].decode())) for a, b, k in spans]
        assert [(e["label"], e["start"], e["end"]) for e in rows[i]["entities"]] == want and rows[i]["n_entities"] == len(want)
        for a, b, k in reversed(spans):
            raw = raw[:a] + f"[{k}]".encode() + raw[b:]
        assert rows[i]["text"] == raw.decode()


def test_documents_dont_depend_on_each_other():
    m = pii.train()
    t = [x for x, _ in pii.examples(120, seed=5)]
    one = [[(s, e, k) for _, s, e, k in pii.entities(m, *flat(pa.array([x])))] for x in t]
    data, offs = flat(pa.array(t))
    both = [[] for _ in t]
    for d, s, e, k in pii.entities(m, data, offs):
        both[d].append((s - int(offs[d]), e - int(offs[d]), k))
    assert one == both


def test_secrets_of_letters_and_long_neighbours(spark):
    t = ["password = correcthorse", "Set db_password: open-sesame-now here", "the key: of the matter", "x" * 6000 + "= " + "ab12" * 10, "secret = " + "q" * 9000]
    got = [r["text"] for r in pii.pii_report(spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == ["password = [SECRET]", "Set db_password: [SECRET] here", t[2], "x" * 6000 + "= [SECRET]", "secret = [SECRET]"]


def test_equal_tokens_share_their_label():
    m = pii.train()
    data, offs = flat(pa.array(["x"]))
    g = pii.graph(data, offs, m.names)
    k = len(pii.LABELS)
    g.doc, g.left_free, g.right_free = np.zeros(2, np.int64), np.zeros(2, bool), np.zeros(2, bool)
    g.rows, g.cols = np.arange(2), np.arange(2)
    w = pii.Model({"a": 0, "b": 1}, np.zeros((2, k)), np.zeros((k, k)), m.same, m.alike)
    w.unary[0, 2], w.unary[1, 0], w.unary[1, 2] = 4.0, 0.4, 0.2  # the first is surely a phone, the second hardly nothing
    g.edges = np.zeros((0, 3), np.int64)
    assert pii.infer(w, g).tolist() == [2, 0]
    g.edges = np.array([[0, 1, 1]])
    assert pii.infer(w, g).tolist() == [2, 2]


def test_plain_numbers_stay(spark):
    t = "In 1999, version 2.0 had 3,400 users; 12:30 on 2020-05-06 cost $12.50. See 4.0. and 9. or @home, a=b, 50%."
    r = pii.pii_report(spark.createDataFrame([(1, t)], "doc_id long, text string")).first()
    assert r["text"] == t and r["entities"] == []


# -- 8


def brute_repeats(docs, length):
    """docs: {id: words}; the words that lie in a run of `length` that occurred before."""
    first, gone = set(), {i: set() for i in docs}
    for i in sorted(docs):
        w = docs[i]
        for p in range(len(w) - length + 1):
            run = tuple(w[p : p + length])
            if run in first:
                gone[i] |= set(range(p, p + length))
            first.add(run)
    return gone


def small_run(docs, length, k, large):
    """The operator's steps on {id: words}, without Spark."""
    ids = sorted(docs)
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array([" ".join(docs[i]) for i in ids])], ["doc_id", "text"])
    a = suffix_dedup._anchor_rows(length, k)(batch).to_pandas()
    a["n"] = a.groupby("h").h.transform("size")
    a = a[a.n > 1]
    a["cell"] = np.where(a.n > large, (a.doc_id * 31 + a.pos * 7) % -(-a.n // large) + 1, 0)

    def listed(rows, columns, kind):
        at = [rows[rows.doc_id == i][columns].to_dict("records") for i in ids]
        return batch.append_column("at", pa.array(at, pa.list_(pa.struct(kind))))

    ctx = suffix_dedup._contexts(length, k)(listed(a, ["pos", "h", "cell"], [("pos", pa.int32()), ("h", pa.int64()), ("cell", pa.int32())])).to_pandas().sort_values(["h", "cell", "doc_id", "pos"])
    rows = pa.RecordBatch.from_pandas(ctx, preserve_index=False)
    cuts = pa.Table.from_batches(suffix_dedup._cuts(length, k)(rows.slice(x, 7) for x in range(0, rows.num_rows, 7))).to_pandas() if rows.num_rows else []
    gone = {i: set() for i in docs}
    if not len(cuts):
        return gone
    lead = cuts[cuts.h.notna()].rename(columns={"lo": "pos"})
    words = suffix_dedup._run_words(length)(listed(lead, ["h", "l", "run", "pos"], [("h", pa.int64()), ("l", pa.int32()), ("run", pa.int64()), ("pos", pa.int32())])).to_pandas().sort_values(["h", "l", "run", "doc_id", "pos"])
    later = [c.to_pandas() for c in suffix_dedup._later(length)([pa.RecordBatch.from_pandas(words, preserve_index=False)])] if len(words) else []
    for c in [cuts[cuts.h.isna()], *later]:
        for i, lo, hi in zip(c.doc_id, c.lo, c.hi):
            gone[i] |= set(range(lo, hi))
    return gone


def tangled(seed):
    r = random.Random(seed)
    pool = [[r.choice("abc") for _ in range(r.randint(3, 12))] for _ in range(4)]
    return {i: list(itertools.chain(*(r.choice(pool) if r.random() < 0.6 else [r.choice("abcdefgh")] * r.randint(1, 3) for _ in range(r.randint(0, 8))))) for i in range(r.randint(1, 14))}


@pytest.mark.parametrize("step,large,slice_", [(4000, 16000, 1000), (3, 5, 2), (1, 1, 1)])
def test_repeats_against_brute_force(monkeypatch, step, large, slice_):
    monkeypatch.setattr(suffix_dedup, "STEP", step), monkeypatch.setattr(suffix_dedup, "SLICE", slice_)
    for seed in range(60):
        docs = tangled(seed)
        assert small_run(docs, 6, 3, large) == brute_repeats(docs, 6), seed


@pytest.mark.parametrize("large", [16000, 4, 1])
def test_colliding_hashes_cut_nothing_else(monkeypatch, large):
    real = suffix_dedup.span_hashes
    monkeypatch.setattr(suffix_dedup, "span_hashes", lambda *a: real(*a) & np.uint64(1))
    for seed in range(40):
        docs = tangled(seed)
        want = brute_repeats(docs, 6)
        assert all(g <= want[i] for i, g in small_run(docs, 6, 3, large).items())


def test_large_groups_are_spread_over_cells(spark):
    """A passage in every document, in cells of a few occurrences."""
    r = random.Random(8)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    shared, other = words(70), words(55)
    docs = {i: words(r.randint(0, 30)) + shared + words(r.randint(0, 30)) + (other if i % 3 == 0 else []) for i in range(60)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string").repartition(4)
    want = brute_repeats(docs, 50)
    for large in (7, 16000):
        got = {x["doc_id"]: (x["text"].split(), x["removed_words"]) for x in suffix_dedup.repeats_report(df, large=large).collect()}
        assert got == {i: ([x for k, x in enumerate(w) if k not in want[i]], len(want[i])) for i, w in docs.items()}


def test_suffixes_are_sorted():
    r = random.Random(3)
    words = np.array([r.randint(0, 2) for _ in range(300)], np.uint64)
    start = np.arange(280)
    size, group = np.minimum(300 - start, 9), start // 70
    s = suffix_dedup._Suffixes(words, start, size, group)
    want = sorted(range(280), key=lambda i: (group[i], words[i : i + size[i]].tolist(), i))
    assert s.sorted().tolist() == want


# -- 9


@pytest.mark.parametrize("kind,every", [("lengths", 1), ("unit", 1), ("close", 1), ("lengths", 20)])
def test_top_k_is_exact(spark, kind, every):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(400, 12))
    if kind == "lengths":
        v *= np.exp(rng.normal(size=(400, 1)) * 1.5)
    elif kind == "close":
        v = v[rng.integers(0, 20, 400)] + rng.normal(size=(400, 12)) * 0.02
    if kind != "lengths":
        v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
    v[7], v[8], v[9] = v[6], v[6], 0.0
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    got = defaultdict(list)
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 5, 64, every).orderBy("vec_id", "rank").collect():
        got[r["vec_id"]].append((r["match_id"], r["score"]))
    s = np.round(np.einsum("id,jd->ij", v, v), 9)
    assert set(got) == set(range(0, 400, every))
    for i in got:
        want = sorted((j for j in range(400) if j != i), key=lambda j: (-s[i, j], j))[:5]
        assert [m for m, _ in got[i]] == want
        assert [x for _, x in got[i]] == pytest.approx([s[i, j] for j in want], abs=2e-9)


def test_coordinate_pruning_runs_and_keeps_all():
    rng = np.random.default_rng(2)
    p = rng.normal(size=(500, 6))
    p /= np.sqrt((p * p).sum(axis=1, keepdims=True))
    q, theta = p[:50], np.full(50, 0.93)
    found = {i: set(ids.tolist()) for i, ids, _ in topk.search(np.arange(50), q, np.arange(500), p, theta, 500)}
    for i in range(50):
        assert found.get(i, set()) == {j for j in range(500) if j != i and q[i] @ p[j] >= 0.93}


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (None, [1.0, 1.0]), (4, []), (5, [float("nan"), 1.0]), (6, [1.0, 2.0, 3.0]), (7, [None, 1.0]), (8, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1)).withColumn("block", F.lit(2))
    got = [(r["vec_id"], r["rank"], r["match_id"], r["score"]) for r in topk.top_k(df).collect()]
    assert sorted(got) == [(1, 1, 2, 0.5), (2, 1, 1, 0.5)]
    assert topk.top_k(df.where("false")).collect() == []


# -- 10


def test_lists_as_of_each_fetch(spark):
    entries = [(1, "block", "Bad.com", "add", "2024-01-02"), (2, "block", "bad.com", "remove", "2024-01-05"), (3, "block", "bad.com", "add", "2024-01-05"), (4, "block", "bad.com", "remove", "2024-01-08"),
               (5, "allow", "ok.bad.com", "add", "2024-01-03"), (6, "block", "x.org/en", "add", "2024-01-01"), (7, "block", None, "add", "2024-01-01"), (8, None, "y.org", "add", "2024-01-01"), (9, "block", "y.org", "odd", "2024-01-01"), (10, "block", "y.org", "remove", "2024-01-01")]
    e = spark.createDataFrame(entries, "entry_id long, list string, pattern string, action string, at string").withColumn("at", F.col("at").cast("timestamp"))
    pages = [(1, "http://www.bad.com/a", 1), (2, "http://www.bad.com/a", 2), (3, "https://u:p@BAD.com.:80/", 5), (4, "http://bad.com", 8), (5, "http://a.ok.bad.com/", 4), (6, "http://x.org/EN/1", 2), (7, "http://x.org/de/1", 2), (8, None, 2), (9, "no url", 2), (10, "http://y.org/", 3), (11, "http://notbad.com/", 3), (None, "http://bad.com/", 3), (1, "http://www.bad.com/a", 1)]
    c = spark.createDataFrame(pages, "page_id long, url string, day int").withColumn("fetched_at", F.expr("timestamp'2024-01-01' + make_dt_interval(day - 1)")).withColumn("verdict", F.lit("?"))
    c = c.unionByName(c.where("page_id = 2").withColumn("page_id", F.lit(20).cast("long")).withColumn("fetched_at", F.lit(None).cast("timestamp")))
    for limit, hot in ((100, 100), (0, 1), (0, 2)):
        got = {r["page_id"]: (r["verdict"], r["rule"], r["n_block"], r["n_allow"]) for r in url_filter.judged(c, e, limit, hot).collect()}
        none = ("none", None, 0, 0)
        assert got == {1: none, 2: ("block", "bad.com", 1, 0), 3: ("block", "bad.com", 1, 0), 4: none, 5: ("allow", "ok.bad.com", 1, 1), 6: ("block", "x.org/en", 1, 0), 7: none, 8: none, 9: none, 10: none, 11: none, None: ("block", "bad.com", 1, 0), 20: none}
    assert {r["verdict"] for r in url_filter.judged(c, e.where("false")).collect()} == {"none"}
    assert url_filter.judged(c.where("false"), e).collect() == []
