"""Operator 7, personal data: a skip-chain conditional random field that labels and redacts tokens.

Nodes are the tokens (between white space) with a digit or an @, those of 16 bytes or more behind an equals sign, and
those of any length behind the name of a credential and an equals sign or a colon; every other token is fixed to the
label O, so that a document falls into short chains. Potentials: features of a token and its surroundings;
pairs of labels of adjacent tokens; and, over skips of any length, pairs of labels of equal tokens and of tokens of
equal shape in the same document, consecutive occurrences being linked, so that a document's labels agree. The graph has
loops; damped sum-product messages run over all documents of a chunk at once, in numpy, but each document stops by
itself, when its own messages have settled or after ROUNDS rounds, so that no document depends on its neighbours in the
chunk. Every node takes its most likely label.

The weights are trained here, by pseudo-likelihood over generated, labelled text (`examples`), once per process on
the driver, and broadcast. Generated text holds all kinds of entities in several notations, repeated within a text, and
numbers that are none: years, versions, prices, dates, times, counts.

Labels: EMAIL, PHONE, CARD, IP, SSN, SECRET. An entity is replaced by its label in brackets, without the punctuation
around it; adjacent tokens of a phone number are one entity.

Defined cases: a null text stays null and an empty one empty, both without entities. Rows with a null doc_id and
repeated rows are treated like any other. Of equally likely labels the first in the order O, EMAIL, PHONE, CARD, IP,
SSN, SECRET is taken. A text without a digit, an @, an = or a colon never changes. An empty table gives an empty result.
Further columns pass through (redact), whatever their names are, or are ignored (pii_report), where a doc_id that is no
whole number is null.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.base import long, map_text, operator
from lexiforge.llm.textops import IS_SPACE, flat, runs

LABELS = ("O", "EMAIL", "PHONE", "CARD", "IP", "SSN", "SECRET")
K = len(LABELS)
ROUNDS, DAMPING, SETTLED, TEXTS = 200, 0.3, 1e-4, 1500

_EDGE = b"\"'`!#$%&*|,;:<>[]{}=?"
_TRIGGER = np.zeros(256, bool)
_TRIGGER[48:58] = True
_TRIGGER[64] = True
_RUNS = re.compile(rb"\d+")
_EMAIL = re.compile(rb"[\w.+%-]+@[\w-]+(\.[\w-]+)*\.[A-Za-z]{2,}", re.ASCII)
_HEX = re.compile(rb"[0-9a-f]{16,}|[0-9A-F]{16,}")
_KEY = re.compile(rb"[A-Za-z0-9_+/\-]{16,}={0,2}")
_NAME = re.compile(rb"(?i)([\w.-]*[_.-])?(token|key|apikey|secret|passw(or)?d|passphrase|pwd|credentials?)")


def core(token: bytes) -> tuple[int, int]:
    """Start and end of a token without the punctuation around it."""
    lo = len(token) - len(token.lstrip(_EDGE))
    inner = token[lo:].rstrip(_EDGE + b".")
    return lo, lo + len(inner)


def shape(word: bytes) -> bytes:
    """Digit runs as their lengths, letters as a: what tokens have in common that are alike."""
    return re.sub(rb"[A-Za-z\x80-\xff]+", b"a", _RUNS.sub(lambda m: b"<%d>" % len(m.group()) if len(m.group()) < 16 else b"<n>", word))


def _bucket(n: int) -> int:
    return n if n < 6 else 8 if n < 10 else 12 if n < 13 else 16 if n < 20 else 32 if n < 36 else 64


def behind_name(before2: bytes, before: bytes) -> bool:
    """Whether a token stands behind the name of a credential and an equals sign or a colon: "name =", "name=", "name:"."""
    if before in (b"=", b":", b":="):
        return _NAME.fullmatch(before2.strip(_EDGE)) is not None
    return before[-1:] in (b"=", b":") and _NAME.fullmatch(before.strip(_EDGE)) is not None


def features(token: bytes, before2: bytes, before: bytes, after: bytes) -> list[str]:
    """Names of the features of a token and its neighbours."""
    lo, hi = core(token)
    w = token[lo:hi]
    digits = sum(map(len, _RUNS.findall(w)))
    f = ["1", f"len{_bucket(len(w))}", f"dig{_bucket(digits)}"]
    if b"@" in w:
        f.append("email" if _EMAIL.fullmatch(w) else "at")
    elif w.isdigit():
        f.append(f"number{len(w) if len(w) < 20 else 20}")
        if 13 <= len(w) <= 19:
            f.append("cardlike")
    elif _HEX.fullmatch(w):
        f.append("hex")
    elif _KEY.fullmatch(w) and digits > 2:
        f.append("key")
    elif len(w) < 24:
        f.append("shape" + shape(w).decode("latin-1"))
        p = w.split(b".")
        if len(p) == 4 and all(x.isdigit() and len(x) < 4 and int(x) < 256 for x in p):
            f.append("octets")
        p = w.replace(b" ", b"-").split(b"-")
        if len(p) == 4 and all(x.isdigit() and len(x) == 4 for x in p):
            f.append("cardgroups")
    if token[:1] in b"\"'" and len(token) > 1:
        f.append("quoted")
    b, a = before.strip(_EDGE), after.strip(_EDGE + b".")
    f.append("before=" if before.endswith(b"=") else "before" + shape(b).decode("latin-1") if any(48 <= c < 58 for c in b) and len(b) < 16 else "beforeword")
    f.append("after" + shape(a).decode("latin-1") if any(48 <= c < 58 for c in a) and len(a) < 16 else "afterword")
    if before.endswith(b"=") and re.search(rb"(?i)token|key|secret|passw|auth|credential", before2 + before):
        f.append("credential")
    if behind_name(before2, before):
        f.append("named" if len(w) > 5 else "namedshort")
    return f


@dataclass
class Model:
    names: dict[str, int]
    unary: np.ndarray  # (features, K)
    chain: np.ndarray  # (K, K), left label by right label
    same: np.ndarray  # (K, K) of equal tokens
    alike: np.ndarray  # (K, K) of tokens of equal shape


@dataclass
class Graph:
    """Nodes of several documents: token bounds, features, and the edges between them."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    rows: np.ndarray  # feature entries: node
    cols: np.ndarray  # feature entries: feature
    left_free: np.ndarray  # whether the token to the left is no node
    right_free: np.ndarray
    edges: np.ndarray  # (n, 3): i, j, kind 0 chain, 1 same, 2 alike; i before j


def graph(data: np.ndarray, offs: np.ndarray, names: dict[str, int], grow: bool = False) -> Graph:
    """The nodes of the texts. With grow, new features get numbers."""
    s, e, at = runs(data, offs, IS_SPACE)
    hits = np.concatenate(([0], np.cumsum(_TRIGGER[data])))
    node = hits[e] > hits[s]
    behind = np.flatnonzero(data[e - 1] == 61) + 1 if len(e) else np.zeros(0, np.int64)
    behind = behind[behind < len(s)]
    behind = behind[(e - s)[behind] >= 16]
    node[behind] = True
    raw = data.tobytes() if len(s) else b""
    get = lambda i: raw[s[i] : e[i]]
    text = np.repeat(np.arange(len(offs) - 1), np.diff(at))
    sign = np.flatnonzero(np.isin(data[e - 1], (58, 61))) if len(e) else np.zeros(0, np.int64)
    for i in sign[sign + 1 < len(s)].tolist():
        if text[i + 1] == text[i] and behind_name(get(i - 1) if i and text[i - 1] == text[i] else b"", get(i)):
            node[i + 1] = True
    at_node = np.flatnonzero(node)
    doc = text[at_node]
    first, last = at[doc], at[doc + 1]
    rows, cols, edges = [], [], []
    seen: dict[tuple, int] = {}
    for n, (i, d, lo, hi) in enumerate(zip(at_node.tolist(), doc.tolist(), first.tolist(), last.tolist())):
        token = raw[s[i] : e[i]]
        for f in features(token, get(i - 2) if i - 2 >= lo else b"", get(i - 1) if i > lo else b"", get(i + 1) if i + 1 < hi else b""):
            c = names.setdefault(f, len(names)) if grow else names.get(f, -1)
            if c >= 0:
                rows.append(n)
                cols.append(c)
        a, b = core(token)
        w = token[a:b]
        before = seen.get((d, w))
        if before is not None:
            edges.append((before, n, 1))
        seen[d, w] = n
        key = (d, None, shape(w))
        before = seen.get(key)
        if before is not None and before != seen.get((d, w, 0)):
            edges.append((before, n, 2))
        seen[key] = n
        seen[d, w, 0] = n
    left = np.concatenate(([False], (at_node[1:] == at_node[:-1] + 1) & (doc[1:] == doc[:-1]))) if len(doc) else np.zeros(0, bool)
    chain = [(int(x) - 1, int(x), 0) for x in np.flatnonzero(left)]
    right = np.append(left[1:], False) if len(left) else left
    return Graph(doc, s[at_node], e[at_node], np.array(rows, np.int64), np.array(cols, np.int64), ~left, ~right, np.array(chain + edges, np.int64).reshape(-1, 3))


def _unary(m: Model, g: Graph) -> np.ndarray:
    u = np.zeros((len(g.doc), K))
    np.add.at(u, g.rows, m.unary[g.cols])
    u += g.left_free[:, None] * m.chain[0] + g.right_free[:, None] * m.chain[:, 0]
    return u


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def infer(m: Model, g: Graph, rounds: int = ROUNDS) -> np.ndarray:
    """Labels of the nodes by loopy sum-product over chain and skip edges; every document stops by itself."""
    belief = _unary(m, g)
    if not len(belief):
        return np.zeros(0, np.int64)
    base = belief.copy()
    if len(g.edges):
        i, j, kind = g.edges.T
        psi = np.stack([m.chain, m.same, m.alike])[kind]
        src, dst = np.concatenate((i, j)), np.concatenate((j, i))
        pot = np.concatenate((psi, psi.transpose(0, 2, 1)))
        back = np.concatenate((np.arange(len(i)) + len(i), np.arange(len(i))))
        msg = np.zeros((len(src), K))
        owner = g.doc[src]
        go = np.arange(len(src))  # messages of documents that go on
        for _ in range(rounds):
            new = _lse((belief[src[go]] - msg[back[go]])[:, :, None] + pot[go], 1)
            new -= _lse(new, 1)[:, None]
            new = DAMPING * msg[go] + (1 - DAMPING) * new
            change = np.zeros(int(g.doc[-1]) + 1)
            np.maximum.at(change, owner[go], np.abs(new - msg[go]).max(axis=1))
            msg[go] = new
            belief = base.copy()
            np.add.at(belief, dst, msg)
            go = go[change[owner[go]] >= SETTLED]
            if not len(go):
                break
    return belief.argmax(axis=1)


def examples(n: int = TEXTS, seed: int = 11) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Generated texts with the character spans of their entities."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyzéüñ") for _ in range(r.randint(1, 11)))
    hexa = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    ascii_word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9)))

    def entity() -> tuple[str, str, str, str]:
        """Label, text before, the entity, text behind."""
        kind = r.choice(LABELS[1:])
        if kind == "EMAIL":
            local = r.choice([ascii_word(), ascii_word() + "." + ascii_word(), ascii_word() + digits(2), word() + "." + digits(2), ascii_word() + "_" + ascii_word()])
            return kind, "", local + "@" + r.choice([ascii_word() + ".com", "mail" + digits(1) + ".example.com", ascii_word() + "." + ascii_word() + ".org"]), ""
        if kind == "PHONE":
            a, b, c = digits(3), digits(3), digits(4)
            return kind, "", r.choice([f"+{r.randint(1, 99)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{r.randint(1, 99)} {a} {b} {c}", f"+{r.randint(1, 99)}-{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{digits(11)}"]), ""
        if kind == "CARD":
            return kind, "", r.choice([digits(16), digits(16), digits(15), "-".join(digits(4) for _ in range(4)), " ".join(digits(4) for _ in range(4))]), ""
        if kind == "IP":
            return kind, "", ".".join(str(r.randint(0, 255)) for _ in range(4)), ""
        if kind == "SSN":
            return kind, "", f"{digits(3)}-{digits(2)}-{digits(4)}", ""
        if r.random() < 0.15:  # letters only, which its name alone tells
            name = r.choice(["token", "secret", "password", "api_key", "PASSWORD", "passwd", "db_password"])
            value = r.choice(["".join(ascii_word() for _ in range(r.randint(2, 4))), ascii_word() + "-" + ascii_word() + "-" + ascii_word(), ascii_word().title() + ascii_word()])
            return kind, *r.choice([(f"{name} = ", value, ""), (f"{name}: ", value, ""), (f'{name} = "', value, '"'), (f"{name}= ", value, "")])
        value = r.choice([hexa(40), hexa(40), hexa(32), hexa(64), "".join(r.choice("ABCDEFGHabcdefghijk0123456789_-") for _ in range(r.randint(20, 44)))])
        name = r.choice(["token", "key", "secret", "password", "api_key", ascii_word()])
        return kind, *r.choice([(f'{name} = "', value, '"'), (f"{name} = ", value, ""), ('"', value, '"')])

    def number() -> str:
        return r.choice([str(r.randint(0, 9)) + ".", str(r.randint(1, 99)), str(r.randint(1900, 2030)), digits(3), digits(5), f"{r.randint(0, 9)}.{r.randint(0, 9)}", f"{r.randint(0, 9)}.{r.randint(0, 9)}.{r.randint(0, 99)}", f"${r.randint(1, 999)}.{digits(2)}", f"{r.randint(1, 999)},{digits(3)}", f"20{digits(2)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1990, 2029)}", f"{r.randint(0, 23)}:{digits(2)}", f"{r.randint(1, 99)}%", word() + digits(1), digits(1) + "th", f"({r.randint(1, 20)})", digits(2) + "-" + digits(2), digits(7), "v" + digits(1), "= " + digits(2), "@" + ascii_word(), f"{word()}=", f"{ascii_word()} = {ascii_word()}", f"{ascii_word()}: {word()}", f"{word()} = {ascii_word()}{ascii_word()}{ascii_word()}", digits(1) + "x" + digits(2), "4.0.", "2.0."])

    out = []
    for _ in range(n):
        text, spans, had = "", [], []
        for _ in range(r.randint(5, 60)):
            x = r.random()
            glue = r.choice([" ", " ", " ", " ", "\n", " | "])
            if x < 0.12:
                kind, a, value, b = r.choice(had) if had and r.random() < 0.4 else entity()
                had.append((kind, a, value, b))
                text += a
                spans.append((len(text), len(text) + len(value), kind))
                text += value + b + r.choice(["", "", "", ".", ",", "!!", "***", "###", "%%%", "$$$", "&&&"]) + glue
            elif x < 0.3:
                text += number() + r.choice(["", "", ".", ",", "!!", "%%%"]) + glue
            else:
                text += word() + r.choice(["", "", "", ".", ",", "***"]) + glue
        out.append((text, spans))
    return out


@lru_cache(maxsize=2)
def train(n: int = TEXTS, steps: int = 250, seed: int = 11) -> Model:
    """Weights that maximise the pseudo-likelihood of the generated texts, with a quadratic penalty."""
    pairs = examples(n, seed)
    names: dict[str, int] = {}
    data, offs = flat(pa.array([t for t, _ in pairs], pa.string()))
    g = graph(data, offs, names, grow=True)
    y = np.zeros(len(g.doc), np.int64)
    for d, (text, spans) in enumerate(pairs):
        here = slice(*np.searchsorted(g.doc, [d, d + 1]))
        b = [(len(text[:lo].encode()) + offs[d], len(text[:hi].encode()) + offs[d], LABELS.index(k)) for lo, hi, k in spans]
        for i in range(here.start, here.stop):
            for lo, hi, k in b:
                if g.start[i] < hi and lo < g.end[i]:
                    y[i] = k
    one = np.eye(K)
    i, j, kind = g.edges.T
    w = [np.zeros((len(names), K)), np.zeros((K, K)), np.zeros((K, K)), np.zeros((K, K))]
    mom = [(np.zeros_like(x), np.zeros_like(x)) for x in w]
    around = [np.zeros((len(y), K)) for _ in range(4)]  # labels left, right, same, alike
    around[0] += g.left_free[:, None] * one[0]
    around[1] += g.right_free[:, None] * one[0]
    for t, (a, b) in enumerate(((0, 1), (2, 2), (3, 3))):
        x = kind == t
        np.add.at(around[a], j[x], one[y[i[x]]])
        np.add.at(around[b], i[x], one[y[j[x]]])
    per_node = np.searchsorted(g.rows, np.arange(len(y)))  # every node has features, entries are in node order
    by_name = np.argsort(g.cols, kind="stable")
    per_name, users = np.searchsorted(g.cols[by_name], np.arange(len(names))), g.rows[by_name]
    for step in range(1, steps + 1):
        logit = np.add.reduceat(w[0][g.cols], per_node)
        logit += around[0] @ w[1] + around[1] @ w[1].T + around[2] @ w[2] + around[3] @ w[3]
        p = np.exp(logit - logit.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        d = one[y] - p
        grad = [np.add.reduceat(d[users], per_name), around[0].T @ d + d.T @ around[1], around[2].T @ d, around[3].T @ d]
        for x in (2, 3):
            grad[x] = (grad[x] + grad[x].T) / 2
        for x in range(4):
            gr = grad[x] - 0.3 * w[x]
            m1, m2 = mom[x]
            m1 += 0.1 * (gr - m1)
            m2 += 0.01 * (gr * gr - m2)
            w[x] += 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return Model(names, *w)


def entities(m: Model, data: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int, str]]:
    """(text number, byte start, byte end, label) of the entities, in order."""
    g = graph(data, offs, m.names)
    label = infer(m, g)
    out: list[tuple[int, int, int, str]] = []
    for n in np.flatnonzero(label).tolist():
        s, e, k = int(g.start[n]), int(g.end[n]), LABELS[label[n]]
        lo, hi = core(data[s:e].tobytes())
        if hi <= lo:
            continue
        if out and k in ("PHONE", "CARD") and not g.left_free[n] and label[n - 1] == label[n] and out[-1][0] == g.doc[n] and (k == "PHONE" or hi - lo <= 4) and data[s] != 43:
            out[-1] = (*out[-1][:2], s + hi, k)
        else:
            out.append((int(g.doc[n]), s + lo, s + hi, k))
    return out


def _redacted(data: np.ndarray, offs: np.ndarray, found: list[tuple[int, int, int, str]]) -> pa.Array:
    raw, parts, at = data.tobytes(), [], 0
    grown = np.zeros(len(offs) - 1, np.int64)
    for d, s, e, k in found:
        mark = b"[%s]" % k.encode()
        parts += [raw[at:s], mark]
        grown[d] += len(mark) - (e - s)
        at = e
    parts.append(raw[at:])
    new = (offs + np.concatenate(([0], np.cumsum(grown)))).astype(np.int32)
    return pa.StringArray.from_buffers(len(offs) - 1, pa.py_buffer(new), pa.py_buffer(b"".join(parts)))


def _with_nulls(new: pa.Array, old: pa.Array) -> pa.Array:
    return pa.StringArray.from_buffers(len(new), new.buffers()[1], new.buffers()[2], pa.array(old.is_valid().to_numpy(zero_copy_only=False)).buffers()[1]) if old.null_count else new


def _redact_rows(shared, names: list[str]):
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        data, offs = flat(b.column("text"))
        text = _with_nulls(_redacted(data, offs, entities(shared.value, data, offs)), b.column("text"))
        return pa.RecordBatch.from_arrays([text if c == "text" else b.column(c) for c in names], names)

    return run


_SPANS = "array<struct<label:string,start:int,end:int>>"


def _report_rows(shared):
    kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        data, offs = flat(b.column("text"))
        found = entities(shared.value, data, offs)
        lists: list[list[dict]] = [[] for _ in range(b.num_rows)]
        if found:
            chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
            for d, s, e, k in found:
                lists[d].append({"label": k, "start": int(chars[s] - chars[offs[d]]), "end": int(chars[e] - chars[offs[d]])})
        text = _with_nulls(_redacted(data, offs, found), b.column("text"))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), text, pa.array([len(x) for x in lists], pa.int32()), pa.array(lists, kind)], ["doc_id", "text", "n_entities", "entities"])

    return run


@operator
def redact(docs: DataFrame) -> DataFrame:
    """docs with the entities of text replaced by their labels; n_chars, where there is one, is counted anew."""
    docs = docs.withColumn("text", F.col("text").cast("string"))
    out = map_text(docs, _redact_rows(docs.sparkSession.sparkContext.broadcast(train()), docs.columns), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


@operator
def pii_report(docs: DataFrame) -> DataFrame:
    """doc_id, redacted text, n_entities and entities (label, start and end in characters of the text before) of every row."""
    texts = docs.select(long("doc_id"), F.col("text").cast("string").alias("text"))
    return map_text(texts, _report_rows(docs.sparkSession.sparkContext.broadcast(train())), f"doc_id long, text string, n_entities int, entities {_SPANS}")
