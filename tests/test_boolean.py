import random

import pytest

from lexiforge.errors import QuerySyntax
from lexiforge.plans.boolean import All, Any_, Not, Term, compiled, parse, positive_terms, tokens


def kinds(q):
    return [("!" * t.negated) + t.kind + (f":{t.value}" if t.value else "") for t in tokens(q)]


@pytest.mark.parametrize("query,want", [
    ("john", ["has:john"]), ("=John", ["exact:John"]), ("^John", ["prefix:John"]), ("Doe$", ["suffix:Doe"]), ("'Man", ["include:Man"]),
    ("!banned", ["!has:banned"]), ("!^old", ["!prefix:old"]), ("!fiction$", ["!suffix:fiction"]), ("!=x", ["!exact:x"]), ("!'x", ["!include:x"]),
    ("john | jane", ["has:john", "|", "has:jane"]), ("(john)", ["(", "has:john", ")"]), ('"hello world"', ["has:hello world"]),
    ("=John ^Doe !banned 'admin", ["exact:John", "prefix:Doe", "!has:banned", "include:admin"]), ("john!banned", ["has:john", "!has:banned"]),
    ("", []), ("   ", []), ("a !", ["has:a"]), ("!!x", ["!has:x"]), ("^x$", ["prefix:x$"]), ("$ = ^ '", []), ('!"a b"', ['!has:"a', 'has:b"']),
])
def test_tokens(query, want):
    assert kinds(query) == want


@pytest.mark.parametrize("query,reason", [
    ('"open', "open_quote"), ("!(a b)", "negated_group"), ("(a", "unbalanced"), ("a)", "unbalanced"), ("", "empty"), ("a |", "empty"), ("| a", "empty"), ("()", "empty"),
    (" ".join("x" * 32), "token_limit"), ("(" * 17 + "x", "depth_limit"),
])
def test_errors(query, reason):
    with pytest.raises(QuerySyntax) as e:
        parse(tokens(query))
    assert e.value.reason == reason and e.value.to_dict()["context"]["reason"] == reason


def test_trees():
    t = lambda v: Term("has", v)
    assert parse(tokens("a b | c")) == Any_((All((t("a"), t("b"))), t("c")))
    assert parse(tokens("admin (john | jane)")) == All((t("admin"), Any_((t("john"), t("jane")))))
    assert parse(tokens("((((deep))))"), 4) == t("deep") and len(tokens(" ".join("x" * 31))) == 31
    with pytest.raises(QuerySyntax):
        parse(tokens("((((deep))))"), 3)
    tree = parse(tokens("a !b (c | !d)"))
    assert positive_terms(tree) == ["a", "c"] and tree.depth() == 4 and parse(tokens("!b")) == Not(t("b"))


def test_only_syntax_errors_escape():
    r = random.Random(0)
    for _ in range(2000):
        q = "".join(r.choice("abc |()!=^$'\"xyz") for _ in range(r.randint(0, 60)))
        try:
            parse(tokens(q))
        except QuerySyntax:
            pass


def test_predicates(spark):
    rows = [("John Doe", "a"), ("john", None), ("Jane Doe", "john"), (None, None), ("100% _x", "b")]
    df = spark.createDataFrame(rows, "n string, m string")
    ids = lambda q, c: [r["n"] for r in df.where(compiled(q, c)).collect()]
    assert ids("=john", ["n"]) == ["john"] and ids("^j doe$", ["n"]) == ["John Doe", "Jane Doe"]
    assert ids("john", ["n", "m"]) == ["John Doe", "john", "Jane Doe"]
    assert ids("!doe", ["n"]) == ["john", "100% _x"]
    assert ids("!doe", ["n", "m"]) == ["100% _x"]
    assert ids("%", ["n"]) == ["100% _x"] and ids("'_", ["n"]) == ["100% _x"]
