"""Documents with every oddity the operators have to stand."""

import ast
import os
import re

from pyspark.sql import types as T

from lexiforge import llm

REQUIRED = {"doc_id", "text", "lang", "source", "n_chars"}


def inner_names() -> list[str]:
    """Every name that stands in a string of the operators' sources, so all they could use for columns of their own."""
    folder, found = os.path.dirname(llm.__file__), set()
    for name in sorted(os.listdir(folder)):
        if name.endswith(".py") and name not in ("queries.py", "__init__.py"):
            with open(os.path.join(folder, name)) as f:
                tree = ast.parse(f.read())
            prose = {id(n.value) for n in ast.walk(tree) if isinstance(n, ast.Expr)}
            for node in ast.walk(tree):
                if isinstance(node, ast.Constant) and isinstance(node.value, str) and id(node) not in prose and re.fullmatch(r"[a-z_]\w*( \w+(<.*>)?(, \w+ .*)?)?", node.value):
                    found |= {x.split()[0] for x in node.value.split(", ")}
    return sorted({x.lower() for x in found if len(x) < 16} - REQUIRED)


#: Names that the operators use inside, as further columns of their input.
CLASHING = inner_names()
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in CLASHING]
)
WORDS = "the of and to in is that for it was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", "ing", "ed", "s"]) + str(r.randint(0, 9)) * (r.random() < 0.02) for _ in range(n))


def row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, None if text is None else len(text), *["x"] * len(CLASHING))


def messy():
    long_text = prose(1, 40_000)
    base = prose(2, 300)
    near = base.replace(" the ", " a ", 2)
    return [
        row(1, base), row(2, base), row(2, base), row(3, near), row(4, ""), row(5, None), row(None, base), row(None, None), row(6, "one"),
        row(7, long_text), row(8, "   \n\t "), row(9, "!!! ??? ..."), row(10, "Mail to anna.b@mail.org or +1 (212) 555-7788."), row(11, base + " " + prose(3, 80), None, None),
        row(12, "é😀 ü　x"), row(13, "one"), row(14, "one", "fr"),
    ]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)
