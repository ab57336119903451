"""Operator 6, token counts: rollups kept up to date by signed deltas, in batches that are committed once.

Method: a change is a signed row (source, lang, tokenizer_version, docs, tokens): +1 and +n for an inserted document, -1
and -n for a deleted one, 0 and the difference for a revised count (or a -1 row and a +1 row where the group changes).
A batch's rows are added up by group and written to a directory of its own; a marker file commits it. The marker is
written under another name, with the directory's name in it, and then renamed, which fails if it is there: so it
is there whole or not at all, and only once. Totals are sums over committed batches only, so that a batch interrupted
at any point leaves no trace, and can be delivered again, and one that is delivered again changes nothing.

compact() folds the batches committed so far into one part. It takes one list of markers, reads their parts, and names
in its own record, which is renamed into place in the same way, the ids whose parts it read; what was committed
in between stays a batch of its own. commit() compacts when FOLD batches wait, so that readers open few files. vacuum()
deletes parts that no total reads. The path's file system has to rename without overwriting (HDFS, or a disk).

Tokenizer versions: the regular expressions in COUNTS, evaluated in the JVM, and any rank file of byte-pair encoding
(bpe_counts), whose tokens are those of operator 5.

Defined cases: null sources and languages form groups of their own; a null or empty text counts one document and 0
tokens. A row with a null doc_id is a document. Repeated rows are documents each. Groups whose documents and tokens have
both come back to 0 are left out of the totals. No batch gives empty totals. A null text is no copy of another. Further
columns are ignored.
"""

from __future__ import annotations

import time
import uuid

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.base import kept, map_text, operator, scratch
from lexiforge.llm.bpe import CHUNK, coder, encode, worker_memo
from lexiforge.llm.textops import flat

GROUP = ("source", "lang", "tokenizer_version")
SCHEMA = "source string, lang string, tokenizer_version string, docs long, tokens long"

#: Batches that wait before commit() compacts them.
FOLD = 64

#: Built-in tokenizers by version: runs of other than white space; and runs of letters or digits, and marks.
COUNTS = {"words-v1": r"\S+", "marks-v1": r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"}


def token_count(text: Column, version: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(COUNTS[version])), F.lit(0)).cast("long")


def inserted(rows: DataFrame, tokens: str = "tokens") -> DataFrame:
    return rows.select(*GROUP, F.lit(1).cast("long").alias("docs"), F.col(tokens).cast("long").alias("tokens"))


def deleted(rows: DataFrame, tokens: str = "tokens") -> DataFrame:
    return rows.select(*GROUP, F.lit(-1).cast("long").alias("docs"), (-F.col(tokens)).cast("long").alias("tokens"))


def revised(rows: DataFrame, before: str, after: str) -> DataFrame:
    return rows.select(*GROUP, F.lit(0).cast("long").alias("docs"), (F.col(after) - F.col(before)).cast("long").alias("tokens"))


class Rollup:
    """Totals under a path in storage that all executors share."""

    def __init__(self, spark: SparkSession, path: str, fold: int = FOLD):
        self.spark, self.path, self.fold = spark, path.rstrip("/"), fold

    def _at(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._at(folder)
        return sorted(n for x in fs.listStatus(p) if not (n := x.getPath().getName()).startswith(".")) if fs.exists(p) else []

    def committed(self) -> list[str]:
        """The ids of the committed batches, those that were compacted included."""
        return self._names("commits")

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Adds the signed rows of a batch; False, without any effect, if that batch was committed before.

        Writers of the same batch write directories of their own; the marker that is renamed into place first names
        the directory that counts. batch_id: letters, digits, - and _.
        """
        fs, p = self._at(f"commits/{batch_id}")
        if fs.exists(p):
            return False
        part = uuid.uuid4().hex
        self._write(changes.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")), part)
        done = self._mark(f"commits/{batch_id}", part)
        if done and len(self._state()[1]) >= self.fold:
            self.compact()
        return done

    def _write(self, sums: DataFrame, part: str) -> None:
        sums.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/deltas/{part}")

    def _mark(self, name: str, content: str) -> bool:
        """Makes a file appear whole, unless there is one of the name."""
        fs, draft = self._at(f"drafts/{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(content.encode()))
        out.close()
        _, p = self._at(name)
        fs.mkdirs(p.getParent())
        if fs.exists(p):
            fs.delete(draft, False)
            return False
        jvm = self.spark._jvm
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, p, options)
        except Py4JJavaError:
            if not fs.exists(p):
                raise
            fs.delete(draft, False)
            return False
        return True

    def _read(self, name: str) -> str:
        fs, p = self._at(name)
        stream = fs.open(p)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _state(self) -> tuple[int, dict[str, str], list[str], str | None]:
        """The number of the next compaction, the parts of the batches that wait by id, the ids that were folded, and their part."""
        folds = self._names("compactions")
        base, *folded = self._read(f"compactions/{folds[-1]}").split("\n") if folds else (None,)
        had = set(folded)
        waiting = {b: self._read(f"commits/{b}") for b in self.committed() if b not in had}
        return int(folds[-1]) + 1 if folds else 0, waiting, folded, base

    def _sum(self, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/deltas/{p}" for p in parts])
        return rows.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, docs and tokens over the committed batches."""
        _, waiting, _, base = self._state()
        return self._sum([*([base] if base else []), *waiting.values()])

    def compact(self) -> bool:
        """Folds the batches committed so far into one part; readers and other commits go on. False if another did it meanwhile."""
        n, waiting, folded, base = self._state()
        if not waiting:
            return False
        part = uuid.uuid4().hex
        self._write(self._sum([*([base] if base else []), *waiting.values()]), part)
        return self._mark(f"compactions/{n:09d}", "\n".join([part, *folded, *waiting]))

    def vacuum(self, older_than: float = 86_400) -> int:
        """Deletes parts that no total reads and drafts, of at least that age in seconds; how many."""
        _, waiting, _, base = self._state()
        live, n = {base, *waiting.values()}, 0
        for folder in ("deltas", "drafts"):
            for name in self._names(folder):
                fs, p = self._at(f"{folder}/{name}")
                if name not in live and fs.getFileStatus(p).getModificationTime() <= (time.time() - older_than) * 1000:
                    n += fs.delete(p, True)
        return n


def regex_counts(docs: DataFrame) -> DataFrame:
    """docs, with counts: an array of (tokenizer_version, tokens, revised) by COUNTS; revised leaves out repeated lines."""
    lines = F.split("text", "\n")
    once = F.array_distinct(lines)
    docs = docs.select("*", F.struct(*[token_count(F.col("text"), v).alias(v) for v in COUNTS]).alias("_n"), F.when(F.size(once) < F.size(lines), F.array_join(once, "\n")).alias("_once"))
    revised = lambda v: F.when(F.col("_once").isNull(), F.col("_n")[v]).otherwise(token_count(F.col("_once"), v))
    each = [F.struct(F.lit(v).alias("tokenizer_version"), F.col("_n")[v].alias("tokens"), revised(v).alias("revised")) for v in COUNTS]
    return docs.select(*[c for c in docs.columns if not c.startswith("_")], F.array(*each).alias("counts"))


def bpe_counts(docs: DataFrame, versions: dict[str, str]) -> DataFrame:
    """The same by byte-pair encoding; versions: rank files by tokenizer version."""
    shared = [(name, coder(docs, path)) for name, path in versions.items()]
    names = docs.columns

    def once(t: str | None) -> str | None:
        lines = t.split("\n") if t else []
        return "\n".join(dict.fromkeys(lines)) if len(set(lines)) < len(lines) else t

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        new = pa.array(map(once, b.column("text").to_pylist()), pa.string())
        both = [flat(b.column("text")), flat(new)]
        rows = [[] for _ in range(b.num_rows)]
        for name, v in shared:
            n, m = (np.diff(encode(v.value, *x, worker_memo(v.value))[1]).tolist() for x in both)
            for r, x, y in zip(rows, n, m):
                r.append({"tokenizer_version": name, "tokens": x, "revised": y})
        kind = pa.list_(pa.struct([("tokenizer_version", pa.string()), ("tokens", pa.int64()), ("revised", pa.int64())]))
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, kind)], [*names, "counts"])

    schema = docs.withColumn("counts", F.lit(None).cast("array<struct<tokenizer_version:string,tokens:bigint,revised:bigint>>")).schema
    return map_text(docs, run, schema, CHUNK)


@operator
def corpus_rollup(docs: DataFrame, bpe: dict[str, str] | None = None) -> DataFrame:
    """Totals after four deliveries: all documents inserted; later exact copies deleted, twice; counts of the rest revised.

    The revised count of a document leaves out its repeated lines. The second delivery of the deletions has no effect.
    bpe: rank files by tokenizer version, to count by in place of the regular expressions. The copy that stays is the
    first by (doc_id, source, lang). It is the minimum of a partial aggregation; the deletions are all copies, negative,
    and the ones that stay, positive, so that no group of copies is gathered or sorted anywhere.
    """
    rows = docs.select("doc_id", "source", "lang", F.col("text").cast("string").alias("text"))
    counted = bpe_counts(rows, bpe) if bpe else regex_counts(rows)
    counted = kept(counted.select("doc_id", "source", "lang", F.when(F.col("text").isNotNull(), F.struct(F.md5(F.encode("text", "utf-8")).alias("m"), F.length("text").alias("n"))).alias("same"), "counts"))
    flat_ = counted.select("source", "lang", F.inline("counts"))
    copies = counted.where("same is not null")
    first = kept(copies.groupBy("same").agg(F.min(F.struct("doc_id", "source", "lang", "counts")).alias("first")).select("first.*").select("source", "lang", F.inline("counts")))
    gone = deleted(copies.select("source", "lang", F.inline("counts"))).unionByName(inserted(first))
    store = Rollup(docs.sparkSession, scratch(docs.sparkSession, "rollup"))
    store.commit("insert-1", inserted(flat_))
    store.commit("delete-1", gone)
    store.commit("delete-1", gone)
    store.commit("revise-1", revised(first.where("tokens <> revised"), "tokens", "revised"))
    first.unpersist(), counted.unpersist()
    return store.totals()


ORACLE = """
with v as (select * from (values ('words-v1', '\\S+'), ('marks-v1', '[\\p{L}\\p{N}]+|[^\\s\\p{L}\\p{N}]')) v(tokenizer_version, p)),
c as (select doc_id, source, lang, text, tokenizer_version, coalesce(len(regexp_extract_all(text, p)), 0) tokens,
             coalesce(len(regexp_extract_all(array_to_string(list_distinct(string_split(text, chr(10))), chr(10)), p)), 0) revised from documents, v),
r as (select *, row_number() over (partition by tokenizer_version, text order by doc_id, source, lang) i from c)
select source, lang, tokenizer_version, cast(count(*) filter (where i = 1 or text is null) as bigint) as docs,
       cast(coalesce(sum(case when text is null then tokens else revised end) filter (where i = 1 or text is null), 0) as bigint) as tokens
from r group by 1, 2, 3 having count(*) filter (where i = 1 or text is null) > 0 or tokens <> 0
"""
