"""Spark helpers that the corpus operators share: shared-folder tables, size-checked joins, batches of bounded size."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import wraps

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most keys that are broadcast; a longer list is joined by shuffling.
BROADCAST_KEYS = 1_000_000
#: Bytes of text handled in one numpy step (one longer text is a step of its own).
CHUNK_BYTES = 1 << 19
#: Bounds of the batches that go to Python and back, and of those that come from Parquet, in an operator's own jobs: rows hold whole texts.
BATCH = {"spark.sql.parquet.columnarReaderBatchSize": "512", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def operator(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Runs an operator's own jobs in a clone of the caller's session that has BATCH set; its result belongs to the caller's.

    The caller's settings stay as they are, and hold where the result is computed.
    """

    @wraps(fn)
    def run(*args, **named):
        frames = [x for x in (*args, *named.values()) if isinstance(x, DataFrame)]
        outer = frames[0].sparkSession
        if getattr(outer, "_lexiforge_inner", False):
            return fn(*args, **named)
        inner = _small_batches(outer)
        move = lambda x: _in_session(x, inner) if isinstance(x, DataFrame) else x
        out = fn(*map(move, args), **{k: move(x) for k, x in named.items()})
        return _in_session(out, outer)

    return run


def _small_batches(outer: SparkSession) -> SparkSession:
    inner = SparkSession(outer.sparkContext, outer._jsparkSession.cloneSession())
    inner._lexiforge_inner, inner._lexiforge_dir = True, shared_dir(outer)
    for key, most in BATCH.items():
        inner.conf.set(key, most)
    return inner


def bounded(df: DataFrame) -> DataFrame:
    """df in a clone of its session that has BATCH set, and so all that operators make of it, their results included."""
    return df if getattr(df.sparkSession, "_lexiforge_inner", False) else _in_session(df, _small_batches(df.sparkSession))


def _in_session(df: DataFrame, session: SparkSession) -> DataFrame:
    plan = df._jdf.queryExecution().analyzed()
    return DataFrame(session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, plan), session)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, spark.checkpoint.dir. Only a session of one machine may leave it unset, and gets a temporary one."""
    there = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_lexiforge_dir", None)
    if not there:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        there = tempfile.mkdtemp(prefix="lexiforge-")
        spark._lexiforge_dir = there
        atexit.register(shutil.rmtree, there, True)
    return there.rstrip("/")


def _folder(spark: SparkSession) -> str:
    """The application's own folder there; it goes when the driver ends, or by clean()."""
    path = f"{shared_dir(spark)}/lexiforge-{spark.sparkContext.applicationId}"
    if path not in _folders:
        if not _folders:  # now that the JVM runs, so that this comes before its end
            atexit.register(clean)
        _folders[path] = spark
    return path


_folders: dict[str, SparkSession] = {}


def clean() -> None:
    """Deletes every table that saved() left for results, in all sessions of this process."""
    while _folders:
        path, spark = _folders.popitem()
        try:
            _delete(spark, path)
        except Exception:  # the session has ended, and its JVM with it
            shutil.rmtree(path.removeprefix("file://"), True)


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the application's folder."""
    return f"{_folder(spark)}/{what}-{uuid.uuid4().hex}"


def saved(df: DataFrame, what: str = "part") -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage is cut, and any executor can read it.

    discard() deletes it; what a result still reads stays until the driver ends.
    """
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexiforge_path = path
    return out


def kept(df: DataFrame) -> DataFrame:
    """df persisted on the executors' disks, for a table that is read again within one operator and then unpersisted.

    What a lost executor held is computed again from the input. It costs no files in the shared folder.
    """
    return df.persist(StorageLevel.DISK_ONLY)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(*dfs: DataFrame) -> None:
    """Deletes the files of tables from saved() that no result reads any more."""
    for df in dfs:
        path = getattr(df, "_lexiforge_path", None)
        if path:
            _delete(df.sparkSession, path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores behind it until no column of df is called so, in any case."""
    had, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in had:
            name += "_"
        had.add(name.lower())
        out.append(name)
    return out


def by_keys(df: DataFrame, on: str | Sequence[Column], keys: DataFrame, keep: bool, limit: int = BROADCAST_KEYS) -> DataFrame:
    """Rows of df whose key is (keep) or is not (not keep) in the table keys, which should be saved().

    on: a column of df, or expressions over df for the columns of keys, in order. The keys are counted; up to `limit` of
    them are broadcast, so that the wide rows of df stay where they are; beyond that both sides are shuffled. A null
    key is in no list.
    """
    exprs = [df[on]] if isinstance(on, str) else list(on)
    names = unused(df, *[f"_key{i}" for i in range(len(exprs))])
    keys = keys.toDF(*names)
    keys = F.broadcast(keys) if keys.count() * len(exprs) <= limit else keys.hint("shuffle_merge")
    same = [e == keys[n] for e, n in zip(exprs, names)]
    return df.join(keys, same, "left_semi" if keep else "left_anti")


def with_small(df: DataFrame, key: str, right: DataFrame, how: str = "left", limit: int = BROADCAST_KEYS // 2) -> DataFrame:
    """df joined on key with a saved() table, which is broadcast only if it has few rows."""
    return df.join(F.broadcast(right) if right.count() <= limit else right, key, how)


def text_chunks(batches: Iterable[pa.RecordBatch], col: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most `most` bytes of text each, or one row."""
    import numpy as np

    for b in batches:
        lens = np.diff(_offsets(b.column(col)))
        ends, at = np.cumsum(lens), 0
        while at < b.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield b.slice(at, to - at)
            at = to


def _offsets(arr: pa.Array):
    import numpy as np

    kind = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    if len(arr) == 0 or arr.buffers()[1] is None:
        return np.zeros(len(arr) + 1, np.int64)
    return np.frombuffer(arr.buffers()[1], kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow; memory that Arrow and the C library keep goes back after each task, since workers stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim is not None:
                trim(0)

    return df.mapInArrow(run, schema)


def map_text(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema, most: int = CHUNK_BYTES) -> DataFrame:
    """map_arrow of fn over slices of bounded text size; df has a column `text`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, most=most):
            out = fn(b)
            if out is not None and out.num_rows:
                yield out

    return map_arrow(df, run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long(c: str) -> Column:
    """A column of whole numbers; what is none counts as null."""
    return F.col(c).try_cast("long").alias(c)
