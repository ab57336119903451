"""Tables, scratch space that all executors share, and files that appear whole and once."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path under spark.checkpoint.dir. Only a session of one machine may leave that unset, and gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_lexiforge_scratch", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = spark._lexiforge_scratch = tempfile.mkdtemp(prefix="lexiforge-")
        atexit.register(shutil.rmtree, base, True)
    return f"{base.rstrip('/')}/lexiforge-{what}-{uuid.uuid4().hex}"


class Files:
    """The files under a path, by names relative to it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def at(self, name: str = ""):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def names(self, folder: str) -> list[str]:
        fs, p = self.at(folder)
        return sorted(n for x in fs.listStatus(p) if not (n := x.getPath().getName()).startswith(".")) if fs.exists(p) else []

    def age(self, name: str, now: float) -> float:
        """Seconds since the file or folder was last changed."""
        fs, p = self.at(name)
        return now - fs.getFileStatus(p).getModificationTime() / 1000

    def read(self, name: str) -> str:
        fs, p = self.at(name)
        stream = fs.open(p)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def delete(self, name: str = "") -> None:
        fs, p = self.at(name)
        fs.delete(p, True)

    def create(self, name: str, content: str) -> bool:
        """Makes a file appear whole, unless there is one of the name: it is written under another one and renamed.

        The file system has to rename without overwriting, as HDFS and disks do.
        """
        fs, draft = self.at(f"drafts/{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(content.encode()))
        out.close()
        _, p = self.at(name)
        fs.mkdirs(p.getParent())
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
