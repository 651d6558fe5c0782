"""Files by name, through Hadoop's file systems: local paths and URIs of any store that Spark reaches, globs among them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(p)


def uri(spark: SparkSession, path: str) -> str:
    """The full URI of a path, as Spark's file sources name it."""
    return _fs(spark, path)[1].toString()


def found(spark: SparkSession, path: str) -> list[str]:
    """URIs of the files that a path or a glob names; none where there is no such file, or its store is not reached."""
    if not path.strip():
        return []
    try:
        fs, p = _fs(spark, path)
        if fs.exists(p):
            return [] if fs.getFileStatus(p).isDirectory() else [p.toString()]
        return [s.getPath().toString() for s in fs.globStatus(p) or () if not s.isDirectory()]
    except Exception:  # Java says in many ways that there is nothing: a wrong scheme, an unknown host, a bad glob
        return []


def folder_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def make_folder(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    fs.mkdirs(p)
    return p.toString()


def parent(spark: SparkSession, path: str) -> str:
    p = _fs(spark, path)[1].getParent()
    return path if p is None else p.toString()


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; in a local session under a temporary one
    where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is unset: it must name a folder that all executors reach")
        base = tempfile.mkdtemp(prefix="rasterflow-")
    return make_folder(spark, f"{base}/{name}-{uuid.uuid4().hex}")


def kept(df: DataFrame) -> DataFrame:
    """df as it is now, in the checkpoint folder, so that what it was read from may go."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession, "kept"))
    return df.checkpoint(eager=True)


def put(spark: SparkSession, path: str, data: bytes) -> str:
    """Writes bytes that the driver holds to a file that executors can read; returns its URI."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return p.toString()


def contents(spark: SparkSession, listed: DataFrame, uris: list[str]) -> DataFrame:
    """listed (pos, source, at) with content and length of the file at each URI; null where `at` is. Files that go between
    listing and reading are null too."""
    empty = listed.withColumns({"content": F.lit(None).cast("binary"), "length": F.lit(None).cast("long")})
    if not uris:
        return empty
    files = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load([escaped(u) for u in sorted(set(uris))]).select(plain("path").alias("_at"), "content", "length")
    return listed.join(files, plain("at") == F.col("_at"), "left").drop("_at")


def escaped(u: str) -> str:
    """A URI that names one file only, whatever signs of a glob its name has."""
    return "".join("\\" + c if c in "*?[]{}\\" else c for c in u)


def plain(column: str):
    """file:/a and file:///a are one file."""
    return F.regexp_replace(column, "^file:/+", "file:/")
