"""What several corpus operators share: cutting lineage, joins with hot keys, components of a link table, small
union-find."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it. Where that is unset a temporary one
    is made, but only in a local session, whose executors are the driver itself; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is unset: it must name a folder that all executors reach")
        found = tempfile.mkdtemp(prefix="rasterflow-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder, so that later steps neither recompute it nor depend on an executor."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def drop_folder(spark: SparkSession, uri: str) -> None:
    """Delete a folder through Hadoop's file systems, so wherever Spark can write."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spare_name(df: DataFrame, name: str) -> str:
    """name, with underscores behind it as long as df has a column that Spark takes for the same."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column_of(batches: Iterator[pa.RecordBatch], name: str, rows: int = 512) -> Iterator:
    """The values of one column of Arrow batches, one by one; only a few hundred rows are Python objects at once."""
    for b in batches:
        values = b.column(name)
        for at in range(0, len(values), rows):
            yield from values.slice(at, rows).to_pylist()


#: A key is hot from more than 1/HOT of the rows on, and is then dealt over SALT sub-keys.
HOT, SALT = 1024, 64


def join_hot(rows: DataFrame, keyed: DataFrame, on: list[str], spread: str, total: int, how: str = "inner", hot: int = HOT, salt: int = SALT) -> DataFrame:
    """rows joined to keyed, which has one row per key and, as n, how many of the `total` rows have that key. Keys with
    more than 1/hot of them are at most `hot` many, so the list of them is broadcast; each is dealt over sub-keys by a
    hash of the column `spread`, as no single task could hold it. All other keys are joined as they are."""
    is_hot = F.col("n") * hot > total
    listed = F.broadcast(keyed.filter(is_hot).select(*on, F.lit(True).alias("_hot")))
    key = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salt)).cast("int")).otherwise(F.lit(0))
    dealt = rows.join(listed, on, "left").withColumn("_salt", key).drop("_hot")
    copies = F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salt - 1))).otherwise(F.array(F.lit(0))))
    return dealt.join(keyed.withColumn("_salt", copies).drop("n"), [*on, "_salt"], how).drop("_salt")


class Forest:
    """Union-find over 0..n-1 on arrays; the root of a set is its smallest member."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.up[a], self.up[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.up, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                nxt = self.up[self.up]
                if np.array_equal(nxt, self.up):
                    break
                self.up = nxt

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        own = np.arange(len(self.up))
        low = self.up < own
        return own[low], self.up[low]


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """Connected components of links (a long, b long): one row (node, root) per node that has a link, root
    being the component's smallest node. Alternates the large-star and small-star steps until the edges stand
    still; every round is a pair of aggregations, none gathers a node's neighbours in one place, and the centre of
    a large star is dealt over sub-keys. Self-links and null ends are ignored; an empty input gives an empty result."""

    def star(e: DataFrame, both: bool, total: int) -> DataFrame:
        # each node's neighbours move to the smallest among the node and them
        hop = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if both:
            hop = hop.union(hop.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = hop.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        moved = join_hot(hop, low, ["u"], "v", total)
        if both:
            moved = moved.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            moved = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return moved.filter("a <> b").distinct()

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()

    links = links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = mark(edges)
    for _ in range(most if seen[0] else 0):
        edges = cut(star(star(edges, True, 2 * seen[0]), False, 2 * seen[0]))
        now = mark(edges)
        if now == seen:
            break
        seen = now
    else:
        if seen[0]:
            raise RuntimeError(f"components did not settle in {most} rounds")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
