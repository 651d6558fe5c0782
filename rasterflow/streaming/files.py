"""A stream of image files: each new file goes through the plan once, whole."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.errors import ImageError
from ..operators import batch
from ..plans import ops as plan

SCHEMA = "path string, modificationTime timestamp, length long, content binary"
#: What a stream's plan may hold, and how each is made from its arguments.
MAKERS = {
    "resize": lambda o: plan.resize(o.get("width"), o.get("height"), o.get("fit", "inside")), "rotate": lambda o: plan.rotate(o.get("degrees")),
    "flipH": lambda o: plan.Op("flip_h"), "flipV": lambda o: plan.Op("flip_v"), "grayscale": lambda o: plan.Op("grayscale"),
}


def stream_plan(ops: list[dict]) -> tuple[tuple[plan.Op, ...], bool]:
    """Operations and whether images are turned upright."""
    out, orient = [], True
    for o in ops:
        if o["op"] == "autoOrient":
            orient = bool(o.get("enabled", True))
        elif o["op"] in MAKERS:
            out.append(MAKERS[o["op"]](o))
        else:
            raise ImageError("E400", f"unknown operation {o['op']!r}")
    return tuple(out), orient


#: Tasks that list a batch's files, of which Spark starts one for each of the first 10,000 names, and what opening a file counts
#: for when files are dealt out: small images go several hundred to a task, large ones by their bytes as ever.
LISTING_TASKS, OPEN_BYTES = 64, 1 << 18
#: Files of a batch. Spark's source of files holds those of a batch in the driver, and the names of all that its folder has; so
#: what writes many files deals them to folders of about as many each, which start_each takes up one after another.
BATCH_FILES = 20_000


def session(spark: SparkSession) -> SparkSession:
    """A session with the settings of the given one, and the above; lists of files, of which none is read twice, are not kept."""
    own = spark.newSession()
    told = {k: v for k, v in spark.conf.getAll.items() if spark.conf.isModifiable(k)}
    ours = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": str(LISTING_TASKS), "spark.sql.files.openCostInBytes": str(OPEN_BYTES), "spark.sql.hive.filesourcePartitionFileCacheSize": "0"}
    for k, v in (told | ours).items():
        own.conf.set(k, v)
    return own


def start(spark: SparkSession, folder: str, out_table: str, checkpoint: str, fmt: str = "png", ops: list[dict] | None = None, glob: str = "*") -> StreamingQuery:
    """Appends (source, output, code, message) of every file in folder to the Parquet folder out_table; files that fail
    are rows with a code. Takes what is there, in batches of BATCH_FILES, and ends."""
    return _start(session(spark), folder, out_table, checkpoint, fmt, ops, glob)


def start_each(spark: SparkSession, folders: Iterable[str], out_table: str, checkpoint: str, fmt: str = "png", ops: list[dict] | None = None, glob: str = "*") -> None:
    """The same of each of the folders, to out_table/folder=0 and so on, when this returns: the driver holds the names of one
    folder's files at a time."""
    own = session(spark)
    for k, folder in enumerate(folders):
        _start(own, folder, f"{out_table}/folder={k}", f"{checkpoint}/{k}", fmt, ops, glob).awaitTermination()


def _start(own: SparkSession, folder: str, out_table: str, checkpoint: str, fmt: str, ops: list[dict] | None, glob: str) -> StreamingQuery:
    queue, orient = stream_plan(ops or [])
    files = own.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", glob).option("maxFilesPerTrigger", BATCH_FILES).load(folder)

    def write(df: DataFrame, epoch: int) -> None:
        rows = df.select(F.xxhash64("path").alias("pos"), F.col("path").alias("source"), F.col("path").alias("at"), "content")
        done = batch.process(rows, queue, fmt, auto_orient=orient)
        done.select("source", "output", "code", "message").write.mode("overwrite").parquet(f"{out_table}/epoch={epoch}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
