"""A sink of files: every row is one file with a name of its own, and either all files of a job appear or none.

Tasks write beside the targets, under names that no reader takes for an output; the driver renames what the successful
attempts wrote once all tasks are done, and takes everything away if the job fails. So a retried or speculative task
leaves nothing behind, and an action that runs once writes once. Reports, one line a row, go to a folder of their own, a file
for each attempt, whose name is all that the driver is told; it reads them line by line, so it holds no list of the outputs.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from . import files

SCHEMA = "pos long, source string, outputPath string, output binary, code string, message string"
REPORT = "pos long, source string, outputPath string, bytes long, code string, message string"


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it, as Python's workers reach it."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(quote(uri, safe=":/@?&=%"))


@dataclass
class Written(WriterCommitMessage):
    report: str


class Writer(DataSourceWriter):
    def __init__(self, folder: str, reports: str):
        self.part, self.reports = f"_part-{uuid.uuid4().hex}", reports
        self.folder = folder

    def write(self, rows: Iterator) -> Written:
        # under a name that Spark's readers pass over, until the attempt is known to be the one that counts
        done = Written(f"_{uuid.uuid4().hex}.json")
        reports, told = store(f"{self.reports}/{done.report}")
        with reports.open_output_stream(told) as report:
            for r in rows:
                code, message, n, moved = r.code, r.message, None, None
                if code is None:
                    fs, path = store(r.outputPath)
                    at, _, name = path.rpartition("/")
                    # the attempt's own name: another attempt of this task never writes to it
                    part = f"{at}/{self.part}.{uuid.uuid4().hex}"
                    try:
                        with fs.open_output_stream(part) as out:
                            out.write(bytes(r.output))
                        n = len(r.output)
                        moved = f"{r.outputPath.rpartition('/')[0]}/{part.rpartition('/')[2]}"
                    except OSError as e:
                        code, message = "E301", str(e)
                row = {"pos": r.pos, "source": r.source, "outputPath": r.outputPath if code is None else None, "bytes": n, "code": code, "message": message, "part": moved}
                report.write(f"{json.dumps(row)}\n".encode())
        return done

    def told(self, report: str) -> Iterator[dict]:
        """The lines of a report; of an attempt that was killed, those that are whole."""
        fs, path = store(f"{self.reports}/{report}")
        with io.TextIOWrapper(fs.open_input_stream(path), encoding="utf-8") as lines:
            for line in lines:
                if line.endswith("\n"):
                    yield json.loads(line)

    def commit(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m:
                for r in self.told(m.report):
                    if r["part"]:
                        fs, path = store(r["part"])
                        fs.move(path, store(r["outputPath"])[1])
                fs, path = store(f"{self.reports}/{m.report}")
                fs.move(path, store(f"{self.reports}/{m.report[1:]}")[1])

    def abort(self, messages: list[Written | None]) -> None:
        fs, path = store(self.reports)
        attempts = (i.base_name for i in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if i.base_name.startswith("_"))
        for folder in {r["part"].rpartition("/")[0] for a in attempts for r in self.told(a) if r["part"]} | {self.folder}:
            fs, path = store(folder)
            for info in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
                if info.base_name.startswith(self.part):
                    fs.delete_file(info.path)


class FileSink(DataSource):
    """Options: path, the folder of the outputs; reports, the folder of the reports. Rows have SCHEMA."""

    @classmethod
    def name(cls) -> str:
        return "image_files"

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], self.options["reports"])


def write_files(rows: DataFrame, folder: str, local: bool = False) -> DataFrame:
    """Writes rows (SCHEMA) now, once; returns what came of them (REPORT). outputPath is a full URI; rows with a code, which
    failed before, are reported and write nothing. local: paths are reported without the scheme of local files."""
    spark = rows.sparkSession
    spark.dataSource.register(FileSink)
    reports = files.shared_folder(spark, "reports")
    try:
        rows.select(*(c.split()[0] for c in SCHEMA.split(", "))).write.format("image_files").mode("append").option("path", folder).option("reports", reports).save()
        told = spark.read.schema(REPORT).json(reports)
        if local:
            told = told.withColumn("outputPath", F.regexp_replace("outputPath", "^file:/+", "/"))
        return files.kept(told)
    finally:
        files.remove(spark, reports)
