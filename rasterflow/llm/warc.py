"""WARC archives: writing, and a normaliser for files that are one gzip stream.

A crawl file that was compressed as a whole cannot be read from the middle. The normaliser inflates such a stream
once, from front to back, and rewrites every record as a gzip member of its own, so that each can be fetched by
offset; a sidecar index, one JSON object a line, says where. No more than one record is held at once. Files are
written under a temporary name and renamed, so a task that is run again replaces what a lost one left.

Folders are URIs that every executor reaches; they are opened through pyarrow's file systems.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot

#: Payloads below this are never revisits; bytes of records after which a writer begins a new file; keepers of
#: equal payloads that are broadcast at most, beyond which they are joined by a shuffle.
REVISIT_BYTES, FILE_BYTES, BROADCAST_ROWS = 1000, 64 << 20, 50_000
#: A stream that shows no end of a record's head for so long is damaged.
HEAD_BYTES = 4 << 20
_BLOCK = 1 << 18
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "archive string, offset long, length long, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, error string"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _attempt() -> str:
    return f".{TaskContext.get().taskAttemptId()}.part"


def record(kind: str, page: int | None, url: str | None, digest: str, size: int, refers: int | None, payload: bytes) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP head only; what its payload was is in its header fields."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    clean = "".join(c for c in url or "" if c > " ")
    head = {
        "WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {clean} {digest}')}>", "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": clean, "WARC-Payload-Digest": f"sha1:{digest}", "WARC-Profile": PROFILE if kind == "revisit" else "",
        "Page-ID": "" if page is None else str(page), "Payload-Length": str(size), "Refers-To-Page-ID": "" if refers is None else str(refers),
        "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block)),
    }
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items() if v).encode() + b"\r\n" + block + b"\r\n\r\n"


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k}


def decide(pages: DataFrame, least: int = REVISIT_BYTES, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) per row. Of rows with equal
    payloads of at least `least` bytes the largest page_id is the response and the others revisit it; rows that
    share that page_id are all responses, and a null page_id is a response unless another row keeps its payload. A null html
    is an empty payload. Further columns are left out, whatever their names; an empty table gives no rows."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    slim = slim.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    groups = slim.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
    keepers = cut(groups.filter("n > 1 AND keeper IS NOT NULL"))
    if keepers.count() <= BROADCAST_ROWS:
        joined = slim.join(F.broadcast(keepers.drop("n")), ["payload_digest"], "left")
    else:  # pages move once; a digest that many of them have is dealt over sub-keys
        joined = join_hot(slim, keepers, ["payload_digest"], "page_id", keepers.agg(F.sum("n")).first()[0], "left")
    again = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return joined.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("keeper")).alias("refers_to"))


def write_monolithic(decided: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write records into files that are one gzip stream each; returns (archive, records), written already. Every
    task writes its own files, a new one after file_bytes of records."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _open(folder)
        part, no, out = TaskContext.get().partitionId(), 0, None
        for b in batches:
            for row in b.itertuples(index=False):
                page, refers = (None if pd.isna(x) else int(x) for x in (row.page_id, row.refers_to))
                raw = record(row.record_type, page, row.url, row.payload_digest, row.payload_bytes, refers, row.payload)
                if out is None:
                    name, squeeze, size, n = f"{root}/whole-{part:05d}-{no:05d}.warc.gz", zlib.compressobj(6, wbits=31), 0, 0
                    out = store.open_output_stream(name + _attempt())
                out.write(squeeze.compress(raw))
                size, n = size + len(raw), n + 1
                if size >= file_bytes:
                    yield close(store, out, squeeze, name, n)
                    out, no = None, no + 1
        if out is not None:
            yield close(store, out, squeeze, name, n)

    def close(store, out, squeeze, name: str, n: int) -> pd.DataFrame:
        out.write(squeeze.flush())
        out.close()
        store.move(name + _attempt(), name)
        return pd.DataFrame({"archive": [name.rpartition("/")[2]], "records": [n]})

    _open(folder)[0].create_dir(_open(folder)[1], recursive=True)
    return cut(decided.mapInPandas(write, "archive string, records long"))


def inflate(source) -> Iterator[bytes]:
    """Blocks of a gzip stream, of one member or many."""
    push, begun = zlib.decompressobj(wbits=31), False
    while raw := source.read(_BLOCK):
        while raw:
            begun = True
            yield push.decompress(raw, 1 << 20)
            while push.unconsumed_tail:
                yield push.decompress(push.unconsumed_tail, 1 << 20)
            raw = push.unused_data
            if push.eof:
                push, begun = zlib.decompressobj(wbits=31), False
            else:
                break
    if begun:
        raise EOFError("the stream ends inside a member")


def records(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated stream; EOFError if it ends inside one."""
    held, need = bytearray(), None
    for block in blocks:
        held += block
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    if len(held) > HEAD_BYTES:
                        raise EOFError("no head of a record in sight")
                    break
                need = end + 4 + int(fields(bytes(held[:end])).get("content-length", "0")) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held.strip():
        raise EOFError("the stream ends inside a record")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """archives: (archive) names of files in folder. Rewrites each as one member a record, beside it under the name
    members-..., with a sidecar of the same name and .idx; returns the index, one row a record, written already.
    A stream that breaks off or is damaged keeps the records before that point, and its last index row has nulls
    and the error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _open(folder)
        for b in batches:
            for name in b["archive"]:
                target, rows, at = f"members-{name.removeprefix('whole-')}", [], 0
                path = f"{root}/{target}"
                with store.open_input_stream(f"{root}/{name}", compression=None) as source, store.open_output_stream(path + _attempt(), compression=None) as out:
                    try:
                        for raw in records(inflate(source)):
                            squeeze = zlib.compressobj(6, wbits=31)
                            member = squeeze.compress(raw) + squeeze.flush()
                            out.write(member)
                            f = fields(raw[: raw.find(b"\r\n\r\n")])
                            number = lambda k: int(f[k]) if f.get(k) else None  # noqa: B023, E731
                            rows.append((target, at, len(member), number("page-id"), f.get("warc-type"), number("payload-length"), f.get("warc-payload-digest", "").removeprefix("sha1:"), number("refers-to-page-id"), None))
                            at += len(member)
                    except (EOFError, zlib.error, ValueError) as e:
                        rows.append((target, at, None, None, None, None, None, None, str(e)))
                names = [c.split()[0] for c in INDEX.split(", ")]
                with store.open_output_stream(f"{path}.idx{_attempt()}") as side:
                    side.write("".join(json.dumps(dict(zip(names, r))) + "\n" for r in rows).encode())
                store.move(path + _attempt(), path)
                store.move(f"{path}.idx{_attempt()}", f"{path}.idx")
                frame = pd.DataFrame(rows, columns=names)
                yield frame.astype({c: "Int64" for c in ("offset", "length", "page_id", "payload_bytes", "refers_to")})

    names = archives.select("archive")
    return cut(names.repartition(max(1, min(4096, names.count()))).mapInPandas(run, INDEX))


def fetch(index: DataFrame, folder: str) -> DataFrame:
    """Read the records of an index back by offset: (page_id, payload_bytes, payload_digest, record_type, refers_to).
    A response's size and digest are taken from the payload itself, a revisit's from its fields."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _open(folder)
        for b in batches:
            out = []
            for archive, part in b.groupby("archive", sort=False):
                with store.open_input_file(f"{root}/{archive}") as source:
                    for offset, length in zip(part["offset"], part["length"]):
                        source.seek(int(offset))
                        raw = zlib.decompress(source.read(int(length)), wbits=31)
                        end = raw.find(b"\r\n\r\n")
                        f, block = fields(raw[:end]), raw[end + 4 : -4]
                        size, digest = int(f["payload-length"]), f["warc-payload-digest"].removeprefix("sha1:")
                        if f["warc-type"] == "response":
                            payload = block[block.find(b"\r\n\r\n") + 4 :]
                            size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                        out.append((int(f["page-id"]) if f.get("page-id") else None, size, digest, f["warc-type"], int(f["refers-to-page-id"]) if f.get("refers-to-page-id") else None))
            yield pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]).astype({"page_id": "Int64", "refers_to": "Int64"})

    return index.filter("error IS NULL").select("archive", "offset", "length").mapInPandas(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_round_trip(pages: DataFrame, folder: str, **columns: str) -> DataFrame:
    """Write pages as monolithic archives in folder, normalise them, and read every record back by its index: one row per
    page, null and repeated ones too, as decide() has them; none, and no archive, for an empty table."""
    index = normalise(write_monolithic(decide(pages, **columns), folder), folder)
    return cut(fetch(index, folder))


def remove(folder: str) -> None:
    store, root = _open(folder)
    store.delete_dir(root)
