"""WARC archives with an index, and coalesced byte-range reads.

Writing gives one archive per partition and one index row per record: file,
offset, length, URL and digest. Reading starts from the index: the selected
records are sorted by place, ranges that lie close together are read at once,
and each record is cut out of its range.

Of records with equal payloads of at least ``revisit_bytes`` bytes, the one with
the largest id holds the payload; the others revisit it and hold headers only.

Defined results: null html is an empty payload; a null url is written empty; a
row with a null id counts as the smallest of its group. Rows that repeat a
group's largest id are all responses. Line breaks in a url are percent-encoded.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import as_table, shared_path, ship, skew_join

INDEX = "page_id long, file string, offset long, length long, url string, digest string, record_type string, refers_to long"
RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
BREAK = b"\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class WarcConfig:
    revisit_bytes: int = 0
    date: str = "2024-01-01T00:00:00Z"
    compresslevel: int = 4
    #: Ranges closer than this are read together, up to a range of ``most`` bytes.
    gap: int = 64 * 1024
    most: int = 8 * 1024 * 1024
    #: Bytes of an archive that one task reads.
    task_bytes: int = 32 * 1024 * 1024


def _store(uri: str):
    """(file system, path) of a location; ``file:/x`` and plain paths are local."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """A response with the payload, or, where ``refers_to`` is given, a revisit without it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest}"]
    if page_id is not None:
        lines.append(f"Page-Id: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to)}", f"Refers-To-Page-Id: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + BREAK * 2 + block + BREAK * 2


def parse(raw: bytes) -> dict:
    """One record's fields; raises where its lengths or its digest don't hold."""
    head, _, rest = raw.partition(BREAK * 2)
    version, *lines = head.decode("utf-8").split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    size = int(fields["Content-Length"])
    if not version.startswith("WARC/") or len(rest) != size + 4 or rest[size:] != BREAK * 2:
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    http, _, payload = rest[:size].partition(BREAK * 2)
    declared = int(http.rsplit(b"Content-Length: ", 1)[1].split(BREAK)[0])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != declared or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
    number = lambda name: int(fields[name]) if name in fields else None
    return {"page_id": number("Page-Id"), "url": fields["WARC-Target-URI"], "payload": None if revisit else payload, "payload_bytes": declared, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("Refers-To-Page-Id")}


def _frame(rows: list, columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    for name in ("page_id", "refers_to"):
        out[name] = out[name].astype("Int64")
    return out


def write_archives(pages: DataFrame, folder: str, url: str = "url", html: str = "html", key: str = "page_id", config: WarcConfig = WarcConfig()) -> DataFrame:
    """Write every row of ``pages`` and return the stored index.

    A task that is run again writes another file; only the files of tasks that
    ended are in the index.
    """
    ship()
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("sha1", F.sha1(F.encode("html", "UTF-8")))
    large = F.octet_length("html") >= config.revisit_bytes
    groups = rows.where(large).groupBy("sha1").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).where("n > 1").drop("n")
    planned = skew_join(rows, groups, ["sha1"], "left")
    refers = F.when(large & F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder")), F.col("holder"))
    planned = planned.select("page_id", "url", "html", refers.alias("refers_to"))

    def write(batches):
        store, path = _store(folder)
        store.create_dir(path, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        at, out = 0, None
        try:
            for batch in batches:
                index = []
                for page, link, text, holder in zip(batch["page_id"].array, batch["url"], batch["html"], batch["refers_to"].array):
                    page, holder = None if pd.isna(page) else int(page), None if pd.isna(holder) else int(holder)
                    payload = text.encode("utf-8", "replace")
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    member = gzip.compress(record(page, link, payload, digest, holder, config.date), config.compresslevel, mtime=0)
                    if out is None:
                        out = store.open_output_stream(f"{path}/{name}", compression=None)
                    out.write(member)
                    index.append((page, f"{folder}/{name}", at, len(member), link, digest, "response" if holder is None else "revisit", holder))
                    at += len(member)
                yield _frame(index, [f.split()[0] for f in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    return as_table(planned.mapInPandas(write, INDEX), "warc-index")


def ranges(places: list[tuple[int, int]], config: WarcConfig) -> list[tuple[int, int, int]]:
    """(offset, end, number of records) of the reads that cover ``places``, sorted (offset, length) pairs."""
    out: list[list[int]] = []
    for offset, length in places:
        if out and offset - out[-1][1] <= config.gap and offset + length - out[-1][0] <= config.most:
            out[-1][1] = max(out[-1][1], offset + length)
            out[-1][2] += 1
        else:
            out.append([offset, offset + length, 1])
    return [tuple(x) for x in out]


def read_records(selected: DataFrame, config: WarcConfig = WarcConfig()) -> DataFrame:
    """The records of the index rows ``selected``, each checked against its digest."""
    ship()
    slices = int(selected.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunk = F.floor(F.col("offset") / config.task_bytes)
    placed = selected.select("file", "offset", "length").repartition(slices, F.col("file"), chunk).sortWithinPartitions("file", "offset")

    def read(batches):
        for batch in batches:
            for file, own in batch.groupby("file", sort=False):
                store, path = _store(file)
                places = list(zip(own["offset"].tolist(), own["length"].tolist()))
                at = 0
                with store.open_input_file(path) as source:
                    for start, end, count in ranges(places, config):
                        block = source.read_at(end - start, start)
                        rows = [parse(zlib.decompress(block[o - start : o - start + n], 31)) for o, n in places[at : at + count]]
                        at += count
                        yield _frame(rows, [f.split()[0] for f in RECORD.split(", ")])

    return placed.mapInPandas(read, RECORD)


def archive_folder(spark) -> str:
    return shared_path(spark, "warc")
