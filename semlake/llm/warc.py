"""WARC archives: writing, reading and revisit resolution.

Records are written by Spark's text writer with the record separator of the format, so any store Spark can write to
will do; a file is one gzip stream.  Reading takes the stream line by line and cuts records by ``Content-Length``, so
a payload may hold anything, record heads included, and a task holds one record at a time.

Resolution shuffles headers only: (id, digest, length) are grouped by payload digest for the first record of each
payload, and joined back to name the later ones revisits of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semlake.llm.common import bounded_batches, materialise, new_path, respread

MIN_REVISIT_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
RECORDS_PER_FILE = 5000


def headers(records: DataFrame) -> DataFrame:
    """``records(page_id, url, payload)`` with ``payload_bytes`` and ``payload_digest`` of the payload's UTF-8 bytes."""
    return records.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2(F.encode("payload", "UTF-8"), 256)})


def resolve_revisits(heads: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``heads(page_id, payload_digest, payload_bytes)`` -> ``(page_id, payload_digest, refers_to)`` of the revisits.

    Of equal payloads of at least ``min_bytes`` the smallest page_id is the response; rows that share it, and rows
    without an id, are responses too.
    """
    big = heads.filter(F.col("payload_bytes") >= min_bytes).select("page_id", "payload_digest")
    first = big.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 and refers_to is not null").select(F.col("payload_digest").alias("d"), "refers_to")
    later = big.join(respread(first), F.col("payload_digest") == F.col("d")).filter("page_id > refers_to")
    return later.select("page_id", "payload_digest", "refers_to").distinct()


def _urn(page_id: F.Column, digest: F.Column) -> F.Column:
    h = F.md5(F.concat_ws("|", page_id.cast("string"), digest))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def write_archives(records: DataFrame, path: str, date: str | None = None) -> None:
    """``records(page_id, url, payload, payload_bytes, payload_digest, refers_to)`` -> gzip WARC files under ``path``.

    A record with ``refers_to`` is a revisit: its HTTP head without the payload.  Line breaks in urls are escaped.  The
    records have no date of their own, so all get ``date``, the time of writing by default.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        field("WARC-Record-ID", _urn(F.col("page_id"), F.col("payload_digest"))),
        field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", url),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        F.when(revisit, field("WARC-Refers-To", _urn(F.col("refers_to"), F.col("payload_digest")))),
        F.when(revisit, field("WARC-Profile", F.lit(PROFILE))),
        field("X-Page-Id", F.col("page_id").cast("string")),
        F.when(revisit, field("X-Refers-To-Page-Id", F.col("refers_to").cast("string"))),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        field("Content-Length", F.octet_length(block).cast("string")),
    )
    out = records.select(F.concat(head, F.lit(END), block).alias("value"))
    out.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


class _Stream:
    """Bytes that arrive piece by piece, cut into WARC records."""

    def __init__(self) -> None:
        self.parts: list[bytes] = []
        self.size, self.need = 0, 0

    def feed(self, data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        self.parts.append(data)
        self.size += len(data)
        if self.size < self.need:
            return
        buf, at, self.need = b"".join(self.parts), 0, 0
        while True:
            end = buf.find(b"\r\n\r\n", at)
            if end < 0:
                break
            lines = buf[at:end].decode("utf-8", "surrogatepass").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
            fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
            stop = end + 4 + int(fields["Content-Length"])
            if len(buf) < stop + 4:
                self.need = stop + 4 - at
                break
            yield fields, buf[end + 4 : stop]
            at = stop + 4
        self.parts, self.size = [buf[at:]], len(buf) - at

    def finish(self) -> None:
        if b"".join(self.parts).strip():
            raise ValueError("an archive ends within a record")


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Archives -> ``(page_id, url, record_type, refers_to, payload_digest, payload_bytes[, payload])``.

    Digest and length of a response come from its payload, those of a revisit from its headers.
    """
    bounded_batches(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream = _Stream()
        for pdf in batches:
            rows = []
            for line in pdf["value"]:
                for f, block in stream.feed(line.encode("utf-8", "surrogatepass") + b"\n"):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    if f["WARC-Type"] == "revisit":
                        size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
                        digest, text = f["WARC-Payload-Digest"].rpartition(":")[2], None
                    else:
                        size, digest, text = len(payload), hashlib.sha256(payload).hexdigest(), payload.decode("utf-8", "surrogatepass") if with_payload else None
                    page, ref = f.get("X-Page-Id"), f.get("X-Refers-To-Page-Id")
                    rows.append((int(page) if page else None, f["WARC-Target-URI"], f["WARC-Type"], int(ref) if ref else None, digest, size, text))
            if rows:
                yield pd.DataFrame(rows, columns=["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]).astype({"page_id": "Int64", "refers_to": "Int64"})
        stream.finish()

    out = spark.read.option("lineSep", "\n").text(path).mapInPandas(run, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload string")
    return out if with_payload else out.drop("payload")


def deduplicate(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """``pages(page_id, url, html)`` -> archives with one record per row under ``path``, repeated payloads as revisits.

    A null html is an empty payload, a null url an empty target; rows without an id are responses; an empty table
    writes no record; other columns are not read.
    """
    records = headers(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload")))
    revisits = materialise(resolve_revisits(records.select("page_id", "payload_digest", "payload_bytes"), min_bytes), "revisits")
    r = respread(revisits.select(F.col("page_id").alias("_p"), F.col("payload_digest").alias("_d"), "refers_to"))
    write_archives(records.join(r, (F.col("page_id") == F.col("_p")) & (F.col("payload_digest") == F.col("_d")), "left"), path)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the deduplicated archives of ``pages`` to the shared folder and read them back, without payloads."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    deduplicate(pages, path)
    return read_archives(spark, path, with_payload=False)
