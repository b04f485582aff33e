"""WARC archives: writing, reading, deduplication and revisit resolution.

A record is one row of Spark's text writer, whose line separator is the two empty lines that end a
WARC record; archives are gzip files. Reading takes whole files of bounded size through Spark's
binary source, so any store that Spark reads will do, and follows the Content-Length of each record.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultsift.llm.common import join_skewed, staged

#: Payloads of fewer bytes are always stored.
MIN_BYTES = 1000
#: Bytes of records in a file, about: so many records of the mean size.
FILE_BYTES = 64_000_000
#: Bytes that are decompressed at a time.
PIECE = 1 << 20
#: Fixed value: the profile of revisits that repeat a payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "<urn:page:"

RECORD = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def plan_revisits(headers: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, digest, refers_to) of the records that revisit another.

    headers is (page_id, digest, n_bytes). Of equal payloads with min_bytes or more, the record of
    the largest page_id is the response. Records without a page_id, and rows that repeat the largest
    one, are responses too.
    """
    large = headers.where(F.col("n_bytes") >= min_bytes)
    kept = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    total = headers.count()
    return (
        join_skewed(large.select("page_id", "digest"), kept, "digest", "n", total)
        .where("page_id < refers_to")
        .select("page_id", "digest", "refers_to")
        .distinct()
    )


def _header(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def records(pages: DataFrame, revisits: DataFrame) -> DataFrame:
    """(record): one WARC record per page (page_id, url, html), without its closing empty lines."""
    uri = F.col("url")
    for code in (9, 10, 13, 32):  # white space would break the header
        uri = F.replace(uri, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    rows = pages.select("page_id", uri.alias("url"), F.coalesce("html", F.lit("")).alias("html")).withColumn(
        "digest", F.sha1(F.col("html").cast("binary"))
    )
    rows = rows.join(revisits.withColumnRenamed("page_id", "r_id").withColumnRenamed("digest", "r_digest"),
                     (F.col("page_id") == F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left")
    is_revisit = F.col("refers_to").isNotNull()
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length("html").cast("string"),
        F.lit("\r\n\r\n"),
    )
    block = F.concat(head, F.when(is_revisit, "").otherwise(F.col("html")))
    page_uri = lambda c: F.concat(F.lit(_ID), c.cast("string"), F.lit(">"))
    return rows.withColumn("block", block).select(
        F.concat(
            F.lit("WARC/1.1\r\nWARC-Type: "),
            F.when(is_revisit, "revisit").otherwise("response"),
            F.lit("\r\n"),
            _header("WARC-Record-ID", F.coalesce(page_uri(F.col("page_id")), F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">")))),
            _header("WARC-Date", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
            _header("WARC-Target-URI", F.col("url")),
            _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            _header("WARC-Refers-To", page_uri(F.col("refers_to"))),
            _header("WARC-Profile", F.when(is_revisit, F.lit(PROFILE))),
            F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
            F.octet_length("block").cast("string"),
            F.lit("\r\n\r\n"),
            F.col("block"),
        ).alias("record")
    )


def write(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, deduplicate: bool = True) -> None:
    """Write a record per row of pages (page_id, url, html) to gzip archives in path.

    A null html is an empty payload, a null url leaves the target out, a null page_id gets a random
    record id. An empty table leaves a folder without records. Other columns are ignored.
    """
    headers = pages.select(
        "page_id",
        F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"),
        F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("n_bytes"),
    )
    headers_all = staged(headers, "warc-headers")
    revisits = plan_revisits(headers_all if deduplicate else headers_all.limit(0), min_bytes)
    writer = records(pages, revisits).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
    mean = headers_all.agg(F.avg("n_bytes")).first()[0] or 0
    writer.option("maxRecordsPerFile", max(1, int(FILE_BYTES / (mean + 600)))).text(path)


def _pieces(data: bytes) -> Iterator[bytes]:
    """The archive's bytes, decompressed a piece at a time; any number of gzip members."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    rest = data
    while rest:
        member = zlib.decompressobj(31)
        while rest and not member.eof:
            made = member.decompress(rest, PIECE)
            rest = member.unconsumed_tail or (b"" if not member.eof else rest)
            if made:
                yield made
            elif not member.eof and not rest:
                break
        rest = member.unused_data.lstrip(b"\0") if member.eof else b""


def parse(data: bytes) -> Iterator[tuple]:
    """The records of an archive, compressed or not, in RECORD's order; it holds no more than a record at once."""
    held, pieces, ended = bytearray(), _pieces(data), False

    def more() -> bool:
        nonlocal ended
        piece = next(pieces, None)
        ended = piece is None
        held.extend(piece or b"")
        return not ended

    while True:
        while (at := held.find(b"WARC/")) < 0 and more():
            pass
        if at < 0:
            return
        while (end := held.find(b"\r\n\r\n", at)) < 0 and more():
            pass
        if end < 0:
            return
        head = {}
        for line in bytes(held[at:end]).split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            head[name.strip().lower()] = value.strip().decode("utf-8", "replace")
        start, size = end + 4, int(head.get(b"content-length", "0"))
        while len(held) < start + size and more():
            pass
        block = bytes(held[start : start + size])
        del held[: start + size]
        if head.get(b"content-type", "").startswith("application/http"):
            block = block.partition(b"\r\n\r\n")[2]
        digest = head.get(b"warc-payload-digest")
        yield (
            head.get(b"warc-record-id"),
            head.get(b"warc-type"),
            head.get(b"warc-target-uri"),
            head.get(b"warc-refers-to"),
            digest and digest.partition(":")[2],
            block,
        )


def read(spark: SparkSession, path: str, batch_rows: int = 256) -> DataFrame:
    """The records (RECORD) of all archives in path. A revisit's own payload is empty."""
    names = RECORD.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string()] * 5 + [pa.binary()]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names
            )

        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for row in parse(content.as_py()):
                    rows.append(row)
                    if len(rows) == batch_rows:
                        yield made(rows)
                        rows = []
                if rows:
                    yield made(rows)

    files = spark.read.format("binaryFile").load(path).where("path like '%.gz' or path like '%.warc' or path like '%.txt'")
    return files.select("content").mapInArrow(run, RECORD)


def resolve(found: DataFrame, columns: list[str]) -> DataFrame:
    """found with the columns of each revisit taken from the response that it refers to.

    That is the response of its id and payload digest; without a digest, the id's response of the largest
    digest. A revisit whose response is missing keeps its own. A response may have any number of revisits:
    those with many are broadcast. found is read several times.
    """
    rest = [c for c in found.columns if c not in columns]
    of = lambda name: F.concat_ws("\n", name, "payload_digest")  # noqa: E731; no header holds a line end
    responses = (
        found.where("record_type = 'response' and record_id is not null")
        .withColumn("_to", F.explode(F.array_distinct(F.array(of("record_id"), "record_id"))))
        .groupBy("_to")
        .agg(F.max_by(F.struct(*columns), F.coalesce("payload_digest", F.lit(""))).alias("_whole"))
    )
    revisits = found.where("record_type = 'revisit'").withColumn("_to", of("refers_to"))
    asked = staged(revisits.groupBy("_to").agg(F.count("*").alias("_n")), "warc-asked")
    total = asked.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    met = join_skewed(revisits, asked.join(responses, "_to", "left"), "_to", "_n", total)
    taken = met.select(*rest, *(F.when(F.col("_whole").isNotNull(), F.col(f"_whole.{c}")).otherwise(F.col(c)).alias(c) for c in columns))
    return found.where("record_type is null or record_type <> 'revisit'").select(*rest, *columns).unionByName(taken)


def page_of(record_id: Column) -> Column:
    """The page_id in a record's id; null for records of other origin."""
    return F.regexp_extract(record_id, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
