"""Content-addressed WARC archive: payload bytes once by SHA-256, exact record headers apart, records rebuilt by a join.

`archive` writes two tables in a folder: payloads (digest, size, zstd bytes), one row a digest, and headers (the exact
header block of each record and the digest of its payload). `records` joins them, checks each payload against its digest
and yields the original records; a wrong payload raises. `write_files` writes records as .warc files through Spark's
text writer, which puts bytes out as they are; `read_files` parses .warc and .warc.gz files that Spark lists, record by
record. `query` goes all the way: archive, rebuilt records, WARC files, and the records read back from those.

Defined cases: null html is an empty payload; null url is an empty target; of records with equal payloads the response is
that with the largest page_id, then the first url in byte order, then the first row read, and a null page_id comes after all
others; all others revisit it, those of the same page_id or a null one too; record ids hold a row number, so they never
clash; an empty table gives empty tables; payloads of any length are kept whole; columns beside page_id, url and html are
ignored.
"""

from __future__ import annotations

import hashlib
import io

import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

LEAST = 1000
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
#: Records of a WARC file, and bytes that a reading task hands on at a time.
FILE_RECORDS, BATCH_BYTES = 20_000, 8 << 20


def planned(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """pages -> page_id, url, payload (binary), n, sha1, digest, response (the page that holds the payload)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    x = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"))
    return x.withColumns({"n": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload"), "digest": F.sha2("payload", 256)})


def header(x: DataFrame) -> DataFrame:
    """The record header block of each row with `best`, the (page_id, row) that holds its payload, or null for its own."""
    revisit = F.col("best").isNotNull() & (F.col("best.row") != F.col("row"))
    uri = lambda page, row: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), row.cast("string"), F.lit(">"))
    lines = [
        F.lit("WARC/1.1"),
        F.when(revisit, F.lit("WARC-Type: revisit")).otherwise(F.lit("WARC-Type: response")),
        F.concat(F.lit("WARC-Record-ID: "), uri(F.col("page_id"), F.col("row"))),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", "")),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), uri(F.col("best.page_id"), F.col("best.row")))),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("n")).cast("string")),
    ]
    return x.withColumns({"revisit": revisit, "header": F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF))})


def archive(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """Writes payloads and headers under path."""
    x = planned(pages, least)

    def squeezed(batches):
        import pyarrow as pa

        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            z = [pack.compress(p) for p in batch.column("payload").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("n"), pa.array(z, pa.binary())], names=["digest", "n", "z"])

    packed = x.select("digest", "n", "payload").mapInArrow(squeezed, "digest string, n long, z binary")
    packed.groupBy("digest").agg(F.first("n").alias("n"), F.first("z").alias("z")).write.option("compression", "none").parquet(f"{path}/payloads")
    slim = store.written(store.few(x.drop("payload")).withColumn("row", F.monotonically_increasing_id()), "pages")
    first = F.struct(F.col("page_id").isNull().alias("nameless"), F.bitwise_not("page_id").alias("down"), "url", "row", "page_id")
    best = slim.where(F.col("n") >= least).groupBy(F.col("digest").alias("_d")).agg(F.min(first).alias("best"))
    slim = slim.join(best.select("_d", F.struct("best.page_id", "best.row").alias("best")), F.col("digest") == F.col("_d"), "left")
    header(slim).select("page_id", "digest", "revisit", "header").write.option("compression", "zstd").parquet(f"{path}/headers")


def records(spark: SparkSession, path: str, *, revisits: bool = True) -> DataFrame:
    """(page_id, header, payload) of every record, joined back and verified; without the payloads of revisits if so asked."""
    heads, bodies = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    rest = heads.where("revisit").select("page_id", "header", F.lit(b"").alias("payload"))
    heads = heads if revisits else heads.where("NOT revisit")

    def opened(batches):
        import pyarrow as pa

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for digest, n, z in zip(*(batch.column(c).to_pylist() for c in ("digest", "n", "z")), strict=True):
                payload = unpack.decompress(z) if n else b""
                if len(payload) != n or hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"payload {digest} does not match its digest")
                out.append(payload)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("header"), pa.array(out, pa.binary())], names=["page_id", "header", "payload"])

    full = heads.join(bodies, "digest").select("page_id", "digest", "header", "n", "z").mapInArrow(opened, "page_id long, header string, payload binary")
    return full if revisits else full.unionByName(rest)


def field(name: str):
    """The value of a header field in a column `header`."""
    return F.nullif(F.regexp_extract("header", rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def page_of(uri):
    return F.regexp_extract(F.coalesce(uri, F.lit("")), r"<urn:page:(-?\d+):", 1).try_cast("long")


def parsed(found: DataFrame) -> DataFrame:
    """(header, block) as read from files -> page_id, payload_bytes, payload_digest, record_type, refers_to, header_digest_ok.

    A revisit has the payload of the response that it refers to.
    """
    mine = F.col("type") == "response"
    x = found.select(
        field("WARC-Record-ID").alias("uri"),
        field("WARC-Type").alias("type"),
        field("WARC-Refers-To").alias("refers"),
        F.substring_index(field("WARC-Payload-Digest"), ":", -1).alias("told"),
        F.octet_length("block").cast("long").alias("n"),
        F.sha1("block").alias("sha1"),
    )
    x = store.written(store.few(x), "read-back")
    held = x.where(mine).select(F.col("uri").alias("_uri"), F.col("n").alias("_n"), F.col("sha1").alias("_sha1"))
    again = x.where(~mine).join(held, F.col("refers") == F.col("_uri"), "left").withColumns({"n": F.col("_n"), "sha1": F.col("_sha1")}).select(x.columns)
    return x.where(mine).unionByName(again).select(
        page_of(F.col("uri")).alias("page_id"),
        F.col("n").alias("payload_bytes"),
        F.col("sha1").alias("payload_digest"),
        F.col("type").alias("record_type"),
        page_of(F.col("refers")).alias("refers_to"),
        (F.col("told") == F.col("sha1")).alias("header_digest_ok"),
    )


def query(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    path, files = store.new_dir(spark, "warc"), store.new_dir(spark, "warc-files")
    archive(store.columns(pages, "page_id", "url", "html"), path)
    write_files(records(spark, path, revisits=False), files, gzip=True)
    return parsed(read_files(spark, files))


def write_files(found: DataFrame, path: str, *, gzip: bool = False) -> None:
    """Records (header, payload) as WARC files: a revisit's block is empty, a record ends with two line ends.

    A binary column cast to string keeps its bytes, and the text writer writes them unchanged, UTF-8 or not.
    """
    block = F.when(field("WARC-Type") == "revisit", F.lit("")).otherwise(F.col("payload").cast("string"))
    out = found.select(F.concat(F.col("header"), block).alias("value")).write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", FILE_RECORDS)
    (out.option("compression", "gzip") if gzip else out).text(path)


def split_records(stream):
    """(header, block) of each record in a binary stream, by Content-Length."""
    while line := stream.readline():
        if not line.strip():
            continue
        head, length = [line], None
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            head.append(line)
            if line.lower().startswith(b"content-length:"):
                length = int(line.split(b":", 1)[1])
        if not line:
            raise ValueError("a record has no end of its header")
        block = stream.read(length or 0)
        if length is None or len(block) < length:
            raise ValueError("a record is cut short or has no Content-Length")
        yield b"".join([*head, line]), block


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, nth, header, block) of WARC files, plain or gzip.

    A file is one task's work: its bytes as they lie are held, its records are opened one after another.
    """
    shape = "path string, nth long, header string, block binary"

    def parse(batches):
        import gzip

        import pyarrow as pa

        kinds = (pa.string(), pa.int64(), pa.string(), pa.binary())
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in shape.split(", ")])
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                stream, rows, held = io.BytesIO(data), [], 0
                stream = gzip.GzipFile(fileobj=stream) if data[:2] == b"\x1f\x8b" else stream
                for n, (head, block) in enumerate(split_records(io.BufferedReader(stream, 1 << 20))):
                    rows.append((name, n, head.decode(errors="replace"), block))
                    held += len(head) + len(block)
                    if held > BATCH_BYTES:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, shape)


SQL = """
WITH p AS (SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
m AS (SELECT *, first_value(page_id) OVER w AS last, row_number() OVER w AS nth FROM p WINDOW w AS (PARTITION BY html ORDER BY page_id DESC NULLS LAST, url, r))
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN strlen(html) >= 1000 AND nth > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(html) >= 1000 AND nth > 1 THEN last END AS refers_to, true AS header_digest_ok
FROM m
"""
