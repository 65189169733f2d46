"""WARC archives: writing captures and assembling transactions from request, response and metadata records.

Both ways go through Spark's text source, so that archives can lie wherever Spark reads and writes. On reading, files are cut where a
record could begin, whatever its 1.x version, and the pieces are put together again until a record has its stated length; so a block
may hold anything, even whole records. Assembling the slim records of ``captured_payloads`` moves digests, places and identifiers,
no payloads; ``assemble`` on full records moves what they hold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.llm.common import Scratch, bounded_batches
from saltmarsh.operators.skew import split_join

END = "\r\n\r\n"
VERSION = "WARC/1.1\r\n"
#: What every record of this family begins with.
FAMILY = "WARC/1."
#: Payloads of fewer bytes are always written as responses.
LEAST_REVISIT_BYTES = 100
#: Records of one archive file at most.
FILE_RECORDS = 60_000
#: The table of revisits is broadcast if its measured rows are estimated at no more bytes than this.
BROADCAST_BYTES = 16 << 20
_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d+)")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(kind: str, *key: Column) -> Column:
    """A record id that depends on the capture alone, so that a repeated task writes the same one."""
    digest = F.md5(F.concat_ws("\x1f", F.lit(kind), *[F.coalesce(k.cast("string"), F.lit("")) for k in key]))
    parts = [F.substring(digest, start, length) for start, length in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(kind: Column, record_id: Column, url: Column, fields: list[tuple[str, Column]], block: Column) -> Column:
    """One record without its end; a field whose value is null is left out."""
    lines = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Target-URI", url), *fields,
             ("Content-Length", F.octet_length(block).cast("string"))]
    head = [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")) for name, value in lines]
    return F.concat(F.lit(VERSION), *head, F.lit("\r\n"), block)


def write_captures(
    pages: DataFrame, folder: str, *, page_id: str = "page_id", url: str = "url", payload: str = "html",
    date: str = "1970-01-01T00:00:00Z", least_bytes: int = LEAST_REVISIT_BYTES,
) -> None:
    """Write a request, a response or revisit, and a metadata record per page, gzipped, under ``folder``.

    Of pages with equal payloads of ``least_bytes`` bytes or more, that with the least id is the response and the others revisit
    it; a page without an id revisits if any has one. Pages that repeat that id and payload are responses too. A null payload is
    an empty one, a null address leaves the target out.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    slim = pages.select(F.col(page_id).alias("page_id"), F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("size"))
    groups = (slim.where(F.col("size") >= least_bytes).groupBy("digest")
              .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
              .where("n > 1 and first_id is not null").select("digest", "first_id"))
    scratch = Scratch(pages.sparkSession, "warc-repeats")
    repeats = scratch.write(groups.select(F.col("digest").alias("of_digest"), "first_id"), "groups")
    side = F.broadcast(repeats) if 100 * repeats.count() <= BROADCAST_BYTES else repeats

    digest, address = F.col("digest"), F.replace(F.replace(F.col(url), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rows = (pages.select(F.col(page_id).alias("page_id"), address.alias("url"), body.alias("body"))
            .withColumn("digest", F.sha2("body", 256))
            .join(side, F.col("digest") == F.col("of_digest"), "left")
            .withColumn("revisits", F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))))
    capture = (F.col("page_id"), digest)
    record_id, type_ = _urn("response", *capture), F.when(F.col("revisits"), "revisit").otherwise("response")
    # the separator may also begin in the end of the HTTP header
    torn = (F.contains(F.col("body"), F.lit(END + VERSION)) | F.startswith(F.col("body"), F.lit(VERSION))
            | F.startswith(F.col("body"), F.lit("\r\n" + VERSION)))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length("body").cast("string"),
        F.when(torn, "\r\nContent-Transfer-Encoding: base64").otherwise(""), F.lit(END))
    held = F.when(F.col("revisits"), "").when(torn, F.base64("body")).otherwise(F.col("body"))
    when = ("WARC-Date", F.lit(date))
    host = F.coalesce(F.regexp_extract(F.col("url"), "^[a-z]+://([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(F.col("url"), "^[a-z]+://[^/?#]*([^#]*)", 1), F.lit(""))
    records = F.array(
        _record(F.lit("request"), _urn("request", *capture), F.col("url"),
                [when, ("WARC-Concurrent-To", record_id), ("Content-Type", F.lit("application/http; msgtype=request"))],
                F.concat(F.lit("GET "), path, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END))),
        _record(type_, record_id, F.col("url"),
                [when, ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
                 ("WARC-Profile", F.when(F.col("revisits"), PROFILE)),
                 ("WARC-Refers-To", F.when(F.col("revisits"), _urn("response", F.col("first_id"), digest))),
                 ("Content-Type", F.lit("application/http; msgtype=response"))],
                F.concat(http, held)),
        _record(F.lit("metadata"), _urn("metadata", *capture), F.col("url"),
                [when, ("WARC-Concurrent-To", record_id), ("Content-Type", F.lit("application/warc-fields"))],
                F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit(""))))
    (rows.select(F.explode(records).alias("value")).write
     .option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(folder))
    scratch.drop("groups")


def _whole_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records from the pieces of files, in their order: a record goes on until it has its stated length.

    Where a file ends before that, its first piece counts as the record, unfinished, and the pieces behind it as records.
    """
    between, end, family = (END + FAMILY).encode(), END.encode(), FAMILY.encode()

    def stated(piece: bytes) -> int:
        head, found, _ = piece.partition(end)
        length = _LENGTH.search(head)
        return len(head) + len(end) + int(length.group(1)) if found and length else 0

    def take(pieces: list[bytes], last: bool) -> tuple[list[bytes], list[bytes]]:
        """Whole records of the pieces held, and the pieces of a record that is not whole yet."""
        out, k = [], 0
        while k < len(pieces):
            need, size, to = stated(pieces[k]), len(pieces[k]), k + 1
            while size < need and to < len(pieces):
                size += len(between) + len(pieces[to])
                to += 1
            if size < need and not last:
                return out, pieces[k:]
            if size < need:
                to = k + 1
            out.append(family + between.join(pieces[k:to]))
            k = to
        return out, []

    held, file, size, need = [], None, 0, 0
    for batch in batches:
        done: list[bytes] = []
        for piece, name in zip(batch.column("value").to_pylist(), batch.column("file").to_pylist(), strict=True):
            if name != file:
                done += take(held, True)[0]
                held, file, size, need = [], name, 0, 0
                piece = piece.removeprefix(family)
            size += len(piece) + (len(between) if held else 0)
            need = need if held else stated(piece)
            held.append(piece)
            if size >= need:
                made, held = take(held, False)
                done += made
                size = need = 0
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.binary())], names=["value"])
    yield pa.RecordBatch.from_arrays([pa.array(take(held, True)[0], pa.binary())], names=["value"])


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all archives in ``folder``: type, record_id, target_uri, concurrent_to, refers_to, digest, block and payload
    (binary; of HTTP responses what follows the HTTP header), and complete.

    A field that a record lacks is null. ``complete`` is false for a record that ends before its stated length, as at the end of a
    file that was cut off. Versions 1.0 and 1.1 are read, gzipped (in one member or many) or plain. A plain archive that Spark reads in
    several splits must not hold the beginning of a record inside a block that lies over their border; gzipped ones are read whole.
    """
    bounded_batches(spark)
    pieces = spark.read.option("lineSep", END + FAMILY).text(folder)
    pieces = pieces.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"))
    text = pieces.mapInArrow(_whole_records, "value binary").select(F.col("value").cast("string").alias("value"))
    head = F.substring_index("value", END, 1)

    def field(name: str) -> Column:
        found = F.regexp_extract("head", f"(?im)^{name}:[ \\t]*([^\\r\\n]*)", 1)
        return F.when(found != "", found)

    raw = F.col("value").cast("binary")
    begin, length = F.octet_length("head") + 4, F.col("length")
    inner = F.octet_length(F.substring_index("value", END, 2)) + 4
    is_http = F.col("type").isin("response", "revisit")
    payload = F.substring(raw, F.col("inner") + 1, F.greatest(begin + length - F.col("inner"), F.lit(0)))
    inner_head = F.substring(raw, begin + 1, F.greatest(F.col("inner") - begin, F.lit(0))).cast("string")
    encoded = is_http & F.contains(F.lower(inner_head), F.lit("content-transfer-encoding: base64"))
    return (text.withColumn("head", head).where(field("WARC-Type").isNotNull())
            .select("value", "head", inner.alias("inner"), F.lower(field("WARC-Type")).alias("type"),
                    field("WARC-Record-ID").alias("record_id"), field("WARC-Target-URI").alias("target_uri"),
                    field("WARC-Concurrent-To").alias("concurrent_to"), field("WARC-Refers-To").alias("refers_to"),
                    field("WARC-Payload-Digest").alias("digest"),
                    F.coalesce(field("Content-Length").cast("int"), F.lit(0)).alias("length"))
            .select("type", "record_id", "target_uri", "concurrent_to", "refers_to", "digest",
                    F.substring(raw, begin + 1, length).alias("block"),
                    F.when(encoded, F.unbase64(payload.cast("string"))).when(is_http, payload).alias("payload"),
                    (F.octet_length(raw) >= begin + length).alias("complete")))


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: columns request, response and metadata, each a struct of the record's columns.

    Requests and metadata meet their response (or revisit) through WARC-Concurrent-To. A capture without one of them has null
    there. If several requests or metadata records name one response, the least is taken; records that repeat an id
    with equal content count once beside each response, so no capture is multiplied.
    """
    columns = [c for c in records.columns if c != "concurrent_to"]

    def beside(kind: str) -> DataFrame:
        return (records.where((F.col("type") == kind) & F.col("concurrent_to").isNotNull())
                .groupBy(F.col("concurrent_to").alias(f"{kind}_of")).agg(F.min(F.struct(*columns)).alias(kind)))

    responses = records.where(F.col("type").isin("response", "revisit")).select(F.struct(*columns).alias("response"))
    return (responses.join(beside("request"), F.col("response.record_id") == F.col("request_of"), "left")
            .join(beside("metadata"), F.col("response.record_id") == F.col("metadata_of"), "left")
            .select("request", "response", "metadata"))


def captured_payloads(
    pages: DataFrame, *, page_id: str = "page_id", url: str = "url", payload: str = "html", folder: str | None = None,
    least_bytes: int = LEAST_REVISIT_BYTES,
) -> DataFrame:
    """Write ``pages`` as archives, read them back and return one row per page.

    Columns page_id, payload_bytes, payload_digest (SHA-256 in hex, worked out from the payload that was read; a revisit's
    is that of the response it refers to), record_type, refers_to (the response's page id). ``folder`` keeps the archives; without
    it they lie in the shared folder until they are read. An empty table gives an empty table.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    kind = pages.schema[page_id].dataType
    archive = folder or f"{scratch.folder}/archive"
    write_captures(pages, archive, page_id=page_id, url=url, payload=payload, least_bytes=least_bytes)
    page = F.regexp_extract(F.decode("block", "UTF-8"), "page-id: ([^\\r\\n]*)", 1)
    slim = read_records(spark, archive).select(
        "type", "record_id", "target_uri", "concurrent_to", "refers_to",
        F.octet_length("payload").cast("long").alias("size"), F.sha2("payload", 256).alias("digest"),
        F.when((F.col("type") == "metadata") & (page != ""), page).cast(kind).alias("page_id"))
    records = scratch.write(slim, "records")
    if folder is None:
        scratch.drop("archive")
    captures = scratch.write(assemble(records).select(
        F.col("metadata.page_id").alias("page_id"), "response.record_id", "response.type", "response.refers_to",
        "response.size", "response.digest"), "captures")
    first = (captures.where("type = 'response'").groupBy(F.col("record_id").alias("of")).agg(
        F.min("page_id").alias("of_page"), F.min("size").alias("of_size"), F.min("digest").alias("of_digest")))
    # one response may be what a large share of all captures refers to
    revisits = split_join(captures.where("type = 'revisit'").withColumn("of", F.col("refers_to")), first, ["of"], "left")
    own = captures.where("type <> 'revisit'").select(
        "page_id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"),
        F.lit(None).cast(kind).alias("refers_to"))
    return own.unionByName(revisits.select(
        "page_id", F.col("of_size").alias("payload_bytes"), F.col("of_digest").alias("payload_digest"), F.col("type").alias("record_type"),
        F.col("of_page").alias("refers_to")))
