"""Web archives: writing request, response or revisit, and metadata records, and assembling them into one row per capture.

Writing: a payload that several pages share is stored once, as the response of the largest page_id (nulls first, then
by url); the others are revisit records that refer to it. Every capture gets three records, joined by
WARC-Concurrent-To. Archives are gzip text files with records separated as the format asks, written by Spark's own
writer, so a lost executor leaves no partial archive behind. Pages are written by class of length (``SIZE_CLASSES``), each class with
as many records in a file as ``file_bytes`` allow for its longest, so no archive is longer; a page beyond that has one of its own.

Reading: files are read by Spark and parsed record by record by Content-Length, so a payload may hold any bytes.

Assembly: requests and metadata are joined to the response or revisit that they name in WARC-Concurrent-To, or that
names them, or that is concurrent to a record they name. The result has one nested row per capture.

Defined results: a null html is an empty payload, a null url becomes about:blank. Pages repeated in full are written as often as they stand and give
as many rows; they share one record id. Records without a capture to belong to are left out of the captures (they stay in ``read_records``). An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuentaclara.llm.common import own_columns, shared_dir, ship, written

ship(__name__)

LINE = "\r\n"
END = LINE + LINE
# The digits of base 32, as the parsing functions and as archives write them.
BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Upper bounds of payload bytes per class; pages beyond the last are written one per archive.
SIZE_CLASSES = (32 << 10, 1 << 20, 16 << 20)
FILE_BYTES = 256 << 20
#: What the three records of a capture take beside payload and address, at most.
HEADER_BYTES = 4 << 10
RECORDS = ("record_id string, type string, target string, date string, concurrent_to array<string>, refers_to string, "
           "payload_digest string, payload_bytes long, fields map<string,string>, payload binary")


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: 20 bits are five hexadecimal or four base32 digits."""
    sha = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(sha, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), BASE32_DIGITS, BASE32_LETTERS)


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts]).cast("binary"))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def _record(kind: str | Column, headers: dict[str, Column], block: Column) -> Column:
    """One record without its end mark. A header that is null is left out."""
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in headers.items()]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(F.lit("WARC/1.1" + LINE + "WARC-Type: "), kind, F.lit(LINE), F.concat_ws(LINE, *lines), F.lit(END), block)


def _http(length: Column) -> Column:
    return F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length.cast("string"), F.lit(END))


def _size_class(size: Column) -> Column:
    return sum((size > bound).cast("int") for bound in SIZE_CLASSES)


def captures_per_file(size_class: int, file_bytes: int) -> int:
    """How many captures of a class fit a file, headers included; one at least."""
    if size_class >= len(SIZE_CLASSES):
        return 1
    return max(1, file_bytes // (SIZE_CLASSES[size_class] + HEADER_BYTES))


def archive(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> None:
    """Write the pages (page_id, url, html) as archives below ``path``, in one folder per class of length that occurs."""
    url = F.regexp_replace(F.coalesce("url", F.lit("about:blank")), r"[\x00-\x20\x7F]", "%20")
    rows = own_columns(pages, "page_id", "url", "html").select("page_id", url.alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    body = F.col("html").cast("binary")
    rows = rows.withColumns({"digest": base32_sha1(body), "check": F.xxhash64(body), "bytes": F.octet_length(body).cast("long")})
    first = written(rows.groupBy("digest", "check", "bytes").agg(F.max(F.struct("page_id", "url")).alias("kept")), "warc-first")
    # A class reads the lengths of all pages but moves and digests only its own.
    size = F.octet_length("html") + 4 * F.octet_length("url")
    for number in sorted(r[0] for r in rows.select(_size_class(size)).distinct().collect()) or [0]:
        _write_class(rows.where(_size_class(size) == number), first, f"{path}/class-{number}", date,
                     3 * captures_per_file(number, file_bytes))


def _write_class(rows: DataFrame, first: DataFrame, path: str, date: str, records_per_file: int) -> None:
    same = ["digest", "check", "bytes"]
    joined = rows.join(first, same)
    mine = F.col("page_id").eqNullSafe(F.col("kept.page_id")) & (F.col("url") == F.col("kept.url"))
    joined = joined.select(
        "page_id", "url", "html", "digest", "bytes", mine.alias("is_first"),
        _urn(F.col("page_id"), F.col("url"), F.col("digest"), F.lit("c")).alias("capture"),
        _urn(F.col("page_id"), F.col("url"), F.col("digest"), F.lit("q")).alias("request"),
        _urn(F.col("page_id"), F.col("url"), F.col("digest"), F.lit("m")).alias("metadata"),
        _urn(F.col("kept.page_id"), F.col("kept.url"), F.col("digest"), F.lit("c")).alias("earlier"))
    common = {"WARC-Date": F.lit(date), "WARC-Target-URI": F.col("url")}
    again = F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    capture = _record(
        F.when(F.col("is_first"), "response").otherwise("revisit"),
        {"WARC-Record-ID": F.col("capture"), **common, "Content-Type": F.lit("application/http; msgtype=response"),
         "WARC-Payload-Digest": F.concat(F.lit("sha1:"), F.col("digest")),
         "WARC-Profile": F.when(~F.col("is_first"), again), "WARC-Refers-To": F.when(~F.col("is_first"), F.col("earlier"))},
        F.concat(_http(F.col("bytes")), F.when(F.col("is_first"), F.col("html")).otherwise("")))
    request = _record(
        "request", {"WARC-Record-ID": F.col("request"), **common, "WARC-Concurrent-To": F.col("capture"),
                    "Content-Type": F.lit("application/http; msgtype=request")},
        F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1" + END)))
    metadata = _record(
        "metadata", {"WARC-Record-ID": F.col("metadata"), **common, "WARC-Concurrent-To": F.col("capture"),
                     "Content-Type": F.lit("application/warc-fields")},
        F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(LINE)))
    joined.select(F.explode(F.array(request, capture, metadata)).alias("value")).write.option("lineSep", END).option(
        "compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse_records(stream) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """Headers (lower-case name to values) and block of each record of an open archive."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:60]!r}")
        headers: dict[str, list[str]] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers.setdefault(name.strip().lower(), []).append(value.strip())
        size = int(headers["content-length"][0])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError(f"a record ends after {len(block)} of {size} bytes")
        yield headers, block


def _row(headers: dict[str, list[str]], block: bytes, payloads: bool) -> dict:
    import base64
    import hashlib

    kind = headers["warc-type"][0]
    content = headers.get("content-type", [""])[0]
    head, payload, fields = b"", block, {}
    if content.startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        for line in head.split(b"\r\n")[1:]:
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
    elif content.startswith("application/warc-fields"):
        for line in block.split(b"\r\n"):
            name, colon, value = line.decode("utf-8", "replace").partition(":")
            if colon:
                fields[name.strip().lower()] = value.strip()
    stated = headers.get("warc-payload-digest", [""])[0].removeprefix("sha1:") or None
    size = len(payload)
    if kind == "revisit":  # it states the payload of the record it refers to
        size = int(fields.get("content-length", -1))
    elif stated is not None:
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if found != stated:
            raise ValueError(f"{headers['warc-record-id'][0]}: the payload has digest {found}, stated is {stated}")
    return {
        "record_id": headers["warc-record-id"][0], "type": kind, "target": headers.get("warc-target-uri", [None])[0],
        "date": headers.get("warc-date", [None])[0], "concurrent_to": headers.get("warc-concurrent-to", []),
        "refers_to": headers.get("warc-refers-to", [None])[0], "payload_digest": stated, "payload_bytes": size,
        "fields": list(fields.items()), "payload": payload if payloads else None}


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records below ``path``, plain or gzip (also with one member per record), with RECORDS as columns."""
    def run(batches: Iterator) -> Iterator:
        import gzip
        import io

        import pyarrow as pa

        kinds = pa.schema([
            ("record_id", pa.string()), ("type", pa.string()), ("target", pa.string()), ("date", pa.string()),
            ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("payload_digest", pa.string()),
            ("payload_bytes", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
        for batch in batches:
            for content in batch.column("content"):
                raw = content.as_buffer()
                stream = io.BytesIO(raw)
                if raw[:2].to_pybytes() == b"\x1f\x8b":
                    stream = io.BufferedReader(gzip.GzipFile(fileobj=stream))
                rows, held = [], 0
                for headers, block in parse_records(stream):
                    rows.append(_row(headers, block, payloads))
                    held += len(block)
                    if len(rows) >= 2_000 or payloads and held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(run, RECORDS)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, copies, capture, requests and metadata (arrays of records)."""
    body = F.struct("type", "target", "date", "refers_to", "payload_digest", "payload_bytes", "fields", "payload")
    # The same record may stand in several archives.
    single = written(records.groupBy("record_id").agg(
        F.first(F.struct("concurrent_to", body.alias("body"))).alias("r"), F.count(F.lit(1)).alias("copies")).select(
        "record_id", "copies", "r.*"), "warc-records")
    is_capture = F.col("body.type").isin("response", "revisit", "resource")
    anchors = single.where(is_capture).select("record_id", "copies", F.col("body").alias("capture"))
    names = single.select("record_id", is_capture.alias("anchor"), F.explode("concurrent_to").alias("other"))
    to_anchor = names.where("NOT anchor").select("record_id", "other").unionByName(
        names.where("anchor").select(F.col("other").alias("record_id"), F.col("record_id").alias("other")))
    direct = to_anchor.join(anchors.select(F.col("record_id").alias("other")), "other").select("record_id", F.col("other").alias("capture_id")).distinct()
    direct = written(direct, "warc-direct")
    # Records that name, or are named by, a request or metadata record of the capture.
    between = names.where("NOT anchor").select("record_id", "other")
    either = between.unionByName(between.select(F.col("other").alias("record_id"), F.col("record_id").alias("other")))
    onward = either.join(direct.select("record_id"), "record_id", "left_anti").join(
        direct.withColumnRenamed("record_id", "other"), "other").select("record_id", "capture_id").distinct()
    parts = direct.unionByName(onward).join(single.where(~is_capture).select("record_id", "body"), "record_id")
    of_kind = {kind: F.collect_list(F.when(F.col("body.type") == kind, F.struct("record_id", "body.*"))) for kind in ("request", "metadata")}
    grouped = parts.groupBy("capture_id").agg(of_kind["request"].alias("requests"), of_kind["metadata"].alias("metadata"))
    return anchors.join(grouped.withColumnRenamed("capture_id", "record_id"), "record_id", "left")


def round_trip(pages: DataFrame) -> DataFrame:
    """The pages through archives and back: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    archive(pages, path)
    page_id = F.get("metadata", F.lit(0))["fields"]["page-id"]
    found = captures(read_records(spark, path, payloads=False)).select(
        "record_id", "copies", F.when(page_id != "", page_id.cast("long")).alias("page_id"), "capture")
    found = written(found, "warc-captures")
    # Only responses that a revisit names have to be found again.
    targets = found.where("capture.type = 'response'").select(F.col("record_id").alias("target_id"), F.col("page_id").alias("refers_to"))
    rows = found.withColumn("target_id", F.col("capture.refers_to")).join(targets, "target_id", "left")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(
        "page_id", F.col("capture.payload_bytes").alias("payload_bytes"), F.col("capture.payload_digest").alias("payload_digest"),
        F.col("capture.type").alias("record_type"), "refers_to", F.col("capture.target").alias("url"))
