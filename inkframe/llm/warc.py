"""WARC archives: one transaction a page written as request, response or revisit, and metadata; read and assembled again."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkframe.llm.store import fresh_path, hot_keys, join_hot, written

#: Payloads of fewer bytes are stored again rather than revisited.
LEAST_REVISIT = 1000
#: Compressed bytes of a row of records, a record more at most, rows an archive file holds at most, and the effort of compression.
ROW_BYTES, ROWS_A_FILE, LEVEL = 4_000_000, 16, 4
#: Copies of a row that one row stands for at most.
COPIES = 100_000
#: The revisit profile that the WARC standard names for payloads of equal digest.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, "
    "payload_digest string, payload_bytes long, intact boolean, fields map<string,string>"
)


def _urn(key: Column) -> Column:
    h = F.md5(key)
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _line(name: str, value: Column | str) -> Column:
    """A header line, or nothing for a null value; line breaks inside a value become spaces."""
    value = F.regexp_replace(value, "[\\r\\n]+", " ") if isinstance(value, Column) else F.lit(value)
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _record(kind: str, rid: Column, lines: list[Column], content_type: str, block: Column) -> Column:
    return F.concat(
        F.lit(f"WARC/1.0\r\nWARC-Type: {kind}\r\n"), _line("WARC-Record-ID", rid), *lines, F.lit(f"Content-Type: {content_type}\r\nContent-Length: "),
        F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block,
    )


def choose_responses(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """(digest, top_id, top_url, n, n_top) of every payload of at least ``least`` bytes that occurs twice or more.

    The response is the row of largest (page_id, url), nulls lowest; n_top counts the rows equal to it in both.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    small = pages.where(F.octet_length(payload) >= least).select(F.sha1(body).alias("digest"), F.struct(F.col(page_id).alias("i"), F.col(url).alias("u")).alias("row"))
    groups = small.groupBy("digest", "row").agg(F.count(F.lit(1)).alias("c")).groupBy("digest").agg(F.max("row").alias("top"), F.sum("c").alias("n"), F.max_by("c", "row").alias("n_top"))
    return groups.where("n > 1").select("digest", F.col("top.i").alias("top_id"), F.col("top.u").alias("top_url"), "n", "n_top")


def gzip_member(record: bytes, level: int = LEVEL) -> bytes:
    """``record`` as a gzip member of its own, ending with a zero byte (a member's last is the top byte of its length)."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = z.compress(record) + z.flush()
    if out[-1]:
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        out += z.flush()
    return out


def write_warc(
    pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST_REVISIT, date: str = "2024-01-01T00:00:00Z"
) -> None:
    """Writes the records of every row of ``pages`` as archives below ``path``, each record a gzip member, with Spark's own text writer.

    Three records a row, in a row: request, response (or revisit), metadata; the first and last name the
    middle one in WARC-Concurrent-To. Rows whose payload (null: empty; string as UTF-8, or binary) has at
    least ``least`` bytes and an equal elsewhere revisit that of the largest (page_id, url). Repeated rows
    are captures of their own, one of equal ones the response. A null page_id or url is left out of its record; an
    empty table gives no record; extra columns are not read. Payloads shuffle once, by digest, and those of
    digests with many copies not at all. A file is closed after ROWS_A_FILE rows of at most ROW_BYTES and a record,
    so its size is bounded by bytes. The writer ends rows with a line separator: it is the last byte of a member.
    """
    body = F.coalesce(F.col(payload).cast("binary").cast("string"), F.lit(""))
    rows = pages.select(F.col(page_id).alias("i"), F.col(url).alias("u"), body.alias("body")).withColumn("digest", F.sha1(F.col("body").cast("binary"))).withColumn("size", F.octet_length("body"))
    tops = written(choose_responses(pages, page_id, url, payload, least), "warc-tops")
    hot = hot_keys(tops, "n")
    cold = tops.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    rows = rows.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "digest", "left")
    # Rows that the broadcast has settled and rows too small to revisit get a key of their own, so that no key is heavy.
    alone = F.coalesce("hot", F.col("size") < least)
    rows = rows.withColumn("k", F.when(alone, F.concat(F.lit("-"), F.xxhash64("i", "u").cast("string"))).otherwise(F.col("digest")))
    rest = cold.select(F.col("digest").alias("k"), *(F.col(c).alias(f"_{c}") for c in ("top_id", "top_url", "n", "n_top")))
    rows = rows.join(rest.hint("shuffle_merge"), "k", "left")
    for c in ("top_id", "top_url", "n", "n_top"):
        rows = rows.withColumn(c, F.coalesce(c, f"_{c}"))
    is_top = F.col("n").isNull() | (F.col("i").eqNullSafe(F.col("top_id")) & F.col("u").eqNullSafe(F.col("top_url")))
    rows = rows.withColumn("is_top", is_top).withColumn("shared", F.col("n").isNotNull())
    named = ["i", "u", "digest", "size", "shared"]
    if not tops.where("n_top > 1").isEmpty():  # wholly equal rows: one of them is the response, and the others need no body
        many = F.coalesce(F.col("is_top") & (F.col("n_top") > 1), F.lit(False))
        equal = written(rows.where(many).groupBy(*named).agg(F.first("body").alias("body"), F.count(F.lit(1)).alias("c")), "warc-equal")
        copies = equal.select(*named, F.explode(F.sequence(F.lit(0), F.floor((F.col("c") - 2) / COPIES))).alias("part"), "c").repartition("digest", "part")
        copies = copies.select(*named, F.explode(F.sequence(F.col("part") * COPIES, F.least((F.col("part") + 1) * COPIES, F.col("c") - 1) - 1)).alias("copy"))
        rows = rows.where(~many).select(*named, "body", "is_top").unionByName(equal.select(*named, "body", F.lit(True).alias("is_top"))).unionByName(copies.select(*named, F.lit("").alias("body"), F.lit(False).alias("is_top")))
    shared = _urn(F.concat(F.lit("response "), F.col("digest")))
    own = F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))
    rows = rows.select("i", "u", "body", "size", "digest", "is_top", F.when(F.col("is_top") & F.col("shared"), shared).otherwise(own).alias("rid"), shared.alias("refers"))
    base = [_line("WARC-Target-URI", F.col("u")), _line("WARC-Date", date)]
    host = F.regexp_extract(F.coalesce("u", F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#\\s]*)", 1)
    request = _record("request", _urn(F.concat(F.lit("request "), "rid")), [*base, _line("WARC-Concurrent-To", F.col("rid"))], "application/http; msgtype=request", F.concat(F.lit("GET / HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    digest = _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest"))
    response = _record("response", F.col("rid"), [*base, digest], "application/http; msgtype=response", F.concat(http, "body"))
    revisit = _record("revisit", F.col("rid"), [*base, digest, _line("WARC-Profile", PROFILE), _line("WARC-Refers-To", F.col("refers"))], "application/http; msgtype=response", http)
    metadata = _record("metadata", _urn(F.concat(F.lit("metadata "), "rid")), [*base, _line("WARC-Concurrent-To", F.col("rid"))], "application/warc-fields", _line("page_id", F.col("i").cast("string")))
    records = rows.select(F.explode(F.array(request, F.when(F.col("is_top"), response).otherwise(revisit), metadata)).alias("value")).select(F.col("value").cast("binary"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for x in b.column(0):
                held.append(gzip_member(x.as_buffer().to_pybytes() + b"\r\n\r\n"))
                size += len(held[-1])
                if size >= ROW_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["value"])

    packed = records.mapInArrow(pack, "value binary").select(F.col("value").cast("string"))
    packed.write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", ROWS_A_FILE).text(path)


def inflated(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """What all gzip members of ``data`` hold, some at a time, or ``data`` itself if it isn't gzip."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    at, end = 0, len(data)
    view = memoryview(data)
    while at < end:
        if data[at] == 0:  # padding between members
            at += 1
            continue
        z = zlib.decompressobj(31)
        while not z.eof:
            given = z.unconsumed_tail
            if not given:
                given = view[at : at + step]
                at += len(given)
            out = z.decompress(given, 4 * step)
            if not out and not len(given):
                raise ValueError("the archive ends within a gzip member")
            yield out
        at -= len(z.unused_data)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of an archive, gzipped or not, by the records' own lengths.

    Memory holds the archive as it is and one record.
    """
    chunks = inflated(data)
    held, at, place, over = bytearray(), 0, 0, False

    def more() -> bool:
        nonlocal over, at, place
        if at > 1 << 22:
            del held[:at]
            place, at = place + at, 0
        chunk = next(chunks, None)
        over = chunk is None
        if chunk:
            held.extend(chunk)
        return not over

    while True:
        while True:
            while at < len(held) and held[at] in b"\r\n":
                at += 1
            if at < len(held) or not more():
                break
        if at >= len(held):
            return
        seen = at
        while (head := held.find(b"\r\n\r\n", seen)) < 0:
            back = len(held) - at
            if not more():
                break
            seen = at + max(0, back - 3)
        if head < 0 or not held.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {place + at}")
        headers: dict[str, str] = {}
        for line in bytes(held[at:head]).split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            headers.setdefault(name.strip().lower().decode("utf-8", "replace"), value.strip().decode("utf-8", "replace"))
        size, start = int(headers["content-length"]), head + 4 - at
        while len(held) < at + start + size:
            if not more():
                raise ValueError(f"the record at byte {place + at} is cut off")
        yield headers, bytes(held[at + start : at + start + size])
        at += start + size


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives below ``path``: RECORD's columns, and ``payload`` unless it is not asked for.

    A response's payload is what follows its HTTP header; length and digest are of these bytes, and
    ``intact`` tells whether the digest agrees with the record's own. A revisit has no payload here: its
    digest is the one it names, its length the one its HTTP header gives. ``fields`` are those of an
    application/warc-fields block. An unreadable archive fails the query rather than losing records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, t) for n, t in zip([c.split()[0] for c in RECORD.split(", ")], [*[pa.string()] * 7, pa.int64(), pa.bool_(), pa.map_(pa.string(), pa.string())])])
        if with_payload:
            schema = schema.append(pa.field("payload", pa.binary()))
        for b in batches:
            for file in b.column(0):
                out, held = [], 0
                for h, block in parse_records(file.as_buffer().to_pybytes()):
                    kind, digest, size, intact, fields, payload = h.get("warc-type"), None, None, None, None, None
                    named = h.get("warc-payload-digest", "").rpartition(":")[2] or None
                    if kind == "response":
                        _, _, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
                        digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
                        intact = named is None or named == digest
                    elif kind == "revisit":
                        digest = named
                        for line in block.split(b"\r\n")[1:]:
                            if line.lower().startswith(b"content-length:"):
                                size = int(line[15:])
                    elif h.get("content-type", "").startswith("application/warc-fields"):
                        fields = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n") if x)]
                    row = [h.get("warc-record-id"), kind, h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"), digest, size, intact, fields]
                    out.append((*row, payload) if with_payload else row)
                    held += len(payload) if with_payload and payload else 200
                    if held > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{txt,gz,warc}").load(path)
    return files.select("content").mapInArrow(run, RECORD + ", payload binary" * with_payload)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: (capture_id, capture struct, requests array<struct>, metadata array<struct>).

    A capture is a response or revisit record; requests and metadata join it through WARC-Concurrent-To (their
    own id without one). Each capture is a row: those without an identifier have no other records, those that share
    one have the same. Requests and metadata that name no capture that is there are a row together with a null
    capture, those without any identifier a row each. No record is lost; an empty table gives none. ``records``
    is read three times and should be a written table. Identifiers that many captures share don't make
    the join uneven; what one capture gathers is one row by construction.
    """
    whole = F.struct(*records.columns)
    captures = records.where(F.col("type").isin("response", "revisit")).select(F.col("record_id").alias("capture_id"), whole.alias("capture"))
    rest = records.where(F.col("type").isin("request", "metadata")).select(F.coalesce("concurrent_to", "record_id").alias("capture_id"), "type", whole.alias("r"))
    kind = rest.schema["r"].dataType.simpleString()
    none = F.array().cast(f"array<{kind}>")
    lists = [F.collect_list(F.when(F.col("type") == t, F.col("r"))).alias(c) for t, c in (("request", "requests"), ("metadata", "metadata"))]
    nested = rest.where("capture_id IS NOT NULL").groupBy("capture_id").agg(*lists)
    found = captures.where("capture_id IS NOT NULL").join(nested.hint("shuffle_merge"), "capture_id", "left")
    found = found.unionByName(captures.where("capture_id IS NULL").select("*", none.alias("requests"), none.alias("metadata")))
    lost = nested.join(captures.where("capture_id IS NOT NULL").select("capture_id").hint("shuffle_merge"), "capture_id", "left_anti")
    lone = rest.where("capture_id IS NULL").select("capture_id", *(F.when(F.col("type") == t, F.array("r")).otherwise(none).alias(c) for t, c in (("request", "requests"), ("metadata", "metadata"))))
    without = lost.unionByName(lone).withColumn("capture", F.lit(None).cast(kind))
    return found.unionByName(without).select("capture_id", "capture", F.coalesce("requests", none).alias("requests"), F.coalesce("metadata", none).alias("metadata"))


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """``captures`` (capture_id, page_id, type, refers_to, ...) with refers_to turned into that response's page_id.

    A response that a third of all rows revisit is broadcast with the other much-revisited ones.
    """
    captures = written(captures, "captures")
    revisits = captures.where("type = 'revisit'")
    targets = revisits.groupBy("refers_to").agg(F.count(F.lit(1)).alias("_n"))
    targets = targets.join(captures.where("type = 'response'").select(F.col("capture_id").alias("refers_to"), F.col("page_id").alias("_to")), "refers_to")
    found = join_hot(revisits, written(targets, "revisited"), "refers_to", "_n").drop("refers_to", "_n").withColumnRenamed("_to", "refers_to")
    kind = captures.schema["page_id"].dataType
    rest = captures.where("type <> 'revisit'").withColumn("refers_to", F.lit(None).cast(kind))
    return rest.unionByName(found)


def archive_and_read(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Archives ``pages`` in the shared folder and reads them again: a row a page with what the records say."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_warc(pages, path, page_id, url, payload)
    nested = assemble(written(read_warc(spark, path, with_payload=False), "records"))
    kind = pages.schema[page_id].dataType
    rows = nested.select(
        "capture_id", F.try_element_at(F.get("metadata", 0)["fields"], F.lit("page_id")).cast(kind).alias("page_id"), F.col("capture.type").alias("type"), F.col("capture.refers_to").alias("refers_to"),
        F.col("capture.payload_bytes").alias("payload_bytes"), F.col("capture.payload_digest").alias("payload_digest"), F.col("capture.intact").alias("intact"),
    )
    out = resolve_revisits(rows)
    return out.select(F.col("page_id").alias(page_id), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to", "intact")
