"""WARC archives: writing captures, reading records, assembling transactions.

Each page becomes a request, a response (or revisit) and a metadata record,
which name the response in WARC-Concurrent-To.  Archives are written by
Spark's text sink (records are UTF-8 text that CRLF CRLF ends), so they go to
any file system that Spark reaches.  Reading parses whole archives by
Content-Length; transactions are assembled by joins on record ids.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import scratch_path, sent_if_small, written

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads under this size are never revisits.
MIN_REVISIT_BYTES = 1000
#: Size classes of payloads, as (bytes below, pages of an archive file): a file, which a reader holds at once, is some 32 MB or one page.
FILE_PAGES = ((16 << 10, 2000), (256 << 10, 128), (1 << 20, 32), (1 << 40, 1))
#: Bytes of a repeated payload, or of a repeated page, in a table that is sent whole.
COPY_BYTES = 512
RECORD = pa.schema([
    ("record_id", pa.string()), ("kind", pa.string()), ("target", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()),
    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha1", pa.string()), ("fields", pa.string()), ("payload", pa.binary()),
])
RECORD_DDL = "record_id string, kind string, target string, concurrent_to array<string>, refers_to string, payload_digest string, payload_bytes bigint, payload_sha1 string, fields string, payload binary"


def _record_id(page_id: Column, url: Column, digest: Column, number: Column, kind: str) -> Column:
    """An id that follows from the page and its number among equal ones; the first has none in its key."""
    h = F.md5(F.to_json(F.struct(page_id.alias("p"), url.alias("u"), digest.alias("d"), F.nullif(number, F.lit(0)).alias("n"), F.lit(kind).alias("k"))).cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(kind: str | Column, headers: list[tuple[str, Column | str]], block: Column) -> Column:
    """A record without the CRLF CRLF that ends it; a header whose value is null is left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.concat(F.lit(f"{CRLF}{k}: "), v if isinstance(v, Column) else F.lit(v)) for k, v in headers]
    head = F.concat(F.lit(f"WARC/1.1{CRLF}WARC-Type: "), kind, *[F.coalesce(x, F.lit("")) for x in lines])
    return F.concat(head, F.lit(f"{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block)


def write_archives(pages: DataFrame, path: str, date: str, min_revisit: int = MIN_REVISIT_BYTES) -> None:
    """Writes page_id, url and html of each row as three records, in gzip'd archives under path.

    Of rows with equal payloads of min_revisit bytes or more, that with the
    largest page_id (then url) is the response, the others are revisits, whose
    payload isn't written again.  A null html is an empty payload; a null url
    has the target urn:none; a null page_id is less than all others.  Rows
    that repeat each other are captures of their own: they are numbered, and
    record ids follow from page_id, url, payload and number.  An empty table
    gives no archives.  The shuffles are of digests and keys, not payloads
    (but for rows that repeat each other).  A file is a gzip stream of its
    own; records in it aren't separate gzip members.
    """
    html = F.coalesce("html", F.lit(""))
    base = pages.select("page_id", F.coalesce("url", F.lit("urn:none")).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("bytes"))
    keys = written(base.select("page_id", "url", "digest", "bytes"), "page-keys")
    latest = F.max(F.struct("page_id", "url")).alias("latest")
    copies = written(keys.where(F.col("bytes") >= min_revisit).groupBy("digest").agg(latest, F.count("*").alias("n")).where("n > 1").select("digest", "latest"), "payload-copies")
    own_key = F.unhex(F.md5(F.to_json(F.struct("page_id", "url", "digest")).cast("binary")))
    again = written(keys.groupBy(own_key.alias("key")).agg(F.count("*").alias("n")).where("n > 1"), "page-copies")
    if again.isEmpty():
        rows = base.withColumn("number", F.lit(0))
    else:
        known = base.withColumn("key", own_key).join(sent_if_small(again, COPY_BYTES), "key", "left")
        alone = known.where("n is null").select(*base.columns, F.lit(0).alias("number"))
        many = known.where("n is not null").groupBy("key", "n").agg(*[F.first(c).alias(c) for c in base.columns])
        rows = alone.union(many.select(*base.columns, F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("number")))
    rows = rows.join(sent_if_small(copies, COPY_BYTES), "digest", "left")
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    revisit = F.col("latest").isNotNull() & ~(F.struct("page_id", "url").eqNullSafe(F.col("latest")) & (F.col("number") == 0)) & (F.col("bytes") >= min_revisit)
    own = lambda kind: _record_id(F.col("page_id"), F.col("url"), F.col("digest"), F.col("number"), kind)
    day = ("WARC-Date", date)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    host = F.regexp_extract(url, "://([^/?#]*)", 1)
    rest = F.regexp_extract(url, "://[^/?#]*(.*)$", 1)
    request = _record("request", [("WARC-Record-ID", own("request")), day, ("WARC-Target-URI", url), ("WARC-Concurrent-To", own("response")), ("Content-Type", "application/http; msgtype=request")], F.concat(F.lit("GET "), F.when(rest == "", "/").otherwise(rest), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF + CRLF)))
    referred = F.when(revisit, _record_id(F.col("latest.page_id"), F.col("latest.url"), F.col("digest"), F.lit(0), "response"))
    response = _record(
        F.when(revisit, "revisit").otherwise("response"),
        [("WARC-Record-ID", own("response")), day, ("WARC-Target-URI", url), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), ("WARC-Refers-To", referred), ("WARC-Profile", F.when(revisit, F.lit(PROFILE))), ("Content-Type", "application/http; msgtype=response")],
        F.concat(http, F.when(revisit, "").otherwise(F.col("html"))),
    )
    metadata = _record("metadata", [("WARC-Record-ID", own("metadata")), day, ("WARC-Target-URI", url), ("WARC-Concurrent-To", own("response")), ("Content-Type", "application/warc-fields")], F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF)))
    written_bytes = F.when(revisit, 0).otherwise(F.col("bytes"))
    below = 0
    sizes = keys.select(*[F.max((F.col("bytes") >= a) & (F.col("bytes") < b)) for a, b in zip((0, *[c for c, _ in FILE_PAGES]), [c for c, _ in FILE_PAGES], strict=False)]).first()
    for (limit, pages_a_file), present in zip(FILE_PAGES, sizes, strict=True):
        if present or not below:  # revisits are of the first class, whatever their payload's size
            own_class = rows.where((written_bytes >= below) & (written_bytes < limit))
            records = own_class.select(F.explode(F.array(request, response, metadata)).alias("value"))
            records.write.mode("append").option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", 3 * pages_a_file).text(path)
        below = limit


def parse_archive(stream: io.BufferedIOBase) -> Iterator[dict]:
    """The records of one archive, in order, found by Content-Length; raises ValueError where it is not WARC."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        headers: list[tuple[str, str]] = []
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode().partition(":")
            headers.append((name.strip().lower(), value.strip()))
        one = dict(reversed(headers))
        block = stream.read(int(one["content-length"]))
        http = one.get("content-type", "").startswith("application/http")
        payload = block[block.find(b"\r\n\r\n") + 4 :] if http else block
        kind = one.get("warc-type")
        whole = kind == "response"
        yield {
            "record_id": one.get("warc-record-id"), "kind": kind, "target": one.get("warc-target-uri"), "concurrent_to": [v for k, v in headers if k == "warc-concurrent-to"], "refers_to": one.get("warc-refers-to"),
            "payload_digest": one.get("warc-payload-digest", "").removeprefix("sha1:") or None, "payload_bytes": len(payload) if whole else None, "payload_sha1": hashlib.sha1(payload).hexdigest() if whole else None,
            "fields": block.decode(errors="replace") if kind == "metadata" else None, "payload": payload if whole else None,
        }


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records of the archives under path (gzip'd or plain); payload is null where payloads is false.

    Every file is read, whatever its name, but for those that Spark takes as
    hidden (names that begin with _ or a dot, such as _SUCCESS).
    Records come in any order, repeated ones as often as they stand; a header
    that is missing is null; a file that isn't WARC raises an error; a folder
    without archives gives no rows.
    """

    def records(batches):
        rows, held = [], 0
        for batch in batches:
            for content in batch.column("content"):
                content = content.as_buffer()
                packed = content.size > 1 and content[0:2].to_pybytes() == b"\x1f\x8b"
                raw = pa.BufferReader(content)
                for r in parse_archive(io.BufferedReader(gzip.GzipFile(fileobj=raw)) if packed else io.BufferedReader(raw)):
                    if not payloads:
                        r["payload"] = None
                    rows.append(r)
                    held += 500 + len(r["payload"] or b"")
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, RECORD)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, RECORD)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(records, RECORD_DDL)


def assemble_transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response, requests, metadata, original.

    response is the struct of the response or revisit record; requests and
    metadata are arrays (by record id) of the records joined to it through
    concurrent-to, whichever side names the other; original is the response
    that a revisit refers to, null where it isn't there.  Records that repeat
    a record id count once.  A request or metadata record that leads to no
    response is a capture of its own, with a null response.  Records of other
    kinds are left out; an empty table gives no rows.
    """
    columns = [c for c in records.columns if c != "record_id"]
    records = records.where(F.col("kind").isin("response", "revisit", "request", "metadata"))
    once = records.groupBy("record_id").agg(F.first(F.struct(*columns)).alias("r")).select("record_id", "r.*")
    is_anchor = F.col("kind").isin("response", "revisit")
    whole = F.struct("record_id", *columns)
    anchors, others = once.where(is_anchor), once.where(~is_anchor)
    named = others.select(F.col("record_id").alias("member"), F.explode("concurrent_to").alias("anchor"))
    naming = anchors.select(F.explode("concurrent_to").alias("member"), F.col("record_id").alias("anchor"))
    links = named.union(naming).distinct().join(anchors.select(F.col("record_id").alias("anchor")), "anchor", "left_semi")
    side = others.select(F.col("record_id").alias("member"), whole.alias("side"))
    joined = side.join(links, "member", "left").withColumn("capture_id", F.coalesce("anchor", "member"))
    of = lambda kind: F.sort_array(F.collect_list(F.when(F.col("side.kind") == kind, F.col("side"))))
    sides = joined.groupBy("capture_id").agg(of("request").alias("requests"), of("metadata").alias("metadata"))
    main = anchors.select(F.col("record_id").alias("capture_id"), whole.alias("response"))
    out = main.join(sides, "capture_id", "full_outer")
    originals = main.select(F.col("capture_id").alias("of"), F.col("response").alias("original")).where("original.kind = 'response'")
    # Captures that refer to none have a key of their own, which matches nothing: nulls would all meet in one task.
    refers = F.coalesce("response.refers_to", F.concat(F.lit("none:"), "capture_id"))
    return out.join(originals, refers == F.col("of"), "left").drop("of")


def round_trip(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Captures of pages, written as archives to the shared folder and read back; payloads are hashed, not kept.

    One capture for each row, repeated ones too; nulls, empty texts, ties and
    empty tables are as in write_archives, other columns are ignored.
    """
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, date)
    return assemble_transactions(written(read_records(pages.sparkSession, path, payloads=False).drop("payload"), "warc-records"))
