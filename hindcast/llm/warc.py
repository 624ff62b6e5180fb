"""WARC archives: writing, reading, and revisit records for payloads that an archive already holds.

Records are rows. The text sink writes them, one gzip file of whole records a task, parted by the two line breaks that end a
record; the text source reads the same parts back in order, and a small parser puts records together by their
Content-Length, so a task holds one record at a time and never an archive, and any file system of Spark's will do.

Revisits are resolved on headers alone: they are dealt out by payload digest, the response of the smallest page id stays, and
the others, and revisits that the input already had, are joined to it. Payloads meet these decisions by record id, which is
spread evenly. Where one digest holds a large part of all headers, its few originals are broadcast instead.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.llm.common import forget, shared_dir, small_batches, written

VERSION, BREAK, PART = "WARC/1.1", "\r\n", "\r\n\r\n"
#: The profile of a revisit record, and the digits of base 32 as SQL's conv and as WARC write them.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CONV, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: A key that holds more than one row in so many is joined by broadcast; there are fewer than so many of these.
SHARES = 1000
#: Bytes of records that a task gathers before it sends them on.
SENT = 8 << 20
READ = "record_id string, type string, page_id long, target_uri string, date string, payload_digest string, refers_to string, n_bytes long, guard long"


def base32(hexed: Column) -> Column:
    """40 hex digits as 32 digits of base 32: five of the ones are four of the others."""
    fours = [F.lpad(F.conv(F.substring(hexed, k, 5), 16, 32), 4, "0") for k in range(1, 41, 5)]
    return F.translate(F.concat(*fours), CONV, BASE32)


def digest(c: Column) -> Column:
    """The bare SHA-1 of bytes in base 32."""
    return base32(F.sha1(c.cast("binary")))


def urn(seed: Column) -> Column:
    """A record id that follows from a text."""
    h = F.md5(seed.cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def in_a_line(c: Column) -> Column:
    """A header's value on one line: line breaks are percent-encoded."""
    return F.replace(F.replace(c, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def records(pages: DataFrame, date: str = "2000-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """A response record for each row: record_id (drawn at random), type, page_id, target_uri, date, payload, and null for the rest.

    Null payloads are empty, null urls and ids have no header. Repeated rows are records of their own.
    """
    none = F.lit(None).cast("string")
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    return pages.select(F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">")).alias("record_id"), F.lit("response").alias("type"), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("target_uri"), F.lit(date).alias("date"), digest(payload).alias("payload_digest"), none.alias("refers_to"), none.alias("refers_to_uri"), none.alias("refers_to_date"), payload.alias("payload"))


def write(of: DataFrame, path: str) -> None:
    """Writes records as gzip files, one a partition; responses with their payload, revisits with what they refer to.

    of has the columns that records() gives. An empty table gives a folder without archives.
    """
    is_response = F.col("type") == "response"
    size = F.octet_length(F.coalesce("payload", F.lit("").cast("binary")))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}"), F.when(is_response, F.concat(F.lit("Content-Length: "), size.cast("string"), F.lit(BREAK))).otherwise(F.lit("")), F.lit(BREAK))
    block = F.when(is_response, F.concat(http, F.col("payload").cast("string"))).otherwise(http)
    of = of.withColumn("__block", block)
    line = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"{name}: "), in_a_line(c.cast("string"))))
    revisit = lambda c: F.when(~is_response, c)
    lines = [
        F.lit(VERSION),
        line("WARC-Type", F.col("type")),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.col("target_uri")),
        line("WARC-Page-ID", F.col("page_id")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), digest(F.col("__block")))),
        line("WARC-Profile", revisit(F.lit(PROFILE))),
        line("WARC-Refers-To", revisit(F.col("refers_to"))),
        line("WARC-Refers-To-Target-URI", revisit(F.col("refers_to_uri"))),
        line("WARC-Refers-To-Date", revisit(F.col("refers_to_date"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("__block")),
    ]
    whole = F.concat(F.concat_ws(BREAK, *lines), F.lit(PART), F.col("__block"))
    of.select(whole.alias("value")).write.mode("overwrite").option("lineSep", PART).option("compression", "gzip").text(path)


def header_of(raw: bytes) -> dict[str, str]:
    """The header's fields by lower-case name."""
    first, *lines = raw.decode("utf-8", "replace").split(BREAK)
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record begins with {first[:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def parsed(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of each record of a file, given as what lies between its double line breaks, in order.

    A part ends a header, a record, or neither (blocks may hold double line breaks); Content-Length tells which.
    """
    held, size, head, need = [], 0, None, 0
    for part in parts:
        if not held and part in (b"", b"\r\n"):
            continue
        size += len(part) + len(PART) * bool(held)
        held.append(part)
        while held:
            if head is None:
                joined = PART.encode().join(held).lstrip(b"\r\n")
                raw = joined.partition(PART.encode())[0]
                head = header_of(raw)
                held, size, need = [joined], len(joined), len(raw) + len(PART) + int(head["content-length"])
            if size < need and not (size + len(PART) == need and int(head["content-length"]) == 0):
                break
            joined = PART.encode().join(held)
            yield head, joined[need - int(head["content-length"]) : need]
            rest = joined[need:].lstrip(b"\r\n")
            held, size, head = [rest] if rest else [], len(rest), None
    if head is not None:
        raise ValueError(f"an archive ends within the record {head.get('warc-record-id')}")


def entity(block: bytes, head: dict[str, str]) -> bytes:
    """The payload of a block: what follows the HTTP header, or the whole block of another type."""
    return block.partition(PART.encode())[2] if head.get("content-type", "").startswith("application/http") else block


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of all archives below path: READ's columns, and the payload's bytes where asked for.

    payload_digest and n_bytes of a response are those of the bytes read (a header that says otherwise raises ValueError);
    a revisit has its header's digest and no bytes. guard is a second hash of the bytes. Other record types are left out.
    """
    small_batches(spark)
    schema = READ + ", payload binary" * payloads
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.binary() if x.endswith("binary") else pa.int64() if x.endswith("long") else pa.string() for x in schema.split(", ")]

    def rows(found: Iterator[tuple[dict[str, str], bytes]]) -> Iterator[tuple]:
        for head, block in found:
            kind, said = head.get("warc-type"), head.get("warc-payload-digest", "").removeprefix("sha1:") or None
            if kind not in ("response", "revisit"):
                continue
            data = entity(block, head) if kind == "response" else None
            if data is not None:
                own = base64.b32encode(hashlib.sha1(data).digest()).decode()
                if said not in (None, own):
                    raise ValueError(f"the payload of {head.get('warc-record-id')} isn't the one of its digest")
                said = own
            guard = int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True) if data is not None else None
            page = head.get("warc-page-id")
            row = (head.get("warc-record-id"), kind, int(page) if page else None, head.get("warc-target-uri"), head.get("warc-date"), said, head.get("warc-refers-to"), None if data is None else len(data), guard)
            yield row + (data,) * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def files() -> Iterator[tuple[str, bytes]]:
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)

        held, size = [], 0
        for _, parts in groupby(files(), key=lambda x: x[0]):
            for row in rows(parsed(x[1] for x in parts)):
                held.append(row)
                size += 300 + (len(row[-1] or b"") if payloads else 0)
                if size >= SENT:
                    yield batch_of(held)
                    held, size = [], 0
        if held:
            yield batch_of(held)

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    parts = spark.read.schema("value string").option("lineSep", PART).text(path)
    return parts.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary")).mapInArrow(run, schema)


def to_one(many: DataFrame, few: DataFrame, keys: list[str], shares: int = SHARES) -> DataFrame:
    """many left join few, which has one row a key. Keys with more than one in `shares` of many's rows, of which there are
    fewer than `shares`, are joined by broadcast, so no task gets more than that share of the rows of one key."""
    most = max(1, many.count() // shares)
    large = many.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > most).select(*keys)
    hot = F.broadcast(few.join(F.broadcast(large), keys, "left_semi"))
    named = F.broadcast(large.withColumn("__large", F.lit(True)))
    told = many.join(named, keys, "left")
    return told.where("__large").drop("__large").join(hot, keys, "left").unionByName(told.where("__large is null").drop("__large").join(few, keys, "left"))


def revisits(headers: DataFrame, least: int = 0) -> DataFrame:
    """(record_id, original, original_uri, original_date) of each record that is to be a revisit.

    Of responses with equal payloads of `least` bytes or more the one of the smallest page_id stays (null ids last, then the
    smaller record id); smaller payloads all stay. A revisit of the input follows the response that stays for its digest; if
    no archive has one, it isn't in the result and keeps what it refers to.
    """
    responses = headers.where("type = 'response'")
    order = F.struct(F.col("page_id").isNull().alias("z"), "page_id", "record_id", "target_uri", "date")
    keys = ["payload_digest", "n_bytes", "guard"]
    originals = responses.groupBy(*keys).agg(F.min(order).alias("o"), F.count(F.lit(1)).alias("n"))
    shown = [F.col(f"o.{a}").alias(b) for a, b in (("record_id", "original"), ("target_uri", "original_uri"), ("date", "original_date"))]
    repeated = originals.where(F.col("n") > 1).where(F.col("n_bytes") >= least).select(*keys, *shown)
    found = to_one(responses.select("record_id", *keys), repeated, keys).where("original <> record_id")
    by_digest = originals.groupBy("payload_digest").agg(F.min("o").alias("o")).select("payload_digest", *shown)
    old = to_one(headers.where("type = 'revisit'").select("record_id", "payload_digest"), by_digest, ["payload_digest"]).where("original is not null")
    columns = ["record_id", "original", "original_uri", "original_date"]
    return found.select(*columns).unionByName(old.select(*columns))


def deduplicated(spark: SparkSession, source: str, target: str, root: str, least: int = 0) -> None:
    """Writes the archives below source again below target, each payload once; every record gets a fresh id and fresh headers.

    root is a folder that all machines see, for the headers.
    """
    headers = written(read(spark, source), root, "headers")
    decided = written(revisits(headers, least), root, "revisits")
    whole = read(spark, source, payloads=True).repartition("record_id").join(decided, "record_id", "left")
    becomes = F.col("original").isNotNull()
    fresh = lambda c: urn(F.concat(c, F.lit(" deduplicated")))
    whole = whole.select(
        fresh(F.col("record_id")).alias("record_id"),
        F.when(becomes, "revisit").otherwise(F.col("type")).alias("type"),
        "page_id", "target_uri", "date", "payload_digest",
        F.when(becomes, fresh(F.col("original"))).otherwise(F.col("refers_to")).alias("refers_to"),
        F.col("original_uri").alias("refers_to_uri"),
        F.col("original_date").alias("refers_to_date"),
        F.when(~becomes, F.col("payload")).alias("payload"),
    )
    write(whole, target)


def resolved(spark: SparkSession, path: str, root: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of all records below path.

    payload_bytes of a revisit are those of the response that it refers to, and refers_to is that response's page_id; both
    are null if no archive has it.
    """
    found = written(read(spark, path), root, "read")
    originals = found.where("type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("n_bytes").alias("__bytes"), F.col("page_id").alias("__page"))
    linked = to_one(found.where("type = 'revisit'").select("page_id", "payload_digest", "refers_to"), originals, ["refers_to"])
    linked = linked.select("page_id", F.col("__bytes").alias("payload_bytes"), "payload_digest", F.lit("revisit").alias("record_type"), F.col("__page").alias("refers_to"))
    own = found.where("type = 'response'").select("page_id", F.col("n_bytes").alias("payload_bytes"), "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return own.unionByName(linked)


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes pages as archives, writes these deduplicated, and reads the result back: see resolved() for its columns.

    An empty table gives an empty result; repeated rows are revisits of one of them.
    """
    spark = pages.sparkSession
    root = shared_dir(spark)
    write(records(pages), f"{root}/raw")
    deduplicated(spark, f"{root}/raw", f"{root}/archives", root, least)
    forget(spark, root, "raw", "headers", "revisits")
    return resolved(spark, f"{root}/archives", root)


SQL = r"""
with paid as (
  select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as s, min(page_id) over (partition by coalesce(html, '')) as first from pages
), fives as (
  select page_id, html, first, list_transform(range(8), lambda k: cast('0x' || substr(s, 5 * k + 1, 5) as bigint)) as x from paid
)
select page_id, strlen(html)::bigint as payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x[k // 4 + 1] // pow(32, 3 - k % 4)::bigint) % 32 + 1, 1)), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to
from fives
"""
