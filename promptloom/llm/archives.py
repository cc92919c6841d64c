"""WARC archives with a shared Zstandard dictionary.

A record is a frame of its own, compressed with a dictionary built from records of the same archives; the
dictionary stands in a skippable frame at the head of every file, so each file can be read by itself by any
tool that knows dictionary-compressed WARC.  The files are written by Spark's own text sink, whose commit keeps
what a lost or repeated task has written out of the result: a line is a frame, and what ends a line is an empty
skippable frame, which decoders pass over.  A frame never holds the bytes that end a line.  So the files
also split like lines when read: a frame names its dictionary by id, and a file of any size is read by many tasks.

Of pages with equal payloads of at least ``least`` bytes, the one with the smallest id keeps the payload in a
``response`` record; the others are ``revisit`` records that name it and hold no payload.  Which page that is
comes from aggregates over narrow rows.  Where few payloads repeat, that is broadcast; else pages meet it in a join
that spreads frequent payloads.  Payloads are equal where their SHA-256 are.

Defined results: a null payload is an empty one; a null id is larger than any other; rows that repeat an id and its
payload are settled by url (null last), and where that repeats as well one of them is the response and the others
revisit it; an empty table gives archives without pages; other columns are ignored.  A url is written with
blanks and control characters percent-encoded; a null or empty one has no header and reads null.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.operators.order import HOT_COPIES, HOT_SHARE, skew_join
from promptloom.session import cut

#: Fixed values of the format: what a frame and the frames to pass over begin with.
DICTIONARY_MAGIC, PASSED_MAGIC = 0x184D2A5D, 0x184D2A50
ENDING = struct.pack("<II", PASSED_MAGIC, 0)

#: The dictionary is built from the beginnings of about this many pages (twice as many at most), each of so many
#: bytes at most, and is no larger than this.  It bears on the size of the archives alone.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 1_000, 16_384, 65_536
#: Dictionaries a reader takes at once; a folder written by one call has one.
MOST_DICTIONARIES = 1_000
#: Bytes of payload in one Arrow batch of a reader, plus one record.
READ_BYTES = 16 << 20
LEVEL = 6
DATE = "2000-01-01T00:00:00Z"
#: Under a name that ends in .zst or .zstd, as other tools expect it, Spark's readers would undo the compression of a
#: whole file as one stream, without its dictionary.  So .zst is added when a file is handed over.
SUFFIX = ".warc"
RESPONSE, REVISIT = "response", "revisit"
#: Payloads that repeat, and bytes of their first pages' urls, up to which they are sent to every executor: rows of a
#: digest, an id and a url.
FEW, FEW_BYTES = 100_000, 16 << 20

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"

Batches = Iterator[pa.RecordBatch]


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of bytes as 32 upper-case letters and digits of base 32: five hex digits are four of these."""
    groups = [F.lpad(F.conv(F.substring(F.sha1(payload), 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _url(url: str | None) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) <= 32 or ord(c) == 127 else c for c in url or "")


def _uuid(*parts) -> str:
    digits = hashlib.sha1("\n".join(map(str, parts)).encode()).hexdigest()
    return f"<urn:uuid:{digits[:8]}-{digits[8:12]}-5{digits[13:16]}-8{digits[17:20]}-{digits[20:32]}>"


def _header(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [f"{name}: {value}" for name, value in fields if value not in (None, "")]
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"])
    return head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record(page_id, url, digest: str, size: int, payload: bytes | None, first_id, first_url, copy: int = 0, date: str = DATE) -> bytes:
    """One record; without ``payload`` a revisit of the page ``first_id``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    url, first_url, kind = _url(url), _url(first_url), REVISIT if payload is None else RESPONSE
    name = _uuid(kind, page_id, url, digest, copy)
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", date),
        ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Page-ID", page_id),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if payload is None:
        fields += [
            ("WARC-Profile", PROFILE), ("WARC-Refers-To", _uuid(RESPONSE, first_id, first_url, digest, 0)),
            ("WARC-Refers-To-Target-URI", first_url), ("Refers-To-Page-ID", first_id),
        ]
    return _header(fields, http + (payload or b""))


def compress(data: bytes, compressor: zstandard.ZstdCompressor) -> bytes:
    """``data`` as one frame without ``ENDING`` in it.

    Bytes that do not compress stand in a frame as they are, so a record that holds the ending may too.  Then
    a block of the frame is ended inside each place.
    """
    frame = compressor.compress(data)
    for inside in (4, 3, 5, 2, 6, 1, 7):
        if ENDING not in frame:
            return frame
        piecewise, made, at = compressor.compressobj(size=len(data)), [], 0
        while (found := data.find(ENDING, at)) >= 0:
            made += [piecewise.compress(data[at : found + inside]), piecewise.flush(zstandard.COMPRESSOBJ_FLUSH_BLOCK)]
            at = found + inside
        frame = b"".join([*made, piecewise.compress(data[at:]), piecewise.flush()])
    raise ValueError("the frame holds the bytes that end it")


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> zstandard.ZstdCompressionDict:
    """Trained from records, with bare headers beside them where they are too few or too alike for that.

    Its id is made from its content, so that frames tell dictionaries apart.
    """
    bare = [record(k, f"https://host-{k % 7}.example/{k}", f"{k:032d}", k, None if k % 2 else b"", k, None) for k in range(300)]
    try:
        content = zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        content = zstandard.train_dictionary(size // 16, samples[:100] + bare).as_bytes()
    mark = 32_768 + int.from_bytes(hashlib.sha256(content).digest()[:3], "little")
    content = content[:4] + struct.pack("<I", mark) + content[8:]
    if ENDING in content:
        return build_dictionary([s.replace(ENDING[:4], b"") for s in samples], size)
    return zstandard.ZstdCompressionDict(content)


def dictionary_frame(content: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content


def _pages(pages: DataFrame, id_column: str, url_column: str, payload_column: str) -> DataFrame:
    payload = F.coalesce(F.col(payload_column).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_column).cast("bigint").alias("page_id"), F.col(url_column).cast("string").alias("url"), payload.alias("payload"))
    return rows.withColumns({"key": F.sha2("payload", 256), "size": F.octet_length("payload").cast("bigint")})


def _first_pages(rows: DataFrame, least: int) -> DataFrame:
    """``key, first, own, rows`` of each payload that repeats: its smallest page, how often that stands there, and
    how many rows have the payload."""
    place = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", F.col("url").isNull().alias("no_url"), "url", "own")
    same = rows.filter(F.col("size") >= least).groupBy("key", "page_id", "url").agg(F.count(F.lit(1)).alias("own"))
    found = same.groupBy("key").agg(F.min(place).alias("first"), F.sum("own").alias("rows")).filter("rows > 1")
    return found.select("key", F.struct("first.page_id", "first.url").alias("first"), "first.own", "rows")


def _with_first(rows: DataFrame, firsts: DataFrame, few: bool, repeated: int) -> DataFrame:
    """Each row with ``first`` and ``own``, null where its payload does not repeat."""
    narrow = firsts.select("key", "first", "own")
    if few:
        return rows.join(F.broadcast(narrow), "key", "left")
    # of the repeated rows more than that share: HOT_SHARE payloads at most
    hot = F.broadcast(firsts.filter(F.col("rows") * HOT_SHARE > repeated).select("key", F.lit(HOT_COPIES).alias("copies")))
    copies = F.coalesce("copies", F.lit(1))
    spread = rows.join(hot, "key", "left").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), copies).cast("int"))
    copied = narrow.join(hot, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), copies - 1)))
    return spread.drop("copies").join(copied.drop("copies"), ["key", "salt"], "left").drop("salt")


def _once(same: DataFrame) -> DataFrame:
    """Of rows alike in every column one with the payload, the others without; each task makes a stretch of them."""
    stretch = 10_000
    one = same.groupBy("page_id", "url", "digest", "size", "first", "own").agg(F.first("payload").alias("payload"))
    kept = one.drop("own").withColumn("copy", F.lit(0).cast("bigint"))
    begins = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("own") - 1, F.lit(stretch).cast("bigint")))
    others = one.drop("payload").withColumn("begin", begins).repartition("digest", "begin")
    last = F.least(F.col("own"), F.col("begin") + stretch) - 1
    others = others.withColumn("copy", F.explode(F.sequence(F.col("begin"), last))).drop("own", "begin")
    return kept.unionByName(others, allowMissingColumns=True)


def to_records(rows: DataFrame, least: int) -> DataFrame:
    """``page_id, url, digest, size, payload, first_id, first_url, copy`` of ``_pages``; a revisit has no ``payload``."""
    rows = rows.withColumn("digest", base32_sha1(F.col("payload")))
    firsts = cut(_first_pages(rows.drop("digest"), least))
    urls = F.sum(F.coalesce(F.octet_length("first.url"), F.lit(0)).cast("bigint"))
    state = firsts.agg(F.count(F.lit(1)).alias("n"), urls.alias("urls"), F.sum("rows").alias("rows"), F.max("own").alias("own")).first()
    few = state.n <= FEW and (state.urls or 0) <= FEW_BYTES
    joined = _with_first(rows.filter(F.col("size") >= least), firsts, few, state.rows or 0)
    is_first = F.col("page_id").eqNullSafe(F.col("first.page_id")) & F.col("url").eqNullSafe(F.col("first.url"))
    joined = joined.withColumn("is_first", F.col("first").isNull() | is_first)
    kept = F.when(F.col("is_first"), F.col("payload")).alias("payload")
    columns, no_copy = ["page_id", "url", "digest", "size"], F.lit(0).cast("bigint").alias("copy")
    if (state.own or 1) == 1:
        made = joined.select(*columns, kept, "first", no_copy)
    else:
        again = F.col("is_first") & F.coalesce(F.col("own") > 1, F.lit(False))
        made = joined.filter(~again).select(*columns, kept, "first", no_copy)
        made = made.unionByName(_once(joined.filter(again).select(*columns, "payload", "first", "own")))
    if least > 0:
        small = rows.filter(F.col("size") < least).select(*columns, "payload", no_copy)
        made = made.unionByName(small, allowMissingColumns=True)
    return made.select(*columns, "payload", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"), "copy")


def _samples(rows: DataFrame) -> list[bytes]:
    """Records of the beginnings of about SAMPLE_PAGES pages, chosen by a hash."""
    every = max(1, rows.count() // SAMPLE_PAGES)
    chosen = rows.filter(F.pmod(F.xxhash64("page_id", "url"), F.lit(every)) == 0)
    some = chosen.select("page_id", "url", F.substring("payload", 1, SAMPLE_BYTES).alias("payload")).limit(2 * SAMPLE_PAGES).collect()
    digest = lambda p: base64.b32encode(hashlib.sha1(p).digest()).decode()
    return [record(r.page_id, r.url, digest(r.payload), len(r.payload), bytes(r.payload), None, None) for r in some]


def _framing(shipped, date: str):
    """Frames of one archive: the dictionary, what the archive is, then the records."""

    def run(batches: Batches) -> Batches:
        content = shipped.value
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(content))
        info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", _uuid("warcinfo", TaskContext.get().partitionId(), hashlib.sha256(content).hexdigest())),
                ("WARC-Date", date), ("Content-Type", "application/warc-fields")]
        first = _header(info, b"software: promptloom\r\nformat: WARC File Format 1.1\r\n")
        yield pa.record_batch([pa.array([dictionary_frame(content), compress(first, compressor)], pa.binary())], names=["frame"])
        for batch in batches:
            page_ids, urls, digests, sizes, payloads, first_ids, first_urls, copies = batch.columns
            values = zip(page_ids, urls, digests, sizes, payloads, first_ids, first_urls, copies, strict=True)
            frames = (compress(record(*(v.as_py() for v in row), date), compressor) for row in values)
            yield pa.record_batch([pa.array(frames, pa.binary())], names=["frame"])

    return run


def _rename(spark: SparkSession, folder: str) -> None:
    """The sink's names end in .txt; readers here take either name, so a break in between does no harm."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.listStatus(place):
        name = status.getPath().getName()
        if name.endswith(".txt"):
            target = spark._jvm.org.apache.hadoop.fs.Path(place, name[: -len(".txt")] + SUFFIX)
            if not files.rename(status.getPath(), target):
                raise OSError(f"cannot rename {status.getPath()}")


def write_archives(
    pages: DataFrame, folder: str, *, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html",
    least: int = 0, date: str = DATE,
) -> None:
    """A record for each page in ``*.warc`` files of a new ``folder``, one file a task."""
    spark = pages.sparkSession
    rows = _pages(pages, id_column, url_column, payload_column)
    dictionary = build_dictionary(_samples(rows)).as_bytes()
    shipped = spark.sparkContext.broadcast(dictionary)  # DICTIONARY_BYTES at most
    frames = to_records(rows, least).mapInArrow(_framing(shipped, date), "frame binary")
    lines = frames.select(F.col("frame").cast("string").alias("value"))
    lines.write.mode("errorifexists").option("lineSep", ENDING.decode("ascii")).text(folder)
    _rename(spark, folder)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}


def parse(data: bytes) -> tuple | None:
    """A response or revisit as a row of RECORD, None for another record; a payload that is not its digest's is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    kind = fields["warc-type"]
    if kind not in (RESPONSE, REVISIT):
        return None
    length = int(fields["content-length"])
    block, after = rest[:length], rest[length:]
    if len(block) < length or after != b"\r\n\r\n":
        raise ValueError("a record is not as long as it states")
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == RESPONSE and (len(payload) != stated or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError("a payload is not the one its record states")
    page, first = (None if fields.get(k) is None else int(fields[k]) for k in ("page-id", "refers-to-page-id"))
    return page, fields.get("warc-target-uri"), kind, first, stated, digest, payload if kind == RESPONSE else None


def _reading(shipped):
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Batches) -> Batches:
        known = {d.dict_id(): zstandard.ZstdDecompressor(dict_data=d) for d in map(zstandard.ZstdCompressionDict, shipped.value)}
        rows, held = [], 0
        for batch in batches:
            for frame in batch.column(0):
                data = frame.as_py()
                parsed = parse(known[zstandard.get_frame_parameters(data).dict_id].decompress(data))
                if parsed:
                    rows.append(parsed)
                    held += len(parsed[-1] or b"") + 200
                if held > READ_BYTES:
                    yield made(rows)
                    rows, held = [], 0
        if rows:
            yield made(rows)

    return run


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The pages' records of the archives in ``folder``, as RECORD; a revisit's ``payload`` is null, its size and digest are the
    full payload's."""
    frame = F.col("value").cast("binary")
    lines = spark.read.option("lineSep", ENDING.decode("ascii")).text(folder).select(frame.alias("frame"))
    is_dictionary = F.substring("frame", 1, 4) == F.lit(struct.pack("<I", DICTIONARY_MAGIC))
    content = F.expr("substring(frame, 9)").alias("content")
    found = lines.filter(is_dictionary).select(content).distinct().limit(MOST_DICTIONARIES + 1).collect()
    if len(found) > MOST_DICTIONARIES:
        raise ValueError(f"more than {MOST_DICTIONARIES} dictionaries; read fewer archives at a time")
    shipped = spark.sparkContext.broadcast([bytes(r.content) for r in found])
    return lines.filter(~is_dictionary & (F.octet_length("frame") > 0)).mapInArrow(_reading(shipped), RECORD)


def with_payloads(records: DataFrame) -> DataFrame:
    """The records with the payload of each revisit filled in from the response of its digest.

    One payload goes to all its revisits, so this writes what the archives saved; frequent payloads are spread."""
    stored = records.filter(F.col("record_type") == RESPONSE).groupBy("payload_digest").agg(F.first("payload").alias("stored"))
    return skew_join(records, stored, ["payload_digest"], ["page_id", "url"], "left").withColumn(
        "payload", F.coalesce("payload", "stored")
    ).drop("stored").select(*records.columns)
