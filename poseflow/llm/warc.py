"""WARC archives of pages with repeated payloads resolved to revisit records, written and read by Spark."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import Scratch

#: Fixed values of the format.
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Headers of our own: the page's id, and that of the page a revisit refers to, in the form of a URL's query.
PAGE, REFERS_TO_PAGE = "X-Page-ID", "X-Refers-To-Page-ID"
#: Date of records that come without one.
NO_DATE = "1970-01-01T00:00:00Z"


def with_payload(pages: DataFrame, id_col: str, url_col: str, html_col: str, date_col: str | None = None) -> DataFrame:
    """page_id, url, date, payload (null html: empty), payload_bytes and payload_digest."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    date = F.date_format(F.col(date_col).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'") if date_col else F.lit(None).cast("string")
    out = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), date.alias("date"), payload.alias("payload"))
    return out.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2(F.col("payload").cast("binary"), 256)})


def resolve_revisits(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date_col: str | None = None, least_bytes: int = 100
) -> DataFrame:
    """page_id, url, date, payload, payload_bytes, payload_digest, record_type, refers_to, record_id and refers_id.

    Of the records whose payloads are equal and have `least_bytes` or more, that with the smallest id is the
    response, and the others are revisits that refer to it. Headers alone (digest and id) are grouped, with partial sums
    before the shuffle; the originals of repeated payloads are a saved table that the pages join by digest, so that
    a payload that a third of the pages share is a skewed join, which adaptive execution splits.

    record_id is that of an original that is referred to, and refers_id the same on its revisits; all other records get theirs when
    they are written. Null html is an empty payload. Rows that repeat the original's id are responses too, and as none of these is the one
    original, record_id and refers_id are null there; a row without an id is a revisit if any row with the payload has an id. A null date stays
    null. An empty table gives no rows. Other columns are not read.
    """
    scratch = Scratch(pages.sparkSession, "revisits")
    records = with_payload(pages, id_col, url_col, html_col, date_col)
    heads = records.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "page_id").agg(F.count("*").alias("n"))
    first = heads.groupBy("payload_digest").agg(F.min("page_id").alias("original"), F.min_by("n", "page_id").alias("same"), F.sum("n").alias("n"))
    # An id as a UUID, made of the digest and the page's id.
    name = F.md5(F.concat_ws("/", F.col("original").cast("string"), "payload_digest"))
    name = F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")
    originals = first.where("n > 1 and original is not null").select("payload_digest", "original", F.when(F.col("same") == 1, name).alias("name"))
    joined = records.join(scratch.save(originals, "originals"), "payload_digest", "left")
    revisit = F.col("original").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("original")))
    return joined.select(
        "page_id", "url", "date", "payload", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("original")).alias("refers_to"), F.when(~revisit, F.col("name")).alias("record_id"), F.when(revisit, F.col("name")).alias("refers_id"),
    )


def _headers_and_block() -> Column:
    """A record without its first line and WARC-Record-ID, and without the two line ends that close it."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\x00-\x20\x7F]", "%20"), F.lit(CRLF)), F.lit(""))
    # Ids return as they were, whatever characters they hold.
    named = lambda name, value: line(name, F.url_encode(value.cast("string")))
    return F.concat(
        line("WARC-Type", F.col("record_type")), line("WARC-Date", F.coalesce("date", F.lit(NO_DATE))), line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")), line("WARC-Profile", F.when(revisit, F.lit(PROFILE))), line("WARC-Refers-To", F.col("refers_id")),
        named(PAGE, F.col("page_id")), named(REFERS_TO_PAGE, F.col("refers_to")), F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"),
        line("Content-Length", (F.octet_length(http) + F.octet_length(body)).cast("string")), F.lit(CRLF), http, body,
    )


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(resolved: DataFrame, path: str, software: str = "poseflow") -> None:
    """Writes one archive per task, `part-*.warc.gz`: a warcinfo record, then a record per row, each a gzip member of its own.

    Spark's text writer puts the bytes down, so that its commit protocol and any store that Spark knows serve. It ends each value
    with a separator, which is the last byte of the member: the zero that is the high byte of the record's size. A record of 16 MiB or
    more, whose size has another high byte, is followed by an empty member, which ends in zeros. The files are renamed when all are there.
    """
    spark, run_id = resolved.sparkSession, uuid.uuid4()

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId(), 0

        def record(record_id: str | None, rest: bytes) -> bytes:
            nonlocal count
            name = record_id or f"<urn:uuid:{uuid.uuid5(run_id, f'{task}/{count}')}>"
            count += 1
            out = _member(f"WARC/1.1{CRLF}WARC-Record-ID: {name}{CRLF}".encode() + rest + b"\r\n\r\n")
            return out[:-1] if not out[-1] else out + _member(b"")[:-1]

        info = f"software: {software}{CRLF}format: WARC File Format 1.1{CRLF}".encode()
        head = f"WARC-Type: warcinfo{CRLF}WARC-Date: {NO_DATE}{CRLF}Content-Type: application/warc-fields{CRLF}Content-Length: {len(info)}{CRLF * 2}".encode()
        for batch in batches:
            out = [record(None, head + info)] if not count else []
            out += [record(name, rest.as_buffer().to_pybytes()) for name, rest in zip(batch.column(0).to_pylist(), batch.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    packed = resolved.select("record_id", _headers_and_block().alias("rest")).mapInArrow(members, "value binary")
    packed.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").text(path)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for file in store.listStatus(folder):
        name = file.getPath().getName()
        if name.endswith(".txt") and not store.rename(file.getPath(), jvm.org.apache.hadoop.fs.Path(folder, name.removesuffix(".txt") + ".warc.gz")):
            raise OSError(f"{name} could not be renamed")


class _Stream:
    """Bytes in pieces, of which an exact number can be taken."""

    def __init__(self):
        self.pieces: list[bytes] = []
        self.size = 0

    def add(self, piece: bytes) -> None:
        self.pieces.append(piece)
        self.size += len(piece)

    def whole(self) -> bytes:
        if len(self.pieces) > 1:
            self.pieces = [b"".join(self.pieces)]
        return self.pieces[0] if self.pieces else b""

    def drop(self, n: int) -> None:
        rest = self.whole()[n:]
        self.pieces, self.size = ([rest] if rest else []), len(rest)


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a stream that comes cut after each CRLF CRLF."""
    stream, head, needed = _Stream(), None, 0
    for piece in pieces:
        stream.add(piece)
        while True:
            if head is None:
                data = stream.whole()
                start = len(data) - len(data.lstrip(b"\r\n"))
                end = data.find(b"\r\n\r\n", start)
                if start == len(data) or end < 0:
                    break
                lines = data[start:end].decode("utf-8", "replace").split(CRLF)
                head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                needed = int(head.get("content-length", 0))
                stream.drop(end + 4)
            if stream.size < needed + 4:  # the record's own closing line ends too
                break
            block = stream.whole()[:needed]
            stream.drop(needed + 4)
            yield head, block
            head = None


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """A row per response or revisit: record_id, record_type, url, date, page_id, refers_to, refers_id, payload_bytes, payload_digest (and payload).

    Archives are compressed, so a file is read by one task, as a stream cut at each CRLF CRLF; records end by their
    Content-Length, so a payload may hold that. A task holds a record at a time. Digests of responses are computed
    from the payload read; one that differs from its header is an error. A revisit's length and digest are its headers'. page_id and refers_to are
    null where a record lacks our headers.
    """
    columns = ["record_id", "record_type", "url", "date", "page_id", "refers_to", "refers_id", "payload_bytes", "payload_digest", *(["payload"] if payload else [])]
    kinds = [*[pa.string()] * 7, pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[bytes]:
            for batch in batches:
                for value in batch.column(0):
                    yield value.as_py() + b"\r\n\r\n"

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows), kinds)], names=columns)

        out, size = [], 0
        for head, block in records(pieces()):
            kind = head.get("warc-type")
            if kind not in ("response", "revisit"):
                continue
            http, _, body = block.partition(b"\r\n\r\n")
            said = head.get("warc-payload-digest", "").removeprefix("sha256:")
            length = len(body)
            if kind == "revisit":
                length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
            elif (found := hashlib.sha256(body).hexdigest()) != said:
                raise ValueError(f"{head.get('warc-record-id')}: payload digest {found}, in its header {said}")
            ids = [None if (x := head.get(name.lower())) is None else unquote_plus(x) for name in (PAGE, REFERS_TO_PAGE)]
            plain = [head.get(x) for x in ("warc-target-uri", "warc-date")]
            out.append((head.get("warc-record-id"), kind, *plain, *ids, head.get("warc-refers-to"), length, said, *([body] if payload else [])))
            size += len(body)
            if len(out) >= 2000 or payload and size > 1 << 24:
                yield batch_of(out)
                out, size = [], 0
        if out:
            yield batch_of(out)

    lines = spark.read.option("lineSep", CRLF * 2).text(path).select(F.col("value").cast("binary").alias("value"))
    return lines.mapInArrow(run, ", ".join(f"{c} {'long' if c == 'payload_bytes' else 'binary' if c == 'payload' else 'string'}" for c in columns))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date_col: str | None = None) -> DataFrame:
    """Writes deduplicated archives of the pages to the shared folder, and reads them back without payloads: the id, payload_bytes,
    payload_digest, record_type, refers_to and date."""
    path = Scratch(pages.sparkSession, "warc").path("archives")
    write_archives(resolve_revisits(pages, id_col, url_col, html_col, date_col), path)
    kind = pages.schema[id_col].dataType
    back = read_archives(pages.sparkSession, path, payload=False)
    return back.select(F.col("page_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "date")
