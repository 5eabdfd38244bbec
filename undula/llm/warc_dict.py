"""WARC archives in which every record is a Zstandard frame of its own, sharing one dictionary.

The dictionary is fitted on a bounded sample of the records to be archived: whole records in the
order of a hash of their key, at most ``SAMPLE_RECORDS`` and ``SAMPLE_BYTES``. Each archive starts
with a skippable frame (0x184D2A5D) holding the dictionary, so it can be read alone.

Archives are written by Spark's own file writer and committer: a row is a frame, and the separator
that the writer puts after each row is an empty skippable frame, which readers of .zst files pass
over. Nothing but Spark touches the file system, so any shared store will do and lost tasks repeat.

Records with equal payloads of ``MIN_REVISIT`` bytes or more: the one with the largest page_id is a
response, the others are revisits of it without a body; smaller ones are all responses.

Defined cases: a null html is an empty payload; a null page_id is smaller than any other and is read
back as null; a null url leaves its header out; rows that share the largest page_id and the payload
are all responses; if all page_ids of a group are null, all are responses; an empty table gives no
archive rows. Control characters and spaces in a url are percent-encoded.
"""

from __future__ import annotations

import base64
import struct

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.llm.common import attach, cut_lineage, scratch

MIN_REVISIT = 1000
SAMPLE_RECORDS = 300
SAMPLE_BYTES = 2 << 20
DICT_BYTES = 64 << 10
DICT_MAGIC = 0x184D2A5D
#: An empty skippable frame, written as the separator of rows.
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
LEVEL = 3
#: Payload bytes of one archive; the number of archives follows from it.
ARCHIVE_BYTES = 16 << 20
DATE = "1970-01-01T00:00:00Z"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def payloads(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_bytes and payload_digest."""
    html = F.coalesce("html", F.lit(""))
    return pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"),
                        F.sha1(html.cast("binary")).alias("payload_digest"))


def revisits(pages: DataFrame) -> DataFrame:
    """page_id, payload_digest, refers_to of the revisits, each pair once; no html leaves the scan."""
    slim = payloads(pages).filter(F.col("payload_bytes") >= MIN_REVISIT).select("page_id", "payload_digest")
    groups = slim.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
    groups = cut_lineage(groups.filter("n > 1 and refers_to is not null"))
    found = attach(slim, groups, "payload_digest", "n").filter("refers_to is not null")
    return found.filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "payload_digest", "refers_to").distinct()


def dealt_records(pages: DataFrame, archives: int) -> DataFrame:
    """``payloads`` with record_type and refers_to, dealt out to ``archives`` tasks.

    Both sides are dealt by the same hash and joined by nothing else, so the one shuffle that brings the
    html to its archive also brings the decisions to the html; these are the smaller side and are
    hashed, so html is not sorted. The few decisions of one hash are told apart afterwards.
    """
    place = F.xxhash64("page_id", "payload_digest").alias("place")
    whole = payloads(pages).select("*", place).repartition(archives, "place")
    one = F.struct(F.col("page_id").alias("of"), F.col("payload_digest").alias("same"), "refers_to")
    known = revisits(pages).select(place, one.alias("one")).repartition(archives, "place")
    known = known.groupBy("place").agg(F.collect_list("one").alias("known"))
    found = whole.join(known.hint("shuffle_hash"), "place", "left")
    own = F.filter("known", lambda k: k["of"].eqNullSafe(F.col("page_id")) & (k["same"] == F.col("payload_digest")))
    refers = F.when(F.col("payload_bytes") >= MIN_REVISIT, F.get(own, F.lit(0))["refers_to"])
    found = found.withColumn("refers_to", refers)
    kind = F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type")
    html = F.when(F.col("refers_to").isNull(), F.col("html")).alias("html")
    return found.select("page_id", "url", html, "payload_bytes", "payload_digest", kind, "refers_to")


def fit_dictionary(pages: DataFrame) -> bytes:
    """The dictionary, fitted in one task on the bounded sample; b"" if too little is there."""
    chosen = pages.filter("html is not null").select("html", F.xxhash64("page_id", "url").alias("h"))
    chosen = chosen.orderBy("h").limit(SAMPLE_RECORDS).select("html").coalesce(1)

    def fit(batches):
        samples, left = [], SAMPLE_BYTES
        for frame in batches:
            for html in frame["html"]:
                data = html.encode("utf-8", "surrogatepass")
                if data and len(data) <= left:
                    samples.append(data)
                    left -= len(data)
        try:
            made = zstandard.train_dictionary(DICT_BYTES, samples, k=256, d=8) if len(samples) > 7 else None
        except zstandard.ZstdError:
            made = None
        yield pd.DataFrame({"data": [made.as_bytes() if made else b""]})

    rows = chosen.mapInPandas(fit, "data binary").collect()
    return bytes(rows[0]["data"]) if rows else b""


def _url(url: str) -> str:
    return "".join(c if ord(c) > 32 and ord(c) != 127 else f"%{ord(c):02X}" for c in url)


def _record(row) -> bytes:
    digest = base64.b32encode(bytes.fromhex(row.payload_digest)).decode()
    body = b"" if row.record_type == "revisit" else row.html.encode("utf-8", "surrogatepass")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {int(row.payload_bytes)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {row.record_type}"]
    if row.page_id is not pd.NA:
        head.append(f"WARC-Record-ID: <urn:page:{row.page_id}>")
    if row.url is not None:
        head.append(f"WARC-Target-URI: {_url(row.url)}")
    if row.record_type == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{row.refers_to}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
             f"Content-Length: {len(http) + len(body)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + http + body + b"\r\n\r\n"


def write_archives(pages: DataFrame, path: str) -> None:
    """Write ``pages`` (page_id, url, html) as archives into the folder ``path``."""
    dictionary = fit_dictionary(pages)

    def frames(batches):
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True)
        lead = struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary
        for frame in batches:
            if len(frame):
                frame = frame.astype({"page_id": "Int64", "refers_to": "Int64"})
                out = [packer.compress(_record(row)) for row in frame.itertuples(index=False)]
                yield pd.DataFrame({"frame": [lead, *out] if lead else out})
                lead = None

    size = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    dealt = dealt_records(pages, max(1, -(-size // ARCHIVE_BYTES)))
    written = dealt.mapInPandas(frames, "frame binary").select(F.col("frame").cast("string").alias("value"))
    written.write.option("lineSep", SEPARATOR).text(path)


def read_frames(data: bytes):
    """Decompressed frames of one archive, in order; the leading frame gives the dictionary."""
    view, at, shared = memoryview(data), 0, None
    while at < len(view):
        magic, size = struct.unpack_from("<II", view, at)
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            if magic == DICT_MAGIC and at == 0 and size:
                shared = zstandard.ZstdCompressionDict(bytes(view[8 : 8 + size]))
            at += 8 + size
            continue
        step = zstandard.ZstdDecompressor(dict_data=shared).decompressobj() if shared else zstandard.ZstdDecompressor().decompressobj()
        out = []
        while not step.eof:
            if at >= len(view):
                raise ValueError("an archive ends inside a frame")
            piece = view[at : at + 4096]
            out.append(step.decompress(piece))
            at += len(piece)
        at -= len(step.unused_data)
        yield b"".join(out)


def _parsed(record: bytes) -> tuple:
    head, _, block = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    length = next(int(x[16:]) for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))
    number = lambda name: int(fields[name][10:-1]) if name in fields else None
    revisit = fields["WARC-Type"] == "revisit"
    return (number("WARC-Record-ID"), fields.get("WARC-Target-URI"), length,
            base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex(), fields["WARC-Type"],
            number("WARC-Refers-To"), None if revisit else body)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below ``path``."""
    names = [c.split(" ")[0] for c in READ.split(", ")]

    def parse(batches):
        for frame in batches:
            for data in frame["content"]:
                rows = []
                for record in read_frames(data):
                    rows.append(_parsed(record))
                    if len(rows) == 500:
                        yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(parse, READ)


def archive(pages: DataFrame) -> DataFrame:
    """Writes the archives to a scratch folder and reads them back, payloads included."""
    path = scratch(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
