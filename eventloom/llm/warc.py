"""WARC archives with dictionary compression: one Zstandard frame a record, and a leading skippable frame with the dictionary.

A page is a response record, or, where another page with an equal payload has a smaller id, a revisit record that names that page. Equal payloads
are found by SHA-1 and length: ids are aggregated before the shuffle, and only payloads that occur more than once are joined with the pages. That
table is written first, so Spark knows its size: a small one is sent out and no page is shuffled; else both sides are shuffled, and a payload that
very many pages share is split by the skew join.

Tasks write archives of bounded size straight to the shared folder, through the file system that its URI names. Each archive trains its
dictionary on its own records. The names hold the attempt of the task, and the manifest, which Spark commits, lists those of attempts that
succeeded: what a lost executor or a second attempt leaves is in no manifest, and remove_strays() deletes it. Reading streams the archives of a
manifest record by record and checks the digests.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, raw, shared_dir, tidy

#: a skippable frame that holds a dictionary, and the frames and dictionaries of Zstandard
SKIPPABLE, FRAME, DICTIONARY = b"\x5d\x2a\x4d\x18", b"\x28\xb5\x2f\xfd", b"\x37\xa4\x30\xec"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
ARCHIVE_BYTES, DICTIONARY_BYTES, SAMPLE, LEVEL, CHUNK = 16 << 20, 64 << 10, 64, 3, 1 << 20
MANIFEST = "path string, records long, raw_bytes long, bytes long, dictionary_bytes long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def digest_name(sha: bytes) -> str:
    return base64.b32encode(sha).decode()


def record_id(page_id: int | None, sha: bytes) -> str:
    """URN of a record, from its page and payload, so that a revisit can name the record that it refers to."""
    return f"<{uuid.UUID(bytes=hashlib.sha256(b'%s/%s' % (str(page_id).encode(), sha)).digest()[:16], version=5).urn}>"


def _header(fields: list[tuple[str, str]]) -> bytes:
    return b"".join([b"WARC/1.1\r\n", *(f"{k}: {v}\r\n".encode() for k, v in fields), b"\r\n"])


def _safe(url: str) -> str:
    """A url as a header's value: white space, controls and % are escaped."""
    return "".join(c if c > " " and c not in "%\x7f" and c.isprintable() else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def _plain(value: str) -> str:
    parts = value.split("%")
    return b"".join([parts[0].encode(), *(bytes.fromhex(p[:2]) + p[2:].encode() for p in parts[1:])]).decode()


def record(page_id: int | None, url: str | None, payload: bytes, sha: bytes, first: int | None, date: str) -> bytes:
    """One WARC record; first is the page that it repeats, if any. A revisit keeps the HTTP header alone."""
    head = HTTP % len(payload)
    block = head if first is not None else head + payload
    fields = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", record_id(page_id, sha)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", _safe(url)))
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if first is not None:
        fields += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", record_id(first, sha)), ("X-Refers-To-Page-ID", str(first))]
    fields += [
        ("WARC-Payload-Digest", f"sha1:{digest_name(sha)}"), ("WARC-Block-Digest", f"sha1:{digest_name(hashlib.sha1(block).digest())}"),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    return _header(fields) + block + b"\r\n\r\n"


def train(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from records evenly spaced over an archive, of at most SAMPLE times its size; empty where they give none."""
    size = min(size, sum(map(len, records)) // 16)
    step = max(1, sum(map(len, records)) // (SAMPLE * max(1, size)))
    try:
        return zstandard.train_dictionary(size, records[::step], k=512, d=8).as_bytes() if size >= 1024 else b""
    except zstandard.ZstdError:  # too few records, or nothing that they share
        return b""


def compressed(records: list[bytes], info: bytes, level: int = LEVEL) -> tuple[bytes, int]:
    """(archive, bytes of its dictionary): the dictionary in a skippable frame, then a frame for info and for each record."""
    dictionary = train(records)
    out = []
    if dictionary:
        packed = zstandard.compress(dictionary, level)
        out += [SKIPPABLE, len(packed).to_bytes(4, "little"), packed]
    data = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    frame = zstandard.ZstdCompressor(level=level, write_content_size=True, **data).compress
    return b"".join([*out, frame(info), *map(frame, records)]), len(dictionary)


def frames(stream) -> Iterator[bytes]:
    """The decompressed frames of an archive, one at a time; stream is read in chunks."""
    data, reader = stream.read(CHUNK), zstandard.ZstdDecompressor()
    while data:
        while len(data) < 8 and (more := stream.read(CHUNK)):
            data += more
        if data[1:4] == SKIPPABLE[1:] and data[0] & 0xF0 == 0x50:
            size = 8 + int.from_bytes(data[4:8], "little")
            while len(data) < size and (more := stream.read(CHUNK)):
                data += more
            if data[:4] == SKIPPABLE:
                held = data[8:size]
                held = zstandard.decompress(held) if held[:4] == FRAME else held
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
            data = data[size:] or stream.read(CHUNK)
            continue
        one, out = reader.decompressobj(), []
        while True:
            out.append(one.decompress(data))
            if one.eof:
                break
            if not (data := stream.read(CHUNK)):
                raise ValueError("the archive ends within a record")
        data = one.unused_data or stream.read(CHUNK)
        yield b"".join(out)


def parsed(frame: bytes) -> tuple[dict[str, str], bytes]:
    """(fields, block) of a record; its length and digest must be right."""
    head, _, rest = frame.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block, end = rest[: int(fields["Content-Length"])], rest[int(fields["Content-Length"]) :]
    if not version.startswith("WARC/") or end != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    if "WARC-Block-Digest" in fields and fields["WARC-Block-Digest"] != f"sha1:{digest_name(hashlib.sha1(block).digest())}":
        raise ValueError(f"digest of {fields['WARC-Record-ID']}")
    return fields, block


def _writer(folder: str, date: str, most: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pyarrow.fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        held: list[bytes] = []
        size = made = 0

        def flush() -> pa.RecordBatch:
            name = f"pages-{task.partitionId():06d}-{made:05d}-{task.taskAttemptId()}.warc.zst"
            block = b"software: eventloom\r\nformat: WARC File Format 1.1\r\n"
            info = _header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, name.encode())), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(block)))])
            archive, dictionary = compressed(held, info + block + b"\r\n\r\n", level)
            with files.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(archive)
            return pa.record_batch([pa.array([x]) for x in (f"{folder}/{name}", len(held), size, len(archive), dictionary)], ["path", "records", "raw_bytes", "bytes", "dictionary_bytes"])

        for batch in batches:
            ids, urls, firsts = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("page_id", "url", "first_id"))
            shas = batch.column(batch.schema.get_field_index("sha"))
            html = batch.column(batch.schema.get_field_index("html")).cast(pa.binary())
            for k, page_id in enumerate(ids):
                first = None if firsts[k] is None or firsts[k] == page_id else firsts[k]
                one = record(page_id, urls[k], html[k].as_py(), bytes.fromhex(shas[k].as_py()), first, date)
                held.append(one)
                size += len(one)
                if size >= most:
                    yield flush()
                    held, size, made = [], 0, made + 1
        if held:
            yield flush()

    return run


def write(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL) -> DataFrame:
    """Archives of pages (page_id, url, html) in folder, a new shared one by default → their manifest.

    Of payloads equal in all bytes and of at least least_bytes, that with the smallest page_id is response and the others are revisits of it.
    Null html is empty; a null url gives no Target-URI; a row without page_id is always a response and nothing refers to it; rows that repeat
    id and payload have the same type; an empty table gives no archive; other columns don't matter. A record longer than archive_bytes has an archive to
    itself or ends one; a task holds one archive and one page.
    """
    spark = pages.sparkSession
    folder = folder or shared_dir(spark)
    files, root = pyarrow.fs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary"))).withColumn("n", F.octet_length("html").cast("long"))
    same = rows.where((F.col("n") >= least_bytes) & F.col("page_id").isNotNull()).groupBy("sha", "n").agg(F.min("page_id").alias("first_id"), F.count("*").alias("k"))
    same = materialise(same.where("k > 1").drop("k"))
    known = F.when(F.col("page_id").isNotNull(), F.col("first_id")).alias("first_id")
    rows = rows.join(same, ["sha", "n"], "left").select("page_id", "url", "html", "sha", known)
    manifest = materialise(rows.mapInArrow(tidy(_writer(folder, date, archive_bytes, level)), MANIFEST))
    discard(same)
    return manifest


def remove_strays(manifest: DataFrame, folder: str) -> int:
    """Delete the archives in folder that the manifest does not list; the number of them."""
    files, root = pyarrow.fs.FileSystem.from_uri(folder)
    there = [x.base_name for x in files.get_file_info(pyarrow.fs.FileSelector(root)) if x.base_name.endswith(".warc.zst")]
    found = manifest.sparkSession.createDataFrame([(n,) for n in there], "name string")
    listed = manifest.select(F.element_at(F.split("path", "/"), -1).alias("name"))
    strays = [r.name for r in found.join(listed, "name", "left_anti").collect()]
    for name in strays:
        files.delete_file(f"{root}/{name}")
    return len(strays)


def _row(fields: dict[str, str], block: bytes, payload: bool) -> tuple:
    head, _, body = block.partition(b"\r\n\r\n")
    length = next(int(line[15:]) for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(body) != length or digest_name(hashlib.sha1(body).digest()) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']}")
    number = {k: int(fields[k]) if k in fields else None for k in ("X-Page-ID", "X-Refers-To-Page-ID")}
    url = _plain(fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields else None
    kept = body if payload and fields["WARC-Type"] == "response" else None
    return number["X-Page-ID"], url, fields["WARC-Type"], number["X-Refers-To-Page-ID"], digest, length, kept


def read(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """The page records of the archives of a manifest: page_id, url, record_type, refers_to, payload_digest, payload_bytes and payload (of responses).

    Digest and bytes are of the full payload, for revisits too. A task streams its archives; a record with a wrong length or digest is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORDS.split(", ")]
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())

        def told(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[k] for r in rows], kinds[k]) for k in range(7)], names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, where = pyarrow.fs.FileSystem.from_uri(path)
                rows: list[tuple] = []
                size = 0
                with files.open_input_stream(where, compression=None) as stream:
                    for frame in frames(stream):
                        fields, block = parsed(frame)
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        rows.append(_row(fields, block, payload))
                        size += len(frame)
                        if len(rows) >= 1000 or size >= ARCHIVE_BYTES:
                            yield told(rows)
                            rows, size = [], 0
                yield told(rows)

    places = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(places, "path").mapInArrow(tidy(run), RECORDS)


def opened(archive: bytes) -> list[tuple[dict[str, str], bytes]]:
    """All records of one archive in memory, for looking at it."""
    return [parsed(f) for f in frames(io.BytesIO(archive))]
