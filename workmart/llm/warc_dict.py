"""WARC archives with a Zstandard dictionary.

A dictionary is built from a bounded sample of the records that will be archived. Every archive file begins with a
skippable frame that holds the dictionary; after it, each record is a frame of its own, so that a reader can go to any
record by its offset and needs nothing but the file. Payloads that occur several times are stored once, in the record
with the largest id; the others are revisit records that refer to it.

Files are written by tasks into a folder that all executors share, under a name that depends on their content's place in
the job alone. A task that runs again writes the same file, first under a name of its own and then renamed, so a lost
executor leaves no half archive. A manifest table (file, records, bytes) is the result of writing and the input of
reading; files are rolled at a size, so reading is spread over as many tasks as there are files.

Results for odd inputs: a null payload is an empty one; a null url is `urn:page:<id>`; line ends and other control
characters in a url are percent-encoded; rows that repeat the largest id of a payload are all responses; a payload that
only rows without an id have is a response in each of them; no rows give no files. Extra columns aren't archived.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from workmart.llm.common import sample_rows, store
from workmart.session import shared_folder

#: Fixed values of the format: the dictionary frame's magic number and that of ordinary frames.
DICTIONARY_FRAME, DATA_FRAME = 0x184D2A5D, 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The sample: records at most, and bytes of each at most (the sample only; records are archived whole).
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 32_768, 65_536
#: Bytes of payload after which a file is closed and the next one begun.
ROLL_BYTES = 32 << 20
MANIFEST = "file string, n_records long, n_bytes long"


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    """Any store that a URI names; a bare path is a file path."""
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else "file://" + os.path.abspath(folder))


def _local(folder: str) -> str:
    """`file:/x` as Spark writes it, as `file:///x`."""
    return re.sub(r"^file:/+", "file:///", folder)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'urn:page:' + page)}>"


def _clean(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record. Its block is an HTTP response; a revisit has the response's header alone."""
    name = "" if page is None else str(page)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(name)}", f"WARC-Date: {date}",
             f"WARC-Target-URI: {_clean(url) if url else 'urn:page:' + name}", f"WARC-Page-ID: {name}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(str(refers_to))}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    block = http + (payload if refers_to is None else b"")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"no WARC record: {first[:40]!r}")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record is cut off")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != length or digest(payload) != stated):
        raise ValueError(f"record {fields['WARC-Record-ID']}: the payload isn't what its header states")
    number = lambda k: int(fields[k]) if fields.get(k) else None
    return {"page_id": number("WARC-Page-ID"), "url": fields["WARC-Target-URI"], "payload": payload if fields["WARC-Type"] == "response" else None,
            "payload_bytes": length, "payload_digest": stated, "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To-Page-ID")}


def build_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """Empty where there are too few records to learn from: the files then have no dictionary frame."""
    if len(records) < 16:
        return b""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, records)) // 10)), records).as_bytes()
    except zstandard.ZstdError:
        return b""


def archive_bytes(records: Iterator[bytes], dictionary: bytes) -> Iterator[bytes]:
    """The frames of one archive file."""
    if dictionary:
        yield struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary
    compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)
    for raw in records:
        yield compressor.compress(raw)


def read_frames(stream) -> Iterator[bytes]:
    """The records of an archive, one at a time: the file is never held whole."""
    head, dictionary = stream.read(8), None
    if len(head) == 8 and struct.unpack("<II", head)[0] == DICTIONARY_FRAME:
        dictionary = zstandard.ZstdCompressionDict(stream.read(struct.unpack("<II", head)[1]))
        head = b""
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
    rest = head
    while True:
        if not rest:
            rest = stream.read(1 << 18)
            if not rest:
                return
        one, parts = decompressor.decompressobj(), []
        while True:
            parts.append(one.decompress(rest))
            rest = one.unused_data
            if one.eof:
                break
            rest = stream.read(1 << 18)
            if not rest:
                raise ValueError("an archive is cut off")
        yield b"".join(parts)


def write(pages: DataFrame, folder: str, date: str = "2026-01-01T00:00:00Z", least_bytes: int = 0, payload: str = "html", roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Archive page_id, url and the payload of each row into `folder`; the manifest. Payloads under `least_bytes` never become revisits."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col(f"`{payload}`"), F.lit("")).cast("binary").alias("payload"))
    keyed = rows.withColumn("_key", F.unhex(F.sha2("payload", 256)))
    # only payloads that several rows share are looked up; a frequent one is one small row on this side
    shared = keyed.filter(F.length("payload") >= least_bytes).groupBy("_key").agg(F.max("page_id").alias("_newest"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    joined = keyed.join(shared, "_key", "left")
    refers = F.when(F.col("_newest").isNotNull() & ~F.col("_newest").eqNullSafe(F.col("page_id")), F.col("_newest"))
    ready = joined.select("page_id", "url", "payload", refers.alias("refers_to"))
    sample = sample_rows(rows.select("page_id", "url", F.substring("payload", 1, SAMPLE_BYTES).alias("payload")), ["page_id", "url"], SAMPLE_ROWS, rows.count()).collect()
    dictionary = build_dictionary([record(r["page_id"], r["url"], bytes(r["payload"]), None, date) for r in sample])
    target = _local(folder)
    run = uuid.uuid4().hex[:12]
    file_system(target)[0].create_dir(file_system(target)[1], recursive=True)

    def put(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        store_, base = file_system(target)
        number, buffer, size, count, made = 0, [], 0, 0, []

        def close():
            nonlocal number, buffer, size, count
            name = f"pages-{run}-{context.partitionId():06d}-{number:04d}.warc.zst"
            part = f"{base}/{name}.{context.taskAttemptId()}.part"
            written = 0
            with store_.open_output_stream(part) as out:
                for frame in archive_bytes(iter(buffer), dictionary):
                    out.write(frame)
                    written += len(frame)
            store_.move(part, f"{base}/{name}")
            made.append((f"{target}/{name}", count, written))
            number, buffer, size, count = number + 1, [], 0, 0

        for batch in batches:
            for page, url, body, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4))):
                raw = record(page, url, body, refers_to, date)
                buffer.append(raw)
                size, count = size + len(raw), count + 1
                if size >= roll_bytes:
                    close()
        if buffer:
            close()
        import pyarrow as pa

        yield pa.RecordBatch.from_pydict({"file": [m[0] for m in made], "n_records": pa.array([m[1] for m in made], pa.int64()), "n_bytes": pa.array([m[2] for m in made], pa.int64())},
                                         schema=pa.schema([("file", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]))

    return store(ready.mapInArrow(put, MANIFEST))


RECORD = "file string, page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_back(spark: SparkSession, manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the files that a manifest names; each payload is checked against its digest. A file that has another number of records is an error."""
    names = [c.split()[0] for c in RECORD.split(", ")]

    def get(batches):
        for pdf in batches:
            for file, expected in zip(pdf["file"], pdf["n_records"]):
                rows, size, seen = [], 0, 0
                store_, path = file_system(file)
                with store_.open_input_stream(path, compression=None) as stream:
                    for raw in read_frames(stream):
                        rows.append({"file": file, **parse(raw)})
                        seen += 1
                        if payloads:
                            size += len(raw)
                        else:
                            rows[-1]["payload"] = None
                        if size >= 8 << 20 or len(rows) >= 20_000:
                            yield _frame(rows, names)
                            rows, size = [], 0
                if seen != expected:
                    raise ValueError(f"{file} has {seen} records, not {expected}")
                if rows:
                    yield _frame(rows, names)

    files = manifest.repartition(max(1, manifest.count()), "file")
    return files.mapInPandas(get, RECORD)


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=names)
    for c in ("page_id", "payload_bytes", "refers_to"):
        pdf[c] = pdf[c].astype("Int64")
    return pdf


def archive_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
