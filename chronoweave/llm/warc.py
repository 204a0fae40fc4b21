"""WARC archives: writing, normalising whole-file gzip to one member per record with an offset index, reading back.

Archives are real files under a folder that driver and executors share, reached
through ``pyarrow.fs``, so any store with such a file system will do. Every step
hands on a written table of paths; a file is renamed into place once complete,
and files of failed attempts are named by no table.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import small_batches
from chronoweave.operators.staging import stage, stage_root

ARCHIVE_BYTES = 32 << 20
CHUNK = 1 << 18
LEVEL = 4
END = b"\r\n\r\n"


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(fields: dict[str, str], block: bytes) -> bytes:
    """One uncompressed record: version, header lines, block."""
    head = "".join(f"{k}: {v}\r\n" for k, v in {**fields, "Content-Length": str(len(block))}.items())
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + END


class Inflated:
    """Buffered bytes of one gzip stream (of one or several members), inflated as they are asked for."""

    def __init__(self, source):
        self.source, self.buffer, self.z = source, bytearray(), zlib.decompressobj(31)

    def _more(self) -> bool:
        data = self.z.unconsumed_tail
        if not data:
            if self.z.eof:
                data = self.z.unused_data or self.source.read(CHUNK)
                if not data:
                    return False
                self.z = zlib.decompressobj(31)
            else:
                data = self.source.read(CHUNK)
                if not data:
                    return False
        self.buffer += self.z.decompress(data, 4 * CHUNK)
        return True

    def until(self, mark: bytes) -> bytes | None:
        at, seen = -1, 0
        while (at := self.buffer.find(mark, seen)) < 0:
            seen = max(0, len(self.buffer) - len(mark))
            if not self._more():
                if self.buffer:
                    raise ValueError("truncated record header")
                return None
        out = bytes(self.buffer[:at])
        del self.buffer[:at + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise ValueError("truncated record block")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def records(source):
    """``(header fields, block)`` of each record of a gzip stream."""
    stream = Inflated(source)
    while (head := stream.until(END)) is not None:
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        block = stream.take(int(fields["Content-Length"]))
        if stream.take(len(END)) != END:
            raise ValueError("record without its end")
        yield fields, block


def _place(store, tmp: str, path: str) -> None:
    store.move(tmp, path)


def _page_record(page_id, url, payload: bytes, top) -> bytes:
    kind = "response" if top is None or page_id is None or page_id == top else "revisit"
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}')}>",
              "WARC-Payload-Digest": "sha1:" + digest32(payload), "X-Payload-Length": str(len(payload))}
    if page_id is not None:
        fields["X-Page-ID"] = str(page_id)
    if url is not None:
        fields["WARC-Target-URI"] = " ".join(url.split())
    if kind == "revisit":
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page": str(top)}
    return record(fields, payload if kind == "response" else b"")


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``page_id, url, payload, top`` rows into archives of one gzip stream each; returns their ``path``.

    ``top`` is the page that holds the payload (null: this page does).
    """

    def write(batches):
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        out = z = name = None
        size = 0

        def close():
            out.write(z.flush())
            out.close()
            _place(store, f"{root}/{name}.part", f"{root}/{name}")
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"]})

        for b in batches:
            for page_id, url, payload, top in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "top"))):
                if out is None:
                    name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                    out, z = store.open_output_stream(f"{root}/{name}.part", compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                data = _page_record(page_id, url, payload, top)
                out.write(z.compress(data))
                size += len(data)
                if size >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return stage(small_batches(pages).mapInArrow(write, "path string"), "archives")


def normalise_archives(paths: DataFrame, folder: str) -> DataFrame:
    """Rewrite each gzip archive with a member per record and a sidecar index; returns ``path, index_path, records``.

    The input is inflated once as a stream; one record is held at a time. The
    sidecar has a JSON line per record: offset, length and header fields.
    """

    def rewrite(batches):
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        for b in batches:
            for source in b.column("path").to_pylist():
                own, at = _store(source)
                name = uuid.uuid4().hex
                offset = n = 0
                with own.open_input_stream(at, compression=None) as src, store.open_output_stream(f"{root}/{name}.part", compression=None) as out, \
                        store.open_output_stream(f"{root}/{name}.idx.part", compression=None) as idx:
                    for fields, block in records(src):
                        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = z.compress(record({k: v for k, v in fields.items() if k != "Content-Length"}, block)) + z.flush()
                        out.write(member)
                        idx.write(json.dumps({"offset": offset, "length": len(member), **fields}).encode() + b"\n")
                        offset += len(member)
                        n += 1
                _place(store, f"{root}/{name}.idx.part", f"{root}/{name}.idx")
                _place(store, f"{root}/{name}.part", f"{root}/{name}.warc.gz")
                yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}.warc.gz"], "index_path": [f"{folder}/{name}.idx"], "records": pa.array([n], pa.int64())})

    return stage(paths.mapInArrow(rewrite, "path string, index_path string, records long"), "normalised")


def read_archives(normalised: DataFrame) -> DataFrame:
    """Records of normalised archives, each by its index entry: ``path, offset, fields, payload``."""

    def read(batches):
        for b in batches:
            for path, index_path in zip(b.column("path").to_pylist(), b.column("index_path").to_pylist()):
                store, at = _store(path)
                held: list[tuple] = []
                size = 0
                with store.open_input_file(at) as f, _store(index_path)[0].open_input_stream(_store(index_path)[1], compression=None) as idx:
                    rest = b""
                    while chunk := idx.read(CHUNK):
                        *lines, rest = (rest + chunk).split(b"\n")
                        for line in lines:
                            entry = json.loads(line)
                            f.seek(entry["offset"])
                            (fields, block), = records(pa.BufferReader(f.read(entry["length"])))
                            held.append((path, entry["offset"], fields, block))
                            size += len(block) + 500
                            if size > 4 << 20:
                                yield _batch(held)
                                held, size = [], 0
                if held:
                    yield _batch(held)

    return normalised.mapInArrow(read, "path string, offset long, fields map<string,string>, payload binary")


def _batch(held: list[tuple]) -> pa.RecordBatch:
    path, offset, fields, block = zip(*held)
    return pa.RecordBatch.from_arrays([pa.array(path), pa.array(offset, pa.int64()), pa.array([list(f.items()) for f in fields], pa.map_(pa.string(), pa.string())),
                                       pa.array(block, pa.binary())], ["path", "offset", "fields", "payload"])


def archive_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
    """Archive every row of ``pages`` and normalise: (normalised archives, records read back).

    Of payloads that are equal and at least ``min_bytes`` long the largest
    page_id's is stored, the others become revisits of it. A null html is an
    empty payload; a null page_id is never referred to and is stored itself;
    rows that share the largest page_id are stored each. Extra columns are ignored.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload")).withColumn("sha", F.sha1("payload"))
    same = rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1")
    same = stage(same.select("sha", "top"), "same")  # a table of its own, so that the join can split a very common payload
    rows = rows.join(same, "sha", "left").select("page_id", "url", "payload", "top")
    root = f"{stage_root(pages.sparkSession)}/chronoweave/warc-{uuid.uuid4().hex}"
    raw = write_archives(rows, f"{root}/raw")
    split = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    done = normalise_archives(raw.repartition(split, "path"), f"{root}/members")
    return done, read_archives(done.repartition(split, "path"))


def page_report(records_: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of read records; stored payloads are measured, revisits declare theirs."""
    h = lambda k: F.col("fields").getItem(k)
    stored = h("WARC-Type") == "response"

    @F.arrow_udf("string")
    def digest(payload: pa.Array) -> pa.Array:
        return pa.array([digest32(x) for x in payload.to_pylist()], pa.string())

    return records_.select(
        h("X-Page-ID").cast("long").alias("page_id"),
        F.when(stored, F.octet_length("payload")).otherwise(h("X-Payload-Length").cast("long")).cast("long").alias("payload_bytes"),
        F.when(stored, digest("payload")).otherwise(F.substring(h("WARC-Payload-Digest"), 6, 99)).alias("payload_digest"),
        h("WARC-Type").alias("record_type"), h("X-Refers-To-Page").cast("long").alias("refers_to"))
