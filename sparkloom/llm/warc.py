"""WARC archives compressed with an embedded Zstandard dictionary.

An archive is one file: a skippable frame (magic 0x184D2A5D) that holds the dictionary, then
one Zstandard frame for each record, so any record can be read alone with the dictionary.
Every writing task trains the dictionary from records of its own archive.  Records whose payload
another record has already are revisits.  Readers need the archive alone.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import Workspace, local_path, table

SKIPPABLE = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
#: A dictionary is trained from the first records of its archive that have so many bytes together, in samples
#: of so many bytes, so many of a record at most, spread over it; and its own bytes, at most.
TRAIN_BYTES = 1 << 20
SAMPLE_BYTES, RECORD_SAMPLES = 2048, 8
DICTIONARY_BYTES = 48 << 10
LEVEL = 3
#: Tasks that read archives, at most; each reads its archives one after another.
READERS = 2000
#: A record's date is a field of the format; runs must agree, so it is a parameter.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str | None, page_id: int | None) -> str:
    return (url or "").replace("\r", "%0D").replace("\n", "%0A") or f"urn:page:{page_id}"


def record(name: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None, sha1: str, date: str = DATE) -> bytes:
    """One WARC/1.1 record with an id of its own, ``name``, and its page's in a field beside it.

    A revisit has no body but still names the payload's digest and length, and the page and address
    that have it.
    """
    revisit = refers_to is not None
    body = b"" if revisit else payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:record:{name}>", f"X-Page-ID: {page_id}", f"WARC-Target-URI: {_uri(url, page_id)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{sha1}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Target-URI: {_uri(refers_url, refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, rest[:n]


def train(records: list[bytes]) -> bytes:
    """A dictionary from records; too few or too plain ones give the raw bytes of the first."""
    samples = []
    for r in records:
        step = max(SAMPLE_BYTES, -(-len(r) // RECORD_SAMPLES))
        samples += [r[i : i + SAMPLE_BYTES] for i in range(0, len(r), step)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8, level=LEVEL).as_bytes() if len(samples) >= 16 else b"".join(records)[:2048]
    except zstandard.ZstdError:
        return b"".join(records)[:DICTIONARY_BYTES]


def _tools(dictionary: bytes):
    held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held), zstandard.ZstdDecompressor(dict_data=held)


#: Schemes of Hadoop's file systems by those of pyarrow's.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs", "wasb": "abfs"}


def _filesystem(folder: str):
    """pyarrow's file system of a folder or file, and its path there."""
    from pyarrow import fs

    plain = local_path(folder)
    if plain.startswith("dbfs:"):
        plain = "/dbfs/" + plain[5:].lstrip("/")  # as clusters mount it
    scheme, _, rest = plain.partition("://")
    return (fs.LocalFileSystem(), plain) if plain.startswith("/") else fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}://{rest}")


MANIFEST = "page_id bigint, path string, start bigint, length bigint"


def _write(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _filesystem(folder)
        held: list[tuple[int, bytes]] = []
        name = uuid.uuid4().hex
        size, out, compress, at, n, path = 0, None, None, 0, 0, f"{root}/{name}.warc.zst"
        done: list[tuple[int, int, int]] = []

        def put(rows: list[tuple[int, bytes]]) -> None:
            nonlocal out, compress, at
            if out is None:
                dictionary = train([r for _, r in rows])
                compress = _tools(dictionary)[0]
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(path, compression=None)  # else the name's ending would choose one
                out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
                at = 8 + len(dictionary)
            for page_id, raw in rows:
                frame = compress.compress(raw)
                out.write(frame)
                done.append((page_id, at, len(frame)))
                at += len(frame)

        def told() -> pa.RecordBatch:
            ids, starts, lengths = zip(*done, strict=True)
            rows = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([path] * len(ids)), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64())], names=["page_id", "path", "start", "length"])
            done.clear()
            return rows

        for batch in batches:
            for page_id, url, html, refers_to, refers_url in zip(*(batch.column(i) for i in range(5)), strict=True):
                payload = (html.as_py() or "").encode()
                raw = record(f"{name}:{n}", page_id.as_py(), url.as_py(), payload, refers_to.as_py(), refers_url.as_py(), digest(payload), date)
                n += 1
                if out is None:
                    held.append((page_id.as_py(), raw))
                    size += len(raw)
                    if size >= TRAIN_BYTES:
                        put(held)
                        held = []
                else:
                    put([(page_id.as_py(), raw)])
            if done:
                yield told()
        if held:
            put(held)
        if out is not None:
            out.close()
        if done:
            yield told()

    return run


def decisions(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, sha1, refers_to, refers_url) of the pages whose payload a page of smaller id has.

    Payloads are compared by digest and length.  Each digest is reduced before the shuffle to its
    smallest page, so a payload that a third of the pages share costs one row a task.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    known = pages.select("page_id", "url", F.sha1(payload).alias("sha1"), F.octet_length(payload).alias("n")).filter((F.col("n") >= least) & F.col("page_id").isNotNull())
    first = known.groupBy("sha1", "n").agg(F.min(F.struct("page_id", "url")).alias("to"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").drop("copies")
    return known.join(first, ["sha1", "n"]).filter("page_id <> to.page_id").select("page_id", "sha1", F.col("to.page_id").alias("refers_to"), F.col("to.url").alias("refers_url")).distinct()


def write(spark: SparkSession, pages: DataFrame, folder: str, least: int = 0, date: str = DATE) -> DataFrame:
    """Write archives under ``folder`` (shared by all executors); the manifest of their records.

    ``pages``: page_id, url, html; other columns are not read.  Null html is an empty payload, a null
    url an urn, and a page without an id is always a response.  Very long pages are written whole.
    Repeated rows are records with ids of their own, all of one type; no rows make no archive.
    A task that is run again writes a file of its own; the manifest names only files of tasks whose
    rows were accepted, so readers never see those of lost attempts.
    """
    revisits = decisions(pages, least)
    sha1 = F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    rows = pages.select("page_id", "url", "html", sha1.alias("sha1")).join(revisits, ["page_id", "sha1"], "left")
    written = rows.select("page_id", "url", "html", "refers_to", "refers_url").mapInArrow(_write(folder, date), MANIFEST)
    return Workspace(spark, "warc-manifest").save(written, "manifest")


READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, payload binary"


def _read(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, plain = _filesystem(path)
                kept: list[tuple] = []
                size = 0
                with store.open_input_stream(plain, compression=None, buffer_size=1 << 20) as source:
                    magic, n = struct.unpack("<II", source.read(8))
                    if magic != SKIPPABLE:
                        raise ValueError(f"{path}: no dictionary frame")
                    _, expand = _tools(source.read(n))
                    for raw in _frames(source, expand):
                        fields, body = parse(raw)
                        got, revisit = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "revisit"
                        if not revisit and digest(body) != got:
                            raise ValueError(f"{path}: a payload differs from its digest")
                        page = fields["X-Page-ID"]
                        kept.append((None if page == "None" else int(page), int(fields["X-Payload-Length"]), got, fields["WARC-Type"], int(fields["X-Refers-To-Page-ID"]) if revisit else None, fields["WARC-Target-URI"], body if payloads else None))
                        size += len(body) if payloads else 100
                        if size > 4 << 20:
                            yield _rows(kept)
                            kept, size = [], 0
                if kept:
                    yield _rows(kept)

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
    names = [x.split()[0] for x in READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _frames(source, expand: zstandard.ZstdDecompressor) -> Iterator[bytes]:
    """The content of one frame after another, read as a stream."""
    held = source.read(1 << 20)
    while held:
        one, parts = expand.decompressobj(), []
        while True:
            if held:
                parts.append(one.decompress(held))
                held = one.unused_data if one.eof else b""
            if one.eof:
                break
            held = source.read(1 << 20)
            if not held:
                raise ValueError("an archive ends inside a record")
        yield b"".join(parts)
        held = held or source.read(1 << 20)


def read(spark: SparkSession, manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the archives that a manifest names, digests checked."""
    paths = manifest.select("path").distinct()
    tasks = max(1, min(READERS, paths.count()))  # a path is a few bytes: by size, or with what distinct() deals out, all would be one task
    return paths.repartition(tasks).mapInArrow(_read(payloads), READ)


def op8_dictionary_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` written to archives and read back; see ``write`` and ``read``."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    manifest = write(spark, pages, Workspace(spark, "warc").path, least=0)
    return read(spark, manifest, payloads=False).drop("payload")


ORACLE = """
WITH known AS (
    SELECT page_id, coalesce(url, 'urn:page:' || page_id) AS url, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
           upper(sha1(coalesce(html, ''))) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
    FROM pages
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (((('0x' || substr(h, (5 * (i // 4) + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to, url
FROM known"""
