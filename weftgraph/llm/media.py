"""Media columns: payloads in content-addressed tar shards, rows with digest, offset and length.

Each task writes the payloads it holds to tar files of its own in a shared folder; equal payloads are stored once. Columns
such as the media type or the size of an image are then filled by reading only the first bytes of each payload, by range.
"""

from __future__ import annotations

import re
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import scratch

SHARD_BYTES, HEADER_BYTES = 256 << 20, 1024
STORED = "digest binary, shard string, offset long, length long, codec string, n_bytes long"
FOUND = "media_type string, width int, height int, rate int, lang string, title string"
_MAGIC = ((b"\x89PNG\r\n\x1a\n", "image/png"), (b"GIF8", "image/gif"), (b"\xff\xd8\xff", "image/jpeg"), (b"%PDF-", "application/pdf"), (b"ID3", "audio/mpeg"), (b"OggS", "audio/ogg"), (b"fLaC", "audio/flac"), (b"PK\x03\x04", "application/zip"))


def media_type(head: bytes) -> str:
    """The type that the first bytes of a payload tell."""
    for magic, kind in _MAGIC:
        if head.startswith(magic):
            return kind
    if head[:4] == b"RIFF" and head[8:12] in (b"WAVE", b"WEBP", b"AVI "):
        return {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}[head[8:12]]
    if head[4:8] == b"ftyp":
        return "video/mp4"
    if re.match(rb"\s*(<!doctype\s+html|<html)", head, re.I):
        return "text/html"
    if not head:
        return "application/x-empty"
    try:
        head[:-3].decode()
        return "text/plain" if b"\0" not in head else "application/octet-stream"
    except UnicodeDecodeError:
        return "application/octet-stream"


def header_columns(head: bytes) -> tuple:
    """(media_type, width, height, rate, lang, title), null where the header doesn't have it."""
    kind, width, height, rate, lang, title = media_type(head), None, None, None, None, None
    if kind == "image/png" and len(head) >= 24:
        width, height = struct.unpack(">II", head[16:24])
    elif kind == "image/gif" and len(head) >= 10:
        width, height = struct.unpack("<HH", head[6:10])
    elif kind == "image/jpeg":
        at = 2
        while at + 9 <= len(head) and head[at] == 0xFF:
            if 0xC0 <= head[at + 1] <= 0xCF and head[at + 1] not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", head[at + 5 : at + 9])
                break
            at += 2 + int.from_bytes(head[at + 2 : at + 4], "big")
    elif kind == "audio/wav" and len(head) >= 28:
        rate = struct.unpack("<I", head[24:28])[0]
    elif kind == "text/html":
        text = head.decode("utf-8", "ignore")
        found = re.search(r"<html[^>]*\blang=[\"']?([A-Za-z-]+)", text, re.I)
        lang = found.group(1).lower() if found else None
        found = re.search(r"<title[^>]*>(.*?)</title>", text, re.I | re.S)
        title = found.group(1).strip() if found else None
    return kind, width, height, rate, lang, title


def _write(folder: str, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, where = fs.FileSystem.from_uri(folder)
        system.create_dir(where, recursive=True)
        out, name, at, here = None, "", 0, {}
        for batch in batches:
            rows = []
            for digest, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if digest in here:
                    continue
                if out is None or at >= shard_bytes:
                    if out is not None:
                        out.write(bytes(1024))
                        out.close()
                    # a name of its own for each attempt: a task that runs again never touches what another has written
                    name, at = f"{folder}/{uuid.uuid4().hex}.tar", 0
                    out = system.open_output_stream(f"{where}/{name.rpartition('/')[2]}")
                packed = zlib.compress(payload, 6) if media_type(payload[:64]).startswith("text/") else payload
                codec = "deflate" if len(packed) < len(payload) else "none"
                stored = packed if codec == "deflate" else payload
                entry = tarfile.TarInfo(digest.hex())
                entry.size = len(stored)
                out.write(entry.tobuf(tarfile.PAX_FORMAT))
                out.write(stored)
                out.write(bytes(-len(stored) % 512))
                rows.append((digest, name, at + 512, len(stored), codec, len(payload)))
                here[digest] = None
                at += 512 + len(stored) + -len(stored) % 512
            columns = list(zip(*rows)) if rows else [[]] * 6
            types = (pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["digest", "shard", "offset", "length", "codec", "n_bytes"])
        if out is not None:
            out.write(bytes(1024))
            out.close()

    return run


def read_range(system: fs.FileSystem, file: pa.NativeFile, offset: int, length: int, codec: str, most: int | None = None) -> bytes:
    """A payload, or as much of it as its first `most` stored bytes give."""
    raw = file.read_at(length if most is None else min(length, most), offset)
    return raw if codec == "none" else zlib.decompressobj().decompress(raw)


def _headers(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple = ("", None, None)
        for batch in batches:
            found = []
            for shard, offset, length, codec in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4))):
                if opened[0] != shard:
                    if opened[2]:
                        opened[2].close()
                    system, where = fs.FileSystem.from_uri(shard)
                    opened = (shard, system, system.open_input_file(where))
                found.append(header_columns(read_range(opened[1], opened[2], offset, length, codec, most)))
            columns = list(zip(*found)) if found else [[]] * 6
            types = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(columns, types))], names=[*batch.schema.names, *(x.split()[0] for x in FOUND.split(", "))])

    return run


def store_payloads(rows: DataFrame, folder: str, *, id_col: str, payload_col: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write every distinct payload to tar shards in `folder`; returns (digest, shard, offset, length, codec, n_bytes).

    The digest is the SHA-256 of the payload; offset and length are of its bytes within the tar file. Payloads that are text
    are deflated, others stored as they are. Only digests are shuffled, pre-aggregated: of several rows with one digest those
    with a higher id don't write. Where these ids outgrow what Spark broadcasts, the join that leaves them out becomes a shuffle.
    Null payloads are left out; an empty one is stored. Rows equal in payload and in id, or both without an id, are stored once
    by each task that holds one; the first of these by shard's name counts.
    """
    own = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    found = rows.select(own.alias("id"), F.col(payload_col).cast("binary").alias("payload")).filter("payload is not null")
    found = found.select("id", F.unhex(F.sha2("payload", 256)).alias("digest"), "payload")
    twice = found.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("n")).filter("n > 1").select("digest", "least")
    repeated = scratch.written(found.select("id", "digest").join(twice, "digest").filter("id > least").select("id", "digest").distinct(), "repeated")
    writers = found.join(repeated, ["id", "digest"], "left_anti").select("digest", "payload")
    stored = scratch.written(writers.mapInArrow(_write(folder, shard_bytes), STORED), "stored")
    place = [F.col(c) for c in ("shard", "offset", "length", "codec", "n_bytes")]
    return stored.groupBy("digest").agg(F.min(F.struct(*place)).alias("place")).select("digest", "place.*")


def media_columns(rows: DataFrame, *, id_col: str = "page_id", payload_col: str = "html", folder: str | None = None, shard_bytes: int = SHARD_BYTES, header_bytes: int = HEADER_BYTES) -> DataFrame:
    """One row for each of `rows`: id, digest, shard, offset, length, codec, n_bytes and what the payload's header tells.

    Header columns come from the first `header_bytes` stored bytes alone and are null where these don't show them. A null
    payload has null columns throughout; an empty one is of type application/x-empty. Equal payloads share one place.
    Repeated rows and those without an id are returned each. Payloads of any length are stored whole. Other columns are not
    read; an empty table gives an empty result. `folder` is by default within the shared folder; shards have random names.
    """
    folder = folder or scratch.path(rows.sparkSession, "shards")
    places = store_payloads(rows, folder, id_col=id_col, payload_col=payload_col, shard_bytes=shard_bytes)
    described = places.repartition("shard").sortWithinPartitions("shard", "offset").mapInArrow(_headers(header_bytes), f"{STORED}, {FOUND}")
    keyed = rows.select(F.col(id_col).cast("long").alias(id_col), F.unhex(F.sha2(F.col(payload_col).cast("binary"), 256)).alias("digest"))
    return keyed.join(described, "digest", "left").select(id_col, F.lower(F.hex("digest")).alias("digest"), *[F.col(c) for c in described.columns if c != "digest"])
