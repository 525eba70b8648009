"""Media columns: texts' bytes stored in progressive JPEG files, files read back to bytes and to RGB tensors.

Batches are cut at about ``CHUNK`` bytes, so memory follows that or the longest text, not the batch's rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import table
from . import pjpeg

CHUNK = 1_000_000


def _chunks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    values = [v or b"" for v in batch.column(column).to_pylist()]
    at = 0
    while at < len(values):
        end, n = at, 0
        while end < len(values) and (end == at or n + len(values[end]) <= CHUNK):
            n += len(values[end])
            end += 1
        yield batch.slice(at, end - at), values[at:end]
        at = end


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data in _chunks(batch, "data_"):
            media = pjpeg.encode([pjpeg.payload(d) for d in data])
            rest = {c: part.column(c) for c in part.schema.names if c != "data_"}
            yield pa.record_batch(rest | {"n_bytes": pa.array([len(d) for d in data], pa.int64()), "media": pa.array(media, pa.binary())})


def stored(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with n_bytes and ``media``, a progressive file of the text's bytes. Null counts as empty; columns named n_bytes and media are replaced."""
    rest = [c for c in docs.columns if c not in (text_col, "n_bytes", "media")]
    slim = docs.select(*rest, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data_"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name != "data_"), "n_bytes long", "media binary"])
    return slim.mapInArrow(_store, schema)


def _read(part: pa.RecordBatch, media: list[bytes], each: Callable) -> dict[str, list]:
    """Columns made by ``each(file, coefficients, tensors, indexes)`` for files of one shape, put back in order."""
    out: dict[str, list] = {}
    for which, files in pjpeg.by_shape(media):
        coefs = pjpeg.coefficients(files)
        for name, values in each(files[0], coefs, pjpeg.rgb(files[0], coefs), which).items():
            column = out.setdefault(name, [None] * len(media))
            for i, v in zip(which, values, strict=True):
                column[i] = v
    return out


def _tensors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def each(f, coefs, rgb, which):
        return {"height": [f.height] * len(rgb), "width": [f.width] * len(rgb), "rgb": [x.tobytes() for x in rgb]}

    for batch in batches:
        for part, media in _chunks(batch, "media"):
            got = _read(part, media, each)
            rest = {c: part.column(c) for c in part.schema.names if c != "media"}
            yield pa.record_batch(rest | {"height": pa.array(got["height"], pa.int32()), "width": pa.array(got["width"], pa.int32()), "rgb": pa.array(got["rgb"], pa.binary())})


def tensors(df: DataFrame) -> DataFrame:
    """Rows with progressive files in ``media`` (null and damaged files raise ValueError) get height, width and ``rgb``, row-major bytes; media is dropped."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "media"), "height int, width int, rgb binary"])
    return df.mapInArrow(_tensors, schema)


_DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, media in _chunks(batch, "media"):
            n = part.column("n_bytes").to_pylist()
            sizes = [max(pjpeg.UNIT, -(-x // pjpeg.UNIT) * pjpeg.UNIT) for x in n]

            def each(f, coefs, rgb, which):
                raw = pjpeg.stored_payload(f, coefs, max(sizes[i] for i in which))
                sums = rgb.sum((1, 2), dtype=np.int64)
                data = [r[: sizes[i]].tobytes() for r, i in zip(raw, which, strict=True)]
                feature = [f"{f.width}x{f.height}:" + ",".join(f"{s / (f.width * f.height):.3f}" for s in x) for x in sums.tolist()]
                return {"sha": [hashlib.sha256(d).hexdigest() for d in data], "crc": [zlib.crc32(d[-16:]) for d in data], "feature": feature}

            got = _read(part, media, each)
            long = pa.int64()
            yield pa.record_batch(
                {
                    "doc_id": part.column("doc_id"), "n_bytes": part.column("n_bytes"), "payload_bytes": pa.array(sizes, long), "payload_sha256": pa.array(got["sha"]), "tail_crc32": pa.array(got["crc"], long),
                    "media_bytes": pa.array([len(m) for m in media], long), "media_sha256": pa.array([hashlib.sha256(m).hexdigest() for m in media]), "feature": pa.array(got["feature"]),
                }
            )


def digests(media: DataFrame) -> DataFrame:
    """What ``stored`` made, read back: hashes of the payload and of the file, and the picture's mean colour."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_digest, _DIGEST)


def op9_media(spark, sf_dir: str) -> DataFrame:
    return digests(stored(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES = {"op9_media": op9_media}
#: All but the stored form's columns can be had from SQL; see the tests, which hold these against hashlib.
ORACLE_SQL: dict[str, str] = {}
