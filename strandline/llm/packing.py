"""Number columns packed into bytes for one row each: differences, byte planes, zstd."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from .words import release

_CODEC = pa.Codec("zstd", compression_level=3)


def zip_bytes(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + _CODEC.compress(data, asbytes=True)


def unzip_bytes(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return _CODEC.decompress(data[8:], size, asbytes=True) if size else b""


def pack(values: np.ndarray) -> bytes:
    """Integers of any order; near-sorted ones shrink to little."""
    return zip_bytes(np.diff(values, prepend=values.dtype.type(0)).view(np.uint8).reshape(len(values), -1).T.tobytes())


def unpack(data: bytes, dtype: type) -> np.ndarray:
    raw = np.frombuffer(unzip_bytes(data), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.cumsum(np.ascontiguousarray(raw.reshape(width, -1).T).view(dtype).ravel(), dtype=dtype)


def pack_plain(values: np.ndarray) -> bytes:
    """Numbers in no order, of which many are small or alike."""
    return zip_bytes(values.view(np.uint8).reshape(len(values), -1).T.tobytes())


def unpack_plain(data: bytes, dtype: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unzip_bytes(data), np.uint8).reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def split_by(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the positions of its values, in order."""
    order = np.argsort(bucket, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        if len(group):
            yield int(bucket[group[0]]), group


def by_bucket(work: Callable[[list[dict]], pa.RecordBatch | None], key: str = "bucket"):
    """A function for mapInArrow on rows sorted by ``key`` that has one bucket's rows in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                if rows and row[key] != rows[0][key]:
                    if (out := work(rows)) is not None:
                        yield out
                    rows = []
                    release()
                rows.append(row)
        if rows and (out := work(rows)) is not None:
            yield out

    return run


def record(**columns: tuple[list | np.ndarray, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in columns.values()], list(columns))
