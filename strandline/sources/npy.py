"""NumPy files as a Spark source: ``spark.read.format("npy").load(path)`` after ``register(spark)``.

A file's header says where each row of a two-dimensional array lies, so the reader plans ranges of rows and each task
reads its own bytes. Options: ``path`` (a file, a folder or a pattern of any store that pyarrow reaches),
``bytes`` (bytes of a task, 16 MB unless given), ``first`` and ``last`` (rows to read, both included), ``prune``
(``true``: filters on ``row`` narrow the ranges; Spark must have spark.sql.python.filterPushdown.enabled set).
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

TASK_BYTES = 16 << 20


@dataclass
class RowRange(InputPartition):
    """Rows ``first`` to ``end - 1`` of a file."""

    path: str
    offset: int
    dtype: str
    rows: int
    width: int
    fortran: bool
    first: int
    end: int


def _store(path: str):
    """The file system of a path, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    import fnmatch

    from pyarrow import fs

    store, at = _store(path)
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    if any(c in at for c in "*?["):
        folder = posixpath.dirname(at)
        names = [f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.is_file and fnmatch.fnmatch(f.path, at)]
    elif store.get_file_info(at).type == fs.FileType.Directory:
        names = [f.path for f in store.get_file_info(fs.FileSelector(at, recursive=True)) if f.is_file and f.path.endswith(".npy")]
    else:
        names = [at]
    return [prefix + n for n in sorted(names)]


def _header(path: str) -> tuple[int, str, int, int, bool]:
    """Where the data begin, their type, rows, columns, and whether columns lie one after the other."""
    from numpy.lib import format as npy

    store, at = _store(path)
    with store.open_input_file(at) as file:
        version = npy.read_magic(file)
        shape, fortran, dtype = (npy.read_array_header_1_0 if version == (1, 0) else npy.read_array_header_2_0)(file)
        offset = file.tell()
    if dtype.hasobject or dtype.kind not in "fiub" or len(shape) not in (0, 1, 2):
        raise ValueError(f"{path}: neither a series nor rows of numbers")
    rows, width = (1, shape[0] if shape else 1) if len(shape) < 2 else shape
    return offset, dtype.str, rows, width, bool(fortran and len(shape) == 2)


class NpyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.task_bytes = options["path"], int(options.get("bytes", TASK_BYTES))
        self.first, self.last = int(options.get("first", 0)), int(options["last"]) if "last" in options else None

    def partitions(self) -> list[RowRange]:
        import numpy as np

        out = []
        for path in _files(self.path):
            offset, dtype, rows, width, fortran = _header(path)
            step = max(1, self.task_bytes // max(1, width * np.dtype(dtype).itemsize))
            end = rows if self.last is None else min(rows, self.last + 1)
            out += [RowRange(path, offset, dtype, rows, width, fortran, a, min(a + step, end)) for a in range(self.first, end, step)]
        return out

    def read(self, part: RowRange) -> Iterator:
        import numpy as np
        import pyarrow as pa

        dtype, count = np.dtype(part.dtype), part.end - part.first
        store, at = _store(part.path)
        with store.open_input_file(at) as file:
            if part.fortran:
                data = np.empty((count, part.width), dtype)
                for column in range(part.width):
                    raw = file.read_at(count * dtype.itemsize, part.offset + (column * part.rows + part.first) * dtype.itemsize)
                    data[:, column] = np.frombuffer(raw, dtype)
            else:
                raw = file.read_at(count * part.width * dtype.itemsize, part.offset + part.first * part.width * dtype.itemsize)
                data = np.frombuffer(raw, dtype).reshape(count, part.width)
        values = pa.array(np.ascontiguousarray(data).astype(np.float64).ravel())
        ends = pa.array(np.arange(count + 1, dtype=np.int32) * part.width)
        columns = [pa.array([part.path] * count, pa.string()), pa.array(np.arange(part.first, part.end, dtype=np.int32)), pa.ListArray.from_arrays(ends, values)]
        yield pa.RecordBatch.from_arrays(columns, ["path", "row", "values"])


class PruningReader(NpyReader):
    def pushFilters(self, filters: list[Filter]):
        """Bounds of ``row`` narrow what is planned; Spark still applies every filter."""
        for f in filters:
            if getattr(f, "attribute", None) == ("row",) and isinstance(getattr(f, "value", None), int):
                if isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan)):
                    self.first = max(self.first, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThanOrEqual, LessThan)):
                    last = f.value - isinstance(f, LessThan)
                    self.last = last if self.last is None else min(self.last, last)
            yield f


class NpySource(DataSource):
    """``path, row, values``; a one-dimensional file is one row."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "path string, row int, values array<double>"

    def reader(self, schema) -> NpyReader:
        return (PruningReader if self.options.get("prune") == "true" else NpyReader)(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpySource)
