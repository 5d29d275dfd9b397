"""Array files in the classic NetCDF formats (32-bit, 64-bit offsets, 64-bit data), as long tables.

Files are read as Spark reads any binary file, so they may lie in any store; a file is a task's row, and a large one is cut into slabs of its
first dimension that are decoded one after the other. The usual layout, a small file for each series, so spreads over all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Rows of one slab, at least one place of the first dimension.
SLAB_ROWS = 200_000
_DIMENSION, _VARIABLE, _ATTRIBUTE = 10, 11, 12
#: Types of the format by number, fixed values.
_KINDS = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
_FILLS = {5: 9.969209968386869e36, 6: 9.969209968386869e36}


@dataclass
class Variable:
    dims: list[str]
    shape: list[int]
    kind: int
    begin: int
    record: bool
    fill: float | None


class ClassicFile:
    """The header of a file, and slabs of its variables."""

    def __init__(self, content: bytes):
        if content[:3] != b"CDF" or len(content) < 8 or content[3] not in (1, 2, 5):
            raise ValueError("no classic NetCDF file")
        self.content, self.version, self.at = content, content[3], 4
        self.records = self._count()
        sizes = [(self._name(), self._count()) for _ in range(self._list(_DIMENSION))]
        self._attributes()
        self.variables: dict[str, Variable] = {}
        for _ in range(self._list(_VARIABLE)):
            name = self._name()
            ids = [self._count() for _ in range(self._count())]
            attributes = self._attributes()
            kind, _ = self._integer(4), self._count()
            begin = self._integer(4 if self.version == 1 else 8)
            record = bool(ids) and sizes[ids[0]][1] == 0
            shape = [self.records if i == 0 and record else sizes[d][1] for i, d in enumerate(ids)]
            self.variables[name] = Variable([sizes[d][0] for d in ids], shape, kind, begin, record, attributes.get("_FillValue", attributes.get("missing_value", _FILLS.get(kind))))
        own = [self._width(v) for v in self.variables.values() if v.record]
        # records of several variables are padded to four bytes each, those of a single one are not
        self.step = own[0] if len(own) == 1 else sum(-(-w // 4) * 4 for w in own)

    def _integer(self, size: int) -> int:
        if self.at + size > len(self.content):
            raise ValueError("the header of a NetCDF file is cut off")
        self.at += size
        return int.from_bytes(self.content[self.at - size : self.at], "big")

    def _count(self) -> int:
        return self._integer(8 if self.version == 5 else 4)

    def _padded(self, size: int) -> bytes:
        out = self.content[self.at : self.at + size]
        self.at += -(-size // 4) * 4
        return out

    def _name(self) -> str:
        return self._padded(self._count()).decode()

    def _list(self, tag: int) -> int:
        found, count = self._integer(4), self._count()
        if found not in (0, tag) or (found == 0 and count):
            raise ValueError("the header of a NetCDF file is broken")
        return count

    def _attributes(self) -> dict[str, float]:
        out = {}
        for _ in range(self._list(_ATTRIBUTE)):
            name, kind, count = self._name(), self._integer(4), self._count()
            raw = self._padded(np.dtype(_KINDS[kind]).itemsize * count)
            if kind != 2 and count == 1:
                out[name] = float(np.frombuffer(raw, _KINDS[kind])[0])
        return out

    def _width(self, v: Variable) -> int:
        """Bytes of one record, or of the whole variable."""
        return np.dtype(_KINDS[v.kind]).itemsize * math.prod(v.shape[1:] if v.record else v.shape)

    def slab(self, name: str, low: int, high: int) -> np.ndarray:
        """Places ``low`` to ``high`` of the first dimension; missing values are NaN in numbers."""
        v = self.variables[name]
        kind, inner = np.dtype(_KINDS[v.kind]), v.shape[1:]
        if v.record:
            parts = [np.frombuffer(self.content, kind, math.prod(inner), v.begin + i * self.step) for i in range(low, high)]
            out = np.concatenate(parts).reshape([high - low, *inner]) if parts else np.empty([0, *inner], kind)
        else:
            row = math.prod(inner)
            out = np.frombuffer(self.content, kind, (high - low) * row, v.begin + low * row * kind.itemsize).reshape([high - low, *inner])
        if v.kind == 2:
            return out
        out = out.astype(np.float64)
        return np.where(out == v.fill, np.nan, out) if v.fill is not None else out

    def whole(self, name: str) -> np.ndarray:
        v = self.variables[name]
        return self.slab(name, 0, v.shape[0]) if v.shape else np.frombuffer(self.content, _KINDS[v.kind], 1, v.begin).astype(np.float64)

    def labels(self, dim: str, size: int) -> np.ndarray:
        """The coordinate of a dimension: the variable of its name (text from its characters), else its places from 0."""
        v = self.variables.get(dim)
        if v is None or v.dims[:1] != [dim]:
            return np.arange(size, dtype=np.float64)
        values = self.whole(dim)
        return np.array([b"".join(row).rstrip(b"\0 ").decode() for row in values.reshape(size, -1)], dtype=object) if v.kind == 2 else values


def _column(labels: np.ndarray, kind: str) -> pa.Array:
    """A column of coordinates; missing numbers are null."""
    if kind == "string":
        return pa.array([x if isinstance(x, str) else f"{x:g}" for x in labels], pa.string())
    numbers = labels.astype(np.float64)
    return pa.array(numbers, pa.float64(), from_pandas=True).cast(pa.int64() if kind == "long" else pa.float64())


def netcdf(spark: SparkSession, path: str, variable: str, dims: dict[str, str], value: str = "y", name: str = "*.nc", slab_rows: int = SLAB_ROWS) -> DataFrame:
    """(path, one column a dimension, value): a variable of every file ``name`` at or below ``path``, in long form.

    ``dims``: the variable's dimensions by name with the type of their coordinates, double, long or string. Missing values (the fill value, NaN) are
    null. A file that is no classic NetCDF, lacks the variable or has other dimensions is an error that names it.
    """
    schema = T.StructType([T.StructField("path", T.StringType()), *(T.StructField(d, {"double": T.DoubleType(), "long": T.LongType(), "string": T.StringType()}[k]) for d, k in dims.items()), T.StructField(value, T.DoubleType())])

    def decode(at: str, content: bytes) -> Iterator[pa.RecordBatch]:
        try:
            file = ClassicFile(content)
            v = file.variables[variable]
            if v.dims != list(dims):
                raise ValueError(f"{variable} has the dimensions {', '.join(v.dims)}")
            labels = [file.labels(d, n) for d, n in zip(v.dims, v.shape)]
        except (ValueError, KeyError) as problem:
            raise ValueError(f"{at}: {problem}") from problem
        inner = math.prod(v.shape[1:])
        step = max(1, slab_rows // max(1, inner))
        for low in range(0, v.shape[0] if v.shape else 1, step):
            high = min(low + step, v.shape[0]) if v.shape else 1
            values = file.slab(variable, low, high).reshape(-1) if v.shape else file.whole(variable)
            shape = [high - low, *v.shape[1:]] if v.shape else []
            places = np.unravel_index(np.arange(len(values)), shape) if shape else []
            coordinates = [_column((labels[i][low:high] if i == 0 else labels[i])[p], k) for i, (p, k) in enumerate(zip(places, dims.values()))]
            numbers = pa.array(values, pa.float64(), from_pandas=True)
            yield pa.RecordBatch.from_arrays([pa.array([at] * len(values)), *coordinates, numbers], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from decode(at, content.as_py())

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(path)
    return files.select("path", "content").mapInArrow(run, schema)
