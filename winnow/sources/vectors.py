"""Vectors in the .npy format: two-dimensional arrays, read by ranges of rows.

The header of a file says where its rows begin and how long one is, so any number of tasks read their own ranges of bytes, and
a row's number is known without reading those before it. Beside `name.npy` a `name.json` tells what the vectors were made from.
"""

from __future__ import annotations

import ast
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.sources.arrow import open_file, open_out

#: Bytes of rows that a task reads at a time.
CHUNK = 4 << 20
_MAGIC = b"\x93NUMPY"


def header(path: str) -> tuple[np.dtype, int, int, int]:
    """(type, rows, columns, offset of the first row) of a file; only its header is read."""
    with open_file(path) as f:
        start = f.read(12)
        if start[:6] != _MAGIC or start[6] not in (1, 2, 3):
            raise ValueError(f"not in the .npy format: {path}")
        size, begin = (struct.unpack("<H", start[8:10])[0], 10) if start[6] == 1 else (struct.unpack("<I", start[8:12])[0], 12)
        f.seek(begin)
        about = ast.literal_eval(f.read(size).decode("latin-1" if start[6] < 3 else "utf-8"))
        kind, shape = np.dtype(about["descr"]), about["shape"]
        if kind.hasobject or kind.kind not in "fiu" or len(shape) != 2 or (about["fortran_order"] and min(shape) > 1):
            raise ValueError(f"a two-dimensional array of numbers, row by row, is needed: {path}")
        if f.size() < begin + size + shape[0] * shape[1] * kind.itemsize:
            raise ValueError(f"the file ends before its last row: {path}")
    return kind, shape[0], shape[1], begin + size


def read_npy(spark: SparkSession, path: str, expected: dict[str, str] | None = None, rows: int | None = None, partitions: int | None = None) -> DataFrame:
    """(row, embedding) of a .npy file. What `expected` says must stand in the .json beside it, and `rows` must be its rows: vectors
    of another make, or of another table, are an error, told before a task begins."""
    kind, n, dim, offset = header(path)
    if expected:
        with open_file(path.removesuffix(".npy") + ".json") as f:
            made = json.loads(f.read())
        if wrong := sorted(k for k, v in expected.items() if made.get(k) != v):
            raise ValueError(f"vectors of another make: {', '.join(wrong)}")
    if rows is not None and rows != n:
        raise ValueError(f"{n} vectors for {rows} rows")
    width = dim * kind.itemsize
    parts = partitions or max(1, min(n, -(-n * width // (64 << 20))))
    double = kind.itemsize > 4 or kind.kind != "f"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column(0).to_pylist():
                at, end = n * p // parts, n * (p + 1) // parts
                step = max(1, CHUNK // max(1, width))
                with open_file(path) as f:
                    while at < end:
                        m = min(step, end - at)
                        x = np.frombuffer(f.read_at(m * width, offset + at * width), dtype=kind).astype(np.float64 if double else np.float32)
                        vectors = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * dim), pa.array(x))
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + m, dtype=np.int64)), vectors], ["row", "embedding"])
                        at += m

    return spark.range(0, parts, 1, parts).mapInArrow(each, f"row long, embedding array<{'double' if double else 'float'}>")


def write_npy(df: DataFrame, vec_col: str, id_col: str, dim: int, path: str, made: dict[str, str]) -> DataFrame:
    """Write df as one .npy file for each of its partitions, `part-<k>.npy`, in the order of its ids, with `part-<k>.json`; the result
    (file, rows, ids) tells which ids are in which rows. Vectors of another length, or with nulls, are an error."""
    kind = df.schema[vec_col].dataType.elementType.simpleString()
    dtype = np.dtype("<f4" if kind == "float" else "<f8")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"{path.rstrip('/')}/part-{context.partitionId():05d}"
        ids, n = [], 0
        for b in batches:
            flat = b.column(1).flatten()
            if flat.null_count or b.column(1).null_count or len(flat) != len(b.column(1)) * dim:
                raise ValueError(f"vectors of {dim} components without nulls are needed")
            ids.append((b.column(0), flat.to_numpy(zero_copy_only=False).astype(dtype)))
            n += b.num_rows
        if n:
            about = f"{{'descr': '{dtype.str}', 'fortran_order': False, 'shape': ({n}, {dim}), }}"
            about += " " * (-(len(about) + 11) % 64) + "\n"
            with open_out(name + ".npy") as f:
                f.write(_MAGIC + b"\x01\x00" + struct.pack("<H", len(about)) + about.encode("latin-1"))
                for _, x in ids:
                    f.write(x.tobytes())
            with open_out(name + ".json") as f:
                f.write(json.dumps(made, sort_keys=True).encode())
            every = pa.concat_arrays([i for i, _ in ids])
            yield pa.RecordBatch.from_arrays([pa.array([name + ".npy"]), pa.array([n], pa.int64()), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), every)], ["file", "rows", "ids"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).sortWithinPartitions("id")
    return rows.mapInArrow(each, "file string, rows long, ids array<long>")
