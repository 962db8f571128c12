"""A data source for files of lines that plans its own byte ranges.

A built-in text scan is cut anew each time it is planned, so a row's place is not the same in two scans.
Here ranges follow from the length of a file alone, and a line belongs to the range in which it begins. One
pass counts the lines of each range, without handing any text to Spark; these counts, one number per
range, give every range the position of its first line, and the rows are read with their positions from
then on. Nothing is copied, sorted or joined.

Paths are opened by pyarrow or, for local and mounted files, by Python. ``\\n``, ``\\r\\n`` and ``\\r`` end a line.
"""

from __future__ import annotations

import base64
import json
import sys
import zlib
from collections.abc import Iterator, Sequence
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Bytes of a range, of one read, and the cost of opening a file, as if it were read.
RANGE_BYTES, CHUNK_BYTES, OPEN_BYTES = 64 << 20, 8 << 20, 4 << 20
# Endings of files that are not cut into ranges because they are compressed.
COMPRESSED = (".gz", ".bz2", ".zst", ".zstd", ".lz4", ".snappy", ".deflate", ".xz")
BOM = b"\xef\xbb\xbf"
NEWLINE, RETURN = 10, 13


def _open(path: str):
    scheme = urlsplit(path).scheme
    if scheme in ("", "file"):
        return open("/" + path.split(":", 1)[1].lstrip("/") if scheme else path, "rb")
    from pyarrow import fs

    store, inside = fs.FileSystem.from_uri(path)
    return store.open_input_file(inside)


def is_compressed(path: str) -> bool:
    return path.lower().endswith(COMPRESSED)


def can_open(path: str) -> bool:
    """Whether the store of a path is one that this source can read."""
    try:
        with _open(path):
            return True
    except Exception:  # noqa: BLE001  any store may refuse in its own way
        return False


def _ends(data: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of line ends and how many bytes each has; an undecided ``\\r`` at the end waits for more."""
    cr, nl = data == RETURN, data == NEWLINE
    after_cr = np.zeros(len(data), bool)
    after_cr[1:] = cr[:-1]
    at = np.flatnonzero(cr | (nl & ~after_cr))
    if len(at) and not last and at[-1] == len(data) - 1 and cr[-1]:
        at = at[:-1]
    following = np.zeros(len(data) + 1, bool)
    following[: len(data)] = nl
    return at, 1 + (cr[at] & following[at + 1]).astype(np.int64)


def lines_in(path: str, start: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """``(bytes, firsts, sizes, offset)`` of the lines that begin in ``[start, end)``, some at a time.

    Lines are ``sizes[i]`` bytes from ``firsts[i]`` on, and ``offset`` is where the bytes begin in the file.
    """
    with _open(path) as f:
        # The byte before tells whether a line begins at ``start``.
        at = max(0, start - 1)
        f.seek(at)
        held, began = b"", start == 0
        while True:
            got = f.read(CHUNK_BYTES)
            data = np.frombuffer(held + got, np.uint8)
            place, width = _ends(data, last=not got)
            first = np.concatenate([[0], place + width])
            size = np.append(place, len(data)) - first
            # What follows the last end is a line only if the file ends there.
            whole = len(first) - (1 if got or not size[-1] else 0)
            first, size, rest = first[:whole], size[:whole], int(first[-1]) if got else len(data)
            if not began and len(first):
                # The piece before the first end began in an earlier range.
                first, size, began = first[1:], size[1:], True
            if at == 0 and start == 0 and len(first) and data[:3].tobytes() == BOM:
                first[0], size[0] = 3, size[0] - 3
            inside = first + at < end
            if at == 0 and start == 0:
                inside |= np.arange(len(first)) == 0
            yield data, first[inside], size[inside], at
            if not got or not inside.all():
                return
            held, at = data[rest:].tobytes(), at + rest
            if began and at >= end:
                return


def count_lines(path: str, start: int, end: int) -> int:
    return sum(len(first) for _, first, _, _ in lines_in(path, start, end))


class _Ranges(InputPartition):
    """Ranges ``(file, start, end, first row)`` that one task reads."""

    def __init__(self, number: int, ranges: list[tuple[str, int, int, int]]):
        self.number, self.ranges = number, ranges


class LineReader(DataSourceReader):
    def __init__(self, plan: dict, kind: str):
        self.plan, self.kind = plan, kind

    def partitions(self) -> Sequence[InputPartition]:
        found, held, size = [], [], 0
        for number, (file, start, end) in enumerate(self.plan["ranges"]):
            base = self.plan["bases"][number] if self.plan["bases"] else number
            cost = end - start + OPEN_BYTES
            if held and size + cost > self.plan["task_bytes"]:
                found.append(_Ranges(len(found), held))
                held, size = [], 0
            held.append((self.plan["files"][file], start, end, base))
            size += cost
        return [*found, _Ranges(len(found), held)] if held or not found else found

    def read(self, partition: _Ranges) -> Iterator[pa.RecordBatch]:
        for path, start, end, base in partition.ranges:
            if self.kind == "counts":
                yield pa.RecordBatch.from_arrays([pa.array([base]), pa.array([count_lines(path, start, end)])], ["number", "n"])
                continue
            for data, first, size, offset in lines_in(path, start, end):
                if not len(first):
                    continue
                offsets = np.concatenate([[0], np.cumsum(size)])
                body = data[np.repeat(first - offsets[:-1], size) + np.arange(offsets[-1])]
                wide = offsets[-1] >= 2**31
                kind, width = (pa.large_string(), np.int64) if wide else (pa.string(), np.int32)
                text = pa.Array.from_buffers(kind, len(first), [None, pa.py_buffer(offsets.astype(width)), pa.py_buffer(body)])
                columns = {"row_idx": pa.array(base + np.arange(len(first))), "text": text.cast(pa.string())}
                if self.kind == "places":
                    columns = {"file": pa.array([path] * len(first)), "offset": pa.array(first + offset)} | columns
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
                base += len(first)


class LineSource(DataSource):
    """``spark.read.format("blockloom_lines").option("plan", …)``; made by ``read_ranges``."""

    @classmethod
    def name(cls) -> str:
        return "blockloom_lines"

    def schema(self) -> str:
        return {
            "counts": "number long, n long",
            "rows": "row_idx long, text string",
            "places": "file string, offset long, row_idx long, text string",
        }[self.options["kind"]]

    def reader(self, schema) -> LineReader:
        packed = base64.b64decode(self.options["plan"])
        return LineReader(json.loads(zlib.decompress(packed)), self.options["kind"])


def plan_ranges(files: list[tuple[str, int]], range_bytes: int = RANGE_BYTES) -> dict:
    """Ranges of files ``(path, length)``, in the order of the paths; they depend on the lengths only."""
    files = sorted(files)
    ranges = [
        (number, start, min(start + range_bytes, length))
        for number, (_, length) in enumerate(files)
        for start in range(0, length, range_bytes)
    ]
    return {"files": [path for path, _ in files], "ranges": ranges, "bases": [], "task_bytes": 2 * range_bytes}


def _load(spark: SparkSession, plan: dict, kind: str) -> DataFrame:
    spark.dataSource.register(LineSource)
    packed = base64.b64encode(zlib.compress(json.dumps(plan).encode())).decode()
    return spark.read.format("blockloom_lines").option("plan", packed).option("kind", kind).load()


def list_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """The files that a scan of ``path`` would read, with their lengths; contents are not touched."""
    rows = spark.read.format("binaryFile").load(path).select("path", "length").collect()
    return [(r["path"], r["length"]) for r in rows]


def read_ranges(spark: SparkSession, files: list[tuple[str, int]], range_bytes: int = RANGE_BYTES, places: bool = False) -> DataFrame:
    """``(row_idx, text)``, with ``places`` also ``(file, offset)``: every line with its position over all files.

    Files go by path. Blank lines stay, empty files have no lines, and what follows the last line end is a line
    unless it is empty. Only one count per range reaches the driver.
    """
    plan = plan_ranges(files, range_bytes)
    counts = np.zeros(len(plan["ranges"]) + 1, np.int64)
    if plan["ranges"]:
        found = _load(spark, plan, "counts").toArrow()
        counts[found["number"].to_numpy() + 1] = found["n"].to_numpy()
    plan["bases"] = np.cumsum(counts)[:-1].tolist()
    return _load(spark, plan, "places" if places else "rows")
