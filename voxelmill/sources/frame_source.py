"""A data source of frame folders that opens each file itself and reads its header's bytes only, unless pixels are asked for.

    spark.dataSource.register(FrameSource)
    spark.read.format("frames").option("payload", "true").load(folder)
"""

from __future__ import annotations

import fnmatch
import re
import struct
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from voxelmill.sources import codecs

# Byte offsets of the header's fields, and how many bytes hold them all.
OFFSETS = {
    "nx": (278, "<H"), "ny": (280, "<H"), "fixed_h": (864, "<d"), "fixed_k": (872, "<d"), "fixed_l": (880, "<d"), "x_h": (896, "<d"), "x_k": (904, "<d"),
    "y_k": (936, "<d"), "y_l": (944, "<d"), "min_h": (960, "<d"), "min_k": (968, "<d"), "min_l": (976, "<d"), "max_h": (992, "<d"), "max_k": (1000, "<d"),
    "max_l": (1008, "<d"), "d_min": (1024, "<d"), "wavelength": (2104, "<d"),
}
UB_OFFSET, NEEDED = 2256, 2330
HEADER_SCHEMA = "path string, " + ", ".join(f"{n} {'int' if f == '<H' else 'double'}" for n, (_, f) in OFFSETS.items()) + ", ub array<double>"
#: Bytes of files that a task reads about, and files of a task at most.
TASK_BYTES, TASK_FILES = 64 << 20, 256
COMPARE = {EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}


def parse_header(head: bytes) -> dict:
    out = {n: struct.unpack_from(f, head, at)[0] for n, (at, f) in OFFSETS.items()}
    return out | {"ub": list(struct.unpack_from("<9d", head, UB_OFFSET))}


def filesystem(path: str):
    """The file system of a path or URI and the path within it; ValueError if none can be opened from Python."""
    from pyarrow import fs

    local = re.sub(r"^file:/*(?=/)", "", path)
    if local.startswith("/"):
        return fs.LocalFileSystem(), local
    try:
        return fs.FileSystem.from_uri(path)
    except Exception as e:
        raise ValueError(f"no file system for {path}: {e}") from e


class Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        super().__init__(tuple(paths))


class FrameReader(DataSourceReader):
    """Files are listed once and dealt by their sizes."""

    def __init__(self, options: dict, payload: bool, codec) -> None:
        self.folder, self.payload, self.bin_xy, self.codec = options["path"], payload, int(options.get("bin", 1)), codec
        self.pattern, self.keep = options.get("pattern", "*.img").lower(), []

    def files(self) -> list[tuple[str, int]]:
        """Paths (as the file system has them) and bytes of the folder's files that pass."""
        from pyarrow import fs

        system, folder = filesystem(self.folder)
        found = [i for i in system.get_file_info(fs.FileSelector(folder)) if i.type == fs.FileType.File and fnmatch.fnmatchcase(i.base_name.lower(), self.pattern)]
        of = {"path": lambda i: self.name(i.path), "file_no": lambda i: file_number(i.base_name)}
        passes = lambda i: all((x := of[n](i)) is not None and test(x, v) for n, test, v in self.keep)
        return sorted((i.path, i.size) for i in found if passes(i))

    def name(self, path: str) -> str:
        """A file's path under the folder as it was given."""
        return self.folder.rstrip("/") + "/" + path.rsplit("/", 1)[-1]

    def partitions(self) -> list[InputPartition]:
        out, now, size = [], [], 0
        for path, n in self.files():
            now.append(path)
            size += n if self.payload else NEEDED
            if size >= TASK_BYTES or len(now) >= TASK_FILES:
                out.append(Files(now))
                now, size = [], 0
        return [*out, Files(now)] if now or not out else out

    def read(self, partition: InputPartition):
        import pyarrow as pa

        system, _ = filesystem(self.folder)
        for path in partition.value:
            with system.open_input_file(path) as f:
                content = f.read() if self.payload else f.read(NEEDED)
            row = frame_row(self.name(path), content, self.payload, self.bin_xy, self.codec)
            yield pa.RecordBatch.from_pylist([row], schema=frame_schema(self.payload))


class FilteringReader(FrameReader):
    """Filters on the path and the file's number leave files unopened."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if type(f) in COMPARE and f.attribute in (("path",), ("file_no",)):
                self.keep.append((f.attribute[0], COMPARE[type(f)], f.value))
            else:
                yield f


def frame_schema(payload: bool):
    import pyarrow as pa

    kinds = [pa.field("path", pa.string()), pa.field("file_no", pa.int64()), pa.field("bytes_read", pa.int64())]
    kinds += [pa.field(n, pa.int32() if f == "<H" else pa.float64()) for n, (_, f) in OFFSETS.items()] + [pa.field("ub", pa.list_(pa.float64()))]
    return pa.schema(kinds + ([pa.field("payload", pa.list_(pa.int32()))] if payload else []))


def frame_row(path: str, content: bytes, payload: bool, bin_xy: int, codec) -> dict:
    """A frame's row.  A file too short for a header has nulls, or with its pixels asked for is an error."""
    row = {"path": path, "file_no": file_number(path), "bytes_read": len(content)}
    if len(content) < NEEDED:
        if payload:
            raise ValueError(f"{path}: a frame of {len(content)} bytes")
        return row
    row |= parse_header(content)
    if payload:
        try:
            row["payload"] = binned(codec(content), row["nx"], row["ny"], bin_xy)
        except ValueError as e:
            raise ValueError(f"{path}: {e}") from e
    return row


def file_number(name: str) -> int | None:
    found = re.search(r"(?i)_(\d+)\.img$", name)
    return int(found[1]) if found else None


def binned(x, nx: int, ny: int, by: int):
    """Block means (floor) of ``by`` pixels each way, as one row after the other; the remainder is dropped."""
    import numpy as np

    x = np.asarray(x, np.int32).reshape(ny, nx)[: ny // by * by, : nx // by * by]
    if by > 1:
        x = (x.reshape(ny // by, by, nx // by, by).sum(axis=(1, 3), dtype=np.int64) // by**2).astype(np.int32)
    return x.ravel()


class FrameSource(DataSource):
    """Frames of a folder: path, file_no, bytes_read, the header's fields, and with the option ``payload`` the pixels.

    A file too short for a header has nulls.
    ``bin`` takes block means of so many pixels each way as a frame is decoded;
    ``pattern`` is the files' pattern, letters of any case.  ``filters`` says
    that Spark may hand over filters (spark.sql.python.filterPushdown.enabled).
    """

    #: From a file's bytes to its pixels; a subclass may have another.
    codec = staticmethod(codecs.frame_pixels)

    @classmethod
    def name(cls) -> str:
        return "frames"

    def payload(self) -> bool:
        return self.options.get("payload", "false").lower() == "true"

    def schema(self) -> str:
        fields = HEADER_SCHEMA.replace("path string, ", "path string, file_no long, bytes_read long, ", 1)
        return fields + (", payload array<int>" if self.payload() else "")

    def reader(self, schema) -> FrameReader:
        if "path" not in self.options:
            raise ValueError("frames need a folder to load")
        kind = FilteringReader if self.options.get("filters", "false").lower() == "true" else FrameReader
        return kind(dict(self.options), self.payload(), type(self).codec)
