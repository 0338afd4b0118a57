"""NPY and NPZ matrices as a data source: read by row ranges, written file by file.

The headers say where each row lies, so one file is read by many tasks: a partition is a range of rows, and
its task seeks to them. Files are opened through the file systems Arrow knows (local, hdfs, s3, gs, abfs);
a path without a scheme is local.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "file string, row_idx bigint, embedding array<float>"
RANGE_BYTES = 64_000_000
_BATCH = 8192  # rows of a record batch


def _opened(path: str):
    """(file system, path on it)."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str):
    """(file system, its data files in order); hidden names are left out."""
    from pyarrow import fs

    system, root = _opened(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return system, [root]
    found = system.get_file_info(fs.FileSelector(root, recursive=True)) if info.type == fs.FileType.Directory else []
    names = [f.path for f in found if f.type == fs.FileType.File]
    inside = [(n, n[len(root):].strip("/").split("/")) for n in names]
    return system, sorted(n for n, parts in inside if not any(p[:1] in ("_", ".") for p in parts))


def _header(handle) -> tuple[tuple[int, ...], np.dtype, bool]:
    version = np.lib.format.read_magic(handle)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, dtype = read(handle)
    if len(shape) not in (1, 2):
        raise ValueError(f"a matrix has one or two dimensions, not {len(shape)}")
    return ((1, shape[0]) if len(shape) == 1 else shape), dtype, fortran


@dataclass
class RowRange(InputPartition):
    """Rows [first, last) of a matrix whose values start at byte ``start`` of a file, or of a packed member."""

    file: str
    member: str | None  # set if the member is compressed and can only be read from its beginning
    start: int
    rows: int
    dim: int
    dtype: str
    fortran: bool
    first: int
    last: int


def _matrix(handle, file: str, size: int) -> RowRange:
    """The whole matrix of a file as one range."""
    if not file.endswith(".npz"):
        (rows, dim), dtype, fortran = _header(handle)
        return RowRange(file, None, handle.tell(), rows, dim, dtype.str, fortran, 0, rows)
    archive = zipfile.ZipFile(handle)
    names = archive.namelist()
    info = archive.getinfo("embeddings.npy" if "embeddings.npy" in names else names[0])
    with archive.open(info) as member:
        (rows, dim), dtype, fortran = _header(member)
        header = member.tell()
    if info.compress_type != zipfile.ZIP_STORED:
        return RowRange(file, info.filename, header, rows, dim, dtype.str, fortran, 0, rows)
    handle.seek(info.header_offset + 26)  # the local header ends with name and extra field
    name, extra = np.frombuffer(handle.read(4), "<u2").tolist()
    return RowRange(file, None, info.header_offset + 30 + name + extra + header, rows, dim, dtype.str, fortran, 0, rows)


def _parts(handle, r: RowRange) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, rows) of a range, batch by batch."""
    dtype = np.dtype(r.dtype)
    if r.fortran and r.member is not None:
        yield 0, np.frombuffer(handle.read(), dtype).reshape((r.rows, r.dim), order="F")
        return
    if r.member is None and not r.fortran:
        handle.seek(r.start + r.first * r.dim * dtype.itemsize)
    for at in range(r.first, r.last, _BATCH):
        n = min(_BATCH, r.last - at)
        if not r.fortran:
            yield at, np.frombuffer(handle.read(n * r.dim * dtype.itemsize), dtype).reshape(n, r.dim)
            continue
        columns = []  # a column lies in one piece
        for j in range(r.dim):
            handle.seek(r.start + (j * r.rows + at) * dtype.itemsize)
            columns.append(np.frombuffer(handle.read(n * dtype.itemsize), dtype))
        yield at, np.stack(columns, axis=1) if columns else np.zeros((n, 0), dtype)


class MatrixReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.bytes = options["path"], int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self) -> list[RowRange]:
        system, files = _files(self.path)
        out = []
        for file in files:
            info = system.get_file_info(file)
            with system.open_input_file(file) as handle:
                whole = _matrix(handle, file, info.size)
            step = max(1, self.bytes // max(1, whole.dim * np.dtype(whole.dtype).itemsize))
            if whole.member is not None:
                step = max(1, whole.rows)  # compressed: one task
            out += [RowRange(**{**whole.__dict__, "first": at, "last": min(whole.rows, at + step)}) for at in range(0, whole.rows, step)]
        return out

    def read(self, partition: RowRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        system, _ = _opened(self.path)
        with system.open_input_file(partition.file) as handle:
            source = handle
            if partition.member is not None:
                source = zipfile.ZipFile(handle).open(partition.member)
                source.read(partition.start)
            name = partition.file if "://" in self.path else "file:" + partition.file
            for at, rows in _parts(source, partition):
                n, dim = rows.shape
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * dim, dim) if dim else np.zeros(n + 1), pa.int32()), pa.array(rows.astype(np.float32).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(at, at + n, dtype=np.int64)), vectors], ["file", "row_idx", "embedding"])


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # (temporary name, final name)


class MatrixWriter(DataSourceArrowWriter):
    """Rows (name, embedding) sorted by name: one file per name, more where a name has too many rows.

    Files of a task lie aside until the whole write commits, so a lost or repeated task leaves nothing.
    """

    def __init__(self, options: dict):
        self.path, self.rows = options["path"], int(options.get("rows_per_file", 100_000))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _opened(self.path)
        aside, done, held, name, number = f"{root}/_temporary", [], [], None, 0
        system.create_dir(aside, recursive=True)

        def close(matrix):
            content = io.BytesIO()
            np.save(content, matrix)
            temporary = f"{aside}/{uuid.uuid4().hex}"
            with system.open_output_stream(temporary) as out:
                out.write(content.getvalue())
            done.append((temporary, f"{root}/{name}{f'-{number}' if number else ''}.npy"))

        def flush(end):
            nonlocal held, number
            while held and (end or sum(map(len, held)) >= self.rows):
                matrix = np.concatenate(held)
                close(matrix[: self.rows])
                number, held = number + 1, [matrix[self.rows :]] if len(matrix) > self.rows else []

        for batch in iterator:
            names = np.array(batch.column(0).to_pylist(), object)
            vectors = batch.column(1)
            edges = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1]))).tolist() if len(names) else []
            for a, b in zip(edges, [*edges[1:], len(names)]):
                if names[a] != name:
                    flush(True)
                    name, number = names[a], 0
                part = vectors.slice(a, b - a)
                held.append(part.flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1))
                flush(False)
        flush(True)
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _opened(self.path)
        for temporary, final in [f for m in messages if m is not None for f in m.files]:
            system.move(temporary, final)
        self._sweep(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._sweep(*_opened(self.path))

    def _sweep(self, system, root: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{root}/_temporary").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/_temporary")


class Matrices(DataSource):
    """Format ``matrices``; options path, range_bytes (read), rows_per_file (write)."""

    @classmethod
    def name(cls) -> str:
        return "matrices"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MatrixReader:
        return MatrixReader(self.options)

    def writer(self, schema, overwrite: bool) -> MatrixWriter:
        return MatrixWriter(self.options)
