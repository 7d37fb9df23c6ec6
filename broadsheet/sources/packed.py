"""A data source of packed records: format("packed") reads and writes files that other programs read.

A record is label u8, length u32, ids u16 each, and pads u16 up to PADDED ids; little-endian, in bz2 files. A file is a
partition; tasks write to a folder of their own write, whose files move to their names when all of them are done.
"""

from __future__ import annotations

import bz2
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

# Ids that a record has at least, and the id that fills it up.
PADDED, PAD = 25, 0
SCHEMA = "label int, len int, ids array<int>"
#: Records of a batch, and bytes read from a file at once.
ROWS, BYTES = 4096, 1 << 20
ENDING = ".bin.bz2"


def files_at(path: str):
    """The file system of a path and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def packed_record(label: int, ids: list[int], pad: int = PAD, least: int = PADDED) -> bytes:
    if not 0 <= label < 256 or any(not 0 <= i < 1 << 16 for i in (*ids, pad)):
        raise ValueError("a label has 8 bits, an id 16")
    more = [pad] * (least - len(ids))
    return struct.pack(f"<BI{len(ids) + len(more)}H", label, len(ids), *ids, *more)


def records(chunks: Iterator[bytes], least: int = PADDED) -> Iterator[tuple[int, int, list[int]]]:
    """(label, length, ids without pads) of a stream of bytes, which may be cut anywhere."""
    data, at = b"", 0
    for more in chunks:
        data, at = data[at:] + more, 0
        while len(data) - at >= 5:
            label, n = struct.unpack_from("<BI", data, at)
            size = 5 + 2 * max(n, least)
            if len(data) - at < size:
                break
            yield label, n, list(struct.unpack_from(f"<{n}H", data, at + 5))
            at += size
    if at < len(data):
        raise ValueError("the file ends within a record")


@dataclass
class File(InputPartition):
    path: str


class PackedReader(DataSourceReader):
    def __init__(self, path: str, least: int) -> None:
        self.path, self.least = path, least

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, path = files_at(self.path)
        found = store.get_file_info(path)
        if found.type == fs.FileType.NotFound:
            raise ValueError(f"there is nothing at {self.path}")
        listed = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path))
        return [File(f.path) for f in sorted(listed, key=lambda f: f.path) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]

    def read(self, partition: File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without files
            return
        store, _ = files_at(self.path)

        def chunks() -> Iterator[bytes]:
            with store.open_input_stream(partition.path, compression=None) as raw, bz2.open(raw) as f:
                while part := f.read(BYTES):
                    yield part

        rows: list[tuple] = []
        for r in records(chunks(), self.least):
            rows.append(r)
            if len(rows) == ROWS:
                yield as_batch(rows)
                rows = []
        if rows:
            yield as_batch(rows)


def as_batch(rows: list[tuple[int, int, list[int]]]) -> pa.RecordBatch:
    label, n, ids = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(n, pa.int32()), pa.array(ids, pa.list_(pa.int32()))], names=["label", "len", "ids"])


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class PackedWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, pad: int, least: int) -> None:
        self.path, self.overwrite, self.pad, self.least = path, overwrite, pad, least
        self.temporary = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, path = files_at(self.path)
        store.create_dir(f"{path}/{self.temporary}", recursive=True)
        own, n = f"{path}/{self.temporary}/{uuid.uuid4().hex}", 0
        with store.open_output_stream(own, compression=None) as raw, bz2.open(raw, "wb") as f:
            for b in iterator:
                for label, ids in zip(b.column("label").to_pylist(), b.column("ids").to_pylist()):
                    f.write(packed_record(label or 0, ids or [], self.pad, self.least))
                    n += 1
        return Written(own if n else None)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, path = files_at(self.path)
        store.create_dir(path, recursive=True)
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(path)):
                if f.type == fs.FileType.File:
                    store.delete_file(f.path)
        name = self.temporary.rpartition("-")[2][:8]
        for k, m in enumerate(x for x in messages if x is not None and x.path):
            store.move(m.path, f"{path}/part-{k:05d}-{name}{ENDING}")
        self.abort(messages)
        with store.open_output_stream(f"{path}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, path = files_at(self.path)
        if store.get_file_info(f"{path}/{self.temporary}").type == fs.FileType.Directory:
            store.delete_dir(f"{path}/{self.temporary}")


class PackedSource(DataSource):
    """Options: path, pad (id of the pads), least (ids that a record has at least).

    Reading gives label, len and ids without pads; rows come file by file. Writing needs the columns label and ids: a null label is 0, null
    ids are none; an id of more than 16 bits or a label of more than 8 is an error, and then nothing is written.
    """

    @classmethod
    def name(cls) -> str:
        return "packed"

    def schema(self) -> str:
        return SCHEMA

    def number(self, name: str, default: int) -> int:
        return int(self.options.get(name, default))

    def reader(self, schema) -> PackedReader:
        return PackedReader(self.options["path"], self.number("least", PADDED))

    def writer(self, schema, overwrite: bool) -> PackedWriter:
        return PackedWriter(self.options["path"], overwrite, self.number("pad", PAD), self.number("least", PADDED))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PackedSource)
