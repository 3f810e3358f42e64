"""Message archives: many messages to a file, read in splits and as a stream.

One file per message costs a listing entry and an open per message. An archive is a plain
mbox (mboxrd): every message begins with a line ``From <name> -``, and lines of a message that look
like one are quoted with ``>``, so a message comes back byte by byte. As a line tells where a message begins, a
large archive is cut into byte ranges, and each task reads the messages that begin in its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quayside.session import bounded_batches

FORMAT = "message_archives"
SCHEMA = "path string, content binary"
SPLIT_BYTES = 64 << 20
FILE_BYTES = 256 << 20
BATCH_BYTES = 4 << 20
_PIECE = 1 << 20
_START = b"\nFrom "
_QUOTE = re.compile(rb"^(>*From )", re.M)
_UNQUOTE = re.compile(rb"^>(>*From )", re.M)


def packed(name: str, content: bytes) -> bytes:
    """A message as it stands in an archive."""
    return b"From " + quote(name, safe="/:@").encode() + b" -\n" + _QUOTE.sub(rb">\1", content) + b"\n"


def _unpacked(message: bytes) -> tuple[str, bytes]:
    head, _, body = message.partition(b"\n")
    return unquote(head[5:].rpartition(b" ")[0].decode()), _UNQUOTE.sub(rb"\1", body[:-1])


def messages_between(file, size: int, start: int, end: int) -> Iterator[tuple[str, bytes]]:
    """(name, content) of the messages of an archive that begin from ``start`` to before ``end``; the last may end after it."""
    # The byte before a range tells whether a line begins with it; a file begins with one anyway.
    at = max(0, start - 1)
    file.seek(at)
    held = b"" if start else b"\n"
    base = at - len(held)
    begun = None
    while True:
        piece = file.read(_PIECE)
        searched = max(0, len(held) - len(_START) + 1) if begun is not None else 0
        held += piece
        while True:
            found = held.find(_START, searched)
            if found < 0:
                break
            if begun is not None:
                yield _unpacked(held[begun:found + 1])
            if base + found + 1 >= end:
                return
            begun, searched = found + 1, found + 1
        if begun is None:
            cut = max(0, len(held) - len(_START) + 1)
            if base + cut + 1 >= end:
                return
        else:
            cut, begun = begun - 1, 1
        held, base = held[cut:], base + cut
        if not piece:
            if begun is not None:
                yield _unpacked(held[begun:])
            return


@dataclass
class _Range(InputPartition):
    path: str
    size: int
    start: int
    end: int


def _archives(folder: str) -> list[tuple[str, int]]:
    """(path, bytes) of the archives of a folder, by name; names beginning with ``_`` or ``.`` are not there yet."""
    store, root = fs.FileSystem.from_uri(folder)
    found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    files = [(f.path, f.size) for f in found if f.type == fs.FileType.File and not any(p[:1] in "_." for p in f.path.removeprefix(root).strip("/").split("/"))]
    return sorted(files, key=lambda f: f[0].removeprefix(root))


def _ranges(files: list[tuple[str, int]], split: int) -> list[_Range]:
    return [_Range(path, size, at, min(at + split, size)) for path, size in files for at in range(0, size, split)]


class _Folder:
    def __init__(self, options: dict):
        self.folder, self.split = options["path"], int(options.get("splitBytes", SPLIT_BYTES))

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.folder)
        names, contents, held = [], [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])

        with store.open_input_file(part.path) as file:
            for name, content in messages_between(file, part.size, part.start, part.end):
                names.append(name)
                contents.append(content)
                held += len(content)
                if held >= BATCH_BYTES:
                    yield batch()
                    names, contents, held = [], [], 0
        if names:
            yield batch()


class _Reader(_Folder, DataSourceReader):
    def partitions(self) -> list[_Range]:
        return _ranges(_archives(self.folder), self.split) or [_Range("", 0, 0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if part.path:
            yield from super().read(part)


class _StreamReader(_Folder, DataSourceStreamReader):
    """An offset is the name of the last archive that was seen: new archives have greater names."""

    def _named(self) -> list[tuple[str, tuple[str, int]]]:
        _, root = fs.FileSystem.from_uri(self.folder)
        return [(f[0].removeprefix(root), f) for f in _archives(self.folder)]

    def initialOffset(self) -> dict:
        return {"last": ""}

    def latestOffset(self) -> dict:
        names = self._named()
        return {"last": names[-1][0] if names else ""}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        return _ranges([f for name, f in self._named() if start["last"] < name <= end["last"]], self.split)


class MessageArchives(DataSource):
    """``spark.read.format("message_archives").load(folder)`` and the same with ``readStream``: (path, content) rows."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def read_message_archives(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, content) of every message in the archives of a folder, in splits of ``split_bytes``."""
    spark.dataSource.register(MessageArchives)
    return spark.read.format(FORMAT).option("splitBytes", split_bytes).load(folder)


def stream_message_archives(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The same as a stream: a micro-batch takes the archives whose names are greater than those seen before."""
    spark.dataSource.register(MessageArchives)
    return spark.readStream.format(FORMAT).option("splitBytes", split_bytes).load(folder)


def write_message_archives(messages: DataFrame, folder: str, name: str = "part", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Pack (path, content) rows into archives; one row (archive, messages, bytes) per file.

    Each task writes its own files, begins the next at ``file_bytes``, and gives a file its name when it is
    whole; the name follows the partition, so a task that runs again replaces what it wrote. The
    result is lazy: the files are there once its rows were taken. Null contents are empty messages.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        stem, number = f"{name}-{task.partitionId():06d}", 0
        made: list[tuple[str, int, int]] = []
        out, count, size = None, 0, 0

        def finish() -> None:
            nonlocal out, number, count, size
            out.close()
            store.move(f"{root}/_{stem}-{task.taskAttemptId()}", f"{root}/{stem}-{number:06d}.mbox")
            made.append((f"{root}/{stem}-{number:06d}.mbox", count, size))
            out, number, count, size = None, number + 1, 0, 0

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out = out or store.open_output_stream(f"{root}/_{stem}-{task.taskAttemptId()}")
                size += out.write(packed(path or "", content or b""))
                count += 1
                if size >= file_bytes:
                    finish()
        if out:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["archive", "messages", "bytes"])

    bounded_batches(messages.sparkSession)
    return messages.select("path", "content").mapInArrow(run, "archive string, messages long, bytes long")
