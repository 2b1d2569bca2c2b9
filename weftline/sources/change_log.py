"""A change log as a streaming source: segments of JSON lines that a database's log reader appends to."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

CHANGES = "op string, table string, is_ddl boolean, names array<string>, values array<string>, ts timestamp, corrupt string"
_ARROW = pa.schema([
    ("op", pa.string()), ("table", pa.string()), ("is_ddl", pa.bool_()), ("names", pa.list_(pa.string())), ("values", pa.list_(pa.string())),
    ("ts", pa.timestamp("us", "UTC")), ("corrupt", pa.string()),
])
#: Bytes that one task reads, about, in a large batch.
PIECE = 64 << 20
#: Pieces of a batch, about at most, unless they would be larger than ``PIECE``.
PIECES = 256
#: Bytes read at a time, and past a piece's end, to the end of its last line.
STEP, REST = 1 << 20, 1 << 14


@dataclass
class Piece(InputPartition):
    """The lines of a segment that begin at ``start`` or later, and before ``end``."""

    segment: str
    start: int
    end: int


def _rows(line: bytes) -> Iterator[tuple]:
    """The changed rows of an entry: none of a transaction's begin and end; a line that isn't an entry comes whole as ``corrupt``."""
    try:
        entry = json.loads(line)
        if entry["type"] != "ROWDATA":
            return
        ts = None if entry.get("ts") is None else datetime.fromtimestamp(entry["ts"] / 1000, timezone.utc)
        text = lambda xs: [None if x is None else str(x) for x in xs]
        head = (*text([entry.get("op"), entry.get("table")]), bool(entry.get("is_ddl")))
        rows = [(*head, text(r["names"]), text(r["values"]), ts, None) for r in entry.get("rows") or []]
    except (ValueError, KeyError, TypeError, AttributeError):
        rows = [(None, None, None, None, None, None, line.decode("utf-8", "replace"))]
    yield from rows


def _batch(lines: list[bytes]) -> pa.RecordBatch:
    rows = [row for line in lines for row in _rows(line)]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ARROW)], schema=_ARROW)


class ChangeLogReader(DataSourceStreamReader):
    """Offsets are a segment and a byte in it: all segments before it by name have been read, and of it the bytes before."""

    def __init__(self, path: str, piece: int) -> None:
        self.path, self.piece = path, piece

    def _files(self) -> tuple[fs.FileSystem, dict[str, fs.FileInfo]]:
        system, root = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return system, {f.base_name: f for f in sorted(found, key=lambda f: f.base_name) if f.is_file and f.base_name[0] not in "._"}

    def initialOffset(self) -> dict:
        return {"segment": "", "at": 0}

    def latestOffset(self) -> dict:
        system, files = self._files()
        if not files:
            return self.initialOffset()
        name, info = list(files.items())[-1]
        at = info.size
        with system.open_input_file(info.path) as file:  # back to the end of the last whole line
            while at:
                begin = max(0, at - STEP)
                file.seek(begin)
                cut = file.read(at - begin).rfind(b"\n")
                at = begin + cut + 1 if cut >= 0 else begin
                if cut >= 0:
                    break
        return {"segment": name, "at": at}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        _, files = self._files()
        if start["segment"] and start["segment"] not in files:
            raise ValueError(f"segment {start['segment']} is gone, so what followed in it can't be read")
        spans = []
        for name, info in files.items():
            if start["segment"] <= name <= end["segment"]:
                spans.append((info.path, start["at"] if name == start["segment"] else 0, end["at"] if name == end["segment"] else info.size))
        # A task costs far more than a small piece, so pieces grow with what a batch reads.
        size = max(self.piece, min(PIECE, sum(last - first for _, first, last in spans) // PIECES))
        return [Piece(path, at, min(at + size, last)) for path, first, last in spans for at in range(first, last, size)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        """The rows of a piece, a batch for each ``STEP`` read."""
        system, _ = fs.FileSystem.from_uri(self.path)
        with system.open_input_file(partition.segment) as file:
            at = partition.start
            if at:  # the line that holds the byte before belongs to the piece before
                file.seek(at - 1)
                at = at - 1
            skip, rest = bool(at or partition.start), b""
            while True:
                chunk = file.read(min(STEP, max(REST, partition.end - file.tell())))
                lines = (rest + chunk).split(b"\n")
                rest, own = lines.pop() if chunk else b"", []
                for line in lines:
                    begin, at = at, at + len(line) + 1
                    if skip:
                        skip = False
                    elif begin < partition.end and line.strip():
                        own.append(line)
                if own:
                    yield _batch(own)
                if not chunk or at >= partition.end:
                    return

    def commit(self, end: dict) -> None:
        """Segments are the writer's: nothing is deleted here."""


class ChangeLog(DataSource):
    """``spark.readStream.format("change_log").option("path", folder)``: the columns of ``CHANGES``, a row for each changed row of an entry.

    An entry is a JSON line: type (TRANSACTIONBEGIN, ROWDATA, TRANSACTIONEND), table, op, is_ddl, ts (milliseconds) and rows of names and
    values. Segments lie in one folder that driver and executors share, of any file system that Arrow knows; they are read in the order of their names, and only the last one grows. A line is
    read when it is whole. Option ``piece`` says how many bytes a task reads; in a batch of more than ``PIECES`` such pieces it is more, up to ``PIECE``.
    """

    @classmethod
    def name(cls) -> str:
        return "change_log"

    def schema(self) -> str:
        return CHANGES

    def streamReader(self, schema) -> ChangeLogReader:
        return ChangeLogReader(self.options["path"], int(self.options.get("piece", PIECE)))


def change_log(spark: SparkSession, path: str, piece: int = PIECE) -> DataFrame:
    """The change log of a folder (a URI or an absolute path) as a stream; ``tables.outbox_inserts`` takes it."""
    spark.dataSource.register(ChangeLog)
    return spark.readStream.format("change_log").option("path", path).option("piece", piece).load()
