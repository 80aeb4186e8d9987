"""A streaming source of files that grow, read by byte positions.

Spark's file source takes a file once and whole. Here an offset has, for every file, the
byte after its last complete record, so that a log that grew is read from where it
ended: a line or a binary row that is half written appears once it is complete, and
a restart from a checkpoint repeats nothing. The driver looks at sizes and at the tails
of files that grew; the records are read by tasks, a large range by many of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from orbitweave.sources.run_logs import HISTORY

#: Bytes of a tail that are looked at in one go; rows that a task hands over at a time.
_TAIL, _ROWS = 64 << 10, 20_000


@dataclass
class Range(InputPartition):
    """Records of a file that start from ``low`` up to ``high``; the range of the trigger begins at ``begin``."""

    path: str
    begin: int
    low: int
    high: int


class GrowingReader(DataSourceStreamReader):
    """Options: ``path`` of a folder, ``pattern`` of file names, ``record_bytes`` (0: lines), ``split_bytes`` a task."""

    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.pattern = options["path"], options.get("pattern", "*")
        self.width = int(options.get("record_bytes", "0"))
        self.split = int(options.get("split_bytes", str(32 << 20)))
        self.known: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """{file: end of its last complete record} of all files that have one: what changed since is what differs."""
        store, folder = fs.FileSystem.from_uri(self.folder)
        ends = {}
        for info in store.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True)):
            name = info.base_name
            if info.type != fs.FileType.File or name[:1] in "._" or not fnmatch(name, self.pattern):
                continue
            size, end = self.known.get(info.path, (-1, 0))
            if size != info.size:
                end = info.size // self.width * self.width if self.width else self._last_line(store, info.path, info.size)
                self.known[info.path] = info.size, end
            if end:
                ends[info.path] = end
        return ends

    @staticmethod
    def _last_line(store: fs.FileSystem, path: str, size: int) -> int:
        with store.open_input_file(path) as file:
            while size > 0:
                low = max(0, size - _TAIL)
                file.seek(low)
                found = file.read(size - low).rfind(b"\n")
                if found >= 0:
                    return low + found + 1
                size = low
        return 0

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        """Byte ranges between two offsets; a file that became shorter is another one and read anew."""
        step = max(1, self.split // self.width) * self.width if self.width else self.split
        ranges = []
        for path, stop in sorted(end.items()):
            begin = start.get(path, 0)
            begin = begin if begin <= stop else 0
            ranges += [Range(path, begin, low, min(low + step, stop)) for low in range(begin, stop, step)]
        return ranges

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.folder)
        with store.open_input_file(partition.path) as file:
            records, low = (self._rows if self.width else self._lines)(file, partition)
        starts = np.cumsum([0] + [len(r) for r in records]) + low
        for k in range(0, len(records), _ROWS):
            own = records[k : k + _ROWS]
            text = own if self.width else [r[:-1] for r in own]
            columns = [pa.array([partition.path] * len(own)), pa.array(starts[k : k + len(own)], pa.int64()), pa.array(text, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["path", "position", "record"])

    def _rows(self, file: pa.NativeFile, part: Range) -> tuple[list[bytes], int]:
        file.seek(part.low)
        content = file.read(part.high - part.low)
        return [content[k : k + self.width] for k in range(0, len(content), self.width)], part.low

    @staticmethod
    def _lines(file: pa.NativeFile, part: Range) -> tuple[list[bytes], int]:
        """Whole lines, with their ends, that start in the range."""

        def until_end(at: int) -> int:
            """The first start of a line at or after ``at``."""
            file.seek(at - 1)
            while block := file.read(_TAIL):
                if (found := block.find(b"\n")) >= 0:
                    return at + found
                at += len(block)
            return at

        low = part.low if part.low == part.begin else until_end(part.low)
        high = until_end(part.high)
        file.seek(low)
        lines = file.read(max(0, high - low)).split(b"\n")
        return [line + b"\n" for line in lines[:-1]], low

    def commit(self, end: dict) -> None:
        """Nothing is held for readers."""


class GrowingFiles(DataSource):
    """``growing_files``: (path, position, record) of every complete record."""

    @classmethod
    def name(cls) -> str:
        return "growing_files"

    def schema(self) -> str:
        return "path string, position long, record binary"

    def streamReader(self, schema: object) -> GrowingReader:
        return GrowingReader(self.options)


def read_growing(spark: SparkSession, folder: str, pattern: str = "*", record_bytes: int = 0, split_bytes: int = 32 << 20) -> DataFrame:
    """A stream of (path, position, record) from the files of a folder and those below it.

    Lines come without their end; records of ``record_bytes`` are binary rows. ``folder`` is an absolute path or a URI
    that both driver and executors can open. An offset names every file, so folders are to be of runs, not of all time.
    """
    spark.dataSource.register(GrowingFiles)
    reader = spark.readStream.format("growing_files").option("path", folder).option("pattern", pattern)
    return reader.option("record_bytes", record_bytes).option("split_bytes", split_bytes).load()


def follow_history(spark: SparkSession, folder: str, pattern: str = "history.jsonl") -> DataFrame:
    """A stream of (run_id, step, loss, new_best, written) from histories that grow.

    The run is the history's folder and ``written`` the line's position. A line that is no JSON object with a step has a
    null step: ``run_progress`` takes nothing of the run from there on.
    """
    row = F.from_json(F.col("record").cast("string"), HISTORY)
    parsed = read_growing(spark, folder, pattern).select(F.regexp_replace("path", "/[^/]*$", "").alias("run_id"), row.alias("r"), F.col("position").alias("written"))
    return parsed.select("run_id", "r.step", "r.loss", "r.new_best", "written")


def follow_knob_rows(spark: SparkSession, folder: str, knobs: Sequence[str], pattern: str = "knobs.f64") -> DataFrame:
    """A stream of (run_id, step, written, values) from binary rows of doubles [step, value of each knob] that grow."""
    width = 8 * (1 + len(knobs))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.frombuffer(b"".join(batch.column("record").to_pylist()), "<f8").reshape(-1, 1 + len(knobs))
            offsets = pa.array(np.arange(len(table) + 1) * len(knobs), pa.int32())
            values = pa.ListArray.from_arrays(offsets, pa.array(table[:, 1:].ravel()))
            steps = pa.array(table[:, 0].astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("path"), steps, batch.column("position"), values], ["path", "step", "written", "values"])

    rows = read_growing(spark, folder, pattern, record_bytes=width).mapInArrow(unpack, "path string, step long, written long, values array<double>")
    return rows.select(F.regexp_replace("path", "/[^/]*$", "").alias("run_id"), "step", "written", "values")
