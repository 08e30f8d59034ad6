"""A source of text files that grow: each line once, with a number that orders all lines.

Files are read in the order of the first number in their names, as logs that roll over have; all
but the last one are complete. A place in the stream is a file and a byte in it, and so is ``arr``,
the number of a line: the file's number above the byte its line begins at. A line counts when its
line break is there. Files before the last one may be removed once they were read.
"""

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

# The source travels to the workers by value; they need no copy of this.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bits of ``arr`` for the byte; the file's number has those above, up to 2^61.
BITS = 36
FILES = 1 << (61 - BITS)
BLOCK = 1 << 20


@dataclass
class Stretch(InputPartition):
    """The lines that begin from byte ``start`` up to ``end`` of a file."""

    path: str
    number: int
    start: int
    end: int


class LineTail(DataSource):
    """Options: ``path``, a folder, and ``split``, bytes of a file in one task."""

    @classmethod
    def name(cls) -> str:
        return "line_tail"

    def schema(self) -> str:
        return "value string, arr long"

    def streamReader(self, schema) -> "LineReader":
        return LineReader(self.options["path"], int(self.options.get("split", 64 << 20)))


class LineReader(DataSourceStreamReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def _store(self) -> tuple[fs.FileSystem, str]:
        if "://" in self.path and not self.path.startswith("file:"):
            return fs.FileSystem.from_uri(self.path)
        return fs.LocalFileSystem(), re.sub("^file:/+", "/", self.path)

    def _files(self) -> list[tuple[int, str, int]]:
        """(number, path, size) in order; hidden files are none."""
        store, folder = self._store()
        out = []
        for info in store.get_file_info(fs.FileSelector(folder)):
            if info.type != fs.FileType.File or info.base_name[0] in "._":
                continue
            number = re.search(r"\d+", info.base_name)
            if not number or int(number[0]) >= FILES or info.size >= 1 << BITS:
                raise ValueError(f"{info.path}: a name needs a number below {FILES}, a size below 2^{BITS}")
            out.append((int(number[0]), info.path, info.size))
        out.sort()
        if any(a[0] == b[0] for a, b in zip(out, out[1:])):
            raise ValueError(f"{self.path}: two files have one number")
        return out

    def initialOffset(self) -> dict:
        return {"file": -1, "at": 0}

    def latestOffset(self) -> dict:
        """The end of the last whole line of the last file."""
        files = self._files()
        if not files:
            return self.initialOffset()
        number, path, size = files[-1]
        store, _ = self._store()
        with store.open_input_file(path) as file:
            end = size
            while end:
                start = max(0, end - BLOCK)
                at = file.read_at(end - start, start).rfind(b"\n")
                if at >= 0:
                    return {"file": number, "at": start + at + 1}
                end = start
        return {"file": number, "at": 0}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        out = []
        for number, path, size in self._files():
            if start["file"] <= number <= end["file"]:
                first = start["at"] if number == start["file"] else 0
                last = end["at"] if number == end["file"] else size
                for at in range(first, last, self.split):
                    out.append(Stretch(path, number, at, min(at + self.split, last)))
        return out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        store, _ = self._store()
        with store.open_input_file(partition.path) as file:
            at, size = partition.start, file.size()
            held, cut = b"", at > 0 and file.read_at(1, at - 1) != b"\n"
            place = at  # of what is held
            while True:
                block = file.read_at(min(BLOCK, size - at), at) if at < size else b""
                at += len(block)
                *lines, held = (held + block).split(b"\n")
                if not block and held:  # the last line of a complete file may lack its break
                    lines, held = [held], b""
                values, places = [], []
                for line in lines:
                    if place >= partition.end:
                        break
                    if not cut:
                        values.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                        places.append((partition.number << BITS) + place)
                    cut, place = False, place + len(line) + 1
                if values:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(values, pa.string()), pa.array(places, pa.int64())], ["value", "arr"]
                    )
                if not block or place >= partition.end:
                    return

    def commit(self, end: dict) -> None:
        """Nothing is kept of what was read."""


def tail_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """The lines of a folder of growing files as a stream of (value, arr)."""
    spark.dataSource.register(LineTail)
    return spark.readStream.format("line_tail").options(path=path, **options).load()
