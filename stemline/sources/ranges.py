"""One file of any size as pieces: tasks read byte ranges.

    spark.dataSource.register(ByteRanges)
    spark.read.format("byte_ranges").option("path", p).option("overlap", 7).load()

yields sid (0), start, n, b like texts.pieces. Options: path (any that pyarrow.fs can open), overlap
(bytes after a piece, for windows that cross its end), piece (bytes of a piece), task (bytes of a
task).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def _open(path: str):
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path)
    return system, place


class ByteRange(InputPartition):
    def __init__(self, start: int, end: int) -> None:
        self.start, self.end = start, end


class ByteRanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return "sid long, start long, n int, b binary"

    def reader(self, schema) -> DataSourceReader:
        return ByteRangeReader(self.options)


class ByteRangeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.overlap, self.piece = int(options.get("overlap", 0)), int(options.get("piece", 1 << 14))
        self.task = max(self.piece, int(options.get("task", 64 << 20)) // self.piece * self.piece)
        system, place = _open(self.path)
        self.size = system.get_file_info(place).size

    def partitions(self) -> list[ByteRange]:
        return [ByteRange(a, min(a + self.task, self.size + 1)) for a in range(0, self.size + 1, self.task)]

    def read(self, partition: ByteRange) -> Iterator[tuple]:
        system, place = _open(self.path)
        with system.open_input_file(place) as file:
            for start in range(partition.start, partition.end, self.piece):
                n = min(self.piece, partition.end - start)
                yield 0, start, n, file.read_at(max(0, min(n + self.overlap, self.size - start)), start) if start < self.size else b""
