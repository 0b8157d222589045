"""Suffix arrays as tables sorted by rank, and as raw files of 64-bit positions."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(sa: DataFrame, path: str) -> None:
    """sid, rank, pos as Parquet, in ranges of (sid, rank), sorted."""
    sa.select("sid", "rank", "pos").repartitionByRange("sid", "rank").sortWithinPartitions("sid", "rank").write.mode("overwrite").parquet(path)


def write_raw(sa: DataFrame, folder: str, chunk: int) -> DataFrame:
    """Of one string: positions in rank order as little-endian 64-bit integers, in files suffixarray_<c> of `chunk` ranks
    each. Returns path and number of positions. A file is written whole under another name and then moved, so a task may
    run again."""
    parts = sa.withColumn("c", F.floor(F.col("rank") / chunk))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        held: dict[int, list] = {}
        for b in batches:
            c, rank, pos = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            for k in np.unique(c).tolist():
                held.setdefault(k, []).append((rank[c == k], pos[c == k]))
        for k, part in held.items():
            rank, pos = (np.concatenate(x) for x in zip(*part, strict=True))
            system, place = fs.FileSystem.from_uri(folder)
            system.create_dir(place, recursive=True)
            name = f"{place}/suffixarray_{k}"
            temporary = f"{name}.{uuid.uuid4().hex}"
            with system.open_output_stream(temporary, compression=None) as out:
                out.write(pos[np.argsort(rank)].astype("<i8").tobytes())
            system.move(temporary, name)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(pos)])], ["path", "n"])

    return parts.select("c", "rank", "pos").repartition(F.col("c")).mapInArrow(write, "path string, n long")
