"""Series of tracks as data sources: CSV files per track, and caches of NumPy columns.

Register with spark.dataSource.register(TrackCsv) or (TrackCache); then spark.read.format("track_csv" or "track_npz") and df.write.format(...) work.
`path` is a folder that the driver and all executors share.

Both writers put the parts of a track down under names of their own, task by task, and only the commit joins them: it moves one
finished file per track into place, and a job that fails leaves what was there before. A track is written by one task if the table is
partitioned by its keys; if several tasks hold rows of it, the commit stops the job. A task that is run again writes new names, and those of
the lost attempt are swept away with the staging folder.

Columns: the keys (option `keys`, by default "track") name the file, the others are its columns, sorted by the first of them.
Nulls are empty cells in CSV, and masks in caches. Values of keys are escaped, so that no key leaves the folder. An empty table writes nothing.
"""

from __future__ import annotations

import csv
import io
import os
import shutil
import time
import uuid
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Fixed value: the mark that tells spreadsheet programs that a file is UTF-8.
BYTE_ORDER_MARK = "﻿"


@dataclass
class Written(WriterCommitMessage):
    """What a task has put into the staging folder: pairs of a file's final name and its present one."""

    files: list[tuple[str, str]]


@dataclass
class File(InputPartition):
    name: str


def file_name(keys: list, suffix: str) -> str:
    """A name for a track that gives its keys back; null is an empty part."""
    return "~".join("" if k is None else "=" + quote(str(k), safe="").replace("~", "%7E") for k in keys) + suffix


def keys_of(name: str, suffix: str) -> list[str | None]:
    return [unquote(k[1:]) if k else None for k in name[: -len(suffix)].split("~")]


def as_csv(table: pa.Table) -> bytes:
    out = io.StringIO()
    out.write(BYTE_ORDER_MARK)
    write = csv.writer(out, lineterminator="\n")
    write.writerow(table.column_names)
    write.writerows(zip(*(["" if v is None else repr(v) if isinstance(v, float) else str(v) for v in c.to_pylist()] for c in table.columns)))
    return out.getvalue().encode()


def from_csv(data: bytes, fields) -> list[pa.Array]:
    rows = csv.reader(io.StringIO(data.decode("utf-8-sig")))
    names = next(rows, [])
    cells = list(zip(*rows)) or [()] * len(names)
    columns = dict(zip(names, cells))
    missing = [f.name for f in fields if f.name not in columns]
    if missing:
        raise ValueError(f"columns {missing} are not among {names}")
    return [pa.array([None if v == "" else v for v in columns[f.name]], pa.string()).cast(f.type) for f in fields]


def as_npz(table: pa.Table) -> bytes:
    out, arrays = io.BytesIO(), {}
    for name, column in zip(table.column_names, table.columns):
        column = column.combine_chunks()
        if pa.types.is_string(column.type):
            arrays[f"v:{name}"] = np.array(["" if v is None else v for v in column.to_pylist()], dtype=np.str_)
        else:
            arrays[f"v:{name}"] = column.fill_null(False if pa.types.is_boolean(column.type) else 0).to_numpy(zero_copy_only=False)
        arrays[f"m:{name}"] = column.is_null().to_numpy(zero_copy_only=False)
    np.savez_compressed(out, **arrays)
    return out.getvalue()


def from_npz(data: bytes, fields) -> list[pa.Array]:
    with np.load(io.BytesIO(data), allow_pickle=False) as held:
        return [pa.array(held[f"v:{f.name}"], mask=held[f"m:{f.name}"]).cast(f.type) for f in fields]


class TrackWriter(DataSourceArrowWriter):
    def __init__(self, path: str, keys: list[str], suffix: str, encode, overwrite: bool):
        self.path, self.keys, self.suffix, self.encode, self.overwrite = path, keys, suffix, encode, overwrite
        self.staging = os.path.join(path, f"_staging-{uuid.uuid4().hex}")
        os.makedirs(self.staging)  # by the driver alone: a task that outlives an abort finds no folder and can't leave one behind

    def write(self, iterator) -> Written:
        batches = [b for b in iterator if len(b)]
        if not batches:
            return Written([])
        table = pa.Table.from_batches(batches)
        columns = [n for n in table.column_names if n not in self.keys]
        table = table.sort_by([(n, "ascending") for n in [*self.keys, *columns[:1]]])
        keys = list(zip(*(table.column(k).to_pylist() for k in self.keys)))
        files, at = [], 0
        for end in range(1, len(keys) + 1):
            if end < len(keys) and keys[end] == keys[at]:
                continue
            staged = os.path.join(self.staging, uuid.uuid4().hex)
            with open(staged, "wb") as out:
                out.write(self.encode(table.slice(at, end - at).select(columns)))
            files.append((file_name(keys[at], self.suffix), staged))
            at = end
        return Written(files)

    def commit(self, messages) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        names = [n for n, _ in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("rows of one track stand in several tasks: repartition by the keys first")
        os.makedirs(self.path, exist_ok=True)
        old = {n for n in os.listdir(self.path) if n.endswith(self.suffix)} if self.overwrite else set()
        for name, staged in files:
            os.replace(staged, os.path.join(self.path, name))
        for name in old - set(names):
            os.remove(os.path.join(self.path, name))
        self.clear()

    def abort(self, messages) -> None:
        self.clear()

    def clear(self) -> None:
        for _ in range(50):  # a task not yet stopped may put a file into the folder while it is emptied
            shutil.rmtree(self.staging, ignore_errors=True)
            if not os.path.isdir(self.staging):
                break
            time.sleep(0.1)


class TrackReader(DataSourceReader):
    def __init__(self, path: str, keys: list[str], suffix: str, decode, schema: StructType):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.path, self.keys, self.suffix, self.decode, self.kinds = path, keys, suffix, decode, to_arrow_schema(schema)

    def partitions(self) -> list[File]:
        return [File(n) for n in sorted(os.listdir(self.path)) if n.endswith(self.suffix)] or [File("")]

    def read(self, partition: File):
        if not partition.name:
            return
        with open(os.path.join(self.path, partition.name), "rb") as f:
            data = f.read()
        own = [f for f in self.kinds if f.name not in self.keys]
        columns = dict(zip((f.name for f in own), self.decode(data, own)))
        n = len(next(iter(columns.values()))) if columns else 0
        for k, v in zip(self.keys, keys_of(partition.name, self.suffix)):
            columns[k] = pa.repeat(pa.scalar(v, pa.string()), n).cast(self.kinds.field(k).type)
        yield pa.RecordBatch.from_arrays([columns[f.name] for f in self.kinds], schema=self.kinds)


class TrackSource(DataSource):
    """Options: path, keys (comma-separated). Reading needs a schema."""

    SUFFIX, encode, decode = "", None, None

    def _options(self) -> tuple[str, list[str]]:
        if not self.options.get("path"):
            raise ValueError("a path is needed")
        return self.options["path"], [k.strip() for k in self.options.get("keys", "track").split(",")]

    def reader(self, schema: StructType) -> TrackReader:
        return TrackReader(*self._options(), self.SUFFIX, type(self).decode, schema)

    def writer(self, schema: StructType, overwrite: bool) -> TrackWriter:
        path, keys = self._options()
        if missing := [k for k in keys if k not in schema.names]:
            raise ValueError(f"keys {missing} are not among {schema.names}")
        return TrackWriter(path, keys, self.SUFFIX, type(self).encode, overwrite)


class TrackCsv(TrackSource):
    """One CSV file a track, with a byte order mark."""

    SUFFIX, encode, decode = ".csv", staticmethod(as_csv), staticmethod(from_csv)

    @classmethod
    def name(cls) -> str:
        return "track_csv"


class TrackCache(TrackSource):
    """One compressed NumPy archive a track, of a value and a mask array for each column."""

    SUFFIX, encode, decode = ".npz", staticmethod(as_npz), staticmethod(from_npz)

    @classmethod
    def name(cls) -> str:
        return "track_npz"
