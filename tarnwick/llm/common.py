"""What the operators of this subpackage share: reading tables and cutting lineage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A folder that driver and executors share, from spark.checkpoint.dir.

    Only where that setting is absent and Spark is local (tests) a folder of this machine is set; on a cluster without it
    an error is raised, as executors could not read what lies on the driver's disk.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tarnwick-"))
    return context.getCheckpointDir()


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared scratch folder and reads it back: lineage ends there.

    The table survives the loss of any executor, and what follows neither scans the
    texts again nor depends on how the rows were computed.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Texts in one Arrow batch: buffers of some MB in a task instead of the default's tens of MB.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows of an Arrow batch to BATCH_ROWS, as texts are long; never raises them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


_held: dict[str, Callable[[], None]] = {}


def holds(name: str, clear: Callable[[], None]) -> None:
    """Says how a worker's tables of that name are emptied."""
    _held[name] = clear


def release(keep: str | None = None) -> None:
    """Empties the tables that a worker holds from other operators' tasks, and gives free memory back: workers outlive stages."""
    for name, clear in _held.items():
        if name != keep:
            clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def arrow_rows(frame: DataFrame, function, schema: str, keep: str | None = None) -> DataFrame:
    """mapInArrow of a generator function from record batches to column dicts; keep names the tables that it uses."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(StructType.fromDDL(schema))
    small_batches(frame.sparkSession)

    def run(batches):
        release(keep)
        for columns in function(batches):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in kinds], schema=kinds)
        columns = None
        release(keep)  # an idle worker then holds little

    return frame.mapInArrow(run, schema)


def text_bytes(column: str = "text"):
    """The UTF-8 bytes of a text column, null as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def keep_rows(docs: DataFrame, predicate) -> DataFrame:
    """The rows of docs that a predicate, made anew in each task by predicate(), keeps.

    The predicate takes a record batch and gives a flag for each row. All columns go through as
    they are, and no row moves to another partition.
    """

    small_batches(docs.sparkSession)

    def run(batches):
        release()
        kept = predicate()
        for b in batches:
            yield b.filter(pa.array(kept(b), pa.bool_()))
        kept = b = None
        release()

    return docs.mapInArrow(run, docs.schema)


def unused(names: list[str], n: int) -> list[str]:
    """n column names that none of `names` is, in whatever case."""
    taken = {x.lower() for x in names}
    return list(islice((x for x in map("_x{}".format, count()) if x not in taken), n))


def joined_if_small(rows: int, most: int, frame: DataFrame) -> DataFrame:
    """A counted table, broadcast up to `most` rows; beyond it Spark shuffles both sides."""
    return F.broadcast(frame) if rows <= most else frame
