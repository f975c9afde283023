"""Where observations come from: a table that exists, or an extractor that reads media files.

Extractors need decoders and trackers that are no part of this engine; they are plugged in as a function.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.sources.files import MEDIA

OBSERVATIONS = "sample string, object string, i int, t double, x double, y double, r double, valid boolean"


def read(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table of observations; NaN coordinates become null and unobserved."""
    rows = spark.read.schema(OBSERVATIONS).parquet(path)
    rows = rows.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("x", "y", "r")})
    return rows.withColumn("valid", F.coalesce(F.col("valid") & F.col("x").isNotNull() & F.col("y").isNotNull(), F.lit(False)))


def from_media(spark: SparkSession, root: str, extract: Callable[[str, bytes], Iterator[tuple]], partitions: int | None = None) -> DataFrame:
    """Observations of all media files below root: extract(path, content) gives rows of OBSERVATIONS.

    Files are dealt one by one to tasks; a task holds one file at a time.
    """
    names = "*.{" + ",".join(MEDIA) + "}"
    media = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(root).select("path", "content")
    if partitions:
        media = media.repartition(partitions, "path")
    columns = [c.split()[0] for c in OBSERVATIONS.split(", ")]

    def run(frames):
        import pandas as pd

        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                yield pd.DataFrame(list(extract(path, content)), columns=columns)

    return media.mapInPandas(run, OBSERVATIONS)


def inside_frame(box: Column) -> Column:
    """Whether a normalised box (x, y, w, h) has a size and lies within the frame."""
    x, y, w, h = (F.get(box, F.lit(k)) for k in range(4))
    return F.coalesce((F.size(box) == 4) & (x >= 0) & (y >= 0) & (w > 0) & (h > 0) & (x + w <= 1) & (y + h <= 1), F.lit(False))


def boxes_or_default(boxes: Column, names: list[str], default: dict[str, list[float]]) -> Column:
    """A map of boxes in which missing and invalid ones are replaced by their default."""
    pairs = []
    for n in names:
        own = F.try_element_at(boxes, F.lit(n))
        pairs += [F.lit(n), F.when(inside_frame(own), own).otherwise(F.array(*map(F.lit, default[n])))]
    return F.create_map(*pairs)
