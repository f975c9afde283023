"""Reading manifests, prompts and media listings; writing results. Schemas are always given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwick.functions.text import file_name, prompt_of, seed_of, stem, task_ids

JOB = T.StructType([T.StructField(n, T.StringType()) for n in ("model", "task")] + [T.StructField("seed", T.IntegerType())])
for _name in ("sample_id", "video", "image", "prompt", "prompt_source", "annotation"):
    JOB.add(_name, T.StringType())
JOB.add("backend_args", T.ArrayType(T.StringType()))
MEDIA = ("mp4", "mov", "mkv", "avi", "webm")


def read_manifest(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """Jobs of a JSON array, or of an object with items or samples; rows without task or video are an error."""
    items = T.ArrayType(JOB)
    whole = spark.read.text(path, wholetext=True)
    wrapped = F.from_json("value", T.StructType().add("items", items).add("samples", items))
    rows = F.when(F.trim("value").startswith("["), F.from_json("value", items)).otherwise(F.coalesce(wrapped["items"], wrapped["samples"]))
    jobs = whole.select(F.explode(rows).alias("job")).select("job.*")
    jobs = jobs.withColumn("model", F.coalesce("model", F.lit(model).cast("string"))).withColumn("sample_id", F.coalesce("sample_id", stem(F.col("video"))))
    ok = F.col("task").isNotNull() & F.col("video").isNotNull() & F.col("model").isNotNull()
    return jobs.withColumn("_ok", F.when(ok, True).otherwise(F.raise_error(F.lit("a manifest row needs task, video and model")))).filter("_ok").drop("_ok")


def scan_media(spark: SparkSession, root: str, model: str | None = None) -> DataFrame:
    """Jobs from a folder: task id from the name, else from the path, exactly one; seed from the name; model from the first folder."""
    names = "*.{" + ",".join(MEDIA) + "}"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(root).select("path", "length", "modificationTime")
    inside = F.split(F.regexp_replace("path", "^.*" + root.rstrip("/").replace(".", r"\.") + "/", ""), "/")
    own = task_ids(stem(F.col("path")))
    tasks = F.when(F.size(own) > 0, own).otherwise(F.array_distinct(F.flatten(F.transform(F.slice(inside, 1, F.greatest(F.lit(0), F.size(inside) - 1)), lambda p: task_ids(p)))))
    first = F.when(F.size(inside) > 1, F.get(inside, F.lit(0)))
    return found.select(
        "path", F.coalesce(F.lit(model).cast("string"), first).alias("model"), F.when(F.size(tasks) == 1, F.get(tasks, F.lit(0))).alias("task"),
        F.size(tasks).alias("task_candidates"), seed_of(stem(F.col("path"))).alias("seed"), file_name(F.col("path")).alias("file"), "length",
    )


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), prompt_of(F.col("value")).alias("prompt"))


def finite_only(df: DataFrame) -> DataFrame:
    """Doubles that are NaN or infinite as nulls: no such value leaves the engine."""
    fix = {f.name: F.when(~F.isnan(f.name) & (F.abs(f.name) != float("inf")), F.col(f.name)) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(fix) if fix else df


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; the commit protocol makes the folder appear whole or not at all."""
    finite_only(df).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> bool:
    """CSV with a header; nothing is written for an empty table."""
    if df.isEmpty():
        return False
    finite_only(df).write.mode("overwrite").option("header", True).csv(path)
    return True


def write_series(df: DataFrame, path: str, keys: list[str]) -> None:
    """Per-frame columns as Parquet folders by key."""
    finite_only(df).repartition(*keys).write.mode("overwrite").partitionBy(*keys).parquet(path)


def even_frames(meta: DataFrame, n: int) -> DataFrame:
    """frame and second of n evenly spaced frames (rounded half to even, each once) of clips with n_frames and fps."""
    at = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.bround(k * (F.col("n_frames") - 1) / F.lit(float(max(1, n - 1)))).cast("int"))
    return meta.withColumn("frame", F.explode(F.array_distinct(at))).withColumn("second", F.col("frame") / F.col("fps"))


#: What a file beside a result is, by its suffix.
ARTIFACTS = {"png": "image", "jpg": "image", "jpeg": "image", "mp4": "video", "csv": "measurement_data", "json": "measurement_data", "npz": "coordinate_cache", "parquet": "coordinate_cache"}


def list_artifacts(spark: SparkSession, root: str, since: float = 0.0) -> DataFrame:
    """path, kind, length and modified of the files below a folder that are of a known kind and not older than a second before `since` (Unix seconds)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    kinds = F.create_map(*[F.lit(x) for pair in ARTIFACTS.items() for x in pair])
    found = found.withColumn("kind", F.try_element_at(kinds, F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))))
    return found.filter(F.col("kind").isNotNull() & (F.unix_micros("modified") / 1e6 >= since - 1)).select("path", "kind", "length", "modified")
