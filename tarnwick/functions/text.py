"""Names, paths, hashes and JSON of experiment files as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The forms of names.
TASK_ID = r"(?:^|[_-])(P\d+[a-z]?)(?=[_.-]|$)"
SEED = r"(?:^|[_-])seed(\d+)(?=[_.-]|$)"
SAFE_NAME = r"^[A-Za-z0-9][A-Za-z0-9._-]*$"


def task_ids(name: Column) -> Column:
    """The distinct task ids in a name."""
    return F.array_distinct(F.regexp_extract_all(name, F.lit(TASK_ID), 1))


def seed_of(name: Column) -> Column:
    found = F.regexp_extract(name, SEED, 1)
    return F.when(found != "", found.cast("int"))


def is_safe_name(name: Column) -> Column:
    return name.rlike(SAFE_NAME)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r"(\.[^.]*)$", 1)


def task_number(task: Column) -> Column:
    """The number by which tasks are ordered: P10 comes after P9."""
    return F.regexp_extract(task, r"^P(\d+)", 1).cast("int")


def prompt_of(document: Column) -> Column:
    """The prompt in a prompt file: JSON with a prompt at one of three places, a JSON string, or the text itself."""
    paths = ("$.prompt", "$.arguments.prompt", "$.sample.prompt")
    found = [F.get_json_object(document, p) for p in paths]
    plain = F.when(F.trim(document).rlike(r'^"(?s:.*)"$'), F.get_json_object(F.concat(F.lit('{"v":'), document, F.lit("}")), "$.v")).otherwise(F.trim(document))
    return F.when(F.trim(document).startswith("{"), F.coalesce(*found)).otherwise(plain)


def canonical_hash(*columns: Column) -> Column:
    """SHA-256 of the JSON of columns in the order of their names, nulls included."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def strip_fences(reply: Column) -> Column:
    """A reply without the code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(reply), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


#: Folders whose place in a path is public, and a model's other spelling.
VIDEO_FOLDER, IMAGE_FOLDER, SPELLINGS = "output_videos", "first_frames", {"minimax_h3": "minimax-h3"}


def last_integer(name: Column) -> Column:
    """The last run of digits in a name."""
    found = F.regexp_extract(name, r"(\d+)\D*$", 1)
    return F.when(found != "", found.cast("long"))


def public_model(model: Column) -> Column:
    out = model
    for other, name in SPELLINGS.items():
        out = F.when(F.lower(model) == other, F.lit(name)).otherwise(out)
    return out


def public_video(path: Column, folder: Column | None = None) -> Column:
    """The path of a video within its package: the model's folder, videos, and the file; other paths stay."""
    inside = F.regexp_extract(path, rf"(?:^|/){VIDEO_FOLDER}/([^/]+)", 1)
    found = F.coalesce(F.lit(None) if folder is None else folder, F.when(inside != "", inside))
    return F.when(path.rlike(rf"(?:^|/){VIDEO_FOLDER}(?:/|$)") & found.isNotNull(), F.concat(found, F.lit("/videos/"), file_name(path))).otherwise(path)


def public_image(path: Column) -> Column:
    """The path of an image from the folder of first frames on; other paths stay."""
    inside = F.regexp_extract(path, rf"(?:^|/)({IMAGE_FOLDER}(?:/.*)?)$", 1)
    return F.when(inside != "", inside).otherwise(path)


def command(template: list[str], **values: Column) -> Column:
    """The words of a command, with {name} in each replaced by a value as text; a missing value leaves the word null."""
    words = []
    for part in template:
        word = F.lit(part)
        for name, value in values.items():
            if f"{{{name}}}" in part:
                word = F.replace(word, F.lit(f"{{{name}}}"), value.cast("string"))
        words.append(word)
    return F.array(*words)
