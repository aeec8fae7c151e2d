"""Sources and sinks of records: track JSON, answers, phases, labels, digests, detectors."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, is_dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME = (
    "frame_index long, time_seconds double, mask_area_fraction double, sam_confidence double, has_mask boolean, detection_box array<double>, detection_score double, "
    "truck_box array<double>, detection_truck_iou double, detection_mask_iou double, bucket_area_fraction double, bucket_confidence double, has_bucket_mask boolean"
)


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """One row per frame of each track file (or of the files below a folder); fields that an older file lacks are NULL."""
    files = spark.read.schema(f"clip string, frames array<struct<{FRAME}>>").option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
    named = files.withColumn("clip", F.coalesce("clip", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)))
    return named.select("clip", F.posexplode("frames").alias("sample", "f")).select("clip", "sample", "f.*")


def write_answers(answers: DataFrame, path: str) -> None:
    """JSON lines, one per clip, keys in the order of the answer."""
    answers.select("answer").write.mode("overwrite").text(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(clip, phase, t) from either layout: named boundary frames, or a list of onsets."""
    schema = "clip string, fps double, boundaries map<string,long>, onsets array<struct<phase:string,frame:long>>"
    files = spark.read.schema(schema).option("multiLine", "true").json(path)
    named = files.where("boundaries is not null").select("clip", "fps", F.explode("boundaries").alias("phase", "frame"))
    listed = files.where("onsets is not null").select("clip", "fps", F.explode("onsets").alias("o")).select("clip", "fps", "o.phase", "o.frame")
    return named.unionByName(listed).select("clip", "phase", (F.col("frame") / F.col("fps")).alias("t"))


def digest(*columns: str | Column) -> Column:
    """First 16 hex digits of the SHA-256 of the columns as JSON, in the order of their names."""
    names = sorted(c for c in columns if isinstance(c, str))
    return F.left(F.sha2(F.to_json(F.struct(*names)), 256), F.lit(16))


def config_digest(config) -> str:
    """The same for a configuration; the order of its keys plays no part."""
    plain = asdict(config) if is_dataclass(config) else dict(config)
    return hashlib.sha256(json.dumps(plain, sort_keys=True, default=str).encode()).hexdigest()[:16]


def merged(*layers: dict) -> dict:
    """Nested settings; later layers win, key by key."""
    out: dict = {}
    for layer in layers:
        for k, v in layer.items():
            out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def layered(defaults: dict, *layers: dict) -> dict:
    """Settings from the defaults up: a file, then what is given by hand. A key the defaults don't know is an error, wherever it stands."""

    def check(known: dict, given: dict, where: str) -> None:
        for k, v in given.items():
            if k not in known:
                raise ValueError(f"unknown setting {where}{k}")
            if isinstance(known[k], dict):
                if not isinstance(v, dict):
                    raise ValueError(f"setting {where}{k} is a group")
                check(known[k], v, f"{where}{k}.")

    for layer in layers:
        check(defaults, layer, "")
    return merged(defaults, *layers)


SCENE = "pivot array<double>, scale double, truck_box array<double>"


def with_scene(rows: DataFrame, scenes: DataFrame, key: str = "clip") -> DataFrame:
    """rows with pivot_x, pivot_y, scale and truck_box of their clip; NULL where the clip has no scene or the JSON is none.

    scenes: key, scene (JSON text)."""
    parsed = scenes.select(key, F.from_json("scene", SCENE).alias("_s"))
    found = rows.join(parsed, key, "left")
    return found.select(*rows.columns, F.get("_s.pivot", F.lit(0)).alias("pivot_x"), F.get("_s.pivot", F.lit(1)).alias("pivot_y"), F.col("_s.scale").alias("scale"), F.col("_s.truck_box").alias("truck_box"))


def unknown_names(given: DataFrame, known: list[str], column: str = "key") -> DataFrame:
    """The distinct names that are not among those known; a NULL is no name."""
    return given.select(column).where(F.col(column).isNotNull() & ~F.col(column).isin(*known)).distinct()


def shared_names(tables: list[DataFrame], column: str = "feature") -> DataFrame:
    """The names that all tables have."""
    out = tables[0].select(column)
    for other in tables[1:]:
        out = out.intersect(other.select(column))
    return out.distinct()


def read_expected(spark: SparkSession, path: str) -> DataFrame:
    """(clip, field, value, error) of label files, and their tolerance as the field `tolerance_seconds`.

    A file that is no JSON object, lacks the expected answer or the tolerance, or has something
    else than a number in a field says so in `error`."""
    from cadence.operators.cycles import PHASES, typed_number

    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("value").alias("raw"))
    doc = F.try_parse_json("raw")
    kind = F.schema_of_variant(doc)
    named = F.coalesce(F.try_variant_get(doc, "$.clip", "string"), F.col("file")).alias("clip")
    paths = {"cycle_count": "$.expected_answer.cycle_count", "average_cycle_duration_seconds": "$.expected_answer.average_cycle_duration_seconds"}
    paths |= {f"average_phase_duration_seconds.{p}": f"$.expected_answer.average_phase_duration_seconds.{p}" for p in PHASES}
    paths["tolerance_seconds"] = "$.scoring.tolerance_seconds"
    whole = F.when(doc.isNull(), "not JSON").when(~kind.startswith("OBJECT"), "not an object")
    fields = []
    for name, path_ in paths.items():
        value, error = typed_number(F.col("raw"), path_)
        fields.append(F.struct(F.lit(name).alias("field"), F.when(whole.isNull(), value).alias("value"), F.coalesce(whole, error).alias("error")))
    return files.select(named, F.explode(F.array(*fields)).alias("f")).select("clip", "f.*")


def write_tracks(frames: DataFrame, path: str) -> None:
    """One JSON object per clip, its frames in order of sample; `read_tracks` reads them back. frames: clip, sample and FRAME's fields."""
    names = [c.split()[0] for c in FRAME.split(", ")]
    ordered = F.array_sort(F.collect_list(F.struct("sample", *names)))
    rows = frames.groupBy("clip").agg(F.transform(ordered, lambda f: F.struct(*(f[c].alias(c) for c in names))).alias("frames"))
    # a file a clip: a reader of whole objects takes one each
    rows.withColumn("_clip", F.col("clip")).repartition("_clip").write.mode("overwrite").option("maxRecordsPerFile", 1).partitionBy("_clip").json(path)


DETECTION = "array<struct<x0:float,y0:float,x1:float,y1:float,score:float,label:string>>"


def detect(images: DataFrame, build: Callable[[], Callable[[bytes, str], list[dict]]], prompts: list[str]) -> DataFrame:
    """Adds `detections` (of the first prompt that finds any) to rows with a binary `image`.

    `build` makes the detector once per worker; any callable (image, prompt) -> boxes will do."""

    @F.pandas_udf(DETECTION)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = build()
        for batch in batches:
            yield pd.Series([next((found for p in prompts if (found := model(image, normal_prompt(p)))), []) for image in batch])

    return images.withColumn("detections", run("image"))


def normal_prompt(prompt: str) -> str:
    """Lower case, trimmed, with a closing full stop."""
    text = prompt.lower().strip()
    return text if text.endswith(".") else f"{text}."


def prompt_of(prompt: Column) -> Column:
    """`normal_prompt` of a column."""
    text = F.lower(F.trim(prompt))
    return F.when(text.endswith("."), text).otherwise(F.concat(text, F.lit(".")))


def answer_problems(answers: DataFrame) -> DataFrame:
    """Answers that break the rules: counts are whole and not negative, durations finite, and above 0 if anything was counted."""
    from cadence.operators.cycles import ANSWER, PHASES

    a = answers.withColumn("_a", F.from_json("answer", ANSWER))
    seconds = [F.col("_a.average_cycle_duration_seconds"), *(F.col(f"_a.average_phase_duration_seconds.{p}") for p in PHASES)]
    bad = F.array_compact(
        F.array(
            F.when(F.col("_a").isNull() | F.col("_a.cycle_count").isNull(), "no count"),
            F.when(F.col("_a.cycle_count") < 0, "negative count"),
            *(F.when(s.isNull() | F.isnan(s) | (s < 0) | (s == float("inf")), "bad duration") for s in seconds),
            F.when((F.col("_a.cycle_count") > 0) & ~(seconds[0] > 0), "counted without duration"),
        )
    )
    return a.withColumn("problems", F.array_distinct(bad)).where(F.size("problems") > 0).drop("_a")
