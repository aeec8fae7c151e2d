"""Routing the answer of a tracker of several objects: a mask and a confidence for each object."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, MapType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from cadence.operators.masks import grown_components


class SplitObjects:
    """A table function: one answer (clip, sample, objects, row, ys, xs, logit) for each row of a tracker's output.

    `objects` lists the ids in the order of the rows, so row k belongs to objects[k] and never to
    the object numbered k. Each object has its own cut: components with less than that share of
    the mask go, unless all would. The confidence is the presence logit as a probability, NULL
    where it was not told. The frame is the partition, so it is shuffled once."""

    @staticmethod
    def analyze(answers: AnalyzeArgument, cuts: AnalyzeArgument) -> AnalyzeResult:
        if not answers.isTable or not isinstance(answers.dataType, StructType):
            raise ValueError("the first argument must be a table")
        lacking = {"clip", "sample", "objects", "row", "ys", "xs", "logit"} - set(answers.dataType.names)
        if lacking:
            raise ValueError(f"the table lacks {', '.join(sorted(lacking))}")
        if not isinstance(cuts.dataType, MapType):
            raise ValueError("the second argument must map object ids to shares")
        schema = StructType()
        for name in ("clip", "sample"):
            schema = schema.add(name, answers.dataType[name].dataType)
        schema = schema.add("object", IntegerType()).add("ys", ArrayType(LongType())).add("xs", ArrayType(LongType())).add("confidence", DoubleType())
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("clip"), PartitioningColumn("sample")], orderBy=[OrderingColumn("row")])

    def eval(self, answer, cuts) -> Iterator[tuple]:
        number = answer["objects"][answer["row"]]
        ys, xs = np.array(answer["ys"] or [], np.int64), np.array(answer["xs"] or [], np.int64)
        keep = kept(ys, xs, (cuts or {}).get(number, 0.0))
        logit = answer["logit"]
        confidence = None if logit is None or logit != logit else 1 / (1 + float(np.exp(-logit)))
        yield answer["clip"], answer["sample"], number, ys[keep].tolist(), xs[keep].tolist(), confidence


def kept(ys: np.ndarray, xs: np.ndarray, least: float) -> np.ndarray:
    """Which pixels stay when components below `least` of the mask go; all, if none would."""
    if least <= 0 or not len(ys):
        return np.ones(len(ys), bool)
    at = grown_components(ys, xs)
    stay = (np.bincount(at) / len(at))[at] >= least
    return stay if stay.any() else np.ones(len(ys), bool)


def register(spark: SparkSession) -> None:
    """`SELECT * FROM split_objects(TABLE(answers), map(1, 0.05D, 2, 0.01D))`"""
    spark.udtf.register("split_objects", F.udtf(SplitObjects))


def split_objects(answers: DataFrame, cuts: dict[int, float]) -> DataFrame:
    """(clip, sample, object, y, x, confidence): the pixels of each object."""
    shares = F.create_map(*(F.lit(x) for pair in (cuts or {0: 0.0}).items() for x in pair))
    split = F.udtf(SplitObjects)(answers.asTable(), shares)
    return split.select("clip", "sample", "object", F.explode(F.arrays_zip("ys", "xs")).alias("p"), "confidence").select("clip", "sample", "object", F.col("p.ys").alias("y"), F.col("p.xs").alias("x"), "confidence")
