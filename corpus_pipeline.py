"""The corpus pipeline: quality rules, near-duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each result as
Parquet in the shared folder and reads it again as the next stage's documents. All stages but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadence.llm import mixing, neardup, packing, passages, quality
from cadence.llm.common import carried, kept_path, restored, table

#: Mixing and packing are not expressible in SQL together (tokenizers); see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and their host's verdict keep.

    Null and empty texts fail; a null source is one host; repeated rows are judged alike; rows
    without doc_id are judged like others; no rows give none."""
    own = ("doc_id", "text", "source")
    judged = quality.judge(carried(docs, *own), carry=["text", "carried"])
    return restored(judged.where("kept"), docs.columns, *own)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the smallest doc_id.

    Of rows that repeat a doc_id with the very same text one stays, the least by its other
    columns; rows that share a doc_id with unlike texts all stay, as do rows without doc_id."""
    found = neardup.classes(docs).where("not kept").select("doc_id", "digest").distinct()
    wide = carried(docs, "doc_id", "text")
    known = wide.where("doc_id is not null").withColumn("digest", neardup.text_digest())
    rest = known.join(found.hint("shuffle_hash"), ["doc_id", "digest"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("doc_id", "digest").orderBy(F.to_json("carried")))
    one = rest.withColumn("nth", nth).where("nth = 1").select(*wide.columns)
    return restored(one.union(wide.where("doc_id is null")), docs.columns, "doc_id", "text")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a smaller doc_id holds; texts left empty go.

    Untouched documents keep their text as it is."""
    cut = passages.remove_passages(carried(docs, "doc_id", "text"))
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    left = cut.where(~changed | (F.col("kept_text") != ""))
    left = left.withColumn("text", text).withColumn("n_new", F.when(changed, F.length("kept_text").cast("long")))
    columns = []
    for c in docs.columns:
        was = F.col(c) if c in ("doc_id", "text") else F.col("carried").getField(c)
        columns.append((F.coalesce("n_new", was.cast("long")) if c == "n_chars" else was).alias(c))
    return left.select(*columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix reads them: whole rounds, and the rest of `taken` by a draw.

    Texts without words are never taken, so null and empty ones go; repeated rows are read each by
    its own place; rows without doc_id share one draw; no rows give none.

    A document whose words are taken k times and a part more stands k times, and once more with
    the chance of that part, drawn from its doc_id, so each source's words keep near its target.
    """
    own = ("doc_id", "text", "source")
    taken = mixing.mix(carried(docs, *own), carry=[*own, "carried"])
    share = F.col("taken") / F.greatest(F.col("size"), F.lit(1))
    whole = F.floor(share).cast("int")
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("draw "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    times = whole + F.when(share - whole > draw, F.lit(1)).otherwise(F.lit(0))
    read = taken.withColumn("_times", times).where("_times > 0").withColumn("_turn", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return restored(read, docs.columns, *own)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens; a text that the mix repeats is packed as often.

    Null and empty texts are one end id; very long ones fill windows of their own; no rows give none."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources to target weights", mixed_sources),
    ("packing", packed_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        out = kept_path(spark, "stage")
        made = stage(spark, docs, sf_dir)
        made.write.parquet(out)
        docs = spark.read.schema(made.schema).parquet(out)
    return docs
