"""Mixing sources to target weights with a low-discrepancy schedule (native DataFrame code).

Slots i = 0, 1, 2, ... get the golden-ratio points u(i) = (i * M mod 2^31) / 2^31. The points
pass through the cumulative weights of the sources, so every stretch of the schedule holds the
sources close to their shares. A slot's rank within its source picks the block it takes: each
source's documents, in a shuffled but fixed order, form one line of words that is cut into
blocks of equal size, and rank r takes block r mod (number of blocks), so a source is read
round after round.

Targets: weights 5, 2, 1 repeating over the sources by code point, null last. A target stops
at `repeats` times the source's size; the excess is shared again by weight. Both are closed
forms over the per-source sums (a water level), no loop.

Scale: no Python, no global sort. Ranks and word positions are two-level prefix sums: sums per
(source, bucket), a window over those few sums, then a window within each bucket, so a source
with a third of all rows is spread over thousands of buckets, more as the input grows. A block
has 32 words, and more in a source of over 2^27 words, so a source has at most `most_blocks`
blocks, the schedule stays below the 2^31 slots after which its points repeat, and no product
passes 2^63. Slots meet their source through an
equi-join on a slice of [0, 1), not a range join. One window runs over the per-source sums in a
single partition; its input is one row per source.

Defined results: null text counts 0 words and is never taken; an empty table gives no rows;
repeated rows each get their own places in the line; documents of equal hash stand in order of
doc_id, then size; extra columns are ignored; a null doc_id keeps its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parts_for, staged, table

GOLDEN = 1327217885  # odd, nearest to 2^31 / golden ratio
MODULUS = 1 << 31
SLICES = 4096


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in the text, 0 for null."""
    plain = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.when(F.trim(plain) == "", F.lit(0)).otherwise(F.size(F.split(F.trim(plain), " +"))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), repeats: int = 3) -> DataFrame:
    """`(source, source_size)` -> the same with `weight` and `target`."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    capped = sizes.withColumn("weight", weight.cast("double")).withColumn("most", F.col("source_size") * F.lit(repeats))
    level = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    out = (
        capped.withColumn("room", F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("water", F.col("room") / F.col("rest"))
        .withColumn("full", F.col("water") * F.col("weight") >= F.col("most"))
        .withColumn("common", F.min(F.when(~F.col("full"), F.struct((F.col("most") / F.col("weight")).alias("o"), F.col("water").alias("w")))).over(whole))
    )
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.col("common.w") * F.col("weight"))
    return out.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), repeats: int = 3, block_words: int = 32, most_blocks: int = 1 << 22, size: Column | None = None, carry: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken.

    `carry` names the documents' columns to return instead, with size and taken."""
    size = word_count(F.col("text")) if size is None else size
    if carry is not None:
        # places are found on narrow rows; a row's number brings its columns back
        wide = staged(docs.select(*carry).withColumn("_row", F.monotonically_increasing_id()), "mixing-rows")
        got = _taken(wide.select("_row", "doc_id", "source", size.alias("size")), weights, repeats, block_words, most_blocks).select("_row", "size", "taken")
        return wide.drop(*(c for c in ("size", "taken") if c in carry)).join(got.where("taken > 0").hint("merge"), "_row").drop("_row")
    rows = docs.select(F.lit(0).alias("_row"), "doc_id", "source", size.alias("size"))
    return _taken(rows, weights, repeats, block_words, most_blocks).drop("_row")


def _taken(rows: DataFrame, weights: tuple[int, ...], repeats: int, block_words: int, most_blocks: int) -> DataFrame:
    spark = rows.sparkSession
    # the leading bits of a hash: their number follows the input and never changes the order
    bits = min(31, max(12, (parts_for(rows, 4) - 1).bit_length()))
    # counted once, then only these narrow rows are read again
    rows = staged(rows.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), "mixing-sizes")
    rows = rows.withColumn("bucket", F.shiftright(F.conv(F.substring("h", 1, 8), 16, 10).cast("long"), 32 - bits))
    cells = rows.groupBy("source", "bucket").agg(F.sum("size").alias("cell_size"))
    per_bucket = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("base", F.coalesce(F.sum("cell_size").over(per_bucket), F.lit(0)))
    targets = source_targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, repeats)

    # blocks: equal parts of a source's line; draws: how many of them the target asks for
    plan = targets.withColumn("n_blocks", F.ceil(F.col("source_size") / F.greatest(F.lit(block_words), F.ceil(F.col("source_size") / F.lit(most_blocks)))).cast("long")).withColumn(
        "draws", F.when(F.col("source_size") > 0, F.col("target") * F.col("n_blocks") / F.greatest(F.col("source_size"), F.lit(1))).otherwise(F.lit(0.0))
    )
    upto = Window.orderBy(F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    plan = (
        plan.withColumn("all_draws", F.sum("draws").over(whole))
        .withColumn("hi", F.sum("draws").over(upto.rowsBetween(Window.unboundedPreceding, 0)) / F.greatest("all_draws", F.lit(1e-300)))
        .withColumn("lo", F.coalesce(F.lag("hi").over(upto), F.lit(0.0)))
        .withColumn("hi", F.when(F.lead("hi").over(upto).isNull(), F.lit(1.0)).otherwise(F.col("hi")))
    )
    plan = staged(plan.select("source", "source_size", "target", "n_blocks", "draws", "lo", "hi"), "mixing-plan")
    # tables that grow with the corpus are merged, never broadcast on a compressed-size guess
    taken_blocks = _drawn(spark, plan, repeats)

    in_cell = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    # join keys are null-safe through a flag: the null source is a source of its own
    key = [F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source_key")]
    line = rows.withColumn("inner", F.coalesce(F.sum("size").over(in_cell), F.lit(0))).withColumn("nth", F.row_number().over(Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size")))
    placed = (
        line.select(*key, "source", "bucket", "nth", "_row", "doc_id", "size", "inner")
        .join(cells.select(*key, "bucket", "base").hint("merge"), ["no_source", "source_key", "bucket"])
        .join(plan.select(*key, "source_size", "target", "n_blocks"), ["no_source", "source_key"])
        .withColumn("a", F.col("base") + F.col("inner"))
        .withColumn("b", F.col("base") + F.col("inner") + F.col("size"))
    )
    per = F.col("source_size") / F.col("n_blocks")
    spans = placed.where("size > 0").select(
        "no_source", "source_key", "bucket", "nth", "a", "b", "n_blocks", "source_size",
        F.explode(F.sequence(F.greatest(F.floor(F.col("a") / per).cast("long") - 1, F.lit(0)), F.least(F.floor(F.col("b") / per).cast("long") + 1, F.col("n_blocks") - 1))).alias("block"),
    )
    # block j holds words [floor(j*size/n), floor((j+1)*size/n)) of its source
    # (with quotient and remainder: the plain product would pass 2**63)
    cut = lambda j: F.expr(f"({j}) * (source_size div n_blocks) + (({j}) * (source_size % n_blocks)) div n_blocks")
    overlap = F.least("b", cut("block + 1")) - F.greatest("a", cut("block"))
    spans = spans.withColumn("overlap", overlap).where("overlap > 0")
    taken = (
        spans.join(taken_blocks.hint("merge"), ["no_source", "source_key", "block"])
        .groupBy("no_source", "source_key", "bucket", "nth")
        .agg(F.sum(F.col("overlap") * F.col("times")).alias("taken"))
    )
    return placed.join(taken.hint("merge"), ["no_source", "source_key", "bucket", "nth"], "left").select("_row", "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _drawn(spark: SparkSession, plan: DataFrame, repeats: int, stretch: int = 8192) -> DataFrame:
    """The schedule: (source, block) -> how often its slots take it."""
    total = plan.agg(F.coalesce(F.round(F.sum("draws")), F.lit(0)).cast("long").alias("n"))
    n_slots = F.col("n")
    # stretches of the schedule, then their slots: the count is data, so nothing is collected
    slots = total.select(F.explode(F.sequence(F.lit(0).cast("long"), F.greatest((n_slots - 1).cast("long"), F.lit(0)), F.lit(stretch).cast("long"))).alias("from"), "n").repartition(max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))), "from")
    slots = slots.where("n > 0").select(F.explode(F.sequence(F.col("from"), F.least(F.col("from") + stretch, F.col("n")) - 1)).alias("i"))
    point = F.pmod(F.pmod("i", F.lit(MODULUS)) * F.lit(GOLDEN), F.lit(MODULUS)) / F.lit(float(MODULUS))
    slots = slots.select("i", point.alias("u")).withColumn("slice", F.floor(F.col("u") * SLICES).cast("long"))
    ranges = plan.where("hi > lo and n_blocks > 0").select(
        F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source_key"), "n_blocks", "lo", "hi",
        F.explode(F.sequence(F.floor(F.col("lo") * SLICES).cast("long"), F.least(F.floor(F.col("hi") * SLICES), F.lit(SLICES - 1)).cast("long"))).alias("slice"),
    )
    met = slots.join(ranges, "slice").where("u >= lo and u < hi").withColumn("stretch", F.expr(f"i div {stretch}"))
    parts = met.groupBy("no_source", "source_key", "stretch").agg(F.count("*").alias("m"))
    along = Window.partitionBy("no_source", "source_key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("no_source", "source_key", "stretch", F.coalesce(F.sum("m").over(along), F.lit(0)).alias("before"))
    ranked = met.join(parts.hint("merge"), ["no_source", "source_key", "stretch"]).withColumn(
        "rank", F.col("before") + F.row_number().over(Window.partitionBy("no_source", "source_key", "stretch").orderBy("i")) - 1
    )
    # a source at its cap is never read more than `repeats` times
    return ranked.where(F.col("rank") < F.col("n_blocks") * repeats).groupBy("no_source", "source_key", F.expr("rank % n_blocks").alias("block")).agg(F.count("*").alias("times"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
