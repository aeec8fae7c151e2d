"""From phase starts to cycles, averages and scores; all relational."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: the phases in order, and how many a cycle needs
PHASES = ("digging", "hauling", "dumping", "swinging")
MIN_PHASES = 3


def assemble(starts: DataFrame, key: str = "clip") -> DataFrame:
    """(clip, phase, time) -> complete cycles: start, end_time, duration and one duration per phase.

    A cycle runs from one start of the first phase to the next one. It counts if at least three
    phases were found, each once and in order. A phase lasts to the next phase if that was
    found too; the last phase lasts to the cycle's end. One shuffle by clip."""
    w = Window.partitionBy(key).orderBy("time", "phase")
    rank = F.array_position(F.array(*map(F.lit, PHASES)), F.col("phase"))
    rows = starts.where(F.col("phase").isin(*PHASES)).withColumn("_p", rank)
    rows = rows.withColumn("_c", F.sum((F.col("_p") == 1).cast("int")).over(w)).where("_c > 0")
    per = rows.groupBy(key, "_c").agg(
        F.min("time").alias("start"),
        F.transform(F.array_sort(F.collect_list(F.struct("time", "phase", "_p"))), lambda x: x["_p"]).alias("_list"),
        *(F.min(F.when(F.col("_p") == k + 1, F.col("time"))).alias(f"_t{k}") for k in range(len(PHASES))),
    )
    per = per.withColumn("end_time", F.lead("start").over(Window.partitionBy(key).orderBy("_c")))
    good = F.col("end_time").isNotNull() & (F.size("_list") >= MIN_PHASES) & (F.col("_list") == F.array_sort(F.array_distinct("_list")))
    ends = [F.col(f"_t{k + 1}") if k + 1 < len(PHASES) else F.col("end_time") for k in range(len(PHASES))]
    return per.where(good).select(key, "start", "end_time", (F.col("end_time") - F.col("start")).alias("duration"), *((ends[k] - F.col(f"_t{k}")).alias(p) for k, p in enumerate(PHASES)))


def averages(cycles: DataFrame, clips: DataFrame | None = None, key: str = "clip") -> DataFrame:
    """Per clip: number of cycles and mean durations over the cycles that measured them, 3 decimals.

    Clips (given) without a cycle get zeros."""
    mean = lambda c: F.bround(F.coalesce(F.avg(c), F.lit(0.0)), 3)
    out = cycles.groupBy(key).agg(F.count(F.lit(1)).alias("cycle_count"), mean("duration").alias("cycle_seconds"), *(mean(p).alias(f"{p}_seconds") for p in PHASES))
    if clips is None:
        return out
    return clips.select(key).distinct().join(out, key, "left").na.fill(0)


def answer_json(summary: DataFrame, key: str = "clip") -> DataFrame:
    """The answer of each clip as JSON, keys in a fixed order."""
    inner = F.struct(*(F.col(f"{p}_seconds").alias(p) for p in PHASES))
    return summary.select(key, F.to_json(F.struct("cycle_count", F.col("cycle_seconds").alias("average_cycle_duration_seconds"), inner.alias("average_phase_duration_seconds"))).alias("answer"))


ANSWER = "cycle_count long, average_cycle_duration_seconds double, average_phase_duration_seconds struct<" + ",".join(f"{p}:double" for p in PHASES) + ">"


def fields(answers: DataFrame, key: str = "clip", column: str = "answer") -> DataFrame:
    """Answer JSON as rows (clip, field, value); a malformed answer gives NULL values."""
    a = answers.withColumn("_a", F.from_json(column, ANSWER))
    names = ["cycle_count", "average_cycle_duration_seconds", *(f"average_phase_duration_seconds.{p}" for p in PHASES)]
    pairs = F.array(*(F.struct(F.lit(n).alias("field"), F.col(f"_a.{n}").cast("double").alias("value")) for n in names))
    return a.select(key, F.explode(pairs).alias("_f")).select(key, "_f.field", "_f.value")


def typed_fields(answers: DataFrame, key: str = "clip", column: str = "answer") -> DataFrame:
    """Answer JSON as rows (clip, field, value, error); each field says itself what is wrong with it."""
    names = ["cycle_count", "average_cycle_duration_seconds", *(f"average_phase_duration_seconds.{p}" for p in PHASES)]
    pairs = []
    for n in names:
        value, error = typed_number(F.col(column), f"$.{n}")
        pairs.append(F.struct(F.lit(n).alias("field"), value.alias("value"), error.alias("error")))
    return answers.select(key, F.explode(F.array(*pairs)).alias("_f")).select(key, "_f.*")


def score(expected: DataFrame, actual: DataFrame, tolerance: float = 0.6, key: str = "clip") -> DataFrame:
    """Field by field: counts must be equal, durations within the tolerance."""
    both = expected.withColumnRenamed("value", "expected").join(actual.withColumnRenamed("value", "actual"), [key, "field"], "left")
    exact = F.col("field") == "cycle_count"
    off = F.col("actual") - F.col("expected")
    return both.withColumn("error", off).withColumn("passed", F.coalesce(F.when(exact, off == 0).otherwise(F.abs(off) <= tolerance), F.lit(False)))


def typed_number(raw: Column, path: str) -> tuple[Column, Column]:
    """(value, error) of a JSON field: a number and nothing else counts, not even a boolean."""
    doc = F.try_parse_json(raw)
    kind = F.schema_of_variant(F.try_variant_get(doc, path, "variant"))
    number = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    error = F.when(doc.isNull() & raw.isNotNull(), "not JSON").when(kind.isNull(), "missing").when(~number, "not a number")
    return F.when(number, F.try_variant_get(doc, path, "double")), error


def zipped(a: DataFrame, b: DataFrame, key: str = "clip") -> DataFrame:
    """(clip, n, apart, error): the n-th starts side by side; a clip where one side has more is one row with the error."""
    whole = Window.partitionBy(key)
    both = a.select(key, "time", "phase", F.lit(0).alias("_s")).union(b.select(key, "time", "phase", F.lit(1)))
    both = both.withColumn("n", F.row_number().over(Window.partitionBy(key, "_s").orderBy("time", "phase")))
    both = both.withColumn("_l", F.count_if(F.col("_s") == 0).over(whole)).withColumn("_r", F.count_if(F.col("_s") == 1).over(whole))
    apart = F.max(F.when(F.col("_s") == 1, F.col("time"))) - F.max(F.when(F.col("_s") == 0, F.col("time")))
    even = both.where("_l = _r").groupBy(key, "n").agg(apart.alias("apart")).select(key, "n", "apart", F.lit(None).cast("string").alias("error"))
    odd = both.where("_l <> _r").select(key, "_l", "_r").distinct()
    return even.union(odd.select(key, F.lit(None).cast("int"), F.lit(None).cast("double"), F.format_string("%d against %d", "_l", "_r")))


def report_line(tolerance: float, width: int) -> Column:
    """One line of the report: field, expected, actual, signed error, verdict."""
    error = F.col("actual") - F.col("expected")
    return F.format_string(f"%-{width}s %9.3f %9.3f %+8.3f %s", F.col("field"), F.col("expected"), F.col("actual"), error, F.when(F.abs(error) <= tolerance, "PASS").otherwise("FAIL"))


def banner(starts: DataFrame, cycles: DataFrame, instants: DataFrame, slack: float = 1e-6) -> DataFrame:
    """What runs at each instant (clip, t, ...): the phase, and how many cycles are complete.

    Both are running values over the union of instants, starts and cycle ends: no range join."""
    names = [c for c in instants.columns if c not in ("clip", "t")]
    blank = [F.lit(None).cast(instants.schema[c].dataType).alias(c) for c in names]
    rows = instants.select("clip", (F.col("t") + slack).alias("t"), *names, F.lit(2).alias("kind"), F.lit(None).cast("string").alias("phase"))
    rows = rows.union(starts.select("clip", "time", *blank, F.lit(0), "phase")).union(cycles.select("clip", "end_time", *blank, F.lit(1), F.lit(None).cast("string")))
    upto = Window.partitionBy("clip").orderBy("t", "kind", "phase").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    now = F.last(F.when(F.col("kind") == 0, F.col("phase")), True).over(upto)
    any_start = F.max(F.col("kind") == 0).over(Window.partitionBy("clip"))
    idle = F.when(any_start, "LOOKING FOR DIG START").otherwise("NO PHASE FOUND")
    out = rows.withColumn("headline", F.coalesce(F.upper(now), idle)).withColumn("complete", F.count_if(F.col("kind") == 1).over(upto))
    return out.where("kind = 2").select("clip", (F.col("t") - slack).alias("t"), *names, "headline", "complete")


def timers(starts: DataFrame, instants: DataFrame, slack: float = 1e-6) -> DataFrame:
    """What a clock beside the banner shows at each instant (clip, t): the phase, how long it has run, and how long each phase has run in all.

    A phase runs to the next start. All are running values over the union of instants and starts."""
    names = [c for c in instants.columns if c not in ("clip", "t")]
    blank = [F.lit(None).cast(instants.schema[c].dataType).alias(c) for c in names]
    w = Window.partitionBy("clip").orderBy("time", "phase")
    lasting = starts.select("clip", "time", "phase", F.lag("phase").over(w).alias("_before"), (F.col("time") - F.lag("time").over(w)).alias("_took"))
    rows = instants.select("clip", (F.col("t") + slack).alias("t"), *names, F.lit(1).alias("_k"), F.lit(None).cast("string").alias("_p"), F.lit(None).cast("string").alias("_b"), F.lit(None).cast("double").alias("_took"))
    rows = rows.union(lasting.select("clip", "time", *blank, F.lit(0), "phase", "_before", "_took"))
    upto = Window.partitionBy("clip").orderBy("t", "_k", "_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    now = F.last(F.when(F.col("_k") == 0, F.struct(F.col("_p").alias("phase"), F.col("t").alias("since"))), True).over(upto)
    out = rows.withColumn("_now", now)
    for p in PHASES:  # what ended before, and what runs
        ended = F.coalesce(F.sum(F.when((F.col("_k") == 0) & (F.col("_b") == p), F.col("_took"))).over(upto), F.lit(0.0))
        out = out.withColumn(f"{p}_total", ended + F.when(F.col("_now.phase") == p, F.col("t") - slack - F.col("_now.since")).otherwise(0.0))
    out = out.where("_k = 1").withColumn("t", F.col("t") - slack)
    return out.select("clip", "t", *names, F.col("_now.phase").alias("phase"), (F.col("t") - F.col("_now.since")).alias("running_for"), *(f"{p}_total" for p in PHASES))
