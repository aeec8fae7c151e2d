"""Quality rules with host-level verdicts.

Each document is measured once. A host's failures (the base rules, or the stricter house
rules) are summed per host, and its failure rate is shrunk towards the corpus with a beta
prior fitted to all hosts by the method of moments: (failures + a) / (documents + a + b).
A host whose shrunk rate passes `host_limit` is not trusted: the house rules, which are
reports elsewhere, then decide for its documents. So a host's verdict reaches every one of its
documents, while a clean document is kept wherever it stands.

Scale: one map-only pass over the texts, written as a narrow table; per-host sums combine on
the map side; the verdicts join back by host (Spark splits a hot host at run time), and nothing
is collected. Repeats are found by 64-bit window hashes within one document.

Defined results: `source` stands for the host, as documents have no address; null text has no
words and fails; a null source is one host of its own; a null doc_id keeps its row; very long
texts are measured whole; repeated rows are judged alike; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import spans
from .common import slices, staged, table, texts_of, tidy

# fixed values: the symbols that count
SYMBOLS = b"#*$%&|<>"
WINDOW = 8

_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(SYMBOLS)] = 1
_INSIDE = ((np.arange(256) & 0xC0) != 0x80) & ~spans._SPACE


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    j = spans.join(texts)
    w = spans.words(j)
    upto = lambda lut: np.concatenate([[0], np.cumsum(lut[j.data], dtype=np.int64)])
    chars, symbols = upto(_INSIDE), upto(_SYMBOL)
    dup_lines = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        if b"\n" in text:
            lines = [x for x in text.split(b"\n") if x and not x.isspace()]
            dup_lines[k] = len(lines) - len(set(lines))
    return {
        "n_words": np.diff(w.first).astype(np.int64),
        "word_chars": chars[j.end] - chars[j.start],
        "n_symbols": symbols[j.end] - symbols[j.start],
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeat_words(w, len(texts)),
    }


def repeat_words(w: spans.Words, n_texts: int) -> np.ndarray:
    """Words of each text inside a window of WINDOW words that stands there twice or more."""
    n = len(w.hash) - WINDOW + 1
    if n <= 0:
        return np.zeros(n_texts, np.int64)
    ok = w.doc[:n] == w.doc[WINDOW - 1 :]
    at = np.flatnonzero(ok)
    key = spans.grams(w.hash, WINDOW)[at] ^ spans.mix(w.doc[at].astype(np.uint64))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(w.hash) + 1, np.int64)
    edge[at[twice]] += 1
    edge[at[twice] + WINDOW] -= 1
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(w.doc[covered], minlength=n_texts).astype(np.int64)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


SALTS = 32


def measured(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """doc_id, source (or the columns of `carry`) and the five measures of every document."""
    names = list(dict.fromkeys(["doc_id", "source", *(carry or [])]))
    names = [n for n in names if n not in MEASURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                got = measure(texts_of(part))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *(pa.array(got[m]) for m in MEASURES)], [*names, *MEASURES])

    both = StructType([*(docs.schema[n] for n in names), *(StructField(m, LongType()) for m in MEASURES)])
    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(tidy(run), both)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def house_failed(max_symbol_share: float = 0.2, max_dup_lines_per_word: float = 0.1, max_repeat_share: float = 0.2, mean_word: tuple[float, float] = (2.0, 20.0)) -> Column:
    """The stricter rules that only decide on hosts that are not trusted."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    length = F.col("word_chars") / n
    return (
        (F.col("n_symbols") > n * max_symbol_share)
        | (F.col("n_dup_lines") > n * max_dup_lines_per_word)
        | (F.col("n_repeat_words") > n * max_repeat_share)
        | (length < mean_word[0])
        | (length > mean_word[1])
    )


def host_verdicts(judged: DataFrame, host_limit: float = 0.5) -> DataFrame:
    """Per host: n, failures, shrunk rate and `trusted`, with a beta prior fitted to all hosts."""
    hosts = judged.groupBy("no_host", "host").agg(F.count("*").alias("n"), F.sum((F.col("base_failed") | F.col("house_failed")).cast("long")).alias("failures"))
    rate = F.col("failures") / F.col("n")
    # moments of the rates over hosts; the binomial share of the variance is taken off
    seen = hosts.agg(F.avg(rate).alias("m"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("v"), F.avg(1 / F.col("n")).alias("r"))
    spread = F.greatest(F.col("v") - F.col("m") * (1 - F.col("m")) * F.col("r"), F.lit(1e-6))
    strength = F.greatest(F.least(F.col("m") * (1 - F.col("m")) / spread - 1, F.lit(1e6)), F.lit(2.0))
    prior = seen.select(F.lit(1).alias("one"), (F.col("m") * strength).alias("a"), ((1 - F.col("m")) * strength).alias("b"))
    shrunk = (F.col("failures") + F.col("a")) / (F.col("n") + F.col("a") + F.col("b"))
    # the prior is exactly one row
    return hosts.withColumn("one", F.lit(1)).join(F.broadcast(prior), "one").select("no_host", "host", "n", "failures", shrunk.alias("host_rate"), (shrunk <= host_limit).alias("trusted"))


def judge(docs: DataFrame, host_limit: float = 0.5, carry: list[str] | None = None, broadcast_hosts: int = 200_000) -> DataFrame:
    """Every document with its measures, its host's shrunk failure rate and `kept`.

    `carry` names further columns of the documents to return (see `common.carried`, which keeps
    clashing names apart). Verdicts of up to `broadcast_hosts` hosts, by count, are broadcast."""
    host = [F.col("source").isNull().alias("no_host"), F.coalesce("source", F.lit("")).alias("host")]

    def judged(kept_columns: list[str] | None) -> DataFrame:
        rows = measured(docs, kept_columns).withColumn("base_failed", base_failed()).withColumn("house_failed", house_failed())
        return rows.select("*", *host)

    rows = staged(judged(None), "quality")
    hosts = staged(host_verdicts(rows, host_limit).select("no_host", "host", "host_rate", "trusted"), "hosts")
    if carry is not None:  # texts are measured again rather than stored
        rows = judged(carry)
    kept = ~F.col("base_failed") & (F.col("trusted") | ~F.col("house_failed"))
    if hosts.count() <= broadcast_hosts:
        out = rows.join(F.broadcast(hosts), ["no_host", "host"])
    else:  # a host's documents are spread over `SALTS` keys
        salted = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["no_host", "host", "salt"]).drop("salt")
    return out.select(*(c for c in rows.columns if c not in ("no_host", "host")), "host_rate", kept.alias("kept"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", *MEASURES, "base_failed", "kept")
