"""Audit of how far the sources of a language differ in their words, by DuckDB over shards.

Terms are counted per (lang, source) while the texts stream by. The counts are hashed into shards
by lang and term, so that all counts of a term stand in one shard. Each shard is a small DuckDB
job in two passes. The first sums the counts and keeps the terms that enough documents of the
lang have; Spark sums the sizes of the groups from it. The second gives the shard's part of every
sum over pairs of sources, and its best terms of each group; Spark adds and ranks them.

A pair's value is a sum over all kept terms, but most terms are missing from most sources, where
p is the source's least p, `z`. So a shard adds up, with f as below,

    f(z, z')                                             for every kept term and pair,
    f(p, z') - f(z, z')                                  for every count above 0, by equal p,
    f(p, p') - f(p, z') - f(z, p') + f(z, z')            where both have the term,

which is the full sum in whole numbers, and costs what the counts above 0 cost.

Scale: texts are folded in the task that reads them, so a hot source, lang or term sends one entry
a term, source and fold. A fold's entries travel as one compressed block for each shard, so Spark
moves few rows; the number of shards follows the size of the input. In the second pass a term has
at most one row a source, and terms and sources are numbers. Nothing is collected; DuckDB runs in
memory within a shard, on one thread, and writes no files.

Defined results: null text, lang and source read as ''; a text without terms (empty, null) still
makes its group occur; repeated rows count as documents of their own, whatever their doc_id; very
long texts are read in slices cut between terms; equal values rank by the item's UTF-8 bytes; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, size_in_bytes, slices, staged, table, tidy

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
GAP = re.compile(r"[\x00-\x40\x5B-\x60\x7B-\x7F]")
ALL = 1_000_000_000  # p's scale

_BLOCKS = "lang string, bucket long, sources array<string>, entries int, block binary"
_KEPT = "lang string, bucket long, source string, term string, n long, once long"
_PARTS = "lang string, source string, part string, item string, value long"


def stretches(text: str, gap: re.Pattern, limit: int = 1 << 20) -> Iterator[str]:
    """A long text in slices of about `limit` characters, cut where `gap` matches."""
    at = 0
    while len(text) - at > limit:
        cut = gap.search(text, at + limit)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def packed(terms: np.ndarray, sources: np.ndarray, n: np.ndarray, docs: np.ndarray) -> bytes:
    """A block of entries: terms hold no line breaks."""
    numbers = b"".join(x.astype("<u8").tobytes() for x in (sources, n, docs))
    return zstandard.ZstdCompressor(level=1).compress(numbers + "\n".join(terms).encode())


def unpacked(block: bytes, entries: int, sources: list[str]) -> list[pa.Array]:
    """(source, term, n, docs) of a block."""
    plain = zstandard.ZstdDecompressor().decompress(block)
    source, n, docs = np.frombuffer(plain, "<u8", 3 * entries).reshape(3, entries).astype(np.int64)
    text = np.frombuffer(plain, np.uint8, offset=24 * entries)
    breaks = np.flatnonzero(text == 10)
    # the breaks stay in the buffer as the last byte of each term but one, so they are cut out first
    ends = np.append(breaks - np.arange(len(breaks)), len(text) - len(breaks)).astype(np.int32)
    term = pa.StringArray.from_buffers(entries, pa.py_buffer(np.append(np.int32(0), ends).astype(np.int32).tobytes()), pa.py_buffer(text[text != 10].tobytes()))
    return [pa.array(sources, pa.string()).take(pa.array(source)), term, pa.array(n), pa.array(docs)]


def term_counts(docs: DataFrame, shards: int, most: int = 500_000) -> DataFrame:
    """(lang, bucket, sources, entries, block): counts of the texts folded so far, whenever `most` terms are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[str, tuple[Counter, Counter]]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, by_source in held.items():
                names = list(by_source)
                terms = np.array([t for n, _ in by_source.values() for t in n], object)
                source = np.repeat(np.arange(len(names)), [len(n) for n, _ in by_source.values()])
                n = np.array([x for n, _ in by_source.values() for x in n.values()], np.int64)
                having = np.array([h[t] for n, h in by_source.values() for t in n], np.int64)
                bucket = (pd.util.hash_array(terms, categorize=False) % np.uint64(shards)).astype(np.int64) if len(terms) else np.zeros(0, np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1])) if len(order) else []
                for pick in np.split(order, cuts[1:]) if len(order) else []:
                    own, at = np.unique(source[pick], return_inverse=True)
                    block = packed(terms[pick], at, n[pick], having[pick])
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([int(bucket[pick[0]])], pa.int64()), pa.array([[names[k] for k in own]], pa.list_(pa.string())), pa.array([len(pick)], pa.int32()), pa.array([block], pa.binary())], ["lang", "bucket", "sources", "entries", "block"])
            held.clear()

        for whole in batches:
            for batch in slices(whole, "text"):
                for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                    if not text:
                        continue
                    n, having = held.setdefault(lang, {}).setdefault(source, (Counter(), Counter()))
                    seen: set[str] = set()
                    for piece in stretches(text.encode().lower().decode(), GAP):  # bytes lower A-Z only
                        terms = TERM.findall(piece)
                        n.update(terms)
                        seen.update(terms)
                    having.update(seen)
                if sum(len(n) for by_source in held.values() for n, _ in by_source.values()) > most:
                    yield from out()
        yield from out()

    blank = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*blank).mapInArrow(tidy(run), _BLOCKS)


def _duck(**tables: pa.Table) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect(config={"threads": 1, "memory_limit": "700MB", "temp_directory": ""})
    for name, rows in tables.items():
        con.register(name, rows)
    con.execute("CREATE MACRO f(p, q) AS ((p - q) * (p - q)) // (p + q)")
    con.execute(f"CREATE MACRO share(n, total, v) AS CAST(1 + (CAST({ALL} AS HUGEINT) * (n + 2)) // (total + 2 * v) AS BIGINT)")
    return con


def _arrow(con: duckdb.DuckDBPyConnection, sql: str, schema: list[tuple[str, pa.DataType]]) -> pa.Table:
    out = con.sql(sql).to_arrow_table().cast(pa.schema(schema))
    con.close()
    return out


def _fields(ddl: str) -> list[tuple[str, pa.DataType]]:
    kinds = {"string": pa.string(), "long": pa.int64()}
    return [(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))]


def kept_counts(blocks: DataFrame, least_docs: int) -> DataFrame:
    """(lang, bucket, source, term, n, once): counts of the terms that enough documents have; once marks a term's first row."""
    sql = f"""WITH k AS (SELECT term FROM rows GROUP BY term HAVING sum(docs) >= {least_docs}),
c AS (SELECT source, term, sum(n) AS n FROM rows SEMI JOIN k USING (term) GROUP BY ALL)
SELECT lang, bucket, source, term, n, CASE WHEN row_number() OVER (PARTITION BY term ORDER BY source) = 1 THEN 1 ELSE 0 END AS once FROM c, shard"""

    def run(blocks: pa.Table) -> pa.Table:
        parts = [pa.RecordBatch.from_arrays(unpacked(*x), ["source", "term", "n", "docs"]) for x in zip(*(blocks.column(c).to_pylist() for c in ("block", "entries", "sources")), strict=True)]
        return _arrow(_duck(rows=pa.Table.from_batches(parts), shard=blocks.select(["lang", "bucket"]).slice(0, 1)), sql, _fields(_KEPT))

    return blocks.groupBy("lang", "bucket").applyInArrow(tidy(run), _KEPT)


def shard_parts(kept: DataFrame, groups: DataFrame, shards: int, top: int) -> DataFrame:
    """Each shard's part of the sums of pairs (the smaller source first) and its best terms of each group."""
    setup = (
        "CREATE TEMP TABLE g AS SELECT source, CAST(row_number() OVER (ORDER BY source) AS INTEGER) AS s, total, v, share(0, total, v) AS z FROM sizes",
        "CREATE TEMP TABLE w AS SELECT term, CAST(row_number() OVER () AS INTEGER) AS id, share(sum(n), any_value(l.total), any_value(l.v)) AS q FROM rows, (SELECT any_value(lang_total) AS total, any_value(v) AS v FROM sizes) l GROUP BY term",
        "CREATE TEMP TABLE c AS SELECT s, id, share(n, total, v) AS p, z FROM rows JOIN g USING (source) JOIN w USING (term)",
    )
    sql = f"""WITH l AS (SELECT any_value(lang) AS lang FROM sizes),
best AS (SELECT g.source, w.term AS item, f(p, q) AS value FROM c JOIN w USING (id) JOIN g USING (s) WHERE p > q QUALIFY row_number() OVER (PARTITION BY s ORDER BY f(p, q) DESC, term) <= {top}),
same AS (SELECT a.s, b.s AS t, sum(f(a.p, b.p) - f(a.p, b.z) - f(a.z, b.p) + f(a.z, b.z)) AS x FROM c a JOIN c b ON a.id = b.id AND a.s < b.s GROUP BY 1, 2),
h AS (SELECT s, p, z, count(*) AS k FROM c GROUP BY ALL),
one AS (SELECT least(h.s, g.s) AS s, greatest(h.s, g.s) AS t, sum(k * (f(h.p, g.z) - f(h.z, g.z))) AS x FROM h JOIN g ON h.s <> g.s GROUP BY 1, 2),
base AS (SELECT a.s, b.s AS t, (SELECT count(*) FROM w) * f(a.z, b.z) AS x FROM g a JOIN g b ON a.s < b.s),
pairs AS (SELECT s, t, sum(x) AS x FROM (FROM same UNION ALL FROM one UNION ALL FROM base) GROUP BY 1, 2)
SELECT lang, source, 'term' AS part, item, CAST(value AS BIGINT) AS value FROM best, l UNION ALL SELECT lang, a.source, 'pair', b.source, CAST(x AS BIGINT) FROM pairs, l, g a, g b WHERE a.s = pairs.s AND b.s = pairs.t"""

    def run(rows: pa.Table, sizes: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.schema(_fields(_PARTS)).empty_table()
        con = _duck(rows=rows, sizes=sizes)
        for x in setup:
            con.execute(x)
        return _arrow(con, sql, _fields(_PARTS))

    everywhere = groups.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    return kept.groupBy("lang", "bucket").cogroup(everywhere.groupBy("lang", "bucket")).applyInArrow(tidy(run), _PARTS)


def source_divergence(docs: DataFrame, least_docs: int = 10, top: int = 10, shard_mb: float = 4, most: int = 500_000) -> DataFrame:
    """lang, source, part, item, value, rank: see the module."""
    # by the input's size alone: every shard tells a sum for each pair of sources
    size = size_in_bytes(docs)
    shards = math.ceil(size / (shard_mb * 1e6)) if 0 < size < 1 << 50 else shuffle_partitions(docs.sparkSession)
    kept = staged(kept_counts(term_counts(docs, shards, most), least_docs), "kept-terms")
    occurring = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("once").alias("v"))
    groups = staged(
        occurring.join(sums.hint("merge"), ["lang", "source"], "left")
        .join(langs.hint("merge"), "lang", "left")
        .select("lang", "source", *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("total", "lang_total", "v"))),
        "term-groups",
    )
    parts = staged(shard_parts(kept, groups, shards, top), "divergence-parts")
    sums = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = sums.union(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    others = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")).hint("merge"), "lang").where("source <> item")
    pairs = others.join(both.hint("merge"), ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).union(ranked(parts.where("part = 'term'")).where(F.col("rank") <= top))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))
