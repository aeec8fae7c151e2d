"""Token-id files: one shared zstandard dictionary, each document compressed on its own.

A dictionary is trained on the serialised id arrays of a bounded sample of documents (it only
affects sizes; every document is encoded whole). Each document's ids become one frame, so a
short document is read alone: segment header -> offset index -> frame.

Segment image (little-endian):
  magic 8 bytes `CDNTOK1\\n`; width of an id in bytes u32; n documents u32; dictionary SHA-256, 32 bytes;
  doc_id i64 x n; has_id u8 x n; n_tokens u32 x n; offset u64 x (n + 1); frames.

Images are bounded (`segment_bytes`) and are committed by Spark's writer as rows of a table in
the shared folder, so a lost executor leaves no half-written file, and any store that Spark
reaches will do. Documents are range-partitioned by doc_id: one shuffle of the texts; the
starts are prefix sums over segments, two levels (partitions, then segments inside them).

Defined results: null text is one end id; a null doc_id comes first; repeated rows are separate
documents, ordered by text; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept_path, parts_for, slices, table, tidy
from .tokens import encoder, with_end

MAGIC = b"CDNTOK1\n"
_HEAD = struct.Struct("<8sII32s")
SEGMENT_SCHEMA = "part int, seq int, n_docs long, n_tokens long, low long, high long, image binary"


def train_dictionary(samples: list[bytes], size: int = 65536) -> bytes:
    """A zstandard dictionary for these id arrays; raw content where there are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size] or b"\0" * 8


def _dictionary(raw: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(raw)


class SegmentWriter:
    def __init__(self, dictionary: bytes, width: int, level: int = 3):
        import zstandard

        self.digest, self.width = hashlib.sha256(dictionary).digest(), width
        self.codec = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(dictionary), write_content_size=True)
        self.clear()

    def clear(self) -> None:
        self.ids: list[int | None] = []
        self.tokens: list[int] = []
        self.frames: list[bytes] = []
        self.bytes = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        raw = ids if self.width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()
        self.ids.append(doc_id)
        self.tokens.append(len(ids) // 4)
        self.frames.append(self.codec.compress(raw))
        self.bytes += len(self.frames[-1])

    def image(self) -> bytes:
        n = len(self.ids)
        offset = np.zeros(n + 1, "<u8")
        np.cumsum([len(f) for f in self.frames], out=offset[1:])
        return b"".join(
            [
                _HEAD.pack(MAGIC, self.width, n, self.digest),
                np.array([x or 0 for x in self.ids], "<i8").tobytes(),
                np.array([x is not None for x in self.ids], "u1").tobytes(),
                np.array(self.tokens, "<u4").tobytes(),
                offset.tobytes(),
                *self.frames,
            ]
        )


@dataclass
class Segment:
    """A segment image opened for reading: documents are decompressed one at a time."""

    image: bytes
    dictionary: bytes

    def __post_init__(self):
        import zstandard

        magic, self.width, n, digest = _HEAD.unpack_from(self.image)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        if digest != hashlib.sha256(self.dictionary).digest():
            raise ValueError("the segment was written with another dictionary")
        at = _HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(self.image, kind, count, at)
            at += out.nbytes
            return out

        self.doc_id, self.has_id, self.n_tokens, self.offset = take("<i8", n), take("u1", n), take("<u4", n), take("<u8", n + 1)
        self.base = at
        self.codec = zstandard.ZstdDecompressor(dict_data=_dictionary(self.dictionary))

    def __len__(self) -> int:
        return len(self.doc_id)

    def read(self, k: int) -> np.ndarray:
        """The ids of the k-th document."""
        raw = self.codec.decompress(self.image[self.base + int(self.offset[k]) : self.base + int(self.offset[k + 1])])
        return np.frombuffer(raw, "<u2" if self.width == 2 else "<u4").astype("<u4")


def sample_dictionary(docs: DataFrame, tokenizer: str | None = None, sample: int = 1000, longest: int = 20_000) -> bytes:
    """Trained on at most `sample` documents, least by a hash, of at most `longest` characters each."""
    mark = F.xxhash64("doc_id", "text")
    rows = docs.where(F.length("text").between(1, longest)).select("doc_id", "text")
    total = docs.count()
    if total > 8 * sample:  # each task sends its least rows to the driver: few of them, at any number of tasks
        few = rows.where(mark < F.lit(int((8 * sample / total) * 2**64) - 2**63))
        kept = few.orderBy(mark, "doc_id", "text").limit(sample).collect()
    else:
        kept = []
    rows = kept if len(kept) == sample else rows.orderBy(mark, "doc_id", "text").limit(sample).collect()
    enc = encoder(tokenizer)
    return train_dictionary([np.frombuffer(with_end(x), "<u4").astype("<u2" if len(enc.size) <= 65536 else "<u4").tobytes() for x in enc.encode([r.text for r in rows])])


def write_tokens(docs: DataFrame, dictionary: bytes, tokenizer: str | None = None, segment_bytes: int = 4_000_000) -> DataFrame:
    """Tokenise, compress and cut all documents, in ascending doc_id order, into segment rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(tokenizer)
        out = SegmentWriter(dictionary, 2 if len(enc.size) <= 65536 else 4)
        part, seq = TaskContext.get().partitionId(), 0

        def flush() -> pa.RecordBatch:
            nonlocal seq
            known = [x for x in out.ids if x is not None] or [None]
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(out.ids)], pa.int64()), pa.array([sum(out.tokens)], pa.int64()), pa.array([known[0]], pa.int64()), pa.array([known[-1]], pa.int64()), pa.array([out.image()], pa.binary())],
                ["part", "seq", "n_docs", "n_tokens", "low", "high", "image"],
            )
            seq += 1
            out.clear()
            return row

        for batch in batches:
            for piece in slices(batch, "text", 1_000_000):
                ids = enc.encode([t or "" for t in piece.column("text").to_pylist()])
                for doc_id, raw in zip(piece.column("doc_id").to_pylist(), ids, strict=True):
                    out.add(doc_id, with_end(raw))
                    if out.bytes >= segment_bytes:
                        yield flush()
        if out.ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange(parts_for(docs, 12), "doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(tidy(run), SEGMENT_SCHEMA)


def read_tokens(segments: DataFrame, dictionary: bytes) -> DataFrame:
    """One row per stored document: doc_id, start, n_tokens and the checksum of its ids."""
    by_part = segments.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = by_part.select("part", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("part_base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    bases = segments.select("part", "seq", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("seg_base")).join(by_part, "part").select("part", "seq", (F.col("part_base") + F.col("seg_base")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, image in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "image")), strict=True):
                seg = Segment(image, dictionary)
                n = len(seg)
                crc = [zlib.crc32(seg.read(k).tobytes()) for k in range(n)]
                start = np.concatenate([[0], np.cumsum(seg.n_tokens, dtype=np.int64)[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(seg.doc_id, pa.int64(), mask=seg.has_id == 0), pa.array(start, pa.int64()), pa.array(seg.n_tokens.astype(np.int64)), pa.array(crc, pa.int64())],
                    ["part", "seq", "doc_id", "inner", "n_tokens", "ids_crc32"],
                )

    rows = segments.select("part", "seq", "image").mapInArrow(tidy(run), "part int, seq int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return rows.join(bases, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def save(docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Token files at `path`: segments, and the dictionary beside them under its hash."""
    dictionary = sample_dictionary(docs, tokenizer)
    spark = docs.sparkSession
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, bytearray(dictionary))], "digest string, dictionary binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/dictionaries/{digest}")
    write_tokens(docs, dictionary, tokenizer).write.mode("overwrite").parquet(f"{path}/segments")


def opened(spark: SparkSession, path: str) -> tuple[DataFrame, bytes]:
    """The segments at `path` and the dictionary that their headers name."""
    segments = spark.read.parquet(f"{path}/segments")
    head = segments.select(F.substring("image", 1, _HEAD.size).alias("head")).first()
    if head is None:
        return segments, b""
    digest = _HEAD.unpack(bytes(head["head"]))[3].hex()
    return segments, bytes(spark.read.parquet(f"{path}/dictionaries/{digest}").first()["dictionary"])


def document(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """The ids of the documents with this doc_id: only segments that can hold it are read."""
    segments, dictionary = opened(spark, path)
    found = []
    for row in segments.where((F.col("low") <= doc_id) & (F.col("high") >= doc_id)).select("part", "seq", "image").orderBy("part", "seq").collect():
        seg = Segment(bytes(row["image"]), dictionary)
        found += [seg.read(int(k)) for k in np.flatnonzero((seg.doc_id == doc_id) & (seg.has_id == 1))]
    return found


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = kept_path(spark, "token-files")
    save(table(spark, sf_dir, "documents"), path)
    return read_tokens(*opened(spark, path))
