"""Grouping of spelling variants by anagram hashing.

A word's anagram key is the sum of the fifth powers of its letters' code points (modulo the prime
2^61 - 1): equal for all orders of the same letters. Taking a letter away subtracts its value, so

    one letter more or less:   key(u) - value(a) = key(w)
    one letter exchanged:      key(u) - value(a) = key(w) - value(b)

and every near pair meets under a key that at least one of both reaches by losing a letter: each
word is listed under its own key and under its key less each of its letters, and only entries
whose key another word has too go on. There the order of letters is verified: each entry becomes
the word without the letter, at every place where it stands. Equal remainders at the same place
are an exchange; a remainder that is a word itself is a letter more.

Scale: words are counted in the task that reads the texts, then summed. No pair of words is
compared: a key that holds a third of all words only sends those words to the second step, where
a group is one word with one place open, which at most one word for each letter of the alphabet fills
(90), or one word with a letter more somewhere (90 for each place). Remainders of words above
`long_word` letters travel as prints of 124 bits, so a word of m letters costs m rows, not m
squared letters. Forms are followed by doubling: five joins for chains of up to 32, and a chain
grows by a factor of ten a step.

Defined results: null text has no words; a null doc_id reads as '' in the check sum; repeated rows
count again; very long texts are read in slices cut between runs; words of equal count are
ordered by code point; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, staged, table, tidy
from .divergence import stretches

GAP = re.compile("[^A-Za-zÀ-ÿ]")
PRIME = (1 << 61) - 1
#: Four primes below 2^31, and a base for each, of the prints of long remainders.
PRINTS = ((2147483647, 1103515245), (2147483629, 69069), (2147483587, 1664525), (2147483579, 22695477))


def word_counts(docs: DataFrame, least_letters: int = 7, one_in: int = 31, most: int = 200_000) -> DataFrame:
    """(word, n): how often each word of enough letters occurs; every `one_in`th run has lost a letter."""
    long_run = re.compile("[a-zÀ-ÿ]{%d,}" % least_letters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return made

        for whole in batches:
            for batch in slices(whole, "text"):
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    own = crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    # bytes lower A-Z only
                    for piece in stretches((text or "").encode().lower().decode(), GAP):
                        for word, n in Counter(long_run.findall(piece)).items():
                            h = crc32(word.encode(), own)
                            if h % one_in == 0:
                                at = h % len(word)
                                word = word[:at] + word[at + 1 :]
                                if len(word) < least_letters:
                                    continue
                            held[word] += n
                if len(held) > most:
                    yield out()
        yield out()

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _value(letter: Column) -> Column:
    c = F.ascii(letter).cast("long")
    return c * c * c * c * c


def anagram_key(letters: Column) -> Column:
    return F.aggregate(letters, F.lit(0).cast("long"), lambda total, letter: (total + _value(letter)) % F.lit(PRIME))


@lru_cache(maxsize=4)
def _powers(n: int) -> list[np.ndarray]:
    """base^0, base^1, ... base^(n-1) for each prime."""
    out = []
    for prime, base in PRINTS:
        p = np.ones(n, np.int64)
        done = 1
        while done < n:
            step = min(done, n - done)
            p[done : done + step] = p[:step] * pow(base, done, prime) % prime
            done += step
        out.append(p)
    return out


def prints(word: str, places: np.ndarray | None) -> list[str]:
    """The print of the word, or of the word without each of the places."""
    codes = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.int64)
    columns = []
    for (prime, base), power in zip(PRINTS, _powers(1 << (len(word) - 1).bit_length()), strict=True):
        sums = np.append(0, np.cumsum(codes * power[: len(codes)] % prime))  # below 2^31 for each letter
        if places is None:
            columns.append(sums[-1:] % prime)
        else:
            behind = (sums[-1] - sums[places + 1]) % prime
            columns.append((sums[places] % prime + behind * pow(base, -1, prime) % prime) % prime)
    return ["#%x.%x.%x.%x" % x for x in zip(*(c.tolist() for c in columns), strict=True)]


def remainders(entries: DataFrame, long_word: int) -> DataFrame:
    """(rest, place, first, id, n): the word less the letter, at every place of it; place -1: the word itself.

    `first` is false where a letter earlier gives the same rest. entries: id, word, n, letter ('' for the word itself)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest, place, first, source = [], [], [], []
            numbers = batch.select(["id", "n"])

            def out(numbers: pa.RecordBatch) -> pa.RecordBatch:
                took = numbers.take(pa.array(source, pa.int64()))
                made = pa.RecordBatch.from_arrays([pa.array(rest, pa.string()), pa.array(place, pa.int32()), pa.array(first, pa.bool_()), took.column("id"), took.column("n")], ["rest", "place", "first", "id", "n"])
                for x in (rest, place, first, source):
                    x.clear()
                return made

            for k, (word, letter) in enumerate(zip(batch.column("word").to_pylist(), batch.column("letter").to_pylist(), strict=True)):
                if not letter:
                    rest.append(word if len(word) <= long_word else prints(word, None)[0])
                    place.append(-1)
                    first.append(True)
                    source.append(k)
                else:
                    at = [m for m, c in enumerate(word) if c == letter]
                    rest += [word[:m] + word[m + 1 :] for m in at] if len(word) - 1 <= long_word else prints(word, np.array(at))
                    place += at
                    first += [m == 0 or word[m - 1] != letter for m in at]
                    source += [k] * len(at)
                if len(rest) > 100_000:
                    yield out(numbers)
            yield out(numbers)

    return entries.select("id", "word", "n", "letter").mapInArrow(tidy(run), "rest string, place int, first boolean, id long, n long")


def near_words(words: DataFrame, long_word: int = 64) -> DataFrame:
    """(id, n_near, best_n, best): number of near words, and the id of the one of largest n, the smallest of these.

    words: id, word, n; ids follow the order of the words."""
    listed = words.withColumn("letters", F.expr("filter(split(word, ''), x -> x <> '')")).withColumn("size", F.char_length("word"))
    listed = listed.withColumn("key", anagram_key(F.col("letters")))
    less = listed.select("id", "word", "n", "key", "size", F.explode(F.array_distinct("letters")).alias("letter"))
    less = less.select("id", "word", "n", "letter", F.pmod(F.col("key") - _value(F.col("letter")), F.lit(PRIME)).alias("key"), (F.col("size") - 1).alias("size"))
    entries = staged(listed.select("id", "word", "n", F.lit("").alias("letter"), "key", "size").union(less), "anagram-keys")
    shared = entries.groupBy("key", "size").agg(F.count(F.lit(1)).alias("words"), F.max("letter").alias("letter")).where("words > 1 and letter <> ''").select("key", "size")
    open_ = staged(remainders(entries.join(shared.hint("merge"), ["key", "size"]), long_word), "remainders")
    ranked = lambda n, key: F.struct((-F.col(n)).alias("least"), F.col(key).alias("id"))
    # one word with one place open: at most one word for each letter of the alphabet
    filled = open_.where("place >= 0").groupBy("rest", "place").agg(F.sort_array(F.collect_list(ranked("n", "id"))).alias("all")).where(F.size("all") > 1)
    filled = filled.select("all", F.explode("all").alias("own"))
    other = F.when(F.col("own.id") == F.col("all")[0]["id"], F.col("all")[1]).otherwise(F.col("all")[0])
    exchanged = filled.select(F.col("own.id").alias("id"), (F.size("all") - 1).cast("long").alias("n_near"), other.alias("best"))
    whole = open_.where("place < 0").select("rest", F.col("id").alias("short"), F.col("n").alias("short_n"))
    met = open_.where("place >= 0 and first").select("rest", "id", "n").join(whole.hint("merge"), "rest")
    one = F.lit(1).cast("long").alias("n_near")
    longer = met.select("id", one, ranked("short_n", "short").alias("best")).union(met.select(F.col("short").alias("id"), one, ranked("n", "id").alias("best")))
    found = exchanged.union(longer).groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return found.select("id", "n_near", (-F.col("best.least")).alias("best_n"), F.col("best.id").alias("best"))


def followed(forms: DataFrame) -> DataFrame:
    """(id, root): from each word with a form along forms to the last."""
    roots = staged(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        step = roots.select(F.col("id").alias("root"), F.col("root").alias("next"))
        further = roots.join(step.hint("merge"), "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        further = staged(further, "roots")
        if not further.where("moved").limit(1).count():
            return further.select("id", "root")
        roots = further.select("id", "root")


def spelling_variants(docs: DataFrame, least_letters: int = 7, least_n: int = 2, times: int = 10, one_in: int = 31, long_word: int = 64) -> DataFrame:
    """word, form, root, n, n_near, form_n: see the module."""
    counted = staged(word_counts(docs, least_letters, one_in).where(F.col("n") >= least_n), "word-counts")
    # numbered in the order of the words, so that a smaller number is an earlier word
    words = staged(counted.orderBy("word").withColumn("id", F.monotonically_increasing_id()), "words")
    near = near_words(words, long_word)
    strong = F.col("best_n") >= times * F.col("n")
    known = words.join(near.hint("merge"), "id", "left").select("id", "word", F.when(strong, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best_n")).alias("form_n"))
    known = staged(known, "variants")
    roots = followed(known.where("form is not null"))
    # both names come from one join: a word's row is met by those whose form or root it is
    ends = roots.join(known.select("id", "form").hint("merge"), "id").select("id", F.explode(F.array(F.struct(F.lit("form").alias("as"), F.col("form").alias("of")), F.struct(F.lit("root").alias("as"), F.col("root").alias("of")))).alias("x")).select("id", "x.*")
    named = ends.join(words.select(F.col("id").alias("of"), F.col("word").alias("name")).hint("merge"), "of")
    named = named.groupBy("id").agg(*(F.max(F.when(F.col("as") == c, F.col("name"))).alias(f"{c}_word") for c in ("form", "root")))
    return known.join(named.hint("merge"), "id", "left").select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))
