"""Source divergence against its SQL and a plain version."""

import glob
import os
import random
import re
from collections import Counter, defaultdict

import duckdb

from cadence.llm import divergence
from cadence.llm.oracles import ORACLES
from cadence.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string"
COLUMNS = ("lang", "source", "part", "item", "value", "rank")


def plain(docs):
    rows = [((lang or ""), (source or ""), [t for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").encode().lower().decode())]) for _, text, lang, source in docs]
    groups, having = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in rows:
        groups[lang, source].update(terms)
        having[lang].update(set(terms))
    out = []
    for (lang, source), counts in groups.items():
        kept = [t for t, n in having[lang].items() if n >= 10]
        every = Counter()
        for (k, _), c in groups.items():
            if k == lang:
                every.update(c)

        def p(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        f = lambda a, b: (a - b) ** 2 // (a + b)
        mine, q = p(counts), p(every)
        pairs = []
        for (k, s), c in groups.items():
            if k == lang and s != source:
                theirs = p(c)
                pairs.append((-sum(f(mine[t], theirs[t]) for t in kept), s.encode()))
        terms = [(-f(mine[t], q[t]), t.encode()) for t in kept if counts[t] and mine[t] > q[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:10])):
            out += [(lang, source, part, item.decode(), -value, k) for k, (value, item) in enumerate(found, 1)]
    return sorted(out)


def answer(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_query_equals_sql(spark):
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    want = c.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLES['op13_source_divergence']})").fetchall()
    assert answer(QUERIES["op13_source_divergence"](spark, SF)) == sorted(want)


def test_against_plain_version(spark):
    rng = random.Random(2)
    words = [f"w{chr(97 + k)}" for k in range(26)] + ["École", "naïve", "漢字", "UPPER"]
    docs = [(k, " ".join(rng.choices(words, range(1, 31), k=rng.randrange(40))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "ü", None, ""])) for k in range(300)]
    docs += [(0, "same same", "en", "a"), (0, "same same", "en", "a"), (None, None, "en", "empty"), (7, "", "xx", "alone"), (8, "1 2 3", "yy", "one"), (8, "rare words", "yy", "two")]
    docs += [(9, "0123456789 " * 110_000 + "behind", "en", "a"), (10, "\U0001f600 long " * 3, "en", "a\x01b")] + [(20 + k, f"tied equal {k}", "tt", "st"[k % 2]) for k in range(24)]
    df = spark.createDataFrame(docs, SCHEMA)
    want = plain(docs)
    assert answer(divergence.source_divergence(df)) == want
    # many small shards and folds give the same
    assert answer(divergence.source_divergence(df, most=20)) == want
    extra = df.selectExpr("*", "1 AS term", "2 AS n", "3 AS bucket", "4 AS part")
    assert answer(divergence.source_divergence(extra)) == want


def test_empty_table(spark):
    assert answer(divergence.source_divergence(spark.createDataFrame([], SCHEMA))) == []
