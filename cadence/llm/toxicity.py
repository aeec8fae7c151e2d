"""Toxicity by a subsequence string kernel SVM with Nystroem landmarks.

Kernel: the gap-weighted subsequence kernel of order 3 (every common subsequence of three
letters counts decay^(span in s + span in t)), normalised, between a word and a landmark word.
Letters may be missing, inserted or separated by marks and the word still comes close. A
sentence is the pooled vector of its words: for each landmark the best kernel value (words
whose best value with a toxic landmark is below `FLOOR`, or that of its weakest variant if less,
or that lack too many of its letters, count as zero). Nystroem whitening (K_mm^-1/2) turns that into features of a linear SVM
(squared hinge) trained on labelled sentences: those near a landmark in toxic texts against
those in the others. Insults common in the training texts are also trained with one letter
inserted or missing. A text is judged by the margin of its worst sentence, by how many of its
words come near each insult, and by their share of its words: a word that plain texts hold now
and then, too, tells little alone and much when it comes again and again. A logistic curve over
these, fitted on texts whose sentences the SVM had not seen, gives the score from 0 to 1.

Training reads a bounded sample: at most `per_class` labelled texts of either class, chosen by a
hash of doc_id from rows whose crc32(doc_id) mod 5 is not 0. Landmarks are the words, and the
stems that come twice in a text, most typical of toxic training texts, kept unlike one another,
and the words of the other texts that come nearest to them. Inputs are texts alone.

Scale: the sample is a fixed bound, so it is collected and the model (some hundred kB) travels
with the task. Scoring is map-only; each worker scores a distinct word once (bounded table).

Defined results: null and empty texts get the score of a text without known words; very long texts
are scored whole (only training reads none above `longest`); a row without doc_id is scored and
counts as not held out; labels that are null are not used, and of several labels of one doc_id the largest counts; without both
classes the score is the share of toxic labels; repeated rows score alike; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, tidy

ORDER, DECAY, FLOOR = 3, 0.6, 0.48
#: an insult in this share of the toxic training texts is trained with its variants
COMMON = 0.01
#: letters that variants get inserted, besides doubled ones
INSERTED = "xen"
LONGEST = 24
_DROP = re.compile(r"[\W\d_]+")
_SPACED = re.compile(r"\b[^\W\d_](?:[\s.\-_*]{1,2}[^\W\d_]\b){3,}")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
#: digits and signs that stand for letters; a fixed table
LOOKS = str.maketrans("013457@$", "oieastas")


def clean(word: str) -> str:
    """Letters of a word in lower case; look-alike signs inside count as letters."""
    if word.isalpha():
        return word
    bare = _DROP.sub("", word)
    if bare and len(bare) >= 2 and any(c in word[1:] for c in "013457@$"):
        return _DROP.sub("", word.translate(LOOKS))
    return bare


def tokens(text: str) -> list[str]:
    """Lower-cased words; letters spaced out one by one also count as the word they spell."""
    lower = text.lower()
    out = lower.split()
    for m in _SPACED.finditer(lower):
        out.append(_DROP.sub("", m.group()))
    return out


def parts(word: str) -> list[str]:
    """Long words in overlapping stretches."""
    if len(word) <= LONGEST:
        return [word]
    return [word[k : k + LONGEST] for k in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def _codes(words: list[str]) -> np.ndarray:
    width = max(map(len, words), default=1)
    out = np.zeros((len(words), max(width, 1)), np.int32)
    for k, w in enumerate(words):
        out[k, : len(w)] = np.frombuffer(w.encode("utf-32-le"), np.int32)
    return out


def subsequence_kernel(s: np.ndarray, t: np.ndarray, pad: int) -> np.ndarray:
    """Kernel of the pairs (s[k], t[k]) of code arrays padded with 0 (s) or `pad` (t)."""
    n, ls, lt = len(s), s.shape[1], t.shape[1]
    same = (s[:, :, None] == np.where(t == 0, pad, t)[:, None, :]).transpose(1, 2, 0).astype(np.float32)
    prime = np.ones((ls + 1, lt + 1, n), np.float32)
    for _ in range(ORDER - 1):
        new = np.zeros_like(prime)
        for a in range(1, ls + 1):
            run = np.zeros(n, np.float32)
            for b in range(1, lt + 1):
                run = DECAY * run + (DECAY * DECAY) * same[a - 1, b - 1] * prime[a - 1, b - 1]
                new[a, b] = DECAY * new[a - 1, b] + run
        prime = new
    return (DECAY * DECAY) * (same * prime[:ls, :lt]).sum(axis=(0, 1))


def variants(word: str) -> list[str]:
    """The word with one letter inserted, or one of its inner letters missing."""
    out = {word[:k] + c + word[k:] for k in range(1, len(word)) for c in INSERTED + word[k]}
    out.update(word[:k] + word[k + 1 :] for k in range(1, len(word) - 1) if len(word) > ORDER)
    return sorted(out - {word})


@dataclass
class Kernel:
    """Kernel values of words with fixed landmarks, of which the first `toxic` are insults.

    Insults in `common` also count words as far off as their own variants."""

    landmarks: list[str]
    toxic: int
    common: tuple[str, ...] = ()

    def __post_init__(self):
        self.codes = _codes(self.landmarks)
        self.own = self._own(self.codes)
        self.masks = self._masks(self.codes)
        letters = np.bitwise_count(self.masks).astype(np.int64)
        wide = np.array([w in self.common for w in self.landmarks], bool)
        short = wide & (letters <= 4) & (letters > ORDER)
        self.needed = np.where((letters > 4) | short, letters - 1, letters)
        # of a short insult an inner letter may be missing, not one at its ends
        ends = self._masks(_codes([w[0] + w[-1] for w in self.landmarks]))
        self.ends = np.where(short, ends, np.uint64(0))
        self.floors = np.full(self.toxic, FLOOR, np.float32)
        for j in np.flatnonzero(wide[: self.toxic]):
            some = _codes(variants(self.landmarks[j]))
            k = subsequence_kernel(some, np.repeat(self.codes[j : j + 1], len(some), axis=0), -1) / np.sqrt(self._own(some) * self.own[j])
            self.floors[j] = min(FLOOR, 0.999 * float(k.min()))

    @staticmethod
    def _masks(codes: np.ndarray) -> np.ndarray:
        """The set of letters of each word, as bits."""
        bits = np.where(codes > 0, np.uint64(1) << (codes % 61).astype(np.uint64), np.uint64(0))
        return np.bitwise_or.reduce(bits, axis=1)

    @staticmethod
    def _own(codes: np.ndarray) -> np.ndarray:
        return np.maximum(subsequence_kernel(codes, codes, -1), 1e-30)

    def values(self, words: list[str], floor: float | None = None) -> dict[str, np.ndarray]:
        """word -> kernel with each landmark, for the words that reach the floor with an insult
        (that insult's own floor, if none is given)."""
        words = sorted((w for w in words if len(w) >= ORDER), key=len)
        if not words or not self.toxic:
            return {}
        codes = _codes(words)
        masks = self._masks(codes)
        size = np.array([len(w) for w in words])
        least = [len(x) - 2 for x in self.landmarks]
        near = [(np.bitwise_count(masks & m) >= k) & (masks & e == e) & (size >= n) for m, k, e, n in zip(self.masks[: self.toxic], self.needed[: self.toxic], self.ends[: self.toxic], least, strict=False)]
        used = np.flatnonzero(np.logical_or.reduce(near))
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        own = np.ones(len(words), np.float32)
        step = 4000
        for lo in range(0, len(used), step):  # words come by length, so blocks are narrow
            pick = used[lo : lo + step]
            own[pick] = self._own(self._narrow(codes[pick]))
        def fill(w: np.ndarray, l: np.ndarray) -> None:
            order = np.argsort(w, kind="stable")
            w, l = w[order], l[order]
            for lo in range(0, len(w), step):
                a, b = w[lo : lo + step], l[lo : lo + step]
                k = subsequence_kernel(self._narrow(codes[a]), self._narrow(self.codes[b]), -1) / np.sqrt(own[a] * self.own[b])
                out[a, b] = np.minimum(k, 1.0)
        w = np.concatenate([np.flatnonzero(x) for x in near])
        fill(w, np.concatenate([np.full(int(x.sum()), j) for j, x in enumerate(near)]))
        hot = np.flatnonzero((out[:, : self.toxic] >= (self.floors if floor is None else floor)).any(axis=1))
        rest = len(self.landmarks) - self.toxic
        if rest and len(hot):
            fill(np.tile(hot, rest), np.repeat(np.arange(self.toxic, len(self.landmarks)), len(hot)))
        return {words[k]: out[k] for k in hot}

    @staticmethod
    def _narrow(codes: np.ndarray) -> np.ndarray:
        return codes[:, : max(1, int((codes > 0).sum(axis=1).max()))]


@dataclass
class Model:
    kernel: Kernel
    weight: np.ndarray
    bias: float = 0.0
    curve: np.ndarray | None = None
    constant: float | None = None
    known: dict = field(default_factory=dict)

    def __getstate__(self):
        return {**self.__dict__, "known": {}}

    def learn(self, words: set[str]) -> None:
        fresh = words - self.known.keys()
        bare = {w: parts(clean(w)) for w in fresh}
        values = self.kernel.values(list({p for ps in bare.values() for p in ps}))
        for w, ps in bare.items():
            got = [values[p] for p in ps if p in values]
            self.known[w] = np.maximum.reduce(got) if got else None

    def sentences(self, texts: list[str]) -> tuple[list[list[np.ndarray]], np.ndarray]:
        """For each text the vectors of its sentences that hold a word near a landmark; and per text
        how many of its words come nearest to each insult, and how many words it has."""
        if len(self.known) > 400_000:
            self.known = {}
        listed = [tokens(t) for t in texts]
        if listed:
            self.learn(set().union(*listed))
        known, out = self.known, []
        counts = np.zeros((len(texts), self.kernel.toxic + 1))
        for k, (text, words) in enumerate(zip(texts, listed, strict=True)):
            found: list[np.ndarray] = []
            near = [v for v in map(known.get, words) if v is not None]
            counts[k, -1] = len(words)
            for v in near:
                counts[k, int(v[: self.kernel.toxic].argmax())] += 1
            if near:
                for sentence in _SENTENCE.split(text):
                    got = [v for v in map(known.get, tokens(sentence)) if v is not None]
                    if got:
                        found.append(np.maximum.reduce(got))
                if not found:  # a word spelt across a sentence's end
                    found.append(np.maximum.reduce(near))
            out.append(found)
        return out, counts

    def margins(self, found: list[list[np.ndarray]]) -> np.ndarray:
        """The largest margin of a text's sentences; plain sentences have the bias."""
        out = np.full(len(found), self.bias)
        for k, vectors in enumerate(found):
            if vectors:
                out[k] = max(out[k], float((np.array(vectors, np.float64) @ self.weight).max()) + self.bias)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        found, counts = self.sentences(texts)
        return 1 / (1 + np.exp(-np.clip(evidence(self.margins(found), counts) @ self.curve, -35, 35)))


def evidence(margins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What a text is judged by: its margin, the share of near words, both together, how often they come again, each count, and 1."""
    hits = counts[:, :-1]
    total, margins = hits.sum(axis=1), np.clip(margins, -2, 2)
    share = np.log1p(100 * total / np.maximum(counts[:, -1], 1))
    return np.column_stack([margins, share, margins * share, np.log1p(np.maximum(total - 1, 0)), np.log1p(hits), np.ones(len(margins))])


def stems(words: list[str]) -> set[str]:
    """The beginnings, of four to eight letters, that two words of a text share (or one word twice)."""
    seen = Counter(w[:k] for w in words for k in range(4, min(len(w), 8) + 1))
    return {stem for stem, n in seen.items() if n > 1}


def pick_landmarks(texts: list[str], labels: np.ndarray, toxic: int = 48, other: int = 64, least_z: float = 3.5) -> Kernel:
    """Words and stems typical of toxic texts, unlike one another, and the others' words nearest to them."""
    seen = (Counter(), Counter())
    twice = (Counter(), Counter())
    for text, label in zip(texts, labels, strict=True):
        words = [p for w in tokens(text) for p in parts(clean(w)) if len(p) >= ORDER]
        seen[label].update(set(words))
        twice[label].update(stems(words))
    n = np.maximum(np.bincount(labels, minlength=2), 1)
    scored = {}
    for counts in (seen, twice):
        for word, hits in counts[1].items():
            p, q = hits / n[1], (counts[0][word] + 0.5) / n[0]
            z = (p - q) / np.sqrt(p / n[1] + q / n[0])
            if hits >= 3 and p > 4 * q and z >= least_z:
                scored[word] = max(z, scored.get(word, 0.0))
    ranked = sorted(scored, key=lambda w: (-round(scored[w], 6), -len(w), w))[:400]
    among = Kernel(ranked, len(ranked)).values(ranked, floor=0.0)
    out: list[str] = []
    taken: list[int] = []
    for k, word in enumerate(ranked):
        if len(out) < toxic and (not taken or word not in among or among[word][taken].max() < 0.55):
            out.append(word)
            taken.append(k)
    common = tuple(w for w in out if max(seen[1][w], twice[1][w]) >= max(3, COMMON * n[1]))
    near = Kernel(out, len(out), common).values([w for w in seen[0] if w not in out])
    kernel = Kernel(out + sorted(near, key=lambda w: (-float(near[w].max()), w))[:other], len(out), common)
    return kernel


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 50.0, steps: int = 60) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge, by Newton steps on the active set. y is -1 or 1."""
    a = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    v = np.zeros(a.shape[1])
    ridge = np.eye(len(v))
    ridge[-1, -1] = 1e-6
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * len(y)
    for _ in range(steps):
        on = y * (a @ v) < 1
        w = cost * share[on]
        new = np.linalg.solve(ridge + (a[on] * w[:, None]).T @ a[on], (a[on] * w[:, None]).T @ y[on])
        if np.allclose(new, v, atol=1e-9):
            break
        v = 0.5 * v + 0.5 * new
    return v[:-1], float(v[-1])


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic curve over the columns of x, the last of which is 1 (regularised targets, balanced classes, Newton steps)."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    weight = np.where(y > 0, 0.5 / max(pos, 1), 0.5 / max(neg, 1)) * len(y)
    hold = np.diag(np.append(np.full(x.shape[1] - 1, ridge), 1e-3))
    v = np.zeros(x.shape[1])
    v[0] = 1.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -35, 35)))
        g = x.T @ (weight * (p - target)) + hold @ v
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + hold
        step = np.linalg.solve(h, g)
        v = v - step / max(1.0, float(np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return v


def train(texts: list[str], labels: list[int]) -> Model:
    y = np.array(labels, int)
    kernel = pick_landmarks(texts, y) if len(set(labels)) == 2 else Kernel([], 0)
    if not kernel.toxic:
        return Model(kernel, np.zeros(0), constant=float(y.mean()) if len(y) else 0.0)
    m = len(kernel.landmarks)
    gram = np.array([kernel.values([w], floor=0.0).get(w, np.zeros(m)) for w in kernel.landmarks], np.float64)
    value, vector = np.linalg.eigh((gram + gram.T) / 2 + 0.01 * np.eye(m))
    whiten = (vector / np.sqrt(np.maximum(value, 1e-2))) @ vector.T
    model = Model(kernel, np.zeros(m))
    found, counts = model.sentences(texts)
    fold = np.arange(len(y)) % 4

    made = [(w, v) for w in kernel.common for v in variants(w)]
    known = kernel.values([v for _, v in made])
    made = [(w, known[v]) for w, v in made if v in known]

    def fit_on(pick: np.ndarray, made: list[np.ndarray]) -> None:
        x, sign = [np.zeros(m)] * 20, [-1.0] * 20  # plain sentences
        x += made
        sign += [1.0] * len(made)
        for k in np.flatnonzero(pick):
            x += found[k]
            sign += [1.0 if y[k] else -1.0] * len(found[k])
        weight, model.bias = fit_svm(np.array(x) @ whiten, np.array(sign))
        model.weight = whiten @ weight

    # insults that plain texts don't hold tell enough alone, in a text of usual length
    plain = (counts[y == 0, : kernel.toxic] > 0).mean(axis=0)
    pure = {w for j, w in enumerate(kernel.landmarks[: kernel.toxic]) if plain[j] < 0.1 * max((counts[y == 1, j] > 0).mean(), 1e-9) and plain[j] < 0.005}
    alone = [(w, v) for w, v in made if w in pure]
    usual = float(np.median(counts[:, -1]))
    rows, sign = [], []
    for k in range(4):
        own = fold == k
        if len(set(y[own])) < 2 or len(set(y[~own])) < 2:
            own[:] = True
        fit_on(~own if not own.all() else own, [v for n, (_, v) in enumerate(made) if n % 4 != k])
        rows.append(evidence(model.margins([f for f, o in zip(found, own, strict=True) if o]), counts[own]))
        sign.append(2.0 * y[own] - 1)
        single = [v for n, (_, v) in enumerate(alone) if n % 16 == k]
        if single:
            one = np.zeros((len(single), kernel.toxic + 1))
            one[np.arange(len(single)), [int(v[: kernel.toxic].argmax()) for v in single]] = 1
            one[:, -1] = usual
            rows.append(evidence(model.margins([[v] for v in single]), one))
            sign.append(np.ones(len(single)))
    model.curve = fit_curve(np.vstack(rows), np.concatenate(sign))
    fit_on(np.ones(len(y), bool), [v for _, v in made])
    return model


def held_out(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1200, longest: int = 20_000) -> Model:
    """A model of at most `per_class` training texts of each class, of at most `longest` characters.

    These bounds keep what the driver collects below 2 * per_class * longest characters."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out("doc_id"))
    short = docs.where(F.length("text") <= longest).select("doc_id").distinct()
    marked = marked.join(short.hint("merge"), "doc_id", "left_semi")  # before the draw, so that it is full
    chosen = None
    for kind in (0, 1):
        one = marked.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = one if chosen is None else chosen.union(one)
    # at most 2 * per_class rows
    rows = docs.select("doc_id", "text").where(F.length("text") <= longest).join(F.broadcast(chosen), "doc_id").collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.text))
    return train([r.text for r in rows], [r.toxic for r in rows])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    packed = docs.sparkSession.sparkContext.broadcast(model)  # at most 64 landmarks and their weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = packed.value
        for batch in batches:
            for piece in slices(batch, "text", 1_000_000):
                got = own.scores([t or "" for t in piece.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(got.astype(np.float64))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
