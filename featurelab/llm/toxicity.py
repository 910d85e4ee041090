"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding: lower case, homoglyphs to the letters they look like, digits and signs between
letters to the letters they stand for, everything else that is no letter to a space.

The lexicon is learned from labelled documents: entries are words and word beginnings that
occur in toxic documents and hardly in others, each weighted by its log odds.  A beginning
that is good enough stands for all words that begin so.  A text's matches (the longest at
each place, at word beginnings, none inside an exception phrase) are summed up as the
highest weight, the sum of the weights of the different entries, and the weight per hundred
words, which is the normalisation by length; a logistic model on these gives the score.

Fitting reads at most ``MAX_TRAIN`` labelled documents, those of the lowest hash; counting,
matching and scoring cover all documents and whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurelab.session import ship_package

from . import words as W
from .stage import free_name, written

#: Labelled documents that a model is fitted on.
MAX_TRAIN = 20_000
MIN_DOCS, MIN_PRECISION = 4, 0.8
SHORTEST, LONGEST = 4, 9             # letters of a word beginning
SHORTEST_WORD = 2                    # letters of a whole word
COUNTED = 500_000                    # entries that a task counts before it hands them on
# fixed values: phrases in which lexicon words say nothing bad
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "rodeo clown", "sore loser rule", "stupid simple")
# fixed values: letters that look alike, and digits and signs that stand for letters
GLYPHS = dict(zip("аеорсухіјѕԁһԛԝαοερτυνικɡıƽ@$0134578", "aeopcyxijsdhqwaoeptuvikgisasoieastb"))
_SIGNS = "@$0134578"
_DISGUISED = re.compile(rf"(?<=[^\W\d_])[{re.escape(_SIGNS)}]+(?=[^\W\d_])|(?<![\w@$])[@$](?=[^\W\d_])")
_LETTERS = re.compile(r"[^\W\d_]+")


class _Fold(dict):
    """Translation table, filled as characters turn up."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        if c in _SIGNS:
            out = code
        elif c in GLYPHS:
            out = ord(GLYPHS[c])
        elif 0xFF21 <= code <= 0xFF5A and chr(code - 0xFEE0).isalpha():
            out = ord(chr(code - 0xFEE0).lower())
        else:
            out = code if c.isalpha() else 0x20
        self[code] = out
        return out


_TABLE = _Fold()


def fold(text: str) -> str:
    t = text.lower().translate(_TABLE)
    return _DISGUISED.sub(lambda m: "".join(GLYPHS[c] for c in m[0]), t)


class Lexicon:
    """Entries: pattern -> (weight, whole word only); exceptions are phrases."""

    def __init__(self, entries: dict[str, tuple[float, bool]], exceptions: tuple[str, ...] = EXCEPTIONS):
        self.entries, self.exceptions = entries, exceptions
        self._auto = None

    def __getstate__(self):
        return {"entries": self.entries, "exceptions": self.exceptions, "_auto": None}

    def automaton(self):
        if self._auto is None:
            self._auto = ahocorasick.Automaton()
            for e, (_, whole) in self.entries.items():
                self._auto.add_word(e, (len(e), e, whole))
            for e in self.exceptions:
                self._auto.add_word(e, (len(e), None, True))
            self._auto.make_automaton()
        return self._auto

    def matches(self, folded: str) -> list[tuple[int, int, str]]:
        """(start, end, entry): at each place the longest entry, none in an exception phrase."""
        best, shields = {}, []
        if not len(self.entries):
            return []
        for last, (n, entry, whole) in self.automaton().iter(folded):
            start, end = last + 1 - n, last + 1
            if start and folded[start - 1].isalpha() or whole and end < len(folded) and folded[end].isalpha():
                continue
            if entry is None:
                shields.append((start, end))
            elif start not in best or end > best[start][0]:
                best[start] = (end, entry)
        return [(s, e, x) for s, (e, x) in sorted(best.items()) if not any(a <= s and e <= b for a, b in shields)]

    def features(self, text: str | None) -> tuple[float, float, float]:
        folded = fold(text or "")
        found = self.matches(folded)
        if not found:
            return 0.0, 0.0, 0.0
        weights = [self.entries[x][0] for _, _, x in found]
        n = folded.count(" ") + 1
        return max(weights), sum(self.entries[x][0] for x in {x for _, _, x in found}), 100 * sum(weights) / (n + 50)


def _candidates(text: str | None) -> set[str]:
    """Words of two letters or more (marked by a final space) and word beginnings."""
    out = set()
    for w in set(_LETTERS.findall(fold(text or ""))):
        if len(w) >= SHORTEST_WORD:
            out.add(w + " ")
        out.update(w[:n] for n in range(SHORTEST, min(len(w), LONGEST) + 1))
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either label that hold an entry, in tables of bounded size."""
    n: tuple[Counter, Counter] = (Counter(), Counter())

    def out():
        entries = list(n[0].keys() | n[1].keys())
        counts = [pa.array([n[label][e] for e in entries], pa.int64()) for label in (1, 0)]
        return pa.RecordBatch.from_arrays([pa.array(entries, pa.string()), *counts], ["entry", "bad", "good"])

    for batch in batches:
        for text, label in zip(batch.column("text"), batch.column("label").to_pylist()):
            n[label].update(_candidates(text.as_py()))
            if len(n[0]) + len(n[1]) > COUNTED:
                yield out()
                n[0].clear()
                n[1].clear()
    yield out()


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Lexicon of a written sample (text, label 0 or 1); empty if a label is missing.

    Every entry that is frequent and precise enough is in it, none is cut off.  Both counts
    meet in one aggregate and are filtered there; the driver gets the entries that pass, each
    of them in ``MIN_DOCS`` documents or more of a sample of at most ``MAX_TRAIN``."""
    totals = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return Lexicon({})
    counts = (sample.mapInArrow(_count, "entry string, bad long, good long").groupBy("entry")
              .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")))
    a, b = F.col("bad") / bad, F.col("good") / good
    balance = a / (a + b + 1 / good)                      # precision, were both labels as frequent
    passed = counts.filter((F.col("bad") >= MIN_DOCS) & (balance >= MIN_PRECISION)
                           & (F.col("bad") >= (F.col("bad") + F.col("good") + 1) * F.lit(MIN_PRECISION)))
    n = {r.entry: (r.bad, r.good) for r in passed.collect()}
    chosen: dict[str, tuple[float, bool]] = {}
    for e in sorted(n, key=lambda e: (len(e), e)):
        word = e.rstrip(" ")
        if any(word[:k] in chosen and not chosen[word[:k]][1] for k in range(SHORTEST, len(word) + 1)):
            continue                                      # a beginning stands for it already
        n1, n0 = n[e]
        chosen[word] = (log((n1 + 0.5) / (bad + 1)) - log((n0 + 0.5) / (good + 1)), e.endswith(" "))
    return Lexicon(chosen)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps with halving; the intercept comes last and is not shrunk."""
    z = np.column_stack((x, np.ones(len(x))))
    w, keep = np.zeros(z.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6])

    def loss(w):
        m = z @ w
        return np.logaddexp(0, -m)[y == 1].sum() + np.logaddexp(0, m)[y == 0].sum() + w @ keep @ w / 2

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + keep, z.T @ (p - y) + keep @ w)
        t = 1.0
        while t > 1e-6 and loss(w - t * step) > loss(w):
            t /= 2
        w = w - t * step
        if t * np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    def __init__(self, lexicon: Lexicon, scale: np.ndarray, weights: np.ndarray):
        self.lexicon, self.scale, self.weights = lexicon, scale, weights

    def score(self, text: str | None) -> float:
        return float(self.scores(np.array([self.lexicon.features(text)]))[0])

    def scores(self, features: np.ndarray) -> np.ndarray:
        x = np.log1p(np.maximum(features, 0)) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", use: Column | None = None) -> Model:
    """Model from the labelled documents that ``use`` allows (a condition on the id; all, if None).

    Labels other than 0 and 1, null ids and labelled ids without a document do not count; an
    id with both labels counts once for each.  Without both labels every score is the share
    of label 1 (0 without any label)."""
    ship_package(docs.sparkSession)
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.filter(F.col("id").isNotNull() & F.col("label").isin(0, 1)).distinct()
    if use is not None:
        known = known.filter(use)
    chosen = known.orderBy(F.xxhash64("id"), "id", "label").limit(MAX_TRAIN)
    sample = written(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
                     .join(F.broadcast(chosen), "id").select("text", "label"), "toxic-sample")
    lexicon = learn_lexicon(sample)

    def measure(batches):
        for batch in batches:
            f = np.array([lexicon.features(t.as_py()) for t in batch.column("text")], float).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*(pa.array(f[:, i]) for i in range(3)), batch.column("label")],
                                             ["a", "b", "c", "label"])

    # three numbers and a label for each of at most MAX_TRAIN documents (more where ids repeat)
    rows = sample.mapInArrow(measure, "a double, b double, c double, label int").groupBy(
        "a", "b", "c", "label").agg(F.count("*").alias("n")).toPandas()
    y = np.repeat(rows["label"].to_numpy(), rows["n"])
    x = np.log1p(np.maximum(np.repeat(rows[["a", "b", "c"]].to_numpy(float), rows["n"], axis=0), 0))
    scale = np.maximum(x.max(axis=0, initial=0.0), 1e-9)
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.0
        return Model(lexicon, scale, np.array([0, 0, 0, log((share + 1e-6) / (1 - share + 1e-6))]))
    return Model(lexicon, scale, _logistic(x / scale, y))


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column ``name`` (the next free name, if taken): the score of each text
    in [0, 1], null and empty texts like ones without matches.  Repeated rows stay, each with
    its score.  A map; nothing is shuffled."""
    ship_package(docs.sparkSession)
    name = free_name(docs, name)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in W.chunks(batch, text_col, 4 << 20):
                f = np.array([m.lexicon.features(t.as_py()) for t in part.column(text_col)], float).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(m.scores(f))], [*columns, name])

    return docs.mapInArrow(run, docs.withColumn(name, F.lit(0.0)).schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               limit: float = 0.5, use: Column | None = None) -> DataFrame:
    """The rows of ``docs`` whose score is below ``limit``, all columns as they were."""
    scored = score(docs, fit(docs, labels, id_col, text_col, use=use), text_col, free_name(docs, "toxicity"))
    return scored.filter(F.col(scored.columns[-1]) < limit).select(*docs.columns)
