"""Secret scans: token patterns, and guess costs of values in a credential context.

Fixed patterns find long values after credential names, access keys and hexadecimal runs.
Values after credential names that those miss, most of them passwords, are judged by what
they would cost to guess: dynamic programming splits the value into words, dates, repeats,
keyboard walks and brute force at the least total cost.  Those above ``MIN_GUESSES`` are
reported as ``guess``; placeholders such as ``changeme`` are not.

The words are those of the scanned texts themselves, ranked by the number of texts that hold
them (``dictionary``), after the commonest passwords and placeholders.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log10

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelab.session import ship_package

from . import words as W
from .stage import written

KINDS = ("assign", "access", "hex", "guess")
MIN_GUESSES = 8.0                    # powers of ten
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_CONTEXT_SQL = (r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|credentials?|token|(?:api|access|private)[_-]?key|"
                r"login|pin)[\"']?[\x20\t]*(?::=|=>|[:=])[\x20\t]*(?:\"([^\"\r\n]+)\"|'([^'\r\n]+)'|([^\s\"',;<>]+))")
_CONTEXT = re.compile(_CONTEXT_SQL, re.I | re.A)
_NAMES = ("pass", "pwd", "secret", "credential", "token", "key", "login", "pin")

# fixed values: common passwords and placeholder words, most frequent first
COMMON = """password admin letmein welcome monkey dragon login master hello freedom whatever qazwsx trustno secret
summer winter spring autumn love baby football baseball soccer hockey superman batman shadow sunshine princess
flower ninja michael jordan jennifer hunter thomas robert daniel charlie andrew jessica ashley nicole george
computer internet samsung google android apple windows server system root guest user test demo example sample
default changeme change me placeholder none null true false your my the pass word key token here insert value
redacted hidden dummy foo bar baz abc xyz qwe asd temp public private company office home family friend money
happy lucky star black white blue green red orange yellow purple silver gold tiger lion eagle cat dog horse
january february march april may june july august september october november december monday tuesday wednesday
thursday friday saturday sunday""".split()
# fixed values: rows of the keyboard that walks follow
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz", "qazwsxedcrfvtgbyhnujm")
#: Words of the dictionary (about 1 MB on the driver and in each task), most frequent first;
#: words in fewer texts than MIN_TEXTS are none, as are those of other lengths.
DICTIONARY_WORDS, MIN_TEXTS = 50_000, 5
SHORTEST_WORD, LONGEST_WORD = 3, 20
_LEET = str.maketrans("0134578@$!", "oieastbasi")
_STEP = {(r[i], r[i + 1]) for r in ROWS for i in range(len(r) - 1)}
_STEP |= {(b, a) for a, b in _STEP}
_DATE = re.compile(r"(?:(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|"
                   r"(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d)")


class Words:
    """Rank of every known word, 1 the first to be guessed."""

    def __init__(self, ranked: list[str] = ()):
        self.rank: dict[str, int] = {}
        for w in (*COMMON, *ranked):
            self.rank.setdefault(w, len(self.rank) + 1)
        self.longest = max(map(len, self.rank))


KNOWN = Words()


class _Starts:
    """Where a segment of the current repeat or walk may begin, with the cost up to there.

    A start is left out if an earlier one is never dearer, so few are kept."""

    def __init__(self):
        self.kept: list[tuple[int, float]] = []

    def add(self, j: int, cost: float) -> None:
        if all(cost - c < log10((j + 3 - k) / 3) for k, c in self.kept):
            self.kept.append((j, cost))

    def least(self, i: int) -> float:
        """Least cost of a segment of three or more that ends before ``i``, without its fixed part."""
        return min((c + log10(i - k) for k, c in self.kept if i - k >= 3), default=float("inf"))


def _brute(c: str) -> float:
    return log10(10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 100)


def guess_cost(value: str, words: Words = KNOWN) -> float:
    """log10 of the guesses an informed attacker needs: the least sum over all segmentations,
    with a factor of 2 for every segment after the first (brute force of one character is no
    segment).  0 for an empty value.  Time grows about linearly: words and dates are short,
    and of the starts of a repeat or walk only those that may be best are kept."""
    n = len(value)
    low = value.lower()
    plain = low.translate(_LEET)
    cost = [0.0] + [float("inf")] * n
    repeats, walks = _Starts(), _Starts()
    for i in range(1, n + 1):
        step = lambda j: cost[j] + (log10(2) if j else 0)
        best = cost[i - 1] + _brute(value[i - 1])
        if i > 1 and value[i - 1] != value[i - 2]:
            repeats = _Starts()
        if i > 1 and (low[i - 2], low[i - 1]) not in _STEP:
            walks = _Starts()
        repeats.add(i - 1, step(i - 1))
        walks.add(i - 1, step(i - 1))
        best = min(best, repeats.least(i) + _brute(value[i - 1]), walks.least(i) + log10(4 * 47))
        for j in range(max(0, i - words.longest), i - 1):
            for text, extra in ((low[j:i], 0.0), (plain[j:i], log10(4))):
                if rank := words.rank.get(text):
                    raw = value[j:i]
                    case = 0.0 if raw == raw.lower() else log10(2) if raw[1:] == raw[1:].lower() else log10(2 ** min(i - j, 30))
                    best = min(best, step(j) + log10(rank + 1) + case + extra)
        for length in (4, 8, 10):
            if length <= i and _DATE.fullmatch(value, i - length, i):
                best = min(best, step(i - length) + log10(100 if length == 4 else 36500 * (1 if length == 8 else 4)))
        cost[i] = best
    return cost[n]


def dictionary(docs: DataFrame, text_col: str = "text", most: int = DICTIONARY_WORDS, min_texts: int = MIN_TEXTS) -> Words:
    """The words in most rows of ``docs``, each in ``min_texts`` rows or more: whole levels of
    frequency from the top, as many as hold ``most`` words together.  A level is a sixteenth of a
    power of two, at low counts a single count.

    Words are runs of ASCII letters of any case, 3 to 20 long, that no letter, digit or
    underscore adjoins, outside values after credential names: a password in many copies of
    a text does not become a word.  Null and empty texts have none.  All rows are counted in
    Spark, a word once per row, and written; the driver gets the sizes of the levels (about
    a thousand) and the ranked words, never more than ``most``."""
    inside = F.regexp_replace(F.lower(F.col(text_col)), _CONTEXT_SQL, " ")
    each = F.explode(F.array_distinct(F.regexp_extract_all(
        inside, F.lit(rf"\b[a-z]{{{SHORTEST_WORD},{LONGEST_WORD}}}\b"), F.lit(0))))
    counted = docs.select(each.alias("word")).groupBy("word").agg(F.count("*").alias("texts")).filter(F.col("texts") >= min_texts)
    counted = written(counted.withColumn("level", F.floor(16 * F.log2("texts")).cast("int")), "word-counts")
    lowest, total = None, 0
    for level, n in sorted(counted.groupBy("level").agg(F.count("*").alias("n")).collect(), reverse=True):
        total += n
        if total > most:
            break
        lowest = level
    if lowest is None:
        return Words()
    found = counted.filter(F.col("level") >= lowest).select("texts", "word").collect()
    return Words([r.word for r in sorted(found, key=lambda r: (-r.texts, r.word))])


def find(text: str, words: Words = KNOWN) -> list[tuple[int, str, int]]:
    """(start, kind, end) of every finding, by start, then in the order of ``KINDS``."""
    out = []
    low = text.lower()
    if any(x in low for x in ("password", "passwd", "secret", "token", "api")) or not text.isascii():
        out += [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    if any(x in low for x in _NAMES):
        taken = sorted((s, e) for s, _, e in out)
        at, seen = 0, -1             # base spans before the match, and how far they reach
        for m in _CONTEXT.finditer(text):
            group = m.lastindex
            start, end = m.span(group)
            while at < len(taken) and taken[at][0] < end:
                seen = max(seen, taken[at][1])
                at += 1
            if seen <= start and guess_cost(m[group], words) >= MIN_GUESSES:
                out.append((start, "guess", end))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(out, key=lambda x: (x[0], order[x[1]], x[2]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: Words | None = None) -> DataFrame:
    """(doc_id, spans: array of (kind, start, end)) for every row of ``docs``; positions in code
    points, end exclusive.  ``words`` defaults to the dictionary of ``docs``.  A null or empty
    text has no spans; null ids and repeated rows stay; other columns are not read; no rows
    give none."""
    ship_package(docs.sparkSession)
    words = words or dictionary(docs, text_col)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch, "text", 8 << 20):
                found = [[{"kind": k, "start": s, "end": e} for s, k, e in find(t.as_py() or "", words)]
                         for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

    return src.mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind, and the spans as text: all of them, and the SHA-256 of the base ones."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return found.select("doc_id", *[number(k).alias(f"n_{k}") for k in KINDS],
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
