"""Whitening, exact deduplication and periodic runs against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from featurelab.llm import exact_dedup, mixture, periodic_runs, queries, quotient_filter, whitening
from featurelab.llm.hot import join_classes
from tests.conftest import SF_SMALL

CLASH = "part int, parts string, k1 int, f string, digest int, row int, word int, bits int, routed int, norm int, z int, dim string"


# ---- whitening

def _vectors():
    rng = np.random.default_rng(3)
    base = (rng.normal(size=(60, 10)) @ rng.normal(size=(10, 10)) + 5).astype(np.float32)
    rows = [(i, [float(x) for x in base[i % 60]]) for i in range(150)]
    rows += [(1000 + i, [float(x) for x in base[7]]) for i in range(90)]       # a vector with a third of all rows
    return rows


@pytest.mark.parametrize("weights", ["count", "one"])
def test_whitening_against_numpy(spark, weights):
    rows = _vectors()
    bad = [(2000, None), (2001, [1.0] * 9 + [None]), (2002, [float("nan")] * 10), (2003, [float("inf")] + [0.0] * 9)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    got = whitening.whiten(df, weights=weights).toPandas()
    x = np.array([[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v in rows], dtype=object)
    fit = x if weights == "count" else np.array(sorted({tuple(r) for r in x}), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    c = ((fit * n - s) / n).astype(float)
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    z = ((x * n - s) / n).astype(float) @ u[:, :8] / np.sqrt(e[:8])
    assert len(got) == len(rows) * 8 and set(got.n) == {n} and set(got.component) == set(range(1, 9))
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    row = {i: k for k, (i, _) in enumerate(rows)}
    for comp, part in got.groupby("component"):
        want = z[[row[i] for i in part.vec_id], comp - 1]
        sign = np.sign(want @ part.whitened)
        assert np.abs(part.whitened - sign * want).max() < 1e-8
        assert abs(part.explained.iloc[0] / (e[comp - 1] / e.sum()) - 1) < 1e-9
        assert [int(d) for d in part.deviation] == [sum((n * a - b) ** 2 for a, b in zip(x[row[i]], s)) for i in part.vec_id]


def test_whitening_edges(spark):
    kind = f"vec_id long, embedding array<double>, {CLASH}"
    pad = (None,) * len(CLASH.split(","))
    make = lambda rows: spark.createDataFrame([(i, v, *pad) for i, v in rows], kind)
    assert whitening.whiten(make([])).count() == 0
    assert whitening.whiten(make([(1, []), (2, None)])).count() == 0
    equal = whitening.whiten(make([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])])).collect()
    assert len(equal) == 6 and all(r.whitened is None and r.deviation == 0 and r.explained == 0 and r.identity_error is None for r in equal)
    mixed = whitening.whiten(make([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, 1.0]), (3, [1.0]), (4, [2.0]), (5, [4.0])])).collect()
    assert sorted((r.vec_id, r.component, r.n) for r in mixed) == [(1, 1, 3), (1, 1, 3), (1, 2, 3), (1, 2, 3), (2, 1, 3), (2, 2, 3),
                                                                   (3, 1, 3), (4, 1, 3), (5, 1, 3)]
    huge = whitening.whiten(make([(1, [1e300, -1e300]), (2, [0.0, 3e38]), (3, [5.0, 1.0])])).collect()
    top = 2**52
    x = [[top + 100_000, 100_000 - top], [100_000, top + 100_000], [105_120, 101_024]]
    s = [sum(c) for c in zip(*x)]
    assert {r.vec_id: int(r.deviation) for r in huge} == {i + 1: sum((3 * a - b) ** 2 for a, b in zip(v, s)) for i, v in enumerate(x)}
    long = whitening.whiten(make([(i, [float((i * j) % 7) for j in range(1500)]) for i in range(9)])).collect()
    assert len(long) == 72
    with pytest.raises(ValueError):
        whitening.whiten(make([(1, [0.0] * (whitening.MAX_DIM + 1))]))


# ---- exact deduplication

def test_quotient_filter_round_trip():
    rng = np.random.default_rng(5)
    for s in (0, 3, 9):
        for n in (1, 2, 50, 5000):
            f = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            if s:
                f = np.unique(f >> np.uint64(s) | np.uint64(3) << np.uint64(64 - s))
            c = rng.choice([1, 1, 2, 3, 70, 2**33, 2**62], len(f)).astype(np.int64)
            got = quotient_filter.decode(quotient_filter.encode(f, c, s))
            assert (got[0] == f).all() and (got[1] == c).all()
    near = np.array([0, 1, 2, 2**64 - 1, 2**64 - 2, 2**63], np.uint64)
    f, c = quotient_filter.tally(near)
    assert (quotient_filter.decode(quotient_filter.encode(f, c, 0))[0] == np.sort(near)).all()


def test_quotient_filters_merge_without_loss():
    rng = np.random.default_rng(6)
    parts = [rng.integers(0, 2**64, 300, dtype=np.uint64) // np.uint64(2**55) * np.uint64(2**55) for _ in range(9)]
    merged = quotient_filter.merge([quotient_filter.encode(*quotient_filter.tally(p), 0) for p in parts])
    f, c = np.unique(np.concatenate(parts), return_counts=True)
    assert (merged[0] == f).all() and (merged[1] == c).all()


def _brute_copies(rows):
    groups = defaultdict(list)
    for at, (i, t) in enumerate(rows):
        groups[re.sub("[ \t-\r]", "", t or "")].append((-len(t or ""), i is None, i, at))
    out = []
    for norm, members in groups.items():
        members.sort(key=lambda m: (m[0], m[1], m[2] or 0))
        for m in members:
            out.append((m[2], members[0][2], len(members), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def _copy_rows():
    rnd = random.Random(8)
    texts = ["a b", "ab", "a\tb ", "a\x0bb\x0c\r\n", "a\u00a0b", "AB", "", " \n", None, "x" * 300_000, "x " * 300_000, "\U0001f600 z", "\U0001f600z"]
    rows = [(i, rnd.choice(texts)) for i in range(300)] + [(1000 + i, "hot text ") for i in range(200)]
    return rows + [(5000 + i, f"single {i}") for i in range(100)] + [(None, "ab"), (None, "null id alone"), (7, "a b"), (7, "a b")]


def _got(df):
    rows = df.collect()
    kept = defaultdict(int)
    for r in rows:
        kept[r.digest] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.digest) for r in rows), key=str), set(kept.values())


def test_copies_against_brute_force(spark):
    rows = _copy_rows()
    pad = (None,) * len(CLASH.split(","))
    df = spark.createDataFrame([(*r, *pad) for r in rows], f"doc_id long, text string, {CLASH}").repartition(7)
    got, kept = _got(exact_dedup.copies(df))
    assert got == _brute_copies(rows) and kept == {1}
    left = exact_dedup.drop_copies(df)
    assert left.columns == df.columns
    want = {g[1:] for g in _brute_copies(rows)}
    assert left.count() == len(want)
    assert exact_dedup.copies(df.limit(0)).count() == 0 and exact_dedup.drop_copies(df.limit(0)).count() == 0


def test_copies_are_verified_by_their_bytes(spark):
    """Fingerprints and digests of very few values: only the bytes tell the texts apart."""
    rows = _copy_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    weak = exact_dedup.copies(df, fingerprint=lambda c: F.pmod(F.xxhash64(c), F.lit(5)), digest=lambda c: F.length(c).cast("string"))
    got = sorted(((r.doc_id, r.keep_id, r.group_size) for r in weak.collect()), key=str)
    assert got == sorted((b[:3] for b in _brute_copies(rows)), key=str)
    assert weak.filter("kept").count() == len({b[3] for b in _brute_copies(rows)})


def test_hot_classes_are_dealt_out(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") < 2000, 0).otherwise(F.col("id")).alias("k"))
    classes = rows.groupBy("k").agg(F.count("*").alias("n"))
    out = join_classes(rows, classes, ["k"], "n", 5000, F.col("id"))
    assert out.columns == ["k", "id", "n"] and out.count() == 5000
    assert {r.k: r.n for r in out.select("k", "n").distinct().collect()} == {r.k: r.n for r in classes.collect()}


# ---- periodic runs

def _brute_runs(w):
    n, out = len(w), set()
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i - s + q
            if length >= max(24, 3 * q) and all(any(w[j] != w[j + r] for j in range(s, s + length - r)) for r in range(1, q)):
                out.add((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _periodic(rnd):
    w = []
    for _ in range(rnd.randint(0, 4)):
        base = [rnd.choice("ab" if rnd.random() < .5 else "abcdefgh") for _ in range(rnd.choice([1, 2, 3, 5, 8, 9, 11, 12, 13, 17, 30, 47]))]
        if rnd.random() < .3:
            base = base * 2 + base[:1]
        m = rnd.randint(1, rnd.choice([3, 4, 8]) * len(base))
        w += (base * 10)[:m] if rnd.random() < .8 else [rnd.choice("abcdefghijk") for _ in range(m)]
    return w


def test_runs_against_brute_force():
    rnd, found = random.Random(1), 0
    for _ in range(300):
        texts = [_periodic(rnd) for _ in range(rnd.randint(1, 6))]
        got = periodic_runs.runs_of(pa.array([rnd.choice([" ", "\n", " \t "]).join(w) for w in texts]))[2]
        want = [_brute_runs(w) for w in texts]
        assert got == want
        found += sum(map(len, want))
    assert found > 300


def test_runs_of_highly_repetitive_words():
    a, b = ["a"], ["a", "b"]
    while len(b) < 700:
        a, b = b, b + a
    tm = ["a"]
    while len(tm) < 256:
        tm = tm + ["b" if x == "a" else "a" for x in tm]
    for w in (b[:700], tm + tm + tm + tm[:99], ["x"] * 500, ["x", "y"] * 300 + ["x"] * 90, list("aab" * 8 + "aabaab" * 9 + "c") * 4):
        assert periodic_runs.runs_of(pa.array([" ".join(w)]))[2][0] == _brute_runs(w)


def test_run_query_against_brute_force(spark):
    """The registered query on whole texts, with its looped tenth of the documents."""
    con = duckdb.connect()
    docs = con.execute(f"SELECT doc_id, text FROM '{SF_SMALL}/documents.parquet'").fetchall()
    got = {r.doc_id: r for r in queries.period_runs(spark, SF_SMALL).collect()}
    assert len(got) == len(docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    looped = 0
    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(i).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
            looped += 1
        if n > 4000:
            continue
        runs = _brute_runs(w)
        dropped = {k for s, length, q in runs for k in range(s + q, s + length)}
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        r = got[i]
        assert (r.n_runs, r.runs_sha256) == (len(runs), sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)))
        assert r.collapsed_sha256 == sha(" ".join(x for k, x in enumerate(w) if k not in dropped))
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
    assert looped > 5


def test_run_edges(spark):
    pad = (None,) * len(CLASH.split(","))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (None, "b c " * 40), (5, "w " * 400_000), (6, "A a " * 12), (6, "A a " * 12)]
    df = spark.createDataFrame([(*r, *pad) for r in rows], f"doc_id long, text string, {CLASH}")
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.find_runs(df).collect()]
    assert sorted(got, key=str) == sorted([
        (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 1, [], "a"), (None, 80, [(0, 80, 2)], "b c"),
        (5, 400_000, [(0, 400_000, 1)], "w"), (6, 24, [(0, 24, 2)], "A a"), (6, 24, [(0, 24, 2)], "A a")], key=str)
    assert periodic_runs.find_runs(df.limit(0)).count() == 0
    looped = {r.doc_id: r.text for r in queries.looped(df.select("doc_id", "text")).collect()}
    assert looped[None] == "b c " * 40 and looped[1] is None


# ---- mixing: reruns agree however the input is partitioned

def test_mix_does_not_depend_on_partitioning(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "source")
    docs = docs.unionByName(docs.filter("doc_id % 3 = 0")).unionByName(docs.filter("doc_id = 5"))
    runs = [sorted(map(tuple, mixture.mix_words(d).collect()), key=str) for d in (docs, docs.repartition(1), docs.repartition(13, "source"))]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == docs.count()
