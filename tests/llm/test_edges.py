"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for
every operator of the subpackage."""

import pytest
from pyspark.sql import functions as F

from featurelab.llm import chat, decontaminate, html_text, licenses, mixture, near_dedup, reshard, secret_scan, topk, toxicity

LONG = "lorem ipsum dolor sit amet consectetur " * 20_000
CLASH = "size long, shard string, slot int, moved int, score double, text_hash string, runs int, mix_row int, lang string"
SCHEMA = f"doc_id long, text string, source string, n_chars long, {CLASH}"


def _row(i, text, source):
    return (i, text, source, None if text is None else len(text), 1, "s", 2, 3, 0.5, "h", 4, 5, None)


ROWS = [_row(1, None, "a"), _row(2, "", "a"), _row(3, " \t\n", None), _row(4, "one", "b"), _row(5, "same words here and there", "b"),
        _row(6, "same words here and there", "a"), _row(6, "same words here and there", "a"), _row(None, "no id at all here", "b"),
        _row(7, LONG, "hot"), _row(8, "ünï çödé \U0001f600 text", None)]


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "same words here and there"), (2, None), (3, "")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1), (5, 0), (None, 1), (6, None)], "doc_id long, toxic int")


def _empty(df):
    return df.limit(0)


def test_licenses(messy):
    assert licenses.scan(messy).count() == len(ROWS)
    assert licenses.scan(_empty(messy)).count() == 0


def test_near_duplicates(messy):
    got = {(r.id, r.n_shingles): (r.component_id, r.kept) for r in near_dedup.near_duplicates(messy, k=2).collect()}
    assert got[(1, 0)] == (1, True) and got[(2, 0)] == (2, True) and got[(3, 0)] == (3, True)
    assert got[(5, 4)] == (5, True) and got[(6, 4)] == (5, False)
    assert got[(None, 4)] == (None, True)
    assert near_dedup.near_duplicates(_empty(messy)).count() == 0
    left = near_dedup.drop_near_duplicates(messy)
    assert left.columns == messy.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(["1", "2", "3", "4", "5", "None", "7", "8"])


def test_decontamination(messy, bench):
    assert sorted(r.doc_id for r in decontaminate.contaminated(messy, bench).collect()) == [5, 6, 6]
    left = decontaminate.drop_contaminated(messy, bench)
    assert left.columns == messy.columns and left.count() == len(ROWS) - 3
    assert decontaminate.contaminated(messy, _empty(bench)).count() == 0
    assert decontaminate.drop_contaminated(messy, _empty(bench)).count() == len(ROWS)
    assert decontaminate.contaminated(_empty(messy), bench).count() == 0


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, "u", ""), (None, None, "<p>" + "this is the text of it. " * 9),
                                   (3, "u", "<p><b><div" * 500)], "page_id long, url string, html string")
    got = html_text.extract(pages).collect()
    assert len(got) == 4 and all(r.text is not None for r in got)
    assert {r.page_id: r.text for r in got}[1] == ""
    assert html_text.extract(_empty(pages)).count() == 0


def test_top_k(spark):
    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (None, [1.0, 1.0]),
            (4, [float("inf"), 0.0]), (5, [0.5, 0.5]), (6, [0.5, 0.5])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(v, F.col("vec_id") == 0).orderBy("rank").collect()]
    score = 256 * 128 + 128 * 128
    assert got == [(0, 1, 5, score), (0, 2, 6, score)]
    assert topk.top_k(_empty(v), F.col("vec_id") == 0).count() == 0


def test_reshard(messy):
    out = reshard.reshard(messy, F.lit(0), 3)
    assert out.columns == [*messy.columns, "size_1", "shard_1", "slot_1", "moved_1"]
    got = out.collect()
    assert len(got) == len(ROWS)
    assert sorted(r.size_1 for r in got) == sorted(len((r[1] or "").encode()) + 1 for r in ROWS)
    for s in {r.shard_1 for r in got}:
        assert sorted(r.slot_1 for r in got if r.shard_1 == s) == list(range(sum(r.shard_1 == s for r in got)))
    assert reshard.reshard(_empty(messy), F.lit(0), 3).count() == 0


def test_mixture(messy):
    got = mixture.mix_words(messy).collect()
    assert len(got) == len(ROWS)
    assert all(r.taken <= 2 * r["size"] for r in got)
    out = mixture.mix_documents(messy)
    assert out.columns == messy.columns
    rows = out.collect()
    assert sum(len(r.text.split()) for r in rows) == sum(r.taken for r in got)
    assert all(r.n_chars == len(r.text) for r in rows)
    assert mixture.mix_words(_empty(messy)).count() == 0
    assert mixture.mix_documents(_empty(messy)).count() == 0


def test_secrets(messy):
    got = secret_scan.digest(secret_scan.scan(messy))
    assert got.count() == len(ROWS) and got.filter("spans != ''").count() == 0
    assert secret_scan.scan(_empty(messy)).count() == 0


def test_toxicity(messy, labels):
    model = toxicity.fit(messy, labels)
    got = toxicity.score(messy, model)
    assert got.columns == [*messy.columns, "score_1"]
    assert all(0 <= r.score_1 <= 1 for r in got.collect())
    nothing = toxicity.fit(messy, _empty(labels))
    assert toxicity.drop_toxic(messy, _empty(labels)).columns == messy.columns
    assert nothing.score(None) == nothing.score("") < 0.5
    assert toxicity.score(_empty(messy), model).count() == 0


def test_chat(spark):
    rows = [(1, 0, None, None), (1, None, "user", "a"), (1, 2, "assistant", ""), (None, 0, "assistant", "x"),
            (2, 0, "user", "only"), (2, 0, "user", "only")]
    c = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.prefix_targets(c)).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[None].loss_chars, got[2].n_turns) == (3, 0, 1, 2)
    assert chat.read_back(chat.prefix_targets(_empty(c))).count() == 0
