"""Operators against brute force, exact round trips and held-out labels."""

import hashlib
import itertools
import math
import random
import re
import textwrap
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from featurelab.llm import chat, decontaminate, html_text, licenses, mixture, near_dedup, queries, reshard, secret_scan, toxicity
from featurelab.llm.components import components
from tests.conftest import SF_CHECK, SF_SMALL


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text, source FROM '{SF_SMALL}/documents.parquet'").fetchall()


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _shingles(text, k):
    w = _words(text)
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def _roots(ids, edges):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_every_query_is_registered():
    names = {n.split("_")[0] for n in entry.queries() if n.startswith("op")}
    assert names == {f"op{i}" for i in range(1, 14)}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "source_mixture", "sharding"]


def test_licenses_against_sql(spark):
    texts = ["Licensed under the Apache License, Version 2.0 (the License); You may not use this file except in compliance with "
             "the License. You may obtain a copy of the License at\nhttp://x", "Released under the MIT License.\nAll rights reserved.",
             "Licensed under CC BY-NC-SA 4.0.", "the mit license", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [tuple(r) for r in licenses.scan(df).orderBy("doc_id").collect()]
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    assert got == con.sql(licenses.duckdb_sql() + " ORDER BY doc_id").fetchall()
    assert [r[3] for r in got] == ["Apache-2.0", "MIT,all-rights-reserved", "CC-BY-NC-SA-4.0", "", "", ""]


def _best_alignment(item, text):
    """Smith-Waterman over the whole text, cell by cell."""
    best, prev = 0, [0] * (len(text) + 1)
    for w in item:
        cur = [0]
        for j, x in enumerate(text, 1):
            cur.append(max(0, prev[j - 1] + (2 if w == x else -1), prev[j] - 1, cur[-1] - 1))
        best, prev = max(best, max(cur)), cur
    return best


def test_decontamination_against_brute_force(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(400)]
    items = [[rng.choice(vocab) for _ in range(rng.randint(12, 40))] for _ in range(12)]
    texts = []
    for i in range(60):
        body = [rng.choice(vocab) for _ in range(rng.randint(0, 200))]
        if i % 3 == 0:
            copy = list(rng.choice(items))
            for _ in range(rng.randint(0, len(copy) // 6)):
                at = rng.randrange(len(copy))
                copy[at:at + 1] = rng.choice([[], ["new"], [copy[at], "more"]])
            at = rng.randint(0, len(body))
            body[at:at] = copy
        texts.append(body)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(df, bench).collect()}
    want = {(i, j): _best_alignment(item, t) / (2 * len(item)) for i, t in enumerate(texts) for j, item in enumerate(items)}
    want = {k: s for k, s in want.items() if s >= decontaminate.MIN_SCORE}
    assert want and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_html_main_text(spark):
    body = "This is the story of the river and of the people who lived by it for many years. " * 3
    html = (f"<html><head><title>t</title><style>p {{}}</style><script>var a = '<p>no</p>';</script></head><body>"
            f"<nav><ul><li><a href=x>Home</a></li><li><a href=y>About</a></li></ul></nav><article><p>{body}&amp; more</p>"
            f"<p>{body}</p></article><footer><p>Copyright 2020</p></footer></body></html>")
    df = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    want = " ".join((body + "&amp; more", body.strip())).replace("&amp;", "&")
    assert html_text.extract(df).first().text == want


def test_top_k_sql(spark):
    name = "op4_exact_top_k"
    got = [tuple(r) for r in entry.queries()[name](spark, SF_SMALL).select("query_id", "rank", "vec_id", "score").orderBy("query_id", "rank").collect()]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF_SMALL}/embeddings.parquet'")
    assert got == con.sql(f"SELECT query_id, rank, vec_id, score FROM ({entry.oracle_sql()[name]}) ORDER BY 1, 2").fetchall()


def test_min_cost_flow_is_optimal():
    rng = random.Random(3)
    for _ in range(20):
        supply = [rng.randint(0, 3) for _ in range(3)]
        total = sum(supply)
        capacity = reshard.even_capacities(total, 2)
        cost = [[int(i != j) for j in range(2)] for i in range(3)]
        flow = reshard.min_cost_flow(supply, capacity, cost)
        assert [sum(r) for r in flow] == supply
        assert all(sum(r[j] for r in flow) <= capacity[j] for j in range(2))
        paid = sum(flow[i][j] * cost[i][j] for i in range(3) for j in range(2))
        best = min(sum(x * cost[i][0] + (supply[i] - x) * cost[i][1] for i, x in enumerate(xs))
                   for xs in itertools.product(*(range(s + 1) for s in supply)) if sum(xs) == capacity[0])
        assert paid == best


def test_sharding(spark):
    rows = queries.sharding(spark, SF_CHECK).collect()
    docs = dict(duckdb.sql(f"SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 1 FROM '{SF_CHECK}/documents.parquet'").fetchall())
    assert {r.doc_id: r["size"] for r in rows} == docs and len(rows) == len(docs)
    load, slots = Counter(), defaultdict(list)
    for r in rows:
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    mean = sum(load.values()) / 8
    assert len(load) == 8 and all(abs(x - mean) < 0.1 * mean for x in load.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_near_dedup_against_brute_force(spark, docs):
    sets = {d: _shingles(t, 2) for d, t, _ in docs}
    ids = sorted(sets)
    linked = [(a, b) for a, b in itertools.combinations(ids, 2) if sets[a] and sets[b]
              and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    roots = _roots(ids, linked)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.near_dedup(spark, SF_SMALL).collect()}
    assert got == {d: (len(sets[d]), roots[d], roots[d] == d) for d in ids}


def test_large_clusters_are_split(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "TILE_MEMBERS", 5)
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", 7)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(80):
        t = list(base)
        for _ in range(rng.randint(0, 5)):
            t[rng.randrange(len(t))] = f"x{rng.randrange(30)}"
        texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {i: _shingles(t, 2) for i, t in enumerate(texts)}
    linked = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    got = {r.id: r.component_id for r in near_dedup.near_duplicates(df, k=2).collect()}
    assert got == _roots(range(80), linked)


def test_loose_parts_of_large_clusters_meet(spark, monkeypatch):
    # drifting texts: clusters fall into many parts, which only the later steps connect
    monkeypatch.setattr(near_dedup, "TILE_MEMBERS", 4)
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", 9)
    rng = random.Random(11)
    texts = []
    for g in range(4):
        t = [f"g{g % 2}w{i}" for i in range(50)]
        for _ in range(30):
            texts.append(" ".join(t))
            for _ in range(rng.randint(1, 4)):
                t[rng.randrange(len(t))] = f"x{rng.randrange(1000)}"
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {i: _shingles(t, 2) for i, t in enumerate(texts)}
    linked = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    got = {r.id: r.component_id for r in near_dedup.near_duplicates(df, k=2).collect()}
    assert got == _roots(range(len(texts)), linked)


def test_rounds_of_components_write_little(spark, monkeypatch):
    # one table of steps and one of edges per round, in few files however many shuffle partitions
    from featurelab.llm import components as C
    tables = []
    real = C.written

    def recorded(df, name, **how):
        out = real(df, name, **how)
        tables.append((name, len(out.inputFiles())))
        return out

    monkeypatch.setattr(C, "written", recorded)
    conf = {"spark.sql.shuffle.partitions": "300", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    edges = [(i, i + 1) for i in range(2000)] + [(5000, 5000)]
    df = spark.createDataFrame(edges, "a long, b long")
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {r.node: r.root for r in components(df).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert set(got) == {*range(2001), 5000} and len({got[i] for i in range(2001)}) == 1 and got[5000] == 5000
    names = Counter(name for name, _ in tables)
    assert names["labels"] == 1 and names["step"] == names["edges"] and len(tables) == 2 * names["step"] + 2
    assert max(n for _, n in tables) <= 4 * spark.sparkContext.defaultParallelism < 300


def test_small_clusters_need_one_search_for_components(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(near_dedup, "components", lambda edges: calls.append(1) or components(edges))
    t = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, t), (2, t + " x"), (3, t + " y"), (4, "other words here")], "doc_id long, text string")
    got = {r.id: r.component_id for r in near_dedup.near_duplicates(df, k=2).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4} and len(calls) == 1


def test_superminhash_estimates_jaccard():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(30):
        x = rng.integers(0, 2**63, 150, dtype=np.uint64)
        a, b = x[:100], x[50:]
        sig = near_dedup.superminhash(np.concatenate((a, b)), np.repeat([0, 1], 100), 2, 96)
        errors.append((sig[0] == sig[1]).mean() - 1 / 3)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = _roots({x for e in edges for x in e}, edges)
    groups = lambda m: {frozenset(k for k in m if m[k] == r) for r in m.values()}
    assert groups(got) == groups(want)


def test_mixture_targets(spark, docs):
    got = queries.source_mixture(spark, SF_SMALL).collect()
    size = {d: len(_words(t)) for d, t, _ in docs}
    source = {d: s for d, _, s in docs}
    names = sorted({s for s in source.values()}, key=lambda s: (s is None, s or ""))
    sizes = [sum(size[d] for d in size if source[d] == n) for n in names]
    weights = [(3, 1, 2)[i % 3] for i in range(len(names))]
    target, rest, free = [0.0] * len(names), 1.5 * sum(sizes), set(range(len(names)))
    while True:                      # the excess is reshared by weight until none is above
        share = {i: rest * weights[i] / sum(weights[j] for j in free) for i in free}
        full = {i for i in free if share[i] > 2 * sizes[i]}
        for i in (full or free):
            target[i] = 2.0 * sizes[i] if full else share[i]
        if not full:
            break
        rest -= sum(2 * sizes[i] for i in full)
        free -= full
    taken = Counter()
    for r in got:
        i = names.index(source[r.doc_id])
        assert (r["size"], r.source_size) == (size[r.doc_id], sizes[i]) and r.target == pytest.approx(target[i])
        assert r.taken <= 2 * r["size"]
        taken[i] += r.taken
    assert all(abs(taken[i] - target[i]) <= 1 for i in range(len(names)))
    again = queries.source_mixture(spark, SF_SMALL).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_permutation_is_one():
    n = np.full(1000, 1000)
    key = np.full(1000, 77)
    p = mixture.permute(np.arange(1000), n, key)
    assert sorted(p) == list(range(1000)) and list(mixture.permute(p, n, key, inverse=True)) == list(range(1000))


def test_secret_base_spans(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF_CHECK}/documents.parquet'").fetchall()
    got = {r.doc_id: r for r in queries.secrets(spark, SF_CHECK).collect()}
    assign = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)
    for d, t in docs:
        spans = [("assign", m) for m in assign.finditer(t or "") if len(m[1]) >= 12]
        spans += [("access", m) for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 18]
        spans += [("hex", m) for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 16]
        spans.sort(key=lambda s: s[1].start())          # stable: kinds stay in order
        text = ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in spans)
        assert got[d].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        n = Counter(k for k, _ in spans)
        assert (got[d].n_assign, got[d].n_access, got[d].n_hex) == (n["assign"], n["access"], n["hex"])


def test_guess_costs():
    cost = secret_scan.guess_cost
    assert cost("") == 0
    assert max(map(cost, ("password", "P4ssw0rd", "qwertyuiop", "aaaaaaaaaa", "19991231"))) < 8 < cost("vK9#xQ2!mZ")
    assert cost("password1999") < cost("pxsqwvrd1873")
    kinds = [k for _, k, _ in secret_scan.find('password = "vK9#xQ2!mZ$w"; pwd = changeme')]
    assert kinds == ["guess"]


def _exhaustive(value, words):
    """Least cost over all segmentations, from the definition of each kind of segment."""
    log = math.log10

    def segment(a, b):
        part, low, out = value[a:b], value[a:b].lower(), []
        if b - a >= 3 and len(set(part)) == 1:
            out.append(secret_scan._brute(part[0]) + log(b - a))
        if b - a >= 3 and all(p in secret_scan._STEP for p in itertools.pairwise(low)):
            out.append(log(4 * 47 * (b - a)))
        for text, extra in ((low, 0.0), (low.translate(secret_scan._LEET), log(4))):
            if b - a >= 2 and text in words.rank:
                case = 0.0 if part == low else log(2) if part[1:] == low[1:] else log(2 ** (b - a))
                out.append(log(words.rank[text] + 1) + case + extra)
        if secret_scan._DATE.fullmatch(part):
            out.append(log({4: 100, 8: 36500, 10: 36500 * 4}[b - a]))
        return min(out, default=math.inf) + (log(2) if a else 0)

    def least(a):
        if a == len(value):
            return 0.0
        return min([secret_scan._brute(value[a]) + rest[a + 1], *(segment(a, b) + rest[b] for b in range(a + 1, len(value) + 1))])
    rest = {len(value): 0.0}
    for a in range(len(value) - 1, -1, -1):
        rest[a] = least(a)
    return rest[0]


def test_guess_cost_against_all_segmentations():
    rng = random.Random(5)
    words = secret_scan.Words(["hello", "ell", "loo", "required", "aaa", "qwe"])
    parts = ["hello", "hellooo", "P4ss", "word", "qwertz", "asdf", "aaaa", "oo", "1999", "2001-12-31", "19991231", "11111", "x", "Q", "#", "é", "987", "reQuired"]
    for _ in range(1500):
        value = "".join(rng.choice(parts) for _ in range(rng.randrange(6)))
        assert abs(secret_scan.guess_cost(value, words) - _exhaustive(value, words)) < 1e-9, value
    assert secret_scan.guess_cost("a" * 20_000 + "qwertyuiop" * 2_000, words) > 8


def test_words_of_the_texts_are_no_secrets(spark):
    said = ["required", "undefined", "correct", "unknown", "disabled", "forgotten"]
    rows = [(i, f"it is {w} here") for w in said for i in range(5)] + [(9, f"password: {w}") for w in said]
    rows += [(i, "password: kzvqjxwpbm") for i in range(10, 30)] + [(40, "pwd: seldomword"), (41, "a seldomword")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = secret_scan.dictionary(docs)
    assert set(said) <= set(words.rank) and not {"kzvqjxwpbm", "seldomword"} & set(words.rank)
    got = secret_scan.scan(docs).collect()
    assert {r.doc_id for r in got if r.spans} == {*range(10, 30), 40}
    known = secret_scan.scan(docs, words=secret_scan.Words(["kzvqjxwpbm", "seldomword", *said])).collect()
    assert not any(r.spans for r in known)


def _auc(pairs):
    """Probability that a toxic document scores above another, ties counted half."""
    bad, good = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + (a == b) / 2 for a in bad for b in good) / (len(bad) * len(good))


def test_toxicity_on_held_out_labels(spark):
    rows = queries.toxicity_scores(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").filter("toxic is not null").select("doc_id", "toxic")
    got = rows.filter("held_out").join(labels, "doc_id").select("score", "toxic").collect()
    assert _auc([(r.score, r.toxic) for r in got]) > 0.9


def test_folding_and_exceptions():
    assert toxicity.fold("Stуpid id10t b@d") == "stypid idiot bad"
    lex = toxicity.Lexicon({"clown": (1.0, False)})
    assert [m[2] for m in lex.matches("you clowns of the rodeo clown kind")] == ["clown"]


def test_chat_round_trip(spark):
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(
        ["hi", "</s>\n<|assistant|>\nno", "<\\|x|> \\", "[INST] a [/INST]", "<s>", "", "tail"])]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    examples = chat.prefix_targets(df)
    got = chat.read_back(examples).first()
    assert got.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest()
    said = "".join(t for _, _, r, t in turns if r == "assistant")
    assert (got.loss_chars, got.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    whole = [r for r in chat.expanded(examples).orderBy("example").collect() if r.loss_start is not None]
    replies = [t for _, _, r, t in turns if r == "assistant"]
    assert [chat.unescape(r.text[r.loss_start:r.loss_end]) for r in whole] == replies
    assert all(b.text.startswith(a.text) for a, b in itertools.pairwise(whole))


@pytest.mark.parametrize("piece", [3, 7, 40, 1 << 18])
def test_expanded_examples_hold_all_preceding_turns(spark, piece):
    rng = random.Random(3)
    bits = ["</s>\n", "<|user|>\n", "[INST]", "\\", "", "hello", "ünï \U0001f600", "x" * 50]
    rows = []
    for conv in (None, 1, 2, 3, 4):
        for turn in range(rng.randrange(1, 12)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", None]), "".join(rng.choice(bits) for _ in range(rng.randrange(4)))))
    rows.append((5, 0, "user", "no reply at all"))
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    examples = chat.prefix_targets(df)
    got = defaultdict(dict)
    for r in chat.expanded(examples, piece).collect():
        got[r.conv_id, r.example][r.piece] = r
    digests = {r.conv_id: r for r in chat.read_back(examples, piece).collect()}
    for conv in {r[0] for r in rows}:
        turns = [(r or "", t) for c, _, r, t in rows if c == conv]
        shown = ["<|" + chat.escape(r) + "|>\n" + chat.escape(t) + "</s>\n" for r, t in turns]
        ends = [i for i, (r, _) in enumerate(turns) if r == "assistant"]
        want = ["".join(shown[:i + 1]) for i in ends] + (["".join(shown)] if not ends or ends[-1] < len(turns) - 1 else [])
        texts = ["".join(got[conv, e][p].text for p in sorted(got[conv, e])) for e in range(len(want))]
        assert texts == want and (conv, len(want)) not in got
        assert all(len(x.text) <= piece for e in range(len(want)) for x in got[conv, e].values())
        for e, i in enumerate(ends):
            first = got[conv, e][0]
            assert chat.unescape(texts[e][first.loss_start:first.loss_end]) == turns[i][1]
        d, loss = digests[conv], "".join(t for r, t in turns if r == "assistant")
        assert (d.n_turns, d.n_examples, d.formatted_chars) == (len(turns), len(want), sum(map(len, want)))
        assert d.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (d.loss_chars, d.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, SF_SMALL)
    assert set(out.columns) >= {"doc_id", "text", "lang", "source", "n_chars", "shard", "slot", "size"}
    rows = out.collect()
    bad = {r.doc_id for r in decontaminate.contaminated(
        spark.read.parquet(f"{SF_SMALL}/documents.parquet"), spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")).collect()}
    assert rows and not bad & {r.doc_id for r in rows}
    copies = near_dedup.near_duplicates(spark.read.parquet(f"{SF_SMALL}/documents.parquet"))
    group = {r.id: r.component_id for r in copies.collect()}
    assert all(n == 1 for n in Counter(group[d] for d in {r.doc_id for r in rows}).values())


@pytest.mark.parametrize("copies", [0, 5])
def test_decontamination_finds_evenly_edited_copies(spark, copies):
    rng = random.Random(2)
    items, texts, want = [], [], set()
    for size in (20, 50, 100):
        for step in (3, 4, 5, 6, "words put between"):
            item = [f"i{len(items)}x{rng.randrange(1000)}" for _ in range(size)]
            if step == "words put between":
                edited = [x for w in item for x in (w, "new")]
            else:
                edited = [f"new{i}" if i % step == step - 1 else w for i, w in enumerate(item)]
            for text in [edited, *[item] * copies]:
                want.add((len(texts), len(items)))
                texts.append([f"a{rng.randrange(300)}" for _ in range(40)] + text + [f"b{rng.randrange(300)}" for _ in range(40)])
            items.append(item)
    texts += [[rng.choice(["a1", "b1", *items[0]]) for _ in range(100)] for _ in range(20)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(df, bench).collect()}
    scores = {(i, j): _best_alignment(item, t) / (2 * len(item)) for i, t in enumerate(texts) for j, item in enumerate(items)}
    assert want <= got.keys() and got == pytest.approx({k: s for k, s in scores.items() if s >= decontaminate.MIN_SCORE})


MIT = ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation '
       'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
       'modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software '
       'is furnished to do so, subject to the following conditions:',
       'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.')
BSD2 = ('Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following '
        'conditions are met:',
        '1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.',
        '2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following '
        'disclaimer in the documentation and/or other materials provided with the distribution.')
BSD3 = (*BSD2, '3. Neither the name of Acme 3D Inc. nor the names of its contributors may be used to endorse or promote products derived '
        'from this software without specific prior written permission.')
ADS = '3. All advertising materials mentioning features or use of this software must display the following acknowledgement: by Acme.'
GPL = ('This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as '
       'published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.',
       'This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of '
       'MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.')
APACHE = ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
          'License. You may obtain a copy of the License at', 'http://www.apache.org/licenses/LICENSE-2.0')


def test_licenses_wrapped_over_lines(spark):
    cases = [(MIT, "MIT"), (BSD2, "BSD-2-Clause"), (BSD3, "BSD-3-Clause"), ((*BSD2, ADS, BSD3[3].replace("3.", "4.", 1)), "BSD-4-Clause"),
             (GPL, "GPL-3-or-later"), (APACHE, "Apache-2.0"), (("This Source Code Form is subject to the terms of the Mozilla Public "
                                                                "License, v. 2.0.",), "MPL-2.0"),
             (("Licensed under the MIT License", "and something else"), "MIT"), (("Licensed under the", "", "MIT License"), "")]
    texts, want = [], []
    for paragraphs, licence in cases:
        for width in (30, 72, 2000):
            for mark, end in (("", "\n"), (" * ", "\n"), ("// ", "\r\n")):
                lines = [line for p in ("Some Title", *paragraphs) for line in (*(textwrap.wrap(p, width) or [""]), "")]
                texts.append(end.join((mark + line).rstrip(" ") for line in lines))
                want.append(licence)
    texts += ["Licensed under the MIT License\nAll rights reserved", "Licensed under the\nMIT License\nLicensed under the GNU General\nPublic License, version 2"]
    want += ["MIT,all-rights-reserved", "MIT,GPL-2"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.licenses for r in licenses.scan(df).orderBy("doc_id").collect()]
    assert got == want


LINKS = "<div><a href=x>Home page</a> <a href=y>All the news</a></div>"
ENGLISH = "This is the story of the river and of the people who lived by it for many years."
RUSSIAN = "Это история реки и людей, которые много лет жили на её берегах и ловили рыбу."
POLISH = "Dawno temu nad wielką rzeką mieszkali ludzie, którzy łowili ryby oraz budowali drewniane domy."
CHINESE = "这是关于河流和多年来居住在河边的人们的故事，他们在那里捕鱼和建造房屋。"


@pytest.mark.parametrize("paragraphs", [
    [ENGLISH, "A short end."], ["A short start.", ENGLISH], ["All is short.", "And so is this."], [RUSSIAN] * 3, [POLISH] * 3,
    [CHINESE] * 3, [RUSSIAN, "Конец."], [RUSSIAN, ENGLISH, RUSSIAN], [POLISH, POLISH, ENGLISH], [ENGLISH, CHINESE]])
def test_html_without_article_loses_no_text(paragraphs):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    want = " ".join(paragraphs)
    assert html_text.main_text(f"<html><body>{body}<footer><p>Copyright 2020</p></footer></body></html>") == want
    if "All is short." in paragraphs or min(map(len, paragraphs)) > 20:
        assert html_text.main_text(f"<body>{LINKS}{body}{LINKS}</body>") == want


def test_html_without_article_still_drops_lists_and_links():
    junk = "<div>red green blue yellow black white pink brown orange violet</div>"
    page = f"<body>{LINKS}<p>Menu</p>{LINKS}<p>{ENGLISH}</p><p>{ENGLISH}</p>{junk}<h2>More</h2>{LINKS}</body>"
    assert html_text.main_text(page) == f"{ENGLISH} {ENGLISH}"
