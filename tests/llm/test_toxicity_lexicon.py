"""The lexicon and its matches against plain counting and searching."""

import random
from collections import Counter

import pytest

from featurelab.llm import toxicity


def _naive_matches(lex, text):
    """At each word beginning the longest entry, none inside an exception phrase."""
    def ends(at):
        return at == len(text) or not text[at].isalpha()

    starts = [i for i in range(len(text)) if text[i].isalpha() and (i == 0 or not text[i - 1].isalpha())]
    shields = [(i, i + len(e)) for e in lex.exceptions for i in starts if text.startswith(e, i) and ends(i + len(e))]
    out = []
    for i in starts:
        found = [e for e, (_, whole) in lex.entries.items() if text.startswith(e, i) and (not whole or ends(i + len(e)))]
        if found:
            best = max(found, key=len)
            if not any(a <= i and i + len(best) <= b for a, b in shields):
                out.append((i, i + len(best), best))
    return out


def test_matches_against_naive_search():
    rng = random.Random(3)
    words = ["clown", "clowns", "trash", "can", "cans", "rodeo", "ass", "asset", "idiot", "idiotic", "he", "the", "a", "b"]
    lex = toxicity.Lexicon({"clow": (1.0, False), "trash": (2.0, True), "ass": (3.0, True), "idiot": (1.0, False),
                            "idiotic": (2.0, True), "he": (0.5, True), "can": (1.0, True)})
    for _ in range(500):
        text = "".join(rng.choice(words) + rng.choice([" ", "  ", ""]) for _ in range(rng.randint(0, 12)))
        assert lex.matches(text) == _naive_matches(lex, text), text


@pytest.mark.parametrize("word", ["zog", "qx", "grolf"])
def test_short_words_are_learned(spark, word):
    texts = [(i, f"we all went home at {i} and {word if i % 2 else 'then'} it was late") for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert model.score(f"oh {word} again") > 0.5 > model.score("oh no again")
    assert model.score(f"oh {word}s again") < 0.5 or len(word) >= toxicity.SHORTEST


@pytest.mark.parametrize("counted", [10, 500_000])
def test_lexicon_against_plain_counts(spark, monkeypatch, counted):
    """All entries that pass, however many there are: more words than any earlier bound."""
    monkeypatch.setattr(toxicity, "COUNTED", counted)
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    rows = []
    for i in range(300):
        label = int(rng.random() < 0.4)
        share = vocabulary[:250] if label else vocabulary[150:]
        rows.append((" ".join(rng.choice(share) for _ in range(30)), label))
    bad, good = sum(y for _, y in rows), sum(1 - y for _, y in rows)
    n1, n0 = Counter(), Counter()
    for text, label in rows:
        entries = set()
        for w in set(text.split()):
            entries |= {w + " "} if len(w) > 1 else set()
            entries |= {w[:k] for k in range(4, min(len(w), 9) + 1)}
        (n1 if label else n0).update(entries)
    passed = {e for e in n1 if n1[e] >= 4 and n1[e] >= 0.8 * (n1[e] + n0[e] + 1)
              and n1[e] / bad / (n1[e] / bad + n0[e] / good + 1 / good) >= 0.8}
    want = {(e.rstrip(), e.endswith(" ")) for e in passed
            if not any(e[:k] in passed for k in range(4, len(e.rstrip()) + 1) if e[:k] != e)}
    lex = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, label int").repartition(3))
    assert {(e, whole) for e, (_, whole) in lex.entries.items()} == want and len(want) > 50
