"""The toxicity operator against counting and matching without an automaton."""

import math
import random
import time
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("homerank.llm")
from homerank.llm import toxicity  # noqa: E402

WORDS = ["fool", "f00l", "fоol", "proof", "good", "day", "idiots", "idiotic", "1d10t", "the", "a", "of", "l|ar", "liar", "", "É"]


def brute_features(lexicon, text):
    folded = toxicity.fold(text or "")
    hits = {}
    for i in range(len(folded)):
        for term, weight in lexicon.terms.items():
            if folded.startswith(term, i):
                hits[i] = max(weight, hits.get(i, 0.0))
    inside = set()
    for phrase in map(toxicity.fold, lexicon.exceptions):
        for i in range(len(folded)):
            if folded.startswith(phrase, i):
                inside.update(range(i, i + len(phrase) - 1))
    kept = [w for i, w in hits.items() if i not in inside]
    return (max(kept), math.log1p(sum(kept)), math.log1p(100 * sum(kept) / len(folded))) if kept else (0.0, 0.0, 0.0)


def test_matching_equals_brute_force():
    rnd = random.Random(3)
    lexicon = toxicity.Lexicon({" fooi ": 4.0, " idio": 3.5, " idiot": 5.0, " iiar ": 3.0}, ["fool proof", "good liar of", "proof of fool"])
    matcher = toxicity.Matcher(lexicon)
    for _ in range(600):
        text = rnd.choice([" ", "-", "  "]).join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 25)))
        assert np.allclose(matcher.features(text), brute_features(lexicon, text)), text
    assert matcher.features(None) == (0.0, 0.0, 0.0)


def test_many_exceptions_take_linear_time():
    matcher = toxicity.Matcher(toxicity.Lexicon({" fooi ": 4.0}, ["fool proof"]))
    start = time.process_time()
    assert matcher.hits(toxicity.fold("fool proof " * 200_000)) == {}
    assert time.process_time() - start < 5


def test_learning_and_scores_equal_brute_force(spark):
    """Terms, weights, exceptions and scores, recounted text by text; two labels for one id, null labels and texts, labels without a text."""
    rnd = random.Random(8)
    clean = [" ".join(rnd.choice(["good", "day", "fool proof", "of", "the", "house"]) for _ in range(8)) for _ in range(60)]
    bad = [" ".join(rnd.choice(["you", "fool", "1d10t", "idiotic", "the", "of"]) for _ in range(8)) for _ in range(40)]
    texts = {i: t for i, t in enumerate([*clean, *bad])} | {200: None, 201: ""}
    label = {i: int(i >= 60) for i in range(100)} | {200: 0, 201: 0}
    rows = [(i, x) for i, x in label.items()] + [(70, 0), (5, None), (999, 1)]
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    lexicon = toxicity.learn(docs, spark.createDataFrame(rows, "doc_id bigint, toxic int"))
    counts = Counter(), Counter()
    for i, x in label.items():
        counts[x].update(toxicity._terms_of(toxicity.fold(texts[i] or "")))
    n = [sum(x == k for x in label.values()) for k in (0, 1)]
    want = {t: math.log((c + 0.5) / (n[1] + 1)) - math.log((counts[0][t] + 0.5) / (n[0] + 1)) for t, c in counts[1].items() if c >= toxicity.LEAST_TEXTS}
    want = {t: w for t, w in want.items() if w >= toxicity.LEAST_WEIGHT}
    assert want and set(lexicon.terms) == set(want) and all(math.isclose(lexicon.terms[t], w) for t, w in want.items())
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in toxicity.score_documents(docs, lexicon).collect()}
    for i, t in texts.items():
        score = 1 / (1 + math.exp(-(lexicon.scale[0] + np.dot(lexicon.scale[1:], brute_features(lexicon, t)))))
        assert math.isclose(got[i][0], score, rel_tol=1e-9) and got[i][1] == int(score >= 0.5)
    assert sum(got[i][1] == x for i, x in label.items()) >= 100
