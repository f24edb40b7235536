"""Suggestions by automaton and postings against all pairs."""

import random

import numpy as np

from siftline.operators import suggest
from siftline.operators.suggest import _Typed


def plain(typed, text):
    words, have = typed.split(" "), text.split(" ")
    if text.startswith(typed):
        return 1.0
    if typed in text:
        return 0.85
    hit = sum(w in have for w in words[:-1]) + any(h.startswith(words[-1]) for h in have)
    return round(0.6 * hit / len(words), 6) if hit and 2 * hit >= len(words) else 0.0


def test_scores_are_those_of_all_pairs():
    r = random.Random(1)
    words = ["a", "ab", "abc", "b", "ba", "cab", "license", "lost", "of", "কর", "ক"]
    for _ in range(60):
        forms = [" ".join(r.choices(words, k=r.randint(1, 4)))[: r.randint(2, 12)].strip() for _ in range(40)]
        forms = [f for f in forms if len(f) >= 2]
        known = _Typed(forms)
        for text in ["", *(" ".join(r.choices(words, k=r.randint(1, 7))) for _ in range(10))]:
            score = np.zeros(len(forms))
            at, s = known.scores(text)
            score[at] = s
            assert score.tolist() == [plain(f, text) for f in forms]


def test_null_ids_and_similar_texts(spark):
    texts = spark.createDataFrame([(1, "Lost deed", [1.0, 0.0]), (2, "License of land", [0.0, 1.0]), (None, "lost", [1.0, 0.0]), (3, None, [0.9, 0.1]), (4, "lost deed again", None)], "id long, text string, v array<double>")
    typed = spark.createDataFrame([(7, "lost", [0.0, 1.0]), (None, "lost", None), (8, "cense of l", None), (9, "l", [1.0, 0.0]), (10, "xyz", [1.0, 0.0])], "query_id long, typed string, v array<double>")
    got = suggest.suggest(typed, texts).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["id"], round(r["score"], 4)) for r in got] == [(7, 1, 1.0), (7, 4, 1.0), (7, 2, 0.8), (8, 2, 0.85), (10, 1, 0.8), (10, 3, 0.7951)]
    assert suggest.suggest(typed.where("false"), texts).count() == 0 and suggest.suggest(typed, texts.where("false")).count() == 0
