"""Texts of two halves, whose languages each gain less than a switch over a third language."""

import numpy as np
import pytest
from data import SCHEMA
from pyspark.sql import functions as F
from test_models import brute_path

from evalloom.llm import language_id as lid


def test_two_halves_beat_a_third_language():
    score = np.array([[0, -6, -2.75]] * 4 + [[-6, 0, -2.75]] * 4)
    (path,) = lid.viterbi([score], 12.0)
    assert path.tolist() == [0] * 4 + [1] * 4


@pytest.mark.parametrize("seed", range(20))
def test_paths_against_all_at_costly_switches(seed):
    rng = np.random.default_rng(seed)
    s = np.round(np.maximum(rng.normal(-2, 2, (7, 3)), -6), 3)
    (path,) = lid.viterbi([s], 5.0)
    value = sum(s[i, p] for i, p in enumerate(path)) - 5.0 * sum(a != b for a, b in zip(path, path[1:]))
    assert value == pytest.approx(brute_path(s, 5.0))


def plain_viterbi(score, switch):
    """Value of the best path, by the textbook recurrence."""
    total = score[0].copy()
    for row in score[1:]:
        total = np.maximum(total, total.max() - switch) + row
    return total.max()


def test_many_random_texts_against_a_plain_dynamic_program():
    rng = np.random.default_rng(3)
    for switch in (1.5, 6.0, 12.0):
        texts = []
        for _ in range(1500):
            n, k = int(rng.integers(1, 61)), 4
            score = rng.normal(-2, 2, (n, k))
            for a in range(0, n, max(1, n // int(rng.integers(1, 5)))):  # stretches that favour one language
                score[a : a + n // 3 + 1, rng.integers(k)] += rng.uniform(0, 3)
            score -= score.max(axis=1, keepdims=True)
            texts.append(np.maximum(score, -6))
        for score, path in zip(texts, lid.viterbi(texts, switch)):
            value = score[np.arange(len(path)), path].sum() - switch * (np.diff(path) != 0).sum()
            assert value == pytest.approx(plain_viterbi(score, switch))


def test_of_too_many_languages_the_most_frequent_are_learned(spark):
    """A dirty column of 300 values, of which a few are frequent."""
    rows = [(i, f"text number {i} here", f"l{i}", "s", 14, 1, "w", 2, "r") for i in range(300)]
    rows += [(1000 + i, "often said words of one kind", "zz", "s", 14, 1, "w", 2, "r") for i in range(40)]
    model = lid.fit_languages(spark.createDataFrame(rows, SCHEMA), F.lit(True))
    assert len(model.languages) == 256 and "zz" in model.languages
    assert set(model.languages) - {"zz"} == set(sorted(f"l{i}" for i in range(300))[:255])
    found = lid.language_id(spark.createDataFrame(rows[-1:], SCHEMA), F.lit(True)).collect()
    assert [r["lang_pred"] for r in found] == ["zz"]


def test_rows_of_one_id_count_once_in_the_sample(spark):
    """One id with nearly all rows of a language: the bound holds, and the other ids are learned from."""
    rows = [(7, "same same same same", "aa", "s", 14, 1, "w", 2, "r")] * 400 + [(100 + i, "kwik fjord vex", "aa", "s", 14, 1, "w", 2, "r") for i in range(30)]
    rows += [(200 + i, "lorem dolor amet", "bb", "s", 14, 1, "w", 2, "r") for i in range(30)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = lid.fit_languages(docs, F.lit(True), per_language=2_000)
    once = lid.fit_languages(docs.dropDuplicates(["doc_id"]), F.lit(True), per_language=2_000)
    assert model.languages == once.languages == ("aa", "bb") and (model.logs == once.logs).all()
