"""Language-model scores against plain counting, a direct softmax and held-out likelihood."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from fleetpulse.llm import bilinear_lm

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, 1, 0.5, "k") for i, t in zip(ids, texts, strict=True)]
    schema = "doc_id long, text string, n_tokens long, score double, key string"
    return spark.createDataFrame(rows, schema).repartition(3)


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + [None]


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def base_scores(texts, ids):
    """doc_id, held_out, n_tokens, n_known, N and base score, counted plainly."""
    counts = Counter()
    for i, text in zip(ids, texts, strict=True):
        if not held_out(i):
            counts.update(tokens(text))
    total, types = sum(counts.values()), len(counts)
    made = []
    for i, text in zip(ids, texts, strict=True):
        line = tokens(text)
        known = sum(counts[t] > 0 for t in line)
        score = sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (types + 1))) for t in line)
        made.append((i, held_out(i), len(line), known, total, score))
    return made


def same(found, wanted):
    def order(row):
        return repr(row[:5]), row[5]

    found, wanted = sorted(found, key=order), sorted(wanted, key=order)
    assert [r[:5] for r in found] == [r[:5] for r in wanted]
    assert [r[5] for r in found] == pytest.approx([r[5] for r in wanted], abs=1e-9)


ODD = [None, "", " \t", "One two\x1cthree", "É é İ K", "x" * 40 + " " + "x" * 41, "x" * 40, "one ONE One.",
       "日本 語\x0b日本", "a\x00b \x00", "word " * 40_000, "one two", "one two", "😀 two"]


@pytest.mark.parametrize("head", [4, 2**17])
def test_base_scores_equal_plain_counting(spark, head):
    ids = [*range(len(ODD) - 2), 3, None]
    rows = bilinear_lm.scores(frame(spark, ODD, ids), head=head, classes=3, rounds=1).collect()
    same([tuple(r)[:6] for r in rows], base_scores(ODD, ids))
    assert all(math.isfinite(r.score) and r.score <= 0 for r in rows)


def test_long_texts_in_chunks_equal_whole_ones(spark, monkeypatch):
    pick = random.Random(5)
    texts = [" ".join(pick.choice("a bb ccc dddd".split()) for _ in range(300)) for _ in range(30)]
    whole = bilinear_lm.scores(frame(spark, texts), rounds=1).collect()
    split = [[k for keys in bilinear_lm.chunks(t) for k in keys] for t in texts]
    monkeypatch.setattr(bilinear_lm, "_CHUNK", 50)
    assert [[k for keys in bilinear_lm.chunks(t) for k in keys] for t in texts] == split
    assert len(list(bilinear_lm.chunks(texts[0]))) > 5
    same([tuple(r)[:6] for r in whole], base_scores(texts, range(30)))


def test_empty_tables_and_tables_without_teaching_rows(spark):
    assert bilinear_lm.scores(frame(spark, [])).collect() == []
    alone = next(i for i in range(100) if held_out(i))
    row = bilinear_lm.scores(frame(spark, ["a b"], [alone])).collect()[0]
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)


def words_and_model():
    counts = np.array([50, 40, 30, 20, 10, 5], np.int64)
    words = bilinear_lm.Vocabulary([b" ", b"a", b"b", b"c", b"d", b"e"], counts, 170, 12, 4)
    model = bilinear_lm.Model(5, 8)
    model.flat += np.random.default_rng(1).standard_normal(len(model.flat)).astype(np.float32) * 0.3
    return words, model


def test_probabilities_are_a_direct_softmax_and_sum_to_one():
    words, model = words_and_model()
    scorer = bilinear_lm.Scorer(words, bilinear_lm.Coder(words), model)
    every = np.arange(5)
    for last in range(5):
        for before in range(5):
            wanted = model.context[last] * model.scale[0] + model.context[before] * model.scale[1]
            logits = (model.target @ wanted + model.bias).astype(np.float64)
            direct = logits - np.log(np.exp(logits).sum())
            found = scorer.log10(np.full(5, last), np.full(5, before), every) * np.log(10)
            assert np.abs(found - direct).max() < 1e-5
            assert np.exp(found).sum() == pytest.approx(1, abs=1e-5)
    # Inside the class of other words: their smoothed shares, and one unseen word's, sum to 1.
    others = 170 - 140 + 0.1 * (12 - 4)
    assert words.rare_mass() == pytest.approx(others + 0.1)
    assert words.unigrams().sum() == pytest.approx(1)


def test_a_text_scores_the_sum_of_its_tokens():
    words, model = words_and_model()
    scorer = bilinear_lm.Scorer(words, bilinear_lm.Coder(words), model)
    keys = [b"a", b"e", b"unknown", b"b", b" "]
    classes, line = [1, 4, 4, 2, 0], [0, 0, 1, 4, 4, 2, 0]
    total = sum(
        float(scorer.log10(np.array([line[i + 1]]), np.array([line[i]]), np.array([c]))[0])
        for i, c in enumerate(classes)
    )
    rare = math.log10(words.rare_mass())
    known, base, score, left, tail = scorer.part(keys, [0, 0])
    assert (known, left, tail) == (4, [b"unknown"], [2, 0])
    assert score == pytest.approx(total + math.log10(5.1) - 2 * rare)
    unit = math.log10(170 + 0.1 * 13)
    assert base == pytest.approx(sum(math.log10(c + 0.1) for c in (40, 5, 30, 50)) - 5 * unit)
    split = scorer.part(keys[:3], [0, 0])
    assert split[2] + scorer.part(keys[3:], split[4])[2] == pytest.approx(score)


def test_training_beats_the_base_on_held_out_texts(spark):
    pick = random.Random(3)
    turn = {"the": ["cat", "dog"], "cat": ["sat", "ran"], "dog": ["sat", "ran"], "sat": ["the"], "ran": ["the"]}
    texts = []
    for _ in range(400):
        line = ["the"]
        while len(line) < 120:
            line.append(pick.choice(turn[line[-1]]))
        texts.append(" ".join(line))
    rows = [r for r in bilinear_lm.scores(frame(spark, texts)).collect() if r.held_out]
    assert len(rows) > 20
    per_token = sum(r.score for r in rows) / sum(r.n_tokens for r in rows)
    base = sum(r.base_score for r in rows) / sum(r.n_tokens for r in rows)
    # A perfect model gives two words in three one of two ways: -0.2 a token; the base -0.65.
    assert base < -0.6 and per_token > -0.4


def test_noise_contrastive_steps_raise_their_objective():
    words, _ = words_and_model()
    unigrams = words.unigrams()
    model = bilinear_lm.Model(5, 8)
    model.bias[:] = np.log(unigrams)
    trainer = bilinear_lm.Trainer(model, unigrams, 1)
    grams = np.array([[1, 0, 2], [2, 1, 3], [3, 2, 1]] * 2000)
    trainer.add(grams)
    trainer.flush()
    assert trainer.tokens == 6000
    _, _, before = model.tables()
    for last, prior, token in grams[:3]:
        old = _probability(model, last, prior, token)
        assert _probability(trainer.model, last, prior, token) > old + 0.1
    assert before.shape == (5, 5)


def _probability(model, last, prior, token):
    a, b, normal = model.tables()
    return float(np.exp(a[last, token] + b[prior, token] - normal[last, prior]))
