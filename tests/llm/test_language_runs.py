"""Language identification against direct kernel ridge regression, and on texts of any length."""

import math
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from fleetpulse.llm import language_kernel as lk

TEACH = [
    ("the cat sat on the mat, and it purred", "en"),
    ("der Hund lief durch den Wald nach Hause", "de"),
    ("el perro corre por la calle mayor", "es"),
    ("where have all the flowers gone today", "en"),
    ("wo sind die schönen Blumen geblieben", "de"),
    ("dónde están las flores de la señora", "es"),
]
ASKED = ["the dog ran home", "die Katze schläft", "la casa de la playa", "Ω", "x 1 y"]


def slot(gram: str) -> int:
    code = 0
    for n, letter in enumerate(gram):
        code = (code * 0x9E3779B1 + ord(letter) + n + 1) % 2**32
    return ((code ^ (code >> 15)) * 0x85EBCA6B % 2**32) >> 18


def spaced(text: str) -> str:
    out = " "
    for letter in text.lower():
        if letter.isalpha():
            out += letter
        elif out[-1] != " ":
            out += " "
    return out + " " if out != " " else ""


def grams(text: str) -> list[set[int]]:
    """The n-grams of each block; those at a block's end reach into the next."""
    chars = spaced(text)
    return [
        {
            slot(chars[i : i + n])
            for i in range(start, min(start + lk.BLOCK, len(chars)))
            for n in (1, 2, 3)
            if i + n <= len(chars)
        }
        for start in range(0, len(chars), lk.BLOCK)
    ]


def kernel(a: set, b: set) -> float:
    return len(a & b) / math.sqrt(len(a) * len(b))


def direct(texts: list[tuple[str, str]], asked: list[str]) -> list[tuple[str, float]]:
    """Weighted kernel ridge regression in the span of all training blocks, nothing folded."""
    names = sorted({language for _, language in texts})
    blocks = [(block, language) for text, language in texts for block in grams(text)]
    held = [language for _, language in blocks]
    weight = np.diag([1 / held.count(language) for language in held])
    gram = np.array([[kernel(a, b) for b, _ in blocks] for a, _ in blocks])
    sides = np.array([[1.0 if language == name else -1.0 for name in names] for language in held])
    alpha = np.linalg.solve(gram @ weight @ gram + lk.RIDGE * gram, gram @ weight @ sides)
    result = []
    for text in asked:
        parts = grams(text)
        if not parts:
            result.append(("und", 0.0))
            continue
        values = [[kernel(part, b) for b, _ in blocks] @ alpha for part in parts]
        mean = np.average(values, axis=0, weights=[len(part) for part in parts])
        share = np.exp(4 * mean) / np.exp(4 * mean).sum()
        result.append((names[int(mean.argmax())], float(share.max())))
    return result


def same(found, wanted):
    assert [name for name, _ in found] == [name for name, _ in wanted]
    np.testing.assert_allclose([s for _, s in found], [s for _, s in wanted], atol=1e-4)


def test_equals_direct_kernel_ridge_regression():
    model = lk.fit([text for text, _ in TEACH], [language for _, language in TEACH])
    asked = [*ASKED, "", " 12 ?!", " ".join(t for t, _ in TEACH) * 20, "ab" * 2 * lk.BLOCK]
    same(model.decide(asked), direct(TEACH, asked))


def test_runs_and_pieces_change_nothing(monkeypatch):
    model = lk.fit([text for text, _ in TEACH], [language for _, language in TEACH])
    base = "Der Hund, la casa -- the end. 12 日本語 "
    texts = [base * n + tail for n in (1, 5, 40) for tail in ("", "x", "?", "  ab")]
    whole = model.decide(texts)
    for at_once, piece, block in ((1, 7, 1500), (2, 1, 1500), (1, 64, 10), (3, 11, 11)):
        monkeypatch.setattr(lk, "BLOCK", block)
        monkeypatch.setattr(lk, "_AT_ONCE", 10**6)
        unsplit = model.decide(texts) if block != 1500 else whole
        monkeypatch.setattr(lk, "_AT_ONCE", at_once)
        monkeypatch.setattr(lk, "_PIECE", piece)
        assert all(lk.characters(t).tolist() == [ord(c) for c in spaced(t)] for t in texts)
        same(model.decide(texts), unsplit)


def test_memory_does_not_follow_the_length_of_a_text():
    model = lk.fit([text for text, _ in TEACH], [language for _, language in TEACH])
    model.decide(["warm up"])
    peaks = []
    for times in (50_000, 400_000):
        text = "the cat sat on the " * times
        tracemalloc.start()
        model.decide([text])
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 100e6 and peaks[1] < 1.5 * peaks[0]


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    data = [(1, TEACH[0][0], "en", 9), (1, TEACH[0][0], "en", 9), (None, TEACH[1][0], "de", 9),
            (2, None, "es", 9), (3, "", None, 9)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, score int")
    docs = docs.withColumn("held_out", F.lit("x")).withColumn("a.b", F.lit(1))
    model = lk.fit([text for text, _ in TEACH], [language for _, language in TEACH])
    found = [tuple(r) for r in lk.predict_languages(docs, model).collect()]
    assert sorted(str(r[0]) for r in found) == ["1", "1", "2", "3", "None"]
    assert len({r for r in found if r[0] == 1}) == 1
    assert {r[2] for r in found if r[0] in (2, 3)} == {"und"}
    assert [r[2] for r in found if r[0] is None] == ["de"]
    assert lk.predict_languages(docs.limit(0), model).count() == 0
