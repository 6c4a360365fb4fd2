"""Decontamination gives the same rows whatever the number of blocks of tests."""

import pytest

from fleetpulse.llm import fm_decontam
from tests.llm.test_documents import _brute_contamination, frame, rows


@pytest.mark.parametrize("block_words", [1_000_000, 3])
def test_every_row_keeps_a_row_and_item_ids_count_once(spark, block_words, monkeypatch):
    monkeypatch.setattr(fm_decontam, "BLOCK_WORDS", block_words)
    tests = [(1, "a b c"), (1, "d e f"), (1, "g h i"), (2, "b c d"), (10, "d e f"), (3, "x y z")]
    texts = ["a b c d e f g h i"] * 3 + ["x y z", "x y z", "no", "no", None, None, "", "a b c"]
    ids = [1, 1, 2, None, None, 4, 4, 5, 5, 5, 5]
    items = spark.createDataFrame(tests, "item_id long, text string")
    df = frame(spark, texts, ids)
    expected = sorted(_brute_contamination(zip(ids, texts, strict=True), tests), key=repr)
    assert rows(fm_decontam.contamination_report(df, items).drop("spans")) == expected
    found = fm_decontam.contamination(df, items)
    assert found.columns == ["doc_id", "n_words", "spans", "items"]
    whole = [(r.spans, r.items) for r in found.where("n_words = 9").collect()]
    assert whole == [([[0, 9]], [1, 2, 10])] * 3
