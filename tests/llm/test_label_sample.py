"""The training sample is drawn from labels that have a text."""

from fleetpulse.llm import toxicity_mil
from tests.llm.test_documents import frame


def test_labels_without_a_text_take_no_place_in_the_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity_mil, "SAMPLE", {0: 6, 1: 4})
    seen = []
    monkeypatch.setattr(toxicity_mil, "fit", lambda texts, labels: seen.extend(labels))
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)], "doc_id long, toxic int")
    ids = list(range(100))
    texts = [f"text {i}" if i < 60 else None for i in ids]
    toxicity_mil.train(frame(spark, texts, ids), labels)
    assert sorted(seen) == [0] * 6 + [1] * 4
