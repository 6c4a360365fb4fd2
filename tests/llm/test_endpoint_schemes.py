"""Endpoints of every scheme that the pattern allows link a short secret."""

import duckdb

from fleetpulse.llm import secret_links
from tests.llm.test_documents import frame

TEXTS = [
    "password: hunter2 at s3://bucket/key-path", "password: hunter2 at a+://bucket/key-path",
    "password: hunter2 at a.://bucket/key-path", "password: hunter2 at a-://bucket/key-path",
    "password: hunter2 at file:///etc/key-path", "password: hunter2 at s3://_x/~key-path",
    "password: hunter2 at 3://bucket/key-path", "password: hunter2 at ://bucket/key-path",
]


def test_no_endpoint_is_lost_before_its_pattern(spark):
    df = frame(spark, TEXTS)
    found = {r.doc_id: r.spans for r in secret_links.secret_spans(df).collect()}
    for i, text in enumerate(TEXTS[:6]):
        assert found[i] == f"short:0:17,endpoint:21:{len(text)}"
    assert found[6] == found[7] == ""
    engine = duckdb.connect()
    engine.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    engine.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(TEXTS)))
    twin = engine.sql(secret_links.sql()).fetchall()
    assert {row[0]: row[-1] for row in twin} == found
    masked = {r.doc_id: r.text for r in secret_links.mask_secrets(df).collect()}
    assert all(masked[i] == "[SECRET] at [SECRET]" for i in range(6))
