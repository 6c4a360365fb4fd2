"""Near-duplicate removal on tables whose column names hold dots."""

from fleetpulse.llm import minhash_oph


def test_column_names_with_dots_pass_through(spark):
    text = "one two three four five six seven eight"
    rows = [(1, text, 10), (1, text + " nine", 11), (2, text, 12), (None, text, 13)]
    df = spark.createDataFrame(rows, "`doc_id` long, text string, `a.b` long")
    kept = minhash_oph.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r["a.b"]) for r in kept.collect()) == [(0, 13), (1, 10)]
