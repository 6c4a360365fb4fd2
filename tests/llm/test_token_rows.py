"""Token files: ids at the ends of their range, null ids, many reading tasks, and the memo."""

import random
import zlib

import numpy as np
import public_tokenizers

from fleetpulse.llm import token_files
from fleetpulse.llm.common import ByteMemo

PATH = public_tokenizers.path("word_bpe_49k.json")


def direct(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_least_id_and_null_ids_stay_apart(spark):
    rows = [(-(2**63), "least"), (None, "none"), (None, None), (2**63 - 1, "most"), (0, "zero one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = token_files.token_file_index(df, PATH).collect()
    assert sorted(repr(r.doc_id) for r in found) == sorted(repr(r[0]) for r in rows)
    starts = sorted((r.start, r.n_tokens) for r in found)
    assert [s for s, _ in starts] == [sum(n for _, n in starts[:i]) for i in range(len(starts))]
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    for doc_id, text in rows:
        if doc_id is not None:
            ids = np.array([*direct(text), 1], "<u4")
            assert by_id[doc_id].ids_crc32 == zlib.crc32(ids.tobytes())


def test_files_are_read_back_in_many_tasks(spark):
    df = spark.createDataFrame([(i, f"word {i}") for i in range(400)], "doc_id long, text string")
    # Small ranges would be merged into one file.
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merging, "false")
    manifest = token_files.write_token_files(df, token_files.scratch_path(spark, "t"), PATH, 1)
    spark.conf.unset(merging)
    back = token_files.read_token_files(manifest)
    assert manifest.count() > 1 and back.rdd.getNumPartitions() == manifest.count()
    assert [r.doc_id for r in back.orderBy("start").collect()] == list(range(400))


def test_chunks_learned_together_equal_the_tokenizer():
    pick = random.Random(4)
    letters = ["a", "Z", "é", "É", "ß", "ñ", "1", "9", ".", ",", "'s", "-", "…", "日", "한", "ﬁ", "Å", "İ", "😀", "́", "\xa0", " ", "\x85", "\x1c", "क्", "ा"]
    encode = token_files.ChunkEncoder(PATH, "<u2")
    for _ in range(400):
        words = ["".join(pick.choice(letters) for _ in range(pick.randrange(1, 9))) for _ in range(40)]
        text = pick.choice([" ", "\n", "\t "]).join(words)
        assert np.frombuffer(encode(text), "<u2").tolist() == direct(text), repr(text)


def test_a_small_memo_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_files, "_MEMO", 2000)
    monkeypatch.setattr(token_files, "_AT_ONCE", 3)
    encode = token_files.ChunkEncoder(PATH, "<u2")
    for i in range(60):
        text = " ".join(f"w{j * i % 37}., Q{j}" for j in range(30)) + " " + "x" * 400
        assert np.frombuffer(encode(text), "<u2").tolist() == direct(text)


def test_the_memo_is_bounded_in_bytes():
    memo = ByteMemo(10_000)
    for i in range(5000):
        memo.put(b"%d" % i, b"x" * 20)
        memo.put(b"k" * 300, b"y")
    assert len(memo.new) + len(memo._old) <= 2 * 10_000 // 180 + 2 and b"k" * 300 not in memo.new
    assert memo.older(b"%d" % (4999 - len(memo.new))) == b"x" * 20
