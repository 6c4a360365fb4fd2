"""Near-duplicates of few shingles, whose bins differ more than the bound allows."""

import pytest

from fleetpulse.llm import minhash_oph
from tests.llm.test_documents import frame


@pytest.mark.parametrize("number", [543, 1822])
def test_small_sets_are_linked_whatever_their_bins(spark, number):
    words = [f"w{number}x{j}" for j in range(8)]
    texts = [" ".join(words), " ".join(words[:7])]
    (keys, bits), (others, own) = (
        minhash_oph.sketched(minhash_oph.shingle_hashes(text)) for text in texts
    )
    assert set(keys) & set(others)
    differs = (bits ^ own).reshape(minhash_oph.PLANES, -1)
    assert sum(int(a | b | c | d).bit_count() for a, b, c, d in differs.T) > 56
    found = minhash_oph.near_duplicates(frame(spark, texts)).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(0, 0), (1, 0)}
