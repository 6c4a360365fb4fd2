"""Exact comparison of sets in pairs of blocks, without a bound that drops links."""

import numpy as np
import pytest

from fleetpulse.llm import minhash_oph, set_blocks
from tests.llm.test_documents import _brute_groups, frame, rows


def _sets(rng, count, size, shared):
    pool = rng.integers(0, 2**63, size, dtype=np.uint64)
    own = rng.integers(0, 2**63, (count, size), dtype=np.uint64)
    return [np.unique(np.concatenate([pool[: rng.integers(1, shared)], o[: rng.integers(1, size)]]))
            for o in own]


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(5)
    sets = _sets(rng, 60, 90, 90)
    sets += [s[: max(1, int(len(s) * 0.8))] for s in sets]
    made = [
        {"low": 0, "high": 0, "block": 0, "node": i, "root": i, "size": len(s),
         "bitmap": set_blocks.bitmap(s), "hashes": s.view(np.int64)}
        for i, s in enumerate(sets)
    ]
    truly = set()
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(np.intersect1d(a, b))
            if 100 * both >= 75 * (len(a) + len(b) - both):
                truly |= {i, j}
    left = set_blocks.undecided(made, 75)
    assert truly and truly <= {r["node"] for r in left} and len(left) < len(made)
    tied = {r["b"] for r in set_blocks.linked(left, 75)} | {r["a"] for r in set_blocks.linked(left, 75)}
    assert tied == truly


@pytest.mark.parametrize("same", [True, False])
def test_overlaps_equal_intersections(same):
    rng = np.random.default_rng(6)
    left = [s.view(np.int64) for s in _sets(rng, 9, 6000, 5000)]
    right = left if same else [s.view(np.int64) for s in _sets(rng, 5, 60, 50)] + left[:2]
    found = set_blocks.overlaps(left, right)
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            if not (same and i == j):
                assert found[i, j] == len(np.intersect1d(a, b))


def test_many_blocks_find_what_one_finds(spark, monkeypatch):
    """Members of a family that no star ties, in blocks of a few sets each."""
    monkeypatch.setattr(set_blocks, "BLOCK_BYTES", 300)
    rng = np.random.default_rng(8)
    base = [f"b{i}" for i in range(150)]
    docs = []
    for own in range(40):
        start = int(rng.integers(0, 60))
        docs.append(" ".join(base[start : start + 90] + [f"o{own // 2}x{i}" for i in range(12)]))
    docs += ["", None, docs[3]]
    members = frame(spark, docs).select("doc_id").where("doc_id < 40")
    members = members.selectExpr("1L AS key", "doc_id AS node", "doc_id AS root")
    nodes = members.select("node")
    sets = minhash_oph._full_sets(frame(spark, docs).select("doc_id", "text"), nodes)
    found = {(r.a, r.b) for r in set_blocks.links_across(members, sets.cache(), 75).collect()}
    root = list(range(40))
    for _ in range(40):
        for a, b in found:
            root[a] = root[b] = min(root[a], root[b])
    assert dict(enumerate(root)) == {r[0]: r[2] for r in _brute_groups(list(enumerate(docs[:40])))}


def test_a_template_family_and_long_texts_equal_brute_force(spark):
    """Pages of one template at a similarity near 0.6, a few of them linked, and long texts whose
    overlap stands at the border."""
    rng = np.random.default_rng(9)
    base = [f"t{i}" for i in range(160)]
    docs = []
    for number in range(300):
        fill = [f"p{number}q{i}" for i in range(50)]
        docs.append(" ".join(base[:80] + fill[: int(rng.integers(38, 50))] + base[80:]))
        if number % 50 == 0:
            docs.append(docs[-1].replace(fill[7], "other"))
    long = [f"l{i}" for i in range(20_004)]
    own = [f"m{i}" for i in range(20_000)]
    # 20,000 shingles against 15,000 of them alone (linked), and against 14,999 (not linked).
    docs += [" ".join(long), " ".join(long[:15_004]), " ".join(own + ["z"] * 4)]
    docs += [" ".join(own[:15_001])]
    found = minhash_oph.near_duplicates(frame(spark, docs))
    assert rows(found) == _brute_groups(list(enumerate(docs)))
