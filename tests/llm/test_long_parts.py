"""Byte-level coding of parts too long to be memoised."""

import hashlib

import public_tokenizers
import tiktoken

from fleetpulse.llm import bpe_codec


def test_long_parts_are_coded_alike_and_not_kept():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    codec = bpe_codec.Codec(path, public_tokenizers.PATTERN)
    peer = tiktoken.Encoding(
        "peer", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={}
    )
    long = "日本語の文章" * 40
    texts = [long, f"{long} {long}", f" {long}", f"a {long}\n b", "x" * 64 + " " + "y" * 65, "a" * 500]
    for text in texts * 2:
        ids, decoded = codec.round_trip(text)
        assert ids.decode() == ",".join(map(str, peer.encode_ordinary(text)))
        assert hashlib.sha256(decoded).digest() == hashlib.sha256(text.encode()).digest()
    held = [*codec._first, *codec._spaced, *codec._pretokens]
    assert max(map(len, held)) <= bpe_codec.LONGEST
