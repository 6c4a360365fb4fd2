"""Token files of letters whose lower case alone has a composed form."""

import string
import sys
import unicodedata
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from fleetpulse.llm import token_files
from tests.llm.test_documents import frame

TEXTS = ["H̱", "T̈", "W̊", "J̌", "Å Å", "The END, Été. THE",
         "xJ̌. J̌,", "ẖ ̱H H"]


def test_decomposed_letters_get_the_ids_of_the_whole_text(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, at, expected = Tokenizer.from_file(path), 0, []
    for i, text in enumerate(TEXTS):
        ids = plain.encode(text, add_special_tokens=False).ids + [1]
        expected.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    found = token_files.token_file_index(frame(spark, TEXTS), path)
    assert sorted(map(tuple, found.collect())) == expected


def test_marks_of_ascii_letters_have_the_named_first_bytes():
    """Of all characters, those that change or compose with an ASCII letter before them."""
    for mark in filter(unicodedata.combining, map(chr, range(sys.maxunicode + 1))):
        for letter in string.ascii_letters:
            whole = unicodedata.normalize("NFC", letter + mark)
            if whole != letter + unicodedata.normalize("NFC", mark):
                assert mark.encode()[:1] in token_files._MARKS
