"""Byte-level BPE encoding and decoding with a sentencepiece model made from a rank file.

The model is serialised straight from the vocabulary: every byte of a token becomes one
character, every token one piece scored by its negative rank, and the normaliser is the
identity. The sentencepiece merge order (best score first, leftmost first) is then the rank
order, and piece ids are ranks.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import Cache, columns_as, map_rows, once_per_worker

# Field numbers and enumeration values of the sentencepiece model format.
_PIECES, _TRAINER, _NORMALIZER = 1, 2, 3
_PIECE_TEXT, _PIECE_SCORE, _PIECE_KIND = 1, 2, 3
_UNKNOWN_KIND = 2
_MODEL_TYPE, _BPE = 3, 2
_NORMALIZER_NAME, _DUMMY_PREFIX, _TRIM_SPACES, _ESCAPE_SPACES = 1, 3, 4, 5

#: Byte b stands as the character with this code plus b: letters that no rule rewrites.
_FIRST_CHARACTER = 0x100


def _varint(value: int) -> bytes:
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _float(field: int, value: float) -> bytes:
    return _varint(field << 3 | 5) + struct.pack("<f", value)


def as_characters(data: bytes) -> str:
    return "".join([chr(_FIRST_CHARACTER + b) for b in data])


def as_bytes(piece: str) -> bytes:
    return bytes([ord(c) - _FIRST_CHARACTER for c in piece])


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file of lines ``base64-token rank``."""
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines) if t}


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model whose piece ids are the ranks."""
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must run from 0 without gaps")
    pieces = [
        _block(_PIECES, _block(_PIECE_TEXT, as_characters(t).encode()) + _float(_PIECE_SCORE, -r))
        for r, t in enumerate(tokens)
    ]
    unknown = _block(_PIECE_TEXT, b"<unk>") + _float(_PIECE_SCORE, 0.0)
    pieces.append(_block(_PIECES, unknown + _number(_PIECE_KIND, _UNKNOWN_KIND)))
    normalizer = _block(_NORMALIZER_NAME, b"identity") + b"".join(
        _number(field, 0) for field in (_DUMMY_PREFIX, _TRIM_SPACES, _ESCAPE_SPACES)
    )
    trainer = _number(_MODEL_TYPE, _BPE)
    return b"".join(pieces) + _block(_TRAINER, trainer) + _block(_NORMALIZER, normalizer)


#: Characters of the longest parts that are memoised: texts without spaces are one part each.
LONGEST = 64


class Codec:
    """Encode texts to ids and decode ids to bytes, with a bounded memo of short text parts."""

    def __init__(self, rank_path: str, pattern: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(rank_path)
        self._model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.ranks))
        self._token_bytes = [
            as_bytes(self._model.id_to_piece(rank)) for rank in range(len(self.ranks))
        ]
        self._split = regex.compile(pattern).findall
        self._pretokens = Cache(self._pretoken, 100_000)
        self._first = Cache(lambda part: self._part(part, part), 20_000)
        self._spaced = Cache(lambda part: self._part(part, " " + part), 200_000)

    def encode_pretoken(self, pretoken: str) -> list[int]:
        data = pretoken.encode()
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self._model.encode(as_characters(data))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self._token_bytes[i] for i in ids])

    def _pretoken(self, pretoken: str) -> tuple[bytes, bytes]:
        ids = self.encode_pretoken(pretoken)
        return b",".join([b"%d" % i for i in ids]), self.decode(ids)

    def _part(self, part: str, text: str) -> tuple[bytes, bytes] | bool:
        if not part or part[0].isspace() or part[-1].isspace():
            return False
        return self._whole(text)

    def _whole(self, text: str) -> tuple[bytes, bytes]:
        known, make = self._pretokens, self._pretoken
        return self._joined(
            [known[p] if len(p) <= LONGEST else make(p) for p in self._split(text)]
        )

    @staticmethod
    def _joined(found: list[tuple[bytes, bytes]]) -> tuple[bytes, bytes]:
        return b",".join([f[0] for f in found]), b"".join([f[1] for f in found])

    def round_trip(self, text: str | None) -> tuple[bytes, bytes]:
        """The decimal ids, comma-joined, and the bytes that these ids decode to.

        A single space between two characters that are not white space always starts a
        pre-token, so such a text is taken part by part; any other goes to the pattern whole.
        """
        if not text:
            return b"", b""
        first, *rest = text.split(" ")
        spaced, part = self._spaced, self._part
        found = [self._first[first] if len(first) <= LONGEST else part(first, first)]
        found += [spaced[p] if len(p) <= LONGEST else part(p, f" {p}") for p in rest]
        return self._whole(text) if False in found else self._joined(found)


def coded_documents(
    docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: n_tokens, ids_sha256 and decoded_sha256.

    Null and empty texts have no ids. Repeated rows and null ids are kept as they are; other
    columns are ignored. Each text is coded whole, in the task that reads it.
    """

    def rows_of(batch: dict[str, list]) -> dict[str, list]:
        codec = once_per_worker(("codec", rank_path, pattern), lambda: Codec(rank_path, pattern))
        counts, ids_hash, text_hash = [], [], []
        for text in batch["text"]:
            ids, decoded = codec.round_trip(text)
            counts.append(ids.count(b",") + 1 if ids else 0)
            ids_hash.append(hashlib.sha256(ids).hexdigest())
            text_hash.append(hashlib.sha256(decoded).hexdigest())
        return {
            "doc_id": batch["doc_id"],
            "n_tokens": counts,
            "ids_sha256": ids_hash,
            "decoded_sha256": text_hash,
        }

    rows = columns_as(docs, doc_id=id_col, text=text_col)
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("long"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_rows(rows, schema, rows_of)


def token_ids(
    docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The ids themselves: doc_id and ids (an array of int; empty for null or empty texts)."""

    def rows_of(batch: dict[str, list]) -> dict[str, list]:
        codec = once_per_worker(("codec", rank_path, pattern), lambda: Codec(rank_path, pattern))
        coded: Iterator[bytes] = (codec.round_trip(text)[0] for text in batch["text"])
        return {
            "doc_id": batch["doc_id"],
            "ids": [[int(i) for i in ids.split(b",")] if ids else [] for ids in coded],
        }

    rows = columns_as(docs, doc_id=id_col, text=text_col)
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("long"))
    return map_rows(rows, "doc_id long, ids array<int>", rows_of)
