"""Language identification by string kernels.

A text is cut into blocks of equal length. A block is the set of its character n-grams of one
to three characters (a blended spectrum, hashed into ``SLOTS`` places); the kernel of two
blocks is the number of n-grams that both hold, over the root of the product of their sizes.
Landmark blocks give the Nystroem map of this kernel, on which kernel ridge regression is fit,
one language against the rest. As the kernel is a product of presence vectors, landmarks and
regression fold into one matrix, and a batch of blocks is scored by one matrix product.

Texts of any length are read in runs of blocks, so a text takes no more memory than a run does.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import columns_as, map_rows, once_per_worker
from fleetpulse.llm.toxicity_mil import is_held_out

#: At most about so many labelled documents of a language are learned from, by a hash of doc_id.
PER_LANGUAGE = 300
#: At most so many blocks of them, and so many landmarks, evenly spread.
BLOCKS, LANDMARKS = 4000, 400
SLOTS, BLOCK, RIDGE = 2**14, 1500, 1e-2
UNKNOWN = "und"
#: Characters of the longest n-gram.
LONGEST = 3
_SPACE = 32
#: Blocks of a run, and characters of a text that are lower-cased at once.
_AT_ONCE, _PIECE = 256, 1 << 18


def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _parts(text: str) -> Iterator[np.ndarray]:
    """The characters of a text, piece by piece."""
    space, started, before = np.array([_SPACE], np.uint32), False, False
    for start in range(0, len(text), _PIECE):
        lower = text[start : start + _PIECE].lower()
        codes = np.frombuffer(lower.encode("utf-32-le"), np.uint32)
        letter = once_per_worker("letters", _letters)[codes]
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[0] |= before
        before = bool(letter[-1])
        if not started and letter.any():
            started = True
            yield space
        yield np.where(letter, codes, space)[keep]
    if started:
        yield space


def characters(text: str) -> np.ndarray:
    """Code points of the lower-cased text; a letter is kept, a run of others becomes one space."""
    return np.concatenate([np.empty(0, np.uint32), *_parts(text)])


def _runs(text: str) -> Iterator[tuple[np.ndarray, int]]:
    """Runs of whole blocks of a text's characters, each with the few characters after it that its
    last n-grams reach into, and the number of characters without those."""
    own, held, size = _AT_ONCE * BLOCK, [], 0
    for part in _parts(text):
        held.append(part)
        size += len(part)
        if size >= own + LONGEST - 1:
            chars = np.concatenate(held)
            while len(chars) >= own + LONGEST - 1:
                yield chars[: own + LONGEST - 1], own
                chars = chars[own:]
            held, size = [chars], len(chars)
    if size:
        yield np.concatenate(held), size


def ngram_slots(chars: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
    """The slot and the block number of every n-gram that starts at one of the first ``own``
    characters."""
    blocks = np.arange(own) // BLOCK
    code, slots, places = np.zeros(len(chars), np.uint32), [], []
    for n in range(LONGEST):
        code = code[: len(chars) - n] * np.uint32(0x9E3779B1) + chars[n:] + np.uint32(n + 1)
        mixed = (code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        slots.append(mixed[:own] >> np.uint32(32 - SLOTS.bit_length() + 1))
        places.append(blocks[: len(code)])
    return np.concatenate(slots), np.concatenate(places)


def presence(runs: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The presence rows of all blocks of some runs, and the run that each row is of."""
    counts = np.array([-(-own // BLOCK) for _, own in runs])
    bases = np.concatenate([[0], np.cumsum(counts)])
    rows = np.zeros((bases[-1], SLOTS), np.float32)
    for base, (chars, own) in zip(bases, runs, strict=False):
        slots, blocks = ngram_slots(chars, own)
        rows[base + blocks, slots] = 1
    return rows, np.repeat(np.arange(len(runs)), counts)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    matrix: np.ndarray

    def decide(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language and its share of a softmax over the decision values, which are the mean
        of a text's blocks, weighted by their n-grams."""
        total = np.zeros((len(texts), len(self.languages)))
        weight = np.zeros(len(texts))
        waiting: list[tuple[np.ndarray, int]] = []
        places: list[int] = []
        blocks = 0

        def flush() -> None:
            rows, owner = presence(waiting)
            size = rows.sum(1)
            at = np.array(places)[owner]
            np.add.at(total, at, (rows @ self.matrix) * np.sqrt(size)[:, None])
            np.add.at(weight, at, size)

        for at, text in enumerate(texts):
            for run in _runs(text) if text and self.languages else ():
                waiting.append(run)
                places.append(at)
                blocks += -(-run[1] // BLOCK)
                if blocks >= _AT_ONCE:
                    flush()
                    waiting, places, blocks = [], [], 0
        if waiting:
            flush()
        result = [(UNKNOWN, 0.0)] * len(texts)
        for at in np.flatnonzero(weight):
            value = total[at] / weight[at]
            share = np.exp(4 * (value - value.max()))
            best = int(value.argmax())
            result[at] = self.languages[best], float(share[best] / share.sum())
        return result


def fit(texts: list[str], languages: list[str]) -> Model:
    """Nystroem landmarks and one-versus-rest ridge regression on blocks of the texts."""
    names = sorted(set(languages))
    pieces, labels = [], []
    for text, language in zip(texts, languages, strict=True):
        chars = characters(text)
        for start in range(0, len(chars), BLOCK):
            pieces.append(chars[start : start + BLOCK])
            labels.append(names.index(language))
    if not pieces:
        return Model([], np.zeros((SLOTS, 0), np.float32))
    some = np.unique(np.linspace(0, len(pieces) - 1, BLOCKS).astype(int))
    rows = np.vstack([presence([(pieces[i], len(pieces[i]))])[0] for i in some])
    rows /= np.sqrt(rows.sum(1, keepdims=True))
    sides = -np.ones((len(some), len(names)))
    sides[np.arange(len(some)), np.array(labels)[some]] = 1
    marks = rows[np.unique(np.linspace(0, len(some) - 1, LANDMARKS).astype(int))]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    mapped = (rows @ marks.T) @ root
    # Each language weighs the same, however many blocks it has.
    weight = 1 / np.bincount(np.array(labels)[some], minlength=len(names))[np.array(labels)[some]]
    gram = (mapped * weight[:, None]).T @ mapped + RIDGE * np.eye(mapped.shape[1])
    solved = np.linalg.solve(gram, (mapped * weight[:, None]).T @ sides)
    return Model(names, (marks.T @ (root @ solved)).astype(np.float32))


def train(docs: DataFrame) -> Model:
    """Learn from text and lang of rows that are not held out; the rows of a language are
    thinned by a hash of their id to about ``PER_LANGUAGE``. Of rows that share an id and a
    language, the first text in order teaches."""
    known = columns_as(docs, doc_id="doc_id", text="text", lang="lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
    )
    known = known.where(~is_held_out(F.col("doc_id"), 4, 2))
    order = F.pmod(F.xxhash64("doc_id"), F.lit(2**40)) / F.lit(float(2**40))
    counts = {row.lang: row.n for row in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for language, n in counts.items():
        share = F.when(F.col("lang") == language, F.lit(min(1.0, PER_LANGUAGE / n))).otherwise(share)
    found = known.where(order < share).groupBy("doc_id", "lang")
    rows = found.agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda row: (row.doc_id, row.text, row.lang))
    return fit([row.text for row in rows], [row.lang for row in rows])


def predict_languages(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: held_out, lang_pred and score.

    ``und`` with score 0 where the text is null or has no letter. Each row is judged by its
    whole text alone, so repeated rows, null ids and other columns need no care.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS x languages numbers

    def rows_of(batch: dict[str, list]) -> dict[str, list]:
        decided = shared.value.decide(batch["text"])
        return {
            "doc_id": batch["doc_id"],
            "held_out": batch["held_out"],
            "lang_pred": [language for language, _ in decided],
            "score": [score for _, score in decided],
        }

    rows = columns_as(docs, doc_id="doc_id", text="text").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        is_held_out(F.col("doc_id"), 4, 2).alias("held_out"),
        "text",
    )
    schema = "doc_id long, held_out boolean, lang_pred string, score double"
    return map_rows(rows, schema, rows_of)
