"""Language-model scoring with a log-bilinear neural model.

Tokens are words and one end a text. Their counts over all training texts are summed by Spark
and stay a table: they give the smoothed unigram base. The log-bilinear model predicts a token
from the two before it: context vectors, scaled per position, give a wanted vector whose product
with a token's vector, plus its bias, is the token's score. It is trained by noise-contrastive
estimation in numpy: each round covers its share of all training texts, every partition starts
from the same parameters, and their mean, weighted by tokens, starts the next round.

The model's classes are the ``CLASSES`` most frequent tokens, the end, and one class for all
other words, inside which a word has its smoothed unigram share. Normalisers of all pairs of
context classes are one matrix product, so probabilities are normalised exactly, and a batch of
tokens is scored by table look-ups. Log-counts of the ``HEAD`` most frequent tokens go to the
tasks; those of all others are joined.

Tokens over 32 bytes are keyed by a blank and their MD5. Null and empty texts are one end; null
ids train (they are not held out); repeated rows are scored each; a long text is read in chunks,
whole. Without training texts every base score is 0. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import columns_as, summed
from fleetpulse.llm.toxicity_mil import is_held_out
from fleetpulse.session import stage

#: Bounds of what tasks hold: tokens with their log-counts, and classes of the model.
HEAD, CLASSES = 2**17, 2000
#: The model: vector length, tokens of a step, noise tokens of a step, rounds, step width.
DIMS, STEP, NOISE, ROUNDS, RATE = 16, 1024, 64, 3, 0.06
SMOOTH, SEED = 0.1, 13
END = b" "
_CHUNK = 2**20
_DISTINCT = 300_000
_RARE_KEYS = 4096
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def chunks(text: str | None) -> Iterator[list[bytes]]:
    """Keys of a text's tokens, in lists of bounded size; the last list ends with the end."""
    data = (text or "").encode("utf-8", "surrogatepass")
    start = 0
    while len(data) - start > _CHUNK:
        space = _SPACE.search(data, start + _CHUNK)
        if space is None:
            break
        yield _keys(data[start : space.start()])
        start = space.end()
    yield [*_keys(data[start:] if start else data), END]


def _keys(data: bytes) -> list[bytes]:
    words = data.lower().split()  # bytes: ASCII letters and ASCII white space only
    if max(map(len, words), default=0) > 32:
        return [w if len(w) <= 32 else END + md5(w).digest() for w in words]
    return words


def _documents(docs: DataFrame) -> DataFrame:
    return columns_as(docs, doc_id="doc_id", text="text").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        is_held_out(F.col("doc_id"), 10, 0).alias("held_out"),
    )


def token_counts(docs: DataFrame) -> DataFrame:
    """(key, n) of every token of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column("text"):
                for keys in chunks(text.as_py()):
                    held.update(keys)
                    if len(held) > _DISTINCT:
                        yield _counted(held)
                        held = Counter()
        if held:
            yield _counted(held)

    parts = docs.select("text").mapInArrow(count, "key binary, n long")
    return parts.groupBy("key").agg(F.sum("n").alias("n"))


def _counted(held: Counter) -> pa.RecordBatch:
    keys, n = pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())
    return pa.RecordBatch.from_arrays([keys, n], ["key", "n"])


@dataclass(frozen=True)
class Vocabulary:
    """The most frequent tokens with their counts (most frequent first, the end always first),
    and totals over all tokens."""

    keys: list[bytes]
    counts: np.ndarray
    tokens: int
    types: int
    classes: int

    def rare_mass(self) -> float:
        """Smoothed counts of all words without a class, and one for unseen ones."""
        known = int(self.counts[: self.classes].sum())
        named = int((self.counts[: self.classes] > 0).sum())
        return self.tokens - known + SMOOTH * (self.types - named + 1)

    def unigrams(self) -> np.ndarray:
        """Smoothed share of each class; that of all other words comes last."""
        mass = np.append(self.counts[: self.classes] + SMOOTH, self.rare_mass())
        return mass / mass.sum()


def vocabulary(counts: DataFrame, head: int = HEAD, classes: int = CLASSES) -> Vocabulary:
    """Totals and frequent tokens. Tokens are cut by count, at the finest of some thousand
    steps that leaves at most ``head`` of them, so nothing is sorted in one task."""
    grade = F.floor(F.log2("n") * 64).cast("int")
    graded = counts.groupBy(grade.alias("grade")).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")
    )
    steps = sorted(graded.collect(), key=lambda row: -row.grade)
    least, left = None, head
    for row in steps:
        left -= row.types
        if left < 0:
            break
        least = row.grade
    if least is None:
        keys, n = [], []
    else:
        found = counts.where(grade >= least).toArrow()
        keys, n = found.column("key").to_pylist(), found.column("n").to_pylist()
    of = dict(zip(keys, n, strict=True))
    end = of.pop(END, None)
    if end is None:
        end = next((row.n for row in counts.where(F.col("key") == END).collect()), 0)
    words = sorted(of, key=lambda key: (-of[key], key))
    held = np.array([end, *[of[w] for w in words]], np.int64)
    totals = sum(row.n for row in steps), sum(row.types for row in steps)
    return Vocabulary([END, *words], held, *totals, min(classes, len(held)))


class Model:
    """Parameters in one vector, with views on its parts."""

    def __init__(self, classes: int, dims: int, flat: np.ndarray | None = None):
        size = classes * dims
        if flat is None:
            pick = np.random.default_rng(SEED)
            flat = np.zeros(2 * size + 2 * dims + classes, np.float32)
            flat[: 2 * size] = pick.standard_normal(2 * size) * 0.1
            flat[2 * size : 2 * size + 2 * dims] = 1
        self.flat = flat
        self.context = flat[:size].reshape(classes, dims)
        self.target = flat[size : 2 * size].reshape(classes, dims)
        self.scale = flat[2 * size : 2 * size + 2 * dims].reshape(2, dims)
        self.bias = flat[2 * size + 2 * dims :]
        self.shape = classes, dims

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of every token by the last token and by the one before it (bias within),
        and the log of the normaliser of every pair of them."""
        last = (self.context * self.scale[0]) @ self.target.T
        before = (self.context * self.scale[1]) @ self.target.T + self.bias
        tops = last.max(1), before.max(1)
        normal = np.exp(last - tops[0][:, None]) @ np.exp(before - tops[1][:, None]).T
        np.log(normal, out=normal)
        normal += tops[0][:, None]
        normal += tops[1][None, :]
        return last, before, normal


class Trainer:
    """Noise-contrastive estimation with a step width per parameter."""

    def __init__(self, model: Model, unigrams: np.ndarray, seed: int):
        self.model = Model(*model.shape, model.flat.copy())
        self._seen = Model(*model.shape, np.ones_like(model.flat))
        self._edges = np.cumsum(unigrams)
        self._offset = np.log(NOISE * unigrams).astype(np.float32)
        self._pick = np.random.default_rng(seed)
        self._waiting: list[np.ndarray] = []
        self._size = self.tokens = 0

    def add(self, grams: np.ndarray) -> None:
        """Rows of (last, before, token)."""
        self._waiting.append(grams)
        self._size += len(grams)
        if self._size >= 16 * STEP:
            self.flush()

    def flush(self) -> None:
        if self._size:
            grams = np.concatenate(self._waiting)
            for start in range(0, len(grams), STEP):
                self._step(*grams[start : start + STEP].T)
            self.tokens += self._size
        self._waiting, self._size = [], 0

    def _step(self, last: np.ndarray, before: np.ndarray, token: np.ndarray) -> None:
        m = self.model
        noise = np.searchsorted(self._edges, self._pick.random(NOISE) * self._edges[-1])
        noise = np.minimum(noise, len(self._edges) - 1)
        one, two = m.context[last], m.context[before]
        wanted = one * m.scale[0] + two * m.scale[1]
        true, false = m.target[token], m.target[noise]
        score = np.einsum("ij,ij->i", wanted, true) + m.bias[token] - self._offset[token]
        others = wanted @ false.T + (m.bias - self._offset)[noise]
        up, down = _sigmoid(-score), -_sigmoid(others)
        to_wanted = up[:, None] * true + down @ false
        self._move("scale", None, np.stack([(to_wanted * one).sum(0), (to_wanted * two).sum(0)]))
        self._move(
            "context",
            np.concatenate([last, before]),
            np.concatenate([to_wanted * m.scale[0], to_wanted * m.scale[1]]),
        )
        places = np.concatenate([token, noise])
        self._move("target", places, np.concatenate([up[:, None] * wanted, down.T @ wanted]))
        self._move("bias", places, np.concatenate([up, down.sum(0)]))

    def _move(self, name: str, places: np.ndarray | None, slope: np.ndarray) -> None:
        values, seen = getattr(self.model, name), getattr(self._seen, name)
        if places is None:
            at = slice(None)
        else:
            order = np.argsort(places, kind="stable")
            ranked = places[order]
            starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
            slope, at = np.add.reduceat(slope[order], starts, axis=0), ranked[starts]
        seen[at] += slope * slope
        values[at] += RATE * slope / np.sqrt(seen[at])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


def _grams(classes: np.ndarray, tail: list[int]) -> np.ndarray:
    """(last, before, token) of each token, after the two classes in ``tail``."""
    line = np.concatenate([tail, classes])
    return np.stack([line[1:-1], line[:-2], line[2:]], axis=1)


class Coder:
    """Places of tokens among the frequent ones, and their classes."""

    def __init__(self, words: Vocabulary):
        self.words = words
        self._place = {key: i for i, key in enumerate(words.keys)}

    def places(self, keys: list[bytes]) -> np.ndarray:
        found = self._place.get
        return np.array([found(key, -1) for key in keys], np.int64)

    def classes(self, places: np.ndarray) -> np.ndarray:
        rare = self.words.classes
        return np.where((places < 0) | (places >= rare), rare, places)


_HELD: dict = {}


def _latest(name: str, identity: str, make: Callable):
    """What a worker made of the last shared value under ``name``; older ones are let go."""
    if _HELD.get(name, (None, None))[0] != identity:
        _HELD.pop(name, None)
        _HELD[name] = identity, make()
    return _HELD[name][1]


def _coder(shared) -> Coder:
    return _latest("words", shared.id, lambda: Coder(shared.value))


class _Shared:
    """A broadcast value under a name of its own, so that workers keep what they make of it."""

    def __init__(self, spark, value):
        self._held = spark.sparkContext.broadcast(value)
        self.id = f"{spark.sparkContext.applicationId}-{self._held._jbroadcast.id()}"

    def __getstate__(self):
        return {"_held": self._held, "id": self.id}

    @property
    def value(self):
        return self._held.value


def train(docs: DataFrame, words: _Shared, dims: int = DIMS, rounds: int = ROUNDS) -> Model:
    """The mean of the partitions' models, round by round, over all texts of ``docs``."""
    vocabulary_ = words.value
    unigrams = vocabulary_.unigrams()
    model = Model(vocabulary_.classes + 1, dims)
    model.bias[:] = np.log(unigrams)
    share = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(rounds))
    for number in range(rounds):
        start = model.flat

        def fitted(batches: Iterator[pa.RecordBatch], start=start, number=number) -> Iterable[np.ndarray]:
            coder = _coder(words)
            trainer = Trainer(Model(len(unigrams), dims, start), unigrams, SEED + number)
            for batch in batches:
                for text in batch.column("text"):
                    tail = [0, 0]
                    for keys in chunks(text.as_py()):
                        classes = coder.classes(coder.places(keys))
                        trainer.add(_grams(classes, tail))
                        tail = [*tail, *classes[-2:].tolist()][-2:]
            trainer.flush()
            if trainer.tokens:
                yield np.append(trainer.model.flat.astype(np.float64) * trainer.tokens, trainer.tokens)

        found = summed(docs.where(share == number).select("text"), fitted, at_once=8)
        if found is not None:
            model = Model(*model.shape, (found[:-1] / found[-1]).astype(np.float32))
    return model


class Scorer:
    """Log10 probabilities of tokens by model and base, with those of rare words left open."""

    def __init__(self, words: Vocabulary, coder: Coder, model: Model):
        self._coder = coder
        self._last, self._before, self._normal = model.tables()
        self._log = np.log10(words.counts + SMOOTH)
        self._seen = words.counts > 0
        self._classes = words.classes
        self._base = np.log10(words.tokens + SMOOTH * (words.types + 1))
        self._rare = np.log10(words.rare_mass())

    def log10(self, last: np.ndarray, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Log10 probabilities of classes after their contexts."""
        score = self._last[last, token].astype(np.float64) + self._before[before, token]
        return (score - self._normal[last, before]) / np.log(10)

    def part(self, keys: list[bytes], tail: list[int]) -> tuple[int, float, float, list[bytes], list[int]]:
        """Known tokens, base and model score of a chunk after the classes in ``tail``, less the
        log10 of rare words' smoothed counts; those words' keys; the new tail."""
        places = self._coder.places(keys)
        classes = self._coder.classes(places)
        frequent = places >= 0
        logs = self._log[places[frequent]]
        scores = self.log10(*_grams(classes, tail).T)
        inside = logs[places[frequent] >= self._classes].sum()
        others = int((classes == self._classes).sum())
        return (
            int(self._seen[places[frequent]].sum()),
            float(logs.sum() - self._base * len(keys)),
            float(scores.sum() + inside - self._rare * others),
            [keys[i] for i in np.flatnonzero(~frequent)],
            [*tail, *classes[-2:].tolist()][-2:],
        )


_PART = """row long, doc_id long, held_out boolean, n_tokens long, n_known long,
    base_score double, score double, rare array<binary>"""


def scored_parts(docs: DataFrame, words: _Shared, model: _Shared) -> DataFrame:
    """Sums of each chunk of each text; keys of words whose counts are not at hand are added,
    a bounded list a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(words)
        scorer = _latest("scorer", model.id, lambda: Scorer(words.value, coder, model.value))
        for batch in batches:
            made = []
            for row, doc_id, held_out, text in zip(*(batch.column(i) for i in range(4)), strict=True):
                head, tail = (row.as_py(), doc_id.as_py(), held_out.as_py()), [0, 0]
                for keys in chunks(text.as_py()):
                    known, base, score, rare, tail = scorer.part(keys, tail)
                    made.append((*head, len(keys), known, base, score, rare[:_RARE_KEYS]))
                    for i in range(_RARE_KEYS, len(rare), _RARE_KEYS):
                        made.append((*head, 0, 0, 0.0, 0.0, rare[i : i + _RARE_KEYS]))
                    if len(made) >= 2000:
                        yield _rows(made)
                        made = []
            if made:
                yield _rows(made)

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    return numbered.mapInArrow(run, _PART)


def _rows(made: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(),
             pa.list_(pa.binary())]
    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"]
    arrays = [pa.array(list(c), k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names)


def scores(
    docs: DataFrame,
    head: int = HEAD,
    classes: int = CLASSES,
    dims: int = DIMS,
    rounds: int = ROUNDS,
) -> DataFrame:
    """Every document's base and model score; texts that are not held out teach."""
    spark, named = docs.sparkSession, _documents(docs)
    teaching = named.where(~F.col("held_out"))
    counts = stage(token_counts(teaching), "lm-counts")
    words = vocabulary(counts, head, classes)
    shared = _Shared(spark, words)
    model = _Shared(spark, train(teaching, shared, dims, rounds))
    parts = stage(scored_parts(named, shared, model), "lm-parts")
    rare = parts.select("row", "doc_id", "held_out", F.explode("rare").alias("key"))
    found = rare.join(counts, "key", "left")
    log = F.log10(F.coalesce("n", F.lit(0)) + F.lit(SMOOTH))
    key = ["row", "doc_id", "held_out"]
    joined = found.select(
        *key,
        F.lit(0).cast("long").alias("n_tokens"),
        F.col("n").isNotNull().cast("long").alias("n_known"),
        log.alias("base_score"),
        log.alias("score"),
    )
    whole = parts.drop("rare").unionByName(joined).groupBy(*key)
    sums = whole.agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return sums.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(words.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
