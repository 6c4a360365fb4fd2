"""Benchmark decontamination with an FM-index per shard of documents.

A shard's words are written as symbols: words of the test phrases have a number, all others
are breaks that no phrase crosses (a lossless reduction: an occurrence holds phrase words
only, so runs of them that are shorter than the shortest phrase are breaks too). The shard's
FM-index is a wavelet tree over the Burrows-Wheeler transform of these runs; all phrases are
searched backwards at once, their occurrences are located by sampled suffix positions, and the
located spans are merged per document.

Phrases are searched in blocks of bounded size, each over every shard, so neither the tests
nor a shard's index need to fit a task whole, however many they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from fleetpulse.llm.common import columns_as
from fleetpulse.session import stage

# The words and the window length that results must follow.
_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 10
#: Words of test phrases that are handed to all tasks at once; more are taken in blocks.
BLOCK_WORDS = 1_000_000
#: A shard's index is built when its runs hold so many symbols (one document may exceed it).
SHARD_SYMBOLS = 400_000
#: Rows that are read together, and that share an index at most.
SLICE_ROWS, SHARD_ROWS = 250, 20_000
#: Every so many positions of a run keep their place.
SAMPLE = 8


def words_of(text: str | None) -> list[bytes]:
    """Words of the text with A-Z lower-cased, as UTF-8."""
    return _WORDS.findall(text.encode().lower()) if text else []


class Phrases:
    """The distinct windows of some items, as rows of word numbers (from 1; 0 pads on the left),
    and the items that each window stands for."""

    def __init__(self, items: list[tuple[int, str]]):
        self.numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[int]] = {}
        for place, (_, text) in enumerate(items):
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)]
            for start in range(max(1, len(ids) - WINDOW + 1)) if ids else ():
                owners.setdefault(tuple(ids[start : start + WINDOW]), set()).add(place)
        self.items = [item for item, _ in items]
        self.lengths = np.array([len(w) for w in owners], np.int64)
        self.rows = np.zeros((len(owners), WINDOW), np.int64)
        for row, window in enumerate(owners):
            self.rows[row, WINDOW - len(window) :] = window
        self.owners = [sorted(places) for places in owners.values()]
        self.shortest = int(self.lengths.min()) if len(owners) else 0


class WaveletTree:
    """Ranks of symbols by bit planes, most significant first, each stably parted in two."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.depth = max(1, int(largest).bit_length())
        self.planes, self.zeros = [], []
        for bit in range(self.depth - 1, -1, -1):
            ones = (symbols >> bit) & 1
            self.planes.append(np.concatenate([[0], np.cumsum(ones)]))
            self.zeros.append(len(symbols) - int(self.planes[-1][-1]))
            symbols = np.concatenate([symbols[ones == 0], symbols[ones == 1]])

    def _walk(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for level, (plane, zeros) in enumerate(zip(self.planes, self.zeros, strict=True)):
            ones = plane[place]
            bit = (symbol >> (self.depth - 1 - level)) & 1
            place = np.where(bit == 1, zeros + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._walk(symbol, place) - self._walk(symbol, np.zeros_like(place))

    def symbol_at(self, place: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(place)
        for plane, zeros in zip(self.planes, self.zeros, strict=True):
            ones = plane[place]
            bit = plane[place + 1] - ones
            symbol = symbol << 1 | bit
            place = np.where(bit == 1, zeros + ones, place - ones)
        return symbol


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; breaks (symbol 0) differ by their place."""
    n = len(symbols)
    breaks = np.cumsum(symbols == 0)
    rank = np.where(symbols == 0, breaks - 1, symbols + breaks[-1])
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        step *= 2
        if fresh[-1] == n - 1 or step >= n:
            return order


class FmIndex:
    """Counts and places of phrases in symbols whose runs are parted by breaks (0)."""

    def __init__(self, symbols: np.ndarray, largest: int):
        order = suffix_order(symbols)
        self.tree = WaveletTree(symbols[order - 1], largest)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=largest + 1))])
        # Positions are sampled by their distance from the last break, so no walk meets one.
        places = np.arange(len(symbols))
        start = np.maximum.accumulate(np.where(symbols == 0, places, -1))
        kept = ((places - start - 1) % SAMPLE == 0) | (symbols == 0)
        self._sampled = kept[order]
        self._sample_at = np.cumsum(self._sampled) - 1
        self._samples = order[self._sampled]

    def search(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix interval of each phrase; phrases are padded with 0 on the left."""
        low = np.zeros(len(rows), np.int64)
        high = np.full(len(rows), self.first[-1], np.int64)
        for column in range(rows.shape[1] - 1, -1, -1):
            live = np.flatnonzero((rows[:, column] > 0) & (high > low))
            symbol = rows[live, column]
            low[live] = self.first[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.tree.rank(symbol, high[live])
        return low, high

    def locate(self, suffixes: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: step back to the next sampled one."""
        at, steps = suffixes.copy(), np.zeros(len(suffixes), np.int64)
        live = np.flatnonzero(~self._sampled[at])
        while len(live):
            symbol = self.tree.symbol_at(at[live])
            at[live] = self.first[symbol] + self.tree.rank(symbol, at[live])
            steps[live] += 1
            live = live[~self._sampled[at[live]]]
        return self._samples[self._sample_at[at]] + steps


class Shard:
    """The runs of phrase words of some documents."""

    def __init__(self, phrases: Phrases):
        self._phrases = phrases
        self._documents = 0
        self.size = 1
        # Each part is a break and a run; with it, its document and the run's first word.
        self._symbols: list[np.ndarray] = []
        self._runs: list[tuple[int, int]] = []

    def add(self, ids: np.ndarray) -> None:
        known = np.concatenate([[0], (ids > 0).astype(np.int8), [0]])
        edges = np.diff(known)
        starts, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        good = stops - starts >= max(1, self._phrases.shortest)
        for start, stop in zip(starts[good].tolist(), stops[good].tolist(), strict=True):
            self._symbols.append(np.concatenate([[0], ids[start:stop]]))
            self._runs.append((self._documents, start))
            self.size += stop - start + 1
        self._documents += 1

    def hits(self) -> list[tuple[list[tuple[int, int]], list[int]]]:
        """Per document: merged spans of words inside occurrences, and the items found."""
        spans: list[list[tuple[int, int]]] = [[] for _ in range(self._documents)]
        found: list[set[int]] = [set() for _ in range(self._documents)]
        if self._symbols and len(self._phrases.rows):
            symbols = np.concatenate([*self._symbols, [0]]).astype(np.int64)
            index = FmIndex(symbols, len(self._phrases.numbers))
            low, high = index.search(self._phrases.rows)
            counts = high - low
            phrase = np.repeat(np.arange(len(counts)), counts)
            first = np.cumsum(counts) - counts
            suffixes = np.arange(counts.sum()) - first[phrase] + low[phrase]
            places = index.locate(suffixes)
            begins = np.cumsum([0] + [len(s) for s in self._symbols[:-1]])
            run = np.searchsorted(begins, places, "right") - 1
            offsets = places - begins[run] - 1
            order = np.argsort(places, kind="stable")
            for r, offset, p in zip(
                run[order].tolist(), offsets[order].tolist(), phrase[order].tolist(), strict=True
            ):
                document, base = self._runs[r]
                start = base + offset
                stop = start + int(self._phrases.lengths[p])
                own = spans[document]
                if own and start <= own[-1][1]:
                    own[-1] = own[-1][0], max(own[-1][1], stop)
                else:
                    own.append((start, stop))
                found[document].update(self._phrases.owners[p])
        return [(s, sorted(f)) for s, f in zip(spans, found, strict=True)]


def _blocks(tests: DataFrame) -> Iterator[Phrases]:
    """Blocks of items with about ``BLOCK_WORDS`` words each, dealt by a hash of the item."""
    words = F.coalesce(F.sum(F.length("text")), F.lit(0)) / 4
    count = int(tests.agg(words.alias("n")).first().n // BLOCK_WORDS) + 1
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    for number in range(count):
        rows = tests.where(block == number).collect()
        yield Phrases(sorted({(row.item_id, row.text) for row in rows if row.text}, key=repr))


def _searched(
    batches: Iterator[pa.RecordBatch], phrases: Phrases, text: str
) -> Iterator[tuple[pa.RecordBatch, list[int], list]]:
    """Slices of the batches with the word count and the hits of each of their rows; an index
    covers all slices since the last one was full."""
    number = phrases.numbers.get
    shard, waiting = Shard(phrases), []

    def flush():
        hits, at = shard.hits(), 0
        for part, counts in waiting:
            yield part, counts, hits[at : at + len(counts)]
            at += len(counts)

    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            part, counts = batch.slice(start, SLICE_ROWS), []
            for value in part.column(text):
                words = words_of(value.as_py())
                shard.add(np.fromiter(map(number, words, repeat(0)), np.int64, len(words)))
                counts.append(len(words))
            waiting.append((part, counts))
            if shard.size >= SHARD_SYMBOLS or len(waiting) * SLICE_ROWS >= SHARD_ROWS:
                yield from flush()
                shard, waiting = Shard(phrases), []
    yield from flush()


def _search(docs: DataFrame, phrases: Phrases) -> DataFrame:
    """doc_id, row, n_words, spans and items of one block of phrases."""
    shared = docs.sparkSession.sparkContext.broadcast(phrases)  # at most one block of phrases

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value.items
        for part, counts, hits in _searched(batches, shared.value, "text"):
            spans = [[[s, e] for s, e in own] for own, _ in hits]
            names = [[items[i] for i in found] for _, found in hits]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("row"),
                    pa.array(counts, pa.int64()),
                    pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                    pa.array(names, pa.list_(pa.int64())),
                ],
                names=["doc_id", "row", "n_words", "spans", "items"],
            )

    schema = "doc_id long, row long, n_words long, spans array<array<bigint>>, items array<bigint>"
    return docs.mapInArrow(run, schema)


@F.udf(ArrayType(ArrayType(LongType())), useArrow=True)
def _merged(spans):
    out: list[list[int]] = []
    for start, stop in sorted(map(tuple, spans)):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return out


def contamination(docs: DataFrame, tests: DataFrame) -> DataFrame:
    """One row per document: n_words, spans (merged [first, after last] word places inside any
    occurrence of a window) and items (ids whose windows occur, ascending).

    Null and empty texts have no words; null and empty tests have no windows; repeated tests
    count once, as do the texts of one id; a null test id is marked but not named. Every row
    keeps a row, however many blocks the tests take: with several, rows are numbered and written
    once, and the number brings together what each block finds in a row.
    """
    docs = columns_as(docs, doc_id="doc_id", text="text").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        "text",
    )
    blocks = _blocks(columns_as(tests, item_id="item_id", text="text"))
    first, second = next(blocks), next(blocks, None)
    if second is None:
        found = _search(docs, first)
    else:
        docs = stage(docs, "numbered")  # numbers differ from one reading to the next
        every = stage(_search(docs, first), "contamination")
        for block in chain([second], blocks):
            every = every.union(stage(_search(docs, block), "contamination"))
        found = every.groupBy("row", "doc_id").agg(
            F.max("n_words").alias("n_words"),
            _merged(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.flatten(F.collect_list("items")).alias("items"),
        )
    items = F.array_sort(F.array_distinct("items")).alias("items")
    return found.select("doc_id", "n_words", "spans", items)


def contamination_report(docs: DataFrame, tests: DataFrame) -> DataFrame:
    """``contamination`` with spans and items as counts and a hash of the item ids."""
    found = contamination(docs, tests)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    names = F.transform(
        F.filter("items", lambda i: i.isNotNull()), lambda i: i.cast("string")
    )
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(names), ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        "spans",
    ).withColumn("spans", F.to_json("spans"))


def drop_contaminated(docs: DataFrame, tests: DataFrame) -> DataFrame:
    """The documents without a hit, with all their columns: each row is judged where it is read,
    by its own text, once for each block of tests."""

    def clean(rows: DataFrame, phrases: Phrases) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast(phrases)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, _, hits in _searched(batches, shared.value, "text"):
                yield part.filter(pa.array([not spans for spans, _ in hits], pa.bool_()))

        return rows.mapInArrow(run, rows.schema)

    for phrases in _blocks(columns_as(tests, item_id="item_id", text="text")):
        docs = clean(docs, phrases)
    return docs
