"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

One pair of files per sorted range of documents, all in one folder that every executor and
reader shares:

* ``<name>.ids``: the ids of all its documents, back to back, as little-endian unsigned
  integers of the smallest width that holds the vocabulary (2 or 4 bytes);
* ``<name>.docs``: little-endian 64-bit integers, three per document: its doc_id, the offset
  of its first id and the offset after its last one, both counted in ids from the file's start
  (a document without an id has the complement of its first offset).

A manifest table lists the files in order. The base of each file in the whole corpus is the
prefix sum of the token counts of the files before it. Each task attempt writes files with
names of its own and lists them only when it succeeds, so the files of lost or repeated
attempts are never read.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.llm.common import ByteMemo, columns_as, once_per_worker
from fleetpulse.session import scratch_path, stage

_SPECIAL = "<|"
#: First bytes of U+0300 to U+037F, which hold every mark that an ASCII letter composes with.
_MARKS = (b"\xcc", b"\xcd")
_MANIFEST = "part long, name string, docs long, tokens long"
#: Bytes of each of two generations of memoised chunks, and chunks encoded in one call.
_MEMO, _AT_ONCE = 160 * 2**20, 2000


class ChunkEncoder:
    """Encode whole texts with a ``tokenizers`` file, white-space chunk by chunk.

    For a tokenizer that lower-cases, drops white space and never joins text across it, the
    ids of a text are those of its ASCII-white-space chunks in order; so chunks are memoised as
    packed bytes, and those of a text that the memo lacks are encoded in one call and told
    apart by their offsets. ASCII letters are lower-cased before, for more hits, unless a
    combining mark may follow them: the tokenizer composes first, and chunks with such marks
    are encoded alone. Texts that may hold a special token's string are encoded whole.
    """

    def __init__(self, path: str, dtype: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self._tokenizer, self._dtype = Tokenizer.from_file(path), dtype
        self._memo = ByteMemo(_MEMO)

    def _encode(self, text: str) -> bytes:
        ids = self._tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, self._dtype).tobytes()

    def _apart(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, from one call for all."""
        texts = [piece.decode() for piece in pieces]
        starts = np.cumsum([0, *[len(text) + 1 for text in texts[:-1]]])
        found = self._tokenizer.encode(" ".join(texts), add_special_tokens=False)
        ids = np.array(found.ids, self._dtype)
        begins = np.fromiter((begin for begin, _ in found.offsets), np.int64, len(ids))
        cuts = (np.searchsorted(begins, starts[1:]) * ids.itemsize).tolist()
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True)]

    def _learned(self, chunks: set[bytes]) -> dict[bytes, bytes]:
        """Ids of chunks that the memo lacks."""
        made, parts = {}, {}
        for chunk in chunks:
            lower = chunk.lower() if chunk.isascii() else chunk
            # Between a letter or digit and a final run of full stops or commas a new piece starts.
            core = lower.rstrip(b".,")
            split = core != lower and core[-1:].isalnum()
            parts[chunk] = (core, lower[len(core) :]) if split else (lower,)
        needed = {piece for split in parts.values() for piece in split}
        alone, joined = [], []
        for piece in needed:
            known = self._memo.new.get(piece) or self._memo.older(piece)
            if known is not None:
                made[piece] = known
            elif any(mark in piece for mark in _MARKS):
                alone.append(piece)
            else:
                joined.append(piece)
        made |= {piece: self._encode(piece.decode()) for piece in alone}
        for start in range(0, len(joined), _AT_ONCE):
            group = joined[start : start + _AT_ONCE]
            made |= zip(group, self._apart(group), strict=True)
        for piece in (*alone, *joined):
            self._memo.put(piece, made[piece])
        for chunk, split in parts.items():
            if chunk not in made:
                made[chunk] = b"".join([made[piece] for piece in split])
                self._memo.put(chunk, made[chunk])
        return made

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _SPECIAL in text:
            return self._encode(text)
        data = text.encode()
        if not any(lead in data for lead in _MARKS):
            data = data.lower()
        chunks = data.split()
        found = list(map(self._memo.new.get, chunks))
        if None in found:
            lacking = {chunk for chunk, ids in zip(chunks, found, strict=True) if ids is None}
            old = {chunk: ids for chunk in lacking if (ids := self._memo.older(chunk)) is not None}
            made = self._learned(lacking - old.keys()) | old
            found = [made[chunk] if ids is None else ids for chunk, ids in zip(chunks, found, strict=True)]
        return b"".join(found)


def id_type(tokenizer_path: str) -> str:
    from tokenizers import Tokenizer

    size = Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True)
    return "<u2" if size <= 2**16 else "<u4"


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write the files in ascending ``id_col`` order and return their manifest.

    A null or empty text has only the end id; null ids come first; rows that repeat an id
    follow each other in the order of their texts; an empty table gives an empty manifest.
    Other columns are ignored.
    """
    dtype = id_type(tokenizer_path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = once_per_worker(
            ("chunks", tokenizer_path), lambda: ChunkEncoder(tokenizer_path, dtype)
        )
        end = np.array([end_id], dtype).tobytes()
        width, part = len(end), TaskContext.get().partitionId()
        name = f"{part:06d}-{uuid.uuid4().hex}"
        written = docs = 0
        ids_out = docs_out = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if ids_out is None:
                where, root = pafs.FileSystem.from_uri(_uri(folder))
                where.create_dir(root, recursive=True)
                ids_out = where.open_output_stream(f"{root}/{name}.ids")
                docs_out = where.open_output_stream(f"{root}/{name}.docs")
            index = np.empty((batch.num_rows, 3), "<i8")
            held = batch.column("doc_id")
            keys = held.fill_null(0).to_numpy(zero_copy_only=False)
            nulls = held.is_null().to_numpy(zero_copy_only=False)
            for row, text in enumerate(batch.column("text")):
                packed = encode(text.as_py()) + end
                ids_out.write(packed)
                # The start of a document without an id is written as its complement.
                start = ~written if nulls[row] else written
                index[row] = keys[row], start, written + len(packed) // width
                written += len(packed) // width
            docs_out.write(index.tobytes())
            docs += batch.num_rows
        if ids_out is not None:
            ids_out.close()
            docs_out.close()
            yield pa.RecordBatch.from_pylist(
                [{"part": part, "name": name, "docs": docs, "tokens": written}]
            )

    rows = columns_as(docs, doc_id=id_col, text=text_col)
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("long"))
    # Rows that share an id, or have none, are spread by the beginnings of their texts.
    ranged = rows.repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions(
        "doc_id", "text"
    )
    files = stage(ranged.mapInArrow(write, _MANIFEST), "token-files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.select(
        F.lit(folder).alias("folder"),
        F.lit(dtype).alias("dtype"),
        *files.columns,
        F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"),
    )


def _uri(path: str) -> str:
    return path if ":" in path.split("/")[0] else f"file://{os.path.abspath(path)}"


class TokenFile:
    """One pair of files, memory-mapped where the folder is a mounted one."""

    def __init__(self, folder: str, name: str, dtype: str):
        where, root = pafs.FileSystem.from_uri(_uri(folder))
        index = where.open_input_stream(f"{root}/{name}.docs").readall()
        self.index = np.frombuffer(index, "<i8").reshape(-1, 3)
        self._dtype, path = np.dtype(dtype), f"{root}/{name}.ids"
        if isinstance(where, pafs.LocalFileSystem):
            self._ids = np.memmap(path, self._dtype, mode="r")
        else:
            self._ids, self._remote = None, where.open_input_file(path)

    def ids(self, start: int, stop: int) -> np.ndarray:
        if self._ids is not None:
            return self._ids[start:stop]
        width = self._dtype.itemsize
        data = self._remote.read_at((stop - start) * width, start * width)
        return np.frombuffer(data, self._dtype)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document, read back from the files: doc_id, start (ids of all documents
    before it), n_tokens (with the end id) and the crc32 of its ids as 32-bit integers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.to_pylist():
                tokens = TokenFile(file["folder"], file["name"], file["dtype"])
                for block in np.array_split(tokens.index, len(tokens.index) // 10_000 + 1):
                    nameless = block[:, 1] < 0
                    begins = np.where(nameless, ~block[:, 1], block[:, 1])
                    sums = [
                        zlib.crc32(tokens.ids(lo, hi).astype("<u4").tobytes())
                        for lo, hi in zip(begins.tolist(), block[:, 2].tolist(), strict=True)
                    ]
                    keys = pa.array(block[:, 0], pa.int64(), mask=nameless)
                    starts = pa.array(begins + file["base"])
                    counts = pa.array(block[:, 2] - begins)
                    yield pa.RecordBatch.from_arrays(
                        [keys, starts, counts, pa.array(sums, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    # A number of partitions, so that few small manifest rows do not end up in one task.
    spread = manifest.repartition(max(1, manifest.count()), F.col("name"))
    return spread.mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def token_file_index(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and read them back."""
    folder = scratch_path(docs.sparkSession, "token-ids")
    return read_token_files(write_token_files(docs, folder, tokenizer_path, end_id))
