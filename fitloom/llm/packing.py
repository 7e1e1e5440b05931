"""Packing token sequences by bounded-space online best-fit.

Documents are tokenised and closed with id 2. A document longer than a sequence is
cut into pieces of exactly ``SEQUENCE`` tokens, its first piece taking the remainder, so a
document has at most one piece that is not a sequence by itself. Only these short pieces
are dealt to tasks and packed.

Each task packs its pieces online, in the order they arrive: a fixed number of bins is open;
a bitset has bit f set when some open bin has f tokens free, so the best fit for a piece of
n tokens is the lowest set bit at or above n. When no bin fits and all are open, the fullest
(lowest set bit) closes. Pieces arrive in hash order, which keeps large and small mixed.

Tokens: the ids are those of ``tokenizers`` with the given file. Texts made of ASCII and
Latin letters are encoded with the same vocabulary as ``tiktoken`` ranks, five times as
fast and equal id for id (tested); every other text, and one holding a special token's
string, goes through ``tokenizers`` itself.

Edge cases: NULL text counts as empty: one piece that holds only id 2; a text of any
length is tokenised whole; repeated rows are packed as often as they occur; an empty table
gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitloom.llm.common import scratch

SEQUENCE = 1024
CLOSE_ID = 2
OPEN_BINS = 1024
PIECES_PER_TASK = 50_000
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED_SCHEMA = PIECE_SCHEMA + ", sequence_id long, offset long"
# Characters on which both tokenizer libraries split alike in every Unicode version.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-ɏ‐-‧‰-⁞]*")


class Encoder:
    """Token ids of whole texts; built once per task from the vocabulary files."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return self.fast.encode_ordinary(text)
        return self.exact.encode(text, add_special_tokens=False).ids


def cut(ids: list[int], sequence: int) -> Iterator[tuple[int, int]]:
    """(start, length) of each piece: the remainder first, then whole sequences."""
    first = len(ids) % sequence or min(len(ids), sequence)
    start, end = 0, first
    while start < len(ids):
        yield start, end - start
        start, end = end, end + sequence


def _default_files() -> tuple[str, str, str]:
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def pieces(docs: DataFrame, files: tuple[str, str, str] | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """One row per piece of every document. ``files``: tokenizer JSON, its ranks and split pattern."""

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*(files or _default_files()))
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encoder.ids(text.as_py() or "")
                ids.append(CLOSE_ID)
                raw = memoryview(array("I", ids).tobytes())
                for n, (start, length) in enumerate(cut(ids, sequence)):
                    row = (doc_id.as_py(), n, start, length, zlib.crc32(raw[4 * start:4 * (start + length)]))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tokenise, PIECE_SCHEMA)


class BestFit:
    """Bounded-space best-fit: ``place`` gives (bin number, offset in the bin) for a piece."""

    def __init__(self, size: int, open_bins: int):
        self.size, self.open_bins = size, open_bins
        self.free = 0  # bit f: an open bin has f tokens free
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]
        self.is_open = self.made = 0

    def _take(self, free: int) -> int:
        number = self.bins[free].pop()
        if not self.bins[free]:
            self.free ^= 1 << free
        self.is_open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        fits = self.free >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.is_open >= self.open_bins:
                self._take((self.free & -self.free).bit_length() - 1)
            number, free = self.made, self.size
            self.made += 1
        rest = free - length
        if rest:
            self.bins[rest].append(number)
            self.free |= 1 << rest
            self.is_open += 1
        return number, self.size - free


def pack(docs: DataFrame, files: tuple[str, str, str] | None = None, sequence: int = SEQUENCE,
         open_bins: int = OPEN_BINS) -> DataFrame:
    """Every piece with its sequence_id and offset; offsets in a sequence are gapless from 0."""
    cut_up = scratch(pieces(docs, files, sequence), "pack-pieces")
    whole = cut_up.where(F.col("length") == sequence).select(
        "*", (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = cut_up.where(F.col("length") < sequence)
    tasks = max(1, -(-short.count() // PIECES_PER_TASK))

    def best_fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins, base = BestFit(sequence, open_bins), TaskContext.get().partitionId() << 32
        for batch in batches:
            placed = [bins.place(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([(base + b) * 2 for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())],
                names=[*batch.schema.names, "sequence_id", "offset"])

    # dealt in turn, not by key: a third of the rows may share one doc_id
    dealt = short.repartition(tasks).sortWithinPartitions(F.xxhash64("doc_id", "ids_crc32"), "doc_id", "piece")
    return dealt.mapInArrow(best_fit, PACKED_SCHEMA).unionByName(whole)
