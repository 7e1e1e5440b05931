"""Alignment of two tokenizers' tokens over the same bytes, by sparse incidence products.

A text is encoded by tokenizer A (byte-level BPE) and B (pieces with byte fallback). With
A the incidence matrix of A tokens x bytes and B that of B tokens x bytes, both hand-built CSR
(``indptr``, ``indices``), the rows of A.B' list for each A token the B tokens that share bytes with
it, with the number of shared bytes: the overlap links. Rows are formed by Gustavson's scheme: the
row of token i is the sum of the rows of B' that the row of A selects (:func:`product`). Byte
offsets where tokens of both sides end cut the text into groups; the product of the group
incidences lists the pairs of tokens in one group (:func:`group_links`); only its size is
kept corpus-wide, since a group of m and n tokens has m * n of them.

Both tokenizers begin a token at a single space between two other than white-space characters, so no
token, link or group crosses such a place, and texts of over ``SLICE`` characters are cut there. Products
are formed for some ``SLICE`` tokens of texts at a time, laid end to end: their tokens share no byte.

Corpus-wide counts of linked id pairs: a task adds up its links and sends each pair once per
``PENDING`` links; the sums are a Spark aggregate. Texts are tokenised once: their ids (two bytes a
token) lie in the shared folder for the second pass, which scores links by these sums. The most
frequent pairs, at most ``HEAD_PAIRS`` (16 MB) by a threshold on the count, are broadcast together with
the highest count of each B id (at most the vocabulary); every other link is sent as (row, pair, number)
to a join with the rest of the table. Both ways give the same sums, at every size.

Edge cases: NULL and empty texts, and texts whose joined A or B bytes differ from space + text (one
with U+2581), have no tokens: zeros and an empty groups_sha256. Texts of any length are multiplied in
slices cut at the places above. Repeated rows count as often as they occur; an empty table gives no
rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitloom.llm.common import scratch
from fitloom.llm.packing import PLAIN

SLICE = 1 << 19         # characters tokenised and tokens multiplied at a time, one slice at least
PENDING = 4_000_000     # sums a task holds before it adds them up, or sends them
HEAD_PAIRS = 1_000_000  # pairs whose counts are broadcast
PAIR = 1 << 20          # a pair (a, b) is the number a * PAIR + b; ids of both vocabularies lie below
# A single space between two characters that are no white space: tokens of both sides begin here.
CUT = re.compile(r" (?=\S)(?<=\S )")
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
ROW_SCHEMA = ("doc_id long, a_ids binary, b_ids binary, n_groups long, n_links long, n_group_links long, groups_sha256 string, "
              "pairs array<long>, pair_n array<long>")
SCORE_SCHEMA = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_group_links long, groups_sha256 string, "
                "n_best long, count_sum long, tail_pairs array<long>, tail_n array<long>")


# CSR products -----------------------------------------------------------------------
def pointers(sizes: np.ndarray) -> np.ndarray:
    """Row pointers of a CSR matrix from its row sizes."""
    out = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return out


def product(a_ptr: np.ndarray, a_idx: np.ndarray, b_ptr: np.ndarray, b_idx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pointers, columns and values of the product of two 0/1 CSR matrices, row by row as Gustavson's scheme forms them.

    Every entry k of a row of the first selects row k of the second; equal columns within a
    row of the result are added up (sorted runs stand for the usual dense accumulator).
    """
    row = np.repeat(np.arange(len(a_ptr) - 1), np.diff(a_ptr))
    if len(b_idx) == len(b_ptr) - 1 and np.array_equal(b_ptr, np.arange(len(b_ptr))):   # every row of the second has one entry
        col = b_idx[a_idx]
    else:
        picked = b_ptr[a_idx + 1] - b_ptr[a_idx]
        row = np.repeat(row, picked)
        col = b_idx[np.repeat(b_ptr[a_idx] - pointers(picked)[:-1], picked) + np.arange(len(row))]
    same_row = row[1:] == row[:-1]
    if np.any(same_row & (col[1:] < col[:-1])):
        order = np.lexsort((col, row))
        row, col = row[order], col[order]
        same_row = row[1:] == row[:-1]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(row)), bool), ~same_row | (col[1:] != col[:-1])]))
    values = np.diff(np.append(first, len(row)))
    return pointers(np.bincount(row[first], minlength=len(a_ptr) - 1)), col[first], values


def overlap_links(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A.B' of the token x byte incidences of two tokenisations of the same bytes (token sizes in bytes)."""
    n = int(a_sizes.sum())
    return product(pointers(a_sizes), np.arange(n), np.arange(n + 1), np.repeat(np.arange(len(b_sizes)), b_sizes))


def groups(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Group of each A and each B token, and the number of groups."""
    a_end, b_end = np.cumsum(a_sizes), np.cumsum(b_sizes)
    closes = np.zeros((2, int(a_end[-1]) + 1 if len(a_end) else 1), bool)
    closes[0, a_end], closes[1, b_end] = True, True
    upto = np.cumsum(closes[0] & closes[1])
    return upto[a_end - 1], upto[b_end - 1], int(upto[-1])


def group_links(a_group: np.ndarray, b_group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Product of the token x group incidence of A with the group x token incidence of B: pairs in one group."""
    return product(np.arange(len(a_group) + 1), a_group, pointers(np.bincount(b_group, minlength=n)), np.arange(len(b_group)))


# tokens -----------------------------------------------------------------------------
class Tokens:
    """The two tokenizers and the byte strings of their ids; built once per task from the vocabulary files."""

    def __init__(self, files: tuple[str, str, str, str] | None = None):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        if files is None:
            import public_tokenizers as P

            files = (P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, P.path("piece_bpe_32k.model"))
        json_path, ranks_path, pattern, piece_path = files
        self.exact = Tokenizer.from_file(json_path)
        self.exact.encode_special_tokens = True
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.a_bytes = [b""] * (max(ranks.values()) + 2)
        for b, i in ranks.items():
            self.a_bytes[i] = b
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := BYTE_PIECE.fullmatch(p)) else p.replace("▁", " ").encode() for p in names]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, t)), np.int64) for t in (self.a_bytes, self.b_bytes))
        self.flat = [(np.frombuffer(b"".join(t), np.uint8), pointers(s)) for t, s in ((self.a_bytes, self.a_sizes), (self.b_bytes, self.b_sizes))]
    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of space + ``text`` by both; None where the bytes do not come back."""
        whole = " " + text
        if PLAIN.fullmatch(whole):
            a = np.array(self.fast.encode_ordinary(whole), np.uint16)
        else:
            a = np.array(self.exact.encode(whole, add_special_tokens=False).ids, np.uint16)
        b, want = np.array(self.pieces.encode(text), np.uint16), whole.encode()
        return (a, b) if self.joined(a, 0) == want == self.joined(b, 1) else None

    def joined(self, ids: np.ndarray, side: int) -> bytes:
        """The bytes of the tokens, joined."""
        sizes, (flat, begin) = (self.a_sizes, self.b_sizes)[side][ids], self.flat[side]
        shift = begin[ids] - np.cumsum(sizes) + sizes
        return flat[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))].tobytes()


def slices(text: str) -> Iterator[str]:
    """A text in slices of some ``SLICE`` characters, cut where tokens of both sides begin."""
    start = 0
    while len(text) - start > SLICE and (m := CUT.search(text, start + SLICE)):
        yield text[start:m.start()]
        start = m.end()
    yield text[start:]


class Digits:
    """Writes ids in decimal, each followed by a given character, as arrays."""

    def __init__(self, n: int):
        texts = [str(i).encode() for i in range(n)]
        self.length = np.array(list(map(len, texts)), np.int8)
        self.digit = np.frombuffer(b"".join(t.ljust(6, b" ") for t in texts), np.uint8).reshape(n, 6)

    def write(self, ids: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The characters, and where each id ends."""
        cells = self.digit[ids]
        size = self.length[ids]
        cells[np.arange(len(ids)), size] = after
        return cells[np.arange(6, dtype=np.int8) <= size[:, None]], np.cumsum(size + np.int64(1))


def written(digits: Digits, a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray,
            in_a: np.ndarray, in_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3;``: the ids of each group (``in_a``, ``in_b``: tokens of each); and where each B id ends in it."""
    a_upto, b_upto = np.cumsum(in_a), np.cumsum(in_b)
    a_place = np.arange(len(a)) + (b_upto - in_b)[a_group]
    b_place = np.arange(len(b)) + a_upto[b_group]
    ids, after = np.empty(len(a) + len(b), np.uint16), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[a_place], ids[b_place] = a, b
    after[a_place[a_upto - 1]] = ord("|")
    after[b_place[b_upto - 1]] = ord(";")
    text, end = digits.write(ids, after)
    return text, end[b_place]


# links of whole texts ------------------------------------------------------------------
LINK_SCHEMA = ("doc_id long, a_ids array<long>, b_ids array<long>, a_group array<long>, b_group array<long>, "
               "link_ptr array<long>, link_b array<long>, link_bytes array<long>")


def links(docs: DataFrame, files: tuple[str, str, str, str] | None = None) -> DataFrame:
    """Token ids, groups and overlap links of every text.

    Links are CSR: A token i is linked with the B tokens ``link_b[link_ptr[i]:link_ptr[i + 1]]``, sharing
    ``link_bytes`` bytes with each. Texts without tokens have empty arrays.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(files)
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                found = tokens.encode(text.as_py()) if text.as_py() else None
                a, b = (x.astype(np.int64) for x in found or (np.zeros(0), np.zeros(0)))
                a_sizes, b_sizes = tokens.a_sizes[a], tokens.b_sizes[b]
                ptr, col, shared = overlap_links(a_sizes, b_sizes)
                a_group, b_group, _ = groups(a_sizes, b_sizes)
                columns = [a, b, a_group, b_group, ptr, col, shared]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id.as_py()], pa.int64())] + [pa.array([np.asarray(c, np.int64)], pa.list_(pa.int64())) for c in columns],
                    names=["doc_id", "a_ids", "b_ids", "a_group", "b_group", "link_ptr", "link_b", "link_bytes"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, LINK_SCHEMA)


# corpus counts ------------------------------------------------------------------------
def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and their numbers."""
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(values)), bool), values[1:] != values[:-1]]))
    return values[first], np.diff(np.append(first, len(values)))


def _summed(pairs: list[np.ndarray], numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    p, n = np.concatenate(pairs), np.concatenate(numbers)
    order = np.argsort(p)
    p, n = p[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])[:len(p)])
    return p[first], np.add.reduceat(n, first) if len(first) else n


class Sums:
    """Numbers of links per id pair, added up when ``PENDING`` sums wait."""

    def __init__(self):
        self.pairs, self.numbers, self.waiting = [], [], 0

    def add(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Sums to be sent, if too many are held."""
        pairs, numbers = runs(np.sort(pairs))
        self.pairs.append(pairs)
        self.numbers.append(numbers)
        self.waiting += len(pairs)
        if self.waiting > PENDING:
            held = self.close()
            if 2 * len(held[0]) > PENDING:
                return held
            self.pairs, self.numbers, self.waiting = [held[0]], [held[1]], len(held[0])
        return None

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        out = _summed(self.pairs, self.numbers)
        self.pairs, self.numbers, self.waiting = [], [], 0
        return out


def tokenised(docs: DataFrame, files: tuple[str, str, str, str] | None = None) -> DataFrame:
    """A row per document: its ids, numbers of links and groups; and rows (n_links NULL) that hold sums of linked id pairs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, sums = Tokens(files), Sums()
        digits = Digits(max(len(tokens.a_bytes), len(tokens.b_bytes)))
        lists = pa.list_(pa.int64())

        def blocks(batch: pa.RecordBatch) -> Iterator[list[tuple[int | None, str | None]]]:
            held, chars = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                held.append((doc_id, text))
                chars += len(text or "")
                if chars > SLICE:
                    yield held
                    held, chars = [], 0
            if held:
                yield held

        def measured(a: np.ndarray, b: np.ndarray, a_end: np.ndarray, b_end: np.ndarray) -> tuple:
            """For texts laid end to end, with the ends of their tokens: per text n_groups, n_links, n_group_links, the written groups."""
            a_sizes, b_sizes = tokens.a_sizes[a], tokens.b_sizes[b]
            ptr, col, _ = overlap_links(a_sizes, b_sizes)
            more = sums.add(np.repeat(a.astype(np.int64) * PAIR, np.diff(ptr)) + b[col])
            a_group, b_group, n = groups(a_sizes, b_sizes)
            in_a, in_b = np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)
            both = pointers(in_a * in_b)                                # row sizes of the group product
            text, end = written(digits, a, b, a_group, b_group, in_a, in_b)
            g_end = a_group[a_end - 1] + 1
            return np.diff(g_end, prepend=0), np.diff(ptr[a_end], prepend=0), np.diff(both[g_end], prepend=0), text, end[b_end - 1], more

        def sent(rows: list[tuple], more: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            rows += [(None,) * 7] * len(more)
            types = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            for k in (0, 1):
                columns.append(pa.array([None] * (len(rows) - len(more)) + [m[k] for m in more], lists))
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "a_ids", "b_ids", "n_groups", "n_links", "n_group_links",
                                                              "groups_sha256", "pairs", "pair_n"])

        for batch in batches:
            for block in blocks(batch):
                rows, more = [], []
                # every slice of a text on its own; a text counts only if the bytes of all its slices come back
                ids = [(k, tokens.encode(part)) for k, (_, text) in enumerate(block) if text for part in slices(text)]
                bad = {k for k, i in ids if i is None}
                good = [(k, i) for k, i in ids if k not in bad]
                totals, shas = {k: [[], [], 0, 0, 0] for k, _ in good}, {}
                while good:
                    take, held = 0, 0
                    while take < len(good) and (take == 0 or held + len(good[take][1][0]) <= SLICE):
                        held += len(good[take][1][0])
                        take += 1
                    now, good = good[:take], good[take:]
                    a_end, b_end = (np.cumsum([len(i[side]) for _, i in now]) for side in (0, 1))
                    a_ids, b_ids = (np.concatenate([i[side] for _, i in now]) for side in (0, 1))
                    n_groups, n_links, n_pairs, text, end, over = measured(a_ids, b_ids, a_end, b_end)
                    if over is not None:
                        more.append(over)
                    view, begin = memoryview(text), 0
                    for at, (k, i) in enumerate(now):
                        t = totals[k]
                        t[0].append(i[0].tobytes())
                        t[1].append(i[1].tobytes())
                        t[2] += int(n_groups[at])
                        t[3] += int(n_links[at])
                        t[4] += int(n_pairs[at])
                        sha = shas.get(k)
                        if sha is None:
                            sha = shas[k] = hashlib.sha256()
                        else:
                            sha.update(b";")
                        sha.update(view[begin:int(end[at]) - 1])
                        begin = int(end[at])
                for k, (doc_id, _) in enumerate(block):
                    t = totals.get(k)
                    rows.append((doc_id, b"", b"", 0, 0, 0, "") if t is None else
                                (doc_id, b"".join(t[0]), b"".join(t[1]), t[2], t[3], t[4], shas[k].hexdigest()))
                yield sent(rows, more)
        yield sent([], [sums.close()])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ROW_SCHEMA)


def align(docs: DataFrame, files: tuple[str, str, str, str] | None = None, head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """One row per document: numbers of tokens, groups and links, links that are the best of their B id, sum of counts.

    ``n_group_links`` is the number of token pairs in one group.
    """
    spark = docs.sparkSession
    made = scratch(tokenised(docs, files).withColumn("row", F.monotonically_increasing_id()), "align-ids", "zstd")
    sums = made.where(F.col("n_links").isNull()).select(F.explode(F.arrays_zip("pairs", "pair_n")).alias("s"))
    counts = scratch(sums.groupBy(F.col("s.pairs").alias("pair")).agg(F.sum("s.pair_n").alias("n")), "align-counts")
    best = counts.groupBy(F.pmod("pair", F.lit(PAIR)).alias("b")).agg(F.max("n").alias("top"))
    # the least power of two that leaves at most head_pairs pairs
    steps = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("step")).count().collect()  # 63 rows at most
    least = 0
    while sum(r["count"] for r in steps if r["step"] >= least) > head_pairs:
        least += 1
    head = counts.where(F.col("n") >= F.lit(1 << least)).toPandas().sort_values("pair")
    tops = best.toPandas()                                                                  # one row per B id
    top = np.zeros(PAIR, np.int64)
    top[tops["b"].to_numpy(np.int64)] = tops["top"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast((head["pair"].to_numpy(np.int64), head["n"].to_numpy(np.int64), top))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(files)
        codes, number, top = shared.value
        codes, number = np.append(codes, np.iinfo(np.int64).max), np.append(number, 0)
        is_best = number == top[codes % PAIR]

        def score(a_raw: bytes, b_raw: bytes) -> tuple:
            a, b = np.frombuffer(a_raw, np.uint16), np.frombuffer(b_raw, np.uint16)
            ptr, col, _ = overlap_links(tokens.a_sizes[a], tokens.b_sizes[b])
            pairs, times = runs(np.sort(np.repeat(a.astype(np.int64) * PAIR, np.diff(ptr)) + b[col]))
            at = np.searchsorted(codes, pairs)
            hit = codes[at] == pairs
            found, n = at[hit], times[hit]
            return int(n[is_best[found]].sum()), int((n * number[found]).sum()), pairs[~hit], times[~hit]

        for batch in batches:
            scores = [score(a.as_buffer(), b.as_buffer()) for a, b in zip(batch.column("a_ids"), batch.column("b_ids"), strict=True)]
            n = [pa.array([len(x.as_buffer()) // 2 for x in batch.column(k)], pa.int64()) for k in ("a_ids", "b_ids")]
            kept = [batch.column(k) for k in ("n_groups", "n_links", "n_group_links", "groups_sha256")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), *n, *kept, pa.array([s[0] for s in scores], pa.int64()),
                 pa.array([s[1] for s in scores], pa.int64()), pa.array([s[2] for s in scores], pa.list_(pa.int64())),
                 pa.array([s[3] for s in scores], pa.list_(pa.int64()))],
                names=[f.split()[0] for f in SCORE_SCHEMA.split(", ")])

    rows = made.where(F.col("n_links").isNotNull()).drop("pairs", "pair_n")
    rows = scratch(rows.mapInArrow(run, SCORE_SCHEMA), "align-rows")
    rest = counts.where(F.col("n") < F.lit(1 << least)).join(best, F.pmod("pair", F.lit(PAIR)) == F.col("b"))
    rest = rest.select("pair", "n", (F.col("n") == F.col("top")).cast("long").alias("is_best"))
    tail = rows.where(F.size("tail_pairs") > 0).select("row", F.explode(F.arrays_zip("tail_pairs", "tail_n")).alias("t"))
    tail = tail.select("row", F.col("t.tail_pairs").alias("pair"), F.col("t.tail_n").alias("times")).join(rest, "pair")
    tail = tail.groupBy("row").agg(F.sum(F.col("times") * F.col("is_best")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more"))
    out = rows.drop("tail_pairs", "tail_n").join(tail, "row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_group_links",
                      (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
                      (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum"), "groups_sha256")
