"""Substring dedup: passages of ``WINDOW`` or more words that an earlier document holds, by FM-indexes of shards.

An index of all text in one piece can't be held, and streaming every document through every shard
costs documents x shards. So what an index must hold for a window to be found is brought together first:

* Every run of ``ANCHOR`` words has a hash; the least one within a window of ``WINDOW`` words is the
  window's anchor. Equal windows have equal anchors at the same place. Anchors that lie in one text only
  (or in its copies) can't be part of a repeated window and go no further.
* Round every other anchor the passage of all windows that may hold it (at most 2 * WINDOW - ANCHOR words)
  is cut out of the text; equal passages of one anchor are one entry with the least doc_id.
* An anchor with over ``MOST`` different passages (a line that very many documents share) would
  make a shard too large; its passages are split into their windows instead, equal ones one entry with
  the least doc_id, and only windows of two documents are kept.

Entries go to shards by anchor (or window), some ``SHARD_WORDS`` words each. A shard builds its FM-index
(:mod:`fm_index`) and every entry is streamed backwards through it; the matching statistics tell which of
its windows lie in the index and the least doc_id among those rows. The windows of a document whose least
doc_id is smaller than its own are repeated, and the words they cover are removed.

Copies of a whole text keep only that of the least doc_id, if they have ``WINDOW`` words.

Edge cases: NULL and empty texts have no words (their kept text is empty); rows without doc_id are kept
whole and remove nothing; rows that repeat a doc_id are not smaller than each other, so they are judged
against smaller ids only; texts of any length are read whole; an empty table gives no rows; other columns
are ignored. Words are compared by 64-bit hashes, 50 of them in a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitloom.llm.common import keep_listed, scratch
from fitloom.llm.fm_index import FMIndex

WINDOW = 50
ANCHOR = 34
MOST = 4096             # passages of one anchor in a shard
SHARD_WORDS = 1 << 20
MULTIPLIER = 0x9E3779B97F4A7C15
READ_SCHEMA = "doc_id long, n_words long, text_sha binary, anchors array<long>, places array<int>, passages array<long>"
ENTRY_SCHEMA = "key long, passage long, doc long, words binary"
FOUND_SCHEMA = "key long, passage long, firsts array<int>, lasts array<int>, last int, most long"
KEPT_SCHEMA = "doc_id long, text_sha binary, n_removed long, kept_sha256 string, kept string"


# words and rolling hashes ------------------------------------------------------------------
def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Rolling:
    """Hashes of runs of words of one text, from prefix sums of word hash x power (mod 2^64)."""

    def __init__(self, words: np.ndarray, powers: Powers):
        self.up, self.down = powers.upto(len(words) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * self.up[:len(words)])])

    def runs(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64))


class Powers:
    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 2 * n
            back = pow(MULTIPLIER, -1, 1 << 64)
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, m, np.uint64))]) for m in (MULTIPLIER, back))
        return self.up, self.down


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def anchors(rolling: Rolling, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of the anchors of a text of n words: of each window, the run of words with the least hash (the first of equals)."""
    begin = np.arange(n - ANCHOR + 1)
    hashes = rolling.runs(begin, begin + ANCHOR)
    wide = WINDOW - ANCHOR + 1
    least = np.lib.stride_tricks.sliding_window_view(hashes, wide).argmin(axis=1)
    at = np.unique(np.arange(len(least)) + least)
    return hashes[at], at


def bounds(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The passage of an anchor: the words of all windows that hold it."""
    return np.maximum(at - (WINDOW - ANCHOR), 0), np.minimum(at + WINDOW, n)


def read(docs: DataFrame) -> DataFrame:
    """Per row: number of words, SHA-256 of the words joined by a space, and its anchors with their passages' hashes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            ids, counts, shas, found = batch.column(0), [], [], ([], [], [])
            for doc_id, text in zip(ids, batch.column(1), strict=True):
                words = (text.as_py() or "").encode().split()
                counts.append(len(words))
                shas.append(hashlib.sha256(b" ".join(words)).digest())
                rows: tuple = ((), (), ())
                if len(words) >= WINDOW and doc_id.is_valid:
                    rolling = Rolling(word_hashes(words), powers)
                    hashes, at = anchors(rolling, len(words))
                    rows = hashes.view(np.int64), at.astype(np.int32), rolling.runs(*bounds(at, len(words))).view(np.int64)
                for column, row in zip(found, rows, strict=True):
                    column.append(row)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(counts, pa.int64()), pa.array(shas, pa.binary()),
                 *[pa.array(c, pa.list_(t)) for c, t in zip(found, (pa.int64(), pa.int32(), pa.int64()), strict=True)]],
                names=["doc_id", "n_words", "text_sha", "anchors", "places", "passages"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, READ_SCHEMA)


# entries of the indexes ---------------------------------------------------------------------
def entries(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The words (their hashes, 8 bytes each) of passages ``wanted`` (key, passage, doc, place) of the documents."""
    per_doc = wanted.groupBy("doc").agg(F.collect_list(F.struct("key", "passage", "place")).alias("w")).select(
        F.col("doc").alias("doc_id"), F.col("w.key").alias("keys"), F.col("w.passage").alias("hashes"), F.col("w.place").alias("places"))
    rows = keep_listed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), per_doc.select("doc_id"), "doc_id")
    rows = rows.join(per_doc, "doc_id").select("doc_id", "text", "keys", "hashes", "places")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for row in range(batch.num_rows):
                words = (batch.column(1)[row].as_py() or "").encode().split()
                n = len(words)
                if n < WINDOW:
                    continue
                hashes = word_hashes(words)
                keys, passages, at = (batch.column(k)[row].values.to_numpy(zero_copy_only=False) for k in (2, 3, 4))
                begin, end = bounds(at.astype(np.int64), n)
                fits = at + ANCHOR <= n
                begin, end = np.where(fits, begin, 0), np.where(fits, end, 0)
                # another text of the same doc_id has other passages
                same = fits & (Rolling(hashes, powers).runs(begin, end).view(np.int64) == passages)
                doc = batch.column(0)[row].as_py()
                for k in np.flatnonzero(same).tolist():
                    out[3].append(hashes[begin[k]:end[k]].tobytes())
                out[0].extend(keys[same].tolist())
                out[1].extend(passages[same].tolist())
                out[2].extend([doc] * int(same.sum()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                                             names=["key", "passage", "doc", "words"])

    return rows.mapInArrow(run, ENTRY_SCHEMA)


def search(rows: DataFrame, shards: int) -> DataFrame:
    """Per entry, what the index of its shard says of its windows, numbered 0..last by their first word.

    Of the least doc of all entries that hold a window: ``most`` is the greatest over the entry's windows (at most
    the entry's own doc), and ``firsts``..``lasts`` are the runs of windows for which it is smaller than that doc.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema=schema)
        if not table.num_rows:
            return
        keys, passages, docs = (table.column(k).to_numpy() for k in range(3))
        keep = np.lexsort((docs, passages, keys))       # a row that repeats doc_id and text may have sent its passages twice
        new = np.ones(len(keep), bool)
        new[1:] = (keys[keep][1:] != keys[keep][:-1]) | (passages[keep][1:] != passages[keep][:-1])
        keep = keep[new]
        words = table.column(3).take(pa.array(keep)).combine_chunks()
        sizes = np.array([len(w.as_buffer()) // 8 for w in words], np.int64)
        raw = np.frombuffer(b"".join(w.as_buffer() for w in words), np.uint64)
        symbols = np.unique(raw, return_inverse=True)[1].astype(np.int64) + 1
        keys, passages, docs = keys[keep], passages[keep], docs[keep]
        index = FMIndex(symbols, sizes, docs, WINDOW)
        length, row = index.matching_statistics(symbols, sizes)
        least = index.least[index.group[row]]
        begin = np.cumsum(sizes) - sizes
        last = sizes - WINDOW
        known = np.where(length >= WINDOW, least, np.iinfo(np.int64).min)
        most = np.maximum.reduceat(known, begin)
        earlier = (length >= WINDOW) & (least < np.repeat(docs, sizes))
        # runs of such windows, within their entry
        edge = np.zeros(len(earlier), bool)
        edge[begin] = True
        first = np.flatnonzero(earlier & (edge | ~np.concatenate([[False], earlier[:-1]])))
        final = np.flatnonzero(earlier & ~np.concatenate([earlier[1:] & ~edge[1:], [False]]))
        entry = np.searchsorted(begin, first, "right") - 1
        upto = np.concatenate([[0], np.cumsum(np.bincount(entry, minlength=len(sizes)))]).astype(np.int32)
        runs = [pa.ListArray.from_arrays(pa.array(upto), pa.array((at - begin[entry]).astype(np.int32))) for at in (first, final)]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(passages), *runs, pa.array(last.astype(np.int32)), pa.array(most)],
                                         names=["key", "passage", "firsts", "lasts", "last", "most"])

    schema = pa.schema([("key", pa.int64()), ("passage", pa.int64()), ("doc", pa.int64()), ("words", pa.binary())])
    return rows.select("key", "passage", "doc", "words").repartition(max(1, shards), "key").mapInArrow(run, FOUND_SCHEMA)


def repeated_spans(docs: DataFrame, made: DataFrame) -> DataFrame:
    """(doc_id, text_sha, start, end): words start..end-1 are covered by repeated windows. ``made`` is ``read(docs)``."""
    wide = 2 * WINDOW - ANCHOR
    seen = made.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= WINDOW)).select(
        F.col("doc_id").alias("doc"), "text_sha", F.explode(F.arrays_zip("anchors", "places", "passages")).alias("a")).select(
        "doc", "text_sha", F.col("a.anchors").alias("key"), F.col("a.places").alias("place"), F.col("a.passages").alias("passage"))
    text = F.xxhash64("text_sha")
    shared = scratch(seen.groupBy("key").agg(F.min(text).alias("one"), F.max(text).alias("other")).where("one < other").select("key"), "fm-anchors")
    hits = scratch(keep_listed(seen, shared, "key"), "fm-hits")
    distinct = scratch(hits.groupBy("key", "passage").agg(F.min(F.struct("doc", "place")).alias("f"), F.max("doc").alias("last")).select(
        "key", "passage", "f.doc", "f.place", (F.col("f.doc") < F.col("last")).alias("again")), "fm-passages")
    sizes = scratch(distinct.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "fm-sizes")
    crowded = sizes.where(F.col("n") > MOST).select("key")
    usual = sizes.where(F.col("n") <= MOST).agg(F.sum("n").alias("n")).first()["n"] or 0
    rows = entries(docs, distinct.join(crowded, "key", "left_anti"))
    found = scratch(search(rows, -(-usual * wide // SHARD_WORDS)), "fm-found")
    many = distinct.join(crowded, "key", "left_semi")
    if not crowded.isEmpty():
        # windows of crowded anchors, equal ones one entry
        parts = scratch(entries(docs, many).join(many.select("key", "passage", "again"), ["key", "passage"]), "fm-crowded")
        starts = F.sequence(F.lit(0), (F.length("words") / 8).cast("int") - WINDOW)
        windows = parts.select("key", "passage", "doc", "again", F.explode(starts).alias("first"), "words")
        windows = windows.withColumn("words", F.expr(f"substring(words, first * 8 + 1, {8 * WINDOW})"))
        windows = windows.select("key", "passage", "doc", "again", "first", "words", F.xxhash64("words").alias("w"), F.xxhash64(F.lit(1), "words").alias("w2"))
        twice = windows.groupBy("w", "w2").agg(F.min("doc").alias("doc"), F.min("passage").alias("one"), F.max("passage").alias("other"),
                                               F.bool_or("again").alias("again"), F.min("words").alias("words"))
        twice = scratch(twice.where("one < other or again").select(F.col("w").alias("key"), F.col("w2").alias("passage"), "doc", "words"), "fm-windows")
        answers = search(twice, -(-twice.count() * WINDOW // SHARD_WORDS)).select(F.col("key").alias("w"), F.col("passage").alias("w2"), F.col("most").alias("least"))
        back = windows.select("key", "passage", "doc", "first", "w", "w2").join(answers, ["w", "w2"], "left")
        earlier = F.collect_list(F.when(F.col("least") < F.col("doc"), F.col("first")))
        back = back.groupBy("key", "passage").agg(earlier.alias("firsts"), F.max("first").alias("last"),
                                                  F.max(F.coalesce("least", "doc")).alias("most"))
        found = found.unionByName(scratch(back.select("key", "passage", "firsts", F.col("firsts").alias("lasts"), "last", "most"), "fm-found-crowded"))
    begin = F.greatest(F.col("place") - (WINDOW - ANCHOR), F.lit(0))
    # all windows of the passage have an earlier document, or those of the runs
    spans = F.when(F.col("doc") > F.col("most"), F.array(F.struct(F.lit(0).alias("first"), F.col("last").alias("last")))).otherwise(
        F.transform(F.arrays_zip("firsts", "lasts"), lambda r: F.struct(r["firsts"].alias("first"), r["lasts"].alias("last"))))
    return hits.join(found, ["key", "passage"]).select("doc", "text_sha", begin.alias("begin"), F.explode(spans).alias("s")).select(
        F.col("doc").alias("doc_id"), "text_sha", (F.col("begin") + F.col("s.first")).alias("start"), (F.col("begin") + F.col("s.last") + WINDOW).alias("end"))


# removal ------------------------------------------------------------------------------------
def removed(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """For documents with repeated words: how many go, and the text and SHA-256 of the rest."""
    per_doc = spans.distinct().groupBy("doc_id").agg(F.collect_list(F.struct("text_sha", "start", "end")).alias("spans"))
    per_doc = scratch(per_doc.select("doc_id", F.col("spans.text_sha").alias("shas"), F.col("spans.start").alias("starts"),
                                     F.col("spans.end").alias("ends")), "fm-spans")
    rows = keep_listed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), per_doc.select("doc_id"), "doc_id")
    rows = rows.join(per_doc, "doc_id").select("doc_id", "text", "shas", "starts", "ends")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for row in range(batch.num_rows):
                words = (batch.column(1)[row].as_py() or "").encode().split()
                sha = hashlib.sha256(b" ".join(words)).digest()
                mine = np.array([s == sha for s in batch.column(2)[row].as_py()], bool)
                begin, end = (batch.column(k)[row].values.to_numpy(zero_copy_only=False)[mine] for k in (3, 4))
                depth = np.zeros(len(words) + 1, np.int64)
                np.add.at(depth, begin, 1)
                np.add.at(depth, end, -1)
                gone = np.cumsum(depth[:-1]) > 0
                kept = b" ".join([words[k] for k in np.flatnonzero(~gone).tolist()])
                for column, value in zip(out, (batch.column(0)[row].as_py(), sha, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()), strict=True):
                    column.append(value)
            types = (pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)],
                                             names=["doc_id", "text_sha", "n_removed", "kept_sha256", "kept"])

    return rows.mapInArrow(run, KEPT_SCHEMA)


def dedup_substrings(docs: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row; with ``texts`` also the kept words, joined by a space, of rows that lose some."""
    made = scratch(read(docs), "fm-read")
    spans = repeated_spans(docs, made)
    changed = removed(docs, spans)
    changed = scratch(changed if texts else changed.drop("kept"), "fm-removed").dropDuplicates(["doc_id", "text_sha"])
    whole = made.select("doc_id", "n_words", "text_sha")
    least = whole.groupBy("text_sha").agg(F.min("doc_id").alias("least"))
    copy = (F.col("least") < F.col("doc_id")) & (F.col("n_words") >= WINDOW)
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    out = whole.join(least, "text_sha").join(changed, ["doc_id", "text_sha"], "left")
    cols = [F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
            F.when(copy, nothing).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("text_sha")))).alias("kept_sha256")]
    if texts:
        cols.append(F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"))
    return out.select("doc_id", "n_words", *cols)
