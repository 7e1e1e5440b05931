"""Language identification by interpolated Kneser-Ney character models.

Fitting: documents outside the held-out fold whose language is known. Per language a
sample of ``SAMPLE_CHARS`` characters of distinct texts is taken in the order of a hash of the text (the
documented bound of the fit; all of them where there are fewer): whole texts, of which the last
is read up to the bound. Copies count once, so no language is without a text however often one is
repeated. Spark counts n-grams of
orders 1 to ``ORDER`` per language with partial sums; the counts reach the driver as sorted hash
arrays, whose size the sample bounds.

Model: interpolated Kneser-Ney with one absolute discount per order,
``p(c | h) = max(k(hc) - d, 0) / k(h.) + d * types(h) / k(h.) * p(c | h')``, with k the count at
the highest order and the number of distinct characters to the left at lower ones. For every
n-gram seen in any language the log-probability is kept for all languages at once, and for every
context its back-off weight, in arrays sorted by n-gram hash: one binary search per character,
and a shorter one for characters whose n-gram no language has seen.

Prediction: letters in lower case, everything else one space; the lowest cross-entropy per
character wins (ties: the smaller language name). ``score`` is the posterior of the winner for
entropies sharpened by ``SHARPNESS``. ``rejected`` says that the winner's cross-entropy lies above
the ``REJECT_QUANTILE`` of the sample's own texts of that language.

Edge cases: NULL text or one without a letter gives ``und`` with score 0; a NULL language is never
learned; without any text to learn from everything is ``und``; texts are read whole; repeated
rows get the same result; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitloom.llm.common import scratch

ORDER = 4
SAMPLE_CHARS = 2_000_000
HASH_BUCKETS = 4096
REJECT_QUANTILE = 0.999
SHARPNESS = 20.0
FLOOR = 1e-7  # probability of a character that no language has seen
CHARS_AT_ONCE = 2_000_000
MULT = 0x9E3779B97F4A7C15


def held_out(doc_id: Column) -> Column:
    """Fold 0 of five by CRC-32 of the id as text."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts in lower case, non-letters as single spaces, each text led by a space; and text numbers."""
    data = np.frombuffer("".join(f" {t.lower()} " for t in texts).encode("utf-32-le", "replace"), np.uint32)
    sizes = np.array([len(t.lower()) + 2 for t in texts])
    table = _letters(int(data.max()) + 1 if len(data) else 1)
    codes = np.where(table[data], data, np.uint32(32))
    text = np.repeat(np.arange(len(texts)), sizes)
    keep = np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32) | (text[1:] != text[:-1])])
    return codes[keep].astype(np.uint64), text[keep]


_LETTERS = np.zeros(0, bool)


def _letters(n: int) -> np.ndarray:
    global _LETTERS
    if len(_LETTERS) < n:
        _LETTERS = np.array([chr(c).isalpha() for c in range(max(n, 0x3000))])
    return _LETTERS


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(MULT)
    return x ^ (x >> np.uint64(29))


def _grams(codes: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n characters that end at each place, and whether they all belong to one text."""
    h = np.full(len(codes), n, np.uint64)
    for k in range(n - 1, -1, -1):
        h[k:] = _mix(h[k:] * np.uint64(MULT) + codes[:len(codes) - k]) if k else _mix(h * np.uint64(MULT) + codes)
        if k:
            h[:k] = 0
    ok = np.zeros(len(codes), bool)
    ok[n - 1:] = text[n - 1:] == text[:len(text) - n + 1]
    return h, ok


def _runs(texts: list[str]) -> Iterator[list[int]]:
    run, size = [], 0
    for i, t in enumerate(texts):
        run.append(i)
        size += len(t) + 2
        if size >= CHARS_AT_ONCE:
            yield run
            run, size = [], 0
    if run:
        yield run


def counted(sample: DataFrame) -> DataFrame:
    """(lang, text) -> lang, n, gram, context, tail, count: n-grams of every order with partial sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                own = [texts[i] for i in np.flatnonzero(langs == lang)]
                for part in _runs(own):
                    codes, text = _codes([own[i] for i in part])
                    all_grams = {0: (np.zeros(len(codes), np.uint64), np.ones(len(codes), bool))}
                    all_grams |= {n: _grams(codes, text, n) for n in range(1, ORDER + 1)}
                    for n in range(1, ORDER + 1):
                        h, ok = all_grams[n]
                        # context: the n - 1 characters before; tail: the last n - 1 characters
                        before = np.concatenate([np.zeros(1, np.uint64), all_grams[n - 1][0][:-1]])
                        at = np.flatnonzero(ok)
                        gram, first, count = np.unique(h[at], return_index=True, return_counts=True)
                        at = at[first]
                        yield pa.RecordBatch.from_arrays([
                            pa.array([lang] * len(at), pa.string()), pa.array(np.full(len(at), n, np.int32)), pa.array(gram.view(np.int64)),
                            pa.array(before[at].view(np.int64)), pa.array(all_grams[n - 1][0][at].view(np.int64)), pa.array(count.astype(np.int64)),
                        ], names=["lang", "n", "gram", "context", "tail", "count"])

    parts = sample.select("lang", "text").mapInArrow(run, "lang string, n int, gram long, context long, tail long, count long")
    return parts.groupBy("lang", "n", "gram").agg(F.min("context").alias("context"), F.min("tail").alias("tail"), F.sum("count").alias("count"))


class Model:
    """Sorted hash arrays of all orders: ``grams[n]`` with ``logp[n]`` (a column per language), ``contexts[n]`` with ``logb[n]``."""

    def __init__(self, counts: dict[str, np.ndarray], langs: list[str]):
        self.langs = langs
        code = {lang: i for i, lang in enumerate(langs)}
        lang = np.array([code[x] for x in counts["lang"]], np.int64)
        order, gram, context, tail = (counts[k] for k in ("n", "gram", "context", "tail"))
        gram, context, tail = (x.astype(np.int64).view(np.uint64) for x in (gram, context, tail))
        weight = counts["count"].astype(float)
        self.grams, self.logp, self.contexts, self.logb = {}, {}, {}, {}
        below = None
        for n in range(1, ORDER + 1):
            mine = order == n
            g, rows = np.unique(gram[mine], return_inverse=True)
            k = np.zeros((len(g), len(langs)))
            if n == ORDER:
                k[rows, lang[mine]] = weight[mine]
            else:
                # distinct characters to the left: n-grams of the next order that end in this one
                up = order == n + 1
                at = np.searchsorted(g, tail[up])
                np.add.at(k, (at, lang[up]), 1.0)
            ctx = np.zeros(len(g), np.uint64)
            ctx[rows] = context[mine]
            end = np.zeros(len(g), np.uint64)
            end[rows] = tail[mine]
            c, which = np.unique(ctx, return_inverse=True)
            total, types, once, twice = (np.zeros((len(c), len(langs))) for _ in range(4))
            np.add.at(total, which, k)
            np.add.at(types, which, (k > 0).astype(float))
            n1, n2 = (k == 1).sum(0), (k == 2).sum(0)
            d = np.clip(n1 / np.maximum(n1 + 2 * n2, 1), 0.1, 0.95)
            safe = np.maximum(total, 1.0)
            back = np.where(total > 0, d * types / safe, 1.0)
            lower = np.full((len(g), len(langs)), 1 / len(g)) if below is None else below[1][np.searchsorted(below[0], end)]
            p = np.maximum(k - d, 0) / safe[which] + back[which] * lower
            self.grams[n], self.logp[n] = g, np.log(np.maximum(p, FLOOR)).astype(np.float32)
            self.contexts[n], self.logb[n] = c, np.log(np.maximum(back, FLOOR)).astype(np.float32)
            below = (g, p)

    def plain(self) -> tuple:
        """Its arrays and names only: what a broadcast may hold where executors lack the package."""
        return self.langs, self.grams, self.logp, self.contexts, self.logb

    @classmethod
    def of(cls, plain: tuple) -> Model:
        model = cls.__new__(cls)
        model.langs, model.grams, model.logp, model.contexts, model.logb = plain
        return model

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character and language, and the number of letters, for each text."""
        codes, text = _codes(texts)
        total = np.zeros((len(texts), len(self.langs)))
        size = np.bincount(text, minlength=len(texts))
        letters = np.bincount(text[codes != 32], minlength=len(texts))
        todo, carried = np.arange(len(codes)), None
        for n in range(ORDER, 0, -1):
            h, ok = _grams(codes, text, n)
            h, ok = h[todo], ok[todo]
            at = np.minimum(np.searchsorted(self.grams[n], h), len(self.grams[n]) - 1)
            hit = ok & (self.grams[n][at] == h)
            found = self.logp[n][at[hit]]
            if carried is not None:
                found = found + carried[hit]
            self._add(total, text[todo[hit]], found)
            miss = np.flatnonzero(~hit)
            if n == 1 or not len(miss):
                break
            ctx, _ = _grams(codes, text, n - 1)
            before = ctx[np.maximum(todo[miss] - 1, 0)]
            at = np.minimum(np.searchsorted(self.contexts[n], before), len(self.contexts[n]) - 1)
            known = ok[miss] & (self.contexts[n][at] == before)
            weight = np.where(known[:, None], self.logb[n][at], np.float32(0))
            carried = weight if carried is None else carried[miss] + weight
            todo = todo[miss]
        else:
            miss = np.empty(0, np.int64)
        if n == 1 and len(miss):
            unseen = np.full((len(miss), len(self.langs)), np.float32(np.log(FLOOR)))
            self._add(total, text[todo[miss]], unseen if carried is None else unseen + carried[miss])
        return -total / np.maximum(size, 1)[:, None], letters

    @staticmethod
    def _add(total: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
        for j in range(total.shape[1]):
            total[:, j] += np.bincount(rows, values[:, j], len(total))


def sampled(known: DataFrame) -> DataFrame:
    """(lang, text) -> the sample's texts: per language distinct texts in hash order until ``SAMPLE_CHARS`` is reached."""
    known = known.withColumn("h", F.xxhash64("text"))
    texts = known.groupBy("lang", "h").agg(F.max(F.length("text")).alias("size")).where("size > 0")
    texts = scratch(texts.withColumn("bucket", F.pmod("h", F.lit(HASH_BUCKETS))), "lang-texts")
    # running sums over buckets first, so that only texts of the buckets up to the bound are sorted
    in_order = Window.partitionBy("lang").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = texts.groupBy("lang", "bucket").agg(F.sum("size").alias("chars"))
    buckets = buckets.withColumn("start", F.coalesce(F.sum("chars").over(in_order), F.lit(0))).where(F.col("start") < SAMPLE_CHARS)
    in_bucket = Window.partitionBy("lang", "bucket").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    taken = texts.join(buckets.select("lang", "bucket", "start"), ["lang", "bucket"])
    room = SAMPLE_CHARS - F.col("start") - F.coalesce(F.sum("size").over(in_bucket), F.lit(0))
    taken = taken.withColumn("room", room).where("room > 0").select("lang", "h", F.least("size", "room").cast("int").alias("room"))
    taken = scratch(taken, "lang-taken")
    return known.join(taken, ["lang", "h"]).select("lang", F.substring("text", F.lit(1), F.col("room")).alias("text")).dropDuplicates()


def fit(docs: DataFrame) -> tuple[Model, np.ndarray] | None:
    """The model and each language's rejection limit; None where there is nothing to learn from."""
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    sample = scratch(sampled(known.select("lang", "text")), "lang-sample")
    langs = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    if not langs:
        return None
    counts = counted(sample).toPandas()
    model = Model({c: counts[c].to_numpy() for c in counts.columns}, langs)
    shared = docs.sparkSession.sparkContext.broadcast(model.plain())

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_model = Model.of(shared.value)
        for batch in batches:
            lang, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in _runs(texts):
                h, _ = own_model.entropies([texts[i] for i in part])
                mine = [float(h[k, own_model.langs.index(lang[i])]) for k, i in enumerate(part)]
                yield pa.RecordBatch.from_arrays([pa.array([lang[i] for i in part], pa.string()), pa.array(mine, pa.float64())], names=["lang", "h"])

    limits = {r["lang"]: r["q"] for r in sample.select("lang", "text").mapInArrow(own, "lang string, h double")
              .groupBy("lang").agg(F.percentile_approx("h", F.lit(REJECT_QUANTILE)).alias("q")).collect()}
    return model, np.array([limits.get(x, np.inf) for x in langs])


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy and rejected for every row of ``docs``."""
    fitted = fit(docs)
    rows = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    if fitted is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.lit(None).cast("double").alias("cross_entropy"), F.lit(False).alias("rejected"))
    shared = docs.sparkSession.sparkContext.broadcast((fitted[0].plain(), fitted[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, limits = Model.of(shared.value[0]), shared.value[1]
        names = np.array(model.langs, object)
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for part in _runs(texts):
                h, letters = model.entropies([texts[i] for i in part])
                best = h.argmin(1)
                low = h[np.arange(len(part)), best]
                score = 1 / np.exp(-SHARPNESS * (h - low[:, None])).sum(1)
                none = letters == 0
                take = pa.array(part)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(take), batch.column(1).take(take), pa.array(np.where(none, "und", names[best]), pa.string()),
                    pa.array(np.where(none, 0.0, score)), pa.array(low, mask=none), pa.array(~none & (low > limits[best])),
                ], names=["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean")
