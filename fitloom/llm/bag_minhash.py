"""Near-duplicate documents by BagMinHash.

A document is the multiset of its five-word shingles (fewer words: one shingle of all).
Its signature is unbiased for the weighted Jaccard similarity: a shingle of weight w owns
the part [0, w) of a line on which points fall as a Poisson process; every point has a
place in time and one of the signature's slots, and a slot keeps its earliest point. Weights
are discretised to units and the line is cut at 1, 2, 4, 8, ...: each piece is a process of its
own with the piece's length as rate, whose points are drawn in time order and thinned by
their level where w ends inside it, so weight w costs log2(w) processes, and a process
stops once its next point is later than every slot's. Two documents agree in a slot with the
probability sum(min weights) / sum(max weights).

Bands of ``ROWS`` slots make buckets. Copies of one text are one node from the start. Then:

1. every node of a bucket is compared with the bucket's least node (a star, not all pairs),
   exactly, on the shingle multisets; links of ``THRESHOLD`` or more make components;
2. buckets that still hold several components are dealt in blocks of about ``BLOCK`` nodes. A
   task per block pair compares signatures across components, each pair in the first bucket
   it shares, and gives the best spanning forest of the components, which is counted exactly
   and joined;
3. what is still apart and agrees in ``LOOK_FROM`` of the slots or more is counted exactly inside
   the block tasks, pair by pair, and a spanning forest of the links is joined. No task sends
   pairs. Of the pairs with a similarity of just 0.8 about 3 in 10,000 agree in fewer slots and
   are not counted in this step; they are missed unless other links join their components.

Edge cases: NULL, empty or wordless texts are never duplicates; one to four words: equal
word sequences only; ties go to the smallest doc_id (NULL first); rows that repeat doc_id
and text are one document, of which ``keep_one`` keeps one row; an empty table gives no rows;
further columns pass through ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitloom.llm.common import WORD, scratch
from fitloom.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
SLOTS = BANDS * ROWS
#: Signature agreement from which a pair is counted exactly in step 3 (3.7 standard deviations under 0.8).
LOOK_FROM = 0.65
BLOCK = 512
COLUMNS = 8192
BYTES_AT_ONCE = 4 << 20
ID_BITS = 44  # shingle ids; the upper bits of a sort key hold the text's place in its slice


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def draws(seed: np.ndarray, n: int) -> np.ndarray:
    return mix64(seed + np.uint64(n * 0x9E3779B97F4A7C15 % 2**64))


def _word_hashes(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hash of each word: its bytes times one odd factor per place, scrambled. Done a slice of words at a time."""
    word = np.empty(len(start), np.uint64)
    upto = np.concatenate([[0], np.cumsum(length)])
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + BYTES_AT_ONCE, side="right")) - 1)
        n, begin = length[lo:hi], upto[lo:hi] - upto[lo]
        at = np.arange(int(n.sum())) - np.repeat(begin, n)
        factors = mix64(np.arange(1, int(n.max()) + 1, dtype=np.uint64)) | np.uint64(1)
        inside = data[np.repeat(start[lo:hi], n) + at].astype(np.uint64) + np.uint64(1)
        word[lo:hi] = mix64(np.add.reduceat(inside * factors[at], begin) + n.astype(np.uint64))
        lo = hi
    return word


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle id, weight) of every distinct shingle, sorted by text and id."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    word = _word_hashes(data, start, end - start)
    ends = np.cumsum([len(t) + 1 for t in texts])
    text = np.searchsorted(ends, start, side="right")
    count = np.bincount(text, minlength=len(texts))
    first = np.cumsum(count) - count
    left = first[text] + count[text] - np.arange(len(text))  # words from here to the end of the text
    take = np.minimum(count[text], SHINGLE)
    ok = left >= take
    at = np.flatnonzero(ok)
    key = np.zeros(len(at), np.uint64)
    for k in range(SHINGLE):
        more = k < take[at]
        key[more] = mix64(key[more] * np.uint64(3) + word[at[more] + k] + np.uint64(k))
    place = np.sort((text[at].astype(np.uint64) << np.uint64(ID_BITS)) | (key >> np.uint64(64 - ID_BITS)))
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    weight = np.diff(np.concatenate([new, [len(place)]]))
    place = place[new]
    return (place >> np.uint64(ID_BITS)).astype(np.int64), place & np.uint64((1 << ID_BITS) - 1), weight


def signatures(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """n x slots times of the earliest points; rows of texts without shingles stay infinite."""
    first = np.full(n * slots, np.inf)
    rows, seeds, rates, tops = [text], [mix64(shingle)], [np.ones(len(text))], [np.zeros(len(text))]
    low = 1
    while (deep := np.flatnonzero(weight > low)).size:
        rows.append(text[deep])
        seeds.append(mix64(shingle[deep] + np.uint64(low * 0xD1342543DE82EF95 % 2**64)))
        rates.append(np.full(deep.size, float(low)))
        # share of the piece [low, 2 * low) that lies under the weight; 0 marks a piece that lies under it whole
        part = (weight[deep] - low) / low
        tops.append(np.where(part >= 1, 0.0, part))
        low *= 2
    row, seed, rate, top = map(np.concatenate, (rows, seeds, rates, tops))
    time, n_draw = np.zeros(len(row)), 0
    unit = 2.0**-53
    while len(row):
        u = ((draws(seed, 3 * n_draw) >> np.uint64(11)).astype(np.float64) + 0.5) * unit
        time = time - np.log(u) / rate
        alive = time < first.reshape(n, slots).max(1)[row] if n_draw else np.ones(len(row), bool)
        if n_draw:
            row, seed, rate, top, time = row[alive], seed[alive], rate[alive], top[alive], time[alive]
            if not len(row):
                break
        slot = (draws(seed, 3 * n_draw + 1) >> np.uint64(32)).astype(np.int64) * slots >> 32
        hit = np.flatnonzero(top > 0)
        seen = np.ones(len(row), bool)
        if len(hit):
            level = (draws(seed[hit], 3 * n_draw + 2) >> np.uint64(11)).astype(np.float64) * unit
            seen[hit] = level < top[hit]
        np.minimum.at(first, (row * slots + slot)[seen], time[seen])
        n_draw += 1
    return first.reshape(n, slots)


def _slices(texts: list[bytes]) -> Iterator[list[int]]:
    """Numbers of texts in runs of about ``BYTES_AT_ONCE`` bytes."""
    run, size = [], 0
    for i, t in enumerate(texts):
        run.append(i)
        size += len(t)
        if size >= BYTES_AT_ONCE:
            yield run
            run, size = [], 0
    if run:
        yield run


def node_of(text: Column) -> Column:
    """128 bits of the text's SHA-256; NULL for a text without a word."""
    return F.when(text.rlike(WORD), F.substring(F.unhex(F.sha2(text, 256)), 1, 16))


def signed(texts: DataFrame) -> DataFrame:
    """(node, text) -> (node, bands array<long>, sketch binary: 16 bits of each slot)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t.encode() for t in batch.column(1).to_pylist()]
            for part in _slices(raw):
                sig = signatures(*shingles([raw[i] for i in part]), len(part))
                bits = mix64(sig.view(np.uint64).reshape(sig.shape))
                band = np.zeros((len(part), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
                for k in range(ROWS):
                    band = mix64(band * np.uint64(3) + bits[:, k::ROWS])
                sketch = (bits >> np.uint64(48)).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(part)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, len(part) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(band.view(np.int64).ravel())),
                    pa.array([s.tobytes() for s in sketch], pa.binary())], names=["node", "bands", "sketch"])

    return texts.select("node", "text").mapInArrow(run, "node binary, bands array<long>, sketch binary")


def _overlap(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Weighted Jaccard similarity of each a[i], b[i]: common multiset over joint multiset."""
    text, shingle, weight = shingles([x for pair in zip(a, b, strict=True) for x in pair])
    total = np.bincount(text // 2, weight, len(a))
    key = ((text // 2).astype(np.uint64) << np.uint64(ID_BITS)) | shingle
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    same = np.flatnonzero(key[1:] == key[:-1])
    common = np.bincount((key[same] >> np.uint64(ID_BITS)).astype(np.int64), np.minimum(weight[same], weight[same + 1]), len(a))
    return common / np.maximum(total - common, 1)


def _overlaps(texts: list[bytes]) -> np.ndarray:
    """Weighted Jaccard similarities of all texts of a block, by products of incidence matrices."""
    text, shingle, weight = shingles(texts)
    # the k-th occurrence of a shingle is an item of its own: common items are the common multiset
    text, shingle = np.repeat(text, weight), np.repeat(shingle, weight)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(weight) - weight, weight)
    _, item, count = np.unique(mix64(shingle + np.uint64(0x9E3779B97F4A7C15) * nth.astype(np.uint64)), return_inverse=True, return_counts=True)
    total = np.bincount(text, minlength=len(texts))
    number = np.cumsum(count > 1) - 1
    shared = count[item] > 1
    text, item = text[shared], number[item[shared]]
    order = np.argsort(item, kind="stable")
    text, item = text[order], item[order]
    common = np.zeros((len(texts), len(texts)), np.float32)
    for lo in range(0, int(item[-1]) + 1 if len(item) else 0, COLUMNS):
        at = slice(*np.searchsorted(item, [lo, lo + COLUMNS]))
        m = np.zeros((len(texts), COLUMNS), np.float32)
        m[text[at], item[at] - lo] = 1
        common += m @ m.T
    return common / np.maximum(total[:, None] + total[None, :] - common, 1)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose texts have similarity ``THRESHOLD`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([t.encode() for t in batch.column(k).to_pylist()] for k in (2, 3))
            good = [part[i] for part in _slices([x + y for x, y in zip(a, b, strict=True)])
                    for i in np.flatnonzero(_overlap([a[i] for i in part], [b[i] for i in part]) >= THRESHOLD)]
            yield batch.select([0, 1]).take(pa.array(good, pa.int64()))

    one = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _across(t: pa.Table, one: int, two: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) of a block pair to look at, and their agreement: of different components, in the
    first bucket that they share, with ``LOOK_FROM`` of the slots in common."""
    part, component, bucket = (t.column(c).to_numpy() for c in ("part", "component", "bucket"))
    sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint16).reshape(-1, SLOTS)
    bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    out_i, out_j, out_share = [], [], []
    others = np.flatnonzero(part == two)
    band = int(np.flatnonzero(bands[0] == bucket[0])[0]) if len(bands) else 0
    for i in np.flatnonzero(part == one):
        look = others[(component[others] != component[i]) & ((others > i) if one == two else True)]
        share = (sketch[look] == sketch[i]).mean(1)
        look, share = look[share >= LOOK_FROM], share[share >= LOOK_FROM]
        fresh = ~(bands[look, :band] == bands[i, :band]).any(1)
        out_i.append(np.full(int(fresh.sum()), i)), out_j.append(look[fresh]), out_share.append(share[fresh])
    none = [np.empty(0, np.int64)]
    return np.concatenate(out_i or none), np.concatenate(out_j or none), np.concatenate(out_share or none)


def _forest(i: np.ndarray, j: np.ndarray, value: np.ndarray, component: np.ndarray) -> list[int]:
    """Positions of the pairs that make the best spanning forest of the components."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    order = np.argsort(-value, kind="stable")
    low, high = np.minimum(component[i], component[j])[order], np.maximum(component[i], component[j])[order]
    _, first = np.unique(np.stack([low, high], 1), axis=0, return_index=True)  # the best pair of two components
    kept = []
    for k in np.sort(first):
        a, b = find(int(low[k])), find(int(high[k]))
        if a != b:
            root[a] = b
            kept.append(int(order[k]))
    return kept


def _dealt(shared: DataFrame, sig: DataFrame, found: DataFrame) -> DataFrame:
    """The nodes of buckets that hold several components, dealt to block pairs."""
    labelled = shared.join(found, F.col("id") == F.col("node"), "left").select(
        "bucket", "id", F.coalesce("component", "id").alias("component"))
    mixed = (labelled.groupBy("bucket").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"))
             .where("lo != hi").select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    d = labelled.join(mixed, "bucket").withColumn("part", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    d = d.select("bucket", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"), "part", "id", "component")
    return d.join(sig.select("id", "bands", "sketch"), "id")


def _guess(key: tuple, t: pa.Table) -> pa.Table:
    """The block pair's best spanning forest by signature."""
    i, j, share = _across(t, key[1].as_py(), key[2].as_py())
    k = _forest(i, j, share, t.column("component").to_numpy())
    ids = t.column("id").to_numpy()
    return pa.table({"a": np.minimum(ids[i[k]], ids[j[k]]), "b": np.maximum(ids[i[k]], ids[j[k]])}, schema=EDGES)


def _involved(key: tuple, t: pa.Table) -> pa.Table:
    """The rows of the block pair that some pair to look at needs."""
    i, j, _ = _across(t, key[1].as_py(), key[2].as_py())
    return t.take(pa.array(np.unique(np.concatenate([i, j]))))


def _count(key: tuple, t: pa.Table) -> pa.Table:
    """A spanning forest of the block pair's links between components, counted exactly."""
    i, j, _ = _across(t, key[1].as_py(), key[2].as_py())
    similar = _overlaps([x.encode() for x in t.column("text").to_pylist()])[i, j] if len(i) else np.empty(0)
    i, j, similar = i[similar >= THRESHOLD], j[similar >= THRESHOLD], similar[similar >= THRESHOLD]
    k = _forest(i, j, similar, t.column("component").to_numpy())
    ids = t.column("id").to_numpy()
    return pa.table({"a": ids[i[k]], "b": ids[j[k]]}, schema=EDGES)


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])
BLOCK_KEYS = ("bucket", "one", "two")
BLOCK_ROWS = "id long, bucket long, one int, two int, part int, component long, bands array<long>, sketch binary"


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, node, class_id, kept for every row: the class is named by its smallest doc_id."""
    text = F.col("text")
    rows = scratch(docs.select("doc_id", node_of(text).alias("node")), "near-rows")
    pool = docs.select(node_of(text).alias("node"), text).where("node is not null")
    # every row is signed where it is read: copies cost time, a shuffle of all texts would cost more
    sig = scratch(signed(pool).dropDuplicates(["node"]).withColumn("id", F.monotonically_increasing_id()), "near-signatures")
    members = sig.select("id", F.explode("bands").alias("bucket"))
    hubs = members.groupBy("bucket").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = scratch(members.join(hubs, "bucket"), "near-shared")
    needed = sig.join(shared.select("id").distinct(), "id").select("id", "node")
    # the one shuffle of texts
    texts = scratch(pool.join(needed, "node").select("id", "text").dropDuplicates(["id"]), "near-texts", "zstd")
    star = shared.where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    edges = scratch(verified(star, texts), "near-edges")
    found = components(edges)
    guessed = _dealt(shared, sig, found).groupBy(*BLOCK_KEYS).applyInArrow(_guess, "a long, b long").distinct()
    edges = edges.union(scratch(verified(guessed, texts), "near-guessed"))
    found = components(edges)
    last = _dealt(shared, sig, found).select("id", "bucket", "one", "two", "part", "component", "bands", "sketch")
    last = scratch(last.groupBy(*BLOCK_KEYS).applyInArrow(_involved, BLOCK_ROWS), "near-apart")
    counted = last.join(texts, "id").groupBy(*BLOCK_KEYS).applyInArrow(_count, "a long, b long")
    found = components(edges.union(scratch(counted, "near-counted")))
    classes = (rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first")).join(sig.select("id", F.col("node").alias("__n")), F.col("node") == F.col("__n"))
               .select("id", F.col("__n").alias("text_node"), "first"))
    classes = scratch(classes.join(found, F.col("id") == F.col("node"), "left")
                      .select("id", "text_node", "first", F.coalesce("component", "id").alias("component")), "near-classes")
    names = classes.groupBy("component").agg(F.min(F.struct("first", "id")).alias("keeper"))
    named = classes.join(names, "component").select("text_node", F.col("keeper.first").alias("class_id"), (F.col("keeper.id") == F.col("id")).alias("keeps"))
    out = rows.join(named, F.col("node") == F.col("text_node"), "left")
    alone = F.col("node").isNull()
    return out.select("doc_id", "node", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                      (alone | (F.col("keeps") & F.col("doc_id").eqNullSafe(F.col("class_id")))).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row left of every class of near-duplicates."""
    names = docs.columns
    found = near_duplicates(docs).where("kept and node is not null").select(
        F.col("doc_id").alias("__id"), F.col("node").alias("__node")).distinct()
    d = docs.withColumn("__n", node_of(F.col("text")))
    good = (d.where("__n is not null").join(found, (F.col("__n") == F.col("__node")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
            .dropDuplicates(["doc_id", "__n"]))
    return good.unionByName(d.where("__n is null")).select(*names)
