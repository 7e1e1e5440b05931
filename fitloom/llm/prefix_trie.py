"""Prefix trie of conversations by the Euler-tour technique, as joins and windows.

Turns are ordered within their conversation and conversations rebuilt (:func:`rebuilt`). A node is a
distinct sequence of first turns; its key is the XOR of 128-bit hashes of (place, turn), so that the key
of the node above is the key without the last turn, and a running XOR gives all keys of a conversation.
A node is named by its least conversation and its depth, which are unique to it.

Every node has an enter and an exit arc. The arc after ``enter(v)`` is the entry of v's first child, or
``exit(v)``; after ``exit(v)`` comes the entry of the next sibling, or the exit of the parent. The tour is a
linked list; :func:`rank_list` finds the place of each arc in it distributedly. Arcs of one conversation
that follow each other are one segment first (windows over at most ``2 * BLOCK`` arcs). Then rounds take
segments out whose hash is above both neighbours' (a third of them a round), each adding its length to the
one before it, until ``BASE`` remain; these are walked, and the rounds undone give every place. Leaves and
savings of a subtree are differences of prefix sums at its two arcs.

Hot groups: a conversation, a parent or an end with a third of all rows is spread: rows are ordered over
all partitions by range and numbered; windows run within (group, ``BLOCK`` numbers), with offsets from
one row per such block. Conversation ids that end at a node are joined up block by block before one task
hashes the node's text (SHA-256 goes through its input in order), so that it reads a row for ``ENDS`` ids.

Edge cases: rows without conv_id belong to no conversation; NULL role or text is empty; NULL turns come
first; equal turns of a conversation are ordered by MD5 of role and text; repeated rows are turns of their
own; texts of any length are hashed where they are read and travel no further; conversations left without
turns end at the root; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitloom.llm.common import scratch

BLOCK = 1024        # depths, or numbers of ordered rows, in a window
ENDS = 512          # conversation ids joined up at a time
BASE = 4096         # list elements that one task walks
SUMS = 1 << 14      # arcs in a window of prefix sums
UPTO = (Window.unboundedPreceding, Window.currentRow)
BEFORE = (Window.unboundedPreceding, -1)


def in_order(df: DataFrame, cols: list[Column | str], label: str) -> DataFrame:
    """``df`` ordered over all partitions, written, with ``at``: increasing in that order, with gaps."""
    spread = df.repartitionByRange(*cols).sortWithinPartitions(*cols)
    return scratch(spread.withColumn("at", F.monotonically_increasing_id()), label)


# conversations ---------------------------------------------------------------------------
def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), t1, t2 (120 bits of the MD5 of role and text), bytes."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.octet_length(text).cast("long").alias("bytes"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("t"))
    rows = in_order(rows, ["conv_id", F.col("turn").asc_nulls_first(), "t"], "trie-turns")
    rows = rows.withColumn("block", F.floor(F.col("at") / BLOCK))
    before = rows.groupBy("conv_id", "block").count().select(
        "conv_id", "block", F.coalesce(F.sum("count").over(Window.partitionBy("conv_id").orderBy("block").rowsBetween(*BEFORE)), F.lit(0)).alias("before"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("conv_id", "block").orderBy("at")))
    return rows.join(before, ["conv_id", "block"]).select(
        "conv_id", (F.col("before") + F.col("n")).alias("pos"), "bytes",
        *[F.conv(F.substring("t", k, 15), 16, 10).cast("long").alias(c) for k, c in ((1, "t1"), (17, "t2"))])


def rebuilt(conversations: DataFrame, share: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, length) and their rebuilt turns (conv_id, depth, t1, t2, bytes).

    A conversation c takes the first h turns of conversation c - c % ``share``, with h = crc32(c) % ``most``,
    and its own turns after its first h.
    """
    t = scratch(turns(conversations), "trie-places")
    c = t.groupBy("conv_id").agg(F.max("pos").alias("n")).select(
        "conv_id", "n", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h"),
        (F.col("conv_id") - F.col("conv_id") % share).alias("base"))
    base = c.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    c = c.join(base, "base", "left").withColumn("p", F.least("h", F.coalesce("n_base", F.lit(0))))
    c = scratch(c.select("conv_id", "base", "h", "p", (F.col("p") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "trie-plan")
    head = t.where(F.col("pos") < most).withColumnRenamed("conv_id", "base")
    taken = c.where("p > 0").select("conv_id", "base", "p").join(head, "base").where("pos <= p")
    own = t.join(c.select("conv_id", "h", "p"), "conv_id").where("pos > h")
    cols = ["t1", "t2", "bytes"]
    rows = taken.select("conv_id", F.col("pos").alias("depth"), *cols).unionByName(
        own.select("conv_id", (F.col("p") + F.col("pos") - F.col("h")).alias("depth"), *cols))
    return c.select("conv_id", "length"), rows


# nodes -----------------------------------------------------------------------------------
def keyed(rows: DataFrame) -> DataFrame:
    """Rebuilt turns with the key (k1, k2) of their node and that of the node above (p1, p2)."""
    rows = rows.withColumn("block", F.floor(F.col("depth") / BLOCK)).withColumn("x1", F.xxhash64("depth", "t1", "t2")).withColumn(
        "x2", F.xxhash64("t2", "t1", "depth"))
    run = "over (partition by conv_id, block order by depth rows between unbounded preceding and current row)"
    past = "over (partition by conv_id order by block rows between unbounded preceding and 1 preceding)"
    blocks = rows.groupBy("conv_id", "block").agg(F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2")).select(
        "conv_id", "block", *[F.expr(f"coalesce(bit_xor(b{k}) {past}, 0L)").alias(f"o{k}") for k in (1, 2)])
    rows = rows.select("conv_id", "depth", "block", "bytes", "x1", "x2", *[F.expr(f"bit_xor(x{k}) {run}").alias(f"r{k}") for k in (1, 2)])
    keys = [F.col(f"r{k}").bitwiseXOR(F.col(f"o{k}")).alias(f"k{k}") for k in (1, 2)]
    above = [F.col(f"k{k}").bitwiseXOR(F.col(f"x{k}")).alias(f"p{k}") for k in (1, 2)]
    return rows.join(blocks, ["conv_id", "block"]).select("*", *keys).select("conv_id", "depth", "bytes", "k1", "k2", *above)


def end_hashes(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2) -> SHA-256 of the ids of the conversations that end there, ascending, comma-joined."""
    rows = in_order(ends, ["conv_id"], "trie-ends").withColumn("block", F.floor(F.col("at") / ENDS))
    key = ["depth", "k1", "k2"]
    joined = rows.groupBy(*key, "block").agg(
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string"))).alias("ids"))

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None

        def sent(done: list[tuple]) -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(types)], names=[*key, "ends_sha256"])

        for batch in batches:
            done = []
            for k, ids in zip(zip(*[batch.column(c).to_pylist() for c in key], strict=True), batch.column("ids").to_pylist(), strict=True):
                if k == now:
                    sha.update(b",")
                else:
                    if now is not None:
                        done.append((*now, sha.hexdigest()))
                    now, sha = k, hashlib.sha256()
                sha.update(ids.encode())
            yield sent(done)
        if now is not None:
            yield sent([(*now, sha.hexdigest())])

    dealt = joined.repartition(*key).sortWithinPartitions(*key, "block").select(*key, "ids")
    return dealt.mapInArrow(digest, "depth long, k1 long, k2 long, ends_sha256 string")


def nodes(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, bytes, ends_sha256, n_children, first_child, next_sibling."""
    convs, rows = rebuilt(conversations)
    rows = scratch(keyed(rows), "trie-keys")
    zero = F.lit(0).cast("long")
    found = rows.groupBy("depth", "k1", "k2").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id", "n_convs", zero.alias("bytes"), zero.alias("p1"), zero.alias("p2"))
    found = scratch(found.unionByName(root), "trie-nodes")
    ends = rows.join(convs.withColumnRenamed("length", "depth"), ["conv_id", "depth"], "left_semi").select("conv_id", "depth", "k1", "k2").unionByName(
        convs.where("length = 0").select("conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2")))
    above = found.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    found = found.join(above, ["depth", "p1", "p2"], "left").join(end_hashes(ends), ["depth", "k1", "k2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "bytes", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
    found = scratch(found, "trie-named")
    # children in order of conv_id, over all parents
    child = found.where("depth > 0").select("parent_conv_id", "depth", "conv_id")
    child = in_order(child, ["parent_conv_id", "depth", "conv_id"], "trie-children").withColumn("block", F.floor(F.col("at") / BLOCK))
    family = ["parent_conv_id", "depth"]
    after = child.groupBy(*family, "block").agg(F.min("conv_id").alias("first")).select(
        *family, "block", F.lead("first").over(Window.partitionBy(*family).orderBy("block")).alias("later"))
    nxt = child.withColumn("next", F.lead("conv_id").over(Window.partitionBy(*family, "block").orderBy("conv_id")))
    nxt = nxt.join(after, [*family, "block"]).select("conv_id", "depth", F.coalesce("next", "later").alias("next_sibling"))
    children = child.groupBy(*family).agg(F.count(F.lit(1)).alias("n_children"), F.min("conv_id").alias("first_child")).select(
        F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"), "n_children", "first_child")
    out = found.join(nxt, ["conv_id", "depth"], "left").join(children, ["conv_id", "depth"], "left")
    return scratch(out.withColumn("n_children", F.coalesce("n_children", zero)), "trie-linked")


# Euler tour ------------------------------------------------------------------------------
def tour(tree: DataFrame) -> DataFrame:
    """Enter (kind 0) and exit (kind 1) arcs with the arc after each, and the segment of following arcs each lies in.

    An arc is (c, s): conversation and 2 * depth + kind. ``head`` is the s of its segment's first arc, ``step`` its place there.
    """
    enter_next = F.when(F.col("first_child").isNotNull(), F.struct(F.col("first_child").alias("c"), (2 * F.col("depth") + 2).alias("s"))).otherwise(
        F.struct(F.col("conv_id").alias("c"), (2 * F.col("depth") + 1).alias("s")))
    exit_next = F.when(F.col("next_sibling").isNotNull(), F.struct(F.col("next_sibling").alias("c"), (2 * F.col("depth")).alias("s"))).when(
        F.col("depth") > 0, F.struct(F.col("parent_conv_id").alias("c"), (2 * F.col("depth") - 1).alias("s")))
    both = F.array(
        F.struct(F.lit(0).alias("kind"), F.col("depth").alias("turn"), enter_next.alias("next"),
                 (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")),
        F.struct(F.lit(1).alias("kind"), (F.lit(1 << 40) - F.col("depth")).alias("turn"), exit_next.alias("next"),
                 F.lit(0).cast("long").alias("leaf"), F.lit(0).cast("long").alias("saved")))
    arcs = tree.select(F.col("conv_id").alias("c"), "depth", F.explode(both).alias("a")).select(
        "c", (2 * F.col("depth") + F.col("a.kind")).alias("s"), F.floor(F.col("depth") / BLOCK).alias("block"), "a.turn", "a.next", "a.leaf", "a.saved")
    w = Window.partitionBy("c", "block").orderBy("turn")
    runs = Window.partitionBy("c", "block").orderBy("turn").rowsBetween(*UPTO)
    arcs = arcs.withColumn("last", F.lag("next").over(w)).withColumn("n", F.row_number().over(w))
    new = ~F.coalesce((F.col("last.c") == F.col("c")) & (F.col("last.s") == F.col("s")), F.lit(False))
    arcs = arcs.withColumn("at_head", F.last(F.when(new, F.struct("s", "n")), ignorenulls=True).over(runs))
    return arcs.select("c", "s", F.col("at_head.s").alias("head"), (F.col("n") - F.col("at_head.n")).cast("long").alias("step"), "next", "leaf", "saved")


def walked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places in a list of at most ``BASE`` elements (c, s, w, next)."""
    rows = [r for b in batches for r in b.to_pylist()]
    after = {(r["c"], r["s"]): r for r in rows}
    later = {(r["nc"], r["ns"]) for r in rows if r["nc"] is not None}
    out, place = [], 0
    now = next((k for k in after if k not in later), None)
    while now is not None:
        r = after[now]
        out.append((*now, place))
        place += r["w"]
        now = (r["nc"], r["ns"]) if r["nc"] is not None else None
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], names=["c", "s", "place"])


def rank_list(elements: DataFrame, base: int = BASE) -> DataFrame:
    """Place (c, s, place) of every element of one linked list: the sum of the lengths ``w`` before it.

    ``elements``: c, s, w, and nc, ns of the element after it (NULL at the end).
    """
    preds = elements.where("nc is not null").select(F.col("nc").alias("c"), F.col("ns").alias("s"), F.col("c").alias("pc"), F.col("s").alias("ps"))
    now = scratch(elements.select("c", "s", "w", "nc", "ns").join(preds, ["c", "s"], "left"), "list-0")
    rounds: list[DataFrame] = []
    while now.count() > base:
        n = len(rounds)
        own, before, after = (F.xxhash64(a, b, F.lit(n)) for a, b in (("c", "s"), ("pc", "ps"), ("nc", "ns")))
        out = F.col("pc").isNotNull() & (own > before) & (F.col("nc").isNull() | (own > after))
        here = F.struct("w", "pc", "ps", "nc", "ns")
        kinds = {"own": "struct<w:bigint,pc:bigint,ps:bigint,nc:bigint,ns:bigint>", "taken": "struct<c:bigint,s:bigint,w:bigint,nc:bigint,ns:bigint>",
                 "pred": "struct<pc:bigint,ps:bigint>"}

        def message(c: str, s: str, kinds: dict = kinds, **held: Column) -> Column:
            return F.struct(F.col(c).alias("c"), F.col(s).alias("s"), *[held.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()])

        told = F.when(out, F.array(message("pc", "ps", taken=F.struct("c", "s", "w", "nc", "ns")), message("nc", "ns", pred=F.struct("pc", "ps")))).otherwise(
            F.array(message("c", "s", own=here)))
        rows = now.select(F.explode(told).alias("m")).select("m.*").where("c is not null")
        rows = rows.groupBy("c", "s").agg(*[F.max(k).alias(k) for k in kinds])
        taken = F.col("taken").isNotNull()
        rows = rows.select(
            "c", "s", (F.col("own.w") + F.coalesce("taken.w", F.lit(0))).alias("w"),
            F.when(taken, F.col("taken.nc")).otherwise(F.col("own.nc")).alias("nc"), F.when(taken, F.col("taken.ns")).otherwise(F.col("own.ns")).alias("ns"),
            F.coalesce("pred.pc", "own.pc").alias("pc"), F.coalesce("pred.ps", "own.ps").alias("ps"),
            F.col("taken.c").alias("xc"), F.col("taken.s").alias("xs"), F.col("own.w").alias("offset"))
        now = scratch(rows, f"list-{n + 1}")
        rounds.append(now)
    places = now.select("c", "s", "w", "nc", "ns").repartition(1).mapInArrow(walked, "c long, s long, place long")
    for made in reversed(rounds):
        found = made.select("c", "s", "xc", "xs", "offset").join(places, ["c", "s"])
        pair = F.array(F.struct("c", "s", "place"), F.when(F.col("xc").isNotNull(), F.struct(
            F.col("xc").alias("c"), F.col("xs").alias("s"), (F.col("place") + F.col("offset")).alias("place"))))
        places = scratch(found.select(F.explode(pair).alias("p")).where("p is not null").select("p.*"), "list-places")
    return places


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Every node with the numbers of its subtree, and the places of its two arcs in the tour."""
    tree = nodes(conversations)
    arcs = scratch(tour(tree), "trie-arcs")
    segments = arcs.groupBy("c", "head").agg(F.count(F.lit(1)).alias("w"), F.max_by("next", "step").alias("next"))
    places = rank_list(segments.select("c", F.col("head").alias("s"), "w", F.col("next.c").alias("nc"), F.col("next.s").alias("ns")))
    placed = arcs.join(places.withColumnRenamed("s", "head"), ["c", "head"]).select(
        "c", "s", "leaf", "saved", (F.col("place") + F.col("step")).alias("at"))
    placed = scratch(placed.withColumn("block", F.floor(F.col("at") / SUMS)), "trie-tour")
    past = Window.orderBy("block").rowsBetween(*BEFORE)
    blocks = placed.groupBy("block").agg(F.sum("leaf").alias("l"), F.sum("saved").alias("v")).select(
        "block", *[F.coalesce(F.sum(x).over(past), F.lit(0)).alias(x) for x in ("l", "v")])
    run = Window.partitionBy("block").orderBy("at").rowsBetween(*UPTO)
    sums = placed.select("c", "s", "at", "leaf", "saved", "block", F.sum("leaf").over(run).alias("leaves"), F.sum("saved").over(run).alias("savings"))
    sums = sums.join(blocks, "block")
    is_exit = F.col("s") % 2 == 1

    def inside(run_sum: str, past_sum: str, own: str) -> Column:
        upto = F.col(run_sum) + F.col(past_sum)
        return F.sum(F.when(is_exit, upto).otherwise(F.col(own) - upto))

    totals = sums.groupBy(F.col("c").alias("conv_id"), F.floor(F.col("s") / 2).alias("depth")).agg(
        inside("leaves", "l", "leaf").alias("n_leaves"), inside("savings", "v", "saved").alias("saved_tokens"),
        F.max(F.when(~is_exit, F.col("at"))).alias("enter_at"), F.max(F.when(is_exit, F.col("at"))).alias("exit_at"))
    return tree.join(totals, ["conv_id", "depth"]).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "enter_at", "exit_at")
