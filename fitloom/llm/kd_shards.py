"""Sharding by K-d tree: weighted medians along the widest metadata dimension [native].

The rows are points in a space of metadata dimensions (text bytes on a log scale,
source, language, doc_id). Starting from one leaf, every leaf that holds more than
one shard's share is split along the dimension whose values span the largest part
of that dimension's whole range; the cut is the weighted median (weight: bytes) or,
for an odd number of shards, the matching weighted quantile. Splitting ends when
every leaf holds the target bytes, i.e. ``total / n_shards``.

The cut is found by radix descent: a row's key on a dimension is 24 bits of the
value's place in its range, then 16 bits of a hash of the row and 16 of a hash of its place in
the written table, so equal values (a hot source, copies of one text, one row repeated) still
have a median to cut at. Each pass sums bytes
per (leaf, next 8 key bits) with map-side partial sums; at most 256 rows per open
leaf reach the driver, whatever the size of the table. Rows move only once, at
the end, to number the slots.

Law ``bytes``: a cut misses the exact split by less than one key's bytes, or by
``tolerance`` of the target where a pass is already that close. Copies of a text are
not held together: a group with a third of all rows could not be, under this law.

Edge cases: NULL text counts as empty (size 1, CRC 0); a NULL dimension sorts
first; ties are told apart by the row hash, rows that agree in doc_id and text by their
place in the written table, so they need not stay together; an empty table gives no rows; further columns of
``docs`` are ignored, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitloom.llm.common import local_rows, scratch

VALUE_BITS = 24
TIE_BITS = 32        # half from the row, half from its place
RADIX_BITS = 8
ROWS_PER_SLOT_BUCKET = 20_000


def _string_place(c: Column) -> Column:
    """First seven UTF-8 bytes as a number: keeps the order of strings; NULL lowest."""
    digits = F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), 1, 7)), 14, "0")
    return F.coalesce(F.conv(digits, 16, 10).cast("double") + 1, F.lit(0.0))


def default_dimensions(docs: DataFrame) -> list[Column]:
    """Metadata dimensions, in the order that settles equal widths."""
    return [
        F.log2(F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 1.0),
        _string_place(F.col("source")),
        _string_place(F.col("lang")),
        F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.0)),
    ]


def kd_shards(docs: DataFrame, n_shards: int = 16, dimensions: list[Column] | None = None,
              tolerance: float = 1e-3) -> DataFrame:
    """Shard every row of ``docs``; returns doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    spark = docs.sparkSession
    dims = dimensions or default_dimensions(docs)
    points = scratch(docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.shiftleft(F.shiftrightunsigned(F.xxhash64("doc_id", text), 64 - TIE_BITS // 2), TIE_BITS // 2).bitwiseOR(
            F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - TIE_BITS // 2)).alias("tie"),
        F.lit(0).alias("leaf"),
        *[d.cast("double").alias(f"d{i}") for i, d in enumerate(dims)],
    ), "kd-points")
    ranges = points.agg(
        F.count("*").alias("n"),
        *[f(f"d{i}").alias(f"{name}{i}") for i in range(len(dims)) for name, f in (("lo", F.min), ("hi", F.max))],
    ).first()

    def place(i: int) -> Column:
        lo, hi = ranges[f"lo{i}"], ranges[f"hi{i}"]
        if lo is None or hi <= lo:
            return F.lit(0).cast("long")
        return F.floor((F.col(f"d{i}") - F.lit(lo)) / F.lit(hi - lo) * F.lit(2**VALUE_BITS - 1)).cast("long")

    keyed = points.select("doc_id", "size", "text_crc32", "tie", "leaf", *[place(i).alias(f"k{i}") for i in range(len(dims))])
    shards_of, next_leaf = {0: (0, n_shards)}, 1
    while any(k > 1 for _, k in shards_of.values()):
        cuts = _cuts(keyed, {leaf: k for leaf, (_, k) in shards_of.items() if k > 1}, len(dims), tolerance)
        rows, grown = [], {leaf: v for leaf, v in shards_of.items() if v[1] == 1}
        for leaf, (first, k) in shards_of.items():
            if k == 1:
                continue
            left = k // 2
            grown[leaf], grown[next_leaf] = (first, left), (first + left, k - left)
            dim, cut = cuts.get(leaf, (0, 0))
            rows.append((leaf, dim, cut, next_leaf))
            next_leaf += 1
        shards_of = grown
        table = local_rows(spark, rows, [("leaf", "int"), ("cut_dim", "int"), ("cut", "bigint"), ("right_leaf", "int")])
        # one row per open leaf: never more than n_shards rows
        keyed = keyed.join(F.broadcast(table), "leaf", "left")
        keyed = keyed.withColumn("leaf", F.when(_key(F.col("cut_dim"), len(dims)) >= F.col("cut"), F.col("right_leaf"))
                                 .otherwise(F.col("leaf"))).drop("cut_dim", "cut", "right_leaf")
    names = local_rows(spark, [(leaf, first) for leaf, (first, _) in shards_of.items()], [("leaf", "int"), ("shard", "int")])
    placed = keyed.join(F.broadcast(names), "leaf").select("doc_id", "size", "text_crc32", "tie", "shard")
    return _number_slots(placed, max(1, -(-ranges["n"] // (n_shards * ROWS_PER_SLOT_BUCKET))))


def _key(dim: Column, n_dims: int) -> Column:
    return F.shiftleft(F.element_at(F.array(*[F.col(f"k{i}") for i in range(n_dims)]), dim + 1), TIE_BITS).bitwiseOR(F.col("tie"))


def _cuts(keyed: DataFrame, open_leaves: dict[int, int], n_dims: int, tolerance: float) -> dict[int, tuple[int, int]]:
    """Widest dimension and first key of the right half for each open leaf that has rows."""
    spark = keyed.sparkSession
    stats = keyed.where(F.col("leaf").isin(list(open_leaves))).groupBy("leaf").agg(
        F.sum("size").alias("bytes"), *[(F.max(f"k{i}") - F.min(f"k{i}")).alias(f"w{i}") for i in range(n_dims)]).collect()
    state = {}
    for r in stats:
        k = open_leaves[r["leaf"]]
        dim = max(range(n_dims), key=lambda i, r=r: (r[f"w{i}"], -i))
        state[r["leaf"]] = {"dim": dim, "prefix": 0, "below": 0, "goal": r["bytes"] * (k // 2) / k,
                            "near": tolerance * r["bytes"] / k, "cut": None}
    bits = VALUE_BITS + TIE_BITS
    for done in range(0, bits, RADIX_BITS):
        going = [(leaf, s["dim"], s["prefix"]) for leaf, s in state.items() if s["cut"] is None]
        if not going:
            break
        table = local_rows(spark, going, [("leaf", "int"), ("dim", "int"), ("prefix", "bigint")])
        hit = keyed.join(F.broadcast(table), "leaf").withColumn("key", _key(F.col("dim"), n_dims))
        if done:
            hit = hit.where(F.shiftright("key", bits - done) == F.col("prefix"))
        step = F.shiftright("key", bits - done - RADIX_BITS).bitwiseAND(F.lit(2**RADIX_BITS - 1).cast("long"))
        sums: dict[int, list[tuple[int, int]]] = {}
        for r in hit.groupBy("leaf", step.alias("step")).agg(F.sum("size").alias("bytes")).collect():
            sums.setdefault(r["leaf"], []).append((r["step"], r["bytes"]))
        for leaf, parts in sums.items():
            s = state[leaf]
            for value, held in sorted(parts):
                if s["below"] + held > s["goal"]:
                    break
                s["below"] += held
            start = (s["prefix"] << RADIX_BITS) | value
            shift = bits - done - RADIX_BITS
            before, after = s["goal"] - s["below"], s["below"] + held - s["goal"]
            if min(before, after) <= s["near"] or not shift:
                s["cut"] = (start if before <= after else start + 1) << shift
            else:
                s["prefix"] = start
    return {leaf: (s["dim"], s["cut"]) for leaf, s in state.items()}


def _number_slots(placed: DataFrame, buckets: int) -> DataFrame:
    """Gapless slots per shard: positions inside (shard, hash bucket) plus the counts of the buckets before."""
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("tie", "doc_id"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
               .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip")))
    here = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return (placed.withColumn("at", F.row_number().over(here) - 1)
            .join(offsets, ["shard", "bucket"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("at") + F.col("skip")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
