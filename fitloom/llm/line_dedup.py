"""Line dedup over content-defined chunks of lines [native].

Lines: a text is split after every newline and every sentence end (``. ``, ``! ``, ``? ``); what is
longer than ``LONG_LINE`` characters is split further, past the first white space after every
``PIECE`` characters. The lines put together again are the text, byte for byte.

Chunks: line hashes are rolled over a window of two lines, and the rolling hashes are counted over
the whole corpus. A chunk ends wherever the rolling hash across the border occurs once (no
repeated chunk can span it), and, within the runs of lines that are left, where the rolling hash
of a line is less than both its neighbours'. So a passage that stands between foreign lines is cut
off from them and cut alike wherever it stands, from its first line on, and every chunk has two lines
at least. Runs of under ``RUN_CHARS`` characters are not compared: pairs of very short lines
repeat by chance.

Dedup: chunks are compared over the whole corpus: they are grouped by hash and bytes (that is the
byte comparison), and each group keeps its first chunk by (doc_id, text hash, position). Only
rolling hashes, runs, repeated chunks and the final join by document are shuffled; the
aggregations combine on the map side, so a chunk found in a third of all rows is no hot task.

Edge cases: NULL text stays NULL; empty text stays empty; a document whose chunks all go
keeps its row with an empty text; a trailing newline is no part of the comparison; rows that
repeat doc_id and text count as one document and get the same result; an empty table gives no
rows; further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitloom.llm.common import SPACE_CLASS, keep_listed, scratch, scratch_by, shuffle_partitions

LINE_ENDS = ("\n", ". ", "! ", "? ")
# set behind every line's end, to split there without a regex; a text that has it already is split by one
MARK = "\x00"
LINE_BORDER = r"(?<=[\n ])(?<=\n|[.!?] )"
LONG_LINE = 160
PIECE = 80
# past the white space, or past 40 further characters where there is none
PIECES = rf"(?s).{{{PIECE}}}[^\x20\x09-\x0D]{{0,40}}{SPACE_CLASS}*|.+"
RUN_CHARS = 120
# a list of documents with pairs of line numbers is broadcast up to this many pairs and documents (some 32 MB)
BROADCAST_PAIRS = 500_000


def _bytes(line: Column) -> Column:
    """``line`` without the newlines at its end; it is referred to more than once."""
    # trimming walks the whole text by characters, so only what needs it is trimmed
    return (F.when(F.endswith(line, F.lit("\n\n")), F.rtrim(line, F.lit("\n")))
            .when(F.endswith(line, F.lit("\n")), F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line))


def _bounded(listed: DataFrame, pairs: str) -> DataFrame:
    """``listed`` marked for broadcast where its rows and the elements of its arrays ``pairs`` are counted and few;
    beyond that it is shuffled to the buckets of the table of lines, with the same rows."""
    n = listed.agg(F.coalesce(F.sum(F.size(pairs) + 1), F.lit(0)).alias("n")).first()["n"]
    return F.broadcast(listed) if n <= BROADCAST_PAIRS else listed.hint("shuffle_hash")


def _cut(text: Column) -> Column:
    """The lines of ``text``, which may end with an empty one."""
    marked = text
    for end in LINE_ENDS:
        marked = F.replace(marked, F.lit(end), F.lit(end + MARK))
    return F.when(F.contains(text, F.lit(MARK)), F.split(text, LINE_BORDER, -1)).otherwise(F.split(marked, MARK, -1))


def lined(docs: DataFrame) -> DataFrame:
    """``docs`` with the text replaced by ``__lines``, their lengths ``__chars``, the rolling hashes ``__windows``
    over each line and the next, and the row's number ``__rid``, by which the rows are dealt."""
    # each array is a column of its own: referred to more than once, it is evaluated once per row
    # dealt before the text is cut: as one string it is smaller than its lines
    d = docs.withColumn("__rid", F.monotonically_increasing_id()).repartition(shuffle_partitions(docs.sparkSession), "__rid")
    d = d.withColumn("__text_hash", F.xxhash64("text"))
    d = d.withColumn("__lines", F.filter(_cut(F.col("text")), lambda s: s != "")).drop("text")
    long_line = F.exists("__lines", lambda s: F.length(s) > LONG_LINE)
    pieces = F.flatten(F.transform("__lines", lambda s: F.when(
        F.length(s) > LONG_LINE, F.regexp_extract_all(s, F.lit(PIECES), F.lit(0))).otherwise(F.array(s))))
    d = d.withColumn("__lines", F.when(long_line, pieces).otherwise(F.col("__lines")))
    d = d.withColumn("__hashes", F.transform("__lines", lambda s: F.xxhash64(_bytes(s))))
    first = F.slice("__hashes", F.lit(1), F.greatest(F.size("__hashes") - 1, F.lit(0)))
    d = d.withColumn("__windows", F.transform(first, lambda h, i: F.xxhash64(h, F.get("__hashes", i + 1))))
    d = d.withColumn("__chars", F.transform("__lines", lambda s: F.length(s)))
    return d.drop("__hashes")


def runs(rows: DataFrame) -> DataFrame:
    """(__rid, __runs): array<struct<first, last>>, the lines of each run of repeated rolling hashes."""
    found = rows.select("__rid", F.posexplode("__windows").alias("k", "window"))
    # the one place of a rolling hash that occurs once comes with its count: nothing is joined to find it
    once = found.groupBy("window").agg(F.count("*").alias("n"), F.min("__rid").alias("__rid"), F.min("k").alias("k")).where("n = 1")
    ends = rows.where(F.size("__windows") > 0).select("__rid", F.size("__windows").alias("k"), "__chars")
    found = once.select("__rid", "k", F.lit(None).cast("array<int>").alias("__chars")).unionByName(ends)
    found = found.groupBy("__rid").agg(F.sort_array(F.collect_list("k")).alias("ks"), F.max_by("__chars", "k").alias("__chars"))
    # a run is what lies between a window that occurs once, or the text's start, and the next one, or the text's end
    found = found.select("__rid", "__chars", F.transform("ks", lambda k, i: F.struct(
        F.coalesce(F.get("ks", i - 1) + 1, F.lit(0)).alias("first"), k.alias("last"))).alias("__runs"))
    long_enough = F.filter("__runs", lambda r: (r["last"] > r["first"]) & (F.aggregate(
        F.slice("__chars", r["first"] + 1, r["last"] - r["first"] + 1), F.lit(0), lambda x, c: x + c) >= RUN_CHARS))
    return found.select("__rid", long_enough.alias("__runs")).where(F.size("__runs") > 0)


def _ends(x: Column, i: Column) -> Column:
    """Whether a chunk ends with line ``i`` of ``lines``: at a least rolling hash, or at the run's end;
    ``marks`` has the rolling hash over each line and the one before it."""
    here = F.get("marks", i)
    least = (F.get("marks", i - 1) > here) & (F.get("marks", i + 1) > here) & (i + 2 < F.size("lines"))
    return (i == F.size("lines") - 1) | F.coalesce(least, F.lit(False))


def chunks(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(__rid, id, t, first, last, bytes, hash): the chunks of all runs ``found``, by first and last line."""
    # the generators are outer ones (no array is empty here): of others Spark infers a filter, which it pushes
    # down with the arrays written out, each evaluated once per element of the next
    d = rows.select("__rid", "doc_id", "__text_hash", "__lines").join(_bounded(found, "__runs"), "__rid")
    d = d.withColumn("__runs", F.transform("__runs", lambda r: F.struct(
        r["first"].alias("first"), F.slice("__lines", r["first"] + 1, r["last"] - r["first"] + 1).alias("lines")))).drop("__lines")
    d = d.select("__rid", "doc_id", "__text_hash", F.inline_outer("__runs"))
    d = d.withColumn("hashes", F.transform("lines", lambda s: F.md5(_bytes(s))))
    d = d.withColumn("marks", F.transform("hashes", lambda h, i: F.when(i > 0, F.md5(F.concat(F.get("hashes", i - 1), h)))))
    d = d.withColumn("ends", F.filter(F.transform("lines", lambda x, i: F.when(_ends(x, i), i)), lambda i: i.isNotNull()))
    body = F.transform("ends", lambda e, k: F.struct(
        F.coalesce(F.get("ends", k - 1) + 1, F.lit(0)).alias("from"), e.alias("to")))
    d = d.withColumn("cuts", body).withColumn("cuts", F.transform("cuts", lambda c: F.struct(
        (F.col("first") + c["from"]).alias("begin"), (F.col("first") + c["to"]).alias("end"),
        F.array_join(F.slice("lines", c["from"] + 1, c["to"] - c["from"] + 1), "").alias("text"))))
    d = d.withColumn("cuts", F.transform("cuts", lambda c: F.struct(c["begin"], c["end"], _bytes(c["text"]).alias("bytes"))))
    d = d.select("__rid", F.col("doc_id").alias("id"), F.col("__text_hash").alias("t"), F.inline_outer("cuts"))
    return d.withColumn("hash", F.xxhash64("bytes"))


def removals(rows: DataFrame) -> DataFrame:
    """(__rid, __compared, __gone): for each document with chunks to compare, how many they are and
    the first and last lines of those that go."""
    found = scratch(runs(rows), "lines-runs")
    texts = scratch(chunks(rows, found), "lines-chunks", compression="zstd")
    place = F.struct("id", "t", "begin")
    groups = texts.groupBy("hash", "bytes").agg(F.min(place).alias("kept"), F.max(place).alias("other"))
    # chunks with one hash but different bytes are collisions: a handful, told apart by their bytes
    groups = scratch(groups.withColumn("texts", F.count("*").over(Window.partitionBy("hash")))
                     .where((F.col("texts") > 1) | ~F.col("kept").eqNullSafe(F.col("other")))
                     .select("hash", "kept", F.when(F.col("texts") > 1, F.col("bytes")).alias("same")), "lines-groups")
    alike = texts.select("__rid", "id", "t", "begin", "end", "hash").join(groups.where("same is null").drop("same"), "hash", "left")
    # few or no chunks have such a hash: only these are shuffled with their bytes
    told = groups.where("same is not null")
    clash = keep_listed(texts, told.select("hash").distinct(), "hash").join(
        told.withColumnRenamed("same", "bytes"), ["hash", "bytes"]).select("__rid", "id", "t", "begin", "end", "hash", "kept")
    judged = alike.unionByName(clash)
    gone = F.col("kept").isNotNull() & ~place.eqNullSafe(F.col("kept"))
    judged = judged.groupBy("__rid").agg(
        F.count_distinct("begin").alias("__compared"), F.collect_set(F.when(gone, F.struct("begin", "end"))).alias("__gone"))
    return judged


def dedup_lines(docs: DataFrame, report: bool = True) -> DataFrame:
    """``docs`` with repeated chunks cut from ``text``; ``report`` adds n_chunks (compared) and n_removed
    (in place of columns of ``docs`` with these names)."""
    names = [c for c in docs.columns if not (report and c in ("n_chunks", "n_removed"))]
    rows = scratch_by(lined(docs), "lines", "__rid")
    gone = scratch(removals(rows), "lines-gone")
    left = rows.join(_bounded(gone, "__gone"), "__rid", "left")
    lost = F.flatten(F.transform("__gone", lambda g: F.sequence(g["begin"], g["end"])))
    left = left.withColumn("__lost", F.when(F.size("__gone") > 0, lost))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__lost")
    left = left.withColumn("__kept", F.when(F.col("__lost").isNotNull(), kept))
    text = F.when(F.col("__lost").isNull(), F.array_join("__lines", "")).otherwise(
        F.array_join(F.transform("__kept", lambda i: F.get("__lines", i)), ""))
    out = left.withColumn("text", text)
    if not report:
        return out.select(*names)
    return out.select(*names, F.coalesce("__compared", F.lit(0)).cast("int").alias("n_chunks"),
                      F.greatest(F.size("__gone"), F.lit(0)).alias("n_removed"))
