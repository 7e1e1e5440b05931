"""Personal data: pattern spans, and terms that disclose them [native].

Base spans: emails, IP addresses, payment cards (Luhn) and phone numbers, leftmost and
without overlap per kind, by code point offsets. The patterns are possessive and anchored where
a run of their characters begins, so a long run costs linear time and no stack; they match
what the plain patterns match. Offsets come from the texts between the matches; their
running sums are taken in two levels, so a text with very many matches stays cheap.

Disclosing terms (C-sanitisation): every base match is a protected entity e. The terms of
its text co-occur with it, wherever they stand; words of the entity itself do not. Over the texts of
the whole corpus (equal texts count once), ``PMI(t; e) = log2(n(t, e) * n / (n(t) * n(e)))`` says
how many of the ``IC(e) = log2(n / n(e))`` bits of the entity the term gives away. A term that gives
away ``GENERALISE`` of them is a span of kind ``term`` wherever it occurs, and is replaced by a
placeholder; from ``REMOVE`` on it is removed. A pair counts once it was seen in ``SUPPORT`` classes
of near copies, none of them with more than half of its texts, so copies and near copies of one
text do not make its words disclosing, while a fixed signature under different texts does. The
class of a text is the least hash of its runs of ``SHINGLE`` words: two texts share it with the
probability of their runs' overlap. An entity in fewer than ``SUPPORT`` texts has no term.

Only texts with an entity of that support send pairs, combined on the map side; document counts are
taken for terms of such pairs alone. The base result is written without texts, so the last
join moves no text.

Edge cases: NULL text counts as empty: no spans, the hash of the empty string; texts are
read whole; repeated rows get the same result; an empty table gives no rows; extra columns pass
through ``sanitised`` and are ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitloom.llm.common import scratch

# The kinds in the order of the result, and their patterns. ``\G`` is the end of the match before.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# what a text must contain for a kind to be looked for at all
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
TERM = r"\p{L}[\p{L}\p{N}_-]{2,}"
SUPPORT = 3
SHINGLE = 3
GENERALISE, REMOVE = 0.8, 0.95
SUM_BLOCK = 256


def _luhn(digits: Column) -> Column:
    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1))
        d = F.when(i % 2 == 1, F.translate(d, "0123456789", "0246813579")).otherwise(d)
        return total + d.cast("int")

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def _holds(kind: str, s: Column) -> Column:
    digits = F.regexp_replace(s, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return s.rlike("^" + r"\.".join([OCTET] * 4) + "$")
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _filter_of(kind: str):
    return lambda x: _holds(kind, x["s"])


def _entity_of(kind: str):
    return lambda x: F.concat(F.lit(kind + ":"), F.lower(x["s"]))


def _mark_of(kind: str):
    return lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("end"), F.lit(f"[{kind.upper()}]").alias("put"))


def _places(d: DataFrame, out: str, found: Column, between: Column) -> DataFrame:
    """Add ``out``: array<struct<s, start, end>> of the matches ``found``, given the texts ``between`` them."""
    # lengths of the text before each match and of the match; step[k]: from match k - 1's start to match k's
    d = d.withColumn("__m", found)
    d = d.withColumn("__len", F.zip_with(between, "__m", lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m"))))
    d = d.withColumn("__step", F.transform("__m", lambda m, k: F.get("__len", k)["g"] + F.coalesce(F.get("__len", k - 1)["m"], F.lit(0))))
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size("__step") / SUM_BLOCK).cast("int")),
                         lambda b: F.aggregate(F.slice("__step", b * SUM_BLOCK + 1, F.lit(SUM_BLOCK)), F.lit(0), lambda a, x: a + x))
    d = d.withColumn("__block", F.when(F.size("__step") > 0, blocks))
    d = d.withColumn("__base", F.transform("__block", lambda x, b: F.aggregate(F.slice("__block", F.lit(1), b), F.lit(0), lambda a, y: a + y)))

    def place(m: Column, k: Column) -> Column:
        b = F.floor(k / SUM_BLOCK).cast("int")
        start = F.get("__base", b) + F.aggregate(F.slice("__step", b * SUM_BLOCK + 1, k % SUM_BLOCK + 1), F.lit(0), lambda a, x: a + x)
        return F.struct(m.alias("s"), start.alias("start"), (start + F.length(m)).alias("end"))

    return d.withColumn(out, F.transform("__m", place)).drop("__m", "__len", "__step", "__block", "__base")


def with_base_spans(d: DataFrame, text: str) -> DataFrame:
    """``d`` plus one column ``__<kind>``, array<struct<s, start, end>>, per kind; ``text`` has no NULL."""
    t = F.col(text)
    none = F.array().cast("array<string>")
    has_digit = t.rlike("[0-9]")
    for kind in KINDS:
        look = F.contains(t, F.lit(HINTS[kind])) if HINTS[kind] else F.lit(True)
        if kind != "email":
            look = look & has_digit
        found = F.when(look, F.regexp_extract_all(t, F.lit(PATTERNS[kind]), F.lit(0))).otherwise(none)
        between = F.when(look, F.split(t, PATTERNS[kind], -1)).otherwise(none)
        d = _places(d, f"__{kind}", found, between)
        d = d.withColumn(f"__{kind}", F.filter(f"__{kind}", _filter_of(kind)))
    return d


def _listed(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")))


def _row_key(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").alias("id"), F.xxhash64(text).alias("t"), text.alias("text"))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def base(docs: DataFrame) -> DataFrame:
    """id, t, the spans of each kind, and for texts with any the entities, the terms, those outside of emails and
    the class of near copies; written to the shared folder without texts."""
    d = with_base_spans(_row_key(docs), "text")
    d = d.withColumn("entities", F.array_distinct(F.concat(*[F.transform(f"__{k}", _entity_of(k)) for k in KINDS])))
    some = F.size("entities") > 0
    d = d.withColumn("__words", F.when(some, _words(F.col("text"))))
    runs = F.transform("__words", lambda w, i: F.xxhash64(w, *[F.get("__words", i + k) for k in range(1, SHINGLE)]))
    whole = F.size("__words") >= SHINGLE
    runs = F.when(whole, F.slice(runs, F.lit(1), F.size("__words") - (SHINGLE - 1))).otherwise(runs)
    # no other kind has letters
    outside = F.when(F.size("__email") > 0, _words(F.regexp_replace("text", PATTERNS["email"], " "))).otherwise(F.col("__words"))
    return scratch(d.select(
        "id", "t", *[F.transform(f"__{k}", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias(k) for k in KINDS],
        "entities", F.array_distinct("__words").alias("terms"), F.when(some, F.array_distinct(outside)).alias("outside"),
        F.when(some, F.coalesce(F.array_min(runs), F.col("t"))).alias("class")), "pii-base")


def _share(n: int, both: Column, n_term: Column, n_entity: Column) -> Column:
    """PMI of term and entity as a share of the entity's information."""
    bits = F.log2(F.lit(float(n)) / n_entity)
    return F.when(bits > 0, F.log2(both * float(n) / (n_term * n_entity)) / bits).otherwise(0.0)


def disclosing_terms(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(id, t, term, share) for every text and each term in it that gives away at least
    ``GENERALISE`` of some entity's information."""
    n = max(2, found.select("t").distinct().count())
    held = found.where(F.size("entities") > 0)
    # equal texts have equal entities: map-side sums over distinct (entity, text)
    entities = held.select("t", F.explode("entities").alias("entity")).distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    entities = scratch(entities.where(F.col("n_entity") >= SUPPORT), "pii-entities")
    with_any = (held.select("t", F.explode("entities").alias("entity")).join(entities, "entity").groupBy("t")
                .agg(F.collect_set("entity").alias("supported")))
    near = held.select("t", "terms", "outside", "class").join(with_any, "t").dropDuplicates(["t"])
    near = scratch(near, "pii-near")
    seen = near.select("terms", "outside", "class", F.explode("supported").alias("entity"))
    # a word of the entity itself counts only where it stands outside of it too
    own = F.array_except(_words(F.regexp_replace("entity", "^[a-z]+:", "")), F.col("outside"))
    seen = seen.select("entity", "class", F.explode(F.array_except("terms", own)).alias("term"))
    # copies and near copies of one text are one class: no class may hold more than half
    pairs = (seen.groupBy("entity", "term", "class").agg(F.count("*").alias("texts"))
             .groupBy("entity", "term").agg(F.sum("texts").alias("both"), F.count("*").alias("kinds"), F.max("texts").alias("most"))
             .where((F.col("kinds") >= SUPPORT) & (2 * F.col("most") <= F.col("both"))))
    # the texts with the term and any supported entity are a lower bound of those with the term at all:
    # most pairs end here, and only the rest needs counts over whole texts
    around_any = near.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_near"))
    pairs = (pairs.join(entities, "entity").join(around_any, "term")
             .where(_share(n, F.col("both"), F.col("n_near"), F.col("n_entity")) >= GENERALISE).select("entity", "term", "both", "n_entity"))
    pairs = scratch(pairs, "pii-pairs")
    held = scratch(_row_key(docs).select("id", "t", F.explode_outer(F.array_distinct(_words(F.col("text")))).alias("term"))
                   .join(pairs.select("term").distinct(), "term", "left_semi").distinct(), "pii-held")
    count = held.select("term", "t").distinct().groupBy("term").agg(F.count("*").alias("n_term"))
    terms = (pairs.join(count, "term").groupBy("term").agg(F.max(_share(n, F.col("both"), F.col("n_term"), F.col("n_entity"))).alias("share"))
             .where(F.col("share") >= GENERALISE))
    return scratch(held.join(terms, "term"), "pii-terms")


def _term_pattern(term: Column) -> Column:
    return F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_-])"), term, F.lit(r"(?![\p{L}\p{N}_-])"))


def term_spans(docs: DataFrame, held: DataFrame) -> DataFrame:
    """id, t, term array<struct<start, end, removed>> for the texts that hold a disclosing term."""
    d = _row_key(docs).join(held.select(F.col("id").alias("i"), F.col("t").alias("k"), "term", "share"),
                            F.col("id").eqNullSafe(F.col("i")) & (F.col("t") == F.col("k"))).drop("i", "k")
    pattern = _term_pattern(F.col("term"))
    d = d.dropDuplicates(["id", "t", "term"]).withColumn("__pattern", pattern)
    d = _places(d, "__at", F.regexp_extract_all("text", F.col("__pattern"), F.lit(0)), F.split("text", F.col("__pattern"), -1))
    # explode() would bring a filter on the array's size, whose pushdown repeats every step above per match
    each = d.select("id", "t", "share", F.explode_outer("__at").alias("x")).where("x is not null")
    return each.groupBy("id", "t").agg(F.array_sort(F.collect_set(
        F.struct("x.start", "x.end", (F.col("share") >= REMOVE).alias("removed")))).alias("term"))


def find(docs: DataFrame) -> DataFrame:
    """id, t and the spans of every kind, ``term`` included, for every row."""
    found = base(docs)
    terms = term_spans(docs, disclosing_terms(docs, found))
    terms = terms.select(F.col("id").alias("i"), F.col("t").alias("k"), "term")
    joined = found.join(terms, F.col("id").eqNullSafe(F.col("i")) & (F.col("t") == F.col("k")), "left")
    return joined.select("id", "t", *KINDS, F.coalesce("term", F.array().cast("array<struct<start:int,end:int,removed:boolean>>")).alias("term"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_<kind>, base_sha256 and spans for every row."""
    f = find(docs)
    listed = F.concat(*[_listed(k, F.col(k)) for k in KINDS])
    return f.select(F.col("id").alias("doc_id"), *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
                    F.sha2(F.array_join(listed, ","), 256).alias("base_sha256"),
                    F.array_join(F.concat(listed, _listed("term", F.col("term"))), ",").alias("spans"))


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, and removed terms gone.

    Where spans overlap, the first (and of those the longest) counts.
    """
    names = docs.columns
    marks = F.concat(
        *[F.transform(k, _mark_of(k)) for k in KINDS],
        F.transform("term", lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("end"),
                                               F.when(x["removed"], "").otherwise("[TERM]").alias("put"))))
    f = find(docs).select(F.col("id").alias("__id"), F.col("t").alias("__t"), F.array_sort(marks).alias("__marks")).dropDuplicates(["__id", "__t"])
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    d = docs.join(f, docs["doc_id"].eqNullSafe(f["__id"]) & (key == f["__t"]))
    empty = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<from:int,start:int,end:int,put:string>>").alias("kept"))
    kept = F.aggregate("__marks", empty, lambda a, x: F.when(x["start"] < a["end"], a).otherwise(F.struct(
        (-x["end"]).alias("end"), F.concat(a["kept"], F.array(F.struct(a["end"].alias("from"), x["start"].alias("start"), (-x["end"]).alias("end"), x["put"].alias("put")))).alias("kept"))))
    d = d.withColumn("__kept", kept)
    pieces = F.transform("__kept.kept", lambda x: F.concat(F.substring(F.col("text"), x["from"] + 1, x["start"] - x["from"]), x["put"]))
    tail = F.substring(F.col("text"), F.col("__kept.end") + 1, F.length("text"))
    return d.withColumn("text", F.when(F.col("text").isNotNull(), F.concat(F.array_join(pieces, ""), tail))).select(*names)
