"""Quality rules by weak supervision [native].

Every rule looks at signals of the whole text and votes good (1), bad (-1) or abstains
(0). Expectation-maximisation over all documents estimates each rule's accuracy and the
share of good documents; a document is kept when its posterior probability of being good
reaches ``KEEP_AT``, instead of having to pass every rule.

The E and M steps only need how many documents cast each combination of votes, so the
corpus is read once: votes are packed to one integer, counted with map-side partial sums,
and the at most ``3 ** number of rules`` counts fit the model on the driver. The posterior of
each combination goes back as a table of the same bounded size.

Repeated three-word windows are found inside the row: the windows' hashes with their
positions are sorted, neighbours that agree are the repeats, and the words they cover are
summed from the gaps between the repeated positions. No row is exploded or shuffled.

Edge cases: NULL, empty or wordless text has zero words and signals, fails the base rule and
is not kept; one or two words make no window; ties at the threshold are kept; repeated rows
get the same verdict; an empty table gives no rows; extra columns pass ``quality_filter``
untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitloom.llm.common import SPACE_CHARS, SPACE_CLASS, local_rows, scratch

KEEP_AT = 0.5
# The base rule's limits.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
EM_ROUNDS = 50
MIN_ODDS = 3.0
# chance of a bad vote before the first round, on good and on bad documents: a rule rarely hits a good
# document, and hits the one kind of fault in several that it is written for
START = {True: 0.005, False: 0.2}

# rule -> (bad when, good when) over the signals; neither: abstain
RULES: dict[str, tuple[str, str]] = {
    "symbols": ("n_symbols > 0.2 * n_words", "n_symbols <= 0.05 * n_words"),
    "marks": ("n_marks > 0.3 * n_words", "n_marks <= 0.05 * n_words"),
    "repeats": ("n_repeat_words > 0.4 * n_words", "n_repeat_words <= 0.2 * n_words"),
    "lines": ("n_dup_lines > 2 and n_dup_lines > 0.5 * n_lines", "n_dup_lines <= 0.2 * n_lines"),
    "word_length": ("word_chars > 15 * n_words or word_chars < 2 * n_words",
                    "word_chars between 3 * n_words and 10 * n_words"),
    "capitals": ("n_capitals > 0.4 * word_chars", "n_capitals <= 0.15 * word_chars"),
    "vocabulary": ("n_distinct_words < 0.5 * sqrt(n_words)", "n_distinct_words >= 2 * sqrt(n_words)"),
    "letters": ("n_letters < 0.7 * word_chars", "n_letters >= 0.8 * word_chars"),
}


def _repeat_words(grams: Column, n_grams: Column) -> Column:
    """Words inside windows whose hash occurs twice or more; ``grams`` is sorted (hash, position)."""
    def repeated(g: Column, i: Column) -> Column:
        # i is 0-based, element_at 1-based; get() is NULL beyond the ends
        same_before = F.coalesce(F.get(grams, i - 1)["h"] == g["h"], F.lit(False))
        return same_before | F.coalesce(F.get(grams, i + 1)["h"] == g["h"], F.lit(False))

    return F.array_sort(F.transform(F.filter(grams, repeated), lambda g: g["p"]))


def signals(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of ``docs`` as one struct ``row``, and the signals of ``text``; one row per row."""
    d = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    t = F.col("__text")
    packed = F.translate(t, SPACE_CHARS, "")
    d = d.withColumn("__words", F.filter(F.split(t, SPACE_CLASS + "+", -1), lambda w: w != ""))
    w = F.col("__words")
    d = d.withColumn("n_words", F.size(w).cast("long"))
    d = d.withColumn("__grams", F.when(F.col("n_words") >= 4, F.array_sort(F.transform(
        F.sequence(F.lit(0), F.col("n_words").cast("int") - 3),
        lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p"))))))
    d = d.withColumn("__at", _repeat_words(F.col("__grams"), F.col("n_words")))
    at = F.col("__at")
    # a repeated window covers three words, less where the next repeated window starts inside it
    covered = F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3)))),
                          F.lit(0), lambda a, b: a + b)
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("__lines", lines).withColumn("n_lines", F.size("__lines").cast("long"))
    return d.select(
        "row", "n_words", F.length(packed).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.col("n_lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words", "n_lines",
        F.regexp_count(t, F.lit(r"[!?|{}=_~^]")).cast("long").alias("n_marks"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        (F.length(packed) - F.regexp_count(packed, F.lit(r"[^\p{L}]"))).cast("long").alias("n_letters"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"))


def vote_code() -> Column:
    """The votes as one integer in base 3 (0 bad, 1 abstain, 2 good), first rule lowest."""
    code = F.lit(0)
    for i, (bad, good) in enumerate(RULES.values()):
        vote = F.when(F.expr(bad), 0).when(F.expr(good), 2).otherwise(1)
        code = code + vote * 3**i
    return code


def fit(counts: dict[int, int], n_rules: int) -> dict[int, float]:
    """EM for each rule's accuracy on good and on bad documents and the share of good ones.

    ``bad_on[y][i]`` is the chance that rule i, when it does not abstain, votes bad on a
    document of class y: its accuracy on bad documents, and one minus that on good ones. The
    two differ since a rule sees one kind of fault: its good vote says little, its bad vote
    much. Abstaining says nothing. A few pseudo-documents keep the rates off 0 and 1, and a
    rule's bad vote must stay at least ``MIN_ODDS`` times as likely on bad documents: rules are
    written to be better than chance, and this keeps good and bad from changing places.
    Returns the posterior of good per vote code.
    """
    votes = {c: [c // 3**i % 3 - 1 for i in range(n_rules)] for c in counts}
    bad_on, share = {y: [START[y]] * n_rules for y in START}, 0.8

    def posterior(code: int) -> float:
        x = math.log(share) - math.log(1 - share)
        for i, v in enumerate(votes[code]):
            g, b = bad_on[True][i], bad_on[False][i]
            x += (math.log(g) - math.log(b)) if v < 0 else (math.log(1 - g) - math.log(1 - b)) if v > 0 else 0.0
        return 1 / (1 + math.exp(-max(x, -700.0)))

    total = sum(counts.values())
    for _ in range(EM_ROUNDS if total else 0):
        good = {c: posterior(c) for c in sorted(counts)}
        share = min(max((sum(counts[c] * g for c, g in good.items()) + 4) / (total + 5), 0.5), 0.99)
        for i in range(n_rules):
            for y in (True, False):
                weight = {c: counts[c] * (g if y else 1 - g) for c, g in good.items() if votes[c][i]}
                said_bad = sum(w for c, w in weight.items() if votes[c][i] < 0)
                bad_on[y][i] = (said_bad + 10 * START[y]) / (sum(weight.values()) + 10)
            bad_on[True][i] = min(bad_on[True][i], 0.05)
            bad_on[False][i] = min(max(bad_on[False][i], MIN_ODDS * bad_on[True][i], 0.05), 0.95)
    return {c: posterior(c) for c in counts}


def judge(docs: DataFrame, keep: list[str], compression: str = "snappy") -> DataFrame:
    """``row`` (the ``keep`` columns), signals, base_failed, posterior and kept for every row of ``docs``."""
    s = scratch(signals(docs, keep).withColumn("votes", vote_code()), "quality-signals", compression)
    s = s.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                     | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    # at most 3 ** len(RULES) rows, however large the corpus
    counts = {r["votes"]: r["n"] for r in s.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    table = local_rows(docs.sparkSession, list(fit(counts, len(RULES)).items()), [("votes", "int"), ("posterior", "double")])
    s = s.join(F.broadcast(table), "votes", "left")
    return s.withColumn("kept", ~F.col("base_failed") & (F.coalesce("posterior", F.lit(0.0)) >= KEEP_AT))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, columns unchanged. Rows wait for the fit on disk: nothing is shuffled."""
    return judge(docs, docs.columns, "zstd").where("kept").select("row.*")
