"""K-d sharding, mixing, quality rules, line dedup and personal data against brute force and edge frames."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from fitloom.llm import line_dedup, pii
from fitloom.llm.common import keep_listed
from fitloom.llm.kd_shards import kd_shards
from fitloom.llm.mixing import mix, mixed_documents, source_targets
from fitloom.llm.quality_rules import fit, judge, quality_filter
from tests.llm.helpers import EDGE_ROWS, LONG, WORD, docs, edge_docs, no_docs


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(5)
    words = [a + b for a in ("th", "re", "on", "ing", "sh") for b in ("an", "er", "ou", "es", "at", "le")]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(1, 400))) for _ in range(600)]


# --- K-d sharding


def test_shards_are_near_equal_and_slots_gapless(spark, prose):
    out = kd_shards(docs(spark, prose), 16).toPandas()
    size = out.groupby("shard")["size"].sum()
    assert len(out) == len(prose) and list(size.index) == list(range(16))
    assert size.max() - size.min() <= 2 * max(len(t) + 1 for t in prose)
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    by_id = out.set_index("doc_id")
    assert all(by_id.text_crc32[i] == zlib.crc32(t.encode()) and by_id["size"][i] == len(t.encode()) + 1 for i, t in enumerate(prose))
    assert set(out.law) == {"bytes"} and out.grown_shard.isna().all()


def test_shards_split_a_hot_group_of_copies(spark):
    out = kd_shards(docs(spark, ["same text"] * 3000 + ["other"] * 96), 16).toPandas()
    size = out.groupby("shard")["size"].sum()
    assert len(size) == 16 and size.max() <= 1.1 * size.mean()


def test_shards_split_one_row_that_repeats(spark):
    rows = [(7, "one row", "en", "s", 7)] * 1000 + [(i, f"text {i}", "en", "s", 8) for i in range(2000)]
    out = kd_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4), 16).toPandas()
    sizes = out.groupby("shard")["size"].sum()
    assert len(out) == 3000 and len(sizes) == 16 and sizes.max() < 1.05 * sizes.min()
    for _, part in out.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))


def test_shards_other_counts_and_edges(spark, prose):
    for n in (1, 3, 7):
        out = kd_shards(docs(spark, prose), n).toPandas()
        size = out.groupby("shard")["size"].sum()
        assert len(size) == n and size.max() <= 1.1 * size.mean()
    out = kd_shards(edge_docs(spark), 4).toPandas()
    assert len(out) == len(EDGE_ROWS) and out.shard.between(0, 3).all()
    assert (out[out.doc_id == 1]["size"] == 1).all() and (out[out.doc_id == 1].text_crc32 == 0).all()
    assert kd_shards(no_docs(spark), 4).count() == 0


# --- mixing


def brute_targets(sizes):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    budget, fixed, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        rest = budget - sum(fixed.values())
        share = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return fixed | share
        fixed |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    return fixed


def test_targets_are_the_reshared_weights(spark):
    rng = random.Random(1)
    for sizes in ({"a": 10}, {"b": 0, "a": 0}, {None: 5, "x": 100, "é": 3}, {f"s{i}": rng.randint(0, 1000) for i in range(40)}):
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in source_targets(frame).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want), (sizes, got, want)


def test_mix_comes_near_targets_and_repeats(spark, prose):
    rng = random.Random(2)
    rows = [(i, t, rng.choice(["a", "a", "a", "b", "c", "d", None])) for i, t in enumerate(prose)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first, again = (mix(x).select("row.doc_id", "size", "source_size", "target", "taken").toPandas().sort_values("doc_id", ignore_index=True) for x in (d, d.repartition(7)))
    assert first.equals(again)
    out = first.merge(d.drop("text").toPandas(), on="doc_id")
    assert (out["size"] == [len(WORD.findall(t)) for t in prose]).all()
    assert (out.taken <= 2 * out["size"]).all() and (out.taken % out["size"].clip(lower=1) == 0).all()
    for _, g in out.groupby("source", dropna=False):
        assert g.source_size.iloc[0] == g["size"].sum()
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max()
        if g.target.iloc[0] >= g["size"].sum():  # complete epochs come first
            assert (g.taken >= g["size"]).all()


def test_mix_edges(spark):
    out = mix(edge_docs(spark)).toPandas()
    assert len(out) == len(EDGE_ROWS)
    assert mix(no_docs(spark)).count() == 0 and mixed_documents(no_docs(spark)).count() == 0
    assert mixed_documents(edge_docs(spark)).columns == edge_docs(spark).columns


def test_mix_prefers_high_weights(spark):
    from pyspark.sql import functions as F

    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("w w w w").alias("text"), F.lit("a").alias("source"))
    many = mix(d, quality=F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.1), budget_share=0.3).toPandas()
    even = many["row"].map(lambda r: r["doc_id"] % 2 == 0)
    assert many.taken[even].sum() > 4 * many.taken[~even].sum()


# --- quality rules


def signals_of(text):
    w = WORD.findall(text or "")
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i:i + 3]), []).append(i)
    covered = {p + k for at in seen.values() if len(at) > 1 for p in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_signals_match_brute_force(spark, prose):
    texts = prose[:150] + ["a b a b a b a b", "x x x x", "a b c a b c", "a a a", "l\nl\n\nl\n", "a b c d " * 40, "#$ <>|"]
    d = docs(spark, texts)
    got = {r["row"]["doc_id"]: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in judge(d, ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        want = signals_of(t)
        assert got[i] == (*want, want[0] < 50 or 100 * want[4] > 50 * want[0]), t[:80]
    edge = judge(edge_docs(spark), ["doc_id", "key", "size"]).toPandas()
    assert len(edge) == len(EDGE_ROWS) and judge(no_docs(spark), ["doc_id"]).count() == 0


def test_rules_separate_faults_from_prose(spark, prose):
    good = [t for t in prose if len(t.split()) >= 60 and signals_of(t)[4] * 2 <= len(t.split())][:200]
    bad = [" ".join(w + m for w, m in zip(t.split(), "$$$ %%% &&& ###".split() * 200)) for t in good[:15]]
    bad += [" | ".join(t.split()) for t in good[15:30]] + [" ".join(w.upper() + "!!" for w in t.split()) for t in good[30:45]]
    kept = {r.doc_id for r in quality_filter(docs(spark, good + bad)).collect()}
    assert kept == set(range(len(good)))
    assert quality_filter(edge_docs(spark)).columns == edge_docs(spark).columns and quality_filter(no_docs(spark)).count() == 0


def test_em_needs_only_counts():
    post = fit({0: 3, 2: 40, 1: 5}, 1)
    assert post[0] < 0.5 < post[1] < post[2] and fit({}, 3) == {}


# --- line dedup


def test_lines_put_together_are_the_text(spark, prose):
    from pyspark.sql import functions as F

    texts = prose[:100] + ["", "\n\n", "no end", "a. b! c? d\ne. f.\n", LONG]
    texts += ["word " * 300, "日本語" * 200, "x" * 500 + " y\n\n" + "é" * 161]
    out = line_dedup.lined(docs(spark, texts)).select("doc_id", F.array_join("__lines", "").alias("t")).collect()
    assert {r.doc_id: r.t for r in out} == dict(enumerate(texts))


def test_lines_are_cut_without_a_regex_but_where_a_text_has_the_mark(spark):
    from pyspark.sql import functions as F

    texts = ["", "\n", "\n\n", "no end", "a. b! c? d\ne. f.\n", ". . .\n \n", "é. ü! \n\n\n", "a\x00b. c\nd! e", "\x00", "x. y\x00", LONG, None]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    cut = line_dedup._cut(F.col("text"))
    got = d.select("id", cut.alias("cut"), F.transform(cut, line_dedup._bytes).alias("bytes"), line_dedup._bytes(F.col("text")).alias("whole"))
    for r in got.collect():
        want = texts[r.id] if texts[r.id] is None else re.split(r"(?<=\n)|(?<=[.!?] )", texts[r.id])
        assert r.cut == want and r.bytes == (want and [x.rstrip("\n") for x in want])
        assert r.whole == (want and texts[r.id].rstrip("\n"))
    # before, every text went through one: a regex that cannot be read shows that it is not used
    plain = spark.createDataFrame([(1, "a. b\nc")], "id int, text string")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(line_dedup, "LINE_BORDER", "(")
        assert plain.select(line_dedup._cut(F.col("text")).alias("x")).first().x == ["a. ", "b\n", "c"]


def test_repeated_passages_go_and_clean_texts_stay(spark):
    rng = random.Random(3)

    def sentence(n):
        return " ".join("".join(rng.choice("abcdefghijkl") for _ in range(6)) for _ in range(n)).capitalize() + "."

    def paragraph():
        return " ".join(sentence(rng.randint(4, 12)) for _ in range(6))

    passage = paragraph() + " " + sentence(20)
    one_sentence = sentence(60)
    texts = []
    for i in range(60):
        parts = [paragraph() for _ in range(4)]
        if i < 20:
            parts.insert(rng.randint(0, 4), passage)
        elif i < 30:
            parts.insert(rng.randint(0, 4), one_sentence)
        texts.append("\n".join(parts))
    out = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    assert sum(passage in r.text for r in out.values()) == 1 and passage in out[0].text
    assert sum(one_sentence in r.text for r in out.values()) == 1
    for i, t in enumerate(texts):
        if i >= 30:
            assert out[i].text == t and out[i].n_removed == 0
        else:
            want = t if i in (0, 20) else t.replace(passage, "").replace(one_sentence, "")
            assert out[i].text.split() == want.split()


KINDS = [("\n", 5, 12), ("\n", 3, 20), ("\n", 10, 12), (" ", 4, 15), (" ", 1, 60), (" ", 10, 15), ("\n", 1, 60)]


def test_passages_between_foreign_lines_go_whole(spark):
    """Each kind is (separator, sentences, words of a sentence), planted between unique sentences in two or three documents."""
    rng = random.Random(5)

    def sentence(n):
        return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(n)).capitalize() + "."

    texts, want = [], []
    for sep, n, words in KINDS:
        for j in range(20):
            passage = sep.join(sentence(words) for _ in range(n))
            for copy in range(2 + j % 2):
                before, after = (sep.join(sentence(rng.randint(5, 20)) for _ in range(5)) for _ in range(2))
                texts.append(before + sep + passage + sep + after)
                want.append(texts[-1] if copy == 0 else before + sep + after)
    texts += ["", None, "The end. Of it.", "The end. Of it."]
    want += texts[-4:]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for spread in (1, 7):
        out = {r.doc_id: r.text for r in line_dedup.dedup_lines(table.repartition(spread), report=False).collect()}
        assert [out[i] for i in range(len(texts))] == want


def test_line_dedup_by_shuffle_join(spark, prose, monkeypatch):
    """Beyond the broadcast bounds the repeated windows, runs and removals are joined by shuffle, with the same result."""
    texts = prose[:60] + prose[30:60] + [prose[0] + "\n" + prose[70]]
    want = sorted(map(tuple, line_dedup.dedup_lines(docs(spark, texts)).collect()))
    monkeypatch.setattr(line_dedup, "keep_listed", lambda df, listed, key: keep_listed(df, listed, key, broadcast_rows=0))
    monkeypatch.setattr(line_dedup, "BROADCAST_PAIRS", -1)
    assert sorted(map(tuple, line_dedup.dedup_lines(docs(spark, texts)).collect())) == want
    assert any(r[-1] for r in want)


def test_line_dedup_moves_texts_once(spark, prose, monkeypatch):
    """Beyond the broadcast bounds a list of removals is shuffled to the bucketed lines, and these stay; before, both were."""
    monkeypatch.setattr(line_dedup, "BROADCAST_PAIRS", -1)
    plan = line_dedup.dedup_lines(docs(spark, prose[:40] + prose[20:40]))._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1


def test_line_runs_lie_between_windows_that_occur_once(spark, prose):
    texts = prose[:30] + prose[20:30] + ["\n".join(prose[i] for i in (0, 31, 5, 32, 5))] + ["A. B. ", "A. B. ", "One.", ""]
    rows = line_dedup.lined(docs(spark, texts)).localCheckpoint()
    got = {r["__rid"]: [tuple(x) for x in r["__runs"]] for r in line_dedup.runs(rows).collect()}
    lines, want = rows.select("__rid", "__windows", "__chars").collect(), {}
    n = Counter(w for _, ws, _ in lines for w in ws or [])
    for rid, ws, chars in lines:
        ks = [-1, *[k for k, w in enumerate(ws or []) if n[w] == 1], len(ws or [])]
        found = [(a + 1, z) for a, z in zip(ks, ks[1:], strict=False) if z - a > 1 and sum(chars[a + 1:z + 1]) >= line_dedup.RUN_CHARS]
        want |= {rid: found} if found else {}
    assert got == want and len(want) >= 20


def test_line_dedup_colliding_hashes(spark, monkeypatch):
    """Where all chunks share one hash, their bytes still tell them apart."""
    from pyspark.sql import functions as F

    a, b = ("Here is a first sentence of its own kind%d. Then comes a second one which is longer%d. And the third closes the passage%d.\n" % (i, i, i) for i in (1, 2))
    texts = [a + b, a, b, a + "Tail."]
    want = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    plain = line_dedup.chunks
    monkeypatch.setattr(line_dedup, "chunks", lambda rows, found: plain(rows, found).withColumn("hash", F.lit(1).cast("long")))
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark, texts)).collect()} == want
    assert want[0] == texts[0] and want[1] == want[2] == ""


def test_line_dedup_edges(spark):
    out = line_dedup.dedup_lines(edge_docs(spark))
    got = out.toPandas()
    assert out.columns == [*edge_docs(spark).columns[:-1], "n_chunks", "n_removed"] and len(got) == len(EDGE_ROWS)
    assert line_dedup.dedup_lines(edge_docs(spark), report=False).columns == edge_docs(spark).columns
    assert got[got.doc_id == 1].text.isna().all() and set(got[got.doc_id == 4].text) == {"one two"}
    assert line_dedup.dedup_lines(no_docs(spark)).count() == 0


# --- personal data

RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        s += x - 9 if x > 9 else x
    return s % 10 == 0


def base_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in RULES for m in re.finditer(p, text or "") if ok(m.group())]


def test_base_spans_match_brute_force(spark):
    rng = random.Random(4)
    bits = ["a@b.com", "x.y@z-1.org", "@", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567",
            "+123456789", "+1", " ", "  ", ".", "-", "é", "日", "\n", "0", "00", "_", "word", "007.000.1.255", "a@b", "..", "+", "(", ")"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    texts += ["a@b.com_x@y.org", "é" * 9 + "q@w.io " * 700, "9" * 30_000, "a" * 30_000, "1 " * 20_000, "1.2.3.4 " * 600]
    got = {r.doc_id: r for r in pii.digest(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t[:80]
        assert got[i].spans.startswith(",".join(want))
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(s.startswith(k) for s in want) for k, _, _ in RULES]


def test_terms_that_disclose_an_entity_are_found(spark):
    colours = "red blue green grey pink teal".split()
    texts = [f"{colours[i % 6]}{'abcdefgh'[i]} wordy Belkin {colours[-1 - i % 6]}o{'abcdefgh'[i]} common anna@b.org tail" for i in range(8)]
    texts += ["elsewhere Belkin stands alone"] + [f"plain {c} words common to all wordy tail" for c in colours * 20]
    d = docs(spark, texts)
    got = {r.doc_id: r.spans for r in pii.digest(d).collect()}
    for i, t in enumerate(texts):
        at = t.find("Belkin")
        assert (f"term:{at}:{at + 6}" in got[i]) == (at >= 0), t
        assert ":".join(["term", str(t.find("common")), ""]) not in got[i]
    clean = {r.doc_id: r.text for r in pii.sanitised(d).collect()}
    assert all("Belkin" not in t and "anna@b.org" not in t for t in clean.values())
    assert "[EMAIL]" in clean[0] and clean[20] == texts[20]


def test_copies_of_a_passage_disclose_nothing(spark):
    texts = ["call our friendly office writer today me@here.org for more"] * 30 + [f"other text number {i}" for i in range(50)]
    assert not any("term" in r.spans for r in pii.digest(docs(spark, texts)).collect())


def test_names_in_fixed_signatures_and_far_from_the_entity_disclose_it(spark):
    rng = random.Random(6)

    def words(n):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(n))

    texts = [f"{words(40)}. Best regards, Alice Smith alice@x.org" for _ in range(20)]
    texts += [f"Dear Zacharias, {words(60)} reach me at +1 555 123 4567" for _ in range(10)]
    near_copy = "call our friendly office writer today me@here.org " + words(40)
    texts += [f"{near_copy} {i}" for i in range(30)] + [f"Best regards, {words(30)}" for _ in range(200)]
    got = {r.doc_id: r.spans for r in pii.digest(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        for word, ids in (("Alice", range(20)), ("Smith", range(20)), ("Zacharias", range(20, 30))):
            at = t.find(word)
            assert (f"term:{at}:{at + len(word)}" in got[i]) == (i in ids), (t, got[i])
        assert f"term:{t.find('friendly')}:" not in got[i] and not t.startswith("Best") or "term:0:4" not in got[i]


def test_pii_edges(spark):
    out = pii.digest(edge_docs(spark)).toPandas()
    assert len(out) == len(EDGE_ROWS) and (out[out.doc_id == 1].base_sha256 == hashlib.sha256(b"").hexdigest()).all()
    assert pii.digest(no_docs(spark)).count() == 0
    clean = pii.sanitised(edge_docs(spark))
    assert clean.columns == edge_docs(spark).columns and clean.count() == len(EDGE_ROWS)
