"""Substring dedup against brute force over all windows, and the index against plain search."""

import hashlib
import random

import numpy as np
import pytest

from fitloom.llm import substring_dedup as S
from fitloom.llm.fm_index import FMIndex, WaveletTree
from tests.llm.helpers import EDGE_ROWS, edge_docs, no_docs

SCHEMA = "doc_id long, text string, n_words string, key int"


def brute(rows, window=50):
    words = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for k in range(len(w) - window + 1):
                x = tuple(w[k:k + window])
                first[x] = min(first.get(x, i), i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k:k + window])] < i:
                gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


def made_up(seed, n=60):
    """Texts of random words with passages of 20 to 200 words of a common store, copies and near copies."""
    rng = random.Random(seed)

    def some(k):
        return [f"w{rng.randint(0, 400)}" for _ in range(k)]

    store, rows = [some(rng.randint(20, 200)) for _ in range(6)], []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.15:
            text = rng.choice(rows)[1]
        elif rows and kind < 0.4:
            w = rng.choice(rows)[1].split()
            for _ in range(3):
                if w:
                    w[rng.randrange(len(w))] = "changed"
            text = " ".join(w)
        else:
            text = " ".join(some(rng.randint(0, 120)) + rng.choice(store) + some(rng.randint(0, 60)) + (["again"] * 70 if rng.random() < 0.2 else []))
        rows.append((rng.choice([i, i, i, 7, None]), text, "x", 1))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_removal_equals_brute_force(spark, seed):
    rows = made_up(seed)
    assert got(S.dedup_substrings(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute(rows)


def test_crowded_anchors(spark, monkeypatch):
    """A passage that every document holds, with anchors far over the limit, and many shards."""
    monkeypatch.setattr(S, "MOST", 5)
    monkeypatch.setattr(S, "SHARD_WORDS", 500)
    rng = random.Random(9)
    line, passage = [f"l{k}" for k in range(40)], [f"p{k}" for k in range(60)]
    rows = made_up(4, 25)
    for i in range(100, 140):
        mine = [[f"u{i}x{rng.randint(0, 9999)}" for _ in range(30)] for _ in range(3)]
        rows.append((i, " ".join(mine[0] + line + mine[1] + passage + mine[2]), "x", 1))
        if i % 2:       # what surrounds the line is in two documents, and in these two only
            rows.append((i + 100, f"else{i} " + " ".join(mine[0] + line + mine[1]), "x", 1))
    out = got(S.dedup_substrings(spark.createDataFrame(rows, SCHEMA).repartition(5)))
    assert out == brute(rows)
    assert {r[2] for r in out if r[0] is not None and 100 < r[0] < 200} == {60} and {r[2] for r in out if r[0] is not None and r[0] > 200} == {100}


def test_kept_texts(spark):
    passage = " ".join(f"p{k}" for k in range(55))
    rows = [(1, f"a b {passage} c", "x", 1), (2, f"d\t{passage}\ne  f", "x", 1), (3, f"a b {passage} c", "x", 1), (4, "short", "x", 1)]
    out = {r.doc_id: r.kept for r in S.dedup_substrings(spark.createDataFrame(rows, SCHEMA), texts=True).collect()}
    assert out == {1: None, 2: "d e f", 3: "", 4: None}


def test_edges(spark):
    out = got(S.dedup_substrings(edge_docs(spark)))
    assert out == brute([(r[0], r[1]) for r in EDGE_ROWS])
    assert S.dedup_substrings(no_docs(spark)).count() == 0


def test_wavelet_tree():
    rng = np.random.default_rng(1)
    for size, n in ((1, 5), (2, 64), (37, 1000), (300, 129)):
        seq = rng.integers(0, size, n)
        tree = WaveletTree(seq, size)
        s, at = rng.integers(0, size, 200), rng.integers(0, n + 1, 200)
        assert tree.rank(s, at).tolist() == [int((seq[:a] == x).sum()) for x, a in zip(s, at, strict=True)]


def test_matching_statistics_of_other_texts():
    """Patterns that are not in the index: matches are cut back to what some text holds."""
    rng = np.random.default_rng(2)
    for cap in (3, 8, 64):
        texts = [rng.integers(1, 5, rng.integers(1, 40)) for _ in range(12)]
        index = FMIndex(np.concatenate(texts), np.array([len(t) for t in texts]), np.arange(12) + 100, cap)
        patterns = [rng.integers(1, 6, rng.integers(1, 30)) for _ in range(30)] + [texts[3], texts[3][1:]]
        patterns = [np.where(p == 5, -1, p) for p in patterns if len(p)]        # -1: a symbol that no text has
        length, row = index.matching_statistics(np.concatenate(patterns), np.array([len(p) for p in patterns]))
        held = [{tuple(t[i:j]) for i in range(len(t)) for j in range(i, min(i + cap, len(t)) + 1)} for t in texts]
        at = 0
        for p in patterns:
            for k in range(len(p)):
                best = max(m for m in range(min(cap, len(p) - k) + 1) if any(tuple(p[k:k + m]) in h for h in held))
                assert length[at] == best
                if best == cap:
                    owners = [100 + i for i, h in enumerate(held) if tuple(p[k:k + cap]) in h]
                    assert index.least[index.group[row[at]]] == min(owners)
                at += 1


def test_query_equals_its_sql(spark, sf):
    import duckdb

    from fitloom.llm import queries

    want = duckdb.sql(queries.ORACLES["op13_substring_dedup"].replace("FROM documents", f"FROM '{sf}/documents.parquet'")).fetchall()
    have = got(queries.QUERIES["op13_substring_dedup"](spark, sf))
    assert have == sorted(want, key=str) and sum(r[2] for r in have) > 1000
