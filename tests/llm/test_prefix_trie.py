"""The conversation trie against a plain one in Python, and list ranking by itself."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fitloom.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, depth string, bytes int"
COLS = ["parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    turns = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns[conv].append(((turn is not None, turn or 0, key), (role, text)))
    own = {c: [x for _, x in sorted(t)] for c, t in turns.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = tuple(own.get(c - int(c - 5 * int(c / 5)), [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, t in made.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    inner = defaultdict(list)
    for p in members:
        if p:
            inner[p[:-1]].append(p)
    out = {}
    for p in sorted(members, key=len, reverse=True):
        own_saving = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        ends = ",".join(str(c) for c in sorted(c for c in members[p] if len(made[c]) == len(p)))
        kids = inner[p]
        out[p] = (min(members[p[:-1]]) if p else None, len(members[p]), len(kids), sum(out[k][3] for k in kids) or 1,
                  own_saving + sum(out[k][4] for k in kids), hashlib.sha256(ends.encode()).hexdigest())
    return {(min(members[p]), len(p)): v for p, v in out.items()}


def got(df):
    rows = df.collect()
    return {(r.conv_id, r.depth): tuple(r[c] for c in COLS) for r in rows}, rows


def made_up(seed, n, turns, words=3):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None, "c" * 9][:words]), "x", 1)
            for c in range(n) for t in range(rng.randint(1, turns))]


def check(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    have, raw = got(T.prefix_trie(frame))
    assert len(raw) == len(have)
    assert have == brute(rows)
    places = sorted([r.enter_at for r in raw] + [r.exit_at for r in raw])
    assert places == list(range(2 * len(raw)))
    by = {(r.conv_id, r.depth): r for r in raw}
    for r in raw:
        if r.depth:
            p = by[r.parent_conv_id, r.depth - 1]
            assert p.enter_at < r.enter_at < r.exit_at < p.exit_at
    return raw


def test_trie_equals_brute_force(spark):
    check(spark, made_up(1, 60, 12))


def test_small_blocks_change_nothing(spark, monkeypatch):
    """Windows, end lists and the walked rest far smaller than the data."""
    for name, value in (("BLOCK", 2), ("ENDS", 2), ("SUMS", 3)):
        monkeypatch.setattr(T, name, value)
    monkeypatch.setattr(T.rank_list, "__defaults__", (3,))
    rows = made_up(2, 40, 9, words=2) + [(1000 + i, t, "user", "same", "x", 1) for i in range(30) for t in range(9)]
    check(spark, rows)


def test_awkward_conversations(spark):
    rows = [(None, 1, "user", "no conversation", "x", 1), (-7, None, "user", "first", "x", 1), (-7, 0, None, None, "x", 1), (-7, 0, None, None, "x", 1),
            (3, 5, "user", "tie a", "x", 1), (3, 5, "user", "tie b", "x", 1), (3, 5, "user", "tie a", "x", 1),
            (10**12 + 1, 1, "u", "ab", "x", 1), (10**12 + 2, 1, "ua", "b", "x", 1)]
    rows += [(8, t, "user", f"turn {t}", "x", 1) for t in range(300)] + [(9, t, "user", f"turn {t}", "x", 1) for t in range(280)]
    rows += [(40, 0, "user", "long " * 50_000, "x", 1)]
    raw = check(spark, rows)
    assert max(r.depth for r in raw) > 250
    assert T.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert T.prefix_trie(spark.createDataFrame([(None, 1, "a", "b", "x", 1)], SCHEMA)).count() == 0


def test_conversation_without_turns_ends_at_the_root(spark):
    bare = next(c for c in range(1, 500) if zlib.crc32(str(c).encode()) % 9 > 1 and c % 5)
    raw = check(spark, [(bare, 0, "user", "all of it goes", "x", 1)])
    assert [(r.depth, r.n_convs, r.n_leaves) for r in raw] == [(0, 1, 1)]
    assert raw[0].ends_sha256 == hashlib.sha256(str(bare).encode()).hexdigest()


@pytest.mark.parametrize(("n", "base"), [(1, 4), (5, 1), (400, 7)])
def test_list_ranking(spark, n, base):
    rng = random.Random(n)
    order = [(i % 7, i) for i in range(n)]
    rng.shuffle(order)
    weights = [rng.randint(1, 5) for _ in order]
    rows = [(*order[i], weights[i], *(order[i + 1] if i + 1 < n else (None, None))) for i in range(n)]
    rng.shuffle(rows)
    places = T.rank_list(spark.createDataFrame(rows, "c long, s long, w long, nc long, ns long"), base)
    want = {order[i]: sum(weights[:i]) for i in range(n)}
    assert {(r.c, r.s): r.place for r in places.collect()} == want


def test_query_equals_its_sql(spark, sf):
    import duckdb

    from fitloom.llm import queries

    rows = queries.QUERIES["op12_prefix_trie"](spark, sf).orderBy("conv_id", "depth")
    want = duckdb.sql(queries.ORACLES["op12_prefix_trie"].replace("FROM conversations", f"FROM '{sf}/conversations.parquet'")).df()
    want = want.sort_values(["conv_id", "depth"])
    have = rows.select(*want.columns).toPandas()
    assert len(have) == len(want) and (have.fillna(-1).values == want.fillna(-1).values).all()
    assert dict(rows.agg(F.max("n_convs").alias("n")).first().asDict())["n"] == 20
