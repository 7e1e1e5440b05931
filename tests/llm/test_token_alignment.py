"""Cross-tokenizer alignment against a byte-by-byte brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from fitloom.llm import token_alignment as T
from tests.llm.helpers import EDGE_ROWS, docs, edge_docs, no_docs


@pytest.fixture(scope="module")
def encoders():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def byte_of():
    """The byte-level alphabet: printable bytes stand for themselves, the others for 256 and on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def brute(encoders, texts):
    a_side, b_side = encoders
    alphabet = byte_of()
    rows = []
    for text in texts:
        if not text:
            rows.append(None)
            continue
        enc = a_side.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(alphabet[c] for c in t)) for i, t in zip(enc.ids, enc.tokens, strict=True)]
        ids = b_side.encode(text)
        names = [b_side.id_to_piece(i) for i in ids]
        b = [(i, bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()) for i, p in zip(ids, names, strict=True)]
        want = (" " + text).encode()
        rows.append((a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else None)
    out, count = [], Counter()
    for r in rows:
        if r is None:
            out.append(None)
            continue
        owners = [[k for k, (_, x) in enumerate(side) for _ in x] for side in r]
        pairs = sorted(set(zip(*owners, strict=True)))
        ends = [set(np.cumsum([len(x) for _, x in side]).tolist()) for side in r]
        groups, at, common = [], [0, 0], sorted(ends[0] & ends[1])
        for end in common:
            group = []
            for s in (0, 1):
                taken, done = [], sum(len(x) for _, x in r[s][:at[s]])
                while done < end:
                    taken.append(r[s][at[s]][0])
                    done += len(r[s][at[s]][1])
                    at[s] += 1
                group.append(",".join(map(str, taken)))
            groups.append("|".join(group))
        links = [(r[0][i][0], r[1][j][0]) for i, j in pairs]
        count.update(links)
        out.append((len(r[0]), len(r[1]), groups, links))
    top = {}
    for (_, b), n in count.items():
        top[b] = max(top.get(b, 0), n)
    return [(0, 0, 0, 0, 0, 0, "") if o is None else
            (o[0], o[1], len(o[2]), len(o[3]), sum(count[p] == top[p[1]] for p in o[3]), sum(count[p] for p in o[3]),
             hashlib.sha256(";".join(o[2]).encode()).hexdigest()) for o in out]


def got(frame):
    cols = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return {r.doc_id: tuple(r[c] for c in cols) for r in frame.collect()}


ODD = ["x <|endoftext|> y", "<s> a </s>", "a  b   c", " lead", "trail ", "two\n lines \n\n x", "日本語 text と", "a▁b", "it's we'll",
       "\t\r\n", "é" * 300, "z" * 5000, "ﬁ ½ ² ‘q’ …", "a\xa0b\x85c d", "1234567 89", " ", "  ", "<0x41> x", "\x1c y   z", "🙂🙂 👩‍👩‍👧"]


def test_alignment_equals_brute_force(spark, encoders, sf):
    texts = list(pd.read_parquet(f"{sf}/documents.parquet").text)[:120] + ODD + ODD[:3] + [None, ""]
    want = dict(enumerate(brute(encoders, texts)))
    assert got(T.align(docs_with_nulls(spark, texts))) == want
    # with hardly any pair broadcast, the join must give the same
    assert got(T.align(docs_with_nulls(spark, texts), head_pairs=10)) == want


def docs_with_nulls(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def test_small_memories_change_nothing(spark, encoders, monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["alpha", "beta.", "gamma,\n", "ünd", "x" * 70, "12"]) for _ in range(rng.randint(1, 400))) for _ in range(40)]
    want = dict(enumerate(brute(encoders, texts)))
    for name, value in (("SLICE", 50), ("PENDING", 5)):
        monkeypatch.setattr(T, name, value)
    assert got(T.align(docs(spark, texts))) == want


def test_pieces_never_hold_an_inner_space():
    """What lets a text be cut before a space: no piece has one after another character."""
    t = T.Tokens()
    assert not any(" " in b.decode("utf-8", "ignore").lstrip(" ") for b in t.b_bytes)
    assert len(t.a_bytes) < T.PAIR and len(t.b_bytes) < T.PAIR


def test_products_are_matrix_products():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = (rng.random((rng.integers(1, 7), 5)) < 0.4).astype(int), (rng.random((5, rng.integers(1, 7))) < 0.4).astype(int)
        csr = [(T.pointers(m.sum(axis=1)), np.nonzero(m)[1]) for m in (a, b)]
        ptr, col, value = T.product(*csr[0], *csr[1])
        dense = np.zeros((a.shape[0], b.shape[1]), int)
        for i in range(a.shape[0]):
            assert sorted(set(col[ptr[i]:ptr[i + 1]])) == list(col[ptr[i]:ptr[i + 1]])
            dense[i, col[ptr[i]:ptr[i + 1]]] = value[ptr[i]:ptr[i + 1]]
        assert (dense == a @ b).all()


def test_links_of_texts(spark, encoders):
    for r in T.links(docs(spark, ["hello brave new world", "naïve café"])).collect():
        a = [T.Tokens().a_bytes[i] for i in r.a_ids]
        b = [T.Tokens().b_bytes[i] for i in r.b_ids]
        owners = [[k for k, x in enumerate(side) for _ in x] for side in (a, b)]
        want = Counter(zip(*owners, strict=True))
        have = {(i, r.link_b[k]): r.link_bytes[k] for i in range(len(a)) for k in range(r.link_ptr[i], r.link_ptr[i + 1])}
        assert have == dict(want)
        ptr, col, _ = T.group_links(np.array(r.a_group), np.array(r.b_group), max(r.a_group) + 1)
        pairs = {(i, c) for i in range(len(a)) for c in col[ptr[i]:ptr[i + 1]]}
        assert pairs == {(i, j) for i, g in enumerate(r.a_group) for j, h in enumerate(r.b_group) if g == h}


def test_alignment_edges(spark):
    out = T.align(edge_docs(spark)).collect()
    assert len(out) == len(EDGE_ROWS)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert len(by[4]) == 2 and by[4][0] == by[4][1] and by[None][0].n_a > 0
    assert all((by[i][0].n_a, by[i][0].groups_sha256) == (0, "") for i in (1, 2)) and by[3][0].n_a > 0
    assert T.align(no_docs(spark)).count() == 0 and T.links(edge_docs(spark)).count() == len(EDGE_ROWS)
