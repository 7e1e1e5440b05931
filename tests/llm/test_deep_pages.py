"""Pages of any nesting and any number of siblings; models that travel without the package."""

import pickle
import random

from fitloom.llm import html_wrappers as H
from fitloom.llm import language_id as L
from tests.llm.helpers import edge_docs

PAGES = "page_id long, url string, html string"


def texts(spark, pages):
    rows = [(i, u, h) for i, (u, h) in enumerate(pages)]
    return {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, PAGES)).collect()}


def test_deep_nesting(spark):
    deep = "<body>" + "<div>" * 100_000 + "the text</body>"
    closed = "<body>" + "<div>" * 3000 + "<p>inside</p>" + "</div>" * 3000 + "<p>after</p></body>"
    forms = "<body>" + "<form><span>" * 5000 + "<p>a</p></body>"
    out = texts(spark, [("http://a.org/1", deep), ("http://a.org/2", closed), ("http://b.org/1", forms), ("http://a.org/3", "<body><p>plain</p></body>")])
    assert out[0] == "the text" and out[1] == "inside\nafter" and out[3] == "plain" and len(out) == 4


def test_very_many_siblings(spark):
    rng = random.Random(3)

    def page():
        return "<body><article>" + "".join(f"<{t}>w{k}</{t}>" for k, t in enumerate(rng.choices(["p", "h2", "h3", "blockquote", "pre"], k=20_000))) + "</article></body>"

    out = texts(spark, [("http://c.org/1", page()), ("http://c.org/2", page())])
    assert all(t.split("\n") == [f"w{k}" for k in range(20_000)] for t in out.values())


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(5)
    for _ in range(60):
        x, y = (rng.choices("abc", k=rng.randint(0, 9)) for _ in range(2))
        pairs = H._common(list(x), list(y))
        assert all(x[i] == y[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x)):
            for j in range(len(y)):
                best[i + 1][j + 1] = best[i][j] + 1 if x[i] == y[j] else max(best[i][j + 1], best[i + 1][j])
        assert len(pairs) == best[-1][-1]


def test_broadcast_model_needs_no_package(spark):
    model, limits = L.fit(edge_docs(spark))
    raw = pickle.dumps((model.plain(), limits))
    assert b"fitloom" not in raw
    plain, _ = pickle.loads(raw)
    sample = ["one two", "mit der und", ""]
    assert (L.Model.of(plain).entropies(sample)[0] == model.entropies(sample)[0]).all()
