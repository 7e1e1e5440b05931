"""The corpus pipeline stage by stage, and the registered queries."""

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from fitloom.llm import queries
from tests.llm.helpers import EDGE_ROWS, classes, edge_docs, no_docs, shingle_bag, similarity


def test_every_operator_is_registered():
    numbers = sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES)
    assert numbers == list(range(1, len(queries.QUERIES) + 1))
    registered = entry.queries()
    assert set(queries.QUERIES) <= set(registered) and registered["pipeline"] is pipeline.run
    assert set(queries.ORACLES) <= set(entry.oracle_sql())


def test_stages_do_their_work(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    names, before = d.columns, None
    for name, stage in pipeline.STAGES:
        out = pipeline.scratch(stage(spark, d, sf), f"test-{name}")
        rows = out.collect()
        if name != "packed":
            assert out.columns == names
        if name == "quality":
            verdict = {r["doc_id"]: r["kept"] for r in queries.QUERIES["op6_quality_rules"](spark, sf).collect()}
            assert {r.doc_id for r in rows} == {i for i, kept in verdict.items() if kept}
        if name == "lines":
            assert {r.doc_id for r in rows} == {r.doc_id for r in before}
            long = [line for r in rows for line in r.text.split("\n") if len(line.split()) > 50]
            assert len(long) == len(set(long)) and all(r.n_chars == len(r.text) for r in rows)
        if name == "near_dedup":
            bags = {r.doc_id: shingle_bag(r.text) for r in before}
            ids = sorted(bags)
            links = [(x, y) for k, x in enumerate(ids) for y in ids[k + 1:] if similarity(bags[x], bags[y]) >= 0.8]
            # texts without a word are duplicates of nothing
            assert {r.doc_id for r in rows} == set(classes(ids, links).values())
        if name == "mixture":
            assert {r.doc_id for r in rows} <= {r.doc_id for r in before} and len(rows) > len(before)
        before, d = rows, out
    assert {r.sequence_id for r in before} and pipeline.run(spark, sf).count() == len(before)


def test_pipeline_edges(spark):
    for frame in (edge_docs(spark), no_docs(spark)):
        for _, stage in pipeline.STAGES:
            out = stage(spark, frame, "")
            assert out.count() <= 400 * len(EDGE_ROWS)
            frame = pipeline.scratch(out, "test-edge")
