"""Registered queries: SQL where there is some, and the pipeline stage by stage."""

from decimal import Decimal

import pytest
from brute import documents, kept_by_quality, near, overlaps, redacted, same

import corpus_pipeline
from voltweave.llm import decontaminate, pii, quality, queries


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_sql(spark, small, duck, name):
    got, wanted = queries.QUERIES[name](spark, small), duck.execute(queries.ORACLES[name])
    columns = [d[0] for d in wanted.description]
    assert sorted(columns) == sorted(got.columns)
    same(got.select(*columns).collect(), [tuple(int(v) if isinstance(v, Decimal) else v for v in r) for r in wanted.fetchall()])


def test_all_ten_are_registered():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 11)}


def test_pipeline_stages(spark, small):
    """Each stage's decisions against the operators' plain results on its own input."""
    docs = spark.read.parquet(f"{small}/documents.parquet").cache()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "MinHash near-dedup", "benchmark decontamination", "PII", "packing"]
    first = stages["quality rules"](spark, docs, small).cache()
    assert {r["doc_id"] for r in first.collect()} == {r["doc_id"] for r in quality.judge(docs).where("kept").collect()}
    second = stages["MinHash near-dedup"](spark, first, small).cache()
    rows = [(r["doc_id"], r["text"]) for r in first.collect()]
    assert {r["doc_id"] for r in second.collect()} == {d for d, _, _, kept in near(rows, 5, 80) if kept}
    third = stages["benchmark decontamination"](spark, second, small).cache()
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    hit = {r["doc_id"] for r in decontaminate.find_overlaps(second, items).collect()}
    assert hit and {r["doc_id"] for r in third.collect()} == {r["doc_id"] for r in second.collect()} - hit
    fourth = stages["PII"](spark, third, small).cache()
    before = {r["doc_id"]: r["text"] for r in third.collect()}
    assert {r["doc_id"]: r["text"] for r in fourth.collect()} == {d: pii.redact(t) for d, t in before.items()}
    assert fourth.columns == docs.columns
    packed = stages["packing"](spark, fourth, small)
    assert {r["doc_id"] for r in packed.collect()} == set(before)
    whole = corpus_pipeline.run(spark, small)
    assert {(r["doc_id"], r["doc_tokens"]) for r in whole.collect()} == {(r["doc_id"], r["doc_tokens"]) for r in packed.collect()}


def test_pipeline_equals_plain_versions(spark, small):
    """The whole run against versions written from the stages' statements."""
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    from voltweave.llm import packing

    t = pq.read_table(f"{small}/documents.parquet").to_pydict()
    items = list(map(tuple, zip(*pq.read_table(f"{small}/benchmark.parquet", columns=["item_id", "text"]).to_pydict().values(), strict=True)))
    rows = kept_by_quality(list(zip(t["doc_id"], t["text"], t["source"], strict=True)))
    rows = [(d, x) for d, x, _ in rows]
    first = {d for d, _, _, kept in near(rows, 5, 80) if kept}
    rows = [(d, x) for d, x in rows if d in first]
    bad = {d for d, _ in overlaps(rows, items)}
    rows = [(d, redacted(x, [("account", s, e) for s, e in pii.find(x)["account"]])) for d, x in rows if d not in bad]
    model = Tokenizer.from_file(packing.default_tokenizer())
    wanted = {(d, len(model.encode(x, add_special_tokens=False).ids) + 1) for d, x in rows}
    got = corpus_pipeline.run(spark, small).collect()
    assert bad and {(r["doc_id"], r["doc_tokens"]) for r in got} == wanted
    assert sum(r["length"] for r in got) == sum(n for _, n in wanted)


def test_pipeline_corner_cases(spark, corner_rows, small):
    clean = [(100 + k, " ".join(f"c{k}x{i}" for i in range(30))) for k in range(40)]  # else the host fails
    docs = documents(spark, corner_rows + clean, extra=True)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {r["doc_id"] for r in docs.collect()}
    assert {d for d, _ in clean} | {4} <= kept and not kept & {1, 2, 3, 5, 6, 7, 12, None}
    assert {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()} == kept
    empty = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, small).count() == 0
