"""The pipeline's stages on a small table: what goes, what stays and what is rewritten."""

import corpus_pipeline as cp
import pyarrow as pa
from test_operators import brute_components

from arborq.llm import pii, quality_model, toxicity


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = docs
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, kept, small)
        assert tuple(out.columns) == cp.COLUMNS, name
        kept = cp.materialise(out, "test-stage")
    last = cp.STAGES[-1][1](spark, kept, small)
    assert last.select("doc_id").distinct().count() <= kept.count()


def test_no_ids_wait_for_a_worker(spark, small):
    """When pieces are placed, no row that holds a piece's ids waits for a Python worker: it is asked about lengths only."""
    plan = cp.packing_stage(spark, spark.read.parquet(f"{small}/documents.parquet"), small)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("ArrowEvalPython") :].splitlines()[1:]
    assert len(below) == 1 and "Range (1, 2049" in below[0], plan


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*cp.COLUMNS).collect()), key=str)


def test_each_stage_is_its_operators_verdicts(spark, small):
    """Toxicity and quality keep exactly the rows that the operator, asked for verdicts of each row, accepts."""
    docs = spark.read.parquet(f"{small}/documents.parquet").where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    toxic = {r.doc_id for r in toxicity.severity(docs, toxicity.fit(toxicity.labelled_documents(spark, small, docs))).collect() if r.toxic}
    assert rows_of(cp.toxicity_stage(spark, docs, small)) == rows_of(docs.where(~docs.doc_id.isin([*toxic, -1])))
    good = {r.doc_id for r in quality_model.score_documents(spark, small, docs).collect() if r.score >= 0.3}
    assert rows_of(cp.quality_stage(spark, docs, small)) == rows_of(docs.where(docs.doc_id.isin([*good, -1])))


def test_near_duplicates_are_the_brute_force_ones(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    named = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None and r.doc_id != 207]
    comp = brute_components(named, 5)
    want = sorted([i for i, (_, c) in comp.items() if i == c] + [207])
    got = [r.doc_id for r in cp.near_dup_stage(spark, docs, small).collect()]
    assert sorted(i for i in got if i is not None) == want and got.count(None) == 1


def test_repeated_ids_with_different_texts(spark, small):
    """Of one id: two equal rows (one stays), another text (stays), and a copy of a smaller id's text (goes)."""
    prose = lambda k: " ".join(f"w{(i * i + k * 17) % 101}.{k}" for i in range(40))
    texts = [(1, prose(1)), (5, prose(2)), (5, prose(2)), (5, prose(3)), (5, prose(1)), (6, prose(3)), (7, None), (7, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in cp.near_dup_stage(spark, docs, small).collect()), key=str)
    assert got == sorted([(1, prose(1)), (5, prose(2)), (5, prose(3)), (7, None)], key=str)


def test_redaction_covers_every_span(spark, small):
    """Texts after the stage are the texts with each of the operator's spans replaced by its kind."""
    prose = [f"call +49 {i} 555-{1000 + i} or write a{i}.b@host{i}.org from 10.{i}.3.{i} today" for i in range(60)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(prose)], "doc_id long, text string, lang string, source string, n_chars long")
    spans = {r.doc_id: r.spans for r in pii.find_pii(docs, pii.fit(docs)).collect()}
    got = {r.doc_id: (r.text, r.n_chars) for r in cp.pii_stage(spark, docs, small).collect()}
    for i, text in enumerate(prose):
        for kind, a, b in sorted(((k, int(a), int(b)) for k, a, b in (s.split(":") for s in spans[i].split(","))), key=lambda s: -s[1]):
            text = text[:a] + f"[{kind}]" + text[b:]
        assert got[i] == (text, len(text))


def test_near_duplicates_leave_one(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    ids = [r.doc_id for r in cp.near_dup_stage(spark, docs, small).collect()]
    assert 5 in ids and not {200, 201, 202} & set(ids) and ids.count(207) == 1 and None in ids and 203 in ids and 204 in ids


def test_redaction(spark, small):
    docs = spark.createDataFrame([(1, "write to a.b@c.org or +1 (499) 555-6503 now", "en", "s", 0), (2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in cp.pii_stage(spark, docs, small).collect()}
    assert got == {1: ("write to [email] or [phone] now", 31), 2: (None, None)}


def test_stages_send_small_batches(spark, small):
    """Each stage bounds what goes to a worker at a time, however many rows a partition has; a smaller bound that was set stays."""
    key, wide = "spark.sql.execution.arrow.maxBytesPerBatch", spark.range(0, 4000, 1, 1).selectExpr("id", "repeat('word ', 400) AS text")
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(20)
    was = spark.conf.get(key)
    sizes = lambda: [r.b for r in wide.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["b"]) for b in batches), "b long").collect()]
    try:
        for _, stage in cp.STAGES:
            spark.conf.set(key, "64m")
            stage(spark, docs, small)
            assert sum(got := sizes()) > 8_000_000 and max(got) < 3 << 20
        spark.conf.set(key, "512k")
        cp.toxicity_stage(spark, docs, small)
        assert spark.conf.get(key) == "512k"
    finally:
        spark.conf.set(key, was)
