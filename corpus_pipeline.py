"""The corpus pipeline: toxicity, quality, near duplicates, personal data, packing.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of ``documents``. Each bounds the bytes of the session's Arrow batches,
since its own passes over texts run when its result is written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborq.llm import near_dup, packing, pii, quality_model, toxicity
from arborq.llm._shared import MAX_BROADCAST_IDS, materialise, small_batches, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose severity model, fitted to the labelled ones among ``docs``, doesn't call them toxic. Null and
    empty texts are kept; every row is judged by its own text, whatever its id; an empty table stays empty."""
    small_batches(spark)
    model = toxicity.fit(toxicity.labelled_documents(spark, sf_dir, docs))
    marked = toxicity.mark(docs.select(*COLUMNS), model)
    return marked.where("NOT toxic").select(*COLUMNS)


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a calibrated quality score of 0.3 or more; the model learns from the labelled ones among ``docs``. Every
    row is judged by its own text, whatever its id, and null texts as empty ones; an empty table stays empty."""
    small_batches(spark)
    model = quality_model.trained(docs, quality_model.labels(spark, sf_dir))
    return quality_model.mark(docs.select(*COLUMNS), model).where("predicted = 1").select(*COLUMNS)


def near_dup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by 5-word shingles at a similarity of 0.8.

    Rows with a null id and rows without words are kept. Where rows repeat an id, each is judged by its own text; of those kept
    with equal shingle sets the smallest by text, language, source and length stays. Ids that go are broadcast where they are
    few enough, so that no text moves; else the texts are joined with them once."""
    small_batches(spark)
    rows = docs.select(*COLUMNS)
    found = materialise(near_dup.near_duplicates(docs).where("doc_id IS NOT NULL"), "near-verdicts")
    again = materialise(found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated-ids")
    gone = found.where("NOT kept").select("doc_id").union(again).distinct()
    n_gone, n_again = gone.count(), again.count()
    kept = rows.join(F.broadcast(gone) if n_gone <= MAX_BROADCAST_IDS else gone, "doc_id", "left_anti").select(*COLUMNS)
    if not n_again:
        return kept
    repeated = rows.join(F.broadcast(again) if n_again <= MAX_BROADCAST_IDS else again, "doc_id", "left_semi")
    verdicts = found.where("kept").join(again, "doc_id", "left_semi").select("doc_id", F.coalesce("set", F.lit(b"")).alias("set")).distinct()
    first = near_dup.with_set(repeated.select(*COLUMNS)).groupBy("doc_id", "set").agg(F.min(F.struct(*COLUMNS[1:])).alias("r"))
    return kept.union(first.join(verdicts, ["doc_id", "set"], "left_semi").select("doc_id", "r.*").select(*COLUMNS))


def pii_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind, and ``n_chars`` of the new texts. The network learns
    from a bounded sample of ``docs``; null texts stay null, rows that repeat are rewritten each, an empty table stays empty."""
    small_batches(spark)
    out = pii.redact(docs.select(*COLUMNS), pii.fit(docs))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens, with the ids. Null texts are empty ones, rows that
    repeat are packed each, an empty table gives no piece."""
    small_batches(spark)
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("near duplicates", near_dup_stage),
    ("personal data", pii_stage),
    ("packing", packing_stage),
]

#: No stage can be expressed in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents`` of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
