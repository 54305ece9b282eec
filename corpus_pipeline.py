"""Corpus pipeline: toxicity, near-dedup, decontamination, secret scans, encoding.

Every stage takes ``(spark, docs, sf_dir)``, judges all rows of its own input and returns
the columns of ``documents``; the last returns the encoded corpus. ``run`` writes nothing
between stages that an operator does not write itself; a driver that writes each stage as
Parquet and rereads it gets the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm import decontaminate, pieces, secrets, simhash, toxicity
from tallywright.llm.common import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Part of a document's words that benchmark items may share with it before it goes whole;
#: below it only the shared words go.
CONTAMINATED_SHARE = 0.5


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least the threshold go; the model learns from the labels of this input.

    A null id or text is scored like any other; rows that share an id go together if one is
    toxic.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs.select(F.struct(*COLUMNS).alias("row"), "text"), model, "row")
    return scored.where(F.col("score") < toxicity.THRESHOLD).select("row.*")


def _row_key() -> Column:
    """A digest of all columns: ids may be null or repeat, and rows of one digest are equal."""
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in COLUMNS]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def drop_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: the one whose id names the component.

    Of rows that repeat that id, and of a component without ids, the row with the smallest
    digest stays. Other components keep theirs, whatever ids they share.
    """
    keyed = docs.select(*COLUMNS, _row_key().alias("key_"))
    # ids first, and null ids last
    labels = simhash.near_duplicates(keyed.select(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key_").alias("row_"), "text"), "row_")
    kept = labels.where(F.col("row_.key_") == F.col("component_id.key_")).select("row_.key_").distinct()
    return keyed.join(kept, "key_", "left_semi").dropDuplicates(["key_"]).select(*COLUMNS)


def remove_benchmarks(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are mostly benchmark text go; others lose the shared words.

    Removal cuts the hit word ranges out of the text, with what stands between their words.
    Every row is judged and cut by its own text, whatever its id.
    """
    keyed = docs.select(*COLUMNS, _row_key().alias("row_"))
    found = decontaminate.decontaminate(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "row_")
    hits = found.where("n_hit > 0").select("row_", (F.col("n_hit") / F.col("n_words")).alias("share"), "spans").dropDuplicates(["row_"])
    joined = keyed.join(hits, "row_", "left").where(F.coalesce("share", F.lit(0.0)) < CONTAMINATED_SHARE)
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(decontaminate.without_spans(F.col("text"), F.col("spans")))
    return joined.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mask_secrets(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret span reads [SECRET]; all documents stay."""
    found = secrets.scan(docs.withColumn("row_", F.struct(*COLUMNS)), "row_")
    text = F.when(F.size("spans") == 0, F.col("row_.text")).otherwise(secrets.masked(F.col("row_.text"), F.col("spans")))
    out = found.select("row_.*", text.alias("masked_"))
    return out.withColumn("text", F.col("masked_")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encode(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept corpus as piece ids."""
    rows = docs.select(F.struct("doc_id", "lang", "source", "n_chars").alias("row"), "text")
    out = pieces.encode(rows, pieces.default_model(), "row")
    return out.select("row.*", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", remove_benchmarks),
    ("secrets", mask_secrets),
    ("encoding", encode),
]

#: Toxicity, near-dedup components and piece folds are no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """Apply STAGES in order to documents, each to the written table of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
