"""Interaction audit of quality filters.

Every document gets a bit mask of the filters it fails. Documents then count by part and
mask; those cells, not the documents, meet the steps of every order of the filters. A
running bit-or over the steps before tells what had removed a cell already, conditional
sums give the figures of a step, and sums over a filter's window its Shapley total.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: The filters, in the order of their bits.
FILTERS = "ABCDE"
_WORD_GAP = r"[ \t-\r]+"


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of the contract, over a text that is not null."""
    words = F.array_remove(F.split(text, _WORD_GAP), "")
    n_words, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n_words < 200,
        "B": 100 * distinct < 50 * n_words,
        "C": 100 * capitals.cast("long") > 2 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, mask) of every row of ``docs``; written once, with filter E among the bits.

    Filter E fails rows whose text some smaller id has too. Only the pair of a text and its
    smallest id passes, so rows meet those pairs by text and id together: however many rows
    share a text, no task gathers them.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    bits = sum((F.when(failed, 1 << FILTERS.index(letter)).otherwise(0) for letter, failed in text_failures(text).items()), F.lit(0))
    rows = materialise(docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        bits.alias("mask"), F.unhex(F.sha2(F.encode(text, "utf-8"), 256)).alias("digest"),
    ), "filter-masks")
    firsts = rows.groupBy("digest").agg(F.min("id").alias("id")).where(F.col("id").isNotNull()).withColumn("first", F.lit(True))
    passed = F.col("first").isNotNull() | F.col("id").isNull()
    return rows.join(firsts, ["digest", "id"], "left").select("id", "part", (F.col("mask") + F.when(passed, 0).otherwise(1 << FILTERS.index("E"))).alias("mask"))


def cells(masked: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): documents of every part and mask, and how many are labelled so."""
    marked = labels.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    return masked.join(marked, "id", "left").groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"),
    )


def evaluate(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row per part, order and step, from the cells that the parts have."""
    steps = F.array(*(
        F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(step).alias("step"), F.lit(letter).alias("filter"), F.lit(1 << filters.index(letter)).alias("bit"))
        for order in itertools.permutations(filters) for step, letter in enumerate(order, start=1)
    ))
    long = counted.select("*", F.inline(steps))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    failing = F.col("mask").bitwiseAND(F.col("bit"))
    judged = long.select("*", (failing != 0).alias("fails"), (F.coalesce(F.bit_or(failing).over(before), F.lit(0)) != 0).alias("gone"))

    def total(condition: Column, of: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(of)).otherwise(0))

    fails, gone = F.col("fails"), F.col("gone")
    per_step = judged.groupBy("part", "filter_order", "step", "filter").agg(
        total(~fails & ~gone).alias("kept"),
        total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"),
        total(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "filter"))
    return per_step.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley.alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """What every filter removes at every step of every order, for each part of ``docs``.

    A null text is empty (and equal to other empty ones), a null part the empty string. A
    document without id is nobody's earlier copy and has none, and carries no label; rows
    that repeat an id count one by one, and copies under the smallest id all pass E. Labels
    that repeat an id count as labelled if any row says so; null labels say nothing. Other
    columns are ignored; an empty table has no parts and no rows.
    """
    return evaluate(cells(masks(docs, id_col, text_col, part_col), labels))


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    """Contract query: the audit over all documents, by source."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: The same by one row a document, order and step, for DuckDB.
ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
f AS (SELECT doc_id, part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
        100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d, coalesce(first < doc_id, false) AS e FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
g AS (SELECT part, a, b, c, d, e, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT [p.x, q.x, r.x, s.x, u.x] AS o FROM x AS p, x AS q, x AS r, x AS s, x AS u WHERE len(list_distinct([p.x, q.x, r.x, s.x, u.x])) = 5),
k AS (SELECT part, array_to_string(o, '') AS filter_order, step, o[step] AS letter, n, good, toxic,
        list_filter(['A', 'B', 'C', 'D', 'E'], lambda y: CASE y WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END) AS failed,
        o[1:step - 1] AS earlier
      FROM g, o, (SELECT unnest(range(1, 6)) AS step)),
j AS (SELECT *, list_contains(failed, letter) AS fails, list_has_any(failed, earlier) AS gone FROM k),
s AS (SELECT part, filter_order, step, letter,
        coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS removed,
        coalesce(sum(n) FILTER (fails AND gone), 0) AS redundant, coalesce(sum(n) FILTER (failed = [letter]), 0) AS unique_fails,
        coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0) AS toxic_lost
      FROM j GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM s
"""
