"""Joins: fallback keys, names, registries, OR predicates, cascades.

A join on "this key, else that one" is two equi-joins and a coalesce, and an OR of
equalities a union of equi-joins: neither may stand in one join condition, which would
compare every pair. Build sides are deduplicated first where several rows could match.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import name_variants, normalise_name, surname
from ..session import scratch_path


def one_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of each key by ``order``."""
    return df.withColumn("rn_", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("rn_ = 1").drop("rn_")


def fallback_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], columns: list[str], order: list[Column]) -> DataFrame:
    """``left`` with ``columns`` of the row of ``right`` that the first fitting key pair finds.

    ``order`` decides among rows of ``right`` with one key. ``matched_by`` is the number of
    the key pair that matched, from 1, or null. Keys are compared as text: a missing one is
    given a text that no key has, so that rows without key do not all meet in one task.
    """
    lone = F.concat(F.lit("\x00"), F.xxhash64(*[F.col(c) for c in left.columns]).cast("string"))
    out = left
    for i, (own, other) in enumerate(keys, 1):
        lookup = one_per_key(right.where(F.col(other).isNotNull()), [other], order).select(F.col(other).cast("string").alias(f"k{i}_"), *[F.col(c).alias(f"{c}_{i}_") for c in columns])
        out = out.join(lookup, F.coalesce(F.col(own).cast("string"), lone) == F.col(f"k{i}_"), "left")
    hit = [F.col(f"k{i}_").isNotNull() for i in range(1, len(keys) + 1)]
    for c in columns:
        out = out.withColumn(c, F.coalesce(*[F.when(h, F.col(f"{c}_{i}_")) for i, h in enumerate(hit, 1)]))
    out = out.withColumn("matched_by", F.coalesce(*[F.when(h, F.lit(i)) for i, h in enumerate(hit, 1)]))
    return out.drop(*[f"k{i}_" for i in range(1, len(keys) + 1)], *[f"{c}_{i}_" for c in columns for i in range(1, len(keys) + 1)])


def match_names(raw: DataFrame, people: DataFrame, raw_name: str, name: str, person_id: str, order: str) -> DataFrame:
    """``raw`` with person_id and level: exact name (1), surname (2), initial and surname (3).

    Of several people the first by ``order`` is meant.
    """
    initial = lambda c: F.concat(F.substring(normalise_name(c), 1, 1), F.lit(" "), surname(c))
    keys = ((1, normalise_name), (2, surname), (3, initial))
    out = raw
    for level, key in keys:
        found = people.groupBy(key(F.col(name)).alias(f"k{level}_")).agg(F.min_by(person_id, order).alias(f"id{level}_"))
        out = out.withColumn(f"r{level}_", key(F.col(raw_name))).join(found, F.col(f"r{level}_") == F.col(f"k{level}_"), "left")
    ids = [F.col(f"id{level}_") for level, _ in keys]
    out = out.withColumn(person_id, F.coalesce(*ids)).withColumn("level", F.coalesce(*[F.when(i.isNotNull(), F.lit(level)) for i, (level, _) in zip(ids, keys)]))
    return out.drop(*[f"{p}{level}_" for p in ("k", "id", "r") for level, _ in keys])


def or_join(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], left_key: str, right_key: str) -> DataFrame:
    """(left_key, right_key) of all pairs for which any of the equalities holds, once each."""
    parts = [left.select(left_key, F.col(a).alias("k_")).join(right.select(right_key, F.col(b).alias("k_")), "k_").select(left_key, right_key) for a, b in pairs]
    return functools.reduce(DataFrame.unionByName, parts).distinct()


def registry(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(winners, conflicts) of (entity, id, name, dataset, priority, row_idx) pairs.

    The first pair of each id by priority and row wins; rows of another name conflict.
    """
    order = W.partitionBy("entity", "id").orderBy("priority", "row_idx")
    ranked = pairs.where("id is not null and name is not null").withColumn("rn", F.row_number().over(order)).withColumn("winner", F.first("name").over(order))
    conflicts = ranked.where("name <> winner").groupBy("entity", "id", "winner", "name").agg(F.sort_array(F.collect_set("dataset")).alias("datasets"))
    return ranked.where("rn = 1").select("entity", "id", "name", "dataset"), conflicts


def registry_variants(winners: DataFrame) -> DataFrame:
    """(entity, variant, id): every spelling of the registered names; of equal ones the smallest id."""
    return winners.select("entity", "id", F.explode(name_variants(F.col("name"))).alias("variant")).groupBy("entity", "variant").agg(F.min("id").alias("id"))


def apply_registry(df: DataFrame, winners: DataFrame, entity: str, id_col: str, name_col: str) -> DataFrame:
    """Fills a missing id from the name's variants and a missing name from the id; tags what it filled."""
    own = winners.where(F.col("entity") == entity)
    by_id = own.select(F.col("id").alias("i_"), F.col("name").alias("n_"))
    by_name = registry_variants(own).select(F.col("variant").alias("v_"), F.col("id").alias("vi_"))
    out = df.join(by_id, F.col(id_col) == F.col("i_"), "left").withColumn("key_", normalise_name(F.col(name_col))).join(by_name, F.col("key_") == F.col("v_"), "left")
    filled_id, filled_name = F.col(id_col).isNull() & F.col("vi_").isNotNull(), F.col(name_col).isNull() & F.col("n_").isNotNull()
    return out.select(
        *[c for c in df.columns if c not in (id_col, name_col)], F.coalesce(id_col, "vi_").alias(id_col), F.coalesce(name_col, "n_").alias(name_col),
        F.array_compact(F.array(F.when(filled_id, F.lit(id_col)), F.when(filled_name, F.lit(name_col)))).alias("cross_referenced"),
    )


#: Entities of a registry with the id and name columns of a record, and how their names are looked up.
ENTITIES = {
    "matter": ("matter_id", "matter_number", lambda c: c.cast("string")),
    "earner": ("lawyer_id", "lawyer_name", normalise_name),
    "client": ("client_id", "display_name", F.lower),
    "department": ("department_id", "department", F.lower),
}
#: Parts that the rows of one key are dealt to.
SALTS = 16


def cross_reference(df: DataFrame, winners: DataFrame, entities: dict | None = None, salts: int = SALTS) -> DataFrame:
    """Every record with the ids that its names have in the registry, and the names of its ids, of all entities at once.

    ``winners`` is a registry (entity, id, name) as ``registry`` gives it. What a record lacks
    is unpivoted to rows (entity, direction, key), which meet the registry in one join, dealt by
    key and salt, and come back as a map a record. ``cross_referenced`` lists the columns that
    were filled. Fee earners are found under any spelling of their names, matters by number, the
    others by name in any case; of several ids the smallest is meant.
    """
    entities = {e: columns for e, columns in (entities or ENTITIES).items() if columns[0] in df.columns and columns[1] in df.columns}
    spark = df.sparkSession
    path = scratch_path(spark, "records")
    df.withColumn("row_", F.monotonically_increasing_id()).write.parquet(path)  # row numbers must not change
    rows = spark.read.parquet(path)

    def ask(entity: str, have: str, lack: str, key: Column) -> Column:
        return F.when(F.col(lack).isNull() & F.col(have).isNotNull(), F.struct(F.lit(f"{entity}.{lack}").alias("field"), key.alias("key")))

    asks = [a for e, (i, name, key) in entities.items() for a in (ask(e, i, name, F.col(i).cast("string")), ask(e, name, i, key(F.col(name))))]
    wanted = rows.select("row_", F.inline(F.array_compact(F.array(*asks)))).withColumn("salt", F.pmod(F.xxhash64("row_"), F.lit(salts)))
    answers = []
    for e, (i, name, key) in entities.items():
        own = winners.where(F.col("entity") == e)
        spelled = F.explode(name_variants(F.col("name")) if key is normalise_name else F.array(key(F.col("name"))))
        answers += [
            own.select(F.lit(f"{e}.{name}").alias("field"), F.col("id").cast("string").alias("key"), F.col("name").cast("string").alias("found")),
            own.select("id", spelled.alias("key")).groupBy("key").agg(F.min("id").cast("string").alias("found")).select(F.lit(f"{e}.{i}").alias("field"), "key", "found"),
        ]
    answers = functools.reduce(DataFrame.unionByName, answers).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    hits = wanted.join(answers, ["field", "key", "salt"]).groupBy("row_").agg(F.map_from_entries(F.collect_list(F.struct("field", "found"))).alias("found_"))
    joined = rows.join(hits, "row_", "left")

    def found(entity: str, column: str) -> Column:
        return F.try_element_at("found_", F.lit(f"{entity}.{column}"))

    filled = {c: F.coalesce(F.col(c), found(e, c).cast(df.schema[c].dataType)) for e, (i, name, _) in entities.items() for c in (i, name)}
    tags = [F.when(found(e, c).isNotNull(), F.lit(c)) for e, (i, name, _) in entities.items() for c in (i, name)]
    return joined.select(*[filled.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns], F.array_compact(F.array(*tags)).alias("cross_referenced"))


def merge_people(primary: DataFrame, extra: DataFrame, columns: list[str]) -> DataFrame:
    """Primary people with ``columns`` of extra rows, by account id, else e-mail, else full name, else a surname that both sides have once."""
    def once(df: DataFrame, key: Column) -> DataFrame:
        return df.withColumn("s_", key).withColumn("n_", F.count("*").over(W.partitionBy("s_")))

    left = once(primary, surname(F.col("name"))).withColumn("k1", F.col("account_id")).withColumn("k2", F.lower("email")).withColumn("k3", normalise_name(F.col("name")))
    left = left.withColumn("k4", F.when(F.col("n_") == 1, F.col("s_"))).drop("s_", "n_")
    right = once(extra, surname(F.col("name"))).withColumn("k1", F.col("account_id")).withColumn("k2", F.lower("email")).withColumn("k3", normalise_name(F.col("name")))
    right = right.withColumn("k4", F.when(F.col("n_") == 1, F.col("s_"))).select(*[F.col(f"k{i}").alias(f"x{i}") for i in range(1, 5)], *columns)
    return fallback_join(left, right, [(f"k{i}", f"x{i}") for i in range(1, 5)], columns, [F.col(c).asc_nulls_last() for c in columns]).drop("k1", "k2", "k3", "k4")


def date_paid(invoices: DataFrame, payments: DataFrame) -> DataFrame:
    """Invoices with the date they were settled: of the first clearing payment, else of the latest."""
    live = payments.where(F.coalesce(F.col("status"), F.lit("")) != "REVERSED")
    settled = live.groupBy("invoice_id").agg(F.min_by("date", F.when(F.col("outstanding") == 0, F.col("row_idx"))).alias("first_"), F.max("date").alias("last_"), F.count_if(F.col("outstanding") == 0).alias("n_"))
    return invoices.join(settled, "invoice_id", "left").withColumn("date_paid", F.when(F.col("n_") > 0, F.col("first_")).otherwise(F.col("last_"))).drop("first_", "last_", "n_")


def array_containment(left: DataFrame, right: DataFrame, key: str, array: str) -> DataFrame:
    """Pairs in which the left key stands in the right array: explode, then an equi-join."""
    return left.join(right.withColumn(key, F.explode(F.array_distinct(array))), key)


def difference(live: DataFrame, trial: DataFrame, key: str = "entity_id") -> DataFrame:
    """Both results of each entity side by side, with the change."""
    both = live.select(key, F.col("value").alias("live")).join(trial.select(key, F.col("value").alias("trial")), key, "full_outer")
    return both.withColumn("delta", F.col("trial") - F.col("live"))
