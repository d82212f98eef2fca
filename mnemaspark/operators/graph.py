"""Filters, lookups and contradictions of memories, entities and relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_about(needle: str) -> Column:
    """Any participant contains it, whatever the case."""
    return F.exists("who", lambda w: F.contains(F.lower(w), F.lit(needle.lower())))


def find_memories(memories: DataFrame, who: str | None = None, place: str | None = None, what: str | None = None) -> DataFrame:
    tests = [t for t in (who and is_about(who), place and F.col("place") == place, what and F.contains(F.lower("what"), F.lit(what.lower()))) if t is not None and not isinstance(t, str)]
    return memories.filter(reduce(lambda a, b: a & b, tests)) if tests else memories


def get(rows: DataFrame, id_) -> DataFrame:
    return rows.filter(F.col("id") == id_)


def entities_by_name(entities: DataFrame, name: str) -> DataFrame:
    return entities.filter(F.lower("name") == name.lower())


def entity_matches(query: str) -> Column:
    """Id or name equal, or an identifier contains it; an empty query matches none."""
    q = query.lower()
    if not q:
        return F.lit(False)
    return (F.col("id").cast("string") == q) | (F.lower("name") == q) | F.exists("identifiers", lambda x: F.contains(F.lower(x), F.lit(q)))


def find_relations(relations: DataFrame, from_id=None, to_id=None, relation_type: str | None = None) -> DataFrame:
    for column, value in (("from_id", from_id), ("to_id", to_id), ("relation_type", relation_type and relation_type.lower())):
        if value is not None:
            relations = relations.filter(F.col(column) == value)
    return relations


def polarity_band() -> Column:
    return F.when(F.col("polarity") > 0.3, "positive").when(F.col("polarity") < -0.3, "negative").otherwise("neutral")


def contradictions(relations: DataFrame) -> DataFrame:
    """Endpoints and type with strictly opposite signs, and how many pairs of rows are."""
    got = relations.groupBy("from_id", "relation_type", "to_id").agg(F.count_if(F.col("polarity") > 0).alias("pro"), F.count_if(F.col("polarity") < 0).alias("contra"))
    return got.filter("pro > 0 and contra > 0").withColumn("pairs", F.col("pro") * F.col("contra"))


def stats(**tables: DataFrame) -> DataFrame:
    counts = [t.agg(F.count("*").alias("rows")).select(F.lit(k).alias("table_name"), "rows") for k, t in tables.items()]
    return reduce(DataFrame.unionByName, counts)
