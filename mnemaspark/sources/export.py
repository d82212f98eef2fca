"""Records as JSON documents and back: a column of text for each kind, with the fields in the documents' own order.

The documents are lossy as in the store that they are exchanged with: of a memory they lack language
and consolidation, of a relation the time of its update, and times of entities and relations are
written but not read. Tables keep all columns; these are for export and import only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEMORY = (
    "id string, who array<string>, what string, why string, `when` string, `where` string, how string, importance double, access_count int, last_accessed string, created_at string, "
    "metadata map<string,string>, lang string"
)
ENTITY = "id string, type string, name string, identifiers array<string>, attributes map<string,string>"
RELATION = "id string, from_id string, relation_type string, to_id string, strength double, polarity double, attributes map<string,string>"
INTENT = "who array<string>, what string, why string, `when` string, `where` string, how string, query_type string, confidence double, raw_query string, lang string"
LEVELS = {"schema": "heuristic", "date": "heuristic", "ambiguity": "heuristic", "contradiction": "heuristic", "embedding": "embedding", "redundancy": "token"}


def iso(t: Column) -> Column:
    """A time as ISO 8601 text; fractions of a second only where there are any."""
    t = t.cast("timestamp_ntz")
    return F.when(t == F.date_trunc("second", t), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def _document(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"})


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _own(rows: DataFrame, name: str, default: Column) -> Column:
    return F.coalesce(F.col(name), default) if name in rows.columns else default


def _empty_map() -> Column:
    return F.create_map().cast("map<string,string>")


def _parsed(schema: str) -> Column:
    """A document's fields. With an option given Spark doesn't cut the schema for each field that is used, so a document is parsed once, not once a field."""
    return F.from_json("document", schema, {"mode": "PERMISSIVE"})


def memory_documents(memories: DataFrame) -> DataFrame:
    """(id, document) of each memory."""
    blank = F.lit("")
    return memories.select("id", _document(
        id=F.col("id").cast("string"), who=F.coalesce("who", F.array().cast("array<string>")), what=F.col("what"), why=_own(memories, "why", blank), when=iso(F.col("when_ts")), where=F.col("place"), how=_own(memories, "how", blank),
        importance=F.col("importance"), access_count=_own(memories, "access_count", F.lit(0)), last_accessed=iso(F.col("last_accessed")), created_at=iso(F.coalesce("created_at", "when_ts")), metadata=_own(memories, "metadata", _empty_map())).alias("document"))


def memories_read(documents: DataFrame, now: str) -> DataFrame:
    """Memories of a column ``document``: fields that are missing have their defaults, times ``now``, an id that is missing is a new one.

    Text that isn't a document of a memory gives a row whose ``what`` is null.
    """
    d = _parsed(MEMORY)
    at = lambda name: F.coalesce(F.try_to_timestamp(d[name]).cast("timestamp_ntz"), F.lit(now).cast("timestamp_ntz"))
    text = lambda name, default="": F.coalesce(d[name], F.lit(default))
    return documents.select(
        F.coalesce(d["id"], F.uuid()).alias("id"), F.coalesce(d["who"], F.array().cast("array<string>")).alias("who"), d["what"].alias("what"), text("why").alias("why"), at("when").alias("when_ts"), text("where", "default").alias("place"),
        text("how").alias("how"), F.coalesce(d["importance"], F.lit(0.5)).alias("importance"), F.coalesce(d["access_count"], F.lit(0)).alias("access_count"), F.try_to_timestamp(d["last_accessed"]).cast("timestamp_ntz").alias("last_accessed"),
        at("created_at").alias("created_at"), F.coalesce(d["metadata"], _empty_map()).alias("metadata"), d["lang"].alias("lang"))


def entity_documents(entities: DataFrame) -> DataFrame:
    """(id, document)."""
    time = lambda n: iso(F.col(n)) if n in entities.columns else _none("string")
    return entities.select("id", _document(id=F.col("id").cast("string"), type=F.col("type"), name=F.col("name"), identifiers=_own(entities, "identifiers", F.array().cast("array<string>")), attributes=_own(entities, "attributes", _empty_map()), created_at=time("created_at"), updated_at=time("updated_at")).alias("document"))


def entities_read(documents: DataFrame) -> DataFrame:
    d = _parsed(ENTITY)
    return documents.select(F.coalesce(d["id"], F.uuid()).alias("id"), *[F.coalesce(d[n], F.lit("")).alias(n) for n in ("type", "name")], F.coalesce(d["identifiers"], F.array().cast("array<string>")).alias("identifiers"), F.coalesce(d["attributes"], _empty_map()).alias("attributes"))


def relation_documents(relations: DataFrame) -> DataFrame:
    """(id, document)."""
    time = iso(F.col("created_at")) if "created_at" in relations.columns else _none("string")
    return relations.select("id", _document(
        **{n: F.col(n).cast("string") for n in ("id", "from_id", "relation_type", "to_id")}, strength=_own(relations, "strength", F.lit(0.5)), polarity=_own(relations, "polarity", F.lit(1.0)), attributes=_own(relations, "attributes", _empty_map()), created_at=time).alias("document"))


def relations_read(documents: DataFrame) -> DataFrame:
    d = _parsed(RELATION)
    return documents.select(
        F.coalesce(d["id"], F.uuid()).alias("id"), *[F.coalesce(d[n], F.lit("")).alias(n) for n in ("from_id", "relation_type", "to_id")],
        *[F.coalesce(d[n], F.lit(x)).alias(n) for n, x in (("strength", 0.5), ("polarity", 1.0))], F.coalesce(d["attributes"], _empty_map()).alias("attributes"))


def _intent(question: str = "question") -> Column:
    i, blank = F.col("intent"), F.lit("")
    return F.struct(i["who"].alias("who"), i["what"].alias("what"), blank.alias("why"), blank.alias("when"), i["where"].alias("where"), blank.alias("how"), i["query_type"].alias("query_type"), i["confidence"].alias("confidence"), F.col(question).alias("raw_query"), F.col("lang").alias("lang"))


def intent_documents(asked: DataFrame) -> DataFrame:
    """(query_id, document) of parsed questions."""
    return asked.select("query_id", F.to_json(_intent(), {"ignoreNullFields": "false"}).alias("document"))


def intents_read(documents: DataFrame) -> DataFrame:
    return documents.select("query_id", _parsed(INTENT).alias("intent")).select("query_id", "intent.*")


def result_documents(asked: DataFrame, found: DataFrame, memories: DataFrame, metrics: DataFrame) -> DataFrame:
    """(query_id, document) of each question: the memories recalled, in order, and the metrics with the intent.

    A document has at most k and k more memories. Entities and relations are never recalled.
    """
    each = memory_documents(memories).join(found.select("query_id", "rank", "id"), "id")
    listed = each.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "document"))).alias("m"))
    # the documents are put together as text: each is JSON already
    rows = asked.select("query_id", _intent().alias("i")).join(listed, "query_id", "left").join(metrics.select("query_id", "structural_match_count", "semantic_fallback_count"), "query_id", "left")
    counts = F.to_json(F.struct(F.col("i").alias("intent"), F.lit("RegexExtractor").alias("extractor"), "structural_match_count", "semantic_fallback_count"))
    inner = F.coalesce(F.array_join(F.col("m.document"), ", "), F.lit(""))
    return rows.select("query_id", F.concat(F.lit('{"memories": ['), inner, F.lit('], "entities": [], "relations": [], "metrics": '), counts, F.lit("}")).alias("document"))


def validation_documents(results: DataFrame, at: str) -> DataFrame:
    """(id, document) of validated writes, with ids in place of memories and entities; reasons in words of our own."""
    level = F.col("level")
    text = lambda c: F.col(c).cast("string")
    what = F.col("what") if "what" in results.columns else F.lit("")
    reason = (
        F.when(level.isin("contradiction", "embedding"), F.concat(F.lit("says the opposite of memory "), text("conflict_id"))).when(level == "redundancy", F.concat(F.lit("repeats memory "), text("similar_id")))
        .when(level == "ambiguity", F.concat(F.size("ambiguous_ids").cast("string"), F.lit(" entities have the name of a participant"))).when(level == "schema", "has no content").when(level == "date", "lies far in the future").otherwise("nothing found"))
    advice = F.when(level.isin("contradiction", "embedding", "redundancy"), F.array(F.lit("change the memory that is there"), F.lit("or word the new one apart from it"))).when(level == "ambiguity", F.array(F.lit("name the participant by an identifier"))).when(level == "schema", F.array(F.lit("say what happened"))).when(level == "date", F.array(F.lit("check the time"))).otherwise(F.array().cast("array<string>"))
    more = F.map_filter(F.create_map(*[x for pair in (
        (F.lit("who_overlap"), F.when(level.isin("contradiction", "embedding"), text("who_overlap"))), (F.lit("what_overlap"), F.when(level.isin("contradiction", "embedding"), text("what_overlap"))),
        (F.lit("similarity_score"), F.when(level == "redundancy", text("similarity"))), (F.lit("missing_field"), F.when(level == "schema", F.lit("what"))), (F.lit("downgraded_from"), F.col("downgraded_from"))) for x in pair]), lambda _, v: v.isNotNull())
    detection = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair]), level), F.lit("none"))
    ids = F.when(level == "ambiguity", F.transform("ambiguous_ids", lambda x: x.cast("string"))).otherwise(F.array().cast("array<string>"))
    return results.select("id", _document(
        status=F.col("status"), reason=reason, conflicting_memory_id=text("conflict_id"), similar_memory_id=F.when(F.col("conflict_id").isNull(), text("similar_id")), ambiguous_entity_ids=ids, suggestions=advice,
        timestamp=iso(F.lit(at)), metadata=more, detection_level=detection).alias("document"))
