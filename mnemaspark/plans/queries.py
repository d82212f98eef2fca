"""Every query of the memory engine over the derived fixtures: (spark, folder of tables) -> DataFrame."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import decay as D
from ..functions import similarity as S
from ..functions import text as T
from ..operators import dream, evaluate, graph, intent, recall, validate, vector
from ..sources import fixtures as X
from ..sources import export, shared, store
from ..streaming import access_state

QUERIES = {}
c = F.col
#: Memories that ``dream_replay`` lists; a cycle touches ``dream.REPLAY`` of them.
REPLAYED = 10
NEEDLE, NATION, QUESTION = "customer000000001", "NATION_3", "order still open with high priority"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def six(x):
    """Six places by the scaled value, as SQL engines round doubles; Spark's own rounding goes by the shortest decimal and parts at ties."""
    return F.round(x * 1e6) / 1e6


def _docs(spark, d):
    return X.read(spark, d, "documents").select("doc_id", "text")


def _token_query(tokens):
    def run(spark, d):
        toks = tokens(c("text"))
        return _docs(spark, d).select("doc_id", F.size(toks).alias("n_tokens"), F.md5(T.listed(toks)).alias("tokens_md5"))

    return run


QUERIES["tokenize_recall"] = _token_query(T.recall_tokens)
QUERIES["tokenize_validator"] = _token_query(T.validator_tokens)
QUERIES["tokenize_whitespace"] = _token_query(T.space_tokens)


@query
def has_negation(spark, d):
    return _docs(spark, d).select("doc_id", T.has_negation(c("text")).alias("negated"))


@query
def detect_lang(spark, d):
    return _docs(spark, d).select("doc_id", T.detect_lang(c("text")).alias("lang"))


@query
def extract_who(spark, d):
    who = T.extract_who(c("text"))
    return X.turns(spark, d).select("conv_id", "turn", F.size(who).alias("n_who"), T.listed(who).alias("who"))


@query
def extract_when(spark, d):
    return _docs(spark, d).select("doc_id", T.extract_when(c("text")).alias("when_text"))


@query
def extract_where(spark, d):
    return _docs(spark, d).select("doc_id", T.extract_where(c("text")).alias("place"))


@query
def rough_tokens(spark, d):
    return _docs(spark, d).select("doc_id", T.rough_tokens(c("text")).alias("tokens"))


@query
def turns_to_memories(spark, d):
    p = store.pair_turns(X.turns(spark, d))
    return p.select("conv_id", "turn", T.listed(T.extract_who(c("text"))).alias("who"), F.md5("text").alias("what_md5"), T.extract_where(c("text")).alias("place"), F.md5("answer").alias("how_md5"), F.lit(0.6).alias("importance"))


@query
def matches_text(spark, d):
    return X.mem_orders(spark, d).select("id", six(S.matches_text(F.lit(QUESTION))).alias("score"))


@query
def memory_to_text(spark, d):
    at = F.when(~c("place").isin("", "default"), F.concat(F.lit("@"), "place"))
    blank = lambda x: F.when(c(x) != "", c(x))
    return X.mem_orders(spark, d).select("id", F.concat_ws(" | ", F.concat_ws(",", "who"), "what", blank("why"), at, blank("how")).alias("line"))


# ---- lookups ------------------------------------------------------------------------------


@query
def get_memory(spark, d):
    return graph.get(X.mem_orders(spark, d), 42).select("id", "what", "place")


@query
def find_memories_who(spark, d):
    return graph.find_memories(X.mem_orders(spark, d), who=NEEDLE).select("id", "what", "place")


@query
def find_memories_where_what(spark, d):
    return graph.find_memories(X.mem_orders(spark, d), place=NATION, what="Still Open").select("id", "what", "importance")


@query
def find_entities_by_name(spark, d):
    return graph.entities_by_name(X.entities(spark, d), "Small RING").select("id", "name")


@query
def entity_matches(spark, d):
    return X.entities(spark, d).filter(graph.entity_matches("Brand#2")).select("id", "name")


@query
def find_relations(spark, d):
    return graph.find_relations(X.relations(spark, d), from_id=7, relation_type="PREFERS").select("from_id", "to_id", "polarity", "order_id", "line")


@query
def relation_polarity_bands(spark, d):
    return X.relations(spark, d).groupBy(graph.polarity_band().alias("band")).agg(F.count("*").alias("n"))


@query
def relation_contradictions(spark, d):
    return graph.contradictions(X.relations(spark, d)).select("from_id", "relation_type", "to_id", "pro", "contra", "pairs")


@query
def graph_stats(spark, d):
    return graph.stats(memories=X.mem_orders(spark, d), entities=X.entities(spark, d), relations=X.relations(spark, d))


@query
def is_consolidated(spark, d):
    return X.mem_orders(spark, d).select("id", D.consolidated().alias("is_consolidated"), c("consolidated_into").isNotNull().alias("was_consolidated"))


@query
def upsert_latest(spark, d):
    return store.upsert(X.read(spark, d, "events").select("event_id", "user_id", "event_type", "value"), ["user_id", "event_type"], "event_id")


@query
def memory_normalize(spark, d):
    rows = X.read(spark, d, "documents").select("doc_id", F.array("lang", F.concat(F.lit(" "), "source", F.lit(" ")), F.lit(" ")).alias("who"), F.concat(F.lit(" \n"), "text", F.lit("\t ")).alias("what"), F.when(c("doc_id") % 2 == 0, c("source")).otherwise("").alias("place"), (c("n_chars") / 10000.0).alias("importance"))
    return store.normalised(rows).select("doc_id", T.listed(c("who")).alias("who"), F.md5("what").alias("what_md5"), "place", "valid")


@query
def export_record(spark, d):
    return store.record(X.mem_orders(spark, d)).select("id", T.listed(c("who")).alias("who"), "what", "place", six(c("importance")).alias("importance"), "access_count")


@query
def inherit_similar(spark, d):
    """Writes that leave participants, place and importance open in turn, each beside the first order of its nation."""
    m = X.mem_orders(spark, d)
    near = m.groupBy("place").agg(F.min_by("id", "seq").alias("similar_to"))
    left = m.join(near, "place").withColumns({
        "who": F.when(c("id") % 2 == 0, F.array().cast("array<string>")).otherwise(c("who")), "place": F.when(c("id") % 3 == 0, "default").otherwise(c("place")), "importance": F.when(c("id") % 5 == 0, 0.5).otherwise(c("importance"))})
    got = store.inherited(left, m)
    return got.join(left.select("id", c("similar_to").alias("ref")), "id").select("id", "ref", T.listed(c("who")).alias("who"), "place", "importance")


@query
def memory_documents(spark, d):
    """Memories written as documents and read again."""
    back = export.memories_read(export.memory_documents(X.mem_orders(spark, d)), X.AS_OF)
    return back.select(c("id").cast("long").alias("id"), T.listed(c("who")).alias("who"), "what", "why", "when_ts", "place", "how", "importance", "access_count", "last_accessed", "created_at")


@query
def entity_documents(spark, d):
    back = export.entities_read(export.entity_documents(X.entities(spark, d)))
    return back.select(c("id").cast("long").alias("id"), "type", "name", F.array_join("identifiers", "|").alias("identifiers"))


@query
def relation_documents(spark, d):
    rows = X.relations(spark, d).withColumn("id", F.concat_ws("/", c("order_id").cast("string"), c("line").cast("string")))
    return export.relations_read(export.relation_documents(rows)).select("id", "from_id", "relation_type", "to_id", "strength", "polarity")


@query
def intent_documents(spark, d):
    back = export.intents_read(export.intent_documents(_asked(spark, d)))
    return back.select("query_id", T.listed(c("who")).alias("who"), "what", c("where").alias("place"), "query_type", "confidence", "raw_query", "lang")


# ---- intents and recall -------------------------------------------------------------------


def _intent_query(lang):
    def run(spark, d):
        q = X.questions(spark, d).withColumn("lang", F.lit(lang))
        i = intent.with_intent(q)
        return i.select("query_id", T.listed(c("intent.who")).alias("who"), "intent.what", c("intent.where").alias("place"), "intent.query_type", "intent.confidence")

    return run


for _lang in ("pt", "en", "es"):
    QUERIES[f"intent_{_lang}"] = _intent_query(_lang)


def _asked(spark, d):
    return intent.with_intent(X.questions(spark, d))


@query
def intent_auto(spark, d):
    return _asked(spark, d).select("query_id", "lang", "intent.query_type", intent.structured().alias("is_structured"))


@query
def recall_structural(spark, d):
    return recall.structural(_asked(spark, d), X.mem_orders(spark, d)).select("query_id", "rank", "id", six(c("score")).alias("score"))


@query
def recall_semantic(spark, d):
    return recall.semantic(_asked(spark, d), X.mem_orders(spark, d)).select("query_id", "rank", "id", six(c("score")).alias("score"))


@query
def recall_tiered(spark, d):
    return recall.tiered(_asked(spark, d), X.mem_orders(spark, d)).select("query_id", "rank", "tier", "id")


@query
def recall_packed(spark, d):
    q = _asked(spark, d)
    return recall.pack(recall.tiered(q, X.mem_orders(spark, d)), q, 30).select("query_id", "packed", "tokens")


@query
def inspect(spark, d):
    got = recall.tiered(_asked(spark, d), X.mem_orders(spark, d)).drop("score").join(X.questions(spark, d).select("query_id", "question"), "query_id")
    return got.withColumn("how", F.lit("")).select("query_id", "rank", "id", F.bround("importance", 3).alias("importance"), six(S.matches_text(c("question"))).alias("match_score"))


@query
def about_entity(spark, d):
    return recall.about(X.mem_orders(spark, d), NEEDLE).select("id", "what", "importance")


@query
def eval_tokens(spark, d):
    """Characters and tokens of the packed answer against all of the customer's memories listed in full."""
    q = _asked(spark, d)
    packed = recall.pack(recall.tiered(q, X.mem_orders(spark, d)), q)
    whole = X.mem_orders(spark, d).agg(F.sum(F.length(F.concat(F.lit("["), F.concat_ws(", ", "who"), F.lit("] "), "what", F.lit(" @ "), "place")) + 1).alias("chars"))
    return packed.agg(F.count("*").alias("answered"), F.sum("tokens").alias("packed_tokens")).join(whole).select("answered", "packed_tokens", (c("chars") / 4).cast("long").alias("baseline_tokens"))


@query
def precision_at_k(spark, d):
    q = X.questions(spark, d).withColumn("wanted", F.lower(F.expr("replace(concat('customer#', lpad(cast(query_id as string), 9, '0')), '#', '')")))
    got = recall.tiered(_asked(spark, d), X.mem_orders(spark, d)).filter(c("rank") <= 5).join(q.select("query_id", "wanted"), "query_id")
    hit = F.exists("who", lambda w: F.lower(w) == c("wanted")).cast("double")
    return got.groupBy("query_id").agg(F.sum(hit).alias("hits"), F.count("*").alias("returned")).select("query_id", six(c("hits") / c("returned")).alias("precision"))


# ---- validation ---------------------------------------------------------------------------


def _pairs(spark, d):
    m = X.mem_orders(spark, d)
    return validate.overlapping(m, m)


def _things(spark, d):
    """Entities of which names are customers': every third customer twice."""
    n = X.read(spark, d, "customer").select(c("c_custkey").alias("id"), F.expr("replace(c_name, '#', '')").alias("name"))
    return n.union(n.filter("id % 3 = 0"))


@query
def validate_overlap(spark, d):
    return _pairs(spark, d).select("a", "b", six(c("who_overlap")).alias("who_overlap"), six(c("what_overlap")).alias("what_overlap"), "opposed")


@query
def validate_ambiguity(spark, d):
    return validate.ambiguous(X.mem_orders(spark, d), _things(spark, d))


@query
def validate_redundancy(spark, d):
    return validate.judged(_pairs(spark, d)).filter("similar_id is not null").select("id", "similar_id", six(c("similarity")).alias("similarity"))


@query
def validate_contradiction(spark, d):
    return validate.judged(_pairs(spark, d)).filter("conflict_id is not null").select("id", "conflict_id")


def _judged(spark, d, policy):
    m = X.mem_orders(spark, d)
    return validate.validate(m, m, _things(spark, d), policy)


@query
def validate_embedding(spark, d):
    """Conflicts by vectors: contents that a table of vectors, taken as the model, holds for opposite."""
    m = X.mem_orders(spark, d)
    model = X.read(spark, d, "embeddings").select(c("vec_id").alias("n"), c("embedding").cast("array<double>").alias("vector"))
    vectors = m.select("id", (F.length("what") * 7).cast("long").alias("n")).join(model, "n").select("id", "vector")
    return validate.validate(m, m, _things(spark, d), "BLOCK", vectors).filter("level = 'embedding'").select("id", "status", "conflict_id")


@query
def recall_metrics(spark, d):
    return recall.metrics(_asked(spark, d), X.mem_orders(spark, d))


@query
def validate_status(spark, d):
    return _judged(spark, d, "WARN")


@query
def validator_stats(spark, d):
    return validate.validator_stats(_judged(spark, d, "BLOCK"))


@query
def confusion_counts(spark, d):
    """A write should be stopped if the customer has an earlier order of the opposite wording."""
    got = _judged(spark, d, "BLOCK").withColumn("stopped", c("status") == "BLOCKED")
    truth = X.mem_orders(spark, d).select("id", c("what").startswith("order not").alias("wanted"))
    j = got.join(truth, "id")
    return j.agg(F.count_if(c("stopped") & c("wanted")).alias("tp"), F.count_if(c("stopped") & ~c("wanted")).alias("fp"), F.count_if(~c("stopped") & c("wanted")).alias("fn"), F.count_if(~c("stopped") & ~c("wanted")).alias("tn"))


@query
def accept_in_order(spark, d):
    return validate.accept_in_order(X.mem_orders(spark, d))


# ---- evaluation ---------------------------------------------------------------------------


def _scenarios(spark, d):
    """A scenario for each nation: its customers' orders, a question about each customer, and a write about each, every second one a denial."""
    memories = X.mem_orders(spark, d).withColumn("namespace", c("place"))
    customers = X.read(spark, d, "customer").join(F.broadcast(X.read(spark, d, "nation")), F.expr("c_nationkey = n_nationkey")).select(c("c_custkey").alias("query_id"), c("n_name").alias("namespace"), F.expr("array(replace(c_name, '#', ''))").alias("relevant_who"))
    questions = X.questions(spark, d).join(customers, "query_id")
    denial = c("query_id") % 2 == 0
    what = F.when(denial, "order not finished priority 1-urgent").otherwise("order finished priority 1-urgent")
    candidates = customers.select("namespace", c("query_id").alias("id"), c("query_id").alias("seq"), c("relevant_who").alias("who"), what.alias("what"), c("namespace").alias("place"), F.lit(None).cast("timestamp_ntz").alias("when_ts"), denial.alias("should_block"))
    return memories, questions, candidates


@query
def evaluate_questions(spark, d):
    memories, questions, _ = _scenarios(spark, d)
    return evaluate.by_question(memories, questions).select("namespace", "query_id", "base_tokens", "tokens", six(c("base_precision")).alias("base_precision"), six(c("precision")).alias("precision"))


def _summaries(spark, d):
    memories, questions, candidates = _scenarios(spark, d)
    return evaluate.by_scenario(evaluate.by_question(memories, questions), evaluate.detections(memories, candidates))


@query
def evaluate_scenarios(spark, d):
    return _summaries(spark, d)


@query
def evaluate_overall(spark, d):
    return evaluate.overall(_summaries(spark, d))


# ---- forgetting ---------------------------------------------------------------------------


@query
def effective_stability(spark, d):
    return X.mem_orders(spark, d).select("id", six(D.stability()).alias("stability"))


@query
def retrievability(spark, d):
    return X.mem_orders(spark, d).select("id", six(D.retrievability(X.AS_OF)).alias("retrievability"))


@query
def decay_status(spark, d):
    return X.mem_orders(spark, d).groupBy(D.status(D.retrievability(X.AS_OF)).alias("status")).agg(F.count("*").alias("n"))


@query
def noise_score(spark, d):
    return X.mem_orders(spark, d).select("id", six(D.noise()).alias("noise"))


@query
def redundancy_score(spark, d):
    return dream.similar_counts(X.mem_docs(spark, d)).select("id", c("similar").alias("n_similar"), D.redundancy(c("similar")).alias("redundancy"))


@query
def obsolescence_score(spark, d):
    return X.mem_orders(spark, d).select("id", six(D.obsolescence(X.AS_OF, D.retrievability(X.AS_OF))).alias("obsolescence"))


@query
def forget_signal(spark, d):
    return dream.forget_signal(X.mem_orders(spark, d), X.AS_OF).select("id", six(c("forget_signal")).alias("forget_signal"))


@query
def forget_split(spark, d):
    return dream.forget_signal(X.mem_orders(spark, d), X.AS_OF).groupBy("forget").agg(F.count("*").alias("n"))


@query
def accelerate_decay(spark, d):
    return dream.accelerate(X.mem_orders(spark, d)).select("id", "importance")


@query
def dream_cleanup(spark, d):
    return dream.cleanup(X.mem_orders(spark, d), X.AS_OF).select("id")


@query
def dream_consolidate(spark, d):
    return dream.consolidate(X.mem_orders(spark, d))


@query
def dream_replay(spark, d):
    return dream.replay(X.mem_orders(spark, d), REPLAYED).select("id", "importance")


@query
def dream_cycle(spark, d):
    return dream.cycle(X.mem_orders(spark, d), X.AS_OF)


@query
def dream_memories(spark, d):
    """The memories after a whole cycle: forgotten ones gone, near-copies merged, the most important touched."""
    got = dream.run_cycle(X.mem_orders(spark, d), X.AS_OF).memories
    return got.select("id", six(c("importance")).alias("importance"), "access_count", "last_accessed", "consolidated_into")


# ---- vectors and access -------------------------------------------------------------------


def _nearest(spark, d, k):
    v = X.read(spark, d, "embeddings").select("vec_id", "embedding")
    return vector.top_k(v, v.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), k)


@query
def cosine_topk(spark, d):
    return _nearest(spark, d, 5).select("query_id", "rank", "vec_id", six(c("sim")).alias("sim"))


@query
def nearest_inherit(spark, d):
    m = X.read(spark, d, "documents").join(X.read(spark, d, "labels"), "doc_id", "left").selectExpr("doc_id AS id", "source AS place", "lang", "CASE quality WHEN 1 THEN 0.8D WHEN 0 THEN 0.2D ELSE 0.5D END AS importance")
    return vector.inherit(_nearest(spark, d, 1), m).select("query_id", "vec_id", "place", "lang", six(c("importance")).alias("importance"))


@query
def access_log(spark, d):
    return X.read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("access_count"), F.max("ts").alias("last_accessed"))


FADED = 0.3


@query
def access_stream(spark, d):
    """A memory for each user and day, written at its first event and touched by each, kept by a stream that deletes what fades."""
    event = X.read(spark, d, "events").select((c("user_id") * 100 + F.dayofmonth("ts")).alias("id"), "ts")
    made = event.groupBy("id").agg(F.min("ts").alias("created_at")).selectExpr("id", "created_at", "created_at AS when_ts", "0.5D AS importance", "0 AS access_count", "CAST(NULL AS timestamp_ntz) AS last_accessed", "id % 3 = 0 AS is_summary", "CAST(array() AS array<string>) AS consolidated_from")
    touch = event.select("id", F.lit("touch").alias("kind"), c("ts").cast("timestamp").alias("at"))
    folder = f"{shared.ensure_checkpoint_dir(spark).rstrip('/')}/access-{uuid.uuid4().hex}"
    access_state.writes(made).unionByName(touch, allowMissingColumns=True).write.parquet(f"{folder}/updates")
    updates = spark.readStream.schema(access_state.UPDATE).parquet(f"{folder}/updates")
    access_state.keep_access(updates, f"{folder}/table", f"{folder}/checkpoint", FADED).awaitTermination()
    return access_state.current(spark, f"{folder}/table").select("id", "access_count", c("last_accessed").cast("timestamp_ntz").alias("last_accessed"), "deleted")
