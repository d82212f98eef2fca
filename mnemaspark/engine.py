"""The facade: remember, recall, inspect, about, dream and stats over memory tables."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import similarity as S
from .operators import dream, graph, intent, recall, validate
from .sources.log import Counters, ValidationLog
from .sources.store import inherited, normalised
from .streaming import access_state

BLOCKED_K = 3


@dataclass
class Engine:
    """Memories, entities and relations of one namespace; methods give new engines, none changes tables in place.

    Engines made from one another share their counters and their log.
    """

    memories: DataFrame
    entities: DataFrame
    policy: str = "WARN"
    namespace: str = "default"
    log: ValidationLog | None = None
    counters: Counters = field(default_factory=Counters)

    def remember(self, writes: DataFrame, validated: bool = True, at: str | None = None) -> tuple["Engine", DataFrame]:
        """The engine with the writes that were not blocked, and the result of each write.

        Writes are normalised first, and take from the memory that ``similar_to`` names (a column
        that they may have) what they leave open. Those that can't be memories, for want of
        content or with an importance outside 0 to 1, are REFUSED: neither stored nor counted. The
        writes come after all memories, in order of ``seq``; a blocked one is not compared with.
        Unless ``validated`` all others are stored, with status null, and count as no writes.
        """
        columns = [c for c in writes.columns if c != "similar_to"]
        own = normalised(inherited(writes, self.memories))
        refused = own.filter("not valid").select("id")
        fit = own.filter("valid").select(*columns)
        if validated:
            results, stored = validate.validate_in_order(fit, self.memories, self.entities, self.policy)
            watched, add = self.counters.watch(results, "writes")
            results = watched.checkpoint()
            add()
        else:
            stored = validate.follow(fit, self.memories).checkpoint()
            results = validate.unvalidated(stored)
        if self.log is not None and validated:
            self.log.append(results, uuid.uuid4().hex, at or "1970-01-01 00:00:00")
        no = validate.unvalidated(refused).withColumns({"status": F.lit("REFUSED"), "level": F.lit("schema")})
        return replace(self, memories=self.memories.unionByName(stored)), results.unionByName(no)

    def remember_and_recall(self, writes: DataFrame, max_tokens: int = 200) -> tuple["Engine", DataFrame, DataFrame]:
        """The engine after the writes, their results, and packed beside each write (query_id is its id) what its content recalls then; nothing for a blocked one."""
        after, results = self.remember(writes)
        live = results.filter("status not in ('BLOCKED', 'REFUSED')").select("id")
        asked = writes.join(live, "id", "left_semi").select(F.col("id").alias("query_id"), F.col("what").alias("question"), F.lit("auto").alias("lang"))
        return after, results, after.recall(asked, BLOCKED_K, max_tokens)[0]

    def recall(self, questions: DataFrame, k: int = 5, max_tokens: int = 200) -> tuple[DataFrame, DataFrame]:
        """(query_id, packed, tokens) and the memories recalled. Memories merged away are dropped after the top k."""
        watched, add = self.counters.watch(self._spaced(questions), "recalls")
        asked = intent.with_intent(watched)
        add()
        found = self._found(asked, k)
        return recall.pack(found, asked, max_tokens), found

    def _spaced(self, questions: DataFrame) -> DataFrame:
        """Questions see the engine's namespace, where its memories name theirs."""
        spaced = "namespace" in self.memories.columns and "namespace" not in questions.columns
        return questions.withColumn("namespace", F.lit(self.namespace)) if spaced else questions

    def _found(self, asked: DataFrame, k: int) -> DataFrame:
        live = self.memories.filter("consolidated_into is null").select("id")
        return recall.tiered(asked, self.memories, k).join(live, "id", "left_semi")

    def metrics(self, questions: DataFrame, k: int = 5) -> DataFrame:
        """For each question its kind and language, how many memories came by structure, and how many the fallback added."""
        return recall.metrics(intent.with_intent(self._spaced(questions)), self.memories, k)

    def touched(self, found: DataFrame, at: str) -> "Engine":
        """The engine after a recall at ``at``: the memories returned count an access for each question."""
        return replace(self, memories=access_state.touched(self.memories, access_state.touches(found, at)))

    def inspect(self, questions: DataFrame, k: int = 5) -> DataFrame:
        """What ``recall`` finds, with all columns and the match of each memory with the question's text; nothing is counted or touched."""
        found = self._found(intent.with_intent(self._spaced(questions)), k).select("query_id", "rank", "id")
        rows = found.join(self.memories, "id").join(questions.select("query_id", "question"), "query_id")
        return rows.withColumn("match_score", F.bround(S.matches_text(F.col("question")), 3))

    def about(self, entity: str, limit: int = 20) -> DataFrame:
        return recall.about(self.memories, entity, limit)

    def dream(self, as_of: str, **how) -> tuple["Engine", dream.Cycle]:
        """The engine after a cycle, and what the cycle did; ``how`` as in ``dream.run_cycle``."""
        cycle = dream.run_cycle(self.memories, as_of, **how)
        return replace(self, memories=cycle.memories), cycle

    def stats(self, **more: DataFrame) -> DataFrame:
        """(name, value): rows of each table, counters and policy."""
        tables = graph.stats(memories=self.memories, entities=self.entities, **more).select(F.col("table_name").alias("name"), F.col("rows").cast("string").alias("value"))
        rest = [*((k, str(v)) for k, v in vars(self.counters).items()), ("validator_policy", self.policy), ("namespace", self.namespace)]
        return tables.union(self.memories.sparkSession.createDataFrame(rest, "name string, value string"))
