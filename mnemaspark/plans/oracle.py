"""The same queries as SQL for DuckDB, over the same tables and with the same column names."""

from __future__ import annotations

from .. import lexicon as L
from ..functions.decay import FORGOTTEN
from ..operators.dream import REPLAY
from ..operators.intent import groups
from ..sources.fixtures import AS_OF, TEMPLATES
from .queries import FADED, NATION, NEEDLE, QUESTION, REPLAYED

SQL: dict[str, str] = {}


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def array(values) -> str:
    return "[" + ", ".join(map(text, values)) + "]"


RUNS = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+')"


def f1(x):
    return f"list_distinct(list_filter({RUNS.format(f'lower({x})')}, lambda t: length(t) > 2 AND NOT list_contains({array(L.STOPWORDS)}, t)))"


def f2(x):
    return f"list_distinct(list_filter({RUNS.format(f'lower({x})')}, lambda t: length(t) > 1))"


def f3(x):
    return rf"list_distinct(list_filter(regexp_split_to_array(lower({x}), '\s+'), lambda t: t <> ''))"


def negated(x):
    return f"len(list_intersect({f3(x)}, {array(L.NEGATIONS)})) > 0"


def joined(x):
    return f"array_to_string(list_sort({x}), ' ')"


def who(x):
    return f"list_distinct(list_filter({RUNS.format(x)}, lambda t: regexp_matches(t, {text(L.NAME_PATTERN)}) AND NOT list_contains({array(L.NOT_NAMES)}, lower(t))))"


def place(x):
    return f"coalesce(list_filter({RUNS.format(f'lower({x})')}, lambda t: list_contains({array(L.PLACE_WORDS)}, t))[1], 'default')"


def first(x, pattern):
    return rf"nullif(regexp_extract({x}, '(?:^|[^\p{{L}}\p{{N}}_])({pattern})(?:[^\p{{L}}\p{{N}}_]|$)', 1), '')"


def when(x):
    days, week = "(?i:" + "|".join(L.DAY_WORDS) + ")", "(?i:" + "|".join(L.WEEKDAYS) + ")(?:(?i:-feira))?"
    return f"coalesce({first(x, days)}, {first(x, week)}, {first(x, r'\d{1,2}/\d{1,2}(?:/\d{2,4})?')}, {first(x, r'\d{4}-\d{2}-\d{2}')}, '')"


def jaccard(a, b):
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"


def lang(x):
    toks = f3(f"translate(lower({x}), '¿¡!?.,;:', '        ')")
    pt, en, es = (f"len(list_intersect({toks}, {array(L.LANGUAGE_WORDS[k])}))" for k in ("pt", "en", "es"))
    return f"CASE WHEN {en} > {pt} AND {en} > {es} THEN 'en' WHEN {es} > {pt} AND {es} > {en} THEN 'es' WHEN {pt} > 0 THEN 'pt' ELSE 'unknown' END"


MEM = """mem AS (
  SELECT o_orderkey AS id, o_orderkey AS seq, [replace(c_name, '#', '')] AS who,
    CASE o_orderstatus WHEN 'F' THEN 'order finished' WHEN 'O' THEN 'order still open' ELSE 'order not finished' END || ' priority ' || lower(o_orderpriority) AS what,
    CASE WHEN o_totalprice > 300000 THEN 'large value' ELSE '' END AS why, o_orderdate AS when_ts, n_name AS place, '' AS how,
    least(1.0::DOUBLE, o_totalprice / 500000.0::DOUBLE) AS importance, (o_orderkey % 7)::INT AS access_count,
    CASE WHEN o_orderkey % 7 > 0 THEN o_orderdate + to_days((o_orderkey % 50)::INT) END AS last_accessed,
    o_orderkey % 11 = 0 AS is_summary, o_orderkey % 13 = 0 AS has_parts
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
REL = """rel AS (
  SELECT o_custkey AS from_id, 'prefers' AS relation_type, l_partkey AS to_id, CASE l_returnflag WHEN 'R' THEN -1.0 WHEN 'A' THEN 0.0 ELSE 1.0 END::DOUBLE AS polarity,
    l_orderkey AS order_id, l_linenumber AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
ASKED = f"""asked AS (
  SELECT c_custkey AS query_id, replace({array(t for _, t in TEMPLATES)}[c_custkey % {len(TEMPLATES)} + 1], '{{}}', replace(c_name, '#', '')) AS question,
    {array(code for code, _ in TEMPLATES)}[c_custkey % {len(TEMPLATES)} + 1] AS said FROM customer)"""


def intents(code: str) -> str:
    """CTEs asked, parsed (query_id, question, lang, who, what, place, query_type, confidence)."""
    patterns = [(k, L.unicode_words(p), kind, groups(p)) for k in ("en", "es", "pt") for p, kind in L.QUESTIONS[k]]
    at = " ".join(f"WHEN lang = '{k}' AND regexp_matches(q, {text(p)}) THEN {i}" for i, (k, p, _, _) in enumerate(patterns))
    one = " ".join(f"WHEN {i} THEN trim(regexp_extract(q, {text(p)}, 1))" for i, (_, p, _, n) in enumerate(patterns) if n)
    two = " ".join(f"WHEN {i} THEN trim(regexp_extract(q, {text(p)}, 2))" for i, (_, p, _, n) in enumerate(patterns) if n > 1)
    kinds, n = array(k for _, _, k, _ in patterns), "[" + ", ".join(str(g) for _, _, _, g in patterns) + "]"
    sure = "([" + ", ".join(str(L.CONFIDENCE[k]) for _, _, k, _ in patterns) + "]::DOUBLE[])"
    used = f"CASE WHEN said = 'auto' THEN {lang('question')} ELSE said END" if code == "auto" else f"'{code}'"
    return f"""{ASKED}, spoken AS (SELECT query_id, question, {used} AS lang FROM asked),
    tried AS (SELECT *, trim(lower(question)) AS q, CASE WHEN lang IN ('en', 'es') THEN lang ELSE 'pt' END AS grammar FROM spoken),
    found AS (SELECT *, CASE {at.replace('lang =', 'grammar =')} END AS nth FROM tried),
    slots AS (SELECT *, {kinds}[nth + 1] AS kind, {n}[nth + 1] AS n, coalesce(CASE nth {one} END, '') AS one, coalesce(CASE nth {two} END, '') AS two FROM found),
    parsed AS (SELECT query_id, question, lang,
      CASE WHEN kind IS NULL OR kind = 'temporal' OR (kind = 'location' AND n = 1) THEN '' ELSE one END AS who,
      CASE WHEN kind = 'temporal' THEN one WHEN kind IN ('action', 'location', 'temporal who', 'causal') THEN two ELSE '' END AS what,
      CASE WHEN kind = 'location' AND n = 1 THEN one ELSE '' END AS place,
      coalesce(split_part(kind, ' ', 1), 'unknown') AS query_type, coalesce({sure}[nth + 1], 0.0::DOUBLE) AS confidence FROM slots)"""


SURE = "confidence >= 0.5 AND (who <> '' OR what <> '' OR place <> '')"


def recall_ctes(home: bool) -> str:
    """CTEs to ``tiered``; with ``home`` each customer's question sees the memories of its own nation only."""
    own = ("JOIN home ON home.query_id = p.query_id AND home.place = m.place", "JOIN home USING (query_id) JOIN ctok c ON c.place = home.place") if home else ("", "CROSS JOIN ctok c")
    return f"""{intents('auto')}, {MEM}, home AS (SELECT c_custkey AS query_id, n_name AS place FROM customer JOIN nation ON c_nationkey = n_nationkey),
  contents AS (SELECT DISTINCT what, place FROM mem),
  wants AS (SELECT DISTINCT what FROM parsed WHERE {SURE}),
  parts AS (SELECT w.what AS want, m.what AS what, CASE WHEN w.what = '' THEN 0.0 WHEN contains(m.what, w.what) OR contains(w.what, m.what) THEN 0.3
      ELSE 0.3 * len(list_intersect({f3('w.what')}, {f3('m.what')})) / len({f3('w.what')}) END::DOUBLE AS part FROM wants w, (SELECT DISTINCT what FROM contents) m),
  weighed AS (SELECT p.query_id, m.id, m.seq,
      (CASE WHEN p.who <> '' THEN CASE WHEN lower(m.who[1]) = p.who THEN 0.5 ELSE 0.0 END ELSE 0.0 END + part + CASE WHEN p.query_type = 'location' AND m.place NOT IN ('', 'default') THEN 0.1 ELSE 0.0 END)::DOUBLE AS s,
      (CASE WHEN p.who <> '' THEN 0.5 ELSE 0.0 END + CASE WHEN p.what <> '' THEN 0.3 ELSE 0.0 END + CASE WHEN p.query_type = 'location' AND m.place NOT IN ('', 'default') THEN 0.1 ELSE 0.0 END)::DOUBLE AS w
    FROM (SELECT * FROM parsed WHERE {SURE}) p JOIN parts ON parts.want = p.what JOIN mem m ON m.what = parts.what {own[0]}),
  structural AS (SELECT query_id, id, seq, least(1.0, s / w) AS score, row_number() OVER (PARTITION BY query_id ORDER BY least(1.0, s / w) DESC, seq) AS rank FROM weighed WHERE w > 0 AND s / w >= 0.3 QUALIFY rank <= 5),
  qtok AS (SELECT query_id, {f1('question')} AS toks FROM asked),
  ctok AS (SELECT what, place, {f1("what || ' ' || place")} AS toks FROM contents),
  over AS (SELECT query_id, what, c.place AS place, len(list_intersect(q.toks, c.toks)) AS hits, list_filter(q.toks, lambda t: NOT list_contains(c.toks, t)) AS rest, len(q.toks) AS n FROM qtok q {own[1]} WHERE len(q.toks) > 0),
  shared AS (SELECT query_id, id, seq, (hits + CASE WHEN list_contains(rest, lower(m.who[1])) THEN 1 ELSE 0 END)::DOUBLE / n AS score FROM over JOIN mem m USING (what, place)),
  semantic AS (SELECT query_id, id, seq, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq) AS rank FROM shared WHERE score >= 0.3 QUALIFY rank <= 5),
  few AS (SELECT query_id FROM asked LEFT JOIN (SELECT query_id, count(*) AS n FROM structural GROUP BY query_id) USING (query_id) WHERE coalesce(n, 0) < 2),
  tiers AS (SELECT query_id, id, 'structural' AS tier, rank FROM structural UNION ALL
    SELECT s.query_id, s.id, 'semantic', s.rank FROM semantic s JOIN few USING (query_id) WHERE NOT EXISTS (SELECT 1 FROM structural t WHERE t.query_id = s.query_id AND t.id = s.id)),
  tiered AS (SELECT query_id, id, tier, row_number() OVER (PARTITION BY query_id ORDER BY tier DESC, rank) AS rank FROM tiers)"""


RECALL = recall_ctes(home=False)


def packed(tokens: int, home: bool = False) -> str:
    return f"""{recall_ctes(home)}, lines AS (SELECT t.query_id, t.rank, concat_ws(' | ', m.who[1], m.what,
        CASE WHEN p.query_type = 'location' AND m.place NOT IN ('', 'default') THEN '@' || m.place END, CASE WHEN p.query_type = 'causal' AND m.why <> '' THEN '(' || m.why || ')' END) AS line
      FROM tiered t JOIN mem m USING (id) JOIN parsed p USING (query_id)),
    sums AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY query_id ORDER BY rank) AS upto FROM lines),
    cut AS (SELECT *, sum((upto > {4 * tokens})::INT) OVER (PARTITION BY query_id ORDER BY rank) AS overs, {4 * tokens} - (upto - length(line) - 1) AS remaining FROM sums),
    packs AS (SELECT query_id, rtrim(string_agg(CASE WHEN overs = 0 THEN line ELSE substring(line, 1, (remaining - 1)::INT) || '…' END, '' ORDER BY rank)) AS packed
      FROM cut WHERE overs = 0 OR (overs = 1 AND upto > {4 * tokens} AND remaining > 20) GROUP BY query_id)"""


MERGED = "(is_summary OR has_parts)"
STABILITY = f"greatest(0.1, least(365.0, 7.0 * (1 + ln(1 + access_count)) * CASE WHEN importance > 0.7 THEN 1.3 ELSE 1.0 END * CASE WHEN {MERGED} THEN 2.0 ELSE 1.0 END))::DOUBLE"


def days(x):
    return f"((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us({x})) / 86400000000.0::DOUBLE)"


IDLE = "coalesce(last_accessed, when_ts)"
RETRIEVED = f"exp(-greatest(0.0, {days(IDLE)}) / {STABILITY})"
NOISE = f"""least(1.0::DOUBLE, CASE WHEN importance < 0.3 THEN 0.3 WHEN importance < 0.5 THEN 0.1 ELSE 0.0 END::DOUBLE + CASE WHEN len(who) = 0 THEN 0.2 ELSE 0.0 END::DOUBLE
  + CASE WHEN length(what) < 10 THEN 0.2 WHEN length(what) < 30 THEN 0.1 ELSE 0.0 END::DOUBLE + CASE WHEN trim(lower(what)) IN ({', '.join(map(text, L.GENERIC_WHATS))}) THEN 0.2 ELSE 0.0 END::DOUBLE
  + CASE WHEN {MERGED} THEN 0.0 ELSE 0.1 END::DOUBLE)"""
OBSOLETE = f"""least(1.0::DOUBLE, CASE WHEN floor({days('when_ts')}) > 90 AND floor({days(IDLE)}) > 60 THEN 0.4 WHEN floor({days('when_ts')}) > 30 AND floor({days(IDLE)}) > 30 THEN 0.2 ELSE 0.0 END::DOUBLE
  + CASE WHEN {RETRIEVED} < 0.2 THEN 0.4 WHEN {RETRIEVED} < 0.4 THEN 0.2 ELSE 0.0 END::DOUBLE)"""
#: Few contents are distinct, so similar ones are counted by content.
SIGNAL = f"""{MEM}, whats AS (SELECT what, count(*) AS n, list_sort({f3('what')}) AS toks FROM mem GROUP BY what),
  alike AS (SELECT a.what, sum(b.n) - 1 AS alikes FROM whats a, whats b WHERE a.toks = b.toks OR {jaccard('a.toks', 'b.toks')} > 0.7 GROUP BY a.what),
  signals AS (SELECT id, greatest(0.0, least(1.0, 0.4::DOUBLE * {NOISE} + 0.35::DOUBLE * CASE WHEN alikes >= 3 THEN 0.5 WHEN alikes >= 1 THEN 0.2 ELSE 0.0 END::DOUBLE + 0.25::DOUBLE * {OBSOLETE})) AS s FROM mem JOIN alike USING (what))"""
OVERLAP = f"""{MEM}, prep AS (SELECT id, seq, what, when_ts, who[1] AS w, place, {f2('what')} AS toks, ({negated('what')}) OR ({negated('why')}) AS neg FROM mem),
  pairs AS (SELECT a.id AS a, b.id AS b, b.seq AS sb, 1.0::DOUBLE AS who_overlap, {jaccard('a.toks', 'b.toks')} AS what_overlap, a.neg <> b.neg AS opposed
    FROM prep a JOIN prep b ON a.place = b.place AND a.w = b.w AND b.seq < a.seq),
  stops AS (SELECT a, min(sb) FILTER (what_overlap >= 0.3 AND opposed) AS stop FROM pairs GROUP BY a),
  judged AS (SELECT a AS id, arg_max(b, struct_pack(o := what_overlap, s := -sb)) FILTER (what_overlap >= 0.85 AND (stop IS NULL OR sb <= stop)) AS similar_id,
      max(what_overlap) FILTER (what_overlap >= 0.85 AND (stop IS NULL OR sb <= stop)) AS similarity, arg_min(b, sb) FILTER (what_overlap >= 0.3 AND opposed) AS conflict_id
    FROM pairs JOIN stops USING (a) GROUP BY a)"""
AMBIGUOUS = "unsure AS (SELECT o_orderkey AS id, 2::BIGINT AS n_candidates FROM orders WHERE o_custkey % 3 = 0 AND o_custkey IN (SELECT c_custkey FROM customer))"


def status(policy):
    return f"""{OVERLAP}, {AMBIGUOUS}, levels AS (SELECT p.id, CASE WHEN trim(p.what) = '' THEN 'schema' WHEN conflict_id IS NOT NULL THEN 'contradiction' WHEN similar_id IS NOT NULL THEN 'redundancy'
        WHEN n_candidates IS NOT NULL THEN 'ambiguity' WHEN year(when_ts) > 2200 THEN 'date' ELSE 'none' END AS level, conflict_id, similar_id FROM prep p LEFT JOIN judged USING (id) LEFT JOIN unsure USING (id)),
      results AS (SELECT id, CASE WHEN level = 'none' THEN 'OK' WHEN level IN ('schema', 'contradiction') AND '{policy}' = 'BLOCK' THEN 'BLOCKED' ELSE 'WARN' END AS status, level, conflict_id, similar_id,
        CASE WHEN level IN ('schema', 'contradiction') AND '{policy}' = 'WARN' THEN 'BLOCKED' END AS downgraded_from FROM levels)"""


def _text_sql():
    for name, f in (("recall", f1), ("validator", f2), ("whitespace", f3)):
        SQL[f"tokenize_{name}"] = f"WITH t AS (SELECT doc_id, {f('text')} AS toks FROM documents) SELECT doc_id, len(toks)::INT AS n_tokens, md5({joined('toks')}) AS tokens_md5 FROM t"
    SQL["has_negation"] = f"SELECT doc_id, {negated('text')} AS negated FROM documents"
    SQL["detect_lang"] = f"SELECT doc_id, {lang('text')} AS lang FROM documents"
    SQL["extract_who"] = f"SELECT conv_id, turn, len({who('text')})::INT AS n_who, {joined(who('text'))} AS who FROM conversations"
    SQL["extract_when"] = f"SELECT doc_id, {when('text')} AS when_text FROM documents"
    SQL["extract_where"] = f"SELECT doc_id, {place('text')} AS place FROM documents"
    SQL["rough_tokens"] = "SELECT doc_id, (length(text) // 4)::INT AS tokens FROM documents"
    SQL["turns_to_memories"] = f"""WITH n AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
      SELECT conv_id, turn, {joined(who('text'))} AS who, md5(text) AS what_md5, {place('text')} AS place, md5(CASE WHEN next_role = 'assistant' THEN next_text ELSE '' END) AS how_md5, 0.6::DOUBLE AS importance FROM n WHERE role = 'user'"""
    q, m = f1(text(QUESTION)), f1("what || ' ' || why || ' ' || how")
    SQL["matches_text"] = f"WITH {MEM}, t AS (SELECT id, {q} AS q, {m} AS m FROM mem) SELECT id, round({jaccard('q', 'm')}, 6) AS score FROM t"
    SQL["memory_to_text"] = f"WITH {MEM} SELECT id, concat_ws(' | ', who[1], what, nullif(why, ''), '@' || place) AS line FROM mem"


def _lookup_sql():
    SQL["get_memory"] = f"WITH {MEM} SELECT id, what, place FROM mem WHERE id = 42"
    SQL["find_memories_who"] = f"WITH {MEM} SELECT id, what, place FROM mem WHERE contains(lower(who[1]), '{NEEDLE}')"
    SQL["find_memories_where_what"] = f"WITH {MEM} SELECT id, what, importance FROM mem WHERE place = '{NATION}' AND contains(what, 'still open')"
    SQL["find_entities_by_name"] = "SELECT p_partkey AS id, p_name AS name FROM part WHERE lower(p_name) = 'small ring'"
    SQL["entity_matches"] = "SELECT p_partkey AS id, p_name AS name FROM part WHERE lower(p_name) = 'brand#2' OR contains(lower(p_brand), 'brand#2') OR contains(lower(p_type), 'brand#2')"
    SQL["find_relations"] = f"WITH {REL} SELECT from_id, to_id, polarity, order_id, line FROM rel WHERE from_id = 7"
    SQL["relation_polarity_bands"] = f"WITH {REL} SELECT CASE WHEN polarity > 0.3 THEN 'positive' WHEN polarity < -0.3 THEN 'negative' ELSE 'neutral' END AS band, count(*) AS n FROM rel GROUP BY 1"
    SQL["relation_contradictions"] = f"""WITH {REL}, g AS (SELECT from_id, relation_type, to_id, count(*) FILTER (polarity > 0) AS pro, count(*) FILTER (polarity < 0) AS contra FROM rel GROUP BY ALL)
      SELECT *, pro * contra AS pairs FROM g WHERE pro > 0 AND contra > 0"""
    SQL["graph_stats"] = f"WITH {MEM}, {REL} SELECT 'memories' AS table_name, count(*) AS rows FROM mem UNION ALL SELECT 'entities', count(*) FROM part UNION ALL SELECT 'relations', count(*) FROM rel"
    SQL["is_consolidated"] = f"WITH {MEM} SELECT id, {MERGED} AS is_consolidated, false AS was_consolidated FROM mem"
    SQL["upsert_latest"] = "SELECT max(event_id) AS event_id, user_id, event_type, arg_max(value, event_id) AS value, min(event_id) AS seq FROM events GROUP BY user_id, event_type"
    SQL["memory_normalize"] = r"""SELECT doc_id, array_to_string(list_sort([lang, trim(source)]), ' ') AS who, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS what_md5, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'default' END AS place,
      regexp_replace(text, '^\s+|\s+$', '', 'g') <> '' AND n_chars / 10000.0::DOUBLE BETWEEN 0 AND 1 AS valid FROM documents"""
    SQL["export_record"] = f"WITH {MEM} SELECT id, who[1] AS who, what, place, round(round_even(importance, 3), 6) AS importance, access_count FROM mem"
    SQL["inherit_similar"] = f"""WITH {MEM}, near AS (SELECT place, arg_min(id, seq) AS ref, arg_min(importance, seq) AS i, arg_min(who[1], seq) AS w FROM mem GROUP BY place)
      SELECT id, ref, CASE WHEN id % 2 = 0 THEN w ELSE who[1] END AS who, place, CASE WHEN id % 5 = 0 OR importance = 0.5 THEN i * 0.8::DOUBLE ELSE importance END AS importance FROM mem JOIN near USING (place)"""
    SQL["memory_documents"] = f"WITH {MEM} SELECT id, who[1] AS who, what, why, when_ts, place, how, importance, access_count, last_accessed, when_ts AS created_at FROM mem"
    SQL["entity_documents"] = "SELECT p_partkey AS id, 'part' AS type, p_name AS name, p_brand || '|' || p_type AS identifiers FROM part"
    SQL["relation_documents"] = f"WITH {REL} SELECT order_id || '/' || line AS id, from_id::VARCHAR AS from_id, relation_type, to_id::VARCHAR AS to_id, 0.5::DOUBLE AS strength, polarity FROM rel"


def _recall_sql():
    for code in ("pt", "en", "es"):
        SQL[f"intent_{code}"] = f"WITH {intents(code)} SELECT query_id, who, what, place, query_type, confidence FROM parsed"
    SQL["intent_auto"] = f"WITH {intents('auto')} SELECT query_id, lang, query_type, {SURE} AS is_structured FROM parsed"
    for tier in ("structural", "semantic"):
        SQL[f"recall_{tier}"] = f"WITH {RECALL} SELECT query_id, rank::INT AS rank, id, round(score, 6) AS score FROM {tier}"
    SQL["intent_documents"] = f"WITH {intents('auto')} SELECT query_id, who, what, place, query_type, confidence, question AS raw_query, lang FROM parsed"
    SQL["recall_metrics"] = f"""WITH {RECALL} SELECT query_id, query_type, confidence, lang, CASE WHEN {SURE} THEN coalesce(n, 0) END AS structural_match_count, CASE WHEN coalesce(n, 0) < 2 THEN coalesce(f, 0) END AS semantic_fallback_count
      FROM parsed LEFT JOIN (SELECT query_id, count(*) AS n FROM structural GROUP BY query_id) USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS f FROM semantic GROUP BY query_id) USING (query_id)"""
    SQL["recall_tiered"] = f"WITH {RECALL} SELECT query_id, rank::INT AS rank, tier, id FROM tiered"
    SQL["recall_packed"] = f"WITH {packed(30)} SELECT query_id, packed, (length(packed) // 4)::INT AS tokens FROM packs"
    qt, mt = f1("question"), f1("m.what || ' ' || m.why")
    SQL["inspect"] = f"""WITH {RECALL}, j AS (SELECT t.query_id, t.rank, t.id, round_even(m.importance, 3) AS importance, {qt} AS q, {mt} AS mt FROM tiered t JOIN mem m USING (id) JOIN asked USING (query_id))
      SELECT query_id, rank::INT AS rank, id, importance, round({jaccard('q', 'mt')}, 6) AS match_score FROM j"""
    SQL["about_entity"] = f"WITH {MEM} SELECT id, what, importance FROM mem WHERE contains(lower(who[1]), '{NEEDLE}') ORDER BY importance DESC, when_ts DESC, seq LIMIT 20"
    SQL["eval_tokens"] = f"""WITH {packed(200)} SELECT count(*) AS answered, sum(length(packed) // 4)::BIGINT AS packed_tokens,
      (SELECT sum(length('[' || who[1] || '] ' || what || ' @ ' || place) + 1) // 4 FROM mem)::BIGINT AS baseline_tokens FROM packs"""
    SQL["precision_at_k"] = f"""WITH {RECALL} SELECT query_id, round(sum(CASE WHEN lower(m.who[1]) = 'customer' || lpad(query_id::VARCHAR, 9, '0') THEN 1.0 ELSE 0.0 END)::DOUBLE / count(*), 6) AS precision
      FROM tiered JOIN mem m USING (id) WHERE rank <= 5 GROUP BY query_id"""


def _validate_sql():
    SQL["validate_overlap"] = f"WITH {OVERLAP} SELECT a, b, who_overlap, round(what_overlap, 6) AS what_overlap, opposed FROM pairs"
    SQL["validate_ambiguity"] = f"WITH {AMBIGUOUS} SELECT * FROM unsure"
    SQL["validate_redundancy"] = f"WITH {OVERLAP} SELECT id, similar_id, round(similarity, 6) AS similarity FROM judged WHERE similar_id IS NOT NULL"
    SQL["validate_contradiction"] = f"WITH {OVERLAP} SELECT id, conflict_id FROM judged WHERE conflict_id IS NOT NULL"
    SQL["validate_status"] = f"WITH {status('WARN')} SELECT id, status, level, conflict_id, similar_id, downgraded_from FROM results"
    SQL["validator_stats"] = f"WITH {status('BLOCK')} SELECT count(*) AS total, count(*) FILTER (status = 'OK') AS ok, count(*) FILTER (status = 'WARN') AS warn, count(*) FILTER (status = 'BLOCKED') AS blocked FROM results"
    SQL["confusion_counts"] = f"""WITH {status('BLOCK')}, j AS (SELECT status = 'BLOCKED' AS s, starts_with(what, 'order not') AS w FROM results JOIN mem USING (id))
      SELECT count(*) FILTER (s AND w) AS tp, count(*) FILTER (s AND NOT w) AS fp, count(*) FILTER (NOT s AND w) AS fn, count(*) FILTER (NOT s AND NOT w) AS tn FROM j"""
    SQL["validate_embedding"] = f"""WITH {OVERLAP}, model AS (SELECT m.id, embedding::DOUBLE[] AS v FROM mem m JOIN embeddings ON vec_id = length(what) * 7),
      firsts AS (SELECT a AS id, arg_min({{'b': b, 'opposed': opposed}}, sb) AS c FROM pairs JOIN model x ON x.id = a JOIN model y ON y.id = b WHERE what_overlap >= 0.3 AND (opposed OR list_cosine_similarity(x.v, y.v) < 0.4) GROUP BY a)
      SELECT id, 'BLOCKED' AS status, c.b AS conflict_id FROM firsts WHERE NOT c.opposed"""
    against = f"l.neg <> b.neg AND {jaccard('l.toks', 'b.toks')} >= 0.3"
    SQL["accept_in_order"] = f"""WITH RECURSIVE {MEM}, b AS MATERIALIZED (SELECT id, place, who[1] AS w, {f2('what')} AS toks, ({negated('what')}) OR ({negated('why')}) AS neg, row_number() OVER (PARTITION BY place, who[1] ORDER BY seq) AS i FROM mem),
      acc(place, w, i, kept, id, accepted) AS (SELECT place, w, i, [{{'toks': toks, 'neg': neg}}], id, true FROM b WHERE i = 1 UNION ALL
        SELECT place, w, i, CASE WHEN ok THEN list_append(kept, {{'toks': toks, 'neg': neg}}) ELSE kept END, id, ok FROM
          (SELECT b.*, kept, len(list_filter(kept, lambda l: {against})) = 0 AS ok FROM acc JOIN b ON b.place = acc.place AND b.w = acc.w AND b.i = acc.i + 1))
      SELECT id, accepted FROM acc"""


def exactly(x: str, places: int) -> str:
    """Rounding by the exact binary value, ties to even."""
    n, unit = f"((({x}) - floor({x})) * {1 << 60}::DOUBLE)::HUGEINT * {10**places}", 1 << 60
    up = f"CASE WHEN {n} % {unit} > {unit // 2} OR ({n} % {unit} = {unit // 2} AND ({n} // {unit}) % 2 = 1) THEN 1 ELSE 0 END"
    return f"(floor({x})::HUGEINT * {10**places} + {n} // {unit} + {up})::DOUBLE / {10**places}"


def _evaluate_sql():
    each = f"""{packed(200, home=True)}, cust AS (SELECT c_custkey AS query_id, n_name AS namespace, replace(c_name, '#', '') AS name FROM customer JOIN nation ON c_nationkey = n_nationkey),
      base AS (SELECT place AS namespace, count(*) AS n_memories, (sum(length('[' || who[1] || '] ' || what || ' @ ' || place)) + count(*) - 1)::BIGINT // 4 AS base_tokens FROM mem GROUP BY place),
      hits AS (SELECT query_id, avg((m.who[1] = c.name)::INT) AS precision FROM tiered JOIN mem m USING (id) JOIN cust c USING (query_id) WHERE rank <= 5 GROUP BY query_id),
      owned AS (SELECT query_id, count(m.id) AS relevant FROM cust JOIN mem m ON m.who[1] = name AND m.place = namespace GROUP BY query_id),
      evaluated AS (SELECT namespace, query_id, n_memories, base_tokens, coalesce(length(packed) // 4, 0)::BIGINT AS tokens, coalesce(relevant, 0)::DOUBLE / least(5, n_memories) AS base_precision, coalesce(precision, 0.0) AS precision
        FROM cust JOIN base USING (namespace) LEFT JOIN packs USING (query_id) LEFT JOIN hits USING (query_id) LEFT JOIN owned USING (query_id))"""
    SQL["evaluate_questions"] = f"WITH {each} SELECT namespace, query_id, base_tokens, tokens, round(base_precision, 6) AS base_precision, round(precision, 6) AS precision FROM evaluated"
    toks, neg = f2("what"), negated("what")
    summed = f"""{each}, writes AS (SELECT query_id AS cid, namespace, name, query_id % 2 = 0 AS wanted, CASE WHEN query_id % 2 = 0 THEN 'order not finished priority 1-urgent' ELSE 'order finished priority 1-urgent' END AS what FROM cust),
      known AS (SELECT what, {toks} AS toks, {neg} AS neg FROM (SELECT DISTINCT what FROM mem)), said AS (SELECT what, {toks} AS toks, {neg} AS neg FROM (SELECT DISTINCT what FROM writes)),
      like_ AS (SELECT s.what AS w, k.what AS m, {jaccard('s.toks', 'k.toks')} AS o, s.neg <> k.neg AS opposed FROM said s, known k),
      caught AS (SELECT DISTINCT cid FROM writes w JOIN mem m ON m.who[1] = w.name AND m.place = w.namespace JOIN like_ ON like_.w = w.what AND like_.m = m.what WHERE o >= 0.85 OR (o >= 0.3 AND opposed)),
      labelled AS (SELECT namespace, wanted, cid IN (SELECT cid FROM caught) AS got FROM writes),
      counts AS (SELECT namespace, count(*) FILTER (wanted AND got) AS tp, count(*) FILTER (wanted AND NOT got) AS fn, count(*) FILTER (NOT wanted AND got) AS fp, count(*) FILTER (NOT wanted AND NOT got) AS tn FROM labelled GROUP BY namespace),
      summed AS (SELECT namespace, any_value(n_memories) AS n_memories, count(*) AS n_queries, sum(base_tokens)::BIGINT AS base_tokens, sum(tokens)::BIGINT AS tokens, {exactly('avg(base_precision)', 3)} AS base_precision, {exactly('avg(precision)', 3)} AS precision FROM evaluated GROUP BY namespace),
      summaries AS (SELECT *, {exactly('(base_tokens - tokens) / base_tokens * 100', 1)} AS savings_pct, {exactly('tp / greatest(1, tp + fn) * 100', 1)} AS detection_pct FROM summed JOIN counts USING (namespace))"""
    SQL["evaluate_scenarios"] = f"WITH {summed} SELECT * FROM summaries"
    SQL["evaluate_overall"] = f"WITH {summed} SELECT count(*) AS n_scenarios, {exactly('avg(savings_pct)', 1)} AS savings_pct, {exactly('avg(base_precision)', 3)} AS base_precision, {exactly('avg(precision)', 3)} AS precision, {exactly('avg(detection_pct)', 1)} AS detection_pct FROM summaries"


def _decay_sql():
    SQL["effective_stability"] = f"WITH {MEM} SELECT id, round({STABILITY}, 6) AS stability FROM mem"
    SQL["retrievability"] = f"WITH {MEM} SELECT id, round({RETRIEVED}, 6) AS retrievability FROM mem"
    SQL["decay_status"] = f"WITH {MEM}, r AS (SELECT {RETRIEVED} AS r FROM mem) SELECT CASE WHEN r >= 0.7 THEN 'active' WHEN r >= 0.3 THEN 'fading' WHEN r >= 0.1 THEN 'weak' ELSE 'forgotten' END AS status, count(*) AS n FROM r GROUP BY 1"
    SQL["noise_score"] = f"WITH {MEM} SELECT id, round({NOISE}, 6) AS noise FROM mem"
    SQL["obsolescence_score"] = f"WITH {MEM} SELECT id, round({OBSOLETE}, 6) AS obsolescence FROM mem"
    SQL["redundancy_score"] = f"""WITH own AS (SELECT doc_id AS id, list_sort({f3('text')}) AS toks FROM documents),
      sets AS (SELECT toks, min(id) AS k, count(*) AS copies FROM own GROUP BY toks), single AS (SELECT k, unnest(toks) AS tok FROM sets), freq AS (SELECT tok, count(*) AS df FROM single GROUP BY tok),
      placed AS (SELECT k, tok, row_number() OVER (PARTITION BY k ORDER BY df, tok) AS i, count(*) OVER (PARTITION BY k) AS n FROM single JOIN freq USING (tok)),
      prefix AS (SELECT * FROM placed WHERE i <= n - ceil(0.7 * n - 1e-9) + 1),
      cand AS (SELECT DISTINCT a.k AS a, b.k AS b FROM prefix a JOIN prefix b ON a.tok = b.tok AND a.k <> b.k AND least(a.n, b.n) >= 0.7 * greatest(a.n, b.n) - 1e-9),
      near AS (SELECT a, sum(y.copies) AS others FROM cand JOIN sets x ON x.k = a JOIN sets y ON y.k = b WHERE {jaccard('x.toks', 'y.toks')} > 0.7 GROUP BY a),
      counted AS (SELECT toks, (coalesce(others, 0) + copies - 1)::BIGINT AS alikes FROM sets LEFT JOIN near ON a = k)
      SELECT id, CASE WHEN len(toks) = 0 THEN 0 ELSE alikes END AS n_similar, CASE WHEN len(toks) = 0 THEN 0.0 WHEN alikes >= 3 THEN 0.5 WHEN alikes >= 1 THEN 0.2 ELSE 0.0 END::DOUBLE AS redundancy FROM own JOIN counted USING (toks)"""
    SQL["forget_signal"] = f"WITH {SIGNAL} SELECT id, round(s, 6) AS forget_signal FROM signals"
    SQL["forget_split"] = f"WITH {SIGNAL} SELECT s >= 0.3 AS forget, count(*) AS n FROM signals GROUP BY 1"
    SQL["accelerate_decay"] = f"WITH {MEM} SELECT id, importance * 0.5::DOUBLE AS importance FROM mem"
    SQL["dream_cleanup"] = f"WITH {MEM} SELECT id FROM mem WHERE {RETRIEVED} >= {FORGOTTEN}"
    SQL["dream_replay"] = f"WITH {MEM} SELECT id, importance FROM mem ORDER BY importance DESC, seq LIMIT {REPLAYED}"


def merging(rows: str) -> str:
    """CTEs mem, merged (id, leader, best) of ``rows`` by greedy leaders, a memory at a time, and clusters of two or more only."""
    alike = "len(list_intersect(l.toks, b.toks)) >= 0.85 * (len(l.toks) + len(b.toks) - len(list_intersect(l.toks, b.toks)))"
    return f"""{MEM}, kept AS MATERIALIZED ({rows}),
      b AS MATERIALIZED (SELECT id, seq, place, who[1] AS w, length(what) AS size, {f3('what')} AS toks, row_number() OVER (PARTITION BY place, who[1] ORDER BY seq) AS i FROM kept),
      led(place, w, i, leaders, id, leader) AS (SELECT place, w, i, [{{'id': id, 'toks': toks}}], id, id FROM b WHERE i = 1 UNION ALL
        SELECT place, w, i, CASE WHEN hit IS NULL THEN list_append(leaders, {{'id': id, 'toks': toks}}) ELSE leaders END, id, coalesce(hit, id) FROM
          (SELECT b.*, leaders, list_filter(leaders, lambda l: {alike})[1].id AS hit FROM led JOIN b ON b.place = led.place AND b.w = led.w AND b.i = led.i + 1)),
      best AS (SELECT leader, list(led.id ORDER BY size DESC, seq)[1] AS best FROM led JOIN b ON b.id = led.id GROUP BY leader HAVING count(*) > 1),
      merged AS (SELECT id, best FROM led JOIN best USING (leader))"""


def _dream_sql():
    SQL["dream_consolidate"] = f"WITH RECURSIVE {merging('SELECT * FROM mem')} SELECT id, best AS consolidated_into FROM merged WHERE id <> best"
    cycle = f"""{merging(f'SELECT * FROM mem WHERE {RETRIEVED} >= {FORGOTTEN}')},
      after AS (SELECT k.id, k.seq, CASE WHEN k.id = m.best THEN least(1.0, k.importance + 0.05::DOUBLE) ELSE k.importance END AS importance, k.access_count, k.last_accessed, CASE WHEN k.id <> m.best THEN m.best END AS consolidated_into FROM kept k LEFT JOIN merged m USING (id)),
      again AS (SELECT id FROM after WHERE consolidated_into IS NULL ORDER BY importance DESC, seq LIMIT {REPLAY})"""
    SQL["dream_cycle"] = f"WITH RECURSIVE {cycle} SELECT (SELECT count(*) FROM mem) - (SELECT count(*) FROM kept) AS n_cleaned, (SELECT count(*) FROM merged WHERE id <> best) AS n_consolidated, (SELECT count(*) FROM again) AS n_replayed"
    SQL["dream_memories"] = f"""WITH RECURSIVE {cycle} SELECT a.id, round(importance, 6) AS importance, (access_count + CASE WHEN g.id IS NULL THEN 0 ELSE 1 END)::INT AS access_count,
      CASE WHEN g.id IS NULL THEN last_accessed ELSE TIMESTAMP '{AS_OF}' END AS last_accessed, consolidated_into FROM after a LEFT JOIN again g ON g.id = a.id"""


def _vector_sql():
    near = """sims AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM sims WHERE sim >= 0.3)"""
    SQL["cosine_topk"] = f"WITH {near} SELECT query_id, rank::INT AS rank, vec_id, round(sim, 6) AS sim FROM ranked WHERE rank <= 5"
    SQL["nearest_inherit"] = f"""WITH {near} SELECT query_id, vec_id, source AS place, lang, round(CASE quality WHEN 1 THEN 0.8 WHEN 0 THEN 0.2 ELSE 0.5 END::DOUBLE * 0.8::DOUBLE, 6) AS importance
      FROM ranked JOIN documents ON doc_id = vec_id LEFT JOIN labels USING (doc_id) WHERE rank = 1"""
    SQL["access_stream"] = f"""WITH e AS (SELECT user_id * 100 + day(ts) AS id, ts FROM events), w AS (SELECT date_trunc('milliseconds', max(ts)) AS now FROM events), g AS (SELECT id, count(*) AS n, max(ts) AS l FROM e GROUP BY id)
      SELECT id, n AS access_count, l AS last_accessed, exp(-((epoch_us(now) - epoch_us(l)) / 86400000000.0) / least(365.0, 7.0 * (1 + ln(1.0 + n)) * CASE WHEN id % 3 = 0 THEN 2.0 ELSE 1.0 END)) < {FADED} AS deleted FROM g, w"""
    SQL["access_log"] = "SELECT user_id, event_type, count(*) AS access_count, max(ts) AS last_accessed FROM events GROUP BY user_id, event_type"


for _part in (_text_sql, _lookup_sql, _recall_sql, _validate_sql, _evaluate_sql, _decay_sql, _dream_sql, _vector_sql):
    _part()
