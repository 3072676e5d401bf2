"""The reference queries: every operator over the documents table as manuscripts, with DuckDB SQL for each where SQL can say it.

Project = source, path = zero-padded id, chapters by a pack of its own.
"""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import checks, detectors, mentions, metrics, search, story, versions
from .packs import LATIN, ZH, Profile
from .plans import analysis, deltas
from .sources import manuscripts as ms
from .stored import stored, temporary
from .streaming import changes

#: The pack of these queries: the tables hold invented prose, so its lexicons are pieces of words that are frequent, or rare, in it.
P = replace(
    LATIN,
    heading=r"^\w+(\s\w+)?\.$",
    delimiters="[.!?\n]",
    person_patterns=(r"([A-ZÀ-Þ][a-zà-ÿ]+) (?:and|the|of|de|der|que|la|en|die) ", r" (?:to|with|of|von|para|pour) ([a-zà-ÿ]{4,9}) "),
    place_pattern=r" (?:in|dans|en|im) ([a-zà-ÿ]{3,9}) ",
    item_patterns=(r"(other|thing|anti)", r" (?:the|la|das) ([a-zà-ÿ]{3,8})"),
    item_prefixes=("the", "un"),
    stopwords=("that", "this", "with", "from", "The", "And"),
    bad_prefixes=("th",),
    bad_suffixes=("ly",),
    bad_infixes=("tion",),
    name_length=(2, 9),
    alias_suffixes=("er", "ing"),
    markers=("that", "pour", "nicht", "para"),
    related=r"([A-ZÀ-Þ][a-zà-ÿ]{1,3})",
    attribute=r" ([a-z]{4}) [^\n]{0,12} (ont|ent|est|and|the|de|der) [^\n]{0,8}(?:er|he|or)",
    watched=("hean", "nicht", "dans", "para", "erth"),
    verbs=("ingthe", "andthe", "ereau", "chen", "ado", "tion"),
    guides=("the", "de", "und", "que", "of"),
    psych=("on", "er", "th", "in", "de"),
    quotes=("«", "»"),
    prohibition=r"([a-z]{2,9}) (?:is|no|nicht|pas) ([a-z]{2,9})",
    prerequisite=r"only ([a-z]{2,9}) (?:then|for) ([a-z]{2,9})",
    contradictions=("but", "or", "aber", "pas"),
    flashback=r"(was|war|qui|los)",
    relative=r"([0-9]{1,6})",
    absolute=r"([a-zà-ÿ]{4,9}) ([0-9]{2,4})",
    speech="[,.]",
    power_high=("tionth", "keitge", "auxque"),
    power_low=("that", "nicht", "dans"),
    streak=("tionth", "erhe", "keit"),
    modern=("hash", "ched", "ado"),
    modern_more=(),
    tiers={"high": ("onth", "keit"), "medium": ("erth", "aux"), "low": ("ando", "heit")},
    protagonist="anti",
    events=("tion", "keit", "aux", "ndo", "erth"),
    setups=("hean", "eau"),
    reactions=("the", "la"),
    ranks={"high": ("onth", "keit"), "mid": ("erth", "aux"), "low": ("ando", "heit")},
    other_periods={"a": ("thand", "chen"), "b": ("ciónde", "eauan")},
    near_run=r"([a-z]{2,})",
    pleasure=("tion", "keit", "aux"),
    conflict=("erth", "heit", "ado"),
    upgrade=("tionth", "keitge", "auxque", "ciónra"),
    weights={"tion": 1.0, "keit": 2.0, "aux": 3.0},
)

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.lpad(F.col("doc_id").cast("string"), 9, "0")
    return table(spark, sf_dir, "documents").select(F.col("source").alias("project_id"), path.alias("path"), F.concat(F.lit("doc "), path).alias("title"), "text")


def chunks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ms.chunks(docs_of(spark, sf_dir), P)


def lst(terms) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in terms) + "]"


def anyof(terms, c: str = "content") -> str:
    return "(" + " OR ".join(f"contains({c}, '{t}')" for t in terms) + ")"


def nof(terms, c: str = "content") -> str:
    return "(" + " + ".join(f"CAST(contains({c}, '{t}') AS INT)" for t in terms) + ")"


DOCS = """d AS (SELECT source AS project_id, lpad(CAST(doc_id AS VARCHAR), 9, '0') AS path, text FROM documents)"""
CH = f"""WITH {DOCS},
li AS (SELECT project_id, path, i, l, regexp_matches(regexp_replace(l, '^\\s+|\\s+$', '', 'g'), '{P.heading}') AS h FROM (SELECT project_id, path, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM d)),
ln AS (SELECT *, sum(CAST(h AS INT)) OVER w AS c, sum(strlen(l) + 1) OVER w - strlen(l) - 1 AS ofs FROM li WINDOW w AS (PARTITION BY project_id, path ORDER BY i)),
wh AS (SELECT project_id, path FROM li GROUP BY ALL HAVING NOT bool_or(h)),
c0 AS (SELECT project_id, path, c - 1 AS chunk_index, arg_min(regexp_replace(l, '^\\s+|\\s+$', '', 'g'), i) AS title, string_agg(l, chr(10) ORDER BY i) AS raw, min(ofs) AS start_offset FROM ln WHERE c > 0 GROUP BY project_id, path, c),
c1 AS (SELECT project_id, path, chunk_index, title, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS content, start_offset, start_offset + strlen(raw) AS end_offset FROM c0
  UNION ALL SELECT project_id, path, 0, 'doc ' || path, text, 0, strlen(text) FROM d SEMI JOIN wh USING (project_id, path)),
ch AS (SELECT project_id, path, CAST(chunk_index AS BIGINT) AS chunk_index, title, content, CAST(start_offset AS BIGINT) AS start_offset, CAST(end_offset AS BIGINT) AS end_offset, sha256(project_id || '|' || path || '|' || CAST(CAST(chunk_index AS BIGINT) AS VARCHAR)) AS chunk_id FROM c1)"""
TRIM = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
def sentences_of(P, CH: str) -> str:
    return CH + f""",
se AS (SELECT project_id, path, chunk_index, chunk_id, unnest(list_filter(list_transform(regexp_split_to_array(content, '{P.delimiters}'), lambda x: {TRIM("x")}), lambda x: x <> '')) AS s FROM ch)"""


SE = sentences_of(P, CH)


@query(CH + """SELECT project_id, path, chunk_index, title, sha256(content) AS content_hash, start_offset, end_offset, chunk_id, CAST(length(regexp_replace(content, '\\s+', '', 'g')) AS BIGINT) AS word_count FROM ch""")
def c1_chunks(spark, d):
    return chunks_of(spark, d).drop("content")


@query(CH + """SELECT project_id, path, title FROM ch WHERE chunk_index = 0""")
def c2_first_chapters(spark, d):
    return ms.chunks(docs_of(spark, d), P, split=False).select("project_id", "path", "title")


@query(SE + """SELECT project_id, count(*) AS n, count(*) FILTER (length(s) >= 8) AS n8, count(*) FILTER (strlen(s) >= 20) AS n20, CAST(sum(length(s)) AS BIGINT) AS chars FROM se GROUP BY project_id""")
def c3_sentences(spark, d):
    s = chunks_of(spark, d).select("project_id", F.explode(tx.sentences("content", P.delimiters)).alias("s"))
    return s.groupBy("project_id").agg(F.count("*").alias("n"), F.count_if(F.length("s") >= 8).alias("n8"), F.count_if(F.octet_length("s") >= 20).alias("n20"), F.sum(F.length("s")).alias("chars"))


@query(SE + """SELECT project_id, CAST(sum(len(list_distinct(regexp_extract_all(s, '[\\p{L}\\p{N}]+')))) AS BIGINT) AS tokens FROM se GROUP BY project_id""")
def c4_run_tokens(spark, d):
    return chunks_of(spark, d).select("project_id", F.explode(tx.sentences("content", P.delimiters)).alias("s")).groupBy("project_id").agg(F.sum(F.size(tx.run_tokens("s"))).alias("tokens"))


@query(CH + f"""SELECT project_id, path, chunk_index, t AS term, CASE WHEN p = 0 THEN substr(content, 1, 60) ELSE substr(content, greatest(1, p - 18), least(length(content), p + length(t) + 17) - greatest(1, p - 18) + 1) END AS snippet,
CAST((length(content) - length(replace(content, t, ''))) / length(t) AS BIGINT) AS n FROM (SELECT *, instr(content, t) AS p FROM (SELECT *, unnest({lst(P.watched)}) AS t FROM ch))""")
def c6_snippets(spark, d):
    x = chunks_of(spark, d).withColumn("term", F.explode(tx.words_array(P.watched)))
    return x.select("project_id", "path", "chunk_index", "term", tx.snippet("content", F.col("term")).alias("snippet"), tx.occurrences("content", F.col("term")).alias("n"))


@query(CH + f"""SELECT project_id, path, chunk_index, CAST({nof(P.watched)} AS INT) AS present, {anyof(P.markers)} AS any_marker FROM ch""")
def p1_lexicon(spark, d):
    return chunks_of(spark, d).select("project_id", "path", "chunk_index", F.size(tx.present("content", P.watched)).alias("present"), tx.any_of("content", P.markers).alias("any_marker"))


def some(xs) -> str:
    return "|".join(map(re.escape, xs))


def ext(patterns) -> str:
    return "list_concat(" + ", ".join(f"regexp_extract_all(content, '{p}', 1)" for p in patterns) + ")" if len(patterns) > 1 else f"regexp_extract_all(content, '{patterns[0]}', 1)"


def men(P, CH: str) -> str:
    return CH + f""",
m0 AS (SELECT project_id, path, chunk_index, chunk_id, 'person' AS node_type, unnest({ext(P.person_patterns)}) AS name FROM ch),
me AS (SELECT * FROM m0 WHERE length(name) BETWEEN {P.name_length[0]} AND {P.name_length[1]} AND NOT list_contains({lst(P.stopwords)}, name) AND NOT regexp_matches(name, '^({some(P.bad_prefixes)})|({some(P.bad_suffixes)})$|({some(P.bad_infixes)})')
 UNION ALL SELECT * FROM (SELECT project_id, path, chunk_index, chunk_id, 'place', unnest({ext((P.place_pattern,))}) AS name FROM ch) WHERE length(name) >= 2
 UNION ALL SELECT * FROM (SELECT project_id, path, chunk_index, chunk_id, 'item', regexp_replace(unnest({ext(P.item_patterns)}), '^({some(P.item_prefixes)})', '') AS name FROM ch) WHERE length(name) >= 2),
ca AS (SELECT project_id, node_type, name, count(*) AS occurrence_count, arg_min(chunk_id, path || lpad(CAST(chunk_index AS VARCHAR), 9, '0')) AS first_chunk_id, arg_max(chunk_id, path || lpad(CAST(chunk_index AS VARCHAR), 9, '0')) AS latest_chunk_id, least(50 + 10 * count(*), 90) AS confidence FROM me GROUP BY ALL)"""


MEN = men(P, CH)


@query(MEN + "SELECT * FROM ca")
def m5_candidates(spark, d):
    return mentions.candidates(mentions.mentions(chunks_of(spark, d), P))


@query(MEN + """, al AS (SELECT project_id, name, name[1] || s AS alias FROM ca, (SELECT unnest(['er', 'ing']) AS s) WHERE node_type = 'person' AND length(name) = 5),
hi AS (SELECT al.project_id, al.name, count(*) AS more, array_to_string(list_sort(list(DISTINCT alias)), ',') AS aliases FROM al JOIN ch ON ch.project_id = al.project_id AND contains(ch.content, alias) GROUP BY ALL)
SELECT ca.project_id, node_type, ca.name, CAST(occurrence_count + coalesce(more, 0) AS BIGINT) AS occurrence_count, coalesce(aliases, '') AS aliases FROM ca LEFT JOIN hi ON hi.project_id = ca.project_id AND hi.name = ca.name AND node_type = 'person'""")
def m6_aliases(spark, d):
    c = chunks_of(spark, d)
    return mentions.merge_aliases(mentions.candidates(mentions.mentions(c, P)), c, P, length=5).select("project_id", "node_type", "name", "occurrence_count", F.array_join("aliases", ",").alias("aliases"))


@query(MEN + "SELECT * FROM ca WHERE node_type = 'person' ORDER BY occurrence_count DESC, name, project_id LIMIT 50")
def l1_top_candidates(spark, d):
    return mentions.top(mentions.candidates(mentions.mentions(chunks_of(spark, d), P, ("people",))), 50, "person")


def fores(P, SE: str) -> str:
    return SE + f""", f AS (SELECT *, substr(s, 1, 28) AS title, path || lpad(CAST(chunk_index AS VARCHAR), 9, '0') AS pos FROM se WHERE length(s) >= 8 AND {anyof(P.markers, "s")}),
g AS (SELECT project_id, title, count(*) AS mentions, min(pos) AS p0, max(pos) AS p1, arg_min(chunk_id, pos) AS first_chunk_id, arg_max(chunk_id, pos) AS latest_chunk_id, arg_min(chunk_index, pos) AS i0, arg_max(chunk_index, pos) AS i1,
 array_to_string(list_sort(list_distinct(flatten(list(regexp_extract_all(s, '{P.related}', 1))))), ',') AS related FROM f GROUP BY project_id, title),
e AS (SELECT project_id, title, pos, min(s) AS s FROM f GROUP BY ALL)
SELECT g.project_id, g.title, mentions, first_chunk_id, latest_chunk_id, related, CASE WHEN abs(i1 - i0) * 2 * mentions >= 20 THEN 'high' WHEN abs(i1 - i0) * 2 * mentions >= 10 THEN 'medium' ELSE 'low' END AS risk_level, substr(e.s, 1, 120) AS evidence
FROM g JOIN e ON e.project_id = g.project_id AND e.title = g.title AND e.pos = g.p0"""


@query(fores(P, SE))
def a1_foreshadows(spark, d):
    return detectors.foreshadows(chunks_of(spark, d), P).withColumn("related", F.array_join("related_nodes", ",")).drop("related_nodes")


@query(CH + f""", x AS (SELECT project_id, path, chunk_index, chunk_id, unnest(regexp_extract_all(content, '{P.attribute}', 1)) AS name, unnest(regexp_extract_all(content, '{P.attribute}', 2)) AS v FROM ch),
y AS (SELECT project_id, name, v, arg_min(chunk_id, path || lpad(CAST(chunk_index AS VARCHAR), 9, '0')) AS c FROM x GROUP BY ALL)
SELECT project_id, name || ' 的眼睛颜色可能前后不一致' AS title, name || ' 出现了多个眼睛颜色候选，请依据正文确认。' AS description, count(*) AS n, string_agg(c, ',' ORDER BY v) AS chunk_ids FROM y GROUP BY project_id, name HAVING count(*) >= 2""")
def a2_attribute_conflicts(spark, d):
    return detectors.attribute_conflicts(chunks_of(spark, d), P).select("project_id", "title", "description", F.size("evidence").cast("long").alias("n"), F.array_join(F.transform("evidence", lambda e: e["chunk_id"]), ",").alias("chunk_ids"))


def _terms_sql(terms, least, cap, title, description):
    return CH + f""", x AS (SELECT project_id, t, chunk_id, row_number() OVER (PARTITION BY project_id, t ORDER BY path, chunk_index) AS r, count(*) OVER (PARTITION BY project_id, t) AS n FROM (SELECT *, unnest({lst(terms)}) AS t FROM ch) WHERE contains(content, t))
SELECT project_id, {title} AS title, {description} AS description, string_agg(chunk_id, ',' ORDER BY r) AS chunk_ids FROM x WHERE n >= {least} AND r <= {cap} GROUP BY ALL"""


def _terms(df):
    return df.select("project_id", "title", "description", F.array_join(F.transform("evidence", lambda e: e["chunk_id"]), ",").alias("chunk_ids"))


REPEATED_TERM = ("'“' || t || '”反复出现'", "'“' || t || '”在多个正文片段中重复出现，可在修订时确认是否有意保留。'")


@query(_terms_sql(P.watched, 3, 5, *REPEATED_TERM))
def a3_repeat_terms(spark, d):
    return _terms(detectors.repeat_terms(chunks_of(spark, d), P))


@query(_terms_sql(P.verbs, 4, 1 << 40, "'重复动作：' || t", "'\"' || t || '\" 出现在 ' || n || ' 个不同章节'"))
def a5_repeated_actions(spark, d):
    return _terms(detectors.repeated_actions(chunks_of(spark, d), P))


@query(SE + """, g AS (SELECT DISTINCT project_id, chunk_id, substr(s, i, n) AS phrase FROM (SELECT project_id, chunk_id, s, n, unnest(range(1, length(s) - n + 2)) AS i FROM (SELECT project_id, chunk_id, regexp_replace(s, '[^\\p{L}\\p{N}]+', '', 'g') AS s FROM se), (SELECT unnest(range(4, 11)) AS n) WHERE length(s) >= n)),
r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY n_chunks DESC, length(phrase) DESC, phrase) AS rank FROM (SELECT project_id, phrase, count(*) AS n_chunks FROM g GROUP BY ALL HAVING count(*) >= 5))
SELECT project_id, phrase, n_chunks, CAST(rank AS INT) AS rank FROM r WHERE rank <= 15""")
def a4_top_phrases(spark, d):
    return detectors.top_phrases(chunks_of(spark, d), delimiters=P.delimiters)


@query(CH + f""", x AS (SELECT project_id, g, count(*) AS n FROM (SELECT *, unnest({lst(P.guides)}) AS g FROM ch) WHERE regexp_matches(content, '[\\p{{L}}\\p{{N}}][\\s\\S]{{0,7}}' || g || '{P.speech}') GROUP BY ALL) SELECT project_id, '某某' || g AS subject, '模式 "某某' || g || '" 在 ' || n || ' 个不同章节中出现' AS description, n AS match_count FROM x WHERE n >= 1""")
def a6_dialogue_patterns(spark, d):
    return detectors.dialogue_patterns(chunks_of(spark, d), P, least=1).select("project_id", "subject", "description", "match_count")


PSY = CH + f""", qu AS (SELECT project_id, path, chunk_index, content, string_split(replace(replace(content, '{P.quotes[0]}', chr(1) || '+'), '{P.quotes[1]}', chr(1) || '-'), chr(1)) AS parts FROM ch WHERE strlen(content) >= 100),
qp AS (SELECT project_id, path, chunk_index, unnest(parts) AS p, unnest(range(len(parts))) AS i FROM qu),
qd AS (SELECT *, sum(CASE WHEN i = 0 THEN 0 WHEN p[1] = '+' THEN 1 ELSE -1 END) OVER (PARTITION BY project_id, path, chunk_index ORDER BY i) AS deep FROM qp),
ql AS (SELECT project_id, path, chunk_index, coalesce(string_agg(CASE WHEN i = 0 THEN p ELSE p[2:] END, chr(2) ORDER BY i) FILTER (deep <= 0), '') AS plain FROM qd GROUP BY ALL),
ps AS (SELECT ql.project_id, ql.path, ql.chunk_index, CAST({" + ".join(f"(length(plain) - length(replace(plain, '{k}', ''))) / {len(k)}" for k in P.psych)} AS BIGINT) AS hits, CAST(length(content) AS BIGINT) AS chars FROM ql JOIN qu ON qu.project_id = ql.project_id AND qu.path = ql.path AND qu.chunk_index = ql.chunk_index)"""


@query(PSY + "SELECT * FROM ps")
def a7_psych_density(spark, d):
    return detectors.psych_counts(chunks_of(spark, d), P).select("project_id", "path", "chunk_index", "hits", "chars")


@query(SE + """, t AS (SELECT DISTINCT project_id, list_sort(list_distinct(regexp_extract_all(s, '[\\p{L}\\p{N}]+'))) AS t FROM se WHERE strlen(s) >= 20),
k AS (SELECT *, row_number() OVER () AS k FROM t WHERE len(t) > 0), w AS (SELECT project_id, k, unnest(t) AS w FROM k),
p AS (SELECT a.project_id, a.k AS a, b.k AS b, count(*) AS common FROM w a JOIN w b ON a.project_id = b.project_id AND a.w = b.w AND a.k < b.k GROUP BY ALL),
q AS (SELECT p.project_id, array_to_string(x.t, ' ') AS s, array_to_string(y.t, ' ') AS t, common, len(x.t) + len(y.t) - common AS total FROM p JOIN k x ON x.k = a JOIN k y ON y.k = b WHERE common >= 0.6 * (len(x.t) + len(y.t) - common) - 1e-9)
SELECT project_id, least(s, t) AS one, greatest(s, t) AS other, common, CAST(total AS BIGINT) AS total FROM q""")
def a8_similar_pairs(spark, d):
    x = detectors.similar_pairs(chunks_of(spark, d), P)
    said = lambda c: F.array_join(c, " ")
    return x.select("project_id", F.least(said("ta"), said("tb")).alias("one"), F.greatest(said("ta"), said("tb")).alias("other"), F.col("common").cast("long").alias("common"), F.col("total").cast("long").alias("total"))


@query()
def a9_similar_groups(spark, d):
    return detectors.similar_groups(chunks_of(spark, d), P)


def _weight(P) -> str:
    return "(" + " + ".join(f"CASE WHEN contains(content, '{k}') THEN {w} ELSE 0 END" for k, w in P.weights.items()) + ")"


def met(P, CH: str) -> str:
    return CH + f""",
na AS (SELECT project_id, path, chunk_index, length(content) AS chars, {nof(P.pleasure)} AS pleasure, {nof(P.conflict)} AS conflict, {nof(P.modern)} AS modern, {_weight(P)} AS weight, {anyof(P.upgrade)} AS upgrade, {nof(P.events)} + {nof(P.conflict)} AS busy, row_number() OVER (PARTITION BY project_id ORDER BY path, chunk_index) AS n FROM ch)"""


MET = met(P, CH)


@query(MET + """SELECT project_id, round(sum(pleasure) * 1000.0 / sum(chars), 6) AS pleasure_density, round(sum(conflict) * 1000.0 / sum(chars), 6) AS conflict_density, round(sum(modern) * 1000.0 / sum(chars), 6) AS modern_density, round(sum(weight) * 1000.0 / sum(chars), 6) AS intensity, round(avg(chars), 6) AS chapter_avg_words FROM na GROUP BY project_id""")
def a10_densities(spark, d):
    x = metrics.densities(metrics.narrow(chunks_of(spark, d), P))
    return x.select("project_id", *[F.round(c, 6).alias(c) for c in x.columns[1:]])


@query(MET + """, g AS (SELECT project_id, avg(gap) AS gap FROM (SELECT project_id, n - lag(n) OVER (PARTITION BY project_id ORDER BY n) AS gap FROM na WHERE upgrade) GROUP BY 1)
SELECT project_id, round(coalesce(gap, c), 6) AS upgrade_interval FROM (SELECT project_id, count(*)::DOUBLE AS c FROM na GROUP BY 1) LEFT JOIN g USING (project_id)""")
def w6_keyword_interval(spark, d):
    return metrics.keyword_interval(metrics.narrow(chunks_of(spark, d), P)).withColumn("upgrade_interval", F.round("upgrade_interval", 6))


@query(MET + """, x AS (SELECT project_id, n, sum(busy) OVER w AS k, sum(chars) OVER w AS len, avg(chars) OVER (PARTITION BY project_id) AS mean FROM na WINDOW w AS (PARTITION BY project_id ORDER BY n ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT project_id, round(coalesce(count(*) FILTER (n >= 5 AND k < 2 AND len > 7.5 * mean) / nullif(count(*) FILTER (n >= 5), 0), 0), 6) AS pacing_flatness FROM x GROUP BY 1""")
def w7_pacing_flatness(spark, d):
    return metrics.pacing_flatness(metrics.narrow(chunks_of(spark, d), P)).withColumn("pacing_flatness", F.round("pacing_flatness", 6))


@query(f"""WITH x AS (SELECT * FROM ({SQL["a10_densities"]}) JOIN ({SQL["w6_keyword_interval"]}) USING (project_id) JOIN ({SQL["w7_pacing_flatness"]}) USING (project_id))
SELECT project_id, metric_type, value, unit FROM (UNPIVOT x ON {", ".join(metrics.UNITS)} INTO NAME metric_type VALUE value) JOIN (SELECT unnest({lst(metrics.UNITS)}) AS metric_type, unnest({lst(metrics.UNITS.values())}) AS unit) USING (metric_type)""")
def a14_metrics(spark, d):
    return metrics.metrics(chunks_of(spark, d), P).withColumn("value", F.round("value", 6))


#: All metrics; one of them with a weight.
WANTED = tuple(metrics.Metric(k, "shuangwen", weight=1.5 if k == "时代穿帮风险" else 1.0) for k in metrics.KINDS)
_PER = {"爽点密度": "pleasure", "冲突频次": "conflict", "时代穿帮风险": "1.5 * modern", "打脸强度": "weight", "知识密度": "knowledge", "人物密度": "person", "地名密度": "place"}
_OTHER = {"升级间隔": "upgrade_interval", "节奏平缓风险": "pacing_flatness", "章节平均字数": "avg_chars"}


@query(MEN + MET[len(CH):] + f""", kn AS (SELECT project_id, sum({" + ".join(f"(length(content) - length(replace(content, '{k}', ''))) / {len(k)}" for k in P.watched)}) AS knowledge FROM ch GROUP BY 1),
mc AS (SELECT project_id, count(*) FILTER (node_type = 'person') AS person, count(*) FILTER (node_type = 'place') AS place FROM me GROUP BY 1),
su AS (SELECT project_id, sum(chars) AS chars, avg(chars) AS avg_chars, sum(pleasure) AS pleasure, sum(conflict) AS conflict, sum(modern) AS modern, sum(weight) AS weight FROM na GROUP BY 1),
al AS (SELECT * FROM su JOIN kn USING (project_id) LEFT JOIN mc USING (project_id) JOIN ({SQL["w6_keyword_interval"]}) USING (project_id) JOIN ({SQL["w7_pacing_flatness"]}) USING (project_id))
""" + " UNION ALL ".join([f"SELECT project_id, 'shuangwen' AS profile_id, '{k}' AS metric_type, round(coalesce({v}, 0) * 1000.0 / chars, 6) AS value, 'per_1000_chars' AS unit FROM al" for k, v in _PER.items()] + [f"SELECT project_id, 'shuangwen', '{k}', round({v}, 6), '{metrics.KINDS[k][2]}' FROM al" for k, v in _OTHER.items()]))
def a14_profile_metrics(spark, d):
    return metrics.profile_metrics(chunks_of(spark, d), P, WANTED, terms=P.watched).withColumn("value", F.round("value", 6))


@query(CH + f"""SELECT project_id, round(sum({" + ".join(f"(length(content) - length(replace(content, '{k}', ''))) / {len(k)}" for k in P.watched)}) * 1000.0 / sum(length(content)), 6) AS knowledge_density FROM ch GROUP BY 1""")
def a13_knowledge_density(spark, d):
    return metrics.knowledge_density(chunks_of(spark, d), P.watched).withColumn("knowledge_density", F.round("knowledge_density", 6))


@query(MEN + """SELECT project_id, node_type, round(n * 1000.0 / chars, 6) AS density FROM (SELECT project_id, node_type, count(*) AS n FROM me GROUP BY ALL) JOIN (SELECT project_id, sum(length(content)) AS chars FROM ch GROUP BY 1) USING (project_id)""")
def a13_entity_density(spark, d):
    c = chunks_of(spark, d)
    return metrics.entity_density(c, mentions.mentions(c, P)).withColumn("density", F.round("density", 6))


@query(CH + """SELECT project_id, count(DISTINCT path) AS documents, count(*) AS chunks, CAST(sum(length(regexp_replace(content, '\\s+', '', 'g'))) AS BIGINT) AS words FROM ch GROUP BY 1""")
def a15_summary(spark, d):
    return metrics.project_summary(chunks_of(spark, d))


@query(MEN + f""", n AS (SELECT project_id, count(*) FILTER (node_type = 'person') AS persons, count(*) FILTER (node_type = 'place') AS places, count(*) FILTER (node_type = 'item') AS items FROM ca GROUP BY 1),
f AS (SELECT project_id, count(*) AS foreshadows FROM ({SQL["a1_foreshadows"]}) GROUP BY 1), i AS (SELECT project_id, count(*) AS issues FROM ({SQL["a3_repeat_terms"]}) GROUP BY 1)
SELECT s.*, coalesce(persons, 0) AS persons, coalesce(places, 0) AS places, coalesce(items, 0) AS items, coalesce(foreshadows, 0) AS foreshadows, coalesce(issues, 0) AS issues
FROM ({SQL["a15_summary"]}) s LEFT JOIN n USING (project_id) LEFT JOIN f USING (project_id) LEFT JOIN i USING (project_id)""")
def a16_dashboard(spark, d):
    c = chunks_of(spark, d)
    return metrics.dashboard(c, mentions.candidates(mentions.mentions(c, P)), detectors.foreshadows(c, P), detectors.repeat_terms(c, P))


@query(f"""SELECT project_id, kind AS issue_type, count(*) AS n FROM (SELECT project_id, 'repeat_expression' AS kind FROM ({SQL["a3_repeat_terms"]}) UNION ALL SELECT project_id, 'action' FROM ({SQL["a5_repeated_actions"]})) GROUP BY ALL""")
def a17_issue_counts(spark, d):
    c = chunks_of(spark, d)
    return metrics.issue_counts(detectors.repeat_terms(c, P).unionByName(detectors.repeated_actions(c, P)))


@query(CH + f"""SELECT project_id, count(*) FILTER (regexp_matches(content, '{P.flashback}')) AS flashbacks, count(*) AS events FROM ch GROUP BY 1""")
def a17_flashbacks(spark, d):
    return metrics.flashbacks(story.timeline_events(chunks_of(spark, d), P))


def _near(groups) -> str:
    rows = " UNION ALL ".join(f"SELECT '{g}' AS tier, '{t}' AS t" for g, ts in groups.items() for t in ts)
    return CH + f""", te AS ({rows}),
oc AS (SELECT project_id, path, chunk_index, chunk_id, tier, t, content, string_split(content, t) AS parts FROM ch JOIN te ON contains(content, t)),
po AS (SELECT *, unnest(range(1, len(parts))) AS j FROM oc),
pp AS (SELECT *, list_sum(list_transform(parts[1:j], lambda x: length(x))) + (j - 1) * length(t) + 1 AS p FROM po),
ar AS (SELECT *, substr(content, CAST(greatest(1, p - 10) AS BIGINT), CAST(least(10, p - 1) AS BIGINT)) || substr(content, CAST(p + length(t) AS BIGINT), 10) AS near FROM pp),
ru AS (SELECT project_id, path, chunk_index, chunk_id, tier, t, unnest(regexp_extract_all(near, '{P.near_run}', 1)) AS r FROM ar),
nm AS (SELECT DISTINCT project_id, path, chunk_index, chunk_id, tier, t, substr(r, i, n) AS name FROM (SELECT *, unnest(range(1, length(r) - n + 2)) AS i FROM ru, (SELECT unnest([2, 3]) AS n) WHERE length(r) >= n))"""


@query(_near(P.tiers) + f""", al AS (SELECT project_id, name, tier FROM nm UNION ALL SELECT project_id, '{P.protagonist}', tier FROM oc WHERE contains(content, '{P.protagonist}'))
SELECT project_id, name, string_agg(DISTINCT tier, ',' ORDER BY tier) AS tiers FROM al GROUP BY 1, 2 HAVING count(DISTINCT tier) >= 2""")
def a18_identity_conflicts(spark, d):
    return checks.identity_conflicts(chunks_of(spark, d), P)


@query(_near(P.tiers) + f"""SELECT DISTINCT * FROM (SELECT project_id, name, path, chunk_index, t AS term, tier FROM nm UNION ALL SELECT project_id, '{P.protagonist}', path, chunk_index, t, tier FROM oc WHERE contains(content, '{P.protagonist}'))""")
def a18_identity_evidence(spark, d):
    return checks.identity_evidence(chunks_of(spark, d), P)


@query(_near(P.ranks) + """, f AS (SELECT project_id, name, tier, min(path || lpad(CAST(chunk_index AS VARCHAR), 9, '0')) AS pos0 FROM nm GROUP BY ALL)
SELECT * FROM (SELECT project_id, name, tier, string_agg(tier, ',') OVER (PARTITION BY project_id, name ORDER BY pos0, tier ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f) WHERE before IS NOT NULL""")
def w9_rank_conflicts(spark, d):
    return checks.rank_conflicts(chunks_of(spark, d), P)


@query(CH + """SELECT project_id, path, chunk_index, row_number() OVER (PARTITION BY project_id ORDER BY path, chunk_index) AS order_index FROM ch""")
def w1_order_index(spark, d):
    return story.order_index(chunks_of(spark, d)).drop("chunk_id")


@query(CH + f""", x AS (SELECT project_id, path, chunk_index, bool_or({anyof(P.power_high)}) OVER (PARTITION BY project_id ORDER BY path, chunk_index) AS since, list_filter({lst(P.power_low)}, lambda t: contains(content, t))[1] AS low FROM ch)
SELECT project_id, count(*) AS n, string_agg(path || ':' || chunk_index || ':' || low, chr(10) ORDER BY path, chunk_index) AS lines FROM x WHERE since AND low IS NOT NULL GROUP BY 1""")
def w2_power_regression(spark, d):
    return checks.power_regression(chunks_of(spark, d), P)


@query(CH + f""", x AS (SELECT project_id, row_number() OVER w AS n, sum(CAST({anyof(P.streak)} AS INT)) OVER (PARTITION BY project_id ORDER BY path, chunk_index ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s FROM ch WINDOW w AS (PARTITION BY project_id ORDER BY path, chunk_index))
SELECT project_id, CAST(min(n) AS INT) AS ends_at FROM x WHERE n >= 3 AND s = 0 GROUP BY 1""")
def w3_low_streak(spark, d):
    return checks.low_streak(chunks_of(spark, d), P)


@query(CH + f""", e AS (SELECT project_id, path, chunk_index, {anyof(P.setups)} AS a, {anyof(P.reactions)} AS b, {nof(P.events)} AS k FROM ch WHERE {nof(P.events)} >= 2),
f AS (SELECT *, CASE WHEN (a, b, k) = lag((a, b, k)) OVER w THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY project_id ORDER BY path, chunk_index)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY project_id ORDER BY path, chunk_index) AS island FROM f),
h AS (SELECT project_id, island, count(*) AS length, min(path || lpad(CAST(chunk_index AS VARCHAR), 9, '0')) AS start FROM g GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY length DESC, start) AS r FROM h)
SELECT project_id, length, start[1:9] AS path, CAST(start[10:] AS BIGINT) AS chunk_index, CASE WHEN length >= 3 THEN 'high' ELSE 'medium' END AS severity FROM r WHERE r = 1 AND length >= 2""")
def w4_diminishing_runs(spark, d):
    return checks.diminishing_runs(chunks_of(spark, d), P)


@query(CH + """, x AS (SELECT project_id, path, chunk_index, length(content) AS chars, avg(length(content)) OVER w AS mean, count(*) OVER w AS n, row_number() OVER (PARTITION BY project_id ORDER BY path, chunk_index) AS chapter FROM ch WINDOW w AS (PARTITION BY project_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY path, chunk_index) AS r FROM x WHERE n >= 3 AND mean >= 10 AND chars > 2.5 * mean)
SELECT project_id, path, chunk_index, CAST(chars AS INT) AS chars, round(mean, 3) AS mean, chapter FROM r WHERE r = 1""")
def w8_chapter_length(spark, d):
    return checks.chapter_length_anomaly(chunks_of(spark, d))


@query(CH + f"""SELECT project_id, path, chunk_index, w AS word FROM (SELECT *, unnest({lst(P.modern)}) AS w FROM ch WHERE {anyof(P.reactions)}) WHERE contains(content, w)""")
def j4_anachronisms(spark, d):
    return checks.anachronisms(chunks_of(spark, d), P.reactions, P.modern)


@query(CH + " UNION ALL ".join(f"""SELECT project_id, path, chunk_index, '{k}' AS period FROM ch WHERE {anyof(P.reactions)} AND {anyof(v)}""" for k, v in P.other_periods.items()))
def j5_place_names(spark, d):
    return checks.place_name_anachronisms(chunks_of(spark, d), P.reactions, P)


def _rules(pattern: str, before: str, word: str, said: str) -> str:
    return f"SELECT project_id, chunk_id, s, a, true AS positive, '{before}' || s || '{word}' || a AS name, '{said}' || '{before}' || s || '{word}' || a AS description FROM (SELECT project_id, chunk_id, unnest(regexp_extract_all(content, '{pattern}', 1)) AS s, unnest(regexp_extract_all(content, '{pattern}', 2)) AS a FROM ch)"


def rules_of(P, CH: str) -> str:
    return CH + f""", ru AS (SELECT DISTINCT * FROM ({_rules(P.prohibition, "", "不能", "从正文抽取的约束规则: ")} UNION ALL {_rules(P.prerequisite, "只有", "才能", "前提约束: ")}))"""


RU = rules_of(P, CH)


@query(RU + """SELECT project_id, chunk_id AS source_chunk_id, name, description, positive FROM ru GROUP BY ALL""")
def f3_rules(spark, d):
    return story.extract_rules(chunks_of(spark, d), P).select("project_id", "source_chunk_id", "name", "description", "positive")


@query(RU + f""", k AS (SELECT DISTINCT project_id, name AS rule, s, a FROM ru) SELECT k.project_id, rule, chunk_id, substr(any_value(content), 1, 80) AS snippet FROM k JOIN ch ON ch.project_id = k.project_id AND contains(content, s) AND contains(content, a) AND {anyof(P.contradictions)} GROUP BY ALL""")
def j3_rule_conflicts(spark, d):
    c = stored(chunks_of(spark, d))  # read for the rules and for the conflicts
    rules = story.extract_rules(c, P).withColumn("status", F.lit("active"))
    found = story.rule_conflicts(c, rules, P).select("project_id", "rule", "chunk_id", "snippet")  # once each, as P's rules of one name have the same keywords
    return found.distinct() if c.groupBy("chunk_id").count().where("count > 1").limit(1).count() else found


@query("""SELECT doc_id, CAST(doc_id AS BIGINT) AS value FROM documents""")
def f1_zh_number(spark, d):
    """Ids written as numerals read back: 零..九 with 千 百 十."""
    digits = "零一二三四五六七八九"
    x = table(spark, d, "documents").select("doc_id")
    place = lambda n, unit: F.when(F.floor(F.col("doc_id") / n) % 10 > 0, F.concat(F.translate((F.floor(F.col("doc_id") / n) % 10).cast("string"), "0123456789", digits), F.lit(unit))).otherwise("")
    text = F.concat(place(1000, "千"), place(100, "百"), place(10, "十"), place(1, ""))
    high = F.floor(F.col("doc_id") / 10000) * 10000
    return x.select("doc_id", (high + F.coalesce(tx.zh_number(F.when(text == "", "零").otherwise(text)), F.lit(0))).cast("long").alias("value"))


@query(CH + f""", x AS (SELECT project_id, path, chunk_index, row_number() OVER (PARTITION BY project_id ORDER BY path, chunk_index) AS order_index, regexp_matches(content, '{P.flashback}') AS is_flashback,
regexp_extract(content, '{P.relative}', 0) AS rel, CAST(nullif(regexp_extract(content, '{P.relative}', 1), '') AS BIGINT) AS rel_n, regexp_extract(content, '{P.absolute}', 0) AS era, CAST(nullif(regexp_extract(content, '{P.absolute}', 2), '') AS BIGINT) AS era_n FROM ch)
SELECT project_id, path, chunk_index, order_index, CASE WHEN era <> '' THEN era ELSE rel END AS time_expression, CASE WHEN era <> '' AND era_n IS NOT NULL THEN era_n WHEN rel <> '' THEN order_index + rel_n END AS estimated_order, is_flashback FROM x""")
def f2_timeline(spark, d):
    return story.timeline_events(chunks_of(spark, d), P).select("project_id", "path", "chunk_index", "order_index", "time_expression", "estimated_order", "is_flashback")


@query(MEN + """, tl AS (SELECT ch.project_id, ch.chunk_id, row_number() OVER (PARTITION BY ch.project_id ORDER BY path, chunk_index) AS o FROM ch),
mm AS (SELECT chunk_id, list(DISTINCT name) FILTER (node_type = 'person') AS ps, min(name) FILTER (node_type = 'place') AS pl FROM me GROUP BY 1),
x AS (SELECT project_id, o, ps, pl, lag(ps) OVER w AS lps, lag(pl) OVER w AS lpl FROM tl LEFT JOIN mm USING (chunk_id) WINDOW w AS (PARTITION BY project_id ORDER BY o))
SELECT * FROM (SELECT project_id, o AS order_index, lpl AS from_place, pl AS to_place, unnest(list_intersect(ps, lps)) AS person FROM x WHERE pl IS NOT NULL AND lpl IS NOT NULL AND pl <> lpl)""")
def w5_two_places(spark, d):
    c = chunks_of(spark, d)
    return story.two_places_at_once(story.with_mentions(story.timeline_events(c, P), mentions.mentions(c, P)))


def old_new(spark, d):
    x = table(spark, d, "documents").where("source IS NOT NULL")
    made = lambda rows, text: rows.select(F.col("source").alias("project_id"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("path"), F.lit("t").alias("title"), text.alias("text"))
    old = made(x.where("doc_id % 11 != 0"), F.col("text"))
    new = made(x.where("doc_id % 13 != 0"), F.concat("text", F.when(F.col("doc_id") % 7 == 0, " (new)").otherwise("")))
    return ms.text_columns(old), ms.text_columns(new)


STATE = """CASE WHEN doc_id % 11 <> 0 AND doc_id % 13 = 0 THEN 'deleted' WHEN doc_id % 11 = 0 AND doc_id % 13 <> 0 THEN 'created' WHEN doc_id % 7 = 0 THEN 'modified' ELSE 'unchanged' END"""


@query(f"""SELECT source AS project_id, lpad(CAST(doc_id AS VARCHAR), 9, '0') AS path, {STATE} AS state FROM documents WHERE doc_id % 11 <> 0 OR doc_id % 13 <> 0""")
def j7_classify(spark, d):
    old, new = (x.withColumn("last_modified_at", F.lit(None).cast("timestamp")) for x in old_new(spark, d))
    return versions.classify_documents(old.withColumn("deleted", F.lit(False)), new)


@query(f"""WITH s AS (SELECT source AS project_id, doc_id, {STATE} AS st FROM documents WHERE doc_id % 11 <> 0 OR doc_id % 13 <> 0)
SELECT project_id, lpad(CAST(doc_id AS VARCHAR), 9, '0') AS path, CASE st WHEN 'created' THEN 'added' WHEN 'deleted' THEN 'removed' ELSE st END AS kind FROM s WHERE st <> 'unchanged'""")
def j6_diff(spark, d):
    old, new = (x.withColumn("chunk_index", F.lit(0)) for x in old_new(spark, d))
    return versions.diff_chunks(old, new).select("project_id", "path", "kind")


@query(f"""SELECT source AS project_id, lpad(CAST(doc_id AS VARCHAR), 9, '0') AS path FROM documents WHERE doc_id % 11 <> 0 AND {STATE} IN ('deleted', 'modified')""")
def j8_removed(spark, d):
    old, new = (x.withColumn("chunk_id", F.col("path")) for x in old_new(spark, d))
    return versions.removed_chunks(old, new).select("project_id", "path")


OLD = DOCS.replace("text FROM documents", "text FROM documents WHERE source IS NOT NULL AND doc_id % 11 <> 0")
NEW = DOCS.replace("text FROM documents", "text || CASE WHEN doc_id % 7 = 0 THEN ' (new)' ELSE '' END AS text FROM documents WHERE source IS NOT NULL AND doc_id % 13 <> 0")


@query(f"""WITH gone AS (SELECT project_id, chunk_id FROM ({CH.replace(DOCS, OLD)} SELECT project_id, chunk_id, content FROM ch) o ANTI JOIN ({CH.replace(DOCS, NEW)} SELECT chunk_id, content FROM ch) n USING (chunk_id, content)),
refs AS (SELECT project_id, 'node' AS kind, name, first_chunk_id AS chunk_id FROM ({MEN.replace(DOCS, OLD)} SELECT * FROM ca) UNION ALL SELECT project_id, 'foreshadow', title, first_chunk_id FROM ({SQL["a1_foreshadows"].replace(DOCS, OLD)})
 UNION ALL SELECT project_id, 'rule', name, source_chunk_id FROM ({SQL["f3_rules"].replace(DOCS, OLD)})),
hit AS (SELECT project_id, count(*) FILTER (kind = 'node') AS nodes, count(*) FILTER (kind = 'foreshadow') AS foreshadows, count(*) FILTER (kind = 'rule') AS rules, string_agg(DISTINCT kind || ':' || name, chr(10) ORDER BY kind || ':' || name) AS touched FROM refs SEMI JOIN gone USING (chunk_id) GROUP BY 1)
SELECT project_id, coalesce(nodes, 0) AS nodes, coalesce(foreshadows, 0) AS foreshadows, coalesce(rules, 0) AS rules, coalesce(touched, '') AS touched, CASE WHEN nodes IS NULL THEN '无影响' ELSE nodes || '/' || foreshadows || '/' || rules END AS summary FROM (SELECT DISTINCT project_id FROM gone) LEFT JOIN hit USING (project_id)""")
def j9_impact(spark, d):
    old, new = (ms.chunks(x, P) for x in old_new(spark, d))
    made = versions.revision_impact(versions.removed_chunks(old, new), mentions.candidates(mentions.mentions(old, P)), detectors.foreshadows(old, P), story.extract_rules(old, P))
    return made.withColumn("touched", F.coalesce(F.array_join("touched", "\n"), F.lit("")))


@query(f"""WITH s AS (SELECT source AS project_id, doc_id, {STATE} AS st FROM documents WHERE doc_id % 11 <> 0 OR doc_id % 13 <> 0)
SELECT project_id, lpad(CAST(doc_id AS VARCHAR), 9, '0') AS path, CAST(st = 'created' AS BIGINT) AS added, CAST(st = 'deleted' AS BIGINT) AS removed, CAST(st = 'modified' AS BIGINT) AS modified,
CASE st WHEN 'created' THEN '0:added:-:t' WHEN 'deleted' THEN '0:removed:t:-' ELSE '0:modified:t:t' END AS diff FROM s WHERE st <> 'unchanged'""")
def f7_revisions(spark, d):
    old, new = (x.withColumn("chunk_index", F.lit(0)) for x in old_new(spark, d))
    line = lambda r: F.concat_ws(":", r["chunk_index"].cast("string"), r["kind"], F.coalesce(r["old_title"], F.lit("-")), F.coalesce(r["new_title"], F.lit("-")))
    return versions.revisions(old, new).withColumn("diff", F.array_join(F.transform("diff", line), "\n"))


@query(f"""SELECT source AS project_id, lpad(CAST(doc_id AS VARCHAR), 9, '0') AS path, {STATE} AS event, CASE WHEN doc_id % 11 <> 0 THEN sha256(text) END AS old_hash, CASE WHEN doc_id % 13 <> 0 THEN sha256(text || CASE WHEN doc_id % 7 = 0 THEN ' (new)' ELSE '' END) END AS new_hash
FROM documents WHERE (doc_id % 11 <> 0 OR doc_id % 13 <> 0) AND {STATE} <> 'unchanged'""")
def f7_scan_log(spark, d):
    return versions.scan_log(*old_new(spark, d))


@query("""SELECT source AS project_id, lpad(CAST(doc_id AS VARCHAR), 9, '0') AS path, length(CASE WHEN doc_id % 13 <> 0 THEN text || CASE WHEN doc_id % 7 = 0 THEN ' (new)' ELSE '' END ELSE text END) AS chars FROM documents WHERE doc_id % 11 <> 0 OR doc_id % 13 <> 0""")
def s7_replace(spark, d):
    old, new = old_new(spark, d)
    return ms.replaced(old, new).select("project_id", "path", F.length("text").cast("long").alias("chars"))


@query(f"""SELECT CAST(o_orderkey AS VARCHAR) AS source_id, '[冲突] ' || o_orderpriority AS title, 'high' AS priority FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 3 <> 0
UNION ALL SELECT project_id || '|' || title, '[伏笔] ' || title, 'medium' FROM ({SQL["a1_foreshadows"]}) WHERE risk_level = 'high'""")
def j10_tasks(spark, d):
    x = table(spark, d, "orders").select(F.lit("p").alias("project_id"), F.col("o_orderkey").alias("key"), F.col("o_orderkey").cast("string").alias("issue_id"), F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderpriority") == "1-URGENT", "high").otherwise("low").alias("severity"))
    fores = detectors.foreshadows(chunks_of(spark, d), P).withColumn("foreshadow_id", F.concat("project_id", F.lit("|"), "title"))
    return versions.auto_tasks(x, fores, x.where("key % 3 = 0").select(F.col("issue_id").alias("source_id"))).select("source_id", "title", "priority")


def docs_state(spark, d):
    return docs_of(spark, d).withColumn("deleted", F.col("path").cast("long") % 5 == 0)


@query(CH + """SELECT project_id, path, chunk_index, 'doc ' || path AS document_title FROM ch WHERE CAST(path AS BIGINT) % 5 <> 0""")
def j1_live_chunks(spark, d):
    return versions.live_chunks(chunks_of(spark, d), docs_state(spark, d)).select("project_id", "path", "chunk_index", "document_title")


@query(MEN + f"""SELECT r.project_id, kind, name, ch.path AS document_path, 'doc ' || ch.path AS document_title, ch.title AS chapter_title, substr(ch.content, 1, 80) AS snippet
FROM (SELECT project_id, node_type AS kind, name, first_chunk_id FROM ca UNION ALL SELECT project_id, 'foreshadow', title, first_chunk_id FROM ({SQL["a1_foreshadows"]})) r JOIN ch ON ch.chunk_id = r.first_chunk_id WHERE CAST(ch.path AS BIGINT) % 5 <> 0""")
def j2_evidence(spark, d):
    c = chunks_of(spark, d)
    nodes = mentions.candidates(mentions.mentions(c, P)).select("project_id", F.col("node_type").alias("kind"), "name", "first_chunk_id")
    fores = detectors.foreshadows(c, P).select("project_id", F.lit("foreshadow").alias("kind"), F.col("title").alias("name"), "first_chunk_id")
    return versions.with_evidence(nodes.unionByName(fores), c, docs_state(spark, d)).drop("first_chunk_id")


@query(f"""SELECT project_id, title, mentions, risk_level FROM ({SQL["a1_foreshadows"]}) ORDER BY mentions DESC, title, project_id LIMIT 100""")
def l2_foreshadows(spark, d):
    return versions.list_foreshadows(detectors.foreshadows(chunks_of(spark, d), P), 100, "mentions").select("project_id", "title", "mentions", "risk_level")


@query("""SELECT o_orderkey AS task_id, o_orderpriority AS title, CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS priority FROM orders
ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '3-MEDIUM' THEN 1 ELSE 2 END, o_orderkey DESC LIMIT 5000""")
def l4_tasks(spark, d):
    x = table(spark, d, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderpriority") == "1-URGENT", "high").when(F.col("o_orderpriority") == "3-MEDIUM", "medium").otherwise("low").alias("priority"))
    return versions.list_tasks(x, 5000, "task_id")


@query("""SELECT event_id, event_type, user_id FROM events ORDER BY event_id DESC LIMIT 200""")
def l5_newest(spark, d):
    return versions.newest(table(spark, d, "events").select("event_id", "event_type", "user_id"), 200, "event_id")


@query("""SELECT CAST(doc_id AS BIGINT) AS document_id, quality AS group_id, lpad(CAST(doc_id AS VARCHAR), 9, '0') AS path FROM labels JOIN documents USING (doc_id) WHERE doc_id % 13 <> 0 GROUP BY ALL""")
def j11_groups(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("path"), (F.col("doc_id") % 13 == 0).alias("deleted"))
    return versions.documents_by(table(spark, d, "labels").select(F.col("doc_id").alias("document_id"), F.col("quality").alias("group_id")), docs, "group_id")


@query("""SELECT user_id AS document_id, arg_max(event_type, event_id) AS volume_id FROM events GROUP BY 1""")
def j11_volumes(spark, d):
    return versions.latest_volume(table(spark, d, "events").select(F.col("user_id").alias("document_id"), F.col("event_type").alias("volume_id"), F.col("event_id").alias("seq")))


@query("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def j12_resume(spark, d):
    one = lambda t: table(spark, d, t).select(F.lit("p").alias("project_id"), F.col("doc_id").alias("path"))
    return versions.resume(one("documents"), one("labels")).select(F.col("path").alias("doc_id"))


@query("""WITH l AS (SELECT user_id, event_type, arg_max(value, event_id) AS v FROM events GROUP BY ALL) SELECT user_id, event_type, v AS value, CASE WHEN user_id % 2 = 0 THEN 'confirmed' ELSE 'open' END AS status FROM l""")
def u2_upsert(spark, d):
    ev = table(spark, d, "events")
    old = ev.where("user_id % 2 = 0").select("user_id", "event_type").distinct().select("user_id", "event_type", F.lit(0.0).alias("value"), F.lit("confirmed").alias("status"))
    return versions.upsert(old, ev.select("user_id", "event_type", "value", F.lit("open").alias("status"), F.col("event_id").alias("seq")), ["user_id", "event_type"])


@query("""SELECT doc_id, CASE WHEN quality IS NULL THEN 'candidate' WHEN quality = 1 THEN 'confirmed' ELSE 'discarded' END AS status FROM documents LEFT JOIN labels USING (doc_id)""")
def u5_status(spark, d):
    up = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "confirmed").otherwise("discarded").alias("status"))
    return versions.apply_status(table(spark, d, "documents").select("doc_id", F.lit("candidate").alias("status")), up, ["doc_id"])


@query("""SELECT event_id, event_type AS issue_type, props AS title FROM events WHERE starts_with(event_type, 'c') ORDER BY CASE WHEN value >= 90 THEN 0 WHEN value >= 50 THEN 1 ELSE 4 END, event_id DESC LIMIT 100""")
def l3_issues(spark, d):
    x = table(spark, d, "events").select("event_id", F.col("event_type").alias("issue_type"), F.col("props").alias("title"), F.when(F.col("value") >= 90, "serious").when(F.col("value") >= 50, "high").otherwise("info").alias("severity"))
    return versions.list_issues(x, 100, "c", "event_id").drop("severity")


def _queries(spark, d, words: int):
    text = F.array_join(F.slice(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "), 3, words), " ")
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), text.alias("query"))


FOLD = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
HITS = """, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY path, chunk_index, project_id) AS rank FROM h) SELECT query_id, CAST(rank AS INT) AS rank, project_id, path, chunk_index FROM r WHERE rank <= 5"""
QS = lambda n: f"""q AS (SELECT item_id AS query_id, array_to_string(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')[3:{2 + n}], ' ') AS query FROM benchmark)"""


@query(CH + f""", {QS(2)}, h AS (SELECT query_id, project_id, path, chunk_index FROM ch JOIN q ON contains({FOLD('content')}, {FOLD('query')}))""" + HITS)
def f4_search_substring(spark, d):
    return search.search_substring(chunks_of(spark, d), _queries(spark, d, 2), 5).select("query_id", "rank", "project_id", "path", "chunk_index")


NORM = lambda x: f"' ' || trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"


@query(CH + f""", {QS(2)}, p AS (SELECT *, {NORM("content")} AS ct, {NORM("title")} AS tt FROM ch), h0 AS (SELECT query_id, project_id, path, chunk_index FROM p JOIN (SELECT *, {NORM("query")} AS qq FROM q) ON contains(ct, qq) OR contains(tt, qq)),
h AS (SELECT * FROM h0 UNION ALL SELECT query_id, project_id, path, chunk_index FROM ch JOIN q ON contains({FOLD('content')}, {FOLD('query')}) WHERE query_id NOT IN (SELECT query_id FROM h0))""" + HITS)
def f5_search_phrase(spark, d):
    return search.search_phrase(chunks_of(spark, d), _queries(spark, d, 2), 5).select("query_id", "rank", "project_id", "path", "chunk_index")


@query(CH + f""", {QS(2)}, h AS (SELECT *, instr({FOLD('content')}, {FOLD('query')}) AS p FROM ch JOIN q ON contains({FOLD('content')}, {FOLD('query')})), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY path, chunk_index, project_id) AS rank FROM h),
k AS (SELECT *, greatest(1, p - 18) AS a, least(length(content), p + length(query) + 17) AS b FROM r WHERE rank <= 5),
t AS (SELECT *, regexp_replace(CASE WHEN a > 1 THEN '...' ELSE '' END || substr(content, a, b - a + 1) || CASE WHEN b < length(content) THEN '...' ELSE '' END, '[\\[\\]]', '', 'g') AS said FROM k)
SELECT q.query_id, '# 上下文包: ' || any_value(q.query) || chr(10) || chr(10) || coalesce(string_agg('## ' || rank || '. ' || title || chr(10) || chr(10) || '来源文件: ' || path || ' (' || (chunk_index + 1) || ', ' || start_offset || '-' || end_offset || ')' || chr(10) || chr(10) || said || chr(10), chr(10) ORDER BY rank), '没有找到相关内容。' || chr(10)) AS markdown,
count(rank) AS n_hits, coalesce(string_agg(chunk_id, ',' ORDER BY rank), '') AS refs FROM q LEFT JOIN t ON t.query_id = q.query_id GROUP BY 1""")
def s9_context_pack(spark, d):
    q = _queries(spark, d, 2)
    made = search.context_pack(search.search_substring(chunks_of(spark, d), q, 5), q)
    return made.select("query_id", "markdown", "n_hits", F.coalesce(F.array_join(F.transform("source_refs", lambda r: r["chunk_id"]), ","), F.lit("")).alias("refs"))


@query(MEN + f""", r AS (SELECT project_id, node_type AS section, -occurrence_count AS o, '- ' || name || ' ×' || occurrence_count AS line FROM ca UNION ALL SELECT project_id, 'foreshadow', -mentions, '- ' || title || ' ' || risk_level FROM ({SQL["a1_foreshadows"]})
 UNION ALL SELECT project_id, 'issue', 0, '- repeat_expression ' || title FROM ({SQL["a3_repeat_terms"]})),
n AS (SELECT *, row_number() OVER (PARTITION BY project_id, section ORDER BY o, line) AS n FROM r), b AS (SELECT project_id, section, string_agg(line, chr(10) ORDER BY n) AS body FROM n WHERE n <= 1000 GROUP BY ALL),
t AS (SELECT project_id, string_agg('## ' || section || chr(10) || chr(10) || body, chr(10) || chr(10) ORDER BY section) AS sections FROM b GROUP BY 1)
SELECT project_id, '# ' || project_id || chr(10) || chr(10) || documents || ' / ' || chunks || ' / ' || words || chr(10) || chr(10) || coalesce(sections, '') AS markdown FROM ({SQL["a15_summary"]}) LEFT JOIN t USING (project_id)""")
def s10_report(spark, d):
    c = chunks_of(spark, d)
    return search.project_report(metrics.project_summary(c), mentions.candidates(mentions.mentions(c, P)), detectors.foreshadows(c, P), detectors.repeat_terms(c, P))


@query(CH + """SELECT project_id, path, string_agg(chunk_index || ' ' || title, chr(10) ORDER BY chunk_index) AS chapters FROM ch GROUP BY 1, 2""")
def f9_tree(spark, d):
    t = search.document_tree(chunks_of(spark, d))
    return t.withColumn("chapters", F.array_join(F.transform("chapters", lambda c: F.concat_ws(" ", c["chunk_index"].cast("string"), c["title"])), "\n"))


@query("""SELECT event_type AS pack_name, count(*) AS entries, array_to_string(list_sort(list(DISTINCT CAST(user_id % 5 AS VARCHAR))), ',') AS dynasties, arg_min(props, event_id) AS pack_type FROM events GROUP BY 1""")
def s12_knowledge(spark, d):
    return ms.knowledge_summary(table(spark, d, "events").select(F.col("event_type").alias("pack_name"), (F.col("user_id") % 5).cast("string").alias("dynasty"), F.col("event_id").alias("row_no"), F.col("props").alias("category")))


@query(f"""WITH e AS (SELECT project_id, 'repeated_expression' AS issue_type, 1 AS n FROM ({SQL["a4_top_phrases"]}) GROUP BY 1 UNION ALL SELECT project_id, 'repeated_action', count(*) FROM ({SQL["a5_repeated_actions"]}) GROUP BY 1
UNION ALL SELECT project_id, 'repeated_dialogue', count(*) FROM ({SQL["a6_dialogue_patterns"]}) WHERE match_count >= 6 GROUP BY 1 UNION ALL SELECT project_id, 'repeated_psych_density', count(*) FROM ({PSY} SELECT * FROM ps) WHERE hits / chars >= 0.04 GROUP BY 1)
SELECT project_id, issue_type, CAST(n AS BIGINT) AS n FROM e""")
def x1_detectors(spark, d):
    """The repeat engine with all of its detectors but that of paragraphs, whose greedy groups are beyond SQL."""
    some = {k: f for k, f in detectors.REPEATED.items() if k != "similar_paragraph"}
    return detectors.run_detectors(chunks_of(spark, d), P, some).groupBy("project_id", "issue_type").agg(F.count("*").alias("n"))


@query()
def x1_repeat_engine(spark, d):
    return detectors.run_detectors(chunks_of(spark, d), P).groupBy("project_id", "issue_type").agg(F.count("*").alias("n"))


@query(f"""SELECT project_id, '[冲突] ' || title AS title, 'conflict' AS task_type, 'high' AS priority FROM ({SQL["a2_attribute_conflicts"]})
UNION ALL SELECT project_id, '[冲突] 打脸边际递减', 'conflict', 'high' FROM ({SQL["w4_diminishing_runs"]}) WHERE severity = 'high'
UNION ALL SELECT project_id, '[伏笔] ' || title, 'foreshadow', 'medium' FROM ({SQL["a1_foreshadows"]}) WHERE risk_level = 'high'""")
def x4_tasks_of_a_scan(spark, d):
    """The tasks of a whole scan: of its high issues and its high-risk foreshadows."""
    return analysis.analyze(chunks_of(spark, d), P)["tasks"].select("project_id", "title", "task_type", "priority")


#: Pieces of which Chinese texts are made, a piece for each word of a document (by its md5): what the zh pack looks for, and plain words.
PIECES = (
    "林澈说", "苏雨问道", "走进青石街", "拿起铜钥匙", "雨夜", "沉默", "秘密", "打脸", "挑衅", "手机", "碾压", "回忆起", "林公子", "推开门", "众人", "皇帝", "平民", "三天后", "贞观3年", "。", "。", "。", "魔法不能凭空造物", "却",
    "震惊", "突破", "青山", "似乎", "金丹", "炼气", "总觉得", "只有勇者才能取剑", "，", "。", "\n第一章 雨夜\n", "\n第二章\n", "天地之间", "风声", "向顾长安说", "日后", "县令", "丞相",
)
RE2 = replace(ZH, **{k: v.replace("\\p{IsHan}", "\\p{Han}").replace("(?i)", "(?i)") for k, v in ((k, getattr(ZH, k)) for k in ("heading", "place_pattern", "related", "prohibition", "prerequisite"))}, **{k: tuple(v.replace("\\p{IsHan}", "\\p{Han}") for v in getattr(ZH, k)) for k in ("person_patterns", "item_patterns")})


def zh_chunks(spark, d):
    """Chapters of the documents as Chinese texts."""
    piece = lambda w: F.element_at(tx.words_array(PIECES), (F.conv(F.substring(F.md5(w.cast("binary")), 1, 4), 16, 10).cast("int") % len(PIECES)) + 1)
    docs = docs_of(spark, d).where("text IS NOT NULL")
    return ms.chunks(docs.withColumn("text", F.array_join(F.transform(F.split("text", " ", -1), piece), "")), ZH)


ZH_DOCS = f"""d AS (SELECT source AS project_id, lpad(CAST(doc_id AS VARCHAR), 9, '0') AS path, array_to_string(list_transform(string_split(text, ' '), lambda w: {lst(p.replace(chr(10), "@") for p in PIECES)}[CAST('0x' || md5(w)[1:4] AS INT) % {len(PIECES)} + 1]), '') AS text FROM documents WHERE text IS NOT NULL),
d2 AS (SELECT project_id, path, replace(text, '@', chr(10)) AS text FROM d)"""
ZH_CH = CH.replace(DOCS, ZH_DOCS).replace(P.heading, RE2.heading).replace("FROM d)", "FROM d2)").replace("FROM d SEMI", "FROM d2 SEMI").replace("replace(text, '@', chr(10)) AS text FROM d2)", "replace(text, '@', chr(10)) AS text FROM d)")
ZH_SE = sentences_of(ZH, ZH_CH)


@query(ZH_CH + """SELECT project_id, path, chunk_index, title, sha256(content) AS content_hash FROM ch""")
def zh_chapters(spark, d):
    return zh_chunks(spark, d).select("project_id", "path", "chunk_index", "title", "content_hash")


@query(men(RE2, ZH_CH) + "SELECT project_id, node_type, name, occurrence_count, first_chunk_id, latest_chunk_id FROM ca")
def zh_candidates(spark, d):
    return mentions.candidates(mentions.mentions(zh_chunks(spark, d), ZH)).drop("confidence")


@query(fores(RE2, ZH_SE))
def zh_foreshadows(spark, d):
    return detectors.foreshadows(zh_chunks(spark, d), ZH).withColumn("related", F.array_join("related_nodes", ",")).drop("related_nodes")


@query(rules_of(RE2, ZH_CH) + """SELECT project_id, chunk_id AS source_chunk_id, name, description, positive FROM ru GROUP BY ALL""")
def zh_rules(spark, d):
    return story.extract_rules(zh_chunks(spark, d), ZH).select("project_id", "source_chunk_id", "name", "description", "positive")


@query(met(ZH, ZH_CH) + SQL["a10_densities"].removeprefix(MET))
def zh_densities(spark, d):
    x = metrics.densities(metrics.narrow(zh_chunks(spark, d), ZH))
    return x.select("project_id", *[F.round(c, 6).alias(c) for c in x.columns[1:]])


@query(SQL["w4_diminishing_runs"].replace(CH, ZH_CH).replace(anyof(P.setups), anyof(ZH.setups)).replace(anyof(P.reactions), anyof(ZH.reactions)).replace(nof(P.events), nof(ZH.events)))
def zh_diminishing_runs(spark, d):
    return checks.diminishing_runs(zh_chunks(spark, d), ZH)


def snapshots(spark, d):
    """Documents before and after: some come, some go, some get another text."""
    x = table(spark, d, "documents")
    path = F.lpad(F.col("doc_id").cast("string"), 9, "0")
    made = lambda rows, text: rows.select("doc_id", F.col("source").alias("project_id"), path.alias("path"), F.concat(F.lit("doc "), path).alias("title"), text.alias("text"))
    return made(x.where("doc_id % 11 != 0"), F.col("text")), made(x.where("doc_id % 13 != 0"), F.concat("text", F.when(F.col("doc_id") % 7 == 0, " (new)").otherwise("")))


OLD_DOCS = DOCS.replace("FROM documents)", "FROM documents WHERE doc_id % 11 <> 0)")
NEW_DOCS = DOCS.replace(", text FROM documents)", ", text || CASE WHEN doc_id % 7 = 0 THEN ' (new)' ELSE '' END AS text FROM documents WHERE doc_id % 13 <> 0)")
on_new = lambda sql: sql.replace(DOCS, NEW_DOCS)


def after_changes(spark, d):
    """The aggregates of the older snapshot, brought up to date from the changed documents."""
    old, new = snapshots(spark, d)
    g = deltas.state(spark, temporary(spark))
    first = ms.chunks(old, P)
    deltas.increment(g, 0, first.limit(0), first, P)
    deltas.increment(g, 1, ms.chunks(old.where("doc_id % 13 = 0 OR doc_id % 7 = 0"), P), ms.chunks(new.where("doc_id % 11 = 0 OR doc_id % 7 = 0"), P), P)
    return g


@query(on_new(SQL["m6_aliases"].replace("AS occurrence_count, coalesce(aliases", "AS occurrence_count, first_chunk_id, latest_chunk_id, coalesce(aliases")))
def x4_delta_candidates(spark, d):
    return deltas.candidates(after_changes(spark, d), P, length=5).select("project_id", "node_type", "name", "occurrence_count", "first_chunk_id", "latest_chunk_id", F.array_join("aliases", ",").alias("aliases"))


@query(on_new(SQL["a3_repeat_terms"]))
def x4_delta_terms(spark, d):
    return _terms(deltas.repeat_terms(after_changes(spark, d)))


@query(on_new(f"""SELECT a.*, flashbacks, events, coalesce(n, 0) AS issues FROM ({SQL["a10_densities"]}) a JOIN ({SQL["a17_flashbacks"]}) USING (project_id) LEFT JOIN (SELECT project_id, CAST(sum(n) AS BIGINT) AS n FROM ({SQL["a17_issue_counts"]}) GROUP BY 1) USING (project_id)"""))
def x4_delta_projects(spark, d):
    g = after_changes(spark, d)
    counts = deltas.issue_counts(g).groupBy("project_id").agg(F.sum("n").alias("issues"))
    x = deltas.densities(g).join(deltas.flashbacks(g), "project_id").join(counts, "project_id", "left").na.fill(0, ["issues"])
    return x.select("project_id", *[F.round(c, 6).alias(c) for c in ("pleasure_density", "conflict_density", "modern_density", "intensity", "chapter_avg_words")], "flashbacks", "events", "issues")


_BOTH = f"""SELECT project_id, 'repeat_expression' AS issue_type, title, description FROM ({SQL["a3_repeat_terms"]}) UNION ALL SELECT project_id, 'repeated_action', title, description FROM ({SQL["a5_repeated_actions"]})"""


@query(f"""WITH o AS ({_BOTH.replace(DOCS, OLD_DOCS)}), n AS ({on_new(_BOTH)})
SELECT coalesce(n.project_id, o.project_id) AS project_id, coalesce(n.issue_type, o.issue_type) AS issue_type, coalesce(n.title, o.title) AS title, coalesce(n.description, o.description) AS description, CASE WHEN o.issue_type = 'repeat_expression' THEN 'false_positive' ELSE 'open' END AS status
FROM o FULL JOIN n ON o.project_id = n.project_id AND o.issue_type = n.issue_type AND o.title = n.title""")
def u2_rescan(spark, d):
    """Issues after a scan, a user's decisions and a scan of the changed documents: what was decided stays, whatever the counts say now."""
    old, new = snapshots(spark, d)
    state, quiet = analysis.results(spark, temporary(spark)), Profile(people=False, places=False, items=False, foreshadows=False, eye_colours=False)
    how = {"detector_list": {"a": detectors.repeated_actions}}
    analysis.scan(state, 0, ms.chunks(old, P), P, (quiet,), **how)
    decided = state.read("issues").where("issue_type = 'repeat_expression'")
    analysis.set_statuses(state, 1, "issues", decided.select(*analysis.TABLES["issues"].key, F.lit("false_positive").alias("status")))
    return analysis.scan(state, 2, ms.chunks(new, P), P, (quiet,), **how)["issues"].select("project_id", "issue_type", "title", "description", "status")


def file_events(ev: DataFrame) -> DataFrame:
    return ev.select(F.lit("p").alias("project_id"), F.concat(F.col("user_id").cast("string"), F.when(F.col("event_type") == "view", ".swp").otherwise(".txt")).alias("path"), F.col("ts").cast("timestamp").alias("ts"))


@query("""WITH e AS (SELECT user_id || '.txt' AS path, CAST(ts AS TIMESTAMP) AS ts FROM events WHERE event_type <> 'view'),
f AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY path ORDER BY ts)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM f)
SELECT 'p' AS project_id, path, epoch_us(min(ts)) AS started_us, count(*) AS n_events FROM g GROUP BY path, k""")
def t2_debounce(spark, d):
    x = changes.debounced(changes.watched(file_events(table(spark, d, "events"))), "1 hour")
    return x.select("project_id", "path", F.unix_micros("started").alias("started_us"), "n_events")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return l1_top_candidates(spark, sf_dir)
