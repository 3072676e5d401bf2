"""Whole analyses: full scan and incremental scan, composed of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..messages import MESSAGES, issue
from ..operators import checks, detectors, mentions, metrics, story, versions
from ..operators.extractors import Extractor, chosen, extracted
from ..packs import Pack, Profile, merged
from ..sources.generations import Generations, Kept
from ..stored import stored
from . import deltas

CLOSED = ("false_positive", "discarded", "resolved", "intentional")
#: The tables of a scan that last: by their key a later scan knows a row again; status and created_at stay, and of a candidate its first chunk.
TABLES = {
    "candidates": Kept("project_id string, node_type string, name string, occurrence_count long, first_chunk_id string, latest_chunk_id string, confidence long, aliases array<string>, status string, created_at timestamp", ("project_id", "node_type", "name")),
    "foreshadows": Kept("project_id string, title string, mentions long, first_chunk_id string, latest_chunk_id string, related_nodes array<string>, risk_level string, evidence string, foreshadow_id string, status string, created_at timestamp", ("project_id", "title", "first_chunk_id")),
    "issues": Kept(f"project_id string, issue_type string, severity string, title string, description string, suggested_actions array<string>, subject string, evidence {detectors.EVIDENCE}, issue_id string, status string, created_at timestamp", ("project_id", "issue_type", "title", "subject")),
    "rules": Kept("project_id string, source_chunk_id string, name string, keywords array<string>, positive boolean, description string, rule_type string, confidence int, status string, created_at timestamp", ("project_id", "name", "source_chunk_id")),
    "tasks": Kept("source_id string, project_id string, title string, task_type string, priority string, status string, created_at timestamp", ("source_id",)),
}
FRESH = {"candidates": "candidate", "foreshadows": "candidate", "issues": "open", "rules": "candidate", "tasks": "open"}


def results(spark: SparkSession, folder: str) -> Generations:
    """The lasting tables of scans in a folder."""
    return Generations(spark, folder, TABLES)


def known(name: str, made: DataFrame, prior: dict[str, DataFrame], now: Column | None = None) -> DataFrame:
    """made with status and created_at: what the prior table of that name has for the row's key, else a new row's. A candidate keeps its first chunk."""
    now = F.current_timestamp() if now is None else now
    made = made.drop("status", "created_at")
    if name not in prior:
        return made.withColumn("status", F.lit(FRESH[name])).withColumn("created_at", now)
    key, rows = TABLES[name].key, prior[name]
    kept = {"status": F.lit(FRESH[name]), "created_at": now} | ({"first_chunk_id": F.col("first_chunk_id")} if name == "candidates" else {})
    old = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in key]).agg(*[(F.max(c) if c in rows.columns else F.lit(None)).alias(f"__old_{c}") for c in kept])
    same = [made[k].eqNullSafe(old[f"__{k}"]) for k in key]
    both = made.join(old, same, "left").withColumns({c: F.coalesce(f"__old_{c}", fresh) for c, fresh in kept.items()})
    return both.select(*dict.fromkeys([*made.columns, *kept]))


def _piece(text: Column, path: Column | None = None) -> Column:
    """Evidence of a check: one line, and the document where it has one."""
    none = F.lit(None).cast("string")
    return F.array(F.struct(none.alias("chunk_id"), none.alias("chapter_title"), (none if path is None else path).alias("document_path"), text.alias("snippet"), F.lit(None).cast("int").alias("match_count")))


def check_issues(kind: str, rows: DataFrame) -> DataFrame:
    """The rows of a check as issues."""
    c = F.col
    place = F.concat_ws("|", "path", c("chunk_index").cast("string")) if "path" in rows.columns else F.lit("")
    title: tuple[Column, ...] = ()
    described: tuple[Column, ...] = ()
    subject, line, path = F.lit(""), F.lit(MESSAGES[kind].title), None
    if kind == "power_regression":
        line = c("lines")
    elif kind == "low_streak":
        line = F.format_string("%d", "ends_at")
    elif kind in ("anachronisms", "place_name_anachronisms"):
        word = c("word" if kind == "anachronisms" else "period")
        described, subject, line, path = (word,), F.concat_ws("|", place, word), word, c("path")
    elif kind == "identity_conflicts":
        subject, line = c("name"), F.format_string("「%s」身份地位冲突: %s", "name", "tiers")
    elif kind == "rank_conflicts":
        subject, line = F.concat_ws("|", "name", "tier"), F.format_string("「%s」同时关联%s和之前章节的%s", "name", "tier", "before")
    elif kind == "diminishing_runs":
        line, path = F.format_string("%d", "length"), c("path")
    elif kind == "chapter_length_anomaly":
        described = (c("chapter"), c("chars").cast("double"), c("mean"), c("chars") / c("mean"))
        line, path = F.format_string("章节%d: %d字, 平均%d字", "chapter", "chars", c("mean").cast("int")), c("path")
    severity = c("severity") if "severity" in rows.columns else None
    return rows.select("project_id", *issue(kind, title=title, description=described, severity=severity, subject=subject), _piece(line, path).alias("evidence"))


def rule_issues(rows: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    said = F.array(F.struct("chunk_id", none.alias("chapter_title"), F.col("path").alias("document_path"), "snippet", F.lit(None).cast("int").alias("match_count")))
    return rows.select("project_id", *issue("rule_conflict", title=(F.col("rule"),), description=(F.col("rule"), F.array_join("keywords", ", ")), subject=F.col("chunk_id")), said.alias("evidence"))


def analyze(chunks: DataFrame, pack: Pack, profiles: tuple[Profile, ...] = (Profile(checks=tuple(checks.CHECKS)),), prior: dict[str, DataFrame] | None = None, detector_list: dict | None = None, terms: tuple[str, ...] = (), now: Column | None = None, extractors: dict[str, Extractor] | None = None) -> dict[str, DataFrame]:
    """All result tables of a full scan, by name. The chunks are stored once and read by every operator.

    prior: tables of the scan before (candidates, foreshadows, issues, rules, tasks): rows whose key is known keep status and
    created_at; issues that have a task, or are closed, get no other; rules that have become active there are held against the
    chunks. terms: a period's, for period checks. extractors: what finds candidates, foreshadows and issues; those that the profiles switch on unless given.
    """
    prior, profile = prior or {}, merged(profiles)
    chunks = stored(chunks)
    live = extractors if extractors is not None else chosen(profile)
    found = extracted("mentions", live, chunks, pack)
    cands = known("candidates", mentions.merge_aliases(mentions.candidates(found), chunks, pack), prior, now)
    fores = extracted("foreshadows", live, chunks, pack)
    fores = known("foreshadows", fores.withColumn("foreshadow_id", F.sha2(F.concat_ws("|", "project_id", "title", "first_chunk_id"), 256)), prior, now)
    rules = known("rules", story.extract_rules(chunks, pack), prior, now)
    conflicts = story.rule_conflicts(chunks, rules, pack)
    rows = {k: checks.run_check(k, chunks, pack, MESSAGES[k].severity, terms) for k in profile.checks}
    issues = detectors.run_detectors(chunks, pack, detector_list)
    for more in [extracted("issues", live, chunks, pack), rule_issues(conflicts), *[check_issues(k, r) for k, r in rows.items()]]:
        issues = issues.unionByName(more)
    issues = stored(known("issues", issues.withColumn("issue_id", F.sha2(F.concat_ws("|", "project_id", "issue_type", "title", "subject"), 256)), prior, now))
    done = prior["tasks"].select("source_id") if "tasks" in prior else issues.limit(0).select(F.col("issue_id").alias("source_id"))
    timeline = story.with_mentions(story.timeline_events(chunks, pack), found)
    open_ones = lambda x: x.where(~F.col("status").isin(*CLOSED))
    tasks = versions.auto_tasks(open_ones(issues), open_ones(fores), done).withColumn("status", F.lit(FRESH["tasks"])).withColumn("created_at", F.current_timestamp() if now is None else now)
    return {
        "candidates": cands, "foreshadows": fores, "issues": issues, "rules": rules, "rule_conflicts": conflicts, "timeline": timeline, "metrics": metrics.metrics(chunks, pack),
        "issue_counts": metrics.issue_counts(issues), "flashbacks": metrics.flashbacks(timeline), "tasks": tasks, **rows,
    }


def scan(state: Generations, batch: int, chunks: DataFrame, pack: Pack, profiles: tuple[Profile, ...] = (Profile(checks=tuple(checks.CHECKS)),), **more) -> dict[str, DataFrame]:
    """A full scan whose results last: analyze() against the tables as batches before this one left them, and its rows merged into them by key.

    Rows that the scan no longer finds stay, as users may have worked on them. The tables change together or not at all; a batch
    that is repeated changes nothing. Returns all tables: those that last as they are now, the others of this scan.
    """
    prior = {name: state.read(name, before=batch) for name in TABLES} if state.manifest(batch)["runs"] else {}
    made = analyze(chunks, pack, profiles, prior, **more)
    state.commit(batch, **{name: one_per_key(name, made[name]) for name in TABLES})
    return made | {name: state.read(name) for name in TABLES}


def one_per_key(name: str, rows: DataFrame) -> DataFrame:
    """One row of each key: findings that say the same in one place are one."""
    key = TABLES[name].key
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min(F.struct(*rest)).alias("x")).select(*[c if c in key else F.col(f"x.{c}").alias(c) for c in rows.columns])


def set_statuses(state: Generations, batch: int, name: str, updates: DataFrame) -> bool:
    """A user's decisions as a batch of their own. updates: the table's key and status; unknown keys change nothing."""
    rows = state.read(name, keys=updates, before=batch)
    return state.commit(batch, **{name: versions.apply_status(rows, updates, list(TABLES[name].key)).select(*rows.columns)})


def incremental(old_docs: DataFrame, listing: DataFrame, old_chunks: DataFrame, new_chunks: DataFrame, prior: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """States of documents, revisions, the scan log, impact and its tasks; new_chunks are those of created and modified documents. deltas.increment() brings the tables of a project up to date from what it returns."""
    states = versions.classify_documents(old_docs, listing)
    touched = states.where("state IN ('created', 'modified', 'deleted')").select("project_id", "path")
    old = old_chunks.join(touched, ["project_id", "path"], "left_semi")
    impact = versions.revision_impact(versions.removed_chunks(old, new_chunks), prior["candidates"], prior["foreshadows"], prior["rules"])
    return {"states": states, "log": versions.scan_log(old_docs.where("NOT deleted"), listing), "revisions": versions.revisions(old, new_chunks), "impact": impact, "tasks": versions.impact_tasks(impact), "removed": old, "added": new_chunks}


def incremental_scan(state: Generations, batch: int, old_docs: DataFrame, listing: DataFrame, old_chunks: DataFrame, new_chunks: DataFrame, prior: dict[str, DataFrame], pack: Pack, profile: Profile = Profile()) -> dict[str, DataFrame]:
    """incremental(), and the aggregates (candidates, repeated terms, densities, counts) brought up to date from the changed chunks alone. state: deltas.state()."""
    made = incremental(old_docs, listing, old_chunks, new_chunks, prior)
    deltas.increment(state, batch, made["removed"], made["added"], pack, profile)
    return made | deltas.tables(state, pack)
