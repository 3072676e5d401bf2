"""Aggregates of a project kept up to date from its changed chunks alone.

Three tables last between batches (see state()). `facts` is a log of what each chunk says: a name's mentions, a term, an alias;
what a removed chunk said comes in once more with the opposite sign, so the log adds up to what the live chunks say. `totals` are
sums per project, to which signed sums are added. `names` are the aggregates per name: counts change by signed sums, first and
latest chunk and the first pieces of evidence are taken over where a batch can only have moved them outwards, and are worked out
again from the log for those names alone that lost a chunk which they name. No chunk that did not change is read.

Only removed and added chunks come in: chunks of documents that a batch deleted, created or modified (their text as it was, their
text as it is). Chunks that stayed as they were may be among both and say nothing. Null projects, titles and texts are kept apart
from all others. Empty batches change nothing; a batch that is repeated changes nothing.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import snippet
from ..operators import detectors, mentions, metrics
from ..packs import Pack, Profile
from ..sources.generations import Generations, Kept, matches
from ..stored import stored

KEY = ("kind", "project_id", "name")
#: Where a fact stands.
AT = ("path", "chunk_index", "chunk_id")
#: What a fact of a term shows as evidence.
SHOWN = ("title", "said")
PLACE = "struct<path:string,chunk_index:long,chunk_id:string>"
SHOW = "struct<path:string,chunk_index:long,chunk_id:string,title:string,said:string>"
TOTALS = ("chunks", "chars", "pleasure", "conflict", "modern", "weight", "flashbacks")
TABLES = {
    "facts": Kept("kind string, project_id string, name string, path string, chunk_index long, chunk_id string, title string, said string, n long", (*KEY, *AT, *SHOWN), KEY, ("n",)),
    "names": Kept(f"kind string, project_id string, name string, n long, chunks long, first {PLACE}, latest {PLACE}, shown array<{SHOW}>", KEY),
    "totals": Kept("project_id string, chunks long, chars long, pleasure long, conflict long, modern long, weight double, flashbacks long", ("project_id",), (), TOTALS),
}


def state(spark: SparkSession, folder: str, buckets: int = 16) -> Generations:
    """The tables in a folder. buckets: into so many parts names are dealt; a batch opens those of its own names. It must stay what it was at first."""
    return Generations(spark, folder, {k: replace(t, buckets=buckets) for k, t in TABLES.items()})


def facts(chunks: DataFrame, pack: Pack, profile: Profile = Profile()) -> DataFrame:
    """(kind, project_id, name, place, title and text of evidence, n = 1) of everything that the chunks say."""
    bare = [F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("said"), F.lit(1).cast("long").alias("n")]
    out = mentions.alias_hits(chunks, pack).select(F.lit("alias").alias("kind"), "project_id", F.col("alias").alias("name"), *AT, *bare)
    if profile.kinds:
        out = out.unionByName(mentions.mentions(chunks, pack, profile.kinds).select(F.col("node_type").alias("kind"), "project_id", "name", *AT, *bare))
    for kind, terms, piece in (("term", pack.watched, snippet), ("action", pack.verbs, detectors.around_term)):
        e = F.col("evidence")
        rows = detectors.term_hits(chunks, terms, piece)
        out = out.unionByName(rows.select(F.lit(kind).alias("kind"), "project_id", F.col("term").alias("name"), e["path"].alias("path"), e["chunk_index"].alias("chunk_index"), e["e"]["chunk_id"].alias("chunk_id"), e["e"]["chapter_title"].alias("title"), e["e"]["snippet"].alias("said"), bare[-1]))
    return out


def totals(chunks: DataFrame, pack: Pack) -> DataFrame:
    narrow = metrics.narrow(chunks, pack)
    flags = chunks.select("project_id", F.col("content").rlike(pack.flashback).cast("long").alias("flashbacks")).groupBy("project_id").agg(F.sum("flashbacks").alias("flashbacks"))
    sums = narrow.groupBy("project_id").agg(F.count("*").alias("chunks"), *[F.sum(c).alias(c) for c in TOTALS[1:-1]])
    return sums.join(flags, sums["project_id"].eqNullSafe(flags["project_id"])).select(sums["project_id"], *TOTALS)


def changed(removed: DataFrame, added: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both without the chunks that are the same on either side."""
    same = ("project_id", "path", "chunk_index", "chunk_id", "title", "content_hash")

    def less(rows: DataFrame, other: DataFrame) -> DataFrame:
        known = other.select(*[F.col(c).alias(f"__{c}") for c in same])
        return rows.join(known, [rows[c].eqNullSafe(known[f"__{c}"]) for c in same], "left_anti")

    return less(removed, added), less(added, removed)


def _first(rows: DataFrame, most: int = detectors.EVIDENCE_OF_TERM) -> DataFrame:
    """(key, shown: the first pieces of evidence) of rows (key, show); no more than these are gathered."""
    place = W.partitionBy(*KEY).orderBy("show")
    return rows.withColumn("i", F.row_number().over(place)).where(F.col("i") <= most).groupBy(*KEY).agg(F.array_sort(F.collect_list("show")).alias("shown"))


def _struct(columns: tuple[str, ...]) -> Column:
    return F.struct(*columns)


def increment(g: Generations, batch: int, removed: DataFrame, added: DataFrame, pack: Pack, profile: Profile = Profile()) -> bool:
    """Brings the tables up to date with a batch; False if that was done before. A first batch adds all chunks."""
    if batch in g.batches():
        return False
    removed, added = (stored(x) for x in changed(removed, added))
    signed = facts(removed, pack, profile).withColumn("n", -F.col("n")).unionByName(facts(added, pack, profile))
    signed = stored(signed.groupBy(*KEY, *AT, *SHOWN).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("n") < 0, -F.col("n")).otherwise(0)).alias("was"), F.sum(F.when(F.col("n") > 0, F.col("n")).otherwise(0)).alias("now")))
    # what a chunk said of a name before and says now; a term's evidence changes with its text
    per_chunk = signed.groupBy(*KEY, *AT).agg(F.sum("was").alias("was"), F.sum("now").alias("now"), F.max(F.when(F.col("now") > 0, _struct(SHOWN))).alias("new"), F.max(F.when(F.col("was") > 0, _struct(SHOWN))).alias("old"))
    per_chunk = stored(per_chunk.withColumn("gone", (F.col("was") > 0) & ((F.col("now") == 0) | ~F.col("new").eqNullSafe(F.col("old")))).withColumn("show", F.struct(*AT, "new.title", "new.said")))
    moved = per_chunk.groupBy(*KEY).agg(F.sum(F.col("now") - F.col("was")).alias("dn"), F.sum((F.col("now") > 0).cast("long") - (F.col("was") > 0).cast("long")).alias("dchunks"), F.min(F.when(F.col("now") > 0, _struct(AT))).alias("low"), F.max(F.when(F.col("now") > 0, _struct(AT))).alias("high"))
    old = stored(g.read("names", keys=moved, before=batch))
    both = moved.join(old, matches(moved, old, KEY), "left").select(*[moved[k] for k in KEY], "dn", "dchunks", "low", "high", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("chunks", F.lit(0)).alias("chunks"), "first", "latest", "shown")
    both = stored(both)
    # names that lost a chunk which they name are worked out again from the log
    gone = per_chunk.where("gone").select(*KEY, _struct(AT).alias("at"))
    named = F.col("at").eqNullSafe(F.col("first")) | F.col("at").eqNullSafe(F.col("latest")) | F.exists(F.coalesce("shown", F.array()), lambda s: F.struct(*[s[c].alias(c) for c in AT]).eqNullSafe(F.col("at")))
    broken = stored(both.join(gone, matches(both, gone, KEY)).where(named).select(*[both[k] for k in KEY]).distinct())
    log = g.read("facts", keys=broken, before=batch)
    here = signed.where("n != 0").join(broken, matches(signed, broken, KEY), "left_semi").select(*log.columns)
    said = stored(log.unionByName(here).groupBy(*KEY, *AT, *SHOWN).agg(F.sum("n").alias("n")).where("n > 0"))
    again = said.groupBy(*KEY).agg(F.min(_struct(AT)).alias("first2"), F.max(_struct(AT)).alias("latest2"))
    terms = F.col("kind").isin("term", "action")
    again_shown = _first(said.where(terms).select(*KEY, F.struct(*AT, *SHOWN).alias("show"))).withColumnRenamed("shown", "shown2")
    more_shown = _first(per_chunk.where(terms & (F.col("now") > 0)).select(*KEY, "show")).withColumnRenamed("shown", "gained")
    marked = _left(_left(_left(_left(both, broken.withColumn("broken", F.lit(True))), again), again_shown), more_shown)
    worked = F.coalesce("broken", F.lit(False))
    none = F.array().cast(f"array<{SHOW}>")
    taken = F.slice(F.array_sort(F.array_distinct(F.concat(F.coalesce("shown", none), F.coalesce("gained", none)))), 1, detectors.EVIDENCE_OF_TERM)
    names = marked.select(
        *KEY, (F.col("n") + F.col("dn")).alias("n"), (F.col("chunks") + F.col("dchunks")).alias("chunks"),
        F.when(worked, F.col("first2")).otherwise(F.least("first", "low")).alias("first"), F.when(worked, F.col("latest2")).otherwise(F.greatest("latest", "high")).alias("latest"),
        F.when(worked, F.coalesce("shown2", none)).otherwise(taken).alias("shown"),
    )
    minus = totals(removed, pack).select("project_id", *[(-F.col(c)).alias(c) for c in TOTALS])
    return g.commit(batch, facts=signed.where("n != 0").select(*log.columns), names=names, totals=minus.unionByName(totals(added, pack)).groupBy("project_id").agg(*[F.sum(c).alias(c) for c in TOTALS]))


def _left(rows: DataFrame, more: DataFrame) -> DataFrame:
    renamed = more.select(*[F.col(k).alias(f"__{k}") for k in KEY], *[c for c in more.columns if c not in KEY])
    return rows.join(renamed, [rows[k].eqNullSafe(renamed[f"__{k}"]) for k in KEY], "left").drop(*[f"__{k}" for k in KEY])


# ---- what the tables say ----


def candidates(g: Generations, pack: Pack, length: int = 2) -> DataFrame:
    """As mentions.merge_aliases() of all live chunks."""
    names = g.read("names").where("chunks > 0")
    cands = names.where(~F.col("kind").isin("alias", "term", "action")).select("project_id", F.col("kind").alias("node_type"), "name", F.col("n").alias("occurrence_count"), F.col("first.chunk_id").alias("first_chunk_id"), F.col("latest.chunk_id").alias("latest_chunk_id"))
    return mentions.with_aliases(cands.withColumn("confidence", mentions.confidence()), names.where("kind = 'alias'").select("project_id", F.col("name").alias("alias"), F.col("chunks").alias("n")), pack, length)


def repeat_terms(g: Generations, least: int = detectors.LEAST_TERMS) -> DataFrame:
    """As detectors.repeat_terms() of all live chunks."""
    none = F.lit(None).cast("int").alias("match_count")
    shown = F.transform("shown", lambda s: F.struct(s["chunk_id"].alias("chunk_id"), s["title"].alias("chapter_title"), s["path"].alias("document_path"), s["said"].alias("snippet"), none))
    return detectors.term_issues(g.read("names").where((F.col("kind") == "term") & (F.col("chunks") >= least)).select("project_id", F.col("name").alias("term"), shown.alias("evidence")))


def issue_counts(g: Generations, terms: int = detectors.LEAST_TERMS, actions: int = detectors.LEAST_ACTIONS) -> DataFrame:
    """As metrics.issue_counts() of repeated terms and actions."""
    kinds = F.when((F.col("kind") == "term") & (F.col("chunks") >= terms), "repeat_expression").when((F.col("kind") == "action") & (F.col("chunks") >= actions), "action")
    return metrics.issue_counts(g.read("names").select("project_id", kinds.alias("issue_type")).where("issue_type IS NOT NULL"))


def densities(g: Generations) -> DataFrame:
    """As metrics.densities() of all live chunks."""
    per = lambda c: F.when(F.col("chars") > 0, F.col(c) * 1000.0 / F.col("chars")).otherwise(0.0)
    return g.read("totals").where("chunks > 0").select("project_id", per("pleasure").alias("pleasure_density"), per("conflict").alias("conflict_density"), per("modern").alias("modern_density"), per("weight").alias("intensity"), (F.col("chars") / F.col("chunks")).alias("chapter_avg_words"))


def flashbacks(g: Generations) -> DataFrame:
    """As metrics.flashbacks() of the timeline of all live chunks."""
    return g.read("totals").where("chunks > 0").select("project_id", "flashbacks", F.col("chunks").alias("events"))


def tables(g: Generations, pack: Pack, length: int = 2) -> dict[str, DataFrame]:
    return {"candidates": candidates(g, pack, length), "repeat_terms": repeat_terms(g), "issue_counts": issue_counts(g), "densities": densities(g), "flashbacks": flashbacks(g)}
