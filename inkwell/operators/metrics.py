"""Project metrics. Per-chunk flags and lengths come from one pass over the text; the rest works on narrow rows."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_of, occurrences, present
from ..packs import Pack, Profile
from .mentions import KIND_HITS
from .order import numbered, segmented


def count_of(terms: tuple[str, ...]) -> Column:
    return F.size(present("content", terms)).cast("long")


def narrow(chunks: DataFrame, pack: Pack, extra: list[Column] = []) -> DataFrame:
    weight = sum((F.when(F.contains("content", F.lit(k)), w).otherwise(0.0) for k, w in pack.weights.items()), F.lit(0.0))
    return chunks.select("project_id", "path", "chunk_index", "chunk_id", F.length("content").cast("long").alias("chars"), count_of(pack.pleasure).alias("pleasure"), count_of(pack.conflict).alias("conflict"), count_of(pack.modern).alias("modern"), weight.alias("weight"), any_of("content", pack.upgrade).alias("upgrade"), (count_of(pack.events) + count_of(pack.conflict)).alias("busy"), *extra)


def per_thousand(x: Column) -> Column:
    return F.when(F.sum("chars") > 0, x * 1000.0 / F.sum("chars")).otherwise(0.0)


def densities(rows: DataFrame) -> DataFrame:
    return rows.groupBy("project_id").agg(per_thousand(F.sum("pleasure")).alias("pleasure_density"), per_thousand(F.sum("conflict")).alias("conflict_density"), per_thousand(F.sum("modern")).alias("modern_density"), per_thousand(F.sum("weight")).alias("intensity"), F.avg("chars").alias("chapter_avg_words"))


def in_order(rows: DataFrame) -> DataFrame:
    """narrow() rows with n, their 1-based place in the project; stored, so that several metrics can read them."""
    return rows if "n" in rows.columns else numbered(segmented(rows))


def keyword_interval(rows: DataFrame, flag: str = "upgrade") -> DataFrame:
    """Mean distance in chapters between chunks with the flag (from the first to the last of them, by their number less one); without two of them, the number of chunks."""
    at, k = F.when(F.col(flag), F.col("n")), F.count_if(F.col(flag))
    made = in_order(rows).groupBy("project_id").agg(F.when(k >= 2, (F.max(at) - F.min(at)) / (k - 1)).otherwise(F.count("*").cast("double")).alias("upgrade_interval"))
    return made


def pacing_flatness(rows: DataFrame, window: int = 5, keywords: str = "busy") -> DataFrame:
    """Share of full windows with under two keyword hits and over 1.5 times the mean length.

    A chunk counts in the windows that end at it and at the next few, so windows are groups by their end and no task holds a project.
    """
    x = in_order(rows)
    ends = x.select("project_id", F.explode(F.sequence("n", F.col("n") + window - 1)).alias("end"), F.col(keywords).alias("k"), "chars")
    full = ends.groupBy("project_id", "end").agg(F.count("*").alias("c"), F.sum("k").alias("k"), F.sum("chars").alias("len")).where(F.col("c") == window)
    means = x.groupBy("project_id").agg(F.avg("chars").alias("mean"))
    both = means.join(full, means["project_id"].eqNullSafe(full["project_id"]), "left").select(means["project_id"], "mean", "k", "len")
    flat, windows = F.count_if((F.col("k") < 2) & (F.col("len") > 1.5 * window * F.col("mean"))), F.count("len")
    return both.groupBy("project_id").agg(F.when(windows > 0, flat / windows).otherwise(0.0).alias("pacing_flatness"))


def entity_density(chunks: DataFrame, mentions: DataFrame) -> DataFrame:
    size = chunks.groupBy("project_id").agg(F.sum(F.length("content")).alias("chars"))
    found = mentions.groupBy("project_id", "node_type").agg(F.count("*").alias("n"))
    return found.join(size, "project_id").select("project_id", "node_type", (F.col("n") * 1000.0 / F.col("chars")).alias("density"))


def knowledge_density(chunks: DataFrame, terms: tuple[str, ...]) -> DataFrame:
    """Occurrences of a knowledge pack's terms per 1000 characters."""
    hits = sum((occurrences("content", t) for t in terms), F.lit(0).cast("long"))
    return chunks.select("project_id", F.length("content").cast("long").alias("chars"), hits.alias("hits")).groupBy("project_id").agg(per_thousand(F.sum("hits")).alias("knowledge_density"))


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("project_id", "issue_type").agg(F.count("*").alias("n"))


def flashbacks(timeline: DataFrame) -> DataFrame:
    return timeline.groupBy("project_id").agg(F.count_if("is_flashback").alias("flashbacks"), F.count("*").alias("events"))


UNITS = {"pleasure_density": "per_1000_chars", "conflict_density": "per_1000_chars", "modern_density": "per_1000_chars", "intensity": "per_1000_chars", "chapter_avg_words": "chars", "upgrade_interval": "chapters", "pacing_flatness": "ratio"}


def metrics(chunks: DataFrame, pack: Pack) -> DataFrame:
    """(project_id, metric_type, value, unit), long."""
    rows = in_order(narrow(chunks, pack))
    wide = densities(rows).join(keyword_interval(rows), "project_id").join(pacing_flatness(rows), "project_id")
    unit = F.create_map(*[F.lit(v) for kv in UNITS.items() for v in kv])
    return wide.unpivot("project_id", list(UNITS), "metric_type", "value").withColumn("unit", unit[F.col("metric_type")])


@dataclass(frozen=True)
class Metric:
    """A metric that a profile asks for, by the name that KINDS knows."""

    metric_type: str
    profile_id: str = ""
    name: str = ""
    description: str = ""
    weight: float = 1.0


# What each metric is made of (lexicons by their name in the pack) and its unit.
KINDS = {
    "爽点密度": ("keywords", "pleasure", "per_1000_chars"),
    "冲突频次": ("keywords", "conflict", "per_1000_chars"),
    "时代穿帮风险": ("keywords", "modern", "per_1000_chars"),
    "打脸强度": ("keywords", "weight", "per_1000_chars"),
    "知识密度": ("knowledge", "", "per_1000_chars"),
    "人物密度": ("mentions", "person", "per_1000_chars"),
    "地名密度": ("mentions", "place", "per_1000_chars"),
    "升级间隔": ("interval", "upgrade", "chapters"),
    "节奏平缓风险": ("flatness", "busy", "ratio"),
    "章节平均字数": ("length", "", "chars"),
}


def load_metrics(paths: list[str]) -> tuple[Metric, ...]:
    """The metrics of profiles/<id>/metrics.toml files, in their order; those of a kind that nothing computes are left out."""
    out = []
    for p in paths:
        with open(p, "rb") as f:
            entries = tomllib.load(f).get("metrics", [])
        profile = p.rsplit("/", 2)[-2] if "/" in p else ""
        out += [Metric(e["id"], profile, e.get("name", ""), e.get("description", ""), float(e.get("weight", 1.0))) for e in entries if e["id"] in KINDS]
    return tuple(out)


def profile_metrics(chunks: DataFrame, pack: Pack, wanted: tuple[Metric, ...], profile: Profile = Profile(), terms: tuple[str, ...] = ()) -> DataFrame:
    """(project_id, profile_id, metric_type, value, unit), long: the wanted metrics and no others, from one pass over the texts.

    The definitions are compiled: each kind that occurs adds its column to the narrow rows and its sum to the one aggregation by
    project; only interval and flatness put the narrow rows in order. A weight multiplies what is per 1000 characters. terms: a
    knowledge pack's. Mentions of kinds that the profile has switched off count as none.
    """
    kinds = {m.metric_type: KINDS[m.metric_type] for m in wanted}
    if not kinds:
        return chunks.sparkSession.createDataFrame([], "project_id string, profile_id string, metric_type string, value double, unit string")
    found = {k: F.size(KIND_HITS[k]("content", pack)) if v in profile.kinds else F.lit(0) for k, v in (("person", "people"), ("place", "places"))}
    extra = [found[x].cast("long").alias(x) for x in sorted({x for kind, x, _ in kinds.values() if kind == "mentions"})]
    if any(kind == "knowledge" for kind, _, _ in kinds.values()):
        extra.append(sum((occurrences("content", t) for t in terms), F.lit(0).cast("long")).alias("knowledge"))
    rows = narrow(chunks, pack, extra)
    ordered = {kind for kind, _, _ in kinds.values()} & {"interval", "flatness"}
    if ordered:
        rows = in_order(rows)
    per = [per_thousand(F.sum(x or kind)).alias(name) for name, (kind, x, _) in kinds.items() if kind in ("keywords", "mentions", "knowledge")]
    length = [F.avg("chars").alias(name) for name, (kind, _, _) in kinds.items() if kind == "length"]
    wide = rows.groupBy("project_id").agg(F.count("*").alias("__chunks"), *per, *length)
    for name, (kind, x, _) in kinds.items():
        if kind in ordered:
            more = keyword_interval(rows, x) if kind == "interval" else pacing_flatness(rows, keywords=x)
            more = more.select(F.col("project_id").alias("__p"), F.col(more.columns[1]).alias(name))
            wide = wide.join(more, wide["project_id"].eqNullSafe(more["__p"])).drop("__p")
    weighted = [F.struct(F.lit(m.profile_id).alias("profile_id"), F.lit(m.metric_type).alias("metric_type"), (F.col(m.metric_type) * (m.weight if kinds[m.metric_type][2] == "per_1000_chars" else 1.0)).cast("double").alias("value"), F.lit(kinds[m.metric_type][2]).alias("unit")) for m in wanted]
    return wide.select("project_id", F.explode(F.array(*weighted)).alias("m")).select("project_id", "m.*")


def project_summary(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("project_id").agg(F.count_distinct("path").alias("documents"), F.count("*").alias("chunks"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("words"))


def dashboard(chunks: DataFrame, cands: DataFrame, fores: DataFrame, issues: DataFrame) -> DataFrame:
    nodes = cands.groupBy("project_id").agg(*[F.count_if(F.col("node_type") == k).alias(f"{k}s") for k in ("person", "place", "item")])
    out = project_summary(chunks).join(nodes, "project_id", "left").join(fores.groupBy("project_id").agg(F.count("*").alias("foreshadows")), "project_id", "left").join(issues.groupBy("project_id").agg(F.count("*").alias("issues")), "project_id", "left")
    return out.na.fill(0)
