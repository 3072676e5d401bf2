"""Order-dependent checks over narrow rows, status and rank conflicts, period checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import any_of, near_text, pieces, positions, present
from ..packs import Pack
from .order import last_where, numbered, running_sum, segmented, with_previous


def power_regression(chunks: DataFrame, pack: Pack) -> DataFrame:
    """Chunks at or after a project's first high level that name a low one: (project_id, n, lines)."""
    x = chunks.select("project_id", "path", "chunk_index", any_of("content", pack.power_high).alias("high"), F.element_at(F.filter(F.concat(present("content", pack.power_low), F.array(F.lit(""))), lambda t: t.isNotNull()), 1).alias("low"))
    first = x.where("high").groupBy("project_id").agg(F.min(F.struct("path", "chunk_index")).alias("first"))
    hit = x.where("low != ''").join(first, "project_id").where(F.struct("path", "chunk_index") >= F.col("first"))
    return hit.groupBy("project_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "chunk_index", "low"))), lambda r: F.concat_ws(":", r["path"], r["chunk_index"].cast("string"), r["low"])), "\n").alias("lines"))


def low_streak(chunks: DataFrame, pack: Pack, k: int = 3) -> DataFrame:
    """First place where k chunks in a row lack every keyword: k places or more after the last one that has some."""
    x = numbered(segmented(chunks.select("project_id", "path", "chunk_index", any_of("content", pack.streak).alias("has"))))
    return last_where(x, "has", "n", "last").where(F.col("n") - F.col("last") >= k).groupBy("project_id").agg(F.min("n").cast("int").alias("ends_at"))


def diminishing_runs(chunks: DataFrame, pack: Pack) -> DataFrame:
    """The longest run of event chunks with one signature; 2 is medium, 3 or more high."""
    sig = F.struct(any_of("content", pack.setups).alias("setup"), any_of("content", pack.reactions).alias("reaction"), F.size(present("content", pack.events)).alias("k"))
    ev = segmented(chunks.select("project_id", "path", "chunk_index", sig.alias("sig")).where("sig.k >= 2"))
    runs = running_sum(with_previous(ev, F.col("sig")).withColumn("new", F.coalesce((F.col("sig") != F.col("last")).cast("int"), F.lit(1))), "new", "island")
    runs = runs.groupBy("project_id", "island").agg(F.count("*").alias("length"), F.min(F.struct("path", "chunk_index")).alias("start"))
    best = runs.groupBy("project_id").agg(F.min(F.struct((-F.col("length")).alias("l"), "start")).alias("b"))
    return best.select("project_id", (-F.col("b.l")).alias("length"), F.col("b.start.path").alias("path"), F.col("b.start.chunk_index").alias("chunk_index")).where("length >= 2").withColumn("severity", F.when(F.col("length") >= 3, "high").otherwise("medium"))


def chapter_length_anomaly(chunks: DataFrame) -> DataFrame:
    """The first chunk longer than 2.5 times its project's mean: (project_id, path, chunk_index, chars, mean, chapter: its place in the project)."""
    x = chunks.select("project_id", "path", "chunk_index", F.length("content").alias("chars"))
    means = x.groupBy("project_id").agg(F.avg("chars").alias("mean"), F.count("*").alias("n")).where("n >= 3 AND mean >= 10").select("project_id", "mean")
    first = x.join(means, "project_id").where("chars > 2.5 * mean").groupBy("project_id").agg(F.min(F.struct("path", "chunk_index", "chars", "mean")).alias("x"))
    place = x.select("project_id", F.struct("path", "chunk_index").alias("at")).join(first, "project_id").where(F.col("at") <= F.struct("x.path", "x.chunk_index")).groupBy("project_id").agg(F.count("*").alias("chapter"))
    return first.join(place, "project_id").select("project_id", "x.path", "x.chunk_index", "x.chars", F.round("x.mean", 3).alias("mean"), "chapter")


def _near_terms(chunks: DataFrame, pack: Pack, tiers: dict[str, tuple[str, ...]]) -> DataFrame:
    """(project_id, path, chunk_index, tier, term, protagonist: the chunk names them, near) of every occurrence of every term, in one pass over the texts."""

    def found(tier: str, term: str) -> Column:
        at = F.when(F.contains("content", F.lit(term)), positions("content", term)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda p: F.struct(F.lit(tier).alias("tier"), F.lit(term).alias("term"), near_text("content", term, p).alias("near")))

    every = F.flatten(F.array(*[found(tier, t) for tier, terms in tiers.items() for t in terms]))
    rows = chunks.select("project_id", "path", "chunk_index", F.contains("content", F.lit(pack.protagonist)).alias("protagonist"), F.explode(every).alias("x"))
    return rows.select("project_id", "path", "chunk_index", "protagonist", "x.*")


def identity_evidence(chunks: DataFrame, pack: Pack) -> DataFrame:
    """Names near status terms: (project_id, name, path, chunk_index, term, tier), once each; a chunk that names the protagonist gives them all its tiers."""
    hero = F.when(F.col("protagonist"), F.array(F.lit(pack.protagonist))).otherwise(F.array().cast("array<string>"))
    rows = _near_terms(chunks, pack, pack.tiers)
    return rows.select("project_id", "path", "chunk_index", "term", "tier", F.explode(F.concat(pieces("near", pack.near_run), hero)).alias("name")).distinct()


def identity_conflicts(chunks: DataFrame, pack: Pack) -> DataFrame:
    """Names near status terms of two tiers or more: (project_id, name, tiers); identity_evidence() has their lines."""
    rows = identity_evidence(chunks, pack)
    return rows.groupBy("project_id", "name").agg(F.array_join(F.array_sort(F.collect_set("tier")), ",").alias("tiers"), F.count_distinct("tier").alias("k")).where("k >= 2").drop("k")


def rank_conflicts(chunks: DataFrame, pack: Pack) -> DataFrame:
    """Names that gain a rank tier while they have others: (project_id, name, tier, before), in order of first appearance."""
    rows = _near_terms(chunks, pack, pack.ranks).select("project_id", "path", "chunk_index", "tier", F.explode(pieces("near", pack.near_run)).alias("name"))
    first = rows.groupBy("project_id", "name", "tier").agg(F.min(F.struct("path", "chunk_index")).alias("at"))
    by = W.partitionBy("project_id", "name").orderBy("at", "tier")  # a name has as many rows as there are tiers
    return first.withColumn("before", F.array_join(F.collect_list("tier").over(by.rowsBetween(W.unboundedPreceding, -1)), ",")).where("before != ''").select("project_id", "name", "tier", "before")


def anachronisms(chunks: DataFrame, terms: tuple[str, ...], modern: tuple[str, ...]) -> DataFrame:
    """Modern words in chunks that name a term of the period."""
    return chunks.where(any_of("content", terms)).select("project_id", "path", "chunk_index", F.explode(present("content", modern)).alias("word"))


def place_name_anachronisms(chunks: DataFrame, terms: tuple[str, ...], pack: Pack) -> DataFrame:
    """Markers of another period in chunks that name a term of the period."""
    found = F.filter(F.array(*[F.when(any_of("content", ms), F.lit(d)) for d, ms in pack.other_periods.items()]), lambda x: x.isNotNull())
    return chunks.where(any_of("content", terms)).select("project_id", "path", "chunk_index", F.explode(found).alias("period"))


CHECKS = {"power_regression": power_regression, "low_streak": low_streak, "diminishing_runs": diminishing_runs, "identity_conflicts": identity_conflicts, "rank_conflicts": rank_conflicts, "chapter_length_anomaly": lambda c, p: chapter_length_anomaly(c)}
#: Checks that need a period's terms besides (a knowledge pack's).
PERIOD_CHECKS = {"anachronisms": lambda c, p, terms: anachronisms(c, terms, p.modern + p.modern_more), "place_name_anachronisms": lambda c, p, terms: place_name_anachronisms(c, terms, p)}


def period_terms(knowledge: DataFrame, period: str, most: int = 10_000) -> tuple[str, ...]:
    """A period's terms from the knowledge table, sorted; packs are written by hand, so more than `most` is an error."""
    rows = knowledge.where(F.col("dynasty") == period).select("term").distinct().orderBy("term").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} terms of {period}")
    return tuple(r.term for r in rows)


def run_check(name: str, chunks: DataFrame, pack: Pack, severity: str = "medium", terms: tuple[str, ...] = ()) -> DataFrame:
    made = PERIOD_CHECKS[name](chunks, pack, terms) if name in PERIOD_CHECKS else CHECKS[name](chunks, pack)
    return made if "severity" in made.columns else made.withColumn("severity", F.lit(severity))
