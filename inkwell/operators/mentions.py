"""Persons, places and items: mentions, candidates, aliases."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..packs import Pack



def _found(content: str, patterns: tuple[str, ...]) -> Column:
    return F.flatten(F.array(*[F.regexp_extract_all(content, F.lit(p), 1) for p in patterns]))


def valid_person(n: Column, pack: Pack) -> Column:
    some = lambda xs: "|".join(map(re.escape, xs))
    return F.length(n).between(*pack.name_length) & ~n.isin(*pack.stopwords) & ~n.rlike(f"^({some(pack.bad_prefixes)})") & ~n.rlike(f"({some(pack.bad_suffixes)})$") & ~n.rlike(f"({some(pack.bad_infixes)})")


def persons_in(content: str, pack: Pack) -> Column:
    return F.filter(_found(content, pack.person_patterns), lambda n: valid_person(n, pack))


def places_in(content: str, pack: Pack) -> Column:
    return F.filter(_found(content, (pack.place_pattern,)), lambda n: F.length(n) >= 2)


def items_in(content: str, pack: Pack) -> Column:
    prefix = "^(" + "|".join(map(re.escape, pack.item_prefixes)) + ")"
    return F.filter(F.transform(_found(content, pack.item_patterns), lambda n: F.regexp_replace(n, prefix, "")), lambda n: F.length(n) >= 2)


#: The names of each kind in a text, as often as they stand there.
KIND_HITS = {"person": persons_in, "place": places_in, "item": items_in}


def _mentions(chunks: DataFrame, kind: str, pack: Pack) -> DataFrame:
    return chunks.select("project_id", "path", "chunk_index", "chunk_id", F.lit(kind).alias("node_type"), F.explode(KIND_HITS[kind]("content", pack)).alias("name"))


def person_mentions(chunks: DataFrame, pack: Pack) -> DataFrame:
    return _mentions(chunks, "person", pack)


def place_mentions(chunks: DataFrame, pack: Pack) -> DataFrame:
    return _mentions(chunks, "place", pack)


def item_mentions(chunks: DataFrame, pack: Pack) -> DataFrame:
    return _mentions(chunks, "item", pack)


KINDS = {"people": person_mentions, "places": place_mentions, "items": item_mentions}


def mentions(chunks: DataFrame, pack: Pack, kinds: tuple[str, ...] = ("people", "places", "items")) -> DataFrame:
    """The mentions of the kinds that are switched on."""
    out = None
    for k in kinds:
        made = KINDS[k](chunks, pack)
        out = made if out is None else out.unionByName(made)
    return out


def candidates(found: DataFrame) -> DataFrame:
    """Per name: count, first and latest chunk, confidence."""
    pos = F.struct("path", "chunk_index")
    made = found.groupBy("project_id", "node_type", "name").agg(F.count("*").alias("occurrence_count"), F.min_by("chunk_id", pos).alias("first_chunk_id"), F.max_by("chunk_id", pos).alias("latest_chunk_id"))
    return made.withColumn("confidence", confidence())


def confidence():
    return F.least(F.lit(50) + 10 * F.col("occurrence_count"), F.lit(90))


def alias_hits(chunks: DataFrame, pack: Pack) -> DataFrame:
    """(project_id, path, chunk_index, chunk_id, alias): each letter that stands before a title, with the title, once per chunk."""
    before = lambda s: F.regexp_extract_all("content", F.lit(f"(?s)(.)(?={re.escape(s)})"), 1)
    joined = lambda s: F.transform(before(s), lambda c: F.concat(c, F.lit(s)))
    hits = F.array_distinct(F.flatten(F.array(*[joined(s) for s in pack.alias_suffixes])))
    return chunks.select("project_id", "path", "chunk_index", "chunk_id", F.explode(hits).alias("alias"))


def with_aliases(cands: DataFrame, seen: DataFrame, pack: Pack, length: int = 2) -> DataFrame:
    """Candidates with aliases. seen: (project_id, alias, n: chunks)."""
    names = cands.where((F.col("node_type") == "person") & (F.length("name") == length)).select("project_id", "name", F.explode(F.array(*[F.concat(F.substring("name", 1, 1), F.lit(s)) for s in pack.alias_suffixes])).alias("alias"))
    more = names.join(seen, ["project_id", "alias"]).groupBy("project_id", "name").agg(F.sum("n").alias("more"), F.array_sort(F.collect_set("alias")).alias("aliases"))
    out = cands.join(more.withColumn("node_type", F.lit("person")), ["project_id", "node_type", "name"], "left")
    out = out.withColumn("occurrence_count", F.col("occurrence_count") + F.coalesce("more", F.lit(0))).withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>"))).drop("more")
    return out.withColumn("confidence", confidence())


def merge_aliases(cands: DataFrame, chunks: DataFrame, pack: Pack, length: int = 2) -> DataFrame:
    """Names of this length gain a mention and an alias for each chunk that holds their first letter followed by a title."""
    seen = alias_hits(chunks, pack).groupBy("project_id", "alias").agg(F.count("*").alias("n"))
    return with_aliases(cands, seen, pack, length)


def top(cands: DataFrame, limit: int, node_type: str | None = None) -> DataFrame:
    x = cands.where(F.col("node_type") == node_type) if node_type else cands
    return x.orderBy(F.desc("occurrence_count"), "name", "project_id", "node_type").limit(limit)
