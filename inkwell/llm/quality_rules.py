"""2. Quality rules: a rule bitmask ledger. DataFrame functions only.

measured() takes every measurement of a text once. ledger() evaluates every rule once and stores the failures as bits of
one integer beside the measurements. A policy is a versioned set of rules (a mask): verdicts(), failure counts and
ablations are bit operations over the ledger, so changing a policy never touches a text again.

Words are `[^\\x20\\x09-\\x0D]+`. Null and empty texts have no words: all measurements are 0, and the base rules fail. Repeated
rows each have their row. An empty table gives an empty ledger. Other columns stay as they are, with their names, unless
named like a measurement; then the measurement wins.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Rule:
    """fails: SQL over the measurements, true where a text fails. Its bit is its place in RULES, for ever."""

    name: str
    fails: str


#: Append only: a bit keeps its meaning in stored ledgers. Integer arithmetic, so no rounding decides.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("many_symbols", "10 * n_symbols > n_words"),
    Rule("upper_case", "10 * n_upper > 4 * word_chars"),
    Rule("shouting", "20 * n_bangs > n_words"),
    Rule("duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
    Rule("few_letters", "10 * n_digits > 3 * word_chars"),
)
BIT = {r.name: i for i, r in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << BIT[r] for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_words"))
#: The policy that op2 applies; earlier versions stay for comparison.
V1 = Policy("v1", (*BASE.rules, "many_symbols", "upper_case", "shouting", "duplicate_lines"))
V2 = Policy("v2", tuple(r.name for r in RULES))
POLICIES = {p.version: p for p in (BASE, V1, V2)}


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without its text, with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper, n_digits, n_bangs (long)."""
    t = F.coalesce(F.col("__text"), F.lit(""))
    left = lambda chars: F.length(F.regexp_replace(t, f"[^{chars}]+", "")).cast("long")
    made = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_bangs")
    keep = [F.col(c) for c in docs.columns if c != text and c not in made]
    start = docs.select(*keep, F.col(text).alias("__text"))
    names = [c for c in docs.columns if c != text and c not in made]
    words = start.select(
        *names,
        F.regexp_extract_all(t, F.lit(f"({WORD})"), 1).alias("__w"),
        F.filter(F.split(t, "\n", -1), lambda line: line.rlike(WORD)).alias("__l"),
        F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        left(r"#*$%&|<>").alias("n_symbols"),
        left("A-ZÀ-ÖØ-Þ").alias("n_upper"),
        left("0-9").alias("n_digits"),
        left("!").alias("n_bangs"),
    )
    # three-word windows as (hash, first word); equal ones stand together after the sort
    n = F.size("__w")
    windows = words.select(
        *names, "word_chars", "n_symbols", "n_upper", "n_digits", "n_bangs",
        n.cast("long").alias("n_words"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.expr("""CASE WHEN size(__w) < 4 THEN cast(array() AS array<struct<h: bigint, i: int>>)
                  ELSE transform(sequence(0, size(__w) - 3), i -> named_struct('h', xxhash64(element_at(__w, i + 1), element_at(__w, i + 2), element_at(__w, i + 3)), 'i', i)) END""").alias("__h"),
    )
    ordered = windows.withColumn("__s", F.when(F.size(F.array_distinct(F.col("__h.h"))) == F.size("__h"), F.expr("cast(array() AS array<struct<h: bigint, i: int>>)")).otherwise(F.sort_array("__h"))).drop("__h")
    found = ordered.withColumn(
        "__p",
        F.expr("sort_array(transform(filter(__s, (x, j) -> x.h = get(__s, j - 1).h OR x.h = get(__s, j + 1).h), x -> x.i))"),
    ).drop("__s")
    cover = F.expr("""CASE WHEN size(__p) = 0 THEN 0 ELSE aggregate(__p, named_struct('last', -3, 'sum', 0),
        (a, i) -> named_struct('last', i, 'sum', a.sum + least(3, i - a.last)), a -> a.sum) END""").cast("long")
    return found.withColumn("n_repeat_words", cover).drop("__p")


def ledger(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """measured() and failed, a long whose bit i is set where rule i fails."""
    bits: list[Column] = [F.when(F.expr(r.fails), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, r in enumerate(rules)]
    return measured(docs, text).withColumn("failed", reduce(lambda a, b: a.bitwiseOR(b), bits))


def fails(policy: Policy) -> Column:
    return F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def verdicts(led: DataFrame, policies: tuple[Policy, ...]) -> DataFrame:
    """The ledger with kept_<version> for each policy."""
    return led.withColumns({f"kept_{p.version}": ~fails(p) for p in policies})


def ablation(led: DataFrame, policy: Policy) -> DataFrame:
    """One row per rule of the policy: (version, rule, n_docs, n_failed, n_only: kept if the rule alone were left out, n_kept).

    One aggregation over the ledger, by bits only.
    """
    sums = [F.count("*").alias("n_docs"), F.count_if(~fails(policy)).alias("n_kept")]
    hit = F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long"))
    for r in policy.rules:
        bit = 1 << BIT[r]
        sums += [F.count_if(hit.bitwiseAND(F.lit(bit).cast("long")) != 0).alias(f"f_{r}"), F.count_if(hit == bit).alias(f"o_{r}")]
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"f_{r}").alias("n_failed"), F.col(f"o_{r}").alias("n_only")) for r in policy.rules])
    return led.agg(*sums).select(F.lit(policy.version).alias("version"), "n_docs", "n_kept", F.explode(rows).alias("r")).select("version", "r.rule", "n_docs", "r.n_failed", "r.n_only", "n_kept")
