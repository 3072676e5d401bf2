"""8. Quality classifier: a sparse rule ensemble.

Small trees are fitted over statistics of the texts; every path from a root to a node below is a rule (a conjunction of
comparisons). A lasso logistic regression over the rules' truth values keeps a few of them, with weights. The kept rules are
compiled to Spark column expressions, so scoring is one projection over the statistics.

Learning uses at most `sample` labelled rows, those with the smallest hash of their id (a documented bound); statistics and
scores cover all rows. Labels, lang, source and id are no inputs of a score.

Rows: a null text counts as empty; empty texts have all statistics 0 and get a score like any other. Several labels of an id:
the largest counts. Null labels are left out. If no label, or one class only, is there to learn from, the score is that
class's share (0.5 without labels). Repeated rows each have their score. Empty tables give no rows. Only the named columns
are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, packed, written

#: Labelled rows to learn from at most.
SAMPLE = 20_000
STATS = ("words", "word_chars", "upper", "digits", "symbols", "bangs", "bars", "wide", "other_marks", "distinct", "commonest", "short", "lines", "line_repeats", "longest", "letters_used")
#: Byte classes counted per text.
CLASSES = {
    "space": b" \t\n\x0b\x0c\r", "upper": bytes(range(65, 91)), "digits": b"0123456789", "symbols": b"#*$%&<>@^~=_+\\/{}[]", "bangs": b"!?", "bars": b"|", "other_marks": b".,;:'\"()-",
    "wide": bytes(range(0xC2, 0xF5)), "inner": bytes(range(0x80, 0xC0)), "newline": b"\n",
}
_OF = np.zeros((len(CLASSES), 256), np.int32)
for _i, _b in enumerate(CLASSES.values()):
    _OF[_i, list(_b)] = 1


def statistics(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, the STATS as doubles): shares of a text's characters, words or lines, so long and short texts compare."""
    out = T.StructType([docs.schema[key], *(T.StructField(s, T.DoubleType()) for s in STATS)])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in packed(batch.column(1)):
                bounds = np.append(texts.starts, texts.ends[-1:])
                c = {}
                for i, name in enumerate(CLASSES):
                    sums = np.zeros(len(texts.data) + 1, np.int64)
                    np.cumsum(_OF[i][texts.data], out=sums[1:])
                    c[name] = np.diff(sums[bounds]).astype(float)
                chars = np.maximum(1, texts.ends - texts.starts - c["inner"])
                shown = np.maximum(1, chars - c["space"])
                word = np.array([_words(texts.data[a:b].tobytes()) for a, b in zip(texts.starts, texts.ends, strict=True)], float).reshape(-1, 8)
                n = np.maximum(1, word[:, 0])
                made = {
                    "words": np.log1p(word[:, 0]), "word_chars": np.where(word[:, 0] > 0, shown / n, 0), "upper": c["upper"] / shown, "digits": c["digits"] / shown, "symbols": c["symbols"] / shown, "bangs": c["bangs"] / n, "bars": c["bars"] / n,
                    "wide": c["wide"] / shown, "other_marks": c["other_marks"] / n, "distinct": word[:, 1] / n, "commonest": word[:, 2] / n, "short": word[:, 3] / n, "lines": word[:, 4] / n, "line_repeats": word[:, 5], "longest": word[:, 6], "letters_used": word[:, 7],
                }
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, texts.n), *(pa.array(made[s], pa.float64()) for s in STATS)], names=out.names)

    return docs.select(key, text).mapInArrow(step, out)


def _words(raw: bytes) -> tuple[float, ...]:
    """Words, distinct ones, the commonest's count, short ones, lines, share of repeated lines, longest word, distinct bytes."""
    words = raw.split()
    if not words:
        return (0,) * 8
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), float(len(counts)), max(counts.values()), sum(n for w, n in counts.items() if len(w) <= 2), len(lines), 1 - len(set(lines)) / len(lines), max(map(len, counts)), len(set(raw))


@dataclass(frozen=True)
class Rules:
    """Weighted conjunctions: (weight, ((statistic, '<=' or '>', bound), ...)); score = sigmoid(bias + the true ones' weights)."""

    bias: float
    rules: tuple[tuple[float, tuple[tuple[str, str, float], ...]], ...] = field(default=())

    def column(self) -> Column:
        total = reduce(lambda a, r: a + F.when(conjunction(r[1]), F.lit(r[0])).otherwise(F.lit(0.0)), self.rules, F.lit(self.bias))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def conjunction(terms: tuple[tuple[str, str, float], ...]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(s) <= F.lit(v) if op == "<=" else F.col(s) > F.lit(v) for s, op, v in terms])


def tree_rules(text: str) -> set[tuple[tuple[str, str, float], ...]]:
    """The paths of a fitted tree, from the indented If / Else lines that it prints. Bounds on one statistic are merged."""
    found, path = set(), []
    for line in text.splitlines():
        if m := re.match(r"(\s*)(If|Else) \(feature (\d+) (<=|>) ([-\d.eE]+)\)", line):
            depth = len(m[1])
            path = [p for p in path if p[0] < depth] + [(depth, STATS[int(m[3])], m[4], float(m[5]))]
            bounds: dict[tuple[str, str], float] = {}
            for _, s, op, v in path:
                bounds[s, op] = (min if op == "<=" else max)(v, bounds.get((s, op), v))
            found.add(tuple(sorted((s, op, v) for (s, op), v in bounds.items())))
    return found


def learned(rows: DataFrame, *, sample: int = SAMPLE, trees: int = 12, depth: int = 3, lasso: float = 0.002, seed: int = 7, key: str = "doc_id") -> Rules:
    """Rules from (key, STATS, label) rows."""
    chosen = rows.orderBy(F.xxhash64(key), key, *STATS).limit(sample)
    data = written(VectorAssembler(inputCols=list(STATS), outputCol="features").transform(chosen).select("features", F.col("label").cast("double").alias("label"), *STATS).repartition(4), "rules-sample")
    classes = {r.label: r["count"] for r in data.groupBy("label").count().collect()}
    if len(classes) < 2:
        share = min(max(next(iter(classes), 0.5), 1e-6), 1 - 1e-6)
        return Rules(float(np.log(share / (1 - share))))
    total, least = sum(classes.values()), min(classes.values())
    weight = F.when(F.col("label") == min(classes, key=classes.get), min(5.0, (total - least) / least)).otherwise(1.0)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird", minInstancesPerNode=5, maxBins=64, weightCol="w").fit(data.withColumn("w", weight))
    rules = sorted(set().union(*(tree_rules(t.toDebugString) for t in forest.trees)))
    if not rules:
        return Rules(float(np.log((total - classes.get(0.0, 0)) / max(1, classes.get(0.0, 0)))))
    truth = data.select("label", array_to_vector(F.array(*[conjunction(r).cast("double") for r in rules])).alias("truth"))
    fit = LogisticRegression(featuresCol="truth", elasticNetParam=1.0, regParam=lasso, maxIter=60).fit(truth)
    kept = tuple((float(w), r) for w, r in zip(fit.coefficients.toArray(), rules, strict=True) if w)
    return Rules(float(fit.intercept), kept)


def scored(docs: DataFrame, labels: DataFrame, train: Column, *, key: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> tuple[DataFrame, Rules]:
    """((key, score), the rules). train: a condition on the key that says which rows' labels may be learned from."""
    bounded_batches(docs.sparkSession)
    stats = written(statistics(docs, key=key), "rules-stats")
    marks = labels.where(train & F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("__labelled")).agg(F.max(label).alias("label"))
    rows = stats.join(marks, stats[key] == marks["__labelled"]).drop("__labelled")
    rules = learned(rows, sample=sample, key=key)
    return stats.select(key, rules.column().alias("score")), rules
