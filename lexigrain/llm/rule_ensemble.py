"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees are grown on labelled rows. Each path from a root is a conjunction of
conditions on statistics; a logistic regression with a lasso penalty weighs these
rules and drops most of them. The rest become one Spark column expression, so a fitted
classifier is a short list of readable rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from lexigrain.llm.common import WHITE, small_batches, texts_of
from lexigrain.llm.compression import SYMBOLS, repeated_words, word_ids
from lexigrain.llm.folders import landed

STATISTICS = ["log_words", "word_length", "symbol_share", "upper_share", "digit_share",
              "mark_share", "loud_share", "bar_share", "distinct_share", "repeated_share",
              "repeated_lines", "line_words", "end_share"]
SAMPLE = 20_000  # labelled rows a fit uses at most (in expectation), chosen by hash
TREES = 24
DEPTH = 3
PENALTY = 0.001
SEED = 7
THRESHOLD = 0.3

UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
DIGITS = b"0123456789"
MARKS = b".,;:!?\"'()-/"


def statistics(text: str) -> list[float]:
    """Shares and means in the order of ``STATISTICS``; 0 where there is nothing to divide."""
    data = text.encode()
    size = len(data.translate(None, WHITE))
    ids = word_ids(data)
    words = len(ids)
    lines = [line for line in data.split(b"\n") if line.strip(WHITE)]
    ends = sum(line.rstrip(WHITE)[-1:] in b".!?:" for line in lines)

    def count(which: bytes) -> int:
        return len(data) - len(data.translate(None, which))

    def share(part: float, whole: float) -> float:
        return part / whole if whole else 0.0

    letters = count(LETTERS)
    return [float(np.log1p(words)), share(size, words), share(count(SYMBOLS), size),
            share(count(UPPER), letters), share(count(DIGITS), size), share(count(MARKS), size),
            share(count(b"!?"), size), share(count(b"|"), words),
            share(int(ids.max()) + 1 if words else 0, words), share(repeated_words(ids), words),
            share(len(lines) - len(set(lines)), len(lines)), share(words, len(lines)),
            share(ends, len(lines))]


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the statistics of each text; null counts as empty. No shuffle."""
    kept = docs.drop(*STATISTICS)
    wide = StructType(list(kept.schema.fields))
    for name in STATISTICS:
        wide = wide.add(name, DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text):
            values = np.asarray([statistics(t) for t in texts_of(batch, text)], float)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(values[:, i]) for i in range(len(STATISTICS)))],
                [*batch.schema.names, *STATISTICS])

    return kept.mapInArrow(run, wide)


@dataclass(frozen=True)
class Rule:
    """Conditions (statistic, lowest excluded, highest included) that hold together."""

    conditions: tuple[tuple[str, float, float], ...]

    def column(self) -> Column:
        holds = F.lit(True)
        for name, low, high in self.conditions:
            if low > -np.inf:
                holds = holds & (F.col(name) > low)
            if high < np.inf:
                holds = holds & (F.col(name) <= high)
        return holds

    def __str__(self) -> str:
        return " and ".join(f"{low:.4g} < {name} <= {high:.4g}" for name, low, high in
                            self.conditions)


@dataclass(frozen=True)
class Ensemble:
    """Weighted rules; the score is the probability of label 1."""

    intercept: float
    rules: tuple[tuple[float, Rule], ...]

    def score(self) -> Column:
        total = F.lit(float(self.intercept))
        for weight, rule in self.rules:
            total = total + F.when(rule.column(), float(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def tree_paths(described: str) -> list[Rule]:
    """The path to every node below the root, from a tree as Spark ML describes it."""
    rules, path = [], []
    for line in described.splitlines():
        found = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([^)]+)\)", line)
        if not found:
            continue
        depth = len(found[1])
        while path and path[-1][0] >= depth:
            path.pop()
        path.append((depth, STATISTICS[int(found[2])], found[3], float(found[4])))
        bounds: dict[str, tuple[float, float]] = {}
        for _, name, sign, value in path:
            low, high = bounds.get(name, (-np.inf, np.inf))
            bounds[name] = (low, min(high, value)) if sign == "<=" else (max(low, value), high)
        rules.append(Rule(tuple((name, *b) for name, b in sorted(bounds.items()))))
    return rules


def fit(sample: DataFrame, label: str = "label", trees: int = TREES, depth: int = DEPTH,
        penalty: float = PENALTY, seed: int = SEED) -> Ensemble:
    """Fit on rows with statistics and a label 0 or 1.

    With no rows the score is 0.5, with one label only it is that label's side.
    """
    counts = {int(r[0]): r[1] for r in sample.groupBy(label).count().collect() if r[0] is not None}
    ones, rows = counts.get(1, 0), sum(counts.values())
    if not rows or ones in (0, rows):
        share = (ones + 1) / (rows + 2)
        return Ensemble(float(np.log(share / (1 - share))), ())
    vectors = sample.select(
        F.col(label).cast("double").alias("label"), *STATISTICS,
        array_to_vector(F.array(*STATISTICS)).alias("features"))
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="0.5").fit(vectors)
    rules = sorted({rule for tree in forest.trees for rule in tree_paths(tree.toDebugString)},
                   key=str)
    if not rules:
        share = ones / rows
        return Ensemble(float(np.log(share / (1 - share))), ())
    held = landed(vectors.select("label", array_to_vector(F.array(
        *[r.column().cast("double") for r in rules])).alias("features")), "rules")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60,
                               standardization=False).fit(held)
    weights = lasso.coefficients.toArray()
    return Ensemble(float(lasso.intercept), tuple(
        (float(w), r) for w, r in zip(weights, rules, strict=True) if abs(w) > 1e-6))


def held_out(doc_id: Column) -> Column:
    """Rows that no fit may see: a fifth of the ids by checksum."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """Statistics and label of at most about ``size`` labelled documents not held out.

    Repeated labels of a document count by their mean; null labels do not count. The
    ids are few by construction, so they are broadcast.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()
                          & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        (F.avg("quality") >= 0.5).cast("int").alias("label"))
    rows = known.count()
    cut = min(1.0, size / max(rows, 1))
    scale = 1 << 30
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < int(cut * scale))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return landed(with_statistics(texts).drop("text"), "sample")


def classify(docs: DataFrame, labels: DataFrame, size: int = SAMPLE,
             threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score and predicted.

    Inputs of the score are statistics of the text alone. Null and empty texts have
    all statistics 0 and a score from the rules that hold then. Copies score alike.
    """
    ensemble = fit(labelled_sample(docs, labels, size))
    scored = with_statistics(docs.select("doc_id", "text")).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), ensemble.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
