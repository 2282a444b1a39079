"""Language ID by Bayesian evidence fusion.

The posterior of a language multiplies what is known about a record: the likelihood
of its text under byte trigrams, the chance of its declared markup language, the
chance of its address suffix, and the prior of its host. Host priors are smoothed
towards the registered domain, and that towards the whole corpus. All tables but
the trigrams are grouped sums, over all records, of what the texts alone say; a
record's own share is taken out of the prior it meets.

The posterior weighs known languages against each other and nears 1 on any long text.
Whether a text is in a known language at all, and in one only, is judged beside it: by
its mean log likelihood a trigram against a floor that labelled texts set, and by the
share of its blocks that vote for the same language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrain.functions.html import visible_text
from lexigrain.llm.bitmaps import blocks_of, merged, whole
from lexigrain.llm.common import column_like, small_batches, texts_of
from lexigrain.llm.folders import landed
from lexigrain.operators.joins import lookup

BITS = 15  # cells of trigrams
SAMPLE = 20_000  # labelled documents the trigrams come from (in expectation), by hash
LEAST = 1_000  # of these, documents of each language (or all it has)
MIN_LABELLED = 3  # labelled documents a language needs
TEMPER = 1 / 3  # a byte lies in three trigrams, which are not independent
SMOOTH = 0.5  # added to each count of trigrams, suffixes and declarations
PULL = 20.0  # records of the level above that a host or domain is smoothed with
CONFIDENT = 0.5
STRANGE = 0.01  # prior odds that a text is in no known language
CHANCE = -BITS * np.log(2)  # log likelihood of a trigram if all cells are alike
DEPTH = 1 / 3  # where the floor lies between the labelled texts of a language and chance
LOW = 0.05  # this share of the labelled texts may lie below the floor, no more
VOTE = 64  # trigrams of a block that votes
VOTES = 64  # blocks scored at a time
AGREED = 2 / 3  # more than this share of the votes must be for one language
BLOCK = 1 << 20
_PLAIN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def trigram_cells(data: bytes) -> np.ndarray:
    """Cells of the byte trigrams of a piece of text."""
    values = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(values) < 3:
        return np.empty(0, np.uint32)
    joined = values[:-2] << np.uint32(16) | values[1:-1] << np.uint32(8) | values[2:]
    return (joined * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def blocks_of_text(text: str) -> Iterator[bytes]:
    """Letters of a text in lower case, with a space around; everything else is one space."""
    for start in range(0, len(text), BLOCK):
        part = text[start:start + BLOCK].lower().encode()
        letters = b" ".join(part.translate(_PLAIN).split())
        yield b" " + letters + b" " if letters else b""


@dataclass(frozen=True)
class Trigrams:
    """Languages, the log likelihood of each cell in each, and the mean of a strange text."""

    languages: tuple[str, ...]
    weights: np.ndarray  # cells x languages
    floors: np.ndarray  # one a language


def learn(labelled: DataFrame, size: int = SAMPLE) -> Trigrams:
    """Trigram counts of a bounded sample of (doc_id, text, lang).

    Rows are chosen by a hash of their id: a share of all that gives ``size`` rows in
    expectation, and more of a language that would have fewer than ``LEAST``. So every
    language of ``MIN_LABELLED`` documents is known, whatever the number of rows.
    Counting is per task, and tables of fixed size are merged.
    """
    known = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    scale = 1 << 30
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(scale))
    found = known.groupBy("lang").agg(F.count("*").alias("n"), F.min(chance).alias("first"))
    rows = found.collect()
    total = sum(r["n"] for r in rows)
    cuts = [(r["lang"], max(int(min(1.0, max(size / total, LEAST / r["n"])) * scale),
                            r["first"] + 1)) for r in rows if r["n"] >= MIN_LABELLED]
    names = sorted(lang for lang, _ in cuts)
    cut = labelled.sparkSession.createDataFrame(cuts, "lang string, _cut long")
    sample = known.withColumn("_chance", chance).join(F.broadcast(cut), "lang").filter(
        "_chance < _cut").select("lang", "text")
    number = {name: i for i, name in enumerate(names)}
    bits = BITS + max(len(names) - 1, 1).bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((1 << (bits - BITS), 1 << BITS), np.uint64)
        for batch in small_batches(batches):
            for lang, text in zip(column_like(batch, "lang").to_pylist(), texts_of(batch),
                                  strict=True):
                if lang in number:
                    for part in blocks_of_text(text):
                        cells[number[lang]] += np.bincount(
                            trigram_cells(part), minlength=1 << BITS).astype(np.uint64)
        blocks, parts = blocks_of(cells)
        yield pa.RecordBatch.from_arrays(
            [pa.array(blocks, pa.int32()), pa.array(parts, pa.binary())],
            names=["block", "cells"])

    table = whole(merged(sample.mapInArrow(run, "block int, cells binary"), "<u8"), bits, "<u8")
    counts = table.reshape(-1, 1 << BITS)[:len(names)].astype(float) + SMOOTH
    shares = counts / counts.sum(axis=1, keepdims=True) if names else counts
    return Trigrams(tuple(names), np.ascontiguousarray(np.log(shares).T),
                    _floors(sample, number, counts))


def _floors(sample: DataFrame, number: dict[str, int], counts: np.ndarray) -> np.ndarray:
    """Per language the mean log likelihood a trigram below which a text is strange to it.

    Every labelled text is scored with its own trigrams taken out of the counts. The floor
    lies ``DEPTH`` of the way from their median to ``CHANCE``, or at their ``LOW`` quantile
    if that is lower (as in a language of few texts). A language without letters knows none.
    """
    floors = np.zeros(len(number))
    if not number:
        return floors
    chosen = sample.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chosen.value
        totals = table.sum(axis=1)
        for batch in small_batches(batches):
            langs, means = [], []
            for lang, text in zip(column_like(batch, "lang").to_pylist(), texts_of(batch),
                                  strict=True):
                if lang in number:
                    own = np.zeros(1 << BITS)
                    for part in blocks_of_text(text):
                        own += np.bincount(trigram_cells(part), minlength=1 << BITS)
                    at, size = np.flatnonzero(own), own.sum()
                    if size:
                        i = number[lang]
                        rest = (table[i, at] - own[at]) / (totals[i] - size)
                        langs.append(lang)
                        means.append(float(own[at] @ np.log(rest) / size))
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(means, pa.float64())],
                names=["lang", "mean"])

    scored = sample.mapInArrow(run, "lang string, mean double")
    for row in scored.groupBy("lang").agg(
            F.percentile("mean", F.array(F.lit(LOW), F.lit(0.5))).alias("q")).collect():
        low, middle = row["q"]
        floors[number[row["lang"]]] = min(low, middle + DEPTH * (CHANCE - middle))
    return floors


def scores(text: str, model: Trigrams) -> tuple[int, np.ndarray, float, float]:
    """Trigrams of a text, its log likelihoods, the chance that it is in no known language,
    and the largest share of one language in the votes of its blocks. A block in no known
    language does not vote; it counts in the whole."""
    count = len(model.languages)
    total, size, votes = np.zeros(count), 0, np.zeros(count)
    for part in blocks_of_text(text):
        cells = trigram_cells(part)
        size += len(cells)
        if not len(cells) or not count:
            continue
        blocks = max(1, round(len(cells) / VOTE))
        edges = np.arange(blocks + 1) * len(cells) // blocks
        for first in range(0, blocks, VOTES):
            ends = edges[first:first + VOTES + 1]
            sums = np.add.reduceat(model.weights[cells[ends[0]:ends[-1]]],
                                   ends[:-1] - ends[0], axis=0)
            best, lengths = sums.argmax(axis=1), np.diff(ends)
            told = _strange(sums[np.arange(len(best)), best], lengths, model.floors[best]) <= 0
            votes += np.bincount(best[told], lengths[told], minlength=count)
            total += sums.sum(axis=0)
    if not size or not count:
        return size, total, 1.0, 0.0
    best = total.argmax()
    odds = _strange(total[best], size, model.floors[best])
    unknown = float(1 / (1 + np.exp(np.clip(-odds, -700, 700))))
    return size, total, unknown, float(votes.max() / max(votes.sum(), 1))


def _strange(found, size, floor):
    """Log odds that trigrams of a log likelihood are in no known language."""
    return np.log(STRANGE) + TEMPER * (size * floor - found)


def text_evidence(records: DataFrame, model: Trigrams) -> DataFrame:
    """Replace ``text`` by ``n_grams``, ``unknown``, ``agreement`` (see :func:`scores`) and
    ``p``, the likelihoods of the text scaled to sum 1."""
    kept = [f for f in records.schema.fields if f.name != "text"]
    names = [f.name for f in kept]
    chosen = records.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept),
                        "n_grams long", "unknown double", "agreement double",
                        "p array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = chosen.value
        for batch in small_batches(batches):
            found = [scores(text, model) for text in texts_of(batch)]
            grams, totals, unknown, agreement = zip(*found, strict=True)
            odds = [np.exp(TEMPER * (t - t.max(initial=-np.inf))) for t in totals]
            yield pa.RecordBatch.from_arrays(
                [*(column_like(batch, n) for n in names), pa.array(grams, pa.int64()),
                 pa.array(unknown, pa.float64()), pa.array(agreement, pa.float64()),
                 pa.array([o / o.sum() for o in odds], pa.list_(pa.float64()))],
                names=[*names, "n_grams", "unknown", "agreement", "p"])

    return records.mapInArrow(run, schema)


def _sums(df: DataFrame, count: int, *keys: str) -> DataFrame:
    """Per group the summed likelihoods, as an array (``_c``); map-side combined."""
    sums = [F.sum(F.col("p")[i]).alias(f"_{i}") for i in range(count)]
    grouped = df.groupBy(*keys).agg(*sums)
    return grouped.select(*keys, F.array(*[f"_{i}" for i in range(count)]).alias("_c"))


def _chances(scored: DataFrame, column: str, count: int) -> DataFrame:
    """log P(value | language) of a column's values, from summed likelihoods."""
    sums = landed(_sums(scored.filter(F.col(column).isNotNull() & (F.col("n_grams") > 0)),
                        count, column), column)
    totals = sums.agg(F.count("*").alias("n"),
                      *[F.sum(F.col("_c")[i]).alias(f"t{i}") for i in range(count)]).head()
    values = [F.ln((F.col("_c")[i] + SMOOTH) / ((totals[f"t{i}"] or 0.0)
                                               + SMOOTH * max(totals["n"], 1)))
              for i in range(count)]
    return sums.select(column, F.array(*values).alias(f"_{column}"))


def fuse(scored: DataFrame, model: Trigrams) -> DataFrame:
    """Add ``lang``, ``confidence``, ``text_lang`` and ``kept`` to records with text evidence.

    Needs host, domain, suffix and declared (each may be null: no evidence). ``kept``
    asks for some letters, a confidence of at least ``CONFIDENT``, a text that is rather in
    a known language than in none, and an agreement of its blocks above ``AGREED``.
    """
    count = len(model.languages)
    if not count:
        return scored.select("*", F.lit(None).cast("string").alias("lang"),
                             F.lit(0.0).alias("confidence"),
                             F.lit(None).cast("string").alias("text_lang"),
                             F.lit(False).alias("kept")).drop("p")
    told = scored.filter("n_grams > 0")
    head = _sums(told, count).head()
    overall = [x or 0.0 for x in (head["_c"] if head else [0.0] * count)]
    share = [(x + 1.0) / (sum(overall) + count) for x in overall]
    found = scored
    for column in ("declared", "suffix"):
        found = lookup(found, _chances(scored, column, count), [column], ["_row"])
    for column in ("domain", "host"):
        sums = landed(_sums(told.filter(F.col(column).isNotNull()), count, column), column)
        found = lookup(found, sums.withColumnRenamed("_c", f"_{column}"), [column], ["_row"])

    def at(name: str, i: int) -> Column:
        return F.coalesce(F.col(f"_{name}")[i], F.lit(0.0))

    def level(name: str, above: list[Column]) -> list[Column]:
        own = [F.when(F.col(f"_{name}").isNotNull() & (F.col("n_grams") > 0),
                      F.col("p")[i]).otherwise(0.0) for i in range(count)]
        counts = [F.greatest(at(name, i) - own[i], F.lit(0.0)) for i in range(count)]
        total = sum(counts[1:], counts[0])
        return [(c + PULL * a) / (total + PULL) for c, a in zip(counts, above, strict=True)]

    found = found.withColumn("_prior", F.array(*level("domain", [F.lit(s) for s in share])))
    found = found.withColumn("_prior", F.array(*level(
        "host", [F.col("_prior")[i] for i in range(count)])))
    odds = F.array(*[
        F.ln(F.greatest(F.col("p")[i], F.lit(1e-300))) + at("declared", i) + at("suffix", i)
        + F.ln(F.col("_prior")[i]) for i in range(count)])
    found = found.withColumn("_odds", odds).withColumn(
        "_e", F.transform("_odds", lambda x: F.exp(x - F.array_max("_odds"))))
    names = F.array(*[F.lit(n) for n in model.languages])
    total = F.aggregate("_e", F.lit(0.0), lambda a, x: a + x)
    return found.select(
        *[c for c in scored.columns if c != "p"],
        F.get(names, (F.array_position("_odds", F.array_max("_odds")) - 1).cast("int")).alias(
            "lang"),
        (1 / total).alias("confidence"),
        F.when(F.col("n_grams") > 0, F.get(names, (F.array_position(
            "p", F.array_max("p")) - 1).cast("int"))).alias("text_lang"),
    ).withColumn("kept", (F.col("n_grams") > 0) & (F.col("confidence") >= CONFIDENT)
                 & (F.col("unknown") <= 0.5) & (F.col("agreement") > AGREED))


def identify(records: DataFrame, model: Trigrams) -> DataFrame:
    """Language of each record.

    ``records`` has text, host, domain, suffix and declared, and any columns to keep.
    A record without letters (null or empty text) takes the language its other evidence
    favours and is not kept. Ties go to the first language by name. Repeated rows stay.
    """
    scored = landed(text_evidence(records, model).withColumn(
        "_row", F.monotonically_increasing_id()), "evidence")
    return fuse(scored, model).drop("_row")


def document_records(docs: DataFrame, *keep: str | Column) -> DataFrame:
    """Documents as records: the source stands for host and domain, nothing is declared."""
    none = F.lit(None).cast("string")
    return docs.select(*keep, "text", F.col("source").alias("host"), none.alias("domain"),
                       none.alias("suffix"), none.alias("declared"))


def page_records(pages: DataFrame, *keep: str | Column) -> DataFrame:
    """Pages as records: host, domain and suffix of the address, language of the markup."""
    host = F.nullif(F.lower(F.regexp_extract(
        F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))
    tag = F.lower(F.regexp_extract(
        F.col("html"), r"(?i)<html[^>]*\slang\s*=\s*[\"']?\s*([a-z]{2,3})\b", 1))
    parts = F.split(host, r"\.")
    return pages.select(
        *keep, visible_text(F.col("html")).alias("text"), host.alias("host"),
        F.when(F.size(parts) > 1, F.concat_ws(".", F.slice(parts, -2, 2))).alias("domain"),
        F.nullif(F.regexp_extract(host, r"\.([a-z]{2,24})$", 1), F.lit("")).alias("suffix"),
        F.nullif(tag, F.lit("")).alias("declared"))
