"""Row-level projections, filters, samples and quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Title prefixes of pages that are not articles.
IGNORED_TITLE_PREFIXES = (
    "Wikipedia", "Category", "File", "Portal", "Template", "MediaWiki", "User", "Help",
    "Book", "Draft", "WikiProject", "Special", "Talk",
)
RUN_SECONDS = 900
FIRST_VERSION_RUN_SECONDS = 3600
MIN_ARTICLE_WORDS = 50


def epoch_text(epoch_seconds: Column) -> Column:
    """Epoch seconds as ``yyyy-MM-dd HH:mm:ss`` (session time zone, UTC here)."""
    return F.date_format(F.timestamp_seconds(epoch_seconds), "yyyy-MM-dd HH:mm:ss")


def constant_columns(df: DataFrame, **values: str) -> DataFrame:
    """Add provenance constants."""
    return df.withColumns({name: F.lit(value) for name, value in values.items()})


def only_dataset(df: DataFrame, dataset: str, column: str = "dataset") -> DataFrame:
    return df.filter(F.col(column) == dataset)


def with_fields(df: DataFrame, *columns: str) -> DataFrame:
    """Rows where every named field is present."""
    present = F.lit(True)
    for column in columns:
        present = present & F.col(column).isNotNull()
    return df.filter(present)


def recent(run_id: Column, published: Column, window: int = RUN_SECONDS,
           future_allowance: int | None = None) -> Column:
    """Published at most ``window`` seconds before the run.

    Entries dated after the run pass too, unless ``future_allowance`` bounds them.
    """
    age = run_id - published
    kept = age <= window
    return kept if future_allowance is None else kept & (age >= -future_allowance)


def has_arity(line: Column, n: int, exact: bool = True, sep: str = "\t") -> Column:
    """The line has ``n`` separated fields (or at least n)."""
    fields = F.size(F.split(line, sep, -1))
    return fields == n if exact else fields >= n


def route_rows(df: DataFrame, problems: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Split into good rows and rejected rows with a ``reason``.

    The first problem that holds names the reason; a null test counts as a problem.
    """
    reason = F.lit(None).cast("string")
    for name, bad in reversed(problems.items()):
        reason = F.when(F.coalesce(bad, F.lit(True)), F.lit(name)).otherwise(reason)
    judged = df.withColumn("reason", reason)
    return (judged.filter(F.col("reason").isNull()).drop("reason"),
            judged.filter(F.col("reason").isNotNull()))


def bernoulli_sample(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Independent draws per row; depends on how rows are partitioned."""
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)


def hash_share(key: Column) -> Column:
    """A number in [0, 1) fixed by the key alone."""
    digits = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10)
    return digits.cast("double") / F.lit(float(1 << 32))


def hash_sample(df: DataFrame, key: str, fraction: float, salt: str = "42") -> DataFrame:
    """A sample fixed by the keys, whatever the partitioning or a retried task."""
    return df.filter(hash_share(F.concat(F.lit(salt + ":"), F.col(key).cast("string")))
                     < fraction)


def in_namespaces(ns: Column, accepted: tuple[int, ...] = (0,)) -> Column:
    return F.coalesce(ns, F.lit(0)).isin(*accepted)


def is_article_title(title: Column) -> Column:
    """The title carries none of the ignored prefixes."""
    return ~title.rlike("^(?:" + "|".join(IGNORED_TITLE_PREFIXES) + "):")


def long_enough(words: Column, minimum: int = MIN_ARTICLE_WORDS) -> Column:
    return F.size(words) >= minimum


def is_plain_value(column: Column) -> Column:
    """The stringified value does not start with a quote (a quality flag)."""
    return ~column.startswith('"')
