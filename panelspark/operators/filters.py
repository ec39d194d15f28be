"""Row filters, firm matching and small projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed_values import COMPANY_KEYWORDS, EXCLUDED_COMPANIES
from ..functions.dates import month_index
from ..functions.text import normalise_or_empty, not_blank


def in_window(df: DataFrame, ts: str, start: str, end: str, firm: str | None = None) -> DataFrame:
    """Inclusive date window as a half-open range of the column's own type, so that it reaches the Parquet scan."""
    kind = df.schema[ts].dataType
    out = df.filter(
        (F.col(ts) >= F.lit(start).cast(kind)) & (F.col(ts) < F.date_add(F.lit(end).cast("date"), 1).cast(kind))
    )
    return out.filter(F.col(firm).isNotNull()) if firm else out


def has_scores() -> Column:
    return F.col("pos_score").isNotNull() & F.col("neg_score").isNotNull() & F.col("neutral_score").isNotNull()


def top_score() -> Column:
    return F.greatest("pos_score", "neg_score", "neutral_score")


def scored_only(df: DataFrame, tau: float = 0.0) -> DataFrame:
    return df.filter(has_scores() & (top_score() >= tau))


def unscored_newest(df: DataFrame, n: int, score: str = "pos_score") -> DataFrame:
    """The n newest rows still without a score."""
    return df.filter(F.col(score).isNull()).orderBy(F.desc("published_at"), F.desc("id")).limit(n)


def score_band(df: DataFrame, col: str, lo: float, hi: float) -> DataFrame:
    return df.filter((F.col(col) >= lo) & (F.col(col) < hi))


def only_firms(df: DataFrame, firms: list, col: str = "ticker") -> DataFrame:
    return df.filter(F.col(col).isin(*firms))


def _firm_columns(companies: DataFrame) -> DataFrame:
    return companies.select(
        F.col("id").alias("company_id"), F.col("name").alias("company_name"), F.col("symbol").alias("company_symbol")
    )


def _occurs(title: Column, needle: Column, word_boundary: bool, wildcards: bool) -> Column:
    if word_boundary:
        quoted = F.concat(F.lit(r"(?U)\b\Q"), F.lower(needle), F.lit(r"\E\b"))
        return F.regexp_like(F.lower(title), quoted)
    if wildcards:
        return F.like(F.lower(title), F.concat(F.lit("%"), F.lower(needle), F.lit("%")))
    return F.contains(F.lower(title), F.lower(needle))


def mention(mode: str = "sql", word_boundary: bool = False, title: str = "title") -> Column:
    """Headline names the firm or its symbol.

    ``sql`` compares lower-cased text; ``like`` lets % and _ in names act as wildcards; ``normalised`` collapses white
    space first and never matches an empty name.
    """
    t, name, symbol = F.col(title), F.col("company_name"), F.col("company_symbol")
    if mode == "normalised":
        text, n, s = normalise_or_empty(t), normalise_or_empty(name), normalise_or_empty(symbol)
        return ((n != "") & F.contains(text, n)) | ((s != "") & F.contains(text, s))
    hit = lambda needle: _occurs(t, needle, word_boundary, mode == "like")
    return not_blank(t) & (hit(name) | hit(symbol))


def mentions_company(
    articles: DataFrame, companies: DataFrame, mode: str = "sql", word_boundary: bool = False
) -> DataFrame:
    """Articles joined to their firm on the key, keeping those whose headline names it."""
    if mode == "alias":
        return alias_mentions(articles, companies)
    joined = articles.join(_firm_columns(companies), "company_id")
    keep = mention(mode, word_boundary)
    if mode != "normalised":
        keep = keep & F.col("published_at").isNotNull()
    return joined.filter(keep)


def alias_mentions(
    articles: DataFrame,
    companies: DataFrame,
    keywords: dict[str, list[str]] = COMPANY_KEYWORDS,
    excluded: list[str] = EXCLUDED_COMPANIES,
) -> DataFrame:
    """Keep headlines holding one of the firm's keywords; the default keyword is the lower-cased name."""
    firms = _firm_columns(companies).filter(~F.col("company_name").isin(*excluded))
    words = F.create_map(*[x for n, ks in keywords.items() for x in (F.lit(n), F.array(*[F.lit(k) for k in ks]))])
    firms = firms.withColumn("_words", F.coalesce(words[F.col("company_name")], F.array(F.lower("company_name"))))
    title = F.lower("title")
    return (
        articles.join(firms, "company_id")
        .filter(F.col("title").isNotNull() & (F.col("title") != ""))
        .filter(F.exists("_words", lambda w: F.contains(title, w)))
        .drop("_words")
    )


def title_failures(articles: DataFrame, companies: DataFrame) -> DataFrame:
    """Complement of the headline check: blank headline, unknown firm, or no mention."""
    joined = articles.join(_firm_columns(companies).withColumn("_known", F.lit(True)), "company_id", "left")
    hit = F.contains(F.lower("title"), F.lower("company_name")) | F.contains(F.lower("title"), F.lower("company_symbol"))
    # a null test is neither hit nor miss, as in SQL: the row is kept out of the failures
    failed = ~not_blank(F.col("title")) | F.col("_known").isNull() | ~hit
    return joined.filter(failed).select(
        "id",
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("company_name", F.lit("")).alias("company_name"),
        F.coalesce("company_symbol", F.lit("")).alias("symbol"),
        "published_at",
    )


def newest(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(F.desc_nulls_last("published_at"), F.desc("id")).limit(n)


def clean_labels(df: DataFrame, classes: tuple = ("relevant", "irrelevant")) -> DataFrame:
    """Drop rows without headline or label, tidy the label, keep the given classes."""
    return (
        df.dropna(subset=["title", "label"])
        .withColumn("label", F.lower(F.trim("label")))
        .filter(F.col("label").isin(*classes))
    )


def stance(null_as_zero: bool = False) -> Column:
    pos, neg = F.col("pos_score"), F.col("neg_score")
    if null_as_zero:
        pos, neg = F.coalesce(pos, F.lit(0.0)), F.coalesce(neg, F.lit(0.0))
    return pos - neg


def post_flag(day: str, cutoff: str) -> Column:
    return (F.col(day) >= F.lit(cutoff).cast("date")).cast("int")


def month_label(m: int) -> str:
    return "m0" if m == 0 else f"{'p' if m > 0 else 'm'}{abs(m)}"


def event_dummies(df: DataFrame, day: str, lo: int = -24, hi: int = 24, ref: int = -1, base_year: int = 2020) -> DataFrame:
    """Restrict to the event window and add one 0/1 column per month other than the reference."""
    out = df.withColumn("event_month", month_index(F.col(day), base_year))
    out = out.filter(F.col("event_month").between(lo, hi))
    return out.withColumns(
        {f"event_{month_label(m)}": (F.col("event_month") == m).cast("int") for m in range(lo, hi + 1) if m != ref}
    )


def did_features(df: DataFrame, cutoff_year: int = 2020, critical: list[str] | None = None) -> DataFrame:
    """Article-level difference-in-differences columns; rows missing a critical column are dropped."""
    out = df
    if "bias_score" not in df.columns:
        out = out.withColumn("bias_score", stance(null_as_zero=True))
    if "exposure" not in df.columns:
        out = out.withColumn("exposure", F.lit(0.0))
    out = (
        out.withColumn("year_month", F.date_format("published_at", "yyyy-MM"))
        .withColumn("post_2020", (F.year("published_at") >= cutoff_year).cast("int"))
        .withColumn("post_x_exposure", F.col("post_2020") * F.col("exposure"))
    )
    return out.dropna(subset=critical or ["bias_score", "company_id", "media_outlet_id", "year_month", "post_x_exposure"])
