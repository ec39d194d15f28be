"""Headline rules, score ensemble, thresholds and the scoring plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from ..functions.screening import Screen
from ..scale import checkpointed
from ..session import ENSEMBLE_THRESHOLD

# case-insensitive, Unicode classes, and a dot that stops at line feeds only
_FLAGS = "(?iUd)"


# every test that reads a whole title: one scan for all their literals tells which of them can succeed
TITLE_PATTERNS = [
    fv.CONSUMER_PATTERN, fv.ANALYST_ACTION_PATTERN, fv.CRIME_PATTERN, fv.LIFESTYLE_PATTERN, fv.VISA_EXCLUSION, fv.INTEL_EXCLUSION, fv.TARGET_EXCLUSION,
    *(p for r in fv.ADJUSTMENT_RULES for p in (*r.get("patterns", []), *([r["also_pattern"]] if "also_pattern" in r else []))),
]
TITLE_PHRASES = [r[k] for r in fv.ADJUSTMENT_RULES for k in ("phrases", "also", "unless") if k in r]
SCREEN = Screen(TITLE_PATTERNS, TITLE_PHRASES)


def matches(text: Column, pattern: str, seen: Column | None = None) -> Column:
    """The pattern matches; ``seen``, the screen of the text, spares texts without any of its literals."""
    hit = text.rlike(_FLAGS + pattern)
    return hit if seen is None else SCREEN.may(seen, pattern) & hit


def any_phrase(lowered: Column, phrases: list[str], seen: Column | None = None) -> Column:
    """One of the phrases occurs literally; a single expression keeps the generated code small."""
    if not phrases:
        return F.lit(False)
    hit = lowered.rlike("|".join(rf"\Q{p}\E" for p in phrases))
    return hit if seen is None else SCREEN.may(seen, phrases) & hit


def _text(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def _blocked_source() -> Column:
    return F.lower(_text("source")).isin(*fv.SOURCE_BLOCKLIST)


def _analyst_action(firms: list[str], must_be_named: bool, seen: Column | None) -> Column:
    title, firm = _text("title"), _text("company_name")
    rated = firm.isin(*firms) & matches(title, fv.ANALYST_ACTION_PATTERN, seen)
    return rated & F.contains(F.lower(title), F.lower(firm)) if must_be_named else rated


def _other_entity(patterns: dict[str, str], seen: Column | None) -> Column:
    hit = F.lit(False)
    for firm, pattern in patterns.items():
        hit = hit | ((_text("company_name") == firm) & matches(_text("title"), pattern, seen))
    return hit


def _forced_irrelevant(exclusions: dict[str, str], seen: Column | None = None) -> Column:
    return (
        _blocked_source()
        | matches(_text("title"), fv.CONSUMER_PATTERN, seen)
        | _analyst_action(fv.ANALYST_FIRMS, True, seen)
        | _other_entity(exclusions, seen)
    )


def hard_filter(seen: Column | None = None) -> Column:
    """True for rows that are irrelevant before any scoring."""
    return _forced_irrelevant(fv.HARD_EXCLUSIONS, seen)


def _screened(df: DataFrame) -> DataFrame:
    return df.withColumn("_seen", SCREEN.of(_text("title")))


def post_filter(df: DataFrame, label: str = "predicted_label") -> DataFrame:
    """The same tests applied after scoring, with one more firm exclusion."""
    forced = _forced_irrelevant(fv.POST_EXCLUSIONS, F.col("_seen"))
    return _screened(df).withColumn(label, F.when(forced, "irrelevant").otherwise(F.col(label))).drop("_seen")


def label_filter(df: DataFrame) -> DataFrame:
    """Annotated labels: hedged reasons become DROP, positives hitting a known error pattern become irrelevant."""
    title, seen = _text("title"), F.col("_seen")
    label = F.lower(F.trim(_text("label")))
    wrong = (
        matches(title, fv.CONSUMER_PATTERN, seen)
        | matches(title, fv.CRIME_PATTERN, seen)
        | matches(title, fv.LIFESTYLE_PATTERN, seen)
        | _analyst_action(fv.LABEL_ANALYST_FIRMS, False, seen)
        | _other_entity(fv.LABEL_EXCLUSIONS, seen)
    )
    return _screened(df).withColumn(
        "label",
        F.when(matches(_text("reason"), fv.HEDGE_PATTERN), "DROP")
        .when((label == "relevant") & wrong, "irrelevant")
        .otherwise(label),
    ).drop("_seen")


def _fires(rule: dict, strict: bool) -> Column:
    title, lowered, firm, seen = (F.col(c) for c in ("_trimmed", "_lowered", "_firm", "_seen"))
    phrases = list(rule.get("phrases", []))
    literal = any_phrase(lowered, phrases, seen)
    if strict and "ice" in phrases:
        rest = [p for p in phrases if p != "ice"]
        literal = SCREEN.may(seen, phrases) & (any_phrase(lowered, rest) | matches(title, r"\bice\b"))
    hit = literal
    for pattern in rule.get("patterns", []):
        hit = hit | matches(title, pattern, seen)
    if "company_contains" in rule:
        hit = hit & F.contains(firm, F.lit(rule["company_contains"]))
    if "also" in rule:
        hit = hit & any_phrase(lowered, rule["also"], seen)
    if "also_pattern" in rule:
        hit = hit & matches(title, rule["also_pattern"], seen)
    if "unless" in rule:
        hit = hit & ~any_phrase(lowered, rule["unless"], seen)
    return hit


def adjust_scores(df: DataFrame, prob: str = "ensemble_prob", strict: bool = False) -> DataFrame:
    """Lower scores by the first matching headline rule; adds ``adj_prob`` and ``rule_fired``.

    ``strict`` matches the immigration-agency abbreviation as a word; by default it is a plain substring.
    """
    rows = df if "_seen" in df.columns else _screened(df)
    # columns of their own: within the chain of rules they would be worked out again for every rule
    trimmed = F.regexp_replace(_text("title"), r"^\s+|\s+$", "")
    rows = rows.withColumns({"_trimmed": trimmed, "_firm": F.lower(F.trim(_text("company_name")))}).withColumn("_lowered", F.lower("_trimmed"))
    # the number of the first rule that fires is worked out once; score and name are looked up by it
    chain = None
    for i, rule in enumerate(fv.ADJUSTMENT_RULES):
        hit = _fires(rule, strict)
        chain = F.when(hit, F.lit(i)) if chain is None else chain.when(hit, F.lit(i))
    look_up = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("_rule"))
    floor = look_up([r["floor"] for r in fv.ADJUSTMENT_RULES])
    cut = look_up([1e9 if r["cut"] is None else r["cut"] for r in fv.ADJUSTMENT_RULES])
    out = rows.withColumn("_rule", chain)
    adjusted = F.when(F.col("_rule").isNull(), F.col(prob)).otherwise(F.greatest(floor, F.col(prob) - cut))
    name = F.coalesce(look_up([r["name"] for r in fv.ADJUSTMENT_RULES]), F.lit(""))
    drop = ["_rule", "_trimmed", "_lowered", "_firm", *([] if "_seen" in df.columns else ["_seen"])]
    return out.withColumns({"adj_prob": adjusted, "rule_fired": name}).drop(*drop)


def ensemble(df: DataFrame, cols: list[str], weights: list[float] | None = None, name: str = "ensemble_prob") -> DataFrame:
    """Weighted mean of model scores with weights summing to one."""
    weights = weights or [1.0] * len(cols)
    total = float(sum(weights))
    mix = F.lit(0.0)
    for c, w in zip(cols, weights):
        mix = mix + F.col(c) * F.lit(w / total)
    return df.withColumn(name, mix)


def classify(
    df: DataFrame,
    threshold: float = ENSEMBLE_THRESHOLD,
    score: Callable[[DataFrame], DataFrame] | None = None,
    strict: bool = False,
) -> DataFrame:
    """Hard filter, score the survivors only, adjust, threshold. Filtered rows keep null scores and are irrelevant.

    ``score`` adds ``ensemble_prob``; without it the column must exist. It runs on the surviving rows alone.
    """
    flagged = _screened(df).withColumn("_hard", hard_filter(F.col("_seen")))
    if score is None:
        done = adjust_scores(flagged, strict=strict)
    else:
        flagged = checkpointed(flagged)  # else the titles would be read and filtered once for either branch
        dropped = flagged.filter("_hard").withColumns(
            {"ensemble_prob": F.lit(None).cast("double"), "adj_prob": F.lit(None).cast("double"), "rule_fired": F.lit("")}
        )
        done = adjust_scores(score(flagged.filter("NOT _hard")), strict=strict).unionByName(dropped, allowMissingColumns=True)
    keep = ~F.col("_hard")
    return done.withColumns(
        {
            "predicted_label": F.when(keep & (F.col("adj_prob") >= threshold), "relevant").otherwise("irrelevant"),
            "ensemble_prob": F.when(keep, F.bround("ensemble_prob", 4)),
            "adj_prob": F.when(keep, F.bround("adj_prob", 4)),
            "rule_fired": F.when(keep, F.col("rule_fired")).otherwise(""),
        }
    ).drop("_hard", "_seen")


def score_batches(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], name: str = "ensemble_prob", setup: Callable[[], object] | None = None
) -> DataFrame:
    """Score rows with the caller's model over Arrow batches; ``setup`` loads it once per partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = setup() if setup else None
        for pdf in batches:
            pdf[name] = fn(pdf) if model is None else fn(pdf, model)
            yield pdf

    return df.mapInPandas(run, df.select("*", F.lit(0.0).alias(name)).schema)


def argmax_label(df: DataFrame, p_relevant: str = "p_rel", tau: float = 0.65) -> DataFrame:
    """Label of the larger class probability, ``uncertain`` below tau, with the confidence."""
    p = F.col(p_relevant)
    conf = F.greatest(p, 1 - p)
    label = F.when(conf < tau, "uncertain").when(p > 1 - p, "relevant").otherwise("irrelevant")
    return df.withColumns({"confidence_score": conf, "predicted_label": label})


def three_way(df: DataFrame, p_relevant: str = "p_rel", hi: float = 0.75, lo: float = 0.50) -> DataFrame:
    p = F.col(p_relevant)
    return df.withColumn(
        "predicted", F.when(p >= hi, "relevant").when(p <= lo, "irrelevant").otherwise("uncertain")
    )
