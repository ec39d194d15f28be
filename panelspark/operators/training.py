"""Seeded sampling, label assembly, verdicts and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..scale import checkpointed, rank_in_group, sampling_hash, unit_hash
from ..session import PSEUDO_CONFIDENCE
from .dedup import merge_sources
from .filters import clean_labels
from .relevance import argmax_label, label_filter


def sample_n(df: DataFrame, n: int, id_col: str = "id", seed: int = 42) -> DataFrame:
    """Uniform sample of n rows, the same for the same seed."""
    return _first_n(df, n, sampling_hash(id_col, seed), id_col)


def _first_n(df: DataFrame, n: int, key: Column, id_col: str) -> DataFrame:
    """The n rows with the smallest key; positions keep a large sample spread out."""
    ranked = rank_in_group(df.withColumn("_h", key), [], [F.col("_h"), F.col(id_col)], "_rn")
    return ranked.filter(F.col("_rn") <= n).drop("_rn", "_h")


def shuffle(df: DataFrame, id_col: str = "id", seed: int = 42) -> DataFrame:
    return df.orderBy(sampling_hash(id_col, seed), id_col)


def cap_per_group(df: DataFrame, keys: list[str], n: int | Column, id_col: str = "id", seed: int = 42) -> DataFrame:
    """At most n random rows per group; n may follow from the keys.

    The rows are worked out and stored once, and only keys and ids are sorted; the rows of the chosen numbers follow.
    """
    rows = checkpointed(df.withColumn("_row", F.monotonically_increasing_id()))
    order = list(dict.fromkeys([*keys, id_col]))
    ranked = rank_in_group(rows.select(*order, "_row", sampling_hash(id_col, seed).alias("_h")), keys, [F.col("_h"), F.col(id_col)], "_rn")
    return rows.join(ranked.filter(F.col("_rn") <= n).select("_row"), "_row", "left_semi").drop("_row")


def cap_per_class(df: DataFrame, group: str, cap: int, label: str = "label", id_col: str = "id", seed: int = 42) -> DataFrame:
    """At most ``cap`` irrelevant and ``cap // 3`` relevant rows per group."""
    limit = F.when(F.col(label) == "irrelevant", cap).otherwise(cap // 3)
    return cap_per_group(df.filter(F.col(label).isin("irrelevant", "relevant")), [group, label], limit, id_col, seed)


def stratified_topup(df: DataFrame, group: str, n: int, id_col: str = "id", seed: int = 42) -> DataFrame:
    """Equal quota per group, then random rows from the rest until n is reached."""
    groups = df.agg(F.countDistinct(group)).first()[0]
    base = cap_per_group(df, [group], max(1, n // max(groups, 1)), id_col, seed)
    short = n - base.count()
    if short <= 0:
        return base
    rest = df.join(base.select(id_col), id_col, "left_anti")
    return base.unionByName(sample_n(rest, short, id_col, seed))


def weighted_sample(
    pool: DataFrame, gold: DataFrame, n: int, group: str = "company_name", id_col: str = "id", seed: int = 42
) -> DataFrame:
    """Sample without replacement favouring groups with few relevant gold rows, with a minimum per group.

    A row's key is -ln(u)/w with u from its hash (Efraimidis and Spirakis, 2006): the smallest keys form the sample.
    """
    pool = pool.join(gold.select(id_col), id_col, "left_anti")
    groups = pool.agg(F.countDistinct(group)).first()[0]
    floor = max(2, n // (max(groups, 1) * 3))
    first = cap_per_group(pool, [group], floor, id_col, seed)
    short = n - first.count()
    if short <= 0:
        return shuffle(first, id_col, seed)
    seen = gold.filter(F.col("label") == "relevant").groupBy(group).agg(F.count(F.lit(1)).alias("_c"))
    rest = pool.join(first.select(id_col), id_col, "left_anti").join(seen, group, "left")
    key = -F.ln(unit_hash(id_col, seed)) * (F.coalesce("_c", F.lit(0)) + 1)
    extra = _first_n(rest, short, key, id_col).select(*pool.columns)
    return shuffle(first.unionByName(extra), id_col, seed)


def assign_folds(df: DataFrame, k: int, label: str = "label", id_col: str = "id", seed: int = 42) -> DataFrame:
    """Stratified folds of equal size per class."""
    ranked = rank_in_group(df.withColumn("_h", sampling_hash(id_col, seed)), [label], [F.col("_h"), F.col(id_col)], "_rn")
    return ranked.withColumn("fold", ((F.col("_rn") - 1) % k).cast("int")).drop("_rn", "_h")


def pseudo_labels(
    scored: DataFrame, gold: DataFrame, tau: float = PSEUDO_CONFIDENCE, cap: int = 300, group: str = "company_name", seed: int = 42
) -> DataFrame:
    """Gold rows followed by confident predictions, capped per group and class."""
    gold = gold.filter(F.col("source") == "gold_manual")
    pool = argmax_label(scored.join(gold.select("id"), "id", "left_anti"), "p_rel", 0.0)
    sure = pool.filter(F.col("confidence_score") >= tau)
    sure = sure.withColumn("label", F.col("predicted_label")).withColumn("source", F.lit("pseudo_label"))
    cols = ["id", "title", "label", "source", group]
    return merge_sources(gold.select(*cols), cap_per_class(sure, group, cap, seed=seed).select(*cols))


def training_set(gold: DataFrame, annotated: DataFrame, cap: int = 200, group: str = "company_name", seed: int = 42) -> DataFrame:
    """Gold labels plus filtered and capped annotations; gold wins on id."""
    gold = clean_labels(gold).withColumn("source", F.lit("gold_manual"))
    rows = clean_labels(annotated).join(gold.select("id"), "id", "left_anti")
    rows = rows.filter(F.col(group).isNotNull() & (F.trim(group) != ""))
    rows = label_filter(rows).filter(F.col("label") != "DROP").withColumn("source", F.lit("llm_v2"))
    cols = ["id", "title", "label", "source", group]
    return merge_sources(gold.select(*cols), cap_per_class(rows, group, cap, seed=seed).select(*cols))


def training_report(df: DataFrame, group: str = "company_name") -> DataFrame:
    rel = F.count_if(F.col("label") == "relevant")
    pct = rel * 100 / F.count(F.lit(1))
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        rel.alias("relevant"),
        F.count_if(F.col("label") == "irrelevant").alias("irrelevant"),
        F.count_if(F.col("source") == "gold_manual").alias("gold"),
        F.countDistinct(group).alias("firms"),
        pct.alias("relevant_pct"),
        F.when(pct < 20, "low").when(pct > 45, "high").otherwise("ok").alias("balance"),
    )


def label_corrections(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows dropped and rows whose label changed in the filter."""
    both = before.select("id", F.lower(F.trim("label")).alias("_b")).join(after.select("id", F.col("label").alias("_a")), "id")
    return both.agg(
        F.count_if(F.col("_a") == "DROP").alias("dropped"),
        F.count_if((F.col("_a") != "DROP") & (F.col("_a") != F.col("_b"))).alias("corrected"),
        F.count(F.lit(1)).alias("total"),
    )


def apply_verdicts(df: DataFrame, verdicts: DataFrame, default: str = "REJECT") -> DataFrame:
    """Second pass over annotated positives only: anything but CONFIRM turns irrelevant."""
    v = verdicts.select("id", F.col("verdict").alias("_v"))
    checked = (F.col("source") == "llm_v2") & (F.col("label") == "relevant")
    kept = F.coalesce("_v", F.lit(default)) == "CONFIRM"
    return df.join(v, "id", "left").withColumn("label", F.when(checked & ~kept, "irrelevant").otherwise(F.col("label"))).drop("_v")


def audit_verdicts(sample: DataFrame, verdicts: DataFrame) -> DataFrame:
    v = verdicts.select("id", F.col("verdict").alias("_v"))
    return sample.join(v, "id", "left").withColumn("audit_verdict", F.coalesce("_v", F.lit("IRRELEVANT"))).drop("_v")


def audit_rate(audited: DataFrame, by: list[str] | None = None) -> DataFrame:
    """False-negative rate of an audited sample, with its band."""
    flipped = F.count_if(F.col("audit_verdict") == "RELEVANT")
    rate = flipped * 100 / F.count(F.lit(1))
    return audited.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_audited"),
        flipped.alias("n_flipped"),
        rate.alias("fn_rate"),
        F.when(rate > 5, "action").when(rate > 2, "warning").otherwise("ok").alias("band"),
    )


def parse_verdicts(df: DataFrame, response: str = "response", value: str = "verdict", allowed: tuple = ("CONFIRM", "REJECT")) -> DataFrame:
    """One row per answer in batched model responses.

    The text from the first ``[`` to the last ``]`` is read as JSON; if that fails, id and value are found by pattern.
    """
    text = F.col(response)
    raw = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    pattern = rf'(?is)"id"\s*:\s*"?([^",}}\s]+)"?.*?"{value}"\s*:\s*"({"|".join(allowed)})"'
    parsed = F.from_json(raw, f"array<struct<id:string,{value}:string>>")
    ids = F.regexp_extract_all(raw, F.lit(pattern), F.lit(1))
    values = F.transform(F.regexp_extract_all(raw, F.lit(pattern), F.lit(2)), lambda v: F.upper(v))
    found = F.zip_with(ids, values, lambda i, v: F.struct(F.trim(i).alias("id"), v.alias(value)))
    # a response that does not parse gives null or entries without id
    usable = parsed.isNotNull() & ~F.exists(parsed, lambda r: r.isNull() | r["id"].isNull())
    rows = df.withColumn("_r", F.explode(F.when(usable, parsed).otherwise(found)))
    return rows.select(*[c for c in df.columns if c != response], "_r.*")


def sample_weights(df: DataFrame, gold_weight: float = 5.0, source: str = "source") -> DataFrame:
    return df.withColumn("sample_weight", F.when(F.trim(source) == "gold_manual", gold_weight).otherwise(1.0))


def class_weights(df: DataFrame, cap: float = 1.5, label: str = "label") -> DataFrame:
    """Balanced class weights n / (2 n_c), the relevant one at most ``cap`` times the irrelevant one."""
    rel, irr = F.count_if(F.col(label) == "relevant"), F.count_if(F.col(label) == "irrelevant")
    counts = df.agg(rel.alias("rel"), irr.alias("irr"))
    n = F.col("rel") + F.col("irr")
    wi, wr = F.try_divide(n, 2 * F.col("irr")), F.try_divide(n, 2 * F.col("rel"))
    return counts.select(wi.alias("w_irrelevant"), F.when(wr > cap * wi, cap * wi).otherwise(wr).alias("w_relevant"))
