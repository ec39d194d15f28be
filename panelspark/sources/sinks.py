"""Keyed writes as DataFrame rewrites: upserts, inserts, purges, id allocation and the run ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import domain
from ..scale import rank_in_group


def write_table(df: DataFrame, path: str, mode: str = "overwrite", dry_run: bool = False, partition_by: tuple = ()) -> int | None:
    """Write Parquet; a dry run only counts. ``overwrite`` is truncate-and-load."""
    if dry_run:
        return df.count()
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
    return None


def _folder(spark: SparkSession, path: str):
    """The path as the cluster's file system knows it, with that file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def is_folder(spark: SparkSession, path: str) -> bool:
    at, fs = _folder(spark, path)
    return fs.getFileStatus(at).isDirectory()


def table_versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole versions of a table, oldest first. A load marks its folder when all files are there, so what a
    failed one has left doesn't count."""
    at, fs = _folder(spark, path)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]
    found = [int(n.removeprefix("v")) for n in names if n.startswith("v") and n[1:].isdigit()]
    return sorted(n for n in found if fs.exists(_folder(spark, f"{path}/v{n}/_SUCCESS")[0]))


def current_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest whole version, or None before the first load."""
    versions = table_versions(spark, path)
    return spark.read.parquet(f"{path}/v{versions[-1]}") if versions else None


def replace_table(df: DataFrame, path: str, keep: int = 1, dry_run: bool = False) -> int:
    """Load the rows as the next version of a table and return its number; readers of the version before are not disturbed.

    Versions older than the last ``keep`` before this one are removed once it is whole, and so is what failed loads have left.
    If the load fails, the table stays as it was. ``dry_run`` evaluates the rows and writes nothing.
    """
    spark = df.sparkSession
    versions = table_versions(spark, path)
    number = (versions[-1] if versions else 0) + 1
    if dry_run:
        df.write.format("noop").mode("overwrite").save()
        return number
    df.write.mode("overwrite").parquet(f"{path}/v{number}")
    at, fs = _folder(spark, path)
    kept = {f"v{n}" for n in [*versions, number][-(keep + 1) :]}
    for s in fs.listStatus(at):
        if s.isDirectory() and s.getPath().getName() not in kept:
            fs.delete(s.getPath(), True)
    return number


def latest_per_key(updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last write per key; a tie in ``order`` falls to the largest remaining columns."""
    rest = [c for c in updates.columns if c not in keys and c != order]
    best = updates.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("_r"))
    return best.select(*[c if c in keys else F.col(f"_r.{c}").alias(c) for c in updates.columns])


def upsert_latest(base: DataFrame, updates: DataFrame, keys: list[str], order: str, stamp: Column | None = None) -> DataFrame:
    """Replace rows of ``base`` by the last update of the same key and set ``updated_at`` when a stamp is given."""
    new = latest_per_key(updates, keys, order).drop(*([order] if order not in base.columns else []))
    if stamp is not None:
        new = new.withColumn("updated_at", stamp)
        if "updated_at" not in base.columns:
            base = base.withColumn("updated_at", F.lit(None).cast(new.schema["updated_at"].dataType))
    return base.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_absent(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Append rows whose key is not stored yet; repeats inside the new rows keep the smallest."""
    rest = [c for c in new.columns if c not in keys]
    fresh = new.join(base.select(*keys), keys, "left_anti")
    if rest:
        fresh = fresh.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r"))
        fresh = fresh.select(*[c if c in keys else F.col(f"_r.{c}").alias(c) for c in new.columns])
    else:
        fresh = fresh.distinct()
    return base.unionByName(fresh, allowMissingColumns=True)


def write_back(base: DataFrame, updates: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Overwrite the given columns where the update has a value."""
    new = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in cols])
    out = base.join(new, key, "left")
    return out.withColumns({c: F.coalesce(f"_new_{c}", c) for c in cols}).drop(*[f"_new_{c}" for c in cols])


def purge(base: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return base.join(ids.select(key), key, "left_anti")


def assign_ids(df: DataFrame, start: Column | int, order: list[Column], name: str = "id") -> DataFrame:
    """Consecutive ids after ``start`` following ``order``; rows are range-partitioned, never sorted in one task."""
    start = F.lit(start) if isinstance(start, int) else start
    return rank_in_group(df, [], order, "_rank").withColumn(name, F.col("_rank") + start).drop("_rank")


def get_or_create_ids(dim: DataFrame, new_keys: DataFrame, key: str, id_col: str = "id") -> DataFrame:
    """Dimension extended by unseen keys, with ids continuing after the largest one."""
    unseen = new_keys.select(key).filter(F.col(key).isNotNull()).distinct().join(dim.select(key), key, "left_anti")
    top = dim.agg(F.coalesce(F.max(id_col), F.lit(0))).first()[0]
    return dim.unionByName(assign_ids(unseen, int(top), [F.col(key)], id_col), allowMissingColumns=True)


def assemble_articles(stories: DataFrame, outlets: DataFrame, company_id: str = "company_id") -> DataFrame:
    """Rows ready to insert: outlet id by domain, source name, and the origin kept as JSON."""
    rows = stories.withColumn("domain", domain(F.col("url")))
    looked_up = rows.join(outlets.select(F.col("id").alias("media_outlet_id"), "domain"), "domain", "left")
    return looked_up.select(
        "story_id",
        company_id,
        "title",
        "url",
        "media_outlet_id",
        F.coalesce(F.nullif(F.col("media_name"), F.lit("")), "domain").alias("source"),
        "published_at",
        F.to_json(F.struct("language", F.col("story_id").alias("media_cloud_id")), {"ignoreNullFields": "false"}).alias("social_data"),
    )


def pending(df: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows not yet in the output table."""
    return df.join(done.select(key), key, "left_anti")


LEDGER_KEYS = ["run_key", "company_id", "year"]


def update_ledger(ledger: DataFrame, events: DataFrame) -> DataFrame:
    """Last status, statistics and error per (run, firm, year)."""
    return upsert_latest(ledger, events, LEDGER_KEYS, "event_time")


def company_completion(ledger: DataFrame) -> DataFrame:
    done = F.count_if(F.col("status") == "completed")
    return ledger.groupBy("run_key", "company_id").agg(
        done.alias("years_completed"), F.count(F.lit(1)).alias("years"), (done == F.count(F.lit(1))).alias("completed")
    )


def open_cells(cells: DataFrame, ledger: DataFrame, force: bool = False) -> DataFrame:
    """Cells still to run: those not completed, or all of them when forced."""
    if force:
        return cells
    return cells.join(ledger.filter(F.col("status") == "completed").select(*LEDGER_KEYS), LEDGER_KEYS, "left_anti")


def merge_json(current: Column, patch: Column) -> Column:
    """Merge two JSON objects of strings; values of the patch win."""
    m = "map<string,string>"
    a = F.coalesce(F.from_json(current, m), F.create_map().cast(m))
    b = F.coalesce(F.from_json(patch, m), F.create_map().cast(m))
    return F.to_json(F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b))


def copy_selected(articles: DataFrame, keep: DataFrame, cols: list[str], nulls: tuple = ("neutral_score",)) -> DataFrame:
    """Copy columns of kept firms to a new table, forcing some columns to null."""
    chosen = [F.lit(None).cast("double").alias(c) if c in nulls else F.col(c) for c in cols]
    return articles.join(keep.select("company_id"), "company_id", "left_semi").select(*chosen)
