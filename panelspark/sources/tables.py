"""Table readers and source normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.returns import simple_returns

_L, _S, _D, _TS, _DT = T.LongType(), T.StringType(), T.DoubleType(), T.TimestampType(), T.DateType()


def _schema(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in cols.items()])


SCHEMAS = {
    "articles": _schema(
        id=_L, title=_S, content=_S, url=_S, source=_S, published_at=_TS, media_outlet_id=_L, company_id=_L,
        social_data=_S, pos_score=_D, neutral_score=_D, neg_score=_D,
    ),
    "companies": _schema(id=_L, symbol=_S, name=_S, exposure=_D, metadata=_S),
    "media_outlets": _schema(id=_L, domain=_S, name=_S),
    "incoming_stories": _schema(id=_S, title=_S, url=_S, publish_date=_DT, media_name=_S, language=_S),
    "stock_prices": _schema(ticker=_S, date=_DT, close=_D),
    "vix_daily": _schema(
        trade_date=_DT, symbol=_S, open=_D, high=_D, low=_D, close=_D, adj_close=_D, volume=_L, source=_S
    ),
}


def read_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet", corrupt: str | None = None, **options) -> DataFrame:
    """Read a domain table with its declared schema. ``jdbc`` takes partitionColumn, lowerBound, ... as options.

    CSV and JSON rows that don't fit the schema have null where a value can't be read; with ``corrupt`` that column holds
    the whole row as it was read, and null for rows that fit.
    """
    reader = spark.read.format(fmt).options(**options)
    if fmt == "jdbc":
        return reader.option("dbtable", path).load()
    if name in SCHEMAS:
        schema = SCHEMAS[name]
        reader = reader.schema(T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())]) if corrupt else schema)
    if corrupt:
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt)
    if fmt == "csv":
        reader = reader.option("header", "true").option("enforceSchema", "false")
    return reader.load(path)


def relevant_ids(predictions: DataFrame, label: str = "relevant") -> DataFrame:
    """Ids predicted relevant; only the two columns needed reach the scan."""
    return predictions.filter(F.col("predicted_label") == label).select("id").distinct()


def scores_between(predictions: DataFrame, col: str, lo: float, hi: float) -> DataFrame:
    return predictions.filter((F.col(col) >= lo) & (F.col(col) < hi)).orderBy(F.desc(col), "id")


def valid_companies(companies: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return companies.filter(~blank("name") & ~blank("symbol")).orderBy("symbol")


def pick_column(df: DataFrame, *names: str) -> str | None:
    """First column whose name matches one of ``names`` ignoring case, spaces and underscores."""
    tidy = lambda s: s.strip().lower().replace(" ", "").replace("_", "")
    for wanted in names:
        for have in df.columns:
            if tidy(have) == tidy(wanted):
                return have
    return None


def _unambiguous(df: DataFrame) -> DataFrame:
    """Without the columns whose name, ignoring case, an earlier one has."""
    names = [c.lower() for c in df.columns]
    numbered = df.toDF(*(f"_{i}" for i in range(len(names))))
    return numbered.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(df.columns) if names.index(c.lower()) == i))


def canonical_ohlcv(df: DataFrame, symbol: str = "^VIX", source: str = "csv") -> DataFrame:
    """Map loosely named market columns to the fixed schema; missing optional columns become null.

    Of several columns with one loose name the first counts.
    """
    df = _unambiguous(df)
    date, close = pick_column(df, "date", "datetime", "trade_date"), pick_column(df, "close")
    if date is None or close is None:
        raise ValueError("a date and a close column are needed")
    number = lambda name: F.expr(f"try_cast(`{name}` AS DOUBLE)") if name else F.lit(None).cast("double")
    named = {n: number(pick_column(df, n)) for n in ("open", "high", "low")}
    out = df.select(
        F.expr(f"try_cast(`{date}` AS DATE)").alias("trade_date"),
        F.lit(symbol).alias("symbol"),
        *[c.alias(n) for n, c in named.items()],
        number(close).alias("close"),
        F.coalesce(number(pick_column(df, "adj_close")), number(close)).alias("adj_close"),
        number(pick_column(df, "volume")).cast("long").alias("volume"),
        F.lit(source).alias("source"),
    )
    scrub = {c: F.when(~F.isnan(c), F.col(c)) for c in ("open", "high", "low", "close", "adj_close")}
    return out.withColumns(scrub).dropna(subset=["trade_date", "close"])


def benchmark_return(*candidates: DataFrame | None, start: str, end: str) -> DataFrame:
    """Daily benchmark return from the first candidate table that has rows in the window."""
    for df in candidates:
        if df is None:
            continue
        date, close = pick_column(df, "date", "trade_date"), pick_column(df, "close", "adj close", "adjclose")
        if date is None or close is None:
            raise ValueError("benchmark needs a date and a close column")
        rows = df.select(
            F.expr(f"try_cast(`{date}` AS DATE)").alias("date"), F.expr(f"try_cast(`{close}` AS DOUBLE)").alias("close")
        ).dropna()
        rows = rows.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
        if not rows.isEmpty():
            return simple_returns(rows, None, "date", "sp500_return").select("date", "sp500_return")
    raise ValueError("no benchmark rows in the window")


def vix_levels(vix: DataFrame) -> DataFrame:
    return vix.filter(F.col("close").isNotNull()).select(F.col("trade_date").alias("date"), F.col("close").alias("vix"))
