"""Writers: tables, rejects, failed rows, JSON summaries, tagged records and report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# whitespace at the ends of cells belongs to the text
CSV = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).options(**CSV).csv(path)


def write_csv_tree(df: DataFrame, path: str, folders: Sequence[str], mode: str = "overwrite") -> None:
    """One folder per value of the named columns; the files hold the other columns."""
    df.write.mode(mode).options(**CSV).partitionBy(*folders).csv(path)


def write_rejects(rejected: DataFrame, path: str, source: str = "source_novel") -> None:
    """Rejected rows appended, one folder per source."""
    rejected.write.mode("append").partitionBy(source).parquet(path)


def write_failed(failed: DataFrame, path: str) -> None:
    """Rows that failed, with their error, appended."""
    failed.filter(F.col("error").isNotNull()).write.mode("append").parquet(path)


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in floats})


def json_summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One JSON object per key; missing and NaN values are written as null."""
    clean = nan_to_null(df)
    body = F.to_json(F.struct(*clean.columns), {"ignoreNullFields": "false"})
    return clean.select(*keys, body.alias("value"))


def write_json_summary(df: DataFrame, keys: Sequence[str], path: str) -> None:
    json_summary(df, keys).write.mode("overwrite").partitionBy(*keys).text(path)


def read_json_summary(spark, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def tagged_records(parts: dict[str, DataFrame]) -> DataFrame:
    """Records of several tables as one column of JSON texts `{"type": ..., "data": {...}}`."""
    out = None
    for name, df in parts.items():
        one = df.select(F.to_json(F.struct(F.lit(name).alias("type"), F.struct(*df.columns).alias("data"))).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def write_tagged_records(parts: dict[str, DataFrame], path: str) -> None:
    tagged_records(parts).write.mode("overwrite").text(path)


def decimals(value: Column, digits: int = 3) -> Column:
    """Fixed decimals, `/` for a missing value."""
    v = F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    text = F.format_string(f"%.{digits}f", v) if digits else v.cast("long").cast("string")
    return F.when(v.isNull(), "/").otherwise(text)


def with_p(r: Column, p: Column) -> Column:
    return F.when(F.nanvl(r.cast("double"), F.lit(None).cast("double")).isNull(), "/").otherwise(F.concat(decimals(r), F.lit("(p="), decimals(p), F.lit(")")))


def percent(value: Column, digits: int = 1) -> Column:
    v = F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    return F.when(v.isNull(), "/").otherwise(F.format_string(f"%.{digits}f%%", v * 100))


def with_interval(r: Column, low: Column, high: Column) -> Column:
    """`0.512 [0.401, 0.603]`; dashes for a missing interval, nothing for a missing value."""
    gone = lambda c: F.nanvl(c.cast("double"), F.lit(None).cast("double")).isNull()
    span = F.when(gone(low) | gone(high), "[—, —]").otherwise(F.concat(F.lit("["), decimals(low), F.lit(", "), decimals(high), F.lit("]")))
    return F.when(gone(r), "").otherwise(F.concat(decimals(r), F.lit(" "), span))


def markdown_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Body lines of a report table."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def write_markdown(df: DataFrame, columns: Sequence[str], titles: Sequence[str], order: Sequence[Column], path: str) -> None:
    """A report table as one text file: title, rule and the rows in order. Report tables are aggregates."""
    lines = df.sparkSession.createDataFrame([(0, "| " + " | ".join(titles) + " |"), (1, "| " + " | ".join("-----" for _ in titles) + " |")], "part int, value string")
    body = df.orderBy(*order).withColumn("_line", F.monotonically_increasing_id())
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    rows = body.select(F.lit(2).alias("part"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"), "_line")
    whole = lines.withColumn("_line", F.lit(0).cast("long")).unionByName(rows).repartition(1).sortWithinPartitions("part", "_line")
    whole.select("value").write.mode("overwrite").text(path)
