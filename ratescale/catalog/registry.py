"""Registration of a query with its SQL twin, and the views both sides read."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratescale.plans.views import VIEWS, with_views

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


class Source:
    """Views and base tables as attributes; a view is expanded over the parquet files of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.spark.sql(self._over_files(unfold_models(with_views([name], f"SELECT * FROM {name}"))))
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        raise AttributeError(name)

    def _over_files(self, sql: str) -> str:
        pattern = r"\b(FROM|JOIN)\s+(" + "|".join(TABLES) + r")\b(\s+[a-z]\b)?"
        return re.sub(pattern, lambda m: f"{m[1]} parquet.`{self.folder}/{m[2]}.parquet`{m[3] or ' ' + m[2]}", sql)


def unfold_models(sql: str) -> str:
    """The few models as an unfolded array instead of a join, which Spark plans without a product of tables."""
    rows = re.findall(r"\((\d+),('[^']+')\)", VIEWS["models"][1])
    models = ", ".join(f"struct({i}, {name})" for i, name in rows)
    return sql.replace("FROM items CROSS JOIN models", f"FROM items LATERAL VIEW inline(array({models})) m AS model_idx, model")


@dataclass
class Query:
    name: str
    build: Callable[[Source], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return plain(self.build(Source(spark, str(folder).rstrip("/"))))


REGISTRY: dict[str, Query] = {}


def plain(df: DataFrame) -> DataFrame:
    """Doubles to six places without minus zero or NaN, whole numbers as BIGINT: what the SQL twin gives."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            r = F.round(c.cast("double"), 6)
            c = F.when(F.isnan(r), None).when(r == 0, F.lit(0.0)).otherwise(r)
        elif isinstance(f.dataType, T.IntegralType):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, views: str = "", sql: str | None = None, num: str = "", ints: str = "", also: str = ""):
    """Register a query. `num`/`ints` list the columns of the SQL twin that are doubles / whole numbers."""

    def register(build: Callable[[Source], DataFrame]):
        twin = None
        if sql is not None:
            repl = [
                f"CASE WHEN isnan(CAST({c} AS DOUBLE)) THEN NULL WHEN round(CAST({c} AS DOUBLE), 6) = 0 THEN 0.0::DOUBLE "
                f"ELSE round(CAST({c} AS DOUBLE), 6) END AS {c}"
                for c in num.split()
            ] + [f"CAST({c} AS BIGINT) AS {c}" for c in ints.split()]
            body = sql.strip().rstrip(";")
            head = "SELECT *" + (f" REPLACE ({', '.join(repl)})" if repl else "")
            rest = ""
            recursive = body.upper().startswith("WITH RECURSIVE ")
            if body.upper().startswith("WITH "):
                rest, body = _split_ctes(body[15:] if recursive else body[5:])
            twin = with_views(views.split(), f"{head} FROM ({body}) AS result_rows", rest)
            if recursive:
                twin = "WITH RECURSIVE " + twin[5:]
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, build, twin)
        return build

    return register


def _split_ctes(sql: str) -> tuple[str, str]:
    """Split `a AS (...), b AS (...) SELECT ...` into the CTE list and the body."""
    rest, depth, quote = sql, 0, False
    for i, ch in enumerate(rest):
        if ch == "'":
            quote = not quote
        elif not quote:
            depth += (ch == "(") - (ch == ")")
            if depth == 0 and ch == ")":
                if re.match(r"\s*SELECT\b", rest[i + 1:], re.I):
                    return rest[: i + 1], rest[i + 1:].strip()
    raise ValueError("no body after the CTEs")
