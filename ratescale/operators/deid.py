"""Participant ids replaced by pseudonyms, the same in every table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratescale.operators.joins import append_distinct, backend_keys
from ratescale.operators.scale import attach_table, value_prefix
from ratescale.session import cut_lineage

# Prefixes of the pseudonyms and columns that must not be published.
ID_PREFIXES = {"prolific_id": "P", "submission_id": "S"}
BROADCAST_BYTES = 32 << 20  # of a re-link table that is sent to all tasks
SENSITIVE = ("Ethnicity_simplified", "languages", "comments")


def dense_numbers(values: DataFrame, column: str) -> DataFrame:
    """Numbers 1, 2, 3, ... of the distinct values in sorted order, without sorting them in one place."""
    one = values.filter(F.col(column).isNotNull()).select(column).distinct().withColumn("_one", F.lit(1))
    return value_prefix(one, column, "_one").select(column, (F.col("_before") + 1).alias("number"), F.col("_all").alias("n_values"))


def build_mapping(tables: Sequence[DataFrame], column: str, prefix: str) -> DataFrame:
    """One pseudonym per distinct id over all tables: prefix and number, padded to at least three digits."""
    ids = [t.select(F.col(column).cast("string").alias("original")) for t in tables if column in t.columns]
    numbered = dense_numbers(reduce(DataFrame.unionByName, ids), "original")
    width = F.greatest(F.lit(3), F.length(F.col("n_values").cast("string")))
    padded = F.concat(F.repeat(F.lit("0"), width - F.length(F.col("number").cast("string"))), F.col("number").cast("string"))
    return numbered.select("original", F.concat(F.lit(prefix), padded).alias("pseudonym"))


def already_pseudonymous(tables: Sequence[DataFrame], column: str, prefix: str) -> Column:
    """A single value: are all ids of the column pseudonyms already?"""
    ids = [t.select(F.col(column).cast("string").alias("v")) for t in tables if column in t.columns]
    flags = reduce(DataFrame.unionByName, ids).agg(F.coalesce(F.bool_and(F.regexp_like("v", F.lit(rf"^{prefix}\d+$"))), F.lit(False)))
    return flags.scalar()


def id_mappings(tables: Sequence[DataFrame], prefixes: Mapping[str, str] = ID_PREFIXES) -> DataFrame:
    """Re-link table of all id columns: column, original, pseudonym. Columns done before give no rows.

    The tables are read once for each column; what follows reads their distinct ids.
    """
    parts = []
    for column, prefix in prefixes.items():
        having = [t.select(F.col(column).cast("string").alias(column)) for t in tables if column in t.columns]
        if having:
            ids = [cut_lineage(reduce(DataFrame.unionByName, having).distinct())]
            done = already_pseudonymous(ids, column, prefix)
            mapping = build_mapping(ids, column, prefix).withColumn("_done", done).filter("not _done").drop("_done")
            parts.append(mapping.select(F.lit(column).alias("id_column"), "original", "pseudonym"))
    return reduce(DataFrame.unionByName, parts)


def apply_mapping(table: DataFrame, relink: DataFrame, columns: Sequence[str] = tuple(ID_PREFIXES), small: bool | None = None) -> DataFrame:
    """Ids by their pseudonyms; ids without one stay.

    A re-link table of few bytes (`small`; worked out if not given) is broadcast, so the table is not shuffled for any of its id columns.
    Otherwise each column is a join in which a participant with very many rows is spread by `attach_table`.
    """
    if small is None:
        small = is_small(relink)
    out = table
    for column in columns:
        if column not in out.columns:
            continue
        own = relink.filter(F.col("id_column") == column).select(F.col("original").alias(column), F.col("pseudonym").alias("_p"))
        named = out.withColumn(column, F.col(column).cast("string"))
        if small:
            joined = named.join(F.broadcast(own), column, "left")
        else:
            sizes = named.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
            joined = attach_table(named, [column], own.join(sizes, column), ["_p"], "_n")
        out = joined.withColumn(column, F.coalesce("_p", column)).drop("_p")
    return out.select(*table.columns)


def is_small(relink: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    size = relink.agg(F.sum(F.octet_length("original") + F.octet_length("pseudonym") + 32)).first()[0]
    return (size or 0) <= most


def resolve_backend_key(table: DataFrame, keys: DataFrame, key: str = "parent_key") -> DataFrame:
    """Submission ids filled in from the backend key, which is then dropped; an unresolved key fails the job."""
    sizes = table.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    named = keys.select(key, F.col("submission_id").alias("_sid")).join(sizes, key)
    joined = attach_table(table, [key], named, ["_sid"], "_n")
    fail = F.raise_error(F.concat(F.lit("backend key without submission: "), F.col(key))).cast("string")
    found = F.when(F.col(key).isNotNull() & F.col("_sid").isNull(), fail).otherwise(F.col("_sid"))
    current = F.coalesce(F.col("submission_id").cast("string"), found) if "submission_id" in table.columns else found
    return joined.withColumn("submission_id", current).drop(key, "_sid")


def deidentify(tables: Mapping[str, DataFrame], key: str = "parent_key", drop: Sequence[str] = SENSITIVE) -> tuple[dict[str, DataFrame], DataFrame]:
    """All tables without sensitive columns and with pseudonyms, and the re-link table.

    Every table joins the re-link table, so it is written to the checkpoint folder once.
    """
    relink = cut_lineage(id_mappings(list(tables.values())))
    small = is_small(relink)
    keyed = [t for t in tables.values() if {"prolific_id", "submission_id"} <= set(t.columns)]
    out = {}
    for name, table in tables.items():
        clean = table.drop(*drop)
        if key in clean.columns:
            clean = resolve_backend_key(clean, backend_keys(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), keyed), table, key), key)
        out[name] = apply_mapping(clean, relink, small=small)
    return out, relink


def change_report(tables: Mapping[str, DataFrame], drop: Sequence[str] = SENSITIVE, prefixes: Mapping[str, str] = ID_PREFIXES) -> DataFrame:
    """What a run would change, without changing it: distinct ids per column and columns to drop per table."""
    parts = []
    for name, table in tables.items():
        ids = [c for c in prefixes if c in table.columns]
        gone = [c for c in drop if c in table.columns]
        one = table.agg(*[F.count_distinct(c).alias(c) for c in ids], *[F.count(c).alias(c) for c in gone])
        cells = F.array(
            *[F.struct(F.lit(c).alias("column_name"), F.lit("pseudonymise").alias("action"), F.col(c).alias("n")) for c in ids],
            *[F.struct(F.lit(c).alias("column_name"), F.lit("drop").alias("action"), F.col(c).alias("n")) for c in gone],
        )
        if ids or gone:
            parts.append(one.select(F.lit(name).alias("table_name"), F.explode(cells).alias("c")).select("table_name", "c.*"))
    return reduce(DataFrame.unionByName, parts)


def update_relink(prior: DataFrame, new: DataFrame) -> DataFrame:
    """Re-link table with the mappings of earlier runs kept. Store it where participants cannot be looked up."""
    return append_distinct(prior, new.select(*prior.columns))
