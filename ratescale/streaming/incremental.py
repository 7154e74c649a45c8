"""Scoring of phrase files as they arrive: the batch job's resume rule, driven by a file stream.

Each micro-batch scores only pairs the result table lacks, so a batch that is run again adds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ratescale.operators import scoring
from ratescale.operators.joins import ITEM, pending, replicate_terms
from ratescale.operators.clean import valid_attribute
from pyspark.sql import functions as F

RESULT = "attribute string, person_term string, predicted_rating double, generation string, error string, batch long"


def phrase_stream(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def score_new_pairs(phrases: DataFrame, scorer: scoring.Scorer | Column, results: str, checkpoint: str) -> StreamingQuery:
    """Score the distinct pairs of every arriving file once; results are appended to a parquet table."""
    spark = phrases.sparkSession

    def batch(rows: DataFrame, number: int) -> None:
        finished = spark.read.schema(RESULT).parquet(results)
        # the same batch run again replaces nothing: its pairs are finished already
        pairs = replicate_terms(rows.filter(valid_attribute(F.col("attribute"))).select("attribute").distinct())
        todo = pending(pairs, finished, scoring.finished_pairs(finished))
        scored = scoring.score_column(todo, scorer) if isinstance(scorer, Column) else scoring.score_batches(todo, scorer)
        scored.select(*ITEM, "predicted_rating", "generation", "error", F.lit(number).cast("long").alias("batch")).write.mode("append").parquet(results)

    spark.createDataFrame([], RESULT).write.mode("append").parquet(results)
    return phrases.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
