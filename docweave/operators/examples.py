"""Stored examples of categories, and centroids kept up to date by sums that add up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators.tables import written
from docweave.sources.tables import exists


class ExampleStore:
    """Examples at ``path`` and, for each batch added, sums and counts per category and dimension.

    An update reads the keys of known examples and its own vectors only. Centroids are the
    sums of all batches over their counts, so they equal those of all examples taken together.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def add(self, examples: DataFrame) -> None:
        """Add ``examples(example_id, category, embedding)`` that their category does not hold yet; null vectors stay out.

        Of several rows with one id and category the one with the least vector counts.
        """
        fresh = examples.filter("embedding is not null").groupBy("example_id", "category").agg(F.min("embedding").alias("embedding"))
        if exists(self.spark, f"{self.path}/examples"):
            fresh = fresh.join(self.examples().select("example_id", "category"), ["example_id", "category"], "left_anti")
        fresh = written(fresh)
        sums = fresh.select("category", F.posexplode("embedding").alias("pos", "x")).groupBy("category", "pos").agg(
            F.sum(F.col("x").cast("double")).alias("total"), F.count("*").alias("n"))
        sums.write.mode("append").parquet(f"{self.path}/sums")
        fresh.write.mode("append").parquet(f"{self.path}/examples")

    def examples(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/examples")

    def centroids(self) -> DataFrame:
        """``(category, embedding, n)``: the mean vector of each category and its number of examples."""
        means = self.spark.read.parquet(f"{self.path}/sums").groupBy("category", "pos").agg(
            (F.sum("total") / F.sum("n")).alias("m"), F.sum("n").alias("n"))
        return means.groupBy("category").agg(
            F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda e: e["m"]).alias("embedding"), F.max("n").alias("n"))
