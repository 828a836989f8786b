"""Stored trigram index of texts: a question reads the posting lists of its own rarest grams.

Two tables. ``texts`` has every distinct text of the indexed columns once, with its
grams. ``postings`` has a row (shelf, gram, text, size) for each gram of each text, kept
by ``shelf``, a hash of the gram, and sorted by gram, so that a list of grams is pushed
into the scan as folders and row groups.

Texts alike by at least ``threshold`` (shared over all grams) share at least that part
of the question's grams. So one of its first ``size - least shared + 1`` grams is among
theirs, whatever the order; the order is by how many texts have a gram, rarest first.
What a question finds under those grams is cut by size and verified on the whole gram
sets. A gram that a third of all texts have is read only by questions that have no
rarer ones to go by.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopspark.functions.text import ALIKE, similarity, trigrams

SHELVES = 64


def shelf_of(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(SHELVES)).cast("int")


@dataclass(frozen=True)
class NameIndex:
    spark: SparkSession
    path: str

    def texts(self) -> DataFrame:
        """text_id, field, text, rows, grams."""
        schema = "text_id bigint, field string, text string, rows bigint, grams array<string>"
        return self.spark.read.schema(schema).parquet(f"{self.path}/texts")

    def postings(self) -> DataFrame:
        return self.spark.read.schema("gram string, text_id bigint, size int, shelf int").parquet(f"{self.path}/postings")

    def frequencies(self) -> DataFrame:
        """gram, texts: in how many texts a gram stands."""
        return self.spark.read.schema("gram string, texts bigint").parquet(f"{self.path}/frequencies")


def build_name_index(table: DataFrame, path: str, columns: Sequence[str] = ("name", "brand", "category")) -> NameIndex:
    """Index the distinct texts of some columns; null texts and those without letters or digits have no grams."""
    spark = table.sparkSession
    fields = [table.select(F.lit(c).alias("field"), F.col(c).cast("string").alias("text")) for c in columns]
    counted = reduce(DataFrame.unionByName, fields).where("text is not null").groupBy("field", "text").agg(F.count("*").alias("rows"))
    numbered = counted.select(F.xxhash64("field", "text").alias("text_id"), "field", "text", "rows", trigrams(F.col("text")).alias("grams"))
    numbered.write.parquet(f"{path}/texts")
    index = NameIndex(spark, path)
    spelled = index.texts().select(F.explode("grams").alias("gram"), "text_id", F.size("grams").alias("size"))
    shelved = spelled.withColumn("shelf", shelf_of(F.col("gram"))).hint("rebalance", F.col("shelf"))
    shelved.sortWithinPartitions("shelf", "gram").write.partitionBy("shelf").parquet(f"{path}/postings")
    index.postings().groupBy("gram").agg(F.count("*").alias("texts")).sort("gram").write.parquet(f"{path}/frequencies")
    return index


def _needed(size: Column, threshold: float) -> Column:
    """Grams that texts alike to one of ``size`` grams have in common with it at least."""
    return F.greatest(F.ceil(size * threshold - 1e-9), F.lit(1)).cast("int")


def asked_grams(index: NameIndex, questions: DataFrame, threshold: float) -> DataFrame:
    """(question, gram, asked, wanted): the rarest grams of each question that no text alike can lack all of."""
    known = questions.where(F.col("question").isNotNull()).distinct().withColumn("wanted", trigrams(F.col("question")))
    spelled = known.select("question", "wanted", F.explode("wanted").alias("gram"))
    rare = spelled.join(index.frequencies(), "gram", "left").groupBy("question", "wanted").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "gram"))).alias("ordered")
    )
    size = F.size("wanted")
    first = F.slice("ordered", 1, size - _needed(size, threshold) + 1)
    return rare.select("question", "wanted", F.explode(first).alias("one")).select("question", "wanted", F.col("one.gram").alias("gram"))


def alike_texts(index: NameIndex, questions: DataFrame, threshold: float = ALIKE) -> DataFrame:
    """(question, field, text, rows, score) of all indexed texts alike to each of many questions (column ``question``)."""
    return _verified(index, asked_grams(index, questions, threshold).withColumn("shelf", shelf_of(F.col("gram"))), index.postings(), threshold)


def alike_to(index: NameIndex, question: str, threshold: float = ALIKE) -> DataFrame:
    """As ``alike_texts`` for one question; its grams (as many as the question has) are pushed into the scan."""
    one = index.spark.createDataFrame([(question,)], "question string")
    asked = asked_grams(index, one, threshold).withColumn("shelf", shelf_of(F.col("gram")))
    own = asked.select("gram", "shelf").collect()
    here = F.col("gram").isin([r.gram for r in own]) & F.col("shelf").isin([r.shelf for r in own])
    return _verified(index, asked, index.postings().where(here), threshold)


def _verified(index: NameIndex, asked: DataFrame, postings: DataFrame, threshold: float) -> DataFrame:
    size = F.size("wanted")
    near = (F.col("size") >= size * threshold - 1e-9) & (F.col("size") * threshold - 1e-9 <= size)
    met = asked.join(postings, ["shelf", "gram"]).where(near).select("question", "wanted", "text_id").distinct()
    scored = met.join(index.texts(), "text_id").withColumn("score", similarity(F.col("grams"), F.col("wanted")))
    return scored.where(F.col("score") >= threshold).select("question", "field", "text", "rows", "score")
