"""Random splits that come out the same in every run and on every cluster: rows are ranked by a seeded digest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Archives of the split by source (fixed values).
TRAIN_VOLUMES = ("trolldoms", "svea_hovratt", "bergskollegium_rel", "poliskammare")
TEST_VOLUMES = ("jonkopings_radhusratts", "gota_hovratt", "bergskollegium_adv", "frihetstidens", "krigshovrattens")


def draw(key: str, seed: int) -> Column:
    """The digest that rows are ranked by."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))


def _ranked(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """rank (from 1) of each row by digest and _total, over all rows: counts by the digest's first three digits give each slice's offset, so no task ranks all."""
    drawn = rows.withColumn("_draw", draw(key, seed)).withColumn("_slice", F.substring("_draw", 1, 3))
    counts = drawn.groupBy("_slice").agg(F.count("*").alias("_n"))
    # At most 4,096 rows.
    before = counts.select("_slice", (F.sum("_n").over(Window.orderBy("_slice")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    local = F.row_number().over(Window.partitionBy("_slice").orderBy("_draw", key))
    return drawn.withColumn("_local", local).join(F.broadcast(before), "_slice").withColumn("rank", F.col("_before") + F.col("_local")).drop("_draw", "_slice", "_local", "_before")


def mixed(pages: DataFrame, key: str, seed: int = 42, test: float = 0.1, val: float = 0.1) -> DataFrame:
    """split of every page: the first ceil(test n) by rank are test, the next ceil(val rest) val, the others train."""
    ranked = _ranked(pages, key, seed)
    cut = F.ceil(F.col("_total") * F.lit(test))
    split = F.when(F.col("rank") <= cut, "test").when(F.col("rank") <= cut + F.ceil((F.col("_total") - cut) * F.lit(val)), "val").otherwise("train")
    return ranked.withColumn("split", split).drop("rank", "_total")


def by_source(pages: DataFrame, key: str, source: str, train_sources: tuple[str, ...] = TRAIN_VOLUMES, test_sources: tuple[str, ...] = TEST_VOLUMES, seed: int = 42, val: float = 0.07) -> DataFrame:
    """Test sources whole in test; of the train sources ceil(val n) pages in val; pages of other sources are left out."""
    test = pages.where(F.col(source).isin(*test_sources)).withColumn("split", F.lit("test"))
    rest = pages.where(F.col(source).isin(*train_sources))
    ranked = _ranked(rest, key, seed)
    return ranked.withColumn("split", F.when(F.col("rank") <= F.ceil(F.col("_total") * F.lit(val)), "val").otherwise("train")).drop("rank", "_total").unionByName(test)


def by_counts(rows: DataFrame, key: str, train: float = 0.7, val: float = 0.15, test: float = 0.15, seed: int = 42) -> DataFrame:
    """floor(train n) in train, floor(val n) in val, and the larger of the rest and floor(test n) in test."""
    ranked = _ranked(rows, key, seed)
    a = F.floor(F.col("_total") * F.lit(train))
    b = a + F.floor(F.col("_total") * F.lit(val))
    last = b + F.greatest(F.col("_total") - b, F.floor(F.col("_total") * F.lit(test)))
    split = F.when(F.col("rank") <= a, "train").when(F.col("rank") <= b, "val").when(F.col("rank") <= last, "test")
    return ranked.withColumn("split", split).where("split is not null").drop("rank", "_total")


def attach(samples: DataFrame, manifest: DataFrame, name: str) -> DataFrame:
    """samples with the split that lists their name; of several, train before val before test; unlisted samples are dropped."""
    order = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)
    one = manifest.groupBy(name).agg(F.min_by("split", order).alias("split"))
    return samples.join(one, name)


def common_names(manifest: DataFrame, name: str) -> DataFrame:
    """Pairs of splits with the number of names in both; a good split has none."""
    pairs = [("train", "val"), ("train", "test"), ("val", "test")]
    of = lambda s: manifest.where(F.col("split") == s).select(name)
    counts = [of(a).intersect(of(b)).agg(F.count("*").alias("n_common")).select(F.lit(a).alias("left"), F.lit(b).alias("right"), "n_common") for a, b in pairs]
    return reduce(DataFrame.union, counts)
