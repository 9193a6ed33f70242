"""What is done with tables of identifiers: leakage, grouping, splits, look-ups, errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def leaked(test: DataFrame, train: DataFrame, key: str = "graph_id") -> DataFrame:
    """Test rows whose id occurs in train."""
    return test.join(train.select(key).distinct(), key, "left_semi")


def novel(test: DataFrame, train: DataFrame, key: str = "graph_id") -> DataFrame:
    """Test rows whose id does not occur in train."""
    return test.join(train.select(key).distinct(), key, "left_anti")


def leakage_counts(test: DataFrame, train: DataFrame, key: str = "graph_id") -> DataFrame:
    """One row (n_test, n_leaked, n_novel)."""
    marked = test.join(train.select(key).distinct().withColumn("__seen", F.lit(1)), key, "left")
    return marked.agg(F.count("*").alias("n_test"), F.count("__seen").alias("n_leaked"), (F.count("*") - F.count("__seen")).alias("n_novel"))


def members(ids: DataFrame, key: str = "graph_id", least: int = 1) -> DataFrame:
    """(key, n, first, members) of groups with at least `least` rows; members as sorted text."""
    rows = ids.groupBy(key).agg(F.count("*").alias("n"), F.min("structure_id").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list("structure_id")), lambda s: s.cast("string")), ",").alias("members"))
    return rows.where(F.col("n") >= least)


def with_first(ids: DataFrame, order: str = "structure_id", key: str = "graph_id") -> DataFrame:
    """Each row with the first row's order value in its group (`first`), and whether it is that row."""
    first = F.min(order).over(Window.partitionBy(key))
    return ids.withColumn("first", first).withColumn("is_first", F.col("first") == F.col(order))


def hash_split(rows: DataFrame, key: Column, parts: int) -> DataFrame:
    """Rows with `part`, equal for equal keys: no id on both sides. The hash is the first 28 bits of md5, so other engines can repeat it."""
    return rows.withColumn("part", F.pmod(F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 7), 16, 10).cast("long"), F.lit(parts)).cast("int"))


def random_split(rows: DataFrame, share: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """A seeded random split."""
    a, b = rows.randomSplit([share, 1 - share], seed)
    return a, b


def mean_absolute_error(rows: DataFrame, actual: str, predicted: str, *by: str) -> DataFrame:
    """(by..., n, mae)."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.abs(F.col(actual) - F.col(predicted))).alias("mae"))


def tagged(parts: dict[str, DataFrame], column: str = "kind") -> DataFrame:
    """All parts under one another, with the name of each."""
    out = None
    for name, df in parts.items():
        own = df.withColumn(column, F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


def histogram(site_ids: DataFrame, value: str = "site_id") -> DataFrame:
    """(structure_id, value, n): how often each environment occurs in a structure."""
    return site_ids.groupBy("structure_id", value).agg(F.count("*").alias("n"))


def look_up(queries: DataFrame, store: DataFrame, key: str = "graph_id") -> DataFrame:
    """Store rows for each queried id; the planner broadcasts a side only if its size is known to be small."""
    return queries.select(key).distinct().join(store, key)


def composition(sites: DataFrame) -> DataFrame:
    """(structure_id, species, share): the composition vector."""
    n = F.count("*").over(Window.partitionBy("structure_id", "species"))
    of = F.count("*").over(Window.partitionBy("structure_id"))
    return sites.select("structure_id", "species", (n / of).alias("share")).distinct()


def imputed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls become the column's mean."""
    means = rows.agg(*[F.avg(c).alias(c) for c in columns]).first()
    return rows.fillna({c: means[c] for c in columns if means[c] is not None})


def forest(train: DataFrame, test: DataFrame, features: list[str], label: str, trees: int = 150, seed: int = 1) -> DataFrame:
    """test with `prediction` of a random forest fitted on train; null features are imputed by the mean of train."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    filled = [f"__{c}" for c in features]
    steps = [Imputer(inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="__x"), RandomForestRegressor(featuresCol="__x", labelCol=label, numTrees=trees, seed=seed)]
    return Pipeline(stages=steps).fit(train).transform(test).drop("__x", *filled)
