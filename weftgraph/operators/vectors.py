"""Vector search: exact, and over lists that partition the vectors."""

from __future__ import annotations

import json
import math
from typing import Any

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.vectors import choose_lists, choose_probes, closeness, is_missing, metric_name
from weftgraph.sources import files


def infer_dimension(*columns: tuple[DataFrame, str]) -> int:
    """The length of the first vector that isn't empty, table by table; 0 if there is none."""
    for rows, column in columns:
        found = rows.filter(~is_missing(F.col(column))).select(F.size(column)).first()
        if found:
            return int(found[0])
    return 0


def check_dimension(expected: int, given: int) -> None:
    if expected and expected != given:
        raise ValueError(f"the query has {given} dimensions, the index {expected}")


def exact_top(rows: DataFrame, query: list[float], k: int, *, vector: str = "embedding", metric: str = "cosine", tie: tuple[str, ...] = ("id",)) -> DataFrame:
    """The k nearest rows with their `score`, greater being nearer; ties by `tie`. The query is a literal: no join."""
    if k <= 0:
        return rows.withColumn("score", F.lit(0.0)).limit(0)
    given = F.array(*[F.lit(float(x)) for x in query])
    return rows.withColumn("score", closeness(F.col(vector), given, metric)).orderBy(F.desc("score"), *tie).limit(k)


class ListIndex:
    """Vectors in k-means lists, one folder each, so that a search reads only the nearest lists."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.meta: dict[str, Any] = json.loads(files.read_text(spark, f"{path}/meta.json"))

    @classmethod
    def build(cls, rows: DataFrame, path: str, *, id_col: str = "id", vector: str = "embedding", metric: str = "cosine", lists: int | None = None, recreate: bool = True, seed: int = 42) -> ListIndex:
        """Write an index of the rows that have a vector. One of another dimension at `path` is an error unless `recreate`."""
        spark, kind = rows.sparkSession, metric_name(metric)
        rows = rows.filter(~is_missing(F.col(vector))).select(F.col(id_col).cast("string").alias("id"), F.col(vector).cast("array<double>").alias("embedding"))
        dim = infer_dimension((rows, "embedding"))
        if dim <= 0:
            raise ValueError("no row has a vector")
        if not recreate and files.exists(spark, f"{path}/meta.json") and cls(spark, path).meta["dim"] != dim:
            raise ValueError("there is an index of another dimension")
        rows = rows.filter(F.size("embedding") == dim)
        if kind == "cosine":  # k-means by cosine doesn't take zero vectors; nothing is near to them either
            rows = rows.filter(F.exists("embedding", lambda x: x != 0))
        n = rows.count()
        count = choose_lists(n, lists)
        featured = rows.withColumn("features", array_to_vector("embedding"))
        if count > 1:
            fitted = KMeans(k=count, seed=seed, maxIter=10, distanceMeasure="cosine" if kind == "cosine" else "euclidean", predictionCol="list_id").fit(featured)
            listed, centres = fitted.transform(featured), [c.tolist() for c in fitted.clusterCenters()]
        else:
            listed, centres = featured.withColumn("list_id", F.lit(0)), [[0.0] * dim]
        listed.select("id", "embedding", "list_id").repartition("list_id").write.mode("overwrite").partitionBy("list_id").parquet(f"{path}/lists")
        files.write_text(spark, f"{path}/meta.json", json.dumps({"dim": dim, "metric": kind, "lists": len(centres), "probes": choose_probes(len(centres)), "n": n, "centres": centres}))
        return cls(spark, path)

    def search(self, query: list[float], k: int, probes: int | None = None) -> DataFrame:
        """(id, score) of the k nearest within the lists whose centres are nearest to the query.

        Unless told otherwise, 7 of 10 lists at least are read: vectors without clusters need that for a recall of 0.9.
        """
        check_dimension(self.meta["dim"], len(query))
        centres, q = np.array(self.meta["centres"]), np.array(query, float)
        if self.meta["metric"] == "cosine":
            near = -(centres @ q) / np.maximum(np.linalg.norm(centres, axis=1), 1e-12)
        elif self.meta["metric"] == "l2":
            near = np.linalg.norm(centres - q, axis=1)
        else:
            near = -(centres @ q)
        chosen = [int(i) for i in np.argsort(near, kind="stable")[: probes or max(self.meta["probes"], math.ceil(0.7 * len(centres)))]]
        rows = self.spark.read.parquet(f"{self.path}/lists").filter(F.col("list_id").isin(chosen))
        return exact_top(rows, query, k, metric=self.meta["metric"]).select("id", "score")


def search_or_exact(index: ListIndex | None, rows: DataFrame, query: list[float], k: int, *, vector: str = "embedding", metric: str = "cosine", fallback: bool = True) -> tuple[DataFrame, str]:
    """(id, score) by the index, or exactly where there is none, or it fails and `fallback` allows it; and which it was.

    The index is read here and now, as a lost file would else be noticed only after the way back is gone; k rows come of it.
    """
    if index is not None:
        try:
            found = index.search(query, k)
            return found.sparkSession.createDataFrame(found.collect(), found.schema), "ann"
        except (ValueError, PySparkException, Py4JJavaError):
            if not fallback:
                raise
    return exact_top(rows, query, k, vector=vector, metric=metric).select("id", "score"), "exact"
