"""Reading and writing graphs, weights and results; adapters from event and embedding tables to graphs."""

from __future__ import annotations

import json
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geosieve.graph import Graph
from geosieve.operators.plane import neighbours

WEIGHTS_SCHEMA = "feature_names array<string>, weights array<double>, transforms struct<log_degree: boolean, cap_percentile: double, zscore: boolean, dropped_freqs: array<string>, include_maxspeed: boolean>, tuning_info struct<best_objective: double, best_details: map<string, double>, q: double, sample_n: bigint, seed: bigint>, notes struct<score_definition: string, urban_high_score: boolean, recommended_split: string>"


def read_graph(spark: SparkSession, path: str) -> Graph:
    return Graph(spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges")).validate()


def write_graph(graph: Graph, path: str) -> None:
    graph.vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    graph.edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WEIGHTS_SCHEMA).option("multiLine", True).json(path)


def write_weights(weights: DataFrame, path: str) -> None:
    weights.coalesce(1).write.mode("overwrite").json(path)


def write_results(rows: DataFrame, path: str, kind: str = "csv", meta: dict | None = None) -> None:
    """Experiment rows as one CSV file with header, or as one JSON document {"meta", "rows"}."""
    if kind == "csv":
        rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
        return
    # Rows of an experiment: one for each algorithm, size and repeat.
    whole = rows.agg(F.to_json(F.collect_list(F.struct(*rows.columns)), {"ignoreNullFields": "false"}).alias("rows"))
    whole.select(F.concat(F.lit(f'{{"meta": {json.dumps(meta or {})}, "rows": '), "rows", F.lit("}")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def seeds_folder(seeds: list[int]) -> str:
    """seed_<a_b_...>; where the joined name is over 50 characters, seeds_<first>_to_<last>."""
    name = "seed_" + "_".join(map(str, seeds))
    return name if len(name) <= 50 else f"seeds_{seeds[0]}_to_{seeds[-1]}"


class EmbeddingGraph(Graph):
    """Vertices with places; directed edges to the k nearest, ties by id, made and stored when they are first asked for."""

    def __init__(self, vertices: DataFrame, k: int):
        object.__setattr__(self, "vertices", vertices)
        object.__setattr__(self, "k", k)

    @cached_property
    def edges(self) -> DataFrame:
        near = neighbours(self.vertices, self.k)
        return near.select((F.col("a") * self.k + F.col("r") - 1).alias("eid"), F.col("a").alias("src"), F.col("b").alias("dst"), F.col("d").alias("length"))


def embedding_graph(spark: SparkSession, sf_dir: str, k: int = 3) -> Graph:
    """Vertices at the first two numbers of each embedding; directed edges to the k nearest, ties by id."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    v = e.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("osmid"), F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"), F.col("label").alias("community"))
    return EmbeddingGraph(v, k)


#: Event types and the road classes they stand for (fixed values).
CLASSES = {"click": "residential", "view": "service", "purchase": "primary", "signup": "motorway"}


def event_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Users as vertices; an edge from each event's user to that of the next event by (ts, event_id).

    The one window over all rows stands for reading a road table; it isn't an operator.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k")
    speed = F.when(F.col("event_type") == "signup", "signals").when(F.col("event_type") == "view", F.concat(k, F.lit(" mph"))).otherwise(k)
    road = F.lit(None).cast("string")
    for kind, name in CLASSES.items():
        road = F.when(F.col("event_type") == kind, name).otherwise(road)
    rows = e.select(F.col("event_id").alias("eid"), F.lag("user_id").over(Window.orderBy("ts", "event_id")).alias("src"), F.col("user_id").alias("dst"), F.col("value").alias("length"), road.alias("highway"), speed.alias("maxspeed"))
    return Graph(e.select(F.col("user_id").alias("id"), F.col("user_id").alias("osmid")).distinct(), rows.where("src IS NOT NULL"))


def plot_series(aggregated: DataFrame, metrics: list[str]) -> DataFrame:
    """A row for each algorithm, k and metric, ready to draw."""
    cols = ", ".join(f"'{m}', {m}_mean, {m}_std" for m in metrics)
    return aggregated.selectExpr("algo", "k", f"stack({len(metrics)}, {cols}) AS (metric, mean, std)").orderBy("algo", "metric", "k")


def weights_document(names: list[str], weights: list[float], **rest) -> str:
    return json.dumps({"feature_names": names, "weights": weights, **rest})
