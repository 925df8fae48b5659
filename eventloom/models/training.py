"""The graph refiner on Spark: graphs as rows, batches of graphs through the network in tasks, training by sums of gradients over tasks.

A row is a graph: a sample's nodes, edges and query. Samples are bounded (max_events where they are made), and tasks take as many graphs
at a time as have about CHUNK edges. Weights go to tasks as a broadcast; their size is the model's, whatever the data's.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.lexicons import RELATIONS
from ..operators import features
from . import refiner as R

CHUNK, BLOCK, FAN = 2048, 16384, 64
WEIGHTS = "name string, shape array<int>, values array<double>"


def _numbers(n: int) -> Column:
    """Features as an array; null and NaN count as 0."""
    return F.array(*[F.nanvl(F.coalesce(f"f{k}", F.lit(0.0)), F.lit(0.0)) for k in range(n)])


def graph_rows(nodes: DataFrame, edges: DataFrame, queries: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Feature tables (features.node_features, edge_features, query_features) → a row a sample.

    (sample_id, nodes array<struct<event_id, f>>, edges array<struct<ord, source, target, f, keep, kind, strength>>, query array<double>).
    Edges that name no node of their sample are left out; samples without nodes don't exist, those without edges have an empty array,
    those without a query zeros. labels (sample_id, ord, edge_label, type_id, strength), of candidates labelled by gold edges, if given. Nulls: an
    edge without a label is not to be kept.
    """
    n = nodes.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("event_id", _numbers(R.NODE).alias("f")))).alias("nodes"))
    edges = edges.select("sample_id", "ord", "source", "target", *[f"f{k}" for k in range(R.EDGE)])
    if labels is not None:
        told = labels.select("sample_id", "ord", F.col("edge_label").cast("double").alias("keep"), F.col("type_id").cast("int").alias("kind"), F.col("strength").cast("double").alias("strength"))
        edges = edges.join(told, ["sample_id", "ord"], "left")
    else:
        edges = edges.withColumns({"keep": F.lit(0.0), "kind": F.lit(0), "strength": F.lit(0.0)})
    one = F.struct("ord", "source", "target", _numbers(R.EDGE).alias("f"), F.coalesce("keep", F.lit(0.0)).alias("keep"), F.coalesce("kind", F.lit(0)).alias("kind"), F.coalesce("strength", F.lit(0.0)).alias("strength"))
    e = edges.groupBy("sample_id").agg(F.array_sort(F.collect_list(one)).alias("edges"))
    rows = n.join(e, "sample_id", "left").join(queries.select("sample_id", _numbers(R.QUERY).alias("query")), "sample_id", "left")
    names = F.transform("nodes", lambda x: x["event_id"])
    inside = F.filter(F.coalesce("edges", F.array().cast(rows.schema["edges"].dataType)), lambda x: F.array_contains(names, x["source"]) & F.array_contains(names, x["target"]))
    return rows.select("sample_id", "nodes", inside.alias("edges"), F.coalesce("query", F.array_repeat(F.lit(0.0), R.QUERY)).alias("query"))


def _matrix(rows: list, width: int) -> np.ndarray:
    return np.array(rows, float).reshape(-1, width)


def joined(rows: pd.DataFrame) -> R.Graphs:
    """Rows of graph_rows side by side."""
    nodes, edges, node_graph, edge_graph, source, target, start = [], [], [], [], [], [], 0
    for k, (some, links) in enumerate(zip(rows["nodes"], rows["edges"], strict=True)):
        at = {x["event_id"]: start + i for i, x in enumerate(some)}
        nodes.extend(x["f"] for x in some)
        node_graph.extend([k] * len(some))
        edges.extend(links)
        edge_graph.extend([k] * len(links))
        source.extend(at[x["source"]] for x in links)
        target.extend(at[x["target"]] for x in links)
        start += len(some)
    told = {c: np.array([x[c] for x in edges], float) for c in ("keep", "kind", "strength")}
    at_edges = [np.array(x, int) for x in (source, target, edge_graph)]
    return R.Graphs(_matrix(nodes, R.NODE), np.array(node_graph, int), _matrix([x["f"] for x in edges], R.EDGE), *at_edges, _matrix(list(rows["query"]), R.QUERY), **told)


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A few graphs at a time, so that what a task holds is bounded."""
    for rows in batches:
        sizes = np.cumsum([len(e) + len(n) for e, n in zip(rows["edges"], rows["nodes"], strict=True)])
        for _, part in rows.groupby(sizes // CHUNK, sort=False):
            yield part.reset_index(drop=True)


def predictions(graphs: DataFrame, weights: dict[str, np.ndarray], steps: int = 4) -> DataFrame:
    """graph_rows → (sample_id, ord, keep_probability, relation_type, strength, event_id, frontier_score): a row an edge, and a row a node, whose edge columns are null."""
    sent = graphs.sparkSession.sparkContext.broadcast(weights)
    kind = {f.name: f.dataType.simpleString() for f in graphs.schema}
    order = graphs.schema["edges"].dataType.elementType["ord"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _chunks(batches):
            g = joined(rows)
            out = R.predict(sent.value, g, steps)
            ids = rows["sample_id"].to_numpy()
            yield pd.DataFrame({
                "sample_id": ids[g.edge_graph], "ord": [x["ord"] for links in rows["edges"] for x in links], "keep_probability": out["keep"],
                "relation_type": [RELATIONS[k] for k in out["kind"].argmax(axis=1)], "strength": out["strength"], "event_id": None, "frontier_score": None,
            })
            yield pd.DataFrame({
                "sample_id": ids[g.node_graph], "ord": pd.array([None] * len(g.nodes), "Int64"), "keep_probability": None, "relation_type": None, "strength": None,
                "event_id": [x["event_id"] for some in rows["nodes"] for x in some], "frontier_score": out["frontier"],
            })

    return graphs.mapInPandas(run, f"sample_id {kind['sample_id']}, ord {order}, keep_probability double, relation_type string, strength double, event_id string, frontier_score double")


def network_refiner(weights: dict[str, np.ndarray], events: DataFrame, query: Column, focus_count: Column, steps: int = 4):
    """A scorers.GraphRefiner: candidates (with source_kind) to each edge's probability, type and strength. events carry tokens and times."""

    def refine(candidates: DataFrame) -> DataFrame:
        graphs = graph_rows(features.node_features(events, query), features.edge_features(candidates, events), features.query_features(events, candidates, focus_count))
        return predictions(graphs, weights, steps).where("ord is not null").drop("event_id", "frontier_score")

    return refine


def frontier_scores(graphs: DataFrame, weights: dict[str, np.ndarray], steps: int = 4) -> DataFrame:
    """(sample_id, event_id, frontier_score), for graphs.rank_frontier."""
    return predictions(graphs, weights, steps).where("event_id is not null").select("sample_id", "event_id", "frontier_score")


# Weights as a table


def write_weights(spark: SparkSession, weights: dict[str, np.ndarray], path: str) -> None:
    rows = [(k, list(v.shape), v.ravel().tolist()) for k, v in sorted(weights.items())]
    spark.createDataFrame(rows, WEIGHTS).write.mode("overwrite").parquet(path)


def read_weights(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    """The table is as big as the model, and comes to the driver."""
    return {r.name: np.array(r.values).reshape(r.shape) for r in spark.read.schema(WEIGHTS).parquet(path).collect()}


# Training


@dataclass
class Settings:
    """Training. lots: parts of the samples, one update each an epoch."""

    epochs: int = 30
    lots: int = 8
    rate: float = 3e-4
    decay: float = 1e-4
    clip: float = 1.0
    seed: int = 42
    patience: int = 3
    factor: float = 0.5
    steps: int = 4


@dataclass
class State:
    """What training goes on from."""

    weights: dict[str, np.ndarray]
    first: dict[str, np.ndarray]
    second: dict[str, np.ndarray]
    updates: int = 0
    epoch: int = 0
    rate: float = 3e-4
    best: float = math.inf
    bad: int = 0
    history: list[dict] = field(default_factory=list)

    @classmethod
    def begin(cls, weights: dict[str, np.ndarray], settings: Settings) -> State:
        zeros = {k: np.zeros_like(v) for k, v in weights.items()}
        return cls(weights, zeros, dict(zeros), rate=settings.rate)


def _vector(by_name: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([by_name[k].ravel() for k in sorted(by_name)])


def _by_name(vector: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    ends = np.cumsum([like[k].size for k in sorted(like)])
    return {k: part.reshape(like[k].shape) for k, part in zip(sorted(like), np.split(vector, ends[:-1]), strict=True)}


def update(state: State, gradient: dict[str, np.ndarray], settings: Settings) -> None:
    """One AdamW step, after the gradient's length was cut to clip."""
    length = math.sqrt(sum(float((g * g).sum()) for g in gradient.values()))
    cut = min(1.0, settings.clip / (length + 1e-6)) if settings.clip > 0 else 1.0
    state.updates += 1
    even = [1.0 - b**state.updates for b in (0.9, 0.999)]
    for k, g in gradient.items():
        g = g * cut
        state.first[k] = 0.9 * state.first[k] + 0.1 * g
        state.second[k] = 0.999 * state.second[k] + 0.001 * g * g
        step = state.first[k] / even[0] / (np.sqrt(state.second[k] / even[1]) + 1e-8)
        state.weights[k] = state.weights[k] * (1.0 - state.rate * settings.decay) - state.rate * step


def plateau(state: State, value: float, settings: Settings) -> bool:
    """Cuts the rate after too many epochs that were not better by a ten-thousandth; whether this one was."""
    better = value < state.best * (1.0 - 1e-4)
    state.best, state.bad = (value, 0) if better else (state.best, state.bad + 1)
    if state.bad > settings.patience:
        state.rate, state.bad = state.rate * settings.factor, 0
    return better


def tree_sum(rows: DataFrame, fan: int = FAN) -> DataFrame:
    """(task, block, values binary) of doubles, summed by block in two levels: groups of fan tasks, then the groups, both in order."""

    def added(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("task")
        whole = np.zeros(len(part["values"].iloc[0]) // 8)
        for values in part["values"]:
            whole += np.frombuffer(values)
        return pd.DataFrame({"task": part["up"].iloc[:1], "block": part["block"].iloc[:1], "values": [whole.tobytes()]})

    for up in (F.floor(F.col("task") / fan).cast("int"), F.lit(0)):
        rows = rows.withColumn("up", up).groupBy("block", "up").applyInPandas(added, "task int, block int, values binary")
    return rows


def _summed(graphs: DataFrame, weights: dict[str, np.ndarray], steps: int, objective: R.Objective, gradients: bool) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(means over the graphs of the losses, mean gradient), from one job."""
    spark = graphs.sparkSession
    sent, size = spark.sparkContext.broadcast(weights), len(R.PARTS) + 1 + (sum(w.size for w in weights.values()) if gradients else 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole, some = np.zeros(size), False
        for rows in _chunks(batches):
            parts, got = R.losses(sent.value, joined(rows), steps, objective, gradients)
            whole[: len(parts) + 1] += [*parts, len(rows)]
            if gradients:
                whole[len(parts) + 1 :] += _vector(got)
            some = True
        if some:
            cuts = range(0, size, BLOCK)
            yield pd.DataFrame({"task": np.int32(TaskContext.get().partitionId()), "block": np.arange(len(cuts), dtype=np.int32), "values": [whole[i : i + BLOCK].tobytes() for i in cuts]})

    try:
        blocks = tree_sum(graphs.mapInPandas(run, "task int, block int, values binary")).orderBy("block").collect()  # as long as the model
    finally:
        sent.unpersist()
    if not blocks:
        return np.full(len(R.PARTS), np.nan), {}
    whole = np.concatenate([np.frombuffer(b["values"]) for b in blocks])
    n, rest = whole[len(R.PARTS)], whole[len(R.PARTS) + 1 :]
    return whole[: len(R.PARTS)] / n, _by_name(rest / n, weights) if gradients else {}


def objective_of(labels: DataFrame, most: float = 12.0, most_kind: float = 4.0, **more) -> R.Objective:
    """Weights of kept edges and of types by how seldom they are among labels (edge_label, type_id)."""
    counted = {r.type_id: (r.n, r.kept) for r in labels.groupBy("type_id").agg(F.count("*").alias("n"), F.count_if(F.col("edge_label") > 0.5).alias("kept")).collect()}  # a row a type
    total, kept = (sum(x[k] for x in counted.values()) for k in (0, 1))
    positive = min(max((total - kept) / kept, 1.0), most) if kept and total > kept else 1.0
    kinds = [counted.get(k, (0, 0))[1] for k in range(R.RELATIONS)]
    seen = [n for n in kinds if n]
    weights = tuple(max(1.0 / most_kind, min(math.sqrt(sum(seen) / len(seen) / n), most_kind)) if n else 0.0 for n in kinds) if len(seen) > 1 else None
    return R.Objective(positive=positive, kinds=weights, **more)


def _saved(spark: SparkSession, state: State, folder: str) -> None:
    rows = [(f"{part}/{k}", list(v.shape), v.ravel().tolist()) for part in ("weights", "first", "second") for k, v in sorted(getattr(state, part).items())]
    told = {k: v for k, v in asdict(state).items() if k not in ("weights", "first", "second")}
    rows.append((json.dumps(told), [0], []))
    spark.createDataFrame(rows, WEIGHTS).write.mode("overwrite").parquet(f"{folder}/epoch-{state.epoch:05d}")


def _latest(spark: SparkSession, folder: str) -> State | None:
    """The state of the last epoch that was written whole."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/epoch-*/_SUCCESS")
    done = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where) or []
    if not len(done):
        return None
    last = max(f.getPath().getParent().toString() for f in done)
    parts: dict[str, dict] = {"weights": {}, "first": {}, "second": {}}
    told: dict = {}
    for r in spark.read.schema(WEIGHTS).parquet(last).collect():  # three times the model
        if r.name.startswith("{"):
            told = json.loads(r.name)
        else:
            part, _, name = r.name.partition("/")
            parts[part][name] = np.array(r["values"]).reshape(r["shape"])
    return State(**parts, **told)


def train(graphs: DataFrame, weights: dict[str, np.ndarray], folder: str, settings: Settings | None = None, objective: R.Objective | None = None, validation: DataFrame | None = None) -> State:
    """Labelled graph_rows → weights. Each epoch goes through the lots in an order drawn for it, and updates the weights by each lot's mean gradient.

    Samples are written once under folder, by lot, so that an update reads its lot's files alone. Each epoch ends with a checkpoint in
    folder; training that is begun again there goes on behind the last whole one, with the same result. Graphs without an edge are left out.
    The rate is cut by the validation's loss, or else by the training's. Without any graph the weights stay.
    """
    spark, settings, objective = graphs.sparkSession, settings or Settings(), objective or R.Objective()
    state, lots = _latest(spark, folder), f"{folder}/graphs"
    if state is None:
        state = State.begin(dict(weights), settings)
        lot = F.pmod(F.xxhash64(F.lit(settings.seed), F.col("sample_id")), F.lit(settings.lots)).cast("int")
        rows = graphs.where(F.size("edges") > 0).withColumn("lot", lot)
        # a lot may be larger than a task's share: its samples are spread, and come in order whatever the input's partitions
        rows.write.mode("overwrite").partitionBy("lot").parquet(lots)
    schema = StructType([*graphs.schema.fields, StructField("lot", IntegerType())])
    table = spark.read.schema(schema).parquet(lots)
    held = validation.where(F.size("edges") > 0) if validation is not None else None
    while state.epoch < settings.epochs:
        seen = []
        for lot in np.random.default_rng([settings.seed, state.epoch]).permutation(settings.lots).tolist():
            parts, gradient = _summed(table.where(F.col("lot") == lot).drop("lot"), state.weights, settings.steps, objective, True)
            if gradient:
                update(state, gradient, settings)
                seen.append(parts)
        record = {"epoch": state.epoch + 1, "rate": state.rate} | dict(zip(R.PARTS, np.mean(seen, axis=0).tolist() if seen else [0.0] * len(R.PARTS), strict=True))
        if held is not None:
            parts, _ = _summed(held, state.weights, settings.steps, objective, False)
            record |= {f"val_{p}": float(x) for p, x in zip(R.PARTS, parts, strict=True) if not math.isnan(x)}
        record["best"] = plateau(state, record.get("val_loss", record["loss"]), settings)
        state.history.append(record)
        state.epoch += 1
        _saved(spark, state, folder)
    return state
