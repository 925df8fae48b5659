"""Text files by line number, archives, and writers of the engine's results."""

from __future__ import annotations

import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of the lines that are not blank; line counts all lines of a file from 1, whatever splits it is read in.

    What a split has before it is known from a count of each split's lines: a row a split.
    """
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    rows = spark.read.text(path).select(*where, F.monotonically_increasing_id().alias("id"), "value")
    splits = rows.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("id").alias("first")).collect()
    before: dict[str, int] = {}
    offsets = []
    for r in sorted(splits, key=lambda r: (r.file, r.start)):
        offsets.append((r.file, r.start, before.get(r.file, 0) - r.first + 1))
        before[r.file] = before.get(r.file, 0) + r.n
    told = spark.createDataFrame(offsets, "file string, start long, shift long")
    out = rows.join(told, ["file", "start"]).withColumn("line", F.col("id") + F.col("shift"))
    return out.where(F.trim("value") != "").select("file", "line", "value")


def unpack(archive: str, member: str, landing: str) -> str:
    """Extract one member of a zip archive to the landing folder, which executors must share; the path. KeyError where there is no such member."""
    target = Path(landing) / member
    if not target.exists():
        with zipfile.ZipFile(archive) as z:
            z.extract(member, landing)
    return str(target)


def resolve(path: str, root: str) -> str:
    """An absolute path, or one with a scheme, as it is; any other under root."""
    return path if Path(path).is_absolute() or "://" in path else f"{root.rstrip('/')}/{path}"


def duration(seconds: float) -> str:
    """12s, 3m05s, 1h02m."""
    if seconds < 60:
        return f"{seconds:.0f}s"
    minutes, rest = divmod(int(seconds), 60)
    return f"{minutes}m{rest:02d}s" if minutes < 60 else f"{minutes // 60}h{minutes % 60:02d}m"


# Sinks


def graph_json(samples: DataFrame, documents: DataFrame, events: DataFrame, edges: DataFrame) -> DataFrame:
    """(sample_id, json): a graph a sample, in the form that corpora.coarse_graphs reads.

    samples (sample_id, query_id, text, cutoff_time, focus_entities), documents, events and edges by sample_id and ord.
    """

    def nested(rows: DataFrame, fields: dict[str, str], name: str) -> DataFrame:
        have = [F.col(c).alias(k) for k, c in fields.items() if c in rows.columns]
        one = F.struct("ord", F.struct(*have).alias("x"))
        return rows.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(one), lambda a, b: (a["ord"] - b["ord"]).cast("int")), lambda r: r["x"]).alias(name))

    same = {c: c for c in ("document_id", "title", "text", "publish_time", "source", "metadata")}
    event = {c: c for c in ("event_id", "text", "normalized_text", "document_id", "sentence_index", "participants", "node_type", "confidence", "evidence", "metadata")}
    edge = {"edge_id": "edge_id", "source_event_id": "source", "target_event_id": "target", "relation_type": "relation_type", "score": "score", "feature_scores": "feature_scores", "metadata": "metadata"}
    out = samples.select("sample_id", F.struct(*[c for c in ("query_id", "text", "cutoff_time", "focus_entities") if c in samples.columns]).alias("query"))
    for rows, fields, name in ((documents, same, "documents"), (events, event, "events"), (edges, edge, "edges")):
        out = out.join(nested(rows, fields, name), "sample_id", "left")
    parts = [F.coalesce(c, F.array().cast(out.schema[c].dataType)).alias(c) for c in ("documents", "events", "edges")]
    return out.select("sample_id", F.to_json(F.struct("query", *parts)).alias("json"))


def write_lines(rows: DataFrame, path: str, column: str | None = None) -> None:
    """JSON lines: a column of JSON texts as it is, or whole rows. Files of the folder are written by the tasks."""
    lines = rows.select(F.col(column).alias("value")) if column else rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
    lines.write.mode("overwrite").text(path)


def write_training_pairs(pairs: DataFrame, path: str) -> None:
    """Prompts and targets of a pair classifier, as JSON lines."""
    write_lines(pairs.select("sample_id", "prompt", "target"), path)


def append_log(rows: DataFrame, path: str) -> None:
    """Predictions or trajectory steps, added to a Parquet log."""
    rows.write.mode("append").parquet(path)
