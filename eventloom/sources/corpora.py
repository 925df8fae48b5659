"""Corpora: news and query tables (tab-separated), gold graphs and graph files (JSON). Archives are unpacked once to a landing folder."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.values import literal_list, literal_map
from ..operators import steps
from ..operators.graph import dedupe_edges, truncate_graph
from .files import numbered_lines

#: names that the validation split goes by, in the order in which they are looked for
SPLITS = dict.fromkeys(("validation", "valid", "val", "dev"), ["validation", "valid", "val", "dev"])
MENTION = "struct<id:string,trigger_word:string,sent_id:int,offset:array<int>>"
GOLD = f"id string, title string, sentences array<string>, tokens array<array<string>>, events array<struct<id:string,type:string,type_id:int,mention:array<{MENTION}>>>, causal_relations map<string,array<array<string>>>, temporal_relations map<string,array<array<string>>>"
SPAN = "struct<document_id:string,sentence_index:int,text:string>"
GRAPH = (
    "query struct<query_id:string,text:string,cutoff_time:string,focus_entities:array<string>>, "
    "documents array<struct<document_id:string,title:string,text:string,publish_time:string,source:string,metadata:map<string,string>>>, "
    f"events array<struct<event_id:string,text:string,normalized_text:string,document_id:string,sentence_index:int,participants:array<string>,node_type:string,confidence:double,evidence:array<{SPAN}>,metadata:map<string,string>>>, "
    f"edges array<struct<edge_id:string,source_event_id:string,target_event_id:string,relation_type:string,score:double,evidence:array<{SPAN}>,feature_scores:map<string,double>,metadata:map<string,string>>>"
)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a tab-separated file with a header, and ord, their order in it; bytes that are no UTF-8 are replaced.

    Quoted fields may hold line breaks, so one task reads a file: give a corpus that is large as several files.
    """
    rows = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', multiLine=True, encoding="UTF-8", nullValue="\x00", emptyValue="")
    return rows.withColumn("ord", F.monotonically_increasing_id())


def _column(rows: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) if name in rows.columns else F.lit("")


def query_text(date: Column, first: Column, second: Column) -> Column:
    """The question of a row of the query table."""
    return F.concat(F.lit("As of "), date, F.lit(", what important event may happen next between "), first, F.lit(" and "), second, F.lit("?"))


def queries(spark: SparkSession, path: str, limit: int | None = 0) -> DataFrame:
    """Query rows with lists and maps read from their written form; limit counts rows in file order, 0 or None for all. metadata and raw are maps."""
    rows = read_tsv(spark, path)
    names = [c for c in rows.columns if c != "ord"]
    rows = rows.orderBy("ord").limit(limit) if limit else rows
    c = {n: _column(rows, n) for n in ("QueryId", "DateStr", "RelName", "EventBaseCode", "Actor1CountryCode", "Actor2CountryCode", "Actor1CountryName", "Actor2CountryName")}
    out = rows.select(
        "ord", c["QueryId"].alias("query_id"), c["DateStr"].alias("cutoff_time"), c["RelName"].alias("relation_name"), c["EventBaseCode"].alias("event_code"),
        F.array(c["Actor1CountryName"], c["Actor2CountryName"]).alias("focus_entities"), F.array(c["Actor1CountryCode"], c["Actor2CountryCode"]).alias("country_codes"),
        literal_list(_column(rows, "Docids")).alias("docids"), literal_list(_column(rows, "AnswerList")).alias("answers"), literal_map(_column(rows, "AnswerDict")).alias("answer_map"),
        query_text(c["DateStr"], c["Actor1CountryName"], c["Actor2CountryName"]).alias("text"), F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))]).alias("raw"),
    )
    return out


def query_by_id(queries: DataFrame, query_id: str) -> DataFrame:
    """The row of a query, the first in file order; KeyError without one."""
    one = queries.where(F.col("query_id") == str(query_id)).orderBy("ord").limit(1)
    if one.isEmpty():
        raise KeyError(f"no query {query_id}")
    return one


def news_rows(rows: DataFrame) -> DataFrame:
    """Rows of the news table → (document_id, ord, title, text, publish_time, source, metadata): abstract and text in one, cleaned."""
    title = X.strip(_column(rows, "Title"))
    body = F.concat_ws("\n", *[F.nullif(X.strip(_column(rows, c)), F.lit("")) for c in ("Abstract", "Text")])
    metadata = F.create_map(F.lit("url"), _column(rows, "URL"), F.lit("md5"), _column(rows, "MD5"))
    return rows.select(_column(rows, "Docid").alias("document_id"), "ord", title.alias("title"), X.clean_document(title, body).alias("text"), F.col("Date").alias("publish_time"), F.lit("MIRAI").alias("source"), metadata.alias("metadata"))


def news_table(spark: SparkSession, path: str) -> DataFrame:
    return news_rows(read_tsv(spark, path))


def event_code_rows(spark: SparkSession, path: str) -> DataFrame:
    """(event_code, name, ord) for retrieval.choice_vocabulary."""
    return read_tsv(spark, path).select(F.trim("EventBaseCode").alias("event_code"), F.trim("RelName").alias("name"), "ord").where("event_code <> ''")


def news_lines(spark: SparkSession, path: str) -> DataFrame:
    """News in JSON lines; keys without a column of their own stay in metadata. ord is the line."""
    known = ["document_id", "title", "text", "publish_time", "source"]
    lines = numbered_lines(spark, path).select(F.col("line").alias("ord"), F.from_json("value", "map<string,string>").alias("m"))
    rest = F.map_filter("m", lambda k, v: ~k.isin(known))
    cols = [F.element_at("m", F.lit(k)).alias(k) for k in known[:-1]]
    return lines.select("ord", *cols, F.coalesce(F.element_at("m", F.lit("source")), F.lit("unknown")).alias("source"), F.to_json(rest).alias("metadata"))


def ad_hoc_query(spark: SparkSession, text: str, cutoff_time: str | None = None, query_id: str = "query_001") -> DataFrame:
    """(query_id, text, cutoff_time, focus_entities) of a question asked by hand: its title-case names are its focus."""
    row = spark.createDataFrame([(query_id, text, cutoff_time)], "query_id string, text string, cutoff_time string")
    return row.withColumn("focus_entities", X.titlecase_entities(F.col("text")))


def gold_rows(spark: SparkSession, folder: str, split: str = "train") -> DataFrame:
    """Gold rows of a split, by the first of its names that the folder has; ord is their order."""
    names = SPLITS.get(split.strip().lower(), [split.strip().lower()])
    have = [n for n in names if Path(f"{folder}/{n}.jsonl").exists()] if "://" not in folder else names[:1]
    if not have:
        raise FileNotFoundError(f"no {' or '.join(f'{n}.jsonl' for n in names)} in {folder}")
    lines = numbered_lines(spark, f"{folder}/{have[0]}.jsonl")
    return lines.select(F.col("line").alias("ord"), F.from_json("value", GOLD).alias("g")).select("ord", "g.*")


def _sentences(listed: Column) -> Column:
    """Sentences, each a text or written as a list of tokens."""
    tokens = F.transform(listed, lambda s: F.when(s.startswith("["), F.array_join(F.from_json(s, "array<string>"), " ")))
    return F.transform(listed, lambda s, i: F.coalesce(F.get(tokens, i), s))


def gold_graphs(rows: DataFrame, context: int = 8, prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """Gold rows → (events, edges): first mentions only, causal edges at 1.0 before temporal ones at 0.85, edges with unknown ends left out.

    An edge's id counts before equal edges (ends and type) are reduced to the first; source_relation is its name in the rows.
    Samples are named prefix and id; those with under two events or without an edge go.
    """
    return _fit(*_gold_parts(rows, context, prefix))


def _gold_parts(rows: DataFrame, context: int = 8, prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """gold_graphs with all samples."""
    rows = rows.withColumn("sample_id", F.concat(F.lit(prefix), "id")).withColumn("sentences", _sentences(F.col("sentences")))
    told = X.let(F.struct("sentences", "tokens", "events"), _told_events)
    e = rows.select("sample_id", F.col("id").alias("document_id"), F.posexplode(told).alias("ord", "e")).select("sample_id", "document_id", "ord", "e.*").where("m is not null and inside")
    words, trigger = F.col("words"), F.trim(F.coalesce("m.trigger_word", F.lit("")))
    start = F.greatest(F.get("m.offset", 0), F.lit(0))
    low, high = F.greatest(start - context, F.lit(0)), F.least(F.greatest(start + 1, F.get("m.offset", 1)) + context, F.size(words))
    window = F.slice(words, low + 1, F.greatest(high - low, F.lit(0)))
    told = F.concat(F.when(low > 0, "... ").otherwise(""), F.array_join(window, " "), F.when(high < F.size(words), " ...").otherwise(""))
    mention = F.when((F.size("m.offset") == 2) & (F.size(words) > 0) & (F.size(window) > 0), told).otherwise(F.col("sentence"))
    events = e.select(
        "sample_id", F.concat(F.lit("maven_e"), "ord").alias("event_id"), "ord", "gold_id", "document_id", F.col("at").alias("sentence_index"), trigger.alias("trigger"), mention.alias("mention"),
        X.event_mention(trigger, mention).alias("text"), F.lower(F.coalesce(F.nullif(trigger, F.lit("")), "sentence")).alias("normalized_text"), F.array().cast("array<string>").alias("participants"), F.lit(1.0).alias("confidence"),
        F.lit("observed").alias("node_type"), F.lit(False).alias("is_title"), F.col("sentence").alias("evidence"), "event_type",
    )
    kinds = [("causal_relations", 0, 1.0), ("temporal_relations", 1, 0.85)]
    told_edges = None
    for column, block, score in kinds:
        one = rows.select("sample_id", F.posexplode(F.map_entries(column)).alias("k", "r"))
        one = one.select("sample_id", "k", F.col("r.key").alias("kind"), F.posexplode("r.value").alias("i", "pair"))
        kind = F.when(F.col("kind") == "CAUSE", "causes").otherwise("precedes")
        one = one.select("sample_id", F.struct(F.lit(block).alias("b"), "k", "i").alias("at"), F.get("pair", 0).alias("a"), F.get("pair", 1).alias("b"), kind.alias("relation_type"), F.lit(score).alias("score"), F.col("kind").alias("source_relation"))
        told_edges = one if told_edges is None else told_edges.unionByName(one)
    ids = events.select("sample_id", "gold_id", "event_id")
    edges = told_edges.join(ids.toDF("sample_id", "a", "source"), ["sample_id", "a"]).join(ids.toDF("sample_id", "b", "target"), ["sample_id", "b"])
    order = F.row_number().over(Window.partitionBy("sample_id").orderBy("at")) - 1
    edges = dedupe_edges(edges.select("sample_id", F.concat(F.lit("gold_edge_"), order).alias("edge_id"), "source", "target", "relation_type", "score", "source_relation", order.alias("ord")))
    return events, edges


def _told_events(row: Column) -> Column:
    """Events of a gold row, each with its sentence and that one's tokens: picked in the row, so that no event takes along all of them."""

    def one(e: Column) -> Column:
        m = F.get(e["mention"], 0)
        at = F.coalesce(m["sent_id"], F.lit(0))
        picked = {"sentence": F.get(row["sentences"], at), "words": F.get(row["tokens"], at)}
        return F.struct(e["id"].alias("gold_id"), e["type"].alias("event_type"), m.alias("m"), at.alias("at"), (at < F.size(row["sentences"])).alias("inside"), *[c.alias(k) for k, c in picked.items()])

    return F.transform(row["events"], one)


def _fit(events: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    fit = events.groupBy("sample_id").count().where("count >= 2").join(edges.select("sample_id").distinct(), "sample_id", "left_semi").select("sample_id")
    return events.join(fit, "sample_id", "left_semi"), edges.join(fit, "sample_id", "left_semi")


def gold_samples(rows: DataFrame, limit: int = 0, max_events: int = 0) -> tuple[DataFrame, DataFrame]:
    """(events, edges) of gold samples: the first limit rows, each cut to max_events by its best edges; what is left too small goes."""
    rows = rows.orderBy("ord").limit(limit) if limit > 0 else rows
    if max_events <= 0:
        return gold_graphs(rows, prefix="maven_")
    events, edges = _gold_parts(rows, prefix="maven_")
    edges = steps.cut(edges)  # narrow; what is left of events and edges asks for them many times
    return _fit(*truncate_graph(*_fit(events, edges), max_events))


def coarse_graphs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Graph files, one JSON value each, bare or under coarse_graph → (documents, events, edges); every field is optional."""
    whole = spark.read.text(path, wholetext=True).select(F.coalesce(F.get_json_object("value", "$.coarse_graph"), "value").alias("json"))
    g = whole.select(F.from_json("json", GRAPH).alias("g")).select(F.coalesce("g.query.query_id", F.lit("query")).alias("sample_id"), "g.*")
    docs = g.select("sample_id", F.posexplode("documents").alias("ord", "d")).select("sample_id", "ord", "d.*")
    events = g.select("sample_id", F.col("query.text").alias("query"), F.col("query.cutoff_time").alias("cutoff_time"), F.posexplode("events").alias("ord", "e")).select("sample_id", "query", "cutoff_time", "ord", "e.*")
    events = events.withColumns({
        "confidence": F.coalesce("confidence", F.lit(0.0)), "sentence_index": F.coalesce("sentence_index", F.lit(0)), "node_type": F.coalesce("node_type", F.lit("observed")), "participants": F.coalesce("participants", F.array().cast("array<string>")),
        "trigger": F.coalesce(F.try_element_at("metadata", F.lit("trigger")), F.lit("")), "event_time_text": F.try_element_at("metadata", F.lit("publish_time")), "is_title": F.coalesce(F.lower(F.try_element_at("metadata", F.lit("is_title"))) == "true", F.lit(False)),
    })
    edges = g.select("sample_id", F.posexplode("edges").alias("ord", "e")).select("sample_id", "ord", "e.edge_id", F.col("e.source_event_id").alias("source"), F.col("e.target_event_id").alias("target"), F.coalesce("e.relation_type", F.lit("precedes")).alias("relation_type"), F.coalesce("e.score", F.lit(0.0)).alias("score"), "e.feature_scores", "e.metadata")
    return docs, events, edges
