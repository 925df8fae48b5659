"""Reader and validator of event-input-v1 records: JSON lines, an object, an array, or {"samples": [...]}.

Records are read as variants, so a value of the wrong type is told apart from one that is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.values import field, is_object, is_true, listed, words
from ..operators import steps
from .files import numbered_lines

VERSION = "event-input-v1"
SPAN = "array<struct<document_id:string,sentence_index:int,text:string>>"


class InvalidInput(ValueError):
    """Records that break a rule; the message names them."""


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """(ord, json) one row a record: of JSON lines the number of the line, of a .json value the place in its array or samples, from 0."""
    if path.endswith(".json"):
        whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value")).withColumn("v", F.try_parse_json("value"))
        samples = F.try_variant_get("v", "$.samples", "variant")
        inner = F.coalesce(samples, F.col("v"))
        array = F.try_variant_get(inner, "$", "array<variant>")
        lone = F.when(samples.isNotNull(), F.array(F.lit("samples must be an array"))).otherwise(F.array("value"))
        return whole.select(F.posexplode(F.coalesce(F.transform(array, lambda x: F.to_json(x)), lone)).alias("ord", "json"))
    return numbered_lines(spark, path).select(F.col("line").alias("ord"), F.col("value").alias("json"))


def _text(value: Column) -> Column:
    """A variant as text with its white space collapsed; null if nothing is left."""
    return F.nullif(X.collapse(words(value)), F.lit(""))


def _kind(value: Column, path: str) -> Column:
    """OBJECT, ARRAY, STRING, VOID (null) or another type; SQL null where the field is missing."""
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get(value, path, "variant")), "^[A-Z]+", 0)


def _not(value: Column, path: str, *kinds: str) -> Column:
    """Whether a field is there and of none of the types."""
    kind = _kind(value, path)
    return F.coalesce(~kind.isin(*kinds), F.lit(False))


def _evidence(event: Column, document_id: Column, sentence_index: Column, mention: Column) -> Column:
    """Spans of an event's evidence, told as a text, an object or a list of these; the mention where there is none."""

    def one(v: Column) -> Column:
        own = F.coalesce(words(field(v, "sentence_index")).try_cast("int"), sentence_index)
        told = F.struct(F.coalesce(F.nullif(words(field(v, "document_id", "doc_id")), F.lit("")), document_id).alias("document_id"), own.alias("sentence_index"), words(field(v, "text", "sentence")).alias("text"))
        plain = F.struct(document_id.alias("document_id"), sentence_index.alias("sentence_index"), words(v).alias("text"))
        return F.when(is_object(v), told).otherwise(plain)

    given = field(event, "evidence")
    lone = F.array(F.struct(document_id.alias("document_id"), sentence_index.alias("sentence_index"), mention.alias("text")))
    spans = X.let(F.filter(F.transform(listed(given), one), lambda s: s["text"] != ""), lambda found: F.when(F.size(found) > 0, found).otherwise(lone))
    return F.when(given.isNull(), lone).otherwise(spans)


def _event(e: Column, i: Column) -> Column:
    """An event with aliases resolved: trigger and mention from fields, metadata, or a formatted text. What other fields are made of is computed once."""
    form = r"(?is)^\s*trigger=(.*?);\s*mention=(.*?)\s*$"
    meta = F.try_variant_get(e, "$.metadata", "variant")
    formatted = F.coalesce(F.try_variant_get(e, "$.text", "string"), F.lit(""))

    def told(group: int) -> Column:
        return F.when(formatted != "", F.nullif(X.collapse(F.regexp_extract(formatted, form, group)), F.lit("")))

    def number(name: str) -> Column:
        return F.nullif(words(field(e, name)), F.lit(""))

    parts = F.struct(
        F.coalesce(_text(F.coalesce(field(e, "trigger"), field(meta, "trigger"))), told(1)).alias("trigger"), F.coalesce(_text(F.coalesce(field(e, "mention", "event"), field(meta, "event_context"))), told(2)).alias("mention"),
        _text(field(e, "document_id", "doc_id")).alias("document_id"), number("sentence_index").alias("place"), number("confidence").alias("sure"), F.nullif(words(field(e, "normalized_text")), F.lit("")).alias("norm"),
        F.transform_values(F.try_variant_get(meta, "$", "map<string,variant>"), lambda k, v: words(v)).alias("meta"), is_true(field(meta, "is_title")).alias("is_title"),
    )

    def known(p: Column) -> Column:
        shown = X.event_mention(p["trigger"], p["mention"])
        place = F.when(p["place"].isNull(), 0).otherwise(p["place"].try_cast("int"))
        return X.let(F.struct(shown.alias("shown"), place.alias("place"), p.alias("p")), built)

    def built(q: Column) -> Column:
        p = q["p"]
        more = F.create_map(F.lit("trigger"), p["trigger"], F.lit("event_mention"), q["shown"], F.lit("event_context"), p["mention"], F.lit("event_input_schema"), F.lit(VERSION))
        own = F.map_filter(F.coalesce(p["meta"], F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin("trigger", "event_mention", "event_context", "event_input_schema"))
        return F.struct(
            i.alias("ord"), _text(field(e, "event_id")).alias("event_id"), p["trigger"].alias("trigger"), p["mention"].alias("mention"), p["document_id"].alias("document_id"), q["place"].alias("sentence_index"),
            F.when(p["sure"].isNull(), 1.0).otherwise(p["sure"].try_cast("double")).alias("confidence"), F.transform(listed(field(e, "participants")), words).alias("participants"),
            F.coalesce(p["norm"], X.normalize(p["mention"])).alias("normalized_text"), F.coalesce(F.nullif(words(field(e, "node_type")), F.lit("")), F.lit("observed")).alias("node_type"),
            q["shown"].alias("text"), _evidence(e, p["document_id"], F.coalesce(q["place"], F.lit(0)), p["mention"]).alias("evidence"), F.nullif(F.try_element_at(p["meta"], F.lit("publish_time")), F.lit("")).alias("event_time_text"),
            p["is_title"].alias("is_title"), F.map_concat(own, more).alias("metadata"),
        )

    return X.let(parts, known)


def _document(d: Column, i: Column) -> Column:
    return F.struct(
        i.alias("ord"), _text(field(d, "document_id", "doc_id")).alias("document_id"), words(field(d, "title")).alias("title"), words(field(d, "text")).alias("text"),
        F.nullif(words(field(d, "publish_time", "published_at")), F.lit("")).alias("publish_time"), F.coalesce(F.nullif(words(field(d, "source")), F.lit("")), F.lit("preextracted")).alias("source"),
        F.to_json(F.try_variant_get(d, "$.metadata", "variant")).alias("metadata"),
    )


def _query(q: Column) -> Column:
    fields = F.struct(
        _text(field(q, "query_id")).alias("query_id"), _text(field(q, "text")).alias("text"), F.nullif(words(field(q, "cutoff_time")), F.lit("")).alias("cutoff_time"),
        F.transform(listed(field(q, "focus_entities")), words).alias("focus_entities"),
    )
    return F.when(is_object(q), fields)


def _repeats(ids: Column) -> Column:
    return F.size(ids) != F.size(F.array_distinct(ids))


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that are computed once a row: they are generated, so neither a later column nor a filter that Spark moves below it computes them again."""
    made = rows.withColumn("_made", F.explode(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
    return made.withColumns({name: F.col("_made")[name] for name in columns}).drop("_made")


def validate(raw: DataFrame) -> DataFrame:
    """raw (ord, json) → records with an array of errors; no rule stops at the first failure. A record is parsed once, each of its parts is read once."""
    out = _once(raw, v=F.try_parse_json("json"))
    v = F.col("v")
    out = _once(out, _d=listed(field(v, "documents")), _e=listed(field(v, "events")), _q=field(v, "query"))
    out = _once(out, query=_query(F.col("_q")), documents=F.transform("_d", _document), events=F.transform("_e", _event))
    out = out.withColumn("query_id", F.coalesce(_text(field(v, "query_id")), F.col("query.query_id"))).withColumn("sample_id", F.coalesce(_text(field(v, "sample_id")), F.concat(F.lit("events_"), F.col("query_id"))))
    out = out.withColumn("schema_version", F.coalesce(_text(field(v, "schema_version")), F.lit(VERSION)))
    docs, ids = F.transform("documents", lambda d: d["document_id"]), F.transform("events", lambda e: e["event_id"])
    loose = F.array_distinct(F.array_compact(F.concat(F.transform("events", lambda e: e["document_id"]), F.flatten(F.transform("events", lambda e: F.transform(e["evidence"], lambda s: s["document_id"]))))))

    def some(c: str, bad) -> Column:
        return F.exists(c, lambda x: F.coalesce(bad(x), F.lit(False)))

    rules = [
        (~is_object(v), "not a JSON object"),
        (F.col("schema_version") != VERSION, "schema_version"),
        (is_true(F.try_variant_get(v, "$.edges", "variant")), "edges are not allowed"),
        (F.col("query_id").isNull(), "query_id is required"),
        (F.col("query").isNotNull() & (F.col("query.query_id").isNull() | F.col("query.text").isNull()), "query needs query_id and text"),
        (F.col("query.query_id") != F.col("query_id"), "query_id differs from the query's"),
        (_not(v, "$.query", "OBJECT", "VOID") | _not(v, "$.metadata", "OBJECT") | _not(v, "$.query.metadata", "OBJECT") | some("_d", lambda d: ~is_object(d) | _not(d, "$.metadata", "OBJECT")) | some("_e", lambda e: ~is_object(e) | _not(e, "$.metadata", "OBJECT")), "must be an object"),
        (_not(v, "$.documents", "ARRAY") | F.coalesce(_kind(v, "$.events") != "ARRAY", is_object(v)) | _not(v, "$.query.focus_entities", "ARRAY") | some("_e", lambda e: _not(e, "$.participants", "ARRAY")), "must be an array"),
        (some("_e", lambda e: _not(e, "$.evidence", "ARRAY", "OBJECT", "STRING", "VOID") | F.exists(listed(field(e, "evidence")), lambda x: F.coalesce(~F.schema_of_variant(x).rlike("^(OBJECT|STRING)"), F.lit(False)))), "evidence must be texts or objects"),
        (some("_e", lambda e: F.exists(listed(field(e, "evidence")), lambda x: is_object(x) & (words(field(x, "text", "sentence")) == ""))), "evidence needs document_id and text"),
        (some("_d", lambda d: _text(field(d, "document_id", "doc_id")).isNull()), "document_id is required"),
        (_repeats(docs), "repeated document_id"),
        ((_kind(v, "$.events") == "ARRAY") & (F.size("events") == 0), "no events"),
        (_repeats(ids), "repeated event_id"),
        (some("events", lambda e: e["event_id"].isNull()), "event_id is required"),
        (some("events", lambda e: e["trigger"].isNull() | e["mention"].isNull()), "trigger and mention are required"),
        (some("events", lambda e: e["document_id"].isNull()), "document_id is required"),
        (some("events", lambda e: e["sentence_index"].isNull() | (e["sentence_index"] < 0)) | some("_e", lambda e: _kind(e, "$.sentence_index") == "VOID"), "sentence_index"),
        (some("events", lambda e: e["confidence"].isNull() | F.isnan(e["confidence"]) | (e["confidence"] < 0) | (e["confidence"] > 1)) | some("_e", lambda e: _kind(e, "$.confidence") == "VOID"), "confidence"),
        ((F.size("documents") > 0) & (F.size(F.array_except(loose, docs)) > 0), "unknown document"),
    ]
    out = _once(out, errors=F.array_distinct(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), m) for c, m in rules]))))
    return out.select("ord", "json", "schema_version", "sample_id", "query_id", "query", "documents", "events", "errors")


def load(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """Valid records. FAILFAST raises on the first ones that break a rule, and where there is none; QUARANTINE leaves them to rejected()."""
    records = validate(read_raw(spark, path))
    if mode == "FAILFAST":
        bad = records.where(F.size("errors") > 0).select("ord", "query_id", "errors").orderBy("ord").limit(5).collect()
        twice = records.where("query_id is not null").groupBy("query_id").count().where("count > 1").limit(5).collect()
        if bad or twice:
            raise InvalidInput("; ".join([f"{path}:{r.ord} ({r.query_id}): {', '.join(r.errors)}" for r in bad] + [f"repeated query_id {r.query_id}" for r in twice]))
        if records.isEmpty():
            raise InvalidInput(f"{path}: no records")
    return records.where(F.size("errors") == 0)


def rejected(spark: SparkSession, path: str) -> DataFrame:
    return validate(read_raw(spark, path)).where(F.size("errors") > 0).select("ord", "query_id", "errors", "json")


def index(records: DataFrame) -> DataFrame:
    """(query_id, record): the records as a keyed table."""
    return records.select("query_id", F.struct(*[c for c in records.columns if c != "query_id"]).alias("record"))


def select_record(records: DataFrame, query_id: str | None = None) -> DataFrame:
    """The record of a query; without an id there must be exactly one."""
    one = records if query_id is None else records.where(F.col("query_id") == str(query_id))
    if one.limit(2).count() != 1:
        raise InvalidInput("exactly one record is needed" if query_id is None else f"no single record of query {query_id}")
    return one


def with_context(records: DataFrame, queries: DataFrame, documents: DataFrame) -> DataFrame:
    """Records with a query and documents: where either is missing, both come from the tables.

    queries (query_id, text, cutoff_time, focus_entities), documents (query_id, ord, document_id, title, text, publish_time, source).
    """
    q = queries.select("query_id", F.struct("query_id", "text", "cutoff_time", "focus_entities").alias("_query"))
    fields = ["ord", "document_id", "title", "text", "publish_time", "source"]
    d = documents.select("query_id", F.struct(*[F.col(c).cast("int" if c == "ord" else "string").alias(c) for c in fields], F.lit(None).cast("string").alias("metadata")).alias("d"))
    d = d.groupBy("query_id").agg(F.array_sort(F.collect_list("d")).alias("_documents"))
    lacking = F.col("query").isNull() | (F.size("documents") == 0)
    out = records.join(q, "query_id", "left").join(d, "query_id", "left")
    told = F.coalesce("_documents", F.array().cast(out.schema["_documents"].dataType))
    both = {"documents": F.when(lacking, told).otherwise(F.col("documents")), "query": F.when(lacking, F.col("_query")).otherwise(F.col("query"))}
    return out.withColumns(both).select(*records.columns)


def materialise(records: DataFrame, max_events: int = 0, max_docs: int = 0) -> tuple[DataFrame, DataFrame]:
    """(documents, events) tables keyed by sample_id. Documents are cut before references are checked, those of all events; a missing query,
    missing documents and under two events (after the cut of events) are errors. The parsed records are kept for the checks and the tables."""
    records = steps.cut(records.select("sample_id", "query_id", "query", "documents", "events"))
    docs = records.select("sample_id", F.explode("documents").alias("d")).select("sample_id", "d.*")
    every = records.select("sample_id", "query_id", F.col("query.text").alias("query"), F.col("query.cutoff_time").alias("cutoff_time"), F.col("query.focus_entities").alias("focus_entities"), F.explode("events").alias("e")).select("sample_id", "query_id", "query", "cutoff_time", "focus_entities", "e.*")
    docs = docs.where(F.col("ord") < max_docs) if max_docs > 0 else docs
    events = every.where(F.col("ord") < max_events) if max_events > 0 else every
    named = every.select("sample_id", F.explode(F.array_union(F.array("document_id"), F.transform("evidence", lambda s: s["document_id"]))).alias("document_id"))
    lost = named.join(docs.select("sample_id", "document_id"), ["sample_id", "document_id"], "left_anti").select("document_id").distinct().orderBy("document_id").limit(5).collect()
    bare = F.when(F.col("query").isNull() | (F.size("documents") == 0), F.concat("query_id", F.lit(" lacks a query or documents")))
    few = F.when(F.least(F.size("events"), F.lit(max_events if max_events > 0 else 2)) < 2, F.concat("sample_id", F.lit(" has under two events")))
    odd = records.select(F.concat_ws("; ", bare, few).alias("e")).where("e <> ''").limit(5).collect()
    if odd or lost:
        raise InvalidInput("; ".join([r.e for r in odd] + [f"unknown document {r.document_id}" for r in lost]))
    return docs, events.join(docs.select("sample_id", "document_id", "publish_time"), ["sample_id", "document_id"], "left")


def summary(records: DataFrame) -> DataFrame:
    """One row: records, events, the first 20 ids in the order of the file, and how many records have a query and documents of their own."""
    has = {"n": F.size("events"), "query": F.col("query").isNotNull(), "documents": F.size("documents") > 0}
    records = steps.cut(records.select("ord", "query_id", *[c.alias(name) for name, c in has.items()]))  # records are parsed once, for the counts and the first ids
    first = records.select("ord", "query_id").orderBy("ord").limit(20).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "query_id"))), lambda x: x["query_id"]).alias("query_ids"))
    counted = records.agg(F.count("*").alias("records"), F.coalesce(F.sum("n"), F.lit(0)).alias("events"), F.count_if("query").alias("with_query"), F.count_if("documents").alias("with_documents"))
    return counted.crossJoin(first)  # two single rows
