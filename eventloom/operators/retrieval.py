"""Evidence retrieval and rule-based events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.lexicons import DEFAULT, Lexicon
from ..functions.values import field, first_json_object, is_object, words


#: up to so many query tokens are sent to the documents; beyond that both sides are shuffled by token
SENT_TOKENS = 200_000
#: up to so many different ones are part of the plan, as a filter
SENT_WORDS = 5_000


def _query_tokens(queries: DataFrame, lexicon: Lexicon) -> tuple[DataFrame, list[str] | None]:
    """((query_id, qn, token), marked to be sent out if they turn out to be few; the different tokens, if these are very few)."""
    q = queries.select("query_id", X.token_set(F.col("text"), lexicon).alias("qt"))
    rows = q.select("query_id", F.size("qt").alias("qn"), F.explode("qt").alias("token"))
    told = rows.select("token").limit(SENT_TOKENS + 1).collect()
    if len(told) > SENT_TOKENS:
        return rows, None
    vocabulary = sorted({r.token for r in told})
    return F.broadcast(rows), vocabulary if len(vocabulary) <= SENT_WORDS else None


def jaccard_of(both: Column, a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(both, a + b - both), F.lit(0.0))


def overlaps(queries: DataFrame, docs: DataFrame, column: str, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """(query_id, document_id, overlap, matched) with Jaccard overlap over 0, by an equi-join on tokens: texts without a common token never meet."""
    d = docs.select("document_id", X.token_set(F.col(column), lexicon).alias("dt"))
    met = d.select("document_id", F.size("dt").alias("dn"), F.explode("dt").alias("token")).join(_query_tokens(queries, lexicon)[0], "token")
    both = met.groupBy("query_id", "document_id", "qn", "dn").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("token")).alias("matched"))
    return both.select("query_id", "document_id", jaccard_of(F.col("n"), F.col("qn"), F.col("dn")).alias("overlap"), "matched")


def retrieve(queries: DataFrame, docs: DataFrame, max_docs: int = 6, title_weight: float = 1.4, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """queries (query_id, text), docs (document_id, ord, title, text) → the best documents of each query with rank and score.

    Tokens of title and text meet the queries' in one join. A document's tokens are in one task, so its scores are added up before the
    shuffle, and so are the best documents of each query. Matched terms are looked up for the best documents only.
    """
    d = docs.select("document_id", "ord", *[F.array_distinct(X.content_tokens(F.coalesce(c, F.lit("")), lexicon)).alias(n) for c, n in (("title", "tt"), ("text", "bt"))])

    def side(tokens: str, title: int) -> Column:
        return F.transform(tokens, lambda t: F.struct(t.alias("token"), F.lit(title).alias("title")))

    asked, vocabulary = _query_tokens(queries, lexicon)
    sized = d.withColumn("tn", F.size("tt")).withColumn("bn", F.size("bt"))
    if vocabulary is not None:  # only tokens that some query has are taken apart
        sized = sized.withColumns({c: F.filter(c, lambda w: w.isin(vocabulary)) for c in ("tt", "bt")})
    rows = sized.select("document_id", "ord", "tn", "bn", F.explode(F.concat(side("tt", 1), side("bt", 0))).alias("p")).select("*", "p.token", "p.title").drop("p")
    met = rows.join(asked, "token")
    out = met.groupBy("query_id", "document_id", "ord", "qn", "tn", "bn").agg(F.sum("title").alias("nt"), F.count("*").alias("n"))
    score = title_weight * jaccard_of(F.col("nt"), F.col("qn"), F.col("tn")) + jaccard_of(F.col("n") - F.col("nt"), F.col("qn"), F.col("bn"))
    out = out.select("query_id", "document_id", "ord", score.alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "ord"))
    best = out.withColumn("rank", rank).where(F.col("rank") <= max_docs)
    both = F.concat_ws(" ", "title", "text")
    told = best.join(docs.select("document_id", "title", "text"), "document_id").join(queries.select("query_id", F.col("text").alias("_query")), "query_id")
    # title and text are cut into tokens apart, and the space between them is no part of one
    terms = F.array_sort(F.array_intersect(X.token_set(F.col("_query"), lexicon), X.content_tokens(both, lexicon)))
    return told.select("query_id", "document_id", "ord", "score", terms.alias("matched_terms"), "rank")


def retrieve_own(queries: DataFrame, docs: DataFrame, max_docs: int = 6, title_weight: float = 1.4, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """retrieve() where each document belongs to one query (owner): an equi-join on the query, scored pair by pair.

    → (query_id, query, document_id, rank, score, title, text).
    """
    q = queries.select("query_id", F.col("text").alias("query"), X.token_set(F.col("text"), lexicon).alias("qt"))
    met = docs.join(q, F.col("owner") == F.col("query_id"))
    score = title_weight * X.jaccard(F.col("qt"), X.token_set(F.coalesce("title", F.lit("")), lexicon)) + X.jaccard(F.col("qt"), X.token_set(F.coalesce("text", F.lit("")), lexicon))
    met = met.withColumn("score", score).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "ord"))
    return met.withColumn("rank", rank).where(F.col("rank") <= max_docs).select("query_id", "query", "document_id", "rank", "score", "title", "text")


def empty_queries(queries: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(query_id, warning) of the queries that no document matched."""
    return queries.join(retrieved, "query_id", "left_anti").select("query_id", F.lit("no document matched").alias("warning"))


def document_sentences(docs: DataFrame) -> DataFrame:
    """One row a sentence: the title is number 0."""
    parts = F.concat(F.array(X.collapse(F.col("title"))), X.sentences(F.col("text")))
    rows = docs.select(*[c for c in docs.columns if c != "text"], F.posexplode(parts).alias("sentence_index", "sentence"))
    return rows.where("sentence <> ''")


def atomic_events(sentences: DataFrame, min_score: float = 0.24, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """sentences (query_id, query, document_id, sentence_index, sentence) → clauses that name an event, with trigger, participants and score."""
    rows = sentences.select("*", F.posexplode(X.clauses(F.col("sentence"))).alias("clause_index", "clause"))
    rows = rows.withColumn("normalized_text", X.normalize(F.col("clause"), lexicon))
    first = F.row_number().over(Window.partitionBy("query_id", "document_id", "sentence_index", "normalized_text").orderBy("clause_index"))
    rows = rows.withColumn("_n", first).where("_n = 1").drop("_n")
    rows = rows.withColumn("trigger", X.trigger(F.col("clause"), lexicon)).where("trigger is not null")
    score = X.clause_score(X.token_set(F.col("query"), lexicon), F.col("clause"), F.col("sentence_index") == 0, lexicon)
    rows = rows.withColumn("_s", score).where(F.col("_s") >= min_score)
    return rows.withColumn("score", F.round(F.least("_s", F.lit(0.98)), 4)).withColumn("participants", X.titlecase_entities(F.col("clause"))).drop("_s")


def document_events(retrieved: DataFrame, max_events_per_doc: int = 4, min_score: float = 0.24, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """retrieved (query_id, query, document_id, rank, title, text) → events with ids that run in order of score over the documents in their rank."""
    found = atomic_events(document_sentences(retrieved), min_score, lexicon)
    best = F.row_number().over(Window.partitionBy("query_id", "document_id").orderBy(F.desc("score"), "sentence_index", "clause_index"))
    found = found.withColumn("event_rank", best).where(F.col("event_rank") <= max_events_per_doc)
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "event_rank")) - 1
    text = X.event_mention(F.col("trigger"), F.col("clause"))
    return found.select("query_id", F.concat(F.lit("e"), number).alias("event_id"), number.alias("ord"), "document_id", "rank", "sentence_index", "trigger", text.alias("text"), "normalized_text", "participants", "score", F.least("score", F.lit(0.95)).alias("confidence"))


def sentence_events(retrieved: DataFrame, most: int = 4, min_score: float = 0.24, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """The events of each sentence of the retrieved documents, the first ones in the order of its clauses: a report on what extraction finds."""
    found = atomic_events(document_sentences(retrieved), min_score, lexicon)
    place = F.row_number().over(Window.partitionBy("query_id", "document_id", "sentence_index").orderBy("clause_index"))
    kept = found.withColumn("n", place).where(F.col("n") <= most)
    return kept.select("query_id", "rank", "document_id", "sentence_index", "sentence", "n", "trigger", F.col("clause").alias("text"), "normalized_text", "participants", "score")


def sentence_report(events: DataFrame) -> DataFrame:
    """sentence_events() nested: one row a query, with its documents, their sentences and their events."""
    one = F.struct("n", "text", "normalized_text", "trigger", "participants", "score")
    s = events.groupBy("query_id", "rank", "document_id", "sentence_index", "sentence").agg(F.array_sort(F.collect_list(one)).alias("events"))
    d = s.groupBy("query_id", "rank", "document_id").agg(F.array_sort(F.collect_list(F.struct("sentence_index", "sentence", "events"))).alias("sentences"))
    return d.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "document_id", "sentences"))).alias("documents"), F.sum(F.aggregate("sentences", F.lit(0), lambda a, x: a + F.size(x["events"]))).alias("events"))


def parse_extracted_events(responses: DataFrame, docs: DataFrame, most: int = 12, lexicon: Lexicon = DEFAULT, prefix: str = "qwen_e") -> DataFrame:
    """A model's events: responses (sample_id, response), docs (sample_id, ord, document_id, title, text) → events located in the documents.

    An unknown document is taken for the sample's first; an event needs a text or evidence; of equal ones (document, trigger, normal form)
    the first counts; the first most stay, numbered in order.
    """
    whole = responses.withColumn("_j", F.try_parse_json(first_json_object("response")))
    listed_events = F.try_variant_get(field(F.col("_j"), "events"), "$", "array<variant>")
    items = whole.select("sample_id", F.posexplode(listed_events).alias("ord", "e")).where(is_object(F.col("e")))
    named = {c: words(field(F.col("e"), c)) for c in ("document_id", "trigger", "event", "evidence")}
    rows = items.select("sample_id", "ord", *[v.alias(k) for k, v in named.items()], F.coalesce(words(field(F.col("e"), "confidence")).try_cast("double"), F.lit(0.7)).alias("confidence"), F.coalesce(F.transform(F.try_variant_get(field(F.col("e"), "participants"), "$", "array<variant>"), words), F.array().cast("array<string>")).alias("participants"))
    rows = rows.where("event <> '' or evidence <> ''")
    first = docs.groupBy("sample_id").agg(F.min_by("document_id", "ord").alias("_first"))
    rows = rows.join(docs.select("sample_id", "document_id", F.lit(True).alias("_known")), ["sample_id", "document_id"], "left").join(first, "sample_id")
    rows = rows.withColumn("document_id", F.when(F.col("_known"), F.col("document_id")).otherwise(F.col("_first")))
    rows = rows.join(docs.select("sample_id", "document_id", "title", F.col("text").alias("_text")), ["sample_id", "document_id"])
    rows = rows.withColumn("at", X.locate_sentence(F.col("title"), F.col("_text"), F.coalesce(F.nullif("evidence", F.lit("")), "event"), lexicon))
    context = F.coalesce(F.nullif("event", F.lit("")), F.col("at.sentence"))
    shown = F.coalesce(F.nullif("trigger", F.lit("")), F.element_at(F.split("event", " "), 1))
    rows = rows.withColumn("text", X.event_mention(shown, context)).withColumn("normalized_text", X.normalize(context, lexicon)).withColumn("_norm", X.normalize(F.col("text"), lexicon))
    once = F.row_number().over(Window.partitionBy("sample_id", "document_id", F.lower("trigger"), "_norm").orderBy("ord"))
    rows = rows.withColumn("_n", once).where("_n = 1")
    number = F.row_number().over(Window.partitionBy("sample_id").orderBy("ord"))
    rows = rows.withColumn("_n", number).where(F.col("_n") <= most)
    confidence = F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0))
    return rows.select("sample_id", F.concat(F.lit(prefix), F.col("_n") - 1).alias("event_id"), (F.col("_n") - 1).alias("ord"), "document_id", F.col("at.sentence_index").alias("sentence_index"), F.col("at.sentence").alias("sentence"), "trigger", "text", "normalized_text", "participants", F.lit("observed").alias("node_type"), confidence.alias("confidence"))


def news_for_ids(requests: DataFrame, news: DataFrame) -> DataFrame:
    """requests (query_id, docids array), news (document_id, ord, …): each id once, at its first place; of repeated news rows the first."""
    wanted = requests.select("query_id", F.posexplode("docids").alias("pos", "document_id")).groupBy("query_id", "document_id").agg(F.min("pos").alias("pos"))
    once = news.join(wanted.select("document_id").distinct(), "document_id", "left_semi")
    once = once.withColumn("_n", F.row_number().over(Window.partitionBy("document_id").orderBy("ord"))).where("_n = 1").drop("_n")
    return wanted.join(once, "document_id")


def choice_vocabulary(rows: DataFrame, most: int = 0) -> DataFrame:
    """rows (event_code, name, ord) → codes by how often they occur, each with its most frequent name (ties: the first seen); ids in order of code, from C001. Rows without a code go, blank names are no name."""
    given = rows.select(F.trim("event_code").alias("event_code"), F.trim(F.coalesce("name", F.lit(""))).alias("name"), "ord").where("event_code <> ''")
    names = given.groupBy("event_code", "name").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    best = F.max_by("name", F.struct(F.when(F.col("name") != "", F.col("n")).otherwise(0), -F.col("first")))
    codes = names.groupBy("event_code").agg(F.sum("n").alias("n"), best.alias("description"))
    if most > 0:
        codes = codes.orderBy(F.desc("n"), "event_code").limit(most)
    number = F.row_number().over(Window.orderBy("event_code"))  # a closed vocabulary of a few hundred codes, added up before
    return codes.select(F.format_string("C%03d", number).alias("choice_id"), "event_code", "description", "n")
