"""Reports: sets of edges, classifications, rates. Counts are aggregated once; ratios are columns over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicons import RELATIONS
from ..functions.values import label, prf, safe_div


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def compare(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of either side with in_gold and in_predicted: set operations as one full join."""
    g = gold.select(*keys).distinct().withColumn("in_gold", F.lit(True))
    p = predicted.select(*keys).distinct().withColumn("in_predicted", F.lit(True))
    return g.join(p, keys, "full_outer").select(*keys, _flag("in_gold").alias("in_gold"), _flag("in_predicted").alias("in_predicted"))


def set_report(gold: DataFrame, predicted: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 of distinct edge tuples, over all or for each value of by."""
    met = compare(gold, predicted, keys)
    tp, fp, fn = F.col("in_gold") & F.col("in_predicted"), ~F.col("in_gold"), ~F.col("in_predicted")
    counted = met.groupBy(*(by or [])).agg(*[F.count_if(c).alias(n) for n, c in (("tp", tp), ("fp", fp), ("fn", fn))])
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return counted.select(*(by or []), "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def classification_report(rows: DataFrame) -> DataFrame:
    """rows (gold, predicted) → precision, recall, f1 and support of each label observed on either side."""
    confusion = rows.groupBy("gold", "predicted").agg(F.count("*").alias("n"))
    sides = confusion.select("n", (F.col("gold") == F.col("predicted")).alias("hit"), F.explode(F.array_distinct(F.array("gold", "predicted"))).alias("label"), "gold", "predicted")
    counted = sides.groupBy("label").agg(
        F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(~F.col("hit") & (F.col("label") == F.col("predicted")), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(~F.col("hit") & (F.col("label") == F.col("gold")), F.col("n")).otherwise(0)).alias("fn"),
    )
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return counted.select("label", p.alias("precision"), r.alias("recall"), f.alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))


def classification_summary(rows: DataFrame) -> DataFrame:
    """accuracy, and means over the observed labels."""
    macro = classification_report(rows).agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"), F.sum("support").alias("total"))
    right = rows.agg(F.count_if(F.col("gold") == F.col("predicted")).alias("correct"))
    return macro.crossJoin(right).select("total", "correct", safe_div(F.col("correct"), F.col("total")).alias("accuracy"), "macro_precision", "macro_recall", "macro_f1")  # two single rows


def binary_report(rows: DataFrame) -> DataFrame:
    """rows (gold, predicted) of booleans."""
    g, p = F.col("gold"), F.col("predicted")
    counted = rows.agg(*[F.count_if(c).alias(n) for n, c in (("tp", g & p), ("fp", ~g & p), ("fn", g & ~p), ("tn", ~g & ~p))])
    precision, recall, f1 = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return counted.select("tp", "fp", "fn", "tn", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), safe_div(F.col("tp") + F.col("tn"), total).alias("accuracy"))


def edge_evaluation(gold: DataFrame, predicted: DataFrame, events: DataFrame, causal_only: bool = False) -> DataFrame:
    """One row a sample: typed counts, pairs of wrong type, and the accuracy of pairs, whatever their type, over all n (n - 1) ordered ones."""
    keys = ["sample_id", "source", "target"]
    if causal_only:
        gold, predicted = (e.where("relation_type <> 'precedes'") for e in (gold, predicted))
    typed = compare(gold, predicted, [*keys, "relation_type"])
    pairs = typed.groupBy(*keys).agg(F.bool_or("in_gold").alias("g"), F.bool_or("in_predicted").alias("p"), F.bool_or(F.col("in_gold") & F.col("in_predicted")).alias("exact"))
    per_pair = pairs.groupBy("sample_id").agg(F.count_if("exact").alias("exact"), F.count_if(F.col("g") & F.col("p") & ~F.col("exact")).alias("wrong_type"), F.count_if(F.col("g") & ~F.col("p")).alias("missed"), F.count_if(~F.col("g") & F.col("p")).alias("extra"))
    size = events.groupBy("sample_id").agg(F.count("*").alias("events"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("exact", "wrong_type", "missed", "extra")]
    out = size.join(per_pair, "sample_id", "left").select("sample_id", "events", *zero)
    universe = F.col("events") * (F.col("events") - 1)
    hit, wrong = F.col("exact") + F.col("wrong_type"), F.col("missed") + F.col("extra")
    return out.withColumn("pair_accuracy", safe_div(hit + F.greatest(universe - hit - wrong, F.lit(0)), universe))


def in_scope(edges: DataFrame, scope: str = "causal", relations: tuple[str, ...] = ("precedes", "causes")) -> DataFrame:
    """Gold edges of the relations asked for: all of them, or those told as causes or preconditions (source_relation)."""
    out = edges.where(F.col("relation_type").isin(*relations))
    return out if scope == "all" else out.where(F.upper("source_relation").isin("CAUSE", "PRECONDITION"))


def relation_report(gold: DataFrame, predicted: DataFrame, relations: tuple[str, ...] = ("precedes", "causes"), by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 of each relation; those that neither side has are zero where by is not given."""
    met = set_report(*[e.where(F.col("relation_type").isin(*relations)) for e in (gold, predicted)], ["sample_id", "source", "target", "relation_type"], [*(by or []), "relation_type"])
    if by:
        return met
    names = gold.sparkSession.createDataFrame([(r,) for r in relations], "relation_type string")
    zeros = [F.coalesce(c, F.lit(0)).alias(c) for c in met.columns[1:]]
    return names.join(met, "relation_type", "left").select("relation_type", *zeros)


def select_samples(samples: DataFrame, gold: DataFrame, limit: int, offset: int = 0, shuffle: bool = False, seed: int = 7) -> DataFrame:
    """samples (sample_id, ord) that have gold edges: limit of them from the offset, or limit of them in hash order."""
    fit = samples.join(gold.select("sample_id").distinct(), "sample_id", "left_semi")
    order = [F.xxhash64(F.lit(seed), "sample_id"), F.col("sample_id")] if shuffle else [F.col("ord")]
    return fit.orderBy(*order).offset(0 if shuffle else offset).limit(limit)


def select_debug_edges(rows: DataFrame, most: int) -> DataFrame:
    """The edges of each sample to look at: added ones, dropped ones of the graph, missed gold, then the likeliest; most of them, in order.

    rows: sample_id, ord, action, source_kind, gold_action, keep_probability. Samples with no more than most stay whole; most <= 0 cuts nothing.
    """
    if most <= 0:
        return rows
    missed = (F.col("gold_action") == "KEEP") & ~F.col("action").isin("KEEP", "ADD")
    turn = F.when(F.col("action") == "ADD", 0).when((F.col("action") == "DROP") & (F.col("source_kind") == "coarse"), 1).when(missed, 2).otherwise(3)
    likely = F.when(turn == 3, -F.col("keep_probability")).otherwise(0.0)
    place = F.row_number().over(Window.partitionBy("sample_id").orderBy(turn, likely, "ord"))
    return rows.withColumn("_n", place).where(F.col("_n") <= most).drop("_n")


def stacked(report: DataFrame, prefix: str, by: str | None = None) -> DataFrame:
    """(metric, value): the numbers of a report, named prefix.column (or prefix.key.column, for one row a key)."""
    names = [c for c in report.columns if c != by]
    name = F.concat_ws(".", F.lit(prefix), *([F.col(by)] if by else []), F.col("c"))
    rows = report.select(*([by] if by else []), F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n).cast("double") for n in names]))).alias("c", "value"))
    return rows.select(name.alias("metric"), "value")


#: the reports of an evaluation and how each is read from its counts of (gold, predicted)
REPORTS = {
    "coarse.parse": "rate", "coarse.candidate_pairs": "cover", "coarse.pair_classification_raw": "labels", "coarse.pair_classification_thresholded": "labels",
    "coarse.edge_binary_thresholded": "binary", "coarse.graph_unlabeled": "set", "coarse.graph_labeled": "set", "refinement.candidate_edges": "cover", "refinement.keep_binary": "binary",
    "refinement.candidate_label_classification": "labels", "refinement.graph_unlabeled": "set", "refinement.graph_labeled": "set",
}


def _facts(gold: DataFrame, pairs: DataFrame, coarse: DataFrame, candidates: DataFrame, refined: DataFrame, coarse_threshold: float, keep_threshold: float) -> DataFrame:
    """One row a pair of events: what gold, the candidates and the two graphs say of it. The five tables are read once, and grouped once."""
    from .graph import label_order

    none = F.lit(None).cast("string")
    parsed, score = F.col("relation_type").isNotNull(), F.coalesce("score", F.lit(0.0))
    raw = label(F.lower(F.trim(F.coalesce("relation_type", F.lit("none")))))
    kept = F.col("keep_probability") >= keep_threshold

    def part(rows: DataFrame, name: str, relation: Column = none, flag: Column | None = None, told: Column = none, cut: Column = none, order: Column | None = None) -> DataFrame:
        no_order = F.lit(None).cast("struct<priority:int,place:bigint>")
        flag, order = (x if x is not None else y for x, y in ((flag, F.lit(None).cast("boolean")), (order, no_order)))
        cols = {"part": F.lit(name), "relation": relation, "flag": flag, "told": told, "cut": cut, "order": order}
        return rows.select("sample_id", "source", "target", *[c.alias(k) for k, c in cols.items()])

    kind = F.col("relation_type")
    parts = [
        part(gold, "gold", kind, order=label_order()), part(coarse, "coarse", kind), part(refined, "refined", kind),
        part(pairs, "pair", flag=parsed, told=raw, cut=F.when(score >= coarse_threshold, raw).otherwise("none")),
        part(candidates, "candidate", flag=kept, told=F.when(kept, label(kind)).otherwise("none")),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)

    def of(name: str, value: Column) -> Column:
        return F.when(F.col("part") == name, value)

    said = F.struct("flag", "told", "cut")
    return rows.groupBy("sample_id", "source", "target").agg(
        F.coalesce(F.max_by("relation", "order"), F.lit("none")).alias("label"), *[F.bool_or(F.col("part") == x).alias(f"in_{x}") for x in ("gold", "pair", "coarse", "candidate", "refined")],
        *[F.collect_set(of(x, F.col("relation"))).alias(f"{x}_types") for x in ("gold", "coarse", "refined")], *[F.collect_list(of(x, said)).alias(f"{x}s") for x in ("pair", "candidate")],
    )


def _counted(facts: DataFrame) -> DataFrame:
    """(report, gold, predicted, n): how often each report meets each outcome, with a row of no count for every report."""

    def fact(report: str, g: Column, p: Column, n: Column | int = 1) -> Column:
        n = F.lit(n) if isinstance(n, int) else n
        return F.struct(F.lit(report).alias("report"), g.cast("string").alias("gold"), p.cast("string").alias("predicted"), n.cast("long").alias("n"))

    def each(listed: str, report: str, g, p) -> Column:
        return F.transform(listed, lambda x: fact(report, g(x), p(x)))

    yes = F.col("label") != "none"
    out = [
        each("pairs", "coarse.parse", lambda x: F.lit(True), lambda x: x["flag"]),
        each("pairs", "coarse.pair_classification_raw", lambda x: F.col("label"), lambda x: x["told"]),
        each("pairs", "coarse.pair_classification_thresholded", lambda x: F.col("label"), lambda x: x["cut"]),
        each("pairs", "coarse.edge_binary_thresholded", lambda x: yes, lambda x: x["cut"] != "none"),
        each("candidates", "refinement.keep_binary", lambda x: yes, lambda x: x["flag"]),
        each("candidates", "refinement.candidate_label_classification", lambda x: F.col("label"), lambda x: x["told"]),
        F.array(*[fact(r, F.col("in_gold"), F.col(f"in_{x}")) for r, x in (("coarse.candidate_pairs", "pair"), ("coarse.graph_unlabeled", "coarse"), ("refinement.candidate_edges", "candidate"), ("refinement.graph_unlabeled", "refined"))]),
    ]
    for report, x in (("coarse.graph_labeled", "coarse"), ("refinement.graph_labeled", "refined")):
        both, g, p = F.size(F.array_intersect("gold_types", f"{x}_types")), F.size("gold_types"), F.size(f"{x}_types")
        true, false = F.lit(True), F.lit(False)
        out.append(F.array(fact(report, true, true, both), fact(report, true, false, g - both), fact(report, false, true, p - both)))
    told = facts.select(F.explode(F.flatten(F.array(*out))).alias("f")).select("f.*").where("n > 0")
    zeros = facts.sparkSession.range(1).select(F.explode(F.array(*[fact(r, F.lit(None), F.lit(None), 0) for r in REPORTS])).alias("f")).select("f.*")
    return told.unionByName(zeros).groupBy("report", "gold", "predicted").agg(F.sum("n").alias("n"))


def evaluation(gold: DataFrame, pairs: DataFrame, coarse: DataFrame, candidates: DataFrame, refined: DataFrame, coarse_threshold: float = 0.5, keep_threshold: float = 0.5) -> DataFrame:
    """(metric, value) of a whole run over gold edges (sample_id, source, target, relation_type, ord).

    pairs: coarse candidates with the model's relation_type (null where it could not be read) and score; coarse: the graph made of them;
    candidates: those of the refiner with keep_probability and relation_type; refined: the refined graph.

    One pass: all tables become facts of pairs, facts become counts of outcomes, and grouping sets over the few counts give reports and
    the rows of labels that their means need. Tables without rows give zeros, and null means.
    """
    n, hit = F.col("n"), F.col("gold") == F.col("predicted")
    counted = _counted(_facts(gold, pairs, coarse, candidates, refined, coarse_threshold, keep_threshold))
    # an outcome counts once for its report (its first label) and once for each of its labels
    sides = counted.select("report", "gold", "predicted", "n", F.posexplode(F.array_distinct(F.array("gold", "predicted"))).alias("at", "label"))

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(F.when(c, n)), F.lit(0))

    once, mine = F.col("at") == 0, F.col("label")
    grouped = sides.groupingSets([["report"], ["report", "label"]], "report", "label").agg(
        F.grouping("label").alias("whole"), total(once).alias("total"), total(once & hit).alias("correct"),
        *[total(once & (F.col("gold") == g) & (F.col("predicted") == p)).alias(name) for name, g, p in (("tp", "true", "true"), ("fp", "false", "true"), ("fn", "true", "false"), ("tn", "false", "false"))],
        total(hit).alias("l_tp"), total(~hit & (mine == F.col("predicted"))).alias("l_fp"), total(~hit & (mine == F.col("gold"))).alias("l_fn"),
    )
    of_label = (F.col("whole") == 0) & F.col("label").isNotNull()
    means = zip(("macro_precision", "macro_recall", "macro_f1"), prf(F.col("l_tp"), F.col("l_fp"), F.col("l_fn")), strict=True)
    sums = ["total", "correct", "tp", "fp", "fn", "tn"]
    reports = grouped.groupBy("report").agg(*[F.max(F.when(F.col("whole") == 1, F.col(c))).alias(c) for c in sums], *[F.avg(F.when(of_label, c)).alias(k) for k, c in means])
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall, f1 = prf(tp, fp, fn)
    scores = [("precision", precision), ("recall", recall), ("f1", f1)]
    sets = [("tp", tp), ("fp", fp), ("fn", fn), *scores]
    read = {
        "rate": [("_rate", safe_div(tp, F.col("total")))], "cover": [("", tp + fp), ("candidate_gold_covered", tp), ("candidate_gold_coverage", safe_div(tp, tp + fn))],
        "labels": [("total", F.col("total")), ("correct", F.col("correct")), ("accuracy", safe_div(F.col("correct"), F.col("total"))), *[(k, F.col(k)) for k in ("macro_precision", "macro_recall", "macro_f1")]],
        "binary": [*sets[:3], ("tn", tn), *scores, ("accuracy", safe_div(tp + tn, F.col("total")))], "set": sets,
    }

    def named(report: str, key: str) -> str:
        if REPORTS[report] == "rate":
            return report + key
        whole, _, short = report.partition(".")
        return f"{whole}.{key or short}" if REPORTS[report] == "cover" else f"{report}.{key}"

    rows = [F.when(F.col("report") == r, F.array(*[F.struct(F.lit(named(r, k)).alias("metric"), v.cast("double").alias("value")) for k, v in read[kind]])) for r, kind in REPORTS.items()]
    # the size of gold stands in the counts: its pairs are met or lacking in every graph
    more = [F.when(F.col("report") == r, F.array(F.struct(F.lit(m).alias("metric"), (tp + fn).cast("double").alias("value")))) for r, m in (("coarse.graph_unlabeled", "dataset.gold_edges"), ("coarse.graph_labeled", "dataset.gold_labeled_edges"))]
    told = [F.coalesce(x, F.array().cast("array<struct<metric:string,value:double>>")) for x in [*rows, *more]]
    metrics = reports.select(F.explode(F.concat(*told)).alias("m")).select("m.metric", "m.value")
    samples = gold.select("sample_id").distinct().agg(F.count("*").cast("double").alias("value")).select(F.lit("dataset.samples").alias("metric"), "value")
    return samples.unionByName(metrics)


def run_rates(rows: DataFrame) -> DataFrame:
    """One row of rates and means over the queries of a run; without any, zeros.

    rows: input_valid, input_parsed (null where events were not read by a model), forecast_parsed, hit, hit_with_alternatives, reward, events, coarse_edges, refined_edges.
    """
    rates = {"event_input_success_rate": "input_valid", "forecast_parse_rate": "forecast_parsed", "code_hit_rate": "hit", "code_hit_with_alternatives_rate": "hit_with_alternatives"}
    means = {"average_reward": "reward", "average_event_count": "events", "average_coarse_edge_count": "coarse_edges", "average_refined_edge_count": "refined_edges"}
    n = F.count("*")
    return rows.agg(
        n.alias("samples"), *[safe_div(F.count_if(c), n).alias(k) for k, c in rates.items()], *[F.coalesce(safe_div(F.sum(F.col(c).cast("double")), n), F.lit(0.0)).alias(k) for k, c in means.items()],
        F.when(F.count("input_parsed") > 0, safe_div(F.count_if(F.coalesce("input_parsed", F.lit(False))), n)).alias("event_extraction_parse_rate"),
    )


def edge_sample_stats(edges: DataFrame, relations: list[str] = RELATIONS) -> DataFrame:
    """One row over labelled edges (sample_id, edge_label, type_id): samples, edges, positives, their share, and how many have each relation."""
    positive = F.col("edge_label") > 0.5
    out = edges.agg(F.count_distinct("sample_id").alias("samples"), F.count("*").alias("edges"), F.count_if(positive).alias("positive_edges"), *[F.count_if(positive & (F.col("type_id") == k)).alias(f"n_{r}") for k, r in enumerate(relations)])
    return out.withColumn("positive_ratio", safe_div(F.col("positive_edges"), F.col("edges")))


def micro(per_sample: DataFrame) -> DataFrame:
    """Reports of samples (tp, fp, fn) summed, with the ratios of the sums, and how many edges a sample has on either side."""
    total = per_sample.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")], F.count("*").alias("samples"))
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    gold, told = (safe_div(F.col("tp") + F.col(c), F.col("samples")) for c in ("fn", "fp"))
    return total.select("samples", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1"), gold.alias("average_gold_edges"), told.alias("average_predicted_edges"))


def review(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Every pair of either side: MATCH, MIS-TYPE, EXTRA or MISS."""
    keys = ["sample_id", "source", "target"]
    g, p = gold.select(*keys, F.col("relation_type").alias("gold_type")), predicted.select(*keys, F.col("relation_type").alias("predicted_type"))
    tag = F.when(F.col("gold_type").isNull(), "EXTRA").when(F.col("predicted_type").isNull(), "MISS").when(F.col("gold_type") == F.col("predicted_type"), "MATCH").otherwise("MIS-TYPE")
    return g.join(p, keys, "full_outer").withColumn("tag", tag)


def answer_scores(rows: DataFrame) -> DataFrame:
    """rows (predicted code, alternatives array, answers array) → hit, hit_with_alternatives and reward (1 for the code, a half for an alternative)."""
    hit = F.array_contains("answers", F.col("predicted"))
    other = F.arrays_overlap("answers", "alternatives")
    return rows.withColumn("hit", F.coalesce(hit, F.lit(False))).withColumn("hit_with_alternatives", F.col("hit") | F.coalesce(other, F.lit(False))).withColumn("reward", F.when(F.col("hit"), 1.0).when(F.col("hit_with_alternatives"), 0.5).otherwise(0.0))


def class_weights(edges: DataFrame, most: float = 10.0, labels: list[str] = RELATIONS) -> DataFrame:
    """Kept edges (label; those with edge_label 0, if there is such a column, don't count) → weight of each label.

    sqrt(mean count / count), clamped; 0 for a label that is not observed; null where at most one is.
    """
    kept = edges.where("edge_label > 0.5") if "edge_label" in edges.columns else edges
    names = edges.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    counted = names.join(kept.groupBy("label").agg(F.count("*").alias("n")), "label", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    mean = counted.where("n > 0").agg(F.avg("n").alias("mean"), F.count("*").alias("labels"))
    weight = F.when(F.col("n") > 0, F.least(F.greatest(F.sqrt(F.col("mean") / F.col("n")), F.lit(1.0 / most)), F.lit(most))).otherwise(0.0)
    return counted.crossJoin(mean).select("label", "n", F.when(F.col("labels") > 1, weight).alias("weight"))  # a row a label by one row


def positive_weight(edges: DataFrame, most: float = 10.0) -> DataFrame:
    """edges (edge_label) → negatives over positives, clamped to [1, most]; null without a positive."""
    counted = edges.agg(F.count_if(F.col("edge_label") == 1).alias("positives"), F.count_if(F.col("edge_label") == 0).alias("negatives"))
    ratio = F.least(F.greatest(safe_div(F.col("negatives"), F.col("positives")), F.lit(1.0)), F.lit(most))
    return counted.select("*", F.when(F.col("positives") > 0, ratio).alias("weight"))


def pair_stats(pairs: DataFrame, labels: list[str]) -> DataFrame:
    """One row: how many pairs have each label, zeros included, and how many have one at all."""
    out = pairs.agg(F.count("*").alias("pairs"), F.count_distinct("sample_id").alias("samples"), F.count_if(F.col("label") != "none").alias("positive_pairs"), *[F.count_if(F.col("label") == x).alias(f"n_{x}") for x in labels])
    return out.withColumn("positive_ratio", safe_div(F.col("positive_pairs"), F.col("pairs")))
