"""URL filter lists by hashed expressions, with DataFrame functions only.

A rule is (action, host, path). It fits a URL whose host is the rule's or a subdomain of it and whose path starts with
the rule's. The shapes of a rule set are the pairs (labels in the host, characters in the path) that occur in it. Each
URL is expanded into one expression, host suffix and path prefix, for each shape; expressions are equi-joined with the
rules on the first 32 bits of their SHA-256, the full digests confirm, and of the rules that fit the longest expression
wins (of equals, block).

While the rules are few, by a count, each shape is one broadcast join that keeps rows as they are: no shuffle. Beyond
that, the distinct (host, path) pairs are expanded and joined with salted rules.
Null URLs, or ones without "://", have an empty host and path; empty tables give empty results; repeated rows stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_HEX = 8
BROADCAST_RULES, BROADCAST_SHAPES, SALTS = 100_000, 32, 16


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(a).alias("action"), F.lit(h).alias("host"), F.lit(p).alias("path")) for a, h, p in rules])
    return spark.range(1).select(F.inline(rows))


def split_url(url: Column) -> tuple[Column, Column]:
    """(host with A-Z lower-cased, path)."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _expression(labels: int, chars: int) -> Column:
    """The expression of a shape; null where the URL is too short for it."""
    enough = (F.size(F.split("host", r"\.")) >= labels) & (F.length("path") >= chars)
    return F.when(enough, F.concat(F.substring_index("host", ".", -labels), F.substring("path", 1, chars)))


def _digested(rules: DataFrame) -> DataFrame:
    """Distinct expressions with digest, prefix and shape; block wins over allow for the same one."""
    expression = F.concat("host", "path")
    return rules.groupBy(F.lower("host").alias("host"), "path").agg(F.max("action").alias("action")).select(
        F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars"), expression.alias("rule"), "action",
        F.sha2(expression, 256).alias("digest"), F.substring(F.sha2(expression, 256), 1, PREFIX_HEX).alias("prefix"),
    )


def _rank(digest: Column, rule: Column, action: Column, wanted: Column) -> Column:
    return F.when(digest == wanted, F.struct(F.length(rule).alias("n"), (action == "block").alias("b"), rule.alias("rule"), action.alias("action")))


def _confirmed(candidates: Column, wanted: Column) -> Column:
    return F.array_max(F.transform(candidates, lambda r: _rank(r.digest, r.rule, r.action, wanted)))


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict added; columns of pages that have these names are replaced."""
    known = _digested(rules)
    shapes = [(r.labels, r.chars) for r in known.select("labels", "chars").distinct().collect()]  # as many as lengths, not as rules
    host, path = split_url(F.col(url_col))
    rows = pages.drop("host", "path", "rule", "verdict", "best").select("*", host.alias("host"), path.alias("path"))
    small = len(shapes) <= BROADCAST_SHAPES and known.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    out = _by_shape(rows, known, shapes) if small else _by_expression(rows, known, shapes)
    return out.select(*rows.columns, F.col("best.rule").alias("rule"), F.coalesce(F.col("best.action"), F.lit(default)).alias("verdict"))


def _by_shape(rows: DataFrame, known: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    names = rows.columns
    bests: list[Column] = []
    for k, (labels, chars) in enumerate(sorted(shapes)):
        of_shape = known.where((F.col("labels") == labels) & (F.col("chars") == chars))
        # rules with the same prefix become one row, so that the join never multiplies pages
        side = of_shape.groupBy(F.col("prefix").alias(f"_p{k}")).agg(F.collect_list(F.struct("digest", "rule", "action")).alias(f"_r{k}"))
        rows = rows.withColumn(f"_d{k}", F.sha2(_expression(labels, chars), 256))
        rows = rows.join(F.broadcast(side), F.substring(f"_d{k}", 1, PREFIX_HEX) == F.col(f"_p{k}"), "left")
        bests.append(_confirmed(F.col(f"_r{k}"), F.col(f"_d{k}")))
    nothing = F.lit(None).cast("struct<n:int,b:boolean,rule:string,action:string>")
    return rows.select(*names, F.array_max(F.array(nothing, *bests)).alias("best"))


def _by_expression(rows: DataFrame, known: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    urls = rows.select("host", "path").distinct()
    expressions = F.array_compact(F.array(*[_expression(*s) for s in sorted(shapes)]))
    asked = urls.select("host", "path", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).alias("salt"), F.explode(expressions).alias("e"))
    asked = asked.withColumn("wanted", F.sha2("e", 256)).withColumn("prefix", F.substring("wanted", 1, PREFIX_HEX))
    salted = known.select("prefix", "digest", F.col("rule").alias("r"), F.col("action").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    met = asked.join(salted, ["prefix", "salt"]).select("host", "path", _rank(F.col("digest"), F.col("r"), F.col("a"), F.col("wanted")).alias("best"))
    return rows.join(met.groupBy("host", "path").agg(F.max("best").alias("best")), ["host", "path"], "left")
