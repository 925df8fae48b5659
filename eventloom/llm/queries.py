"""Driver queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, divergence, html_extract, language_id, packing, phrases, simhash, substring_dedup, token_count, toxicity, url_filter, warc
from .common import bucket_of, registered, scratch, shared_dir, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(bucket_of("doc_id", 5) == 0, F.lit(False)))
    prototypes = language_id.train(docs.where("not held_out and lang is not null"))
    return language_id.predict(docs.select("doc_id", "held_out", "text"), prototypes, keep_text=False).drop("letters")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


#: allow or block, host, path: the rules of op3
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.rule_table(spark, URL_RULES)).drop("url")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", F.coalesce(bucket_of("doc_id", 4) == 2, F.lit(False)))
    labels = table(spark, sf_dir, "labels").where(F.coalesce(bucket_of("doc_id", 4) != 2, F.lit(False)))
    model = toxicity.train(docs, labels)
    return toxicity.score(docs, model, ["doc_id", "held_out"]).drop("passages")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), ["doc_id"])


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives go once they are read back; the rows read stay."""
    kept = shared_dir(spark)
    with scratch(spark):
        rows = warc.read(warc.write(table(spark, sf_dir, "pages"), registered(spark)), payload=False)
        rows = rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
        rows.write.parquet(kept)
    return spark.read.schema(rows.schema).parquet(kept)


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_packing": op2_packing,
    "op3_url_filter": op3_url_filter,
    "op10_substring_dedup": op10_substring_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_decontamination": op5_decontamination,
    "op6_nearest": op6_nearest,
    "op7_token_counts": op7_token_counts,
    "op8_simhash": op8_simhash,
    "op9_html_extraction": op9_html_extraction,
    "op11_warc": op11_warc,
    "op12_phrases": op12_phrases,
    "op13_source_divergence": op13_source_divergence,
}
ORACLE_SQL = {
    "op11_warc": """
        WITH rows AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
            firsts AS (SELECT html, min(page_id) AS first_id FROM rows WHERE page_id IS NOT NULL GROUP BY 1),
            typed AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h, CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM rows LEFT JOIN firsts USING (html))
        SELECT page_id, payload_bytes, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to,
            array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (CAST('0x' || substr(h, 1 + 5 * (k // 4), 5) AS BIGINT) >> (15 - 5 * (k % 4))) % 32, 1)), '') AS payload_digest
        FROM typed""",
    "op12_phrases": r"""
        WITH docs AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
            pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\n-\r]')) AS p FROM docs),
            lists AS (SELECT lang, list_filter(string_split_regex(p, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
            totals AS (SELECT lang, sum(len(w)) AS n FROM lists GROUP BY 1),
            grams AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM lists, (VALUES (1), (2), (3), (4)) AS sizes(m) WHERE len(w) >= m)),
            counts AS (SELECT lang, phrase, m, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
            cuts AS (SELECT lang, phrase, m, f, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM counts WHERE m > 1),
            scored AS (SELECT c.lang, c.phrase, c.m, c.f AS a, x.f AS l, y.f AS r, k, CAST(CAST(2000000 AS HUGEINT) * c.f // (x.f + y.f) AS BIGINT) AS score FROM cuts c
                JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:k], ' ') JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:c.m], ' ')),
            best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
            inner_ AS (SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(f) AS longer
                FROM (SELECT lang, w, f, s, unnest(range(1, m - s + 2)) AS i FROM (SELECT lang, string_split(phrase, ' ') AS w, f, m, unnest(range(2, m)) AS s FROM counts WHERE m > 2)) GROUP BY 1, 2),
            kept AS (SELECT best.* FROM best LEFT JOIN inner_ USING (lang, phrase) WHERE longer IS NULL OR CAST(100 AS HUGEINT) * longer < CAST(80 AS HUGEINT) * a),
            ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
    "op13_source_divergence": r"""
        WITH docs AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
            words AS (SELECT k, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
            kept AS (SELECT lang, term, count(*) AS c FROM words GROUP BY 1, 2 HAVING count(DISTINCT k) >= 3),
            langs AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY 1),
            names AS (SELECT DISTINCT lang, source FROM docs),
            own AS (SELECT w.lang, w.source, w.term, count(*) AS c FROM words w JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
            sums AS (SELECT lang, source, sum(c) AS n FROM own GROUP BY 1, 2),
            shares AS (SELECT g.lang, g.source, k.term, coalesce(o.c, 0) AS c, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(o.c, 0) + 1) // (coalesce(s.n, 0) + v) AS p, 1 + CAST(1000000000 AS HUGEINT) * (k.c + 1) // (l.n + v) AS q
                FROM names g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN sums s USING (lang, source) LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
            met AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM shares a JOIN shares b USING (lang, term) WHERE a.source <> b.source GROUP BY 1, 2, 3),
            pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM names a JOIN names b ON a.lang = b.lang AND a.source <> b.source
                LEFT JOIN met ON met.lang = a.lang AND met.source = a.source AND met.item = b.source),
            terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM shares WHERE c > 0 AND p > q),
            ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200""",
    "op10_substring_dedup": r"""
        WITH docs AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
            starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM docs WHERE len(w) >= 20),
            windows AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM starts),
            again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1),
            gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM again),
            words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM docs),
            kept AS (SELECT doc_id, count(g.k) AS n_removed, string_agg(x, ' ' ORDER BY words.k) FILTER (g.k IS NULL) AS t FROM words LEFT JOIN gone g USING (doc_id, k) GROUP BY 1)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (doc_id)""",
    "op3_url_filter": r"""
        WITH rules(action, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
                ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
            cut AS (SELECT row_number() OVER () AS k, page_id,
                CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
            urls AS (SELECT k, page_id,
                translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
            best AS (SELECT k, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.action, length(r.host || r.path)) AS action
                FROM urls u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY k)
        SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM urls LEFT JOIN best USING (k)""",
}
