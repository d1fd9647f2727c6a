"""The registered queries of this subpackage: each applies one operator to its whole table. SQL twins in `oracles`."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, decontam, langid, licenses, neardup, packing, pii, records, secrets, spelling, tokencount, topk, urlfilter

#: The queries' key; a real job takes a secret one.
PII_KEY = "registered query"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = langid.fit(docs.where(~held_out))
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "coverage")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY)
    counts = [F.coalesce(F.try_element_at("pii", F.lit(k)), F.lit(0)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, "text")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("secrets", lambda x: x["rank"] < 3)

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda x: x["rank"] == secrets.KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in secrets.KINDS], F.sha2(secrets.listing(base), 256).alias("base_sha256"), secrets.listing(F.col("secrets")).alias("spans"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft")


def op6_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tokencount.token_count(F.col("text"), tokenizer_path("piece_bpe_32k.model")).alias("n_tokens"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = records.new_folder(spark)
    records.write(table(spark, sf_dir, "documents"), folder, tokenizer_path("byte_bpe_50k.json"))
    return records.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(audit.counters(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels")))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_secret_scan, op3_minhash_near_dedup, op4_url_filter, op5_benchmark_decontamination, op6_token_count, op7_pii_surrogates, op8_license_scan, op9_packing, op10_exact_top_k, op11_spelling_variants, op12_binary_records, op13_filter_interaction_audit)}

_HOST = "translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1)"


def _terms(terms: list[str]) -> str:
    return " + ".join(f"CAST(regexp_matches(u, '(^|[^a-z0-9]){t}($|[^a-z0-9])') AS INT)" for t in terms)


ORACLES: dict[str, str] = {
    "op4_url_filter": f"""
WITH p AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u FROM pages),
r(verdict, rule) AS (VALUES ('allow', 'org/'), ('block', 'example.org/es/'), ('block', 'example.org/en/1'), ('allow', 'com/fr/'), ('block', 'com/de/')),
f AS (SELECT *, split_part(rule, '/', 1) AS h, substr(rule, length(split_part(rule, '/', 1)) + 1) AS s FROM r),
n AS (SELECT *, {_terms(urlfilter.STRICT)} AS n_strict, {_terms(urlfilter.SOFT)} AS n_soft FROM p),
m AS (SELECT n.*, (SELECT max(struct_pack(k := length(rule), rule := rule, verdict := verdict)) FROM f WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s)) AS best FROM n)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, CASE WHEN n_strict > 0 OR n_soft >= 2 THEN 'block' ELSE 'allow' END) AS verdict, n_strict, n_soft FROM m
""",
    "op13_filter_interaction_audit": f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
g AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, MAP {{'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words),
    'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), 'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(w.doc_id > first, false)}} AS fails FROM w LEFT JOIN g USING (doc_id)),
o(filter_order) AS (VALUES {", ".join(f"('{''.join(x)}')" for x in permutations("ABCDE"))}),
r AS (SELECT part, good, toxic, filter_order, s AS step, fails[filter_order[s]] AS fail, list_bool_or(list_prepend(false, list_transform(range(1, s), lambda x: fails[filter_order[x]]))) AS gone,
    list_sum(list_transform(map_values(fails), lambda x: CAST(x AS INT))) AS n_fails FROM f, o, range(1, 6) AS steps(s)),
c AS (SELECT part, filter_order, CAST(step AS INT) AS step, count(*) FILTER (NOT fail AND NOT gone) AS kept, count(*) FILTER (fail AND NOT gone) AS removed, count(*) FILTER (fail AND gone) AS redundant,
    count(*) FILTER (fail AND n_fails = 1) AS unique_fails, count(*) FILTER (fail AND NOT gone AND good = 1) AS good_lost, count(*) FILTER (fail AND NOT gone AND toxic = 1) AS toxic_lost FROM r GROUP BY ALL)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, filter_order[step]) AS BIGINT) AS shapley FROM c
""",
}
