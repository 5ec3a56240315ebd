"""The registered queries of the training-data operators, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import bpe, embeddings, infill, jaccard, knn, language, lines, mixing, pii, quality, retrieval, store, urls
from driftline.llm.common import table

def vocabulary(path: str | None = None) -> str:
    """The JSON of a public byte-level BPE vocabulary; ``path`` defaults to the installed one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


#: Fixed values of the contract: action, host, path.
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return urls.judged(table(spark, sf_dir, "pages"), rules)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy does, by bit arithmetic over the counted ledger."""
    return quality.ablations(quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False), "v2")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, keys = store.write_store(table(spark, sf_dir, "documents"), vocabulary())
    return made.digests(keys).select(F.nullif("key", F.lit(-(2**63))).alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary())


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.coalesce(language.held_out(), F.lit(False)).alias("held_out"))
    model = language.train(docs.where("not held_out"))
    return language.predicted(docs.select("doc_id", "held_out", "text"), model, keep_text=False)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mixed(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "mix_source", "mix_lang", "mix_topic", "mix_tokens", F.round("mix_ratio", 6).alias("mix_ratio"), F.round("mix_probability", 6).alias("mix_probability"), "mix_copies", "kept")


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymised(docs, secret="driftline-demo-key")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.deduplicated(docs, exact_words=1)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("row", "class")


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id 50 divides, against all rows."""
    return knn.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = retrieval.build(table(spark, sf_dir, "documents"))
    return retrieval.search(index, table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_ngram_jaccard": op1_ngram_jaccard, "op2_line_dedup": op2_line_dedup, "op6_pii": op6_pii, "op4_embedding_near_dedup": op4_embedding_near_dedup, "op5_mixing": op5_mixing, "op10_language": op10_language, "op8_token_files": op8_token_files, "op9_bpe": op9_bpe, "op3_url_filters": op3_url_filters, "op7_quality_rules": op7_quality_rules, "quality_ablations": quality_ablations, "op11_exact_top_k": op11_exact_top_k, "op12_fill_in_middle": op12_fill_in_middle, "op13_ranked_search": op13_ranked_search}
_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
_URLS = f"""WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{urls._UPPER}', '{urls._LOWER}') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages), r(verdict, h, p) AS (VALUES {_RULES}),
  m AS (SELECT u.page_id, max_by({{'rule': h || p, 'verdict': r.verdict}}, length(h || p) * 1000 + length(h)) AS best FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (page_id)"""
SQL: dict[str, str] = {"op3_url_filters": _URLS, "op5_mixing": mixing.sql(), "op7_quality_rules": quality.sql(), "quality_ablations": quality.ablations_sql(), "op4_embedding_near_dedup": embeddings.sql(), "op11_exact_top_k": knn.sql(), "op12_fill_in_middle": infill.sql(), "op13_ranked_search": retrieval.sql()}
