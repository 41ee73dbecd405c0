"""Crawled pages made from the documents table, the same in Spark and in SQL, so that every audit has rows on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def from_documents(docs: DataFrame) -> DataFrame:
    docs = docs.where("text is not null")
    i = F.col("doc_id")
    url = F.concat(F.lit("https://site.example/"), "lang", F.lit("/"), "source", F.lit("/"), i.cast("string"))
    line = F.substring_index("text", "\n", 1)
    title = F.when(i % 11 != 0, F.substring(line, F.lit(1), (F.lit(20) + i % 60).cast("int")))
    desc = F.when(i % 13 != 0, F.substring(F.col("text"), F.lit(1), (F.lit(40) + i % 150).cast("int")))
    status = F.when(i % 20 == 0, 404).when(i % 20 == 1, 301).when(i % 20 == 2, 500).otherwise(200)
    return docs.select(
        url.alias("url"), status.alias("status_code"), F.lit(None).cast("string").alias("error_message"), ((status == 200) & (i % 7 != 0)).alias("indexable"), F.when((status == 200) & (i % 7 != 0), "Indexable").otherwise("Other").alias("indexability_status"),
        title.alias("title"), desc.alias("meta_desc"), F.when(i % 9 != 0, F.substring(line, 1, 24)).alias("h1"), (i % 4).alias("h1_count"), F.when(i % 3 != 0, F.substring(line, 5, 16)).alias("h2"), (i % 3).alias("h2_count"),
        F.regexp_count("text", F.lit(r"[^ \t\n\x0b\f\r]+")).cast("long").alias("word_count"), F.octet_length("text").cast("long").alias("size_bytes"), F.when(i % 5 == 1, "/relative").when(i % 5 != 0, url).alias("canonical"),
        F.array().cast("array<string>").alias("inlinks"), F.array(F.concat(F.lit("https://site.example/"), "lang", F.lit("/"), "source", F.lit("/"), (i - i % 10).cast("string"))).alias("outlinks"),
        F.when(i % 4 == 0, F.array().cast("array<struct<src:string,alt:string,local_path:string>>")).otherwise(F.array(F.struct(F.concat(F.lit("/img/"), i.cast("string"), F.lit(".png")).alias("src"), F.when(i % 4 == 2, "").when(i % 4 == 3, "a picture").alias("alt"), F.lit(None).cast("string").alias("local_path")))).alias("images"),
        (i % 8).alias("depth"), (F.col("n_chars") % 1000).alias("response_time_ms"), F.when(i % 6 == 1, "  ").when(i % 6 != 0, title).alias("og_title"), F.when(i % 7 != 0, "described").alias("og_description"), F.when(i % 2 == 0, "/og.png").alias("og_image"), F.lit(None).cast("string").alias("og_url"), F.lit("article").alias("og_type"),
        F.lit(None).cast("string").alias("twitter_title"), F.lit(None).cast("string").alias("twitter_description"), F.lit(None).cast("string").alias("twitter_image"), F.when(i % 3 == 0, "summary").alias("twitter_card"),
        F.when(i % 8 == 0, F.array(F.lit('{"@context":"https://schema.org","@type":"Article"}'))).otherwise(F.array().cast("array<string>")).alias("schema_json_ld"), F.when(i % 16 == 0, F.array(F.lit("Missing '@type' property."))).otherwise(F.array().cast("array<string>")).alias("schema_errors"),
        F.when(i % 9 != 0, F.array(F.struct(F.lit(1).alias("level"), F.substring(line, 1, 24).alias("text")))).otherwise(F.array().cast("array<struct<level:int,text:string>>")).alias("headings"), F.col("text").alias("markdown"),
    )


SQL = r"""doc_pages AS (
  SELECT 'https://site.example/' || lang || '/' || source || '/' || doc_id AS url,
    CASE doc_id % 20 WHEN 0 THEN 404 WHEN 1 THEN 301 WHEN 2 THEN 500 ELSE 200 END AS status_code,
    (doc_id % 20 > 2 AND doc_id % 7 <> 0) AS indexable,
    CASE WHEN doc_id % 11 <> 0 THEN substr(split_part(text, chr(10), 1), 1, CAST(20 + doc_id % 60 AS INT)) END AS title,
    CASE WHEN doc_id % 13 <> 0 THEN substr(text, 1, CAST(40 + doc_id % 150 AS INT)) END AS meta_desc,
    CASE WHEN doc_id % 9 <> 0 THEN substr(split_part(text, chr(10), 1), 1, 24) END AS h1, doc_id % 4 AS h1_count,
    CASE WHEN doc_id % 3 <> 0 THEN substr(split_part(text, chr(10), 1), 5, 16) END AS h2, doc_id % 3 AS h2_count,
    len(regexp_extract_all(text, '[^ \t\n\x0b\f\r]+')) AS word_count, CAST(strlen(text) AS BIGINT) AS size_bytes,
    CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '/relative' ELSE 'https://site.example/' || lang || '/' || source || '/' || doc_id END AS canonical,
    'https://site.example/' || lang || '/' || source || '/' || (doc_id - doc_id % 10) AS outlink,
    doc_id % 4 AS image_kind, doc_id % 8 AS depth, n_chars % 1000 AS response_time_ms,
    CASE WHEN doc_id % 6 = 0 THEN NULL WHEN doc_id % 6 = 1 THEN '  ' WHEN doc_id % 11 <> 0 THEN substr(split_part(text, chr(10), 1), 1, CAST(20 + doc_id % 60 AS INT)) END AS og_title,
    CASE WHEN doc_id % 7 <> 0 THEN 'described' END AS og_description, CASE WHEN doc_id % 2 = 0 THEN '/og.png' END AS og_image, CASE WHEN doc_id % 3 = 0 THEN 'summary' END AS twitter_card,
    doc_id % 8 = 0 AS has_schema, doc_id % 16 = 0 AS has_errors, text AS markdown, doc_id
  FROM documents WHERE text IS NOT NULL)
"""

#: The audit predicates over doc_pages in SQL; duplicates count over all rows.
PREDICATES = {
    "all": "true",
    "status_2xx": "status_code BETWEEN 200 AND 299", "status_3xx": "status_code BETWEEN 300 AND 399", "status_4xx": "status_code BETWEEN 400 AND 499", "status_5xx": "status_code BETWEEN 500 AND 599",
    "title_missing": "coalesce(title, '') = ''", "title_duplicate": "coalesce(title, '') <> '' AND count(*) OVER (PARTITION BY title) > 1", "title_too_long": "coalesce(length(title), 0) > 60", "title_too_short": "coalesce(title, '') <> '' AND length(title) < 30",
    "desc_missing": "coalesce(meta_desc, '') = ''", "desc_duplicate": "coalesce(meta_desc, '') <> '' AND count(*) OVER (PARTITION BY meta_desc) > 1", "desc_too_long": "coalesce(length(meta_desc), 0) > 155", "desc_too_short": "coalesce(meta_desc, '') <> '' AND length(meta_desc) < 70",
    "h1_missing": "coalesce(h1, '') = ''", "h1_multiple": "h1_count > 1", "h1_duplicate": "coalesce(h1, '') <> '' AND count(*) OVER (PARTITION BY h1) > 1", "h2_missing": "coalesce(h2, '') = ''", "h2_multiple": "h2_count > 1",
    "images_missing_alt": "image_kind IN (1, 2)", "canonical_missing": "canonical IS NULL", "canonical_other": "canonical IS NOT NULL AND canonical <> url",
    "og_title_missing": "trim(coalesce(og_title, '')) = ''", "og_desc_missing": "trim(coalesce(og_description, '')) = ''", "schema_present": "has_schema", "schema_errors": "has_errors",
}
