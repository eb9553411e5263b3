"""The registered queries of the operators, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.llm import dialogue, langid, mixing, neighbours, packing, pii, quality, simhash, sketches, spelling, url_filter, warc, wrappers
from loanlens.llm.common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_filter.rule_table(spark, url_filter.RULES)
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op3_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc.page_captures(table(spark, sf_dir, "pages")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.select(
        "record_id", "canonical", "verdict", "refers_to", F.concat_ws(";", lines).alias("headers"), F.md5("payload").alias("payload_md5"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract_text(table(spark, sf_dir, "pages"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.compare_versions(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.learn(docs))
    return found.select("doc_id", langid.is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_forms(table(spark, sf_dir, "documents"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def op13_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    return dialogue.repair_report(dialogue.damaged(given), given)


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_simhash": op2_simhash,
    "op3_revisits": op3_revisits,
    "op4_main_text": op4_main_text,
    "op5_neighbours": op5_neighbours,
    "op6_sketches": op6_sketches,
    "op7_pii": op7_pii,
    "op8_mix": op8_mix,
    "op9_language": op9_language,
    "op10_packing": op10_packing,
    "op11_spelling": op11_spelling,
    "op12_quality": op12_quality,
    "op13_dialogue": op13_dialogue,
}

SQL = {
    "op1_url_filter": """
        with parts as (
            select page_id,
                   translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                   coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
            from pages),
        judged as (
            select *, case
                when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
                when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
                when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
                when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/'
            end as rule
            from parts)
        select page_id, host, path, rule,
               case when rule in ('net/', 'example.com/de/') then 'block' else 'allow' end as verdict
        from judged""",
    "op3_revisits": """
        with captures as (
            select page_id,
                   regexp_replace(regexp_replace(lower(regexp_extract(url, '^([^:]*://[^/]*/[^/]*)', 1)), '^[a-z]+://', ''), '^www\\.', '') || '/' as canonical,
                   ((page_id % 4) + 4) % 4 = 0 as is_full, '"' || (floor(page_id / 64)::bigint)::varchar || '"' as tag, html
            from pages),
        found as (
            select *, last_value(case when is_full then {'id': page_id, 'tag': tag, 'html': html} end ignore nulls) over (
                       partition by canonical order by page_id rows between unbounded preceding and 1 preceding) as base
            from captures),
        judged as (
            select *, case when is_full then 'full' when base is null then 'missing' when base.tag = tag then 'resolved' else 'changed' end as verdict
            from found)
        select page_id as record_id, canonical, verdict,
               case when not is_full then base.id end as refers_to,
               'content-length=' || case when is_full then length(html) when verdict = 'resolved' then length(base.html) else 0 end
                   || ';date=' || page_id || ';etag=' || case when is_full then '' else 'W/' end || tag as headers,
               md5(case when is_full then html when verdict = 'resolved' then base.html end) as payload_md5
        from judged""",
}
