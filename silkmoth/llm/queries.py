"""Queries of the training-text operators, and their SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silkmoth.llm import langid, leakage, mixing, mojibake, parsimonious, templates, trie_counts, word_salad
from silkmoth.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_salad.spam_pages(table(spark, sf_dir, "crawl_docs")).where("spam").select("fetch_id")


def p1_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_salad.spam_pages(table(spark, sf_dir, "crawl_docs"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.garbled(table(spark, sf_dir, "crawl_docs")).select("fetch_id")


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.garbled(table(spark, sf_dir, "crawl_docs"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = trie_counts.term_counts(table(spark, sf_dir, "crawl_docs"), "fetch_id", "content")
    return counts.where("mark is not null").select("term", "mark")


def p4_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_counts.term_counts(table(spark, sf_dir, "crawl_docs"), "fetch_id", "content")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsimonious.distinctive(*parsimonious.fitted(table(spark, sf_dir, "crawl_docs"))).select("url", "term")


def p5_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsimonious.record_models(table(spark, sf_dir, "crawl_docs"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.articles(table(spark, sf_dir, "crawl_docs"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = leakage.load_items(table(spark, sf_dir, "eval_items"))
    return leakage.leaks(table(spark, sf_dir, "documents"), items).select("doc_id", "item_id").distinct()


def p8_removal_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = leakage.load_items(table(spark, sf_dir, "eval_items"))
    return leakage.removal_spans(leakage.leaks(table(spark, sf_dir, "documents"), items))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = langid.train(table(spark, sf_dir, "lang_samples"))
    return langid.mislabelled(langid.segments(table(spark, sf_dir, "documents"), model))


def p10_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = langid.train(table(spark, sf_dir, "lang_samples"))
    return langid.segments(table(spark, sf_dir, "documents"), model)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = mixing.sized(table(spark, sf_dir, "documents"), mixing.word_size(F.col("text")))
    plan = mixing.plan_mix(sizes, table(spark, sf_dir, "mix_targets"))
    return plan.report(spark).where("short").select("source")


def p9_mix(spark: SparkSession, sf_dir: str, tokenizer: str = mixing.TOKENIZER) -> DataFrame:
    sizes = mixing.sized(table(spark, sf_dir, "documents"), None, tokenizer=tokenizer)
    return mixing.select_mix(sizes, mixing.plan_mix(sizes, table(spark, sf_dir, "mix_targets")))


def p9_shares(spark: SparkSession, sf_dir: str, tokenizer: str = mixing.TOKENIZER) -> DataFrame:
    sizes = mixing.sized(table(spark, sf_dir, "documents"), None, tokenizer=tokenizer)
    return mixing.plan_mix(sizes, table(spark, sf_dir, "mix_targets")).report(spark)


_TERMS = """docs as (select distinct fetch_id, url, last_modified, content from crawl_docs where content is not null and fetch_id is not null),
words as (select *, unnest(regexp_extract_all(regexp_replace(content, '<[^>]*>', ' ', 'g'), '[A-Za-z0-9]+')) as w from {docs}),
terms as (select fetch_id, url, lower(w) as term, count(*) as c from words group by all)"""

_P4 = f"""with {_TERMS.format(docs="docs")},
counts as (select term, cast(sum(c) as bigint) as occurrences, count(*) as records from terms group by term),
marked as (select term, occurrences, records, case when records < 3 then 'rare'
  when records >= 0.4 * (select count(*) from docs) then 'common' end as mark from counts)
select {{columns}} from marked{{where}}"""

SQL = {
    "p4_found": _P4.format(columns="term, mark", where=" where mark is not null"),
    "p4_term_counts": _P4.format(columns="term, occurrences, records, mark", where=""),
    "p5_found": f"""with cur0 as (select * from (select *, row_number() over (partition by url order by last_modified desc nulls last, fetch_id desc) as rn
  from crawl_docs where content is not null and url is not null and fetch_id is not null) where rn = 1), {_TERMS.format(docs="cur0")},
n as (select count(*)::double as n from cur0), df as (select term, count(*) as df from terms group by term),
tot as (select url, sum(c)::double as t from terms group by url),
w as (select url, term, (0.4 + 0.6 * (c / t)) * ln(n / df) as weight from terms join df using (term) join tot using (url), n where df >= 2 and df <= n / 2)
select url, term from (select *, row_number() over (partition by url order by weight desc, term) as r from w) where r <= 3""",
    "p9_found": """with s as (select lower(regexp_replace(source, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g')) as source,
  len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+')) as size from documents)
select m.source from mix_targets m left join (select source, sum(size) as size from s group by source) x using (source)
where m.max_repeats * coalesce(x.size, 0) < m.target_share * (select sum(size) from s)""",
}


def queries() -> dict:
    """Name -> query, for the entry point."""
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit()}
