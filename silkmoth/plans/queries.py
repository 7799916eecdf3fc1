"""Queries of the core operators over the test tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silkmoth.functions import html, http, text, urls, xpath
from silkmoth.functions.robots import robots
from silkmoth.operators import crawl, index, kv, linkgraph, packed, pagerank, search, skew
from silkmoth.plans import lineage, sql
from silkmoth.sources import files, sinks
from silkmoth.sources.tables import table
from silkmoth.streaming import topology

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query()
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.unpack_rows(table(spark, sf_dir, "link_lines"), "line_id", "dest")


@query(
    """with n as (select count(*) as n from link_edges), k as (
select 'dest' as side, dest as node, count(*) as c from link_edges where dest is not null group by dest
union all select 'url', url, count(*) from link_edges where url is not null group by url)
select side, node from k, n where c >= 0.01 * n"""
)
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "link_edges")
    results = skew.per_key(edges, ["dest", "url"], "seen_at", "edge_id")
    return skew.hot_keys(results, edges.count()).select("side", "node")


@query(
    """with k as (select 'dest' as side, dest as node, edge_id, seen_at from link_edges where dest is not null
union all select 'url', url, edge_id, seen_at from link_edges where url is not null),
s as (select *, epoch_us(seen_at) - lag(epoch_us(seen_at)) over (partition by side, node order by seen_at nulls first, edge_id) as step from k)
select side, node, count(*) as n_rows, min(seen_at) as first_at, max(seen_at) as last_at, max(step) as longest_step from s group by side, node"""
)
def p7_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = skew.per_key(table(spark, sf_dir, "link_edges"), ["dest", "url"], "seen_at", "edge_id")
    return results.select("side", "node", "n_rows", "first_at", "last_at", "longest_step")


# --- urls -----------------------------------------------------------------------------

_URL = """u0 as (select {key}, trim({col}) as u from {t}),
u1 as (select *, regexp_extract(u, '^(https?)://', 1) as protocol, regexp_extract(u, '^https?://([^/]*)', 1) as authority,
  case when regexp_matches(u, '^https?://[^/]*/') then regexp_replace(u, '^https?://[^/]*', '') else '/' end as path from u0
  where regexp_matches(u, '^https?://') and length(u) >= 8),
u2 as (select {key}, protocol, case when authority = '' then null else split_part(authority, ':', 1) end as host,
  case when authority = '' then 0 else coalesce(try_cast(nullif(regexp_extract(authority, '^[^:]*:([+-]?[0-9]+)$', 1), '') as int),
    case when protocol = 'https' then 443 else 80 end) end as port, path from u1)"""


@query(f"with {_URL.format(key='edge_id', col='dest', t='link_edges')} select *, protocol || '://' || host || ':' || port || path as normalized from u2")
def url_parse_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "link_edges", "edge_id", "dest").withColumn("p", urls.parse_url(F.col("dest"))).where("p is not null")
    return rows.select("edge_id", "p.*", urls.normalize(F.col("p")).alias("normalized"))


@query(f"with {_URL.format(key='edge_id', col='dest', t='link_edges')} select edge_id, path, not contains(path, '.') or regexp_matches(path, '[.](htm|html|xml|rss)$') as desired from u2")
def url_desired(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "link_edges", "edge_id", "dest").withColumn("p", urls.parse_url(F.col("dest"))).where("p is not null")
    return rows.select("edge_id", "p.path", urls.is_desired(F.col("p.path")).alias("desired"))


@query("select url, url_encode(url) as encoded, url_decode(url_encode(url)) as decoded from page_ranks")
def url_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "page_ranks", "url").withColumn("encoded", F.url_encode("url"))
    return rows.select("url", "encoded", F.url_decode("encoded").alias("decoded"))


@query(
    """with p as (select distinct fetch_id, links from parsed_links where links is not null and len(links) > 0),
l as (select fetch_id, unnest(generate_series(1, len(links))) as pos, unnest(links) as x from p)
select fetch_id, pos, x.protocol, x.host, x.port, x.path from l"""
)
def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "crawl_docs", "fetch_id", "url", "mime", "content").where(F.contains("mime", F.lit("text/html")))
    wanted = table(spark, sf_dir, "parsed_links", "fetch_id", "links").where("links is not null and size(links) > 0")
    rows = docs.join(wanted, "fetch_id", "left_semi")  # fetches that were parsed
    return page_links(rows).distinct()


@query()
def link_extract_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every HTML fetch, also of those that ``parsed_links`` has no links of."""
    docs = table(spark, sf_dir, "crawl_docs", "fetch_id", "url", "mime", "content").where(F.contains("mime", F.lit("text/html")))
    return page_links(docs.where("fetch_id is not null and content is not null")).distinct()


def page_links(docs: DataFrame) -> DataFrame:
    """``(fetch_id, pos, protocol, host, port, path)``: desired links of pages in page order."""
    base = docs.withColumn("base", urls.parse_url(F.col("url")))
    found = base.withColumn("links", F.transform(html.hrefs(F.col("content")), lambda h: urls.parse_url(urls.absolutise(h, F.col("base")))))
    kept = found.select("fetch_id", F.posexplode(F.filter("links", lambda p: p["host"].isNotNull() & urls.is_desired(p["path"]))).alias("i", "p"))
    return kept.select("fetch_id", (F.col("i") + 1).cast("bigint").alias("pos"), "p.*")


# --- documents and text ---------------------------------------------------------------

_BODY = "content"
# what goes, in order, and what stands in its place
for _p, _r in (
    ("(?is)<!--.*?-->", ""),
    (r"(?is)<head\b.*?</head\s*>", ""),
    (r"(?is)<script\b.*?</script\s*>", ""),
    (r"(?is)<style\b.*?</style\s*>", ""),
    (r"(?is)</?(?:a|abbr|b|em|font|i|mark|small|span|strong|sub|sup|u)(?:\s[^>]*)?>", ""),
    ("(?s)<[^>]*>", " "),
):
    _BODY = f"regexp_replace({_BODY}, '{_p}', '{_r}', 'g')"
for _n, _c in html.REFERENCES.items():
    _BODY = f"replace({_BODY}, '{_n.replace(chr(39), chr(39) * 2)}', '{_c.replace(chr(39), chr(39) * 2)}')"
_BODY = rf"trim(regexp_replace({_BODY}, '[ \t\r\n\f]+', ' ', 'g'))"


@query(f"select fetch_id, {_BODY} as body from (select distinct fetch_id, content from crawl_docs where contains(lower(mime), 'html') and content is not null)")
def html_body_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "crawl_docs", "fetch_id", "mime", "content").where(F.contains(F.lower("mime"), F.lit("html")) & F.col("content").isNotNull())
    return docs.select("fetch_id", html.body_text(F.col("content")).alias("body")).distinct()


@query(r"select distinct fetch_id, regexp_replace(content, '[\p{Cc}\p{Cf}\p{Co}]', '', 'g') as content from crawl_docs where content is not null")
def control_char_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "crawl_docs", "fetch_id", "content").where("content is not null")
    return docs.select("fetch_id", html.without_controls(F.col("content")).alias("content")).distinct()


@query("select distinct fetch_id, mime from crawl_docs where contains(mime, 'text/html')")
def mime_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "crawl_docs", "fetch_id", "mime").where(F.contains("mime", F.lit("text/html"))).distinct()


@query("select distinct fetch_id, strftime(last_modified at time zone 'UTC', '%a, %d %b %Y %H:%M:%S GMT') as stamp from crawl_docs where last_modified is not null")
def http_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "crawl_docs", "fetch_id", "last_modified").where("last_modified is not null")
    return docs.select("fetch_id", http.http_date(F.col("last_modified")).alias("stamp")).distinct()


@query("select distinct fetch_id, strftime(last_modified at time zone 'UTC', '%Y-%m-%dT%H:%M:%S') as stamp from crawl_docs where last_modified is not null")
def iso_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "crawl_docs", "fetch_id", "last_modified").where("last_modified is not null")
    return docs.select("fetch_id", http.iso_time(F.col("last_modified")).alias("stamp")).distinct()


_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_TOKENS = """w0 as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) as w from documents),
tok as (select doc_id as doc, lower(w) as token, count(*) as n from w0 group by all)"""
_INDEX = f"""{_TOKENS}, kept as (select *, sum(n) over (partition by doc) as t from tok where token not in ({_STOP})),
post as materialized (select token as term, doc, cast(n as float) / cast(t as float) as tf from kept)"""


@query(f"with {_TOKENS} select doc, token, n from tok")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.term_counts(index.token_rows(table(spark, sf_dir, "documents"), "doc_id", "text"))


@query("select doc_id, cast(len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+')) as int) as tokens from documents")
def doc_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.size(text.tokens(F.col("text"))).alias("tokens"))


@query(f"with {_TOKENS} select * from tok where token not in ({_STOP})")
def stopword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(spark, sf_dir)
    return text.drop_stop_words(counts, text.default_stop_words(spark)).select("doc", "token", "n")


_STEMS = f"""{_TOKENS}, vocabulary as materialized (select distinct token from tok), {sql.stems('vocabulary')}"""
# the words that are kept, by their stems
_STEMMED = f"""{_STEMS}, kept as materialized (select tok.*, sum(n) over (partition by doc) as t from tok where token not in ({_STOP})),
post as materialized (select stem as term, doc, cast(sum(n) as float) / cast(max(t) as float) as tf from kept join stems using (token) group by stem, doc)"""


@query(f"with {_STEMS} select token, stem from stems")
def stem_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.stem_vocabulary(index.token_rows(table(spark, sf_dir, "documents"), "doc_id", "text"))


# --- index ----------------------------------------------------------------------------


def plain_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index of the documents without stems."""
    return index.build(table(spark, sf_dir, "documents"), "doc_id", "text", text.default_stop_words(spark), stems=False)


@query(f"with {_INDEX} select term, doc, tf from post")
def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_index(spark, sf_dir)


@query(f"with {_STEMMED} select term, doc, tf from post")
def inverted_index_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.build(table(spark, sf_dir, "documents"), "doc_id", "text", text.default_stop_words(spark))


@query(f"with {_INDEX} select term, count(*) as df from post group by term")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.document_frequency(plain_index(spark, sf_dir))


@query(
    f"""with {_INDEX}, b as (select *, (row_number() over (partition by term order by doc) - 1) // {index.BLOCK} as block from post)
select term, block, count(*) as n, min(doc) as first_doc, max(doc) as last_doc, round(sum(cast(tf as double)), 6) as tf from b group by term, block"""
)
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = index.posting_lists(plain_index(spark, sf_dir))
    total = F.aggregate("postings", F.lit(0.0), lambda a, p: a + p["tf"].cast("double"))
    return lists.select("term", "block", F.size("postings").cast("bigint").alias("n"), F.col("postings")[0]["doc"].alias("first_doc"), F.element_at("postings", -1)["doc"].alias("last_doc"), F.round(total, 6).alias("tf"))


@query(f"with {_INDEX} select term, count(*) as df, round(sum(cast(tf as double)), 6) as tf from post group by term")
def index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, stop = table(spark, sf_dir, "documents"), text.default_stop_words(spark)
    halves = [index.build(docs.where(F.pmod("doc_id", F.lit(2)) == k), "doc_id", "text", stop, stems=False) for k in (0, 1)]
    return index.merge(*halves).groupBy("term").agg(F.count("*").alias("df"), F.round(F.sum(F.col("tf").cast("double")), 6).alias("tf"))


_CRAWL = """c0 as (select distinct fetch_id, url, content from crawl_docs where content is not null),
c1 as (select fetch_id, url, unnest(regexp_extract_all(content, '[A-Za-z0-9]+')) as w from c0),
c2 as (select fetch_id, url, lower(w) as term, count(*) as n from c1 group by all), c3 as (select fetch_id, sum(n) as t from c2 group by fetch_id),
c4 as (select term, url as doc, fetch_id, cast(n as float) / cast(t as float) as tf from c2 join c3 using (fetch_id))"""


@query(f"with {_CRAWL} select term, doc, arg_max(tf, fetch_id) as tf from c4 group by term, doc")
def posting_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "crawl_docs", "fetch_id", "url", "content").where("content is not null").distinct()
    postings = index.build(docs, "fetch_id", "content", None, stems=False)
    named = postings.join(docs.select(F.col("fetch_id").alias("doc"), "url"), "doc")
    return index.last_wins(named.select("term", F.col("url").alias("doc"), F.col("doc").alias("seq"), "tf"), "seq")


@query(
    f"""with {_INDEX}, base as (select term, count(*) as df from post where doc % 2 = 0 group by term), fresh as (select term, count(*) as df from post where doc % 2 = 1 group by term)
select * from fresh union all select * from base where term not in (select term from fresh)"""
)
def index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings = plain_index(spark, sf_dir)
    halves = [index.document_frequency(postings.where(F.pmod("doc", F.lit(2)) == k)) for k in (0, 1)]
    return kv.put(halves[0], halves[1], "term")


@query(
    """select doc_id, case when length(text) < 1000 then text end as inline, case when length(text) >= 1000 then text end as overflow, text as info
from documents where text is not null"""
)
def posting_spill(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "documents", "doc_id", "text").where("text is not null").withColumnRenamed("text", "info")
    return index.read_routed(index.routed(items, inline=1000).select("doc_id", "inline", "overflow")).select("doc_id", "inline", "overflow", "info")


@query(f"with {_INDEX} select term, doc, tf from post")
def index_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = index.posting_lists(plain_index(spark, sf_dir))
    items = lists.select("term", index.to_json(F.col("postings")).alias("info"))
    return items.select("term", F.explode(index.from_json(F.col("info"))).alias("doc", "tf")).select("term", F.col("doc").cast("bigint").alias("doc"), "tf")


@query(f"with {_INDEX} select term, doc, tf from post")
def index_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = index.from_text(index.to_text(index.posting_lists(plain_index(spark, sf_dir))))
    return back.select("term", F.col("doc").cast("bigint").alias("doc"), "tf")


# --- search ---------------------------------------------------------------------------

#: What the search queries ask for.
ASKED = "flood warning of the museum"
_TERMS = ", ".join(f"'{w}'" for w in sorted(set(ASKED.split())))
_SCORES = f"""{_INDEX}, hits as (select * from post where term in ({_TERMS})), df as (select term, count(*) as df from hits group by term),
n as (select count(*)::double as n from documents),
scores as (select doc, sum((0.4 + 0.6 * cast(tf as double)) * ln(n.n / df.df)) as tfidf from hits join df using (term), n group by doc),
ranked as (select scores.doc, tfidf, coalesce(r.rank, 1.0) as rank,
  case when tfidf = 0 or coalesce(r.rank, 1.0) = 0 then 0.0 else 1 / (0.99 / tfidf + 0.01 / coalesce(r.rank, 1.0)) end as harmonic
  from scores left join (select doc_id, 1.0 + doc_id % 7 as rank from documents where doc_id % 2 = 0) r on r.doc_id = scores.doc)"""


def stored_index(spark: SparkSession, sf_dir: str, stems: bool = False) -> DataFrame:
    """The index of the documents, built and stored at its first use; searches read it."""

    def make(path: str) -> None:
        built = index.build(table(spark, sf_dir, "documents"), "doc_id", "text", text.default_stop_words(spark), stems=stems)
        index.store(built, path)

    return spark.read.parquet(lineage.kept(spark, f"index {stems} {sf_dir}", make))


def scores(spark: SparkSession, sf_dir: str, stems: bool = False) -> DataFrame:
    """Scores of the documents for what is asked."""
    n = table(spark, sf_dir, "documents", "doc_id").count()
    return search.tfidf(stored_index(spark, sf_dir, stems), search.query_terms(spark, ASKED, stems=stems), n)


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores blended with ranks that half of the documents have."""
    own = table(spark, sf_dir, "documents", "doc_id").where(F.pmod("doc_id", F.lit(2)) == 0)
    ranks = own.select(F.col("doc_id").alias("doc"), (F.lit(1.0) + F.pmod("doc_id", F.lit(7))).alias("rank"))
    return search.blend(scores(spark, sf_dir), ranks)


@query(f"with {_SCORES} select doc, round(tfidf, 9) as tfidf from scores")
def tfidf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).select("doc", F.round("tfidf", 9).alias("tfidf"))


_SCORES_STEMMED = _STEMMED + _SCORES[len(_INDEX) :].replace(f"term in ({_TERMS})", f"term in (select stem from stems where token in ({_TERMS}))")


@query(f"with {_SCORES_STEMMED} select doc, round(tfidf, 9) as tfidf from scores")
def tfidf_search_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir, stems=True).select("doc", F.round("tfidf", 9).alias("tfidf"))


@query(f"with {_SCORES} select doc, round(tfidf, 9) as tfidf, rank, round(harmonic, 9) as harmonic from ranked")
def hybrid_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark, sf_dir).select("doc", F.round("tfidf", 9).alias("tfidf"), "rank", F.round("harmonic", 9).alias("harmonic"))


@query(f"with {_SCORES} select doc, round(harmonic, 9) as harmonic from ranked order by ranked.harmonic desc, doc limit 10 offset 10")
def search_page_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.shown(ranked(spark, sf_dir), 2).select("doc", F.round("harmonic", 9).alias("harmonic"))


@query(
    f"""with {_SCORES}, number as (select count(*) as n from ranked), a as (select unnest([-1, 1, 2, 3, 1000000]) as asked),
b as (select asked, cast(case when asked < 1 or n < (asked - 1) * 10 then 1 else asked end as bigint) as page, n from a, number),
back as (select *, greatest(0, least(10, n - (page - 1) * 10)) as returned from b)
select asked, page, page = 1 as "first", returned <> 10 as "last", returned from back"""
)
def search_page_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = lineage.materialise(ranked(spark, sf_dir))
    rows = []
    for asked in (-1, 1, 2, 3, 1_000_000):
        number = search.page_number(asked, hits.count())
        returned = search.page(hits, number).count()
        rows.append((asked, number, *search.flags(number, returned), returned))
    return spark.createDataFrame(rows, "asked int, page bigint, first boolean, last boolean, returned bigint")


@query(f"with {_SCORES} select doc, left(text, 70) || '...' as snippet from (select doc from ranked order by harmonic desc, doc limit 10) join documents on doc_id = doc")
def search_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.shown(ranked(spark, sf_dir), 10_000_000)  # too high a page shows the first
    docs = table(spark, sf_dir, "documents", F.col("doc_id").alias("doc"), "text")
    return docs.join(F.broadcast(hits.select("doc")), "doc").select("doc", html.snippet(F.col("text")).alias("snippet"))  # ten rows


# --- links and ranks --------------------------------------------------------------------


def _edges_of(rows: str) -> str:
    """SQL for the edges of rows ``(src, dest)``: places of commas with an even number of quotes behind them, and what lies between."""
    return f"""r as (select distinct src, dest from ({rows}) where src is not null and dest is not null),
c as (select src, dest, unnest(generate_series(1, length(dest))) as p from r),
k as (select src, dest, p from c where substr(dest, p, 1) = ',' and (length(substr(dest, p + 1)) - length(replace(substr(dest, p + 1), '"', ''))) % 2 = 0 union all select src, dest, 0 from r),
e as (select src, dest, p, coalesce(lead(p) over (partition by src, dest order by p), length(dest) + 1) as q from k)
select distinct src, substr(dest, p + 1, q - p - 1) as dst from e"""


@query(f"with {_edges_of('select url as src, dest from link_lines')}")
def edge_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkgraph.edges(table(spark, sf_dir, "link_lines", "url", "dest"))


@query(f"""with {_edges_of("select split_part(line, '|', 1) as src, split_part(line, '|', 2) as dest from (select url || coalesce('|' || dest, '') as line from link_lines)")}""")
def adjacency_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "link_lines", "url", "dest").select(F.concat("url", F.coalesce(F.concat(F.lit("|"), "dest"), F.lit(""))).alias("value"))
    return linkgraph.edges(linkgraph.adjacency(lines))


@query(
    f"""with r as (select url as src, dest, edge_id, (row_number() over (partition by url order by edge_id, dest) - 1) // {linkgraph.LINKS} as part
  from link_edges where url is not null and dest is not null)
select src, part, string_agg(dest, ',' order by edge_id) as dests from r group by src, part"""
)
def outlink_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkgraph.link_lists(table(spark, sf_dir, "link_edges"), "url", "dest", "edge_id")


def edge_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct edges of the link table; an empty target is one."""
    rows = table(spark, sf_dir, "link_edges", F.col("url").alias("src"), F.col("dest").alias("dst"))
    return rows.where("src is not null and dst is not null").distinct()


_EDGES = """e as (select distinct url as src, dest as dst from link_edges where url is not null and dest is not null),
s as (select src, 1.0::double / count(*) as share from e group by src), l as (select e.src, e.dst, s.share from e join s using (src) where e.dst in (select src from s))"""


@query(f"with {_EDGES} select (select count(*) from s) as sources, (select count(*) from e) as edges, (select count(*) from l) as inner_edges")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkgraph.graph_stats(edge_table(spark, sf_dir))


@query(f"with {_EDGES} select src as url, round(0.15 + 0.85 * coalesce(x, 0), 9) as rank from s left join (select dst, sum(share) as x from l group by dst) t on t.dst = s.src")
def pagerank_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edge_table(spark, sf_dir)
    ranks = e.select(F.col("src").alias("url")).distinct().withColumn("rank", F.lit(1.0))
    return pagerank.step(pagerank.weighted(e), ranks, 1.0).select("url", F.round("rank", 9).alias("rank"))


@query(
    f"""with recursive {_EDGES}, r as (select 0 as k, src as url, 1.0::double as rank from s
union all select k + 1, url, x * count(*) over () / sum(x) over () from (
  select k, url, 0.15 + 0.85 * sum(part) as x from (
    select r.k, l.dst as url, r.rank * l.share as part from r join l on l.src = r.url where r.k < 30
    union all select k, url, 0.0 from r where k < 30) group by k, url))
select url, round(rank, 6) as rank from r where k = 30"""
)
def pagerank_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagerank.pagerank(edge_table(spark, sf_dir)).select("url", F.round("rank", 6).alias("rank"))


@query(
    """select split_part(url, ',', 1) as url, case when contains(url, ',') then coalesce(try_cast(split_part(url, ',', 2) as double), 1.0) else coalesce(rank, 1.0) end as rank
from page_ranks where url is not null"""
)
def rank_readback(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = table(spark, sf_dir, "page_ranks").where("url is not null")
    lines = sinks.rank_text(ranks.withColumn("rank", F.coalesce(F.col("rank").cast("string"), F.lit("none"))))
    return files.rank_lines(lines)


# --- crawl ------------------------------------------------------------------------------


@query("select dest as url, count(*) as n from link_edges where dest is not null and dest not in (select url from crawl_docs where url is not null) group by dest")
def url_seen_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "link_edges", F.col("dest").alias("url")).where("url is not null")
    return crawl.unseen(found.groupBy("url").agg(F.count("*").alias("n")), table(spark, sf_dir, "crawl_docs", "url"))


@query("select dest as url, count(*) as n from link_edges where dest in (select url from crawl_docs) group by dest")
def url_seen_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "link_edges", F.col("dest").alias("url")).where("url is not null")
    return crawl.known(found.groupBy("url").agg(F.count("*").alias("n")), table(spark, sf_dir, "crawl_docs", "url"))


_ROBOTS = sql.robots("silkmoth")
_GATE = _URL.format(key="fetch_id, url", col="url", t="(select distinct fetch_id, url from crawl_docs)")


@query(
    f"""with {_ROBOTS}, {_GATE}, g as (select fetch_id, url, host || ':' || port as host_port, path from u2 union all
  select distinct fetch_id, url, null, null from crawl_docs where url is null or not (regexp_matches(trim(url), '^https?://') and length(trim(url)) >= 8))
select fetch_id, url, g.host_port, coalesce(delay_ms, 5000) as delay_ms,
  case when path is null then false else coalesce(len(list_filter(disallow, lambda x: starts_with(path, x))), 0) = 0 end as allowed
from g left join rules on rules.host_port = g.host_port"""
)
def robots_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = table(spark, sf_dir, "robots_rules").select("host_port", robots(F.col("body")).alias("rules"))
    return crawl.gate(table(spark, sf_dir, "crawl_docs", "fetch_id", "url"), rules).distinct()


@query(f"with {_ROBOTS} select host_port, disallow, delay_ms, specific from rules")
def robots_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "robots_rules").select("host_port", robots(F.col("body")).alias("rules")).select("host_port", "rules.*")


@query(
    """select event_id, case when status >= 400 then 'error' when status = 304 then 'not_modified' when status >= 300 and location is not null then 'redirect'
when status >= 300 then 'error' when coalesce(length <= 1000000, true) and contains(coalesce(kind, ''), 'text/html') then kind else 'undesired' end as outcome
from (select event_id, [200, 301, 304, 404, 503, 302][1 + event_id % 6] as status, case when event_id % 4 < 2 then 'http://b/' end as location,
  cast(event_id % 5 as bigint) * 400000 as length, ['text/html', 'image/png', 'text/html; charset=utf-8', null][1 + event_id % 4] as kind from events)"""
)
def head_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")

    def pick(*values):
        return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(e, F.lit(len(values))).cast("int"))

    location = F.when(F.pmod(e, F.lit(4)) < 2, F.lit("http://b/"))
    kind = pick("text/html", "image/png", "text/html; charset=utf-8", None)
    outcome = http.head_outcome(pick(200, 301, 304, 404, 503, 302), location, F.pmod(e, F.lit(5)) * 400_000, kind, 1_000_000)
    return table(spark, sf_dir, "events", "event_id").select("event_id", outcome.alias("outcome"))


@query(
    """select edge_id, case when url is null or dest is null then [] when starts_with(url, 'https') then [trim(dest || ', ' || url)]
  else list_transform(string_split(dest || ', ' || url, ','), lambda x: trim(x)) end as targets from link_edges"""
)
def redirect_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "link_edges", "edge_id", "url", "dest")
    secure = F.coalesce(F.startswith("url", F.lit("https")), F.lit(False))
    return rows.select("edge_id", http.redirect_targets(F.concat("dest", F.lit(", "), "url"), secure).alias("targets"))


@query(
    """with r as (select *, row_number() over (partition by user_id order by ts, event_id) as i from events where user_id is not null and ts is not null),
v as (select *, max(epoch_us(ts) - i * 3600000000) over (partition by user_id order by i) as m from r)
select event_id, user_id, make_timestamp(i * 3600000000 + m) as start from v"""
)
def politeness_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events", "event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return crawl.schedule(rows, "user_id", "ts", "event_id", 3600).select("event_id", "user_id", F.col("start").cast("timestamp_ntz").alias("start"))


@query("select event_id, event_type from events order by event_id limit 100")
def budget_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.within_budget(table(spark, sf_dir, "events", "event_id", "event_type"), "event_id", 100)


@query(
    """with seen as (select distinct url from crawl_docs where url is not null), f as (select edge_id as seq, dest as url from link_edges where dest is not null),
take as (select seq, url from f where url not in (select url from seen) order by seq limit 50)
select seq, url from f where url not in (select url from seen) and url not in (select url from take)"""
)
def frontier_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    front = table(spark, sf_dir, "link_edges", F.col("edge_id").alias("seq"), F.col("dest").alias("url")).where("url is not null")
    seen = table(spark, sf_dir, "crawl_docs", "url").where("url is not null").distinct()
    return crawl.frontier_step(front, seen, front.limit(0), 50)[1]


# --- streams ----------------------------------------------------------------------------


@query("select event_id as seq, event_type as word, cast(row_number() over (partition by event_type order by event_id) as varchar) as count from events where event_type is not null")
def running_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.running_count(table(spark, sf_dir, "events"), "event_type", "event_id").select("seq", "word", "count")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files."""
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path if spark._jvm.java.io.File(path).isDirectory() else f"{path}*")


@query("select event_type as word, count(*) as count from events group by event_type")
def stream_wordcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    words = event_stream(spark, sf_dir).select(F.col("event_type").alias("word"))
    plan = topology.Topology(words).fields("count", topology.word_counts, 4, "word").plan()
    return topology.run_to_table(plan, f"words-{uuid.uuid4().hex}")


@query("select event_type as word, cast(row_number() over (partition by event_type order by event_id) as varchar) as count from events where event_type is not null")
def stream_running_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    plan = topology.counted(event_stream(spark, sf_dir), "event_type")
    return topology.run_to_table(plan, f"counts-{uuid.uuid4().hex}", "append").select("word", "count")


@query(
    """with r as (select *, row_number() over (partition by user_id order by ts, event_id) as i from events where user_id is not null and ts is not null),
v as (select *, max(epoch_us(ts) - i * 3600000000) over (partition by user_id order by i) as m from r)
select event_id, user_id, make_timestamp(i * 3600000000 + m) as start from v"""
)
def stream_politeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    plan = topology.polite(event_stream(spark, sf_dir), "user_id", "ts", "event_id", 3600)
    return topology.run_to_table(plan, f"polite-{uuid.uuid4().hex}", "append").select("event_id", "user_id", F.col("start").cast("timestamp_ntz").alias("start"))


_CHAIN = f"""with {_ROBOTS}, pages as (select distinct fetch_id, url from crawl_docs where contains(mime, 'text/html') and content is not null),
asked as (select distinct dest as url from link_edges), {_URL.format(key='url', col='url', t='asked')},
allowed as (select distinct url from u2 left join rules on rules.host_port = host || ':' || port
  where coalesce(len(list_filter(disallow, lambda x: starts_with(path, x))), 0) = 0),
got as (select distinct fetch_id from pages join allowed using (url)),
l as (select fetch_id, unnest(links) as x from parsed_links where fetch_id in (select fetch_id from got)),
fresh as (select distinct x.protocol || '://' || x.host || ':' || x.port || x.path as url from l)
select url from fresh where url not in (select url from crawl_docs where url is not null)"""


@query(_CHAIN)
def stream_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain over the link targets as a stream, with the fetches that ``parsed_links`` knows the links of."""
    import uuid

    path = f"{sf_dir.rstrip('/')}/link_edges.parquet"
    urls_ = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path if spark._jvm.java.io.File(path).isDirectory() else f"{path}*")
    pages = table(spark, sf_dir, "crawl_docs", "fetch_id", "url", "mime", "content").where(F.contains("mime", F.lit("text/html")) & F.col("content").isNotNull())
    known = table(spark, sf_dir, "parsed_links", "fetch_id", "links").where("links is not null").select("fetch_id")
    rules = table(spark, sf_dir, "robots_rules").select("host_port", robots(F.col("body")).alias("rules"))

    def links(docs: DataFrame) -> DataFrame:
        return page_links(docs).select("fetch_id", "pos", urls.normalize(F.struct("protocol", "host", "port", "path")).alias("url"))

    seen = table(spark, sf_dir, "crawl_docs", "url").where("url is not null")
    frontier = urls_.select(F.col("edge_id").alias("seq"), F.col("dest").alias("url")).where("url is not null")
    chain = topology.crawl_chain(frontier, rules, pages.join(known, "fetch_id", "left_semi").distinct(), seen, links)
    return topology.run_to_table(chain.plan(), f"crawl-{uuid.uuid4().hex}", "append").select("url")


@query("select distinct user_id from events")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    plan = topology.seen_once(event_stream(spark, sf_dir).select("user_id"), "user_id")
    return topology.run_to_table(plan, f"seen-{uuid.uuid4().hex}", "append").select("user_id")


@query("select event_id, cast(event_id % 4 as int) as instance from events")
def router_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.round_robin(table(spark, sf_dir, "events", "event_id"), "event_id", 4)


@query("select event_type, 1::bigint as instances from events group by event_type")
def router_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = topology.by_fields(table(spark, sf_dir, "events", "event_type"), 4, "event_type")
    return placed.groupBy("event_type").agg(F.countDistinct("instance").alias("instances"))


# --- keyed tables -----------------------------------------------------------------------


@query("select * from customer where c_custkey in (select o_custkey from orders where o_totalprice > 200000)")
def kv_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return kv.lookup(table(spark, sf_dir, "customer"), keys, "c_custkey")


@query("select c_name from customer order by c_name")
def kv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.scan(table(spark, sf_dir, "customer"), "c_name")


@query("select * from customer where c_nationkey <> 3 union all select c_custkey, c_name, 3, 0.0, 'NONE' from customer where c_nationkey = 3")
def kv_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = table(spark, sf_dir, "customer")
    fresh = store.where("c_nationkey = 3").withColumn("c_acctbal", F.lit(0.0)).withColumn("c_mktsegment", F.lit("NONE"))
    return kv.put(store, fresh, "c_custkey")


@query("select * from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 300000)")
def kv_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return kv.delete(table(spark, sf_dir, "customer"), keys, "c_custkey")


@query("select c_custkey, exists(select 1 from orders where o_custkey = c_custkey) as subscribed from customer")
def subscribe_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders", F.col("o_custkey").alias("c_custkey"))
    return kv.flagged(table(spark, sf_dir, "customer", "c_custkey"), own, "c_custkey")


@query("select n_name, c_custkey, c_name from nation join customer on c_nationkey = n_nationkey")
def channel_show(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    lists = customers.groupBy("c_nationkey").agg(F.collect_set("c_custkey").alias("docs"))  # a channel's list is one value
    channels = table(spark, sf_dir, "nation").join(lists, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "docs")
    return kv.show(channels, customers.select("c_custkey", "c_name"), "docs", "c_custkey")


@query("select c_custkey, sha256(c_name) as hash from customer")
def password_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", kv.password_hash(F.col("c_name")).alias("hash"))


# --- small languages --------------------------------------------------------------------

_PATHS = ["/a/b", '/a / b[ text() = "x y" ]', '/a[contains(text(),"z")][@id="1"]/c', "/a[b]", "//a", "a/b", "/a/", '/a[@href="x/y"]', "/a["]
_PATHS_SQL = "(values " + ", ".join(f"('{p}')" for p in _PATHS) + ") as t(path)"


# a step at a time: names between slashes, each with tests that quote no slash or bracket
_STRIPPED = """s0 as (select path, unnest(generate_series(1, length(path))) as i from {t}),
s1 as (select path, i, substr(path, i, 1) as c, (length(left(path, i)) - length(replace(left(path, i), '"', ''))) % 2 = 1 as quoted from s0),
s2 as (select path, string_agg(c, '' order by i) as p from s1 where c <> ' ' or quoted group by path)"""
_NAME_TESTS = r'[A-Za-z0-9]+(\[(text\(\)="[^"/\[\]]*"|contains\(text\(\),"[^"/\[\]]*"\)|@[A-Za-z0-9]+="[^"/\[\]]*")\])*'


@query(f"with {_STRIPPED.format(t=_PATHS_SQL)} select path, p[1] = '/' and len(list_filter(string_split(p[2:], '/'), lambda x: not regexp_full_match(x, '{_NAME_TESTS}'))) = 0 as valid from s2")
def xpath_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(p,) for p in _PATHS], "path string").select("path", xpath.is_valid(F.col("path")).alias("valid"))


@query(f"select path, regexp_extract_all(path, '[/\\[\\]]|[^/\\[\\]]+') as parts from {_PATHS_SQL}")
def xpath_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(p,) for p in _PATHS], "path string").select("path", xpath.tokenise(F.col("path")).alias("parts"))


@query(f"with {_STRIPPED.format(t=_PATHS_SQL)} select path, p as stripped from s2")
def xpath_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(p,) for p in _PATHS], "path string").select("path", xpath.strip_blanks(F.col("path")).alias("stripped"))


def queries() -> dict[str, Query]:
    """Name -> query, for the entry point."""
    return dict(_QUERIES)
