"""The registered queries over the driver's tables, each with its SQL. Inputs that the tables lack (markup) are built from their
columns by the same expression on both sides. All queries read whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.functions import coords, markup, text
from tidegraph.operators import category, charts, ordering, resolve, search
from tidegraph.operators.pagerank import pagerank
from tidegraph.operators.storage import stored
from tidegraph.sources import readers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# graph of trade: customers point to the parts they ordered, parts to their suppliers, suppliers to nations; nations dangle

EDGE_SQL = """
edges AS (
  SELECT o_custkey * 4 AS src, l_partkey * 4 + 1 AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION SELECT l_partkey * 4 + 1, l_suppkey * 4 + 2 FROM lineitem
  UNION SELECT s_suppkey * 4 + 2, CAST(s_nationkey AS BIGINT) * 4 + 3 FROM supplier),
vertices AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges)"""
RANK_SQL = f"""
WITH RECURSIVE {EDGE_SQL},
n AS (SELECT count(*) AS n FROM vertices), deg AS (SELECT src, count(*) AS d FROM edges GROUP BY src),
pr(it, id, rank, delta) AS (
  SELECT 0, id, 1.0::DOUBLE / n, 1e308::DOUBLE FROM vertices, n
  UNION ALL
  SELECT it, id, rank, sum(abs(rank - before)) OVER () FROM (
    SELECT p.it + 1 AS it, p.id, coalesce(c.raw, 0) + (1 - sum(coalesce(c.raw, 0)) OVER ()) / n.n AS rank, p.rank AS before
    FROM pr p CROSS JOIN n LEFT JOIN (SELECT e.dst, sum(0.85 * q.rank / deg.d) AS raw FROM edges e JOIN pr q ON q.id = e.src JOIN deg ON deg.src = e.src GROUP BY e.dst) c ON c.dst = p.id
    WHERE p.delta > 0.0001)),
ranks AS (SELECT id, rank FROM pr WHERE it = (SELECT max(it) FROM pr))"""


def trade_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges, each once for every row that has it."""
    items, orders, suppliers = (t(spark, sf_dir, n) for n in ("lineitem", "orders", "supplier"))
    bought = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("o_custkey") * 4).alias("src"), (F.col("l_partkey") * 4 + 1).alias("dst"))
    made = items.select((F.col("l_partkey") * 4 + 1).alias("src"), (F.col("l_suppkey") * 4 + 2).alias("dst"))
    home = suppliers.select((F.col("s_suppkey") * 4 + 2).alias("src"), (F.col("s_nationkey").cast("long") * 4 + 3).alias("dst"))
    return bought.union(made).union(home)


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trade_links(spark, sf_dir).distinct()


def trade_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagerank(None, trade_links(spark, sf_dir), repeated=True)


@query(RANK_SQL + " SELECT id, round(rank, 8) AS rank FROM ranks")
def pagerank_edges(spark, sf_dir):
    return trade_ranks(spark, sf_dir).select("id", F.round("rank", 8).alias("rank"))


@query(RANK_SQL + ' SELECT id, round(round(rank, 10), 8) AS rank, row_number() OVER (ORDER BY round(rank, 10) DESC, id) AS "order" FROM ranks QUALIFY "order" <= 100')
def pagerank_topk_order(spark, sf_dir):
    ranked = trade_ranks(spark, sf_dir).withColumn("rank", F.round("rank", 10))
    return ordering.leading(ranked, 100, [F.desc("rank"), F.asc("id")], "order").select("id", F.round("rank", 8).alias("rank"), "order")


@query("SELECT DISTINCT l_partkey % 100 AS src, l_suppkey AS dst FROM lineitem WHERE l_partkey % 100 <> l_suppkey")
def edge_dedupe_selfloop(spark, sf_dir):
    return resolve.edges_of(t(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 100).alias("src"), F.col("l_suppkey").alias("dst")))


@query("SELECT l_partkey % 100 AS src, l_suppkey AS dst, count(*) AS count FROM lineitem WHERE l_partkey % 100 <> l_suppkey GROUP BY ALL")
def link_counts(spark, sf_dir):
    return resolve.counted_edges(t(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 100).alias("src"), F.col("l_suppkey").alias("dst"), F.lit(1).alias("count")))


@query(f"WITH {EDGE_SQL} SELECT src, count(*) AS outdegree FROM edges GROUP BY src")
def outdegree(spark, sf_dir):
    return trade_edges(spark, sf_dir).groupBy("src").agg(F.count(F.lit(1)).alias("outdegree"))


@query(rf"""SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '{readers.ANCHOR}', 1)) AS href, unnest(regexp_extract_all(html, '{readers.ANCHOR}', 2)) AS body FROM pages)
  WHERE starts_with(href, '/') AND trim(regexp_replace(body, '(?s)<[^>]*>', '', 'g')) <> '' GROUP BY ALL""")
def html_links(spark, sf_dir):
    links = t(spark, sf_dir, "pages").select("page_id", F.explode(readers.anchors(F.col("html"), "/")).alias("a"))
    return links.groupBy("page_id", F.col("a.href").alias("href")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT page_id, title FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'File:' WHEN 1 THEN 'MediaWiki:' WHEN 2 THEN 'Lists of ' WHEN 3 THEN '' ELSE 'User Talk:' END || url AS title FROM pages)
  WHERE NOT regexp_matches(title, '^({"|".join(readers.NAMESPACES)}):') AND NOT regexp_matches(title, '{readers.NOT_FILMS}')""")
def html_title_filter(spark, sf_dir):
    k = F.col("page_id") % 5
    kind = F.when(k == 0, "File:").when(k == 1, "MediaWiki:").when(k == 2, "Lists of ").when(k == 3, "").otherwise("User Talk:")
    titles = t(spark, sf_dir, "pages").select("page_id", F.concat(kind, "url").alias("title"))
    return readers.film_titles(titles.where(readers.is_article_title(F.col("title"))))


MARKUP_SQL = "'[[' || p_brand || '#s|' || p_name || ']] [[' || p_type || ']] [[|' || p_brand || ']] [[' || p_brand || '|x]]<!-- [[lost]] -->'"


@query(rf"""SELECT p_partkey, title, count(*) AS count FROM (SELECT p_partkey, CASE WHEN g1 IS NULL OR g1 = '' THEN g2 ELSE regexp_extract(g1, '^[^#]*') END AS title FROM (
  SELECT p_partkey, unnest(regexp_extract_all(m, '{markup.LINK}', 1)) AS g1, unnest(regexp_extract_all(m, '{markup.LINK}', 2)) AS g2
  FROM (SELECT p_partkey, regexp_replace({MARKUP_SQL}, '<!--(.*?)-->', '', 'g') AS m FROM part))) GROUP BY ALL""")
def wikilink_extract(spark, sf_dir):
    page = F.format_string("[[%s#s|%s]] [[%s]] [[|%s]] [[%s|x]]<!-- [[lost]] -->", "p_brand", "p_name", "p_type", "p_brand", "p_brand")
    links = t(spark, sf_dir, "part").select("p_partkey", F.explode(markup.text_links(markup.without_comments(page))).alias("l"))
    return links.select("p_partkey", F.col("l.article_title").alias("title"), F.col("l.count").cast("long").alias("count"))


@query(r"SELECT doc_id, md5(regexp_replace('<!-- ' || source || ' -->' || text || '<!--' || lang || '-->', '<!--(.*?)-->', '', 'g')) AS digest FROM documents")
def comment_strip(spark, sf_dir):
    whole = F.concat(F.lit("<!-- "), "source", F.lit(" -->"), "text", F.lit("<!--"), "lang", F.lit("-->"))
    return t(spark, sf_dir, "documents").select("doc_id", F.md5(markup.without_comments(whole)).alias("digest"))


@query("SELECT c_custkey, 'de' AS language, c_mktsegment AS title FROM customer UNION ALL SELECT c_custkey, 'fr', c_name FROM customer")
def lang_titles(spark, sf_dir):
    page = F.format_string("[[de:%s]] x [[fr:%s]] [[pl:%s]] [[de:%s]]", "c_name", "c_name", "c_name", "c_mktsegment")
    return t(spark, sf_dir, "customer").select("c_custkey", F.explode(markup.language_titles(page)).alias("language", "title"))


def nation_pages(spark, sf_dir):
    """Nations redirect to regions, which are articles; regions have larger ids."""
    nations = t(spark, sf_dir, "nation").join(t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    redirects = nations.select(F.concat(F.lit("N"), "n_name").alias("title"), F.col("n_nationkey").cast("long").alias("id"), F.col("r_name").alias("redirect_to"))
    return redirects.union(t(spark, sf_dir, "region").select("r_name", F.col("r_regionkey").cast("long") + 1000, F.lit(None).cast("string")))


@query("""SELECT c_custkey AS src, CAST(n_regionkey AS BIGINT) + 1000 AS dst, 1 AS count FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def redirect_single_hop(spark, sf_dir):
    pages = nation_pages(spark, sf_dir)
    links = t(spark, sf_dir, "customer").join(t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("src"), F.concat(F.lit("N"), "n_name").alias("title"), F.lit(1).alias("count"))
    return resolve.resolve_links(links, resolve.redirect_map(pages), resolve.title_ids(pages))


@query("""WITH RECURSIVE up(title, target) AS (SELECT p_partkey, p_partkey // 10 FROM part WHERE p_partkey >= 10 UNION ALL SELECT title, target // 10 FROM up WHERE target >= 10)
  SELECT CAST(title AS VARCHAR) AS title, CAST(target AS VARCHAR) AS target FROM up WHERE target < 10""")
def redirect_transitive(spark, sf_dir):
    key = F.col("p_partkey")
    pages = t(spark, sf_dir, "part").select(key.cast("string").alias("title"), key.alias("id"), F.when(key >= 10, F.concat(F.floor(key / 10).cast("string"), F.lit("#part"))).alias("redirect_to"))
    # a cycle of five and redirects that lead to it, which have no end
    cycle = t(spark, sf_dir, "region").select(F.concat(F.lit("x"), "r_regionkey"), F.lit(0).cast("long"), F.concat(F.lit("x"), (F.col("r_regionkey") + 1) % 5))
    lost = t(spark, sf_dir, "nation").select(F.concat(F.lit("y"), "n_nationkey"), F.lit(0).cast("long"), F.concat(F.lit("x"), F.col("n_regionkey")))
    return resolve.redirect_map(pages.union(cycle).union(lost), transitive=True, strip_section=True)


@query("SELECT DISTINCT CAST(n_regionkey AS BIGINT) + 1000 AS src, CAST((n_regionkey + 1) % 5 AS BIGINT) + 1000 AS dst FROM nation")
def redirect_own_links(spark, sf_dir):
    """Links of redirect pages, each to itself and to the region behind its own, as links of the articles that they lead to."""
    after = t(spark, sf_dir, "region").select(((F.col("r_regionkey") + 4) % 5).alias("n_regionkey"), F.col("r_name").alias("next"))
    own = t(spark, sf_dir, "nation").join(after, "n_regionkey").select(F.concat(F.lit("N"), "n_name").alias("title"), "next")
    link = lambda c: F.struct(F.col(c).alias("article_title"), F.lit(1).alias("count"))
    pages = nation_pages(spark, sf_dir).join(own, "title", "left")
    pages = pages.withColumn("text_links", F.when(F.col("next").isNotNull(), F.array(link("title"), link("next"))).otherwise(F.array().cast("array<struct<article_title:string,count:int>>")))
    return resolve.build_graph(pages, redirect_links=True)[1]


@query("SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return resolve.repeated_ids(t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id")))


@query("SELECT r_name AS title, string_agg('N' || n_name, '|' ORDER BY n_name) AS aliases FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def alias_collect(spark, sf_dir):
    pages = nation_pages(spark, sf_dir)
    merged = resolve.with_aliases(pages.where(~resolve.is_redirect()), resolve.redirect_map(pages))
    return merged.where(F.size("aliases") > 0).select("title", F.array_join("aliases", "|").alias("aliases"))


@query("""SELECT s_suppkey, round(CASE WHEN s_suppkey % 2 = 0 THEN -1 ELSE 1 END * (s_suppkey % 90 + (s_suppkey % 60) / 60.0 + (s_nationkey % 60) / 3600.0), 6) AS lat,
  round(CASE WHEN s_suppkey % 3 = 0 THEN -1 ELSE 1 END * (s_suppkey % 180 + (s_nationkey % 60) / 60.0), 6) AS long FROM supplier""")
def coord_dms(spark, sf_dir):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    s = lambda c: c.cast("string")
    c = coords.decimal_degrees((s(k % 90), s(k % 60), s(n % 60), F.when(k % 2 == 0, "S").otherwise("N")), (s(k % 180), s(n % 60), F.lit(""), F.when(k % 3 == 0, "W").otherwise("E")))
    return t(spark, sf_dir, "supplier").select("s_suppkey", c.alias("c")).select("s_suppkey", F.round("c.lat", 6).alias("lat"), F.round("c.long", 6).alias("long"))


@query("""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN a WHEN 1 THEN -a WHEN 2 THEN round(a + 30 / 60.0, 6) WHEN 3 THEN round(-(a + 30 / 60.0 + 36 / 3600.0), 6) END AS lat,
  CASE c_custkey % 6 WHEN 0 THEN b WHEN 1 THEN b WHEN 2 THEN round(-(b + 15 / 60.0), 6) WHEN 3 THEN round(b + 15 / 60.0 + 18 / 3600.0, 6) END AS long
  FROM (SELECT c_custkey, CAST(c_custkey % 80 AS DOUBLE) AS a, CAST(c_custkey % 170 AS DOUBLE) AS b FROM customer)""")
def coord_template(spark, sf_dir):
    k = F.col("c_custkey")
    a, b = (k % 80).cast("string"), (k % 170).cast("string")
    forms = ["{{coord|%s|%s|display=title}}", "{{Coord|%s|S|%s|E|title}}", "x {{coord|%s|30|N|%s|15|W|type:city|display=title}}", "{{coord|%s|30|36|S|%s|15|18|E|display=title}} {{coord|1|1|title}}", "{{coord|%s|%s}}", "{{coord|%s|2|%s|display=title}}"]
    form = F.lit(None).cast("string")
    for i, f in enumerate(forms):
        form = F.when(k % 6 == i, F.format_string(f, a, b)).otherwise(form)
    c = coords.from_text(form)
    return t(spark, sf_dir, "customer").select("c_custkey", c.alias("c")).select("c_custkey", F.round("c.lat", 6).alias("lat"), F.round("c.long", 6).alias("long"))


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN -(s_suppkey % 90 + 0.5) WHEN 1 THEN CAST(s_suppkey % 80 AS DOUBLE) END AS lat,
  CASE s_suppkey % 3 WHEN 0 THEN -CAST(s_suppkey % 180 AS DOUBLE) WHEN 1 THEN CAST(s_nationkey AS DOUBLE) END AS long FROM supplier""")
def coord_infobox_raw(spark, sf_dir):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    fields = F.format_string("{{Infobox x\n| LatD = %s\n|latm = 30 | latNS = S\n| longd = %s\n|longEW = W}}", (k % 90).cast("string"), (k % 180).cast("string"))
    page = F.when(k % 3 == 0, fields).when(k % 3 == 1, F.format_string("{{Infobox x\n|coord ={{Coord|%s|%s}}\n| latd = 1}}", (k % 80).cast("string"), n.cast("string"))).otherwise("{{Infobox x\n| latd =5\n| longd = 6}}")
    return t(spark, sf_dir, "supplier").select("s_suppkey", coords.coordinate_raw(page).alias("c")).select("s_suppkey", "c.lat", "c.long")


@query("SELECT p_partkey, 'film' AS kind, p_name AS name, p_brand AS brand, '[[' || p_type || '|x]]' AS type, 'http://x/?q=' AS url, CAST(p_size AS VARCHAR) AS sum FROM part")
def infobox_attrs(spark, sf_dir):
    page = F.format_string("lead {{Infobox film\n| name = %s\n| brand = %s\n|type=[[%s|x]]\n| url = http://x/?q=\n| sum = a=b=%s\n| empty =\n}} tail | name = no", "p_name", "p_brand", "p_type", "p_size")
    box = t(spark, sf_dir, "part").select("p_partkey", markup.infobox(page).alias("b"))
    one = lambda *k: markup.first_of(F.col("b.attributes"), k)
    return box.select("p_partkey", F.col("b.infobox_type").alias("kind"), one("title", "name").alias("name"), one("brand").alias("brand"), one("type").alias("type"), one("url").alias("url"), one("sum").alias("sum"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE year(o_orderdate) END AS release_year FROM orders")
def release_year(spark, sf_dir):
    page = F.when(F.col("o_orderkey") % 3 == 0, F.lit("| released = soon\n| x = 1999")).otherwise(F.format_string("| released = {{Film date|%s|01}}\n| runtime = 1234", F.year("o_orderdate").cast("string")))
    return t(spark, sf_dir, "orders").select("o_orderkey", markup.release_year(page).alias("release_year"))


# categories: parts as ranked pages (title name, alias brand, rank price), a list of brands in either case

BRANDS = ["Brand#11", "BRAND#12", "Brand#23", "Brand#45", "Nope", "nope"]
BRAND_SQL = "(VALUES " + ", ".join(f"('{b}')" for b in BRANDS) + ") AS list(title)"


def part_pages(spark, sf_dir):
    return t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.array("p_brand").alias("aliases"), F.col("p_retailprice").alias("rank"))


def brand_list(spark):
    return spark.createDataFrame([(b,) for b in BRANDS], "title string")


@query(f"SELECT p_partkey AS id FROM part WHERE p_name IN (SELECT title FROM {BRAND_SQL}) OR p_brand IN (SELECT title FROM {BRAND_SQL})")
def category_semi(spark, sf_dir):
    return category.members(part_pages(spark, sf_dir), brand_list(spark)).select("id")


@query(f"SELECT p_partkey AS id FROM part WHERE upper(p_name) IN (SELECT upper(title) FROM {BRAND_SQL}) OR upper(p_brand) IN (SELECT upper(title) FROM {BRAND_SQL})")
def category_semi_upper(spark, sf_dir):
    return category.members(part_pages(spark, sf_dir), brand_list(spark), case_sensitive=False).select("id")


@query(f"SELECT DISTINCT upper(title) AS title FROM {BRAND_SQL} WHERE upper(title) NOT IN (SELECT upper(p_brand) FROM part UNION SELECT upper(p_name) FROM part)")
def category_anti(spark, sf_dir):
    return category.unmatched(part_pages(spark, sf_dir), brand_list(spark), case_sensitive=False)


@query("""SELECT c_custkey AS id, round(r / sum(r) OVER (), 10) AS page_rank, row_number() OVER (ORDER BY r DESC, c_custkey) AS position
  FROM (SELECT c_custkey, abs(c_acctbal) + 1 AS r FROM customer WHERE upper(c_mktsegment) = 'BUILDING')""")
def category_conditional(spark, sf_dir):
    pages = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("title"), (F.abs("c_acctbal") + 1).alias("rank"))
    inside = category.members(pages, spark.createDataFrame([("building",)], "title string"), case_sensitive=False)
    return category.conditional_ranks(inside).select("id", F.round("page_rank", 10).alias("page_rank"), "position")


@query(f"""WITH {EDGE_SQL}, deg AS (SELECT src, count(*) AS d FROM edges GROUP BY src), ranks AS (SELECT id, 1.0 / (1 + id) AS rank FROM vertices WHERE id % 4 IN (1, 2))
  SELECT e.dst, e.src, round(0.85 * a.rank / d / b.rank, 8) AS influence, CAST(row_number() OVER (PARTITION BY e.dst ORDER BY round(0.85 * a.rank / d / b.rank, 8) DESC, e.src) AS INT) AS place
  FROM edges e JOIN deg USING (src) JOIN ranks a ON a.id = e.src JOIN ranks b ON b.id = e.dst QUALIFY place <= 3""")
def category_influence(spark, sf_dir):
    edges = trade_edges(spark, sf_dir)
    inside = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct().where((F.col("id") % 4).isin(1, 2)).withColumn("rank", 1.0 / (1 + F.col("id")))
    flows = category.influences(inside, edges).withColumn("influence", F.round("influence", 8))
    return category.top_influencers(flows, 3).select("dst", "src", "influence", "place")


# lookup: customers and parts as titles, balances and prices as ranks

INDEX_SQL = """idx AS (SELECT key, max(rank) AS rank, min(id) FILTER (rank = best) AS id FROM (SELECT upper(name) AS key, id, rank, max(rank) OVER (PARTITION BY upper(name)) AS best FROM (
  SELECT c_name AS name, c_custkey AS id, c_acctbal AS rank FROM customer UNION ALL SELECT c_mktsegment, c_custkey, c_acctbal FROM customer)) GROUP BY key)"""


def customer_index(spark, sf_dir):
    return search.title_index(t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.array("c_mktsegment").alias("aliases"), F.col("c_acctbal").alias("rank")))


@query(f"WITH {INDEX_SQL} SELECT key, id, rank FROM idx")
def title_index(spark, sf_dir):
    return customer_index(spark, sf_dir)


@query(f"WITH {INDEX_SQL} SELECT key, id, rank FROM idx WHERE key = 'BUILDING'")
def exact_lookup(spark, sf_dir):
    return search.lookup(customer_index(spark, sf_dir), "Building")


@query(f"WITH {INDEX_SQL} SELECT key, id, rank FROM idx WHERE starts_with(key, 'CUSTOMER#') ORDER BY rank DESC, key LIMIT 10")
def prefix_suggest(spark, sf_dir):
    return search.suggest(customer_index(spark, sf_dir), "customer#")


@query(f"WITH {INDEX_SQL}, asked(prefix) AS (SELECT DISTINCT upper(substr(c_mktsegment, 1, 2)) FROM customer) SELECT prefix, CAST(row_number() OVER (PARTITION BY prefix ORDER BY rank DESC, key) AS INT) AS place, key, id, rank FROM asked JOIN idx ON starts_with(key, prefix) QUALIFY place <= 10")
def prefix_suggest_many(spark, sf_dir):
    return search.suggest_many(customer_index(spark, sf_dir), t(spark, sf_dir, "customer").select(F.substring("c_mktsegment", 1, 2).alias("prefix")))


RATIO_SQL = "greatest(a.s_acctbal, b.s_acctbal) / least(a.s_acctbal, b.s_acctbal)"


@query(f"SELECT a.s_suppkey, round({RATIO_SQL}, 6) AS ratio, {RATIO_SQL} <= 1.05 AS alike FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1 WHERE a.s_acctbal > 0 AND b.s_acctbal > 0")
def compare_ratio(spark, sf_dir):
    s = t(spark, sf_dir, "supplier").where("s_acctbal > 0")
    pairs = s.join(s.select((F.col("s_suppkey") - 1).alias("s_suppkey"), F.col("s_acctbal").alias("other")), "s_suppkey")
    ratio, said = search.compare(F.col("s_acctbal"), F.col("other"))
    return pairs.select("s_suppkey", F.round(ratio, 6).alias("ratio"), (said == "about as").alias("alike"))


@query(rf"""SELECT s_suppkey, said, CASE WHEN x >= y THEN n ELSE m END || ' is ' || said || CASE said WHEN 'about as' THEN ' influential as ' ELSE ' influential than ' END || CASE WHEN x >= y THEN m ELSE n END AS sentence FROM (
  SELECT *, CASE WHEN ratio <= 1.05 THEN 'about as' WHEN ratio < 10 THEN regexp_replace(printf('%.1f', round(ratio, 1)), '\.0$', '') || 'x more'
    ELSE CAST(CAST(round(ratio / pow(10, floor(log10(ratio)))) * pow(10, floor(log10(ratio))) AS BIGINT) AS VARCHAR) || 'x more' END AS said
  FROM (SELECT a.s_suppkey, a.s_name AS n, b.s_name AS m, a.s_acctbal AS x, b.s_acctbal AS y, {RATIO_SQL} AS ratio FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1 WHERE a.s_acctbal > 0 AND b.s_acctbal > 0))""")
def compare_words(spark, sf_dir):
    s = t(spark, sf_dir, "supplier").where("s_acctbal > 0")
    pairs = s.join(s.select((F.col("s_suppkey") - 1).alias("s_suppkey"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("other")), "s_suppkey")
    return pairs.select("s_suppkey", search.compare(F.col("s_acctbal"), F.col("other"))[1].alias("said"), search.said_of(F.col("s_name"), F.col("s_acctbal"), F.col("name"), F.col("other")).alias("sentence"))


@query("SELECT o_orderkey, printf(CASE WHEN x >= 0.1 THEN '%.2f' ELSE '%.3f' END, x) || '%' AS said FROM (SELECT o_orderkey, (o_orderkey % 97 + 1) / 100 AS x FROM orders)")
def percent_influence(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", text.percent_influence(F.col("o_orderkey") % 97 + 1, F.lit(100)).alias("said"))


@query("""SELECT category, id, position, percent_of_first FROM (SELECT c_mktsegment AS category, c_custkey AS id, CAST(row_number() OVER w AS INT) AS position,
    CASE WHEN row_number() OVER w = 1 THEN 0.0 ELSE round(100 * c_acctbal / first_value(c_acctbal) OVER w, 8) END AS percent_of_first
  FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey)) WHERE position <= 100""")
def category_tables(spark, sf_dir):
    people = t(spark, sf_dir, "customer")
    pages = people.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_acctbal").alias("rank"))
    lists = people.select(F.col("c_mktsegment").alias("category"), F.concat(F.lower("c_name"), F.lit(" ")).alias("title"))
    lists = lists.union(spark.createDataFrame([("BUILDING", "no such page")], "category string, title string"))
    tables = search.category_tables(search.title_index(pages), pages, lists, 100)
    return tables.select("category", "id", "position", F.round("percent_of_first", 8).alias("percent_of_first"))


@query(f"WITH {INDEX_SQL} SELECT c_custkey AS id, c_name AS title FROM customer WHERE c_custkey IN (SELECT id FROM idx WHERE key IN ('BUILDING', 'CUSTOMER#000000007'))")
def pages_by_title(spark, sf_dir):
    pages = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"))
    asked = spark.createDataFrame([("building ",), ("Customer#000000007",), ("BUILDING",), ("?",)], "title string")
    return search.pages_by_title(customer_index(spark, sf_dir), pages, asked)


@query("SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS \"order\" FROM orders QUALIFY \"order\" = 77")
def page_by_order(spark, sf_dir):
    rows = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("rank"))
    return search.page_by_order(ordering.ordered(rows), 77).select("id", "order")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS position FROM orders")
def external_sort(spark, sf_dir):
    return ordering.with_position(t(spark, sf_dir, "orders"), [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_orderkey", "position")


@query('SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS "order" FROM orders QUALIFY "order" > 20 AND "order" <= 40')
def ordered_range(spark, sf_dir):
    rows = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("rank"))
    return ordering.leading(rows, 40, [F.desc("rank"), F.asc("id")], "order", start=20).select("id", "order")


@query('SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS "order" FROM orders QUALIFY "order" > 45 AND "order" <= 55')
def neighbourhood(spark, sf_dir):
    rows = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("rank"))
    return ordering.neighbourhood(ordering.ordered(rows), 50).select("id", "order")


@query("""SELECT o_orderkey, round(o_totalprice / max(o_totalprice) OVER (), 10) AS relative_rank, round(o_totalprice / sum(o_totalprice) OVER (), 12) AS share,
  CASE WHEN o_totalprice = max(o_totalprice) OVER () THEN 0.0 ELSE round(100 * o_totalprice / max(o_totalprice) OVER (), 8) END AS percent_of_first FROM orders""")
def relative_rank(spark, sf_dir):
    rows = ordering.with_shares(t(spark, sf_dir, "orders"), "o_totalprice")
    return rows.select("o_orderkey", F.round("relative_rank", 10).alias("relative_rank"), F.round("share", 12).alias("share"), F.round("percent_of_first", 8).alias("percent_of_first"))


YEAR_SQL = "SELECT year(o_orderdate) AS year, max(o_totalprice) AS best_rank, min(o_orderkey) FILTER (o_totalprice = top) AS best, round(sum(o_totalprice), 2) AS mass FROM (SELECT *, max(o_totalprice) OVER (PARTITION BY year(o_orderdate)) AS top FROM orders) GROUP BY ALL"


def by_year(spark, sf_dir):
    years = charts.per_year(t(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate")), "year", "o_totalprice", "o_orderkey")
    return years.withColumn("mass", F.round("mass", 2))


@query(f"SELECT year, best, best_rank FROM ({YEAR_SQL})")
def best_per_year(spark, sf_dir):
    return by_year(spark, sf_dir).drop("mass")


@query(f"SELECT year, mass FROM ({YEAR_SQL}) WHERE year < (SELECT max(year(o_orderdate)) FROM orders)")
def mass_per_year(spark, sf_dir):
    return charts.latest_years(by_year(spark, sf_dir)).select("year", "mass")


@query("SELECT DISTINCT year(o_orderdate) AS year FROM orders WHERE (year(o_orderdate) - (SELECT min(year(o_orderdate)) FROM orders)) % 4 = 0")
def label_years(spark, sf_dir):
    return charts.label_years(by_year(spark, sf_dir).select("year"))


@query("SELECT CAST(floor(ln(o_totalprice) / 0.25) AS BIGINT) AS bucket, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 10) AS frequency FROM orders GROUP BY ALL")
def log_histogram(spark, sf_dir):
    return charts.log_histogram(t(spark, sf_dir, "orders"), "o_totalprice", 0.25).withColumn("frequency", F.round("frequency", 10))


@query("SELECT event_type, min(event_id) AS event_id FROM events GROUP BY event_type")
def ordered_uniq(spark, sf_dir):
    return readers.first_seen(t(spark, sf_dir, "events"), "event_type", "event_id")


@query("""SELECT p_partkey, CASE WHEN p_retailprice = 0 THEN 0 ELSE round(p_retailprice / power(10, floor(log10(p_retailprice)) - 1)) * power(10, floor(log10(p_retailprice)) - 1) END AS rounded,
  regexp_replace(p_name || ' (' || p_brand || ')', ' *\\([^)]*\\)', '', 'g') AS plain, replace(replace('<' || p_type || '&', '&', '&amp;'), '<', '&lt;') AS safe FROM part""")
def scalar_text(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", text.significant(F.col("p_retailprice"), 2).alias("rounded"), text.without_brackets(F.format_string("%s (%s)", "p_name", "p_brand")).alias("plain"), text.escaped_html(F.concat(F.lit("<"), "p_type", F.lit("&"))).alias("safe"))


@query("SELECT round(sum(o_totalprice), 2) AS total, min(o_totalprice) AS least, max(o_totalprice) AS greatest FROM orders")
def extent(spark, sf_dir):
    return charts.extent(t(spark, sf_dir, "orders"), "o_totalprice").withColumn("total", F.round("total", 2))


def step_sql(ticks: int) -> str:
    """The step that cuts high - low into about that many."""
    p = f"pow(10, floor(log10((high - low) / {ticks})))"
    e = f"{ticks} / (high - low) * {p}"
    return f"{p} * CASE WHEN {e} <= 0.15 THEN 10 WHEN {e} <= 0.35 THEN 5 WHEN {e} <= 0.75 THEN 2 ELSE 1 END"


@query(f"""WITH x AS (SELECT ln(o_totalprice) AS x FROM orders), d AS (SELECT min(x) AS low, max(x) AS high, count(*) AS total FROM x), w AS (SELECT *, {step_sql(10)} AS wide FROM d),
  e AS (SELECT floor(low / wide) * wide AS low, ceil(high / wide) * wide AS high, total FROM w), s AS (SELECT *, {step_sql(50)} AS step FROM e),
  r AS (SELECT *, CAST(ceil(round(low / step, 9)) AS BIGINT) AS first, CAST(floor(round(high / step, 9)) AS BIGINT) AS last FROM s),
  c AS (SELECT least(CAST(floor(x / step) AS BIGINT) - first, last - first - 1) AS bucket, count(*) AS n FROM x, r GROUP BY 1)
  SELECT b.bucket, round((b.bucket + first) * step, 8) AS lower, coalesce(n, 0) AS n, round(coalesce(n, 0) / total, 10) AS frequency FROM r, LATERAL (SELECT unnest(range(last - first)) AS bucket) b LEFT JOIN c ON c.bucket = b.bucket""")
def rounded_histogram(spark, sf_dir):
    rows = charts.rounded_histogram(t(spark, sf_dir, "orders"), "o_totalprice")
    return rows.select("bucket", F.round("lower", 8).alias("lower"), F.col("n").cast("long").alias("n"), F.round("frequency", 10).alias("frequency"))


@query("SELECT o_orderkey, o_orderkey & 4 <> 0 AS flagged FROM orders")
def flag_test(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", text.has_flag(F.col("o_orderkey"), 4).alias("flagged"))


@query("SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def table_lengths(spark, sf_dir):
    return spark.createDataFrame([(name, readers.row_count(t(spark, sf_dir, name))) for name in ("orders", "lineitem")], "name string, n long")
