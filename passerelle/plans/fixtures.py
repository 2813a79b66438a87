"""Tables in the shape of captures and exports, derived from the driver's tables by SQL that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier")

FIXTURES = {
    "fx_entries": """
SELECT concat('e',CAST(p_partkey AS STRING)) AS id, p_name AS name,
  CASE p_type WHEN 'PROMO' THEN 'articleDetail' WHEN 'ECONOMY' THEN 'webinarsDetail' WHEN 'MEDIUM' THEN 'HardGoodDetail'
    WHEN 'SMALL' THEN 'personDetail' WHEN 'LARGE' THEN 'hardGoodDetail' END AS type,
  concat(replace(p_name,' ','-'),'-',CAST(p_partkey % 400 AS STRING)) AS slug
FROM part
""",
    "fx_nodes": """
SELECT path, composition_id FROM (VALUES ('/','c0'),('/:locale','c1'),('/about','c2'),('/:locale/about','c3'),
  ('/old','c4'),('/:locale/articles/:articles','c5'),('/webinars/:webinars/','c6'),('/people/:speaker','c7'),
  ('/shop/:hardGoodDetail','c8'),('/misc/:unmapped','c9'),('/draft',NULL),('/gone/:articles','c10')) AS t(path, composition_id)
""",
    "fx_redirects": """
SELECT source_url FROM (VALUES ('/old'),('/gone/:articles'),('/never')) AS t(source_url)
""",
    "fx_type_map": """
SELECT param, type FROM (VALUES ('articles','articleDetail'),('conference','conferencesDetail'),('od-ls','onlineTrainingDetail'),
  ('webinars','webinarsDetail'),('od-ls-watch-page','onlineTrainingDetail'),('hardGoodDetail','hardGoodDetail'),('speaker','personDetail')) AS t(param, type)
""",
    "fx_api_pages": """
SELECT CAST(floor((p_partkey) / 50) AS BIGINT) * 50 AS page_offset, p_partkey AS item_pos, p_name AS name FROM part
""",
    "fx_locs": """
SELECT CASE page_id % 4 WHEN 0 THEN concat('https://s.example.com/home/',CAST(page_id % 20 AS STRING),'/')
  WHEN 1 THEN concat('https://s.example.com/n/',CAST(page_id % 30 AS STRING)) WHEN 2 THEN url ELSE 'https://s.example.com/home' END AS loc FROM pages
""",
    "fx_inv_a": """
SELECT regexp_extract(url,'^[a-z]+://[^/?#]*([^?#]*)',1) AS url FROM pages WHERE page_id % 10 <> 3
UNION ALL SELECT regexp_extract(url,'^[a-z]+://[^/?#]*([^?#]*)',1) AS url FROM pages WHERE page_id % 20 = 7
""",
    "fx_inv_b": """
SELECT regexp_extract(url,'^[a-z]+://[^/?#]*([^?#]*)',1) AS url FROM pages WHERE page_id % 10 <> 7
""",
    "fx_captures": """
SELECT page_id, url, CASE WHEN page_id % 13 = 5 THEN replace(html,'<article>','<article><p>Page Not Found</p>')
  WHEN page_id % 13 = 6 THEN replace(html,'<article>','<article><p hidden>Internal Server Error</p>')
  WHEN page_id % 13 = 7 THEN replace(html,'<article>','<article><p>Internal Server Error</p>') ELSE html END AS html,
  CAST(CASE page_id % 11 WHEN 0 THEN 404 WHEN 1 THEN 502 WHEN 2 THEN 0 WHEN 3 THEN 204 ELSE 200 END AS INT) AS status
FROM pages
""",
    "fx_attempts": """
SELECT concat('https://s.example.com/u/',CAST(user_id AS STRING),'/',CAST(event_id % 7 AS STRING)) AS url, event_id AS attempt_id, ts,
  CAST(CASE event_type WHEN 'error' THEN 502 WHEN 'purchase' THEN 404 WHEN 'signup' THEN 502 WHEN 'view' THEN 204 ELSE 200 END AS INT) AS status
FROM events
""",
    "fx_links": """
SELECT DISTINCT concat('https://s.example.com/p/',CAST(l_partkey AS STRING)) AS page_url, l_linenumber AS pos,
  CASE WHEN l_linenumber = 7 AND l_quantity > 45 THEN 'http://' WHEN l_linenumber = 6 THEN 'https://s.example.com.evil.org/x'
    WHEN l_linenumber = 5 THEN 'https://other.example.net/x' WHEN l_linenumber = 4 THEN concat('/p/',CAST(CAST(floor(l_partkey / 7) AS BIGINT) AS STRING),'?q=1#f')
    ELSE concat('/p/',CAST(l_partkey * 7 + l_linenumber AS STRING),'?q=1#f') END AS href
FROM lineitem
""",
    "fx_nodes_dom": """
SELECT page, side, node_id, CASE WHEN l_returnflag = 'R' AND node_id > 1 THEN node_id - 1 ELSE 0 END AS parent_id, node_id AS ord,
  'div' AS tag, l_tax > 0 AS is_component, CASE WHEN l_quantity < 3 THEN 'none' ELSE 'block' END AS display,
  CASE WHEN l_quantity > 48 THEN 'fixed' ELSE 'static' END AS position,
  CASE WHEN l_discount = 0 THEN 0 ELSE l_quantity END AS height, CASE WHEN l_linestatus = 'O' THEN 'x' ELSE ' ' END AS text
FROM (SELECT concat('/o/',CAST(l_orderkey AS STRING)) AS page, CASE WHEN l_orderkey % 2 = 0 THEN 'prod' ELSE 'stage' END AS side,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey,l_extendedprice,l_shipdate) AS node_id, lineitem.* FROM lineitem) AS n
""",
    "fx_components": """
SELECT concat('/o/',CAST(l_orderkey AS STRING)) AS url,
  CASE l_linenumber WHEN 1 THEN 'header' WHEN 7 THEN 'footer' ELSE concat('component-0',CAST(l_linenumber AS STRING)) END AS component,
  CASE WHEN max(l_returnflag) = 'N' THEN 'prod_only' WHEN max(l_returnflag) = 'A' THEN 'stage_only' ELSE 'both' END AS presence,
  CAST(max(l_quantity) AS INT) * 10 AS height, round(max(l_discount) * max(l_tax) * 8000) / 2 AS mismatch
FROM lineitem GROUP BY l_orderkey, l_linenumber
""",
    "fx_ignore": """
SELECT concat('/o/',CAST(l_orderkey AS STRING)) AS url, concat('component-0',CAST(l_linenumber AS STRING)) AS component,
  CAST(0 AS DOUBLE) AS percents FROM lineitem WHERE l_orderkey % 17 = 0 GROUP BY l_orderkey, l_linenumber
""",
    "fx_images": """
SELECT vec_id AS pair, side, concat('/v/',CAST(CAST(floor(vec_id / 3) AS BIGINT) AS STRING)) AS url, concat('component-0',CAST(vec_id % 3 AS STRING)) AS component,
  NOT (vec_id % 10 = 6 AND side = 'stage') AS readable, CASE WHEN vec_id % 10 = 7 THEN 0 ELSE 64 * h END AS pixels, h AS height
FROM (SELECT vec_id, CASE WHEN vec_id % 50 = 0 THEN 400 ELSE 8 END AS h FROM embeddings) AS e CROSS JOIN (VALUES ('prod'), ('stage')) AS s(side)
""",
    "fx_shot_rules": """
SELECT concat('/v/',CAST(CAST(floor(vec_id / 3) AS BIGINT) AS STRING)) AS url, concat('component-0',CAST(vec_id % 3 AS STRING)) AS component,
  CASE WHEN vec_id % 3 = 0 THEN 34.38 ELSE 34.375 END AS percents FROM embeddings WHERE vec_id % 20 = 3
""",
    "fx_finals": """
SELECT concat('/o/',CAST(o_orderkey AS STRING)) AS url, CASE WHEN o_orderstatus = 'P' THEN concat('https://p.example.com/r/',CAST(o_orderkey AS STRING)) END AS prod_final,
  CASE WHEN o_orderkey % 3 = 0 THEN concat('https://m.example.com/r/',CAST(o_orderkey AS STRING)) END AS stage_final FROM orders
""",
    "fx_requests": """
SELECT event_id AS request_id, CASE event_id % 6 WHEN 0 THEN concat('https://s.example.com/_next/image?url=%2Fimg%2F',CAST(user_id AS STRING),'.gif&w=64')
  WHEN 1 THEN concat('https://cdn.example.com/v/',CAST(user_id AS STRING),'.MP4?t=1') WHEN 2 THEN 'https://c.clarity.ms/c.gif?x=1'
  WHEN 3 THEN concat('https://cdn.example.com/cdn-cgi/image/w=1/https://h.example.com/',CAST(user_id AS STRING),'.png')
  WHEN 4 THEN concat('https://s.example.com/proxy?src=https%253A%252F%252Fh.example.com%252F',CAST(user_id AS STRING),'.gif')
  ELSE concat('https://s.example.com/a/',CAST(user_id AS STRING)) END AS url FROM events
""",
    "fx_blocked": """
SELECT CASE WHEN event_id % 2 = 0 THEN 'prod' ELSE 'migrated' END AS side, concat('/u/',CAST(user_id AS STRING)) AS url,
  concat('https://img.assets.example.com/p/ab',CAST(event_id AS STRING),'-Clip',CAST(event_id % 9 AS STRING),'.GIF') AS media_url
FROM events
""",
    "fx_findings": """
SELECT 'entry' AS kind, CAST(d.doc_id AS STRING) AS id, d.source AS name, d.n_chars % 5 = 0 AS pattern,
  CASE WHEN l.toxic = 1 THEN 'rgb(217, 83, 79)' WHEN l.quality = 0 THEN 'rgb(250, 204, 21)' WHEN d.n_chars % 7 = 0 THEN 'rgb(0, 0, 0)' END AS color,
  concat('<svg w="12"></svg> ',CASE WHEN d.n_chars % 4 = 3 THEN '' ELSE CAST(d.n_chars % 4 AS STRING) END) AS html
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
""",
}

#: tables that the engines spell apart
#: Screens of both sides: x to 63, y to 7, or to 399 on every fiftieth pair. By pair % 10: one pixel differs, none, all, every third column, a row is on stage only,
#: a third of the rows differ, stage is unreadable, both are empty, else none.
_SHOT_SIDES = """SELECT pair, side, x, y, CASE WHEN side = 'prod' THEN v WHEN pair % 10 = 0 AND x = 0 AND y = 0 THEN v + 1 WHEN pair % 10 = 2 THEN v + 1 WHEN pair % 10 = 3 AND x % 3 = 0 THEN v + 1
  WHEN pair % 10 = 5 AND y % 3 = 0 THEN v - 1 ELSE v END AS v
FROM (SELECT b.pair, b.x, b.v, s.side, y.y, b.h FROM base b CROSS JOIN (VALUES ('prod'), ('stage')) AS s(side) JOIN ys y ON y.y < b.h + CASE WHEN b.pair % 10 = 4 AND s.side = 'stage' THEN 1 ELSE 0 END) AS t
WHERE pair % 10 <> 7 AND NOT (pair % 10 = 6 AND side = 'stage')"""
SHOTS = {
    "spark": f"""
WITH base AS (SELECT vec_id AS pair, CAST(pos AS BIGINT) AS x, CAST(floor(v * 4) AS INT) AS v, h FROM (SELECT vec_id, embedding, CASE WHEN vec_id % 50 = 0 THEN 400 ELSE 8 END AS h FROM embeddings) LATERAL VIEW posexplode(embedding) AS pos, v),
ys AS (SELECT id AS y FROM range(0, 401)) {_SHOT_SIDES}
""",
    "duckdb": f"""
WITH base AS (SELECT vec_id AS pair, i - 1 AS x, CAST(floor(embedding[i] * 4) AS INT) AS v, CASE WHEN vec_id % 50 = 0 THEN 400 ELSE 8 END AS h FROM embeddings, range(1, 65) AS r(i) WHERE i <= len(embedding)),
ys AS (SELECT y FROM range(0, 401) AS r(y)) {_SHOT_SIDES}
""",
}
PIXELS = {
    "spark": """
SELECT CAST(floor(vec_id / 2) AS BIGINT) AS pair, CASE WHEN vec_id % 2 = 0 THEN 'prod' ELSE 'stage' END AS side, pos AS x, 0 AS y, CAST(floor(v * 4) AS INT) AS v FROM embeddings LATERAL VIEW posexplode(embedding) AS pos, v
""",
    "duckdb": """
SELECT CAST(floor(vec_id / 2) AS BIGINT) AS pair, CASE WHEN vec_id % 2 = 0 THEN 'prod' ELSE 'stage' END AS side, CAST(i - 1 AS INT) AS x, 0 AS y, CAST(floor(embedding[i] * 4) AS INT) AS v FROM embeddings, range(1, 4097) AS r(i) WHERE i <= len(embedding)
""",
}
APART = {"fx_pixels": PIXELS, "fx_shots": SHOTS}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The derived table, over views of the tables that its SQL names."""
    sql = APART[name]["spark"] if name in APART else FIXTURES[name]
    for t in TABLES:
        if t in sql:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(sql)


def with_fixtures(query: str, *names: str, recursive: bool = False) -> str:
    """DuckDB SQL with the derived tables in front."""
    parts = [f"{n} AS ({(APART[n]['duckdb'] if n in APART else FIXTURES[n]).strip()})" for n in names]
    body = query.strip()
    more = ", " + body[5:] if body[:5].upper() == "WITH " else " " + body
    return f"WITH {'RECURSIVE ' * recursive}" + ", ".join(parts) + more
