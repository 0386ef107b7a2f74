"""Views of the driver's tables that have the shape of a hiking network. The same SQL text runs in Spark and in other engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {
    "hub": """
SELECT 0 AS hub_type, CAST(s_suppkey AS BIGINT) AS hub_id, s_name AS name,
       9.5 + CAST((s_suppkey * 7919) % 10007 AS DOUBLE) / 10007 * 7.5 AS lon,
       46.4 + CAST((s_suppkey * 4729) % 10009 AS DOUBLE) / 10009 * 2.1 AS lat
FROM supplier
UNION ALL
SELECT CAST(1 + c_custkey % 3 AS INT) AS hub_type, CAST(c_custkey AS BIGINT) AS hub_id, c_name AS name,
       9.5 + CAST((c_custkey * 3571) % 10007 AS DOUBLE) / 10007 * 7.5 AS lon,
       46.4 + CAST((c_custkey * 8117) % 10009 AS DOUBLE) / 10009 * 2.1 AS lat
FROM customer""",
    "hut_edge": """
SELECT u * 100000 + v AS edge_id, u AS from_id, v AS to_id,
       CAST(3000 + (u * 7919 + v * 4729) % 15000 AS DOUBLE) AS distance_m,
       CAST((u * 613 + v * 307) % 1200 AS DOUBLE) AS ascent_m,
       CAST((u * 401 + v * 811) % 1200 AS DOUBLE) AS descent_m,
       CAST(1500 + (u * 97 + v * 193) % 1800 AS DOUBLE) AS max_ele_m,
       CAST((u + v) % 7 - 1 AS INT) AS sac_rank,
       (u * v) % 11 = 3 AS via_ferrata,
       (u + 3 * v) % 13 = 0 AS downgraded,
       n_orders
FROM (SELECT a.l_suppkey AS u, b.l_suppkey AS v, COUNT(DISTINCT a.l_orderkey) AS n_orders
      FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey
      GROUP BY a.l_suppkey, b.l_suppkey) p
CROSS JOIN (SELECT COUNT(*) AS n FROM supplier) c
WHERE (u * 31 + v * 17) % GREATEST(1, CAST(FLOOR(c.n / 8) AS BIGINT)) = 0""",
    "start_edge": """
SELECT o_custkey AS start_id, CAST(1 + o_custkey % 3 AS INT) AS start_type, l_suppkey AS hut_id,
       CAST(MIN(l_linenumber) % 4 AS INT) AS variant,
       CAST(1000 + (SUM(CAST(l_quantity AS BIGINT)) * 97) % 24000 AS DOUBLE) AS distance_m,
       CAST((o_custkey * 53 + l_suppkey * 71) % 1500 AS DOUBLE) AS ascent_m,
       CAST((o_custkey * 31 + l_suppkey * 17) % 400 AS DOUBLE) AS descent_m,
       CASE MIN(o_orderpriority) WHEN '1-URGENT' THEN 'private' WHEN '2-HIGH' THEN 'customers' END AS access
FROM orders JOIN lineitem ON o_orderkey = l_orderkey
GROUP BY o_custkey, l_suppkey""",
    "vertex": """
SELECT l_orderkey AS rec, CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_extendedprice) - 1 AS INT) AS pos,
       11.0 + CAST(l_partkey % 997 AS DOUBLE) / 99700 AS lon, 47.0 + CAST(l_suppkey % 89 AS DOUBLE) / 8900 AS lat,
       CASE WHEN l_returnflag = 'R' THEN NULL ELSE 1000.0 + l_quantity * 20 END AS ele
FROM lineitem""",
    "hut_day": """
SELECT user_id AS ohrs_id, CAST(ts AS DATE) AS d,
       CASE WHEN SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) > 0 THEN 'UNSERVICED' ELSE 'SERVICED' END AS status,
       CAST(20 + user_id % 30 AS INT) AS capacity,
       CAST(20 + user_id % 30 - SUM(CAST(FLOOR(value / 8) AS BIGINT)) AS INT) AS free_place
FROM events GROUP BY user_id, CAST(ts AS DATE)""",
}
#: Views that other queries build on: ways with tags, and legs by direction and variant.
VIEWS |= {
    "way": """
SELECT CAST(p_partkey AS BIGINT) AS way_id,
       CASE p_partkey % 9 WHEN 0 THEN 'residential' WHEN 1 THEN 'track' WHEN 2 THEN 'footway' WHEN 3 THEN 'steps' WHEN 4 THEN 'tertiary' WHEN 5 THEN 'via_ferrata' ELSE 'path' END AS highway,
       CASE p_size % 11 WHEN 0 THEN 'hiking' WHEN 1 THEN 'mountain_hiking' WHEN 2 THEN 'alpine_hiking' WHEN 3 THEN 'difficult_alpine_hiking' WHEN 4 THEN 'unheard_of' END AS sac_scale,
       CASE p_size % 5 WHEN 0 THEN 'asphalt' WHEN 1 THEN 'gravel' END AS surface,
       CASE p_partkey % 13 WHEN 0 THEN 'no' WHEN 1 THEN 'private' WHEN 2 THEN 'yes' END AS access,
       CASE p_partkey % 4 WHEN 0 THEN 'designated' WHEN 1 THEN 'no' END AS foot,
       CASE p_size % 17 WHEN 0 THEN 'bad' WHEN 1 THEN 'good' WHEN 2 THEN 'no' END AS trail_visibility,
       CASE p_size % 19 WHEN 3 THEN 'yes' END AS informal,
       CASE p_size % 23 WHEN 5 THEN 'yes' END AS ladder,
       CAST(100 + p_partkey % 900 AS DOUBLE) AS length_m
FROM part""",
    "graded_edge": """
SELECT e.*, (sac_rank >= 0 AND NOT via_ferrata AND NOT downgraded) AS constrained_ok FROM hut_edge e""",
    "start_record": """
SELECT s.*, start_id * 1000000 + hut_id AS edge_id FROM start_edge s""",
}


_registered: dict[str, str] = {}


def register(spark: SparkSession, sf_dir: str) -> None:
    """Temp views of the tables and of VIEWS; once for a session and folder."""
    session = spark._jsparkSession.sessionUUID()
    if _registered.get(session) == sf_dir and spark.catalog.tableExists("start_record"):
        return
    _registered[session] = sf_dir
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    for name, text in VIEWS.items():
        if (session, sf_dir, name) in _built:
            _built[session, sf_dir, name].createOrReplaceTempView(name)
        else:
            spark.sql(f"CREATE OR REPLACE TEMP VIEW {name} AS {text}")


#: The network's own tables, each a join of the largest tables: built once for a session and folder, as tables in the checkpoint folder.
NETWORK = ("hut_edge", "start_edge")
_built: dict[tuple[str, str, str], DataFrame] = {}


def build(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Builds those of NETWORK that names stand on and that are not built yet."""
    from routelake.plans.lineage import cut

    register(spark, sf_dir)
    session = spark._jsparkSession.sessionUUID()
    wanted = [n for n in NETWORK if (session, sf_dir, n) not in _built and any(n == m or n in NEEDS.get(m, ()) for m in names)]
    for name in wanted:
        _built[session, sf_dir, name] = cut(spark.table(name))
        _built[session, sf_dir, name].createOrReplaceTempView(name)
    for name, needs in NEEDS.items():
        if any(n in wanted for n in needs):
            spark.sql(f"CREATE OR REPLACE TEMP VIEW {name} AS {VIEWS[name]}")


def view(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame | tuple[DataFrame, ...]:
    build(spark, sf_dir, *names)
    out = tuple(spark.table(n) for n in names)
    return out[0] if len(out) == 1 else out


NEEDS = {"graded_edge": ("hut_edge",), "start_record": ("start_edge",)}


def with_views(query: str, *names: str, more: str = "") -> str:
    """query as SQL text of its own: the views that it names as common table expressions before it."""
    wanted = [n for n in VIEWS if n in names or any(n in NEEDS.get(m, ()) for m in names)]
    parts = [f"{n} AS ({VIEWS[n]})" for n in wanted] + ([more] if more else [])
    recursive = "RECURSIVE " if "RECURSIVE" in more else ""
    return f"WITH {recursive}" + ",\n".join(parts).replace("RECURSIVE ", "") + "\n" + query if parts else query
