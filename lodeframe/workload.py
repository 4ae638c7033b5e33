"""Queries of the dialect over the driver's tables, each with SQL that gives the same rows."""

import bz2
import gzip
import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import types
from .engine import Engine, over_parquet

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "benchmark", "pages", "conversations", "embeddings")

#: Rows of the packed files: so many that a bzip2 block of them has over 256 KiB.
PACKED_ROWS = 40_000

FLAGSHIP = """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
round(avg(l_discount), 6) AS avg_disc, min(l_shipdate) AS first_ship, max(l_extendedprice) AS top_price, count(*) AS n
FROM lineitem WHERE l_quantity < 45 GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus"""


#: name: the dialect's text, or (the dialect's text, the oracle's)
DIALECT: dict[str, str | tuple[str, str]] = {
    "flagship": FLAGSHIP,
    "scan_project": ("SELECT n_nationkey, n_name FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation"),
    "select_star": ("SELECT *, r_regionkey*2 AS dbl FROM region", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name, CAST(r_regionkey AS BIGINT)*2 AS dbl FROM region"),
    "namespace_star": ("SELECT r.*, r.r_name AS again FROM region r", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name, r_name AS again FROM region"),
    "quoted_names": ("SELECT \"r_name\" AS \"The Name\", R_REGIONKEY AS k FROM region", "SELECT r_name AS \"The Name\", CAST(r_regionkey AS BIGINT) AS k FROM region"),
    "alias_arith": "SELECT l_orderkey, round(l_extendedprice*(1-l_discount)*(1+l_tax), 4) AS charge FROM lineitem",
    "int_division": ("SELECT o_orderkey, (o_orderkey-7500)/7 AS q FROM orders", "SELECT o_orderkey, (o_orderkey-7500)//7 AS q FROM orders"),
    "float_division": "SELECT o_orderkey, o_totalprice/4.0 AS q FROM orders",
    "unary_minus": "SELECT c_custkey, -c_acctbal AS neg, +c_acctbal AS pos FROM customer",
    "literals": ("SELECT r_name, 1 AS i, .5 AS f, 1e3 AS e, 'it''s' AS s, true AS b, false OR true AS n FROM region", "SELECT r_name, CAST(1 AS BIGINT) AS i, 0.5::DOUBLE AS f, 1e3::DOUBLE AS e, 'it''s' AS s, true AS b, true AS n FROM region"),
    "parentheses_comments": ("SELECT (o_orderkey + 1) * 2 AS x -- a comment\nFROM orders", "SELECT (o_orderkey + 1) * 2 AS x FROM orders"),
    "filter_cmp": "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 30 AND l_discount < 0.05",
    "filter_between_cols": "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey < l_partkey AND l_suppkey != 3",
    "filter_or_not": "SELECT l_orderkey, l_tax FROM lineitem WHERE (NOT (l_tax > 0.02)) OR l_returnflag = 'R'",
    "filter_mixed_num": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber = l_quantity", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem WHERE l_linenumber = l_quantity"),
    "filter_string_cmp": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment > 'BUILDING'",
    "filter_null_eq": ("SELECT c_custkey FROM customer WHERE nullif(c_mktsegment,'BUILDING') = NULL", "SELECT c_custkey FROM customer WHERE nullif(c_mktsegment,'BUILDING') IS NULL"),
    "filter_not_null": "SELECT c_custkey FROM customer WHERE nullif(c_mktsegment,'BUILDING') IS NOT NULL",
    "filter_three_valued": "SELECT c_custkey FROM customer WHERE nullif(c_mktsegment,'BUILDING') = 'MACHINERY' OR c_acctbal > 0",
    "is_true_false": "SELECT c_custkey, (nullif(c_mktsegment,'BUILDING') = 'MACHINERY') IS TRUE AS a, (nullif(c_mktsegment,'BUILDING') = 'MACHINERY') IS NOT FALSE AS b FROM customer",
    "null_arithmetic": ("SELECT o_orderkey, o_orderkey + NULL AS a, o_orderkey < NULL AS b FROM orders", "SELECT o_orderkey, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BOOLEAN) AS b FROM orders"),
    "cmp_columns_ts": "SELECT count(*) AS n FROM lineitem WHERE l_shipdate = l_shipdate",
    "bool_projection": "SELECT o_orderkey, o_totalprice > 100000 AS big FROM orders",
    "like": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%bolt%'",
    "ilike": "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE 'BLUE%'",
    "not_like": "SELECT p_partkey, p_name FROM part WHERE p_name NOT LIKE '%bolt%'",
    "in_list": "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT','2-HIGH')",
    "not_in_list": "SELECT o_orderkey FROM orders WHERE o_orderpriority NOT IN ('1-URGENT','2-HIGH')",
    "case_when": "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders",
    "fn_nullif": ("SELECT l_orderkey, nullif(l_linenumber, 1) AS x FROM lineitem", "SELECT l_orderkey, CAST(nullif(l_linenumber, 1) AS BIGINT) AS x FROM lineitem"),
    "fn_coalesce": ("SELECT l_orderkey, coalesce(nullif(l_linenumber,1), 0) AS x, coalesce(nullif(l_linenumber,1), 0.5) AS y FROM lineitem", "SELECT l_orderkey, CAST(coalesce(nullif(l_linenumber,1), 0) AS BIGINT) AS x, CAST(coalesce(CAST(nullif(l_linenumber,1) AS DOUBLE), 0.5::DOUBLE) AS DOUBLE) AS y FROM lineitem"),
    "fn_round": ("SELECT l_orderkey, round(l_extendedprice*l_discount, 2) AS a, round(l_extendedprice) AS b, round(l_linenumber, 2) AS c FROM lineitem", "SELECT l_orderkey, round(l_extendedprice*l_discount, 2) AS a, round(l_extendedprice) AS b, CAST(l_linenumber AS DOUBLE) AS c FROM lineitem"),
    "fn_trig": ("SELECT c_custkey, " + ", ".join(f"round({f}(c_acctbal/1000.0), 6) AS {f}" for f in ("sin", "cos", "tan", "asin", "acos", "atan")) + " FROM customer", "SELECT c_custkey, " + ", ".join(f"round({f}(c_acctbal/1000.0), 6) AS {f}" for f in ("sin", "cos", "tan", "atan")) + ", " + ", ".join(f"CASE WHEN abs(c_acctbal/1000.0) <= 1 THEN round({f}(CASE WHEN abs(c_acctbal/1000.0) <= 1 THEN c_acctbal/1000.0 ELSE 0 END), 6) END AS {f}" for f in ("asin", "acos")) + " FROM customer"),
    "fn_hyper": "SELECT c_custkey, " + ", ".join(f"round({f}(c_acctbal/2000.0), 5) AS {f}" for f in ("sinh", "cosh", "tanh")) + " FROM customer",
    "fn_log_exp": (
        "SELECT c_custkey, round(log(c_acctbal), 6) AS l, round(log2(c_acctbal), 6) AS l2, round(log10(c_acctbal), 6) AS l10, round(sqrt(c_acctbal), 6) AS r, round(exp(c_acctbal/1000.0), 4) AS e, round(exp2(c_acctbal/1000.0), 4) AS e2 FROM customer",
        "SELECT c_custkey, " + ", ".join(f"CASE WHEN c_acctbal {op} 0 THEN round({f}(CASE WHEN c_acctbal {op} 0 THEN c_acctbal ELSE 1 END), 6) END AS {n}" for f, n, op in (("ln", "l", ">"), ("log2", "l2", ">"), ("log10", "l10", ">"), ("sqrt", "r", ">="))) + ", round(exp(c_acctbal/1000.0), 4) AS e, round(pow(2.0::DOUBLE, c_acctbal/1000.0), 4) AS e2 FROM customer",
    ),
    "fn_trim_case": "SELECT p_partkey, trim(p_name) AS t, lower(p_brand) AS l, upper(p_name) AS u FROM part",
    "fn_lower_text": "SELECT doc_id, lower(text) AS l FROM documents",
    "fn_left": "SELECT doc_id, left(text, 12) AS l FROM documents",
    "fn_split_part": ("SELECT p_partkey, split_part(p_name,'b',1) AS a, split_part(p_type,' ',2) AS b, split_part(p_brand,'#',5) AS c FROM part", "SELECT p_partkey, " + ", ".join(f"CASE WHEN instr({x},'{d}')=0 THEN '' ELSE split_part({x},'{d}',{n}) END AS {a}" for x, d, n, a in (("p_name", "b", 1, "a"), ("p_type", " ", 2, "b"), ("p_brand", "#", 5, "c"))) + " FROM part"),
    "fn_version": ("SELECT version() AS v, count(*) AS n FROM region GROUP BY version()", "SELECT '0.1.0' AS v, count(*) AS n FROM region"),
    "group_distinct": "SELECT l_returnflag, l_linestatus FROM lineitem GROUP BY 1, 2",
    "select_distinct": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "group_expr": ("SELECT o_totalprice > 100000 AS big, count() AS n FROM orders GROUP BY o_totalprice > 100000", "SELECT o_totalprice > 100000 AS big, count(*) AS n FROM orders GROUP BY o_totalprice > 100000"),
    "group_ordinal": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1",
    "group_alias": ("SELECT left(o_orderpriority, 1) AS p, count(*) AS n FROM orders GROUP BY p", "SELECT left(o_orderpriority, 1) AS p, count(*) AS n FROM orders GROUP BY 1"),
    "group_null_key": "SELECT nullif(c_mktsegment,'BUILDING') AS s, count(*) AS n FROM customer GROUP BY nullif(c_mktsegment,'BUILDING')",
    "group_literal_key": "SELECT 'all' AS k, count(*) AS n FROM orders GROUP BY 'all'",
    "group_key_in_expr": ("SELECT o_custkey, o_custkey + count(*) AS x FROM orders GROUP BY o_custkey", "SELECT o_custkey, o_custkey + count(*) AS x FROM orders GROUP BY o_custkey"),
    "global_agg": ("SELECT count()*2-1 AS a, max(o_totalprice)-min(o_totalprice) AS b, sum(o_custkey) AS s, round(avg(o_custkey), 6) AS m FROM orders", "SELECT count(*)*2-1 AS a, max(o_totalprice)-min(o_totalprice) AS b, CAST(sum(o_custkey) AS BIGINT) AS s, round(avg(o_custkey), 6) AS m FROM orders"),
    "global_agg_empty": ("SELECT count() AS n, max(o_custkey) AS m FROM orders WHERE 1 > 2", "SELECT count(*) AS n, max(o_custkey) AS m FROM orders WHERE 1 > 2"),
    "agg_distinct": ("SELECT l_returnflag, count(DISTINCT l_suppkey) AS c, sum(DISTINCT l_linenumber) AS s, round(avg(DISTINCT l_quantity), 6) AS a, min(DISTINCT l_tax) AS m FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS c, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s, round(avg(DISTINCT l_quantity), 6) AS a, min(l_tax) AS m FROM lineitem GROUP BY l_returnflag"),
    "agg_literal": ("SELECT count(1) AS c, sum(2) AS s FROM orders", "SELECT count(1) AS c, CAST(sum(2) AS BIGINT) AS s FROM orders"),
    "agg_bool": "SELECT o_orderstatus, bool_and(o_totalprice > 2000) AS a, bool_or(o_totalprice > 499000) AS o FROM orders GROUP BY o_orderstatus",
    "minmax_types": ("SELECT min(o_orderdate) AS d1, max(o_orderdate) AS d2, min(o_orderpriority) AS s1, max(o_orderpriority) AS s2, min(o_custkey) AS i1, max(o_totalprice) AS f2 FROM orders", "SELECT min(o_orderdate) AS d1, max(o_orderdate) AS d2, min(o_orderpriority) AS s1, max(o_orderpriority) AS s2, min(o_custkey) AS i1, max(o_totalprice) AS f2 FROM orders"),
    "count_nonnull": "SELECT count(nullif(c_mktsegment,'BUILDING')) AS c, count(*) AS n FROM customer",
    "agg_filter": "SELECT event_type, count(*) AS n, round(sum(value), 2) AS v FROM events WHERE value > 100 GROUP BY event_type",
    "having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "order_asc_desc": "SELECT o_orderpriority, o_orderkey FROM orders ORDER BY o_orderpriority DESC, 2 ASC LIMIT 40",
    "order_nulls": "SELECT c_custkey, nullif(c_mktsegment,'BUILDING') AS s FROM customer ORDER BY s DESC NULLS LAST, c_custkey LIMIT 50",
    "order_nulls_default": ("SELECT c_custkey, nullif(c_mktsegment,'BUILDING') AS s FROM customer ORDER BY s DESC, c_custkey LIMIT 50", "SELECT c_custkey, nullif(c_mktsegment,'BUILDING') AS s FROM customer ORDER BY s DESC NULLS FIRST, c_custkey LIMIT 50"),
    "order_hidden": "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
    "agg_topk": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10",
    "limit_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20",
    "limit_zero": "SELECT o_orderkey FROM orders LIMIT 0",
    "join_inner": ("SELECT o.o_orderkey AS o_orderkey, c.c_custkey AS c_custkey, c_mktsegment AS segment, o_totalprice FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o_totalprice > 100000", "SELECT o_orderkey, c_custkey, c_mktsegment AS segment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000"),
    "join_left": ("SELECT c_custkey, o.o_orderkey AS k FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 300000", "SELECT c_custkey, o_orderkey AS k FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000"),
    "join_group": ("SELECT r.r_name AS r_name, n_name, count(*) AS n, round(sum(l_extendedprice), 2) AS v FROM lineitem l JOIN orders ON l_orderkey = o_orderkey INNER JOIN customer c ON o_custkey = c_custkey JOIN nation ON c.c_nationkey = n_nationkey LEFT OUTER JOIN region r ON n_regionkey = r_regionkey GROUP BY r.r_name, n_name ORDER BY v DESC, n_name LIMIT 15", "SELECT r_name, n_name, count(*) AS n, round(sum(l_extendedprice), 2) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name ORDER BY v DESC, n_name LIMIT 15"),
    "join_self": ("SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"),
    "join_star": ("SELECT r.*, n.n_name AS n_name FROM nation n JOIN region r ON n_regionkey = r_regionkey", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "fn_left_null": ("SELECT n_nationkey, left(n_name, nullif(n_regionkey, 1)) AS l FROM nation", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CASE WHEN n_regionkey <> 1 THEN left(n_name, n_regionkey) END AS l FROM nation"),
    "fn_now": ("SELECT count(*) AS n FROM region WHERE now() = now() AND r_regionkey >= 0", "SELECT count(*) AS n FROM region"),
    "no_from": ("SELECT 1+2*3 AS a, upper('x') AS b", "SELECT CAST(1+2*3 AS BIGINT) AS a, upper('x') AS b"),
}


def _engine(spark: SparkSession, sf_dir: str, text: str) -> Engine:
    return over_parquet(spark, {t: f"{sf_dir}/{t}.parquet" for t in TABLES if t in text})


def dialect_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _engine(spark, sf_dir, text).sql(text)


def _catalog(spark: SparkSession) -> Engine:
    """An engine whose datasets live in the shared folder, if the cluster names one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return Engine(spark, f"{shared}/datasets" if shared else None)


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations as CSV text, loaded with inferred types, and queried."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").collect()  # 25 of them at any scale
    text = "Nation Key,nName,Region-Key\n" + "".join(f'{r["n_nationkey"]},"{r["n_name"]}",{r["n_regionkey"]}\n' for r in rows)
    e = _catalog(spark)
    e.catalog.load(text.encode(), "nations from csv")
    return e.sql("SELECT nation_key, n_name, region_key FROM nations_from_csv WHERE nation_key > 2")


def tsv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tab-separated text, in which a row repeats the header."""
    rows = spark.read.parquet(f"{sf_dir}/region.parquet").collect()  # 5 of them at any scale
    e = _catalog(spark)
    e.catalog.load(("name\tword\n" + "".join(f'{r["r_name"]}\t"{r["r_regionkey"]}\n' for r in rows) + "name\tword\n").encode(), "tabs")
    return e.sql("SELECT name, word FROM tabs")


def _packed(pack: Callable[[bytes], bytes], name: str) -> Callable[[SparkSession, str], DataFrame]:
    """Text that hardly packs, so that a block of it is longer than a sample."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = "k;hash\n" + "".join(f"{i};{hashlib.md5(str(i).encode()).hexdigest()}\n" for i in range(PACKED_ROWS))
        e = _catalog(spark)
        e.catalog.load(pack(text.encode()), name)
        return e.sql(f"SELECT k, hash FROM {name}")

    return query


def schema_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV under a given schema: keys stay texts, nothing is inferred."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").collect()
    e = _catalog(spark)
    e.catalog.load(("key,name\n" + "".join(f"{r['n_nationkey']},{r['n_name']}\n" for r in rows)).encode(), "typed", T.StructType([T.StructField("key", T.StringType()), T.StructField("name", T.StringType())]))
    return e.sql("SELECT key, name, key < '2' AS low FROM typed")


def map_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _catalog(spark)
    e.catalog.load_map("from_map", {"b": ["x", "", "z"], "a": ["1", "2", ""]})
    return e.sql("SELECT a, b FROM from_map")


def folder_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file of a folder is a dataset."""
    e = _catalog(spark)
    folder = f"{e.catalog.folder}/folder-{uuid.uuid4().hex}"
    for name, raw in (("one.csv", b"a,b\n1,x\n"), ("two.csv", b"a;c\n1;2.5\n1;4\n")):
        e.catalog.files.write(f"{folder}/{name}", raw)
    e.catalog.load_folder(folder)
    return e.sql("SELECT one.a AS a, b, sum(c) AS s FROM one JOIN two ON one.a = two.a GROUP BY one.a, b")


def padded_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").collect()
    e = _catalog(spark)
    e.catalog.load(("name,n\n" + "".join(f"\" \t{r['n_name']}  \",1\n" for r in rows)).encode(), "padded")
    return e.sql("SELECT trim(name) AS name FROM padded WHERE name != trim(name)")


def json_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON answer, read back."""
    got = json.loads(_engine(spark, sf_dir, "nation").json("SELECT n_name, n_regionkey, nullif(n_nationkey, n_nationkey) AS nothing FROM nation WHERE n_nationkey < 9 ORDER BY n_name"))
    return spark.createDataFrame([tuple(r) for r in got["data"]], ", ".join(f"{c['name']} {types.SPARK[c['dtype']].simpleString()}" for c in got["schema"]))


def dataset_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An old version of a dataset that was loaded twice."""
    e = _catalog(spark)
    old = e.catalog.add("area", spark.read.parquet(f"{sf_dir}/region.parquet"))
    e.catalog.add("area", spark.read.parquet(f"{sf_dir}/nation.parquet"))
    return e.sql(f"SELECT r_regionkey, r_name FROM area@v{old['id']}")


QUERIES = {name: dialect_query(x if isinstance(x, str) else x[0]) for name, x in DIALECT.items()} | {
    "csv_roundtrip": csv_roundtrip, "tsv_roundtrip": tsv_roundtrip, "gzip_roundtrip": _packed(gzip.compress, "zipped"), "bzip2_roundtrip": _packed(bz2.compress, "blocks"), "schema_load": schema_load,
    "map_load": map_load, "folder_load": folder_load, "padded_trim": padded_trim, "json_result": json_result, "dataset_version": dataset_version,
}
SQL = {name: x if isinstance(x, str) else x[1] for name, x in DIALECT.items()} | {
    "csv_roundtrip": "SELECT CAST(n_nationkey AS BIGINT) AS nation_key, n_name, CAST(n_regionkey AS BIGINT) AS region_key FROM nation WHERE n_nationkey > 2",
    "tsv_roundtrip": "SELECT r_name AS name, '\"' || r_regionkey AS word FROM region UNION ALL SELECT 'name', 'word'",
    "gzip_roundtrip": f"SELECT i AS k, md5(CAST(i AS VARCHAR)) AS hash FROM range({PACKED_ROWS}) t(i)",
    "bzip2_roundtrip": f"SELECT i AS k, md5(CAST(i AS VARCHAR)) AS hash FROM range({PACKED_ROWS}) t(i)",
    "schema_load": "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name, CAST(n_nationkey AS VARCHAR) < '2' AS low FROM nation",
    "map_load": "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'x'), (2, ''), (NULL, 'z')) t(a, b)",
    "folder_load": "SELECT CAST(1 AS BIGINT) AS a, 'x' AS b, 6.5::DOUBLE AS s",
    "padded_trim": "SELECT n_name AS name FROM nation",
    "json_result": "SELECT n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey, CAST(NULL AS BIGINT) AS nothing FROM nation WHERE n_nationkey < 9",
    "dataset_version": "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region",
}
