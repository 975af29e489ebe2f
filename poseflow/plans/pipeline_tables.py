"""Queries that write files in the shared folder and read them back: A1, A2, A7, A8, A16-A19."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import poses
from ..sources import files, text
from ..tables import Scratch
from .registry import Registry
from .views import table, view

REGISTRY = query = Registry()


@query("SELECT complex, code, score FROM v_pose")
def delimited_scores(spark, d):
    path = Scratch(spark, "scores").path("table")
    view(spark, d, "v_pose").select(F.format_string("%d,\t%s  %s", "complex", "code", F.col("score").cast("string")).alias("value")).write.text(path)
    return text.read_delimited(spark, path, {"complex": "bigint", "code": "string", "score": "double"}).drop("path")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY complex ORDER BY score DESC, code) AS k FROM v_pose),
b AS (SELECT complex, n, coalesce(min(rmsd) FILTER (WHERE k <= n) <= 2, false) AS ok FROM r, (SELECT unnest([1, 2, 3]) AS n) GROUP BY complex, n)
SELECT CAST(n AS INTEGER) AS k, avg(CAST(ok AS DOUBLE)) AS rate FROM b GROUP BY n""")
def written_report(spark, d):
    path = Scratch(spark, "report").path("table")
    files.write_report(poses.pose_success(view(spark, d, "v_pose")), path)
    return spark.read.option("sep", "\t").option("header", True).schema("k int, n_complexes long, n_success long, rate double").csv(path).select("k", "rate")


@query("SELECT CASE WHEN length(o_custkey::VARCHAR) < 4 THEN lpad(o_custkey::VARCHAR, 4, '0') ELSE o_custkey::VARCHAR END AS code, o_orderkey FROM orders")
def stored_pairs(spark, d):
    path = Scratch(spark, "pairs").path("table")
    # Codes of at least four digits: lpad to four would cut longer ones.
    key = F.col("o_custkey").cast("string")
    pairs = table(spark, d, "orders").select(F.when(F.length(key) < 4, F.lpad(key, 4, "0")).otherwise(key).alias("code"), "o_orderkey")
    files.write_pairs(pairs, path)
    return files.load_pairs(spark, path, pairs.select("code")).select(F.col("code").cast("string").alias("code"), "o_orderkey")


@query("SELECT o_custkey, count(*) AS n, sum(l_quantity) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey")
def bucketed_pairs(spark, d):
    """Two tables in buckets by order: their join has no exchange."""
    scratch = Scratch(spark, "buckets")
    names = [f"poseflow_{x}_{scratch.root[-12:]}" for x in ("orders", "lines")]
    keys = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), "o_custkey")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), "l_quantity")
    for name, df in zip(names, (keys, lines)):
        files.write_bucketed(df, name, ["key"], 16, scratch.path(name))
    return spark.table(names[0]).join(spark.table(names[1]), "key").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("SELECT CAST(o_custkey % 20 AS VARCHAR) AS part, count(*) AS n, sum(o_orderkey) AS keys FROM orders GROUP BY ALL")
def resumed_parts(spark, d):
    """A first run that ends half way, and a second one that writes the rest."""
    path = Scratch(spark, "resumed").path("table")
    orders = table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("part"), "o_orderkey")
    files.write_resumable(orders.where("part < 9"), path, "part")
    files.write_resumable(orders, path, "part")
    return spark.read.schema("o_orderkey long, part string").parquet(path).groupBy("part").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("SELECT lower(c_name) AS id FROM customer UNION ALL SELECT lower(c_mktsegment) FROM customer")
def id_lists(spark, d):
    path = Scratch(spark, "ids").path("list")
    table(spark, d, "customer").select(F.concat_ws(",", "c_name", "c_mktsegment").alias("value")).write.text(path)
    return text.read_id_dir(spark, path)


@query("SELECT o_custkey::VARCHAR AS key, string_agg(k, ' ' ORDER BY k) AS rows FROM (SELECT o_custkey, o_orderkey || '-' || o_orderstatus AS k FROM orders) GROUP BY o_custkey")
def multimaps(spark, d):
    path = Scratch(spark, "multimap").path("table")
    table(spark, d, "orders").select(F.concat_ws(";", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderstatus").alias("value")).write.text(path)
    return text.read_multimap(spark, path, ";", 1, [0, 2]).select("key", F.array_join(F.array_sort(F.transform("rows", lambda r: F.array_join(r, "-"))), " ").alias("rows"))


@query("SELECT '>' || c_name || '-0-A' || chr(10) || upper(c_mktsegment) AS value FROM customer")
def fasta_records(spark, d):
    return files.fasta(table(spark, d, "customer").select(F.col("c_name").alias("name"), F.lit(0).alias("model"), F.lit("A").alias("chain"), F.upper("c_mktsegment").alias("sequence")))
