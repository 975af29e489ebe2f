"""Views over the given tables in the shape of docking data, for Spark and, as SQL, for DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: SQL that both engines read; {0}, {1} ... are places in arrays, which Spark counts from 0 and DuckDB from 1.
VIEWS: dict[str, str] = {
    "v_pose": "SELECT l_orderkey AS complex, concat_ws('-', l_orderkey, l_partkey, l_suppkey) AS code, l_quantity / 5 AS rmsd, l_extendedprice AS score FROM lineitem",
    "v_core": "SELECT l_orderkey AS target, concat_ws('-', l_orderkey, l_partkey, l_suppkey) AS code, l_quantity / 5 AS logKa, l_extendedprice / 10000 AS score FROM lineitem",
    "v_screen": "SELECT l_suppkey AS target, l_partkey AS ligand, l_extendedprice AS score FROM lineitem",
    "v_actives": "SELECT target, CAST(k AS INT) AS rank, ligand FROM (SELECT target, ligand, row_number() OVER (PARTITION BY target ORDER BY d, ligand) AS k FROM (SELECT l_suppkey AS target, l_partkey AS ligand, min(l_shipdate) AS d FROM lineitem GROUP BY l_suppkey, l_partkey) AS t) AS u WHERE k <= 10",
    "v_ligand_info": "SELECT o_orderkey AS code, o_custkey AS grp, o_orderkey % 100 AS t1 FROM orders",
    "v_points": "SELECT vec_id AS id, label AS k, CAST(embedding[{0}] AS DOUBLE) AS x, CAST(embedding[{1}] AS DOUBLE) AS y, CAST(embedding[{2}] AS DOUBLE) AS z FROM embeddings",
    "v_atoms": "SELECT label AS pdb_name, CAST(vec_id % 4 AS VARCHAR(9)) AS chain, vec_id % 40 AS residue, vec_id AS aid, CAST(embedding[{0}] AS DOUBLE) AS x, CAST(embedding[{1}] AS DOUBLE) AS y, CAST(embedding[{2}] AS DOUBLE) AS z FROM embeddings",
    "v_pred": "SELECT label AS complex, vec_id AS atom_idx, CAST(embedding[{0}] AS DOUBLE) AS px, CAST(embedding[{1}] AS DOUBLE) AS py, CAST(embedding[{2}] AS DOUBLE) AS pz, CAST(embedding[{3}] AS DOUBLE) AS tx, CAST(embedding[{4}] AS DOUBLE) AS ty, CAST(embedding[{5}] AS DOUBLE) AS tz FROM embeddings",
    "v_binary": "SELECT d.doc_id, lang, n_chars / (n_chars + 2000.0D0) AS score, quality AS y FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
    "v_feat": "SELECT o_orderkey AS id, o_custkey AS k, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS value FROM orders",
    "v_cand": "SELECT s_name AS protein_name, p_name AS smiles, concat(p_partkey, '-', s_suppkey) AS pocket_name, s_acctbal / 1000 + p_retailprice / 1000 AS affinity FROM supplier CROSS JOIN part",
    "v_chain": "SELECT user_id AS k, event_id AS id, ts, CAST(value AS DOUBLE) AS x, value * value * (event_id % 7) / 100 AS y, CAST(event_id % 10 AS DOUBLE) AS z FROM events",
}

def drawn(seed: int, *keys: str) -> str:
    """DuckDB's SQL for `hash_uniform`."""
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(keys)}, '{seed}')), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE)"


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name].format(*range(8)).replace("2000.0D0", "2000.0D").replace("VARCHAR(9)", "STRING")
    used = [t for t in TABLES if f" {t}" in sql]
    return spark.sql(_bind(sql, used), **{t: table(spark, sf_dir, t) for t in used})


def _bind(sql: str, used: list[str]) -> str:
    """Puts the tables' names in braces, for spark.sql's arguments."""
    return re.sub(rf"\b(FROM|JOIN) ({'|'.join(used)})\b", r"\1 {\2}", sql)


def with_views(sql: str) -> str:
    """SQL for DuckDB with the views that it names before it; sql may begin with its own `WITH `."""
    names = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    if not names:
        return sql
    head = ", ".join(f"{n} AS ({VIEWS[n].format(*range(1, 9)).replace('2000.0D0', '2000.0')})" for n in names)
    body = sql.lstrip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[15:]}"
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"
