"""Works, references and embeddings over the test tables, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A work for each document. Valid in both dialects.
WORKS = r"""
SELECT doc_id AS work_id,
       CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN concat('https://doi.org/10.1234/W', CAST(doc_id AS STRING))
            WHEN doc_id % 5 = 2 THEN concat('doi:10.1234/w', CAST(doc_id - 1 AS STRING)) WHEN doc_id % 5 = 3 THEN concat(' 10.5555/X', CAST(doc_id AS STRING), ' ')
            ELSE concat('http://dx.doi.org/10.1234/w', CAST(doc_id - 3 AS STRING)) END AS doi,
       split_part(text, chr(10), 1) AS title, text AS abstract, CAST(1995 + doc_id % 7 AS INT) AS year, source AS venue, lang, source,
       concat(source, '-', CAST(doc_id AS STRING)) AS source_id, CAST((doc_id * 37) % 101 AS INT) AS cited_by_count, CAST(doc_id % 4 AS INT) AS source_count,
       CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 11 = 1 THEN '' ELSE concat('Author', CAST(doc_id % 50 AS STRING), ', A.; Other, B.') END AS first_author,
       concat(lang, '; ', source, '; k', CAST(doc_id % 13 AS STRING)) AS keywords, CAST(CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END AS INT) AS from_grey,
       CAST(CASE WHEN doc_id % 17 = 0 THEN 1 ELSE 0 END AS INT) AS from_teaching
FROM documents
"""
#: A citation edge for each pair of orders and parts: part (cited) by order (citing), with both years.
EDGES = """
SELECT l_orderkey AS source_id, l_partkey AS ref_id, CAST(year(o_orderdate) AS INT) AS source_year, CAST(1990 + l_partkey % 12 AS INT) AS ref_year
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""
#: Works as parts sold: venue is the brand, year that of the order, citations the lines.
PAPERS = """
SELECT l_partkey AS work_id, p_brand AS venue, p_type AS kind, CAST(year(o_orderdate) AS INT) AS year, l_orderkey AS source_id, l_extendedprice AS price
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
"""
#: Citations inside one set of works: each order cites those up to 60 keys back that share its customer's last digit.
INNER_EDGES = """
SELECT a.o_orderkey AS source_id, b.o_orderkey AS ref_id, CAST(year(a.o_orderdate) AS INT) AS source_year, CAST(year(b.o_orderdate) AS INT) AS ref_year
FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderkey < a.o_orderkey
"""
_NEEDS = {"works": ("documents",), "edges": ("lineitem", "orders"), "papers": ("lineitem", "orders", "part"), "inner_edges": ("orders",)}
ROWS = 1_000_000
_TEXT = {"works": WORKS, "edges": EDGES, "papers": PAPERS, "inner_edges": INNER_EDGES}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the proxies as a DataFrame; the scan it starts from is pruned by what a query uses."""
    tables = {t: read(spark, sf_dir, t) for t in _NEEDS[name]}
    if name == "edges":
        # a task's join, and what follows on the same key, holds about ROWS lines, however many there are
        parts = tables["lineitem"].count() // ROWS
        if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
            tables = {t: d.repartition(parts, {"lineitem": "l_orderkey", "orders": "o_orderkey"}[t]) for t, d in tables.items()}
    text = _TEXT[name]
    for t in tables:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}} {t}").replace(f"JOIN {t}", f"JOIN {{{t}}} {t}") if name != "inner_edges" else text
    if name == "inner_edges":
        text = text.replace("FROM orders a JOIN orders b", "FROM {orders} a JOIN {orders} b")
    return spark.sql(text, **tables)


def sql(name: str) -> str:
    return f"{name} AS ({_TEXT[name]})"
