"""Genomic tables stated in integer arithmetic over the star-schema tables, for Spark and for SQL engines alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Columns of each adapter: (base table, [(name, expression)]). Expressions hold in Spark SQL and in DuckDB alike.
_START = "(l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 1299709) % 2000000"
_LENGTH = "(35 + (l_orderkey * 31 + l_partkey * 17 + l_linenumber * 7) % 966)"
_GENE = "(c_custkey * 9973) % 1990000"
_REGION = "(p_partkey * 7717) % 1990000"

ADAPTERS: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "fragments": ("lineitem", [("frag_id", "l_orderkey * 10 + l_linenumber"), ("sample_id", "l_orderkey % 8"), ("chrom", "cast(1 + l_suppkey % 22 as varchar(8))"), ("start", _START), ("end", f"{_START} + {_LENGTH}"), ("length", _LENGTH), ("gc_pct", "30 + 4 * cast(round(l_discount * 100) as int)"), ("flag", "(l_orderkey * 13 + l_linenumber * 5 + l_partkey) % 2048"), ("mapq", "l_partkey % 61"), ("evidence", "l_returnflag"), ("plus", "l_linestatus = 'F'")]),
    "genes": ("customer", [("gene_idx", "c_custkey"), ("chrom", "cast(1 + c_custkey % 22 as varchar(8))"), ("start", _GENE), ("end", f"{_GENE} + 200 + c_custkey % 800"), ("gene", "'G' || cast(c_custkey % 50 as varchar(8))"), ("nation", "c_nationkey")]),
    "regions": ("part", [("region_idx", "p_partkey"), ("chrom", "cast(1 + p_partkey % 22 as varchar(8))"), ("start", _REGION), ("end", f"{_REGION} + 200 + p_partkey % 800"), ("label", "p_type"), ("plus", "p_size % 2 = 0")]),
    "blacklist": ("supplier", [("chrom", "cast(1 + s_suppkey % 22 as varchar(8))"), ("start", "(s_suppkey * 31337) % 1990000"), ("end", "(s_suppkey * 31337) % 1990000 + 5000")]),
    "variants": ("orders", [("variant_id", "o_orderkey"), ("chrom", "cast(1 + o_custkey % 22 as varchar(8))"), ("pos", "(o_orderkey * 7919) % 2000000"), ("ref", "case o_orderkey % 5 when 0 then 'A' when 1 then 'AC' when 2 then 'A' when 3 then 'AC' else 'ACG' end"), ("alt", "case o_orderkey % 5 when 0 then 'T' when 1 then 'GT' when 2 then 'AT' when 3 then 'A' else 'TT' end")]),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def adapted(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, columns = ADAPTERS[name]
    return table(spark, sf_dir, base).selectExpr(*[f"{e.replace('varchar(8)', 'string')} as `{c}`" for c, e in columns])


def cte(name: str) -> str:
    """The adapter as a common table expression in standard SQL."""
    base, columns = ADAPTERS[name]
    return f"{name} AS (SELECT " + ", ".join(f'{e} AS "{c}"' for c, e in columns) + f" FROM {base})"


def with_sql(*names: str, body: str) -> str:
    return "WITH " + ", ".join(cte(n) for n in names) + " " + body
