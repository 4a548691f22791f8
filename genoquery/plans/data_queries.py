"""Queries of the general data problems: hot keys, packed fields, failing lines, drifting layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoquery.operators import packed, rawlines, skew
from genoquery.session import table

CHUNK_ROWS = 50_000
HOT_SHARE = 10  # a hot key holds at least one row in so many
PACKED = ["gene", "clnsig", "clnrevstat"]


def _chrom() -> F.Column:
    return F.nullif(F.regexp_replace(F.trim("chrom"), "^(?i:chr)", ""), F.lit(""))


def _observations(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    rows = table(spark, sf_dir, "observations").select("*", F.col("_metadata"))
    return skew.with_file_order(rows).select(skew.BLOCK, skew.AT, _chrom().alias("key_value"), *columns)


def _genes(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    rows = table(spark, sf_dir, "thalassemia_clinvar").select("*", F.col("_metadata"))
    genes = F.explode(F.array_distinct(packed.split_packed(F.col("gene"))))
    return skew.with_file_order(rows).select(skew.BLOCK, skew.AT, genes.alias("key_value"), *columns)


def _sizes(rows: DataFrame) -> DataFrame:
    return skew.chunked(rows, "key_value", [F.count(F.lit(1)).alias("n")], [F.sum("n").alias("n")], CHUNK_ROWS)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that hold at least a tenth of all rows of their table; null keys count towards the total only."""
    parts = []
    for name, rows in (("observations", _observations(spark, sf_dir)), ("thalassemia_clinvar", _genes(spark, sf_dir))):
        total = table(spark, sf_dir, name).agg(F.count(F.lit(1)).alias("total"))
        hot = _sizes(rows).where(F.col("n") * HOT_SHARE >= total.scalar())
        parts.append(hot.select(F.lit(name).alias("table_name"), "key_value"))
    return parts[0].unionByName(parts[1])


def p2_chrom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per chromosome: rows, rows with a variant, and the longest run of variant rows in delivery order."""
    rows = _observations(spark, sf_dir, "outcome")
    return skew.key_runs(rows, "key_value", F.col("outcome") == "variant", CHUNK_ROWS).withColumnsRenamed({"key_value": "chrom", "hits": "variants"})


def p2_chrom_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per chromosome: rows, usable depths, their sum, and the first and last record in delivery order."""
    rows = _observations(spark, sf_dir, "depth", "record_id")
    good = F.when(F.col("depth") >= 0, F.col("depth"))
    states = [F.count(F.lit(1)).alias("n"), F.count(good).alias("d"), F.sum(good).alias("s"), F.min_by("record_id", "__n").alias("a"), F.max_by("record_id", "__n").alias("b")]
    merges = [F.sum("n").alias("rows"), F.sum("d").alias("usable"), F.sum("s").alias("depth_sum"), F.min_by("a", "__chunk").alias("first_record"), F.max_by("b", "__chunk").alias("last_record")]
    return skew.chunked(rows, "key_value", states, merges, CHUNK_ROWS).withColumnRenamed("key_value", "chrom")


def p2_gene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per single gene: rows, positions seen and the span of positions; a row that names several genes counts for each."""
    rows = _genes(spark, sf_dir, "position")
    states = [F.count(F.lit(1)).alias("n"), F.count("position").alias("p"), F.min("position").alias("a"), F.max("position").alias("b")]
    merges = [F.sum("n").alias("rows"), F.sum("p").alias("positions"), F.min("a").alias("first_position"), F.max("b").alias("last_position")]
    return skew.chunked(rows, "key_value", states, merges, CHUNK_ROWS).withColumnRenamed("key_value", "gene")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of every field that holds two or more."""
    return packed.unpack(table(spark, sf_dir, "thalassemia_clinvar"), "row_id", PACKED, at_least=2)


def p4_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of the three packed fields, single ones too."""
    return packed.unpack(table(spark, sf_dir, "thalassemia_clinvar"), "row_id", PACKED)


def _raw(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return rawlines.parse(rawlines.read_lines({"ancestrydna_csv": table(spark, sf_dir, "ancestrydna_csv_sample"), "familytreedna": table(spark, sf_dir, "familytreedna_sample")}))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each failed data line with the first reason that applies."""
    return rawlines.failures(_raw(spark, sf_dir)[0])


def p5_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data lines that load, typed."""
    return rawlines.consistent(_raw(spark, sf_dir)[0]).where(F.size("failed_casts") == 0).drop("failed_casts")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each difference between a file and its vendor's base layout."""
    return rawlines.changes(_raw(spark, sf_dir)[1])


def p6_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All data lines of all files in one layout, with the fields whose cast failed, or what is wrong with the line."""
    return rawlines.consistent(_raw(spark, sf_dir)[0])


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_chrom, p2_chrom_depth, p2_gene, p4_found, p4_values, p5_found, p5_valid, p6_found, p6_table)}


_PIECES = r"""select row_id, field, list_transform(regexp_extract_all(v, '("[^"]*"|''[^'']*''|,_|[^|;/&,])+'), lambda x: trim(x)) as raw from (
  select row_id, 'gene' as field, gene as v from thalassemia_clinvar union all select row_id, 'clnsig', clnsig from thalassemia_clinvar union all select row_id, 'clnrevstat', clnrevstat from thalassemia_clinvar)"""
_LISTS = f"""select row_id, field, list_filter(list_transform(raw, lambda x: trim(case when regexp_full_match(x, '"[^"]*"|''[^'']*''') then substr(x, 2, length(x) - 2) else x end)), lambda x: x <> '') as vals from ({_PIECES})"""


def _unnest(at_least: int) -> str:
    return f"select row_id, field, cast(i as int) as ordinal, vals[i] as value from (select row_id, field, vals, unnest(range(1, len(vals) + 1)) as i from ({_LISTS}) where len(vals) >= {at_least})"


_CHROM = "nullif(regexp_replace(trim(chrom), '^(?i:chr)', ''), '')"
_GENES = f"select distinct row_id, value as gene from ({_unnest(1)}) where field = 'gene'"


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"""with n as (select count(*) as t from observations), m as (select count(*) as t from thalassemia_clinvar)
            select 'observations' as table_name, k as key_value from (select {_CHROM} as k, count(*) as c from observations group by 1), n where k is not null and c * 10 >= t
            union all select 'thalassemia_clinvar', gene from (select gene, count(*) as c from ({_GENES}) group by 1), m where c * 10 >= t""",
        "p2_chrom": f"""with o as (select {_CHROM} as chrom, coalesce(outcome = 'variant', false) as v, file_at from read_parquet_order),
            n as (select chrom, v, row_number() over (partition by chrom order by file_at) - row_number() over (partition by chrom, v order by file_at) as g from o where chrom is not null)
            select chrom, sum(c)::bigint as rows, sum(case when v then c else 0 end)::bigint as variants, max(case when v then c else 0 end)::bigint as longest_run from (select chrom, v, g, count(*) as c from n group by 1, 2, 3) group by 1""".replace("from read_parquet_order", "from (select outcome, chrom, row_number() over () as file_at from observations)"),
        "p2_chrom_depth": f"""with o as (select {_CHROM} as chrom, record_id, depth, row_number() over () as file_at from observations)
            select chrom, count(*) as rows, count(depth) filter (where depth >= 0) as usable, cast(sum(depth) filter (where depth >= 0) as bigint) as depth_sum, arg_min(record_id, file_at) as first_record, arg_max(record_id, file_at) as last_record from o where chrom is not null group by 1""",
        "p2_gene": f"select g.gene, count(*) as rows, count(t.position) as positions, min(t.position) as first_position, max(t.position) as last_position from ({_GENES}) g join thalassemia_clinvar t using (row_id) group by 1",
        "p4_found": _unnest(2),
        "p4_values": _unnest(1),
    }
