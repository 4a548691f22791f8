"""Statistics over participants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def allele_statistics(calls: DataFrame) -> DataFrame:
    """Per locus and allele over calls (chrom, pos, ref, alts, alleles, rsid, row): count, number, hom, het, frequency text, first rsid.

    Only calls of exactly two known alleles count. A homozygous call adds two to ``num_homo``.
    """
    known = F.transform(F.concat(F.array("ref"), "alts"), lambda a: F.upper(a))
    ok = F.filter(F.transform("alleles", lambda a: F.upper(a)), lambda a: F.array_contains(known, a))
    called = calls.select("chrom", "pos", "rsid", "row", ok.alias("ok")).where(F.size("ok") == 2)
    each = called.select("chrom", "pos", "rsid", "row", (F.col("ok")[0] == F.col("ok")[1]).alias("homo"), F.explode("ok").alias("allele"))
    by = each.groupBy("chrom", "pos", "allele").agg(
        F.count(F.lit(1)).alias("allele_count"), F.sum(F.col("homo").cast("int")).alias("num_homo"), F.sum((~F.col("homo")).cast("int")).alias("num_hetero"), F.min_by("rsid", F.when(F.col("rsid").isNotNull(), F.col("row"))).alias("rsid")
    )
    # a call has two alleles, so the locus total is the sum over its alleles: one more aggregate over few rows
    number = by.groupBy("chrom", "pos").agg(F.sum("allele_count").alias("allele_number"))
    return by.join(number, ["chrom", "pos"]).withColumn("allele_freq", F.format_string("%.6f", F.col("allele_count") / F.col("allele_number")))


def status_statistics(status: DataFrame, known: list[str]) -> DataFrame:
    """Per status over (pid, status text ``a/b``): count, number, het, hom and frequency text; statuses without participants have zeros."""
    parts = F.filter(F.split("status", "/"), lambda s: s.isin(known))
    each = status.select(parts.alias("p")).select("p", F.explode("p").alias("status"))
    both, same = F.size("p") == 2, F.col("p")[0] == F.col("p")[1]
    got = each.groupBy("status").agg(F.count(F.lit(1)).alias("count"), F.sum((both & ~same).cast("int")).alias("hetero"), (F.sum((both & same).cast("int")) / 2).cast("long").alias("homo"))
    total = got.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("number"))
    all_ = status.sparkSession.createDataFrame([(k,) for k in known], "status string")
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = all_.join(got, "status", "left").withColumn("number", total.scalar())
    return out.select("status", zero(F.col("count")).alias("count"), "number", zero(F.col("hetero")).alias("hetero"), zero(F.col("homo")).alias("homo"), F.format_string("%.6f", F.when(F.col("number") > 0, zero(F.col("count")) / F.col("number")).otherwise(F.lit(0.0))).alias("frequency"))


def apol1_status(site1: Column, site2: Column, g2: Column) -> Column:
    """The pair of haplotypes from three genotypes; any letter but the reference and ``-`` counts as a variant."""
    others = lambda g, ref: F.coalesce(F.length(F.regexp_replace(g, f"[{ref}-]", "")), F.lit(0))
    d = F.coalesce(F.length(F.regexp_replace(g2, "[^D]", "")), F.lit(0))
    a, b = others(site1, "A"), others(site2, "T")
    g1 = F.when((a > 0) & (b > 0), a + b).otherwise(0)
    return (
        F.when(site1.isNull() & site2.isNull() & g2.isNull(), "G-/G-").when(d == 2, "G2/G2").when((d == 1) & (g1 >= 2), "G2/G1").when(d == 1, "G2/G0")
        .when(g1 == 4, "G1/G1").when(g1 >= 2, "G1/G0").otherwise("G0/G0")
    )


def merge_replicates(rows: DataFrame, key: str, genotype: str) -> DataFrame:
    """No-calls drop, agreement stays, disagreement and nothing left give ``--``."""
    call = F.when(~F.col(genotype).isin("--", ""), F.col(genotype))
    # least and greatest are enough to tell one value from several
    got = rows.groupBy(key).agg(F.min(call).alias("lo"), F.max(call).alias("hi"))
    return got.select(key, F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.lit("--")).alias(genotype))


def merge_in_order(rows: DataFrame, keys: list[str], order: str, genotype: str) -> DataFrame:
    """The order-dependent form: a first no-call is replaced, two differing calls give ``--``, and a later call replaces that again."""
    seq = F.transform(F.array_sort(F.collect_list(F.struct(order, genotype))), lambda s: s[genotype])
    none = lambda g: g.isin("--", "")
    step = lambda s, g: F.when(s.isNull() | none(s), g).when(none(g) | (s == g), s).otherwise(F.lit("--"))
    return rows.where(F.col(genotype).isNotNull()).groupBy(*keys).agg(F.aggregate(seq, F.lit(None).cast("string"), step).alias(genotype))
