"""Pileups, depth and CIGAR walks over decoded reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of the read flag.
UNMAPPED, SECONDARY, QC_FAIL, DUPLICATE, PAIRED, PROPER, REVERSE = 4, 256, 512, 1024, 1, 2, 16
LEAST_QUALITY = 13
OPS = "array<struct<kind:string,len:int>>"


def has(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(F.lit(bit)) != 0


def read_filter(flag: Column) -> Column:
    """Why a read is left out of a SNP pileup, first reason first; null where it stays. Supplementary reads stay."""
    return (
        F.when(has(flag, UNMAPPED), "unmapped").when(has(flag, SECONDARY), "secondary").when(has(flag, QC_FAIL), "qc_fail").when(has(flag, DUPLICATE), "duplicate")
        .when(has(flag, PAIRED) & ~has(flag, PROPER), "improper_pair")
    )


def snp_pileup(bases: DataFrame, keys: list[str], ref: Column, alt: Column) -> DataFrame:
    """Counters per locus over bases (base, qual, flag): filters, raw and filtered depth and counts, per base and strand."""
    why = read_filter(F.col("flag"))
    stays = why.isNull()
    base = F.upper("base")
    acgt = base.isin("A", "C", "G", "T")
    good = stays & (F.col("qual") >= LEAST_QUALITY)
    n = lambda c, name: F.count_if(c).alias(name)
    per = [n(stays & (base == b), f"raw_{b.lower()}") for b in "ACGT"] + [n(good & (base == b), f"filtered_{b.lower()}") for b in "ACGT"] + [n(stays & (base == b) & has(F.col("flag"), REVERSE), f"reverse_{b.lower()}") for b in "ACGT"]
    return bases.groupBy(*keys).agg(
        *[n(why == w, f"filtered_{w}") for w in ("unmapped", "secondary", "qc_fail", "duplicate", "improper_pair")],
        n(stays & acgt, "raw_depth"), n(stays & (base == ref), "raw_ref"), n(stays & (base == alt), "raw_alt"), n(stays & (F.col("qual") < LEAST_QUALITY), "low_quality"),
        n(good & ~acgt, "non_acgt"), n(good & acgt, "depth"), n(good & (base == ref), "ref_count"), n(good & (base == alt), "alt_count"), *per,
    )


def parse_cigar(cigar: Column) -> Column:
    """``5M2I`` as an array of kinds and lengths."""
    kinds, lens = F.regexp_extract_all(cigar, F.lit(r"\d+([MIDNSHP=X])"), F.lit(1)), F.regexp_extract_all(cigar, F.lit(r"(\d+)[MIDNSHP=X]"), F.lit(1))
    return F.zip_with(kinds, lens, lambda k, n: F.struct(k.alias("kind"), n.cast("int").alias("len")))


def index_at(cigar: Column, start: Column, target: Column) -> Column:
    """The 0-based index in the read of the base at a reference position; null in a gap and outside the read."""
    state = "struct<ref:bigint,read:bigint,hit:bigint>"
    zero = F.struct(start.cast("long").alias("ref"), F.lit(0).cast("long").alias("read"), F.lit(None).cast("long").alias("hit")).cast(state)

    def step(s: Column, op: Column) -> Column:
        k, n = op["kind"], op["len"]
        match, gap = k.isin("M", "=", "X"), k.isin("D", "N")
        here = match & (target >= s["ref"]) & (target < s["ref"] + n) & s["hit"].isNull()
        return F.struct((s["ref"] + F.when(match | gap, n).otherwise(0)).alias("ref"), (s["read"] + F.when(match | k.isin("I", "S"), n).otherwise(0)).alias("read"), F.when(here, s["read"] + target - s["ref"]).otherwise(s["hit"]).alias("hit")).cast(state)

    return F.aggregate(cigar, zero, step)["hit"]


def indel_at(cigar: Column, start: Column, anchor: Column) -> Column:
    """The insertion or deletion right after an anchor base: its kind and length, or null."""
    state = "struct<ref:bigint,kind:string,len:int>"
    zero = F.struct(start.cast("long").alias("ref"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("int").alias("len")).cast(state)

    def step(s: Column, op: Column) -> Column:
        k, n = op["kind"], op["len"]
        here = k.isin("I", "D") & (s["ref"] - 1 == anchor) & s["kind"].isNull()
        return F.struct((s["ref"] + F.when(k.isin("M", "=", "X", "N", "D"), n).otherwise(0)).alias("ref"), F.when(here, k).otherwise(s["kind"]).alias("kind"), F.when(here, n).otherwise(s["len"]).alias("len")).cast(state)

    got = F.aggregate(cigar, zero, step)
    return F.when(got["kind"].isNotNull(), F.struct(got["kind"].alias("kind"), got["len"].alias("len")))


def observed_length(cigar: Column, start: Column, stop: Column, lo: Column, hi: Column, ref_len: Column) -> Column:
    """The length of the reference stretch lo..hi as the read has it; null where the read does not cover it."""
    hits = F.filter(F.transform(F.sequence(lo - 1, hi), lambda a: indel_at(cigar, start, a)), lambda x: x.isNotNull())
    first = F.try_element_at(hits, F.lit(1))
    return F.when((start <= lo) & (stop >= hi), F.when(first["kind"] == "I", ref_len + first["len"]).when(first["kind"] == "D", F.greatest(ref_len - first["len"], F.lit(0))).otherwise(ref_len))


def depth_summary(depths: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """Summary of depth per region (keys, lo, hi) over (keys, pos, depth): positions without a row have 0; population deviation, exact median.

    Positions are not expanded: uncovered ones enter the sums as a count, and the median comes from the counts per depth.
    """
    d = depths.join(regions, keys).where(F.col("pos").between(F.col("lo"), F.col("hi")) & (F.col("depth") > 0))
    per = d.groupBy(*keys, "depth").agg(F.count(F.lit(1)).alias("n"))
    tot = per.groupBy(*keys).agg(F.sum("n").alias("covered"), F.sum(F.col("n") * F.col("depth")).alias("s"), F.sum(F.col("n") * F.col("depth") * F.col("depth")).alias("ss"), F.min("depth").alias("least"), F.max("depth").alias("max"), F.array_sort(F.collect_list(F.struct("depth", "n"))).alias("hist"))
    n = F.col("hi") - F.col("lo") + 1
    r = regions.join(tot, keys, "left").withColumns({"n": n, "zero": n - F.coalesce("covered", F.lit(0))})
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    at = lambda k: F.when(k <= F.col("zero"), F.lit(0)).otherwise(F.aggregate("hist", F.struct(F.col("zero").cast("long").alias("c"), F.lit(-1).cast("long").alias("v")), lambda s, h: F.struct((s["c"] + h["n"]).alias("c"), F.when((s["v"] < 0) & (s["c"] + h["n"] >= k), h["depth"].cast("long")).otherwise(s["v"]).alias("v")))["v"])
    mean = z("s") / F.col("n")
    return r.select(
        *keys, mean.alias("mean"), ((at(F.floor((F.col("n") + 1) / 2)) + at(F.floor(F.col("n") / 2) + 1)) / 2.0).alias("median"), F.sqrt(F.greatest(z("ss") / F.col("n") - mean * mean, F.lit(0.0))).alias("stdev"),
        F.when(F.col("zero") > 0, F.lit(0)).otherwise(z("least")).cast("long").alias("min"), z("max").cast("long").alias("max"), F.col("n").alias("region_length"), F.col("zero").alias("uncovered_bases"), (F.col("zero") / F.col("n") * 100).alias("percent_uncovered"),
    )
