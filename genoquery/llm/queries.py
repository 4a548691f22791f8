"""Queries of the subpackage and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoquery.llm import leaks, matching, packing, quantiles, reading
from genoquery.session import durable, table

# (measure, percentile, limit, whether a case lies below it)
LIMITS = [("depth", 50, 18.0, True), ("depth", 99, 500.0, False), ("allele_balance", 50, 0.34, True), ("allele_balance", 95, 0.94, True)]
LEAST_VALUES = 150
PCTS = [1, 5, 25, 50, 75, 95, 99]


def _measures(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """assay_id, measure, value of the usable values."""
    o = table(spark, sf_dir, "observations")
    depth = F.when(F.col("depth") >= 0, F.col("depth").cast("double"))
    balance = F.when(F.col("allele_balance").between(0, 1) & ~F.isnan("allele_balance"), F.col("allele_balance"))
    pair = F.array(*[F.struct(F.lit(n).alias("measure"), c.alias("value")) for n, c in (("depth", depth), ("allele_balance", balance))])
    return o.select("assay_id", *more, F.explode(pair).alias("m")).select("assay_id", *more, "m.measure", "m.value").where(F.col("value").isNotNull())


def p1_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of variant_key and variant_id that mean one variant, with a confidence."""
    return matching.match(table(spark, sf_dir, "observations"), table(spark, sf_dir, "variant_catalogue"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs alone."""
    return p1_matches(spark, sf_dir).select("variant_key", "variant_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assays whose percentile lies beyond a limit: decided by the summaries' rank bounds, by an exact count where these leave it open."""
    values = _measures(spark, sf_dir)
    limits: dict[str, list[float]] = {}
    for m, _, x, _ in LIMITS:
        limits.setdefault(m, []).append(x)
    bounds = quantiles.counts_at(quantiles.summarise(values, ["assay_id"], "measure", "value"), ["assay_id", "measure"], limits, "measure")
    rules = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(p).alias("pct"), F.lit(x).alias("x"), F.lit(b).alias("below")) for m, p, x, b in LIMITS])
    each = bounds.where(F.col("n") >= LEAST_VALUES).select("*", F.explode(rules).alias("r")).where((F.col("r.m") == F.col("measure")) & (F.col("r.x") == F.col("limit")))
    rank = F.floor((F.col("r.pct") * F.col("n") + 99) / 100)
    # below the limit: at least `rank` values are below it; above: fewer than `rank` are at most it
    sure = F.when(F.col("r.below"), F.col("lt_lo") >= rank).otherwise(F.col("le_hi") < rank)
    may = F.when(F.col("r.below"), F.col("lt_hi") >= rank).otherwise(F.col("le_lo") < rank)
    judged = durable(each.select("assay_id", "measure", F.col("r.pct").alias("pct"), "limit", F.col("r.below").alias("below"), rank.alias("rank"), sure.alias("sure"), may.alias("may")))
    found = judged.where("sure").select("assay_id", "measure", "pct")
    open_ = judged.where("may and not sure")
    if open_.isEmpty():
        return found
    beyond = F.when(F.col("below"), F.col("value") < F.col("limit")).otherwise(F.col("value") <= F.col("limit"))
    exact = values.join(open_, ["assay_id", "measure"]).groupBy("assay_id", "measure", "pct", "below", "rank").agg(F.count(F.when(beyond, 1)).alias("c"))
    return found.unionByName(exact.where(F.when(F.col("below"), F.col("c") >= F.col("rank")).otherwise(F.col("c") < F.col("rank"))).select("assay_id", "measure", "pct"))


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per assay and measure with the bound of their rank error; daily summaries are combined."""
    daily = quantiles.summarise(_measures(spark, sf_dir, "ingested_at").withColumn("day", F.to_date("ingested_at")), ["assay_id", "day"], "measure", "value")
    return quantiles.percentiles(quantiles.combine(daily.drop("day"), ["assay_id", "measure"]), ["assay_id", "measure"], PCTS)


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's container and place in it."""
    return packing.pack(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that had to be split."""
    return p7_containers(spark, sf_dir).where(F.col("piece") == 1).select("doc_id")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, documents in them, tokens and unused room."""
    per = p7_containers(spark, sf_dir).where(F.col("container_id").isNotNull()).groupBy("container_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("tokens"))
    return per.agg(F.count(F.lit(1)).alias("containers"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"), (F.count(F.lit(1)) * packing.CAPACITY - F.sum("tokens")).alias("unused"))


def _items(spark: SparkSession, sf_dir: str) -> list[tuple[int, str]]:
    """The test set, which is given and small (its size does not follow the corpus)."""
    return [tuple(r) for r in table(spark, sf_dir, "eval_items").select("item_id", "text").collect()]


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every affected document, the item, the share of its words and where they are."""
    return leaks.find(table(spark, sf_dir, "documents"), _items(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the items that leaked into them."""
    return p8_spans(spark, sf_dir).select("doc_id", "item_id")


def p9_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level of every document that is mainly English prose, with its probabilities."""
    return reading.levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and their reading level."""
    return p9_levels(spark, sf_dir).select("doc_id", "band")


def p9_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, words and mean confidence per source and level."""
    sources = table(spark, sf_dir, "documents").select("doc_id", "source")
    return p9_levels(spark, sf_dir).join(sources, "doc_id").groupBy("source", "band").agg(F.count(F.lit(1)).alias("documents"), F.sum("words").alias("words"), F.round(F.avg("confidence"), 3).alias("confidence"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_matches, p3_found, p3_percentiles, p7_found, p7_containers, p7_fill, p8_found, p8_spans, p9_found, p9_levels, p9_profile)}


def oracle_sql() -> dict[str, str]:
    values = """select assay_id, 'depth' as measure, cast(depth as double) as v from observations where depth >= 0
        union all select assay_id, 'allele_balance', allele_balance from observations where allele_balance between 0 and 1 and not isnan(allele_balance)"""
    rules = " union all ".join(f"select '{m}' as measure, {p} as pct, {x} as lim, {str(b).lower()} as below" for m, p, x, b in LIMITS)
    return {
        "p3_found": f"""with v as ({values}), r as (select *, row_number() over (partition by assay_id, measure order by v) as k, count(*) over (partition by assay_id, measure) as n from v)
            select assay_id, r.measure, pct from r join ({rules}) l on l.measure = r.measure and r.k = (l.pct * r.n + 99) // 100 where n >= {LEAST_VALUES} and case when below then v < lim else v > lim end"""
    }
