"""Post-processing of calls in a variable number tandem repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Thresholds, motifs and alternates of the caller's rules.
LOW_SCORE, HIGH_SCORE = 0.00469, 0.00515
ALT_LOW, ALT_MID_LOW, ALT_MID_HIGH = 20.0, 21.0, 100.0
REGION_DEPTH = 200.0
MOTIF_POSITION = 60
RIGHT_EXCLUDED = ["8", "9", "7", "6p", "6"]
EXCLUDED_ALTS = ["CCGCC", "CGGCG", "CGGCC"]
EXCLUDED_MOTIFS = ["6", "6p", "7"]
CONSERVED = ["1", "2", "3", "4", "6", "7", "8", "9"]


def confidence(alt: Column, region: Column, score: Column) -> Column:
    """Later rules overwrite earlier ones, so they are tested from the last to the first; below the low score it is negative."""
    mid = (alt >= ALT_MID_LOW) & (alt < ALT_MID_HIGH)
    return (
        F.when(score.isNull() | (score < LOW_SCORE), "Negative").when((score > LOW_SCORE) & (score < HIGH_SCORE), "Low_Precision").when(mid & (score >= HIGH_SCORE), "High_Precision")
        .when(alt <= ALT_LOW, "Low_Precision").when(mid & score.between(LOW_SCORE, HIGH_SCORE), "Low_Precision").when((alt >= ALT_MID_HIGH) & (score >= HIGH_SCORE), "High_Precision*")
        .when((region <= REGION_DEPTH) | (score == LOW_SCORE), "Low_Precision").otherwise("Negative")
    )


def annotate(calls: DataFrame) -> DataFrame:
    """Adds depths, score, frameshift, confidence, ALT filter and flag to calls (CHROM, POS, REF, ALT, Sample ``x:alt:region``)."""
    part = lambda i: F.coalesce(F.get(F.split("Sample", ":"), F.lit(i)).try_cast("double"), F.lit(0.0))
    c = calls.withColumns({"alt_depth": part(1), "region_depth": part(2), "delta": F.length("ALT") - F.length("REF")})
    c = c.withColumn("depth_score", F.when(F.col("region_depth") != 0, F.col("alt_depth") / F.col("region_depth")))
    d = F.col("delta")
    return c.withColumns({
        "is_frameshift": d % 3 != 0, "valid": ((d > 0) & (d % 3 == 1)) | ((d < 0) & (F.abs(d) % 3 == 2)), "confidence": confidence(F.col("alt_depth"), F.col("region_depth"), F.col("depth_score")),
        "alt_pass": (F.col("ALT") != "GG") | F.coalesce(F.col("depth_score") >= LOW_SCORE, F.lit(False)),
    })


def flag(motif: Column) -> Column:
    parts = F.concat_ws(", ", F.when((F.col("REF") == "C") & (F.col("ALT") == "CGGCA"), "False_Positive_4bp_Insertion"), F.when((F.col("depth_score") < 0.4) & motif.isin(CONSERVED), "Low_Depth_Conserved_Motifs"))
    return F.when(parts == "", "Not flagged").otherwise(parts)


def correct_motifs(calls: DataFrame, sample: str = "sample", idx: str = "idx") -> DataFrame:
    """Adds ``motif``, ``survives`` and ``passes`` to annotated calls.

    Below position 60 the motif is the right token, from 60 on the left one. Left calls are deduplicated by locus, the best
    first; right calls only where the sample has a right call with ALT GG, and then without the excluded motifs.
    A sample with no or several dashes in a motif name keeps nothing.
    """
    whole = Window.partitionBy(sample)
    dashes = F.length("CHROM") - F.length(F.replace("CHROM", F.lit("-"), F.lit("")))
    c = calls.withColumn("__ok", (F.max(dashes).over(whole) == 1) & (dashes == 1)).withColumn("__left", F.col("POS") < MOTIF_POSITION)
    tokens = F.split("CHROM", "-")
    c = c.withColumn("motif", F.when(F.col("__ok"), F.when(F.col("__left"), F.get(tokens, F.lit(1))).otherwise(F.get(tokens, F.lit(0)))))
    c = c.withColumn("__gg", F.coalesce(F.max(F.when(F.col("__ok") & ~F.col("__left"), F.col("ALT") == "GG")).over(whole), F.lit(False)))
    c = c.withColumn("__in", F.col("__ok") & (F.col("__left") | ~F.col("__gg") | ~F.col("motif").isin(RIGHT_EXCLUDED)))
    best = Window.partitionBy(sample, "__left", "__in", "POS", "REF", "ALT").orderBy(F.col("valid").desc(), F.coalesce("depth_score", F.lit(0.0)).desc(), idx)
    first = (F.row_number().over(best) == 1) | (~F.col("__left") & ~F.col("__gg"))
    c = c.withColumn("survives", F.col("__in") & first & ~F.col("ALT").isin(EXCLUDED_ALTS) & ~F.col("motif").isin(EXCLUDED_MOTIFS))
    c = c.withColumn("survives", F.coalesce("survives", F.lit(False)))
    return c.withColumn("passes", F.col("survives") & F.col("valid") & (F.col("confidence") != "Negative") & F.col("alt_pass")).drop("__ok", "__left", "__gg", "__in")


def best_call(calls: DataFrame, sample: str = "sample", idx: str = "idx") -> DataFrame:
    """The call with the highest score; of equal ones the last."""
    return calls.groupBy(sample).agg(F.max_by(idx, F.struct(F.coalesce("depth_score", F.lit(0.0)), F.col(idx))).alias(idx))


def result(calls: DataFrame, sample: str = "sample", idx: str = "idx") -> DataFrame:
    """Per sample the label of the first passing call that is of high or low precision; flagged calls are marked; else negative."""
    high, low, clean = F.col("confidence").isin("High_Precision", "High_Precision*"), F.col("confidence") == "Low_Precision", F.col("flag") == "Not flagged"
    label = F.when(high & clean, "High_Precision").when(low & clean, "Low_Precision").when(high, "High_Precision_flagged").when(low, "Low_Precision_flagged")
    label = F.when(F.col("passes"), label)
    return calls.groupBy(sample).agg(F.coalesce(F.min_by(label, F.when(label.isNotNull(), F.col(idx))), F.lit("negative")).alias("result"))
