"""Writing results: tables, JSON lines, reports, FASTQ."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the observation table and of the manifest rows, in order.
OBSERVATION = ["participant_id", "assay_id", "assay_version", "variant_key", "rsid", "gene", "assembly", "chrom", "pos_start", "pos_end", "ref", "alt", "kind", "match_status", "coverage_status", "call_status", "genotype", "genotype_display", "zygosity", "ref_count", "alt_count", "depth", "genotype_quality", "allele_balance", "outcome", "evidence_type", "evidence_raw", "match_quality", "match_notes", "facets"]
MANIFEST_ROW = ["kind", "name", "path", "tags", "participant_id", "backend", "matched_rsid", "assembly", "genotype", "ref_count", "alt_count", "depth", "evidence"]

# marks and newlines are gone from the values, so nothing is quoted; blanks stay as they are
PLAIN = {"sep": "\t", "quote": "", "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def tsv_line(df: DataFrame, columns: list[str], marks: str = "[\t\r\n]") -> Column:
    """The columns as one tab separated line: ``marks`` become blanks, null and absent columns are empty."""
    have = {c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), marks, " ") if c in df.columns else F.lit("") for c in columns}
    return F.concat_ws("\t", *have.values())


def write_tsv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """A tab separated table with a header in each part; extra columns are left out, missing ones are empty."""
    columns = columns or df.columns
    clean = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "[\t\r\n]", " ").alias(c) if c in df.columns else F.lit("").alias(c) for c in columns]
    df.select(*clean).write.mode("overwrite").options(**PLAIN).csv(path, header=True)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_tsv`` wrote, as text; empty values are null."""
    return spark.read.options(**PLAIN).csv(path, header=True)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines; null fields are kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def report_json(df: DataFrame) -> DataFrame:
    """One JSON text per row, null fields kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def html_table(df: DataFrame, title: str, most: int = 1000) -> str:
    """A page with the first ``most`` rows, in the order of all columns; a report shows a bounded result."""
    rows = df.orderBy(*df.columns).limit(most).collect()
    cell = lambda v: f"<td>{html.escape('' if v is None else str(v))}</td>"
    return f"<!doctype html><title>{html.escape(title)}</title><table><tr>{''.join(f'<th>{html.escape(c)}</th>' for c in df.columns)}</tr>" + "".join(f"<tr>{''.join(map(cell, r))}</tr>" for r in rows) + "</table>"


def write_fastq(reads: DataFrame, path: str) -> None:
    """First and last mates of names that have both, as FASTQ text under ``path/r1`` and ``path/r2``, in the order of names."""
    mate = lambda bit: F.min(F.when(F.col("flag").bitwiseAND(F.lit(bit)) != 0, F.struct("seq", "qual")))
    pairs = reads.groupBy("name").agg(mate(64).alias("a"), mate(128).alias("b")).where("a is not null and b is not null")
    text = lambda m: F.concat(F.lit("@"), F.col("name"), F.lit("\n"), F.col(f"{m}.seq"), F.lit("\n+\n"), F.array_join(F.transform(f"{m}.qual", lambda q: F.chr((q + 33).cast("long"))), ""))
    for m, d in (("a", "r1"), ("b", "r2")):
        pairs.orderBy("name").select(text(m).alias("value")).write.mode("overwrite").text(f"{path}/{d}")


def combine(frames: list[DataFrame]) -> DataFrame:
    """Tables of several participants as one; columns are matched by name, missing ones are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def trace(paths: list[str]) -> list[str]:
    """Lines of the trace table: step, line, code."""
    return ["step\tline\tcode", *(f"{i}\t{i}\t{p}" for i, p in enumerate(paths, 1))]


def review_rows(cases: list[dict]) -> list[tuple[str, str, str]]:
    """(case, rsid, genotype) of hand-written review cases; null genotypes are left out."""
    return [(c["name"], rsid, g) for c in cases for rsid, g in (c.get("genotypes") or {}).items() if g is not None]


def metrics_json(metrics: dict) -> str:
    return json.dumps(metrics, sort_keys=True)
