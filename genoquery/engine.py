"""The calls a script makes, on DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genoquery.functions import genotype as G
from genoquery.operators import lookup
from genoquery.operators.skew import measured_join
from genoquery.session import durable
from genoquery.sources import binary, sinks, text

SPEC = "vid int, rsids array<string>, grch37 string, grch38 string, ref string, alt string, kind string, deletion_length int, motifs array<string>"


def variant(rsid=None, grch37=None, grch38=None, ref=None, alt=None, kind="snp", deletion_length=None, motifs=()) -> tuple:
    """A spec row without its number; loci are ``chrom:start-stop`` texts."""
    return ([rsid] if isinstance(rsid, str) else list(rsid or []), grch37, grch38, ref, alt, kind, deletion_length, list(motifs))


class Engine:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def load_genotypes(self, paths: list[str], form: str | None = None) -> DataFrame:
        """``pid, row_idx, rsid, chrom, pos, genotype`` of files of any mix of formats; the participant is told by the file's name.

        ``form`` forces a format on all files. Else archives and variant files are told by their endings, and the rest (and what
        archives hold) by the lines: a VCF by its header, an array report by ``[Data]``, all others are delimited. BCF gives its
        records' haplotype dosages as genotypes; alignments hold no genotypes and are refused. No paths are an error.
        """
        kinds: dict[str, list[str]] = {}
        for p in paths:
            kinds.setdefault(binary.source_format(p, None, form), []).append(p)
        if unread := sorted(set(kinds) - {"zip", "text", "vcf", "gsgt", "bcf"}) or ([] if paths else ["nothing"]):
            raise ValueError(f"no genotypes can be loaded from {', '.join(unread)}")
        parts = []
        for kind, mine in kinds.items():
            if kind == "bcf":
                binary.register(self.spark)
                r = self.spark.read.format("genoquery_bcf").load(",".join(mine))
                parts.append(r.select("file", F.row_number().over(Window.partitionBy("file").orderBy("chrom", "position", "ref")).cast("long").alias("line_no"), "rsid", "chrom", "position", G.genotype_from_hds(F.col("hds"), F.col("ref"), F.try_element_at("alts", F.lit(1))).alias("genotype")))
                continue
            lines = binary.zip_lines(self.spark, mine) if kind == "zip" else text.read_lines(self.spark, mine)
            parts += [r.select("file", "line_no", "rsid", "chrom", "position", "genotype") for r in self._read(lines, kind)]
        rows = parts[0]
        for r in parts[1:]:
            rows = rows.unionByName(r)
        pid = G.participant_from_file(F.substring_index("file", "/", -1))
        return rows.select(pid.alias("pid"), F.col("line_no").alias("row_idx"), "rsid", G.chrom_match_key(F.col("chrom")).alias("chrom"), F.col("position").alias("pos"), "genotype")

    @staticmethod
    def _read(lines: DataFrame, kind: str) -> list[DataFrame]:
        readers = {"vcf": text.vcf, "gsgt": text.final_report, "text": text.delimited}
        if kind in ("vcf", "gsgt"):
            return [readers[kind](lines)]
        line = F.ltrim("line")
        marks = lines.groupBy("file").agg(F.bool_or(line.startswith("##fileformat=VCF") | line.startswith("#CHROM\t")).alias("vcf"), F.bool_or(F.lower(F.trim("line")) == "[data]").alias("gsgt"))
        told = durable(marks.select("file", F.when(F.col("vcf"), "vcf").when(F.col("gsgt"), "gsgt").otherwise("text").alias("__kind")))
        found = [r["__kind"] for r in told.select("__kind").distinct().collect()]  # three at most
        all_lines = measured_join(lines, told, ["file"], ["line_no"])
        return [readers[k](all_lines.where(F.col("__kind") == k).drop("__kind") if len(found) > 1 else lines) for k in sorted(found) or ["text"]]

    def query_plan(self, variants: list[tuple]) -> DataFrame:
        """Specs as a DataFrame, numbered in order."""
        return self.spark.createDataFrame([(i, *v) for i, v in enumerate(variants)], SPEC)

    def lookup_variants(self, rows: DataFrame, specs: DataFrame, build: str = "grch38") -> DataFrame:
        """One row per participant and spec, in the order of the specs; those not found have nulls."""
        named = specs.select("vid", F.explode("rsids").alias("rsid"))
        other = "grch37" if build == "grch38" else "grch38"
        locus = F.coalesce(build, other)
        p = r"^([^:]+):(\d+)(?:-\d+)?$"
        placed = specs.where(locus.isNotNull()).select("vid", G.chrom_match_key(F.regexp_extract(locus, p, 1)).alias("chrom"), F.regexp_extract(locus, p, 2).cast("long").alias("pos"))
        best = lookup.winners(lookup.by_name(rows, named), lookup.by_place(rows, placed))
        return lookup.every_spec(rows.select("pid").distinct(), specs, best).orderBy("pid", "vid")

    def get(self, rows: DataFrame, rsid: str) -> DataFrame:
        """The first genotype of a name per participant."""
        return rows.where((F.col("rsid") == rsid) & F.col("genotype").isNotNull()).groupBy("pid").agg(F.min(F.struct("row_idx", "genotype"))["genotype"].alias("genotype"))

    def classify(self, rows: DataFrame, rule: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
        """A script's rule over rows; its result columns are called ``NAME_column``, but for ``pid``."""
        out = rule(rows)
        return out.select(*[F.col(c) if c == "pid" else F.col(c).alias(f"{name}_{c}") for c in out.columns])

    def fetch(self, reads: DataFrame, chrom: str, start: int, stop: int) -> DataFrame:
        """Reads that overlap start..stop, 0-based and half-open."""
        return reads.where((F.col("chrom") == chrom) & (F.col("start") <= stop) & (F.col("stop") >= start + 1))

    write_tsv = staticmethod(sinks.write_tsv)

    def read_tsv(self, path: str) -> DataFrame:
        return sinks.read_tsv(self.spark, path)
