"""Sex, assembly and source of a file, from its rows and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoquery.functions.genotype import chrom_for_anchor, chrom_for_sex

NON_PAR_X = (2_781_480, 154_931_043)
# Marker, chromosome, its position in builds 36, 37 and 38, and its alleles on the plus strand.
ANCHORS = [
    ("rs1801133", "1", 11778965, 11856378, 11796321, "AG"), ("rs6025", "1", 167785673, 169519049, 169549811, "C"), ("rs3131972", "1", 742584, 752721, 817341, "AG"), ("rs4988235", "2", 136325116, 136608646, 135851076, "G"),
    ("rs1801282", "3", 12368125, 12393125, 12351626, "C"), ("rs53576", "3", 8779371, 8804371, 8762685, "AG"), ("rs1229984", "4", 100458342, 100239319, 99318162, "C"), ("rs1801260", "4", 55996126, 56301369, 55435202, "AG"),
    ("rs16891982", "5", 33987450, 33951693, 33951588, "CG"), ("rs1042713", "5", 148186633, 148206440, 148826877, "G"), ("rs1799971", "6", 154402490, 154360797, 154039662, "A"), ("rs662", "7", 94775382, 94937446, 95308134, "CT"),
    ("rs505922", "9", 135139050, 136149229, 133273813, "CT"), ("rs7903146", "10", 114748339, 114758349, 112998590, "C"), ("rs1800497", "11", 112776038, 113270828, 113400106, "G"), ("rs671", "12", 110726149, 112241766, 111803962, "G"),
    ("rs12913832", "15", 26039213, 28365618, 28120472, "AG"), ("rs1051730", "15", 76681394, 78894339, 78601997, "G"), ("rs16969968", "15", 76669980, 78882925, 78590583, "G"), ("rs762551", "15", 72828970, 75041917, 74749576, "AC"),
    ("rs1042522", "17", 7520197, 7579472, 7676154, "CG"), ("rs429358", "19", 50103781, 45411941, 44908684, "CT"), ("rs7412", "19", 50103919, 45412079, 44908822, "C"), ("rs4680", "22", 18331271, 19951271, 19963748, "AG"),
    ("rs1800896", "1", 205013520, 206946897, 206773552, "T"), ("rs1800795", "7", 22733170, 22766645, 22727026, "G"), ("rs5186", "3", 149942678, 148459988, 148742201, "A"),
]


def sex_statistics(rows: DataFrame, key: str, markers: list[str]) -> DataFrame:
    """Nine counters per file over genotype rows (key, rsid, chrom, pos, genotype). ``markers``: names that only men have."""
    c = chrom_for_sex(F.col("chrom"))
    g = F.upper(F.trim("genotype"))
    called = F.coalesce(g.rlike("^[ACGT]+$"), F.lit(False))
    x = (c == "X") & F.col("pos").between(*NON_PAR_X) & called
    y = c == "Y"
    marker = y & F.col("rsid").isin(markers)
    n = F.length(g)
    return rows.groupBy(key).agg(
        F.count_if(x).alias("x_non_par_sites"), F.count_if(x & (n == 1)).alias("x_haploid_gt_sites"), F.count_if(x & (n == 2)).alias("x_diploid_gt_sites"), F.count_if(x & (n == 2) & (F.substring(g, 1, 1) != F.substring(g, 2, 1))).alias("x_het_gt_sites"),
        F.count_if(y).alias("total_y_snps"), F.count_if(y & called).alias("called_y_snps"), F.count_if(marker).alias("male_markers_found"), F.count_if(marker & called).alias("male_markers_called"),
    )


def _pct(a: Column, b: Column) -> Column:
    return F.when(b > 0, a * 100.0 / b).otherwise(F.lit(0.0))


def classify_array_sex() -> Column:
    """Sex and confidence from the counters of ``sex_statistics``: the first rule that fits."""
    s = F.col
    y_pct, hap, het = _pct(s("called_y_snps"), s("total_y_snps")), _pct(s("x_haploid_gt_sites"), s("x_non_par_sites")), _pct(s("x_het_gt_sites"), s("x_non_par_sites"))
    out = lambda sex, conf: F.struct(F.lit(sex).alias("sex"), (F.lit(conf) if isinstance(conf, str) else conf).alias("confidence"))
    sure = lambda c: F.when(c, "high").otherwise("medium")
    many = s("x_non_par_sites") >= 1000
    return (
        F.when(many & (s("x_diploid_gt_sites") >= 1000) & (het >= 2), out("female", sure((s("x_non_par_sites") >= 10000) & (het >= 10))))
        .when(many & (hap >= 95), out("male", sure((s("x_non_par_sites") >= 10000) & (hap >= 99))))
        .when((s("total_y_snps") > 1000) & (s("male_markers_found") >= 3) & (s("male_markers_called") == 0) & (y_pct < 20), out("female", "high"))
        .when((s("called_y_snps") > 500) & (y_pct >= 50), out("male", "high")).when((s("called_y_snps") > 100) & (s("male_markers_called") > 10), out("male", "medium"))
        .when((s("total_y_snps") > 1000) & (s("called_y_snps") < 10) & (s("male_markers_called") < 3), out("female", sure(s("called_y_snps") == 0)))
        .when((s("called_y_snps") > 50) | (s("male_markers_called") > 5), out("male", "medium")).when((s("called_y_snps") < 10) & (s("total_y_snps") > 0), out("female", "medium"))
        .otherwise(out("unknown", "low"))
    )


def classify_vcf_sex() -> Column:
    """As ``classify_array_sex`` for variant files."""
    s = F.col
    het, y_x = _pct(s("x_het_gt_sites"), s("x_diploid_gt_sites")), _pct(s("called_y_snps"), s("x_non_par_sites"))
    out = lambda sex, conf: F.struct(F.lit(sex).alias("sex"), (F.lit(conf) if isinstance(conf, str) else conf).alias("confidence"))
    some = (s("x_non_par_sites") >= 50) & (s("x_diploid_gt_sites") > 0)
    return (
        F.when((s("called_y_snps") >= 10000) | ((s("x_non_par_sites") >= 1000) & (y_x >= 10)), out("male", "high"))
        .when(some & (het >= 2), out("female", F.when((s("x_non_par_sites") >= 1000) & (het >= 10), "high").otherwise("medium")))
        .when((s("x_haploid_gt_sites") >= 20) | (some & (het <= 0.2)), out("male", "high")).when(s("called_y_snps") > 500, out("unknown", "medium")).otherwise(out("unknown", "low"))
    )


def classify_depth_sex(autosome: Column, x: Column, y: Column) -> Column:
    """Sex and confidence from mean reads per window on autosomes, X and Y."""
    rx, ry = F.when(autosome > 0, x / autosome).otherwise(F.lit(0.0)), F.when(autosome > 0, y / autosome).otherwise(F.lit(0.0))
    out = lambda sex, conf: F.struct(F.lit(sex).alias("sex"), F.lit(conf).alias("confidence"))
    return (
        F.when(autosome < 5, out("unknown", "low")).when((rx >= 0.75) & (ry < 0.15), out("female", "high")).when((rx < 0.75) & (ry >= 0.08), out("male", "high"))
        .when((rx >= 0.75) & (ry < 0.25), out("female", "medium")).when((rx < 0.85) & (ry >= 0.03), out("male", "medium")).otherwise(out("unknown", "low"))
    )


def anchor_votes(rows: DataFrame, key: str) -> DataFrame:
    """Per file the votes for builds 36, 37 and 38 and the assembly they decide, or null.

    A name at its anchor's position weighs 3, alleles that fit there 1. At least 4 anchors and 90 percent of the weight are
    needed; build 36 is not a known assembly. The anchor table is fixed, so it is broadcast.
    """
    spark = rows.sparkSession
    a = spark.createDataFrame([(i, r, c, p, b, al, al.translate(str.maketrans("ACGT", "TGCA"))) for i, (r, c, p36, p37, p38, al) in enumerate(ANCHORS) for b, p in ((36, p36), (37, p37), (38, p38))], "i int, a_rsid string, chrom string, pos long, build int, fwd string, rev string")
    r = rows.select(key, "rsid", chrom_for_anchor(F.col("chrom")).alias("chrom"), F.col("pos").cast("long").alias("pos"), F.upper(F.regexp_replace(F.coalesce("genotype", F.lit("")), "[^ACGTacgt]", "")).alias("g"))
    hit = r.join(F.broadcast(a), ["chrom", "pos"])
    named = F.coalesce(F.col("rsid") == F.col("a_rsid"), F.lit(False))
    fits = (F.translate("g", "ACGT", "") == "") & ((F.regexp_replace("g", F.concat(F.lit("["), "fwd", F.lit("]")), F.lit("")) == "") | (F.regexp_replace("g", F.concat(F.lit("["), "rev", F.lit("]")), F.lit("")) == ""))
    w = F.when(named, 3).when(fits, 1)
    per = hit.groupBy(key).agg(*[F.coalesce(F.sum(F.when(F.col("build") == b, w)), F.lit(0)).alias(f"score_{b}") for b in (36, 37, 38)], F.count(w).alias("anchors"))
    total = F.col("score_36") + F.col("score_37") + F.col("score_38")
    best = F.greatest("score_36", "score_37", "score_38")
    enough = (F.col("anchors") >= 4) & (best / total >= 0.9)
    # a tie cannot have 90 percent
    return per.withColumn("assembly", F.when(enough & (F.col("score_37") == best), "grch37").when(enough & (F.col("score_38") == best), "grch38"))


def assembly_from_text(text: Column) -> Column:
    """The build that metadata names; tokens of 38 are tested first."""
    t = F.lower(text)
    # Tokens of the two builds.
    of = lambda tokens: F.coalesce(F.exists(F.array(*map(F.lit, tokens)), lambda x: F.contains(t, x)), F.lit(False))
    b38 = of(["build 38", "assembly38", "assembly 38", "grch38", "hg38", "b38", "gca_000001405.15", "##contig=<id=chr1,length=248956422", "##contig=<id=1,length=248956422", "##contig=<id=chrx,length=156040895", "##contig=<id=x,length=156040895"])
    b37 = of(["build 37", "grch37", "hg19", "b37", "human_g1k_v37", "37.1", "##contig=<id=chr1,length=249250621", "##contig=<id=1,length=249250621", "##contig=<id=chrx,length=155270560", "##contig=<id=x,length=155270560"])
    return F.when(b38, "grch38").when(b37, "grch37")


def vendor_of(name: Column, header: Column) -> Column:
    """The vendor that a file's name and comments tell, first rule first."""
    t = F.translate(F.lower(F.concat_ws("\n", name, header)), "_-.", "   ")
    # Vendors and their tokens in order.
    rules = [("Genes for Good", ["genes for good", "geneforgood"]), ("23andMe", ["23andme", "23&me"]), ("AncestryDNA", ["ancestrydna", "ancestry com dna"]), ("FamilyTreeDNA", ["family tree dna", "familytreedna", "ftdna"]), ("Dynamic DNA", ["dynamic dna", "dynamicdnalabs", "ddna"]), ("MyHeritage", ["myheritage"]), ("Sequencing.com", ["sequencing com"]), ("CariGenetics", ["carigenetics", "cari genetics"])]
    out = F.lit(None).cast("string")
    for vendor, tokens in reversed(rules):
        hit = F.lit(False)
        for x in tokens:
            hit = hit | F.contains(t, F.lit(x))
        out = F.when(hit, vendor).otherwise(out)
    return out


def phasing(gts: DataFrame, key: str) -> DataFrame:
    """Per file: true where any genotype has a bar, else false where any has a slash, else null."""
    return gts.groupBy(key).agg(F.when(F.bool_or(F.contains("gt", F.lit("|"))), True).when(F.bool_or(F.contains("gt", F.lit("/"))), False).alias("phased"))


def genotype_shape(line: Column) -> Column:
    """Whether a line looks like rsid, chromosome, position, genotype or two alleles."""
    f = F.when(F.contains(line, F.lit("\t")), F.transform(F.split(line, "\t", -1), lambda x: F.trim(x))).when(F.contains(line, F.lit(",")), F.transform(F.split(line, ",", -1), lambda x: F.regexp_replace(F.trim(x), '^"+|"+$', ""))).otherwise(F.split(F.trim(line), r"\s+"))
    chrom = lambda x: F.regexp_replace(F.trim(x), "^(?:chr)+", "").rlike("^(?:[+]?0*(?:[1-9]|1[0-9]|2[0-6])|(?i:X|Y|M|MT|XY))$")
    text = F.concat_ws("\x1f", F.slice(f, F.array_position(F.transform(f, chrom), True).cast("int") + 1, F.size(f)))
    geno, one = "(?i:[ACGTID0-]{1,4})", "(?i:[ACGTID0-])"
    tail = text.rlike(rf"(?:^|\x1f)[+]?\d+\x1f(?:[^\x1f]*\x1f)*?{geno}(?:\x1f|$)") | text.rlike(rf"(?:^|\x1f)[+]?\d+\x1f{one}\x1f{one}(?:\x1f|$)")
    return (F.size(f) >= 4) & f[0].rlike("^(?:rs|i)") & F.exists(f, chrom) & F.coalesce(tail, F.lit(False))
