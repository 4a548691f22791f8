"""Sources and sinks on small files and round trips."""

import gzip
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from genoquery.engine import Engine, variant
from genoquery.operators import cohort, reads
from genoquery.sources import binary, manifest, sinks, text

DELIMITED = {
    "anc": ["#AncestryDNA", "rsid\tchromosome\tposition\tallele1\tallele2", "rs1\t1\t100\tA\tG", "rs2\t2\t200\tT\tT # note", "\t\t\tA\tA"],
    "g4g": ["# x", "#rsid\tchromosome\tposition\tgenotype", "rs1\t1\t100\tGA", "\t5\t7\tCC"],
    "csv": ['"SNP Name",x', 'rs1,1,5,AG'],
    "bare": ["rs9 7 70 CT extra"],
}


def _lines(spark, files):
    return spark.createDataFrame([(f, i, x) for f, xs in files.items() for i, x in enumerate(xs)], "file string, line_no long, line string")


def test_delimited(spark):
    got = {(r["file"], r["line_no"]): (r["rsid"], r["chrom"], r["position"], r["genotype"]) for r in text.delimited(_lines(spark, DELIMITED)).collect()}
    assert got == {("anc", 2): ("rs1", "1", 100, "AG"), ("anc", 3): ("rs2", "2", 200, "TT"), ("g4g", 2): ("rs1", "1", 100, "AG"), ("g4g", 3): (None, "5", 7, "CC"), ("csv", 0): ("SNP Name", "x", None, "--"), ("csv", 1): ("rs1", "1", 5, "AG"), ("bare", 0): ("rs9", "7", 70, "CT")}


def test_vcf_position_is_checked(spark):
    with pytest.raises(Exception, match="position is no number"):
        text.vcf(_lines(spark, {"a": ["\t".join(["1", "x", ".", "A", "G", ".", ".", ".", "GT", "0/1"])]})).collect()


def test_final_report_and_replicates(spark):
    head = ["[Header]", "x\ty", "[Data]", "Sample ID\tSNP Name\tChr\tPosition\tAllele1 - Plus\tAllele2 - Plus"]
    rows = ["s\trs1\t1\t5\tC\tC", "s\trs1_dup\t1\t5\t-\t-", "s\trs2\t1\t6\tA\tA", "s\trs2.1\t1\t6\tG\tG", "s\trs3\t0\t0\tA\tA", "s\t2:6000\t2\t6000\tA\tC"]
    out = text.final_report(_lines(spark, {"r": head + rows}))
    assert out.count() == 5
    merged = {r["rsid"]: r["genotype"] for r in cohort.merge_replicates(out.where("rsid is not null"), "rsid", "genotype").collect()}
    assert merged == {"rs1": "CC", "rs2": "--"}


def _bgzf(path, data):
    with gzip.open(path, "wb") as f:
        f.write(data)


def test_bam_round_trip(spark, tmp_path):
    def record(name, flag, pos, cigar, seq):
        codes = {c: i for i, c in enumerate("=ACMGRSVTWYHKDBN")}
        nib = [codes[c] for c in seq] + [0] * (len(seq) % 2)
        body = struct.pack("<iiBBHHHiiii", 0, pos - 1, len(name) + 1, 60, 0, len(cigar), flag, len(seq), -1, -1, 0) + name.encode() + b"\0"
        body += b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(k)) for k, n in cigar) + bytes(nib[i] << 4 | nib[i + 1] for i in range(0, len(nib), 2)) + bytes([40] * len(seq))
        return struct.pack("<i", len(body)) + body

    data = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)
    data += record("q1", 64, 100, [("M", 5)], "ACGTA") + record("q1", 128, 103, [("M", 2), ("D", 2), ("M", 2)], "TTAC")
    _bgzf(tmp_path / "a.bam", data)
    binary.register(spark)
    df = spark.read.format("genoquery_bam").load(str(tmp_path / "a.bam"))
    got = [(r["name"], r["flag"], r["chrom"], r["start"], r["stop"], r["seq"]) for r in df.orderBy("flag").collect()]
    assert got == [("q1", 64, "chr1", 100, 104, "ACGTA"), ("q1", 128, "chr1", 103, 108, "TTAC")]
    at = df.select("flag", reads.index_at(F.col("cigar"), F.col("start"), F.lit(107).cast("long")).alias("i")).orderBy("flag").collect()
    assert [r["i"] for r in at] == [None, 2]
    sinks.write_fastq(df, str(tmp_path / "fq"))
    assert spark.read.text(str(tmp_path / "fq" / "r1")).count() == 4
    assert Engine(spark).fetch(df, "chr1", 104, 105).count() == 1


def test_bcf_round_trip(spark, tmp_path):
    header = b"##fileformat=VCFv4.2\n##contig=<ID=7,length=9>\n##FORMAT=<ID=HDS,Number=2>\n\0"
    word = lambda s: bytes([len(s) << 4 | 7]) + s
    shared = struct.pack("<iiifHHI", 0, 41, 1, 0.0, 0, 2, 1 << 24 | 1) + word(b"rs5") + word(b"A") + word(b"G") + bytes([0])
    indiv = bytes([0x11, 1, 0x25]) + struct.pack("<2f", 0.9, 0.1)
    _bgzf(tmp_path / "a.bcf", b"BCF\2\2" + struct.pack("<I", len(header)) + header + struct.pack("<II", len(shared), len(indiv)) + shared + indiv)
    binary.register(spark)
    r = spark.read.format("genoquery_bcf").load(str(tmp_path / "a.bcf")).first()
    assert (r["rsid"], r["chrom"], r["position"], r["ref"], r["alts"], [round(x, 1) for x in r["hds"]]) == ("rs5", "7", 42, "A", ["G"], [0.9, 0.1])


def test_zip_and_engine(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "P1.txt.zip", "w") as z:
        z.writestr("readme.md", "x")
        z.writestr("data.txt", "rsid\tchromosome\tposition\tgenotype\nrs1\t1\t100\tAG\nrs1\t1\t100\tGG\n")
    e = Engine(spark)
    rows = e.load_genotypes([str(tmp_path / "P1.txt.zip")])
    found = e.lookup_variants(rows, e.query_plan([variant("rs1"), variant(grch38="chr1:100-100"), variant("rs2")])).collect()
    assert [(r["pid"], r["vid"], r["genotype"]) for r in found] == [("P1", 0, "AG"), ("P1", 1, "AG"), ("P1", 2, None)]
    out = e.classify(rows, lambda d: d.groupBy("pid").agg(F.count(F.lit(1)).alias("n")), "COUNT")
    assert out.columns == ["pid", "COUNT_n"]
    e.write_tsv(out, str(tmp_path / "o"))
    assert e.read_tsv(str(tmp_path / "o")).first()["COUNT_n"] == "2"
    assert "<td>P1</td>" in sinks.html_table(out, "t")
    assert binary.sniff((tmp_path / "P1.txt.zip").read_bytes()) == "zip" and binary.sniff(b"##fileformat=VCFv4") == "vcf"


def test_package_limits(tmp_path):
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.writestr("manifest.yaml", "x")
    assert manifest.import_package(str(tmp_path / "p.zip"), str(tmp_path / "p")) == ["manifest.yaml"]
    with zipfile.ZipFile(tmp_path / "q.zip", "w") as z:
        z.writestr("../up.yaml", "x")
    with pytest.raises(ValueError, match="leaves"):
        manifest.import_package(str(tmp_path / "q.zip"), str(tmp_path / "q"))


def test_cigar_walks(spark):
    df = spark.createDataFrame([(1, 100, "20M2D30M"), (2, 100, "20M2I28M"), (3, 95, "5S46M")], "i int, start long, cigar string").withColumn("ops", reads.parse_cigar(F.col("cigar")))
    r = {x["i"]: x for x in df.select("i", reads.index_at(F.col("ops"), F.col("start"), F.lit(122).cast("long")).alias("at"), reads.indel_at(F.col("ops"), F.col("start"), F.lit(119).cast("long")).alias("g")).collect()}
    assert (r[1]["at"], r[2]["at"], r[3]["at"]) == (20, 24, 32)
    assert tuple(r[1]["g"]) == ("D", 2) and tuple(r[2]["g"]) == ("I", 2) and r[3]["g"] is None


def test_empty_depths(spark):
    none = spark.createDataFrame([], "chrom string, pos long, depth long")
    r = reads.depth_summary(none, spark.createDataFrame([("1", 1, 4)], "chrom string, lo long, hi long"), ["chrom"]).first()
    assert (r["mean"], r["median"], r["uncovered_bases"], r["percent_uncovered"]) == (0.0, 0.0, 4, 100.0)


def test_observations_in_full(spark):
    from genoquery.plans.source_queries import in_full

    row = lambda i, kind, ref, alt, shown, chrom="1", depth=None, alts=None, by="genotype_file", rsid="rs1": (i, "p", "a", "1.0", "k", rsid, "g", "grch38", chrom, 5, 5, ref, alt, kind, shown, None, alts, depth, None, by, None)
    rows = [
        row(1, "snp", "A", "G", "AG"), row(2, "snp", "A", "G", "G", "chrX"), row(3, "snp", "A", "G", "A", "X"), row(4, "deletion", "TT", "T", "ID"), row(5, "deletion", "TT", "T", "ID", depth=30, alts=0, by="mpileup"), row(6, "insertion", "T", "TT", "DD"),
        row(7, "snp", "A", "G", "AT", rsid="RS7"), row(8, "snp", "A", "G", "GT", rsid="rs7"), row(9, "snp", "A", "G", "GC"), row(10, None, None, None, None, None, depth=-9, rsid=None), row(11, "snp", "A", "G", None, depth=0), row(1, "snp", "A", "G", "AG"), row(12, "snp", "A", "G", "GG", depth=40, alts=30, by="mpileup"),
    ]
    schema = "record_id long, participant_id string, assay_id string, assay_version string, variant_key string, rsid string, gene string, assembly string, chrom string, pos_start long, pos_end long, reference string, alternate string, kind string, genotype_display string, ref_count long, alt_count long, depth long, genotype_quality long, evidence_type string, evidence_raw string"
    df = in_full(spark.createDataFrame(rows, schema), spark.createDataFrame([("rs7", ["T"])], "rsid string, observed array<string>"))
    got = df.collect()
    assert len(df.columns) == 31 and len(got) == len(rows)
    said = {r["record_id"]: (r["genotype"], r["zygosity"], r["outcome"], r["call_status"], r["genotype_display"]) for r in got}
    assert said == {
        1: ("0/1", "het", "variant", "called", "AG"), 2: ("1", "hem_alt", "variant", "called", "G"), 3: ("0", "hem_ref", "reference", "called", "A"), 4: ("0/1", "het", "variant", "called", "ID"), 5: ("0/0", "hom_ref", "reference", "called", "II"), 6: ("0/0", "hom_ref", "reference", "called", "DD"),
        7: ("0/1", "het", "variant", "called", "AT"), 8: ("GT", "unknown", "observed_alt", "observed_alt", "GT"), 9: ("GC", "unknown", "unknown_alt", "unknown_alt", "GC"), 10: ("./.", "unknown", "no_call", "no_call", "??"), 11: ("./.", "unknown", "not_covered", "no_call", "??"), 12: ("1/1", "hom_alt", "variant", "called", "GG"),
    }
    by = {r["record_id"]: r for r in got}
    assert by[7]["alt"] == "T" and by[8]["facets"] == "observed_alt;known_observed_alts=T" and by[9]["facets"] == "unknown_alt" and by[2]["chrom"] == "X"
    assert by[4]["match_quality"] == "weak" and by[4]["match_notes"] and by[5]["match_quality"] is None and by[12]["allele_balance"] == 0.75
    assert (by[10]["match_status"], by[10]["coverage_status"], by[10]["kind"], by[10]["depth"]) == ("not_found", "covered", "unknown", None) and by[11]["coverage_status"] == "not_covered"


def test_mixed_formats_in_one_call(spark, tmp_path):
    (tmp_path / "P1.txt").write_text("rsid\tchromosome\tposition\tgenotype\nrs1\t1\t100\tAG\n")
    (tmp_path / "P2").write_text("##fileformat=VCFv4.2\n1\t100\trs1\tA\tG\t.\t.\t.\tGT\t1/1\n")
    (tmp_path / "P3.vcf").write_text("1\t100\trs1\tA\tG\t.\t.\t.\tGT\t0/0\n")
    report = ["[Header]", "x", "[Data]", "SNP Name\tChr\tPosition\tAllele1 - Plus\tAllele2 - Plus", "rs1\t1\t100\tC\tC"]
    (tmp_path / "P4.txt").write_text("\n".join(report))
    for name, inner, lines in (("P5.zip", "a/x.txt", ["rsid,chromosome,position,genotype", "rs1,1,100,TT"]), ("P6.zip", "x.txt", ["##fileformat=VCFv4.2", "1\t100\trs1\tA\tT\t.\t.\t.\tGT\t0/1"])):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("readme.md", "no")
            z.writestr(inner, "\n".join(lines))
    e = Engine(spark)
    got = {r["pid"]: r["genotype"] for r in e.load_genotypes([str(p) for p in sorted(tmp_path.iterdir())]).collect()}
    assert got == {"P1": "AG", "P2": "GG", "P3.vcf": "AA", "P4": "CC", "P5": "TT", "P6": "AT"}
    for bad in (["a.bam"], ["a.txt", "b.cram"], []):
        with pytest.raises(ValueError):
            e.load_genotypes(bad)


def test_line_numbers_follow_the_file(spark, tmp_path):
    lines = [f"line {i:07d}" for i in range(60_000)]
    (tmp_path / "a.txt").write_text("\n".join(lines))
    (tmp_path / "b.txt").write_text("\n".join(lines[:1000]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 131072)
    try:
        got = text.read_lines(spark, [str(tmp_path)]).orderBy("file", "line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r["line"] for r in got] == lines + lines[:1000]


def test_required_entries(spark):
    from genoquery.operators import lookup

    specs, rows = spark.createDataFrame([("rs1",), ("rs2",)], "rsid string"), spark.createDataFrame([("rs1",)], "rsid string")
    assert lookup.require(rows, specs, "rsid").count() == 1
    with pytest.raises(LookupError, match="rs2"):
        lookup.require(specs, rows, "rsid")


def test_fastq_records(spark):
    got = text.fastq_records(_lines(spark, {"a": ["@q", "A", "+", "I"] * 3, "b": ["@q", "A"], "c": []})).collect()
    assert {tuple(r) for r in got} == {("a", 3), ("b", 1)}
