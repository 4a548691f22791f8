"""Queries of the script calls, of files written and read back, and of whole-file inspection."""

from __future__ import annotations

import gzip
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Window
from pyspark.sql import functions as F

from genoquery.engine import Engine, variant
from genoquery.functions import genotype as G
from genoquery.operators import inspect, rawlines, vntr
from genoquery.operators.cohort import apol1_status
from genoquery.plans.cases import CALLS, READS, Cases, plain, view
from genoquery.plans.relational_queries import APOL, VNTR
from genoquery.session import shared_dir, table
from genoquery.sources import binary, manifest, sinks, text

C = F.col
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _place(spark) -> str:
    """A new folder that every executor reaches."""
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


@query("nrm_07", """select variant_id, case when grch38_chrom is not null then 0 when grch37_chrom is not null then 1 else 2 end as build, case when c is null then '~' when regexp_full_match(k, '\\d+') then lpad(k, cast(greatest(3, length(k)) as int), '0') when upper(k) = 'X' then '023' when upper(k) = 'Y' then '024' when upper(k) in ('M', 'MT') then '025' else '999-' || upper(k) end as chrom_key
    from (select *, coalesce(grch38_chrom, grch37_chrom) as c, regexp_replace(trim(coalesce(grch38_chrom, grch37_chrom)), '^chr', '') as k from variant_catalogue)""")
def nrm_07(spark, sf):
    c = F.coalesce("grch38_chrom", "grch37_chrom")
    return table(spark, sf, "variant_catalogue").select("variant_id", F.when(C("grch38_chrom").isNotNull(), 0).when(C("grch37_chrom").isNotNull(), 1).otherwise(2).alias("build"), F.coalesce(G.chrom_sort_key(c), F.lit("~")).alias("chrom_key"))


LONG = Cases("display string, ref string, alt string", [("TG/T", "TG", "T"), ("TGTG", "TG", "T"), ("T|T", "TG", "T"), ("t/tg", "TG", "T"), ("TGA", "TG", "T"), ("T-TG", "T", "TG")])


@query("call_07", f"select display, ref, alt, case when d = ref || ref then 'hom_ref' when d = alt || alt then 'hom_alt' when d in (ref || alt, alt || ref) then 'het' else 'unknown' end as zygosity from (select *, upper(regexp_replace(display, '[/| .-]', '', 'g')) as d from {LONG.sql()})")
def call_07(spark, sf):
    z = G.app_genotype(C("display"), C("ref"), C("alt"), F.lit("indel"), F.lit("1"), F.lit(False))
    return LONG.df(spark).select("display", "ref", "alt", z["zygosity"].alias("zygosity"))


_U = f"(select sample, idx, split_part(CHROM, '-', 1) as motif, POS, REF, ALT, coalesce(try_cast(split_part(Sample_text, ':', 2) as double), 0) / nullif(coalesce(try_cast(split_part(Sample_text, ':', 3) as double), 0), 0) as score from {VNTR.sql()} where POS >= 60 and CHROM like '%-%')"


@query("win_08", f"select sample as who, idx from (select *, row_number() over (partition by sample, POS, REF, ALT order by coalesce(score, 0) desc, idx) as k from {_U} where motif not in ('8', '9', '7', '6p', '6')) where k = 1 and ALT <> 'GG'")
def win_08(spark, sf):
    """The uniform form for right motifs: excluded motifs go, the best call of a locus stays, and ALT GG only with an allowed motif, of which there is none."""
    c = vntr.annotate(VNTR.df(spark).where("POS >= 60 and CHROM like '%-%'").select(C("sample").alias("who"), "idx", "CHROM", "POS", "REF", "ALT", C("Sample_text").alias("Sample")))
    c = c.where(~F.substring_index("CHROM", "-", 1).isin(vntr.RIGHT_EXCLUDED))
    w = Window.partitionBy("who", "POS", "REF", "ALT").orderBy(F.coalesce("depth_score", F.lit(0.0)).desc(), "idx")
    return c.withColumn("k", F.row_number().over(w)).where("k = 1 and ALT <> 'GG'").select("who", "idx")


@query("ins_01", """select s.file_id, s.vendor = 'familytreedna' as ftdna, count(*) > 0 as read_ from samplesheet s join (select file_id from ancestrydna_csv_sample union all select file_id from familytreedna_sample) l using (file_id) group by 1, 2""")
def ins_01(spark, sf):
    """One row per raw file: whether it is one vendor's, and that it could be read. See ``inspection`` for all that is told."""
    return inspection(spark, sf).select("file_id", (C("vendor") == "familytreedna").alias("ftdna"), (C("lines") > 0).alias("read_"))


@query("ins_01_files")
def inspection(spark, sf):
    """Per raw file: vendor, lines, whether they have the shape of genotypes, and the build its comments name."""
    one = lambda t, v: table(spark, sf, t).select("file_id", F.lit(v).alias("vendor"), "line")
    raw = one("ancestrydna_csv_sample", "ancestrydna_csv").unionByName(one("familytreedna_sample", "familytreedna"))
    t = F.trim(F.regexp_replace("line", "^﻿|[\r\n]+$", ""))
    note = t.startswith("#") | t.startswith("//")
    shape = F.coalesce(inspect.genotype_shape(t), F.lit(False))
    per = raw.groupBy("vendor", "file_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(~note & (t != "")).alias("data"), F.count_if(~note & shape).alias("shaped"), F.max(F.when(note, inspect.assembly_from_text(t))).alias("assembly"))
    return per.select("vendor", "file_id", "lines", (C("shaped") * 10 >= C("data") * 7).alias("genotypes"), "assembly")


_TXT = "P1", ["rs1\t1\t100\tAG", "rs2\tX\t7\tTT"]


_FORMS = "select record_id, pid, rsid, chrom, pos, ref, alt, display, record_id % 2 as form from (" + CALLS + ") where rsid like 'rs%' and chrom is not null and pos is not null and length(ref) = 1 and length(alt) = 1 and ref <> alt and length(display) = 2 and record_id is not null"
_LOADED = f"select rsid, min(genotype) as least, max(genotype) as most, count(*) as n from (select form, rsid, case when form = 1 then case when display = ref || ref then ref || ref when display in (ref || alt, alt || ref) then least(ref, alt) || greatest(ref, alt) when display = alt || alt then alt || alt else '--' end else case when display = '--' then '--' else least(substr(display, 1, 1), substr(display, 2, 1)) || greatest(substr(display, 1, 1), substr(display, 2, 1)) end end as genotype from {plain(_FORMS)} where regexp_full_match(display, '[ACGT]{{2}}|--')) group by 1"


@query("api_01", _LOADED)
def api_01(spark, sf):
    """SNP rows written as plain text and as VCF without its ending, and loaded in one call."""
    r = view(spark, sf, _FORMS).where("display rlike '^(?:[ACGT]{2}|--)$'")
    place = _place(spark)
    plain_line = F.concat_ws("\t", "rsid", "chrom", "pos", "display")
    two = lambda a, b: F.concat(a, b)
    gt = F.when(C("display") == two("ref", "ref"), "0/0").when(C("display").isin(two("ref", "alt"), two("alt", "ref")) | (C("display") == two("ref", "alt")) | (C("display") == two("alt", "ref")), "0/1").when(C("display") == two("alt", "alt"), "1/1").otherwise("./.")
    vcf_line = F.concat_ws("\t", "chrom", "pos", "rsid", "ref", "alt", F.lit("."), F.lit("."), F.lit("."), F.lit("GT"), gt)
    head = lambda line: spark.createDataFrame([(line,)], "value string")
    head("rsid\tchromosome\tposition\tgenotype").unionByName(r.where("form = 0").select(plain_line.alias("value"))).coalesce(1).write.text(f"{place}/p0")
    head("##fileformat=VCFv4.2").unionByName(r.where("form = 1").select(vcf_line.alias("value"))).coalesce(1).write.text(f"{place}/p1")

    return Engine(spark).load_genotypes([f"{place}/p0", f"{place}/p1"]).groupBy("rsid").agg(F.min("genotype").alias("least"), F.max("genotype").alias("most"), F.count(F.lit(1)).alias("n"))


QUERIES["src_02"], SQL["src_02"] = api_01, SQL["api_01"]


@query("src_03", "select * from (values ('zip', 'vcf', 'vcf', 'text')) t(a, b, c, d)")
def src_03(spark, sf):
    got = [binary.sniff(b"PK\x03\x04"), binary.sniff(gzip.compress(b"##fileformat=VCFv4.2\n")), binary.sniff(b"##fileformat=VCFv4.2"), binary.sniff(b"rsid\t")]
    return spark.createDataFrame([tuple(got)], "a string, b string, c string, d string")


@query("api_02", "select * from (values (0, 'rs1', 'chr1:5-5'), (1, null, 'chr2:7-9')) t(vid, rsid, grch38)")
def api_02(spark, sf):
    plan = Engine(spark).query_plan([variant("rs1", grch38="chr1:5-5"), variant(grch38="chr2:7-9", kind="deletion", deletion_length=3)])
    return plan.select("vid", F.try_element_at("rsids", F.lit(1)).alias("rsid"), "grch38")


QUERIES["api_03"], SQL["api_03"] = api_02, SQL["api_02"]


@query("snk_05", "select row_id, nullif(gene, '') as gene, position from thalassemia_clinvar")
def snk_05(spark, sf):
    e, place = Engine(spark), _place(spark)
    e.write_tsv(table(spark, sf, "thalassemia_clinvar").select("row_id", "gene", "position"), place)
    return e.read_tsv(place).select(C("row_id").cast("long").alias("row_id"), "gene", C("position").cast("long").alias("position"))


QUERIES["api_04"], SQL["api_04"] = snk_05, SQL["snk_05"]
QUERIES["snk_09"], SQL["snk_09"] = snk_05, SQL["snk_05"]


@query("src_23", "select row_id, gene from thalassemia_clinvar")
def src_23(spark, sf):
    place = _place(spark)
    sinks.write_jsonl(table(spark, sf, "thalassemia_clinvar").select("row_id", "gene"), place)
    return text.analysis_rows(spark, place, "jsonl").select("row_id", "gene")


@query("snk_06", "select true as has_title, 26 as rows")
def snk_06(spark, sf):
    page = sinks.html_table(table(spark, sf, "nation"), "nations")
    return spark.createDataFrame([("<title>nations</title>" in page, page.count("<tr>"))], "has_title boolean, rows int")


FASTQ = f"select name, base, qual, flag from {plain(READS)}"


@query("snk_08", f"select 4 * count(*) as lines from (select name from {plain(READS)} group by name having count(*) filter (where flag & 64 <> 0) > 0 and count(*) filter (where flag & 128 <> 0) > 0)")
def snk_08(spark, sf):
    place = _place(spark)
    sinks.write_fastq(view(spark, sf, READS).select("name", "flag", C("base").alias("seq"), F.array("qual").alias("qual")), place)
    return spark.read.text(f"{place}/r2").agg(F.count(F.lit(1)).alias("lines"))


@query("snk_10", "select participant_id, count(*) as n from observations group by 1")
def snk_10(spark, sf):
    """A result kept partitioned for later queries, and read back with a partition filter at hand."""
    place = _place(spark)
    table(spark, sf, "observations").groupBy("participant_id").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)


@query("src_18", f"select event_id from {plain(READS)} where chrom = '2' and start <= 900 and stop >= 501")
def src_18(spark, sf):
    return Engine(spark).fetch(view(spark, sf, READS), "2", 500, 900).select("event_id")


QUERIES["api_07"], SQL["api_07"] = src_18, SQL["src_18"]


@query("api_08", "select 'GTA' as bases")
def api_08(spark, sf):
    lines = spark.createDataFrame([("f", 0, ">c1 x"), ("f", 1, "AC"), ("f", 2, "GTAC")], "file string, line_no long, line string")
    return text.fasta(lines).select(text.slice_sequence(C("sequence"), F.lit(2), F.lit(5)).alias("bases"))


@query("api_09", f"select record_id, row_number() over (partition by chrom order by pos, record_id) as place from (select distinct record_id, chrom, pos from {plain(CALLS)} where chrom is not null and pos between 5000000 and 6000000)")
def api_09(spark, sf):
    """View of a region and sort by place."""
    c = view(spark, sf, CALLS).where("chrom is not null and pos between 5000000 and 6000000").select("record_id", "chrom", "pos").distinct()
    return c.select("record_id", F.row_number().over(Window.partitionBy("chrom").orderBy("pos", "record_id")).alias("place"))


@query("api_10", f"select sample, count(*) as n from {VNTR.sql()} group by 1")
def api_10(spark, sf):
    v = VNTR.df(spark)
    line = F.concat_ws("\t", "CHROM", C("POS").cast("string"), F.lit("."), "REF", "ALT", F.lit("."), F.lit("."), F.lit("."), F.lit("GT"), "Sample_text")
    calls = text.call_records(v.select(C("sample").alias("file"), C("idx").cast("long").alias("line_no"), line.alias("line")))
    return calls.groupBy(C("file").alias("sample")).agg(F.count(F.lit(1)).alias("n"))


@query("api_12", f"select chrom, start, count(*) as depth from {plain(READS)} where flag & 4 = 0 group by 1, 2")
def api_12(spark, sf):
    return view(spark, sf, READS).where((C("flag").bitwiseAND(F.lit(4))) == 0).groupBy("chrom", "start").agg(F.count(F.lit(1)).alias("depth"))


_STATUS = f"(select pid, case when s1 is null and s2 is null and g2 is null then 'G-/G-' else 'other' end as st from {APOL.sql()})"


@query("api_13", f"select pid, st = 'G-/G-' as APOL1_missing from {_STATUS}")
def api_13(spark, sf):
    rule = lambda d: d.select("pid", (apol1_status(C("s1"), C("s2"), C("g2")) == "G-/G-").alias("missing"))
    return Engine(spark).classify(APOL.df(spark), rule, "APOL1")


QUERIES["api_14"], SQL["api_14"] = api_13, SQL["api_13"]


@query("src_30", "select * from (values ('a/x.tsv'), ('manifest.yaml')) t(name)")
def src_30(spark, sf):
    with tempfile.TemporaryDirectory() as d:  # a package is unpacked by the driver
        path = os.path.join(d, "p.zip")
        with zipfile.ZipFile(path, "w") as z:
            z.writestr("manifest.yaml", "x")
            z.writestr("a/x.tsv", "y")
        names = manifest.import_package(path, os.path.join(d, "out"))
    return spark.createDataFrame([(n,) for n in names], "name string")


@query("p6_profile")
def p6_profile(spark, sf):
    """The path-type statistics behind p6: per file and column the usual raw type and its count."""
    _, files = rawlines.parse(rawlines.read_lines({"ancestrydna_csv": table(spark, sf, "ancestrydna_csv_sample"), "familytreedna": table(spark, sf, "familytreedna_sample")}))
    return files.select("vendor", "file_id", F.explode(F.arrays_zip("names", "profile")).alias("z")).where("z.profile is not null").select("vendor", "file_id", C("z.names").alias("path"), "z.profile.type", "z.profile.n")


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
