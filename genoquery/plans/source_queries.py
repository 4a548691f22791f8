"""Queries of the sources, sinks, checks and streams: lines are written from tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from genoquery.functions import genotype as G
from genoquery.plans.cases import CALLS, Cases, flatten, plain, view
from genoquery.session import table
from genoquery.sources import binary, manifest, sinks, text
from genoquery.streaming import arrivals

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


def _lines(df, parts, *head: str, sep="\t"):
    """Lines of one file per assay: header lines, then a line per row."""
    body = df.select(C("assay_id").alias("file"), C("record_id").alias("line_no"), F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).alias("line"))
    tops = df.select(C("assay_id").alias("file")).distinct().select("file", F.posexplode(F.array(*map(F.lit, head))).alias("i", "line")).select("file", (C("i") - 100).cast("long").alias("line_no"), "line")
    return body.unionByName(tops)


def _calls(spark, sf):
    c = view(spark, sf, CALLS)
    return c.groupBy("record_id", "assay_id", "rsid", "chrom", "pos", "ref", "alt", "display").agg(F.count(F.lit(1)).alias("copies"))


_DIST = f"(select distinct record_id, assay_id, trim(rsid) as rsid, chrom, pos, ref, alt, display from {plain(CALLS)})"
_G = "case when coalesce(display, '') = '' then '--' else array_to_string(list_sort(string_split(upper(display), '')), '') end"
_DEL = f"select assay_id as file, record_id as line_no, rsid, chrom, pos as position, {_G} as genotype from {_DIST} where rsid is not null or (chrom is not null and pos is not null)"


@query("src_05", _DEL)
def src_05(spark, sf):
    lines = _lines(_calls(spark, sf), [C("rsid"), C("chrom"), C("pos"), C("display")], "# comment", "# rsid\tchromosome\tposition\tgenotype", "")
    return text.delimited(lines).select("file", "line_no", "rsid", "chrom", "position", "genotype")


@query("src_06", _DEL)
def src_06(spark, sf):
    lines = _lines(_calls(spark, sf), [C("chrom"), C("rsid"), C("pos"), C("display")], "Chr,SNP ID,Base_pair-position,Your Code", sep=",")
    # the first field must name the marker: swap the columns back in the header line and the rows
    swap = F.split("line", ",", -1)
    lines = lines.select("file", "line_no", F.concat_ws(",", F.get(swap, F.lit(1)), F.get(swap, F.lit(0)), F.get(swap, F.lit(2)), F.get(swap, F.lit(3))).alias("line"))
    return text.delimited(lines, alphabetical=True).select("file", "line_no", "rsid", "chrom", "position", "genotype")


FIRST = Cases("s string", [("a\tb,c",), ("a,b c",), ("a b",), ("abc",), (" x ",)])


@query("src_04", f"select s, case when contains(s, chr(9)) then 'tab' when contains(s, ',') then 'comma' when regexp_matches(trim(s), '\\s') then 'space' else 'tab' end as d from {FIRST.sql()}")
def src_04(spark, sf):
    return FIRST.df(spark).select("s", text.delimiter(C("s")).alias("d"))


QUOTED = Cases("s string", [('a,b',), ('"a,b",c',), ('a"b,c"d,e',), ('"open,x',), ('""',), ('a,,b',), ('"a""b",c',)])


@query("src_07", rf"""select s, list_transform(regexp_extract_all(s || ',', '((?:[^,"]|"[^"]*(?:"|$))*)(?:,|$)', 1), lambda x: trim(replace(x, '"', '')))[1:-2] as f from {QUOTED.sql()} where s <> '"open,x' union all select '"open,x', ['open,x']""")
def src_07(spark, sf):
    return QUOTED.df(spark).select("s", text.split_quoted(C("s")).alias("f"))


PATHS = Cases("p string", [("a.zip",), ("B.CRAM",), ("c.bam",), ("d.vcf.gz",), ("e.bcf",), ("f.txt",)])


@query("src_01", f"select p, case when lower(p) like '%.zip' then 'zip' when lower(p) like '%.cram' then 'cram' when lower(p) like '%.bam' then 'bam' when lower(p) like '%.vcf' or lower(p) like '%.vcf.gz' then 'vcf' when lower(p) like '%.bcf' then 'bcf' else 'text' end as kind from {PATHS.sql()}")
def src_01(spark, sf):
    return spark.createDataFrame([(p, binary.source_format(p)) for (p,) in PATHS.rows], "p string, kind string")


@query("src_11", f"select assay_id as file, record_id as line_no, rsid, chrom, pos as position, case when display is null then '--' else array_to_string(list_sort([substr(display, 1, 1), substr(display, 2, 1)]), '') end as genotype from {_DIST} where chrom is not null and pos is not null and (display is null or length(display) = 2)")
def src_11(spark, sf):
    c = _calls(spark, sf).where("display is null or length(display) = 2")
    side = lambda i: F.coalesce(F.substring("display", i, 1), F.lit("-"))
    lines = _lines(c, [F.concat(F.lit("BOT-"), F.coalesce("rsid", F.lit("x:1"))), F.coalesce("chrom", F.lit("0")), F.coalesce("pos", F.lit(0)), side(1), side(2)], "[Header]", "Content\tx.bpm", "[Data]", "SNP Name\tChr\tPosition\tAllele1 - Plus\tAllele2 - Plus")
    return text.final_report(lines).select("file", "line_no", "rsid", "chrom", "position", "genotype")


_GT = "case record_id % 5 when 0 then '0/0' when 1 then '0/1' when 2 then '1/1' when 3 then './.' else '1' end"


@query("src_13", f"""select assay_id as file, record_id as line_no, rsid, chrom, pos as position, ref, [alt] as alts, case record_id % 5 when 3 then '--' when 0 then case when length(ref) = 1 then ref || ref else ref || '/' || ref end when 1 then case when length(ref) = 1 and length(alt) = 1 then least(ref, alt) || greatest(ref, alt) else ref || '/' || alt end
    when 2 then case when length(alt) < length(ref) then 'DD' when length(alt) > length(ref) then 'II' else alt || alt end else case when length(alt) < length(ref) then 'D' when length(alt) > length(ref) then 'I' else alt end end as genotype from {_DIST} where chrom is not null and pos is not null and ref is not null and alt is not null""")
def src_13(spark, sf):
    c = _calls(spark, sf).dropna(subset=["chrom", "pos", "ref", "alt"])
    gt = F.expr(_GT)
    lines = _lines(c, [C("chrom"), C("pos"), F.coalesce("rsid", F.lit(".")), C("ref"), C("alt"), F.lit("."), F.lit("PASS"), F.lit("."), F.lit("DP:GT"), F.concat(F.lit("9:"), gt)], "##fileformat=VCFv4.2", "#CHROM\tPOS")
    return text.vcf(lines).select("file", "line_no", "rsid", "chrom", "position", "ref", "alts", "genotype")


FORMATS = Cases("f string, s string", [("GT", "0/1"), ("DP:GT", "9:1|1"), ("DP", "9"), ("DP:gt:AD", "9:0/0"), ("DP:GT", "9")])


@query("src_14", f"select f, s, case when list_position(string_split(upper(f), ':'), 'GT') > 0 then coalesce(string_split(s, ':')[list_position(string_split(upper(f), ':'), 'GT')], '.') end as gt from {FORMATS.sql()}")
def src_14(spark, sf):
    at = F.array_position(F.split(F.upper("f"), ":"), "GT").cast("int")
    return FORMATS.df(spark).select("f", "s", F.when(at > 0, F.coalesce(F.try_element_at(F.split("s", ":"), at), F.lit("."))).alias("gt"))


HDS = Cases("i int, ref string, alt string, h array<double>", [(1, "A", "G", [0.9, 0.1]), (2, "A", "G", [0.5, 0.5]), (3, "A", "G", [0.2]), (4, "TG", "T", [0.7, 0.2]), (5, "A", "G", [])])


@query("src_15", f"""with a as (select i, list_transform(h, lambda x: case when x >= 0.5 then alt else ref end) as l, ref from {HDS.sql()}), b as (select i, case when len(l) = 1 then list_append(l, ref) else l end as l from a)
    select i, case when len(l) = 0 then null when len(list_filter(l, lambda x: length(x) > 1)) > 0 then array_to_string(l, '/') else array_to_string(list_sort(l), '') end as genotype from b""")
def src_15(spark, sf):
    return HDS.df(spark).select("i", G.genotype_from_hds(C("h"), C("ref"), C("alt")).alias("genotype"))


ZIPS = [["readme.md", "d/", "d/x.CSV"], ["a.bin", "b.bin"], ["x.vcf.gz", "y.txt"]]


@query("src_17", "select * from (values (0, 'd/x.CSV'), (1, 'a.bin'), (2, 'x.vcf.gz')) t(i, entry)")
def src_17(spark, sf):
    return spark.createDataFrame([(i, binary.zip_entry(n)) for i, n in enumerate(ZIPS)], "i int, entry string")


@query("src_20", "select cast(doc_id % 7 as varchar) as contig, substr(string_agg(substr(md5(cast(doc_id as varchar)), 1, 20), '' order by doc_id), 11, 20) as part from documents where doc_id < 400 group by 1".replace(" where doc_id < 400", ""))
def src_20(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", (C("doc_id") % 7).cast("string").alias("k"), F.substring(F.md5(C("doc_id").cast("string")), 1, 20).alias("s"))
    body = d.select(C("k").alias("file"), C("doc_id").alias("line_no"), C("s").alias("line"))
    lines = body.unionByName(d.select("k").distinct().select(C("k").alias("file"), F.lit(-1).cast("long").alias("line_no"), F.concat(F.lit(">"), "k", F.lit(" x")).alias("line")))
    return text.fasta(lines).select("contig", text.slice_sequence(C("sequence"), F.lit(10), F.least(F.lit(30), F.length("sequence"))).alias("part"))


@query("src_21", f"select assay_id as file, chrom as CHROM, cast(pos as varchar) as POS, ref as REF, alt as ALT, 'Del:' || record_id || ':9' as Sample from {_DIST} where chrom is not null and pos is not null and ref is not null and alt is not null")
def src_21(spark, sf):
    c = _calls(spark, sf).dropna(subset=["chrom", "pos", "ref", "alt"])
    lines = _lines(c, [C("chrom"), C("pos"), F.lit("."), C("ref"), C("alt"), F.lit("."), F.lit("."), F.lit("."), F.lit("GT:A:B"), F.concat(F.lit("Del:"), C("record_id"), F.lit(":9"))], "##x", "#CHROM\tPOS")
    return text.call_records(lines).select("file", "CHROM", "POS", "REF", "ALT", "Sample")


@query("src_22", "select cast(row_id as varchar) as id, coalesce(gene, '') as gene, coalesce(clnsig, '') as sig, '' as more from thalassemia_clinvar")
def src_22(spark, sf):
    t = table(spark, sf, "thalassemia_clinvar").select(F.lit("t").alias("assay_id"), C("row_id").alias("record_id"), "row_id", "gene", "clnsig")
    rows = text.table_rows(_lines(t, [C("row_id"), C("gene"), C("clnsig")], "id\tgene\tsig\tmore", ""))
    return rows.select(*[C("row")[k].alias(k) for k in ("id", "gene", "sig", "more")])


_LST = "list_filter(list_transform(string_split(coalesce({c}, ''), '|'), lambda x: trim(x)), lambda x: x <> '')"


@query("src_24", f"select variant_id as vid, coalesce(nullif(name, ''), 'catalogue-' || variant_id) as name, list_sort(list_distinct(list_concat({_LST.format(c='rsid')}, {_LST.format(c='aliases')}))) as rsids, ref, {_LST.format(c='alts')}[1] as alt, case when len({_LST.format(c='observed_alts')}) > 0 then {_LST.format(c='observed_alts')} else {_LST.format(c='alts')} end as observed, lower(kind) as kind from variant_catalogue where len({_LST.format(c='rsid')}) + len({_LST.format(c='aliases')}) > 0 or grch37_chrom is not null or grch38_chrom is not null")
def src_24(spark, sf):
    return text.catalogue(table(spark, sf, "variant_catalogue")).select("vid", "name", F.array_sort("rsids").alias("rsids"), "ref", "alt", "observed", "kind")


CHAIN = Cases("file string, line_no long, line string", [("c", i, x) for i, x in enumerate(["chain 50 chr1 1000 + 10 200 chr1 1100 + 20 210 1", "40 5 10", "60 10 0", "75", "", "chain 90 chrM 500 + 0 50 chrM 500 - 0 50 2", "50", "chain 7 chrUn 9 + 0 9 chr1 9 + 0 9 3", "9"])])


@query("src_27", "select * from (values (0, '1', 10, 50, '1', 20, 1100, '+', 50), (0, '1', 55, 115, '1', 70, 1100, '+', 50), (0, '1', 125, 200, '1', 130, 1100, '+', 50), (1, 'MT', 0, 50, 'MT', 0, 500, '-', 90)) t(idx, chrom, start, stop, to_chrom, to_start, to_size, strand, score)")
def src_27(spark, sf):
    return text.chain_blocks(CHAIN.df(spark)).drop("file")


@query("src_28", "select i, sha256(t) as digest, sha256(t) = d as ok from (values (1, 'abc', 'ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad'), (2, 'abd', 'x')) v(i, t, d)")
def src_28(spark, sf):
    rows = spark.createDataFrame([(1, "abc", "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"), (2, "abd", "x")], "i int, t string, d string")
    return rows.select("i", F.sha2("t", 256).alias("digest"), (F.sha2("t", 256) == C("d")).alias("ok"))


# --- sinks

_OBSCOLS = [c if c not in ("ref", "alt") else {"ref": "reference", "alt": "alternate"}[c] for c in sinks.OBSERVATION if c not in ("allele_balance",)]


@query("snk_01", "select md5(" + " || chr(9) || ".join(f"regexp_replace(coalesce(cast({c} as varchar), ''), '[\\t\\r\\n]', ' ', 'g')" for c in _OBSCOLS) + ") as line, count(*) as n from observations group by 1")
def snk_01(spark, sf):
    o = table(spark, sf, "observations")
    return o.groupBy(F.md5(sinks.tsv_line(o, _OBSCOLS)).alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query("snk_02", "select 'variant' || chr(9) || coalesce(name, '') || chr(9) || variant_id || repeat(chr(9), 10) || 'by' || ' tab' as line from variant_catalogue")
def snk_02(spark, sf):
    c = table(spark, sf, "variant_catalogue").select(F.lit("variant").alias("kind"), "name", C("variant_id").alias("path"), F.lit("by\ttab").alias("evidence"))
    return c.select(sinks.tsv_line(c, sinks.MANIFEST_ROW, "\t").alias("line"))


@query("snk_03", """select '{"row_id":' || row_id || ',"gene":' || coalesce('"' || replace(gene, '"', '\\"') || '"', 'null') || ',"position":' || coalesce(cast(position as varchar), 'null') || '}' as json from thalassemia_clinvar""")
def snk_03(spark, sf):
    return sinks.report_json(table(spark, sf, "thalassemia_clinvar").select("row_id", "gene", "position"))


@query("snk_04", """select '{"participant_id":"' || participant_id || '","tested":' || count(*) || ',"called":' || count(*) filter (where call_status = 'called') || '}' as json from observations where participant_id is not null group by participant_id""")
def snk_04(spark, sf):
    m = table(spark, sf, "observations").where("participant_id is not null").groupBy("participant_id").agg(F.count(F.lit(1)).alias("tested"), F.count_if(C("call_status") == "called").alias("called"))
    return sinks.report_json(m)


QUERIES["snk_11"] = lambda spark, sf: sinks.combine([table(spark, sf, "ancestrydna_csv_sample").select("file_id", "line_no"), table(spark, sf, "familytreedna_sample").select("file_id", "line_no")]).groupBy("file_id").agg(F.max("line_no").alias("lines"))
SQL["snk_11"] = "select file_id, max(line_no) as lines from (select file_id, line_no from ancestrydna_csv_sample union all select file_id, line_no from familytreedna_sample) group by 1"


@query("snk_12", "select * from (values (1, 'a.yaml'), (2, 'b.yaml')) t(step, path)")
def snk_12(spark, sf):
    rows = [x.split("\t") for x in sinks.trace(["a.yaml", "b.yaml"])[1:]]
    return spark.createDataFrame([(int(a), c) for a, _, c in rows], "step int, path string")


@query("snk_07", "select * from (values ('c1', 'rs1', 'AG')) t(name, rsid, genotype)")
def snk_07(spark, sf):
    rows = sinks.review_rows([{"name": "c1", "genotypes": {"rs1": "AG", "rs2": None}}])
    return spark.createDataFrame(rows, "name string, rsid string, genotype string")


# --- observations in full

_Z = """case when d = r || r and length(r) = 1 and length(a) = 1 then 'hom_ref' when d in (r || a, a || r) and length(r) = 1 and length(a) = 1 and r <> a then 'het' when d = a || a and length(r) = 1 and length(a) = 1 then 'hom_alt' else 'unknown' end"""


@query("call_20", f"""select record_id, case when rsid is not null or d <> '' then 'found' else 'not_found' end as match_status, case when depth is null or depth > 0 then 'covered' else 'not_covered' end as coverage_status, {_Z} as zygosity,
    case when depth = 0 then 'not_covered' when d = '' then 'no_call' when {_Z} = 'hom_ref' then 'reference' when {_Z} in ('het', 'hom_alt') then 'variant' else 'unknown' end as outcome, count(*) as n
    from (select record_id, rsid, depth, coalesce(display, '') as d, ref as r, alt as a from {plain(CALLS)} where kind = 'snp' and ref is not null and alt is not null and chrom is not null and (display is null or length(display) = 2) and chrom <> 'X')
    where d = '' or (d in (r || r, r || a, a || r, a || a)) group by all""")
def call_20(spark, sf):
    c = view(spark, sf, CALLS).where("kind = 'snp' and ref is not null and alt is not null and chrom is not null and (display is null or length(display) = 2) and chrom <> 'X'")
    c = c.withColumn("d", F.coalesce("display", F.lit(""))).where("d = '' or d in (ref || ref, ref || alt, alt || ref, alt || alt)")
    c = c.withColumn("z", G.app_genotype(C("d"), C("ref"), C("alt"), C("kind"), C("chrom"), F.lit(False))).withColumn("s", G.non_reportable(C("d"), C("ref"), C("alt"), F.array().cast("array<string>")))
    c = c.withColumn("v", G.call_values(C("depth"), C("s"), C("z.genotype"), C("z.zygosity"), C("d")))
    found = F.when(C("rsid").isNotNull() | (C("d") != ""), "found").otherwise("not_found")
    covered = F.when(C("depth").isNull() | (C("depth") > 0), "covered").otherwise("not_covered")
    return c.groupBy("record_id", found.alias("match_status"), covered.alias("coverage_status"), C("z.zygosity").alias("zygosity"), C("v.outcome").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def in_full(o, known):
    """Each observation as all columns of ``sinks.OBSERVATION``, worked out from its display, alleles and counts.

    ``known`` has ``rsid`` and ``observed``, the other alternates seen there. Rows stay as delivered, repeats included; a count
    below 0 is none; sexes are not inferred, so a display of two letters is diploid on X and Y too.
    """
    count = lambda c: F.when(C(c) >= 0, C(c))
    text_ = lambda c: F.coalesce(C(c), F.lit(""))
    o = o.withColumn("key", F.lower("rsid")).join(known.select(F.lower("rsid").alias("key"), "observed"), "key", "left").withColumn("observed", F.coalesce("observed", F.array().cast("array<string>")))
    o = o.withColumns({"ref": F.upper(text_("reference")), "alt": F.upper(text_("alternate")), "chrom": F.regexp_replace(text_("chrom"), "^(?i)chr", ""), "kind": F.lower(F.coalesce("kind", F.lit("unknown"))), "backend": F.when(C("evidence_type") == "mpileup", "cram").otherwise("text")})
    o = o.withColumns({c: count(c) for c in ("depth", "ref_count", "alt_count")})
    o = o.withColumn("d", F.coalesce(G.deletion_display(C("kind"), C("backend"), C("ref"), C("alt_count"), C("depth")), text_("genotype_display")))
    o = o.withColumn("alt", G.reportable_alt(C("d"), C("ref"), C("alt"), C("observed")))
    o = o.withColumn("z", G.app_genotype(C("d"), C("ref"), C("alt"), C("kind"), C("chrom"), F.lit(False))).withColumn("s", G.non_reportable(C("d"), C("ref"), C("alt"), C("observed")))
    o = o.withColumn("v", G.call_values(C("depth"), C("s"), C("z.genotype"), C("z.zygosity"), C("d"))).withColumn("weak", G.weak_indel(C("kind"), C("backend"), C("ref"), C("d")))
    got = {
        "assembly": F.upper("assembly"), "match_status": F.when((text_("rsid") != "") | (C("d") != ""), "found").otherwise("not_found"), "coverage_status": F.when(C("depth") == 0, "not_covered").otherwise("covered"),
        "call_status": C("v.call_status"), "genotype": C("z.genotype"), "genotype_display": C("v.reported"), "zygosity": C("z.zygosity"), "allele_balance": G.allele_balance(C("alt_count"), C("depth")), "outcome": C("v.outcome"),
        "evidence_type": F.when(C("backend") == "cram", "mpileup").otherwise("genotype_file"), "evidence_raw": text_("evidence_raw"), "match_quality": F.when(C("weak"), "weak"), "match_notes": F.when(C("weak"), WEAK), "facets": G.facets(C("s"), C("observed")),
    }
    return o.select("record_id", *[got.get(c, C(c)).alias(c) for c in sinks.OBSERVATION])


WEAK = "consumer genotype file reported an insertion/deletion token at the marker, not sequence-resolved evidence for the exact deletion allele"


# call_20 is the part of it that SQL checks
@query("call_20_full")
def call_20_full(spark, sf):
    c = table(spark, sf, "variant_catalogue").where("rsid is not null and observed_alts is not null").select(F.lower("rsid").alias("rsid"), F.explode(F.split("observed_alts", r"\|")).alias("a"))
    known = c.groupBy("rsid").agg(F.array_sort(F.collect_set(F.upper(F.trim("a")))).alias("observed"))
    return in_full(table(spark, sf, "observations"), known)


# --- checks

_CH = "coalesce(regexp_full_match(grch38_chrom, '[1-9]|1[0-9]|2[0-2]|X|Y|MT'), true)"


@query("val_02", f"select variant_id, coalesce(regexp_full_match(rsid, 'rs[0-9]*'), true) as rsid_ok, {_CH} as chrom_ok, coalesce(grch38_pos >= 1, true) as pos_ok, coalesce(grch38_end >= grch38_start, true) as range_ok from variant_catalogue")
def val_02(spark, sf):
    yes = lambda c: F.coalesce(c, F.lit(True))
    c = table(spark, sf, "variant_catalogue")
    return c.select("variant_id", yes(C("rsid").rlike("^rs[0-9]*$")).alias("rsid_ok"), yes(C("grch38_chrom").isin(sorted(manifest.CHROMS))).alias("chrom_ok"), yes(C("grch38_pos") >= 1).alias("pos_ok"), yes(C("grch38_end") >= C("grch38_start")).alias("range_ok"))


BAD = {"schema": "x:variant:1.0", "name": "n", "identifiers": {"rsids": ["rs1", "rs1", "x"]}, "coordinates": {"grch38": {"chrom": "99", "start": 5, "end": 5}}, "alleles": {"kind": "snv", "ref": "A", "alts": ["I"]}, "findings": [{"schema": "s", "alt": "G", "binding": {"source": "variant"}}]}


@query("val_01", "select * from (values ('error', 8), ('warning', 3)) t(severity, n)")
def val_01(spark, sf):
    return spark.createDataFrame(manifest.check_variant(BAD), manifest.ISSUES).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@query("val_04", "select * from (values ('members[0].kind'), ('members[0]'), ('analyses[0].derived_from')) t(path)")
def val_04(spark, sf):
    bad = {"schema": "x:assay:1.0", "name": "n", "members": [{"kind": "assay", "path": "a", "download": "d"}], "downloads": [], "analyses": [{"id": "a", "output_format": "tsv"}]}
    issues = [i for i in manifest.check_panel(bad, "assay") if i[1] != "members[0].download"]
    return spark.createDataFrame([(p,) for _, p, _ in issues], "path string")


@query("val_05", "select * from (values ('variants'), ('findings.source')) t(path)")
def val_05(spark, sf):
    return spark.createDataFrame([(p,) for _, p, _ in manifest.check_catalogue({"schema": "x:variant-catalogue:1.0", "name": "n", "findings": {"source": "f.csv"}})], "path string")


@query("val_06", "select * from (values ('provenance.sources[0].label'), ('provenance.sources[0].url'), ('downloads[0].sha256'), ('downloads[0].url')) t(path)")
def val_06(spark, sf):
    out: list = []
    manifest.check_provenance({"provenance": {"sources": [{"id": "a", "kind": "k"}]}, "downloads": [{"id": "d", "url": "https://a.org/x", "sha256": "1"}]}, out)
    return spark.createDataFrame([(p,) for _, p, _ in out], "path string")


QUERIES["val_07"], SQL["val_07"] = val_01, SQL["val_01"]


@query("val_03", "select * from (values ('findings[0].alt'), ('findings[0].binding.variant'), ('findings[0].binding.key'), ('findings[0].binding.value'), ('findings[0]')) t(path)")
def val_03(spark, sf):
    out: list = []
    manifest.check_findings({"alleles": {"alts": ["T"]}, "findings": BAD["findings"]}, out)
    return spark.createDataFrame([(p,) for _, p, _ in out], "path string")


FILES = {"p.yaml": "schema: x:panel:1.0\nmembers: [{kind: variant, path: v/a.yaml}, {kind: assay, path: b.yaml}]\nfindings: [{include: f.yaml, binding: {source: variant}}]", "v/a.yaml": "schema: x:variant:1.0\nname: A\nfindings: [{schema: s, label: own}]", "b.yaml": "schema: x:assay:1.0\nmembers: [{kind: variant, path: v/a.yaml}]", "f.yaml": "findings: [{schema: s, label: got}]"}


@query("set_02", "select * from (values ('got', 'variant', 1), ('own', null, 2)) t(label, source, n)")
def set_02(spark, sf):
    got = manifest.collect_findings("p.yaml", FILES.__getitem__)
    df = spark.createDataFrame([(f["label"], (f.get("binding") or {}).get("source")) for f in got], "label string, source string")
    return df.groupBy("label", "source").agg(F.count(F.lit(1)).cast("int").alias("n"))


# --- streams


@query("stream_events", "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n from events group by 1, 2")
def stream_events(spark, sf):
    """Hourly counts by type, read as a stream and run over all that has arrived."""
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").load(f"{sf}/events.parquet*", format="parquet").withColumn("ts", C("ts").cast("timestamp"))
    out = arrivals.run_once(arrivals.event_counts(stream, late="3650 days"), "events", "update")
    # an open window is written again in each batch in which it changed: the last state holds
    return out.groupBy(C("start").cast("timestamp_ntz").alias("start"), "event_type").agg(F.max("n").alias("n"))


@query("agg_12_arrivals", "select count(*) as n from (select distinct record_id from observations)")
def agg_12_arrivals(spark, sf):
    """Records without those delivered again, from the table as loaded."""
    return table(spark, sf, "observations").dropDuplicates(["record_id"]).agg(F.count(F.lit(1)).alias("n"))


@query("src_25", f"select assay_id as file, record_id as line_no, rsid, chrom, pos as position, coalesce(display, '') as genotype, record_id % 100 / 4.0 as gs from {_DIST}")
def src_25(spark, sf):
    """The older reader: alleles keep their order, and gs is a number."""
    c = _calls(spark, sf).withColumn("gs", (C("record_id") % 100) / 4.0)
    lines = _lines(c, [C("rsid"), C("chrom"), C("pos"), C("display"), C("gs")], "rsid\tchromosome\tposition\tgenotype\tgs")
    r = text.table_rows(lines)
    none = lambda k: F.nullif(F.trim(C("row")[k]), F.lit(""))
    return r.select("file", "line_no", none("rsid").alias("rsid"), none("chromosome").alias("chrom"), none("position").try_cast("long").alias("position"), C("row")["genotype"].alias("genotype"), none("gs").try_cast("double").alias("gs"))


_LEG = f"(select *, substr(genotype, 1, 1) as a1, substr(genotype, 2, 1) as a2, case when length(ref) = 1 and length(alt) = 1 then 'SNV' when length(ref) = 1 and length(alt) > 1 then 'INSERTION' when length(ref) > 1 and length(alt) = 1 then 'DELETION' when length(ref) = length(alt) then 'INDEL' else 'MNV' end as variant_type from {plain(CALLS)} where length(genotype) = 2 and ref is not null and alt is not null)"
_LEG_BASES = "list_filter([a1, a2], lambda x: x in ('A', 'C', 'G', 'T'))"


@query("leg_08", f"""select pid as participant_id, gene, rsid, chrom as chromosome, pos as position, least(a1, a2) || greatest(a1, a2) as genotype, ref, alt, variant_type, case
    when variant_type = 'SNV' then case when a1 = a2 and a1 = ref then 'REFERENCE_CALL' when a1 = alt or a2 = alt then 'VARIANT_CALL' else 'NO_CALL' end
    when variant_type in ('INSERTION', 'DELETION') then case when (case variant_type when 'INSERTION' then 'I' else 'D' end) in (a1, a2) then 'VARIANT_CALL' when (case variant_type when 'INSERTION' then 'D' else 'I' end) in (a1, a2) then 'REFERENCE_CALL' else 'NO_CALL' end
    when len({_LEG_BASES}) > 0 and len(list_filter({_LEG_BASES}, lambda x: contains(alt, x))) = len({_LEG_BASES}) and len(list_filter({_LEG_BASES}, lambda x: contains(ref, x))) = 0 then 'VARIANT_CALL'
    when len({_LEG_BASES}) > 0 and len(list_filter({_LEG_BASES}, lambda x: contains(ref, x))) = len({_LEG_BASES}) and len(list_filter({_LEG_BASES}, lambda x: contains(alt, x))) = 0 then 'REFERENCE_CALL' else 'NO_CALL' end as match_type,
    (a1 = ref)::int + (a2 = ref)::int as ref_count, (a1 = alt)::int + (a2 = alt)::int as alt_count, assay_id || '.txt' as filename from {_LEG}""")
def leg_08(spark, sf):
    """The older matcher's report row of every two-allele call."""
    c = view(spark, sf, CALLS).where("length(genotype) = 2 and ref is not null and alt is not null").withColumns({"a1": F.substring("genotype", 1, 1), "a2": F.substring("genotype", 2, 1), "variant_type": G.variant_type(C("ref"), C("alt"))})
    both = F.array("a1", "a2")
    kind = C("variant_type")
    match = F.when(kind == "SNV", G.match_snv(C("a1"), C("a2"), F.array("ref"), F.array("alt"))).when(kind.isin("INSERTION", "DELETION"), G.match_indel(C("a1"), C("a2"), kind)).otherwise(G.match_complex(C("a1"), C("a2"), C("ref"), C("alt")))
    count = lambda allele: F.size(F.filter(both, lambda x: x == C(allele)))
    return c.select(
        C("pid").alias("participant_id"), "gene", "rsid", C("chrom").alias("chromosome"), C("pos").alias("position"), F.array_join(F.array_sort(both), "").alias("genotype"), "ref", "alt", "variant_type", match.alias("match_type"),
        count("ref").alias("ref_count"), count("alt").alias("alt_count"), F.concat("assay_id", F.lit(".txt")).alias("filename"),
    )


@query("api_05", "select participant_id as pid, genotype_display as genotype from observations where lower(rsid) = 'rs7040732293' and genotype_display is not null qualify row_number() over (partition by participant_id order by record_id, genotype_display) = 1")
def api_05(spark, sf):
    from genoquery.engine import Engine

    rows = view(spark, sf, CALLS).select("pid", C("record_id").alias("row_idx"), "rsid", "chrom", "pos", C("display").alias("genotype"))
    return Engine(spark).get(rows, "rs7040732293")


@query("api_06", """with o as (select participant_id as pid, record_id as row_idx, lower(rsid) as rsid, lower(case when lower(chrom) like 'chr%' then substr(chrom, 4) else chrom end) as chrom, pos_start as pos, genotype_display as genotype from observations),
    h as (select pid, 0 as vid, row_idx, 0 as prio, genotype, rsid from o where rsid = 'rs7040732293' union all select pid, 1, row_idx, 1, genotype, rsid from o where chrom = '11' and pos = 5226725), w as (select * from h where genotype is not null qualify row_number() over (partition by pid, vid order by row_idx, prio, genotype, rsid nulls first) = 1)
    select p.pid, s.vid, w.genotype from (select distinct pid from o) p cross join (values (0), (1)) s(vid) left join w on w.pid = p.pid and w.vid = s.vid""")
def api_06(spark, sf):
    from genoquery.engine import Engine, variant

    e = Engine(spark)
    rows = view(spark, sf, CALLS).select("pid", C("record_id").alias("row_idx"), "rsid", F.lower("chrom").alias("chrom"), "pos", C("display").alias("genotype"))
    return e.lookup_variants(rows, e.query_plan([variant(rsid="rs7040732293"), variant(grch38="11:5226725-5226725")])).select("pid", "vid", "genotype")


flatten(QUERIES, SQL, {"src_07": ["f"], "src_13": ["alts"], "src_24": ["rsids", "observed"]})


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
