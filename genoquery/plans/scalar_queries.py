"""Queries of the scalar rules: normalisation, calls, displays, dosage, allele sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from genoquery.functions import genotype as G
from genoquery.plans.cases import CALLS, Cases, flatten, plain, view

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


TEXTS = Cases("g string", [(x,) for x in ("AG", "ga", " g a ", "", "NA", "n/a", "#N/A", "none", "A/G", "G|A", "A/", "-/A", "TG/T", "--", "0", "I D", "a|", "N/A ", "T", None)])
_UP = "upper(replace(trim(g), ' ', ''))"
_NORM = f"""case when g is null then null when {_UP} in ('', 'NA', 'N/A', '#N/A', 'NONE') then '--' when regexp_matches({_UP}, '[/|]') and len(list_filter(string_split_regex({_UP}, '[/|]'), lambda p: p in ('', '-'))) > 0 then 'ID'
    when regexp_matches({_UP}, '[/|]') then array_to_string(list_sort(string_split_regex({_UP}, '[/|]')), '') else array_to_string(list_sort(string_split({_UP}, '')), '') end"""


@query("nrm_01", f"select g, {_NORM} as genotype, count(*) as n from (select g from {TEXTS.sql()} union all select genotype from observations) group by all")
def nrm_01(spark, sf):
    g = TEXTS.df(spark).unionByName(view(spark, sf, "select genotype as g from {observations}"))
    return g.groupBy("g").count().select("g", G.normalize_genotype(C("g")).alias("genotype"), C("count").alias("n"))


GTS = Cases("i int, gt string, ref string, alts array<string>", [
    (1, "0/1", "A", ["G"]), (2, "1|0", "A", ["G"]), (3, "1/1", "A", ["G"]), (4, "./.", "A", ["G"]), (5, ".", "A", ["G"]), (6, "1", "A", ["G"]), (7, "0", "A", ["G"]), (8, "0/1", "TG", ["T"]), (9, "1/1", "TG", ["T"]), (10, "1/1", "T", ["TG"]),
    (11, "1/2", "T", ["TG", "A"]), (12, "2/2", "A", ["G"]), (13, "0/1", "A", ["<DEL>"]), (14, "0/0", "TG", ["T"]), (15, "0/1/1", "A", ["G"]), (16, "x/1", "A", ["G"]), (17, "1/.", "A", ["G"]), (18, " 0/1 ", "a", ["g"]), (19, "", "A", ["G"]), (20, "1/2", "AC", ["A", "ACC"]), (21, "0/3", "A", ["G", "T"]),
])
_ALT_TOK = "case when starts_with(trim(a), '<') and ends_with(trim(a), '>') then '--' when length(a) < length(ref) then 'D' when length(a) > length(ref) then 'I' else upper(trim(a)) end"


@query("nrm_02", f"""with x as (select *, replace(trim(gt), '|', '/') as t from {GTS.sql()}), p as (select *, string_split(t, '/') as ps from x),
    ok as (select *, regexp_full_match(t, '\\d+(/\\d+)?') as known from p), u as (select i, known, ref, alts, unnest(case when known then list_transform(ps, lambda q: cast(q as int)) else [0] end) as k, generate_subscripts(ps[1:case when known then 2 else 1 end], 1) as ord from ok),
    w as (select *, alts[k] as a, min(k) over (partition by i) > 0 as only_alt from u),
    tok as (select *, case when k = 0 then upper(trim(ref)) when k > len(alts) then '#beyond' when starts_with(trim(a), '<') then '#sym' when only_alt then {_ALT_TOK} else upper(trim(a)) end as tk from w),
    l as (select i, bool_and(known) as known, list(tk order by ord) as ts from tok group by i)
    select i, case when not known then '--' when len(list_filter(ts, lambda q: starts_with(q, '#'))) > 0 then case when list_filter(ts, lambda q: starts_with(q, '#'))[1] = '#sym' then '--' end
      when len(list_filter(ts, lambda q: length(q) <> 1)) = 0 then array_to_string(list_sort(ts), '') else array_to_string(ts, '/') end as genotype from l""")
def nrm_02(spark, sf):
    return GTS.df(spark).select("i", G.genotype_from_gt(C("gt"), C("ref"), C("alts")).alias("genotype"))


ALLELES = Cases("i int, ref string, alts array<string>", [(1, "A", ["G"]), (2, "TG", ["T"]), (3, "T", ["TG"]), (4, "TG", ["T", "TGG"]), (5, "tg", ["<DEL>"]), (6, "a", ["g", "ca"]), (7, "TG", ["CA"])])


@query("nrm_03", f"""select i, case when s > 0 and l = 0 then 'I' when l > 0 and s = 0 then 'D' else upper(trim(ref)) end as token from (select i, ref, len(list_filter(alts, lambda a: not starts_with(a, '<') and length(a) < length(ref))) as s,
    len(list_filter(alts, lambda a: not starts_with(a, '<') and length(a) > length(ref))) as l from {ALLELES.sql()})""")
def nrm_03(spark, sf):
    return ALLELES.df(spark).select("i", G.ref_token(C("ref"), C("alts")).alias("token"))


@query("nrm_04", f"select i, a, {_ALT_TOK} as token from (select i, ref, unnest(alts) as a from {ALLELES.sql()})")
def nrm_04(spark, sf):
    return ALLELES.df(spark).select("i", "ref", F.explode("alts").alias("a")).select("i", "a", G.alt_token(C("ref"), C("a")).alias("token"))


CHROMS = Cases("c string", [(x,) for x in ("1", "chr1", "CHR1", " chr7 ", "chrchr2", "X", "chrX", "x", "23", "24", "25", "26", "M", "MT", "chrM", "chr_1_alt", "", "GL000", None)])
_SEX = "case {u} when '23' then 'X' when '24' then 'Y' when '25' then 'XY' when '26' then 'MT' when 'M' then 'MT' else {u} end"


@query("nrm_05", f"""select c, lower(regexp_replace(trim(c), '^(chr)+', '')) as match_key, {_SEX.format(u="upper(regexp_replace(regexp_replace(trim(c), '^(chr)+', ''), '^(CHR)+', ''))")} as sex_name,
    {_SEX.format(u="upper(regexp_replace(trim(c), '^(chr|CHR)', ''))")} as anchor_name, upper(regexp_replace(regexp_replace(trim(c), '^(chr)+', ''), '^(CHR)+', '')) in ('X', 'Y', '23', '24') as is_sex, count(*) as n
    from (select c from {CHROMS.sql()} union all select chrom from observations union all select chromosome from thalassemia_clinvar) group by all""")
def nrm_05(spark, sf):
    c = CHROMS.df(spark).union(view(spark, sf, "select chrom as c from {observations}")).union(view(spark, sf, "select chromosome as c from {thalassemia_clinvar}")).groupBy("c").count()
    return c.select("c", G.chrom_match_key(C("c")).alias("match_key"), G.chrom_for_sex(C("c")).alias("sex_name"), G.chrom_for_anchor(C("c")).alias("anchor_name"), G.chrom_is_sex(C("c")).alias("is_sex"), C("count").alias("n"))


_T = "regexp_replace(trim(c), '^chr', '')"


@query("nrm_06", f"""select c, case when regexp_full_match({_T}, '\\d+') then lpad({_T}, cast(greatest(3, length({_T})) as int), '0') when upper({_T}) = 'X' then '023' when upper({_T}) = 'Y' then '024' when upper({_T}) in ('M', 'MT') then '025' when c is not null then '999-' || upper({_T}) end as key, count(*) as n
    from (select c from {CHROMS.sql()} union all select chrom from observations) group by all""")
def nrm_06(spark, sf):
    c = CHROMS.df(spark).union(view(spark, sf, "select chrom as c from {observations}")).groupBy("c").count()
    return c.select("c", G.chrom_sort_key(C("c")).alias("key"), C("count").alias("n"))


LINES = Cases("v string", [("rs1\t1\t100\tAG\r\n",), ("a\x01b",), ("plain",), ("x # note",), ("x // note # y",), ("http://a",), ("﻿rsid",), ("  SNP_Id ",), ("Allele1 - Top",), ("",), (None,)])


@query("nrm_08", f"select v, regexp_replace(regexp_replace(regexp_replace(v, '[\\r\\n]+$', ''), '\\t', '  ', 'g'), '[\\x00-\\x1f\\x7f]', ' ', 'g') as line from {LINES.sql()}")
def nrm_08(spark, sf):
    return LINES.df(spark).select("v", G.evidence_line(C("v")).alias("line"))


@query("src_08", f"select v, trim(case when contains(v, '#') then split_part(v, '#', 1) else split_part(v, '//', 1) end) as value from {LINES.sql()}")
def src_08(spark, sf):
    return LINES.df(spark).select("v", G.inline_comment(C("v")).alias("value"))


@query("src_09", f"select v, case when starts_with(v, chr(65279)) then substr(v, 2) else v end as value from {LINES.sql()}")
def src_09(spark, sf):
    return LINES.df(spark).select("v", G.strip_bom(C("v")).alias("value"))


@query("src_10", f"select v, replace(replace(replace(lower(trim(v)), ' ', ''), '_', ''), '-', '') as name from {LINES.sql()}")
def src_10(spark, sf):
    return LINES.df(spark).select("v", G.column_name(C("v")).alias("name"))


@query("nrm_09", "select genotype, translate(genotype, 'ACGTacgt', 'TGCAtgca') as flipped, count(*) as n from observations group by all")
def nrm_09(spark, sf):
    return view(spark, sf, "select genotype from {observations}").groupBy("genotype").count().select("genotype", G.complement_genotype(C("genotype")).alias("flipped"), C("count").alias("n"))


LOCI = Cases("s string", [("chr1:100-200",), ("X:5-5",), ("1:100",), ("1:a-b",), ("",), (None,)])


@query("nrm_10", f"""select s, case when regexp_full_match(s, '[^:]+:\\d+-\\d+') then split_part(s, ':', 1) end as chrom, case when regexp_full_match(s, '[^:]+:\\d+-\\d+') then cast(regexp_extract(s, ':(\\d+)-', 1) as bigint) end as start,
    case when regexp_full_match(s, '[^:]+:\\d+-\\d+') then cast(regexp_extract(s, '-(\\d+)$', 1) as bigint) end as stop from {LOCI.sql()}""")
def nrm_10(spark, sf):
    p = r"^([^:]+):(\d+)-(\d+)$"
    got = lambda i: F.when(C("s").rlike(p), F.regexp_extract("s", p, i))
    return LOCI.df(spark).select("s", got(1).alias("chrom"), got(2).cast("long").alias("start"), got(3).cast("long").alias("stop"))


NAMES = Cases("f string", [("P1.txt.zip",), ("a.csv",), ("a.csv.csv",), ("b.vcf.gz",), ("x.txt.csv",), ("x.csv.txt",), ("y.cram",), ("z.zip.txt.zip",), ("plain",)])


@query("nrm_11", "select f, " + "regexp_replace(" * 7 + "f" + "".join(f", '({e})+$', '')" for e in (r"\.txt\.zip", r"\.csv\.zip", r"\.vcf\.gz", r"\.cram", r"\.zip", r"\.txt", r"\.csv")) + f" as participant, count(*) as n from (select f from {NAMES.sql()} union all select genotype_file from samplesheet) group by all")
def nrm_11(spark, sf):
    f = NAMES.df(spark).union(view(spark, sf, "select genotype_file as f from {samplesheet}")).groupBy("f").count()
    return f.select("f", G.participant_from_file(C("f")).alias("participant"), C("count").alias("n"))


PROBES = Cases("p string", [("BOT-rs1135675",), ("rs111647200_ilmndup1",), ("1:103380393",), ("RS12",), ("rsx12rs9",), ("",), (None,)])


@query("src_12", f"select p, case when regexp_matches(p, '(?i)rs\\d') then 'rs' || regexp_extract(p, '(?i)rs(\\d+)', 1) end as rsid from {PROBES.sql()}")
def src_12(spark, sf):
    return PROBES.df(spark).select("p", G.probe_rsid(C("p")).alias("rsid"))


# --- calls over all observations

_RANK = "case when strpos('ACGTID', upper(substr({a}, 1, 1))) > 0 then strpos('ACGTID', upper(substr({a}, 1, 1))) else 99 end"
_HET = f"case when {_RANK.format(a='alt')} < {_RANK.format(a='ref')} then upper(alt || ref) else upper(ref || alt) end"
_FR = "(alt_count / nullif(depth, 0))"
_SNP = f"case when depth = 0 or ref_count + alt_count = 0 then null when {_FR} >= 0.8 then alt || alt when {_FR} <= 0.2 then ref || ref else {_HET} end"
COUNTS = Cases("ref string, alt string, ref_count long, alt_count long, depth long", [("A", "G", 0, 0, 0), ("A", "G", 0, 0, 9), ("A", "G", 1, 4, 5), ("A", "G", 4, 1, 5), ("T", "C", 5, 5, 10), ("I", "D", 3, 3, 6), ("D", "I", 3, 3, 6), ("A", "G", 2, 8, 20), ("N", "G", 4, 4, 8)])
_CALLS_C = f"(select ref, alt, ref_count, alt_count, depth from {plain(CALLS)} union all select * from {COUNTS.sql()})"


def _calls(spark, sf):
    return view(spark, sf, CALLS).select("ref", "alt", "ref_count", "alt_count", "depth").unionByName(COUNTS.df(spark))


@query("call_01", f"select call, count(*) as n, cast(sum(depth) as bigint) as depth from (select *, {_SNP} as call from {_CALLS_C} where depth >= 0) group by all")
def call_01(spark, sf):
    x = _calls(spark, sf).where("depth >= 0")
    return x.withColumn("call", G.call_snp(*[C(c) for c in ("ref", "alt", "ref_count", "alt_count", "depth")])).groupBy("call").agg(F.count(F.lit(1)).alias("n"), F.sum("depth").alias("depth"))


@query("call_02", f"select call, count(*) as n from (select *, case when depth = 0 then null when {_FR} >= 0.8 then alt || alt when {_FR} <= 0.2 then ref || ref else {_HET} end as call from {_CALLS_C} where depth >= 0) group by all")
def call_02(spark, sf):
    return _calls(spark, sf).where("depth >= 0").withColumn("call", G.call_copies(C("ref"), C("alt"), C("alt_count"), C("depth"))).groupBy("call").agg(F.count(F.lit(1)).alias("n"))


PILES = Cases("i int, pref string, ref string, observed array<string>, a int, c int, g int, t int", [(1, "G", "A", ["C", "T"], 5, 3, 3, 3), (2, "g", "A", ["T"], 5, 0, 2, 9), (3, "G", "A", [], 0, 0, 0, 0), (4, "C", "A", ["a", " t"], 9, 1, 1, 1)])


@query("call_03", f"""with u as (select i, pref, upper(l) as l, case upper(l) when 'A' then a when 'C' then c when 'G' then g when 'T' then t else 0 end as n from (select *, unnest(list_distinct(list_append(list_filter(list_transform(observed, lambda x: upper(substr(trim(x), 1, 1))), lambda x: x <> upper(ref)), upper(pref)))) as l from {PILES.sql()}))
    select i, arg_max(l, row(n, n, case when l = upper(pref) then 1 else 0 end, l)) as alternate from u group by i""")
def call_03(spark, sf):
    m = F.create_map(*[x for b in "acgt" for x in (F.lit(b.upper()), C(b))])
    return PILES.df(spark).select("i", G.observed_alternate(C("pref"), C("ref"), C("observed"), m, m).alias("alternate"))


@query("call_04", f"""with u as (select i, unnest([row('A', a), row('C', c), row('G', g), row('T', t)]) as s from {PILES.sql()}), v as (select i, s[1] as b, s[2] as n from u where s[2] > 0), r as (select i, list(b order by n desc, b) as bs, list(n order by n desc, b) as ns, sum(n) as tot from v group by i)
    select p.i, case when r.i is null then null when len(bs) = 1 or ns[1] * 10 >= tot * 8 then bs[1] || bs[1] else bs[1] || bs[2] end as display from {PILES.sql()} p left join r using (i)""")
def call_04(spark, sf):
    m = F.create_map(*[x for b in "acgt" for x in (F.lit(b.upper()), C(b).cast("long"))])
    return PILES.df(spark).select("i", G.display_from_counts(m).alias("display"))


DISPLAYS = Cases("display string, ref string, alt string, kind string, chrom string, male boolean", [
    ("", "A", "G", "snp", "1", False), ("AG", "A", "G", "snp", "1", False), ("GG", "A", "G", "snp", "X", True), ("GG", "A", "G", "snp", "X", False), ("A", "A", "G", "snp", "chrY", True), ("G", "A", "G", "snp", "1", True), ("--", "A", "G", "snp", "1", False), ("AT", "A", "G", "snp", "1", False),
    ("ID", "TG", "T", "deletion", "1", False), ("DD", "TG", "T", "deletion", "1", False), ("II", "T", "TG", "insertion", "1", False), ("TG/T", "TG", "T", "deletion", "1", False), ("TGTG", "TG", "T", "indel", "1", False), ("TT", "TG", "T", "indel", "1", False), ("--", "TG", "T", "deletion", "1", False), ("AGT", "A", "G", "snp", "1", False), ("D", "TG", "T", "deletion", "X", True),
])
_GEN = f"(select display, ref, alt, kind, chrom, false as male from {plain(CALLS)} where ref is not null and alt is not null and chrom is not null and display is not null union all select * from {DISPLAYS.sql()})"
_TOK = "((kind = 'deletion' and length(ref) > 1 or kind = 'insertion' and length(alt) > length(ref)) and not regexp_matches(display, '[A-CE-HJ-Za-ce-hj-z]'))"
_APP = f"""select *, case when display = '' then './.|unknown' when lng and d = lr || lr then '0/0|hom_ref' when lng and d = la || la then '1/1|hom_alt' when lng and (d = lr || la or d = la || lr) then '0/1|het'
    when length(r) <> 1 or length(a) <> 1 then display || '|unknown' when length(l) = 1 and sx then case when l = r then '0|hem_ref' when l = a then '1|hem_alt' else display || '|unknown' end when length(l) <> 2 then display || '|unknown'
    when sx and male and l[1] = l[2] then case when l[1] = r then '0|hem_ref' when l[1] = a then '1|hem_alt' else display || '|unknown' end
    when l = r || r then '0/0|hom_ref' when l in (r || a, a || r) and r <> a then '0/1|het' when l = a || a then '1/1|hom_alt' else display || '|unknown' end as gz
    from (select *, r <> '' and a <> '' and not (length(r) = 1 and length(a) = 1) as lng, upper(regexp_replace(display, '[/| .-]', '', 'g')) as d, upper(r) as lr, upper(a) as la, regexp_replace(display, '[^A-Za-z]', '', 'g') as l, upper(regexp_replace(chrom, '^(chr|CHR)+', '')) in ('X', 'Y', '23', '24') as sx
    from (select *, case when {_TOK} then case when kind = 'deletion' then 'I' else 'D' end else ref end as r, case when {_TOK} then case when kind = 'deletion' then 'D' else 'I' end else alt end as a from {_GEN}))"""


def _displays(spark, sf):
    t = view(spark, sf, "select genotype_display as display, upper(reference) as ref, upper(alternate) as alt, kind, case when lower(chrom) like 'chr%' then substr(chrom, 4) else chrom end as chrom, false as male from {observations}").dropna(subset=["ref", "alt", "chrom", "display"])
    return t.unionByName(DISPLAYS.df(spark)).withColumn("z", G.app_genotype(*[C(c) for c in ("display", "ref", "alt", "kind", "chrom", "male")]))


@query("call_05", f"select display, ref, alt, kind, male, split_part(gz, '|', 1) as genotype, split_part(gz, '|', 2) as zygosity, count(*) as n from ({_APP}) group by all")
def call_05(spark, sf):
    return _displays(spark, sf).groupBy("display", "ref", "alt", "kind", "male", C("z.genotype").alias("genotype"), C("z.zygosity").alias("zygosity")).agg(F.count(F.lit(1)).alias("n"))


@query("call_06", f"select display, ref, alt, kind, coalesce({_TOK}, false) as token, count(*) as n from {_GEN} group by all")
def call_06(spark, sf):
    x = _displays(spark, sf)
    return x.withColumn("token", G.is_indel_display(C("display"), C("ref"), C("alt"), C("kind"))).groupBy("display", "ref", "alt", "kind", "token").agg(F.count(F.lit(1)).alias("n"))


@query("call_08", f"select kind, case when kind = 'deletion' and length(ref) > 1 and depth > 0 then case when coalesce(alt_count, 0) / depth >= 0.8 then 'DD' when coalesce(alt_count, 0) / depth <= 0.2 then 'II' else 'DI' end end as display, count(*) as n from {plain(CALLS)} group by all")
def call_08(spark, sf):
    x = view(spark, sf, CALLS)
    return x.withColumn("display", G.deletion_display(C("kind"), F.lit("bam"), C("ref"), C("alt_count"), C("depth"))).groupBy("kind", "display").agg(F.count(F.lit(1)).alias("n"))


@query("call_09", f"select display, case when regexp_extract(display, '[A-Za-z]') = '' then display else regexp_extract(display, '[A-Za-z]') end as shown, count(*) as n from {_GEN} group by all")
def call_09(spark, sf):
    return _displays(spark, sf).groupBy("display", G.hemizygous_display(C("display")).alias("shown")).agg(F.count(F.lit(1)).alias("n"))


_OUT = """case when depth = 0 then 'not_covered' when g = './.' then 'no_call' when z in ('hom_ref', 'hem_ref') then 'reference' when z in ('het', 'hom_alt', 'hem_alt') then 'variant' else 'unknown' end"""
OUT_CASES = Cases("depth long, g string, z string", [(0, "0/1", "het"), (None, "./.", "unknown"), (5, "0", "hem_ref"), (5, "1/1", "hom_alt"), (5, "AT", "unknown"), (0, "./.", "unknown")])
_OUT_IN = f"(select depth, case when genotype is null then './.' else genotype end as g, zygosity as z from observations union all select * from {OUT_CASES.sql()})"


@query("call_10", f"select {_OUT} as outcome, case when g = './.' then 'no_call' else 'called' end as call_status, count(*) as n from {_OUT_IN} group by all")
def call_10(spark, sf):
    x = view(spark, sf, "select depth, case when genotype is null then './.' else genotype end as g, zygosity as z from {observations}").unionByName(OUT_CASES.df(spark))
    x = x.withColumn("v", G.call_values(C("depth"), F.lit(None).cast("string"), C("g"), C("z"), F.lit("AG")))
    return x.groupBy(C("v.outcome").alias("outcome"), C("v.call_status").alias("call_status")).agg(F.count(F.lit(1)).alias("n"))


OBS = Cases("i int, display string, ref string, alt string, observed array<string>", [(1, "AT", "A", "G", ["T"]), (2, "AC", "A", "G", ["T"]), (3, "AG", "A", "G", ["T"]), (4, "", "A", "G", ["T"]), (5, "TT", "A", "G", ["C", "T"]), (6, "CT", "A", "G", ["C", "T"]), (7, "AA", "AT", "A", ["G"]), (8, "ct", "A", "G", ["c"]), (9, "--", "A", "G", ["T"]), (10, "CA", "A", "G", [])])
_L = "list_transform(string_split(regexp_replace(display, '[^A-Za-z]', '', 'g'), ''), lambda x: upper(x))"


@query("call_11", f"""select i, case when display = '' or length(ref) <> 1 or length(alt) <> 1 or regexp_replace(display, '[^A-Za-z]', '', 'g') = '' or list_contains({_L}, alt) then alt
    else coalesce(list_filter(observed, lambda o: length(o) = 1 and upper(o) <> ref and list_contains({_L}, upper(o)))[1], alt) end as alternate from {OBS.sql()}""")
def call_11(spark, sf):
    return OBS.df(spark).select("i", G.reportable_alt(C("display"), C("ref"), C("alt"), C("observed")).alias("alternate"))


@query("call_12", f"select i, case ref when 'A' then a when 'C' then c when 'G' then g when 'T' then t end as ref_count, coalesce(case upper(pref) when 'A' then a when 'C' then c when 'G' then g when 'T' then t end, 0) as alt_count from {PILES.sql()}")
def call_12(spark, sf):
    m = F.create_map(*[x for b in "acgt" for x in (F.lit(b.upper()), C(b))])
    count = lambda a: F.coalesce(F.try_element_at(m, F.upper(a)), F.lit(0))
    return PILES.df(spark).select("i", count(C("ref")).alias("ref_count"), count(C("pref")).alias("alt_count"))


_NR = f"list_filter({_L}, lambda x: x <> '' and x <> ref and x <> alt)"
_STATUS = f"case when display = '' or length(ref) <> 1 or length(alt) <> 1 or len({_NR}) = 0 then null when len(list_filter({_NR}, lambda x: not list_contains(list_transform(observed, lambda o: upper(o)), x))) = 0 then 'observed_alt' else 'unknown_alt' end"


@query("call_13", f"select i, {_STATUS} as status from {OBS.sql()}")
def call_13(spark, sf):
    return OBS.df(spark).select("i", G.non_reportable(C("display"), C("ref"), C("alt"), C("observed")).alias("status"))


@query("call_15", f"select i, case when {_STATUS} = 'observed_alt' and len(observed) > 0 then 'observed_alt;known_observed_alts=' || array_to_string(observed, ',') else {_STATUS} end as facets from {OBS.sql()}")
def call_15(spark, sf):
    status = G.non_reportable(C("display"), C("ref"), C("alt"), C("observed"))
    return OBS.df(spark).select("i", G.facets(status, C("observed")).alias("facets"))


@query("call_14", f"select kind, ref, display, coalesce(kind = 'deletion' and length(ref) > 1 and not regexp_matches(display, '[A-CE-HJ-Za-ce-hj-z]'), false) as weak, count(*) as n from {_GEN} group by all")
def call_14(spark, sf):
    x = _displays(spark, sf)
    return x.groupBy("kind", "ref", "display", G.weak_indel(C("kind"), F.lit("text"), C("ref"), C("display")).alias("weak")).agg(F.count(F.lit(1)).alias("n"))


@query("call_16", f"select record_id, case when depth > 0 then alt_count / depth end as balance from {plain(CALLS)} where depth is not null")
def call_16(spark, sf):
    return view(spark, sf, CALLS).where("depth is not null").select("record_id", G.allele_balance(C("alt_count"), C("depth")).alias("balance"))


IMP = Cases("i int, kind string, ref string, alt string, chrom string, male boolean", [(1, "snp", "a", "G", "1", False), (2, None, "A", "G", "X", True), (3, "snp", "AT", "G", "1", False), (4, "deletion", "TG", "T", "X", True), (5, "insertion", "T", "TG", "1", False), (6, "indel", "TG", "T", "1", False), (7, "other", "A", "G", "1", False), (8, "snp", None, "G", "1", False), (9, "snp", "A", "G", "chrY", False), (10, "indel", "TG", "CA", "1", False)])


@query("call_17", f"""select i, case when coalesce(kind, 'snp') = 'snp' then case when length(ref) = 1 and length(alt) = 1 then case when male and upper(regexp_replace(chrom, '^chr', '')) in ('X', 'Y') then upper(ref) else upper(ref) || upper(ref) end end when kind = 'deletion' then 'II'
    when kind in ('insertion', 'indel') then case when length(alt) < length(ref) then 'II' when length(alt) > length(ref) then 'DD' else upper(ref) || upper(ref) end end as genotype from {IMP.sql()}""")
def call_17(spark, sf):
    return IMP.df(spark).select("i", G.imputed_reference(*[C(c) for c in ("kind", "ref", "alt", "chrom", "male")]).alias("genotype"))


IND = Cases("i int, genotype string, kind string, ref string, alts array<string>", [(1, "TG/T", "deletion", "TG", ["T"]), (2, "T/TG", "insertion", "T", ["TG"]), (3, "TG/T", "snp", "TG", ["T"]), (4, "DD", "deletion", "TG", ["T"]), (5, "TG/X", "deletion", "TG", ["T"]), (6, "TG/T", "indel", "TG", ["T", "TGG"]), (7, "t/tg", "insertion", "T", ["TG"])])


@query("call_18", f"""with u as (select i, ref, alts, kind, genotype, unnest(string_split(genotype, '/')) as p, len(string_split(genotype, '/')) as k from {IND.sql()}),
    t as (select *, len(list_filter(alts, lambda a: length(a) < length(ref))) as s, len(list_filter(alts, lambda a: length(a) > length(ref))) as l, list_filter(alts, lambda a: upper(a) = upper(p))[1] as a from u),
    v as (select i, genotype, kind, k, case when upper(p) = upper(ref) then case when s > 0 and l = 0 then 'I' when l > 0 and s = 0 then 'D' else upper(ref) end when a is not null then case when length(a) < length(ref) then 'D' when length(a) > length(ref) then 'I' else upper(a) end end as tok from t)
    select i, case when any_value(kind) in ('deletion', 'insertion', 'indel') and any_value(k) > 1 and bool_and(coalesce(length(tok) = 1, false)) then string_agg(tok, '' order by tok) else any_value(genotype) end as genotype from v group by i""")
def call_18(spark, sf):
    return IND.df(spark).select("i", G.indel_genotype(C("genotype"), C("kind"), C("ref"), C("alts")).alias("genotype"))


@query("call_19", f"""select ref, alt, ref_count, alt_count, depth, case when depth = 0 then 'no covering reads for SNP; genotype unresolved (ref=' || ref || ', alt=' || alt || ')' when ref_count + alt_count = 0 then
    'no reads matched the declared SNP alleles; genotype unresolved; counts ref=' || ref_count || ' alt=' || alt_count || ' depth=' || depth || ' for ' || ref || '>' || alt
    else 'SNP genotype rule: alt_fraction=' || printf('%.3f', alt_count / depth) || ' with thresholds ref<=0.200, het=(0.200,0.800), alt>=0.800; counts ref=' || ref_count || ' alt=' || alt_count || ' depth=' || depth || ' for ' || ref || '>' || alt end as decision from {COUNTS.sql()}""")
def call_19(spark, sf):
    cols = [C(c) for c in ("ref", "alt", "ref_count", "alt_count", "depth")]
    return COUNTS.df(spark).select("*", G.decision_snp(*cols).alias("decision"))


@query("call_21", "select rsid, 'https://www.ncbi.nlm.nih.gov/snp/' || rsid as link, count(*) as n from (select lower(rsid) as rsid from observations) where starts_with(rsid, 'rs') group by all")
def call_21(spark, sf):
    x = view(spark, sf, CALLS).where(C("rsid").startswith("rs"))
    return x.groupBy("rsid").agg(F.count(F.lit(1)).alias("n")).select("rsid", F.concat(F.lit("https://www.ncbi.nlm.nih.gov/snp/"), "rsid").alias("link"), "n")


TAGS = Cases("i int, tags array<string>", [(1, ["a", "gene:HBB", "gene:HBD"]), (2, ["x"]), (3, []), (4, ["gene:"])])


@query("call_22", f"select i, coalesce(substr(list_filter(tags, lambda t: starts_with(t, 'gene:'))[1], 6), '') as gene from {TAGS.sql()}")
def call_22(spark, sf):
    return TAGS.df(spark).select("i", F.coalesce(F.substring(F.try_element_at(F.filter("tags", lambda t: t.startswith("gene:")), F.lit(1)), 6, 1 << 20), F.lit("")).alias("gene"))


# --- dosage and chromosome count

_DOS = """case when allele = '' then null when allele = ref then case when zygosity = 'hom_ref' then 2 when zygosity in ('hem_ref', 'het') then 1 when zygosity in ('hom_alt', 'hem_alt') then 0 end
    when allele = alt then case when zygosity in ('hom_ref', 'hem_ref') then 0 when zygosity in ('het', 'hem_alt') then 1 when zygosity = 'hom_alt' then 2 end
    when length(allele) = 1 then length(display) - length(replace(upper(display), allele, '')) end"""


@query("flt_04", f"select allele, ref, alt, zygosity, {_DOS} as dosage, count(*) as n from {plain(CALLS)}, (values ('A'), ('G'), (''), ('T')) t(allele) where ref is not null and alt is not null group by all")
def flt_04(spark, sf):
    x = view(spark, sf, CALLS).dropna(subset=["ref", "alt"]).withColumn("allele", F.explode(F.array(*map(F.lit, ["A", "G", "", "T"]))))
    d = G.dosage(*[C(c) for c in ("allele", "ref", "alt", "zygosity", "display")])
    return x.groupBy("allele", "ref", "alt", "zygosity", d.alias("dosage")).agg(F.count(F.lit(1)).alias("n"))


@query("flt_05", "select zygosity, case when zygosity in ('hem_ref', 'hem_alt') then 1 when zygosity in ('hom_ref', 'het', 'hom_alt') then 2 end as copies, count(*) as n from observations group by all")
def flt_05(spark, sf):
    return view(spark, sf, CALLS).groupBy("zygosity", G.chromosome_count(C("zygosity")).alias("copies")).agg(F.count(F.lit(1)).alias("n"))


# --- allele sets of the older matcher

SETS = Cases("i int, a array<string>, b array<string>", [(1, ["A", "C"], ["C", "G"]), (2, ["A"], ["A"]), (3, [], ["T"]), (4, ["A", "C", "G", "T"], ["A"])])


@query("leg_01", f"select i, list_sort(list_filter(['A', 'C', 'G', 'T'], lambda x: not list_contains(a, x))) as not_a, list_sort(list_distinct(list_concat(a, b))) as joined, list_sort(list_filter(list_distinct(a), lambda x: not list_contains(b, x))) as less, list_has_any(a, b) as shared from {SETS.sql()}")
def leg_01(spark, sf):
    every = F.array(*map(F.lit, "ACGT"))
    return SETS.df(spark).select("i", F.array_sort(F.array_except(every, "a")).alias("not_a"), F.array_sort(F.array_union("a", "b")).alias("joined"), F.array_sort(F.array_except("a", "b")).alias("less"), F.arrays_overlap("a", "b").alias("shared"))


_TWO = "(select ref, alt, substr(genotype, 1, 1) as a1, substr(genotype, 2, 1) as a2 from " + plain(CALLS) + " where length(genotype) = 2 and ref is not null and alt is not null)"


def _two(spark, sf):
    return view(spark, sf, CALLS).where("length(genotype) = 2 and ref is not null and alt is not null").select("ref", "alt", F.substring("genotype", 1, 1).alias("a1"), F.substring("genotype", 2, 1).alias("a2"))


def _counted(df, name, expr):
    return df.groupBy("ref", "alt", "a1", "a2", expr.alias(name)).agg(F.count(F.lit(1)).alias("n"))


@query("leg_02", f"select ref, alt, a1, a2, case when a1 = a2 and a1 = ref then 'REFERENCE_CALL' when a1 = alt or a2 = alt then 'VARIANT_CALL' else 'NO_CALL' end as call, count(*) as n from {_TWO} group by all")
def leg_02(spark, sf):
    return _counted(_two(spark, sf), "call", G.match_snv(C("a1"), C("a2"), F.array("ref"), F.array("alt")))


@query("leg_03", f"select ref, alt, a1, a2, case when length(alt) > 1 then case when 'I' in (a1, a2) then 'VARIANT_CALL' when 'D' in (a1, a2) then 'REFERENCE_CALL' else 'NO_CALL' end else case when 'D' in (a1, a2) then 'VARIANT_CALL' when 'I' in (a1, a2) then 'REFERENCE_CALL' else 'NO_CALL' end end as call, count(*) as n from {_TWO} group by all")
def leg_03(spark, sf):
    return _counted(_two(spark, sf), "call", G.match_indel(C("a1"), C("a2"), F.when(F.length("alt") > 1, "INSERTION").otherwise("DELETION")))


_BASES = "list_filter([a1, a2], lambda x: x in ('A', 'C', 'G', 'T'))"


@query("leg_04", f"""select ref, alt, a1, a2, case when len(b) > 0 and len(list_filter(b, lambda x: contains(alt, x))) = len(b) and len(list_filter(b, lambda x: contains(ref, x))) = 0 then 'VARIANT_CALL'
    when len(b) > 0 and len(list_filter(b, lambda x: contains(ref, x))) = len(b) and len(list_filter(b, lambda x: contains(alt, x))) = 0 then 'REFERENCE_CALL' else 'NO_CALL' end as call, count(*) as n from (select *, {_BASES} as b from {_TWO}) group by ref, alt, a1, a2, call""")
def leg_04(spark, sf):
    return _counted(_two(spark, sf), "call", G.match_complex(C("a1"), C("a2"), C("ref"), C("alt")))


@query("leg_05", f"select ref, alt, case when length(ref) = 1 and length(alt) = 1 then 'SNV' when length(ref) = 1 and length(alt) > 1 then 'INSERTION' when length(ref) > 1 and length(alt) = 1 then 'DELETION' when length(ref) = length(alt) then 'INDEL' else 'MNV' end as type, count(*) as n from {plain(CALLS)} where ref is not null and alt is not null group by all")
def leg_05(spark, sf):
    x = view(spark, sf, CALLS).dropna(subset=["ref", "alt"])
    return x.groupBy("ref", "alt", G.variant_type(C("ref"), C("alt")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query("leg_06", f"select ref, alt, a1, a2, (a1 = ref)::int + (a2 = ref)::int as ref_dosage, (a1 = alt)::int + (a2 = alt)::int as alt_dosage, count(*) as n from {_TWO} group by all")
def leg_06(spark, sf):
    both = F.array("a1", "a2")
    return _two(spark, sf).groupBy("ref", "alt", "a1", "a2", F.size(F.filter(both, lambda x: x == C("ref"))).alias("ref_dosage"), F.size(F.filter(both, lambda x: x == C("alt"))).alias("alt_dosage")).agg(F.count(F.lit(1)).alias("n"))


@query("leg_07", f"select least(a1, a2) || greatest(a1, a2) as sorted, a1 = a2 and a1 <> '-' as hom, a1 <> a2 and a1 <> '-' and a2 <> '-' as het, '-' in (a1, a2) as missing, count(*) as n from {_TWO} group by all")
def leg_07(spark, sf):
    gone = (C("a1") == "-") | (C("a2") == "-")
    return _two(spark, sf).groupBy(F.array_join(F.array_sort(F.array("a1", "a2")), "").alias("sorted"), ((C("a1") == C("a2")) & (C("a1") != "-")).alias("hom"), ((C("a1") != C("a2")) & ~gone).alias("het"), gone.alias("missing")).agg(F.count(F.lit(1)).alias("n"))


STATES = Cases("x string, y string", [("G1", "G0"), ("G0", "G0"), ("G2", "G1"), ("G1", "G2"), ("G2", "G2"), ("G0", "G2")])


@query("leg_09", f"with r as (select *, strpos('G2G1G0', x) as i, strpos('G2G1G0', y) as j from {STATES.sql()}) select x, y, case when i <= j then x || '/' || y else y || '/' || x end as status from r")
def leg_09(spark, sf):
    order = F.array(*map(F.lit, ["G2", "G1", "G0"]))
    ranked = F.sort_array(F.transform(F.array("x", "y"), lambda v: F.struct(F.array_position(order, v).alias("r"), v.alias("v"))))
    return STATES.df(spark).select("x", "y", F.array_join(F.transform(ranked, lambda s: s["v"]), "/").alias("status"))


EYES = Cases("g string", [("AA",), ("AG",), ("GA",), ("GG",), ("--",), (None,)])


@query("cls_03", f"select g, case array_to_string(list_sort(string_split(g, '')), '') when 'AA' then 'Brown' when 'AG' then 'Brown' when 'GG' then 'Blue' else 'Unknown' end as colour from {EYES.sql()}")
def cls_03(spark, sf):
    # Eye colour by the sorted genotype.
    colours = F.create_map(*[F.lit(x) for x in ("AA", "Brown", "AG", "Brown", "GG", "Blue")])
    return EYES.df(spark).select("g", F.coalesce(F.try_element_at(colours, F.array_join(F.array_sort(F.split("g", "")), "")), F.lit("Unknown")).alias("colour"))


@query("cls_05", "select genotype, length(genotype) - length(replace(genotype, 'D', '')) as ds, count(*) as n from observations where genotype is not null group by all")
def cls_05(spark, sf):
    return view(spark, sf, CALLS).where("genotype is not null").groupBy("genotype", (F.length("genotype") - F.length(F.replace("genotype", F.lit("D"), F.lit("")))).alias("ds")).agg(F.count(F.lit(1)).alias("n"))


REPEATS = Cases("s string", [("AAAA",), ("ATATAT",), ("ATAT",), ("ACG",), ("CAGCAGCAGCAG",), ("aaaaa",), ("A",), ("",)])


@query("fn_repeat", rf"""with u as (select s, upper(s) as t, k from {REPEATS.sql()}, range(1, 33) r(k)), f as (select s, t, k, substr(t, 1, k) as unit from u where k <= length(t) and length(t) % k = 0 and length(t) // k >= 3 and repeat(substr(t, 1, k), length(t) // k) = t)
    select r.s, f.unit || '[' || (length(f.t) // length(f.unit)) || ']' as notation from {REPEATS.sql()} r left join (select s, arg_min(unit, k) as unit, any_value(t) as t from f group by s) f using (s)""")
def fn_repeat(spark, sf):
    s = F.upper("s")
    unit = F.regexp_extract(s, r"^(.{1,32}?)\1{2,}$", 1)
    return REPEATS.df(spark).select("s", F.when(unit != "", F.concat(unit, F.lit("["), (F.length(s) / F.length(unit)).cast("int").cast("string"), F.lit("]"))).alias("notation"))


@query("fn_json", "select event_type, json_extract_string(props, '$.k') as k, count(*) as n from events group by all")
def fn_json(spark, sf):
    return view(spark, sf, "select event_type, props from {events}").groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("fn_hash", "select variant_id, sha256(variant_id) as sha, md5(variant_id) as md from variant_catalogue")
def fn_hash(spark, sf):
    return view(spark, sf, "select variant_id from {variant_catalogue}").select("variant_id", F.sha2("variant_id", 256).alias("sha"), F.md5("variant_id").alias("md"))


URLS = Cases("u string", [("https://www.a.org/x?y=1",), ("http://b.com",), ("nothing",)])


@query("fn_url", f"select u, case when regexp_matches(u, '^[a-z]+://') then regexp_extract(u, '://([^/?#]+)', 1) end as host from {URLS.sql()}")
def fn_url(spark, sf):
    return URLS.df(spark).select("u", F.try_parse_url("u", F.lit("HOST")).alias("host"))


LEVELS = Cases("v string", [("1A",), ("1B",), ("2A",), ("3",), ("4",), ("Strong",), ("moderate evidence",), ("",)])


@query("srt_03", f"select v, case when starts_with(v, '1A') then 0 when starts_with(v, '1B') then 1 when starts_with(v, '2A') then 2 when starts_with(v, '2B') then 3 when starts_with(v, '3') then 4 when starts_with(v, '4') then 5 else 9 end as rank from {LEVELS.sql()}")
def srt_03(spark, sf):
    rank = F.lit(9)
    # Evidence levels from strongest to weakest.
    for i, level in reversed(list(enumerate(["1A", "1B", "2A", "2B", "3", "4"]))):
        rank = F.when(C("v").startswith(level), i).otherwise(rank)
    return LEVELS.df(spark).select("v", rank.alias("rank"))


flatten(QUERIES, SQL, {"leg_01": ["not_a", "joined", "less"]})


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
