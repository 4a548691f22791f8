"""Queries of the joins, aggregations, windows and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from genoquery.functions import genotype as G
from genoquery.operators import cohort, inspect, lookup, reads, vntr
from genoquery.plans.cases import CALLS, READS, ROWS, SPECS, Cases, flatten, plain, view
from genoquery.operators.skew import bounded
from genoquery.session import new_folder, table
from genoquery.sources import text

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




def _n():
    return F.count(F.lit(1)).alias("n")


_W = "select pid, vid, row_idx, prio, genotype, rsid from ({hits}) where genotype is not null qualify row_number() over (partition by pid, vid order by row_idx, prio) = 1"
_BYN = "select pid, vid, row_idx, 0 as prio, genotype, r.rsid from {rows} r join {specs} s on r.rsid = s.rsid"
_BYP = "select pid, vid, row_idx, 1 as prio, genotype, r.rsid from {rows} r join {specs} s on r.chrom = s.chrom and r.pos = s.pos"
_R, _S = plain(ROWS), plain(SPECS)


@query("join_01", _W.format(hits=_BYN.format(rows=_R, specs=_S)))
def join_01(spark, sf):
    return lookup.winners(lookup.by_name(view(spark, sf, ROWS), view(spark, sf, SPECS)))


@query("join_02", _W.format(hits=_BYP.format(rows=_R, specs=_S)))
def join_02(spark, sf):
    return lookup.winners(lookup.by_place(view(spark, sf, ROWS), view(spark, sf, SPECS)))


@query("join_03", _W.format(hits=_BYN.format(rows=_R, specs=_S) + " union all " + _BYP.format(rows=_R, specs=_S)))
def join_03(spark, sf):
    rows, specs = view(spark, sf, ROWS), view(spark, sf, SPECS)
    return lookup.winners(lookup.by_name(rows, specs), lookup.by_place(rows, specs))


SQL["join_08"] = SQL["join_03"]
QUERIES["join_08"] = join_03


VCF = Cases("i int, pos long, ref string, alts array<string>, spec_start long, spec_ref string, spec_alt string, spec_kind string, spec_len int", [
    (1, 10, "A", ["G"], 10, "A", "G", "snp", None), (2, 10, "A", ["T"], 10, "A", "G", "snp", None), (3, 10, "G", ["A"], 10, "A", "G", "snp", None), (4, 10, "C", ["A"], 10, None, "G", "snp", None), (5, 9, "TG", ["T"], 10, "TG", "T", "deletion", 1), (6, 9, "TGG", ["T"], 10, "TG", "T", "deletion", 1),
    (7, 9, "TGG", ["T"], 10, None, None, "deletion", None), (8, 10, "T", ["TG"], 10, "T", "TG", "insertion", None), (9, 9, "C", ["CA"], 10, "T", "TG", "insertion", None), (10, 8, "C", ["CA"], 10, "T", "TG", "insertion", None), (11, 10, "TG", ["T"], 10, "CA", "C", "indel", None), (12, 10, "TG", ["CA"], 10, "TG", "CA", "indel", None),
    (13, 10, "A", ["G"], 10, "A", "G", None, None), (14, 11, "A", ["G"], 10, "A", "G", None, None), (15, 10, "a", ["g", "c"], 10, "A", "C", "snp", None),
])


@query("join_04", f"""select i, coalesce(case spec_kind when 'snp' then pos = spec_start and (spec_ref is null or upper(spec_ref) = upper(ref)) and (spec_alt is null or len(list_filter(alts, lambda a: upper(a) = upper(spec_alt) or coalesce(upper(a) = upper(spec_ref), false))) > 0)
    when 'deletion' then pos = spec_start - 1 and len(list_filter(alts, lambda a: length(a) < length(ref) and (coalesce(spec_len, 0) = 0 or length(ref) - length(a) = spec_len))) > 0
    when 'insertion' then pos in (spec_start, spec_start - 1) and len(list_filter(alts, lambda a: length(a) > length(ref) and (((spec_ref is null or spec_ref = ref) and (spec_alt is null or spec_alt = a)) or coalesce(length(spec_alt) <> length(spec_ref) and length(a) - length(ref) = length(spec_alt) - length(spec_ref), false)))) > 0
    when 'indel' then pos in (spec_start, spec_start - 1) and len(list_filter(alts, lambda a: length(a) <> length(ref) and (((spec_ref is null or spec_ref = ref) and (spec_alt is null or spec_alt = a)) or coalesce(length(spec_alt) <> length(spec_ref) and length(a) - length(ref) = length(spec_alt) - length(spec_ref), false)))) > 0
    else pos = spec_start end, false) as hit from {VCF.sql()}""")
def join_04(spark, sf):
    return VCF.df(spark).select("i", F.coalesce(lookup.vcf_matches(), F.lit(False)).alias("hit"))


@query("join_05", "select variant_id, coalesce(grch37_pos, grch38_pos) as pos_37, coalesce(grch38_pos, grch37_pos) as pos_38 from variant_catalogue")
def join_05(spark, sf):
    return table(spark, sf, "variant_catalogue").select("variant_id", F.coalesce("grch37_pos", "grch38_pos").alias("pos_37"), F.coalesce("grch38_pos", "grch37_pos").alias("pos_38"))


@query("join_06", "select variant_id, case when grch38_pos is not null then 'grch38' when grch37_pos is not null then 'grch37' end as build, coalesce(grch38_pos, grch37_pos) as pos from variant_catalogue")
def join_06(spark, sf):
    c = table(spark, sf, "variant_catalogue")
    return c.select("variant_id", F.when(C("grch38_pos").isNotNull(), "grch38").when(C("grch37_pos").isNotNull(), "grch37").alias("build"), F.coalesce("grch38_pos", "grch37_pos").alias("pos"))


FEW = "select n_nationkey as vid, concat('rs', cast(n_nationkey as string)) as rsid from {nation}"
PIDS = "select c_custkey as pid from {customer}"


@query("join_07", f"with w as ({_W.format(hits=_BYN.format(rows=_R, specs=plain(FEW)))}) select c.pid, s.vid, w.genotype, case when w.vid is null then 'no matching row' else 'resolved by rsid ' || s.rsid end as evidence from {plain(PIDS)} c cross join {plain(FEW)} s left join w on w.pid = c.pid and w.vid = s.vid")
def join_07(spark, sf):
    specs = view(spark, sf, FEW)
    found = lookup.winners(lookup.by_name(view(spark, sf, ROWS), specs))
    out = lookup.every_spec(view(spark, sf, PIDS), specs, found).join(specs.select("vid", C("rsid").alias("name")), "vid")
    return out.select("pid", "vid", "genotype", F.when(C("genotype").isNull(), "no matching row").otherwise(F.concat(F.lit("resolved by rsid "), "name")).alias("evidence"))


LOCI = "select vid, chrom, pos as lo, pos + 20 as hi from (select p_partkey as vid, cast(1 + p_partkey % 3 as string) as chrom, 100 + (p_partkey * 53) % 4000 as pos from {part})"


@query("join_09", f"select event_id, vid from {plain(READS)} r join {plain(LOCI)} l on r.chrom = l.chrom and r.stop >= l.lo and r.start <= l.hi")
def join_09(spark, sf):
    return lookup.overlaps(view(spark, sf, READS).select("event_id", "chrom", "start", "stop"), view(spark, sf, LOCI)).select("event_id", "vid")


@query("join_10", f"select vid, count(*) as n from {plain(READS)} r join {plain(LOCI)} l on r.chrom = l.chrom and l.lo >= r.start - 1 and l.lo <= r.stop group by vid")
def join_10(spark, sf):
    points = view(spark, sf, LOCI).withColumn("hi", C("lo"))
    return lookup.overlaps(view(spark, sf, READS).select("chrom", "start", "stop"), points, loose=1).groupBy("vid").agg(_n())


BLOCKS = Cases("idx int, chrom string, start long, stop long, to_chrom string, to_start long, to_size long, strand string, score long", [
    (0, "1", 0, 200000, "1", 1000, 900000, "+", 50), (1, "1", 100000, 400000, "1", 150000, 900000, "+", 90), (2, "2", 0, 300000, "2", 500, 900000, "-", 70), (3, "1", 100000, 300000, "7", 5, 900000, "+", 90), (4, "3", 50000, 60000, "3", 51000, 100000, "+", 10),
])
_LIFT = f"""select vid, chrom, pos, to_chrom, to_pos, strand from (select s.vid, s.chrom, s.pos, b.to_chrom, case when b.strand = '+' then b.to_start + s.pos - 1 - b.start else b.to_size - (b.to_start + s.pos - 1 - b.start) - 1 end + 1 as to_pos, b.strand,
    row_number() over (partition by s.vid order by b.score desc nulls last, b.idx) as k from {_S} s left join {BLOCKS.sql()} b on s.chrom = b.chrom and b.start <= s.pos - 1 and s.pos - 1 < b.stop) where k = 1"""


@query("join_11", _LIFT)
def join_11(spark, sf):
    return lookup.lift_blocks(view(spark, sf, SPECS).select("vid", "chrom", "pos"), BLOCKS.df(spark), ["vid"])


@query("lift_01", f"select pid, vid, genotype as old, case when strand = '-' then translate(genotype, 'ACGT', 'TGCA') else genotype end as genotype, to_chrom, to_pos, case when to_pos is null then 'no_primary_mapping' end as reason from (select r.pid, r.row_idx as vid, r.genotype, l.to_chrom, l.to_pos, l.strand from {_R} r join {_S} s on r.rsid = s.rsid join ({_LIFT}) l on l.vid = s.vid)")
def lift_01(spark, sf):
    rows = view(spark, sf, ROWS).join(view(spark, sf, SPECS).select("rsid", C("vid").alias("spec")), "rsid")
    lifted = lookup.lift_blocks(view(spark, sf, SPECS).select("vid", "chrom", "pos"), BLOCKS.df(spark), ["vid"]).select(C("vid").alias("spec"), "to_chrom", "to_pos", "strand")
    out = rows.join(lifted, "spec")
    return out.select("pid", C("row_idx").alias("vid"), C("genotype").alias("old"), F.when(C("strand") == "-", G.complement_genotype(C("genotype"))).otherwise(C("genotype")).alias("genotype"), "to_chrom", "to_pos", F.when(C("to_pos").isNull(), "no_primary_mapping").alias("reason"))


@query("join_12", f"select r.pid, r.row_idx, coalesce(c.genotype, r.genotype) as genotype, c.genotype is not null as cached from {_R} r left join (select pid, row_idx, genotype from {_R} where row_idx % 3 = 0) c on c.pid = r.pid and c.row_idx = r.row_idx")
def join_12(spark, sf):
    rows = view(spark, sf, ROWS)
    cache = rows.where("row_idx % 3 = 0").select("pid", "row_idx", C("genotype").alias("kept"))
    return rows.join(cache, ["pid", "row_idx"], "left").select("pid", "row_idx", F.coalesce("kept", "genotype").alias("genotype"), C("kept").isNotNull().alias("cached"))


_WANTED = "select vid, rsid from (" + SPECS + ") union all select cast(-1 - n_nationkey as bigint) as vid, concat('rs-', n_name) as rsid from {nation}"


@query("join_13", f"select vid from {plain(_WANTED)} s where not exists (select 1 from {_R} r where r.rsid = s.rsid)")
def join_13(spark, sf):
    """The required entries that the rows lack, for which ``lookup.require`` stops."""
    return lookup.misses(view(spark, sf, _WANTED), view(spark, sf, ROWS), "rsid").select("vid")


FINDINGS = Cases("fid string, ord int, effect string, op string, allele string, k string, vals array<string>, copies int", [
    ("f1", 1, "carrier", "dosage_in", "T", None, ["1", "2"], None), ("f1", 2, "two copies", "dosage_equals", "T", None, ["2"], 2), ("f2", 1, "outcome", "equals", None, "outcome", ["variant"], None), ("f3", 1, "zyg", "in", None, "zygosity", ["het", "hom_alt"], None),
    ("f4", 1, "alt", "equals", None, "alt", ["G"], None), ("f5", 1, "bad", "unknown", None, "outcome", ["variant"], None), ("f6", 1, "single", "equals", None, "zygosity", ["hem_alt"], 1),
])
# every finding without a variant, and bound to one name of every gene, written as a path
_KEYED = CALLS.replace(" from {observations}", ", variant_key as vkey from {observations}")
_NAMES = "select min(lower(trim(rsid))) as rsid from {variant_catalogue} where gene is not null and rsid is not null group by gene"
_BOUND = f"(select *, '' as ref_ from {FINDINGS.sql()} union all select f.* replace (f.fid || '@' || n.rsid as fid), 'panel/' || n.rsid from {FINDINGS.sql()} f, {plain(_NAMES)} n)"
_FJ = f"""select fid, ord, pid, rid from (select f.fid, f.ord, o.pid, min(o.record_id) as rid from (select * from {plain(_KEYED)} where ref is not null and alt is not null and genotype is not null) o join {_BOUND} f on
    (f.ref_ = '' or o.rsid = split_part(f.ref_, '/', 2) or o.vkey = split_part(f.ref_, '/', 2))
    and (f.copies is null or f.copies = case when o.zygosity in ('hem_ref', 'hem_alt') then 1 when o.zygosity in ('hom_ref', 'het', 'hom_alt') then 2 end) and case
    when op in ('dosage_equals', 'dosage_in') then list_contains(vals, cast(case when allele = ref then case when zygosity = 'hom_ref' then 2 when zygosity in ('hem_ref', 'het') then 1 when zygosity in ('hom_alt', 'hem_alt') then 0 end
      when allele = alt then case when zygosity in ('hom_ref', 'hem_ref') then 0 when zygosity in ('het', 'hem_alt') then 1 when zygosity = 'hom_alt' then 2 end else length(display) - length(replace(upper(display), allele, '')) end as varchar))
    when k = 'alt' then list_contains(vals, alt) and case when zygosity in ('het', 'hem_alt', 'hom_alt') then true else false end
    when op in ('equals', 'in') and k = 'outcome' then list_contains(vals, outcome) when op in ('equals', 'in') and k = 'zygosity' then list_contains(vals, zygosity) else false end group by all)"""


def bound_findings(obs, findings, obs_keys, ref):
    """The first observation (by record_id) per finding, effect and participant whose variant and values the finding is bound to.

    A finding's variant reference names an observation by one of ``obs_keys`` or by the last part of its path, which is an equi-join
    on that part; only findings without a reference meet every observation, and these come with a manifest: their size is checked.
    """
    base = lambda c: F.substring_index(c, "/", -1)
    keys = F.array_distinct(F.filter(F.array(*[base(C(k)) for k in obs_keys]), lambda x: x.isNotNull()))
    named = findings.where(C(ref) != "").withColumn("key_", base(C(ref)))
    by_name = obs.withColumn("key_", F.explode(keys)).join(named, "key_").drop("key_")
    loose = findings.where(C(ref) == "")
    if not bounded(loose):
        raise ValueError("too many findings without a variant")
    d = G.dosage(C("allele"), C("ref"), C("alt"), C("zygosity"), C("display")).cast("string")
    value = F.when(C("k") == "outcome", C("outcome")).when(C("k") == "zygosity", C("zygosity")).when(C("k") == "alt", C("alt"))
    shown = F.coalesce(F.exists("vals", lambda v: G.dosage(v, C("ref"), C("alt"), C("zygosity"), C("display")) > 0), F.lit(False))
    ok = F.when(C("op").isin("dosage_equals", "dosage_in"), F.array_contains("vals", d)).when(~C("op").isin("equals", "in"), False).when(C("k") == "alt", F.array_contains("vals", value) & shown).otherwise(F.array_contains("vals", value))
    copies = C("copies").isNull() | (C("copies") == G.chromosome_count(C("zygosity")))
    hit = F.coalesce(ok, F.lit(False)) & copies
    # the first observation wins, as an aggregate that combines before the shuffle
    both = by_name.where(hit).select("fid", "ord", "pid", "record_id").unionByName(obs.join(F.broadcast(loose), hit).select("fid", "ord", "pid", "record_id"))
    return both.groupBy("fid", "ord", "pid").agg(F.min("record_id").alias("rid"))


@query("join_14", _FJ)
def join_14(spark, sf):
    obs = view(spark, sf, _KEYED).dropna(subset=["ref", "alt", "genotype"])
    f = FINDINGS.df(spark)
    each = F.array(*[F.struct(*[F.lit(v).cast(t).alias(n) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(n) for n, t, v in zip(FINDINGS.names, FINDINGS.types, r)]) for r in FINDINGS.rows])
    per_gene = view(spark, sf, _NAMES).select("rsid", F.explode(each).alias("f")).select("f.*", F.concat(F.lit("panel/"), "rsid").alias("ref_")).withColumn("fid", F.concat("fid", F.lit("@"), F.substring_index("ref_", "/", -1)))
    return bound_findings(obs, f.withColumn("ref_", F.lit("")).unionByName(per_gene), ["vkey", "rsid"], "ref_")


ANALYSIS = Cases("aid string, pid int, r int, k string, v string", [("apol1", 1, 1, "status", "G1/G0"), ("apol1", 2, 1, "status", "G2/G2"), ("apol1", 2, 2, "status", "G1/G0"), ("eye", 1, 1, "colour", "Blue"), ("apol1", 3, 1, "risk", "high")])
BINDINGS = Cases("fid string, aid string, k string, vals array<string>", [("f1", "apol1", "status", ["G1/G0", "G2/G2"]), ("f2", "", "colour", ["Blue"]), ("f3", "eye", "status", ["G1/G0"]), ("f4", "apol1", "risk", ["low"])])


@query("join_15", f"select fid, min(row(a.aid, a.pid, a.r, a.v)).v as v from (select fid, a.aid, a.pid, a.r, a.v from {BINDINGS.sql()} b join {ANALYSIS.sql()} a on a.k = b.k and (b.aid = '' or b.aid = a.aid) and list_contains(b.vals, a.v)) a group by fid".replace("min(row(a.aid, a.pid, a.r, a.v)).v", "arg_min(v, aid || '|' || lpad(cast(pid as varchar), 9, '0') || '|' || lpad(cast(r as varchar), 9, '0'))"))
def join_15(spark, sf):
    b, a = BINDINGS.df(spark).withColumnRenamed("aid", "want"), ANALYSIS.df(spark)
    hit = a.join(b, "k").where(((C("want") == "") | (C("want") == C("aid"))) & F.array_contains("vals", C("v")))
    return hit.groupBy("fid").agg(F.min_by("v", F.struct("aid", "pid", "r")).alias("v"))


REFS = Cases("fid string, ref string", [("f1", "rs1"), ("f2", "variants/x.yaml"), ("f3", "other/x.yaml"), ("f4", ""), ("f5", "x"), ("f6", "k9")])
KEYS = Cases("oid int, vkey string, path string, rsid string", [(1, "k1", "a/b/x.yaml", "rs1"), (2, "k9", "y.yaml", "rs2"), (3, "x", "z.yaml", None)])


@query("join_16", f"""select fid, oid from {REFS.sql()} f, {KEYS.sql()} o where f.ref = '' or f.ref in (o.vkey, o.path, o.rsid) or list_contains(list_transform(list_filter([o.vkey, o.path, o.rsid], lambda x: x is not null), lambda x: string_split(x, '/')[-1]), string_split(f.ref, '/')[-1])""")
def join_16(spark, sf):
    base = lambda c: F.substring_index(c, "/", -1)
    keys = KEYS.df(spark).select("oid", F.explode(F.array("vkey", "path", "rsid")).alias("key")).where("key is not null").select("oid", base(C("key")).alias("key")).distinct()
    refs = REFS.df(spark)
    named = refs.where("ref <> ''").select("fid", base(C("ref")).alias("key")).join(keys, "key").select("fid", "oid")
    return named.unionByName(refs.where("ref = ''").join(KEYS.df(spark).select("oid"), F.lit(True)).select("fid", "oid")).distinct()


@query("join_17", f"select event_id from {plain(READS)} where name in (select name from {plain(READS)} where chrom = '1' and start between 500 and 900) or flag & 4 <> 0")
def join_17(spark, sf):
    r = view(spark, sf, READS)
    names = r.where("chrom = '1' and start between 500 and 900").select("name").distinct()
    out = reads.has(C("flag"), reads.UNMAPPED)
    return r.where(~out).join(names, "name", "left_semi").select("event_id").unionByName(r.where(out).select("event_id"))


@query("join_18", f"select name, min(event_id) filter (where flag & 64 <> 0) as first_mate, min(event_id) filter (where flag & 128 <> 0) as last_mate from {plain(READS)} group by name")
def join_18(spark, sf):
    one = lambda bit: F.min(F.when(reads.has(C("flag"), bit), C("event_id")))
    return view(spark, sf, READS).groupBy("name").agg(one(64).alias("first_mate"), one(128).alias("last_mate"))


@query("join_19", f"select o.record_id, c.variant_id, bool_or(o.rsid = c.rs) as by_name, bool_or(o.pos = c.p and o.chrom = c.ch) as by_place from {plain(CALLS)} o join (select variant_id, lower(trim(rsid)) as rs, grch38_pos as p, grch38_chrom as ch from variant_catalogue) c on o.rsid = c.rs or (o.pos = c.p and o.chrom = c.ch) group by all")
def join_19(spark, sf):
    o = view(spark, sf, CALLS).select("record_id", "rsid", "pos", "chrom")
    c = table(spark, sf, "variant_catalogue").select("variant_id", F.lower(F.trim("rsid")).alias("rs"), C("grch38_pos").alias("p"), C("grch38_chrom").alias("ch"))
    keep = ["record_id", "variant_id", "rsid", "rs", "pos", "p", "chrom", "ch"]
    hits = o.join(c, C("rsid") == C("rs")).select(*keep).unionByName(o.join(c, (C("pos") == C("p")) & (C("chrom") == C("ch"))).select(*keep))
    return hits.groupBy("record_id", "variant_id").agg(F.bool_or(C("rsid") == C("rs")).alias("by_name"), F.bool_or((C("pos") == C("p")) & (C("chrom") == C("ch"))).alias("by_place"))


@query("join_20", f"with f as (select pid, rsid, display as shown from {plain(CALLS)} where rsid is not null qualify row_number() over (partition by pid, rsid order by record_id, display nulls first) = 1) select o.record_id, o.display, coalesce(f.shown, o.display) as shown from {plain(CALLS)} o left join f on f.pid = o.pid and f.rsid = o.rsid")
def join_20(spark, sf):
    o = view(spark, sf, CALLS)
    f = o.where("rsid is not null").groupBy("pid", "rsid").agg(F.min(F.struct("record_id", "display"))["display"].alias("first"))
    # one participant holds many rows, a participant and name do not: the join keys spread
    return o.join(f, ["pid", "rsid"], "left").select("record_id", "display", F.coalesce("first", "display").alias("shown"))


TWO = Cases("sample string, a string, b string", [("s1", "High_Precision", "positive"), ("s2", "negative", "negative"), ("s3", "Low_Precision", "negative"), ("s4", "negative", "positive"), ("s5", "negative", None)])


@query("join_21", f"select sample, case when b is null then 'not_performed' when (a <> 'negative') = (b = 'positive') then 'concordant' else 'discordant' end as status from {TWO.sql()}")
def join_21(spark, sf):
    x = TWO.df(spark)
    other = x.where("b is not null").select("sample", (C("b") == "positive").alias("found"))
    return x.select("sample", "a").join(other, "sample", "left").select("sample", F.when(C("found").isNull(), "not_performed").when((C("a") != "negative") == C("found"), "concordant").otherwise("discordant").alias("status"))


@query("join_23", f"select pid, vid, arg_max(genotype, row_idx) as genotype, max(row_idx) as row_idx from ({_BYN.format(rows=_R, specs=_S)}) where genotype is not null group by 1, 2")
def join_23(spark, sf):
    return lookup.last_winners(lookup.by_name(view(spark, sf, ROWS), view(spark, sf, SPECS)))


@query("join_24", f"select pid, vid, arg_max(genotype, row_idx) as genotype from ({_BYN.format(rows=_R, specs=_S)}) where genotype is not null and prio = 0 group by 1, 2")
def join_24(spark, sf):
    return lookup.last_winners(lookup.by_name(view(spark, sf, ROWS), view(spark, sf, SPECS))).select("pid", "vid", "genotype")


ANCHOR_ROWS = Cases("f string, rsid string, chrom string, pos long, genotype string", [(f, r, ("chr" + c) if f == "b" else c, {"a": p37, "b": p38, "c": p36, "d": p37 if i % 2 else p38}[f], al if i % 3 else "--") for f in "abcd" for i, (r, c, p36, p37, p38, al) in enumerate(inspect.ANCHORS[:9])] + [("e", "rs1", "1", 11856378, "AG"), ("e", "rs1", "1", 11856378, "AT"), ("f", "rs6025", "1", 169519049, "C")])
_ANCH = "(select col0 as a_rsid, col1 as chrom, col2 as build, col3 as pos, col4 as al from (values " + ", ".join(f"('{r}', '{c}', {b}, {p}, '{al}')" for r, c, p36, p37, p38, al in inspect.ANCHORS for b, p in ((36, p36), (37, p37), (38, p38))) + "))"


@query("join_22", f"""with h as (select r.f, a.build, case when r.rsid = a.a_rsid then 3 when regexp_full_match(replace(r.genotype, '-', ''), '[' || a.al || ']*') or regexp_full_match(replace(r.genotype, '-', ''), '[' || translate(a.al, 'ACGT', 'TGCA') || ']*') then 1 end as w from {ANCHOR_ROWS.sql()} r join {_ANCH} a on upper(regexp_replace(r.chrom, '^chr', '')) = a.chrom and r.pos = a.pos),
    s as (select f, coalesce(sum(w) filter (where build = 36), 0)::bigint as score_36, coalesce(sum(w) filter (where build = 37), 0)::bigint as score_37, coalesce(sum(w) filter (where build = 38), 0)::bigint as score_38, count(w) as anchors from h group by f)
    select *, case when anchors >= 4 and greatest(score_36, score_37, score_38) / (score_36 + score_37 + score_38) >= 0.9 then case greatest(score_36, score_37, score_38) when score_37 then 'grch37' when score_38 then 'grch38' end end as assembly from s""")
def join_22(spark, sf):
    return inspect.anchor_votes(ANCHOR_ROWS.df(spark), "f")


QUERIES["agg_11"] = join_22
SQL["agg_11"] = SQL["join_22"]

# --- filters

MANIFESTS = Cases("path string, name string, tags array<string>", [("a/hbb.yaml", "HBB site", ["gene:HBB", "blood"]), ("b/apol1.yaml", "APOL1 G1", ["gene:APOL1"]), ("b/x.yaml", "Other", [])])


@query("flt_01", f"select path, contains(name, 'G1') as by_name, contains(path, 'b/') as by_path, list_contains(tags, 'blood') as by_tag, contains(path, 'b/') and contains(name, 'G1') as both_, false as unknown_key from {MANIFESTS.sql()}")
def flt_01(spark, sf):
    from genoquery.sources.manifest import matches

    m = lambda *f: matches(list(f), C("name"), C("path"), C("tags"))
    return MANIFESTS.df(spark).select("path", m("name=G1").alias("by_name"), m("path=b/").alias("by_path"), m("tag=blood").alias("by_tag"), m("path=b/", "name=G1", "kind=variant").alias("both_"), m("colour=red").alias("unknown_key"))


@query("flt_02", f"select path, contains(path, 'b/') as by_path, false as other from {MANIFESTS.sql()}")
def flt_02(spark, sf):
    return MANIFESTS.df(spark).select("path", F.contains("path", F.lit("b/")).alias("by_path"), F.lit(False).alias("other"))


QUERIES["flt_03"] = join_14
SQL["flt_03"] = _FJ


@query("flt_06", f"select case when flag & 4 <> 0 then 'unmapped' when flag & 256 <> 0 then 'secondary' when flag & 512 <> 0 then 'qc_fail' when flag & 1024 <> 0 then 'duplicate' when flag & 1 <> 0 and flag & 2 = 0 then 'improper_pair' end as why, qual < 13 as low, base in ('A', 'C', 'G', 'T') as acgt, count(*) as n from {plain(READS)} group by all")
def flt_06(spark, sf):
    return view(spark, sf, READS).groupBy(reads.read_filter(C("flag")).alias("why"), (C("qual") < reads.LEAST_QUALITY).alias("low"), C("base").isin("A", "C", "G", "T").alias("acgt")).agg(_n())


VNTR = Cases("sample string, idx int, CHROM string, POS long, REF string, ALT string, Sample_text string", [
    ("s1", 0, "1-2", 67, "C", "CGGCA", "Del:120:10000"), ("s1", 1, "1-2", 60, "ATG", "A", "Del:50:10000"), ("s1", 2, "3-4", 40, "C", "CGG", "Del:5:10000"), ("s1", 3, "3-5", 40, "C", "CGG", "Del:90:10000"), ("s2", 0, "8-X", 67, "G", "GG", "Del:200:10000"), ("s2", 1, "X-8", 67, "G", "GG", "Del:150:10000"), ("s2", 2, "Q-6", 20, "A", "AT", "Del:300:10000"),
    ("s2", 3, "C-Q", 30, "A", "AT", "Del:30:5000"), ("s3", 0, "AB", 67, "G", "GT", "Del:200:10000"), ("s4", 0, "1-2", 67, "C", "GG", "Del:30:150"), ("s4", 1, "1-2", 70, "C", "CA", "Del:15:100"), ("s4", 2, "1-2", 71, "C", "CA", "x:y:z"), ("s5", 0, "C-C", 67, "C", "CA", "Del:469:100000"), ("s5", 1, "C-C", 68, "CTT", "C", "Del:50:10000"), ("s5", 2, "C-C", 66, "C", "GG", "Del:90:10000"), ("s5", 3, "9-C", 69, "C", "CT", "Del:90:10000"),
])
_V = f"""(select *, case when rd <> 0 then ad / rd end as score from (select sample, idx, CHROM, POS, REF, ALT, length(ALT) - length(REF) as d, coalesce(try_cast(split_part(Sample_text, ':', 2) as double), 0) as ad, coalesce(try_cast(split_part(Sample_text, ':', 3) as double), 0) as rd from {VNTR.sql()}))"""
_VV = "((d > 0 and d % 3 = 1) or (d < 0 and abs(d) % 3 = 2))"


def _vntr(spark):
    return vntr.annotate(VNTR.df(spark).select(C("sample").alias("who"), "idx", "CHROM", "POS", "REF", "ALT", C("Sample_text").alias("Sample")))


@query("flt_07", f"select sample as who, idx, d % 3 <> 0 as is_frameshift, {_VV} as valid from {_V}")
def flt_07(spark, sf):
    return _vntr(spark).select("who", "idx", "is_frameshift", "valid")


_CONF = """case when score is null or score < 0.00469 then 'Negative' else coalesce(
    case when score > 0.00469 and score < 0.00515 then 'Low_Precision' end, case when ad >= 21 and ad < 100 and score >= 0.00515 then 'High_Precision' end, case when ad <= 20 then 'Low_Precision' end, case when ad >= 21 and ad < 100 and score between 0.00469 and 0.00515 then 'Low_Precision' end,
    case when ad >= 100 and score >= 0.00515 then 'High_Precision*' end, case when rd <= 200 or score = 0.00469 then 'Low_Precision' end, 'Negative') end"""


@query("flt_08", f"select sample as who, idx, score as depth_score, {_CONF} as confidence from {_V}")
def flt_08(spark, sf):
    return _vntr(spark).select("who", "idx", "depth_score", "confidence")


@query("flt_09", f"select sample as who, idx, ALT <> 'GG' or coalesce(score >= 0.00469, false) as alt_pass from {_V}")
def flt_09(spark, sf):
    return _vntr(spark).select("who", "idx", "alt_pass")


_DASH = "length(CHROM) - length(replace(CHROM, '-', ''))"
_M = f"""(select *, case when ok then split_part(CHROM, '-', case when POS < 60 then 2 else 1 end) end as motif, {_VV} as valid, {_CONF} as conf, ALT <> 'GG' or coalesce(score >= 0.00469, false) as alt_pass from (select *, max({_DASH}) over (partition by sample) = 1 and {_DASH} = 1 as ok from {_V}))"""
_M2 = f"(select *, coalesce(max(case when ok and POS >= 60 and ALT = 'GG' then 1 end) over (partition by sample), 0) = 1 as gg from {_M})"
_M3 = f"(select *, ok and (POS < 60 or not gg or motif not in ('8', '9', '7', '6p', '6')) as inn from {_M2})"
_M4 = f"""(select *, coalesce(inn and (row_number() over (partition by sample, POS < 60, inn, POS, REF, ALT order by valid desc, coalesce(score, 0) desc, idx) = 1 or (POS >= 60 and not gg)) and ALT not in ('CCGCC', 'CGGCG', 'CGGCC') and motif not in ('6', '6p', '7'), false) as survives from {_M3})"""
_M5 = f"(select *, survives and valid and conf <> 'Negative' and alt_pass as passes, case when REF = 'C' and ALT = 'CGGCA' then 'False_Positive_4bp_Insertion' else '' end as f1, case when score < 0.4 and motif in ('1', '2', '3', '4', '6', '7', '8', '9') then 'Low_Depth_Conserved_Motifs' else '' end as f2 from {_M4})"


def _motifs(spark):
    c = vntr.correct_motifs(_vntr(spark), "who")
    return c.withColumn("flag", vntr.flag(C("motif")))


@query("win_03", f"select sample as who, idx, motif, survives, passes from {_M5}")
def win_03(spark, sf):
    return _motifs(spark).select("who", "idx", "motif", "survives", "passes")


QUERIES["win_02"], SQL["win_02"] = win_03, SQL["win_03"]
_FLAG = "case when f1 = '' and f2 = '' then 'Not flagged' when f1 = '' then f2 when f2 = '' then f1 else f1 || ', ' || f2 end"


@query("flt_10", f"select sample as who, idx, {_FLAG} as flag from {_M5}")
def flt_10(spark, sf):
    return _motifs(spark).select("who", "idx", "flag")


@query("win_04", f"select sample as who, idx from (select sample, idx, row_number() over (partition by sample order by coalesce(score, 0) desc, idx desc) as k from {_V}) where k = 1")
def win_04(spark, sf):
    return vntr.best_call(_vntr(spark), "who")


@query("agg_26", f"""with l as (select sample, idx, case when passes then case when conf in ('High_Precision', 'High_Precision*') and {_FLAG} = 'Not flagged' then 'High_Precision' when conf = 'Low_Precision' and {_FLAG} = 'Not flagged' then 'Low_Precision' when conf in ('High_Precision', 'High_Precision*') then 'High_Precision_flagged' when conf = 'Low_Precision' then 'Low_Precision_flagged' end end as label from {_M5})
    select sample as who, coalesce(arg_min(label, idx) filter (where label is not null), 'negative') as result from l group by 1""")
def agg_26(spark, sf):
    return vntr.result(_motifs(spark), "who")


@query("win_05", f"select sample as who, idx, row_number() over (partition by sample, POS, REF, ALT order by coalesce(score, 0) desc, idx) > 1 as duplicate from {_V}")
def win_05(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("who", "POS", "REF", "ALT").orderBy(F.coalesce("depth_score", F.lit(0.0)).desc(), "idx")
    return _vntr(spark).select("who", "idx", (F.row_number().over(w) > 1).alias("duplicate"))


COVERAGE = Cases("s string, mean double", [("a", 100.0), ("b", 99.9), ("c", None)])


@query("agg_27", f"select s, coalesce(mean >= 100, true) as pass from {COVERAGE.sql()}")
def agg_27(spark, sf):
    return COVERAGE.df(spark).select("s", F.coalesce(C("mean") >= 100, F.lit(True)).alias("pass"))


RULES = Cases("i int, result string, flagged boolean, depth double", [(1, "High", False, 10.0), (2, "Low", True, 2.0), (3, "None", False, 0.0)])


@query("flt_12", f"select i, case when result = 'High' and flagged <> true then 'A' when result in ('Low', 'Mid') then 'B' when result not in ('High', 'Low') then 'C' end as rule from {RULES.sql()}")
def flt_12(spark, sf):
    # Rules as (column, operator, value) and their label, first rule first.
    rules = [([("result", "==", "High"), ("flagged", "!=", True)], "A"), ([("result", "in", ["Low", "Mid"])], "B"), ([("result", "not in", ["High", "Low"])], "C")]
    ops = {"==": lambda c, v: c == v, "!=": lambda c, v: c != v, "in": lambda c, v: c.isin(v), "not in": lambda c, v: ~c.isin(v)}
    out = F.lit(None).cast("string")
    for tests, label in reversed(rules):
        ok = F.lit(True)
        for column, op, value in tests:
            ok = ok & ops[op](C(column), value)
        out = F.when(ok, label).otherwise(out)
    return RULES.df(spark).select("i", out.alias("rule"))


@query("flt_11", f"select i, depth / 2 > 1 as deep, result = 'High' or flagged as odd from {RULES.sql()}")
def flt_11(spark, sf):
    # Named rule expressions; text from outside is never evaluated.
    rules = {"deep": "depth / 2 > 1", "odd": "result = 'High' or flagged"}
    return RULES.df(spark).select("i", *[F.expr(x).alias(n) for n, x in rules.items()])


@query("flt_13", "select row_id from thalassemia_clinvar where lower(clnsig) in ('pathogenic', 'likely_pathogenic') and lower(clnvc) = 'single_nucleotide_variant' and lower(gene) = 'hbb'")
def flt_13(spark, sf):
    low = lambda c, *v: F.lower(c).isin(*v)
    return table(spark, sf, "thalassemia_clinvar").where(low("clnsig", "pathogenic", "likely_pathogenic") & low("clnvc", "single_nucleotide_variant") & low("gene", "hbb")).select("row_id")


@query("flt_14", "select row_id, length(ref) as r, length(alt) as a from thalassemia_clinvar where length(ref) > 1 or length(alt) > 1")
def flt_14(spark, sf):
    return table(spark, sf, "thalassemia_clinvar").select("row_id", F.length("ref").alias("r"), F.length("alt").alias("a")).where("r > 1 or a > 1")


@query("flt_15", "select row_id, rsid, position, clnvc from thalassemia_clinvar where rsid = 'rs8000000014' or position between 5225000 and 5228000 or clnvc = 'Deletion'")
def flt_15(spark, sf):
    return table(spark, sf, "thalassemia_clinvar").where((C("rsid") == "rs8000000014") | C("position").between(5225000, 5228000) | (C("clnvc") == "Deletion")).select("row_id", "rsid", "position", "clnvc")


@query("src_26", "select row_id from thalassemia_clinvar where len(list_filter(string_split(gene, '|'), lambda g: split_part(g, ':', 1) = 'HBD')) > 0")
def src_26(spark, sf):
    return table(spark, sf, "thalassemia_clinvar").where(F.exists(F.split("gene", r"\|"), lambda g: F.substring_index(g, ":", 1) == "HBD")).select("row_id")


# --- aggregations

_KEEP = "not (flag & 4 <> 0 or flag & 256 <> 0 or flag & 512 <> 0 or flag & 1024 <> 0 or (flag & 1 <> 0 and flag & 2 = 0))"
_WHY = "case when flag & 4 <> 0 then 'unmapped' when flag & 256 <> 0 then 'secondary' when flag & 512 <> 0 then 'qc_fail' when flag & 1024 <> 0 then 'duplicate' when flag & 1 <> 0 and flag & 2 = 0 then 'improper_pair' end"


@query("agg_01", f"select chrom, start, {', '.join(f'''count(*) filter (where {_WHY} = '{w}') as filtered_{w}''' for w in ('unmapped', 'secondary', 'qc_fail', 'duplicate', 'improper_pair'))}, count(*) filter (where {_KEEP} and base <> 'N') as raw_depth, count(*) filter (where {_KEEP} and base = 'A') as raw_ref, count(*) filter (where {_KEEP} and base = 'G') as raw_alt, count(*) filter (where {_KEEP} and qual < 13) as low_quality, count(*) filter (where {_KEEP} and qual >= 13 and base = 'N') as non_acgt, count(*) filter (where {_KEEP} and qual >= 13 and base <> 'N') as depth, count(*) filter (where {_KEEP} and qual >= 13 and base = 'A') as ref_count, count(*) filter (where {_KEEP} and qual >= 13 and base = 'G') as alt_count, "
       + ", ".join(f"count(*) filter (where {_KEEP} and base = '{b}') as raw_{b.lower()}, count(*) filter (where {_KEEP} and qual >= 13 and base = '{b}') as filtered_{b.lower()}, count(*) filter (where {_KEEP} and base = '{b}' and flag & 16 <> 0) as reverse_{b.lower()}" for b in "ACGT") + f" from {plain(READS)} group by 1, 2")
def agg_01(spark, sf):
    return reads.snp_pileup(view(spark, sf, READS), ["chrom", "start"], F.lit("A"), F.lit("G"))


CIGARS = Cases("i int, start long, stop long, cigar string", [(1, 100, 149, "50M"), (2, 100, 151, "20M2D30M"), (3, 100, 147, "20M2I28M"), (4, 95, 140, "5S46M"), (5, 100, 159, "10M20N30M"), (6, 119, 168, "3H50M"), (7, 100, 169, "20M2I10M1D39M"), (8, 121, 170, "50=")])


@query("agg_04", """select * from (values (1, 0, 19, 20, 21, 22, 30), (2, 0, 19, null, null, 20, 28), (3, 0, 19, 22, 23, 24, 32), (4, 10, 29, 30, 31, 32, 40), (5, 0, null, null, null, null, 10), (6, null, 0, 1, 2, 3, 11), (7, 0, 19, 22, 23, 24, null), (8, null, null, null, 0, 1, 9)) t(i, at_100, at_119, at_120, at_121, at_122, at_130)""")
def agg_04(spark, sf):
    x = CIGARS.df(spark).withColumn("ops", reads.parse_cigar(C("cigar")))
    return x.select("i", *[reads.index_at(C("ops"), C("start"), F.lit(p).cast("long")).alias(f"at_{p}") for p in (100, 119, 120, 121, 122, 130)])


@query("agg_05", """select * from (values (1, null, null), (2, 'D', 2), (3, 'I', 2), (4, null, null), (5, null, null), (6, null, null), (7, 'I', 2), (8, null, null)) t(i, kind, len)""")
def agg_05(spark, sf):
    x = CIGARS.df(spark).withColumn("ops", reads.parse_cigar(C("cigar"))).withColumn("hit", reads.indel_at(C("ops"), C("start"), F.lit(119).cast("long")))
    return x.select("i", C("hit.kind").alias("kind"), C("hit.len").alias("len"))


@query("agg_03", """select 7 as depth, 4 as ref_like, 2 as alt_count, [0, 2, 4] as lengths""")
def agg_03(spark, sf):
    x = CIGARS.df(spark).withColumn("ops", reads.parse_cigar(C("cigar"))).withColumn("len", reads.observed_length(C("ops"), C("start"), C("stop"), F.lit(120).cast("long"), F.lit(121).cast("long"), F.lit(2)))
    return x.where("len is not null").agg(_n().alias("depth"), F.count_if(C("len") == 2).alias("ref_like"), F.count_if(C("len") == 4).alias("alt_count"), F.array_sort(F.collect_set("len")).alias("lengths"))


@query("agg_02", """select 7 as depth, 1 as alt_count, 6 as ref_count""")
def agg_02(spark, sf):
    x = CIGARS.df(spark).withColumn("ops", reads.parse_cigar(C("cigar"))).withColumn("hit", reads.indel_at(C("ops"), C("start"), F.lit(119).cast("long")))
    spans = (C("start") - 1 <= 119) & (C("stop") >= 119)
    gone = F.coalesce((C("hit.kind") == "D") & (C("hit.len") == 2), F.lit(False))
    return x.where(spans).agg(_n().alias("depth"), F.count_if(gone).alias("alt_count"), F.count_if(~gone).alias("ref_count"))


DEPTHS = "select cast(1 + user_id % 5 as string) as chrom, user_id as pos, count(*) as depth from {events} group by user_id"
REGIONS = Cases("chrom string, lo long, hi long", [("1", 0, 999), ("2", 100, 100), ("3", 50, 400), ("9", 1, 10)])


@query("agg_06", f"""with p as (select r.chrom, r.lo, r.hi, unnest(range(lo, hi + 1)) as pos from {REGIONS.sql()} r), d as (select p.chrom, coalesce(d.depth, 0) as depth from p left join {plain(DEPTHS)} d on d.chrom = p.chrom and d.pos = p.pos)
    select chrom, avg(depth) as mean, median(depth) as median, stddev_pop(depth) as stdev, min(depth) as min, max(depth) as max, count(*) as region_length, count(*) filter (where depth = 0) as uncovered_bases, count(*) filter (where depth = 0) / count(*) * 100 as percent_uncovered from d group by 1""")
def agg_06(spark, sf):
    return reads.depth_summary(view(spark, sf, DEPTHS), REGIONS.df(spark), ["chrom"])


MARKERS = [f"rs{n}" for n in range(0, 2000, 7)]
SEXROWS = "select participant_id as f, lower(rsid) as rsid, case when record_id % 5 = 0 then 'Y' else chrom end as chrom, pos_start as pos, case when record_id % 7 = 0 then substr(genotype_display, 1, 1) else genotype_display end as genotype from {observations}"
_SX = f"(select f, rsid, upper(regexp_replace(regexp_replace(chrom, '^(chr)+', ''), '^(CHR)+', '')) as c, pos, upper(trim(genotype)) as g, coalesce(regexp_full_match(upper(trim(genotype)), '[ACGT]+'), false) as called from {plain(SEXROWS)})"
_XX = "c = 'X' and pos between 2781480 and 154931043 and called"


@query("agg_07", f"select f, count(*) filter (where {_XX}) as x_non_par_sites, count(*) filter (where {_XX} and length(g) = 1) as x_haploid_gt_sites, count(*) filter (where {_XX} and length(g) = 2) as x_diploid_gt_sites, count(*) filter (where {_XX} and length(g) = 2 and g[1] <> g[2]) as x_het_gt_sites, count(*) filter (where c = 'Y') as total_y_snps, count(*) filter (where c = 'Y' and called) as called_y_snps, 0::bigint as male_markers_found, 0::bigint as male_markers_called from {_SX} group by f")
def agg_07(spark, sf):
    return inspect.sex_statistics(view(spark, sf, SEXROWS), "f", MARKERS)


_SS = "x_non_par_sites long, x_haploid_gt_sites long, x_diploid_gt_sites long, x_het_gt_sites long, total_y_snps long, called_y_snps long, male_markers_found long, male_markers_called long"
SEXES = Cases("i long, " + _SS, [(i, *r) for i, r in enumerate([(20000, 100, 19000, 3000, 0, 0, 0, 0), (2000, 10, 1900, 50, 0, 0, 0, 0), (20000, 19900, 10, 1, 0, 0, 0, 0), (2000, 1920, 10, 1, 0, 0, 0, 0), (0, 0, 0, 0, 2000, 10, 5, 0), (0, 0, 0, 0, 1000, 700, 0, 0), (0, 0, 0, 0, 1000, 150, 20, 12), (0, 0, 0, 0, 2000, 0, 0, 0), (0, 0, 0, 0, 2000, 5, 2, 2), (0, 0, 0, 0, 100, 60, 0, 0), (0, 0, 0, 0, 20, 3, 0, 0), (0, 0, 0, 0, 0, 0, 0, 0), (100, 5, 80, 10, 0, 0, 0, 0), (100, 30, 50, 0, 0, 0, 0, 0), (60, 0, 60, 0, 0, 0, 0, 0), (2000, 0, 1900, 300, 300, 250, 0, 0), (10, 0, 0, 0, 900, 600, 0, 0), (0, 0, 0, 0, 99999, 10000, 0, 0)])])
_Y, _H, _X = "(case when total_y_snps > 0 then called_y_snps * 100.0 / total_y_snps else 0 end)", "(case when x_non_par_sites > 0 then x_haploid_gt_sites * 100.0 / x_non_par_sites else 0 end)", "(case when x_non_par_sites > 0 then x_het_gt_sites * 100.0 / x_non_par_sites else 0 end)"


@query("agg_08", f"""select i, split_part(r, '|', 1) as sex, split_part(r, '|', 2) as confidence from (select i, case when x_non_par_sites >= 1000 and x_diploid_gt_sites >= 1000 and {_X} >= 2 then 'female|' || case when x_non_par_sites >= 10000 and {_X} >= 10 then 'high' else 'medium' end
    when x_non_par_sites >= 1000 and {_H} >= 95 then 'male|' || case when x_non_par_sites >= 10000 and {_H} >= 99 then 'high' else 'medium' end when total_y_snps > 1000 and male_markers_found >= 3 and male_markers_called = 0 and {_Y} < 20 then 'female|high' when called_y_snps > 500 and {_Y} >= 50 then 'male|high'
    when called_y_snps > 100 and male_markers_called > 10 then 'male|medium' when total_y_snps > 1000 and called_y_snps < 10 and male_markers_called < 3 then 'female|' || case when called_y_snps = 0 then 'high' else 'medium' end when called_y_snps > 50 or male_markers_called > 5 then 'male|medium' when called_y_snps < 10 and total_y_snps > 0 then 'female|medium' else 'unknown|low' end as r from {SEXES.sql()})""")
def agg_08(spark, sf):
    return SEXES.df(spark).select("i", inspect.classify_array_sex().alias("s")).select("i", "s.*")


_VX, _VY = "(case when x_diploid_gt_sites > 0 then x_het_gt_sites * 100.0 / x_diploid_gt_sites else 0 end)", "(case when x_non_par_sites > 0 then called_y_snps * 100.0 / x_non_par_sites else 0 end)"


@query("agg_09", f"""select i, split_part(r, '|', 1) as sex, split_part(r, '|', 2) as confidence from (select i, case when called_y_snps >= 10000 or (x_non_par_sites >= 1000 and {_VY} >= 10) then 'male|high' when x_non_par_sites >= 50 and x_diploid_gt_sites > 0 and {_VX} >= 2 then 'female|' || case when x_non_par_sites >= 1000 and {_VX} >= 10 then 'high' else 'medium' end
    when x_haploid_gt_sites >= 20 or (x_non_par_sites >= 50 and x_diploid_gt_sites > 0 and {_VX} <= 0.2) then 'male|high' when called_y_snps > 500 then 'unknown|medium' else 'unknown|low' end as r from {SEXES.sql()})""")
def agg_09(spark, sf):
    return SEXES.df(spark).select("i", inspect.classify_vcf_sex().alias("s")).select("i", "s.*")


WINDOWS = Cases("f string, part string, n long", [("a", "autosome", 40), ("a", "autosome", 900), ("a", "x", 30), ("a", "y", 1), ("b", "autosome", 100), ("b", "x", 50), ("b", "y", 45), ("c", "autosome", 3), ("c", "x", 3), ("c", "y", 0)])


@query("agg_10", f"""with m as (select f, avg(least(n, 400)) filter (where part = 'autosome') as a, avg(least(n, 400)) filter (where part = 'x') as x, avg(least(n, 400)) filter (where part = 'y') as y from {WINDOWS.sql()} group by f)
    select f, case when a < 5 then 'unknown' when x / a >= 0.75 and y / a < 0.15 then 'female' when x / a < 0.75 and y / a >= 0.08 then 'male' when x / a >= 0.75 and y / a < 0.25 then 'female' when x / a < 0.85 and y / a >= 0.03 then 'male' else 'unknown' end as sex from m""")
def agg_10(spark, sf):
    mean = lambda p: F.coalesce(F.avg(F.when(C("part") == p, F.least("n", F.lit(400)))), F.lit(0.0))
    m = WINDOWS.df(spark).groupBy("f").agg(mean("autosome").alias("a"), mean("x").alias("x"), mean("y").alias("y"))
    return m.select("f", inspect.classify_depth_sex(C("a"), C("x"), C("y"))["sex"].alias("sex"))


REPL = "select participant_id as pid, lower(rsid) as rsid, record_id as idx, case when record_id % 4 = 0 then '--' else genotype_display end as genotype from {observations} where rsid is not null"


@query("agg_12", f"select key, case when count(distinct g) = 1 then min(g) else '--' end as genotype from (select pid || ':' || rsid as key, case when genotype not in ('--', '') then genotype end as g from {plain(REPL)}) group by key")
def agg_12(spark, sf):
    return cohort.merge_replicates(view(spark, sf, REPL).withColumn("key", F.concat_ws(":", "pid", "rsid")), "key", "genotype")


ORDERED = Cases("k string, i int, genotype string", [("a", 1, "AA"), ("a", 2, "AG"), ("a", 3, "GG"), ("b", 1, "--"), ("b", 2, "AA"), ("c", 1, "AA"), ("c", 2, "--"), ("d", 1, "AA"), ("d", 2, "AG"), ("e", 1, "--"), ("f", 1, "AA"), ("f", 2, "AA")])


@query("agg_13", f"with recursive o as (select *, row_number() over (partition by k order by i) as rn from {ORDERED.sql()}), s as (select k, rn, genotype as g from o where rn = 1 union all select o.k, o.rn, case when s.g = '--' then o.genotype when o.genotype = '--' or o.genotype = s.g then s.g else '--' end from s join o on o.k = s.k and o.rn = s.rn + 1) select k, arg_max(g, rn) as genotype from s group by k")
def agg_13(spark, sf):
    return cohort.merge_in_order(ORDERED.df(spark), ["k"], "i", "genotype")


@query("agg_14", "select participant_id as pid, count(*) as tested, count(*) filter (where call_status = 'called') as called, count(*) filter (where call_status is distinct from 'called') as missing, case when count(*) = count(*) filter (where call_status = 'called') then 'complete' else 'partial' end as status from observations group by 1")
def agg_14(spark, sf):
    yes = C("call_status") == "called"
    m = table(spark, sf, "observations").groupBy(C("participant_id").alias("pid")).agg(F.count(F.lit(1)).alias("tested"), F.count_if(yes).alias("called"))
    return m.select("pid", "tested", "called", (C("tested") - C("called")).alias("missing"), F.when(C("tested") == C("called"), "complete").otherwise("partial").alias("status"))


EVID = Cases("i int, source string, kind string, id string, url string, fid string, label string, effect string", [(1, "clinvar", "v", "9", None, "f1", "x", "e"), (2, "clinvar", "v", "9", None, "f2", "y", "e"), (3, None, None, None, "http://a", "f3", "z", "e"), (4, None, None, None, "http://a", "f4", "z", "e"), (5, None, None, None, None, "f5", "q", "e"), (6, None, None, None, None, None, "q", "e"), (7, None, None, None, None, None, "q", "e"), (8, None, None, None, None, None, "r", "")])


@query("agg_15", f"select min(i) as i, key from (select i, case when coalesce(source, '') || coalesce(kind, '') || coalesce(id, '') <> '' then 'evidence|' || coalesce(source, '') || '|' || coalesce(kind, '') || '|' || coalesce(id, '') || '|' || effect when url is not null then 'evidence_url|' || url || '|' || effect when fid is not null then 'id|' || fid || '|' || effect else 'content|' || coalesce(label, '') || '|' || effect end as key from {EVID.sql()}) group by key")
def agg_15(spark, sf):
    z = lambda c: F.coalesce(C(c), F.lit(""))
    bar = lambda *p: F.concat_ws("|", *[F.lit(x) if isinstance(x, str) else x for x in p])
    key = F.when(F.concat(z("source"), z("kind"), z("id")) != "", bar("evidence", z("source"), z("kind"), z("id"), C("effect"))).when(C("url").isNotNull(), bar("evidence_url", C("url"), C("effect"))).when(C("fid").isNotNull(), bar("id", C("fid"), C("effect"))).otherwise(bar("content", z("label"), C("effect")))
    return EVID.df(spark).groupBy(key.alias("key")).agg(F.min("i").alias("i"))


@query("agg_16", f"select path, arg_min(name, name) as name from (select * from {MANIFESTS.sql()} union all select * from {MANIFESTS.sql()}) group by path")
def agg_16(spark, sf):
    m = MANIFESTS.df(spark)
    return m.unionByName(m).dropDuplicates(["path"]).select("path", "name")


_AL = f"(select chrom, pos, ref, alt, record_id, rsid, upper(substr(genotype, 1, 1)) as a, upper(substr(genotype, 2, 1)) as b from {plain(CALLS)} where length(genotype) = 2 and chrom is not null and pos is not null)"


@query("agg_17", f"""with c as (select * from {_AL} where ref is not null and alt is not null and a in (ref, alt) and b in (ref, alt)), e as (select chrom, pos, record_id, rsid, a = b as homo, unnest([a, b]) as allele from c), n as (select chrom, pos, count(*) as allele_number from e group by 1, 2)
    select chrom, pos, allele, count(*) as allele_count, count(*) filter (where homo) as num_homo, count(*) filter (where not homo) as num_hetero, min(rsid) as rsid, any_value(allele_number) as allele_number, printf('%.6f', count(*) / any_value(allele_number)) as allele_freq from e join n using (chrom, pos) group by 1, 2, 3""".replace("min(rsid) as rsid", "arg_min(rsid, record_id) filter (where rsid is not null) as rsid"))
def agg_17(spark, sf):
    c = view(spark, sf, CALLS).where("length(genotype) = 2 and chrom is not null and pos is not null and ref is not null and alt is not null")
    c = c.groupBy("record_id", "chrom", "pos", "ref", "alt", "rsid", "genotype").agg(_n()).select("*", F.explode(F.array_repeat(F.lit(1), C("n").cast("int"))).alias("one"))
    return cohort.allele_statistics(c.select("chrom", "pos", "ref", F.array("alt").alias("alts"), F.split("genotype", "").alias("alleles"), "rsid", C("record_id").alias("row")))


@query("agg_18", f"""with e as (select chrom, pos, a = b as homo, unnest([a, b]) as allele from {_AL} where a || b <> '--'), n as (select chrom, pos, count(*) as allele_number from e group by 1, 2)
    select chrom, pos, allele, count(*) as allele_count, (count(*) filter (where homo))::bigint as num_homo, any_value(allele_number) as allele_number from e join n using (chrom, pos) group by 1, 2, 3""")
def agg_18(spark, sf):
    c = view(spark, sf, CALLS).where("length(genotype) = 2 and chrom is not null and pos is not null and genotype <> '--'")
    e = c.select("chrom", "pos", (F.upper(F.substring("genotype", 1, 1)) == F.upper(F.substring("genotype", 2, 1))).alias("homo"), F.explode(F.split(F.upper("genotype"), "")).alias("allele"))
    by = e.groupBy("chrom", "pos", "allele").agg(F.count(F.lit(1)).alias("allele_count"), F.count_if("homo").alias("num_homo"))
    return by.join(by.groupBy("chrom", "pos").agg(F.sum("allele_count").alias("allele_number")), ["chrom", "pos"])


APOL = Cases("pid int, s1 string, s2 string, g2 string", [(1, "AA", "TT", "II"), (2, "AG", "TC", "II"), (3, "GG", "CC", "II"), (4, "AA", "TT", "ID"), (5, "AG", "CT", "DI"), (6, "AA", "TT", "DD"), (7, None, None, None), (8, "AG", "TT", "II"), (9, "--", "TC", None)])
_ST = f"""(select pid, case when s1 is null and s2 is null and g2 is null then 'G-/G-' when d = 2 then 'G2/G2' when d = 1 then case when g >= 2 then 'G2/G1' else 'G2/G0' end when g = 4 then 'G1/G1' when g >= 2 then 'G1/G0' else 'G0/G0' end as status from (select *, case when a > 0 and b > 0 then a + b else 0 end as g from
    (select *, coalesce(length(replace(replace(s1, 'A', ''), '-', '')), 0) as a, coalesce(length(replace(replace(s2, 'T', ''), '-', '')), 0) as b, coalesce(length(g2) - length(replace(g2, 'D', '')), 0) as d from {{src}})))"""
TALL = "select participant_id as pid, max(case when rk = 0 then genotype_display end) as s1, max(case when rk = 1 then genotype_display end) as s2, max(case when rk = 2 then genotype_display end) as g2 from (select participant_id, genotype_display, record_id % 3 as rk from {observations} where gene = 'APOL1') group by participant_id"


@query("cls_01", f"select cast(pid as varchar) as pid, status from {_ST.format(src=APOL.sql())} union all select pid, status from {_ST.format(src=plain(TALL))}")
def cls_01(spark, sf):
    every = APOL.df(spark).withColumn("pid", C("pid").cast("string")).unionByName(view(spark, sf, TALL))
    return every.select("pid", cohort.apol1_status(C("s1"), C("s2"), C("g2")).alias("status"))


@query("cls_02", f"select o.record_id, o.pid, s.status from {plain(CALLS)} o join {_ST.format(src=plain(TALL))} s on s.pid = o.pid where o.gene = 'APOL1'")
def cls_02(spark, sf):
    s = view(spark, sf, TALL).select("pid", cohort.apol1_status(C("s1"), C("s2"), C("g2")).alias("status"))
    return view(spark, sf, CALLS).where("gene = 'APOL1'").join(s, "pid").select("record_id", "pid", "status")


@query("cls_04", f"select o.record_id, c.row_id, case when o.zygosity in ('het', 'hom_alt', 'hem_alt') then 'VARIANT_CALL' when o.zygosity in ('hom_ref', 'hem_ref') then 'REFERENCE_CALL' else 'NO_CALL' end as call from {plain(CALLS)} o join thalassemia_clinvar c on o.chrom = regexp_replace(c.chromosome, '^chr', '') and o.pos = c.position and o.ref = c.ref and o.alt = c.alt")
def cls_04(spark, sf):
    c = table(spark, sf, "thalassemia_clinvar").select("row_id", F.regexp_replace("chromosome", "^chr", "").alias("chrom"), C("position").alias("pos"), "ref", "alt")
    z = C("zygosity")
    return view(spark, sf, CALLS).join(c, ["chrom", "pos", "ref", "alt"]).select("record_id", "row_id", F.when(z.isin("het", "hom_alt", "hem_alt"), "VARIANT_CALL").when(z.isin("hom_ref", "hem_ref"), "REFERENCE_CALL").otherwise("NO_CALL").alias("call"))


@query("agg_19", f"""with s as (select status from {_ST.format(src=plain(TALL))}), e as (select status, unnest(string_split(status, '/')) as a from s), k as (select unnest(['G0', 'G1', 'G2']) as st), t as (select count(*) as n from e where a in ('G0', 'G1', 'G2'))
    select st as status, count(a) as count, any_value(n) as number, count(a) filter (where split_part(status, '/', 1) <> split_part(status, '/', 2)) as hetero, (count(a) filter (where split_part(status, '/', 1) = split_part(status, '/', 2)) // 2)::bigint as homo, printf('%.6f', case when any_value(n) > 0 then count(a) / any_value(n) else 0 end) as frequency from k left join e on e.a = k.st cross join t group by st""")
def agg_19(spark, sf):
    s = view(spark, sf, TALL).select("pid", cohort.apol1_status(C("s1"), C("s2"), C("g2")).alias("status"))
    return cohort.status_statistics(s, ["G0", "G1", "G2"])


GROUPS = ["G0/G0", "G1/G0", "G1/G1", "G2/G0", "G2/G1", "G2/G2"]


@query("agg_20", f"with k as (select unnest({GROUPS!r}) as g) select g, count(s.pid) as n from k left join {_ST.format(src=plain(TALL))} s on k.g = greatest(split_part(s.status, '/', 1), split_part(s.status, '/', 2)) || '/' || least(split_part(s.status, '/', 1), split_part(s.status, '/', 2)) group by g")
def agg_20(spark, sf):
    s = view(spark, sf, TALL).select(cohort.apol1_status(C("s1"), C("s2"), C("g2")).alias("st"))
    pair = F.array_join(F.sort_array(F.split("st", "/"), asc=False), "/")
    got = s.groupBy(pair.alias("g")).agg(_n())
    return spark.createDataFrame([(g,) for g in GROUPS], "g string").join(got, "g", "left").select("g", F.coalesce("n", F.lit(0)).alias("n"))


@query("agg_21", "select participant_id as pid, min(record_id) as record_id from observations group by 1")
def agg_21(spark, sf):
    return table(spark, sf, "observations").groupBy(C("participant_id").alias("pid")).agg(F.min_by("record_id", "record_id").alias("record_id"))


@query("agg_22", "select clnsig as value, count(*) as n from thalassemia_clinvar group by 1")
def agg_22(spark, sf):
    return table(spark, sf, "thalassemia_clinvar").groupBy(C("clnsig").alias("value")).agg(_n()).orderBy(C("n").desc(), C("value").asc_nulls_first())


@query("agg_23", "select size, count(*) as n from (select length(ref) - length(alt) as size from thalassemia_clinvar) where size > 0 group by 1 order by n desc, size limit 10")
def agg_23(spark, sf):
    t = table(spark, sf, "thalassemia_clinvar").select((F.length("ref") - F.length("alt")).alias("size")).where("size > 0")
    return t.groupBy("size").agg(_n()).orderBy(C("n").desc(), "size").limit(10)


@query("agg_24", " union ".join(f"select '{c}' as field, trim(v) as value from (select unnest(string_split({c}, '|')) as v from thalassemia_clinvar) where trim(v) <> ''" for c in ("clnsig", "clnrevstat", "clnvc")))
def agg_24(spark, sf):
    t = table(spark, sf, "thalassemia_clinvar")
    e = t.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), C(c).alias("v")) for c in ("clnsig", "clnrevstat", "clnvc")])).alias("s")).select("s.field", F.explode(F.split("s.v", r"\|")).alias("v"))
    return e.select("field", F.trim("v").alias("value")).where("value <> ''").distinct()


@query("agg_25", f"select chrom, pos, count(*) as rows, count(distinct alt) as alternates, count(distinct pid) as participants from {plain(CALLS)} where chrom is not null and pos is not null group by 1, 2")
def agg_25(spark, sf):
    c = view(spark, sf, CALLS).where("chrom is not null and pos is not null")
    # distinct pairs first, so that a hot position is counted from partial results
    alts = c.groupBy("chrom", "pos").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("alt").alias("alternates"))
    people = c.groupBy("chrom", "pos").agg(F.countDistinct("pid").alias("participants"))
    return alts.join(people, ["chrom", "pos"])


@query("agg_28", f"select chrom, count(*) as records from {plain(READS)} group by 1")
def agg_28(spark, sf):
    """Records of FASTQ files: written from the reads, a file or more a chromosome, and counted by their lines."""
    place = new_folder(spark)
    r = view(spark, sf, READS)
    r.select("chrom", F.explode(F.array(F.concat(F.lit("@"), "name"), "base", F.lit("+"), F.lit("I"))).alias("value")).write.partitionBy("chrom").text(place)
    lines = text.read_lines(spark, [place]).withColumn("file", F.regexp_extract("file", "chrom=([^/]+)", 1))
    return text.fastq_records(lines).withColumnRenamed("file", "chrom")


# --- windows, sorts, sets


@query("win_01", f"select pid, rsid, row_idx, genotype from {_R} where rsid is not null qualify row_number() over (partition by pid, rsid order by row_idx) = 1")
def win_01(spark, sf):
    return view(spark, sf, ROWS).where("rsid is not null").groupBy("pid", "rsid").agg(F.min(F.struct("row_idx", "genotype")).alias("w")).select("pid", "rsid", "w.*")


MATCHES = Cases("pos int, i int, exact_rsid boolean, exact_place boolean, has_rsid boolean, has_place boolean, type string", [(1, 1, True, False, True, True, "REFERENCE_CALL"), (1, 2, True, True, True, True, "REFERENCE_CALL"), (1, 3, False, True, False, True, "VARIANT_CALL"), (2, 1, False, True, False, True, "REFERENCE_CALL"), (2, 2, True, False, True, False, "REFERENCE_CALL"), (3, 1, False, False, True, False, "VARIANT_CALL"), (3, 2, False, False, True, True, "VARIANT_CALL")])


@query("win_06", f"select pos, i from {MATCHES.sql()} qualify row_number() over (partition by pos order by (type = 'VARIANT_CALL') desc, (exact_rsid and exact_place) desc, exact_rsid desc, exact_place desc, has_rsid desc, has_place desc, i) = 1")
def win_06(spark, sf):
    no = lambda c: (~c).cast("int")
    rank = F.struct(no(C("type") == "VARIANT_CALL").alias("t"), no(C("exact_rsid") & C("exact_place")).alias("a"), no(C("exact_rsid")).alias("b"), no(C("exact_place")).alias("c"), no(C("has_rsid")).alias("d"), no(C("has_place")).alias("e"), C("i"))
    return MATCHES.df(spark).groupBy("pos").agg(F.min(rank)["i"].alias("i"))


@query("win_07", "select chrom, p, list(variant_id order by variant_id) as ids, count(*) as n from (select variant_id, regexp_replace(lower(grch38_chrom), '^chr', '') as chrom, grch38_pos as p from variant_catalogue where grch38_pos is not null) group by 1, 2 having count(*) > 1")
def win_07(spark, sf):
    c = table(spark, sf, "variant_catalogue").where("grch38_pos is not null").select("variant_id", F.regexp_replace(F.lower("grch38_chrom"), "^chr", "").alias("chrom"), C("grch38_pos").alias("p"))
    return c.groupBy("chrom", "p").agg(F.array_sort(F.collect_list("variant_id")).alias("ids"), _n()).where("n > 1")


@query("srt_01", f"select vid, dense_rank() over (order by cast(chrom as int), pos, vid) as place from {_S}")
def srt_01(spark, sf):
    # places by a total order without one task for all rows: rank within a range partition plus the sizes of those before
    s = view(spark, sf, SPECS).select("vid", G.chrom_sort_key(C("chrom")).alias("ck"), "pos")
    from pyspark.sql import Window

    per = s.groupBy("ck").agg(F.count(F.lit(1)).alias("c"))
    before = per.select("ck", (F.sum("c").over(Window.orderBy("ck")) - C("c")).alias("base"))  # a row per chromosome
    inside = F.row_number().over(Window.partitionBy("ck").orderBy("pos", "vid"))
    return s.select("vid", "ck", inside.alias("k")).join(before, "ck").select("vid", (C("base") + C("k")).alias("place"))


@query("srt_06", f"select event_id, row_number() over (partition by chrom order by start, event_id) as place from {plain(READS)}")
def srt_06(spark, sf):
    from pyspark.sql import Window

    return view(spark, sf, READS).select("event_id", F.row_number().over(Window.partitionBy("chrom").orderBy("start", "event_id")).alias("place"))


@query("srt_07", f"select pid, list(x order by x)[1:5] as examples from (select pid, rsid || ':' || genotype as x from {plain(CALLS)} where chrom = 'X' and rsid is not null and genotype is not null) group by pid")
def srt_07(spark, sf):
    x = view(spark, sf, CALLS).where("chrom = 'X' and rsid is not null and genotype is not null").select("pid", F.concat_ws(":", "rsid", "genotype").alias("x"))
    from pyspark.sql import Window

    top = x.withColumn("k", F.row_number().over(Window.partitionBy("pid").orderBy("x"))).where("k <= 5")
    return top.groupBy("pid").agg(F.array_sort(F.collect_list("x")).alias("examples"))


@query("srt_05", "select row_id from thalassemia_clinvar order by row_id limit 20")
def srt_05(spark, sf):
    return table(spark, sf, "thalassemia_clinvar").select("row_id").orderBy("row_id").limit(20)


QUERIES["srt_04"], SQL["srt_04"] = agg_17, SQL["agg_17"]


@query("set_01", "select file_id, 'a' as v, count(*) as n from ancestrydna_csv_sample group by 1 union all select file_id, 'f', count(*) from familytreedna_sample group by 1")
def set_01(spark, sf):
    one = lambda t, v: table(spark, sf, t).select("file_id", F.lit(v).alias("v"))
    return one("ancestrydna_csv_sample", "a").unionByName(one("familytreedna_sample", "f")).groupBy("file_id", "v").agg(_n())


@query("set_03", "select variant_id, list_sort(list_distinct(list_concat(string_split(coalesce(aliases, ''), '|'), [coalesce(rsid, '')]))) as names from variant_catalogue")
def set_03(spark, sf):
    c = table(spark, sf, "variant_catalogue")
    return c.select("variant_id", F.array_sort(F.array_union(F.split(F.coalesce("aliases", F.lit("")), r"\|"), F.array(F.coalesce("rsid", F.lit(""))))).alias("names"))


@query("set_04", "select file_id as id, vendor, null::varchar as gene from samplesheet union all select row_id, null, gene from thalassemia_clinvar")
def set_04(spark, sf):
    a = table(spark, sf, "samplesheet").select(C("file_id").alias("id"), "vendor")
    return a.unionByName(table(spark, sf, "thalassemia_clinvar").select(C("row_id").alias("id"), "gene"), allowMissingColumns=True)


SHARDS = Cases("name string", [("cohort.chr1.bcf",), ("chrX_part2.bcf",), ("all.bcf",), ("c.chr22.dose.bcf",)])


@query("src_16", f"select name, nullif(regexp_extract(name, '(^|[._])chr([0-9]+|X|Y)', 2), '') as chrom from {SHARDS.sql()}")
def src_16(spark, sf):
    return SHARDS.df(spark).select("name", F.nullif(F.regexp_extract("name", r"(?:^|[._])chr([0-9]+|X|Y)", 1), F.lit("")).alias("chrom"))


META = Cases("f string, txt string", [("a", "# build 37.1"), ("b", "##reference=GRCh38"), ("c", "nothing"), ("d", "build 38 lifted from build 37"), ("e", "human_g1k_v37"), ("g", "##contig=<ID=chr1,length=248956422>")])


@query("ins_04", f"select f, case when regexp_matches(lower(txt), 'build 38|assembly ?38|grch38|hg38|b38|length=248956422') then 'grch38' when regexp_matches(lower(txt), 'build 37|grch37|hg19|b37|human_g1k_v37|37\\.1|length=249250621') then 'grch37' end as assembly from {META.sql()}")
def ins_04(spark, sf):
    return META.df(spark).select("f", inspect.assembly_from_text(C("txt")).alias("assembly"))


FILES = Cases("name string, header string", [("x.txt", "# This data file generated by 23andMe"), ("AncestryDNA.txt", ""), ("ftdna_1.csv", ""), ("k.csv", "# MyHeritage DNA"), ("sequencing.com.vcf", ""), ("DDNA-1.txt", ""), ("genes_for_good.txt", "# 23andme"), ("none.txt", "")])


@query("ins_03", f"select name, case when t like '%genes for good%' then 'Genes for Good' when t like '%23andme%' then '23andMe' when t like '%ancestrydna%' then 'AncestryDNA' when t like '%ftdna%' then 'FamilyTreeDNA' when t like '%ddna%' then 'Dynamic DNA' when t like '%myheritage%' then 'MyHeritage' when t like '%sequencing com%' then 'Sequencing.com' end as vendor from (select name, replace(replace(replace(lower(name || chr(10) || header), '_', ' '), '-', ' '), '.', ' ') as t from {FILES.sql()})")
def ins_03(spark, sf):
    return FILES.df(spark).select("name", inspect.vendor_of(C("name"), C("header")).alias("vendor"))


PHASES = Cases("f string, gt string", [("a", "0/1"), ("a", "0|1"), ("b", "0/0"), ("c", "1"), ("d", "1|1")])


@query("ins_05", f"select f, case when bool_or(contains(gt, '|')) then true when bool_or(contains(gt, '/')) then false end as phased from {PHASES.sql()} group by f")
def ins_05(spark, sf):
    return inspect.phasing(PHASES.df(spark), "f")


@query("ins_02")
def ins_02(spark, sf):
    """Per raw file whether at least 70 percent of its data lines have the shape of genotypes."""
    from genoquery.operators.rawlines import read_lines

    lines = read_lines({"a": table(spark, sf, "ancestrydna_csv_sample"), "f": table(spark, sf, "familytreedna_sample")})
    per = lines.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(inspect.genotype_shape(C("text")), F.lit(False))).alias("k"))
    return per.select("file_id", (C("k") * 10 >= C("n") * 7).alias("genotypes"))


KINDS = Cases("kind string, vcf boolean, source boolean", [("vcf", True, False), ("vcf", False, False), ("bcf", False, False), ("bam", False, True), ("text", False, True), ("text", False, False), ("unknown", False, False)])


@query("ins_06", f"select kind, vcf, source, case when (kind = 'vcf' and vcf) or kind in ('bcf', 'bam', 'cram', 'fasta') then 'authoritative' when kind = 'vcf' or (kind = 'text' and source) then 'strong' when kind = 'text' then 'weak' else 'unknown' end as confidence, case when kind = 'bcf' then 'grch38' end as assembly from {KINDS.sql()}")
def ins_06(spark, sf):
    k = C("kind")
    conf = F.when((k == "vcf") & C("vcf"), "authoritative").when(k.isin("bcf", "bam", "cram", "fasta"), "authoritative").when(k == "vcf", "strong").when(k == "text", F.when(C("source"), "strong").otherwise("weak")).otherwise("unknown")
    return KINDS.df(spark).select("kind", "vcf", "source", conf.alias("confidence"), F.when(k == "bcf", "grch38").alias("assembly"))


QUERIES["ins_07"], SQL["ins_07"] = ins_06, SQL["ins_06"]

_CAT = "(select variant_id, lower(trim(rsid)) as rsid, regexp_replace(lower(grch38_chrom), '^chr', '') as chrom, grch38_pos as pos from variant_catalogue)"
_OBS = f"(select record_id as row_idx, pid, rsid, lower(chrom) as chrom, pos, display as genotype from {plain(CALLS)})"
FLAGSHIP_SQL = f"""select pid, vid, row_idx, prio, genotype from (select *, row_number() over (partition by pid, vid order by row_idx, prio, genotype) as k from (
    select o.pid, c.variant_id as vid, o.row_idx, 0 as prio, o.genotype from {_OBS} o join {_CAT} c on o.rsid = c.rsid where o.genotype is not null
    union all select o.pid, c.variant_id, o.row_idx, 1, o.genotype from {_OBS} o join {_CAT} c on o.chrom = c.chrom and o.pos = c.pos where o.genotype is not null)) where k = 1"""


@query("flagship", FLAGSHIP_SQL)
def flagship(spark, sf):
    """Every catalogue entry looked up in all observations, by name or place: the first row per participant and entry."""
    o = view(spark, sf, CALLS).select(C("record_id").alias("row_idx"), "pid", "rsid", F.lower("chrom").alias("chrom"), "pos", C("display").alias("genotype"))
    c = table(spark, sf, "variant_catalogue").select(C("variant_id").alias("vid"), F.lower(F.trim("rsid")).alias("rsid"), F.regexp_replace(F.lower("grch38_chrom"), "^chr", "").alias("chrom"), C("grch38_pos").alias("pos"))
    return lookup.winners(lookup.by_name(o, c.select("vid", "rsid")), lookup.by_place(o, c), keep=("genotype",))


flatten(QUERIES, SQL, {"win_07": ["ids"], "set_03": ["names"], "srt_07": ["examples"], "agg_03": ["lengths"]})


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
