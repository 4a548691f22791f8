"""Genotype text, chromosome names and variant calls as column expressions.

Every function takes columns and gives a column; a null input gives null unless
the docstring says otherwise. Chromosome names are cleaned differently in
different places, so each use has its own helper.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that mean no call, and the sorting ranks of alleles.
NO_CALL_WORDS = ["", "NA", "N/A", "#N/A", "NONE"]
ALLELE_RANK = "ACGTID"
HOM_ALT, HOM_REF = 0.8, 0.2


def _letters(text: Column) -> Column:
    """The ASCII letters of a text, one per element."""
    return F.regexp_extract_all(text, F.lit("([A-Za-z])"), F.lit(1))


def join(parts: Column, sep: str = "") -> Column:
    return F.array_join(parts, sep)


# --- normalisation


def normalize_genotype(g: Column) -> Column:
    """Upper case sorted alleles; no-call words give ``--``; an empty or ``-`` side of a slash gives ``ID``."""
    c = F.upper(F.replace(F.trim(g), F.lit(" "), F.lit("")))
    parts = F.split(c, "[/|]", -1)
    return (
        F.when(c.isin(NO_CALL_WORDS), "--").when(c.rlike("[/|]") & F.exists(parts, lambda p: p.isin("", "-")), "ID")
        .when(c.rlike("[/|]"), join(F.array_sort(parts))).otherwise(join(F.array_sort(F.split(c, ""))))
    )


def is_symbolic(alt: Column) -> Column:
    t = F.trim(alt)
    return t.startswith("<") & t.endswith(">")


def alt_token(ref: Column, alt: Column) -> Column:
    """``D`` for a shorter, ``I`` for a longer alternate, else its bases; ``--`` where it is symbolic."""
    return F.when(is_symbolic(alt), "--").when(F.length(alt) < F.length(ref), "D").when(F.length(alt) > F.length(ref), "I").otherwise(F.upper(F.trim(alt)))


def ref_token(ref: Column, alts: Column) -> Column:
    """``I`` if all sized alternates that differ are shorter, ``D`` if longer, else the reference's bases."""
    real = F.filter(alts, lambda a: ~is_symbolic(a))
    shorter, longer = F.exists(real, lambda a: F.length(a) < F.length(ref)), F.exists(real, lambda a: F.length(a) > F.length(ref))
    return F.when(shorter & ~longer, "I").when(longer & ~shorter, "D").otherwise(F.upper(F.trim(ref)))


def genotype_from_gt(gt: Column, ref: Column, alts: Column) -> Column:
    """The genotype text of a VCF call. An allele number beyond the alternates gives null; unknown forms give ``--``.

    I and D stand for alleles only where no allele is the reference.
    """
    t = F.replace(F.trim(gt), F.lit("|"), F.lit("/"))
    idx = F.transform(F.split(t, "/", -1), lambda p: p.try_cast("int"))
    known = t.rlike(r"^\+?\d+(?:/\+?\d+)?$")
    beyond = F.exists(idx, lambda i: i > F.size(alts))
    pick = lambda i: F.try_element_at(alts, F.greatest(i, F.lit(1)))
    symbolic = F.exists(idx, lambda i: (i > 0) & is_symbolic(pick(i)))
    only_alt = F.forall(idx, lambda i: i > 0)
    tokens = F.transform(idx, lambda i: F.when(i == 0, F.upper(F.trim(ref))).when(only_alt, alt_token(ref, pick(i))).otherwise(F.upper(F.trim(pick(i)))))
    short = F.forall(tokens, lambda x: F.length(x) == 1)
    # the first allele that is beyond or symbolic decides
    first = F.element_at(idx, 1)
    first_bad = F.when(first > F.size(alts), "beyond").when((first > 0) & is_symbolic(pick(first)), "symbolic")
    return (
        F.when(~known, "--").when(first_bad == "beyond", None).when(first_bad == "symbolic", "--").when(beyond, None).when(symbolic, "--")
        .when(short, normalize_genotype(join(tokens))).otherwise(join(tokens, "/"))
    )


def chrom_match_key(c: Column) -> Column:
    """For locus lookup: leading ``chr`` off, lower case."""
    return F.lower(F.regexp_replace(F.trim(c), "^(?:chr)+", ""))


def chrom_sort_key(c: Column) -> Column:
    """Three digits; X is 023, Y 024, M 025; anything else ``999-`` and its name. One leading ``chr`` is dropped."""
    t = F.regexp_replace(F.trim(c), "^chr", "")
    u = F.upper(t)
    number = t.try_cast("bigint")
    return F.when(t.rlike(r"^\+?\d{1,9}$"), F.when(F.length(number.cast("string")) >= 3, number.cast("string")).otherwise(F.lpad(number.cast("string"), 3, "0"))).when(u == "X", "023").when(u == "Y", "024").when(u.isin("M", "MT"), "025").otherwise(F.concat(F.lit("999-"), u))


def chrom_for_sex(c: Column) -> Column:
    """For sex statistics: ``chr`` / ``CHR`` off, upper case, 23 to 26 as X, Y, XY, MT."""
    u = F.upper(F.regexp_replace(F.regexp_replace(F.trim(c), "^(?:chr)+", ""), "^(?:CHR)+", ""))
    return F.when(u == "23", "X").when(u == "24", "Y").when(u == "25", "XY").when(u.isin("26", "M"), "MT").otherwise(u)


def chrom_for_anchor(c: Column) -> Column:
    """For anchor votes: one ``chr`` or ``CHR`` off, upper case, 23 to 26 as X, Y, XY, MT."""
    u = F.upper(F.regexp_replace(F.trim(c), "^(?:chr|CHR)", ""))
    return F.when(u == "23", "X").when(u == "24", "Y").when(u == "25", "XY").when(u.isin("26", "M"), "MT").otherwise(u)


def chrom_is_sex(c: Column) -> Column:
    return F.upper(F.regexp_replace(F.regexp_replace(F.trim(c), "^(?:chr)+", ""), "^(?:CHR)+", "")).isin("X", "Y", "23", "24")


def evidence_line(line: Column) -> Column:
    """A raw line for evidence: trailing newlines off, tabs as two blanks, other control characters as one."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(line, "[\r\n]+$", ""), "\t", "  "), r"\p{Cntrl}", " ")


def complement_genotype(g: Column) -> Column:
    """Bases complemented in place, not reversed."""
    return F.translate(g, "ACGTacgt", "TGCAtgca")


def column_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), "[ _-]", "")


def inline_comment(v: Column) -> Column:
    """The value before ``#``, else before ``//``, trimmed."""
    return F.trim(F.when(F.instr(v, "#") > 0, F.substring_index(v, "#", 1)).otherwise(F.substring_index(v, "//", 1)))


def strip_bom(v: Column) -> Column:
    return F.regexp_replace(v, "^﻿", "")


def probe_rsid(name: Column) -> Column:
    """The first rs number inside a probe name, or null."""
    return F.when(name.rlike(r"(?i)rs\d"), F.concat(F.lit("rs"), F.regexp_extract(name, r"(?i)rs(\d+)", 1)))


def participant_from_file(name: Column) -> Column:
    """The file name without the known endings, each taken off as often as it occurs, in this order."""
    out = name
    # Endings in the order in which they are taken off.
    for end in (".txt.zip", ".csv.zip", ".vcf.gz", ".cram", ".zip", ".txt", ".csv"):
        out = F.regexp_replace(out, "(?:" + end.replace(".", r"\.") + ")+$", "")
    return out


# --- calls


def _rank(a: Column) -> Column:
    at = F.call_function("instr", F.lit(ALLELE_RANK), F.upper(F.substring(a, 1, 1)))
    return F.when(at > 0, at).otherwise(F.lit(99))


def _het(a: Column, b: Column) -> Column:
    return F.upper(F.when(_rank(b) < _rank(a), F.concat(b, a)).otherwise(F.concat(a, b)))


def call_snp(ref: Column, alt: Column, ref_count: Column, alt_count: Column, depth: Column) -> Column:
    """hom alt from 0.8 of the depth, hom ref up to 0.2, else het; null without depth or without reads of either allele."""
    f = alt_count / F.nullif(depth, F.lit(0))
    return F.when((depth == 0) | (ref_count + alt_count == 0), None).when(f >= HOM_ALT, F.concat(alt, alt)).when(f <= HOM_REF, F.concat(ref, ref)).otherwise(_het(ref, alt))


def call_copies(ref: Column, alt: Column, alt_count: Column, depth: Column) -> Column:
    """As ``call_snp`` for tokens; depth without reads of the alternate is hom ref."""
    f = alt_count / F.nullif(depth, F.lit(0))
    return F.when(depth == 0, None).when(f >= HOM_ALT, F.concat(alt, alt)).when(f <= HOM_REF, F.concat(ref, ref)).otherwise(_het(ref, alt))


def decision_snp(ref: Column, alt: Column, rc: Column, ac: Column, depth: Column) -> Column:
    f = F.format_string("%.3f", ac / F.nullif(depth, F.lit(0)))
    n = lambda c: c.cast("string")
    counts = F.concat(F.lit("counts ref="), n(rc), F.lit(" alt="), n(ac), F.lit(" depth="), n(depth), F.lit(" for "), ref, F.lit(">"), alt)
    return (
        F.when(depth == 0, F.concat(F.lit("no covering reads for SNP; genotype unresolved (ref="), ref, F.lit(", alt="), alt, F.lit(")")))
        .when(rc + ac == 0, F.concat(F.lit("no reads matched the declared SNP alleles; genotype unresolved; "), counts))
        .otherwise(F.concat(F.lit("SNP genotype rule: alt_fraction="), f, F.lit(" with thresholds ref<=0.200, het=(0.200,0.800), alt>=0.800; "), counts))
    )


def observed_alternate(preferred: Column, ref: Column, observed: Column, filtered: Column, raw: Column) -> Column:
    """The alternate with most filtered, then raw reads, then the preferred one, then the last letter."""
    up = F.upper(preferred)
    letters = F.array_union(F.array(up), F.filter(F.transform(observed, lambda a: F.upper(F.substring(F.trim(a), 1, 1))), lambda a: (a != "") & (a != F.upper(ref))))
    count = lambda m, a: F.coalesce(F.try_element_at(m, a), F.lit(0))
    return F.array_max(F.transform(letters, lambda a: F.struct(count(filtered, a).alias("f"), count(raw, a).alias("r"), (a == up).cast("int").alias("p"), a.alias("a"))))["a"]


def display_from_counts(counts: Column) -> Column:
    """Two letters from a map of base counts: the top base twice from 80 percent on, else the top two; null without reads."""
    items = F.filter(F.map_entries(counts), lambda e: F.upper(F.substring(e["key"], 1, 1)).isin("A", "C", "G", "T") & (e["value"] > 0))
    ranked = F.array_sort(F.transform(items, lambda e: F.struct((-e["value"]).alias("n"), F.upper(F.substring(e["key"], 1, 1)).alias("b"))))
    total = F.aggregate(ranked, F.lit(0).cast("long"), lambda s, e: s - e["n"])
    top, second = F.try_element_at(ranked, F.lit(1)), F.try_element_at(ranked, F.lit(2))
    return F.when(F.size(ranked) == 0, None).when((F.size(ranked) == 1) | (-top["n"] * 10 >= total * 8), F.concat(top["b"], top["b"])).otherwise(F.concat(top["b"], second["b"]))


def _plain(seq: Column) -> Column:
    return F.upper(F.regexp_replace(seq, r"[/| .\-]", ""))


def is_indel_display(display: Column, ref: Column, alt: Column, kind: Column) -> Column:
    """Whether I and D tokens stand for the alleles; a display without letters passes."""
    sized = F.when(kind == "deletion", F.length(ref) > 1).when(kind == "insertion", F.length(alt) > F.length(ref)).otherwise(F.lit(False))
    return F.coalesce(sized, F.lit(False)) & ~display.rlike("[A-CE-HJ-Za-ce-hj-z]")


def app_genotype(display: Column, ref: Column, alt: Column, kind: Column, chrom: Column, male: Column) -> Column:
    """``genotype`` and ``zygosity`` of a display. ``male``: sex is male with high or medium confidence. Empty is ``./.``."""
    token = is_indel_display(display, ref, alt, kind)
    r = F.when(token, F.when(kind == "deletion", "I").otherwise("D")).otherwise(ref)
    a = F.when(token, F.when(kind == "deletion", "D").otherwise("I")).otherwise(alt)
    long_ = (r != "") & (a != "") & ~((F.length(r) == 1) & (F.length(a) == 1))
    d, lr, la = _plain(display), _plain(r), _plain(a)
    letters = _letters(display)
    n = F.size(letters)
    l1, l2 = F.try_element_at(letters, F.lit(1)), F.try_element_at(letters, F.lit(2))
    out = lambda g, z: F.struct((F.lit(g) if isinstance(g, str) else g).alias("genotype"), F.lit(z).alias("zygosity"))
    unknown = out(display, "unknown")
    hem = F.when(l1 == r, out("0", "hem_ref")).when(l1 == a, out("1", "hem_alt")).otherwise(unknown)
    refs, alts = (l1 == r).cast("int") + (l2 == r).cast("int"), (l1 == a).cast("int") + (l2 == a).cast("int")
    return (
        F.when(display == "", out("./.", "unknown")).when(long_ & (d == F.concat(lr, lr)), out("0/0", "hom_ref")).when(long_ & (d == F.concat(la, la)), out("1/1", "hom_alt"))
        .when(long_ & ((d == F.concat(lr, la)) | (d == F.concat(la, lr))), out("0/1", "het")).when((F.length(r) != 1) | (F.length(a) != 1), unknown)
        .when((n == 1) & chrom_is_sex(chrom), hem).when(n != 2, unknown).when(chrom_is_sex(chrom) & male & (l1 == l2), hem)
        .when((refs == 2) & (alts == 0), out("0/0", "hom_ref")).when((refs == 1) & (alts == 1), out("0/1", "het")).when((refs == 0) & (alts == 2), out("1/1", "hom_alt")).otherwise(unknown)
    )


def deletion_display(kind: Column, backend: Column, ref: Column, alt_count: Column, depth: Column) -> Column:
    """DD, II or DI for deletions read from alignments; null elsewhere and without depth."""
    f = F.coalesce(alt_count, F.lit(0)) / F.nullif(depth, F.lit(0))
    fits = (kind == "deletion") & backend.isin("cram", "bam") & (F.length(ref) > 1) & (depth > 0)
    return F.when(F.coalesce(fits, F.lit(False)), F.when(f >= HOM_ALT, "DD").when(f <= HOM_REF, "II").otherwise("DI"))


def hemizygous_display(display: Column) -> Column:
    first = F.regexp_extract(display, "[A-Za-z]", 0)
    return F.when(first == "", display).otherwise(first)


def non_reportable(display: Column, ref: Column, alt: Column, observed: Column) -> Column:
    """``observed_alt`` or ``unknown_alt`` where the display has letters of neither allele, else null."""
    letters = F.filter(F.transform(_letters(display), lambda c: F.upper(c)), lambda c: (c != F.upper(ref)) & (c != F.upper(alt)))
    singles = F.filter(F.transform(observed, lambda a: F.upper(a)), lambda a: F.length(a) == 1)
    return F.when((display == "") | (F.length(ref) != 1) | (F.length(alt) != 1) | (F.size(letters) == 0), None).when(F.forall(letters, lambda c: F.array_contains(singles, c)), "observed_alt").otherwise("unknown_alt")


def reportable_alt(display: Column, ref: Column, alt: Column, observed: Column) -> Column:
    """Another known alternate that the display shows, where it shows neither this one; else this one."""
    letters = F.transform(_letters(display), lambda c: F.upper(c))
    fits = (display != "") & (F.length(ref) == 1) & (F.length(alt) == 1) & (F.size(letters) > 0) & ~F.array_contains(letters, F.upper(alt))
    other = F.try_element_at(F.filter(observed, lambda a: (F.length(a) == 1) & (F.upper(a) != F.upper(ref)) & F.array_contains(letters, F.upper(a))), F.lit(1))
    return F.when(fits, F.coalesce(other, alt)).otherwise(alt)


def call_values(depth: Column, status: Column, genotype: Column, zygosity: Column, display: Column) -> Column:
    """``outcome``, ``call_status`` and ``reported`` display, in the order of precedence: no depth, other alternates, no call, then zygosity."""
    outcome = (
        F.when(depth == 0, "not_covered").when(status.isNotNull(), status).when(genotype == "./.", "no_call").when(zygosity.isin("hom_ref", "hem_ref"), "reference")
        .when(zygosity.isin("het", "hom_alt", "hem_alt"), "variant").otherwise("unknown")
    )
    state = F.when(outcome.isin("observed_alt", "unknown_alt"), outcome).when(genotype == "./.", "no_call").otherwise("called")
    shown = F.when(zygosity.isin("hem_ref", "hem_alt"), hemizygous_display(display)).when((display == "") & outcome.isin("no_call", "not_covered"), "??").otherwise(display)
    return F.struct(outcome.alias("outcome"), state.alias("call_status"), shown.alias("reported"))


def weak_indel(kind: Column, backend: Column, ref: Column, display: Column) -> Column:
    """Whether a deletion from text was matched on I and D alone; no letters at all pass."""
    return F.coalesce((kind == "deletion") & backend.isin("text", "zip") & (F.length(ref) > 1) & ~display.rlike("[A-CE-HJ-Za-ce-hj-z]"), F.lit(False))


def facets(status: Column, observed: Column) -> Column:
    return F.when(status.isNotNull(), F.when((status == "observed_alt") & (F.size(observed) > 0), F.concat(status, F.lit(";known_observed_alts="), join(observed, ","))).otherwise(status))


def allele_balance(alt_count: Column, depth: Column) -> Column:
    return F.when(depth > 0, alt_count / depth)


def imputed_reference(kind: Column, ref: Column, alt: Column, chrom: Column, male: Column) -> Column:
    """The genotype of a variant absent from a variants-only file: reference, single on a man's X and Y; null where it cannot be told."""
    base = F.upper(ref)
    single = F.when(male & chrom_is_sex(chrom), base).otherwise(F.concat(base, base))
    tok = ref_token(ref, F.array(alt))
    k = F.coalesce(kind, F.lit("snp"))
    return F.when((k == "snp") & (F.length(ref) == 1) & (F.length(alt) == 1), single).when(k == "deletion", "II").when(k.isin("insertion", "indel") & ref.isNotNull() & alt.isNotNull(), F.concat(tok, tok))


def indel_genotype(genotype: Column, kind: Column, ref: Column, alts: Column) -> Column:
    """A slashed indel genotype as I and D tokens where every side is a known allele of one letter's token; else as it is."""
    parts = F.split(genotype, "/", -1)
    token = lambda p: F.when(F.upper(p) == F.upper(ref), ref_token(ref, alts)).when(F.exists(alts, lambda a: F.upper(a) == F.upper(p)), alt_token(ref, F.try_element_at(F.filter(alts, lambda a: F.upper(a) == F.upper(p)), F.lit(1))))
    tokens = F.transform(parts, token)
    fits = kind.isin("deletion", "insertion", "indel") & (F.size(parts) > 1) & F.forall(tokens, lambda t: F.coalesce(F.length(t) == 1, F.lit(False)))
    return F.when(F.coalesce(fits, F.lit(False)), normalize_genotype(join(tokens))).otherwise(genotype)


# --- findings


def dosage(allele: Column, ref: Column, alt: Column, zygosity: Column, display: Column) -> Column:
    """Copies of an allele by zygosity, else by the letters of the display; null where it cannot be told."""
    of_ref = F.when(zygosity == "hom_ref", 2).when(zygosity.isin("hem_ref", "het"), 1).when(zygosity.isin("hom_alt", "hem_alt"), 0)
    of_alt = F.when(zygosity.isin("hom_ref", "hem_ref"), 0).when(zygosity.isin("het", "hem_alt"), 1).when(zygosity == "hom_alt", 2)
    u = F.upper(display)
    return F.when(allele == "", None).when(allele == ref, of_ref).when(allele == alt, of_alt).when(F.length(allele) == 1, F.length(u) - F.length(F.replace(u, F.upper(allele), F.lit(""))))


def chromosome_count(zygosity: Column) -> Column:
    return F.when(zygosity.isin("hem_ref", "hem_alt"), 1).when(zygosity.isin("hom_ref", "het", "hom_alt"), 2)


# --- allele sets of the older matcher


def variant_type(ref: Column, alt: Column) -> Column:
    """SNV, INSERTION and DELETION against a single base; of longer alleles, equal lengths are INDEL and unequal ones MNV."""
    r, a = F.length(ref), F.length(alt)
    return F.when((r == 1) & (a == 1), "SNV").when((r == 1) & (a > 1), "INSERTION").when((r > 1) & (a == 1), "DELETION").when(r == a, "INDEL").otherwise("MNV")


def match_snv(a1: Column, a2: Column, refs: Column, alts: Column) -> Column:
    """REFERENCE_CALL for twice the same reference base, VARIANT_CALL where either is an alternate, else NO_CALL."""
    return F.when((a1 == a2) & F.array_contains(refs, a1), "REFERENCE_CALL").when(F.array_contains(alts, a1) | F.array_contains(alts, a2), "VARIANT_CALL").otherwise("NO_CALL")


def match_indel(a1: Column, a2: Column, kind: Column) -> Column:
    """By the tokens I and D: the token of the change is a variant, the other one the reference."""
    change, other = F.when(kind == "INSERTION", "I").otherwise("D"), F.when(kind == "INSERTION", "D").otherwise("I")
    return F.when((a1 == change) | (a2 == change), "VARIANT_CALL").when((a1 == other) | (a2 == other), "REFERENCE_CALL").otherwise("NO_CALL")


def match_complex(a1: Column, a2: Column, ref: Column, alt: Column) -> Column:
    """By letters: all in the alternate and none in the reference is a variant, the opposite the reference, else no call."""
    bases = F.filter(F.array(a1, a2), lambda x: x.isin("A", "C", "G", "T"))
    in_ref, in_alt = (lambda x: F.contains(ref, x)), (lambda x: F.contains(alt, x))
    some = F.size(bases) > 0
    return F.when(some & F.forall(bases, in_alt) & ~F.exists(bases, in_ref), "VARIANT_CALL").when(some & F.forall(bases, in_ref) & ~F.exists(bases, in_alt), "REFERENCE_CALL").otherwise("NO_CALL")


def genotype_from_hds(hds: Column, ref: Column, alt: Column) -> Column:
    """The genotype of haplotype dosages: the alternate from one half on; a lone haplotype is completed by the reference.

    Null without dosages or alternate.
    """
    picked = F.transform(hds, lambda x: F.when(x >= 0.5, alt).otherwise(ref))
    both = F.when(F.size(picked) == 1, F.concat(picked, F.array(ref))).otherwise(picked)
    long_ = F.exists(both, lambda a: F.length(a) > 1)
    return F.when((F.size(picked) <= 0) | alt.isNull(), None).when(long_, F.array_join(both, "/")).otherwise(normalize_genotype(F.array_join(both, "/")))
