"""Genotype text as lines: delimited exports, final reports, VCF, FASTA, chains, tables.

Every reader takes a DataFrame of lines (``file``, ``line_no``, ``line``), so one
plan reads any number of files. A file's header is found by an aggregate over its
lines and joined back; nothing is looped over on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genoquery.functions import genotype as G
from genoquery.operators.packed import masked, restore
from genoquery.operators.skew import measured_join
from genoquery.session import durable

# Names of the columns in exports, compared in lower case without blanks, "_" and "-".
ALIASES = {
    "rsid": ["rsid", "name", "snp", "marker", "id", "snpid"],
    "chrom": ["chromosome", "chr", "chrom"],
    "position": ["position", "pos", "coordinate", "basepairposition", "basepair"],
    "genotype": ["genotype", "gt", "result", "results", "result1", "call", "calls", "yourcode", "code", "genotypevalue", "variation"],
    "allele1": ["allele1", "allelea", "allele1top"],
    "allele2": ["allele2", "alleleb", "allele2top"],
}
DEFAULT = ["rsid", "chromosome", "position", "genotype"]


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``file, line_no, line`` of text files; gzip is read as it is.

    ``line_no`` rises along a file and is not consecutive: the block of the file in its upper bits, the line within the task in
    the lower ones. Blocks of a file are at least 64 KB apart, so it does not matter which task reads which block.
    """
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), place_in_file(F.col("_metadata.file_block_start")).alias("line_no"), F.col("value").alias("line"))


def place_in_file(block_start: Column) -> Column:
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return F.shiftleft(F.floor(block_start / 65_536), 33) + within


def fastq_records(lines: DataFrame) -> DataFrame:
    """``file, records``: every fourth line begins a record, so a cut last record counts. A file without lines has no row."""
    return lines.groupBy("file").agg(F.ceil(F.count(F.lit(1)) / 4).alias("records"))


def delimiter(first: Column) -> Column:
    """The delimiter of a file by its first data line: tab, else comma, else blanks, else tab."""
    return F.when(F.contains(first, F.lit("\t")), "tab").when(F.contains(first, F.lit(",")), "comma").when(F.trim(first).rlike(r"\s"), "space").otherwise("tab")


def split_quoted(line: Column) -> Column:
    """Comma separated fields; a quote toggles and is dropped, a doubled quote is no escape, an open one runs to the end."""
    return masked(line, '"[^"]*(?:"|$)', lambda m, spans: F.transform(F.split(m, ",", -1), lambda p: F.trim(F.replace(restore(p, spans), F.lit('"'), F.lit("")))))


def split_by(line: Column, kind: Column) -> Column:
    tab = F.transform(F.split(line, "\t", -1), lambda x: F.trim(x))
    return F.when(kind == "tab", tab).when(kind == "comma", split_quoted(line)).otherwise(F.split(F.trim(line), r"\s+"))


def _index(names: Column, role: str) -> Column:
    """The first column whose name is any alias of a role, from 1, or null."""
    hits = F.filter(F.transform(names, lambda n, i: F.when(n.isin(ALIASES[role]), i + 1)), lambda i: i.isNotNull())
    return F.array_min(hits)


def delimited(lines: DataFrame, alphabetical: bool = False) -> DataFrame:
    """Genotype rows of delimited files: ``file, line_no, rsid, chrom, position, genotype, evidence``.

    The header is the first data line if its first field names the rsid, else the last comment before the first data line
    that does, else the usual four columns. ``alphabetical`` takes the first non-empty alias of a role in alphabetical order
    instead of the first such column. Rows with neither a name nor a place are left out, as are blank lines and comments.
    """
    text = F.regexp_replace(F.trim("line"), "^﻿", "")
    is_comment = text.startswith("#") | text.startswith("//")
    x = lines.where(F.trim("line") != "").select("file", "line_no", "line", text.alias("text"), is_comment.alias("comment"))
    data = F.when(~F.col("comment"), F.struct("line_no", "text"))
    first = x.groupBy("file").agg(F.min(data).alias("first"))
    # a row per file, written so that its size is known and the lines are not read for it again
    kind = durable(first.select("file", F.col("first.line_no").alias("first_no"), F.col("first.text").alias("first_text"), delimiter(F.col("first.text")).alias("kind")))
    comments = measured_join(x.where("comment"), kind, ["file"], ["line_no"]).where(F.col("first_no").isNull() | (F.col("line_no") < F.col("first_no")))
    heads = comments.withColumn("fields", split_by(F.trim(F.regexp_replace("text", "^(?:#+|(?://)+)", "")), F.col("kind")))
    named = lambda f: G.column_name(F.get(f, F.lit(0))).isin(ALIASES["rsid"])
    above = heads.where(named(F.col("fields"))).groupBy("file").agg(F.max_by("fields", "line_no").alias("above"))
    files = kind.join(above, "file", "left").withColumn("own", split_by(F.col("first_text"), F.col("kind")))
    has_head = named(F.col("own"))
    names = F.transform(F.when(has_head, F.col("own")).when(F.col("above").isNotNull(), F.col("above")).otherwise(F.array(*map(F.lit, DEFAULT))), lambda n: G.column_name(n))
    files = files.select("file", "kind", names.alias("names"), F.when(has_head, F.col("first_no")).alias("head_no"))
    files = durable(files.select("*", *[_index(F.col("names"), r).alias(f"i_{r}") for r in ALIASES]))
    rows = measured_join(x.where("not comment"), files, ["file"], ["line_no"]).where(F.col("head_no").isNull() | (F.col("line_no") != F.col("head_no")))
    rows = rows.withColumn("f", F.transform(split_by(F.regexp_replace("line", "^﻿", ""), F.col("kind")), lambda v: G.inline_comment(v)))

    def value(role: str) -> Column:
        if not alphabetical:
            return F.try_element_at("f", F.col(f"i_{role}"))
        pairs = F.arrays_zip(F.col("names"), F.col("f"))
        of = lambda a: F.try_element_at(F.filter(pairs, lambda z: (z["names"] == a) & (z["f"] != "")), F.lit(-1))["f"]
        return F.coalesce(*[of(a) for a in sorted(ALIASES[role])])

    empty = lambda c: F.nullif(c, F.lit(""))
    blank = lambda c: F.coalesce(c, F.lit(""))
    pair = F.concat(blank(value("allele1")), blank(value("allele2")))
    geno = F.coalesce(value("genotype"), pair) if alphabetical else F.when(F.col("i_genotype").isNotNull(), blank(value("genotype"))).otherwise(pair)
    out = rows.select("file", "line_no", empty(value("rsid")).alias("rsid"), empty(value("chrom")).alias("chrom"), value("position").try_cast("long").alias("position"), G.normalize_genotype(geno).alias("genotype"), G.evidence_line(F.col("line")).alias("evidence"))
    return out.where(F.col("rsid").isNotNull() | (F.col("chrom").isNotNull() & F.col("position").isNotNull()))


def final_report(lines: DataFrame) -> DataFrame:
    """Rows of array final reports: plus-strand alleles after ``[Data]``; unplaced markers (chromosome or position 0) are left out.

    A report without one of its five columns gives no rows.
    """
    low = F.lower(F.trim("line"))
    marks = durable(lines.groupBy("file").agg(F.min(F.when(low == "[data]", F.col("line_no"))).alias("data_no")))
    body = measured_join(lines.where(F.trim("line") != ""), marks, ["file"], ["line_no"]).where(F.col("line_no") > F.col("data_no")).withColumn("f", F.transform(F.split(F.regexp_replace("line", "[\r\n]+$", ""), "\t", -1), lambda v: F.trim(v)))
    head = body.groupBy("file").agg(F.min(F.struct("line_no", "f")).alias("h"))
    names = F.transform(F.col("h.f"), lambda n: G.column_name(n))
    at = lambda *n: F.coalesce(*[F.nullif(F.array_position(names, x).cast("int"), F.lit(0)) for x in n])
    cols = head.select("file", F.col("h.line_no").alias("head_no"), at("snpname").alias("a"), at("chr", "chromosome", "chrom").alias("b"), at("position", "pos").alias("c"), at("allele1plus").alias("d"), at("allele2plus").alias("e")).dropna()
    cols = durable(cols)
    rows = measured_join(body, cols, ["file"], ["line_no"]).where(F.col("line_no") != F.col("head_no"))
    get = lambda i: F.coalesce(F.try_element_at("f", F.col(i)), F.lit(""))
    none = get("d").isin("-", "") & get("e").isin("-", "")
    out = rows.select("file", "line_no", G.probe_rsid(get("a")).alias("rsid"), get("b").alias("chrom"), get("c").try_cast("long").alias("position"), F.when(none, "--").otherwise(G.normalize_genotype(F.concat(get("d"), get("e")))).alias("genotype"))
    return out.where(~F.col("chrom").isin("", "0") & (F.col("position") != 0))


def vcf(lines: DataFrame) -> DataFrame:
    """VCF records: ``file, line_no, rsid, chrom, position, ref, alts, genotype`` of the first sample.

    Comments, short records, records without reference or alternates are left out; a position that is no number is an error.
    """
    t = F.trim("line")
    f = lines.where((t != "") & ~t.startswith("#")).withColumn("f", F.split(t, "\t", -1)).where(F.size("f") >= 10)
    g = lambda i: F.trim(F.get("f", F.lit(i)))
    alts = F.filter(F.transform(F.split(g(4), ",", -1), lambda a: F.trim(a)), lambda a: ~a.isin("", "."))
    pos = g(1).try_cast("long")
    where = F.array_position(F.transform(F.split(g(8), ":", -1), lambda x: F.upper(x)), "GT").cast("int")
    gt = F.when(where > 0, F.coalesce(F.try_element_at(F.split(g(9), ":", -1), where), F.lit(".")))
    out = f.select("file", "line_no", F.when(~g(2).isin("", "."), g(2)).alias("rsid"), g(0).alias("chrom"), F.when(pos.isNull(), F.raise_error(F.concat(F.lit("VCF position is no number: "), g(1))).cast("long")).otherwise(pos).alias("position"), g(3).alias("ref"), alts.alias("alts"), gt.alias("gt"))
    out = out.where(~F.col("ref").isin("", ".") & (F.size("alts") > 0))
    return out.select("file", "line_no", "rsid", "chrom", "position", "ref", "alts", F.coalesce(F.when(F.col("gt").isNotNull(), G.genotype_from_gt(F.col("gt"), F.col("ref"), F.col("alts"))), F.lit("--")).alias("genotype"))


def fasta(lines: DataFrame) -> DataFrame:
    """``file, contig, sequence``. A contig's lines are joined in one row, so this is for references of known contigs, not for reads."""
    from pyspark.sql import Window

    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    x = lines.withColumn("head", F.when(F.col("line").startswith(">"), F.regexp_extract("line", r"^>\s*(\S+)", 1))).withColumn("contig", F.last("head", ignorenulls=True).over(w))
    body = x.where(F.col("head").isNull() & F.col("contig").isNotNull())
    return body.groupBy("file", "contig").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.trim("line").alias("s")))), lambda z: z["s"]), "").alias("sequence"))


def slice_sequence(sequence: Column, start: Column, stop: Column) -> Column:
    """Bases start..stop, 0-based and half-open; a stretch outside the sequence is an error."""
    bad = (stop < start) | (start < 0) | (stop > F.length(sequence))
    return F.when(bad, F.raise_error(F.lit("slice is out of bounds")).cast("string")).otherwise(F.substring(sequence, start + 1, stop - start))


def chain_blocks(lines: DataFrame, primary: list[str] | None = None) -> DataFrame:
    """Blocks of chain files: ``file, idx, chrom, start, stop, to_chrom, to_start, to_size, strand, score``; chains off the primary chromosomes are left out."""
    from pyspark.sql import Window

    w = Window.partitionBy("file").orderBy("line_no")
    t = F.split(F.trim("line"), r"\s+")
    x = lines.where(F.trim("line") != "").withColumn("t", t).withColumn("head", F.when(F.get("t", F.lit(0)) == "chain", F.col("t"))).withColumn("h", F.last("head", ignorenulls=True).over(w)).withColumn("chain", F.count("head").over(w))
    b = x.where(F.col("head").isNull() & F.col("h").isNotNull())
    n = lambda i: F.coalesce(F.get("t", F.lit(i)).try_cast("long"), F.lit(0))
    before = Window.partitionBy("file", "chain").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    z = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    h = lambda i: F.get("h", F.lit(i))
    clean = lambda c: F.when(F.regexp_replace(c, "^chr", "") == "M", "MT").otherwise(F.regexp_replace(c, "^chr", ""))
    out = b.select("file", (F.col("chain") - 1).cast("int").alias("idx"), clean(h(2)).alias("chrom"), (h(5).cast("long") + z(n(0) + n(1))).alias("start"), n(0).alias("size"), clean(h(7)).alias("to_chrom"), (h(10).cast("long") + z(n(0) + n(2))).alias("to_start"), h(8).cast("long").alias("to_size"), h(9).alias("strand"), h(1).cast("long").alias("score"))
    keep = primary or [*map(str, range(1, 23)), "X", "Y", "MT"]
    return out.where(F.col("chrom").isin(keep) & F.col("to_chrom").isin(keep)).withColumn("stop", F.col("start") + F.col("size")).drop("size")


def call_records(lines: DataFrame) -> DataFrame:
    """Records of a caller's VCF as text columns, the last one as ``Sample``."""
    f = F.split("line", "\t", -1)
    # The columns of a record.
    names = ["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT"]
    return lines.where(~F.col("line").startswith("#") & (F.trim("line") != "")).select("file", "line_no", *[F.get(f, F.lit(i)).alias(n) for i, n in enumerate(names)], F.get(f, F.lit(9)).alias("Sample"))


def table_rows(lines: DataFrame) -> DataFrame:
    """Rows of tab separated text as maps, by the first non-blank line's names; short rows are filled with empty text."""
    some = lines.where(F.trim("line") != "")
    head = some.groupBy("file").agg(F.min(F.struct("line_no", F.split("line", "\t", -1).alias("h"))).alias("h")).select("file", F.col("h.line_no").alias("head_no"), F.col("h.h").alias("h"))
    rows = measured_join(some, head, ["file"], ["line_no"]).where(F.col("line_no") != F.col("head_no")).withColumn("f", F.split("line", "\t", -1))
    values = F.transform(F.col("h"), lambda _, i: F.coalesce(F.get("f", i), F.lit("")))
    return rows.select("file", "line_no", F.map_from_arrays("h", values).alias("row"))


def analysis_rows(spark: SparkSession, path: str, form: str) -> DataFrame:
    """Rows of an analysis output: ``tsv``, ``json`` (an array, an object with ``rows``, or one object) or ``jsonl``."""
    if form == "tsv":
        return spark.read.csv(path, sep="\t", header=True)
    if form == "jsonl":
        return spark.read.json(path)
    if form == "json":
        df = spark.read.json(path, multiLine=True)
        return df.select(F.explode("rows").alias("r")).select("r.*") if "rows" in df.columns else df
    raise ValueError(f"unsupported output format {form!r}")


def catalogue(rows: DataFrame, sep: str = r"\|") -> DataFrame:
    """Variant specs of a catalogue table in its default layout: ``vid, name, rsids, ref, alt, observed, kind, tags`` and the two loci.

    Names fall back on the id; observed alternates on the alternates; an entry with neither a name nor a place is left out.
    """
    lst = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), sep, -1), lambda x: F.trim(x)), lambda x: x != "")
    locus = lambda b: F.when(F.col(f"{b}_chrom").isNotNull(), F.struct(F.col(f"{b}_chrom").alias("chrom"), F.coalesce(f"{b}_pos", f"{b}_start").alias("start"), F.coalesce(f"{b}_end", f"{b}_pos").alias("stop")))
    alts, seen = lst(F.col("alts")), lst(F.col("observed_alts"))
    out = rows.select(
        F.col("variant_id").alias("vid"), F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("catalogue-"), "variant_id")).alias("name"), F.array_distinct(F.concat(lst(F.col("rsid")), lst(F.col("aliases")))).alias("rsids"), F.col("ref"), F.get(alts, F.lit(0)).alias("alt"),
        F.when(F.size(seen) > 0, seen).otherwise(alts).alias("observed"), F.lower("kind").alias("kind"), F.when(F.col("gene") != "", F.array(F.concat(F.lit("gene:"), "gene"))).otherwise(F.array().cast("array<string>")).alias("tags"), locus("grch37").alias("grch37"), locus("grch38").alias("grch38"),
    )
    return out.where((F.size("rsids") > 0) | F.col("grch37").isNotNull() | F.col("grch38").isNotNull())
