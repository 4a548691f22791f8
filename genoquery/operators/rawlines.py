"""Raw export files as lines: layout, drift between files, and lines that fail.

A file's header says what its columns mean. Every file's columns are profiled by
the raw types of their values, the profile says in which notation the file writes
positions, alleles and names, and lines are judged by their own file's notation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoquery.operators.packed import let, masked, restore
from genoquery.operators.skew import bounded, measured_join
from genoquery.session import durable

# The base layouts of the two vendors.
BASE = {
    "ancestrydna_csv": ["rsid", "chromosome", "position", "allele1", "allele2"],
    "familytreedna": ["rsid", "chromosome", "position", "result"],
}
# Names under which the exports give a field, compared in lower case without blanks, "_" and "-".
NAMES = {
    "rsid": ["rsid", "snp", "snpid", "name", "marker", "markername", "markerid", "probe", "probeid", "variant", "variantid", "vref", "rs", "rsnumber"],
    "chromosome": ["chromosome", "chrom", "chr", "chrno", "contig", "chrnumber"],
    "position": ["position", "pos", "loc", "coordinate", "bp", "basepairposition", "location", "bppos"],
    "allele1": ["allele1", "a1", "first", "allelea", "allele1top", "firstallele", "allele1forward"],
    "allele2": ["allele2", "a2", "second", "alleleb", "allele2top", "secondallele", "allele2forward"],
    "result": ["result", "genotype", "gt", "call", "calls", "alleles", "yourcode", "genotypes"],
}
QUOTED_FIELD = r'(?<=^|,)[ \t]*"[^"]*(?:""[^"]*)*"[ \t]*(?=,|$)'
# a line of which every field is bare, or quoted without a quote or comma inside
EASY_QUOTES = r'^ *(?:"[^",]*"|[^",]*+) *(?:, *(?:"[^",]*"|[^",]*+) *)*+$'
MAX_POSITION = 250_000_000
# The raw types of a value as written, by the letter that stands for them in a line's ``shape``.
RAW_TYPES = {
    "b": "blank", "i": "int", "l": "int", "a": "allele", "n": "name", "p": "pair", "c": "locus", "w": "whole_decimal", "d": "decimal", "r": "chr_word", "s": "slashed_pair", "x": "text", "t": "text",
}
FILE = ["vendor", "file_id"]
LINE = [*FILE, "line_no"]


def compared(name: Column) -> Column:
    """A column name as it is compared: lower case without blanks, ``_`` and ``-``."""
    return F.translate(F.lower(name), " \t\n\r\f\v_-", "")


def read_lines(sources: dict[str, DataFrame]) -> DataFrame:
    """The data lines of all sources: ``vendor``, ``file_id``, ``line_no``, ``text``.

    Blank lines and comments are left out; BOM, carriage return and outer blanks are removed. A null line is blank, and lines
    without a ``file_id`` or ``line_no`` belong to no file and are left out.
    """
    parts = [df.select(F.lit(vendor).alias("vendor"), "file_id", "line_no", F.trim(F.regexp_replace(F.rtrim("line", F.lit("\r\n")), "^﻿", "")).alias("text")) for vendor, df in sources.items()]
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part)
    return lines.where((F.col("text") != "") & ~F.col("text").startswith("#") & ~F.col("text").startswith("//")).dropna(subset=["file_id", "line_no"])


def fields_of(text: Column) -> Column:
    """``broken`` (whether the quoting of a comma separated line is) and ``fields`` without quotes and outer blanks."""

    def open_field(piece: Column, spans: Column) -> Column:
        v = F.trim(restore(piece, spans))
        quoted = v.startswith('"') & v.endswith('"') & (F.length(v) >= 2)
        return F.when(quoted, F.trim(F.replace(F.substring(v, F.lit(2), F.length(v) - 2), F.lit('""'), F.lit('"')))).otherwise(v)

    both = lambda broken, fields: F.struct(broken.alias("broken"), fields.alias("fields"))
    split = lambda t: F.when(F.instr(t, " ") == 0, F.split(t, ",", -1)).otherwise(F.split(F.trim(t), " *, *", -1))
    easy = both(F.lit(False), split(F.translate(text, '"', "")))
    hard = masked(text, QUOTED_FIELD, lambda m, spans: both(F.instr(m, '"') > 0, F.transform(F.split(m, ",", -1), lambda p: open_field(p, spans))))
    return F.when(F.instr(text, '"') == 0, both(F.lit(False), split(text))).when(text.rlike(EASY_QUOTES), easy).otherwise(hard)


def known_field(name: Column) -> Column:
    """The base field for a compared name, or null."""
    pairs = ",".join(f"{n}:{field}" for field, names in NAMES.items() for n in names)
    return F.try_element_at(F.str_to_map(F.lit(pairs)), name)


def raw_type(v: Column) -> Column:
    """The letter of a value's raw type in ``RAW_TYPES``; ``l`` is a number of three digits or more, ``x`` the name of a sex chromosome or MT."""
    return (
        F.when(v == "", "b").when(v.rlike(r"^\d{3,}$"), "l").when(v.rlike(r"^-?\d+$"), "i").when(v.rlike("^[ACGTID0-]$"), "a").when(v.rlike(r"^(?i:rs|i)\d+$"), "n").when(v.rlike("^(?:[ACGTID]{2}|--)$"), "p")
        .when(v.rlike("^(?:X|Y|XY|MT?)$"), "x").when(v.rlike(r"^(?i:chr)?(?:\d{1,2}|[XYM]|MT):\d+$"), "c").when(v.rlike(r"^\d+\.0+$"), "w").when(v.rlike(r"^-?\d+\.\d+$"), "d")
        .when(v.rlike("^(?i:chr|chrom|chromosome)[ _]?(?:[0-9]{1,2}|X|Y|M|MT)$"), "r").when(v.rlike("^[ACGTID][/|][ACGTID]$"), "s").otherwise("t")
    )


def data_lines(parsed: DataFrame, files: DataFrame, may_broadcast: bool | None = None) -> DataFrame:
    """The parsed lines with their file's columns, without the header and its repeats."""
    rows = measured_join(parsed, files, FILE, ["line_no"], may_broadcast=may_broadcast)
    # only a line whose first field is the header's is compared in full
    repeat = (compared(F.get("fields", F.lit(0))) == F.get("head", F.lit(0))) & (F.transform("fields", compared) == F.col("head"))
    return rows.where((F.col("line_no") != F.col("header_line")) & ~repeat).drop("header_line", "head")


def at_role(role: str) -> Column:
    """The place of a role among a file's columns, from 1, or null."""
    return F.expr(f"nullif(cast(array_position(roles, '{role}') as int), 0)")


def parse(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed data lines, and one row per file with its layout and notation.

    Lines: ``vendor, file_id, line_no, broken, fields, shape, width, at_*, position_as, coded`` (``at_*`` are the places of the base
    fields, from 1); the header and its repeats are left out. Files: ``vendor, file_id, names, profile, roles, types`` and the notation columns. Each line is parsed once: its values
    and their raw types (``shape``, a letter each) are written. All lines of a file have the same paths, so these are
    kept once per file, and the path-type statistics count whole shapes before they are divided into paths.
    Of two lines with the same number the first header is the lesser. An empty table gives no rows.
    """
    split = lines.select(*LINE, fields_of(F.col("text")).alias("p")).select(*LINE, "p.broken", "p.fields")
    parsed = durable(split.withColumn("shape", F.array_join(F.transform("fields", raw_type), "")))
    first = durable(parsed.groupBy(*FILE).agg(F.min("line_no").alias("line_no")))
    few = bounded(first)
    heads = measured_join(parsed.select(*LINE, "fields"), first, LINE, ["line_no"], may_broadcast=few)
    heads = heads.groupBy(*LINE).agg(F.min(F.transform("fields", compared)).alias("head"))
    base = F.when(F.col("vendor") == "ancestrydna_csv", F.array(*map(F.lit, BASE["ancestrydna_csv"]))).otherwise(F.array(*map(F.lit, BASE["familytreedna"])))
    # a file whose first line names no field has no header and is read by the base layout
    headed = F.exists("head", lambda n: known_field(n).isNotNull())
    unlike = F.transform("head", lambda n, i: F.when(F.array_position("head", n) == i + 1, n).otherwise(F.concat(n, F.lit("#"), i.cast("string"))))
    layout = durable(heads.select(*FILE, F.when(headed, F.col("line_no")).otherwise(F.lit(0)).alias("header_line"), F.when(headed, F.col("head")).otherwise(F.array().cast("array<string>")).alias("head"), F.when(headed, unlike).otherwise(base).alias("names")))
    few = bounded(layout)
    sound = data_lines(parsed.where("not broken"), layout.withColumn("width", F.size("names")), may_broadcast=few).where(F.size("fields") == F.col("width"))
    shapes = sound.groupBy(*FILE, "shape").agg(F.count(F.lit(1)).alias("n"))
    paths = shapes.select(*FILE, "n", F.posexplode(F.split("shape", "(?!^)")).alias("i", "letter"))
    kinds = F.str_to_map(F.lit(",".join(f"{a}:{b}" for a, b in RAW_TYPES.items())))
    share = lambda letters: F.sum(F.when(F.col("letter").isin(*letters), F.col("n")).otherwise(0))
    types = paths.where("letter <> 'b'").withColumn("type", kinds[F.col("letter")]).groupBy(*FILE, "i", "type").agg(F.sum("n").alias("n"), share("l").alias("long"), share("x").alias("sex"))
    usual = types.groupBy(*FILE, "i").agg(F.max_by("type", F.struct("n", "type")).alias("type"), F.sum("n").alias("n"), F.sum("long").alias("long"), F.sum("sex").alias("sex"))
    profiles = usual.groupBy(*FILE).agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct("type", "n", "long", "sex").alias("s")))).alias("profile"))
    files = layout.join(profiles, FILE, "left").withColumn("profile", F.transform("names", lambda n, i: F.try_element_at("profile", i)))
    files = durable(files.withColumn("roles", roles_of()))
    files = files.withColumn("types", F.map_from_arrays(F.array(*map(F.lit, NAMES)), F.array(*[F.try_element_at("profile", at_role(r))["type"] for r in NAMES])))
    type_of = lambda r: F.col("types")[r]
    files = durable(files.withColumns({
        "position_as": F.when(type_of("position").isin("locus", "whole_decimal"), type_of("position")).otherwise("int"),
        "coded": F.coalesce((type_of("allele1") == "int") | (type_of("result") == "int"), F.lit(False)),
    }))
    return data_lines(parsed, files.select(*FILE, "header_line", "head", F.size("names").alias("width"), *[at_role(r).alias(f"at_{r}") for r in NAMES], "position_as", "coded")), files


def roles_of() -> Column:
    """The base field of each column of a file: by its name, else by the types of its values where no column is named so.

    A column of an unlisted name is a result if its values are pairs, an allele if they are single alleles (the first such column is
    allele1, the second allele2), a position if most are numbers of three digits or more or loci, a chromosome if they are chromosome words
    or numbers among which are sex chromosomes, and an rsid if they are names. Of several such columns the first counts.
    """
    named = F.transform("names", lambda n: F.coalesce(known_field(n), F.lit("")))
    # (role, the roles that must not be named, test of a column's profile)
    tests = [
        ("rsid", ["rsid"], lambda s: s["type"] == "name"), ("result", ["result", "allele1"], lambda s: s["type"].isin("pair", "slashed_pair")),
        ("position", ["position"], lambda s: (s["type"] == "locus") | ((s["type"] == "int") & (s["long"] * 2 > s["n"]))),
        ("chromosome", ["chromosome"], lambda s: (s["type"] == "chr_word") | (s["type"].isin("int", "text") & (s["sex"] > 0) & (s["long"] == 0))),
        ("allele1", ["allele1", "result"], lambda s: s["type"] == "allele"), ("allele2", ["allele2", "result"], lambda s: s["type"] == "allele"),
    ]

    def assign(each: tuple, roles: Column) -> Column:
        role, absent, test = each
        free = F.zip_with(roles, F.col("profile"), lambda r, s: (r == "") & F.coalesce(test(s), F.lit(False)))
        first = let(free, lambda f: F.array_position(f, True))
        found = let(first, lambda at: F.transform(roles, lambda r, i: F.when(at == i + 1, F.lit(role)).otherwise(r)))
        return F.when(F.arrays_overlap(roles, F.array(*map(F.lit, absent))), roles).otherwise(found)

    def step(each: tuple):
        return lambda roles: assign(each, roles)

    out = named
    for each in tests:
        out = let(out, step(each))
    return out


def changes(files: DataFrame) -> DataFrame:
    """Each difference between a file and its vendor's base layout: ``file_id, field, change``. A file without one has no row."""
    out = []
    for vendor, base in BASE.items():
        of = files.where(F.col("vendor") == vendor)
        at = {f: F.expr(f"nullif(cast(array_position(roles, '{f}') as int), 0)") for f in NAMES}
        found = []
        for f in base:
            name = F.try_element_at(F.col("names"), at[f])
            found.append(F.when(at[f].isNull(), F.struct(F.lit(f).alias("field"), F.lit("removed").alias("change"))))
            found.append(F.when(name != f, F.struct(F.lit(f).alias("field"), F.lit("renamed").alias("change"))))
            t = F.col("types")[f]
            other = {"rsid": t.isin("int", "decimal", "whole_decimal", "locus"), "chromosome": t.isin("chr_word", "decimal", "whole_decimal", "locus"), "position": t.isin("locus", "whole_decimal", "decimal", "text", "name")}.get(f, t.isin("int", "slashed_pair", "decimal", "whole_decimal"))
            found.append(F.when(other, F.struct(F.lit(f).alias("field"), F.lit("type_changed").alias("change"))))
        new = F.transform(
            F.filter(F.arrays_zip("names", "roles"), lambda z: (z["roles"] == "") | z["roles"].isin([f for f in NAMES if f not in base])),
            lambda z: F.struct(F.regexp_replace(z["names"], "#.*$", "").alias("field"), F.lit("added").alias("change")),
        )
        out.append(of.select("file_id", F.explode(F.concat(F.filter(F.array(*found), lambda s: s.isNotNull()), new)).alias("c")).select("file_id", "c.field", "c.change"))
    return out[0].unionByName(out[1]).distinct()


def cell(role: str) -> Column:
    """The value of a role in a parsed row, or null where the file has no such column."""
    return F.try_element_at("fields", F.col(f"at_{role}"))


def to_position(value: Column, written: Column) -> Column:
    """The position in the file's notation, or null."""
    digits = (
        F.when((written == "int") & value.rlike(r"^\d+$"), value).when((written == "locus") & value.rlike(r"^[^:]+:\d+$"), F.substring_index(value, ":", -1))
        .when((written == "whole_decimal") & value.rlike(r"^\d+(?:\.0+)?$"), F.substring_index(value, ".", 1))
    )
    return digits.try_cast("long")


def bad_value(kind: Column, written: Column, value: Column) -> Column:
    """Whether a cell's value is invalid for its kind and notation."""
    p = to_position(value, written)
    ok = (
        F.when(kind == "position", F.coalesce(p.between(1, MAX_POSITION), F.lit(False)))
        .when((kind == "allele") & (written == "coded"), value.rlike("^[0-6]$")).when(kind == "allele", value.rlike("^[ACGTID0-]$"))
        .when(written == "coded", value.rlike("^(?:-1|[0-2])$")).otherwise(value.rlike("^(?:[ACGTID]{1,2}|--)$"))
    )
    return ~ok


def structural() -> Column:
    """The failure of a line as a whole, or null."""
    return F.when(F.col("broken"), "quoting").when(F.length("shape") != F.col("width"), "column_count")


def failures(rows: DataFrame) -> DataFrame:
    """``file_id, line_no, reason`` of each parsed line that fails; the first reason of quoting, column_count, position, allele.

    Each distinct value of a column kind and notation is cast once; the invalid ones form a dictionary that is joined back to
    the lines, which are read a second time from where they were written.
    """
    code = F.when(F.col("coded"), "coded").otherwise("letters")
    one = lambda kind, written, role: F.struct(F.lit(kind).alias("kind"), written.alias("written"), cell(role).alias("value"))
    whole = F.array(F.struct(structural().alias("kind"), F.lit("").alias("written"), F.lit("").alias("value")))
    each = F.array(one("position", F.col("position_as"), "position"), one("allele", code, "allele1"), one("allele", code, "allele2"), one("genotype", code, "result"))
    cells = rows.select("file_id", "line_no", F.explode(F.when(structural().isNotNull(), whole).otherwise(each)).alias("c")).select("file_id", "line_no", "c.*").where("value is not null")
    keys = ["kind", "written", "value"]
    # a line's first reason is the one with the largest number
    number = F.when(F.col("kind") == "quoting", 4).when(F.col("kind") == "column_count", 3).when(F.col("kind") == "position", 2).otherwise(1)
    distinct = cells.where(~F.col("kind").isin("quoting", "column_count")).select(*keys).distinct()
    invalid = durable(distinct.where(bad_value(F.col("kind"), F.col("written"), F.col("value"))).withColumn("known", F.lit(True)))
    hits = measured_join(cells, invalid, keys, ["file_id", "line_no"], how="left").withColumn("reason", number).where("known or reason >= 3")
    names = F.element_at(F.array(*map(F.lit, ("allele", "position", "column_count", "quoting"))), F.max("reason"))
    return hits.groupBy("file_id", "line_no").agg(names.alias("reason"))


def consistent(rows: DataFrame) -> DataFrame:
    """The typed content of every data line in one layout, with what failed in ``failed_casts``: the fields whose cast did, or the line as a whole.

    A line whose quoting or field count is broken keeps its place and has no values. Coded alleles stay as written: the files
    give no key to the codes. A pair of alleles and a genotype are given in both forms.
    """
    whole = structural()
    sound = rows.withColumn("whole", whole).withColumn("fields", F.when(F.col("whole").isNull(), F.col("fields")))
    pos, a1, a2, res, rs = (cell(x) for x in ("position", "allele1", "allele2", "result", "rsid"))
    typed = to_position(pos, F.col("position_as"))
    typed = F.when(typed.between(1, MAX_POSITION), typed)
    chrom = F.coalesce(cell("chromosome"), F.when(F.col("position_as") == "locus", F.substring_index(pos, ":", 1)))
    code = F.when(F.col("coded"), "coded").otherwise("letters")
    failed = F.filter(F.array(
        F.col("whole"), F.when(pos.isNotNull() & typed.isNull(), "position"), F.when(bad_value(F.lit("allele"), code, a1), "allele1"),
        F.when(bad_value(F.lit("allele"), code, a2), "allele2"), F.when(bad_value(F.lit("genotype"), code, res), "result"),
    ), lambda x: x.isNotNull())
    return sound.select(
        "vendor", "file_id", "line_no", F.when(rs.rlike(r"^\d+$"), F.concat(F.lit("rs"), rs)).otherwise(rs).alias("rsid"), F.regexp_replace(chrom, "^(?i:chr)", "").alias("chromosome"), typed.alias("position"),
        F.coalesce(a1, F.when(~F.col("coded"), F.substring(res, 1, 1))).alias("allele1"), F.coalesce(a2, F.when(~F.col("coded"), F.substring(res, -1, 1))).alias("allele2"),
        F.coalesce(res, F.when(~F.col("coded"), F.concat(a1, a2))).alias("result"), F.col("coded").alias("alleles_coded"), failed.alias("failed_casts"),
    )
