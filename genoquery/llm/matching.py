"""Matching observed variants to a catalogue that shares no key with them.

Both sides become one record per variant with a locus, a change and a name. The
q-grams of each attribute set bits of fixed vectors: the locus (four overlapping
grids of neighbouring positions), the name (positional digit pairs) and the
change. Close vectors are found exactly by multi-index Hamming hashing: a vector
is cut into ``CHUNKS`` chunks, pairs that agree on a chunk are candidates, and
those within ``MAX_HAMMING`` bits are kept. Loci up to ``REACH`` + 1 bases apart lie in
different cells of at most two grids, so they differ in at most that many bits
and agree on a chunk: no such pair is lost.

Field-weighted Dice scores of the pairs (the locus by cells of 1 to 32 bases) become
confidences. Names are the labels of the calibration: the share of agreeing names in a
bin of scores, as a part of that among pairs alike in all else, is the share of true
matches in the bin. Other alternates of a site
share its name, so a pair of known and unlike changes is labelled false. A pair's own
name then moves its confidence by Bayes' rule. Pairs of at least ``LEAST_CONFIDENCE`` are
matches unless the exact check of place and change that follows refuses them.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoquery.operators.skew import measured_join, salted_join
from genoquery.session import durable

CHUNKS = 4
GRID = 32
REACH = 9
BITS = 6  # of a locus q-gram, in a chunk of 64
MAX_HAMMING = 4 * BITS  # two grids' cells on either side
LEAST_CONFIDENCE = 0.1  # low, as the exact check follows
MAX_STRETCHES = 500_000
WEIGHTS = {"locus": 0.5, "change": 0.35, "name": 0.15}
LIFT_BIN = 1_000_000
MAX_POSITION = 260_000_000  # no chromosome is longer; bounds the lift table
ACGT = "^[ACGT]+$"


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGT", "TGCA")


def clean_chrom(c: Column) -> Column:
    return F.nullif(F.regexp_replace(F.upper(F.trim(c)), "^CHR", ""), F.lit(""))


def clean_name(c: Column) -> Column:
    """The digits of an rsid however written, or null."""
    return F.nullif(F.regexp_extract(F.lower(c), r"^\s*(?:rs)?(\d+)\s*[;,]?\s*$", 1), F.lit(""))


def _or(bits: list[Column]) -> Column:
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def _bit(h: Column, i: int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.call_function("shiftrightunsigned", h, F.lit(6 * i)).bitwiseAND(F.lit(63)).cast("int"))


def locus_vector(chrom: Column, pos: Column) -> Column:
    """Four chunks; chunk j has the bits of the grid cell of the j-th grid that holds the position."""
    cells = [F.xxhash64(chrom, F.floor((pos + j * GRID // CHUNKS) / GRID), F.lit(j)) for j in range(CHUNKS)]
    return F.when(chrom.isNotNull() & pos.isNotNull(), F.array(*[_or([_bit(h, i) for i in range(BITS)]) for h in cells]))


def fine_vector(chrom: Column, pos: Column) -> Column:
    """Two chunks with the cells of 1 to 32 bases that hold the position, in two grids each: the nearer two loci, the more they share."""
    bits = lambda sizes: _or([_bit(F.xxhash64(chrom, F.floor((pos + at) / size), F.lit(size), F.lit(at)), i) for size in sizes for at in {0, size // 2} for i in (0, 1)])
    return F.when(chrom.isNotNull() & pos.isNotNull(), F.array(bits([1, 2, 4]), bits([8, 16, 32])))


def name_vector(name: Column) -> Column:
    """Four chunks; chunk j has the positional digit pairs of the last twelve digits that do not touch its j-th part."""
    d = F.when(F.length(name) > 12, F.substring(name, -12, 12)).otherwise(F.lpad(name, 12, "0"))
    chunks = []
    for j in range(CHUNKS):
        pairs = [i for i in range(11) if not {i // 3, (i + 1) // 3} & {j}]
        chunks.append(_or([_bit(F.xxhash64(F.substring(d, i + 1, 2), F.lit(i)), 0) for i in pairs]))
    return F.when(name.isNotNull(), F.array(*chunks))


def change_vector(kind: Column, seq: Column) -> Column:
    """One chunk: the letter pairs of the change, each with the kind of the change."""
    grams = F.transform(F.sequence(F.lit(0), F.greatest(F.length(seq) - 2, F.lit(0))), lambda i: _bit(F.xxhash64(F.substring(seq, i + 1, F.lit(2)), kind), 0))
    return F.coalesce(F.aggregate(grams, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)), F.lit(0).cast("long"))


def dice(a: Column, b: Column) -> Column:
    """Dice of two vectors (arrays of chunks); null where one is missing."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda s, c: s + F.bit_count(c).cast("int"))
    return 2.0 * total(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))) / (total(a) + total(b))


def hamming(a: Column, b: Column) -> Column:
    """The number of bits in which two vectors differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, c: s + c)


def lift_table(catalogue: DataFrame) -> DataFrame:
    """``chrom, bin, segments``: by million bases of the older assembly, the stretches of constant offset in and around it.

    The offsets come from the catalogue's rows with both positions. A row whose neighbours on either side agree on another offset
    is mistaken; every other stretch counts, however short. Stretches are as many as the assemblies' alignment has,
    which does not grow with the catalogue; more than ``MAX_STRETCHES`` are refused as no such alignment.
    """
    both = catalogue.select(clean_chrom(F.col("grch37_chrom")).alias("chrom"), F.col("grch37_pos").alias("p"), (F.col("grch38_pos") - F.col("grch37_pos")).alias("offset"))
    both = both.where(F.col("p").between(1, MAX_POSITION) & F.col("offset").isNotNull() & F.col("chrom").rlike("^(?:[0-9]{1,2}|X|Y|MT?)$"))
    seen = both.groupBy("chrom", "p", "offset").agg(F.count(F.lit(1)).alias("n")).groupBy("chrom", "p").agg(F.max_by("offset", F.struct("n", "offset")).alias("offset"))
    # a bin has at most as many rows as bases
    w = Window.partitionBy("chrom", F.floor(F.col("p") / LIFT_BIN)).orderBy("p")
    kept = seen.select("*", F.lag("offset").over(w).alias("a"), F.lead("offset").over(w).alias("z")).where(F.coalesce((F.col("a") != F.col("z")) | (F.col("a") == F.col("offset")), F.lit(True)))
    runs = kept.withColumn("run", F.sum(F.coalesce((F.lag("offset").over(w) != F.col("offset")).cast("int"), F.lit(0))).over(w))
    found = runs.groupBy("chrom", F.floor(F.col("p") / LIFT_BIN).alias("bin"), "run", "offset").agg(F.min("p").alias("lo"), F.max("p").alias("hi")).limit(MAX_STRETCHES + 1).collect()
    if len(found) > MAX_STRETCHES:
        raise ValueError("the catalogue's two positions are not tied by stretches of constant offset")
    kept = found
    by: dict[str, list] = {}
    for r in sorted(kept, key=lambda r: (r["chrom"], r["lo"], r["hi"])):
        runs = by.setdefault(r["chrom"], [])
        if runs and runs[-1][2] == r["offset"]:
            runs[-1][1] = max(runs[-1][1], r["hi"])
        else:
            runs.append([r["lo"], r["hi"], r["offset"]])
    rows = []
    for chrom, runs in by.items():
        for b in range(MAX_POSITION // LIFT_BIN + 1):
            lo, hi = b * LIFT_BIN, (b + 1) * LIFT_BIN
            i = bisect_left([r[1] for r in runs], lo)
            near = runs[max(0, i - 1) : next((k for k in range(i, len(runs)) if runs[k][0] >= hi), len(runs)) + 1]
            rows.append((chrom, b, [tuple(r) for r in near]))
    return catalogue.sparkSession.createDataFrame(rows, "chrom string, bin long, segments array<struct<lo:bigint,hi:bigint,offset:bigint>>")


def lift(df: DataFrame, table: DataFrame, chrom: str, pos: str, out: str) -> DataFrame:
    """Adds the possible newer positions of an older one: the offset of the stretch it lies in, else those of both neighbours, nearest first."""
    right = table.select(F.col("chrom").alias(chrom), F.col("bin").alias("__bin"), "segments")
    both = df.withColumn("__bin", F.floor(F.col(pos) / LIFT_BIN)).join(F.broadcast(right), [chrom, "__bin"], "left")
    p = F.col(pos)
    inside = F.filter("segments", lambda s: p.between(s["lo"], s["hi"]))
    far = lambda s: F.greatest(s["lo"] - p, p - s["hi"])
    below = F.array_max(F.transform(F.filter("segments", lambda s: s["hi"] < p), lambda s: F.struct(s["hi"].alias("at"), s["offset"].alias("o"), far(s).alias("far"))))
    above = F.array_min(F.transform(F.filter("segments", lambda s: s["lo"] > p), lambda s: F.struct(s["lo"].alias("at"), s["offset"].alias("o"), far(s).alias("far"))))
    sides = F.array_sort(F.filter(F.array(F.when(below.isNotNull(), F.struct(below["far"].alias("f"), (p + below["o"]).alias("p"))), F.when(above.isNotNull(), F.struct(above["far"].alias("f"), (p + above["o"]).alias("p")))), lambda s: s.isNotNull()))
    got = F.when(p.isNull() | F.col("segments").isNull(), F.array().cast("array<bigint>")).when(F.size(inside) > 0, F.transform(inside, lambda s: p + s["offset"])).otherwise(F.transform(sides, lambda s: s["p"]))
    return both.withColumn(out, F.array_distinct(got)).drop("__bin", "segments")


def _modes(votes: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """The most voted non-null value of each name in ``values`` by key; ties go to the larger value. ``votes`` has ``c``.

    ``votes`` are counts, so a hot key has few of them; they move once, by their key.
    """
    each = [F.struct(F.lit(i).alias("i"), *[(v if j == i else F.lit(None)).alias(f"v{j}") for j, v in enumerate(values.values())]) for i in range(len(values))]
    vs = [f"v{j}" for j in range(len(values))]
    melted = votes.repartition(key).select(key, "c", F.explode(F.array(*each)).alias("x")).select(key, "c", "x.*").where(" or ".join(f"{v} is not null" for v in vs))
    some = melted.groupBy(key, "i", *vs).agg(F.sum("c").alias("c"))
    return some.groupBy(key).agg(*[F.max_by(v, F.when(F.col("i") == j, F.struct("c", v))).alias(name) for j, (v, name) in enumerate(zip(vs, values))])


def observed_variants(observations: DataFrame, table: DataFrame) -> DataFrame:
    """One record per ``variant_key``: chrom, pos (newer assembly), r, a, kind, gap, name.

    Rows are counted by what they say before they move. Assays that write positions one too low throughout are told by their
    distance from the other assays' positions, and corrected. Null attributes are no votes; a key without a locus keeps its name.
    """
    o = observations.where(F.col("variant_key").isNotNull())
    p = F.when(F.col("pos_start").between(1, MAX_POSITION), F.col("pos_start"))
    loci = durable(o.groupBy("variant_key", "assay_id", clean_chrom(F.col("chrom")).alias("chrom"), (F.upper("assembly") == "GRCH37").alias("old"), p.alias("p")).agg(F.count(F.lit(1)).alias("c")))
    # a row without a chromosome takes its key's
    chrom = _modes(loci, "variant_key", {"chrom": F.col("chrom")})
    moved = loci.drop("chrom").join(chrom, "variant_key").where(F.col("p").isNotNull())
    moved = lift(moved, table, "chrom", "p", "lifted").withColumn("pos", F.when(F.col("old"), F.try_element_at("lifted", F.lit(1))).otherwise(F.col("p")))
    moved = moved.where(F.col("pos").isNotNull()).groupBy("variant_key", "assay_id", "chrom", "pos").agg(F.sum("c").alias("c"))
    # the position most rows of a key have; its rows are together already
    at = moved.withColumn("same", F.sum("c").over(Window.partitionBy("variant_key", "pos")))
    at = durable(at.withColumn("usual", F.max(F.struct("same", "pos")).over(Window.partitionBy("variant_key"))["pos"]).drop("same"))
    off = at.groupBy("assay_id").agg((F.sum(F.when(F.col("pos") - F.col("usual") == -1, F.col("c")).otherwise(0)) / F.sum("c")).alias("low"))
    shifts = durable(off.select("assay_id", F.when(F.col("low") > 0.5, 1).otherwise(0).alias("shift")))
    right = measured_join(at.select("variant_key", "assay_id", "chrom", "pos", "c"), shifts, ["assay_id"], ["variant_key", "pos"]).withColumn("pos", F.col("pos") + F.col("shift"))
    place = _modes(right, "variant_key", {"chrom": F.col("chrom"), "pos": F.col("pos")})
    seq = lambda c: F.upper(F.trim(c))
    known = F.col("r").rlike(ACGT) & F.col("a").rlike(ACGT) & ~((F.col("r") == "D") | (F.col("a") == "D"))
    said = o.groupBy("variant_key", seq(F.col("reference")).alias("r"), seq(F.col("alternate")).alias("a"), F.lower("kind").alias("kind"), (F.col("pos_end") - F.col("pos_start")).alias("gap")).agg(F.count(F.lit(1)).alias("c"))
    said = _modes(said, "variant_key", {"pair": F.when(known, F.struct("r", "a")), "kind": F.col("kind"), "gap": F.col("gap")})
    names = o.groupBy("variant_key", clean_name(F.col("rsid")).alias("name")).agg(F.count(F.lit(1)).alias("c"))
    names = names.groupBy("variant_key").agg(F.sum("c").alias("n"), F.max_by("name", F.when(F.col("name").isNotNull(), F.struct("c", "name"))).alias("name"))
    out = names.join(place, "variant_key", "left").join(said, "variant_key", "left")
    return with_change(out.select("variant_key", "n", "chrom", "pos", F.col("pair.r").alias("r"), F.col("pair.a").alias("a"), "kind", "gap", "name"))


def with_change(df: DataFrame) -> DataFrame:
    """Adds ``type`` (snp, deletion, insertion) and ``seq``: the two letters of a SNP, or the bases gained or lost.

    Alleles may be written with an anchor base, with ``-``, or as I and D, which give the type and perhaps a length (``size``) only.
    """
    r, a = F.col("r"), F.col("a")
    lr, la = F.length("r"), F.length("a")
    dash_r, dash_a = r == "-", a == "-"
    given = F.lower("kind")
    typ = (
        F.when(dash_r | ((r == "D") & (a == "I")), "insertion").when(dash_a | ((r == "I") & (a == "D")), "deletion").when((lr == 1) & (la == 1), "snp")
        .when(lr > la, "deletion").when(la > lr, "insertion").otherwise(F.when(given.isin("snp", "deletion", "insertion"), given).when(la == 1, F.lit("snp")))
    )
    coded = r.isin("I", "D") & a.isin("I", "D")
    seq = F.when(coded, None).when(dash_r, a).when(dash_a, r).when((lr == 1) & (la == 1), F.concat(r, a)).when(lr > la, F.substring(r, la + 1, lr)).when(la > lr, F.substring(a, lr + 1, la))
    size = F.coalesce(F.when(F.col("type").isin("deletion", "insertion"), F.length("seq")), F.when((F.col("type") == "deletion") & (F.col("gap") > 0), F.col("gap").cast("int")))
    return df.withColumn("type", typ).withColumn("seq", seq).withColumn("size", size)


def catalogue_variants(catalogue: DataFrame, table: DataFrame) -> DataFrame:
    """One record per ``variant_id``, listed alternate and possible place; ``names`` has the name and its aliases."""
    c = catalogue.where(F.col("variant_id").isNotNull())
    pos38 = F.when(F.col("grch38_pos").between(1, MAX_POSITION), F.col("grch38_pos"))
    c = c.select(
        "variant_id", F.upper(F.trim("ref")).alias("r"), F.explode_outer(F.transform(F.split("alts", r"\|"), lambda x: F.upper(F.trim(x)))).alias("a"), "kind",
        clean_chrom(F.coalesce("grch38_chrom", "grch37_chrom")).alias("chrom"), pos38.alias("p38"), F.col("grch37_pos").alias("p37"),
        F.coalesce(F.col("grch38_end") - F.col("grch38_start"), F.col("grch37_end") - F.col("grch37_start")).alias("gap"),
        F.array_distinct(F.filter(F.concat(F.array(clean_name(F.col("rsid"))), F.transform(F.coalesce(F.split("aliases", r"\|"), F.array().cast("array<string>")), lambda x: clean_name(x))), lambda x: x.isNotNull())).alias("names"),
    )
    c = lift(c, table, "chrom", "p37", "lifted")
    places = F.when(F.col("p38").isNotNull(), F.array("p38")).otherwise(F.col("lifted"))
    c = with_change(c.select("variant_id", "r", "a", "kind", "chrom", "gap", "names", F.explode_outer(places).alias("pos")))
    # a change written without its anchor base starts one base later
    return c.withColumn("pos", F.when((F.col("r") == "-") | (F.col("a") == "-"), F.col("pos") - 1).otherwise(F.col("pos")))


def _index(df: DataFrame, id_col: str, vector: str, as_name: str) -> DataFrame:
    return df.where(F.col(vector).isNotNull()).select(id_col, F.col(vector).alias(as_name), F.posexplode(vector).alias("__j", "__chunk"))


def _close(left: DataFrame, right: DataFrame) -> DataFrame:
    """The pairs of two indexes within ``MAX_HAMMING`` bits that agree on a chunk, each from the first chunk they agree on."""
    pairs = left.join(right, ["__j", "__chunk"])
    first = F.array_position(F.zip_with("__left", "__right", lambda x, y: x == y), True) - 1
    return pairs.where((F.col("__j") == first) & (hamming(F.col("__left"), F.col("__right")) <= MAX_HAMMING)).select("variant_key", "cid")


def candidates(keys: DataFrame, entries: DataFrame) -> DataFrame:
    """``variant_key, cid`` of the pairs with close locus vectors, or, where a side has no locus, close name vectors."""
    by_place = _close(_index(keys, "variant_key", "locus", "__left"), _index(entries, "cid", "locus", "__right"))
    named = entries.select("cid", "locus", F.explode("names").alias("name")).withColumn("named", name_vector(F.col("name")))
    lost_keys = keys.where(F.col("locus").isNull())
    a = _close(_index(keys, "variant_key", "named", "__left"), _index(named.where(F.col("locus").isNull()), "cid", "named", "__right"))
    b = _close(_index(lost_keys, "variant_key", "named", "__left"), _index(named.where(F.col("locus").isNotNull()), "cid", "named", "__right"))
    return by_place.unionByName(a.unionByName(b).distinct())


def score(keys: DataFrame, entries: DataFrame) -> DataFrame:
    """The candidate pairs with their Dice scores per field and the comparison of place and change."""
    k = keys.select("variant_key", *[F.col(c).alias(f"k_{c}") for c in ("chrom", "pos", "type", "seq", "size", "name", "fine", "named", "change", "r", "a")])
    e = entries.select("cid", "chrom", "pos", "type", "seq", "size", "names", "fine", "change", "r", "a")
    pairs = candidates(keys, entries).join(k, "variant_key").join(e, "cid")
    d = F.col("pos") - F.col("k_pos")
    s, t, ks = F.col("seq"), F.col("type"), F.col("k_seq")
    swap = lambda x: F.concat(F.substring(x, 2, 1), F.substring(x, 1, 1))
    snp = (
        F.when(s == ks, 1.0).when(s == complement(ks), 0.95).when(s == swap(ks), 0.85).when(s == swap(complement(ks)), 0.8)
        .when(F.col("r").isNull() & F.col("a").isNotNull() & (F.col("a") == F.col("k_a")), 0.9).when(F.col("r").isNull() & (F.col("a") == complement(F.col("k_a"))), 0.8)
        .when(ks.isNull() | (s.isNull() & F.col("a").isNull()), 0.5).otherwise(0.0)
    )
    turned = F.contains(F.concat(s, s), ks) & (F.length(s) == F.length(ks))
    indel = (
        F.when(s == ks, 1.0).when((s == complement(ks)) | (s == F.reverse(complement(ks))), 0.9).when(turned & (d != 0), 0.85)
        .when(s.isNotNull() & ks.isNotNull(), 0.0).when(F.col("size") == F.col("k_size"), 0.8).when(F.col("size").isNull() | F.col("k_size").isNull(), 0.6).otherwise(0.0)
    )
    same = F.when(t != F.col("k_type"), 0.0).when(t == "snp", snp).when(t.isNull() | F.col("k_type").isNull(), 0.3).otherwise(indel)
    names = F.array_max(F.transform("names", lambda n: dice(name_vector(n), F.col("k_named"))))
    return pairs.select(
        "variant_key", "cid", F.when(F.col("chrom") == F.col("k_chrom"), d).alias("d"), ((F.col("chrom") != F.col("k_chrom")) & F.col("pos").isNotNull() & F.col("k_pos").isNotNull()).alias("elsewhere"), F.coalesce(t, F.col("k_type")).alias("type"), same.alias("same"),
        F.array_contains("names", F.col("k_name")).alias("named"), dice(F.col("fine"), F.col("k_fine")).alias("locus"), names.alias("name"), F.when(s.isNotNull() & ks.isNotNull(), dice(F.array("change"), F.array("k_change"))).alias("change"),
    )


def weighted(fields: list[str]) -> Column:
    """The mean of the Dice scores that both sides have, by weight."""
    w = F.lit(0.0)
    x = F.lit(0.0)
    for f in fields:
        w = w + F.when(F.col(f).isNotNull(), WEIGHTS[f]).otherwise(0.0)
        x = x + F.coalesce(F.col(f), F.lit(0.0)) * WEIGHTS[f]
    return F.when(w > 0, x / w).otherwise(F.lit(0.0))


def _class() -> Column:
    """The kind of evidence of a pair: SNP or not, both changes known or not."""
    return (F.coalesce(F.col("type") == "snp", F.lit(False)).cast("int") * 2 + F.col("change").isNotNull().cast("int")).cast("int")


def _bin(bins: int) -> Column:
    return F.least(F.floor(weighted(["locus", "change"]) * bins), F.lit(bins - 1)).cast("int")


AGREE = 0.75  # Dice of two names that differ in a digit at most
CHANCE = 0.01  # how often names of different places agree


def calibrate(pairs: DataFrame, bins: int = 20) -> tuple[list[list[float]], float]:
    """By kind of evidence and bin of the score without names: the share of true matches; and the share of agreeing names in true pairs.

    Names are independent of place and change: among the pairs of a bin they agree as often as its mix of true and other
    pairs makes them. The shares are made monotone by pooling neighbouring bins. At most 8 * ``bins`` rows are collected.
    """
    both = pairs.where(F.col("name").isNotNull() & F.col("locus").isNotNull())
    whole = (weighted(["locus", "change"]) >= 0.999) & F.col("change").isNotNull()
    unlike = F.coalesce(F.col("change") < 0.5, F.lit(False))
    rows = both.groupBy(_class().alias("c"), _bin(bins).alias("b"), whole.alias("whole")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("name") >= AGREE).cast("long")).alias("named"), F.sum(((F.col("name") >= AGREE) & ~unlike).cast("long")).alias("y")).collect()
    share = lambda some: (sum(r["named"] for r in some) + 0.05) / (sum(r["n"] for r in some) + 1.0)
    true_agree = max(share([r for r in rows if r["whole"]]), 2 * CHANCE)
    out = []
    for c in range(4):
        pools: list[list[float]] = []
        for i in range(bins):
            mine = [r for r in rows if (r["c"], r["b"]) == (c, i)]
            n, y = sum(r["n"] for r in mine), sum(r["y"] for r in mine)
            pools.append([y, n, 1])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                last = pools.pop()
                pools[-1] = [x + z for x, z in zip(pools[-1], last)]
        # a bin without pairs takes what the other kinds suggest for it: half
        agree = [(y / n if n else None, n) for y, n, k in pools for _ in range(int(k))]
        out.append([0.5 if a is None else min(1 - 0.5 / (n + 1), max(0.5 / (n + 1), (a - CHANCE) / (true_agree - CHANCE))) for a, n in agree])
    return out, true_agree


def confidence_of(calibration: tuple[list[list[float]], float]) -> Column:
    """The probability that a pair means one variant, from its scores and the agreement of names.

    A pair without a place on both sides was found by its name, and is as sure as true names are and as its changes are alike.
    """
    table, true_agree = calibration
    base = F.element_at(F.element_at(F.array(*[F.array(*map(F.lit, t)) for t in table]), _class() + 1), _bin(len(table[0])) + 1)
    by = F.when(F.col("name").isNull(), 1.0).when(F.col("named") | (F.col("name") >= AGREE), true_agree / CHANCE).otherwise((1 - true_agree) / (1 - CHANCE))
    odds = base / (1 - base) * by
    return F.when(F.col("locus").isNull(), F.when(F.col("named"), true_agree).otherwise(0.0) * F.coalesce("change", F.lit(1.0))).otherwise(odds / (1 + odds))


def match(observations: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``variant_key, variant_id, confidence, score, shift`` of the pairs that mean one variant.

    An entry goes to the key at its place with its change, for each alternate it lists; a place one base off counts where no key is
    nearer (insertions and deletions: up to ten with the same bases on either strand, or the same length where a side has no
    bases). Names change the confidence and choose between keys more than three bases off; an entry without a place goes by
    its name. Repeated entries are pairs of their own; nulls never agree; empty tables give no rows.
    """
    table = lift_table(catalogue)
    keys = observed_variants(observations, table)
    vec = {"locus": locus_vector(F.col("chrom"), F.col("pos")), "fine": fine_vector(F.col("chrom"), F.col("pos"))}
    canon = F.when(F.col("type") == "snp", F.array_min(F.array(F.array_join(F.array_sort(F.split("seq", "")), ""), F.array_join(F.array_sort(F.split(complement(F.col("seq")), "")), "")))).otherwise(F.least(F.col("seq"), complement(F.col("seq"))))
    keys = durable(keys.withColumns(vec | {"named": name_vector(F.col("name")), "change": change_vector(F.coalesce("type", F.lit("?")), canon)}))
    # entries of one content are compared once, however often they are repeated
    content = ["chrom", "pos", "type", "seq", "size", "r", "a", "names"]
    written = catalogue_variants(catalogue, table)
    written = durable(written.select("variant_id", *content, F.md5(F.to_json(F.struct(*content), {"ignoreNullFields": "false"})).alias("cid")))
    members = written.select("cid", "variant_id", "a").distinct()
    entries = durable(written.select("cid", *content).dropDuplicates(["cid"]).withColumns(vec | {"change": change_vector(F.coalesce("type", F.lit("?")), canon)}))
    pairs = durable(score(keys, entries))
    confidence = confidence_of(calibrate(pairs))
    total = weighted(["locus", "change", "name"])
    agree = F.col("named") | (F.col("name") >= AGREE)
    far = F.abs("d")
    ok = (
        F.when(F.col("elsewhere"), False).when(F.col("d").isNull(), F.col("named") & (F.col("same") >= 0.5)).when(far == 0, F.col("same") >= 0.5)
        .when((F.col("type") == "snp") & (far == 1), F.col("same") >= 0.8).when((F.col("type") != "snp") & (far == 1), F.col("same") >= 0.6)
        .when((F.col("type") != "snp") & (far <= REACH + 1), F.col("same") >= 0.8).otherwise(False)
    )
    # more than three bases off, a key whose name agrees goes before a nearer one
    near = F.when(far <= 3, -far).when(far > 3, F.when(agree, -4).otherwise(-5)).otherwise(-50)
    place = F.struct(near.alias("near"), F.coalesce(-far, F.lit(-50)).alias("far"))
    rank = F.struct(F.col("same").alias("a"), F.coalesce(F.col("named"), F.lit(False)).alias("b"), near.alias("c"))
    # the exact check refuses another place or another change, however sure the scores are
    held = pairs.withColumn("confidence", confidence).where((F.col("confidence") >= LEAST_CONFIDENCE) & ok).select("variant_key", "cid", F.col("d").alias("shift"), "confidence", total.alias("score"), place.alias("place"), rank.alias("rank"))
    held = salted_join(members, held, ["cid"], ["variant_id"])
    # an entry has one place; each alternate it lists there has keys of its own
    at = held.withColumn("at", F.max("place").over(Window.partitionBy("variant_id"))).where("place.far = at.far")
    best = at.withColumn("top", F.max("rank").over(Window.partitionBy("variant_id", "a"))).where("rank = top")
    return best.groupBy("variant_key", "variant_id").agg(F.max("confidence").alias("confidence"), F.max("score").alias("score"), F.min_by("shift", F.abs("shift")).alias("shift"))
