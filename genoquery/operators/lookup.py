"""Looking up variant specs among genotype rows.

An OR of two equi-joins cannot be planned as a hash join, so the two are joined
apart and united; one winner per participant and spec is the least of
(row, priority), taken by an aggregate that combines before the shuffle.
Neither side is forced to broadcast: the planner measures the specs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoquery.operators.skew import with_salts
from genoquery.session import durable

BIN = 16_384  # of lift-over blocks
LEAST_BIN_BITS = 6
WIDEN = 16
MOST_BASES = 1 << 28  # no chromosome is longer
SAME_PLACE = 4  # rows a place from which places are joined
PLACE_ROWS = 512
HOT_PAIRS = 200_000_000
TASK_PAIRS = 10_000_000
TASK_ROWS = 1_000_000
MOST_TASKS = 20_000


def by_name(rows: DataFrame, specs: DataFrame) -> DataFrame:
    """Rows whose rsid is one of a spec's; alleles are not compared. Null names match nothing."""
    return rows.join(specs.select("vid", F.col("rsid")), "rsid").withColumn("prio", F.lit(0))


def by_place(rows: DataFrame, specs: DataFrame, residual: Column | None = None) -> DataFrame:
    """Rows at a spec's chrom and pos, after ``residual`` over ``spec_*`` columns."""
    s = specs.select("vid", "chrom", "pos", *[F.col(c).alias(f"spec_{c}") for c in specs.columns if c not in ("vid", "chrom", "pos", "rsid")])
    joined = rows.join(s, ["chrom", "pos"])
    return (joined if residual is None else joined.where(residual)).withColumn("prio", F.lit(1))


def winners(*hits: DataFrame, keep: tuple[str, ...] = ("genotype", "rsid")) -> DataFrame:
    """The earliest row per participant and spec; within a row a name beats a place. A no-call is a result, a null genotype is not."""
    cols = ["pid", "vid", "row_idx", "prio", *keep]
    united = hits[0].select(*cols)
    for h in hits[1:]:
        united = united.unionByName(h.select(*cols))
    best = united.where(F.col("genotype").isNotNull()).groupBy("pid", "vid").agg(F.min(F.struct("row_idx", "prio", *keep)).alias("w"))
    return best.select("pid", "vid", "w.*")


def last_winners(hits: DataFrame, keep: tuple[str, ...] = ("genotype",)) -> DataFrame:
    """The rule of the in-memory store: of equal keys the last row wins."""
    return hits.where(F.col("genotype").isNotNull()).groupBy("pid", "vid").agg(F.max(F.struct("row_idx", *keep)).alias("w")).select("pid", "vid", "w.*")


def every_spec(pids: DataFrame, specs: DataFrame, found: DataFrame) -> DataFrame:
    """One row per participant and spec; those without a hit have nulls. The result is as large as both sides multiplied, as asked for."""
    return pids.join(specs.select("vid"), F.lit(True)).join(found, ["pid", "vid"], "left")


def misses(specs: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The specs that nothing was found for."""
    return specs.join(found.select(key).distinct(), key, "left_anti")


def require(specs: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``specs``, if all of them were found; a miss is an error that names one."""
    miss = misses(specs, found, key).first()
    if miss is not None:
        raise LookupError(f"required, but not found: {miss[key]}")
    return specs


def overlaps(reads: DataFrame, loci: DataFrame, loose: int = 0) -> DataFrame:
    """Pairs of reads (chrom, start, stop) and loci (chrom, lo, hi) that overlap; ``loose`` bases are allowed on the left.

    Bins are as wide as nine in ten reads are long, so that a pile-up falls apart into many bins; a longer locus goes to a
    level of wider bins, ``WIDEN`` times each, and a read is looked up in the levels that have loci. A pair counts in the bin
    where the later of the two begins. Rows with a null match nothing.

    A side with many rows of the same place is joined by place, and the pairs of rows are made last, place by place: written
    in this order they take a small part of the bytes. Tasks are as many as the pairs that bins can have ask for, and a bin
    with very many is spread over several. Give only columns that are wanted: those of a place are moved together.
    """
    keys = ["chrom", "__width", "__bin"]
    reads, loci = reads.dropna(subset=["chrom", "start", "stop"]), loci.dropna(subset=["chrom", "lo", "hi"])
    wanted = ["chrom", *[c for c in [*reads.columns, *loci.columns] if c != "chrom"]]
    size = reads.agg(F.percentile_approx(F.col("stop") - F.col("start") + loose, 0.9).alias("p"), F.count(F.lit(1)).alias("n")).first()
    widths = [1 << max(LEAST_BIN_BITS, int(size["p"] or 0).bit_length())]
    while widths[-1] < MOST_BASES:
        widths.append(widths[-1] * WIDEN)
    levels = F.array(*map(F.lit, widths)).cast("array<bigint>")
    wide = F.coalesce(F.array_min(F.filter(levels, lambda w: w > F.col("hi") - F.col("lo"))), F.lit(widths[-1]).cast("long"))
    counts = loci.groupBy(wide.alias("w")).count().collect()  # at most as many as there are levels
    present = [r["w"] for r in counts]
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / F.col("__width")), F.floor(b / F.col("__width"))))
    read_bins = lambda df: df.withColumn("__from", F.col("start") - loose).withColumn("__width", F.explode(F.array(*map(F.lit, present)).cast("array<bigint>"))).withColumn("__bin", bins(F.col("__from"), F.col("stop")))
    locus_bins = lambda df: df.withColumn("__width", wide).withColumn("__bin", bins(F.col("lo"), F.col("hi")))

    count = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    work = count(read_bins(reads), "__reads").join(count(locus_bins(loci), "__loci"), keys).withColumn("__pairs", F.col("__reads").cast("double") * F.col("__loci"))
    cells = F.sum(F.ceil(F.col("__pairs") / HOT_PAIRS)).alias("cells")
    plan = work.agg(F.sum("__pairs").alias("pairs"), F.max("__pairs").alias("most"), cells).first()
    pairs, rows = plan["pairs"] or 0, size["n"] * len(present) + sum(r["count"] for r in counts)
    tasks = int(min(MOST_TASKS, 1 + max(rows / TASK_ROWS, min(pairs / TASK_PAIRS, plan["cells"] or 0))))

    (r, read_rows), (q, locus_rows) = _by_place(reads, ["chrom", "start", "stop"], "__reads"), _by_place(loci, ["chrom", "lo", "hi"], "__loci")
    r, q = read_bins(r), locus_bins(q)
    chunk = max(HOT_PAIRS, pairs / 100_000)  # at most 100,000 bins are hot
    if (plan["most"] or 0) > chunk:
        hot = durable(work.where(F.col("__pairs") > chunk).select(*keys, F.least(F.ceil(F.col("__pairs") / chunk), "__reads").cast("int").alias("__salts")))
        r, q = with_salts(r, q, hot, keys, ["start", "stop", *(["__part"] if read_rows else [])])
        keys.append("__salt")
    hit = (F.col("stop") >= F.col("lo")) & (F.col("__from") <= F.col("hi")) & (F.floor(F.greatest("__from", "lo") / F.col("__width")) == F.col("__bin"))
    out = r.drop("__part").repartition(tasks, *keys).join(q.drop("__part").repartition(tasks, *keys), keys).where(hit)
    if read_rows:  # compiled with the join, this would hold all pairs of a place's reads at once; a function of higher order is not compiled, so they are made one by one
        out = out.select("*", F.inline(F.transform(read_rows, lambda x: x))).drop(read_rows)
    if locus_rows:
        out = out.select("*", F.inline(locus_rows)).drop(locus_rows)
    return out.select(*wanted)


def _by_place(df: DataFrame, place: list[str], name: str) -> tuple[DataFrame, str | None]:
    """Of rows that share places: a row for each place and ``__part`` of it, and ``name``, the array of the other columns. Else the rows themselves and None."""
    rest = [c for c in df.columns if c not in place]
    size = df.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64(*place)).alias("places")).first()
    if not rest or size["n"] < SAME_PLACE * max(1, size["places"]):
        return df, None
    most = max(PLACE_ROWS, size["n"] // 100_000)  # at most 100,000 places have parts
    hot = df.groupBy(*place).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > most)
    hot = durable(hot.select(*place, F.ceil(F.col("__rows") / most).cast("int").alias("__parts")))
    part = F.lit(0)
    if not hot.isEmpty():
        df, part = df.join(F.broadcast(hot), place, "left"), F.pmod(F.xxhash64(*rest), F.coalesce("__parts", F.lit(1))).cast("int")
    return df.withColumn("__part", part).groupBy(*place, "__part").agg(F.collect_list(F.struct(*rest)).alias(name)), name


def vcf_matches() -> Column:
    """Whether a row (ref, alts, pos) at a spec's place carries its change; ``spec_*`` are the spec's columns, ``spec_start`` its position."""
    s = F.col
    same = lambda a, b: F.upper(a) == F.upper(b)
    any_alt = lambda f: F.exists(s("alts"), f)
    snp = (s("pos") == s("spec_start")) & (s("spec_ref").isNull() | same(s("spec_ref"), s("ref"))) & (s("spec_alt").isNull() | any_alt(lambda a: same(a, s("spec_alt")) | same(a, s("spec_ref"))))
    gone = lambda a: F.length(s("ref")) - F.length(a)
    deletion = (s("pos") == s("spec_start") - 1) & any_alt(lambda a: (gone(a) > 0) & ((F.coalesce(s("spec_len"), F.lit(0)) == 0) | (gone(a) == s("spec_len"))))
    near = (s("pos") == s("spec_start")) | (s("pos") == s("spec_start") - 1)
    delta = F.length("spec_alt") - F.length("spec_ref")
    exact = lambda a: (s("spec_ref").isNull() | same(s("spec_ref"), s("ref"))) & (s("spec_alt").isNull() | same(s("spec_alt"), a))
    sized = lambda a: (delta != 0) & (F.length(a) - F.length(s("ref")) == delta)
    fits = lambda a: exact(a) | F.coalesce(sized(a), F.lit(False))
    insertion = near & any_alt(lambda a: (F.length(a) > F.length(s("ref"))) & fits(a))
    indel = near & any_alt(lambda a: (F.length(a) != F.length(s("ref"))) & fits(a))
    kind = s("spec_kind")
    return F.when(kind == "snp", snp).when(kind == "deletion", deletion).when(kind == "insertion", insertion).when(kind == "indel", indel).otherwise(s("pos") == s("spec_start"))


def lift_blocks(rows: DataFrame, blocks: DataFrame, keep: list[str]) -> DataFrame:
    """Positions (chrom, pos) carried through chain blocks: best score, then first block. Rows outside every block have nulls."""
    p = F.col("pos") - 1
    b = blocks.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("start") / BIN), F.floor((F.col("stop") - 1) / BIN))))
    hit = rows.withColumn("__bin", F.floor(p / BIN)).join(b, ["chrom", "__bin"]).where((F.col("start") <= p) & (p < F.col("stop")))
    to = F.when(F.col("strand") == "+", F.col("to_start") + p - F.col("start")).otherwise(F.col("to_size") - (F.col("to_start") + p - F.col("start")) - 1) + 1
    best = hit.groupBy(*keep).agg(F.min(F.struct((-F.col("score")).alias("s"), "idx", F.col("to_chrom"), to.alias("to_pos"), "strand")).alias("w"))
    return rows.join(best.select(*keep, "w.to_chrom", "w.to_pos", "w.strand"), keep, "left")
