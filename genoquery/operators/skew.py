"""Work on keys of which a few hold most rows.

``salted_join`` spreads a hot key over as many tasks as its measured rows ask for. ``number_rows`` and
``chunked`` implement exact offset chunking: count keys per input block, turn
the counts into offsets by a prefix sum, number the rows of every key, process
chunks of equal size and merge their ordered boundary states.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from genoquery.session import durable

BLOCK = "__block"
AT = "__at"
BROADCAST_BYTES = 32 << 20
CHUNK_ROWS = 2_000_000
SPAN = 1024
FAN_IN = 1024


def bounded(small: DataFrame) -> bool:
    """Whether a table that is cheap to read (a written one) has at most ``BROADCAST_BYTES``, as measured by its rows written out."""
    size = small.agg(F.sum(F.length(F.to_json(F.struct("*"))).cast("long") + 16).alias("b")).first()["b"]
    return (size or 0) <= BROADCAST_BYTES


def measured_join(big: DataFrame, small: DataFrame, keys: Sequence[str], spread: Sequence[str], how: str = "inner", may_broadcast: bool | None = None) -> DataFrame:
    """Joins ``big`` to ``small``, which is sent to every task if its measured size allows, and else joined by ``salted_join``.

    ``small`` is a written table or as cheap to read; ``may_broadcast`` has the answer of ``bounded`` where it is known.
    """
    if bounded(small) if may_broadcast is None else may_broadcast:
        return big.join(F.broadcast(small), list(keys), how)
    return salted_join(big, small, keys, spread, how)


def salted_join(big: DataFrame, small: DataFrame, keys: Sequence[str], spread: Sequence[str], how: str = "inner", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Joins ``big`` to ``small`` so that no task gets much more than ``chunk_rows`` rows of one key.

    The rows of each key of ``big`` are counted first. Only keys above ``chunk_rows`` are salted, by as many salts as they
    have chunks; they are at most a ``chunk_rows``-th of all rows and are sent to every task. ``spread`` names columns of ``big``
    that differ within a key. ``how`` is inner, left, left_semi or left_anti. Null keys match nothing, as in a plain join.
    """
    keys = list(keys)
    hot = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > chunk_rows).dropna(subset=keys)
    hot = durable(hot.select(*keys, F.ceil(F.col("__rows") / chunk_rows).cast("int").alias("__salts")))
    if hot.isEmpty():
        return big.join(small, keys, how)
    left, right = with_salts(big, small, hot, keys, spread)
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


def with_salts(big: DataFrame, small: DataFrame, hot: DataFrame, keys: Sequence[str], spread: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``__salt``, which ends the join's key: rows of ``big`` have one, rows of ``small`` are repeated for each. ``hot`` has the ``__salts`` of some keys; others have one."""
    salts = F.coalesce("__salts", F.lit(1))
    left = big.join(F.broadcast(hot), list(keys), "left").withColumn("__salt", F.pmod(F.xxhash64(*spread), salts).cast("int")).drop("__salts")
    right = small.join(F.broadcast(hot), list(keys), "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    return left, right


def with_file_order(df: DataFrame, block_rows: int = 65536) -> DataFrame:
    """Adds the block and place of each row of a file scan: ``__block`` and ``__at``.

    A block is a run of ``block_rows`` rows of one file, so it means the same in
    every attempt of a task and on every cluster. For a DataFrame that is no
    file scan, write it first.
    """
    row = F.col("_metadata.row_index")
    return df.select("*", F.concat_ws("#", F.col("_metadata.file_path"), F.lpad((row / block_rows).cast("long").cast("string"), 12, "0")).alias(BLOCK), row.alias(AT))


def number_rows(df: DataFrame, key: str, chunk_rows: int) -> DataFrame:
    """Adds ``__n`` (the row's number within its key, from 1, in block and row order) and ``__chunk``.

    ``df`` has ``__block`` and ``__at``. The window over rows is per block and key,
    so no task holds more than a block of a hot key. The prefix sum has two levels, so
    its windows have a row per span of blocks (a file, or ``SPAN`` numbered blocks) and a row
    per block of a span. Rows without a key are dropped: null is no key.
    """
    rows = df.where(F.col(key).isNotNull())
    within = rows.withColumn("__i", F.row_number().over(Window.partitionBy(BLOCK, key).orderBy(AT)))
    span = F.regexp_replace(BLOCK, "#[^#]*$", "") if isinstance(df.schema[BLOCK].dataType, StringType) else F.floor(F.col(BLOCK) / SPAN)
    counts = rows.groupBy(key, span.alias("__span"), BLOCK).agg(F.count(F.lit(1)).alias("__c"))
    before = lambda keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    spans = counts.groupBy(key, "__span").agg(F.sum("__c").alias("__c"))
    spans = spans.select(key, "__span", F.coalesce(F.sum("__c").over(before([key], "__span")), F.lit(0)).alias("__first"))
    inner = counts.withColumn("__offset", F.coalesce(F.sum("__c").over(before([key, "__span"], BLOCK)), F.lit(0)))
    offsets = inner.join(spans, [key, "__span"]).select(key, BLOCK, (F.col("__first") + F.col("__offset")).alias("__offset"))
    return within.join(offsets, [key, BLOCK]).withColumn("__n", F.col("__offset") + F.col("__i")).withColumn("__chunk", F.floor((F.col("__n") - 1) / chunk_rows)).drop("__i", "__offset")


def chunked(df: DataFrame, key: str, states: Sequence[Column], merges: Sequence[Column], chunk_rows: int = 50_000) -> DataFrame:
    """Per-key results in which no task sees more than ``chunk_rows`` rows of a key.

    ``states`` are aggregates over one chunk's rows (they may use ``__n``), and
    ``merges`` are aggregates over one key's chunk states, which carry ``__chunk``
    for their order. An empty input gives no rows.
    """
    numbered = number_rows(df, key, chunk_rows)
    return numbered.groupBy(key, "__chunk").agg(*states).groupBy(key).agg(*merges)


def key_runs(df: DataFrame, key: str, flag: Column, chunk_rows: int = 50_000) -> DataFrame:
    """Per key, in row order: rows, flagged rows and the longest unbroken run of flagged rows.

    The run needs order across chunks. A chunk's boundary state is its length, the
    run at its start, the run at its end and its longest run; states merge from left
    to right. A null flag counts as false.
    """
    numbered = number_rows(df.withColumn("__flag", F.coalesce(flag, F.lit(False))), key, chunk_rows)
    # rows of a run share __n minus their rank among flagged rows; ranks are within the chunk, which bounds the window
    ranked = numbered.withColumn("__rank", F.sum(F.col("__flag").cast("long")).over(Window.partitionBy(key, "__chunk").orderBy("__n").rowsBetween(Window.unboundedPreceding, 0)))
    runs = ranked.groupBy(key, "__chunk", F.when(F.col("__flag"), F.col("__n") - F.col("__rank")).alias("__run")).agg(F.count(F.lit(1)).alias("len"), F.min("__n").alias("a"), F.max("__n").alias("b"))
    flagged = F.col("__run").isNotNull()
    chunks = runs.groupBy(key, "__chunk").agg(
        F.sum("len").alias("rows"), F.min("a").alias("lo"), F.max("b").alias("hi"), F.coalesce(F.max(F.when(flagged, F.col("len"))), F.lit(0)).alias("best"),
        F.min_by(F.when(flagged, F.struct("a", "b", "len")), F.when(flagged, F.col("a"))).alias("first"),
        F.max_by(F.when(flagged, F.struct("a", "b", "len")), F.when(flagged, F.col("a"))).alias("last"), F.coalesce(F.sum(F.when(flagged, F.col("len"))), F.lit(0)).alias("hits"),
    )
    states = chunks.select(
        key, "__chunk", "rows", "best", "hits",
        F.when(F.col("first.a") == F.col("lo"), F.col("first.len")).otherwise(F.lit(0)).alias("head"),
        F.when(F.col("last.b") == F.col("hi"), F.col("last.len")).otherwise(F.lit(0)).alias("tail"),
    )
    # the states of FAN_IN neighbours become one, three times over: no task holds more than so many of a key
    for last in (False, False, True):
        group = F.lit(0).cast("long") if last else F.floor(F.col("__chunk") / FAN_IN).cast("long")
        merged = states.groupBy(key, group.alias("__chunk_")).agg(_joined_runs().alias("s"), F.sum("hits").alias("hits"))
        states = merged.select(key, F.col("__chunk_").alias("__chunk"), "s.rows", "s.best", "hits", "s.head", "s.tail")
    return states.select(key, "rows", "hits", F.col("best").alias("longest_run"))


def _joined_runs() -> Column:
    """The state of neighbouring chunks, joined in their order: rows, longest run, runs at the start and at the end."""
    state = "struct<rows:bigint,best:bigint,head:bigint,tail:bigint>"
    zero = F.struct(*[F.lit(0).cast("long").alias(x) for x in ("rows", "best", "head", "tail")])
    return F.aggregate(
        F.array_sort(F.collect_list(F.struct("__chunk", "rows", "best", "head", "tail"))), zero.cast(state),
        lambda s, c: F.struct(
            (s["rows"] + c["rows"]).alias("rows"), F.greatest(s["best"], c["best"], s["tail"] + c["head"]).alias("best"),
            F.when(s["head"] == s["rows"], s["rows"] + c["head"]).otherwise(s["head"]).alias("head"),
            F.when(c["head"] == c["rows"], s["tail"] + c["rows"]).otherwise(c["tail"]).alias("tail"),
        ).cast(state),
    )
