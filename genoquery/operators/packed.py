"""Several values packed in one field.

Quoted spans become indexed placeholders, the rest is split on the delimiters,
and the spans come back by array lookup. A placeholder is U+E000, a number,
U+E001; a U+E000 that the text already has is first written as U+E000 e U+E001,
so no text can look like a placeholder.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "", ""
ESCAPED = OPEN + "e" + CLOSE
QUOTED = "\"[^\"]*\"|'[^']*'"
DELIMITERS = "[|;/&]|,(?!_)"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` uses it: a lambda's outer expressions run again for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def mask(text: Column, span: str = QUOTED) -> tuple[Column, Column]:
    """The text with each match of ``span`` replaced by a placeholder, and the array of matches."""
    safe = F.replace(text, F.lit(OPEN), F.lit(ESCAPED))
    spans = F.regexp_extract_all(safe, F.lit(f"({span})"), F.lit(1))
    return F.array_join(F.transform(F.split(safe, span, -1), lambda g, i: F.when(i == 0, g).otherwise(F.concat(F.lit(OPEN), (i - 1).cast("string"), F.lit(CLOSE), g))), ""), spans


def masked(text: Column, span: str, f: Callable[[Column, Column], Column]) -> Column:
    """``f`` of the masked text and its spans, each worked out once."""
    m, spans = mask(text, span)
    return let(F.struct(m.alias("text"), spans.alias("spans")), lambda s: f(s["text"], s["spans"]))


def restore(piece: Column, spans: Column) -> Column:
    """``piece`` with its placeholders replaced by the spans they stand for."""

    def back(part: Column, i: Column) -> Column:
        name, rest = F.substring_index(part, CLOSE, 1), F.substring(part, F.instr(part, CLOSE) + 1, F.length(part))
        span = F.replace(F.try_element_at(spans, name.try_cast("int") + 1), F.lit(ESCAPED), F.lit(OPEN))
        return F.when(i == 0, part).when(name == "e", F.concat(F.lit(OPEN), rest)).otherwise(F.concat(span, rest))

    return F.when(F.instr(piece, OPEN) == 0, piece).otherwise(F.array_join(F.transform(F.split(piece, OPEN, -1), back), ""))


def unquote(value: Column) -> Column:
    """``value`` without outer blanks and without one pair of enclosing quotes."""
    v = F.trim(value)
    return F.trim(F.when(v.rlike("^(?:\"[^\"]*\"|'[^']*')$"), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v))


def split_packed(text: Column, delimiters: str = DELIMITERS, span: str = QUOTED) -> Column:
    """The values of a packed field, in order. Null gives null; a field of nothing but delimiters and blanks gives an empty array."""
    plain = ~text.rlike("[\"'" + OPEN + "]")
    quick = F.transform(F.split(text, delimiters, -1), lambda p: F.trim(p))
    careful = masked(text, span, lambda m, spans: F.transform(F.split(m, delimiters, -1), lambda p: unquote(restore(p, spans))))
    return F.filter(F.when(plain, quick).otherwise(careful), lambda v: v != "")


def unpack(df: DataFrame, id_col: str, fields: Sequence[str], at_least: int = 1) -> DataFrame:
    """One row for each value: id, ``field``, ``ordinal`` (from 1) and ``value``.

    Fields with fewer than ``at_least`` values, null and empty fields give no row. Repeated
    values keep their own ordinals. Other columns of ``df`` are not read.
    """
    packed = df.select(F.col(id_col), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("f"))
    lists = packed.select(id_col, F.col("f.field").alias("field"), split_packed(F.col("f.text")).alias("values")).where(F.size("values") >= at_least)
    return lists.select(id_col, "field", F.posexplode("values").alias("i", "value")).select(id_col, "field", (F.col("i") + 1).alias("ordinal"), "value")
