"""Text as columns: stripping, sentences, tokens and overlapping windows, all without Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HAN = "\\x{4e00}-\\x{9fff}"
#: Fixed value: white space of any script.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = "\\s\\x1c-\\x1f"
#: Runs of Han, runs of Latin letters and digits, other single signs.
TOKEN = f"(?:[{HAN}]+|[a-zA-Z0-9]+|[^{_SPACE}])"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once a row, even where use reads it in a lambda for each of many elements."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.trim(c, F.lit(WHITE))


def is_blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike("(?U)\\S")


def fixed(c: Column, digits: int = 6) -> Column:
    """Rounded half up by operations that every engine computes alike."""
    return F.floor(c * float(10**digits) + 0.5) / float(10**digits)


def window_starts(n: Column, size: int, overlap: int) -> Column:
    """Starts of windows over n units; the last window is the first to reach the end."""
    step = size - overlap
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil((n - size) / step).cast("int"), F.lit(0))), lambda i: i * step)


def schema_text(rows: DataFrame, *more: str) -> str:
    """The columns of rows and more of them, as the text of a schema."""
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), *more])


def check_window(size: int, overlap: int, split_by: str = "char") -> None:
    if split_by not in ("char", "token"):
        raise ValueError(f"split_by must be char or token, not {split_by!r}")
    if overlap >= size or size < 1 or overlap < 0:
        raise ValueError("overlap must be smaller than size")


def sentences(c: Column) -> Column:
    """Stripped sentences, cut after each of 。！？.!?; empty ones are left out."""
    return F.filter(F.transform(F.split(c, "(?<=[。！？.!?])"), strip), lambda s: s != "")


def char_windows(c: Column, size: int, overlap: int) -> Column:
    """Array of (text, start_char, end_char): the text is cut once into pieces of one step, and each window joins its few."""
    step = size - overlap
    pieces = F.regexp_extract_all(c, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))

    def window(p: Column, n: Column, s: Column) -> Column:
        joined = F.array_join(F.slice(p, (s / step).cast("int") + 1, -(-size // step)), "")
        return F.struct(F.substring(joined, 1, size).alias("text"), s.alias("start_char"), F.least(s + size, n).alias("end_char"))

    return let(F.length(c), lambda n: let(pieces, lambda p: F.transform(window_starts(n, size, overlap), lambda s: window(p, n, s))))


def token_windows(c: Column, size: int, overlap: int) -> Column:
    """Array of (text, start_token, end_token, token_count): the text is cut once into tokens with what is before each, and a window joins its own."""
    pieces = F.regexp_extract_all(F.rtrim(c, F.lit(WHITE)), F.lit(f"(?U)[{_SPACE}]*+{TOKEN}"), F.lit(0))

    def window(p: Column, n: Column, s: Column) -> Column:
        end = F.least(s + size, n)
        return F.struct(F.ltrim(F.array_join(F.slice(p, s + 1, size), ""), F.lit(WHITE)).alias("text"), s.alias("start_token"), end.alias("end_token"), (end - s).alias("token_count"))

    return let(pieces, lambda p: let(F.size(p), lambda n: F.transform(window_starts(n, size, overlap), lambda s: window(p, n, s))))


def terms(c: Column) -> Column:
    """Lower-cased runs of letters and digits, repeats included; runs of Han become pairs of characters."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(f"[{HAN}]+|[\\p{{L}}\\p{{N}}&&[^{HAN}]]+"), F.lit(0))

    def pairs(r: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))

    return F.flatten(F.transform(F.coalesce(runs, F.array().cast("array<string>")), lambda r: F.when(r.rlike(f"^[{HAN}]"), pairs(r)).otherwise(F.array(r))))
