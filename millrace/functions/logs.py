"""Lines and texts for people: logs, durations, shortened and escaped texts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_place(x: Column) -> Column:
    """A number of at least 1 to one place, by the exact value of the double, ties to even. Spark's format_string rounds the shortest decimal that stands for it instead, and half up.

    The fraction is cut in two, so that ten times each part and their distance from the tie are exact.
    """
    x = x.cast("double")
    fraction = x - F.floor(x)
    high = F.floor(fraction * (1 << 26)) / (1 << 26)
    tenth = F.floor(high * 10)
    past = (high * 10 - tenth - 0.5) + (fraction - high) * 10
    tenths = F.floor(x) * 10 + tenth + F.when((past > 0) | ((past == 0) & (tenth % 2 == 1)), 1).otherwise(0)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def duration(ms: Column) -> Column:
    """Whole milliseconds below a second, else seconds to one place."""
    return F.when(ms < 1000, F.format_string("%d ms", F.floor(ms + 0.5))).otherwise(F.concat(one_place(ms.cast("double") / 1000), F.lit(" s")))


def pairs(**values: Column) -> Column:
    """name=value of each that isn't null, parted by spaces."""
    return F.concat_ws(" ", *[F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), v.cast("string"))) for k, v in values.items()])


def timings(**ms: Column) -> Column:
    """name=Nms of each that isn't null, rounded half to even."""
    return pairs(**{k: F.concat(F.bround(v, 0).cast("long").cast("string"), F.lit("ms")) for k, v in ms.items()})


def line(tag: str, **values: Column) -> Column:
    return F.concat(F.lit(f"[{tag}] "), pairs(**values))


def cache_line(match_type: Column, similarity: Column) -> Column:
    """What the log says of a look at the cache."""
    near = F.when(match_type != "identical", F.concat(F.lit(" similarity="), F.format_string("%.4f", similarity)))
    return F.when(match_type == "none", "[cache] MISS").otherwise(F.concat(F.lit("[cache] HIT match="), match_type, F.coalesce(near, F.lit(""))))


def shortened(x: Column, n: int) -> Column:
    """The first n characters and an ellipsis, or a text that is no longer as it is."""
    x = F.coalesce(x, F.lit(""))
    return F.when(F.length(x) > n, F.concat(F.left(x, F.lit(n)), F.lit("…"))).otherwise(x)


def escaped(x: Column) -> Column:
    """Text as it stands between HTML tags."""
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), (" ", "&nbsp;")):
        x = F.replace(x, F.lit(plain), F.lit(coded))
    return x
