"""Media time as whole milliseconds: parsing and formatting columns."""
from pyspark.sql import Column
from pyspark.sql import functions as F

TIMECODE = r"\d{1,2}:\d{2}:\d{2}[,.]\d{1,3}"


def parse_timecode(text: Column) -> Column:
    """`H:MM:SS,f` to ms; the fraction is padded on the right (`,5` is 500 ms)."""
    part = F.split(F.replace(text, F.lit("."), F.lit(",")), "[:,]")
    n = lambda i: F.get(part, F.lit(i)).try_cast("bigint")
    return ((n(0) * 60 + n(1)) * 60 + n(2)) * 1000 + F.rpad(F.get(part, F.lit(3)), 3, "0").try_cast("bigint")


def srt_time(ms: Column) -> Column:
    """HH:MM:SS,mmm; times before 0 become 0."""
    t = F.greatest(ms.cast("bigint"), F.lit(0).cast("bigint"))
    part = lambda d, m, w: F.lpad((F.floor(t / d) % m).cast("string"), w, "0")
    hours = F.floor(t / 3_600_000).cast("string")
    return F.concat(F.when(F.length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(hours), F.lit(":"), part(60_000, 60, 2), F.lit(":"), part(1_000, 60, 2), F.lit(","), part(1, 1_000, 3))


def srt_time_clamped(seconds: Column) -> Column:
    """HH:MM:SS,mmm of seconds as a double: fractions that round to 1000 ms become 999."""
    whole = F.floor(F.greatest(seconds, F.lit(0.0)))
    ms = F.least(F.bround((F.greatest(seconds, F.lit(0.0)) - whole) * 1000).cast("bigint"), F.lit(999))
    return srt_time(whole.cast("bigint") * 1000 + ms)


def ass_time(ms: Column) -> Column:
    """H:MM:SS.cc, centiseconds rounded half to even, with carry."""
    t = F.bround(F.greatest(ms.cast("bigint"), F.lit(0)) / 10).cast("bigint")
    two = lambda d, m: F.lpad((F.floor(t / d) % m).cast("string"), 2, "0")
    return F.concat(F.floor(t / 360_000).cast("string"), F.lit(":"), two(6_000, 60), F.lit(":"), two(100, 60), F.lit("."), two(1, 100))
