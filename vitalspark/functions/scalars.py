"""Scalar functions of the diagnostics model, as column expressions (all stay in whole-stage code generation)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_WORDS = ("", "nan", "NaN", "None")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def zero(c: Column | str) -> Column:
    return F.coalesce(col(c).cast("double"), F.lit(0.0))


# --- text to numbers -----------------------------------------------------------------------------------------------


def clean_number(c: Column | str) -> Column:
    """thousands separators dropped; blanks, words and NaN are NULL."""
    x = F.replace(F.trim(col(c)), F.lit(","), F.lit("")).try_cast("double")
    return F.when(~F.isnan(x), x)


def _scaled(c: Column | str, factors: Sequence[tuple[str, float]], bare: float = 1.0) -> Column:
    """A number with an optional unit; ``factors`` are tried in order, longer units first."""
    s = F.lower(F.trim(F.replace(col(c).cast("string"), F.lit(","), F.lit(""))))
    number = lambda unit: F.left(s, F.greatest(F.length(s) - len(unit), F.lit(0))).try_cast("double")
    out = s.try_cast("double") * bare
    for unit, factor in reversed(factors):
        out = F.when(F.endswith(s, F.lit(unit)), number(unit) * factor).otherwise(out)
    return F.when(~F.isnan(out), out)


def to_ms(c: Column | str) -> Column:
    """us, ms, ns and s to milliseconds; a bare number is milliseconds; anything else NULL."""
    return _scaled(c, [("us", 1e-3), ("ms", 1.0), ("ns", 1e-6), ("s", 1e3)])


def to_mb(c: Column | str) -> Column:
    """K, M and G (an optional B after them) to megabytes; a bare number is megabytes."""
    s = F.regexp_replace(F.trim(col(c).cast("string")), "[bB]$", "")
    return _scaled(s, [("g", 1024.0), ("m", 1.0), ("k", 1 / 1024)])


def to_count(c: Column | str) -> Column:
    """K and M to plain counts."""
    return _scaled(c, [("k", 1e3), ("m", 1e6)])


def row_hash(columns: Sequence[str]) -> Column:
    """md5 of the values in order of column name, joined by ``|``; NULL is written ``None``."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in sorted(columns)]))


def sanitize(c: Column | str) -> Column:
    """words that stand for nothing become NULL."""
    return F.when(~col(c).isin(*NULL_WORDS), col(c))


def plan_size(c: Column | str, compat: bool = False) -> Column:
    """a row or byte count of a plan listing; ``26K`` is 26,000. ``compat`` drops the suffix instead."""
    s = F.trim(col(c))
    digits = F.nullif(F.regexp_extract(s, r"^(\d+)", 1), F.lit("")).try_cast("double")
    if compat:
        return digits
    # By the last letter's place: 0 for none, as for any other letter.
    return digits * F.pow(F.lit(1000.0), F.instr(F.lit("KMG"), F.upper(F.right(s, F.lit(1)))))


def plan_cost(c: Column | str, compat: bool = False) -> Column:
    """the cost cell without its ``(percent)``; ``compat`` makes a cost with a suffix NULL."""
    s = F.trim(F.regexp_replace(col(c), r"\(\s*\d*\s*\)", ""))
    return s.try_cast("double") if compat else plan_size(s)


# --- scores --------------------------------------------------------------------------------------------------------


def z_score(value: Column | str, mean: Column | str, sd: Column | str) -> Column:
    """F8: 0 where the deviation is missing or 0."""
    return F.when(zero(sd) == 0, F.lit(0.0)).otherwise((col(value) - col(mean)) / col(sd))


def z_severity(z: Column | str, threshold: float = 1.5, alert: float = 3.0, critical: float = 4.0) -> Column:
    """NULL below the threshold."""
    a = F.abs(col(z))
    return F.when(a >= critical, "critical").when(a >= alert, "alert").when(a >= threshold, "warning")


def wait_score(pct: Column | str) -> Column:
    """1 to 5 by share of database time."""
    p = col(pct)
    return F.when(p >= 20, 5).when(p >= 10, 4).when(p >= 5, 3).when(p >= 2, 2).otherwise(1)


def wait_blend(pct: Column | str, time_s: Column | str, avg_ms: Column | str, digits: int = 2) -> Column:
    """F11"""
    return F.round(0.5 * zero(pct) + 0.3 * zero(time_s) + 0.2 * zero(avg_ms), digits)


def wait_summary_blend(pct: Column | str, time_s: Column | str, avg_ms: Column | str, digits: int = 2) -> Column:
    """F12"""
    return F.round(0.7 * zero(pct) + 0.2 * zero(time_s) / 100 + 0.1 * zero(avg_ms) / 10, digits)


#: Weight and divisor of each statement metric (fixed values of the score).
SQL_WEIGHTS = {
    "elapsed": (0.25, 1.0),
    "cpu": (0.25, 1.0),
    "gets": (0.15, 1e4),
    "reads": (0.10, 1e3),
    "uio": (0.10, 1.0),
    "unopt": (0.05, 1e3),
    "parses": (0.05, 1e3),
    "cluster": (0.05, 1.0),
}
#: Weight of each segment metric (fixed values of the score).
SEGMENT_WEIGHTS = {
    "physical_reads": 0.15,
    "direct_reads": 0.10,
    "direct_writes": 0.10,
    "logical_reads": 0.10,
    "cr_blocks": 0.10,
    "cur_blocks": 0.10,
    "table_scans": 0.05,
    "unopt_reads": 0.05,
    "read_requests": 0.03,
    "write_requests": 0.03,
    "opt_reads": 0.02,
    "block_changes": 0.10,
    "row_lock_waits": 0.10,
    "itl_waits": 0.05,
    "buffer_busy": 0.10,
    "gc_buffer_busy": 0.05,
}
#: Segment metrics that count double in the plain sum.
SEGMENT_DOUBLE = ("physical_reads", "physical_writes", "direct_reads", "direct_writes")


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def sql_score(columns: dict[str, str] | None = None, digits: int = 4) -> Column:
    """weighted sum of the statement metrics at hand; missing ones count 0."""
    at = columns or {k: k for k in SQL_WEIGHTS}
    return F.round(_sum([w * zero(at[k]) / d for k, (w, d) in SQL_WEIGHTS.items() if k in at]), digits)


def segment_score_weighted(columns: Sequence[str], digits: int = 4) -> Column:
    """F14"""
    return F.round(_sum([w * zero(k) for k, w in SEGMENT_WEIGHTS.items() if k in columns]), digits)


def segment_score_sum(columns: Sequence[str], digits: int = 4) -> Column:
    """F15"""
    return F.round(_sum([zero(k) * (2 if k in SEGMENT_DOUBLE else 1) for k in columns]), digits)


def pct_change(before: Column | str, after: Column | str, digits: int = 1) -> Column:
    """F16: NULL where the value before is 0 or missing."""
    b = col(before)
    return F.round((col(after) - b) / F.nullif(b, F.lit(0)) * 100, digits)


# --- classes -------------------------------------------------------------------------------------------------------


def rag_fixed(score: Column | str) -> Column:
    """the closed ranges leave gaps (40.5, 79.5), which are green."""
    s = col(score)
    return F.when(s >= 80, "red").when(s.between(41, 79), "orange").when(s.between(11, 40), "yellow").otherwise("green")


def severity_order(severity: Column | str) -> Column:
    """F18"""
    s = F.lower(col(severity))
    return F.when(s == "critical", 1).when(s == "high", 2).when(s == "medium", 3).otherwise(4)


def wait_severity(pct: Column | str) -> Column:
    """F19"""
    p = col(pct)
    return F.when(p > 20, "critical").when(p > 10, "high").when(p > 5, "medium").otherwise("low")


def sql_severity(elapsed_s: Column | str) -> Column:
    """F19"""
    e = col(elapsed_s)
    return F.when(e > 3600, "critical").when(e > 300, "high").when(e > 60, "medium").otherwise("low")


def disk_status(util: Column | str, await_ms: Column | str) -> Column:
    """F19"""
    return F.when(col(util) >= 85, "critical").when(col(util) >= 60, "warning").when(col(await_ms) >= 50, "slow").otherwise("ok")


def sql_perf_class(elapsed_s: Column | str, executions: Column | str) -> Column:
    """by milliseconds an execution."""
    n = zero(executions)
    ms = zero(elapsed_s) / F.greatest(n, F.lit(1.0)) * 1000
    return F.when(n == 0, "not executed").when(ms < 10, "good").when(ms < 100, "acceptable").when(ms < 1000, "slow").otherwise("very slow")


def cache_hit_pct(physical: Column | str, logical: Column | str, digits: int = 1) -> Column:
    """F21"""
    return F.round((1 - zero(physical) / F.greatest(zero(logical), F.lit(1.0))) * 100, digits)


# --- texts ---------------------------------------------------------------------------------------------------------


def sql_normalise(c: Column | str) -> Column:
    """lower case without string literals, comments and repeated blanks."""
    s = F.regexp_replace(F.lower(col(c)), "'[^']*'", "")
    s = F.regexp_replace(F.regexp_replace(s, r"--[^\n]*", " "), r"(?s)/\*.*?\*/", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def snap_label(snap: Column | str, ts: Column | str) -> Column:
    """``123 - 2024-01-02 03:04``"""
    return F.concat(col(snap).cast("string"), F.lit(" - "), F.date_format(col(ts), "yyyy-MM-dd HH:mm"))


def snap_of_label(c: Column | str) -> Column:
    """F23"""
    return F.split_part(col(c), F.lit(" - "), F.lit(1)).try_cast("int")


def day_label(c: Column | str) -> Column:
    """``02-Jan-2024``"""
    return F.date_format(col(c), "dd-MMM-yyyy")


def day_of_label(c: Column | str) -> Column:
    """F23"""
    return F.to_date(col(c), "dd-MMM-yyyy")


def wildcard_match(value: Column | str, pattern: Column | str) -> Column:
    """``*`` is everything, ``prefix*`` a prefix, else equality; case does not count."""
    v, p = F.lower(F.trim(col(value))), F.lower(F.trim(col(pattern)))
    return F.when(p == "*", True).when(F.endswith(p, F.lit("*")), F.startswith(v, F.left(p, F.length(p) - 1))).otherwise(v == p)


def steps_text(c: Column | str) -> Column:
    """a JSON array of texts joined by `` | ``, other text as it is."""
    return F.coalesce(F.array_join(F.from_json(F.when(F.startswith(F.ltrim(col(c)), F.lit("[")), col(c)), "array<string>"), " | "), col(c))


def in_zone(ts: Column | str, zone: str) -> Column:
    """local time of a zone read as UTC."""
    return F.to_utc_timestamp(col(ts).cast("timestamp"), zone).cast("timestamp_ntz")


def last_named(names: str, cells: str) -> Column:
    """The map of names to cells; a repeated name keeps its last cell, cells or names beyond the shorter list are dropped."""
    n = F.least(F.size(names), F.size(cells))
    given = F.slice(names, F.lit(1), n)
    pairs = F.transform(given, lambda x, i: F.struct(x.alias("n"), F.get(cells, i).alias("c")))
    last = F.filter(pairs, lambda x, i: ~F.array_contains(F.slice(given, i + 2, F.greatest(n, F.lit(1))), x["n"]))
    whole = F.map_from_arrays(given, F.slice(cells, F.lit(1), n))
    once = F.map_from_entries(F.filter(last, lambda x: x["n"].isNotNull()))
    return F.when(F.size(F.array_distinct(given)) == n, whole).otherwise(once)


def try_clock(day: Column, time: Column, half: Column) -> Column:
    """The timestamp of a day (struct y, m, d), a time ``h:mm:ss`` and AM, PM or null; null if there is no such time."""
    part = lambda i: F.get(F.split(time, ":"), F.lit(i)).try_cast("int")
    hour = F.when(half.isNull(), part(0)).when(part(0).between(1, 12), part(0) % 12 + F.when(half == "PM", 12).otherwise(0))
    second = F.when(part(2) < 60, part(2))
    return F.try_make_timestamp_ntz(day["y"], day["m"], day["d"], hour, part(1), second)


MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def day_first_time(text: Column) -> Column:
    """A timestamp of a text that may have its day first (``03-May-24 10:00:05``, ``3/5/2024 10:00``, ``03.05.2024 1:00 PM``) or its year
    (``2024-05-03T10:00:05``). Where the second of three numbers can't be a month, the first is. Two-digit years lie in 1969 to 2068. Else null."""
    c = F.trim(text)
    number = lambda p, g: F.regexp_extract(c, p, g).try_cast("int")
    word = r"^(\d{1,2})[-/. ]+([A-Za-z]{3})[A-Za-z]*[-/., ]+(\d{4}|\d{2})(?!\d)"
    digits, year_first = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})(?!\d)", r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?!\d)"
    named = F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(c, word, 2))).cast("int"), F.lit(0))
    a, b = number(digits, 1), number(digits, 2)
    swapped = (b > 12) & (a <= 12)
    year = F.coalesce(number(word, 3), number(digits, 3), number(year_first, 1))
    year = F.when(year < 69, year + 2000).when(year < 100, year + 1900).otherwise(year)
    month = F.coalesce(named, F.when(swapped, a).otherwise(b), number(year_first, 2))
    day = F.coalesce(F.when(named.isNotNull(), number(word, 1)), F.when(swapped, b).otherwise(a), number(year_first, 3))
    clock = r"(?:[T ]+)(\d{1,2}:\d{2}(?::\d{2})?)(?:\.\d+)?\s*(?i:([AP]M))?\s*$"
    time = F.nullif(F.regexp_extract(c, clock, 1), F.lit(""))
    rest = F.regexp_replace(c, f"{word}|{digits}|{year_first}", "")
    time = F.when(F.trim(rest) == "", F.lit("0:00:00")).when(time.rlike("^\\d+:\\d+$"), F.concat(time, F.lit(":00"))).otherwise(time)
    half = F.upper(F.nullif(F.regexp_extract(c, clock, 2), F.lit("")))
    return try_clock(F.struct(year.alias("y"), month.alias("m"), day.alias("d")), time, half)
