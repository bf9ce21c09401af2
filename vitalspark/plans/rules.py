"""Rule-based recommendations (X4) and metadata rules.

Rules are rows: rule_id, category, pattern, condition, severity, title. A condition is a SQL expression over the category's allow-listed
column names; it is checked word by word before it becomes an expression, so a rule can compare and combine numbers and nothing else.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import severity_order, wildcard_match
from ..operators import select

#: Names that a category's conditions may use.
CONTEXT = {
    "wait": ("pct_db_time", "avg_wait_ms", "total_waits"),
    "sql": ("elapsed_time_s", "cpu_time_s", "parse_calls", "executions", "parse_calls_pct"),
    "instance_efficiency": ("value",),
    "segment": ("logical_reads", "physical_reads", "physical_writes", "row_lock_waits", "table_scans", "gc_buffer_busy", "pcttotal"),
}
_WORDS = {"and", "or", "not", "between", "in", "is", "null"}
_TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d+)?)|([A-Za-z_]\w*)|(<=|>=|<>|!=|==|[-+*/<>=(),]))")


@dataclass(frozen=True)
class Rule:
    rule_id: str
    category: str
    pattern: str
    condition: str
    severity: str
    title: str
    root_cause: str = ""
    resolution: tuple[str, ...] = ()
    diagnostic_sql: tuple[str, ...] = ()
    related: tuple[str, ...] = ()


def compile_condition(text: str, names: Sequence[str]) -> Column:
    """The expression of a condition; ValueError for anything but numbers, operators and the allowed names."""
    out, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not allowed in a condition: {text[at:]!r}")
        at = m.end()
        number, word, sign = m.groups()
        if word and word.lower() not in _WORDS and word not in names:
            raise ValueError(f"unknown name in a condition: {word}")
        out.append({"==": "="}.get(sign, sign) or word or f"{number}D")
    if not out:
        raise ValueError("empty condition")
    return F.expr(" ".join(out))


def apply_rules(facts: DataFrame, rules: Sequence[Rule], category: str, entity: str, keys: Sequence[str]) -> DataFrame:
    """X4, one category: the first matching rule of each row, in order of the rules. One pass over the facts, however many rules."""
    own = [r for r in rules if r.category == category]
    if not own:
        return facts.where(F.lit(False)).select(
            *keys,
            F.lit("").alias("rule_id"),
            F.lit("").alias("severity"),
            F.lit("").alias("title"),
            F.col(entity).cast("string").alias("entity"),
        )
    hit = lambda r: wildcard_match(F.col(entity).cast("string"), F.lit(r.pattern)) & F.coalesce(
        compile_condition(r.condition, CONTEXT[category]), F.lit(False)
    )
    first = F.coalesce(
        *[
            F.when(
                hit(r), F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.title).alias("title"))
            )
            for r in own
        ]
    )
    return facts.withColumn("__r", first).where("__r is not null").select(*keys, "__r.*", F.col(entity).cast("string").alias("entity"))


def recommendations(
    parts: dict[str, tuple[DataFrame, str]], rules: Sequence[Rule], keys: Sequence[str], min_severity: str = "medium", dedup: bool = True
) -> DataFrame:
    """Findings of all categories, at least ``min_severity``, by severity; with ``dedup`` one row a (keys, rule_id): the smallest entity.
    ``parts``: category -> (facts, entity column)."""
    found = [apply_rules(df, rules, c, entity, keys).withColumn("category", F.lit(c)) for c, (df, entity) in parts.items()]
    out = reduce(lambda a, b: a.unionByName(b), found)
    least = {"critical": 1, "high": 2, "medium": 3}.get(min_severity, 4)
    out = out.where(severity_order("severity") <= least)
    if dedup:
        out = out.groupBy(*keys, "rule_id").agg(
            F.min(F.struct("entity", "severity", "title", "category")).alias("r"), F.count("*").alias("hits")
        ).select(*keys, "rule_id", "r.*", "hits")
    return out.orderBy(severity_order("severity"), "rule_id", *keys)


#: FIXED names: what a pattern of a statement, efficiency or segment rule measures.
SQL_PATTERNS = {"high_elapsed_time": "elapsed_time_s", "high_cpu": "cpu_time_s", "high_parse_calls": "parse_calls"}
EFFICIENCY_PATTERNS = {
    "buffer_cache_hit_ratio": ("Buffer Cache Hit Ratio", "Buffer Nowait %"),
    "soft_parse_ratio": ("Soft Parse %",),
    "library_cache_hit_ratio": ("Library Cache Hit Ratio", "Library Hit %"),
    "execute_to_parse_ratio": ("Execute to Parse %",),
}
SEGMENT_PATTERNS = {
    "high_logical_reads": "logical_reads",
    "high_physical_reads": "physical_reads",
    "high_table_scans": "table_scans",
    "high_row_lock_waits": "row_lock_waits",
    "high_gc_buffer_busy": "gc_buffer_busy",
}
TOP_SQL, TOP_SEGMENTS = 5, 3


def _hits(df: DataFrame, rules: Sequence[Rule], category: str, keys: Sequence[str], entity: Column, value: Column) -> DataFrame:
    """Every rule whose condition holds on a row of ``pattern`` and the category's names, with the rule's own texts."""
    own = lambda r: F.struct(
        F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.title).alias("title"), F.lit(r.root_cause).alias("root_cause"),
        *[F.array(*map(F.lit, x)).cast("array<string>").alias(n) for n, x in (("resolution", r.resolution), ("diagnostic_sql", r.diagnostic_sql), ("related_rules", r.related))]
    )
    hit = lambda r: (F.col("pattern") == r.pattern) & F.coalesce(compile_condition(r.condition, CONTEXT[category]), F.lit(False))
    none = F.when(F.lit(False), own(Rule("", category, "", "0 = 1", "", "")))  # gives the type where there are no rules
    found = F.array_compact(F.array(none, *[F.when(hit(r), own(r)) for r in rules]))
    return df.select(*keys, F.lit(category).alias("category"), entity.cast("string").alias("entity"), value.cast("double").alias("value"), F.explode(found).alias("r")).select(
        *keys, "category", "entity", "value", "r.*"
    )


def statement_findings(statements: DataFrame, rules: Sequence[Rule], keys: Sequence[str], k: int = TOP_SQL) -> DataFrame:
    """The first rule of each pattern on the ``k`` statements that lead in the pattern's metric. ``statements``: keys, sql_id, elapsed_time_s, cpu_time_s,
    parse_calls, executions. A condition sees the pattern's metric, executions and parse calls for each hundred executions; other metrics are 0."""
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("pattern"), zero(m).alias("value")) for p, m in SQL_PATTERNS.items()]))
    d = statements.select(*keys, "sql_id", zero("executions").alias("executions"), each.alias("m")).select(*keys, "sql_id", "executions", "m.*")
    d = select.top_k_per_group(d, [*keys, "pattern"], k, F.desc("value"), F.col("sql_id")).withColumns(
        {m: F.when(F.col("pattern") == p, F.col("value")).otherwise(0.0) for p, m in SQL_PATTERNS.items()}
    )
    d = d.withColumn("parse_calls_pct", F.col("parse_calls") / F.greatest(F.col("executions"), F.lit(1.0)) * 100)
    first = {r.pattern: r for r in reversed(rules) if r.category == "sql"}
    return _hits(d, [r for r in rules if first.get(r.pattern) is r and r.pattern in SQL_PATTERNS], "sql", keys, F.col("sql_id"), F.col("value"))


def efficiency_findings(efficiency: DataFrame, rules: Sequence[Rule], keys: Sequence[str]) -> DataFrame:
    """Rules on ratios: the first of a pattern's metric names that the keys have. ``efficiency``: keys, metric, value; a repeated metric is averaged."""
    own = [r for r in rules if r.category == "instance_efficiency"]
    wanted = {r.pattern: EFFICIENCY_PATTERNS.get(r.pattern, (r.pattern,)) for r in own}
    places = [F.struct(F.lit(p).alias("pattern"), F.lit(i).alias("place"), F.lit(m).alias("m")) for p, ms in wanted.items() for i, m in enumerate(ms)]
    means = efficiency.groupBy(*keys, "metric").agg(F.coalesce(F.avg("value"), F.lit(0.0)).alias("value"))
    named = F.filter(F.array(*places), lambda x: x["m"] == F.col("metric")) if places else F.array().cast("array<struct<pattern:string,place:int,m:string>>")
    d = means.select(*keys, "value", F.explode(named).alias("x")).groupBy(*keys, "x.pattern").agg(F.min_by("value", "x.place").alias("value"))
    return _hits(d, own, "instance_efficiency", keys, F.col("pattern"), F.col("value"))


def segment_findings(segments: DataFrame, rules: Sequence[Rule], keys: Sequence[str], k: int = TOP_SEGMENTS) -> DataFrame:
    """Every rule on the ``k`` segments that lead in its pattern's metric. ``segments``: keys, owner, object_name, metric, value, pct, one row each.
    A condition sees the value under any of the metrics' names, and ``pcttotal``."""
    metrics = {m: p for p, m in SEGMENT_PATTERNS.items()}
    d = segments.where(F.col("metric").isin(*metrics)).withColumn("value", F.coalesce(F.col("value").cast("double"), F.lit(0.0)))
    d = select.top_k_per_group(d, [*keys, "metric"], k, F.desc("value"), F.col("owner"), F.col("object_name"))
    names = {m: F.col("value") for m in CONTEXT["segment"] if m != "pcttotal"}
    pattern = F.create_map(*[F.lit(x) for pair in metrics.items() for x in pair])[F.col("metric")]
    d = d.withColumns({**names, "pcttotal": F.coalesce(F.col("pct").cast("double"), F.lit(0.0)), "pattern": pattern})
    entity = F.concat_ws(".", F.coalesce(F.col("owner").cast("string"), F.lit("")), F.coalesce(F.col("object_name").cast("string"), F.lit("")))
    own = [r for r in rules if r.category == "segment" and r.pattern in SEGMENT_PATTERNS]
    return _hits(d, own, "segment", keys, entity, F.col("value"))


def wait_findings(waits: DataFrame, rules: Sequence[Rule], keys: Sequence[str]) -> DataFrame:
    """The first rule that fits each event. ``waits``: keys, event, pct_db_time, avg_wait_ms, total_waits; nulls are 0."""
    own = [r for r in rules if r.category == "wait"]
    d = waits.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in CONTEXT["wait"]})
    first = apply_rules(d, own, "wait", "event", [*keys, "pct_db_time"]).select(*keys, "pct_db_time", "entity", F.col("rule_id").alias("pattern"))
    by_id = [replace(r, pattern=r.rule_id, condition="1 = 1") for r in own]
    return _hits(first, by_id, "wait", keys, F.col("entity"), F.col("pct_db_time"))


def all_findings(
    waits: DataFrame, statements: DataFrame, efficiency: DataFrame, segments: DataFrame, rules: Sequence[Rule], keys: Sequence[str],
    min_severity: str = "medium", dedup: bool = True
) -> DataFrame:
    """X4 whole: findings of waits, leading statements, ratios and leading segments with cause, steps, diagnostic SQL and related rules, at least
    ``min_severity``. With ``dedup`` one row a (keys, rule_id): that of the greatest value, then the smallest entity. Rows are in order of severity."""
    found = [
        wait_findings(waits, rules, keys), statement_findings(statements, rules, keys), efficiency_findings(efficiency, rules, keys),
        segment_findings(segments, rules, keys)
    ]
    out = reduce(DataFrame.unionByName, found)
    least = {"critical": 1, "high": 2, "medium": 3}.get(min_severity, 4)
    out = out.where(severity_order("severity") <= least)
    if dedup:
        rest = [c for c in out.columns if c not in {*keys, "rule_id"}]
        out = out.groupBy(*keys, "rule_id").agg(
            F.min_by(F.struct(*rest), F.struct((-F.col("value")).alias("down"), "entity")).alias("r"), F.count("*").alias("hits")
        ).select(*keys, "rule_id", "r.*", "hits")
    return out.orderBy(severity_order("severity"), "rule_id", *keys)


def metadata_rules(meta: DataFrame, keys: Sequence[str] = ("owner", "object_name")) -> DataFrame:
    """(keys, rule, severity) of objects with stale or missing statistics, poor clustering, deep indexes, missing partitions or compression.
    ``meta``: object_type, num_rows, analysed_days, clustering_factor, blevel, partition_type, compression. One pass: an array of the matches."""
    table, rows = F.col("object_type") == "TABLE", F.col("num_rows")
    ratio = F.col("clustering_factor") / F.nullif(rows, F.lit(0.0))
    graded = lambda rule, high, medium: F.when(high, F.struct(F.lit(rule).alias("rule"), F.lit("high").alias("severity"))).when(
        medium, F.struct(F.lit(rule).alias("rule"), F.lit("medium").alias("severity"))
    )
    never = F.lit(False)
    rules = F.array(
        graded("missing statistics", F.col("analysed_days").isNull(), never),
        graded("stale statistics", F.col("analysed_days") > 90, F.col("analysed_days") > 30),
        graded("clustering", ~table & (ratio > 1.5), ~table & (ratio > 0.8)),
        graded("index depth", ~table & (F.col("blevel") >= 5), ~table & (F.col("blevel") >= 4)),
        graded(
            "not partitioned",
            table & F.col("partition_type").isNull() & (rows > 1e8),
            table & F.col("partition_type").isNull() & (rows > 1e7),
        ),
        graded("not compressed", never, table & F.col("compression").isNull() & (rows > 5e7)),
    )
    return meta.select(*keys, F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("r")).select(*keys, "r.*")
