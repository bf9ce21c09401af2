"""Problems, comparison and warnings of execution plans."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import joins, select

KEYS = ("path", "plan_no")
FULL_SCAN = "(contains(upper(operation), 'TABLE ACCESS FULL') OR contains(upper(operation), 'FIXED TABLE FULL'))"
#: pattern -> condition on a step, severity.
PROBLEMS = {
    "full scan": (FULL_SCAN, "high"),
    "large fast full scan": ("contains(upper(operation), 'INDEX FAST FULL SCAN') AND rows > 10000", "medium"),
    "large nested loop": ("contains(upper(operation), 'NESTED LOOPS') AND rows > 1000", "medium"),
    "high cost": ("cost > 10000", "high"),
    "unbounded full scan": (f"{FULL_SCAN} AND predicate IS NULL", "critical"),
}
#: Operations whose coming or going changes the verdict on a plan.
FULL_OPERATIONS = ("TABLE ACCESS FULL", "FIXED TABLE FULL", "INDEX FAST FULL SCAN")


def plan_problems(steps: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row a (plan, pattern, step), of equal messages (first 40 characters) the first step. One pass: the patterns a step matches are an array."""
    hits = F.filter(
        F.array(*[F.when(F.expr(c), F.struct(F.lit(p).alias("pattern"), F.lit(s).alias("severity"))) for p, (c, s) in PROBLEMS.items()]),
        lambda x: x.isNotNull(),
    )
    d = steps.select(
        *keys, "step_id", "operation", "object_name", "rows", "cost", F.explode(hits).alias("p")
    ).select("*", "p.pattern", "p.severity").drop("p")
    d = d.withColumn("message", F.concat_ws(" ", "operation", F.lit("on"), F.coalesce("object_name", F.lit("?"))))
    return select.newest_by(
        d.withColumn("short", F.left("message", F.lit(40))), [*keys, "pattern", "short"], F.col("step_id")
    ).drop("short")


#: What comparisons read of a step.
COMPARED = ("operation", "object_name", "cost")


def _each(plans: DataFrame, keys: Sequence[str], *more: str) -> DataFrame:
    """One row a pair of ``paired_steps``, and columns of the plan."""
    side = lambda s: [F.col(f"p.{s}.{c}").alias(f"{n}_{s}") for c, n in zip(("step_id", *COMPARED), ("step", "operation", "object", "cost"))]
    return plans.select(*keys, *more, F.explode("pairs").alias("p")).select(*keys, *more, *side("before"), *side("after"), "p.how")


def plan_compare(before: DataFrame, after: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Matched steps with costs, change in percent and status (same, changed, removed, added). Each side is read once."""
    j = _each(joins.paired_steps(before, after, keys, COMPARED), keys)
    changed = (F.col("how") == "moved") | ~F.col("cost_before").eqNullSafe(F.col("cost_after"))
    status = F.when(F.col("how").isin("removed", "added"), F.col("how")).when(changed, "changed").otherwise("same")
    return j.withColumns(
        {
            "cost_delta": F.col("cost_after") - F.col("cost_before"),
            "cost_pct": (F.col("cost_after") - F.col("cost_before")) / F.nullif("cost_before", F.lit(0.0)) * 100,
            "status": status,
        }
    )


def _is_full(operation: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.upper(operation), F.lit(o)) for o in FULL_OPERATIONS])


def _full_scans() -> Column:
    return F.when(F.col("full_before") & ~F.col("full_after"), "removed").when(~F.col("full_before") & F.col("full_after"), "introduced")


def plan_verdict(before: DataFrame, after: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Total cost (that of the first step) before and after, change, percent, whether it fell, and whether full scans came or went. Each side is
    reduced to a row a plan as it is read."""
    full = _is_full(F.col("operation"))
    side = lambda df, s: df.groupBy(*keys).agg(F.min_by("cost", "step_id").alias(f"total_{s}"), F.max(full).alias(f"full_{s}"))
    j = side(before, "before").join(side(after, "after"), list(keys))
    change = F.col("total_after") - F.col("total_before")
    pct = F.when(F.col("total_before") > 0, change / F.col("total_before") * 100)
    return j.withColumns(
        {"cost_change": change, "cost_pct_change": pct, "improved": F.col("total_after") < F.col("total_before"), "full_scans": _full_scans()}
    )


def problem_changes(before: DataFrame, after: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """X14, (keys, change, problem): full scans that are ``new`` or ``fixed``, of the plan as a whole, and step by step where that is not said by the
    whole already (a step's scan is new only if the plan had none); and ``access``: steps whose operation or object changed to an operation that no step
    of the plan had before. All of it comes from one row a plan that holds both sides' pairs of steps, so each side is read once."""
    of = lambda s: F.filter(F.col("pairs")[s], lambda x: x.isNotNull())
    p = joins.paired_steps(before, after, keys, COMPARED).withColumns({"had": of("before"), "has": of("after")})
    # None of a step's operations may be known: as a maximum over them, null is passed over.
    any_full = lambda c: F.array_max(F.transform(c, lambda x: _is_full(x["operation"])))
    both = (F.size("had") > 0) & (F.size("has") > 0)
    p = p.withColumns({"full_before": F.when(both, any_full("had")), "full_after": F.when(both, any_full("has"))})
    p = p.withColumn("ops", F.filter(F.transform("had", lambda x: F.upper(x["operation"])), lambda x: x.isNotNull()))
    row = lambda when, change, *problem: F.when(when, F.struct(F.lit(change).alias("change"), F.concat(*problem).alias("problem")))
    title = lambda s: F.lit(f"Full table scan {s}")
    scans = _full_scans()
    whole = [row(scans == "removed", "fixed", title("removed")), row(scans == "introduced", "new", title("introduced"))]
    obj = lambda x: F.coalesce(x["object_name"], F.lit("None"))
    name = lambda x: F.concat(x["operation"], F.lit(" ("), obj(x), F.lit(")"))

    def steps(x: Column) -> Column:
        b, a = x["before"], x["after"]
        full = lambda s: F.contains(F.upper(s["operation"]), F.lit("FULL"))
        gone = full(b) & ~full(a) & ~(F.col("full_before") & ~F.col("full_after"))
        come = ~full(b) & full(a) & ~F.col("full_before")
        unknown = both & ~F.exists("ops", lambda o: F.contains(o, F.upper(a["operation"])))
        return F.array(
            row(gone, "fixed", F.lit("Full scan removed: "), b["operation"], F.lit(" on "), obj(b), F.lit(" -> "), a["operation"]),
            row(come, "new", F.lit("New full scan: "), a["operation"], F.lit(" on "), obj(a)),
            row(unknown, "access", name(b), F.lit(" -> "), name(a)),
        )

    moved = F.flatten(F.transform(F.filter("pairs", lambda x: x["how"] == "moved"), steps))
    found = p.select(*keys, F.explode(F.filter(F.concat(F.array(*whole), moved), lambda x: x.isNotNull())).alias("c"))
    return found.select(*keys, "c.change", "c.problem")


def metadata_warnings(steps: DataFrame, meta: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Warnings and INFO rows for the objects a plan uses, one row a (plan, object, pattern). Objects without metadata give none.

    ``meta``: object_name, object_type, num_rows, analysed_days, blevel, clustering_factor, index_columns (JSON), uniqueness, partition_type, and
    dbname, by which plans are matched too where the steps have it. Thresholds: FIXED values of the reference."""
    on = ["dbname"] if "dbname" in steps.columns and "dbname" in meta.columns else []
    own = steps.where("object_name is not null").select(*{k: 0 for k in (*keys, *on)}, F.upper("object_name").alias("__n")).distinct()
    known = meta.withColumn("__n", F.upper(F.col("object_name").cast("string"))).drop(*[k for k in keys if k not in on])
    j = own.join(known, [*on, "__n"])
    index, table = F.col("object_type") == "INDEX", F.col("object_type") == "TABLE"
    ratio = F.col("clustering_factor") / F.nullif(F.col("num_rows").cast("double"), F.lit(0.0))
    columns = F.array_join(
        F.transform(F.from_json("index_columns", "array<struct<col:string>>"), lambda x: F.coalesce(x["col"], F.lit(""))), ", "
    )
    grade = lambda high: F.when(high, "HIGH").otherwise("MEDIUM")
    name = F.col("object_name").cast("string")
    row = lambda severity, pattern, *detail: F.struct(
        severity.alias("severity"), F.lit(pattern).alias("pattern"), F.concat(name, *detail).alias("detail")
    )
    whole = lambda c: F.col(c).cast("long").cast("string")
    days, level = F.col("analysed_days"), F.col("blevel")
    rules = [
        F.when(days.isNull(), row(F.lit("HIGH"), "Missing Statistics", F.lit(": never analyzed"))),
        F.when(
            days > 30, row(grade(days > 90), "Stale Statistics", F.lit(": last analyzed "), whole("analysed_days"), F.lit(" days ago"))
        ),
        F.when(
            index & (ratio > 0.8),
            row(
                grade(ratio > 1.5),
                "High Clustering Factor",
                F.lit(": clustering_factor="),
                whole("clustering_factor"),
                F.lit(" / num_rows="),
                whole("num_rows"),
            ),
        ),
        F.when(index & (level >= 4), row(grade(level >= 5), "Deep B-tree Index", F.lit(": blevel="), whole("blevel"))),
        F.when(
            index & columns.isNotNull(),
            row(
                F.lit("INFO"),
                "Index Definition",
                F.lit(" ["),
                F.coalesce("uniqueness", F.lit("None")),
                F.lit("]: ("),
                columns,
                F.lit(")"),
            ),
        ),
        F.when(
            table & (F.col("num_rows") > 0),
            row(
                F.lit("INFO"),
                "Table Size",
                F.lit(": "),
                whole("num_rows"),
                F.lit(" rows, "),
                F.coalesce(F.concat(F.lit("partitioned ("), "partition_type", F.lit(")")), F.lit("unpartitioned")),
            ),
        ),
    ]
    out = j.select(*keys, "object_name", F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("w"))
    return out.select(*keys, "object_name", "w.severity", "w.pattern", "w.detail")
