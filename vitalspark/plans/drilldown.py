"""From statement texts to objects, and the focus drill-down."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import sql_normalise
from ..operators import joins, select

_NAME = r"(?:([a-z][a-z0-9_$#]*)\.)?([a-z][a-z0-9_$#]*)"
#: What stands before an object's name.
_PLACES = {
    "from": r"\b(?:from|join)\s+",
    "into": r"\binsert\s+into\s+",
    "update": r"\bupdate\s+",
    "delete": r"\bdelete\s+from\s+",
    "merge": r"\bmerge\s+into\s+",
}
_ANY = r"\b(?:from|join|insert\s+into|update|delete\s+from|merge\s+into)\s+" + _NAME
#: Words that may follow a place but are no object.
NOT_OBJECTS = ("select", "set", "dual", "table", "lateral", "only")


def sql_object_map(texts: DataFrame) -> DataFrame:
    """Distinct (sql_id, owner, object, has_owner) of the objects that statements name; owner is NULL where the text has none."""
    s = sql_normalise("sql_text")
    pairs = F.arrays_zip(
        F.regexp_extract_all(s, F.lit(_ANY), F.lit(1)).alias("o"), F.regexp_extract_all(s, F.lit(_ANY), F.lit(2)).alias("n")
    )
    d = texts.select("sql_id", F.explode(pairs).alias("p")).select(
        "sql_id", F.nullif("p.o", F.lit("")).alias("owner"), F.col("p.n").alias("object")
    )
    return d.where(~F.col("object").isin(*NOT_OBJECTS)).distinct().withColumn("has_owner", F.col("owner").isNotNull())


def rule_text_pick(facts: DataFrame, rules: DataFrame, category: str, key: str) -> DataFrame:
    """The rule text of the exact key, else of ``*``, by category. ``rules``: category, rule_key, rule_text."""
    r = rules.groupBy(F.lower("category").alias("__c"), F.lower("rule_key").alias("__k")).agg(F.min("rule_text").alias("t"))
    exact = r.select("__c", "__k", F.col("t").alias("t1"))
    wild = r.where("__k = '*'").select(F.col("__c").alias("__c2"), F.col("t").alias("t2"))
    j = facts.join(
        exact, (F.lower(F.col(category)) == F.col("__c")) & (F.lower(F.col(key).cast("string")) == F.col("__k")), "left"
    ).join(wild, F.lower(F.col(category)) == F.col("__c2"), "left")
    return j.select(*facts.columns, F.coalesce("t1", "t2").alias("rule_text"))


def focus_drilldown(
    statements: DataFrame, segments: DataFrame, waits: DataFrame, bridge: DataFrame, focus: str, value, k: int = 10
) -> DataFrame:
    """What goes with a focus, as (section, item, amount) rows, best ``k`` of each section.

    ``X_together``: entities of the snapshots in which the focus occurs, by the sum of score products. ``segment_text`` (focus ``sql``): segments
    that the text names. ``sql_text``: statements by mean score that name the focused segment, the segments named by the focused statement, or
    the best segments that go with the focused wait. Scored inputs: dbname, instance, begin_snap, entity, score; ``bridge``: sql_id, owner, object."""
    keys = ["dbname", "instance", "begin_snap"]
    entity = {"sql": "sql_id", "segment": "object_name", "wait": "event"}
    sides = {"sql": statements, "segment": segments, "wait": waits}
    own = sides[focus].where(F.col(entity[focus]) == value)
    snaps = own.groupBy(*keys).agg(F.sum("score").alias("w"))
    objects = segments.groupBy("owner", F.col("object_name").cast("string").alias("object")).agg(F.avg("score").alias("amount"))
    parts = {}
    for name, df in sides.items():
        if name != focus:
            amount = F.sum(F.col("score") * F.col("w")).alias("amount")
            parts[f"{name}_together"] = df.join(snaps, keys).groupBy(F.col(entity[name]).cast("string").alias("item")).agg(amount)
    if focus == "sql":
        objects = joins.object_bridge(bridge.where(F.col("sql_id") == value), objects)
        parts["segment_text"] = objects.groupBy(F.col("object").alias("item")).agg(F.max("amount").alias("amount"))
    elif focus == "segment":
        objects = objects.where(F.col("object") == F.lit(value).cast("string"))
    else:
        best = select.top_k(parts["segment_together"], k, F.desc("amount"), F.col("item"))
        objects = objects.join(best.select(F.col("item").alias("object")), "object", "left_semi")
    named = joins.object_bridge(bridge, objects.select("owner", "object").distinct()).select("sql_id").distinct()
    named = named.where(F.col("sql_id") != value) if focus == "sql" else named
    scores = statements.join(named, "sql_id", "left_semi").groupBy(F.col("sql_id").cast("string").alias("item"))
    parts["sql_text"] = scores.agg(F.avg("score").alias("amount"))
    best = [
        select.top_k(d, k, F.desc("amount"), F.col("item")).select(F.lit(n).alias("section"), "item", "amount") for n, d in parts.items()
    ]
    return reduce(DataFrame.union, best)


#: FIXED titles and places of the sections.
TITLES = {
    "segment_together": (3, "Top Segments"),
    "segment_text": (3, "Segments referenced by SQL"),
    "sql_together": (4, "SQLs of the same snapshots"),
    "sql_text": (4, "Top SQLs referencing segments"),
    "wait_together": (5, "Top Waits (window)"),
}
NO_RULE = "No recommendation found for this selection."


def drilldown_text(found: DataFrame, focus: str, value, rules: DataFrame) -> DataFrame:
    """X9 as a drawer shows it: (ord, section, value) with the focus first, each section's items as bullets by amount, and the rule's text
    last. ``found``: the result of focus_drilldown, whose sections hold at most ``k`` items each."""
    items = F.array_sort(F.collect_list(F.struct((-F.col("amount")).alias("down"), "item")))
    bullets = F.transform(items, lambda x: F.format_string("• %s [%.2f]", x["item"], -x["down"]))
    titles = F.create_map(
        *[x for n, (at, t) in TITLES.items() for x in (F.lit(n), F.struct(F.lit(at).alias("ord"), F.lit(t).alias("title")))]
    )
    body = found.groupBy("section").agg(F.array_join(bullets, "\n").alias("value")).withColumn("t", titles[F.col("section")])
    body = body.select("t.ord", F.col("t.title").alias("section"), "value")
    one = found.sparkSession.range(1).select(F.lit(focus).alias("category"), F.lit(str(value)).alias("key"))
    head = one.select(F.lit(1).alias("ord"), F.lit("Focus").alias("section"), F.concat("category", F.lit(": "), "key").alias("value"))
    rule = F.coalesce("rule_text", F.lit(NO_RULE)).alias("value")
    last = rule_text_pick(one, rules, "category", "key").select(F.lit(9).alias("ord"), F.lit("Recommendation").alias("section"), rule)
    return head.union(body).union(last)
