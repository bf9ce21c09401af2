"""Plan listings at size: lines stay in their file's row, and comparisons read each side once."""

from vitalspark import fixture_texts as ft
from vitalspark.plans import listings
from vitalspark.sources import plan_text

HEAD = "| Id | Operation | Name | Rows | Bytes | Cost |\n"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_not_shuffled(spark):
    files = spark.createDataFrame([("f", "SQL_ID a\n")], "path string, content string")
    plan = physical(plan_text.plan_steps(files))
    assert "Window" not in plan and plan.count("Exchange") == 1 and "Exchange" not in physical(plan_text.plans(files))


def test_listing_texts_are_dealt_once(spark, sf_dir):
    assert physical(ft.plan_texts(spark, sf_dir)).count("Exchange") == 1


def test_what_headings_hold(spark):
    """Headings, header lines and step numbers hold for the lines behind them, in the same plan only; lines end with or without a carriage return."""
    text = (
        "lost\n| 9 | LOST |\nSQL_ID a\nselect\n--\n | b\nPlan hash value: 7 Plan hash value: 9\n| 8 | NO HEADER |\n" + HEAD + "|* 1 |  SCAN | T | 2K | 3 | 4 (5)|\n"
        "Predicate Information\n---\nlost\n 1 - x\n\n   y\n 99999999999 - z\nNote\n - n1\nno\n - n2\nPredicate Information\n 2 - late\n 1 - w\n"
        "| Operation | Name | Id |\n| 5 | U |\n  SQL_ID b\n| 1 | OTHER |\nPlan hash value: x\n"
    )
    for end in ("\n", "\r\n"):
        files = spark.createDataFrame([("f", text.replace("\n", end))], "path string, content string")
        a, b = plan_text.plans(files).orderBy("plan_no").collect()
        assert (a["sql_id"], a["plan_hash_value"], a["sql_text"], a["notes"]) == ("a", "7", "select | b", "n1; n2")
        assert [(s["step_id"], s["depth"], s["operation"], s["object_name"], s["rows"], s["cost"]) for s in a["steps"]] == [
            (1, 1, "SCAN", "T", 2000.0, 4.0), (5, 0, "5", "U", None, None),
        ]
        assert [(p["step_id"], p["t"]) for p in a["predicates"]] == [(1, "x"), (1, "y"), (1, "z"), (2, "late"), (1, "w"), (1, "| Operation | Name | Id |"), (1, "| 5 | U |")]
        assert (b["plan_no"], b["sql_id"], b["plan_hash_value"], b["steps"], b["predicates"]) == (2, "b", None, [], [])
        steps = {r["step_id"]: r["predicate"] for r in plan_text.plan_steps(files).collect()}
        assert steps == {1: "x y z w | Operation | Name | Id | | 5 | U |", 5: None}


def test_comparisons_read_each_side_once(spark):
    side = lambda n: spark.createDataFrame([("p", 1, "SCAN", "T", 1.0)], "path string, step_id int, operation string, object_name string, cost double").where(f"step_id < {n}")
    for out in (listings.plan_compare(side(7), side(8), ["path"]), listings.problem_changes(side(7), side(8), ["path"])):
        plan = physical(out)
        assert plan.count("Scan ") == 2 and "Join" not in plan and plan.count("Exchange") == 1


def test_equal_step_numbers_of_a_plan_multiply_nothing(spark):
    """Two rows of one step number, and a plan without a key, keep their own columns."""
    schema = "path string, step_id int, operation string, object_name string, cost double"
    before = spark.createDataFrame([("p", 1, "SCAN", "T", 1.0), ("p", 1, "SORT", None, 2.0), (None, 1, "SCAN", "T", 5.0)], schema)
    after = spark.createDataFrame([("p", 1, "SCAN", "T", 4.0), (None, 1, "SCAN", "T", 6.0)], schema)
    got = listings.plan_compare(before, after, ["path"]).collect()
    assert sorted((str(r["path"]), r["operation_before"], r["cost_before"], r["cost_after"], r["status"]) for r in got) == [
        ("None", "SCAN", 5.0, 6.0, "changed"), ("p", "SCAN", 1.0, 4.0, "changed"), ("p", "SORT", 2.0, None, "removed"),
    ]


def test_steps_read_as_arrays_are_those_read_line_by_line(spark):
    """``plan_steps`` and ``plans`` agree on headers in any order, repeated, cut and reopened, odd blanks, predicates of several sections, and files without plans."""
    texts = [
        "x\n| 1 | LOST |\n" + "SQL_ID a\n\t SQL_ID: zz\n| Id | Operation | Name |\n| 1 | A | T |\n|*  2 |  B \n| 3 |\n| x | C |\n  |4\t|   D | U | extra |\n"
        "| Name | Operation | Name | Cost | Cost (%CPU) |\n|7|E|n|5|6 (1)|\n|8|F|n|5|\n| Operations | no |\n Plan hash value: 3 Plan hash value: 9\n"
        "Predicate Information\n----\n 2 - p\n\n  | 5 | q |\n 7 - r\n Note \n 2 - no\nPredicate Information\n lost\n 2 - s\n  SQL_ID b\n| 1 | NO HEADER |\n 2 - t\n",
        None, "", "nothing", "SQL_ID", "SQL_ID c\r\n| Id | Operation | Rows |\r\n| 1 | \u00e9 | 2K |\r\nSQL_ID c\r\n| 1 | Z |\r\nfoo SQL_ID d\r\n",
    ]
    files = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, content string")
    each = "path", "plan_no", "sql_id", "plan_hash_value"
    want = []
    for r in plan_text.plans(files).collect():
        said = {}
        for x in r["predicates"]:
            said.setdefault(x["step_id"], []).append(x["t"])
        want += [(*(r[c] for c in each), *s, " ".join(said[s["step_id"]]) if s["step_id"] in said else None) for s in r["steps"]]
    got = [tuple(r) for r in plan_text.plan_steps(files).collect()]
    assert len(want) == 8 and sorted(got, key=repr) == sorted(want, key=repr)
    few = plan_text.plan_steps(files, columns=("cost", "sql_id"), dealt=False)
    assert few.columns == ["path", "sql_id", "cost"] and "Exchange" not in physical(few)
    assert sorted(map(tuple, few.collect()), key=repr) == sorted(((w[0], w[2], w[10]) for w in want), key=repr)


def test_pairs_are_made_within_a_row(spark):
    """A plan's steps are gathered by one aggregate; unknown operations and repeated steps are paired in order."""
    schema = "path string, step_id int, operation string, object_name string, cost double"
    before = spark.createDataFrame([("p", 1, "a", None, 1.0), ("p", 2, "A", "", 2.0), ("p", 3, None, "t", 3.0), ("p", 4, "b", "t", 4.0)], schema)
    after = spark.createDataFrame([("p", 5, "A", None, 5.0), ("p", 6, None, "T", 6.0), ("p", 7, "c", "t", 7.0)], schema)
    out = listings.plan_compare(before, after, ["path"])
    got = sorted((r["step_before"] or 0, r["step_after"] or 0, r["how"]) for r in out.collect())
    assert got == [(1, 5, "same"), (2, 7, "moved"), (3, 6, "same"), (4, 0, "removed")]
    assert physical(listings.plan_compare(before, after, ["path"])).count("ObjectHashAggregate") <= 2


def test_pairs_are_finished_before_they_are_exploded(spark):
    """No expression of the pairing stands in the plan behind the shuffle: in the filter that Spark infers from ``explode``, partners were searched anew for each step."""
    from vitalspark.operators import joins

    side = lambda n: spark.createDataFrame([("p", 1, "SCAN", "T", 1.0)], "path string, step_id int, operation string, object_name string, cost double").where(f"step_id < {n}")
    for out in (listings.plan_compare(side(7), side(8), ["path"]), joins.step_match(side(7), side(8), ["path"])):
        assert "lambdafunction" not in physical(out)


def test_plans_cut_by_arrow_batches_are_paired_whole(spark):
    """Batches of 1 to 8 rows, plans of up to 40 steps, keys with NULL, equal and unknown steps: the pairs are those of a search plan by plan."""
    from vitalspark.operators import joins

    schema = "a string, b long, step_id int, operation string, object_name string"
    plans = {(a, b): ([f"{'xyZ'[i * n % 3]}" for i in range(n % 41)], [f"{'Xyz'[i * 7 % 3]}" for i in range(n * 3 % 17)]) for n, (a, b) in enumerate((a, b) for a in ("p", None, "q") for b in (*range(9), None))}
    rows = [[(a, b, i, op, op if i % 2 else None) for (a, b), p in plans.items() for i, op in enumerate(p[side])] for side in (0, 1)]
    want = []
    for (a, b), p in plans.items():
        kinds = [[(op.upper(), op.upper() if i % 2 else "") for i, op in enumerate(s)] for s in p]
        free = list(range(len(kinds[1])))
        mates = [next((free.pop(free.index(j)) for j in list(free) if kinds[1][j] == k), None) for k in kinds[0]]
        left = [i for i, j in enumerate(mates) if j is None]
        want += [(a, b, i, j, "same") for i, j in enumerate(mates) if j is not None]
        for n in range(max(len(left), len(free))):
            i, j = left[n] if n < len(left) else None, free[n] if n < len(free) else None
            want.append((a, b, i, j, "added" if i is None else "removed" if j is None else "moved"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("1", "2", "8", before):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = joins.step_match(*[spark.createDataFrame(r, schema) for r in rows], ["a", "b"]).collect()
            assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_steps_stay_in_their_plans_row_until_they_are_paired(spark, sf_dir):
    """Comparisons shuffle, sort and send plans: steps become rows once, as pairs."""
    from vitalspark import catalog

    for name in ("x14_plan_compare", "x14_problem_changes"):
        assert physical(catalog.QUERIES[name](spark, sf_dir)).count("Generate ") == 1


def test_lists_of_steps_are_paired_as_rows_of_steps(spark):
    """A plan's steps in one row, in two with and without steps, in no order, of equal numbers, NULL cells and on one side only, give the pairs of their rows."""
    schema = "path string, step_id int, operation string, object_name string, cost double"
    rows = [[(p, (i * 5 + side) % 4, ("a", "Full", "TABLE ACCESS FULL", "new")[i * (n + side) % (3 + side)] if i % 5 else None, "xY"[i % 2] if i % 3 else None, float(i * n % 3)) for n, p in enumerate(("p", None, "q", "r")) for i in range(9) if (n, side) != (2, 1)] for side in (0, 1)]
    steps = [spark.createDataFrame(r, schema) for r in rows]
    lists = []
    for r in rows:
        two = [(p, [x[1:] for x in r if x[0] == p][i::2]) for p in {x[0] for x in r} for i in (0, 1)]
        lists.append(spark.createDataFrame([*two, ("p", []), ("q", None), ("none", [])], "path string, steps array<struct<step_id int, operation string, object_name string, cost double>>"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("1", before):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            for f in (listings.plan_compare, listings.problem_changes):
                want, got = (sorted((tuple(x) for x in f(*side, ["path"]).collect()), key=repr) for side in (steps, lists))
                assert got == want and got
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_cells_typed_in_arrow_are_those_typed_by_spark(spark):
    import pyarrow as pa
    from pyspark.sql import functions as F

    ids = ["1", "*2", "*  3", "4\t", "007", "2147483647", "2147483648", "00000000000000000012", "99999999999999999999", "*\x0b6", "0", "000"]
    sizes = ["", "1", "12K", "12k", "3M", "5g", "x", "K", "9" * 30, "9" * 310, "9" * 400, "1.5K", "12 K", "-3", "\u0663", "5\u00e9", "12\u017f", None, "1e3", "8T", "1KM"]
    costs = [*sizes, "12 (3)", "12K (100)", "(3) 12", "12 ( 3 )", "1(2)3(4)", "( )", "12 (\x0b3)", "12 (3", "12 (3))", "12K(1)(2)", "12 (\u0663)", "5 (\n2)", "NaN", "1e3 (2)"]
    ops, names = ["A", " A", "  B ", "", "   ", None, "    \u00e9", "\tA", " \tB  "], ["", "T", None]
    rows = [(ids[i % 12], ops[i % 9], names[i % 3], sizes[i % 21], sizes[i * 5 % 21], costs[i % len(costs)]) for i in range(36 * 35)]
    cells = dict(zip(plan_text._CELLS, (pa.array(c, pa.string()) for c in zip(*rows))))
    for compat in (False, True):
        made = plan_text._step_values({k: lambda a=a: a for k, a in cells.items()}, compat)
        got = spark.createDataFrame(list(zip(*[made[c]().to_pylist() for c in plan_text._OF])), "step_id int, depth int, operation string, object_name string, rows double, bytes double, cost " + ("string" if compat else "double"))
        if compat:
            got = got.withColumn("cost", F.col("cost").try_cast("double"))
        want = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in plan_text._CELLS)).select(*plan_text._typed(F.col, compat, tuple(plan_text._OF)))
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_heads_read_as_arrays_are_those_read_line_by_line():
    """Many SQL_IDs and hashes in a plan, in any place of a line, with and without blanks: the greatest counts, as by ``plans``."""
    import random

    import pyarrow as pa

    r = random.Random(5)
    pieces = ["SQL_ID", " ", "\t", "\x0b", "\r", ":", "a", "b1_", "\u00e9", "|", "Plan hash value:", "12", "9", "\u0663", "\n", "\n", "\n| Id | Operation |\n| 1 | A |\n", "\n  SQL_ID ", "\nSQL_ID zz\n", "\x85", "SQL_ID:  q"]
    met = 0
    for _ in range(300):
        texts = ["SQL_ID a\n" + "".join(r.choices(pieces, k=r.randrange(40))) for _ in range(3)]
        got = plan_text._steps_of(pa.array(["0", "1", "2"]), pa.array(texts), ["sql_id", "plan_hash_value"], ["step_id"], False).to_pylist()
        want = {(str(i), no): plan_text._parse(p) for i, t in enumerate(texts) for no, p in enumerate(plan_text._cut(t), 1)}
        want = {k: p[:2] for k, p in want.items() if p[4]}
        assert {(x["path"], x["plan_no"]): (x["sql_id"], x["plan_hash_value"]) for x in got} == want
        met += len(want)
    assert met > 100
