"""Filter, selection and scalar queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrays import join_list, split_ints, split_list
from tidemark.functions.times import day_text, iso_text, naive
from tidemark.operators.fields import decode_json, expand_fields
from tidemark.operators.filters import Filters
from tidemark.operators.options import FieldType, FilterOp, field_types
from tidemark.sources.sinks import json_row
from tidemark.sources.tables import assign_event_time
from workloads.registry import Tables, query


def filter_report(df: DataFrame, key: str, fields: dict[str, str], cases: list[tuple[str, str]]) -> DataFrame:
    """Per filter the number of rows that pass and the sum of their keys, in one pass over ``df``."""
    # Worked out before they are counted: inside the aggregates each filter would be worked out for both.
    passing = [Filters.parse(fields, {name: text}).predicates({name: F.col(name)})[0] for name, text in cases]
    df = df.select(key, *[passes.alias(f"_passes{i}") for i, passes in enumerate(passing)])
    reports = []
    for i, (name, text) in enumerate(cases):
        passes = F.col(f"_passes{i}")
        reports.append(
            F.struct(
                F.lit(f"{name}={text}").alias("filter"),
                F.count_if(passes).alias("passed"),
                F.sum(F.when(passes, F.col(key))).cast("long").alias("key_sum"),
            )
        )
    # Aggregates first, rows after: the explode sees a single row.
    flat = df.agg(*[r.alias(f"r{i}") for i, r in enumerate(reports)])
    return flat.select(F.explode(F.array(*flat.columns)).alias("r")).select("r.*")


def report_sql(source: str, key: str, cases: list[tuple[str, str, str]]) -> str:
    """``cases``: field, filter text and the SQL condition it stands for."""
    return "\nUNION ALL\n".join(
        f"SELECT '{name}={text}' AS filter, count(*) AS passed, sum({key})::BIGINT AS key_sum"
        f" FROM ({source}) WHERE {condition}"
        for name, text, condition in cases
    )


def _cases(cases):
    return [(name, text) for name, text, _ in cases]


STRINGS = [
    ("p_name", "contains:red", "contains(p_name, 'red')"),
    ("p_name", "contains:%", "contains(p_name, '%')"),
    ("p_name", "not_contains:ring", "NOT contains(p_name, 'ring')"),
    ("p_type", "eq:ECONOMY", "p_type = 'ECONOMY'"),
    ("p_type", "neq:ECONOMY", "p_type <> 'ECONOMY'"),
    ("p_name", "starts_with:small", "starts_with(p_name, 'small')"),
    ("p_name", "ends_with:widget", "ends_with(p_name, 'widget')"),
    ("p_brand", "one_of:Brand#2,,Brand#17", "p_brand IN ('Brand#2', 'Brand#17')"),
    ("p_brand", "one_of:", "false"),
    ("p_brand", "not_one_of:Brand#2,Brand#17", "p_brand NOT IN ('Brand#2', 'Brand#17')"),
    ("p_brand", "not_one_of:", "true"),
    ("p_name", "min_len:10", "length(p_name) >= 10"),
    ("p_name", "max_len:10", "length(p_name) <= 10"),
]


@query(report_sql("SELECT * REPLACE (nullif(p_brand, 'Brand#3') AS p_brand) FROM part", "p_partkey", STRINGS))
def filter_string_ops(t: Tables):
    fields = {"p_name": "string", "p_type": "string", "p_brand": "string"}
    part = t.part.withColumn("p_brand", F.nullif("p_brand", F.lit("Brand#3")))
    return filter_report(part, "p_partkey", fields, _cases(STRINGS))


NUMBERS = [
    ("l_quantity", "gt:25", "l_quantity > 25"),
    ("l_quantity", "gte:25", "l_quantity >= 25"),
    ("l_discount", "lt:0.05", "l_discount < 0.05"),
    ("l_discount", "lte:0.05", "l_discount <= 0.05"),
    ("l_linenumber", "eq:3", "l_linenumber = 3"),
    ("l_linenumber", "neq:3", "l_linenumber <> 3"),
    ("l_quantity", "one_of:1,2.5,17", "l_quantity IN (1, 2.5, 17)"),
    ("l_linenumber", "not_one_of:1,2", "l_linenumber NOT IN (1, 2)"),
]


@query(report_sql("SELECT * REPLACE (nullif(l_linenumber, 7) AS l_linenumber) FROM lineitem", "l_orderkey", NUMBERS))
def filter_number_ops(t: Tables):
    fields = dict.fromkeys(["l_quantity", "l_discount", "l_linenumber"], "number")
    rows = t.lineitem.withColumn("l_linenumber", F.nullif("l_linenumber", F.lit(7)))
    return filter_report(rows, "l_orderkey", fields, _cases(NUMBERS))


DATES = [
    ("o_orderdate", "gt:1998-03-05", "o_orderdate > TIMESTAMP '1998-03-05'"),
    ("o_orderdate", "gte:1998-03-05T00:00Z", "o_orderdate >= TIMESTAMP '1998-03-05'"),
    ("o_orderdate", "lt:1998-03-05T06:07", "o_orderdate < TIMESTAMP '1998-03-05 06:07:00'"),
    ("o_orderdate", "lte:1998-03-05T02:00+02:00", "o_orderdate <= TIMESTAMP '1998-03-05'"),
    ("o_orderdate", "eq:1998-03-05 00:00", "o_orderdate = TIMESTAMP '1998-03-05'"),
    ("o_orderdate", "neq:889056000", "o_orderdate <> TIMESTAMP '1998-03-05'"),
    ("o_orderdate", "one_of:1998-03-05,1999-01-01", "o_orderdate IN (TIMESTAMP '1998-03-05', TIMESTAMP '1999-01-01')"),
    ("o_orderdate", "not_one_of:1998-03-05", "o_orderdate <> TIMESTAMP '1998-03-05'"),
]


@query(report_sql("SELECT * REPLACE (nullif(o_orderdate, TIMESTAMP '1995-01-01') AS o_orderdate) FROM orders", "o_orderkey", DATES))
def filter_date_ops(t: Tables):
    gaps = F.nullif(F.col("o_orderdate"), F.expr("timestamp_ntz '1995-01-01'"))
    rows = t.orders.withColumn("o_orderdate", gaps)
    return filter_report(rows, "o_orderkey", {"o_orderdate": "date"}, _cases(DATES))


TIMEDELTAS = [
    ("seconds", "gt:PT10H", "seconds > 36000"),
    ("seconds", "gte:36000", "seconds >= 36000"),
    ("seconds", "lt:P1D", "seconds < 86400"),
    ("seconds", "lte:PT1H30M", "seconds <= 5400"),
    ("seconds", "eq:PT1H", "seconds = 3600"),
    ("seconds", "neq:PT1H", "seconds <> 3600"),
    ("seconds", "one_of:PT1H,7200,P1D", "seconds IN (3600, 7200, 86400)"),
    ("seconds", "not_one_of:PT1H,7200", "seconds NOT IN (3600, 7200)"),
]


@query(report_sql("SELECT l_orderkey, nullif(l_quantity, 5) * 1800 AS seconds FROM lineitem", "l_orderkey", TIMEDELTAS))
def filter_timedelta_ops(t: Tables):
    seconds = (F.nullif(F.col("l_quantity"), F.lit(5.0)) * 1800).alias("seconds")
    rows = t.lineitem.select("l_orderkey", seconds)
    return filter_report(rows, "l_orderkey", {"seconds": "timedelta"}, _cases(TIMEDELTAS))


_ARRAYS_SQL = """
    SELECT l_orderkey,
           CASE WHEN l_linenumber < 7 THEN [l_returnflag, CASE WHEN l_linenumber > 2 THEN l_linestatus END] END AS tags,
           list_resize([l_linenumber, l_linenumber + 1, 9], l_linenumber % 4) AS numbers,
           [l_shipdate, l_shipdate + INTERVAL 1 DAY] AS dates,
           [l_quantity * 60, l_quantity * 3600] AS spans
    FROM lineitem
"""

ARRAYS = [
    ("tags", "contains:R", "list_contains(tags, 'R')"),
    ("tags", "not_contains:F", "tags IS NOT NULL AND NOT list_contains(tags, 'F')"),
    ("tags", "contains_one_of:R,F", "list_has_any(tags, ['R', 'F'])"),
    ("tags", "not_contains_one_of:R,F", "tags IS NOT NULL AND NOT list_has_any(tags, ['R', 'F'])"),
    ("tags", "contains_one_of:", "false"),
    ("tags", "not_contains_one_of:", "true"),
    ("tags", "min_len:2", "len(tags) >= 2"),
    ("numbers", "contains:2", "list_contains(numbers, 2)"),
    ("numbers", "not_contains:2", "NOT list_contains(numbers, 2)"),
    ("numbers", "min_len:2", "len(numbers) >= 2"),
    ("numbers", "max_len:1", "len(numbers) <= 1"),
    ("numbers", "contains_one_of:3,9", "list_has_any(numbers, [3, 9])"),
    ("dates", "contains:1998-03-05", "list_contains(dates, TIMESTAMP '1998-03-05')"),
    ("dates", "contains_one_of:1998-03-05,1999-01-01", "list_has_any(dates, [TIMESTAMP '1998-03-05', TIMESTAMP '1999-01-01'])"),
    ("spans", "contains:PT1H", "list_contains(spans, 3600)"),
    ("spans", "not_contains_one_of:PT1H,PT5M", "NOT list_has_any(spans, [3600::DOUBLE, 300::DOUBLE])"),
]


@query(report_sql(_ARRAYS_SQL, "l_orderkey", ARRAYS))
def filter_array_ops(t: Tables):
    number = F.col("l_linenumber")
    three = F.array(number, number + 1, F.lit(9))
    rows = t.lineitem.select(
        "l_orderkey",
        F.when(number < 7, F.array("l_returnflag", F.when(number > 2, F.col("l_linestatus")))).alias("tags"),
        F.slice(three, F.lit(1), number % 4).alias("numbers"),
        F.array(F.col("l_shipdate"), F.col("l_shipdate") + F.expr("interval 1 day")).alias("dates"),
        F.array(F.col("l_quantity") * 60, F.col("l_quantity") * 3600).alias("spans"),
    )
    fields = {
        "tags": "array[string]", "numbers": "array[number]", "dates": "array[date]", "spans": "array[timedelta]",
    }
    return filter_report(rows, "l_orderkey", fields, _cases(ARRAYS))


@query("""
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    WHERE contains(o_orderpriority, 'O') AND o_totalprice >= 1000 AND o_totalprice < 400000.5
      AND o_orderdate >= TIMESTAMP '1996-02-01' AND o_orderstatus IN ('F', 'P')
""")
def filter_conjunction(t: Tables):
    """Filters on several fields, twice on one; a field without a column is skipped."""
    fields = {
        "o_orderpriority": "string", "o_totalprice": "number", "o_orderdate": "date",
        "o_orderstatus": "string", "elsewhere": "number",
    }
    wanted = {
        "o_orderpriority": "contains:O",
        "o_totalprice": ["gte:1000", "lt:400000.5"],
        "o_orderdate": ["gte:1996-02-01"],
        "o_orderstatus": ["one_of:F,P"],
        "elsewhere": ["eq:1"],
    }
    return Filters.parse(fields, wanted).apply(t.orders).select("o_orderkey", "o_custkey", "o_totalprice")


@query("""
    SELECT p_partkey, p_brand, p_size FROM part
    WHERE p_brand SIMILAR TO 'Brand#1.*' AND p_size BETWEEN 10 AND 20
""")
def custom_filter_op(t: Tables):
    """Caller-made field types, built of columns like the built-in ones."""
    def bounds(text: str) -> tuple[int, int]:
        low, _, high = text.partition("..")
        return int(low), int(high)

    extra = [
        FieldType("pattern", {"matches": FilterOp(str, lambda c, v: c.rlike(f"^(?:{v})$"))}),
        FieldType(
            "size",
            {**field_types()["number"].ops, "within": FilterOp(bounds, lambda c, v: c.between(*v))},
        ),
    ]
    fields = {"p_brand": "pattern", "p_size": "size"}
    wanted = {"p_brand": "matches:Brand#1.*", "p_size": "within:10..20"}
    return Filters.parse(fields, wanted, extra).apply(t.part).select("p_partkey", "p_brand", "p_size")


@query("SELECT event_id, user_id, event_type, value FROM events")
def select_shorthand(t: Tables):
    """The key column, then a group of fields, one of them named twice."""
    groups = {"default": ["who", "value"], "who": ["user_id", "event_type"]}
    return t.events.select("event_id", *expand_fields("who, value, event_type", groups))


@query("""
    SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events
""")
def json_config_field(t: Tables):
    return decode_json(t.events.select("event_id", "props"), "props", "k bigint")


@query("SELECT event_id, ts AS at FROM events")
def strip_tz(t: Tables):
    """An instant back to its zoneless UTC time."""
    return t.events.select("event_id", naive(F.col("ts").cast("timestamp")).alias("at"))


@query("""
    SELECT event_id, strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%gZ') AS iso, strftime(ts, '%Y-%m-%d') AS day,
           epoch_us(date_trunc('second', ts)) // 1000000 % 7 AS phase,
           round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 2592000000000, 3) AS share
    FROM events
""")
def scalar_time(t: Tables):
    """ISO text, day text, epoch seconds modulo, and a rounded share of a range."""
    ts = F.col("ts").cast("timestamp")
    passed = F.timestamp_diff("MICROSECOND", F.expr("timestamp '2024-01-01 00:00:00'"), ts)
    return t.events.select(
        "event_id", iso_text(ts).alias("iso"), day_text(F.col("ts")).alias("day"),
        (F.unix_seconds(ts) % 7).alias("phase"), F.round(passed / 2592000000000, 3).alias("share"),
    )


@query("""
    SELECT conv_id, turn, array_to_string(words, ',') AS words, array_to_string(lengths, ',') AS lengths,
           len(words) AS n, list_contains(words, 'the') AS has_the
    FROM (SELECT conv_id, turn, string_split(text, ' ') AS words,
                 list_transform(string_split(text, ' '), lambda w: length(w)) AS lengths FROM conversations)
""")
def scalar_array(t: Tables):
    """Arrays as comma-joined text, their length and membership."""
    rows = t.conversations.select("conv_id", "turn", F.split("text", " ").alias("words"))
    return rows.select(
        "conv_id",
        "turn",
        join_list(F.col("words")).alias("words"),
        join_list(F.transform("words", F.length)).alias("lengths"),
        F.size("words").cast("long").alias("n"),
        F.array_contains("words", "the").alias("has_the"),
    )


@query("""
    SELECT event_id, CASE WHEN event_type = 'view' THEN [] ELSE string_split(event_type || ',' || user_id, ',') END AS words,
           CASE WHEN event_type = 'view' THEN [] ELSE [user_id::INT, (event_id + 1)::INT] END AS numbers
    FROM events
""")
def scalar_split(t: Tables):
    """Comma lists split into strings and integers; empty and missing text give an empty array."""
    kind = F.col("event_type")
    user = F.col("user_id").cast("string")
    words = F.when(kind != "view", F.concat_ws(",", kind, user))
    numbers = F.when(kind == "view", F.lit("")).otherwise(
        F.concat_ws(",", user, (F.col("event_id") + 1).cast("string"))
    )
    return t.events.select(
        "event_id", split_list(words).alias("words"), split_ints(numbers).alias("numbers")
    )


@query("""
    SELECT event_id, CASE WHEN event_type = 'click' THEN TIMESTAMP '2010-01-01' ELSE date_trunc('millisecond', ts) END AS at
    FROM events
""", name="assign_event_time")
def assign_event_time_query(t: Tables):
    """Event time from text; unreadable text falls through to a second column or the default."""
    kind = F.col("event_type")
    raw = t.events.select(
        "event_id",
        F.when(kind.isin("click", "error"), F.lit("soon")).otherwise(iso_text(F.col("ts"))).alias("stamp"),
        F.when(kind == "error", iso_text(F.col("ts"))).alias("spare"),
    )
    return assign_event_time(raw, ["stamp", "spare"]).select("event_id", naive(F.col("ts")).alias("at"))


@query("""
    SELECT event_id, '{"sim_id":"user-' || user_id || '","event_type":"' || event_type || '","note":'
           || CASE WHEN event_type = 'view' THEN 'null' ELSE '"' || event_type || '"' END || '}' AS value
    FROM events
""")
def to_json_rows(t: Tables):
    """Rows as JSON text with the run id in front and NULL fields kept."""
    sim = F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("sim_id")
    note = F.nullif(F.col("event_type"), F.lit("view")).alias("note")
    return t.events.select("event_id", json_row(sim, "event_type", note).alias("value"))
