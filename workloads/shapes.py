"""Reshaping queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import reshape
from workloads.registry import Tables, query

_METRICS = list(reshape.CDU_METRICS)
_PLANT = sorted(set(reshape.CEP_PATHS.values()))


def _sql_list(items) -> str:
    return "[" + ", ".join(f"'{i}'" for i in items) + "]"


#: A line item is a reading: of a unit's metric, or (last line of an order) of the central plant.
READINGS_SQL = f"""
    SELECT l_orderkey AS record, l_quantity AS value,
           CASE WHEN l_linenumber < 5
                THEN 'simulator[1].datacenter[1].computeBlock[' || l_linenumber || '].cdu[1].summary.'
                     || ({_sql_list(_METRICS)})[(l_partkey % {len(_METRICS)} + 1)::INT]
                ELSE ({_sql_list(_PLANT)})[(l_partkey % {len(_PLANT)} + 1)::INT] END AS path
    FROM lineitem
"""


def mixed_spelling(path):
    """Two thirds of the paths with brackets and quotes of either kind, as the simulator may write them."""
    third = F.col("l_suppkey") % 3
    once = F.regexp_replace(path, r"\.(\w+)", "['$1']")
    twice = F.regexp_replace(path, r"\.(\w+)", '["$1"]')
    return F.when(third == 0, path).when(third == 1, once).otherwise(twice)


def readings(t: Tables):
    part = F.col("l_partkey")

    def pick(items):
        return F.element_at(F.array(*map(F.lit, items)), (part % len(items) + 1).cast("int"))

    unit = F.concat(
        F.lit("simulator[1].datacenter[1].computeBlock["), F.col("l_linenumber").cast("string"),
        F.lit("].cdu[1].summary."), pick(_METRICS),
    )
    path = F.when(F.col("l_linenumber") < 5, unit).otherwise(pick(_PLANT))
    return t.lineitem.select(
        F.col("l_orderkey").alias("record"), mixed_spelling(path).alias("path"), F.col("l_quantity").alias("value")
    )


@query(f"""
    SELECT record, regexp_extract(path, 'computeBlock.(\\d+)', 1)::INT AS cdu,
           {", ".join(f"max(value) FILTER (WHERE ends_with(path, '.{m}')) AS {c}" for m, c in reshape.CDU_METRICS.items())}
    FROM ({READINGS_SQL}) WHERE contains(path, 'computeBlock') GROUP BY 1, 2
""")
def flat_keys_to_wide(t: Tables):
    return reshape.wide_cdus(readings(t), ["record"])


@query(f"""
    SELECT record, {", ".join(f"max(value) FILTER (WHERE path = '{p}') AS {c}" for c, p in reshape.CEP_PATHS.items())}
    FROM ({READINGS_SQL}) WHERE NOT contains(path, 'computeBlock') GROUP BY 1
""")
def flat_keys_to_plant(t: Tables):
    return reshape.wide_plant(readings(t), ["record"])


#: Places read back from nested rows.
_NESTED = {
    "pue": ["pue"],
    "return_temp": ["simulator", 1, "datacenter", 1, "computeBlock", 1, "cdu", 1, "summary", "T_sec_r_C"],
    "fan_power": ["simulator", 1, "centralEnergyPlant", 1, "coolingTowerLoop", 1, "summary", "W_flow_CT_kW"],
}


@query(f"""
    SELECT record, count(*) - count(DISTINCT path) AS conflicts,
           CASE WHEN count(*) = count(DISTINCT path) THEN max(value) FILTER (WHERE path = 'pue') END AS pue,
           CASE WHEN count(*) = count(DISTINCT path) THEN max(value) FILTER (
               WHERE path = 'simulator[1].datacenter[1].computeBlock[1].cdu[1].summary.T_sec_r_C') END AS return_temp,
           CASE WHEN count(*) = count(DISTINCT path) THEN max(value) FILTER (
               WHERE path = 'simulator[1].centralEnergyPlant[1].coolingTowerLoop[1].summary.W_flow_CT_kW') END AS fan_power
    FROM ({READINGS_SQL}) GROUP BY 1
""")
def flat_keys_nested(t: Tables):
    """Every reading at its path, whatever the spelling; some places read back."""
    rows = reshape.nested_rows(readings(t), ["record"])
    return rows.select(
        "record", "conflicts", *[reshape.nested_value("nested", parts).alias(name) for name, parts in _NESTED.items()]
    )


@query("""
    SELECT record, replace(place, '.', '/') AS place, 'duplicate' AS problem FROM (
        SELECT l_orderkey AS record, 'a.' || l_linenumber || '.x' AS place FROM lineitem WHERE l_linenumber < 4)
    GROUP BY ALL HAVING count(*) > 1
    UNION ALL
    SELECT DISTINCT a.l_orderkey, 'a/b', 'nested' FROM lineitem a JOIN lineitem b USING (l_orderkey)
    WHERE a.l_linenumber = 4 AND b.l_linenumber = 5
      AND (SELECT count(*) FROM lineitem c WHERE c.l_orderkey = a.l_orderkey AND c.l_linenumber = 4) = 1
    UNION ALL
    SELECT l_orderkey, 'a/b', 'duplicate' FROM lineitem WHERE l_linenumber = 4 GROUP BY 1 HAVING count(*) > 1
    UNION ALL
    SELECT l_orderkey, 'a/b/c', 'duplicate' FROM lineitem WHERE l_linenumber = 5 GROUP BY 1 HAVING count(*) > 1
    UNION ALL
    SELECT DISTINCT l_orderkey, 'a..b', 'invalid' FROM lineitem WHERE l_linenumber > 5
""")
def flat_key_conflicts(t: Tables):
    """Duplicate, nested and malformed places, with quoted and dotted spellings mixed."""
    number = F.col("l_linenumber")
    status = F.col("l_linestatus")
    path = (
        F.when((number < 4) & (status == "F"), F.concat(F.lit("a['"), number.cast("string"), F.lit("'].x")))
        .when(number < 4, F.concat(F.lit("a."), number.cast("string"), F.lit('["x"]')))
        .when(number == 4, F.lit("a.b"))
        .when(number == 5, F.lit("a['b'].c"))
        .otherwise(F.lit("a..b"))
    )
    rows = t.lineitem.select(F.col("l_orderkey").alias("record"), path.alias("path"))
    return reshape.path_conflicts(rows, ["record"])


_POWER_SQL = """
    SELECT l_orderkey AS record, l_suppkey % 10 AS cdu,
           max(CASE WHEN l_linenumber = 1 THEN l_quantity END) AS rack_1_power,
           max(CASE WHEN l_linenumber = 2 THEN l_quantity END) AS rack_2_power,
           max(CASE WHEN l_linenumber = 3 THEN l_quantity END) AS rack_3_power,
           max(l_extendedprice) AS total_power,
           max(CASE WHEN l_linenumber = 1 THEN l_tax END) AS rack_1_loss,
           max(CASE WHEN l_linenumber = 2 THEN l_tax END) AS rack_2_loss,
           max(CASE WHEN l_linenumber = 3 THEN l_tax END) AS rack_3_loss,
           max(l_discount) AS total_loss
    FROM lineitem GROUP BY 1, 2
"""


def rack_readings(t: Tables):
    """Power frame of the simulator: racks 1 to 3, their losses, and the sums."""
    number = F.col("l_linenumber")
    racks = [
        F.max(F.when(number == n, F.col(source))).alias(f"{name} {n}")
        for name, source in (("Rack", "l_quantity"), ("Loss", "l_tax"))
        for n in (1, 2, 3)
    ]
    return (
        t.lineitem.groupBy(F.col("l_orderkey").alias("record"), (F.col("l_suppkey") % 10).alias("cdu"))
        .agg(*racks, F.max("l_extendedprice").alias("Sum"), F.max("l_discount").alias("Loss"))
    )


@query(f"""
    SELECT coalesce(p.record, c.record) AS record, coalesce(p.cdu, c.cdu) AS cdu,
           p.* EXCLUDE (record, cdu), c.facility_flowrate, c.rack_flowrate
    FROM ({_POWER_SQL}) p FULL JOIN (
        SELECT l_orderkey AS record, l_suppkey % 10 AS cdu, max(l_quantity) AS facility_flowrate,
               max(l_discount) AS rack_flowrate
        FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1, 2) c
    ON p.record = c.record AND p.cdu = c.cdu
""")
def merge_power_cooling(t: Tables):
    """Power and cooling readings of a unit at one time become one row; either may be missing."""
    key = ["record", "cdu"]
    power = reshape.rack_columns(rack_readings(t), key)
    cooling = t.lineitem.filter("l_returnflag <> 'A'").select(
        F.col("l_orderkey").alias("record"), (F.col("l_suppkey") % 10).alias("cdu"),
        F.col("l_quantity").alias("facility_flowrate"), F.col("l_discount").alias("rack_flowrate"),
    )
    return reshape.merge_sides(key, power, cooling)


@query(f"""
    SELECT * FROM ({" UNION ALL ".join(
        f"SELECT record, cdu, {n} AS rack, rack_{n}_power AS power, rack_{n}_loss AS loss FROM ({_POWER_SQL})"
        for n in (1, 2, 3))})
    WHERE power IS NOT NULL OR loss IS NOT NULL
""")
def rack_unpivot(t: Tables):
    key = ["record", "cdu"]
    return reshape.racks_to_rows(reshape.rack_columns(rack_readings(t), key), key)


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * 1000000 AS average_power, l_tax * 1000000 AS average_loss
    FROM lineitem
""")
def unit_scale(t: Tables):
    """Megawatts to watts."""
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_quantity").alias("average_power"), F.col("l_tax").alias("average_loss"),
    )
    return reshape.scale_units(rows, dict.fromkeys(["average_power", "average_loss"], 1e6))
