"""Reshaping of sensor data: flat path keys to wide rows, merging of sides, racks to rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The metric names of a cooling unit and the columns they fill.
CDU_METRICS = {
    "W_flow_CDUP_kW": "work_done_by_cdup",
    "T_sec_r_C": "rack_return_temp",
    "T_sec_s_C": "rack_supply_temp",
    "p_sec_s_psig": "rack_supply_pressure",
    "p_sec_r_psig": "rack_return_pressure",
    "V_flow_sec_GPM": "rack_flowrate",
    "T_prim_r_C": "facility_return_temp",
    "T_prim_s_C": "facility_supply_temp",
    "p_prim_s_psig": "facility_supply_pressure",
    "p_prim_r_psig": "facility_return_pressure",
    "V_flow_prim_GPM": "facility_flowrate",
}
CDU_PATH = r"^simulator\[1\]\.datacenter\[1\]\.computeBlock\[(\d+)\]\.cdu\[1\]\.summary\.(\w+)$"

# Where each column of the central plant comes from.
CEP_PATHS = {
    "htw_flowrate": "simulator[1].centralEnergyPlant[1].hotWaterLoop[1].summary.V_flow_htw_GPM",
    "ctw_flowrate": "simulator[1].centralEnergyPlant[1].coolingTowerLoop[1].summary.V_flow_ctw_GPM",
    "htw_return_pressure": "simulator[1].centralEnergyPlant[1].hotWaterLoop[1].summary.p_fac_htw_r_psig",
    "htw_supply_pressure": "simulator[1].centralEnergyPlant[1].hotWaterLoop[1].summary.p_fac_htw_s_psig",
    "ctw_return_pressure": "simulator[1].centralEnergyPlant[1].coolingTowerLoop[1].summary.p_fac_ctw_r_psig",
    "ctw_supply_pressure": "simulator[1].centralEnergyPlant[1].coolingTowerLoop[1].summary.p_fac_ctw_s_psig",
    "htw_return_temp": "simulator[1].centralEnergyPlant[1].hotWaterLoop[1].summary.T_fac_htw_r_C",
    "htw_supply_temp": "simulator[1].centralEnergyPlant[1].hotWaterLoop[1].summary.T_fac_htw_s_C",
    "ctw_return_temp": "simulator[1].centralEnergyPlant[1].coolingTowerLoop[1].summary.T_fac_ctw_r_C",
    "ctw_supply_temp": "simulator[1].centralEnergyPlant[1].coolingTowerLoop[1].summary.T_fac_ctw_s_C",
    "power_consumption_htwps": "simulator[1].centralEnergyPlant[1].hotWaterLoop[1].summary.W_flow_HTWP_kW",
    "power_consumption_ctwps": "simulator[1].centralEnergyPlant[1].coolingTowerLoop[1].summary.W_flow_CTWP_kW",
    "power_consumption_fan": "simulator[1].centralEnergyPlant[1].coolingTowerLoop[1].summary.W_flow_CT_kW",
    "htwp_speed": "simulator[1].centralEnergyPlant[1].hotWaterLoop[1].summary.N_HTWP",
    "nctwps_staged": "simulator[1].centralEnergyPlant[1].coolingTowerLoop[1].summary.n_CTWPs",
    "nhtwps_staged": "simulator[1].centralEnergyPlant[1].hotWaterLoop[1].summary.n_HTWPs",
    "nehxs_staged": "simulator[1].centralEnergyPlant[1].hotWaterLoop[1].summary.n_EHXs",
    "ncts_staged": "simulator[1].centralEnergyPlant[1].coolingTowerLoop[1].summary.n_CTs",
    "facility_return_temp": "simulator[1].centralEnergyPlant[1].hotWaterLoop[1].summary.T_fac_htw_r_C",
    "pue_output": "pue",
    "cdu_loop_bypass_flowrate": "simulator[1].datacenter[1].summary.V_flow_bypass_GPM",
}

def long_readings(df: DataFrame, key: Sequence[str], readings: str) -> DataFrame:
    """Rows of ``key, path, value`` from a map column of path-keyed readings."""
    return df.select(*key, F.explode(readings).alias("path", "value"))


def wide_cdus(readings: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per key and cooling unit from long readings; one aggregation, no pivot pass.

    Paths may be spelt with dots or brackets. Duplicate readings are an input error (see
    :func:`path_conflicts`); their maximum is taken.
    """
    unit = {
        "cdu": lambda path: F.substring_index(F.substring_index(path, "computeBlock[", -1), "]", 1).cast("int"),
        "metric": lambda path: F.substring_index(path, ".", -1),
    }

    def place(path: Column) -> Column:
        return F.when(path.rlike(CDU_PATH), F.struct(*[part(path).alias(name) for name, part in unit.items()]))

    found = readings.select(*key, _once(_once(F.col("path"), plain_path), place).alias("_place"), "value")
    found = found.select(*key, "_place.cdu", "_place.metric", "value")
    cells = [
        F.max(F.when(F.col("metric") == name, F.col("value"))).alias(column)
        for name, column in CDU_METRICS.items()
    ]
    # Other readings make one group per key, which goes after the aggregation: a filter before it would be
    # pushed down to where paths are made, and make and read each of them twice.
    return found.groupBy(*key, "cdu").agg(*cells, F.count("metric").alias("_found")).filter("_found > 0").drop("_found")


def wide_plant(readings: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per key with the central plant's columns from long readings, in either spelling of paths."""
    found = readings.select(*key, _once(F.col("path"), plain_path).alias("_path"), "value")
    cells = [
        F.max(F.when(F.col("_path") == path, F.col("value"))).alias(column)
        for column, path in CEP_PATHS.items()
    ]
    known = F.count_if(F.col("_path").isin(sorted(set(CEP_PATHS.values())))).alias("_found")
    return found.groupBy(*key).agg(*cells, known).filter("_found > 0").drop("_found")


def _once(value: Column, then) -> Column:
    """``then(value)`` with ``value`` worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), then), 0)


def plain_path(path: Column) -> Column:
    """Brackets around plain names written as dots, so that ``a['b']`` becomes ``a.b``; all else stays as it is."""
    dotted = F.regexp_replace(path, r"""\[(['"])(\w+)\1\](?=[.\[]|$)""", ".$2")
    return F.when(path.contains("']") | path.contains('"]'), F.ltrim(dotted, F.lit("."))).otherwise(path)


# A path is a name or a place in brackets, then names after dots and further places. Nothing is tried twice, so long
# paths need no deeper stack.
_NAME = r"[\p{L}\p{N}_]++"
_PLACE = r"""\[(?:[0-9]++|'[^']++'|"[^"]++")\]"""
_WHOLE_PATH = rf"\A(?:\.?{_NAME}|{_PLACE})(?:\.{_NAME}|{_PLACE})*+\z"


def path_parts(path: Column) -> Column:
    """Parts of a path in one spelling each, so that ``a.b`` and ``a['b']`` are the same place; NULL if the text
    is no path. Names lose their dots and quotes; indexes keep their brackets.

    A path has names of letters, digits and ``_``, after a dot unless they come first; or brackets around a whole
    number, or around a name in quotes of either kind, which may hold anything but that quote and is not empty.
    Two matches read it, so that every reading can be read where it is.
    """

    def plain(part: Column) -> Column:
        quoted = part.startswith("['") | part.startswith('["')
        return F.when(quoted, F.substr(part, F.lit(3), F.length(part) - 4)).otherwise(part)

    parts = F.regexp_extract_all(path, F.lit(f"{_NAME}|{_PLACE}"), F.lit(0))
    return F.when(path.rlike(_WHOLE_PATH), F.transform(parts, plain))


def path_conflicts(readings: DataFrame, key: Sequence[str]) -> DataFrame:
    """Places that make a record unusable: ``key, place, problem``.

    ``duplicate``: two readings for one place; ``nested``: a reading at a place that holds further
    places; ``invalid``: not a path. Readings without a path are left out. Paths are read in place, as few frequent ones
    would meet in few tasks of a join; then one aggregation over readings and their ancestors.
    """

    def known(parts: Column) -> Column:
        return F.struct(F.coalesce(parts, F.array("path")).alias("parts"), parts.isNotNull().alias("is_path"))

    read = readings.filter(F.col("path").isNotNull()).select(*key, _once(path_parts(F.col("path")), known).alias("_read"))
    parts = read.select(*key, "_read.parts", "_read.is_path")
    places = parts.select(
        "*", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth")
    ).select(
        *key,
        F.concat_ws("/", F.slice("parts", F.lit(1), F.col("depth"))).alias("place"),
        "is_path",
        (F.col("depth") == F.size("parts")).alias("leaf"),
    )
    leaves = F.count_if(F.col("leaf"))
    problem = (
        F.when(~F.col("is_path"), "invalid")
        .when(leaves > 1, "duplicate")
        .when((leaves > 0) & (leaves < F.count(F.lit(1))), "nested")
    )
    return (
        places.groupBy(*key, "place", "is_path")
        .agg(problem.alias("problem"))
        .filter(F.col("problem").isNotNull())
        .select(*key, "place", "problem")
    )


def nested_rows(readings: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per key: ``nested``, a VARIANT with every reading at its path, and ``conflicts``.

    Names are object keys; so are indexes, with their brackets, which keeps ``a[1]`` and ``a['1']`` apart (read with
    :func:`nested_value`). Values keep their kind; NULL stays, NaN and infinities are texts. ``conflicts`` counts
    readings that are no path, for a place that has one already, or below such a place; a record that has any
    has no ``nested`` (:func:`path_conflicts` tells which). Each distinct path is read once.

    Sorted by parts, the readings of an object lie together: each one closes what the one before has open beyond
    their common parts, and opens its own. A row holds all readings of its record, as its result does.
    """
    paths = readings.select("path").distinct().withColumn("_parts", path_parts(F.col("path")))

    def json(value: Column) -> Column:
        listed = F.to_json(F.array(value), {"ignoreNullFields": "false"})
        return F.substr(listed, F.lit(2), F.length(listed) - 2)

    leaves = readings.join(paths, "path", "left").select(
        *key, "_parts", json(F.col("value")).alias("_text")
    )
    legal = F.col("_parts").isNotNull()
    records = leaves.groupBy(*key).agg(
        F.sort_array(F.collect_list(F.when(legal, F.struct("_parts", "_text")))).alias("_leaves"),
        F.count_if(~legal).alias("_broken"),
    )

    def parts_at(i: Column) -> Column:
        before = F.get(F.col("_leaves"), i)["_parts"]
        return F.coalesce(before, F.array().cast("array<string>"))

    def differs(before: Column, own: Column) -> Column:
        """The first part in which two leaves differ, from 1; 0 if in none."""
        return F.array_position(F.zip_with(before, own, lambda a, b: a.eqNullSafe(b)), False).cast("int")

    def clashes(leaf: Column, i: Column) -> Column:
        before = parts_at(i - 1)
        at = differs(before, leaf["_parts"])
        return (i > 0) & ((at == 0) | (at > F.size(before)))

    def written(leaf: Column, i: Column) -> Column:
        before, own = parts_at(i - 1), leaf["_parts"]
        shared = differs(before, own) - 1
        opened = F.slice(own, shared + 1, F.size(own) - 1 - shared)
        return F.concat(
            F.when(i > 0, F.concat(F.repeat(F.lit("}"), F.size(before) - 1 - shared), F.lit(","))).otherwise(""),
            F.array_join(F.transform(opened, lambda name: F.concat(json(name), F.lit(":{"))), ""),
            json(F.element_at(own, -1)), F.lit(":"), leaf["_text"],
        )

    clashing = F.size(F.filter(F.transform("_leaves", clashes), lambda clash: clash))
    counted = records.select(*key, "_leaves", (clashing + F.col("_broken")).cast("long").alias("conflicts"))
    last = F.size(parts_at(F.size("_leaves") - 1))
    text = F.concat(F.lit("{"), F.array_join(F.transform("_leaves", written), ""), F.repeat(F.lit("}"), last))
    return counted.select(*key, F.when(F.col("conflicts") == 0, F.parse_json(text)).alias("nested"), "conflicts")


def nested_value(nested: str, parts: Sequence[str | int], kind: str = "double") -> Column:
    """The value at a place of ``nested``, as ``kind``; NULL if there is none or it is of another kind. Whole numbers
    among the parts are indexes."""
    steps = []
    for part in parts:
        name = f"[{part}]" if isinstance(part, int) else part
        quote = '"' if "'" in name else "'"
        steps.append(f"[{quote}{name}{quote}]")
    return F.try_variant_get(F.col(nested), "$" + "".join(steps), kind)


def merge_sides(key: Sequence[str], *sides: DataFrame) -> DataFrame:
    """Full outer merge of sides with one row per key each and different measures.

    Written as union and aggregation: one shuffle that combines map-side, where a full outer join
    would shuffle every side whole and could not split a hot key.
    """
    stacked = sides[0]
    for side in sides[1:]:
        stacked = stacked.unionByName(side, allowMissingColumns=True)
    measures = [c for c in stacked.columns if c not in key]
    return stacked.groupBy(*key).agg(*[F.max(c).alias(c) for c in measures])


def rack_columns(power: DataFrame, key: Sequence[str], racks: int = 3) -> DataFrame:
    """Per-rack power and loss under their table names; racks a unit lacks are NULL."""
    def pick(source: str, name: str) -> Column:
        col = F.col(f"`{source}`") if source in power.columns else F.lit(None)
        return col.cast("double").alias(name)

    return power.select(
        *key,
        *[pick(f"Rack {n}", f"rack_{n}_power") for n in range(1, racks + 1)],
        pick("Sum", "total_power"),
        *[pick(f"Loss {n}", f"rack_{n}_loss") for n in range(1, racks + 1)],
        pick("Loss", "total_loss"),
    )


def racks_to_rows(cdus: DataFrame, key: Sequence[str], racks: int = 3) -> DataFrame:
    """Long form: ``key, rack, power, loss`` for each rack that has a reading."""
    each = [
        F.struct(
            F.lit(n).alias("rack"),
            F.col(f"rack_{n}_power").alias("power"),
            F.col(f"rack_{n}_loss").alias("loss"),
        )
        for n in range(1, racks + 1)
    ]
    return (
        cdus.select(*key, F.explode(F.array(*each)).alias("r"))
        .select(*key, "r.*")
        .filter(F.col("power").isNotNull() | F.col("loss").isNotNull())
    )


def scale_units(df: DataFrame, factors: Mapping[str, float]) -> DataFrame:
    """Columns multiplied by a unit factor, e.g. megawatts to watts by 1e6."""
    return df.withColumns({c: F.col(c) * f for c, f in factors.items()})
