"""The registry of series primitives: effect, layer, category, argument patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ADD, SET = "additive", "overwrite"

#: The module from which generated programs import primitives, where a caller names no other.
PROGRAM_MODULE = "primitives"

#: Fixed values. name: (effect, default layer, catalog category, argument patterns any one of which must be
#: given, mutually exclusive pairs)
PRIMITIVES: dict[str, tuple[str, str, str | None, list[list[str]], list[tuple[str, str]]]] = {
    "add_trend": (ADD, "segment_structure", "trend", [["slope"], ["start_value", "end_value"], ["start_offset", "end_offset"]], [("slope", "start_value"), ("slope", "end_value"), ("slope", "start_offset"), ("slope", "end_offset"), ("start_value", "start_offset"), ("end_value", "end_offset")]),
    "add_ramp": (SET, "segment_structure", "trend", [["end_value"], ["slope"]], [("end_value", "slope")]),
    "add_flat": (SET, "segment_structure", "trend", [["target_value"]], []),
    "add_growth": (SET, "segment_structure", "trend", [], []),
    "add_decay": (SET, "segment_structure", "trend", [], []),
    "add_plateau": (SET, "segment_structure", None, [["target_value"], ["anchor_timestep"]], [("target_value", "anchor_timestep")]),
    "add_change_point": (ADD, "global_scaffold", "structural", [["level_change"], ["slope_change"]], []),
    "add_seasonality": (ADD, "texture", "seasonal", [["amplitude", "period"]], []),
    "add_peak": (ADD, "local_event", "local_event", [["amplitude"], ["target_value"]], [("amplitude", "target_value"), ("width", "spread")]),
    "add_trough": (ADD, "local_event", "local_event", [["amplitude"], ["target_value"]], [("amplitude", "target_value"), ("width", "spread")]),
    "add_spike": (ADD, "local_event", "local_event", [["amplitude"], ["target_value"]], [("amplitude", "target_value"), ("width", "half_width")]),
    "add_dip": (ADD, "local_event", "local_event", [["amplitude"], ["target_value"]], [("amplitude", "target_value"), ("width", "half_width")]),
    "add_outlier": (SET, "local_event", "local_event", [["target_value"], ["relative_change"], ["delta"]], [("target_value", "relative_change"), ("target_value", "delta"), ("relative_change", "delta")]),
    "add_level_shift": (ADD, "global_scaffold", "structural", [["start_timestep", "shift"], ["start_timestep", "target_value"], ["anchor_timestep", "shift"], ["anchor_timestep", "target_value"]], [("shift", "target_value"), ("start_timestep", "anchor_timestep")]),
    "add_gap": (SET, "missingness", "structural", [], []),
    "add_noise": (ADD, "texture", "stochastic", [["noise_scale"]], [("random_seed", "random_generator")]),
    "add_volatility": (SET, "texture", "stochastic", [["volatility_scale"]], []),
}

LAYERS = ["global_scaffold", "segment_structure", "texture", "local_event", "missingness"]

SCHEMA = "primitive string, effect_type string, layer string, category string, required array<array<string>>, exclusive array<array<string>>"


def registry(spark: SparkSession) -> DataFrame:
    """A dimension table of 17 rows."""
    return spark.createDataFrame([(n, e, lay, c, r, [list(p) for p in x]) for n, (e, lay, c, r, x) in PRIMITIVES.items()], SCHEMA)


def _case(name: Column, of: int) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for n, row in PRIMITIVES.items() if row[of] is not None for x in (n, row[of])]), name)


def effect_of(name: Column) -> Column:
    return _case(name, 0)


def layer_of(name: Column) -> Column:
    return _case(name, 1)


def argument_error(name: Column, params: Column) -> Column:
    """The first registry rule that a step's parameters break, or null."""
    has = lambda k: F.map_contains_key(params, F.lit(k))
    out = F.when(~name.isin(*PRIMITIVES), F.lit("unknown_primitive"))
    for n, (_, _, _, required, exclusive) in PRIMITIVES.items():
        for a, b in exclusive:
            out = out.when((name == n) & has(a) & has(b), F.lit(f"exclusive:{a},{b}"))
        if required:
            some = F.lit(False)
            for pattern in required:
                whole = F.lit(True)
                for k in pattern:
                    whole = whole & has(k)
                some = some | whole
            out = out.when((name == n) & ~some, F.lit("missing_arguments"))
    return out
