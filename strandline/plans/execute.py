"""Execution of plans: a fold over the ordered steps, with guards, and checks of generated programs.

The state of the fold is one struct (series, touched and gap masks, constraints, trace, error); once there is
an error, later steps leave it as it is. So a plan of any length is one expression over its row.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import primitives as P
from ..functions.primitives import let
from . import plan as L
from .registry import PRIMITIVES, PROGRAM_MODULE, argument_error

_NONE = "array<struct<id:string,values:array<double>>>"
LARGEST = 10_000.0


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def _normals(seeds, lengths):
    import numpy as np
    import pandas as pd

    draw = lambda s, n: [] if s is None or np.isnan(s) else np.random.default_rng(int(s)).normal(0.0, 1.0, int(n)).tolist()
    return pd.Series([None if a is None else [draw(s, n) for s, n in zip(a, b)] for a, b in zip(seeds, lengths)])


def noise_of(steps: Column, length: Column) -> Column:
    """Unit normals for each step, empty where it is not noise; a column of its own, since lambdas take no Python."""
    seeds = F.transform(steps, lambda s: F.when(s["primitive"] == "add_noise", F.coalesce(L.number(s, "random_seed"), F.lit(7.0))))
    lengths = F.transform(steps, lambda s: F.greatest(L.affected(s, length)["end"] - L.affected(s, length)["start"] + 1, F.lit(0)))
    return _normals(seeds, lengths)


def _unstable(values: Column, touched: Column, gaps: Column) -> Column:
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    bad = F.transform(values, lambda v, i: F.get(touched, i) & F.when(finite(v), F.abs(v) > LARGEST).otherwise(~F.get(gaps, i)))
    return F.exists(bad, lambda b: b)


def violated(constraint: Column, values: Column) -> Column:
    """Whether a series breaks a protected constraint."""
    inside = P.window(values, constraint["start"], constraint["end"])
    near = F.coalesce(constraint["tolerance"], F.lit(1e-6))
    steps = F.zip_with(F.slice(inside, 2, F.greatest(F.size(inside) - 1, F.lit(0))), F.slice(inside, 1, F.greatest(F.size(inside) - 1, F.lit(0))), lambda b, a: b - a)
    off = lambda v: F.coalesce(F.isnan(v) | (F.abs(v - constraint["value"]) > near), F.lit(True))
    return (
        F.when(constraint["kind"] == "constant_segment", F.exists(inside, off))
        .when(constraint["kind"] == "monotone_window", F.exists(steps, lambda d: F.isnan(d) | F.when(constraint["direction"] == "nondecreasing", d < -1e-8).otherwise(d > 1e-8)))
        .when(constraint["kind"] == "point_value", off(F.get(values, constraint["timestep"])))
        .otherwise(False)
    )


def fold(steps: Column, length: Column, normals: Column | None = None, *, guarded: bool = True, gaps_allowed: bool = True, protect: bool = True, traced: bool = False) -> Column:
    """``struct<values, error, trace>`` of steps applied in the order given, from zeros."""
    length = length.cast("int")
    flags = F.array_repeat(F.lit(False), length)
    zero = F.struct(
        F.array_repeat(F.lit(0.0), length).alias("values"), flags.alias("touched"), flags.alias("gaps"), F.array().cast(f"array<{L.CONSTRAINT}>").alias("constraints"),
        F.array().cast(_NONE).alias("trace"), F.lit(None).cast("string").alias("error"))
    noise = normals if normals is not None else F.transform(steps, lambda s: F.array().cast("array<double>"))
    indexed = F.transform(steps, lambda s, i: F.struct(s.alias("step"), F.get(noise, i).alias("normals")))

    def one(state: Column, x: Column) -> Column:
        # parameters and window are bound once: the primitives name them many times
        bound = F.struct(P.typed(x["step"]["parameters"]).alias("q"), L.affected(x["step"], length).alias("at"), F.coalesce(L.param(x["step"], "waveform"), F.lit("sine")).alias("waveform"))
        return F.when(state["error"].isNotNull(), state).otherwise(let(bound, lambda b: applied(state, x, b)))

    def applied(state: Column, x: Column, b: Column) -> Column:
        s, values = x["step"], state["values"]
        g, at, waveform = P.from_struct(b["q"]), b["at"], b["waveform"]
        inside = lambda i: (i >= at["start"]) & (i <= at["end"])
        refused = F.coalesce(F.when(argument_error(s["primitive"], s["parameters"]).isNotNull(), "invalid_primitive_args"), F.when(P.value_error(s["primitive"], values, g, waveform).isNotNull(), "execution_failed"))
        if guarded:
            bare = F.exists(F.transform(values, lambda v, i: inside(i) & ~F.get(state["touched"], i) & ~F.coalesce(F.abs(v) <= 1e-12, F.lit(False))), lambda b: b)
            refused = F.coalesce(F.when((s["effect_type"] == "additive") & bare, "additive_without_baseline"), refused)

        def after(v: Column) -> Column:
            touched = F.transform(state["touched"], lambda t, i: t | inside(i))
            missing = (s["primitive"] == "add_gap") & (g("fill_value").isNull() | F.isnan(g("fill_value")))
            gaps = F.transform(state["gaps"], lambda t, i: t | (missing & inside(i))) if gaps_allowed else state["gaps"]
            held = F.concat(state["constraints"], F.coalesce(s["protected_constraints"], F.array().cast(f"array<{L.CONSTRAINT}>"))) if protect else state["constraints"]
            error = F.lit(None).cast("string")
            if guarded:
                error = F.when(_unstable(v, touched, gaps), "numeric_range_explosion")
                if protect:
                    error = F.coalesce(error, F.when(F.exists(held, lambda c: violated(c, v)), "protected_constraint_violation"))
            trace = F.array_append(state["trace"], F.struct(s["id"].alias("id"), v.alias("values"))) if traced else state["trace"]
            return F.struct(v.alias("values"), touched.alias("touched"), gaps.alias("gaps"), held.alias("constraints"), trace.alias("trace"), error.alias("error"))

        done = let(P.apply_step(s["primitive"], values, g, waveform, x["normals"]), after)
        return let(refused, lambda r: F.when(r.isNotNull(), state.withField("error", r)).otherwise(done))

    return F.aggregate(indexed, zero, one, lambda st: F.struct(F.when(st["error"].isNull(), st["values"]).alias("values"), st["error"].alias("error"), st["trace"].alias("trace")))


def execute(steps: Column, length: Column, normals: Column | None = None, **how) -> Column:
    """The fold over steps in plan order; ``normals`` go with the ordered steps (see ``noise_of``)."""
    return fold(L.ordered(steps), length, normals, **how)


def replay(steps: Column, length: Column, normals: Column | None = None) -> Column:
    """Without guards, keeping the series after each step."""
    return execute(steps, length, normals, guarded=False, traced=True)


def as_listed(steps: Column, length: Column, normals: Column | None = None) -> Column:
    """Primitive steps in the order of the list, without guards."""
    return fold(F.filter(steps, L.is_primitive), length, normals, guarded=False)


def run_plans(plans: DataFrame, plan: str = "plan", length: str = "length") -> DataFrame:
    """Adds ``series``, ``execution`` (ok, rejected, fallback, failed) and ``warning``.

    A declined plan has no series; one that parsing or a guard refuses is applied in listed order.
    """
    p = F.col(plan)
    rows = plans.withColumns({"__rejected": L.rejected(p), "__order": L.ordered(p["steps"]), "__list": F.filter(p["steps"], L.is_primitive)})
    n = F.col(length)
    rows = rows.withColumns({"__z1": noise_of(F.col("__order"), n), "__z2": noise_of(F.col("__list"), n)})
    used = F.array_distinct(F.transform("__list", lambda s: s["primitive"]))
    rows = rows.withColumn("__refused", L.parse_error(p, used, n)).withColumn("__first", F.when(~F.col("__rejected") & F.col("__refused").isNull(), fold(F.col("__order"), n, F.col("__z1"))))
    warning = F.coalesce("__refused", F.col("__first.error"))
    rows = rows.withColumn("warning", F.when(~F.col("__rejected"), warning)).withColumn("__second", F.when(F.col("warning").isNotNull(), fold(F.col("__list"), n, F.col("__z2"), guarded=False)))
    state = F.when(F.col("__rejected"), "rejected").when(F.col("warning").isNull(), "ok").when(F.col("__second.error").isNull(), "fallback").otherwise("failed")
    rows = rows.withColumns({"series": F.coalesce("__first.values", "__second.values"), "execution": state})
    return rows.drop("__rejected", "__order", "__list", "__z1", "__z2", "__refused", "__first", "__second")


# Generated programs: they are checked, never run.

_PLAIN = (ast.Module, ast.Import, ast.ImportFrom, ast.alias, ast.Assign, ast.Expr, ast.Name, ast.Load, ast.Store, ast.Constant, ast.Call, ast.keyword, ast.Attribute, ast.BinOp, ast.UnaryOp, ast.operator, ast.unaryop, ast.Subscript, ast.Slice, ast.List, ast.Tuple)


def program_fault(code: str | None, allowed: list[str], module: str = PROGRAM_MODULE) -> str | None:
    """The first reason to refuse a program, or None: only imports, and calls of allowed primitives assigned to ``series``."""
    try:
        tree = ast.parse(code or "")
    except SyntaxError:
        return "contract_invalid"
    called = 0
    for node in ast.walk(tree):
        if not isinstance(node, _PLAIN):
            return "contract_invalid"
        if isinstance(node, ast.Import) and [(a.name, a.asname) for a in node.names] != [("numpy", "np")]:
            return "contract_invalid"
        if isinstance(node, ast.ImportFrom) and (node.module != module or {a.name for a in node.names} - set(allowed)):
            return "contract_invalid"
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
            if node.func.id not in allowed or node.func.id not in PRIMITIVES or any(k.arg is None for k in node.keywords):
                return "contract_invalid"
            called += 1
            effect, _, _, required, exclusive = PRIMITIVES[node.func.id]
            given = {k.arg: k.value for k in node.keywords}
            if any(a in given and b in given for a, b in exclusive) or (required and not any(set(r) <= set(given) for r in required)):
                return "invalid_primitive_args"
            if effect == "additive" and any(isinstance(n, ast.Name) and n.id == "series" for k, v in given.items() if k in ("amplitude", "target_value", "shift", "level_change") for n in ast.walk(v)):
                return "additive_as_setter"
        if isinstance(node, ast.Assign) and not (len(node.targets) == 1 and isinstance(node.targets[0], ast.Name) and node.targets[0].id == "series"):
            return "contract_invalid"
    kept = all(isinstance(n, (ast.Import, ast.ImportFrom, ast.Assign)) for n in tree.body)
    return None if called and kept else "contract_invalid"


def check_programs(rows: DataFrame, code: str = "code", candidates: str = "candidates", module: str = PROGRAM_MODULE) -> DataFrame:
    """Adds ``fault``; the texts are parsed in Arrow batches."""
    shape = T.StructType([*rows.schema.fields, T.StructField("fault", T.StringType())])

    def run(frames: Iterator) -> Iterator:
        for frame in frames:
            yield frame.assign(fault=[program_fault(c, list(a), module) for c, a in zip(frame[code], frame[candidates])])

    return rows.mapInPandas(run, shape)


FINAL_VALUE = [r"(?:last value|ends at|ending at|end[s]?\s+(?:at|near)|final value(?: of)?|stabilizes at)\s+(\d+\.\d+)", r"(?:value\s+)(\d+\.\d+)\s*$"]


def plausibility(series: Column, caption: Column) -> Column:
    """Reasons for which a series is no likely answer to its caption."""
    low = F.lower(caption)
    stated = F.transform(F.regexp_extract_all(caption, F.lit(r"\d+\.\d+"), F.lit(0)), lambda x: x.cast("double"))
    m, spread = P.mean(series), P.stddev(series)
    hint = F.coalesce(*[F.regexp_extract(low, p, 1).try_cast("double") for p in FINAL_VALUE])
    tail = P.mean(F.slice(series, -F.least(F.lit(8), F.size(series)), F.lit(8)))
    calm = L.has_any(low, ["stable", "minimal fluctuation", "low volatility"])
    largest = F.array_max(F.transform(P.finite(series), lambda v: F.abs(v)))
    return F.array_compact(F.array(
        F.when(F.exists(stated, lambda x: x > 1e-8) & F.forall(series, lambda v: F.abs(v) <= 1e-8), "zero_series_output"), F.when(largest > LARGEST, "numeric_range_explosion"),
        F.when(calm & (spread > F.greatest(F.lit(0.25), 0.1 * F.greatest(F.abs(m), F.lit(1.0)))), "excessive_variance"), F.when(F.abs(tail - hint) > F.greatest(F.lit(0.25), F.abs(hint) * 0.05), "endpoint_mismatch")))


def direct_array(text: Column, length: Column) -> Column:
    """``struct<series, error>`` of an answer that is an object with ``series`` or holds a bracketed list."""
    inside = F.coalesce(F.get_json_object(L.json_text(text), "$.series"), F.when(F.try_parse_json(L.json_text(text)).isNull(), F.nullif(F.regexp_extract(text, r"(?s)(\[.*\])", 1), F.lit(""))))
    values = F.from_json(inside, "array<double>")
    bad = F.when(inside.isNull(), "no_list").when(values.isNull() | F.exists(values, lambda v: v.isNull()), "not_one_dimensional").when(F.size(values) != length, F.format_string("length %d does not match expected length %d", F.size(values), length))
    return F.struct(F.when(bad.isNull(), values).alias("series"), bad.alias("error"))
