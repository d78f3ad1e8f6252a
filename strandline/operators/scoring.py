"""Scoring of cases: signal checks as data, features matched to steps, reports and failure labels.

A case is one row: its specification (features), a plan and a series. All is array work within the row, so
scoring is one narrow stage; only aggregates over cases shuffle.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import examples, query
from ..functions import primitives as P
from ..functions.primitives import let
from ..plans import execute as X
from ..plans import plan as L
from ..plans import schema as S
from ..sources.series import POINTS_SQL, rounded, rounded_sql, user_series
from . import checkers
from .plan_queries import FLAT, SPIKE, plan, step, steps_of, unresolved
from .reports import LABELS, iou

INFINITE = float("inf")
_WINDOW = "struct<start:int,end:int>"
_SEGMENT = "array<struct<start:int,end:int,value:double,tolerance:double>>"
CHECKS = (
    f"struct<length:int,point_values:array<struct<timestep:int,value:double,tolerance:double>>,constant_segments:{_SEGMENT},unchanged_windows:{_SEGMENT},monotone_windows:array<struct<start:int,end:int,direction:string>>,"
    f"argmax_in:array<int>,argmin_in:array<int>,value_bounds:struct<min:double,max:double>,nonconstant_windows:array<{_WINDOW}>,variance_comparison:struct<reference_window:array<int>,target_window:array<int>,expect:string>,"
    "periodicity_hint:string,deterministic_seed:int>"
)
FEATURE = f"struct<id:string,semantic:string,expected_primitives:array<string>,window:{_WINDOW},parameters:map<string,string>,effect_type:string,checker:string,required:boolean,tolerance:double,forbidden:array<string>>"
RESULT = "array<struct<id:string,passed:boolean,error:double>>"


# Signal checks


def _result(id: Column, passed: Column, error: Column) -> Column:
    return F.struct(id.alias("id"), F.coalesce(passed, F.lit(False)).alias("passed"), F.coalesce(error, F.lit(INFINITE)).cast("double").alias("error"))


def _bounded(s: Column, a: Column, b: Column) -> Column:
    """The window, or nothing where it leaves the series."""
    return F.when((a >= 0) & (b >= a) & (b < F.size(s)), P.window(s, a, b)).otherwise(F.array().cast("array<double>"))


def _spread(x: Column) -> Column:
    return P.stddev(P.finite(x))


def _numbered(items: Column, name: str, f) -> Column:
    return F.coalesce(F.transform(items, lambda x, i: f(x, F.concat(F.lit(f"{name}_"), (i + 1).cast("string")))), F.array().cast(RESULT))


def signal_checks(s: Column, checks: Column) -> Column:
    """One result for each check of ``checks`` (see ``CHECKS``), in their order."""
    inside = lambda x: _bounded(s, x["start"], x["end"])
    near = lambda x: F.coalesce(x["tolerance"], F.lit(1e-6))
    differences = lambda x: F.zip_with(F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))), lambda b, a: b - a)
    one = lambda there, r: F.when(there, F.array(r)).otherwise(F.array().cast(RESULT))
    finite = P.finite(s)

    def point(x: Column, id: Column) -> Column:
        off = F.abs(F.when((x["timestep"] >= 0) & (x["timestep"] < F.size(s)), F.get(s, x["timestep"])) - x["value"])
        return _result(id, off <= near(x), off)

    def level(x: Column, id: Column) -> Column:
        v = inside(x)
        off = F.greatest(F.array_max(F.transform(P.finite(v), lambda y: F.abs(y - x["value"]))), _spread(v))
        return let(F.when(F.size(P.finite(v)) > 0, off), lambda e: _result(id, e <= near(x), e))

    def monotone(x: Column, id: Column) -> Column:
        d = differences(inside(x))
        up, down = F.greatest(F.lit(0.0), -F.array_min(d)), F.greatest(F.lit(0.0), F.array_max(d))
        off = F.when(F.size(d) > 0, F.when(x["direction"] == "nondecreasing", up).when(x["direction"] == "nonincreasing", down))
        return _result(id, off <= 1e-8, off)

    def varied(x: Column, id: Column) -> Column:
        ok = F.when(F.size(inside(x)) > 1, _spread(inside(x)) > 1e-12)
        return _result(id, ok, F.when(ok, 0.0).when(~ok, 1.0))

    def extreme(name: str, best: Column) -> Column:
        at = F.array_position(s, best) - 1
        ok = F.when(F.size(finite) > 0, (at >= checks[name][0]) & (at <= checks[name][1]))
        return one(checks[name].isNotNull(), _result(F.lit(name), ok, F.when(ok, 0.0).when(~ok, 1.0)))

    bounds, compared = checks["value_bounds"], checks["variance_comparison"]
    outside = F.greatest(F.lit(0.0), bounds["min"] - F.array_min(finite), F.array_max(finite) - bounds["max"])
    sides = [_bounded(s, compared[k][0], compared[k][1]) for k in ("reference_window", "target_window")]
    more = _spread(sides[1]) - _spread(sides[0])
    gain = F.when((F.size(sides[0]) > 1) & (F.size(sides[1]) > 1), F.when(F.coalesce(compared["expect"], F.lit("target_greater")) == "target_greater", more).otherwise(-more))
    return F.concat(
        one(checks["length"].isNotNull(), _result(F.lit("length"), F.size(s) == checks["length"], F.abs(F.size(s) - checks["length"]))), _numbered(checks["point_values"], "point_value", point),
        _numbered(checks["constant_segments"], "constant_segments", level), _numbered(checks["unchanged_windows"], "unchanged_windows", level), _numbered(checks["monotone_windows"], "monotone_window", monotone),
        extreme("argmax_in", F.array_max(finite)), extreme("argmin_in", F.array_min(finite)), one(bounds.isNotNull(), _result(F.lit("value_bounds"), F.when(F.size(s) > 0, outside <= 1e-8), F.when(F.size(s) > 0, outside))),
        _numbered(checks["nonconstant_windows"], "nonconstant_window", varied), one(compared.isNotNull(), _result(F.lit("variance_comparison"), gain > 0, F.greatest(F.lit(0.0), -gain))),
        one(checks["periodicity_hint"].isNotNull(), _result(F.lit("periodicity_hint"), F.lit(True), F.lit(0.0))), one(checks["deterministic_seed"].isNotNull(), _result(F.lit("deterministic_seed"), F.lit(True), F.lit(0.0))),
    )


def seed_reproduces(steps: Column, length: Column, normals: Column, again: Column) -> Column:
    """Whether two executions with the plan's seeds give one series."""
    same = F.zip_with(X.as_listed(steps, length, normals)["values"], X.as_listed(steps, length, again)["values"], lambda a, b: a.eqNullSafe(b))
    return F.forall(same, lambda x: x)


# Features and steps


def step_window(s: Column, length: Column, rounded_width: bool = False) -> Column:
    """The inclusive window that a step's parameters state, or null; events reach by their width on both sides.

    ``rounded_width``: other events than spikes and dips take a rounded ``width`` or ``spread``.
    """
    a, b, at, anchor, final = L.whole(s, "start_timestep"), L.whole(s, "end_timestep"), L.whole(s, "timestep"), L.whole(s, "anchor_timestep"), length - 1
    width = F.coalesce(L.whole(s, "half_width"), L.whole(s, "width"), F.lit(0))
    if rounded_width:
        width = F.when(s["primitive"].isin("add_spike", "add_dip"), width).otherwise(F.bround(F.coalesce(L.number(s, "width"), L.number(s, "spread"), F.lit(0.0))).cast("int"))
    pair = lambda x, y: F.struct(x.cast("int").alias("start"), y.cast("int").alias("end"))
    return (
        F.when(a.isNotNull() & b.isNotNull(), pair(a, b)).when(anchor.isNotNull(), pair(anchor, F.coalesce(b, final)))
        .when(at.isNotNull(), pair(F.greatest(F.lit(0), at - width), F.least(final, at + width))).when(a.isNotNull() | b.isNotNull(), pair(F.coalesce(a, F.lit(0)), F.coalesce(b, final)))
    )


def overlap(x: Column, y: Column) -> Column:
    return iou(x["start"], x["end"], y["start"], y["end"])


def best_step(feature: Column, steps: Column, length: Column) -> Column:
    """The step of an allowed primitive whose window overlaps the feature's most; the first of equals."""
    fit = F.filter(steps, lambda s: L.is_primitive(s) & F.array_contains(feature["expected_primitives"], s["primitive"]))
    ranked = F.transform(fit, lambda s, i: F.struct(F.when(feature["window"].isNull(), 0.0).otherwise(overlap(feature["window"], step_window(s, length))).alias("o"), (-i).alias("i")))
    return F.get(fit, -F.array_max(ranked)["i"])


def f1_with_alternatives(expected: Column, used: Column) -> Column:
    """F1 of a greedy match: each expectation, a set of names, takes the first used name that it allows."""
    zero = F.struct(used.alias("left"), F.lit(0).alias("n"))

    def take(st: Column, options: Column) -> Column:
        hits = F.transform(st["left"], lambda u: F.array_contains(options, u))
        at = F.array_position(hits, F.lit(True)).cast("int")
        rest = F.concat(F.slice(st["left"], 1, F.greatest(at - 1, F.lit(0))), F.slice(st["left"], at + 1, F.size(st["left"])))
        return F.when(at > 0, F.struct(rest.alias("left"), (st["n"] + 1).alias("n"))).otherwise(st)

    matched = F.aggregate(expected, zero, take, lambda st: st["n"])
    return F.when((F.size(expected) == 0) & (F.size(used) == 0), 1.0).when((F.size(expected) == 0) | (F.size(used) == 0), 0.0).otherwise(2.0 * matched / F.greatest(F.size(expected) + F.size(used), F.lit(1)))


def parameter_error(feature: Column, s: Column, length: Column) -> Column:
    """Mean of capped relative errors of a feature's parameters; positions and periods count by the length."""

    def one(e: Column) -> Column:
        got = F.try_element_at(s["parameters"], e["key"])
        x, y = e["value"].try_cast("double"), got.try_cast("double")
        by = F.when(e["key"].contains("timestep") | (e["key"] == "period"), F.greatest(F.lit(1.0), length.cast("double"))).otherwise(F.greatest(F.lit(1.0), F.abs(x)))
        return F.when(got.isNull(), 1.0).when(x.isNull() | y.isNull(), F.when(got == e["value"], 0.0).otherwise(1.0)).otherwise(F.least(F.lit(1.0), F.abs(y - x) / by))

    errors = F.transform(F.map_entries(F.coalesce(feature["parameters"], F.create_map().cast("map<string,string>"))), one)
    return F.when(s.isNull(), 1.0).otherwise(P.mean(errors))


def _mean_or(values: Column, otherwise: Column) -> Column:
    return F.when(F.size(values) > 0, P.mean(values)).otherwise(otherwise)


def check_feature(feature: Column, s: Column, used: Column) -> Column:
    """A feature's checker on a series, within the feature's window."""
    named = F.map_filter(F.coalesce(feature["parameters"], F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin("start_timestep", "end_timestep", "tolerance"))
    window = F.create_map(F.lit("start_timestep"), F.coalesce(feature["window"]["start"], F.lit(0)).cast("string"), F.lit("end_timestep"), F.coalesce(feature["window"]["end"], F.size(s) - 1).cast("string"), F.lit("tolerance"), F.coalesce(feature["tolerance"], F.lit(1e-6)).cast("string"))
    denied = checkers.check_negation(F.coalesce(feature["forbidden"], F.array().cast("array<string>")), used)
    # series and parameters are bound once: the checkers name them many times
    held = let(s, lambda x: let(P.typed(F.map_concat(named, window)), lambda q: checkers.check(feature["checker"], x, P.from_struct(q))))
    return F.when(feature["checker"] == "check_negation", denied).otherwise(held)


def _failure(when: Column, stage: str, code: str, message: Column | str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(when, F.struct(F.lit(stage).alias("stage"), F.lit(code).alias("code"), text.alias("message")))


def _first_column(rows: DataFrame, name: str, otherwise: Column) -> Column:
    return F.coalesce(F.col(name), otherwise) if name in rows.columns else otherwise


def evaluate_cases(cases: DataFrame) -> DataFrame:
    """Scores plans and their series against specifications.

    ``cases`` has ``features``, ``unsupported`` (ids), ``length``, ``plan``, ``series`` and may have
    ``registry_valid``, ``plan_valid``, ``execution_success`` and ``code_safe``. A case passes if registry, plan and
    execution are good, the series is what a replay of the plan gives, it is not wrongly declined and nine tenths of its
    required features hold on the series after their matched steps; one that must be declined passes if it is.
    """
    n, s, p = F.col("length"), F.col("series"), F.col("plan")
    rows = cases.withColumns({"__required": F.filter("features", lambda f: F.coalesce(f["required"], F.lit(True))), "__steps": F.filter(p["steps"], L.is_primitive), "rejected": L.rejected(p), "requires_rejection": F.coalesce(F.size("unsupported"), F.lit(0)) > 0})
    rows = rows.withColumns({
        "registry_valid": _first_column(rows, "registry_valid", F.lit(True)), "plan_valid": _first_column(rows, "plan_valid", F.lit(True)), "execution_success": _first_column(rows, "execution_success", s.isNotNull()), "code_safe": _first_column(rows, "code_safe", F.lit(True)),
        "__used": F.transform("__steps", lambda x: x["primitive"]), "__matched": F.transform("__required", lambda f: best_step(f, F.col("__steps"), n)), "__order": L.ordered(p["steps"]),
    })
    rows = rows.withColumn("__noise", X.noise_of(F.col("__order"), n)).withColumn("__replay", F.when(F.col("plan_valid") & s.isNotNull() & ~F.col("rejected") & ~F.col("requires_rejection"), X.fold(F.col("__order"), n, F.col("__noise"), guarded=False, traced=True)))
    positive = F.filter(F.col("__required"), lambda f: f["checker"] != "check_negation")
    expected = F.transform(F.filter(positive, lambda f: F.size(f["expected_primitives"]) > 0), lambda f: f["expected_primitives"])
    pairs = F.filter(F.arrays_zip(F.col("__required").alias("f"), F.col("__matched").alias("s")), lambda x: x["f"]["checker"] != "check_negation")
    windows = F.transform(F.filter(pairs, lambda x: x["f"]["window"].isNotNull() & x["s"].isNotNull()), lambda x: overlap(x["f"]["window"], step_window(x["s"], n)))
    same = F.zip_with(s, F.col("__replay.values"), lambda a, b: F.when(F.isnan(a) | F.isnan(b), F.isnan(a) & F.isnan(b)).otherwise(F.abs(a - b) <= 1e-8 + 1e-8 * F.abs(b)))
    matches = F.when(F.col("__replay").isNull(), True).otherwise(F.col("__replay.error").isNull() & F.forall(same, lambda x: F.coalesce(x, F.lit(False))))
    after = lambda f, m: F.coalesce(F.when(f["checker"] != "check_negation", F.get(F.filter(F.col("__replay.trace"), lambda t: t["id"] == m["id"]), F.lit(0))["values"]), s)
    rows = rows.withColumns({
        "primitive_f1": f1_with_alternatives(expected, F.col("__used")), "window_iou": _mean_or(windows, F.when(F.size(positive) == 0, 1.0).otherwise(0.0)), "parameter_error": _mean_or(F.transform(pairs, lambda x: parameter_error(x["f"], x["s"], n)), F.lit(0.0)), "signal_matches": matches,
        "checks": F.when(s.isNotNull() & ~F.col("rejected") & ~F.col("requires_rejection"), F.zip_with("__required", "__matched", lambda f, m: let(check_feature(f, after(f, m), F.col("__used")), lambda c: _result(f["id"], c["passed"], c["error"])))).otherwise(F.array().cast(RESULT)),
    })
    return _verdicts(rows, direct=False).drop("__required", "__steps", "__used", "__matched", "__order", "__noise", "__replay")


def evaluate_signals(cases: DataFrame) -> DataFrame:
    """Scores final series only: by ``signal_checks`` (see ``CHECKS``) where given, else by the features' checkers.

    A case that must be declined cannot be told from a series and fails.
    """
    s = F.col("series")
    rows = cases.withColumns({"rejected": F.lit(False), "requires_rejection": F.coalesce(F.size("unsupported"), F.lit(0)) > 0, "registry_valid": _first_column(cases, "registry_valid", F.lit(True)), "plan_valid": F.lit(False), "execution_success": _first_column(cases, "execution_success", s.isNotNull()), "code_safe": F.lit(True)})
    required = F.filter("features", lambda f: F.coalesce(f["required"], F.lit(True)))
    own = F.transform(required, lambda f: let(check_feature(f, s, F.array().cast("array<string>")), lambda c: _result(f["id"], c["passed"], c["error"])))
    found = F.when(F.col("signal_checks").isNotNull(), signal_checks(s, F.col("signal_checks"))).otherwise(own)
    rows = rows.withColumns({"primitive_f1": F.lit(0.0), "window_iou": F.lit(0.0), "signal_matches": F.lit(True), "checks": F.when(s.isNotNull() & ~F.col("requires_rejection"), found).otherwise(F.array().cast(RESULT))})
    return _verdicts(rows.withColumn("parameter_error", F.lit(0.0)), direct=True)


def _verdicts(rows: DataFrame, direct: bool) -> DataFrame:
    s, must, declined = F.col("series"), F.col("requires_rejection"), F.col("rejected")
    share = P.mean(F.transform("checks", lambda c: c["passed"].cast("double")))
    none = F.when(s.isNull(), 0.0).otherwise(1.0) if direct else F.when(F.size(F.filter("features", lambda f: F.coalesce(f["required"], F.lit(True)))) > 0, 0.0).otherwise(1.0)
    csr = F.when(must, F.lit(0.0) if direct else declined.cast("double")).otherwise(F.when(F.size("checks") > 0, share).otherwise(none))
    rows = rows.withColumns({"csr": csr, "correct_rejection": must & declined, "false_rejection": ~must & declined, "hallucinated": must & (s.isNotNull() if direct else ~declined)})
    supported = F.col("registry_valid") & F.col("execution_success") & (F.col("csr") >= 0.9)
    if not direct:
        supported = supported & F.col("plan_valid") & F.col("signal_matches") & ~F.col("false_rejection")
    passed = F.when(must, F.lit(False) if direct else F.col("registry_valid") & F.col("plan_valid") & declined).otherwise(supported)
    semantic = F.col("csr") if direct else F.when(must, F.col("csr")).otherwise((F.col("csr") + F.col("primitive_f1") + F.greatest(F.lit(0.0), 1 - F.col("parameter_error"))) / 3)
    found = F.transform(F.filter("checks", lambda c: ~c["passed"]), lambda c: F.struct(F.lit("evaluation").alias("stage"), F.lit("F_semantic").alias("code"), c["id"].alias("message")))
    lone = F.array_compact(F.array(
        _failure(~F.col("registry_valid"), "registry_validation", "F_schema", "registry schema validation failed"), _failure(F.lit(not direct) & ~F.col("plan_valid"), "plan_validation", "F_schema", "plan schema validation failed"),
        _failure(~F.col("code_safe"), "code_generation", "F_safety", "generated code failed safety validation"), _failure(F.col("hallucinated"), "evaluation" if direct else "planning", "F_rejection", "unsupported semantics were generated instead of rejected"),
        _failure(F.col("false_rejection"), "planning", "F_rejection", "supported case was incorrectly rejected"), _failure(~must & s.isNull() & ~declined, "execution", "F_execution", "no executed signal was provided"), _failure(~F.col("signal_matches"), "execution", "F_execution", "provided signal does not match replayed plan execution")))
    rows = rows.withColumns({"passed": passed, "semantic_score": semantic, "failures": F.concat(lone, found)})
    if direct:
        rows = rows.withColumn("parameter_error", F.when(F.col("passed"), 0.0).otherwise(1.0))
    return rows.withColumn("direct", F.lit(direct))


def aggregate_results(results: DataFrame, *keys: str) -> DataFrame:
    """Means over cases; correct rejection and hallucination over those to decline, false rejection over the others."""
    mean = lambda c: F.avg(F.col(c).cast("double"))
    of = lambda c, kind: F.avg(F.when(F.col("requires_rejection") == kind, F.col(c).cast("double")))
    return results.groupBy(*keys).agg(
        F.count("*").alias("cases"), mean("passed").alias("pass_rate"), *(mean(c).alias(c) for c in ("csr", "primitive_f1", "window_iou", "parameter_error")),
        of("correct_rejection", True).alias("crr"), of("false_rejection", False).alias("frr"), of("hallucinated", True).alias("hus"),
    )


def report(results: DataFrame, description: str = "description") -> DataFrame:
    """Adds ``report``, the evaluation report as JSON, and ``report_errors`` of its contract."""
    status = lambda ok, path: F.struct(F.when(ok, "valid").otherwise("invalid").alias("status"), F.lit(f"schemas/{path}.schema.json").alias("schema_path"), F.lit(path).alias("target_path"), F.array().cast("array<string>").alias("errors"))
    plan_status = F.when(F.col("direct"), status(F.lit(True), "plan").withField("status", F.lit("not_run"))).otherwise(status(F.col("plan_valid"), "plan"))
    code = F.struct(F.lit("not_run").alias("status"), F.lit(False).alias("draft_generated"), F.lit(False).alias("final_generated"), F.array().cast("array<string>").alias("errors"))
    run = F.struct(F.when(F.col("execution_success"), "success").otherwise("not_run").alias("status"), F.when(F.col("execution_success"), F.array().cast("array<string>")).otherwise(F.array(F.lit("execution was not provided to the core evaluator"))).alias("errors"))
    score = F.struct(
        F.col("semantic_score").alias("overall"), F.when(F.col("direct"), F.col("csr")).otherwise(F.col("primitive_f1")).alias("description_to_plan"),
        F.when(F.col("plan_valid") | F.col("direct"), 1.0).otherwise(0.0).alias("plan_to_code"), F.when(F.col("execution_success"), F.col("csr")).otherwise(0.0).alias("code_to_signal"))
    open_items = F.coalesce(F.transform("plan.unresolved_semantics", lambda u: F.struct(u["id"].alias("id"), u["description"].alias("description"), u["reason"].alias("reason"))), F.array().cast("array<struct<id:string,description:string,reason:string>>"))
    body = F.struct(
        F.lit("1.0").alias("version"), F.col(description).alias("input_description"), status(F.col("registry_valid"), "registry").alias("registry_validation"), plan_status.alias("plan_validation_status"), code.alias("code_generation_status"), run.alias("execution_status"),
        score.alias("semantic_alignment_score"), open_items.alias("unresolved_semantics"), F.col("failures").alias("failure_reasons"))
    return results.withColumn("report", F.to_json(body)).withColumn("report_errors", S.validate("eval_report", F.col("report"))["errors"])


def failure_labels(results: DataFrame, errors: str | None = None) -> Column:
    """The labels of a failed case in report order; ``errors`` names a column of execution messages."""
    has = lambda stage, code: F.exists("failures", lambda f: (f["code"] == code) & ((f["stage"] == stage) if stage else F.lit(True)))
    said = lambda text: F.exists("failures", lambda f: (f["code"] == "F_rejection") & F.lower(f["message"]).contains(text))
    applies = ~F.col("direct")
    messages = F.transform(F.col(errors), F.lower) if errors else F.array().cast("array<string>")
    in_some = lambda f: F.exists(messages, f)
    silent = lambda m: m.contains("no executed signal") | m.contains("execution was not provided")
    false_rejection = F.col("false_rejection") | said("incorrectly rejected")
    hallucinated = F.col("hallucinated") | F.exists("failures", lambda f: (f["code"] == "F_rejection") & ~F.lower(f["message"]).contains("incorrectly rejected"))
    found = {
        "schema_invalid": applies & (~F.col("plan_valid") | has("plan_validation", "F_schema")), "registry_invalid": ~F.col("registry_valid") | has("registry_validation", "F_schema"),
        "unsafe_code": has(None, "F_safety") | in_some(lambda m: L.has_any(m, ["generated code must include", "disallowed", "unsafe"])), "execution_failed": has(None, "F_execution") | in_some(lambda m: ~silent(m) & L.has_any(m, ["execution", "failed"])),
        "parse_failure": in_some(lambda m: L.has_any(m, ["no json object", "json", "parse"])), "length_mismatch": in_some(lambda m: m.contains("length") & m.contains("does not match")),
        "no_signal": in_some(silent) & ~false_rejection & ~hallucinated, "wrong_primitive": has(None, "F_grounding") | (applies & (F.col("primitive_f1") < 0.999)), "wrong_window": applies & (F.col("window_iou") < 0.999),
        "wrong_parameter": applies & (F.col("parameter_error") > 1e-9), "semantic_constraint_failed": has(None, "F_semantic") | (F.col("csr") < 0.999), "false_rejection": false_rejection, "unsupported_hallucination": hallucinated,
    }
    return F.when(F.col("passed"), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*[F.when(F.coalesce(found[x], F.lit(False)), F.lit(x)) for x in LABELS])))


def taxonomy(results: DataFrame, labels: str = "labels", *keys: str) -> DataFrame:
    """Failed cases by label (``uncategorized`` if none), with rates over all and over failed cases."""
    named = F.when(F.col("passed"), F.array().cast("array<string>")).when(F.size(labels) == 0, F.array(F.lit("uncategorized"))).otherwise(F.col(labels))
    totals = results.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(~F.col("passed")).alias("failed"))
    counts = results.select(*keys, F.explode(named).alias("label")).groupBy(*keys, "label").agg(F.count("*").alias("cases"))
    joined = counts.join(totals, list(keys)) if keys else counts.crossJoin(F.broadcast(totals))
    return joined.select(*keys, "label", "cases", (F.col("cases") / F.col("n")).alias("rate"), (F.col("cases") / F.col("failed")).alias("failed_rate"))


# Gold cases

# The feature and checker that show a primitive; flats and plateaus stand for each other.
SEMANTICS = {n: (n.removeprefix("add_"), n.replace("add_", "check_")) for n in (
    "add_flat add_ramp add_growth add_decay add_trend add_spike add_dip add_outlier add_peak add_trough add_level_shift add_change_point add_seasonality add_noise add_volatility add_gap").split()} | {"add_plateau": ("flat", "check_flat")}
DIRECTIONS = ["down", "downward", "lower", "negative", "decline", "decrease", "drop", "up", "upward", "raise", "increase", "positive"]


def _says(text: Column, value: Column, magnitude: Column | bool = False) -> Column:
    """Whether a number of the text is the value, to a millionth of it."""
    x = value.try_cast("double")
    near = F.greatest(F.lit(1e-6), F.abs(x) * 1e-6)
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"[-+]?\d+(?:\.\d+)?"), F.lit(0)), lambda m: m.cast("double"))
    either = magnitude if isinstance(magnitude, Column) else F.lit(magnitude)
    return F.coalesce(F.exists(numbers, lambda m: (F.abs(m - x) <= near) | (either & (F.abs(F.abs(m) - F.abs(x)) <= near))), F.lit(False))


def _clause(text: Column, verb: str, cue: str, value: Column) -> Column:
    """Whether the 240 characters from a verb on say ``from`` or ``to`` the value."""
    tail = F.left(F.regexp_extract(F.lower(text), rf"(?s)((?:{verb}).*)", 1), F.lit(240))
    x = value.try_cast("double")
    numbers = F.regexp_extract_all(tail, F.lit(rf"\b{cue}\s+([-+]?\d+(?:\.\d+)?)"), F.lit(1))
    return F.coalesce(F.exists(numbers, lambda m: F.abs(m.cast("double") - x) <= F.greatest(F.lit(1e-6), F.abs(x) * 1e-6)), F.lit(False))


def explicit(primitive: Column, key: Column, value: Column, text: Column) -> Column:
    """Whether a description states a parameter, so that a case may be held to it."""
    low = F.lower(text)
    grown = {("add_decay", "start_value"): ("decays?|decay", "from"), ("add_decay", "end_value"): ("decays?|decay", "to"), ("add_growth", "start_value"): ("grows?|growth", "from"), ("add_growth", "end_value"): ("grows?|growth", "to")}
    out = (
        F.when(key.isin("start_timestep", "end_timestep", "timestep", "anchor_timestep"), _says(text, value)).when(key.isin("width", "half_width", "spread"), L.has_any(low, ["width", "spread"]))
        .when(key.isin("growth_rate", "decay_rate"), F.contains(low, F.replace(key, F.lit("_"), F.lit(" "))) & _says(text, value)).when(key == "random_seed", low.contains("seed") & _says(text, value))
        .when(key == "fill_value", low.contains("fill") & ((F.lower(value) == "nan") | _says(text, value)))
    )
    for (name, k), (verb, cue) in grown.items():
        out = out.when((primitive == name) & (key == k), _clause(text, verb, cue, value))
    moved = _says(text, value, L.has_any(low, DIRECTIONS))
    plain = key.isin("target_value", "start_value", "end_value", "amplitude", "period", "phase", "baseline", "noise_scale", "volatility_scale")
    return out.when(key.isin("slope", "shift", "level_change", "slope_change", "relative_change", "delta"), moved).when(plain, _says(text, value)).otherwise(True)


def spec_features(steps: Column, forbidden: Column, description: Column, length: Column) -> Column:
    """Features of a gold outline: its steps with the parameters that the text states, and negations."""
    of = lambda s, k: F.element_at(F.create_map(*[F.lit(x) for n, v in SEMANTICS.items() for x in (n, v[k])]), s["primitive"])
    known = F.filter(F.transform(steps, lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda x: x["s"]["primitive"].isin(*SEMANTICS))
    allowed = lambda s: F.when(s["primitive"].isin("add_flat", "add_plateau"), F.array(F.lit("add_flat"), F.lit("add_plateau"))).otherwise(F.array(s["primitive"]))
    own = F.transform(known, lambda x: F.struct(
        F.concat(F.lit("f"), (x["i"] + 1).cast("string")).alias("id"), of(x["s"], 0).alias("semantic"), allowed(x["s"]).alias("expected_primitives"), step_window(x["s"], length, True).alias("window"), F.map_filter(x["s"]["parameters"], lambda k, v: explicit(x["s"]["primitive"], k, v, description)).alias("parameters"),
        x["s"]["effect_type"].alias("effect_type"), of(x["s"], 1).alias("checker"), F.lit(True).alias("required"), F.lit(1e-6).alias("tolerance"), F.lit(None).cast("array<string>").alias("forbidden")))
    denied = F.transform(F.coalesce(forbidden, F.array().cast("array<string>")), lambda name, i: F.struct(
        F.concat(F.lit("neg"), (i + 1).cast("string")).alias("id"), F.lit("negation").alias("semantic"), F.array().cast("array<string>").alias("expected_primitives"), F.struct(F.lit(0).alias("start"), (length - 1).cast("int").alias("end")).alias("window"), F.create_map().cast("map<string,string>").alias("parameters"),
        F.lit(None).cast("string").alias("effect_type"), F.lit("check_negation").alias("checker"), F.lit(True).alias("required"), F.lit(1e-6).alias("tolerance"), F.array(name).alias("forbidden")))
    return F.concat(own.cast(f"array<{FEATURE}>"), denied.cast(f"array<{FEATURE}>"))


def oracle_plan(outline: Column, description: Column, length: Column) -> Column:
    """The plan that a gold outline (a plan struct) stands for: numbered steps, unresolved items as steps too."""
    base = lambda s: (s["primitive"] == "add_flat") & F.contains(F.lower(F.coalesce(s["semantic_role"], F.lit(""))), F.lit("baseline")) & (F.coalesce(L.whole(s, "start_timestep"), F.lit(0)) == 0) & (L.whole(s, "end_timestep") == length - 1)
    steps = F.transform(F.filter(outline["steps"], L.is_primitive), lambda s, i: s.withField("id", F.concat(F.lit("step_"), (i + 1).cast("string"))).withField("kind", F.lit("primitive")).withField("semantic_role", F.coalesce(s["semantic_role"], s["primitive"])).withField("confidence", F.lit(1.0)).withField("source_text", description).withField("semantic_layer", F.coalesce(s["semantic_layer"], F.when(base(s), "global_scaffold"))))
    items = F.transform(F.coalesce(outline["unresolved_semantics"], F.array().cast(f"array<{L.UNRESOLVED}>")), lambda u, i: F.struct(F.coalesce(u["id"], F.concat(F.lit("u"), (i + 1).cast("string"))).alias("id"), u["description"].alias("description"), description.alias("source_text"), F.coalesce(u["reason"], F.lit(L.NO_PRIMITIVE)).alias("reason")))
    opened = F.transform(items, lambda u: F.from_json(F.to_json(F.struct(u["id"].alias("id"), F.lit("unresolved").alias("kind"), u["description"].alias("description"), u["description"].alias("semantic_role"), F.lit(1.0).alias("confidence"), u["source_text"].alias("source_text"), u["reason"].alias("reason"), F.lit(True).alias("needs_library_extension"))), L.STEP))
    context = F.struct(length.cast("int").alias("length"), F.coalesce(outline["global_context"]["numeric_range"], F.struct(F.lit(-1000.0).alias("min"), F.lit(1000.0).alias("max"))).alias("numeric_range"), F.lit(None).cast("bigint").alias("seed"))
    return F.struct(
        F.lit("1.0").alias("version"), description.alias("input_description"), F.struct(F.lit("valid").alias("status")).alias("registry_validation"), context.alias("global_context"), F.concat(steps, opened).alias("steps"),
        items.alias("unresolved_semantics"), (F.coalesce(outline["needs_library_extension"], F.lit(False)) | (F.size(items) > 0)).alias("needs_library_extension"))


def evaluable(outline: Column) -> Column:
    return F.coalesce((F.size(outline["steps"]) > 0) | outline["needs_library_extension"] | (F.size(outline["unresolved_semantics"]) > 0), F.lit(False))


# Queries

_EDITED = "CASE WHEN user_id % 2 = 0 AND t BETWEEN 5 AND 12 THEN 50.0 WHEN user_id % 2 = 0 AND t BETWEEN 13 AND 20 THEN 50.0 + t ELSE v END"


def edited(spark, sf_dir) -> DataFrame:
    even = F.col("user_id") % 2 == 0
    v = F.transform("values", lambda x, t: F.when(even & (t >= 5) & (t <= 12), 50.0).when(even & (t >= 13) & (t <= 20), 50.0 + t).otherwise(x))
    return user_series(spark, sf_dir).select("user_id", v.alias("values"))


_ASKS = {
    "length": 60, "point_values": [{"timestep": 7, "value": 50}, {"timestep": 500, "value": 50}], "constant_segments": [{"start": 5, "end": 12, "value": 50, "tolerance": 1e-6}], "unchanged_windows": [{"start": 5, "end": 900, "value": 50}],
    "monotone_windows": [{"start": 13, "end": 20, "direction": "nondecreasing"}, {"start": 13, "end": 20, "direction": "nonincreasing"}, {"start": 1, "end": 9, "direction": "sideways"}], "argmax_in": [10, 40], "argmin_in": [10, 40], "value_bounds": {"min": 0, "max": 100},
    "nonconstant_windows": [{"start": 5, "end": 12}, {"start": 3, "end": 3}], "variance_comparison": {"reference_window": [5, 12], "target_window": [25, 40], "expect": "target_greater"}, "periodicity_hint": "weekly", "deterministic_seed": 7,
}
_IN = lambda a, b, x="v": f"CASE WHEN t BETWEEN {a} AND {b} THEN {x} END"


@query(
    "s02_checks_as_data",
    f"""WITH {POINTS_SQL}, e AS (SELECT user_id, t, n, {_EDITED} AS v FROM p), x AS (SELECT *, v - lag(v) OVER (PARTITION BY user_id ORDER BY t) AS d FROM e),
a AS (SELECT user_id, max(n) = 60 AS c0, coalesce(max(CASE WHEN t = 7 THEN abs(v - 50) END) <= 1e-6, FALSE) AS c1, FALSE AS c2, greatest(max({_IN(5, 12, 'abs(v - 50)')}), stddev_pop({_IN(5, 12)})) <= 1e-6 AS c3, FALSE AS c4,
 min({_IN(14, 20, 'd')}) >= -1e-8 AS c5, max({_IN(14, 20, 'd')}) <= 1e-8 AS c6, FALSE AS c7, arg_max(t, (v, -t)) BETWEEN 10 AND 40 AS c8, arg_min(t, (v, t)) BETWEEN 10 AND 40 AS c9, greatest(0 - min(v), max(v) - 100, 0) <= 1e-8 AS c10, stddev_pop({_IN(5, 12)}) > 1e-12 AS c11, FALSE AS c12,
 stddev_pop({_IN(25, 40)}) > stddev_pop({_IN(5, 12)}) AS c13, TRUE AS c14, TRUE AS c15 FROM x GROUP BY user_id)
SELECT user_id, [{', '.join(f"'{c}'" for c in ("length", "point_value_1", "point_value_2", "constant_segments_1", "unchanged_windows_1", "monotone_window_1", "monotone_window_2", "monotone_window_3", "argmax_in", "argmin_in", "value_bounds", "nonconstant_window_1", "nonconstant_window_2", "variance_comparison", "periodicity_hint", "deterministic_seed"))}][i + 1] AS check_id, [{', '.join(f'c{i}' for i in range(16))}][i + 1] AS passed FROM a, (SELECT unnest(range(0, 16)) AS i)""",
)
def s02(spark, sf_dir):
    """All kinds of signal checks, given as data, with windows that leave the series."""
    found = signal_checks(F.col("values"), F.from_json(F.lit(json.dumps(_ASKS)), CHECKS))
    return edited(spark, sf_dir).select("user_id", F.explode(found).alias("c")).select("user_id", F.col("c.id").alias("check_id"), "c.passed")


examples("e08_step_window", [(plan(s),) for s in (FLAT, SPIKE, step("add_spike", timestep=1, amplitude=1, width=3), step("add_change_point", anchor_timestep=8, level_change=1), step("add_noise", noise_scale=1), step("add_ramp", end_value=1, start_timestep=4), step("add_peak", timestep=9, amplitude=1, width=2.5))], ["0-39", "7-7", "0-4", "8-39", None, "4-39", "7-11"], lambda t: let(step_window(F.get(steps_of(t), F.lit(0)), F.lit(40)), lambda w: F.when(w.isNotNull(), F.concat_ws("-", w["start"].cast("string"), w["end"].cast("string")))))
examples("e16_rounded_window", [(plan(s),) for s in (step("add_peak", timestep=9, amplitude=1, width=2.5), step("add_peak", timestep=9, amplitude=1, spread=3.4), step("add_dip", timestep=9, amplitude=1, half_width=1), step("add_outlier", timestep=39, delta=1, width=1.5))], ["7-11", "6-12", "8-10", "37-39"], lambda t: let(step_window(F.get(steps_of(t), F.lit(0)), F.lit(40), True), lambda w: F.concat_ws("-", w["start"].cast("string"), w["end"].cast("string"))))
examples("e06_f1_alternatives", [("add_flat/add_plateau,add_spike", "add_plateau,add_spike"), ("add_flat/add_plateau,add_spike", "add_spike,add_dip"), ("", ""), ("add_gap", ""), ("add_gap,add_gap", "add_gap")], ["1.0", "0.5", "1.0", "0.0", "0.6666666666666666"], lambda e, u: f1_with_alternatives(F.transform(F.filter(F.split(e, ","), lambda x: x != ""), lambda x: F.split(x, "/")), F.filter(F.split(u, ","), lambda x: x != "")).cast("string"))
_FEATURE = {"id": "f1", "semantic": "spike", "expected_primitives": ["add_spike"], "window": {"start": 7, "end": 7}, "parameters": {"timestep": 7, "amplitude": 4}, "checker": "check_spike", "required": True}
examples("e07_parameter_error", [(json.dumps(_FEATURE), plan(SPIKE)), (json.dumps(_FEATURE), plan(step("add_spike", timestep=17, target_value=4))), (json.dumps(_FEATURE), plan(FLAT)), (json.dumps({**_FEATURE, "parameters": {}}), plan(SPIKE)), (json.dumps({**_FEATURE, "parameters": {"waveform": "sine"}}), plan(step("add_spike", timestep=1, amplitude=1, waveform="sine")))], ["0.125", "0.625", "1.0", "0.0", "0.0"], lambda f, t: let(F.from_json(f, FEATURE), lambda x: parameter_error(x, best_step(x, steps_of(t), F.lit(40)), F.lit(40))).cast("string"))
examples("e10_rejected", [(plan(FLAT),), (plan(FLAT, needs_library_extension=True),), (plan(FLAT, unresolved()),), (plan(FLAT, unresolved_semantics=[{"id": "u"}]),)], ["false", "true", "true", "true"], lambda t: L.rejected(F.from_json(t, L.PLAN)).cast("string"))
_TEXT = "It decays from 9 to 2.5 with decay rate 2, then drops by 3 at timestep 20, with a width of 4. Fill with 0, seed 11."
examples(
    "e14_explicit_parameters", [(n, k, v, _TEXT) for n, k, v in (("add_decay", "start_value", "9"), ("add_decay", "end_value", "9"), ("add_decay", "end_value", "2.5"), ("add_decay", "decay_rate", "2"), ("add_level_shift", "shift", "-3"), ("add_spike", "timestep", "21"), ("add_spike", "timestep", "20"), ("add_spike", "width", "7"), ("add_gap", "fill_value", "NaN"), ("add_noise", "random_seed", "7"), ("add_noise", "random_seed", "11"), ("add_flat", "target_value", "-3"), ("add_flat", "odd", "x"))],
    ["true", "false", "true", "true", "true", "false", "true", "true", "true", "false", "true", "false", "true"], lambda n, k, v, t: explicit(n, k, v, t).cast("string"),
)
_GOLD_TEXT = "A flat baseline at 5, then a spike reaching 9 at timestep 7."
_GOLD = plan(step("add_flat", role="baseline", target_value=5, start_timestep=0, end_timestep=39), step("add_spike", "x", timestep=7, target_value=9, width=0))
examples(
    "e13_spec_features", [(_GOLD, "add_dip"), (plan(step("add_odd"), step("add_plateau", "p", target_value=3, start_timestep=4, end_timestep=8)), "")],
    ["f1 flat check_flat 0-39 target_value=5;f2 spike check_spike 7-7 target_value=9,timestep=7;neg1 negation check_negation 0-39 ", "f2 flat check_flat 4-8 "],
    lambda t, d: F.array_join(F.transform(spec_features(steps_of(t), F.filter(F.split(d, ","), lambda x: x != ""), F.lit(_GOLD_TEXT), F.lit(40)), lambda f: F.concat_ws(" ", f["id"], f["semantic"], f["checker"], F.concat_ws("-", f["window"]["start"].cast("string"), f["window"]["end"].cast("string")), F.array_join(F.transform(F.array_sort(F.map_entries(f["parameters"])), lambda e: F.concat_ws("=", e["key"], e["value"])), ","))), ";"),
)
examples(
    "e15_oracle_plan", [(_GOLD,), (plan(unresolved_semantics=[{"id": "u9", "description": "calendar"}]),)], ["step_1 primitive global_scaffold;step_2 primitive|false|true", "u9 unresolved|true|true"],
    lambda t: let(oracle_plan(F.from_json(t, L.PLAN), F.lit(_GOLD_TEXT), F.lit(40)), lambda p: F.concat_ws("|", F.array_join(F.transform(p["steps"], lambda s: F.concat_ws(" ", s["id"], s["kind"], s["semantic_layer"])), ";"), p["needs_library_extension"].cast("string"), evaluable(F.from_json(t, L.PLAN)).cast("string"))),
)

#: Cases by user_id: (outline, plan that was made, ids that must be declined), all of 40 timesteps.
CASES = [
    (_GOLD, _GOLD, []), (_GOLD, plan(step("add_plateau", target_value=5, start_timestep=0, end_timestep=39), step("add_spike", "x", timestep=7, target_value=9)), []), (_GOLD, plan(step("add_flat", target_value=5, start_timestep=0, end_timestep=39)), []),
    (_GOLD, plan(step("add_flat", target_value=5, start_timestep=0, end_timestep=39), step("add_spike", "x", timestep=17, target_value=9)), []), (_GOLD, plan(FLAT, needs_library_extension=True), []), (plan(), plan(unresolved(), needs_library_extension=True), ["u1"]), (plan(), plan(FLAT), ["u1"]),
]


def gold_cases(spark, sf_dir, of: tuple[int, ...] = tuple(range(len(CASES)))) -> DataFrame:
    """Rows of each user's case: ``user_id, k, description, length, features, unsupported, plan, series``; ``of`` are the cases to deal out."""
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    table = spark.createDataFrame([(i, o, p, u) for i, (o, p, u) in enumerate(CASES)], "k int, outline string, made string, unsupported array<string>")
    rows = users.withColumn("k", F.get(F.array(*map(F.lit, of)), (F.col("user_id") % len(of)).cast("int"))).join(F.broadcast(table), "k").withColumns({"description": F.lit(_GOLD_TEXT), "length": F.lit(40)})
    rows = rows.withColumns({"features": spec_features(steps_of(F.col("outline")), F.array(F.lit("add_dip")), F.col("description"), F.col("length")), "plan": F.from_json("made", L.PLAN)})
    series = X.execute(F.col("plan.steps"), F.col("length"))["values"]
    return rows.withColumn("series", F.when(~L.rejected(F.col("plan")), series)).select("user_id", "k", "description", "length", "features", "unsupported", "plan", "series")


#: passed, csr, f1, window overlap, parameter error of the cases above, by the rules (three required features in the first five).
_SCORES = [(True, 1, 1, 1, 0), (True, 1, 1, 1, 0), (False, 2 / 3, 2 / 3, 1, 0.5), (False, 2 / 3, 1, 0.5, 0.0625), (False, 0, 2 / 3, 1, 0.5), (True, 1, 1, 1, 0), (False, 0, 0, 1, 0)]
_SCORES_SQL = f"u AS (SELECT DISTINCT user_id, user_id % {len(CASES)} AS k FROM events), e(k, passed, csr, f1, overlap, parameter, must) AS (VALUES {', '.join(f'({i}, {p}, {c}::DOUBLE, {f}::DOUBLE, {w}::DOUBLE, {e}::DOUBLE, {i > 4})' for i, (p, c, f, w, e) in enumerate(_SCORES))})"


@query("e01_evaluate_case", f"WITH {_SCORES_SQL} SELECT user_id, passed, {rounded_sql('csr')} AS csr, {rounded_sql('f1')} AS primitive_f1, {rounded_sql('overlap')} AS window_iou, {rounded_sql('parameter')} AS parameter_error, {rounded_sql('CASE WHEN must THEN csr ELSE (csr + f1 + 1 - parameter) / 3 END')} AS semantic_score FROM u JOIN e ON u.k = e.k")
def e01(spark, sf_dir):
    """Plans and their series against specifications: matched steps, replay, checks, verdict."""
    rows = evaluate_cases(gold_cases(spark, sf_dir))
    return rows.select("user_id", "passed", *(rounded(F.col(c)).alias(c) for c in ("csr", "primitive_f1", "window_iou", "parameter_error", "semantic_score")))


_POINT = json.dumps({"point_values": [{"timestep": 7, "value": 9}], "value_bounds": {"min": 0, "max": 9}})


@query("e02_evaluate_signal", f"SELECT user_id, ([2 / 3.0, 2 / 3.0, 2 / 3.0, 1 / 3.0, 0, 0, 0]::DOUBLE[])[k + 1] * 3 AS features_held, k < 2 AS passed_checks, k = 6 AS hallucinated FROM (SELECT DISTINCT user_id, user_id % {len(CASES)} AS k FROM events)")
def e02(spark, sf_dir):
    """Final series alone, by the features' checkers and by signal checks."""
    rows = gold_cases(spark, sf_dir)
    plain = evaluate_signals(rows.withColumn("signal_checks", F.lit(None).cast(CHECKS))).select("user_id", F.round(F.col("csr") * 3).alias("features_held"), "hallucinated")
    checked = evaluate_signals(rows.withColumn("signal_checks", F.from_json(F.lit(_POINT), CHECKS))).select("user_id", F.col("passed").alias("passed_checks"))
    return plain.join(checked, "user_id")


@query("e11_aggregate_results", f"WITH {_SCORES_SQL} SELECT count(*) AS cases, {rounded_sql('avg(passed::INT)')} AS pass_rate, {rounded_sql('avg(csr)')} AS csr, {rounded_sql('avg(f1)')} AS primitive_f1, {rounded_sql('avg(overlap)')} AS window_iou, {rounded_sql('avg(parameter)')} AS parameter_error, {rounded_sql('avg((e.k = 5)::INT) FILTER (must)')} AS crr, {rounded_sql('avg((e.k = 4)::INT) FILTER (NOT must)')} AS frr, {rounded_sql('avg((e.k = 6)::INT) FILTER (must)')} AS hus FROM u JOIN e ON u.k = e.k")
def e11_all(spark, sf_dir):
    rows = aggregate_results(evaluate_cases(gold_cases(spark, sf_dir)))
    return rows.select("cases", *(rounded(F.col(c)).alias(c) for c in rows.columns if c != "cases"))


@query("e12_eval_report", f"WITH {_SCORES_SQL} SELECT user_id, 0 AS contract_errors, CASE WHEN e.k IN (4, 5) THEN 'not_run' ELSE 'success' END AS execution, ([0, 0, 1, 1, 1, 0, 1])[e.k + 1] AS failures FROM u JOIN e ON u.k = e.k")
def e12(spark, sf_dir):
    """Evaluation reports, checked against their contract."""
    rows = report(evaluate_cases(gold_cases(spark, sf_dir)))
    return rows.select("user_id", F.size("report_errors").alias("contract_errors"), F.get_json_object("report", "$.execution_status.status").alias("execution"), F.size("failures").alias("failures"))


_LABELED = ["", "", "length_mismatch,wrong_primitive,wrong_parameter,semantic_constraint_failed", "execution_failed,parse_failure,wrong_window,wrong_parameter,semantic_constraint_failed", "wrong_primitive,wrong_parameter,semantic_constraint_failed,false_rejection", "", "wrong_primitive,semantic_constraint_failed,unsupported_hallucination"]


def labelled(spark, sf_dir) -> DataFrame:
    rows = evaluate_cases(gold_cases(spark, sf_dir))
    said = F.when(F.col("k") == 2, F.array(F.lit("length 3 does not match expected length 40"))).when(F.col("k") == 3, F.array(F.lit("No JSON object found"), F.lit("execution failed"))).when(F.col("k") == 4, F.array(F.lit("no executed signal"))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("errors", said)
    return rows.withColumn("labels", failure_labels(rows, "errors"))


@query("t01_failure_labels", f"SELECT user_id, [{', '.join(repr(x) for x in _LABELED)}][1 + user_id % {len(CASES)}] AS labels FROM (SELECT DISTINCT user_id FROM events)")
def t01(spark, sf_dir):
    """Labels of failed cases from codes, messages and metrics, in report order."""
    return labelled(spark, sf_dir).select("user_id", F.array_join("labels", ",").alias("labels"))


@query("t02_taxonomy", f"WITH u AS (SELECT DISTINCT user_id FROM events), x AS (SELECT user_id, string_split([{', '.join(repr(x) for x in _LABELED)}][1 + user_id % {len(CASES)}], ',') AS l FROM u), y AS (SELECT unnest(l) AS label FROM x WHERE l <> ['']) SELECT label, count(*) AS cases, {rounded_sql('count(*) / (SELECT count(*) FROM u)::DOUBLE')} AS rate, {rounded_sql(f'count(*) / (SELECT count(*) FROM u WHERE user_id % {len(CASES)} NOT IN (0, 1, 5))::DOUBLE')} AS failed_rate FROM y GROUP BY label")
def t02(spark, sf_dir):
    """Failed cases by label, with rates over all and over failed cases."""
    return taxonomy(labelled(spark, sf_dir)).select("label", "cases", rounded(F.col("rate")).alias("rate"), rounded(F.col("failed_rate")).alias("failed_rate"))


@query("s12_seed_reproduces", "SELECT user_id, TRUE AS same FROM (SELECT DISTINCT user_id FROM events)")
def s12(spark, sf_dir):
    """A plan with seeded noise, executed twice."""
    steps = steps_of(F.lit(plan(FLAT, step("add_noise", "z", noise_scale=0.5, random_seed=11))))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct().withColumn("steps", steps)
    rows = rows.withColumns({"one": X.noise_of(F.col("steps"), F.lit(40)), "two": X.noise_of(F.col("steps"), F.lit(40))})
    return rows.select("user_id", seed_reproduces(F.col("steps"), F.lit(40), F.col("one"), F.col("two")).alias("same"))
