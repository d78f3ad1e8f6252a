"""Baselines and ablations: a rule parser, forced plans, damaged plans, prompts; and repair's queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import examples, query
from ..plans import execute as X
from ..plans import plan as L
from ..plans import repair as W
from ..plans.registry import effect_of
from ..sources.series import rounded
from . import scoring as S
from .claims import _groups
from .plan_queries import _SHOW, FLAT, SPIKE, plan, step, steps_of, unresolved
from .retrieval import unsupported

_N = r"(-?\d+(?:\.\d+)?)"
# The patterns of the rule parser, by family.
RULES = {
    "flat": rf"(?i)(?:flat|constant|stable baseline|stays flat|remains flat|is flat)(?:\s+at|\s+near)?\s+{_N}(?:\s+from timestep\s+(\d+)\s+to\s+(\d+)|\s+across all|\s+throughout)?",
    "half": rf"(?i)first half is flat at\s+{_N}",
    "ramp": rf"(?i)(?:between|from) timestep\s+(\d+)\s+(?:and|to)\s+(\d+).*?(?:linearly from|moves linearly from|linear ramp to|from)\s+{_N}\s+to\s+{_N}",
    "trend": rf"(?i)(?:from timestep\s+(\d+)\s+to\s+(\d+).*?|after timestep\s+(\d+).*?)(?:trend|declines|increases|slope).*?slope\s+{_N}",
    "jump": rf"(?i)(?:at|after) timestep\s+(\d+).*?jump\w*\s+(up|down)\s+by\s+{_N}",
    "change": rf"(?i)change point.*?timestep\s+(\d+).*?jumps up by\s+{_N}.*?slope\s+{_N}",
    "plateau": rf"(?i)from timestep\s+(\d+)\s+to\s+(\d+).*?plateau at\s+{_N}",
    "gap": r"(?i)from timestep\s+(\d+)\s+to\s+(\d+).*?(?:missing|gap)",
    "season": rf"(?i)from timestep\s+(\d+)\s+to\s+(\d+).*?(?:sine|seasonal|periodic).*?amplitude\s+{_N}.*?period\s+{_N}",
    "noise": rf"(?i)(?:from|between) timestep\s+(\d+)\s+(?:to|and)\s+(\d+).*?(?:noise|jitter).*?scale\s+{_N}(?:.*?seed\s+(\d+))?",
    "volatility": r"(?i)(?:between timestep\s+(\d+)\s+and\s+(\d+)|after timestep\s+(\d+)).*?(?:twice|(\d+(?:\.\d+)?) times).*?baseline",
    "spike": rf"(?i)spike(?:\s+to|.*?reaching)\s+{_N}.*?timestep\s+(\d+)", "dip": rf"(?i)dip(?:\s+to|.*?reaching)\s+{_N}.*?timestep\s+(\d+)",
    "peak": rf"(?i)peak(?:\s+reaches|.*?reaching)\s+{_N}.*?timestep\s+(\d+)", "trough": rf"(?i)trough(?:\s+reaches|.*?reaching)\s+{_N}.*?timestep\s+(\d+)",
}


def rule_steps(text: Column, length: Column) -> Column:
    """Steps that the patterns find, family by family, numbered in that order."""
    final, none = length - 1, F.array().cast(f"array<{L.STEP}>")
    num, whole = lambda x: x.try_cast("double"), lambda x: x.try_cast("int")

    def found(key: str, groups: int, name: str, role: str, params, one: bool = False) -> Column:
        got = _groups(text, RULES[key], tuple(range(groups + 1)))
        made = F.transform(F.slice(got, 1, 1) if one else got, lambda g: W.new_step("", name, params(g), role, g[0], 0.7))
        return F.coalesce(made, none)

    local = lambda g: {"timestep": whole(g[2]), "target_value": num(g[1])}
    round_event = lambda g: local(g) | {"width": F.lit(2), "start_timestep": F.greatest(F.lit(0), whole(g[2]) - 5), "end_timestep": whole(g[2]) + 5}
    span = lambda g, **more: {"start_timestep": whole(g[1]), "end_timestep": whole(g[2])} | more
    every = F.concat(
        found("flat", 3, "add_flat", "constant baseline", lambda g: {"start_timestep": F.coalesce(whole(g[2]), F.lit(0)), "end_timestep": F.coalesce(whole(g[3]), final), "target_value": num(g[1])}),
        found("half", 1, "add_flat", "initial flat regime", lambda g: {"start_timestep": F.lit(0), "end_timestep": F.floor(length / 2).cast("int") - 1, "target_value": num(g[1])}, True),
        found("ramp", 4, "add_ramp", "linear ramp", lambda g: span(g, start_value=num(g[3]), end_value=num(g[4]))),
        found("trend", 4, "add_trend", "linear trend", lambda g: {"start_timestep": F.coalesce(whole(g[1]), whole(g[3])), "end_timestep": F.coalesce(whole(g[2]), final), "slope": num(g[4])}),
        found("jump", 3, "add_level_shift", "level shift", lambda g: {"anchor_timestep": whole(g[1]), "shift": F.when(F.lower(g[2]) == "down", -F.abs(num(g[3]))).otherwise(num(g[3]))}),
        found("change", 3, "add_change_point", "change point", lambda g: {"anchor_timestep": whole(g[1]), "level_change": num(g[2]), "slope_change": num(g[3])}),
        found("plateau", 3, "add_flat", "plateau", lambda g: span(g, target_value=num(g[3])), True), found("gap", 2, "add_gap", "missing interval", span),
        found("season", 4, "add_seasonality", "seasonality", lambda g: span(g, amplitude=num(g[3]), period=num(g[4]), waveform=F.lit("sine"))),
        found("noise", 4, "add_noise", "noise", lambda g: span(g, noise_scale=num(g[3]), random_seed=F.coalesce(whole(g[4]), F.lit(7)))),
        found("volatility", 4, "add_volatility", "volatility", lambda g: {"start_timestep": F.coalesce(whole(g[1]), whole(g[3])), "end_timestep": F.coalesce(whole(g[2]), F.lit(99)), "volatility_scale": F.when(F.contains(F.lower(g[0]), F.lit("twice")), 2.0).otherwise(num(g[4])), "baseline": F.lit(0.0)}),
        found("spike", 2, "add_spike", "spike", local), found("dip", 2, "add_dip", "dip", local), found("peak", 2, "add_peak", "rounded peak", round_event), found("trough", 2, "add_trough", "rounded trough", round_event),
    )
    return F.transform(every, lambda s, i: s.withField("id", F.concat(F.lit("step_"), (i + 1).cast("string"))))


def rule_plan(description: Column, length: Column) -> Column:
    """The rule parser's plan; it declines reversion, denied periods and what no pattern finds."""
    low = F.lower(description)
    steps = rule_steps(description, length)
    semantic = F.when(L.has_any(low, ["mean-reverting", "mean reversion"]), "mean_reversion").when(low.contains("does not indicate any repeating period"), "mild_nonperiodic_oscillation").when(F.size(steps) == 0, "unparsed_description")
    base = W.rejection(description, length, F.coalesce(semantic, F.lit("")))
    return F.when(semantic.isNotNull(), base).otherwise(base.withField("steps", steps).withField("unresolved_semantics", F.array().cast(f"array<{L.UNRESOLVED}>")).withField("needs_library_extension", F.lit(False)))


def without_rejection(p: Column, description: Column, length: Column) -> Column:
    """Forces a flat plan where a plan declines."""
    flat = W.new_step("step_1", "add_flat", {"start_timestep": F.lit(0), "end_timestep": length - 1, "target_value": F.lit(0.0)}, "forced baseline", description, 0.1)
    return F.when(L.rejected(p), p.withField("steps", F.array(flat)).withField("unresolved_semantics", F.array().cast(f"array<{L.UNRESOLVED}>")).withField("needs_library_extension", F.lit(False))).otherwise(p)


def _first_only(steps: Column, change) -> Column:
    first = F.array_position(F.transform(steps, L.is_primitive), F.lit(True)) - 1
    return F.transform(steps, lambda s, i: F.when(i == first, change(s)).otherwise(s))


def damaged(p: Column, variant: str) -> Column:
    """A plan as an ablation leaves it."""
    steps = p["steps"]
    swap = lambda s: s.withField("id", F.lit(None).cast("string")).withField("source_text", F.lit(None).cast("string")).withField("effect_type", F.when(s["effect_type"] == "additive", "overwrite").otherwise("additive")).withField("semantic_layer", F.lit("texture"))
    if variant == "no_schema_validation":
        return p.withField("version", F.lit(None).cast("string"))
    if variant == "no_registry_grounding":
        return p.withField("steps", _first_only(steps, lambda s: s.withField("primitive", F.lit("add_unregistered_pattern"))))
    if variant == "no_effect_ordering":
        return p.withField("steps", F.concat(F.reverse(F.filter(steps, L.is_primitive)), F.filter(steps, lambda s: ~L.is_primitive(s))))
    if variant == "no_evidence_span":
        return p.withField("steps", F.transform(steps, lambda s: s.withField("source_text", F.lit(None).cast("string"))))
    if variant.startswith("repair_challenge"):
        return p.withField("version", F.lit(None).cast("string")).withField("registry_validation", F.lit(None).cast("struct<status:string>")).withField("global_context.length", p["global_context"]["length"] + 1).withField("steps", _first_only(steps, lambda s: L.without_param(swap(s), "random_seed")))
    return p


VARIANTS = ["full_oracle", "no_schema_validation", "no_registry_grounding", "no_effect_ordering", "no_evidence_span", "repair_challenge_no_repair", "repair_challenge_with_repair", "no_rejection", "rule_parser_no_repair", "rule_parser_with_repair"]


def complete(p: Column) -> Column:
    """Whether all that a plan must state is there."""
    whole = lambda s: s["id"].isNotNull() & s["source_text"].isNotNull() & (~L.is_primitive(s) | effect_of(s["primitive"]).isNotNull())
    return p["version"].isNotNull() & p["registry_validation"].isNotNull() & p["input_description"].isNotNull() & (F.size(p["steps"]) > 0) & F.forall(p["steps"], whole)


def run_ablation(cases: DataFrame, variant: str) -> DataFrame:
    """Evaluates the gold cases' oracle plans (``plan``) as a variant leaves them."""
    p, n, text = F.col("plan"), F.col("length"), F.col("description")
    made = rule_plan(text, n) if variant.startswith("rule_parser") else without_rejection(p, text, n) if variant == "no_rejection" else damaged(p, variant)
    rows = cases.withColumn("made", made)
    if variant.endswith("with_repair"):
        rows = rows.withColumn("made", W.repair(F.col("made"), n)["plan"])
    runs = F.col("plan") if variant in ("no_schema_validation", "no_evidence_span") else F.col("made")
    order = F.filter(runs["steps"], L.is_primitive) if variant == "no_effect_ordering" else L.ordered(runs["steps"])
    series = F.when(~L.rejected(runs) & (F.lit(variant) != "no_registry_grounding"), X.fold(order, n, guarded=False)["values"])
    rows = rows.withColumns({"series": series, "plan_valid": F.coalesce(complete(F.col("made")), F.lit(False)), "variant": F.lit(variant)})
    return S.evaluate_cases(rows.withColumn("plan", F.col("made")).drop("made"))


def run_methods(cases: DataFrame, saved: DataFrame, methods: list[str]) -> DataFrame:
    """Rows ``method, case_id, status, series`` of saved outputs; a case without one is skipped, with the reason."""
    asked = cases.select("case_id", "length").crossJoin(F.broadcast(cases.sparkSession.createDataFrame([(m,) for m in methods], "method string")))
    joined = asked.join(saved.select("method", "case_id", loaded_series(saved).alias("series")), ["method", "case_id"], "left")
    status = F.when(F.col("series").isNull(), "missing_artifact").when(F.size("series") != F.col("length"), "length_mismatch").otherwise("loaded")
    return joined.select("method", "case_id", status.alias("status"), F.when(status == "loaded", F.col("series")).alias("series"))


def loaded_series(saved: DataFrame) -> Column:
    """The series of a saved output, under whichever of its names."""
    return F.coalesce(*[F.col(c) for c in ("generated_series", "series", "values") if c in saved.columns], F.lit(None).cast("array<double>"))


def selection_prompt(caption: Column, candidates: Column, length: Column, low: Column, high: Column) -> Column:
    """What a planner is asked: caption, length, range and the primitives that it may use."""
    return F.concat(F.lit("Select primitives for the description.\nDescription: "), caption, F.format_string("\nLength: %d\nRange: [%s, %s]\nCandidates: ", length, low.cast("string"), high.cast("string")), F.array_join(candidates, ", "), F.lit("\nAnswer with one JSON object."))


def parameter_prompt(plan_text: Column, caption: Column) -> Column:
    return F.concat(F.lit("Infer the numeric parameters of each step.\nDescription: "), caption, F.lit("\nPlan: "), plan_text, F.lit("\nAnswer with one JSON object with `steps`."))


def answered(prompts: DataFrame, responses: DataFrame, key: str = "prompt", attempts: int = 3) -> DataFrame:
    """A planner's recorded answers, joined by prompt: the first good one of ``attempts``; the waits between them as seconds."""
    ranked = responses.where(F.col("attempt") <= attempts).groupBy(key).agg(F.min_by("response", F.when(F.col("ok"), F.col("attempt"))).alias("response"), F.min(F.when(F.col("ok"), F.col("attempt"))).alias("used"))
    return prompts.join(ranked, key, "left").withColumn("waited", F.coalesce(F.col("used") * (F.col("used") - 1), F.lit(attempts * (attempts - 1))).cast("double"))


# Queries

_FIX = lambda t: W.repair(F.from_json(t, L.PLAN), F.lit(40))
_SHORT_BASE = step("add_flat", text="The series is flat at 5", role="start", target_value=5, start_timestep=0, end_timestep=9)
_LAYERED = {"semantic_layer": "segment_structure"}
_F0 = step("add_flat", text="flat", target_value=5, start_timestep=0, end_timestep=39, extra=_LAYERED)
_LOCAL = {"semantic_layer": "local_event"}
_S0 = step("add_spike", "s2", timestep=7, amplitude=3, extra=_LOCAL)
examples(
    "w01_repair_plan",
    [(plan(_F0, _S0),), (plan(_F0, step("add_odd", "o", text="odd")),), (plan({**_F0, "effect_type": "additive"}, length=41),), (plan(FLAT, step("add_noise", "z", noise_scale=0.1)),), (plan(_F0, needs_library_extension=True, description="From timestep 5 to 9 data is missing.", unresolved_semantics=[{"id": "u", "description": "d", "source_text": "t", "reason": "workflow failed"}]),)],
    ["0||s1 end_timestep=39 start_timestep=0 target_value=5;s2 amplitude=3 timestep=7", "1|unresolved 2|s1 end_timestep=39 start_timestep=0 target_value=5;o", "1|length,effect_type add_flat|s1 end_timestep=39 start_timestep=0 target_value=5", "1|semantic_layer add_flat,semantic_layer add_noise,random_seed add_noise|s1 end_timestep=39 start_timestep=0 target_value=5;z noise_scale=0.1 random_seed=7", "1|recovered|step_1 end_timestep=9 start_timestep=5"],
    lambda t: F.concat_ws("|", _FIX(t)["iterations"].cast("string"), F.array_join(_FIX(t)["notes"], ","), _SHOW(_FIX(t)["plan"]["steps"])),
)
_ONE = lambda t, d: F.array_join(F.transform(F.transform(steps_of(t), lambda s, i: W.fixed_step(s, i, d, F.lit(0.0), F.lit(1.0), F.lit(True))), lambda x: F.coalesce(F.concat_ws(" ", F.array_join(F.transform(F.array_sort(F.map_entries(x["step"]["parameters"])), lambda e: F.concat_ws("=", e["key"], e["value"])), " ")), F.lit("gone"))), ";")
examples(
    "w04_semantic_normalization",
    [(plan(step("add_spike", text="a spike at timestep 9 reaches 4", timestep=7, amplitude=1)), "x"), (plan(step("add_gap", text="data is missing", start_timestep=3, fill_value=0)), "x"), (plan(step("add_noise", noise_scale=2, random_seed=1)), "some jitter"), (plan(step("add_trend", slope=1, start_timestep=11)), "It rises after timestep 10."), (plan(step("add_spike", text="t", timestep=7, amplitude=1)), "a brief impulse"), (plan(step("add_noise", noise_scale=2)), "wider swings rather than adding fresh random noise")],
    ["target_value=4.0 timestep=9", "start_timestep=3", "noise_scale=0.2 random_seed=1", "slope=1 start_timestep=10", "target_value=0.5 timestep=7", ""], _ONE,
)
examples("w05_global_baseline", [(plan(_SHORT_BASE, SPIKE), "x"), (plan(_SHORT_BASE), "x"), (plan({**_SHORT_BASE, "source_text": "the first half is flat"}, SPIKE), "x")], ["s1 end_timestep=39 start_timestep=0 target_value=5;s2 amplitude=3 timestep=7", "s1 end_timestep=9 start_timestep=0 target_value=5", "s1 end_timestep=9 start_timestep=0 target_value=5;s2 amplitude=3 timestep=7"], lambda t, d: _SHOW(W.global_baselines(steps_of(t), d, F.lit(40))))
_SHIFT = step("add_level_shift", "s2", start_timestep=20, shift=2)
examples("w06_shift_baseline", [(plan(_SHORT_BASE, _SHIFT), "It jumps to a new level."), (plan(_SHORT_BASE, _SHIFT), "Nothing."), (plan(_SHORT_BASE, step("add_level_shift", "s2", start_timestep=20, target_value=2)), "A shift.")], ["s1 end_timestep=39 start_timestep=0 target_value=5;s2 shift=2 start_timestep=20", "s1 end_timestep=9 start_timestep=0 target_value=5;s2 shift=2 start_timestep=20", "s1 end_timestep=9 start_timestep=0 target_value=5;s2 start_timestep=20 target_value=2"], lambda t, d: _SHOW(W.shift_baselines(steps_of(t), d, F.lit(40))))
_FAILED = dict(needs_library_extension=True, unresolved_semantics=[{"id": "u", "description": "d", "source_text": "t", "reason": "The workflow failed."}])
examples("w07_recover_steps", [(plan(FLAT, **_FAILED), "From timestep 5 to 9 the values are missing entirely."), (plan(FLAT, **_FAILED), "After timestep 12 it is more volatile, rather than adding fresh random noise."), (plan(FLAT, **_FAILED), "Nothing known."), (plan(FLAT), "From timestep 5 to 9 data is missing.")], ["step_1 end_timestep=9 start_timestep=5", "step_1 baseline=0.0 end_timestep=39 start_timestep=12 volatility_scale=2.0", None, None], lambda t, d: _SHOW(W.recovered_steps(F.from_json(t, L.PLAN), d, F.lit(40))))
examples("w08_text_rules", [("no fresh random noise, scale 3",), ("data gap filled at timestep 8",), ("After timestep 12 it jumps to -4.5",), ("the baseline is 3",)], ["true true false false   false false", "false false true true 8  false false", "false false false false  12 true false", "false false false false   false true"], lambda t: F.concat_ws(" ", *(f(t).cast("string") for f in (W.forbids_noise, W.states_scale, W.states_fill, W.asks_missing)), F.coalesce(W.stated_timestep(t).cast("string"), F.lit("")), F.coalesce(W.after_timestep(t).cast("string"), F.lit("")), W.shifts_for_good(t).cast("string"), W.global_baseline(t).cast("string")))
examples("w09_static_rejector", [("A mean-reverting path.", plan(FLAT)), ("A flat path.", plan(FLAT)), ("A mean-reverting path.", plan(FLAT, needs_library_extension=True))], ["u1 mean_reversion true", "s1 false", "s1 true"], lambda d, t: F.concat_ws(" ", F.get(W.reject(F.from_json(t, L.PLAN), d, F.lit(40), unsupported(d))["steps"], F.lit(0))["id"], F.get(W.reject(F.from_json(t, L.PLAN), d, F.lit(40), unsupported(d))["steps"], F.lit(0))["description"], W.reject(F.from_json(t, L.PLAN), d, F.lit(40), unsupported(d))["needs_library_extension"].cast("string")))
examples(
    "b01_rule_parser",
    [("The series is flat at 5 from timestep 0 to 39.",), ("From timestep 3 to 9 it moves linearly from 2 to 8.5, then spike to 9 at timestep 20.",), ("After timestep 10 the trend increases with slope -0.5.",), ("At timestep 12 it jumps down by 3.",), ("A change point at timestep 8 jumps up by 2 with slope 0.5.",), ("From timestep 4 to 6 values are missing.",), ("From timestep 0 to 30 a sine wave with amplitude 2 and period 7.",), ("Between timestep 5 and 9 noise of scale 0.3 with seed 4.",), ("After timestep 9 swings are twice as wide around the baseline.",), ("A peak reaches 12 at timestep 3.",), ("A mean-reverting path.",), ("Nothing.",)],
    ["step_1 end_timestep=39 start_timestep=0 target_value=5.0", "step_1 end_timestep=9 end_value=8.5 start_timestep=3 start_value=2.0;step_2 target_value=9.0 timestep=20", "step_1 end_timestep=39 slope=-0.5 start_timestep=10", "step_1 anchor_timestep=12 shift=-3.0", "step_1 anchor_timestep=8 shift=2.0;step_2 anchor_timestep=8 level_change=2.0 slope_change=0.5", "step_1 end_timestep=6 start_timestep=4", "step_1 amplitude=2.0 end_timestep=30 period=7.0 start_timestep=0 waveform=sine",
     "step_1 end_timestep=9 noise_scale=0.3 random_seed=4 start_timestep=5", "step_1 baseline=0.0 end_timestep=99 start_timestep=9 volatility_scale=2.0", "step_1 end_timestep=8 start_timestep=0 target_value=12.0 timestep=3 width=2", "u1 mean_reversion", "u1 unparsed_description"],
    lambda d: F.when(L.rejected(rule_plan(d, F.lit(40))), F.concat_ws(" ", F.lit("u1"), F.get(rule_plan(d, F.lit(40))["steps"], F.lit(0))["description"])).otherwise(_SHOW(rule_plan(d, F.lit(40))["steps"])),
)
examples("b03_without_rejection", [(plan(unresolved(), needs_library_extension=True),), (plan(SPIKE),)], ["step_1 end_timestep=39 start_timestep=0 target_value=0.0|false", "s2 amplitude=3 timestep=7|false"], lambda t: F.concat_ws("|", _SHOW(without_rejection(F.from_json(t, L.PLAN), F.lit("d"), F.lit(40))["steps"]), L.rejected(without_rejection(F.from_json(t, L.PLAN), F.lit("d"), F.lit(40))).cast("string")))
_SIGNED = lambda p: F.concat_ws("|", F.coalesce(p["version"], F.lit("-")), p["global_context"]["length"].cast("string"), F.array_join(F.transform(p["steps"], lambda s: F.concat_ws(" ", F.coalesce(s["id"], F.lit("-")), s["primitive"], s["effect_type"], F.coalesce(s["source_text"], F.lit("-")))), ";"))
_INTACT = "1.0|40|s1 add_flat overwrite said;s2 add_spike additive said"
examples("b06_ablation_transforms", [(v, plan(FLAT, SPIKE)) for v in VARIANTS[:6]], [_INTACT, "-" + _INTACT[3:], _INTACT.replace("add_flat", "add_unregistered_pattern"), "1.0|40|s2 add_spike additive said;s1 add_flat overwrite said", _INTACT.replace("said", "-"), "-|41|- add_flat additive -;s2 add_spike additive said"], lambda v, t: F.coalesce(*[F.when(v == x, _SIGNED(damaged(F.from_json(t, L.PLAN), x))) for x in VARIANTS[:6]]))
examples("b08_prompts", [("A rise", "add_trend,add_ramp")], ["Select primitives for the description.\nDescription: A rise\nLength: 40\nRange: [0.0, 10.0]\nCandidates: add_trend, add_ramp\nAnswer with one JSON object."], lambda c, x: selection_prompt(c, F.split(x, ","), F.lit(40), F.lit(0.0), F.lit(10.0)))


def _ablated(variant: str, passed: bool, csr: float) -> None:
    @query(f"b07_{variant}", f"SELECT user_id, {passed} AS passed, floor({csr}::DOUBLE * 1e6 + 0.5) / 1e6::DOUBLE AS csr FROM (SELECT DISTINCT user_id FROM events)")
    def run(spark, sf_dir):
        rows = run_ablation(S.gold_cases(spark, sf_dir, of=(0,)), variant)
        return rows.select("user_id", "passed", rounded(F.col("csr")).alias("csr"))


for _v, _p, _c in (("full_oracle", True, 1.0), ("no_schema_validation", False, 2 / 3), ("no_registry_grounding", False, 0.0), ("no_effect_ordering", False, 1.0), ("repair_challenge_with_repair", True, 1.0)):
    _ablated(_v, _p, _c)


@query("b05_saved_outputs", "SELECT user_id AS case_id, CASE WHEN user_id % 3 = 0 THEN 'missing_artifact' WHEN user_id % 3 = 1 THEN 'loaded' ELSE 'length_mismatch' END AS status FROM (SELECT DISTINCT user_id FROM events)")
def b05(spark, sf_dir):
    """Saved series under any of their names, missing ones and wrong lengths."""
    users = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("user_id").alias("case_id")).agg(F.count("*").cast("int").alias("length"))
    saved = users.where("case_id % 3 != 0").select(F.lit("Ours").alias("method"), "case_id", F.when(F.col("case_id") % 3 == 1, F.array_repeat(F.lit(1.0), F.col("length"))).alias("series"), F.when(F.col("case_id") % 3 == 2, F.array(F.lit(1.0))).alias("values"))
    return run_methods(users, saved, ["Ours"]).select("case_id", "status")


@query("b09_planner_answers", "SELECT user_id, CASE WHEN user_id % 4 = 3 THEN NULL ELSE 'plan ' || (1 + user_id % 4) END AS response, ([0, 2, 6, 6])[1 + user_id % 4]::DOUBLE AS waited FROM (SELECT DISTINCT user_id FROM events)")
def b09(spark, sf_dir):
    """Recorded answers of an external planner: the first good one of three attempts."""
    prompts = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct().withColumn("prompt", (F.col("user_id") % 4).cast("string"))
    responses = spark.createDataFrame([(str(k), a, f"plan {a}", a == k + 1) for k in range(4) for a in range(1, 5)], "prompt string, attempt int, response string, ok boolean")
    return answered(prompts, responses).select("user_id", "response", "waited")
