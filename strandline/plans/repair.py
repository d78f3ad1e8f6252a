"""Static repair and rejection of plans: rules over one row, two passes at most.

A pass fixes each step on its own, a chain of rules that each see what the one before it made, and then the
baselines that later steps rest on. What was changed is kept as texts beside the plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.primitives import let
from . import plan as L
from .registry import PRIMITIVES, effect_of, layer_of

# The wordings that rules look for.
NO_FRESH_NOISE = ["rather than introducing fresh random noise", "without introducing fresh random noise", "not introducing fresh random noise", "no fresh random noise", "rather than adding fresh random noise"]
MISSING = ["missing", "data gap", "gap in the data", "gap"]
SHIFTING = ["jump", "jumps", "shift", "shifts", "level shift", "new level", "stays at that new level"]
PARTIAL = ["first part", "first half", "initial segment", "early segment"]
GLOBAL = ["baseline is", "starts from a baseline", "stays around", "mostly centered at", "series is flat at", "the series is flat at", "begins flat", "starts flat"]
TARGETS = [r"\breaches\s+([-+]?\d+(?:\.\d+)?)", r"\bto\s+([-+]?\d+(?:\.\d+)?)", r"\bset exactly to\s+([-+]?\d+(?:\.\d+)?)", r"\bvalue\s+([-+]?\d+(?:\.\d+)?)"]
BUILDING = ["add_spike", "add_dip", "add_peak", "add_trough", "add_outlier", "add_seasonality", "add_noise", "add_volatility", "add_ramp", "add_trend", "add_growth", "add_decay", "add_change_point", "add_level_shift"]
SOMETHING = "time-series description"


def forbids_noise(text: Column) -> Column:
    return L.has_any(F.lower(text), NO_FRESH_NOISE)


def states_scale(text: Column) -> Column:
    return F.regexp_like(F.lower(text), F.lit(r"\bscale\s+[-+]?\d|\bnoise[_ -]?scale\s*[:=]?\s*[-+]?\d"))


def states_fill(text: Column) -> Column:
    return L.has_any(F.lower(text), ["fill", "encoded as"])


def asks_missing(text: Column) -> Column:
    return L.has_any(F.lower(text), MISSING)


def stated_timestep(text: Column) -> Column:
    return F.regexp_extract(F.lower(text), r"\b(?:at|near|around)\s+timestep\s+(\d+)\b", 1).try_cast("int")


def stated_target(text: Column) -> Column:
    return F.coalesce(*[F.regexp_extract(F.lower(text), p, 1).try_cast("double") for p in TARGETS])


def after_timestep(text: Column) -> Column:
    return F.regexp_extract(F.lower(text), r"\bafter timestep\s+(\d+)\b", 1).try_cast("int")


def shifts_for_good(text: Column) -> Column:
    return L.has_any(F.lower(text), SHIFTING)


def global_baseline(text: Column) -> Column:
    return ~L.has_any(F.lower(text), PARTIAL) & L.has_any(F.lower(text), GLOBAL)


def new_step(id: Column | str, name: Column | str, parameters: dict[str, Column], role: Column | str, text: Column, confidence: float = 0.8, **more: Column) -> Column:
    """A primitive step; its effect and layer are the registry's."""
    c = lambda x: F.lit(x) if isinstance(x, str) else x
    params = F.map_filter(F.create_map(*[x for k, v in parameters.items() for x in (F.lit(k), v.cast("string"))]), lambda k, v: v.isNotNull())
    fields = {"id": c(id), "kind": F.lit("primitive"), "primitive": c(name), "parameters": params, "semantic_role": c(role), "effect_type": effect_of(c(name)), "confidence": F.lit(confidence), "source_text": text, "semantic_layer": layer_of(c(name)), "needs_library_extension": F.lit(False)} | more
    names = ["id", "kind", "primitive", "parameters", "semantic_role", "effect_type", "confidence", "source_text", "semantic_layer", "priority", "protected_constraints", "semantic_cues", "inferred_constraints", "description", "reason", "needs_library_extension"]
    return F.struct(*[fields.get(n, F.lit(None)).alias(n) for n in names]).cast(L.STEP)


def open_step(id: Column, said: Column, text: Column, reason: Column, confidence: float = 0.5) -> Column:
    fields = {"id": id, "kind": F.lit("unresolved"), "semantic_role": said, "confidence": F.lit(confidence), "source_text": text, "description": said, "reason": reason, "needs_library_extension": F.lit(True)}
    names = ["id", "kind", "primitive", "parameters", "semantic_role", "effect_type", "confidence", "source_text", "semantic_layer", "priority", "protected_constraints", "semantic_cues", "inferred_constraints", "description", "reason", "needs_library_extension"]
    return F.struct(*[fields.get(n, F.lit(None)).alias(n) for n in names]).cast(L.STEP)


Rule = Callable[[Column], tuple[Column, Column, Column]]


def _chain(step: Column, rules: list[Rule]) -> Column:
    """``struct<step, notes>`` after rules ``step -> (applies, step, note)``, each on what the one before it made."""
    start = F.struct(step.alias("step"), F.array().cast("array<string>").alias("notes"))

    def apply(state: Column, rest: list[Rule]) -> Column:
        if not rest:
            return state

        def one(st: Column) -> Column:
            applies, made, note = rest[0](st["step"])
            done = F.struct(made.alias("step"), F.array_append(st["notes"], note).alias("notes"))
            return apply(F.when(F.coalesce(applies, F.lit(False)), done).otherwise(st), rest[1:])

        return let(state, one)

    return apply(start, rules)


def fixed_step(step: Column, index: Column, description: Column, low: Column, high: Column, with_volatility: Column) -> Column:
    """``struct<step, notes>`` of one step (null step: it goes)."""
    name = step["primitive"]
    said = F.coalesce(step["description"], step["semantic_role"], name, F.lit("unresolved semantic"))
    number = (index + 1).cast("string")
    opened = open_step(F.coalesce(step["id"], F.concat(F.lit("unresolved_"), number)), said, F.coalesce(step["source_text"], description), F.coalesce(step["reason"], F.lit(L.NO_PRIMITIVE)))
    unknown = (step["kind"] == "unresolved") | ~F.coalesce(name, F.lit("")).isin(*PRIMITIVES)
    filled = step.withField("id", F.coalesce(step["id"], F.concat(F.lit("step_"), number))).withField("kind", F.lit("primitive")).withField("parameters", F.map_filter(F.coalesce(step["parameters"], F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull()))
    filled = filled.withField("semantic_role", F.coalesce(step["semantic_role"], F.replace(name, F.lit("add_"), F.lit("")))).withField("confidence", F.coalesce(step["confidence"], F.lit(0.5))).withField("source_text", F.coalesce(step["source_text"], description)).withField("needs_library_extension", F.lit(False))
    event = lambda s: s["primitive"].isin(*L.EVENTS)
    after = after_timestep(description)
    low_text = F.lower(description)
    rules: list[Rule] = [
        lambda s: (~s["effect_type"].eqNullSafe(effect_of(s["primitive"])), s.withField("effect_type", effect_of(s["primitive"])), F.concat(F.lit("effect_type "), s["primitive"])),
        lambda s: ((s["primitive"] != "add_plateau") & ~s["semantic_layer"].eqNullSafe(layer_of(s["primitive"])), s.withField("semantic_layer", layer_of(s["primitive"])), F.concat(F.lit("semantic_layer "), s["primitive"])),
        lambda s: ((s["primitive"] == "add_noise") & ~L.has(s, "random_seed") & ~L.has(s, "random_generator"), L.with_param(s, "random_seed", F.lit(7)), F.lit("random_seed add_noise")),
        lambda s: (L.whole(s, "start_timestep") == after + 1, L.with_param(s, "start_timestep", after), F.lit("start after timestep")),
        lambda s: (event(s) & (stated_timestep(s["source_text"]) != L.whole(s, "timestep")), L.with_param(s, "timestep", stated_timestep(s["source_text"])), F.concat(F.lit("timestep "), s["primitive"])),
        lambda s: (event(s) & ~L.has(s, "target_value") & stated_target(s["source_text"]).isNotNull(), L.with_param(s, "target_value", stated_target(s["source_text"]), "amplitude", "relative_change", "delta"), F.concat(F.lit("target_value "), s["primitive"])),
        lambda s: ((s["primitive"] == "add_gap") & L.has(s, "fill_value") & asks_missing(s["source_text"]) & ~states_fill(s["source_text"]), L.without_param(s, "fill_value"), F.lit("fill_value add_gap")),
        lambda s: ((s["primitive"] == "add_noise") & (L.number(s, "noise_scale") > 0.5) & ~states_scale(description) & L.has_any(low_text, ["jitter", "noisy"]), L.with_param(s, "noise_scale", F.lit(0.2)), F.lit("noise_scale add_noise")),
        lambda s: (s["primitive"].isin("add_spike", "add_dip") & ~L.has(s, "target_value") & L.has(s, "amplitude") & (high - low).between(0.0, 1.0) & L.has_any(low_text, ["impulse", "spike"]), L.with_param(s, "target_value", (low + high) / 2, "amplitude"), F.lit("narrow range impulse")),
    ]
    gone = (name == "add_noise") & forbids_noise(description) & with_volatility
    none = F.struct(F.lit(None).cast(L.STEP).alias("step"), F.array(F.lit("removed add_noise")).alias("notes"))
    known = (step["kind"] == "unresolved") & step["id"].isNotNull() & step["source_text"].isNotNull() & step["reason"].isNotNull()
    kept = F.struct(opened.alias("step"), F.when(F.coalesce(known, F.lit(False)), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("unresolved "), number))).alias("notes"))
    return F.when(unknown, kept).when(gone, none).otherwise(let(filled, lambda s: _chain(s, rules)))


def _promoted(step: Column, final: Column, role: str) -> Column:
    named = F.when(F.contains(F.lower(F.coalesce(step["semantic_role"], F.lit(""))), F.lit("baseline")), step["semantic_role"]).otherwise(F.lit(role))
    return L.with_param(step, "end_timestep", final).withField("semantic_layer", F.lit("global_scaffold")).withField("semantic_role", named)


def _flat(step: Column) -> Column:
    return F.coalesce((step["primitive"] == "add_flat") & L.has(step, "target_value"), F.lit(False))


def global_baselines(steps: Column, description: Column, length: Column) -> Column:
    """A first flat stretch that the text calls the baseline reaches the end where later steps build on it."""
    final = length - 1

    def one(s: Column, i: Column) -> Column:
        later = F.exists(F.slice(steps, i + 2, F.size(steps)), lambda x: F.coalesce(x["primitive"].isin(*BUILDING), F.lit(False)))
        short = _flat(s) & (F.coalesce(L.whole(s, "start_timestep"), F.lit(0)) == 0) & (F.coalesce(L.whole(s, "end_timestep"), F.lit(-1)) < final)
        return F.when(short & later & global_baseline(F.coalesce(s["source_text"], description)), _promoted(s, final, "global baseline")).otherwise(s)

    return F.transform(steps, one)


def shift_baselines(steps: Column, description: Column, length: Column) -> Column:
    """The flat stretch before a relative level shift becomes a baseline of the whole horizon."""
    final = length - 1

    def one(now: Column, i: Column) -> Column:
        s = F.get(now, i)
        begin = F.coalesce(L.whole(s, "start_timestep"), L.whole(s, "anchor_timestep"))
        fits = lambda x: _flat(x) & (L.whole(x, "start_timestep") == 0) & (begin >= 0) & ((L.whole(x, "end_timestep") < final) | ~x["semantic_layer"].eqNullSafe(F.lit("global_scaffold")))
        base = F.array_max(F.filter(F.sequence(F.lit(0), F.greatest(i - 1, F.lit(0))), lambda j: (j < i) & F.coalesce(fits(F.get(now, j)), F.lit(False))))
        wanted = (s["primitive"] == "add_level_shift") & L.has(s, "shift") & ~L.has(s, "target_value") & base.isNotNull()
        return F.when(F.coalesce(wanted, F.lit(False)), F.transform(now, lambda x, k: F.when(k == base, _promoted(x, final, "persistent baseline")).otherwise(x))).otherwise(now)

    fold = F.aggregate(F.sequence(F.lit(0), F.size(steps) - 1), steps, one)
    return F.when(shifts_for_good(description) & (F.size(steps) > 0), fold).otherwise(steps)


def recovered_steps(plan: Column, description: Column, length: Column) -> Column:
    """After a failed workflow: a gap or a volatility step that the text states outright, or null."""
    low = F.lower(description)
    failed = F.exists(plan["unresolved_semantics"], lambda u: F.contains(F.lower(F.concat_ws(" ", u["reason"], u["description"])), F.lit("workflow failed")))
    a, b = (F.regexp_extract(low, r"\bfrom timestep\s+(\d+)\s+to\s+(\d+)\b", k).try_cast("int") for k in (1, 2))
    gap = new_step("step_1", "add_gap", {"start_timestep": a, "end_timestep": b}, "missing interval", description)
    start = after_timestep(description)
    wide = new_step("step_1", "add_volatility", {"start_timestep": start, "end_timestep": length - 1, "volatility_scale": F.lit(2.0), "baseline": F.lit(0.0)}, "wider swings around same center", description)
    return F.when(F.coalesce(plan["needs_library_extension"] & failed, F.lit(False)), F.when(a.isNotNull() & L.has_any(low, ["missing entirely", "data is missing", "missing interval"]), F.array(gap)).when(start.isNotNull() & low.contains("more volatile") & forbids_noise(description), F.array(wide)))


def repair_once(plan: Column, length: Column) -> Column:
    """``struct<plan, notes>`` of one pass."""
    description = F.coalesce(plan["input_description"], F.lit(SOMETHING))
    own = plan["global_context"]["numeric_range"]
    low, high = (F.when(own["min"].isNotNull() & own["max"].isNotNull(), own[k]).otherwise(d) for k, d in (("min", -1000.0), ("max", 1000.0)))
    none = F.array().cast("array<string>")

    def with_steps(raw: Column, back: Column) -> Column:
        volatile = F.exists(raw, lambda s: F.coalesce(s["primitive"] == "add_volatility", F.lit(False)))
        fixed = F.transform(raw, lambda s, i: fixed_step(s, i, description, low, high, volatile))
        return let(fixed, lambda x: with_fixed(x, back))

    def with_fixed(fixed: Column, back: Column) -> Column:
        first = F.transform(F.filter(fixed, lambda x: x["step"].isNotNull()), lambda x: x["step"])
        based = let(global_baselines(first, description, length), lambda s: shift_baselines(s, description, length))
        opened = F.transform(F.filter(first, lambda s: s["kind"] == "unresolved"), lambda s: F.struct(s["id"].alias("id"), s["description"].alias("description"), s["source_text"].alias("source_text"), s["reason"].alias("reason")))
        given = F.when(back, F.array().cast(f"array<{L.UNRESOLVED}>")).otherwise(F.coalesce(plan["unresolved_semantics"], F.array().cast(f"array<{L.UNRESOLVED}>")))
        listed = F.transform(given, lambda u, i: F.struct(F.coalesce(u["id"], F.concat(F.lit("u"), (i + 1).cast("string"))).alias("id"), F.coalesce(u["description"], F.lit("unresolved semantic")).alias("description"), F.coalesce(u["source_text"], description).alias("source_text"), F.coalesce(u["reason"], F.lit(L.NO_PRIMITIVE)).alias("reason")))
        once = F.aggregate(F.concat(opened, listed), F.array().cast(f"array<{L.UNRESOLVED}>"), lambda now, u: F.when(F.exists(now, lambda k: k["id"] == u["id"]), now).otherwise(F.array_append(now, u)))
        return let(F.struct(based.alias("steps"), once.alias("open"), first.alias("first"), F.flatten(F.transform(fixed, lambda x: x["notes"])).alias("notes"), back.alias("back")), finished)

    def finished(x: Column) -> Column:
        steps = F.when(F.size(x["steps"]) > 0, x["steps"]).otherwise(F.transform(x["open"], lambda u: open_step(u["id"], u["description"], u["source_text"], u["reason"])))
        one = lambda c, t: F.when(F.coalesce(c, F.lit(False)), F.array(F.lit(t))).otherwise(none)
        moved = F.zip_with(x["first"], x["steps"], lambda a, b: ~L.param(a, "end_timestep").eqNullSafe(L.param(b, "end_timestep")) | ~a["semantic_layer"].eqNullSafe(b["semantic_layer"]))
        notes = F.array_distinct(F.concat(one(plan["input_description"].isNull(), "input_description"), one(plan["registry_validation"].isNull(), "registry_validation"), one(~plan["global_context"]["length"].eqNullSafe(length), "length"), one(plan["version"].isNull(), "version"), one(x["back"], "recovered"), x["notes"], one(F.exists(moved, lambda m: m), "baseline")))
        context = F.struct(length.cast("int").alias("length"), F.struct(low.alias("min"), high.alias("max")).alias("numeric_range"), plan["global_context"]["seed"].alias("seed"))
        made = F.struct(
            F.coalesce(plan["version"], F.lit("1.0")).alias("version"), description.alias("input_description"), F.coalesce(plan["registry_validation"], F.struct(F.lit("valid").alias("status"))).alias("registry_validation"), context.alias("global_context"), steps.alias("steps"),
            x["open"].alias("unresolved_semantics"), ((F.coalesce(plan["needs_library_extension"], F.lit(False)) & ~x["back"]) | (F.size(x["open"]) > 0)).alias("needs_library_extension")).cast(L.PLAN)
        return F.struct(made.alias("plan"), notes.alias("notes"))

    saved = recovered_steps(plan, description, length)
    return let(F.struct(F.coalesce(saved, plan["steps"], F.array().cast(f"array<{L.STEP}>")).alias("steps"), saved.isNotNull().alias("back")), lambda x: with_steps(x["steps"], x["back"]))


def repair(plan: Column, length: Column, most: int = 2) -> Column:
    """``struct<plan, notes, iterations>``: passes until nothing is left to change, ``most`` at most."""

    def again(state: Column, left: int) -> Column:
        if not left:
            return state
        step = lambda st: let(repair_once(st["plan"], length), lambda r: F.when(F.size(r["notes"]) > 0, F.struct(r["plan"].alias("plan"), F.array_union(st["notes"], r["notes"]).alias("notes"), (st["iterations"] + 1).alias("iterations"))).otherwise(st))
        return let(again(state, left - 1), step)

    return again(F.struct(plan.alias("plan"), F.array().cast("array<string>").alias("notes"), F.lit(0).alias("iterations")), most)


def rejection(description: Column, length: Column, semantic: Column, low: Column | None = None, high: Column | None = None) -> Column:
    """A plan that only declines."""
    reason = F.lit("Requested semantic is outside the current primitive library.")
    item = F.struct(F.lit("u1").alias("id"), semantic.alias("description"), description.alias("source_text"), reason.alias("reason"))
    bounds = F.struct(F.coalesce(low if low is not None else F.lit(None), F.lit(-1000.0)).alias("min"), F.coalesce(high if high is not None else F.lit(None), F.lit(1000.0)).alias("max"))
    return F.struct(
        F.lit("1.0").alias("version"), description.alias("input_description"), F.struct(F.lit("valid").alias("status")).alias("registry_validation"), F.struct(length.cast("int").alias("length"), bounds.alias("numeric_range"), F.lit(None).cast("bigint").alias("seed")).alias("global_context"),
        F.array(open_step(F.lit("u1"), semantic, description, reason, 0.9)).alias("steps"), F.array(item).alias("unresolved_semantics"), F.lit(True).alias("needs_library_extension")).cast(L.PLAN)


def reject(plan: Column, description: Column, length: Column, semantic: Column) -> Column:
    """The plan, or one that declines where ``semantic`` is not null and the plan does not decline already."""
    done = F.coalesce(plan["needs_library_extension"], F.lit(False)) | (F.coalesce(F.size(plan["unresolved_semantics"]), F.lit(0)) > 0)
    return F.when(done | semantic.isNull(), plan).otherwise(rejection(description, length, semantic))
