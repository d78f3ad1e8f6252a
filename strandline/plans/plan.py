"""Plans as data: types, parsing, validation, normalization and the order of steps.

A plan is a struct whose steps are an array; every rule is an expression over one row, so plans of any
number are checked and rewritten in one narrow stage. Rules that depend on earlier rewrites are folds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import ADD, PRIMITIVES, PROGRAM_MODULE, effect_of, layer_of

CONSTRAINT = "struct<kind:string,start:int,end:int,direction:string,timestep:int,value:double,tolerance:double>"
CUE = "struct<kind:string,source_text:string,confidence:double>"
INFERRED = "struct<kind:string,value:string,source_text:string,confidence:double,notes:string>"
STEP = (
    "struct<id:string,kind:string,primitive:string,parameters:map<string,string>,semantic_role:string,effect_type:string,confidence:double,source_text:string,semantic_layer:string,priority:int,"
    f"protected_constraints:array<{CONSTRAINT}>,semantic_cues:array<{CUE}>,inferred_constraints:array<{INFERRED}>,description:string,reason:string,needs_library_extension:boolean>"
)
UNRESOLVED = "struct<id:string,description:string,source_text:string,reason:string>"
_HEAD = f"version:string,input_description:string,registry_validation:struct<status:string>,global_context:struct<length:int,numeric_range:struct<min:double,max:double>,seed:bigint>,steps:array<{STEP}>"
PLAN = f"struct<{_HEAD},unresolved_semantics:array<{UNRESOLVED}>,needs_library_extension:boolean>"
_RAW = f"struct<{_HEAD},unresolved_semantics:array<string>,needs_library_extension:boolean>"

# Fixed values
LAYER_ORDER = ["global_scaffold", "segment_structure", "local_event", "texture", "missingness"]
EVENTS = ["add_spike", "add_peak", "add_trough", "add_dip", "add_outlier"]
TEXTURES = ["add_noise", "add_volatility", "add_seasonality"]
CUE_WORDS = {
    "decline": ["declin", "downward", "descending", "negative slope", "nonincreasing"], "increase": ["increas", "upward", "ascending", "positive slope", "nondecreasing", "climb"],
    "plateau": ["plateau", "flat", "constant", "stable level", "zero slope"], "oscillation": ["oscillat", "season", "periodic", "repeating pattern", "sine"],
    "light_noise": ["noise", "jitter", "volatility", "fluctuation", "texture"],
}
_MANY = r"\b(?:several|multiple|repeated|many)\s+"
_ADJECTIVES = r"(?:small\s+|local\s+|prominent\s+|distinct\s+|separate\s+|isolated\s+)*"
PLURALS = [
    (rf"{_MANY}{_ADJECTIVES}peaks\b", ["add_peak", "add_spike"]), (rf"{_MANY}{_ADJECTIVES}troughs\b", ["add_trough", "add_dip"]),
    (rf"{_MANY}(?:peaks\s+and\s+troughs|troughs\s+and\s+peaks)\b", ["add_peak", "add_spike", "add_trough", "add_dip"]),
]
OVERLAYS = ["added on top", "superimposed", "around that level"]
BASELINES = ["baseline", "stable", "stays close", "remains fairly stable", "starts from", "begins near", "initial plateau", "plateau"]
NO_PRIMITIVE = "No registered primitive covers this semantic."
MARKED = "Model marked this semantic as unresolved."


def has_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def param(step: Column, key: str) -> Column:
    return F.try_element_at(step["parameters"], F.lit(key))


def number(step: Column, key: str) -> Column:
    return param(step, key).try_cast("double")


def whole(step: Column, key: str) -> Column:
    return number(step, key).cast("int")


def has(step: Column, key: str) -> Column:
    return F.coalesce(F.map_contains_key(step["parameters"], F.lit(key)), F.lit(False))


def with_param(step: Column, key: str, value: Column, *drop: str) -> Column:
    kept = F.map_filter(step["parameters"], lambda k, v: ~k.isin(key, *drop))
    return step.withField("parameters", F.map_concat(kept, F.create_map(F.lit(key), value.cast("string"))))


def without_param(step: Column, *keys: str) -> Column:
    return step.withField("parameters", F.map_filter(step["parameters"], lambda k, v: ~k.isin(*keys)))


def is_primitive(step: Column) -> Column:
    return F.coalesce(step["kind"], F.lit("primitive")) == "primitive"


def start_of(step: Column) -> Column:
    return F.coalesce(whole(step, "start_timestep"), whole(step, "anchor_timestep"), whole(step, "timestep"))


# Parsing


def json_text(text: Column) -> Column:
    """What lies between the first and the last brace, or null."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def lenient(text: Column) -> Column:
    """Bare decimals get their zero, sums of two integers after a colon are added up."""
    plain = F.regexp_replace(F.regexp_replace(text, r"([:\[,]\s*)\.(\d+)", "$10.$2"), r"([:\[,]\s*)-\.(\d+)", "$1-0.$2")
    total = r":\s*(-?\d+)\s*\+\s*(-?\d+)(?=\s*[,}\]])"
    between = F.split(plain, total, -1)
    sums = F.zip_with(F.regexp_extract_all(plain, F.lit(total), F.lit(1)), F.regexp_extract_all(plain, F.lit(total), F.lit(2)), lambda a, b: F.concat(F.lit(": "), (a.cast("long") + b.cast("long")).cast("string")))
    return F.array_join(F.zip_with(between, sums, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def cue_kind(text: Column) -> Column:
    low, out = F.lower(text), F.when(F.lit(False), "")
    for kind, words in CUE_WORDS.items():
        out = out.when(has_any(low, words), kind)
    return out


def cues(raw: Column, inferred: Column) -> Column:
    """Cues of known kinds, others by their wording, those of constraints last; each (kind, text) once."""
    words = lambda *x: F.concat_ws(" ", *x)
    known = F.transform(F.coalesce(raw, F.array().cast(f"array<{CUE}>")), lambda c: F.struct(
        F.when(c["kind"].isin(*CUE_WORDS), c["kind"]).otherwise(cue_kind(words(c["kind"], c["source_text"]))).alias("kind"), F.coalesce(F.nullif(F.trim(c["source_text"]), F.lit("")), c["kind"]).alias("source_text"), c["confidence"].alias("confidence")))
    more = F.transform(F.coalesce(inferred, F.array().cast(f"array<{INFERRED}>")), lambda c: F.struct(
        cue_kind(words(c["kind"], c["value"], c["source_text"], c["notes"])).alias("kind"), F.trim(F.coalesce(c["source_text"], c["value"], c["kind"])).alias("source_text"), c["confidence"].alias("confidence")))
    every = F.filter(F.concat(known, more), lambda c: c["kind"].isNotNull())
    seen = lambda now, c: F.exists(now, lambda k: (k["kind"] == c["kind"]) & (k["source_text"] == c["source_text"]))
    return F.aggregate(every, F.array().cast(f"array<{CUE}>"), lambda now, c: F.when(seen(now, c), now).otherwise(F.array_append(now, c)))


def inferred_constraints(raw: Column, found: Column) -> Column:
    """Legal constraints as they are; without any, the slope's sign from the cues."""
    legal = F.filter(F.coalesce(raw, F.array().cast(f"array<{INFERRED}>")), lambda c: c["kind"].isin("slope_sign", "endpoint_order", "monotonicity") & c["value"].isNotNull())
    sign = lambda c: F.when(c["kind"] == "decline", "negative").when(c["kind"] == "increase", "positive").when(c["kind"] == "plateau", "zero")
    derived = F.transform(F.filter(found, lambda c: sign(c).isNotNull()), lambda c: F.struct(F.lit("slope_sign").alias("kind"), sign(c).alias("value"), c["source_text"].alias("source_text"), F.coalesce(F.nullif(c["confidence"], F.lit(0.0)), F.lit(0.8)).alias("confidence"), F.lit(None).cast("string").alias("notes")))
    return F.when(F.size(legal) > 0, legal).otherwise(derived)


def normalize_step(step: Column, index: Column) -> Column:
    """Layer, priority, constraints and cues where a step leaves them out."""
    filled = step.withField("semantic_layer", F.coalesce(step["semantic_layer"], F.when(is_primitive(step), layer_of(step["primitive"])), F.lit("segment_structure"))).withField("priority", F.coalesce(step["priority"], index))
    found = cues(step["semantic_cues"], step["inferred_constraints"])
    full = filled.withField("protected_constraints", F.coalesce(step["protected_constraints"], F.array().cast(f"array<{CONSTRAINT}>"))).withField("semantic_cues", found)
    full = full.withField("inferred_constraints", inferred_constraints(step["inferred_constraints"], found))
    return F.when(is_primitive(step), full).otherwise(filled)


def _unresolved(items: Column, steps: Column) -> Column:
    """Unresolved items as structs: objects as they are, plain text by the unresolved step that says the same."""
    marked = F.filter(steps, lambda s: s["kind"] == "unresolved")
    plain = F.transform(items, lambda x: ~x.startswith("{"))

    def one(x: Column, i: Column) -> Column:
        text = F.trim(x)
        same = F.get(F.filter(marked, lambda s: (text != "") & text.isin(F.trim(F.coalesce(s["description"], F.lit(""))), F.trim(F.coalesce(s["source_text"], F.lit(""))))), F.lit(0))
        order = F.size(F.filter(F.slice(plain, 1, i + 1), lambda p: p))
        said = F.coalesce(F.nullif(text, F.lit("")), F.concat(F.lit("unresolved semantic "), (i + 1).cast("string")))
        made = F.struct(
            F.coalesce(same["id"], F.concat(F.lit("unresolved_"), order.cast("string"))).alias("id"), F.coalesce(F.nullif(same["description"], F.lit("")), said).alias("description"),
            F.coalesce(F.nullif(same["source_text"], F.lit("")), said).alias("source_text"), F.coalesce(F.nullif(same["reason"], F.lit("")), F.lit(MARKED)).alias("reason"))
        return F.when(x.startswith("{"), F.from_json(x, UNRESOLVED)).otherwise(made)

    return F.transform(items, one)


def from_text(text: Column) -> Column:
    """A plan from a planner's answer: fences and talk around the object do not matter; null if there is none."""
    raw = F.from_json(json_text(text), _RAW)
    steps = F.transform(raw["steps"], normalize_step)
    plan = F.struct(
        raw["version"].alias("version"), raw["input_description"].alias("input_description"), raw["registry_validation"].alias("registry_validation"), raw["global_context"].alias("global_context"),
        steps.alias("steps"), _unresolved(raw["unresolved_semantics"], raw["steps"]).alias("unresolved_semantics"), raw["needs_library_extension"].alias("needs_library_extension"))
    return F.when(F.try_parse_json(json_text(text)).isNotNull(), plan)


def range_error(low: Column, high: Column) -> Column:
    finite = lambda x: ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(low.isNull() | high.isNull(), "range_incomplete").when(~finite(low) | ~finite(high), "range_not_finite").when(low > high, "range_reversed")


def implicit_scaffold(step: Column, index: Column, candidates: Column) -> Column:
    """A first flat step may stand outside the candidates where all of them are additive."""
    return (step["primitive"] == "add_flat") & (index == 0) & (F.size(candidates) > 0) & F.forall(candidates, lambda c: effect_of(c) == ADD)


def plural_error(description: Column, steps: Column) -> Column:
    """Wording of several events asks for two at least."""
    low, out = F.lower(description), F.when(F.lit(False), "")
    for pattern, names in PLURALS:
        out = out.when(F.regexp_like(low, F.lit(pattern)) & (F.size(F.filter(steps, lambda s: is_primitive(s) & s["primitive"].isin(*names))) < 2), "plural_events_missing")
    return out


def parse_error(plan: Column, candidates: Column, length: Column, numeric_range: Column | None = None, partial: bool = False) -> Column:
    """``category:reason`` of the first rule that a plan breaks, or null."""
    own, steps = plan["global_context"]["numeric_range"], plan["steps"]
    wrong = lambda s, i: (
        F.when(~is_primitive(s), None if partial else "needs_library_extension:unresolved_step")
        .when(~F.array_contains(candidates, s["primitive"]) & ~implicit_scaffold(s, i, candidates), "plan_invalid:not_a_candidate")
        .when(~s["primitive"].isin(*PRIMITIVES), "plan_invalid:unknown_primitive")
        .when(effect_of(s["primitive"]) != F.coalesce(s["effect_type"], F.lit("")), "plan_invalid:effect_type")
    )
    first = F.get(F.filter(F.transform(steps, wrong), lambda e: e.isNotNull()), F.lit(0))
    invalid = lambda reason: F.when(reason.isNotNull(), F.concat(F.lit("plan_invalid:"), reason))
    tests = [
        F.when(plan.isNull() | steps.isNull() | plan["global_context"]["length"].isNull(), "plan_invalid:schema"),
        F.when(plan["global_context"]["length"] != length, "plan_invalid:length"), invalid(range_error(own["min"], own["max"])),
    ]
    if numeric_range is not None:
        tests.append(F.when((F.abs(own["min"] - numeric_range["min"]) > 1e-9) | (F.abs(own["max"] - numeric_range["max"]) > 1e-9), "plan_invalid:range"))
    tests += [F.when(F.coalesce(plan["registry_validation"]["status"], F.lit("")) != "valid", "plan_invalid:registry"), F.when(F.trim(plan["input_description"]) == "", "plan_invalid:description")]
    if not partial:
        tests += [F.when(plan["needs_library_extension"], "needs_library_extension:flag"), F.when(F.size(plan["unresolved_semantics"]) > 0, "needs_library_extension:unresolved")]
    tests.append(first)
    if partial:
        tests.append(F.when(~F.exists(steps, is_primitive), "needs_library_extension:no_primitive"))
    return F.coalesce(*tests, invalid(plural_error(plan["input_description"], steps)))


# Rewrites


def drop_null_parameters(steps: Column) -> Column:
    return F.transform(steps, lambda s: s.withField("parameters", F.map_filter(s["parameters"], lambda k, v: v.isNotNull())))


def set_context(plan: Column, length: Column, low: Column, high: Column) -> Column:
    """The length and range that were asked for, whatever the plan says."""
    return plan.withField("global_context.length", length.cast("int")).withField("global_context.numeric_range", F.struct(low.cast("double").alias("min"), high.cast("double").alias("max")))


def merge_parameters(steps: Column, inferred: Column, seed: Column) -> Column:
    """Steps with inferred parameters (``array<struct<id,primitive,parameters>>``) over their own; noise gets a seed."""
    own = lambda s: F.get(F.filter(inferred, lambda x: x["id"] == s["id"]), F.lit(0))

    def merged(s: Column) -> Column:
        more = own(s)["parameters"]
        both = F.map_filter(F.map_concat(F.map_filter(s["parameters"], lambda k, v: ~F.map_contains_key(more, k)), more), lambda k, v: v.isNotNull())
        seeded = F.map_concat(both, F.create_map(F.lit("random_seed"), F.coalesce(seed, F.lit(7)).cast("string")))
        return s.withField("parameters", F.when((s["primitive"] == "add_noise") & ~F.map_contains_key(both, F.lit("random_seed")), seeded).otherwise(both))

    return F.transform(steps, lambda s: F.when(is_primitive(s), merged(s)).otherwise(s))


def merge_error(steps: Column, inferred: Column) -> Column:
    own = lambda s: F.get(F.filter(inferred, lambda x: x["id"] == s["id"]), F.lit(0))
    wrong = F.transform(F.filter(steps, is_primitive), lambda s: F.when(own(s).isNull(), "no_parameters").when(own(s)["primitive"] != s["primitive"], "primitive_changed"))
    return F.get(F.filter(wrong, lambda e: e.isNotNull()), F.lit(0))


def extend_backgrounds(steps: Column, length: Column) -> Column:
    """Baselines that later steps build on, and backgrounds under overlays, reach the end of the horizon."""
    final = length - 1
    end = lambda s: whole(s, "end_timestep")
    says = lambda s: F.lower(F.concat_ws(" ", s["source_text"], s["semantic_role"]))
    base = lambda s: is_primitive(s) & s["primitive"].isin("add_flat", "add_ramp") & (start_of(s) == 0) & has_any(says(s), BASELINES)
    later = lambda s: F.exists(steps, lambda x: is_primitive(x) & F.coalesce(start_of(x) > end(s), F.lit(False)))
    whole_first = F.transform(steps, lambda s: F.when(F.coalesce(base(s) & (end(s) < final) & later(s), F.lit(False)), with_param(s, "end_timestep", final)).otherwise(s))

    def overlay(now: Column, i: Column) -> Column:
        s = F.get(now, i)
        begin = start_of(s)
        fits = lambda x: is_primitive(x) & x["primitive"].isin("add_flat", "add_trend", "add_ramp") & (end(x) >= begin - 1)
        under = F.array_max(F.filter(F.sequence(F.lit(0), F.greatest(i - 1, F.lit(0))), lambda j: (j < i) & F.coalesce(fits(F.get(now, j)), F.lit(False))))
        cut = F.exists(F.slice(now, i + 2, F.size(now)), lambda x: is_primitive(x) & (x["effect_type"] == "overwrite") & F.coalesce(start_of(x) > begin, F.lit(False)))
        wanted = is_primitive(s) & has_any(F.lower(F.coalesce(s["source_text"], F.lit(""))), OVERLAYS) & (s["effect_type"] == ADD) & begin.isNotNull() & under.isNotNull() & ~cut
        return F.when(F.coalesce(wanted, F.lit(False)), F.transform(now, lambda x, k: F.when(k == under, with_param(x, "end_timestep", final)).otherwise(x))).otherwise(now)

    return F.when(F.size(steps) > 0, F.aggregate(F.sequence(F.lit(0), F.size(steps) - 1), whole_first, overlay)).otherwise(steps)


# Order and rendering


def ordered(steps: Column) -> Column:
    """Primitive steps: structure, textures, events with a target; then layer, start, priority, overwrites first, id."""
    phase = lambda s: F.when(s["primitive"].isin(*TEXTURES), 1).when(s["primitive"].isin(*EVENTS) & has(s, "target_value"), 2).otherwise(0)
    layer = lambda s: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, LAYER_ORDER)), F.coalesce(s["semantic_layer"], layer_of(s["primitive"]), F.lit("segment_structure"))), F.lit(0)), F.lit(99))
    begin = lambda s: F.coalesce(start_of(s), F.lit(0))
    own = F.filter(steps, is_primitive)
    keys = F.transform(own, lambda s, i: F.struct(phase(s).alias("phase"), layer(s).alias("layer"), begin(s).alias("start"), F.coalesce(s["priority"], i).alias("priority"), F.when(s["effect_type"] == "overwrite", 0).otherwise(1).alias("e"), s["id"].alias("id"), i.alias("i")))
    return F.transform(F.array_sort(keys), lambda k: F.get(own, k["i"]))


def program(steps: Column, length: Column, module: str = PROGRAM_MODULE) -> Column:
    """The ordered steps as program text that imports its primitives from ``module``."""
    order = ordered(steps)
    literal = lambda v: F.when(v.try_cast("double").isNotNull(), v).when(F.lower(v) == "true", "True").when(F.lower(v) == "false", "False").otherwise(F.concat(F.lit("'"), v, F.lit("'")))
    call = lambda s: F.concat(F.lit("series = "), s["primitive"], F.lit("(series, "), F.array_join(F.transform(F.map_entries(s["parameters"]), lambda e: F.concat(e["key"], F.lit("="), literal(e["value"]))), ", "), F.lit(")"))
    used = F.array_distinct(F.transform(order, lambda s: s["primitive"]))
    imports = F.when(F.size(used) > 0, F.array(F.concat(F.lit(f"from {module} import "), F.array_join(used, ", ")))).otherwise(F.array().cast("array<string>"))
    head = F.array(F.lit(""), F.format_string("series = np.zeros(%d, dtype=np.float64)", length), F.lit(""))
    return F.concat(F.array_join(F.concat(F.array(F.lit("import numpy as np")), imports, head, F.transform(order, call)), "\n"), F.lit("\n"))


def affected(step: Column, length: Column) -> Column:
    """First and last timestep that a step touches."""
    name, final = step["primitive"], length - 1
    a, b, at = whole(step, "start_timestep"), F.coalesce(whole(step, "end_timestep"), final), whole(step, "timestep")
    width = F.coalesce(whole(step, "half_width"), whole(step, "width"), F.lit(0))
    pair = lambda x, y: F.struct(x.cast("int").alias("start"), y.cast("int").alias("end"))
    return (
        F.when(has(step, "start_timestep") | (has(step, "end_timestep") & ~name.isin("add_change_point", "add_level_shift")), pair(F.coalesce(a, F.lit(0)), b))
        .when(name.isin("add_change_point", "add_level_shift"), pair(F.coalesce(whole(step, "anchor_timestep"), F.lit(0)), b))
        .when(name == "add_outlier", pair(at, at))
        .when(name.isin("add_spike", "add_dip"), pair(F.greatest(F.lit(0), at - width), F.least(final, at + width)))
        .otherwise(pair(F.lit(0), final))
    )


def rejected(plan: Column) -> Column:
    """Whether a plan declines: by its flag, an unresolved item or an unresolved step."""
    return F.coalesce(plan["needs_library_extension"], F.lit(False)) | (F.coalesce(F.size(plan["unresolved_semantics"]), F.lit(0)) > 0) | F.coalesce(F.exists(plan["steps"], lambda s: s["kind"] == "unresolved"), F.lit(False))


