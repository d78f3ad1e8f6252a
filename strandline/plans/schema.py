"""Payload validation: rules as data, turned into one expression over a parsed JSON value.

A rule is a dict: ``type`` (one or several), ``required``, ``properties``, ``closed``, ``items``, ``least``
(length or items), ``enum``, ``pattern``, ``low``, ``high``, or ``by`` (a property that picks a rule).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.primitives import let

# The payload contracts.
_TEXT, _TEXTS, _NOTE, _FLAG, _NUMBER, _WHOLE = {"type": ["string"], "least": 1}, {"type": ["array"], "items": {"type": ["string"], "least": 1}}, {"type": ["string"]}, {"type": ["boolean"]}, {"type": ["number", "integer"]}, {"type": ["integer"]}
_SHARE, _PLACE = _NUMBER | {"low": 0, "high": 1}, _WHOLE | {"low": 0}


def _object(required: str, closed: bool = True, **properties: dict) -> dict:
    return {"type": ["object"], "required": required.split(), "properties": properties, "closed": closed}


_STATUS = _object("status schema_path target_path errors", status={"type": ["string"], "enum": ["valid", "invalid", "unavailable", "not_run"]}, schema_path=_TEXT, target_path=_TEXT, errors=_TEXTS)
_LAYER = {"type": ["string"], "enum": ["global_scaffold", "segment_structure", "local_event", "texture", "missingness"]}
_PROTECTED = _object("kind", kind={"type": ["string"], "enum": ["constant_segment", "monotone_window", "point_value"]}, start=_PLACE, end=_PLACE, direction={"type": ["string"], "enum": ["nondecreasing", "nonincreasing"]}, timestep=_PLACE, value=_NUMBER, tolerance=_NUMBER | {"low": 0})
_CUE = _object("kind", kind={"type": ["string"], "enum": ["decline", "increase", "plateau", "oscillation", "light_noise"]}, source_text=_TEXT, confidence=_SHARE)
_INFERRED = _object("kind", kind={"type": ["string"], "enum": ["slope_sign", "endpoint_order", "monotonicity"]}, value={"type": ["string"], "enum": ["negative", "positive", "zero", "descending", "ascending", "flat", "nonincreasing", "nondecreasing"]}, source_text=_TEXT, confidence=_SHARE, notes=_NOTE)
_LIST = lambda rule: {"type": ["array"], "items": rule}
_STEP = _object(
    "id kind primitive parameters semantic_role effect_type confidence source_text needs_library_extension", id=_TEXT, kind=_TEXT, primitive={"type": ["string"], "pattern": "^add_[a-z0-9_]+$"}, parameters={"type": ["object"]},
    semantic_role=_TEXT, effect_type={"type": ["string"], "enum": ["overwrite", "additive"]}, confidence=_SHARE, source_text=_TEXT, notes=_NOTE, semantic_layer=_LAYER, priority=_WHOLE, protected_constraints=_LIST(_PROTECTED), semantic_cues=_LIST(_CUE),
    inferred_constraints=_LIST(_INFERRED), depends_on=_TEXTS, needs_library_extension={"type": ["boolean"], "enum": ["false"]})
_OPEN_STEP = _object(
    "id kind description semantic_role confidence source_text reason needs_library_extension", id=_TEXT, kind=_TEXT, description=_TEXT, semantic_role=_TEXT, confidence=_SHARE, source_text=_TEXT, reason=_TEXT, semantic_layer=_LAYER, priority=_WHOLE,
    candidate_compositions_considered=_TEXTS, notes=_NOTE, needs_library_extension={"type": ["boolean"], "enum": ["true"]})
PLAN = _object(
    "version input_description registry_validation global_context steps unresolved_semantics needs_library_extension", version=_TEXT, input_description=_TEXT, registry_validation=_STATUS,
    global_context=_object("length numeric_range", length=_WHOLE | {"low": 2}, numeric_range=_object("min max", min=_NUMBER, max=_NUMBER), dt={"type": ["number", "integer", "null"]}, seed={"type": ["integer", "null"]}, notes=_NOTE),
    steps={"type": ["array"], "least": 1, "items": {"by": ("kind", {"primitive": _STEP, "unresolved": _OPEN_STEP})}}, unresolved_semantics=_LIST(_object("id description source_text reason", id=_TEXT, description=_TEXT, source_text=_TEXT, reason=_TEXT, candidate_compositions_considered=_TEXTS)),
    needs_library_extension=_FLAG, assumptions=_TEXTS, notes=_NOTE)
_RUN = {"type": ["string"], "enum": ["success", "failed", "not_run"]}
EVAL_REPORT = _object(
    "version input_description registry_validation plan_validation_status code_generation_status execution_status semantic_alignment_score unresolved_semantics failure_reasons", version=_TEXT, input_description=_TEXT, registry_validation=_STATUS, plan_validation_status=_STATUS,
    code_generation_status=_object("status draft_generated final_generated errors", status=_RUN, draft_generated=_FLAG, final_generated=_FLAG, artifacts=_TEXTS, errors=_TEXTS),
    execution_status=_object("status errors", status=_RUN, errors=_TEXTS, signal_summary=_object("length", length=_PLACE, min=_NUMBER, max=_NUMBER, mean=_NUMBER, std=_NUMBER)),
    semantic_alignment_score=_object("overall", overall=_SHARE, description_to_plan=_SHARE, plan_to_code=_SHARE, code_to_signal=_SHARE, notes=_NOTE),
    unresolved_semantics=_LIST(_object("id description reason", id=_TEXT, description=_TEXT, reason=_TEXT, related_step_ids=_TEXTS)),
    failure_reasons=_LIST(_object("stage code message", stage={"type": ["string"], "enum": ["registry_validation", "planning", "plan_validation", "code_generation", "execution", "evaluation"]}, code=_TEXT, message=_TEXT, related_step_ids=_TEXTS)), notes=_NOTE)
_MAP = {"type": ["object"]}
PRIMITIVE = _object(
    "name category description args required_args defaults aliases semantic_triggers constraints examples composable_from", name={"type": ["string"], "pattern": "^add_[a-z0-9_]+$"}, category={"type": ["string"], "enum": ["base", "trend", "periodic", "transient", "noise", "shape", "event"]},
    description=_TEXT, args=_MAP, required_args=_TEXTS, defaults=_MAP, aliases=_TEXTS, semantic_triggers=_TEXTS, constraints=_MAP, examples={"type": ["array"], "least": 1, "items": _object("text call", text=_TEXT, call=_TEXT)}, composable_from=_TEXTS)
KINDS = {"plan": PLAN, "eval": EVAL_REPORT, "eval_report": EVAL_REPORT, "primitive": PRIMITIVE, "registry": {"type": ["array"], "least": 1, "items": PRIMITIVE}}


def kind_of(value: Column) -> Column:
    return F.when(value.isNotNull(), let(F.schema_of_variant(value), _kind_named))


def _kind_named(s: Column) -> Column:
    return (
        F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean")
        .when((s == "BIGINT") | s.endswith(",0)"), "integer").when(s == "VOID", "null").otherwise("number")
    )


def violations(value: Column, rule: dict, path: Column) -> Column:
    """``path: problem`` for each rule that a parsed value breaks."""
    none = F.array().cast("array<string>")
    one = lambda bad, text: F.when(bad, F.array(F.concat(path, F.lit(f": {text}")))).otherwise(none)
    if "by" in rule:
        key, rules = rule["by"]
        picked = F.try_variant_get(value, f"$.{key}", "string")
        out = F.when(F.lit(False), none)
        for k, r in rules.items():
            out = out.when(picked == k, violations(value, r, path))
        return out.otherwise(F.array(F.concat(path, F.lit(f": {key} must be one of {', '.join(rules)}"))))
    return let(kind_of(value), lambda kind: _of_kind(value, kind, rule, path))


def _of_kind(value: Column, kind: Column, rule: dict, path: Column) -> Column:
    none = F.array().cast("array<string>")
    one = lambda bad, text: F.when(bad, F.array(F.concat(path, F.lit(f": {text}")))).otherwise(none)
    parts = []
    text, at = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
    if "enum" in rule:
        parts.append(one(~text.isin(*rule["enum"]), "is not allowed"))
    if "pattern" in rule:
        parts.append(one(~F.regexp_like(text, F.lit(rule["pattern"])), "does not match"))
    if "low" in rule:
        parts.append(one(at < rule["low"], f"is under {rule['low']}"))
    if "high" in rule:
        parts.append(one(at > rule["high"], f"is over {rule['high']}"))
    if "items" in rule or "least" in rule:
        items = F.try_variant_get(value, "$", "array<variant>")
        if rule.get("least"):
            parts.append(one(F.when(kind == "array", F.size(items)).otherwise(F.length(text)) < rule["least"], "is empty"))
        if "items" in rule:
            parts.append(F.coalesce(F.flatten(F.transform(items, lambda x, i: violations(x, rule["items"], F.concat(path, F.lit("/"), i.cast("string"))))), none))
    if "properties" in rule:
        keys = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
        missing = F.filter(F.array(*map(F.lit, rule["required"])), lambda k: ~F.array_contains(keys, k))
        parts.append(F.transform(missing, lambda k: F.concat(path, F.lit(": misses "), k)))
        if rule["closed"]:
            extra = F.array_except(keys, F.array(*map(F.lit, rule["properties"])))
            parts.append(F.transform(F.array_sort(extra), lambda k: F.concat(path, F.lit(": does not know "), k)))
        for k, r in rule["properties"].items():
            parts.append(_below(value, k, r, path))
    wrong = one(~kind.isin(*rule["type"]), f"must be {' or '.join(rule['type'])}")
    return F.when(kind.isin(*rule["type"]), F.concat(none, *[F.coalesce(p, none) for p in parts])).otherwise(F.coalesce(wrong, none))


def _below(value: Column, key: str, rule: dict, path: Column) -> Column:
    """Violations of a property; its value is bound once, or it would double with each level of rules."""
    none = F.array().cast("array<string>")
    return let(F.try_variant_get(value, f"$.{key}", "variant"), lambda v: F.when(v.isNotNull(), violations(v, rule, F.concat(path, F.lit(f"/{key}")))).otherwise(none))


def validate(kind: str, text: Column) -> Column:
    """``struct<status, errors>`` of a payload's text; what is no JSON is invalid."""
    value = F.try_parse_json(text)
    errors = F.when(value.isNull(), F.array(F.lit("$: is not JSON"))).otherwise(F.array_sort(violations(value, KINDS[kind], F.lit("$"))))
    return F.struct(F.when(F.size(errors) == 0, "valid").otherwise("invalid").alias("status"), errors.alias("errors"))
