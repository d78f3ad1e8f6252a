"""Caption and series consistency: claims that a text makes about a series, and their scores.

All is one narrow stage: text patterns give anchors, array functions give the numbers at these anchors,
and a case's claims are an array. Patterns are one text for both engines (no look-around).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import primitives as P
from ..sources.series import SERIES_SQL, rounded, rounded_sql, user_series

# The patterns and word lists that define the claims.
NUMBER = r"[-+]?\d+(?:\.\d+)?"
UNIT = r"(?:time\s*step|timestep|data\s*points?|observations?|points?)"
UNIT_FIRST = rf"(?i)\b({UNIT})\s+({NUMBER})(?:st|nd|rd|th)?\b"
_PEAK = r"(?:peak(?:s|ed|ing)?|maximum|local maximum|reaches?\s+a\s+peak|reaching\s+a\s+peak)"
_TROUGH = r"(?:trough(?:s|ed|ing)?|minimum|local minimum|low)"
_VALUED = rf"[^.,;]*?\b(?:of|at|to|near|around|value\s*(?:of)?|with\s+value)\s+({NUMBER})[^.,;]*?\b(at|near|around|by)\s+(?:the\s+)?({NUMBER})(?:st|nd|rd|th)?(?:\s*({UNIT}))?"
_TIMED = rf"(?:\s+is\s+observed|\s+observed|\s+occurs)?[^.]*?\b(?:at|near|around)\s+timestep\s+({NUMBER})(?:[^.]*?\b(?:value\s*(?:of)?|with\s+value)\s*({NUMBER}))?"
_PLACED = rf"[^.]*?\b(?:at|near|around|by)\s+(?:the\s+)?({NUMBER})(?:st|nd|rd|th)?\s*({UNIT})"
EVENTS = {
    "peak": [rf"(?i)\b{_PEAK}{_VALUED}", rf"(?i)\b(?:peak|maximum|local maximum){_TIMED}", rf"(?i)\b{_PEAK}{_PLACED}"],
    "trough": [rf"(?i)\b{_TROUGH}{_VALUED}", rf"(?i)\b(?:trough|minimum|local minimum|low){_TIMED}", rf"(?i)\b{_TROUGH}{_PLACED}"],
}
#: ``(0, 100)`` and ``(0, 80)`` are literal text here: the pattern that is in effect, which only adjacent
#: wording meets. ``spread=True`` in the builders asks for the wider distance that was meant.
MOVES = r"(?i)\b(?:declin\w*|decreas\w*|drop\w*|fall\w*|rise\w*|increas\w*|recover\w*|climb\w*)[^.]{gap}\bto\s+({number})\s+by\s+(?:the\s+)?({number})(?:st|nd|rd|th)?\s*({unit})"
VALUES = r"(?i)\b(?:value|level|reading|starts?\s+(?:at|from)|begins?\s+(?:at|from)|high\s+point\s+of|low\s+of)\s+({number})[^.]{gap}\b(?:at|near|around|by)\s+(?:the\s+)?({number})(?:st|nd|rd|th)?\s*({unit})"
PLACES = r"(?i)\b(?:at|by)\s+(?:the\s+)?({number})(?:st|nd|rd|th)?\s*({unit})[^.]{gap}\b(?:value|level|reading)\s+(?:of\s+)?({number})"
RANGE = rf"(?i)\bbetween\s+({NUMBER})\s+and\s+({NUMBER})\s+from\s+(?:the\s+)?({NUMBER})(?:st|nd|rd|th)?\s+to\s+(?:the\s+)?({NUMBER})(?:st|nd|rd|th)?\s*({UNIT})"
SEGMENT = r"(?i)(from timestep\s+(\d+)\s+to\s+(\d+)[^.]{0,80})"
CHANGE = r"(?i)(?:after|at|from)\s+timestep\s+(\d+)[^.]{0,60}\b(?:shift|jump|change|break|plateau|stabiliz|climb|declin|drop|rise)"
UP = ["upward trend", "upward", "increase", "increasing", "climb", "rises"]
DOWN = ["downward trend", "downward", "decline", "decrease", "fall", "drops"]
FLAT = [r"\b(?:overall|generally|mostly|relatively)?\s*(?:flat|constant|stable trajectory|stable profile)\b", r"\bremains?\s+(?:flat|constant|stable|fixed)\b", "no discernible trend"]
WEAK = r"\b(?:general|overall|gradual|slight|minor|modest|steady|consistent)\b"
STRONG = r"\b(?:strong|significant|pronounced|prominent|sharp|clear|robust)\b"
MINOR = [r"\b(?:minor|small|slight|mild|modest|limited)\s+fluctuat", r"\bfluctuat\w*\s+(?:slightly|mildly|modestly)\b"]
LOW = ["low volatility", "very low volatility", "minimal deviation", "smooth", "stable trajectory", "non-existent"]
MODERATE = ["moderate volatility", "moderately volatile"]
MODERATE_RE = r"\bmoderate\w*\s+fluctuat"
HIGH = ["high volatility", "noticeable volatility", "volatile", "noisy"]
HIGH_RE = r"\b(?:high|large|wide|strong|substantial|significant|noticeable)\s+fluctuat"
SEGMENT_DOWN = ["down", "declin", "fall", "drop"]
SEGMENT_UP = ["up", "rise", "increase", "climb"]
SEGMENT_FLAT = ["flat", "stable", "constant", "plateau"]


def _gap(pattern: str, limit: int, spread: bool) -> str:
    return pattern.replace("{gap}", "{0,%d}?" % limit if spread else f"(?:0, {limit})?").replace("{number}", NUMBER).replace("{unit}", UNIT)


def anchored(spread: bool = False) -> list[tuple[str, str, tuple[int, int, int]]]:
    """Kind, pattern and the groups of value, position and unit of explicit point values."""
    return [
        ("peak", EVENTS["peak"][0], (1, 3, 4)),
        ("trough", EVENTS["trough"][0], (1, 3, 4)),
        ("movement_endpoint", _gap(MOVES, 100, spread), (1, 2, 3)),
        ("point_value", _gap(VALUES, 80, spread), (1, 2, 3)),
        ("point_value", _gap(PLACES, 80, spread), (3, 1, 2)),
    ]


CLAIM = "struct<name:string,score:double,confidence:double,supported:boolean,contradicted:boolean,unverifiable:boolean>"


def clip(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def claim(name: Column | str, score: Column, confidence: float, support: Column | float = 0.7, contradict: float = 0.35) -> Column:
    s = clip(score)
    return F.struct((F.lit(name) if isinstance(name, str) else name).alias("name"), s.alias("score"), F.lit(confidence).alias("confidence"), (s >= support).alias("supported"), (s <= contradict).alias("contradicted"), F.lit(False).alias("unverifiable"))


def scale(s: Column) -> Column:
    return F.greatest(F.array_max(s) - F.array_min(s), F.abs(P.mean(s)), F.lit(1.0))


def slope(s: Column) -> Column:
    """Least squares of degree one over the indices."""
    n = F.size(s)
    middle = (n - 1) / 2.0
    top = P.let(P.mean(s), lambda m: F.aggregate(F.transform(s, lambda v, i: (v - m) * (i - middle)), F.lit(0.0), lambda a, x: a + x))
    return top / F.greatest(n * (n * n - 1) / 12.0, F.lit(1e-12))


def mean_step(s: Column) -> Column:
    """Mean absolute difference of neighbours."""
    n = F.size(s)
    return P.mean(F.zip_with(F.slice(s, 2, n - 1), F.slice(s, 1, n - 1), lambda x, y: F.abs(x - y)))


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def _regex(text: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | F.regexp_like(text, F.lit(p))
    return out


def _groups(text: Column, pattern: str, groups: tuple[int, ...]) -> Column:
    """One array of strings for each match: its groups."""
    parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in groups]
    return F.transform(parts[0], lambda x, i: F.array(*[F.get(p, i) for p in parts]))


def units_last(text: Column) -> Column:
    return F.regexp_replace(text, UNIT_FIRST, "$2 $1")


def position(raw: Column, unit: Column, n: Column) -> Column:
    """Points, data points and observations count from 1, timesteps from 0; clamped to the series."""
    u = F.replace(F.lower(F.coalesce(unit, F.lit(""))), F.lit(" "), F.lit(""))
    one_based = u.contains("datapoint") | u.contains("observation") | u.isin("point", "points")
    at = F.bround(raw.try_cast("double")).cast("int") - F.when(one_based, 1).otherwise(0)
    return F.greatest(F.lit(0), F.least(n - 1, at))


def trend_claim(text: Column, s: Column) -> Column:
    low, change, size = F.lower(text), F.element_at(s, -1) - F.element_at(s, 1), scale(s)
    strength, m = F.abs(change) / size, slope(s)
    up, down = _any(low, UP), _any(low, DOWN)
    threshold = F.when(_regex(low, [STRONG]) & ~_regex(low, [WEAK]), 0.7).otherwise(0.6)
    agrees = 0.6 + 0.4 * F.least(F.lit(1.0), strength / 0.2)
    return (
        F.when(up & ~down, claim("overall_trend_up", F.when((m > 0) | (change > 0), agrees).otherwise(0.15), 0.85, threshold))
        .when(down & ~up, claim("overall_trend_down", F.when((m < 0) | (change < 0), agrees).otherwise(0.15), 0.85, threshold))
        .when(_regex(low, FLAT), claim("overall_trend_flat_or_stable", 1 - F.least(F.lit(1.0), strength / 0.08), 0.75))
    )


def volatility_claim(text: Column, s: Column) -> Column:
    low, size = F.lower(text), scale(s)
    spread, step = P.stddev(s) / size, mean_step(s) / size
    one = lambda x: F.least(F.lit(1.0), x)
    high = _any(low, HIGH) | _regex(low, [HIGH_RE])
    return (
        F.when(_regex(low, MINOR) & ~high, claim("fluctuation_minor", 0.8 * (1 - one(spread / 0.08)) + 0.2 * one(step / 0.006), 0.6, 0.6, 0.25))
        .when(_any(low, LOW) & ~high, claim("volatility_low", 1 - one(spread / 0.03), 0.7))
        .when((_any(low, MODERATE) | _regex(low, [MODERATE_RE])) & ~high, claim("volatility_moderate", 1 - one(F.abs(spread - 0.04) / 0.04), 0.6))
        .when(high, claim("volatility_high", one(spread / 0.05), 0.7))
        .when(low.contains("fluctuat"), claim("fluctuation_present", one(F.greatest(spread / 0.015, step / 0.006)), 0.55, 0.55, 0.2))
    )


def change_strengths(s: Column, width: Column) -> Column:
    """For each index with room on both sides: (strength, -index) of the shift of means."""
    n = F.size(s)
    inner = F.when(n - width > width, F.sequence(width, n - width - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(inner, lambda i: F.struct(F.abs(P.mean(F.slice(s, i + 1, width)) - P.mean(F.slice(s, i - width + 1, width))).alias("strength"), (-i).alias("minus")))


def change_point(s: Column, width: Column) -> Column:
    """(strength, -index) of the largest shift; the first wins, and no shift is index 0."""
    best = F.array_max(F.filter(change_strengths(s, width), lambda x: x["strength"] > 0))
    return F.coalesce(best, F.struct(F.lit(0.0).alias("strength"), F.lit(0).alias("minus")))


def change_claim(text: Column, s: Column) -> Column:
    n, size = F.size(s), scale(s)
    width = F.greatest(F.lit(5), F.floor(n / 10).cast("int"))
    best = change_point(s, width)
    stated = F.transform(F.regexp_extract_all(text, F.lit(CHANGE), F.lit(1)), lambda x: x.try_cast("int"))

    def score(p: Column) -> Column:
        left, right = F.slice(s, p - width + 1, width), F.slice(s, p + 1, width)
        shift = F.abs(P.mean(right) - P.mean(left)) / size
        bend = F.abs(slope(right) - slope(left)) * n / size
        near = F.greatest(F.lit(0.0), 1 - F.abs(-best["minus"] - p) / (2.0 * width))
        return 0.45 * F.least(F.lit(1.0), shift / 0.08) + 0.35 * F.least(F.lit(1.0), bend / 0.4) + 0.20 * near

    scores = F.transform(F.filter(stated, lambda p: (p >= width) & (p < n - width)), score)
    total = F.coalesce(F.array_max(scores), F.least(F.lit(1.0), best["strength"] / size / 0.1))
    return F.when(F.size(stated) > 0, claim("change_point_alignment", total, 0.8))


def point_claims(text: Column, s: Column, spread: bool = False) -> Column:
    plain, n = units_last(text), F.size(s)

    def anchors(kind: str, pattern: str, v: int, p: int, u: int) -> Column:
        event = kind in ("peak", "trough")
        got = _groups(plain, pattern, (v, p, u, 2) if event else (v, p, u))
        if event:  # without a unit, only "at" and "by" place a value
            got = F.filter(got, lambda g: (g[2] != "") | F.lower(g[3]).isin("at", "by"))
        unit = lambda g: F.when(g[2] != "", g[2]).otherwise("point" if event else "")
        return F.array_distinct(F.transform(got, lambda g: F.struct(position(g[1], unit(g), n).alias("index"), g[0].cast("double").alias("value"))))

    found = [anchors(kind, pattern, *groups) for kind, pattern, groups in anchored(spread)]
    tolerance = F.greatest(0.05 * scale(s), F.lit(0.25))
    return F.transform(F.concat(*found), lambda x: claim(F.concat(F.lit("point_value_"), x["index"].cast("string")), 1 - F.abs(F.get(s, x["index"]) - x["value"]) / tolerance, 0.95, 0.75, 0.4))


def range_claims(text: Column, s: Column) -> Column:
    n, size = F.size(s), scale(s)
    got = _groups(units_last(text), RANGE, (1, 2, 3, 4, 5))

    def one(g: Column) -> Column:
        i, j = position(g[2], g[4], n), position(g[3], g[4], n)
        a, b = F.least(i, j), F.greatest(i, j)
        low, high = F.least(g[0].cast("double"), g[1].cast("double")), F.greatest(g[0].cast("double"), g[1].cast("double"))
        tolerance = F.greatest(0.02 * size, F.lit(0.1))
        out = F.transform(P.window(s, a, b), lambda v: F.greatest(low - v, v - high, F.lit(0.0)))
        score = 0.65 * P.mean(F.transform(out, lambda x: F.when(x <= tolerance, 1.0).otherwise(0.0))) + 0.35 * F.greatest(F.lit(0.0), 1 - F.array_max(out) / tolerance)
        return claim(F.concat_ws("_", F.lit("range_bounds"), a.cast("string"), b.cast("string")), score, 0.9, 0.75, 0.4)

    return F.transform(got, one)


def segment_claims(text: Column, s: Column) -> Column:
    n, size = F.size(s), scale(s)
    got = F.filter(_groups(text, SEGMENT, (1, 2, 3)), lambda g: (g[1].cast("int") < g[2].cast("int")) & (g[2].cast("int") < n))

    def one(g: Column) -> Column:
        words = F.lower(g[0])
        change = F.get(s, g[2].cast("int")) - F.get(s, g[1].cast("int"))
        strength = F.abs(change) / size
        agrees = 0.6 + 0.4 * F.least(F.lit(1.0), strength / 0.08)
        name = lambda k: F.concat_ws("_", F.lit(k), g[1].cast("int").cast("string"), g[2].cast("int").cast("string"))
        return (
            F.when(_any(words, SEGMENT_DOWN), claim(name("segment_down"), F.when(change < 0, agrees).otherwise(0.15), 0.8))
            .when(_any(words, SEGMENT_UP), claim(name("segment_up"), F.when(change > 0, agrees).otherwise(0.15), 0.8))
            .when(_any(words, SEGMENT_FLAT), claim(name("segment_flat"), 1 - F.least(F.lit(1.0), strength / 0.04), 0.7))
        )

    return F.filter(F.transform(got, one), lambda c: c.isNotNull())


def event_anchors(text: Column, n: Column, kind: str) -> Column:
    """Distinct (index, value or null) of stated peaks or troughs, in order of the patterns."""
    plain = units_last(text)
    valued, timed, placed = EVENTS[kind]
    anchor = lambda i, v: F.struct(i.alias("index"), v.alias("value"))
    # without a unit, "at" and "by" place a value, counted from 1; a match that says "timestep" counts from 0
    says = lambda g: F.lower(g[4]).contains("timestep")
    first = F.filter(_groups(plain, valued, (1, 3, 4, 2, 0)), lambda g: (g[2] != "") | says(g) | F.lower(g[3]).isin("at", "by"))
    first = F.transform(first, lambda g: anchor(position(g[1], F.when(g[2] != "", g[2]).when(says(g), "timestep").otherwise("point"), n), g[0].cast("double")))
    second = F.transform(_groups(plain, timed, (1, 2)), lambda g: anchor(position(g[0], F.lit("timestep"), n), F.when(F.coalesce(g[1], F.lit("")) != "", g[1]).try_cast("double")))
    third = F.transform(_groups(plain, placed, (1, 2)), lambda g: anchor(position(g[0], g[1], n), F.lit(None).cast("double")))
    return F.array_distinct(F.concat(first, second, third))


def event_claims(text: Column, s: Column) -> Column:
    n, size = F.size(s), scale(s)

    def aligned(kind: str, best: Column) -> Column:
        at = F.array_position(s, best).cast("int") - 1
        time = lambda a: F.greatest(F.lit(0.0), 1 - F.abs(at - a["index"]) / 12.0)
        value = lambda a: F.when(a["value"].isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(best - a["value"]) / F.greatest(0.05 * size, F.lit(0.5))))
        return F.transform(event_anchors(text, n, kind), lambda a: claim(f"{kind}_alignment", 0.55 * time(a) + 0.45 * value(a), 0.9))

    return F.concat(aligned("peak", F.array_max(s)), aligned("trough", F.array_min(s)))


def claims(text: Column, s: Column, spread: bool = False) -> Column:
    """All claims in their fixed order; one that cannot be verified where there are none."""
    lone = F.filter(F.array(trend_claim(text, s), volatility_claim(text, s), change_claim(text, s)), lambda c: c.isNotNull())
    found = F.concat(lone, point_claims(text, s, spread), range_claims(text, s), segment_claims(text, s), event_claims(text, s))
    nothing = F.struct(F.lit("no_extractable_claims").alias("name"), F.lit(0.5).alias("score"), F.lit(0.25).alias("confidence"), F.lit(False).alias("supported"), F.lit(False).alias("contradicted"), F.lit(True).alias("unverifiable"))
    return F.when(F.size(found) > 0, found).otherwise(F.array(nothing))


def weight(c: Column) -> Column:
    name = c["name"]
    exact = name.startswith("point_value") | name.startswith("range_bounds") | name.startswith("peak_alignment") | name.startswith("trough_alignment")
    some = name.startswith("change_point") | name.startswith("segment_")
    return F.when(c["unverifiable"], 0.0).otherwise(F.greatest(F.lit(0.05), c["confidence"] * F.when(exact, 1.25).when(some, 1.15).otherwise(1.0)))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def correctness(found: Column) -> Column:
    usable = F.filter(found, lambda c: ~c["unverifiable"])
    total = F.greatest(_sum(F.transform(usable, weight)), F.lit(1e-12))
    mean = _sum(F.transform(usable, lambda c: weight(c) * c["score"])) / total
    wrong = _sum(F.transform(F.filter(usable, lambda c: c["contradicted"]), weight)) / total
    severe = _sum(F.transform(F.filter(usable, lambda c: c["score"] <= 0.2), weight)) / total
    return F.when(F.size(usable) == 0, 0.5).otherwise(clip(mean - 0.20 * wrong - 0.10 * severe))


def verdict(found: Column, correct: Column) -> Column:
    usable = F.filter(found, lambda c: ~c["unverifiable"])
    supported = F.size(F.filter(usable, lambda c: c["supported"]))
    contradicted = F.exists(usable, lambda c: c["contradicted"])
    return (
        F.when((F.size(usable) > 0) & ~contradicted & (supported == F.size(usable)), "consistent")
        .when(contradicted & (correct < 0.6), "inconsistent")
        .when((supported > 0) | (correct >= 0.6), "partially_consistent")
        .otherwise("inconsistent")
    )


def evaluate(cases: DataFrame, text: str = "caption", values: str = "values", spread: bool = False) -> DataFrame:
    """Adds ``claims``, scores and verdict; a series under 8 points or with gaps gets ``error`` instead."""
    s = F.col(values)
    bad = F.when(F.size(s) < 8, "series_too_short").when(F.size(P.finite(s)) < F.size(s), "series_not_finite")
    rows = cases.withColumn("error", bad).withColumn("claims", F.when(bad.isNull(), claims(F.col(text), s, spread)))
    usable = F.filter("claims", lambda c: ~c["unverifiable"])
    k = F.size(usable)
    strength = P.mean(F.transform(usable, lambda c: F.abs(c["score"] - 0.5) * 2.0))
    rows = rows.withColumns({
        "consistency_score": F.when(k == 0, 0.5).otherwise(clip(P.mean(F.transform(usable, lambda c: c["score"])))),
        "confidence_score": F.when(k == 0, 0.25).otherwise(clip(0.35 + 0.35 * F.least(F.lit(1.0), k / 4.0) + 0.30 * strength)),
        "correctness_score": correctness(F.col("claims")),
        "verifiable": k,
        "contradicted_rate": F.when(k == 0, 0.0).otherwise(F.size(F.filter(usable, lambda c: c["contradicted"])) / F.greatest(k, F.lit(1))),
    })
    return rows.withColumn("verdict", verdict(F.col("claims"), F.col("correctness_score")))


#: Captions for the users' series, by user_id modulo their number.
CAPTIONS = [
    "The series shows a clear upward trend with high volatility.",
    "A gradual decline is visible; minor fluctuations remain.",
    "The series remains flat with very low volatility and minimal deviation.",
    "After timestep 20 a shift in level is visible.",
    "It peaks at 170.5 at the 12th data point and falls to 30.25 by the 25 data points.",
    "The value 55.0 at timestep 8 is followed by a trough of 2.0 at timestep 30.",
    "Values stay between 10.0 and 90.0 from the 4.0 to 16.0 data points.",
    "From timestep 5 to 15 the series climbs, from timestep 20 to 30 it drops.",
    "Nothing measurable is said.",
    "The maximum is observed near timestep 33 with value 188.8, and data point 4 has a reading of 12.5.",
    "Fluctuating values with moderate fluctuations and an increase.",
    "From timestep 10 to 40 the profile is stable and generally flat.",
]


def captioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    caption = F.element_at(F.array(*[F.lit(c) for c in CAPTIONS]), (F.col("user_id") % len(CAPTIONS) + 1).cast("int"))
    return user_series(spark, sf_dir).withColumn("caption", caption)


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _any_sql(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(low, {_q(w)})" for w in words) + ")"


def _regex_sql(patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches(low, {_q(p)})" for p in patterns) + ")"


def _at_sql(raw: str, unit: str) -> str:
    u = f"replace(lower({unit}), ' ', '')"
    return f"greatest(0, least(n - 1, round_even({raw}::DOUBLE, 0)::INT - CASE WHEN contains({u}, 'datapoint') OR contains({u}, 'observation') OR {u} IN ('point', 'points') THEN 1 ELSE 0 END))::INT"


def _matches_sql(pattern: str, groups: tuple[int, ...], source: str = "plain") -> str:
    return ", ".join(f"unnest(regexp_extract_all({source}, {_q(pattern)}, {g})) AS g{k}" for k, g in enumerate(groups))


_CASES_SQL = f"""{SERIES_SQL}, c AS (SELECT *, list_sum(list_transform(s, lambda v, i: (v - m) * (i - 1 - (n - 1) / 2.0::DOUBLE))) / (n * (n * n - 1) / 12.0::DOUBLE) AS slope, s[n] - s[1] AS delta
 FROM (SELECT *, lower(caption) AS low, regexp_replace(caption, {_q(UNIT_FIRST)}, '\\2 \\1', 'g') AS plain, list_avg(s) AS m, list_max(s) AS hi, list_min(s) AS lo, greatest(list_max(s) - list_min(s), abs(list_avg(s)), 1.0::DOUBLE) AS size
 FROM (SELECT *, list_value({", ".join(map(_q, CAPTIONS))})[user_id % {len(CAPTIONS)} + 1] AS caption FROM s)))"""


def _claim_sql(name: str, score: str, confidence: float, support: str = "0.7", contradict: float = 0.35) -> str:
    bounded = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {score}))"
    return f"{{'name': {name}, 'score': {bounded}, 'confidence': {confidence}::DOUBLE, 'supported': {bounded} >= {support}::DOUBLE, 'contradicted': {bounded} <= {contradict}::DOUBLE}}"


_AGREES = "0.6::DOUBLE + 0.4::DOUBLE * least(1.0::DOUBLE, abs({d}) / size / {by}::DOUBLE)"
_TREND_SQL = f"""SELECT user_id, 1 AS o, CASE
 WHEN {_any_sql(UP)} AND NOT {_any_sql(DOWN)} THEN {_claim_sql("'overall_trend_up'", "CASE WHEN slope > 0 OR delta > 0 THEN " + _AGREES.format(d="delta", by=0.2) + " ELSE 0.15::DOUBLE END", 0.85, "(CASE WHEN " + _regex_sql([STRONG]) + " AND NOT " + _regex_sql([WEAK]) + " THEN 0.7 ELSE 0.6 END)")}
 WHEN {_any_sql(DOWN)} AND NOT {_any_sql(UP)} THEN {_claim_sql("'overall_trend_down'", "CASE WHEN slope < 0 OR delta < 0 THEN " + _AGREES.format(d="delta", by=0.2) + " ELSE 0.15::DOUBLE END", 0.85, "(CASE WHEN " + _regex_sql([STRONG]) + " AND NOT " + _regex_sql([WEAK]) + " THEN 0.7 ELSE 0.6 END)")}
 WHEN {_regex_sql(FLAT)} THEN {_claim_sql("'overall_trend_flat_or_stable'", "1 - least(1.0::DOUBLE, abs(delta) / size / 0.08::DOUBLE)", 0.75)} END AS c FROM c"""
_HIGH_SQL = f"({_any_sql(HIGH)} OR {_regex_sql([HIGH_RE])})"
_VOLATILITY_SQL = f"""SELECT user_id, 2 AS o, CASE
 WHEN {_regex_sql(MINOR)} AND NOT {_HIGH_SQL} THEN {_claim_sql("'fluctuation_minor'", "0.8::DOUBLE * (1 - least(1.0::DOUBLE, spread / 0.08::DOUBLE)) + 0.2::DOUBLE * least(1.0::DOUBLE, step / 0.006::DOUBLE)", 0.6, "0.6", 0.25)}
 WHEN {_any_sql(LOW)} AND NOT {_HIGH_SQL} THEN {_claim_sql("'volatility_low'", "1 - least(1.0::DOUBLE, spread / 0.03::DOUBLE)", 0.7)}
 WHEN ({_any_sql(MODERATE)} OR {_regex_sql([MODERATE_RE])}) AND NOT {_HIGH_SQL} THEN {_claim_sql("'volatility_moderate'", "1 - least(1.0::DOUBLE, abs(spread - 0.04::DOUBLE) / 0.04::DOUBLE)", 0.6)}
 WHEN {_HIGH_SQL} THEN {_claim_sql("'volatility_high'", "least(1.0::DOUBLE, spread / 0.05::DOUBLE)", 0.7)}
 WHEN contains(low, 'fluctuat') THEN {_claim_sql("'fluctuation_present'", "least(1.0::DOUBLE, greatest(spread / 0.015::DOUBLE, step / 0.006::DOUBLE))", 0.55, "0.55", 0.2)} END AS c
 FROM (SELECT *, sqrt(list_avg(list_transform(s, lambda v: (v - m) * (v - m)))) / size AS spread, list_avg(list_transform(range(1, n), lambda i: abs(s[i + 1] - s[i]))) / size AS step FROM c)"""
_SLOPE_SQL = "(list_sum(list_transform({x}, lambda v, i: (v - list_avg({x})) * (i - 1 - (w - 1) / 2.0::DOUBLE))) / (w * (w * w - 1) / 12.0::DOUBLE))"
_CHANGE_SQL = f"""SELECT user_id, 3 AS o, CASE WHEN any_value(points) > 0 THEN {_claim_sql("'change_point_alignment'", "coalesce(max(score), least(1.0::DOUBLE, any_value(best.strength) / any_value(size) / 0.1::DOUBLE))", 0.8)} END AS c FROM (
 SELECT user_id, points, best, size, CASE WHEN p >= w AND p < n - w THEN 0.45::DOUBLE * least(1.0::DOUBLE, abs(list_avg(r) - list_avg(l)) / size / 0.08::DOUBLE)
  + 0.35::DOUBLE * least(1.0::DOUBLE, abs({_SLOPE_SQL.format(x="r")} - {_SLOPE_SQL.format(x="l")}) * n / size / 0.4::DOUBLE) + 0.20::DOUBLE * greatest(0.0::DOUBLE, 1 - abs(best.i - p) / (2.0::DOUBLE * w)) END AS score
 FROM (SELECT *, s[p - w + 1:p] AS l, s[p + 1:p + w] AS r FROM (SELECT *, len(stated) AS points, unnest(CASE WHEN len(stated) = 0 THEN [-1] ELSE stated END) AS p FROM (
  SELECT *, list_transform(regexp_extract_all(caption, {_q(CHANGE)}, 1), lambda x: x::INT) AS stated, coalesce(list_reduce(list_filter(list_transform(range(w, n - w), lambda i: {{'i': i, 'strength': abs(list_avg(s[i + 1:i + w]) - list_avg(s[i - w + 1:i]))}}), lambda z: z.strength > 0), lambda a, b: CASE WHEN b.strength > a.strength THEN b ELSE a END), {{'i': 0, 'strength': 0.0::DOUBLE}}) AS best
  FROM (SELECT *, greatest(5, n // 10)::BIGINT AS w FROM c))))) GROUP BY user_id"""


def _point_sql() -> str:
    parts = []
    for k, (kind, pattern, (v, p, u)) in enumerate(anchored()):
        event = kind in ("peak", "trough")
        got = f"SELECT user_id, s, n, size, {_matches_sql(pattern, (v, p, u, 2) if event else (v, p, u))} FROM c"
        unit = f"CASE WHEN g2 <> '' THEN g2 ELSE '{'point' if event else ''}' END"
        where = "WHERE g2 <> '' OR lower(g3) IN ('at', 'by')" if event else ""
        parts.append(f"SELECT DISTINCT user_id, s, size, {k} AS k, {_at_sql('g1', unit)} AS i, g0::DOUBLE AS x FROM ({got}) {where}")
    return f"""SELECT user_id, 4 AS o, {_claim_sql("'point_value_' || i", "1 - abs(s[i + 1] - x) / greatest(0.05::DOUBLE * size, 0.25::DOUBLE)", 0.95, "0.75", 0.4)} AS c FROM ({" UNION ALL ".join(parts)})"""


_RANGE_SQL = f"""SELECT user_id, 5 AS o, {_claim_sql("'range_bounds_' || a || '_' || b", "0.65::DOUBLE * list_avg(list_transform(o, lambda x: CASE WHEN x <= tol THEN 1.0::DOUBLE ELSE 0 END)) + 0.35::DOUBLE * greatest(0.0::DOUBLE, 1 - list_max(o) / tol)", 0.9, "0.75", 0.4)} AS c
 FROM (SELECT *, list_transform(s[a + 1:b + 1], lambda v: greatest(lo2 - v, v - hi2, 0.0::DOUBLE)) AS o FROM (SELECT user_id, s, greatest(0.02::DOUBLE * size, 0.1::DOUBLE) AS tol, least(i, j) AS a, greatest(i, j) AS b, least(g0::DOUBLE, g1::DOUBLE) AS lo2, greatest(g0::DOUBLE, g1::DOUBLE) AS hi2
 FROM (SELECT *, {_at_sql("g2", "g4")} AS i, {_at_sql("g3", "g4")} AS j FROM (SELECT user_id, s, n, size, {_matches_sql(RANGE, (1, 2, 3, 4, 5))} FROM c))))"""


def _segment_words(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(g0), {_q(w)})" for w in words) + ")"


_SEGMENT_SQL = f"""SELECT user_id, 6 AS o, CASE
 WHEN {_segment_words(SEGMENT_DOWN)} THEN {_claim_sql("'segment_down_' || a || '_' || b", "CASE WHEN d < 0 THEN " + _AGREES.format(d="d", by=0.08) + " ELSE 0.15::DOUBLE END", 0.8)}
 WHEN {_segment_words(SEGMENT_UP)} THEN {_claim_sql("'segment_up_' || a || '_' || b", "CASE WHEN d > 0 THEN " + _AGREES.format(d="d", by=0.08) + " ELSE 0.15::DOUBLE END", 0.8)}
 WHEN {_segment_words(SEGMENT_FLAT)} THEN {_claim_sql("'segment_flat_' || a || '_' || b", "1 - least(1.0::DOUBLE, abs(d) / size / 0.04::DOUBLE)", 0.7)} END AS c
 FROM (SELECT *, g1::INT AS a, g2::INT AS b, s[g2::INT + 1] - s[g1::INT + 1] AS d FROM (SELECT user_id, s, n, size, {_matches_sql(SEGMENT, (1, 2, 3), "caption")} FROM c) WHERE g1::INT < g2::INT AND g2::INT < n)"""


def _event_sql(kind: str) -> str:
    valued, timed, placed = EVENTS[kind]
    says = "contains(lower(g4), 'timestep')"
    first = f"SELECT user_id, {_at_sql('g1', 'CASE WHEN g2 <> $$$$ THEN g2 WHEN ' + says + ' THEN $$timestep$$ ELSE $$point$$ END')} AS i, g0::DOUBLE AS x FROM (SELECT user_id, n, {_matches_sql(valued, (1, 3, 4, 2, 0))} FROM c) WHERE g2 <> '' OR {says} OR lower(g3) IN ('at', 'by')"
    second = f"SELECT user_id, {_at_sql('g0', '$$timestep$$')} AS i, CASE WHEN g1 <> '' THEN g1 END::DOUBLE AS x FROM (SELECT user_id, n, {_matches_sql(timed, (1, 2))} FROM c)"
    third = f"SELECT user_id, {_at_sql('g0', 'g1')} AS i, NULL::DOUBLE AS x FROM (SELECT user_id, n, {_matches_sql(placed, (1, 2))} FROM c)"
    best = "hi" if kind == "peak" else "lo"
    score = f"0.55::DOUBLE * greatest(0.0::DOUBLE, 1 - abs(list_position(s, {best}) - 1 - i) / 12.0::DOUBLE) + 0.45::DOUBLE * CASE WHEN x IS NULL THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - abs({best} - x) / greatest(0.05::DOUBLE * size, 0.5::DOUBLE)) END"
    return f"SELECT user_id, {7 if kind == 'peak' else 8} AS o, {_claim_sql(_q(kind + '_alignment'), score, 0.9)} AS c FROM (SELECT DISTINCT user_id, i, x FROM ({first} UNION ALL {second} UNION ALL {third})) JOIN c USING (user_id)"


_PARTS_SQL = {"c01_trend": _TREND_SQL, "c02_volatility": _VOLATILITY_SQL, "c03_change_point": _CHANGE_SQL, "c08_point_values": _point_sql(), "c09_range_bounds": _RANGE_SQL, "c10_segments": _SEGMENT_SQL, "c05_peaks_troughs": f"{_event_sql('peak')} UNION ALL {_event_sql('trough')}"}
_OUT_SQL = f"SELECT user_id, c.name AS name, {rounded_sql('c.score')} AS score, c.confidence AS confidence, c.supported AS supported, c.contradicted AS contradicted FROM x WHERE c IS NOT NULL"
_BUILDERS = {
    "c01_trend": lambda t, s: F.array(trend_claim(t, s)), "c02_volatility": lambda t, s: F.array(volatility_claim(t, s)), "c03_change_point": lambda t, s: F.array(change_claim(t, s)), "c08_point_values": point_claims,
    "c09_range_bounds": range_claims, "c10_segments": segment_claims, "c05_peaks_troughs": event_claims,
}


def _claims_query(build):
    def run(spark, sf_dir):
        rows = captioned(spark, sf_dir).select("user_id", F.explode(build(F.col("caption"), F.col("values"))).alias("c")).where("c is not null")
        return rows.select("user_id", "c.name", rounded(F.col("c.score")).alias("score"), "c.confidence", "c.supported", "c.contradicted")

    return run


for _name, _build in _BUILDERS.items():
    query(_name, f"WITH {_CASES_SQL}, x AS ({_PARTS_SQL[_name]}) {_OUT_SQL}")(_claims_query(_build))

_ALL_SQL = f"""{_CASES_SQL}, x AS ({" UNION ALL ".join(f"({p})" for p in _PARTS_SQL.values())}),
k AS (SELECT user_id, c.score AS score, c.supported AS supported, c.contradicted AS contradicted, greatest(0.05::DOUBLE, c.confidence * CASE WHEN c.name LIKE 'point_value%' OR c.name LIKE 'range_bounds%' OR c.name LIKE '%_alignment' AND c.name NOT LIKE 'change%' THEN 1.25::DOUBLE WHEN c.name LIKE 'change_point%' OR c.name LIKE 'segment_%' THEN 1.15::DOUBLE ELSE 1 END) AS w FROM x WHERE c IS NOT NULL),
f AS (SELECT c.user_id, count(k.score) AS verifiable, count(*) FILTER (k.supported) AS yes, count(*) FILTER (k.contradicted) AS no, avg(score) AS mean, avg(abs(score - 0.5::DOUBLE) * 2) AS strength,
 CASE WHEN count(score) > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, sum(w * score) / sum(w) - 0.20::DOUBLE * coalesce(sum(w) FILTER (contradicted), 0) / sum(w) - 0.10::DOUBLE * coalesce(sum(w) FILTER (score <= 0.2::DOUBLE), 0) / sum(w))) END AS correct
 FROM c LEFT JOIN k ON k.user_id = c.user_id GROUP BY c.user_id)"""


@query(
    "c20_consistency",
    f"""WITH {_ALL_SQL} SELECT user_id, verifiable::INT AS verifiable, {rounded_sql("coalesce(mean, 0.5::DOUBLE)")} AS consistency_score, {rounded_sql("coalesce(correct, 0.5::DOUBLE)")} AS correctness_score,
 {rounded_sql("CASE WHEN verifiable = 0 THEN 0.25::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.35::DOUBLE + 0.35::DOUBLE * least(1.0::DOUBLE, verifiable / 4.0::DOUBLE) + 0.30::DOUBLE * strength)) END")} AS confidence_score,
 {rounded_sql("CASE WHEN verifiable = 0 THEN 0 ELSE no / verifiable::DOUBLE END")} AS contradicted_rate,
 CASE WHEN verifiable > 0 AND no = 0 AND yes = verifiable THEN 'consistent' WHEN no > 0 AND correct < 0.6::DOUBLE THEN 'inconsistent' WHEN yes > 0 OR coalesce(correct, 0.5::DOUBLE) >= 0.6::DOUBLE THEN 'partially_consistent' ELSE 'inconsistent' END AS verdict FROM f""",
)
def c20(spark, sf_dir):
    """Scores and verdict of each user's caption and series (C17 to C21 included)."""
    rows = evaluate(captioned(spark, sf_dir))
    return rows.select("user_id", "verifiable", *(rounded(F.col(k)).alias(k) for k in ("consistency_score", "correctness_score", "confidence_score", "contradicted_rate")), "verdict")


@query(
    "c13_series_statistics",
    f"""WITH {_CASES_SQL} SELECT user_id, n::INT AS length, {rounded_sql("lo")} AS min, {rounded_sql("hi")} AS max, {rounded_sql("m")} AS mean, {rounded_sql("sqrt(list_avg(list_transform(s, lambda v: (v - m) * (v - m))))")} AS std,
 (list_position(s, hi) - 1)::INT AS argmax, (list_position(s, lo) - 1)::INT AS argmin, {rounded_sql("slope")} AS slope, {rounded_sql("size")} AS scale, {rounded_sql("sqrt(list_avg(list_transform(s, lambda v: (v - m) * (v - m)))) / size")} AS relative_volatility FROM c""",
)
def c13(spark, sf_dir):
    """Length, extremes, mean, deviation, slope, scale and relative volatility."""
    s = F.col("values")
    return user_series(spark, sf_dir).select(
        "user_id", F.size(s).alias("length"), *(rounded(x).alias(k) for k, x in (("min", F.array_min(s)), ("max", F.array_max(s)), ("mean", P.mean(s)), ("std", P.stddev(s)), ("slope", slope(s)), ("scale", scale(s)), ("relative_volatility", P.stddev(s) / scale(s)))),
        (F.array_position(s, F.array_max(s)) - 1).cast("int").alias("argmax"), (F.array_position(s, F.array_min(s)) - 1).cast("int").alias("argmin"),
    )


@query("c12_unit_order", f"WITH {_CASES_SQL} SELECT user_id, plain FROM c")
def c12(spark, sf_dir):
    """Captions with units after positions."""
    return captioned(spark, sf_dir).select("user_id", units_last(F.col("caption")).alias("plain"))


@query(
    "c04_change_strength",
    f"""WITH {_CASES_SQL}, z AS (SELECT user_id, unnest(list_transform(range(6, n - 6), lambda i: {{'i': i, 'strength': abs(list_avg(s[i + 1:i + 6]) - list_avg(s[i - 5:i]))}})) AS z FROM c)
SELECT user_id, arg_min(z.i, (-z.strength, z.i))::INT AS index, {rounded_sql("max(z.strength)")} AS strength FROM z GROUP BY user_id""",
)
def c04(spark, sf_dir):
    """Where the means of six points on both sides differ most."""
    best = change_point(F.col("values"), F.lit(6))
    return user_series(spark, sf_dir).select("user_id", (-best["minus"]).alias("index"), rounded(best["strength"]).alias("strength"))
