"""Caption semantics and primitive retrieval.

One automaton holds all patterns of tags, all cues and all phrases (``functions.matching``); each caption goes
through it once, in Arrow batches. Tags, candidates and ranks are array expressions on what it found, so a caption
is worked on in its row: nothing is joined or shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..catalog import query
from ..functions import vocabulary as V
from ..functions.matching import matcher
from ..functions.primitives import let
from ..plans.registry import PRIMITIVES

TOKEN = r"[a-z]+(?:'[a-z]+)?"


def any_of(text: Column, phrases: list[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | text.contains(p)
    return out


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def negated(prefix: Column, window: int = 6) -> Column:
    """Whether a negation stands among the last words before a match."""
    words = tokens(prefix)
    last = F.slice(words, F.greatest(F.size(words) - window + 1, F.lit(1)), window)
    single = F.exists(F.transform(last, lambda w, i: w.isin(*V.NEGATIONS) & ~(w.isin("no", "not") & F.coalesce(F.get(last, i + 1) == "only", F.lit(False)))), lambda x: x)
    double = F.exists(F.transform(last, lambda w, i: F.concat_ws(" ", w, F.get(last, i + 1)).isin(*V.NEGATION_PAIRS)), lambda x: x)
    return single | double


def mentioned(text: Column, pattern: Column) -> Column:
    """Whether a match of the pattern is not negated; a match's prefix is what lies before it."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, pattern, -1)
    prefix = lambda i: F.array_join(F.zip_with(F.slice(between, 1, i + 1), F.slice(found, 1, i), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.exists(F.transform(found, lambda m, i: ~negated(prefix(i))), lambda x: x)


def cue_pattern(cue: str) -> str:
    return r"\b" + re.sub(r"(?:\\ |\s)+", r"\\s+", re.escape(cue.lower())) + r"\b"


#: Patterns of tags (kind 0, in tag order) and cues of primitives (kind 1, in catalog order).
PATTERNS = [(0, sorted(V.RULES).index(t), t, p) for t, (patterns, _) in V.RULES.items() for p in patterns]
PATTERNS += [(1, i, n, cue_pattern(c)) for i, (n, (_, _, cues)) in enumerate(V.CATALOG.items()) for c in cues]
_RANKING = [V.EVENT_TERMS, V.TEXTURE_TERMS, V.STRUCTURAL_TERMS, V.TREND_TERMS, V.OVERWRITE_TERMS, V.ADDITIVE_TERMS, V.SEASONAL_TERMS]
PHRASES = sorted({
    "oscill", "linearly from", "stable", *V.PERIODIC, *(p for ps in V.NEGATED_PHRASES.values() for p in ps), *(p for groups, *_ in V.ROUTES for g in groups for p in g), *(p for ps in _RANKING for p in ps),
    *(t.replace("_", " ") for _, tags, _ in V.CATALOG.values() for t in tags), *(q.lower() for _, _, cues in V.CATALOG.values() for q in cues)})

_HIT = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("rank", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("mentioned", T.BooleanType())])


@F.pandas_udf(T.StructType([T.StructField("hits", T.ArrayType(_HIT)), T.StructField("phrases", T.ArrayType(T.StringType()))]))
def matched(text):
    """Names whose patterns match a lower-case text, each once, and the phrases in it."""
    import pandas as pd

    found = matcher(tuple(p for *_, p in PATTERNS), tuple(PHRASES))

    def one(caption):
        hits: dict[tuple, bool] = {}
        patterns, phrases = found.find(caption or "")
        for k, mentioned in patterns.items():
            key = PATTERNS[k][:3]
            hits[key] = hits.get(key, False) or mentioned
        return [{"kind": k[0], "rank": k[1], "name": k[2], "mentioned": m} for k, m in sorted(hits.items())], sorted(phrases)

    return pd.DataFrame([one(c) for c in text], columns=["hits", "phrases"])


def names(xs: list[str]) -> Column:
    return F.array(*map(F.lit, xs)).cast("array<string>")


def said(phrases: list[str]) -> Column:
    """Whether one of the phrases is in the text (of rows that ``match`` has seen)."""
    return F.arrays_overlap("__phrases", names(phrases))


def match(captions: DataFrame, caption: str = "caption") -> DataFrame:
    """Adds ``__hits`` and ``__phrases``."""
    rows = captions.withColumn("__found", matched(F.lower(caption)))
    return rows.withColumns({"__hits": F.col("__found.hits"), "__phrases": F.col("__found.phrases")}).drop("__found")


def _swings() -> Column:
    return said(["oscill"]) & ~said(V.PERIODIC)


def _inferred(captions: DataFrame, caption: str) -> DataFrame:
    rows = match(captions, caption)
    of_kind = lambda k: F.transform(F.filter("__hits", lambda h: (h["kind"] == k) & h["mentioned"]), lambda h: h["name"])
    dropped = F.array_compact(F.array(*[F.when(said(p), F.lit(t)) for t, p in V.NEGATED_PHRASES.items()]))
    extra = F.concat(F.when(_swings(), names(["volatility"])).otherwise(names([])), F.when(said(["linearly from"]), names(["trend_up", "trend_down"])).otherwise(names([])))
    tags = F.array_sort(F.array_distinct(F.concat(F.array_except(of_kind(0), dropped), extra)))
    return rows.withColumns({"tags": tags, "cued": of_kind(1)})


def infer(captions: DataFrame, caption: str = "caption") -> DataFrame:
    """Adds ``tags`` (sorted) and ``cued`` (primitives by cue, in catalog order)."""
    return _inferred(captions, caption).drop("__hits", "__phrases")


def retrieve(captions: DataFrame, caption: str = "caption") -> DataFrame:
    """Adds ordered ``candidates``, ``weak_reasons`` and ``status`` by tags, cues and phrase routes."""
    rows = _inferred(captions, caption)
    by_tag = F.create_map(*[x for t, (_, p) in V.RULES.items() for x in (F.lit(t), names(p))])
    found = F.array_distinct(F.concat(F.flatten(F.transform("tags", lambda t: F.element_at(by_tag, t))), F.col("cued")))
    weak, routes = [], []
    for groups, add, remove, reason in V.ROUTES:
        applies = F.lit(True)
        for phrases in groups:
            applies = applies & said(phrases)
        routes.append(F.struct(applies.alias("applies"), names(add).alias("add"), names(remove).alias("remove")))
        if reason:
            weak.append(F.when(applies, F.lit(reason)))
    routes.append(F.struct(_swings().alias("applies"), names(["add_noise", "add_volatility"]).alias("add"), names([]).alias("remove")))
    # a fold over the routes: a chain of columns would double the expression with each
    step = lambda now, r: F.when(r["applies"], F.array_distinct(F.concat(F.array_except(now, r["remove"]), r["add"]))).otherwise(now)
    rows = rows.withColumn("candidates", F.aggregate(F.array(*routes), found, step))
    shaped = F.arrays_overlap("tags", names(["flat", "trend_up", "trend_down", "level_shift", "change_point"]))
    weak += [F.when(_swings(), F.lit("oscillation_without_period")), F.when(said(["stable"]) & ~shaped, F.lit("broad_stable")), F.when(F.size("candidates") == 0, F.lit("no_cue"))]
    orchestrated = F.array_intersect("tags", names(V.ORCHESTRATED))
    rows = rows.withColumns({"weak_reasons": F.array_compact(F.array(*weak)), "orchestration": orchestrated})
    status = F.when((F.size("weak_reasons") > 0) | (F.size("orchestration") > 0), "weak").otherwise("strong")
    return rows.withColumns({"retrievable": (F.size("candidates") > 0) | (F.size("tags") == 0), "status": status}).drop("__hits", "__phrases")


BUCKET = {"local_event": "local_event", "stochastic": "texture", "seasonal": "texture", "structural": "structural"}


def rank(captions: DataFrame, hints: str = "candidates", caption: str = "caption", most: int = 10) -> DataFrame:
    """Adds ``ranked``: at most ``most`` primitives (more if more are hinted): hints, bucket quotas, then scores."""
    rows = match(captions, caption)
    flags = {"texture": V.TEXTURE_TERMS, "structural": V.STRUCTURAL_TERMS, "trend": V.TREND_TERMS, "overwrite": V.OVERWRITE_TERMS, "additive": V.ADDITIVE_TERMS, "seasonal": V.SEASONAL_TERMS}
    events = F.size(F.array_intersect("__phrases", names(V.EVENT_TERMS)))
    known = F.struct(F.coalesce(F.col(hints), names([])).alias("hints"), *(said(p).alias(k) for k, p in flags.items()), events.alias("events"))
    catalog = F.array(*(
        F.struct(F.lit(n).alias("name"), F.lit(PRIMITIVES[n][0]).alias("effect"), F.lit(c).alias("category"), F.lit(BUCKET.get(c, "trend")).alias("bucket"), names([t.replace("_", " ") for t in tags]).alias("tags"), names([q.lower() for q in cues]).alias("cues"))
        for n, (c, tags, cues) in V.CATALOG.items()))

    def scored(k: Column, c: Column) -> Column:
        hinted = F.array_contains(k["hints"], c["name"])
        shared = lambda of: F.size(F.array_intersect("__phrases", c[of]))
        bonus = F.when((c["category"] == "stochastic") & k["texture"], 1.25).when((c["category"] == "seasonal") & k["seasonal"], 1.5).when((c["category"] == "structural") & k["structural"], 0.75).when((c["category"] == "trend") & k["trend"], 0.5).otherwise(0.0)
        score = F.when(hinted, 4.0).otherwise(0.0) + 2.0 * shared("cues") + 0.5 * shared("tags") + bonus
        score = score + F.when(F.when(c["effect"] == "overwrite", k["overwrite"]).otherwise(k["additive"]), 0.25).otherwise(0.0)
        return F.struct((-score).alias("order"), c["name"].alias("name"), c["bucket"].alias("bucket"), hinted.alias("hinted"))

    def ordered(k: Column, all_scored: Column) -> Column:
        kept = lambda keep: F.transform(F.filter(all_scored, keep), lambda x: x["name"])
        quotas = {"trend": F.lit(2), "structural": k["structural"].cast("int"), "local_event": F.least(k["events"], F.lit(2)), "texture": k["texture"].cast("int")}
        wanted = []
        of = lambda bucket, hinted: kept(lambda x: (x["bucket"] == bucket) & (x["hinted"] == hinted))
        for bucket, quota in quotas.items():
            wanted.append(F.slice(of(bucket, False), F.lit(1), F.greatest(quota - F.size(of(bucket, True)), F.lit(0))))
        first = kept(lambda x: x["hinted"])
        every = F.array_distinct(F.concat(first, *wanted, kept(lambda x: F.lit(True))))
        ranked = F.slice(every, F.lit(1), F.greatest(F.lit(most), F.size(first)))
        return F.when(F.size(all_scored) > 0, ranked).otherwise(names([n for n in V.FALLBACK if n in V.CATALOG]))

    # hints, flags and scores are bound once: each is read many times
    by_score = lambda k: F.array_sort(F.filter(F.transform(catalog, lambda c: scored(k, c)), lambda x: x["hinted"] | (x["order"] < 0)))
    return rows.withColumn("ranked", let(known, lambda k: let(by_score(k), lambda x: ordered(k, x)))).drop("__hits", "__phrases")


def unsupported(text: Column) -> Column:
    """The semantic for which a description must be rejected, or null."""
    low = F.lower(text)
    denies = any_of(low, ["no repeating period", "not indicate any repeating period"])
    return F.when(any_of(low, ["mean-reverting", "mean reversion", "long-run mean"]), "mean_reversion").when(low.contains("oscillat") & denies & any_of(low, ["seasonal cycle", "seasonality"]), "mild_nonperiodic_oscillation")


def representative(rows: DataFrame, status: str, key: str, limit: int = 5) -> DataFrame:
    """The captions of a status with most weak reasons and candidates, ties by key."""
    return rows.where(F.col("status") == status).orderBy(F.size("weak_reasons").desc(), F.size("candidates").desc(), key).limit(limit)


def summary(rows: DataFrame, most: int = 12) -> DataFrame:
    """Counts by status, and the most frequent primitives and tags."""
    kinds = rows.select(F.explode(F.concat(F.array(F.struct(F.lit("status").alias("kind"), F.col("status").alias("name"))), F.transform("candidates", lambda c: F.struct(F.lit("primitive").alias("kind"), c.alias("name"))), F.transform("tags", lambda t: F.struct(F.lit("tag").alias("kind"), t.alias("name"))))).alias("x"))
    counts = kinds.groupBy("x.kind", "x.name").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "name"))
    return counts.withColumn("rank", place).where(F.col("rank") <= most)


#: Captions by user_id modulo their number, with negations, distractors and routes.
CAPTIONS = [
    "A steady rise with an upward trend and a sudden jump.", "The series is not volatile and shows no peak at all.", "It is not only noisy but also seasonal, with a repeating pattern.", "There is a gap of missing values after a level shift to a new level.",
    "Values hover around 10 with support near 9 and resistance at 11.", "Exponential decay follows without any outlier or dip.", "The signal oscillates but does not indicate any repeating period and has no seasonality.", "A perfectly flat line that remains constant.",
    "It moves linearly from 3 to 9, then jumps up by 4 to a higher level.", "No evidence of mean reversion; returns to the mean never occur.", "A regime shift rather than just a finite plateau, with fluctuations being rescaled.", "Mean-reverting behaviour around the long-run mean.",
    "The absence of noise lets a local minimum and the highest value stand out.", "Stable, then an accelerating decline with a sharp drop.", "One-timestep impulse, a change point and a break in trend.", "Nothing of note happens here.",
]


def captioned(spark, sf_dir) -> DataFrame:
    """Each user's caption: two sentences by id, and the number of its events."""
    pick = lambda i: F.element_at(F.array(*[F.lit(c) for c in CAPTIONS]), (i % len(CAPTIONS) + 1).cast("int"))
    users = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.count("*").alias("n"))
    second = F.floor(F.col("user_id") / len(CAPTIONS)) + 5
    return users.select("user_id", F.concat(pick(F.col("user_id")), F.lit(" "), pick(second), F.lit(" It spans "), F.col("n").cast("string"), F.lit(" timesteps.")).alias("caption"))


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_LIST = lambda xs: "[" + ", ".join(map(_q, xs)) + "]"
_PICK_SQL = lambda i: f"list_value({', '.join(map(_q, CAPTIONS))})[({i}) % {len(CAPTIONS)} + 1]"
_CAPTION_SQL = f"u AS (SELECT user_id, {_PICK_SQL('user_id')} || ' ' || {_PICK_SQL(f'user_id // {len(CAPTIONS)} + 5')} || ' It spans ' || count(*)::VARCHAR || ' timesteps.' AS caption FROM events GROUP BY user_id), c AS (SELECT DISTINCT caption, lower(caption) AS low FROM u)"
_RULES_SQL = "r(kind, rank, tag, pattern) AS (VALUES " + ", ".join(f"({k}, {i}, {_q(t)}, {_q(p)})" for k, i, t, p in PATTERNS) + ")"
_HITS_SQL = f"""{_CAPTION_SQL}, {_RULES_SQL}, m AS (SELECT caption, low, kind, rank, tag, regexp_split_to_array(low, pattern) AS b, regexp_extract_all(low, pattern) AS f FROM c, r WHERE regexp_matches(low, pattern)),
i AS (SELECT caption, kind, rank, tag, array_to_string(list_transform(range(1, k + 1), lambda j: b[j] || CASE WHEN j < k THEN f[j] ELSE '' END), '') AS prefix FROM (SELECT *, unnest(range(1, len(f) + 1)) AS k FROM m)),
w AS (SELECT caption, kind, rank, tag, list_slice(x, greatest(len(x) - 5, 1), len(x)) AS x FROM (SELECT caption, kind, rank, tag, regexp_extract_all(prefix, {_q(TOKEN)}) AS x FROM i)),
every AS (SELECT caption, kind, rank, tag, len(list_filter(range(1, len(x) + 1), lambda j: list_contains({_LIST(V.NEGATIONS)}, x[j]) AND NOT (x[j] IN ('no', 'not') AND coalesce(x[j + 1] = 'only', FALSE)) OR coalesce(list_contains({_LIST(V.NEGATION_PAIRS)}, x[j] || ' ' || x[j + 1]), FALSE))) > 0 AS negated FROM w), h AS (SELECT * FROM every WHERE kind = 0)"""
_HAS_SQL = lambda phrases: "(" + " OR ".join(f"contains(low, {_q(p)})" for p in phrases) + ")"


@query("r01_tokens", f"WITH {_CAPTION_SQL} SELECT user_id, array_to_string(regexp_extract_all(lower(caption), {_q(TOKEN)}), ' ') AS tokens FROM u")
def r01(spark, sf_dir):
    return captioned(spark, sf_dir).select("user_id", F.array_join(tokens(F.col("caption")), " ").alias("tokens"))


@query("r03_mentions", f"WITH {_HITS_SQL} SELECT u.user_id, h.tag, bool_or(NOT negated) AS mentioned FROM u JOIN h ON h.caption = u.caption GROUP BY u.user_id, h.tag")
def r03(spark, sf_dir):
    """Tags whose patterns match, and whether a match is not negated."""
    rows = match(captioned(spark, sf_dir)).select("user_id", F.explode(F.filter("__hits", lambda h: h["kind"] == 0)).alias("h"))
    return rows.select("user_id", F.col("h.name").alias("tag"), "h.mentioned")


_TAGS_SQL = f"""{_HITS_SQL}, t AS (SELECT caption, tag FROM h WHERE NOT negated EXCEPT SELECT caption, tag FROM c, (VALUES {', '.join(f"({_q(t)}, {_q(p)})" for t, ps in V.NEGATED_PHRASES.items() for p in ps)}) d(tag, phrase) WHERE contains(low, phrase)),
a AS (SELECT caption, tag FROM t UNION SELECT caption, 'volatility' FROM c WHERE contains(low, 'oscill') AND NOT {_HAS_SQL(V.PERIODIC)} UNION SELECT caption, unnest(['trend_up', 'trend_down']) FROM c WHERE contains(low, 'linearly from'))"""


@query("r04_tags", f"WITH {_TAGS_SQL} SELECT u.user_id, coalesce(string_agg(a.tag, ',' ORDER BY a.tag), '') AS tags FROM u LEFT JOIN a ON a.caption = u.caption GROUP BY u.user_id")
def r04(spark, sf_dir):
    return infer(captioned(spark, sf_dir)).select("user_id", F.array_join("tags", ",").alias("tags"))


@query("r06_calm_language", f"WITH {_CAPTION_SQL} SELECT user_id, {_HAS_SQL(V.CALM)} AS calm FROM u JOIN c ON c.caption = u.caption")
def r06(spark, sf_dir):
    return captioned(spark, sf_dir).select("user_id", any_of(F.lower("caption"), V.CALM).alias("calm"))


def _candidates_sql() -> str:
    """Candidates, weak reasons and status of each caption: a chain of lists, one for each route."""
    tags = " ".join(f"WHEN {_q(t)} THEN {_LIST(p) if p else '[]::VARCHAR[]'}" for t, (_, p) in V.RULES.items())
    swings = f"(contains(low, 'oscill') AND NOT {_HAS_SQL(V.PERIODIC)})"
    steps = [
        "tagged AS (SELECT c.caption, any_value(c.low) AS low, coalesce(list(a.tag ORDER BY a.tag) FILTER (WHERE a.tag IS NOT NULL), []) AS tags FROM c LEFT JOIN a ON a.caption = c.caption GROUP BY c.caption)",
        "cued AS (SELECT caption, list(tag ORDER BY rank) AS cued FROM (SELECT DISTINCT caption, rank, tag FROM every WHERE kind = 1 AND NOT negated) GROUP BY caption)",
        f"f0 AS (SELECT t.caption, low, tags, flatten(list_transform(tags, lambda t: CASE t {tags} END)) || coalesce(cued, []) AS y FROM tagged t LEFT JOIN cued q ON q.caption = t.caption)",
    ]
    weak, routes = [], [(" AND ".join(_HAS_SQL(g) for g in groups), add, remove, reason) for groups, add, remove, reason in V.ROUTES]
    for k, (applies, add, remove, reason) in enumerate([*routes, (swings, ["add_noise", "add_volatility"], [], "oscillation_without_period")], 1):
        steps.append(f"x{k} AS (SELECT caption, low, tags, list_filter(y, lambda v, i: list_position(y, v) = i) AS x FROM f{k - 1})")
        steps.append(f"f{k} AS (SELECT caption, low, tags, CASE WHEN {applies} THEN list_filter(x, lambda v: NOT list_contains({_LIST(remove)}::VARCHAR[], v)) || {_LIST(add)}::VARCHAR[] ELSE x END AS y FROM x{k})")
        weak += [f"CASE WHEN {applies} THEN {_q(reason)} END"] if reason else []
    last = len(routes) + 1
    weak.append(f"CASE WHEN contains(low, 'stable') AND NOT list_has_any(tags, ['flat', 'trend_up', 'trend_down', 'level_shift', 'change_point']) THEN 'broad_stable' END")
    weak.append("CASE WHEN len(candidates) = 0 THEN 'no_cue' END")
    steps.append(f"found AS (SELECT caption, low, tags, list_filter(y, lambda v, i: list_position(y, v) = i) AS candidates FROM f{last})")
    steps.append(f"judged AS (SELECT *, list_filter([{', '.join(weak)}], lambda w: w IS NOT NULL) AS weak FROM found)")
    steps.append(f"z AS (SELECT u.user_id, j.*, len(candidates) > 0 OR len(tags) = 0 AS retrievable, CASE WHEN len(weak) > 0 OR list_has_any(tags, {_LIST(V.ORCHESTRATED)}) THEN 'weak' ELSE 'strong' END AS status FROM u JOIN judged j ON j.caption = u.caption)")
    return f"{_TAGS_SQL}, {', '.join(steps)}"


_CANDIDATES_SQL = _candidates_sql()


@query("r07_candidates", f"WITH {_CANDIDATES_SQL} SELECT user_id, array_to_string(candidates, ',') AS candidates, array_to_string(weak, ',') AS weak_reasons, retrievable, status FROM z")
def r07(spark, sf_dir):
    """Ordered candidates with weak reasons and status."""
    return retrieve(captioned(spark, sf_dir)).select("user_id", F.array_join("candidates", ",").alias("candidates"), F.array_join("weak_reasons", ",").alias("weak_reasons"), "retrievable", "status")


@query("r11_representatives", f"WITH {_CANDIDATES_SQL} SELECT user_id, status, len(candidates)::INT AS n FROM z WHERE status = 'weak' ORDER BY len(weak) DESC, len(candidates) DESC, user_id LIMIT 5")
def r11(spark, sf_dir):
    return representative(retrieve(captioned(spark, sf_dir)), "weak", "user_id").select("user_id", "status", F.size("candidates").alias("n"))


@query(
    "r12_summary",
    f"""WITH {_CANDIDATES_SQL}, k AS (SELECT 'status' AS kind, status AS name FROM z UNION ALL SELECT 'primitive', unnest(candidates) FROM z UNION ALL SELECT 'tag', unnest(tags) FROM z),
n AS (SELECT kind, name, count(*) AS n FROM k GROUP BY kind, name), o AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, name)::INT AS rank FROM n) SELECT * FROM o WHERE rank <= 12""",
)
def r12(spark, sf_dir):
    return summary(retrieve(captioned(spark, sf_dir)))


def _ranked_sql() -> str:
    """Hints, bucket quotas and scores as windows over (caption, primitive) rows."""
    lower = lambda xs: _LIST([x.lower().replace("_", " ") for x in xs])
    rows = ", ".join(f"({_q(n)}, {_q(PRIMITIVES[n][0])}, {_q(c)}, {_q(BUCKET.get(c, 'trend'))}, {lower(tags)}, {_LIST([q.lower() for q in cues])})" for n, (c, tags, cues) in V.CATALOG.items())
    when = lambda kind, phrases, value: f"CASE WHEN category = '{kind}' AND {_HAS_SQL(phrases)} THEN {value}::DOUBLE ELSE 0 END"
    bonus = " + ".join([when("stochastic", V.TEXTURE_TERMS, 1.25), when("seasonal", V.SEASONAL_TERMS, 1.5), when("structural", V.STRUCTURAL_TERMS, 0.75), when("trend", V.TREND_TERMS, 0.5)])
    events = " + ".join(f"contains(low, {_q(t)})::INT" for t in V.EVENT_TERMS)
    fallback = ", ".join(f"({k}, {_q(n)})" for k, n in enumerate(n for n in V.FALLBACK if n in V.CATALOG))
    return f"""catalog(name, effect, category, bucket, tags, cues) AS (VALUES {rows}),
s AS (SELECT z.user_id, low, c.name, c.bucket, list_contains(candidates, c.name) AS hinted, CASE WHEN list_contains(candidates, c.name) THEN 4 ELSE 0 END + 2.0::DOUBLE * len(list_filter(cues, lambda q: contains(low, q))) + 0.5::DOUBLE * len(list_filter(c.tags, lambda q: contains(low, q)))
 + CASE WHEN CASE WHEN effect = 'overwrite' THEN {_HAS_SQL(V.OVERWRITE_TERMS)} ELSE {_HAS_SQL(V.ADDITIVE_TERMS)} END THEN 0.25::DOUBLE ELSE 0 END + {bonus} AS score,
 CASE bucket WHEN 'trend' THEN 2 WHEN 'structural' THEN {_HAS_SQL(V.STRUCTURAL_TERMS)}::INT WHEN 'texture' THEN {_HAS_SQL(V.TEXTURE_TERMS)}::INT ELSE least({events}, 2) END AS quota FROM z, catalog c),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id, bucket ORDER BY hinted, score DESC, name) AS own, sum(hinted::INT) OVER (PARTITION BY user_id, bucket) AS taken FROM s WHERE hinted OR score > 0),
g AS (SELECT *, CASE WHEN hinted THEN -1 WHEN own <= quota - taken THEN CASE bucket WHEN 'trend' THEN 0 WHEN 'structural' THEN 1 WHEN 'local_event' THEN 2 ELSE 3 END ELSE 9 END AS stage FROM o),
e AS (SELECT user_id, name, row_number() OVER (PARTITION BY user_id ORDER BY stage, score DESC, name) AS place, greatest(10, sum(hinted::INT) OVER (PARTITION BY user_id)) AS most FROM g)
SELECT user_id, (place - 1)::INT AS place, name AS primitive FROM e WHERE place <= most
UNION ALL SELECT user_id, k::INT, name FROM z, (VALUES {fallback}) f(k, name) WHERE user_id NOT IN (SELECT user_id FROM e)"""


@query("r13_ranked", f"WITH {_CANDIDATES_SQL}, {_ranked_sql()}")
def r13(spark, sf_dir):
    """At most ten primitives by hints, quotas and scores, one row each."""
    rows = rank(retrieve(captioned(spark, sf_dir)))
    return rows.select("user_id", F.posexplode("ranked").alias("place", "primitive"))


@query("r15_unsupported", f"""WITH {_CAPTION_SQL} SELECT user_id, CASE WHEN {_HAS_SQL(["mean-reverting", "mean reversion", "long-run mean"])} THEN 'mean_reversion' WHEN contains(low, 'oscillat') AND {_HAS_SQL(["no repeating period", "not indicate any repeating period"])} AND {_HAS_SQL(["seasonal cycle", "seasonality"])} THEN 'mild_nonperiodic_oscillation' END AS semantic FROM u JOIN c ON c.caption = u.caption""")
def r15(spark, sf_dir):
    return captioned(spark, sf_dir).select("user_id", unsupported(F.col("caption")).alias("semantic"))


@query("r10_catalog_differences", "SELECT * FROM (VALUES ('add_plateau', 'not_in_catalog')) t(primitive, problem)")
def r10(spark, sf_dir):
    """Anti joins of the registered primitives and the catalog, both ways."""
    known = spark.createDataFrame([(n,) for n in PRIMITIVES], "primitive string")
    listed = spark.createDataFrame([(n,) for n in V.CATALOG], "primitive string")
    missing = known.join(listed, "primitive", "left_anti").withColumn("problem", F.lit("not_in_catalog"))
    return missing.unionByName(listed.join(known, "primitive", "left_anti").withColumn("problem", F.lit("not_registered")))


@query(
    "r16_retrieval_assertions",
    f"""WITH {_CANDIDATES_SQL} SELECT user_id, NOT contains(caption, 'gap') OR list_contains(candidates, 'add_gap') AS expected_found, NOT (contains(caption, 'not volatile') AND list_has_any(candidates, ['add_volatility', 'add_peak'])) AS none_forbidden, candidates[1] AS "primary" FROM z""",
)
def r16(spark, sf_dir):
    """Expected and forbidden candidates of each caption, checked as arrays."""
    rows = retrieve(captioned(spark, sf_dir))
    expected = F.when(F.col("caption").contains("gap"), F.array(F.lit("add_gap"))).otherwise(F.array().cast("array<string>"))
    forbidden = F.when(F.col("caption").contains("not volatile"), F.array(F.lit("add_volatility"), F.lit("add_peak"))).otherwise(F.array().cast("array<string>"))
    return rows.select("user_id", (F.size(F.array_except(expected, "candidates")) == 0).alias("expected_found"), (~F.arrays_overlap(forbidden, "candidates")).alias("none_forbidden"), F.get("candidates", F.lit(0)).alias("primary"))
