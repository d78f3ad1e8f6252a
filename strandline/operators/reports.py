"""Case scoring, failure labels, grouped reports, sampling: ordinary grouped and windowed aggregation.

Records are rows ``method, case_id, dataset, length, status, score``; the queries derive them from the
users' events by integers alone, so that any engine makes the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import query
from ..sources.blocks import joined
from ..sources.series import rounded, rounded_sql
from .quantiles import medians

METHODS = ["Reference", "Ours", "Direct"]
#: Failure labels in report order.
LABELS = ["schema_invalid", "registry_invalid", "unsafe_code", "execution_failed", "parse_failure", "length_mismatch", "no_signal", "wrong_primitive", "wrong_window", "wrong_parameter", "semantic_constraint_failed", "false_rejection", "unsupported_hallucination"]
_RECORDS_SQL = """u AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), k(method, j) AS (VALUES ('Reference', 0), ('Ours', 1), ('Direct', 2)),
x AS (SELECT method, j, user_id AS case_id, user_id % 4 AS dataset, [24, 48, 96][user_id % 3 + 1] AS length, n, CASE WHEN j > 0 AND (user_id + j) % 7 = 0 THEN 'missing_series' WHEN j > 0 AND (user_id + j) % 11 = 0 THEN 'evaluation_error' ELSE 'success' END AS status, ((user_id * 37 + n * 11 + j * 29) % 101) / 100.0::DOUBLE AS raw FROM u, k),
r AS (SELECT method, j, case_id, dataset, length, n, status, CASE WHEN status = 'success' THEN raw END AS score, CASE WHEN status = 'success' THEN CASE WHEN raw >= 0.7::DOUBLE THEN 'consistent' WHEN raw < 0.35::DOUBLE THEN 'inconsistent' ELSE 'partially_consistent' END END AS verdict FROM x)"""


def records(spark, sf_dir: str) -> DataFrame:
    users = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.count("*").alias("n"))
    methods = spark.createDataFrame([(m, j) for j, m in enumerate(METHODS)], "method string, j int")
    u, j = F.col("user_id"), F.col("j")
    status = F.when((j > 0) & ((u + j) % 7 == 0), "missing_series").when((j > 0) & ((u + j) % 11 == 0), "evaluation_error").otherwise("success")
    raw = ((u * 37 + F.col("n") * 11 + j * 29) % 101) / 100.0
    rows = users.crossJoin(F.broadcast(methods)).select("method", "j", u.alias("case_id"), (u % 4).alias("dataset"), F.element_at(F.array(F.lit(24), F.lit(48), F.lit(96)), (u % 3 + 1).cast("int")).alias("length"), "n", status.alias("status"), raw.alias("raw"))
    verdict = F.when(F.col("raw") >= 0.7, "consistent").when(F.col("raw") < 0.35, "inconsistent").otherwise("partially_consistent")
    ok = F.col("status") == "success"
    return rows.select("method", "j", "case_id", "dataset", "length", "n", "status", F.when(ok, F.col("raw")).alias("score"), F.when(ok, verdict).alias("verdict"))


def aggregate(rows: DataFrame, *keys: str) -> DataFrame:
    """Success rate, mean and median score over valid cases, mean over all (missing counts 0), verdict rates."""
    ok, n = F.count_if(F.col("status") == "success"), F.count("*")
    means = rows.groupBy(*keys).agg(
        n.alias("cases"), ok.alias("valid"), rounded(ok / n).alias("success_rate"), rounded(F.avg("score")).alias("mean_valid"),
        rounded(F.sum(F.coalesce("score", F.lit(0.0))) / n).alias("mean_all"), rounded(F.count_if(F.col("verdict") == "consistent") / F.nullif(ok, F.lit(0))).alias("consistent_rate"),
    )
    middle = medians(rows, list(keys), "score").select(*keys, rounded(F.col("median")).alias("median_valid"))
    return joined(means, middle, list(keys))


_AGG_SQL = f"""count(*) AS cases, count(score) AS valid, {rounded_sql('count(score) / count(*)::DOUBLE')} AS success_rate, {rounded_sql('avg(score)')} AS mean_valid, {rounded_sql('quantile_cont(score, 0.5)')} AS median_valid,
 {rounded_sql('sum(coalesce(score, 0)) / count(*)')} AS mean_all, {rounded_sql("count(*) FILTER (verdict = 'consistent') / nullif(count(score), 0)::DOUBLE")} AS consistent_rate"""


@query("a02_by_method", f"WITH {_RECORDS_SQL} SELECT method, {_AGG_SQL} FROM r GROUP BY method")
def a02(spark, sf_dir):
    return aggregate(records(spark, sf_dir), "method")


@query("a03_by_dataset_length", f"WITH {_RECORDS_SQL} SELECT method, dataset, length, {_AGG_SQL} FROM r GROUP BY method, dataset, length")
def a03(spark, sf_dir):
    return aggregate(records(spark, sf_dir), "method", "dataset", "length")


@query("a01_statuses", f"WITH {_RECORDS_SQL} SELECT method, status, count(*) AS cases FROM r GROUP BY method, status")
def a01(spark, sf_dir):
    return records(spark, sf_dir).groupBy("method", "status").agg(F.count("*").alias("cases"))


@query("a04_reference_normalized", f"WITH {_RECORDS_SQL}, z AS (SELECT a.method, coalesce(least(1.0::DOUBLE, a.score / greatest(b.score, 0.25::DOUBLE)), 0) AS x FROM r a LEFT JOIN r b ON a.case_id = b.case_id AND b.method = 'Reference') SELECT method, {rounded_sql('avg(x)')} AS mean, {rounded_sql('quantile_cont(x, 0.5)')} AS median FROM z GROUP BY method")
def a04(spark, sf_dir):
    """Scores by the reference method's score of the same case."""
    rows = records(spark, sf_dir)
    base = rows.where("method = 'Reference'").select("case_id", F.col("score").alias("base"))
    x = F.coalesce(F.least(F.lit(1.0), F.col("score") / F.greatest("base", F.lit(0.25))), F.lit(0.0))
    shares = rows.join(base, "case_id", "left").select("method", x.alias("x"))
    middle = medians(shares, ["method"], "x").select("method", rounded(F.col("median")).alias("median"))
    return joined(shares.groupBy("method").agg(rounded(F.avg("x")).alias("mean")), middle, ["method"])


#: The wording of messages by which failures are told apart, and their buckets, in order.
BUCKETS = [
    ("does not match expected length", "length_mismatch"), ("__name__", "missing___name__"), ("could not broadcast input array", "shape_broadcast_mismatch"), ("Disallowed numpy call", "unsupported_numpy_api"),
    ("Only whitelisted `np.*` calls are allowed.", "unsupported_numpy_api"), ("Disallowed function call", "disallowed_function_call"), ("No JSON object found", "json_parse_failure"),
]
_MESSAGES = [
    "Generated series length {a} does not match expected length {e}.", "name '__name__' is not defined", "could not broadcast input array from shape (24,) into shape (25,)", "Disallowed numpy call: np.fft.fft", "Only whitelisted `np.*` calls are allowed.",
    "Disallowed function call: open", "No JSON object found\nin the output", "timeout " + "while waiting for a planner " * 8,
]
_ERROR_SQL = f"replace(replace([{', '.join(chr(39) + m.replace(chr(39), chr(39) * 2) + chr(39) for m in _MESSAGES)}][1 + (case_id + j) % {len(_MESSAGES)}], '{{a}}', (n - 3 + case_id % 7)::VARCHAR), '{{e}}', n::VARCHAR)"


def errors(rows: DataFrame) -> DataFrame:
    """Adds a message to each record, of all kinds in turn."""
    text = F.element_at(F.array(*map(F.lit, _MESSAGES)), ((F.col("case_id") + F.col("j")) % len(_MESSAGES) + 1).cast("int"))
    actual = F.replace(text, F.lit("{a}"), (F.col("n") - 3 + F.col("case_id") % 7).cast("string"))
    return rows.withColumn("error", F.replace(actual, F.lit("{e}"), F.col("n").cast("string")))


def bucket(error: Column) -> Column:
    out = F.when(F.lit(False), "")
    for words, name in BUCKETS:
        out = out.when(error.contains(words), name)
    return out.otherwise("other_execution_failure")


_BUCKET_SQL = "CASE " + " ".join(f"WHEN contains(error, '{w}') THEN '{b}'" for w, b in BUCKETS) + " ELSE 'other_execution_failure' END"
LENGTHS = r"length (\d+) does not match expected length (\d+)"


def length_difference(error: Column) -> Column:
    """Actual minus expected length of a mismatch message, signed, or null."""
    actual, expected = (F.regexp_extract(error, LENGTHS, k).try_cast("int") for k in (1, 2))
    return F.format_string("%+d", F.when(F.regexp_like(error, F.lit(LENGTHS)), actual - expected))


@query("a10_failure_buckets", f"WITH {_RECORDS_SQL}, e AS (SELECT method, {_ERROR_SQL} AS error FROM r WHERE status <> 'success') SELECT method, {_BUCKET_SQL} AS bucket, count(*) AS cases FROM e GROUP BY 1, 2")
def a10(spark, sf_dir):
    return errors(records(spark, sf_dir)).where("status != 'success'").groupBy("method", bucket(F.col("error")).alias("bucket")).agg(F.count("*").alias("cases"))


@query("a11_length_differences", f"WITH {_RECORDS_SQL}, e AS (SELECT {_ERROR_SQL} AS error FROM r) SELECT printf('%+d', regexp_extract(error, '{LENGTHS}', 1)::INT - regexp_extract(error, '{LENGTHS}', 2)::INT) AS difference, count(*) AS cases FROM e WHERE regexp_matches(error, '{LENGTHS}') GROUP BY 1")
def a11(spark, sf_dir):
    """Histogram of signed differences between actual and expected lengths."""
    rows = errors(records(spark, sf_dir)).where(F.regexp_like("error", F.lit(LENGTHS)))
    return rows.groupBy(length_difference(F.col("error")).alias("difference")).agg(F.count("*").alias("cases"))


def error_prefix(error: Column) -> Column:
    """The first 160 characters of a message's first line."""
    return F.left(F.split(error, "\n", 2)[0], F.lit(160))


@query("a13_error_prefixes", f"WITH {_RECORDS_SQL}, e AS (SELECT left(split_part({_ERROR_SQL}, chr(10), 1), 160) AS prefix, count(*) AS cases FROM r WHERE status <> 'success' GROUP BY 1) SELECT prefix, cases, row_number() OVER (ORDER BY cases DESC, prefix)::INT AS rank FROM e QUALIFY rank <= 12")
def a13(spark, sf_dir):
    """The twelve most frequent first lines of failures, cut at 160 characters."""
    failed = errors(records(spark, sf_dir)).where("status != 'success'")
    top = failed.groupBy(error_prefix(F.col("error")).alias("prefix")).agg(F.count("*").alias("cases")).orderBy(F.desc("cases"), "prefix").limit(12)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cases"), "prefix")))


@query("a13_missing_artifacts", f"WITH {_RECORDS_SQL} SELECT method, count(*) AS cases, count(*) FILTER (status = 'success') AS successful, count(*) FILTER (status = 'missing_series') AS missing, string_agg(case_id::VARCHAR, ',' ORDER BY case_id) FILTER (status = 'missing_series') AS missing_cases FROM r GROUP BY method")
def a13_missing(spark, sf_dir):
    """Status counters and the missing cases of each method."""
    missing = F.col("status") == "missing_series"
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(missing, F.col("case_id")))), lambda x: x.cast("string")), ",")
    return records(spark, sf_dir).groupBy("method").agg(F.count("*").alias("cases"), F.count_if(F.col("status") == "success").alias("successful"), F.count_if(missing).alias("missing"), F.nullif(listed, F.lit("")).alias("missing_cases"))


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose keys it lacks."""
    return old.join(new, list(keys), "left_anti").unionByName(new)


@query("a15_upsert", f"WITH {_RECORDS_SQL} SELECT method, case_id, CASE WHEN case_id % 3 = 0 AND method = 'Ours' THEN 1.0::DOUBLE ELSE score END AS score FROM r")
def a15(spark, sf_dir):
    rows = records(spark, sf_dir).select("method", "case_id", "score")
    return upsert(rows, rows.where("case_id % 3 = 0 and method = 'Ours'").withColumn("score", F.lit(1.0)), "method", "case_id")


@query("a17_pivot", f"WITH {_RECORDS_SQL} SELECT method, {', '.join(rounded_sql(f'avg(score) FILTER (dataset = {d})') + f' AS d{d}' for d in range(4))} FROM r GROUP BY method")
def a17(spark, sf_dir):
    wide = records(spark, sf_dir).groupBy("method").pivot("dataset", [0, 1, 2, 3]).agg(F.avg("score"))
    return wide.select("method", *(rounded(F.col(str(d))).alias(f"d{d}") for d in range(4)))


@query("a18_claim_gates", f"""WITH {_RECORDS_SQL}, g AS (SELECT coalesce(avg(score) FILTER (method = 'Ours'), 0) AS ours, coalesce(avg(score) FILTER (method = 'Direct'), 0) AS direct, count(*) FILTER (status <> 'success' AND method = 'Ours') AS lost FROM r)
SELECT CASE WHEN ours - direct >= 0.20 THEN 'supported' ELSE 'not_supported' END AS plan_beats_direct, CASE WHEN lost > 0 THEN 'partial' ELSE 'supported' END AS complete FROM g""")
def a18(spark, sf_dir):
    """Gates on joined aggregates; absent metrics count as 0."""
    rows = records(spark, sf_dir)
    mean = lambda m: F.coalesce(F.avg(F.when(F.col("method") == m, F.col("score"))), F.lit(0.0))
    lost = F.count_if((F.col("status") != "success") & (F.col("method") == "Ours"))
    g = rows.agg(mean("Ours").alias("ours"), mean("Direct").alias("direct"), lost.alias("lost"))
    return g.select(F.when(F.col("ours") - F.col("direct") >= 0.20, "supported").otherwise("not_supported").alias("plan_beats_direct"), F.when(F.col("lost") > 0, "partial").otherwise("supported").alias("complete"))


@query("a19_stability", f"WITH {_RECORDS_SQL}, z AS (SELECT method, verdict, first_value(verdict) OVER (PARTITION BY case_id ORDER BY j) AS base FROM r) SELECT method, {rounded_sql('avg((verdict IS NOT DISTINCT FROM base)::INT)')} AS agreement FROM z GROUP BY method")
def a19(spark, sf_dir):
    """Agreement of each method's signature with the first method's, by case."""
    base = F.first("verdict").over(Window.partitionBy("case_id").orderBy("j"))
    rows = records(spark, sf_dir).withColumn("base", base)
    return rows.groupBy("method").agg(rounded(F.avg(F.col("verdict").eqNullSafe(F.col("base")).cast("int"))).alias("agreement"))


@query("e11_rollup", f"WITH {_RECORDS_SQL} SELECT method, coalesce(dataset, -1) AS dataset, count(*) AS cases, {rounded_sql('avg((score >= 0.9)::INT)')} AS pass_rate, {rounded_sql('avg(score) FILTER (dataset = 3)')} AS hard_mean FROM r GROUP BY GROUPING SETS ((method, dataset), (method))")
def e11(spark, sf_dir):
    """Overall and by-category rows in one rollup, with conditional means."""
    rows = records(spark, sf_dir)
    out = rows.groupBy("method", "dataset").agg(F.count("*").alias("cases"), F.sum((F.col("score") >= 0.9).cast("int")).alias("p"), F.count("score").alias("k"), F.sum(F.when(F.col("dataset") == 3, F.col("score"))).alias("h"), F.count(F.when(F.col("dataset") == 3, F.col("score"))).alias("hk"))
    total = out.groupBy("method").agg(F.lit(-1).cast("long").alias("dataset"), *(F.sum(c).alias(c) for c in ("cases", "p", "k", "h", "hk")))
    both = out.unionByName(total)
    return both.select("method", "dataset", "cases", rounded(F.try_divide("p", "k")).alias("pass_rate"), rounded(F.try_divide("h", "hk")).alias("hard_mean"))


def iou(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Overlap of inclusive windows by the length of their hull."""
    overlap = F.greatest(F.lit(0), F.least(b, d) - F.greatest(a, c) + 1) / (F.greatest(b, d) - F.least(a, c) + 1)
    return F.when(a.isNull() | b.isNull() | c.isNull() | d.isNull(), 0.0).otherwise(overlap)


@query("e03_best_step", f"""WITH {_RECORDS_SQL}, s(step, a, b) AS (VALUES (0, 0, 10), (1, 5, 20), (2, 15, 30)), f AS (SELECT case_id, case_id % 20 AS c, case_id % 20 + 8 AS d FROM r WHERE j = 0),
z AS (SELECT case_id, step, greatest(0, least(b, d) - greatest(a, c) + 1) / (greatest(b, d) - least(a, c) + 1)::DOUBLE AS iou FROM f, s) SELECT case_id, arg_min(step, (-iou, step))::INT AS step, {rounded_sql('max(iou)')} AS iou FROM z GROUP BY case_id""")
def e03(spark, sf_dir):
    """The step whose window overlaps a feature's most; the first wins."""
    steps = spark.createDataFrame([(0, 0, 10), (1, 5, 20), (2, 15, 30)], "step int, a int, b int")
    f = records(spark, sf_dir).where("j = 0").select("case_id", (F.col("case_id") % 20).alias("c"), (F.col("case_id") % 20 + 8).alias("d"))
    z = f.crossJoin(F.broadcast(steps)).withColumn("iou", iou(F.col("a"), F.col("b"), F.col("c"), F.col("d")))
    return z.groupBy("case_id").agg(F.min_by("step", F.struct(-F.col("iou"), "step")).alias("step"), rounded(F.max("iou")).alias("iou"))


@query("e05_multiset_f1", f"""WITH {_RECORDS_SQL}, ve AS (SELECT case_id, unnest(['flat', 'spike', 'spike']) AS p FROM r WHERE j = 0), vu AS (SELECT case_id, unnest(CASE WHEN case_id % 3 = 0 THEN ['flat', 'spike'] WHEN case_id % 3 = 1 THEN ['spike', 'dip', 'spike', 'gap'] ELSE ['trend'] END) AS p FROM r WHERE j = 0),
a AS (SELECT case_id, p, count(*) AS n FROM ve GROUP BY ALL), b AS (SELECT case_id, p, count(*) AS n FROM vu GROUP BY ALL),
z AS (SELECT coalesce(a.case_id, b.case_id) AS case_id, sum(least(coalesce(a.n, 0), coalesce(b.n, 0))) AS shared, sum(coalesce(a.n, 0)) AS e, sum(coalesce(b.n, 0)) AS u FROM a FULL JOIN b ON a.case_id = b.case_id AND a.p = b.p GROUP BY 1)
SELECT case_id, {rounded_sql('CASE WHEN e + u = 0 THEN 1 ELSE 2.0::DOUBLE * shared / (e + u) END')} AS f1 FROM z""")
def e05(spark, sf_dir):
    """F1 of two multisets of primitives by case."""
    words = lambda *x: F.array(*map(F.lit, x))
    k = F.col("case_id") % 3
    rows = records(spark, sf_dir).where("j = 0").select("case_id", words("flat", "spike", "spike").alias("expected"), F.when(k == 0, words("flat", "spike")).when(k == 1, words("spike", "dip", "spike", "gap")).otherwise(words("trend")).alias("used"))
    times = lambda xs, w: F.size(F.filter(xs, lambda y: y == w))
    both = F.aggregate(F.array_distinct("expected"), F.lit(0), lambda n, w: n + F.least(times(F.col("expected"), w), times(F.col("used"), w)))
    total = F.size("expected") + F.size("used")
    return rows.select("case_id", rounded(F.when(total == 0, 1.0).otherwise(2.0 * both / total)).alias("f1"))


@query("g06_stratified_sample", f"WITH {_RECORDS_SQL}, z AS (SELECT dataset, length, case_id, row_number() OVER (PARTITION BY dataset, length ORDER BY md5(case_id::VARCHAR), case_id) AS k FROM r WHERE j = 0 AND case_id % 10 <> 0) SELECT dataset, length, case_id FROM z WHERE k <= 3")
def g06(spark, sf_dir):
    """Three cases of each stratum, outside a main split (an anti join), in a seeded order."""
    rows = records(spark, sf_dir).where("j = 0")
    rest = rows.join(rows.where("case_id % 10 = 0").select("case_id"), "case_id", "left_anti")
    place = F.row_number().over(Window.partitionBy("dataset", "length").orderBy(F.md5(F.col("case_id").cast("string").cast("binary")), "case_id"))
    return rest.withColumn("k", place).where("k <= 3").select("dataset", "length", "case_id")


@query("g08_train_valid_split", f"WITH {_RECORDS_SQL}, z AS (SELECT dataset, case_id, row_number() OVER (PARTITION BY dataset ORDER BY md5(case_id::VARCHAR), case_id) AS k FROM r WHERE j = 0) SELECT dataset, case_id, CASE WHEN k <= 10 THEN 'train' ELSE 'valid' END AS part FROM z WHERE k <= 14")
def g08(spark, sf_dir):
    """Disjoint seeded ranges of each dataset."""
    place = F.row_number().over(Window.partitionBy("dataset").orderBy(F.md5(F.col("case_id").cast("string").cast("binary")), "case_id"))
    return records(spark, sf_dir).where("j = 0").withColumn("k", place).where("k <= 14").select("dataset", "case_id", F.when(F.col("k") <= 10, "train").otherwise("valid").alias("part"))
