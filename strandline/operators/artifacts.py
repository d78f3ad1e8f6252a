"""Reports over methods and saved artifacts, sinks, and the runs that tie the operators together."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import examples, query
from ..functions.primitives import let
from ..plans import execute as X
from ..plans import plan as L
from ..plans import repair as W
from ..sources.blocks import cut, joined
from ..sources.series import POINTS_SQL, points, rounded, rounded_sql, user_series
from . import metrics, realcaption
from . import scoring as S
from .plan_queries import FLAT, SPIKE, plan, step
from .quantiles import medians
from .reports import _RECORDS_SQL, records
from .retrieval import unsupported

METRICS = ["mse", "rmse", "mae", "mrr", "wape", "max_abs_error"]


def grouped_cases(cases: DataFrame, order: str, *keys: str) -> DataFrame:
    """Adds each case's ``place`` in its group, by ``order``."""
    return cases.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)


def load_series(cases: DataFrame, reports: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``series``: from the evaluation report, else from the case's own file (both ``case_id, values``)."""
    both = cases.join(reports.select("case_id", F.col("values").alias("__a")), "case_id", "left").join(files.select("case_id", F.col("values").alias("__b")), "case_id", "left")
    return both.withColumn("series", F.coalesce("__a", "__b")).drop("__a", "__b")


def method_metrics(pairs: DataFrame, *keys: str) -> DataFrame:
    """Means and medians of error metrics by ``keys``; pairs are points ``keys, case_id, g, r``, g null where it failed."""
    each = cut(metrics.error_metrics(pairs.where("g is not null"), *keys, "case_id"))
    ok = each.groupBy(*keys).agg(F.count("*").alias("ok"), *[F.avg(c).alias(f"mean_{c}") for c in METRICS], F.avg("correlation").alias("mean_correlation"))
    long = each.select(*keys, F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("x")) for c in METRICS))).alias("m")).select(*keys, "m.metric", "m.x")
    middle = medians(long, [*keys, "metric"], "x").groupBy(*keys).agg(*(F.max(F.when(F.col("metric") == c, F.col("median"))).alias(f"median_{c}") for c in METRICS))
    cases = pairs.groupBy(*keys).agg(F.countDistinct("case_id").alias("cases"))
    out = joined(joined(cases, ok, list(keys), "left"), middle, list(keys), "left")
    return out.withColumn("success_rate", F.coalesce(F.col("ok"), F.lit(0)) / F.col("cases"))


def native_generation(native: DataFrame, scales: DataFrame, truth: DataFrame, limit: float = 0.10) -> DataFrame:
    """Generated points back on the data's scale, and whether a case's normalized RMSE allows a match.

    ``native``: ``case_id, dataset, t, v`` in 0 to 1; ``scales``: ``dataset, t, low, high``; ``truth``: ``case_id, t, r``.
    """
    back = native.join(scales, ["dataset", "t"]).withColumn("g", F.col("v") * (F.col("high") - F.col("low")) + F.col("low"))
    both = back.join(truth, ["case_id", "t"])
    out = both.groupBy("case_id").agg(F.sqrt(F.avg((F.col("g") - F.col("r")) ** 2)).alias("rmse"), (F.max("r") - F.min("r")).alias("span"))
    return out.withColumn("aligned", F.col("rmse") / F.greatest("span", F.lit(1e-8)) <= limit)


def summary(evaluations: DataFrame) -> DataFrame:
    """One row: counts by status, means and medians of the metrics over successes."""
    ok = F.col("status") == "success"
    pick = lambda c: F.when(ok, F.col(c))
    middle = medians(evaluations.where(ok), [], "score").select("median")  # one row, like the sums
    return evaluations.agg(F.count("*").alias("cases"), F.count_if(ok).alias("successful"), F.count_if(F.col("status") == "missing_series").alias("missing"), F.count_if(F.col("status") == "evaluation_error").alias("failed"), F.avg(pick("score")).alias("mean")).crossJoin(middle)


def reliability(results: DataFrame, *keys: str) -> DataFrame:
    """Rates of valid, executable, safe and explained results, each over the cases that it can be asked of."""
    ran = ~F.col("rejected") & F.col("series").isNotNull()
    has = lambda c: F.exists("failures", lambda f: f["code"] == c)
    mean = lambda x: F.avg(x.cast("double"))
    return results.groupBy(*keys).agg(
        mean(F.col("plan_valid")).alias("schema_valid"), mean(F.col("registry_valid")).alias("registry_valid"), mean(F.when(ran, F.col("execution_success"))).alias("executable"), mean(~has("F_safety")).alias("safe_code"),
        F.coalesce(mean(F.when(~F.col("passed"), (F.size("failures") > 0) | (F.size("plan.unresolved_semantics") > 0) | F.col("correct_rejection"))), F.lit(1.0)).alias("failure_report_complete"),
    )


#: The gates of the evidence report over scalar metrics; absent ones count as 0 (a null ``hus`` passes).
def gates(m: DataFrame) -> DataFrame:
    """One row of verdicts from one row of metrics (see the columns that it names)."""
    v = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if c in m.columns else F.lit(0.0)
    raw = lambda c: F.col(c) if c in m.columns else F.lit(None).cast("double")
    held = lambda test: F.when(test, "supported").otherwise("not_supported")
    better = (v("ours_csr") > v("rule_csr")) & (v("ours_adversarial") > v("rule_adversarial"))
    return m.select(
        held((v("ours_pass") - v("direct_pass") >= 0.20) & (v("ours_csr") > v("direct_csr")) & (raw("direct_hus").isNull() | (raw("direct_hus") >= 0.50))).alias("h1"), held(v("full_csr") - v("no_registry_csr") >= 0.50).alias("h2"),
        held((v("repair_pass") - v("no_repair_pass") >= 0.50) & (v("changed") > 0)).alias("h3"), held((v("ours_crr") >= 0.95) & (v("ours_hus") <= 0.05) & (v("no_rejection_hus") >= 0.50)).alias("h4"),
        F.when(better & (v("ours_compositional") > v("rule_compositional")), "supported").when(better & (v("ours_compositional") == v("rule_compositional")), "partial").otherwise("not_supported").alias("h5"),
        F.when(raw("drift").isNull(), "pending").when((v("drift") <= 0.01) & (v("inside") >= 0.05), "partial").otherwise("not_supported").alias("h6"), F.when(raw("seconds").isNotNull(), "partial").otherwise("pending").alias("h7"),
        F.when(v("public_done") > 0, "supported").when(v("public_known") > 0, "partial").otherwise("pending").alias("h8"),
    )


def timed(methods: dict[str, Callable[[], DataFrame]], cases: int, repeats: int = 3) -> dict[str, dict[str, float]]:
    """Wall seconds per case of each method, a mean over ``repeats`` runs; token costs are unknown."""
    out = {}
    for name, run in methods.items():
        spent = []
        for _ in range(repeats):
            began = time.perf_counter()
            run().write.format("noop").mode("overwrite").save()
            spent.append(time.perf_counter() - began)
        out[name] = {"seconds_per_case": sum(spent) / repeats / max(cases, 1), "repeats": repeats, "token_cost": None}
    return out


def screening(rows: DataFrame, k: int, *, hard: float = 1.0, group: str = "dataset") -> DataFrame:
    """The k most telling cases by how far others are worse than ours: one of each group first, then the rest."""
    scored = rows.withColumn("severity", F.col("worst") - F.col("ours")).withColumn("hard", F.col("worst") >= hard)
    first = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("severity"), "case_id"))
    place = F.row_number().over(Window.orderBy(F.when(F.col("turn") == 1, 0).otherwise(1), F.desc("severity"), "case_id"))
    return scored.withColumn("turn", first).withColumn("place", place).where(F.col("place") <= k)


def primitive_match(expected: Column, used: Column) -> Column:
    """``struct<precision, recall, f1, exact>`` of two lists of primitives; ``exact`` asks for the order too."""
    times = lambda xs, w: F.size(F.filter(xs, lambda y: y == w))
    both = F.aggregate(F.array_distinct(expected), F.lit(0), lambda n, w: n + F.least(times(expected, w), times(used, w)))
    ratio = lambda n: F.when(n > 0, both / n).otherwise(0.0)
    total = F.size(expected) + F.size(used)
    return F.struct(ratio(F.size(used)).alias("precision"), ratio(F.size(expected)).alias("recall"), F.when(total > 0, 2.0 * both / total).otherwise(1.0).alias("f1"), (expected == used).alias("exact"))


def check_rate(found: Column) -> Column:
    return F.when(F.size(found) > 0, F.size(F.filter(found, lambda c: c["passed"])) / F.size(found)).otherwise(1.0)


def read_metrics(spark: SparkSession, path: str, names: tuple[str, ...] = ("cttp", "fid", "jftsd")) -> DataFrame:
    """Means of the numeric metrics of CSV logs; values that are no numbers are left out."""
    rows = spark.read.option("header", True).csv(path)
    return rows.agg(*[F.avg(F.col(n).try_cast("double")).alias(n) for n in names if n in rows.columns])


def reprocess(saved: DataFrame, text: str = "text", reference: str = "reference") -> DataFrame:
    """Plans from saved planner answers, their open items resolved and gaps filled from the reference, then executed."""
    ref = F.col(reference)
    rows = saved.withColumns({"length": F.size(ref), "plan": L.from_text(realcaption.L.lenient(F.col(text)))})
    rows = rows.withColumn("plan", realcaption.resolve(F.col("plan"), ref, F.array(F.lit("add_noise"))))
    steps = realcaption.backbone(realcaption.scaffolds(F.transform(F.col("plan.steps"), lambda s: realcaption.filled_step(s, ref, F.col("plan.input_description"))), ref), ref)
    rows = rows.withColumn("steps", steps).withColumn("z", X.noise_of(L.ordered(F.col("steps")), F.col("length")))
    done = X.execute(F.col("steps"), F.col("length"), F.col("z"))
    return rows.withColumn("done", F.when(~L.rejected(F.col("plan")), done)).withColumns({"series": F.col("done.values"), "status": F.when(F.col("plan").isNull(), "parse_failure").when(F.col("done").isNull(), "rejected").when(F.col("done.error").isNotNull(), F.col("done.error")).otherwise("success")}).drop("done", "z")


# Sinks and a directory scan


def write_rows(rows: DataFrame, path: str, kind: str = "jsonl") -> None:
    """JSON Lines, CSV (arrays as JSON), or one JSON array or Markdown table for a report.

    A folder of any store that Spark writes to. A report is one file, so one task writes it, row by row.
    """
    if kind == "jsonl":
        rows.write.mode("overwrite").json(path)
    elif kind == "csv":
        flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in rows.dtypes]
        rows.select(*flat).write.mode("overwrite").option("header", True).csv(path)
    elif kind in ("json", "markdown"):
        names = rows.columns
        lines = rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))
        # a row without value makes sure of one task, also where there are no rows
        lines = lines.unionByName(rows.sparkSession.range(1).select(F.lit(None).cast("string").alias("value"))).coalesce(1)

        def report(frames: Iterator) -> Iterator:
            import pandas as pd

            head = ["["] if kind == "json" else markdown(names, []).splitlines()
            first = True
            for frame in (f.dropna() for f in frames):
                if frame.empty:
                    continue
                if kind == "json":
                    body = [("  " if first and i == 0 else ", ") + v for i, v in enumerate(frame["value"])]
                else:
                    body = markdown(names, map(json.loads, frame["value"])).splitlines()[2:]
                yield pd.DataFrame({"value": head + body if first else body})
                first = False
            yield pd.DataFrame({"value": (head if first else []) + (["]"] if kind == "json" else [])}, dtype=str)

        lines.mapInPandas(report, "value string").write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown kind {kind}")


def markdown(columns: list[str], body: Iterable[dict]) -> str:
    line = lambda cells: "| " + " | ".join(str(c).replace("|", "\\|") for c in cells) + " |\n"
    return line(columns) + line(["---"] * len(columns)) + "".join(line([r.get(c, "") for c in columns]) for r in body)


def read_case_folders(spark: SparkSession, path: str, name: str = "record.json") -> DataFrame:
    """One JSON record in a folder for each case; the folder names the case."""
    rows = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).json(path)
    return rows.withColumn("case_id", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


# Runs


def collect_outputs(saved: DataFrame, repair: bool = True, reject: bool = True) -> DataFrame:
    """Saved plans (``case_id, description, length, plan``), with the rejector and repair if asked, executed."""
    rows = saved.withColumn("given", F.to_json("plan"))
    if reject:
        rows = rows.withColumn("plan", W.reject(F.col("plan"), F.col("description"), F.col("length"), unsupported(F.col("description"))))
    if repair:
        rows = rows.withColumn("plan", W.repair(F.col("plan"), F.col("length"))["plan"])
    return X.run_plans(rows).withColumn("changed", F.to_json("plan") != F.col("given")).drop("given")


def benchmark(cases: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """Aggregate and failure taxonomy of evaluated cases."""
    results = S.evaluate_cases(cases)
    return S.aggregate_results(results, *keys), S.taxonomy(results.withColumn("labels", S.failure_labels(results)), "labels", *keys)


def research_run(cases: DataFrame, folder: str, variants: list[str]) -> dict[str, str]:
    """Evaluates ablation variants of the gold cases and writes their results, tables and a manifest."""
    from .baselines import run_ablation

    written = {}
    for v in variants:
        S.aggregate_results(run_ablation(cases, v), "variant").write.mode("overwrite").parquet(f"{folder}/{v}")
        written[v] = f"{folder}/{v}"
    cases.sparkSession.createDataFrame(list(written.items()), "variant string, path string").write.mode("overwrite").json(os.path.join(folder, "manifest"))
    return written


# Queries


@query("a05_grouped_cases", f"WITH {_RECORDS_SQL} SELECT dataset, length, case_id, row_number() OVER (PARTITION BY dataset, length ORDER BY case_id)::INT - 1 AS place FROM r WHERE j = 0")
def a05(spark, sf_dir):
    return grouped_cases(records(spark, sf_dir).where("j = 0").select("dataset", "length", "case_id"), "case_id", "dataset", "length")


@query("a06_loaded_series", "SELECT user_id AS case_id, CASE WHEN user_id % 3 = 0 THEN 1.0 WHEN user_id % 3 = 1 THEN 2.0 END::DOUBLE AS first FROM (SELECT DISTINCT user_id FROM events)")
def a06(spark, sf_dir):
    """Reports first, then files, else none."""
    cases = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("case_id")).distinct()
    one = lambda x: F.array(F.lit(x)).alias("values")
    return load_series(cases, cases.where("case_id % 3 = 0").select("case_id", one(1.0)), cases.where("case_id % 3 < 2").select("case_id", one(2.0))).select("case_id", F.get("series", F.lit(0)).alias("first"))


@query("a07_method_metrics", f"WITH {POINTS_SQL}, q AS (SELECT user_id % 4 AS dataset, user_id, v AS r, CASE WHEN user_id % 5 <> 0 THEN v + (t % 3) END AS g FROM p), m AS (SELECT dataset, user_id, avg((g - r) * (g - r)) AS mse, avg(abs(g - r)) AS mae FROM q WHERE g IS NOT NULL GROUP BY ALL), c AS (SELECT dataset, count(DISTINCT user_id) AS cases FROM q GROUP BY dataset) SELECT c.dataset, cases, {rounded_sql('count(m.user_id) / any_value(cases)::DOUBLE')} AS success_rate, {rounded_sql('avg(mse)')} AS mean_mse, {rounded_sql('quantile_cont(mae, 0.5)')} AS median_mae FROM c LEFT JOIN m ON m.dataset = c.dataset GROUP BY c.dataset, cases")
def a07(spark, sf_dir):
    """Metrics of a method by dataset, failed cases in the rate."""
    rows = points(user_series(spark, sf_dir), "user_id").select((F.col("user_id") % 4).alias("dataset"), F.col("user_id").alias("case_id"), F.when(F.col("user_id") % 5 != 0, F.col("v") + F.col("t") % 3).alias("g"), F.col("v").alias("r"))
    out = method_metrics(rows, "dataset")
    return out.select("dataset", "cases", *(rounded(F.col(c)).alias(c) for c in ("success_rate", "mean_mse", "median_mae")))


@query("a08_native_generation", f"WITH {POINTS_SQL}, s AS (SELECT user_id % 4 AS dataset, t, min(v) AS low, max(v) AS high FROM p GROUP BY ALL), g AS (SELECT p.user_id, p.t, v AS r, 0.5::DOUBLE * (high - low) + low AS g FROM p JOIN s ON s.dataset = p.user_id % 4 AND s.t = p.t) SELECT user_id AS case_id, {rounded_sql('sqrt(avg((g - r) * (g - r)))')} AS rmse, sqrt(avg((g - r) * (g - r))) / greatest(max(r) - min(r), 1e-8) <= 0.1 AS aligned FROM g GROUP BY user_id")
def a08(spark, sf_dir):
    rows = points(user_series(spark, sf_dir), "user_id").select(F.col("user_id").alias("case_id"), (F.col("user_id") % 4).alias("dataset"), "t", F.col("v").alias("r"))
    scales = rows.groupBy("dataset", "t").agg(F.min("r").alias("low"), F.max("r").alias("high"))
    out = native_generation(rows.select("case_id", "dataset", "t", F.lit(0.5).alias("v")), scales, rows.select("case_id", "t", "r"))
    return out.select("case_id", rounded(F.col("rmse")).alias("rmse"), "aligned")


@query("a12_summary", f"WITH {_RECORDS_SQL} SELECT count(*) AS cases, count(score) AS successful, count(*) FILTER (status = 'missing_series') AS missing, count(*) FILTER (status = 'evaluation_error') AS failed, {rounded_sql('avg(score)')} AS mean, {rounded_sql('quantile_cont(score, 0.5)')} AS median FROM r")
def a12(spark, sf_dir):
    out = summary(records(spark, sf_dir))
    return out.select("cases", "successful", "missing", "failed", rounded(F.col("mean")).alias("mean"), rounded(F.col("median")).alias("median"))


@query("a16_reliability", f"WITH u AS (SELECT user_id % {len(S.CASES)} AS k FROM (SELECT DISTINCT user_id FROM events)) SELECT 1.0::DOUBLE AS schema_valid, 1.0::DOUBLE AS executable, 1.0::DOUBLE AS safe_code, 1.0::DOUBLE AS failure_report_complete")
def a16(spark, sf_dir):
    return reliability(S.evaluate_cases(S.gold_cases(spark, sf_dir))).select("schema_valid", "executable", "safe_code", "failure_report_complete")


_GATED = [
    {"ours_pass": 0.9, "direct_pass": 0.5, "ours_csr": 0.95, "direct_csr": 0.6, "direct_hus": 0.8, "full_csr": 1.0, "no_registry_csr": 0.1, "repair_pass": 0.9, "no_repair_pass": 0.1, "changed": 3.0, "ours_crr": 1.0, "ours_hus": 0.0, "no_rejection_hus": 1.0, "rule_csr": 0.5, "ours_adversarial": 0.9, "rule_adversarial": 0.4, "ours_compositional": 0.5, "rule_compositional": 0.5, "drift": 0.0, "inside": 0.2, "seconds": 0.1, "public_done": 0.0, "public_known": 2.0},
    {"ours_pass": 0.6, "direct_pass": 0.5, "ours_csr": 0.5, "direct_csr": 0.6, "direct_hus": 0.2, "full_csr": 0.5, "no_registry_csr": 0.1, "repair_pass": 0.9, "no_repair_pass": 0.1, "changed": 0.0, "ours_crr": 0.5, "ours_hus": 0.3, "no_rejection_hus": 1.0, "rule_csr": 0.6, "ours_adversarial": 0.1, "rule_adversarial": 0.4, "ours_compositional": 0.5, "rule_compositional": 0.5, "drift": None, "inside": 0.2, "seconds": None, "public_done": 1.0, "public_known": 2.0},
]
_VERDICTS = ["supported supported supported supported partial partial partial partial", "not_supported not_supported not_supported not_supported not_supported pending pending supported"]


@query("a18_evidence_gates", f"SELECT user_id, [{', '.join(repr(v) for v in _VERDICTS)}][1 + user_id % 2] AS verdicts FROM (SELECT DISTINCT user_id FROM events)")
def a18_all(spark, sf_dir):
    """The eight gates over metrics that users get by their ids."""
    table = spark.createDataFrame([(i, *m.values()) for i, m in enumerate(_GATED)], "k int, " + ", ".join(f"{c} double" for c in _GATED[0]))
    out = gates(table.where("k = 0")).withColumn("k", F.lit(0)).unionByName(gates(table.where("k = 1")).withColumn("k", F.lit(1)))
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct().withColumn("k", (F.col("user_id") % 2).cast("int"))
    return users.join(F.broadcast(out), "k").select("user_id", F.concat_ws(" ", *(f"h{i}" for i in range(1, 9))).alias("verdicts"))


@query("a21_screening", f"WITH {_RECORDS_SQL}, z AS (SELECT dataset, case_id, raw FROM x WHERE j = 0), y AS (SELECT *, (case_id * 7 % 13) / 10.0::DOUBLE - raw AS severity, row_number() OVER (PARTITION BY dataset ORDER BY (case_id * 7 % 13) / 10.0::DOUBLE - raw DESC, case_id) AS turn FROM z), w AS (SELECT *, row_number() OVER (ORDER BY (turn <> 1)::INT, severity DESC, case_id) AS place FROM y) SELECT case_id, place::INT AS place FROM w WHERE place <= 6")
def a21(spark, sf_dir):
    """The six most telling cases (a top-k report), each dataset's worst first."""
    rows = records(spark, sf_dir).where("j = 0")
    raw = ((F.col("case_id") * 37 + F.col("n") * 11) % 101) / 100.0
    return screening(rows.select("dataset", "case_id", raw.alias("ours"), ((F.col("case_id") * 7 % 13) / 10.0).alias("worst")), 6).select("case_id", "place")


examples("a22_match_scores", [("flat,spike", "flat,spike"), ("flat,spike", "spike,flat"), ("flat", "spike"), ("", "")], ["1.0 1.0 1.0 true", "1.0 1.0 1.0 false", "0.0 0.0 0.0 false", "0.0 0.0 1.0 true"], lambda e, u: let(primitive_match(F.filter(F.split(e, ","), lambda x: x != ""), F.filter(F.split(u, ","), lambda x: x != "")), lambda m: F.concat_ws(" ", *(m[k].cast("string") for k in ("precision", "recall", "f1", "exact")))))


@query("a24_benchmark", f"SELECT count(*) AS cases, {rounded_sql(f'avg((user_id % {len(S.CASES)} IN (0, 1, 5))::INT)')} AS pass_rate FROM (SELECT DISTINCT user_id FROM events)")
def a24(spark, sf_dir):
    rows, _ = benchmark(S.gold_cases(spark, sf_dir))
    return rows.select("cases", rounded(F.col("pass_rate")).alias("pass_rate"))


@query("o02_collected_outputs", "SELECT user_id, CASE user_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'rejected' ELSE 'ok' END AS execution FROM (SELECT DISTINCT user_id FROM events)")
def o02(spark, sf_dir):
    """Saved plans through rejector and repair, executed."""
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    damaged = plan({**FLAT, "effect_type": "additive"}, SPIKE, length=41)
    text = F.when(F.col("user_id") % 3 == 2, damaged).otherwise(plan(FLAT, SPIKE))
    rows = users.withColumns({"description": F.when(F.col("user_id") % 3 == 1, "A mean-reverting path.").otherwise("A flat path with one bump."), "length": F.lit(40), "plan": F.from_json(text, L.PLAN)})
    return collect_outputs(rows).select("user_id", "execution")


@query("a14_reprocessed", "SELECT user_id, CASE user_id % 2 WHEN 0 THEN 'success' ELSE 'parse_failure' END AS status FROM (SELECT DISTINCT user_id FROM events)")
def a14(spark, sf_dir):
    """Saved planner answers, re-read and executed against their references."""
    rows = user_series(spark, sf_dir).withColumn("text", F.when(F.col("user_id") % 2 == 0, "Answer: " + plan(step("add_spike", timestep=7, amplitude=3))).otherwise("no answer"))
    return reprocess(rows, reference="values").select("user_id", "status")
