"""Edits and plans on series of any length, kept in blocks.

A step changes each point by its own value, its place and a few numbers of the whole series: values at the ends,
the center or an anchor, the mean of a window. So a plan runs in two passes. The first gathers the values at the
places that its steps name, a few points of a series, and resolves every step to plain numbers: what a step
reads there is what the steps before make of these few points. The second applies the resolved steps to the blocks,
each on its own. Window means that a step needs of a changed series are one aggregation each, in between.

Guards are flags of single points; the first of them, by step, stops a plan. Rows are dealt out by (key, block):
a key with half of all points is spread like any other.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import ORACLE_SQL, query, register
from ..functions import primitives as P
from ..functions.primitives import let
from ..plans import plan as L
from ..plans.execute import LARGEST
from ..plans.registry import ADD, PRIMITIVES, argument_error
from ..sources import blocks as B
from ..sources.series import rounded
from .plan_queries import planned, step
from .series_queries import CASES

NAMES = list(PRIMITIVES)
CODE = {n: k for k, n in enumerate(NAMES)}
#: Why a plan stops, in the order in which a step is tested.
ERRORS = ("additive_without_baseline", "invalid_primitive_args", "execution_failed", "numeric_range_explosion", "protected_constraint_violation")

_CONSTRAINTS = f"array<{L.CONSTRAINT}>"
RESOLVED = f"struct<op:int,a:bigint,b:bigint,p:double,q:double,r:double,s:double,kind:string,first:bigint,last:bigint,additive:boolean,missing:boolean,refused:int,mean:boolean,drawn:map<bigint,double>,held:{_CONSTRAINTS}>"


def _is(step: Column, *names: str) -> Column:
    return step["op"].isin(*(CODE[n] for n in names))


def point(step: Column, v: Column, i: Column, z: Column) -> Column:
    """A point after a resolved step; ``z`` is its unit normal where the step is noise."""
    k, length = i - step["a"], step["b"] - step["a"] + 1
    p, q, r, s = (step[c] for c in "pqrs")
    weight = F.when(r != 0, P.logistic_step(length, k)).otherwise(F.lit(1.0))
    line = P.linspace(p, q, length, k)
    forms = {
        ("add_trend",): v + F.coalesce(k * r, line),
        ("add_ramp",): line,
        ("add_flat", "add_plateau"): p,
        ("add_growth",): P.growth_curve(p, q, r, length, k),
        ("add_decay",): P.decay_curve(p, q, r, length, k),
        ("add_change_point",): v + weight * p + k * q,
        ("add_peak", "add_trough"): v + p * F.exp(-0.5 * F.pow((i - q) / r, 2)),
        ("add_spike", "add_dip"): v + p * (1 - F.abs(i - q) / (r + 1)),
        ("add_outlier",): F.coalesce(p, v + q),
        ("add_seasonality",): v + q + p * P.wave(step["kind"], 2 * math.pi * k / r + s),
        ("add_noise",): v + p * z,
        ("add_volatility",): p + (v - p) * r,
        ("add_level_shift",): v + p * weight,
        ("add_gap",): F.coalesce(p, F.lit(P.NAN)),
    }
    out = F.when((i < step["a"]) | (i > step["b"]), v)
    for names, form in forms.items():
        out = out.when(_is(step, *names), form)
    return out.otherwise(v)


def places(step: Column, n: Column) -> Column:
    """The timesteps whose values a step reads."""
    g = P.from_map(step["parameters"])
    a, b = P.interval(P.Length(n), g)
    name, at = step["primitive"], g("timestep").cast("long")
    anchor = F.coalesce(g("start_timestep"), g("anchor_timestep"), F.lit(0.0)).cast("long")
    wanted = (
        F.when(name.isin("add_ramp", "add_growth", "add_decay"), F.array(a.cast("long"), b.cast("long")))
        .when(name == "add_plateau", F.array(g("anchor_timestep").cast("long")))
        .when(name.isin("add_peak", "add_trough", "add_spike", "add_dip"), F.array(at))
        .when(name == "add_level_shift", F.array(anchor))
    )
    return F.coalesce(wanted, F.array().cast("array<bigint>"))


def _violates(c: Column, i: Column, v: Column, before: Column) -> Column:
    off = F.coalesce(F.isnan(v) | (F.abs(v - c["value"]) > F.coalesce(c["tolerance"], F.lit(1e-6))), F.lit(True))
    step = v - before
    against = F.when(c["direction"] == "nondecreasing", step < -1e-8).otherwise(step > 1e-8)
    return (
        F.when(c["kind"] == "constant_segment", (i >= c["start"]) & (i <= c["end"]) & off)
        .when(c["kind"] == "monotone_window", (i > c["start"]) & (i <= c["end"]) & F.coalesce(F.isnan(step) | against, F.lit(False)))
        .when(c["kind"] == "point_value", (i == c["timestep"]) & off)
        .otherwise(False)
    )


@dataclass
class Engine:
    """How plans run: with which guards (as ``plans.execute.fold``), and on blocks of which size."""

    size: int = B.SIZE
    guarded: bool = True
    gaps_allowed: bool = True
    protect: bool = True
    listed: bool = False

    def resolved(self, steps: Column, n: Column, base: Callable[[Column], Column], means: Column) -> Column:
        """Steps as plain numbers; ``base(t)`` is the series at a place before the first step.

        ``means`` maps the number of a step to the window mean that it scales around; a step whose mean is
        needed and not known yet is marked, and stands for no change.
        """
        length = P.Length(n)

        def one(done: Column, s: Column, j: Column) -> Column:
            bound = F.struct(P.typed(s["parameters"]).alias("g"), L.affected(s, n.cast("int")).alias("at"))
            return let(bound, lambda x: resolve(done, s, j, x))

        def resolve(done: Column, s: Column, j: Column, x: Column) -> Column:
            g, name = P.from_struct(x["g"]), s["primitive"]
            a, b = (c.cast("long") for c in P.interval(length, g))
            at = g("timestep").cast("long")
            anchored = F.coalesce(g("start_timestep"), g("anchor_timestep"), F.lit(0.0)).cast("long")
            reads = F.array(a, b, at, anchored, g("anchor_timestep").cast("long"))
            now = lambda t: F.when((t >= 0) & (t < n), F.aggregate(done, base(t), lambda v, d: point(d, v, t, F.coalesce(F.try_element_at(d["drawn"], t), F.lit(0.0)))))
            return let(F.transform(reads, now), lambda seen: numbers(done, s, j, x, seen, (a, b, at, anchored)))

        def numbers(done: Column, s: Column, j: Column, x: Column, seen: Column, where: tuple[Column, ...]) -> Column:
            g, name = P.from_struct(x["g"]), s["primitive"]
            a, b, at, anchored = where
            at_a, at_b, at_center, at_start, at_anchor = (F.get(seen, F.lit(k)) for k in range(5))
            change = F.coalesce(g("target_value") - at_center, g("amplitude"))
            width = F.greatest(F.coalesce(g("width"), g("half_width"), F.lit(0.0)), F.lit(0.0)).cast("int").cast("long")
            smooth, none = F.coalesce(g("smooth"), F.lit(0.0)), F.lit(None).cast("double")
            start = F.coalesce(g("start_value"), at_a)
            mean = F.coalesce(g("baseline"), F.try_element_at(means, j))
            pick = lambda table, other: F.coalesce(*[F.when(name.isin(*names.split()), c) for names, c in table.items()], other)
            waits = (name == "add_volatility") & mean.isNull()
            p = pick({
                "add_trend": F.coalesce(g("start_value"), g("start_offset")), "add_ramp add_growth add_decay": start, "add_flat add_outlier": g("target_value"),
                "add_plateau": F.coalesce(g("target_value"), at_anchor), "add_change_point": F.coalesce(g("level_change"), F.lit(0.0)), "add_peak add_spike": change, "add_trough add_dip": -F.abs(change),
                "add_seasonality": g("amplitude"), "add_noise": g("noise_scale"), "add_volatility": F.coalesce(mean, F.lit(0.0)), "add_level_shift": F.coalesce(g("target_value") - at_start, g("shift")), "add_gap": g("fill_value")}, none)
            q = pick({
                "add_trend": F.coalesce(g("end_value"), g("end_offset")), "add_ramp": F.coalesce(g("end_value"), start + g("slope") * (b - a)), "add_growth add_decay": F.coalesce(g("end_value"), at_b),
                "add_change_point": F.coalesce(g("slope_change"), F.lit(0.0)), "add_peak add_trough add_spike add_dip": at.cast("double"), "add_outlier": F.coalesce(g("relative_change"), g("delta")), "add_seasonality": F.coalesce(g("baseline"), F.lit(0.0))}, none)
            r = pick({
                "add_trend": g("slope"), "add_growth": F.coalesce(g("growth_rate"), F.lit(1.0)), "add_decay": F.coalesce(g("decay_rate"), F.lit(1.0)), "add_change_point add_level_shift": smooth,
                "add_peak add_trough": F.coalesce(g("width"), g("spread"), F.lit(1.0)), "add_spike add_dip": width.cast("double"), "add_seasonality": g("period"), "add_volatility": F.when(waits, 1.0).otherwise(g("volatility_scale"))}, none)
            held = F.coalesce(F.get(done, F.size(done) - 1)["held"], F.array().cast(_CONSTRAINTS)) if self.protect else F.array().cast(_CONSTRAINTS)
            if self.protect:
                held = F.concat(held, F.coalesce(s["protected_constraints"], F.array().cast(_CONSTRAINTS)))
            lost = F.exists(held, lambda c: (c["kind"] == "point_value") & ~F.coalesce((c["timestep"] >= 0) & (c["timestep"] < n), F.lit(False)))
            waveform = F.coalesce(L.param(s, "waveform"), F.lit("sine"))
            refused = F.coalesce(
                F.when(argument_error(name, s["parameters"]).isNotNull(), 1), F.when(P.value_error(name, length, g, waveform).isNotNull(), 2), F.when(lost, 4) if self.guarded else F.lit(None).cast("int"))
            event = name.isin("add_spike", "add_dip")
            step = F.struct(
                F.element_at(F.create_map(*[F.lit(y) for pair in CODE.items() for y in pair]), name).alias("op"),
                F.when(event, at - width).when(name == "add_outlier", at).when(name == "add_change_point", F.coalesce(g("anchor_timestep"), F.lit(0.0)).cast("long")).when(name == "add_level_shift", anchored).otherwise(a).alias("a"),
                F.when(event, at + width).when(name == "add_outlier", at).otherwise(b).alias("b"),
                p.alias("p"), q.alias("q"), r.alias("r"), F.coalesce(g("phase"), F.lit(0.0)).alias("s"), waveform.alias("kind"),
                x["at"]["start"].cast("long").alias("first"), x["at"]["end"].cast("long").alias("last"), (s["effect_type"] == ADD).alias("additive"),
                ((name == "add_gap") & (g("fill_value").isNull() | F.isnan(g("fill_value")))).alias("missing"), refused.alias("refused"), waits.alias("mean"), F.get("drawn", j).alias("drawn"), held.alias("held"))
            return F.array_append(done, step)

        numbered = F.transform(steps, lambda s, j: F.struct(s.alias("s"), j.alias("j")))
        return F.aggregate(numbered, F.array().cast(f"array<{RESOLVED}>"), lambda done, x: one(done, x["s"], x["j"]))

    def state(self, steps: Column, i: Column, v: Column, before: Column, monotone: Column, normals: Callable[[Column, Column], Column]) -> Column:
        """``struct<v, bad>`` of a point after all steps; ``bad`` is 8 times the step, plus the error, of its first flag.

        The point before goes through the steps too where a constraint asks for a ``monotone`` window.
        """
        zero = F.struct(v.alias("v"), before.alias("u"), F.lit(False).alias("touched"), F.lit(False).alias("gap"), F.lit(None).cast("int").alias("bad"), F.lit(0).alias("j"))

        def step(now: Column, s: Column) -> Column:
            inside = (i >= s["first"]) & (i <= s["last"])
            moved = F.struct(
                point(s, now["v"], i, normals(now["j"], i)).alias("v"), F.when(monotone, point(s, now["u"], i - 1, normals(now["j"], i - 1))).otherwise(now["u"]).alias("u"))
            return let(moved, lambda m: flagged(now, s, inside, m["v"], m["u"]))

        def flagged(now: Column, s: Column, inside: Column, v: Column, u: Column) -> Column:
            touched = now["touched"] | inside
            gap = (now["gap"] | (s["missing"] & inside)) if self.gaps_allowed else now["gap"]
            bad = F.when(s["refused"].isin(1, 2), s["refused"])
            if self.guarded:
                bare = s["additive"] & inside & ~now["touched"] & ~F.coalesce(F.abs(now["v"]) <= 1e-12, F.lit(False))
                finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
                wild = touched & F.when(finite, F.abs(v) > LARGEST).otherwise(~gap)
                broken = (s["refused"] == 4) | F.exists(s["held"], lambda c: _violates(c, i, v, F.when(i > 0, u)))
                bad = F.when(bare, 0).otherwise(F.coalesce(bad, F.when(wild, 3), F.when(F.coalesce(broken, F.lit(False)), 4)))
            return F.struct(v.alias("v"), u.alias("u"), touched.alias("touched"), gap.alias("gap"), F.coalesce(now["bad"], now["j"] * 8 + bad).alias("bad"), (now["j"] + 1).alias("j"))

        return F.aggregate(steps, zero, step, lambda x: F.struct(x["v"].alias("v"), x["bad"].alias("bad")))

    def applied(self, rows: DataFrame, key: str, values: Column, before: Column) -> DataFrame:
        """Blocks after the resolved ``steps`` of each row (``key, block, start, n, steps``), with the first flag of each."""
        monotone = F.exists(F.get("steps", F.size("steps") - 1)["held"], lambda c: c["kind"] == "monotone_window") if self.guarded else F.lit(False)
        rows = rows.withColumns({"__monotone": F.coalesce(monotone, F.lit(False)), "__values": values, "__before": before, "__noise": _normals_of("start", F.size(values), "states")})
        noise = lambda j, i: F.get(F.get("__noise", j), (i - F.col("start") + 1).cast("int"))
        previous = lambda k: F.when(k == 0, F.col("__before")).otherwise(F.get("__values", k - 1))
        states = F.transform("__values", lambda v, k: self.state(F.col("steps"), F.col("start") + k, v, previous(k), F.col("__monotone"), noise))
        done = rows.select(key, "block", "start", "n", states.alias("__states"))
        return done.select(key, "block", "start", "n", F.transform("__states", lambda x: x["v"]).alias("values"), F.array_min(F.transform("__states", lambda x: x["bad"])).alias("bad"))

    def run(self, plans: DataFrame, key: str, steps: Column, stored: DataFrame | None = None) -> DataFrame:
        """Blocks ``key, block, start, n, values, bad`` of each plan's series.

        ``plans`` has one row for each key, with ``n`` where ``stored`` blocks are not given: then series start from
        zeros. ``steps`` are applied in plan order, or as listed. A block's ``bad`` is null where no point of it stops the plan.
        """
        chosen = F.filter(steps, L.is_primitive) if self.listed else L.ordered(steps)
        if stored is not None:
            plans = B.joined(plans, stored.where("block = 0").select(key, "n"), [key])
        rows = plans.select(key, F.col("n").cast("long").alias("n"), chosen.alias("chosen"))
        rows, base = self._with_base(rows, key, stored)
        rows = rows.withColumn("means", F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<double>")))
        read = F.array_sort(F.array_distinct(F.flatten(F.transform("chosen", lambda s: places(s, F.col("n"))))))
        noise = _noise(F.transform("chosen", _seed), F.transform("chosen", lambda s: _drawn(s, F.col("n"))), F.filter(read, lambda t: t.isNotNull()), F.lit(self.size))
        rows = rows.withColumn("__noise", noise)
        rows = rows.withColumns({"states": F.transform("__noise", lambda x: x["states"]), "drawn": F.transform("__noise", lambda x: F.map_from_arrays(x["t"], x["z"]))}).drop("__noise")
        resolved = B.cut(rows.withColumn("steps", self.resolved(F.col("chosen"), F.col("n"), base, F.col("means"))))
        waiting = F.filter("steps", lambda s: s["mean"] & s["refused"].isNull())
        for _ in range(int(resolved.agg(F.max(F.size(waiting))).first()[0] or 0)):
            resolved = B.cut(self._next_mean(resolved, key, stored, base))
        return self._over_blocks(resolved, key, stored)

    def _with_base(self, rows: DataFrame, key: str, stored: DataFrame | None) -> tuple[DataFrame, Callable[[Column], Column]]:
        """The series before the first step at the places that steps read: zeros, or looked up block by block."""
        if stored is None:
            return rows, lambda t: F.lit(0.0)
        asked = rows.select(key, F.explode(F.array_distinct(F.flatten(F.transform("chosen", lambda s: places(s, F.col("n")))))).alias("t")).where(f"t >= 0 and t is not null")
        asked = asked.withColumn("block", F.floor(F.col("t") / self.size).cast("long"))
        found = B.joined(asked, stored.select(key, "block", "start", "values"), [key, "block"])
        known = found.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("t", F.get("values", (F.col("t") - F.col("start")).cast("int")).alias("v")))).alias("known"))
        return B.joined(rows, known, [key], "left"), lambda t: F.try_element_at(F.col("known"), t)

    def _over_blocks(self, resolved: DataFrame, key: str, stored: DataFrame | None) -> DataFrame:
        last = F.greatest(F.floor((F.col("n") - 1) / self.size), F.lit(0)).cast("long")
        each = resolved.select(key, "n", "steps", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"), "states")
        each = each.withColumn("states", F.transform("states", lambda s: F.get(s, F.col("block").cast("int"))))
        if stored is None:
            each = each.where("n > 0").repartition(F.col(key), F.col("block")).withColumn("start", F.col("block") * self.size)
            zeros = F.array_repeat(F.lit(0.0), F.least(F.lit(self.size).cast("long"), F.col("n") - F.col("start")).cast("int"))
            return self.applied(each, key, zeros, F.lit(0.0))
        rows = B.joined(B.with_borders(stored, key), each.select(key, "block", "steps", "states"), [key, "block"])
        return self.applied(rows, key, F.col("values"), F.col("before"))

    def _next_mean(self, resolved: DataFrame, key: str, stored: DataFrame | None, base: Callable[[Column], Column]) -> DataFrame:
        """Finds the window mean that the first waiting step of each plan scales around, and resolves again."""
        first = F.array_position(F.transform("steps", lambda s: s["mean"] & s["refused"].isNull()), True).cast("int") - 1
        rows = resolved.withColumn("__first", first)
        upto = rows.where("__first >= 0").withColumns({"window": F.get("steps", F.col("__first")), "steps": F.slice("steps", 1, F.col("__first"))})
        blocks = B.joined(self._over_blocks(upto, key, stored), upto.select(key, F.col("window.a").alias("__a"), F.col("window.b").alias("__b")), [key])
        inside = F.filter(F.slice("values", F.greatest(F.col("__a") - F.col("start"), F.lit(0)).cast("int") + 1, F.greatest(F.least(F.col("__b") - F.col("start"), F.size("values") - 1) - F.greatest(F.col("__a") - F.col("start"), F.lit(0)) + 1, F.lit(0)).cast("int")), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
        sums = blocks.select(key, F.aggregate(inside, F.lit(0.0), lambda a, v: a + v).alias("s"), F.size(inside).alias("c")).groupBy(key).agg(F.coalesce(F.try_divide(F.sum("s"), F.sum("c")), F.lit(0.0)).alias("__mean"))
        rows = B.joined(rows, sums, [key], "left")
        known = F.when(F.col("__first") >= 0, F.map_concat("means", F.create_map(F.col("__first"), F.coalesce("__mean", F.lit(0.0))))).otherwise(F.col("means"))
        rows = rows.withColumn("means", known).drop("__first", "__mean")
        return rows.withColumn("steps", self.resolved(F.col("chosen"), F.col("n"), base, F.col("means")))


def errors(blocks: DataFrame, key: str) -> DataFrame:
    """``key, error``: why a plan stops, null where it does not."""
    names = F.array(*map(F.lit, ERRORS))
    worst = blocks.groupBy(key).agg(F.min("bad").alias("bad"))
    return worst.select(key, F.get(names, F.col("bad") % 8).alias("error"))


# Seeded normals: a generator's stream has no random access, so one light pass notes its state at each block.


def _seed(step: Column) -> Column:
    return F.when(step["primitive"] == "add_noise", F.coalesce(L.number(step, "random_seed"), F.lit(7.0)).cast("long"))


def _drawn(step: Column, n: Column) -> Column:
    """First timestep of a step's noise and the number of its normals."""
    g = P.from_map(step["parameters"])
    a, b = P.interval(P.Length(n), g)
    return F.struct(a.cast("long").alias("a"), F.greatest(F.least(b, n - 1) - a + 1, F.lit(0)).cast("long").alias("count"))


_NOTED = T.StructType([T.StructField("states", T.ArrayType(T.StringType())), T.StructField("t", T.ArrayType(T.LongType())), T.StructField("z", T.ArrayType(T.DoubleType()))])


@F.pandas_udf(T.ArrayType(_NOTED))
def _noise(seeds, drawn, read, size):
    """Of each noise step its normals at the places ``read``, and for each block a place and the generator before it.

    That place is the point before the block, or the first that the noise touches.
    """
    import json

    import numpy as np
    import pandas as pd

    def noted(seed, a, count, places, width):
        generator, states, at, found = np.random.default_rng(int(seed)), [], a, {}
        for k in range(-(-(a + count) // width) + 1):
            first = min(max(a, k * width - 1), a + count)
            normals = generator.normal(0.0, 1.0, first - at)
            found |= {int(t): float(normals[t - at]) for t in places if at <= t < first}
            at = first
            if k * width < a + count:
                states.append(json.dumps([first, generator.bit_generator.state]))
        return {"states": states, "t": list(found), "z": list(found.values())}

    none = {"states": [], "t": [], "z": []}
    each = lambda x, y, p, w: none if x is None or x != x else noted(x, int(y["a"]), int(y["count"]), p, int(w))
    return pd.Series([None if s is None else [each(x, y, p, w) for x, y in zip(s, d)] for s, d, p, w in zip(seeds, drawn, read, size)])


def _normals_of(start: str, count: Column, states: str) -> Column:
    """The unit normals of a block's points for each step (one earlier point first), empty where it is no noise."""
    return F.when(F.exists(states, lambda s: s.isNotNull()), _draw(F.col(start), count, F.col(states))).otherwise(F.transform(states, lambda s: F.array().cast("array<double>")))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def _draw(start, count, states):
    import json

    import numpy as np
    import pandas as pd

    def normals(begin, n, noted):
        if noted is None:
            return []
        (first, state), generator = json.loads(noted), np.random.default_rng(0)
        generator.bit_generator.state = state
        out, skip = np.zeros(n + 1), min(n + 1, first - (begin - 1))
        out[skip:] = generator.normal(0.0, 1.0, n + 1 - skip)
        return out.tolist()

    return pd.Series([None if s is None else [normals(int(b), int(n), x) for x in s] for b, n, s in zip(start, count, states)])


# Queries: the same rows as those of the primitives and of plans on whole series.

#: Points in a block of the queries' series, which have some tens of points each.
_SHORT = 16
_CASES = ("p01_add_trend", "p02_add_ramp", "p04_add_growth", "p06_add_plateau", "p08_add_peak", "p11_add_dip", "p15_add_volatility", "p16_add_level_shift")


def _edited(name: str, arguments: dict):
    def run(spark, sf_dir):
        stored = B.cut(B.user_blocks(spark, sf_dir, _SHORT))
        steps = F.from_json(F.lit(json.dumps([step(name, **arguments)])), f"array<{L.STEP}>")
        plans = stored.where("block = 0").select("user_id", steps.alias("steps"))
        done = Engine(_SHORT, guarded=False, listed=True).run(plans, "user_id", F.col("steps"), stored)
        return B.points_of(done, "user_id").withColumn("v", rounded(F.col("v")))

    return run


for _name, _primitive, _arguments, _value in CASES:
    if _name in _CASES:
        register(f"{_name}_blocks", _edited(_primitive, _arguments), ORACLE_SQL[_name])


def _executed(spark, sf_dir) -> DataFrame:
    return B.cut(Engine(_SHORT).run(planned(spark, sf_dir), "user_id", F.col("plan.steps")))


@query("x01_execute_plan_blocks", ORACLE_SQL["x01_execute_plan"])
def x01_blocks(spark, sf_dir):
    """Plans from zeros over as many timesteps as a user has events, block by block."""
    done = _executed(spark, sf_dir)
    kept = B.joined(done, errors(done, "user_id").where("error is null").select("user_id"), ["user_id"])
    v = F.when(~F.isnan("v"), F.col("v"))
    return B.points_of(kept, "user_id").select("user_id", "t", rounded(v).alias("v"))


@query("x02_guards_blocks", ORACLE_SQL["x02_guards"])
def x02_blocks(spark, sf_dir):
    return errors(_executed(spark, sf_dir), "user_id")
