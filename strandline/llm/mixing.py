"""Mixing sources to target weights by hash-threshold histograms (operator 6).

A document's position in its source's order is a hash of its id. Sizes are summed by source and hash
bucket; the bucket in which the running sum passes the budget is split again by the next bits of the
hash, until it holds one hash; where rows share that hash, as rows of one id do, a second hash, of their text and
place, splits them the same way. All documents below that threshold are taken once more than the whole
number of times that the budget asks of every document. Nothing is sorted and no document moves: a
filter on the hash decides. What the threshold leaves of the budget goes through the same search among
the documents that still fit it, until less than ``tolerance`` of the target is left or for ``rounds``
times (nested budgets).

Defined cases: null or empty text has size 0 and is taken 0 words; a null source is a source of its own,
the last; rows with equal ids, null ids among them, follow each other in the order of their texts' hashes and are
taken up to the budget like others, so which of several equal rows is taken is not defined, but how many are; a
null id hashes as the empty string; an empty table gives an empty result; other columns are ignored. The driver
holds one row for each source.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common, words

HASH_BITS = 60


def word_counts(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``size``, the number of `[^\\x20\\x09-\\x0D]+` in the whole text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.chunks(batch, "__text"):
                data, at = words.buffer_of(part.column("__text"))
                *_, first = words.word_table(data, at)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(first[1:] - first[:-1], pa.int64())], [*keep, "size"])

    common.bounded_batches(docs)
    rows = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = T.StructType([*(f for f in rows.schema if f.name != "__text"), T.StructField("size", T.LongType())])
    return rows.mapInArrow(count, schema)


def targets(sizes: dict[str | None, int], weights: Sequence[int], share: float, most: float) -> dict[str | None, float]:
    """Shares ``share`` of all sizes by weight; none above ``most`` times its own size, the rest reshared."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    cap = {s: most * sizes[s] for s in names}
    left, open_weight, level = share * sum(sizes.values()), sum(weight.values()), 0.0
    for s in sorted(names, key=lambda s: (cap[s] / weight[s], s is None, s or "")):
        level = left / open_weight
        if level <= cap[s] / weight[s]:
            break
        left, open_weight = left - cap[s], open_weight - weight[s]
    return {s: min(cap[s], level * weight[s]) for s in names}


def id_hash(column: str) -> Column:
    """60 bits of the md5 of the id as text; any engine with md5 can follow."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def tie_hash(text: str) -> Column:
    """60 bits that order rows of one id: a hash of the text, then one of the row's place in the input."""
    half = HASH_BITS // 2
    of_text, of_place = F.xxhash64(text), F.xxhash64(F.monotonically_increasing_id())
    return F.shiftleft(F.shiftrightunsigned(of_text, 64 - half), half) + F.shiftrightunsigned(of_place, 64 - half)


#: Rows by source up to which a table is sent to every task, some 10 MB.
_SMALL = 100_000


def _by_source(spark, rows: list[tuple], schema: str) -> DataFrame:
    table = spark.createDataFrame(rows, schema)
    return F.broadcast(table) if len(rows) <= _SMALL else table


def _thresholds(sized: DataFrame, budgets: list[tuple[str | None, float]], bits: int, column: str = "hash") -> dict[str | None, tuple[int, int, bool]]:
    """Per source the hash at which the running sum passes the budget, the sum below it, and whether rows share that hash.

    A level sums by source and bucket and keeps the one boundary bucket of each source; the next level
    reads only rows of boundary buckets. ``budgets`` has a row for each source, as the result has.
    """
    spark, found = sized.sparkSession, {}
    state = [(s, 0, 0, float(b)) for s, b in budgets if b > 0]
    shift = HASH_BITS
    while state and shift > 0:
        step = min(bits, shift)
        shift -= step
        known = _by_source(spark, state, "__source string, __prefix long, __below long, __budget double")
        rows = sized.join(known, F.col("__source").eqNullSafe(F.col("source")) & (F.shiftright(column, shift + step) == F.col("__prefix")))
        by_bucket = rows.groupBy("__source", "__below", "__budget", F.shiftright(column, shift).alias("bucket")).agg(F.sum("size").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"), (F.count("*") > 1).alias("shared"))
        running = F.sum("n").over(Window.partitionBy("__source").orderBy("bucket")) + F.col("__below")
        passed = by_bucket.withColumn("upto", running).where("upto > __budget").groupBy("__source").agg(F.min(F.struct("bucket", "upto", "n", "low", "high", "shared")).alias("b"))
        seen, state = state, []
        got = {r["__source"]: r["b"] for r in passed.collect()}
        for source, _, below, budget in seen:
            b = got.get(source)
            if b is None:
                found[source] = (1 << HASH_BITS, below, False)  # never passed: all fit
            elif b["low"] == b["high"]:
                found[source] = (b["low"], b["upto"] - b["n"], b["shared"])
            else:
                state.append((source, b["bucket"], b["upto"] - b["n"], budget))
    return found


def mix(docs: DataFrame, *, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, rounds: int = 8, tolerance: float = 0.001, bits: int = 10, id_col: str = "doc_id", text: str = "text", source: str = "source", keep: Sequence[str] = ()) -> DataFrame:
    """Rows ``id, source, size, source_size, target, copies, taken`` for every document, and its columns ``keep``.

    Only sums by source come to the driver (a row for each source). ``copies`` is how often the mix has
    the document, ``taken`` the words of them all.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(id_col).alias("id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"), *keep)
    sized = common.cut(word_counts(named.withColumn("tie", tie_hash("text")), "id", "source", "tie", *keep).withColumn("hash", id_hash("id")))
    sizes = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    target = targets(sizes, weights, share, most)
    whole = {s: int(t // n) if (n := sizes[s]) else 0 for s, t in target.items()}
    left = {s: target[s] - whole[s] * sizes[s] for s in target}
    rest, cuts = sized.where("size > 0"), []
    for _ in range(rounds):
        got = _thresholds(rest, list(left.items()), bits)
        shared = [(s, cut) for s, (cut, below, more) in got.items() if more and left[s] - below >= 1]
        ties = {}
        if shared:
            at = _by_source(spark, shared, "__s string, __cut long")
            tied = rest.join(at, F.col("__s").eqNullSafe(F.col("source")) & (F.col("hash") == F.col("__cut"))).select("source", "size", "tie")
            ties = _thresholds(tied, [(s, left[s] - got[s][1]) for s, _ in shared], bits, "tie")
        cuts.append({s: (got.get(s, (0,))[0], ties.get(s, (0,))[0], int(min(left[s], 1 << 62))) for s in left})
        left = {s: left[s] - got.get(s, (0, 0))[1] - ties.get(s, (0, 0))[1] for s in left}
        left = {s: b if b >= 1 and b > tolerance * target[s] else 0.0 for s, b in left.items()}
        if not any(left.values()):
            break
        fits = _by_source(spark, [(s, *cuts[-1][s][:2], b) for s, b in left.items()], "__s string, __cut long, __tie long, __left double")
        rest = rest.join(fits, F.col("__s").eqNullSafe(F.col("source"))).where("(hash > __cut or hash = __cut and tie >= __tie) and size <= __left").select("id", "source", "size", "hash", "tie")
    plan = _by_source(spark, [(s, sizes[s], target[s], whole[s], [c[s] for c in cuts]) for s in target], "__s string, source_size long, target double, __whole int, __cuts array<struct<cut:long,tie:long,fits:long>>")
    below = lambda c: (F.col("hash") < c["cut"]) | ((F.col("hash") == c["cut"]) & (F.col("tie") < c["tie"]))
    extra = F.exists("__cuts", lambda c: below(c) & (F.col("size") <= c["fits"]))
    rows = sized.join(plan, F.col("__s").eqNullSafe(F.col("source")))
    copies = F.col("__whole") + F.when((F.col("size") > 0) & extra, 1).otherwise(0)
    return rows.select("id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *keep)


def op6_source_mix(spark, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document (weights 3, 1, 2 by source, 150% in all, 2 times at most)."""
    rows = mix(common.table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def _oracle(rounds: int = 8, tolerance: float = 0.001) -> str:
    """The same rule with sorted running sums in place of histograms."""
    steps = [
        "sized AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END::BIGINT AS size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS hash FROM documents)",
        "sources AS (SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM sized GROUP BY source)",
        "filled AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS rest, sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS open_weight, 2.0::DOUBLE * source_size / weight AS fill FROM sources WINDOW w AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST))",
        "level AS (SELECT coalesce(arg_min(rest / open_weight, fill) FILTER (WHERE rest / open_weight <= fill), max(fill)) AS level FROM filled)",
        "goal AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, level * weight) AS target FROM filled, level)",
        "g0 AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END::BIGINT AS whole, target - CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END * source_size AS left_over FROM goal)",
        "d0 AS (SELECT s.*, FALSE AS extra FROM sized s)",
    ]
    for i in range(1, rounds + 1):
        steps += [
            f"c{i} AS (SELECT d.source, d.hash, d.size, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.hash) AS upto FROM d{i - 1} d JOIN g{i - 1} g ON d.source IS NOT DISTINCT FROM g.source WHERE NOT d.extra AND d.size > 0 AND d.size <= CASE WHEN {i} = 1 THEN 9e18 ELSE g.left_over END)",
            f"t{i} AS (SELECT g.source, coalesce(min(c.hash) FILTER (WHERE c.upto > g.left_over), 1152921504606846976) AS cut, coalesce(max(c.upto) FILTER (WHERE c.upto <= g.left_over), 0) AS spent FROM g{i - 1} g LEFT JOIN c{i} c ON c.source IS NOT DISTINCT FROM g.source GROUP BY g.source)",
            f"d{i} AS (SELECT d.doc_id, d.source, d.size, d.hash, d.extra OR (d.size > 0 AND g.left_over > 0 AND d.size <= g.left_over AND d.hash < t.cut) AS extra FROM d{i - 1} d JOIN g{i - 1} g ON d.source IS NOT DISTINCT FROM g.source JOIN t{i} t ON d.source IS NOT DISTINCT FROM t.source)",
            f"g{i} AS (SELECT g.source, g.source_size, g.target, g.whole, CASE WHEN g.left_over - t.spent >= 1 AND g.left_over - t.spent > {tolerance}::DOUBLE * g.target THEN g.left_over - t.spent ELSE 0 END AS left_over FROM g{i - 1} g JOIN t{i} t ON g.source IS NOT DISTINCT FROM t.source)",
        ]
    return f"WITH {', '.join(steps)} SELECT d.doc_id, d.size, g.source_size, g.target, ((g.whole + d.extra::INT) * d.size)::BIGINT AS taken FROM d{rounds} d JOIN g0 g ON d.source IS NOT DISTINCT FROM g.source"


OP6_SQL = _oracle()
