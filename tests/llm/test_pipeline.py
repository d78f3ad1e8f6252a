"""The pipeline as a whole: clashing names, empty tables, and its stages' decisions on planted rows; the mix where ids repeat."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import common, mixing

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "copies string, taken int, row_key string, `ROW_KEY_` int, __text string, __gone string, `__place` string, id string, size string, hash string, tie string, class_id int"


def prose(rng, n):
    vocabulary = {"en": ["the", "and", "of", "to", "is", "water", "house", "with"], "de": ["und", "der", "die", "nicht", "ist", "wasser", "haus", "mit"]}
    lang = rng.choice(["en", "de"])
    return lang, " ".join(rng.choice(vocabulary[lang]) + rng.choice(["", "", "a", "e", "er"]) + str(rng.randrange(40)) * (rng.random() < 0.3) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    made = [prose(rng, rng.randint(30, 90)) for _ in range(120)]
    rows = [(i if i % 10 else None, t, lang, f"s{i % 3}" if i % 7 else None, len(t)) for i, (lang, t) in enumerate(made)]
    leak = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows += [(200 + k, rows[50][1], "en", "s1", 9) for k in range(3)] + [(301, f"{rows[51][1]} {leak} {rows[52][1]}", "en", "s2", 9), (302, rows[53][1] + " fast", "en", "s0", 9)]
    passage = prose(rng, 45)[1]
    rows += [(400 + k, f"{prose(rng, 30)[1]} {passage} {prose(rng, 30)[1]}", "en", "s1", 9) for k in range(3)]
    rows += [(500, None, None, None, 0), (501, "", None, None, 0), (502, "1234 !!", None, None, 0), rows[5], rows[5]]
    out = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame(rows, COLUMNS).coalesce(2)
    docs.write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


@pytest.fixture(scope="module")
def plain(spark, folder):
    return corpus_pipeline.run(spark, folder)


def test_run_with_clashing_names(spark, folder, plain):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    own = {f.split()[0].strip("`"): f.split()[1] for f in CLASHING.split(", ")}
    clashing = docs.select("*", *(F.lit("7").cast(kind).alias(name) for name, kind in own.items()))
    mixed = corpus_pipeline.run_on(spark, clashing, folder)
    assert plain.columns == [*docs.columns, "copies", "taken"]
    assert mixed.columns == [*clashing.columns, "copies_", "taken_"]
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"], r["source"] or "")
    both = [sorted(((*key(r), r[c]) for r in df.collect()), key=str) for df, c in ((plain, "copies"), (mixed, "copies_"))]
    # equal rows differ in nothing but the key, which the mix does not read
    assert [r[:-1] for r in both[0]] == [r[:-1] for r in both[1]]
    assert all(str(r[c]) == "7" for r in mixed.collect() for c in own)


def test_run_catches_what_is_planted(spark, folder, plain):
    got = plain.collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    ids = {r["doc_id"] for r in got}
    assert not ids & {200, 201, 202, 301, 302, 500, 501, 502}
    texts = [r["text"] for r in got]
    windows = [tuple(w[i : i + 20]) for t in texts for w in [t.split()] for i in range(len(w) - 19)]
    assert len(windows) == len(set(windows))
    # clean documents stay whole, but for those that the mix leaves out
    clean = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 120]
    assert len(clean) > 70 and all(r["text"] == docs[r["doc_id"]]["text"] for r in clean)
    assert all(r["taken"] == r["copies"] * len(r["text"].split()) for r in got)


def test_empty_tables(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize(("texts", "ids"), [(lambda i: "a b c d", lambda i: 7), (lambda i: f"w{i} b c d", lambda i: None), (lambda i: f"w{i} b c d", lambda i: i // 50)])
def test_mix_of_repeated_ids(spark, texts, ids):
    rows = [(ids(i), texts(i), "shared") for i in range(100)] + [(1000 + i, "a b c d", "apart") for i in range(100)] + [(1, "x " * 50, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = common.cut(mixing.mix(docs))
    by = {r["source"]: r for r in got.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("size"), F.max("copies").alias("copies")).collect()}
    assert got.count() == len(rows)
    for r in by.values():
        assert 0 <= r["target"] - r["taken"] <= r["size"] and r["copies"] <= 2
    again = mixing.mix(docs.orderBy(F.desc("doc_id")))
    count = lambda df: sorted((r["source"] or "", r["copies"], r["n"]) for r in df.groupBy("source", "copies").agg(F.count("*").alias("n")).collect())
    assert count(got) == count(again)
