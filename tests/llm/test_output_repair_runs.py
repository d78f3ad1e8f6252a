"""Token shards, conversation repair and periodic runs against plain Python; nulls, ties, empty tables, clashing names."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strandline.llm import repair, runs, tokens

WORD = r"[^\x20\x09-\x0D]+"
DOCS = "doc_id long, text string, content string, part string, start string, id string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["a", "bb", "Étion", "x,y", "12", "don't", "\n", "<|endoftext|>", "  ", " z", "日本 語"]) for _ in range(rng.randint(0, 80))) for _ in range(90)]
    texts += [None, "", " ", " \n ", "one", "tail  ", "a b " * 4000, "x" * 20_000, "well " + "say it " * 7 + "end", "a a a a a a b " + "x y z " * 4 + "x", "a\t b　 c  d"]
    rows = [(i if i % 9 else None, t, "clash", "clash", "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[3], rows[3], (5, "another of the same id", *["clash"] * 4)], DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def plain():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    return library


def test_token_shards_round_trip(spark, docs, plain, tmp_path):
    tokens.write_shards(docs, str(tmp_path / "s"), public_tokenizers.path("byte_bpe_50k.json"), shard_tokens=700)
    expected = sorted((-1 if r["doc_id"] is None else r["doc_id"], tuple([*plain.encode(r["text"] or "", add_special_tokens=False).ids, 0])) for r in docs.collect())
    got = tokens.read_tokens(spark, str(tmp_path / "s")).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], tuple(r["tokens"])) for r in got) == expected
    rows = sorted(tokens.read_documents(spark, str(tmp_path / "s")).collect(), key=lambda r: r["start"])
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in rows]
    assert ids == sorted(ids) and len(rows) == docs.count()
    assert [r["start"] for r in rows] == [0, *np.cumsum([r["n_tokens"] for r in rows])[:-1]]
    sums = sorted((i, len(t), zlib.crc32(np.array(t, "<u4").tobytes())) for i, t in expected)
    assert sorted((i, r["n_tokens"], r["ids_crc32"]) for i, r in zip(ids, rows)) == sums
    files = list((tmp_path / "s").glob("*.txt"))
    assert len(files) > 5 and all(f.read_bytes().startswith(tokens.MAGIC) for f in files)
    wanted = [0, plain.encode("a").ids[0], 49_999]
    found = tokens.token_occurrences(spark, str(tmp_path / "s"), wanted).collect()
    assert sorted((r["token"], -1 if r["doc_id"] is None else r["doc_id"], r["position"]) for r in found) == sorted((w, i, k) for w in wanted for i, t in expected for k, x in enumerate(t) if x == w)


def test_token_shards_of_an_empty_table(spark, none, tmp_path):
    tokens.write_shards(none, str(tmp_path / "s"), public_tokenizers.path("byte_bpe_50k.json"))
    assert tokens.read_documents(spark, str(tmp_path / "s")).count() == 0


@pytest.mark.parametrize(("size", "values"), [(0, 1), (1, 1), (511, 2), (512, 9), (513, 60_000), (5000, 40)])
def test_wavelet(size, values):
    ids = np.random.default_rng(size).integers(0, values, size).astype(np.uint32)
    shard = tokens.Shard(tokens.pack_shard(1, 2, 3, [None, 7], np.array([0, size]), ids))
    assert shard.ids == [None, 7] and (shard.wavelet.tokens() == ids).all() and (shard.wavelet.access(np.arange(size)) == ids).all()
    for t in [*range(min(values, 45)), 1 << 20]:
        assert (shard.wavelet.occurrences(t) == np.flatnonzero(ids == t)).all()
        assert shard.wavelet.count(t, size // 3, size) == (ids[size // 3 :] == t).sum()


def test_remembered_pieces_change_nothing(plain, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tokens, "KNOWN_BYTES", 200)
    own = tokens.Tokenizer(plain.to_str())
    rng = random.Random(1)
    for _ in range(20):
        texts = ["".join(rng.choice(["ab", " ", "'s", "\n", "é", " q", "9"]) for _ in range(60)) for _ in range(5)]
        ids, first = own.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == [plain.encode(t).ids for t in texts]
    broken = pa.Array.from_buffers(pa.string(), 1, [None, pa.py_buffer(np.array([0, 4], np.int32)), pa.py_buffer(b"a \xff ")])
    assert own.encode(broken)[0].tolist() == plain.encode("a � ").ids


def test_words_are_learnt_without_their_marks():
    """Words are remembered apart from marks and line feeds beside them, and texts get the library's own ids."""
    import pyarrow as pa

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        definition = file.read()
    own, library = tokens.Tokenizer(definition), Tokenizer.from_str(definition)
    library.encode_special_tokens = True
    word = ["alpha", "añb", "ñandú", "x7"]
    own.encode(pa.array([" " + w + mark + " " + w for w in word for mark in (",", ".", "!", "%%%", "-", ".)", ").\n" + w)]))
    assert len(own.known) < 20
    own.forget()
    signs = ["a", "Z", "s", "t", "ll", "'", "'s", ".", ",", "%%%", "-", "7", " ", "  ", "\n", "\n\n", "\t", "\r", "é", "ñ", "×", "÷", "Ā", "ſ", "ƀ", "ª", "\u00a0", "\u0301", "日", "😀", "<|endoftext|>", "\x00", "\x85", "\u3000"]
    rng = random.Random(3)
    for _ in range(40):
        texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(14))) for _ in range(200)]
        ids, first = own.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


# ---------------------------------------------------------------- repair

FOLLOW = {"": "su", "s": "u", "u": "a", "a": "u"}


def cheapest(rows):
    """All edits of a short conversation, tried one by one."""
    best = []

    def go(i, last, cost, audit, out, inserted):
        if i == len(rows) and last in ("", "a"):
            best.append((cost, audit, out))
        for initial in FOLLOW[last]:
            role = {"u": "user", "a": "assistant"}.get(initial)
            if role and inserted < 2:
                go(i, initial, cost + 5, audit + "I", [*out, (role, "")], inserted + 1)
            if i < len(rows) and rows[i][2] not in ("blank", "duplicate"):
                late = 5 * (rows[i][2] == "truncated")
                if rows[i][0][:1] == initial:
                    go(i + 1, initial, cost + late, audit + "K", [*out, rows[i][:2]], 0)
                if role:
                    go(i + 1, initial, cost + late + 1, audit + "R", [*out, (role, rows[i][1])], 0)
        if i < len(rows):
            go(i + 1, last, cost + 2, audit + "D", out, 0)

    go(0, "", 0, "", [], 0)
    return min(best, key=lambda b: b[:2])


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        fault = None
        if not re.search(WORD, text):
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        elif not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text):
            fault = "truncated"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def test_repair_of_short_conversations():
    rng = random.Random(4)
    for _ in range(400):
        rows = [(rng.choice(["user", "assistant", "system", "tool", ""]), f"t{k}", rng.choice([None, None, "blank", "duplicate", "truncated"])) for k in range(rng.randint(0, 5))]
        search = repair.Repair()
        for row in rows:
            search.turn(*row)
        cost, digest, steps = search.end()
        best = cheapest(rows)
        assert (cost, "".join(steps)) == best[:2] and len(steps) == len(rows) + 1
        assert digest == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in best[2]).encode()).hexdigest()


def test_repair_of_long_conversations():
    rng = random.Random(6)
    for roles in (["user"], ["system"], ["user", "assistant"], ["user", "assistant", "system", "tool"]):
        search = repair.Repair()
        layer = {"": (0, ""), "u": (5, "I"), "a": (10, "II")}
        for k in range(1500):
            role, fault = roles[k % len(roles)] if rng.random() < 0.8 else rng.choice(roles), rng.choice([None] * 6 + ["blank", "truncated"])
            search.turn(role, "t", fault)
            offers = []
            for last, (cost, audit) in layer.items():
                offers.append((last, (cost + 2, audit + "D")))
                for initial in FOLLOW[last] if fault != "blank" else "":
                    late = cost + 5 * (fault == "truncated")
                    offers += [(initial, (late, audit + "K"))] * (role[:1] == initial) + [(initial, (late + 1, audit + "R"))] * (initial in "ua")
            for last, follows in (("", "u"), ("s", "u"), ("a", "u"), ("u", "a")):
                offers += [(follows, (c + 5, a + "I")) for before, (c, a) in offers if before == last]
            layer = {last: min(v for k, v in offers if k == last) for last in {k for k, _ in offers}}
        cost, _, steps = search.end()
        assert (cost, "".join(steps)) == min(v for k, v in layer.items() if k in ("", "a"))


@pytest.fixture(scope="module")
def chats(spark):
    rng = random.Random(9)
    roles, texts = ["user", "assistant", "system", None, "", "tool"], ["Yes.", "No!", "cut off", None, "", " \n", "a?b", "end. \t"]
    rows = [(rng.choice([None, *range(12)]), rng.choice([None, *range(5)]), rng.choice(roles), rng.choice(texts), "clash", "clash", 1) for _ in range(60)]
    return spark.createDataFrame([*rows, rows[0], rows[0]], "conv_id long, turn long, role string, text string, fault string, gone string, place int").cache()


def test_repair_against_brute_force(spark, chats):
    by = {}
    for r in chats.collect():
        role, text = (" " if v is None else v for v in (r["role"], r["text"]))
        by.setdefault(r["conv_id"], []).append((r["turn"] is not None, r["turn"] or 0, role, text))
    expected, repaired = {}, {}
    for conv, rows in by.items():
        rows = sorted(rows)
        judged = faults([r[2:] for r in rows])
        known = [r[1] for r in rows if r[0]]
        cost, audit, out = cheapest(judged) if len(judged) < 7 else (None, None, None)
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        counts = [sum(j[2] == f for j in judged) for f in ("blank", "duplicate", "truncated")]
        expected[conv], repaired[conv] = ([gaps, *counts, illegal], cost, audit), out
    got = repair.repair_summary(chats).collect()
    assert {r["conv_id"] for r in got} == set(by) and len(got) == len(by)
    turns = {}
    for r in sorted(repair.repaired_turns(chats).collect(), key=lambda r: r["position"]):
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    for r in got:
        counts, cost, audit = expected[r["conv_id"]]
        assert [r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"]] == counts
        out = turns.get(r["conv_id"], [])
        assert cost is None or (r["cost"], r["audit"], out) == (cost, audit, repaired[r["conv_id"]])
        assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for role, _ in out))
        assert r["repaired_sha256"] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest()
    assert repair.repair_summary(chats.limit(0)).count() == 0 == repair.repaired_turns(chats.limit(0)).count()


def test_repair_query_and_its_sql(chats, spark, tmp_path):
    chats.select("conv_id", "turn", "role", "text").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(map(tuple, repair.op12_conversation_repair(spark, str(tmp_path)).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert got == sorted(con.execute(repair.OP12_SQL).fetchall(), key=str)


# ---------------------------------------------------------------- runs


def plain_runs(w, repeats=4, least=6):
    found = {}
    for p in range(1, len(w) // repeats + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(least, repeats * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def collapsed(w, found):
    gone = {k for s, n, p in found for k in range(s + p, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def test_runs_of_random_words():
    rng = random.Random(5)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 6)):
            few = rng.choice([1, 2, 3, 30])
            w = [rng.randrange(few) for _ in range(rng.randint(0, 40))]
            unit = [rng.randrange(few) for _ in range(rng.randint(1, 7))]
            w[len(w) // 2 : len(w) // 2] = (unit * 9)[: rng.randint(0, len(unit) * 9)]
            texts.append(w)
        codes, first = np.array(sum(texts, []), np.int64), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        for repeats, least in ((4, 6), (2, 2), (3, 8)):
            got = [tuple(map(int, r)) for r in runs.find_runs(codes, first, repeats, least)]
            assert sorted(got) == sorted((s + f, s + n + f, p) for t, f in zip(texts, first.tolist()) for s, n, p in plain_runs(t, repeats, least))


def test_runs_query_against_brute_force(spark, docs, none, tmp_path, monkeypatch):
    monkeypatch.setattr(runs, "_PAIRS", 500)
    docs.select("doc_id", "text").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    expected = []
    for r in docs.collect():
        w, name = re.findall(WORD, r["text"] or ""), "null" if r["doc_id"] is None else str(r["doc_id"])
        h = zlib.crc32(name.encode())
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        found = plain_runs(w)
        best = min(found, key=lambda f: (-f[1], f[0], f[2])) if found else None
        digest = [hashlib.sha256(t.encode()).hexdigest() for t in ("".join(f"{s},{n},{p}\n" for s, n, p in found), collapsed(w, found))]
        expected.append((r["doc_id"], len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *digest))
    got = runs.op13_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert sum(e[1] > 0 for e in expected) > 2
    assert runs.periodic_runs(none).count() == 0
    kept = runs.periodic_runs(docs, reading=None).collect()
    assert len(kept) == docs.count() and all(r["n_words"] == 0 and r["collapsed"] == "" for r in kept if r["id"] == 91)

