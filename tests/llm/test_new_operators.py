"""Manifest, periodic runs and quality: brute force, held-out labels, and the odd cases."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from compare import differences
from conftest import TINY
from pyspark.sql import functions as F

from flowsieve.llm import rule_quality as Q
from flowsieve.llm.merkle_manifest import climb, fold_proof, leaf_digest, merkle_manifest, proof_digest
from flowsieve.llm.periodic_runs import collapse, periodic_runs
from flowsieve.llm.queries import ORACLES, QUERIES

ODD_DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, periodic int, quality int, stats int, score int"


def odd_rows():
    long_text = " ".join(f"w{k % 97}" for k in range(60_000))
    return [
        (3, "a b c", "en", "s", 5, "x", 1, 1, 1, 1), (3, "a b c", "en", "s", 5, "x", 1, 1, 1, 1), (None, "lone", None, None, None, None, None, None, None, None),
        (1, None, "en", None, None, None, 2, 2, 2, 2), (2, "", None, "s", 0, "y", 2, 2, 2, 2), (4, long_text, "de", "s", len(long_text), "z", 2, 2, 2, 2),
        (5, "x y " * 9, "én", "s", 36, "z", 2, 2, 2, 2), (None, None, None, None, None, None, None, None, None, None),
    ]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels(leaves, arity):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][k : k + arity])) for k in range(0, len(out[-1]), arity)])
    return out


def sides(tree, index, arity):
    out = []
    for level in tree[:-1]:
        first = index // arity * arity
        out.append(("".join(level[first:index]), "".join(level[index + 1 : first + arity])))
        index //= arity
    return out


def brute_manifest(rows, arity):
    """rows (id, group, leaf) -> sorted (id, leaf, subroot, root, digest of the proof)."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    trees = {g: levels([r[2] for r in groups[g]], arity) for g in order}
    top = levels([trees[g][-1][0] for g in order], arity)
    out = []
    for k, g in enumerate(order):
        for i, row in enumerate(groups[g]):
            proof = "".join(a + b for a, b in sides(trees[g], i, arity) + sides(top, k, arity))
            out.append((row[0], row[2], trees[g][-1][0], top[-1][0], digest(proof)))
    return sorted(out, key=str)


@pytest.mark.parametrize("arity,height", [(2, 2), (3, 1), (2, 10)])
def test_manifest_against_brute_force(spark, arity, height):
    make = random.Random(arity)
    rows = [(make.choice([None, *range(40)]), make.choice([None, "", "a", "b", "é", "z" * 50]), digest(str(k))) for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, d string")
    found = merkle_manifest(docs, F.col("d"), arity=arity, levels=height)
    shown = found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")), (fold_proof(F.col("leaf"), F.col("proof")) == F.col("root")).alias("ok"))
    got = [tuple(r) for r in shown.collect()]
    assert all(r[-1] for r in got)
    assert sorted((r[:-1] for r in got), key=str) == brute_manifest(rows, arity)


def test_manifest_of_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(), ODD_DOCS)
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    found = merkle_manifest(docs, leaf_digest(*map(F.col, fields)), carried={"other": F.col("score")})
    expected = brute_manifest([(r[0], r[2], digest("".join(map(field, (r[0], r[3], r[2], r[4], r[1]))))) for r in odd_rows()], 2)
    got = found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")))
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected
    assert merkle_manifest(docs.where("false"), F.col("leaf")).count() == 0
    lone = merkle_manifest(docs.where("doc_id = 4"), F.col("leaf")).first()
    assert (lone["subroot"], lone["root"], lone["proof"]) == ("z", "z", [])


def test_tampering_is_seen(spark):
    top, proofs = climb([digest(str(k)) for k in range(5)], 3, 2)
    rows = [(digest(str(k)), proof) for k, proof in enumerate(proofs)] + [(digest("x"), proofs[0])]
    folded = spark.createDataFrame(rows, "leaf string, proof array<struct<left: string, right: string>>")
    assert [r[0] == top for r in folded.select(fold_proof(F.col("leaf"), F.col("proof"))).collect()] == [True] * 5 + [False]


def brute_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            first = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - first + q >= max(12, 2 * q):
                found.setdefault((first, i - first + q), q)
            i += 1
    gone = {k for (s, length), q in found.items() for k in range(s + q, s + length)}
    runs = sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))
    return runs, " ".join(w for k, w in enumerate(words) if k not in gone)


def regular_text(make):
    kind, letters = make.randint(0, 4), "abcd"[: make.randint(1, 4)]
    words = [make.choice(letters) for _ in range(make.choice([0, 1, 5, 12, 13, 24, 40, 90, 150]))]
    if kind == 1 and words:
        a = make.randrange(len(words))
        p = 1 + (len(words) - a) // make.randint(2, 9)
        words = [words[k] if k < a else words[a + (k - a) % p] for k in range(len(words))]
    if kind == 2:
        unit = [make.choice("abcdefgh") for _ in range(make.randint(1, 9))]
        words = words + unit * make.randint(2, 6) + words[:5] + unit * 3
    if kind == 3:  # the words of Fibonacci, full of runs inside runs
        a, words = ["a"], ["a", "b"]
        for _ in range(make.randint(2, 8)):
            a, words = words, words + a
    return words


def test_runs_against_brute_force():
    make = random.Random(8)
    for _ in range(60):
        texts = [regular_text(make) for _ in range(make.randint(1, 6))]
        joined = [make.choice([" ", "\n", " \t", "\r\n"]).join(words) for words in texts]
        counts, runs, kept = collapse(pa.array([*joined, None], pa.string()))
        for words, n, found, text in zip([*texts, []], counts, runs.to_pylist(), kept.to_pylist(), strict=True):
            shown = [(r["start"], r["length"], r["period"]) for r in found]
            assert (n, (shown, text)) == (len(words), brute_runs(words))


def test_runs_of_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(), ODD_DOCS)
    found = periodic_runs(docs)
    assert found.columns == [c for c in docs.columns if c not in ("text", "periodic")] + ["periodic"]
    by_id = {r["doc_id"]: r["periodic"] for r in found.where("doc_id IS NOT NULL").collect()}
    assert found.count() == len(odd_rows())
    assert [tuple(r) for r in by_id[4]["runs"]] == [(0, 60_000, 97)] and by_id[4]["collapsed"].count(" ") == 96
    assert [tuple(r) for r in by_id[5]["runs"]] == [(0, 18, 2)] and by_id[5]["collapsed"] == "x y"
    assert tuple(by_id[1]) == tuple(by_id[2]) == (0, [], "")
    assert periodic_runs(docs.where("false")).count() == 0


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_periodic_runs"])
def test_queries_against_sql(spark, name):
    assert differences(spark, TINY, QUERIES[name], ORACLES[name]) == ""


def test_statistics_by_hand():
    text = "Go go go!!! |\nSTOP no. No"
    row = dict(zip(Q.STATISTICS, Q.statistics(pa.array([None, text, ""], pa.string()))[1], strict=True))
    assert row["words"] == 7 and row["line_words"] == 3.5 and row["word_bytes"] == 19 / 7
    assert row["upper"] == 6 / 14 and row["symbols"] == 5 / 19 and row["odd_symbols"] == 4 / 19
    assert row["bare_words"] == 1 / 7 and row["doubled_ends"] == 1 / 7 and row["sentence_ends"] == 2 / 7
    assert row["repeats"] == 0 and row["longest_repeat"] == 1 and row["distinct"] == 1
    again = dict(zip(Q.STATISTICS, Q.statistics(pa.array(["go go go no"]))[0], strict=True))
    assert again["repeats"] == 0.5 and again["longest_repeat"] == 3 and again["distinct"] == 0.5 and again["worst_repeats"] == 0.5
    assert not Q.statistics(pa.array([None, ""], pa.string())).any()


def test_whole_text_counts():
    """What stands at the end of a long text changes its statistics as what stands at its start."""
    good, bad = " ".join(f"word{k}" for k in range(5000)), "HE " * 400
    table = Q.statistics(pa.array([good, good + " " + bad, bad + good]))
    k = Q.STATISTICS.index("worst_repeats")
    assert table[0, k] == 0 and table[1, k] > 0.9 and table[2, k] > 0.9


def test_rules_say_the_same_in_spark_and_numpy(spark):
    table = np.random.default_rng(4).random((400, len(Q.STATISTICS)))
    label = ((table[:, 3] > 0.3) & (table[:, 9] <= 0.8)).astype(float)
    model = Q.fit(table, label)
    assert ((model.score(table) >= 0.5) == (label == 1)).mean() > 0.95
    assert 0 < len(model.rules) < len(Q.tree_rules(table, label))  # the lasso leaves rules out
    rows = spark.createDataFrame([tuple(map(float, r)) for r in table], ", ".join(f"{s} double" for s in Q.STATISTICS))
    got = [r[0] for r in rows.select(model.column(F.struct(*Q.STATISTICS))).collect()]
    assert np.allclose(got, model.score(table))


def test_held_out_quality(spark):
    """Labels that the fit never saw, of the middle size."""
    folder = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in QUERIES["op13_rule_quality"](spark, folder).collect()}
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{folder}/labels.parquet'").fetchall()
    held = [(got[d], q) for d, q in labels if zlib.crc32(str(d).encode()) % 4 == 2]
    assert all(r["held_out"] for r, _ in held)
    assert sum(r["predicted"] == q for r, q in held) >= 0.97 * len(held)
    assert all(r["predicted"] == 0 for r, q in held if q == 0)


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(), ODD_DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int")
    found = Q.quality(docs, none)
    assert found.columns == [c for c in docs.columns if c != "quality"] + ["quality"]
    assert {r["quality"]["score"] for r in found.collect()} == {0.5} and found.count() == len(odd_rows())
    labels = spark.createDataFrame([(3, 1), (3, 1), (4, 0), (5, 0), (None, 0), (1, 7), (2, None)], "doc_id long, quality int")
    scores = [r["quality"]["score"] for r in Q.quality(docs, labels).collect()]
    assert len(scores) == len(odd_rows()) and all(0 <= s <= 1 for s in scores)
    assert Q.quality(docs.where("false"), labels).count() == 0


def test_texts_of_few_shingles_lose_no_link(spark):
    """Seven words and the same with an eighth: 3 of 4 shingles are common, exactly the threshold."""
    from flowsieve.llm.superminhash import near_duplicates

    rows = []
    for k in range(300):
        words = [f"w{k}x{j}" for j in range(8)]
        rows += [(2 * k, " ".join(words[:7])), (2 * k + 1, " ".join(words))]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {d: d - d % 2 for d in range(600)}
    with pytest.raises(ValueError, match="percent"):
        near_duplicates(found, percent=50)


def test_scores_of_vectors_of_different_length(spark):
    from flowsieve.llm.topk import top_scores

    table = {0: [1.0, 2.0, 3.0, 4.0], 1: [1.0, 1.0, 1.0], 2: [1.0, 1.0, 1.0, 1.0, 9.0], 3: [2.0], 4: [0.5, 0.5, 0.5, 0.5], 20: [1.0, -1.0]}
    frame = spark.createDataFrame(list(table.items()), "vec_id long, embedding array<float>").repartition(3)
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in top_scores(frame, F.col("vec_id") % 20 == 0).collect()}
    assert got == {(q, c): int(4096 * sum(a * b for a, b in zip(table[q], v))) for q in (0, 20) for c, v in table.items() if c != q}
