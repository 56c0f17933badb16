"""Operators against small known results and brute force."""

import random

import pytest
from conftest import TINY
from pyspark.sql import functions as F

from flowsieve.functions.text import reference_segments, resolve_type_tags, scan_references, type_tags
from flowsieve.operators import ends, fixpoint, graph, inside, guards, paths, states, taint
from flowsieve.plans import bindings, load_all
from flowsieve.plans.profiles import read_profiles
from flowsieve.session import cut
from flowsieve.sources import policy, references
from flowsieve.streaming.arrival import analyse_arrivals, latest_arrivals

QUERIES, _ = load_all()


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_contract_keeps_loops(spark):
    edges = spark.createDataFrame(
        [("u", "a", "p"), ("u", "p", "q"), ("u", "q", "b"), ("u", "b", "s"), ("u", "s", "s"), ("u", "c", "x"), ("u", "x", "y"), ("u", "y", "x")],
        "unit string, src string, dst string",
    )
    passing = spark.createDataFrame([("u", b) for b in "pqsxy"], "unit string, block string")
    got = rows(graph.contract_pass_through(edges, passing).select("src", "dst"))
    assert got == {("a", "b"), ("b", "s"), ("s", "s"), ("c", "x"), ("x", "y"), ("y", "x")}


def brute_trivial(merges):
    """Replace merges with one operand until none is left."""
    left = {}
    for result, operand in merges:
        if operand != result:
            left.setdefault(result, set()).add(operand)
    while True:
        single = next((r for r, ops in sorted(left.items()) if len(ops) == 1), None)
        if single is None:
            return {(r, o) for r, ops in left.items() for o in ops}
        (target,) = left.pop(single)
        for r in list(left):
            if single in left[r]:
                left[r] = (left[r] - {single} | {target}) - {r}
                if not left[r]:
                    del left[r]


@pytest.mark.parametrize("seed", range(4))
def test_trivial_merges_brute_force(spark, seed):
    rnd = random.Random(seed)
    # operands point to older merges or plain values, plus loops back to themselves
    data = []
    for m in range(12):
        for _ in range(rnd.randint(1, 3)):
            data.append((f"m{m:02d}", rnd.choice([f"m{rnd.randint(0, m):02d}", f"v{rnd.randint(0, 3)}"])))
    table = spark.createDataFrame([("u", *d) for d in data], "unit string, result string, operand string")
    left, renames = graph.eliminate_trivial_merges(table)
    assert rows(left.select("result", "operand")) == brute_trivial(data)
    gone = {r["result"] for r in renames.collect()}
    assert gone.isdisjoint({r for r, _ in brute_trivial(data)})


@pytest.mark.parametrize("limit", ["200000", "9"])
def test_trivial_merges_of_many_units(spark, limit, monkeypatch):
    """Whole units in a task, or by joins where a unit is too large for it; circles of merges that only name each other have no target."""
    rnd = random.Random(5)
    data = {u: [(f"m{m}", rnd.choice([f"m{rnd.randint(0, 8)}", f"v{rnd.randint(0, 2)}"])) for m in range(9) for _ in range(rnd.randint(1, 3))] for u in "uvw"}
    data["c"] = [("m1", "m2"), ("m2", "m1"), ("m3", "m1"), ("m3", "v1"), ("m3", "v2")]
    table = spark.createDataFrame([(u, *d) for u, rows_of in data.items() for d in rows_of], "unit string, result string, operand string")
    written = []
    monkeypatch.setattr(graph, "cut", lambda df: written.append(1) or cut(df))
    spark.conf.set("flowsieve.rows.per.group", limit)
    try:
        left, renames = graph.eliminate_trivial_merges(table)
        for u in "uvw":
            rows_of = data[u]
            assert rows(left.where(F.col("unit") == u).select("result", "operand")) == brute_trivial(rows_of)
        assert rows(left.where("unit = 'c'").select("result", "operand")) == {("m3", "v1"), ("m3", "v2")}
        assert {(r["result"], r["target"]) for r in renames.where("unit = 'c'").collect()} == {("m1", None), ("m2", None)}
    finally:
        spark.conf.unset("flowsieve.rows.per.group")
    assert limit != "200000" or len(written) == 2  # however many passes it takes


@pytest.mark.parametrize("limit", ["200000", "3"])
def test_chains_end_where_their_last_row_is(spark, limit):
    made = [("u", i, i - 1 if i else None, f"e{i}") for i in range(30)] + [("v", 1, 2, "x"), ("v", 2, 1, "y"), ("v", 3, None, None), ("v", 4, 3, "z")]
    nodes = spark.createDataFrame(made, "unit string, id int, next int, value string")
    spark.conf.set("flowsieve.rows.per.group", limit)
    try:
        found = {(r["unit"], r["id"]): (r["next"] is None, r["value"]) for r in ends.follow_ends(nodes, ["unit", "id"], "next", ["value"]).collect()}
        assert all(found["u", i] == (True, "e0") for i in range(30)) and found["v", 4] == found["v", 3] == (True, None)
        assert not found["v", 1][0] and not found["v", 2][0]
        with pytest.raises(Exception, match="name no row"):
            ends.follow_ends(nodes.where("id <> 0"), ["unit", "id"], "next", ["value"]).collect()
    finally:
        spark.conf.unset("flowsieve.rows.per.group")


def test_trivial_merges_of_events(spark):
    left = QUERIES["eliminate_trivial_merges"](spark, TINY)
    counted = left.groupBy("unit", "result").agg(F.countDistinct("operand").alias("n"))
    assert counted.where("n < 2").count() == 0


def test_loop_merge(spark):
    """A loop over a variable needs one merge: the value before and the one of the body."""
    edges = spark.createDataFrame([("m", *e) for e in [("1", "2"), ("2", "3"), ("3", "5"), ("3", "2"), ("5", "2"), ("2", "4")]], "unit string, src string, dst string")
    defs = spark.createDataFrame([("m", "1", "a"), ("m", "5", "a")], "unit string, block string, var string")
    reads = spark.createDataFrame([("m", "3", "a"), ("m", "4", "a"), ("m", "5", "a")], "unit string, block string, var string")
    got = rows(graph.place_merges(reads.where("block <> '5'"), defs, edges).select("block", "operand"))
    assert got == {("2", "1"), ("2", "5")}


def test_pointers_log_rounds_and_circles(spark):
    chain = spark.range(1, 301).select(
        F.lit("u").alias("unit"), F.col("id"), F.when(F.col("id") > 1, F.col("id") - 1).alias("next"),
        F.when(F.col("id") == 1, F.lit("end")).alias("value"),
    )
    circle = spark.createDataFrame([("c", 1, 2, None), ("c", 2, 1, None)], "unit string, id bigint, next bigint, value string")
    done = fixpoint.follow_pointers(chain.unionByName(circle), ["unit", "id"], "next", {"value": lambda a, b: F.coalesce(a, b)})
    assert done.where("value = 'end'").count() == 300
    assert done.where("unit = 'c' AND value IS NULL AND next IS NOT NULL").count() == 2


def test_fixpoint_idempotent_and_partition_free(spark):
    rnd = random.Random(5)
    data = [("u", rnd.randint(0, 40), rnd.randint(0, 40)) for _ in range(60)]
    edges = spark.createDataFrame(data, "unit string, src int, dst int")
    seed = spark.createDataFrame([("u", 0)], "unit string, block int")
    once = graph.reachable_blocks(edges.repartition(3), seed)
    seen, level, front = {0: 0}, 0, {0}
    while front:
        level += 1
        front = {d for _, s, d in data if s in front} - set(seen)
        seen.update({b: level for b in front})
    assert {(r["block"], r["level"]) for r in once.collect()} == set(seen.items())
    again = graph.reachable_blocks(edges, once.select("unit", "block"))
    assert again.where("level > 0").count() == 0


def test_strict_flags_at_least_the_reference_mode(spark):
    plain = rows(QUERIES["report_flows"](spark, TINY).select("file", "start_line"))
    strict = rows(QUERIES["report_flows_strict"](spark, TINY).select("file", "start_line"))
    assert plain <= strict


def test_known_counts(spark):
    ops = bindings.program_events(spark, TINY)
    kind = F.col("event_type")
    flagged = bindings.program_links(ops).withColumn("is_source", kind == "signup").withColumn("is_clean", kind == "view")

    def by_type(tainted):
        return {r["event_type"]: r["count"] for r in tainted.join(ops, ["unit", "seq"]).groupBy("event_type").count().collect()}

    # signups alone are sources
    assert by_type(taint.straight_line_taint(flagged).where("tainted")) == {"signup": 199, "click": 76, "error": 66, "purchase": 77}
    # by their names some purchases are sources as well as sinks, which taints one click and two of themselves more
    assert by_type(QUERIES["taint_fixpoint"](spark, TINY)) == {"signup": 199, "click": 77, "error": 66, "purchase": 79}
    assert QUERIES["feasible_paths_integer"](spark, TINY).where("NOT reachable").count() == 6


def test_more_than_the_bound_is_imprecise(spark):
    edges = spark.createDataFrame([("u", "a", "b"), ("u", "b", "a"), ("u", "b", "c")], "unit string, src string, dst string")
    entry = spark.createDataFrame([("u", "a")], "unit string, block string")
    found = paths.enumerate_paths(edges, entry, max_loop=2).select(F.array_join("path", "").alias("p"), "imprecise")
    assert rows(found) == {("a", False), ("ab", False), ("aba", False), ("abab", True), ("abc", False), ("ababc", False)}


def test_feasible_real_and_integer(spark):
    data = [("p", "x", ">", 3), ("p", "x", "<", 4), ("q", "x", ">", 4), ("q", "x", "<=", 4), ("r", "x", "=", 5), ("r", "x", "!=", 5), ("s", "x", "~", 1), ("s", "x", "=", 1), ("s", "x", "=", 2)]
    table = spark.createDataFrame(data, "path string, var string, cmp string, const int")
    assert rows(paths.feasible_paths(table, ["path"])) == {("p", True, False), ("q", False, False), ("r", False, False), ("s", True, True)}
    assert ("p", False, False) in rows(paths.feasible_paths(table, ["path"], integers=True))


def test_union_and_intersection_of_states(spark):
    table = spark.createDataFrame([("a", True, ["x", "y"]), ("a", False, ["y"]), ("b", False, []), ("c", True, ["z", "z"])], "k string, tainted boolean, sanitizers array<string>")
    union = {r["k"]: (r["tainted"], r["sanitizers"]) for r in states.merge_union(table, ["k"]).collect()}
    both = {r["k"]: (r["tainted"], r["sanitizers"]) for r in states.merge_intersect(table, ["k"]).collect()}
    assert union == {"a": (True, ["x", "y"]), "b": (False, []), "c": (True, ["z"])}
    assert both == {"a": (True, ["y"]), "b": (False, []), "c": (True, ["z"])}


def test_strict_masks(spark):
    """Two ways to c: one through s0, one through s0 and s1; only s0 is met by both."""
    flows = spark.createDataFrame([("u", "a", "u", "b", 1), ("u", "b", "u", "c", 0), ("u", "b", "u", "d", 2), ("u", "d", "u", "c", 0), ("u", "c", "u", "b", 0)], "unit string, var string, to_unit string, to_var string, clears bigint")
    seeds = spark.createDataFrame([("u", "a")], "unit string, var string")
    state = {r["var"]: r["open_mask"] & 3 for r in taint.taint_strict(seeds, flows).collect()}
    assert state == {"a": 3, "b": 2, "c": 2, "d": 0}


def test_guard_text(spark):
    """``is_int($a) || is_float($a)``, and its negation on the else side."""
    table = spark.createDataFrame([(1, "a", 1, "or", "int", False), (1, "a", 2, "or", "float", False)], "g int, var string, pos int, mode string, tested_type string, negated boolean")
    merged = guards.combine_guards(table, ["g", "var"])
    text = merged.select(
        guards.render_guard(F.col("terms"), F.col("mode"), F.lit(False)), guards.render_guard(F.col("terms"), F.col("mode"), F.lit(True))
    ).first()
    assert text[0] == "(type(LITERAL('int'))|type(LITERAL('float')))"
    assert text[1] == "not((type(LITERAL('int'))|type(LITERAL('float'))))"


@pytest.mark.parametrize("raw", ["123", "*", "[]", "$b", "@param"])
def test_malformed_types_stay(spark, raw):
    table = spark.createDataFrame([(1, f"/** @param {raw} $bar */")], "id int, c string")
    alias = spark.createDataFrame([("Bar", "Foo\\Bar"), ("Quux", "Foo\\Bar")], "alias string, target string")
    found = resolve_type_tags(type_tags(table, "c", ["id"]), ["id"], alias)
    assert [r["resolved"] for r in found.collect()] == [raw]


def test_types_are_resolved(spark):
    table = spark.createDataFrame([(1, "/** @param Bar|int[] $a\n * @return ?Quux[] */")], "id int, c string")
    alias = spark.createDataFrame([("Bar", "Foo\\Bar"), ("Quux", "Foo\\Bar")], "alias string, target string")
    found = resolve_type_tags(type_tags(table, "c", ["id"]), ["id"], alias).orderBy("pos")
    assert [r["resolved"] for r in found.collect()] == ["Foo\\Bar|int[]", "?Foo\\Bar[]"]


def brute_expand(files, root):
    """Queue of references, first in first out."""
    import re

    pattern = re.compile(r"(include|require)(_once)?[ \t\n\r\f]*\(?(.*?)\)?;")
    tree = {"text": files[root], "name": root, "chain": (root,)}
    queue, included = [tree], set()
    while queue:
        level = []
        for node in queue:
            node["parts"], at = [], 0
            for hit in pattern.finditer(node["text"]):
                node["parts"].append(node["text"][at : hit.start()])
                at = hit.end()
                target = hit.group(3).replace("'", "").strip()
                child = {"matched": hit.group(0)}
                node["parts"].append(child)
                if target not in files:
                    child["out"] = hit.group(0)
                    continue
                again = target in included
                included.add(target)
                if (hit.group(2) and again) or target in node["chain"]:
                    child["out"] = ""
                    continue
                child.update(text=files[target], name=target, chain=(*node["chain"], target))
                level.append(child)
            node["parts"].append(node["text"][at:])
        queue = level

    def render(node):
        if "parts" not in node:
            return node["out"]
        return "".join(p if isinstance(p, str) else render(p) for p in node["parts"])

    return render(tree)


def test_expanded_text_brute_force(spark):
    files = {
        "a": "A1;require_once('b');A2;include 'c';A3;require_once('b');A4;",
        "b": "B1;include('c');B2;include 'gone';B3;",
        "c": "C1;require_once 'a';C2;include 'c';C3;",
        "d": "D1;",
    }
    table = spark.createDataFrame(list(files.items()), "name string, text string")
    refs = scan_references(table, "text", ["name"]).select("name", "pos", "path", "once")
    tree = references.expand_references(refs, table.select("name"), table.select("name"))
    pieces = references.expanded_source(tree, reference_segments(table, "text", ["name"]), table.select("name"))
    got = {}
    for r in sorted(pieces.collect(), key=lambda r: (r["root"], list(r["place"]))):
        got[r["root"]] = got.get(r["root"], "") + r["text"]
    assert got == {name: brute_expand(files, name) for name in files}


def test_overlay_wins(spark):
    base = policy.load_policy(spark)
    extra = policy.rows_to_table(spark, [("sink", "XSS", 0, "echo", [2], [])])
    both = policy.overlay_policy(base, extra)
    assert both.count() == base.count()
    assert both.where("name = 'echo' AND kind = 'sink'").first()["positions"] == [2]


def test_built_in_sinks_of_every_category(spark):
    sinks = policy.load_policy(spark).where("kind = 'sink'")
    counts = {r["category"]: r["count"] for r in sinks.groupBy("category").count().collect()}
    assert counts == {
        "XSS": 12, "CODE": 8, "EXEC": 13, "DATABASE": 54, "SSRF": 1, "HTTP_HEADER": 1, "POP": 2, "OTHER": 17,
        "CONNECT": 31, "SESSION_FIXATION": 3, "REFLECTION": 62, "FILE_READ": 54, "FILE_AFFECT": 43, "LDAP": 5,
        "XPATH": 3, "FILE_INCLUDE": 9,
    }
    assert sinks.select("name").distinct().count() == 299
    callback = sinks.where("name = 'preg_replace_callback'").orderBy("rank").collect()
    assert [(r["category"], r["positions"], r["safe_by"]) for r in callback] == [
        ("CODE", [1], ["preg_quote"]), ("REFLECTION", [2], []),
    ]
    assert sinks.where("name = 'readfile'").first()["safe_by"] == ["basename", "dirname", "pathinfo"]


def test_policy_from_file(spark, tmp_path):
    path = tmp_path / "policy.json"
    path.write_text('{"kind": "sink", "category": "FILE_READ", "rank": 11, "name": "readfile", "positions": [1], "safe_by": ["basename"]}\n')
    both = policy.overlay_policy(policy.load_policy(spark), policy.load_policy(spark, str(path)))
    found = {r["name"]: r for r in both.where("category = 'FILE_READ'").collect()}
    assert len(found) == 54 and [n for n, r in found.items() if r["layer"] == 1] == ["readfile"]
    assert found["readfile"]["safe_by"] == ["basename"]


def test_profiles_from_file(spark, tmp_path):
    path = tmp_path / "profiles.json"
    path.write_text('{"taint": [{"modules": [["m.taint", "Taint"]],\n "traversal": "DFS"}, {"modules": [], "traversal": "BFS"}]}')
    assert [(r["stage"], r["traversal"]) for r in read_profiles(spark, str(path)).orderBy("stage").collect()] == [(0, "DFS"), (1, "BFS")]


def test_a_batch_of_many_tasks_keeps_few_files(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(400).select((F.col("id") % 40).alias("unit")).repartition(8).write.parquet(source)
    analyse_arrivals(spark, source, spark.read.parquet(source).schema, lambda batch: batch.groupBy("unit").count(), out, unit="unit", buckets=4)
    kept = list((tmp_path / "out-rows").rglob("*.parquet"))
    assert len(kept) <= 4  # small folders share a task, a folder has one file
    assert latest_arrivals(spark, out, "unit").where("count = 10").count() == 40


def test_arrivals_take_only_what_is_new(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in (1, 2):
        spark.range(part * 10).coalesce(1).write.mode("append").parquet(source)
        analyse_arrivals(
            spark, source, spark.range(1).schema, lambda df: df.groupBy().count(), out, files_per_batch=1, state=state
        )
    assert sorted(r["count"] for r in spark.read.parquet(out).collect()) == [10, 20]


def test_units_in_two_batches_keep_their_findings(spark, tmp_path):
    from flowsieve.plans.q_sources import analyse_batch

    events = spark.read.parquet(f"{TINY}/events.parquet")
    whole = rows(analyse_batch(events))
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in ("event_id % 3 = 0", "event_id % 3 > 0"):
        events.where(part).coalesce(1).write.mode("append").parquet(source)
        analyse_arrivals(spark, source, events.schema, analyse_batch, out, state=state, unit="user_id")
    found = latest_arrivals(spark, out, "unit")
    assert rows(found.select(*analyse_batch(events).columns)) == whole and found.count() == len(whole) > 0


def test_a_batch_reads_only_what_it_touches(spark, tmp_path):
    """Ten batches of two units each: what is read for a batch does not grow with the batches before it."""
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    counted = lambda df: df.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    make = lambda k: spark.range(100).selectExpr(f"cast({2 * (k % 8)} + id % 2 AS int) AS unit", f"id + {k} AS value")
    progress = []
    for k in range(10):
        make(k).coalesce(1).write.mode("append").parquet(source)
        analyse_arrivals(spark, source, make(0).schema, counted, out, state=state, unit="unit", buckets=64, progress=progress)
    # the last two batches meet their units again
    assert [p["held"] for p in progress] == [100] * 8 + [200] * 2
    assert all(p["read"] <= p["held"] + 100 for p in progress)
    whole = make(0)
    for k in range(1, 10):
        whole = whole.unionByName(make(k))
    assert rows(latest_arrivals(spark, out, "unit").select("unit", "n", "total")) == rows(counted(whole))


def test_type_tags_of_whole_texts(spark, tmp_path):
    from flowsieve.plans import load_all

    texts = [(1, "Один two, en", "en", "s"), (2, None, "fr", None), (3, "日本", "en", "s")]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    found = load_all()[0]["extract_type_tags"](spark, str(tmp_path)).where("pos > 3 OR pos = 0").orderBy("doc_id", "pos")
    assert [(r["doc_id"], r["resolved"]) for r in found.collect()] == [
        (1, "?Lang\\EN[]"), (1, "Один|null"), (1, "two|null"), (1, "Lang\\EN|null"), (2, "?Lang\\FR[]"), (3, "?Lang\\EN[]"), (3, "日本|null")
    ]


def test_walks_go_round_a_loop(spark):
    from flowsieve.plans import load_all

    found = load_all()[0]["enumerate_paths"](spark, TINY)
    walks = [r["path"].split(">") for r in found.select("path").collect()]
    assert max(max(map(w.count, w)) for w in walks) == 2
    assert len(walks) == 73215  # counted by the SQL


@pytest.mark.parametrize("bits", [1, 6, 62])
def test_words_of_any_width_agree(spark, bits):
    """A unit's variables may fill one word or several."""
    from flowsieve.operators.spread import breadth_first, spread

    events = bindings.block_events(spark, TINY).where("unit LIKE '1%'")
    edges = bindings.block_edges(events)
    data = {}
    for u, s, d in edges.collect():
        data.setdefault(u, set()).add((s, d))
    facts = [(r["unit"], r["block"], r["var"]) for r in bindings.block_mentions(events).collect()]
    live = set(facts)
    while True:
        more = {(u, s, v) for u, b, v in live for s, d in data.get(u, ()) if d == b} - live
        if not more:
            break
        live |= more
    assert rows(spread(bindings.block_mentions(events), edges, ["var"], backward=True, bits=bits)) == live
    entries = {(r["unit"], r["block"]) for r in bindings.block_entries(events).collect()}
    levels, front, level = {e: 0 for e in entries}, entries, 0
    while front:
        level += 1
        front = {(u, d) for u, b in front for s, d in data.get(u, ()) if s == b} - set(levels)
        levels.update({f: level for f in front})
    got = breadth_first(bindings.block_entries(events), edges)
    assert {((r["unit"], r["block"]), r["level"]) for r in got.collect()} == set(levels.items())


def test_dangling_pointer_is_an_error(spark):
    nodes = spark.createDataFrame([("u", 1, 9, None), ("u", 2, None, "x")], "unit string, id int, next int, value string")
    with pytest.raises(ValueError):
        fixpoint.follow_pointers(nodes, ["unit", "id"], "next", {"value": lambda a, b: F.coalesce(a, b)})


def test_block_taint(spark):
    events = bindings.block_events(spark, TINY).where("unit LIKE '1%'")
    edges = bindings.block_edges(events)
    made = [(r["unit"], r["block"], r["event_type"], r["rv"], r["wv"]) for r in events.collect()]
    tainted = {(u, b, w) for u, b, kind, _, w in made if kind == "signup"}
    steps = [tuple(r) for r in edges.collect()]
    while True:
        more = {(u, d, v) for u, s, d in steps for u2, b, v in tainted if u2 == u and b == s}
        more |= {(u, b, w) for u, b, kind, r, w in made if kind not in ("signup", "view") and (u, b, r) in tainted}
        if more <= tainted:
            break
        tainted |= more
    generated = events.where("event_type = 'signup'").select("unit", "block", F.col("wv").alias("var"))
    copies = events.where("event_type NOT IN ('signup', 'view')").select("unit", "block", F.col("rv").alias("var"), F.col("wv").alias("to_var")).distinct()
    assert rows(taint.taint_blocks(generated, copies, edges)) == tainted


def test_merges_with_words_of_any_width_agree(spark):
    events = bindings.block_events(spark, TINY).where("unit LIKE '1%'")
    defs = events.where("event_type <> 'error'").select("unit", "block", F.col("wv").alias("var")).distinct()
    reads = events.select("unit", "block", F.col("rv").alias("var")).distinct().join(defs, ["unit", "block", "var"], "left_anti")
    edges = bindings.block_edges(events)
    packed, mixed = (rows(graph.place_merges(reads, defs, edges, bits=n)) for n in (62, 3))
    assert packed == mixed
    assert packed


@pytest.mark.parametrize("blocks", [62, 63])
def test_long_circles(spark, blocks):
    """A circle of any length with more variables than a word has bits."""
    from flowsieve.operators.spread import breadth_first, flood, spread

    edges = spark.range(blocks).selectExpr("'u' AS unit", "cast(id AS int) AS src", f"cast((id + 1) % {blocks} AS int) AS dst")
    facts = spark.createDataFrame([("u", k % blocks, k) for k in range(100)], "unit string, block int, var int")
    facts = facts.unionByName(spark.createDataFrame([("u", 0, None)], facts.schema))
    assert spread(facts, edges, ["var"]).count() == 101 * blocks
    assert spread(facts.where("var = 5"), edges, []).count() == blocks
    stops = spark.createDataFrame([("u", 10, 7), ("u", 3, None), ("u", 1, 400)], facts.schema)
    held = flood(facts.where("var = 7 OR var IS NULL"), edges, stops, ["var"])
    assert rows(held) == {("u", b, 7) for b in (7, 8, 9)} | {("u", b, None) for b in (0, 1, 2)}
    levels = breadth_first(facts.where("var = 0").select("unit", "block"), edges)
    assert {(r["block"], r["level"]) for r in levels.collect()} == {(b, b) for b in range(blocks)}


def test_tags_are_not_gathered_by_document(spark, capsys):
    """Each type is resolved once; documents with the same id and comment keep their own rows."""
    table = spark.createDataFrame([(1, "@param A|Quux $x @var A|Quux"), (1, "@param A|Quux $x"), (2, "@var ?B[]")], "id int, c string")
    alias = spark.createDataFrame([("quux", "Foo\\Bar")], "alias string, target string")
    found = resolve_type_tags(type_tags(table, "c", ["id"]), ["id"], alias)
    assert sorted((r["id"], r["pos"], r["tag"], r["resolved"]) for r in found.collect()) == [
        (1, 0, "param", "A|Foo\\Bar"), (1, 0, "param", "A|Foo\\Bar"), (1, 1, "var", "A|Foo\\Bar"), (2, 0, "var", "?B[]")
    ]
    found.explain()
    assert "hashpartitioning(id" not in capsys.readouterr().out


@pytest.mark.parametrize("bound", [1, 2, 3])
def test_paths_are_not_dealt_out_again(spark, capsys, bound):
    """Same prefixes as by brute force, over several rounds; the paths themselves are never shuffled by their text."""
    steps = [("u", 1, 2), ("u", 2, 3), ("u", 3, 1), ("u", 3, 4), ("u", 4, 5), ("u", 5, 6), ("u", 6, 7), ("u", 7, 5), ("u", 6, None), ("v", 1, 1)]
    edges = spark.createDataFrame([*steps, (None, 1, 2), ("u", 4, 8)], "unit string, src int, dst int")
    starts = [("u", 1), ("u", 9), ("v", 1), (None, 1), ("w", None)]
    dead = spark.createDataFrame([("u", 4, 8)], "unit string, src int, dst int")
    found = paths.enumerate_paths(edges, spark.createDataFrame(starts, "unit string, block int"), max_loop=bound, dead_ends=dead)
    expected, front = [], [(u, (b,)) for u, b in starts]
    while front:
        unit, path = front.pop()
        onward = [d for u, s, d in steps if u == unit and s == path[-1]]
        expected.append((unit, path, path[-1], any(path.count(d) >= bound for d in onward)))
        front += [(unit, (*path, d)) for d in onward if path.count(d) < bound]
    got = [(r["unit"], tuple(r["path"]), r["block"], r["imprecise"]) for r in found.select("unit", "path", "block", "imprecise").collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    found.explain()
    assert "path" not in "".join(x for x in capsys.readouterr().out.splitlines() if "Exchange hashpartitioning" in x).replace("_path", "")


def test_written_tables_count_by_their_rows(spark, capsys):
    """Two million rows fit files of less than two MB; they are not sent through the driver for that."""
    from flowsieve.session import cut, sizes_in_memory

    factor = "spark.sql.sources.fileCompressionFactor"
    before = spark.conf.get(factor)
    many = cut(spark.range(2_000_000).selectExpr("pmod(xxhash64(id), 7) AS k", "pmod(xxhash64(id, 1), 5) AS v"))
    few = cut(spark.range(100).selectExpr("id AS k"))
    with sizes_in_memory(spark):
        many.join(many.withColumnRenamed("v", "w"), "k").explain()
        assert "Broadcast" not in capsys.readouterr().out
        many.join(few, "k").explain()
        assert "Broadcast" in capsys.readouterr().out
    assert spark.conf.get(factor) == before


def test_parts_of_a_unit_hand_on_what_they_find(spark):
    """A unit of many parts gives what one part gives: levels, words of bits with stops, values with copies and kills."""
    from flowsieve.operators.spread import breadth_first, flood

    edges = spark.range(60).selectExpr("if(id < 40, 'u', 'v') AS unit", "cast(id AS int) AS src", "cast((id * 7 + 3) % 40 AS int) AS dst")
    edges = edges.unionByName(spark.createDataFrame([("u", 3, None), (None, 1, 2), ("u", None, 4)], "unit string, src int, dst int"))
    facts = spark.createDataFrame([("u", k % 40, k % 9) for k in range(30)] + [("u", 1, None), (None, 1, 1), ("v", 45, 2)], "unit string, block int, var int")
    stops = spark.createDataFrame([("u", 10, 7), ("u", 3, None), ("u", 24, 4)], facts.schema)
    copies = spark.createDataFrame([("u", k, k % 9, (k * 5) % 11, 1 << (k % 4)) for k in range(40)], "unit string, block int, var int, to_var int, clears bigint")
    masks = facts.withColumn("open_mask", F.lit(15).cast("bigint"))

    def all_of():
        links = edges.select("unit", F.col("src").alias("block"), F.col("dst").alias("_to"))
        deal = inside.deal_large_units(links)
        entries = facts.where("var IN (2, 5)").select("unit", "block").distinct()
        return deal, [
            rows(breadth_first(entries, edges)), rows(flood(facts, edges, stops, ["var"], bits=4)), rows(taint.taint_blocks(facts, copies, edges)),
            rows(inside.follow(masks, links, ["var"], "open_mask", copies=copies, kills=stops, deal=deal)),
        ]

    deal, one = all_of()
    assert deal is None
    spark.conf.set("flowsieve.rows.per.group", "20")
    try:
        deal, many = all_of()
    finally:
        spark.conf.unset("flowsieve.rows.per.group")
    assert deal is not None
    assert one == many


def test_facts_of_a_unit_meet_its_links_once(spark, capsys):
    """However long the way, its facts are not dealt out again: one shuffle, no join, no table per round."""
    links = spark.range(300).selectExpr("'u' AS unit", "cast(id AS int) AS block", "cast(id + 1 AS int) AS _to")
    found = inside.follow(spark.createDataFrame([("u", 0)], "unit string, block int"), links, [])
    assert found.count() == 301
    found.explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_long_chains_of_calls_cross_few_regions(spark):
    """Calls a few units ahead: regions are bounded, grow along the calls, and change neither what is reached nor its depth."""
    from flowsieve.operators.regions import regions

    name = "substring(md5(cast({} AS string)), 1, 12)"
    calls = spark.range(150).selectExpr("id", "explode(array(1, 3)) AS ahead").selectExpr(f"{name.format('id')} AS unit", f"{name.format('id + ahead')} AS callee")
    roots = spark.range(1).selectExpr(f"{name.format('id')} AS unit")
    expected = {(r["n"], r["l"]) for r in spark.range(153).selectExpr(f"{name.format('id')} AS n", "cast(id div 3 + id % 3 AS int) AS l").collect()}
    dealt = regions(calls, 200).groupBy("region").count().collect()
    assert 1 < len(dealt) < 40 and max(r["count"] for r in dealt) <= 200
    spark.conf.set("flowsieve.rows.per.group", "200")
    try:
        assert rows(graph.reachable_units(calls, roots)) == expected
    finally:
        spark.conf.unset("flowsieve.rows.per.group")
    assert rows(graph.reachable_units(calls, roots)) == expected
