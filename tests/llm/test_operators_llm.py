"""The ten operators and the pipeline against brute force, with nulls, ties, repeats and clashing names."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from compare import differences
from flowsieve.llm import binary_codes, line_runs, pseudo_likelihood, superminhash, topk, tree_bpe
from flowsieve.llm.binary_codes import near_vectors
from flowsieve.llm.chunks import load
from flowsieve.llm.components import components
from flowsieve.llm.line_runs import drop_repeated_lines
from flowsieve.llm.mixing import emit_copies, mix_sources
from flowsieve.llm.pseudo_likelihood import pseudo_log_likelihood
from flowsieve.llm.queries import ORACLES, QUERIES
from flowsieve.llm.superminhash import near_duplicates
from flowsieve.llm.token_blocks import read_tokens, write_tokens
from flowsieve.llm.topk import top_scores
from flowsieve.llm.toxicity import toxicity
from flowsieve.llm.tree_bpe import encode_documents
from flowsieve.llm.url_rank import judge_urls
from flowsieve.session import new_folder

TINY = "/root/testdata/sf0.001"
LONG = "word " * 4000 + "\n" + "a line that is long enough to be a key\n" * 30
TEXTS = [None, "", " \n ", "a", "one two three four five six", "One two three four five SIX", LONG, LONG + "tail", "\n".join(["Some repeated line of text  "] * 3)]
#: Extra columns with names that the operators use inside or return.
EXTRA = ["id", "text2", "n", "mark", "batch", "size", "rule", "label2", "component_id", "score"]


def documents(spark, texts=TEXTS):
    rows = [(k, t, "en", f"s{k % 3}" if k % 4 else None, len(t or "")) for k, t in enumerate(texts)]
    rows += [(4, TEXTS[4], "en", "s1", 0), (4, "other text of the same id", "en", "s1", 0), (None, TEXTS[4], None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def clashing(df):
    return df.withColumns({name: F.lit("x") for name in EXTRA})


def empty(df):
    return df.where("false")


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def component_of(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingle_set(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def test_components_of_chains_stars_and_loops(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 200), (300, 301), (301, 300), (None, 5)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    known = [(a, b) for a, b in links if a is not None and a != b]
    assert got == component_of({x for link in known for x in link}, known)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_queries_equal_their_sql(spark, name):
    assert differences(spark, TINY, QUERIES[name], ORACLES[name]) == ""


def test_near_duplicates_equal_brute_force(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    base = "the quick brown fox jumps over a lazy dog and runs far away into the dark green wood today"
    extra = [(10_000 + k, base + f" {k}") for k in range(12)] + [(20_000 + k, " ".join(base.split()[k : k + 14])) for k in range(8)]
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] + extra
    got = {r.doc_id: tuple(r)[1:] for r in near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    sets = {k: shingle_set(t) for k, t in texts}
    holders = defaultdict(set)
    for k, s in sets.items():
        for x in s:
            holders[x].add(k)
    pairs = {p for held in holders.values() for p in itertools.combinations(sorted(held), 2)}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = component_of(sets, links)
    assert got == {k: (len(sets[k]), want[k], want[k] == k) for k in sets}


def test_near_duplicates_of_odd_rows(spark):
    got = rows(near_duplicates(clashing(documents(spark))))
    assert got[(None, 2, None, True)] == 1
    assert got[(4, 2, 4, True)] == 3 and got[(5, 2, 4, False)] == 1
    assert got[(0, 0, 0, True)] == got[(1, 0, 1, True)] == got[(2, 0, 2, True)] == 1
    assert near_duplicates(empty(documents(spark))).collect() == []


def test_lines_of_odd_rows_and_levels(spark, monkeypatch):
    monkeypatch.setattr(line_runs, "BATCHES", 5)
    line = "a line that is long enough to count"
    texts = [f"{line}\nown {k}" for k in range(12)] + [None, "", f"  {line.upper()} \n{line}", "short\nshort"]
    docs = clashing(spark.createDataFrame([*enumerate(texts), (None, line), (3, line)], "doc_id long, text string"))
    out = drop_repeated_lines(docs)
    got = Counter((r.doc_id, r.text, r.line_dedup.n_lines, r.line_dedup.n_dropped) for r in out.collect())
    want = Counter({(k, f"own {k}", 2, 1): 1 for k in range(12)})
    want += Counter([(12, "", 1, 0), (13, "", 1, 0), (14, texts[14], 2, 0), (15, "short\nshort", 2, 0), (None, line, 1, 0), (3, "", 1, 1)])
    assert got == want
    assert out.columns == ["doc_id", "text", *EXTRA, "line_dedup"]
    assert drop_repeated_lines(empty(docs)).collect() == []


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(binary_codes, "BLOCK_ROWS", 16)
    monkeypatch.setattr(binary_codes, "SMALL", 6)
    make = np.random.default_rng(8)
    base = make.standard_normal((6, 16))
    vectors = [base[k % 6] + 0.06 * make.standard_normal(16) for k in range(150)] + [2.0 * base[0], base[0], base[0]]
    table = [(k, v.tolist(), k % 2) for k, v in enumerate(vectors)]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, base[0].tolist(), None),
           (None, base[0].tolist(), 1), (905, [1.0, 2.0], 1), (906, [], 1), (907, [float("inf")] * 16, 0)]
    frame = spark.createDataFrame(table + odd, "vec_id long, embedding array<double>, label int")
    got = rows(near_vectors(clashing(frame)))
    units = {k: (np.array(v) / np.linalg.norm(v), label) for k, v, label in table}
    links = [(a, b) for a, b in itertools.combinations(units, 2) if units[a][1] == units[b][1] and units[a][0] @ units[b][0] >= 0.98]
    assert len(links) > 500
    count = Counter(x for link in links for x in link)
    want = component_of(units, links)
    expected = Counter({(k, count[k], want[k], want[k] == k): 1 for k in units})
    expected += Counter([(k, 0, k, True) for k in range(900, 908)] + [(None, 0, None, True)])
    assert got == expected
    assert near_vectors(empty(frame)).collect() == []


def test_top_scores_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 3)
    monkeypatch.setattr(topk, "BINS", 4)
    make = np.random.default_rng(9)
    table = [(k, np.round(make.standard_normal(4), 1).tolist()) for k in range(60)]
    odd = [(100, None), (120, [float("nan")] * 4), (None, [1.0] * 4), (140, [None, 1.0, 1.0, 1.0])]
    frame = clashing(spark.createDataFrame(table + odd, "vec_id long, embedding array<float>"))
    whole = {k: np.floor(64 * np.float32(v).astype(float)).astype(int) for k, v in table}
    for k in (3, 20, 80):
        got = rows(top_scores(frame, F.col("vec_id") % 5 == 0, k))
        want = Counter()
        for q in range(0, 60, 5):
            best = sorted((-int(whole[q] @ v), c) for c, v in whole.items() if c != q)[:k]
            want.update((q, n + 1, c, -s) for n, (s, c) in enumerate(best))
        assert got == want
    assert top_scores(empty(frame), F.lit(True)).collect() == []


def test_mix_meets_targets_and_agrees(spark):
    docs = clashing(documents(spark))
    mixed = mix_sources(docs)
    assert rows(mixed) == rows(mix_sources(docs))
    for r in mixed.collect():
        assert r.mix.copies <= 2 and r.mix.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    copies = emit_copies(mixed)
    assert copies.columns == docs.columns and copies.count() == sum(r.mix.copies for r in mixed.collect())
    assert mix_sources(empty(docs)).collect() == []
    whole = mix_sources(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    sums = whole.groupBy("source").agg(F.sum(F.col("mix.copies") * F.col("mix.size")).alias("taken"), F.max("mix.target").alias("target")).collect()
    assert abs(sum(r.taken for r in sums) / sum(r.target for r in sums) - 1) < 0.1


def test_trust_and_distrust_spread(spark):
    page = lambda k, url, *links: (k, url, " ".join(f'<a HREF = "{x}">x</a>' for x in links))
    pages = [
        page(1, "http://bad.com/de/x?y", "/own", "http://other.net/"),
        page(2, "https://farm.net/a", "http://bad.com/1", "//BAD.com/2"),
        page(3, "https://half.net/a", "http://bad.com/1", "http://good.org/2", "http://plain.net/"),
        page(4, "http://www.Good.ORG/es/1#f", "http://half.net/"),
        page(5, "http://plain.net", "mailto:x@y.z"),
        page(6, "no scheme"),
        page(7, "http://example.org/en/12"),
        page(8, "http://example.org"),
        (9, None, None),
        (None, "http://bad.com/de/x?y", None),
    ]
    frame = clashing(spark.createDataFrame(pages, "page_id long, url string, html string"))
    rules = spark.createDataFrame(
        [("org", "/", "allow"), ("example.org", "/en/1", "block"), ("com", "/de/", "block")], "host string, path string, verdict string"
    )
    out = {r.page_id: tuple(r.judged)[:4] for r in judge_urls(frame, rules).collect()}
    assert out == {
        1: ("bad.com", "/de/x", "com/de/", "block"),
        2: ("farm.net", "/a", None, "block"),
        3: ("half.net", "/a", None, "allow"),
        4: ("www.good.org", "/es/1", "org/", "allow"),
        5: ("plain.net", "", None, "allow"),
        6: ("", "", None, "allow"),
        7: ("example.org", "/en/12", "example.org/en/1", "block"),
        8: ("example.org", "", None, "block"),  # rules block half of its pages, which is the threshold
        9: ("", "", None, "allow"),
        None: ("bad.com", "/de/x", "com/de/", "block"),
    }
    assert judge_urls(empty(frame), rules).collect() == []


def test_token_files_equal_the_library(spark):
    library = load(public_tokenizers.path("byte_bpe_50k.json"))
    for docs in (clashing(documents(spark)), spark.read.parquet(f"{TINY}/documents.parquet")):
        folder = new_folder(spark, "tokens")
        write_tokens(docs, folder, public_tokenizers.path("byte_bpe_50k.json"))
        got = sorted(map(tuple, read_tokens(spark, folder).collect()), key=lambda r: r[1])
        texts = docs.select("doc_id", "text").collect()
        codes = Counter((r.doc_id, zlib.crc32(np.array(library.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4").tobytes())) for r in texts)
        assert Counter((r[0], r[3]) for r in got) == codes
        assert [r[0] if r[0] is not None else -1 for r in got] == sorted(r.doc_id if r.doc_id is not None else -1 for r in texts)
        assert [r[1] for r in got] == [0, *itertools.accumulate(r[2] for r in got)][:-1]
    folder = new_folder(spark, "tokens")
    write_tokens(empty(documents(spark)), folder, public_tokenizers.path("byte_bpe_50k.json"))
    assert read_tokens(spark, folder).collect() == []


def test_tree_codes_equal_the_library(spark, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = load(path)

    def want(text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())

    monkeypatch.setattr(tree_bpe, "PIECE", 1000)
    docs = clashing(documents(spark, [*TEXTS, "unbroken" * 900]))
    assert rows(encode_documents(docs, path)) == Counter((r.doc_id, *want(r.text)) for r in docs.collect())
    assert encode_documents(empty(docs), path).collect() == []


def test_scores_of_odd_rows(spark):
    docs = clashing(documents(spark))
    scored = {(r.doc_id, r.text): r for r in pseudo_log_likelihood(docs).join(docs.select("doc_id", "text"), "doc_id").collect()}
    assert scored[(0, None)].n_tokens == 0 and scored[(0, None)].log_probability == 0.0
    assert all(r.log_probability < 0 for r in scored.values() if r.n_tokens)
    assert pseudo_log_likelihood(docs).count() == docs.count()
    assert pseudo_log_likelihood(empty(docs)).collect() == []


def test_rare_words_are_predicted_as_themselves(spark, monkeypatch):
    common = [f"c{k}" for k in range(pseudo_likelihood.VOCABULARY)]
    texts = [(k, " ".join(common)) for k in range(12)] + [(100 + k, "eight") for k in range(8)] + [(200, "two"), (201, "two")]
    texts += [(300, " ".join(f"junk{k}" for k in range(300))), (301, " ".join(f"other{k}" for k in range(300)))]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(2)
    held = {r.doc_id: r for r in pseudo_log_likelihood(docs).collect()}
    assert abs(held[100].log_probability - held[200].log_probability - np.log(8 / 2)) < 1e-6
    assert held[300].mean_log_probability < held[0].mean_log_probability - 1
    monkeypatch.setattr(pseudo_likelihood, "CACHED", 0)  # every count is joined
    joined = pseudo_log_likelihood(docs).collect()
    assert len(joined) == docs.count()
    assert all(abs(r.log_probability - held[r.doc_id].log_probability) < 1e-3 and r.n_tokens == held[r.doc_id].n_tokens for r in joined)


def test_shuffled_words_are_less_likely(spark):
    """Texts of a fixed order of words, and a few with the same words in any order."""
    make = np.random.default_rng(10)
    order = [f"w{k}" for k in range(40)]
    plain = [(k, " ".join(order * 50)) for k in range(120)]
    mixed = [(1000 + k, " ".join(make.permutation(order * 50))) for k in range(6)]
    scored = pseudo_log_likelihood(spark.createDataFrame(plain + mixed, "doc_id long, text string").coalesce(2))
    means = dict(map(tuple, scored.groupBy(F.col("doc_id") >= 1000).agg(F.avg("mean_log_probability")).collect()))
    assert means[False] > means[True] + 0.01  # measured: 0.027 after so few words


def test_word_order_gains_whole_nats(spark):
    """Each word follows from its neighbour, so up to log 40 = 3.7 nats are to be had."""
    make = np.random.default_rng(11)
    order = [f"w{k}" for k in range(40)]
    texts = [(k, " ".join(order * 50)) for k in range(120)] + [(1000 + k, " ".join(make.permutation(order * 50))) for k in range(6)]
    scored = pseudo_log_likelihood(spark.createDataFrame(texts, "doc_id long, text string").coalesce(2))
    means = dict(map(tuple, scored.groupBy(F.col("doc_id") >= 1000).agg(F.avg("mean_log_probability")).collect()))
    assert means[False] > means[True] + 2 and means[False] > -1


def test_toxicity_of_odd_rows(spark):
    docs = clashing(documents(spark))
    labels = spark.createDataFrame([(4, 0, 1), (5, 0, 0), (6, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    out = toxicity(docs, labels)
    assert out.columns == [*docs.columns, "toxicity"]
    found = out.collect()
    assert len(found) == docs.count() and all(0 <= r.toxicity.score <= 1 for r in found)
    assert all(r.toxicity.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    assert toxicity(empty(docs), empty(labels)).collect() == []


def test_pipeline_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        path = new_folder(spark, "stage")
        out = stage(spark, docs, TINY)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, TINY)
    assert last.count() == docs.count() > 0
    gone = corpus_pipeline.drop_near_duplicates(spark, docs.dropDuplicates(["doc_id"]), TINY)
    assert gone.count() == docs.select("doc_id").distinct().count()
    assert corpus_pipeline.run(spark, TINY).count() == last.count()
    assert superminhash.BANDS * superminhash.ROWS <= superminhash.SLOTS


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, stage):
    docs = clashing(documents(spark))
    assert stage(spark, docs, TINY).count() > 0
    assert stage(spark, empty(docs), TINY).collect() == []
