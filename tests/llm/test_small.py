"""The helpers of the training-data operators, without Spark."""

import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest

from flowsieve.llm import binary_codes, chunks, hashing, pseudo_likelihood, superminhash, token_blocks, toxicity, tree_bpe

TEXTS = [
    "",
    " ",
    "one",
    "A b\tC d\n\n e f g h",
    "x " * 50,
    "É ée  Ñ\x0bñ",
    "don't  <|endoftext|> a<|endoftext|>",
    " a   b",
    "a\x1c b \x85c 　 d\n",
    "é e ́x",
]


def test_words_and_shingles_are_those_of_the_pattern():
    data, offsets = hashing.flat(pa.array([*TEXTS, None]))
    hashed, before = hashing.words(data, offsets)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    expected = [re.findall(r"[^\x20\x09-\x0D]+", t.translate(lower)) for t in TEXTS] + [[]]
    assert np.diff(before).tolist() == [len(w) for w in expected]
    flat = [w for found in expected for w in found]
    assert len(set(hashed.tolist())) == len(set(flat))
    assert len({(w, h) for w, h in zip(flat, hashed.tolist())}) == len(set(flat))
    _, at = hashing.shingles(hashed, before, 5)
    sizes = [len(w) - 4 if len(w) >= 5 else min(1, len(w)) for w in expected]
    assert np.diff(at).tolist() == sizes


def test_words_of_long_texts_are_those_of_short_ones():
    size = hashing.SLICE_BYTES
    long = "x" * (size + 5)  # a word that lies in three blocks, then words on either side of a border
    texts = ["Ab " * size, f" {long} ab {long.upper()}\n", "ab"]
    data, offsets = hashing.flat(pa.array(texts))
    hashed, before = hashing.words(data, offsets)
    alone = hashing.words(*hashing.flat(pa.array(["ab", "x" * (size + 4), long])))[0]
    assert np.diff(before).tolist() == [size, 3, 1]
    assert (hashed[:size] == alone[0]).all() and hashed[size:].tolist() == [alone[2], alone[0], alone[2], alone[0]]
    assert len(set(alone.tolist())) == 3


def test_signature_estimates_the_similarity():
    make = np.random.default_rng(1)
    pool = make.integers(0, 2**63, 3000).astype(np.uint64)
    sets = [pool[:2000], pool[500:2500], pool[:40], pool[10:50], pool[:1], pool[:0], pool[:0]]
    signature = superminhash.signatures(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]))
    assert abs((signature[0] == signature[1]).mean() - 1500 / 2500) < 0.15
    assert abs((signature[2] == signature[3]).mean() - 30 / 50) < 0.15
    assert len(set(signature[4].tolist())) == superminhash.SLOTS
    assert (signature[5] == signature[6]).all()


@pytest.mark.parametrize("name,keep", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_chunks_encode_as_the_whole_text(name, keep, monkeypatch):
    monkeypatch.setattr(chunks, "REMEMBERED", 4)
    base = chunks.ChunkEncoder(public_tokenizers.path(name), keep)
    library = chunks.load(public_tokenizers.path(name))
    for _ in range(3):
        ids, at = base.encode(TEXTS)
        codes = [ids[a:b] for a, b in zip(at[:-1], at[1:])]
        assert [c.tolist() for c in codes] == [c.ids for c in library.encode_batch(TEXTS, add_special_tokens=False)]
        assert base.decode(codes) == [library.decode(c.tolist(), skip_special_tokens=False) for c in codes]


def test_tree_equals_the_library(monkeypatch):
    monkeypatch.setattr(tree_bpe, "LEAF", 64)
    monkeypatch.setattr(tree_bpe, "EDGE", 24)
    base = chunks.ChunkEncoder(public_tokenizers.path("word_bpe_49k.json"), False)
    make = random.Random(3)
    texts = ["".join(make.choice("abcdetsoniéè'.1 ́ΣSſ\n" if k % 2 else "abcdetsoniéè") for _ in range(make.randint(65, 900))) for k in range(60)]
    for text in [*texts, "a" * 1000, "the" * 300, "ab " * 200, "!?" * 300]:
        assert tree_bpe.encode_tree(text, base).ids.tolist() == base.tokenizer.encode(text, add_special_tokens=False).ids


def test_packed_blocks_round_trip():
    make = np.random.default_rng(2)
    for values in (
        np.zeros(0, np.uint32),
        np.zeros(1, np.uint32),
        make.integers(0, 2**32, 5000, dtype=np.uint64).astype(np.uint32),
        np.where(make.random(3000) < 0.01, 2**32 - 1, make.integers(0, 50, 3000)).astype(np.uint32),
        np.full(2048, 7, np.uint32),
    ):
        packed = token_blocks.pack(values)
        assert (token_blocks.unpack(packed) == values).all()
        assert (token_blocks.unpack(packed, 1, 2) == values[1024:2048]).all()
    sparse = token_blocks.pack(np.where(np.arange(4096) % 200 == 0, 10**6, np.arange(4096) % 8).astype(np.uint32))
    assert len(sparse) < 4096
    assert zlib.crc32(token_blocks.unpack(sparse).tobytes())


def test_bounds_never_exclude_a_link():
    make = np.random.default_rng(4)
    for size in (2, 8, 64):
        turn = binary_codes.rotations(size, 1)[:, :size]
        x = make.standard_normal((4000, size))
        y = x + 0.1 * make.standard_normal(x.shape) * np.linalg.norm(x, axis=1, keepdims=True) / np.sqrt(size)
        x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
        near = (x * y).sum(axis=1) >= 0.98
        rotated = x @ turn
        code = np.where(rotated >= 0, 1, -1) / np.sqrt(size)
        may = binary_codes.may_link((y @ turn * code).sum(axis=1), (rotated * code).sum(axis=1), size, 0.98)
        assert near.sum() > 500 and may[near].all()


def test_network_is_a_distribution_and_learns():
    make = np.random.default_rng(5)
    net = pseudo_likelihood.start(np.arange(2000, 0, -1)[: pseudo_likelihood.VOCABULARY], 3_000_000)
    around = make.integers(0, 100, (4, 1))
    words = np.arange(pseudo_likelihood.VOCABULARY + 1)
    logs = pseudo_likelihood.log_probability(net, np.repeat(around, len(words), axis=1), words)
    assert abs(np.exp(logs).sum() - 1) < 1e-4
    tokens = np.tile(make.integers(0, 60, 50), 200)
    before = np.array([0, len(tokens)])
    wanted = np.arange(len(tokens))
    first = pseudo_likelihood.log_probability(net, pseudo_likelihood._around(tokens, before, wanted), tokens).mean()
    for _ in range(10):
        for k in range(0, len(tokens), 1000):
            own = wanted[k : k + 1000]
            pseudo_likelihood.train_step(net, pseudo_likelihood._around(tokens, before, own), tokens[own], 0.1)
    last = pseudo_likelihood.log_probability(net, pseudo_likelihood._around(tokens, before, wanted), tokens).mean()
    assert last > first / 2


def test_estimate_is_bounded_with_the_true_size(monkeypatch):
    make, size, seen = np.random.default_rng(12), 64, []
    x = make.normal(size=size)
    vectors = np.stack([x, x + make.normal(size=size) * 0.01, make.normal(size=size), make.normal(size=size)])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    signs = vectors @ binary_codes.rotations(size, 1)[:, :size] > 0
    factor = np.abs(vectors @ binary_codes.rotations(size, 1)[:, :size]).sum(axis=1) / np.sqrt(size)
    rows = pd.DataFrame({
        "unit": 0, "side": 0, "rep": range(4), "many": 1, "band": 0, "factor": factor, "bands": [np.array([1])] * 4,
        "vector": [v.tobytes() for v in vectors], "code": [np.packbits(s).tobytes() for s in signs],
    })
    link = binary_codes.may_link

    def spy(b, factor, size, least):
        spread = binary_codes.DEVIATIONS * np.sqrt(1 - factor**2) / factor / np.sqrt(size - 1)
        seen.append((size, b / factor + spread >= least))  # the estimate's bound alone
        return link(b, factor, size, least)

    monkeypatch.setattr(binary_codes, "may_link", spy)
    out = binary_codes._compare(0.98)(rows)
    assert {s for s, _ in seen} == {size}
    passed = np.concatenate([p for _, p in seen])
    assert passed.any() and not passed.all()
    assert set(out["a"]) == {0, 1}


def test_every_word_is_a_target_once():
    ids, before = np.array([7, 8, -3, 8]), np.array([0, 500, 500, 1700, 1701])
    passes = [pseudo_likelihood._targets(ids, before, k) for k in range(pseudo_likelihood.PASSES)]
    assert sorted(np.concatenate(passes)) == list(range(1701))
    assert min(map(len, passes)) > 1701 / pseudo_likelihood.PASSES / 2
    alone = pseudo_likelihood._targets(ids[2:3], np.array([0, 1200]), 0)  # whatever lies beside it
    assert list(alone + 500) == [k for k in passes[0] if 500 <= k < 1700]


def test_training_leaves_the_shared_weights():
    vector = pseudo_likelihood.start(np.arange(50, 0, -1), 2000).vector()
    net, held = pseudo_likelihood.Network.of(vector), vector.copy()
    pseudo_likelihood.train_step(net, np.ones((4, 100), dtype=np.int64), np.arange(100) % 50, 0.1)
    assert (vector == held).all() and (net.vector() != held).any()


def plain_step(net, around, target, rate):
    """Descent of ``train_step`` with whole tables of probabilities, word by word."""
    n, many = len(target), pseudo_likelihood.CLUSTER
    hidden = np.tanh(sum(net.inputs[k][around[k]] for k in range(len(around))) + net.hidden)
    first, cluster = pseudo_likelihood._first_level(target)
    change = {name: np.zeros(x.shape) for name, x in vars(net).items()}
    for i in range(n):
        back = np.zeros(pseudo_likelihood.WIDTH)
        levels = [(net.head, net.head_bias, first[i], change["head"], change["head_bias"])]
        if cluster[i] >= 0:
            k = cluster[i]
            inside = (target[i] - pseudo_likelihood.FREQUENT) % many
            levels.append((net.tail[k], net.tail_bias[k], inside, change["tail"][k], change["tail_bias"][k]))
        for table, bias, wanted, to_table, to_bias in levels:
            slope = np.exp((table @ hidden[i] + bias).astype(float))
            slope /= slope.sum()
            slope[wanted] -= 1
            back += rate * slope @ table
            to_table -= rate * np.outer(slope, hidden[i]) / np.sqrt(n)
            to_bias -= rate * slope / n
        back *= 1 - hidden[i] ** 2
        change["hidden"] -= back / n
        for k in range(len(around)):
            change["inputs"][k][around[k][i]] -= back / np.sqrt((around[k] == around[k][i]).sum() * np.sqrt(n))
    return pseudo_likelihood.Network(**{name: x + change[name] for name, x in vars(net).items()})


@pytest.mark.parametrize("words", [pseudo_likelihood.VOCABULARY + 1, pseudo_likelihood.FREQUENT])
def test_a_step_takes_all_clusters_at_once(words, monkeypatch):
    """The plain gradient, from two tables of exponentials and one sort of all places instead of one for each."""
    make, calls = np.random.default_rng(9), {"exp": 0, "argsort": 0}
    net = pseudo_likelihood.start(np.arange(pseudo_likelihood.VOCABULARY, 0, -1), 900_000)
    around, target = make.integers(0, 60, (4, 300)), make.integers(0, words, 300)
    around[:, ::7] = pseudo_likelihood.OUTSIDE
    expected = plain_step(net, around, target, 0.1).vector()
    for name in calls:
        kept = getattr(np, name)
        monkeypatch.setattr(np, name, lambda *args, _name=name, _kept=kept, **more: calls.update({_name: calls[_name] + 1}) or _kept(*args, **more))
    pseudo_likelihood.train_step(net, around, target, 0.1)
    assert np.abs(net.vector() - expected).max() < 1e-5
    assert calls["exp"] <= 2 and calls["argsort"] <= 2


def test_classifier_finds_unseen_misspellings():
    make = random.Random(6)
    syllables = ["ba", "re", "ti", "no", "lu", "ke", "sha", "mon"]
    clean = lambda: "".join(make.choice(syllables) for _ in range(make.randint(1, 4)))
    def text(toxic, n, words):
        out = [clean() for _ in range(n)]
        if toxic:
            out[make.randrange(n)] = make.choice(words)
        return " ".join(out)
    seen = ["vexgrub", "vexgrubs", "xvexgrub", "vexgrubby", "vexgrubbed"]
    texts = [text(k % 3 == 0, 60, seen) for k in range(900)]
    model = toxicity.fit(texts, np.array([k % 3 == 0 for k in range(900)]).astype(int))
    weight, bias = model.weight()
    fresh = [text(True, 60, ["vexgrubbing", "vexgrubz"]) for _ in range(50)] + [text(False, 60, []) for _ in range(200)] + [""]
    scores = toxicity.score_texts(pa.array(fresh), weight.astype(np.float32), bias)
    assert (scores[:50] >= 0.7).mean() > 0.9 and (scores[50:] >= 0.7).mean() < 0.05
    alone = toxicity.score_texts(pa.array(fresh[3:4]), weight.astype(np.float32), bias)
    assert np.allclose(alone, scores[3])  # a text's score doesn't depend on its neighbours
