"""Toxicity scores from averaged subword embeddings and a linear softmax."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.hashing import LOWER, SLICE_BYTES
from flowsieve.llm.shipping import ready
from flowsieve.session import cut

#: Hash buckets of character n-grams, their lengths in bytes, their embedding, and the words of a window.
BUCKET_BITS, SIZES, DIMENSIONS, WINDOW = 18, (3, 4, 5, 6), 4, 16
#: The model is fitted to at most this many documents of each label, of at most this many characters.
SAMPLE, SAMPLE_CHARS = 2500, 20_000
#: Passes over the sample: with windows at random, then with the windows that speak most for the label.
WARM, EPOCHS = 2, 7
#: Texts whose n-grams are in memory at once during the fit.
BLOCK = 256
#: What is left of the embeddings after a pass, so that n-grams of single texts fade.
DECAY = 0.85
#: Factor between a window's mean embedding and the softmax, so that one word among WINDOW can decide.
SCALE = 16.0

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _grams(texts: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """(places of window starts, [(buckets, counts, is one) for each length], document of each window, bytes).

    The n-gram at place p is the one whose second byte is there, so it lies in the window of its word. A
    byte that is no letter or digit is the mark of a word's begin and end.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    raw = "\n" + "\n".join(texts.to_pylist()) + "\n" * 6
    data = np.frombuffer(raw.encode("utf-8"), dtype=np.uint8)
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = 1 + np.concatenate([[0], np.cumsum(lengths + 1)])
    letter = _LETTER[data]
    code = np.where(letter, LOWER[data], 1).astype(np.uint32)
    n = len(data) - 6
    hashed = code[:n] * np.uint32(0x9E3779B1) + code[1 : n + 1] * np.uint32(0x85EBCA77) + code[2 : n + 2] * np.uint32(0xC2B2AE3D)
    start = np.flatnonzero(letter[1 : n + 1] & ~letter[:n])  # the place before a word's first letter
    doc = np.searchsorted(begin, start + 1, side="right") - 1
    inner = letter[1 : n + 1].copy()
    if len(start):
        # a word that only repeats the one before it adds nothing
        mark = np.add.reduceat(np.where(inner, hashed, 0).astype(np.uint64), start)
        again = np.concatenate([[False], (mark[1:] == mark[:-1]) & (doc[1:] == doc[:-1])])
        word = np.cumsum(np.bincount(start, minlength=n)[:n]) - 1
        fresh = ~again[np.maximum(word, 0)]
    else:
        fresh = np.ones(n, dtype=bool)
    grams = []
    for size in SIZES:
        if size > 3:
            hashed = hashed * np.uint32(0x27D4EB2F) + code[size - 1 : n + size - 1] * np.uint32(0x165667B1)
            inner = inner & letter[size - 2 : n + size - 2]
        spread = hashed ^ (hashed >> np.uint32(15))
        grams.append(((spread * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BUCKET_BITS), inner & fresh, inner))
    first = np.searchsorted(doc, np.arange(len(texts)))
    window = (np.arange(len(start)) - first[doc]) % WINDOW == 0 if len(start) else np.zeros(0, bool)
    return start[window], grams, doc[window], data[:n]


def _window_scores(texts: pa.Array, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean weight of every window's n-grams, document of the window, place of its first word)."""
    places, grams, doc, data = _grams(texts)
    if not len(places):
        return np.zeros(0), doc, places
    total, count = np.zeros(len(data), np.float64), np.zeros(len(data), np.int64)
    for bucket, counts, valid in grams:
        total += np.where(counts, weight[bucket], 0)
        count += valid
    return SCALE * np.add.reduceat(total, places) / np.maximum(1, np.add.reduceat(count, places)), doc, places


def score_texts(texts: pa.Array, weight: np.ndarray, bias: float) -> np.ndarray:
    """Softmax probability of the toxic label in each text's most toxic window; without words, of an empty window."""
    logit = np.full(len(texts), bias, dtype=np.float64)
    values, doc, _ = _window_scores(texts, weight)
    if len(values):
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        logit[doc[first]] = np.maximum.reduceat(values, first) + bias
    return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


class SubwordModel:
    """Embeddings of n-gram buckets and the two softmax rows, trained together."""

    def __init__(self, seed: int = 11) -> None:
        self.make = np.random.default_rng(seed)
        self.embedding = self.make.uniform(-0.5, 0.5, (1 << BUCKET_BITS, DIMENSIONS)) / DIMENSIONS
        self.rows = self.make.uniform(-0.5, 0.5, (2, DIMENSIONS))
        self.offset = np.zeros(2)
        self._squares = [np.full(1 << BUCKET_BITS, 1e-8), np.full((2, DIMENSIONS), 1e-8), np.full(2, 1e-8)]

    def weight(self) -> tuple[np.ndarray, float]:
        """What an n-gram adds to the difference of the two logits, and the difference of the offsets."""
        return self.embedding @ (self.rows[1] - self.rows[0]), float(self.offset[1] - self.offset[0])

    def step(self, buckets: np.ndarray, kept: np.ndarray, sizes: np.ndarray, label: np.ndarray, share: np.ndarray, rate: float) -> None:
        """One step of adaptive gradient descent on windows: their buckets in a row, how many are each
        window's, the n-grams it has in all, its label and its weight."""
        owner = np.repeat(np.arange(len(sizes)), kept)
        mean = np.stack([np.bincount(owner, self.embedding[buckets, k], len(sizes)) for k in range(DIMENSIONS)], axis=1)
        mean *= (SCALE / np.maximum(1, sizes))[:, None]
        logits = mean @ self.rows.T + self.offset
        chance = np.exp(logits - logits.max(axis=1, keepdims=True))
        chance /= chance.sum(axis=1, keepdims=True)
        chance[np.arange(len(label)), label] -= 1
        chance *= (share / share.sum())[:, None]
        back = (chance @ self.rows) * (SCALE / np.maximum(1, sizes))[:, None]
        for value, square, slope in ((self.rows, self._squares[1], chance.T @ mean), (self.offset, self._squares[2], chance.sum(axis=0))):
            square += slope * slope
            value -= rate * slope / np.sqrt(square)
        touched, place = np.unique(buckets, return_inverse=True)
        slope = np.stack([np.bincount(place, back[owner, k], len(touched)) for k in range(DIMENSIONS)], axis=1)
        self._squares[0][touched] += (slope * slope).sum(axis=1)
        self.embedding[touched] -= rate * slope / np.sqrt(self._squares[0][touched])[:, None]


class _Windows:
    """The n-gram buckets of the windows of some texts, one window after the other."""

    def __init__(self, texts: pa.Array) -> None:
        places, grams, self.doc, data = _grams(texts)
        window = np.cumsum(np.bincount(places, minlength=len(data))[: len(data)]) - 1
        buckets, owners = [], []
        self.sizes = np.zeros(len(places), dtype=np.int64)
        for bucket, counts, valid in grams:
            own = np.flatnonzero(counts & (window >= 0))
            buckets.append(bucket[own])
            owners.append(window[own])
            self.sizes += np.bincount(window[valid & (window >= 0)], minlength=len(places))
        owner = np.concatenate(owners)
        self.buckets = np.concatenate(buckets)[np.argsort(owner, kind="stable")]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(places)))])

    def scores(self, weight: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(weight[self.buckets])])
        return (total[self.at[1:]] - total[self.at[:-1]]) / np.maximum(1, self.sizes)

    def chosen(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(buckets of the chosen windows in a row, their number per window, n-grams of each window)."""
        parts = [self.buckets[self.at[k] : self.at[k + 1]] for k in keep]
        return np.concatenate(parts).astype(np.int64), self.at[keep + 1] - self.at[keep], self.sizes[keep]


def fit(texts: list[str] | pa.Array, labels: np.ndarray, rate: float = 0.2, batch: int = 128) -> SubwordModel:
    """Train on labelled texts. A toxic text needs to be so in one window only: after the first passes, a
    text is represented by its windows of the highest score, so clean texts show what is not toxic. The
    two labels weigh the same, whatever their share. Only the texts stay in memory; the n-grams of a
    block of texts are made again in every pass.
    """
    model = SubwordModel()
    if not len(texts):
        return model
    clean = max(1, int((np.asarray(labels) == 0).sum()))
    heavier = clean / max(1, len(texts) - clean)
    order = model.make.permutation(len(texts))
    labels = np.asarray(labels)[order].astype(np.int64)
    texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
    for epoch in range(WARM + EPOCHS):
        speed = rate * (1 - epoch / (WARM + EPOCHS)) + 0.01
        if epoch:
            model.embedding *= DECAY
        weight, _ = model.weight()
        for block in model.make.permutation(-(-len(texts) // BLOCK)):
            first = int(block) * BLOCK
            windows = _Windows(texts.take(pa.array(order[first : first + BLOCK])))
            doc = windows.doc
            if not len(doc):
                continue
            if epoch < WARM:
                rank = model.make.random(len(doc))
                most = np.full(len(doc), 6)
            else:
                rank = -windows.scores(weight)
                most = np.where(labels[first + doc] == 1, 2, 3)
            by = np.lexsort((rank, doc))
            place = np.arange(len(by)) - np.searchsorted(doc[by], doc[by])
            keep = model.make.permutation(by[place < most[by]])
            for k in range(0, len(keep), batch):
                part = keep[k : k + batch]
                buckets, kept, sizes = windows.chosen(part)
                if len(buckets):
                    label = labels[first + doc[part]]
                    model.step(buckets, kept, sizes, label, np.where(label == 1, heavier, 1.0) / most[part], speed)
    return model


def _score(model):
    def run(texts: pd.Series) -> pd.Series:
        weight, bias = model.value
        column = pa.array(texts, pa.large_string(), from_pandas=True)
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
        parts, row = [], 0
        while row < len(column):
            before = ends[row - 1] if row else 0
            end = max(row + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
            parts.append(score_texts(column.slice(row, end - row), weight, bias))
            row = end
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return run


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[pa.Array, np.ndarray]:
    """Texts and labels of a bounded sample: of each label the documents with the smallest hash of the id.

    The ids are chosen from ids, lengths and labels alone; only their texts are then looked up.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(
        (F.length("text") > 0) & (F.length("text") <= SAMPLE_CHARS)
    )
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label IN (0, 1)")
    known = known.where(F.col("id").isNotNull() & (F.crc32(F.col("id").cast("string").cast("binary")) % 3 != 1)).distinct()
    usable = known.join(rows.select("id"), "id", "left_semi").withColumn("order", F.xxhash64("id", F.lit(3)))
    picked = [usable.where(F.col("label") == v).orderBy("order", "id").limit(SAMPLE) for v in (0, 1)]
    picked = cut(picked[0].unionByName(picked[1]))  # at most twice SAMPLE rows, so it may be broadcast
    found = rows.join(F.broadcast(picked), "id").orderBy("order", "label", "text").limit(2 * SAMPLE).toArrow()
    return found["text"].cast(pa.large_string()).combine_chunks(), found["label"].to_numpy().astype(np.int64)


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", least: float = 0.7
) -> DataFrame:
    """The rows of ``docs`` with the column ``toxicity`` (held_out, score, predicted).

    Words are bags of hashed character n-grams, so a misspelling shares most of its vectors with
    the word. Windows of WINDOW words are averaged and go through a linear softmax; a text's score is that
    of its most toxic window, so a long text doesn't hide one. The fit sees a bounded sample (SAMPLE
    documents per label, in the order of a hash) of the rows of ``labels`` whose crc32(id) mod 3 is not 1;
    scores use the text alone and cover every whole text. Null and empty texts get the score of
    an empty window; null ids are never held out; without usable labels scores come from the
    untrained model; repeated rows are scored each; an empty table gives no rows; other columns pass through.
    """
    spark = ready(docs.sparkSession)
    weight, bias = fit(*training_sample(docs, labels, id_col, text_col, label_col)).weight()
    model = spark.sparkContext.broadcast((weight.astype(np.float32), bias))
    score = F.pandas_udf(_score(model), "double")
    held = F.coalesce(F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    scored = docs.withColumn("__score", score(F.col(text_col).cast("string")))
    found = F.struct(held.alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= least).cast("int").alias("predicted"))
    return scored.select(*[F.col(c) for c in docs.columns if c != "toxicity"], found.alias("toxicity"))
