"""Masked pseudo-likelihood of documents under a bidirectional window network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.hashing import ODD, U, mix, slices, words
from flowsieve.llm.shipping import ready
from flowsieve.session import cut

#: The softmax has two levels: HEAD outputs are FREQUENT words, "any other word", and clusters of CLUSTER words.
FREQUENT, CLUSTERS, CLUSTER = 47, 16, 64
HEAD, VOCABULARY = FREQUENT + 1 + CLUSTERS, FREQUENT + CLUSTERS * CLUSTER
OTHER, OUTSIDE = VOCABULARY, VOCABULARY + 1
#: A word outside the vocabulary has its share of the counted words under "any other word". Tasks hold the
#: counts of about CACHED frequent words; the words beyond are joined with the table of counts.
CACHED = 1 << 17
#: Logarithms of joined words are summed as integers of this fineness.
LOG_FINE = 1 << 24
#: Words seen on either side, and the width of the hidden layer.
PLACES, WIDTH = (-2, -1, 1, 2), 24
#: Passes over the corpus; every word of every document is masked in one of them, chosen by hash.
PASSES = 2
#: Masked words that are kept together before they are trained on, and words that are scored at once.
BATCH, SCORE = 4096, 16384
#: Masked words of a training step.
STEP = 1024
#: Weights are summed as integers of this fineness, so that sums don't depend on their order.
FINE = 1 << 16


@dataclass
class Network:
    """Embeddings by place around the gap, a tanh layer, and the rows of the two softmax levels."""

    inputs: np.ndarray
    hidden: np.ndarray
    head: np.ndarray
    head_bias: np.ndarray
    tail: np.ndarray
    tail_bias: np.ndarray

    def vector(self) -> np.ndarray:
        return np.concatenate([x.reshape(-1) for x in vars(self).values()])

    @staticmethod
    def of(vector: np.ndarray) -> Network:
        shapes = {
            "inputs": (len(PLACES), VOCABULARY + 2, WIDTH),
            "hidden": (WIDTH,),
            "head": (HEAD, WIDTH),
            "head_bias": (HEAD,),
            "tail": (CLUSTERS, CLUSTER, WIDTH),
            "tail_bias": (CLUSTERS, CLUSTER),
        }
        parts, at = {}, 0
        for name, shape in shapes.items():
            size = int(np.prod(shape))
            # a copy: training must not change the vector that it is compared with
            parts[name] = np.array(vector[at : at + size].reshape(shape), dtype=np.float32)
            at += size
        return Network(**parts)


def start(counts: np.ndarray, total: int, seed: int = 5) -> Network:
    """Small random weights; the biases are the log frequencies of the words, most frequent first."""
    make = np.random.default_rng(seed)
    small = lambda *shape: make.normal(0, 0.1, shape)
    known = np.zeros(VOCABULARY)
    known[: len(counts)] = counts
    clusters = known[FREQUENT:].reshape(CLUSTERS, CLUSTER) + 0.5
    head = np.concatenate([known[:FREQUENT] + 0.5, [max(0, total - known.sum()) + 0.5], clusters.sum(axis=1)])
    return Network.of(
        np.concatenate(
            [
                small(len(PLACES) * (VOCABULARY + 2) * WIDTH),
                np.zeros(WIDTH),
                small(HEAD * WIDTH),
                np.log(head / head.sum()),
                small(CLUSTERS * CLUSTER * WIDTH),
                np.log(clusters / clusters.sum(axis=1, keepdims=True)).reshape(-1),
            ]
        )
    )


def _top(logits: np.ndarray) -> np.ndarray:
    """What is taken out before the exponentials: the largest logit of all, or of each row if they lie far apart."""
    top = logits.max(initial=0)
    return logits.max(axis=1, keepdims=True) if top - logits.min(initial=0) > 60 else top


def _row_sums(grown: np.ndarray) -> np.ndarray:
    return grown @ np.ones((grown.shape[1], 1), dtype=grown.dtype)


def _log_sum(logits: np.ndarray) -> np.ndarray:
    """Log of the sum of the exponentials of each row."""
    top = _top(logits)
    grown = logits - top
    total = _row_sums(np.exp(grown, out=grown))
    return (np.log(total) + top)[:, 0]


def _slope(logits: np.ndarray, target: np.ndarray, rate: float) -> np.ndarray:
    """``rate`` times the slope of the loss by each logit, in the place of the logits."""
    logits -= _top(logits)
    np.exp(logits, out=logits)
    logits *= rate / _row_sums(logits)
    logits[np.arange(len(target)), target] -= rate
    return logits


def _first_level(target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(output of the head, cluster or -1)."""
    tail = (target >= FREQUENT) & (target < VOCABULARY)
    cluster = np.where(tail, (target - FREQUENT) // CLUSTER, -1)
    return np.where(tail, FREQUENT + 1 + cluster, np.minimum(target, FREQUENT)), cluster


def _hidden(net: Network, around: np.ndarray) -> np.ndarray:
    total = net.inputs[0].take(around[0], axis=0)
    total += net.hidden
    for k in range(1, len(PLACES)):
        total += net.inputs[k].take(around[k], axis=0)
    return np.tanh(total, out=total)


def _by_cluster(cluster: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words of clusters, cluster by cluster, and where each cluster begins and the last one ends."""
    order = np.argsort(cluster.astype(np.int16), kind="stable")
    edges = np.searchsorted(cluster[order], np.arange(CLUSTERS + 1))
    return order[edges[0] :], edges - edges[0]


def _tail_logits(net: Network, hidden: np.ndarray, cluster: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Logits of the second level for words in the order of their clusters."""
    logits = net.tail_bias.take(cluster, axis=0)
    for k in range(CLUSTERS):
        own = slice(edges[k], edges[k + 1])
        logits[own] += hidden[own] @ net.tail[k].T
    return logits


def log_probability(net: Network, around: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log P(target | the words around it); around is (place, word)."""
    hidden = _hidden(net, around)
    first, cluster = _first_level(target)
    logits = hidden @ net.head.T
    logits += net.head_bias
    out = logits[np.arange(len(target)), first] - _log_sum(logits)
    own, edges = _by_cluster(cluster)
    logits = _tail_logits(net, hidden.take(own, axis=0), cluster[own], edges)
    out[own] += logits[np.arange(len(own)), (target[own] - FREQUENT) % CLUSTER] - _log_sum(logits)
    return out


def train_step(net: Network, around: np.ndarray, target: np.ndarray, rate: float) -> None:
    """One step of gradient descent on the mean loss of the masked words."""
    hidden = _hidden(net, around)
    n = len(target)
    fine = np.float32(np.sqrt(n))
    first, cluster = _first_level(target)
    logits = hidden @ net.head.T
    logits += net.head_bias
    slope = _slope(logits, first, rate)
    back = slope @ net.head
    net.head -= slope.T @ hidden / fine
    net.head_bias -= slope.sum(axis=0) / n
    own, edges = _by_cluster(cluster)
    near = hidden.take(own, axis=0)
    slope = _slope(_tail_logits(net, near, cluster[own], edges), (target[own] - FREQUENT) % CLUSTER, rate)
    pushed = np.empty_like(near)
    for k in np.flatnonzero(np.diff(edges)):
        part = slice(edges[k], edges[k + 1])
        pushed[part] = slope[part] @ net.tail[k]
        net.tail[k] -= slope[part].T @ near[part] / fine
        net.tail_bias[k] -= slope[part].sum(axis=0) / n
    back[own] += pushed
    hidden *= hidden
    back *= 1 - hidden
    net.hidden -= back.sum(axis=0) / n
    # the rows of all places are one table, so one sort brings each row's slopes together
    inputs = net.inputs.reshape(-1, WIDTH)
    rows = (around + np.arange(len(PLACES))[:, None] * (VOCABULARY + 2)).ravel().astype(np.min_scalar_type(len(inputs)))
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    at = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    total = np.add.reduceat(back.take(order % n, axis=0), at, axis=0)
    count = np.diff(np.append(at, len(rows))).astype(np.float32)
    inputs[rows[at]] -= total / np.sqrt(count * fine)[:, None]


def _numbers(hashed: np.ndarray, keys: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Word numbers; OTHER for words outside the vocabulary."""
    if not len(keys):
        return np.full(len(hashed), OTHER)
    place = np.minimum(np.searchsorted(keys, hashed), len(keys) - 1)
    return np.where(keys[place] == hashed, numbers[place], OTHER)


def _around(tokens: np.ndarray, before: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The words around the wanted places; OUTSIDE beyond the ends of the text."""
    doc = np.searchsorted(before, wanted, side="right") - 1
    out = np.empty((len(PLACES), len(wanted)), dtype=np.int64)
    for k, step in enumerate(PLACES):
        place = wanted + step
        inside = (place >= before[doc]) & (place < before[doc + 1])
        out[k] = np.where(inside, tokens[np.clip(place, 0, len(tokens) - 1)], OUTSIDE)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word hash, count) of every word of a slice."""
    for batch in batches:
        for _, _, data, offsets in slices(batch.column(0)):
            hashed = words(data, offsets)[0]
            seen, counts = np.unique(hashed, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), pa.array(counts)], ["word", "n"])


def _targets(ids: np.ndarray, before: np.ndarray, pass_number: int) -> np.ndarray:
    """Places of the words that this pass masks; they follow from document id and place in the document."""
    count = np.diff(before)
    with np.errstate(over="ignore"):
        place = (np.arange(before[-1]) - np.repeat(before[:-1], count)).astype(np.uint64)
        return np.flatnonzero(mix((place + U(1)) * ODD + np.repeat(mix(ids.view(np.uint64)), count)) % U(PASSES) == U(pass_number))


def _train(model, pass_number: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, numbers, vector = model.value
        net, seen = Network.of(vector), 0
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def learn(least: int) -> None:
            nonlocal held, seen
            if sum(len(t) for _, t in held) < least:
                return
            around, target = np.concatenate([a for a, _ in held], axis=1), np.concatenate([t for _, t in held])
            for k in range(0, len(target), STEP):
                train_step(net, around[:, k : k + STEP], target[k : k + STEP], 0.1)
            seen += len(target)
            held = []

        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy()
            for row, end, data, offsets in slices(batch.column(1)):
                hashed, before = words(data, offsets)
                if not len(hashed):
                    continue
                tokens = _numbers(hashed, keys, numbers)
                masked = _targets(ids[row:end], before, pass_number)
                held.append((_around(tokens, before, masked), tokens[masked]))
                learn(4 * BATCH)
        learn(1)
        if seen:
            change = net.vector().astype(np.float64) - vector
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.append(np.arange(len(change)), -1)),
                    pa.array(np.append(np.rint(np.clip(change, -64, 64) * FINE * seen).astype(np.int64), seen)),
                ],
                ["place", "value"],
            )

    return run


SCORED = ["at", "doc_id", "n_tokens", "log_probability", "word", "times"]


def _score(model):
    """A row per document, and a row per document and word whose count no task holds.

    ``at`` tells the rows of ``docs`` apart. The row of the document itself has a key like a word's
    that no join needs to find, and no ``times``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, numbers, vector, held, shares = model.value
        net = Network.of(vector)
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            for row, end, data, offsets in slices(batch.column(1)):
                hashed, before = words(data, offsets)
                tokens = _numbers(hashed, keys, numbers)
                logs = np.zeros(len(tokens) + 1)
                for k in range(0, len(tokens), SCORE):
                    wanted = np.arange(k, min(k + SCORE, len(tokens)))
                    logs[wanted] = log_probability(net, _around(tokens, before, wanted), tokens[wanted])
                rare = np.flatnonzero(tokens == OTHER)
                place = np.searchsorted(held, hashed[rare])
                known = np.zeros(len(rare), dtype=bool)
                known[place < len(held)] = held[place[place < len(held)]] == hashed[rare[place < len(held)]]
                logs[rare[known]] += shares[place[known]]
                sums = np.concatenate([[0.0], np.cumsum(logs[:-1])])
                ids = at + np.arange(end - row)
                at += end - row
                with np.errstate(over="ignore"):
                    own = mix(ids.astype(np.uint64) * ODD).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids),
                        batch.column(0).slice(row, end - row),
                        pa.array(np.diff(before)),
                        pa.array(sums[before[1:]] - sums[before[:-1]]),
                        pa.array(own),
                        pa.nulls(end - row, pa.int64()),
                    ],
                    SCORED,
                )
                rare = rare[~known]
                if len(rare):
                    doc = np.searchsorted(before, rare, side="right") - 1
                    order = np.lexsort((hashed[rare], doc))
                    doc, word = doc[order], hashed[rare][order]
                    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])))
                    n, times = len(first), np.diff(np.append(first, len(word)))
                    blank = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[doc[first]]), *blank, pa.array(word[first].view(np.int64)), pa.array(times)], SCORED
                    )

    return run


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) of all texts, written once: the fit, the shares and the scores read it."""
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    return cut(texts.mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))


def frequent_counts(counted: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """(sorted hashes, counts) of at most CACHED words, all those of some count or more, and the sum of all counts.

    The least count comes from a histogram of counts, eight steps to a doubling, so no task sorts all words.
    """
    step = F.floor(F.log2("n") * 8).cast("int")
    steps = counted.groupBy(step.alias("step")).agg(F.count("n").alias("words"), F.sum("n").alias("n")).orderBy(F.desc("step")).collect()
    least, words_above = None, 0
    for row in steps:
        words_above += row["words"]
        if words_above > CACHED:
            break
        least = row["step"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), sum(row["n"] for row in steps)
    found = counted.where(step >= least).toArrow()
    hashes = found["word"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], found["n"].to_numpy()[order], sum(row["n"] for row in steps)


def fit(
    docs: DataFrame, counted: DataFrame, total: int, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(sorted word hashes, their numbers, weights, words of the corpus outside the vocabulary).

    The VOCABULARY most frequent of the counted words get numbers. In each pass every
    task trains a copy of the network on the masked words of its part of the corpus (over the passes, on
    every word once); the changes,
    weighted by masked words, are averaged by Spark, weight by weight. The driver holds the
    vocabulary and one network, whatever the corpus.
    """
    spark = ready(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    top = counted.orderBy(F.desc("n"), "word").limit(VOCABULARY).toArrow()
    hashes, counts = top["word"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(hashes)
    keys, numbers = hashes[order], order.astype(np.int64)
    vector = start(counts, total).vector().astype(np.float64)
    for number in range(PASSES):
        model = spark.sparkContext.broadcast((keys, numbers, vector.astype(np.float32)))
        changes = texts.mapInArrow(_train(model, number), "place long, value long").groupBy("place").agg(F.sum("value").alias("value"))
        found = changes.toArrow()
        place, value = found["place"].to_numpy(), found["value"].to_numpy()
        if not len(place):
            break
        seen = value[place < 0][0]
        vector[place[place >= 0]] += value[place >= 0] / (FINE * seen)
    return keys, numbers, vector.astype(np.float32), total - int(counts.sum())


def pseudo_log_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, log_probability, mean_log_probability) of every row of ``docs``.

    The network is fitted to the same documents. Every word of every whole text is masked in turn and
    predicted from the words on both sides; the logarithms are summed. A word outside the vocabulary has
    the probability of "any other word" times its share of the counted words there. Texts without words have 0 tokens,
    the sum 0 and a null mean; null texts count as empty; null ids and repeated rows are scored
    as they are; an empty table gives no rows.
    """
    spark = ready(docs.sparkSession)
    counted = count_words(docs, text_col)
    held, counts, total = frequent_counts(counted)
    *fitted, others = fit(docs, counted, total, id_col, text_col)
    # one share is left for all words that were not counted
    model = spark.sparkContext.broadcast((*fitted, held, np.log(counts / (others + 1))))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(_score(model), "at long, doc_id long, n_tokens long, log_probability double, word long, times long")
    share = F.round(F.log(F.coalesce("n", F.lit(1)) / F.lit(others + 1)) * LOG_FINE).cast("long")
    whole = (
        scored.join(counted, "word", "left")
        .groupBy("at")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("n_tokens").alias("n_tokens"),
            (F.max("log_probability") + F.coalesce(F.sum(F.col("times") * share), F.lit(0)) / LOG_FINE).alias("log_probability"),
        )
        .drop("at")
    )
    mean = F.when(F.col("n_tokens") > 0, F.col("log_probability") / F.col("n_tokens"))
    return whole.withColumn("mean_log_probability", mean)
