"""Quality scores from a sparse ensemble of rules over statistics of a text."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.hashing import slices
from flowsieve.llm.naming import free_name
from flowsieve.llm.periodic_runs import word_ids, word_places
from flowsieve.llm.shipping import ready
from flowsieve.session import cut

#: Words of a window; the statistics called ``worst`` are those of the window where they are highest.
WINDOW = 32
STATISTICS = (
    "words", "word_bytes", "line_words", "upper", "symbols", "odd_symbols", "digits", "bare_words", "doubled_ends",
    "repeats", "longest_repeat", "distinct", "sentence_ends", "worst_upper", "worst_symbols", "worst_repeats",
)

#: The ensemble: trees, their depth, the share of the sample and the statistics each tree sees, candidate thresholds.
TREES, DEPTH, SHARE, SEEN, THRESHOLDS = 60, 3, 0.5, 6, 24
#: Weight of the lasso's penalty, its steps, and the least size of a weight that is kept.
PENALTY, STEPS, LEAST_WEIGHT = 0.002, 600, 1e-3

_UPPER, _LETTER, _DIGIT, _SYMBOL, _ODD, _END = (np.zeros(256, dtype=bool) for _ in range(6))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SYMBOL[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_ODD[:] = _SYMBOL
_ODD[list(b".,;:'\"-?()")] = False
_END[list(b".!?")] = True


def _per(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, weights=values, minlength=n)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of STATISTICS per text, over the whole text; a text without words has zeros."""
    out = np.zeros((len(texts), len(STATISTICS)))
    for row, last, data, offsets in slices(texts):
        first, end, before = word_places(data, offsets)
        if not len(first):
            continue
        n = last - row
        doc, size = np.repeat(np.arange(n), np.diff(before)), end - first
        word = word_ids(data, first, end)

        def within(table: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(table[data])])
            return (total[end] - total[first]).astype(np.float64)

        upper, letters, symbols = within(_UPPER), within(_LETTER), within(_SYMBOL)
        named = within(_LETTER | _DIGIT | (np.arange(256) > 127))
        again = np.zeros(len(first), dtype=bool)
        again[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
        place = np.arange(len(first)) - before[doc]
        stretch = np.arange(len(first)) - np.maximum.accumulate(np.where(again, 0, np.arange(len(first))))
        tail = data[end - 1]
        doubled = (size > 2) & _SYMBOL[tail] & (data[np.maximum(end - 2, 0)] == tail)
        line = np.zeros(len(first), dtype=bool)
        breaks = np.concatenate([[0], np.cumsum(data == 10)])
        line[1:] = breaks[first[1:]] > breaks[first[:-1]]
        # words that came before in the text: the first place of each (text, word) is new
        order = np.lexsort((np.arange(len(first)), word, doc))
        new = np.ones(len(first), dtype=bool)
        new[order[1:]] = (word[order[1:]] != word[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])

        words = np.maximum(1, np.diff(before)).astype(np.float64)
        shown = np.maximum(1, _per(size, doc, n))
        table = out[row:last]
        table[:, 0] = np.diff(before)
        table[:, 1] = _per(size, doc, n) / words
        table[:, 2] = words / (1 + _per(line & (place > 0), doc, n))
        table[:, 3] = _per(upper, doc, n) / np.maximum(1, _per(letters, doc, n))
        table[:, 4] = _per(symbols, doc, n) / shown
        table[:, 5] = _per(within(_ODD), doc, n) / shown
        table[:, 6] = _per(within(_DIGIT), doc, n) / shown
        table[:, 7] = _per(named == 0, doc, n) / words
        table[:, 8] = _per(doubled, doc, n) / words
        table[:, 9] = _per(again, doc, n) / words
        np.maximum.at(table[:, 10], doc, stretch + 1)
        table[:, 11] = _per(new, doc, n) / words
        table[:, 12] = _per(_END[tail], doc, n) / words
        starts = np.flatnonzero(place % WINDOW == 0)
        owner = doc[starts]
        count = np.diff(np.append(starts, len(first)))
        full = np.minimum(WINDOW, words[owner])  # a short last window does not weigh more than its words
        for column, over, under in ((13, upper, np.maximum(1, np.add.reduceat(letters, starts))), (14, symbols, np.add.reduceat(size, starts)), (15, again, full)):
            share = np.add.reduceat(over.astype(np.float64), starts) / under * (count / full)
            np.maximum.at(table[:, column], owner, share)
    return out


@dataclass(frozen=True)
class Rule:
    """A conjunction: for each (statistic, low, high) low < value <= high."""

    bounds: tuple[tuple[int, float, float], ...]

    def holds(self, table: np.ndarray) -> np.ndarray:
        out = np.ones(len(table), dtype=bool)
        for k, low, high in self.bounds:
            out &= (table[:, k] > low) & (table[:, k] <= high)
        return out

    def column(self, stats: Column) -> Column:
        parts = []
        for k, low, high in self.bounds:
            value = stats[STATISTICS[k]]
            parts += [value > low] if low > -np.inf else []
            parts += [value <= high] if high < np.inf else []
        return reduce(lambda a, b: a & b, parts)


@dataclass(frozen=True)
class RuleModel:
    """Weighted rules; the logit of a text is the bias plus the weights of the rules that hold."""

    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, table: np.ndarray) -> np.ndarray:
        logit = np.full(len(table), self.bias)
        for rule, weight in self.rules:
            logit += weight * rule.holds(table)
        return 1 / (1 + np.exp(-logit))

    def column(self, stats: Column) -> Column:
        """The score as an expression over a struct of STATISTICS."""
        logit = F.lit(self.bias)
        for rule, weight in self.rules:
            logit = logit + F.when(rule.column(stats), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def _best_split(bins: np.ndarray, slope: np.ndarray, columns: np.ndarray) -> tuple[float, int, int]:
    """(gain, statistic, last bin of the left side) of the split that tells the slopes apart best."""
    best = (1e-9, -1, -1)
    for k in columns:
        total = np.cumsum(np.bincount(bins[:, k], weights=slope, minlength=THRESHOLDS + 1))
        count = np.cumsum(np.bincount(bins[:, k], minlength=THRESHOLDS + 1))
        left, right = count[:-1], count[-1] - count[:-1]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = total[:-1] ** 2 / left + (total[-1] - total[:-1]) ** 2 / right - total[-1] ** 2 / count[-1]
        gain = np.where((left >= 5) & (right >= 5), gain, 0)
        at = int(np.argmax(gain))
        if gain[at] > best[0]:
            best = (float(gain[at]), int(k), at)
    return best


def tree_rules(table: np.ndarray, label: np.ndarray, seed: int = 13) -> list[Rule]:
    """The distinct paths of a boosted ensemble of small trees, from the root to every inner node and leaf."""
    make = np.random.default_rng(seed)
    ranks = np.linspace(0, 1, THRESHOLDS + 2)[1:-1]
    # midway between two values that occur, so that a bound is met by neither
    edges = []
    for k in range(table.shape[1]):
        values = np.unique(table[:, k])
        middle = (values[1:] + values[:-1]) / 2
        edges.append(np.unique(middle[(ranks * (len(middle) - 1)).round().astype(int)]) if len(middle) else np.zeros(0))
    bins = np.stack([np.searchsorted(e, table[:, k], side="left") for k, e in enumerate(edges)], axis=1)
    logit = np.zeros(len(label))
    found: dict[Rule, None] = {}

    def grow(rows: np.ndarray, slope: np.ndarray, bounds: dict, depth: int, columns: np.ndarray) -> None:
        if bounds:
            rule = Rule(tuple((k, *bounds[k]) for k in sorted(bounds)))
            found.setdefault(rule)
        gain, k, at = _best_split(bins[rows], slope[rows], columns) if depth and len(rows) >= 10 else (0, -1, -1)
        if k < 0 or at >= len(edges[k]):
            chance = 1 / (1 + np.exp(-logit[rows]))
            leaf = Rule(tuple((j, *bounds[j]) for j in sorted(bounds)))
            logit[leaf.holds(table)] += 0.3 * slope[rows].sum() / max(1e-6, (chance * (1 - chance)).sum())
            return
        low, high = bounds.get(k, (-np.inf, np.inf))
        edge = float(edges[k][at])
        left = bins[rows, k] <= at
        grow(rows[left], slope, {**bounds, k: (low, min(high, edge))}, depth - 1, columns)
        grow(rows[~left], slope, {**bounds, k: (max(low, edge), high)}, depth - 1, columns)

    for _ in range(TREES):
        slope = label - 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        rows = np.flatnonzero(make.random(len(label)) < SHARE)
        columns = np.sort(make.permutation(table.shape[1])[:SEEN])
        if len(rows):
            grow(rows, slope, {}, DEPTH, columns)
        logit = np.clip(logit, -6, 6)
    return list(found)


def lasso(holds: np.ndarray, label: np.ndarray, share: np.ndarray) -> tuple[float, np.ndarray]:
    """(bias, weights) of a logistic model with an absolute penalty on the weights, by accelerated gradient steps."""
    holds = holds.astype(np.float64)
    share = share / share.sum()
    rate = 4 / max(1e-9, float(((holds * holds).sum(axis=1) + 1) @ share))
    weights, bias = np.zeros(holds.shape[1]), 0.0
    ahead, ahead_bias, pace = weights, bias, 1.0
    for _ in range(STEPS):
        error = share * (1 / (1 + np.exp(-(holds @ ahead + ahead_bias))) - label)
        moved = ahead - rate * (holds.T @ error)
        new = np.sign(moved) * np.maximum(0, np.abs(moved) - rate * PENALTY)
        new_bias = ahead_bias - rate * float(error.sum())
        after = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead, ahead_bias = new + (pace - 1) / after * (new - weights), new_bias + (pace - 1) / after * (new_bias - bias)
        weights, bias, pace = new, new_bias, after
    return bias, weights


def fit(table: np.ndarray, label: np.ndarray) -> RuleModel:
    """Rules and weights from statistics and labels; both labels weigh the same. With one label or
    none the model has no rules: a bias for the label seen, or 0."""
    label = np.asarray(label, dtype=np.float64)
    ones, zeros = int(label.sum()), int(len(label) - label.sum())
    if not ones or not zeros:
        return RuleModel(float(np.log((ones + 1) / (zeros + 1))), ())
    rules = tree_rules(table, label)
    if not rules:
        return RuleModel(0.0, ())
    holds = np.stack([rule.holds(table) for rule in rules], axis=1)
    bias, weights = lasso(holds, label, np.where(label == 1, 1 / ones, 1 / zeros))
    return RuleModel(float(bias), tuple((rules[k], float(weights[k])) for k in np.flatnonzero(np.abs(weights) >= LEAST_WEIGHT)))


def _stats_udf():
    schema = ", ".join(f"{name}: double" for name in STATISTICS)

    @F.arrow_udf(f"struct<{schema}>")
    def stats(texts: pa.Array) -> pa.Array:
        table = statistics(texts)
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(table[:, k])) for k in range(len(STATISTICS))], list(STATISTICS))

    return stats


def training_table(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``sample`` documents per label, those with the smallest hash of the id."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("label IN (0, 1)")
    known = known.where(F.col("id").isNotNull() & ~held_out(F.col("id"))).distinct()
    usable = known.join(rows.select("id"), "id", "left_semi").withColumn("order", F.xxhash64("id", F.lit(7)))
    picked = [usable.where(F.col("label") == v).orderBy("order", "id").limit(sample) for v in (0, 1)]
    picked = cut(picked[0].unionByName(picked[1]))  # at most twice the sample, so it may be broadcast
    found = rows.join(F.broadcast(picked), "id").select("order", "label", _stats_udf()(F.col("text")).alias("stats"))
    found = found.select("order", "label", "stats.*").orderBy("order", "label", *STATISTICS).limit(2 * sample).toArrow()
    table = np.stack([found[name].to_numpy() for name in STATISTICS], axis=1) if len(found) else np.zeros((0, len(STATISTICS)))
    return table, found["label"].to_numpy()


def held_out(key: Column) -> Column:
    """Whether the labels of this id are left for testing: crc32 of its digits mod 4 is 2; not for null."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    least: float = 0.7,
    sample: int = 2500,
) -> DataFrame:
    """The rows of ``docs`` with the column ``quality`` (held_out, score, predicted).

    Small trees are boosted on STATISTICS of labelled texts; every path of a tree is a rule, a
    conjunction of bounds; a logistic model with a lasso penalty picks and weighs few of them; these are compiled into
    column expressions over the statistics, which cover the whole text of every row. The fit sees at most ``sample``
    documents per label (chosen by a hash of the id) of the rows of ``labels`` that are not held out; of these only
    the statistics come to the driver. Ids, labels and other columns are no part of a score.

    Null and empty texts have statistics of zero and the score these give; null ids are never held out nor learnt from; other
    labels than 0 and 1 are ignored; without labels every score is 0.5; repeated rows are scored each; an empty table gives no
    rows. Other columns pass through; a column that is called ``quality`` already is replaced.
    """
    ready(docs.sparkSession)
    model = fit(*training_table(docs, labels, id_col, text_col, label_col, sample))
    stats, score = free_name(docs.columns, "stats"), free_name(docs.columns, "score")
    rows = docs.withColumn(stats, _stats_udf()(F.col(f"`{text_col}`").cast("string")))
    rows = rows.withColumn(score, model.column(F.col(stats)))
    found = F.struct(
        held_out(F.col(f"`{id_col}`")).alias("held_out"), F.col(score).alias("score"), (F.col(score) >= least).cast("int").alias("predicted")
    )
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "quality"], found.alias("quality"))
