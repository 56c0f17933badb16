"""BPE encoding of whole texts by tree concatenation, and decoding."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.chunks import ChunkEncoder, encoder
from flowsieve.llm.shipping import ready
from flowsieve.session import cut

#: Characters of a leaf, which is encoded as it is, and of a piece, which is a row (and task) of its own.
LEAF, PIECE = 8192, 65536
#: Tokens on each side of a joint that are encoded anew at first, and equal tokens in a row that count as agreement.
WINDOW, AGREE = 16, 4
#: Texts that are encoded at once.
TEXTS = 256
#: Characters at the ends of a leaf whose tokens are kept with their places.
EDGE = 256


@dataclass
class Node:
    """Token ids of a text, and the (start, end) characters of its first and of its last tokens."""

    ids: np.ndarray
    head: np.ndarray
    tail: np.ndarray

    def spans(self, text: str, count: int, at_end: bool, base: ChunkEncoder) -> np.ndarray:
        """Places of the first or last ``count`` tokens (of all, if fewer)."""
        known = self.tail if at_end else self.head
        if len(known) < min(count, len(self.ids)):
            self.head = self.tail = known = _encode(text, base)[1]
        return known[max(0, len(known) - count) :] if at_end else known[:count]


def _encode(text: str, base: ChunkEncoder) -> tuple[np.ndarray, np.ndarray]:
    code = base.tokenizer.encode(text, add_special_tokens=False)
    return np.array(code.ids, dtype=np.uint32), np.array(code.offsets, dtype=np.int64).reshape(-1, 2)


def leaf(text: str, base: ChunkEncoder) -> Node:
    """A text encoded as it is; places are looked up for its ends only, as far as the next space."""
    ids = base.encode([text])[0]
    cut_head = text.find(" ", EDGE)
    cut_tail = text.rfind(" ", 0, max(0, len(text) - EDGE)) + 1
    head = _encode(text if cut_head < 0 else text[:cut_head], base)[1]
    tail = _encode(text[cut_tail:], base)[1] + cut_tail
    return Node(ids, head, tail)


def halves(length: int, size: int) -> list[int]:
    """Places that cut a text of this length into halves, and those again, down to ``size`` characters."""
    parts = 1
    while length > size * parts:
        parts *= 2
    return [length * k // parts for k in range(parts + 1)]


def _meet(ids: np.ndarray, spans: np.ndarray, fresh: np.ndarray, places: np.ndarray, first: bool) -> tuple[int, int] | None:
    """First or last place where AGREE tokens in a row (ids and places) are the same: (index, index in fresh)."""
    known = {(int(t), int(s), int(e)): k for k, (t, (s, e)) in enumerate(zip(ids, spans))}
    tokens = [(int(t), int(s), int(e)) for t, (s, e) in zip(fresh, places)]
    order = range(len(tokens) - AGREE + 1)
    for j in order if first else reversed(order):
        i = known.get(tokens[j])
        if i is not None and all(known.get(tokens[j + k]) == i + k for k in range(AGREE)):
            return (i, j) if first else (i + AGREE, j + AGREE)
    return None


def join(text: str, left: Node, right: Node, middle: int, base: ChunkEncoder) -> Node:
    """Tokens of ``text`` from those of text[:middle] and text[middle:].

    The text around the joint is encoded anew, from the start of a token on the left to the end of
    one on the right. Where AGREE tokens in a row are the same (ids and places) on the left, and
    again on the right, the three runs are put together there: every two neighbours in the
    result then are neighbours in an encoding of their own surroundings. If either side doesn't
    agree, the window is doubled, in the end to the whole text.
    """
    size = WINDOW
    while True:
        one = left.spans(text[:middle], size, True, base)
        two = right.spans(text[middle:], size, False, base) + middle
        all_left, all_right = len(one) == len(left.ids), len(two) == len(right.ids)
        begin = 0 if all_left else int(one[0, 0])
        end = len(text) if all_right else int(two[-1, 1])
        fresh, places = _encode(text[begin:end], base)
        places = places + begin
        skip = len(left.ids) - len(one)
        start = (0, 0) if all_left else _meet(left.ids[skip:], one, fresh, places, True)
        stop = (len(two), len(fresh)) if all_right else _meet(right.ids[: len(two)], two, fresh, places, False)
        if start is not None and stop is not None and start[1] <= stop[1]:
            break
        size *= 2
    kept, gone = skip + start[0], stop[0]
    inner = places[start[1] : stop[1]]
    head, tail = left.head[:kept], right.tail[max(0, gone - len(right.ids) + len(right.tail)) :] + middle
    if len(head) == kept:
        head = np.concatenate([head, inner, two[gone:]])
    if len(tail) == len(right.ids) - gone:
        tail = np.concatenate([one[: start[0]], inner, tail])
    return Node(np.concatenate([left.ids[:kept], fresh[start[1] : stop[1]], right.ids[gone:]]), head, tail)


def tree(text: str, cuts: list[int], nodes: list[Node], base: ChunkEncoder) -> Node:
    """Join the encoded parts text[cuts[i]:cuts[i + 1]] pair by pair."""
    while len(nodes) > 1:
        joined, places = [], [cuts[0]]
        for k in range(0, len(nodes), 2):
            begin, middle, end = cuts[k], cuts[k + 1], cuts[k + 2]
            joined.append(join(text[begin:end], nodes[k], nodes[k + 1], middle - begin, base))
            places.append(end)
        nodes, cuts = joined, places
    return nodes[0]


def encode_tree(text: str, base: ChunkEncoder) -> Node:
    """Tokens of a text, from leaves up."""
    cuts = halves(len(text), LEAF)
    return tree(text, cuts, [leaf(text[a:b], base) for a, b in zip(cuts[:-1], cuts[1:])], base)


def _digests(codes: list[np.ndarray], base: ChunkEncoder) -> tuple[list[int], list[str], list[str]]:
    decoded = base.decode(codes)
    return (
        [len(c) for c in codes],
        [hashlib.sha256(c.astype("<u4").tobytes()).hexdigest() for c in codes],
        [hashlib.sha256(d.encode("utf-8")).hexdigest() for d in decoded],
    )


def _short(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = encoder(path, keep_space=False)
        for batch in batches:
            for first in range(0, batch.num_rows, TEXTS):
                part = batch.slice(first, TEXTS)
                texts = [t or "" for t in part.column(1).to_pylist()]
                leaves = [k for k, t in enumerate(texts) if len(t) <= LEAF]
                ids, at = base.encode([texts[k] for k in leaves])
                codes: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
                for n, k in enumerate(leaves):
                    codes[k] = ids[at[n] : at[n + 1]]
                for k, t in enumerate(texts):
                    if len(t) > LEAF:
                        codes[k] = encode_tree(t, base).ids
                counts, one, two = _digests(codes, base)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64()), pa.array(one), pa.array(two)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1)):
            text = text.as_py()
            cuts = halves(len(text), PIECE)
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key.as_py()], pa.binary()), pa.array([k]), pa.array([text[a:b]])], ["mark", "piece", "text"]
                )


def _encode_pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = encoder(path, keep_space=False)
        for batch in batches:
            nodes = [encode_tree(t, base) for t in batch.column(2).to_pylist()]
            ids = pa.array([n.ids.astype("<u4").tobytes() for n in nodes], pa.binary())
            head = pa.array([n.head.astype("<i8").tobytes() for n in nodes], pa.binary())
            tail = pa.array([n.tail.astype("<i8").tobytes() for n in nodes], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, head, tail], ["mark", "piece", "text", "ids", "head", "tail"])

    return run


def _join_pieces(path: str):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        base = encoder(path, keep_space=False)
        rows = rows.sort_values("piece")
        texts = rows["text"].tolist()
        cuts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).tolist()
        nodes = [
            Node(*(np.frombuffer(i, "<u4").astype(np.uint32), *(np.frombuffer(x, "<i8").reshape(-1, 2) for x in (h, t))))
            for i, h, t in zip(rows["ids"], rows["head"], rows["tail"])
        ]
        ids = tree("".join(texts), cuts, nodes, base).ids
        counts, one, two = _digests([ids], base)
        return pd.DataFrame({"mark": [rows["mark"].iloc[0]], "n_tokens": counts, "ids_sha256": one, "decoded_sha256": two})

    return run


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row.

    Texts up to PIECE characters are encoded in one task, by a tree of leaves where they are
    longer than a leaf. Longer texts are halved into pieces that are rows of their own, so their parts
    are encoded in parallel by different tasks; then the pieces of a text are joined pair by
    pair. Equal long texts are encoded once and the result is joined to all their rows. Null
    texts count as empty; null ids and repeated rows are kept; an empty table gives no rows.
    """
    ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    is_long = F.coalesce(F.length("text") > PIECE, F.lit(False))
    short = rows.where(~is_long).mapInArrow(_short(path), f"doc_id long, {out}")
    long = cut(rows.where(is_long).select("doc_id", F.unhex(F.sha2("text", 256)).alias("mark"), "text"))
    once = long.groupBy("mark").agg(F.max("text").alias("text"))
    pieces = once.mapInArrow(_pieces, "mark binary, piece long, text string").repartition("mark", "piece")
    coded = pieces.mapInArrow(
        _encode_pieces(path), "mark binary, piece long, text string, ids binary, head binary, tail binary"
    )
    joined = coded.groupBy("mark").applyInPandas(_join_pieces(path), f"mark binary, {out}")
    return short.unionByName(long.select("doc_id", "mark").join(joined, "mark").drop("mark"))
