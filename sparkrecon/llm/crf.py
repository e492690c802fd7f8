"""Line-level linear-chain conditional random field that scores the quality of documents.

Every \\n-split line is a node with features of its own and of its neighbours; two states, good
and bad; transitions are weighted. Training lines carry the label of their document. The score
of a document is the mean probability of the good state over its lines, each line weighted by
its bytes plus one (forward-backward marginals).

The model is fitted on the driver from at most ``TRAIN_DOCUMENTS`` labelled documents, half of
each label as far as there are, chosen by a hash of the id: a documented bound that does not
grow with the table. Scoring reads every text whole. Null texts score as empty ones, repeated rows
are scored one by one, labels without a value are left out, and without labels every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrecon.llm.rules import per_row, seen_before
from sparkrecon.llm.words import Texts, chunks, column, row_of, texts_of

TRAIN_DOCUMENTS = 1_600
STEPS = 120
THRESHOLD = 0.3


def _table(characters: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(characters)] = True
    return out


_CLASSES = {
    "upper": _table(bytes(range(65, 91))),
    "lower": _table(bytes(range(97, 123))),
    "digit": _table(bytes(range(48, 58))),
    "mark": _table(b"#*$%&<>|"),
    "pipe": _table(b"|"),
    "bang": _table(b"!"),
    "stop": _table(b".,;:"),
    "wide": _table(bytes(range(128, 256))),
}
NEIGHBOUR = (1, 3, 4, 5, 9, 10)


def line_features(x: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features per line (rows of a matrix), offsets of documents into lines, line weights."""
    first, last, of_row = x.lines()
    n, rows = len(first), row_of(of_row)
    size = (last - first).astype(float)

    def count(name: str) -> np.ndarray:
        total = np.zeros(len(x.raw) + 1, dtype=np.int64)
        np.cumsum(_CLASSES[name][x.raw], out=total[1:])
        return (total[last] - total[first]).astype(float)

    starts, ends, _ = x.words()
    a, b = np.searchsorted(starts, first), np.searchsorted(starts, last)
    words = (b - a).astype(float)
    offsets = np.concatenate([a, b[-1:]]) if n else np.zeros(1, np.int64)
    hashes = x.span_hashes(starts, ends)
    again = np.zeros(len(hashes), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    line_of_word = row_of(offsets)
    repeated, _ = seen_before(hashes, line_of_word)
    upper, lower, mark = count("upper"), count("lower"), count("mark")
    some_words, some_size = np.maximum(words, 1), np.maximum(size, 1)
    copy = np.zeros(n)
    worded = np.flatnonzero(words > 0)
    later, _ = seen_before(x.span_hashes(first[worded], last[worded]), rows[worded])
    copy[worded[later]] = 1
    own = np.stack(
        [
            np.log1p(size) / 8,
            upper / np.maximum(upper + lower, 1),
            count("digit") / some_size,
            np.minimum(mark / some_words, 4),
            np.minimum(count("pipe") / some_words, 2),
            np.minimum(count("bang") / some_words, 3),
            count("stop") / some_words,
            count("wide") / some_size,
            size / some_words / 10 * (words > 0),
            per_row(again, offsets) / some_words if n else words,
            per_row(repeated, offsets) / some_words if n else words,
            copy,
            (words == 0).astype(float),
            np.minimum(words, 5) / 5,
        ],
        axis=1,
    )
    is_first, is_last = np.zeros(n), np.zeros(n)
    is_first[of_row[:-1]] = 1
    is_last[of_row[1:] - 1] = 1
    part = own[:, NEIGHBOUR]
    before, after = np.zeros_like(part), np.zeros_like(part)
    before[1:], after[:-1] = part[:-1], part[1:]
    before *= 1 - is_first[:, None]
    after *= 1 - is_last[:, None]
    return np.column_stack([np.ones(n), own, is_first, is_last, before, after]), of_row, size + 1


def marginals(
    node: np.ndarray, offsets: np.ndarray, edge: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Probability of state 1 per line, and summed pair probabilities (2 x 2).

    ``node`` is the score of state 1 (state 0 scores 0). Sequences advance together, longest
    first, so the loop runs over positions, not over lines.
    """
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    begin, lengths = offsets[:-1][order], lengths[order]
    steps = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(1, steps + 1), side="right")
    alpha = np.zeros((len(node), 2))
    beta = np.zeros((len(node), 2))
    alpha[:, 1] = node
    for t in range(1, steps):
        k = begin[: active[t]] + t
        prev = alpha[k - 1]
        alpha[k, 0] += np.logaddexp(prev[:, 0] + edge[0, 0], prev[:, 1] + edge[1, 0])
        alpha[k, 1] += np.logaddexp(prev[:, 0] + edge[0, 1], prev[:, 1] + edge[1, 1])
    pairs = np.zeros((2, 2))
    for t in range(steps - 1, 0, -1):
        k = begin[: active[t]] + t
        here = beta[k]
        here[:, 1] += node[k]
        beta[k - 1, 0] = np.logaddexp(edge[0, 0] + here[:, 0], edge[0, 1] + here[:, 1])
        beta[k - 1, 1] = np.logaddexp(edge[1, 0] + here[:, 0], edge[1, 1] + here[:, 1])
        joint = alpha[k - 1][:, :, None] + edge[None] + here[:, None, :]
        joint -= joint.max(axis=(1, 2), keepdims=True)
        joint = np.exp(joint)
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    both = alpha + beta
    return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500))), pairs


def fit(features: np.ndarray, offsets: np.ndarray, labels: np.ndarray) -> dict:
    """Penalised likelihood by gradient steps with momentum and per-weight scaling."""
    scale = np.maximum(features.std(axis=0), 1e-3)
    scale[0] = 1
    x = features / scale
    rows = row_of(offsets)
    y = labels[rows].astype(float)
    weight = np.zeros(x.shape[1] + 4)
    weight[-4:] = [0.5, -0.5, -0.5, 0.5]
    inner = (np.diff(offsets) - 1).astype(float)
    seen = np.array([[inner[labels == 0].sum(), 0], [0, inner[labels == 1].sum()]])
    slow, fast = np.zeros_like(weight), np.zeros_like(weight)
    n = max(len(labels), 1)
    for step in range(1, STEPS + 1):
        edge = weight[-4:].reshape(2, 2)
        p, pairs = marginals(x @ weight[:-4], offsets, edge)
        slope = np.concatenate([x.T @ (p - y), (pairs - seen).ravel()]) / n + 2e-3 * weight
        slow = 0.9 * slow + 0.1 * slope
        fast = 0.99 * fast + 0.01 * slope * slope
        weight -= 0.1 * (slow / (1 - 0.9**step)) / (np.sqrt(fast / (1 - 0.99**step)) + 1e-8)
    return {"weight": weight[:-4] / scale, "edge": weight[-4:].reshape(2, 2)}


def train(docs: DataFrame, labelled: DataFrame, label: str = "quality") -> dict | None:
    """Fit on a bounded choice of ``labelled`` (doc_id, label) rows joined to their texts."""
    known = labelled.select("doc_id", F.col(label).cast("int").alias("_y")).filter(F.col("_y").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.max("_y").alias("_y"))
    half = TRAIN_DOCUMENTS // 2
    chosen = [
        known.filter(F.col("_y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(half) for y in (0, 1)
    ]
    picked = chosen[0].unionByName(chosen[1])
    texts = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull())
    sample = texts.join(F.broadcast(picked), "doc_id")

    def run(batches):
        for batch in batches:
            for piece in chunks(batch):
                matrix, offsets, _ = line_features(texts_of(column(piece, "text")))
                blobs = [
                    matrix[offsets[i] : offsets[i + 1]].astype("<f4").tobytes() for i in range(len(offsets) - 1)
                ]
                yield pa.RecordBatch.from_arrays(
                    [column(piece, "doc_id"), column(piece, "_y"), pa.array(blobs, pa.binary())],
                    ["doc_id", "y", "f"],
                )

    rows = sample.mapInArrow(run, "doc_id long, y int, f binary").collect()
    rows = sorted({(r["doc_id"], bytes(r["f"])): r["y"] for r in rows}.items())
    if not rows:
        return None
    width = line_features(Texts(np.zeros(0, np.uint8), np.zeros(2, np.int64)))[0].shape[1]
    blocks = [np.frombuffer(f, "<f4").reshape(-1, width) for (_, f), _ in rows]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])])
    return fit(np.concatenate(blocks).astype(float), offsets, np.array([y for _, y in rows]))


def document_scores(x: Texts, model: dict | None) -> np.ndarray:
    if model is None:
        return np.full(x.n, 0.5)
    features, offsets, size = line_features(x)
    p, _ = marginals(features @ model["weight"], offsets, model["edge"])
    total = np.zeros(len(p) + 1)
    np.cumsum(p * size, out=total[1:])
    weight = np.zeros(len(p) + 1)
    np.cumsum(size, out=weight[1:])
    mean = (total[offsets[1:]] - total[offsets[:-1]]) / (weight[offsets[1:]] - weight[offsets[:-1]])
    return np.clip(mean, 0.0, 1.0)


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id and ``score`` in 0 to 1; the higher, the likelier the document is good."""

    def run(batches):
        for batch in batches:
            for piece in chunks(batch):
                values = document_scores(texts_of(column(piece, "text")), model)
                yield pa.RecordBatch.from_arrays(
                    [column(piece, "doc_id"), pa.array(values, pa.float64())], ["doc_id", "score"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def good_documents(docs: DataFrame, model: dict | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, all columns kept."""
    names = [f.name for f in docs.schema.fields]
    schema = docs.schema

    def run(batches):
        for batch in batches:
            for piece in chunks(batch):
                values = document_scores(texts_of(column(piece, "text")), model)
                yield piece.filter(pa.array(values >= threshold))

    return docs.mapInArrow(run, schema).select(*names)
