"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are per document, so tokens are labelled first: a greedy cover picks the words and word beginnings that explain
most of the toxic documents of the sample that are still unexplained and that hardly occur in the clean ones; tokens of
toxic documents that show a picked feature are toxic, all others are not. The field has two states, transition weights,
and emission weights of hashed features (the word, its beginnings, the words beside it). It is trained on the sample on
the driver by gradient steps on its likelihood. Forward and backward passes give each token's marginal; a logistic
regression turns a document's marginals into its score; tokens with a marginal of one half or more are the toxic spans.

Words are runs of digits, letters and anything beyond ASCII, A-Z in lower case. Null and empty texts have no tokens and
get the score of a document without any sign. Without labels of both classes, every score is the share of label 1.
Rows that repeat a document get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.llm.sampling import held_out, labelled
from opsframe.llm.text import LETTERS, U64, Hashes, blocks, documents_of, lists, mix, of_bytes, words

BITS = 18
BEGINNINGS = (3, 4, 5, 6, 7, 8)  # bytes
PER_CLASS, LONGEST = (1000, 2500), 20_000  # clean and toxic documents of the sample
STRIDE = 128
TOLERANCE = 0.02  # clean documents for each toxic one, of equally many, that a picked feature may have


def tokens(data: np.ndarray, offsets: np.ndarray):
    """Starts, ends, first token per document, and the features: rows of 64-bit hashes, 0 where a token has none."""
    starts, ends, first = words(data, offsets, LETTERS)
    hashes = Hashes(of_bytes(data, lower=True))
    found = [hashes.spans(starts, ends)]
    for k in BEGINNINGS:
        part = mix(hashes.spans(starts, np.minimum(starts + k, ends)) + U64(k))
        part[ends - starts < k] = 0
        found.append(part)
    return starts, ends, first, found


def emissions(found: list[np.ndarray], first: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """How much the toxic state is favoured at each token."""
    out = np.full(len(found[0]), weights[-1], np.float32)
    for bucket in buckets(found, first):
        out += weights[bucket]
    return out


def buckets(found: list[np.ndarray], first: np.ndarray) -> Iterator[np.ndarray]:
    """For each feature the bucket of every token; bucket 0 has no weight."""
    shift, top = U64(64 - BITS), 1 << BITS
    for h in found:
        yield np.where(h == 0, 0, (h >> shift).astype(np.int64))
    word, n = found[0], len(found[0])
    edge = np.zeros(n + 1, bool)
    edge[first] = True
    before, after = np.zeros(n, np.int64), np.zeros(n, np.int64)
    before[1:] = np.where(edge[1:-1], 0, top + (mix(word[:-1] + U64(1)) >> shift).astype(np.int64)) if n else 0
    after[:-1] = np.where(edge[1:-1], 0, top + (mix(word[1:] + U64(2)) >> shift).astype(np.int64)) if n else 0
    yield before
    yield after


def marginals(emission: np.ndarray, first: np.ndarray, transition: np.ndarray, pairs: bool = False):
    """P(toxic) of each token, and with `pairs` the expected number of each (state, state) of neighbours.

    Forward and backward passes. All documents of a block form one chain whose links are cut between them. The chain is
    folded into strides that are walked side by side: once for each stride's transfer matrix, once over the strides, and
    once with what comes in. With two states a message is one ratio, toxic to clean, and a transfer maps ratios.
    """
    n = len(emission)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    rows = -(-n // STRIDE)
    grow = np.ones(rows * STRIDE)
    grow[:n] = np.exp(np.clip(emission, -30, 30))
    begins = first[:-1][np.diff(first) > 0]
    t = np.exp(transition)
    links = np.empty((4, rows * STRIDE))  # clean-clean, clean-toxic, toxic-clean, toxic-toxic, into each token
    links[:] = t.reshape(4, 1)
    links[:, begins] = 1  # documents are independent
    links[:, n:] = 1  # and so is what fills the last stride
    links = np.ascontiguousarray(links.reshape(4, rows, STRIDE).transpose(0, 2, 1))
    grow = np.ascontiguousarray(grow.reshape(rows, STRIDE).T)
    a, b, c, d = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)
    for k in range(STRIDE):
        p, q, r, s = links[0, k], links[1, k] * grow[k], links[2, k], links[3, k] * grow[k]
        a, b, c, d = a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s
        size = a + b + c + d
        a, b, c, d = a / size, b / size, c / size, d / size
    into, out = np.empty(rows), np.empty(rows)
    steps = list(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist()))
    v = 1.0
    for i, (p, q, r, s) in enumerate(steps):
        into[i] = v
        v = min(max((q + v * s) / (p + v * r), 1e-200), 1e200)
    v = 1.0
    for i in range(rows - 1, -1, -1):
        out[i] = v
        p, q, r, s = steps[i]
        v = min(max((r + s * v) / (p + q * v), 1e-200), 1e200)
    forward, backward = np.empty((STRIDE, rows)), np.empty((STRIDE, rows))
    v = into
    for k in range(STRIDE):
        v = grow[k] * (links[1, k] + v * links[3, k]) / (links[0, k] + v * links[2, k])
        forward[k] = v
    v = out
    for k in range(STRIDE - 1, -1, -1):
        backward[k] = v
        w = grow[k] * v
        v = (links[2, k] + links[3, k] * w) / (links[0, k] + links[1, k] * w)
    odds = (forward * backward).T.reshape(-1)[:n]
    toxic = odds / (1 + odds)
    if not pairs:
        return toxic, None
    f, w = forward.T.reshape(-1)[:n - 1], (grow * backward).T.reshape(-1)[1:n]
    both = np.stack([np.full(n - 1, t[0, 0]), t[0, 1] * w, t[1, 0] * f, t[1, 1] * f * w])
    both /= both.sum(0)
    both[:, begins[begins > 0] - 1] = 0
    return toxic, both.sum(1).reshape(2, 2)


def token_labels(found: list[np.ndarray], doc: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Which tokens of the sample are toxic: those that show a feature picked by the greedy cover.

    toxic: label of each document. A feature is a candidate if it is rare enough in clean documents (TOLERANCE). The cover
    ends when the best candidate explains less than three more documents, or one in five hundred.
    """
    n_docs, n_toxic = len(toxic), int(toxic.sum())
    short = U64(20)  # 44 bits of a feature and 20 of a document
    kept_names, kept_inverse, kept_of, kept_bad, known = [], [], [], [], 0
    for h in found:  # one kind of feature after the other, to hold less
        pairs = np.unique((h[h > 0] >> short << short) | doc[h > 0].astype(np.uint64))
        names, inverse = np.unique(pairs >> short, return_inverse=True)
        of = (pairs & U64((1 << 20) - 1)).astype(np.int64)
        bad = np.bincount(inverse, toxic[of], len(names))
        clean = np.bincount(inverse, 1 - toxic[of], len(names))
        # a clean document weighs as much as a toxic one: the classes of the sample differ in size
        candidate = (bad >= 3) & (clean * n_toxic <= TOLERANCE * bad * max(1, n_docs - n_toxic))
        keep = candidate[inverse] & (toxic[of] == 1)
        kept_names.append(names[candidate])
        kept_bad.append(bad[candidate])
        kept_inverse.append(known + (np.cumsum(candidate) - 1)[inverse[keep]])
        kept_of.append(of[keep])
        known += int(candidate.sum())
    names, inverse, of, bad = (np.concatenate(x) for x in (kept_names, kept_inverse, kept_of, kept_bad))
    order = np.argsort(inverse, kind="stable")
    inverse, of = inverse[order], of[order]
    begin = np.searchsorted(inverse, np.arange(len(names) + 1))
    open_docs = toxic == 1
    least = max(3, n_toxic // 500)
    picked = []
    while True:
        gain = np.bincount(inverse, open_docs[of], len(names))
        best = int(gain.argmax()) if len(gain) else 0
        if not len(gain) or gain[best] < least:
            break
        alike = np.flatnonzero(gain == gain[best])  # of equals, the one with the fewest documents in all: the longest beginning
        best = int(alike[np.argmin(bad[alike])])
        picked.append(names[best])
        open_docs[of[begin[best]:begin[best + 1]]] = False
    out = np.zeros(len(doc), bool)
    for h in found:
        out |= np.isin(h >> short, np.array(picked, np.uint64))
    return out & (toxic[doc] == 1)


class Field:
    """Weights of the field and of the regression on documents."""

    def __init__(self, share: float):
        self.weights = np.zeros((2 << BITS) + 1, np.float32)
        self.transition = np.zeros((2, 2))
        p = min(max(share, 1e-6), 1 - 1e-6)
        self.regression = np.array([np.log(p / (1 - p)), 0.0, 0.0])

    def signs(self, marginal: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
        """Per document: 1, the greatest marginal, and the log of 1 plus the expected number of toxic tokens."""
        most, total = np.zeros(n_docs), np.bincount(doc, marginal * (marginal > 0.05), n_docs)
        np.maximum.at(most, doc, marginal)
        return np.stack([np.ones(n_docs), most, np.log1p(total)], 1)

    def score(self, signs: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(signs @ self.regression, -30, 30)))


def fit(texts: list[str], labels: list[int], share: float, steps: int = 25) -> Field:
    field = Field(share)
    toxic = np.array(labels)
    if len(set(labels)) < 2:
        return field
    data, offsets = b"".join(t.encode() for t in texts), np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t.encode()) for t in texts], out=offsets[1:])
    _, _, first, found = tokens(np.frombuffer(data, np.uint8), offsets)
    n = len(found[0])
    doc = documents_of(first, n)
    truth = token_labels(found, doc, toxic).astype(np.float64)
    inner = np.ones(n, bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    seen = np.zeros((2, 2))
    inside = np.flatnonzero(inner)
    np.add.at(seen, (truth[inside - 1].astype(int), truth[inside].astype(int)), 1)
    spots = [b.astype(np.int32) for b in buckets(found, first)]
    speed, speed_t = np.full(len(field.weights), 1e-3), np.full((2, 2), 1e-3)
    field.weights[-1] = -2
    for _ in range(steps):
        marginal, pair = marginals(emissions(found, first, field.weights), first, field.transition, True)
        slope = np.zeros(len(field.weights))
        gap = truth - marginal
        for spot in spots:
            slope[:2 << BITS] += np.bincount(spot, gap, 2 << BITS)
        slope[-1] = gap.sum()
        slope[0] = 0
        slope -= 0.01 * field.weights
        speed += slope ** 2
        field.weights += (0.5 * slope / np.sqrt(speed)).astype(np.float32)
        slope_t = seen - pair - 0.01 * field.transition
        speed_t += slope_t ** 2
        field.transition += 0.2 * slope_t / np.sqrt(speed_t)
    marginal, _ = marginals(emissions(found, first, field.weights), first, field.transition)
    signs = field.signs(marginal, doc, len(texts))
    weight = np.where(toxic == 1, share / toxic.mean(), (1 - share) / (1 - toxic.mean()))
    w, ridge = field.regression, np.diag([0.01, 1.0, 1.0])

    def loss(w):
        z = signs @ w
        return (weight * (np.logaddexp(0, z) - toxic * z)).sum() + w @ ridge @ w / 2

    for _ in range(50):  # Newton's method, each step halved until it helps
        p = 1 / (1 + np.exp(-np.clip(signs @ w, -30, 30)))
        hess = (signs * (weight * p * (1 - p))[:, None]).T @ signs + ridge
        move, now = np.linalg.solve(hess, signs.T @ (weight * (toxic - p)) - ridge @ w), loss(w)
        while np.abs(move).max() > 1e-6 and loss(w + move) > now:
            move = move / 2
        w = w + move
    field.regression = w
    return field


def scores(documents: DataFrame, field: Field) -> DataFrame:
    """doc_id, score, and the toxic spans as (start, end) in bytes of the UTF-8 text."""
    shared = documents.sparkSession.sparkContext.broadcast((field.weights, field.transition, field.regression))
    text = F.coalesce(documents["text"].cast("string"), F.lit(""))
    given = documents.select(documents["doc_id"].alias("doc_id"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(0.5)
        own.weights, own.transition, own.regression = shared.value
        for batch in batches:
            for rows, data, offsets in blocks(batch):
                starts, ends, first, found = tokens(data, offsets)
                doc = documents_of(first, len(starts))
                marginal, _ = marginals(emissions(found, first, own.weights), first, own.transition)
                hit = np.flatnonzero(marginal >= 0.5)
                n = rows.num_rows
                spans = pa.StructArray.from_arrays([pa.array(starts[hit] - offsets[doc[hit]]), pa.array(ends[hit] - offsets[doc[hit]])],
                                                   ["start", "end"])
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(own.score(own.signs(marginal, doc, n))),
                     lists(spans, np.bincount(doc[hit], minlength=n))], ["doc_id", "score", "spans"])

    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(run, f"doc_id {kind}, score double, spans array<struct<start:long,end:long>>")


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, spans."""
    scored = scores(documents, fit(*labelled(documents, labels, "toxic", PER_CLASS, LONGEST)))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
