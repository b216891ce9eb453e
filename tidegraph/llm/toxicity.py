"""Toxicity: a linear-chain conditional random field over tokens, trained from labelled documents.

Document labels become token labels: a token of a toxic document is a toxic span token if a feature of it (the word, or its first
4, 5 or 6 letters) stands in toxic documents far more often than chance allows (Chernoff bound on the binomial tail). The chain has two
tags, one weight per kept feature, a bias and transitions, fitted by gradient steps on exact forward-backward marginals. Tokens
without a kept feature all have the same potentials, so that runs of them are one power of a 2x2 matrix, taken from its
eigenvalues: scoring steps from event to event and stays exact. A document's score is a logistic function of the expected number
of toxic tokens and the largest marginal; tokens with a marginal of one half or more are its offending spans.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import map_batches, release_driver_memory

EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
TOKEN = re.compile(r"\S+")
#: Bits of evidence (nats) that keep a feature, and that make a token a labelled span.
KEEP, SPAN = 8.0, 11.5
#: Bins of the minhash of a training text, and the estimated similarity from which it is a copy.
BINS, COPY = 128, 0.75
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def features_of(token: str) -> list[str]:
    word = token.lower().strip(EDGES)
    return [word, *(f"{word[:k]}*" for k in (4, 5, 6) if len(word) > k)] if word else []


def evidence(a: int, b: int, rate: float) -> float:
    """n * KL(a/n || rate) where the share of toxic documents is above rate, else 0."""
    n, q = a + b, a / (a + b)
    if q <= rate:
        return 0.0
    return n * (q * math.log(q / rate) + ((1 - q) * math.log((1 - q) / (1 - rate)) if q < 1 else 0.0))


@dataclass
class Crf:
    """Emission weights of tag 1 against tag 0 by feature, bias, log transitions, and the document's logistic function."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -6.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    doc: tuple[float, float, float] = (-4.0, 0.0, 0.0)

    def emission(self, token: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features_of(token))

    def marginals(self, events: list[np.ndarray], scores: list[np.ndarray], lengths: np.ndarray) -> list[np.ndarray]:
        """P(tag 1) at the event tokens (positions, ascending) of each document; exact for the whole chain."""
        n = np.array([len(e) for e in events])
        most = int(n.max(initial=0))
        out = [np.zeros(k) for k in n]
        if not most:
            return out
        order = np.argsort(-n, kind="stable")
        lanes = int((n > 0).sum())
        order = order[:lanes]
        pos, emit = np.zeros((most, lanes), np.int64), np.zeros((most, lanes))
        for j, d in enumerate(order):
            pos[: n[d], j], emit[: n[d], j] = events[d], scores[d]
        count, length = n[order], np.asarray(lengths)[order]
        m, eb = np.exp(self.trans), math.exp(self.bias)
        k = m * np.array([1.0, eb])
        values, right = np.linalg.eig(k)
        values, right = values.real, right.real
        top = int(np.argmax(values))
        left = np.linalg.inv(right)
        p1, p2 = np.outer(right[:, top], left[top]), np.outer(right[:, 1 - top], left[1 - top])
        ratio = values[1 - top] / values[top]

        def power(gap: np.ndarray) -> np.ndarray:
            return p1 + (ratio**gap)[:, None, None] * p2

        def unit(v: np.ndarray) -> np.ndarray:
            return v / v.sum(1, keepdims=True)

        psi = np.exp(np.clip(emit + self.bias, -60, 60))
        alpha = np.zeros((most, lanes, 2))
        for t in range(most):
            live = int((count > t).sum())
            if t:
                v = np.einsum("di,dij->dj", alpha[t - 1, :live], power(pos[t, :live] - pos[t - 1, :live] - 1)) @ m
            else:
                gap = pos[0, :live]
                v = np.einsum("i,dij->dj", np.array([1.0, eb]), power(np.maximum(gap - 1, 0))) @ m
                v[gap == 0] = 1.0
            v[:, 1] *= psi[t, :live]
            alpha[t, :live] = unit(v)
        beta = np.zeros((lanes, 2))
        for t in range(most - 1, -1, -1):
            live, ended = int((count > t).sum()), count == t + 1
            if t + 1 < most and (on := count > t + 1).any():
                last = int(on.sum())
                v = beta[:last].copy()
                v[:, 1] *= psi[t + 1, :last]
                beta[:last] = unit(np.einsum("dij,dj->di", power(pos[t + 1, :last] - pos[t, :last] - 1), v @ m.T))
            if ended.any():
                beta[ended] = unit(power(length[ended] - pos[t, ended] - 1).sum(2))
            both = alpha[t, :live] * beta[:live]
            p = both[:, 1] / both.sum(1)
            for j, d in enumerate(order[:live]):
                out[d][t] = p[j]
        return out

    def score(self, marginals: np.ndarray) -> float:
        a, b, c = self.doc
        z = a + b * math.log1p(float(marginals.sum())) + c * float(marginals.max(initial=0.0))
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, z))))


class Memo(dict):
    """Emission of each token met, emptied when it holds too many."""

    def __init__(self, crf: Crf, most: int = 150_000):
        self.crf, self.most = crf, most

    def __missing__(self, token: str) -> float:
        if len(self) >= self.most:
            self.clear()
        self[token] = value = self.crf.emission(token)
        return value


def events_of(text: str | None, memo: Memo) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions and emissions of tokens with a kept feature, and the token count."""
    tokens = (text or "").split()
    values = np.fromiter(map(memo.__getitem__, tokens), np.float64, len(tokens))
    at = np.flatnonzero(values)
    return at, values[at], len(tokens)


def full_pass(x: np.ndarray, mask: np.ndarray, bias: float, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of tag 1 (time x docs), expected transition counts and the log partition sum of padded sequences."""
    steps, docs = x.shape
    live = mask.sum(1)
    psi = np.exp(np.clip(x + bias, -60, 60))
    m = np.exp(trans)
    alpha, norm, beta = np.zeros((steps, docs, 2)), np.ones((steps, docs)), np.ones((steps, docs, 2))
    for t in range(steps):
        v = alpha[t - 1, : live[t]] @ m if t else np.ones((live[t], 2))
        v[:, 1] *= psi[t, : live[t]]
        norm[t, : live[t]] = v.sum(1)
        alpha[t, : live[t]] = v / norm[t, : live[t], None]
    pair = np.zeros((2, 2))
    for t in range(steps - 2, -1, -1):
        k = live[t + 1]
        v = beta[t + 1, :k].copy()
        v[:, 1] *= psi[t + 1, :k]
        v /= norm[t + 1, :k, None]
        beta[t, :k] = v @ m.T
        pair += (alpha[t, :k].T @ v) * m
    both = alpha * beta
    return np.where(mask, both[..., 1] / np.maximum(both.sum(2), 1e-300), 0.0), pair, float(np.log(norm).sum())


def without_copies(rows: list[tuple[str | None, int]]) -> list[tuple[str, int]]:
    """The rows less near copies of earlier ones that stay and have the same label: a family of copies with one label would make all its
    words look like evidence. The similarity of two sets of 3-word shingles is estimated by a one-permutation minhash: of the BINS that
    either set fills, the share in which their least hashes are equal; from COPY on a row is a copy."""
    edges = np.array([k * (1 << 32) // BINS for k in range(BINS)], np.uint64)
    out, marks = [], {y: [np.zeros((len(rows), BINS), np.uint32), 0] for y in {bool(y) for _, y in rows}}
    for text, y in rows:
        words = (text or "").lower().split()
        h = np.fromiter((zlib.crc32(" ".join(words[k : k + 3]).encode()) for k in range(max(1, len(words) - 2))), np.uint64)
        h = np.sort((h + np.uint64(1)) * SPREAD >> np.uint64(32))
        at = np.searchsorted(h, edges)
        first = h[np.minimum(at, len(h) - 1)]
        mine = np.where((at < len(h)) & (first < np.append(edges[1:], np.uint64(1 << 32))), first + np.uint64(1), np.uint64(0)).astype(np.uint32)
        kept, n = marks[bool(y)]
        equal = ((kept[:n] == mine) & (mine > 0)).sum(1)
        if (equal < COPY * ((kept[:n] > 0) | (mine > 0)).sum(1)).all():
            out.append((text or "", y))
            kept[n] = mine
            marks[bool(y)][1] += 1
    return out


def fit(rows: list[tuple[str | None, int]], steps: int = 40, clean_docs: int = 1500, segment: int = 64) -> Crf:
    """Fit the field and the document score on (text, toxic) rows, in any number; with one class only the score is its smoothed rate.

    The chain is fitted on segments of that many tokens: of all toxic documents, and of clean_docs others."""
    rows = without_copies(rows)
    texts, labels = [t for t, _ in rows], np.array([1 if y else 0 for _, y in rows], int)
    toxic = int(labels.sum())
    rate = (toxic + 0.5) / (len(rows) + 1)
    if not 0 < toxic < len(rows):
        return Crf(doc=(math.log(rate / (1 - rate)) if not toxic else 0.0, 0.0, 0.0))
    bad, good = Counter(), Counter()
    for text, y in zip(texts, labels, strict=True):
        if y:
            bad.update({f for w in set(text.split()) for f in features_of(w)})
    bad = Counter({f: n for f, n in bad.items() if n > 1})  # one document is no evidence
    for text, y in zip(texts, labels, strict=True):
        if not y:
            good.update({f for w in set(text.split()) for f in features_of(w) if f in bad})
    told = {f: e for f, a in bad.items() if (e := evidence(a, good[f], rate)) >= KEEP}
    names = {f: k for k, f in enumerate(told)}
    clean = iter(range(clean_docs))
    sizes, marked, rows_, cols, feats = [], [], [], [], []
    memo: dict[str, tuple[list[int], bool]] = {}
    for text, y in zip(texts, labels, strict=True):
        if not y and next(clean, None) is None:
            continue
        words = text.split()
        first = len(sizes)
        sizes += [min(segment, len(words) - k) for k in range(0, len(words), segment)]
        if len(memo) > 100_000:
            memo.clear()
        for k, w in enumerate(words):
            if w not in memo:
                fs = [f for f in features_of(w) if f in told]
                memo[w] = [names[f] for f in fs], any(told[f] >= SPAN for f in fs)
            ids, strong = memo[w]
            if ids:
                if strong and y:
                    marked.append((k % segment, first + k // segment))
                rows_ += [k % segment] * len(ids)
                cols += [first + k // segment] * len(ids)
                feats += ids
    longest_first = np.argsort(-np.array(sizes, int), kind="stable")
    column = np.argsort(longest_first)
    mask = np.arange(segment)[:, None] < np.array(sizes, int)[longest_first][None]
    tags = np.zeros(mask.shape, bool)
    for t, d in marked:
        tags[t, column[d]] = True
    cols = column[np.array(cols, int)]
    rows_, cols, feats = (np.array(x, int) for x in (rows_, cols, feats))
    w, bias, trans = np.zeros(len(names)), -3.0, np.zeros((2, 2))
    at = [np.zeros(len(names)), 0.0, np.zeros((2, 2))]
    real = np.zeros((2, 2))
    for i in (0, 1):
        for j in (0, 1):
            real[i, j] = ((tags[:-1] == i) & (tags[1:] == j) & mask[1:]).sum()
    for _ in range(steps):
        x = np.zeros(mask.shape)
        np.add.at(x, (rows_, cols), w[feats])
        p, pair, _ = full_pass(x, mask, bias, trans)
        miss = tags - p
        grads = [np.bincount(feats, miss[rows_, cols], len(names)) - 0.05 * w, miss.sum() - 0.01 * bias, real - pair - 0.01 * trans]
        grads[2][0, 0] = 0.0
        new = []
        for k, (value, g) in enumerate(zip((w, bias, trans), grads, strict=True)):
            at[k] = at[k] + np.square(g)
            new.append(value + 0.7 * g / np.sqrt(at[k] + 1e-6))
        w, bias, trans = new
    crf = Crf({f: float(w[k]) for f, k in names.items() if abs(w[k]) > 0.05}, float(bias), trans)
    cache = Memo(crf)
    found = [events_of(t, cache) for t in texts]
    p = crf.marginals([f[0] for f in found], [f[1] for f in found], np.array([f[2] for f in found]))
    z = np.array([[1.0, math.log1p(float(q.sum())), float(q.max(initial=0.0))] for q in p])
    ridge = np.array([0.01, 0.05, 0.05])

    def loss(v: np.ndarray) -> float:
        return float(np.logaddexp(0, z @ v).sum() - labels @ (z @ v) + 0.5 * (ridge * v * v).sum())

    theta = np.array([math.log(rate / (1 - rate)), 0.0, 0.0])
    for _ in range(60):  # Newton steps, halved until the loss falls
        s = 1 / (1 + np.exp(-np.clip(z @ theta, -50, 50)))
        move = np.linalg.solve((z * (s * (1 - s))[:, None]).T @ z + np.diag(ridge), z.T @ (labels - s) - ridge * theta)
        while np.abs(move).max() > 1e-6 and loss(theta + move) > loss(theta):
            move = move / 2
        if np.abs(move).max() <= 1e-6:
            break
        theta = theta + move
    crf.doc = tuple(float(x) for x in theta)
    return crf


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 6000, max_text_bytes: int = 32768) -> Crf:
    """Fit on a bounded sample of labelled rows: the max_rows labels smallest by hash of the id whose crc32(id as text) mod 3 is not 1,
    and of their texts those of max_text_bytes at most (6000 x 32 KiB bounds what the driver gathers). Null labels do not count."""
    ids = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1))
    picked = ids.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y")).distinct().orderBy(F.xxhash64("k"), "k", "y").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("text")).where(F.octet_length("text") <= max_text_bytes)
    rows = texts.join(F.broadcast(picked), "k").orderBy(F.xxhash64("k"), "k", "text", "y").limit(max_rows).select("text", "y").collect()
    crf = fit([(r[0], r[1]) for r in rows])
    del rows
    release_driver_memory(docs.sparkSession)
    return crf


def score_documents(docs: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, whole: bool = False) -> DataFrame:
    """One row for each row of docs: id, held_out, score, predicted, spans (start:end code points of tokens with a marginal of 0.5 or more);
    with whole, also row, a struct of all its columns.

    No shuffle; whole texts. Null and empty texts have the score of a text without events. Null ids are not held out. Repeated
    rows get equal scores; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.struct(*(docs.columns if whole else [text_col])).alias("row"))
    passed = ["row"] if whole else []

    def run(batches):
        memo = Memo(crf)
        for batch in batches:
            texts = batch.column("row").field(text_col).to_pylist()
            found = [events_of(t, memo) for t in texts]
            p = crf.marginals([f[0] for f in found], [f[1] for f in found], np.array([f[2] for f in found]))
            spans = []
            for text, f, q in zip(texts, found, p, strict=True):
                bad = set(f[0][q >= 0.5].tolist())
                spans.append(",".join(f"{m.start()}:{m.end()}" for k, m in enumerate(TOKEN.finditer(text)) if k in bad) if bad else "")
            scores = [crf.score(q) for q in p]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(spans, pa.string()), *map(batch.column, passed)], names=["id", "score", "predicted", "spans", *passed])

    scored = map_batches(rows, run, "id long, score double, predicted int, spans string" + (f", row {rows.schema['row'].dataType.simpleString()}" if whole else ""))
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return scored.select(F.col("id").alias(id_col), held.alias("held_out"), "score", "predicted", "spans", *passed)
