"""Toxicity by multiple-instance learning.

Labels say which documents are toxic, not where. A document is a bag of
sentences; a sentence is toxic with probability sigmoid(w . words + b), and a
document is toxic unless none of its sentences is (noisy-or), with a leak for
what no sentence explains:

    P(document) = 1 - (1 - leak) * product over sentences of (1 - p(sentence))

Weights, bias and leak are trained together from document labels by proximal
gradient descent on the likelihood of the bags; the same weights then say which
sentences are the offending ones.

Training uses a bounded sample of labelled documents (``max_train``, the least
hashes of doc_id): their sparse sentences meet in one task and only the model
comes to the driver. Scoring is one narrow pass over whole texts, and reads
nothing but the text.

A sentence is a run of text between ``.!?`` and line breaks that has a word; a
word is a run of letters, digits and wider characters, A-Z lower-cased.

Defined results: a null or empty text has no sentence and scores the leak;
documents without a label, labels without a document and null labels are not
trained on; of several labels the highest counts; repeated rows are scored
alike; a null doc_id is never held out; without any usable label every score is
0.5; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainlens.llm import common as C

BITS, MAX_TRAIN = 18, 16_000
STEM = 5  # bytes of a word that make a feature of their own

# letters, digits and bytes of wider characters 1, ends of sentences 2, the rest 0
KIND = np.zeros(256, np.uint8)
KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
KIND[[0x21, 0x2E, 0x3F, 0x0A, 0x0D]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Sentences:
    """The sentences of some texts: whose they are, their bytes (first word's
    start, last word's end) and their features as CSR, a word's own and its
    stem's for every word."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    feature: np.ndarray


def _stems(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The first ``STEM`` bytes of every word, and each word's among them."""
    d = pc.binary_slice(words, 0, STEM).dictionary_encode()
    return d.dictionary, d.indices.to_numpy(zero_copy_only=False)


def sentences(buf: np.ndarray, off: np.ndarray, bits: int = BITS) -> Sentences:
    low = LOWER[buf]
    kind = KIND[low]
    word = kind == 1
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1:-1]
    end = word.copy()
    end[:-1] &= ~word[1:] | edge[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    if not len(s):
        z = np.zeros(0, np.int64)
        return Sentences(z, z, z, np.zeros(1, np.int64), z)
    breaks = np.union1d(np.flatnonzero(kind == 2), off[:-1])
    key = np.searchsorted(breaks, s, side="right")
    new = np.append(True, key[1:] != key[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(s)) - 1
    code, words = C.codes(low, s, e)
    size = np.uint64(1 << bits)
    stems, stem_of = _stems(words)
    whole, stem = C.hashes(words, 13) % size, (C.hashes(stems, 14) % size)[stem_of]
    feature = np.stack([whole.astype(np.int64)[code], stem.astype(np.int64)[code]], 1).ravel()
    return Sentences(np.searchsorted(off, s[head], side="right") - 1, s[head], e[tail], 2 * np.append(head, len(s)), feature)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, x)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    leak: float  # the logit of a document's own chance

    def logits(self, s: Sentences) -> np.ndarray:
        size = np.diff(s.first)
        return np.bincount(np.repeat(np.arange(len(size)), size), weights=self.weights[s.feature], minlength=len(size)) + self.bias

    def score(self, z: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        """Noisy-or of the sentences' logits per text."""
        clean = np.bincount(text, weights=_softplus(z), minlength=n) + _softplus(np.float64(self.leak))
        return -np.expm1(-clean)


def loss_and_slopes(z: np.ndarray, bias: float, leak: float, bag: np.ndarray, plain: np.ndarray,
                    label: np.ndarray) -> tuple[float, np.ndarray, float, float]:
    """Mean negative log likelihood of the bags, its slope by every sentence's
    logit, by the bias of the ``plain`` sentences that each bag has besides,
    and by the leak."""
    n = len(label)
    a = np.bincount(bag, weights=_softplus(z), minlength=n) + plain * _softplus(np.float64(bias)) + _softplus(np.float64(leak))
    a = np.maximum(a, 1e-12)  # -log P(clean)
    loss = np.where(label, -np.log(-np.expm1(-a)), a).mean()
    by_a = np.where(label, -1 / np.expm1(np.minimum(a, 500)), 1.0) / n
    return (float(loss), by_a[bag] * _sigmoid(z), float((by_a * plain).sum() * _sigmoid(np.float64(bias))),
            float(by_a.sum() * _sigmoid(np.float64(leak))))


def fit(bag: np.ndarray, first: np.ndarray, feature: np.ndarray, label: np.ndarray, *, size: int = 1 << BITS,
        penalty: float = 4e-5, rounds: int = 400, least: int = 2) -> Model:
    """``bag`` is every sentence's document, ``first`` and ``feature`` the
    sentences' features as CSR, ``label`` every document's. Features of under
    ``least`` documents and those whose slope at the start is under half
    of the absolute penalty or twice its noise stay zero. Steps shrink per feature by its running
    squared slopes and overall with the rounds, and are halved where the loss
    rises; the best round is the model."""
    label = label.astype(bool)
    n, rate = len(label), min(max(label.mean(), 1e-3), 1 - 1e-3)
    sent = np.repeat(np.arange(len(bag)), np.diff(first))
    mean = max(1.0, len(bag) / n)
    bias = float(np.log(np.expm1(rate / mean)))
    leak = float(np.log(np.expm1(0.1 * rate)))
    pair = np.unique(bag[sent] * size + feature)
    docs_of = np.bincount(pair % size, minlength=size)
    _, slope, _, _ = loss_and_slopes(np.full(len(bag), bias), bias, leak, bag, np.zeros(n), label)
    at_start = np.abs(np.bincount(feature, weights=slope[sent], minlength=size))
    noise = np.sqrt(np.bincount(feature, weights=slope[sent] ** 2, minlength=size))
    keep = ((docs_of >= least) & (at_start > penalty / 2) & (at_start > 2 * noise))[feature]
    # sentences without a feature in use all have the bias as their logit
    active, sent = np.unique(sent[keep], return_inverse=True)
    plain = np.bincount(bag, minlength=n) - np.bincount(bag[active], minlength=n)
    bag = bag[active]
    used, col = np.unique(feature[keep], return_inverse=True)
    x = np.concatenate([np.zeros(len(used)), [bias, leak]])
    square, momentum = np.zeros(len(x)), np.zeros(len(x))
    rate_of_step, before = 0.3, np.inf
    best, best_loss = x, np.inf
    for t in range(1, rounds + 1):
        z = np.bincount(sent, weights=x[col], minlength=len(bag)) + x[-2]
        loss, slope, by_bias, by_leak = loss_and_slopes(z, x[-2], x[-1], bag, plain, label)
        whole = loss + penalty * np.abs(x[:-2]).sum()
        if whole < best_loss:
            best, best_loss = x, whole
        if whole > before * 1.02:
            rate_of_step /= 2
        before = whole
        g = np.concatenate([np.bincount(col, weights=slope[sent], minlength=len(used)), [slope.sum() + by_bias, by_leak]])
        momentum = 0.9 * momentum + 0.1 * g
        square = 0.99 * square + 0.01 * g * g
        step = rate_of_step / (1 + 4 * t / rounds) / (np.sqrt(square / (1 - 0.99**t)) + 1e-5)
        x = x - step * momentum / (1 - 0.9**t)
        x[:-2] = np.sign(x[:-2]) * np.maximum(np.abs(x[:-2]) - step[:-2] * penalty, 0)
    weights = np.zeros(size)
    weights[used] = best[:-2]
    return Model(weights, float(best[-2]), float(best[-1]))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        col = lambda c: b.column(b.schema.get_field_index(c))  # noqa: B023, E731
        buf, off = C.buffer_of(col("text"))
        for lo, hi in C.pieces(off):
            s = sentences(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
            per = np.searchsorted(s.text, np.arange(hi - lo + 1))
            size = pa.ListArray.from_arrays(pa.array(per.astype(np.int32)), pa.array(np.diff(s.first).astype(np.int32)))
            feature = pa.ListArray.from_arrays(pa.array(s.first[per].astype(np.int32)), pa.array(s.feature.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([col("place").slice(lo, hi - lo), col("toxic").slice(lo, hi - lo), size, feature],
                                             ["place", "toxic", "sizes", "features"])


def _train(t: pa.Table) -> pa.Table:
    def flat(name: str) -> tuple[np.ndarray, np.ndarray]:
        lists = pa.concat_arrays(t.column(name).chunks)
        return lists.value_lengths().to_numpy(), lists.flatten().to_numpy().astype(np.int64)

    many, size = flat("sizes")
    _, feature = flat("features")
    m = fit(np.repeat(np.arange(len(many)), many), np.append(0, np.cumsum(size)), feature, t.column("toxic").to_numpy() > 0)
    return pa.table({"weights": pa.array([m.weights.astype("<f4").tobytes()], pa.binary()), "bias": [m.bias], "leak": [m.leak]})


def train(docs: DataFrame, labels: DataFrame, *, max_train: int = MAX_TRAIN) -> Model | None:
    """A model from at most ``max_train`` labelled documents."""
    C.prepare(docs.sparkSession)
    marked = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id")
              .agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic")))
    # more ids than needed, as some may have no document here
    chosen = marked.withColumn("place", F.xxhash64(F.lit(13), "doc_id")).orderBy("place", "doc_id").limit(2 * max_train)
    sample = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("place", "toxic", "text")
              .mapInArrow(_bags, "place long, toxic int, sizes array<int>, features array<int>")
              .orderBy("place").limit(max_train).withColumn("model", F.lit(0)))
    got = sample.groupBy("model").applyInArrow(_train, "weights binary, bias double, leak double").collect()
    if not got:
        return None
    return Model(np.frombuffer(got[0]["weights"], "<f4").astype(np.float64), got[0]["bias"], got[0]["leak"])


def _score(model: Model | None, at: float, with_sentences: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc = b.column(b.schema.get_field_index("doc_id"))
            buf, off = C.buffer_of(b.column(b.schema.get_field_index("text")))
            for lo, hi in C.pieces(off):
                part, o = buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
                s = sentences(part, o)
                z = model.logits(s) if model else np.zeros(len(s.text))
                score = model.score(z, s.text, hi - lo) if model else np.full(hi - lo, 0.5)
                p = _sigmoid(z)
                bad = p >= at if model else np.zeros(len(p), bool)
                if not with_sentences:
                    cols = [doc.slice(lo, hi - lo), pa.array(score), pa.array(np.bincount(s.text, minlength=hi - lo)),
                            pa.array(np.bincount(s.text[bad], minlength=hi - lo))]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "score", "n_sentences", "n_offending"])
                    continue
                lead = np.append(0, np.cumsum((part & 0xC0) != 0x80))
                x, y, own = s.start[bad], s.end[bad], s.text[bad]
                words = pa.array([part[i:j].tobytes() for i, j in zip(x.tolist(), y.tolist(), strict=True)], pa.binary()).cast(pa.string())
                cols = [doc.slice(lo, hi - lo).take(pa.array(own)), pa.array(lead[x] - lead[o[own]]), pa.array(lead[y] - lead[x]),
                        pa.array(p[bad]), pa.array(score[own]), words]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "probability", "score", "sentence"])
    return run


def score(docs: DataFrame, model: Model | None, *, sentence_at: float = 0.5) -> DataFrame:
    """doc_id, score, n_sentences and n_offending (sentences whose probability
    reaches ``sentence_at``) of every row."""
    C.prepare(docs.sparkSession)
    base = docs.select("doc_id", "text")
    return base.mapInArrow(_score(model, sentence_at, False),
                           f"doc_id {base.schema['doc_id'].dataType.simpleString()}, score double, n_sentences long, n_offending long")


def offending(docs: DataFrame, model: Model | None, *, sentence_at: float = 0.5) -> DataFrame:
    """doc_id, start and length in code points, probability, the document's
    score and the text of every offending sentence."""
    C.prepare(docs.sparkSession)
    base = docs.select("doc_id", "text")
    return base.mapInArrow(_score(model, sentence_at, True), f"doc_id {base.schema['doc_id'].dataType.simpleString()}, "
                           "start long, length long, probability double, score double, sentence string")


def held_out(doc_id: Column | str, folds: int = 3, fold: int = 1) -> Column:
    """Whether a document's labels are kept from training."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % folds == fold, F.lit(False))


def judge(docs: DataFrame, labels: DataFrame, *, max_train: int = MAX_TRAIN, predict_at: float = 0.7) -> DataFrame:
    """Score and prediction of every row by a model that has not seen the
    labels of held-out documents."""
    model = train(docs, labels.where(~held_out("doc_id")), max_train=max_train)
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score",
                                     F.when(F.col("score") >= predict_at, 1).otherwise(0).alias("predicted"), "n_sentences", "n_offending")
