"""Quality classifier: ordinal cumulative-link regression on hashed text.

Ratings are grades 0 (toxic), 1 (poor) and 2 (good). One weight vector over
hashed tokens is shared by all grades; ordered thresholds cut its score:
P(grade <= k) = sigmoid(threshold_k - score). That gives an expected grade and
tail probabilities, and a text is kept if P(grade >= 2) reaches ``keep_at``.

Training uses a bounded sample of labelled documents (``max_train``, the least
hashes of doc_id, so it is spread over the corpus and the same on every run):
their sparse features meet in one task and only the model (``2**bits``
numbers) comes to the driver. The fit is proximal gradient descent with
momentum, steps scaled per feature, and an absolute penalty, which leaves most
weights zero. Scoring is one narrow pass.

Defined results: a null or empty text has only its length features; documents
without a label, labels without a document and labels with a null in quality
and toxic are not trained on; a document with several labels counts with its
lowest grade; repeated rows are scored alike; without any usable label every
text is kept with null scores; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trainlens.llm import common as C

BITS, GRADES, MAX_TRAIN = 18, 3, 16_000

# white space 0; letters, digits and all bytes of wider characters 1; the rest 2
KIND = np.full(256, 2, np.uint8)
KIND[C.SPACE] = 0
KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def sparse(buf: np.ndarray, off: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, each once: the hashed runs of letters and of
    other characters in a text, and steps of its length, of the share of
    different runs and of the share of runs that aren't words."""
    n, size = len(off) - 1, 1 << bits
    buf = LOWER[buf]
    kind = KIND[buf]
    new = np.ones(len(buf), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[off[:-1][off[:-1] < len(buf)]] = True
    s = np.flatnonzero(new)
    what = kind[s]
    if len(s):
        arr = pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(np.append(s, len(buf)).astype(np.int32)),
                                                          pa.py_buffer(np.ascontiguousarray(buf))])
        d = arr.dictionary_encode()
        feature = (C.hashes(d.dictionary, 7) % np.uint64(size)).astype(np.int64)[d.indices.to_numpy(zero_copy_only=False)]
    else:
        feature = np.zeros(0, np.int64)
    text = np.searchsorted(off, s, side="right") - 1
    text, feature, what = text[what > 0], feature[what > 0], what[what > 0]
    pair = np.unique(text * size + feature)
    runs = np.bincount(text, minlength=n)
    marks = np.bincount(text[what == 2], minlength=n)
    kinds = np.bincount(pair // size, minlength=n)
    safe = np.maximum(runs, 1)
    shape = {"length": np.log2(safe).astype(np.int64), "different": 10 * kinds // safe, "marks": 10 * marks // safe}
    for name, step in shape.items():
        codes = np.array([xxhash.xxh3_64_intdigest(f"\x00{name} {i}", 7) % size for i in range(int(step.max(initial=0)) + 1)], np.int64)
        pair = np.concatenate([pair, np.arange(n) * size + codes[step]]) if n else pair
    pair = np.unique(pair)
    return pair // size, pair % size


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, text: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(text, weights=self.weights[feature], minlength=n)

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .., one column each."""
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(text: np.ndarray, feature: np.ndarray, grade: np.ndarray, *, size: int = 1 << BITS, grades: int = GRADES,
        penalty: float = 5e-5, rounds: int = 600, gap: float = 0.1) -> Model:
    """``text`` and ``feature`` list the features of the texts, ``grade`` has
    a grade for each text. Thresholds stay ``gap`` apart, which bounds their
    gradient where a grade is rare; momentum is dropped and steps are halved
    whenever the loss rises, so the fit cannot run away. Features whose
    gradient at the start is under half the penalty are left out: with an
    absolute penalty they would stay zero but for rare cases."""
    n = len(grade)
    share = np.clip(np.cumsum(np.bincount(grade, minlength=grades)[:-1]) / n, 1e-3, 1 - 1e-3)
    edge = np.concatenate([[0.0], share, [1.0]])
    first = np.bincount(feature, weights=(1 - edge[grade] - edge[grade + 1])[text], minlength=size) / n
    keep = np.abs(first)[feature] > penalty / 2
    text, feature = text[keep], feature[keep]
    used, col = np.unique(feature, return_inverse=True)
    per_text = np.bincount(text, minlength=n) + grades - 1
    # bound of each feature's curvature (that of a score is 1/2 at most), from
    # the features it occurs with; thresholds count as features of every text
    curve = 0.5 * np.bincount(col, weights=per_text[text].astype(float), minlength=len(used)) / n
    step, step_t = 1 / np.maximum(curve, 1e-6), 2 / per_text.mean()
    apart = gap * np.arange(grades - 1)
    order = lambda t: np.maximum.accumulate(t - apart) + apart
    theta = order(np.log(share / (1 - share)))
    w = np.zeros(len(used))
    momentum, scale, before = 1.0, 1.0, np.inf
    tw, tt = w, theta
    for _ in range(rounds):
        s = np.bincount(text, weights=tw[col], minlength=n)
        cut = np.concatenate([[-np.inf], tt, [np.inf]])
        a, b = _sigmoid(cut[grade] - s), _sigmoid(cut[grade + 1] - s)  # P(below), P(up to) the grade
        p = np.maximum(b - a, 1e-12)
        loss = -np.log(p).mean() + penalty * np.abs(tw).sum()
        if loss > before + 1e-6 and momentum > 1:
            momentum, scale, before = 1.0, scale / 2, np.inf
            tw, tt = w, theta
            continue
        before = loss
        g = 1 - a - b  # d loss / d score
        gw = np.bincount(col, weights=g[text], minlength=len(used)) / n
        gt = np.array([(a * (1 - a) / p)[grade == k + 1].sum() - (b * (1 - b) / p)[grade == k].sum() for k in range(grades - 1)]) / n
        nw = tw - scale * step * gw
        nw = np.sign(nw) * np.maximum(np.abs(nw) - scale * step * penalty, 0)
        nt = order(tt - scale * step_t * gt)
        m = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        tw, tt = nw + (momentum - 1) / m * (nw - w), order(nt + (momentum - 1) / m * (nt - theta))
        w, theta, momentum = nw, nt, m
    weights = np.zeros(size, np.float64)
    weights[used] = w
    return Model(weights, theta)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        buf, off = C.buffer_of(b.column(b.schema.get_field_index("text")))
        for lo, hi in C.pieces(off):
            t, f = sparse(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
            o = np.searchsorted(t, np.arange(hi - lo + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index("place")).slice(lo, hi - lo), b.column(b.schema.get_field_index("grade")).slice(lo, hi - lo),
                 pa.ListArray.from_arrays(pa.array(o), pa.array(f.astype(np.int32)))], ["place", "grade", "features"])


def _train(t: pa.Table) -> pa.Table:
    lists = t.column("features").combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    size = lists.value_lengths().to_numpy()
    grade = t.column("grade").to_numpy().astype(np.int64)
    m = fit(np.repeat(np.arange(len(size)), size), lists.flatten().to_numpy().astype(np.int64), grade)
    return pa.table({"weights": pa.array([m.weights.astype("<f4").tobytes()], pa.binary()),
                     "thresholds": pa.array([m.thresholds.astype("<f8").tobytes()], pa.binary())})


def train(docs: DataFrame, labels: DataFrame, *, max_train: int = MAX_TRAIN) -> Model | None:
    """A model from at most ``max_train`` labelled documents."""
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).when(F.col("quality").isNotNull(), 1)
    rated = (labels.select("doc_id", grade.alias("grade")).where("doc_id IS NOT NULL AND grade IS NOT NULL")
             .groupBy("doc_id").agg(F.min("grade").alias("grade")))
    # more ids than needed, as some may have no document here
    chosen = rated.withColumn("place", F.xxhash64(F.lit(8), "doc_id")).orderBy("place", "doc_id").limit(2 * max_train)
    sample = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("place", "grade", "text")
              .mapInArrow(_features, "place long, grade int, features array<int>")
              .orderBy("place").limit(max_train).withColumn("model", F.lit(0)))
    got = sample.groupBy("model").applyInArrow(_train, "weights binary, thresholds binary").collect()
    if not got:
        return None
    return Model(np.frombuffer(got[0]["weights"], "<f4").astype(np.float64), np.frombuffer(got[0]["thresholds"], "<f8"))


def _score(model: Model, keep_at: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = C.buffer_of(b.column(b.schema.get_field_index("text")))
            doc = b.column(b.schema.get_field_index("doc_id"))
            rest = [k for k, name in enumerate(b.schema.names) if name not in ("doc_id", "text")]
            for lo, hi in C.pieces(off):
                t, f = sparse(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                tails = model.tails(model.score(t, f, hi - lo))
                yield pa.RecordBatch.from_arrays(
                    [doc.slice(lo, hi - lo), *[b.column(k).slice(lo, hi - lo) for k in rest], pa.array(tails.sum(1)), pa.array(tails[:, 0]), pa.array(tails[:, -1]),
                     pa.array(tails[:, -1] >= keep_at)],
                    ["doc_id", *[b.schema.field(k).name for k in rest], "expected_grade", "p_not_toxic", "p_good", "kept"])
    return run


def classify(docs: DataFrame, labels: DataFrame, *, max_train: int = MAX_TRAIN, keep_at: float = 0.6,
             row_keys: bool = False) -> DataFrame:
    """doc_id, expected_grade, p_not_toxic, p_good and kept of every row, with
    ``row_keys`` also rid, its key of doc_id and text."""
    C.prepare(docs.sparkSession)
    model = train(docs, labels, max_train=max_train)
    key = [C.row_key("doc_id", "text").alias("rid")] if row_keys else []
    base = docs.select("doc_id", *key, "text")
    kind = base.schema["doc_id"].dataType.simpleString()
    if model is None:
        null = F.lit(None).cast("double")
        return base.drop("text").select("*", null.alias("expected_grade"), null.alias("p_not_toxic"), null.alias("p_good"), F.lit(True).alias("kept"))
    return base.mapInArrow(_score(model, keep_at), f"doc_id {kind}, {'rid long, ' if row_keys else ''}expected_grade double, p_not_toxic double, p_good double, kept boolean")
