"""Risk-controlled quality rules.

Every text gets plain counts in one narrow pass. Rules compare a ratio of
those counts with a cutoff. Cutoffs are not set by hand: they go through
``LEVELS`` joint settings, from one where every rule is lax to one where every
rule is strict, so a text has one number, the first level that rejects it. Per
stratum, the labelled texts of good quality tell how often a level would reject
one wrongly by any rule, and a level is admitted only if the exact
(Clopper-Pearson) upper bound of that rate stays under the allowed risk.

* Levels are tested from the laxest to the strictest and testing stops at the
  first that fails, which spends no further error.
* The confidence is split evenly over the strata with enough good labels to
  admit any level at all (Bonferroni; how many there are follows from the
  numbers of labels alone, not from what the rules do to them).
* Equal texts of a stratum are one trial, good if all their labels are; texts
  that the base rule rejects are none.

Among the admitted levels the one that catches most labelled bad texts is
taken, the laxest on a tie. A stratum with too few labels (217 good texts with
four strata, 2 % risk and 95 % confidence) rejects nothing by these rules.

Defined results: a null text has no words and all counts 0 (so the base rule
fails it, as it fails any text under ``min_words``); texts of a null lang are a
stratum of their own; an unlabelled stratum has no cutoffs; repeated rows are judged alike; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainlens.llm import common as C

SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
CLOSERS = np.isin(np.arange(256), np.frombuffer(b"!?", np.uint8))
WINDOW, LEVELS = 5, 60
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_distinct"]
_SCHEMA = ", ".join(f"{c} long" for c in COUNTS)

# metric -> (SQL over the counts of a text with words, cutoffs from lax to
# strict); a text is rejected when the metric is over the cutoff
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols_per_word": ("try_divide(n_symbols, n_words)", [x / 20 for x in range(60, 0, -1)]),
    "marks_per_word": ("try_divide(n_marks, n_words)", [x / 20 for x in range(60, 0, -1)]),
    "dup_line_share": ("try_divide(n_dup_lines, n_lines)", [x / 40 for x in range(39, 0, -1)]),
    "repeated_word_share": ("try_divide(n_repeat_words, n_words)", [x / 100 for x in range(20, 0, -1)]),
    "mean_word_chars": ("try_divide(word_chars, n_words)", [float(x) for x in range(60, 7, -1)]),
}


def _per_text(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=c[1:])
    return c[off[1:]] - c[off[:-1]]


def _grouped(key_text: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items (text, key): how often each pair occurs, and the pair's text."""
    pair = np.stack([key_text.astype(np.uint64), key], 1)
    order = np.lexsort((pair[:, 1], pair[:, 0]))
    p = pair[order]
    first = np.ones(len(p), bool)
    first[1:] = (p[1:] != p[:-1]).any(1)
    group = np.cumsum(first) - 1
    n = np.bincount(group) if len(p) else np.zeros(0, np.int64)
    times = np.empty(len(p), np.int64)
    times[order] = n[group]
    return times, key_text[order][first]


def text_counts(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of every text of a buffer; ``n_lines`` has lines with a word,
    ``n_marks`` characters of ``!?``, ``n_distinct`` distinct words."""
    n = len(off) - 1
    s, e, wo = C.spans(buf, off)
    nw = np.diff(wo)
    lead = ((buf & 0xC0) != 0x80) & ~C.SPACE[buf]
    out = {"n_words": nw, "word_chars": _per_text(lead, off), "n_symbols": _per_text(SYMBOLS[buf], off),
           "n_marks": _per_text(CLOSERS[buf], off)}
    code, words = C.codes(buf, s, e)
    text_of = np.repeat(np.arange(n), nw)
    out["n_distinct"] = np.bincount(_grouped(text_of, code.astype(np.uint64))[1], minlength=n).astype(np.int64)
    # windows: those that lie in one text and occur there more than once
    out["n_repeat_words"] = np.zeros(n, np.int64)
    if len(s) >= WINDOW:
        g = C.grams(C.hashes(words)[code], WINDOW)
        at = np.arange(len(g))
        own = text_of[at] == text_of[at + WINDOW - 1]
        at, g = at[own], g[own]
        times, _ = _grouped(text_of[at], g)
        cover = np.zeros(len(s) + 1, np.int64)
        hit = at[times > 1]
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + WINDOW, -1)
        out["n_repeat_words"] = _per_text(np.cumsum(cover)[:-1] > 0, wo)
    # lines: between text edges and newlines, if a word starts in them
    nl = np.flatnonzero(buf == 10)
    ls = np.unique(np.concatenate([off[:-1][np.diff(off) > 0], nl + 1]))
    ls = ls[ls < len(buf)]
    le = np.append(ls[1:], len(buf))
    worded = np.searchsorted(s, le) > np.searchsorted(s, ls)
    ends_nl = np.zeros(len(ls), bool)
    ends_nl[le > ls] = buf[le[le > ls] - 1] == 10
    ls, le = ls[worded], (le - ends_nl)[worded]
    lcode, _ = C.codes(buf, ls, le)
    ltext = np.searchsorted(off, ls, side="right") - 1
    _, distinct = _grouped(ltext, lcode.astype(np.uint64))
    out["n_lines"] = np.bincount(ltext, minlength=n).astype(np.int64)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(distinct, minlength=n)
    return out


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        i = b.schema.get_field_index("text")
        buf, off = C.buffer_of(b.column(i))
        for lo, hi in C.pieces(off):
            o = off[lo:hi + 1]
            t = text_counts(buf[o[0]:o[-1]], o - o[0])
            rest = b.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays(
                [rest.column(k) for k in range(rest.num_columns) if k != i] + [pa.array(t[c], pa.int64()) for c in COUNTS],
                [f.name for k, f in enumerate(rest.schema) if k != i] + COUNTS)


def features(docs: DataFrame) -> DataFrame:
    """doc_id, stratum (the language), key of doc_id, text and language, key of
    the text, and the counts of every text."""
    C.prepare(docs.sparkSession)
    cols = docs.select("doc_id", F.col("lang").cast("string").alias("stratum"), C.row_key("doc_id", "text", "lang").alias("rid"),
                       C.row_key("text").alias("tid"), "text")
    schema = f"doc_id {cols.schema['doc_id'].dataType.simpleString()}, stratum string, rid long, tid long, {_SCHEMA}"
    return cols.mapInArrow(_count_batches, schema)


def upper_bound(k: int, n: int, delta: float) -> float:
    """Exact one-sided binomial bound: the largest rate at which seeing ``k``
    or fewer in ``n`` still has probability ``delta``."""
    if n <= 0 or k >= n:
        return 1.0

    def below(p: float) -> float:
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
                for i in range(k, -1, -1)]
        top = max(logs)
        return math.exp(top) * sum(math.exp(x - top) for x in logs) if top > -700 else 0.0

    lo, hi = k / n, 1.0 - 1e-12
    for _ in range(60):
        mid = (lo + hi) / 2
        if below(max(mid, 1e-300)) > delta:
            lo = mid
        else:
            hi = mid
    return hi


def cutoff_at(rule: str, level: int) -> float:
    """A rule's cutoff at a joint level."""
    grid = RULES[rule][1]
    return grid[level * (len(grid) - 1) // (LEVELS - 1)]


def first_level() -> Column:
    """The first joint level that rejects a text; ``LEVELS`` if none does."""
    out = []
    for rule, (expr, _) in RULES.items():
        cuts = [cutoff_at(rule, i) for i in range(LEVELS)]  # they only get stricter
        out.append(F.expr(f"{LEVELS} - size(filter(array({', '.join(f'{x}D' for x in cuts)}), x -> {expr} > x))"))
    return F.least(*out)


def powered(sizes: list[int], risk: float, delta: float) -> int:
    """How many strata share the confidence: the most for which each, with its
    share, could admit a level that rejects no good text."""
    ordered = sorted(sizes, reverse=True)
    return max([m for m in range(1, len(ordered) + 1) if (1 - risk) ** ordered[m - 1] <= delta / m], default=0)


def admitted_level(good: np.ndarray, bad: np.ndarray, risk: float, delta: float) -> int | None:
    """From how many good and bad texts each level is the first to reject (the
    last entry: none does), the admitted level that catches most bad texts."""
    n, best, most = int(good.sum()), None, 0
    k = caught = 0
    for level in range(len(good) - 1):
        k, caught = k + int(good[level]), caught + int(bad[level])
        if upper_bound(k, n, delta) > risk:
            break
        if caught > most:
            best, most = level, caught
    return best


def choose_levels(feats: DataFrame, labels: DataFrame, *, max_false_rejection: float = 0.02,
                  delta: float = 0.05) -> dict[str | None, int]:
    """Admitted joint level per stratum, from every labelled text; null is a
    stratum like any other. Only histogram cells come to the driver: at most
    strata x 2 x levels of them."""
    lab = (labels.select("doc_id", "quality").where("doc_id IS NOT NULL AND quality IS NOT NULL")
           .groupBy("doc_id").agg(F.min("quality").alias("quality")))
    held = feats.where("n_words > 0").join(lab, "doc_id").withColumn("level", first_level())
    trials = held.groupBy("stratum", "tid").agg(F.min("quality").alias("quality"), F.min("level").alias("level"))
    seen: dict[str | None, np.ndarray] = {}
    for r in trials.groupBy("stratum", (F.col("quality") > 0).alias("good"), "level").count().collect():
        seen.setdefault(r["stratum"], np.zeros((2, LEVELS + 1), np.int64))[int(r["good"]), r["level"]] += r["count"]
    share = powered([int(h[1].sum()) for h in seen.values()], max_false_rejection, delta)
    out = {}
    for stratum, (bad, good) in seen.items():
        level = admitted_level(good, bad, max_false_rejection, delta / share) if share else None
        if level is not None:
            out[stratum] = level
    return out


def judge(docs: DataFrame, labels: DataFrame, *, min_words: int = 10, max_repeat_pct: int = 20,
          max_false_rejection: float = 0.02, delta: float = 0.05) -> DataFrame:
    """Counts, base verdict and final verdict of every text; ``rid`` is the row's
    key of doc_id, text and language. ``level`` is the stratum's admitted joint
    level, null where there is none."""
    C.prepare(docs.sparkSession)
    # read twice (holdout counts, verdicts): small rows, so the text is read once
    feats = features(docs).checkpoint()
    base = F.expr(f"n_words < {min_words} OR 100 * n_repeat_words > {max_repeat_pct} * n_words")
    # the risk is that of the rules, so texts that the base rule rejects are no trials
    levels = choose_levels(feats.where(~base), labels, max_false_rejection=max_false_rejection, delta=delta)
    # one row per stratum that has over two hundred labelled texts
    table = docs.sparkSession.createDataFrame([(s, s is None, i) for s, i in levels.items()], "at string, no_lang boolean, level int")
    over = F.coalesce(first_level() <= F.col("level"), F.lit(False))
    keyed = feats.withColumn("_s", F.coalesce(F.concat(F.lit("s"), "stratum"), F.lit("")))
    keys = table.select(F.when(F.col("no_lang"), "").otherwise(F.concat(F.lit("s"), "at")).alias("_s"), "level")
    return (keyed.join(keys, "_s", "left").drop("_s").withColumn("base_failed", base)
            .withColumn("kept", ~F.col("base_failed") & ~over))
