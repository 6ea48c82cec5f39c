"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

A text's features are its distinct words (runs of letters, lower-cased) and
their beginnings of four to seven letters, hashed. One weight vector w is
shared by all grades: P(grade <= j) = 1 / (1 + exp(w.x - theta_j)) with ordered
thresholds theta_0 < theta_1 < ... The expected severity is the sum over j of
P(grade > j); a text is rejected if P(grade > 0) passes ``REJECT``.

``labels`` tells toxic rows from others but not how toxic they are. Rows not
toxic have grade 0; toxic rows have grade 2 if they hold more distinct marker
words than the middle toxic row of the sample, else grade 1. Markers are words
whose share of toxic rows, smoothed, is at least ``ODDS`` times that of the rest.

Fitted on at most ``ROWS`` toxic and ``2 * ROWS`` other labelled rows, the
first in order of md5(doc_id). The weights are fitted by proximal gradient steps
with an L1 penalty, which leaves few of them. The bound holds for fitting only:
every text is graded whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernwork.plans.scale import top_per_group

from .common import slices, table

ROWS, ROUNDS, SIZE = 2000, 200, 1 << 20
PENALTY, SCREEN, ODDS, REJECT = 2e-4, 2.5, 8.0, 0.35
WORD = re.compile(r"[^\W\d_]+")
REMEMBERED = 400_000


def word_features(word: str) -> list[int]:
    parts = ["w" + word] + ["p" + word[:n] for n in range(4, 8) if n < len(word)]
    return [zlib.crc32(p.encode()) % SIZE for p in parts]


class Model:
    """Non-zero weights by feature, and the thresholds."""

    def __init__(self, weights: dict[int, float], theta: np.ndarray):
        self.weights, self.theta = weights, theta

    def above(self, words: set[str], memory: dict[str, tuple[int, ...]]) -> np.ndarray:
        """P(grade > j) for each j. ``memory`` keeps the weighted features of words."""
        known = self.weights
        found: set[int] = set()
        for w in words:
            got = memory.get(w)
            if got is None:
                if len(memory) >= REMEMBERED:
                    memory.clear()
                got = memory[w] = tuple(f for f in word_features(w) if f in known)
            found.update(got)
        s = sum(known[f] for f in sorted(found))
        return 1.0 / (1.0 + np.exp(np.clip(self.theta - s, -50, 50)))


def grades(texts: list[np.ndarray], toxic: np.ndarray, size: int) -> np.ndarray:
    """0, 1 or 2 for each text, given as its distinct words' numbers below ``size``."""
    count = lambda some: np.bincount(np.concatenate([np.zeros(0, np.int32), *(t for t, y in zip(texts, some) if y)]), minlength=size)
    bad, good = count(toxic), count(~toxic)
    markers = (bad >= 3) & ((bad + 0.5) / max(1, toxic.sum()) >= ODDS * (good + 0.5) / max(1, (~toxic).sum()))
    held = np.array([markers[t].sum() if y else -1 for t, y in zip(texts, toxic)])
    middle = np.median(held[held >= 0]) if (held >= 0).any() else 0
    return np.where(held < 0, 0, np.where(held > middle, 2, 1))


def fit(rows: list[tuple[str, bool]], rounds: int = ROUNDS, penalty: float = PENALTY) -> Model | None:
    """From (text, toxic) rows; None unless both kinds are there."""
    toxic = np.array([bool(b) for _, b in rows], bool)
    if not toxic.any() or toxic.all():
        return None
    words: dict[str, int] = {}
    texts = []  # as numbers of distinct words: the driver holds few strings
    for text, _ in rows:
        texts.append(np.array(sorted({words.setdefault(w, len(words)) for w in WORD.findall((text or "").lower())}), np.int32))
    grade = grades(texts, toxic, len(words))
    levels = int(grade.max())
    of_word = np.full((max(1, len(words)), 5), -1, np.int32)
    for i, w in enumerate(words):
        f = word_features(w)
        of_word[i, : len(f)] = f
    del words
    found = [np.unique(of_word[t]) for t in texts]
    found = [f[f >= 0] for f in found]
    index = np.concatenate(found)
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(f) for f in found])
    del found
    often, seen = np.bincount(index, minlength=SIZE), np.bincount(index[toxic[row]], minlength=SIZE)
    # screening: a feature of one or two rows, or as common in toxic rows as elsewhere, tells nothing of other texts
    share = often / len(rows)
    error = np.sqrt(share * (1 - share + 1e-9) * (1 / toxic.sum() + 1 / (~toxic).sum()))
    spread = (seen / toxic.sum() - (often - seen) / (~toxic).sum()) / np.maximum(error, 1e-12)
    ids = np.flatnonzero((often >= 3) & (np.abs(spread) >= SCREEN))
    place = np.full(SIZE, -1, np.int32)
    place[ids] = np.arange(len(ids))
    keep = place[index] >= 0
    col, row = place[index[keep]], row[keep]
    del index
    w, theta = np.zeros(len(ids)), np.linspace(1.0, 2.0, levels)
    gw, gt = np.full(len(ids), 1e-6), np.full(levels, 1e-6)
    n = len(rows)
    for r in range(rounds):
        s = np.bincount(row, w[col], n)
        # P(grade <= j) at the bounds of each row's grade
        cut = np.concatenate(([-50.0], theta, [50.0]))
        hi = 1.0 / (1.0 + np.exp(-np.clip(cut[grade + 1] - s, -50, 50)))
        lo = 1.0 / (1.0 + np.exp(-np.clip(cut[grade] - s, -50, 50)))
        p = np.maximum(hi - lo, 1e-9)
        d_hi, d_lo = hi * (1 - hi), lo * (1 - lo)
        slip = (d_hi - d_lo) / p / n  # of -log p by s
        g = np.bincount(col, slip[row], len(ids))
        gth = np.zeros(levels)
        for j in range(levels):
            gth[j] = np.sum((d_lo / p)[grade == j + 1]) / n - np.sum((d_hi / p)[grade == j]) / n
        gw += 0.05 * (g * g - gw)
        gt += 0.05 * (gth * gth - gt)
        speed = 0.15 / (1 + r / 40)
        rate = speed / np.sqrt(gw)
        w = w - rate * g
        w = np.sign(w) * np.maximum(0.0, np.abs(w) - rate * penalty)
        gap = 0.1 * np.arange(levels)  # ordered thresholds keep a distance
        theta = np.maximum.accumulate(theta - speed / np.sqrt(gt) * gth - gap) + gap
    return Model({int(i): float(x) for i, x in zip(ids, w) if x}, theta)


def sample(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> list[tuple[str, bool]]:
    """At most ``rows`` toxic and twice as many other labelled texts.

    Ids are picked first; only the picked texts move. Where ids repeat with
    different texts, these come under the same bound, in order of md5(id), then of the text's hash.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    # three groups of at most ``rows``, so that a task sends no more than that of each before the shuffle
    key = F.md5(F.col("doc_id").cast("string"))
    group = F.when(F.col("toxic"), "toxic").otherwise(F.substring(key, 32, 1).rlike("[0-7]").cast("string"))
    picked = top_per_group(known.withColumns({"at": key, "group": group}), ["group"], [F.asc("at")], rows)
    picked = picked.select(F.col("doc_id").alias("picked"), "toxic", "group", "at")  # 3 * rows ids at most
    found = docs.join(F.broadcast(picked), F.col("doc_id") == F.col("picked")).filter("text IS NOT NULL").select("doc_id", "text", "toxic", "group", "at").distinct()
    found = top_per_group(found, ["group"], [F.asc("at"), F.asc(F.xxhash64("text")), F.asc("text")], rows)
    return [(r["text"], r["toxic"]) for r in sorted(found.collect(), key=lambda r: (r["doc_id"], r["text"]))]


def grade(docs: DataFrame, model: Model | None, text_col: str = "text", reject: float = REJECT, keep_text: bool = False) -> DataFrame:
    """``docs`` with severity (expected grade), p_toxic and rejected, without the text unless ``keep_text``.

    Null, empty and wordless texts, and all texts without a model, have
    severity 0 and stay. Columns named like a result column are replaced.
    """
    made_cols = ("severity", "p_toxic", "rejected")
    kept = [c for c in docs.columns if c.lower() not in made_cols and (keep_text or c != text_col)]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, memory = shared.value, {}
        for batch in slices(batches, text_col):
            severity, p_toxic = [], []
            for text in batch.column(text_col).to_pylist():
                words = set(WORD.findall(text.lower())) if text and made else None
                over = made.above(words, memory) if words else np.zeros(1)
                severity.append(float(over.sum()))
                p_toxic.append(float(over[0]))
            out = [pa.array(severity, pa.float64()), pa.array(p_toxic, pa.float64()), pa.array([p > reject for p in p_toxic], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + out, names=[*kept, *made_cols])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*[F.col(f"`{c}`") for c in kept]).schema)
    cols = list(dict.fromkeys([*kept, text_col]))
    return docs.select(*[f"`{c}`" for c in cols]).mapInArrow(run, f"{schema}severity double, p_toxic double, rejected boolean")


def op8(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return grade(docs, fit(sample(docs, table(spark, sf_dir, "labels"))))
