"""Language of a text from a linear-chain CRF over its words.

Words (runs of letters, lower-cased) are labelled with languages. Features of a
word are its affixes, its letter n-grams and its entries in the lexicons of the
languages; transitions between the labels of neighbouring words are learned, so
that a short foreign passage is labelled as such (``label_words``). A text's
language is the one with the largest sum of word probabilities from
forward-backward over the whole text, and its score is that sum's share.

Fitted on at most ``ROWS`` rows of each language, the first in order of
md5(doc_id), then of the text's hash: up to ``SPANS`` spans of up to ``SPAN`` words are drawn from each
such text with a seed and joined to code-switched sequences. The lexicons are
the words that occur most in the spans of one language. These bounds hold for
fitting only; every text is labelled whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernwork.plans.scale import top_per_group

from .common import slices, table
from .crf import Chain

ROWS, SPANS, SPAN, ROUNDS = 300, 12, 24, 60
SIZE = 1 << 16
LEXICON = 400
SLOTS = 14
WORD = re.compile(r"[^\W\d_]+")
#: Words whose scores a task remembers at a time.
REMEMBERED = 300_000


def features(word: str, lexicon: dict[str, int]) -> list[int]:
    w = f"<{word}>"
    parts = ["p" + w[:3], "p" + w[:4], "s" + w[-3:], "s" + w[-4:], "w" + w]
    # n-grams spread over the word, whatever its length
    grams = len(w) - 1
    parts += ["b" + w[i * grams // 5 : i * grams // 5 + 2] for i in range(min(5, grams))]
    if len(w) > 4:
        parts += ["t" + w[1:4], "t" + w[len(w) // 2 - 1 : len(w) // 2 + 2]]
    found = [zlib.crc32(p.encode()) % (SIZE - 64) + 64 for p in parts]
    if word in lexicon:
        found.append(1 + lexicon[word] % 60)
    return found + [0] * (SLOTS - len(found))


class Model:
    def __init__(self, labels: list[str], lexicon: dict[str, int], chain: Chain):
        self.labels, self.lexicon, self.chain = labels, lexicon, chain

    def probabilities(self, texts: list[list[str]], memory: dict[str, int], scores: list[np.ndarray]) -> np.ndarray:
        """Label probabilities of the words of texts laid end to end; scores of words are kept in ``memory``."""
        new = list({w for words in texts for w in words if w not in memory})
        if len(memory) + len(new) > REMEMBERED:
            memory.clear()
            scores.clear()
            new = list({w for words in texts for w in words})
        if new:
            base = sum(map(len, scores))
            memory.update(zip(new, range(base, base + len(new))))
            scores.append(self.chain.scores(np.array([features(w, self.lexicon) for w in new])))
            if len(scores) > 1:
                scores[:] = [np.concatenate(scores)]
        at = np.fromiter((memory[w] for words in texts for w in words), np.int64)
        return self.chain.marginals(scores[0][at] if len(at) else np.zeros((0, len(self.labels))), np.array([len(t) for t in texts], np.int64))

    def label_words(self, text: str) -> list[tuple[str, str, float]]:
        """Each word of a code-switched text with its most probable language and that probability."""
        words = WORD.findall(text.lower())
        if not words:
            return []
        p = self.probabilities([words], {}, [])
        return [(w, self.labels[j], float(p[i, j])) for i, (w, j) in enumerate(zip(words, p.argmax(axis=1)))]


def fit(rows: list[tuple[str, str]], rounds: int = ROUNDS, seed: int = 3) -> Model | None:
    """From (text, label) rows; None without any."""
    draw = np.random.default_rng(seed)
    spans: list[tuple[list[str], int]] = []
    labels = sorted({label for text, label in rows if WORD.search(text or "")})
    counts = [Counter() for _ in labels]
    for text, label in rows:
        words = WORD.findall((text or "").lower())
        if not words:
            continue
        k = labels.index(label)
        counts[k].update(words)
        for _ in range(min(SPANS, 1 + len(words) // SPAN)):
            start = int(draw.integers(0, max(1, len(words) - SPAN // 2)))
            spans.append((words[start : start + int(draw.integers(1, SPAN + 1))], k))
    if not labels:
        return None
    lexicon: dict[str, int] = {}
    for k, found in enumerate(counts):
        rest = sum((c for j, c in enumerate(counts) if j != k), Counter())
        scale = sum(found.values()) / max(1, sum(rest.values()))
        for w, c in found.most_common(LEXICON):
            if c > 4 * scale * rest[w]:
                lexicon[w] = k
    order = draw.permutation(len(spans))
    sequences, current = [], []
    for i in order:
        current.append(spans[i])
        if draw.random() < 0.4:
            sequences.append(current)
            current = []
    if current:
        sequences.append(current)
    distinct: dict[str, int] = {}
    longest = max(sum(len(w) for w, _ in s) for s in sequences)
    item = np.full((len(sequences), longest), -1)
    label = np.full((len(sequences), longest), -1)
    for r, s in enumerate(sequences):
        at = 0
        for words, k in s:
            item[r, at : at + len(words)] = [distinct.setdefault(w, len(distinct)) for w in words]
            label[r, at : at + len(words)] = k
            at += len(words)
    feats = np.array([features(w, lexicon) for w in distinct])
    return Model(labels, lexicon, Chain(SIZE, len(labels)).fit(feats, item, label, rounds))


def sample(docs: DataFrame, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> list[tuple[str, str]]:
    """At most ``rows`` different texts of each label, in order of md5(id), then of the text's hash.

    Narrow rows are picked first, so texts of the picked rows alone move; null
    and repeated ids come under the same bound. Rows alike count once.
    """
    key, mark = F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), F.xxhash64(F.col(f"`{text_col}`"))
    known = docs.filter(F.col(f"`{label_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull())
    known = known.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{label_col}`").cast("string").alias("label"), key.alias("at"), mark.alias("mark"))
    picked = top_per_group(known.select("label", "at", "mark").distinct(), ["label"], [F.asc("at"), F.asc("mark")], rows)
    out = known.join(F.broadcast(picked), ["label", "at", "mark"], "left_semi").distinct().collect()  # rows x labels
    return [(r["text"], r["label"]) for r in sorted(out, key=lambda r: (r["at"], r["label"], r["text"]))]


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` without the text and with the language (``und`` without a letter or model) and its score; other columns pass."""
    kept = [c for c in docs.columns if c not in (text_col, lang_col, score_col)]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, memory, scores = shared.value, {}, []
        for batch in slices(batches, text_col, 4 << 20):
            texts = [WORD.findall(t.lower()) if t and any(map(str.isalpha, t)) else [] for t in batch.column(text_col).to_pylist()]
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            full = [i for i, t in enumerate(texts) if t] if made else []
            if full:
                p = made.probabilities([texts[i] for i in full], memory, scores)
                lengths = np.array([len(texts[i]) for i in full])
                sums = np.add.reduceat(p, np.concatenate(([0], np.cumsum(lengths)[:-1])), axis=0) / lengths[:, None]
                for i, row in zip(full, sums):
                    lang[i], score[i] = made.labels[int(row.argmax())], float(min(1.0, row.max()))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*kept, lang_col, score_col])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*[F.col(f"`{c}`") for c in kept]).schema)
    return docs.select(*[f"`{c}`" for c in kept], f"`{text_col}`").mapInArrow(run, f"{schema}`{lang_col}` string, `{score_col}` double")


def op6(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    model = fit(sample(docs.filter(~held_out)))
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
