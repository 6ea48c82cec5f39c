"""Main text of web pages by a linear-chain CRF over the leaf blocks of the DOM.

A block's features are its open elements, the words in their class, id and
role, and its own text: length, share of links, punctuation and telling words.
The chain learns how article and other blocks follow each other; the best
labelling comes from Viterbi.

It is trained on ``TRAINING`` labelled pages: layouts from ``pages.Maker``,
filled with sentences of at most ``ROWS`` pages of the table, the first in order
of md5(page_id). The bound holds for training only; each page is read whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table
from .crf import Chain
from .dom import Block, blocks
from .pages import PHRASES, Maker

ROWS, TRAINING, ROUNDS, SEED = 100, 2000, 80, 11
SIZE, SLOTS = 1 << 14, 48
WORD = re.compile(r"[^\W_]+")
LIMITS = (2, 4, 8, 16, 40, 100)
#: Words of the phrases of menus, notices and forms; other words tell nothing of a block's part.
TELLING = frozenset(w.lower() for some in PHRASES.values() for phrase in some for w in WORD.findall(phrase) if len(w) > 3) - frozenset("this your have more also about most next free site under with from".split())


def number(name: str) -> int:
    return zlib.crc32(name.encode()) % (SIZE - 1) + 1


def path_features(path: tuple) -> tuple[int, ...]:
    """Of the open elements; the innermost three once more by their place."""
    found = {f"a:{tag}" for tag, _ in path} | {f"m:{m}" for _, marks in path for m in marks}
    found |= {f"i{k}:{tag}" for k, (tag, _) in enumerate(reversed(path[-2:]))}
    block = next((tag for tag, _ in reversed(path) if tag not in ("a", "b", "i", "em", "strong", "span", "small", "u")), "")
    found -= {"a:html", "a:body", "a:div", "i1:body", "i1:html"}  # true of most blocks
    return tuple(sorted(map(number, found | {f"t:{block}"})))


def text_features(b: Block) -> list[int]:
    words = WORD.findall(b.text)
    n = len(words)
    size = sum(n > limit for limit in LIMITS)
    link = b.links / max(1, len(b.text))
    linked = 0 if link == 0 else 1 if link < 0.5 else 2
    stop = b.text[-1] in ".!?…\"”»"
    found = [f"n:{size}", f"l:{linked}", f"nl:{size}:{linked}", f"s:{stop}", f"ns:{size}:{stop}", f"c:{min(3, b.text.count(','))}"]
    if "©" in b.text or "copyright" in b.text.lower():
        found.append("copyright")
    if n <= 16:
        found += [f"w:{w}" for w in dict.fromkeys(w.lower() for w in words) if w in TELLING]
    return [number(f) for f in found]


class Model:
    def __init__(self, chain: Chain):
        self.chain = chain

    def features(self, found: list[Block], memory: dict) -> np.ndarray:
        out = np.zeros((len(found), SLOTS), np.int64)
        for i, b in enumerate(found):
            of_path = memory.get(b.path)
            if of_path is None:
                if len(memory) > 50_000:
                    memory.clear()
                of_path = memory[b.path] = path_features(b.path)
            own = text_features(b)[:SLOTS]
            whole = own + list(of_path[: SLOTS - len(own)])
            out[i, : len(whole)] = whole
        return out

    def extract(self, pages: list[str | None], memory: dict) -> list[str]:
        parsed = [blocks(p) for p in pages]
        every = [b for found in parsed for b in found]
        score = self.chain.scores(self.features(every, memory)) if every else np.zeros((0, 2))
        out, at = [], 0
        for found in parsed:
            labels = self.chain.viterbi(score[at : at + len(found)])
            at += len(found)
            out.append("\n\n".join(b.text for b, y in zip(found, labels) if y))
        return out


def fit(pages: list[str], training: int = TRAINING, rounds: int = ROUNDS, seed: int = SEED) -> Model:
    """``pages`` give the sentences of the training layouts."""
    sentences = []
    for page in pages:
        for b in blocks(page):
            if not b.links and any(tag == "p" for tag, _ in b.path) and not any(tag in ("footer", "header", "nav", "aside", "form") for tag, _ in b.path):
                sentences += [s.strip() for s in re.split(r"(?<=[.!?]) ", b.text) if len(s.strip()) > 2]
    maker = Maker(sorted(set(sentences)), seed)
    model = Model(Chain(SIZE, 2))
    rows, labels, memory = [], [], {}
    for _ in range(training):
        page, label = maker.page()
        found = blocks(page)
        if len(found) == len(label):
            rows.append(model.features(found, memory))
            labels.append(label)
    longest = max(map(len, labels))
    item, gold = np.full((len(rows), longest), -1), np.full((len(rows), longest), -1)
    at = 0
    for i, label in enumerate(labels):
        item[i, : len(label)] = np.arange(at, at + len(label))
        gold[i, : len(label)] = label
        at += len(label)
    model.chain.fit(np.concatenate(rows), item, gold, rounds, rate=0.1, decay=1e-4)
    return model


def sample(pages: DataFrame, rows: int = ROWS, id_col: str = "page_id", html_col: str = "html") -> list[str]:
    """At most ``rows`` pages, the first in order of md5(id); ids are picked before pages move."""
    key = F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    last = pages.select(key.alias("at")).distinct().orderBy("at").limit(rows).agg(F.max("at")).first()[0]
    found = pages.filter((key <= F.lit(last)) & F.col(f"`{html_col}`").isNotNull()).select(key.alias("at"), F.col(f"`{html_col}`").alias("html")).distinct().orderBy("at", "html").limit(rows)
    return [r["html"] for r in found.collect()]


def main_text(pages: DataFrame, model: Model, html_col: str = "html", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``pages`` with the main text (empty if none) and its number of code points, without the markup.

    Null and empty pages have an empty text. Columns named like a result
    column are replaced; repeated rows give repeated rows.
    """
    kept = [c for c in pages.columns if c not in (html_col, text_col, chars_col)]
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, memory = shared.value, {}
        for batch in slices(batches, html_col):
            text = made.extract(batch.column(html_col).to_pylist(), memory)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=[*kept, text_col, chars_col])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pages.select(*[F.col(f"`{c}`") for c in kept]).schema)
    return pages.select(*[f"`{c}`" for c in kept], f"`{html_col}`").mapInArrow(run, f"{schema}`{text_col}` string, `{chars_col}` bigint")


def op10(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text(pages, fit(sample(pages)))
