"""Near-duplicate groups by SimHash with pigeonring filtering.

A text's words are joined to shingles; each shingle is hashed (XXH64) and a
fingerprint bit is 1 if it is set in over half of the hashes. Fingerprints of
``bits`` bits link at ``radius`` or fewer differing bits, and groups are the
components of those links.

Pigeonring: the bits are cut into ``segments`` in a ring. If two fingerprints
differ in at most ``radius`` bits, then from some segment on every chain of l
segments differs in at most floor(l * radius / segments) bits. Candidates meet
in buckets, pass the chain test, then the full Hamming check.

Two indexes bring candidates together:

* ``ring_keys`` (64 bits, radius 3, four segments): the first segment of a
  chain must agree and the second may differ in one bit, so in one of its four
  nibbles. A bucket is (segment, nibble left out, the 28 bits that must agree):
  16 keys a fingerprint, and no link is missed.
* ``band_keys`` (wide fingerprints and radii): ``tables`` keys of some bits
  drawn from the fingerprint. They gather candidates for ``one_of_each_group``,
  which links documents only by the exact similarity of their shingle sets; at
  a similarity of 0.8 a bit differs with probability 0.15, and 99 % of such
  pairs are candidates. Recall and precision are measured in the tests.

Equal fingerprints are one row from the start. A bucket leaves its task as a
forest of links, never as all pairs; a bucket of over ``BUCKET`` rows is dealt
out again as pairs of parts. Null text has no words; without words the
fingerprint is zero, linked like any other. A row without id has a fingerprint
and joins the group of its fingerprint, if a row with an id has the same one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_texts, fresh, saved, slices, table
from .components import components

#: Rows of a bucket that one task compares; larger buckets are split into parts of this size.
BUCKET = 2048
#: Buckets of up to this size are searched for any link side by side.
SMALL = 64
LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def shingle_hashes(text: bytes | None, k: int, seed: int) -> np.ndarray:
    words = text.translate(LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    n = len(words)
    if n <= k:
        return np.array([digest(line, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.fromiter((digest(line[a:b], seed) for a, b in zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist())), np.uint64, n - k + 1)


def widen(h: np.ndarray, lanes: int) -> np.ndarray:
    """The hash itself and further mixes of it, one column a lane of 64 bits."""
    out = np.empty((len(h), lanes), np.uint64)
    out[:, 0] = h
    for lane in range(1, lanes):
        z = h + np.uint64(0x9E3779B97F4A7C15 * lane & (1 << 64) - 1)
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        out[:, lane] = z ^ z >> np.uint64(31)
    return out


def majority(h: np.ndarray) -> np.ndarray:
    """Bits set in over half of the rows of (n, lanes) hashes, as one row of lanes."""
    n, lanes = h.shape
    counts = np.zeros(64 * lanes, np.int64)
    # 255 rows at most add up within a byte, eight counters to a machine word
    for at in range(0, n, 255):
        bits = np.unpackbits(np.ascontiguousarray(h[at : at + 255]).view(np.uint8), axis=1, bitorder="little")
        counts += bits.view(np.uint64).sum(axis=0, dtype=np.uint64).view(np.uint8)
    return np.packbits(2 * counts > n, bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, bits: int, seed: int = 42) -> DataFrame:
    """(id, fp): the fingerprint as bits / 8 little-endian bytes."""
    lanes = bits // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = [majority(widen(shingle_hashes(t, shingle, seed), lanes)).tobytes() for t in binary_texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], names=["id", "fp"])

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "id bigint, fp binary")


def ring_keys(fp: np.ndarray) -> np.ndarray:
    """16 bucket keys for each 64-bit fingerprint."""
    f = fp[:, 0]
    seg = [f >> np.uint64(16 * i) & np.uint64(0xFFFF) for i in range(4)]
    keys = []
    for i in range(4):
        for nibble in range(4):
            rest = seg[(i + 1) % 4] & np.uint64(0xFFFF ^ 0xF << 4 * nibble)
            keys.append(np.uint64(4 * i + nibble) << np.uint64(32) | seg[i] << np.uint64(16) | rest)
    return np.stack(keys, 1)


def band_keys(tables: int, width: int = 18, seed: int = 5) -> Callable[[np.ndarray], np.ndarray]:
    def keys(fp: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8), axis=1, bitorder="little")
        draw = np.random.default_rng(seed)
        out = np.empty((len(fp), tables), np.uint64)
        for t in range(tables):
            at = draw.choice(bits.shape[1], width, replace=False)
            out[:, t] = bits[:, at].astype(np.uint64) @ (np.uint64(1) << np.arange(width, dtype=np.uint64)) | np.uint64(t << width)
        return out

    return keys


def near(x: np.ndarray, radius: int, segments: int) -> np.ndarray:
    """Which rows of differences (n, lanes) pass the chain test and then the full check."""
    counts = np.bitwise_count(x.view(np.uint16)) if segments == 4 * x.shape[1] else np.bitwise_count(x)
    ok = np.zeros(len(x), bool)
    for start in range(segments):
        total = np.zeros(len(x), np.int64)
        good = np.ones(len(x), bool)
        for length in range(1, min(3, segments) + 1):
            total = total + counts[:, (start + length - 1) % segments]
            good &= total <= length * radius // segments
        ok |= good
    passed = np.flatnonzero(ok)
    ok[passed] = counts[passed].sum(axis=1, dtype=np.int64) <= radius
    return ok


def forest(fp: np.ndarray, radius: int, segments: int, label: np.ndarray) -> list[tuple[int, int]]:
    """Links that join all members of a bucket that links connect: each new member is compared with those not yet joined to it, nor of its label."""
    label = label.copy()
    out = []
    for i in range(len(fp)):
        others = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        if not len(others):
            continue
        hit = others[near(fp[others] ^ fp[i], radius, segments)]
        if len(hit):
            _, first = np.unique(label[hit], return_index=True)
            out += [(i, int(j)) for j in hit[first]]
            label[np.isin(label, label[hit])] = label[i]
    return out


def linker(lanes: int, radius: int, segments: int, limit: int | None) -> Callable:
    """Task over rows sorted by key: (a, b, key null) are links of different ids, (a = id, b null, key) the rows of a bucket over the limit.

    Rows of one id are joined from the start, so the id may be the label of a group.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("fp", pa.binary())])

    def out(a, b, key, fp):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(key, pa.int64()), pa.array(fp, pa.binary())], schema=schema)

    def links(key: np.ndarray, ids: np.ndarray, raw: list[bytes]) -> pa.RecordBatch:
        fp = np.frombuffer(b"".join(raw), np.uint64).reshape(len(raw), lanes)
        edge = np.flatnonzero(key[1:] != key[:-1]) + 1
        starts = np.concatenate(([0], edge))
        sizes = np.diff(np.concatenate((starts, [len(key)])))
        a, b = [], []
        two = starts[sizes == 2]  # most buckets that have anyone to compare
        two = two[ids[two] != ids[two + 1]]
        hit = two[near(fp[two] ^ fp[two + 1], radius, segments)]
        a += ids[hit].tolist()
        b += ids[hit + 1].tolist()
        # of the larger ones, only those that hold a link at all are looked at member by member
        number = np.repeat(np.arange(len(starts)), sizes)
        rest = sizes[number] > 2
        held = np.zeros(len(starts), bool)
        for d in range(1, min(SMALL, int(sizes.max(initial=0)))):
            first = np.flatnonzero(rest[:-d] & (number[d:] == number[:-d]) & (sizes[number[:-d]] <= SMALL) & (ids[d:] != ids[:-d]))
            held[number[first[near(fp[first] ^ fp[first + d], radius, segments)]]] = True
        full = np.flatnonzero((sizes > SMALL) | held)
        for s, n in zip(starts[full].tolist(), sizes[full].tolist()):
            for i, j in forest(fp[s : s + n], radius, segments, ids[s : s + n]):
                a.append(int(ids[s + i]))
                b.append(int(ids[s + j]))
        return out(a, b, [None] * len(a), [None] * len(a))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_key, hold_id, hold_fp = [], [], []  # whole buckets wait until a batch's worth is there
        over = None
        for batch in batches:
            for piece in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                key, ids, fp = piece.column("key").to_pylist(), piece.column("id").to_pylist(), piece.column("fp").to_pylist()
                if over is not None:  # the bucket that was too large goes on
                    n = next((i for i, k in enumerate(key) if k != over), len(key))
                    if n:
                        yield out(ids[:n], [None] * n, key[:n], fp[:n])
                    key, ids, fp = key[n:], ids[n:], fp[n:]
                    if not key:
                        continue
                    over = None
                hold_key += key
                hold_id += ids
                hold_fp += fp
                last = len(hold_key) - 1
                while last > 0 and hold_key[last - 1] == hold_key[-1]:
                    last -= 1
                if last:
                    yield links(np.array(hold_key[:last]), np.array(hold_id[:last]), hold_fp[:last])
                    hold_key, hold_id, hold_fp = hold_key[last:], hold_id[last:], hold_fp[last:]
                if limit and len(hold_key) > limit:
                    over = hold_key[0]
                    yield out(hold_id, [None] * len(hold_id), hold_key, hold_fp)
                    hold_key, hold_id, hold_fp = [], [], []
        if hold_key:
            yield links(np.array(hold_key), np.array(hold_id), hold_fp)

    return run


LINK_SCHEMA = "a bigint, b bigint, key bigint, fp binary"


def link(reps: DataFrame, keys: Callable, lanes: int, radius: int, segments: int) -> DataFrame:
    """Links (a, b) between the ids of distinct fingerprints (id, fp)."""
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("fp", pa.binary())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = batch.column("fp")
            made = keys(np.frombuffer(b"".join(raw.to_pylist()), np.uint64).reshape(batch.num_rows, lanes)).view(np.int64)
            for t in range(made.shape[1]):
                yield pa.RecordBatch.from_arrays([pa.array(made[:, t]), batch.column("id"), raw], schema=schema)

    rows = reps.select("id", "fp").mapInArrow(spread, "key bigint, id bigint, fp binary")
    by_key = lambda x: x.repartition("key").sortWithinPartitions("key")
    first = saved(by_key(rows).mapInArrow(linker(lanes, radius, segments, BUCKET), LINK_SCHEMA))
    edges = first.filter("b IS NOT NULL").select("a", "b")
    # the rows of large buckets, each in every pair of parts that its part belongs to
    large = first.filter("b IS NULL").select("key", F.col("a").alias("id"), "fp")
    sizes = large.groupBy("key").agg(F.ceil(F.count("*") / BUCKET).cast("int").alias("parts"), (F.min("id") < F.max("id")).alias("mixed")).filter("mixed").drop("mixed")
    part = F.pmod(F.xxhash64("fp"), F.col("parts"))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts").cast("bigint") - 1))
    paired = large.join(sizes, "key").withColumn("part", part).withColumn("other", other)
    block = F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other"))
    more = by_key(paired.select(block.alias("key"), "id", "fp")).mapInArrow(linker(lanes, radius, segments, None), LINK_SCHEMA)
    return edges.unionByName(more.select("a", "b"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 64, radius: int = 3, segments: int = 4, keys: Callable = ring_keys) -> DataFrame:
    """One row for each row of ``docs``: id, fp, component_id (least id of its group)."""
    prints = saved(fingerprints(docs, id_col, text_col, shingle, bits))
    reps = saved(prints.groupBy("fp").agg(F.min("id").alias("id")))
    found = components(link(reps.filter("id IS NOT NULL"), keys, bits // 64, radius, segments))
    of = saved(reps.join(found, F.col("id") == F.col("node"), "left").select("fp", F.coalesce("component", "id").alias("component_id")))
    return prints.join(of, "fp").select("id", "fp", "component_id")


#: Five-word shingles: bits of sets at a similarity of 0.8 differ in 15 % of 256 places on average, 39; 60 and 96 keys leave out under 1 % of such pairs.
WIDE = {"shingle": 5, "bits": 256, "radius": 60, "segments": 16, "keys": band_keys(96, 16)}
#: Ends of the rounds in which the keys come.
ROUNDS = (8, 32, 96)
#: Hashes of a block that one task holds, 16 MB; and the copies of a node from which on blocks are dealt by bucket keys.
HASHES, COPIES = 2 << 20, 96
#: Jaccard similarity of the shingle sets from which documents are near copies.
LEAST = 0.8


def shingle_sets(rows: DataFrame, shingle: int, bits: int, seed: int = 42) -> DataFrame:
    """(id, mark, node, size, fp) of (id, mark, text): a number for the set of shingles, its size, and the SimHash of the set (not of the repetitions)."""
    lanes = bits // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [np.unique(shingle_hashes(t, shingle, seed)) for t in binary_texts(batch, "text")]
            node = np.array([xxhash.xxh3_64_intdigest(x.tobytes(), seed) for x in sets], np.uint64).view(np.int64)
            fp = [majority(widen(x, lanes)).tobytes() for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark"), pa.array(node), pa.array(list(map(len, sets)), pa.int64()), pa.array(fp, pa.binary())], names=["id", "mark", "node", "size", "fp"])

    return rows.mapInArrow(run, "id bigint, mark struct<hash:bigint,length:int>, node bigint, size bigint, fp binary")


def hash_sets(texts: DataFrame, shingle: int, seed: int = 42) -> DataFrame:
    """(node, hashes) of (node, text): the sorted hashes of the shingles, eight bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            made = [np.unique(shingle_hashes(t, shingle, seed)).tobytes() for t in binary_texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(made, pa.binary())], names=["node", "hashes"])

    return texts.mapInArrow(run, "node bigint, hashes binary")


def shared(one: np.ndarray, other: np.ndarray, least: float) -> bool:
    """Whether two sorted sets of hashes have a Jaccard similarity of ``least`` or more."""
    both = len(np.intersect1d(one, other, assume_unique=True))
    return both >= least * (len(one) + len(other) - both)


def alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets (node, hashes) have a similarity of ``least`` or more."""
    left = pairs.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    both = left.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "y"):
            sides = (batch.column(c).to_pylist() for c in ("x", "y"))
            right = [shared(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), least) for x, y in zip(*sides)]
            yield batch.select(["a", "b"]).filter(pa.array(right, pa.bool_()))

    return both.mapInArrow(run, "a bigint, b bigint")


def verified(node: np.ndarray, label: np.ndarray, fp: np.ndarray, sets: list[np.ndarray], radius: int, segments: int, least: float) -> list[tuple[int, int]]:
    """Links that join all members of a block that pairs of a similarity of ``least`` connect; none between members of one label.

    Each member is held against the later ones of other labels: sizes, chain
    test and bits within the radius, then the sets themselves.
    """
    size = np.array(list(map(len, sets)), np.int64)
    ends = np.cumsum(size)
    _, at = np.unique(np.concatenate(sets), return_inverse=True)  # hashes as small numbers
    marked = np.zeros(int(at.max(initial=-1)) + 1, np.int64)
    out = []
    for i in range(len(node) - 1):
        j = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        j = j[np.minimum(size[j], size[i]) >= least * np.maximum(size[j], size[i])]
        j = j[near(fp[j] ^ fp[i], radius, segments)]
        if not len(j):
            continue
        mine = at[ends[i] - size[i] : ends[i]]
        marked[mine] = 1
        theirs = np.concatenate([at[ends[k] - size[k] : ends[k]] for k in j])
        both = np.add.reduceat(marked[theirs], np.concatenate(([0], np.cumsum(size[j])[:-1])))
        marked[mine] = 0
        hit = j[both >= least * (size[i] + size[j] - both)]
        if len(hit):
            _, first = np.unique(label[hit], return_index=True)
            out += [(int(node[i]), int(node[k])) for k in hit[first]]
            label[np.isin(label, label[hit])] = label[i]
    return out


def block_links(members: DataFrame, sets: DataFrame, radius: int, segments: int, least: float) -> DataFrame:
    """A forest of links (a, b) of similar sets out of each block. ``members`` has block, node, label, size and fp.

    A block is one task's work up to ``BUCKET`` nodes and ``HASHES`` hashes; a
    larger one is dealt out as pairs of parts. No pair leaves its task
    unchecked, and a block gives fewer links than it has nodes.
    """
    stats = members.groupBy("block").agg(
        F.greatest(F.lit(1), F.ceil(F.greatest(F.count("*") / BUCKET, F.sum("size") / HASHES))).cast("bigint").alias("parts"), (F.min("label") < F.max("label")).alias("mixed")
    )
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    dealt = members.join(stats.filter("mixed"), "block").withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    dealt = dealt.select(F.xxhash64("block", F.least("part", "other"), F.greatest("part", "other")).alias("block"), "node", "label", "fp").join(sets, "node")
    names = ["block", "node", "label", "fp", "hashes"]

    def links(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        raw = rows.column("fp").to_pylist()
        fp = np.frombuffer(b"".join(raw), np.uint64).reshape(len(raw), -1)
        found = [np.frombuffer(x, np.uint64) for x in rows.column("hashes").to_pylist()]
        out = verified(rows.column("node").to_numpy(), rows.column("label").to_numpy().copy(), fp, found, radius, segments, least)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("block").to_numpy()
            edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for start, end in zip(edges[:-1], edges[1:]):
                if held and keys[start] != block:
                    yield links(held)
                    held = []
                block = keys[start]
                held.append(batch.slice(start, end - start))
        if held:
            yield links(held)

    return dealt.select(*names).repartition("block").sortWithinPartitions("block").mapInArrow(run, "a bigint, b bigint")


def keyed(members: DataFrame, keys: Callable) -> DataFrame:
    """``members`` once for each of their bucket keys, the block being that of block and key."""
    names = ["block", "node", "label", "size", "fp"]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = batch.column("fp").to_pylist()
                made = keys(np.frombuffer(b"".join(raw), np.uint64).reshape(len(raw), -1)).view(np.int64)
                for t in range(made.shape[1]):
                    yield pa.RecordBatch.from_arrays([pa.array(made[:, t]), *(batch.column(c) for c in names)], names=["key", *names])

    rows = members.select(*names).mapInArrow(spread, "key bigint, block bigint, node bigint, label bigint, size bigint, fp binary")
    return rows.select(F.xxhash64("block", "key").alias("block"), *names[1:])


def loose_groups(nodes: DataFrame, keys: Callable, lanes: int, radius: int, segments: int) -> DataFrame:
    """(node, block): components of candidates among (node, fp). The keys come in rounds, and what is joined already gives no more links."""
    labels = nodes.select("node", "fp", F.col("node").alias("id"))
    for start, stop in zip((0, *ROUNDS[:-1]), ROUNDS):
        found = components(link(labels, lambda fp, a=start, b=stop: keys(fp)[:, a:b], lanes, radius, segments))
        joined = labels.join(found.withColumnRenamed("node", "id"), "id", "left")
        labels = saved(joined.select("node", "fp", F.coalesce("component", "id").alias("id")))
    return labels.select("node", F.col("id").alias("block"))


def near_copy_groups(docs: DataFrame, id_col: str, text_col: str, shingle: int, bits: int, radius: int, segments: int, keys: Callable, least: float) -> DataFrame:
    """(id, mark, group) for each row of ``docs``; groups are the components of pairs of shingle sets with a similarity of ``least`` or more.

    SimHash only gathers candidates, every link is checked on the sets. A loose
    component of candidates is a block, in which all pairs meet. One of over
    ``BUCKET`` nodes is first held against one member of it; if that leaves
    several pieces, it is dealt out as pairs of parts, or by bucket keys where
    there would be more parts than keys. A set of shingles is a node under its
    64-bit hash.
    """
    doc, text = F.col(f"`{id_col}`").cast("bigint"), F.col(f"`{text_col}`")
    rows = docs.select(doc.alias("id"), mark_of(text).alias("mark"), text.alias("text"))
    prints = saved(shingle_sets(rows, shingle, bits))
    nodes = saved(prints.groupBy("node").agg(F.min(F.struct("id", "mark")).alias("of"), F.first("size").alias("size"), F.first("fp").alias("fp")))
    loose = loose_groups(nodes, keys, bits // 64, radius, segments)
    several = loose.groupBy("block").agg(F.count("*").alias("n")).filter("n > 1").select("block")
    some = saved(nodes.join(loose.join(saved(several), "block"), "node"))
    texts = rows.join(some.select("node", "of.id", "of.mark"), ["id", "mark"]).groupBy("node").agg(F.first("text").alias("text"))
    sets = saved(hash_sets(texts, shingle))
    large = saved(some.groupBy("block").agg(F.count("*").alias("n"), F.min_by("node", "of").alias("a")).filter(F.col("n") > BUCKET))
    sure = saved(alike(some.join(large, "block").filter("a <> node").select("a", F.col("node").alias("b")), sets, least))
    found = components(sure)
    members = some.join(found, "node", "left").join(large.select("block", "n"), "block", "left")
    members = saved(members.select("block", "node", F.coalesce("component", "node").alias("label"), "size", "fp", (F.coalesce("n", F.lit(0)) > BUCKET * COPIES).alias("huge")))
    blocks = members.filter("NOT huge").drop("huge").unionByName(keyed(members.filter("huge"), keys))
    found = saved(components(sure.unionByName(block_links(blocks, sets, radius, segments, least))))
    return prints.join(found, "node", "left").select("id", "mark", F.coalesce("component", "node").alias("group"))


def mark_of(text):
    """What tells the texts of rows with one id apart."""
    return F.struct(F.xxhash64(text).alias("hash"), F.coalesce(F.length(text), F.lit(-1)).alias("length"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, **options) -> DataFrame:
    """One row of each group of near copies: that of the least id, then of the least hash of the text. Rows without id stay.

    It is decided for each row, not for each id: rows that share an id and have
    other texts belong to the groups of their texts. Other columns pass unchanged.
    """
    of = near_copy_groups(docs.filter(F.col(f"`{id_col}`").isNotNull()), id_col, text_col, least=least, **(WIDE | options))
    name, key, alone, same = fresh(docs, "_gone"), fresh(docs, "_mark"), fresh(docs, "_alone"), fresh(docs, "_same")
    of = saved(of.distinct())
    firsts = saved(of.groupBy("group").agg(F.min(F.struct("id", "mark")).alias("first")))  # a table of its own, so that a large group splits in the join
    gone = of.join(firsts, "group").filter(F.struct("id", "mark") != F.col("first"))
    gone = gone.select(F.col("id").alias(name), F.col("mark").alias(key))
    marked = docs.withColumn(same, mark_of(F.col(f"`{text_col}`")))
    kept = marked.join(gone.hint("merge"), (F.col(f"`{id_col}`").cast("bigint") == F.col(name)) & (F.col(same) == F.col(key)), "left_anti")
    # a row given twice is one document; rows without id are told apart by their place
    kept = kept.withColumn(alone, F.when(F.col(f"`{id_col}`").isNull(), F.monotonically_increasing_id()))
    return kept.dropDuplicates([id_col, alone, same]).drop(alone, same)


def op4(spark, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digits = F.lower(F.concat(*[F.hex(F.substring("fp", i, 1)) for i in range(8, 0, -1)]))
    return found.select(F.col("id").alias("doc_id"), digits.alias("fingerprint"), "component_id")


def brute_force(docs: list[tuple], shingle: int = 3, radius: int = 3) -> dict:
    """Plain check for tests: bit by bit fingerprints, every pair compared."""
    prints = {}
    for d, t in docs:
        words = (t or "").encode().translate(LOWER).split()
        parts = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
        hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        prints[d] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    of = {d: d for d in prints}
    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius and of[a] != of[b]:
                low, high = sorted((of[a], of[b]))
                of = {k: low if v == high else v for k, v in of.items()}
    return {d: (f"{prints[d]:016x}", of[d]) for d in prints}
