"""SimHash near duplicates found in a hierarchical index over Gray order.

Fingerprints: each of the 64 bits is the majority of that bit over the XXH64 hashes of
all three-word shingles. Links: at most ``most_bits`` differing bits. Two fingerprints
that close agree on one of ``most_bits + 1`` blocks of bits, so each is sent to its
blocks' segments and only segments are searched. Within a segment the fingerprints are
sorted by Gray rank (neighbours differ in few bits), and every eight of them form a node
that holds the bits on which all below agree; nodes of nodes hold what these share.
A search goes down from the top, adds up differing bits of what each level fixes anew,
and leaves a whole group as soon as the sum is too large. A group that already belongs
to the searcher's component is left out too, since its links would join nothing new.

A segment sends on a spanning forest of its links, at most one edge for each
fingerprint, whatever the number of its pairs. A segment with more than ``split_rows``
fingerprints is cut by blocks of the bits that are still open (two close fingerprints agree
on one of these again), so no task holds more than that many of one segment.
Copies have one fingerprint and take part once; their documents meet it in a join that
gives hot fingerprints a broadcast of bounded size.

Null and empty texts have fingerprint zero and link like any other. Rows that repeat a
doc_id are kept as they are; null ids take no part in the smallest id of a component.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from sparkgauge.llm.common import add_columns, column, hot_keys, join_by_key, stored
from sparkgauge.llm.components import components

SEED = 42
NODE = 8
BATCH_ROWS = 1 << 16
FRONTIER = 1 << 20
SPLIT_ROWS = 100_000


def simhash(text: str | None, words: int = 3) -> int:
    """Fingerprint of a text; 0 without words."""
    tokens = (text or "").encode().lower().split()  # bytes: A-Z only, and white space is 0x20 and 0x09 to 0x0D
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(tokens) - words + 1
    spans = map(slice, starts[:n].tolist(), ends[words - 1:].tolist())
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, spans), repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        ones += np.unpackbits(hashes[at:at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, text: str = "text", name: str = "fp", words: int = 3, keep: Sequence[str] | None = None) -> DataFrame:
    """Add the fingerprint of each text as a signed 64-bit number."""
    def make():
        return lambda texts: [pa.array(np.array([simhash(t, words) for t in texts.to_pylist()], np.uint64).view(np.int64))]

    return add_columns(df, [text], [(name, "long")], make, keep)


def gray_rank(code: Column) -> Column:
    """Rank of a code in Gray order, as a number whose signed order is that of the rank."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code.bitwiseXOR(F.lit(-(1 << 63)))


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class GrayIndex:
    """Index over segments of codes that lie in Gray order, and the forest of links found so far."""

    def __init__(self, segment: np.ndarray, codes: np.ndarray, most_bits: int):
        self.codes, self.most = codes, most_bits
        self.label = np.arange(len(codes))
        #: For each level from the bottom: first child of each node and one more, agreed bits, their values.
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        all_and, all_or, owner = codes, codes, segment
        while True:
            first = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1])
            size = np.diff(np.append(first, len(owner)))
            place = np.arange(len(owner)) - np.repeat(first, size)
            cut = np.flatnonzero(place % NODE == 0)
            all_and, all_or = np.bitwise_and.reduceat(all_and, cut), np.bitwise_or.reduceat(all_or, cut)
            owner = owner[cut]
            agreed = ~(all_and ^ all_or)
            self.levels.append((np.append(cut, len(place)), agreed, all_and & agreed))
            if len(owner) == len(first):
                break
        self.top = np.repeat(np.arange(len(first)), np.diff(np.append(np.flatnonzero(np.append(True, segment[1:] != segment[:-1])), len(segment))))
        last = np.arange(1, len(codes) + 1)
        self.last = []  # one past the last code below each node
        for child, _, _ in self.levels:
            last = last[child[1:] - 1]
            self.last.append(last)

    def link(self, queries: np.ndarray) -> None:
        """Find all links of the codes at these places with later ones."""
        step = max(1, FRONTIER // NODE)
        for at in range(0, len(queries), step):
            q = queries[at:at + step]
            self._descend(len(self.levels) - 1, q, self.top[q], np.zeros(len(q), np.int64))

    def _descend(self, level: int, q: np.ndarray, node: np.ndarray, far: np.ndarray) -> None:
        child, agreed, _ = self.levels[level]
        if level == 0:
            low, high = np.minimum.reduceat(self.label, child[:-1]), np.maximum.reduceat(self.label, child[:-1])
            own = self.label[q]
            open_ = (low[node] != own) | (high[node] != own)
            q, node, far = q[open_], node[open_], far[open_]
        for at in range(0, len(q), FRONTIER // NODE):
            qs, ns, fs = (x[at:at + FRONTIER // NODE] for x in (q, node, far))
            n = child[ns + 1] - child[ns]
            ix = np.repeat(np.arange(len(qs)), n)
            below = np.arange(len(ix)) - np.repeat(np.cumsum(n) - n, n) + child[ns][ix]
            query, above = qs[ix], agreed[ns][ix]
            if level == 0:
                near = (below > query) & (fs[ix] + _popcount((self.codes[query] ^ self.codes[below]) & ~above) <= self.most)
                if near.any():
                    self._join(query[near], below[near])
            else:
                _, mask, values = self.levels[level - 1]
                more = fs[ix] + _popcount((self.codes[query] ^ values[below]) & mask[below] & ~above)
                near = (more <= self.most) & (self.last[level - 1][below] > query + 1)
                if near.any():
                    self._descend(level - 1, query[near], below[near], more[near])

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Merge the components of the pairs: hook the larger root to the smaller, then shorten the paths."""
        label = self.label
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(label[label], label):
                label[:] = label[label]

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        linked = np.flatnonzero(self.label != np.arange(len(self.label)))
        return self.codes[linked], self.codes[self.label[linked]]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and codes of whole segments, gathered into arrays of at least ``BATCH_ROWS``."""
    held: list[list[np.ndarray]] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)])
        rows += batch.num_rows
        if rows >= BATCH_ROWS:
            arrays = [np.concatenate(c) for c in zip(*held)]
            cut = int(np.argmax(arrays[0] == arrays[0][-1]))
            if cut:
                yield arrays[0][:cut], arrays[1][:cut]
            held, rows = [[a[cut:] for a in arrays]], rows - cut
    if rows:
        yield tuple(np.concatenate(c) for c in zip(*held))


def _blocks(bits: int, count: int) -> list[int]:
    """A set of bits cut into ``count`` sets of near equal size."""
    places = [i for i in range(64) if bits >> i & 1]
    edges = [len(places) * i // count for i in range(count + 1)]
    return [sum(1 << p for p in places[x:y]) for x, y in zip(edges, edges[1:])]


def _spread(rows: DataFrame, opened: list[int], count: int) -> tuple[DataFrame, list[int]]:
    """Each code (path, code) to one row for each block of the bits that its path has open; and the open bits of the new paths.

    Its key stands for the path and for the code's bits that the path has fixed.
    """
    left = [bits & ~block for bits in opened for block in _blocks(bits, count)]
    fixed = F.array(*[F.lit(_signed(~bits)) for bits in left])
    taken = rows.select("code", F.explode(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.col("path") * count + i)).alias("path"))
    return taken.select("path", "code", F.xxhash64("path", F.col("code").bitwiseAND(F.get(fixed, F.col("path")))).alias("key")), left


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def segments(codes: DataFrame, most_bits: int = 3, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """(key, code) such that two codes within ``most_bits`` share a key; a key has at most ``split_rows`` codes where open bits allow.

    Codes of a larger segment agree in its block, so what is apart lies in their other bits: these are cut into
    ``most_bits + 1`` blocks again, one of which is equal too, and the segment gives way to the smaller ones.
    """
    count, opened = most_bits + 1, [(1 << 64) - 1]
    rows, done = codes.select(F.lit(0).alias("path"), F.col("fp").alias("code")).filter("code is not null").distinct(), None
    while True:
        spread, opened = _spread(rows, opened, count)
        if min(b.bit_count() for b in opened) < count:  # nothing left to cut
            return spread.select("key", "code") if done is None else done.unionByName(spread.select("key", "code"))
        # A key among these has over split_rows rows, so they are few.
        large = stored(spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > split_rows).select("key"), "large-segments")
        if large.isEmpty():
            return spread.select("key", "code") if done is None else done.unionByName(spread.select("key", "code"))
        small = spread.join(F.broadcast(large), "key", "left_anti").select("key", "code")
        done = small if done is None else done.unionByName(small)
        rows = stored(spread.join(F.broadcast(large), "key", "left_semi").select("path", "code"), "segments")


def links(codes: DataFrame, most_bits: int = 3, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Edges (a, b) that connect the distinct codes of column ``fp`` as all pairs within ``most_bits`` would."""
    ordered = segments(codes, most_bits, split_rows).repartition("key").sortWithinPartitions("key", gray_rank(F.col("code")))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for segment, code in _segments(batches):
            several = np.append(segment[1:] == segment[:-1], False)
            several[1:] |= several[:-1].copy()
            if not several.any():
                continue
            index = GrayIndex(segment[several], code[several], most_bits)
            index.link(np.arange(len(index.codes)))
            a, b = index.forest()
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return ordered.mapInArrow(search, "a long, b long")


def _roots(codes: DataFrame, most_bits: int) -> DataFrame:
    """(fp, root) of the codes that have links; the root is a code of the component."""
    return components(links(codes, most_bits), "a", "b").select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, most_bits: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for each row; the component's id is its smallest doc_id."""
    source = docs.select(column(doc_id).alias("doc_id"), column(text).alias("text"))
    marked = stored(fingerprints(source, words=words, keep=["doc_id"]), "fingerprints")
    codes = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    linked = _roots(codes, most_bits)
    least = codes.join(linked, "fp").groupBy("root").agg(F.min("first_id").alias("least_id"))
    groups = stored(linked.join(least, "root").select("fp", "least_id"), "components")
    facts = codes.join(groups, "fp", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id"))
    hot = stored(hot_keys(marked, "fp"), "hot-fingerprints")
    return join_by_key(marked, facts, "fp", hot).select("doc_id", "fp", "component_id")


def first_of_each(docs: DataFrame, order: Sequence[str], text: str = "text", words: int = 3, most_bits: int = 3) -> DataFrame:
    """The first row of each group of near duplicates by the columns of ``order``, nulls last.

    Rows that repeat in full are separate rows, of which one stays. Fingerprints decide first, by row number; texts are moved once.
    """
    inner = ["__fp", "__row"]
    rows = stored(fingerprints(docs, text, "__fp", words).withColumn("__row", F.monotonically_increasing_id()), "fingerprints")
    place = F.struct(*[x for c in order for x in (column(c).isNull(), column(c))], "__row")
    best = stored(rows.groupBy(F.col("__fp").alias("fp")).agg(F.min(place).alias("first")), "first-rows")
    roots = _roots(best, most_bits)
    firsts = best.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp")).agg(F.min("first").alias("first"))
    keepers = stored(firsts.select(F.col("first.__row").alias("__row")), "keepers")
    return rows.join(keepers, "__row", "left_semi").drop(*inner)


def fingerprint_text(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
