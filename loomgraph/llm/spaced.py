"""Benchmark decontamination by spaced-seed hashing.

A mask picks some positions of a window of words and ignores the others, so a hash
over the picked ones still matches where an ignored word was replaced. The masks of an
item are chosen so that every overlap that counts has a hit (`masks_for`). Hashes of
benchmark windows and of document windows are joined; at each hit both texts are
aligned at the same offset, and the overlap counts where it is long enough and most of
its words agree.

The benchmark is the stated query set. It is taken in blocks of a bounded number of
words, each held against all documents and released before the next is sent, so neither
the driver nor a task ever holds more than one block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back, text_or_empty

#: Words of an overlap at least (or the whole item, if it is shorter), and the share that agrees.
LEAST_WORDS, AGREE = 13, 0.8
#: Words that an item has at least; shorter ones (a bare "yes") are in texts of any kind and overlap nothing.
SHORTEST = 5
#: Words of a block of the query set (an item longer than that is a block of its own).
BLOCK_WORDS = 1 << 20

_WORD = re.compile(r"[^\W_]+")
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)
_BITS = 22


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Hasher:
    """64-bit numbers of words, with a bounded memo."""

    def __init__(self, most: int = 200_000):
        self.memo: dict[str, int] = {}
        self.most = most

    def _word(self, word: str) -> int:
        from xxhash import xxh64_intdigest

        if len(self.memo) >= self.most:
            self.memo.clear()
        got = self.memo[word] = xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 5) or 1
        return got

    def of(self, words: list[str]) -> np.ndarray:
        known = self.memo.get
        return np.array([known(w) or self._word(w) for w in words], dtype=np.uint64)


def seed_hashes(h: np.ndarray, mask: str) -> np.ndarray:
    """A hash for each window of len(mask) words over the positions the mask picks."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return h[:0]
    out = np.full(n, len(mask), dtype=np.uint64)
    for i, bit in enumerate(mask):
        if bit == "1":
            out = (out ^ h[i : i + n]) * _A
            out ^= out >> np.uint64(31)
    return out * _B


def masks_for(n: int, least: int = LEAST_WORDS, agree: float = AGREE) -> tuple[str, ...]:
    """Masks (1 is hashed, 0 ignored) of which one hits every overlap of an item of n words.

    m replaced words leave m + 1 runs of agreeing ones, the longest with its share at
    least. Where the shortest such run comes only of runs that are all as short, two of
    them with a replaced word between are a hit too, and longer runs will do besides."""
    runs = []
    for words in range(max(1, min(least, n)), n + 1):
        m = int((1 - agree) * words + 1e-9)
        runs.append((-(-(words - m) // (m + 1)), words - m, m + 1))
    k = min((run for run, _, _ in runs), default=0)
    if k < 1:
        return ()
    tight = [same == k * parts and parts > 1 for run, same, parts in runs if run == k]
    return ("1" * (k + 1), "1" * k + "0" + "1" * k) if all(tight) else ("1" * k,)


def overlap(doc: np.ndarray, item: np.ndarray, offset: int, agree: float = AGREE) -> tuple[int, int, int]:
    """(words, start in doc, agreeing words) of the longest stretch with doc[i + offset] against
    item[i] whose share of agreeing words is at least `agree`; the first of equal ones."""
    lo, hi = max(0, -offset), min(len(item), len(doc) - offset)
    if hi <= lo:
        return 0, 0, 0
    same = doc[lo + offset : hi + offset] == item[lo:hi]
    total = np.r_[0.0, np.cumsum(same - agree)]
    low = np.minimum.accumulate(total)
    first = np.searchsorted(-low, -(total + 1e-9), "left")  # the earliest sum that isn't higher
    end = int(np.argmax(np.arange(len(total)) - first))
    start = int(first[end])
    return end - start, lo + offset + start, int(same[start:end].sum())


class Block:
    """The benchmark items of one block, with their window hashes sorted for look-up."""

    def __init__(self, items: list[tuple[int, np.ndarray]], least: int = LEAST_WORDS, agree: float = AGREE):
        self.items, self.least, self.agree = items, least, agree
        by_mask: dict[str, list[int]] = {}
        for k, (_, h) in enumerate(items):
            for mask in masks_for(len(h), least, agree):
                by_mask.setdefault(mask, []).append(k)
        self.tables = []
        for mask, ks in by_mask.items():
            parts = [(seed_hashes(items[k][1], mask), k) for k in ks]
            value = np.concatenate([v for v, _ in parts])
            item = np.concatenate([np.full(len(v), k, dtype=np.int32) for v, k in parts])
            place = np.concatenate([np.arange(len(v), dtype=np.int32) for v, _ in parts])
            order = np.argsort(value, kind="stable")
            bits = np.zeros(1 << _BITS, dtype=bool)
            bits[(value >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            self.tables.append((mask, value[order], item[order], place[order], bits))

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """item, offset of the item's start in the document: the distinct ones of all hash matches."""
        items, offsets = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for mask, value, item, place, bits in self.tables:
            v = seed_hashes(h, mask)
            maybe = np.flatnonzero(bits[(v >> np.uint64(64 - _BITS)).astype(np.int64)])
            low, high = np.searchsorted(value, v[maybe], "left"), np.searchsorted(value, v[maybe], "right")
            some = high > low
            if some.any():
                n = (high - low)[some]
                at = np.repeat(low[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                items.append(item[at].astype(np.int64))
                offsets.append(np.repeat(maybe[some], n) - place[at])
        if len(items) == 1:
            return items[0], offsets[0]
        pairs = np.unique(np.stack([np.concatenate(items), np.concatenate(offsets)], axis=1), axis=0)
        return pairs[:, 0], pairs[:, 1]

    def overlaps(self, h: np.ndarray, first: bool = False) -> list[tuple[int, int, int, int]]:
        """(item_id, start, words, agreeing) of the longest verified overlap (the first of equal ones)
        of each item; with `first` no more than one."""
        out: dict[int, tuple[int, int, int, int]] = {}
        for k, offset in zip(*(x.tolist() for x in self.hits(h)), strict=True):
            item_id, item = self.items[k]
            if k in out and out[k][2] == len(item):
                continue
            words, start, same = overlap(h, item, offset, self.agree)
            if words and words >= min(self.least, len(item)) and (k not in out or words > out[k][2]):
                out[k] = (item_id, start, words, same)
                if first:
                    break
        return list(out.values())


def blocks_of(benchmark: DataFrame, least: int = LEAST_WORDS, agree: float = AGREE, words: int = BLOCK_WORDS, shortest: int = SHORTEST) -> Iterator[Block]:
    """The query set in blocks of about `words` words, read one after the other."""
    hasher = Hasher()
    rows: list[tuple[int, np.ndarray]] = []
    held = 0
    for r in benchmark.select("item_id", text_or_empty().alias("text")).toLocalIterator(prefetchPartitions=False):
        h = hasher.of(words_of(r["text"]))
        if len(h) < shortest:
            continue
        if rows and held + len(h) > words:
            yield Block(rows, least, agree)
            rows, held = [], 0
        rows.append((r["item_id"], h))
        held += len(h)
    if rows:
        yield Block(rows, least, agree)


def _each_block(benchmark: DataFrame, step, **options) -> None:
    """`step(block as a broadcast, whether it is the only one)`, one block after the other; those
    but a single one are released when their step is done."""
    blocks = blocks_of(benchmark, **options)
    now = next(blocks, None)
    alone = True
    while now is not None:
        following = next(blocks, None)
        alone = alone and following is None
        sent = benchmark.sparkSession.sparkContext.broadcast(now)
        step(sent, alone)
        if not alone:
            sent.destroy()
        now = following


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, start, n_words, n_same: one row for each document and benchmark item that overlap.

    The overlap is the longest one: start is the word of the document where it begins, n_words its length
    (at least `least`, or the whole item if that is shorter), n_same the words that agree, a share of
    `agree` at least; of equal ones the item's least offset counts. Words are runs of letters and digits
    in lower case. Items of fewer than `shortest` words, null and empty texts on either side overlap
    nothing, nor does an empty table; repeated documents or items give repeated rows; a very long text is
    taken whole. Other columns are not read. Narrow; the documents are read once for each block of
    `words` words of the query set.
    """
    spark = docs.sparkSession
    source = docs.select("doc_id", text_or_empty().alias("text"))
    id_type = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {id_type}, item_id long, start long, n_words long, n_same long"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    parts: list[DataFrame] = []

    def step(sent, alone: bool) -> None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher, held = Hasher(), sent.value
            for batch in batches:
                ids, out = batch.column(0), []
                for at in range(0, batch.num_rows, 1000):
                    for i, text in enumerate(batch.column(1).slice(at, 1000).to_pylist()):
                        for x in held.overlaps(hasher.of(words_of(text))):
                            out.append((at + i, *x))
                take = pa.array([x[0] for x in out], type=pa.int64())
                columns = [ids.take(take).cast(arrow.field(0).type)]
                columns += [pa.array([x[j] for x in out], type=pa.int64()) for j in range(1, 5)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

        part = source.mapInArrow(run, schema)
        parts.append(part if alone else cut(part, "overlaps"))

    _each_block(benchmark, step, **options)
    found = parts[0] if parts else spark.createDataFrame([], schema)
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def flags(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_items, n_words (of the longest overlap): one row per contaminated doc_id, over all its
    rows; a null doc_id is one, too. Empty, null and long texts are as in `contaminated`."""
    return contaminated(docs, benchmark, **options).groupBy("doc_id").agg(
        F.countDistinct("item_id").alias("n_items"), F.max("n_words").alias("n_words")
    )


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `docs` without an overlap as in `contaminated`, all columns as they are.

    Narrow: a row is dropped where it lies, block after block of the query set; with several
    blocks the rows left are written down between them. Null and empty texts stay, repeated rows
    go or stay together, an empty table on either side drops nothing."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = [docs]
    arrow, at_text = to_arrow_schema(docs.schema), docs.columns.index("text")

    def step(sent, alone: bool) -> None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher, held = Hasher(), sent.value
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    part = batch.slice(at, 1000)
                    free = [not held.overlaps(hasher.of(words_of(t or "")), first=True) for t in part.column(at_text).to_pylist()]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(part.filter(pa.array(free)).columns, arrow, strict=True)], schema=arrow)
            del hasher
            give_back()

        left = kept[0].mapInArrow(run, docs.schema)
        kept[0] = left if alone else cut(left, "without-overlaps")

    _each_block(benchmark, step, **options)
    return kept[0]
