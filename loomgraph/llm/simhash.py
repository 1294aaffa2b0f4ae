"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments. Two fingerprints that differ in at most
`max_bits` bits agree in some segment up to a few bits, so every fingerprint is put
in a table under each segment's value and looks up the small Hamming ball around it;
what it meets is verified over the whole fingerprint. Of two neighbours in a segment
only one enumerates the other (the one with a zero at the lowest bit in which they
differ), which halves the ball without losing a pair.

What leaves a table group is a forest over its linked fingerprints, not all pairs.

`similar_components` goes by exact likeness of shingle sets. Its candidates are what the
tables above link and, because sets of similarity 0.8 differ in about ten of 64 bits and
so mostly lie outside any ball that can be enumerated, what agrees in a band of least hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, combinations
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back, join_often, map_text, text_or_empty
from .components import connected_components

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLACE = np.arange(8, dtype=np.int64) * 256
#: Shingles counted at once, rows linked at once, members of a table group in one unit of work.
SHINGLES_AT_ONCE, ROWS_AT_ONCE, UNIT = 1 << 16, 200_000, 30_000
#: Least hashes of a band; chance at most that a similar pair shares no band, and that its sketches
#: rule it out; least hashes of a sketch (two bits of each).
ROWS, MISS, SKETCH = 4, 1e-6, 96
#: Rows of a group whose pairs are compared one by one; elements of sets compared in one unit; pivots
#: of a group too large for one unit.
FEW, BLOCK_ELEMENTS, PIVOTS = 16, 1_000_000, 8


def shingle_hashes(text: str, shingle: int) -> Iterator[np.ndarray]:
    """Hashes of a text's word shingles in their order, a bounded number at a time.

    A-Z are lower-cased, words are runs of what isn't ASCII white space. Fewer words
    than `shingle`: the whole sequence; no words: nothing.
    """
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words)))
    k = min(shingle, len(words))
    n = len(words) - k + 1
    stops = [e + i for i, e in enumerate(ends)]
    starts = [0, *[e + 1 for e in stops[: n - 1]]]
    for at in range(0, n, SHINGLES_AT_ONCE):
        to = min(n, at + SHINGLES_AT_ONCE)
        yield np.array(
            [xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts[at:to], stops[at + k - 1 : to + k - 1], strict=True)],
            dtype="<u8",
        )


def _folded(parts: Iterable[np.ndarray]) -> int:
    counts, n = np.zeros((8, 8), dtype=np.int64), 0
    for h in parts:
        seen = np.bincount((h.view(np.uint8).reshape(-1, 8) + _PLACE).ravel(), minlength=2048)
        counts += seen.reshape(8, 256) @ _BITS
        n += len(h)
    return int(np.packbits((counts * 2 > n).ravel(), bitorder="little").view("<i8")[0]) if n else 0


def fingerprint(text: str, shingle: int = 4) -> int:
    """64-bit SimHash of the word shingles of `text` (repeats count), as a signed integer;
    zero without words."""
    return _folded(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, fp (long): one row per row of `docs`; a null text counts as empty. Narrow."""
    return map_text(
        docs.select("doc_id", text_or_empty().alias("text")),
        lambda texts: {"fp": [fingerprint(t, shingle) for t in texts]},
        "fp long",
    )


def segments_of(segments: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment."""
    cuts = [round(64 * i / segments) for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def ball_masks(max_bits: int, segments: int) -> list[tuple[int, np.ndarray]]:
    """Per segment, the masks to flip (mask 0, the own entry, first).

    With max_bits = segments * a + b, a pair agrees within a bits in one of the first
    b + 1 segments or within a - 1 bits in one of the others.
    """
    a, b = divmod(max_bits, segments)
    out = []
    for i, (low, width) in enumerate(segments_of(segments)):
        radius = a if i <= b else a - 1
        if radius >= 0:
            masks = [sum(1 << (low + j) for j in c) for r in range(radius + 1) for c in combinations(range(width), r)]
            out.append((i, np.array(masks, dtype=np.uint64)))
    return out


def table_rows(fps: DataFrame, max_bits: int, segments: int) -> DataFrame:
    """key, fp, own of each table entry (own) and of each look-up, for distinct `fps`."""
    plan, cuts = ball_masks(max_bits, segments), segments_of(segments)
    schema = pa.schema([("key", pa.int64()), ("fp", pa.int64()), ("own", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                fp = batch.column(0).slice(at, 5000).to_numpy(zero_copy_only=False).view(np.uint64)
                for i, masks in plan:
                    low, width = cuts[i]
                    lowest = masks & (~masks + np.uint64(1))
                    flips = (fp[:, None] & lowest[None, :]) == 0  # true for mask 0 too
                    value = ((fp[:, None] ^ masks[None, :]) >> np.uint64(low)) & np.uint64((1 << width) - 1)
                    row, col = np.nonzero(flips)
                    key = (value[row, col] * np.uint64(64) + np.uint64(i)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row].view(np.int64)), pa.array(col == 0)], schema=schema)

    if segments < 2:
        raise ValueError("at least two segments")
    return fps.select("fp").mapInArrow(run, "key long, fp long, own boolean")


def _within(fp: np.ndarray, a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    return np.bitwise_count(fp[a] ^ fp[b]) <= max_bits


def _link_large(fp: np.ndarray, own: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what all pairs of an own entry and any other row would connect in
    one large group. Rows near a central pivot are linked to it; pairs of them need no
    link of their own. Every pair with a row that isn't near is compared, a block at a time."""
    bits = np.unpackbits(fp[own].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    centre = np.packbits(bits.sum(0) * 2 > len(bits), bitorder="little").view(np.uint64)[0]
    owned = np.flatnonzero(own)
    pivot = owned[np.argmin(np.bitwise_count(fp[owned] ^ centre))]
    near = np.bitwise_count(fp ^ fp[pivot]) <= max_bits
    hit = np.flatnonzero(near)
    links = [(np.full(len(hit), pivot), hit)]
    for rows, others in ((np.flatnonzero(own & ~near), np.arange(len(fp))), (np.flatnonzero(own & near), np.flatnonzero(~own & ~near))):
        step = max(1, (1 << 22) // max(1, len(others)))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            r, c = np.nonzero(np.bitwise_count(fp[part][:, None] ^ fp[others][None, :]) <= max_bits)
            links.append((part[r], others[c]))
    return links


def link_rows(group: np.ndarray, fp: np.ndarray, own: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest over the fingerprints linked within the groups; rows stand group by group."""
    fp = fp.view(np.uint64)
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[start, len(group)])
    owned = np.add.reduceat(own.astype(np.int64), start) > 0
    links: list[tuple[np.ndarray, np.ndarray]] = []
    wanted = owned & (size > 1)
    for s, n in zip(start[wanted & (size > 256)], size[wanted & (size > 256)], strict=True):
        links += [(a + s, b + s) for a, b in _link_large(fp[s : s + n], own[s : s + n], max_bits)]
    small = wanted & (size <= 256)
    for part in np.array_split(np.flatnonzero(small), max(1, int((size[small] ** 2).sum() // 4_000_000))):
        if not len(part):
            continue
        member = np.repeat(start[part], size[part]) + _ramp(size[part])
        group_of, each = np.repeat(start[part], size[part]), np.repeat(size[part], size[part])
        keep = own[member]
        member, group_of, each = member[keep], group_of[keep], each[keep]
        a, b = np.repeat(member, each), np.repeat(group_of, each) + _ramp(each)
        ok = (a != b) & _within(fp, a, b, max_bits)
        links.append((a[ok], b[ok]))
    if not links:
        return fp[:0].view(np.int64), fp[:0].view(np.int64)
    a, b = np.concatenate([x for x, _ in links]), np.concatenate([y for _, y in links])
    return _forest(fp[a].view(np.int64), fp[b].view(np.int64))


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each node but the smallest of its component to that one."""
    named, back = np.unique(np.r_[a, b], return_inverse=True)
    x, y = back[: len(a)], back[len(a) :]
    root = np.arange(len(named))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, root, new)
        new = new[new]
        if (new == root).all():
            break
        root = new
    far = root != np.arange(len(named))
    return named[far], named[root[far]]


def _ramp(sizes: np.ndarray) -> np.ndarray:
    if not len(sizes):
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(sizes)
    return np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)


def _by_group(rows: DataFrame, columns: list[str], schema: pa.Schema, ddl: str, fn) -> DataFrame:
    """`fn` of the arrays (group number, then `columns`) of whole groups of (key, unit), many at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        count = 0

        def flush(last: bool) -> pa.RecordBatch | None:
            nonlocal held, count
            key, unit, *more = (np.concatenate(x) for x in zip(*held, strict=True))
            end = len(key)
            if not last:  # the last group may go on in the next batch
                different = np.flatnonzero((key != key[-1]) | (unit != unit[-1]))
                end = different[-1] + 1 if len(different) else 0
            held = [[x[end:] for x in (key, unit, *more)]]
            count = len(key) - end
            if not end:
                return None
            change = (key[1:end] != key[: end - 1]) | (unit[1:end] != unit[: end - 1])
            found = fn(np.cumsum(np.r_[0, change]), *[x[:end] for x in more])
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found], schema=schema)

        limit = ROWS_AT_ONCE
        for batch in batches:
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(2 + len(columns))])
            count += batch.num_rows
            if count >= limit:
                got = flush(False)
                limit = max(ROWS_AT_ONCE, 2 * count)
                if got is not None:
                    yield got
        if held and sum(len(x[0]) for x in held):
            got = flush(True)
            if got is not None:
                yield got
        del held
        give_back()

    dealt = rows.select("key", "unit", *columns).repartition("key", "unit").sortWithinPartitions("key", "unit")
    return dealt.mapInArrow(run, ddl)


def link_groups(rows: DataFrame, max_bits: int) -> DataFrame:
    """src, dst: links that connect the same fingerprints as all pairs of each table group would."""
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])
    return _by_group(rows, ["fp", "own"], schema, "src long, dst long", lambda group, fp, own: link_rows(group, fp, own, max_bits))


def split_hot(rows: DataFrame, unit: int = UNIT) -> DataFrame:
    """Adds `unit`, so that no task holds a whole hot group: own entries are cut into blocks of about
    `unit`, look-ups too; every pair of blocks of own entries is a unit of work, and so is every block
    of look-ups with one of own entries. Look-ups of a hot key without own entries are dropped."""
    counts = rows.groupBy("key").agg(F.count(F.when(F.col("own"), 1)).alias("mine"), F.count(F.when(~F.col("own"), 1)).alias("theirs"))
    counts = counts.where(F.greatest("mine", "theirs") > unit)
    hot = cut(counts.select("key", *[F.ceil(F.col(c) / unit).cast("int").alias(c) for c in ("mine", "theirs")]), "hot-keys")
    if hot.isEmpty():
        return rows.withColumn("unit", F.lit(0))

    def numbers(to: F.Column) -> F.Column:
        return F.when(to > 0, F.sequence(F.lit(0), to - 1)).otherwise(F.array().cast("array<int>"))

    mine, theirs, h = F.col("mine"), F.col("theirs"), F.xxhash64("fp")
    i, k, look = F.pmod(h, mine).cast("int"), F.pmod(h, theirs).cast("int"), mine * mine
    as_own = F.concat(F.transform(numbers(mine), lambda j: F.least(i, j) * mine + F.greatest(i, j)), F.transform(numbers(theirs), lambda x: look + i * theirs + x))
    as_look = F.transform(numbers(mine), lambda j: look + j * theirs + k)
    units = F.when(mine.isNull(), F.array(F.lit(0))).when(F.col("own"), as_own).otherwise(as_look)
    return rows.join(hot, "key", "left").withColumn("unit", F.explode(units)).drop("mine", "theirs")


def near_duplicates(
    docs: DataFrame, shingle: int = 4, max_bits: int = 4, segments: int = 3
) -> DataFrame:
    """doc_id, fp, component_id: one row per row of `docs`.

    component_id is the smallest doc_id among the documents that can be reached over
    fingerprints that differ in at most `max_bits` bits. A null text is an empty one
    (fingerprint zero, linked like any other); rows with a null doc_id take part and
    get the component's smallest known id, or null if it has none; repeated rows stay.
    An empty table gives an empty result. Other columns are not read.

    Copies with one fingerprint are one entry of the tables (their smallest id is
    pre-aggregated), so a group of exact copies costs one row. `segments` sets the
    balance of look-ups a fingerprint makes to entries it meets: 3 suits up to about
    10^8 fingerprints, 2 more; the result is the same.
    """
    marked = cut(fingerprints(docs, shingle), "fingerprints")
    known = marked.groupBy("fp").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("rows"))
    stars = connected_components(fingerprint_links(known, max_bits, segments))
    linked = stars.join(known, stars.node == known.fp).select("node", "root", "doc")
    least = linked.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = linked.join(least, "root").select(F.col("node").alias("fp"), "component_id")
    table = known.join(named, "fp", "left").select("fp", "rows", F.coalesce("component_id", "doc").alias("component_id"))
    return join_often(marked, cut(table, "components"), "fp").select("doc_id", "fp", "component_id")


def fingerprint_links(known: DataFrame, max_bits: int, segments: int) -> DataFrame:
    """src, dst: links over the distinct `fp` of `known` that connect all pairs within `max_bits`."""
    return link_groups(split_hot(table_rows(known, max_bits, segments)), max_bits)


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles, as `fingerprint` takes them."""
    return _distinct(shingle_hashes(text, shingle))


def _distinct(parts: Iterable[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, dtype="<u8"), *parts]))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Likeness of two sorted sets; two empty ones are alike."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared) if len(a) or len(b) else 1.0


def set_id(shingles: np.ndarray) -> int:
    """What equal sets share, as a signed integer."""
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(shingles.tobytes(), 7)).view(np.int64))


def bands_for(similarity: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands of `rows` least hashes, of which sets of at least `similarity` share one but with the chance `miss`."""
    return ceil(log(miss) / log(1 - similarity**rows)) if similarity < 1 else 1


def least_agreeing(similarity: float, of: int = SKETCH, miss: float = MISS) -> int:
    """The two-bit numbers that agree of `of`, at least, but with the chance `miss`, in sketches of similar sets."""
    p, total = similarity + (1 - similarity) / 4, 0.0
    for k in range(of + 1):
        total += comb(of, k) * p**k * (1 - p) ** (of - k)
        if total > miss:
            return k
    return of


def _numbers_of(n: int, seed: int) -> np.ndarray:
    """n well mixed 64-bit numbers by a rule."""
    x = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _hashers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return (_numbers_of(n, 0) >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1), (_numbers_of(n, 1000) >> np.uint64(32)).astype(np.uint32)[:, None]


def least_hashes(shingles: np.ndarray, n: int) -> np.ndarray:
    """The least of n 32-bit hashes of a set's elements: two sets agree in a share of them that is near their similarity."""
    x, (factors, flips) = (shingles >> np.uint64(32)).astype(np.uint32), _hashers(n)
    out = np.full(n, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 2048):
        out = np.minimum(out, (x[None, at : at + 2048] * factors ^ flips).min(axis=1))
    return out


def band_keys(least: np.ndarray, bands: int) -> np.ndarray:
    """A number of each band of least hashes, as signed integers."""
    out = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    for column in least[: bands * ROWS].reshape(bands, ROWS).T.astype(np.uint64):
        out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def sketch(least: np.ndarray) -> np.ndarray:
    """Two mixed bits of each of the first `SKETCH` least hashes, as longs."""
    mixed = ((least[:SKETCH] * np.uint32(0x9E3779B1)) ^ (least[:SKETCH] >> np.uint32(15))) * np.uint32(0x85EBCA77) >> np.uint32(30)
    bits = np.stack([mixed & np.uint32(1), mixed >> np.uint32(1)], axis=1).astype(np.uint8).ravel()
    return np.packbits(bits, bitorder="little").view("<i8")


def _possible(n: np.ndarray, sign: np.ndarray, a, b, similarity: float, agreeing: int) -> np.ndarray:
    """False only for pairs that sizes or sketches rule out."""
    na, nb = n[a], n[b]
    x = sign[a] ^ sign[b]
    differ = np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(axis=-1, dtype=np.int64)
    return (np.minimum(na, nb) >= similarity * np.maximum(na, nb) - 1e-9) & (differ <= SKETCH - agreeing)


def candidate_rows(group: np.ndarray, fp: np.ndarray, n: np.ndarray, *sign: np.ndarray, similarity: float) -> tuple[np.ndarray, ...]:
    """src, dst: a forest that connects what all possible pairs of the groups connect."""
    sign, agreeing = np.stack(sign, axis=1).view(np.uint64), least_agreeing(similarity)
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[start, len(group)])
    links: list[tuple[np.ndarray, np.ndarray]] = []
    for s, m in zip(start[size > FEW], size[size > FEW], strict=True):
        every = np.arange(s, s + m)
        pivot = every[np.argsort(n[every])[m // 2]]
        near = _possible(n, sign, pivot, every, similarity, agreeing)
        links.append((np.full(near.sum(), pivot), every[near]))
        far, step = every[~near], max(1, (1 << 18) // m)
        for at in range(0, len(far), step):
            rows = far[at : at + step]
            r, c = np.nonzero(_possible(n, sign, rows[:, None], every[None, :], similarity, agreeing))
            links.append(_forest(rows[r], every[c]))
    member = np.flatnonzero(np.repeat((size > 1) & (size <= FEW), size))
    end = np.repeat(start + size, size)
    each = end[member] - member - 1
    for part in np.array_split(np.arange(len(member)), max(1, int(each.sum() // 500_000))):
        a = np.repeat(member[part], each[part])
        b = a + 1 + _ramp(each[part])
        ok = _possible(n, sign, a, b, similarity, agreeing)
        links.append((a[ok], b[ok]))
    src, dst = (np.concatenate([np.zeros(0, dtype=np.int64), *[fp[x[i]] for x in links]]) for i in range(2))
    return _forest(src, dst)


def similar_sets(ids: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """src, dst: links that connect what all pairs of at least `similarity` connect. A set's
    shared elements with all others are counted at once; only pairs within the largest
    component need no count."""
    size = np.array([len(x) for x in sets], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    _, code, times = np.unique(np.concatenate([np.zeros(0, dtype="<u8"), *sets]), return_inverse=True, return_counts=True)
    posted, first = owner[np.argsort(code, kind="stable")], np.r_[0, np.cumsum(times)]
    begin = np.r_[0, np.cumsum(size)]
    weight = np.bincount(owner, weights=times[code], minlength=len(sets))
    order = np.argsort(-weight, kind="stable")
    root, src, dst = np.arange(len(sets)), [], []
    count = np.ones(len(sets), dtype=np.int64)
    done = np.zeros(len(sets), dtype=bool)
    while len(todo := order[~done[order] & (root[order] != count.argmax())]):
        i = todo[0]
        done[i] = True
        mine = code[begin[i] : begin[i + 1]]
        hits = posted[np.repeat(first[mine], times[mine]) + _ramp(times[mine])]
        shared = np.bincount(hits, minlength=len(sets))
        for j in np.flatnonzero(shared / np.maximum(size + size[i] - shared, 1) >= similarity):
            low, high = sorted((root[i], root[j]))
            if low != high:
                src.append(ids[i])
                dst.append(ids[j])
                root[root == high] = low
                count[low] += count[high]
                count[high] = 0
    return np.array(src, dtype=np.int64), np.array(dst, dtype=np.int64)


def _candidates(known: DataFrame, similarity: float, max_bits: int, segments: int) -> DataFrame:
    """src, dst: links between ids of sets that connect all pairs that may be similar: fingerprints
    within `max_bits`, and sets with a band in common that sizes and sketches leave possible."""
    named = known.groupBy("fp").agg(F.min("id").alias("first"))
    by_bits = fingerprint_links(named, max_bits, segments)
    for end in ("src", "dst"):
        by_bits = by_bits.join(named.select(F.col("fp").alias(end), F.col("first").alias(f"{end}_id")), end)
    same = known.join(named, "fp").select(F.col("id").alias("src"), F.col("first").alias("dst")).where("src != dst")
    signs = [c for c in known.columns if c[0] == "s" and c[1:].isdigit()]
    rows = known.select(F.explode("keys").alias("key"), F.col("id").alias("fp"), F.lit(True).alias("own"), "n", *signs)
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])
    by_bands = _by_group(split_hot(rows), ["fp", "n", *signs], schema, "src long, dst long", lambda *x: candidate_rows(*x, similarity=similarity))
    return by_bands.unionByName(by_bits.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))).unionByName(same)


def _sets_of(source: DataFrame, members: DataFrame, shingle: int) -> DataFrame:
    """id, set of each member, from the texts of one document of each; one row an id."""
    docs = members.select(F.col("doc").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    texts = source.join(docs, "doc_id", "left_semi").unionByName(source.where("doc_id IS NULL"))

    def sketched(values: list) -> dict[str, list]:
        sets = [shingle_set(t, shingle) for t in values]
        return {"id": [set_id(x) for x in sets], "set": [x.tobytes() for x in sets]}

    return map_text(texts.select("text"), sketched, "id long, set binary").groupBy("id").agg(F.first("set").alias("set"))


def _verified(dealt: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """src, dst: links that connect what all similar pairs of one root within one unit connect."""

    def within(table: pa.Table) -> pa.Table:
        ids, roots = (table.column(c).to_numpy() for c in ("id", "root"))
        order = np.lexsort((ids, roots))
        order = order[np.r_[True, (ids[order[1:]] != ids[order[:-1]]) | (roots[order[1:]] != roots[order[:-1]])]]
        each, src, dst = table.column("set"), [], []
        for part in np.split(order, np.flatnonzero(np.diff(roots[order])) + 1):
            found = similar_sets(ids[part], [np.frombuffer(each[int(i)].as_buffer(), "<u8") for i in part], similarity)
            src.append(found[0])
            dst.append(found[1])
        return pa.table({"src": pa.array(np.concatenate(src)), "dst": pa.array(np.concatenate(dst))})

    return dealt.join(sets, "id").select("id", "root", "unit", "set").groupBy("unit").applyInArrow(within, "src long, dst long")


def _numbers(to: F.Column) -> F.Column:
    return F.sequence(F.lit(0), to - 1)


def _compared(members: DataFrame, sets: DataFrame, similarity: float, elements: int) -> DataFrame:
    """src, dst: links that connect all similar pairs within the roots of `members` (id, root, n).

    Roots of up to `elements` elements are dealt whole to units of about that size. A larger one is
    cut into blocks, each compared within itself and with some pivots; then what isn't connected to
    the root's largest class is compared with all blocks. So a group of copies of one text is sent
    about once, and only what stays apart is compared across blocks."""
    blocks = F.ceil(F.col("total") / elements).cast("int")
    sized = members.groupBy("root").agg(F.sum("n").alias("total"), *[F.min_by("id", F.xxhash64("id", F.lit(k))).alias(f"p{k}") for k in range(PIVOTS)])
    sized = cut(sized.withColumn("blocks", F.greatest(blocks, F.lit(1))), "candidate-groups")
    rest = sized.where("blocks = 1").agg(F.sum("total").alias("total")).first()["total"] or 0
    unit = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(rest // elements + 1))).otherwise(F.xxhash64("root", "block"))
    placed = members.join(sized.select("root", "blocks"), "root").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = placed.select("id", "root", unit.alias("unit"))
    large = sized.where("blocks > 1")
    if large.isEmpty():
        return _verified(dealt, sets, similarity)
    pivots = large.select("root", "blocks", F.explode(F.array_distinct(F.array(*[f"p{k}" for k in range(PIVOTS)]))).alias("id"))
    pivots = pivots.withColumn("block", F.explode(_numbers(F.col("blocks")))).select("id", "root", unit.alias("unit"))
    first = cut(_verified(dealt.unionByName(pivots), sets, similarity), "links")
    named = connected_components(first).select(F.col("node").alias("id"), F.col("root").alias("class"))
    apart = placed.where("blocks > 1").join(named, "id", "left").withColumn("class", F.coalesce("class", "id"))
    apart = cut(apart, "classes")
    largest = apart.groupBy("root", "class").count().groupBy("root").agg(F.max_by("class", F.struct("count", "class")).alias("largest"))
    far = apart.join(largest, "root").where("class != largest")
    parts = far.groupBy("root").agg(F.greatest(F.ceil(F.sum("n") / elements), F.lit(1)).cast("int").alias("parts"))
    parts = cut(parts, "apart")
    if parts.isEmpty():
        return first
    a_unit = F.xxhash64("root", "part", "block", F.lit("apart"))
    outer = far.join(parts, "root").withColumn("part", F.pmod(F.xxhash64("id", F.lit("part")), F.col("parts")).cast("int"))
    outer = outer.withColumn("block", F.explode(_numbers(F.col("blocks")))).select("id", "root", a_unit.alias("unit"))
    every = apart.join(parts, "root").withColumn("part", F.explode(_numbers(F.col("parts")))).select("id", "root", a_unit.alias("unit"))
    return first.unionByName(_verified(outer.unionByName(every), sets, similarity))


def similar_components(
    docs: DataFrame, shingle: int = 5, similarity: float = 0.8, max_bits: int = 4, segments: int = 3, elements: int = BLOCK_ELEMENTS
) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, id of every row; id, rows, component_id of every distinct set of shingles).

    Components are those of all pairs of texts whose sets of shingles have at least `similarity`
    (texts with equal sets are alike, also those without words). Candidates are fingerprints within
    `max_bits` by the tables and sets that share a band of least hashes, which a similar pair fails to
    do with a chance of at most `MISS`; every link is the outcome of a comparison of two whole sets.
    Null ids, null texts and repeated rows are as in `near_duplicates`; only texts of candidates are
    read again. Very long texts are hashed a bounded number of shingles at a time.
    """
    source = docs.select("doc_id", text_or_empty().alias("text"))
    bands, longs = bands_for(similarity), SKETCH // 32
    hashes = max(bands * ROWS, SKETCH)

    def described(texts: list) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("fp", "id", "n", *[f"s{i}" for i in range(longs)], "keys")}
        for text in texts:
            parts = list(shingle_hashes(text, shingle))
            own = _distinct(parts)
            least = least_hashes(own, hashes)
            row = (_folded(parts), set_id(own), len(own), *map(int, sketch(least)), band_keys(least, bands) if len(own) else [])
            for c, x in zip(out, row, strict=True):
                out[c].append(x)
        return out

    signs = [f"s{i}" for i in range(longs)]
    ddl = f"fp long, id long, n int, {', '.join(f'{s} long' for s in signs)}, keys array<long>"
    marked = cut(map_text(source, described, ddl), "shingle-bands")
    each = [F.first(c).alias(c) for c in ("fp", "n", *signs, "keys")]
    known = cut(marked.groupBy("id").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("rows"), *each), "distinct-sets")
    groups = connected_components(_candidates(known, similarity, max_bits, segments)).select(F.col("node").alias("id"), "root")
    members = cut(known.select("id", "doc", "n").join(groups, "id"), "candidates")
    links = _compared(members, _sets_of(source, members, shingle), similarity, elements)
    merged = connected_components(links).select(F.col("node").alias("id"), "root")
    top = known.select("id", "doc", "rows").join(merged, "id", "left").withColumn("top", F.coalesce("root", "id"))
    least = top.groupBy("top").agg(F.min("doc").alias("component_id"))
    return marked.select("doc_id", "fp", "id"), cut(top.join(least, "top").select("id", "rows", "component_id"), "components")


def similar_documents(docs: DataFrame, **options) -> DataFrame:
    """doc_id, fp, component_id of every row of `docs`, by `similar_components`."""
    marked, table = similar_components(docs, **options)
    return join_often(marked, table, "id").select("doc_id", "fp", "component_id")


def keep_similar(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that `keep_first` keeps of components of similar texts: only their first
    ids are joined, so that no join has a key that copies share."""
    _, table = similar_components(docs, **options)
    return _kept(docs, table.select(F.col("component_id").alias("doc_id")).where("doc_id IS NOT NULL"))


def hex_digits(fp: str = "fp") -> F.Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id names their component in `found`; of rows that
    repeat such an id one stays, and rows without an id stay."""
    return _kept(docs, found.where(F.col("component_id") == F.col("doc_id")).select("doc_id"))


def _kept(docs: DataFrame, named: DataFrame) -> DataFrame:
    named = named.distinct()
    kept = docs.join(named, "doc_id", "left_semi")
    rows = docs.select("doc_id").join(named, "doc_id", "left_semi").groupBy("doc_id").count()
    if not rows.where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id"])
    return kept.select(docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))
