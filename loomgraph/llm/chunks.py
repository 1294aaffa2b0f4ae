"""Document fingerprints by content-defined chunking.

A gear hash rolls over the bytes of a text; where its top bits are zero a chunk may
end. Cutting is normalised: below the normal size more bits must be zero than above
it, so sizes gather around it. An insertion moves only the boundaries near it, so the
set of chunk digests survives shifts. The likeness of two fingerprints is the length
of the chunks they share over the length of the smaller set: containment.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import MOST_PARTS, by_id, id_cuts, parts_for, sizes

#: Bytes of a chunk: least, normal, most; zero bits asked for below and above the normal size.
LEAST, NORMAL, MOST, STRICT, LOOSE = 16, 40, 160, 7, 4
#: Bytes whose hashes are held at once; text bytes of a partition.
WINDOW, PART_BYTES = 1 << 20, 32 << 20


def _gear() -> np.ndarray:
    """256 32-bit numbers by a rule: the high halves of multiples of an odd constant, mixed."""
    x = (np.arange(1, 257, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(np.uint32)


_GEAR = _gear()


def gear_hashes(data: bytes) -> np.ndarray:
    """The gear hash after each byte: sum of gear[byte i - k] << k, over 32 bytes."""
    h = _GEAR[np.frombuffer(data, dtype=np.uint8)]
    reach = 1
    while reach < 32:
        if len(h) <= reach:
            break
        more = h.copy()
        more[reach:] += h[:-reach] << np.uint32(reach)
        h, reach = more, reach * 2
    return h


def candidates(data: bytes) -> tuple[list[int], list[int]]:
    """Ends where a chunk may stop: by the loose rule, and by the strict one."""
    loose, strict = [], []
    for at in range(0, len(data), WINDOW):
        lead = min(at, 31)
        h = gear_hashes(data[at - lead : at + WINDOW])[lead:]
        where = np.flatnonzero(h < (1 << (32 - LOOSE)))
        loose += (where + (at + 1)).tolist()
        strict += (where[h[where] < (1 << (32 - STRICT))] + (at + 1)).tolist()
    return loose, strict


def cut_points(data: bytes, start: int = 0) -> list[int]:
    """Ends of the chunks of `data` from `start` (itself a cut); the last is the end of data.

    Each cut depends only on the bytes before it, so texts with a common beginning
    have its cuts in common."""
    lead = max(0, start - 31)
    loose, strict = candidates(data[lead:])
    n, at, cuts = len(data), start, []
    while at < n:
        low, middle, high = at + LEAST, at + NORMAL, min(n, at + MOST)
        i = bisect_left(strict, low - lead)
        if i < len(strict) and strict[i] + lead < middle:
            end = strict[i] + lead
        else:
            i = bisect_left(loose, max(low, middle) - lead)
            end = loose[i] + lead if i < len(loose) and loose[i] + lead < high else high
        at = min(end, n)
        cuts.append(at)
    return cuts


def chunk_digests(data: bytes, cuts: list[int], start: int = 0) -> dict[int, int]:
    """Length by digest of the distinct chunks."""
    from xxhash import xxh64_intdigest

    out = {}
    for end in cuts:
        out[xxh64_intdigest(data[start:end], 6)] = end - start
        start = end
    return out


def fingerprint(text: str) -> dict[int, int]:
    data = text.encode("utf-8", "surrogatepass")
    return chunk_digests(data, cut_points(data))


def render(chunks: dict[int, int]) -> str:
    """digest:length of each distinct chunk, in the order of the digests."""
    return " ".join(f"{d:016x}:{n}" for d, n in sorted(chunks.items()))


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """Shared length over the length of the smaller set; two empty ones are alike, an empty and another not."""
    if not a or not b:
        return float(not a and not b)
    if len(a) > len(b):
        a, b = b, a
    shared = sum(n for d, n in a.items() if d in b)
    return min(1.0, shared / min(sum(a.values()), sum(b.values())))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every row of `docs`; a null text counts as empty, and an empty
    text's fingerprint is the empty string. Repeated rows stay, equal texts agree. Narrow."""
    from .common import map_text, text_or_empty

    source = docs.select("doc_id", text_or_empty().alias("text"))
    return map_text(source, lambda texts: {"fingerprint": [render(fingerprint(t)) for t in texts]}, "fingerprint string")


class _Marked:
    """A text with its bytes, cuts and chunks."""

    def __init__(self, doc_id, text: str):
        self.doc_id, self.text = doc_id, text
        self.data = text.encode("utf-8", "surrogatepass")
        self.cuts = cut_points(self.data)
        self.chunks = chunk_digests(self.data, self.cuts)


def _edited(one: _Marked, following: str) -> tuple[str, dict[int, int]]:
    """The text with its last quarter replaced by the beginning of the next one, and its chunks.

    Chunks that end within the kept part are those of the text itself; only what
    follows is cut again."""
    n = len(one.text)
    kept = one.text[: n - n // 4]
    text = kept + following[: n // 4]
    data, common = text.encode("utf-8", "surrogatepass"), len(kept.encode("utf-8", "surrogatepass"))
    same = bisect_left(one.cuts, common)  # a cut at the very end of the kept part may be the text's own end
    start = one.cuts[same - 1] if same else 0
    return text, chunk_digests(data, one.cuts[:same]) | chunk_digests(data, cut_points(data, start), start)


def compare_edited(docs: DataFrame, part_bytes: int = PART_BYTES, most_parts: int = MOST_PARTS) -> DataFrame:
    """doc_id, n_chars, edited (text), fingerprint, edited_fingerprint, near_edited, near_next.

    One row per row of `docs`. The next document is the next in ascending doc_id (null
    ids first; rows with one id by their text, a repeated row next to its twin), the
    first after the last. A null text counts as empty; a single document is its own
    next; an empty table gives an empty result; other columns are not read.

    Documents are dealt once, by ranges of ids of about `part_bytes` of text; each range
    also gets the first document of the one after it. The driver sees one id a range. With
    more than `most_parts` ranges these grow instead; a task holds a batch of rows and one
    document more, however long its range is. Very long texts are hashed in windows.
    """
    id_type = dict(docs.dtypes)["doc_id"]
    rows = by_id(docs, id_cuts(docs, parts_for(sizes(docs)[1], part_bytes, most_parts)), lookahead=True)
    schema = f"doc_id {id_type}, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def compared(one: _Marked, after: _Marked) -> tuple:
        text, chunks = _edited(one, after.text)
        return (
            one.doc_id, len(one.text), text, render(one.chunks), render(chunks),
            likeness(one.chunks, chunks), likeness(one.chunks, after.chunks),
        )

    def packed(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], type=f.type) for j, f in enumerate(arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out, done = None, [], False
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for ahead, doc_id, text in zip(*(part.column(j).to_pylist() for j in range(3)), strict=True):
                    if done:
                        continue  # further rows of the id that is looked ahead to
                    one = _Marked(doc_id, text)
                    if held is not None:
                        out.append(compared(held, one))
                    held, done = one, ahead
                if len(out) >= 250:
                    yield packed(out)
                    out = []
        if out:
            yield packed(out)

    return rows.select("ahead", "doc_id", "text").mapInArrow(run, schema)


def digests(compared: DataFrame) -> DataFrame:
    return compared.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )
