"""Token ids as length-delimited binary records with an offset index.

A data file is a run of frames, one for each document, in ascending doc_id:

    8 bytes  length n of the payload        (little-endian, as all numbers)
    4 bytes  masked CRC-32 of those 8 bytes
    n bytes  payload
    4 bytes  masked CRC-32 of the payload
    1 byte   line feed, which ends a frame

    payload: 8 bytes doc_id, 1 byte flags (1: doc_id is null), 1 byte width of an id
    (2 or 4 bytes), 4 bytes number of ids, then the ids

A checksum c is masked as ((c >> 15 | c << 17) + 0xA282EAD8) mod 2^32, so that a
checksum over data that holds checksums is not trivially right. Frames are written by
Spark's own text writer (its line separator is the last byte of a frame), so files
appear only when a task commits, on any store Spark writes to, and a task that is run
again leaves no half file. The index is a Parquet table beside the data with file,
offset and length of each frame.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch_path
from .ordered import MOST_PARTS, by_id, id_cuts, parts_for, sizes

#: Text bytes whose ids go to one file; pieces of text a worker remembers the ids of.
FILE_BYTES, MEMO_PIECES = 24 << 20, 600_000

_HEAD, _PAYLOAD = struct.Struct("<QI"), struct.Struct("<qBBI")


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes) -> bytes:
    """The frame (without its line feed) of ids given as little-endian 32-bit integers."""
    numbers = np.frombuffer(ids, dtype="<u4")
    narrow = len(numbers) == 0 or int(numbers.max()) < 1 << 16
    body = numbers.astype("<u2").tobytes() if narrow else ids
    payload = _PAYLOAD.pack(doc_id or 0, int(doc_id is None), 2 if narrow else 4, len(numbers)) + body
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def frames(data: bytes, verify: bool = True) -> Iterator[tuple[int, int, int | None, int, memoryview, int]]:
    """(offset, length, doc_id, n ids, their bytes, width) of each frame; ValueError on damage."""
    view, at = memoryview(data), 0
    while at < len(data):
        n, check = _HEAD.unpack_from(view, at)
        if masked(bytes(view[at : at + 8])) != check:
            raise ValueError(f"damaged length at byte {at}")
        payload = view[at + 12 : at + 12 + n]
        if verify and masked(payload) != struct.unpack_from("<I", view, at + 12 + n)[0]:
            raise ValueError(f"damaged record at byte {at}")
        doc_id, flags, width, count = _PAYLOAD.unpack_from(payload, 0)
        yield at, n + 17, None if flags & 1 else doc_id, count, payload[_PAYLOAD.size :], width
        at += n + 17


class Encoder:
    """Ids of whole texts by the tokenizers library, as little-endian 32-bit integers.

    White space only separates words in the tokenizer's file, letters and signs are
    separate words, and case doesn't count. So the library is asked once for each word
    of Latin letters and for each other piece between ASCII white space; bounded memos
    hold the rest."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.memo: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}
        # letters that normalisation leaves alone and that have one lower-case letter, and a sign at the end
        self.ends = np.zeros(self.library.get_vocab_size(), dtype=bool)
        for token, i in self.library.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.plain = re.compile("([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f]+)([.,;:!?]?)").fullmatch

    def _ask(self, words: list[str], apart: bool) -> None:
        """Ids of words, or (`apart`) of pieces that may be of several words or none. Words go to
        the library many in one text; where each ends, its ids show."""
        size = 1 if apart else 256
        texts = [words[at : at + size] for at in range(0, len(words), size)]
        for at in range(0, len(texts), 1024):
            got = self.library.encode_batch_fast([" ".join(t) for t in texts[at : at + 1024]], add_special_tokens=False)
            for part, e in zip(texts[at : at + 1024], got, strict=True):
                ids = np.array(e.ids, dtype="<u4")
                if apart:
                    self.words[part[0]] = ids.tobytes()
                    continue
                data, ends = ids.tobytes(), (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
                self.words.update((w, data[a:b]) for w, a, b in zip(part, [0, *ends], ends, strict=False))
                if len(ends) != len(part):
                    raise ValueError("a word without an end")

    def _learn(self, pieces: set[bytes]) -> None:
        parts, one, other = {}, set(), set()
        for piece in pieces:
            text = piece.decode("utf-8", "surrogatepass")
            m = self.plain(text)
            if m:
                word, stop = m[1].lower(), m[2]
                parts[piece] = (word, stop) if stop else (word,)
                one.update(parts[piece])
            else:
                parts[piece] = (text,)
                other.add(text)
        if len(self.words) > MEMO_PIECES:
            self.words.clear()
        words = self.words
        self._ask([w for w in one if w not in words], False)
        self._ask([w for w in other if w not in words], True)
        self.memo.update((p, b"".join(map(words.__getitem__, ws))) for p, ws in parts.items())

    def encode(self, texts: list[str]) -> list[bytes]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if len(self.memo) > MEMO_PIECES:
            self.memo.clear()
        memo = self.memo
        split = [t.encode("utf-8", "surrogatepass").split() for t in texts]
        new = {p for pieces in split for p in pieces if p not in memo}
        if new:
            self._learn(new)
        return [b"".join(map(memo.__getitem__, pieces)) for pieces in split]


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def write(
    docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 1, file_bytes: int = FILE_BYTES, most_parts: int = MOST_PARTS
) -> None:
    """Encode every whole text, append `end_id`, and write the frames under `path`/data,
    then the index under `path`/index.

    Documents are dealt once, by at most `most_parts` ranges of ids, in ascending doc_id
    (null ids first, rows with one id by their text). A range is written to files of about
    `file_bytes` of text each (twice the mean number of documents of that size at most), so
    files stay small however many documents there are. A null text counts as empty and has
    only the end id. Repeated rows are repeated records. An empty table writes no records
    and an empty index. Very long texts are one record each. Other columns are not read.
    """
    spark = docs.sparkSession
    count, total = sizes(docs)
    rows = by_id(docs, id_cuts(docs, parts_for(total, file_bytes, most_parts)))
    per_file = max(1, 2 * count * file_bytes // max(1, total))
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = encoder.encode(part.column(1).to_pylist())
                out = [frame(d, x + end) for d, x in zip(part.column(0).to_pylist(), ids, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(out, type=pa.binary())], names=["frame"])

    framed = rows.select("doc_id", "text").mapInArrow(run, "frame binary")
    framed.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", per_file).text(f"{path}/data")
    _index(spark, path).write.parquet(f"{path}/index")


def _files(spark: SparkSession, path: str) -> DataFrame:
    source = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/data")
    return source.select("path", "content")


def _scan(files: DataFrame, verify: bool, column: str, kind: str, value) -> DataFrame:
    """file, place in it, doc_id, offset, length, before (ids of earlier records of the file), n_tokens and `column`."""
    schema = f"file string, place long, doc_id long, offset long, length long, before long, n_tokens long, {column} {kind}"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, before, out = batch.column(0)[i].as_py().rsplit("/", 1)[-1], 0, []
                for k, (at, length, doc_id, n, body, width) in enumerate(frames(batch.column(1)[i].as_buffer(), verify)):
                    out.append((name, k, doc_id, at, length, before, n, value(body, width)))
                    before += n
                    if len(out) >= 1000:
                        yield _packed(out, arrow)
                        out = []
                if out:
                    yield _packed(out, arrow)

    return files.mapInArrow(run, schema)


def _packed(out: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], type=f.type) for j, f in enumerate(arrow)], schema=arrow)


def _index(spark: SparkSession, path: str) -> DataFrame:
    return _scan(_files(spark, path), False, "width", "int", lambda body, width: width)


def index(spark: SparkSession, path: str) -> DataFrame:
    """file, place, doc_id, offset, length, before, n_tokens, width of every record."""
    return spark.read.parquet(f"{path}/index")


def _wide(body, width: int) -> bytes:
    return bytes(body) if width == 4 else np.frombuffer(body, dtype="<u2").astype("<u4").tobytes()


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, little-endian 32-bit) of every record, checksums
    verified (ValueError on damage). start counts the ids of all records before it; what is added
    up across files is one row a file. Null ids come back as null, empty texts as their end id."""
    found = _scan(_files(spark, path), True, "ids", "binary", _wide)
    return _with_start(spark, path, found, "ids")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record, as `read` gives them; no files, no rows."""
    found = _scan(_files(spark, path), True, "ids_crc32", "long", lambda body, width: zlib.crc32(_wide(body, width)))
    return _with_start(spark, path, found, "ids_crc32")


def _with_start(spark: SparkSession, path: str, found: DataFrame, column: str) -> DataFrame:
    sizes = index(spark, path).groupBy("file").agg(F.sum("n_tokens").alias("n"))
    # a range's files follow each other by number: part-<range>-<run>-c<number of the file>
    place = [F.regexp_extract("file", p, 1).cast("long") for p in ("^part-([0-9]+)", "-c([0-9]+)[^-]*$")]
    before = F.sum("n").over(Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select(F.col("file").alias("at_file"), F.coalesce(before, F.lit(0)).alias("base"))
    joined = found.join(bases, found.file == bases.at_file)
    return joined.select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", column)


def read_shuffled(spark: SparkSession, path: str, seed: int, share: float = 1.0) -> DataFrame:
    """rank, doc_id, ids of a `share` of the records in a pseudo-random order set by `seed`.

    The index chooses and ranks the records; each file is then read once and only the
    chosen frames are taken at their offsets, checksums verified. Repeated documents, null ids and
    empty texts are records like any other; an empty store gives no rows."""
    rank = F.xxhash64("file", "place", F.lit(seed))
    chosen = index(spark, path).select("file", "offset", "length", rank.alias("rank"))
    if share < 1:
        chosen = chosen.where(F.pmod("rank", F.lit(1_000_000)) < int(share * 1_000_000))
    wanted = chosen.groupBy("file").agg(F.collect_list(F.struct("offset", "length", "rank")).alias("wanted"))
    files = _files(spark, path).withColumn("file", F.element_at(F.split("path", "/"), -1)).join(wanted, "file")
    schema = "rank long, doc_id long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data, out = memoryview(batch.column(0)[i].as_buffer()), []
                for w in batch.column(1)[i].as_py():
                    for _, _, doc_id, _, body, width in frames(bytes(data[w["offset"] : w["offset"] + w["length"]])):
                        out.append((w["rank"], doc_id, _wide(body, width)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[j] for x in out], type=t) for j, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["rank", "doc_id", "ids"]
                )

    return files.select("content", "wanted").mapInArrow(run, schema).orderBy("rank")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write `docs` to the shared folder and read the digests back from the files: `write`, then
    `read_digests`, which say what nulls, empty, long and repeated rows and empty tables give."""
    path = scratch_path(docs.sparkSession, "records")
    write(docs, path, tokenizer)
    return read_digests(docs.sparkSession, path)
