"""Helpers shared by the corpus operators."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that a row of a run counts for besides its text, so that empty texts fill runs too.
ROW_BYTES = 64
#: Rows and bytes that one Arrow batch carries into Python: long texts must not pile up in one batch.
BATCH_ROWS, BATCH_BYTES = 400, 16 << 20

U64 = np.uint64


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and the bytes of an Arrow batch, unless the session already asks for fewer.

    Plans read the setting when they run, so it stays set for the session.
    """
    rows, size = (f"spark.sql.execution.arrow.{k}" for k in ("maxRecordsPerBatch", "maxBytesPerBatch"))
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    told = spark.conf.get(size).removesuffix("b")  # Spark writes out the unit
    if told.isdigit() and int(told) > BATCH_BYTES:
        spark.conf.set(size, str(BATCH_BYTES))


def whole_text(name: str = "text") -> Column:
    """The text, a null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def fold(of: int, name: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % F.lit(of)


def sha256_of(values: Column) -> Column:
    """Lowercase hex of an array's values joined by commas."""
    return F.sha2(F.concat_ws(",", values).cast("binary"), 256)


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes of all texts, by one aggregate."""
    return int(docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0)


def parts_for(total: int, each: int, least: int = 1) -> int:
    """How many parts of about `each` make `total`."""
    return max(least, math.ceil(total / each))


# --- packed numbers -------------------------------------------------------


def list_array(lengths, values: pa.Array) -> pa.ListArray:
    """An Arrow list column from row lengths and flat values."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser (in place on a copy)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


#: Lower-cases A-Z byte by byte.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` once A-Z are lower case: 0-9, a-z, all of UTF-8's longer forms.
WORD_BYTES = bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: Maps a text's bytes to lower-case words between blanks.
WORDS_ONLY = bytes((LOWER[b] if LOWER[b] in WORD_BYTES else 32) for b in range(256))
#: Bytes of `[^\x20\x09-\x0D]`.
INK_BYTES = bytes(b for b in range(256) if b not in (32, 9, 10, 11, 12, 13))
#: Maps a text's bytes to lower-case tokens between single kinds of blank.
INK_ONLY = bytes((LOWER[b] if LOWER[b] in INK_BYTES else 32) for b in range(256))

_PRIME = U64(0x9E3779B97F4A7C15)
#: Bytes hashed at a time: each takes some 40 bytes of temporary arrays.
_PIECE = 1 << 20
#: Places of a word whose random numbers are kept in a table.
_TABLED = 64


def powers(n: int) -> np.ndarray:
    """Powers of an odd 64-bit number, modulo 2**64."""
    out = np.empty(max(1, n), U64)
    out[0] = 1
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * U64(pow(0x9E3779B97F4A7C15, have, 1 << 64))
        have += more
    return out


def _drawn(place_and_byte: np.ndarray) -> np.ndarray:
    """A pseudo-random number for each byte value at each place of a word."""
    return mix64(mix64(place_and_byte.astype(U64) + U64(1)) + _PRIME)


_TABLE = _drawn(np.arange(_TABLED << 8))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the blank-separated words of a byte string, and where each starts.

    The words must have been separated by 0x20 (see WORDS_ONLY, INK_ONLY). A word's hash is the mixed sum
    of a random number for each byte at its place (tabulation), so no pattern of bytes collides by rule;
    it doesn't depend on where the word stands. Long strings go in pieces that end before a blank.
    """
    parts, at = [], 0
    while at < len(data) or not parts:
        end = data.find(b" ", at + _PIECE)
        end = len(data) if end < 0 else end
        hashes, starts = _piece_hashes(data[at:end])
        parts.append((hashes, starts + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if len(parts) > 1 else parts[0]


def _piece_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(data, np.uint8)
    if not a.size:
        return np.empty(0, U64), np.empty(0, np.int64)
    ink = a != 32
    edge = np.diff(ink.view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not starts.size:
        return np.empty(0, U64), starts
    lengths = ends - starts
    # offset of each byte in its word, counted from the word's start
    first = np.concatenate([[0], starts])
    place = np.arange(a.size) - np.repeat(first, np.diff(np.append(first, a.size)))
    place <<= 8
    place |= a
    if int(lengths.max()) <= _TABLED:
        value = _TABLE[np.minimum(place, _TABLE.size - 1, out=place)]
    else:
        far = np.flatnonzero((place >= _TABLE.size) & ink)
        more = _drawn(place[far])
        value = _TABLE[np.minimum(place, _TABLE.size - 1, out=place)]
        value[far] = more
    value[~ink] = 0
    return mix64(np.add.reduceat(value, starts) + lengths.astype(U64) * _PRIME), starts


def squeezed(values: np.ndarray) -> bytes:
    """Whole numbers of 0 or more in the fewest bytes of 1 to 8, one byte of all after the other, compressed."""
    import zstandard

    top = int(values.max()) if values.size else 0
    width = max(1, (top.bit_length() + 7) // 8)
    held = 4 if width <= 4 else 8
    planes = np.ascontiguousarray(values.astype(f"<u{held}").view(np.uint8).reshape(-1, held)[:, :width].T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def loosened(data: bytes) -> np.ndarray:
    """The numbers of squeezed()."""
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<i8").ravel()


def squeezed_strings(values: list[bytes]) -> bytes:
    """Byte strings with their lengths, compressed."""
    import zstandard

    sizes = squeezed(np.array([len(v) for v in values], np.int64))
    return len(sizes).to_bytes(4, "little") + sizes + zstandard.ZstdCompressor(level=3).compress(b"".join(values))


def loosened_strings(data: bytes) -> list[bytes]:
    import zstandard

    n = 4 + int.from_bytes(data[:4], "little")
    at = np.cumsum(np.append(0, loosened(data[4:n]))).tolist()
    whole = zstandard.ZstdDecompressor().decompress(data[n:])
    return [whole[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def give_back() -> None:
    """Return what Arrow's pool has kept of freed batches: a worker lives on, and tens of megabytes with it."""
    pa.default_memory_pool().release_unused()


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives memory back at its task's end."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


def text_runs(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, dict[str, list]]]:
    """The rows of a task in runs of about `limit` bytes (the column `text`, as bytes, and ROW_BYTES for each row), each with an
    id of its own: the partition's number and the run's. Only for tables that are written at once, as a run
    depends on the order in which its task reads."""
    from pyspark import TaskContext

    base, k, size, held = TaskContext.get().partitionId() << 32, 0, 0, None
    for batch in batches:
        columns = {n: (batch.column(n).cast(pa.binary()) if n == "text" else batch.column(n)).to_pylist() for n in batch.schema.names}
        begin = 0
        for j, text in enumerate(columns["text"]):
            size += len(text) + ROW_BYTES
            if size > limit:
                held = {n: [*(held[n] if held else ()), *c[begin : j + 1]] for n, c in columns.items()}
                give_back()
                yield base + k, held
                begin, k, size, held = j + 1, k + 1, 0, None
        held = {n: [*(held[n] if held else ()), *c[begin:]] for n, c in columns.items()}
    if held and held["text"]:
        give_back()
        yield base + k, held
    give_back()


def runs_of(values: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Distinct values of a sorted array and where each one's run begins and ends."""
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if values.size else np.empty(0, np.int64)
    at = np.append(first, values.size)
    return values[first], list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


def firsts(values: np.ndarray) -> np.ndarray:
    """Where the runs of a sorted array begin, as a mask."""
    out = np.ones(values.size, bool)
    np.not_equal(values[1:], values[:-1], out=out[1:])
    return out


def distinct(values: np.ndarray) -> np.ndarray:
    """Distinct values of a sorted array."""
    return values[firsts(values)]


def ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique(values, return_inverse=True) of 64-bit whole numbers of 0 or more, in a third of its time.

    Plain numbers sort several times faster than places by their numbers, so each place stands in the low
    bits of its value. Where the values leave too few bits free, their own low bits go; if two values differ
    in these only, the order shows it, and np.unique has its turn. Sorted values are only cut where they change.
    """
    if not (values[1:] < values[:-1]).any():
        first = firsts(values)
        rank = np.cumsum(first)
        rank -= 1
        return values[first], rank
    bits = values.size.bit_length()
    lost = max(0, int(values.max()).bit_length() + bits - 64)
    code = values.view(U64) >> U64(lost)
    code <<= U64(bits)
    code |= np.arange(values.size, dtype=U64)
    code.sort()
    place = (code & U64((1 << bits) - 1)).view(np.int64)
    if lost:
        ordered = values[place]
        if (ordered[1:] < ordered[:-1]).any():
            return np.unique(values, return_inverse=True)
    else:
        code >>= U64(bits)
        ordered = code.view(values.dtype)
    first = firsts(ordered)
    out, rank = ordered[first], np.empty(values.size, np.int64)
    ranks = np.cumsum(first, out=code.view(np.int64))
    ranks -= 1
    rank[place] = ranks
    return out, rank


def flat(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of the given runs, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if ends.size else 0) + np.repeat(starts - (ends - lengths), lengths)


def packed_sorted(values: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as differences, byte by byte of all: the high bytes are then runs of zeros."""
    return np.diff(values, prepend=U64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(U64).ravel(), dtype=U64)


def zipped(docs: DataFrame) -> DataFrame:
    """The frame with its column `text` as a compressed binary column `zip`, for texts that are shuffled whole."""
    small_batches(docs.sparkSession)

    def run(batches):
        import zstandard

        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            kept = {n: batch.column(n) for n in batch.schema.names if n != "text"}
            yield pa.RecordBatch.from_pydict(kept | {"zip": pa.array([z.compress(t) for t in batch.column("text").cast(pa.binary()).to_pylist()], pa.binary())})

    schema = T.StructType([f for f in docs.schema.fields if f.name != "text"]).add("zip", T.BinaryType())
    return docs.mapInArrow(run, schema)


def unzipped(column: pa.ChunkedArray) -> list[bytes]:
    import zstandard

    z = zstandard.ZstdDecompressor()
    return [z.decompress(b) for b in column.to_pylist()]
