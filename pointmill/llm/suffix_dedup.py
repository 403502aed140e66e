"""Removal of repeated passages by suffix arrays.

A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller id.

1. Documents are dealt to chunks. Every window of `length` bytes has an anchor, the least hash among
   its byte k-grams; windows in a row with one anchor form a segment. A window's anchor depends on its
   bytes alone, so equal windows have equal anchors. Chunks send their distinct anchors to buckets, which
   answer how often each occurs. Segments whose anchor occurs once cannot hold a repeat.
2. Chunks send their other distinct segments, with the least id that has each, to the shard of the
   anchor. A shard sorts one suffix array over its distinct segments by Larsson-Sadakane refinement;
   neighbours whose Kasai prefix is `length` long have the same window, and its least id is known.
3. The segments of a frequent anchor are split over many shards. Those send their sorted windows to merge
   tasks, which look every shard's windows up in the others' by binary search on their bytes.
4. Chunks get a bit for each window of each segment back and mark the bytes.

Hashes only choose where bytes go: what counts as equal has equal bytes. Only distinct anchors and
segments of a chunk travel, so copies and common passages are summed up before any shuffle. Nulls: a null
text is empty, a null id comes after all others; rows of equal id don't remove each other's bytes, and
rows that are equal altogether are spread over chunks as far as they come from different partitions. A
very long text stays in one chunk and is hashed in blocks. Empty tables give no rows. Only the id and
the text are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointmill.llm import common, suffixes

LENGTH = 50
#: Bytes of an anchor's k-gram; a window has LENGTH - GRAM + 1 of them, which must fit the 32 bits of a mask.
GRAM = 20
#: Text of a chunk; bytes hashed at a time; occurrences of an anchor that one shard takes.
CHUNK_BYTES, BLOCK_BYTES, HOT = 4 << 20, 1 << 18, 20_000
#: Shards of segments for each chunk of documents: small ones even out.
SHARDS_EACH = 3
LAST_ID = (1 << 63) - 1

_U = np.uint64
_PLACE = 31  # bits of a place in a block: no text is longer
_P = 0x9E3779B97F4A7C15


def gram_hashes(a: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all byte strings of `width`, by doubling."""
    have, h = 1, a.astype(_U) + _U(1)
    parts, need, total = {1: h}, width, None
    while have * 2 <= width:
        h = h[: h.size - have] + h[have:] * _U(pow(_P, have, 1 << 64))
        have *= 2
        parts[have] = h
    at = 0
    n = a.size - width + 1
    for size in sorted(parts, reverse=True):
        if need >= size:
            piece = parts[size][at : at + n] * _U(pow(_P, at, 1 << 64))
            total = piece if total is None else total + piece
            at, need = at + size, need - size
    return common.mix64(total)


def sliding_least(key: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` keys in a row."""
    have, m = 1, key
    while have * 2 <= width:
        m = np.minimum(m[: m.size - have], m[have:])
        have *= 2
    if have < width:
        m = np.minimum(m[: m.size - (width - have)], m[width - have :])
    return m


class Runs:
    """The segments of a chunk: document, place of the first window, windows, anchor's hash and offset."""

    def __init__(self, texts: list[bytes], length: int, gram: int) -> None:
        self.texts = texts
        doc, start, count, anchor, offset = [], [], [], [], []
        begin, size = 0, 0
        for k in range(len(texts) + 1):
            if k == len(texts) or (size and size + len(texts[k]) > BLOCK_BYTES):
                for out, x in zip((doc, start, count, anchor, offset), self._block(begin, k, length, gram), strict=True):
                    out.append(x)
                begin, size = k, 0
            if k < len(texts):
                size += len(texts[k])
        self.doc, self.start, self.count, self.offset = (np.concatenate(x).astype(np.int64) for x in (doc, start, count, offset))
        self.anchor = np.concatenate(anchor)

    def _block(self, low: int, high: int, length: int, gram: int):
        none = (np.empty(0, np.int64),) * 3 + (np.empty(0, _U), np.empty(0, np.int64))
        sizes = np.array([len(t) for t in self.texts[low:high]], np.int64)
        if not (sizes >= length).any():
            return none
        a = np.frombuffer(b"".join(self.texts[low:high]), np.uint8)
        h = gram_hashes(a, gram)
        key = (h & ~_U((1 << _PLACE) - 1)) | np.arange(h.size, dtype=_U)
        chosen = (sliding_least(key, length - gram + 1) & _U((1 << _PLACE) - 1)).astype(np.int64)
        base = np.cumsum(sizes) - sizes
        windows = np.maximum(sizes - length + 1, 0)
        doc = np.repeat(np.arange(sizes.size), windows)
        place = np.arange(doc.size) - np.repeat(np.cumsum(windows) - windows, windows) + base[doc]
        chosen = chosen[place]
        edge = np.ones(doc.size, bool)
        edge[1:] = (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(edge)
        count = np.diff(np.append(first, doc.size))
        at = chosen[first]
        return doc[first] + low, place[first] - base[doc[first]], count, h[at], at - place[first]


def run_hashes(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte runs that lie one after the other."""
    if not lengths.size:
        return np.empty(0, _U)
    starts = np.cumsum(lengths) - lengths
    p = common.powers(int(lengths.max()) + 1)
    value = (data.astype(_U) + _U(1)) * p[np.arange(data.size) - np.repeat(starts, lengths)]
    return common.mix64(np.add.reduceat(value, starts) + lengths.astype(_U))


def same_bytes(data: np.ndarray, starts: np.ndarray, size: np.ndarray, digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each set of equal byte runs, and the set of each run.

    Runs are brought together by digest and compared byte by byte.
    """
    _, lead, of = np.unique(digest, return_index=True, return_inverse=True)
    if (size != size[lead][of]).any() or (data[common.flat(starts, size)] != data[common.flat(starts[lead][of], size)]).any():
        # different runs of one digest
        place: dict[bytes, int] = {}
        of = np.array([place.setdefault(data[s : s + n].tobytes(), len(place)) for s, n in zip(starts.tolist(), size.tolist(), strict=True)])
        lead = np.unique(of, return_index=True)[1]
    return lead, of


class Chunk:
    """A chunk's documents and, with the answers of the buckets, its distinct segments."""

    def __init__(self, table: pa.Table, length: int, gram: int) -> None:
        ids = table.column("doc_id").to_pylist()
        texts = table.column("text").cast(pa.binary()).to_pylist()
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0, texts[k]))
        self.ids = [ids[k] for k in order]
        self.texts = [texts[k] for k in order]
        self.key = np.array([LAST_ID if i is None else i for i in self.ids], np.int64)
        self.length = length
        self.runs = Runs(self.texts, length, gram)
        self.anchors, self.anchor_of, self.seen = np.unique(self.runs.anchor, return_inverse=True, return_counts=True)

    def buckets(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The anchors in the order of their buckets, and these. Anchors are least hashes, so they are hashed again."""
        bucket = (common.mix64(self.anchors) % _U(n)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        return order, bucket[order]

    def distinct(self, told: np.ndarray, shards: int) -> dict:
        """Distinct segments of the anchors that may repeat, in order of their destination; told: the buckets' codes."""
        r = self.runs
        codes = np.empty(self.anchors.size, np.uint8)
        codes[self.buckets(shards)[0]] = told
        code = codes[self.anchor_of]
        pick = np.flatnonzero(code > 0)
        base = np.cumsum([0] + [len(t) for t in self.texts])
        size = r.count[pick] + self.length - 1
        whole = np.frombuffer(b"".join(self.texts), np.uint8)
        data = whole[common.flat(base[r.doc[pick]] + r.start[pick], size)]
        digest = run_hashes(data, size)
        salt = digest & ((_U(1) << (code[pick] - 1).astype(_U)) - _U(1))
        hot = code[pick] > 1
        shard = (common.mix64(r.anchor[pick] + salt * _U(_P)) % _U(shards)).astype(np.int64)
        starts = np.cumsum(size) - size
        _, equal = same_bytes(data, starts, size, digest)
        # equal segments have one shard, but for those of two anchors
        order = np.lexsort((self.key[r.doc[pick]], equal, shard, hot))
        d, h, s = equal[order], hot[order], shard[order]
        fresh = np.ones(order.size, bool)
        fresh[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1]) | (s[1:] != s[:-1])
        index = np.empty(order.size, np.int64)
        index[order] = np.cumsum(fresh) - 1
        lead = order[fresh]  # the least document's occurrence of each
        return {"pick": pick, "index": index, "hot": hot[lead], "shard": shard[lead], "size": size[lead], "offset": r.offset[pick][lead], "least": self.key[r.doc[pick]][lead], "data": data[common.flat(starts[lead], size[lead])]}


class Segments:
    """The distinct segments of a shard: bytes, and the least id that has each."""

    def __init__(self, table: pa.Table, length: int, gram: int) -> None:
        self.length = length
        self.rows = sorted(range(table.num_rows), key=lambda k: (table["chunk"][k].as_py(),))
        get = lambda c, t: np.concatenate([np.frombuffer(table[c][k].as_py(), t) for k in self.rows])
        self.chunks = [table["chunk"][k].as_py() for k in self.rows]
        size, offset = get("size", np.uint8).astype(np.int64), get("offset", np.uint8).astype(np.int64)
        self.entry_least = get("least", np.int64)
        self.entries = [len(table["size"][k].as_py()) for k in self.rows]
        data = get("data", np.uint8)
        starts = np.cumsum(size) - size
        lead, self.entry_of = same_bytes(data, starts, size, run_hashes(data, size))
        self.size, starts = size[lead], starts[lead]
        self.data = data[common.flat(starts, self.size)]
        self.least = np.full(lead.size, LAST_ID, np.int64)
        np.minimum.at(self.least, self.entry_of, self.entry_least)
        self.windows = self.size - length + 1
        self.start = np.cumsum(self.size) - self.size
        grams = common.flat(self.start + offset[lead], np.full(lead.size, gram))
        self.anchor = run_hashes(self.data[grams], np.full(lead.size, gram))

    def least_of_windows(self) -> np.ndarray:
        """For every window of every distinct segment, the least id in this shard, by a suffix array."""
        out = np.repeat(self.least, self.windows)
        _, of, n = np.unique(self.anchor, return_inverse=True, return_counts=True)
        some = n[of] > 1  # a segment that shares its anchor with no other one has no window in another
        if not some.any():
            return out
        text = self.data[common.flat(self.start[some], self.size[some])]
        begins = np.cumsum(self.size[some]) - self.size[some]
        windows = common.flat(begins, self.windows[some])
        sa = suffixes.sorted_suffixes(text)
        lcp = suffixes.kasai(text, sa, self.length)
        group = np.flatnonzero(lcp < self.length)
        # places that are no window, as they cross into the next segment, count for nothing
        least = np.full(text.size, LAST_ID, np.int64)
        least[windows] = np.repeat(self.least[some], self.windows[some])
        low = np.empty(text.size, np.int64)
        low[sa] = np.repeat(np.minimum.reduceat(least[sa], group), np.diff(np.append(group, sa.size)))
        found = low[windows]
        out[np.repeat(some, self.windows)] = found
        return out

    def answers(self, least: np.ndarray) -> tuple[list[int], list[bytes]]:
        """For each chunk, a mask for each of its segments: windows that a smaller id has."""
        first = np.cumsum(self.windows) - self.windows
        n = self.windows[self.entry_of]
        bit = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        smaller = least[common.flat(first[self.entry_of], n)] < np.repeat(self.entry_least, n)
        mask = np.bitwise_or.reduceat(smaller.astype(np.uint32) << bit.astype(np.uint32), np.cumsum(n) - n)
        cut = np.cumsum([0, *self.entries])
        return self.chunks, [mask[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def distinct_windows(self, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct windows in the order of their parts and bytes, each one's part and a place where it is,
        and the distinct one of every window."""
        every = common.flat(self.start, self.windows)
        whole = np.lib.stride_tricks.sliding_window_view(self.data, self.length)[every]
        names, lead, of = np.unique(np.ascontiguousarray(whole).view(f"S{self.length}").ravel(), return_index=True, return_inverse=True)
        part = ((gram_hashes(self.data, self.length)[every[lead]] >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        rank = np.empty(order.size, np.int64)
        rank[order] = np.arange(order.size)
        return names[order], part[order], lead[order], rank[of]


def _rows(**columns) -> pa.Table:
    kinds = {"chunk": pa.int64(), "bucket": pa.int64(), "shard": pa.int64(), "part": pa.int64(), "hot": pa.bool_()}
    return pa.table({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in columns.items()})


def find_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, spans: array of (start, end) to remove, kept: the other bytes) of every document."""
    if length - gram + 1 > 32 or gram < 8:
        raise ValueError("the k-gram must have 8 bytes or more and leave at most 32 of them in a window")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.whole_text(text_col).alias("text"))
    chunks = common.parts_for(common.text_bytes(source), chunk_bytes)
    shards = SHARDS_EACH * chunks
    # one exchange of the texts serves the three passes over the chunks; the partition's number keeps equal rows apart
    base = source.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.octet_length("text"), F.spark_partition_id()), F.lit(chunks).cast("long")))

    def send_anchors(key, table):
        c = Chunk(table, length, gram)
        order, bucket = c.buckets(shards)
        names, cut = common.runs_of(bucket)
        anchors, seen = c.anchors[order], np.minimum(c.seen[order], 65535).astype(np.uint16)
        return _rows(chunk=[key[0].as_py()] * len(names), bucket=names, keys=[anchors[a:b].tobytes() for a, b in cut], seen=[seen[a:b].tobytes() for a, b in cut])

    def count_anchors(key, table):
        keys = [np.frombuffer(x, _U) for x in table["keys"].to_pylist()]
        seen = [np.frombuffer(x, np.uint16) for x in table["seen"].to_pylist()]
        _, of = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(of, weights=np.concatenate(seen))
        code = np.where(total < 2, 0, 1 + np.ceil(np.log2(np.maximum(total / hot, 1)))).astype(np.uint8)[of]
        cut = np.cumsum([0] + [k.size for k in keys])
        return _rows(chunk=table["chunk"].to_pylist(), hot=[None] * len(keys), shard=table["bucket"].to_pylist(), data=[code[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)])

    answer = "chunk long, hot boolean, shard long, data binary"
    codes = base.groupBy("chunk").applyInArrow(send_anchors, "chunk long, bucket long, keys binary, seen binary").groupBy("bucket").applyInArrow(count_anchors, answer)

    def joined(table: pa.Table, kind) -> np.ndarray:
        """The answers of a kind, in the order in which they were asked for."""
        told = [(h or False, s, d) for h, s, d in zip(table["hot"].to_pylist(), table["shard"].to_pylist(), table["data"].to_pylist(), strict=True) if (h is None) == (kind == "code")]
        return np.frombuffer(b"".join(d for *_, d in sorted(told, key=lambda x: x[:2])), np.uint8 if kind == "code" else np.uint32)

    def send_segments(key, left, right):
        s = Chunk(left, length, gram).distinct(joined(right, "code"), shards)
        at = s["hot"].astype(np.int64) * shards + s["shard"]
        names, cut = common.runs_of(at)
        bytes_at = np.concatenate([[0], np.cumsum(s["size"])])
        small = lambda name, t: [s[name][a:b].astype(t).tobytes() for a, b in cut]
        return _rows(chunk=[key[0].as_py()] * len(names), shard=names, size=small("size", np.uint8), offset=small("offset", np.uint8), least=small("least", np.int64), data=[s["data"][bytes_at[a] : bytes_at[b]].tobytes() for a, b in cut])

    sent = base.groupBy("chunk").cogroup(codes.groupBy("chunk")).applyInArrow(send_segments, "chunk long, shard long, size binary, offset binary, least binary, data binary")

    # shards of frequent anchors have numbers of their own, so that all readers share one exchange
    nothing = {"answer": _rows(chunk=[], hot=[], shard=[], data=[]), "windows": _rows(shard=[], part=[], keys=[], least=[])}

    def answer_shard(key, table):
        if key[0].as_py() >= shards:
            return nothing["answer"]
        s = Segments(table, length, gram)
        names, masks = s.answers(s.least_of_windows())
        return _rows(chunk=names, hot=[False] * len(names), shard=[key[0].as_py()] * len(names), data=masks)

    answers = sent.groupBy("shard").applyInArrow(answer_shard, answer)

    # frequent anchors: their shards merge by ranges of the windows
    def cut_windows(key, table):
        if key[0].as_py() < shards:
            return nothing["windows"]
        s = Segments(table, length, gram)
        names, part, lead, _ = s.distinct_windows(chunks)
        least = s.least_of_windows()[lead]  # equal windows have equal least ids already
        found, cut = common.runs_of(part)
        return _rows(shard=[key[0].as_py()] * len(found), part=found, keys=[zlib.compress(names[a:b].tobytes(), 1) for a, b in cut], least=[least[a:b].tobytes() for a, b in cut])

    def merge_ranges(key, table):
        """The least id of each window over all shards: each shard's sorted windows are looked up by binary search."""
        keys = [np.frombuffer(zlib.decompress(x), f"S{length}") for x in table["keys"].to_pylist()]
        least = [np.frombuffer(x, np.int64) for x in table["least"].to_pylist()]
        union = np.unique(np.concatenate(keys))
        low = np.full(union.size, LAST_ID, np.int64)
        places = [np.searchsorted(union, k) for k in keys]
        for p, m in zip(places, least, strict=True):
            low[p] = np.minimum(low[p], m)
        return _rows(shard=table["shard"].to_pylist(), part=[key[0].as_py()] * len(keys), keys=[None] * len(keys), least=[low[p].tobytes() for p in places])

    def answer_merged(key, left, right):
        if key[0].as_py() < shards:
            return nothing["answer"]
        s = Segments(left, length, gram)
        *_, of = s.distinct_windows(chunks)
        least = np.concatenate([np.frombuffer(right["least"][int(k)].as_py(), np.int64) for k in np.argsort(right["part"].to_numpy())])
        names, masks = s.answers(least[of])
        return _rows(chunk=names, hot=[True] * len(names), shard=[key[0].as_py()] * len(names), data=masks)

    window_rows = "shard long, part long, keys binary, least binary"
    merged = sent.groupBy("shard").applyInArrow(cut_windows, window_rows).groupBy("part").applyInArrow(merge_ranges, window_rows)
    answers = answers.unionByName(sent.groupBy("shard").cogroup(merged.groupBy("shard")).applyInArrow(answer_merged, answer))

    def mark(key, left, right):
        c = Chunk(left, length, gram)
        s, r = c.distinct(joined(right, "code"), shards), c.runs
        pick, index = s["pick"], s["index"]
        # asked for by hot, then shard: the order of the distinct segments
        mask = joined(right, "mask")[index].astype(_U)
        every = (_U(1) << r.count[pick].astype(_U)) - _U(1)
        mask = np.where(c.key[r.doc[pick]] > s["least"][index], every, mask)
        some = np.flatnonzero(mask)
        size = np.array([len(t) for t in c.texts], np.int64)
        base = np.cumsum(size + 1) - size - 1  # one free place after each document
        n = r.count[pick][some]
        run = np.repeat(some, n)
        bit = np.arange(run.size) - np.repeat(np.cumsum(n) - n, n)
        out = (mask[run] >> bit.astype(_U)) & _U(1) == 1
        at = (base[r.doc[pick]] + r.start[pick])[run[out]] + bit[out]
        total = int(size.sum() + size.size)
        change = np.bincount(at, minlength=total + 1) - np.bincount(at + length, minlength=total + 1)
        gone = np.cumsum(change)[:total] > 0
        edge = np.diff(gone.view(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        doc = np.searchsorted(base, starts, side="right") - 1
        spans = pa.StructArray.from_arrays([pa.array(starts - base[doc]), pa.array(ends - base[doc])], names=["start", "end"])
        kept = [np.frombuffer(t, np.uint8)[~gone[b : b + len(t)]].tobytes() if gone[b : b + len(t)].any() else t for t, b in zip(c.texts, base, strict=True)]
        lists = common.list_array(np.bincount(doc, minlength=size.size), spans)
        return pa.table({"doc_id": pa.array(c.ids, pa.int64()), "n_bytes": pa.array(size), "spans": lists, "kept": pa.array(kept, pa.binary())})

    told = codes.unionByName(answers)
    return base.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(mark, "doc_id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary")
