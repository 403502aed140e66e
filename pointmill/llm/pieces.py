"""SentencePiece encoding and decoding with a table of distinct marked words.

Where no piece of the model has a whitespace marker after another character, merges never cross the
place before a run of markers. A text then splits into marked words (markers, then other characters)
that are segmented alone, each distinct one of the whole corpus once:

1. Every task cuts its rows into chunks: the chunk's distinct words, and the texts as places in that list.
2. Chunks send their distinct words to the buckets of the word table; a bucket segments every distinct
   word once and answers each chunk in the order in which it asked. Beyond MOST_BUCKETS chunks (24 GB of text) there are
   several word tables, for lots of as many chunks: messages and buckets then grow no further.
3. The ids come back to the chunk and are joined by position. Chunks are a bucketed table, so the texts
   themselves are never shuffled.

Nulls: a null text is empty; the empty text has no ids and decodes to the empty text. Repeated rows each
get their row; an empty table gives none. A very long text is one chunk, a very long word one entry of
the table. Only the id and the text are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointmill.functions.tables import bucketed
from pointmill.llm import common

MARK = "▁"
#: Text of a chunk.
CHUNK_BYTES = 12 << 20
#: Buckets of a word table. A larger corpus has a word table for each MOST_BUCKETS chunks, so that a chunk sends a bounded
#: number of messages and a bucket gets a bounded number.
MOST_BUCKETS = 2_000
#: Words of the documents that a chunk's answer is made of at a time.
RUN_WORDS = 200_000
_MARKED_WORDS = re.compile(f"[ {MARK}]+[^ {MARK}]*")

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])


def splits_at_markers(model: bytes) -> bool:
    """Whether the model's pieces and settings let marked words be segmented alone."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    crossing = any(MARK in p.lstrip(MARK) for p in pieces)
    # the normaliser must leave text alone but for the marker before it
    probe = "  A ﬁ  b\n "
    return not crossing and sp.decode(sp.encode(probe)) == probe and sp.encode("b", out_type=str)[0].startswith(MARK)


class Segmenter:
    """Segments marked words as they are segmented inside a text."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.lead = self.sp.encode("a")

    def ids(self, words: list[str]) -> list[list[int]]:
        # the library puts one marker before each text: it stands for the word's first one
        out = self.sp.encode([w[1:] for w in words], num_threads=1)
        for k, w in enumerate(words):
            if len(w) == 1:
                out[k] = [self.sp.piece_to_id(MARK)]
        return out

    def decoded(self, ids: list[list[int]]) -> list[str]:
        # decoding strips a leading space only at the start of a text, so decode behind a known lead
        return [t[1:] for t in self.sp.decode([self.lead + i for i in ids], num_threads=1)]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, ids, decoded) of every text, equal to the library's encode() and decode() of the whole text."""
    import sentencepiece  # noqa: F401  fail early where it is missing

    common.small_batches(docs.sparkSession)
    with open(model_path, "rb") as f:
        model = f.read()
    if not splits_at_markers(model):
        raise ValueError("a piece of this model crosses a whitespace marker, or its normaliser changes text")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.whole_text(text_col).alias("text"))
    n_chunks = common.parts_for(common.text_bytes(source), chunk_bytes)
    buckets, lots = min(n_chunks, MOST_BUCKETS), common.parts_for(n_chunks, MOST_BUCKETS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in common.text_runs(batches, chunk_bytes):
            place: dict[str, int] = {}
            tokens, n, texts = [], [], rows.pop("text")
            for k, t in enumerate(texts):
                words = _MARKED_WORDS.findall(" " + t.decode()) if t else []
                tokens.append(np.array([place.setdefault(w, len(place)) for w in words], np.int32))
                n.append(len(words))
                texts[k] = None  # a worker holds a text or its places, not both
            words = [w.encode() for w in place]
            del place
            to = np.array([zlib.crc32(w) % buckets for w in words], np.int64)
            order = np.argsort(to, kind="stable")  # words in the order of their buckets
            rank = np.empty(order.size, np.int32)
            rank[order] = np.arange(order.size, dtype=np.int32)
            tokens = rank[np.concatenate(tokens)] if words else np.empty(0, np.int32)
            yield pa.RecordBatch.from_pydict(
                {
                    "chunk": pa.array([chunk], pa.int64()),
                    "ids": pa.array([rows["doc_id"]], pa.list_(pa.int64())),
                    "n": pa.array([common.squeezed(np.array(n, np.int64))], pa.binary()),
                    "tokens": pa.array([common.squeezed(tokens)], pa.binary()),
                    "words": pa.array([common.squeezed_strings([words[k] for k in order])], pa.binary()),
                    "to": pa.array([common.squeezed(to[order])], pa.binary()),
                }
            )

    chunks = bucketed(source.mapInArrow(cut, "chunk long, ids array<long>, n binary, tokens binary, words binary, to binary"), "chunk", n_chunks, "piece_chunks")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, words, to in zip(*(batch.column(c).to_pylist() for c in ("chunk", "words", "to")), strict=True):
                words = common.loosened_strings(words)
                names, runs = common.runs_of(common.loosened(to))
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk] * len(names), pa.int64()), "bucket": pa.array(names), "words": pa.array([common.squeezed_strings(words[a:b]) for a, b in runs], pa.binary())})

    def segment(key, table):
        """One bucket of the word table: every distinct word's ids, and its decoded text where that isn't the word."""
        common.give_back()
        asked = [common.loosened_strings(x) for x in table["words"].to_pylist()]
        place = {w: k for k, w in enumerate(dict.fromkeys(w for ws in asked for w in ws))}
        words = [w.decode() for w in place]
        tool = Segmenter(model)
        found = tool.ids(words)
        told = [b"" if t == w.replace(MARK, " ") else b"=" + t.encode() for w, t in zip(words, tool.decoded(found), strict=True)]
        n = np.array([len(i) for i in found], np.int64)
        every, start = np.array([i for ids in found for i in ids], np.int64), np.cumsum(n) - n
        mine = [np.array([place[w] for w in ws], np.int64) for ws in asked]
        pack = lambda values: pa.array(values, pa.binary())
        return pa.table(
            {
                "chunk": table["chunk"],
                "bucket": table["bucket"],
                "n": pack([common.squeezed(n[m]) for m in mine]),
                "pieces": pack([common.squeezed(every[common.flat(start[m], n[m])]) for m in mine]),
                "decoded": pack([common.squeezed_strings([told[k] for k in m.tolist()]) for m in mine]),
            }
        )

    asked = chunks.select("chunk", "words", "to").mapInArrow(common.tidy(ask), "chunk long, bucket long, words binary")
    lot = F.pmod(F.xxhash64("chunk"), F.lit(lots).cast("long"))
    answers = asked.groupBy("bucket", *([lot] if lots > 1 else [])).applyInArrow(segment, "chunk long, bucket long, n binary, pieces binary, decoded binary")

    def join_back(key, left, right):
        common.give_back()
        row, order = left.to_pylist()[0], np.argsort(right["bucket"].to_numpy())
        told = lambda c: (right[c][int(k)].as_py() for k in order)
        number = lambda parts: np.concatenate([np.empty(0, np.int32), *(common.loosened(x).astype(np.int32) for x in parts)])
        n, pieces = number(told("n")), number(told("pieces"))
        start = np.cumsum(n, dtype=np.int64) - n
        odd = (x for part in told("decoded") for x in common.loosened_strings(part))
        said = [x[1:].decode() if x else w.decode().replace(MARK, " ") for x, w in zip(odd, common.loosened_strings(row.pop("words")), strict=True)]
        tokens, words_of = common.loosened(row.pop("tokens")).astype(np.int32), common.loosened(row["n"])
        edge = np.append(0, np.cumsum(words_of))
        # documents of RUN_WORDS words at a time, or one: temporary arrays and the batches of the answer stay small
        parts, first = [], 0
        while first < len(row["ids"]):
            last = max(first + 1, int(np.searchsorted(edge, edge[first] + RUN_WORDS, "right")) - 1)
            mine, at = tokens[edge[first] : edge[last]], edge[first : last + 1] - edge[first]
            ids = pieces[common.flat(start[mine], n[mine])]
            size = np.append(0, np.cumsum(n[mine], dtype=np.int64))[at]
            decoded = ["".join([said[k] for k in mine[a:b].tolist()])[1:] for a, b in zip(at[:-1], at[1:], strict=True)]
            parts.append(pa.table({"doc_id": pa.array(row["ids"][first:last], pa.int64()), "ids": common.list_array(np.diff(size), pa.array(ids)), "decoded": pa.array(decoded, pa.string())}))
            first = last
        return pa.concat_tables(parts)

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(join_back, SCHEMA)


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from arrays of ids; null ids are an empty array."""
    common.small_batches(encoded.sparkSession)
    with open(model_path, "rb") as f:
        model = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        for batch in batches:
            texts = sp.decode(batch.column("ids").to_pylist(), num_threads=1) if batch.num_rows else []
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(run, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]))
