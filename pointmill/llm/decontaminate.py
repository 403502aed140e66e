"""Benchmark decontamination by suffix arrays of the training words.

1. Every task cuts its rows into shards and writes for each a suffix array over its words: the training
   index, a table in the shared folder that can be searched again and again.
2. The benchmark goes through in blocks of bounded size. Every suffix of every item of a block is
   binary-searched in every shard, which gives the longest verbatim matches and their places; what a block
   finds is written before the next one is read, so neither driver nor tasks hold more than a block.
3. Places are joined to the index's documents by shard and position, not by id. Removal goes by the
   digest of contaminated texts, as equal texts have equal matches.

Nulls: a null text has no words and matches nothing; a null item id reads as the empty string, an item
without words is ignored. Repeated rows and repeated or null ids each get their own result row, and
removal never takes a clean row along. A very long text is a shard of its own. Empty tables give no rows
(an empty benchmark: no matches). Columns besides the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointmill.functions.tables import written
from pointmill.llm import common, suffixes

#: Words of a window; an item with fewer words is one window.
WINDOW = 10
#: Benchmark text held by a task at a time; a larger benchmark is gone through in blocks of this size.
BENCHMARK_BLOCK = 8 << 20
#: Text of one shard.
SHARD_BYTES = 8 << 20
#: Text whose words are hashed at a time.
RUN_BYTES = 1 << 20

MATCH = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("item_word", T.LongType()), T.StructField("doc_word", T.LongType()), T.StructField("n_words", T.LongType())])
_ARROW_MATCH = pa.struct([("item_id", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("n_words", pa.int64())])
_INDEX = "shard long, ids array<{id}>, digests array<struct<a:long,b:long>>, n_words binary, words binary, tokens binary, suffixes binary"
_HIT = "shard long, position long, matches array<struct<item_id:string,item_word:long,doc_word:long,n_words:long>>"


def digest(text: Column) -> Column:
    """128 bits of a text."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b"))


def index(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The training index: one row for each shard, with its documents' ids and its words' suffix array.

    Suffixes are in order of their first `window` words, equal ones in order of the word before them.
    """
    common.small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), common.whole_text(text_col).alias("text"), digest(common.whole_text(text_col)).alias("digest"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in common.text_runs(batches, shard_bytes):
            arrays = shard_arrays(rows.pop("text"), window)
            yield pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([shard], pa.int64()),
                    "ids": pa.array([rows["doc_id"]]).cast(id_type),
                    "digests": pa.array([rows["digest"]], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
                    **{name: pa.array([x], pa.binary()) for name, x in arrays.items()},
                }
            )

    kind = source.schema["doc_id"].dataType
    id_type = pa.list_({"string": pa.string(), "int": pa.int32()}.get(kind.simpleString(), pa.int64()))
    return written(source.mapInArrow(build, _INDEX.format(id=kind.simpleString())), "shards")


def shard_arrays(texts: list[bytes], window: int) -> dict[str, bytes]:
    """Documents' numbers of words, distinct word hashes, the words as places among these and their suffix array.

    Empties the list: a task holds texts or what was made of them, and words in numbers of 32 bits where these do.
    """
    hashes, n_words = [], []
    texts.reverse()
    while texts:
        run, size = [], 0
        while texts and size < RUN_BYTES:
            run.append(texts.pop().translate(common.WORDS_ONLY))
            size += len(run[-1]) + 1
        found, starts = common.word_hashes(b" ".join(run))
        hashes.append(found)
        n_words.append(np.diff(np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in run]))))
    n_words, hashes = np.concatenate(n_words), np.concatenate(hashes)
    words, place = common.ranked(hashes)
    del hashes
    if place.size + n_words.size < suffixes.NARROW:
        place = place.astype(np.int32)
    out = {"n_words": common.squeezed(n_words), "words": common.packed_sorted(words), "tokens": common.squeezed(place)}
    seq = sequence(place, n_words)
    del words, place
    rank = suffixes.ranks_to_depth(seq, window)
    return out | {"suffixes": common.squeezed(np.lexsort((before(seq), rank)))}


def sequence(place: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """A shard's words as numbers from 1, a 0 before each document."""
    return np.insert(place + 1, np.cumsum(n_words) - n_words, 0)


def before(seq: np.ndarray) -> np.ndarray:
    """The number before each place."""
    out = np.zeros_like(seq)
    out[1:] = seq[:-1]
    return out


class TestSet:
    """The suffixes of one block of benchmark items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        hashed = [(i, common.word_hashes(t.translate(common.WORDS_ONLY))[0]) for i, t in items]
        hashed = [(i, h) for i, h in hashed if h.size]
        self.ids = [i for i, _ in hashed]
        self.length = np.array([h.size for _, h in hashed], np.int64)
        self.vocabulary, self.words = np.unique(np.concatenate([h for _, h in hashed] or [np.empty(0, np.uint64)]), return_inverse=True)
        width = np.minimum(window, self.length)
        n = self.length - width + 1
        first = np.cumsum(self.length) - self.length
        self.item = np.repeat(np.arange(n.size), n)
        self.start = common.flat(first, n)
        self.place = self.start - first[self.item]
        self.width = width[self.item]


def search(row: dict, tests: TestSet) -> list[np.ndarray]:
    """Maximal matches of a shard as (document, item, item word, document word, words) columns."""
    none = [np.empty(0, np.int64)] * 5
    words = common.unpacked_sorted(row["words"])
    if not words.size or not tests.start.size:
        return none
    at = np.minimum(np.searchsorted(words, tests.vocabulary), words.size - 1)
    local = np.where(words[at] == tests.vocabulary, at + 1, -1)[tests.words]  # no shard's sequence has a -1
    missing = np.append(0, np.cumsum(local < 0))
    able = np.flatnonzero(missing[tests.start + tests.width] == missing[tests.start])
    if not able.size:
        return none
    n_words = common.loosened(row["n_words"])
    seq, sa = sequence(common.loosened(row["tokens"]), n_words), common.loosened(row["suffixes"])
    lo, hi = suffixes.search(seq, sa, local, tests.start[able], tests.width[able])
    # a match that the item and the document both go on before is part of a longer one. Only windows of full width have a word
    # before them, and their range is one run of equal windows in order of the word before: a part of it is cut out
    inner = tests.place[able] > 0
    prior = np.where(inner, local[np.maximum(tests.start[able] - 1, 0)], -1)
    left = before(seq)[sa]
    lower, upper = (np.where(inner, cut, lo) for cut in suffixes.bounds_within(left, lo, hi, prior))
    test, pos = [], []
    for a, b in ((lo, lower), (upper, hi)):
        test.append(np.repeat(able, b - a))
        pos.append(sa[common.flat(a, b - a)])
    test, pos = np.concatenate(test), np.concatenate(pos)
    item, item_word = tests.item[test], tests.place[test]
    long, _ = suffixes.compare(seq, pos, local, tests.start[test], tests.length[item] - item_word)
    first = np.cumsum(n_words + 1) - n_words
    doc = np.searchsorted(first, pos, side="right") - 1
    return [doc, item, item_word, pos - first[doc], long]


def hits(shards: DataFrame, benchmark: DataFrame, window: int = WINDOW, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(shard, position, matches) of the documents of an index that have a match, a row for each block of the benchmark."""
    spark = shards.sparkSession
    bench = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.col(item_text_col).alias("t")).where(F.col("t").isNotNull())
    blocks = common.parts_for(common.text_bytes(bench, "t"), BENCHMARK_BLOCK)
    out = None
    for b in range(blocks):
        rows = bench.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()  # about BENCHMARK_BLOCK bytes, whatever the benchmark's size
        block = spark.sparkContext.broadcast(TestSet(sorted((r["i"], r["t"].encode()) for r in rows), window))

        def find(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    doc, item, item_word, doc_word, n = search(row, block.value)
                    order = np.lexsort((item_word, item, doc_word, doc))
                    values = pa.StructArray.from_arrays([pa.array([block.value.ids[i] for i in item[order]], pa.string()), pa.array(item_word[order]), pa.array(doc_word[order]), pa.array(n[order])], fields=list(_ARROW_MATCH))
                    found, size = np.unique(doc, return_counts=True)
                    yield pa.RecordBatch.from_pydict({"shard": pa.array([row["shard"]] * found.size, pa.int64()), "position": pa.array(found), "matches": common.list_array(size, values)})

        found = written(shards.select("shard", "n_words", "words", "tokens", "suffixes").mapInArrow(common.tidy(find), _HIT), "hits")
        block.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def documents_of(shards: DataFrame) -> DataFrame:
    """(shard, position, doc_id, n_words, digest) of every document of an index."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, digests = (batch.column(c).slice(k, 1).flatten() for c in ("ids", "digests"))
                yield pa.RecordBatch.from_pydict({"shard": pa.array([batch.column("shard")[k].as_py()] * len(ids), pa.int64()), "position": pa.array(np.arange(len(ids))), "doc_id": ids, "n_words": pa.array(common.loosened(batch.column("n_words")[k].as_py())), "digest": digests})

    kind = shards.schema["ids"].dataType.elementType.simpleString()
    return shards.select("shard", "ids", "digests", "n_words").mapInArrow(common.tidy(tell), f"shard long, position long, doc_id {kind}, n_words long, digest struct<a:long,b:long>")


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Every document with its number of words and its maximal verbatim matches of at least a window.

    Returns (doc_id, n_words, digest, matches: array of (item_id, item_word, doc_word, n_words)).
    """
    shards = index(docs, window, id_col, text_col)
    found = hits(shards, benchmark, window, item_col, item_text_col)
    found = found.groupBy("shard", "position").agg(F.array_sort(F.flatten(F.collect_list("matches")), lambda x, y: _in_order(x, y)).alias("matches"))
    told = documents_of(shards).join(found, ["shard", "position"], "left")
    return told.select("doc_id", "n_words", "digest", F.coalesce("matches", F.array().cast(T.ArrayType(MATCH))).alias("matches"))


def _in_order(x: Column, y: Column) -> Column:
    """Matches by their place in the document, then by item."""
    key = lambda m: F.struct(m["doc_word"], m["item_id"], m["item_word"])
    return F.when(key(x) < key(y), -1).when(key(x) > key(y), 1).otherwise(0)


def words_hit(matches: Column) -> Column:
    """Words that the matches cover, overlaps once."""
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(m["doc_word"].alias("s"), (m["doc_word"] + m["n_words"]).alias("e"))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(
        spans,
        zero,
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(a["end"], x["s"]))).alias("n"), F.greatest(a["end"], x["e"]).alias("end")),
        lambda a: a["n"],
    )


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """find_matches() with the words hit, the items found and the verdict."""
    found = find_matches(docs, benchmark, window)
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    return found.select("doc_id", "n_words", words_hit(F.col("matches")).alias("n_hit"), items.alias("items"), "matches").withColumn("contaminated", F.col("n_hit") > 0)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without a match, all columns kept."""
    shards = index(docs, window)
    found = hits(shards, benchmark, window).select("shard", "position").distinct()
    bad = documents_of(shards).join(found, ["shard", "position"]).select("digest").distinct()
    return docs.join(bad, digest(common.whole_text()) == bad["digest"], "left_anti")
