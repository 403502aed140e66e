"""Katz backoff scoring: Good-Turing discounted n-grams with exactly normalised backoff weights.

P(w | h) is d(c) c(h, w) / c(h) for an n-gram seen c times, else the backoff weight of h times P(w | h')
with the farthest word of h left off, and so on down to single words, whose left-over goes to one event
for all unknown words. Discounts d are Good-Turing's up to a count of 5, for each order. Each text begins
with marks that are only contexts and ends with one that is a token.

1. Tasks cut their rows into chunks: the distinct words, and the texts as places in that list. Chunks are
   a bucketed table, so texts are never shuffled.
2. The word table: chunks send their distinct words with their training counts to buckets, which give
   every word its total and a number, and answer each chunk in the order in which it asked.
3. The n-gram table, partitioned by the word before the last (the nearest of the context): a bucket holds
   all orders of its n-grams, so that counts of shorter ones are sums of longer ones and backoff weights
   are found by recursion inside the bucket. Chunks ask for their distinct n-grams, of training and other
   texts alike, with their own training counts. Both tables are written to the shared folder.
4. Counts, and the weights of contexts that a chunk saw with an unseen word, go back to the chunk, which
   evaluates the recursion for each token.

A very frequent word is split over buckets by the word that follows; the parts' sums for each context meet
in parts by the context's hash, which tell them to the chunks that need them. All counts are over all
training texts; nothing is pruned. Words are known by 64-bit hashes of their bytes, n-grams by the numbers of their words.

Nulls: a null text is empty (its only token is the end), a null id is held out. Repeated rows count and
are scored each. A very long text is one chunk. Empty tables give no rows; without training texts every
token is the unknown event. Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointmill.functions.tables import bucketed, written
from pointmill.llm import common

#: Longest n-gram; counts up to DISCOUNTED are discounted.
ORDER, DISCOUNTED = 3, 5
#: Text of a chunk, and how many times less a bucket has; occurrences of a word that one bucket takes.
CHUNK_BYTES, BUCKETS_EACH, HOT, BLOCK_BYTES = 8 << 20, 1.5, 800_000, 1 << 20

_U = np.uint64
_END = _U(0x3C2F733E00000001)
#: Numbers of words that training texts lack, and of the mark before a text; other words come after.
UNKNOWN, BEGIN, FIRST = 0, 1, 2


def discounts(n: np.ndarray) -> np.ndarray:
    """d(0..DISCOUNTED) from the numbers of events seen once, twice, ... (index 0: once), Katz's form.

    Where the counts of counts are too few for it (a value outside 0 to 1), half a count is taken off.
    """
    d = np.ones(DISCOUNTED + 1)
    far = (DISCOUNTED + 1) * n[DISCOUNTED] / n[0] if n[0] else 1.0
    for r in range(1, DISCOUNTED + 1):
        x = ((r + 1) * n[r] / (r * n[r - 1]) - far) / (1 - far) if n[r - 1] and far < 1 else -1.0
        d[r] = x if 0 < x < 1 else (r - 0.5) / r
    return d


def discounted(count: np.ndarray, d: np.ndarray) -> np.ndarray:
    return count * d[np.where(count <= DISCOUNTED, count, 0).astype(np.int64)]


class Unigrams:
    """P(w), normalised over the known words and the one unknown event."""

    def __init__(self, n_tokens: float, n: np.ndarray) -> None:
        self.d, self.n = discounts(n), max(n_tokens, 1.0)
        r = np.arange(1, DISCOUNTED + 1)
        left = float(((1 - self.d[1:]) * r * n[:DISCOUNTED]).sum()) if n_tokens else 1.0
        self.scale, self.unknown = (1.0, left / self.n) if left > 0 else (self.n / (self.n + 1), 1 / (self.n + 1))

    def p(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, self.scale * discounted(count, self.d) / self.n, self.unknown)


def backoff(mass: np.ndarray, lower: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Backoff weight of contexts, and whether nothing was discounted in them.

    mass: discounted counts of what follows, lower: its probability in the shorter context, total: its
    count. Where nothing was discounted, one count is set aside: seen events are scaled by
    total / (total + 1). An unseen context has the weight 1.
    """
    total = np.maximum(total, 0.0)
    left = 1 - np.divide(mass, total, out=np.zeros_like(mass), where=total > 0)
    full = (left <= 1e-12) & (total > 0)
    left = np.where(full, 1 / (total + 1), left)
    return np.where(total > 0, left / np.maximum(1 - lower, 1e-300), 1.0), full


def scale_of(full: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.where(full, total / (total + 1), 1.0)


def counts_of_counts(total: np.ndarray) -> list[float]:
    return [float(x) for x in np.bincount(np.minimum(total, DISCOUNTED + 2).astype(np.int64), minlength=DISCOUNTED + 3)[1 : DISCOUNTED + 2]]


def _table(**columns) -> pa.Table:
    kinds = {"chunk": pa.int64(), "bucket": pa.int64(), "kind": pa.int64(), "stats": pa.list_(pa.float64())}
    return pa.table({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in columns.items()})


def _sum_of_stats(table: DataFrame, n: int) -> np.ndarray:
    """Sums of the places of the column `stats`: a few numbers, whatever the table's size."""
    row = table.agg(*[F.coalesce(F.sum(F.element_at("stats", k + 1)), F.lit(0.0)) for k in range(n)]).first()
    return np.array(row, float)


# --- chunks -------------------------------------------------------------------------------------------


def tokenised(docs: DataFrame, held_out: F.Column, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """Chunks of the texts as words by place, in a bucketed table, and how many buckets suit their n-grams."""
    common.small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.whole_text(text_col).alias("text"), held_out.alias("held_out"))
    total = common.text_bytes(source)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in common.text_runs(batches, chunk_bytes):
            parts, lengths, block, size = [], [], [], 0
            for k, t in enumerate(rows["text"]):
                block.append(t.translate(common.INK_ONLY))
                size += len(t)
                if size > BLOCK_BYTES or k == len(rows["text"]) - 1:
                    at = np.cumsum([0] + [len(t) + 1 for t in block])
                    h, starts = common.word_hashes(b" ".join(block))
                    parts.append(h)
                    lengths.append(np.diff(np.searchsorted(starts, at)))
                    block, size = [], 0
            n = np.concatenate(lengths)
            held = np.array(rows["held_out"], bool)
            words, place = common.ranked(np.append(np.concatenate(parts), _END))
            end, place = place[-1], place[:-1]
            count = np.bincount(place[~np.repeat(held, n)], minlength=words.size)
            count[end] += int((~held).sum())
            pack = lambda x: pa.array([x], pa.binary())
            yield pa.RecordBatch.from_pydict(
                {
                    "chunk": pa.array([chunk], pa.int64()),
                    "ids": pa.array([rows["doc_id"]], pa.list_(pa.int64())),
                    "held": pack(common.squeezed(held.astype(np.int64))),
                    "n": pack(common.squeezed(n)),
                    "tokens": pack(common.squeezed(place)),
                    "words": pack(common.packed_sorted(words)),
                    "counts": pack(common.squeezed(count)),
                }
            )

    return bucketed(source.mapInArrow(cut, "chunk long, ids array<long>, held binary, n binary, tokens binary, words binary, counts binary"), "chunk", common.parts_for(total, chunk_bytes), "katz_chunks"), common.parts_for(total, chunk_bytes / BUCKETS_EACH)


class Chunk:
    """A chunk's tokens as numbers of the word table, and its distinct n-grams.

    An n-gram is kept as levels: (v, w), then (v, w, u), ... where w is the last word, v the one before it,
    u the one before that. `gram[k]` is each token's n-gram of order k + 2, by its place among the distinct
    ones, which go by the bucket and then by v, w, u, ...; `parent[k]` leads to the level before.
    """

    def __init__(self, row: dict, answers: list[dict], buckets: int, hot: int, order: int) -> None:
        words = common.unpacked_sorted(row["words"])
        number = lambda c: np.concatenate([common.loosened(a[c]) for a in answers])
        ids, total = number("a"), number("b")
        n = common.loosened(row["n"])
        self.held = common.loosened(row["held"]).astype(bool)
        self.n_tokens = n + 1
        self.first = np.cumsum(self.n_tokens) - self.n_tokens
        end = np.searchsorted(words, _END)
        size = int(self.n_tokens.sum())
        start, inner = np.zeros(size, bool), np.ones(size, bool)
        start[self.first] = True
        inner[self.first + n] = False
        # names: distinct numbers in the chunk, the mark before a text among them
        self.names, of = common.ranked(np.append(ids, BEGIN))
        begin, of = of[-1], of[:-1]
        self.texts = int(total[end])  # of training: as often as a text ends, one begins
        self.name_total = np.zeros(self.names.size, np.int64)
        self.name_total[of] = total
        self.name_total[begin] = self.texts
        self.token = np.full(size, of[end])
        self.token[inner] = of[common.loosened(row["tokens"])]
        back = [self.token]
        for _ in range(order - 1):
            before = np.empty_like(self.token)
            before[1:] = back[-1][:-1]
            before[start] = begin
            back.append(before)
        self.start = start
        w, v = back[0], back[1]
        # a frequent word is split by the word that follows it; places are the parts of all words, by bucket and word
        parts = np.clip(-(-self.name_total // hot), 1, buckets)
        first = np.cumsum(parts) - parts
        words = np.repeat(np.arange(parts.size), parts)
        to = (common.mix64(self.names.astype(_U)) % _U(buckets)).astype(np.int64)
        to = (to[words] + np.arange(words.size) - first[words]) % buckets
        by = np.lexsort((words, to))
        rank = np.empty_like(by)
        rank[by] = np.arange(by.size)
        place = rank[first][v]
        split = np.flatnonzero((parts > 1)[v])
        place[split] = rank[first[v[split]] + self.names[w[split]] % parts[v[split]]]
        bits = self.names.size.bit_length()
        distinct, of = common.ranked(place << bits | w)
        at, self.tail = by[distinct >> bits], distinct & (1 << bits) - 1
        self.bucket, self.head, self.gram, self.key, self.parent = to[at], words[at], [of], [], []
        for u in back[2:]:
            distinct, of = common.ranked(of << bits | u)
            self.parent.append(distinct >> bits)
            self.key.append(distinct & (1 << bits) - 1)
            self.gram.append(of)

    def counts(self) -> np.ndarray:
        """How often training texts have each distinct n-gram of the last level."""
        return np.bincount(self.gram[-1][np.repeat(~self.held, self.n_tokens)], minlength=(self.key or [self.head])[-1].size)

    def buckets_of(self, level: int) -> np.ndarray:
        """The bucket of each distinct n-gram of a level."""
        out = self.bucket
        for parent in self.parent[:level]:
            out = out[parent]
        return out


# --- grams of a bucket ------------------------------------------------------------------------------------


class Grams:
    """Distinct n-grams by levels, from those of all chunks: places in sorted names and how each level goes on in the next.

    `of` leads from the chunks' longest n-grams to the distinct ones.
    """

    def __init__(self, v: np.ndarray, keys: list[np.ndarray], degrees: list[np.ndarray], size: int) -> None:
        bits = size.bit_length()
        code, self.of = common.ranked(v << bits | keys[0])
        self.v, self.keys, self.parents = code >> bits, [code & (1 << bits) - 1], []
        for u, degree in zip(keys[1:], degrees, strict=True):
            code, self.of = common.ranked(np.repeat(self.of, degree) << bits | u)
            self.parents.append(code >> bits)
            self.keys.append(code & (1 << bits) - 1)


def totals_of(count: np.ndarray, keys: list[np.ndarray], parents: list[np.ndarray]) -> list[np.ndarray]:
    """Counts of each level's n-grams from the last one's."""
    out = [count]
    for parent, key in zip(reversed(parents), reversed(keys[:-1]), strict=True):
        out.insert(0, np.bincount(parent, weights=out[0], minlength=key.size).astype(np.int64))
    return out


def contexts(v: np.ndarray, keys: list[np.ndarray], parents: list[np.ndarray], size: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each level the context of its n-grams by place, and the contexts' nearest and farthest words.

    The contexts of a level are the distinct (v), (v, u), ... in ascending order.
    """
    (names, of), bits = common.ranked(v), size.bit_length()
    out = [(of, names, names)]
    for parent, key in zip(parents, keys[1:], strict=True):
        of, near = out[-1][0][parent], out[-1][1]
        code, now = common.ranked(of << bits | key)
        out.append((now, near[code >> bits], code & (1 << bits) - 1))
    return out


@dataclass
class Model:
    """What is known once the n-grams are counted: tokens, distinct words, discounts of all orders."""

    tokens: float
    types: float
    unigrams: Unigrams
    discounts: list[np.ndarray]


def _spread(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


_TABLE_SCHEMA = "bucket long, names binary, totals binary, heads binary, keys array<binary>, parents array<binary>, counts binary, chunks array<long>, asked array<binary>, stats array<double>"
def word_table(chunks: DataFrame, buckets: int, hot: int) -> DataFrame:
    """The word table, by buckets of the words' hashes: totals and numbers, and which of them each chunk asked for."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, words, counts in zip(*(batch.column(c).to_pylist() for c in ("chunk", "words", "counts")), strict=True):
                words, counts = common.unpacked_sorted(words), common.loosened(counts)
                names, runs = common.runs_of(((words >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64))
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk] * len(names), pa.int64()), "bucket": pa.array(names), "words": pa.array([common.packed_sorted(words[a:b]) for a, b in runs], pa.binary()), "counts": pa.array([common.squeezed(counts[a:b]) for a, b in runs], pa.binary())})

    def count(key, table):
        asked = [common.unpacked_sorted(x) for x in table["words"].to_pylist()]
        words, of = common.ranked(np.concatenate(asked))
        total = np.bincount(of, weights=_spread([common.loosened(x) for x in table["counts"].to_pylist()]), minlength=words.size).astype(np.int64)
        # frequent words get small numbers
        rank = np.empty(words.size, np.int64)
        rank[np.lexsort((words, -total))] = np.arange(words.size)
        number = np.where(total > 0, FIRST + rank * buckets + key[0].as_py(), UNKNOWN)
        cut = np.cumsum([0] + [x.size for x in asked])
        mine = [common.squeezed(of[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        stats = [float(total.sum()), float((total > 0).sum()), float((-(-total[total > hot] // hot)).sum()), *counts_of_counts(total)]
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "words": pa.array([common.packed_sorted(words)], pa.binary()), "numbers": pa.array([common.squeezed(number)], pa.binary()), "totals": pa.array([common.squeezed(total)], pa.binary()), "chunks": pa.array([table["chunk"].to_pylist()], pa.list_(pa.int64())), "asked": pa.array([mine], pa.list_(pa.binary())), "stats": pa.array([stats], pa.list_(pa.float64()))})

    sent = chunks.select("chunk", "words", "counts").mapInArrow(ask, "chunk long, bucket long, words binary, counts binary")
    return written(sent.groupBy("bucket").applyInArrow(count, "bucket long, words binary, numbers binary, totals binary, chunks array<long>, asked array<binary>, stats array<double>"), "katz_words")


def word_answers(words: DataFrame) -> DataFrame:
    """Numbers and totals for each chunk, in the order in which it has the words of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                number, total = common.loosened(r["numbers"]), common.loosened(r["totals"])
                mine = [common.loosened(x) for x in r["asked"]]
                n = len(mine)
                yield pa.RecordBatch.from_pydict({"chunk": pa.array(r["chunks"], pa.int64()), "bucket": pa.array([r["bucket"]] * n, pa.int64()), "a": pa.array([common.squeezed(number[m]) for m in mine], pa.binary()), "b": pa.array([common.squeezed(total[m]) for m in mine], pa.binary())})

    return words.drop("words", "stats").mapInArrow(run, "chunk long, bucket long, a binary, b binary")


def gram_table(chunks: DataFrame, told: DataFrame, buckets: int, hot: int, order: int) -> DataFrame:
    """The n-gram table, one row a bucket: the distinct n-grams and counts, and which of them each chunk asked for."""

    def ask(key, left, right):
        c = Chunk(left.to_pylist()[0], sorted(right.to_pylist(), key=lambda r: r["bucket"]), buckets, hot, order)
        levels = order - 1
        at, count = [c.buckets_of(k) for k in range(levels)], c.counts()
        names, runs = common.runs_of(at[0])
        bounds = [runs, *[list(zip(np.searchsorted(at[k], names), np.searchsorted(at[k], names, "right"), strict=True)) for k in range(1, levels)]]
        out = {"chunk": [key[0].as_py()] * len(names), "bucket": names, **{k: [] for k in ("heads", "keys", "totals", "degrees", "counts")}}
        for j in range(len(names)):
            ends = [bounds[k][j] for k in range(levels)]
            (a, b), deeper = ends[0], ends[1:]
            out["heads"].append(common.squeezed(np.diff(c.names[c.head[a:b]], prepend=0)))
            out["keys"].append([common.squeezed(c.names[x]) for x in (c.tail[a:b], *[c.key[k][x:y] for k, (x, y) in enumerate(deeper)])])
            # totals of the distinct words, in order
            out["totals"].append([common.squeezed(c.name_total[common.distinct(x)]) for x in (c.head[a:b], np.sort(c.tail[a:b]))])
            out["degrees"].append([common.squeezed(np.bincount(c.parent[k][x:y] - ends[k][0], minlength=ends[k][1] - ends[k][0])) for k, (x, y) in enumerate(deeper)])
            x, y = ends[-1]
            out["counts"].append(common.squeezed(count[x:y]))
        lists = ("keys", "totals", "degrees")
        return pa.table({k: pa.array(v, pa.int64() if k in ("chunk", "bucket") else pa.list_(pa.binary()) if k in lists else pa.binary()) for k, v in out.items()})

    def count(key, table):
        rows = table.to_pylist()
        columns: list[list] = [[] for _ in range(order)]
        for r in rows:
            for out, x in zip(columns, [np.cumsum(common.loosened(r["heads"])), *map(common.loosened, r["keys"])], strict=True):
                out.append(x)
        names, of = common.ranked(_spread([x for out in columns for x in out]))
        total, at = np.zeros(names.size, np.int64), 0
        for k, out in enumerate(columns):
            for j, x in enumerate(out):
                out[j] = of[at : at + x.size]
                at += x.size
                if k < 2:
                    total[common.distinct(np.sort(out[j]) if k else out[j])] = common.loosened(rows[j]["totals"][k])
        del of
        degrees = [_spread([common.loosened(r["degrees"][k]) for r in rows]) for k in range(order - 2)]
        counts = [common.loosened(r["counts"]) for r in rows]
        v, *keys = map(_spread, columns)
        del columns, out
        grams = Grams(v, keys, degrees, names.size)
        leaf = np.bincount(grams.of, weights=_spread(counts), minlength=grams.keys[-1].size).astype(np.int64)
        cut = np.cumsum([0, *[x.size for x in counts]])
        asked = [common.squeezed(np.diff(grams.of[a:b], prepend=0)) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        stats = [x for t in totals_of(leaf, grams.keys, grams.parents) for x in counts_of_counts(t)]
        one = lambda x: pa.array([x], pa.binary())
        many = lambda x: pa.array([x], pa.list_(pa.binary()))
        return pa.table(
            {
                "bucket": pa.array([key[0].as_py()], pa.int64()),
                "names": one(common.squeezed(np.diff(names, prepend=0))),
                "totals": one(common.squeezed(total)),
                "heads": one(common.squeezed(np.diff(grams.v, prepend=0))),
                "keys": many([common.squeezed(x) for x in grams.keys]),
                "parents": many([common.squeezed(np.diff(x, prepend=0)) for x in grams.parents]),
                "counts": one(common.squeezed(leaf)),
                "chunks": pa.array([[r["chunk"] for r in rows]], pa.list_(pa.int64())),
                "asked": many(asked),
                "stats": pa.array([stats], pa.list_(pa.float64())),
            }
        )

    sent = chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(ask, "chunk long, bucket long, heads binary, keys array<binary>, totals array<binary>, degrees array<binary>, counts binary")
    return written(sent.groupBy("bucket").applyInArrow(count, _TABLE_SCHEMA), "katz_grams")


class Bucket:
    """A row of the n-gram table with all that can be said inside it.

    Of the contexts of split words only the sums of this part are known: their discounted counts, and the
    probabilities in the shorter context without its scale, which all parts share.
    """

    def __init__(self, row: dict, model: Model, hot: int) -> None:
        self.names = np.cumsum(common.loosened(row["names"]))
        total = common.loosened(row["totals"])
        v = np.cumsum(common.loosened(row["heads"]))
        keys = [common.loosened(k) for k in row["keys"]]
        self.parents = [np.cumsum(common.loosened(p)) for p in row["parents"]]
        self.count = totals_of(common.loosened(row["counts"]), keys, self.parents)
        self.context = contexts(v, keys, self.parents, self.names.size)
        p = model.unigrams.p(total[keys[0]])
        self.weight, self.full, self.sums, self.hot = [], [], [], []
        for k, (of, near, _) in enumerate(self.context):
            c = self.count[k]
            seen, cut = c > 0, discounted(c, model.discounts[k])
            n, mass, lower = (np.bincount(of[seen], weights=x[seen], minlength=near.size) for x in (c, cut, p))
            weight, full = backoff(mass, lower, n)
            self.sums.append((n, mass, lower))
            self.weight.append(weight)
            self.full.append(full)
            self.hot.append(total[near] > hot)
            if k < len(self.parents):
                n = np.where(self.hot[k], total[near], n)
                scale = np.where(self.hot[k], 1.0, scale_of(full, n))
                p = ((scale / np.maximum(n, 1))[of] * cut)[self.parents[k]]

    def named(self, level: int, places: np.ndarray) -> np.ndarray:
        """Level and words of contexts, as rows; a single word is its own farthest."""
        _, near, far = self.context[level]
        return np.stack([np.full(places.size, level), self.names[near[places]], self.names[far[places]]], 1)


_ANSWERS = "chunk long, kind long, bucket long, a binary, b binary, c binary"


def _batch(**columns) -> pa.RecordBatch:
    size = max(len(x) for x in columns.values())
    kinds = {name: {"long": pa.int64(), "binary": pa.binary()}[kind] for name, kind in (c.split() for c in _ANSWERS.split(", "))}
    return pa.RecordBatch.from_pydict({k: pa.array(columns[k], t) if k in columns else pa.nulls(size, t) for k, t in kinds.items()})


def _by_part(named: np.ndarray, parts: int) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray]:
    """Parts of contexts by their words' hash, the runs of each and the order that makes them."""
    part = (common.mix64(common.mix64(named[:, 1].astype(_U)) + named[:, 2].astype(_U)) % _U(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return *common.runs_of(part[order]), order


def answered(table: DataFrame, model: Model, hot: int, parts: int) -> DataFrame:
    """What the buckets say to the chunks, written.

    Kind 1: counts of the chunk's n-grams by level; a flag for each of its contexts (1 nothing discounted,
    2 followed by an n-gram without count, 4 of a split word); the weights of those with flag 2 and not 4.
    Kind 2: a part's sums for the contexts of split words. Kind 3: which of these a chunk must know more
    about, as it needs the weight or nothing was discounted in this part. Both are dealt by the context.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in (x for j in range(batch.num_rows) for x in batch.slice(j, 1).to_pylist()):
                b = Bucket(r, model, hot)
                split = [np.flatnonzero(x) for x in b.hot]
                named = np.concatenate([b.named(k, j) for k, j in enumerate(split)])
                if len(named):
                    sums = np.concatenate([np.stack([x[j] for x in b.sums[k]], 1) for k, j in enumerate(split)])
                    names, runs, order = _by_part(named, parts)
                    named, sums = named[order], sums[order]
                    yield _batch(kind=[2] * len(runs), bucket=names, a=[common.squeezed(named[x:y].T.ravel()) for x, y in runs], b=[sums[x:y].astype(float).tobytes() for x, y in runs])
                for chunk, asked in zip(r["chunks"], r["asked"], strict=True):
                    levels, told, ask = [np.cumsum(common.loosened(asked))], {"a": [], "b": [], "c": []}, []
                    for parent in reversed(b.parents):
                        levels.insert(0, common.distinct(parent[levels[0]]))
                    for k, grams in enumerate(levels):
                        mine, place = common.ranked(b.context[k][0][grams])
                        count, is_hot = b.count[k][grams], b.hot[k][mine]
                        need = np.zeros(mine.size, bool)
                        need[place[count == 0]] = True
                        told["a"].append(common.squeezed(count))
                        told["b"].append(common.squeezed((b.full[k][mine] & ~is_hot) + 2 * need + 4 * is_hot))
                        told["c"].append(b.weight[k][mine[need & ~is_hot]].tobytes())
                        ask.append(b.named(k, mine[is_hot & (need | b.full[k][mine])]))
                    yield _batch(chunk=[chunk], kind=[1], bucket=[r["bucket"]], **{name: [_joined(x)] for name, x in told.items()})
                    if len(ask := np.concatenate(ask)):
                        names, runs, order = _by_part(ask, parts)
                        yield _batch(chunk=[chunk] * len(runs), kind=[3] * len(runs), bucket=names, a=[common.squeezed(ask[order[x:y]].T.ravel()) for x, y in runs])

    return written(table.drop("stats").mapInArrow(run, _ANSWERS), "katz_answers")


def split_sums(answers: DataFrame) -> DataFrame:
    """Sums over all parts for the contexts of split words (kind 4), for the chunks that asked."""

    def run(key, table):
        rows = sorted(table.to_pylist(), key=lambda r: (r["kind"], r["chunk"] or 0))
        named = [common.loosened(r["a"]).reshape(3, -1) for r in rows]
        level, near, far = np.concatenate(named, axis=1)
        names, of = common.ranked(np.append(near, far))
        bits = names.size.bit_length()
        code, of = common.ranked((level << bits | of[: near.size]) << bits | of[near.size :])
        told = np.concatenate([np.frombuffer(r["b"]).reshape(-1, 3) for r in rows if r["kind"] == 2])
        sums = np.stack([np.bincount(of[: len(told)], weights=x, minlength=code.size) for x in told.T], 1)
        at = np.cumsum([0] + [x.shape[1] for x in named])
        asks = [(r, of[i:j]) for r, i, j in zip(rows, at[:-1], at[1:], strict=True) if r["kind"] == 3]
        return pa.Table.from_batches([_batch(chunk=[r["chunk"]], kind=[4], bucket=[r["bucket"]], a=[r["a"]], b=[sums[j].tobytes()]) for r, j in asks] or [_batch(chunk=[])])

    return answers.where("kind in (2, 3)").groupBy("bucket").applyInArrow(run, _ANSWERS)


def _joined(parts: list[bytes]) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def _parted(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def evaluated(chunks: DataFrame, told: DataFrame, model: Model, buckets: int, hot: int, order: int) -> DataFrame:
    """The recursion for every token of every chunk, summed by text."""

    def run(key, left, right):
        rows = right.to_pylist()
        of_kind = lambda k: sorted((r for r in rows if r["kind"] == k), key=lambda r: r["bucket"])
        row = left.to_pylist()[0]
        c = Chunk(row, of_kind(0), buckets, hot, order)
        answers = [[_parted(r[x]) for x in "abc"] for r in of_kind(1)]
        split = SplitContexts(of_kind(4), c.names)
        # everything is the same wherever an n-gram stands: worked for each distinct one of a level, from the level before
        bits, p = c.names.size.bit_length(), model.unigrams.p(c.name_total)[c.tail]
        n = c.name_total[c.head].astype(float)
        for k in range(order - 1):
            count = np.concatenate([common.loosened(a[k]) for a, _, _ in answers])
            flags = np.concatenate([common.loosened(b[k]) for _, b, _ in answers])
            if k == 0:
                code, of = common.ranked(c.bucket << bits | c.head)
                near = far = code & (1 << bits) - 1
            else:
                p = p[c.parent[k - 1]]
                code, of = common.ranked(of[c.parent[k - 1]] << bits | c.key[k - 1])
                near, far = far[code >> bits], code & (1 << bits) - 1
            weight, full = np.ones(far.size), flags % 2 == 1
            weight[flags & 6 == 2] = np.concatenate([np.frombuffer(w[k], np.float64) for _, _, w in answers])
            j = np.flatnonzero(flags >= 4)
            told, values = split.whole(k, near[j], far[j])
            weight[j[told]], full[j[told]] = values
            p = np.where(count > 0, scale_of(full[of], n) * discounted(count, model.discounts[k]) / np.maximum(n, 1), weight[of] * p)
            if k < order - 2:
                n = total_before(c, count[c.gram[k]], c.gram[k + 1])
        known = c.name_total > 0
        plain = np.log10((c.name_total + 0.1) / (model.tokens + 0.1 * (model.types + 1)))[c.token]
        score = np.log10(p)[c.gram[-1]]
        by_text = lambda x: np.add.reduceat(x, c.first)
        return pa.table(
            {
                "doc_id": pa.array(row["ids"], pa.int64()),
                "held_out": pa.array(c.held),
                "n_tokens": pa.array(c.n_tokens),
                "n_known": pa.array(by_text(known.astype(np.int64)[c.token])),
                "train_tokens": pa.array(np.full(c.held.size, int(model.tokens), np.int64)),
                "base_score": pa.array(by_text(plain)),
                "score": pa.array(by_text(score)),
            }
        )

    return chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


class SplitContexts:
    """What a chunk was told of contexts of split words: sums over all parts, by level and the places of two words."""

    def __init__(self, rows: list[dict], names: np.ndarray) -> None:
        self.bits = names.size.bit_length()
        level, near, far = np.concatenate([np.empty((3, 0), np.int64), *[common.loosened(r["a"]).reshape(3, -1) for r in rows]], axis=1)
        sums = np.concatenate([np.empty((0, 3)), *[np.frombuffer(r["b"]).reshape(-1, 3) for r in rows]])
        code = self._code(level, np.searchsorted(names, near), np.searchsorted(names, far))
        # several parts may have asked about the same context
        self.code, at = np.unique(code, return_index=True)
        self.sums = sums[at]

    def _code(self, level, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        return (level << self.bits | near) << self.bits | far

    def _found(self, level: int, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sums of contexts, zeros where nothing was told, and whether something was."""
        code = self._code(np.int64(level), near, far)
        at = np.searchsorted(self.code, code)
        told = np.append(self.code, -1)[at] == code
        return np.append(self.sums, np.zeros((1, 3)), axis=0)[np.where(told, at, -1)].T, told

    def whole(self, level: int, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Which of the contexts were told of, and these ones' weights and flags."""
        (n, mass, lower), told = self._found(level, near, far)
        if level:  # the parts left out the scale of the shorter context
            total, cut, shorter = self._found(0, near, near)[0]
            lower = lower * scale_of(backoff(cut, shorter, total)[1], total)
        weight, full = backoff(mass, lower, n)
        return told, (weight[told], full[told])


def total_before(c: Chunk, count: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """The count of each distinct n-gram's context: that of the n-gram which ends before its last token, of all texts at a start.

    count: of the shorter n-gram that ends at each token; gram: the distinct one of each token.
    """
    before = np.empty(count.size)
    before[1:] = count[:-1]
    before[c.start] = c.texts
    out = np.empty(int(gram.max()) + 1)
    out[gram] = before
    return out


def score(docs: DataFrame, folds: int = 10, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, chunk_bytes: int = CHUNK_BYTES, hot: int = HOT) -> DataFrame:
    """Every document with its base score and the model's log10 probability.

    Learns from the documents outside fold 0 of crc32(id); (doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score).
    """
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3: parts of split words only know their contexts of up to two words")
    chunks, buckets = tokenised(docs, common.fold(folds, id_col) == 0, id_col, text_col, chunk_bytes)
    words = word_table(chunks, buckets, hot)
    width = DISCOUNTED + 1
    one = _sum_of_stats(words, 3 + width)
    told = word_answers(words)
    grams = gram_table(chunks, told, buckets, hot, order)
    more = _sum_of_stats(grams, width * (order - 1))
    model = Model(one[0], one[1], Unigrams(one[0], one[3:]), [discounts(more[k * width : (k + 1) * width]) for k in range(order - 1)])
    answers = answered(grams, model, hot, max(1, int(one[2])))
    numbers = told.select("chunk", F.lit(0).cast("long").alias("kind"), "bucket", "a", "b", F.lit(None).cast("binary").alias("c"))
    return evaluated(chunks, numbers.unionByName(answers.where("kind = 1")).unionByName(split_sums(answers)), model, buckets, hot, order)
