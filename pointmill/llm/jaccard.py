"""Jaccard join on word n-grams: MinHash bands find candidates, full n-gram sets decide.

1. Every text becomes its set of n-gram hashes, a digest of the set, and band hashes of MinHash rows.
   Texts of equal sets are one node with a count, so copies never meet each other.
2. Nodes are shuffled on band hashes. Buckets with the same members count once. Inside a bucket, nodes
   join the leaders that their signatures resemble; only a forest of these links leaves the bucket. Two sets of
   the wanted similarity always end up under one leader, so components of the links lose no pair
   that shares a bucket. Large buckets are split by a salt, and the leaders of the parts compared.
3. Each component's full sets are compared exactly, in blocks when it is large, which counts every
   node's links; a spanning forest of the links gives the classes.

Nulls: a null text has no words. Texts without words are alone in their class and have no links; shorter
ones than an n-gram have one n-gram, the whole text. Rows go by (id, digest of the text), null ids last, so
rows that repeat an id are documents of their own and equal rows are copies. A class whose rows all lack
an id is named null. An empty table gives no rows. Only the id and the text are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointmill.functions.graph import connected_components, forest
from pointmill.functions.tables import written
from pointmill.llm import common

WORDS, SIMILARITY, RECALL, ROWS = 5, 0.8, 0.999, 6
#: Signature similarity that joins a node to a leader, and that makes it no leader itself.
JOIN_LEADER, SAME_AS_LEADER, LINK_LEADERS = 0.4, 0.8, 0.2
#: Members of a bucket in one part; rows in one group of buckets; nodes in one block of a component.
BUCKET_PART, GROUP_ROWS, BLOCK = 500, 500, 400
#: Parts of the rows of one node when they learn their class.
SALTS = 16
_P = [pow(0x9E3779B97F4A7C15, 2 * k + 3, 1 << 64) for k in range(64)]


def bands_for(similarity: float, recall: float, rows: int) -> int:
    """Bands of `rows` rows with which a pair at the similarity shares a band with probability `recall`."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word n-grams."""
    data = [t.translate(common.WORDS_ONLY) for t in texts]
    at = np.cumsum([0] + [len(t) + 1 for t in data])
    h, starts = common.word_hashes(b" ".join(data))
    first = np.searchsorted(starts, at)
    grams = np.zeros(max(0, h.size - n + 1), np.uint64)
    for k in range(n):
        grams += h[k : k + grams.size] * np.uint64(_P[k])
    grams = common.mix64(grams)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            short = sum(int(h[a + k]) * _P[k] for k in range(b - a)) + int(b - a)
            out.append(common.mix64(np.array([short % (1 << 64)], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def node_of(grams: np.ndarray) -> int:
    """A 64-bit id of the set."""
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def multipliers(n: int, seed: int = 1) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """MinHash values, one row a set (sets must not be empty)."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [s.size for s in sets[:-1]])
    out = np.empty((len(sets), n), np.uint64)
    buffer = np.empty_like(flat)
    for k, m in enumerate(multipliers(n)):
        np.multiply(flat, m, out=buffer)
        out[:, k] = np.minimum.reduceat(buffer, starts)
    return out


def row_key() -> Column:
    """What tells rows apart and orders them: no id last, the id, a digest of the text."""
    return F.struct(F.col("doc_id").isNull().alias("z"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("i"), F.xxhash64(common.whole_text()).alias("t"))


def signed(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(row, node, sig, bands) of every document; node is null without words."""
    common.small_batches(docs.sparkSession)
    source = docs.select(row_key().alias("row"), common.whole_text().alias("text"))
    schema = "row struct<z:boolean,i:long,t:long>, node long, sig binary, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column("text").cast(pa.binary()).to_pylist(), n)
            full = [k for k, s in enumerate(sets) if s.size]
            sig = signatures([sets[k] for k in full], bands * rows) if full else np.empty((0, bands * rows), np.uint64)
            band = np.zeros((len(full), bands), np.uint64)
            for r in range(rows):
                band = band * np.uint64(_P[r + 8]) + sig[:, r::rows]
            band = common.mix64(band * np.uint64(_P[7]) + np.arange(bands, dtype=np.uint64)[None, :]).view(np.int64)
            short = (sig >> np.uint64(48)).astype(np.uint16)
            nodes, sigs, lengths = [None] * len(sets), [None] * len(sets), np.zeros(len(sets), np.int64)
            for j, k in enumerate(full):
                nodes[k], sigs[k], lengths[k] = node_of(sets[k]), short[j].tobytes(), bands
            yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "node": pa.array(nodes, pa.int64()), "sig": pa.array(sigs, pa.binary()), "bands": common.list_array(lengths, pa.array(band.ravel()))})

    return source.mapInArrow(common.tidy(run), schema)


def joined(label: np.ndarray, near: np.ndarray) -> None:
    """Put all marked places in one set, named by its least place (in place)."""
    names = np.unique(label[near])
    if names.size > 1:
        label[np.isin(label, names)] = names[0]


def canopies(nodes: np.ndarray, sig: np.ndarray, all_leaders: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A forest (src, dst) of a bucket's nodes that resemble a common leader, and the leaders' places."""
    order = np.argsort(nodes)
    nodes, sig = nodes[order], sig[order]
    free, label, leaders = np.ones(nodes.size, bool), np.arange(nodes.size), []
    while free.any() and (all_leaders or label.any()):  # all in one set: nothing left to link
        k = int(np.argmax(free))
        like = (sig == sig[k]).mean(1)
        joined(label, like >= JOIN_LEADER)
        leaders.append(order[k])
        free &= like < SAME_AS_LEADER
        free[k] = False
    apart = np.flatnonzero(label != np.arange(nodes.size))
    return nodes[label[apart]], nodes[apart], np.array(leaders)


def _matrix(sigs) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint16).reshape(len(sigs), -1)


def candidate_edges(reps: DataFrame) -> DataFrame:
    """Candidate edges (src, dst) between nodes that share a band and whose signatures are near a common leader."""
    spread = reps.select("node", F.explode("bands").alias("bucket"))
    sizes = spread.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where("n > 1")
    kept = written(sizes.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "n"), "buckets")
    rows = int(kept.agg(F.sum("n")).first()[0] or 0)
    parts = common.parts_for(rows, GROUP_ROWS)
    members = spread.join(kept, "bucket").join(reps.select("node", "sig"), "node")
    salts = F.ceil(F.col("n") / BUCKET_PART)
    members = members.withColumn("split", salts > 1).withColumn("salt", F.pmod(F.xxhash64("node"), salts))
    members = members.withColumn("part", F.pmod(F.xxhash64("bucket", "salt"), F.lit(parts))).drop("n", "bands")

    def inside(key, frame):
        out: list[pd.DataFrame] = []
        for (bucket, _, split), g in frame.groupby(["bucket", "salt", "split"], sort=False):
            nodes = g["node"].to_numpy()
            src, dst, leaders = canopies(nodes, _matrix(g["sig"].tolist()), split)
            out.append(pd.DataFrame({"src": src, "dst": dst}).astype("Int64"))  # nullable, as floats can't hold the ids
            if split:
                top = g.iloc[leaders]
                out.append(pd.DataFrame({"bucket": bucket, "node": top["node"].to_numpy(), "sig": top["sig"].to_numpy()}).astype({"bucket": "Int64", "node": "Int64"}))
        return pd.concat(out, ignore_index=True).reindex(columns=["src", "dst", "bucket", "node", "sig"])

    found = written(members.groupBy("part").applyInPandas(inside, "src long, dst long, bucket long, node long, sig binary"), "stars")

    def between(key, frame):
        i, j = key[1], key[2]  # two blocks of the bucket's leaders, or one with itself
        a, b = frame[frame["block"] == i], frame[frame["block"] == j]
        nodes = np.concatenate([a["node"], b["node"]])
        if a.empty or b.empty:
            return pd.DataFrame({"src": nodes[:0], "dst": nodes[:0]})
        sig_a, sig_b = _matrix(a["sig"].tolist()), _matrix(b["sig"].tolist())
        label = np.arange(nodes.size)
        for k in range(len(a)):
            near = np.concatenate([np.zeros(len(a), bool), (sig_b == sig_a[k]).mean(1) >= LINK_LEADERS])
            near[k] = True
            joined(label, near)
        apart = np.flatnonzero(label != np.arange(nodes.size))
        return pd.DataFrame({"src": nodes[label[apart]], "dst": nodes[apart]})

    top = found.where("bucket is not null").select("bucket", "node", "sig")
    blocks = top.groupBy("bucket").agg(F.ceil(F.count("*") / BUCKET_PART).alias("blocks"))
    top = top.join(blocks, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    top = top.select("bucket", "node", "sig", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    linked = top.groupBy("bucket", "i", "j").applyInPandas(between, "src long, dst long")
    return found.where("src is not null").select("src", "dst").unionByName(linked)


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """|A and B| for all sets of two lists, by products of slices of their 0/1 incidence."""
    flat = np.concatenate([*a, *b])
    ids, index, seen = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.cumsum(seen > 1) - 1
    shared = (seen > 1)[index]
    row = np.repeat(np.arange(len(a) + len(b)), [s.size for s in [*a, *b]])[shared]
    col = rank[index[shared]]
    out = np.zeros((len(a), len(b)), np.float32)
    width = max(256, min(8192, 16_000_000 // max(1, len(a) + len(b))))
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for low in range(0, int(col[-1]) + 1 if col.size else 0, width):
        i, j = np.searchsorted(col, [low, low + width])
        m = np.zeros((len(a) + len(b), width), np.float32)
        m[row[i:j], col[i:j] - low] = 1
        out += m[: len(a)] @ m[len(a) :].T
    return out


def compare_blocks(nodes_a, sets_a, copies_a, nodes_b, sets_b, copies_b, same: bool, similarity: float) -> pd.DataFrame:
    """Links of each node (counting copies) between two blocks and the least node it is linked with."""
    both = overlaps(sets_a, sets_b).astype(np.float64)
    size_a, size_b = np.array([s.size for s in sets_a]), np.array([s.size for s in sets_b])
    near = both / (size_a[:, None] + size_b[None, :] - both) >= similarity
    if same:
        np.fill_diagonal(near, False)
    links_a, links_b = near @ copies_b, copies_a @ near
    i, j = np.nonzero(near)
    known: dict[int, int] = {}
    if i.size:
        known = dict(zip(*(x.tolist() for x in forest(nodes_a[i], nodes_b[j])), strict=True))
    nodes = nodes_a if same else np.concatenate([nodes_a, nodes_b])
    links = links_a if same else np.concatenate([links_a, links_b])
    return pd.DataFrame({"node": nodes, "links": links.astype(np.int64), "label": [known.get(x, x) for x in nodes.tolist()]})


def members(docs: DataFrame, n: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """(row, class, n_links, alone) of every document: its key, the least key of its class, whether it has no words."""
    signed_docs = written(signed(docs, n, bands_for(similarity, recall, rows), rows), "signatures")
    worded = signed_docs.where("node is not null")
    reps = written(worded.groupBy("node").agg(F.min("row").alias("first"), F.count("*").alias("copies"), F.any_value("sig").alias("sig"), F.any_value("bands").alias("bands")), "nodes")
    near = connected_components(candidate_edges(reps))
    sized = near.join(near.groupBy("component").agg(F.count("*").alias("size")), "component")
    blocks = F.ceil(F.col("size") / block)
    wanted = written(sized.join(reps.select("node", "first", "copies"), "node").select("component", "node", "first", "copies", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).alias("block")), "candidates")
    parts = common.parts_for(int(wanted.agg(F.sum("blocks")).first()[0] or 0), GROUP_ROWS // 4)

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column("text").cast(pa.binary()).to_pylist(), n)
            cols = {c: batch.column(c) for c in ("component", "node", "copies", "blocks", "block")}
            yield pa.RecordBatch.from_pydict(cols | {"grams": pa.array([s.tobytes() for s in sets], pa.binary())})

    texts = docs.select(row_key().alias("first"), common.whole_text().alias("text"))
    # never a broadcast: what is wanted grows with the input, and the plan is to be the same at every size
    sets = texts.join(wanted.hint("merge"), "first").mapInArrow(common.tidy(with_sets), "component long, node long, copies long, blocks long, block long, grams binary")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = sets.withColumn("other", other).select("component", "node", "copies", "grams", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("component", "i", "j"), F.lit(parts)))

    def verify(key, frame):
        out = []
        for (_, i, j), g in frame.drop_duplicates(["component", "i", "j", "node"]).groupby(["component", "i", "j"], sort=False):
            sides = []
            for k in (i, j):
                side = g[g["block"] == k]
                sides += [side["node"].to_numpy(), [np.frombuffer(x, np.uint64) for x in side["grams"]], side["copies"].to_numpy()]
            if len(sides[0]) and len(sides[3]):
                out.append(compare_blocks(*sides, same=i == j, similarity=similarity))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"node": [], "links": [], "label": []}).astype("int64")

    verified = written(dealt.groupBy("part").applyInPandas(verify, "node long, links long, label long"), "links")
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    linked = connected_components(verified.select(F.col("node").alias("src"), F.col("label").alias("dst")))
    named = linked.join(reps.select("node", "first"), "node")
    names = named.groupBy("component").agg(F.min("first").alias("class"))
    told = reps.select("node", "first", "copies").join(linked.join(names, "component").select("node", "class"), "node", "left").join(links, "node", "left")
    told = told.select("node", F.coalesce("class", "first").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies", "first")
    # a node may have a third of all rows: rows are salted, and nodes with copies are there under each salt
    salt = lambda key: F.pmod(F.xxhash64(f"{key}.i", f"{key}.t", F.lit(3)), F.lit(SALTS))
    salts = F.when(F.col("copies") > 1, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(salt("first")))
    told = told.withColumn("salt", F.explode(salts)).drop("copies", "first")
    out = worded.select("row", "node", salt("row").alias("salt")).join(told, ["node", "salt"]).select("row", "class", "n_links", F.lit(False).alias("alone"))
    alone = signed_docs.where("node is null").select("row", F.col("row").alias("class"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("alone"))
    return out.unionByName(alone)


def classes(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, class_id, n_links) of every document; the options are those of members().

    A link joins two documents of Jaccard similarity `similarity` or more; a class is a connected set of
    documents, named by its least doc_id; n_links counts the other documents linked with one, copies too.
    """
    name = lambda key: F.when(~F.col(f"{key}.z"), F.col(f"{key}.i"))
    return members(docs, **how).select(name("row").alias("doc_id"), name("class").alias("class_id"), "n_links")


def deduplicate(docs: DataFrame, **how) -> DataFrame:
    """One document of each class stays: the first by (id, digest of the text), null ids last. All columns kept.

    Of rows with equal id and text, the one whose columns are least as JSON stays. Documents without words
    are near nothing and all stay.
    """
    first = members(docs, **how).groupBy("row").agg(F.count("*").alias("n"), F.bool_or("alone").alias("alone"), F.bool_or(F.col("row") == F.col("class")).alias("first")).where("first")
    once = F.col("alone") | (F.col("n") == 1)
    keyed = docs.select(row_key().alias("row"), F.struct("*").alias("doc"))
    single = keyed.join(first.where(once).select("row"), "row").select("doc.*")
    # the sum of equal rows is made before the shuffle
    several = keyed.join(first.where(~once).select("row"), "row").groupBy("row").agg(F.min_by("doc", F.to_json("doc")).alias("doc")).select("doc.*")
    return single.unionByName(several)
