"""Temporary arrays of a task stay small beside its text, and results don't depend on the pieces it is worked in."""

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from pointmill.llm import common, decontaminate, pieces, queries, suffixes


def test_words_are_hashed_in_pieces(monkeypatch):
    rng = random.Random(4)
    data = b" ".join(rng.randbytes(rng.randrange(1, 12)).replace(b" ", b"_") for _ in range(600_000))
    tracemalloc.start()
    hashes, starts = common.word_hashes(data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * len(data)
    monkeypatch.setattr(common, "_PIECE", len(data))
    assert all((a == b).all() for a, b in zip((hashes, starts), common.word_hashes(data), strict=True))
    for few in (b"", b"   ", b"a", b"a b " * 4, b" x" * 5, b"long" * 40 + b" y"):
        monkeypatch.setattr(common, "_PIECE", 2)
        got = common.word_hashes(few)
        monkeypatch.setattr(common, "_PIECE", 1 << 20)
        assert [x.tolist() for x in got] == [x.tolist() for x in common.word_hashes(few)]


def test_chunks_are_answered_in_runs_of_documents(spark, docs, monkeypatch):
    want = sorted(map(str, pieces.encode(docs, queries.piece_model()).collect()))
    monkeypatch.setattr(pieces, "RUN_WORDS", 50)
    assert sorted(map(str, pieces.encode(docs, queries.piece_model()).collect())) == want


def peak_of(work):
    tracemalloc.start()
    out = work()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, peak


def test_suffixes_are_ranked_in_little_memory():
    symbols = np.random.default_rng(3).integers(0, 70_000, 400_000)
    symbols[200_000:] = symbols[:200_000]  # as many suffixes as can be stay open to the end
    rank, peak = peak_of(lambda: suffixes.ranks_to_depth(symbols, 10))
    assert (rank[:199_990] == rank[200_000:-10]).all() and np.unique(rank).size == 200_000 + 10 - 1
    assert peak < 60 * symbols.size


def test_a_shard_is_built_in_little_memory():
    rng = random.Random(5)
    words = [rng.randbytes(rng.randrange(2, 9)).hex()[:9].encode() for _ in range(5_000)]
    texts = [b" ".join(rng.choices(words, k=rng.randrange(800))) for _ in range(1_000)]
    size = sum(map(len, texts))
    held, (arrays, peak) = len(texts), peak_of(lambda: decontaminate.shard_arrays(texts, 10))
    assert common.loosened(arrays["n_words"]).size == held and not texts
    assert peak < 12 * size


def test_a_shard_has_its_words_and_suffixes(monkeypatch):
    texts = [b"", b"A b. a b a", b"   ", b"b a b", b"", b"c a b a b", "\u00e9 A b".encode(), b""]
    split = [t.translate(common.WORDS_ONLY).split() for t in texts]
    hashes = [[int(common.word_hashes(w)[0][0]) for w in ws] for ws in split]
    known = sorted({h for hs in hashes for h in hs})
    seq = [x for hs in hashes for x in (0, *(known.index(h) + 1 for h in hs))]
    for run in (1 << 20, 1):
        monkeypatch.setattr(decontaminate, "RUN_BYTES", run)
        got = decontaminate.shard_arrays(list(texts), 3)
        n, tokens = common.loosened(got["n_words"]), common.loosened(got["tokens"])
        assert n.tolist() == [len(ws) for ws in split] and common.unpacked_sorted(got["words"]).tolist() == known
        assert decontaminate.sequence(tokens, n).tolist() == seq
        want = sorted(range(len(seq)), key=lambda i: (seq[i : i + 3], seq[i - 1] if i else 0, i))
        assert common.loosened(got["suffixes"]).tolist() == want
    none = decontaminate.shard_arrays([b"", b" "], 3)
    assert common.loosened(none["n_words"]).tolist() == [0, 0] and not common.loosened(none["tokens"]).size


def test_tasks_give_arrows_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(len(calls)))
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["a b"] * 3)})
    assert list(common.tidy(iter)([batch, batch])) == [batch, batch] and len(calls) == 1
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: SimpleNamespace(partitionId=lambda: 2))
    assert [(k, len(r["text"])) for k, r in common.text_runs(iter([batch, batch]), 2 * 64)] == [(2 << 32, 2), ((2 << 32) + 1, 2), ((2 << 32) + 2, 2)]
    assert len(calls) == 1 + 3 + 1
