"""The pipeline against its stages done by hand."""

import re

import corpus_pipeline
from pointmill.llm import jaccard, quality_rank, queries, secrets


def test_pipeline_equals_its_stages_by_hand(spark, sf_dir):
    import sentencepiece

    got = {r["doc_id"]: (list(r["ids"]), r["decoded"]) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    docs = queries.table(spark, sf_dir, "documents")
    ranking = quality_rank.fit(docs, queries.table(spark, sf_dir, "labels"))
    rows = sorted((r["doc_id"], r["text"] or "") for r in quality_rank.accepted(docs, ranking).collect())
    sets = jaccard.shingle_sets([t.encode() for _, t in rows], 5)
    index, parent = {}, list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for k, s in enumerate(sets):
        counts = {}
        for g in s.tolist():
            for j in index.setdefault(g, []):
                counts[j] = counts.get(j, 0) + 1
            index[g].append(k)
        for j, m in counts.items():
            if m / (s.size + sets[j].size - m) >= 0.8:
                a, b = sorted((root(j), root(k)))
                parent[b] = a
    rows = [r for k, r in enumerate(rows) if root(k) == k]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    grams = lambda w: {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    bench = set().union(*(grams(words(r["text"])) for r in queries.table(spark, sf_dir, "benchmark").collect() if r["text"]))
    rows = [(i, t) for i, t in rows if not grams(words(t)) & bench]
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    automaton, want = secrets.automaton(), {}
    for i, t in rows:
        at, out = 0, ""
        for _, s, e in secrets.scan(t, automaton):
            if s >= at:
                out += t[at:s] + "[SECRET]"
            at = max(at, e)
        t = out + t[at:]
        want[i] = (sp.encode(t), sp.decode(sp.encode(t)))
    assert got == want


def test_stages_keep_the_columns(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


def test_awkward_documents_go_through(spark, docs, empty, tmp_path):
    """Nulls, copies, repeated and missing ids, empty and long texts, clashing columns; then nothing at all."""
    spark.createDataFrame([(0, 1, 0), (6, 0, 0), (None, 1, None), (8, None, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([("q", "no such words at all in any document of this table"), (None, None)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for start, name in ((docs, "some"), (empty, "none")):
        now = start
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, now, str(tmp_path))
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns
            before = now.count()
            out.write.parquet(str(tmp_path / f"{name}{k}"))
            now = spark.read.parquet(str(tmp_path / f"{name}{k}"))
            if k in (2, 3, 4):  # no leak here, and the last two drop nothing
                assert now.count() == before
        assert (now.count() > 0) == (name == "some")
