"""Windows of placed terms and the scoring of batches, against plain loops."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lodestone.operators import blockmax, index, retrieval, scan, scoring, sweep


def placed(texts):
    runs = sweep._runs()
    found = [[(t, m.start(), m.end()) for m in runs.finditer(text) for t in sweep.run_terms(m.group(), runs)] for text in texts]
    lists = [pa.array([[f[k] for f in own] for own in found], pa.list_(kind)) for k, kind in enumerate((pa.string(), pa.int32(), pa.int32()))]
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string()), *lists], ["doc_id", "text", "terms", "starts", "ends"])


@pytest.mark.parametrize("size, overlap", [(20, 5), (12, 0), (7, 6), (300, 10)])
def test_windows_of_many_documents_at_once(size, overlap):
    r = random.Random(3)
    texts = ["".join(r.choice(["red ", "Apple", "差旅费用", " ", "tree. ", "x9", "\n", "é"]) for _ in range(r.randint(1, 60))) for _ in range(30)]
    b, runs = placed(texts), sweep._runs()
    sent = list(sweep.slices(b))
    assert sum(x.num_rows for x in sent) == 30
    s = sweep.Placed(b, runs)
    w = s.windows(size, overlap)
    step = size - overlap
    want = [(d, i, t[i * step : i * step + size]) for d, t in enumerate(texts) for i in range(max(-(-(len(t) - size) // step), 0) + 1)]
    assert [(d, i, s.text[x:y]) for d, i, x, y in zip(w.doc, w.index, w.a, w.b, strict=True)] == want
    held = [[] for _ in want]
    for first, last, code in zip(w.first, w.last, s.codes, strict=True):
        for i in range(first, last + 1):
            held[i].append(s.names[code])
    for i, code in zip(w.rest, w.rest_terms, strict=True):
        held[i].append(s.names[code])
    assert [sorted(x) for x in held] == [sorted(sweep.run_terms(t, runs)) for _, _, t in want]
    assert w.lengths().tolist() == [len(x) for x in held] and w.kept.tolist() == [bool(t.strip()) for _, _, t in want]


@pytest.mark.parametrize("odd", [False, True])
def test_best_of_batches_against_all_scores(odd):
    """Many equal scores among them: a column's first k by rounded score and key stay, and little else."""
    r = np.random.default_rng(5)
    terms, columns, n, k = 40, 9, 700, 6
    w = np.where(r.random((terms, columns)) < 0.3, r.integers(-1 if odd else 1, 4, (terms, columns)) * 0.7, np.nan)
    tf = r.poisson(0.15, (n, terms)) * (r.random((n, 1)) < 0.9)
    norm = scoring.norms(tf.sum(axis=1) // 3, 2.0)
    raw = (tf * 2.5 / (tf + norm[:, None])) @ np.nan_to_num(w)
    hit = (tf > 0) @ ~np.isnan(w) > 0
    best = scoring.Best(w, k)
    held = scoring.Held(best, ["key"])
    for begin in range(0, n, 100):
        row, at = np.nonzero(tf[begin : begin + 100])
        (window, column, score), told = best.add(min(100, n - begin), [(row, at, tf[begin + row, at])], norm[begin : begin + 100], (np.arange(100), np.full(100, 2)))
        assert np.allclose(told, raw[begin : begin + 100, 2], rtol=0, atol=1e-12)
        held.add(pa.table([pa.array(column), pa.array(score), pa.array(window + begin)], ["column", "raw", "key"]))
    out = held.out().to_pydict()
    assert len(out["key"]) < columns * k * 4
    for c in range(columns):
        found = {key: x for q, x, key in zip(out["column"], out["raw"], out["key"], strict=True) if q == c}
        assert all(abs(x - raw[key, c]) < 1e-12 and hit[key, c] for key, x in found.items())
        first = lambda keys: sorted((-round(raw[key, c], 6), key) for key in keys)[:k]  # noqa: B023, E731
        assert first(found) == first(np.flatnonzero(hit[:, c]).tolist())


def test_a_scan_gives_what_scoring_everything_gives(spark, monkeypatch):
    """Heads with many queries, rare terms, equal chunks, sets of few heads."""
    r = random.Random(2)
    words = ["the", "of", *(f"w{i}" for i in range(30))]
    text = lambda n: " ".join(r.choice(words[:2]) if r.random() < 0.4 else r.choice(words) for _ in range(n))
    rows = [(i, j, f"{text(r.randint(1, 9))} key{i}") for i in range(120) for j in range(2)] + [(200 + i, 0, "of w3 w4") for i in range(40)] + [(300, 0, ""), (301, 0, None)]
    chunks = spark.createDataFrame(rows, "doc_id bigint, chunk_index int, text string").repartition(5)
    asked = [(i, f"{['w3 w4', 'the of w9', 'w3 w4 w4'][i % 3]} key{7 * i % 130}") for i in range(60)] + [(70, "key5"), (71, "zzz"), (72, ""), (73, "of the"), (74, "w1 key3 key4")]
    q = spark.createDataFrame(asked, "query_id bigint, query string")
    plain = index.build_index(chunks)
    got = lambda df: sorted(map(tuple, df.select("query_id", "doc_id", "chunk_index", "score", "rank").collect()))
    for numbers, rare, k in ((1 << 22, 3, 5), (60, 3, 30), (1 << 22, 0, 5)):
        monkeypatch.setattr(scan, "NUMBERS", numbers)
        monkeypatch.setattr(scan, "RARE", rare)
        assert got(retrieval.bm25_search(q, {"chunks": chunks}, k)) == got(retrieval.bm25_search(q, plain, k))
    assert scan.search(q, chunks.limit(0), 3).count() == scan.search(q.limit(0), chunks, 3).count() == 0


def searches(spark, monkeypatch, name):
    """(rows of a registered query on sf0.001, searches that it made, block indexes that it wrote)"""
    from lodestone.jobs import queries
    from lodestone.sources.tables import work_dir

    calls, search = [], retrieval.bm25_search
    monkeypatch.setattr(retrieval, "bm25_search", lambda *a, **b: calls.append(a) or search(*a, **b))
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{work_dir(spark)}/blocks-*")
    written = lambda: len(at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or [])
    before = written()
    n = queries.QUERIES[name](spark, "/root/testdata/sf0.001").count()
    return n, len(calls), written() - before


@pytest.mark.parametrize("name", ["confidence_gate", "keyword_hit"])
def test_evidence_is_searched_once_and_without_an_index(spark, monkeypatch, name):
    assert searches(spark, monkeypatch, name) == (40, 1, 0)


def test_padded_hits_are_searched_once_and_without_an_index(spark, monkeypatch):
    n, calls, written = searches(spark, monkeypatch, "bm25_padded")
    assert n == 40 * 500 and calls == 1 and written == 0


@pytest.mark.parametrize("name, rows", [("retrieve_rules", 50), ("retrieve_rules_plain", 50)])
def test_rules_are_searched_without_a_block_index(spark, monkeypatch, name, rows):
    assert searches(spark, monkeypatch, name) == (rows, 1, 0)


def test_nearest_keeps_few_scores_and_breaks_ties_by_key_in_any_order():
    r = np.random.default_rng(1)
    scores, keys = np.round(r.random((300, 7)), 1), r.permutation(300)
    scores[:200] = np.where(r.random((200, 7)) < 0.9, 1.0, scores[:200])  # most of the first ones are alike
    for order in (np.argsort(keys), np.arange(300)):
        own = retrieval._Nearest(np.arange(7), 5, ["k0"])
        for begin in range(0, 300, 50):
            block = np.sort(order[begin : begin + 50]) if order[0] == 0 else order[begin : begin + 50]
            block = block[np.argsort(keys[block])]
            own.add(scores[block], [pa.array(keys[block])])
        got = own.out().to_pydict()
        for q in range(7):
            want = sorted((-s, k) for s, k in zip(scores[:, q], keys, strict=True))[:5]
            assert [(-s / 1e6, k) for n, s, k in zip(got["query"], got["s"], got["k0"], strict=True) if n == q] == want


def test_a_vacuumed_index_keeps_what_it_reads_alone(spark, tmp_path):
    chunks = spark.createDataFrame([(i, 0, f"w{i % 7} the w{i % 5} the key{i}") for i in range(90)], "doc_id bigint, chunk_index int, text string")
    q = spark.createDataFrame([(1, "w3 the key9"), (2, "w1 w2")], "query_id bigint, query string")
    path = f"{tmp_path}/i"
    blockmax.add_segment(chunks.where("doc_id < 50"), path)
    blockmax.add_segment(chunks.where("doc_id >= 50"), path)
    blockmax.delete_documents(spark, path, spark.range(40, 60).select("id").withColumnRenamed("id", "doc_id"))
    blockmax.merge(spark, path)
    blockmax.vacuum(spark, path)
    listed = {x: sorted(p.name for p in (tmp_path / "i" / x).iterdir() if not p.name.startswith(".")) for x in ("forward", "blocks", "terms", "gone", "stats", "generations")}
    assert listed == {"forward": ["segment=3"], "blocks": ["segment=3"], "terms": ["segment=3"], "gone": [], "stats": ["00000004"], "generations": ["00000004.json"]}
    found = blockmax.open_index(spark, path)
    got = lambda df: sorted(map(tuple, df.select("query_id", "doc_id", "chunk_index", "score", "rank").collect()))
    assert got(blockmax.search(q, found, 6)) == got(retrieval.bm25_search(q, index.build_index(chunks.where("doc_id < 40 or doc_id >= 60")), 6))
    # postings become blocks where their chunks are
    assert "Exchange" not in blockmax._packed_blocks(found.forward, 5.0)._jdf.queryExecution().executedPlan().toString()


def test_deleted_chunks_of_high_scores_hide_no_others(spark, tmp_path):
    rows = [(i, 0, "w1 w1 w1" if i < 60 else f"w1 x{i} y z v") for i in range(75)] + [(100 + i, 0, f"u{i} u u") for i in range(200)]
    chunks = spark.createDataFrame(rows, "doc_id bigint, chunk_index int, text string").coalesce(1)
    q = spark.createDataFrame([(1, "w1 y")], "query_id bigint, query string")
    blockmax.add_segment(chunks, f"{tmp_path}/i")
    blockmax.delete_documents(spark, f"{tmp_path}/i", spark.range(60).withColumnRenamed("id", "doc_id"))
    got = lambda df: sorted(map(tuple, df.select("query_id", "doc_id", "chunk_index", "score", "rank").collect()))
    want = got(retrieval.bm25_search(q, index.build_index(chunks.where("doc_id >= 60")), 5))
    assert len(want) == 5 and got(blockmax.search(q, blockmax.open_index(spark, f"{tmp_path}/i"), 5)) == want
