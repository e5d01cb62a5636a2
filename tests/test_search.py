"""The stored block index, chunk windows, the chunking sweep, the result cache and plug-ins."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import plugins
from lodestone.functions import text as T
from lodestone.operators import blockmax, cache, chunking, evaluate, index, retrieval, sweep
from lodestone.sources import tables

WORDS = ["the", "of", "and", *(f"w{i}" for i in range(120))]


def corpus(spark, n, seed=1):
    r = random.Random(seed)
    text = lambda: " ".join(r.choice(WORDS[:3]) if r.random() < 0.4 else WORDS[min(len(WORDS) - 1, int(r.expovariate(0.05)))] for _ in range(r.randint(1, 40)))
    return spark.createDataFrame([(i, 0, text()) for i in range(n)] + [(n, 0, ""), (n + 1, 0, "the the the")], "doc_id bigint, chunk_index int, text string")


def asked(spark):
    return spark.createDataFrame([(1, "w3 w50 the"), (2, "of and the"), (3, "w9 w9 w100 w101 zzz"), (4, "nothing"), (5, "W60 w61 w62 w63 w64 w65"), (6, "")], "query_id bigint, query string")


def rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "doc_id", "chunk_index", "score", "rank").collect())


@pytest.mark.parametrize("probed", [200, 1])
def test_blocks_give_what_scoring_everything_gives(spark, tmp_path, monkeypatch, probed):
    monkeypatch.setattr(blockmax, "CELL_BITS", 6)
    monkeypatch.setattr(blockmax, "PROBED", probed)
    chunks, q = corpus(spark, 400).cache(), asked(spark)
    blockmax.add_segment(chunks, f"{tmp_path}/i", buckets=4)
    got = blockmax.open_index(spark, f"{tmp_path}/i")
    plain = index.build_index(chunks)
    for k in (7, 500):
        assert rows(blockmax.search(q, got, k)) == rows(retrieval.bm25_search(q, plain, k))
    read = blockmax.blocks_read(q, got, 5).groupBy().sum().first()
    assert 0 < read["sum(postings_read)"] <= read["sum(postings)"] and read["sum(blocks_read)"] < read["sum(blocks)"]


def test_search_reads_only_asked_buckets(spark, tmp_path):
    blockmax.add_segment(corpus(spark, 50), f"{tmp_path}/i", buckets=64)
    got = blockmax.open_index(spark, f"{tmp_path}/i")
    q = spark.createDataFrame([(1, "w3")], "query_id bigint, query string")
    mine = blockmax._asked(q, got, plugins.TERMS)["bucket"].tolist()
    plan = got.in_buckets(got.blocks, mine)._jdf.queryExecution().executedPlan().toString()
    assert len(mine) == 1 and re.search(rf"PartitionFilters: \[[^\]]*bucket#\d+ (= {mine[0]}\b|IN \({mine[0]}\))", plan)


def test_segments_deletions_and_merges_equal_a_rebuild(spark, tmp_path):
    chunks, q = corpus(spark, 120).cache(), asked(spark)
    path = f"{tmp_path}/i"
    blockmax.add_segment(chunks.where("doc_id < 50"), path)
    blockmax.add_segment(chunks.where("doc_id >= 50"), path)
    assert rows(blockmax.search(q, blockmax.open_index(spark, path), 9)) == rows(retrieval.bm25_search(q, index.build_index(chunks), 9))
    before = blockmax.open_index(spark, path)
    blockmax.delete_documents(spark, path, spark.range(30, 70).select(F.col("id").alias("doc_id")))
    left = index.build_index(chunks.where("doc_id < 30 or doc_id >= 70"))
    assert rows(blockmax.search(q, blockmax.open_index(spark, path), 9)) == rows(retrieval.bm25_search(q, left, 9))
    assert rows(blockmax.search(q, before, 9)) == rows(retrieval.bm25_search(q, index.build_index(chunks), 9))  # an older generation stays
    m = blockmax.merge(spark, path)
    assert len(m.segments) == 1 and not m.deletions and rows(blockmax.search(q, blockmax.open_index(spark, path), 9)) == rows(retrieval.bm25_search(q, left, 9))
    blockmax.add_segment(chunks.where("doc_id between 30 and 69"), path)  # deleted documents may come again
    assert rows(blockmax.search(q, blockmax.open_index(spark, path), 9)) == rows(retrieval.bm25_search(q, index.build_index(chunks), 9))


def test_an_index_of_nothing(spark, tmp_path):
    blockmax.add_segment(corpus(spark, 5).limit(0), f"{tmp_path}/i")
    assert blockmax.search(asked(spark), blockmax.open_index(spark, f"{tmp_path}/i"), 5).count() == 0
    with pytest.raises(FileNotFoundError):
        blockmax.open_index(spark, f"{tmp_path}/none")


def test_a_second_run_scores_nothing(spark, tmp_path):
    chunks = corpus(spark, 60).cache()
    plain, calls = index.build_index(chunks), []
    q = asked(spark).union(spark.createDataFrame([(9, "w3 w50 the")], "query_id bigint, query string"))

    def search(own):
        calls.append(own.count())
        return retrieval.bm25_search(own, plain, 4)

    for version, scored in (("1", 6), ("1", 0), ("2", 6)):
        hits, new = cache.cached_search(q, search, f"{tmp_path}/c", version, 4)
        assert new.count() == scored and rows(hits) == rows(retrieval.bm25_search(q, plain, 4))
    assert calls == [6, 6]


def test_plug_ins_from_build_to_query(spark, tmp_path):
    encoder = plugins.Encoder("lengths", 2, lambda: lambda texts: np.array([[len(t), len(t.split())] for t in texts], dtype=float).reshape(-1, 2))
    halves = plugins.Tokenizer("halves", lambda c: F.transform(F.split(F.lower(c), " "), lambda w: F.substring(w, 1, 2)))
    chunks, q = corpus(spark, 40).cache(), asked(spark)
    built = index.build_index(chunks, tokenizer=halves, encoder=encoder)
    assert {len(r.embedding) for r in built["vectors"].collect()} == {2} and built["term_stats"].where("length(term) > 2").count() == 0
    settings = retrieval.Settings(tokenizer=halves, encoder=encoder)
    stages = retrieval.retrieve_stages(q, built, 3, settings=settings)
    assert stages["evidence"].columns == ["query_id", "doc_id", "chunk_index", "score", "expanded_via_graph", "rank"]
    assert {r.query_id for r in stages["evidence"].collect()} == {1, 2, 3, 4, 5, 6}
    assert all(r.hybrid_retrieval_count == 10 and r.reranked_count == 10 for r in stages["counts"].where("query_id < 4").collect())
    for other in (retrieval.Settings(), retrieval.Settings(tokenizer=halves), retrieval.Settings(encoder=encoder)):
        with pytest.raises(ValueError):
            retrieval.retrieve_batch(q, built, settings=other)
    blockmax.add_segment(chunks, f"{tmp_path}/i", halves)
    got = blockmax.open_index(spark, f"{tmp_path}/i", halves)
    assert rows(blockmax.search(q, got, 4, halves)) == rows(retrieval.bm25_search(q, built, 4, tokenizer=halves))
    for bad in (lambda: blockmax.open_index(spark, f"{tmp_path}/i"), lambda: blockmax.search(q, got, 4), lambda: blockmax.add_segment(chunks, f"{tmp_path}/i")):
        with pytest.raises(ValueError):
            bad()
    sentences = chunking.chunk_semantic(chunks.select("doc_id", "text"), lambda s: index.embed_text(s, ["doc_id", "pos"], encoder), 0.5, 5, 50)
    assert sentences.count() > 0


def test_windows_cost_grows_with_the_text(spark):
    took = []
    for n in (1_000_000, 8_000_000):
        df = spark.createDataFrame([(1, "abcd efgh 差旅. " * (n // 14))], "doc_id bigint, text string").cache()
        df.count()
        began = time.time()
        for f in (chunking.chunk_chars, chunking.chunk_tokens):
            f(df, 512, 64).write.format("noop").mode("overwrite").save()
        took.append(time.time() - began)
    assert took[1] < 8 * 3 * took[0] + 5


def test_windows_against_slices(spark):
    r = random.Random(4)
    texts = ["".join(r.choice("ab é差.\U0001f600 \n") for _ in range(r.randint(0, 90))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for size, overlap in ((10, 3), (7, 6), (20, 0), (9, 8)):
        got = {(x.doc_id, x.start_char): x.text for x in chunking.chunk_chars(df, size, overlap).collect()}
        want = {}
        for i, t in enumerate(texts):
            for s in range(0, max(len(t) - size, 0) + size - overlap, size - overlap):
                if t[s : s + size].strip() and (s == 0 or s - (size - overlap) + size < len(t)):
                    want[i, s] = t[s : s + size]
        assert got == want


def test_tokens_stream_in_batches(spark, monkeypatch):
    monkeypatch.setattr(chunking, "TOKEN_ROWS", 3)
    df = spark.createDataFrame([(1, " ab,差旅 c9"), (2, None), (3, "x" * 5 + " y" * 10)], "doc_id bigint, text string")
    got = sorted(tuple(x) for x in chunking.tokenize_offsets(df).where("doc_id = 1").collect())
    assert got == [(1, 0, "ab", 1, 3), (1, 1, ",", 3, 4), (1, 2, "差旅", 4, 6), (1, 3, "c9", 7, 9)] and chunking.tokenize_offsets(df).count() == 15


def test_sweep_equals_cutting_and_scoring_each_setting(spark):
    r = random.Random(8)
    alphabet = ["red ", "Apple", "差旅费用", " ", "tree. ", "x9", "\n", "blue-sky ", "é"]
    docs = spark.createDataFrame([(i, "".join(r.choice(alphabet) for _ in range(r.randint(0, 60)))) for i in range(25)] + [(90, None), (91, " " * 50)], "doc_id bigint, text string")
    q = spark.createDataFrame([(1, "red apple", "red apple"), (2, "差旅 tree sky", "tree"), (3, "none", "none")], "query_id bigint, query string, answer string")
    settings = [(20, 5), (12, 0), (30, 10)]
    placed = tables.store({"p": sweep.placed_terms(docs)})["p"]
    counts = tables.store({"c": sweep.counted(placed, settings)})["c"]
    got = sweep.ranked(placed, settings, *sweep.weights(counts, q), 5)
    for p, (size, overlap) in enumerate(settings):
        chunks = chunking.chunk_chars(docs, size, overlap)
        plain = index.build_index(chunks.select("doc_id", "chunk_index", "text"))
        n = {x.term: x.n for x in counts.where(f"pair = {p}").collect()}
        assert n.pop(None) == chunks.count() and n == {x.term: x.df for x in plain["term_stats"].collect()}
        want = retrieval.bm25_search(q, plain, 5).join(chunks.select("doc_id", "chunk_index", F.substring("text", 1, 100).alias("text")), index.KEY)
        columns = ["query_id", "doc_id", "score", "rank", "text"]
        assert sorted(map(tuple, got.where(f"pair = {p}").select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))


def test_session_without_a_shared_folder(spark):
    assert tables.work_dir(spark).startswith(tables.shared_dir(spark))
    path = f"{tables.work_dir(spark)}/x"
    spark.range(3).write.parquet(path)
    tables.delete(spark, path)
    assert spark.range(3).count() == 3 and T.WHITE.strip() == ""
    assert evaluate.CATEGORIES
