"""The retrieval, graph, answer and evaluation operators on small tables."""

import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import answer, chunking, evaluate, graph, index, retrieval
from lodestone.sources import tables


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_char_windows_cover_the_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(103))
    rows = chunking.chunk_chars(docs(spark, text, "  \n ", None, "short"), 20, 5).orderBy("doc_id", "chunk_index").collect()
    own = [r for r in rows if r.doc_id == 0]
    assert own[0].text + "".join(r.text[5:] for r in own[1:]) == text
    assert own[0].text[-5:] == own[1].text[:5] and [r.chunk_index for r in own] == list(range(len(own)))
    assert [r.text for r in rows if r.doc_id == 3] == ["short"] and {r.doc_id for r in rows} == {0, 3}


def test_window_parameters():
    for bad in ((5, 5, "char"), (5, 6, "char"), (5, 1, "line")):
        with pytest.raises(ValueError):
            T.check_window(*bad)


def test_token_windows_keep_inner_space(spark):
    r = chunking.chunk_tokens(docs(spark, " ab,  cd 差旅 x"), 3, 1).orderBy("chunk_index").collect()
    assert [x.text for x in r] == ["ab,  cd", "cd 差旅 x"] and [x.token_count for x in r] == [3, 3]


def test_sentences(spark):
    r = chunking.split_sentences(docs(spark, "A b. C!  D？e 2.5")).orderBy("pos").collect()
    assert [x.text for x in r] == ["A b.", "C!", "D？", "e 2.", "5"]


@pytest.mark.parametrize("smallest, largest", [(3, 10), (5, 7), (1, 4)])
def test_fold_sizes_loses_nothing(smallest, largest):
    r = random.Random(smallest)
    for _ in range(200):
        parts = ["x" * r.randint(1, 25) for _ in range(r.randint(0, 6))]
        got = chunking.fold_sizes(parts, smallest, largest)
        assert "".join(got) == "".join(parts) and all(len(g) <= largest for g in got)


def test_folds_of_one_huge_segment_and_of_odd_keys(spark):
    got = chunking.fold_sizes(["x" * 2_000_001, " ", "y"], 100, 1000)
    assert len(got) == 2001 and got[0] == "x" * 1000 and got[-1] == "x y"
    rows = [(None, 0, "a" * 5), ("k", 1, None), ("k", 0, "b" * 12), ("k", 2, ""), ("only blank", 0, "  ")]
    parts = chunking.enforce_chunk_sizes(spark.createDataFrame(rows, "name string, segment int, text string"), 4, 10, "name").collect()
    assert sorted((str(r["name"]), r.chunk_index, r.chunk_id, r.text) for r in parts) == [("None", 0, "chunk_0000", "aaaaa"), ("k", 0, "chunk_0000", "b" * 10), ("k", 1, "chunk_0001", "bb")]


def test_segments_of_a_long_document_take_many_tasks(spark):
    """No plan collects a document's sentences in one row of a window: windows go by document and block, and counts are a row a block."""
    text = " ".join(f"{'ab'[n // 5 % 2]}{n}." for n in range(10_000))
    embed = lambda rows: rows.withColumn("embedding", F.when(F.col("text").startswith("a"), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))))
    similar = chunking.adjacent_similarity(embed(chunking.split_sentences(docs(spark, text))))
    assert "hashpartitioning(doc_id#" in (plan := similar._jdf.queryExecution().executedPlan().toString()) and "_b#" in plan.split("hashpartitioning(")[1].split(")")[0]
    got = chunking.semantic_segments(embed(chunking.split_sentences(docs(spark, text)))).orderBy("segment").collect()
    assert [r.segment for r in got] == list(range(2000)) and got[1000].text == "".join(f"a{n}." for n in range(5000, 5005))


def test_csv_keeps_empty_texts_nulls_and_white_space(spark, tmp_path):
    rows = [(1, ""), (2, None), (3, '  "quoted",\n second line \\'), (4, " lead\ttail ")]
    tables.write_results_csv(spark.createDataFrame(rows, "n int, text string"), f"{tmp_path}/csv")
    assert sorted(map(tuple, tables.read_results_csv(spark, f"{tmp_path}/csv", "n int, text string").collect())) == rows


def test_bm25_ranks_and_scales(spark):
    chunks = docs(spark, "red apple", "green apple apple", "blue sky", "").withColumn("chunk_index", F.lit(0))
    q = spark.createDataFrame([(1, "green apple"), (2, "nothing here")], "query_id bigint, query string")
    hits = retrieval.bm25_search(q, index.build_index(chunks), 2).collect()
    assert hits[0].doc_id == 1 and hits[0].score == 1.0 and {h.query_id for h in hits} == {1}
    padded = retrieval.pad_to_k(retrieval.bm25_search(q, index.build_index(chunks), 3), q, chunks, 3)
    assert {r.query_id: r.n for r in padded.groupBy("query_id").agg(F.count("*").alias("n")).collect()} == {1: 3, 2: 3}


def test_rrf_and_rerank(spark):
    hits = lambda *ids: spark.createDataFrame([(1, i, 0, 1.0 / r, r) for r, i in enumerate(ids, 1)], "query_id bigint, doc_id bigint, chunk_index int, score double, rank int")
    fused = retrieval.rrf_fuse(hits(1, 2), hits(2, 1, 3)).orderBy("rank").collect()
    assert [r.doc_id for r in fused] == [1, 2, 3] and all(r.score <= 2 / 61 + 1e-9 for r in fused)
    chunks = docs(spark, "", "a", "a b", "a b c").withColumn("chunk_index", F.lit(0))
    q = spark.createDataFrame([(1, "a b c")], "query_id bigint, query string")
    assert [r.doc_id for r in retrieval.rerank(hits(1, 2, 3), q, chunks).orderBy("rank").collect()] == [3, 2, 1]


def test_dense_search_against_numpy(spark):
    r = random.Random(1)
    rows = [(i, 0, [r.random() for _ in range(4)]) for i in range(40)]
    v = spark.createDataFrame(rows, "doc_id bigint, chunk_index int, embedding array<double>")
    q = v.where("doc_id < 3").select(F.col("doc_id").alias("query_id"), "embedding")
    got = retrieval.dense_search(q, v.repartition(5), 5).orderBy("query_id", "rank").collect()
    for i in range(3):
        want = sorted(rows, key=lambda x: (-round(sum(a * b for a, b in zip(rows[i][2], x[2])), 6), x[0]))[:5]
        assert [g.doc_id for g in got if g.query_id == i] == [w[0] for w in want]


def test_registered_dedupe_compares_whole_questions(spark, tmp_path):
    from lodestone.jobs import queries

    turns = [(c, t, ("user", "assistant")[t], text) for c, q in enumerate(["what is this", "what is that", "what is this"]) for t, text in enumerate([q, "x" * 180])]
    spark.createDataFrame(turns, "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert {r.query_id: r.first_id for r in queries.dedupe_queries(spark, str(tmp_path)).collect()} == {0: 0, 1000: 1000, 2000: 0}
    # what is looked for begins at character 191 of the answer and goes on beyond the 200 that are shown
    assert {(r.predicted_answer, r.is_hit) for r in queries.eval_rows(spark, str(tmp_path)).where("query_id = 1000").collect()} == {("." * 190 + "x" * 10, True)}


def test_rules(spark):
    text = "intro that is long enough to count\n**规则A001：t**\n- 适用条件：国内出差三天以上。\n- 规定：须提前申报登记。参见规则B002\n**规则B002：u**\n- 如果金额超过五百元则需要部门经理审批。"
    chunks = spark.createDataFrame([(1, 0, text)], "doc_id bigint, chunk_index int, text string")
    nodes, edges = graph.build_graph(chunks)
    rules = {r.rule_id: r.node_id for r in nodes.where("type = 'rule'").collect()}
    assert set(rules) == {"1:0:0", "A001", "B002"}
    ref = [(e.src, e.dst) for e in edges.where("weight = 0.9").collect()]
    assert ref == [(rules["A001"], rules["B002"])]
    assert nodes.where("type = 'condition' and text like '国内出差%'").count() == 2


def walk(starts, out, hops, decay=0.7, least=0.1):
    """A queue, one step at a time: what the windowed walk must give."""
    seen, paths, queue = {}, [], deque()
    for n, s in starts:
        queue.append((n, s, [n]))
        seen[n] = s
    while queue:
        n, s, p = queue.popleft()
        for m, w in out.get(n, []):
            new = round(s * decay * w, 9)
            if new < least:
                continue
            better = m not in seen or seen[m] < new
            paths.append((">".join([*p, m]), new, better))
            if better:
                seen[m] = new
                if len(p) + 1 <= hops:
                    queue.append((m, new, [*p, m]))
    return sorted(paths)


def test_paths_against_a_queue(spark):
    r = random.Random(3)
    for case in range(3):
        names = [f"n{i}" for i in range(6)]
        edges = [(a, b, r.choice([1.0, 0.8, 0.9])) for a in names for b in names if r.random() < 0.35]
        nodes = spark.createDataFrame([(n, i, 0, [i, 0]) for i, n in enumerate(names)], "node_id string, doc_id bigint, chunk_index int, ord array<bigint>")
        e = spark.createDataFrame([(a, b, "x", w, [k]) for k, (a, b, w) in enumerate(edges)], "src string, dst string, relation_type string, weight double, ord array<bigint>")
        hits = spark.createDataFrame([(1, 0, 0, 0.9, 1), (1, 3, 0, 0.6, 2)], "query_id bigint, doc_id bigint, chunk_index int, score double, rank int")
        out = {}
        for a, b, w in edges:
            out.setdefault(a, []).append((b, w))
        got = sorted((">".join(p.nodes), p.score, p.improved) for p in graph.graph_paths(hits, nodes, e, 2).collect())
        assert got == walk([("n0", 0.9), ("n3", 0.6)], out, 2), case


def test_hits_expand_over_the_graph_of_their_chunks(spark):
    rule, far = "**规则A001：apple pear plum**\n参见规则B002 and nothing else here", "**规则B002：zzz yyy xxx**\nwords that nobody asks for"
    hits = spark.createDataFrame([(1, 0, 0, 1.0, 1), (1, 2, 0, 0.5, 2), (1, 3, 0, 0.2, 3)], "query_id bigint, doc_id bigint, chunk_index int, score double, rank int")
    got = lambda first: [(r.doc_id, r.score) for r in graph.expand_hits(hits, docs(spark, first, far, "other words", "more words").withColumn("chunk_index", F.lit(0)), 3).orderBy("rank").collect()]
    assert got(rule) == [(0, 1.0), (1, 0.63), (2, 0.5)]
    assert got("no rule is in this chunk at all") == [(0, 1.0), (2, 0.5), (3, 0.2)]


def test_responses_and_gate(spark):
    rows = [(1, '{"answer":"x","cited_chunks":["a"],"confidence_score":0.9}'), (2, 'so {"answer":"y"} end'), (3, "plain"), (4, "[1]"), (5, '{"confidence_score":"high"}'), (6, None), (7, '{"answer":"z"}')]
    p = {r.query_id: (r.answer, r.cited_chunks, r.confidence) for r in answer.parse_responses(spark.createDataFrame(rows, "query_id bigint, response string")).collect()}
    assert p[1] == ("x", ["a"], 0.9) and p[2] == ("y", [], 0.3) and p[3] == ("plain", [], 0.3) and p[4][2] == 0.0 and p[5][2] == 0.0 and p[6] == ("", [], 0.3) and p[7] == ("z", [], 0.5)
    gen = spark.createDataFrame([(1, [], 0.1), (2, ["a"], 1.0)], "query_id bigint, cited_chunks array<string>, confidence double")
    hits = spark.createDataFrame([(2, "a", 1.0, 1)], "query_id bigint, chunk_id string, score double, rank int")
    g = {r.query_id: r for r in answer.confidence_gate(gen, hits).collect()}
    assert g[1].should_clarify and "0.04" in g[1].clarification and g[2].confidence == 1.0 and g[2].warning is None


def test_responses_with_text_around_json(spark):
    rows = [
        '{"answer":"x"} done', '{"a":1} {"answer":"y","cited_chunks":["c"],"confidence_score":0.8}', '{"answer":null}', '{"confidence_score":null}', '{"cited_chunks":null}', '{"cited_chunks":"c"}',
        '{"answer":"x"}, {"answer":"y"}', '"text"', "null", "1] [2", '1, "b": 2', ' {"answer": 5, "confidence_score": "0.25"}\n', "{broken} text", '{"a": {"answer": "deep"}} tail',
        '{"answer":"p","answer":"q","cited_chunks":["a"],"cited_chunks":["b"]}', '{"answer":true,"confidence_score":false}', '{"confidence_score":"true"}', '{"cited_chunks":{"b":1,"a":{"c":2},"b":3}}', '{"cited_chunks":""}', '{"cited_chunks":7}',
        'see {"answer":false,"confidence_score":true} end', '{"answer":NaN}', '{"answer":"true","cited_chunks":[]}', '{"answer":{"b":1}}',
    ]
    df = spark.createDataFrame(list(enumerate(rows)), "query_id int, response string")
    p = {r.query_id: (r.answer, r.cited_chunks, r.confidence) for r in answer.parse_responses(df).collect()}
    error = ("error", [], 0.0)
    assert p == {
        0: ("x", [], 0.3), 1: (rows[1], [], 0.3), 2: ("None", [], 0.5), 3: error, 4: error, 5: ("", ["c"], 0.5), 6: ("x", [], 0.3), 7: error, 8: error,
        9: (rows[9], [], 0.3), 10: (rows[10], [], 0.3), 11: ("5", [], 0.25), 12: (rows[12], [], 0.3), 13: ("deep", [], 0.3),
        14: ("q", ["b"], 0.5), 15: ("True", [], 0.0), 16: error, 17: ("", ["b", "a"], 0.5), 18: ("", [], 0.5), 19: error, 20: ("False", [], 1.0), 21: (rows[21], [], 0.3), 22: ("true", [], 0.5), 23: ('{"b":1}', [], 0.5),
    }


def test_hits_are_judged_on_whole_answers(spark):
    q = spark.createDataFrame([(1, "q", "key words", "simple"), (2, "q", "key words", "simple"), (3, "q", "", "simple")], "query_id bigint, query string, answer string, difficulty string")
    a = spark.createDataFrame([(1, "." * 210 + "key words", 0.5, 1.0, ["c"]), (3, "x", 0.5, 1.0, [])], "query_id bigint, predicted_answer string, confidence double, latency_ms double, cited array<string>")
    got = {r.query_id: (r.is_hit, len(r.predicted_answer), r.cited_chunks) for r in evaluate.eval_rows(q, a).collect()}
    assert got == {1: (True, 200, "c"), 2: (False, 0, ""), 3: (False, 1, "")}


def test_error_rows_tell_all_columns(spark):
    q = spark.createDataFrame([(1, "q" * 120, "abcdef", "simple", ["a", "b"])], "query_id bigint, query string, answer string, difficulty string, tags array<string>")
    hits = spark.createDataFrame([(1, "abcdef" * 40, 1.0, 1), (1, "zz", 0.5, 2)], "query_id bigint, text string, score double, rank int")
    r = evaluate.error_rows(q, hits).first()
    assert (len(r.query), r.reference, len(r.predicted), r.difficulty, r.tags, r.n_hits, r.avg_score, r.confidence, r.category, r.description) == (100, "abcdef", 100, "simple", "a|b", 2, 0.75, 1.0, "correct", evaluate.CATEGORIES["correct"])


@pytest.mark.parametrize("block, batch", [(4096, 4096), (3, 2)])
def test_semantic_chunks_against_a_fold(spark, monkeypatch, block, batch):
    """Sentences whose vectors tell where topics change, against a sequential form of the same steps; blocks of any size give the same."""
    monkeypatch.setattr(chunking, "BLOCK", block)
    monkeypatch.setattr(chunking, "FOLD_ROWS", batch)
    r = random.Random(7)
    texts = [" ".join(f"{'ab'[r.random() < 0.5]}{'x' * r.randint(3, 30)}." for _ in range(r.randint(2, 14))) for _ in range(12)] + ["", "one.", None]
    embed = lambda rows: rows.withColumn("embedding", F.when(F.col("text").startswith("a"), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))))

    def fold(text):
        sentences = [s.strip() + "." for s in (text or "").split(".") if s.strip()]
        if len(sentences) <= 1 or len(text) <= 30:
            return [text.strip()] if text and text.strip() else []
        parts = [sentences[0]]
        for a, b in zip(sentences, sentences[1:]):
            if a[0] == b[0]:
                parts[-1] += b
            else:
                parts.append(b)
        out, held = [], ""
        for p in parts:
            if len(held) < 30:
                held += p
            else:
                out.append(held)
                held = p
            while len(held) > 60:
                out.append(held[:60])
                held = held[60:]
        if held and len(held) < 30 and out:
            held = out.pop() + held
            while len(held) > 60:
                out.append(held[:60])
                held = held[60:]
        return out + ([held] if held else [])

    got = {}
    for c in chunking.chunk_semantic(docs(spark, *texts), embed, 0.5, 30, 60).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(c.doc_id, []).append(c.text)
    assert got == {i: want for i, t in enumerate(texts) if (want := fold(t))}


def test_sources_and_sinks_round_trip(spark, tmp_path):
    (tmp_path / "a.md").write_text("**规则A001：t**\nline two\n")
    (tmp_path / "b.md").write_text(" ")
    (tmp_path / "empty.md").write_text("")
    corpus = tables.read_corpus(spark, f"{tmp_path}/*.md").collect()
    assert sorted(r.text for r in corpus) == [" ", "**规则A001：t**\nline two\n"] and len({r.doc_id for r in corpus}) == 2
    (tmp_path / "1.jsonl").write_text('{"query": "q1", "answer": "a", "tags": ["t"], "difficulty": "simple", "reasoning_chain": ["r"]}\n\n')
    (tmp_path / "2.jsonl").write_text('{"query": "q2"}\n{"answer": "only"}\n')
    got = {(r.query, r.answer, r.difficulty, tuple(r.tags), tuple(r.reasoning_chain)) for r in tables.read_queries(spark, [f"{tmp_path}/1.jsonl", f"{tmp_path}/2.jsonl"]).collect()}
    assert got == {("q1", "a", "simple", ("t",), ("r",)), ("q2", "", "unknown", (), ()), ("", "only", "unknown", (), ())}

    chunks = docs(spark, "**规则A001：apple pear plum**\n参见规则B002 and more", "**规则B002：zzz yyy xxx**\nwords that nobody asks for").withColumn("chunk_index", F.lit(0))
    built, at = index.build_index(chunks), f"{tmp_path}/index"
    tables.write_index(built, at)
    loaded = tables.load_index(spark, at)
    assert set(loaded) == set(built) and all(sorted(map(str, loaded[n].select(*built[n].columns).collect())) == sorted(map(str, built[n].collect())) for n in built)
    q = spark.createDataFrame([(1, "apple")], "query_id bigint, query string")
    assert retrieval.bm25_search(q, loaded, 3).collect() == retrieval.bm25_search(q, built, 3).collect()
    expanded, plain = ({(r.doc_id, r.rank) for r in retrieval.retrieve_batch(q, loaded, 2, on).collect()} for on in (True, False))
    assert expanded == retrieval_set(retrieval.retrieve_batch(q, built, 2)) and (0, 1) in plain

    tables.export_graph(loaded["nodes"], loaded["edges"], f"{tmp_path}/graph")
    back = spark.read.option("header", True).option("multiLine", True).option("escape", "\\").csv(f"{tmp_path}/graph/edges")
    assert {(r.src, r.dst) for r in back.collect()} == {(r.src, r.dst) for r in built["edges"].collect()}
    rows = [("a \"b\", c", 1), ("line\nfeed", 2)]
    tables.write_results_csv(spark.createDataFrame(rows, "text string, n int"), f"{tmp_path}/csv")
    assert sorted((r.text, int(r.n)) for r in spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{tmp_path}/csv").collect()) == rows


def retrieval_set(hits):
    return {(r.doc_id, r.rank) for r in hits.collect()}


def test_nodes_of_chunks_and_references_beyond_the_cut(spark):
    far = "**规则A001：t**\n" + "很长的说明" * 60 + "。参见规则B002"
    chunks = spark.createDataFrame([(1, 0, far), (2, 0, "**规则B002：u 有足够长的正文内容在这里**")], "doc_id bigint, chunk_index int, text string")
    ref = lambda n: [(e.src, e.dst) for e in graph.build_graph(chunks, n)[1].where("weight = 0.9").collect()]
    assert ref(200) == [] and ref(None) == [("1:0:0", "2:0:0")]
    nodes = graph.build_graph(chunks)[0]
    assert {r.doc_id for r in graph.chunk_nodes(nodes, chunks.where("doc_id = 2")).collect()} == {2}


def test_chunk_nodes_query_gives_the_nodes_of_every_chunk(spark, tmp_path):
    from lodestone.jobs import queries

    spark.createDataFrame([(k, f"T{k % 3}", k, f"B{k % 2}") for k in range(1, 26)], "p_partkey bigint, p_type string, p_size int, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(r.node_id for r in queries.chunk_nodes(spark, str(tmp_path)).collect())
    nodes = graph.build_graph(queries.rule_chunks(spark, str(tmp_path)))[0]
    assert got == sorted(r.node_id for r in nodes.collect()) and {n.split(":")[0] for n in got} == {str(k) for k in range(1, 26)}


def test_evaluation(spark):
    rows = spark.createDataFrame([("simple", "a b", "a c"), ("multi_hop", "", ""), ("multi_hop", "x", "")], "difficulty string, pred string, ref string")
    m = {r.bucket: r for r in evaluate.bucket_metrics(evaluate.token_prf(rows)).collect()}
    assert m["simple"].precision == 0.5 and m["multi_hop"].recall == 0.5 and m["overall"].n == 3
    e = spark.createDataFrame([("abc", "abcdef", 3, 1.0), ("abcdef", "abcdef", 0, 1.0), ("abcdef", "abcdef", 1, 0.1), ("zzzzzz", "abcdef", 1, 1.0), ("abcdef", "abcdef", 1, 1.0)], "predicted string, reference string, n_hits int, confidence double")
    s = {r.category: r.n for r in evaluate.error_summary(evaluate.error_category(e)).collect()}
    assert s == {"generation_error": 1, "no_evidence": 1, "low_confidence": 1, "wrong_evidence": 1, "correct": 1, "total": 5}


def test_every_query_has_a_name_and_sql_of_it():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_a_hub_is_dealt_over_tasks(spark, monkeypatch):
    """One node with most of the edges: parts hold even shares, and walks are those of the whole list."""
    hub = spark.range(200_000).select(F.lit("hub").alias("src"), F.format_string("n%06d", "id").alias("dst"), F.lit("requires").alias("relation_type"), F.lit(0.8).alias("weight"), F.array(F.lit(1).cast("bigint"), "id").alias("ord"))
    few = spark.range(500).select(F.format_string("n%06d", F.col("id") * 7).alias("src"), F.lit("hub").alias("dst"), F.lit("requires").alias("relation_type"), F.lit(0.9).alias("weight"), F.array(F.lit(0).cast("bigint"), "id").alias("ord"))
    edges = hub.union(few)
    dealt, hubs = graph._dealt(edges)
    assert [tuple(r) for r in hubs.collect()] == [("hub", 10)]
    shares = [r["count"] for r in dealt.where("src = 'hub'").groupBy("part").count().collect()]
    assert len(shares) == 10 and max(shares) < 1.1 * min(shares)
    starts = spark.createDataFrame([("hub",), ("n000007",)], "node_id string")
    got = {(r.start, r.node, r.score, r.hops) for r in graph.neighbors(edges, starts, 2, 0.1).collect()}
    want = {("hub", f"n{k:06d}", 0.8, 1) for k in range(200_000)} | {("n000007", f"n{k:06d}", 0.72, 2) for k in range(200_000) if k != 7} | {("hub", "hub", 1.0, 0), ("n000007", "n000007", 1.0, 0), ("n000007", "hub", 0.9, 1)}
    assert got == want
    nodes = spark.createDataFrame([("hub", 1, 0, [1]), ("n000007", 2, 0, [2])], "node_id string, doc_id bigint, chunk_index int, ord array<bigint>")
    hits = spark.createDataFrame([(1, 2, 0, 1.0, 1)], "query_id bigint, doc_id bigint, chunk_index int, score double, rank int")
    walk = lambda: sorted(tuple(map(str, r)) for r in graph.graph_paths(hits, nodes, edges.where("dst < 'n001'  or dst = 'hub'"), 2).collect())
    monkeypatch.setattr(graph, "HUB_EDGES", 100)
    dealt_walk = walk()
    monkeypatch.setattr(graph, "HUB_EDGES", 10**9)
    assert len(dealt_walk) == 1001 and dealt_walk == walk()


def test_dense_search_in_blocks_against_numpy(spark, monkeypatch):
    """Blocks of a few vectors and queries, ties, a null vector and a key of text: the hits of one whole product."""
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 7)
    r = np.random.default_rng(5)
    v, q = r.integers(-3, 4, (200, 6)) / 4, r.integers(-3, 4, (23, 6)) / 4
    rows = [(f"d{n:03d}", n % 3, [float(x) for x in v[n]]) for n in range(200)] + [("none", 0, None)]
    vectors = spark.createDataFrame(rows, "name string, chunk_index int, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(n, [float(x) for x in q[n]]) for n in range(23)], "query_id bigint, embedding array<double>")
    found = retrieval.dense_search(asked, vectors, 9, ["name", "chunk_index"])
    got = {(x["query_id"], x["rank"]): (x["name"], x["chunk_index"], x["score"]) for x in found.collect()}
    scores = np.floor(v @ q.T * 1e6 + 0.5) / 1e6
    want = {}
    for n in range(23):
        for rank, d in enumerate(sorted(range(200), key=lambda d: (-scores[d, n], d))[:9], 1):
            want[n, rank] = (f"d{d:03d}", d % 3, scores[d, n])
    assert got == want
    final = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("BroadcastNestedLoopJoin") == 1 and "CartesianProduct" not in final
    assert retrieval.dense_search(asked.limit(0), vectors, 9, ["name", "chunk_index"]).count() == retrieval.dense_search(asked, vectors.limit(0), 9, ["name", "chunk_index"]).count() == 0
