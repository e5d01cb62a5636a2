"""What stands around a model's answer: prompts from evidence, parsing of responses, and the confidence gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Own wording; other wordings are parameters.
NO_EVIDENCE = "抱歉，没有找到相关的证据。"


def evidence_prompt(queries: DataFrame, hits: DataFrame, no_evidence: str = NO_EVIDENCE) -> DataFrame:
    """(query_id, prompt, n_evidence): numbered evidence in rank order and the question; an apology without evidence.

    hits has query_id, chunk_id, text and rank.
    """
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "text"))), lambda h, i: F.concat(F.lit("[证据"), (i + 1).cast("string"), F.lit("] ID: "), h["chunk_id"], F.lit("\n内容: "), h["text"], F.lit("\n")))
    evidence = hits.groupBy("query_id").agg(F.array_join(listed, "\n").alias("evidence"), F.count("*").alias("n_evidence"))
    prompt = F.when(F.col("evidence").isNull(), F.lit(no_evidence)).otherwise(F.concat(F.col("evidence"), F.lit("\n问题: "), F.col("query")))
    return queries.select("query_id", "query").join(evidence, "query_id", "left").select("query_id", prompt.alias("prompt"), F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"))


def parse_responses(df: DataFrame, col: str = "response") -> DataFrame:
    """df with answer, cited_chunks, confidence.

    A text that is one JSON object gives its fields (defaults: empty, none, 0.5); else, with text around it or after it,
    the first flat {...} in the text does (defaults: the text, none, 0.3); else the text itself stands with 0.3. Of a
    repeated field the last counts. An answer that is null, true or false reads None, True or False; a confidence of true
    or false is 1 or 0; citations that are a text or an object are its characters or its keys. JSON that isn't an object,
    a confidence that is no number and citations of other kinds are an error answer with 0, nulls there too; a field that
    isn't there takes the default. NaN and Infinity are no JSON here, so a text with them stands as it is; an answer that
    is a list or object reads as its JSON. A null response counts as empty text. Leaves
    spark.sql.variant.allowDuplicateKeys on in the session.
    """
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    schema = "answer string, cited_chunks array<string>, confidence_score string"
    raw = F.coalesce(F.col(col), F.lit(""))
    kind = lambda c: F.schema_of_variant(F.try_parse_json(c))
    kind_of = lambda k: F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json("_json"), f"$.{k}", "variant")), F.lit(""))
    # the parser stops behind the first value; alone inside brackets of both kinds, a text is one value and no more
    whole = T.strip(raw)
    listed, named = F.concat(F.lit("["), whole, F.lit("]")), F.concat(F.lit('{"v":'), whole, F.lit("}"))
    one = (F.json_array_length(listed) == 1) & (F.size(F.json_object_keys(named)) == 1) & kind(listed).isNotNull() & kind(named).isNotNull()
    block = F.regexp_extract(raw, "(?s)\\{[^{}]*\\}", 0)
    rows = df.withColumns({"_raw": raw, "_kind": F.when(one, kind(whole)), "_block": block, "_block_kind": kind(block)})
    rows = rows.withColumn("_from", F.when(F.col("_kind").isNotNull(), F.when(F.col("_kind").startswith("OBJECT"), 1).otherwise(0)).when(F.col("_block_kind").startswith("OBJECT"), 2).otherwise(3))
    rows = rows.withColumn("_json", F.when(F.col("_from") == 1, whole).when(F.col("_from") == 2, F.col("_block")))
    rows = rows.withColumns({
        "_d": F.from_json("_json", schema), "_plain": F.from_json("_json", "cited_chunks string")["cited_chunks"], "_keys": F.coalesce(F.json_object_keys("_json"), F.array().cast("array<string>")),
        "_answer": kind_of("answer"), "_cited": kind_of("cited_chunks"), "_sure": kind_of("confidence_score"),
    })
    truth = lambda k, yes, no: F.when(F.col(f"_d.{k}") == "true", yes).otherwise(no)
    number = F.when(F.col("_sure") == "BOOLEAN", truth("confidence_score", 1.0, 0.0)).otherwise(F.expr("try_cast(_d.confidence_score as double)"))
    none_cited = F.array().cast("array<string>")
    cited = (
        F.when(F.col("_cited").startswith("ARRAY"), F.col("_d.cited_chunks"))
        .when(F.col("_cited") == "STRING", F.when(F.col("_plain") == "", none_cited).otherwise(F.split("_plain", "")))
        .when(F.col("_cited").startswith("OBJECT"), F.array_distinct(F.json_object_keys("_plain")))
    )
    has = lambda k: F.array_contains("_keys", k)
    bad = (F.col("_from") == 0) | (has("confidence_score") & number.isNull()) | (has("cited_chunks") & cited.isNull())
    said = F.when(F.col("_answer") == "BOOLEAN", truth("answer", "True", "False")).otherwise(F.col("_d.answer"))
    none = F.when(has("answer"), "None").when(F.col("_from") == 1, "").otherwise(F.col("_raw"))
    default = F.when(F.col("_from") == 1, 0.5).otherwise(0.3)
    return rows.withColumns({
        "answer": F.when(bad, F.lit("error")).otherwise(F.coalesce(said, none)),
        "cited_chunks": F.when(bad, none_cited).otherwise(F.coalesce(cited, none_cited)),
        "confidence": F.when(bad, 0.0).otherwise(F.coalesce(number, default)),
    }).drop("_raw", "_kind", "_block", "_block_kind", "_from", "_json", "_d", "_plain", "_keys", "_answer", "_cited", "_sure")


def confidence_gate(generated: DataFrame, hits: DataFrame, low: float = 0.4, high: float = 0.7) -> DataFrame:
    """(query_id, confidence, should_clarify, clarification, warning).

    generated has query_id, cited_chunks and confidence (the model's own); hits query_id, chunk_id, score and rank. The
    final confidence is 0.4 of the model's, 0.3 of the share of hits that are cited and 0.3 of the first three's mean score.
    """
    found = hits.groupBy("query_id").agg(F.collect_set("chunk_id").alias("ids"), F.count("*").alias("n"), F.avg(F.when(F.col("rank") <= 3, F.col("score"))).alias("top"))
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    j = generated.select("query_id", "cited_chunks", F.col("confidence").alias("own")).join(found, "query_id", "left")
    coverage = F.coalesce(F.size(F.array_intersect("cited_chunks", "ids")) / F.col("n"), F.lit(0.0))
    final = T.fixed(clip(0.4 * F.col("own") + 0.3 * coverage + 0.3 * clip(F.coalesce("top", F.lit(0.0)))))
    shown = F.format_string("%.2f", T.fixed(F.col("confidence"), 2))
    clarify = F.col("confidence") < low
    return j.select("query_id", final.alias("confidence")).select(
        "query_id", "confidence", clarify.alias("should_clarify"),
        F.when(clarify, F.concat(F.lit("答案置信度较低（"), shown, F.lit("），请提供更具体的问题。"))).alias("clarification"),
        F.when(~clarify & (F.col("confidence") < high), F.concat(F.lit("答案置信度为 "), shown, F.lit("，请验证关键信息。"))).alias("warning"),
    )
