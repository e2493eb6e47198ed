"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import bpe, chat_format, embedding_dedup, fill_in_middle, line_dedup, packing, pii, quality_classifier, quality_rules, runs, secret_scan, simhash, toxicity
from ledgerlens.llm.frames import documents
from ledgerlens.plans.registry import Registry
from ledgerlens.sources.tables import table

registry = Registry()


@registry.add("op1_secret_scan")
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digest(documents(spark, sf_dir))


@registry.add("op3_simhash_near_dedup")
def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


@registry.add("op7_quality_rules")
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir))


@registry.add("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@registry.add("op10_best_fit_packing")
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_tokens(documents(spark, sf_dir))


@registry.add("op9_pii")
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(documents(spark, sf_dir))


@registry.add("op8_byte_level_bpe")
def op8_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir))


@registry.add("op2_quality_classifier")
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


@registry.add("op4_embedding_near_dedup")
def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


@registry.add(
    "op5_chat_formatting",
    """
    SELECT conv_id, turn AS at_turn, -1 AS at_call, 0 AS step, turn, 'message' AS kind, NULL::VARCHAR AS call_id, NULL::VARCHAR AS status, '[]' AS errors,
           '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || '}' AS json
    FROM conversations
    """,
)
def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL holds while the given table has plain messages only, which a test checks."""
    return _chat_digest(chat_format.format_chats(table(spark, sf_dir, "conversations")))


@registry.add(
    "chat_tool_dialogues",
    """
    WITH t AS (
        SELECT conv_id, turn, role, coalesce(text, '') AS text, length(coalesce(text, '')) AS chars, len(string_split(coalesce(text, ''), ' ')) AS words FROM conversations
    ), calls AS (
        SELECT *, CASE WHEN chars < 100 THEN 'short' WHEN chars < 600 THEN 'long' ELSE 'huge' END AS size FROM t WHERE role = 'assistant'
    ), spoken AS (
        SELECT conv_id, turn * 3 AS at_turn, -2 AS at_call, 0 AS step, turn * 3 AS turn, 'tool_definition' AS kind, NULL AS call_id, 'defined' AS status, '[]' AS errors,
               '{"definition":{"name":"measure","parameters":{"additionalProperties":false,"properties":{"chars":{"maximum":400,"type":["integer","null"]},"size":{"enum":["short","long"]},"words":{"items":{"properties":{"n":{"minimum":20,"type":"integer"}}},"type":"array"}},"required":["chars","size"]}},"type":"tool_definition"}' AS json
        FROM t WHERE turn = 0
        UNION ALL
        SELECT conv_id, turn * 3, -1, 0, turn * 3, 'message', NULL, NULL, '[]', '{"content":null,"role":"system"}' FROM t WHERE turn = 0
        UNION ALL
        SELECT conv_id, turn * 3 + 1, -1, 0, turn * 3 + 1, 'message', NULL, NULL, '[]', '{"content":' || to_json(text)::VARCHAR || ',"role":' || to_json(role)::VARCHAR || '}' FROM t
        UNION ALL
        SELECT c.conv_id, c.turn * 3 + 1, 0, 1, c.turn * 3 + 1, 'tool_call', 'c' || c.turn, CASE WHEN u.turn IS NULL THEN 'open' ELSE 'linked' END,
               '[' || concat_ws(',', CASE WHEN size = 'huge' THEN '"enum size"' END, CASE WHEN c.chars > 400 THEN '"maximum chars"' END, CASE WHEN c.words < 20 THEN '"minimum words[0].n"' END) || ']',
               '{"arguments":{"chars":' || c.chars || ',"size":"' || size || '","words":[{"n":' || c.words || '}]},"id":"c' || c.turn || '","name":"measure","type":"tool_call"}'
        FROM calls c LEFT JOIN (SELECT DISTINCT conv_id, turn FROM t WHERE role = 'user') u ON u.conv_id = c.conv_id AND u.turn = c.turn + 1
        UNION ALL
        SELECT u.conv_id, CASE WHEN c.turn IS NULL THEN u.turn * 3 + 2 ELSE c.turn * 3 + 1 END, CASE WHEN c.turn IS NULL THEN -1 ELSE 0 END, 2, u.turn * 3 + 2, 'tool_result',
               'c' || (u.turn - 1), CASE WHEN c.turn IS NULL THEN 'orphan' ELSE 'linked' END, '[]',
               '{"content":{"chars":' || u.chars || '},"tool_call_id":"c' || (u.turn - 1) || '","type":"tool_result"}'
        FROM t u LEFT JOIN (SELECT DISTINCT conv_id, turn FROM calls) c ON c.conv_id = u.conv_id AND c.turn = u.turn - 1 WHERE u.role = 'user'
    )
    SELECT * FROM spoken
    """,
)
def chat_tool_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of the table as a dialogue with a tool, so that definitions, calls and results meet."""
    return _chat_digest(chat_format.format_chats(chat_format.tool_dialogues(table(spark, sf_dir, "conversations"))))


def _chat_digest(records: DataFrame) -> DataFrame:
    return records.withColumn("errors", F.to_json("errors"))


@registry.add(
    "op11_line_dedup",
    """
    WITH raw_lines AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
        FROM documents
    ), lines AS (
        SELECT doc_id, pos, line,
               translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
        FROM raw_lines
    ), shared AS (
        SELECT line_key, min(doc_id) AS keeper FROM lines WHERE length(line_key) >= 10 GROUP BY line_key HAVING count(DISTINCT doc_id) >= 2
    ), marked AS (
        SELECT l.doc_id, l.pos, l.line, s.keeper IS NOT NULL AND s.keeper <> l.doc_id AS dropped FROM lines l LEFT JOIN shared s USING (line_key)
    )
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
    """,
)
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(documents(spark, sf_dir))


@registry.add(
    "op12_fill_in_middle",
    """
    WITH drawn AS (
        SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents
    ), numbers AS (
        SELECT doc_id, text, n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
               ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
        FROM drawn
    ), cut AS (
        SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
               CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
        FROM numbers
    ), parts AS (
        SELECT *, substring(text, 1, a) AS pre, substring(text, a + 1, b - a) AS mid, substring(text, b + 1) AS suf FROM cut
    )
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
           sha256(text) AS restored_sha256
    FROM parts
    """,
)
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digest(documents(spark, sf_dir))


@registry.add("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(documents(spark, sf_dir))
