"""Registered queries: scalar text / prompt / payload functions, sources
and sinks, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate as E
from ..session import new_folder
from ..sources import items as S
from ..sources import sinks as K
from ..sources import tables as tb
from .evaluation import eval_results
from .sqlbits import EVAL_RESULTS, duckdb_with, strip, yes_no

QUERIES: dict = {}
SQL: dict = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


IMG_DIR = "/data/mc/extracted_images"
LOCAL_BASE = "/data/pages"

# DuckDB: guided choices of a JSON answers string (objects or strings).
_GC_ELEMS = ("list_transform(CASE WHEN starts_with({t}, '{{') THEN [{t}::JSON] "
             "WHEN json_valid({s}) THEN from_json({s}, '[\"JSON\"]') END, "
             "lambda e: lower(" + strip("CASE WHEN json_type(e) = 'OBJECT' THEN json_extract_string(e, '$.answer') "
                                        "WHEN json_type(e) = 'VARCHAR' THEN json_extract_string(e, '$') "
                                        "WHEN json_type(e) IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'BOOLEAN') THEN CAST(e AS VARCHAR) END") + "))")


def gc_sql(s: str) -> str:
    elems = _GC_ELEMS.format(s=s, t=strip(s))
    arr = f"list_sort(list_distinct(list_filter({elems}, lambda e: e IS NOT NULL AND length(e) > 0)))"
    return f"(CASE WHEN len({arr}) > 0 THEN {arr} END)"


# ------------------------------------------------------------------ F1
@register("null_to_empty", duckdb_with("mc_items") + """
SELECT idx, coalesce(hint, '') AS hint, coalesce(D, '') AS D FROM mc_items""")
def q_null_to_empty(spark, sf):
    m = tb.mc_items(spark, sf)
    return m.select("idx", T.null_to_empty("hint").alias("hint"), T.null_to_empty("D").alias("D"))


# ------------------------------------------------------------------ F2
@register("mc_prompt", duckdb_with("mc_items") + """
SELECT idx, 'Question: ' || coalesce(question, '') || chr(10) || chr(10) || 'Hint: ' || coalesce(hint, '')
  || chr(10) || chr(10) || 'Options:' || chr(10) || 'A) ' || coalesce(A, '') || chr(10) || 'B) ' || coalesce(B, '')
  || chr(10) || 'C) ' || coalesce(C, '') || chr(10) || 'D) ' || coalesce(D, '') || chr(10) || chr(10)
  || 'Please analyze the image and answer the question.' AS prompt FROM mc_items""")
def q_mc_prompt(spark, sf):
    m = tb.mc_items(spark, sf)
    return m.select("idx", T.mc_prompt("question", "hint", "A", "B", "C", "D").alias("prompt"))


# ------------------------------------------------------------------ F3 / F4
_TPL = "props || ' {} {' || event_type || '}'"


@register("template_fields", f"""
SELECT event_id, regexp_extract_all({_TPL}, '\\{{(.*?)\\}}', 1) AS fields FROM events""")
def q_template_fields(spark, sf):
    e = tb.raw(spark, sf, "events")
    tpl = F.concat(F.col("props"), F.lit(" {} {"), F.col("event_type"), F.lit("}"))
    return e.select("event_id", T.template_fields(tpl).alias("fields"))


@register("template_fields_strict", f"""
SELECT event_id, regexp_extract_all({_TPL}, '\\{{([^}}]+)\\}}', 1) AS fields FROM events""")
def q_template_fields_strict(spark, sf):
    e = tb.raw(spark, sf, "events")
    tpl = F.concat(F.col("props"), F.lit(" {} {"), F.col("event_type"), F.lit("}"))
    return e.select("event_id", T.template_fields_strict(tpl).alias("fields"))


# ------------------------------------------------------------------ F5
@register("template_render", duckdb_with("mc_items") + """
SELECT idx, replace(replace('Is {question} a kind of {hint}? {question}', '{question}', coalesce(question, '')),
                    '{hint}', coalesce(hint, '')) AS prompt FROM mc_items""")
def q_template_render(spark, sf):
    m = tb.mc_items(spark, sf)
    return m.select("idx", T.template_render("Is {question} a kind of {hint}? {question}",
                                             {"question": "question", "hint": "hint"}).alias("prompt"))


# ------------------------------------------------------------------ F6
_LBL = "'text: ' || text || ' | text: tail'"


@register("strip_label", f"""
SELECT conv_id, turn, CASE WHEN instr({_LBL}, 'text: ') > 0
  THEN substr({_LBL}, 1, instr({_LBL}, 'text: ') - 1) || substr({_LBL}, instr({_LBL}, 'text: ') + 6)
  ELSE {_LBL} END AS text FROM conversations""")
def q_strip_label(spark, sf):
    c = tb.raw(spark, sf, "conversations")
    v = F.concat(F.lit("text: "), F.col("text"), F.lit(" | text: tail"))
    return c.select("conv_id", "turn", T.strip_label(v, "text").alias("text"))


# ------------------------------------------------------------------ F7
@register("strip_label_split", duckdb_with("eval_log") + f"""
SELECT test_number, CASE WHEN instr(generated_text || category, ':') > 0
  THEN {strip("substr(generated_text || category, instr(generated_text || category, ':') + 1)")}
  ELSE generated_text || category END AS value FROM eval_log""")
def q_strip_label_split(spark, sf):
    e = tb.eval_log(spark, sf)
    return e.select("test_number", T.strip_label_split(F.concat("generated_text", "category")).alias("value"))


# ------------------------------------------------------------------ F8
@register("normalise_answer", duckdb_with("responses") + f"""
SELECT question_id, lower({strip('content')}) AS lower_answer, upper(replace({strip('content')}, 'ß', 'SS')) AS upper_answer
FROM responses""")
def q_normalise_answer(spark, sf):
    r = tb.responses(spark, sf)
    return r.select("question_id", T.normalise_answer("content", "lower").alias("lower_answer"),
                    T.normalise_answer("content", "upper").alias("upper_answer"))


# ------------------------------------------------------------------ F11 / F12
_NAME = "CASE WHEN page_id % 5 = 0 THEN 'dir/sub\\name' || CAST(page_id % 3 AS VARCHAR) ELSE url END"
_PAY = ("CASE WHEN page_id % 4 = 1 THEN unhex('89504E470D0A1A0A') || encode(html) "
        "WHEN page_id % 4 = 2 THEN unhex('FFD8FFE0') || encode(html) ELSE encode(html) END")
_SNIFF = ("CASE WHEN starts_with(hex(p), '89504E470D0A1A0A') THEN 'png' WHEN starts_with(hex(p), 'FFD8FF') THEN 'jpg' "
          "WHEN starts_with(hex(p), '474946383761') OR starts_with(hex(p), '474946383961') THEN 'gif' "
          "WHEN starts_with(hex(p), '424D') THEN 'bmp' "
          "WHEN starts_with(hex(p), '52494646') AND substr(hex(p), 17, 8) = '57454250' THEN 'webp' END")


def _named_pages(spark, sf):
    p = tb.raw(spark, sf, "pages")
    name = F.when(F.col("page_id") % 5 == 0,
                  F.concat(F.lit("dir/sub\\name"), (F.col("page_id") % 3).cast("string"))).otherwise(F.col("url"))
    html = F.col("html").cast("binary")
    pay = (F.when(F.col("page_id") % 4 == 1, F.concat(F.unhex(F.lit("89504E470D0A1A0A")), html))
           .when(F.col("page_id") % 4 == 2, F.concat(F.unhex(F.lit("FFD8FFE0")), html)).otherwise(html))
    return p.select("page_id", name.alias("name"), pay.alias("payload"))


_NAMED_SQL = f"named AS (SELECT page_id, {_NAME} AS name, {_PAY} AS payload FROM pages)"
_SAFE = ("CASE WHEN regexp_matches(lower(regexp_replace(name, '[/\\\\]', '_', 'g')), '\\.(jpg|jpeg|png|gif|bmp|webp)$') "
         "THEN regexp_replace(name, '[/\\\\]', '_', 'g') "
         "ELSE regexp_replace(name, '[/\\\\]', '_', 'g') || '.' || coalesce(" + _SNIFF.replace("(p)", "(payload)") + ", 'jpg') END")


@register("sniff_format", f"WITH {_NAMED_SQL} SELECT page_id, "
          + _SNIFF.replace("(p)", "(payload)") + " AS format FROM named")
def q_sniff_format(spark, sf):
    n = _named_pages(spark, sf)
    return n.select("page_id", T.sniff_format("payload").alias("format"))


@register("safe_filename", f"WITH {_NAMED_SQL} SELECT page_id, {_SAFE} AS file_name FROM named")
def q_safe_filename(spark, sf):
    n = _named_pages(spark, sf)
    return n.select("page_id", T.safe_filename("name", "payload").alias("file_name"))


# ------------------------------------------------------------------ F15 / F16 / F17 / F18
@register("guided_choices", duckdb_with("mc_items") + f"""
SELECT idx, {gc_sql('answers')} AS choices FROM mc_items""")
def q_guided_choices(spark, sf):
    m = tb.mc_items(spark, sf)
    return m.select("idx", T.guided_choices("answers").alias("choices"))


# answers column varied: array, object, empty, invalid, null
VARIED_ANSWERS_SQL = ("CASE idx % 5 WHEN 0 THEN answers WHEN 1 THEN '{\"answer\":\"' || B || '\"}' WHEN 2 THEN '' "
            "WHEN 3 THEN 'bad' ELSE NULL END")


def varied_answers(m):
    return (F.when(F.col("idx") % 5 == 0, F.col("answers"))
            .when(F.col("idx") % 5 == 1, F.concat(F.lit('{"answer":"'), F.col("B"), F.lit('"}')))
            .when(F.col("idx") % 5 == 2, F.lit("")).when(F.col("idx") % 5 == 3, F.lit("bad")))


@register("guided_choices_label", duckdb_with("mc_items") + f"""
, g AS (SELECT idx, {gc_sql(VARIED_ANSWERS_SQL)} AS ch FROM mc_items)
SELECT idx, CASE WHEN coalesce(len(ch), 0) > 0 THEN '[''' || array_to_string(ch, ''', ''') || ''']'
            ELSE '[''yes'', ''no'']' END AS guided_choices_used FROM g""")
def q_guided_choices_label(spark, sf):
    m = tb.mc_items(spark, sf)
    ch = T.guided_choices(varied_answers(m))
    return m.select("idx", T.guided_choices_label(ch).alias("guided_choices_used"))


@register("default_choices", duckdb_with("mc_items") + f"""
, g AS (SELECT idx, {gc_sql(VARIED_ANSWERS_SQL)} AS ch FROM mc_items)
SELECT idx, CASE WHEN coalesce(len(ch), 0) > 0 THEN ch ELSE ['yes', 'no'] END AS choices FROM g""")
def q_default_choices(spark, sf):
    m = tb.mc_items(spark, sf)
    return m.select("idx", T.default_choices(T.guided_choices(varied_answers(m))).alias("choices"))


_GTEXT = "lower(question || ' ' || coalesce(hint, ''))"


@register("parse_guided", duckdb_with("mc_items") + f"""
, g AS (SELECT idx, question || ' ' || coalesce(hint, '') AS txt, {gc_sql(VARIED_ANSWERS_SQL)} AS ch FROM mc_items)
SELECT idx, CASE WHEN coalesce(len(ch), 0) > 0 THEN
   {strip(f"coalesce({strip('lower(list_filter(ch, lambda c: instr(lower(' + strip('txt') + '), ' + strip('lower(c)') + ') > 0)[1])')}, lower({strip('txt')}))")}
 ELSE {strip(yes_no('txt'))} END AS predicted_answer FROM g""")
def q_parse_guided(spark, sf):
    m = tb.mc_items(spark, sf)
    txt = F.concat(F.col("question"), F.lit(" "), T.null_to_empty("hint"))
    return m.select("idx", T.parse_guided(txt, T.guided_choices(varied_answers(m))).alias("predicted_answer"))


# ------------------------------------------------------------------ F21
_Q_JSON = "CAST(to_json(question) AS VARCHAR)"


@register("request_payload", duckdb_with("questions") + """
SELECT question_id, '{"model":"model","messages":[{"role":"system","content":"You are a helpful assistant."},{"role":"user","content":['
  || '{"type":"image_embeds","image_embeds":' || CAST(to_json('emb:' || CAST(image_id AS VARCHAR)) AS VARCHAR)
  || ',"uuid":' || CAST(to_json(CAST(image_id AS VARCHAR)) AS VARCHAR) || '},'
  || '{"type":"text","text":' || CAST(to_json(question) AS VARCHAR) || '}'
  || ']}],"max_tokens":1024,"temperature":0,"guided_choice":["yes","no"]}' AS payload FROM questions""")
def q_request_payload(spark, sf):
    q = tb.questions(spark, sf)
    ref = F.concat(F.lit("emb:"), F.col("image_id").cast("string"))
    none = F.lit(None).cast("array<string>")
    return q.select("question_id", T.request_payload(F.col("question"), ref, uuid=F.col("image_id"),
                                                     guided_choice=none, embeds_first=True).alias("payload"))


# ------------------------------------------------------------------ F24
@register("preview_text", """
SELECT doc_id, left(text, 100) AS preview_100, left(text, 200) AS preview_200 FROM documents""")
def q_preview_text(spark, sf):
    d = tb.raw(spark, sf, "documents")
    return d.select("doc_id", T.preview_text("text", 100).alias("preview_100"),
                    T.preview_text("text", 200).alias("preview_200"))


# ------------------------------------------------------------------ F25 (time-dependent: rows only)
@register("stamp")
def q_stamp(spark, sf):
    e = tb.eval_log(spark, sf)
    return e.select("test_number", T.stamp("record").alias("timestamp"), T.stamp("file").alias("file_stamp"))


# ------------------------------------------------------------------ U6
@register("choice_guard", duckdb_with("eval_log") + f"""
, p AS (SELECT test_number, {yes_no('generated_text')} AS ans FROM eval_log)
SELECT test_number, ans, coalesce(list_contains(['yes', 'no'], ans), false) AS allowed FROM p""")
def q_choice_guard(spark, sf):
    e = tb.eval_log(spark, sf)
    ans = T.parse_yes_no("generated_text")
    return e.select("test_number", ans.alias("ans"),
                    T.choice_guard(ans, F.lit(None).cast("array<string>")).alias("allowed"))


# ------------------------------------------------------------------ U5 (long form: no per-conversation collect)
@register("chat_messages", """
SELECT conv_id, turn, role, text AS content,
       (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS position,
       role <> 'system' AS kept_without_system FROM conversations""")
def q_chat_messages(spark, sf):
    from ..operators.semantic import chat_messages_long
    return chat_messages_long(tb.raw(spark, sf, "conversations"))


# ------------------------------------------------------------------ S1
@register("scan_items", duckdb_with("mc_items") + """
SELECT idx AS "index", question, hint, answer, A, B, C, D FROM mc_items""")
def q_scan_items(spark, sf):
    return S.scan_items(tb.mc_items(spark, sf), rename={"index": "idx"})


# ------------------------------------------------------------------ S2
@register("scan_with_defaults", duckdb_with("questions") + """
SELECT question_id, question, 'unknown' AS category,
       'image_' || CAST(row_number() OVER (ORDER BY question_id) - 1 AS VARCHAR) AS image_source FROM questions""")
def q_scan_with_defaults(spark, sf):
    q = tb.questions(spark, sf).select("question_id", "question")
    return S.scan_with_defaults(q, "question_id", {"question_id": "q_", "category": "unknown",
                                                   "image_source": "image_", "question": ""})


# ------------------------------------------------------------------ S3
_VARIANT = ("CASE page_id % 4 WHEN 0 THEN {'bytes': encode(html), 'data': NULL::BLOB, 'binary': NULL::BLOB} "
            "WHEN 1 THEN {'bytes': NULL::BLOB, 'data': encode(html), 'binary': NULL::BLOB} "
            "WHEN 2 THEN {'bytes': NULL::BLOB, 'data': NULL::BLOB, 'binary': encode(html)} "
            "ELSE {'bytes': NULL::BLOB, 'data': NULL::BLOB, 'binary': NULL::BLOB} END")


@register("payload_extract", f"""
WITH v AS (SELECT page_id, {_VARIANT} AS image FROM pages),
x AS (SELECT page_id, coalesce(image.bytes, image.data, image.binary) AS p FROM v)
SELECT page_id, octet_length(p)::BIGINT AS n_bytes,
       CASE WHEN p IS NULL THEN 'error: unsupported payload' ELSE 'ok' END AS status FROM x""")
def q_payload_extract(spark, sf):
    p = tb.raw(spark, sf, "pages")
    html = F.col("html").cast("binary")
    nb = F.lit(None).cast("binary")
    m = F.col("page_id") % 4
    variant = F.struct(F.when(m == 0, html).otherwise(nb).alias("bytes"),
                       F.when(m == 1, html).otherwise(nb).alias("data"),
                       F.when(m == 2, html).otherwise(nb).alias("binary"))
    x = p.select("page_id", S.payload_extract(variant).alias("p"))
    return x.select("page_id", F.octet_length("p").cast("bigint").alias("n_bytes"),
                    S.payload_status(F.col("p")).alias("status"))


# ------------------------------------------------------------------ S4 / J4
@register("image_path_lookup", duckdb_with("mc_items") + f"""
SELECT idx, CASE WHEN idx IS NULL OR idx = 0 THEN ''
  ELSE '{IMG_DIR}/' || CAST(row_number() OVER (ORDER BY idx) - 1 AS VARCHAR) || '.jpg' END AS sample_image_path
FROM mc_items""")
def q_image_path_lookup(spark, sf):
    m = tb.mc_items(spark, sf).select("idx")
    return S.image_path_lookup(m, "idx", "idx", IMG_DIR)


# ------------------------------------------------------------------ S5
_LOCAL = "CASE WHEN page_id % 2 = 0 THEN url WHEN page_id % 3 = 0 THEN '/abs/' || CAST(page_id AS VARCHAR) || '.png' ELSE 'rel/' || CAST(page_id AS VARCHAR) || '.jpg' END"


@register("file_url", f"""
WITH p AS (SELECT page_id, {_LOCAL} AS path FROM pages)
SELECT page_id, CASE WHEN regexp_matches(path, '^https?://') THEN path
  ELSE 'file://' || CASE WHEN starts_with(path, '/') THEN path ELSE '{LOCAL_BASE}/' || path END END AS url FROM p""")
def q_file_url(spark, sf):
    p = tb.raw(spark, sf, "pages")
    path = (F.when(F.col("page_id") % 2 == 0, F.col("url"))
            .when(F.col("page_id") % 3 == 0, F.concat(F.lit("/abs/"), F.col("page_id").cast("string"), F.lit(".png")))
            .otherwise(F.concat(F.lit("rel/"), F.col("page_id").cast("string"), F.lit(".jpg"))))
    return p.select("page_id", S.file_url(path, LOCAL_BASE).alias("url"))


# ------------------------------------------------------------------ S6
@register("data_url", f"""
WITH p AS (SELECT page_id, {_LOCAL} AS path, encode(html) AS payload FROM pages)
SELECT page_id, 'data:image/' || CASE WHEN ends_with(lower(path), '.png') THEN 'png'
   WHEN ends_with(lower(path), '.jpg') OR ends_with(lower(path), '.jpeg') THEN 'jpeg'
   WHEN ends_with(lower(path), '.gif') THEN 'gif' WHEN ends_with(lower(path), '.webp') THEN 'webp' ELSE 'jpeg' END
   || ';base64,' || to_base64(payload) AS data_url FROM p""")
def q_data_url(spark, sf):
    p = tb.raw(spark, sf, "pages")
    path = (F.when(F.col("page_id") % 2 == 0, F.col("url"))
            .when(F.col("page_id") % 3 == 0, F.concat(F.lit("/abs/"), F.col("page_id").cast("string"), F.lit(".png")))
            .otherwise(F.concat(F.lit("rel/"), F.col("page_id").cast("string"), F.lit(".jpg"))))
    return p.select("page_id", S.data_url(path, F.col("html").cast("binary")).alias("data_url"))


# ------------------------------------------------------------------ K1 / K3
_PROJ_SQL = duckdb_with("eval_log") + ", " + EVAL_RESULTS + """
SELECT test_number, '' AS total_tests, '' AS sample_image_path, '' AS "timestamp", embed_time, api_call_time,
       total_time, api_success, generated_text, predicted_answer, is_correct, '' AS error_message,
       '' AS full_response, '' AS model_path, '' AS original_token, pruned_token, '' AS api_url, '' AS method,
       '' AS preprocess_time, '' AS encode_time, '' AS project_time, '' AS prune_time{extra} FROM results"""


def _through_csv(spark, results, write, keys=()):
    path, schema = new_folder(spark, "results"), K.results_projection(results, extra=keys).schema
    return K.read_results_csv(spark, path, schema) if write(results, path) else spark.createDataFrame([], schema)


@register("results_projection", _PROJ_SQL.format(extra=""))
def q_results_projection(spark, sf):
    """The rows read back from the written CSV."""
    return _through_csv(spark, eval_results(spark, sf), K.write_results_csv)


@register("combined_results", _PROJ_SQL.format(extra=", keep_ratio, recovery_ratio"))
def q_combined_results(spark, sf):
    return K.results_projection(eval_results(spark, sf), extra=("keep_ratio", "recovery_ratio"))


@register("write_per_config", _PROJ_SQL.format(extra=", keep_ratio, recovery_ratio"))
def q_write_per_config(spark, sf):
    """The rows read back from the folders of all configurations."""
    return _through_csv(spark, eval_results(spark, sf), K.write_per_config, ("keep_ratio", "recovery_ratio"))


# ------------------------------------------------------------------ K4
@register("summary_text", duckdb_with("eval_log") + ", " + EVAL_RESULTS + """
, s AS (SELECT keep_ratio, recovery_ratio, count(*) AS n, count(*) FILTER (WHERE api_success) AS n_success,
        count(*) FILTER (WHERE api_success AND is_correct) AS n_correct,
        round(count(*) FILTER (WHERE api_success AND is_correct) / nullif(count(*) FILTER (WHERE api_success), 0), 6) AS accuracy,
        round(avg(embed_time) FILTER (WHERE api_success), 6) AS avg_embed_time,
        round(avg(api_call_time) FILTER (WHERE api_success), 6) AS avg_api_time,
        round(avg(pruned_token) FILTER (WHERE api_success), 6) AS avg_pruned_tokens,
        round((576.0 - avg(pruned_token) FILTER (WHERE api_success)) / 576.0 * 100.0, 6) AS token_reduction_pct
        FROM results GROUP BY 1, 2)
SELECT keep_ratio, recovery_ratio,
  'keep_ratio=' || CAST(keep_ratio AS VARCHAR) || ', recovery_ratio=' || CAST(recovery_ratio AS VARCHAR) || chr(10)
  || 'Samples: ' || CAST(n AS VARCHAR) || chr(10) || 'Successful: ' || CAST(n_success AS VARCHAR) || chr(10)
  || 'Accuracy: ' || printf('%.2f%%', round(accuracy * 100, 2)) || ' (' || CAST(n_correct AS VARCHAR) || '/' || CAST(n_success AS VARCHAR) || ')' || chr(10)
  || 'Avg Embed Time: ' || printf('%.2f', round(avg_embed_time, 2)) || 's' || chr(10)
  || 'Avg API Time: ' || printf('%.2f', round(avg_api_time, 2)) || 's' || chr(10)
  || 'Avg Pruned Tokens: ' || printf('%.1f', round(avg_pruned_tokens, 1)) || chr(10)
  || 'Token Reduction: ' || printf('%.1f', round(token_reduction_pct, 1)) || '%' AS summary FROM s""")
def q_summary_text(spark, sf):
    s = E.config_summary(eval_results(spark, sf))
    return s.select("keep_ratio", "recovery_ratio", K.summary_text(s).alias("summary"))


# ------------------------------------------------------------------ K5 / P4 / A16
_MANIFEST_SQL = (f"WITH {_NAMED_SQL}, m AS (SELECT page_id AS row_id, "
                 f"CASE WHEN page_id % 7 = 3 THEN NULL ELSE payload END AS payload, name FROM named), "
                 f"mm AS (SELECT row_id, payload, CASE WHEN payload IS NOT NULL AND name IS NOT NULL THEN "
                 + _SAFE.replace("payload", "payload") + " END AS file_name, "
                 "CASE WHEN payload IS NOT NULL AND name IS NOT NULL THEN 'ok' ELSE 'failed' END AS status FROM m)\n")


def _manifest(spark, sf):
    n = _named_pages(spark, sf)
    n = n.withColumn("payload", F.when(F.col("page_id") % 7 == 3, F.lit(None).cast("binary")).otherwise(F.col("payload")))
    return K.payload_manifest(n, "name", "payload", "page_id")


@register("extract_payload_files", _MANIFEST_SQL + """
SELECT file_name, max(row_id) AS row_id, octet_length(arg_max(payload, row_id))::BIGINT AS n_bytes,
       sha256(arg_max(payload, row_id)) AS sha256, count(*) AS n_writes FROM mm WHERE status = 'ok' GROUP BY file_name""")
def q_extract_payload_files(spark, sf):
    """The last payload of each name, written as a file and read back."""
    files = K.final_files(_manifest(spark, sf))
    folder = new_folder(spark, "payload-files")
    K.write_payload_files(files, folder)
    back = K.read_payload_files(files, folder).select("file_name", F.octet_length("payload").cast("bigint").alias("n_bytes"), F.sha2("payload", 256).alias("sha256"))
    return files.select("file_name", "row_id", "n_writes").join(back, "file_name")


@register("payload_present", _MANIFEST_SQL + "SELECT row_id, status FROM mm")
def q_payload_present(spark, sf):
    return _manifest(spark, sf).select("row_id", "status")


@register("extraction_counts", _MANIFEST_SQL + "SELECT status, count(*) AS n FROM mm GROUP BY status")
def q_extraction_counts(spark, sf):
    return E.extraction_counts(_manifest(spark, sf))


# ------------------------------------------------------------------ P3
@register("non_empty_questions", duckdb_with("questions") + """
SELECT question_id FROM questions WHERE question IS NOT NULL AND length(question) > 0""")
def q_non_empty_questions(spark, sf):
    return E.non_empty_questions(tb.questions(spark, sf)).select("question_id")


# ------------------------------------------------------------------ F23
@register("result_record", duckdb_with("eval_log") + ", " + EVAL_RESULTS + """
SELECT test_number, round(embed_time, 6) AS embed_time, round(api_call_time, 6) AS api_call_time,
  round(total_time, 6) AS total_time, api_success,
  CASE WHEN api_success THEN generated_text ELSE '' END AS generated_text,
  CASE WHEN api_success THEN predicted_answer ELSE '' END AS predicted_answer,
  api_success AND is_correct AS is_correct,
  CASE WHEN api_success THEN '' ELSE 'Failed to get response' END AS error_message,
  576 AS original_token, CASE WHEN api_success THEN pruned_token ELSE 0 END AS pruned_token,
  'pruned_embeddings' AS method FROM results""")
def q_result_record(spark, sf):
    r = eval_results(spark, sf)
    return r.select("test_number", *[F.round(c, 6).alias(c) for c in ("embed_time", "api_call_time", "total_time")],
                    *K.result_record_columns())


# ------------------------------------------------------------------ A17
@register("answer_value_set", duckdb_with("mc_items") + f"""
SELECT idx, {gc_sql('answers')} AS answer_values FROM mc_items""")
def q_answer_value_set(spark, sf):
    m = tb.mc_items(spark, sf)
    return m.select("idx", T.guided_choices("answers").alias("answer_values"))
