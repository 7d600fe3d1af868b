"""Scalar Column -> Column functions: prompts, answer parsing, payloads.

Everything here is a built-in Spark expression (JVM side, inside
whole-stage codegen); no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.tables import TOKENS_PER_IMAGE

# Whitespace removed by Python's ``str.strip()`` (ASCII part).
PY_WHITESPACE = " \t\n\r\x0b\x0c"
# The answer letters of a multiple-choice item, in order.
MC_LETTERS = ("A", "B", "C", "D")
# Extensions that count as "already has an image extension".
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "bmp", "webp")
# Default choices when an item has none, and the system prompt.
DEFAULT_CHOICES = ("yes", "no")
SYSTEM_PROMPT = "You are a helpful assistant."
MC_INSTRUCTION = "Please analyze the image and answer the question."


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(c) -> Column:
    """Python ``str.strip()``: Spark ``trim`` only removes spaces."""
    return F.btrim(_c(c), F.lit(PY_WHITESPACE))


# F1
def null_to_empty(c) -> Column:
    return F.coalesce(_c(c), F.lit(""))


# F2
def mc_prompt(question, hint, a, b, c, d) -> Column:
    """``Question: ..\\n\\nHint: ..\\n\\nOptions:\\nA) ..`` with nulls as ''."""
    q, h, oa, ob, oc, od = (null_to_empty(x) for x in (question, hint, a, b, c, d))
    return F.concat(
        F.lit("Question: "), q, F.lit("\n\nHint: "), h, F.lit("\n\nOptions:\nA) "), oa,
        F.lit("\nB) "), ob, F.lit("\nC) "), oc, F.lit("\nD) "), od,
        F.lit("\n\n" + MC_INSTRUCTION),
    )


# F3 / F4
def template_fields(template) -> Column:
    """Placeholders ``{...}`` (non-greedy), including the empty ``{}``."""
    return F.regexp_extract_all(_c(template), F.lit(r"\{(.*?)\}"), 1)


def template_fields_strict(template) -> Column:
    """Placeholders with at least one character: ``\\{([^}]+)\\}``."""
    return F.regexp_extract_all(_c(template), F.lit(r"\{([^}]+)\}"), 1)


# F5
def template_render(template: str, fields: dict) -> Column:
    """Substitute ``{name}`` in a driver-side template with column values."""
    out = F.lit(template)
    for name, col in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), null_to_empty(_c(col).cast("string")))
    return out


# F6
def strip_label(c, label: str) -> Column:
    """Remove the first occurrence of ``"<label>: "`` anywhere in the value."""
    c = _c(c)
    p = f"{label}: "
    pos = F.instr(c, p)
    return F.when(
        pos > 0,
        F.concat(F.substring(c, F.lit(1), pos - 1), F.substring(c, pos + len(p), F.lit(1 << 30))),
    ).otherwise(c)


# F7
def strip_label_split(c) -> Column:
    """``x.split(':', 1)[1].strip()`` when ``:`` is present, else ``x``."""
    c = _c(c)
    pos = F.instr(c, ":")
    return F.when(pos > 0, py_strip(F.substring(c, pos + 1, F.lit(1 << 30)))).otherwise(c)


# F8
def normalise_answer(c, case: str = "lower") -> Column:
    s = py_strip(_c(c))
    return F.lower(s) if case == "lower" else F.upper(s)


# F9
def token_budget(keep_ratio, recovery_ratio, n_tokens=TOKENS_PER_IMAGE,
                 important_ratio=0.6) -> Column:
    """struct(keep, important, diverse, recover, output) token counts.

    ``int()`` in Python truncates toward zero, so does a cast to int.
    """
    n = F.lit(n_tokens) if isinstance(n_tokens, int) else _c(n_tokens)
    k = F.least((_c(keep_ratio) * n).cast("int"), n.cast("int"))
    imp = (k * _c(important_ratio) if not isinstance(important_ratio, (int, float))
           else k * F.lit(float(important_ratio))).cast("int")
    rec = F.least((_c(recovery_ratio) * n).cast("int"), (n - k).cast("int"))
    rec = F.greatest(rec, F.lit(0))
    return F.struct(
        k.alias("keep"), imp.alias("important"), (k - imp).alias("diverse"),
        rec.alias("recover"), (k + rec).alias("output"),
    )


# F10
def token_reduction_pct(avg_tokens, n_tokens: int = TOKENS_PER_IMAGE) -> Column:
    return (F.lit(float(n_tokens)) - _c(avg_tokens)) / F.lit(float(n_tokens)) * F.lit(100.0)


# F11
def has_image_extension(name) -> Column:
    return F.lower(_c(name)).rlike(r"\.(" + "|".join(IMAGE_EXTENSIONS) + r")$")


def safe_filename(name, payload=None) -> Column:
    """Path separators to ``_``; add a sniffed extension (default jpg) if none."""
    clean = F.regexp_replace(_c(name).cast("string"), r"[/\\]", "_")
    ext = F.coalesce(sniff_format(payload), F.lit("jpg")) if payload is not None else F.lit("jpg")
    return F.when(has_image_extension(clean), clean).otherwise(F.concat(clean, F.lit("."), ext))


# F12
def sniff_format(payload) -> Column:
    """Image type from magic bytes (jpeg reported as jpg); null if unknown."""
    h = F.hex(F.substring(_c(payload), 1, 12))
    return (
        F.when(h.startswith("89504E470D0A1A0A"), F.lit("png"))
        .when(h.startswith("FFD8FF"), F.lit("jpg"))
        .when(h.startswith("474946383761") | h.startswith("474946383961"), F.lit("gif"))
        .when(h.startswith("424D"), F.lit("bmp"))
        .when(h.startswith("52494646") & (F.substring(h, 17, 8) == F.lit("57454250")), F.lit("webp"))
    )


# F13
def parse_mc_answer(text) -> Column:
    """Exact letter; else, in order A..D, contains ``X)`` or starts with X; else ''."""
    u = F.upper(py_strip(text))
    out = F.when(u.isin(*MC_LETTERS), u)
    for letter in MC_LETTERS:
        out = out.when(u.contains(letter + ")") | u.startswith(letter), F.lit(letter))
    return out.otherwise(F.lit(""))


# F14
def parse_yes_no(text) -> Column:
    low = F.lower(py_strip(text))
    return F.when(low.contains("yes"), F.lit("yes")).when(low.contains("no"), F.lit("no")).otherwise(low)


# F15
def parse_guided(text, choices) -> Column:
    """First choice (sorted order) contained in the lowered text, else the text.

    With no choices it falls back to ``parse_yes_no``.
    """
    low = F.lower(py_strip(text))
    ch = _c(choices)
    hit = F.try_element_at(F.filter(ch, lambda x: F.instr(low, py_strip(F.lower(x))) > 0), F.lit(1))
    guided = py_strip(F.coalesce(py_strip(F.lower(hit)), low))
    return F.when(F.coalesce(F.size(ch), F.lit(0)) > 0, guided).otherwise(py_strip(parse_yes_no(text)))


# F16
def guided_choices(answers) -> Column:
    """Distinct lowered/stripped answers of a JSON list of objects or strings.

    A JSON object string counts as a one-element list; ``null`` values and
    objects without ``answer`` are dropped; sorted; null if none or invalid.
    """
    s = _c(answers)
    t = py_strip(s)
    as_list = F.when(t.startswith("{"), F.array(t)).otherwise(F.from_json(s, "array<string>"))
    vals = F.transform(
        as_list,
        lambda e: F.when(py_strip(e).startswith("{"), F.get_json_object(e, "$.answer")).otherwise(e),
    )
    vals = F.transform(vals, lambda e: F.lower(py_strip(e)))
    vals = F.array_sort(F.array_distinct(F.filter(vals, lambda e: e.isNotNull() & (F.length(e) > 0))))
    return F.when(F.size(vals) > 0, vals)


# F17
def guided_choices_label(choices) -> Column:
    ch = _c(choices)
    return F.when(
        F.coalesce(F.size(ch), F.lit(0)) > 0,
        F.concat(F.lit("['"), F.array_join(ch, "', '"), F.lit("']")),
    ).otherwise(F.lit("['yes', 'no']"))


# F18
def default_choices(choices) -> Column:
    ch = _c(choices)
    return F.when(F.coalesce(F.size(ch), F.lit(0)) > 0, ch).otherwise(
        F.array(*[F.lit(x) for x in DEFAULT_CHOICES])
    )


# F19
def is_correct(predicted, answer, fold: str = "upper") -> Column:
    """``predicted == answer`` after null -> '' (so '' == '' is true)."""
    a = null_to_empty(answer)
    if fold == "upper":
        a = F.upper(a)
    elif fold == "lower":
        a = F.lower(py_strip(a))
    elif fold == "strip":
        a = py_strip(a)
    return F.coalesce(null_to_empty(predicted) == a, F.lit(False))


# F20
def response_content(response_json) -> Column:
    """``choices[0].message.content`` if present, else the whole response."""
    j = _c(response_json)
    obj = F.ltrim(j).startswith("{")          # plain text skips the JSON parser
    return F.coalesce(F.when(obj, F.get_json_object(j, "$.choices[0].message.content")), j)


def has_choices(response_json) -> Column:
    """Stricter success rule: the response holds a non-empty ``choices`` list."""
    j = _c(response_json)
    return F.coalesce(F.when(F.ltrim(j).startswith("{"), F.get_json_object(j, "$.choices[0]").isNotNull()),
                      F.lit(False))


def json_string(c) -> Column:
    """A string value as a JSON string literal (quoted, escaped)."""
    js = F.to_json(F.array(_c(c)))
    return F.substring(js, F.lit(2), F.length(js) - 2)


# F21
def request_payload(question, embeds_ref, model: str = "model", guided_choice=None,
                    uuid=None, embeds_first: bool = False) -> Column:
    """Chat request JSON: system + user (text and embeds part), max 1024 tokens,
    temperature 0, optional ``guided_choice`` list and ``uuid`` prefix key."""
    text_part = F.concat(F.lit('{"type":"text","text":'), json_string(question), F.lit("}"))
    emb = F.concat(F.lit('{"type":"image_embeds","image_embeds":'), json_string(embeds_ref))
    if uuid is not None:
        emb = F.concat(emb, F.lit(',"uuid":'), json_string(_c(uuid).cast("string")))
    emb = F.concat(emb, F.lit("}"))
    parts = [emb, F.lit(","), text_part] if embeds_first else [text_part, F.lit(","), emb]
    out = [
        F.lit('{"model":"' + model + '","messages":[{"role":"system","content":"' + SYSTEM_PROMPT
              + '"},{"role":"user","content":['),
        *parts,
        F.lit(']}],"max_tokens":1024,"temperature":0'),
    ]
    if guided_choice is not None:
        out += [F.lit(',"guided_choice":'), F.to_json(default_choices(guided_choice))]
    out.append(F.lit("}"))
    return F.concat(*out)


# F22
def total_time(embed_time, api_call_time) -> Column:
    return _c(embed_time) + _c(api_call_time)


# F24
def preview_text(c, n: int = 100) -> Column:
    return F.left(_c(c), F.lit(n))


# F25
def stamp(kind: str = "record") -> Column:
    fmt = "yyyy-MM-dd HH:mm:ss" if kind == "record" else "yyyyMMdd_HHmmss"
    return F.date_format(F.current_timestamp(), fmt)


# U6
def choice_guard(answer, choices) -> Column:
    """True when the answer is one of the allowed choices."""
    return F.coalesce(F.array_contains(default_choices(choices), _c(answer)), F.lit(False))
