"""DuckDB text fragments shared by the SQL oracles."""

from __future__ import annotations

from ..sources.tables import duckdb_with  # noqa: F401  (re-export)

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def mc_parse(x: str) -> str:
    u = f"upper({strip(x)})"
    arms = " ".join(
        f"WHEN contains({u}, '{L})') OR starts_with({u}, '{L}') THEN '{L}'" for L in "ABCD"
    )
    return f"(CASE WHEN {u} IN ('A','B','C','D') THEN {u} {arms} ELSE '' END)"


def yes_no(x: str) -> str:
    low = f"lower({strip(x)})"
    return f"(CASE WHEN contains({low}, 'yes') THEN 'yes' WHEN contains({low}, 'no') THEN 'no' ELSE {low} END)"


def trunc_int(x: str) -> str:
    """Python ``int()`` of a double (DuckDB's cast rounds, so truncate first)."""
    return f"CAST(trunc({x}) AS INTEGER)"


def budget(keep: str, rec: str, n: str = "576", imp: str = "0.6") -> dict:
    k = f"least({trunc_int(f'{keep} * {n}')}, CAST({n} AS INTEGER))"
    i = trunc_int(f"({k}) * {imp}")
    r = f"greatest(least({trunc_int(f'{rec} * {n}')}, CAST({n} AS INTEGER) - ({k})), 0)"
    return {"keep": k, "important": i, "diverse": f"(({k}) - ({i}))", "recover": r,
            "output": f"(({k}) + ({r}))"}


def dot(a: str, b: str) -> str:
    return f"list_reduce(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]), lambda s, x: s + x, 0.0::DOUBLE)"


def json_str(x: str) -> str:
    return f"CAST(to_json({x}) AS VARCHAR)"


EVAL_RESULTS = f"""results AS (
  SELECT *, {budget('keep_ratio', 'recovery_ratio')['output']} AS pruned_token,
         embed_time + api_call_time AS total_time,
         coalesce(predicted_answer = upper(coalesce(correct_answer, '')), false) AS is_correct
  FROM (SELECT *, {mc_parse('generated_text')} AS predicted_answer FROM eval_log))
"""
