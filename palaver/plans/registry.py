"""The registry of queries with their DuckDB SQL, and the SQL of the tables' conventions (``plans.model``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# -- shared SQL of the conventions ------------------------------------------------------------------------------------
NORM = r"replace(lower(nfc_normalize(regexp_replace({0}, '[\s_/\-　、。〈〉《》「」『』【】〔〕〖〗！（），：；？“”‘’—…·]', ' ', 'g'))), 'ß', 'ss')"
CORPUS_SQL = f"""c AS (SELECT doc_id AS key, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS ts, split_part(text, chr(10), 1) AS title,
  source AS project, text AS body, {NORM.format("split_part(text, chr(10), 1)")} AS title_norm, {NORM.format("source")} AS project_norm, {NORM.format("text")} AS body_norm FROM documents)"""
FRESH_SQL = "2.0 * pow(2.0, -(date_diff('second', {0}, TIMESTAMP '2024-02-01') / 86400.0) / 7.0)"
MESSAGES_SQL = r"""m AS (SELECT key, turn, role, text, row_number() OVER (PARTITION BY key ORDER BY turn) AS ordinal FROM (
  SELECT *, max(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY turn) AS met FROM (
    SELECT conv_id AS key, turn, role, text FROM conversations WHERE role <> 'system' AND trim(coalesce(text, '')) <> '')) WHERE role = 'user' OR met = 1)"""


def tf_sql(field: str, word: str) -> str:
    return f"ln(1.0 + least(len(regexp_extract_all({field}, '(?:^|[^\\p{{L}}]){word}')), 10))"


def near_sql(field: str, pair: str) -> str:
    return f"least(len(regexp_extract_all({field}, '(?:^|[^\\p{{L}}]){pair}')), 3)"


def score_sql(words: list[str], top: int | None, explain: bool = False, where: str = "TRUE", rows: str = CORPUS_SQL) -> str:
    pair = f"{words[0]} {words[1][:3]}" if len(words) > 1 else None
    fields = {"title": 5, "project": 4, "body": 1}
    parts = {f"{f}_tf": f"{w}.0 * ({' + '.join(tf_sql(f + '_norm', x) for x in words)})" for f, w in fields.items()}
    parts |= {f"{f}_near": f"{2 * w}.0 * {near_sql(f + '_norm', pair) if pair else 0}" for f, w in fields.items()}
    gate = " AND ".join(f"(regexp_matches(body_norm, '(?:^|[^\\p{{L}}]){x}') OR regexp_matches(project_norm, '(?:^|[^\\p{{L}}]){x}'))" for x in words)
    shown = ", ".join(f"round({v}, 6) AS {k}" for k, v in parts.items()) + ", " if explain else ""
    return f"""WITH {rows}
SELECT key, {shown}round({" + ".join(parts.values())} + {FRESH_SQL.format("ts")}, 6) AS score FROM c WHERE {gate} AND {where}
ORDER BY score DESC, ts DESC, key {f"LIMIT {top}" if top else ""}"""
