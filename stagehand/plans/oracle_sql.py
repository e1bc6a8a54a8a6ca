"""DuckDB SQL snippets that mirror the guarded casts, for the oracle queries.

They spell the same text-shape rules as ``functions.casts`` so the oracle and
Spark agree on what counts as a valid integer, float, date or datetime.
"""
from __future__ import annotations

from ..functions.casts import DATE_RE, DATETIME_RE, FLOAT_RE, HEX_RE, INF_RE, INT_RE, NAN_RE


def q_int(x: str) -> str:
    t = f"trim({x})"
    return (f"(CASE WHEN regexp_matches({t}, '{INT_RE}') THEN TRY_CAST({t} AS BIGINT) "
            f"WHEN regexp_matches({t}, '{HEX_RE}') THEN (CASE WHEN starts_with({t}, '-') THEN -1 ELSE 1 END) "
            f"* TRY_CAST(regexp_replace({t}, '^[+-]', '') AS BIGINT) END)")


def q_double(x: str) -> str:
    t = f"trim({x})"
    return (f"(CASE WHEN regexp_matches({t}, '{FLOAT_RE}') THEN TRY_CAST({t} AS DOUBLE) "
            f"WHEN regexp_matches({t}, '{INF_RE}') THEN (CASE WHEN starts_with({t}, '-') THEN '-inf' ELSE 'inf' END)::DOUBLE "
            f"WHEN regexp_matches({t}, '{NAN_RE}') THEN 'nan'::DOUBLE END)")


def q_date(x: str) -> str:
    t = f"trim({x})"
    return f"(CASE WHEN regexp_matches({t}, '{DATE_RE}') THEN TRY_CAST({t} AS DATE) END)"


def q_datetime(x: str) -> str:
    t = f"trim({x})"
    return f"(CASE WHEN regexp_matches({t}, '{DATETIME_RE}') THEN TRY_CAST({t} AS TIMESTAMP) END)"


def q_flag(x: str) -> str:
    return f"({q_int(f'nullif({x}, {chr(39)}{chr(39)})')} = 1)"


def q_rate(num: str, den: str, digits: int = 4) -> str:
    return f"round(CAST({num} AS DOUBLE) / nullif(CAST({den} AS DOUBLE), 0), {digits})"


def q_blank(x: str) -> str:
    return f"({x} IS NULL OR {x} = '')"
