"""Oracle SQL fragments, written apart from the Spark expressions they check."""

from __future__ import annotations

from fieldwarden.functions.text import HAN_RANGES, char_class

SPACE = (
    r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
HAN = char_class(HAN_RANGES)  # the fixed ranges; Java and RE2 read the same class


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def clean(x: str) -> str:
    """DuckDB lacks compatibility normalisation: full-width marks of the inputs are mapped by name."""
    plain = f"translate(coalesce({x}, ''), '，：（）', ',:()')"
    kept = f"""regexp_replace({plain}, '[^A-Za-z0-9(),!?''"{HAN}]', ' ', 'g')"""
    return f"upper(trim(regexp_replace({kept}, '\\s{{2,}}', ' ', 'g')))"


def text_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def in_list(values: list[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def percent_label(n: str, total: str) -> str:
    cents = f"({n} * 10000) // {total}"
    twice = f"2 * (({n} * 10000) % {total})"
    up = f"({twice} > {total} OR ({twice} = {total} AND ({cents}) % 2 = 1))"
    h = f"({cents} + CASE WHEN {up} THEN 1 ELSE 0 END)"
    return (
        f"CASE WHEN {n} * 100 > {total} THEN CAST({h} // 100 AS VARCHAR) || '.' || "
        f"lpad(CAST({h} % 100 AS VARCHAR), 2, '0') || '%' ELSE '' END"
    )


def hashed(seed: int, *keys: str) -> str:
    parts = "".join(f" || '|' || coalesce(CAST({k} AS VARCHAR), '')" for k in keys)
    return f"md5('{seed}'{parts})"


def one_hot(value: str, values: list[str], default: str) -> str:
    picked = f"CASE WHEN {value} IN {in_list(values)} THEN {value} ELSE '{default}' END"
    return (
        f"list_transform({text_list(values)}, lambda v: CASE WHEN v = ({picked}) THEN 1000000 ELSE 0 END)"
    )


def ratio(x: str, size: int) -> str:
    part = f"least(length({strip(f'coalesce({x}, {chr(39) * 2})')}) / CAST({size} AS DOUBLE), 1.0)"
    return f"[CAST(round({part} * 1000000) AS INT)]"


def sequence(cleaned: str, size: int) -> str:
    ids = (
        f"CASE WHEN {cleaned} = '' THEN CAST([] AS INT[]) ELSE "
        f"list_transform(string_split({cleaned}, ''), lambda c: coalesce(m[c], 1)) END"
    )
    return f"list_resize(list_slice(list_append({ids}, 2), 1, {size}), {size}, 0)"
