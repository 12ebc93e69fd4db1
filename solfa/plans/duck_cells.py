"""The cleaners as DuckDB SQL, for comparison on ASCII text. Names: r is the raw cell, b its base text."""

from __future__ import annotations

from ..functions.schema import COSMETIC, FIX_TAGS, LANGUAGES, PLACEHOLDERS, TYPES, VOCALS
from .fixtures import CATALOG_MAPPING, RAW_CATALOG, duck_table


def base(r: str) -> str:
    kept = rf"regexp_replace(regexp_replace({r}, '_x[0-9A-Fa-f]{{4}}_', ' ', 'g'), '[\x00-\x08\x0a-\x1f]', '', 'g')"
    return rf"trim(regexp_replace({kept}, '\s+', ' ', 'g'))"


def norm(v: str) -> str:
    return rf"lower(trim(regexp_replace({v}, '\s+', ' ', 'g')))"


def title(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, ''), lambda ch, i: CASE WHEN i > 1 AND regexp_matches(string_split({x}, '')[i - 1], '[A-Za-z]') THEN lower(ch) ELSE upper(ch) END), '')"


def problem(x: str) -> str:
    return rf"""CASE WHEN regexp_matches({x}, '[$%@#^*=+~<>{{}}\[\]\\"`]') THEN 1
      WHEN NOT regexp_matches({x}, '\s') AND regexp_matches(regexp_replace({x}, '[^A-Za-z]', '', 'g'), '^[A-Z]{{2,}}$') THEN 2
      WHEN regexp_matches({x}, '[a-z][A-Z]|[A-Z]{{2,}}[a-z]') THEN 3 END"""


def ordered_distinct(values: str) -> str:
    return f"list_filter({values}, lambda x, i: list_position({values}, x) = i)"


def split_trim(text: str, pattern: str) -> str:
    return rf"list_filter(list_transform(regexp_split_to_array({text}, '{pattern}'), lambda x: trim(x)), lambda x: x <> '')"


NAMES = split_trim("b", r"(?i)\s*[|,&]\s*|\s+and\s+")
LABELS = split_trim("b", r"(?i)\s*[,&]\s*|\s+and\s+")
GARBLED = r"(regexp_matches(r, '_x[0-9A-Fa-f]{4}_') OR length(r) - length(replace(r, '$', '')) >= 2 OR (contains(r, '`') AND contains(r, '$')))"
PLACEHOLDER = f"(lower(b) IN ({', '.join(repr(x) for x in PLACEHOLDERS)}) OR NOT regexp_matches(b, '[A-Za-z0-9]'))"


def _day(y: str, m: str, d: str) -> str:
    return f"TRY_CAST(lpad(NULLIF({y}, ''), 4, '0') || '-' || lpad(NULLIF({m}, ''), 2, '0') || '-' || lpad(NULLIF({d}, ''), 2, '0') AS DATE)"


def date(x: str) -> str:
    g = lambda p, i: f"regexp_extract({x}, '{p}', {i})"
    iso, named = r"^(\d{4})-(\d{1,2})-(\d{1,2})$", r"^(\d{1,2})-([A-Za-z]{3})-(\d{4}|\d{2})$"
    month = f"CAST((instr('janfebmaraprmayjunjulaugsepoctnovdec', lower({g(named, 2)})) + 2) // 3 AS VARCHAR)"
    year = f"CASE WHEN length({g(named, 3)}) = 4 THEN {g(named, 3)} ELSE CAST(TRY_CAST({g(named, 3)} AS INT) + CASE WHEN TRY_CAST({g(named, 3)} AS INT) >= 69 THEN 1900 ELSE 2000 END AS VARCHAR) END"
    dmy = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    return f"coalesce({_day(g(iso, 1), g(iso, 2), g(iso, 3))}, CASE WHEN {g(named, 2)} <> '' THEN {_day(year, month, g(named, 1))} END, {_day(g(dmy, 3), g(dmy, 2), g(dmy, 1))}, {_day(g(dmy, 3), g(dmy, 1), g(dmy, 2))})"


DAY = f"coalesce({date('b')}, {date('split_part(b, chr(32), 1)')})"
PARTS = "string_split(b, ':')"
NUMBERS = f"list_transform({PARTS}, lambda x: TRY_CAST(x AS BIGINT))"
SECONDS = f"CASE len({PARTS}) WHEN 1 THEN {NUMBERS}[1] WHEN 2 THEN {NUMBERS}[1] * 60 + {NUMBERS}[2] ELSE {NUMBERS}[1] * 3600 + {NUMBERS}[2] * 60 + {NUMBERS}[3] END"
UNREAD = f"(len({PARTS}) > 3 OR len(list_filter({PARTS}, lambda x: NOT regexp_matches(trim(x), '^[0-9]+$'))) > 0)"
OVER = f"(len({PARTS}) > 1 AND len(list_filter({NUMBERS}[2:], lambda x: x >= 60)) > 0)"
SHARES = f"list_transform({split_trim('b', '[|]')}, lambda x: trim(replace(x, '%', '')))"
BAD_SHARE = f"list_filter({SHARES}, lambda x: TRY_CAST(x AS DOUBLE) IS NULL OR TRY_CAST(x AS DOUBLE) < 0 OR TRY_CAST(x AS DOUBLE) > 100)[1]"


def _map(table: dict[str, str]) -> str:
    return "CASE lower(b) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


VALUE = {
    "name": f"CASE WHEN {GARBLED} THEN b ELSE array_to_string({ordered_distinct(f'list_transform({NAMES}, lambda y: {title("y")})')}, ' | ') END",
    "title": f"CASE WHEN {GARBLED} THEN b ELSE {title('b')} END",
    "path": "replace(b, chr(92), '/')",
    "code": "replace(upper(b), ' ', '')",
    "isrc": "regexp_replace(upper(b), '[- ]', '', 'g')",
    "upc": r"regexp_replace(b, '\D', '', 'g')",
    "date": f"coalesce(strftime({DAY}, '%Y-%m-%d'), b)",
    "duration": f"CASE WHEN {UNREAD} THEN r WHEN {OVER} THEN b WHEN {SECONDS} > 36000 THEN r ELSE printf('%02d:%02d:%02d', {SECONDS} // 3600, {SECONDS} % 3600 // 60, {SECONDS} % 60) END",
    "vocal_instrumental": f"coalesce({_map(VOCALS)}, b)",
    "language": f"coalesce({_map(LANGUAGES)}, {title('b')})",
    "label": f"array_to_string({LABELS}, ' | ')",
    "percent": f"CASE WHEN {BAD_SHARE} IS NULL THEN array_to_string(list_transform({SHARES}, lambda x: printf('%g', TRY_CAST(x AS DOUBLE))), ' | ') WHEN TRY_CAST({BAD_SHARE} AS DOUBLE) IS NULL THEN {BAD_SHARE} ELSE printf('%g', TRY_CAST({BAD_SHARE} AS DOUBLE)) END",
}
ERROR = {
    "name": f"CASE WHEN {GARBLED} THEN 'garbled_value' WHEN len(list_filter({NAMES}, lambda x: regexp_matches(x, '^[0-9]+$') OR length(x) = 1 OR ({problem('x')}) IS NOT NULL)) > 0 THEN 'suspect_value' END",
    "title": f"CASE WHEN {GARBLED} THEN 'garbled_value' WHEN ({problem('b')}) IS NOT NULL THEN 'suspect_value' END",
    "isrc": f"CASE WHEN NOT regexp_matches({VALUE['isrc']}, '^[A-Z]{{2}}[A-Z0-9]{{3}}[0-9]{{7}}$') THEN 'invalid_isrc' END",
    "upc": f"CASE WHEN length({VALUE['upc']}) NOT IN (12, 13) THEN 'invalid_upc' END",
    "date": f"CASE WHEN {DAY} IS NULL THEN 'invalid_date' WHEN year({DAY}) NOT BETWEEN 1950 AND 2031 THEN 'implausible_date' END",
    "duration": f"CASE WHEN {UNREAD} OR {OVER} OR {SECONDS} = 0 OR {SECONDS} > 36000 THEN 'invalid_duration' END",
    "vocal_instrumental": f"CASE WHEN {_map(VOCALS)} IS NULL THEN 'invalid_category' END",
    "percent": f"CASE WHEN {BAD_SHARE} IS NOT NULL THEN 'invalid_percent' END",
}


def _by_kind(table: dict[str, str], otherwise: str, kinds: set[str]) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items() if k in kinds)
    return f"CASE kind {cases} ELSE {otherwise} END" if cases else otherwise


def cells(mapping: dict[str, list[str]] = CATALOG_MAPPING, raw: str = RAW_CATALOG) -> str:
    """CTEs raw and cells(row_index, col, pos, src, value, action, tag, cosmetic, original): each source cell cleaned."""
    kinds = {TYPES.get(c, "text") for c in mapping}
    rows = " UNION ALL ".join(
        f"SELECT row_index, '{c}' AS col, {pos} AS pos, {src} AS src, '{TYPES.get(c, 'text')}' AS kind, {s} AS r FROM raw"
        for pos, (c, sources) in enumerate(mapping.items())
        for src, s in enumerate(sources)
    )
    return f"""raw AS ({duck_table(raw)}), long AS ({rows}), {cleaned_cells('long', kinds)}"""


def kind_of(columns: list[str]) -> str:
    return "CASE col " + " ".join(f"WHEN '{c}' THEN '{TYPES[c]}'" for c in columns if c in TYPES) + " ELSE 'text' END"


def cleaned_cells(long: str, kinds: set[str], p: str = "", keep: str = "pos, src") -> str:
    """CTEs, the last of them {p}cells, of the cells in long (row_index, col, kind, r and the columns to keep) cleaned."""
    fix = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FIX_TAGS.items()) + " END"
    cosmetic = ", ".join(f"'{k}'" for k in COSMETIC)
    return f"""{p}based AS (SELECT *, {base('r')} AS b FROM {long}),
{p}found AS (SELECT *, b = '' AS empty, b <> '' AND {PLACEHOLDER} AS junk, {_by_kind(VALUE, 'b', kinds)} AS v,
  CASE WHEN b <> '' AND NOT {PLACEHOLDER} THEN coalesce({_by_kind(ERROR, 'NULL', kinds)}, CASE WHEN {GARBLED} THEN 'garbled_value' END) WHEN {GARBLED} THEN 'garbled_value' END AS err FROM {p}based),
{p}done AS (SELECT *, CASE WHEN empty OR junk THEN '' ELSE v END AS value,
  CASE WHEN err IS NOT NULL THEN 'error' WHEN junk OR (NOT empty AND v <> r) THEN 'fixed' ELSE 'ok' END AS action FROM {p}found),
{p}cells AS (SELECT row_index, col, {keep}, value, action, r AS original,
  coalesce(err, CASE WHEN action = 'fixed' THEN CASE WHEN trim(r) <> '' AND value = '' THEN 'removed_junk' ELSE {fix} END END) AS tag,
  action = 'fixed' AND kind IN ({cosmetic}) AND NOT (trim(r) <> '' AND value = '') AS cosmetic FROM {p}done)"""


def merged() -> str:
    """CTE cell(row_index, col, pos, value, action, tag, cosmetic, original) after cells(): one cell a column."""
    parts = "list_filter(flatten(list_transform(list(value ORDER BY src) FILTER (value <> ''), lambda x: string_split(x, ' | '))), lambda x: x <> '')"
    return f"""grouped AS (SELECT row_index, col, pos, count(*) AS n, count(*) FILTER (value <> '') AS nfull,
  list({{'v': value, 'a': action, 't': tag, 'c': cosmetic, 'o': original}} ORDER BY src) AS every,
  list({{'v': value, 'a': action, 't': tag, 'c': cosmetic, 'o': original}} ORDER BY src) FILTER (value <> '') AS fulls,
  list(tag ORDER BY src) FILTER (action = 'error') AS errs, {parts} AS parts, array_to_string(list(original ORDER BY src) FILTER (original <> ''), ' | ') AS originals
  FROM cells GROUP BY ALL),
cell AS (SELECT row_index, col, pos,
  CASE WHEN n = 1 THEN every[1].v WHEN nfull > 1 THEN array_to_string({ordered_distinct('parts')}, ' | ') WHEN nfull = 1 THEN fulls[1].v ELSE '' END AS value,
  CASE WHEN n = 1 THEN every[1].a WHEN nfull > 1 THEN CASE WHEN len(errs) > 0 THEN 'error' ELSE 'fixed' END WHEN nfull = 1 THEN fulls[1].a ELSE 'ok' END AS action,
  CASE WHEN n = 1 THEN every[1].t WHEN nfull > 1 THEN CASE WHEN len(errs) > 0 THEN errs[1] ELSE 'combined_columns' END WHEN nfull = 1 THEN fulls[1].t END AS tag,
  CASE WHEN n = 1 THEN every[1].c WHEN nfull > 1 THEN false WHEN nfull = 1 THEN fulls[1].c ELSE false END AS cosmetic,
  CASE WHEN n = 1 THEN every[1].o WHEN nfull > 1 THEN originals WHEN nfull = 1 THEN fulls[1].o ELSE '' END AS original
  FROM grouped)"""
