"""The page automaton a second time, as a recursion over tokens in SQL."""

from __future__ import annotations

from ..operators import markup


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]::VARCHAR[]"


def _by_kind(part: int) -> str:
    return "CASE " + " ".join(f"WHEN kind IN ({', '.join(map(repr, row[0]))}) THEN {_list(row[part])}" for row in markup.IMPLIED) + " ELSE []::VARCHAR[] END"


def _last(condition: str) -> str:
    return f"coalesce(list_max(list_transform(s.stack, lambda e, k: CASE WHEN {condition} THEN k ELSE 0 END)), 0)"


#: CTEs up to ``nodes`` (page_id, node, last, parent, kind, depth, text).
NODES = f"""
raw AS (SELECT page_id, regexp_extract_all(coalesce(html, ''), '{markup.TOKEN.replace("'", "''")}', 1) AS ts FROM pages),
split AS (SELECT page_id, len(ts) AS n, unnest(ts) AS t, unnest(range(0, len(ts))) AS i FROM raw),
named AS (SELECT *, lower(regexp_extract(t, '{markup.TAG}', 1)) AS kind FROM split),
toks AS MATERIALIZED (SELECT page_id, n, i, CASE WHEN kind <> '' THEN kind ELSE '{markup.TEXT}' END AS kind, CASE WHEN kind = '' THEN t END AS text,
    CASE WHEN kind <> '' AND starts_with(t, '</') THEN 'close' WHEN kind <> '' AND (kind IN {markup.VOID} OR ends_with(t, '/>') OR regexp_matches(t, '{markup.RAW}')) THEN 'leaf' WHEN kind <> '' THEN 'open'
        WHEN NOT regexp_matches(t, '^<[!?]') AND regexp_matches(t, '[^\\x09-\\x0D\\x20]') THEN 'leaf' END AS op,
    CASE WHEN kind <> '' AND NOT starts_with(t, '</') THEN {_by_kind(1)} ELSE []::VARCHAR[] END AS ends, CASE WHEN kind <> '' AND NOT starts_with(t, '</') THEN {_by_kind(2)} ELSE []::VARCHAR[] END AS bars FROM named),
run AS (
    SELECT page_id, -1::BIGINT AS i, []::STRUCT(node BIGINT, kind VARCHAR)[] AS stack, 0::BIGINT AS stay, []::STRUCT(node BIGINT, kind VARCHAR)[] AS before FROM raw
    UNION ALL SELECT page_id, i, list_concat(stack[1:stay], CASE WHEN op = 'open' THEN [{{'node': i, 'kind': kind}}] ELSE [] END), stay, stack FROM (
        SELECT s.page_id, t.i, t.kind, t.op, s.stack, CAST(CASE WHEN t.op = 'close' THEN CASE WHEN {_last("e.kind = t.kind")} > 0 THEN {_last("e.kind = t.kind")} - 1 ELSE len(s.stack) END
            WHEN {_last("list_contains(t.ends, e.kind)")} > {_last("list_contains(t.bars, e.kind)")} THEN {_last("list_contains(t.ends, e.kind)")} - 1 ELSE len(s.stack) END AS BIGINT) AS stay
        FROM run s JOIN toks t ON t.page_id = s.page_id AND t.i = s.i + 1)),
steps AS MATERIALIZED (SELECT * FROM run),
ended AS (SELECT page_id, unnest(before[stay + 1:]).node AS node, i - 1 AS last FROM steps),
nodes AS MATERIALIZED (SELECT t.page_id, CAST(t.i AS INTEGER) AS node, CAST(CASE WHEN t.op = 'leaf' THEN t.i ELSE coalesce(ended.last, t.n - 1) END AS INTEGER) AS last,
    CAST(CASE WHEN r.stay > 0 THEN r.before[r.stay].node END AS INTEGER) AS parent, t.kind, CAST(r.stay AS INTEGER) AS depth, t.text
    FROM toks t JOIN steps r ON r.page_id = t.page_id AND r.i = t.i LEFT JOIN ended ON ended.page_id = t.page_id AND ended.node = t.i WHERE t.op IN ('open', 'leaf'))"""

PAGE_NODES = f"WITH RECURSIVE {NODES} SELECT page_id, node, last, parent, kind, depth FROM nodes"


def passages(kinds: tuple[str, ...]) -> str:
    """Every text with the innermost of some elements around it."""
    return f"""WITH RECURSIVE {NODES}, around AS (SELECT x.page_id, x.node, max(y.node) AS around FROM nodes x JOIN nodes y ON x.page_id = y.page_id AND y.node < x.node AND x.node <= y.last WHERE x.kind = '{markup.TEXT}' AND y.kind IN {kinds} GROUP BY ALL)
    SELECT x.page_id, x.node, a.around, y.kind AS region, length(x.text) AS n_chars FROM nodes x LEFT JOIN around a ON a.page_id = x.page_id AND a.node = x.node LEFT JOIN nodes y ON y.page_id = x.page_id AND y.node = a.around WHERE x.kind = '{markup.TEXT}'"""
