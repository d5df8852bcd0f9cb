"""The role decoder and its rules a second time, as SQL over ``documents``: recursions along the lines instead of array folds."""

from __future__ import annotations

from ..operators import decoding
from ..operators.rulebits import RuleBits

_S = range(len(decoding.ROLES))


def _case(sign: str, weights) -> str:
    pattern = decoding.SIGNS[sign].replace("'", "''")
    return f"CASE WHEN regexp_matches(x, '{pattern}') THEN {weights} ELSE 0 END"


def _bits() -> str:
    return "[" + ", ".join(" + ".join(_case(sign, bits[j]) for sign, bits in decoding.SIGN_BITS.items()) for j in _S) + "]"


def _list(values) -> str:
    return "[" + ", ".join(values) + "]"


def _scaled(name: str, parts: list[str]) -> str:
    """Parts over their sum, summed from the left as the folds do."""
    return f"list_transform({_list(parts)}, lambda v: v / ({' + '.join(['0.0::DOUBLE', *parts])})) AS {name}"


_REACH = [_list(f"v.w[{i + 1}] + {decoding.NEXT_BITS[i][j]}" for i in _S) for j in _S]
_CARRIED = ["(" + " + ".join(["0.0::DOUBLE", *(f"m.s[{i + 1}] * {2.0 ** decoding.NEXT_BITS[i][j]!r}" for i in _S)]) + ")" for j in _S]
_BEHIND = ["(" + " + ".join(["0.0::DOUBLE", *(f"(m.s[{j + 1}] * n.p[{j + 1}]) * {2.0 ** decoding.NEXT_BITS[i][j]!r}" for j in _S)]) + ")" for i in _S]

#: CTEs up to ``decoded`` (doc_id, seq, x, role, confidence); ``t`` counts the lines that show text.
DECODED = f"""
raw AS (SELECT doc_id, unnest(range(0, len(ls))) AS seq, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
shown AS (SELECT doc_id, seq, regexp_replace(line, '^[\\x09-\\x0D\\x20]+|[\\x09-\\x0D\\x20]+$', '', 'g') AS x FROM raw),
lines AS MATERIALIZED (SELECT doc_id, seq, x, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS t, count(*) OVER (PARTITION BY doc_id) AS n, {_bits()} AS b FROM shown WHERE x <> ''),
weighed AS MATERIALIZED (SELECT *, list_transform(b, lambda v: pow(2.0::DOUBLE, v)) AS p FROM lines),
forward AS (
    SELECT doc_id, t, {_list(f"b[{j + 1}] + {decoding.FIRST_BITS[j]}" for j in _S)} AS w, NULL::BIGINT[] AS k FROM lines WHERE t = 0
    UNION ALL SELECT l.doc_id, l.t, {_list(f"list_max({_REACH[j]}) + l.b[{j + 1}]" for j in _S)}, {_list(f"list_position({_REACH[j]}, list_max({_REACH[j]}))::BIGINT" for j in _S)} FROM forward v JOIN lines l ON l.doc_id = v.doc_id AND l.t = v.t + 1),
held AS MATERIALIZED (SELECT * FROM forward),
path AS (
    SELECT h.doc_id, h.t, list_position(h.w, list_max(h.w))::BIGINT AS role FROM held h JOIN lines l USING (doc_id, t) WHERE l.t = l.n - 1
    UNION ALL SELECT h.doc_id, h.t - 1, h.k[p.role] FROM path p JOIN held h ON h.doc_id = p.doc_id AND h.t = p.t WHERE h.t > 0),
ahead_0 AS (SELECT doc_id, {_list(f"p[{j + 1}] * {2.0 ** decoding.FIRST_BITS[j]!r}" for j in _S)} AS q FROM weighed WHERE t = 0),
ahead AS (
    SELECT doc_id, 0::BIGINT AS t, {_scaled("s", [f"q[{j + 1}]" for j in _S])} FROM ahead_0
    UNION ALL SELECT doc_id, t, {_scaled("s", [f"(c[{j + 1}] * p[{j + 1}])" for j in _S])} FROM (SELECT n.doc_id, n.t, n.p, {_scaled("c", _CARRIED)} FROM ahead m JOIN weighed n ON n.doc_id = m.doc_id AND n.t = m.t + 1)),
behind AS (
    SELECT doc_id, t, {_list(["1.0::DOUBLE"] * len(_S))} AS s FROM weighed WHERE t = n - 1
    UNION ALL SELECT n.doc_id, n.t - 1, {_scaled("s", _BEHIND)} FROM behind m JOIN weighed n ON n.doc_id = m.doc_id AND n.t = m.t WHERE n.t > 0),
joint AS (SELECT doc_id, t, {_scaled("g", [f"(a.s[{j + 1}] * z.s[{j + 1}])" for j in _S])} FROM ahead a JOIN behind z USING (doc_id, t)),
decoded AS MATERIALIZED (SELECT doc_id, CAST(seq AS INTEGER) AS seq, x, {_list(f"'{r}'" for r in decoding.ROLES)}[path.role] AS role, g[path.role] AS confidence FROM lines JOIN path USING (doc_id, t) JOIN joint USING (doc_id, t))"""

ROLES = f"WITH RECURSIVE {DECODED} SELECT doc_id, seq, role, round(confidence, 6) AS confidence FROM decoded"

_RANGE = "([0-9]+\\s*[-–−~～—]\\s*[0-9]+)\\s*页?\\s*[。.]?$"
_FOREIGN = "role = 'reference_entry' AND NOT regexp_matches(x, '^\\p{Han}')"
_NAMES, _QUOTED = "^([^0-9]+?), ?[(（]?[0-9]{4}", "[\"“]([^\"“”]+)[\"”]"

#: CTEs up to ``found`` (doc_id, rule_id, ok): the rules of wording, on what decoded lines are.
FOUND = f"""{DECODED},
parts AS (
    SELECT doc_id, role, x AS text FROM decoded
    UNION ALL SELECT doc_id, 'reference_page_range', regexp_extract(x, '{_RANGE}', 1) FROM decoded WHERE role = 'reference_entry' AND regexp_matches(x, '{_RANGE}')
    UNION ALL SELECT doc_id, 'foreign_reference_entry_layout', x FROM decoded WHERE {_FOREIGN}
    UNION ALL SELECT doc_id, 'english_reference_authors', regexp_extract(x, '{_NAMES}', 1) FROM decoded WHERE {_FOREIGN} AND regexp_matches(x, '{_NAMES}')
    UNION ALL SELECT doc_id, 'english_reference_title', regexp_extract(x, '{_QUOTED}', 1) FROM decoded WHERE {_FOREIGN} AND regexp_matches(x, '{_QUOTED}')),
found AS (
    SELECT doc_id, 'ER-MS-AUTHORINFO-002' AS rule_id, NOT contains(text, '电子邮箱') AS ok FROM parts WHERE role = 'contact_label'
    UNION ALL SELECT doc_id, 'ER-MS-REF-PAGERANGE-001', NOT regexp_matches(text, '[0-9]\\s*[-–−~～]\\s*[0-9]') FROM parts WHERE role = 'reference_page_range'
    UNION ALL SELECT doc_id, 'ER-MS-REF-TITLECASE-001', regexp_matches(text, '^[\\s"“]*\\p{{Lu}}') FROM parts WHERE role = 'english_reference_title'
    UNION ALL SELECT doc_id, 'ER-MS-REF-AUTHOR-001', regexp_matches(text, '^\\p{{Lu}}[\\p{{L}}''-]+, (\\p{{Lu}}\\.[ -]?)+(,? (and|&) ((\\p{{Lu}}\\.[ -]?)+ ?\\p{{Lu}}[\\p{{L}}''-]+|\\p{{Lu}}[\\p{{L}}''-]+, (\\p{{Lu}}\\.[ -]?)+))*$') FROM parts WHERE role = 'english_reference_authors'
    UNION ALL SELECT doc_id, 'ER-REF-FOREIGN-LINE-001', contains(text, ',') FROM parts WHERE role = 'foreign_reference_entry_layout')"""


def bitmaps(rule_ids) -> str:
    """One row a document: which rules it breaks, keeps and does not meet, as a word of 64 bits."""
    bits = RuleBits(rule_ids)
    value = "CASE rule_id " + " ".join(f"WHEN '{r}' THEN {bits.value([r])}" for r in bits.ids) + " END"
    return f"""WITH RECURSIVE {FOUND},
    words AS (SELECT doc_id, bit_or(CASE WHEN ok THEN 0 ELSE {value} END) AS broken, bit_or(CASE WHEN ok THEN {value} ELSE 0 END) AS kept FROM found GROUP BY doc_id)
    SELECT doc_id, CAST(coalesce(broken, 0) AS BIGINT) AS broken, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST({bits.all()} & ~(coalesce(broken, 0) | coalesce(kept, 0)) AS BIGINT) AS unmet
    FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN words USING (doc_id)"""


def coverage(rule_ids) -> str:
    """Of each rule, the documents that break it, keep it and do not meet it."""
    rules = ", ".join(f"('{r}')" for r in sorted(rule_ids))
    return f"""WITH RECURSIVE {FOUND}, rules(rule_id) AS (VALUES {rules}), documents_of AS (SELECT DISTINCT doc_id FROM documents),
    states AS (SELECT doc_id, rule_id, bool_or(NOT ok) AS broken, bool_or(ok) AS kept FROM found GROUP BY doc_id, rule_id)
    SELECT rule_id, count(*) FILTER (broken) AS broken, count(*) FILTER (kept) AS kept, count(*) FILTER (broken IS NULL) AS unmet
    FROM rules CROSS JOIN documents_of LEFT JOIN states USING (doc_id, rule_id) GROUP BY rule_id"""
