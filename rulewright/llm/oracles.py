"""SQL twins of the operators that SQL can express, for small tables."""

from __future__ import annotations

from . import quality_rules as quality
from .url_filter import HOST_RULES

_WS = r"[\x20\x09-\x0D]+"

#: Components by repeated minima over links (a, b), for nodes n.
_REACH = """
    reach(node, low) AS (
        SELECT n, n FROM nodes
        UNION
        SELECT l.b, r.low FROM reach r JOIN both_ways l ON l.a = r.node WHERE r.low < l.b
    ),
    lowest AS (SELECT node, min(low) AS component_id FROM reach GROUP BY node)"""

EMBEDDING_DEDUP = f"""
WITH RECURSIVE unit AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
), usable AS (
    SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM unit
    WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), links AS (
    SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.label = y.label AND x.vec_id < y.vec_id AND len(x.v) = len(y.v)
    WHERE x.norm > 0 AND y.norm > 0 AND list_dot_product(x.v, y.v) / (x.norm * y.norm) >= 0.93
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
nodes AS (SELECT vec_id AS n FROM embeddings), {_REACH},
degree AS (SELECT a, count(*) AS n_links FROM both_ways GROUP BY a)
SELECT node AS vec_id, coalesce(n_links, 0) AS n_links, component_id, node = component_id AS kept FROM lowest LEFT JOIN degree ON a = node"""

_WORDS = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}'), lambda w: w <> '')"

SUBSTRING_DEDUP = f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS p FROM docs WHERE len(words) >= 50),
windows AS (SELECT doc_id, p, array_to_string(words[p:p + 49], ' ') AS content FROM starts),
first_of AS (SELECT content, min(doc_id) AS first_doc FROM windows GROUP BY content),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS place FROM windows JOIN first_of USING (content) WHERE first_doc < doc_id),
per_doc AS (SELECT doc_id, list(place) AS places FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
    sha256(array_to_string(CASE WHEN places IS NULL THEN words ELSE list_filter(words, lambda w, i: NOT list_contains(places, i)) END, ' ')) AS kept_sha256
FROM docs LEFT JOIN per_doc USING (doc_id)"""

_ASSIGN = """([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["\'\']?\\x20*[:=]\\x20*["\'\']?([A-Za-z0-9+/_.=-]+)"""


def _spans(kind: str, order: int, pattern: str, least: int, measured: str) -> str:
    """Matches and the gaps between them alternate; places are running sums of their lengths."""
    return f"""SELECT doc_id, {order} AS o, '{kind}' AS kind, unnest(list_transform(m, lambda x, i: {{\'s\': list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i-1], lambda y: length(y))), 0), \'n\': length(x), \'k\': {measured}}})) AS f
    FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_split_to_array(t, '{pattern}') AS g FROM texts)"""


SECRET_SCAN = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (
    {_spans("assign", 0, _ASSIGN, 12, f"length(regexp_extract(x, '{_ASSIGN}', 2))")}
    UNION ALL {_spans("access", 1, "AKIA[A-Z0-9]+", 18, "length(x)")}
    UNION ALL {_spans("hex", 2, "[0-9a-f]+", 16, "length(x)")}
), kept AS (
    SELECT doc_id, o, kind, CAST(f.s AS BIGINT) AS s, CAST(f.s + f.n AS BIGINT) AS e FROM found
    WHERE f.k >= CASE kind WHEN 'assign' THEN 12 WHEN 'access' THEN 18 ELSE 16 END
), joined AS (
    SELECT doc_id, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS spans FROM kept GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN joined USING (doc_id)"""


def _host_rules() -> str:
    rows = []
    for rule in HOST_RULES:
        host, slash, rest = rule.text.partition("/")
        rows.append(f"('{rule.text}', '{host}', '{slash}{rest}', '{rule.verdict}')")
    return ", ".join(rows)


URL_FILTER = f"""
WITH rules(rule, rule_host, rule_path, verdict) AS (VALUES {_host_rules()}),
cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
best AS (SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
    FROM parts LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(verdict, CASE
    WHEN regexp_matches(host || ' ' || path, '^[^ ]*\\bcheap-pills\\b|^([^ ]*\\.)?free-casino\\b|^([^ ]*\\.)?(ads|adserver|tracker)\\.') THEN 'block' ELSE 'allow' END) AS verdict
FROM best"""

_LOWER_WORDS = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WS}'), lambda w: w <> '')"

NEAR_DEDUP = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {_LOWER_WORDS} AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS p FROM docs WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 3], ' ') AS s FROM starts),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes i ON i.doc_id = a JOIN sizes k ON k.doc_id = b WHERE 100 * shared.n >= 80 * (i.n + k.n - shared.n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
nodes AS (SELECT doc_id AS n FROM docs), {_REACH}
SELECT node AS doc_id, coalesce(n, 0) AS n_shingles, component_id, node = component_id AS kept FROM lowest LEFT JOIN sizes ON doc_id = node"""


_D = range(4)
_PAIRS = [(i, j) for i in _D for j in range(i, 4)]
_MOMENTS = ["m", *(f"s{i}" for i in _D), *(f"q{i}{j}" for i, j in _PAIRS)]
_PARAMETERS = [*(f"u{i}" for i in _D), *(f"l{i}{j}" for i in _D for j in range(i + 1))]
_FLOOR2 = quality.FLOOR**2


def _sums(x: str = "x") -> str:
    return ", ".join(["count(*) AS m", *(f"sum({x}{i}) AS s{i}" for i in _D), *(f"sum({x}{i} * {x}{j}) AS q{i}{j}" for i, j in _PAIRS)])


def _moments(name: str, source: str, keys: str, factor: float) -> list[str]:
    """CTEs from moments to means u and the regularised covariance c."""
    mean = ", ".join(f"s{i}::DOUBLE / m / 1024 AS u{i}" for i in _D)
    cov = ", ".join(f"(q{i}{j}::DOUBLE / m / 1048576 - u{i} * u{j}) * {factor!r} + {_FLOOR2 if i == j else 0.0!r} AS c{i}{j}" for i, j in _PAIRS)
    return [f"{name}u AS (SELECT {keys}, m, {mean}, {', '.join(f'q{i}{j}' for i, j in _PAIRS)} FROM {source})", f"{name}c AS (SELECT {keys}, {', '.join(f'u{i}' for i in _D)}, {cov} FROM {name}u)"]


def _factors(name: str, source: str, keys: str) -> str:
    """A CTE from u and c to the Cholesky factor l and the log-determinant, by lateral columns."""
    low = []
    for i in _D:
        for j in range(i + 1):
            rest = f"c{j}{i}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            low.append(f"sqrt(greatest({rest}, {_FLOOR2 / 4!r})) AS l{i}{j}" if i == j else f"({rest}) / l{j}{j} AS l{i}{j}")
    return f"{name} AS (SELECT {keys}, {', '.join(f'u{i}' for i in _D)}, {', '.join(low)}, {' + '.join(f'2 * ln(l{i}{i})' for i in _D)} AS det FROM {source})"


def _distance(x: str = "v", g: str = "g") -> str:
    """Squared distance, by lateral columns z0..z3."""
    z = ", ".join(f"({x}.x{i} / 1024.0 - {g}.u{i}" + "".join(f" - {g}.l{i}{k} * z{k}" for k in range(i)) + f") / {g}.l{i}{i} AS z{i}" for i in _D)
    return f"{z}, z0 * z0 + z1 * z1 + z2 * z2 + z3 * z3 AS d2"


def _step(name: str, before: str) -> list[str]:
    """CTEs of one concentration step: the half of each group that is nearest by ``before``."""
    room = "half - ahead"
    taken = ", ".join(f"coalesce((sum({c}) FILTER ({room} >= m))::DOUBLE, 0) + coalesce((max({c}) FILTER ({room} > 0 AND {room} < m))::DOUBLE * (max(({room}) / m) FILTER ({room} > 0 AND {room} < m)), 0) AS {c}" for c in _MOMENTS)
    return [
        f"{name}d AS MATERIALIZED (SELECT v.grp, g.start, v.x0, v.x1, v.x2, v.x3, {_distance()} FROM vectors v JOIN {before} g ON v.grp = g.grp)",
        f"{name}n AS (SELECT grp, start, least({quality.CELLS - 1}, floor(log2(1 + d2) * {quality.CELLS_PER_UNIT})) AS cell, {_sums()} FROM {name}d GROUP BY ALL)",
        f"{name}h AS (SELECT *, sum(m) OVER (PARTITION BY grp, start ORDER BY cell) - m AS ahead, sum(m) OVER (PARTITION BY grp, start) * {quality.MAJORITY} AS half FROM {name}n)",
        f"{name}t AS (SELECT grp, start, {taken} FROM {name}h GROUP BY grp, start)",
        *_moments(name, f"{name}t", "grp, start", quality.consistency(quality.MAJORITY)),
        _factors(f"{name}f", f"{name}c", "grp, start"),
    ]


def _estimates(steps: int = 12) -> list[str]:
    """From ``vectors`` to ``final``: three starts, two steps each, the least determinant, steps until it settles, reweighting."""
    cell, unit = quality.START_CELL, quality.START_CELL / quality.SCALE
    out = [
        f"cells AS (SELECT grp, {', '.join(f'round(x{i} / {cell}.0) AS x{i}' for i in _D)} FROM vectors)",
        f"middle AS (SELECT grp, {', '.join(f'quantile_cont(x{i}, 0.5) AS u{i}' for i in _D)} FROM cells GROUP BY grp)",
        f"widths AS (SELECT grp, {', '.join(f'any_value(u{i}) * {unit!r} AS u{i}' for i in _D)}, {', '.join(f'sqrt((quantile_cont(abs(x{i} - u{i}), 0.5) * {unit * quality.DEVIATION!r}) ** 2 + {_FLOOR2!r}) AS w{i}' for i in _D)} FROM cells JOIN middle USING (grp) GROUP BY grp)",
        f"scores AS (SELECT grp, {', '.join(f'(x{i} / 1024.0 - u{i}) / w{i} AS z{i}' for i in _D)}, sqrt(z0 * z0 + z1 * z1 + z2 * z2 + z3 * z3) AS len FROM vectors JOIN widths USING (grp))",
        f"bent AS (SELECT grp, 1 AS start, {', '.join(f'CAST(round(tanh(z{i}) * 1024) AS BIGINT) AS t{i}' for i in _D)} FROM scores UNION ALL SELECT grp, 2, {', '.join(f'CAST(round(CASE WHEN len > 0 THEN z{i} / len ELSE 0 END * 1024) AS BIGINT)' for i in _D)} FROM scores)",
        f"shapes AS (SELECT grp, start, {_sums('t')} FROM bent GROUP BY grp, start)",
    ]
    spread = lambda a, b: f"(q{min(a, b)}{max(a, b)}::DOUBLE / m - (s{a}::DOUBLE / m) * (s{b}::DOUBLE / m))"
    shaped = ", ".join(f"w{i} * w{i} AS c{i}{i}" if i == j else f"w{i} * w{j} * {spread(i, j)} / sqrt(({spread(i, i)} + 1.0) * ({spread(j, j)} + 1.0)) AS c{i}{j}" for i, j in _PAIRS)
    plain = ", ".join(f"w{i} * w{i} AS c{i}{i}" if i == j else f"0.0 AS c{i}{j}" for i, j in _PAIRS)
    means = ", ".join(f"u{i}" for i in _D)
    out.append(f"start_c AS (SELECT grp, 0 AS start, {means}, {plain} FROM widths UNION ALL SELECT grp, start, {means}, {shaped} FROM shapes JOIN widths USING (grp))")
    out.append(_factors("step_0", "start_c", "grp, start"))
    for k in range(quality.FIRST_STEPS):
        out += [*_step(f"first{k}", f"step_{k}"), f"step_{k + 1} AS MATERIALIZED (SELECT * FROM first{k}f)"]
    out.append(f"now_0 AS MATERIALIZED (SELECT * FROM step_{quality.FIRST_STEPS} QUALIFY row_number() OVER (PARTITION BY grp ORDER BY det, start) = 1)")
    for k in range(steps):
        out += _step(f"more{k}", f"now_{k}")
        pick = ", ".join(f"CASE WHEN a.det - b.det >= {quality.SETTLED!r} THEN b.{c} ELSE a.{c} END AS {c}" for c in (*_PARAMETERS, "det"))
        out.append(f"now_{k + 1} AS MATERIALIZED (SELECT a.grp, a.start, {pick} FROM now_{k} a JOIN more{k}f b ON a.grp = b.grp)")
    out.append(f"inner_d AS (SELECT v.grp, v.x0, v.x1, v.x2, v.x3, {_distance()} FROM vectors v JOIN now_{steps} g ON v.grp = g.grp)")
    out.append(f"inner_m AS (SELECT grp, {_sums()} FROM inner_d WHERE d2 <= {quality.INNER!r} GROUP BY grp)")
    return [*out, *_moments("final_", "inner_m", "grp", quality.consistency(0.975)), _factors("final", "final_c", "grp")]


_GROUP = "concat_ws('/', {0}, CASE WHEN {0} < 2 THEN coalesce('=' || {1}, '-') END, CASE WHEN {0} < 1 THEN coalesce('=' || {2}, '-') END)"

QUALITY_RULES = f"""
WITH docs AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM documents),
spots AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM docs WHERE len(w) >= 8),
eights AS (SELECT doc_id, p, count(*) OVER same AS times, row_number() OVER (same ORDER BY p) AS nth FROM spots WINDOW same AS (PARTITION BY doc_id, array_to_string(w[p:p + 7], ' '))),
covered AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(p, p + 8)) AS place FROM eights WHERE times > 1) GROUP BY doc_id),
runs AS (SELECT doc_id, count(*) + 7 AS words FROM (SELECT doc_id, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS run FROM eights WHERE times > 1 AND nth = 1) GROUP BY doc_id, run),
passages AS (SELECT doc_id, max(words) AS words FROM runs GROUP BY doc_id),
base AS (SELECT docs.doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, len(ls) AS n_lines, coalesce(passages.words, 0) AS n_passage_words
    FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN passages USING (doc_id)),
stats AS MATERIALIZED (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    CAST(round(ln(greatest(word_chars, 1) / greatest(n_words, 1)) * {quality.LENGTH_FACTOR} * 1024) AS BIGINT) AS x0, CAST(round(ln(1 + n_symbols * {quality.SYMBOL_FACTOR} / greatest(n_words, 1)) * 1024) AS BIGINT) AS x1,
    CAST(round(ln(1 + greatest(n_dup_lines - 1, 0) * {quality.LINE_FACTOR} / greatest(n_lines, 1)) * 1024) AS BIGINT) AS x2, CAST(round(ln(1 + greatest(n_repeat_words - 2 * n_passage_words, 0) * {quality.REPEAT_FACTOR} / greatest(n_words, 1)) * 1024) AS BIGINT) AS x3 FROM base),
good AS (SELECT * FROM stats WHERE NOT base_failed),
sizes AS (SELECT lang, source, count(*) AS n, sum(count(*)) OVER (PARTITION BY lang) AS of_lang FROM good GROUP BY lang, source),
takes AS (SELECT lang, source, CASE WHEN n >= {quality.LEAST_GROUP} THEN 0 WHEN of_lang >= {quality.LEAST_GROUP} THEN 1 ELSE 2 END AS level, {_GROUP.format("level", "lang", "source")} AS grp FROM sizes),
vectors AS MATERIALIZED (SELECT {_GROUP.format("k", "lang", "source")} AS grp, x0, x1, x2, x3 FROM good CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) WHERE grp IN (SELECT t.grp FROM takes t)),
{", ".join(_estimates())},
far AS (SELECT v.doc_id, {_distance()} FROM good v JOIN takes t ON v.lang IS NOT DISTINCT FROM t.lang AND v.source IS NOT DISTINCT FROM t.source JOIN final g ON g.grp = t.grp)
SELECT s.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
    CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(d2 > {quality.CUT_OFF!r}, FALSE) AS kept
FROM stats s LEFT JOIN far USING (doc_id)"""


def _words_of(table: str, key: str, separators: str) -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"SELECT {key}, list_filter(regexp_split_to_array({lower}, '{separators}'), lambda x: x <> '') AS w FROM {table}"


_NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATION = f"""
WITH docs AS ({_words_of("documents", "doc_id", _NOT_ALNUM)}),
items AS ({_words_of("benchmark", "item_id", _NOT_ALNUM)}),
windows AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[p:p + 9], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS p FROM items WHERE len(w) > 0)),
spots AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
met AS MATERIALIZED (SELECT doc_id, item_id, p, spots.n FROM spots JOIN windows USING (n, s)),
hit AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(p, p + n)) AS place FROM met) GROUP BY doc_id),
listed AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM met WHERE item_id IS NOT NULL GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)"""

#: CRC-32 of the decimal id, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, 1 + length(CAST(doc_id AS VARCHAR))), lambda i: ascii(CAST(doc_id AS VARCHAR)[i])::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))))"""

#: Two places with the same six words, q apart, lie in a stretch of period q; runs are stretches that no shorter period has.
PERIODIC_RUNS = f"""
WITH plain AS (SELECT doc_id, {_WORDS} AS w, coalesce({_CRC}, 1) AS h FROM documents),
planted AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS change, (h // 10) % greatest(len(w), 1) AS a, h // 10 AS g FROM plain),
periods AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM planted),
docs AS MATERIALIZED (SELECT doc_id, CASE WHEN change THEN list_transform(range(0, n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[1 + a + (i - a) % p] END) ELSE w END AS w FROM periods),
sixes AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i + 1:i + 6], ' ') AS s FROM (SELECT doc_id, w, unnest(range(0, len(w) - 5)) AS i FROM docs WHERE len(w) >= 12)),
same AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM sixes x JOIN sixes y ON x.doc_id = y.doc_id AND x.s = y.s AND x.i < y.i),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same),
stretches AS (SELECT doc_id, min(i) AS start, max(i) - min(i) + 6 + q AS length, q FROM islands GROUP BY doc_id, q, island),
runs AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM stretches WHERE length >= greatest(12, 2 * q) GROUP BY doc_id, start, length),
per_doc AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM runs GROUP BY doc_id),
longest AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1),
gone AS (SELECT doc_id, list(DISTINCT place) AS places FROM (SELECT doc_id, unnest(range(start + period, start + length)) AS place FROM runs) GROUP BY doc_id)
SELECT docs.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256,
    sha256(array_to_string(CASE WHEN places IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(places, i - 1)) END, ' ')) AS collapsed_sha256
FROM docs LEFT JOIN per_doc USING (doc_id) LEFT JOIN longest USING (doc_id) LEFT JOIN gone USING (doc_id)"""

#: All shares written out, for every source and every kept term.
SOURCE_DIVERGENCE = r"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
words AS (SELECT r, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
posts AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
groups AS MATERIALIZED (SELECT DISTINCT lang, source FROM docs),
sizes AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
totals AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM posts GROUP BY ALL),
dense AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (coalesce(total, 0) + v) AS p
    FROM groups g JOIN kept k USING (lang) JOIN sizes USING (lang) LEFT JOIN totals USING (lang, source) LEFT JOIN posts USING (lang, source, term)),
of_lang AS (SELECT lang, sum(n)::HUGEINT AS total FROM posts GROUP BY lang),
shares AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (any_value(total) + any_value(v)) AS q FROM posts JOIN sizes USING (lang) JOIN of_lang USING (lang) GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, b.source AS item FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair_part AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM pairs LEFT JOIN sums USING (lang, source, item)),
term_part AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM dense JOIN shares USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pair_part UNION ALL FROM term_part))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200"""
