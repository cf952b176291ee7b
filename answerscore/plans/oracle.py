"""The scorer as DuckDB SQL: common table expressions that the oracle queries are put together from.

Each step is written from the definition, not from the DataFrame code: token rows, sets, matches, sums, penalties.
"""

from __future__ import annotations

from answerscore import lexicon
from answerscore.config import LEXICAL, Config
from answerscore.functions.text import GAP, LOWER, UPPER, WORD


def _in(col: str, words) -> str:
    return f"{col} IN (" + ", ".join(f"'{w}'" for w in words) + ")"


def _case(col: str, values: dict, other: str) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in values.items()) + f" ELSE {other} END"


def low(col: str) -> str:
    return f"translate({col}, '{UPPER}', '{LOWER}')"


def key(col: str) -> str:
    return f"replace({low(col)}, ',', '')"


def fnv(col: str) -> str:
    hx = f"hex(encode({col}))"
    digit = lambda at: f"(strpos('0123456789ABCDEF', substr({hx}, {at}, 1)) - 1)"
    return f"list_reduce(list_transform(range(0, length({hx}) // 2), lambda i: CAST(16 * {digit('2 * i + 1')} + {digit('2 * i + 2')} AS BIGINT)), lambda a, x: (xor(a, x) * 16777619) & 4294967295, CAST(2166136261 AS BIGINT))"


def mul32(x: str, factor: int) -> str:
    return f"CAST((CAST({x} AS HUGEINT) * {factor}) % 4294967296 AS BIGINT)"


def slot(gram: str) -> str:
    return f"(({mul32(gram, 0x9E3779B1)} >> 13) & 131071)"


SCALE1 = {k: v for k, v in lexicon.SCALES.items() if len(k) == 1}


def scale(k: str) -> str:
    last = f"right({low('tok')}, 1)"
    return f"CASE WHEN {_in(k, lexicon.SCALES)} THEN {_case(k, lexicon.SCALES, '0')} WHEN regexp_matches(tok, '^[0-9]') AND strlen(tok) >= 2 THEN {_case(last, SCALE1, '0')} ELSE 0 END"


def _stem() -> str:
    cut = lambda n: key(f"substr(tok, 1, length(tok) - {n})")
    l = low("tok")  # noqa: E741
    rules = f"WHEN strlen(tok) >= 7 AND {l} LIKE '%ing' THEN {cut(3)} "
    rules += " ".join(f"WHEN strlen(tok) >= 6 AND {l} LIKE '%{s}' THEN {cut(2)}" for s in ("ed", "ly", "es"))
    return f"CASE WHEN is_num THEN k {rules} WHEN strlen(tok) >= 5 AND {l} LIKE '%s' THEN {cut(1)} ELSE wk END"


def _alt() -> str:
    head = "regexp_extract(tok, '^[0-9][0-9.,]*')"
    return f"CASE WHEN is_num THEN k WHEN strlen(tok) >= 5 AND {low('tok')} LIKE '%ed' THEN {key('substr(tok, 1, length(tok) - 1)')} WHEN {head} <> '' AND length({head}) < length(tok) THEN {key(head)} ELSE wk END"


def tokens(source: str, whole: bool = False) -> str:
    """CTEs from ``texts(id, side, text)`` (defined by ``source``) to ``tok``: all tokens, or the first 2048."""
    pattern = f"({WORD})({GAP})"
    many = "len(toks)" if whole else "least(len(toks), 2048)"
    return f"""{source},
split AS (SELECT id, side, text, regexp_extract_all(text, '{pattern}', 1) AS toks, regexp_extract_all(text, '{pattern}', 2) AS gaps FROM texts),
spread AS (SELECT id, side, unnest(range(1, {many} + 1)) AS i, toks, gaps, regexp_matches(text, '^{WORD}') AS starts FROM split),
raw AS (SELECT id, side, i - 1 AS pos, toks[i] AS tok, gaps[i] AS gap, starts FROM spread),
keyed AS (SELECT *, {key('tok')} AS wk, regexp_matches(tok, '[A-Za-z]') AS alpha FROM raw),
numbered AS (SELECT *, {_case('wk', {k: str(v) for k, v in lexicon.NUMERALS.items()}, 'wk')} AS k,
    (regexp_matches(tok, '[0-9]') AND NOT alpha) OR {_in('wk', lexicon.NUMERALS)} AS is_num, regexp_matches(tok, '^[A-Z]') AS cap FROM keyed),
proper AS (SELECT *, cap AND (pos > 0 OR NOT starts) AS prop FROM numbered),
formed AS (SELECT id, side, pos, tok, k AS key, {_stem()} AS stem, {_alt()} AS alt,
    CAST(CASE WHEN is_num THEN 30000 WHEN {_in('k', lexicon.STOP)} THEN 1200 WHEN regexp_matches(tok, '[^\\x00-\\x7F]') THEN 5000
        ELSE 10000 + 600 * least(strlen(tok), 12) + CASE WHEN prop THEN 13000 ELSE 0 END END AS BIGINT) AS w,
    is_num AS numeric, prop AS proper, cap, regexp_matches(gap, '[.,;!?:]') AS bnd,
    CASE WHEN regexp_matches(tok, '^[A-Z]{{2,4}}$') THEN {low('tok')} ELSE '' END AS acro, {low("regexp_extract(tok, '^[A-Za-z]')")} AS first, {low("regexp_extract(tok, '^[A-Za-z]{0,4}')")} AS pre,
    {scale('k')} AS scale, {scale('wk')} AS wscale, coalesce(try_cast(nullif(replace(regexp_extract(tok, '^[0-9][0-9,]*([.][0-9][0-9,]*)?'), ',', ''), '') AS DOUBLE), 0) AS lead0 FROM proper),
tok AS MATERIALIZED (SELECT id, side, pos, tok, key, stem, alt, w, numeric, proper, cap, bnd, acro, first, pre, scale,
    CASE WHEN lead0 > 0 AND wscale > 0 THEN lead0 * pow(10.0, wscale) ELSE lead0 END
        * CASE WHEN lead(lead0) OVER o = 0 AND lead(wscale) OVER o > 0 THEN pow(10.0, lead(wscale) OVER o) ELSE 1.0 END AS val,
    coalesce(max(CASE WHEN {_in('key', lexicon.NEG)} THEN pos END) OVER (PARTITION BY id, side ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)
        > coalesce(max(CASE WHEN bnd THEN pos END) OVER (PARTITION BY id, side ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1), false) AS neg
    FROM formed WINDOW o AS (PARTITION BY id, side ORDER BY pos))"""


SIDES = "texts AS (SELECT id, 'q' AS side, q AS text FROM triples UNION ALL SELECT id, 'gt', gt FROM triples UNION ALL SELECT id, 'a', a FROM triples)"


def sides(triples: str, whole: bool = False) -> str:
    """CTEs from triples to ``tok``."""
    return tokens(f"{triples},\n{SIDES}", whole)


SETS = """sets AS MATERIALIZED (SELECT id, side, word, min(pos) AS first_pos FROM (SELECT id, side, pos, unnest([key, stem, alt]) AS word FROM tok) GROUP BY id, side, word)"""


def probe(side: str, other: str) -> str:
    """A subquery (id, pos, at): where tokens of ``side`` are matched in the set of ``other``."""
    return f"""(SELECT t.id, t.pos, coalesce(s1.first_pos, s2.first_pos, s3.first_pos) AS spot FROM tok t
    LEFT JOIN sets s1 ON s1.id = t.id AND s1.side = '{other}' AND s1.word = t.key LEFT JOIN sets s2 ON s2.id = t.id AND s2.side = '{other}' AND s2.word = t.stem
    LEFT JOIN sets s3 ON s3.id = t.id AND s3.side = '{other}' AND s3.word = t.alt WHERE t.side = '{side}')"""


def bridge(side: str, other: str) -> str:
    """A subquery (id, pos, first, last): acronyms of ``side`` and the content ranks of ``other`` they stand for."""
    lead = lambda n: f"CASE WHEN lead(first, {n}) OVER o <> '' THEN lead(first, {n}) OVER o END"
    initials = [" || ".join(f"({lead(i)})" for i in range(n)) for n in (2, 3, 4)]
    ini = "CASE length(s.acro) WHEN 2 THEN c.i2 WHEN 3 THEN c.i3 ELSE c.i4 END"
    return f"""(SELECT id, pos, first, last FROM (SELECT s.id, s.pos, c.rank AS first, CASE WHEN c.cap AND left(c.pre, length(s.acro)) = s.acro THEN c.rank ELSE c.rank + length(s.acro) - 1 END AS last,
        row_number() OVER (PARTITION BY s.id, s.pos ORDER BY c.rank) AS n
    FROM tok s JOIN (SELECT id, cap, pre, row_number() OVER o AS rank, {initials[0]} AS i2, {initials[1]} AS i3, {initials[2]} AS i4 FROM tok WHERE side = '{other}' AND w > 5000 WINDOW o AS (PARTITION BY id ORDER BY pos)) c ON c.id = s.id
    WHERE s.side = '{side}' AND s.acro <> '' AND ((c.cap AND left(c.pre, length(s.acro)) = s.acro) OR {ini} = s.acro)) WHERE n = 1)"""


def _covered(side: str, other: str) -> str:
    return f"""SELECT id, '{side}' AS side, pos FROM {bridge(side, other)} UNION SELECT c.id, '{other}', c.pos FROM (SELECT id, pos, row_number() OVER (PARTITION BY id ORDER BY pos) AS rank FROM tok WHERE side = '{other}' AND w > 5000) c
    JOIN {bridge(side, other)} b ON b.id = c.id AND c.rank BETWEEN b.first AND b.last"""


MARKED = f"""hits AS MATERIALIZED ({_covered('a', 'gt')} UNION {_covered('gt', 'a')}
    UNION SELECT t.id, t.side, t.pos FROM tok t WHERE t.scale > 0 AND t.side IN ('gt', 'a') AND EXISTS (SELECT 1 FROM tok o WHERE o.id = t.id AND o.side = CASE t.side WHEN 'gt' THEN 'a' ELSE 'gt' END AND o.scale = t.scale)),
marked AS MATERIALIZED (SELECT t.*, p.spot, q.spot IS NOT NULL AS in_q, h.pos IS NOT NULL AS hit FROM tok t
    JOIN (SELECT *, 'a' AS side FROM {probe('a', 'gt')} UNION ALL SELECT *, 'gt' FROM {probe('gt', 'a')}) p ON p.id = t.id AND p.side = t.side AND p.pos = t.pos
    JOIN (SELECT *, 'a' AS side FROM {probe('a', 'q')} UNION ALL SELECT *, 'gt' FROM {probe('gt', 'q')}) q ON q.id = t.id AND q.side = t.side AND q.pos = t.pos
    LEFT JOIN hits h ON h.id = t.id AND h.side = t.side AND h.pos = t.pos)"""
PRECISION = """prec AS (SELECT id, sum(CASE WHEN spot IS NOT NULL OR hit THEN w ELSE 0 END) / 10000.0 AS p_hit,
    sum(CASE WHEN spot IS NOT NULL OR hit THEN 100 * w WHEN in_q THEN 35 * w ELSE 100 * w END) / 1000000.0 AS p_tot,
    sum(CASE WHEN w > 5000 THEN w ELSE 0 END) / 10000.0 AS an_content, sum(CASE WHEN w > 5000 AND NOT in_q THEN w ELSE 0 END) / 10000.0 AS an_novel FROM marked WHERE side = 'a' GROUP BY id)"""
RECALL = """gtm AS (SELECT m.*, NOT m.hit AND m.spot IS NOT NULL AND a.neg AND NOT m.neg AND m.w > 5000 AS against FROM marked m LEFT JOIN tok a ON a.id = m.id AND a.side = 'a' AND a.pos = m.spot WHERE m.side = 'gt'),
gth AS (SELECT *, hit OR (spot IS NOT NULL AND NOT coalesce(against, false)) AS hard FROM gtm),
rec AS (SELECT id, sum(CASE WHEN hard THEN w ELSE 0 END) / 10000.0 AS r_hit, sum(w) / 10000.0 AS r_tot, sum(CASE WHEN hard AND NOT in_q THEN w ELSE 0 END) / 10000.0 AS k_hit,
    sum(CASE WHEN NOT in_q THEN w ELSE 0 END) / 10000.0 AS k_tot, sum(CASE WHEN against THEN w ELSE 0 END) / 10000.0 AS contra_w FROM gth GROUP BY id)"""


def clamp(x: str) -> str:
    return f"greatest(0.0, least(1.0, {x}))"


COMBINED = f"""sums AS (SELECT p.*, r.r_hit, r.r_tot, r.k_hit, r.k_tot, r.contra_w FROM prec p JOIN rec r ON r.id = p.id),
ratios AS (SELECT *, CASE WHEN p_tot > 0 THEN {clamp('CAST(p_hit AS DOUBLE) / p_tot')} ELSE 0 END AS p_raw, CASE WHEN r_tot > 0 THEN {clamp('CAST(r_hit AS DOUBLE) / r_tot')} ELSE 0 END AS r_all,
    CASE WHEN k_tot > 0 THEN {clamp('CAST(k_hit AS DOUBLE) / k_tot')} ELSE 0 END AS k_all, CASE WHEN an_content > 0 THEN CAST(an_novel AS DOUBLE) / an_content ELSE 0 END AS novelty FROM sums),
pr AS (SELECT *, p_raw * (2 - p_raw) AS p, CASE WHEN k_tot > 0 THEN {clamp('k_all * (0.5 + 0.5 * r_all) + 0.3 * r_all * greatest(0.0, least(1.0, (novelty - 0.2) * 3.0))')} ELSE r_all END AS r FROM ratios),
lexed AS (SELECT *, CASE WHEN 0.36 * p + r > 0 THEN 1.36 * p * r / (0.36 * p + r) ELSE 0 END AS lex FROM pr)"""


def gram_list(col: str, n: int) -> str:
    """A subquery expression: the distinct n-gram slots of a text column."""
    norm = f"hex(encode(ltrim(regexp_replace({low(col)}, '[\\x00-/:-@\\[-`{{-\\x7F]+', ' ', 'g'), ' ')))"
    digit = lambda at: f"(strpos('0123456789ABCDEF', substr(hx, {at}, 1)) - 1)"
    codes = f"list_transform(range(0, length(hx) // 2), lambda i: CAST(16 * {digit('2 * i + 1')} + {digit('2 * i + 2')} AS BIGINT))"
    gram = " + ".join(f"{256 ** (n - 1 - j)} * b[i + {j + 1}]" for j in range(n))
    place = f"((((({gram}) * {0x9E3779B1}) & 4294967295) >> 13) & 131071)"  # at most 24 bits times 32: no overflow
    return f"(SELECT list_distinct(list_transform(range(0, greatest(0, len(b) - {n - 1})), lambda i: {place})) FROM (SELECT {codes} AS b FROM (SELECT {norm} AS hx)))"


def likeness(g: str, a: str, contained: bool = True) -> str:
    inter = f"len(list_intersect({g}, {a}))"
    both = f"2.0 * {inter} / (len({g}) + len({a}))"
    best = f"greatest({both}, CAST({inter} AS DOUBLE) / len({g}))" if contained else both
    return f"CASE WHEN len({g}) = 0 OR len({a}) = 0 THEN 0.0 ELSE least(1.0, {best}) END"


GRAMS = f"""slots AS (SELECT id, {gram_list('gt', 3)} AS g3, {gram_list('a', 3)} AS a3, {gram_list('gt', 2)} AS g2, {gram_list('a', 2)} AS a2 FROM triples),
grams AS MATERIALIZED (SELECT id, {likeness('g3', 'a3')} AS gram3, {likeness('g2', 'a2')} AS gram2 FROM slots)"""
ADJACENT = f"""neighbours AS (SELECT DISTINCT id, side, prev, stem FROM (SELECT id, side, stem, lag(stem) OVER (PARTITION BY id, side ORDER BY pos) AS prev FROM tok WHERE w > 5000) WHERE prev IS NOT NULL),
bislots AS (SELECT id, side, list(DISTINCT {slot('xor(' + fnv('prev') + ', ' + mul32(fnv('stem'), 0x85EBCA6B) + ')')}) AS s FROM neighbours GROUP BY id, side),
adjacent AS (SELECT t.id, {likeness("coalesce(g.s, [])", "coalesce(a.s, [])", False)} AS adjacency, len(coalesce(g.s, [])) AS adjacency_gt, len(coalesce(a.s, [])) AS adjacency_a
    FROM (SELECT DISTINCT id FROM bislots) t LEFT JOIN bislots g ON g.id = t.id AND g.side = 'gt' LEFT JOIN bislots a ON a.id = t.id AND a.side = 'a')"""
ENTITY = f"""figs AS (SELECT id, side, pos, CASE WHEN numeric THEN key WHEN alt <> key AND scale <> 0 THEN alt END AS figure FROM tok),
near AS (SELECT f.id, f.side, f.pos, f.figure, e.stem AS entity, row_number() OVER (PARTITION BY f.id, f.side, f.pos ORDER BY abs(e.pos - f.pos), e.pos) AS n
    FROM figs f JOIN tok e ON e.id = f.id AND e.side = f.side AND e.cap AND e.w > 5000 AND e.pos <> f.pos AND abs(e.pos - f.pos) <= 4 WHERE f.figure IS NOT NULL),
enslots AS (SELECT id, side, list(DISTINCT {slot('xor(' + fnv('entity') + ', ' + mul32(fnv('figure'), 0xC2B2AE35) + ')')}) AS s FROM near WHERE n = 1 GROUP BY id, side),
entities AS (SELECT t.id, {likeness("coalesce(g.s, [])", "coalesce(a.s, [])", False)} AS entity, len(coalesce(g.s, [])) AS entity_gt, len(coalesce(a.s, [])) AS entity_a
    FROM (SELECT DISTINCT id FROM enslots) t LEFT JOIN enslots g ON g.id = t.id AND g.side = 'gt' LEFT JOIN enslots a ON a.id = t.id AND a.side = 'a')"""
CLOSE = "abs(x.val - y.val) / CASE WHEN greatest(abs(x.val), abs(y.val)) > 1e-6 THEN greatest(abs(x.val), abs(y.val)) ELSE 1.0 END <= 0.005"
NUMBERS = f"""nums AS (SELECT t.id, count(*) AS gt_nums, count(s.word) AS gt_nums_hit FROM tok t LEFT JOIN sets s ON s.id = t.id AND s.side = 'a' AND s.word = t.key WHERE t.side = 'gt' AND t.numeric GROUP BY t.id),
wrong AS (SELECT t.id, count(*) AS n FROM tok t WHERE t.side = 'a' AND t.numeric AND NOT EXISTS (SELECT 1 FROM sets s WHERE s.id = t.id AND s.side IN ('gt', 'q') AND s.word = t.key) GROUP BY t.id),
gtf AS (SELECT x.id, count(*) AS gt_fig, count(*) FILTER (EXISTS (SELECT 1 FROM tok y WHERE y.id = x.id AND y.side = 'a' AND y.val > 0 AND {CLOSE})) AS gt_fig_hit FROM tok x WHERE x.side = 'gt' AND x.val > 0 GROUP BY x.id),
fgn AS (SELECT x.id, count(*) AS n FROM tok x WHERE x.side = 'a' AND x.val > 0 AND abs(x.val - 1) >= 1e-6 AND NOT EXISTS (SELECT 1 FROM tok y WHERE y.id = x.id AND y.side IN ('gt', 'q') AND y.val > 0 AND {CLOSE}) GROUP BY x.id),
numbers AS (SELECT n.id, n.gt_nums, n.gt_nums_hit, coalesce(w.n, 0) AS wrong_nums, coalesce(g.gt_fig, 0) AS gt_fig, coalesce(g.gt_fig_hit, 0) AS gt_fig_hit, coalesce(f.n, 0) AS foreign_fig
    FROM nums n LEFT JOIN wrong w ON w.id = n.id LEFT JOIN gtf g ON g.id = n.id LEFT JOIN fgn f ON f.id = n.id)"""


def _axis(name: str, pos, neg) -> str:
    s = f"CASE WHEN key = 'no' AND NOT bnd AND n <> 1 THEN 0 WHEN {_in('key', pos)} THEN 1 WHEN {_in('key', neg)} THEN -1 ELSE 0 END * CASE WHEN neg THEN -1 ELSE 1 END"
    return f"coalesce(arg_min({s}, pos) FILTER (({s}) <> 0), 0) AS {name}, coalesce(count(DISTINCT {s}) FILTER (({s}) <> 0) > 1, false) AS {name}_mixed"


STANCES = "stances AS (SELECT id, side, bool_or(" + _in("key", lexicon.NEG) + ") AS negates, " + ", ".join(_axis(*a) for a in lexicon.AXES) + " FROM (SELECT *, count(*) OVER (PARTITION BY id, side) AS n FROM tok) GROUP BY id, side)"


def _tally(kind: str) -> str:
    part = {
        "silent": "(g.{0} <> 0 AND a.{0} = 0)", "contra": "(g.{0} <> 0 AND a.{0} <> 0 AND a.{0} <> g.{0})",
        "two_faced": "(g.{0} <> 0 AND a.{0} = g.{0} AND a.{0}_mixed AND m.gram3 > 0.6)", "agree": "(g.{0} <> 0 AND a.{0} = g.{0} AND NOT (a.{0}_mixed AND m.gram3 > 0.6))",
    }[kind]
    return " + ".join(f"CAST({part.format(n)} AS INT)" for n, _, _ in lexicon.AXES) + f" AS {kind}"


TALLY = "tally AS (SELECT g.id, " + ", ".join(map(_tally, ("agree", "contra", "silent", "two_faced"))) + ", g.negates <> a.negates AS negation_differs FROM stances g JOIN stances a ON a.id = g.id AND a.side = 'a' JOIN grams m ON m.id = g.id WHERE g.side = 'gt')"
FEATURES = ",\n".join((SETS, MARKED, PRECISION, RECALL, COMBINED, GRAMS, ADJACENT, ENTITY, NUMBERS, STANCES, TALLY)) + """,
counts AS (SELECT id, count(*) FILTER (w > 5000 AND side = 'gt') AS content_gt, count(*) FILTER (w > 5000 AND side = 'a') AS content_a FROM tok GROUP BY id),
feats AS MATERIALIZED (SELECT l.*, g.gram3, g.gram2, c.content_gt, c.content_a, coalesce(j.adjacency, 0) AS adjacency, coalesce(e.entity, 0) AS entity, coalesce(e.entity_gt, 0) AS entity_gt, coalesce(e.entity_a, 0) AS entity_a,
    coalesce(n.gt_nums, 0) AS gt_nums, coalesce(n.gt_nums_hit, 0) AS gt_nums_hit, coalesce(n.wrong_nums, 0) AS wrong_nums, coalesce(n.gt_fig, 0) AS gt_fig, coalesce(n.gt_fig_hit, 0) AS gt_fig_hit, coalesce(n.foreign_fig, 0) AS foreign_fig,
    t.agree, t.contra, t.silent, t.two_faced, t.negation_differs
    FROM lexed l JOIN grams g ON g.id = l.id JOIN counts c ON c.id = l.id LEFT JOIN adjacent j ON j.id = l.id LEFT JOIN entities e ON e.id = l.id LEFT JOIN numbers n ON n.id = l.id LEFT JOIN tally t ON t.id = l.id)"""


def finished(config: Config = LEXICAL, base: str = "feats", raw: str = "lex_only", score: str | None = None) -> str:
    """CTEs from ``base``, features and what else ``raw`` needs, to ``scored(id, raw, score)``."""
    c = config
    score = score or f"{c.sharpen} * raw * raw * (3 - 2 * raw) + {1 - c.sharpen} * raw"
    return f"""facts AS (SELECT *, {clamp(f'{c.w_lex} * lex + {c.w_gram3} * gram3 + {c.w_gram2} * gram2')} AS lex_only, k_tot > 0 AND k_hit >= k_tot * 0.999 AS full_cover FROM {base}),
flags AS (SELECT *, full_cover AND p_raw >= 0.999 AND adjacency < 0.15 AND content_gt >= 3 AND content_a >= 3 AS reordered, entity_gt > 0 AND entity_a > 0 AND entity < 0.05 AND full_cover AS swapped, contra_w > 0 AND k_tot > 0 AS negated FROM facts),
s1 AS (SELECT *, {raw} * CASE WHEN reordered THEN {c.m_order} ELSE 1.0 END * CASE WHEN swapped THEN {c.m_entity} ELSE 1.0 END * CASE WHEN negated THEN 1 - {c.m_negcov} * least(1.0, CAST(contra_w AS DOUBLE) / k_tot) ELSE 1.0 END AS x1 FROM flags),
s2 AS (SELECT *, x1 * CASE WHEN gt_nums > 0 THEN {c.m_num_miss_base} + {1 - c.m_num_miss_base} * gt_nums_hit / gt_nums ELSE 1.0 END * CASE WHEN gt_nums > 0 AND wrong_nums > 0 AND gt_nums_hit < gt_nums THEN {c.m_num_wrong} ELSE 1.0 END AS x2 FROM s1),
s3 AS (SELECT *, CASE WHEN contra > 0 THEN x2 * {c.m_contra} WHEN two_faced > 0 THEN x2 * {c.m_two_faced} WHEN agree > 0 THEN x2 + (1 - x2) * {c.b_agree} WHEN silent > 0 THEN x2 * {c.m_silent} WHEN negation_differs THEN x2 * (1 - 0.35 * lex) ELSE x2 END AS x3,
    reordered OR swapped OR negated OR contra > 0 OR two_faced > 0 OR (agree = 0 AND silent = 0 AND negation_differs) AS claim_wrong FROM s2),
s4 AS (SELECT *, {clamp(f'CASE WHEN {c.m_num_match} > 0 AND gt_nums > 0 AND gt_fig > 0 AND gt_fig_hit = gt_fig AND foreign_fig = 0 AND NOT claim_wrong THEN x3 + (1 - x3) * {c.m_num_match} ELSE x3 END')} AS raw FROM s3),
scored AS (SELECT *, {clamp(score)} AS score FROM s4)"""


GUARDS = f"""guards AS (SELECT id, CASE WHEN NOT regexp_matches(a, '[^ \\t\\n\\f\\r]') THEN 0.0 WHEN gt = '' THEN 0.0
    WHEN {low(f"array_to_string(regexp_extract_all(gt, '{WORD}'), '')")} = {low(f"array_to_string(regexp_extract_all(a, '{WORD}'), '')")} THEN 1.0 END AS guard FROM triples)"""


def scored(triples: str, config: Config = LEXICAL, whole: bool = False) -> str:
    """CTEs from triples to ``final(id, score)``."""
    return f"""{sides(triples, whole)},
{FEATURES},
{finished(config)},
{GUARDS},
final AS (SELECT t.id, coalesce(g.guard, s.score, 0.0) AS score FROM triples t LEFT JOIN guards g ON g.id = t.id LEFT JOIN scored s ON s.id = t.id)"""
