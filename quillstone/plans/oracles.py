"""DuckDB SQL that gives the same rows as the queries, written apart from them: set-based steps over the same tables."""

from __future__ import annotations

import math
import re

from quillstone import config as C
from quillstone.operators.image import ANGLES, LUMA
from quillstone.sources.views import CELL, QUALITY
from quillstone.sources.views import PAGES as PAGE_COUNT

NL = "chr(10)"
MONEY = "DECIMAL(18,2)"

RECEIPTS = f"""
r_items AS (
  SELECT l_orderkey, p_name, CAST(l_extendedprice AS {MONEY}) AS price, CAST(l_tax AS DECIMAL(4,2)) AS rate,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) AS rn
  FROM lineitem JOIN part ON p_partkey = l_partkey),
r_sums AS (
  SELECT l_orderkey, max(CASE WHEN rn = 1 THEN p_name || ' Store' END) AS vendor,
         string_agg(p_name || ' ' || CAST(price AS VARCHAR), {NL} ORDER BY rn) FILTER (WHERE rn <= 5) AS items,
         CAST(sum(price) AS {MONEY}) AS subtotal, CAST(sum(price * rate) AS {MONEY}) AS tax
  FROM r_items GROUP BY l_orderkey),
r_all AS (
  SELECT s.*, o_orderdate AS d, CAST(subtotal + tax AS {MONEY}) AS total, CAST(l_orderkey % 4 = 0 AS INT) AS is_forged,
         CAST(subtotal + tax + CASE WHEN l_orderkey % 4 = 0 THEN 100 ELSE 0 END AS {MONEY}) AS shown
  FROM r_sums s JOIN orders ON o_orderkey = l_orderkey),
receipts AS (
  SELECT l_orderkey AS doc_id, vendor || {NL} || 'Receipt Date: ' || CASE l_orderkey % 6 WHEN 1 THEN strftime(d, '%m/%d/%Y') WHEN 2 THEN strftime(d, '%d.%m.%Y')
           WHEN 3 THEN strftime(d, '%b %-d, %Y') WHEN 4 THEN strftime(d, '%-d %B %Y') WHEN 5 THEN strftime(d, '%m/%d/%y') ELSE strftime(d, '%Y-%m-%d') END
           || {NL} || items || {NL} || 'Subtotal ' || subtotal || {NL} || 'Tax ' || tax || {NL} || 'TOTAL ' || shown AS text,
         vendor, strftime(d, '%Y-%m-%d') AS date, CAST(total AS VARCHAR) AS total, is_forged, CAST(shown AS VARCHAR) AS shown_total
  FROM r_all)"""

LINES = f"""
lines AS (
  SELECT doc_id, idx - 1 AS idx, trim(t) AS text, 10 * (idx - 1) AS top, 10 * (idx - 1) + 8 AS bottom, 8 * length(trim(t)) AS "right", lower(trim(t)) AS low, n, max_right, 10 * (n - 1) + 8 AS max_bottom
  FROM (SELECT doc_id, unnest(parts) AS t, generate_subscripts(parts, 1) AS idx, len(parts) AS n, list_max(list_transform(parts, lambda x: 8 * length(trim(x)))) AS max_right
        FROM (SELECT doc_id, string_split(text, {NL}) AS parts FROM receipts)))"""

AMOUNT = C.AMOUNT.replace("'", "''")


def any_of(c: str, terms) -> str:
    return "(" + " OR ".join(f"contains({c}, '{t}')" for t in terms) + ")"


def normalized(source: str, name: str) -> str:
    """CTEs that add value to a source with column token."""
    return f"""
{name}_c AS (SELECT *, regexp_replace(regexp_replace(token, '(?i)\\b(?:rm|usd|eur|aed)\\b', '', 'g'), '[^0-9,.+-]', '', 'g') AS c FROM {source}),
{name}_b AS (SELECT *, regexp_replace(c, '^[+-]', '') AS b FROM {name}_c),
{name}_n AS (SELECT *, length(b) - length(replace(b, ',', '')) AS commas, length(b) - length(replace(b, '.', '')) AS dots, replace(replace(b, ',', ''), '.', '') AS bare,
   length(regexp_extract(b, '[^,.]*$')) AS tail FROM {name}_b),
{name}_p AS (SELECT *, CASE
   WHEN commas > 0 AND dots > 0 AND regexp_matches(b, '\\.[^,]*$') THEN replace(b, ',', '')
   WHEN commas > 0 AND dots > 0 THEN replace(replace(b, '.', ''), ',', '.')
   WHEN commas + dots > 1 AND tail = 2 THEN left(bare, length(bare) - 2) || '.' || right(bare, 2)
   WHEN commas + dots = 1 AND tail IN (1, 2) THEN replace(b, ',', '.')
   ELSE bare END AS p FROM {name}_n),
{name} AS (SELECT *, CASE WHEN regexp_matches(p, '^([0-9]+\\.?[0-9]*|\\.[0-9]+)$') THEN (CASE WHEN c LIKE '-%' THEN '-' ELSE '' END) || CAST(TRY_CAST(p AS DECIMAL(38,2)) AS VARCHAR) END AS value,
   (NOT regexp_matches(token, '[.,]') AND length(regexp_replace(token, '[^0-9]', '', 'g')) >= 7) AS long_plain FROM {name}_p)"""


SHAPES = f"""regexp_matches(token, '[0-9]{{1,4}}[/-][0-9]{{1,2}}') AS date_like,
  (long_plain AND regexp_matches(regexp_replace(token, '^\\s+|\\s+$', '', 'g'), '^\\+?[0-9][0-9\\s().-]{{6,}}[0-9]$')) AS phone_like, (long_plain AND regexp_matches(token, '[0-9]{{7,}}')) AS invoice_like"""

TOKENS = f"""
both_src AS (SELECT 'receipt' AS src, doc_id, text FROM receipts UNION ALL SELECT 'document', doc_id, text FROM documents),
tok AS (SELECT src, doc_id, unnest(l) AS token, generate_subscripts(l, 1) - 1 AS ord FROM (SELECT src, doc_id, regexp_extract_all(replace(text, {NL}, '|'), '{AMOUNT}') AS l FROM both_src))"""

MONTH_NUMBERS = "{" + ", ".join(f"'{m}': {i}" for i, m in enumerate((m[:3] for m in C.MONTHS), 1)) + "}"
FULL_NAMES = ", ".join(f"'{m}'" for m in (*C.MONTHS, *{m[:3] for m in C.MONTHS}))


def dated(source: str, name: str) -> str:
    """CTEs that add iso and ambiguous to a source with column raw."""
    group = lambda p, k: f"regexp_extract(x, '{p}', {k})"
    yf, nu = "^([0-9]{4})([-/])([0-9]{1,2})([-/])([0-9]{1,2})$", "^([0-9]{1,2})([-/.])([0-9]{1,2})([-/.])([0-9]{4}|[0-9]{2})$"
    mf, df = "(?i)^([a-z]+) ([0-9]{1,2}),? ([0-9]{4}|[0-9]{2})$", "(?i)^([0-9]{1,2}) ([a-z]+) ([0-9]{4}|[0-9]{2})$"
    month = lambda e: f"list_position([{', '.join(repr(m[:3]) for m in C.MONTHS)}], CASE WHEN lower({e}) IN ({FULL_NAMES}) THEN lower(left({e}, 3)) END)"
    year = lambda e: f"CASE WHEN length({e}) = 2 THEN CAST({e} AS INT) + CASE WHEN CAST({e} AS INT) < 69 THEN 2000 ELSE 1900 END ELSE TRY_CAST({e} AS INT) END"
    day = lambda y, m, d: f"strftime(TRY_CAST(printf('%04d-%02d-%02d', {y}, {m}, {d}) AS DATE), '%Y-%m-%d')"
    return f"""
{name}_x AS (SELECT *, replace(regexp_replace(rtrim(trim(raw), '.'), '\\s+', ' ', 'g'), 'Sept', 'Sep') AS x FROM {source}),
{name}_p AS (SELECT *, CASE
   WHEN regexp_matches(x, '{yf}') AND {group(yf, 2)} = {group(yf, 4)} THEN {{'k': 'Y', 's': '', 'a': CAST({group(yf, 3)} AS INT), 'b': CAST({group(yf, 5)} AS INT), 'y': {year(group(yf, 1))}}}
   WHEN regexp_matches(x, '{nu}') AND {group(nu, 2)} = {group(nu, 4)} THEN {{'k': 'N', 's': {group(nu, 2)}, 'a': CAST({group(nu, 1)} AS INT), 'b': CAST({group(nu, 3)} AS INT), 'y': {year(group(nu, 5))}}}
   WHEN regexp_matches(x, '{mf}') THEN {{'k': 'Y', 's': '', 'a': {month(group(mf, 1))}, 'b': CAST({group(mf, 2)} AS INT), 'y': {year(group(mf, 3))}}}
   WHEN regexp_matches(x, '{df}') THEN {{'k': 'Y', 's': '', 'a': {month(group(df, 2))}, 'b': CAST({group(df, 1)} AS INT), 'y': {year(group(df, 3))}}}
   END AS p FROM {name}_x),
{name} AS (SELECT *, coalesce(p.k = 'N' AND p.s <> '.' AND p.a <= 12 AND p.b <= 12, false) AS ambiguous, CASE
   WHEN p.k = 'Y' THEN {day('p.y', 'p.a', 'p.b')}
   WHEN p.k = 'N' AND (p.s = '.' OR (p.a <= 12 AND p.b <= 12)) THEN {day('p.y', 'p.b', 'p.a')}
   WHEN p.k = 'N' THEN coalesce({day('p.y', 'p.a', 'p.b')}, {day('p.y', 'p.b', 'p.a')}) END AS iso FROM {name}_p)"""


DATE_STRINGS = """
date_strings AS (SELECT doc_id, unnest(l) AS raw, generate_subscripts(l, 1) - 1 AS style FROM (
  SELECT o_orderkey AS doc_id, [strftime(o_orderdate, '%Y-%m-%d'), strftime(o_orderdate, '%m/%d/%Y'), strftime(o_orderdate, '%d.%m.%Y'), strftime(o_orderdate, '%b %-d, %Y'), strftime(o_orderdate, '%-d %B %Y'),
    strftime(o_orderdate, '%m/%d/%y'), strftime(o_orderdate, '%d-%m-%Y'), strftime(o_orderdate, '%-d %b %y'), (o_orderkey % 40) || '/' || (o_orderkey % 15) || '/' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0')] AS l FROM orders))"""


def _sum(*terms: str) -> str:
    return "(" + " + ".join(terms) + ")"


def _d(x) -> str:
    return f"{x}::DOUBLE"


VENDOR_SCORE = _sum(
    f"CASE WHEN top <= max_bottom * {_d(0.35)} THEN {_d(2.0)} ELSE {_d(0.0)} END", f"greatest({_d(0.0)}, {_d(1.2)} - {_d(0.18)} * idx)", f"CASE WHEN idx < 3 THEN {_d(0.5)} ELSE {_d(0.0)} END",
    f"CASE WHEN length(text) >= 4 THEN {_d(0.5)} ELSE {_d(0.0)} END", f"CASE WHEN len(string_split(text, ' ')) <= 6 THEN {_d(0.4)} ELSE {_d(0.0)} END",
    f"CASE WHEN alpha / solid >= {_d(0.65)} THEN {_d(0.5)} WHEN alpha / solid < {_d(0.45)} THEN {_d(-0.8)} ELSE {_d(0.0)} END",
    f"CASE WHEN digits / solid > {_d(0.3)} THEN {_d(-1.4)} WHEN digits > 0 THEN {_d(-0.6)} ELSE {_d(0.0)} END", f"CASE WHEN {any_of('low', C.VENDOR_STOPS)} THEN {_d(-1.5)} ELSE {_d(0.0)} END",
    f"CASE WHEN regexp_full_match(text, '[^a-zA-Z]+') THEN {_d(-1.0)} ELSE {_d(0.0)} END", f"({_d(1.0)} - least(abs(\"right\" / {_d(2.0)} - max_right / {_d(2.0)}) / (max_right / {_d(2.0)}), {_d(1.0)})) * {_d(0.8)}",
)

VENDOR = f"""
v_lines AS (SELECT *, CAST(length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) AS DOUBLE) AS alpha, CAST(length(regexp_replace(text, '[^0-9]', '', 'g')) AS DOUBLE) AS digits, CAST(length(replace(text, ' ', '')) AS DOUBLE) AS solid FROM lines WHERE idx < 8),
v_scored AS (SELECT doc_id, idx, text, {VENDOR_SCORE} AS score FROM v_lines),
v_best AS (SELECT doc_id, first(text ORDER BY score DESC, idx) AS value, max(score) AS score FROM v_scored GROUP BY doc_id),
vendor_out AS (SELECT doc_id, CASE WHEN score >= 1 THEN value END AS vendor, CASE WHEN score >= 1 THEN round(least({_d(1.0)}, score / {_d(3.0)}), 6) ELSE 0 END AS vendor_confidence FROM v_best)"""

DATE_CANDIDATES = f"""
d_raw AS (SELECT doc_id, idx, text, low, unnest(l) AS c FROM (SELECT doc_id, idx, text, low, list_concat({', '.join(f"list_transform(regexp_extract_all(text, '(?i){p}'), lambda x: {{'s': {i}, 'raw': x}})" for i, p in enumerate(C.DATE_SHAPES))}) AS l FROM lines)),
d_flat AS (SELECT doc_id, idx, text, low, c.raw AS raw, c.s AS shape FROM d_raw),
{dated("d_flat", "d_read")},
d_cand AS (SELECT doc_id, idx, shape, raw, iso, {_d(1.2)} + (CASE WHEN {any_of('low', C.DATE_TERMS)} THEN {_d(0.6)} ELSE {_d(0.0)} END + CASE WHEN {any_of('low', C.DATE_STRONG_TERMS)} THEN {_d(0.2)} ELSE {_d(0.0)} END)
   + CASE WHEN ambiguous THEN {_d(-0.2)} ELSE {_d(0.4)} END + CASE WHEN regexp_matches(text, '{C.TIME}') THEN {_d(-0.7)} ELSE {_d(0.0)} END AS score FROM d_read WHERE iso IS NOT NULL)"""

DATE = f"""{DATE_CANDIDATES},
d_best AS (SELECT doc_id, first(iso ORDER BY score DESC, idx, shape) AS value, max(score) AS score FROM d_cand GROUP BY doc_id),
date_out AS (SELECT r.doc_id, CASE WHEN score >= {_d(0.8)} THEN value END AS date, CASE WHEN score >= {_d(0.8)} THEN round(least({_d(1.0)}, score / {_d(3.0)}), 6) ELSE 0 END AS date_confidence FROM receipts r LEFT JOIN d_best b ON r.doc_id = b.doc_id)"""

LINE_SCORE = _sum(
    *(f"CASE WHEN contains(low, '{t}') THEN {_d(1.2 if t == 'total' else 2.0)} ELSE {_d(0.0)} END" for t in C.POSITIVE_TERMS), *(f"CASE WHEN contains(low, '{t}') THEN {_d(-1.4)} ELSE {_d(0.0)} END" for t in C.NEGATIVE_TERMS),
    f"CASE WHEN (top + bottom) / {_d(2.0)} / max_bottom >= {_d(0.6)} THEN {_d(0.9)} WHEN (top + bottom) / {_d(2.0)} / max_bottom >= {_d(0.5)} THEN {_d(0.4)} ELSE {_d(0.0)} END",
    f"CASE WHEN idx >= greatest(0, n - 4) THEN {_d(0.4)} ELSE {_d(0.0)} END",
)


def offers(lines: str, conf: bool = False, stats: bool = False) -> str:
    """CTEs from lines to scored amounts, t_scored."""
    usual = f"+ CASE WHEN amount >= (SELECT q1 FROM stats) AND amount <= (SELECT q3 FROM stats) THEN {_d(0.5)} ELSE {_d(0.0)} END + CASE WHEN (SELECT s FROM stats) > 0 AND abs(amount - (SELECT m FROM stats)) > 3 * (SELECT s FROM stats) THEN {_d(-0.3)} ELSE {_d(0.0)} END"
    return f"""
t_lines AS (SELECT *, {LINE_SCORE} AS line_score FROM {lines}),
t_raw AS (SELECT * EXCLUDE (l), unnest(l) AS token, generate_subscripts(l, 1) AS ord FROM (SELECT *, regexp_extract_all(text, '{AMOUNT}') AS l FROM t_lines)),
{normalized("t_raw", "t_norm")},
t_shape AS (SELECT *, CAST(value AS DOUBLE) AS amount, {SHAPES} FROM t_norm WHERE value IS NOT NULL),
t_scored AS (SELECT *, line_score + CASE WHEN amount > 0 THEN {_d(0.8)} ELSE {_d(0.0)} END + CASE WHEN abs(amount - round_even(amount, 0)) > 1e-6 THEN {_d(0.2)} ELSE {_d(0.0)} END
   {usual if stats else ""} {f"+ CASE WHEN conf >= 65 THEN {_d(0.2)} ELSE {_d(0.0)} END" if conf else ""} + CASE WHEN contains(low, 'total') AND {any_of('low', C.SUBTOTAL_TERMS)} THEN {_d(-0.8)} ELSE {_d(0.0)} END
   + CASE WHEN date_like THEN {_d(-2.2)} ELSE {_d(0.0)} END + CASE WHEN phone_like THEN {_d(-2.0)} ELSE {_d(0.0)} END + CASE WHEN invoice_like THEN {_d(-1.8)} ELSE {_d(0.0)} END
   + CASE WHEN {" OR ".join(f"starts_with(low, '{t}')" for t in C.QUANTITY_STARTS)} THEN {_d(-1.2)} ELSE {_d(0.0)} END AS score FROM t_shape)"""


TOTAL_OF = f"""
t_best AS (SELECT doc_id, first(value ORDER BY score DESC, idx, ord) AS value, first(amount ORDER BY score DESC, idx, ord) AS amount, max(score) AS score FROM t_scored WHERE score > -1 GROUP BY doc_id),
t_sub AS (SELECT doc_id, list(amount) AS subs FROM t_scored WHERE {any_of('low', C.SUBTOTAL_TERMS)} GROUP BY doc_id),
t_tax AS (SELECT doc_id, list(amount) AS taxes FROM t_scored WHERE {any_of('low', C.TAX_TERMS)} GROUP BY doc_id),
t_hits AS (SELECT b.*, len(list_filter(coalesce(subs, []), lambda s: len(list_filter(coalesce(taxes, [{_d(0.0)}]), lambda x: abs(b.amount - (s + x)) <= {_d(0.06)})) > 0)) AS hits FROM t_best b LEFT JOIN t_sub USING (doc_id) LEFT JOIN t_tax USING (doc_id)),
t_fin AS (SELECT doc_id, value, amount, score + hits * {_d(1.2)} AS score FROM t_hits),
total_out AS (SELECT r.doc_id, CASE WHEN score >= {_d(0.9)} THEN value END AS total, CASE WHEN score >= {_d(0.9)} THEN round(least({_d(1.0)}, score / {_d(3.0)}), 6) ELSE 0 END AS total_confidence FROM receipts r LEFT JOIN t_fin USING (doc_id))"""

TOTAL = f"{offers('lines')}, {TOTAL_OF}"

FIELDS = f"{RECEIPTS}, {LINES}, {VENDOR}, {DATE}, {TOTAL}, fields_out AS (SELECT * FROM vendor_out JOIN date_out USING (doc_id) JOIN total_out USING (doc_id))"

WORDS = f"""
w_split AS (SELECT doc_id, idx, top, string_split(text, ' ') AS ws FROM lines),
w_flat AS (SELECT doc_id, idx, top, ws, unnest(ws) AS text, generate_subscripts(ws, 1) - 1 AS j FROM w_split),
words AS (SELECT doc_id, idx, idx * 1000 + j AS ord, text, 8 * (CASE WHEN j = 0 THEN 0 ELSE length(array_to_string(ws[1:j], ' ')) + 1 END) AS "left", top, 8 * length(text) AS width, 8 AS height,
   CAST((doc_id * 7 + idx * 13 + j * 29) % 101 AS DOUBLE) AS confidence FROM w_flat)"""

WORD_LINES = """
word_lines AS (SELECT doc_id, idx, string_agg(text, ' ' ORDER BY "left") AS text, min("left") AS "left", min(top) AS top, max("left" + width) AS "right", max(top + height) AS bottom, avg(confidence) AS conf FROM words GROUP BY doc_id, idx)"""

STATS = f"""
stats AS (SELECT count(*) AS n_amounts, avg(CAST(total AS DOUBLE)) AS m, stddev_pop(CAST(total AS DOUBLE)) AS s, quantile_cont(CAST(total AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(total AS DOUBLE), 0.75) AS q3,
   min(CAST(total AS DOUBLE)) AS lo, max(CAST(total AS DOUBLE)) AS hi, list_sort(list(DISTINCT vendor)) AS vendors, list(DISTINCT lower(vendor)) AS low_vendors FROM receipts)"""

CONSISTENCY = f"""
c_base AS (SELECT r.doc_id, r.text, coalesce(CAST(f.total AS DOUBLE), 0) AS a, f.total AS shown, lower(r.text) AS low, f.*, st.* FROM receipts r JOIN fields_out f USING (doc_id) CROSS JOIN stats st),
c_tok AS (SELECT doc_id, a, list_distinct(list_transform(regexp_extract_all(text, '[0-9][0-9.,]*'), lambda t: CASE WHEN ltrim(replace(t, ',', '.'), '0') = '' THEN '0' ELSE ltrim(replace(t, ',', '.'), '0') END)) AS toks FROM c_base),
c_var AS (SELECT doc_id, toks, CASE WHEN a > 0 THEN list_transform([CAST(CAST(a AS DECIMAL(28,2)) AS VARCHAR), CAST(CAST(a AS DECIMAL(28,1)) AS VARCHAR), CAST(CAST(round_even(a, 0) AS DECIMAL(28,0)) AS VARCHAR)], lambda t: CASE WHEN ltrim(t, '0') = '' THEN '0' ELSE ltrim(t, '0') END) ELSE [] END AS vars,
   list_min(list_transform(list_filter(toks, lambda t: regexp_matches(t, '^([0-9]+\\.?[0-9]*|\\.[0-9]+)$')), lambda t: abs(CAST(t AS DOUBLE) - a))) AS near FROM c_tok),
c_feat AS (SELECT b.*, CASE WHEN list_has_any(toks, vars) THEN {_d(1.0)} ELSE {_d(0.0)} END AS amount_in_text, CASE WHEN a > 0 THEN coalesce(near, a) ELSE {_d(0.0)} END AS amount_token_gap,
   CASE WHEN a > 0 AND s > 1e-6 THEN abs(a - m) / s ELSE {_d(0.0)} END AS amount_zscore,
   CASE WHEN a > 0 AND q3 - q1 > 1e-6 THEN CASE WHEN a < q1 THEN (q1 - a) / (q3 - q1) WHEN a > q3 THEN (a - q3) / (q3 - q1) ELSE {_d(0.0)} END ELSE {_d(0.0)} END AS amount_iqr_gap,
   CASE WHEN len(list_filter(low_vendors, lambda v: contains(low, v))) > 0 OR coalesce(list_contains(low_vendors, lower(b.vendor)), false) THEN {_d(1.0)} ELSE {_d(0.0)} END AS known_vendor_hit,
   len(list_filter(string_split(b.text, {NL}), lambda x: regexp_matches(x, '[0-9]'))) / CAST(len(string_split(b.text, {NL})) AS DOUBLE) AS numeric_line_ratio FROM c_base b JOIN c_var USING (doc_id)),
c_out AS (SELECT *, greatest({_d(0.0)}, least({_d(1.0)}, {_d(0.35)} * (1 - amount_in_text) + {_d(0.25)} * least(amount_zscore / 3, 1) + {_d(0.2)} * least(amount_iqr_gap, 1) + {_d(0.1)} * (1 - known_vendor_hit) + {_d(0.1)} * least(amount_token_gap / greatest(a, 1), 1))) AS consistency_risk,
   (CAST(vendor IS NOT NULL AS INT) + CAST(date IS NOT NULL AS INT) + CAST(total IS NOT NULL AS INT)) / {_d(3.0)} AS field_presence FROM c_feat),
h_out AS (SELECT *, consistency_risk > {_d(0.5)} AS r1, total_confidence < {_d(0.35)} AS r2, field_presence < {_d(0.67)} AS r3,
   CASE WHEN consistency_risk > {_d(0.5)} THEN {_d(0.25)} ELSE {_d(0.0)} END + CASE WHEN total_confidence < {_d(0.35)} THEN {_d(0.1)} ELSE {_d(0.0)} END + CASE WHEN field_presence < {_d(0.67)} THEN {_d(0.1)} ELSE {_d(0.0)} END AS score FROM c_out)"""

SCORED = f"{FIELDS}, {STATS}, {CONSISTENCY}"

TEXT = """
tf AS (SELECT doc_id, lang, text, CAST(length(text) AS DOUBLE) AS n, CAST(length(regexp_replace(text, '[^\\p{Nd}]', '', 'g')) AS DOUBLE) AS digits, CAST(length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS DOUBLE) AS letters,
   CAST(length(regexp_replace(text, '[^ \\n]', '', 'g')) AS DOUBLE) AS plain, string_split(regexp_replace(regexp_replace(text, '\\r\\n|[\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]', chr(10), 'g'), '\\n$', ''), chr(10)) AS ls,
   regexp_matches(text, '[^\\s]') AS solid FROM documents),
tl AS (SELECT *, list_filter(ls, lambda x: regexp_matches(x, '[^\\s]')) AS full_lines FROM tf),
text_out AS (SELECT doc_id, lang, CASE WHEN solid THEN n ELSE 0 END AS text_length, CASE WHEN solid THEN CAST(len(full_lines) AS DOUBLE) ELSE 0 END AS line_count, CASE WHEN solid THEN digits / n ELSE 0 END AS digit_ratio,
   CASE WHEN solid THEN letters / n ELSE 0 END AS alpha_ratio, CASE WHEN solid THEN (n - digits - letters - plain) / n ELSE 0 END AS special_ratio,
   CASE WHEN solid THEN list_sum(list_transform(full_lines, lambda x: length(x))) / CAST(len(full_lines) AS DOUBLE) ELSE 0 END AS avg_line_length, CASE WHEN solid THEN (len(ls) - len(full_lines)) / CAST(len(ls) AS DOUBLE) ELSE 0 END AS empty_line_ratio FROM tl)"""

PIXELS = """
px AS (SELECT vec_id, label, (i - 1) // 8 AS y, (i - 1) % 8 AS x, greatest(0, least(255, round_even(CAST(e AS DOUBLE) * 64 + 128, 0))) AS v FROM (SELECT vec_id, label, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings)),
ras AS (SELECT vec_id, avg(v) AS img_mean, stddev_pop(v) AS img_std, quantile_cont(v, 0.5) AS img_median, quantile_cont(v, 0.05) AS p5, quantile_cont(v, 0.95) AS p95 FROM px GROUP BY vec_id)"""


def levels(quality: int) -> str:
    """CTEs for lv, the pixels with the error level e of a JPEG round trip of 8 by 8 rasters, and ela, their features."""
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    table = ", ".join(LUMA.split())
    return f"""
cs AS (SELECT k, n, (CASE WHEN k = 0 THEN sqrt(CAST(0.125 AS DOUBLE)) ELSE CAST(0.5 AS DOUBLE) END) * cos((2 * n + 1) * k * pi() / 16) AS c FROM range(8) a(k), range(8) b(n)),
qt AS (SELECT (i - 1) // 8 AS u, (i - 1) % 8 AS w, CAST(greatest(1, least(255, floor((t * {scale} + 50) / 100))) AS DOUBLE) AS q FROM (SELECT unnest([{table}]) AS t, generate_subscripts([{table}], 1) AS i)),
f1 AS (SELECT vec_id, k AS u, x, sum(c * (v - 128)) AS s FROM px JOIN cs ON n = y GROUP BY vec_id, k, x),
f2 AS (SELECT vec_id, u, k AS w, sum(c * s) AS s FROM f1 JOIN cs ON n = x GROUP BY vec_id, u, k),
kq AS (SELECT vec_id, u, w, round_even(round(s, 6) / q, 0) * q AS s FROM f2 JOIN qt USING (u, w)),
b1 AS (SELECT vec_id, n AS y, w, sum(c * s) AS s FROM kq JOIN cs ON k = u GROUP BY vec_id, n, w),
b2 AS (SELECT vec_id, y, n AS x, sum(c * s) AS s FROM b1 JOIN cs ON k = w GROUP BY vec_id, y, n),
lv AS (SELECT vec_id, y, x, v, abs(v - greatest(0, least(255, round_even(round(s, 6) + 128, 0)))) AS e FROM px JOIN b2 USING (vec_id, y, x)),
ela AS (SELECT vec_id, avg(e) AS ela_mean, stddev_pop(e) AS ela_std, max(e) AS ela_max, avg(CASE WHEN e >= 25 THEN 1.0 ELSE 0.0 END) AS ela_high_ratio, CAST(0 AS DOUBLE) AS ela_block_std FROM lv GROUP BY vec_id)"""


_kernel = [math.exp(-d * d / 8) for d in range(-6, 7)]
STENCILS = f"""
nb AS (SELECT a.vec_id, a.y, a.x, any_value(a.v) AS v, count(*) AS near, sum(b.v) AS s FROM px a JOIN px b ON a.vec_id = b.vec_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY a.vec_id, a.y, a.x),
kn AS (SELECT unnest([{', '.join(f"CAST({k / sum(_kernel)!r} AS DOUBLE)" for k in _kernel)}]) AS g, unnest(range(-6, 7)) AS d),
g1 AS (SELECT a.vec_id, a.y, a.x, sum(g * b.v) AS s FROM px a, kn JOIN px b ON a.vec_id = b.vec_id AND a.x = b.x AND b.y = greatest(0, least(7, a.y + d)) GROUP BY a.vec_id, a.y, a.x),
g2 AS (SELECT a.vec_id, a.y, a.x, sum(g * b.s) AS s FROM g1 a, kn JOIN g1 b ON a.vec_id = b.vec_id AND a.y = b.y AND b.x = greatest(0, least(7, a.x + d)) GROUP BY a.vec_id, a.y, a.x),
noisy AS (SELECT vec_id, CASE WHEN near = 9 THEN greatest(0, least(255, 9 * v - nb.s)) ELSE v END AS edge, v - round_even(round(g2.s, 6), 0) AS noise FROM nb JOIN g2 USING (vec_id, y, x)),
sten AS (SELECT vec_id, avg(edge) AS edge_mean, stddev_pop(edge) AS edge_std, stddev_pop(noise) AS noise_std, avg(abs(noise)) AS noise_mean FROM noisy GROUP BY vec_id)"""

IMG = f"""{PIXELS}, {levels(QUALITY)}, {STENCILS},
bits AS (SELECT vec_id, -sum(n / 64.0 * log2(n / 64.0)) AS entropy FROM (SELECT vec_id, floor(v / 4) AS b, CAST(count(*) AS DOUBLE) AS n FROM px GROUP BY ALL) GROUP BY vec_id),
img AS (SELECT vec_id, img_mean, img_std, img_median, edge_mean, edge_std, noise_std, noise_mean, p95 - p5 AS dynamic_range, entropy, CAST(0 AS DOUBLE) AS block_var_std, img_std * img_std AS block_var_mean, CAST(1 AS DOUBLE) AS aspect_ratio,
   CAST(64 AS DOUBLE) AS total_pixels, p5, p95, ela_mean, ela_std, ela_max, ela_high_ratio, ela_block_std FROM ras JOIN sten USING (vec_id) JOIN bits USING (vec_id) JOIN ela USING (vec_id))"""

#: Rasters on the pages of receipts: the features of documents, hot cells and the error levels around fields (needs receipts and boxes).
ON_PAGES = f"""{IMG},
pg AS (SELECT doc_id, page_index, (doc_id * {PAGE_COUNT} + page_index) % (SELECT count(*) FROM embeddings) AS vec_id FROM receipts, range({PAGE_COUNT}) r(page_index)),
di AS (SELECT doc_id, {', '.join(f"{'max' if c in ('ela_max', 'ela_high_ratio') else 'avg'}({c}) AS {c}" for c in (*C.IMAGE_FEATURES, *C.ELA_FEATURES))} FROM pg JOIN img USING (vec_id) GROUP BY doc_id),
hot AS (SELECT doc_id, CAST(page_index AS INT) AS page, CAST(x * {CELL} AS INT) AS "left", CAST(y * {CELL} AS INT) AS top, CAST((x + 1) * {CELL} AS INT) AS "right", CAST((y + 1) * {CELL} AS INT) AS bottom, e AS ela FROM pg JOIN lv USING (vec_id) WHERE e >= 18),
rooms AS (SELECT doc_id, i, field, score, 0 AS x0, et AS y0, least({8 * CELL}, er) AS x1, least({8 * CELL}, eb) AS y1 FROM boxes),
shares AS (SELECT r.doc_id, field, e, CAST(greatest(0, least(y1, (y + 1) * {CELL}) - greatest(y0, y * {CELL})) * greatest(0, least(x1, (x + 1) * {CELL}) - greatest(x0, x * {CELL})) AS DOUBLE) AS a
   FROM rooms r JOIN pg ON pg.doc_id = r.doc_id AND page_index = 0 JOIN lv USING (vec_id)),
patched AS (SELECT doc_id, field, sum(a * e) / nullif(sum(a), 0) AS local_ela FROM shares GROUP BY doc_id, field)"""

DOC_SCORES = f"{TEXT}, scores AS (SELECT doc_id, round(least(1.0, special_ratio * 3), 9) AS score, 1 - quality AS label FROM text_out JOIN labels USING (doc_id))"

PREDICTIONS = """
pl AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN 'o' || (o_orderkey - 1) WHEN o_orderkey % 13 = 0 THEN '  ' WHEN o_orderkey % 17 = 0 THEN NULL ELSE 'o' || o_orderkey END AS id,
   o_orderkey % 31 > 0 AS has_id, o_orderkey % 37 > 0 AS has_flag, NOT (o_orderkey % 19 = 0 OR o_orderkey % 23 = 0 OR o_orderkey % 29 = 0) AS good_flag, o_orderkey % 41 = 0 AS bad_vendor FROM orders),
pd AS (SELECT *, row_number() OVER (PARTITION BY id, has_id ORDER BY k) AS nth, has_id AND id IS NOT NULL AND trim(id) <> '' AS good_id, 'line ' || k || ': ' AS pos FROM pl),
pv AS (SELECT k AS line_no, CASE WHEN NOT has_id THEN pos || 'missing required field ''id''' ELSE array_to_string(list_filter([
   CASE WHEN NOT has_flag THEN pos || 'missing required field ''is_forged''' END, CASE WHEN NOT good_id THEN pos || '''id'' must be a non-empty string' END,
   CASE WHEN good_id AND nth > 1 THEN pos || 'duplicate prediction id ''' || id || '''' END, CASE WHEN NOT has_flag OR NOT good_flag THEN pos || '''is_forged'' must be integer 0 or 1' END,
   CASE WHEN bad_vendor THEN pos || '''vendor'' must be string or null' END], lambda x: x IS NOT NULL), '; ') END AS problems FROM pd)"""


def rounded(*columns: str, places: int = 6) -> str:
    return ", ".join(f"round({c}, {places}) AS {c}" for c in columns)


ORACLES = {
    "text_features": f"WITH {TEXT} SELECT doc_id, {rounded(*C.TEXT_FEATURES, places=9)} FROM text_out",
    "text_features_by_lang": f"WITH {TEXT} SELECT lang, count(*) AS n, round(avg(text_length), 6) AS text_length, round(avg(line_count), 6) AS line_count, round(avg(digit_ratio), 6) AS digit_ratio, round(avg(alpha_ratio), 6) AS alpha_ratio, max(text_length) AS longest FROM text_out GROUP BY lang",
    "conversation_merge_text": r"SELECT conv_id, count(*) AS page_count, coalesce(string_agg(t, chr(10) ORDER BY turn, t) FILTER (WHERE t <> ''), '') AS text FROM (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM conversations) GROUP BY conv_id",
    "amount_tokens": f"WITH {RECEIPTS}, {TOKENS} SELECT src, doc_id, CAST(ord AS INT) AS ord, token FROM tok",
    "amount_normalize": f"WITH {RECEIPTS}, {TOKENS}, {normalized('tok', 'nt')} SELECT src, doc_id, CAST(ord AS INT) AS ord, value, {SHAPES} FROM nt",
    "date_normalize": f"WITH {DATE_STRINGS}, {dated('date_strings', 'ds')} SELECT doc_id, CAST(style AS INT) AS style, iso, ambiguous FROM ds",
    "date_candidates": f"WITH {RECEIPTS}, {LINES}, {DATE_CANDIDATES} SELECT doc_id, CAST(idx AS INT) AS idx, raw, iso, round(score, 6) AS score FROM d_cand",
    "extract_vendor": f"WITH {RECEIPTS}, {LINES}, {VENDOR} SELECT * FROM vendor_out",
    "extract_date": f"WITH {RECEIPTS}, {LINES}, {DATE} SELECT * FROM date_out",
    "extract_total": f"WITH {RECEIPTS}, {LINES}, {TOTAL} SELECT * FROM total_out",
    "extract_fields": f"WITH {FIELDS} SELECT * FROM fields_out",
    "simple_vendor": f"SELECT doc_id, list_filter(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1:5], lambda x: length(x) >= 3 AND NOT regexp_full_match(x, '[0-9\\s\\-/.:,$%]+') AND NOT {any_of('lower(x)', C.VENDOR_STOP_WORDS)})[1] AS vendor FROM documents",
    "vendor_prior_counts": f"WITH {RECEIPTS} SELECT lower(vendor) AS vendor, count(*) AS count FROM receipts GROUP BY 1",
    "total_subtotal_tax_check": f"WITH {RECEIPTS} SELECT doc_id, is_forged, is_forged = 0 AS consistent FROM receipts",
    "words_to_lines": f'WITH {RECEIPTS}, {LINES}, {WORDS}, {WORD_LINES} SELECT doc_id, CAST(idx AS INT) AS idx, text, "left", top, "right", bottom, round(conf, 6) AS conf FROM word_lines',
    "ocr_confidence_stats": f"WITH {RECEIPTS}, {LINES}, {WORDS} SELECT doc_id, round(avg(confidence / 100), 6) AS ocr_mean_confidence, round(avg(CASE WHEN confidence / 100 < 0.5 THEN 1.0 ELSE 0.0 END), 6) AS ocr_low_conf_ratio, CAST(count(*) AS DOUBLE) AS word_count FROM words GROUP BY doc_id",
    "field_word_overlap": f"""WITH {FIELDS}, {WORDS},
       bx AS (SELECT doc_id, 'vendor' AS field, first(idx ORDER BY score DESC, idx) AS idx, max(score) AS score, {_d(1.0)} AS least FROM v_scored GROUP BY doc_id
         UNION ALL SELECT doc_id, 'date', first(idx ORDER BY score DESC, idx, shape), max(score), {_d(0.8)} FROM d_cand GROUP BY doc_id
         UNION ALL SELECT t.doc_id, 'total', first(idx ORDER BY t.score DESC, idx, ord), max(f.score), {_d(0.9)} FROM t_scored t JOIN t_fin f ON t.doc_id = f.doc_id WHERE t.score > -1 GROUP BY t.doc_id),
       rooms AS (SELECT doc_id, field, greatest(0, l.top - 6) AS t, l.bottom + 6 AS b, l."right" + greatest(6, round_even(l."right" * {_d(0.15)}, 0)) AS r FROM bx JOIN lines l USING (doc_id, idx) WHERE score >= least)
       SELECT doc_id, field, round(avg(confidence / 100), 6) AS field_conf, count(*) AS words FROM rooms JOIN words w USING (doc_id) WHERE w.top < b AND w.top + 8 > t AND w."left" < r AND w.width > 0 GROUP BY doc_id, field""",
    "predict_without_words": f"""WITH {SCORED}, pw AS (SELECT doc_id, CASE WHEN consistency_risk > {_d(0.5)} THEN {_d(0.25)} ELSE {_d(0.0)} END + CASE WHEN a > 0 THEN {_d(0.0)} ELSE {_d(0.1)} END + CASE WHEN a > 0 THEN {_d(0.0)} ELSE {_d(0.1)} END AS score FROM c_out)
       SELECT doc_id, round(score, 6) AS score, CAST(score >= {_d(0.45)} AS INT) AS is_forged FROM pw""",
    "conflicting_amounts": f"""WITH {RECEIPTS}, {LINES}, {WORDS}, {WORD_LINES}, wl AS (SELECT w.doc_id, w.idx, w.text, w.top, w.bottom, lower(w.text) AS low, w.conf, max(w.bottom) OVER (PARTITION BY w.doc_id) AS max_bottom, count(*) OVER (PARTITION BY w.doc_id) AS n FROM word_lines w),
       {offers("wl", conf=True)}, found AS (SELECT doc_id, CAST(count(DISTINCT value) AS DOUBLE) AS k FROM t_scored s JOIN receipts r USING (doc_id) WHERE score >= {_d(0.9)} AND abs(amount - CAST(shown_total AS DOUBLE)) > {_d(0.06)} AND CAST(shown_total AS DOUBLE) > 0 GROUP BY doc_id)
       SELECT r.doc_id, coalesce(k, 0) AS field_conflict_count FROM receipts r LEFT JOIN found USING (doc_id)""",
    "training_stats": f"WITH {RECEIPTS}, {STATS} SELECT n_amounts, round(m, 4) AS amount_mean, round(s, 4) AS amount_std, round(q1, 4) AS amount_q1, round(q3, 4) AS amount_q3, round(lo, 4) AS amount_min, round(hi, 4) AS amount_max, CAST(len(vendors) AS INT) AS n_vendors, vendors[1] AS first_vendor, CAST(len(vendors) AS INT) AS n_known, CAST(n_amounts AS INT) AS n_dates, 1 AS n_formats FROM stats",
    "amount_zscore_iqr": "SELECT o_orderkey, round(abs(a - m) / s, 6) AS zscore, round(CASE WHEN a < q1 THEN q1 - a WHEN a > q3 THEN a - q3 ELSE 0 END / (q3 - q1), 6) AS iqr_gap FROM (SELECT o_orderkey, o_totalprice AS a FROM orders) CROSS JOIN (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders)",
    "known_vendor_hit": f"WITH {SCORED} SELECT doc_id, known_vendor_hit FROM c_out",
    "consistency_features": f"WITH {SCORED} SELECT doc_id, {rounded(*C.CONSISTENCY_FEATURES)} FROM c_out",
    "heuristic_score": f"WITH {SCORED} SELECT doc_id, round(score, 6) AS score, CAST(score >= {_d(0.45)} AS INT) AS is_forged FROM h_out",
    "forged_reasons": f"WITH {SCORED}, rs AS (SELECT unnest(list_filter([CASE WHEN r1 THEN '{C.REASONS[2]}' END, CASE WHEN r2 THEN '{C.REASONS[4]}' END, CASE WHEN r3 THEN '{C.REASONS[5]}' END], lambda x: x IS NOT NULL)) AS reason FROM h_out) SELECT reason, count(*) AS n FROM rs GROUP BY reason",
    "raster_stats": f"WITH {PIXELS} SELECT vec_id, {rounded('img_mean', 'img_std', 'img_median', 'p5', 'p95')}, round(p95 - p5, 6) AS dynamic_range FROM ras",
    "raster_entropy": f"WITH {PIXELS}, b AS (SELECT vec_id, floor(v / 4) AS bin, count(*) AS n FROM px GROUP BY 1, 2) SELECT vec_id, round(-sum(n / 64.0::DOUBLE * log2(n / 64.0::DOUBLE)), 6) AS entropy FROM b GROUP BY vec_id",
    "raster_blocks": f"WITH {PIXELS}, b AS (SELECT vec_id, var_pop(v) AS s FROM px GROUP BY vec_id, y // 4, x // 4) SELECT vec_id, round(avg(s), 10) AS block_var_mean, round(stddev_pop(s), 6) AS block_var_std FROM b GROUP BY vec_id",
    "raster_ela": f"WITH {PIXELS}, {levels(QUALITY)} SELECT vec_id, {rounded(*C.ELA_FEATURES)} FROM ela",
    "raster_error_levels": f"WITH {PIXELS}, {levels(C.DEFAULT.jpeg_quality)} SELECT vec_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(v AS BIGINT) AS v, CAST(e AS BIGINT) AS e FROM lv",
    "raster_edges_noise": f"WITH {PIXELS}, {STENCILS} SELECT vec_id, {rounded('edge_mean', 'edge_std', 'noise_std', 'noise_mean')} FROM sten",
    "raster_features": f"WITH {IMG} SELECT vec_id, {rounded(*C.IMAGE_FEATURES, *C.ELA_FEATURES)} FROM img",
    "raster_skew": f"""WITH {PIXELS}, up AS (SELECT vec_id, y * 4 + i AS y, x * 4 + j AS x, CASE WHEN v > 180 THEN 255 ELSE 0 END AS b FROM px, range(4) a(i), range(4) d(j)),
       an AS (SELECT unnest(range(9)) AS turn, unnest([{', '.join(f"CAST({a} AS DOUBLE)" for a in ANGLES)}]) AS deg),
       turned AS (SELECT vec_id, turn, deg, y, round_even(round(cos(radians(deg)) * (y - 15.5) + sin(radians(deg)) * (x - 15.5) + 15.5, 9), 0) AS sy, round_even(round(cos(radians(deg)) * (x - 15.5) - sin(radians(deg)) * (y - 15.5) + 15.5, 9), 0) AS sx FROM up, an),
       sums AS (SELECT a.vec_id, turn, deg, a.y, sum(coalesce(u.b, 255)) AS line FROM turned a LEFT JOIN up u ON u.vec_id = a.vec_id AND u.y = a.sy AND u.x = a.sx GROUP BY ALL),
       vars AS (SELECT vec_id, turn, deg, CAST(count(*) * sum(line * line) - sum(line) * sum(line) AS DOUBLE) / (count(*) * count(*)) AS score FROM sums GROUP BY ALL)
       SELECT vec_id, first(deg ORDER BY score DESC, turn) AS angle, round(max(score), 4) AS score FROM vars GROUP BY vec_id""",
    "page_feature_aggregate": f"WITH {PIXELS}, {levels(QUALITY)}, l AS (SELECT DISTINCT vec_id, label FROM px) SELECT label, round(avg(img_mean), 6) AS img_mean, round(avg(img_std), 6) AS img_std, round(avg(img_median), 6) AS img_median, round(avg(p95 - p5), 6) AS dynamic_range, round(avg(ela_mean), 6) AS ela_mean, round(max(ela_max), 6) AS ela_max, round(max(ela_high_ratio), 6) AS ela_high_ratio FROM ras JOIN ela USING (vec_id) JOIN l USING (vec_id) GROUP BY label",
    "field_match_eval": f"WITH {FIELDS}, m AS (SELECT r.vendor AS tv, r.date AS td, r.total AS tt, f.* FROM receipts r JOIN fields_out f USING (doc_id)) "
    + " UNION ALL ".join(
        f"SELECT '{f}' AS field, count(*) FILTER (WHERE {f} IS NOT DISTINCT FROM {t}) AS exact, count(*) FILTER (WHERE nullif(regexp_replace(lower({f}), '[^0-9a-z]+', '', 'g'), '') IS NOT DISTINCT FROM nullif(regexp_replace(lower({t}), '[^0-9a-z]+', '', 'g'), '')) AS normalized, count(*) AS total FROM m"
        for f, t in zip(C.FIELDS, ("tv", "td", "tt"), strict=True)
    ),
    "anomaly_metrics": f"""WITH {DOC_SCORES}, c AS (SELECT CAST(count(*) FILTER (WHERE label = 1 AND score >= 0.45) AS DOUBLE) AS tp, count(*) FILTER (WHERE label = 0 AND score >= 0.45) AS fp, count(*) FILTER (WHERE label = 1 AND score < 0.45) AS fn, count(*) AS n FROM scores)
       SELECT round((n - fp - fn) / CAST(n AS DOUBLE), 6) AS accuracy, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS "precision", round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1, n AS labeled_records FROM c""",
    "threshold_calibration": f"""WITH {DOC_SCORES}, t AS (SELECT DISTINCT round_even(score * 10000, 0) / 10000 AS t FROM scores),
       f AS (SELECT t, 2.0::DOUBLE * count(*) FILTER (WHERE score >= t AND label = 1) / (count(*) FILTER (WHERE score >= t) + count(*) FILTER (WHERE label = 1)) AS f1 FROM t CROSS JOIN scores GROUP BY t)
       SELECT round(t, 4) AS threshold, round(f1, 6) AS f1 FROM f ORDER BY round_even(f1 * 1e12, 0) DESC, round_even(abs(t - 0.45::DOUBLE) * 1e12, 0), t LIMIT 1""",
    "label_overrides": f"WITH {RECEIPTS} SELECT id, is_forged FROM (SELECT r.doc_id AS id, coalesce(l.toxic, CASE WHEN r.doc_id % 3 > 0 THEN r.is_forged END) AS is_forged FROM receipts r LEFT JOIN labels l ON l.doc_id = r.doc_id) WHERE is_forged IS NOT NULL",
    "prediction_validation": f"WITH {PREDICTIONS} SELECT line_no, problems FROM pv WHERE problems <> ''",
    "missing_extra_ids": "WITH g AS (SELECT DISTINCT l_orderkey + CASE WHEN l_orderkey % 100 = 0 THEN 1000000000 ELSE 0 END AS id FROM lineitem) SELECT o_orderkey AS id, 'missing' AS kind FROM orders WHERE o_orderkey NOT IN (SELECT id FROM g) UNION ALL SELECT id, 'extra' FROM g WHERE id NOT IN (SELECT o_orderkey FROM orders)",
    "duplicate_ids": "SELECT line_no, id FROM (SELECT event_id AS line_no, user_id || ':' || event_type AS id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS nth FROM events) WHERE nth > 1",
    "latency_percentiles": "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean_value, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type",
    "normalized_match_keys": "SELECT c_custkey, nullif(regexp_replace(lower(c_name || ' - ' || c_mktsegment), '[^0-9a-z]+', '', 'g'), '') AS match_key FROM customer",
    "document_summary": f"""WITH {SCORED} SELECT doc_id, coalesce(vendor, '') AS vendor, coalesce(date, '') AS date, coalesce(total, '') AS total, true AS ocr_text_present, CASE WHEN score >= {_d(0.45)} THEN 'Suspicious' ELSE 'Genuine' END AS status, round_even(score * 10000, 0) / 10000 AS score,
       {_d(0.45)} AS threshold, CAST(CAST(r1 AS INT) + CAST(r2 AS INT) + CAST(r3 AS INT) AS INT) AS reason_count, CASE WHEN r1 THEN '{C.REASONS[2]}' WHEN r2 THEN '{C.REASONS[4]}' WHEN r3 THEN '{C.REASONS[5]}' ELSE '' END AS strongest_signal FROM h_out""",
    "vendor_of_words": f"WITH {RECEIPTS} SELECT doc_id, list_filter(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1:5], lambda x: length(x) >= 3 AND NOT regexp_full_match(x, '[0-9\\s\\-/.:,$%]+') AND NOT {any_of('lower(x)', C.VENDOR_STOP_WORDS)})[1] AS vendor FROM receipts",
    "label_counts": "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY quality, toxic",
    "year_of_date": """SELECT o_orderkey, raw, CASE WHEN raw ~ '^20[0-9]{2}-' THEN CAST(left(raw, 4) AS INT) WHEN raw ~ '/20[0-9]{2}$' THEN CAST(right(raw, 4) AS INT) WHEN raw ~ '[.-][0-9]{2}$' THEN 2000 + CAST(right(raw, 2) AS INT) END AS year
       FROM (SELECT o_orderkey, unnest([strftime(o_orderdate, '%Y-%m-%d'), strftime(o_orderdate, '%d/%m/%Y'), strftime(o_orderdate, '%m.%d.%y'), strftime(o_orderdate, '%b'), '12 345']) AS raw FROM orders)""",
    "collection_summary": """SELECT o_orderpriority, count(*) AS n, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), 4) AS mean_amount, round(median(o_totalprice), 4) AS median_amount,
       min(CASE WHEN year(o_orderdate) >= 2000 THEN CAST(year(o_orderdate) AS INT) END) AS first_year, max(CASE WHEN year(o_orderdate) >= 2000 THEN CAST(year(o_orderdate) AS INT) END) AS last_year FROM orders GROUP BY o_orderpriority""",
    "generated_text": "SELECT o_orderkey, regexp_replace(o_orderpriority, '-', ' ', 'g') || CASE WHEN o_orderstatus = 'O' THEN '' ELSE ' ' || o_orderstatus END AS text, CAST(NULL AS VARCHAR) AS blank FROM orders",
    "null_baseline": "SELECT o_orderkey AS id, CAST(NULL AS VARCHAR) AS vendor, CAST(NULL AS VARCHAR) AS date, CAST(NULL AS VARCHAR) AS total, 0 AS is_forged FROM orders",
    "vendor_top": f"WITH {RECEIPTS} SELECT vendor, count(*) AS n FROM receipts GROUP BY vendor ORDER BY n DESC, vendor LIMIT 20",
}


# The rest: the whole analysis with words, regions and sentences.

#: Confidence of each field as it is, unrounded; a field that isn't found has 0.
EXACT = f"""
x_conf AS (SELECT r.doc_id, CASE WHEN v.score >= 1 THEN least({_d(1.0)}, v.score / {_d(3.0)}) ELSE 0 END AS cv, CASE WHEN d.score >= {_d(0.8)} THEN least({_d(1.0)}, d.score / {_d(3.0)}) ELSE 0 END AS cd,
   CASE WHEN t.score >= {_d(0.9)} THEN least({_d(1.0)}, t.score / {_d(3.0)}) ELSE 0 END AS ct, CASE WHEN v.score >= 1 THEN v.value END AS vv, CASE WHEN d.score >= {_d(0.8)} THEN d.value END AS vd, CASE WHEN t.score >= {_d(0.9)} THEN t.value END AS vt
   FROM receipts r LEFT JOIN v_best v USING (doc_id) LEFT JOIN d_best d USING (doc_id) LEFT JOIN t_fin t USING (doc_id))"""

PAGES = RECEIPTS.replace("\nreceipts AS (", "\nwhole AS (") + f""",
receipts AS (SELECT {{'d': doc_id, 'p': p}} AS doc_id, t AS text FROM (SELECT doc_id, unnest(string_split(text, {NL})) AS t, generate_subscripts(string_split(text, {NL}), 1) AS p FROM whole))"""

PRIORS = "priors AS (SELECT lower(vendor) AS pv, count(*) AS pn FROM receipts GROUP BY 1)"
WITH_PRIOR = f"{VENDOR_SCORE} + coalesce(least({_d(1.6)}, {_d(0.5)} + {_d(0.08)} * pn), {_d(0.0)}) + CASE WHEN pn IS NOT NULL THEN {_d(1.0)} ELSE {_d(0.0)} END AS score FROM v_lines LEFT JOIN priors ON pv = low)"
KNOWN_FORMAT = f"ELSE {_d(0.4)} END + CASE WHEN regexp_matches(raw, '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}$') THEN {_d(0.3)} ELSE {_d(0.0)} END"
LEARNED = f"""{RECEIPTS}, {LINES}, {STATS}, {PRIORS}, {VENDOR.replace(f"{VENDOR_SCORE} AS score FROM v_lines)", WITH_PRIOR)}, {DATE.replace(f"ELSE {_d(0.4)} END", KNOWN_FORMAT)}, {offers("lines", stats=True)}, {TOTAL_OF},
fields_out AS (SELECT * FROM vendor_out JOIN date_out USING (doc_id) JOIN total_out USING (doc_id))"""

FIELD_LINES = f"""
bx AS (SELECT doc_id, 0 AS i, 'vendor' AS field, first(idx ORDER BY score DESC, idx) AS idx, max(score) AS score, {_d(1.0)} AS least FROM v_scored GROUP BY doc_id
  UNION ALL SELECT doc_id, 1, 'date', first(idx ORDER BY score DESC, idx, shape), max(score), {_d(0.8)} FROM d_cand GROUP BY doc_id
  UNION ALL SELECT t.doc_id, 2, 'total', first(idx ORDER BY t.score DESC, idx, ord), max(f.score), {_d(0.9)} FROM t_scored t JOIN t_fin f ON t.doc_id = f.doc_id WHERE t.score > -1 GROUP BY t.doc_id),
boxes AS (SELECT doc_id, i, field, score, l.top, l.bottom, l."right", greatest(0, l.top - 6) AS et, l.bottom + 6 AS eb, l."right" + greatest(6, CAST(round_even(l."right" * {_d(0.15)}, 0) AS INT)) AS er FROM bx JOIN lines l USING (doc_id, idx) WHERE score >= least)"""

WORD_OFFERS = f"""{WORDS}, {WORD_LINES}, wl AS (SELECT w.doc_id, w.idx, w.text, w."left", w.top, w."right", w.bottom, lower(w.text) AS low, w.conf, max(w.bottom) OVER (PARTITION BY w.doc_id) AS max_bottom, count(*) OVER (PARTITION BY w.doc_id) AS n FROM word_lines w),
{re.sub(r"\bt_", "u_", offers("wl", conf=True))}"""

WORD_SLOTS = f"""
near AS (SELECT doc_id, field, avg(confidence / 100) AS fc FROM boxes JOIN words w USING (doc_id) WHERE w.top < eb AND w.top + 8 > et AND w."left" < er AND w.width > 0 GROUP BY doc_id, field),
clash AS (SELECT doc_id, CAST(count(DISTINCT u.value) AS DOUBLE) AS k FROM u_scored u JOIN c_out c USING (doc_id) WHERE u.score >= {_d(0.9)} AND c.a > 0 AND abs(u.amount - c.a) > {_d(0.06)} GROUP BY doc_id),
seen AS (SELECT doc_id, avg(confidence / 100) AS ocr_mean_confidence, avg(CASE WHEN confidence / 100 < 0.5 THEN {_d(1.0)} ELSE {_d(0.0)} END) AS ocr_low_conf_ratio, CAST(count(*) AS DOUBLE) AS word_count FROM words GROUP BY doc_id)"""

REGIONS = f"""
o_top AS (SELECT *, max(score) OVER (PARTITION BY doc_id) AS best FROM u_scored),
o_one AS (SELECT *, row_number() OVER (PARTITION BY doc_id, value ORDER BY score DESC, idx, ord) AS nth FROM o_top WHERE score >= greatest({_d(1.4)}, best - {_d(0.6)})),
o_rank AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, idx, ord) AS r, count(*) OVER (PARTITION BY doc_id) AS several FROM o_one WHERE nth = 1),
o_diff AS (SELECT o.*, coalesce(o.value <> f.total, false) AS differ, sum(CAST(coalesce(o.value <> f.total, false) AS INT)) OVER (PARTITION BY o.doc_id) AS others FROM o_rank o JOIN fields_out f ON f.doc_id = o.doc_id WHERE several > 1),
looks AS (
  SELECT doc_id, 2 AS source, row_number() OVER (PARTITION BY doc_id ORDER BY {_d(1.0)} - least({_d(1.0)}, score / {_d(3.0)}) DESC, i) AS r, 0 AS x0, et AS y0, er AS x1, eb AS y1 FROM boxes WHERE score / {_d(3.0)} < {_d(0.5)}
  UNION ALL SELECT doc_id, 3, r, "left", top, "right", bottom FROM o_diff WHERE CASE WHEN others > 0 THEN differ ELSE r > 1 END
  UNION ALL SELECT doc_id, 4, row_number() OVER (PARTITION BY doc_id ORDER BY confidence, ord), "left", top, "left" + width, top + height FROM words WHERE confidence < 45),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY source, r) AS spot FROM looks),
apart AS (SELECT doc_id, x0, y0, x1, y1, min(spot) AS spot FROM placed WHERE spot <= 6 GROUP BY ALL),
regions_out AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY spot) - 1 AS INT) AS place, CAST(x0 AS INT) AS "left", CAST(y0 AS INT) AS top, CAST(x1 AS INT) AS "right", CAST(y1 AS INT) AS bottom, 0 AS page FROM apart)"""


IMAGE_REGIONS = (
    REGIONS.replace("looks AS (\n", f"""looks AS (
  SELECT doc_id, 1 AS source, r, "left" AS x0, top AS y0, "right" AS x1, bottom AS y1, page FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ela DESC, page, top, "left") AS r FROM hot) WHERE r <= 3
  UNION ALL SELECT doc_id, 2, row_number() OVER (PARTITION BY doc_id ORDER BY greatest({_d(1.0)} - least({_d(1.0)}, score / {_d(3.0)}), coalesce(local_ela, 0) / {_d(18.0)}) DESC, i), x0, y0, x1, y1, 0
     FROM rooms LEFT JOIN patched USING (doc_id, field) WHERE least({_d(1.0)}, score / {_d(3.0)}) < {_d(0.5)} OR coalesce(local_ela, 0) >= 18
""")
    .replace(REGIONS[REGIONS.index("  SELECT doc_id, 2 AS source") : REGIONS.index("  UNION ALL SELECT doc_id, 3")], "")
    .replace('"right", bottom FROM o_diff', '"right", bottom, 0 FROM o_diff').replace("top + height FROM words", "top + height, 0 FROM words")
    .replace("SELECT doc_id, x0, y0, x1, y1, min(spot)", "SELECT doc_id, x0, y0, x1, y1, page, min(spot)").replace("0 AS page FROM apart", "CAST(page AS INT) AS page FROM apart")
)


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _listed(*cases: str) -> str:
    return f"list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL)"


def _pick(options, index: str) -> str:
    return f"[{', '.join(map(_q, options))}][CAST(({index}) % {len(options)} AS INT) + 1]"


SENTENCES = f"""
n_lists AS (SELECT *, {_listed(*(f"CASE WHEN coalesce({f}, '') = '' THEN '{f}' END" for f in C.FIELDS))} AS missing, {_listed(*(f"CASE WHEN {f} IS NOT NULL THEN '{f}' END" for f in C.FIELDS))} AS flagged,
   score >= {_d(0.45)} AS forged, CAST(r1 AS INT) + CAST(r2 AS INT) + CAST(r3 AS INT) AS n_reasons FROM h_out),
n_said AS (SELECT *, list_concat({_listed(_q(C.EVIDENCE[1]), f"CASE WHEN len(missing) > 0 THEN replace({_q(C.EVIDENCE[2])}, '%s', array_to_string(missing, '/')) END", f"CASE WHEN consistency_risk >= {_d(0.58)} THEN {_q(C.EVIDENCE[3])} END", f"CASE WHEN amount_zscore >= 2.5 OR amount_iqr_gap >= 1 THEN {_q(C.EVIDENCE[4])} END")},
   list_transform(flagged, lambda f: replace({_q(C.EVIDENCE[5])}, '%s', f))) AS said FROM n_lists),
n_parts AS (SELECT *, len(said) AS n, CASE WHEN score >= {_d(0.65)} OR len(said) >= 4 THEN 'strongly suggests' WHEN score >= {_d(0.45)} OR len(said) >= 2 THEN 'likely' ELSE 'possibly' END AS sure,
   (CAST(round_even(score * 100, 0) AS INT) + 1 + n_reasons) % 7 AS variant FROM n_said)"""

WORD_COLUMNS = {
    **{c: f"di.{c}" for c in (*C.IMAGE_FEATURES, *C.ELA_FEATURES)}, **{("text_line_count" if c == "line_count" else c): f"x.{c}" for c in C.TEXT_FEATURES}, **{c: f"c.{c}" for c in C.CONSISTENCY_FEATURES},
    "ocr_mean_confidence": "s.ocr_mean_confidence", "ocr_low_conf_ratio": "s.ocr_low_conf_ratio", "line_count": "x.line_count", "word_count": "s.word_count", "vendor_confidence": "e.cv", "date_confidence": "e.cd", "total_confidence": "e.ct",
    "field_presence": "c.field_presence", **{f"field_ela_{f}": f"coalesce((SELECT local_ela FROM patched WHERE patched.doc_id = c.doc_id AND field = '{f}'), 0)" for f in C.FIELDS}, **{f"field_conf_{f}": f"coalesce((SELECT fc FROM near WHERE near.doc_id = c.doc_id AND field = '{f}'), 0)" for f in C.FIELDS},
    **{f"field_present_{f}": f"CASE WHEN c.{f} IS NULL THEN 0 ELSE 1 END" for f in C.FIELDS}, "field_conflict_count": "coalesce(k.k, 0)", "amount": "c.a",
}

RECEIPT_TEXT = TEXT.replace("FROM documents)", "FROM (SELECT doc_id, '' AS lang, text FROM receipts))")
_four = lambda e, d=4: f"printf('%.{d}f', round(CAST({e} AS DOUBLE), {d}))"
_PROMPT_VALUES = {"consistency_risk": "consistency_risk", "amount_zscore": "amount_zscore", "amount_iqr_gap": "amount_iqr_gap", **{f"field_present_{f}": f"({f} IS NOT NULL)::INT" for f in C.FIELDS}}
PROMPT_HEAD = (
    "Prepare a forensic document analysis summary for this receipt.", "Requirements:", "- Write exactly 2 or 3 sentences.", "- Mention whether the receipt appears genuine or suspicious.",
    "- Reference the anomaly score and the strongest evidence.", "- If fields are missing or low-confidence, mention that briefly.", "",
)
PROMPT_LINES = [
    *map(_q, PROMPT_HEAD), f"'Anomaly score: ' || {_four('score')}", "'Decision threshold: 0.4500'", f"'Is forged: ' || CASE WHEN score >= {_d(0.45)} THEN 'True' ELSE 'False' END",
    "'Reasons: ' || coalesce(nullif(concat_ws(', ', " + ", ".join(f"CASE WHEN {r} THEN {_q(C.REASONS[i])} END" for r, i in (("r1", 2), ("r2", 4), ("r3", 5))) + "), ''), 'None')", "'Extraction results:'",
    *(f"'- {f.capitalize()}: value=' || coalesce(nullif({f}, ''), 'missing') || ', confidence=' || {_four(c, 3)}" for f, c in zip(C.FIELDS, ("cv", "cd", "ct"), strict=True)),
    "'OCR text present: True'", "'Page count: 1'", "'Key feature values:'", *(f"'- {c}: ' || {_four(_PROMPT_VALUES.get(c, '0'))}" for c in C.PROMPT_FEATURES),
]

ORACLES |= {
    "date_format_detect": f"WITH {DATE_STRINGS} SELECT CASE " + " ".join(f"WHEN regexp_matches(raw, '[0-9]{{4}}') = {str(f.find('%Y') >= 0).lower()} AND try_strptime(replace(raw, 'Sept', 'Sep'), '{f}') IS NOT NULL THEN '{f}'" for f in C.DATE_FORMATS) + " END AS format, count(*) AS n FROM date_strings GROUP BY 1",
    "extract_fields_with_stats": f"WITH {LEARNED} SELECT * FROM fields_out",
    "page_merge_best_field": f"""WITH {PAGES}, {LINES}, {VENDOR}, {DATE}, {TOTAL}, {EXACT} SELECT doc_id.d AS doc_id, """
    + ", ".join(f"first(v{c} ORDER BY c{c} DESC, doc_id.p) AS {f}, round(max(c{c}), 6) AS {f}_confidence" for f, c in zip(C.FIELDS, "vdt", strict=True)) + " FROM x_conf GROUP BY 1",
    "suspicious_regions": f"WITH {FIELDS}, {FIELD_LINES}, {ON_PAGES}, {WORD_OFFERS}, {IMAGE_REGIONS} SELECT * FROM regions_out",
    "field_error_levels": f'WITH {FIELDS}, {FIELD_LINES}, {ON_PAGES} SELECT doc_id, field, CAST(x0 AS INT) AS "left", CAST(y0 AS INT) AS top, CAST(x1 AS INT) AS "right", CAST(y1 AS INT) AS bottom, 0 AS page, round(local_ela, 6) AS local_ela FROM rooms LEFT JOIN patched USING (doc_id, field)',
    "hot_blocks": f'WITH {RECEIPTS}, boxes AS (SELECT 0 AS doc_id, 0 AS i, \'\' AS field, 0 AS score, 0 AS et, 0 AS er, 0 AS eb), {ON_PAGES} SELECT doc_id, CAST(ela AS DOUBLE) AS ela, "left", top, "right", bottom, page FROM hot',
    "field_overlays": f"""WITH {FIELDS}, {FIELD_LINES}, {WORD_OFFERS}, {REGIONS},
       shown AS (SELECT b.doc_id, 'field' AS kind, field || ': ' || CASE field WHEN 'vendor' THEN f.vendor WHEN 'date' THEN f.date ELSE f.total END AS label, 0 AS "left", CAST(top AS INT) AS top, CAST("right" AS INT) AS "right", CAST(bottom AS INT) AS bottom, 0 AS page FROM boxes b JOIN fields_out f USING (doc_id))
       SELECT * FROM shown UNION ALL SELECT doc_id, 'suspicious', 'suspicious', "left", top, "right", bottom, page FROM regions_out""",
    "feature_vector": f"WITH {SCORED}, {EXACT}, {FIELD_LINES}, {ON_PAGES}, {WORD_OFFERS}, {WORD_SLOTS}, {RECEIPT_TEXT} SELECT c.doc_id, 53 AS slots, " + ", ".join(f"round(CAST({e} AS DOUBLE), 6) AS {c}" for c, e in WORD_COLUMNS.items())
    + " FROM c_out c JOIN x_conf e USING (doc_id) JOIN seen s USING (doc_id) JOIN text_out x USING (doc_id) JOIN di USING (doc_id) LEFT JOIN clash k USING (doc_id)",
    "analyze_documents": f"""WITH {SCORED}, {FIELD_LINES}, {ON_PAGES}, {WORD_OFFERS}, {WORD_SLOTS}, {IMAGE_REGIONS}, counted AS (SELECT doc_id, count(*) AS n FROM regions_out GROUP BY doc_id),
       flags AS (SELECT h.*, ela_high_ratio > {_d(0.12)} AS ra, noise_std > 20 AS rn, s.ocr_low_conf_ratio > {_d(0.35)} AS rw FROM h_out h JOIN seen s USING (doc_id) JOIN di USING (doc_id)),
       judged AS (SELECT *, least({_d(1.0)}, {' + '.join(f"CASE WHEN {r} THEN {_d(w)} ELSE {_d(0.0)} END" for r, w in (("ra", 0.25), ("rn", 0.15), ("r1", 0.25), ("rw", 0.15), ("r2", 0.1), ("r3", 0.1)))}) AS total_score FROM flags)
       SELECT doc_id, vendor, date, total, round(total_score, 6) AS score, CAST(total_score >= {_d(0.45)} AS INT) AS is_forged, concat_ws('; ', {', '.join(f"CASE WHEN {r} THEN {_q(C.REASONS[i])} END" for i, r in enumerate(("ra", "rn", "r1", "rw", "r2", "r3")))}) AS reasons,
       CAST(coalesce(n, 0) AS INT) AS n_regions FROM judged LEFT JOIN counted USING (doc_id)""",
    "nlg_summary": f"""WITH {SCORED}, {SENTENCES} SELECT doc_id, CASE WHEN forged THEN {_pick(C.SUSPICIOUS_OPENERS, "variant")} || ' and ' || sure || ' alteration.' ELSE {_pick(C.GENUINE_OPENERS, "variant")} || ', although the available signals ' || sure || ' localized review.' END
       || ' ' || {_pick(C.LEADS, "n + CAST(round_even(score * 10, 0) AS INT) + 4")} || ' ' || CASE WHEN n = 1 THEN said[1] ELSE array_to_string(said[1:n - 1], ', ') || ', and ' || said[n] END || '. '
       || CASE WHEN forged AND len(flagged) > 0 THEN {_q(C.CLOSINGS[0])} WHEN len(missing) > 0 THEN {_q(C.CLOSINGS[1])} WHEN forged THEN {_q(C.CLOSINGS[2])} ELSE {_q(C.CLOSINGS[3])} END AS summary FROM n_parts""",
    "prompt_text": f"WITH {SCORED}, {EXACT} SELECT doc_id, concat_ws({NL}, {', '.join(PROMPT_LINES)}) AS prompt FROM h_out JOIN x_conf USING (doc_id)",
}
