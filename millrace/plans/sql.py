"""The registered queries in DuckDB's SQL, put together from the same vocabularies and constants."""

from __future__ import annotations

from millrace.functions.lexicon import vocabulary
from millrace.operators.claims import REASONS, RISK
from millrace.sources.derived import golden

# White space, and the patterns of millrace.functions.text in RE2's syntax.
WS = r"[\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
QUANTITY = (
    rf"(?i)\d+(?:[.,]\d+)?{WS}*%"
    rf"|\b\d{{1,3}}(?:[,. ]\d{{3}})*(?:\.\d+)?{WS}*(?:t\b|tonnes?|tco2e?|ktco2e?|mtco2e?|kt\b|mt\b|kg\b|kwh|mwh|gwh|twh|m3|m³|litres?|liters?|million|billion|bn\b)"
)
WORKPLACE = rf"(?i)\b(work|working|business|regulatory|operating|control|team|inclusive|safe){WS}+environment"
CAPTION = rf"(?i)^{WS}*(Figure|Table|Chart|Exhibit){WS}+\d"
LIST_ITEM = rf"^{WS}*(?:[-•·●▪◦*]|\d+[.)]|[a-zA-Z][.)]){WS}+"
PAGE_NUMBER = rf"^{WS}*(?:[-–—]{WS}*)?\d{{1,4}}(?:{WS}*[-–—])?{WS}*$"
TOKEN = r"[a-z0-9_]+|[^a-z0-9_\s]"
PIECE = r"(?:[a-zA-Z0-9_]+|[^a-zA-Z0-9_\s])\s*"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_of(name: str, low: str = "low") -> str:
    return "(" + " OR ".join(f"contains({low}, {q(t)})" for t in vocabulary()[name]) + ")"


def hits(name: str, low: str = "low") -> str:
    return "(" + " + ".join(f"CAST(contains({low}, {q(t)}) AS INTEGER)" for t in vocabulary()[name]) + ")"


def clean(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def stripped(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def tokens(x: str) -> str:
    return f"CAST(len(regexp_extract_all(lower({x}), '{TOKEN}')) AS INTEGER)"


def pieces(x: str) -> str:
    return rf"string_split(regexp_replace({x}, '([.!?]){WS}+', '\1' || chr(1), 'g'), chr(1))"


NATURE = rf"CAST(len(regexp_extract_all(low, '\bnature\b')) > len(regexp_extract_all(low, '\bnature\b{WS}+of\b')) AS INTEGER)"
ENVIRONMENT = f"({hits('topic_keywords')} + {NATURE})"
WORK = f"regexp_matches(low, '{WORKPLACE}')"

GOLDEN = "golden(id, sentence) AS (VALUES " + ", ".join(f"({r[0]}, {q(r[1])})" for r in golden()) + ")"
SENTS = rf"""{GOLDEN}, sents AS (
  SELECT doc_id, 1 AS page_number, CAST(i - 1 AS INTEGER) AS sent_idx, p[i] AS raw
  FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, {pieces("text")} AS p FROM documents WHERE text IS NOT NULL))
  UNION ALL SELECT d.doc_id, 2, 0, g.sentence FROM documents d JOIN golden g ON g.id = d.doc_id % 35 + 1
  UNION ALL SELECT d.doc_id, 2, 1, g.sentence FROM documents d JOIN golden g ON g.id = (d.doc_id * 2 + 31) % 35 + 1
)"""
FEATS = rf"""{SENTS}, cleaned AS (SELECT *, {clean("raw")} AS s FROM sents), feats AS (
  SELECT *, lower(s) AS low, CAST(len(string_split(s, ' ')) AS INTEGER) AS words, regexp_matches(s, '{QUANTITY}') AS quantity FROM cleaned
)"""
PREDICATES = {
    "length": "NOT (words BETWEEN 4 AND 45)",
    "not_assertion": f"NOT ((quantity OR {any_of('action_keywords')}) AND ({ENVIRONMENT} + {hits('social_keywords')} + {hits('governance_keywords')}) > 0)",
    "boilerplate": any_of("boilerplate_phrases"),
    "reference_dense": r"(len(regexp_extract_all(s, '\b\d[\d,.]*\b')) >= 5 OR len(regexp_extract_all(low, 'page ')) >= 2)",
    "navigation": f"({any_of('nav_pointer_phrases')} OR {hits('section_nav_words')} >= 2 OR ((contains(low, 'impact report') OR contains(low, 'sustainability report')) AND {hits('section_nav_words')} >= 1))",
    "governance_plumbing": f"(NOT quantity AND {any_of('gov_plumbing')})",
    "activity_report": any_of("activity_phrases"),
    "methodology": any_of("method_phrases"),
    "general_statement": f"(NOT quantity AND {any_of('general_statement_phrases')})",
    "risk_description": f"(NOT quantity AND {any_of('risk_phrases')})",
}
REASONED = f"{FEATS}, reasoned AS (SELECT *, CASE " + " ".join(f"WHEN {PREDICATES[r]} THEN '{r}'" for r in REASONS) + " END AS reason FROM feats)"
SEEN = f"{REASONED}, numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, low ORDER BY page_number, sent_idx) AS seen FROM reasoned WHERE reason IS NULL)"
FUTURE = any_of("future_markers")
CLAIM_TYPE = f"CASE WHEN {FUTURE} THEN 'Future Promise' WHEN quantity THEN 'Strong' ELSE 'Vague' END"
EVIDENCE = f"CASE WHEN quantity AND NOT {FUTURE} THEN 'Yes' WHEN quantity OR {any_of('evidence_refs')} THEN 'Partial' ELSE 'No' END"
TYPED = f"""(SELECT *, CASE WHEN {any_of("strong_gov")} AND g >= e AND g >= o THEN 'G' WHEN g > e AND g >= o THEN 'G' WHEN o > e AND o >= g THEN 'S' ELSE 'E' END AS ESG_Type FROM
  (SELECT *, CASE WHEN {WORK} AND {ENVIRONMENT} > 0 THEN {ENVIRONMENT} - 1 ELSE {ENVIRONMENT} END AS e, {hits("social_keywords")} + CAST({WORK} AS INTEGER) AS o, {hits("governance_keywords")} AS g FROM %s))"""
RISKS = "risks(ct, ev, risk) AS (VALUES " + ", ".join(f"({q(a)}, {q(b)}, {q(c)})" for a, b, c in RISK) + ")"
CLAIMS = f"""{SEEN}, {RISKS}, labelled AS (
  SELECT CAST(doc_id AS VARCHAR) AS Company, page_number AS Page, s AS Claim_Text, ESG_Type, {CLAIM_TYPE} AS Claim_Type, {EVIDENCE} AS Evidence_Exists FROM {TYPED % "numbered"} WHERE seen = 1
), claims AS (SELECT l.*, coalesce(r.risk, '') AS Risk_Signal FROM labelled l LEFT JOIN risks r ON r.ct = l.Claim_Type AND r.ev = l.Evidence_Exists)"""

BLOCKS = """lines AS (
  SELECT doc_id, source, ls, unnest(range(0, len(ls))) AS i FROM (SELECT doc_id, source, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents WHERE text IS NOT NULL)
), cut AS (SELECT doc_id, source, ls[i + 1] AS line, i, CAST(i // 8 + 1 AS INTEGER) AS page_number, CAST(i % 8 AS INTEGER) AS j FROM lines), blocks AS (
  SELECT doc_id, page_number, j + 1 AS src_idx, CASE WHEN j = 3 THEN '- ' || line WHEN j = 5 THEN 'Table ' || CAST(i + 1 AS VARCHAR) || ' ' || line ELSE line END AS text,
    72.0::DOUBLE AS x0, (100 + 80 * j)::DOUBLE AS y0, 540.0::DOUBLE AS x1, (160 + 80 * j)::DOUBLE AS y1, CASE WHEN j = 0 THEN 18.0::DOUBLE ELSE 10.0::DOUBLE END AS max_font, CASE WHEN j = 0 THEN 18.0::DOUBLE ELSE 10.0::DOUBLE END AS median_font, 792.0::DOUBLE AS page_height FROM cut
  UNION ALL SELECT doc_id, page_number, 0, source, 72, 20, 540, 40, 9, 9, 792 FROM cut WHERE j = 0
  UNION ALL SELECT doc_id, page_number, 9, CAST(page_number AS VARCHAR), 300, 750, 320, 765, 9, 9, 792 FROM cut WHERE j = 0
)"""
CELLS = "[CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), l_returnflag, l_linestatus]"
HEAD = "['order', 'line', 'part', 'supplier', 'quantity', 'flag', 'status']"
TABLES = f"""grids AS (
  SELECT l_orderkey - 1 AS doc_id, list({CELLS} ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_returnflag, l_linestatus) AS body FROM lineitem GROUP BY 1
), tables AS (
  SELECT d.doc_id, 1 AS page_number, 0 AS src_idx, list_concat([{HEAD}], coalesce(g.body, [])) AS data,
    CASE WHEN d.doc_id % 3 = 0 THEN 60.0::DOUBLE END AS x0, CASE WHEN d.doc_id % 3 = 0 THEN 250.0::DOUBLE END AS y0, CASE WHEN d.doc_id % 3 = 0 THEN 560.0::DOUBLE END AS x1, CASE WHEN d.doc_id % 3 = 0 THEN 345.0::DOUBLE END AS y1
  FROM documents d LEFT JOIN grids g USING (doc_id) WHERE d.doc_id % 3 <> 2
)"""
MARGIN = "(y1 < page_height * 0.12::DOUBLE OR y0 > page_height * 0.88::DOUBLE)"
HEADERS = f"""{BLOCKS}, marked AS (SELECT *, {clean("text")} AS header, page_height > 0 AND {MARGIN} AS margin FROM blocks), n AS (SELECT doc_id, max(page_number) + CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS n_pages FROM blocks GROUP BY 1), repeated AS (
  SELECT doc_id, header FROM (SELECT doc_id, header, count(DISTINCT page_number) AS shown FROM marked WHERE margin AND length(header) BETWEEN 1 AND 80 GROUP BY 1, 2) JOIN n USING (doc_id) WHERE n_pages >= 4 AND shown >= greatest(2, n_pages * 3 // 10)
), headless AS (
  SELECT * FROM marked m WHERE NOT (margin AND regexp_matches(header, '{PAGE_NUMBER}')) AND NOT (margin AND EXISTS (SELECT 1 FROM repeated r WHERE r.doc_id = m.doc_id AND r.header = m.header))
), fonts AS (SELECT doc_id, page_number, coalesce(median(median_font) FILTER (WHERE median_font > 0), 10.0) AS page_font FROM headless GROUP BY 1, 2)"""
IOU = """CASE WHEN least(b.x1, t.x1) > greatest(b.x0, t.x0) AND least(b.y1, t.y1) > greatest(b.y0, t.y0) THEN
  (least(b.x1, t.x1) - greatest(b.x0, t.x0)) * (least(b.y1, t.y1) - greatest(b.y0, t.y0)) /
  ((b.x1 - b.x0) * (b.y1 - b.y0) + (t.x1 - t.x0) * (t.y1 - t.y0) - (least(b.x1, t.x1) - greatest(b.x0, t.x0)) * (least(b.y1, t.y1) - greatest(b.y0, t.y0))) ELSE 0.0::DOUBLE END"""
INSIDE = "(b.x0 >= t.x0 - 2 AND b.y0 >= t.y0 - 2 AND b.x1 <= t.x1 + 2 AND b.y1 <= t.y1 + 2)"
FREE = f"""{HEADERS}, {TABLES}, free AS (
  SELECT * FROM headless b WHERE NOT EXISTS (SELECT 1 FROM tables t WHERE t.doc_id = b.doc_id AND t.page_number = b.page_number AND t.x0 IS NOT NULL AND ({INSIDE} OR {IOU} > 0.3::DOUBLE))
)"""
BLOCK_TYPE = f"""CASE WHEN regexp_matches(string_split({stripped("text")}, chr(10))[1], '{CAPTION}') THEN 'caption'
  WHEN page_font > 0 AND max_font >= page_font * 1.2::DOUBLE AND ((length({stripped("text")}) < 200 AND NOT contains({stripped("text")}, chr(10))) OR length({stripped("text")}) < 120) THEN 'heading'
  WHEN regexp_matches(string_split({stripped("text")}, chr(10))[1], '{LIST_ITEM}') THEN 'list_item' ELSE 'paragraph' END"""
ORDER = "page_number, y, kind, src_idx"
ITEMS = f"""{FREE}, items AS (
  SELECT doc_id, page_number, 0 AS kind, src_idx, header AS whole, CAST(NULL AS VARCHAR[][]) AS data, round_even(y0, 1) AS y, x0, y0, x1, y1, {BLOCK_TYPE} AS content_type FROM free JOIN fonts USING (doc_id, page_number) WHERE header <> ''
  UNION ALL SELECT doc_id, page_number, 1, src_idx, CAST(NULL AS VARCHAR), data, coalesce(y0, 0.0), x0, y0, x1, y1, 'table' FROM tables
), placed AS (
  SELECT * EXCLUDE (above), CASE WHEN content_type <> 'heading' THEN above END AS heading_context FROM (
    SELECT *, last_value(CASE WHEN content_type = 'heading' THEN whole END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS above FROM items)
)"""


def markdown(data: str) -> str:
    width = f"list_max(list_transform({data}, lambda r: len(r)))"
    cell = stripped("replace(coalesce(c, ''), chr(10), ' ')")
    lines = f"list_transform({data}, lambda r: '| ' || array_to_string(list_concat(list_transform(r, lambda c: {cell}), list_transform(range(len(r), {width}), lambda k: '')), ' | ') || ' |')"
    rule = f"'| ' || array_to_string(list_transform(range(0, {width}), lambda k: '---'), ' | ') || ' |'"
    return f"array_to_string(list_concat(({lines})[1:1], [{rule}], ({lines})[2:]), chr(10))"


def packing(key: str) -> str:
    """A walk over numbered sentences (key, k, s, st): which piece each falls in."""
    return f"""walk AS (
  SELECT {key}, k, CASE WHEN st > 480 THEN 0 ELSE st END AS n, st <= 480 AS held, 1 AS c FROM numbered_sents WHERE k = 1
  UNION ALL SELECT {", ".join("w." + x.strip() for x in key.split(","))}, s.k,
    CASE WHEN s.st > 480 THEN 0 WHEN w.held AND w.n + s.st <= 480 THEN w.n + s.st ELSE s.st END, s.st <= 480,
    CASE WHEN s.st <= 480 AND w.held AND w.n + s.st <= 480 THEN w.c ELSE w.c + 1 END
  FROM walk w JOIN numbered_sents s ON {" AND ".join(f"s.{x.strip()} = w.{x.strip()}" for x in key.split(","))} AND s.k = w.k + 1
), grouped AS (
  SELECT {key}, c, min(k) AS first_k, string_agg(s, ' ' ORDER BY k) AS text, max(st) AS most FROM walk JOIN numbered_sents USING ({key}, k) GROUP BY ALL
), packed AS (
  SELECT {key}, first_k, 0 AS w, text FROM grouped WHERE most <= 480
  UNION ALL SELECT {key}, first_k, w, {stripped("array_to_string(tk[w * 430 + 1 : w * 430 + 480], '')")} FROM (
    SELECT {key}, first_k, tk, unnest(range(0, CAST(greatest(0, ceil((len(tk) - 480) / 430.0)) AS BIGINT) + 1)) AS w FROM (SELECT *, regexp_extract_all(text, '{PIECE}') AS tk FROM grouped WHERE most > 480))
)"""


def numbered_sents(source: str, key: str, text: str) -> str:
    return f"""split_sents AS (SELECT {key}, unnest(range(1, len(p) + 1)) AS i, p FROM (SELECT {key}, {pieces(text)} AS p FROM {source} WHERE {tokens(text)} > 480)),
numbered_sents AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY i) AS k, s, {tokens("s")} AS st FROM (SELECT {key}, i, {stripped("p[i]")} AS s FROM split_sents) WHERE s <> '')"""


KEY = "doc_id, page_number, src_idx"
CHUNKS = f"""{ITEMS}, big AS (SELECT * FROM placed WHERE kind = 0), {numbered_sents("big", KEY, "whole")}, {packing(KEY)}, parts AS (
  SELECT doc_id, page_number, y, kind, src_idx, 0 AS first_k, 0 AS w, whole AS text, content_type, heading_context, x0, y0, x1, y1 FROM placed WHERE kind = 0 AND {tokens("whole")} <= 480
  UNION ALL SELECT doc_id, page_number, y, kind, src_idx, first_k, w, text, content_type, heading_context, x0, y0, x1, y1 FROM packed JOIN big USING ({KEY})
  UNION ALL SELECT doc_id, page_number, y, kind, src_idx, 0, 0, {markdown("data")}, content_type, heading_context, x0, y0, x1, y1 FROM placed WHERE kind = 1
), chunks AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY {ORDER}, first_k, w) AS INTEGER) AS number FROM parts)"""
TOLD = f"""told AS (
  SELECT doc_id, 'extraction' AS phase, n_pages AS page_number, 0 AS seq, 0 AS sub, CASE WHEN doc_id % 8 = 0 THEN 'extraction error: no such font' ELSE 'text extraction returned empty' END AS message FROM n WHERE doc_id % 4 = 0
  UNION ALL SELECT doc_id, 'chunking', page_number, place, k, 'sentence exceeded 480 tokens (' || CAST(st AS VARCHAR) || '); split on tokens with 50-token overlap' FROM numbered_sents JOIN (SELECT doc_id, page_number, kind, src_idx, row_number() OVER (PARTITION BY doc_id ORDER BY {ORDER}) AS place FROM placed) USING ({KEY}) WHERE st > 480 AND kind = 0
), warned AS (SELECT doc_id, phase, page_number, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY phase <> 'extraction', page_number, seq, sub) AS INTEGER) AS seq, 'page ' || CAST(page_number AS VARCHAR) || ': ' || message AS message FROM told)"""
NOTES = """notes AS (
  SELECT o_orderkey AS doc_id, o_custkey, 'Order No. ' || CAST(o_orderkey AS VARCHAR) || ' of Dr. ' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' holds approx. ' || CAST(CAST(trunc(o_totalprice) AS BIGINT) AS VARCHAR) || ' crowns and may cost more crowns. It was placed on '
    || strftime(o_orderdate, '%Y-%m-%d') || ' by mail. Is it urgent? The desk of J. ' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' holds more mail, cf. note ' || CAST(o_orderkey AS VARCHAR) || '.' AS text
  FROM orders JOIN customer ON c_custkey = o_custkey
), noted AS (
  SELECT doc_id, 1 AS page_number, text FROM documents
  UNION ALL SELECT d.doc_id, 2, a.sentence || ' ' || b.sentence FROM documents d JOIN golden a ON a.id = d.doc_id % 35 + 1 JOIN golden b ON b.id = (d.doc_id * 2 + 31) % 35 + 1
  UNION ALL SELECT doc_id, 3, text FROM notes
)"""


def word(x: str) -> str:
    bare = rf"regexp_replace(regexp_replace(lower({x}), '^[^\p{{L}}\p{{N}}]+', ''), '[^\p{{L}}\p{{N}}]*$', '')"
    return rf"CASE WHEN regexp_matches({bare}, '^[\p{{N}}.,:/-]*\p{{N}}[\p{{N}}.,:/-]*$') THEN '#' ELSE {bare} END"


def ending(x: str) -> str:
    return rf"CASE WHEN regexp_matches({x}, '[\p{{L}}\p{{N}}]\.$') THEN '.' WHEN regexp_matches({x}, '[.!?]$') THEN '!' ELSE '' END"


def case_of(x: str) -> str:
    first = rf"regexp_extract({x}, '\p{{L}}|\p{{N}}')"
    return rf"CASE WHEN regexp_matches({first}, '\p{{Lu}}') THEN 'upper' WHEN regexp_matches({first}, '\p{{Ll}}') THEN 'lower' ELSE 'other' END"


def likelihood(k: str, n: str, p: str) -> str:
    held = f"least(greatest({p}, 1e-10::DOUBLE), 1 - 1e-10::DOUBLE)"
    return f"(({k}) * ln({held}) + (({n}) - ({k})) * ln(1 - {held}))"


def tied(first: str, total: str, least: float) -> str:
    """paired and second are columns; first and total expressions."""
    rest, out = f"greatest({total} - {first}, 0)", "greatest(second - paired, 0)"
    ratio = f"-2 * ({likelihood('paired', first, f'second / {total}')} + {likelihood(out, rest, f'second / {total}')} - {likelihood('paired', first, f'paired / {first}')} - {likelihood(out, rest, f'CASE WHEN {rest} > 0 THEN {out} / {rest} ELSE 0 END')})"
    return f"({ratio} >= {least} AND paired / {first} > second / {total})"


LENGTH = "length(replace(word, '.', ''))::DOUBLE"
SINGLE = r"regexp_matches({}, '^\p{{L}}$')"
LEARNED = rf"""{GOLDEN}, {NOTES}, toks AS (
  SELECT t[i] AS tok, CASE WHEN i > 1 THEN t[i - 1] END AS prev FROM (
    SELECT t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT list_filter(string_split_regex(replace(text, chr(1), ' '), '{WS}+'), lambda x: x <> '') AS t FROM (SELECT DISTINCT text FROM noted)))
), shaped AS (SELECT CASE WHEN ended = '.' THEN {word("prev")} ELSE '' END AS before, ended, {word("tok")} AS word, {ending("tok")} = '.' AS stop, {case_of("tok")} AS letter FROM (SELECT *, CASE WHEN prev IS NULL THEN '!' ELSE {ending("prev")} END AS ended FROM toks)),
counts AS (SELECT *, count(*)::DOUBLE AS n FROM shaped GROUP BY ALL),
words AS (SELECT word, sum(n) AS n, coalesce(sum(n) FILTER (WHERE stop), 0) AS k FROM counts WHERE word <> '' GROUP BY 1),
abbreviated AS (
  SELECT word FROM words, (SELECT sum(k) AS stops, sum(n) AS tokens FROM words) WHERE k > 0 AND regexp_matches(word, '\p{{L}}') AND NOT {SINGLE.format("word")}
  AND -2 * ({likelihood("k", "n", "stops / tokens")} - {likelihood("k", "n", "0.99::DOUBLE")}) * (length(word) - {LENGTH} + 1) * exp(-{LENGTH}) * exp(-(n - k) * ln({LENGTH})) >= 0.3
), after AS (SELECT *, before IN (SELECT word FROM abbreviated) OR before = '#' OR {SINGLE.format("before")} AS unsure FROM counts WHERE ended <> ''),
total AS (SELECT sum(n) AS total FROM counts), breaks AS (SELECT sum(n) AS first FROM after WHERE ended = '!' OR NOT unsure),
every AS (SELECT word, sum(n) AS second, coalesce(sum(n) FILTER (WHERE letter = 'lower'), 0) AS low, coalesce(sum(n) FILTER (WHERE letter = 'upper' AND ended = ''), 0) AS inside FROM counts GROUP BY 1),
starters AS (
  SELECT word FROM (SELECT word, sum(n) AS paired FROM after WHERE (ended = '!' OR NOT unsure) AND regexp_matches(word, '\p{{L}}') GROUP BY 1) JOIN every USING (word), breaks, total WHERE {tied("first", "total", 30.0)}
), collocated AS (
  SELECT before, word FROM (SELECT before, word, sum(n) AS paired FROM after WHERE ended = '.' AND word <> '' AND before <> '' AND (unsure OR word = '#') GROUP BY ALL HAVING sum(n) > 1)
  JOIN (SELECT word AS before, sum(n) AS first FROM counts WHERE stop AND word <> '' GROUP BY 1) USING (before) JOIN every USING (word), total WHERE word NOT IN (SELECT word FROM starters) AND {tied("first", "total", 7.88)}
), openers AS (SELECT word FROM every WHERE low > 0 AND inside = 0 AND word IN (SELECT word FROM after WHERE unsure AND ended = '.' AND letter = 'upper'))"""


def learned_pieces(source: str, key: str) -> str:
    """split(key, i, sentence) of a source with a text, by the learned lists."""
    return rf"""cut_up AS (SELECT {key}, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT {key}, string_split(regexp_replace(replace(text, chr(1), ' '), '([.!?])({WS}+)', '\1' || chr(1) || '\2' || chr(1), 'g'), chr(1)) AS p FROM {source} WHERE text IS NOT NULL)),
near AS (SELECT {key}, i, p[i] AS x, {word("l")} AS lw, {word("r")} AS rw, {case_of("r")} AS letter, {ending("l")} AS mark FROM (SELECT *, regexp_extract(p[i - 1], '[^\s]+$') AS l, regexp_extract(p[i + 1], '^[^\s]+') AS r FROM cut_up)),
judged AS (SELECT *, letter = 'upper' AND rw IN (SELECT word FROM openers) AS opens, letter = 'upper' AND rw IN (SELECT word FROM starters) AS starts, (lw, rw) IN (SELECT (before, word) FROM collocated) AS close FROM near),
ended AS (SELECT *, i % 2 = 0 AND (mark <> '.' OR NOT ((close AND NOT opens) OR CASE WHEN lw IN (SELECT word FROM abbreviated) THEN NOT (starts OR opens)
  WHEN lw = '#' OR {SINGLE.format("lw")} THEN letter = 'lower' OR ({SINGLE.format("lw")} AND letter = 'upper' AND NOT (starts OR opens)) ELSE false END)) AS cut FROM judged),
split AS (SELECT {key}, g AS i, string_agg(x, '' ORDER BY i) AS sentence FROM (SELECT *, sum(cut::INTEGER) OVER (PARTITION BY {key} ORDER BY i) AS g FROM ended) WHERE NOT cut GROUP BY ALL)"""


TOLD_GOLD = """gold_told AS (
  SELECT doc_id, gold_id, sentence AS original, quality = 1 AS is_real, CASE doc_id % 4 WHEN 0 THEN sentence WHEN 1 THEN upper(sentence) WHEN 2 THEN array_to_string(w[1 : greatest(len(w) - 1, 1)], ' ')
    ELSE array_to_string(w[1 : len(w) // 2], ' ') || ' and so on, in other terms that nobody kept' END AS text
  FROM (SELECT doc_id, gold_id, quality, sentence, string_split(sentence, ' ') AS w FROM (
    SELECT doc_id, max(quality) AS quality, unnest([0, 1]) AS gold_id FROM labels GROUP BY doc_id) JOIN golden ON id = CASE gold_id WHEN 0 THEN doc_id % 35 + 1 ELSE (doc_id * 2 + 31) % 35 + 1 END)
)"""


def distinct_tokens(x: str) -> str:
    return rf"list_distinct(regexp_extract_all(lower({clean(x)}), '[\p{{L}}\p{{N}}]+'))"


def gold_found(claims: str, keys: str, gold: str) -> str:
    """found(gold columns, as_topic or null): every gold row against every claim of its keys."""
    on = " AND ".join(f"c.{k.strip()} = g.{k.strip()}" for k in keys.split(","))
    same = ", ".join(f"g.{k.strip()}" for k in keys.split(","))
    return f"""pairs AS (
  SELECT {same}, g.gold_id, c.topic AS as_topic, c.text AS claim_text, len(list_intersect({distinct_tokens("g.text")}, {distinct_tokens("c.text")})) AS held, len({distinct_tokens("g.text")}) AS wanted FROM {gold} g JOIN {claims} c ON {on}
), best AS (SELECT {keys}, gold_id, as_topic FROM pairs WHERE held > 0 AND held * 100 >= wanted * 80 QUALIFY row_number() OVER (PARTITION BY {keys}, gold_id ORDER BY held DESC, claim_text) = 1),
found AS (SELECT g.*, b.as_topic, b.gold_id IS NOT NULL AS hit FROM {gold} g LEFT JOIN best b USING ({keys}, gold_id))"""


def recall_by(key: str) -> str:
    return f"""SELECT {key}, count(*) FILTER (WHERE is_real) AS real, count(*) FILTER (WHERE is_real AND hit) AS found, avg(hit::INTEGER::DOUBLE) FILTER (WHERE is_real) AS recall, count(*) FILTER (WHERE NOT is_real AND hit) AS admitted,
  avg(is_real::INTEGER::DOUBLE) FILTER (WHERE hit) AS precision, avg((topic = as_topic)::INTEGER::DOUBLE) FILTER (WHERE is_real AND hit) AS typed FROM found WHERE is_real IS NOT NULL GROUP BY {key}"""


GOLD = f"{TOLD_GOLD}, gold AS (SELECT doc_id, gold_id, text, is_real, ESG_Type AS topic FROM {TYPED % '(SELECT *, lower(original) AS low FROM gold_told)'})"
_NO_ENVIRONMENT = f"NOT ((quantity OR {any_of('action_keywords')}) AND {ENVIRONMENT} > 0)"
_PLAIN = f"CASE WHEN {hits('social_keywords')} > {ENVIRONMENT} AND {hits('social_keywords')} >= {hits('governance_keywords')} THEN 'S' WHEN {hits('governance_keywords')} > {ENVIRONMENT} THEN 'G' ELSE 'E' END"


def reason_of(reasons: tuple[str, ...], own: dict[str, str] | None = None) -> str:
    return "CASE " + " ".join(f"WHEN {(PREDICATES | (own or {}))[r]} THEN '{r}'" for r in reasons) + " END"


#: Each version by itself: its reasons, its first uses, its topics.
V1 = ("length", "not_assertion", "boilerplate", "reference_dense")
V2 = (*V1, "navigation", "methodology", "general_statement", "risk_description")
VERSIONED = f"""{FEATS}, r1 AS (SELECT *, {reason_of(V1, {"not_assertion": _NO_ENVIRONMENT})} AS reason, {_PLAIN} AS topic FROM feats),
r2 AS (SELECT * EXCLUDE (e, o, g, ESG_Type), ESG_Type AS topic FROM {TYPED % f"(SELECT *, {reason_of(V2)} AS reason FROM feats)"}), r3 AS (SELECT * EXCLUDE (e, o, g, ESG_Type), ESG_Type AS topic FROM {TYPED % f"(SELECT *, {reason_of(REASONS)} AS reason FROM feats)"}),
judged AS (SELECT 'v1' AS version, * FROM r1 UNION ALL BY NAME SELECT 'v2' AS version, * FROM r2 UNION ALL BY NAME SELECT 'v2.1' AS version, * FROM r3),
versioned AS (SELECT version, doc_id, page_number, sent_idx, s AS text, topic, low FROM judged WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY version, doc_id, low ORDER BY page_number, sent_idx) = 1)"""
JUDGES = "judges AS (SELECT l.doc_id, lang, quality AS reader, CASE WHEN text IS NOT NULL AND doc_id % 11 <> 0 THEN (len(string_split(trim(text), ' ')) >= 20)::INTEGER END AS length_rule, 1 - toxic AS tone_rule FROM labels l JOIN documents d USING (doc_id))"


CHUNK_ID = "'chunk_' || CASE WHEN number < 10000 THEN lpad(CAST(number AS VARCHAR), 4, '0') ELSE CAST(number AS VARCHAR) END"
SENT_KEYS = "doc_id, page_number, sent_idx"


def queries() -> dict[str, str]:
    any_lists = ["topic_keywords", "social_keywords", "governance_keywords", *(x for x in vocabulary() if x not in ("topic_keywords", "social_keywords", "governance_keywords", "section_nav_words"))]
    found = {
        "claims": f"WITH {CLAIMS} SELECT * FROM claims",
        "g01_sentences": f"WITH {SENTS} SELECT {SENT_KEYS}, raw FROM sents",
        "g01_trained": f"WITH {LEARNED}, {learned_pieces('noted', 'doc_id, page_number')} SELECT doc_id, page_number, i::INTEGER AS sent_idx, sentence AS raw FROM split",
        "g02_trained": f"""WITH RECURSIVE {LEARNED}, texts AS (SELECT o_custkey, string_agg(text, ' ' ORDER BY doc_id) AS text FROM notes GROUP BY 1), {learned_pieces("texts", "o_custkey")},
  sized AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY i) AS k, {stripped("sentence")} AS s, {tokens("sentence")} AS st FROM split),
  walk AS (SELECT o_custkey, k, st AS n, 0 AS c FROM sized WHERE k = 1 UNION ALL SELECT w.o_custkey, s.k, CASE WHEN w.n + s.st > 60 THEN s.st ELSE w.n + s.st END, CASE WHEN w.n + s.st > 60 THEN w.c + 1 ELSE w.c END FROM walk w JOIN sized s ON s.o_custkey = w.o_custkey AND s.k = w.k + 1)
  SELECT o_custkey, c::INTEGER AS piece_idx, string_agg(s, ' ' ORDER BY k) AS text FROM walk JOIN sized USING (o_custkey, k) GROUP BY ALL""",
        "p01_clean": f"WITH {FEATS} SELECT {SENT_KEYS}, s FROM feats",
        "p02_lower": f"WITH {FEATS} SELECT {SENT_KEYS}, low FROM feats",
        "p03_words": f"WITH {FEATS} SELECT {SENT_KEYS}, words FROM feats",
        "p04_quantity": f"WITH {FEATS} SELECT {SENT_KEYS}, quantity FROM feats",
        "p05_numbers": rf"WITH {FEATS} SELECT {SENT_KEYS}, CAST(len(regexp_extract_all(s, '\b\d[\d,.]*\b')) AS INTEGER) AS numbers FROM feats",
        "p06_page_mentions": f"WITH {FEATS} SELECT {SENT_KEYS}, CAST(len(regexp_extract_all(low, 'page ')) AS INTEGER) AS mentions FROM feats",
        "p07_any": f"WITH {FEATS} SELECT {SENT_KEYS}, {', '.join(f'{any_of(x)} AS any_{x}' for x in any_lists)} FROM feats",
        "p08_hits": f"WITH {FEATS} SELECT {SENT_KEYS}, {hits('topic_keywords')} AS topic, {hits('social_keywords')} AS social, {hits('governance_keywords')} AS governance, {hits('section_nav_words')} AS headings FROM feats",
        "p09_nature": f"WITH {FEATS} SELECT {SENT_KEYS}, {NATURE} AS nature FROM feats",
        "p10_workplace": f"WITH {FEATS} SELECT {SENT_KEYS}, {WORK} AS workplace FROM feats",
        "p11_total_hits": f"WITH {FEATS} SELECT {SENT_KEYS}, {ENVIRONMENT} + {hits('social_keywords')} + {hits('governance_keywords')} AS total FROM feats",
        **{f"f{k:02d}_{r}": f"WITH {FEATS} SELECT {SENT_KEYS} FROM feats WHERE {PREDICATES[r]}" for k, r in enumerate(REASONS, 1)},
        "f11_duplicate": f"WITH {SEEN} SELECT {SENT_KEYS} FROM numbered WHERE seen > 1",
        "cascade": f"WITH {REASONED} SELECT {SENT_KEYS}, reason FROM reasoned",
        "o01_first_seen": f"WITH {SEEN} SELECT {SENT_KEYS}, low FROM numbered WHERE seen = 1",
        "c01_claim_type": f"WITH {FEATS} SELECT {SENT_KEYS}, {CLAIM_TYPE} AS Claim_Type FROM feats",
        "c02_evidence": f"WITH {FEATS} SELECT {SENT_KEYS}, {EVIDENCE} AS Evidence_Exists FROM feats",
        "c03_risk": f"WITH {FEATS}, {RISKS} SELECT {SENT_KEYS}, coalesce(risk, '') AS Risk_Signal FROM (SELECT {SENT_KEYS}, {CLAIM_TYPE} AS t, {EVIDENCE} AS e FROM feats) LEFT JOIN risks ON ct = t AND ev = e",
        "c04_esg_type": f"WITH {FEATS} SELECT {SENT_KEYS}, ESG_Type FROM {TYPED % 'feats'}",
        "a01_drop_counts": f"WITH {SEEN} SELECT doc_id, reason, count(*) AS n FROM (SELECT doc_id, reason FROM reasoned WHERE reason IS NOT NULL UNION ALL SELECT doc_id, 'duplicate' FROM numbered WHERE seen > 1) GROUP BY ALL",
        "a02_type_counts": f"WITH {CLAIMS} SELECT Company, Claim_Type, count(*) AS n FROM claims GROUP BY ALL",
        "s12_summary": f"WITH {SEEN} SELECT reason, count(*) AS n FROM (SELECT reason FROM reasoned WHERE reason IS NOT NULL UNION ALL SELECT 'duplicate' FROM numbered WHERE seen > 1) GROUP BY ALL",
        "a02_levels": f"""WITH {CLAIMS} SELECT coalesce(nullif(concat_ws(',', CASE WHEN grouping(Company) = 0 THEN 'Company' END, CASE WHEN grouping(ESG_Type) = 0 THEN 'ESG_Type' END, CASE WHEN grouping(Claim_Type) = 0 THEN 'Claim_Type' END), ''), 'all') AS level, Company, ESG_Type, Claim_Type,
  count(*) AS claims, count(DISTINCT (Company, Page)) AS pages, count(*) FILTER (WHERE Evidence_Exists = 'Yes') AS supported FROM claims GROUP BY GROUPING SETS ((Company, ESG_Type, Claim_Type), (Company, ESG_Type), (Company), (ESG_Type, Claim_Type), (ESG_Type), (Claim_Type), ())""",
        "a07_distinct_claims": f"WITH {CLAIMS} SELECT ESG_Type, count(*) AS claims, count(DISTINCT lower(Claim_Text)) AS distinct_texts, true AS sketch_is_near FROM claims GROUP BY 1",
        "s09_variants": f"""WITH RECURSIVE {CHUNKS} SELECT 'reports/doc-' || CAST(doc_id AS VARCHAR) || '.pdf' AS source_pdf, n_pages AS total_pages, number, {CHUNK_ID} AS chunk_id, content_type, text, y0 AS top, 2 * {tokens('text')} AS score, CAST(NULL AS VARCHAR) AS nowhere, CASE WHEN doc_id % 3 = 0 THEN 'checked' END AS state FROM chunks JOIN n USING (doc_id)""",
        "s07_page_dump": f"WITH {GOLDEN} SELECT doc_id, page_number, '========== PAGE ' || CAST(page_number AS VARCHAR) || ' ==========' || chr(10) || regexp_replace(text, '{WS}+$', '') || chr(10) AS dump FROM (SELECT doc_id, 1 AS page_number, coalesce(text, '') AS text FROM documents UNION ALL SELECT d.doc_id, 2, a.sentence || ' ' || b.sentence FROM documents d JOIN golden a ON a.id = d.doc_id % 35 + 1 JOIN golden b ON b.id = (d.doc_id * 2 + 31) % 35 + 1)",
        "s08_tsv_round_trip": f"WITH {CLAIMS} SELECT * FROM claims",
        "s10_output_names": "SELECT doc_id, url, regexp_replace(url, '(?i)\\.(tsv|csv|txt)$', '') || '.tsv' AS output FROM (SELECT doc_id, source || CASE doc_id % 5 WHEN 0 THEN '.tsv' WHEN 1 THEN '.CSV' WHEN 2 THEN '.Txt' WHEN 3 THEN '.pdf' ELSE '' END AS url FROM documents)",
        "a06_scanned": f"WITH {GOLDEN} SELECT doc_id, avg(sparse) AS sparse_share, avg(sparse) >= 0.5 AS scanned FROM (SELECT doc_id, CASE WHEN length({stripped('text')}) < 20 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS sparse FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT d.doc_id, a.sentence FROM documents d JOIN golden a ON a.id = d.doc_id % 35 + 1)) GROUP BY doc_id",
        "p12_patterns": f"WITH {BLOCKS} SELECT {KEY}, regexp_matches(string_split({stripped('text')}, chr(10))[1], '{CAPTION}') AS caption, regexp_matches(string_split({stripped('text')}, chr(10))[1], '{LIST_ITEM}') AS list_item, regexp_matches({clean('text')}, '{PAGE_NUMBER}') AS page_no FROM blocks",
        "p13_first_line": "SELECT doc_id, string_split(text, chr(10))[1] AS line FROM documents",
        "p14_token_count": f"SELECT doc_id, {tokens('text')} AS tokens FROM documents",
        "p15_chunk_id": "SELECT o_orderkey AS number, 'chunk_' || CASE WHEN o_orderkey < 10000 THEN lpad(CAST(o_orderkey AS VARCHAR), 4, '0') ELSE CAST(o_orderkey AS VARCHAR) END AS chunk_id FROM orders",
        "p16_margin": f"WITH {BLOCKS} SELECT {KEY}, page_height > 0 AND {MARGIN} AS margin FROM blocks",
        "p17_iou": f"WITH {BLOCKS}, {TABLES} SELECT b.doc_id, b.page_number, b.src_idx, {IOU} AS iou FROM blocks b JOIN tables t ON t.doc_id = b.doc_id AND t.page_number = b.page_number WHERE t.x0 IS NOT NULL",
        "p18_contained": f"WITH {BLOCKS}, {TABLES} SELECT b.doc_id, b.page_number, b.src_idx, {INSIDE} AS inside FROM blocks b JOIN tables t ON t.doc_id = b.doc_id AND t.page_number = b.page_number WHERE t.x0 IS NOT NULL",
        "p19_markdown": f"WITH {TABLES} SELECT doc_id, {markdown('data')} AS markdown FROM tables",
        "a03_block_fonts": f"WITH {BLOCKS} SELECT {KEY}, max(size) AS max_font, median(size) AS median_font FROM (SELECT {KEY}, unnest([max_font, median_font, median_font - 1]) AS size FROM blocks) GROUP BY ALL",
        "a04_page_fonts": f"WITH {HEADERS} SELECT * FROM fonts",
        "a05_repeated_texts": f"WITH {HEADERS} SELECT * FROM repeated",
        "j01_uncovered": f"WITH {FREE} SELECT {KEY} FROM free",
        "j02_without_headers": f"WITH {HEADERS} SELECT {KEY} FROM headless",
        "j03_page_numbers": f"WITH {HEADERS} SELECT {KEY} FROM marked WHERE margin AND regexp_matches(header, '{PAGE_NUMBER}')",
        "j05_tables_of_pages": f"WITH {BLOCKS}, {TABLES} SELECT p.doc_id, p.page_number, count(t.doc_id) AS tables FROM (SELECT DISTINCT doc_id, page_number FROM blocks) p LEFT JOIN tables t ON t.doc_id = p.doc_id AND t.page_number = p.page_number GROUP BY ALL",
        "o04_reading_order": f"WITH {ITEMS} SELECT doc_id, page_number, kind, src_idx, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY {ORDER}) AS INTEGER) AS place FROM placed",
        "c05_block_type": f"WITH {ITEMS} SELECT {KEY}, content_type FROM placed WHERE kind = 0",
        "o02_heading_context": f"WITH {ITEMS} SELECT {KEY}, kind, heading_context FROM placed",
        "g03_packing": f"WITH RECURSIVE whole AS (SELECT doc_id, {clean('text')} AS text FROM documents), {numbered_sents('whole', 'doc_id', 'text')}, {packing('doc_id')} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first_k, w) - 1 AS INTEGER) AS piece_idx, text FROM (SELECT * FROM packed UNION ALL SELECT doc_id, 0, 0, text FROM whole WHERE {tokens('text')} <= 480 AND text <> '')",
        "g04_windows": f"SELECT doc_id, CAST(w AS INTEGER) AS window_idx, {stripped("array_to_string(tk[w * 430 + 1 : w * 430 + 480], '')")} AS text FROM (SELECT doc_id, tk, unnest(range(0, CAST(greatest(0, ceil((len(tk) - 480) / 430.0)) AS BIGINT) + 1)) AS w FROM (SELECT doc_id, regexp_extract_all(text, '{PIECE}') AS tk FROM documents WHERE {tokens('text')} > 480))",
        "g05_table_split": f"""WITH RECURSIVE rows AS (SELECT l_suppkey AS id, {CELLS} AS cells, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, {CELLS}) AS k FROM lineitem),
  told AS (SELECT *, '| ' || array_to_string(cells, ' | ') || ' |' AS line FROM rows), sized AS (SELECT *, {tokens("line")} AS n FROM told),
  head AS (SELECT '| ' || array_to_string({HEAD}, ' | ') || ' |' || chr(10) || '| ' || array_to_string(['---', '---', '---', '---', '---', '---', '---'], ' | ') || ' |' AS top),
  walk AS (
    SELECT id, k, {tokens("top")} + n AS held, 1 AS c FROM sized, head WHERE k = 1
    UNION ALL SELECT s.id, s.k, CASE WHEN w.held + s.n > 480 THEN {tokens("top")} + s.n ELSE w.held + s.n END, CASE WHEN w.held + s.n > 480 THEN w.c + 1 ELSE w.c END FROM walk w JOIN sized s ON s.id = w.id AND s.k = w.k + 1, head
  ) SELECT id, CAST(c - 1 AS INTEGER) AS piece_idx, any_value(top) || chr(10) || string_agg(line, chr(10) ORDER BY k) AS text FROM walk JOIN sized USING (id, k), head GROUP BY id, c""",
        "chunks": f"WITH RECURSIVE {CHUNKS} SELECT doc_id, number, {CHUNK_ID} AS chunk_id, page_number, content_type, text, {tokens('text')} AS token_count, x0, y0, x1, y1, heading_context FROM chunks",
        "o03_numbering": f"WITH RECURSIVE {CHUNKS} SELECT doc_id, page_number, kind, src_idx, number FROM chunks",
        "a07_totals": f"WITH RECURSIVE {CHUNKS} SELECT doc_id, content_type, count(*) AS chunks, sum({tokens('text')})::BIGINT AS tokens FROM chunks GROUP BY ALL",
        "a08_reports": f"WITH RECURSIVE {CHUNKS} SELECT doc_id, CAST(coalesce(n_chunks, 0) AS INTEGER) AS n_chunks, coalesce(outline, '') AS outline, n_pages AS total_pages FROM n LEFT JOIN (SELECT doc_id, count(*) AS n_chunks, string_agg({CHUNK_ID} || ':' || content_type, ',' ORDER BY number) AS outline FROM chunks GROUP BY doc_id) USING (doc_id)",
        "a08_warnings": f"WITH RECURSIVE {CHUNKS}, {TOLD} SELECT * FROM warned",
        "s09_json_round_trip": f"WITH RECURSIVE {CHUNKS}, {TOLD} SELECT 'reports/doc-' || CAST(doc_id AS VARCHAR) || '.pdf' AS source_pdf, 'Acme' AS company, 2024 AS year, CAST(NULL AS VARCHAR) AS report_type, n_pages AS total_pages, CAST(coalesce(n_warnings, 0) AS INTEGER) AS n_warnings, {CHUNK_ID} AS chunk_id, page_number, content_type, text, {tokens('text')} AS token_count, heading_context, x0, y0, x1, y1 FROM chunks JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n_warnings FROM warned GROUP BY 1) USING (doc_id)",
        "s01_pages": f"""WITH {GOLDEN}, pages AS (SELECT doc_id, 1 AS page_number, coalesce(text, '') AS text FROM documents UNION ALL SELECT d.doc_id, 2, a.sentence || ' ' || b.sentence FROM documents d JOIN golden a ON a.id = d.doc_id % 35 + 1 JOIN golden b ON b.id = (d.doc_id * 2 + 31) % 35 + 1)
  SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS report, page_number, CASE WHEN page_number = 2 AND doc_id % 5 = 0 THEN '' ELSE text END AS text, CASE WHEN page_number = 2 AND doc_id % 5 = 0 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN page_number = 2 AND doc_id % 5 = 0 THEN 'no such font' END AS error FROM pages WHERE doc_id % 7 <> 0 AND doc_id % 9 <> 0
  UNION ALL SELECT 'doc-' || CAST(doc_id AS VARCHAR), NULL, NULL, 'failed', 'encrypted' FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 9 = 0""",
        "s04_tables": f"WITH {TABLES} SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS report, page_number, CAST(1 - doc_id % 2 AS INTEGER) AS src_idx, {markdown('data')} AS markdown, x0, y0, x1, y1 FROM tables WHERE doc_id % 7 <> 0 AND doc_id % 9 <> 0",
        "s03_blocks": f"""WITH {BLOCKS}, split_words AS (SELECT *, unnest(range(0, len(ws))) AS i FROM (SELECT *, string_split(regexp_replace(text, '( )', ' ' || chr(1), 'g'), chr(1)) AS ws FROM blocks)),
  spans AS (SELECT {KEY}, i // 8 AS line, i AS span, ws[i + 1] AS word, CASE WHEN i % 3 <> 2 THEN max_font - i % 2 END AS size FROM split_words UNION ALL SELECT {KEY}, 1 << 20, 0, '  ', max_font + 2 FROM blocks WHERE (doc_id + src_idx) % 2 = 0),
  span_lines AS (SELECT {KEY}, line, string_agg(word, '' ORDER BY span) AS text FROM spans GROUP BY ALL), shown AS (SELECT {KEY}, {stripped("string_agg(text, chr(10) ORDER BY line)")} AS text FROM span_lines WHERE NOT regexp_full_match(text, '{WS}*') GROUP BY ALL),
  sizes AS (SELECT {KEY}, coalesce(max(size) FILTER (WHERE size <> 0), 0.0) AS max_font, coalesce(median(size) FILTER (WHERE size <> 0), 0.0) AS median_font FROM spans GROUP BY ALL)
  SELECT doc_id, page_number, CAST(row_number() OVER (PARTITION BY doc_id, page_number ORDER BY src_idx) AS INTEGER) AS src_idx, s.text, x0, y0, x1, y1, z.max_font, z.median_font, page_height FROM shown s JOIN sizes z USING ({KEY}) JOIN blocks b USING ({KEY}) WHERE s.text <> ''""",
        "s07_page_files": f"""WITH {GOLDEN}, pages AS (SELECT doc_id, 1 AS page_number, coalesce(text, '') AS text FROM documents UNION ALL SELECT d.doc_id, 2, a.sentence || ' ' || b.sentence FROM documents d JOIN golden a ON a.id = d.doc_id % 35 + 1 JOIN golden b ON b.id = (d.doc_id * 2 + 31) % 35 + 1)
  SELECT CAST(doc_id AS VARCHAR) AS name, string_agg('========== PAGE ' || CAST(page_number AS VARCHAR) || ' ==========' || chr(10) || regexp_replace(text, '{WS}+$', '') || chr(10) || chr(10), '' ORDER BY page_number) AS text FROM pages GROUP BY doc_id""",
        "a09_precision": "SELECT d.lang, count(*) AS judged, avg(CAST(quality AS DOUBLE)) AS precision FROM labels l JOIN documents d USING (doc_id) GROUP BY d.lang",
        "a09_error_kinds": "SELECT d.source, sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END)::BIGINT AS rejected, sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END)::BIGINT AS abusive, count(*) AS judged FROM labels l JOIN documents d USING (doc_id) GROUP BY d.source",
        "a09_pivot": "SELECT d.source, " + ", ".join(f"count(*) FILTER (WHERE d.lang = '{x}') AS {x}" for x in ("de", "en", "es", "fr")) + " FROM labels l JOIN documents d USING (doc_id) WHERE l.quality = 1 GROUP BY d.source",
        "a09_label_pairs": "SELECT quality AS first, toxic AS second, count(*) AS n FROM labels GROUP BY ALL",
        "a09_agreement": f"""WITH {JUDGES}, pairs AS (SELECT lang, reader AS a, length_rule AS b FROM judges WHERE reader IS NOT NULL AND length_rule IS NOT NULL), n AS (SELECT lang, count(*)::DOUBLE AS n, count(*) FILTER (WHERE a = b)::DOUBLE AS same FROM pairs GROUP BY 1),
  shares AS (SELECT lang, v, count(*) FILTER (WHERE one)::DOUBLE AS a, count(*) FILTER (WHERE NOT one)::DOUBLE AS b FROM (SELECT lang, a AS v, true AS one FROM pairs UNION ALL SELECT lang, b, false FROM pairs) GROUP BY ALL),
  chance AS (SELECT lang, sum(a * b) AS cross_, sum((a + b) * (a + b)) AS square FROM shares GROUP BY 1), every AS (SELECT lang, count(*) AS rows FROM judges GROUP BY 1)
  SELECT e.lang, e.rows, coalesce(n, 0)::BIGINT AS paired, same / nullif(n, 0) AS observed, (same / n - cross_ / (n * n)) / nullif(1 - cross_ / (n * n), 0) AS kappa, 1 - (2 * n - 1) * 2 * (n - same) / nullif(4 * n * n - square, 0) AS alpha
  FROM every e LEFT JOIN n ON n.lang IS NOT DISTINCT FROM e.lang LEFT JOIN chance c ON c.lang IS NOT DISTINCT FROM e.lang""",
        "a09_reliability": f"""WITH {JUDGES}, answers AS (SELECT lang, doc_id AS unit, unnest([reader, length_rule, tone_rule]) AS answer FROM judges), cells AS (SELECT lang, unit, answer, count(*)::DOUBLE AS n FROM answers WHERE answer IS NOT NULL GROUP BY ALL),
  units AS (SELECT lang, unit, sum(n) AS m, sum(n * n) AS square FROM cells GROUP BY ALL HAVING sum(n) > 1), apart AS (SELECT lang, count(*) AS units, sum(m) AS m, sum((m * m - square) / (m - 1)) AS apart FROM units GROUP BY 1),
  totals AS (SELECT lang, sum(n * n) AS square FROM (SELECT c.lang, c.answer, sum(c.n) AS n FROM cells c JOIN units u ON u.unit = c.unit AND u.lang IS NOT DISTINCT FROM c.lang GROUP BY ALL) GROUP BY 1)
  SELECT a.lang, a.units, a.m::BIGINT AS answers, 1 - (m - 1) * apart / nullif(m * m - t.square, 0) AS alpha FROM apart a JOIN totals t ON t.lang IS NOT DISTINCT FROM a.lang""",
        "a09_recall": f"WITH {CLAIMS}, {GOLD}, made AS (SELECT Company::BIGINT AS doc_id, Claim_Text AS text, ESG_Type AS topic FROM claims), {gold_found('made', 'doc_id', 'gold')} {recall_by('topic')}",
        "a09_versions": f"WITH {VERSIONED} SELECT version, " + ", ".join(f"count(*) FILTER (WHERE topic = '{t}') AS {t}" for t in "ESG") + ", count(*) AS claims FROM versioned GROUP BY version",
        "a09_version_changes": f"""WITH {VERSIONED}, all_first AS (SELECT * FROM judged WHERE low IS NOT NULL QUALIFY row_number() OVER (PARTITION BY version, doc_id, low, reason IS NULL ORDER BY page_number, sent_idx) = 1), texts AS (SELECT DISTINCT doc_id, low FROM versioned),
  side AS (SELECT version, doc_id, low, any_value(reason) AS reason, any_value(topic) AS topic FROM all_first JOIN texts USING (doc_id, low) GROUP BY ALL), steps(older, newer) AS (VALUES ('v1', 'v2'), ('v2', 'v2.1')),
  moved AS (SELECT older, newer, a.topic AS old, b.topic AS new, a.reason AS was, b.reason AS now FROM steps JOIN side a ON a.version = older JOIN side b ON b.version = newer AND b.doc_id = a.doc_id AND b.low = a.low WHERE a.reason IS NULL OR b.reason IS NULL)
  SELECT older, newer, CASE WHEN was IS NOT NULL THEN 'gained' WHEN now IS NOT NULL THEN 'lost' WHEN old <> new THEN 'relabelled' ELSE 'kept' END AS change, CASE WHEN was IS NOT NULL THEN new ELSE old END AS topic, CASE WHEN was IS NOT NULL THEN was WHEN now IS NOT NULL THEN now WHEN old <> new THEN new ELSE '' END AS detail, count(*) AS n FROM moved GROUP BY ALL""",
        "a09_version_gold": f"WITH {VERSIONED}, {GOLD}, asked AS (SELECT *, unnest(['v1', 'v2', 'v2.1']) AS version FROM gold), {gold_found('versioned', 'version, doc_id', 'asked')} {recall_by('version')}",
        "a09_supported": f"WITH {CLAIMS} SELECT Company, count(*) AS found, count(*) FILTER (WHERE Evidence_Exists = 'Yes') * 1.0::DOUBLE / count(*) AS supported FROM claims GROUP BY Company",
    }
    return found | {"s09_report_files": found["s09_json_round_trip"], "s12_observed": found["s12_summary"]}
