"""The registered queries again, in DuckDB SQL over the same tables.

Written apart from the Spark side: scores by grouping terms instead of folding
arrays, attempt logs by windows instead of minima, traces by lists of structs.
Only fixed values and template texts are shared.
"""

from __future__ import annotations

from ..functions.http import DIRECT_WAIT_MS, FIRST_WAIT_MS, LONGEST_WAIT_MS, MAX_ATTEMPTS
from ..functions.stem import STEP_2, STEP_3, STEP_4
from ..functions.stopwords import BASE
from ..functions.text import CONTROL_AND_SPACE, UNICODE_SPACE
from ..operators.attempts import JUDGE_CHAIN, POLICIES, VISION_CHAIN
from ..operators.requests import (
    COMPARE_RULES, DIRECT_TEMPERATURE_MODELS, JUDGE_RULES, JUDGE_SYSTEM, PROMPT_VERSION, QUESTION_RULES, QUESTION_SYSTEM,
    REASON_FIELD, SCORE_FIELD, TEMPERATURE_MODELS,
)
from .fixtures import CALLER_WORDS, CUSTOM_MODEL
from .queries import JUDGE_PROMPT, QUESTION_PROMPT, VISION_PROMPT

ORACLES: dict[str, str] = {}


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lits(words) -> str:
    return "[" + ", ".join(lit(w) for w in words) + "]"


CONTROL = lit(CONTROL_AND_SPACE.replace("\0", ""))
SPACE = lit(UNICODE_SPACE)
BASE_LIST = lits(BASE)


def trim(x: str) -> str:
    return f"trim({x}, {CONTROL})"


def blank(x: str) -> str:
    return f"coalesce({trim(x)} = '', true)"


def quoted(x: str) -> str:
    return f"CAST(to_json({x}) AS VARCHAR)"


# --- pairs and lexical scores ---------------------------------------------------------

PAIRS = """
pairs AS (
  SELECT u.conv_id, u.turn, concat(u.conv_id, '-', u.turn) AS pair_id, u.text AS expected, a.text AS actual
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""

DOCUMENT_PAIRS = """
pairs AS (
  SELECT d.doc_id AS pair_id, d.text AS expected, n.text AS actual
  FROM documents d JOIN documents n ON n.doc_id = d.doc_id + 1)"""

CALLER_LIST = f"words AS (SELECT {lits(CALLER_WORDS)} AS stop)"
CALLER_TABLE = """
words AS (
  SELECT list(DISTINCT word) AS stop FROM (
    SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark) WHERE length(word) <= 3)"""

BASE_WORDS = f"words AS (SELECT {BASE_LIST} AS stop)"


def keyword_tokens(x: str) -> str:
    return f"string_split_regex(regexp_replace(lower({x}), '[^a-z ]', '', 'g'), ' +')"


def without(tokens: str, stop: str = BASE_LIST) -> str:
    return f"list_filter({tokens}, lambda t: t <> '' AND NOT list_contains({stop}, t))"


def keyword_terms(x: str) -> str:
    return f"list_distinct({without(keyword_tokens(x))})"


def class_tokens(x: str) -> str:
    runs = f"regexp_extract_all(lower({x}), '\\p{{L}}+|\\p{{Nd}}+')"
    return f"list_transform({runs}, lambda w: regexp_replace(w, '[^a-z0-9]', '', 'g'))"


ORACLES["pair_source"] = f"WITH {PAIRS} SELECT conv_id, turn, pair_id, expected, actual FROM pairs"
ORACLES["containment_terms"] = f"""
WITH {PAIRS} SELECT pair_id,
  array_to_string(list_sort({keyword_terms('expected')}), ' ') AS expected_terms,
  array_to_string(list_sort({keyword_terms('actual')}), ' ') AS actual_terms FROM pairs"""


def containment(pairs: str, keys: str, valid: bool) -> str:
    return f"""
WITH {pairs},
terms AS (SELECT *, {keyword_terms('expected')} AS e, {keyword_terms('actual')} AS a FROM pairs),
scored AS (
  SELECT *, CASE WHEN len(a) > 0 THEN CAST(len(list_intersect(e, a)) AS DOUBLE) / len(a) * 100 END AS pct
  FROM terms)
SELECT {keys}, round(pct, 6) AS containment_pct{', coalesce(pct > 60, false) AS is_valid' if valid else ''} FROM scored"""


ORACLES["containment"] = containment(PAIRS, "conv_id, turn", False)
ORACLES["containment_valid"] = containment(PAIRS, "conv_id, turn", True)
ORACLES["containment_documents"] = containment(DOCUMENT_PAIRS, "pair_id AS doc_id", True)

for _name, _words in (("stopword_filter", BASE_WORDS), ("stopword_filter_ext", CALLER_LIST)):
    ORACLES[_name] = f"""
WITH {_words}, kept AS (
  SELECT doc_id, {without(keyword_tokens('text'), 'stop')} AS k FROM documents, words)
SELECT doc_id, len(k) AS n_kept, array_to_string(k, ' ') AS kept FROM kept"""

ORACLES["clean_tokens"] = f"""
WITH {CALLER_LIST}, kept AS (
  SELECT doc_id, list_filter({without(class_tokens('text'), 'stop')}, lambda c: length(c) > 1) AS k
  FROM documents, words)
SELECT doc_id, array_to_string(k, ' ') AS tokens FROM kept"""


def cosine(pairs: str, words: str, stem: bool = False) -> str:
    """CTEs ending in ``scored(pair_id, cosine)`` by grouping exploded terms."""
    word = "stem" if stem else "term"
    lookup = f", {STEMS}" if stem else ""
    join = "JOIN stems USING (term)" if stem else ""
    return f"""
WITH {pairs}, {words},
tokens AS (
  SELECT pair_id, unnest({without(class_tokens('expected'), 'stop')}) AS term, 1 AS e, 0 AS a FROM pairs, words
  UNION ALL
  SELECT pair_id, unnest({without(class_tokens('actual'), 'stop')}), 0, 1 FROM pairs, words){lookup},
counts AS (
  SELECT pair_id, {word} AS term, sum(e) AS e, sum(a) AS a FROM tokens {join}
  WHERE length({word}) > 1 GROUP BY 1, 2),
norms AS (
  SELECT pair_id, CAST(sum(e * a) AS DOUBLE) AS dot, CAST(sum(e * e) AS DOUBLE) AS ee, CAST(sum(a * a) AS DOUBLE) AS aa
  FROM counts GROUP BY 1),
scored AS (
  SELECT p.*, CASE WHEN expected IS NULL OR actual IS NULL THEN NULL
    WHEN coalesce(ee, 0) = 0 AND coalesce(aa, 0) = 0 THEN 1.0
    WHEN coalesce(ee, 0) = 0 OR coalesce(aa, 0) = 0 THEN 0.0
    ELSE dot / sqrt(ee * aa) END AS cosine
  FROM pairs p LEFT JOIN norms n ON n.pair_id = p.pair_id)"""


ORACLES["cosine_pct"] = f"{cosine(PAIRS, CALLER_LIST)} SELECT pair_id, round(cosine * 100, 6) AS cosine_pct FROM scored"
ORACLES["cosine_pct_documents"] = (
    f"{cosine(DOCUMENT_PAIRS, CALLER_LIST)} SELECT pair_id AS doc_id, round(cosine * 100, 6) AS cosine_pct FROM scored"
)
ORACLES["cosine_by_terms"] = (
    f"{cosine(DOCUMENT_PAIRS, CALLER_TABLE)} SELECT pair_id AS doc_id, round(cosine * 100, 6) AS cosine_pct FROM scored"
)

VERDICT_PAIRS = f"""{PAIRS.replace('pairs AS', 'turns AS', 1)},
pairs AS (
  SELECT pair_id, CASE WHEN (conv_id + turn) % 9 <> 0 THEN expected END AS expected, actual,
    CASE WHEN (conv_id + turn) % 7 <> 0 THEN ((conv_id + turn) % 10) * 10.0::DOUBLE END AS threshold FROM turns)"""
ORACLES["cosine_verdict"] = f"""
{cosine(VERDICT_PAIRS, CALLER_LIST)},
shown AS (
  SELECT *, CASE WHEN threshold IS NOT NULL THEN cosine * 100 END AS pct,
    CAST(CAST(cosine * 100 AS FLOAT) AS VARCHAR) AS txt FROM scored)
SELECT pair_id, round(pct, 6) AS cosine_pct, threshold,
  CASE WHEN pct >= threshold THEN 'PASS' ELSE 'FAIL' END AS status,
  CASE WHEN expected IS NULL OR actual IS NULL THEN 'Error: text is null'
    WHEN threshold IS NULL THEN 'Error: threshold is null'
    WHEN pct >= threshold THEN 'Similarity Matched | Score: ' || txt
    ELSE 'Not Matched | Score: ' || txt END AS message
FROM shown"""

# --- stems: the published steps over the distinct terms of a ``tokens`` relation ---------


def shape(x: str) -> str:
    """The word as V and C letters. A y turns on its left neighbour, so it is settled from the left."""
    marked = f"regexp_replace(regexp_replace({x}, '[^aeiouy]', 'C', 'g'), '[aeiou]', 'V', 'g')"
    marked = f"regexp_replace({marked}, '^y', 'C')"
    for _ in range(4):
        marked = f"replace(replace({marked}, 'Cy', 'CV'), 'Vy', 'VC')"
    return marked


def cut(x: str, n: int | str) -> str:
    return f"left({x}, length({x}) - {n})"


def measure(s: str) -> str:
    return f"len(regexp_extract_all({s}, 'V+C+'))"


def short_end(x: str, s: str) -> str:
    return f"({s} LIKE '%CVC' AND NOT regexp_matches({x}, '[wxy]$'))"


def with_base(name: str, source: str, suffix: str) -> str:
    """Relation with the suffix found, the part ahead of it, and that part's shape."""
    return f"""
{name}_found AS (SELECT term, w, {suffix} AS suffix FROM {source}),
{name}_cut AS (SELECT *, {cut('w', 'length(suffix)')} AS base FROM {name}_found),
{name}_base AS (SELECT *, {shape('base')} AS shaped, {shape('w')} AS whole FROM {name}_cut)"""


def ending(suffixes) -> str:
    return f"regexp_extract(w, '({'|'.join(suffixes)})$', 1)"


def replaced(table: dict[str, str]) -> str:
    return "CASE suffix " + " ".join(f"WHEN {lit(a)} THEN {lit(b)}" for a, b in table.items()) + " END"


_M = measure("shaped")
STEMS = f"""
plural AS (
  SELECT DISTINCT term, CASE WHEN regexp_matches(term, '(sses|ies)$') THEN {cut('term', 2)}
    WHEN regexp_matches(term, '(^|[^s])s$') THEN {cut('term', 1)} ELSE term END AS w
  FROM tokens WHERE regexp_full_match(term, '[a-z]{{3,}}')),
{with_base('participle', 'plural', "CASE WHEN w LIKE '%eed' THEN 'eed' WHEN w LIKE '%ed' THEN 'ed' WHEN w LIKE '%ing' THEN 'ing' ELSE '' END")},
participle AS (
  SELECT term, CASE WHEN suffix = 'eed' THEN CASE WHEN {_M} > 0 THEN {cut('w', 1)} ELSE w END
    WHEN suffix = '' OR shaped NOT LIKE '%V%' THEN w
    WHEN regexp_matches(base, '(at|bl|iz)$') THEN base || 'e'
    WHEN length(base) > 1 AND base[-1] = base[-2] AND shaped LIKE '%C'
      THEN CASE WHEN base[-1] IN ('l', 's', 'z') THEN base ELSE {cut('base', 1)} END
    WHEN {_M} = 1 AND {short_end('base', 'shaped')} THEN base || 'e' ELSE base END AS w FROM participle_base),
{with_base('final_y', 'participle', "CASE WHEN w LIKE '%y' THEN 'y' ELSE '' END")},
final_y AS (SELECT term, CASE WHEN suffix = 'y' AND shaped LIKE '%V%' THEN base || 'i' ELSE w END AS w FROM final_y_base),
{with_base('second', 'final_y', ending(STEP_2))},
second AS (SELECT term, CASE WHEN suffix <> '' AND {_M} > 0 THEN base || {replaced(STEP_2)} ELSE w END AS w FROM second_base),
{with_base('third', 'second', ending(STEP_3))},
third AS (SELECT term, CASE WHEN suffix <> '' AND {_M} > 0 THEN base || {replaced(STEP_3)} ELSE w END AS w FROM third_base),
{with_base('fourth', 'third', ending(STEP_4))},
fourth AS (
  SELECT term, CASE WHEN suffix <> '' AND {_M} > 1 AND (suffix <> 'ion' OR regexp_matches(base, '[st]$')) THEN base ELSE w END AS w
  FROM fourth_base),
{with_base('fifth', 'fourth', "CASE WHEN w LIKE '%e' THEN 'e' ELSE '' END")},
fifth AS (
  SELECT term, CASE WHEN suffix = 'e' AND ({_M} > 1 OR ({_M} = 1 AND NOT {short_end('base', 'shaped')})) THEN base ELSE w END AS w
  FROM fifth_base),
stems AS (
  SELECT term, CASE WHEN w LIKE '%ll' AND {measure(shape('w'))} > 1 THEN {cut('w', 1)} ELSE w END AS stem FROM fifth
  UNION ALL
  SELECT DISTINCT term, term FROM tokens WHERE NOT regexp_full_match(term, '[a-z]{{3,}}'))"""

DOCUMENT_TOKENS = f"""
listed AS (SELECT doc_id, {without(class_tokens('text'))} AS l FROM documents),
tokens AS (SELECT doc_id, i, l[i + 1] AS term FROM (SELECT doc_id, l, unnest(range(len(l))) AS i FROM listed))"""

ORACLES["stem_terms"] = f"WITH {DOCUMENT_TOKENS}, {STEMS} SELECT term, stem FROM stems"
ORACLES["stemmed_tokens"] = f"""
WITH {DOCUMENT_TOKENS}, {STEMS},
joined AS (
  SELECT doc_id, string_agg(stem, ' ' ORDER BY i) AS tokens FROM tokens JOIN stems USING (term)
  WHERE length(stem) > 1 GROUP BY doc_id)
SELECT doc_id, coalesce(tokens, '') AS tokens FROM documents LEFT JOIN joined USING (doc_id)"""
ORACLES["cosine_stemmed"] = f"{cosine(PAIRS, BASE_WORDS, stem=True)} SELECT pair_id, round(cosine, 6) AS cosine FROM scored"
ORACLES["cosine_stemmed_documents"] = (
    f"{cosine(DOCUMENT_PAIRS, BASE_WORDS, stem=True)} SELECT pair_id AS doc_id, round(cosine, 6) AS cosine FROM scored"
)

# --- input rules ----------------------------------------------------------------------

JUDGE_INPUTS = """
inputs AS (
  SELECT CAST(doc_id AS VARCHAR) AS pair_id,
    CASE doc_id % 11 WHEN 0 THEN NULL WHEN 1 THEN ' ' || chr(9) || chr(10) ELSE text END AS expected,
    CASE doc_id % 13 WHEN 0 THEN '' ELSE source END AS actual,
    CASE doc_id % 17 WHEN 0 THEN ' ' ELSE 'Compare both answers.' END AS prompt,
    TRY_CAST(CASE doc_id % 19 WHEN 0 THEN NULL WHEN 1 THEN 'abc' ELSE CAST(doc_id % 104 - 2 AS VARCHAR) END
      AS INTEGER) AS threshold
  FROM documents),
checked AS (
  SELECT *, CASE WHEN {expected} THEN 'Expected_Response must not be empty.'
    WHEN {actual} THEN 'Actual_Response must not be empty.'
    WHEN {prompt} THEN 'Prompt must not be empty.'
    WHEN threshold IS NULL OR threshold < 0 OR threshold > 100
      THEN 'Similarity_Threshold must be an integer between 0 and 100.' END AS input_error
  FROM inputs)""".format(expected=blank("expected"), actual=blank("actual"), prompt=blank("prompt"))
ORACLES["judge_input_rules"] = f"""
WITH {JUDGE_INPUTS} SELECT pair_id, threshold, input_error,
  CASE WHEN input_error IS NOT NULL THEN 'INPUT' END AS error_kind FROM checked"""

DOCUMENT_BYTES = """
bytes AS (
  SELECT doc_id, text, CASE doc_id % 7 WHEN 0 THEN encode('%PDF-1.7 ' || text)
    WHEN 1 THEN encode('PK' || chr(3) || chr(4) || text) WHEN 2 THEN encode('  ' || chr(10)) WHEN 3 THEN encode('')
    ELSE encode(' ' || chr(10) || text || chr(10) || ' ') END AS content FROM documents)"""
ORACLES["qa_input_rules"] = f"""
WITH {DOCUMENT_BYTES},
inputs AS (
  SELECT doc_id, content,
    CAST(CASE doc_id % 17 WHEN 0 THEN NULL WHEN 1 THEN 50 ELSE doc_id % 53 END AS INTEGER) AS query_count,
    CASE doc_id % 23 WHEN 0 THEN chr(10) ELSE 'Write questions.' END AS prompt FROM bytes),
checked AS (
  SELECT *, CASE WHEN octet_length(content) = 0 THEN 'Document_File_Path must not be empty.'
    WHEN query_count IS NULL OR query_count < 1 THEN 'Query_Count must be a positive integer.'
    WHEN query_count > 50 THEN 'Query_Count must not exceed 50.'
    WHEN {blank('prompt')} THEN 'Prompt must not be empty.' END AS input_error FROM inputs)
SELECT doc_id, query_count, input_error, CASE WHEN input_error IS NOT NULL THEN 'INPUT' END AS error_kind FROM checked"""

# --- requests -------------------------------------------------------------------------

JUDGE_TEXT = (
    f"""{lit(JUDGE_PROMPT + chr(10) * 2 + 'Expected Response: "')} || expected || """
    f"""{lit('"' + chr(10) + 'Actual Response:   "')} || actual || {lit('"' + chr(10) * 2 + JUDGE_RULES)}"""
)
COMPARE_TEXT = (
    f"""{lit(COMPARE_RULES + chr(10) * 2 + 'Sentence 1: "')} || expected || """
    f"""{lit('"' + chr(10) + 'Sentence 2: "')} || actual || '"'"""
)
QUESTION_TEXT = (
    f"""{lit(QUESTION_PROMPT + chr(10) * 2 + 'DOCUMENT CONTENT:' + chr(10))} || text || """
    f"""{lit(chr(10) * 2 + QUESTION_RULES)} || (doc_id % 50 + 1) || '.'"""
)


def messages(system: str, prompt: str) -> str:
    return f"[{{'role': 'system', 'content': {lit(system)}}}, {{'role': 'user', 'content': {prompt}}}]"


ORACLES["judge_prompt"] = f"WITH {PAIRS} SELECT pair_id, {JUDGE_TEXT} AS prompt FROM pairs"
ORACLES["judge_prompt_b"] = (
    f"WITH {PAIRS} SELECT pair_id, {COMPARE_TEXT} AS prompt, {lit(PROMPT_VERSION)} AS prompt_version FROM pairs"
)
ORACLES["judge_request"] = f"""
WITH {PAIRS} SELECT pair_id, CAST(to_json({{'messages': {messages(JUDGE_SYSTEM, JUDGE_TEXT)}, 'temperature': 0,
  'response_format': {{'type': 'json_object'}}}}) AS VARCHAR) AS body FROM pairs"""
ORACLES["judge_request_b"] = f"""
WITH {PAIRS}, asked AS (SELECT pair_id, {COMPARE_TEXT} AS prompt, unnest({lits(JUDGE_CHAIN)}) AS model FROM pairs)
SELECT pair_id, model, {lit(PROMPT_VERSION)} AS prompt_version,
  CAST(CASE WHEN list_contains({lits(TEMPERATURE_MODELS)}, model)
    THEN to_json({{'model': model, 'input': prompt, 'temperature': 0, 'text': {{'format': {{'type': 'json_object'}}}}}})
    ELSE to_json({{'model': model, 'input': prompt, 'text': {{'format': {{'type': 'json_object'}}}}}}) END
    AS VARCHAR) AS body FROM asked"""
ORACLES["judge_request_direct"] = f"""
WITH {PAIRS}, asked AS (SELECT pair_id, {COMPARE_TEXT} AS prompt, unnest({lits(JUDGE_CHAIN)}) AS model FROM pairs)
SELECT pair_id, model, CAST(CASE WHEN list_contains({lits(DIRECT_TEMPERATURE_MODELS)}, model)
    THEN to_json({{'model': model, 'input': prompt, 'temperature': 0, 'text': {{'format': {{'type': 'json_object'}}}}}})
    ELSE to_json({{'model': model, 'input': prompt, 'text': {{'format': {{'type': 'json_object'}}}}}}) END
    AS VARCHAR) AS body FROM asked"""
ORACLES["qa_prompt"] = f"SELECT doc_id, {QUESTION_TEXT} AS prompt FROM documents"
ORACLES["qa_request"] = f"""
SELECT doc_id, CAST(to_json({{'messages': {messages(QUESTION_SYSTEM, QUESTION_TEXT)}, 'temperature': 0}}) AS VARCHAR) AS body
FROM documents"""

IMAGES = """
images AS (
  SELECT doc_id, 'images/' || doc_id || CASE doc_id % 6 WHEN 0 THEN '.png' WHEN 1 THEN '.PNG' WHEN 2 THEN '.gif'
    WHEN 3 THEN '.webp' WHEN 4 THEN '.jpg' ELSE '' END AS path, encode(text) AS content FROM documents),
typed AS (
  SELECT *, CASE lower(regexp_extract(path, '\\.([A-Za-z]+)$', 1)) WHEN 'png' THEN 'image/png' WHEN 'gif' THEN 'image/gif'
    WHEN 'webp' THEN 'image/webp' ELSE 'image/jpeg' END AS media_type FROM images),
urls AS (SELECT *, 'data:' || media_type || ';base64,' || base64(content) AS data_url FROM typed)"""
ORACLES["media_type"] = f"WITH {IMAGES} SELECT doc_id, path, media_type FROM typed"
ORACLES["data_url"] = f"WITH {IMAGES} SELECT doc_id, data_url FROM urls"
ORACLES["vision_request"] = f"""
WITH {IMAGES} SELECT doc_id, '{{"model":"{VISION_CHAIN[0]}","input":[{{"role":"user","content":['
  || to_json({{'type': 'input_image', 'image_url': data_url}}) || ','
  || to_json({{'type': 'input_text', 'text': {lit(VISION_PROMPT)}}}) || ']}}]}}' AS body FROM urls"""

# --- replies --------------------------------------------------------------------------

_FENCE = "```"


def unfence(x: str, chars: str) -> str:
    inner = f"regexp_replace(regexp_replace({x}, '^{_FENCE}[a-zA-Z]*\\n?', ''), '{_FENCE}$', '')"
    return f"CASE WHEN starts_with({x}, '{_FENCE}') THEN trim({inner}, {chars}) ELSE {x} END"


def judge_json(score: str, reason: str, more: str = "") -> str:
    return f"""'{{"{SCORE_FIELD}": ' || {score} || ', "{REASON_FIELD}": ' || {reason} || '{more}}}'"""


_NUMBER = "CAST(doc_id % 101 AS VARCHAR)"
_TEXT = quoted("text")
_GOOD = judge_json(_NUMBER, _TEXT)

CHAT_REPLIES = f"""
contents AS (
  SELECT doc_id, CASE doc_id % 18
    WHEN 1 THEN '{_FENCE}json' || chr(10) || {_GOOD} || chr(10) || '{_FENCE}'
    WHEN 2 THEN {judge_json(_NUMBER + " || '.9'", _TEXT)}
    WHEN 3 THEN {judge_json("'-0.5'", _TEXT)}
    WHEN 4 THEN {judge_json("'" + '"85"' + "'", _TEXT)}
    WHEN 5 THEN {judge_json("'null'", _TEXT)}
    WHEN 6 THEN {judge_json("'101'", _TEXT)}
    WHEN 7 THEN '{{"{SCORE_FIELD}": ' || {_NUMBER} || '}}'
    WHEN 8 THEN {judge_json(_NUMBER, "'" + '"  "' + "'")}
    WHEN 9 THEN 'oops'
    WHEN 10 THEN {judge_json(_NUMBER, _TEXT, ', "Extra": 1')}
    WHEN 11 THEN ' ' || chr(10)
    WHEN 15 THEN '{{"{REASON_FIELD}": ' || {_TEXT} || '}}'
    WHEN 16 THEN {judge_json("'true'", _TEXT)}
    ELSE {_GOOD} END AS inner_text FROM documents),
replies AS (
  SELECT doc_id, CASE doc_id % 18 WHEN 12 THEN '{{"id": 1}}' WHEN 13 THEN '{{"choices":[{{"index":0}}]}}'
    WHEN 14 THEN 'not json' WHEN 17 THEN '{{"choices":[]}}'
    ELSE '{{"choices":[{{"index":0,"message":{{"role":"assistant","content":' || {quoted('inner_text')} || '}}}}]}}' END AS body
  FROM contents)"""

CHAT_PARSED = f"""
opened AS (SELECT *, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS j FROM replies),
read AS (
  SELECT *, {trim("json_extract_string(j, '$.choices[0].message.content')")} AS t,
    json_type(j, '$.choices') AS choices_type, json_type(j, '$.choices[0].message') AS message_type FROM opened),
named AS (
  SELECT *, CASE WHEN j IS NULL OR json_type(j) <> 'OBJECT' THEN 'Body is not a JSON object.'
    WHEN choices_type IS DISTINCT FROM 'ARRAY' OR json_array_length(j, '$.choices') = 0
      THEN 'Response missing ''choices'' array.'
    WHEN message_type IS DISTINCT FROM 'OBJECT' THEN 'No ''message'' object in first choice.'
    WHEN coalesce(t, '') = '' THEN 'Empty ''content'' in assistant message.' END AS parse_error FROM read),
parsed AS (
  SELECT * EXCLUDE (j, choices_type, message_type), CASE WHEN parse_error IS NULL THEN {unfence('t', CONTROL)} END AS content,
    CASE WHEN parse_error LIKE 'Body%' THEN 'BAD_JSON' WHEN parse_error IS NOT NULL THEN 'ENVELOPE' END AS error_class
  FROM named)"""
ORACLES["parse_chat"] = (
    f"WITH {CHAT_REPLIES}, {CHAT_PARSED} SELECT doc_id, content, parse_error, error_class FROM parsed"
)

def _block(text: str) -> str:
    return f"""'{{"type":"output_text","text":' || {text} || '}}'"""


def _item(*blocks: str, kind: str = "message") -> str:
    return f"""'{{"type":"{kind}","content":[' || {" || ',' || ".join(blocks)} || ']}}'"""


def _body(*items: str) -> str:
    return f"""'{{"output":[' || {" || ',' || ".join(items)} || ']}}'"""


_REFUSAL = """'{"type":"refusal","refusal":"no"}'"""
_INNER = quoted("inner_text")
_FENCED = quoted(f"' {_FENCE}json' || chr(10) || inner_text || chr(10) || '{_FENCE} '")
_LATER = """'"later"'"""
RESPONSES_REPLIES = f"""
contents AS (SELECT doc_id, {_GOOD} AS inner_text FROM documents),
replies AS (
  SELECT doc_id, CASE doc_id % 14
    WHEN 1 THEN {_body(_item(_REFUSAL, _block(_INNER)))}
    WHEN 2 THEN {_body(_item(_REFUSAL), _item(_block(_INNER)))}
    WHEN 3 THEN {_body(_item(_block(_FENCED)))}
    WHEN 4 THEN '{{"id":"x"}}'
    WHEN 5 THEN '{{"output":[]}}'
    WHEN 6 THEN '{{"output":[{{"type":"message"}}]}}'
    WHEN 7 THEN '{{"output":[{{"type":"message","content":[{{"type":"output_text"}}]}}]}}'
    WHEN 8 THEN 'not json'
    WHEN 9 THEN {_body(_item(_block(_INNER), kind="reasoning"))}
    WHEN 10 THEN {_body(lit('{"type":"message","content":null}'), _item(_block(_INNER), _block(_LATER)))}
    WHEN 11 THEN '{{"output":"x"}}'
    WHEN 12 THEN {_body(lit('7'), _item(_block(_INNER)))}
    WHEN 13 THEN {_body(_item(lit('null'), _block(_INNER)))}
    ELSE {_body(lit('{"type":"reasoning"}'), _item(_block(_INNER)))} END AS body FROM contents)"""

RESPONSES_PARSED = f"""
opened AS (SELECT *, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS j FROM replies),
blocks AS (
  SELECT * EXCLUDE (hit), hit.bad AS bad, hit.block AS block FROM (
    SELECT *, list_filter(flatten(list_transform(json_extract(j, '$.output[*]'), lambda i:
        CASE WHEN json_type(i) <> 'OBJECT' THEN [{{'bad': true, 'block': NULL::JSON}}]
          WHEN json_extract_string(i, '$.type') = 'message'
            THEN list_transform(json_extract(i, '$.content[*]'), lambda b: {{'bad': json_type(b) <> 'OBJECT', 'block': b}})
          ELSE [] END)),
      lambda e: e.bad OR json_extract_string(e.block, '$.type') = 'output_text')[1] AS hit FROM opened)),
read AS (SELECT *, trim(json_extract_string(block, '$.text'), {SPACE}) AS t FROM blocks),
named AS (
  SELECT *, CASE WHEN j IS NULL OR json_type(j) <> 'OBJECT' THEN 'Body is not a JSON object.'
    WHEN json_type(j, '$.output') IS DISTINCT FROM 'ARRAY' THEN 'Response missing ''output'' array.'
    WHEN bad IS NULL THEN 'No ''output_text'' block found in response.'
    WHEN bad THEN 'Item or block is not a JSON object.'
    WHEN json_type(block, '$.text') IS DISTINCT FROM 'VARCHAR' THEN 'Block has no ''text'' string.' END AS parse_error
  FROM read),
parsed AS (
  SELECT * EXCLUDE (j, bad, block), CASE WHEN parse_error IS NULL THEN {unfence('t', SPACE)} END AS content,
    CASE WHEN parse_error LIKE 'B%' OR parse_error LIKE 'Item%' THEN 'BAD_JSON' WHEN parse_error IS NOT NULL THEN 'ENVELOPE' END AS error_class
  FROM named)"""
ORACLES["parse_responses"] = (
    f"WITH {RESPONSES_REPLIES}, {RESPONSES_PARSED} SELECT doc_id, content, parse_error, error_class FROM parsed"
)

ORACLES["fence_strip"] = f"""
WITH fenced AS (SELECT doc_id, {trim(f"CASE WHEN doc_id % 2 = 0 THEN '{_FENCE}text' || chr(10) || text || chr(10) || '{_FENCE}' ELSE text END")} AS x
  FROM documents)
SELECT doc_id, {unfence('x', CONTROL)} AS stripped FROM fenced"""

_SCORE_PATH = f"""'$."{SCORE_FIELD}"'"""
_REASON_PATH = f"""'$."{REASON_FIELD}"'"""
JUDGED = f"""
fields AS (
  SELECT *, CASE WHEN json_valid(content) AND starts_with(content, '{{') THEN CAST(content AS JSON) END AS r FROM parsed),
typed AS (
  SELECT *, json_type(r, {_SCORE_PATH}) AS sk, json_extract_string(r, {_SCORE_PATH}) AS st,
    json_type(r, {_REASON_PATH}) AS rk, json_extract_string(r, {_REASON_PATH}) AS rt FROM fields),
numbered AS (
  SELECT *, CASE WHEN sk IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN TRY_CAST(trunc(TRY_CAST(st AS DOUBLE)) AS INTEGER) END AS n
  FROM typed),
judged AS (
  SELECT *, CASE WHEN parse_error IS NOT NULL THEN NULL
    WHEN r IS NULL THEN 'Reply is not a JSON object.'
    WHEN sk IS NULL THEN 'Required field missing: "{SCORE_FIELD}"'
    WHEN sk NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'Field "{SCORE_FIELD}" must be a number, got: ' ||
      CASE sk WHEN 'VARCHAR' THEN 'String' WHEN 'BOOLEAN' THEN 'Boolean' WHEN 'NULL' THEN 'Null'
        WHEN 'ARRAY' THEN 'JSONArray' ELSE 'JSONObject' END
    WHEN n IS NULL OR n < 0 OR n > 100 THEN 'Field "{SCORE_FIELD}" must be 0-100, got: ' || coalesce(CAST(n AS VARCHAR), st)
    WHEN rk IS NULL THEN 'Required field missing: "{REASON_FIELD}"'
    WHEN rk <> 'VARCHAR' OR {trim('rt')} = '' THEN 'Field "{REASON_FIELD}" must be a non-empty string.' END AS schema_error,
    CASE WHEN parse_error IS NOT NULL THEN NULL WHEN r IS NULL THEN 'Reply is not a JSON object.'
      WHEN n IS NULL AND NOT (sk = 'VARCHAR' AND regexp_full_match(st, '[+-]?[0-9]+')) OR sk IS NULL
        THEN '"{SCORE_FIELD}" is not an integer.'
      WHEN rk IS DISTINCT FROM 'VARCHAR' THEN '"{REASON_FIELD}" is not a string.' END AS loose_error
  FROM numbered),
scored AS (
  SELECT *, parse_error IS NULL AND schema_error IS NULL AS usable,
    coalesce(error_class, CASE WHEN schema_error LIKE 'Reply%' THEN 'BAD_JSON' WHEN schema_error IS NOT NULL THEN 'SCHEMA' END)
      AS final_class FROM judged)"""
CHAT_JUDGED = f"{CHAT_REPLIES}, {CHAT_PARSED}, {JUDGED}"
ORACLES["judge_schema"] = (
    f"WITH {CHAT_JUDGED} SELECT doc_id, parse_error, schema_error, final_class AS error_class FROM scored"
)
ORACLES["judge_schema_unchecked"] = f"""
WITH {CHAT_JUDGED} SELECT doc_id, loose_error AS schema_error,
  CASE WHEN parse_error IS NULL AND loose_error IS NULL THEN coalesce(n, TRY_CAST(st AS INTEGER)) END AS judge_score
FROM scored"""
ORACLES["judge_scores"] = f"""
WITH {CHAT_JUDGED} SELECT doc_id, CASE WHEN usable THEN n END AS judge_score, CASE WHEN usable THEN rt END AS reason FROM scored"""
ORACLES["reason_lines"] = """
WITH lines AS (SELECT doc_id, string_split(regexp_replace(text || chr(10) || chr(10), '\\n+$', ''), chr(10)) AS l FROM documents)
SELECT doc_id, CAST(i AS INTEGER) AS pos, l[i + 1] AS line FROM (SELECT doc_id, l, unnest(range(len(l))) AS i FROM lines)"""
ORACLES["judge_verdict"] = f"""
WITH {JUDGE_INPUTS}, {CHAT_JUDGED},
joined AS (
  SELECT c.pair_id, c.threshold, c.input_error, CASE WHEN usable AND c.input_error IS NULL THEN n END AS judge_score,
    CASE WHEN usable AND c.input_error IS NULL THEN rt END AS reason
  FROM checked c JOIN scored s ON CAST(s.doc_id AS VARCHAR) = c.pair_id)
SELECT pair_id, judge_score, threshold, len(string_split(regexp_replace(reason, '\\n+$', ''), chr(10))) AS n_lines,
  CASE WHEN judge_score >= threshold THEN 'PASS' ELSE 'FAIL' END AS status,
  CASE WHEN input_error IS NOT NULL THEN 'INPUT' WHEN judge_score IS NULL THEN 'RUNTIME' END AS error_kind,
  CASE WHEN input_error IS NOT NULL THEN 'Error: ' || input_error WHEN judge_score IS NULL THEN 'Error: no valid reply'
    WHEN judge_score >= threshold THEN 'PASS - Similarity Score: ' || judge_score || '%'
    ELSE 'FAIL - Similarity Score: ' || judge_score || '% is below threshold of ' || threshold || '%' END AS message
FROM joined"""

# --- attempts -------------------------------------------------------------------------

_TRY_REASON = quoted("'try ' || attempt_no || ' of ' || source")
_TRY_GOOD = judge_json(_NUMBER, _TRY_REASON)
_TRY_INNER = f"""CASE mix WHEN 17 THEN {judge_json("'101'", _TRY_REASON)} WHEN 18 THEN 'oops'
  WHEN 21 THEN '{_FENCE}json' || chr(10) || {_TRY_GOOD} || chr(10) || '{_FENCE}' ELSE {_TRY_GOOD} END"""
PREFERRED = f"""
preferred AS (
  SELECT CAST(doc_id AS VARCHAR) AS pair_id, doc_id, source, CASE doc_id % 5 WHEN 0 THEN NULL
    WHEN 1 THEN {lit(JUDGE_CHAIN[0])} WHEN 2 THEN {lit(JUDGE_CHAIN[1])} WHEN 3 THEN {lit(JUDGE_CHAIN[2])}
    ELSE {lit(CUSTOM_MODEL)} END AS preferred_model FROM documents)"""
ATTEMPTS = f"""{PREFERRED},
tries AS (
  SELECT p.*, m, {lits([*JUDGE_CHAIN, CUSTOM_MODEL])}[m + 1] AS model, CAST(attempt_no AS INTEGER) AS attempt_no,
    (doc_id * 7 + m * 5 + attempt_no * 2 + doc_id // 16) % 23 AS mix
  FROM preferred p, range(4) r(m), range(1, 6) s(attempt_no)
  WHERE (doc_id // 7) % 4 <> 0 OR attempt_no <= 2),
replies AS (
  SELECT *, CASE WHEN mix < 6 THEN 429 WHEN mix < 11 THEN 500 WHEN mix = 11 THEN NULL WHEN mix < 14 THEN 404 ELSE 200 END AS http_status,
    CASE mix WHEN 0 THEN '2' WHEN 2 THEN 'abc' WHEN 3 THEN '45' WHEN 4 THEN ' 7 ' WHEN 5 THEN '-1' END AS retry_after,
    CASE WHEN mix = 19 THEN '{{"output":[]}}' WHEN mix >= 14 THEN
      '{{"output":[{{"type":"message","content":[{{"type":"output_text","text":' || {quoted(_TRY_INNER)} || '}}]}}]}}' END AS body
  FROM tries)"""
_HTTP = """CASE WHEN http_status IS NULL THEN 'NETWORK' WHEN http_status BETWEEN 200 AND 299 THEN 'OK'
    WHEN http_status = 429 THEN 'RATE_LIMIT' WHEN http_status >= 500 THEN 'SERVER' ELSE 'CLIENT' END"""
ORACLES["http_outcome"] = f"WITH {ATTEMPTS} SELECT pair_id, model, attempt_no, {_HTTP} AS outcome FROM replies"

RESPONSES_UNFENCED = RESPONSES_PARSED.replace(unfence("t", SPACE), "t")


def outcomes(relation: str, error_class: str) -> str:
    return f"""
outcomes AS (
  SELECT *, CASE WHEN {_HTTP} = 'OK' THEN coalesce({error_class}, 'OK') ELSE {_HTTP} END AS outcome FROM {relation})"""


OUTCOMES = f"{ATTEMPTS}, {RESPONSES_PARSED}, {JUDGED}, {outcomes('scored', 'final_class')}"
DIRECT_OUTCOMES = f"""{ATTEMPTS}, {RESPONSES_UNFENCED}, {JUDGED},
loose AS (
  SELECT * REPLACE (coalesce(n, TRY_CAST(st AS INTEGER)) AS n),
    coalesce(error_class, CASE WHEN loose_error IS NOT NULL THEN 'BAD_JSON' END) AS loose_class FROM judged),
{outcomes('loose', 'loose_class')}"""
VISION_OUTCOMES = f"{ATTEMPTS}, {RESPONSES_UNFENCED}, {outcomes('parsed', 'error_class')}"


def actions(policy: str) -> str:
    cases = " ".join(f"WHEN {lit(o)} THEN {lit(a)}" for o, a in POLICIES[policy].items())
    return f"CASE outcome {cases} END"


ORACLES["attempt_wait"] = f"""
WITH {OUTCOMES}, acted AS (
  SELECT *, {actions('responses')} AS action, coalesce(TRY_CAST(trim(retry_after) AS BIGINT), 0) * 1000 AS asked,
    {FIRST_WAIT_MS} * CAST(pow(2, attempt_no - 1) AS BIGINT) AS doubling FROM outcomes)
SELECT pair_id, model, attempt_no, outcome, CAST(
  CASE WHEN outcome = 'RATE_LIMIT' THEN least(CASE WHEN asked > 0 THEN asked ELSE doubling END, {LONGEST_WAIT_MS})
    WHEN action = 'retry' AND attempt_no < {MAX_ATTEMPTS} THEN least(doubling, {LONGEST_WAIT_MS}) ELSE 0 END AS BIGINT) AS wait_ms
FROM acted"""
ORACLES["attempt_wait_direct"] = f"""
WITH {DIRECT_OUTCOMES}, acted AS (
  SELECT *, {actions('direct')} AS action, coalesce(TRY_CAST(trim(retry_after) AS BIGINT), 0) * 1000 AS asked FROM outcomes)
SELECT pair_id, model, attempt_no, outcome, CAST(
  CASE WHEN attempt_no >= {MAX_ATTEMPTS} THEN 0
    WHEN outcome = 'RATE_LIMIT' THEN CASE WHEN asked > 0 THEN asked ELSE {DIRECT_WAIT_MS} * CAST(pow(2, attempt_no - 1) AS BIGINT) END
    WHEN action = 'retry' THEN {DIRECT_WAIT_MS} * attempt_no ELSE 0 END AS BIGINT) AS wait_ms
FROM acted"""


def order_of(preferred: str, chain) -> str:
    models = lits(chain)
    return f"""CASE WHEN list_contains({models}, {preferred})
      THEN list_slice({models}, list_position({models}, {preferred}), {len(chain)})
      ELSE list_concat([{preferred}], {models}) END"""


ORACLES["model_order"] = f"""
WITH {PREFERRED}, ordered AS (
  SELECT pair_id, preferred_model, {order_of(f"coalesce(preferred_model, {lit(JUDGE_CHAIN[0])})", JUDGE_CHAIN)} AS o FROM preferred)
SELECT pair_id, preferred_model, CAST(i AS INTEGER) AS rank, o[i + 1] AS model
FROM (SELECT *, unnest(range(len(o))) AS i FROM ordered)"""


def resolved(policy: str, chain, log: str = OUTCOMES, payload=(("judge_score", "n"), ("reason", "rt"))) -> str:
    first = lit(chain[0])
    wish = f"coalesce(preferred_model, {first})" if len(chain) > 1 else first
    kept = ", ".join(f"CASE WHEN e.action = 'accept' THEN e.{column} END AS {name}" for name, column in payload)
    return f"""
WITH {log},
placed AS (SELECT *, {order_of(wish, chain)} AS o, {actions(policy)} AS action FROM outcomes),
ranked AS (SELECT *, list_position(o, model) AS place FROM placed),
stops AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id, place ORDER BY attempt_no) AS nth
  FROM ranked WHERE place > 0 AND attempt_no <= {MAX_ATTEMPTS} AND (action <> 'retry' OR attempt_no = {MAX_ATTEMPTS})),
firsts AS (SELECT * FROM stops WHERE nth = 1),
reached AS (
  SELECT * FROM (
    SELECT *, count(CASE WHEN action = 'next' THEN 1 END) OVER (
      PARTITION BY pair_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS refusals FROM firsts)
  WHERE refusals = place - 1),
ends AS (SELECT *, 1 AS k FROM reached WHERE action <> 'next'),
refused AS (SELECT pair_id FROM reached WHERE action = 'next' AND place = len(o)),
keys AS (SELECT DISTINCT pair_id FROM outcomes)
SELECT p.pair_id,
  CASE e.action WHEN 'accept' THEN 'ACCEPTED' WHEN 'abort' THEN 'ABORTED' WHEN 'retry' THEN 'RETRIES_USED_UP'
    ELSE CASE WHEN r.pair_id IS NOT NULL THEN 'MODELS_USED_UP' ELSE 'INCOMPLETE' END END AS end_state,
  CASE WHEN e.action = 'accept' THEN e.model END AS model_used, e.attempt_no,
  {kept}
FROM keys p LEFT JOIN (SELECT * FROM ends WHERE k = 1) e ON e.pair_id = p.pair_id
LEFT JOIN refused r ON r.pair_id = p.pair_id"""


ORACLES["resolve_attempts"] = resolved("responses", JUDGE_CHAIN)
ORACLES["resolve_attempts_chat"] = resolved("chat", JUDGE_CHAIN[:1])
ORACLES["resolve_attempts_vision"] = resolved("vision", VISION_CHAIN, VISION_OUTCOMES, (("content", "content"),))
ORACLES["resolve_attempts_direct"] = resolved("direct", JUDGE_CHAIN[:1], DIRECT_OUTCOMES)

# --- documents and generated pairs ----------------------------------------------------

DOC_TYPES = f"""{DOCUMENT_BYTES},
kinds AS (SELECT *, CASE WHEN starts_with(hex(content), '25504446') THEN 'pdf' WHEN starts_with(hex(content), '504B') THEN 'docx'
  ELSE 'txt' END AS doc_type FROM bytes)"""
ORACLES["document_source"] = f"""
WITH {DOCUMENT_BYTES} SELECT doc_id, octet_length(content) AS length, left(hex(content), 8) AS first_bytes FROM bytes"""
ORACLES["document_type"] = f"WITH {DOC_TYPES} SELECT doc_id, doc_type FROM kinds"
ORACLES["document_text"] = f"""
WITH {DOC_TYPES}, read AS (SELECT *, CASE WHEN doc_type = 'txt' THEN {trim('decode(content)')} END AS t FROM kinds)
SELECT doc_id, doc_type, CASE WHEN t <> '' THEN t END AS text,
  CASE WHEN doc_type <> 'txt' THEN 'No text reader for type ' || doc_type WHEN t = '' THEN 'Document is empty.' END AS document_error
FROM read"""


def question(query: str, answer: str | None = None) -> str:
    tail = f""" || ', "Expected_Response": ' || {answer}""" if answer else ""
    return f"""'{{"Query": ' || {query}{tail} || '}}'"""


_FIRST = question("""'"First?"'""", _TEXT)
_MANY = f"""'[' || array_to_string(list_transform(range(1, doc_id % 4 + 2),
  lambda i: {question("""'"Question ' || i || '?"'""", _TEXT)}), ', ') || ']'"""
QUESTIONS = f"""
contents AS (
  SELECT doc_id, CASE doc_id % 12
    WHEN 4 THEN '{_FENCE}json' || chr(10) || {_MANY} || chr(10) || '{_FENCE}'
    WHEN 5 THEN 'Here: ' || {_MANY}
    WHEN 6 THEN '[]'
    WHEN 7 THEN '[' || {_FIRST} || ', 1]'
    WHEN 8 THEN '[' || {_FIRST} || ', ' || {question("""'" "'""", _TEXT)} || ']'
    WHEN 9 THEN '[' || {question("'7'", _TEXT)} || ', ' || {_FIRST} || ']'
    WHEN 10 THEN '[' || {_FIRST} || ', ' || {question("""'"Second?"'""")} || ']'
    WHEN 11 THEN '[{{"Query": '
    ELSE {_MANY} END AS inner_text FROM documents),
replies AS (
  SELECT doc_id, '{{"choices":[{{"index":0,"message":{{"role":"assistant","content":' || {quoted('inner_text')} || '}}}}]}}' AS body
  FROM contents),
{CHAT_PARSED},
listed AS (
  SELECT *, CASE WHEN json_valid(content) AND starts_with(content, '[') THEN CAST(content AS JSON) END AS arr FROM parsed),
arrays AS (
  SELECT doc_id, coalesce(parse_error,
      CASE WHEN NOT starts_with(content, '[') THEN 'Expected JSON array starting with ''['', got: ' || left(content, 100)
        WHEN arr IS NULL THEN 'Reply is not a JSON array.' END) AS problem,
    error_class, json_extract(arr, '$[*]') AS elements FROM listed),
elements AS (SELECT doc_id, i, elements[i + 1] AS e FROM (SELECT doc_id, elements, unnest(range(len(elements))) AS i FROM arrays)),
element_fields AS (
  SELECT doc_id, i, e, json_type(e, '$.Query') AS qk, json_extract_string(e, '$.Query') AS q,
    json_type(e, '$.Expected_Response') AS ak, json_extract_string(e, '$.Expected_Response') AS a FROM elements),
element_errors AS (
  SELECT *, 'Element at index ' || i || CASE WHEN json_type(e) <> 'OBJECT' THEN ' is not a JSON object.'
      WHEN qk IS NULL OR qk = 'NULL' OR {trim('q')} = '' THEN ' is missing or has empty ''Query'' field.'
      WHEN ak IS NULL OR ak = 'NULL' OR {trim('a')} = '' THEN ' is missing or has empty ''Expected_Response'' field.' END AS bad,
    'Element at index ' || i || CASE WHEN qk <> 'VARCHAR' THEN ' has a ''Query'' that is not a string.'
      WHEN ak <> 'VARCHAR' THEN ' has a ''Expected_Response'' that is not a string.' END AS wrong FROM element_fields),
errors AS (
  SELECT doc_id, arg_min(bad, i) FILTER (bad IS NOT NULL) AS bad, arg_min(wrong, i) FILTER (wrong IS NOT NULL) AS wrong
  FROM element_errors GROUP BY doc_id),
checked AS (
  SELECT r.doc_id, r.problem, r.elements, r.error_class,
    coalesce(CASE WHEN len(r.elements) = 0 THEN 'Model returned an empty array.' END, e.bad) AS bad, e.wrong
  FROM arrays r LEFT JOIN errors e ON e.doc_id = r.doc_id),
verdicts AS (
  SELECT *, coalesce(bad, wrong) AS array_error, CASE WHEN problem IS NOT NULL THEN 'RUNTIME' WHEN bad IS NOT NULL THEN 'SCHEMA'
    WHEN wrong IS NOT NULL THEN 'RUNTIME' END AS error_kind FROM checked)"""
ORACLES["qa_parse"] = f"""
WITH {QUESTIONS} SELECT doc_id, len(elements) AS n_elements, problem AS parse_error,
  coalesce(error_class, CASE WHEN problem IS NOT NULL THEN 'BAD_JSON' END) AS error_class FROM arrays"""
ORACLES["qa_validate"] = f"WITH {QUESTIONS} SELECT doc_id, array_error, error_kind FROM verdicts"
ORACLES["qa_pairs"] = f"""
WITH {QUESTIONS} SELECT f.doc_id, CAST(f.i AS INTEGER) AS pos, f.q AS query, f.a AS expected_response
FROM element_fields f JOIN verdicts v ON v.doc_id = f.doc_id WHERE v.error_kind IS NULL"""
ORACLES["qa_totals"] = f"""
WITH {QUESTIONS}, counted AS (SELECT *, CASE WHEN error_kind IS NULL THEN len(elements) END AS total FROM verdicts)
SELECT doc_id, total AS total_generated, coalesce(total = doc_id % 5 + 1, false) AS count_matches,
  CASE WHEN error_kind IS NULL THEN 'PASS' ELSE 'FAIL' END AS status,
  CASE WHEN error_kind IS NULL THEN 'PASS - Generated ' || total || ' query-response pairs.'
    ELSE 'Error: ' || coalesce(problem, array_error) END AS message FROM counted"""

# --- agent traces ---------------------------------------------------------------------

TRACES = """
keys AS (
  SELECT o_orderkey AS k, 'T' || o_orderkey AS test_id, 'ORD' || o_orderkey AS id, o_orderkey % 13 AS f,
    CASE WHEN o_orderkey % 3 = 1 THEN ['check_policy', 'search_order', 'create_refund']
      ELSE ['search_order', 'create_refund'] END AS expected_tools FROM orders),
named AS (
  SELECT *, CASE WHEN k % 29 <> 0 THEN id END AS expected_order_id,
    CASE WHEN k % 4 < 3 THEN 'The money was sent back successfully, see ' || id ELSE 'We still look into the matter.' END AS final_answer,
    CASE f WHEN 0 THEN list_concat(['delete_order'], expected_tools) WHEN 3 THEN list_reverse(expected_tools) WHEN 4 THEN []
      WHEN 5 THEN [expected_tools[1], 'delete_order']
      WHEN 6 THEN list_transform(expected_tools, lambda t: upper(t[1]) || t[2:])
      WHEN 7 THEN list_concat(expected_tools, ['check_policy']) ELSE expected_tools END AS names FROM keys),
traces AS (
  SELECT *, list_transform(range(len(names)), lambda i: {'pos': i, 'name': names[i + 1],
    'id': CASE WHEN i = 1 AND f = 2 THEN NULL WHEN i = 0 AND f IN (1, 5) THEN 'ORD0' ELSE id END}) AS calls FROM named),
returned AS (SELECT DISTINCT 'ORD' || l_orderkey AS order_id FROM lineitem WHERE l_returnflag = 'R'),
flagged AS (
  SELECT t.*, r.order_id IS NOT NULL AS in_backend,
    list_filter(calls, lambda c: c.name NOT IN ('search_order', 'create_refund', 'check_policy'))[1] AS unknown,
    list_filter(calls, lambda c: c.id IS DISTINCT FROM expected_order_id)[1] AS wrong
  FROM traces t LEFT JOIN returned r ON r.order_id = t.expected_order_id)"""
ORACLES["tool_exists"] = f"""
WITH {TRACES} SELECT test_id, unknown IS NULL AS all_known, CAST(unknown.pos AS INTEGER) AS unknown_pos,
  unknown.name AS unknown_tool FROM flagged"""
ORACLES["tool_params"] = f"""
WITH {TRACES} SELECT test_id, expected_order_id IS NULL AS rejected,
  CASE WHEN expected_order_id IS NOT NULL THEN wrong IS NULL END AS all_right,
  CASE WHEN expected_order_id IS NOT NULL THEN CAST(wrong.pos AS INTEGER) END AS wrong_pos
FROM flagged"""
ORACLES["tool_sequence"] = f"""
WITH {TRACES} SELECT test_id, array_to_string(names, ',') AS called, names = expected_tools AS same_sequence FROM flagged"""
ORACLES["backend_exists"] = f"WITH {TRACES} SELECT test_id, expected_order_id, in_backend FROM flagged"
ORACLES["hallucination"] = f"""
WITH {TRACES} SELECT test_id, in_backend, final_answer LIKE '%successfully%' AND NOT in_backend AS is_hallucination FROM flagged"""
ORACLES["agent_verdict"] = f"""
WITH {TRACES}, failed AS (
  SELECT *, CASE WHEN expected_order_id IS NULL THEN 'input'
    WHEN unknown IS NOT NULL AND (wrong IS NULL OR unknown.pos <= wrong.pos) THEN 'tool_exists'
    WHEN wrong IS NOT NULL THEN 'tool_params'
    WHEN names <> expected_tools THEN 'tool_sequence'
    WHEN NOT in_backend THEN 'backend_exists' END AS failed_check FROM flagged)
SELECT test_id, failed_check,
  CASE WHEN failed_check IS NULL THEN 'PASS' WHEN failed_check = 'input' THEN 'REJECTED' ELSE 'FAIL' END AS status,
  CASE failed_check WHEN 'input' THEN 'expected_order_id must not be null.'
    WHEN 'tool_exists' THEN 'INVALID TOOL DETECTED -> ' || unknown.name
    WHEN 'tool_params' THEN 'INVALID ORDER ID' || chr(10) || 'Expected -> ' || expected_order_id || chr(10) || 'Actual -> ' || coalesce(wrong.id, 'null')
    WHEN 'tool_sequence' THEN 'TOOL SEQUENCE MISMATCH' || chr(10) || 'Expected -> [' || array_to_string(expected_tools, ', ') || ']'
      || chr(10) || 'Actual -> [' || array_to_string(names, ', ') || ']'
    WHEN 'backend_exists' THEN 'Refund not created in backend' ELSE 'AI AGENT TEST PASSED' END AS message
FROM failed"""
ORACLES["tool_exists_table"] = ORACLES["tool_exists"]
ORACLES["cosine_pct_table"] = ORACLES["cosine_by_terms"]
ORACLES["result_sink"] = ORACLES["cosine_verdict"]
ORACLES["judge_verdict_by_key"] = ORACLES["judge_verdict"]
ORACLES["reply_source"] = f"""
WITH {ATTEMPTS} SELECT pair_id, model, CAST(attempt_no AS INTEGER) AS attempt_no, CAST(http_status AS INTEGER) AS http_status,
  retry_after, body FROM replies"""
