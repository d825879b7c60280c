"""One DuckDB statement per registered query."""

from __future__ import annotations

from oracle import base as B
from redline import constants as K

_WEIGHTS = tuple(K.SCORE_WEIGHTS.values())  # template, modality and part, dictation, edited sections

SQL: dict[str, str] = {}

_A = "WITH " + B.analysis()

SQL["cases_scan"] = f"""WITH {B.CASES}
SELECT row_index, case_id, modality, body_part, template_content, dictation, report FROM cases"""

SQL["template_structure"] = f"""WITH {B.CASES}
SELECT case_id, {B.valid('template_content')} AS valid,
  CAST((length(template_content)-length(replace(template_content,'IMPRESSION:','')))/11 AS BIGINT) AS impressions,
  CASE WHEN {B.valid('template_content')} THEN {B.region('template_content')} END AS region,
  CASE WHEN {B.valid('template_content')} THEN {B.after('template_content')} END AS after_impression
FROM cases"""

SQL["sections_parse"] = f"""WITH {B.CASES},{B.sections('ts','template_content')}
SELECT case_id, pos AS position, label, body, CAST(st AS BIGINT) AS start_line, CAST(en AS BIGINT) AS end_line FROM ts"""

SQL["report_sections_parse"] = f"""WITH {B.CASES},{B.sections('rs','report')}
SELECT case_id, pos AS position, label, body, CAST(st AS BIGINT) AS start_line, CAST(en AS BIGINT) AS end_line FROM rs"""

SQL["section_counts"] = f"""WITH {B.CASES},{B.sections('ts','template_content')},
n AS (SELECT c.modality||' / '||c.body_part AS grp, c.case_id, count(t.label) AS n FROM cases c
  LEFT JOIN ts t ON t.case_id=c.case_id WHERE {B.valid('c.template_content')} GROUP BY ALL)
SELECT grp AS "group", count(*) AS templates, count(*) FILTER (WHERE n=0) AS prose,
  CAST(sum(n) AS BIGINT) AS sections, max(n) AS most_sections FROM n GROUP BY grp"""

SQL["section_bodies_last_wins"] = f"""WITH {B.CASES},{B.sections('rs','report')},{B.last_body('rs')}
SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY pos) - 1 AS position, label, body FROM rsu"""

SQL["normalize_text"] = f"SELECT doc_id, {B.norm('text')} AS normalized FROM documents"

SQL["tokens_df"] = f"""WITH t AS (SELECT DISTINCT doc_id, unnest({B.tokens('text')}) AS token FROM documents)
SELECT token, count(*) AS df FROM t WHERE NOT list_contains({B.STOP_LIST}, token) GROUP BY token"""

SQL["dictation_terms"] = f"""WITH {B.CASES}, t AS (SELECT unnest({B.tokens('dictation')}) AS term FROM cases)
SELECT term, count(*) AS occurrences FROM t
WHERE length(term)>=3 AND NOT list_contains({B.STOP_LIST}, term) GROUP BY term"""

_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
_SIDE = _WORDS.format("dictation")


def side(column: str = "dictation") -> str:
    words = _WORDS.format(column)
    n = lambda w: f"len(list_filter({words}, lambda w: w='{w}'))"
    return (
        f"CASE WHEN {n('bilateral')}>0 THEN 'bilateral' WHEN {n('left')}>{n('right')} THEN 'left' "
        f"WHEN {n('right')}>{n('left')} THEN 'right' END"
    )


def generic(column: str = "body_part") -> str:
    t = f"lower({B.strip(column)})"
    return rf"regexp_replace({t}, '^(.+) (spine|joint|bone|region)$', '\1', 's')"


SQL["laterality"] = f"WITH {B.CASES} SELECT case_id, {side()} AS side FROM cases"
SQL["generic_term"] = f"WITH {B.CASES} SELECT case_id, {generic()} AS term FROM cases"

_SPANS = (
    r"CASE WHEN len(regexp_extract_all({0}, '\[[^\]]*\]'))>0 THEN array_to_string(regexp_extract_all({0}, '\[[^\]]*\]'),'|') "
    "WHEN contains({0},'[') THEN '[' WHEN contains({0},']') THEN ']' ELSE '' END"
)
SQL["bracket_spans"] = f"""WITH {B.CASES}, u AS (
  SELECT case_id AS id, report AS t FROM cases UNION ALL SELECT 'p'||CAST(page_id AS VARCHAR), html FROM pages)
SELECT id, {_SPANS.format('t')} AS spans, replace(replace(t,'[',''),']','') AS stripped FROM u"""

MEASURES = r"regexp_extract_all({}, '[0-9]+(?:\.[0-9]+)?\s*(?:mL|ml|mm|cm|cc|mmHg|mm\s*hg|kPa|degrees?|deg)')"


def lost(dictation: str, report: str) -> str:
    return (
        f"list_filter(list_transform({MEASURES.format(dictation)}, lambda m: {B.strip('m')}),"
        f" lambda m: NOT contains(lower({report}), lower(m)))"
    )


SQL["measurement_loss"] = f"""WITH {B.CASES}
SELECT case_id, len({MEASURES.format('dictation')}) AS measured,
  coalesce(array_to_string({lost('dictation','report')},'|'),'') AS missing FROM cases"""

_ONE_LINE = f"regexp_replace({B.strip('dictation')}, {B.WS_RE}, ' ', 'g')"
SNIPPET = (
    f"CASE WHEN {_ONE_LINE}='' THEN 'No significant abnormality.' WHEN length({_ONE_LINE})>120 "
    f"THEN rtrim(substr({_ONE_LINE},1,120),' ,.;')||' ...' ELSE {_ONE_LINE} END"
)
SQL["dictation_snippet"] = f"WITH {B.CASES} SELECT case_id, {SNIPPET} AS snippet FROM cases"

SQL["edit_classify"] = _A + """
SELECT case_id, edited_labels AS edited, unchanged_labels AS unchanged, added_labels AS added,
  findings_changed, impression_changed, sectioned, sections,
  coalesce(array_to_string(ph,'|'),'') AS placeholders, coalesce(array_to_string(unresolved,'|'),'') AS unresolved,
  len(ph)-len(unresolved) AS resolved FROM analysis"""

SQL["edit_rate_by_group"] = _A + """
SELECT modality||' / '||body_part AS "group", count(*) FILTER (WHERE findings_changed) AS findings_edited,
  count(*) AS total FROM analysis GROUP BY 1"""

SQL["edit_histogram"] = _A + """
SELECT edited AS edited_sections, count(*) AS cases FROM analysis GROUP BY 1"""

SQL["top_labels"] = _A + """,
f AS (SELECT v.label, count(*) AS edits, min(a.row_index*1000000+v.pos) AS first
  FROM verdict v JOIN analysis a ON a.case_id=v.case_id WHERE NOT v.same GROUP BY v.label)
SELECT row_number() OVER (ORDER BY edits DESC, first) AS rank, label, edits FROM f
ORDER BY edits DESC, first LIMIT 20"""

SQL["placeholder_stats"] = _A + """,
p AS (SELECT unnest(ph) AS placeholder FROM analysis)
SELECT placeholder, count(*) AS cases FROM p GROUP BY 1"""

SQL["corpus_edit_stats"] = _A + """
SELECT count(*) AS total_cases,
  count(*) FILTER (WHERE findings_changed) AS findings_edited,
  count(*) FILTER (WHERE NOT findings_changed) AS findings_unchanged,
  count(*) FILTER (WHERE impression_changed) AS impression_edited,
  count(*) FILTER (WHERE NOT impression_changed) AS impression_unchanged,
  round(avg(edited),3) AS average_edited_sections, CAST(median(edited) AS DOUBLE) AS median_edited_sections,
  count(*) FILTER (WHERE edited=0) AS zero_section_edits, count(*) FILTER (WHERE edited=1) AS one_section_edit,
  count(*) FILTER (WHERE edited>=2) AS multi_section_edits,
  count(*) FILTER (WHERE impression_changed AND NOT findings_changed) AS only_impression_changed,
  count(*) FILTER (WHERE findings_changed AND NOT impression_changed) AS only_findings_changed,
  count(*) FILTER (WHERE findings_changed AND impression_changed) AS both_changed,
  round(count(*) FILTER (WHERE sections>0 AND unchanged>=sections/2)/count(*)*100,2) AS percent_mostly_unchanged,
  count(*) FILTER (WHERE len(ph)>0) AS cases_with_placeholder,
  count(*) FILTER (WHERE len(unresolved)>0) AS cases_with_unresolved_placeholder
FROM analysis"""

_REP = "CASE WHEN {b}='' THEN {l}||':' WHEN contains({b},chr(10)) THEN {l}||':'||chr(10)||{b} ELSE {l}||': '||{b} END"
_OK2 = f"{B.valid('c.template_content')} AND {B.valid('c.report')}"

_DERIVED = _A + f""",
kept AS (
  SELECT t.case_id, t.label, t.pos, r.body FROM tsu t JOIN rsu r ON r.case_id=t.case_id AND r.label=t.label
  JOIN both_ok b ON b.case_id=t.case_id WHERE {B.norm('t.body')} <> {B.norm('r.body')}),
imp AS (
  SELECT c.case_id, CASE WHEN {B.norm(B.after('c.template_content'))} <> {B.norm(B.after('c.report'))}
      AND {B.nl_trim(B.after('c.report'))} <> '' THEN {B.nl_trim(B.after('c.report'))} END AS impression
  FROM cases c WHERE {_OK2})"""

SQL["derive_edits"] = _DERIVED + """,
e AS (SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY pos) - 1 AS position, label, body FROM kept)
SELECT case_id, position, label, body FROM e
UNION ALL SELECT i.case_id, (SELECT count(*) FROM e WHERE e.case_id=i.case_id), 'IMPRESSION', impression FROM imp i"""


def resolved(raw: str, body_part: str, dictation: str) -> str:
    out = raw
    for token in ("[left/right]", "[left/right/bilateral]", "[_laterality_]"):
        out = f"replace({out}, '{token}', coalesce({dictation}, '{token}'))"
    return f"replace(replace(replace({out}, '[generic]', {body_part}),'[',''),']','')"


def _warn(raw: str, side_: str) -> str:
    found = f"list_filter({B.TOKENS3}, lambda p: contains({raw}, p))"
    quoted = f"array_to_string(list_transform({found}, lambda p: chr(39)||p||chr(39)),', ')"
    return (
        f"CASE WHEN len({found})>0 AND {side_} IS NULL THEN 'laterality placeholder(s) ['||{quoted}||"
        "'] left unresolved: the dictation names no side' ELSE '' END"
    )


SQL["apply_edits"] = _DERIVED + f""",
pieces AS (
  SELECT l.case_id, l.i, CASE WHEN k.label IS NULL THEN l.line
      WHEN l.i = t.st THEN {_REP.format(b=B.nl_trim('k.body'), l='k.label')} END AS piece,
      k.label IS NOT NULL AND l.i > t.st AS gone
  FROM ts_s l LEFT JOIN ts t ON t.case_id=l.case_id AND t.pos=l.sid-1 AND l.i>=t.st AND l.i<t.en
  LEFT JOIN kept k ON k.case_id=t.case_id AND k.label=t.label),
built AS (SELECT case_id, string_agg(piece, chr(10) ORDER BY i) AS region FROM pieces WHERE NOT gone GROUP BY case_id),
raw AS (
  SELECT c.case_id, c.case_id NOT IN (SELECT case_id FROM ts) AS rejected,
    'FINDINGS:'||b.region||'IMPRESSION:'||CASE WHEN i.impression IS NULL THEN {B.after('c.template_content')}
      ELSE chr(10)||i.impression END AS raw, {generic('c.body_part')} AS term, {side('c.dictation')} AS side
  FROM cases c JOIN imp i ON i.case_id=c.case_id JOIN built b ON b.case_id=c.case_id)
SELECT case_id, CASE WHEN NOT rejected THEN {resolved('raw','term','side')} END AS report,
  CASE WHEN rejected THEN '' ELSE {_warn('raw','side')} END AS warnings, rejected FROM raw"""

SQL["unknown_labels"] = _A + """
SELECT b.case_id, coalesce((SELECT string_agg(label, '|' ORDER BY label) FROM rsu r WHERE r.case_id=b.case_id
  AND NOT EXISTS (SELECT 1 FROM ts t WHERE t.case_id=r.case_id AND t.label=r.label)
  AND (EXISTS (SELECT 1 FROM ts t WHERE t.case_id=r.case_id) OR r.label<>'FINDINGS')),'') AS unknown
FROM both_ok b"""

SQL["mock_edits"] = f"""WITH {B.CASES},{B.sections('ts','template_content')},
s AS (SELECT case_id, {SNIPPET} AS snip FROM cases),
pieces AS (
  SELECT l.case_id, l.i, CASE WHEN t.label IS NULL THEN l.line
      ELSE t.label||': Mockized review for '||t.label||': '||s.snip END AS piece,
      t.label IS NOT NULL AND l.i > t.st AS gone
  FROM ts_s l JOIN s ON s.case_id=l.case_id
  LEFT JOIN ts t ON t.case_id=l.case_id AND t.pos=l.sid-1 AND l.i>=t.st AND l.i<t.en),
built AS (SELECT case_id, string_agg(piece, chr(10) ORDER BY i) AS region FROM pieces WHERE NOT gone GROUP BY case_id),
raw AS (
  SELECT c.case_id, 'FINDINGS:'||CASE WHEN c.case_id IN (SELECT case_id FROM ts) THEN b.region
      ELSE chr(10)||s.snip||chr(10)||chr(10) END||'IMPRESSION:'||chr(10)||'Mock impression ('||c.case_id||
      ') - not clinically meaningful.' AS raw, {generic('c.body_part')} AS term, {side('c.dictation')} AS side
  FROM cases c JOIN s ON s.case_id=c.case_id JOIN built b ON b.case_id=c.case_id)
SELECT case_id, {resolved('raw','term','side')} AS report, {_warn('raw','side')} AS apply_warnings,
  CAST(0 AS BIGINT) AS n_errors FROM raw"""

_QSPANS = (
    r"CASE WHEN len(regexp_extract_all({0}, '\[[^\]]*\]'))>0 THEN array_to_string(list_transform("
    r"regexp_extract_all({0}, '\[[^\]]*\]'), lambda s: chr(39)||s||chr(39)),', ') "
    "WHEN contains({0},'[') THEN chr(39)||'['||chr(39) WHEN contains({0},']') THEN chr(39)||']'||chr(39) ELSE '' END"
)


def _list(items: str) -> str:
    return f"('['||array_to_string(list_transform({items}, lambda s: chr(39)||s||chr(39)),', ')||']')"


SQL["report_validation"] = f"""WITH {B.CASES},{B.sections('rs','report')},
dup AS (SELECT case_id, list(label ORDER BY label) AS names FROM (
  SELECT case_id, label FROM rs GROUP BY case_id, label HAVING count(*)>1) GROUP BY case_id),
v AS (SELECT c.*, list_filter({B.TOKENS4}, lambda p: contains(report,p)) AS left_ph, dup.names,
    {lost('dictation','report')} AS lost, {_QSPANS.format('report')} AS spans
  FROM cases c LEFT JOIN dup ON dup.case_id=c.case_id)
SELECT case_id, concat_ws('|',
  CASE WHEN spans<>'' THEN 'report holds bracketed placeholder or template text: '||spans END,
  CASE WHEN {B.nl_trim(B.region('report'))}='' THEN 'empty FINDINGS block' END,
  CASE WHEN {B.strip(B.after('report'))}='' THEN 'empty IMPRESSION' END) AS errors,
 concat_ws('|',
  CASE WHEN len(left_ph)>0 THEN 'unresolved placeholder(s) in report: '||{_list('left_ph')} END,
  CASE WHEN names IS NOT NULL THEN 'duplicate section label(s) in report: '||{_list('names')} END,
  CASE WHEN len(lost)>0 THEN 'measured value(s) of the dictation absent from report: '||{_list('lost')} END) AS warnings
FROM v"""

SQL["edit_summary"] = f"""WITH {B.CASES},{B.sections('ts','template_content')},{B.sections('rs','report')},
r1 AS (SELECT case_id, label, arg_min(body, pos) AS body FROM rs GROUP BY ALL),
d AS (SELECT t.case_id, string_agg(t.label, '|' ORDER BY t.pos) AS edited, count(*) AS n FROM ts t
  LEFT JOIN r1 ON r1.case_id=t.case_id AND r1.label=t.label
  WHERE r1.label IS NULL OR {B.strip('r1.body')} <> {B.strip('t.body')} GROUP BY t.case_id)
SELECT c.case_id, CASE WHEN {_OK2} THEN coalesce(d.edited,'') END AS edited,
  CASE WHEN {_OK2} THEN {B.strip(B.after('c.template_content'))} <> {B.strip(B.after('c.report'))} END AS impression_changed,
  CASE WHEN {_OK2} THEN coalesce(d.n,0) END AS edited_section_count
FROM cases c LEFT JOIN d ON d.case_id=c.case_id"""

_BLANK = "count(*) FILTER (WHERE " + B.strip("{0}") + "='') AS blank_{0}"
SQL["dataset_checks"] = f"""WITH {B.CASES}
SELECT count(*) AS rows, count(*)-count(DISTINCT case_id) AS duplicate_ids,
  {", ".join(_BLANK.format(c) for c in ("body_part","case_id","dictation","modality","template_content"))} FROM cases"""

SQL["contract_checks"] = """WITH c AS (SELECT lpad(CAST(doc_id AS VARCHAR),12,'0') AS id FROM documents),
s AS (SELECT lpad(CAST(doc_id AS VARCHAR),12,'0') AS id FROM labels),
m AS (SELECT id FROM c WHERE id NOT IN (SELECT id FROM s)), x AS (SELECT id FROM s WHERE id NOT IN (SELECT id FROM c))
SELECT 'cases' AS "check", (SELECT count(*) FROM c) AS found, '' AS sample
UNION ALL SELECT 'rows', (SELECT count(*) FROM s), ''
UNION ALL SELECT 'duplicates', (SELECT count(*)-count(DISTINCT id) FROM s), ''
UNION ALL SELECT 'missing', (SELECT count(*) FROM m), ''
UNION ALL SELECT 'extra', (SELECT count(*) FROM x), ''
UNION ALL SELECT 'missing_sample', NULL, coalesce((SELECT string_agg(id, ',' ORDER BY id) FROM (SELECT id FROM m ORDER BY id LIMIT 3)),'')
UNION ALL SELECT 'extra_sample', NULL, coalesce((SELECT string_agg(id, ',' ORDER BY id) FROM (SELECT id FROM x ORDER BY id LIMIT 3)),'')"""

_LOG = """log AS (
  SELECT event_id AS seq, lpad(CAST(user_id AS VARCHAR),12,'0') AS case_id, user_id AS row_index,
    CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'PENDING' ELSE 'SUCCESS' END AS status,
    CASE WHEN event_type='error' THEN '' WHEN event_type='view' THEN 'FINDINGS:'||chr(10)||'[x] '||props||chr(10)||'IMPRESSION:'||chr(10)||'ok'
      WHEN value<5 THEN ' '||chr(10) ELSE 'FINDINGS:'||chr(10)||props||chr(10)||'IMPRESSION:'||chr(10)||'ok' END AS report,
    CAST(regexp_extract(props,'[0-9]+') AS BIGINT) AS attempts, round(value,3) AS latency_seconds,
    CASE WHEN event_type='error' THEN 'TIMEOUT' END AS error_category,
    CASE WHEN event_type='error' THEN 'TimeoutError: '||props END AS error_message,
    strftime(ts,'%Y-%m-%dT%H:%M:%S') AS timestamp
  FROM events)"""

SQL["checkpoint_records"] = f"""WITH {_LOG}
SELECT seq, case_id, row_index, status, report, CASE WHEN seq%16=7 THEN 1 ELSE attempts END AS attempts,
  latency_seconds, error_category, timestamp FROM log WHERE status<>'PENDING' AND seq%16 NOT IN (3,5)"""

_STATE = f"""{_LOG},
ok AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY seq DESC) AS back,
  min(seq) OVER (PARTITION BY case_id) AS first_seq FROM log WHERE status<>'PENDING'),
state AS (SELECT * FROM ok WHERE back=1)"""

SQL["latest_state"] = f"""WITH {_STATE} SELECT case_id, seq, first_seq, status, report, attempts,
  latency_seconds, error_category, timestamp FROM state"""
SQL["state_counts"] = f"""WITH {_STATE} SELECT count(*) AS attempted,
  count(*) FILTER (WHERE status='SUCCESS') AS succeeded, count(*) FILTER (WHERE status='FAILED') AS failed FROM state"""
SQL["run_summary"] = f"""WITH {_LOG} SELECT count(*) FILTER (WHERE status='SUCCESS') AS succeeded,
  count(*) FILTER (WHERE status='FAILED') AS failed, CAST(sum(attempts) AS BIGINT) AS call_count
  FROM log WHERE status<>'PENDING'"""
_IDS = "ids AS (SELECT lpad(CAST(doc_id AS VARCHAR),12,'0') AS case_id, doc_id AS row_index FROM documents)"
SQL["resume_plan"] = f"""WITH {_STATE},{_IDS} SELECT case_id, row_index FROM ids
WHERE case_id NOT IN (SELECT case_id FROM state WHERE status='SUCCESS')"""
SQL["predictions_view"] = f"""WITH {_STATE},{_IDS} SELECT i.case_id, i.row_index, s.report FROM ids i
JOIN state s ON s.case_id=i.case_id WHERE s.status='SUCCESS'"""
SQL["failures_view"] = f"""WITH {_STATE} SELECT case_id, row_index, timestamp, coalesce(error_category,'') AS error_category,
  coalesce(error_message,'') AS error_message, attempts FROM state
WHERE status='FAILED' AND case_id IN (SELECT lpad(CAST(doc_id AS VARCHAR),12,'0') FROM documents)"""
SQL["submission_errors"] = f"""WITH {_STATE},{_IDS},
f AS (
  SELECT 0 AS part, i.row_index AS place, CASE WHEN s.status IS NULL THEN 'missing: '||i.case_id||' was never attempted'
    WHEN s.status<>'SUCCESS' THEN 'not succeeded: '||i.case_id||' has status '||s.status
    WHEN {B.strip('s.report')}='' THEN 'empty report: '||i.case_id
    WHEN {_QSPANS.format('s.report')}<>'' THEN 'bracketed text in report: '||i.case_id||' '||{_QSPANS.format('s.report')} END AS message
  FROM ids i LEFT JOIN state s ON s.case_id=i.case_id
  UNION ALL SELECT 2, 0, 'unexpected case_id(s) in state: ['||string_agg(chr(39)||case_id||chr(39), ', ' ORDER BY first_seq)||']'
  FROM (SELECT case_id, first_seq FROM state WHERE status='SUCCESS' AND case_id NOT IN (SELECT case_id FROM ids)
        ORDER BY first_seq LIMIT 5) HAVING count(*)>0),
r AS (SELECT row_number() OVER (ORDER BY part, place) AS rank, message FROM f WHERE message IS NOT NULL)
SELECT rank, message FROM r WHERE rank<=10
UNION ALL SELECT 11, '... and '||CAST(count(*)-10 AS VARCHAR)||' more issue(s)' FROM r HAVING count(*)>10"""

SQL["error_classes"] = """WITH e AS (
  SELECT ['MockFailure','InvalidModelOutput','TimeoutError','DeadlineExceeded','TooManyRequests','ClientError','ServerError',
    'ConnectionResetError','OSError','Unavailable','TemplateError','ValueError'][(length(event_type)+CAST(props->>'k' AS BIGINT))%12+1] AS name,
    [400,401,403,404,418,429,500,502,503,504][(CAST(props->>'k' AS BIGINT)//10)%10+1] AS status FROM events),
c AS (SELECT name, CAST(status AS BIGINT) AS status, CASE
  WHEN name='MockFailure' THEN 'MOCK' WHEN name='InvalidModelOutput' THEN 'INVALID_OUTPUT'
  WHEN name IN ('TimeoutError','DeadlineExceeded') THEN 'TIMEOUT' WHEN name='TooManyRequests' THEN 'RATE_LIMIT'
  WHEN name IN ('ClientError','ServerError') AND status<>418 THEN
    CASE WHEN status IN (401,403) THEN 'AUTH' WHEN status IN (400,404) THEN 'CONFIG' WHEN status=429 THEN 'RATE_LIMIT' ELSE 'TRANSIENT' END
  WHEN name IN ('ConnectionResetError','OSError','Unavailable') THEN 'TRANSIENT' ELSE 'GENERIC' END AS category FROM e)
SELECT name, status, category, count(*) AS events, category NOT IN ('AUTH','CONFIG') AS retryable FROM c GROUP BY ALL"""


def _round(x: str, digits: int) -> str:
    return f"CAST(printf('%.{digits}f', {x}) AS DOUBLE)"


def _routing(where: str = "") -> str:
    """CTEs by_group and by_term over the analysed cases."""
    return f"""
ra AS (SELECT * FROM analysis {where}),
rl AS (SELECT DISTINCT v.case_id, v.label FROM verdict v WHERE NOT v.same),
gt AS (SELECT modality||' / '||body_part AS signal, count(*) AS total FROM ra GROUP BY 1),
gp AS (SELECT a.modality||' / '||a.body_part AS signal, l.label, count(*) AS n FROM ra a JOIN rl l ON l.case_id=a.case_id GROUP BY 1,2),
gq AS (SELECT gp.signal, gp.label, {_round('CAST(n AS DOUBLE)/total', 4)} AS weight FROM gp JOIN gt ON gt.signal=gp.signal
  WHERE n>=3 AND CAST(n AS DOUBLE)/total>=0.25),
by_group AS (SELECT gt.signal, gq.label, gq.weight FROM gt LEFT JOIN gq ON gq.signal=gt.signal),
tw AS (SELECT case_id, unnest({B.tokens('dictation')}) AS term FROM ra),
tt AS (SELECT case_id, term FROM tw WHERE length(term)>=3 AND NOT list_contains({B.STOP_LIST}, term)),
tn AS (SELECT term, count(*) AS total FROM tt GROUP BY 1),
tp AS (SELECT tt.term, l.label, count(*) AS n FROM tt JOIN rl l ON l.case_id=tt.case_id GROUP BY 1,2),
tq AS (SELECT tp.term AS signal, tp.label, {_round('CAST(n AS DOUBLE)/total', 4)} AS weight FROM tp JOIN tn ON tn.term=tp.term
  WHERE total>=6 AND n>=3 AND CAST(n AS DOUBLE)/total>=0.25),
by_term AS (SELECT signal, label, weight FROM (
  SELECT *, row_number() OVER (PARTITION BY signal ORDER BY weight DESC, label) AS r FROM tq) WHERE r<=8)"""


SQL["routing_by_group"] = _A + "," + _routing() + " SELECT signal, label, weight FROM by_group"
SQL["routing_by_term"] = _A + "," + _routing() + " SELECT signal, label, weight FROM by_term"

_TRAINED = "WHERE row_index IN (SELECT doc_id FROM labels)"


def _candidates() -> str:
    """CTE cand(case_id, label, r) for the unlabelled cases."""
    eligible = (
        f"list_filter({B.tokens('dictation')}, lambda t: length(t)>=3 AND NOT list_contains({B.STOP_LIST}, t))[1:4]"
    )
    return f"""
todo AS (SELECT * FROM cases WHERE row_index NOT IN (SELECT doc_id FROM labels)),
sig AS (SELECT case_id, 'g' AS kind, modality||' / '||body_part AS signal FROM todo
  UNION ALL SELECT case_id, 't', unnest({eligible}) FROM todo),
hits AS (SELECT s.case_id, m.label, m.weight FROM sig s JOIN by_group m ON s.kind='g' AND m.signal=s.signal AND m.label IS NOT NULL
  UNION ALL SELECT s.case_id, m.label, m.weight FROM sig s JOIN by_term m ON s.kind='t' AND m.signal=s.signal),
best AS (SELECT h.case_id, h.label, max(h.weight) AS weight FROM hits h
  WHERE EXISTS (SELECT 1 FROM ts t WHERE t.case_id=h.case_id AND t.label=h.label) GROUP BY 1,2),
cand AS (SELECT * FROM (SELECT case_id, label,
  row_number() OVER (PARTITION BY case_id ORDER BY weight DESC, label) AS r FROM best) WHERE r<=8)"""


SQL["candidate_sections"] = _A + "," + _routing(_TRAINED) + "," + _candidates() + """
SELECT t.case_id, coalesce(string_agg(c.label, '|' ORDER BY c.r),'') AS candidates
FROM todo t LEFT JOIN cand c ON c.case_id=t.case_id GROUP BY 1"""


def _brute_force(queries: str, index: str, cand: str) -> str:
    """All pairs of two case sets with every signal (CTE pairs)."""
    toks = lambda c: f"list_distinct(list_filter({B.tokens(c)}, lambda t: NOT list_contains({B.STOP_LIST}, t)))"
    parts = lambda c: f"list_distinct(regexp_extract_all(lower({c}), '[a-z0-9]+'))"
    ji = lambda a, b: f"(CASE WHEN len({a})+len({b})=0 THEN 0 ELSE len(list_intersect({a},{b}))/(len({a})+len({b})-len(list_intersect({a},{b}))) END)"
    return f"""
feat AS (SELECT c.*, {toks('c.template_content')} AS words, {toks('c.dictation')} AS spoken,
    {parts('c.body_part')} AS bp,
    coalesce((SELECT list(label ORDER BY pos) FROM ts t WHERE t.case_id=c.case_id),[]) AS labels,
    coalesce((SELECT list(v.label) FROM verdict v WHERE v.case_id=c.case_id AND NOT v.same),[]) AS edited
  FROM cases c),
ix AS (SELECT * FROM feat c WHERE {_OK2} {index}),
qx AS (SELECT f.*, {cand} AS cands FROM feat f {queries}),
df AS (SELECT token, count(*) AS df FROM (SELECT unnest(spoken) AS token FROM ix) GROUP BY 1),
idf AS (SELECT token, pow(ln((1.0+(SELECT count(*) FROM ix))/(1.0+df))+1.0, 2) AS w FROM df),
qt AS (SELECT case_id, unnest(spoken) AS token FROM qx), it AS (SELECT case_id, unnest(spoken) AS token FROM ix),
qn AS (SELECT case_id, sqrt(sum(w)) AS n FROM qt JOIN idf ON idf.token=qt.token GROUP BY 1),
inn AS (SELECT case_id, sqrt(sum(w)) AS n FROM it JOIN idf ON idf.token=it.token GROUP BY 1),
qww AS (SELECT case_id, unnest(words) AS token FROM qx), iww AS (SELECT case_id, unnest(words) AS token FROM ix),
wsh AS (SELECT a.case_id AS q, b.case_id AS i, count(*) AS n FROM qww a JOIN iww b ON a.token=b.token GROUP BY 1,2),
dots AS (SELECT qt.case_id AS q, it.case_id AS i, sum(w) AS dot, count(*) AS n FROM qt JOIN it ON it.token=qt.token
  JOIN idf ON idf.token=qt.token GROUP BY 1,2),
pairs0 AS (
  SELECT q.case_id AS q, i.case_id AS i, q.modality=i.modality AS sm, lower(q.body_part)=lower(i.body_part) AS sb,
    {ji('q.bp','i.bp')} AS bj, {ji('q.labels','i.labels')} AS lj,
    CASE WHEN len(q.labels)+len(i.labels)=0 THEN 1.0
         ELSE 2.0*len(list_intersect(q.labels,i.labels))/(len(q.labels)+len(i.labels)) END AS lo,
    len(q.words) AS qw, len(i.words) AS iw, len(q.spoken) AS qs, len(i.spoken) AS isp,
    list_intersect(CASE WHEN len(q.cands)>0 THEN q.cands ELSE q.labels END, i.edited) AS e1,
    CASE WHEN len(q.cands)>0 THEN q.cands ELSE q.labels END AS e2
  FROM qx q JOIN ix i ON q.case_id<>i.case_id),
pairs1 AS (
  SELECT p.q, p.i, 0.4*lj+0.25*lo+0.35*(CASE WHEN qw+iw=0 THEN 0 ELSE coalesce(wsh.n,0)/(qw+iw-coalesce(wsh.n,0)) END) AS ts,
    CASE WHEN sm AND sb THEN 1.0 WHEN sm THEN 0.5+0.25*bj WHEN sb THEN 0.6 ELSE 0.25*bj END AS mb,
    round(0.5*coalesce(dot/(qn.n*inn.n),0)+0.5*(CASE WHEN qs+isp=0 THEN 0 ELSE coalesce(d.n,0)/(qs+isp-coalesce(d.n,0)) END), 12) AS ds,
    CASE WHEN len(e2)=0 THEN 0.0 ELSE len(e1)/len(e2) END AS er
  FROM pairs0 p LEFT JOIN dots d ON d.q=p.q AND d.i=p.i LEFT JOIN wsh ON wsh.q=p.q AND wsh.i=p.i LEFT JOIN qn ON qn.case_id=p.q LEFT JOIN inn ON inn.case_id=p.i),
pairs AS (SELECT *, CASE WHEN ts>=0.97 THEN 0 WHEN ts>=0.90 THEN 1 WHEN ts>=0.80 THEN 2 ELSE 3 END AS tier FROM pairs1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY tier, mb DESC, ds DESC, er DESC, i) AS rank FROM pairs)"""


_LABELLED = "AND c.row_index IN (SELECT doc_id FROM labels)"
_UNLABELLED = "WHERE f.row_index NOT IN (SELECT doc_id FROM labels)"
_CANDS = "coalesce((SELECT list(label ORDER BY r) FROM cand WHERE cand.case_id=f.case_id),[])"
_SPLIT = _A + "," + _routing(_TRAINED) + "," + _candidates() + "," + _brute_force(_UNLABELLED, _LABELLED, _CANDS)

SQL["retrieval_topk"] = _SPLIT + """
SELECT q AS case_id, rank, i AS match_id, CAST(tier AS BIGINT) AS tier, round(ts,6) AS template_similarity,
  CAST(round(mb,6) AS DOUBLE) AS modality_bodypart, round(ds,6) AS dictation_similarity,
  CAST(round(er,6) AS DOUBLE) AS edited_section_relevance,
  round((""" + "+".join(f"{w}*{c}" for c, w in zip(("ts", "mb", "ds", "er"), _WEIGHTS)) + f""")/{sum(_WEIGHTS)},6) AS score
FROM ranked WHERE rank<=3"""
SQL["retrieval_indexed"] = SQL["retrieval_topk"]
SQL["retrieval_self"] = _A + "," + _brute_force("", "", "CAST([] AS VARCHAR[])") + """
SELECT q AS case_id, i AS match_id, CAST(tier AS BIGINT) AS tier FROM ranked WHERE rank=1"""
SQL["near_templates"] = _SPLIT + """
SELECT q AS case_id, CAST(tier AS BIGINT) AS tier, count(*) AS matches FROM pairs WHERE tier<3 GROUP BY ALL"""
SQL["tfidf_norms"] = _A + "," + _brute_force("", "", "CAST([] AS VARCHAR[])") + """
SELECT case_id, round(n,6) AS norm FROM inn"""
SQL["modality_scores"] = f"""WITH {B.CASES},
q AS (SELECT DISTINCT modality, body_part FROM cases WHERE row_index NOT IN (SELECT doc_id FROM labels)),
i AS (SELECT DISTINCT modality, body_part FROM cases WHERE row_index IN (SELECT doc_id FROM labels)),
p AS (SELECT q.modality, q.body_part, i.modality AS index_modality, i.body_part AS index_body_part,
    regexp_extract_all(lower(q.body_part),'[a-z0-9]+') AS a, regexp_extract_all(lower(i.body_part),'[a-z0-9]+') AS b
  FROM q, i WHERE q.modality=i.modality OR lower(q.body_part)=lower(i.body_part)
    OR len(list_intersect(regexp_extract_all(lower(q.body_part),'[a-z0-9]+'), regexp_extract_all(lower(i.body_part),'[a-z0-9]+')))>0)
SELECT modality, body_part, index_modality, index_body_part, round(CASE
  WHEN modality=index_modality AND lower(body_part)=lower(index_body_part) THEN 1.0
  WHEN modality=index_modality THEN 0.5+0.25*len(list_intersect(a,b))/(len(a)+len(b)-len(list_intersect(a,b)))
  WHEN lower(body_part)=lower(index_body_part) THEN 0.6
  ELSE 0.25*len(list_intersect(a,b))/(len(a)+len(b)-len(list_intersect(a,b))) END, 6) AS score FROM p"""

_TASK = (
    "'TEMPLATE SECTION LABELS (use exactly these keys in findings_edits):'||chr(10)||"
    "coalesce((SELECT string_agg('- '||label, chr(10) ORDER BY pos) FROM ts t WHERE t.case_id=c.case_id),'- FINDINGS')"
    "||chr(10)||chr(10)||'TEMPLATE_CONTENT:'||chr(10)||c.template_content||chr(10)||chr(10)||'DICTATION:'||chr(10)||c.dictation"
)
_HINT = (
    "coalesce((SELECT chr(10)||'CANDIDATE SECTIONS TO CONSIDER (suggested by training data — a HINT only, not a restriction):'"
    "||chr(10)||string_agg('- '||label, chr(10) ORDER BY r) FROM cand WHERE cand.case_id=c.case_id HAVING count(*)>0),'')"
)
SQL["prompt_turns"] = _A + "," + _routing(_TRAINED) + "," + _candidates() + f""",
p AS (SELECT c.case_id, {_TASK}||{_HINT} AS text FROM todo c WHERE {B.valid('c.template_content')})
SELECT case_id, CAST(2 AS BIGINT) AS turn, 'user' AS role, text FROM p
UNION ALL SELECT case_id, 0, 'user', 'TEMPLATE SECTION LABELS (use exactly these keys in findings_edits):'||chr(10)||'- BONES'
  ||chr(10)||chr(10)||'TEMPLATE_CONTENT:'||chr(10)||'FINDINGS:'||chr(10)||'BONES: Normal.'||chr(10)||chr(10)||'IMPRESSION:'||chr(10)||'Normal.'
  ||chr(10)||chr(10)||'DICTATION:'||chr(10)||'broken' FROM p
UNION ALL SELECT case_id, 1, 'model', '{{'||chr(10)||'  "findings_edits": {{'||chr(10)||'    "BONES": "Broken."'||chr(10)||'  }},'
  ||chr(10)||'  "impression": null'||chr(10)||'}}' FROM p"""

_JS = "CAST(to_json({}) AS VARCHAR)"
SQL["example_turns"] = _DERIVED + f""",
js AS (SELECT case_id, string_agg('    '||{_JS.format('label')}||': '||{_JS.format('body')}, ','||chr(10) ORDER BY pos) AS body
  FROM kept GROUP BY case_id),
p AS (SELECT c.case_id, 'REAL TRAINING EXAMPLE 1'||chr(10)||chr(10)||{_TASK} AS task,
  '{{'||chr(10)||'  "findings_edits": '||coalesce('{{'||chr(10)||js.body||chr(10)||'  }}','{{}}')||','||chr(10)||'  "impression": '
  ||coalesce({_JS.format('i.impression')},'null')||chr(10)||'}}' AS answer
  FROM cases c JOIN imp i ON i.case_id=c.case_id LEFT JOIN js ON js.case_id=c.case_id
  WHERE c.row_index IN (SELECT doc_id FROM labels))
SELECT case_id, CAST(0 AS BIGINT) AS turn, 'user' AS role, task AS text FROM p
UNION ALL SELECT case_id, 1, 'model', answer FROM p"""

SQL["retrieval_prompts"] = (
    _DERIVED + "," + _routing(_TRAINED) + "," + _candidates() + "," + _brute_force(_UNLABELLED, _LABELLED, _CANDS) + f""",
js AS (SELECT case_id, string_agg('    '||{_JS.format('label')}||': '||{_JS.format('body')}, ','||chr(10) ORDER BY pos) AS body
  FROM kept GROUP BY case_id),
shown AS (SELECT r.q, r.rank, 'REAL TRAINING EXAMPLE '||r.rank||chr(10)||chr(10)||{_TASK} AS task,
  '{{'||chr(10)||'  "findings_edits": '||coalesce('{{'||chr(10)||js.body||chr(10)||'  }}','{{}}')||','||chr(10)||'  "impression": '
  ||coalesce({_JS.format('i.impression')},'null')||chr(10)||'}}' AS answer
  FROM ranked r JOIN cases c ON c.case_id=r.i JOIN imp i ON i.case_id=c.case_id LEFT JOIN js ON js.case_id=c.case_id
  WHERE r.rank<=3),
asked AS (SELECT c.case_id, {_TASK}||{_HINT} AS text FROM todo c WHERE {B.valid('c.template_content')})
SELECT a.case_id, CAST(2*(s.rank-1) AS BIGINT) AS turn, 'user' AS role, s.task AS text FROM asked a JOIN shown s ON s.q=a.case_id
UNION ALL SELECT a.case_id, 2*(s.rank-1)+1, 'model', s.answer FROM asked a JOIN shown s ON s.q=a.case_id
UNION ALL SELECT a.case_id, 2*(SELECT count(*) FROM shown s WHERE s.q=a.case_id), 'user', a.text FROM asked a"""
)

# each range of two label lists is split at its longest common block, earliest first, until none is left;
# the width of a block goes to the range before it
_BLOCK = """list_sort(list_filter(flatten(list_transform(range(alo, ahi), lambda i: list_transform(range(blo, bhi),
  lambda j: struct_pack(k := coalesce(list_max(list_filter(range(1, least(ahi-i, bhi-j)+1),
    lambda n: a[i+1:i+n]=b[j+1:j+n])), 0), i := -i, j := -j)))), lambda x: x.k>0))[-1]"""
_LABELS = "coalesce((SELECT list(label ORDER BY pos) FROM {0} WHERE {0}.case_id=c.case_id), CAST([] AS VARCHAR[]))"
SQL["label_order_ratio"] = f"""WITH RECURSIVE {B.CASES},{B.sections('ts','template_content')},{B.sections('rs','report')},
p AS (SELECT a, b, count(*) AS cases FROM (SELECT {_LABELS.format('ts')} AS a, {_LABELS.format('rs')} AS b FROM cases c
  WHERE {B.valid('template_content')} AND {B.valid('report')}) GROUP BY a, b),
steps AS (
  SELECT a, b, CAST(0 AS BIGINT) AS alo, len(a) AS ahi, CAST(0 AS BIGINT) AS blo, len(b) AS bhi, CAST(0 AS BIGINT) AS width FROM p
  UNION ALL
  SELECT a, b, r.alo, r.ahi, r.blo, r.bhi, r.width FROM (
    SELECT a, b, unnest([struct_pack(alo := alo, ahi := -m.i, blo := blo, bhi := -m.j, width := m.k),
      struct_pack(alo := m.k-m.i, ahi := ahi, blo := m.k-m.j, bhi := bhi, width := CAST(0 AS BIGINT))]) AS r
    FROM (SELECT *, {_BLOCK} AS m FROM steps WHERE alo<ahi AND blo<bhi) WHERE m IS NOT NULL)),
matched AS (SELECT a, b, sum(width) AS n FROM steps GROUP BY a, b)
SELECT array_to_string(a, '|') AS template, array_to_string(b, '|') AS report, cases,
  CASE WHEN len(a)+len(b)=0 THEN 1.0 ELSE 2.0*CAST(n AS DOUBLE)/(len(a)+len(b)) END AS ratio
FROM p JOIN matched USING (a, b)"""

_FAIL = "'InvalidModelOutput: '||"
SQL["parse_model_json"] = _DERIVED + f""",
hit AS (SELECT case_id, arg_min(label, pos) AS label FROM kept WHERE contains(body, ' Measures') GROUP BY 1),
odd AS (SELECT case_id, bool_or(contains({_JS.format('label')}||{_JS.format('body')}, 'null')) AS nulls FROM kept GROUP BY 1),
f AS (SELECT i.case_id, CASE c.row_index % 8
    WHEN 2 THEN {_FAIL}'not valid JSON'
    WHEN 3 THEN {_FAIL}'unexpected in answer: conclusion'
    WHEN 4 THEN CASE WHEN i.impression IS NULL THEN {_FAIL}'impression must be string or null' END
    WHEN 5 THEN coalesce({_FAIL}'block header inside '||h.label,
      CASE WHEN contains(i.impression, ' Measures') THEN {_FAIL}'block header inside impression' END)
    WHEN 6 THEN {_FAIL}'empty response' END AS error, c.row_index % 8 = 4 AND coalesce(o.nulls, false) AS changed
  FROM imp i JOIN cases c ON c.case_id=i.case_id LEFT JOIN hit h ON h.case_id=i.case_id LEFT JOIN odd o ON o.case_id=i.case_id)
SELECT case_id, error, CASE WHEN error IS NULL THEN NOT changed END AS same_edits FROM f"""
