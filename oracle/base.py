"""Common table expressions shared by the oracle statements (DuckDB dialect)."""

from __future__ import annotations

import re

from redline import constants as K

_WS_POINTS = (
    [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680]
    + list(range(0x2000, 0x200B)) + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
WS = "(" + "||".join(f"chr({p})" for p in _WS_POINTS) + ")"
WS_RE = "'[" + "".join(f"\\x{{{p:x}}}" for p in _WS_POINTS) + "]+'"
NL = "chr(10)"
HEADER = r"'^([A-Za-z][A-Za-z0-9 &/\-()]+):'"
STOP_LIST = "[" + ",".join(f"'{w}'" for w in sorted(K.STOP_WORDS)) + "]"
TOKENS4 = "['[left/right]','[left/right/bilateral]','[_laterality_]','[generic]']"
TOKENS3 = "['[left/right]','[left/right/bilateral]','[_laterality_]']"


def strip(e: str) -> str:
    return f"trim({e}, {WS})"


def norm(e: str) -> str:
    return f"regexp_replace(lower({strip(f'coalesce({e}, chr(0)||chr(0))')}), {WS_RE}, ' ', 'g')".replace(
        "chr(0)||chr(0)", "''"
    )


def nl_trim(e: str) -> str:
    return f"trim({e}, {NL})"


def tokens(e: str) -> str:
    """Suffix [a-z0-9]{2,} of every word run."""
    runs = rf"regexp_extract_all(lower({e}), '[\p{{L}}\p{{N}}_]+')"
    return (
        f"list_filter(list_transform({runs}, lambda w: regexp_extract(w, '[a-z0-9]{{2,}}$')),"
        " lambda w: w <> '')"
    )


_VOCAB = "['LUNGS','PLEURAL SPACES','HEART','MEDIASTINUM/HILA','L1-L2','SOFT TISSUES (DEEP)','BONES & JOINTS','OTHER FINDINGS']"
_LABEL = f"({_VOCAB}[(i-1)%8+1] || CASE WHEN i>8 THEN ' ' || CAST((i-1)//8+1 AS VARCHAR) ELSE '' END)"
_HEAD = "CASE WHEN num%10=0 THEN '' ELSE {} || CASE WHEN num%10=4 THEN ':'||chr(10) ELSE ': ' END END"
_MARKED = (
    "(CASE WHEN i=1 THEN CASE num%10 WHEN 2 THEN '[left/right] ' WHEN 5 THEN '[ and stable] ' "
    "WHEN 6 THEN '[left/right/bilateral] ' ELSE '' END ELSE '' END || l)"
)
_SPOKEN = "(lines[len(lines)+1-i] || ' Measures ' || CAST(doc_id%90+i AS VARCHAR) || '.5 mm.')"
_KIND = "((doc_id+3*i)%12)"
_H = "(" + _HEAD.format(_LABEL) + ")"
_HM = "(" + _HEAD.format("('MOVED ' || CAST(i AS VARCHAR))") + ")"


def _joined(items: str) -> str:
    two, one = (f"array_to_string({items}, {s})" for s in ("chr(10)||chr(10)", "chr(10)"))
    return f"coalesce(CASE WHEN num%10=4 THEN {two} ELSE {one} END, '')"



def cases_sql(where: str = "") -> str:
    return f"""
base0 AS (
  SELECT doc_id, lang, source, n_chars,
    coalesce(TRY_CAST(regexp_extract(source,'[0-9]+') AS INT),0) AS num,
    list_filter(string_split(text, chr(10)), lambda s: {strip('s')} <> '') AS lines
  FROM documents d {where}),
base1 AS (
  SELECT *, CASE num%10 WHEN 3 THEN 'Normal [generic] spine. '
                        WHEN 5 THEN 'Seen in the [_laterality_] part. ' ELSE '' END
            || coalesce(lines[-1],'') AS conclusion,
    {_joined(f"list_transform(lines, lambda l, i: {_H} || {_MARKED})")} AS parts,
    {_joined(f"""flatten(list_transform(lines, lambda l, i:
      CASE WHEN {_KIND}<=2 THEN [{_H} || {_SPOKEN}]
           WHEN {_KIND}=3 AND i>1 THEN CAST([] AS VARCHAR[])
           WHEN {_KIND}=4 THEN [{_HM} || {_MARKED}]
           WHEN {_KIND}=5 THEN [{_H} || replace({_MARKED},' ','  ')]
           WHEN {_KIND}=6 THEN [{_H} || {_MARKED}, {_H} || 'Again ' || l]
           ELSE [{_H} || {_MARKED}] END))""")} AS new_parts,
    coalesce(array_to_string(list_filter(list_transform(lines, lambda l, i:
      CASE WHEN {_KIND}<=2 THEN {_SPOKEN} END), lambda s: s IS NOT NULL), ' '),'') AS words
  FROM base0),
base2 AS (
  SELECT *, CASE WHEN num%10=1 THEN 'GROUP: '||chr(10) ELSE '' END AS grp,
    CASE WHEN doc_id%15=7 THEN '' WHEN doc_id%3=0 THEN conclusion||' Stable since prior.'
         WHEN doc_id%3=2 THEN '  '||conclusion||' '||chr(10) ELSE conclusion END AS new_conclusion
  FROM base1),
base3 AS (
  SELECT *, 'FINDINGS:'||chr(10)||grp||new_parts||chr(10)||chr(10)||'IMPRESSION:'||chr(10)||new_conclusion AS rep
  FROM base2),
cases AS (
  SELECT doc_id AS row_index, lpad(CAST(doc_id AS VARCHAR),12,'0') AS case_id,
    upper(lang) AS modality,
    source || [' spine',' joint',' bone',' region',''][num%5+1] AS body_part,
    CASE WHEN num=19 THEN 'FINDINGS' ELSE 'FINDINGS:' END || chr(10) || grp || parts || chr(10)||chr(10)
      ||'IMPRESSION:'||chr(10)||conclusion
      || CASE WHEN num=18 AND doc_id%5=0 THEN chr(10)||'IMPRESSION: again' ELSE '' END AS template_content,
    CASE WHEN words='' THEN 'norml' ELSE words END
      || [' left',' left and right',' bilateral leftover',' Right side, right_ Right',''][doc_id%5+1]
      || CASE WHEN doc_id%4=0 THEN ' Size 12.5 cm and 120 mmHg.' ELSE '' END AS dictation,
    CASE WHEN doc_id%2=0 THEN replace(replace(replace(replace(rep,'[left/right]','left'),
      '[left/right/bilateral]','right'),'[_laterality_]','left'),'[generic]','lumbar') ELSE rep END AS report
  FROM base3)"""


CASES = cases_sql()
TRAIN = cases_sql("WHERE doc_id IN (SELECT doc_id FROM labels)")
TEST = cases_sql("WHERE doc_id NOT IN (SELECT doc_id FROM labels)")


def renamed(ctes: str, prefix: str) -> str:
    """The case CTEs under another prefix, for two sets in one statement."""
    return re.sub(r"\b(base[0-3]|cases)\b", lambda m: prefix + m.group(1), ctes)


def valid(c: str) -> str:
    return f"(starts_with({c},'FINDINGS:') AND length({c})-length(replace({c},'IMPRESSION:',''))=11)"


def region(c: str) -> str:
    return f"substr({c}, 10, strpos({c},'IMPRESSION:')-10)"


def after(c: str) -> str:
    return f"substr({c}, strpos({c},'IMPRESSION:')+11)"


def sections(name: str, column: str, source: str = "cases") -> str:
    """CTE ``name``(case_id,pos,label,body,st,en) from the lines of a text column."""
    return f"""
{name}_l AS (
  SELECT case_id, unnest(string_split({region(column)}, chr(10))) AS line,
    generate_subscripts(string_split({region(column)}, chr(10)), 1) - 1 AS i
  FROM {source} WHERE {valid(column)}),
{name}_s AS (
  SELECT *, sum(CASE WHEN regexp_matches(line, {HEADER}) THEN 1 ELSE 0 END)
    OVER (PARTITION BY case_id ORDER BY i) AS sid FROM {name}_l),
{name}_e AS (
  SELECT case_id, sid, min(i) AS st, max(i) FILTER (WHERE line <> '') + 1 AS en
  FROM {name}_s WHERE sid > 0 GROUP BY ALL),
{name}_h AS (
  SELECT e.*, regexp_extract(s.line, {HEADER}, 1) AS label, s.line AS header
  FROM {name}_e e JOIN {name}_s s ON s.case_id=e.case_id AND s.i=e.st),
{name}_f AS (
  SELECT s.case_id, s.sid, string_agg(s.line, chr(10) ORDER BY s.i) AS following
  FROM {name}_s s JOIN {name}_e e ON s.case_id=e.case_id AND s.sid=e.sid AND s.i>e.st AND s.i<e.en
  GROUP BY ALL),
{name} AS (
  SELECT h.case_id, CAST(h.sid AS BIGINT) - 1 AS pos, h.label, h.st, h.en,
    trim(CASE WHEN {strip('substr(h.header, length(h.label)+2)')} = '' THEN coalesce(f.following,'')
         ELSE concat_ws(chr(10), ltrim(substr(h.header, length(h.label)+2), {WS}), f.following) END,
         chr(10)) AS body
  FROM {name}_h h LEFT JOIN {name}_f f ON f.case_id=h.case_id AND f.sid=h.sid)"""


def last_body(name: str) -> str:
    """CTE ``name``u(case_id,label,pos,body): one row per label, last body, first position."""
    return f"""
{name}u AS (
  SELECT case_id, label, min(pos) AS pos, arg_max(body, pos) AS body FROM {name} GROUP BY case_id, label)"""


def classified() -> str:
    """CTE ``verdict``(case_id,label,pos,same) and ``extra``(case_id,pos,label)."""
    return f"""
both_ok AS (SELECT case_id, {region('report')} AS rregion FROM cases
  WHERE {valid('template_content')} AND {valid('report')}),
verdict AS (
  SELECT t.case_id, t.label, t.pos,
    CASE WHEN r.label IS NOT NULL THEN {norm('t.body')} = {norm('r.body')}
         ELSE {norm('t.body')} = '' OR contains({norm('b.rregion')}, {norm('t.body')}) END AS same
  FROM tsu t JOIN both_ok b ON b.case_id=t.case_id
  LEFT JOIN rsu r ON r.case_id=t.case_id AND r.label=t.label),
extra AS (
  SELECT r.case_id, r.pos, r.label FROM rs r JOIN both_ok b ON b.case_id=r.case_id
  WHERE NOT EXISTS (SELECT 1 FROM ts t WHERE t.case_id=r.case_id AND t.label=r.label))"""


def analysis() -> str:
    """CTE ``analysis``: one row per case with counts and flags."""
    ok = f"({valid('c.template_content')} AND {valid('c.report')})"
    return f"""{CASES},{sections('ts','template_content')},{sections('rs','report')},
{last_body('ts')},{last_body('rs')},{classified()},
vcount AS (
  SELECT case_id, count(*) FILTER (WHERE NOT same) AS edited, count(*) FILTER (WHERE same) AS unchanged,
    coalesce(string_agg(label, '|' ORDER BY pos) FILTER (WHERE NOT same),'') AS edited_labels,
    coalesce(string_agg(label, '|' ORDER BY pos) FILTER (WHERE same),'') AS unchanged_labels
  FROM verdict GROUP BY case_id),
xcount AS (SELECT case_id, string_agg(label, '|' ORDER BY pos) AS added_labels FROM extra GROUP BY case_id),
tcount AS (SELECT case_id, count(*) AS sections FROM ts GROUP BY case_id),
analysis AS (
  SELECT c.row_index, c.case_id, c.modality, c.body_part, c.dictation, {ok} AS parsed,
    {ok} AND {norm(region('c.template_content'))} <> {norm(region('c.report'))} AS findings_changed,
    {ok} AND {norm(after('c.template_content'))} <> {norm(after('c.report'))} AS impression_changed,
    NOT {ok} OR t.sections IS NOT NULL AS sectioned,
    CASE WHEN {ok} THEN coalesce(t.sections,0) ELSE 0 END AS sections,
    coalesce(v.edited,0) AS edited, coalesce(v.unchanged,0) AS unchanged,
    coalesce(v.edited_labels,'') AS edited_labels, coalesce(v.unchanged_labels,'') AS unchanged_labels,
    coalesce(x.added_labels,'') AS added_labels,
    CASE WHEN {ok} THEN list_filter({TOKENS4}, lambda p: contains(c.template_content, p)) ELSE [] END AS ph,
    CASE WHEN {ok} THEN list_filter({TOKENS4}, lambda p: contains(c.template_content, p) AND contains(c.report, p))
      ELSE [] END AS unresolved
  FROM cases c LEFT JOIN vcount v ON v.case_id=c.case_id LEFT JOIN xcount x ON x.case_id=c.case_id
  LEFT JOIN tcount t ON t.case_id=c.case_id)"""
