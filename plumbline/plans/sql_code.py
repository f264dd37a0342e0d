"""SQL of the code-sample operators, built from the same vocabularies; every text-only step is done once a template."""

from __future__ import annotations

from ..functions import vocab
from ..sources.fixtures import CODE_SQL, PROMPT_IDS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(c: str, p: str, ci: bool = False) -> str:
    """regexp_matches for a pattern that both engines know; look-aheads are handled by `lookahead`."""
    return f"regexp_matches({c}, {q(('(?i)' if ci else '') + p)})"


def rule_match(c: str, p: str) -> str:
    if "(?!" not in p:
        return rx(c, p, True)
    # The pattern occurs outside what the look-ahead excludes, if it still does with that cut out.
    head, excluded = p[: p.index("(?!")], p[p.index("(?!") + 3 : -1]
    cut = f"regexp_replace({c}, {q('(?i)http://(' + excluded + ')')}, '', 'g')"
    return rx(cut, head, True)


def joined(items: list[str]) -> str:
    return "array_to_string(list_sort(list_filter([" + ", ".join(items) + "], lambda x: x is not null)), ',')"


IMPORTS = "list_sort(list_distinct(regexp_extract_all(code, '(?m)^\\s*(?:from|import)\\s+([a-zA-Z_]\\w*)', 1)))"
DESIGN = joined([f"case when {rx('code', p)}" + (f" and not {rx('code', vocab.DESIGN_PATTERNS[0][1])}" if n == "function_based" else "") + f" then {q(n)} end" for n, p in vocab.DESIGN_PATTERNS])
STORAGE = (
    "case when list_has_any(imports, ['sqlite3', 'sqlalchemy']) then 'sqlite' when list_contains(imports, 'shelve') then 'shelve' when list_contains(imports, 'pickle') then 'pickle' "
    "when list_contains(imports, 'csv') then 'csv' when list_contains(imports, 'json') and regexp_matches(lower(code), '\\.json[''\"]|json\\.dump|json\\.load') then 'json_file' "
    "when regexp_matches(lower(code), '\\bopen\\([^\\)]+[''\"][rwab+]+[''\"]') then 'plain_file' when list_contains(imports, 'redis') then 'redis' else 'in_memory' end"
)
INTERFACE = "case " + " ".join(f"when {rx('code', p)} then {q(n)}" for n, p in vocab.INTERFACES) + " else 'library' end"


def _algorithms() -> str:
    def test(w: str) -> str:
        kind, _, rest = w.partition(":")
        return {"re": lambda: rx("code", rest.replace(r"[\s\S]{0,200}", r"[\s\S]{0,200}")), "imp": lambda: f"list_contains(imports, {q(rest)})", "raw": lambda: f"contains(code, {q(rest)})"}.get(kind, lambda: f"contains(lower(code), {q(w)})")()

    out = "case prompt "
    for pid, tags in vocab.ALGORITHM_TAGS.items():
        items = [f"case when {' or '.join('(' + ' and '.join(map(test, words)) + ')' for words in alts)} then {q(n)} end" for n, alts in tags.items()]
        if pid == "OD-01":
            items.append("'data_struct=' || case when contains(lower(code), 'ordereddict') then 'ordereddict' when contains(lower(code), 'heapq') then 'heap' else 'dict' end")
        out += f"when {q(pid)} then {joined(items)} "
    return out + "else '' end"


ALGORITHMS = _algorithms()
LINES = "lines as (select k, code, unnest(string_split(code, chr(10))) as l, generate_subscripts(string_split(code, chr(10)), 1) as line from texts)"
_RULES = ", ".join(
    f"({r}, {i}, {q('CWE-' + str(int(cwe[4:])))}, {q(name)})" for r, (cwe, name, patterns) in enumerate(vocab.WEAKNESS_RULES) for i in range(len(patterns))
)
_HITS = " union all ".join(
    f"select k, {r} as r, {i} as i, min(line) as line from lines where not starts_with(ltrim(l, ' ' || chr(9)), '#') and {rule_match('l', p)}"
    + (f" and not {rx('code', vocab.RULE_EXCLUDED_BY[cwe])}" if cwe in vocab.RULE_EXCLUDED_BY else "") + " group by k"
    for r, (cwe, _, patterns) in enumerate(vocab.WEAKNESS_RULES) for i, p in enumerate(patterns)
)
SEVERITIES = "severities(cwe, severity) as (values " + ", ".join(f"('CWE-{k}', {v}::double)" for k, v in vocab.SEVERITY.items()) + ")"
SINK = (
    "case when regexp_matches(matched, '^([\\w.]+\\s*\\()(.*)') then regexp_extract(matched, '^([\\w.]+\\s*\\()', 1) || '...' || "
    "case when len(h) > 0 then ',' || array_to_string(h, ',') else '' end || ')' else substr(matched, 1, 80) end"
)
#: found: one row for each template and weakness class, as scan() gives them.
FOUND = f"""{LINES},
rules(r, i, cwe, rule) as (values {_RULES}),
hits as ({_HITS}),
best as (select k, r, arg_min(line, i) as line from hits group by k, r),
placed as (select b.k, b.r, b.line, c.cwe, c.rule, substr(regexp_replace(l.l, '^\\s+|\\s+$', '', 'g'), 1, 120) as matched
  from best b join (select distinct r, cwe, rule from rules) c using (r) join lines l on l.k = b.k and l.line = b.line),
hinted as (select *, regexp_extract(matched, '^([\\w.]+\\s*\\()(.*)', 2) as tail from placed),
found as (select k, r, line, cwe, rule, matched, {SINK} as sink, coalesce(severity, 5.0) as severity
  from (select *, list_filter([case when contains(tail, 'shell=True') then 'shell=True' end, case when regexp_matches(tail, '^\\s*f[''"]') then 'f-string' end,
    case when regexp_matches(tail, '%\\s*[sd]') then '%-format' end, case when contains(tail, '.format(') then '.format()' end], lambda x: x is not null) as h from hinted) left join severities using (cwe)),
sigs as (select t.k, coalesce(string_agg(distinct cwe || '@' || sink, ';' order by cwe || '@' || sink), '') as sig, coalesce(string_agg(distinct cwe, ',' order by cwe), '') as cwes,
  count(f.k) > 0 as vulnerable, coalesce(sum(severity), 0) as total from texts t left join found f using (k) group by t.k)"""
SCAN_SQL = f"with {CODE_SQL},\n{SEVERITIES},\n{FOUND},\nscanned as (select c.*, s.sig, s.cwes, s.vulnerable, s.total from code c join sigs s using (k))\n"
FEATURES_SQL = f"with {CODE_SQL},\nimported as (select *, {IMPORTS} as imports from texts),\nfeatures as (select k, code, imports, {DESIGN} as tags, {STORAGE} as storage, {INTERFACE} as interface from imported)\n"
PROMPTS = "[" + ", ".join(map(q, PROMPT_IDS)) + "]"
