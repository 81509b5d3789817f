"""Scan of every file for risky text: counts by rule, comments, folded text, profiles and classes of lines."""

from __future__ import annotations

from ..functions.dialect import Dialect
from ..functions.rules import BIDI, DIRECTIVE, ESCAPES, INVISIBLE, LICENSE_FILES, LICENSES, TAGS, alike, ascii_classes, confusables, java, rules
from .findings import _matches

FENCE = "(?m)^```[^\n]*\n(?s:.*?)^```"
COMMENT = "<!--((?s:.*?))-->"


def _pattern(d: Dialect, own: str, re2: str) -> str:
    return own if d.name == "spark" else re2


def _edges(d: Dialect, pattern: str) -> str:
    """A pattern whose \\b are ASCII in either engine."""
    return _pattern(d, java(pattern), pattern)


def _counts(d: Dialect, surface: str) -> list[str]:
    return [f"{d.count('text', _pattern(d, j, r))} AS {c.lower().replace('-', '_')}" for c, _, s, j, r in rules() if s == surface]


def scan_1_instructions(d: Dialect) -> str:
    """Matches of each instruction rule in each file."""
    return f"SELECT skill, path, {', '.join(_counts(d, 'text'))} FROM @file"


def scan_1_offsets(d: Dialect) -> str:
    """Every match of every instruction rule with its line and column, in code points."""
    return "SELECT skill, path, code, sev, line, col, evidence FROM @rule_finding WHERE code LIKE 'INSTR-%'"


def scan_2_execution(d: Dialect) -> str:
    """Matches of each execution rule that begin in code: in all of a code file, in closed fences of others."""
    return "SELECT skill, path, code, count(*) AS n, min(line) AS first_line FROM @rule_finding WHERE code LIKE 'EXEC-%' GROUP BY skill, path, code"


def scan_3_folded(d: Dialect) -> str:
    """Files where a rule matches only after look-alike letters are folded to ASCII."""
    table = confusables()
    folded = f"translate(text, {d.text(''.join(table))}, {d.text(''.join(table.values()))})"
    only = " + ".join(f"CASE WHEN {d.like('folded', _pattern(d, j, r))} AND NOT {d.like('text', _pattern(d, j, r))} THEN 1 ELSE 0 END" for _, _, _, j, r in rules())
    return f"SELECT skill, path, folded <> text AS has_lookalikes, CASE WHEN folded <> text THEN {only} ELSE 0 END AS disguised FROM (SELECT skill, path, text, {folded} AS folded FROM @file) AS f"


def _comments(d: Dialect, source: str, columns: str) -> str:
    case = " ".join(f"WHEN {d.like('inner_', _pattern(d, j, r))} THEN '{c}'" for c, _, _, j, r in rules())
    word = _edges(d, ascii_classes(DIRECTIVE))
    each = d.exploded(source if d.name == "duckdb" else f"{source} AS s", d.all("text", COMMENT, 1), columns, "inner_")
    return f"SELECT {columns}, pos, length(inner_) AS length, CASE {case} WHEN {d.like('inner_', word)} THEN 'directive' ELSE 'plain' END AS what FROM ({each}) AS c"


def scan_6_html_comments(d: Dialect) -> str:
    """Comments of pages and files: hostile (the first rule in order), directive, or plain."""
    return _comments(d, "(SELECT concat('page-', page_id) AS id, html AS text FROM @pages UNION ALL SELECT concat(skill, '/', path), text FROM @file)", "id")


def scan_8_escape_runs(d: Dialect) -> str:
    return f"SELECT skill, path, {d.count('text', ESCAPES)} AS runs FROM @file"


#: Lines with their fence state: fenced, by the parity of fence marks before.
_LINES = """SELECT skill, path, pos, line, sum(CASE WHEN line LIKE '```%' THEN 1 ELSE 0 END) OVER (PARTITION BY skill, path ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS marks FROM @line"""


#: Control characters but tab, line feed and carriage return; fixed values.
CONTROL = r"[\x{0000}-\x{0008}\x{000B}\x{000C}\x{000E}-\x{001F}\x{007F}-\x{009F}]"


def scan_14_char_profile(d: Dialect) -> str:
    """Characters of each class in each document and page, each in the first class that has it, and the longest line."""
    longest = "cast(array_max(transform(split(text, '\\n'), x -> length(x))) as bigint)" if d.name == "spark" else "cast(list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) as bigint)"
    n = {"control": CONTROL, "invisible": INVISIBLE, "bidi": BIDI, "tags": TAGS, "confusable": alike(d.name == "spark")[1], "wide": r"[^\x{0000}-\x{007F}]", "high": r"[\x{0080}-\x{009F}]"}
    counts = ", ".join(f"{d.count('text', p)} AS {k}" for k, p in n.items())
    texts = "SELECT concat('doc-', doc_id) AS id, text FROM @documents UNION ALL SELECT concat('page-', page_id), html FROM @pages UNION ALL SELECT concat(skill, '/', path), text FROM @scanned WHERE path <> 'SKILL.md'"
    return f"SELECT id, control, invisible, bidi, tags, confusable, wide - invisible - bidi - tags - confusable - high AS other, longest_line FROM (SELECT id, {counts}, {longest} AS longest_line FROM ({texts}) AS t) AS c"


def scan_15_line_classes(d: Dialect) -> str:
    """How many lines of each class every file has, and how many of them hold part of a comment.

    Only markdown has classes: frontmatter, if the first line opens it, until
    the next rule; fences, by pairs of marks, an open one to the end; headings.
    Comments go on over lines until they are closed.
    """
    md = "path LIKE '%.md'"
    lines = d.exploded("@scanned", d.split(d.sub("text", r"\n\z", ""), "\n"), "skill, path", "line")
    over = "OVER (PARTITION BY skill, path ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    ends = f"SELECT skill, path, pos, line, max(CASE WHEN pos = 0 AND line = '---' THEN 1 ELSE 0 END) {over} = 1 AND coalesce(sum(CASE WHEN pos > 0 AND line = '---' THEN 1 ELSE 0 END) {over}, 0) = 0 OR (pos = 0 AND line = '---') AS front FROM ({lines}) AS l"
    mark = d.like("line", r"^[ \t\r\n\f\v]*(```|~~~)")
    marks = f"SELECT skill, path, pos, line, coalesce(front, false) AS front, coalesce(sum(CASE WHEN NOT coalesce(front, false) AND {mark} THEN 1 ELSE 0 END) {over}, 0) % 2 = 1 AS fenced FROM ({ends}) AS e"
    kind = f"CASE WHEN NOT {md} THEN 'plain' WHEN front THEN 'frontmatter' WHEN fenced OR {mark} THEN 'fence' WHEN {d.like('line', r'^#{1,6}[ \t\r\n\f\v]')} THEN 'heading' ELSE 'plain' END"
    found = f"SELECT skill, path, hit, line - 1 AS first FROM ({_matches(d, '@scanned', r'<!--(?s:.*?)(?:-->|' + chr(92) + 'z)')}) AS m"
    spread = d.exploded(f"({found}) AS f", d.split("hit", "\n"), "skill, path, first", "part", "k")
    comments = f"SELECT DISTINCT skill, path, first + k AS pos FROM ({spread}) AS s WHERE part <> ''"
    return f"SELECT k.skill, k.path, k.class, count(*) AS lines, count(c.pos) AS commented FROM (SELECT skill, path, pos, {kind} AS class FROM ({marks}) AS m) AS k LEFT JOIN ({comments}) AS c ON c.skill = k.skill AND c.path = k.path AND c.pos = k.pos GROUP BY k.skill, k.path, k.class"


def scan_16_license(d: Dialect) -> str:
    """The first license file in the names' order, the first pattern that it matches, and its notice."""
    rank = "CASE path " + " ".join(f"WHEN '{n}' THEN {k}" for k, n in enumerate(LICENSE_FILES)) + " END"
    case = " ".join(f"WHEN {d.like('text', _edges(d, '(?i)' + p.replace('[' + chr(92) + 's' + chr(92) + 'S]', '(?s:.)')))} THEN '{i}'" for p, i in LICENSES)
    return f"SELECT skill, path, CASE {case} END AS license, nullif({d.first('text', '(?im)^[ ]*(Copyright[^A-Za-z0-9_].*)$')}, '') AS notice FROM (SELECT *, row_number() OVER (PARTITION BY skill ORDER BY {rank}) AS k FROM @file WHERE path IN ({', '.join(repr(n) for n in LICENSE_FILES)})) AS f WHERE k = 1"


def win_6_fence_state(d: Dialect) -> str:
    return f"SELECT skill, path, pos, marks % 2 = 1 AS fenced FROM ({_LINES}) AS l"


OPS = (scan_1_offsets, scan_1_instructions, scan_2_execution, scan_3_folded, scan_6_html_comments, scan_8_escape_runs, scan_14_char_profile, scan_15_line_classes, scan_16_license, win_6_fence_state)
