"""Records kept about packages: where they came from, what was changed, what they promise, and whether the ledger still says so.

Records are markdown tables and JSON texts.  Tables are read line by line, with
the section that a line stands in carried over lines; JSON is held against a
schema that is data.  Null is what nobody looked at, and is never made zero.
"""

from __future__ import annotations

from ..functions.dialect import Dialect

_WS = r"[ \t]*"


def _cell(d: Dialect, x: str, name: str, value: str, rest: str = "") -> str:
    """The value of the row ``name`` of a record's table, or null."""
    return f"nullif(trim({d.first(x, name + _WS + chr(92) + '|' + _WS + value + rest)}), '')"


_SPAN = r"`?([^\n|`]+?)`?"
_ARROW = r"(?:[ \t]*→[ \t]*`?([^\n|`]+?)`?)?"
_HEX = r"`([0-9a-fA-F]{7,40})`"
_DAY = r"([0-9]{4}-[0-9]{2}-[0-9]{2})"
_LICENSE = r"`?([A-Za-z0-9.+-]+?)`?[ \t]*(?:\||$)"


def provenance(d: Dialect) -> str:
    """(skill, kind, source, subpath, commit_id, fetched, license, license_basis, record_path) of every package.

    A package with an audit is acquired; each field is what its origin says, or
    else its audit.  An authored one has the license that its frontmatter names.
    """
    row = lambda name: rf"\|[ \t]*\*\*{name}\*\*[ \t]*"
    bold = lambda name: rf"(?i:\*\*{name}\*\*)[ \t]*"
    end = r"[ \t]*\|"
    both = lambda o, a: f"CASE WHEN audit IS NOT NULL THEN coalesce({o}, {a}) END"
    source = both(_cell(d, "origin", row("Source"), _SPAN, end), _cell(d, "audit", row("Source"), _SPAN, _ARROW + end))
    arrow = f"nullif(trim({d.first('audit', row('Source') + chr(92) + '|' + _WS + _SPAN + _ARROW + end, 2)}), '')"
    under = _cell(d, "origin", row("Subpath"), _SPAN, end)
    subpath = f"CASE WHEN origin IS NOT NULL THEN CASE WHEN NOT {d.like(f'coalesce({under}, {d.text(str())})', '(?i)^repository root$')} THEN {under} END ELSE {arrow} END"
    commit = both(_cell(d, "origin", bold("Resolved commit"), _HEX), _cell(d, "audit", bold("Upstream commit"), _HEX))
    fetched = both(_cell(d, "origin", row("Fetched"), _DAY), _cell(d, "audit", row("Retrieved"), _DAY))
    license_ = f"CASE WHEN audit IS NULL THEN nullif(trim(declared), '') ELSE coalesce({_cell(d, 'origin', row('License'), _LICENSE)}, {_cell(d, 'audit', row('License'), _LICENSE)}) END"
    basis = f"coalesce({_cell(d, 'origin', row('Licence basis'), r'([^' + chr(92) + 'n|]+?)', end)}, {_cell(d, 'audit', row('Licence basis'), r'([^' + chr(92) + 'n|]+?)', end)})"
    texts = """SELECT p.skill, max(CASE WHEN f.path = 'ORIGIN.md' THEN f.text END) AS origin, max(CASE WHEN f.path = 'AUDIT.md' THEN f.text END) AS audit, max(l.value) AS declared
        FROM @pkg p LEFT JOIN @record_file f ON f.skill = p.skill LEFT JOIN (SELECT skill, value FROM @front WHERE key = 'license' AND back = 1) AS l ON l.skill = p.skill GROUP BY p.skill"""
    told = f"SELECT skill, origin, audit, {source} AS source, {subpath} AS subpath, {commit} AS commit_id, {fetched} AS fetched, {license_} AS license, {basis} AS basis FROM ({texts}) AS t"
    return f"""SELECT skill, CASE WHEN audit IS NULL THEN 'authored' ELSE 'acquired' END AS kind, source, subpath, commit_id, fetched, license, CASE WHEN license IS NULL THEN NULL WHEN audit IS NULL THEN 'declared' ELSE basis END AS license_basis,
        CASE WHEN origin IS NOT NULL THEN 'ORIGIN.md' WHEN audit IS NOT NULL THEN 'AUDIT.md' END AS record_path FROM ({told}) AS p"""


def arrival(d: Dialect) -> str:
    """(skill, path, sha256): files as they came, of the rows of an origin's inventory that have a whole digest; the last of a path counts."""
    row = r"^\|[ \t]*`([^`]+)`[ \t]*\|[ \t]*[0-9]+ B[ \t]*\|[ \t]*`([0-9a-f]{64})`[ \t]*\|"
    lines = d.exploded("(SELECT skill, text FROM @record_file WHERE path = 'ORIGIN.md') AS o", d.split("text", "\n"), "skill", "line")
    own = f"SELECT skill, pos, {d.first('line', row, 1)} AS path, {d.first('line', row, 2)} AS sha256 FROM ({lines}) AS l WHERE {d.like('line', row)}"
    return f"SELECT skill, path, sha256 FROM (SELECT *, row_number() OVER (PARTITION BY skill, path ORDER BY pos DESC) AS back FROM ({own}) AS r) AS b WHERE back = 1"


def src_7_provenance(d: Dialect) -> str:
    """Where every package came from, field by field."""
    return "SELECT skill, kind, source, subpath, commit_id, fetched, license, license_basis, record_path FROM @provenance"


def src_7_arrival(d: Dialect) -> str:
    return "SELECT skill, path, sha256 FROM @arrival"


def prj_11_acquired(d: Dialect) -> str:
    """Acquired packages that can be looked up again: they name a source and a commit."""
    return "SELECT skill, source, commit_id, source IS NOT NULL AND commit_id IS NOT NULL AS pinned FROM @provenance WHERE kind = 'acquired'"


def changes(d: Dialect) -> str:
    """(skill, line): lines of the audit's first section 'Changes applied', up to the next heading of its rank."""
    lines = d.exploded("(SELECT skill, text FROM @record_file WHERE path = 'AUDIT.md') AS a", d.split("text", "\n"), "skill", "line")
    start, head = d.like("line", r"(?i)^##[ \t]*changes applied"), d.like("line", r"^##[ \t]")
    marked = f"SELECT skill, pos, line, {start} AS starts, sum(CASE WHEN {head} OR {start} THEN 1 ELSE 0 END) OVER (PARTITION BY skill ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM ({lines}) AS l"
    first = f"SELECT skill, min(CASE WHEN starts THEN section END) AS section FROM ({marked}) AS m GROUP BY skill"
    return f"SELECT m.skill, m.pos, m.line FROM ({marked}) AS m JOIN ({first}) AS f ON f.skill = m.skill AND f.section = m.section"


def adapted(d: Dialect) -> str:
    """(skill, path): files that the section on changes names in backticks; the section's own heading names none."""
    named = d.exploded(f"(SELECT skill, line FROM @changes WHERE NOT {d.like('line', '^##')}) AS c", d.all("line", r"`([a-zA-Z0-9_./-]+[.][a-zA-Z0-9]+)`", 1), "skill", "path", "k")
    return f"SELECT DISTINCT skill, path FROM ({named}) AS n"


def agg_23_adapted(d: Dialect) -> str:
    """How many files every audit's section on changes names; 0 if it names none, null without a section."""
    return """SELECT f.skill, CASE WHEN s.skill IS NOT NULL THEN coalesce(a.n, 0) END AS adapted FROM @record_file f LEFT JOIN (SELECT DISTINCT skill FROM @changes) AS s ON s.skill = f.skill
        LEFT JOIN (SELECT skill, count(*) AS n FROM @adapted GROUP BY skill) AS a ON a.skill = f.skill WHERE f.path = 'AUDIT.md'"""


def join_17_adaptation(d: Dialect) -> str:
    """Files on disk that are not as they came, record files left out, and whether the audit has a section that says what was changed."""
    both = "SELECT coalesce(k.skill, a.skill) AS skill FROM (SELECT skill, path, sha256 FROM @disk WHERE path NOT IN ('AUDIT.md', 'ORIGIN.md')) AS k FULL OUTER JOIN @arrival a ON a.skill = k.skill AND a.path = k.path WHERE k.sha256 IS DISTINCT FROM a.sha256"
    came = "(SELECT skill FROM @arrival GROUP BY skill) AS h"
    return f"SELECT h.skill, count(b.skill) AS diverged, count(b.skill) > 0 AND max(s.skill) IS NULL AS unmet FROM {came} LEFT JOIN ({both}) AS b ON b.skill = h.skill LEFT JOIN (SELECT DISTINCT skill FROM @changes) AS s ON s.skill = h.skill GROUP BY h.skill"


#: Headings of stages, and the line that is a stage's gate; fixed values.
STAGE = r"^###[ \t]+(?:[0-9]+[ \t]*·[ \t]*.+|[0-9]+[.][ \t]+.+|(?:Phase|Part)[ \t]+[0-9]+[ \t]*[—–-][ \t]*.+)$"
GATE = r"^>[ \t]*\*\*Gate:\*\*[ \t]*"


def stage(d: Dialect) -> str:
    """(skill, stage, gate): stages of every spine, and the first gate before the next heading; '' is an empty gate, null none."""
    lines = d.exploded("(SELECT skill, text FROM @scanned WHERE path = 'SKILL.md') AS s", d.split("text", "\n"), "skill", "line")
    marked = f"SELECT skill, pos, line, sum(CASE WHEN {d.like('line', '^#{2,3}[ ' + chr(92) + 't]')} THEN 1 ELSE 0 END) OVER (PARTITION BY skill ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM ({lines}) AS l"
    gates = f"CASE WHEN {d.like('line', GATE)} THEN trim({d.sub('line', GATE, '')}) END"
    at = f"CASE WHEN {d.like('line', GATE)} THEN pos END"
    return f"SELECT skill, section AS stage, min_by(gate, place) AS gate FROM (SELECT skill, section, {gates} AS gate, {at} AS place, {d.like('line', STAGE)} AS heads FROM ({marked}) AS m) AS g GROUP BY skill, section HAVING max(CASE WHEN heads THEN 1 ELSE 0 END) = 1"


def contract(d: Dialect) -> str:
    """(skill, model_invocable, desc_bytes, stages, gated, tests, self_test): what every package with a spine promises.

    ``gated`` is null without stages; ``tests`` and ``self_test`` without scripts.
    """
    held = "(SELECT skill FROM @scanned WHERE path = 'SKILL.md' GROUP BY skill) AS p"
    keys = f"(SELECT skill, max(CASE WHEN key = 'disable-model-invocation' AND lower(value) = 'true' THEN 1 ELSE 0 END) AS manual, max(CASE WHEN key = 'description' THEN {d.bytes('value')} END) AS bytes FROM @front WHERE back = 1 GROUP BY skill) AS k"
    stages = "(SELECT skill, count(*) AS n, min(CASE WHEN coalesce(gate, '') <> '' THEN 1 ELSE 0 END) = 1 AS gated FROM @stage GROUP BY skill) AS s"
    tests = f"(SELECT skill, count(CASE WHEN {d.like('path', '^scripts/[^/]*[.]test[.]mjs$')} THEN 1 END) AS n, max(CASE WHEN path = 'scripts/self-test.mjs' THEN 1 ELSE 0 END) = 1 AS self FROM @raw_file WHERE path LIKE 'scripts/%' GROUP BY skill) AS t"
    return f"SELECT p.skill, coalesce(k.manual, 0) = 0 AS model_invocable, coalesce(k.bytes, 0) AS desc_bytes, coalesce(s.n, 0) AS stages, s.gated, t.n AS tests, t.self AS self_test FROM {held} LEFT JOIN {keys} ON k.skill = p.skill LEFT JOIN {stages} ON s.skill = p.skill LEFT JOIN {tests} ON t.skill = p.skill"


def agg_12_contract(d: Dialect) -> str:
    return "SELECT skill, model_invocable, desc_bytes, stages, gated, tests, self_test FROM @contract"


def structural(d: Dialect) -> str:
    """(skill, section, field, value): everything about a package that can be told from its files now, as texts."""
    fields = {
        "origin": ("@provenance", ("kind", "source", "commit_id", "fetched", "license", "license_basis")),
        "contract": ("@contract", ("model_invocable", "desc_bytes", "stages", "gated", "tests", "self_test")),
    }
    parts = [f"SELECT skill, '{section}' AS section, '{f}' AS field, cast({f} as string) AS value FROM {source}" for section, (source, names) in fields.items() for f in names]
    parts.append("SELECT skill, 'integrity', path, sha256 FROM @disk")
    return " UNION ALL ".join(parts)


#: Fields of a point in time, which a comparison leaves out.
_TIMES = "'fetched', 'upstream_head', 'last_verified'"


def join_15_ledger_check(d: Dialect) -> str:
    """Sections of the ledger that are not what the files say now, packages without an entry, and entries without a package.

    Fields are compared null-safe; a field or file that one side lacks differs
    from one that has a value.  Fields of a point in time are not compared.
    """
    now, then = "(SELECT skill, section, field, value FROM @structural) AS n", "(SELECT skill, section, field, value FROM @ledger_field) AS l"
    held, kept = "(SELECT DISTINCT skill FROM @structural) AS h", "(SELECT DISTINCT skill FROM @ledger_field) AS k"
    differ = f"SELECT coalesce(n.skill, l.skill) AS skill, coalesce(n.section, l.section) AS section FROM {now} FULL OUTER JOIN {then} ON l.skill = n.skill AND l.section = n.section AND l.field = n.field WHERE coalesce(n.field, l.field) NOT IN ({_TIMES}) AND n.value IS DISTINCT FROM l.value"
    lacks = f"SELECT coalesce(h.skill, k.skill) AS skill, CASE WHEN k.skill IS NULL THEN 'no entry' ELSE 'not held' END AS what FROM {held} FULL OUTER JOIN {kept} ON k.skill = h.skill WHERE h.skill IS NULL OR k.skill IS NULL"
    return f"SELECT x.skill, x.section AS what, count(*) AS fields FROM ({differ}) AS x LEFT JOIN ({lacks}) AS m ON m.skill = x.skill WHERE m.skill IS NULL GROUP BY x.skill, x.section UNION ALL SELECT skill, what, cast(NULL as bigint) FROM ({lacks}) AS m"


#: What an unfilled record still has, verdicts, and what decides a finding; fixed values.
VERDICT_MENU = r"ADOPT[ \t]*·[ \t]*REVISE[ \t]*·[ \t]*REJECT"
PLACEHOLDERS = {
    "unfilled date": "YYYY-MM-DD", "verdict menu": VERDICT_MENU, "quality menu": r"Ready[ \t]*·[ \t]*Adopt with changes", "disposition menu": "Real / Accepted / False positive", "unfilled field": r"(?i)<[a-z][^>\n]{2,}>",
}
VERDICT = r"(?i)\|[ \t]*\*\*Verdict\*\*[ \t]*\|[ \t*]*(ADOPT|REVISE|REJECT)"
VERDICT_CELL = r"(?m)^\|[ \t]*\*\*Verdict\*\*[ \t]*\|([^|\n]*)\|"
FINDING_ROW = r"^\|[ \t]*[0-9]+[ \t]*\|[ \t]*`?[A-Z]+-[A-Z0-9]+`?[ \t]*\|[^|]*\|([^|]*)\|"
DECIDED = r"(?i)^(real|accepted|false positive|fixed|removed|n/a)($|[^A-Za-z0-9_])"


def record_gate(d: Dialect) -> str:
    """(skill, why): every reason why an audit is no finished decision; a verdict's menu is a placeholder and no verdict."""
    audit = "@record_file WHERE path = 'AUDIT.md'"
    verdict = f"upper({d.first('text', VERDICT)})"
    menu = d.like(d.first("text", VERDICT_CELL), VERDICT_MENU)
    left = [f"SELECT skill, '{why}' AS why FROM {audit} AND {d.like('text', p)}" for why, p in PLACEHOLDERS.items()]
    rows = d.exploded(f"(SELECT skill, text FROM {audit}) AS a", d.split("text", "\n"), "skill", "line")
    open_ = f"SELECT skill FROM ({rows}) AS r WHERE {d.like('line', FINDING_ROW)} AND NOT {d.like(f'trim({d.first(chr(108) + chr(105) + chr(110) + chr(101), FINDING_ROW)})', DECIDED)} GROUP BY skill"
    return " UNION ALL ".join([
        *left, f"SELECT skill, 'no verdict' FROM {audit} AND NOT {d.like('text', VERDICT_MENU)} AND {verdict} = ''", f"SELECT skill, 'rejected' FROM {audit} AND NOT {menu} AND {verdict} = 'REJECT'", f"SELECT skill, 'undecided findings' FROM ({open_}) AS o",
    ])


def agg_14_record_gate(d: Dialect) -> str:
    """Audits with the reasons why they do not pass, one row each; null where one passes."""
    return "SELECT f.skill, g.why FROM @record_file f LEFT JOIN @record_gate g ON g.skill = f.skill WHERE f.path = 'AUDIT.md'"


def unmet(d: Dialect) -> str:
    """(skill, why): conditions of a promotion that a package does not meet.

    An acquired one needs a resolved commit, a finished audit and a section on
    what was changed; an authored one an entry of the catalog, and a description
    and body that are not too long.  Nothing that blocks may be found in either,
    records aside.
    """
    blocks = "f.sev = 'BLOCK' OR p.kind = 'authored' AND f.code IN ('STRUCT-LONGDESC', 'STRUCT-LONGBODY')"
    return f"""SELECT p.skill, 'no spine' AS why FROM @provenance p WHERE NOT EXISTS (SELECT 1 FROM @raw_file f WHERE f.skill = p.skill AND f.path = 'SKILL.md')
        UNION ALL SELECT skill, 'held already' FROM @held_already UNION ALL SELECT skill, 'no resolved commit' FROM @provenance WHERE kind = 'acquired' AND commit_id IS NULL
        UNION ALL SELECT g.skill, concat('record: ', g.why) FROM @record_gate g UNION ALL SELECT skill, 'changes not told' FROM ({join_17_adaptation(d)}) AS j WHERE unmet
        UNION ALL SELECT p.skill, 'not in the catalog' FROM @provenance p WHERE p.kind = 'authored' AND NOT EXISTS (SELECT 1 FROM @catalog c WHERE c.skill = p.skill)
        UNION ALL SELECT p.skill, 'blocking findings' FROM @provenance p JOIN @finding f ON f.skill = p.skill WHERE ({blocks}) AND f.path NOT IN ('AUDIT.md', 'ORIGIN.md') GROUP BY p.skill"""


def agg_15_promotion(d: Dialect) -> str:
    """Whether every package may be promoted, and the conditions that it does not meet."""
    return f"SELECT p.skill, p.kind, count(u.why) AS unmet, {d.joined('u.why')} AS reasons, count(u.why) = 0 AS promotable FROM @provenance p LEFT JOIN @unmet u ON u.skill = p.skill GROUP BY p.skill, p.kind"


_NAME = r"^`([a-z0-9][a-z0-9-]*)`$"
_SOURCE = r"\[`?([^\]`]+)`?\]\(([^)]+)\)"


def decision(d: Dialect) -> str:
    """(file, pos, kind, name, repo, url, date, scan, finding, why): rows of the tables below 'Refused' and 'Declined'.

    A row counts if its first cell is nothing but a name in backticks; rows of
    fewer than three cells, and sections that repeat a heading, do not.
    """
    head = d.like("trim(line)", r"^##[ \t]+")
    marked = f"SELECT file, pos, line, {head} AS heads, max(CASE WHEN {head} THEN pos END) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM @rejected_line"
    heads = "SELECT file, kind, min(pos) AS section FROM (SELECT file, pos, CASE trim(line) WHEN '## Refused' THEN 'refused' WHEN '## Declined' THEN 'declined' END AS kind FROM @rejected_line) AS h WHERE kind IS NOT NULL GROUP BY file, kind"
    cells = d.mapped(d.split("substr(line, instr(line, '|') + 1)", "[|]"), "c", "trim(c)")
    item = lambda i: f"element_at(cells, {i})" if d.name == "spark" else f"cells[{i}]"
    rows = f"SELECT m.file, m.pos, h.kind, {cells} AS cells FROM ({marked}) AS m JOIN ({heads}) AS h ON h.file = m.file AND h.section = m.section WHERE NOT m.heads AND trim(m.line) LIKE '|%'"
    # The last cell is what follows the last bar.
    fit = f"SELECT file, pos, kind, cells, {d.size('cells')} - 1 AS n FROM ({rows}) AS r WHERE {d.size('cells')} > 3"
    value = lambda i: f"CASE WHEN n >= {i} THEN nullif({item(i)}, '') END"
    told = f"SELECT file, pos, kind, {d.first(item(1), _NAME)} AS name, {d.first(item(2), _SOURCE, 1)} AS repo, {d.first(item(2), _SOURCE, 2)} AS url, {value(3)} AS date, {value(4)} AS fourth, {value(5)} AS why FROM ({fit}) AS f WHERE {d.like(item(1), _NAME)}"
    return f"SELECT file, pos, kind, name, nullif(repo, '') AS repo, nullif(url, '') AS url, date, CASE WHEN kind = 'declined' THEN fourth END AS scan, CASE WHEN kind = 'refused' THEN fourth END AS finding, CASE WHEN kind = 'declined' THEN why END AS why FROM ({told}) AS t"


def src_6_rejected(d: Dialect) -> str:
    """Rows of the tables of decisions, parsed from their lines."""
    return "SELECT file, kind, name, repo, url, date, scan, finding, why FROM @decision"


_TEXT, _FULL = {"type": "string"}, {"type": "string", "least": 1}
_DATE, _DIGEST = {"type": "string", "pattern": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"}, {"type": "string", "pattern": "^sha256:[0-9a-f]{64}$"}
_OR_NULL = lambda s: {**s, "null": True}
#: What a record must be, object by object; fixed values.  ``each``: the objects or values of an array or map.
RECORD = {
    "": {
        "schemaVersion": {"const": "1"}, "skill": _FULL, "certifications": {"type": "array", "items": 1}, "inventory": {"type": "object"}, "findings": {"type": "array"}, "notChecked": {"type": "array"},
        "exemption": {"type": "object", "null": True}, "provenance": {"type": "object"},
    },
    "certifications[*]": {
        "criterion": {"enum": ("safe-to-load", "safe-to-execute", "house-style")}, "state": {"enum": ("certified", "refused", "not-applicable", "not-assessed")}, "by": _OR_NULL(_FULL), "on": _OR_NULL(_DATE),
        "method": _OR_NULL(_FULL), "inventoryDigest": _OR_NULL(_DIGEST), "why": _OR_NULL(_FULL),
    },
    "findings[*]": {"code": _FULL, "severity": {"enum": ("block", "review", "note")}, "at": _FULL, "excerpt": _TEXT, "disposition": {"enum": ("real", "accepted", "false-positive", "fixed", "removed", "not-applicable")}, "why": _FULL},
    "exemption": {"reason": _FULL, "on": _DATE},
    "provenance": {k: _OR_NULL(_TEXT) for k in ("source", "commit", "retrieved", "license", "licenseBasis")},
}


def record_object(d: Dialect) -> str:
    """(id, place, node): the objects of every record that the schema has fields for, with where they stand."""
    parts = ["SELECT id, '' AS place, line AS node FROM @record_json WHERE " + d.valid_json("line") + " AND " + d.json_kind("line", "$") + " = 'object'"]
    for place in RECORD:
        name = place.removesuffix("[*]")
        if place.endswith("[*]"):
            each = d.exploded(f"(SELECT id, line FROM @record_json WHERE {d.valid_json('line')} AND {d.json_kind('line', '$.' + name)} = 'array') AS r", d.blocks("line", "$." + name), "id", "node")
            parts.append(f"SELECT id, concat('{name}[', pos, ']'), node FROM ({each}) AS e")
        elif name:
            parts.append(f"SELECT id, '{name}', {d.json_node('line', '$.' + name)} FROM @record_json WHERE {d.valid_json('line')} AND {d.json_kind('line', '$.' + name)} = 'object'")
    return " UNION ALL ".join(parts)


def violation(d: Dialect) -> str:
    """(id, place, field, what): every violation of the schema by every record; a text that is no object has one."""
    kind, value = (lambda f: d.json_kind("node", f"$.{f}")), (lambda f: d.json("node", f"$.{f}"))
    parts = [f"SELECT id, '' AS place, '' AS field, 'not a record' AS what FROM @record_json WHERE NOT {d.valid_json('line')} OR {d.json_kind('line', '$')} IS DISTINCT FROM 'object'"]
    for place, fields in RECORD.items():
        here = f"@record_object WHERE place = '{place}'" if not place.endswith("[*]") else f"@record_object WHERE {d.like('place', '^' + place.removesuffix('[*]') + chr(92) + '[[0-9]+' + chr(92) + ']$')}"
        if place.endswith("[*]"):
            parts.append(f"SELECT id, place, '', 'type' FROM {here} AND {d.json_kind('node', '$')} IS DISTINCT FROM 'object'")
            here += f" AND {d.json_kind('node', '$')} = 'object'"
        checks = []
        for f, s in fields.items():
            tests = []
            if "const" in s:
                tests.append(f"WHEN {kind(f)} <> 'number' OR {value(f)} <> '{s['const']}' THEN 'const'")
            if "enum" in s:
                tests.append(f"WHEN {kind(f)} <> 'string' OR {value(f)} NOT IN ({', '.join(repr(v) for v in s['enum'])}) THEN 'enum'")
            if s.get("null"):
                tests.insert(0, f"WHEN {kind(f)} = 'null' THEN NULL")
            if "type" in s:
                tests.append(f"WHEN {kind(f)} <> '{s['type']}' THEN 'type'")
            if "least" in s:
                tests.append(f"WHEN length({value(f)}) < {s['least']} THEN 'empty'")
            if "pattern" in s:
                tests.append(f"WHEN NOT {d.like(value(f), s['pattern'])} THEN 'pattern'")
            if "items" in s:
                tests.append(f"WHEN {d.size(d.blocks('node', '$.' + f))} < {s['items']} THEN 'too few'")
            checks.append(f"CASE WHEN {kind(f)} IS NULL THEN 'required:{f}' ELSE (CASE {' '.join(tests)} END) || ':{f}' END")
        each = d.exploded(f"(SELECT id, place, {d.array(checks)} AS found FROM {here}) AS o", "found", "id, place", "hit", "k")
        parts.append(f"SELECT id, place, split_part(hit, ':', 2), split_part(hit, ':', 1) FROM ({each}) AS e WHERE hit IS NOT NULL")
        keys = d.exploded(f"(SELECT id, place, {d.json_keys('node')} AS names FROM {here}) AS o", "names", "id, place", "name", "k")
        parts.append(f"SELECT id, place, name, 'unknown' FROM ({keys}) AS e WHERE name NOT IN ({', '.join(repr(f) for f in fields)})")
    # Values of the inventory, and items of what was not checked.
    files = f"(SELECT id, {d.json_node('line', '$.inventory')} AS node FROM @record_json WHERE {d.valid_json('line')} AND {d.json_kind('line', '$.inventory')} = 'object') AS i"
    named = d.exploded(f"(SELECT id, node, {d.json_keys('node')} AS names FROM {files}) AS o", "names", "id, node", "name", "k")
    parts.append(f"SELECT id, 'inventory', name, 'pattern' FROM ({named}) AS e WHERE NOT coalesce({d.like(d.json_at('node', 'name'), _DIGEST['pattern'])}, false)")
    items = d.exploded(f"(SELECT id, line FROM @record_json WHERE {d.valid_json('line')} AND {d.json_kind('line', '$.notChecked')} = 'array') AS n", d.blocks("line", "$.notChecked"), "id", "item")
    parts.append(f"SELECT id, concat('notChecked[', pos, ']'), '', CASE WHEN {d.json_kind('item', '$')} IS DISTINCT FROM 'string' THEN 'type' ELSE 'empty' END FROM ({items}) AS e WHERE {d.json_kind('item', '$')} IS DISTINCT FROM 'string' OR length({d.json('item', '$')}) < 1")
    return " UNION ALL ".join(parts)


def agg_24_record_validation(d: Dialect) -> str:
    """Everything wrong with every record: what breaks the schema, and, where nothing does, what its decisions lack."""
    field = lambda f: d.json("node", f"$.{f}")
    sound = "id NOT IN (SELECT id FROM @violation)"
    certs = f"(SELECT id, place, {field('state')} AS state, {field('by')} AS signer, {field('on')} AS dated, {field('inventoryDigest')} AS digest, {field('why')} AS why FROM @record_object WHERE place LIKE 'certifications[%' AND {sound}) AS c"
    lacks = lambda f, col, state: f"SELECT id, place, '{f}' AS field, 'lacks' AS what FROM {certs} WHERE {state} AND {col} IS NULL"
    return " UNION ALL ".join([
        "SELECT id, place, field, what FROM @violation",
        lacks("why", "why", "state IN ('refused', 'not-applicable')"), lacks("by", "signer", "state = 'certified'"), lacks("on", "dated", "state = 'certified'"), lacks("inventoryDigest", "digest", "state = 'certified'"),
        f"SELECT id, '' AS place, 'notChecked', 'says nothing' FROM @record_object WHERE place = '' AND {sound} AND {d.size(d.blocks('node', '$.notChecked'))} = 0 AND {d.json_kind('node', '$.exemption')} = 'null'",
    ])


RELATIONS = (record_gate, unmet, provenance, arrival, changes, adapted, stage, contract, structural, decision, record_object, violation)
OPS = (src_7_provenance, src_7_arrival, prj_11_acquired, agg_23_adapted, join_17_adaptation, agg_12_contract, agg_14_record_gate, agg_15_promotion, join_15_ledger_check, src_6_rejected, agg_24_record_validation)
