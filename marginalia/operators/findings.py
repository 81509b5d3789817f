"""Findings of the scan: every check of every file, with its place, and the verdict made of them.

Files come as bytes.  Archives and binaries are reported and leave; the rest is
text, and only text is searched.  A finding is one match: package, file, code,
severity, line and column in code points (null where a check is about the whole
file), evidence, and the words of the package that its reason quotes.  The rules
are looked for in one pass: cheap hints say which rules a file may match, and
only those are searched and located.

Each case has a result: a null content counts as an empty file; a package
without files has no findings; equal files of several packages are found each;
matches of one rule do not overlap; a file of any length is searched whole.
"""

from __future__ import annotations

from ..functions.dialect import Dialect
from ..functions.rules import (
    ARCHIVES, BIDI, BODY_WORDS, BREADTH, BUNDLE_DIRS, BUNDLE_FILES, BUNDLED_SCRIPT, CHECKS, CODE_FILE, CODE_LINE, DESC_LEAST, DESC_MOST, DIRECTIVE, EARLY, ESCAPES, HARNESS_KEYS, HOOK_KEYS, IMPORT, INVISIBLE, NAME_MOST,
    READABLE, RECORD_FILES, REFERRED, SPEC_KEYS, TAGS, UNFENCED_LEAST, VERDICTS, WILD_TOOLS, alike, ascii_classes, confusables, glob_pattern, java, rules,
)

FENCE = "(?m)^```[^\n]*\n(?s:.*?)^```"
INLINE = "`[^`\n]+`"
COMMENT = "<!--(?s:.*?)-->"
RUN = "[A-Za-z0-9+/]{40,}={0,2}"
_BLANK = r"[ \t\r\n\f\v]+"
#: Globs whose files' findings are set apart.
EXCLUDED = ("references/**", "*.json")

#: What a rule's match has in it, in lower case, at least one of; a text without any is not searched.  Rules that are not here are looked for in all code.
_HINTS = {
    "INSTR-OVERRIDE": "ignore", "INSTR-SUPREMACY": "regardless irrespective", "INSTR-EXFIL": "http", "INSTR-REMOTE": "http", "INSTR-NOCONFIRM": "without",
    "INSTR-AUTOAPPROVE": "approve allow accept", "INSTR-AUTHORITY": "override mode directive instruction command", "INSTR-CONCEAL": "tell inform notify mention reveal disclos show",
    "INSTR-PERMBYPASS": "dangerously yolo bypasspermissions disable_ claude_", "INSTR-ROLESWAP": "now actually really",
    "INSTR-SECRETS": ".env .ssh id_rsa id_ed25519 .aws .netrc _key _token aws_secret keychain credentials .npmrc",
}


def _own(d: Dialect, pattern: str) -> str:
    """A pattern with ASCII classes and edges, spelled for the engine."""
    p = ascii_classes(pattern)
    return java(p) if d.name == "spark" else p


def _rule(d: Dialect, java_: str, re2: str) -> str:
    return java_ if d.name == "spark" else re2


def _as(d: Dialect, sql: str, name: str) -> str:
    return f"({sql}) AS {name}"


def _placed(d: Dialect, found: str, columns: str, key: str) -> str:
    """``columns``, pos, hit, off, line, col, seg and nxt of every match, from rows with ``hits`` and ``gaps``.

    Places are running sums over a text's matches, so a text moves with none of
    them and the work grows with the matches.
    """
    each = d.exploded(f"(SELECT {columns}, {d.matched('hits', 'gaps')} AS found FROM ({found}) AS f) AS z", "found", columns, "m")
    over = f"OVER (PARTITION BY {key} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    flat = f"SELECT {columns}, pos, m.hit AS hit, m.seg AS seg, m.nxt AS nxt, cast(length(m.seg) - length(replace(m.seg, chr(10), '')) as int) AS breaks, cast(length(split_part(m.seg, chr(10), -1)) as int) AS tail FROM ({each}) AS e"
    summed = f"SELECT *, cast(sum(length(seg)) {over} as int) AS off, 1 + cast(sum(breaks) {over} as int) AS line FROM ({flat}) AS f"
    return f"SELECT *, off - coalesce(max(CASE WHEN breaks > 0 THEN off - tail END) {over}, 0) + 1 AS col FROM ({summed}) AS s"


def _matches(d: Dialect, source: str, pattern: str) -> str:
    """Every match of a pattern in the texts of ``source``, placed."""
    found = f"SELECT skill, path, {d.all('text', pattern)} AS hits, {d.split('text', pattern)} AS gaps FROM {source} WHERE {d.like('text', pattern)}"
    return _placed(d, found, "skill, path", "skill, path")


def _place(off: str = "off") -> str:
    """Line and column, from 1, of a place in ``text``."""
    before = f"substr(text, 1, {off})"
    return f"cast(length({before}) - length(replace({before}, chr(10), '')) as int) + 1 AS line, cast(length(split_part({before}, chr(10), -1)) as int) + 1 AS col"


def _excerpt(d: Dialect, x: str, most: int = 100) -> str:
    """A match on one line, cut with a mark."""
    raw = f"trim({d.sub(f'substr({x}, 1, {most})', _BLANK, ' ')})"
    return f"CASE WHEN length({raw}) < length({x}) THEN concat({raw}, '…') ELSE {raw} END"


def fragment(d: Dialect, x: str) -> str:
    """Words of a package fit to be quoted: one line, 60 characters with a mark, all but printable ASCII escaped."""
    flat = f"trim({d.sub(x, _BLANK, ' ')})"
    cut = f"CASE WHEN length({flat}) > 60 THEN concat(substr({flat}, 1, 60), '…') ELSE {flat} END"
    point = d.code_point("c", 4, False)
    escaped = f"CASE WHEN {d.like('c', '[ -~…]')} THEN c WHEN length({point}) > 4 THEN concat({d.text(chr(92) + 'u{')}, {point}, '}}') ELSE concat({d.text(chr(92) + 'u')}, {point}) END"
    return d.together(d.mapped(d.all(f"({cut})", "(?s:.)"), "c", escaped), "")


def routed(d: Dialect) -> str:
    """(skill, path, content, bytes, route, archive): archives by their first bytes or tar's mark, then binaries by an early NUL, then text."""
    head = f"hex({d.part('content', 1, 8)})"
    kind = " ".join(f"WHEN head LIKE '{h}%' THEN '{k}'" for k, h in ARCHIVES)
    tar = f"WHEN bytes > 262 AND hex({d.part('content', 258, 5)}) = '7573746172' THEN 'tar'"
    bare = f"SELECT skill, path, coalesce(content, {d.to_bytes(d.text(''))}) AS content FROM @raw_file"
    first = f"SELECT skill, path, content, cast(octet_length(content) as bigint) AS bytes, {head} AS head FROM ({bare}) AS b"
    told = f"SELECT skill, path, content, bytes, CASE {kind} {tar} END AS archive FROM ({first}) AS h"
    return f"SELECT skill, path, content, bytes, archive, CASE WHEN archive IS NOT NULL THEN 'archive' WHEN {d.has_nul(d.part('content', 1, EARLY))} THEN 'binary' ELSE 'text' END AS route FROM ({told}) AS t"


def scanned(d: Dialect) -> str:
    """(skill, path, text, low, is_code) of the files that are text."""
    text = d.to_text("content")
    return f"SELECT skill, path, text, lower(text) AS low, {d.like('path', CODE_FILE)} AS is_code FROM (SELECT skill, path, {text} AS text FROM @routed WHERE route = 'text') AS t"


def fence(d: Dialect) -> str:
    """(skill, path, lo, hi): fenced blocks that are closed, as places in the text."""
    return f"SELECT skill, path, off AS lo, off + length(hit) AS hi FROM ({_matches(d, '@scanned', FENCE)}) AS m"


def spine(d: Dialect) -> str:
    """Every package's spine: its text, the frontmatter block (null if there is none that is closed), what follows, and why there is none."""
    bare = f"SELECT skill, {d.sub('text', chr(92) + 'A' + chr(92) + 'x{FEFF}', '')} AS t, {d.like('text', chr(92) + 'A' + chr(92) + 'x{FEFF}')} AS bom FROM @scanned WHERE path = 'SKILL.md'"
    at = "SELECT skill, t, bom, t LIKE '---%' AS opens, instr(t, chr(10)) AS nl, instr(substr(t, 4), concat(chr(10), '---')) AS e FROM (" + bare + ") AS b"
    return f"SELECT skill, bom, opens, opens AND e > 0 AS ok, CASE WHEN opens AND e > 0 THEN substr(t, cast(nl + 1 as int), cast(greatest(e + 3 - nl - 1, 0) as int)) END AS block, CASE WHEN opens AND e > 0 THEN substr(t, cast(e + 7 as int)) END AS body FROM ({at}) AS a"


def front(d: Dialect) -> str:
    """(skill, key, value, line, n, back): frontmatter keys; n is how often a key stands there, back counts from its last.

    Indented lines go on with the value before them; blank lines and lines that
    begin with # are none; a line that is no key ends the one before; quotes
    around a value go.
    """
    lines = d.exploded("(SELECT skill, block FROM @spine WHERE ok) AS b", d.split("block", "\n"), "skill", "raw")
    own = f"SELECT skill, pos, raw, NOT {d.like('raw', '^' + _BLANK)} AS heads FROM ({lines}) AS l WHERE NOT {d.like('raw', r'^[ \t\r\n\f\v]*(#|$)')}"
    grouped = f"SELECT skill, pos, raw, heads, sum(CASE WHEN heads THEN 1 ELSE 0 END) OVER (PARTITION BY skill ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM ({own}) AS o"
    more = d.joined("CASE WHEN NOT heads THEN trim(raw) END", distinct=False, order="pos", by=" ")
    one = f"SELECT skill, min(CASE WHEN heads THEN pos END) AS pos, max(CASE WHEN heads THEN raw END) AS head, {more} AS more FROM ({grouped}) AS g GROUP BY skill, g"
    rest = f"trim({d.sub('head', '^[A-Za-z0-9_-]+:' + r'[ \t\r\f\v]*', '')})"
    quoted = f"""(v LIKE '"%' AND v LIKE '%"') OR (v LIKE '''%' AND v LIKE '%''')""" if d.name == "duckdb" else """(v LIKE '"%' AND v LIKE '%"') OR (v LIKE '\\'%' AND v LIKE '%\\'')"""
    keys = f"SELECT skill, pos, {d.first('head', '^([A-Za-z0-9_-]+):')} AS key, {rest} AS v, more FROM ({one}) AS k WHERE head IS NOT NULL"
    value = f"concat(CASE WHEN {quoted} THEN substr(v, 2, cast(greatest(length(v) - 2, 0) as int)) ELSE v END, CASE WHEN more IS NULL THEN '' ELSE concat(' ', more) END)"
    return f"SELECT skill, key, {value} AS value, cast(pos + 2 as int) AS line, count(*) OVER (PARTITION BY skill, key) AS n, row_number() OVER (PARTITION BY skill, key ORDER BY pos DESC) AS back FROM ({keys}) AS f WHERE key <> ''"


def known_as(d: Dialect) -> str:
    """(skill, name): the names by which a package's own files may call it: its folder and what it declares."""
    return "SELECT skill, skill AS name FROM @raw_file GROUP BY skill UNION SELECT skill, value FROM @front WHERE key = 'name' AND back = 1 AND value <> ''"


_TRAIL = r"""[.,;:!?)\]}'"]+$"""


def mention(d: Dialect) -> str:
    """(skill, referrer, target, vouches): files that a package's texts refer to.

    A bare path is taken from the package's own files, one below the package's
    own name from its record files too; but a record never vouches for a file.
    """
    record = ", ".join(f"'{r}'" for r in RECORD_FILES)
    bare = _matches(d, f"(SELECT skill, path, text FROM @scanned WHERE path NOT IN ({record})) AS s", f"(?:{REFERRED})/[A-Za-z0-9._/-]+")
    anchored = f"skills/([A-Za-z0-9._-]+)/((?:{REFERRED})/[A-Za-z0-9._/-]+)"
    own = _matches(d, "@scanned", anchored)
    named = f"SELECT o.skill, o.path, o.target FROM (SELECT skill, path, {d.first('hit', anchored, 1)} AS name, {d.first('hit', anchored, 2)} AS target FROM ({own}) AS m) AS o JOIN @known_as k ON k.skill = o.skill AND k.name = o.name"
    free = f"SELECT skill, path, hit AS target FROM ({bare}) AS m WHERE NOT ({d.like('seg', '[A-Za-z0-9_-]' + chr(92) + 'z')}) AND NOT ({d.like('seg', '[A-Za-z0-9_]/' + chr(92) + 'z')})"
    both = f"SELECT skill, path, {d.sub('target', _TRAIL, '')} AS target FROM ({free} UNION ALL {named}) AS b"
    return f"SELECT DISTINCT skill, path AS referrer, target, path NOT IN ({record}) AS vouches FROM ({both}) AS t WHERE target NOT LIKE '%/'"


def dead_reference(d: Dialect) -> str:
    """(skill, target, referrer): paths that are referred to and not there; the first of the package's own files that does, else the record."""
    return """SELECT m.skill, m.target, coalesce(min(CASE WHEN m.vouches THEN m.referrer END), min(m.referrer)) AS referrer FROM @mention m
        WHERE NOT EXISTS (SELECT 1 FROM @raw_file f WHERE f.skill = m.skill AND f.path = m.target) GROUP BY m.skill, m.target"""


def unmentioned(d: Dialect) -> str:
    """(skill, path, folder, named): files of the four folders that no text of the package names; named: some text names the folder."""
    record = ", ".join(f"'{r}'" for r in RECORD_FILES)
    folders = d.exploded(f"(SELECT skill, text FROM @scanned WHERE path NOT IN ({record})) AS s", d.all("text", _own(d, rf"\b({REFERRED})/"), 1), "skill", "folder")
    return f"""SELECT f.skill, f.path, f.folder, n.folder IS NOT NULL AS named FROM (SELECT skill, path, split_part(path, '/', 1) AS folder FROM @raw_file WHERE {d.like('path', f'^({REFERRED})/')}) AS f
        LEFT JOIN (SELECT DISTINCT skill, folder FROM ({folders}) AS x) AS n ON n.skill = f.skill AND n.folder = f.folder WHERE NOT EXISTS (SELECT 1 FROM @mention m WHERE m.skill = f.skill AND m.target = f.path AND m.vouches)"""


def _row(code: str, source: str, path: str = "path", sev: str | None = None, line: str = "cast(NULL as int)", col: str = "cast(NULL as int)", evidence: str = "cast(NULL as string)", quoted: str = "cast(NULL as string)", where: str = "true") -> str:
    code_, sev_ = (f"'{code}'", f"'{CHECKS[code]}'") if code in CHECKS else (code, "")
    return f"SELECT skill, {path} AS path, {code_} AS code, {sev or sev_} AS sev, {line} AS line, {col} AS col, {evidence} AS evidence, {quoted} AS quoted FROM {source} WHERE {where}"


def layout_finding(d: Dialect) -> str:
    """What a package is made of: bundles, files for other harnesses, a missing spine, archives, binaries, NULs in text."""
    base = f"lower({d.first('path', '([^/]+)$')})"
    top = "split_part(path, '/', 1)"
    dirs = ", ".join(f"'{x}'" for x in BUNDLE_DIRS)
    bundle = " OR ".join(d.like("base", p) for p in BUNDLE_FILES)
    files = f"(SELECT r.skill, r.path, {base} AS base, {top} AS top, s.skill IS NOT NULL AS held FROM @raw_file r LEFT JOIN (SELECT skill FROM @raw_file WHERE path = 'SKILL.md' GROUP BY skill) AS s ON s.skill = r.skill) AS f"
    at = f"instr(text, chr(0)) - 1"
    return " UNION ALL ".join([
        _row("CONFIG-OUTOFSCOPE", files, where=f"({bundle})", quoted="base"),
        _row("CONFIG-OUTOFSCOPE", files, where=f"top IN ({dirs}) AND path <> top OR top = 'agents' AND path <> top AND NOT held", quoted="concat(top, '/')"),
        _row("CONFIG-CROSSHARNESS", files, where="top = 'agents' AND path <> top AND held"),
        _row("STRUCT-NOSKILL", "(SELECT skill, max(CASE WHEN path = 'SKILL.md' THEN 1 ELSE 0 END) AS held FROM @raw_file GROUP BY skill) AS g", "'.'", where="held = 0"),
        _row("STRUCT-ARCHIVE", "@routed", evidence="concat(bytes, ' bytes')", where="route = 'archive'", quoted="archive"),
        _row("STRUCT-BINARY", "@routed", evidence="concat(bytes, ' bytes')", where="route = 'binary'"),
        f"SELECT skill, path, 'STRUCT-NULBYTE', '{CHECKS['STRUCT-NULBYTE']}', {_place(f'cast({at} as int)')}, concat('byte ', {at}), cast(NULL as string) FROM @scanned WHERE instr(text, chr(0)) > 0",
    ])


def front_finding(d: Dialect) -> str:
    """What is wrong with a package's frontmatter."""
    named = lambda keys: ", ".join(f"'{k}'" for k in keys)
    f, last = "@front", "back = 1"
    tier = f"CASE WHEN key IN ({named(HOOK_KEYS)}) THEN 'CONFIG-HOOKFRONTMATTER' WHEN key IN ({named(HARNESS_KEYS)}) THEN 'STRUCT-NONPORTABLE' ELSE 'STRUCT-UNKNOWNKEY' END"
    sev = lambda case: "CASE " + case + " " + " ".join(f"WHEN '{c}' THEN '{s}'" for c, s in CHECKS.items() if c in ("CONFIG-HOOKFRONTMATTER", "STRUCT-NONPORTABLE", "STRUCT-UNKNOWNKEY")) + " END"
    spine_ = "'SKILL.md'"
    missing = lambda key: f"(SELECT s.skill FROM @spine s LEFT JOIN (SELECT skill FROM @front WHERE key = '{key}' AND back = 1 AND value <> '') AS k ON k.skill = s.skill WHERE s.ok AND k.skill IS NULL) AS m"
    on = lambda code, key, where, evidence="cast(NULL as string)", quoted="cast(NULL as string)": _row(code, f, spine_, line="line", col="1", evidence=evidence, quoted=quoted, where=f"{last} AND key = '{key}' AND value <> '' AND {where}")
    wild = d.like("value", _own(d, WILD_TOOLS))
    body = f"(SELECT skill, {d.count('body', r'[^ \t\r\n\f\v]+')} AS words FROM @spine WHERE ok) AS b"
    return " UNION ALL ".join([
        _row("STRUCT-BOM", "@spine", spine_, line="1", col="1", where="bom"),
        _row("STRUCT-NOFRONTMATTER", "@spine", spine_, line="1", col="1", where="NOT ok"),
        _row("STRUCT-DUPKEY", f, spine_, evidence="key", quoted="key", where="back > 1"),
        _row("key_code", f"(SELECT skill, key, line, {tier} AS key_code FROM {f} WHERE {last} AND key NOT IN ({named(SPEC_KEYS)})) AS t", spine_, sev=sev("key_code"), line="line", col="1", evidence="key", quoted="key"),
        _row("STRUCT-NONAME", missing("name"), spine_),
        on("STRUCT-BADNAME", "name", f"NOT {d.like('value', chr(92) + 'A[a-z0-9-]+' + chr(92) + 'z')}", "value"),
        on("STRUCT-LONGNAME", "name", f"length(value) > {NAME_MOST}", "concat(length(value), ' chars')"),
        on("STRUCT-NAMEMISMATCH", "name", "value <> skill", quoted="value"),
        _row("STRUCT-NODESC", missing("description"), spine_),
        on("STRUCT-LONGDESC", "description", f"length(value) > {DESC_MOST}", "concat(length(value), ' chars')"),
        on("STRUCT-DESCANGLE", "description", d.like("value", "[<>]")),
        on("STRUCT-SHORTDESC", "description", f"length(value) < {DESC_LEAST}", "value"),
        on("STRUCT-TRIGGERBREADTH", "description", d.like("value", _own(d, BREADTH)), d.together(d.all("value", _own(d, BREADTH)), ", ")),
        _row("CONFIG-ALLOWEDTOOLS", f, spine_, sev=f"CASE WHEN {wild} THEN 'BLOCK' ELSE '{CHECKS['CONFIG-ALLOWEDTOOLS']}' END", line="line", col="1", evidence="value", where=f"{last} AND key = 'allowed-tools'"),
        _row("STRUCT-LONGBODY", body, spine_, where=f"words > {BODY_WORDS}"),
    ])


def reference_finding(d: Dialect) -> str:
    """References to files that are not there, and files that nothing refers to."""
    return " UNION ALL ".join([
        _row("STRUCT-DEADREF", "@dead_reference", "referrer", evidence="target", quoted="target"),
        _row("STRUCT-UNNAMED", "@unmentioned", quoted="concat(folder, '/')", where="named"),
        _row("STRUCT-ORPHAN", "@unmentioned", quoted="concat(folder, '/')", where="NOT named"),
    ])


def rule_finding(d: Dialect) -> str:
    """Every match of every rule: instructions in all texts, execution in code and inside fences of other files.

    A path below the home folder is none where the next 120 characters name the
    package itself, or any package's scripts.
    """
    known = rules()
    branches = []
    # A few rules at a time, so that the code that is generated for them stays small.
    for lo in range(0, len(known), 5):
        numbers = []
        for k, (code, _, surface, *_) in list(enumerate(known))[lo : lo + 5]:
            hints = " OR ".join(f"contains(low, {d.text(h)})" for h in _HINTS[code].split()) if code in _HINTS else "is_code OR contains(text, '```')"
            numbers.append(f"CASE WHEN {hints} THEN {k} END")
        maybe = d.exploded("@scanned", d.array(numbers), "skill, path, text, is_code", "k", "slot")
        pick = lambda of: "CASE k " + " ".join(f"WHEN {k} THEN {of('text', _rule(d, j, r))}" for k, (_, _, _, j, r) in list(enumerate(known))[lo : lo + 5]) + " END"  # noqa: B023, E731
        found = f"SELECT skill, path, is_code, k, hits, {pick(d.split)} AS gaps FROM (SELECT *, {pick(d.all)} AS hits FROM ({maybe}) AS m WHERE k IS NOT NULL) AS a WHERE {d.size('hits')} > 0"
        branches.append(_placed(d, found, "skill, path, is_code, k", "skill, path, k"))
    each = " UNION ALL ".join(branches)
    secrets = next(k for k, r in enumerate(known) if r[0] == "INSTR-SECRETS")
    # One engine has no look-behind, so that rule takes the character before its match along.
    early = f"CASE WHEN k = {secrets} AND {d.like('hit', '(?i)' + chr(92) + 'A[^A-Za-z0-9_][.]env' + chr(92) + 'z')} THEN 1 ELSE 0 END"
    home = next(k for k, r in enumerate(known) if r[0] == "EXEC-HOMEPATH")
    ahead = d.run_of(f"CASE WHEN k = {home} THEN concat(hit, substr(nxt, 1, 120)) ELSE '' END", "PARTITION BY skill, path, k ORDER BY pos ROWS BETWEEN CURRENT ROW AND 60 FOLLOWING")
    at = f"SELECT skill, path, is_code, k, substr(hit, 1 + early) AS hit, off + early AS off, CASE WHEN early = 1 AND hit LIKE concat(chr(10), '%') THEN line + 1 ELSE line END AS line, CASE WHEN early = 1 AND hit LIKE concat(chr(10), '%') THEN 1 ELSE col + early END AS col, substr(ahead, 1, 120) AS ahead FROM (SELECT *, {early} AS early, {ahead} AS ahead FROM ({each}) AS e) AS s"
    first_code = next(k for k, r in enumerate(known) if r[2] == "code")
    escaped = d.sub("n.name", "([^A-Za-z0-9_-])", chr(92) * 2 + "$1") if d.name == "spark" else "regexp_escape(n.name)"
    itself = f"concat('skills/', {escaped}, '([^A-Za-z0-9_-]|{chr(92) * (2 if d.name == 'spark' else 1)}z)')"
    matches = f"ahead RLIKE {itself}" if d.name == "spark" else f"regexp_matches(ahead, {itself})"
    code = "CASE k " + " ".join(f"WHEN {k} THEN '{c}'" for k, (c, *_) in enumerate(known)) + " END"
    sev = "CASE k " + " ".join(f"WHEN {k} THEN '{v}'" for k, (_, v, *_) in enumerate(known)) + " END"
    kept = f"""SELECT h.* FROM ({at}) AS h WHERE (k < {first_code} OR is_code OR EXISTS (SELECT 1 FROM @fence f WHERE f.skill = h.skill AND f.path = h.path AND h.off >= f.lo AND h.off < f.hi))
        AND NOT (k = {home} AND {d.like('ahead', BUNDLED_SCRIPT)}) AND NOT EXISTS (SELECT 1 FROM @known_as n WHERE n.skill = h.skill AND h.k = {home} AND {matches})"""
    return f"SELECT skill, path, {code} AS code, {sev} AS sev, line, col, {_excerpt(d, 'hit')} AS evidence, cast(NULL as string) AS quoted FROM ({kept}) AS x"


def disguise_finding(d: Dialect) -> str:
    """Rules that match only after look-alikes are folded, hidden and reordering characters, look-alikes in code."""
    known, table = rules(), confusables()
    coarse, exact = alike(d.name == "spark")
    folded = f"translate(text, {d.text(''.join(table))}, {d.text(''.join(table.values()))})"
    numbers = d.array([str(k) for k in range(len(known))])
    each = d.exploded(f"(SELECT skill, path, text, folded FROM (SELECT skill, path, text, {folded} AS folded FROM @scanned WHERE {d.like('text', coarse)}) AS f WHERE folded <> text) AS g", numbers, "skill, path, text, folded", "k", "slot")
    match = "CASE k " + " ".join(f"WHEN {k} THEN CASE WHEN NOT {d.like('text', _rule(d, j, r))} THEN {d.first('folded', _rule(d, j, r), 0)} END" for k, (_, _, _, j, r) in enumerate(known)) + " END"
    rule = "CASE k " + " ".join(f"WHEN {k} THEN '{c}'" for k, (c, *_) in enumerate(known)) + " END"
    parts = [_row("INSTR-OBFUSCATED", f"(SELECT skill, path, {match} AS hit, {rule} AS rule FROM ({each}) AS e) AS m", evidence=_excerpt(d, "hit", 80), quoted="rule", where="hit <> ''")]
    point = f"concat('U+', {d.code_point('hit', 4)})"
    for code, chars in (("INSTR-INVISIBLE", INVISIBLE), ("INSTR-BIDI", BIDI), ("INSTR-TAGCHARS", TAGS)):
        mark = r"\A\x{FEFF}"
        where = f"NOT (off = 0 AND {d.like('hit', mark)})"
        parts.append(f"SELECT skill, path, '{code}', '{CHECKS[code]}', line, col, {point}, cast(NULL as string) FROM ({_matches(d, '@scanned', chars)}) AS m WHERE {where}")
    spans = f"SELECT skill, path, lo, hi FROM @fence UNION ALL SELECT skill, path, off, off + length(hit) FROM ({_matches(d, '(SELECT * FROM @scanned WHERE ' + d.like('text', exact) + ') AS s', INLINE)}) AS m"
    found = _matches(d, "@scanned", exact)
    ascii_ = f"translate(hit, {d.text(''.join(table))}, {d.text(''.join(table.values()))})"
    parts.append(f"""SELECT skill, path, 'INSTR-HOMOGLYPH', '{CHECKS['INSTR-HOMOGLYPH']}', line, col, concat({point}, ' reads as "', {ascii_}, '"'), cast(NULL as string)
        FROM ({found}) AS m WHERE EXISTS (SELECT 1 FROM ({spans}) AS s WHERE s.skill = m.skill AND s.path = m.path AND m.off >= s.lo AND m.off < s.hi)""")
    return " UNION ALL ".join(parts)


def hostile(d: Dialect, x: str) -> str:
    """The first rule in order that a string matches, or null."""
    return "CASE " + " ".join(f"WHEN {d.like(x, _rule(d, j, r))} THEN '{c}'" for c, _, _, j, r in rules()) + " END"


def comment(d: Dialect) -> str:
    """(skill, path, line, col, said): what every HTML comment says."""
    return f"SELECT skill, path, line, col, substr(hit, 5, cast(length(hit) - 7 as int)) AS said FROM ({_matches(d, '@scanned', COMMENT)}) AS c"


def told_comment(d: Dialect) -> str:
    """Comments with the first rule that they match."""
    return f"SELECT skill, path, line, col, said, {hostile(d, 'said')} AS rule FROM @comment"


def told_run(d: Dialect) -> str:
    """Encoded runs with the first rule that their text matches, where it is readable."""
    return f"SELECT skill, path, off, line, col, length, kind, readable, said, {hostile(d, 'said')} AS rule FROM @encoded_run"


def hidden_finding(d: Dialect) -> str:
    """Comments that hold a rule's match or read as directives, encoded runs, escape runs."""
    blocks = ", ".join(f"'{c}'" for c, v, *_ in rules() if v == "BLOCK")
    comments = f"""SELECT skill, path, CASE WHEN rule IS NOT NULL THEN 'INSTR-HIDDENDIRECTIVE' ELSE 'INSTR-HTMLCOMMENT' END AS code, CASE WHEN rule IN ({blocks}) THEN 'BLOCK' ELSE 'REVIEW' END AS sev, line, col, {_excerpt(d, 'said')} AS evidence, rule AS quoted
        FROM @told_comment WHERE rule IS NOT NULL OR {d.like('said', _own(d, DIRECTIVE))}"""
    encoded = f"""SELECT skill, path, CASE WHEN rule IS NOT NULL THEN 'INSTR-ENCODEDPAYLOAD' WHEN kind = 'hex' THEN 'INSTR-HEXBLOB' ELSE 'INSTR-BASE64' END, CASE WHEN rule IS NOT NULL THEN 'BLOCK' ELSE 'REVIEW' END, line, col,
        CASE WHEN said IS NULL THEN concat(length, ' chars') WHEN rule IS NOT NULL THEN {_excerpt(d, 'said')} ELSE {_excerpt(d, 'said', 60)} END, rule FROM @told_run WHERE kind = 'base64' OR readable"""
    escapes = f"SELECT skill, path, 'INSTR-HEXESC', '{CHECKS['INSTR-HEXESC']}', line, col, {_excerpt(d, 'hit', 60)}, cast(NULL as string) FROM ({_matches(d, '@scanned', ESCAPES)}) AS m"
    return " UNION ALL ".join([comments, encoded, escapes])


#: One character of UTF-8 in hex, byte by byte with a space after each; else a single byte, which counts as one.
_CHARACTER = "[0-7][0-9A-F] |(?:C[2-9A-F]|D[0-9A-F]) [89AB][0-9A-F] |E[0-9A-F] (?:[89AB][0-9A-F] ){2}|F[0-4] (?:[89AB][0-9A-F] ){3}|[0-9A-F]{2} "


def encoded_run(d: Dialect) -> str:
    """(skill, path, off, line, col, hit, kind, said, readable): long runs of the base64 alphabet that are no paths, and what they say.

    Hex of odd length says nothing; a run whose letters are 0 to f is hex.
    Readable: more than the fixed share of the characters is printable ASCII.
    """
    kind = f"CASE WHEN {d.like('hit', '^[0-9a-fA-F]+$')} THEN 'hex' ELSE 'base64' END"
    runs = f"SELECT skill, path, off, line, col, hit, {kind} AS kind FROM ({_matches(d, '@scanned', RUN)}) AS m WHERE {d.count('hit', '/')} * 16 <= length(hit)"
    bare = f"SELECT *, {d.sub('hit', '=+$', '')} AS core FROM ({runs}) AS r"
    even = f"SELECT *, substr(core, 1, cast(length(core) - CASE WHEN length(core) % 4 = 1 THEN 1 ELSE 0 END as int)) AS whole FROM ({bare}) AS b"
    padded = "concat(whole, CASE length(whole) % 4 WHEN 2 THEN '==' WHEN 3 THEN '=' ELSE '' END)"
    made = f"SELECT skill, path, off, line, col, hit, kind, CASE WHEN kind = 'base64' THEN {d.from_base64(padded)} WHEN length(hit) % 2 = 0 THEN {d.from_hex('hit')} END AS raw FROM ({even}) AS e"
    spaced = d.sub("hex(raw)", "([0-9A-F]{2})", "$1 ")
    counted = f"SELECT *, {d.count('pairs', '(?:[2-6][0-9A-F]|7[0-9A-E]) ')} AS shown, {d.count('pairs', _CHARACTER)} AS characters FROM (SELECT *, {spaced} AS pairs FROM ({made}) AS m) AS p"
    readable = f"coalesce(shown > {READABLE} * characters, false)"
    return f"SELECT skill, path, off, line, col, length(hit) AS length, kind, CASE WHEN {readable} THEN {d.to_text('raw')} END AS said, {readable} AS readable FROM ({counted}) AS c"


def code_finding(d: Dialect) -> str:
    """Code outside fences, and imports of what is no builtin."""
    code_line = _own(d, CODE_LINE)
    some = f"(SELECT skill, path, text FROM @scanned WHERE NOT is_code AND path LIKE '%.md' AND {d.size(d.kept(d.split('text', chr(10)), 'l', d.like('l', code_line)))} >= {UNFENCED_LEAST}) AS s"
    lines = d.exploded(some, d.split("text", "\n"), "skill, path", "line")
    placed = f"SELECT skill, path, pos, line, sum(length(line) + 1) OVER (PARTITION BY skill, path ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(line) - 1 AS off FROM ({lines}) AS l"
    open_ = f"SELECT skill, path, pos FROM ({placed}) AS p WHERE {d.like('line', code_line)} AND NOT EXISTS (SELECT 1 FROM @fence f WHERE f.skill = p.skill AND f.path = p.path AND p.off >= f.lo AND p.off < f.hi)"
    counted = f"(SELECT o.skill, o.path, o.n, o.first, coalesce(f.n, 0) AS fences FROM (SELECT skill, path, count(*) AS n, min(pos) + 1 AS first FROM ({open_}) AS o GROUP BY skill, path) AS o LEFT JOIN (SELECT skill, path, count(*) AS n FROM @fence GROUP BY skill, path) AS f ON f.skill = o.skill AND f.path = o.path) AS u"
    imports = _matches(d, "(SELECT skill, path, text FROM @scanned WHERE is_code) AS s", ascii_classes(IMPORT))
    name = d.first("hit", ascii_classes(IMPORT), 1)
    return " UNION ALL ".join([
        _row("STRUCT-UNFENCEDCODE", counted, line="cast(first as int)", col="1", evidence="concat(n, ' lines, ', fences, ' fenced block(s)')", where=f"n >= {UNFENCED_LEAST}"),
        f"SELECT skill, path, 'EXEC-DEPENDENCY', '{CHECKS['EXEC-DEPENDENCY']}', line, col, name, cast(NULL as string) FROM (SELECT *, {name} AS name FROM ({imports}) AS m) AS n WHERE name NOT LIKE 'node:%'",
    ])


def excluded(d: Dialect, path: str, globs: tuple[str, ...] = EXCLUDED) -> str:
    """Whether a path, or its last part, matches one of the globs."""
    base = d.first(path, "([^/]+)$")
    return "(" + (" OR ".join(f"{d.like(x, glob_pattern(g))}" for g in globs for x in (path, base)) or "false") + ")"


def finding(d: Dialect) -> str:
    """(skill, path, code, sev, line, col, evidence, quoted, excluded): every finding of the scan."""
    parts = ("layout_finding", "front_finding", "reference_finding", "rule_finding", "disguise_finding", "hidden_finding", "code_finding")
    return f"SELECT skill, path, code, sev, line, col, evidence, {fragment(d, 'quoted')} AS quoted, {excluded(d, 'path')} AS excluded FROM ({' UNION ALL '.join(f'SELECT * FROM @{p}' for p in parts)}) AS f"


_RANK = "CASE sev WHEN 'BLOCK' THEN 0 WHEN 'REVIEW' THEN 1 ELSE 2 END"


def agg_1_verdict(d: Dialect) -> str:
    """Findings that count, those set apart, the verdict and the exit code of every package, clean ones too."""
    n = lambda sev: f"count(CASE WHEN f.sev = '{sev}' AND NOT f.excluded THEN 1 END)"
    case = lambda i: f"CASE WHEN blocks > 0 THEN {_lit(VERDICTS['BLOCK'][i])} WHEN reviews > 0 THEN {_lit(VERDICTS['REVIEW'][i])} ELSE {_lit(VERDICTS['NOTE'][i])} END"
    return f"""SELECT skill, blocks, reviews, notes, excluded, {case(0)} AS verdict, {case(1)} AS exit_code
        FROM (SELECT h.skill, {n('BLOCK')} AS blocks, {n('REVIEW')} AS reviews, {n('NOTE')} AS notes, count(CASE WHEN f.excluded THEN 1 END) AS excluded
              FROM (SELECT skill FROM @raw_file GROUP BY skill) AS h LEFT JOIN @finding f ON f.skill = h.skill GROUP BY h.skill) AS g"""


def _lit(v) -> str:
    return f"'{v}'" if isinstance(v, str) else str(v)


def top_1_order(d: Dialect) -> str:
    """Place of each finding in its package: worst severity first, then file, line, and, to settle ties, column, code and evidence."""
    return f"SELECT skill, path, code, sev, line, col, evidence, excluded, row_number() OVER (PARTITION BY skill ORDER BY {_RANK}, path, coalesce(line, 0), coalesce(col, 0), code, coalesce(evidence, ''), coalesce(quoted, '')) AS place FROM @finding"


def top_6_first_block(d: Dialect) -> str:
    """The first finding that blocks each package, in the order of findings, as a refusal words it."""
    return f"SELECT skill, path, code, line, evidence FROM (SELECT *, row_number() OVER (PARTITION BY skill ORDER BY path, coalesce(line, 0), coalesce(col, 0), code, coalesce(evidence, ''), coalesce(quoted, '')) AS place FROM @finding WHERE sev = 'BLOCK' AND NOT excluded) AS f WHERE place = 1"


def prj_1_route(d: Dialect) -> str:
    """Where every file goes: archive, binary or text, from its bytes."""
    return "SELECT skill, path, bytes, route, archive FROM @routed"


def prj_4_frontmatter(d: Dialect) -> str:
    """Keys and values with their lines; of a repeated key the last counts."""
    return "SELECT skill, key, value, line, n > 1 AS duplicate FROM @front WHERE back = 1"


def win_8_duplicate_keys(d: Dialect) -> str:
    return "SELECT skill, key, n FROM @front WHERE back = 1 AND n > 1"


def prj_7_excluded(d: Dialect) -> str:
    """Files that the globs exclude, by path or by name, and how many of their findings are set apart."""
    return f"SELECT f.skill, f.path, {excluded(d, 'f.path')} AS excluded, coalesce(n.n, 0) AS set_apart FROM @raw_file f LEFT JOIN (SELECT skill, path, count(*) AS n FROM @finding WHERE excluded GROUP BY skill, path) AS n ON n.skill = f.skill AND n.path = f.path"


def prj_8_withheld(d: Dialect) -> str:
    """Findings whose evidence is withheld: it is null, what the reason would quote is a mark, and all else stays."""
    return "SELECT skill, path, code, sev, line, col, cast(NULL as string) AS evidence, CASE WHEN quoted IS NOT NULL THEN '[withheld]' END AS quoted, excluded FROM @finding"


def prj_9_quiet(d: Dialect) -> str:
    """Findings as a quiet report shows them: notes are left out here, and counted in the verdict all the same."""
    return "SELECT skill, path, code, sev, line FROM @finding WHERE sev <> 'NOTE'"


def prj_10_home_paths(d: Dialect) -> str:
    """Home paths that are reported; those of the package itself or of packages' scripts are not."""
    return "SELECT skill, path, line, col, evidence FROM @rule_finding WHERE code = 'EXEC-HOMEPATH'"


def scan_11_nul_bytes(d: Dialect) -> str:
    return "SELECT skill, path, line, col, evidence FROM @layout_finding WHERE code = 'STRUCT-NULBYTE'"


def scan_12_layout(d: Dialect) -> str:
    """Files that mean a bundle or another harness, packages without a spine, archives and binaries."""
    return "SELECT skill, path, code, sev, quoted FROM @layout_finding WHERE code <> 'STRUCT-NULBYTE'"


def scan_13_frontmatter_checks(d: Dialect) -> str:
    """Everything wrong with a package's frontmatter, one row per problem."""
    return "SELECT skill, code, sev, line, evidence FROM @front_finding"


def scan_7_encoded_runs(d: Dialect) -> str:
    """Long runs that are no paths: hex or base64, whether they read as text, and the rule that the text matches."""
    return "SELECT skill, path, off, length, kind, readable, rule FROM @told_run"


def scan_4_hidden_chars(d: Dialect) -> str:
    """Every hidden, reordering and tag character with its place and code point; a byte-order mark that opens a file is none."""
    return "SELECT skill, path, code, line, col, evidence FROM @disguise_finding WHERE code IN ('INSTR-INVISIBLE', 'INSTR-BIDI', 'INSTR-TAGCHARS')"


def scan_5_homoglyphs(d: Dialect) -> str:
    """Look-alike characters inside fences and inline code, with what they look like."""
    return "SELECT skill, path, line, col, evidence FROM @disguise_finding WHERE code = 'INSTR-HOMOGLYPH'"


def scan_9_unfenced_code(d: Dialect) -> str:
    return "SELECT skill, path, line, evidence FROM @code_finding WHERE code = 'STRUCT-UNFENCEDCODE'"


def scan_10_imports(d: Dialect) -> str:
    """Packages that code imports and that are no builtin."""
    return "SELECT skill, path, line, evidence AS name FROM @code_finding WHERE code = 'EXEC-DEPENDENCY'"


def join_11_dead_references(d: Dialect) -> str:
    """Paths that a package's files refer to and that it has not; the first file that does."""
    return "SELECT skill, target, referrer FROM @dead_reference"


def join_12_orphans(d: Dialect) -> str:
    """Files in the four folders that nothing names: a note if the folder is named, else a review."""
    return "SELECT skill, path, CASE WHEN named THEN 'NOTE' ELSE 'REVIEW' END AS sev FROM @unmentioned"


def snk_1_findings(d: Dialect) -> str:
    """What the findings table holds of each severity, and of how many packages."""
    return "SELECT sev, code, count(*) AS n, count(DISTINCT skill) AS packages, count(CASE WHEN excluded THEN 1 END) AS set_apart FROM @finding GROUP BY sev, code"


RELATIONS = (routed, scanned, fence, spine, front, known_as, mention, dead_reference, unmentioned, layout_finding, front_finding, reference_finding, rule_finding, disguise_finding, encoded_run, comment, told_comment, told_run, hidden_finding, code_finding, finding)
OPS = (agg_1_verdict, top_1_order, top_6_first_block, prj_1_route, prj_4_frontmatter, win_8_duplicate_keys, prj_7_excluded, prj_8_withheld, prj_9_quiet, prj_10_home_paths, scan_11_nul_bytes, scan_12_layout, scan_13_frontmatter_checks, scan_7_encoded_runs, scan_4_hidden_chars, scan_5_homoglyphs, scan_9_unfenced_code, scan_10_imports, join_11_dead_references, join_12_orphans, snk_1_findings)
