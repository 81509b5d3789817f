"""Projections of files and lines: roles, leaves, words, anchors, links, contracts, records."""

from __future__ import annotations

from ..functions.dialect import Dialect

def prj_3_roles(d: Dialect) -> str:
    head = "split_part(path, '/', 1)"
    return f"SELECT skill, path, CASE WHEN path = 'SKILL.md' THEN 'spine' WHEN path = 'AUDIT.md' THEN 'audit' WHEN path = 'ORIGIN.md' THEN 'origin' WHEN {head} = 'references' THEN 'ref' WHEN {head} = 'assets' THEN 'asset' WHEN {head} = 'agents' THEN 'agent' WHEN {head} = 'scripts' THEN 'script' WHEN path NOT LIKE '%/%' AND path LIKE '%.md' THEN 'ref' ELSE 'other' END AS role FROM @file"


def prj_5_held(d: Dialect) -> str:
    return "SELECT DISTINCT f.skill FROM @file f WHERE f.skill NOT LIKE '.%' AND EXISTS (SELECT 1 FROM @file s WHERE s.skill = f.skill AND s.path = 'SKILL.md')"


def prj_6_manual_only(d: Dialect) -> str:
    """Whether the frontmatter of each package's spine keeps it for calls by hand; without frontmatter it does not."""
    return "SELECT p.skill, coalesce(f.yes, 0) = 1 AS manual_only FROM (SELECT skill FROM @file WHERE path = 'SKILL.md' GROUP BY skill) AS p LEFT JOIN (SELECT skill, max(CASE WHEN lower(value) = 'true' THEN 1 ELSE 0 END) AS yes FROM @front f WHERE key = 'disable-model-invocation' AND back = 1 GROUP BY skill) AS f ON f.skill = p.skill"


def prj_12_leaves(d: Dialect) -> str:
    leaf = "^(references|assets|agents)/([^/.][^/]*)$"
    return f"SELECT concat(skill, '/', {d.first('path', leaf, 2)}) AS leaf, {d.first('path', leaf, 1)} AS kind, path, {d.count('text', r'[^ \t\r\n\f\v]+')} AS words FROM @file WHERE {d.like('path', leaf)}"


def agg_19_words(d: Dialect) -> str:
    """Words of each package's spine and of its other texts."""
    n = d.count("text", r"[^ \t\r\n\f\v]+")
    return f"SELECT skill, cast(sum(CASE WHEN path = 'SKILL.md' THEN n ELSE 0 END) as bigint) AS spine, cast(sum(CASE WHEN path LIKE 'references/%' THEN n ELSE 0 END) as bigint) AS halo FROM (SELECT skill, path, {n} AS n FROM @file) AS w GROUP BY skill"


def agg_19_turn_words(d: Dialect) -> str:
    return f"SELECT conv_id, count(*) AS turns, cast(sum({d.count('text', r'[^ \t\r\n\f\v]+')}) as bigint) AS words FROM @conversations GROUP BY conv_id"


def _slugs(d: Dialect) -> str:
    title = d.first("line", r"^#{1,6}[ ]+(.*)$")
    slug = d.sub(d.sub(f"lower(trim({title}))", r"[^\p{L}\p{N} -]", ""), "[ ]+", "-")
    return f"SELECT skill, path, pos, {slug} AS slug FROM @line WHERE {d.like('line', '^#{1,6}[ ]+')}"


def fn_5_slugs(d: Dialect) -> str:
    return f"SELECT skill, path, pos, slug FROM ({_slugs(d)}) AS s"


def win_4_anchors(d: Dialect) -> str:
    """Heading anchors; the n-th repeat of a slug gets -n."""
    return f"SELECT skill, path, pos + 1 AS line, CASE WHEN n = 1 THEN slug ELSE concat(slug, '-', n - 1) END AS anchor FROM (SELECT *, row_number() OVER (PARTITION BY skill, path, slug ORDER BY pos) AS n FROM ({_slugs(d)}) AS s) AS a"


def win_7_sections(d: Dialect) -> str:
    """Lines of each file under each heading.

    Where a package has a path twice, lines of one place lie under the heading that
    is at that place in either file, whatever order they come in: the frame takes peers in.
    """
    last = "last_value(CASE WHEN line LIKE '# %' THEN pos END IGNORE NULLS) OVER (PARTITION BY skill, path ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)" if d.name == "duckdb" else "last(CASE WHEN line LIKE '# %' THEN pos END, true) OVER (PARTITION BY skill, path ORDER BY pos RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"SELECT skill, path, coalesce(section, -1) AS section, count(*) AS lines FROM (SELECT skill, path, {last} AS section FROM @line) AS s GROUP BY skill, path, coalesce(section, -1)"


def fn_8_links(d: Dialect) -> str:
    """Targets of links in pages, with their hosts."""
    each = d.exploded("@pages", d.all("html", r'href="([^"]*)"', 1), "page_id", "target")
    return f"SELECT page_id, pos, target, nullif({d.first('target', '^https?://([^/?#]+)')}, '') AS host, CASE WHEN {d.like('target', '^[a-z][a-z0-9+.-]*:')} THEN 'external' WHEN target LIKE '#%' THEN 'anchor' ELSE 'path' END AS kind FROM ({each}) AS l"


def fn_8_urls(d: Dialect) -> str:
    each = d.exploded("@file", d.all("text", r"https?://[^ \t\r\n\f\v<>()\[\]\"'`]+"), "skill, path", "url")
    return f"SELECT skill, path, pos, url, {d.first('url', '^https?://([^/?#]+)')} AS host FROM ({each}) AS u"


def fn_7_source_url(d: Dialect) -> str:
    """Repository, ref and folder of a source address; a blob address is refused."""
    tree = r"^https://github\.com/([^/]+/[^/]+)/tree/([^/]+)/?(.*)$"
    return f"SELECT page_id, repo, ref, sub, blob FROM (SELECT page_id, nullif({d.first('u', tree, 1)}, '') AS repo, nullif({d.first('u', tree, 2)}, '') AS ref, nullif({d.first('u', tree, 3)}, '') AS sub, u LIKE '%/blob/%' AS blob FROM (SELECT page_id, concat('https://github.com/own/', {d.sub('url', '[^A-Za-z0-9]+', '-')}, CASE WHEN page_id % 3 = 0 THEN '/blob/main/x' ELSE concat('/tree/v', page_id, '/skills/a') END) AS u FROM @pages) AS a) AS b"


def fn_9_pins(d: Dialect) -> str:
    """path:line:col of each first line of the documents' second words, parsed back."""
    pin = r"^(.*?):([0-9]+)(?::([0-9]+))?$"
    return f"SELECT skill, {d.first('pin', pin, 1)} AS path, cast({d.first('pin', pin, 2)} as int) AS line, cast(nullif({d.first('pin', pin, 3)}, '') as int) AS col FROM (SELECT skill, concat(path, ':', pos + 1, CASE WHEN pos % 2 = 0 THEN concat(':', length(line) + 1) ELSE '' END) AS pin FROM @line) AS p"


def fn_11_safe_names(d: Dialect) -> str:
    return f"SELECT name, {d.like('name', '^[a-z0-9][a-z0-9-]*$')} AS safe FROM (SELECT skill AS name FROM @pkg UNION SELECT skill FROM @event) AS n"


def fn_14_decision_rows(d: Dialect) -> str:
    """Text of a decision's row: bars replaced, hash shortened."""
    return "SELECT p.skill, concat('| ', p.skill, ' | ', replace(p.description, '|', '/'), ' | ', substr(k.sha256, 1, 7), ' |') AS line FROM @pkg p JOIN @disk k ON k.skill = p.skill AND k.path = 'SKILL.md'"


#: Records made of labels: a verdict, and a table of findings where quality is bad.
_RECORD = "SELECT doc_id, concat('| **Verdict** | ', CASE WHEN toxic = 1 THEN 'REJECT' WHEN quality = 1 THEN 'ADOPT' ELSE '<menu>' END, ' |', CASE WHEN quality = 0 THEN concat(chr(10), '| 1 | `INSTR-OVERRIDE` | SKILL.md:1 | ', CASE WHEN doc_id % 2 = 0 THEN 'accepted' ELSE 'undecided' END, ' | x |', chr(10), '| 2 | `EXEC-EVAL` | scripts/run.sh:2 | ', CASE WHEN doc_id % 3 = 0 THEN 'open' ELSE 'false positive' END, ' | y |') ELSE '' END) AS text FROM @labels"


def agg_13_audit(d: Dialect) -> str:
    """Verdict, findings and whether all are decided, of each record; null where there is no table."""
    verdict = d.first("text", r"\|[ ]*\*\*Verdict\*\*[ ]*\|[ *]*(ADOPT|REVISE|REJECT)", 1)
    row = r"(?m)^\|[ ]*[0-9]+[ ]*\|[ ]*`?[A-Z]+-[A-Z0-9]+`?[ ]*\|[^|]*\|"
    decided = row + "[ ]*(?:real|accepted|false positive|fixed|removed|n/a)"
    return f"SELECT doc_id, nullif({verdict}, '') AS verdict, nullif({d.count('text', row)}, 0) AS findings, CASE WHEN {d.count('text', row)} > 0 THEN {d.count('text', decided)} = {d.count('text', row)} END AS dispositioned FROM ({_RECORD}) AS r"


#: Structured records out of labels: mostly valid, every kind of violation by the id.
_JSON = """SELECT doc_id, concat('{"schemaVersion":', CASE WHEN doc_id % 41 = 0 THEN '2' ELSE '1' END, ',"skill":"doc-', doc_id, '","state":"', CASE WHEN toxic = 1 THEN 'blocked' ELSE 'certified' END, '"', CASE WHEN doc_id % 3 = 0 THEN '' ELSE ',"by":"x"' END, CASE WHEN doc_id % 37 = 0 THEN '' ELSE '}' END) AS line FROM @labels"""


def src_8_records(d: Dialect) -> str:
    """Fields of structured records; a broken record is kept, with nulls."""
    ok = d.valid_json("line")
    return f"SELECT doc_id, {ok} AS ok, CASE WHEN {ok} THEN {d.json('line', '$.skill')} END AS skill, CASE WHEN {ok} THEN {d.json('line', '$.state')} END AS state, CASE WHEN {ok} THEN {d.json('line', '$.by')} END AS signer, CASE WHEN {ok} THEN {d.json('line', '$.schemaVersion')} END AS version FROM ({_JSON}) AS j"


def fn_4_fragments(d: Dialect) -> str:
    """Each package's description on one line, cut at 60 characters with a mark."""
    flat = d.sub("description", "[ \t\r\n\f\v]+", " ")
    return f"SELECT skill, CASE WHEN length(f) > 60 THEN concat(substr(f, 1, 60), '…') ELSE f END AS fragment FROM (SELECT skill, trim({flat}) AS f FROM @pkg) AS x"


def _pins(d: Dialect) -> str:
    """Findings to pin: a place in a file and an excerpt, some beyond the file, some of another line."""
    return "SELECT l.skill, l.path, CASE WHEN l.pos % 5 = 4 THEN l.pos + 100000 ELSE l.pos + 1 END AS line, CASE WHEN l.pos % 3 = 2 THEN 'not on this line' WHEN length(l.line) > 20 THEN concat(substr(l.line, 1, 20), '…') ELSE l.line END AS excerpt FROM @line l"


def join_20_pinned(d: Dialect) -> str:
    """Findings pinned to lines: the line must exist, and its folded text must have the folded excerpt."""
    fold = lambda x: f"trim({d.sub(x, '[ ' + chr(92) + 't' + chr(92) + 'r' + chr(92) + 'n' + chr(92) + 'f' + chr(92) + 'v]+', ' ')})"
    needle = f"rtrim({d.sub(fold('p.excerpt'), '…$', '')})"
    inside = f"contains({fold('l.line')}, {needle})"
    return f"SELECT p.skill, p.path, p.line, l.line IS NOT NULL AS on_line, coalesce({needle} <> '' AND {inside}, false) AS excerpt_matches FROM ({_pins(d)}) AS p LEFT JOIN @line l ON l.skill = p.skill AND l.path = p.path AND l.pos + 1 = p.line"


OPS = (fn_4_fragments, join_20_pinned, prj_3_roles, prj_5_held, prj_6_manual_only, prj_12_leaves, agg_19_words, agg_19_turn_words, fn_5_slugs, win_4_anchors, win_7_sections, fn_8_links, fn_8_urls, fn_7_source_url, fn_9_pins, fn_11_safe_names, fn_14_decision_rows, agg_13_audit, src_8_records)
