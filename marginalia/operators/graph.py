"""Catalog checks and the graph of packages, sources, decisions and links."""

from __future__ import annotations

from ..functions.dialect import Dialect, placed


def src_3_catalog(d: Dialect) -> str:
    return "SELECT skill, category FROM @pkg WHERE category IS NOT NULL"


def src_4_edges(d: Dialect) -> str:
    return "SELECT from_id, to_id, type, status FROM @edge"


def join_7_unfiled(d: Dialect) -> str:
    """Packages that the catalog does not file."""
    return "SELECT p.skill FROM @pkg p WHERE NOT EXISTS (SELECT 1 FROM @catalog c WHERE c.skill = p.skill)"


def join_8_filed_missing(d: Dialect) -> str:
    """Entries of the catalog that have no package, with the category that files them."""
    return "SELECT c.category, c.skill FROM @catalog c WHERE NOT EXISTS (SELECT 1 FROM @pkg p WHERE p.skill = c.skill)"


_CHECK = """SELECT e.from_id, e.to_id, e.type, CASE WHEN e.type = 'overlaps' THEN 'measured, not declared' WHEN f.skill IS NULL THEN 'from not held'
      WHEN t.skill IS NULL AND r.name IS NULL AND e.status IS DISTINCT FROM 'gap' THEN 'target resolves to nothing'
      WHEN e.type = 'operative' AND t.skill IS NULL THEN 'operative at not held' WHEN e.type = 'operative' AND t.manual_only THEN 'operative at manual-only'
      WHEN e.type = 'operative' AND c.callee IS NULL THEN 'warning: never called' WHEN e.type <> 'operative' AND c.callee IS NOT NULL THEN 'warning: called' END AS problem
    FROM @edge e LEFT JOIN @pkg f ON f.skill = e.from_id LEFT JOIN @pkg t ON t.skill = e.to_id LEFT JOIN (SELECT name FROM @rejected GROUP BY name) AS r ON r.name = e.to_id LEFT JOIN @call c ON c.skill = e.from_id AND c.callee = e.to_id"""


def join_9_edge_checks(d: Dialect) -> str:
    return f"SELECT from_id, to_id, type, problem FROM ({_CHECK}) AS x WHERE problem IS NOT NULL"


def join_10_undeclared_mentions(d: Dialect) -> str:
    """Packages whose prose names another by a hyphenated name, with no edge that declares it."""
    words = d.exploded("(SELECT skill, text FROM @file WHERE path = 'SKILL.md')", d.all("text", "[a-z0-9-]+"), "skill", "token")
    return f"""SELECT DISTINCT w.skill, w.token AS name FROM ({words}) AS w JOIN (SELECT skill AS name FROM @pkg UNION SELECT name FROM @rejected) AS k ON k.name = w.token
        WHERE w.token <> w.skill AND w.token LIKE '%-%' AND NOT EXISTS (SELECT 1 FROM @edge e WHERE e.from_id = w.skill AND e.to_id = w.token)"""


def join_18_resolution(d: Dialect) -> str:
    """What each edge target is: a package, a refused or declined name, or a ghost."""
    return "SELECT DISTINCT e.to_id AS name, CASE WHEN p.skill IS NOT NULL THEN 'skill' WHEN r.kind IS NOT NULL THEN r.kind ELSE 'ghost' END AS what FROM @edge e LEFT JOIN @pkg p ON p.skill = e.to_id LEFT JOIN (SELECT name, max(kind) AS kind FROM @rejected GROUP BY name) AS r ON r.name = e.to_id"


def join_21_dangling(d: Dialect) -> str:
    return "SELECT 'from' AS side, l.a AS id, l.kind FROM @link l WHERE NOT EXISTS (SELECT 1 FROM @node n WHERE n.id = l.a AND n.kind <> 'ghost') UNION ALL SELECT 'to', l.b, l.kind FROM @link l WHERE NOT EXISTS (SELECT 1 FROM @node n WHERE n.id = l.b AND n.kind <> 'ghost')"


def join_22_manual_operative(d: Dialect) -> str:
    return "SELECT e.from_id, e.to_id FROM @edge e WHERE e.type = 'operative' AND EXISTS (SELECT 1 FROM @pkg p WHERE p.skill = e.to_id AND p.manual_only)"


def fn_6_repo_slug(d: Dialect) -> str:
    slug = d.sub(d.first("url", r"github\.com/([^/]+/[^/#?]+)"), r"\.git$", "")
    return f"SELECT name, url, nullif({slug}, '') AS slug FROM @rejected"


def join_23_vendor(d: Dialect) -> str:
    """Rejected names with the vendor whose repository they came from."""
    return f"SELECT r.name, r.slug, v.vendor FROM ({fn_6_repo_slug(d)}) AS r LEFT JOIN (SELECT DISTINCT concat(lang, '/', source) AS vendor FROM @pkg) AS v ON v.vendor = r.slug"


def join_24_category(d: Dialect) -> str:
    return "SELECT skill, coalesce(category, 'unfiled') AS category FROM @pkg"


def agg_16_vendors(d: Dialect) -> str:
    """Every adopted package's name under its vendor, with how many packages came from there; a null vendor is one too."""
    vendor = "concat(lang, '/', source)"
    return f"SELECT v.vendor, v.adopted, p.skill AS name FROM @pkg p JOIN (SELECT {vendor} AS vendor, count(*) AS adopted FROM @pkg GROUP BY {vendor}) AS v ON v.vendor IS NOT DISTINCT FROM concat(p.lang, '/', p.source)"


def agg_17_ghosts(d: Dialect) -> str:
    """Names that resolve to nothing, a row for each package that refers to them."""
    named = "SELECT from_id AS skill, to_id AS name FROM @edge UNION SELECT skill, callee FROM @call"
    return f"SELECT name, skill AS referrer FROM ({named}) AS n WHERE NOT EXISTS (SELECT 1 FROM @pkg p WHERE p.skill = n.name) AND NOT EXISTS (SELECT 1 FROM @rejected r WHERE r.name = n.name)"


def agg_18_duplicates(d: Dialect) -> str:
    """Ids that several nodes have, and paths that a package has twice."""
    return "SELECT 'node' AS what, id, count(*) AS n FROM @node GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'path', concat(skill, '/', path), count(*) FROM @file GROUP BY concat(skill, '/', path) HAVING count(*) > 1 UNION ALL SELECT 'total', 'all', count(*) FROM @node"


def agg_20_degrees(d: Dialect) -> str:
    """Degree of every node; 0: an orphan."""
    return "SELECT n.kind, n.id, count(e.id) AS degree FROM @node n LEFT JOIN (SELECT a AS id FROM @link UNION ALL SELECT b FROM @link) AS e ON e.id = n.id GROUP BY n.kind, n.id"


def agg_20_kinds(d: Dialect) -> str:
    return "SELECT kind, count(*) AS nodes FROM @node GROUP BY kind"


def agg_21_adjacency(d: Dialect) -> str:
    """Neighbours of every node by kind of edge and direction: how many, and a fold of their ids that no order changes."""
    both = "SELECT a AS id, kind, 'out' AS direction, b AS other FROM @link UNION SELECT b, kind, 'in', a FROM @link"
    return f"SELECT id, kind, direction, count(*) AS n, bit_xor({d.number_of('other')}) AS neighbours_fold FROM ({both}) AS x GROUP BY id, kind, direction"


def agg_22_calls(d: Dialect) -> str:
    return "SELECT skill, callee FROM @call"


def agg_26_script_fold(d: Dialect) -> str:
    return f"SELECT skill, count(*) AS scripts, {d.joined('path')} AS files FROM @file WHERE path LIKE 'scripts/%' GROUP BY skill"


def agg_27_library_check(d: Dialect) -> str:
    """Problems of each library (here: a source) and its exit code."""
    problems = f"SELECT from_id AS skill, 'edge' AS what FROM ({_CHECK}) AS x WHERE problem IS NOT NULL AND problem NOT LIKE 'warning%' UNION ALL SELECT skill, 'unfiled' FROM @pkg WHERE category IS NULL UNION ALL SELECT skill, 'ledger' FROM @disk k WHERE NOT EXISTS (SELECT 1 FROM @ledger_file l WHERE l.skill = k.skill AND l.path = k.path AND l.sha256 = k.sha256)"
    n = lambda w: f"cast(sum(CASE WHEN q.what = '{w}' THEN 1 ELSE 0 END) as bigint)"
    return f"SELECT p.source AS library, {n('edge')} AS edges, {n('unfiled')} AS unfiled, {n('ledger')} AS ledger, CASE WHEN count(q.what) > 0 THEN 1 ELSE 0 END AS code FROM @pkg p LEFT JOIN ({problems}) AS q ON q.skill = p.skill GROUP BY p.source"


def win_3_first_rejected(d: Dialect) -> str:
    return "SELECT name, kind, url FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY pos) AS k FROM @rejected) AS r WHERE k = 1"


def snk_6_append_rejected(d: Dialect) -> str:
    """Ghost names that may be appended: a name that is there already is refused."""
    return "SELECT g.to_id AS name, min(g.from_id) AS first_from FROM @edge g WHERE NOT EXISTS (SELECT 1 FROM @rejected r WHERE r.name = g.to_id) AND NOT EXISTS (SELECT 1 FROM @pkg p WHERE p.skill = g.to_id) GROUP BY g.to_id"


def top_7_node_order(d: Dialect) -> str:
    """Place of every node in a listing: by kind, then by id."""
    rank = "CASE kind WHEN 'skill' THEN 0 WHEN 'leaf' THEN 1 WHEN 'script' THEN 2 WHEN 'category' THEN 3 WHEN 'vendor' THEN 4 WHEN 'refused' THEN 5 WHEN 'declined' THEN 6 ELSE 7 END"
    return placed("SELECT kind, id FROM @node", "kind, id", f"concat({rank}, substr(id, 1, 8))", f"{rank}, id")


def set_1_nodes(d: Dialect) -> str:
    return "SELECT kind, id FROM @node"


def set_2_edges(d: Dialect) -> str:
    return "SELECT kind, a, b, round(weight, 6) AS weight FROM @link"


def grph_1_graph(d: Dialect) -> str:
    ids = "(SELECT id FROM @node GROUP BY id)"
    return f"SELECT l.kind, l.a, l.b, round(l.weight, 6) AS weight, x.id IS NOT NULL AND y.id IS NOT NULL AS resolved FROM @link l LEFT JOIN {ids} AS x ON x.id = l.a LEFT JOIN {ids} AS y ON y.id = l.b"


def grph_2_overlap_edges(d: Dialect) -> str:
    """Measured overlaps whose both ends are packages of the graph."""
    return "SELECT c.covers AS a, c.covered AS b, round(c.coverage, 6) AS weight FROM @coverer c JOIN (SELECT skill FROM @pkg GROUP BY skill) AS x ON x.skill = c.covers JOIN (SELECT skill FROM @pkg GROUP BY skill) AS y ON y.skill = c.covered"


#: Weight of an edge in the neighbourhood that does not touch the focus, how many hops the neighbourhood has, and how many are walked; fixed values.
NEARBY, NEARBY_DEPTH, DEPTH = 0.45, 2, 3


def step(d: Dialect) -> str:
    """(x, y): edges of every kind in both directions; loops are none."""
    return "SELECT a AS x, b AS y FROM @link WHERE a <> b UNION SELECT b, a FROM @link WHERE a <> b"


def focus(d: Dialect) -> str:
    """Nodes whose neighbourhood is asked for: rejected names that an edge reaches."""
    return "SELECT DISTINCT r.name AS focus FROM @rejected r JOIN @edge e ON e.to_id = r.name"


def hidden(d: Dialect) -> str:
    """Nodes that are not shown, and so not walked: hubs that gather packages."""
    return "SELECT id FROM @node WHERE kind IN ('category', 'vendor')"


def _grown(k: int):
    def grown(d: Dialect) -> str:
        seen = f"@reach_{'abc'[k - 2]}" if k > 1 else "(SELECT focus, focus AS id, 0 AS depth FROM @focus)"
        new = f"SELECT DISTINCT s.focus, e.y AS id FROM {seen} AS s JOIN @step e ON e.x = s.id WHERE s.depth = {k - 1} AND NOT EXISTS (SELECT 1 FROM @hidden h WHERE h.id = e.y)"
        return f"SELECT focus, id, depth FROM {seen} AS s UNION ALL SELECT n.focus, n.id, {k} FROM ({new}) AS n WHERE NOT EXISTS (SELECT 1 FROM {seen} AS s WHERE s.focus = n.focus AND s.id = n.id)"

    grown.__name__ = f"reach_{'abc'[k - 1]}"
    grown.__doc__ = f"(focus, id, depth): nodes within {k} hops; each frontier is joined once, and what was reached before stays out."
    return grown


def grph_3_neighbourhood(d: Dialect) -> str:
    """Depth, three at most, of the nodes around each focus; hidden nodes are not walked."""
    return "SELECT focus, id, depth FROM @reach_c"


def grph_3_edge_tiers(d: Dialect) -> str:
    """Edges of each neighbourhood: 1 where they touch the focus, a nearby weight where both ends are within two hops; all others have 0 and no row."""
    touch = "SELECT f.focus, l.kind, l.a, l.b FROM @focus f JOIN @link l ON l.a = f.focus UNION SELECT f.focus, l.kind, l.a, l.b FROM @focus f JOIN @link l ON l.b = f.focus"
    near = f"SELECT DISTINCT x.focus, l.kind, l.a, l.b FROM @reach_c x JOIN @link l ON l.a = x.id JOIN @reach_c y ON y.focus = x.focus AND y.id = l.b WHERE x.depth <= {NEARBY_DEPTH} AND y.depth <= {NEARBY_DEPTH} AND l.a <> x.focus AND l.b <> x.focus"
    return f"SELECT focus, kind, a, b, cast(1 as double) AS tier FROM ({touch}) AS t UNION ALL SELECT focus, kind, a, b, cast({NEARBY} as double) FROM ({near}) AS n"


def grph_4_integrity(d: Dialect) -> str:
    return f"SELECT 'dangling' AS what, count(*) AS n FROM ({join_21_dangling(d)}) AS a UNION ALL SELECT 'manual', count(*) FROM ({join_22_manual_operative(d)}) AS b UNION ALL SELECT 'duplicate', count(*) FROM (SELECT id FROM @node GROUP BY id HAVING count(*) > 1) AS c UNION ALL SELECT 'duplicate path', count(*) FROM (SELECT skill, path FROM @raw_file GROUP BY skill, path HAVING count(*) > 1) AS p"


OPS = (src_3_catalog, src_4_edges, join_7_unfiled, join_8_filed_missing, join_9_edge_checks, join_10_undeclared_mentions, join_18_resolution, join_21_dangling, join_22_manual_operative, fn_6_repo_slug, join_23_vendor, join_24_category, agg_16_vendors, agg_17_ghosts, agg_18_duplicates, agg_20_degrees, agg_20_kinds, agg_21_adjacency, agg_22_calls, agg_26_script_fold, agg_27_library_check, win_3_first_rejected, snk_6_append_rejected, top_7_node_order, set_1_nodes, set_2_edges, grph_1_graph, grph_2_overlap_edges, grph_3_neighbourhood, grph_3_edge_tiers, grph_4_integrity)
RELATIONS = (step, focus, hidden, *map(_grown, (1, 2, 3)))
