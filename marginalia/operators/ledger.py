"""Inventories: hashes on disk, on record and upstream, and how they differ."""

from __future__ import annotations

from ..functions.dialect import Dialect


def agg_11_inventory(d: Dialect) -> str:
    """Files of each package, and one hash over its sorted inventory."""
    return f"SELECT skill, count(*) AS files, {d.sha(d.joined('entry'))} AS inventory_sha256 FROM (SELECT skill, concat(path, '=', sha256) AS entry FROM @disk) AS e GROUP BY skill"


def join_13_hash_verdict(d: Dialect) -> str:
    return "SELECT k.skill, k.path, CASE WHEN l.sha256 IS NULL THEN 'unlisted' WHEN l.sha256 = k.sha256 THEN 'matches' ELSE 'drift' END AS verdict FROM @disk k LEFT JOIN @ledger_file l ON l.skill = k.skill AND l.path = k.path"


def join_14_missing(d: Dialect) -> str:
    return "SELECT l.skill, l.path FROM @ledger_file l WHERE NOT EXISTS (SELECT 1 FROM @disk k WHERE k.skill = l.skill AND k.path = l.path)"


def join_16_upstream_drift(d: Dialect) -> str:
    """Every path of arrival and upstream: same, changed, inconclusive (it was adapted here), removed or added."""
    return """SELECT coalesce(a.skill, u.skill) AS skill, coalesce(a.path, u.path) AS path, CASE WHEN u.path IS NULL THEN 'removed' WHEN a.path IS NULL THEN 'added' WHEN a.sha256 = u.sha256 THEN 'same' WHEN x.path IS NOT NULL THEN 'inconclusive' ELSE 'changed' END AS drift
        FROM @ledger_file a FULL OUTER JOIN @upstream u ON u.skill = a.skill AND u.path = a.path LEFT JOIN @adapted x ON x.skill = coalesce(a.skill, u.skill) AND x.path = coalesce(a.path, u.path)"""


def join_16_status(d: Dialect) -> str:
    n = lambda w: f"sum(CASE WHEN drift = '{w}' THEN 1 ELSE 0 END)"
    return f"SELECT skill, cast({n('changed')} as bigint) AS changed, cast({n('removed')} as bigint) AS removed, cast({n('added')} as bigint) AS added, cast({n('inconclusive')} as bigint) AS inconclusive, {n('changed')} + {n('removed')} + {n('added')} + {n('inconclusive')} = 0 AS clean FROM ({join_16_upstream_drift(d)}) AS x GROUP BY skill"


def join_25_backfill(d: Dialect) -> str:
    """Held packages; due where no ledger has an entry of them, and all of them if forced."""
    return "SELECT p.skill, l.skill IS NULL AS due, true AS due_if_forced FROM @pkg p LEFT JOIN (SELECT skill FROM @ledger_file GROUP BY skill) AS l ON l.skill = p.skill"


def snk_2_merged_sections(d: Dialect) -> str:
    """A section of the update replaces the whole section on record; others stay, and so does one that the update lacks."""
    return """SELECT coalesce(c.skill, u.skill) AS skill, CASE WHEN u.skill IS NOT NULL THEN u.total ELSE c.usage_total END AS usage_total, c.files AS integrity_files
        FROM (SELECT skill, count(*) AS files, CASE WHEN count(*) > 1 THEN 100 + count(*) END AS usage_total FROM @ledger_file GROUP BY skill) AS c FULL OUTER JOIN @usage u ON u.skill = c.skill"""


def set_3_path_difference(d: Dialect) -> str:
    return "(SELECT skill, path, 'added' AS what FROM @upstream EXCEPT SELECT skill, path, 'added' FROM @disk) UNION ALL (SELECT skill, path, 'removed' FROM @disk EXCEPT SELECT skill, path, 'removed' FROM @upstream)"


def src_5_ledger(d: Dialect) -> str:
    """Entries of each package's ledger, one row per file."""
    return "SELECT skill, path, sha256 FROM @ledger_file"


def agg_25_size_guard(d: Dialect) -> str:
    return "SELECT cast(sum(bytes) as bigint) AS bytes, sum(bytes) > 4000000 AS over FROM @disk"


def top_5_largest(d: Dialect) -> str:
    return "SELECT skill, path, bytes FROM @disk ORDER BY bytes DESC, skill, path LIMIT 5"


OPS = (agg_11_inventory, join_13_hash_verdict, join_14_missing, join_16_upstream_drift, join_16_status, join_25_backfill, snk_2_merged_sections, set_3_path_difference, src_5_ledger, agg_25_size_guard, top_5_largest)
