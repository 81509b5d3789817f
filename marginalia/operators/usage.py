"""Usage: invocations in trailing windows, their cost, and what was never used."""

from __future__ import annotations

from ..functions.dialect import Dialect, placed
from ..plans.derive import NOW

#: What a package costs: bytes of its description, and uses so far (zero where none).
_COST = "SELECT p.skill, octet_length(p.description) AS b, p.manual_only, coalesce(u.d7, 0) AS d7, coalesce(u.d30, 0) AS d30, coalesce(u.d90, 0) AS d90, coalesce(u.total, 0) AS total, u.last_invoked FROM @pkg p LEFT JOIN @usage u ON u.skill = p.skill"


def _cost(d: Dialect) -> str:
    return _COST.replace("octet_length(p.description)", d.bytes("p.description"))


def agg_2_window_counts(d: Dialect) -> str:
    return "SELECT skill, d7, d30, d90, total FROM @usage"


def agg_3_last_invoked(d: Dialect) -> str:
    return f"SELECT skill, {d.starts('last_invoked', 'second')} AS last_invoked FROM @usage"


def agg_4_totals(d: Dialect) -> str:
    return "SELECT cast(sum(d7) as bigint) AS d7, cast(sum(d30) as bigint) AS d30, cast(sum(d90) as bigint) AS d90, cast(sum(total) as bigint) AS total, count(*) AS names, (SELECT count(*) FROM @event WHERE called IS NULL) AS undated FROM @usage"


def _parsed(d: Dialect) -> str:
    ok = d.valid_json("line")
    return f"SELECT event_id, {ok} AS ok, CASE WHEN {ok} THEN {d.json('line', '$.timestamp')} END AS called, file FROM @transcript"


def fn_13_tool_events(d: Dialect) -> str:
    """Invocations out of transcript records, of every block of each; malformed lines and other tools give none."""
    each = d.exploded("@transcript", d.blocks("line", "$.message.content"), "event_id, line", "block")
    return f"SELECT event_id, pos, {d.json('block', '$.input.skill')} AS skill, {d.json('line', '$.timestamp')} AS called FROM ({each}) AS b WHERE {d.json('block', '$.type')} = 'tool_use' AND {d.json('block', '$.name')} = 'Skill' AND {d.json('block', '$.input.skill')} <> ''"


def agg_5_corpus_depth(d: Dialect) -> str:
    return f"SELECT min(called) AS oldest, max(called) AS newest, count(DISTINCT file) AS files, count(*) AS lines, sum(CASE WHEN ok THEN 0 ELSE 1 END) AS skipped, cast({d.days('cast(min(called) as date)', 'cast(max(called) as date)')} as bigint) AS span_days FROM ({_parsed(d)}) AS p"


def agg_6_window_meta(d: Dialect) -> str:
    """Whether each window reaches back before the oldest dated record."""
    return f"SELECT n AS days, cast({NOW} - INTERVAL 1 DAY * n as date) AS starts, cast({NOW} as date) AS ends, {NOW} - INTERVAL 1 DAY * n < o.oldest AS before_corpus FROM (VALUES (7), (30), (90)) AS w(n) CROSS JOIN (SELECT min(called) AS oldest FROM @event) AS o"


def join_1_usage_cost(d: Dialect) -> str:
    """Held packages with their counts; bytes per use is null where there is no use."""
    return f"SELECT skill, b AS bytes, manual_only, d7, d30, d90, total, round(cast(b as double) / nullif(total, 0), 6) AS bytes_per_use FROM ({_cost(d)}) AS c"


def join_2_unheld(d: Dialect) -> str:
    return "SELECT u.skill, u.d7, u.d30, u.d90, u.total FROM @usage u WHERE NOT EXISTS (SELECT 1 FROM @pkg p WHERE p.skill = u.skill)"


def join_3_never_invoked_coverer(d: Dialect) -> str:
    """Packages that never fired, who covers each, and how often that one fired."""
    return f"SELECT c.covered, c.covers, round(c.coverage, 6) AS coverage, coalesce(u.total, 0) AS coverer_total, coalesce(u.d30, 0) AS coverer_d30 FROM @coverer c JOIN ({_cost(d)}) AS k ON k.skill = c.covered AND k.total = 0 LEFT JOIN @usage u ON u.skill = c.covers"


def agg_10_report_totals(d: Dialect) -> str:
    return f"""SELECT count(*) AS held, cast(sum(b) as bigint) AS bytes, cast(sum(total) as bigint) AS uses, sum(CASE WHEN total = 0 THEN 1 ELSE 0 END) AS never, cast(sum(CASE WHEN total = 0 THEN b ELSE 0 END) as bigint) AS never_bytes,
        max(total) AS most, (SELECT count(*) FROM @coverer v JOIN ({_cost(d)}) AS k ON k.skill = v.covered AND k.total = 0) AS covered FROM ({_cost(d)}) AS c"""


def top_3_cost_table(d: Dialect) -> str:
    """Place in the cost report: never used first, then dearest per use, then by name."""
    cost = "cast(b as double) / nullif(total, 0)"
    bucket = f"CASE WHEN total = 0 THEN concat('0', substr(skill, 1, 8)) ELSE concat('1', lpad(cast(1000000 - least(cast(floor({cost}) as bigint), 999999) as string), 7, '0')) END"
    return placed(_cost(d), "skill, b AS bytes, total", bucket, f"CASE WHEN total = 0 THEN 0 ELSE 1 END, {cost} DESC, skill")


def top_4_unheld_order(d: Dialect) -> str:
    """Place of names that are used and not held: most used first, then by name."""
    return placed(join_2_unheld(d), "skill, total", "concat(lpad(cast(1000000000000 - total as string), 13, '0'), substr(skill, 1, 8))", "total DESC, skill")


def top_4_covered_order(d: Dialect) -> str:
    """Place of never used packages by how far another's description covers theirs, then by name."""
    bucket = "concat(lpad(cast(1000 - cast(floor(1000 * coverage) as int) as string), 4, '0'), substr(covered, 1, 8))"
    return placed(join_3_never_invoked_coverer(d), "covered, covers, coverage", bucket, "coverage DESC, covered")


def win_9_daily_trailing(d: Dialect) -> str:
    """Trailing 7, 30 and 90-day counts at every day with an invocation, by whole days."""
    daily = "SELECT skill, cast(called as date) AS day, count(*) AS n FROM @event WHERE called IS NOT NULL GROUP BY skill, cast(called as date)"
    number = d.days("DATE '2020-01-01'", "day")
    over = lambda n: f"cast(sum(n) OVER (PARTITION BY skill ORDER BY k RANGE BETWEEN {n - 1} PRECEDING AND CURRENT ROW) as bigint)"
    return f"SELECT skill, day, {over(7)} AS d7, {over(30)} AS d30, {over(90)} AS d90 FROM (SELECT skill, day, n, cast({number} as int) AS k FROM ({daily}) AS x) AS y"


def set_5_populations(d: Dialect) -> str:
    """Held and unheld invoked names part the invoked names."""
    held = "SELECT skill FROM @usage u WHERE EXISTS (SELECT 1 FROM @pkg p WHERE p.skill = u.skill)"
    unheld = "SELECT skill FROM @usage u WHERE NOT EXISTS (SELECT 1 FROM @pkg p WHERE p.skill = u.skill)"
    return f"SELECT (SELECT count(*) FROM ({held}) AS h) AS held, (SELECT count(*) FROM ({unheld}) AS w) AS unheld, (SELECT count(*) FROM (({held}) INTERSECT ({unheld})) AS i) AS both, (SELECT count(*) FROM @usage) AS invoked"


def fn_12_windows(d: Dialect) -> str:
    """Which trailing windows each dated invocation lies in."""
    inside = lambda n: f"(called <= {NOW} AND called >= {NOW} - INTERVAL {n} DAY)"
    return f"SELECT event_id, {inside(7)} AS in7, {inside(30)} AS in30, called > {NOW} AS in_future FROM @event WHERE called IS NOT NULL"


def snk_3_usage_ledger(d: Dialect) -> str:
    """One line per name as the nested ledger has it."""
    return "SELECT skill, concat('{\"d7\":', d7, ',\"d30\":', d30, ',\"d90\":', d90, ',\"all\":', total, '}') AS invocations FROM @usage"


OPS = (agg_2_window_counts, agg_3_last_invoked, agg_4_totals, fn_13_tool_events, agg_5_corpus_depth, agg_6_window_meta, join_1_usage_cost, join_2_unheld, join_3_never_invoked_coverer, agg_10_report_totals, top_3_cost_table, top_4_unheld_order, top_4_covered_order, win_9_daily_trailing, set_5_populations, fn_12_windows, snk_3_usage_ledger)
