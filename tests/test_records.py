"""Known answers of records, decisions, contracts, ledger checks and links."""

import json

import pytest

from marginalia.operators import links, records
from marginalia.plans import registry

H = "0a" * 32
PKG = "doc_id long, skill string, text string, description string, manual_only boolean, category string, source string, lang string"


def pkg(spark, *names):
    return spark.createDataFrame([(i, n, "", "", False, None, "s", "en") for i, n in enumerate(names)], PKG)


def raw(spark, files):
    return spark.createDataFrame([(s, p, bytearray(t.encode())) for s, p, t in files], "skill string, path string, content binary")


def texts(spark, files):
    return spark.createDataFrame(files, "skill string, path string, text string")


ORIGIN = f"| **Source** | `/src/a` |\n| **Subpath** | Repository root |\n| **Resolved commit** | `{'ab' * 20}` |\n| **Fetched** | 2024-01-02 |\n| `SKILL.md` | 3 B | `{H}` |\n| `x.md` | 3 B | `abc…` |\n"
AUDIT = "| **Source** | `https://x.example/s` → `skills/b/` |\n| **Upstream commit** | `1234567` |\n| **Retrieved** | 2023-12-31 |\n| **License** | `MIT` |\n| **Licence basis** | as of today |\nnames `out.md`\n## Changes applied\n`in.md`, `a/b.py` and `none`\n### Deeper\n`deep.md`\n## Later\n`after.md`\n"


@pytest.fixture(scope="module")
def kept(spark):
    files = [("both", "ORIGIN.md", ORIGIN), ("both", "AUDIT.md", AUDIT), ("audit", "AUDIT.md", AUDIT), ("plain", "AUDIT.md", "## Changes applied\nnothing\n"), ("bare", "AUDIT.md", "no section\n")]
    spine = [("own", "SKILL.md", "---\nname: own\ndescription: d\nlicense: ISC\n---\n"), ("none", "SKILL.md", "---\nname: none\n---\n")]
    return {"record_file": texts(spark, files), "pkg": pkg(spark, "both", "audit", "plain", "bare", "own", "none"), "raw_file": raw(spark, spine)}


def test_provenance_falls_back_field_by_field(spark, kept):
    got = {r.skill: tuple(r)[1:] for r in registry.over(spark, records.src_7_provenance, kept).collect()}
    assert got["both"] == ("acquired", "/src/a", None, "ab" * 20, "2024-01-02", "MIT", "as of today", "ORIGIN.md")
    assert got["audit"] == ("acquired", "https://x.example/s", "skills/b/", "1234567", "2023-12-31", "MIT", "as of today", "AUDIT.md")
    assert got["own"] == ("authored", None, None, None, None, "ISC", "declared", None)
    assert got["none"] == ("authored", None, None, None, None, None, None, None)
    assert sorted(map(tuple, registry.over(spark, records.src_7_arrival, kept).collect())) == [("both", "SKILL.md", H)]
    assert {(r.skill, r.pinned) for r in registry.over(spark, records.prj_11_acquired, kept).collect()} == {("both", True), ("audit", True), ("plain", False), ("bare", False)}


def test_names_outside_the_section_do_not_count(spark, kept):
    got = registry.relation(spark, "", "adapted", kept).collect()
    assert {tuple(r) for r in got} == {(s, p) for s in ("both", "audit") for p in ("in.md", "a/b.py", "deep.md")}
    assert {r.skill: r.adapted for r in registry.over(spark, records.agg_23_adapted, kept).collect()} == {"both": 3, "audit": 3, "plain": 0, "bare": None}


def test_adaptation_needs_a_section(spark, kept):
    arrival = spark.createDataFrame([("both", "SKILL.md", H), ("bare", "SKILL.md", H), ("same", "SKILL.md", H)], "skill string, path string, sha256 string")
    disk = spark.createDataFrame([("both", "SKILL.md", "x", 1), ("bare", "SKILL.md", "x", 1), ("bare", "new.md", "y", 1), ("same", "SKILL.md", H, 1), ("same", "AUDIT.md", "z", 1)], "skill string, path string, sha256 string, bytes long")
    got = {tuple(r) for r in registry.over(spark, records.join_17_adaptation, {**kept, "arrival": arrival, "disk": disk}).collect()}
    assert got == {("both", 1, False), ("bare", 2, True), ("same", 0, False)}


def test_contracts(spark):
    head = lambda n: f"---\nname: {n}\ndescription: dé\n---\n"
    files = [
        ("gated", "SKILL.md", head("gated") + "### 1 · Look → out\n> **Gate:** yes\n> **Gate:**\n### 2. Write\n> **Gate:** done\n"), ("half", "SKILL.md", head("half") + "### Phase 1 — Look\n## Other\n> **Gate:** too late\n### Part 2 - Write\n> **Gate:** done\n"),
        ("empty", "SKILL.md", head("empty") + "### 1. Look\n> **Gate:**\n> **Gate:** second\n"), ("stageless", "SKILL.md", "---\nname: x\ndisable-model-invocation: True\n---\n### Notes\n> **Gate:** of nothing\n"),
        ("gated", "scripts/a.test.mjs", ""), ("gated", "scripts/in/b.test.mjs", ""), ("gated", "scripts/self-test.mjs", ""), ("half", "scripts/run.sh", ""),
    ]
    got = {r.skill: tuple(r)[1:] for r in registry.over(spark, records.agg_12_contract, {"raw_file": raw(spark, files)}).collect()}
    assert got == {"gated": (True, 3, 2, True, 1, True), "half": (True, 3, 2, False, 0, False), "empty": (True, 3, 1, False, None, None), "stageless": (False, 0, 0, None, None, None)}


def test_ledger_drift_of_every_section(spark):
    fields = "skill string, section string, field string, value string"
    now = [("same", "origin", "license", None), ("same", "integrity", "a", "1"), ("origin", "origin", "license", "MIT"), ("origin", "origin", "fetched", "2024"), ("contract", "contract", "gated", None), ("files", "integrity", "a", "1"), ("files", "integrity", "b", "1"), ("new", "origin", "kind", "x")]
    then = [("same", "origin", "license", None), ("same", "integrity", "a", "1"), ("origin", "origin", "license", "GPL"), ("origin", "origin", "fetched", "2020"), ("contract", "contract", "gated", "false"), ("files", "integrity", "a", "2"), ("files", "integrity", "c", "1"), ("lost", "origin", "kind", "x")]
    known = {"structural": spark.createDataFrame(now, fields), "ledger_field": spark.createDataFrame(then, fields)}
    got = {tuple(r) for r in registry.over(spark, records.join_15_ledger_check, known).collect()}
    assert got == {("origin", "origin", 1), ("contract", "contract", 1), ("files", "integrity", 3), ("new", "no entry", None), ("lost", "not held", None)}


def test_decisions(spark):
    lines = """# Decisions
| `early` | [`o/r`](https://github.com/o/r) | d | f |
## Refused
| Skill | Source | Date | Finding |
|-|-|-|-|
| `one` | [`o/r`](https://github.com/o/r) @ `abc` | 2024-01-02 | OVERRIDE |
| one | [o/r](u) | x | y |
| `two` | no link | | |
| `few` | x |
like `prose` | a | b
## Declined
| `one` | [o/r](https://x.example) | 2024-01-03 | scan | like `two` |
  | `three` | [o/r](u) | d |
## Other
| `four` | [o/r](u) | d | e | f |
## Refused
| `five` | [o/r](u) | d | e |""".split("\n")
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(lines)], "file string, pos long, line string")
    got = [tuple(r)[1:] for r in registry.over(spark, records.src_6_rejected, {"rejected_line": df}).collect()]
    assert sorted(got, key=str) == sorted([
        ("refused", "one", "o/r", "https://github.com/o/r", "2024-01-02", None, "OVERRIDE", None), ("refused", "two", None, None, None, None, None, None),
        ("declined", "one", "o/r", "https://x.example", "2024-01-03", "scan", None, "like `two`"), ("declined", "three", "o/r", "u", "d", None, None, None),
    ], key=str)


CERT = {"criterion": "safe-to-load", "state": "certified", "by": "x", "on": "2024-01-02", "method": "read", "inventoryDigest": f"sha256:{H}", "why": None}
FOUND = {"code": "A", "severity": "block", "at": "a:1", "excerpt": "", "disposition": "fixed", "why": "x"}
SOUND = {"schemaVersion": 1, "skill": "a", "certifications": [CERT], "inventory": {"a b.md": f"sha256:{H}"}, "findings": [FOUND], "notChecked": ["images"], "exemption": None, "provenance": {"source": None, "commit": None, "retrieved": None, "license": "MIT", "licenseBasis": None}}
WRONG = [
    ({}, []), ({"schemaVersion": 2}, [("", "schemaVersion", "const")]), ({"schemaVersion": "1"}, [("", "schemaVersion", "const")]), ({"skill": ""}, [("", "skill", "empty")]), ({"skill": 3}, [("", "skill", "type")]), ({"mood": 1}, [("", "mood", "unknown")]),
    ({"certifications": []}, [("", "certifications", "too few")]), ({"certifications": {}}, [("", "certifications", "type")]), ({"certifications": [3]}, [("certifications[0]", "", "type")]), ({"certifications": [{**CERT, "state": "sure"}]}, [("certifications[0]", "state", "enum")]),
    ({"certifications": [CERT, {**CERT, "on": "soon", "extra": 1}]}, [("certifications[1]", "on", "pattern"), ("certifications[1]", "extra", "unknown")]), ({"certifications": [{k: v for k, v in CERT.items() if k != "why"}]}, [("certifications[0]", "why", "required")]),
    ({"inventory": {"a": "md5:1", "b": 3}}, [("inventory", "a", "pattern"), ("inventory", "b", "pattern")]), ({"findings": [{**FOUND, "disposition": "open"}]}, [("findings[0]", "disposition", "enum")]), ({"notChecked": ["", 2]}, [("notChecked[0]", "", "empty"), ("notChecked[1]", "", "type")]),
    ({"exemption": {"reason": "x", "on": "x"}}, [("exemption", "on", "pattern")]), ({"provenance": None}, [("", "provenance", "type")]), ({"provenance": {**SOUND["provenance"], "commit": 3}}, [("provenance", "commit", "type")]),
    # Meaning, only where the structure holds.
    ({"certifications": [{**CERT, "state": "refused"}]}, [("certifications[0]", "why", "lacks")]), ({"certifications": [{**CERT, "by": None, "on": None, "inventoryDigest": None}]}, [("certifications[0]", f, "lacks") for f in ("by", "on", "inventoryDigest")]),
    ({"notChecked": []}, [("", "notChecked", "says nothing")]), ({"notChecked": [], "exemption": {"reason": "x", "on": "2024-01-02"}}, []), ({"notChecked": [], "mood": 1}, [("", "mood", "unknown")]),
]


def test_record_violations(spark):
    rows = [(i, json.dumps({**SOUND, **change})) for i, (change, _) in enumerate(WRONG)] + [(100, "{"), (101, "[]"), (102, "3")]
    got = registry.over(spark, records.agg_24_record_validation, {"record_json": spark.createDataFrame(rows, "id long, line string")}).collect()
    want = [(i, *v) for i, (_, all_) in enumerate(WRONG) for v in all_] + [(i, "", "", "not a record") for i in (100, 101, 102)]
    assert sorted(map(tuple, got)) == sorted(want)


LINES = [
    # (text, kept spans (col, raw), what they point at)
    ("[https://a.example](https://b.example)", [(1, "https://a.example"), (20, "https://b.example")], ["external a.example", "external b.example"]),
    ("[x](references/a.md) [y](references/lost.md)", [(4, "references/a.md"), (25, "references/lost.md")], ["node one/a.md", "unresolved None"]),
    ("[x](%72eferences/a.md) [y](./scripts/../references/a.md?q#z)", [(4, "%72eferences/a.md"), (27, "./scripts/../references/a.md?q#z")], ["node one/a.md", "node one/a.md"]),
    ("[x](../two) [y](../two/SKILL.md) [z](../two/a.md) [u](../../two)", [(4, "../two"), (16, "../two/SKILL.md"), (37, "../two/a.md"), (54, "../../two")], ["node two", "node two", "unresolved None", "unresolved None"]),
    ("[x](#My%20Heading) [y](#%) [z](%zz) [w](a%)", [(4, "#My%20Heading"), (23, "#%"), (31, "%zz"), (40, "a%")], ["anchor my-heading", "unresolved None", "unresolved None", "unresolved None"]),
    ("[x](<>) [y](< a.md>) [z](LICENSE) [s](scripts/run.sh) [d](.)", [(13, " a.md"), (25, "LICENSE"), (38, "scripts/run.sh"), (58, ".")], ["unresolved None", "file LICENSE", "node one/scripts", "unresolved None"]),
    ("[[two|b]][[gone]] Call the skill tool with `two`", [(2, "two"), (11, "gone"), (44, "two")], ["node two", "unresolved None", "node two"]),
    ("[[https://x.example/a]] <mailto:me> [m](mailto:me)", [(2, "https://x.example/a"), (25, "mailto:me"), (40, "mailto:me")], ["unresolved None", "external mailto", "external mailto"]),
    ("[n]([[two]])", [(4, "[[two]]")], ["unresolved None"]),
]


def test_links(spark):
    files = [("one", p, "") for p in ("SKILL.md", "references/a.md", "LICENSE", "scripts/run.sh")]
    known = {
        "link_line": spark.createDataFrame([("one", "SKILL.md", i, t) for i, (t, *_) in enumerate(LINES)], "skill string, path string, ln int, text string"), "pkg": pkg(spark, "one", "two"),
        "raw_file": raw(spark, files), "rejected": spark.createDataFrame([], "name string, kind string, url string, pos long"),
    }
    spans = registry.over(spark, links.win_5_kept_spans, known).toPandas().sort_values(["ln", "col"])
    ends = registry.over(spark, links.join_19_links, known).toPandas().sort_values(["ln", "col"])
    for i, (_, want, to) in enumerate(LINES):
        assert list(zip(spans[spans.ln == i].col, spans[spans.ln == i].raw)) == want, i
        assert [f"{k} {t}" for k, t in zip(ends[ends.ln == i].kind, ends[ends.ln == i].target)] == to, i


def test_links_below_a_folder(spark):
    files = [("one", p, "") for p in ("notes/deep.md", "notes/x.md", "references/a.md")]
    known = {
        "link_line": spark.createDataFrame([("one", "notes/deep.md", 1, "[a](x.md) [b](../references/a.md) [c](../../two)")], "skill string, path string, ln int, text string"), "pkg": pkg(spark, "one", "two"),
        "raw_file": raw(spark, files), "rejected": spark.createDataFrame([], "name string, kind string, url string, pos long"),
    }
    got = registry.over(spark, links.join_19_links, known).toPandas().sort_values("col")
    assert list(zip(got.kind, got.target)) == [("file", "notes/x.md"), ("node", "one/a.md"), ("node", "two")]


def test_nothing_to_read(spark):
    none = {"record_json": spark.createDataFrame([], "id long, line string"), "rejected_line": spark.createDataFrame([], "file string, pos long, line string")}
    assert registry.over(spark, records.agg_24_record_validation, none).count() == 0
    assert registry.over(spark, records.src_6_rejected, none).count() == 0
