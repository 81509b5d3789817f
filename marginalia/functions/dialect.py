"""SQL that two engines read: the few spellings that differ, and running text over frames.

An operator is a function from a dialect to SQL in which ``@name`` stands for an
input relation.  ``run`` binds the inputs to DataFrames; ``plain`` binds them to
named relations of the checking engine.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Sql = Callable[["Dialect"], str]


class Dialect:
    """Spellings of Spark SQL."""

    name = "spark"

    def text(self, s: str) -> str:
        """A string literal; backslashes and quotes stay as they are."""
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def like(self, x: str, pattern: str) -> str:
        return f"({x} RLIKE {self.text(pattern)})"

    def count(self, x: str, pattern: str) -> str:
        return f"cast(regexp_count({x}, {self.text(pattern)}) as bigint)"

    def first(self, x: str, pattern: str, group: int = 1) -> str:
        """The group of the first match; '' if there is none."""
        return f"regexp_extract({x}, {self.text(pattern)}, {group})"

    def all(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, {self.text(pattern)}, {group})"

    def sub(self, x: str, pattern: str, by: str) -> str:
        """Every match replaced; groups are written $1."""
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(by)})"

    def sha(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def number_of(self, x: str) -> str:
        """A number of 60 bits out of a string's hash, for folding sets without order."""
        return f"cast(conv(substr({self.sha(x)}, 1, 15), 16, 10) as bigint)"

    def joined(self, x: str, distinct: bool = True, order: str | None = None, by: str = ",") -> str:
        """Values in order, joined by commas or another mark."""
        return f"listagg({'DISTINCT ' if distinct else ''}{x}, '{by}') WITHIN GROUP (ORDER BY {order or x})"

    def exploded(self, source: str, array: str, columns: str, item: str = "item", pos: str = "pos") -> str:
        """SELECT of ``columns``, and the array's items with their places from 0."""
        return f"SELECT {columns}, {pos}, {item} FROM {source} LATERAL VIEW posexplode({array}) _x AS {pos}, {item}"

    def split(self, x: str, pattern: str) -> str:
        return f"split({x}, {self.text(pattern)})"

    def bytes(self, x: str) -> str:
        return f"cast(octet_length({x}) as bigint)"

    def days(self, a: str, b: str) -> str:
        """Whole days from date a to date b."""
        return f"datediff({b}, {a})"

    def valid_json(self, x: str) -> str:
        return f"(try_parse_json({x}) IS NOT NULL)"

    def json(self, x: str, path: str) -> str:
        return f"get_json_object({x}, '{path}')"

    def blocks(self, x: str, path: str) -> str:
        """The items of a JSON array, as JSON texts; none where the text is no JSON."""
        return f"coalesce(transform(try_variant_get(try_parse_json({x}), '{path}', 'array<variant>'), v -> to_json(v)), array())"

    def array(self, items: list[str]) -> str:
        return f"array({', '.join(items)})"

    def kept(self, array: str, item: str, condition: str) -> str:
        """The array's items that meet a condition on ``item``."""
        return f"filter({array}, {item} -> {condition})"

    def mapped(self, array: str, item: str, value: str) -> str:
        return f"transform({array}, {item} -> {value})"

    def together(self, array: str, by: str) -> str:
        return f"array_join({array}, {self.text(by)})"

    def size(self, array: str) -> str:
        return f"cast(size({array}) as bigint)"

    def matched(self, hits: str, gaps: str) -> str:
        """Structs (hit, seg, nxt) of a text's matches and gaps: seg is what lies between the begins of the match before and this one, nxt the gap after."""
        return f"transform({hits}, (h, i) -> named_struct('hit', h, 'seg', concat(CASE WHEN i > 0 THEN {hits}[i - 1] ELSE '' END, {gaps}[i]), 'nxt', {gaps}[i + 1]))"

    def run_of(self, x: str, over: str) -> str:
        """Strings of a window's frame in a row."""
        return f"array_join(collect_list({x}) OVER ({over}), '')"

    def code_point(self, x: str, width: int, upper: bool = True) -> str:
        """The hexadecimal code point of a character, of ``width`` digits at least."""
        return f"format_string('%0{width}{'X' if upper else 'x'}', ascii({x}))"

    def to_bytes(self, x: str) -> str:
        return f"cast({x} as binary)"

    def to_text(self, x: str) -> str:
        """Bytes as text; what is no UTF-8 is replaced."""
        return f"make_valid_utf8(cast({x} as string))"

    def part(self, x: str, start: int, n: int) -> str:
        """``n`` bytes from place ``start``, counted from 1."""
        return f"substring({x}, {start}, {n})"

    def json_kind(self, x: str, path: str) -> str:
        """What a JSON value is: null for none at the path, else 'null', 'string', 'number', 'boolean', 'array' or 'object'."""
        t = f"schema_of_variant(variant_get(try_parse_json({x}), '{path}'))" if path != "$" else f"schema_of_variant(try_parse_json({x}))"
        return f"CASE WHEN {t} = 'VOID' THEN 'null' WHEN {t} = 'STRING' THEN 'string' WHEN {t} = 'BOOLEAN' THEN 'boolean' WHEN {t} LIKE 'ARRAY%' THEN 'array' WHEN {t} LIKE 'OBJECT%' THEN 'object' WHEN {t} IS NOT NULL THEN 'number' END"

    def json_node(self, x: str, path: str) -> str:
        """The JSON text at a path."""
        return f"get_json_object({x}, '{path}')"

    def json_keys(self, x: str) -> str:
        return f"json_object_keys({x})"

    def json_at(self, x: str, key: str) -> str:
        """The string under a key that is a column."""
        return f"from_json({x}, 'map<string,string>')[{key}]"

    def has_nul(self, x: str) -> str:
        return f"contains({x}, X'00')"

    def from_hex(self, x: str) -> str:
        return f"unhex({x})"

    def from_base64(self, x: str) -> str:
        return f"try_to_binary({x}, 'base64')"

    def decoded(self, x: str, kind: str) -> str:
        """The text that a run of hex or base64 stands for; null if it is none."""
        b = f"unhex({x})" if kind == "hex" else f"try_to_binary({x}, 'base64')"
        return f"CASE WHEN is_valid_utf8(cast({b} as string)) THEN cast({b} as string) END"

    def starts(self, ts: str, unit: str = "day") -> str:
        return f"date_trunc('{unit}', {ts})"


class Duck(Dialect):
    """Spellings of the checking engine."""

    name = "duckdb"

    def text(self, s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def like(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {self.text(pattern)})"

    def count(self, x: str, pattern: str) -> str:
        return f"cast(len(regexp_extract_all({x}, {self.text(pattern)})) as bigint)"

    def sub(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(re.sub(r'\$(\d)', r'\\\1', by))}, 'g')"

    def sha(self, x: str) -> str:
        return f"sha256({x})"

    def number_of(self, x: str) -> str:
        return f"cast('0x' || substr({self.sha(x)}, 1, 15) as bigint)"

    def joined(self, x: str, distinct: bool = True, order: str | None = None, by: str = ",") -> str:
        return f"string_agg({'DISTINCT ' if distinct else ''}{x}, '{by}' ORDER BY {order or x})"

    def exploded(self, source: str, array: str, columns: str, item: str = "item", pos: str = "pos") -> str:
        return f"SELECT {columns}, _i - 1 AS {pos}, _a[_i] AS {item} FROM (SELECT *, unnest(generate_series(1, len(_a))) AS _i FROM (SELECT *, {array} AS _a FROM {source}))"

    def split(self, x: str, pattern: str) -> str:
        return f"regexp_split_to_array({x}, {self.text(pattern)})"

    def bytes(self, x: str) -> str:
        return f"cast(strlen({x}) as bigint)"

    def days(self, a: str, b: str) -> str:
        return f"date_diff('day', cast({a} as date), cast({b} as date))"

    def valid_json(self, x: str) -> str:
        return f"json_valid({x})"

    def json(self, x: str, path: str) -> str:
        return f"json_extract_string({x}, '{path}')"

    def blocks(self, x: str, path: str) -> str:
        return f"CASE WHEN json_valid({x}) THEN cast(json_extract({x}, '{path}[*]') as varchar[]) ELSE cast([] as varchar[]) END"

    def array(self, items: list[str]) -> str:
        return f"[{', '.join(items)}]"

    def kept(self, array: str, item: str, condition: str) -> str:
        return f"list_filter({array}, lambda {item}: {condition})"

    def mapped(self, array: str, item: str, value: str) -> str:
        return f"list_transform({array}, lambda {item}: {value})"

    def together(self, array: str, by: str) -> str:
        return f"array_to_string({array}, {self.text(by)})"

    def size(self, array: str) -> str:
        return f"cast(len({array}) as bigint)"

    def matched(self, hits: str, gaps: str) -> str:
        return f"list_transform({hits}, lambda h, i: {{'hit': h, 'seg': concat(CASE WHEN i > 1 THEN {hits}[i - 1] ELSE '' END, {gaps}[i]), 'nxt': {gaps}[i + 1]}})"

    def run_of(self, x: str, over: str) -> str:
        return f"string_agg({x}, '') OVER ({over})"

    def code_point(self, x: str, width: int, upper: bool = True) -> str:
        return f"printf('%0{width}{'X' if upper else 'x'}', unicode({x}))"

    def to_bytes(self, x: str) -> str:
        return f"encode({x})"

    def to_text(self, x: str) -> str:
        return f"try(decode({x}))"

    def part(self, x: str, start: int, n: int) -> str:
        return f"{x}[{start}:{start + n - 1}]"

    def json_kind(self, x: str, path: str) -> str:
        t = f"json_type({x}, '{path}')"
        return f"CASE WHEN {t} = 'NULL' THEN 'null' WHEN {t} = 'VARCHAR' THEN 'string' WHEN {t} = 'BOOLEAN' THEN 'boolean' WHEN {t} = 'ARRAY' THEN 'array' WHEN {t} = 'OBJECT' THEN 'object' WHEN {t} IS NOT NULL THEN 'number' END"

    def json_node(self, x: str, path: str) -> str:
        return f"cast(json_extract({x}, '{path}') as varchar)"

    def json_keys(self, x: str) -> str:
        return f"json_keys({x})"

    def json_at(self, x: str, key: str) -> str:
        return f"json_extract_string({x}, concat('$.\"', {key}, '\"'))"

    def has_nul(self, x: str) -> str:
        return f"regexp_matches(hex({x}), '^(?:..)*?00')"

    def from_base64(self, x: str) -> str:
        return f"try(from_base64({x}))"

    def decoded(self, x: str, kind: str) -> str:
        return f"try(decode({'unhex' if kind == 'hex' else 'from_base64'}({x})))"


def placed(source: str, columns: str, bucket: str, order: str) -> str:
    """``columns`` of all rows, and their place in an order over everything, without one task that sees all.

    ``bucket`` is a string that follows the order; rows are numbered in their
    bucket, after as many as the buckets before it have.
    """
    rows = f"SELECT *, {bucket} AS bucket FROM ({source}) AS s"
    before = f"SELECT bucket, coalesce(sum(n) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT bucket, count(*) AS n FROM ({rows}) AS r GROUP BY bucket) AS c"
    return f"SELECT {columns}, cast(b.before + row_number() OVER (PARTITION BY r.bucket ORDER BY {order}) as bigint) AS place FROM ({rows}) AS r JOIN ({before}) AS b ON b.bucket = r.bucket"


SPARK, DUCK = Dialect(), Duck()
_NAME = re.compile(r"@([a-z_]+)")


def needs(sql: str) -> list[str]:
    """The relations that a text names, in order of first use."""
    return list(dict.fromkeys(_NAME.findall(sql)))


def run(spark: SparkSession, sql: Sql, **frames: DataFrame) -> DataFrame:
    """The operator over DataFrames."""
    text, mark = sql(SPARK), uuid.uuid4().hex[:12]
    for name in needs(text):
        frames[name].createOrReplaceTempView(f"{name}_{mark}")
    return spark.sql(_NAME.sub(lambda m: f"{m[1]}_{mark}", text))


def plain(sql: Sql, relations: dict[str, Sql]) -> str:
    """The operator for the checking engine; derived relations become WITH entries."""
    text = sql(DUCK)
    order: list[str] = []

    def visit(name: str) -> None:
        if name in relations and name not in order:
            for below in needs(relations[name](DUCK)):
                visit(below)
            order.append(name)

    for name in needs(text):
        visit(name)
    own = [f"r_{n} AS ({relations[n](DUCK)})" for n in order]
    bound = ("WITH " + ",\n".join(own) + "\n" if own else "") + f"SELECT * FROM (\n{text}\n) AS answer"
    return _NAME.sub(lambda m: f"r_{m[1]}" if m[1] in relations else m[1], bound)
