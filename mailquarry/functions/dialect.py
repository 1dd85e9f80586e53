"""Expressions that read the same in Spark SQL and in the SQL of the oracle.

An operator states its plan once, as SQL over a dialect; Spark runs it through
Catalyst, the oracle runs the same statement.  Only what the two spell
differently goes through a method here.
"""

from __future__ import annotations


class Spark:
    name = "spark"

    def lit(self, text: str) -> str:
        return "r'" + text.replace("'", "''") + "'" if "'" not in text else "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def replace_all(self, x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, {self.lit(pattern)}, '{to}')"

    def extract(self, x: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({x}, {self.lit(pattern)}, {group})"

    def extract_all(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, {self.lit(pattern)}, {group})"

    def matches(self, x: str, pattern: str) -> str:
        return f"({x} RLIKE {self.lit(pattern)})"

    def category(self, name: str) -> str:
        return f"\\p{{{{{name}}}}}"  # braces are doubled, as statements name their tables in single ones

    def url_decode(self, x: str) -> str:
        # malformed escapes stay, and so does the plus sign
        return f"url_decode(replace(regexp_replace({x}, r'%(?![0-9A-Fa-f][0-9A-Fa-f])', '%25'), '+', '%2B'))"

    def split(self, x: str, mark: str) -> str:
        return f"split({x}, {self.lit('[' + mark + ']')})"

    def chars(self, x: str) -> str:
        return f"split({x}, '')"

    def keep(self, array: str, v: str, condition: str) -> str:
        return f"filter({array}, {v} -> {condition})"

    def each(self, array: str, v: str, expression: str) -> str:
        return f"transform({array}, {v} -> {expression})"

    def size(self, array: str) -> str:
        return f"size({array})"

    def last(self, array: str, n: int) -> str:
        return f"slice({array}, greatest(size({array}) - {n - 1}, 1), {n})"

    def but_last(self, array: str, n: int) -> str:
        return f"slice({array}, 1, greatest(size({array}) - {n}, 0))"

    def head(self, array: str, n: int) -> str:
        return f"slice({array}, 1, {n})"

    def joined(self, array: str, mark: str) -> str:
        return f"array_join({array}, '{mark}')"

    def distinct(self, array: str) -> str:
        return f"array_distinct({array})"

    def concat_arrays(self, a: str, b: str) -> str:
        return f"concat({a}, {b})"

    def has(self, array: str, x: str) -> str:
        return f"array_contains({array}, {x})"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})"

    def total(self, array: str) -> str:
        return f"aggregate({array}, 0D, (a, b) -> a + b)"

    def text_array(self, items: list[str]) -> str:
        return "array(" + ", ".join(self.lit(i) for i in items) + ")"

    def unnest(self, array: str) -> str:
        return f"explode({array})"

    def sha256(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def fixed(self, x: str, digits: int) -> str:
        return f"printf('%.{digits}f', {x})"

    def json_array(self, array: str) -> str:
        return f"to_json({array})"

    def json_keys(self, x: str) -> str:
        return f"coalesce(json_object_keys({x}), array())"

    def fold(self, array: str, start: str, a: str, v: str, expression: str) -> str:
        return f"aggregate({array}, {start}, ({a}, {v}) -> {expression})"

    def from_hex(self, x: str) -> str:
        return f"cast(conv({x}, 16, 10) as int)"

    def difference(self, a: str, b: str) -> str:
        return f"array_except({a}, {b})"

    def position(self, array: str, x: str) -> str:
        return f"cast(array_position({array}, {x}) as int)"


class Oracle(Spark):
    name = "oracle"

    def lit(self, text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def replace_all(self, x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, {self.lit(pattern)}, '{to.replace('$', chr(92))}', 'g')"

    def extract_all(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, {self.lit(pattern)}, {group})"

    def matches(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {self.lit(pattern)})"

    def category(self, name: str) -> str:
        return f"\\p{{{name}}}"

    def url_decode(self, x: str) -> str:
        return f"url_decode({x})"

    def split(self, x: str, mark: str) -> str:
        return f"string_split({x}, '{mark}')"

    def chars(self, x: str) -> str:
        return f"string_split({x}, '')"

    def keep(self, array: str, v: str, condition: str) -> str:
        return f"list_filter({array}, lambda {v}: {condition})"

    def each(self, array: str, v: str, expression: str) -> str:
        return f"list_transform({array}, lambda {v}: {expression})"

    def size(self, array: str) -> str:
        return f"len({array})"

    def last(self, array: str, n: int) -> str:
        return f"list_slice({array}, greatest(len({array}) - {n - 1}, 1), len({array}))"

    def but_last(self, array: str, n: int) -> str:
        return f"list_slice({array}, 1, greatest(len({array}) - {n}, 0))"

    def head(self, array: str, n: int) -> str:
        return f"list_slice({array}, 1, {n})"

    def joined(self, array: str, mark: str) -> str:
        return f"coalesce(array_to_string({array}, '{mark}'), '')"

    def distinct(self, array: str) -> str:
        # in the order of first appearance
        return f"list_filter({array}, lambda v, i: list_position({array}, v) = i)"

    def concat_arrays(self, a: str, b: str) -> str:
        return f"list_concat({a}, {b})"

    def has(self, array: str, x: str) -> str:
        return f"list_contains({array}, {x})"

    def array(self, *items: str) -> str:
        return f"[{', '.join(items)}]"

    def total(self, array: str) -> str:
        return f"coalesce(list_sum({array}), 0)"

    def text_array(self, items: list[str]) -> str:
        return "[" + ", ".join(self.lit(i) for i in items) + "]"

    def unnest(self, array: str) -> str:
        return f"unnest({array})"

    def sha256(self, x: str) -> str:
        return f"sha256({x})"

    def json_array(self, array: str) -> str:
        return f"cast(to_json({array}) as varchar)"

    def json_keys(self, x: str) -> str:
        return f"coalesce(json_keys(try_cast({x} as json)), [])"

    def fold(self, array: str, start: str, a: str, v: str, expression: str) -> str:
        return f"list_reduce({array}, lambda {a}, {v}: {expression}, {start})"

    def from_hex(self, x: str) -> str:
        return f"cast(concat('0x', {x}) as int)"

    def difference(self, a: str, b: str) -> str:
        return f"list_filter({a}, lambda v: not list_contains({b}, v))"

    def position(self, array: str, x: str) -> str:
        return f"coalesce(list_position({array}, {x}), 0)"


SPARK, ORACLE = Spark(), Oracle()


def count_of(x: str, mark: str) -> str:
    """Occurrences of a character."""
    return f"(length({x}) - length(replace({x}, '{mark}', '')))"


def hits(x: str, phrases) -> str:
    """How many of the phrases ``x`` contains; a repeated phrase counts once."""
    quoted = [p.replace("'", "''") for p in phrases]
    return "(" + " + ".join(f"cast(contains({x}, '{p}') as int)" for p in quoted) + ")"


def any_of(x: str, phrases) -> str:
    return "(" + " or ".join(f"contains({x}, '{p}')" for p in phrases) + ")"


def one_of(x: str, values) -> str:
    return f"({x} in (" + ", ".join(f"'{v}'" for v in sorted(values)) + "))"


def entropy(d: Spark, x: str) -> str:
    """Shannon entropy of the characters, in bits; 0 for empty text."""
    share = f"((length({x}) - length(replace({x}, ch, ''))) / cast(length({x}) as double))"
    return f"(case when length({x}) = 0 then cast(0 as double) else -{d.total(d.each(d.distinct_set(d.chars(x)), 'ch', f'{share} * log2({share})'))} end)"


Spark.distinct_set = lambda self, array: f"array_distinct({array})"
Oracle.distinct_set = lambda self, array: f"list_distinct({array})"
