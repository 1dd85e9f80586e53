"""Problem 7: several values packed in one field."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.catalogue import query

#: What a URL starts with.
URL_START = r"(?i:[a-z][a-z0-9+.\-]*://|www\.)"
#: Words that stand for "no value" (fixed values).
NO_VALUE = r"(?i:none|nan|null|nil|n/?a|-)"
OPEN, CLOSE, ESCAPE = "\ue000", "\ue001", "\ue002"
_EDGE = r"[\[\](){}<>,;|\s]"
#: A quoted span stands between delimiters, brackets or the ends.
QUOTED = rf"""(?<=^|{_EDGE})(?:"([^"]*)"|'([^']*)')(?={_EDGE}|$)"""
#: Blanks always part values; a mark does only before a value, an empty place or the end, else it is the URL's own.
DELIMITER = rf"[,;|]*\s+[\s,;|]*|[,;|]+(?={URL_START}|{OPEN}|{NO_VALUE}?(?:[,;|\s]|$))"


def packed_values(text: Column, value_start: str = URL_START) -> Column:
    """Array of the values in ``text`` in stored order.

    Quoted spans become indexed placeholders in private-use characters (those
    already in the text are escaped first, so no placeholder can collide), the
    rest is split at delimiters, and the spans come back by array lookup.
    Null, blank and "no value" texts give an empty array; repeats are kept.
    """
    s = F.regexp_replace(F.coalesce(text, F.lit("")), r"\\(?=[/\"'])", "")
    s = F.regexp_replace(s, r"[<>]+", " ")  # angle brackets only ever surround values
    s = F.regexp_replace(s, ESCAPE, ESCAPE + "c")
    s = F.regexp_replace(F.regexp_replace(s, OPEN, ESCAPE + "a"), CLOSE, ESCAPE + "b")
    s = F.regexp_replace(s, r"(?U)^[\s\[({]+|[\s\])}]+$", "")
    spans = F.regexp_extract_all(s, F.lit(QUOTED), F.lit(0))
    pieces = F.split(s, QUOTED, -1)
    marked = F.array_join(
        F.transform(pieces, lambda p, i: F.when(i < F.size(spans), F.concat(p, F.lit(OPEN), i.cast("string"), F.lit(CLOSE))).otherwise(p)),
        "",
    )
    index = lambda x: F.regexp_extract(x, f"{OPEN}([0-9]+){CLOSE}", 1)
    restored = F.transform(
        F.split(marked, DELIMITER, -1),
        lambda x: F.when(index(x) != "", F.get(spans, index(x).cast("int"))).otherwise(x),
    )
    bare = F.transform(restored, lambda x: F.regexp_replace(x, r"(?U)^[\s\"'<\[(]+|[\s\"'>\])]+$", ""))
    plain = F.transform(bare, _unescape)
    return F.filter(plain, lambda x: x.rlike(f"^{value_start}"))


def _unescape(x: Column) -> Column:
    back = {"a": OPEN, "b": CLOSE, "c": ESCAPE}
    return reduce(lambda c, kv: F.replace(c, F.lit(ESCAPE + kv[0]), F.lit(kv[1])), back.items(), x)


def explode_packed(df: DataFrame, table_ref: str, key_col: str, packed_col: str) -> DataFrame:
    """One row per value: table_ref, row_key, pos (from 1), url.

    Rows without a value give no row; empty places take no position.  Other
    columns of ``df``, also of the names of the result, don't matter.
    """
    values = df.select(F.col(key_col).cast("string").alias("row_key"), packed_values(F.col(packed_col)).alias("v"))
    return values.select(F.lit(table_ref).alias("table_ref"), "row_key", F.posexplode("v").alias("p", "url")).select("table_ref", "row_key", (F.col("p") + 1).cast("int").alias("pos"), "url")


_SQL = r"""
with f as (
  select 'emails' as table_ref, cast(record_id as varchar) as row_key, urls from emails
  union all select 'joint_threshold_calibration_set', case_id, urls from joint_threshold_calibration_set),
m as (
  select table_ref, row_key, list_filter(list_transform(string_split(
      regexp_replace(replace(urls, '\/', '/'), '(^|[\s,;|"''\[\]<>]+)((?:[a-zA-Z][a-zA-Z0-9+.-]*://|www\.))', chr(1) || '\2', 'g'), chr(1)),
      lambda x: regexp_replace(regexp_replace(x, '[\s]+(None|nan|null)?[\s,;|]*$', ''), '[\s,;|"''\[\]<>]+$', '')),
      lambda x: regexp_matches(x, '^([a-zA-Z][a-zA-Z0-9+.-]*://|www\.)')) as v
  from f where urls is not null)
select table_ref, row_key, cast(generate_subscripts(v, 1) as integer) as pos, unnest(v) as url from m
"""


@query("p7_found", _SQL)
def p7_found(spark, d):
    emails = spark.read.parquet(f"{d}/emails.parquet")
    cases = spark.read.parquet(f"{d}/joint_threshold_calibration_set.parquet")
    name = "joint_threshold_calibration_set"
    return explode_packed(emails, "emails", "record_id", "urls").unionByName(explode_packed(cases, name, "case_id", "urls"))
