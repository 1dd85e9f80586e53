"""Set-at-a-time operators: deduplication, caps, splits, samples, coercion, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicons as lx
from ..functions.dialect import Spark
from ..plans.catalogue import query, statement
from ..runtime import durable

_KEY = "concat(lower(coalesce(subject, '')), '␟', lower(coalesce(body, '')), '␟', lower(coalesce(sender, '')), '␟', coalesce(cast(label as varchar(20)), ''))"


@statement("dedupe_hash")
def dedupe_hash(d: Spark) -> str:
    """First record of each content hash (subject, body, sender, label without case).

    A grouped minimum, not a window: partial aggregation shrinks a group of
    copies of any size before the shuffle.
    """
    return f"select min(record_id) as record_id, count(*) as copies from (select record_id, {d.sha256(_KEY)} as h from {{emails}}) t group by h"


@statement("dedupe_summary")
def dedupe_summary(d: Spark) -> str:
    return f"select count(*) as records, count(distinct h) as kept, count(*) - count(distinct h) as removed from (select {d.sha256(_KEY)} as h from {{emails}}) t"


@statement("counts_by_source_and_label")
def counts_by_source_and_label(d: Spark) -> str:
    """Counts by source, by label and by both, in one pass."""
    return "select source, label, count(*) as n from {emails} group by grouping sets ((source), (label), (source, label))"


def capped(d: Spark, pair_cap: int, source_cap: int) -> str:
    """``pair_cap`` records of each source and label, then ``source_cap`` of each source."""
    h = d.sha256("concat(cast(record_id as varchar(20)), '#7')")
    return f"""with r as (select record_id, source, label, {h} as h from {{emails}} where source is not null and label is not null),
    p as (select *, row_number() over (partition by source, label order by h, record_id) as in_pair from r),
    s as (select *, row_number() over (partition by source order by h, record_id) as in_source from p where in_pair <= {pair_cap})
    select record_id, source, label from s where in_source <= {source_cap}"""


@statement("balance_caps")
def balance_caps(d: Spark) -> str:
    """At most 150 records of each source and label, then at most 250 of each source,
    in a hashed order.  The greedy loop over shuffled rows equals these two filters."""
    return capped(d, 150, 250)


def hashed_rank(d: Spark, source: str, by: str, key: str, h: str) -> str:
    """``ranked``: the rows of ``source`` with their rank ``n`` in the order of a hash
    within ``by``, and the size ``c`` of their group.

    Groups may hold any share of the rows: they are ranked in 4,096 buckets (the
    first digits of the hash), and only the counts of the buckets meet in one task.
    """
    return f"""h as (select *, {h} as h, substr({h}, 1, 3) as bucket from {source}),
    b as (select {by} as g, bucket, count(*) as k from h group by 1, 2),
    o as (select g, bucket, sum(k) over (partition by g order by bucket) - k as before, sum(k) over (partition by g) as c from b),
    ranked as (select h.*, o.c, o.before + row_number() over (partition by {by}, h.bucket order by h.h, {key}) as n from h join o on h.bucket = o.bucket and h.{by} = o.g)"""


@statement("split_stratified")
def split_stratified(d: Spark) -> str:
    """80/20 within each label, in a hashed order; the larger part is rounded up."""
    ranked = hashed_rank(d, "(select record_id, label from {emails} where label is not null)", "label", "record_id", d.sha256("concat(cast(record_id as varchar(20)), '#42')"))
    return f"with {ranked} select record_id, label, case when n <= ceil(c * 0.8) then 'train' else 'test' end as part from ranked"


@statement("split_nested")
def split_nested(d: Spark) -> str:
    """60/20/20 within each expected label of the joint cases; cases without a label form a group."""
    ranked = hashed_rank(d, "(select case_id, coalesce(expected_joint_label, '') as label from {joint_eval_cases})", "label", "case_id", d.sha256("concat(case_id, '#17')"))
    return f"with {ranked} select case_id, label, case when n <= ceil(c * 0.6) then 'train' when n <= ceil(c * 0.8) then 'dev' else 'test' end as part from ranked"


@statement("source_holdout")
def source_holdout(d: Spark) -> str:
    """Experiments that train on some sources and test on another: a join of a small
    configuration with the records."""
    return """with config as (select 'A' as experiment, 'enron' as source, 'train' as part union all select 'A', 'nazario', 'train' union all select 'A', 'spamassassin', 'test'
      union all select 'B', 'enron', 'train' union all select 'B', 'spamassassin', 'train' union all select 'B', 'nazario', 'test'
      union all select 'C', 'nazario', 'train' union all select 'C', 'spamassassin', 'train' union all select 'C', 'enron', 'test')
    select experiment, part, count(*) as records, sum(label) as positives, count(distinct label) = 2 as valid from {emails} e join config c on lower(trim(e.source)) = c.source where label in (0, 1) group by experiment, part"""


@statement("downsample")
def downsample(d: Spark) -> str:
    """At most 300 records in all, each label keeping its share."""
    ranked = hashed_rank(d, "(select record_id, label from {emails} where label is not null)", "label", "record_id", d.sha256("concat(cast(record_id as varchar(20)), '#3')"))
    total = "(select count(*) from {emails} where label is not null)"
    return f"with {ranked} select record_id, label from ranked where n <= round(300.0 * c / {total})"


@statement("label_clean")
def label_clean(d: Spark) -> str:
    """Numbers to 0/1: fractions are cut towards 0, anything else drops out."""
    return """with x as (select event_id, try_cast((value - 25) / 25 as double) as v from {events}), c as (select event_id, case when v < 0 then ceil(v) else floor(v) end as v from x where v is not null)
    select event_id, cast(v as int) as label from c where v in (0, 1)"""


@statement("label_fold")
def label_fold(d: Spark) -> str:
    return """select case_id, case when lower(trim(expected_joint_label)) in ('malicious', 'phishing', '1', 'true', 'yes') then 1 else 0 end as y from {joint_threshold_calibration_set}"""


@statement("numeric_columns")
def numeric_columns(d: Spark) -> str:
    """Share of values of each column that are numbers, in one pass; from 0.8 on a column is numeric."""
    cols = ("case_id", "subject", "body", "sender", "urls", "expected_joint_label", "note")
    shares = ", ".join(f"avg(case when try_cast({c} as double) is not null then 1.0 else 0.0 end) as {c}" for c in cols)
    rows = " union all ".join(f"select '{c}' as name, round(cast({c} as double), 6) as share from s" for c in cols)
    return f"with s as (select {shares} from {{joint_threshold_calibration_set}}), r as ({rows}) select name, share, share >= 0.8 as is_numeric from r"


def numeric_feature_columns(df: DataFrame, least: float = 0.8) -> list[str]:
    """Columns that hold numbers, identifiers and texts of the record left out.

    Raises ValueError if there is none.
    """
    skip = {"subject", "body", "sender", "sender_domain", "urls", "label", "source", "text", "index", "idx", "id"}
    names = [c for c in df.columns if c.lower() not in skip and not c.lower().startswith("unnamed") and not c.lower().endswith("_id")]
    if names:
        row = df.agg(*[F.avg(F.expr(f"cast(try_cast(cast(`{c}` as string) as double) is not null as int)")).alias(c) for c in names]).first()
        names = [c for c in names if (row[c] or 0) >= least]
    if not names:
        raise ValueError("no numeric feature column")
    return names


@query("median_impute", "select doc_id, cast(coalesce(n_chars, (select coalesce(median(n_chars), 0) from documents)) as double) as n_chars from documents")
def median_impute(spark, d):
    """Missing numbers become the median of the column, 0 if it has no number."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", F.coalesce(F.col("n_chars").cast("double"), F.lit(exact_median(docs, "n_chars"))).alias("n_chars"))


def exact_median(df: DataFrame, col: str, none: float = 0.0) -> float:
    """The median of a column, exactly: equal values are counted first, and only the
    counts of range partitions and the one or two middle values come to the driver."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("c"))
    parts = durable(counts.repartitionByRange("x").withColumn("_p", F.spark_partition_id()), "ranges")
    sizes = sorted((r["_p"], r["c"]) for r in parts.groupBy("_p").agg(F.sum("c").alias("c")).collect())  # one row a partition
    total = sum(c for _, c in sizes)
    if not total:
        return none
    found = []
    for at in {(total - 1) // 2, total // 2}:
        before = 0
        for p, c in sizes:
            if at < before + c:
                upto = F.sum("c").over(Window.orderBy("x"))
                found.append(parts.where(F.col("_p") == p).select("x", upto.alias("upto")).where(F.col("upto") > at - before).agg(F.min("x")).first()[0])
                break
            before += c
    return sum(found) / len(found)


@statement("numeric_fill")
def numeric_fill(d: Spark) -> str:
    return "select url, coalesce(try_cast(phish_id as double), 0.0) as phish_id from {url_corpus}"


def threshold_of(mode: str, given: str) -> str:
    """The given threshold within [0, 1], else that of the mode, else 0.5."""
    modes = " ".join(f"when '{m}' then {t}e0" for m, t in lx.MODE_THRESHOLDS.items())
    return f"(case when {given} is not null then greatest(0e0, least(1e0, {given})) else case lower(trim({mode})) {modes} else 0.5e0 end end)"


@statement("thresholds")
def thresholds(d: Spark) -> str:
    """Thresholds of requests: modes in any spelling, thresholds as text that may be none."""
    given = "try_cast(nullif(trim(difficulty), '') as double)"
    return f"""with r as (select case_id, case when scenario like 'link%' then 'SOC' when scenario like 'domain%' then ' High_Confidence ' when scenario like 'no%' then 'balanced' else scenario end as mode,
      case when case_id like '%1' then 1.7e0 when case_id like '%2' then -1e0 when case_id like '%3' then 0.33e0 else {given} end as given from {{joint_eval_cases}})
    select case_id, mode, given, {threshold_of('mode', 'given')} as threshold from r"""


@statement("valid_requests")
def valid_requests(d: Spark) -> str:
    """Requests that hold something to score, and the rest."""
    blank = "trim(coalesce({0}, '')) = ''"
    return f"select case_id, case when {blank.format('subject')} and {blank.format('body')} and {blank.format('urls')} then 'rejected' when {blank.format('subject')} and {blank.format('body')} then 'url_only' else 'accepted' end as status from {{joint_eval_cases}}"


def global_row_number(df: DataFrame, order: list[str], out: str = "n") -> DataFrame:
    """Numbers all rows from 1 in an order, without sorting them in one task: range
    partitions are numbered by themselves and shifted by the counts before them."""
    parts = durable(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    counts = sorted((r["_p"], r["count"]) for r in parts.groupBy("_p").count().collect())  # one row a partition
    before, total = [], 0
    for p, c in counts:
        before.append((p, total))
        total += c
    offsets = F.broadcast(df.sparkSession.createDataFrame(before, "_p int, _before bigint"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return parts.withColumn("_own", own).join(offsets, "_p").withColumn(out, F.col("_before") + F.col("_own")).drop("_p", "_own", "_before")


@query(
    "case_columns",
    """select coalesce(nullif(case_id, ''), concat('row-', cast(row_number() over (order by case_id) as varchar))) as case_id,
  coalesce(nullif(sender_name, ''), 'unknown') as sender, coalesce(nullif(expected_joint_label, ''), nullif(expected_email_label, ''), '') as expected_label from joint_eval_cases""",
)
def case_columns(spark, d):
    """Columns of case files by any of their names: an empty cell falls through to the next."""
    rows = global_row_number(spark.read.parquet(f"{d}/joint_eval_cases.parquet"), ["case_id"])
    cell = lambda c: F.expr(f"nullif({c}, '')")
    return rows.select(
        F.coalesce(cell("case_id"), F.concat(F.lit("row-"), F.col("n").cast("string"))).alias("case_id"),
        F.coalesce(cell("sender_name"), F.lit("unknown")).alias("sender"),
        F.coalesce(cell("expected_joint_label"), cell("expected_email_label"), F.lit("")).alias("expected_label"),
    )


@statement("corpus_union")
def corpus_union(d: Spark) -> str:
    """Rows of several corpora in one frame."""
    return """select source, count(*) as n, count(distinct body) as bodies from (select 'emails' as source, body from {emails} union all select 'cases', body from {joint_eval_cases} union all select 'calibration', body from {joint_threshold_calibration_set}) t group by source"""


@statement("corpus_sets")
def corpus_sets(d: Spark) -> str:
    """Domains that occur in both mail and aliases, and those of mail alone."""
    return """with a as (select distinct lower(trim(sender_domain)) as x from {emails} where sender_domain is not null), b as (select lower(trim(domain_name)) as x from {domain_aliases} union select lower(trim(same_as)) from {domain_aliases})
    select 'both' as part, count(*) as n from (select x from a intersect select x from b) t union all select 'mail only', count(*) from (select x from a except select x from b) t"""


@statement("top_senders")
def top_senders(d: Spark) -> str:
    """The ten domains with most mail (a report)."""
    return "select lower(trim(sender_domain)) as domain, count(*) as n from {emails} where trim(coalesce(sender_domain, '')) <> '' group by 1 order by n desc, domain limit 10"


@statement("error_scenarios_sorted")
def error_scenarios_sorted(d: Spark) -> str:
    """Scenarios by errors of two kinds, in mixed directions."""
    return """select scenario, difficulty, sum(case when expected_email_label <> expected_joint_label then 1 else 0 end) as email_errors, sum(case when expected_url_label <> expected_joint_label then 1 else 0 end) as url_errors from {joint_eval_cases} where scenario is not null
      group by scenario, difficulty order by email_errors asc, url_errors desc, scenario, difficulty"""


@statement("label_snippets")
def label_snippets(d: Spark) -> str:
    """Three snippets of each label, the earliest records."""
    return """select label, record_id, substr(body, 1, 80) as snippet from (select label, record_id, body, row_number() over (partition by label order by record_id) as n from {emails} where body is not null and label is not null) t where n <= 3"""


@query("row_index", "select concat('case_', lpad(cast(row_number() over (order by case_id) - 1 as varchar), 4, '0')) as row_id, case_id from joint_eval_cases")
def row_index(spark, d):
    """Row numbers in the order of the cases, as text."""
    rows = global_row_number(spark.read.parquet(f"{d}/joint_eval_cases.parquet").select("case_id"), ["case_id"])
    return rows.select(F.concat(F.lit("case_"), F.lpad((F.col("n") - 1).cast("string"), 4, "0")).alias("row_id"), "case_id")


@statement("late_records")
def late_records(d: Spark) -> str:
    """Records stored more than a day after they were received, by month."""
    return """select year(received_at) as y, month(received_at) as m, count(*) as n, count_if(ingested_at > received_at + interval '1' day) as late from {emails} where received_at is not null group by 1, 2"""


def salted_counts(df: DataFrame, key: str, salts: int = 64) -> DataFrame:
    """Counts of a key in two steps, for keys that hold a large share of all rows.

    Rows are spread at random over the salts, so that even without a partial
    aggregate no task gets a key as a whole.  Null is a key of its own.
    """
    salted = df.select(key, F.pmod(F.monotonically_increasing_id(), F.lit(salts)).alias("_salt"))
    return salted.groupBy(key, "_salt").agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(F.sum("n").alias("n"))


@query("salted_domain_counts", "select sender_domain, count(*) as n from emails group by sender_domain")
def salted_domain_counts(spark, d):
    return salted_counts(spark.read.parquet(f"{d}/emails.parquet").select("sender_domain", "record_id"), "sender_domain")


@statement("shuffled_urls")
def shuffled_urls(d: Spark) -> str:
    """URLs with their place in a hashed order, by range: no single task sorts all."""
    return f"select url, substr({d.sha256("concat(url, '#11')")}, 1, 16) as place from (select distinct url from {{url_corpus}} where url is not null) t order by place, url"
