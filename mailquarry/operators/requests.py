"""Requests and reports: batch rows, exports, key checks, comparison of reports."""

from __future__ import annotations

from ..functions.dialect import Spark
from ..functions.url import clamp, risk_level
from ..plans.catalogue import statement
from .metrics import SCORES, prf
from .scoring import RECOMMENDATIONS
from .texts import body_urls, strip


def batch_requests(d: Spark, source: str, mode: str) -> str:
    """Rows as requests: the single URL, then the listed ones, then those of the body,
    each once; in URL mode the texts are left out."""
    listed = d.keep(d.each(d.split(d.replace_all("coalesce(urls, '')", "[|\\n,;]", "|"), "|"), "v", strip(d, "v")), "v", "v <> ''")
    single = d.keep(d.array(strip(d, "coalesce(url, '')")), "v", "v <> ''")
    every = d.distinct(d.concat_arrays(d.concat_arrays("one", "given"), "found"))
    text = (lambda c: "''") if mode == "url" else (lambda c: f"coalesce({c}, '')")
    first = d.joined(d.head("all_urls", 1), "")
    return f"""with r as (select case_id, subject, body, sender, {single} as one, {listed} as given, {body_urls(d, 'body')} as found from {source}), q as (select *, {every} as all_urls from r)
    select case_id, '{mode}' as mode, {text('subject')} as subject, {text('body')} as body, {text('sender')} as sender, {d.joined('all_urls', ' ')} as urls, cast({d.size('all_urls')} as int) as n_urls, {first} as url_single from q"""


_CASES = "(select case_id, subject, body, sender_name as sender, urls, cast(null as varchar(20)) as url from {joint_eval_cases})"


@statement("batch_url_requests")
def batch_url_requests(d: Spark) -> str:
    return batch_requests(d, _CASES, "url")


@statement("batch_joint_requests")
def batch_joint_requests(d: Spark) -> str:
    return batch_requests(d, _CASES, "joint")


@statement("export_rows")
def export_rows(d: Spark) -> str:
    """The eight columns of a batch export: scores with four digits, rows in the order of the cases."""
    s = clamp("case expected_email_label when 'malicious' then 0.6e0 else 0.1e0 end + mod(length(coalesce(body, '')), 40) / 100e0")
    summary = "concat(coalesce(scenario, 'none'), ', ', coalesce(difficulty, 'none'))"
    return f"""with r as (select case_id, scenario, difficulty, {s} as s, row_number() over (order by case_id) - 1 as n from {{joint_eval_cases}}), p as (select *, {risk_level('s')} as level, cast(round(100 * s) as int) as pct from r)
    select cast(n as varchar(20)) as row_index, case_id, 'email' as mode, case when s >= 0.5 then 'phishing' else 'legitimate' end as label, {d.fixed('s', 4)} as score, level as risk_level,
      {RECOMMENDATIONS.format(level='level', pct='pct')} as recommendation, {summary} as explanation_summary from p"""


@statement("reason_keys")
def reason_keys(d: Spark) -> str:
    """Whether an object holds all keys asked for, and which it lacks."""
    keys = d.json_keys("props")
    lacks = lambda names: d.difference(d.text_array(names), keys)
    return f"select event_id, {d.size(lacks(['k']))} = 0 as has_key, {d.size(lacks(['k', 'note']))} = 0 as has_both, {d.joined(lacks(['k', 'note', 'value']), ',')} as lacks from {{events}}"


@statement("rank_list_head")
def rank_list_head(d: Spark) -> str:
    """The first hundred names of the rank list (a head scan, in the order of the list)."""
    return "select rank_pos, domain_name from {domain_ranks} order by rank_pos, domain_name limit 100"


@statement("report_comparison")
def report_comparison(d: Spark) -> str:
    """Recall and F1 of one report against another, by experiment; where the other has
    none the experiment stays, marked as missing."""
    state = lambda x: f"case when b.id is null then 'missing' when {x} > 0 then 'improved' when {x} < 0 then 'decreased' else 'unchanged' end"
    one = lambda name, score, least: f"{name}c as (select source as id, count(*) as n, count_if(y = 1 and {score} >= 0.5) as tp, count_if(y = 0 and {score} >= 0.5) as fp, count_if(y = 1 and {score} < 0.5) as fn, count_if(y = 0 and {score} < 0.5) as tn from scores where {least} group by source), {name} as (select id, {prf()} from {name}c)"
    return f"""with {SCORES}, {one('a', 's2', 'true')}, {one('b', 's', "source <> 'nazario'")}
    select a.id, a.recall_, a.f1, round(a.recall_ - b.recall_, 6) as recall_delta, round(a.f1 - b.f1, 6) as f1_delta, {state('a.recall_ - b.recall_')} as recall_state, {state('a.f1 - b.f1')} as f1_state from a left join b on a.id = b.id"""


@statement("best_variant")
def best_variant(d: Spark) -> str:
    """The best variant of each split among the runs that ended well and whose F1 is a number."""
    return f"""with {SCORES}, v as (select 'frozen' as variant, source as split, avg(case when (s >= 0.5) = (y = 1) then 1e0 else 0e0 end) as x from scores group by source
      union all select 'open', source, avg(case when (s2 >= 0.5) = (y = 1) then 1e0 else 0e0 end) from scores group by source),
    runs as (select variant, split, case when split = 'none' then 'skipped' when split = 'nazario' and variant = 'open' then 'failed' else 'ok' end as status, case when split = 'enron' and variant = 'open' then 'n/a' else {d.fixed('x', 6)} end as f1 from v),
    good as (select variant, split, try_cast(f1 as double) as f1 from runs where status = 'ok' and try_cast(f1 as double) is not null)
    select split, variant, f1 from (select *, row_number() over (partition by split order by f1 desc, variant) as n from good) t where n = 1"""
