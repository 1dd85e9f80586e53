"""Metric operators: confusion, ranking metrics, sweeps, drift, association.

All are exact and set-at-a-time: ties are handled by grouping equal scores
first, which also bounds the windows by the number of distinct scores.
"""

from __future__ import annotations

from .. import lexicons as lx
from ..functions.dialect import Spark
from ..plans.catalogue import statement
from .relational import hashed_rank

#: A deterministic score and a label of each record, as a model would give them.
SCORES = """scores as (select record_id, coalesce(source, 'none') as source, label as y,
  round(cast(0.3 * label as double) + mod(record_id * 37, 101) / 151.5e0, 4) as s, round(mod(record_id * 53, 97) / 140e0 + cast(0.3 * label as double), 4) as s2 from {emails} where label in (0, 1))"""

_PRF = """round((tp + tn) / cast(greatest(n, 1) as double), 6) as accuracy,
  round(case when tp + fp = 0 then 0 else tp / cast(tp + fp as double) end, 6) as precision_, round(case when tp + fn = 0 then 0 else tp / cast(tp + fn as double) end, 6) as recall_,
  round(case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / cast(2 * tp + fp + fn as double) end, 6) as f1,
  round(case when tp + fn = 0 then tn / cast(tn + fp as double) when tn + fp = 0 then tp / cast(tp + fn as double) else (tp / cast(tp + fn as double) + tn / cast(tn + fp as double)) / 2 end, 6) as balanced_accuracy"""


def prf() -> str:
    """Columns of accuracy, precision, recall, F1 and balanced accuracy over tp, fp, fn, tn and n."""
    return _PRF


def _counts(by: str, threshold: str = "0.5", score: str = "s") -> str:
    keys = f"{by}, " if by else ""
    group = f" group by {by}" if by else ""
    return f"""select {keys}count(*) as n, count_if(y = 1 and {score} >= {threshold}) as tp, count_if(y = 0 and {score} >= {threshold}) as fp,
      count_if(y = 1 and {score} < {threshold}) as fn, count_if(y = 0 and {score} < {threshold}) as tn from scores{group}"""


@statement("confusion")
def confusion(d: Spark) -> str:
    return f"with {SCORES} {_counts('source')}"


@statement("binary_metrics")
def binary_metrics(d: Spark) -> str:
    """Accuracy, precision, recall, F1 (0 where undefined), balanced accuracy (the
    mean over the classes that occur)."""
    return f"with {SCORES}, c as ({_counts('source')}) select source, {_PRF} from c"


#: Scores lie within 0 and about 1.1; equal ones are counted first, then they are ranked in
#: 1,024 ranges, and only the counts of the ranges meet in one task.
_RANKED = """g as (select source, s, cast(floor(s * 1024) as int) as bucket, count(*) as c, sum(y) as p from scores group by source, s),
  o as (select source, bucket, sum(c) as bc, sum(p) as bp from g group by source, bucket),
  o2 as (select source, bucket, sum(bc) over (partition by source order by bucket) - bc as below, sum(bc) over (partition by source order by bucket desc) - bc as over_c, sum(bp) over (partition by source order by bucket desc) - bp as over_p from o),
  r as (select g.source, g.s, g.c, g.p, below + sum(g.c) over (partition by g.source, g.bucket order by g.s) as upto, over_p + sum(g.p) over (partition by g.source, g.bucket order by g.s desc) as tp,
    over_c + sum(g.c) over (partition by g.source, g.bucket order by g.s desc) as above from g join o2 on g.source = o2.source and g.bucket = o2.bucket)"""


@statement("roc_auc")
def roc_auc(d: Spark) -> str:
    """Area under the ROC curve by mid-ranks; null where one class is missing."""
    return f"""with {SCORES}, {_RANKED},
    t as (select source, sum(p) as n1, sum(c - p) as n0, sum(p * (upto - c + (c + 1) / 2.0)) as ranks from r group by source)
    select source, round(case when n1 = 0 or n0 = 0 then null else cast((ranks - n1 * (n1 + 1) / 2.0) as double) / (cast(n1 as double) * n0) end, 6) as auc from t"""


@statement("average_precision")
def average_precision(d: Spark) -> str:
    """Sum of precision over the steps of recall (no interpolation)."""
    return f"""with {SCORES}, {_RANKED}, t as (select source, sum(p) as n1 from g group by source)
    select r.source, round(sum(case when n1 = 0 then 0 else (p / cast(n1 as double)) * (tp / cast(above as double)) end), 6) as ap from r join t on r.source = t.source group by r.source"""


@statement("classification_report")
def classification_report(d: Spark) -> str:
    """Precision, recall, F1 and support of each class, and their plain and weighted means."""
    prf = "tp, fp, fn, support"
    cell = """round(case when tp + fp = 0 then 0 else tp / cast(tp + fp as double) end, 6) as precision_, round(case when tp + fn = 0 then 0 else tp / cast(tp + fn as double) end, 6) as recall_,
      round(case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / cast(2 * tp + fp + fn as double) end, 6) as f1"""
    return f"""with {SCORES}, c as (select '1' as class, count_if(y = 1 and s >= 0.5) as tp, count_if(y = 0 and s >= 0.5) as fp, count_if(y = 1 and s < 0.5) as fn, count_if(y = 1) as support from scores
      union all select '0', count_if(y = 0 and s < 0.5), count_if(y = 1 and s < 0.5), count_if(y = 0 and s >= 0.5), count_if(y = 0) from scores),
    k as (select class, {cell}, support from (select class, {prf} from c) t)
    select class, precision_, recall_, f1, support from k
    union all select 'macro', round(avg(precision_), 6), round(avg(recall_), 6), round(avg(f1), 6), cast(sum(support) as bigint) from k
    union all select 'weighted', round(sum(precision_ * support) / sum(support), 6), round(sum(recall_ * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), cast(sum(support) as bigint) from k"""


def _sweep(d: Spark, first: int = 1, last: int = 19) -> str:
    grid = d.array(*[f"{k * 5 / 100}e0" for k in range(first, last + 1)])
    return f"""g0 as (select s, count(*) as c, sum(y) as p from scores group by s), g as (select s, c, p, {d.unnest(grid)} as threshold from g0),
    c as (select threshold, sum(c) as n, cast(sum(case when s >= threshold then p else 0 end) as bigint) as tp, cast(sum(case when s >= threshold then c - p else 0 end) as bigint) as fp,
      cast(sum(case when s < threshold then p else 0 end) as bigint) as fn, cast(sum(case when s < threshold then c - p else 0 end) as bigint) as tn from g group by threshold),
    m as (select threshold, tp, fp, fn, tn, {_PRF} from c)"""


@statement("threshold_sweep")
def threshold_sweep(d: Spark) -> str:
    """Metrics at nineteen thresholds: equal scores are counted first, so that the
    grid multiplies the distinct scores and not the rows."""
    return f"with {SCORES}, {_sweep(d)} select cast(threshold as double) as threshold, tp, fp, fn, tn, accuracy, precision_, recall_, f1, balanced_accuracy from m"


@statement("threshold_picks")
def threshold_picks(d: Spark) -> str:
    """Best accuracy (tie: F1), best F1 (tie: balanced accuracy), the middle of both,
    the best mean of three, and for few misses or few false alarms the highest recall or
    precision (ties: F1, then the other of the two); last tie: the smaller threshold."""
    orders = {"high_recall": "recall_ desc, f1 desc, precision_ desc", "high_precision": "precision_ desc, f1 desc, recall_ desc", "accuracy": "accuracy desc, f1 desc", "f1": "f1 desc, balanced_accuracy desc", "tradeoff": "0.5 * accuracy + 0.5 * f1 desc", "dev": "round((accuracy + balanced_accuracy + f1) / 3, 9) desc"}
    picks = " union all ".join(f"select '{k}' as pick, threshold, accuracy, f1 from (select *, row_number() over (order by {o}, threshold) as n from m) t where n = 1" for k, o in orders.items())
    return f"with {SCORES}, {_sweep(d)}, p as ({picks}) select pick, cast(threshold as double) as threshold, accuracy, f1 from p"


@statement("class_weights")
def class_weights(d: Spark) -> str:
    """Weights of the positive class in the three forms that trainers take."""
    return """with c as (select count_if(label = 1) as n1, count_if(label = 0) as n0 from {emails} where label in (0, 1))
    select round(greatest(n0, 1) / cast(greatest(n1, 1) as double), 6) as ratio, round(case when n1 = 0 then 1e0 else greatest(1e0, n0 / cast(n1 as double)) end, 6) as pos_weight,
      round((n0 + n1) / (2e0 * greatest(n1, 1)), 6) as balanced_1, round((n0 + n1) / (2e0 * greatest(n0, 1)), 6) as balanced_0 from c"""


@statement("mean_probability")
def mean_probability(d: Spark) -> str:
    """Mean score of either class; with one class alone the mean of all stands under the negatives."""
    rows = "select source, s, y from scores union all select 'positives only', s, y from scores where y = 1"
    return f"""with {SCORES}, r as ({rows}), t as (select source, avg(case when y = 1 then s end) as pos, avg(case when y = 0 then s end) as neg, avg(s) as mean, count(distinct y) as classes from r group by source)
    select source, round(case when classes > 1 then pos end, 6) as positives, round(case when classes > 1 then neg else mean end, 6) as negatives, classes from t"""


#: Numeric features of a record in long form.
def features(d: Spark) -> str:
    """``long``: one row for each record and feature, from one scan."""
    names = d.text_array(["body_length", "subject_length", "exclamations", "urls_length"])
    return f"""wide as (select coalesce(source, 'none') as source, label as y, length(coalesce(body, '')) as f1, length(coalesce(subject, '')) as f2,
    length(coalesce(body, '')) - length(replace(coalesce(body, ''), '!', '')) as f3, length(coalesce(urls, '')) as f4, {d.unnest(names)} as feature from {{emails}} where label in (0, 1)),
  long as (select source, y, feature, cast(case feature when 'body_length' then f1 when 'subject_length' then f2 when 'exclamations' then f3 else f4 end as double) as x from wide)"""


@statement("feature_drift")
def feature_drift(d: Spark) -> str:
    """Mean and population deviation of each feature in each source."""
    return f"with {features(d)} select feature, source, round(avg(x), 6) as mean, round(stddev_pop(x), 6) as deviation, count(*) as n from long group by feature, source"


@statement("feature_label_correlation")
def feature_label_correlation(d: Spark) -> str:
    return f"with {features(d)} select feature, round(case when stddev_pop(x) > 1e-12 and stddev_pop(y) > 1e-12 then corr(x, cast(y as double)) else 0 end, 6) as r from long group by feature"


_ETA = """k as (select feature, source, avg(x) as m, count(*) as n from long group by feature, source),
  a as (select feature, avg(x) as m, var_pop(x) * count(*) as total from long group by feature),
  e as (select k.feature, case when max(a.total) > 1e-12 then sum(k.n * (k.m - a.m) * (k.m - a.m)) / max(a.total) else 0 end as eta2 from k join a on k.feature = a.feature group by k.feature)"""


@statement("eta_squared")
def eta_squared(d: Spark) -> str:
    """Share of a feature's variance that lies between the sources."""
    return f"with {features(d)}, {_ETA} select feature, round(eta2, 6) as eta2 from e"


#: Values are counted first and summed up within 256 ranges of each feature; ranges meet as counts.
_KS = """e0 as (select feature, min(x) as low, max(x) as high from long group by feature),
  v as (select l.feature, source, x, cast(floor(case when high > low then 255 * (x - low) / (high - low) else 0 end) as int) as bucket, count(*) as c from long l join e0 on l.feature = e0.feature group by l.feature, source, x, low, high),
  b as (select a.feature, a.source as s1, z.source as s2, a.n as n1, z.n as n2 from (select feature, source, sum(c) as n from v group by feature, source) a join (select feature as feature2, source, sum(c) as n from v group by feature, source) z on a.feature = z.feature2 and a.source < z.source),
  w as (select b.feature, s1, s2, bucket, x, sum(case when v.source = s1 then c else 0 end) / cast(max(n1) as double) as d1, sum(case when v.source = s2 then c else 0 end) / cast(max(n2) as double) as d2
    from b join v on b.feature = v.feature and (v.source = b.s1 or v.source = b.s2) group by b.feature, s1, s2, bucket, x),
  wb as (select feature, s1, s2, bucket, sum(d1 - d2) as d from w group by feature, s1, s2, bucket), wo as (select feature, s1, s2, bucket, sum(d) over (partition by feature, s1, s2 order by bucket) - d as before from wb),
  f as (select w.feature, w.s1, w.s2, abs(before + sum(d1 - d2) over (partition by w.feature, w.s1, w.s2, w.bucket order by x)) as gap from w join wo on w.feature = wo.feature and w.s1 = wo.s1 and w.s2 = wo.s2 and w.bucket = wo.bucket),
  ks as (select feature, s1, s2, max(gap) as ks from f group by feature, s1, s2)"""

#: How well a feature alone tells the source: shares of records that lie nearest to the mean of their own source.
_LEAK = """lm as (select feature, source, avg(x) as m from long group by feature, source), lc as (select l.feature, l.source, l.x, lm.source as guess, row_number() over (partition by l.feature, l.source, l.x order by abs(l.x - lm.m), lm.source) as n, c
    from (select feature, source, x, count(*) as c from long where feature <> 'urls_length' group by feature, source, x) l join lm on l.feature = lm.feature),
  leak as (select feature, sum(case when guess = source then c else 0 end) / cast(sum(c) as double) as leak from lc where n = 1 group by feature)"""


def _risks(d: Spark) -> str:
    """``risks``: association of each feature left joined with its leakage (0 where it has none) and its risk."""
    return f"""{features(d)}, {_ETA}, {_KS}, {_LEAK}, r as (select feature, case when stddev_pop(x) > 1e-12 and stddev_pop(y) > 1e-12 then abs(corr(x, cast(y as double))) else 0 end as r from long group by feature),
    j as (select e.feature, round(eta2, 9) as eta2, round(max(ks), 9) as max_ks, round(max(r), 9) as r from e join ks on e.feature = ks.feature join r on e.feature = r.feature group by e.feature, eta2),
    risks as (select j.feature, eta2, max_ks, r, round(coalesce(leak, 0e0), 9) as leak, round(1.5 * eta2 + max_ks + greatest(0e0, coalesce(leak, 0e0) - 0.43e0) - 0.8 * r, 6) as risk from j left join leak on j.feature = leak.feature)"""


@statement("ks_pairs")
def ks_pairs(d: Spark) -> str:
    """Two-sample Kolmogorov-Smirnov statistic of each feature and pair of sources."""
    return f"with {features(d)}, {_KS} select feature, s1, s2, round(ks, 6) as ks from ks"


@statement("feature_risk")
def feature_risk(d: Spark) -> str:
    """Risk of a feature to tell sources rather than labels."""
    return f"with {_risks(d)} select feature, round(eta2, 6) as eta2, round(max_ks, 6) as max_ks, round(r, 6) as r, round(leak, 6) as leak, risk from risks"


@statement("portability_verdict")
def portability_verdict(d: Spark, max_gain: float | None = None) -> str:
    """Whether the features as a set are portable between sources.

    ``max_gain``: what the best of them adds to the F1 of text alone; without it
    their help counts as weak.
    """
    weak = "true" if max_gain is None or max_gain < 0.005 else "false"
    return f"""with {_risks(d)}, t as (select count(*) as n, count_if(eta2 >= 0.10 and max_ks >= 0.35 and leak >= 0.55) as high, max(leak) as max_leak, max(max_ks) as max_ks from risks)
    select high, round(max_leak, 6) as max_leak, round(max_ks, 6) as max_ks, case when {weak} and max_leak >= 0.55 and max_ks >= 0.35 then 'NOT portable' when high >= greatest(3, ceil(0.4 * n)) then 'NOT portable' when high >= 2 then 'partially portable' else 'portable' end as verdict from t"""


@statement("feature_ranking")
def feature_ranking(d: Spark) -> str:
    """The five features tied most to the source, the five with the weakest tie to the label, and the three of most risk."""
    lists = {"source": ("eta2 desc, leak desc, max_ks desc", 5), "weak_label": ("r", 5), "risk": ("risk desc", 3)}
    return f"with {_risks(d)} " + " union all ".join(f"select '{k}' as list, cast(n as int) as pos, feature from (select feature, row_number() over (order by {o}, feature) as n from risks) t{k} where n <= {most}" for k, (o, most) in lists.items())


_STRATEGY = """cases as (select case_id, coalesce(scenario, 'none') as scenario, case when expected_joint_label = 'malicious' then 1 else 0 end as y,
    case when expected_email_label = 'malicious' then 1 else 0 end as base, case when expected_url_label = 'malicious' then 1 else 0 end as opt from {joint_eval_cases})"""


@statement("error_status")
def error_status(d: Spark) -> str:
    """What the second strategy changed in each case."""
    return f"""with {_STRATEGY} select case_id, case when base = y and opt = y then 'both_correct' when opt = y then 'corrected' when base = y then 'newly_broken' else 'both_wrong' end as status from cases"""


@statement("error_counts")
def error_counts(d: Spark) -> str:
    """How many cases the second strategy corrected and how many it broke."""
    return f"with {_STRATEGY} select count_if(base <> y and opt = y) as corrected, count_if(base = y and opt <> y) as newly_broken, count_if(base = y and opt = y) as both_correct, count_if(base <> y and opt <> y) as both_wrong from cases"


@statement("error_pivot")
def error_pivot(d: Spark) -> str:
    """Errors of each scenario by strategy and kind, and the net change."""
    return f"""with {_STRATEGY} select scenario, count_if(base = 1 and y = 0) as baseline_false_positive, count_if(base = 0 and y = 1) as baseline_false_negative,
      count_if(opt = 1 and y = 0) as optimized_false_positive, count_if(opt = 0 and y = 1) as optimized_false_negative, count_if(opt <> y) - count_if(base <> y) as net_change from cases group by scenario"""


@statement("error_top")
def error_top(d: Spark) -> str:
    """The five scenarios with most false positives of the second strategy, and the five with most false negatives."""
    kinds = {"false_positive": "opt = 1 and y = 0", "false_negative": "opt = 0 and y = 1"}
    counts = " union all ".join(f"select '{k}' as kind, scenario, count_if({c}) as errors from cases group by scenario" for k, c in kinds.items())
    return f"with {_STRATEGY}, c as ({counts}), r as (select kind, scenario, errors, cast(row_number() over (partition by kind order by errors desc, scenario) as int) as pos from c where errors > 0) select * from r where pos <= 5"


@statement("repeat_metrics")
def repeat_metrics(d: Spark) -> str:
    """Mean and sample deviation of accuracy over repeated hashed test parts, and the
    repeats that the second strategy wins: one grouped pass over (case, repeat)."""
    seeds = d.unnest(d.array("17", "23", "31", "47", "59"))
    h = d.sha256("concat(case_id, '#', cast(seed as varchar(20)))")
    # ranked in buckets of the hash, as a seed and label hold half of all cases
    ranked = hashed_rank(d, f"(select *, concat(cast(seed as varchar(20)), '/', cast(y as varchar(20))) as part from (select *, {seeds} as seed from cases) e)", "part", "case_id", h)
    return f"""with {_STRATEGY}, {ranked}, k as (select seed, y, base, opt, n, c from ranked),
    m as (select seed, avg(case when base = y then 1e0 else 0e0 end) as a, avg(case when opt = y then 1e0 else 0e0 end) as b from k where n > ceil(c * 0.8) group by seed)
    select round(cast(avg(a) as double), 6) as base_mean, round(coalesce(stddev_samp(a), 0), 6) as base_std, round(cast(avg(b) as double), 6) as opt_mean, round(coalesce(stddev_samp(b), 0), 6) as opt_std, count_if(b > a) as wins from m"""


@statement("variant_pairs")
def variant_pairs(d: Spark) -> str:
    """Differences between two variants on the splits where both have a result."""
    return f"""with {SCORES}, v as (select 'frozen' as variant, source as split, avg(case when (s >= 0.5) = (y = 1) then 1e0 else 0e0 end) as f1 from scores group by source
      union all select 'open', source, avg(case when (s2 >= 0.5) = (y = 1) then 1e0 else 0e0 end) from scores where source <> 'none' group by source),
    ok as (select * from v where split <> 'spamassassin' or variant <> 'open')
    select round(cast(avg(a.f1 - b.f1) as double), 6) as mean_delta, count(*) as splits from ok a join ok b on a.split = b.split where a.variant = 'frozen' and b.variant = 'open'"""


@statement("label_counts_json")
def label_counts_json(d: Spark) -> str:
    """Label counts of each source as text."""
    text = "concat(chr(123), '\"0\":', cast(n0 as varchar(20)), ',\"1\":', cast(n1 as varchar(20)), chr(125))"
    return f"select source, {text} as counts from (select source, count_if(label = 0) as n0, count_if(label = 1) as n1 from {{emails}} where source is not null group by source) t"


@statement("metric_change_text")
def metric_change_text(d: Spark) -> str:
    """What a change of F1 between two variants means, in words, by a band of 0.02."""
    return f"""with {SCORES}, a as (select source, avg(case when (s >= 0.5) = (y = 1) then 1e0 else 0e0 end) as x, avg(case when (s2 >= 0.5) = (y = 1) then 1e0 else 0e0 end) as z from scores group by source)
    select source, round(z - x, 6) as delta, case when z - x > 0.02 then 'improved' when z - x < -0.02 then 'worse' else 'about the same' end as meaning from a"""


@statement("reason_classes")
def reason_classes(d: Spark) -> str:
    """Classes of case notes by their words; harmless words are looked for first, so that a mismatch counts as a match."""
    note = "lower(coalesce(note, ''))"
    return f"""select case_id, case when {d.matches(note, lx.BENIGN_REASONS)} then 'benign' when {d.matches(note, lx.SUSPICIOUS_REASONS)} then 'suspicious' else 'neutral' end as class from {{joint_threshold_calibration_set}}"""
