"""Scoring of URLs, messages and both together.

Scores of models are inputs.  What happens to them is a table of steps, each
with a condition; ``ladder`` folds the steps in order into one expression, so
that order, floors and caps stay visible as data and Catalyst sees plain
arithmetic.
"""

from __future__ import annotations

from typing import NamedTuple

from .. import lexicons as lx
from ..functions.dialect import Spark, any_of, entropy, hits
from ..functions.url import clamp, closest_trusted, hard_signs, host_columns, lure_flags, model_features, parts, risk_level, shown_as_trusted, trust_kind
from ..plans.catalogue import statement
from .relational import threshold_of
from .texts import body_urls, canonical, sender_domain
from .urls import FIRST_REASONS, REASONS, heuristics, listed


class Step(NamedTuple):
    """add, cap (not above) or floor (not below) a value where a condition holds."""

    how: str
    value: float
    when: str
    reason: str = ""


def ladder(start: str, steps: list[Step]) -> str:
    """The score after all steps, in order; each step uses the score before once."""
    score = start
    for how, value, when, _ in steps:
        if how == "add":
            score = f"({score} + case when {when} then {value}e0 else 0e0 end)"
        elif how == "cap":
            score = f"least({score}, case when {when} then {value}e0 else 9e0 end)"
        else:
            score = f"greatest({score}, case when {when} then {value}e0 else -9e0 end)"
    return score


def reasons(d: Spark, steps: list[Step], first: str = "") -> str:
    """Array of the reasons of the steps that apply, in order."""
    return listed(d, [*([(first, "true")] if first else []), *[(x.reason, x.when) for x in steps if x.reason]])


#: Optimised joint score (fixed values): u is the highest URL score, sig the number of hard signs.
JOINT_STEPS = [
    Step("add", 0.10, "has_urls and sig >= 2", "url_signs_strong"),
    Step("add", 0.05, "has_urls and sig = 1", "url_signs_moderate"),
    Step("add", 0.12, "has_urls and mismatch >= 0.75", "mismatch_to_untrusted_url"),
    Step("add", 0.06, "has_urls and mismatch >= 0.35 and mismatch < 0.75", "mismatch"),
    Step("add", -0.12, "has_urls and trusted_match and sig = 0", "trusted_match"),
    Step("cap", 0.32, "has_urls and legit_alert and trusted_match and not brand_mismatch", "security_alert_of_trusted_domain"),
    Step("cap", 0.42, "has_urls and reputable_count >= url_count and not brand_mismatch and sig = 0 and benign_hits + internal_hits >= 1 and u <= 0.6", "reputable_urls_and_benign_text"),
    Step("cap", 0.38, "has_urls and benign_hits >= 2 and reputable_count >= 1 and sig = 0 and u <= 0.35", "benign_phrases_and_reputable_url"),
    Step("add", 0.04, "has_urls and mixed_reputation", "mixed_reputation"),
    Step("floor", 0.72, "has_urls and escalation", "suspicious_url_structure"),
    Step("add", 0.06, "has_urls and escalation"),
    Step("floor", 0.74, "has_urls and trusted_match and not brand_mismatch and email_lex >= 2 and urgency_hits >= 1 and (high_intent_hits >= 1 or credential_hits + restriction_hits >= 2)", "high_intent_text"),
    Step("floor", 0.80, "has_urls and multi_conflict and strongest_bad", "malicious_url_among_others"),
    Step("floor", 0.66, "not has_urls and bad_without_url", "malicious_text_without_url"),
    Step("cap", 0.25, "not has_urls and benign_without_url", "benign_text_without_url"),
    Step("cap", 0.40, "not has_urls and not benign_without_url and benign_hits >= 2 and email_lex <= 1", "informational_text_without_url"),
    Step("floor", 0.70, "bad_url_conflict", "benign_text_and_bad_url"),
    Step("floor", 0.84, "ip_count > 0", "address_host"),
    Step("floor", 0.86, "typosquat_count > 0", "lookalike_host"),
]
#: Baseline joint score after the blend and the boost (fixed values).
BASELINE_STEPS = [
    Step("floor", 0.68, "has_urls and base_mismatch >= 0.75 and (e >= 0.6 or top >= 0.4)", "strong_mismatch"),
    Step("floor", 0.62, "not has_urls and stealth_hits >= 2 and e >= 0.45", "hard_text_without_url"),
    Step("floor", 0.90, "has_urls and top >= 0.9", "extreme_url"),
    Step("floor", 0.90, "not has_urls and e >= 0.9", "extreme_text_without_url"),
    Step("floor", 0.92, "has_urls and e >= 0.75 and top >= 0.75", "both_channels"),
    Step("add", 0.05, "risky_count >= 2", "several_risky_urls"),
    Step("cap", 0.97, "risky_count >= 2"),
]
#: Guards of the e-mail score s (fixed values).
EMAIL_STEPS = [
    Step("cap", 0.35, "all_reputable and statement_hints > 0 and urgency_hints = 0 and s < 0.97", "reputable_statement_notification_guard"),
    Step("cap", 0.32, "all_reputable and transaction_hints >= 2 and urgency_hints = 0 and stealth_hints = 0 and credential_hints <= 1 and s < 0.97 and trusted_count > 0", "transactional_benign_guard"),
    Step("cap", 0.38, "all_reputable and transaction_hints >= 2 and urgency_hints = 0 and stealth_hints = 0 and credential_hints <= 1 and s < 0.97 and trusted_count = 0", "transactional_benign_guard"),
]
#: What follows from an e-mail score (fixed values).
ACTIONS = [(0.8, "Escalate immediately and quarantine related messages."), (0.5, "Flag for analyst review before user interaction."), (0.3, "Monitor and inspect links/sender context."), (-1.0, "Likely legitimate; keep routine monitoring.")]

#: Stand-ins for model scores, so that the queries run without a trained model.
EMAIL_SCORE = "round(0.45e0 * coalesce(label, 0) + mod(record_id * 37, 101) / 202e0, 4)"
URL_SCORE = "least(0.99e0, 0.05e0 + 0.25e0 * cast(is_ip as int) + 0.1e0 * path_risk_score + 0.15e0 * cast(non_https as int) + 0.2e0 * cast(suspicious_host_shape as int))"


_RANKS = "(select lower(case when domain_name like 'www.%' then substr(domain_name, 5) else domain_name end) as ranked_name, min(rank_pos) as sender_rank from {domain_ranks} group by 1)"
MOST_URLS = 20


def _texts(d: Spark) -> str:
    """``texts``: a row a message with what its own texts say, no long text in it.

    Columns: the e-mail score e, lexicon counts, sender's registrable domain and
    whether it is good, the hint (that domain or the brand named), and all URLs.
    """
    stored = d.replace_all("replace(coalesce(urls, ''), '\\/', '/')" if d.name == "oracle" else "replace(coalesce(urls, ''), r'\\/', '/')", "[|;,]+[ ]*(https?://|www[.])", " $1")
    lists = {"urgency": lx.URGENCY, "credential": lx.CREDENTIAL, "finance": lx.FINANCE, "restriction": lx.RESTRICTION, "benign": lx.BENIGN, "internal": lx.INTERNAL, "high_intent": lx.HIGH_INTENT}
    lex = ", ".join(f"{hits('txt', v)} as {k}_hits" for k, v in lists.items())
    hint = " ".join(f"when contains(lower(coalesce(sender, '')), '{b}') then '{x}'" for b, x in lx.SENDER_BRANDS.items())
    good = f"({trust_kind(d, 'sender_reg', 'sender_reg')} <> 'untrusted')"
    return f"""t0 as (select record_id, {clamp(EMAIL_SCORE)} as e, lower(concat(coalesce(subject, ''), ' ', coalesce(body, ''))) as txt, lower({canonical(d)}) as mail, {body_urls(d, f"concat({stored}, ' ', coalesce(body, ''))")} as found,
      {sender_domain(d, 'sender')} as domain, case {hint} else '' end as brand from {{emails}}),
    t1 as (select record_id, e, found, brand, {lex}, {hits('mail', lx.STEALTH_HINTS)} as stealth_hits, {host_columns(d, 'domain')} from t0),
    t2 as (select *, registrable as sender_reg from t1),
    texts as (select record_id, e, found, urgency_hits, credential_hits, finance_hits, restriction_hits, benign_hits, internal_hits, high_intent_hits, stealth_hits, sender_reg,
      case when sender_reg <> '' then sender_reg else brand end as hint, ({good} or coalesce(sender_rank <= 20000, false)) as sender_good from t2 left join {_RANKS} k on sender_reg = ranked_name)"""


def _per_url(d: Spark) -> str:
    """``per_url``: all URLs of each message with heuristics, score and hard signs; the first 20 are analysed."""
    source = f"(select record_id, sender_reg, hint, found, {d.unnest('found')} as url from texts)"
    hard = " or ".join(hard_signs(d).values())
    return f"""{_texts(d)}, {heuristics(d, source)},
    p0 as (select *, {d.position('found', 'url')} as pos, {URL_SCORE} as url_score, ({hard}) as hard_sign, {lure_flags(d=d)} from heur),
    per_url as (select *, pos <= {MOST_URLS} as analysed, trusted or top_ranked as good,
      (hard_sign or typosquat_hit or (not trusted and ((is_ip and sensitive_path) or redirect_target or lure_pattern))) as hard_cue from p0)"""


def _messages(d: Spark) -> str:
    """Messages with the rollup of their URLs; ``m``.  URLs are exploded once and
    grouped once; the sender's hint travels with them, and no text is shuffled."""
    count = lambda c, name: f"count_if({c}) as {name}"
    zero = "url_count analysed_count risky_count ip_count shortener_count tld_count deep_count keyword_total path_risk_total non_https_count punycode_count shape_count compound_count brand_total typosquat_count trusted_count trusted_subdomain_count trusted_exact_count reputable_count good_count cue_count same same_reputable other_bad named sender_same sender_unknown".split()
    counts = ", ".join(f"coalesce(r.{c}, 0) as {c}" for c in zero)
    return f"""{_per_url(d)},
    rolled as (select record_id, count(*) as url_count, {count('analysed', 'analysed_count')}, max(case when analysed then url_score end) as u, avg(case when analysed then url_score end) as avg_u, {count('analysed and url_score >= 0.5', 'risky_count')},
      {count('is_ip', 'ip_count')}, {count('has_shortener', 'shortener_count')}, {count('suspicious_tld', 'tld_count')}, {count('depth >= 3', 'deep_count')},
      sum(keyword_hits) as keyword_total, sum(path_risk_score) as path_risk_total, {count('non_https', 'non_https_count')}, {count('punycode_like', 'punycode_count')},
      {count('suspicious_host_shape', 'shape_count')}, {count('suspicious_compound_hostname', 'compound_count')}, sum(brand_token_hits) as brand_total,
      {count('typosquat_hit', 'typosquat_count')}, {count('trusted', 'trusted_count')}, {count('trusted_subdomain', 'trusted_subdomain_count')},
      {count('trusted_exact', 'trusted_exact_count')}, {count('reputable', 'reputable_count')}, {count('analysed and good', 'good_count')}, {count('analysed and hard_cue', 'cue_count')},
      {count("registrable = hint and hint <> ''", 'same')}, {count("registrable = hint and hint <> '' and reputable", 'same_reputable')}, {count('registrable <> hint and not reputable', 'other_bad')}, {count("registrable <> ''", 'named')},
      {count("registrable = sender_reg and sender_reg <> ''", 'sender_same')}, {count("registrable <> '' and not good", 'sender_unknown')} from per_url group by record_id),
    m0 as (select t.record_id, t.e, t.urgency_hits, t.credential_hits, t.finance_hits, t.restriction_hits, t.benign_hits, t.internal_hits, t.high_intent_hits, t.stealth_hits, t.sender_reg, t.hint, t.sender_good,
      coalesce(r.u, 0e0) as u, coalesce(r.avg_u, 0e0) as avg_u, {counts} from texts t left join rolled r on t.record_id = r.record_id),
    m1 as (select *, url_count > 0 as has_urls, hint <> '' and same > 0 as sender_match, hint <> '' and same = 0 and named > 0 as brand_mismatch, hint <> '' and same_reputable > 0 as trusted_match,
      case when sender_reg = '' or named = 0 or sender_same > 0 then 0e0 when sender_unknown > 0 and sender_good then 0.8e0 when sender_unknown > 0 then 0.6e0 else 0.35e0 end as base_mismatch,
      url_count - trusted_count as untrusted_count, trusted_count > 0 and url_count > trusted_count as mixed_reputation,
      (ip_count > 0 or typosquat_count > 0 or tld_count > 0 or punycode_count > 0 or u >= 0.8) as url_hard from m0),
    m2 as (select *, case when brand_mismatch then case when other_bad > 0 then 0.85e0 else 0.45e0 end else 0e0 end as mismatch, urgency_hits + credential_hits + finance_hits + restriction_hits as email_lex from m1),
    m3 as (select *, ip_count + shortener_count + tld_count + deep_count + typosquat_count + punycode_count + cast(url_hard as int) as sig,
      (not has_urls and e >= 0.55 and email_lex >= 2) as bad_without_url, benign_hits >= 2 and u >= 0.7 as bad_url_conflict,
      (not has_urls and urgency_hits <= 2 and credential_hits = 0 and finance_hits <= 1 and restriction_hits = 0 and (benign_hits >= 1 or internal_hits >= 1)) as benign_without_url,
      (has_urls and trusted_match and not brand_mismatch and email_lex <= 2 and urgency_hits <= 1 and high_intent_hits = 0 and credential_hits + restriction_hits >= 1 and u <= 0.45 and not url_hard) as legit_alert,
      (has_urls and (compound_count > 0 or (brand_total > 0 and trusted_count = 0 and trusted_subdomain_count = 0)) and (path_risk_total > 0 or keyword_total > 0) and (untrusted_count > 0 or u >= 0.55)) as escalation,
      (url_count > 1 and reputable_count > 0 and (url_hard or u >= 0.68)) as multi_conflict from m2),
    m as (select *, (url_hard or u >= 0.82 or (escalation and u >= 0.6)) as strongest_bad, analysed_count > 0 and good_count = analysed_count and cue_count = 0 as calm from m3)"""


def verdict(score: str, threshold: str = "0.5e0") -> str:
    return f"case when {score} >= {threshold} then 'phishing' else 'legitimate' end"


_OPTIMISED = "(0.56e0 * e + 0.44e0 * u)"


@statement("joint_scores")
def joint_scores(d: Spark, threshold: str = "0.5e0") -> str:
    """Flagship: every message with its URLs rolled up, scored by the optimised rules."""
    score = clamp(f"round({ladder(_OPTIMISED, JOINT_STEPS)}, 9)")
    return f"""with {_messages(d)}, z as (select record_id, url_count, e, u, {score} as score from m)
    select record_id, cast(url_count as bigint) as url_count, round(e, 6) as email_score, round(u, 6) as url_score, round(score, 6) as joint_score, {verdict('score', threshold)} as verdict, {risk_level('score')} as risk_level from z"""


#: Heuristic features of a message by their published names (fixed values).
JOINT_FEATURES = {
    "has_urls": "has_urls", "url_count": "url_count", "ip_url_count": "ip_count", "shortener_count": "shortener_count", "suspicious_tld_count": "tld_count", "deep_subdomain_count": "deep_count",
    "url_keyword_total": "keyword_total", "path_risk_total": "path_risk_total", "non_https_count": "non_https_count", "punycode_count": "punycode_count", "suspicious_host_shape_count": "shape_count",
    "suspicious_compound_count": "compound_count", "brand_token_total": "brand_total", "typosquat_count": "typosquat_count", "trusted_url_count": "trusted_count", "trusted_subdomain_count": "trusted_subdomain_count",
    "trusted_exact_count": "trusted_exact_count", "reputable_url_count": "reputable_count", "untrusted_url_count": "untrusted_count", "mixed_url_reputation": "mixed_reputation", "sender_url_match": "sender_match",
    "sender_url_mismatch": "brand_mismatch", "trusted_domain_match": "trusted_match", "brand_domain_mismatch": "brand_mismatch", "urgency_hits": "urgency_hits", "credential_hits": "credential_hits",
    "finance_hits": "finance_hits", "restriction_hits": "restriction_hits", "benign_hits": "benign_hits", "internal_hits": "internal_hits", "high_intent_hits": "high_intent_hits", "suspicious_email_lex": "email_lex",
    "baseline_url_hard": "url_hard", "malicious_email_no_url": "bad_without_url", "benign_email_bad_url_conflict": "bad_url_conflict", "no_url_benign_support": "benign_without_url",
    "legit_security_alert_support": "legit_alert", "suspicious_url_escalation": "escalation", "multi_url_conflict": "multi_conflict", "strongest_url_malicious": "strongest_bad",
}


@statement("joint_features")
def joint_features(d: Spark) -> str:
    """The heuristic features of a message."""
    cols = ", ".join(f"cast({c} as bigint) as h_{k}" for k, c in JOINT_FEATURES.items())
    return f"with {_messages(d)} select record_id, {cols}, round(u, 6) as h_max_url_score, mismatch as h_sender_url_mismatch_score from m"


def _baseline(d: Spark, messages: str | None = None) -> tuple[str, str]:
    """Tables up to ``m7`` and the baseline score over it."""
    tables = f"""{messages or _messages(d)}, m5 as (select *, case when calm then least(u, 0.45e0) else u end as top, has_urls and base_mismatch > 0 as apart from m),
    m6 as (select *, calm and top <= 0.1 and risky_count = 0 as low, apart and (e >= 0.45 or top >= 0.35 or stealth_hits >= 1) as boosted from m5),
    m7 as (select *, case when low then 0.45e0 when calm then 0.65e0 else 0.6e0 end as we, case when low then 0.55e0 when calm then 0.35e0 else 0.4e0 end as wu, case when low then 0.45e0 else 9e0 end as most from m6)"""
    start = "least(least(we * e + wu * top, most) + case when boosted then least(0.18e0, 0.2e0 * base_mismatch) else 0e0 end, case when boosted then 0.99e0 else 9e0 end)"
    return tables, clamp(f"round({ladder(start, BASELINE_STEPS)}, 9)")


def _baseline_reasons(d: Spark) -> str:
    own = [("base_blend", "true"), ("reputation_dampening", "calm"), ("low_risk_guard", "low"), ("sender_url_mismatch", "boosted")]
    return listed(d, [*own, *[(x.reason, x.when) for x in BASELINE_STEPS if x.reason]])


@statement("joint_baseline")
def joint_baseline(d: Spark, threshold: str = "0.5e0") -> str:
    """The baseline blend: weights by reputation, then boosts, floors and caps in order."""
    tables, score = _baseline(d)
    return f"""with {tables}, z as (select record_id, risky_count, {score} as score from m7)
    select record_id, cast(risky_count as bigint) as risky_count, round(score, 6) as score, {verdict('score', threshold)} as verdict, {risk_level('score')} as risk_level from z"""


@statement("joint_assembly")
def joint_assembly(d: Spark, threshold: str = threshold_of("'balanced'", "cast(null as double)")) -> str:
    """Both strategies of each message with weights, reasons in order and flags.

    The optimised strategy replaces score, verdict and risk of the baseline and adds
    its reasons after those of the baseline.
    """
    tables, score = _baseline(d)
    better = clamp(f"round({ladder(_OPTIMISED, JOINT_STEPS)}, 9)")
    strategies = d.unnest(d.text_array(["baseline", "optimized"]))
    on = "strategy = 'optimized'"
    optimised = d.concat_arrays("base_reasons", reasons(d, JOINT_STEPS, "optimized_blend"))
    after = "no_url_benign_support suspicious_url_escalation".split()
    benign = "(not has_urls and (benign_without_url or (benign_hits >= 2 and email_lex <= 1)))"
    worse = "((has_urls and (escalation or (multi_conflict and strongest_bad))) or bad_url_conflict or ip_count > 0 or typosquat_count > 0)"
    calmer = "(has_urls and ((legit_alert and trusted_match and not brand_mismatch) or (reputable_count >= url_count and not brand_mismatch and sig = 0 and benign_hits + internal_hits >= 1 and u <= 0.6)))"
    flags = dict(zip(after, (f"case when {on} then {benign} else benign_without_url end", f"case when {on} then {worse} else escalation end")))
    return f"""with {tables}, y as (select *, {score} as base_score, {better} as better_score, {_baseline_reasons(d)} as base_reasons, {threshold} as threshold from m7),
    x as (select *, {strategies} as strategy from y), z as (select *, case when {on} then better_score else base_score end as score, case when {on} then {optimised} else base_reasons end as all_reasons from x)
    select record_id, strategy, round(score, 6) as final_score, {verdict('score', 'threshold')} as final_label, {risk_level('score')} as risk_level, round(e, 6) as email_score, round(top, 6) as url_score, threshold,
      we as email_weight, wu as url_weight, cast(analysed_count as bigint) as analyzed_url_count, cast(risky_count as bigint) as risky_url_count, cast(url_count as bigint) as extracted_url_count,
      base_mismatch as sender_url_mismatch_score, cast(stealth_hits as bigint) as email_hard_cue_count, analysed_count > 0 and good_count = analysed_count as all_urls_reputable, cue_count > 0 as any_url_hard_cue,
      case when {on} then trusted_match or {calmer} else trusted_match end as trusted_domain_match, brand_mismatch as brand_domain_mismatch, {', '.join(f'{v} as {k}' for k, v in flags.items())}, {d.joined('all_reasons', '|')} as reasons from z"""


@statement("joint_url_results")
def joint_url_results(d: Spark) -> str:
    """The URLs analysed of each message in their order, with score, verdict and whether a hard sign is on them."""
    return f"""with {_per_url(d)} select record_id, pos, url, round(url_score, 6) as score, {verdict('url_score')} as label, hard_cue, trusted, good as reputable from per_url where analysed"""


@statement("email_guards")
def email_guards(d: Spark, threshold: str = "0.5e0") -> str:
    """E-mail score after its guards, with reasons and the action to take; URLs of
    the body alone count here.  A message without text scores 0."""
    lists = {"statement": lx.STATEMENT_HINTS, "transaction": lx.TRANSACTION_HINTS, "urgency": lx.URGENCY_HINTS, "credential": lx.CREDENTIAL_HINTS, "stealth": lx.STEALTH_HINTS}
    cols = ", ".join(f"{hits('txt', v)} as {k}_hints" for k, v in lists.items())
    rise = Step("floor", 0.72, "stealth_hints >= 2 and (credential_hints >= 1 or urgency_hints > 0) and g < 0.9", "stealth_social_engineering_cue")
    urls = f"(select record_id, {d.unnest(body_urls(d, 'body'))} as url from {{emails}})"
    action = "case " + " ".join(f"when score >= {least} then '{text}'" for least, text in ACTIONS) + " end"
    given = listed(d, [("email_input", "empty"), *[(x.reason, f"not empty and {x.when}") for x in [*EMAIL_STEPS, rise]], ("email_threshold_check", "not empty")])
    bare = "trim(coalesce(subject, '')) = '' and trim(coalesce(body, '')) = ''"
    return f"""with {heuristics(d, urls)}, r as (select record_id, count(*) as n, count_if(trusted) as trusted_count, count_if(trusted or top_ranked) as good from heur group by record_id),
    t as (select record_id, {clamp(EMAIL_SCORE)} as s, lower({canonical(d)}) as txt, {bare} as empty from {{emails}}), b as (select record_id, s, empty, {cols} from t),
    a as (select b.*, coalesce(r.trusted_count, 0) as trusted_count, coalesce(r.n > 0 and r.good = r.n, false) as all_reputable from b left join r on b.record_id = r.record_id),
    c as (select *, {ladder('s', EMAIL_STEPS)} as g from a), y as (select *, {d.joined(given, '|')} as reasons, case when empty then 0e0 else {ladder('g', [rise])} end as score from c)
    select record_id, round(s, 6) as given, round(score, 6) as score, {verdict('score', threshold)} as verdict, {risk_level('score')} as risk_level, case when empty then 'Provide a subject or body before analysis.' else {action} end as action, reasons from y"""


@statement("sender_mismatch")
def sender_mismatch(d: Spark) -> str:
    """How far the sender's domain is from those of the URLs: 0 if there is nothing to
    compare or one agrees, more if URLs are unknown, most if the sender is known."""
    return f"""with {_messages(d)} select record_id, sender_reg, base_mismatch as mismatch, case when sender_reg = '' or named = 0 then 'insufficient_context' when sender_same > 0 then 'aligned' when base_mismatch = 0.8e0 then 'reputable_sender_to_untrusted_url'
      when base_mismatch = 0.6e0 then 'mismatch_with_untrusted_url' else 'domain_mismatch' end as reason from m"""


#: Stand-ins for the two URL models of a fusion.
FIRST_MODEL = "round((mod(length(url) * 37, 101)) / 101e0, 4)"
SECOND_MODEL = "round((mod(length(url) * 53, 97)) / 97e0, 4)"


def fused(d: Spark, source: str, first: str = FIRST_MODEL, second: str = SECOND_MODEL, models: tuple[str, ...] = ("both",), shown: str = "registrable") -> str:
    """``fused``: URLs with the fusion of two model scores, verdict and reasons in order.

    Weights go by trust, then come trust, lookalike and path rules.  The verdict has
    rules of its own and can differ from the score.  ``models``: both, v1 or
    v2 where only one of them answered; a row each.  ``shown``: what the registrable
    domain looks like, where international names are decoded.
    """
    least, _ = closest_trusted(d, "registrable")
    features = model_features(d, "norm", "host", "norm_path", "query", "norm_scheme", "norm")
    base = d.head(listed(d, [(name, when) for name, when, _ in REASONS]), FIRST_REASONS)
    weight = "case when trusted and docs_path then 0.85e0 when trusted then 0.75e0 when models = 'v1' then 1e0 when models = 'v2' then 0e0 else 0.6e0 end"
    steps = [
        Step("cap", 0.25, "trusted and not hard"),
        Step("floor", 0.95, "typo"),
        Step("floor", 0.88, "not trusted and is_ip and sensitive_path"),
        Step("floor", 0.78, "not trusted and redirect_target"),
        Step("floor", 0.72, "not trusted and lure_pattern"),
        Step("cap", 0.25, "trusted and not hard"),
    ]
    bad = "(typo or (not trusted and ((is_ip and sensitive_path) or redirect_target or lure_pattern)))"
    patterns = "(not trusted or hard)"
    front = listed(d, [
        ("trusted_soft_cues_override", "trusted and not hard"), ("untrusted_lure_pattern", "not trusted and lure_pattern"), ("embedded_redirect_target", "not trusted and redirect_target"),
        ("ip_sensitive_path", "not trusted and is_ip and sensitive_path"), ("fake_brand_domain", "typo"), ("url_char_patterns", f"{patterns} and s2 >= 0.9"), ("trusted_docs_override", "trusted and docs_path and not hard"),
        ("trusted_veto", "trusted and not hard"), ("trusted_exact_domain_exemption", "trusted and not docs_path and kind = 'exact_trusted_brand_domain'"), ("trusted_domain_guard", "trusted and not docs_path"),
        ("trusted_docs_guard", "trusted and docs_path"), ("url_model_fallback_v1_only", "models = 'v1'"), ("url_model_fallback_v2_only", "models = 'v2'"), ("rule_override", "models <> 'v2' and rule_override"),
    ])
    back = listed(d, [("url_char_patterns", f"{patterns} and s2 >= 0.75 and s2 < 0.9")])
    none = d.head("base_reasons", 0)
    return f"""{parts(d, source)}, fa as (select *, {features}, {lure_flags(d=d)}, {trust_kind(d, 'host', 'registrable')} as kind,
      (coalesce({least} = 1, false) or {shown_as_trusted('registrable', shown)}) and not is_ip as near, {first} as v1, {second} as v2, {d.unnest(d.text_array(list(models)))} as models from parts),
    fb as (select *, kind <> 'untrusted' as trusted, tld_suspicious = 1 and keyword_count >= 2 as rule_override, {base} as base_reasons, models <> 'v2' and (has_ip_host = 1 or tld_suspicious = 1 or num_at > 0 or has_http_in_path = 1) as hard,
      case when models = 'v2' then v2 else v1 end as s1, case when models = 'v1' then v1 else v2 end as s2 from fa),
    fc as (select *, near and not trusted as typo, {weight} as w1 from fb), fd as (select *, w1 * s1 + (1e0 - w1) * s2 as blend, models <> 'v1' and s2 >= 0.985 and (hard or not trusted) as forced from fc),
    fused as (select *, round({ladder('blend', steps)}, 9) as score, {d.concat_arrays(d.concat_arrays(front, f"case when models = 'v2' then {none} else base_reasons end"), back)} as reasons,
      case when trusted and not hard then 'legitimate' when {bad} or forced or (models <> 'v2' and (rule_override or s1 >= 0.5) and hard and not trusted) or blend >= 0.5 then 'phishing' else 'legitimate' end as verdict from fd)"""


@statement("url_fusion")
def url_fusion(d: Spark) -> str:
    """Fusion of both models, and of either alone, of every URL."""
    urls = "(select distinct url from {url_corpus} where url is not null)"
    return f"with {fused(d, urls, models=('both', 'v1', 'v2'))} select url, models, round(score, 6) as score, trusted, hard, typo as lookalike, verdict, {d.joined('reasons', '|')} as reasons from fused"


@statement("curated_verdicts")
def curated_verdicts(d: Spark) -> str:
    """Right verdicts of each category, and how often one of the first four reasons names a lookalike."""
    urls = "(select url, coalesce(source, 'none') as category, label from {url_corpus} where url is not null and label in (0, 1))"
    top = d.head("reasons", 4)
    return f"""with {fused(d, urls)} select category, count(*) as total, count_if((verdict = 'phishing') = (label = 1)) as correct, round(avg(case when {d.has(top, "'fake_brand_domain'")} then 1e0 else 0e0 end), 6) as flag_rate from fused group by category"""


#: Codes of the recommendation (fixed values).
RECOMMENDATIONS = "case when {level} = 'critical' or {pct} >= 85 then 'high_risk_candidate' when {level} = 'high' or {pct} >= 65 then 'investigate_immediately' when {level} = 'medium' or {pct} >= 40 then 'review_carefully' else 'likely_safe' end"


@statement("recommendations")
def recommendations(d: Spark) -> str:
    """Recommendation by risk level or by the score in percent, whichever is graver."""
    pct = "cast(round(100 * s) as int)"
    return f"""with r as (select record_id, {clamp(EMAIL_SCORE)} as s from {{emails}}), p as (select record_id, {pct} as pct, {risk_level('s')} as level from r)
    select record_id, pct, {RECOMMENDATIONS.format(level='level', pct='pct')} as recommendation from p"""


@statement("unified_results")
def unified_results(d: Spark) -> str:
    """Results of URLs and of messages in one shape: bands of URLs are their own, scores lie within 0 and 1."""
    urls = "(select distinct url from {url_corpus} where url is not null)"
    return f"""with {fused(d, urls)}, e as (select record_id, {clamp(EMAIL_SCORE)} as s from {{emails}})
    select 'url' as mode, url as id, verdict as label, round({clamp('score')}, 6) as score, {risk_level('score', url=True)} as risk_level, 'url_model' as strategy, 'balanced' as operating_mode, 0.5e0 as resolved_threshold from fused
    union all select 'email', cast(record_id as varchar(20)), {verdict('s')}, round(s, 6), {risk_level('s')}, 'email_model', 'balanced', 0.5e0 from e"""


@statement("verdict_counts")
def verdict_counts(d: Spark) -> str:
    """Messages with some phrase of urgency, by source and verdict filter."""
    return f"""with r as (select coalesce(source, 'none') as source, {clamp(EMAIL_SCORE)} as s, {any_of("lower(coalesce(body, ''))", lx.URGENCY)} as urgent from {{emails}})
    select source, case when s >= 0.5 then 'phishing' else 'legitimate' end as verdict, count(*) as n, count_if(urgent) as urgent from r group by 1, 2"""


def sql_functions(d: Spark) -> dict[str, tuple[str, str]]:
    """Functions of one argument that callers may register: name, (argument, expression)."""
    return {"entropy": ("x string", entropy(d, "x")), "risk_level": ("x double", risk_level("x")), "url_risk_level": ("x double", risk_level("x", url=True)), "sender_domain": ("x string", sender_domain(d, "x"))}
