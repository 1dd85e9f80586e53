"""URL operators: normalisation, features, scores, trust, lookalikes, corpora."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicons as lx
from ..functions import url as u
from ..functions.dialect import SPARK, Spark, count_of, entropy, hits, one_of
from ..plans.catalogue import query, run_sql, statement

_URLS = "(select url, label, source, phish_id from {url_corpus})"


@statement("url_normalize")
def url_normalize(d: Spark) -> str:
    return f"with {u.parts(d, _URLS)} select url, norm, host, is_ip from parts"


@statement("url_host_parts")
def url_host_parts(d: Spark) -> str:
    return f"with {u.parts(d, _URLS)} select url, host, registrable, subdomain, cast(depth as int) as depth, scheme, path, query from parts"


@statement("url_features")
def url_features(d: Spark) -> str:
    """Features as a model is served with: of the normalised URL."""
    return f"with {u.parts(d, _URLS)} select url, {u.model_features(d, 'norm', 'host', 'norm_path', 'query', 'norm_scheme', 'norm')} from parts"


@statement("url_features_raw")
def url_features_raw(d: Spark) -> str:
    """Features as the training corpus has them: of the URL as written, keywords
    only in path and query, the scheme it really has."""
    cte = u.parts(d, _URLS, decode=False)
    return f"with {cte} select url, {u.model_features(d, 'raw', 'raw_host', 'p0', 'q0', 's0', 'concat(p0, ' + chr(39) + '?' + chr(39) + ', q0)')} from parts"


@statement("url_features_calibration")
def url_features_calibration(d: Spark) -> str:
    """Features as calibration has them: the host keeps the user part."""
    cte = u.parts(d, _URLS)
    host = d.extract("norm_netloc", "^([^:]*)", 1)
    return f"with {cte}, c as (select *, {host} as cal_host from parts) select url, {u.model_features(d, 'norm', 'cal_host', 'norm_path', 'query', 'norm_scheme', 'norm')} from c"


def _basic(d: Spark, source: str) -> str:
    """Signals and the additive score of the first heuristic model."""
    full = "lower(concat(host, norm_path, '?', query))"
    digits = f"(length(norm) - length({d.replace_all('norm', '[0-9]', '')}))"
    return f"""{u.parts(d, source)},
    signals as (select *, depth as subdomain_depth, length(norm) as url_length, contains(norm, '@') as has_at,
      {digits} / cast(greatest(length(norm), 1) as double) as digit_ratio, {entropy(d, 'norm')} as entropy,
      {one_of('host', lx.BASIC_SHORTENERS)} as is_shortener, {hits(full, lx.BASIC_KEYWORDS)} as keyword_count,
      (norm_scheme = 'https') as has_https from parts),
    scored as (select *, {u.clamp('''round(0.05 + case when is_ip then 0.35 else 0 end + case when has_at then 0.25 else 0 end
      + case when subdomain_depth >= 3 then 0.18 else 0 end + case when url_length >= 80 then 0.12 else 0 end
      + case when entropy >= 4.2 then 0.10 else 0 end + case when digit_ratio >= 0.18 then 0.08 else 0 end
      + case when is_shortener then 0.22 else 0 end + case when keyword_count >= 2 then 0.18 else 0 end
      - case when has_https then 0.03 else 0 end, 6)''')} as score from signals)"""


@statement("url_basic_scores")
def url_basic_scores(d: Spark) -> str:
    return f"with {_basic(d, _URLS)} select url, norm, cast(subdomain_depth as int) as subdomain_depth, round(entropy, 6) as entropy, keyword_count, score, case when score >= 0.5 then 'phishing' else 'legitimate' end as verdict, {u.risk_level('score')} as risk_level from scored"


@statement("url_basic_by_risk")
def url_basic_by_risk(d: Spark) -> str:
    return f"with {_basic(d, _URLS)} select source, {u.risk_level('score')} as risk_level, count(*) as n, min(score) as least, round(avg(score), 6) as mean from scored group by 1, 2"


#: Reasons of the feature model in their order: feature, condition and the value shown.
REASONS = [
    ("has_ip_host", "has_ip_host = 1", "has_ip_host"),
    ("tld_suspicious", "tld_suspicious = 1", "tld_suspicious"),
    ("keyword_count", "keyword_count >= 1", "keyword_count"),
    ("num_subdomains", "num_subdomains >= 3", "num_subdomains"),
    ("num_at", "num_at > 0", "num_at"),
    ("has_http_in_path", "has_http_in_path = 1", "has_http_in_path"),
    ("num_pct", "num_pct >= 3", "num_pct"),
    ("qparams", "qparams >= 4", "qparams"),
    ("entropy_url", "entropy_url >= 4.2", "entropy_url"),
    ("url_len", "url_len >= 90", "url_len"),
    ("num_digits", "num_digits >= 12", "num_digits"),
]
FIRST_REASONS = 8


def listed(d: Spark, cases: list[tuple[str, str]]) -> str:
    """Array of the names whose condition holds, in order."""
    return d.keep(d.array(*[f"case when {when} then '{name}' end" for name, when in cases]), "v", "v is not null")


@statement("url_reasons")
def url_reasons(d: Spark) -> str:
    """Reasons of the feature model in long form, at most eight of a URL, in their order."""
    f = u.model_features(d, "norm", "host", "norm_path", "query", "norm_scheme", "norm")
    shown = lambda c: d.fixed(c, 3) if c == "entropy_url" else f"cast({c} as varchar(20))"
    items = [f"case when {when} then concat('{k:02d}|{name}|', {shown(value)}) end" for k, (name, when, value) in enumerate(REASONS)]
    given = d.head(d.keep(d.array(*items), "v", "v is not null"), FIRST_REASONS)
    urls = "(select distinct url from {url_corpus} where url is not null)"
    return f"""with {u.parts(d, urls)}, f as (select url, {f} from parts), r as (select url, {d.unnest(given)} as item from f)
    select url, cast(row_number() over (partition by url order by item) as int) as pos, {d.extract('item', '^[0-9]+[|]([a-z_]+)[|]', 1)} as feature, {d.extract('item', '^[0-9]+[|][a-z_]+[|](.*)$', 1)} as value from r"""


def heuristics(d: Spark, source: str, ranks: str = "") -> str:
    """The lenient parse and the twenty fields of the joint model, in ``heur``."""
    pathq = "lower(concat(path, ' ', query))"
    tokens = d.keep(d.split(d.replace_all("raw_host", "[-_.]+", "."), "."), "v", "v <> ''")
    brand_hits = "(" + " + ".join(f"cast({d.has('tokens', chr(39) + b + chr(39))} as int)" for b in lx.SENDER_BRANDS) + ")"
    least, _ = u.closest_trusted(d, "registrable")
    nested = " or ".join(f"raw_host like '%.{s}'" for s in lx.TRUSTED_SUBDOMAINS)
    rank = f"left join (select lower(case when domain_name like 'www.%' then substr(domain_name, 5) else domain_name end) as ranked, min(rank_pos) as rank_pos from {{domain_ranks}} group by 1) k on h1.registrable = k.ranked" if not ranks else ranks
    parts = u.parts(d, source, decode=False).replace(u.host_columns(d, "host"), u.host_columns(d, "raw_host"))
    return f"""{parts},
    h0 as (select *, {pathq} as pathq, {tokens} as tokens, {d.extract('registrable', '[.]([^.]*)$', 1)} as tld from parts),
    h1 as (select *, {d.size('tokens')} as host_token_count, {brand_hits} as brand_token_hits,
      {one_of('registrable', lx.JOINT_SHORTENERS)} as has_shortener, {one_of('tld', lx.JOINT_TLDS)} as suspicious_tld,
      {hits("concat(raw_host, ' ', pathq)", lx.JOINT_KEYWORDS)} as keyword_hits, {hits('pathq', lx.PATH_RISKS)} as path_risk_score,
      (scheme <> 'https') as non_https, ({count_of('raw_host', '-')} >= 2 or {d.matches('raw_host', '[0-9][0-9][0-9]')}) as suspicious_host_shape,
      contains(raw_host, 'xn--') as punycode_like, ({u.trust_kind(d, 'raw_host', 'registrable')} <> 'untrusted') as trusted,
      ({one_of('raw_host', lx.TRUSTED_SUBDOMAINS)} or {nested}) as trusted_subdomain,
      {one_of('registrable', lx.BENIGN_REGISTRABLES)} as trusted_exact, {least} as distance from h0),
    h2 as (select h1.*, coalesce(k.rank_pos <= 20000, false) and not is_ip as top_ranked from h1 {rank}),
    heur as (select *, ((coalesce(distance = 1, false) or {u.shown_as_trusted('registrable')}) and not trusted and not is_ip) as typosquat_hit,
      ((host_token_count >= 4 and {count_of('raw_host', '-')} >= 1) or (brand_token_hits >= 1 and {count_of('raw_host', '-')} >= 1 and not (trusted or trusted_subdomain))
        or (brand_token_hits >= 2 and not trusted)) as suspicious_compound_hostname,
      (trusted or trusted_subdomain or top_ranked or trusted_exact) as reputable from h2)"""


@statement("url_heuristics")
def url_heuristics(d: Spark) -> str:
    return f"""with {heuristics(d, _URLS)} select url, raw_host, registrable, cast(host_token_count as int) as host_token_count, brand_token_hits, is_ip, has_shortener,
      suspicious_tld, cast(depth as int) as subdomain_depth, keyword_hits, path_risk_score, typosquat_hit, non_https, suspicious_host_shape, suspicious_compound_hostname,
      punycode_like, trusted, trusted_subdomain, trusted_exact, top_ranked, reputable from heur"""


@statement("url_path_flags")
def url_path_flags(d: Spark) -> str:
    """Documentation paths, sensitive paths, redirect targets and lures."""
    return f"with {u.parts(d, _URLS)} select url, {u.lure_flags(d=d)} from parts"


@statement("url_trust")
def url_trust(d: Spark) -> str:
    """Trust kind of each sending host and of each URL host."""
    hosts = "(select distinct url from {url_corpus} union select distinct lower(trim(sender_domain)) as url from {emails} where sender_domain is not null)"
    return f"with {u.parts(d, hosts)} select url, host, {u.trust_kind(d, 'host', 'registrable')} as trust_kind from parts"


@statement("url_typosquat")
def url_typosquat(d: Spark) -> str:
    """Sending domains one edit away from one of the most popular domains.

    A theta join on edit distance is blocked by length: only names that differ
    in length by one at most are compared.  Ties go to the alphabetically first.
    """
    name = "lower(case when domain_name like 'www.%' then substr(domain_name, 5) else domain_name end)"
    return f"""with popular as (select distinct {name} as trusted from {{domain_ranks}} where rank_pos <= 1000),
    senders as (select distinct lower(trim(sender_domain)) as domain from {{emails}} where sender_domain is not null),
    blocked as (select trusted, {d.unnest(d.array("length(trusted) - 1", "length(trusted)", "length(trusted) + 1"))} as l from popular),
    near as (select domain, trusted, levenshtein(domain, trusted) as distance from senders join blocked on length(domain) = l where levenshtein(domain, trusted) <= 1),
    hit as (select domain, min(distance) as distance from near group by domain)
    select n.domain, min(n.trusted) as closest, cast(h.distance as int) as distance from near n join hit h on n.domain = h.domain and n.distance = h.distance where h.distance = 1 group by n.domain, h.distance"""


@statement("url_rank_lookup")
def url_rank_lookup(d: Spark) -> str:
    """Rank of the registrable domain; the first of repeated ranks holds."""
    name = "lower(case when domain_name like 'www.%' then substr(domain_name, 5) else domain_name end)"
    return f"""with {u.parts(d, _URLS)}, ranks as (select {name} as domain, min(rank_pos) as rank_pos from {{domain_ranks}} where domain_name is not null group by 1)
    select url, registrable, case when is_ip then null else rank_pos end as rank_pos, coalesce(rank_pos <= 1000, false) and not is_ip as top_ranked from parts left join ranks on registrable = domain"""


@statement("url_benign")
def url_benign(d: Spark) -> str:
    """Two URLs of each ranked domain, as examples of the harmless class."""
    return f"""with n as (select distinct {d.replace_all("lower(trim(domain_name))", '^www[.]', '')} as domain from {{domain_ranks}} where domain_name is not null)
    select {d.unnest(d.array("concat('https://', domain, '/')", "concat('https://www.', domain, '/')"))} as url, 0 as label, 'tranco' as source from n where contains(domain, '.') and not contains(domain, ' ') and length(domain) <= 253"""


@statement("url_corpus_clean")
def url_corpus_clean(d: Spark) -> str:
    """URLs as the training corpus takes them: control characters and blanks
    removed, http by default, host in lower case, no fragment; no dot in the host, no row.

    Of character entities those of XML and the numeric ones of ASCII are resolved.
    """
    start = d.replace_all(d.replace_all("coalesce(url, '')", r"[\x00-\x1f\x7f]", ""), r"\s+", "")
    for name, mark in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("amp", "&")):
        start = f"replace({start}, '&{name};', '{mark}')"
    decimal = d.fold(d.extract_all("s0", "&#([0-9][0-9]?[0-9]?);", 1), "s0", "a", "v", "case when cast(v as int) between 33 and 126 then replace(a, concat('&#', v, ';'), chr(cast(v as int))) else a end")
    hexa = d.fold(d.extract_all("s1", "&#[xX]([0-9a-fA-F][0-9a-fA-F]);", 1), "s1", "a", "v", f"case when {d.from_hex('v')} between 33 and 126 then replace(replace(a, concat('&#x', v, ';'), chr({d.from_hex('v')})), concat('&#X', v, ';'), chr({d.from_hex('v')})) else a end")
    host = d.extract("netloc", "^(?:.*@)?([^:]*)", 1)
    whole = "^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)([?][^#]*)?(#.*)?$"
    return f"""with a0 as (select url, label, source, phish_id, {start} as s0 from {{url_corpus}}), a1 as (select *, {decimal} as s1 from a0), a as (select *, {hexa} as s from a1),
    b as (select *, case when {d.matches('s', '^[a-zA-Z][a-zA-Z0-9+.-]*://')} then s else concat('http://', s) end as r from a where s <> ''),
    c as (select *, lower({d.extract('r', whole, 1)}) as scheme, lower({d.extract('r', whole, 2)}) as netloc, {d.extract('r', whole, 3)} as path, {d.extract('r', whole, 4)} as query from b)
    select url, concat(scheme, '://', netloc, path, query) as clean, label, source, phish_id from c where contains({host}, '.')"""


@statement("url_dedupe")
def url_dedupe(d: Spark) -> str:
    """One row for each URL; a harmful label and then the smallest report wins."""
    return """with r as (select url, label, source, phish_id, row_number() over (partition by url order by label desc nulls last, phish_id asc nulls last, source) as n from {url_corpus} where url is not null)
    select url, label, source, phish_id from r where n = 1"""


@statement("url_sample")
def url_sample(d: Spark) -> str:
    """A deterministic sample: the rows with the smallest hashes (a bounded top-k, no full sort)."""
    h = d.sha256("concat(url, '#42')")
    return f"select url, label from (select distinct url, label from {{url_corpus}} where url is not null) t order by {h}, label limit 200"


def lookalikes(d: Spark, hosts: str) -> str:
    least, name = u.closest_trusted(d, "registrable")
    alike = u.shown_as_trusted("registrable")
    shown = f"translate(registrable, '{''.join(lx.CONFUSABLES)}', '{''.join(lx.CONFUSABLES.values())}')"
    return f"""with {u.parts(d, hosts, decode=False)}, h as (select distinct raw_host, registrable, is_ip, {u.trust_kind(d, 'raw_host', 'registrable')} as kind from parts), c as (select *, {least} as edits, {name} as near, {alike} as alike, {shown} as shown from h)
    select raw_host as host, registrable, case when alike then shown else near end as closest_trusted, case when alike then null else cast(edits as int) end as distance, case when alike then 'confusable_skeleton' else 'levenshtein' end as match_type
      from c where kind = 'untrusted' and not is_ip and (alike or edits <= 1)"""


@statement("url_lookalikes")
def url_lookalikes(d: Spark) -> str:
    """Hosts that come within one edit of a trusted domain, or look like one: the closest and how they match."""
    hosts = "(select distinct url from (select url from {url_corpus} union all select domain_name as url from {domain_ranks} union all select sender_domain as url from {emails}) t where url is not null)"
    return lookalikes(d, hosts)


_MAP = str.maketrans(lx.CONFUSABLES)


def skeleton(host: Column) -> Column:
    """What a host looks like: IDN labels decoded, compatibility forms and case
    folded, lookalike letters replaced.  Null stays null; a label that is no
    valid IDN stays as it is.  Spark has no Unicode normalisation, hence Arrow;
    plain hosts take the built-in branch alone.
    """

    @F.pandas_udf("string")
    def decode(batch: pd.Series) -> pd.Series:
        import unicodedata

        def one(h: str | None) -> str | None:
            if h is None:
                return None
            labels = []
            for label in filter(None, h.lower().split(".")):
                if label.startswith("xn--"):
                    try:
                        label = label.encode("ascii").decode("idna")
                    except UnicodeError:
                        pass
                labels.append(label)
            return unicodedata.normalize("NFKC", ".".join(labels)).casefold().translate(_MAP)

        return batch.map(one)

    return decode(host)


def with_skeleton(df: DataFrame, host_col: str, out: str = "skeleton") -> DataFrame:
    """Adds the skeleton; only hosts with IDN labels or other scripts go to Python."""
    special = F.col(host_col).contains("xn--") | F.col(host_col).rlike(r"[^\x00-\x7F]")
    plain = df.where(~F.coalesce(special, F.lit(False))).withColumn(out, F.lower(host_col))
    return plain.unionByName(df.where(special).withColumn(out, skeleton(F.col(host_col))))


@query("url_confusable")
def url_confusable(spark, d):
    """Hosts whose skeleton is a trusted domain that they are not."""
    parsed = run_sql(spark, d, f"with {u.parts(SPARK, _URLS, decode=False)} select raw_host from parts")
    return confusable_hosts(parsed.select(F.col("raw_host").alias("host")).where("host <> ''").distinct())


def confusable_hosts(hosts: DataFrame) -> DataFrame:
    """(host, skeleton, trusted) of the hosts that look like a trusted domain and are none."""
    spark = hosts.sparkSession
    shown = with_skeleton(hosts, "host").withColumn("registrable", F.substring_index("skeleton", ".", -2))
    trusted = F.broadcast(spark.createDataFrame([(x,) for x in sorted({".".join(s.split(".")[-2:]) for s in lx.TRUSTED_SUFFIXES})], "trusted string"))
    return shown.join(trusted, F.col("registrable") == F.col("trusted")).where(F.substring_index("host", ".", -2) != F.col("trusted")).select("host", "skeleton", "trusted")




@statement("url_decisions")
def url_decisions(d: Spark) -> str:
    """Verdict of the feature model: from a score of 0.5 on, or by rule where a listed
    ending meets two keywords; the rule leaves the score as it is."""
    f = u.model_features(d, "norm", "host", "norm_path", "query", "norm_scheme", "norm")
    return f"""with {u.parts(d, _URLS)}, f as (select url, {f} from parts), s as (select url, tld_suspicious, keyword_count, round(mod(url_len * 37, 101) / 101e0, 4) as score from f)
    select url, score, (tld_suspicious = 1 and keyword_count >= 2) as by_rule, case when score >= 0.5 or (tld_suspicious = 1 and keyword_count >= 2) then 'phishing' else 'legitimate' end as verdict from s"""


@statement("url_browser_norm")
def url_browser_norm(d: Spark) -> str:
    """The form that a browser keeps: the scheme stays, host in lower case, default ports and fragments go."""
    return f"""with {u.parts(d, _URLS, decode=False)} select url, case when netloc = '' then '' else concat(scheme, '://', {d.replace_all(d.replace_all('netloc', ':80$', ''), ':443$', '')}, norm_path, case when query <> '' then concat('?', query) else '' end) end as kept from parts"""


def sorted_scores(d: Spark, by: str = "score", descending: bool = True) -> str:
    """URLs with their scores, by ``score`` or ``url``, in either direction."""
    if by not in ("score", "url"):
        raise ValueError(f"no such order: {by}")
    order = f"{by} {'desc' if descending else 'asc'}{', url' if by == 'score' else ''}"
    return f"with {_basic(d, '(select distinct url from {url_corpus} where url is not null)')} select url, score from scored order by {order}"


@statement("urls_by_score")
def urls_by_score(d: Spark) -> str:
    """URLs from the highest score down; equal scores by name (``sorted_scores`` has other orders)."""
    return sorted_scores(d)
