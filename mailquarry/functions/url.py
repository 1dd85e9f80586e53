"""URL expressions: each step names columns that the next one uses.

``parts(d, source, url)`` gives a chain of common table expressions; its last,
``parts``, holds the rows of ``source`` with the columns raw, scheme, netloc,
path, query, norm (the normalised URL), host, is_ip, labels, registrable,
subdomain and depth.
"""

from __future__ import annotations

from .. import lexicons as lx
from .dialect import Spark, any_of, count_of, entropy, hits, one_of

_SCHEME = "^[a-zA-Z][a-zA-Z0-9+.-]*://"
_WHOLE = "^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)([?]([^#]*))?(#.*)?$"
_OCTET = "[0-9][0-9]?[0-9]?"
_DOTTED = f"^{_OCTET}[.]{_OCTET}[.]{_OCTET}[.]{_OCTET}$"
_IPV4 = "^([0-9]+)[.]([0-9]+)[.]([0-9]+)[.]([0-9]+)$"


def host_columns(d: Spark, host: str) -> str:
    """is_ip, labels, registrable, subdomain, depth of a host expression."""
    octets = " and ".join(f"try_cast({d.extract(host, _IPV4, k)} as int) between 0 and 255" for k in range(1, 5))
    labels = d.keep(d.split(host, "."), "v", "v <> ''")
    return f"""(case when {d.matches(host, _DOTTED)} then {octets} else false end) as is_ip,
      {labels} as labels,
      {d.joined(d.last(labels, 2), '.')} as registrable,
      {d.joined(d.but_last(labels, 2), '.')} as subdomain,
      greatest({d.size(labels)} - 2, 0) as depth"""


def parts(d: Spark, source: str, url: str = "url", decode: bool = True) -> str:
    """Common table expressions that take URLs apart and normalise them.

    Null and blank URLs normalise to ``https:///``; nothing fails.  ``decode``
    False keeps the URL as it is written (the lenient parse).
    """
    text = f"coalesce({url}, '')"
    trimmed = d.replace_all(text, r"^\s+|\s+$", "")
    start = d.replace_all(d.url_decode(trimmed) if decode else trimmed, "[\t\r\n]", "")
    host = d.replace_all(d.replace_all(d.extract("netloc", r"^(.*@)?(\[[^\]]*\]|[^:]*)", 2), r"[\[\]]", ""), r"^\s+|\s+$", "")
    return f"""u0 as (select *, {start} as start_ from {source}),
    u1 as (select *, case when {d.matches('start_', _SCHEME)} then start_ else concat('https://', start_) end as raw from u0),
    u2 as (select *, lower({d.extract('raw', _WHOLE, 1)}) as s0, lower({d.extract('raw', _WHOLE, 2)}) as n0,
      {d.extract('raw', _WHOLE, 3)} as p0, {d.extract('raw', _WHOLE, 5)} as q0 from u1),
    u3 as (select *, case when n0 = '' and p0 <> '' then 'https' else s0 end as scheme,
      n0 as netloc, {d.replace_all('p0', '^(.*/[^/;]*|[^/;]*);[^/]*$', '$1')} as path,
      case when n0 = '' and p0 <> '' then '' else q0 end as query from u2),
    u4 as (select *, {d.replace_all(d.replace_all(d.replace_all('netloc', ':80$', ''), ':443$', ''), r'^www[.]', '')} as norm_netloc,
      case when path = '' then '/' else path end as norm_path, case when scheme = 'http' then 'https' else scheme end as norm_scheme,
      lower({host}) as raw_host from u3),
    u5 as (select *, concat(norm_scheme, '://', norm_netloc, norm_path,
      case when query <> '' then concat('?', query) else '' end) as norm,
      lower({host.replace('netloc', 'norm_netloc')}) as host from u4),
    parts as (select *, {host_columns(d, 'host')} from u5)"""


def model_features(d: Spark, url: str, host: str, path: str, query: str, scheme: str, keyword_text: str) -> str:
    """The 29 features in their frozen order."""
    n = f"cast(greatest(length({url}), 1) as double)"
    pq = f"concat({path}, {query})"
    e = lambda x: f"round({entropy(d, x)}, 6)"
    flag = lambda c: f"cast({c} as int)"
    tld = d.extract(host, "[.]([^.]*)$", 1)
    columns = {
        "url_len": f"length({url})",
        "host_len": f"length({host})",
        "path_len": f"length({path})",
        "query_len": f"length({query})",
        "host_ratio": f"round(length({host}) / {n}, 6)",
        "path_ratio": f"round(length({path}) / {n}, 6)",
        "query_ratio": f"round(length({query}) / {n}, 6)",
        "num_dots": count_of(host, "."),
        "num_subdomains": f"greatest({count_of(host, '.')} - 1, 0)",
        "num_hyphens": count_of(url, "-"),
        "num_underscores": count_of(url, "_"),
        "num_digits": f"(length({url}) - length({d.replace_all(url, '[0-9]', '')}))",
        "num_at": count_of(url, "@"),
        "num_pct": count_of(url, "%"),
        "num_eq": count_of(url, "="),
        "num_amp": count_of(url, "&"),
        "num_qmark": count_of(url, "?"),
        "num_slash": count_of(url, "/"),
        "num_colon": count_of(url, ":"),
        "qparams": f"(case when {query} = '' then 0 else {count_of(query, '&')} + 1 end)",
        "has_https": flag(f"{scheme} = 'https'"),
        "has_http_in_path": flag(f"contains(lower({pq}), 'http')"),
        "has_double_slash_in_path": flag(f"contains({pq}, '//')"),
        "has_ip_host": flag("is_ip"),
        "tld_suspicious": flag(one_of(tld, lx.MODEL_TLDS)),
        "entropy_host": e(host),
        "entropy_path": e(path),
        "entropy_url": e(url),
        "keyword_count": hits(f"lower({keyword_text})", lx.MODEL_KEYWORDS),
    }
    assert tuple(columns) == lx.MODEL_FEATURES
    return ",\n      ".join(f"cast({v} as {'double' if 'ratio' in k or 'entropy' in k else 'int'}) as {k}" for k, v in columns.items())


def trust_kind(d: Spark, host: str, registrable: str, suffixes=lx.TRUSTED_SUFFIXES) -> str:
    """exact_trusted_brand_domain, trusted_subdomain_ecosystem or untrusted."""
    return f"(case when {one_of(registrable, {'.'.join(s.split('.')[-2:]) for s in suffixes})} then case when {host} = {registrable} then 'exact_trusted_brand_domain' else 'trusted_subdomain_ecosystem' end else 'untrusted' end)"


def closest_trusted(d: Spark, registrable: str, suffixes=lx.TRUSTED_SUFFIXES) -> tuple[str, str]:
    """Smallest edit distance to a trusted domain and the alphabetically first at it.

    Names whose length differs by more than one are not compared; null if none is left.
    """
    names = sorted({".".join(s.split(".")[-2:]) for s in suffixes})
    distances = [f"case when length({registrable}) between {len(n) - 1} and {len(n) + 1} then levenshtein({registrable}, '{n}') end" for n in names]
    least = f"least({', '.join(distances)})"
    name = "(case " + " ".join(f"when {x} = {least} then '{n}'" for n, x in zip(names, distances)) + " end)"
    return least, name


def shown_as_trusted(registrable: str, shown: str | None = None, suffixes=lx.TRUSTED_SUFFIXES) -> str:
    """Whether lookalike letters, replaced, make a trusted domain of one that is none.

    ``shown``: the domain with international names decoded, where it differs.
    """
    names = {".".join(s.split(".")[-2:]) for s in suffixes}
    return f"({one_of(f'translate({shown or registrable}, {chr(39)}{''.join(lx.CONFUSABLES)}{chr(39)}, {chr(39)}{''.join(lx.CONFUSABLES.values())}{chr(39)})', names)} and not {one_of(registrable, names)})"


#: Features of a URL that count as hard signs of the feature model.
def hard_signs(d: Spark) -> dict[str, str]:
    tld = d.extract("host", "[.]([^.]*)$", 1)
    return {"has_ip_host": "is_ip", "tld_suspicious": one_of(tld, lx.MODEL_TLDS), "num_at": "contains(norm, '@')", "has_http_in_path": "contains(lower(concat(norm_path, query)), 'http')"}


def risk_level(score: str, url: bool = False) -> str:
    """Bands of a score; ``url`` has those that callers see for single URLs."""
    if url:
        return f"(case when {score} >= 0.8 then 'critical' when {score} >= 0.6 then 'high' when {score} >= 0.4 then 'medium' else 'low' end)"
    return f"(case when {score} >= 0.9 then 'critical' when {score} >= 0.7 then 'high' when {score} >= 0.4 then 'medium' else 'low' end)"


def clamp(x: str) -> str:
    """Into [0, 1]; null stays null."""
    return f"(case when {x} is null then null else greatest(cast(0 as double), least(cast(1 as double), cast({x} as double))) end)"


def lure_flags(path: str = "norm_path", query: str = "query", host: str = "host", d: Spark | None = None) -> str:
    """docs_path, sensitive_path, redirect_target, lure_keywords, lure_pattern."""
    p = f"lower({path})"
    keywords = hits(f"lower(concat({host}, ' ', {path}, ' ', {query}))", lx.LURE_KEYWORDS)
    redirect = "(^|[?&])(redirect|redir|url|next|return|returnurl|continue|dest|destination|to)=(https?%3a%2f%2f|https?://)"
    return f"""({any_of(p, lx.DOCS_PATHS)} or {d.matches(p, '[.](html?|pdf|md|txt)$')}) as docs_path,
      {any_of(p, lx.SENSITIVE_PATHS)} as sensitive_path,
      {d.matches(f"concat('?', lower({query}))", redirect)} as redirect_target,
      {keywords} as lure_keywords,
      ({keywords} >= 3 or ({keywords} >= 2 and {count_of(host, '-')} >= 2)) as lure_pattern"""
