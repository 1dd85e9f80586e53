"""Text and e-mail operators: canonical forms, counters, extraction, lexicons."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import lexicons as lx
from ..functions.dialect import Spark, hits
from ..functions.url import host_columns
from ..plans.catalogue import query, statement

#: Broad URL pattern and mailbox pattern of message bodies (fixed values).
BODY_URL = r"(?i)(https?://[^\s<>'\"`]+|www\.[^\s<>'\"`]+)"
MAILBOX_DOMAIN = r"(?i)[A-Z0-9._%+-]+@([A-Z0-9.-]+[.][A-Z][A-Z]+)"

#: Quoted items of a list as a program writes it.
QUOTED_ITEM = r"""'[^']*'|"[^"]*\""""
#: Categories of digits and capitals of any script.
DIGIT, CAPITAL = "Nd", "Lu"


def strip(d: Spark, x: str) -> str:
    return d.replace_all(x, r"^\s+|\s+$", "")


def is_literal_list(d: Spark, x: str) -> str:
    """Whether a text holds nothing but quoted items between brackets."""
    return d.matches(d.replace_all(x, QUOTED_ITEM, ""), r"^\[[\s,]*\]$")


def canonical(d: Spark, subject: str = "subject", body: str = "body", sep: str = " [SEP] ") -> str:
    """Subject and body in one text; null counts as empty."""
    return strip(d, f"concat({strip(d, f'coalesce({subject}, {chr(39)*2})')}, '{sep}', {strip(d, f'coalesce({body}, {chr(39)*2})')})")


def body_urls(d: Spark, text: str) -> str:
    """URLs in a text: trimmed of punctuation, www. completed, at least 8 long, first sight kept."""
    found = d.extract_all(f"coalesce({text}, '')", BODY_URL, 1 if d.name == "spark" else 0)
    right = d.each(found, "v", d.replace_all("v", r"""[.,;:!?)\]\x7d>"']+$""", ""))
    left = d.each(right, "v", d.replace_all("v", r"""^[(<\[\x7b"']+""", ""))
    whole = d.each(left, "v", "case when lower(substr(v, 1, 4)) = 'www.' then concat('https://', v) else v end")
    return d.distinct(d.keep(whole, "v", "length(v) >= 8"))


def sender_domain(d: Spark, sender: str) -> str:
    return f"lower({d.extract(f'coalesce({sender}, {chr(39)*2})', MAILBOX_DOMAIN, 1)})"


@statement("text_canonical")
def text_canonical(d: Spark) -> str:
    """Texts of the served model (with separator) and of the baseline (joined by a blank).

    Without subject and body the first is the bare separator, the second empty.
    """
    return f"select record_id, {canonical(d)} as model_text, {canonical(d, sep=' ')} as baseline_text from {{emails}}"


@statement("text_safe")
def text_safe(d: Spark) -> str:
    """Control zeros and runs of white space become one blank."""
    clean = d.replace_all("coalesce(body, '')", r"[\s\x00]+", " ")
    return f"select record_id, {strip(d, clean)} as safe_body from {{emails}}"


@statement("text_format_features")
def text_format_features(d: Spark) -> str:
    """Marks, digit and capital ratios, length; all 0 for empty text."""
    t = canonical(d, sep=" ")
    ratio = lambda p: f"case when length(t) = 0 then cast(0 as double) else round((length(t) - length({d.replace_all('t', p, '')})) / cast(length(t) as double), 12) end"
    return f"""with x as (select record_id, {t} as t from {{emails}})
    select record_id, cast(length(t) - length(replace(t, '!', '')) as int) as exclamation_count, {ratio(d.category(DIGIT))} as digit_ratio, {ratio(d.category(CAPITAL))} as capital_ratio, cast(length(t) as int) as body_length from x"""


@statement("text_url_features")
def text_url_features(d: Spark) -> str:
    """The URL columns of the feature table: number, addresses, mean length, ending in
    a listed domain (nearly never, since paths follow), shorteners (each hit counts)."""
    urls = d.extract_all("t", r"https?://[^\s]+")
    any_ip = d.size(d.keep("u", "v", d.matches("v", "[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+")))
    tlds = d.size(d.keep("u", "v", "(" + " or ".join(f"v like '%{x}'" for x in lx.CORPUS_TLDS) + ")"))
    short = d.total(d.each("u", "v", f"cast({hits('v', lx.CORPUS_SHORTENERS)} as double)"))
    mean = d.total(d.each("u", "v", "cast(length(v) as double)"))
    return f"""with x as (select record_id, {canonical(d, sep=' ')} as t from {{emails}}), y as (select record_id, {urls} as u from x)
    select record_id, cast({d.size('u')} as int) as url_count, cast({any_ip} > 0 as int) as has_ip_url,
      case when {d.size('u')} = 0 then cast(0 as double) else round({mean} / {d.size('u')}, 6) end as avg_url_length,
      cast({tlds} as int) as suspicious_tld_count, cast({short} as int) as shortener_count from y"""


@statement("text_urls")
def text_urls(d: Spark) -> str:
    """URLs in bodies, one row each."""
    return f"select record_id, {d.unnest(body_urls(d, 'body'))} as url from {{emails}}"


@statement("sender_domains")
def sender_domains(d: Spark) -> str:
    """Domain of the first mailbox in the sender and its registrable part."""
    return f"with s as (select record_id, {sender_domain(d, 'sender')} as domain from {{emails}}), h as (select *, {host_columns(d, 'domain')} from s) select record_id, domain, registrable from h"


@statement("sender_brand_hint")
def sender_brand_hint(d: Spark) -> str:
    """Domain of the first brand that the sender's name holds, in list order."""
    cases = " ".join(f"when contains(lower(sender_name), '{b}') then '{x}'" for b, x in lx.SENDER_BRANDS.items())
    return f"select case_id, case {cases} else '' end as brand_domain from {{joint_eval_cases}}"


@statement("lexicon_counts")
def lexicon_counts(d: Spark) -> str:
    """How many phrases of each list a message contains."""
    lists = {"urgency": lx.URGENCY, "credential": lx.CREDENTIAL, "finance": lx.FINANCE, "restriction": lx.RESTRICTION, "benign": lx.BENIGN, "internal": lx.INTERNAL, "high_intent": lx.HIGH_INTENT}
    cols = ", ".join(f"{hits('t', v)} as {k}_hits" for k, v in lists.items())
    return f"with x as (select record_id, lower(concat(coalesce(subject, ''), ' ', coalesce(body, ''))) as t from {{emails}}) select record_id, {cols} from x"


@statement("lexicon_hints")
def lexicon_hints(d: Spark) -> str:
    """Phrases of the e-mail model's lists in a message."""
    lists = {"statement": lx.STATEMENT_HINTS, "transaction": lx.TRANSACTION_HINTS, "urgency": lx.URGENCY_HINTS, "credential": lx.CREDENTIAL_HINTS, "stealth": lx.STEALTH_HINTS}
    cols = ", ".join(f"{hits('t', v)} as {k}_hints" for k, v in lists.items())
    return f"with x as (select record_id, lower({canonical(d)}) as t from {{emails}}) select record_id, {cols} from x"


@statement("lexicon_join")
def lexicon_join(d: Spark) -> str:
    """Messages by phrase of all lists: each message gives one row for each phrase it contains."""
    phrases = d.text_array(sorted({*lx.URGENCY, *lx.CREDENTIAL, *lx.FINANCE, *lx.RESTRICTION, *lx.BENIGN, *lx.INTERNAL, *lx.HIGH_INTENT}))
    found = d.keep("phrases", "v", "contains(txt, v)")
    return f"with t as (select lower(concat(coalesce(subject, ''), ' ', coalesce(body, ''))) as txt, {phrases} as phrases from {{emails}}), x as (select {d.unnest(found)} as phrase from t) select phrase, count(*) as messages from x group by phrase"


@statement("html_to_text")
def html_to_text(d: Spark) -> str:
    """Tags dropped, the five XML entities and the blank entity resolved, white space collapsed."""
    t = d.replace_all("coalesce(text, '')", "<[^>]+>", " ")
    for name, mark in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("amp", "&")):
        t = f"replace({t}, '&{name};', '{mark}')"
    collapsed = d.replace_all(t, r"\s+", " ")
    return f"select doc_id, {strip(d, collapsed)} as plain from {{documents}}"


@statement("url_lists")
def url_lists(d: Spark) -> str:
    """The list dialects of case files: split at bars only; at bars, line ends and
    commas, with the word nan as nothing; at blanks and commas, six long at least;
    a list as a program writes it, whose quoted items count."""
    text = "coalesce(urls, '')"
    trimmed = lambda a: d.keep(d.each(a, "v", strip(d, "v")), "v", "v <> ''")
    unified = d.replace_all(text, r"\s*[|]\s*|[\n,]", "|")
    spaced = d.replace_all(text, r"[\s,]+", "|")
    return f"""select case_id, cast({d.size(trimmed(d.split(text, '|')))} as int) as by_bar,
      case when lower({strip(d, text)}) = 'nan' then 0 else cast({d.size(trimmed(d.split(unified, '|')))} as int) end as by_marks,
      cast({d.size(d.distinct_set(d.keep(d.split(spaced, '|'), 'v', 'length(v) >= 6')))} as int) as by_blanks,
      case when {is_literal_list(d, strip(d, text))} then cast({d.size(d.extract_all(text, QUOTED_ITEM))} as int) else 0 end as by_literal from {{joint_threshold_calibration_set}}"""


@statement("merged_urls")
def merged_urls(d: Spark) -> str:
    """Given URLs, then those of the body, blanks dropped, first sight kept, the
    first 20; with what the body adds and whether both share one."""
    given = d.keep(d.each(d.split("coalesce(urls, '')", "|"), "v", strip(d, "v")), "v", "v <> ''")
    merged = d.head(d.distinct(d.concat_arrays("g", "b")), 20)
    return f"""with x as (select case_id, {given} as g, {body_urls(d, 'body')} as b from {{joint_threshold_calibration_set}})
    select case_id, {d.joined(merged, ' ')} as merged, cast({d.size(merged)} as int) as n, cast({d.size(d.keep('b', 'v', f"not {d.has('g', 'v')}"))} as int) as added, {d.size(d.keep('b', 'v', d.has('g', 'v')))} > 0 as overlap from x"""


def corpus_urls(d: Spark, text: str) -> str:
    """URLs in a text as the corpus builder takes them: no brackets within, http:// before www."""
    found = d.extract_all(f"coalesce({text}, '')", r"""(?i)\b(?:https?://|www[.])[^\s<>"'()\]]+""")
    clean = d.each(found, "v", d.replace_all("v", r"""[.,;:!?]+$""", ""))
    return d.distinct(d.each(clean, "v", "case when lower(substr(v, 1, 4)) = 'www.' then concat('http://', v) else v end"))


@statement("message_text_urls")
def message_text_urls(d: Spark) -> str:
    """URLs of a record by its stored field: of a list as a program writes it its items, of
    anything else the field and the body; where the field is blank, a number, or a
    list that gives none, those of the body."""
    value = strip(d, "coalesce(urls, '')")
    listed = is_literal_list(d, "value")
    number = d.matches("value", r"^[-+]?[0-9]+(?:[.][0-9]+)?$")
    bracketed = "value like '[%]'"
    return f"""with x as (select record_id, body, {value} as value from {{emails}}),
    y as (select record_id, value, value = '' or {number} as unusable, {bracketed} as bracketed, {listed} as listed, {corpus_urls(d, 'value')} as own, {corpus_urls(d, 'body')} as found, {corpus_urls(d, "concat(value, ' ', coalesce(body, ''))")} as every from x),
    z as (select record_id, case when unusable then found when bracketed then case when listed and {d.size('own')} > 0 then own else found end else every end as taken from y)
    select record_id, cast({d.size('taken')} as int) as n, {d.joined('taken', ' ')} as taken from z"""


def sender_domain_strict(df: DataFrame, col: str, out: str = "domain") -> DataFrame:
    """Domain by the address grammar: what follows the last @ of the parsed address,
    dots stripped, empty if it holds blanks.  Null senders give an empty text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from email.utils import parseaddr

        for pdf in frames:
            found = []
            for s in pdf[col]:
                address = parseaddr(s or "")[1]
                domain = address.rpartition("@")[2].strip().lower().strip(".") if "@" in address else ""
                found.append("" if " " in domain else domain)
            yield pdf.assign(**{out: found})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` string"
    return df.mapInPandas(run, schema)


@query("sender_domains_strict")
def sender_domains_strict(spark, d):
    return sender_domain_strict(spark.read.parquet(f"{d}/emails.parquet").select("record_id", "sender"), "sender").select("record_id", "domain")


def unescape_html(df: DataFrame, col: str, out: str = "plain") -> DataFrame:
    """All character entities of HTML, tags dropped, white space collapsed (Arrow)."""

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        import html
        import re

        return batch.map(lambda t: None if t is None else " ".join(html.unescape(re.sub(r"<[^>]+>", " ", t)).split()))

    return df.withColumn(out, run(F.col(col)))


@query("html_unescaped", """select doc_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[\\s\\p{Z}\\x{85}\\x0b\\x1c-\\x1f]+', ' ', 'g')) as plain from documents""")
def html_unescaped(spark, d):
    return unescape_html(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), "text").select("doc_id", "plain")


@statement("text_urls_corpus")
def text_urls_corpus(d: Spark) -> str:
    """URLs of bodies as the corpus builder takes them, one row each."""
    return f"select record_id, {d.unnest(corpus_urls(d, 'body'))} as url from {{emails}}"
