"""Sources: CSV, JSON, rank lists, mail messages, archives of messages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.relational import global_row_number
from ..runtime import broadcast_if_small, durable

#: Bytes of members that a batch of an archive holds before it is passed on.
MEMBER_BYTES = 4_000_000
RECORD = "subject string, body string, sender string, sender_domain string, urls string, label int, source string"


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, required: tuple[str, ...] = ()) -> DataFrame:
    """CSV with a header, quoted line ends and doubled quotes; bad bytes don't fail.

    Raises ValueError if a required column is not in the schema.
    """
    df = spark.read.schema(schema).options(header=True, multiLine=True, escape='"', maxCharsPerColumn=-1, mode="PERMISSIVE").csv(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


#: Names that a column of a case file may have, first the one kept (fixed values).
ALIASES = {"case_id": ("case_id", "id"), "urls": ("urls", "url_list", "links"), "url": ("url", "link"), "body": ("body", "email_body", "message"), "sender": ("sender", "sender_name", "from"), "expected_joint_label": ("expected_joint_label", "expected_label"), "subject": ("subject",)}


def read_case_file(spark: SparkSession, path: str) -> DataFrame:
    """Case files: headers in any case, columns by any of their names, an empty cell
    falls through to the next name; rows without an id get ``row-<n>``."""
    df = spark.read.options(header=True, multiLine=True, escape='"').csv(path)
    for c in df.columns:
        df = df.withColumnRenamed(c, c.strip().lower().replace(" ", "_"))
    cell = lambda c: F.expr(f"nullif(trim(`{c}`), '')")
    out = {name: F.coalesce(*[cell(c) for c in names if c in df.columns], F.lit("")) for name, names in ALIASES.items()}
    rows = df.withColumn("_at", F.monotonically_increasing_id()).select("_at", *[c.alias(k) for k, c in out.items()])
    numbered = global_row_number(rows, ["_at"], "_n")
    return numbered.withColumn("case_id", F.when(F.col("case_id") == "", F.concat(F.lit("row-"), (F.col("_n") - 1).cast("string"))).otherwise(F.col("case_id"))).drop("_at", "_n")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of reports (url, phish_id), one a file; entries without a text URL or a whole id drop out.

    Raises ValueError if a file holds no array.
    """
    whole = spark.read.text(path, wholetext=True)
    if not whole.where(~F.regexp_replace(F.substring("value", 1, 1000), r"^[\s\uFEFF]+", "").startswith("[")).isEmpty():
        raise ValueError(f"no JSON array: {path}")
    df = spark.read.schema("url string, phish_id string").json(path, multiLine=True)
    return df.select("url", F.expr("try_cast(phish_id as int)").alias("phish_id")).where("url is not null and phish_id is not null")


def clean_domain(c: Column) -> Column:
    x = F.lower(F.trim(c))
    x = F.regexp_replace(x, r"^[a-z]+://", "")
    return F.regexp_replace(F.regexp_replace(x, r"/.*$", ""), r"^www\.", "")


def read_rank_list(spark: SparkSession, path: str, top_n: int | None = None) -> DataFrame:
    """(domain, rank) of a rank list without header; the domain column is the one of
    which most of ten sampled cells hold a dot, later columns first; the first of repeated domains holds.  ``top_n``: only domains of that rank at most."""
    df = spark.read.csv(path)
    sample = df.limit(10).agg(*[F.avg(F.coalesce(F.col(c).contains("."), F.lit(False)).cast("int")).alias(c) for c in df.columns]).first()
    names = df.columns
    at = max(range(len(names)), key=lambda k: (sample[names[k]] or 0, k)) if names else 0
    other = next((c for k, c in enumerate(names) if k != at), None)
    rank = F.expr(f"try_cast(`{other}` as int)") if other else F.monotonically_increasing_id()
    rows = df.select(clean_domain(F.col(names[at])).alias("domain"), rank.cast("bigint").alias("rank"))
    good = rows.where(F.col("domain").contains(".") & ~F.col("domain").contains(" ") & (F.length("domain") <= 253) & F.col("rank").isNotNull())
    if top_n is not None:
        good = good.where(F.col("rank") <= top_n)
    return good.groupBy("domain").agg(F.min("rank").alias("rank"))


def decode_payload(data: bytes | None, charset: str | None) -> str:
    """Bytes of a part by its charset, else UTF-8, else Latin-1."""
    if not data:
        return ""
    for name in (charset, "utf-8"):
        if name:
            try:
                return data.decode(name)
            except (LookupError, UnicodeDecodeError):
                continue
    return data.decode("latin-1")


def parse_message(raw: str | bytes | None) -> tuple[str, str, str]:
    """(subject, body, sender) of an RFC-822 message: plain text before HTML,
    attachments left out; what can't be parsed gives empty texts."""
    import email
    import html
    import re
    from email.header import decode_header, make_header

    if not raw:
        return "", "", ""
    # a text goes through its bytes, or letters outside Latin-1 would come out as escapes
    message = email.message_from_bytes(raw if isinstance(raw, bytes) else raw.encode("utf-8", "surrogatepass"))

    def header(name: str) -> str:
        found = next((str(v) for k, v in message.raw_items() if k.lower() == name.lower()), "")
        text = decode_payload(found.encode("utf-8", "surrogateescape"), None)
        try:
            return str(make_header(decode_header(text)))
        except Exception:
            return text

    plain, rich = [], []
    for part in message.walk():
        if part.is_multipart() or part.get_filename() or "attachment" in str(part.get("Content-Disposition", "")).lower():
            continue
        kind = part.get_content_type()
        if kind in ("text/plain", "text/html"):
            text = decode_payload(part.get_payload(decode=True), part.get_content_charset())
            (plain if kind == "text/plain" else rich).append(text)
    body = "\n".join(plain) if any(p.strip() for p in plain) else html.unescape(re.sub(r"<[^>]+>", " ", "\n".join(rich)))
    clean = lambda t: " ".join(t.replace("\x00", " ").split())
    return clean(header("Subject")), clean(body), clean(header("From"))


def parse_messages(df: DataFrame, col: str = "message") -> DataFrame:
    """Adds subject, body and sender of raw messages (Arrow batches)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            parsed = [parse_message(m) for m in pdf[col]]
            yield pdf.assign(subject=[p[0] for p in parsed], body=[p[1] for p in parsed], sender=[p[2] for p in parsed])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", subject string, body string, sender string"
    return df.mapInPandas(run, schema)


def archive_label(name: Column) -> Column:
    """1 for archives of spam, 0 for ham, else null; the name is tested for spam first."""
    last = F.lower(F.element_at(F.split(name, "/"), -1))
    return F.when(last.contains("spam"), 1).when(last.contains("ham"), 0)


def read_archives(spark: SparkSession, folder: str, pattern: str = "*.tar.bz2") -> DataFrame:
    """(archive, member, label, subject, body, sender) of archives of messages.

    Archives with the same content are read once, the first by name; those
    without a label are skipped.  Duplicates go before anything is unpacked.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    hashed = files.select("path", F.sha2("content", 256).alias("h"))
    first = durable(hashed.groupBy("h").agg(F.min("path").alias("path")).select("path"), "archives")
    kept = files.join(broadcast_if_small(first), "path").withColumn("label", archive_label(F.col("path"))).where("label is not null")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import tarfile

        names = ["archive", "member", "label", "subject", "body", "sender"]
        for pdf in frames:
            for path, content, label in zip(pdf["path"], pdf["content"], pdf["label"]):
                rows, size = [], 0
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for member in tar:
                        if member.isfile() and not member.name.endswith("cmds"):
                            rows.append((path, member.name, int(label), *parse_message(tar.extractfile(member).read())))
                            size += member.size
                            if size > MEMBER_BYTES:
                                yield pd.DataFrame(rows, columns=names)
                                rows, size = [], 0
                yield pd.DataFrame(rows, columns=names)

    return kept.select("path", "content", "label").mapInPandas(run, "archive string, member string, label int, subject string, body string, sender string")


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows with the smallest hashes: a top-k, taken before anything costly."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def read_json_config(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def report_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(section, metric, value) of the metric lines ``- name: value`` in a Markdown report."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("at", "line"))
    heads = lines.withColumn("section", F.when(F.col("line").rlike("^#+ "), F.regexp_replace("line", "^#+ ", "")))
    filled = heads.withColumn("section", F.last("section", ignorenulls=True).over(Window.orderBy("at")))  # one report
    value = F.expr("try_cast(regexp_extract(line, r'^[-*] [^:]+: *`?([0-9.]+)', 1) as double)")
    return filled.select("section", F.regexp_extract("line", r"^[-*] ([^:]+):", 1).alias("metric"), value.alias("value")).where("value is not null")
