"""File readers and writers: columnar, delimited, XML, JSON, zipped tables."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.names import strong_key
from ..functions.scalars import parse_compact_date
from .archive_source import ArchiveMembers


def columns(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    return spark.read.parquet(path).select(*names)


def class_files(spark: SparkSession, pattern: str, id_pattern: str, out: str = "cls") -> DataFrame:
    """One file per class: the class id comes from the file name."""
    df = spark.read.parquet(pattern)
    return df.withColumn(out, F.regexp_extract(F.col("_metadata.file_path"), id_pattern, 1))


def delimited(
    spark: SparkSession, path: str, schema: str, sep: str = ",", null_value: str = "",
    drop_bad: bool = False, header: bool = True,
) -> DataFrame:
    """CSV or TSV against an explicit schema; ragged lines are padded or, with
    ``drop_bad``, dropped."""
    reader = spark.read.schema(schema).options(
        sep=sep, header=str(header).lower(), nullValue=null_value,
        mode="DROPMALFORMED" if drop_bad else "PERMISSIVE",
    )
    return reader.csv(path)


def json_lookup(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """JSON objects of objects, one row per entry with its key.  A file is one object over
    any number of lines; a lookup that ships in parts is read part by part."""
    text = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", f"map<string, struct<{value_schema}>>")
    return text.select(F.explode(entries).alias("key", "_v")).select("key", "_v.*")


# --- XML case files ---------------------------------------------------------

# Element names of a case file.
CASE_SCHEMA = """
`serial-number` string,
`case-file-header` struct<`filing-date`: string, `registration-date`: string, `status-code`: string,
  `mark-identification`: string, `attorney-name`: string, `intent-to-use-in`: string>,
`classifications` struct<classification: array<struct<`international-code`: array<string>, `us-code`: array<string>>>>,
`case-file-owners` struct<`case-file-owner`: array<struct<`party-name`: string, state: string, country: string>>>,
`case-file-statements` struct<`case-file-statement`: array<struct<`type-code`: string, text: string>>>,
`case-file-event-statements` struct<`case-file-event-statement`: array<struct<code: string, type: string,
  `description-text`: string, date: string, number: string>>>
"""

# What events need of it: less is built a case.
EVENT_SCHEMA = """
`serial-number` string, `case-file-header` struct<`attorney-name`: string>,
`case-file-event-statements` struct<`case-file-event-statement`: array<struct<code: string, type: string, date: string, number: string>>>
"""


def case_files(spark: SparkSession, path: str) -> DataFrame:
    """Raw case-file elements.  The schema is explicit: inference would turn serial
    numbers into numbers and a single statement into a struct."""
    return spark.read.format("xml").option("rowTag", "case-file").schema(CASE_SCHEMA).load(path)


def case_records(raw: DataFrame) -> DataFrame:
    """One row per case: first owner, sorted distinct class codes, statement texts
    whose type starts with GS joined by a blank."""
    h, st = F.col("case-file-header"), F.col("case-file-statements.case-file-statement")
    entries = F.col("classifications.classification")

    def codes(field: str):
        kept = F.flatten(F.filter(F.transform(entries, lambda c: c[field]), lambda x: x.isNotNull()))
        kept = F.filter(F.transform(kept, lambda c: F.trim(c)), lambda c: c != "")
        return F.coalesce(F.array_sort(F.array_distinct(kept)), F.array().cast("array<string>"))

    goods = F.filter(st, lambda s: s["type-code"].startswith("GS") & (F.length(s["text"]) > 0))
    owner = F.try_element_at("case-file-owners.case-file-owner", F.lit(1))
    return raw.select(
        F.col("serial-number").alias("serial"),
        h["filing-date"].alias("filing_date"),
        h["registration-date"].alias("registration_date"),
        h["status-code"].alias("status_code"),
        h["mark-identification"].alias("mark"),
        codes("international-code").alias("nice_classes"),
        codes("us-code").alias("us_classes"),
        owner["party-name"].alias("owner_name"),
        F.coalesce(F.array_join(F.transform(goods, lambda s: s["text"]), " "), F.lit("")).alias("goods_services"),
    )


def case_events(raw: DataFrame) -> DataFrame:
    """Events with the attorney of their own file: the parts of :data:`EVENT_SCHEMA` are enough."""
    ev = raw.select(
        F.col("serial-number").alias("serial"), F.col("case-file-header.attorney-name").alias("attorney_name"),
        F.explode("case-file-event-statements.case-file-event-statement").alias("e"),
    ).filter(F.length("e.code") > 0)
    number = lambda c: F.coalesce(F.col(c).try_cast("int"), F.lit(0))
    return ev.select(
        "serial", "e.code", F.coalesce("e.type", F.lit("")).alias("etype"),
        number("e.date").alias("date"), number("e.number").alias("seq"), "attorney_name",
    )


def case_tables(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events, case attributes and the (code, description) pairs of the same files."""
    extras = raw.select(
        F.col("serial-number").alias("serial"),
        F.col("case-file-header.attorney-name").alias("attorney_name"),
        F.col("case-file-header.intent-to-use-in").alias("intent_to_use_in"),
    )
    described = raw.select(F.explode("case-file-event-statements.case-file-event-statement").alias("e")).filter(F.length("e.code") > 0)
    described = described.select("e.code", F.col("e.description-text").alias("description"))
    return case_events(raw).drop("attorney_name"), extras, described.filter(F.col("description").isNotNull())


def owner_addresses(raw: DataFrame) -> DataFrame:
    """State and country of the first owner, one row per serial."""
    o = F.try_element_at("case-file-owners.case-file-owner", F.lit(1))
    rows = raw.select(F.col("serial-number").alias("serial"), o["state"].alias("state"), o["country"].alias("country"))
    one = rows.groupBy("serial").agg(F.min(F.struct("state", "country")).alias("_a"))
    return one.select("serial", "_a.state", "_a.country")


# --- zipped tables -----------------------------------------------------------


def archives(spark: SparkSession, pattern: str) -> DataFrame:
    """Paths of the archives; their content is not read."""
    return spark.read.format("binaryFile").load(pattern).select("path")


def _members(files: DataFrame, pattern: str, **options: str) -> DataFrame:
    """Records of the members whose base name fits, one partition a member; the driver sees the
    archives' names only."""
    spark = files.sparkSession
    spark.dataSource.register(ArchiveMembers)
    paths = sorted(r.path for r in files.select("path").distinct().collect())
    return spark.read.format("archive_members").options(paths=json.dumps(paths), members=pattern, **options).load()


def write_archives(files: DataFrame, folder: str) -> None:
    """Write ``(path, content)`` rows as files of a folder that all executors share."""

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        plain = folder.removeprefix("file://") if folder.startswith("file:///") else folder.removeprefix("file:")
        store, root = (fs.LocalFileSystem(), plain) if "://" not in plain else fs.FileSystem.from_uri(plain)
        store.create_dir(root, recursive=True)
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                with store.open_output_stream(f"{root}/{name}") as out:
                    out.write(content)
            yield pdf[["path"]]

    files.select("path", "content").mapInPandas(put, "path string").write.format("noop").mode("overwrite").save()


def archive_tables(files: DataFrame, members: Mapping[str, Sequence[str]]) -> DataFrame:
    """``(path, member, cells)``: the named columns of the named tab-separated members.

    Columns are found by each member's own header line, wherever they stand; one that an
    archive lacks is NULL, and lines shorter than the header are dropped.
    """
    wanted = json.dumps({m: list(names) for m, names in members.items()})
    return _members(files, "|".join(re.escape(m) for m in members), columns=wanted).drop("element")


def zipped_case_files(files: DataFrame, schema: str = CASE_SCHEMA) -> DataFrame:
    """Raw case-file elements of the ``.xml`` and ``.xml.gz`` members of archives, as
    :func:`case_files` gives them, or those of their parts that ``schema`` names; an element that is no XML has nulls only and is dropped."""
    rows = _members(files, r".*\.xml(?:\.gz)?", tag="case-file")
    raw = rows.select(F.from_xml("element", schema).alias("_r")).select("_r.*")
    return raw.filter(F.col("serial-number").isNotNull())


def member_table(tables: DataFrame, member: str, names: Sequence[str]) -> DataFrame:
    """One member's rows with their archive and named columns."""
    rows = tables.filter(F.col("member") == member)
    return rows.select("path", *[F.col("cells")[i].alias(n) for i, n in enumerate(names)])


# Column names of the published archives.
SUB = ("adsh", "cik", "name", "sic", "form", "fy", "fp", "period", "filed")
NUM = ("adsh", "tag", "ddate", "qtrs", "segments", "value")
SUBMISSION = ("ACCESSIONNUMBER", "FILING_DATE", "SUBMISSIONTYPE", "SIC_CODE", "TESTORLIVE")
OFFERING = (
    "ACCESSIONNUMBER", "INDUSTRYGROUPTYPE", "ISPOOLEDINVESTMENTFUNDTYPE", "INVESTMENTFUNDTYPE", "ISAMENDMENT", "SALE_DATE",
    "TOTALOFFERINGAMOUNT", "TOTALAMOUNTSOLD", "REVENUERANGE",
)
ISSUERS = (
    "ACCESSIONNUMBER", "CIK", "ENTITYNAME", "STATEORCOUNTRY", "ENTITYTYPE", "YEAROFINC_VALUE_ENTERED", "IS_PRIMARYISSUER_FLAG",
)


def financial_facts(files: DataFrame, tags: Sequence[str], forms: str = "^10-[KQ]") -> DataFrame:
    """Facts of annual and quarterly forms: wanted tags, no segment, joined on accession
    within each archive."""
    tables = archive_tables(files, {"sub.txt": SUB, "num.txt": NUM})
    sub = member_table(tables, "sub.txt", SUB).filter(F.col("form").rlike(forms))
    year = F.trim("fy")
    sub = sub.withColumn("cik", F.trim("cik").try_cast("long")).filter(
        F.col("cik").isNotNull() & ((year == "") | year.try_cast("int").isNotNull())
    )
    num = member_table(tables, "num.txt", NUM).filter(F.col("tag").isin(*tags) & (F.col("segments") == ""))
    number = F.col("value").try_cast("double")
    num = num.filter((F.col("value") == "") | number.isNotNull())
    return num.join(sub, ["path", "adsh"]).select(
        "adsh", "cik", "name", "sic", "form", year.try_cast("int").alias("fy"), "fp", "period", "filed", "ddate", "tag",
        F.col("qtrs").try_cast("int").alias("qtrs"), number.alias("value"),
    )


def offering_rounds(files: DataFrame, max_days: int = 1095) -> DataFrame:
    """Live offerings: submission, offering and issuer members joined within each archive; the
    first-sale date is trusted only up to ``max_days`` before the filing.  Has the columns
    that :func:`entities.operating_issuers` asks for."""
    names = ("FORMDSUBMISSION.tsv", "OFFERING.tsv", "ISSUERS.tsv")
    tables = archive_tables(files, dict(zip(names, (SUBMISSION, OFFERING, ISSUERS))))
    sub = member_table(tables, names[0], SUBMISSION).filter(F.upper("TESTORLIVE") == "LIVE")
    off = member_table(tables, names[1], OFFERING)
    iss = member_table(tables, names[2], ISSUERS).filter(F.trim("CIK").rlike("^[0-9]+$"))
    j = iss.join(sub, ["path", "ACCESSIONNUMBER"]).join(off, ["path", "ACCESSIONNUMBER"])
    filed, sold = parse_compact_date("FILING_DATE"), parse_compact_date("SALE_DATE")
    sane = F.when((sold <= filed) & (F.datediff(filed, sold) <= max_days), sold)
    flag = lambda c, yes: F.lower(F.coalesce(F.col(c), F.lit(""))) == yes
    return j.select(
        F.col("ACCESSIONNUMBER").alias("accession"), F.trim("CIK").cast("long").alias("cik"), F.col("ENTITYNAME").alias("entity_name"),
        strong_key("ENTITYNAME").alias("norm"), F.col("STATEORCOUNTRY").alias("state"), F.col("ENTITYTYPE").alias("entity_type"),
        F.col("YEAROFINC_VALUE_ENTERED").alias("year_inc"), flag("IS_PRIMARYISSUER_FLAG", "yes").alias("is_primary"),
        filed.alias("filed"), F.coalesce(sane, filed).alias("round_date"), F.col("SUBMISSIONTYPE").alias("submission_type"),
        F.col("SIC_CODE").alias("sic"), F.col("INDUSTRYGROUPTYPE").alias("industry"),
        flag("ISPOOLEDINVESTMENTFUNDTYPE", "true").alias("is_pooled"), F.col("INVESTMENTFUNDTYPE").alias("fund_type"),
        flag("ISAMENDMENT", "true").alias("is_amend"), F.col("TOTALOFFERINGAMOUNT").try_cast("double").alias("total_offering"),
        F.col("TOTALAMOUNTSOLD").try_cast("double").alias("total_sold"), F.col("REVENUERANGE").alias("revenue_range"),
    )


# --- ingest, schema changes, sinks -------------------------------------------


def of_class(records: DataFrame, cls: str, year_prefix: str | None = None) -> DataFrame:
    out = records.filter(F.array_contains("nice_classes", cls))
    return out if year_prefix is None else out.filter(F.col("filing_date").startswith(year_prefix))


def by_class(records: DataFrame, targets: Sequence[str]) -> DataFrame:
    """One row per record and declared class inside the targets."""
    wanted = F.array_intersect("nice_classes", F.array(*[F.lit(t) for t in targets]))
    return records.withColumn("cls", F.explode(wanted))


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename columns where present; running it again changes nothing, and a clash
    with an existing new name is refused."""
    for old, new in names.items():
        if old in df.columns and new in df.columns:
            raise ValueError(f"both {old} and {new} exist")
    return df.withColumnsRenamed({o: n for o, n in names.items() if o in df.columns})


def decay_as_window(decay_scores: DataFrame) -> DataFrame:
    """Decay score table in the layout of the window scores."""
    out = rename(decay_scores, {"n_eff_past": "n_past", "n_eff_future": "n_future"})
    out = out.drop("halflife_past", "halflife_future")
    return out.withColumn("n_past", F.col("n_past").cast("int")).withColumn("n_future", F.col("n_future").cast("int"))


def backfill(scores: DataFrame, records: DataFrame, key: str, column: str) -> DataFrame:
    if column in scores.columns:
        return scores
    return scores.join(records.select(key, column), key, "left")


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), if_missing: bool = False) -> None:
    """zstd parquet; ``if_missing`` leaves an existing table alone."""
    w = df.write.mode("ignore" if if_missing else "overwrite").option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_text(df: DataFrame, path: str, kind: str) -> None:
    w = df.write.mode("overwrite")
    w.option("header", "true").csv(path) if kind == "csv" else w.json(path)
