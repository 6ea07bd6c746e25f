"""The operators applied to the whole test tables, one query each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.staging import stage
from . import counting, dialogues, language, licenses, lines, mixing, negatives, packing, pages, secrets, simhash, vectors, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query
def op5_language_ppm(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return language.identify(docs, keep=["doc_id"]).select(
        "doc_id", language.held_out().alias("held_out"), "lang_pred", "score"
    )


@query
def op4_simhash_tiles(spark: SparkSession, d: str) -> DataFrame:
    return simhash.groups(table(spark, d, "documents")).select(
        "doc_id", simhash.as_hex().alias("fingerprint"), "component_id"
    )


@query
def op9_secret_structure(spark: SparkSession, d: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, d, "documents"), keep=["doc_id"])
    n = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = secrets.joined("secrets", secrets.BASE_KINDS)
    return found.select(
        "doc_id", *map(n, secrets.BASE_KINDS), F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        secrets.joined("secrets").alias("spans"),
    )


# The mix: a domain is a range of source numbers; targets are parts of the parent's budget.
DOMAINS = {"web": range(0, 5), "forum": range(5, 10), "books": range(10, 15), "reference": range(15, 20)}
MIX_WEIGHTS = ({"web": 4, "forum": 2, "books": 2, "reference": 2}, {"en": 5, "de": 2, "fr": 2, "es": 1}, {})


def mix_levels() -> dict[str, Column]:
    domain = F.lit("other")
    for name, numbers in DOMAINS.items():
        domain = F.when(F.col("source").isin([f"src{i}" for i in numbers]), name).otherwise(domain)
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


@query
def op7_mix_budget(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return mixing.mix(docs, mix_levels(), MIX_WEIGHTS).select(
        "doc_id", "domain", "lang", "source", "epoch", "n_tokens", "tokens_taken"
    )


def mix_sql(weights, total=(1, 2), max_epochs=2, seed=7) -> str:
    """The mix as plain SQL: the same whole-token budgets, level by level, and a running sum over
    each leaf's documents in the order of its last epoch."""
    levels = ["domain", "lang", "source"]
    case = " ".join(
        f"WHEN source IN ({', '.join(f"'src{i}'" for i in numbers)}) THEN '{name}'" for name, numbers in DOMAINS.items()
    )
    words = r"len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))"
    steps = [f"""WITH docs AS (
        SELECT doc_id, CASE {case} ELSE 'other' END AS domain, lang, source,
            CAST(coalesce({words}, 0) AS BIGINT) AS n_tokens FROM documents),
    leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM docs GROUP BY ALL)"""]
    for i, level in enumerate(levels):
        path = ", ".join(levels[: i + 1])
        up = " AND ".join(f"n.{x} IS NOT DISTINCT FROM u.{x}" for x in levels[:i])
        part = f"PARTITION BY {', '.join(levels[:i])}" if i else ""
        weight = f"CASE {' '.join(f"WHEN {level} = '{k}' THEN {w}" for k, w in weights[i].items())} ELSE 1 END" if weights[i] else "1"
        nodes = f"""SELECT {path}, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens) * {max_epochs} AS BIGINT) AS capacity,
            CAST({weight} AS DOUBLE) AS weight FROM leaves GROUP BY {path}"""
        budget = (
            f"(SELECT n.*, u.budget AS parent FROM ({nodes}) n JOIN level{i - 1} u ON {up})" if i else
            f"(SELECT n.*, CAST(floor(sum(tokens) OVER () * {total[0]} / {total[1]}) AS BIGINT) AS parent FROM ({nodes}) n)"
        )
        order = f"{part} ORDER BY CASE WHEN weight > 0 THEN capacity / weight END ASC NULLS LAST, {level} ASC NULLS FIRST"
        steps.append(f"""level{i} AS (
        SELECT {path}, tokens, CASE WHEN filled THEN capacity ELSE least(capacity,
            coalesce(CAST(floor(weight * ((parent - used) / nullif(rest, 0))) AS BIGINT), 0)) END AS budget FROM (
        SELECT *, coalesce(sum(CASE WHEN filled THEN capacity END) OVER ({part}), 0) AS used,
            sum(CASE WHEN filled THEN 0 ELSE weight END) OVER ({part}) AS rest FROM (
        SELECT *, coalesce(CASE WHEN weight > 0 THEN capacity / weight END <=
            (parent - coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / nullif(sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0), false) AS filled
        FROM {budget})))""")
    same = " AND ".join(f"d.{x} IS NOT DISTINCT FROM l.{x}" for x in levels)
    steps.append(f"""placed AS (
        SELECT d.*, l.budget, CAST(coalesce(l.budget // nullif(l.tokens, 0), 0) AS INTEGER) AS epochs,
            l.budget - coalesce(l.budget // nullif(l.tokens, 0), 0) * l.tokens AS rest,
            md5('{seed}:' || coalesce(l.budget // nullif(l.tokens, 0), 0) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
        FROM docs d JOIN level2 l ON {same}),
    summed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k
            RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
            sum(n_tokens) OVER (PARTITION BY domain, lang, source, k) AS own FROM placed)
    SELECT doc_id, domain, lang, source, CAST(e AS INTEGER) AS epoch, n_tokens, n_tokens AS tokens_taken
    FROM placed, unnest(range(epochs)) AS t(e)
    UNION ALL
    SELECT doc_id, domain, lang, source, epochs, n_tokens,
        CAST(CASE WHEN upto < rest THEN n_tokens ELSE least(n_tokens, rest - upto + own) END AS BIGINT)
    FROM summed WHERE rest > 0 AND upto - own < rest""")
    return ",\n".join(steps[:-1]) + ",\n" + steps[-1]


ORACLE_SQL["op7_mix_budget"] = mix_sql(MIX_WEIGHTS)


@query
def op10_pack_configurations(spark: SparkSession, d: str) -> DataFrame:
    cut = packing.pieces(table(spark, d, "documents"), keep=["doc_id"])
    # only digests of the ids are shuffled
    cut = cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(cut)


@query
def op8_html_template(spark: SparkSession, d: str) -> DataFrame:
    found = pages.main_text(table(spark, d, "pages"), keep=["page_id", "url"])
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


# Base 32 in SQL: five hex digits at a time give four letters.
_LETTERS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, {5 * g + 1}, 5) AS BIGINT) >> {15 - 5 * j}) & 31 AS INTEGER) + 1, 1)"
    for g in range(8) for j in range(4)
)
ORACLE_SQL["op2_warc_members"] = f"""SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, {_LETTERS} AS payload_digest,
    CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN nth > 1 THEN first END AS refers_to
    FROM (SELECT page_id, payload, sha1(payload) AS h, min(page_id) OVER (PARTITION BY payload) AS first,
      row_number() OVER (PARTITION BY payload ORDER BY page_id NULLS LAST, url NULLS FIRST) AS nth
      FROM (SELECT page_id, url, coalesce(html, '') AS payload FROM pages))"""


@query
def op2_warc_members(spark: SparkSession, d: str) -> DataFrame:
    return warc.digests(*warc.archive_pages(table(spark, d, "pages")))


@query
def op6_one_bit_codes(spark: SparkSession, d: str) -> DataFrame:
    return vectors.search(table(spark, d, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op3_line_field(spark: SparkSession, d: str) -> DataFrame:
    found = lines.assess(table(spark, d, "documents"), table(spark, d, "labels"), keep=["doc_id"])
    return found.select("doc_id", *lines.COUNTS, "base_failed", "kept")


@query
def op1_edit_counts(spark: SparkSession, d: str) -> DataFrame:
    counted = counting.count_tokens(table(spark, d, "documents"), keep=["doc_id", "text"])
    counted = stage(counted.withColumnRenamed("n_tokens", "tokens_before"), "counted")
    counted = counted.withColumn("n_tokens", F.col("tokens_before"))
    edited = counting.recount(counting.with_cleaning(counted), keep=["doc_id", "tokens_before"])
    return edited.select("doc_id", "tokens_before", "n_edits", "n_encoded", "n_tokens")


@query
def op13_role_repair(spark: SparkSession, d: str) -> DataFrame:
    damaged = dialogues.damage(table(spark, d, "conversations"))
    return dialogues.repair_conversations(damaged).withColumnRenamed("conv", "conv_id")


@query
def op12_hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, d, "embeddings"), F.col("vec_id") % 100 == 0, label)


ORACLE_SQL["op12_hard_negatives"] = """WITH r AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
        SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
        FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    positives AS (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
        vec_id AS negative_id, positive_score, score AS negative_score
    FROM positives p JOIN scored s USING (anchor_id)
    WHERE NOT same AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score QUALIFY rank <= 10"""


@query
def op11_license_rules(spark: SparkSession, d: str) -> DataFrame:
    return licenses.digest(licenses.find_licenses(table(spark, d, "documents"), keep=["doc_id"]), ["doc_id"])
