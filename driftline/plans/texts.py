"""Text, token and vocabulary queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, text as tx
from ..operators import templates, trajectories, vocabulary
from . import bindings as b
from .registry import R, query, r, rounded, sql_list, view


@query("tok_chunked_ngrams", "SELECT doc_id, term, cnt FROM v_terms")
def tok_chunked_ngrams(spark, d):
    return b.raw_terms(spark, d).select("doc_id", "term", "cnt")


view(
    "v_words",
    f"""WITH chunks AS (SELECT doc_id, cls, unnest({b._CHUNKS}) AS chunk FROM v_corpus)
    SELECT doc_id, cls, unnest(regexp_extract_all(chunk, '\\b[a-z][a-z''-]{{1,}}\\b')) AS word FROM chunks""",
)


@query(
    "tok_stopwords",
    f"""SELECT cls, count(*) AS n_words,
    count(*) FILTER (WHERE list_contains({sql_list(b.STOPWORDS)}, word)) AS n_stop
    FROM v_words GROUP BY cls""",
)
def tok_stopwords(spark, d):
    chunks = tx.word_chunks("body", [])
    words = b.corpus(spark, d).select("cls", F.explode(F.flatten(chunks)).alias("word"))
    return words.groupBy("cls").agg(
        F.count(F.lit(1)).alias("n_words"),
        F.count_if(F.col("word").isin(b.STOPWORDS)).alias("n_stop"),
    )


@query("vocab_build", "SELECT cls, term, ngram_size, doc_freq, term_freq FROM v_vocab")
def vocab_build(spark, d):
    docs = vocabulary.require_text(b.corpus(spark, d))
    v = vocabulary.build_vocabulary(docs, b.doc_terms(spark, d, docs), b.MIN_DF, 0.5)
    return vocabulary.sorted_vocabulary(v)


@query(
    "vocab_top_k",
    """SELECT * FROM (SELECT cls, term, ngram_size, doc_freq, CAST(row_number() OVER (
      PARTITION BY cls, ngram_size ORDER BY doc_freq DESC, term) AS INTEGER) AS rank FROM v_vocab)
    WHERE rank <= 25""",
)
def vocab_top_k(spark, d):
    return vocabulary.top_terms(b.vocab(spark, d), 25, ["cls"]).drop("term_freq")


@query(
    "vocab_pool",
    """SELECT term, CAST(sum(doc_freq) AS BIGINT) AS doc_freq FROM v_vocab GROUP BY term
    HAVING sum(doc_freq) >= 20""",
)
def vocab_pool(spark, d):
    return vocabulary.pool_vocabularies(b.vocab(spark, d), 20)


@query("dtm_counts", "SELECT doc_id, term, cnt FROM v_terms JOIN v_vocab USING (cls, term)")
def dtm_counts(spark, d):
    docs = b.corpus(spark, d)
    terms = b.doc_terms(spark, d, docs)
    v = vocabulary.build_vocabulary(docs, terms, b.MIN_DF, 0.5)
    return vocabulary.count_matrix(terms, v).select("doc_id", "term", "cnt")


@query(
    "dtm_binary",
    """SELECT t.term, count(*) AS n_docs FROM v_terms t JOIN v_vocab v USING (cls, term)
    WHERE v.doc_freq >= 10 GROUP BY t.term""",
)
def dtm_binary(spark, d):
    docs = b.corpus(spark, d)
    terms = b.doc_terms(spark, d, docs)
    v = vocabulary.build_vocabulary(docs, terms, 10, 0.5)
    present = vocabulary.count_matrix(terms, v).select("doc_id", "cls", "term").distinct()
    return present.groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"))


view(
    "v_tfidf",
    """WITH n AS (SELECT cls, count(*) AS n FROM v_corpus GROUP BY cls),
    w AS (SELECT t.doc_id, t.cls, t.year, t.term, (1 + ln(t.cnt)) *
      (ln((1.0 + n.n) / (1.0 + v.doc_freq)) + 1) AS w
      FROM v_terms t JOIN v_vocab v USING (cls, term) JOIN n USING (cls))
    SELECT doc_id, cls, year, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w""",
)


@query("dtm_tfidf_l2", f"SELECT doc_id, term, {R('weight')} AS weight FROM v_tfidf")
def dtm_tfidf_l2(spark, d):
    docs = b.corpus(spark, d)
    terms = b.doc_terms(spark, d, docs)
    v = vocabulary.build_vocabulary(docs, terms, b.MIN_DF, 0.5)
    return vocabulary.tfidf_l2(terms, v, docs).select("doc_id", "term", r("weight").alias("weight"))


_ASCII = "regexp_replace(lower(body), '[^\\x00-\\x7F\\PL]|[^\\x00-\\x7F\\PN]', '0', 'g')"


@query(
    "tok_plain_word_set",
    f"""SELECT doc_id, CAST(len(list_distinct(regexp_extract_all({_ASCII}, '\\b[a-z]{{3,}}\\b'))) AS INTEGER) AS n_pattern,
    CAST(len(list_distinct(list_filter(regexp_split_to_array({_ASCII}, '\\s+'),
      lambda w: regexp_full_match(w, '[a-z]{{3,}}')))) AS INTEGER) AS n_split,
    list_sort(list_distinct(regexp_extract_all({_ASCII}, '\\b[a-z]{{3,}}\\b')))[1] AS first_word FROM v_corpus""",
)
def tok_plain_word_set(spark, d):
    found = tx.word_set("body")
    return b.corpus(spark, d).select(
        "doc_id",
        F.size(found).alias("n_pattern"),
        F.size(tx.word_set("body", "split")).alias("n_split"),
        F.try_element_at(found, F.lit(1)).alias("first_word"),
    )


@query(
    "tok_topic_pattern",
    f"""WITH t AS (SELECT doc_id, regexp_extract_all({_ASCII}, '\\b[a-z][a-z\\-]{{2,}}\\b') AS tk FROM v_corpus),
    g AS (SELECT unnest({b._GRAMS}) AS term FROM t)
    SELECT term, count(*) AS cnt FROM g GROUP BY term""",
)
def tok_topic_pattern(spark, d):
    terms = b.corpus(spark, d).select(F.explode(tx.plain_terms("body")).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("cnt"))


_TEMPLATE = "trim(regexp_replace(regexp_replace(lower(body), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
view(
    "v_copies",
    f"""SELECT template, count(*) AS n_copies, count(*) FILTER (WHERE status = 'F') AS hits
    FROM (SELECT doc_id, status, {_TEMPLATE} AS template FROM v_short) WHERE length(template) >= 5
    GROUP BY template""",
)


@query("text_template_norm", f"SELECT doc_id, {_TEMPLATE} AS template FROM v_corpus")
def text_template_norm(spark, d):
    return b.corpus(spark, d).select("doc_id", tx.template_key("body").alias("template"))


@query("text_template_counts", "SELECT template, n_copies FROM v_copies")
def text_template_counts(spark, d):
    return templates.copy_counts(b.short_corpus(spark, d))


def wilson_sql(p: str, n: str, sign: str) -> str:
    return (
        f"(({p} + 3.8416 / (2 * {n})) / (1 + 3.8416 / {n}) {sign} "
        f"1.96 * sqrt({p} * (1 - {p}) / {n} + 3.8416 / (4.0 * {n} * {n})) / (1 + 3.8416 / {n}))"
    )


@query(
    "text_template_bins",
    f"""SELECT copies, n_templates, n, hits, {R('rate')} AS rate, {R(wilson_sql('rate', 'n', '-'))} AS lo,
    {R(wilson_sql('rate', 'n', '+'))} AS hi FROM (
    SELECT copies, count(*) AS n_templates, CAST(sum(n_copies) AS BIGINT) AS n, CAST(sum(hits) AS BIGINT) AS hits,
      CAST(sum(hits) AS DOUBLE) / sum(n_copies) AS rate FROM (
      SELECT *, CASE WHEN n_copies <= 1 THEN '1' WHEN n_copies <= 2 THEN '2' WHEN n_copies <= 5 THEN '3-5'
        WHEN n_copies <= 10 THEN '6-10' WHEN n_copies <= 50 THEN '11-50' WHEN n_copies <= 200 THEN '51-200'
        WHEN n_copies <= 1000 THEN '201-1000' WHEN n_copies <= 5000 THEN '1001-5000' ELSE '5000+' END AS copies
      FROM v_copies) GROUP BY copies)""",
)
def text_template_bins(spark, d):
    out = templates.outcome_by_copies(b.short_corpus(spark, d), F.col("status") == "F")
    return rounded(out, "rate", "lo", "hi")


@query(
    "text_template_top",
    f"""SELECT template, n_copies, {R('CAST(hits AS DOUBLE) / n_copies')} AS rate FROM v_copies
    ORDER BY n_copies DESC, template LIMIT 50""",
)
def text_template_top(spark, d):
    out = templates.top_templates(b.short_corpus(spark, d), F.col("status") == "F", 50)
    return rounded(out, "rate")


def owner_names(spark, d):
    """Customer and supplier names with legal forms and punctuation added."""
    c = b.table(spark, d, "customer").select(
        F.col("c_custkey").alias("k"),
        F.expr(
            """CASE c_custkey % 12 WHEN 0 THEN concat(c_name, ', Inc.') WHEN 1 THEN concat('The ', c_name, ' Company')
            WHEN 2 THEN concat(c_name, ' Holdings Corp Ltd') WHEN 3 THEN concat(c_mktsegment, ' & Sons, L.L.C.')
            WHEN 4 THEN concat(c_mktsegment, ' Smith Jr.') WHEN 5 THEN concat('Müller, ', c_mktsegment)
            WHEN 6 THEN concat('José ', c_mktsegment, ' O''Neil-García') WHEN 7 THEN concat('Société ', c_name, ' Générale SA')
            WHEN 8 THEN concat('Müller ', c_custkey, ' GmbH') WHEN 9 THEN concat('ООО Ромашка-', c_mktsegment, ' Ltd')
            WHEN 10 THEN concat('Ελλάς bolt×ring COÉ ', c_name, ' L.L.C') ELSE lower(c_name) END"""
        ).alias("name"),
    )
    return c


view(
    "v_names",
    """SELECT c_custkey AS k, CASE c_custkey % 12 WHEN 0 THEN c_name || ', Inc.' WHEN 1 THEN 'The ' || c_name || ' Company'
    WHEN 2 THEN c_name || ' Holdings Corp Ltd' WHEN 3 THEN c_mktsegment || ' & Sons, L.L.C.'
    WHEN 4 THEN c_mktsegment || ' Smith Jr.' WHEN 5 THEN 'Müller, ' || c_mktsegment
    WHEN 6 THEN 'José ' || c_mktsegment || ' O''Neil-García' WHEN 7 THEN 'Société ' || c_name || ' Générale SA'
    WHEN 8 THEN 'Müller ' || c_custkey || ' GmbH' WHEN 9 THEN 'ООО Ромашка-' || c_mktsegment || ' Ltd'
    WHEN 10 THEN 'Ελλάς bolt×ring COÉ ' || c_name || ' L.L.C' ELSE lower(c_name) END AS name FROM customer""",
)
# The oracle's own statement of the fixed values, independent of functions/names.py.
# Its engine has no Unicode word boundary, so the character after a form is spelled out;
# it is put back, and further forms wait for the next pass.
_LEGAL_SQL = (
    "INC|INCORPORATED|LLC|LLP|LP|LTD|LIMITED|CORP|CORPORATION|CO|COMPANY|GMBH|SA|AG|NV|PLC|PBC|AB|OY|KK|KABUSHIKI KAISHA|SRL|SPA|SAS|"
    "BV|PTY|PTE"
)
_DOTTED_SQL = "L\\.L\\.C\\.|L\\.P\\.|S\\.A\\.|N\\.V\\.|S\\.R\\.L\\.|S\\.P\\.A\\.|S\\.A\\.S\\.|B\\.V\\."
SUFFIX_SQL = f"(?:^|[\\s,])(?:(?:{_LEGAL_SQL})($|[^\\pL\\pN_])|(?:{_DOTTED_SQL})(\\.|[\\pL\\pN_]))"
_LIGHT_SQL = (
    "\\b(?:INC|INCORPORATED|LLC|L L C|CORP|CORPORATION|LTD|LIMITED|CO|COMPANY|GMBH|S A|SA|AG|B V|BV|PTY|PLC|LP|LLP|KK|K K|CO LTD)\\b\\.?"
)
_ENTITY_SQL = (
    "LLC L.L.C. LL.C. L.L.C INC INC. INCORPORATED CORP CORP. CORPORATION CO CO. COMPANY LTD LTD. LIMITED LP L.P. LLP L.L.P. PLC "
    "P.L.C. GMBH AG NV N.V. BV B.V. SA S.A. SAS OY AB KG S.R.L. SRL S.A.S. TRUST FOUNDATION FUND ASSOCIATION ASSN ASSN. SOCIETY "
    "INSTITUTE INSTITUTION GROUP HOLDINGS ENTERPRISES INDUSTRIES BRANDS INTERNATIONAL WORLDWIDE GLOBAL UNIVERSITY COLLEGE SCHOOL "
    "ACADEMY HOSPITAL CLINIC MEDICAL CHURCH MINISTRIES PARISH DIOCESE BANK INSURANCE CAPITAL VENTURES PARTNERS TECHNOLOGIES "
    "TECHNOLOGY SOLUTIONS SYSTEMS SERVICES PRODUCTS PRODUCTIONS STUDIOS MEDIA ENTERTAINMENT RESTAURANTS FOODS AGENCY BUREAU "
    "DEPARTMENT GOVERNMENT USA U.S.A. U.S. AMERICA OF AND AND/OR"
).split()
_PERSON_SQL = "JR JR. SR SR. II III IV V ESQ ESQ. MD M.D. DO D.O. PHD PH.D. DDS D.D.S. JD J.D. CPA C.P.A.".split()


def strong_sql(name: str) -> str:
    s = f"replace(upper({name}), '&', ' AND ')"
    for _ in range(4):
        s = (
            f"trim(regexp_replace(regexp_replace(regexp_replace({s}, '{SUFFIX_SQL}', ' \\1\\2', 'g'), "
            f"'[^\\pL\\pN_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
        )
    return f"trim(regexp_replace(regexp_replace({s}, ' THE$', ''), '^THE ', ''))"


def light_sql(name: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace(regexp_replace(upper({name}), '[^A-Z0-9 ]', ' ', 'g'), "
        f"'{_LIGHT_SQL}', ' ', 'g'), '\\s+', ' ', 'g'))"
    )


@query("name_norm_strong", f"SELECT k, {strong_sql('name')} AS norm FROM v_names")
def name_norm_strong(spark, d):
    return owner_names(spark, d).select("k", names.strong_key("name").alias("norm"))


@query("name_norm_light", f"SELECT k, {light_sql('name')} AS norm FROM v_names")
def name_norm_light(spark, d):
    return owner_names(spark, d).select("k", names.light_key("name").alias("norm"))


def entity_sql(s: str) -> str:
    return (
        f"(regexp_matches(upper({s}), '@|\\.COM|\\.NET|\\.ORG|\\.IO|/|&|[0-9]') OR "
        f"list_has_any(regexp_extract_all(upper({s}), '[A-Z][A-Z.]*'), {sql_list(_ENTITY_SQL)}))"
    )


@query(
    "name_is_entity",
    f"""SELECT k, {entity_sql('name')} AS entity,
    NOT regexp_matches(upper(name), '{_LIGHT_SQL}') AND NOT contains(name, '&')
      AND len(regexp_split_to_array(trim(name), '\\s+')) BETWEEN 2 AND 4 AS personal FROM v_names""",
)
def name_is_entity(spark, d):
    return owner_names(spark, d).select(
        "k",
        names.is_entity("name").alias("entity"),
        names.looks_personal("name").alias("personal"),
    )


view(
    "v_surname",
    f"""WITH t AS (SELECT k, name, trim(upper(name)) AS raw,
      list_filter(list_transform(regexp_split_to_array(trim(upper(name)), '[\\s,]+'), lambda x: trim(x, '.')),
        lambda x: length(x) > 0) AS w FROM v_names),
    u AS (SELECT *, CASE WHEN list_contains({sql_list(_PERSON_SQL)}, w[len(w)])
      THEN w[1:len(w) - 1] ELSE w END AS v,
      list_filter(list_transform(regexp_split_to_array(trim(split_part(raw, ',', 1)), '\\s+'), lambda x: trim(x, '.')),
        lambda x: length(x) > 0) AS h FROM t)
    SELECT k, CASE WHEN length(raw) > 0 AND NOT {entity_sql('raw')} AND len(v) BETWEEN 2 AND 4
      AND len(list_filter(v, lambda x: NOT regexp_full_match(x, '[A-Z''\\-]+'))) = 0
      THEN CASE WHEN contains(raw, ',') AND len(h) BETWEEN 1 AND 2 AND regexp_full_match(h[1], '[A-Z''\\-]+')
        THEN h[1] ELSE v[len(v)] END END AS surname FROM u""",
)


@query("name_parse_surname", "SELECT k, surname FROM v_surname")
def name_parse_surname(spark, d):
    return owner_names(spark, d).select("k", names.surname("name").alias("surname"))


@query(
    "name_fold_diacritics",
    f"""SELECT k, CASE WHEN length(last) >= 2 THEN last END AS folded FROM (SELECT k, split_part(s, ' ', -1) AS last FROM (
    SELECT k, trim(regexp_replace(regexp_replace(translate(upper(name), 'ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ', 'AAAAAACEEEEIIIINOOOOOUUUUY'),
      '[^A-Z''\\- ]', '', 'g'), '\\s+', ' ', 'g')) AS s FROM v_names))""",
)
def name_fold_diacritics(spark, d):
    return owner_names(spark, d).select("k", names.folded_surname("name").alias("folded"))


THEMES = {"metal": r"(?i)\b(ring|bolt|gear)\b", "colour": r"(?i)\b(red|blue|green)\b",
          "economy": r"(?i)economy|small"}


@query(
    "theme_regex_tags",
    "SELECT doc_id, " + ", ".join(f"regexp_matches(body, '{p}') AS {k}" for k, p in THEMES.items())
    + " FROM v_short",
)
def theme_regex_tags(spark, d):
    return b.short_corpus(spark, d).select("doc_id", *tx.theme_flags("body", THEMES))


PHRASES = {"and_the": "and the", "in_the": "in the", "de_la": "de la"}


@query(
    "phrase_filter",
    "SELECT doc_id FROM v_corpus WHERE regexp_matches(regexp_replace(lower(body), '[^\\x00-\\x7F\\PL]|[^\\x00-\\x7F\\PN]', '0', 'g'), '(?i)\\band\\s+the\\b')",
)
def phrase_filter(spark, d):
    return b.corpus(spark, d).filter(tx.has_phrase("body", "and the")).select("doc_id")


@query(
    "phrase_trajectory",
    "WITH f AS (SELECT year, count(*) AS n_docs, "
    + ", ".join(
        f"count(*) FILTER (WHERE regexp_matches({_ASCII}, '{tx.phrase_pattern(p)}')) AS {k}"
        for k, p in PHRASES.items()
    )
    + " FROM v_corpus GROUP BY year HAVING count(*) >= 10), u AS ("
    + " UNION ALL ".join(
        f"SELECT year, n_docs, '{k}' AS phrase, {k} AS hits FROM f" for k in PHRASES
    )
    + f") SELECT *, {R('CAST(hits AS DOUBLE) / n_docs')} AS share FROM u",
)
def phrase_trajectory(spark, d):
    return rounded(trajectories.phrase_shares(b.corpus(spark, d), PHRASES, 10), "share")


@query(
    "token_lift_first_last",
    f"""WITH w AS (SELECT year, unnest(list_distinct(regexp_extract_all({_ASCII}, '\\b[a-z]{{3,}}\\b'))) AS word FROM v_corpus),
    n AS (SELECT year, count(*) AS n_docs FROM v_corpus GROUP BY year),
    f AS (SELECT word, year, count(*) / CAST(max(n_docs) AS DOUBLE) AS freq FROM w JOIN n USING (year) GROUP BY word, year)
    SELECT word, count(*) AS n_years, {R('avg(freq) FILTER (WHERE year BETWEEN 2000 AND 2001) / avg(freq) FILTER (WHERE year BETWEEN 1995 AND 1996)')} AS lift,
    {R('regr_slope(ln(freq), year)')} AS log_slope FROM f GROUP BY word HAVING count(*) >= 2""",
)
def token_lift_first_last(spark, d):
    freq = trajectories.word_year_frequency(b.corpus(spark, d))
    out = trajectories.first_last_lift(freq, (1995, 1996), (2000, 2001))
    return rounded(out, "lift", "log_slope")
