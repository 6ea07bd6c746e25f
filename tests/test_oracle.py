"""A cross-section of the bound queries against their oracles at sf0.001.

``python -m tests.oracle`` compares all of them at sf0.01.
"""

import pytest

from driftline.plans import ORACLE_SQL, QUERIES

from .oracle import compare, connection

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
KEYS = (
    "kl_year_window kl_topic_rolling kl_token_attribution vocab_build tok_chunked_ngrams name_norm_strong "
    "text_template_bins gate_event_window gate_cohort_curve hazard_by_age event_response_latency join_theta_after "
    "agg_hhi_topn agg_corr_spearman win_ordinal_bin win_autocorr bin_quantile_curve bin_2d_grid newterms "
    "crosswalk_exact funding_match returns_panel reg_fe_lpm_cluster eb_shrink theme_panel src_xml_records "
    "stream_term_counts src_tsv_zip_financials src_tsv_zip_offerings reg_ols reg_twoway_fe reg_logit_outcomes "
    "name_is_entity score_summary theme_bass_fit kernel_surface_bandwidth src_xml_events"
).split()


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("key", KEYS)
def test_query_equals_oracle(spark, con, key):
    message = compare(QUERIES[key](spark, SF), con, ORACLE_SQL[key])
    if message == "EMPTY":  # nothing to compare in the small tables
        message = compare(QUERIES[key](spark, LARGER), connection(LARGER), ORACLE_SQL[key])
    assert message is None, message


def test_every_query_has_a_callable_and_oracles_belong_to_queries():
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert all(callable(q) for q in QUERIES.values())
