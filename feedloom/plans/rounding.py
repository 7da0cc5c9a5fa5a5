"""Columns of doubles of the registered queries. Sums of doubles differ in their last bits with their order, so both a query
and its SQL give them rounded to ``PLACES`` places, without negative zeros."""

from __future__ import annotations

PLACES = 9
COLUMNS: dict[str, list[str]] = {
    "a01_asset_matches": ["relevance", "confidence"],
    "a02_primary_subjects": ["relevance"],
    "a03_aspect_votes": ["magnitude", "confidence"],
    "a06_dedup_entities": ["confidence"],
    "a07_tier3_composite": ["composite"],
    "a07_tier3_parts": ["enums", "assets", "summary", "entities", "economic", "event", "narrative", "embedding"],
    "a08_quality_score": ["q"],
    "a09_faithfulness": ["f"],
    "a10_rarity_weights": ["weight"],
    "a11_batch_verdict": ["composite", "match_rate"],
    "a14_penalty_detail": ["score"],
    "a19_weights": ["weight"],
    "a20_pay_split": ["pay"],
    "a21_commit_votes": ["weight"],
    "a23_cycle_metrics": ["p50", "p95", "completion", "ack_fail_rate", "timeout_rate"],
    "a24_log_stats": ["accept_rate"],
    "a25_worker_fields": ["share"],
    "a25_worker_report": ["rate"],
    "a27_gold_eval": ["asset_recall", "language_accuracy", "direction_agreement"],
    "e05_match_narratives": ["score"],
    "e06_narrative_intensity": ["sentiment"],
    "e10_split_candidates": ["cohesion"],
    "e11_merge_candidates": ["sim"],
    "e13_consensus_read": ["confidence"],
    "f01_triage_stage": ["confidence"],
    "f11_summary_agreement": ["cosine"],
    "flagship_ticker_days": ["relevance"],
    "j05_contagion_links": ["strength"],
    "j06_inferred_impacts": ["confidence"],
    "j10_asset_agreement": ["agreement"],
    "j11_clone_pairs": ["sim"],
    "j11_clone_pairs_differential": ["sim"],
    "j13_resolve_entities": ["confidence"],
    "k06_trending_events": ["momentum"],
    "p1_apply_model": ["peak"],
    "p3_vector_norm": ["n", "c"],
    "s08_read_commitments": ["score"],
    "t01_text_length": ["avg_sentence_length", "avg_word_length"],
    "t02_readability": ["flesch_ease", "flesch_kincaid"],
    "t03_density": ["numeric_density", "quote_density"],
    "t06_language_style": ["hedging", "certainty", "clickbait"],
    "t13_jaccard": ["tier", "quality"],
    "t14_ordinal_score": ["s"],
    "t15_sentiment_agreement": ["s"],
    "t16_vote_to_sentiment": ["magnitude"],
    "t21_recency": ["r"],
    "t22_post_value": ["v"],
    "t23_post_score": ["s"],
    "t24_article_score": ["s"],
    "t25_source_metadata": ["credibility"],
    "t26_economic_deltas": ["vs_expected", "vs_previous"],
    "t31_emission_gate": ["g"],
    "t33_copy_ratio": ["copy", "abstractive"],
    "t40_sentiment_value": ["v"],
    "w04_block_relevance": ["cosine"],
    "w08_observations": ["score", "weight"],
    "w09_reputation": ["reputation", "gate"],
    "w12_rolling_latency": ["median"],
    "x03_stream_reputation": ["reputation"],
    "x09_stream_triage": ["confidence"],
}
