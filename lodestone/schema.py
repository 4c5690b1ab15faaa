"""Schemas of the relations. ord carries the order of rows wherever order is data."""

PAGE = (
    "ord long, url string, title string, meta_description string, h1_tags array<string>, h2_tags array<string>, h3_tags array<string>, "
    "body_text string, internal_links array<string>, external_links array<string>, word_count int, crawled_at timestamp, status_code int, "
    "content_type string, depth int"
)
PROMPT = (
    "ord long, prompt_text string, source_urls array<string>, relevance_score double, search_intent string, topic_cluster string, "
    "estimated_volume string, difficulty string, content_match_score double, status string, extraction_reasoning string"
)
VALIDATION = (
    "prompt_text string, is_accurate boolean, accuracy_score double, accuracy_reasoning string, is_faithful boolean, faithfulness_score double, "
    "faithfulness_reasoning string, quality_rating string, quality_score double, quality_reasoning string, overall_score double, "
    "debate_summary array<string>, validation_timestamp timestamp"
)
CLAIM = (
    "struct<claim_text:string,source_context:string,is_verifiable:boolean,verification_status:string,confidence:double,evidence:array<string>,reasoning:string>"
)
FACTCHECK = (
    f"prompt_text string, claims array<{CLAIM}>, overall_factual_score double, decomposition_reasoning string, verification_summary string, "
    "is_factually_sound boolean, confidence_level double, factcheck_timestamp timestamp"
)
SEARCH = "ord long, query string, clicks long, impressions long, ctr double, position double, pages array<string>, date_range string"
TRAFFIC = (
    "ord long, page_path string, sessions long, users long, pageviews long, avg_session_duration double, bounce_rate double, conversions long, organic_sessions long"
)
COMPETITOR = (
    "ord long, domain string, name string, reason string, strength string, overlap_areas array<string>, source string, industry string, pages_crawled int, prompts_found int"
)
RUN = "domain string, run_seq long, timestamp timestamp, prompt_count int, text string, score double, intent string, topic string, ord long"
REQUEST = "request_hash string, messages array<struct<role:string,content:string>>, temperature double, max_tokens int"
RESPONSE = "request_hash string, content string, error string, prompt_tokens long, completion_tokens long, cached_tokens long"

STATUSES = ("extracted", "validated", "factchecked", "correlated", "rejected")
RATINGS = ("high", "medium", "low", "rejected")
VERDICTS = ("pending", "verified", "refuted", "unverifiable")
