"""Explicit schemas of the tables the operators exchange, as DDL texts."""

from __future__ import annotations

CELLS = (
    "bundle_id string, file_id string, sheet string, row int, col string, value string, formula string"
)
FILES = (
    "bundle_id string, file_idx int, file_id string, filename string, length bigint, "
    "sheets array<string>, readable boolean, error string"
)
FINDINGS = (
    "bundle_id string, severity string, severity_rank int, code string, title string, message string, "
    "location string, expected string, actual string, source string, needs_human boolean, "
    "stage_seq int, rule_seq int, row_seq bigint"
)
PAGE_LINES = ("doc_id string, page_no int, line_no int, line string")
CHUNKS = (
    "reg_code string, reg_title string, section_path string, title string, text string, "
    "chunk_seq int, `order` int, chunk_id string"
)
SECTION = "reg_code: string, section_path: string, title: string, excerpt: string, score: double, origin: string"
RETRIEVAL_MAP = (
    "schema_version int, built_at string, embedding_model string, "
    f"f03_items map<string, struct<item_id: string, canonical_topic: string, canonical_description: string, "
    f"canonical_ref_raw: string, refs: array<struct<reg_code: string, section_path_prefix: string>>, "
    f"sections: array<struct<{SECTION}>>>>, "
    f"f02_questions map<string, struct<qid: string, sections: array<struct<{SECTION}>>>>"
)
EVIDENCE_RESPONSE = (
    "results array<struct<item_id: string, difference: struct<flag: boolean, summary: string>, "
    "proposal: struct<vague: boolean, reason: string>, golive: struct<vague: boolean, reason: string>>>"
)
COMPLIANCE_RESPONSE = (
    "results array<struct<item_id: string, verdict: string, gap_refs: array<string>, reason: string>>"
)
INDEX_META = (
    "schema_version int, built_at string, embedding_model string, embedding_dim int, "
    "kind string, name string, chunks bigint, sha256 string"
)
INDEX_CHUNKS = (
    "reg_title string, section_path string, title string, text string, chunk_seq int, `order` int, "
    "id string, embedding array<float>, reg_code string"
)
INDEX_STATE = "reg_code string, n_lines bigint, mark_a string, mark_b string, embedding_model string, embedding_dim int"
AUDIT = (
    "event string, bundle_id string, subject string, filing_unit string, form_type string, error_count bigint, "
    "warn_count bigint, passed boolean, enable_llm boolean, duration_ms bigint, ts timestamp, "
    "run_id string, attempt string, event_date string"
)
AUDIT_COMMITS = "run_id string, attempt string, event_date string, committed_at timestamp"
