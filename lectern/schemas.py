"""Explicit schemas of the review tables."""

SECTION = "section_number string, title string, content string"
SECTIONS = f"doc_id string, ord int, {SECTION}"
EXAMPLE = f"dimension string, error_type string, original struct<{SECTION}>, corrupted struct<{SECTION}>, error_description string"
USAGE = "requests bigint, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint"


DOCUMENT = f"record_index int, example_count int, file_name string, file_stem string, parse_token_usage struct<{USAGE}>, source_text string, examples array<struct<{EXAMPLE}>>"
BENCHMARK = f"total_files int, documents array<struct<{DOCUMENT}>>, total_examples int, error_type_counts map<string,int>"
ITEMS = "doc_id string, gt_index int, section_number string, dimension string, error_type string, title string, content string, error_description string"
PREDICTIONS = "doc_id string, pred_index int, section_number string, dimension string, error_type string, reason string, error_description string, evidence string, confidence string, critic_note string"
RULES = "id string, text string, metadata map<string,string>, embedding array<float>"
ISSUES = "reviewer_id string, location string, issue_type string, description string, suggestion string, confidence double, extra map<string,string>"
