"""Declared record schemas and enumerations. Records are never read with inferred schemas."""

from __future__ import annotations

# Enumerations of the data model, in their defined order.
REPAIR_CATEGORIES = ["appliance", "plumbing", "electrical", "hvac", "general"]
ITEM_FAILURES = [
    "incomplete_answer",
    "safety_violations",
    "unrealistic_tools",
    "overcomplicated_solution",
    "missing_context",
    "poor_quality_tips",
]
PAIR_FAILURES = [
    "experience_mismatch",
    "seniority_mismatch",
    "missing_core_skills",
    "hallucinated_skills",
    "awkward_language",
]
EXPERIENCE_LEVELS = ["Entry", "Mid", "Senior", "Lead", "Executive"]
PROFICIENCY_LEVELS = ["Beginner", "Intermediate", "Advanced", "Expert"]
FIT_LEVELS = ["Excellent", "Good", "Partial", "Poor", "Mismatch"]
WRITING_STYLES = ["formal", "casual", "technical", "achievement", "career_changer"]
ERROR_CATEGORIES = ["missing_field", "type_mismatch", "format_violation", "logical_inconsistency"]
PARSERS = ["pdfplumber", "pypdf2", "pymupdf"]
CHUNK_METHODS = ["fixed_size", "sentence", "semantic"]
RETRIEVAL_METHODS = ["bm25", "vector", "hybrid"]

ITEM = (
    "struct<question: string, answer: string, equipment_problem: string, tools_required: array<string>, "
    "steps: array<string>, safety_info: string, tips: array<string>>"
)
ITEM_JUDGEMENT = "struct<" + ", ".join(f"{m}: int" for m in ITEM_FAILURES) + ">"
QA_RECORD = (
    f"trace_id string, item {ITEM}, "
    "metadata struct<trace_id: string, category: string, prompt_version: string, passed_validation: boolean, "
    "validation_errors: array<string>, model_name: string, timestamp: string>, "
    f"judge_result {ITEM_JUDGEMENT}"
)

RESUME = (
    "struct<contact: struct<name: string, email: string, phone: string, location: string, linkedin: string, "
    "portfolio: string>, "
    "education: array<struct<degree: string, institution: string, graduation_date: string, gpa: double, "
    "coursework: array<string>>>, "
    "experience: array<struct<company: string, title: string, start_date: string, end_date: string, "
    "responsibilities: array<string>, achievements: array<string>>>, "
    "skills: array<struct<name: string, proficiency_level: string, years_used: double>>, summary: string, "
    "metadata: struct<trace_id: string, generated_at: string, prompt_template: string, fit_level: string, "
    "writing_style: string>>"
)
JOB = (
    "struct<company: struct<name: string, industry: string, size: string, location: string>, title: string, "
    "description: string, requirements: struct<required_skills: array<string>, preferred_skills: array<string>, "
    "min_education: string, experience_years: int, experience_level: string>, "
    "metadata: struct<trace_id: string, generated_at: string, is_niche_role: boolean>>"
)
PAIR_METADATA = (
    "struct<pair_id: string, created_at: string, fit_level: string, writing_style: string, "
    "correction_attempts: int, passed_validation: boolean, validation_error_count: int>"
)
PAIR = f"resume {RESUME}, job {JOB}, metadata {PAIR_METADATA}"

ERROR = "struct<field_path: string, category: string, invalid_value: string, expected_format: string, message: string>"
LABELS = (
    "pair_id string, skills_overlap double, "
    + ", ".join(f"{m} boolean" for m in PAIR_FAILURES)
)
PAIR_JUDGEMENT = (
    "pair_id string, hallucination_score int, awkward_language_score int, quality_score int, "
    "fit_assessment string, recommendations array<string>"
)

PAGE = "document_id string, page_number int, text string, start_char bigint, end_char bigint"
CHUNK = (
    "id string, document_id string, text string, page_number int, chunk_index int, start_char bigint, "
    "end_char bigint, method string, section_indices array<int>, metadata map<string, string>"
)
QA_EXAMPLE = "question string, relevant_chunk_ids array<string>, metadata map<string, string>"
RETRIEVAL = "query_id string, method string, rank int, chunk_id string, score double"
EXPERIMENT = (
    "experiment_id string, embedding_model string, chunking_method string, retrieval_method string, "
    "use_reranking boolean, metrics struct<recall_at_k: map<string, double>, precision_at_k: map<string, double>, "
    "ndcg_at_k: map<string, double>, mrr: double, map_score: double, avg_retrieval_time: double, total_queries: bigint>"
)
