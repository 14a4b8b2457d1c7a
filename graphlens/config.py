"""Thresholds and limits that decide results; fixed values shared by operators and their SQL."""

from __future__ import annotations

# Anchors
ANCHOR_STRONG, ANCHOR_WEAK, ANCHOR_DEGRADE = 0.80, 0.60, 0.40
NAME_EXACT, NAME_AMBIGUOUS = 0.85, 0.65
INHERIT_DECAY = 0.90
FOLLOW_UP_TOKENS = 12
# Retrieval metrics
CONCENTRATION, CONCENTRATION_ENHANCED, CONCENTRATION_DEGRADE = 0.55, 0.45, 0.35
EVIDENCE_SUFFICIENT, EVIDENCE_ENHANCEMENT, EVIDENCE_REQUIRED, EVIDENCE_RELEVANT = 0.60, 0.40, 2.0, 0.55
EXPANSION_GAIN, CONSISTENCY, METRICS_TOP_K = 0.25, 0.40, 5
# Rank fusion weights, in hundredths: anchor, name, type, similarity, distance, memory
FUSION = (30, 15, 10, 25, 10, 10)
RANK_TOP_K = 10
# Nearest neighbours per object type, and the least similarity
BUCKETS = {"module": 5, "file": 10, "symbol": 20, "relation": 15}
MIN_SIMILARITY = 0.5
# Files taken by a scan
MAX_FILE_BYTES = 1_000_000
# Prompts and documents
PROMPT_BUDGET, SECTION_CAP = 2_000, 50
LOW_CONFIDENCE, DEGRADED_SPLIT = 0.3, 0.6
# State
SESSION_TTL_S, RATE_LIMIT, RATE_WINDOW_S = 604_800, 120, 60
MAX_RETRIES = 3

#: First-match rules: what a module, file or symbol is responsible for, by a part of its name.
MODULE_RULES = (
    ("api", "API Layer"),
    ("controller", "API Layer"),
    ("service", "Business Logic"),
    ("business", "Business Logic"),
    ("model", "Data Model"),
    ("entity", "Data Model"),
    ("util", "Utility"),
    ("helper", "Utility"),
)
FILE_RULES = (("test", "Test"), ("config", "Configuration"), ("main", "Entry Point"), ("app", "Entry Point"))
SYMBOL_RULES = (
    ("get", "Query"),
    ("find", "Query"),
    ("query", "Query"),
    ("create", "Create"),
    ("add", "Create"),
    ("insert", "Create"),
    ("update", "Update"),
    ("modify", "Update"),
    ("delete", "Delete"),
    ("remove", "Delete"),
    ("validate", "Validation"),
    ("check", "Validation"),
)
LANGUAGE_LABELS = {
    "python": "Python Module",
    "java": "Java Class",
    "javascript": "JavaScript Module",
    "typescript": "TypeScript Module",
    "go": "Go Package",
    "rust": "Rust Module",
    "cpp": "C++ Source File",
    "c": "C Source File",
}
EXTENSIONS = {
    "py": "python",
    "java": "java",
    "js": "javascript",
    "jsx": "javascript",
    "ts": "javascript",
    "tsx": "javascript",
    "go": "go",
    "rs": "rust",
    "c": "c",
    "h": "c",
    "cc": "cpp",
    "cpp": "cpp",
    "hpp": "cpp",
}
RELATION_WORDS = {
    "calls": "calls",
    "extends": "extends",
    "implements": "implements",
    "depends_on": "depends on",
    "references": "references",
}
API_TYPES = ("route", "controller", "endpoint", "api")
