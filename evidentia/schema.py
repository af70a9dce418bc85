"""Schemas and the fixed vocabulary that defines matching behaviour."""

from __future__ import annotations

# Match strategies in the order in which they are tried.
STRATEGIES = ["exact", "case-insensitive", "normalized", "bag of words", "fuzzy", "ontology synonym"]
NOT_FOUND = "not found"
LLM = "llm"

# Answers that claim nothing.
PLACEHOLDERS = ["none", "n/a", "na", "not applicable", "unknown", "not specified", "not available", "null"]

# Short names of two leaf paths.
LEGACY_NAMES = {"Description.Title": "title", "Description.Comment.Paragraph": "comment"}

# Attribute names that make weaker evidence (0 for all others, lowest wins).
ATTRIBUTE_PRIORITY = {"source_name": 1, "sample_name": 2}

# Normalisation.
MIN_NORMALIZED = 4
MIN_LOOSE_CANDIDATE = 5
SEPARATORS = " \t\n\r-_"
OPENERS = "([{"
CLOSERS = ")]}"

# Whole tokens that may be fused to a normalised match.
FUSED_SUFFIXES = ["KO", "ko", "CKO", "cKO", "fl", "f", "flox", "LSL", "GFP", "eGFP", "OE", "KD", "wt", "Cre", "IRES", "lox", "delta", "del", "s"]
FUSED_PREFIXES = ["sh", "si", "sg", "TRE", "peg"]
POINT_MUTATION = r"^[A-Z]\d{1,4}[A-Z]$"

# Spelling tolerance.
MIN_FUZZY_WORD = 6
CONFUSABLE = ("lio", "110")

# Attribute names that hold a project accession.
PROJECT_ATTRIBUTES = ["bioproject_id", "bioproject"]

MATCH = "struct<name:string,content:string,start:int,end:int>"

#: Columns of a trace row; empty texts are '' and empty lists [], never null.
TRACE_COLUMNS = [
    "target_field",
    "target_value",
    "is_placeholder",
    "strategy",
    "raw_fields",
    "raw_texts",
    "raw_matched_phrase",
    "negated",
    "row_negated",
    "n_matches",
    "assigned_term_id",
    "assigned_term_label",
    "assigned_term_synonyms",
]
