"""Fixed values of the report format.  Results depend on each of them literally."""

# Block headers and the key a template without sections is edited under.
FINDINGS = "FINDINGS:"
IMPRESSION = "IMPRESSION:"
WHOLE_BLOCK = "FINDINGS"

# Fixed value: a section header at the start of a line.
HEADER_RE = r"[A-Za-z][A-Za-z0-9 &/\-()]+:"

# Placeholders a template may carry.
LATERALITY_TOKENS = ("[left/right]", "[left/right/bilateral]", "[_laterality_]")
GENERIC_TOKEN = "[generic]"
PLACEHOLDERS = LATERALITY_TOKENS + (GENERIC_TOKEN,)

# Body-part suffixes dropped for the generic placeholder, first match wins.
GENERIC_SUFFIXES = (" spine", " joint", " bone", " region")

# Words that carry no signal for routing and retrieval.
STOP_WORDS = (
    "the", "and", "are", "with", "was", "for", "from", "this", "there", "that",
    "have", "has", "not", "no", "any", "is", "of", "in", "on", "at", "to", "a",
    "an", "be", "or", "but", "right", "left", "mild", "moderate", "severe",
    "small", "large", "shows", "show", "noted", "note", "consistent", "seen",
    "findings", "within", "without", "due", "related", "also", "both", "report",
    "imaging", "study", "showing",
)

# Routing thresholds.
MIN_TERM_LENGTH = 3
MIN_TERM_SUPPORT = 6
MIN_PAIR_SUPPORT = 3
MIN_PROBABILITY = 0.25
MAX_LABELS_PER_TERM = 8
MAX_DICTATION_TERMS = 4
MAX_CANDIDATES = 8

# Retrieval tiers and the weights of its four signals.
TIER_EDGES = (0.97, 0.90, 0.80)
TEMPLATE_WEIGHTS = {"labels": 0.40, "order": 0.25, "tokens": 0.35}
SCORE_WEIGHTS = {
    "template_similarity": 0.55,
    "modality_bodypart": 0.12,
    "dictation_similarity": 0.28,
    "edited_section_relevance": 0.05,
}
DEFAULT_K = 3

# Columns of the record sets.
CASE_COLUMNS = (
    "case_id", "modality", "body_part", "study_description",
    "patient_age_band", "patient_sex", "template_content", "dictation",
)
NON_BLANK_COLUMNS = ("body_part", "case_id", "dictation", "modality", "template_content")
EXPECTED_CASES = 132
FAILURE_COLUMNS = (
    "case_id", "row_index", "timestamp", "error_category", "error_message", "attempts",
)
SUCCESS, FAILED = "SUCCESS", "FAILED"

# Every character Python's str.strip() and \s treat as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)
