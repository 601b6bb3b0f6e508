"""Closed value sets and thresholds.

Fixed values: results depend on these exact strings and numbers.
"""

ENTITY_CLASSES = (
    "RegulatoryBody",
    "Party",
    "Reference",
    "Instrument",
    "Requirement",
    "Topic",
    "Process",
)

SCORE_LABEL_TO_CLASS = {
    "regulatory body": "RegulatoryBody",
    "regulated actor or third party": "Party",
    "external rule or standard": "Reference",
    "regulatory document": "Instrument",
    "regulatory requirement or duty": "Requirement",
    "domain topic": "Topic",
    "activity or process": "Process",
}

CONNECTION_LABELS = (
    "aligns-with",
    "differs-on",
    "conflicts-with",
    "silent-on",
    "goes-beyond",
)
SENTIMENTS = ("tighten", "loosen", "neutral")
SENTIMENT_LABEL = "differs-on"

VERDICTS = ("Consensus", "Conflict", "Gap", "Duplicate", "Partial")
PROVENANCES = ("structural", "curated", "llm-found")
FULL_CONFIDENCE_PROVENANCES = ("structural", "curated")

BLOCKED = "could_not_retrieve"
PENDING = "pending_extraction"
ILLUSTRATIVE = "illustrative"
PROPOSED = "proposed"
DEFAULT_BRANCH = "uncited"
DEFAULT_SOURCE_TYPE = "international_standard"

NO_CLAUSE_MESSAGE = "No matching clause found"
BLOCKED_REASON = "This source could not be retrieved automatically."
ADDED_REASON = (
    "Added by you — the tool will link it to this paragraph and analyse "
    "the connection."
)

HIGH_BAND_FROM = 0.85
MEDIUM_BAND_FROM = 0.70
SPAN_SCORE_MIN = 0.7
MENTIONS_MIN = 2
LONG_CHUNK_CHARS = 500
TOP_K = 10
