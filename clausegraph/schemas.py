"""Table contracts as DDL strings, for `spark.read.schema(...)`."""

DOCUMENTS = (
    "document_id STRING, policy_id STRING, version_seq INT, title STRING, version STRING, "
    "effective_date DATE, source STRING, cluster STRING, kind STRING, access STRING, "
    "preview BOOLEAN, source_type STRING, source_url STRING, mother_document STRING, "
    "precedence STRING, legislated BOOLEAN, standard_setting_party STRING, doc_class STRING, "
    "stance STRING, normalise_glyphs BOOLEAN, markdown STRING"
)
CORPUS = (
    "doc_id STRING, title STRING, doc_type STRING, jurisdiction STRING, issuer STRING, "
    "issued_date DATE"
)
PASSAGES = (
    "document_id STRING, policy_id STRING, seq INT, anchor STRING, heading STRING, passage STRING"
)
ANCHORS = (
    "document_id STRING, seq INT, clause_number STRING, starts_with STRING, heading STRING, "
    "parent STRING"
)
CLAUSES = (
    "clause_number STRING, bare_number STRING, policy_id STRING, document_id STRING, "
    "clause_seq INT, text STRING, heading STRING, source STRING, parent STRING, "
    "children ARRAY<STRING>, full_text STRING"
)
DROPPED = (
    "document_id STRING, clause_number STRING, reason STRING, heading STRING, starts_with STRING"
)
DOC_EDGES = (
    "source STRING, target STRING, type STRING, reason STRING, source_clauses ARRAY<STRING>, "
    "target_clauses ARRAY<STRING>, provenance STRING, confidence DOUBLE"
)
CANDIDATES = (
    "candidate_id STRING, doc_a STRING, doc_b STRING, seq INT, summary STRING, label STRING, "
    "sentiment STRING, source_clauses ARRAY<STRING>, target_clauses ARRAY<STRING>, "
    "scope_note STRING"
)
BRANCH_CANDIDATES = (
    "id STRING, paragraph STRING, branch STRING, source_document_id STRING, "
    "clause_number STRING, confidence_score DOUBLE, scope_note STRING, "
    "gap_deviates_ambiguous BOOLEAN, verdict STRING, rationale STRING, verification STRING, "
    "stance STRING, status STRING, reason STRING"
)
VERDICTS = (
    "id STRING, record_seq LONG, paragraph STRING, branch STRING, source_document_id STRING, "
    "verdict STRING, verdict_status STRING, confidence STRING, rationale STRING, "
    "clause_number STRING, verification STRING, stance STRING, status STRING, reason STRING"
)
SEEDS = (
    "seed_seq INT, canonical STRING, class_ STRING, aliases ARRAY<STRING>, "
    "left_forbidden ARRAY<STRING>, right_forbidden ARRAY<STRING>"
)
CHUNKS = "doc_id STRING, chunk_id STRING, char_start INT, char_end INT, text STRING"
PREDICTIONS = "chunk_id STRING, start INT, end INT, text STRING, label STRING, score DOUBLE"
SPANS = (
    "doc_id STRING, chunk_id STRING, char_start INT, char_end INT, surface STRING, "
    "class_ STRING, source STRING, confidence DOUBLE"
)
MENTIONS = (
    "entity_id STRING, doc_id STRING, chunk_id STRING, char_start INT, char_end INT"
)
EDGES = "source STRING, target STRING, edge_type STRING, weight DOUBLE"
RAW_REPLIES = "reply_id STRING, raw STRING"
