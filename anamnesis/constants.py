"""Results must equal the published behaviour, so these are not tunables."""

# Chunking.
CHUNK_CHAR_LIMIT = 1600

# Relevance, duplicates and the cold-query gate, as cosine distances.
RELEVANCE_DISTANCE = 0.5
DUPLICATE_DISTANCE = 0.08
COLD_QUERY_DISTANCE = 0.8

# BM25 and reciprocal-rank fusion.
BM25_K1 = 1.2
BM25_B = 0.75
MIN_TOKEN_LENGTH = 2
RRF_K = 60
RRF_LEG_DEPTH = 100
FUSED_DISTANCE_SPAN = 0.4

# Result sizes.
RECALL_K = 5
LIST_K = 10
OVERFETCH_FACTOR = 20
OVERFETCH_FLOOR = 100

# Text search.
TRIGRAM_SIZE = 3
MIN_LITERAL_LENGTH = 3
SNIPPET_CONTEXT = 48
SNIPPETS_PER_MEMORY = 3
SNIPPETS_PER_PATTERN = 200
PREVIEW_LENGTH = 200

# Ids and the tag that only one memory may carry.
ID_PATTERN = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"
RESERVED_TAG = "_index"

# Embedding batches.

# Evaluation depths.
REPORT_KS = (5, 10)

# Reconcile period.
RECONCILE_MINUTES = 10
