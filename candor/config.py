"""Default thresholds and size bounds.

The first block holds fixed values that results depend on. The second block
bounds what may be broadcast or handed to a single task; none of these bounds
ever drops a row, they only choose between plans with the same result.
"""

# fixed values
SIMILARITY_THRESHOLD = 0.85
TEMPORAL_SIMILARITY = 0.8
CAMPAIGN_MIN_SIZE = 5
CLUSTER_MIN_SAMPLES = 3
AUTHENTICITY_THRESHOLD = 0.7
LOW_AUTHENTICITY = 0.3
EMBEDDING_DIM = 384
FAILED_EMBEDDING_DIM = 768
EMBEDDING_MODEL = "hashing-384"
TEXT_MODEL_VERSION = "rule_based_v1.0"
IMAGE_MODEL_VERSION = "image_analyzer_v1.0"

# size bounds
BLOCK_ROWS = 4096  # rows of one side of a similarity block
PAIR_BLOCK_ROWS = 2048  # the same where the pairs themselves are emitted, 4 million at most per block pair
MAX_PIVOTS = 2048  # vectors sampled to partition the unit sphere
PASS_QUERIES = 10_000  # vectors of a similarity search that one pass over the candidates broadcasts
BROADCAST_ROWS = 200_000  # rows of a counted lookup table that may be broadcast
HEAVY_KEYS = 1_000  # a key above 1/HEAVY_KEYS of the rows is handled as heavy
