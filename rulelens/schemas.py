"""Table schemas and fixed values shared by all operators."""

from pyspark.sql import types as T

# Severity levels, most severe first, and their score penalties.
LEVELS = ["blocker", "critical", "major", "minor", "info"]
LEVEL_WEIGHTS = {"blocker": 25, "critical": 15, "major": 8, "minor": 3, "info": 0}
MAX_SCORE = 100

# Limits of a review run.
MAX_FINDINGS_PER_PATH = 10
MAX_TITLE_CHARS = 80
DEFAULT_CONFIDENCE = 0.9
DEFAULT_TTL_HOURS = 168
DEFAULT_SUMMARY_DAYS = 30
DEFAULT_RECENT_CALLS = 20
DEFAULT_PACK_VERSION = "0.1.0"
HASH_CHARS = 32
ISSUE_ID_CHARS = 12
SNIPPET_CONTEXT_LINES = 2

# Directory names a scan never enters (hidden ones aside).
IGNORED_DIRS = ["__pycache__", "node_modules", ".venv", "venv"]

STRINGS = T.ArrayType(T.StringType())

HUNK = T.StructType(
    [
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("content", T.StringType()),
        T.StructField("header", T.StringType()),
    ]
)

CORPUS = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("is_new", T.BooleanType()),
        T.StructField("hunks", T.ArrayType(HUNK)),
    ]
)

RULES = T.StructType(
    [
        T.StructField("rule_id", T.StringType()),
        T.StructField("pack", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("checklist", STRINGS),
        T.StructField("fix", T.StringType()),
        T.StructField("tags", STRINGS),
        T.StructField(
            "triggers",
            T.StructType(
                [T.StructField("file_patterns", STRINGS), T.StructField("code_patterns", STRINGS)]
            ),
        ),
        T.StructField("examples", T.MapType(T.StringType(), T.StringType())),
    ]
)

LOCATION = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("start_col", T.IntegerType()),
        T.StructField("end_col", T.IntegerType()),
    ]
)

# A finding is kept flat (location columns at top level) until it is serialised.
FINDINGS = T.StructType(
    [
        T.StructField("issue_id", T.StringType()),
        T.StructField("rule_id", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("start_col", T.IntegerType()),
        T.StructField("end_col", T.IntegerType()),
        T.StructField("title", T.StringType()),
        T.StructField("why", T.StringType()),
        T.StructField("do", STRINGS),
        T.StructField("pack", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("tags", STRINGS),
        T.StructField("snippet", T.StringType()),
        T.StructField("context", T.StringType()),
    ]
)
FINDING_COLUMNS = FINDINGS.fieldNames()

# What a cache entry keeps of a finding: no id, snippet or context, they are recomputed.
CACHED_FINDING = T.StructType(
    [
        T.StructField("rule_id", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("location", LOCATION),
        T.StructField("title", T.StringType()),
        T.StructField("why", T.StringType()),
        T.StructField("do", STRINGS),
        T.StructField("pack", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("tags", STRINGS),
    ]
)

CACHE = T.StructType(
    [
        T.StructField("file_hash", T.StringType()),
        T.StructField("rules_hash", T.StringType()),
        T.StructField("findings", T.ArrayType(CACHED_FINDING)),
        T.StructField("created_at", T.TimestampType()),
    ]
)
CACHE_KEY = ["file_hash", "rules_hash"]

USAGE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("model", T.StringType()),
        T.StructField("pack", T.StringType()),
        T.StructField("files", STRINGS),
        T.StructField("prompt_tokens", T.LongType()),
        T.StructField("completion_tokens", T.LongType()),
        T.StructField("total_tokens", T.LongType()),
        T.StructField("cost_usd", T.DoubleType()),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("issues_found", T.LongType()),
        T.StructField("cached", T.BooleanType()),
    ]
)
# Columns of old usage logs that were retired.
RETIRED_USAGE_COLUMNS = ["prompt_text", "response_text"]

# The structured answer a scorer returns for one row.
ANSWER_CORRUPT = "_corrupt"
ANSWER = T.StructType(
    [
        T.StructField(
            "issues",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("rule_id", T.StringType()),
                        T.StructField("level", T.StringType()),
                        T.StructField(
                            "location",
                            T.StructType(
                                [
                                    # Models write line numbers in several ways; they are read as text and checked.
                                    T.StructField("start_line", T.StringType()),
                                    T.StructField("end_line", T.StringType()),
                                ]
                            ),
                        ),
                        T.StructField("title", T.StringType()),
                        T.StructField("why", T.StringType()),
                        T.StructField("do", STRINGS),
                        T.StructField("confidence", T.DoubleType()),
                        T.StructField("tags", STRINGS),
                    ]
                )
            ),
        ),
        T.StructField(ANSWER_CORRUPT, T.StringType()),
    ]
)
EMPTY_ANSWER = '{"issues":[]}'

SCORED = T.StructType(
    [
        T.StructField("response_json", T.StringType()),
        T.StructField("prompt_tokens", T.LongType()),
        T.StructField("completion_tokens", T.LongType()),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("error", T.StringType()),
    ]
)

SPANS = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("span_id", T.IntegerType()),
        T.StructField("parent_id", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
    ]
)
