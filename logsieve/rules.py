"""Rule table, closed vocabularies and default texts.

Everything in the FIXED VALUES blocks below must stay exactly as written: the
triage results (labels, severities, report and alert texts) are compared
against the reference behaviour value for value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES: ordered failure rules (first match wins).
# (prio, pattern, category, severity, label); patterns match case-insensitively
# against the raw line.
# ---------------------------------------------------------------------------
DEFAULT_RULES: list[tuple[int, str, str, str, str]] = [
    (0, r"AccessDenied|403 Forbidden|403\b|Permission denied|NoSuchBucketException|AmazonS3Exception|FileNotFoundException|ADLS.*error|HDFS.*denied", "Infra", "HIGH", "StorageAccess"),
    (1, r"OutOfMemoryError|GC overhead limit exceeded|Container killed.*memory|heap space", "Spark", "CRITICAL", "OOM/Memory"),
    (2, r"ExecutorLost|Executor.*lost\b|Lost executor", "Spark", "HIGH", "ExecutorLost"),
    (3, r"FetchFailed|ShuffleBlockFetcherIterator|shuffle.*fetch.*fail", "Spark", "HIGH", "ShuffleFetch"),
    (4, r"TimeoutException|Connection refused|Connection reset|SocketTimeoutException|metadata.*after \d+\s*ms", "Dependency", "HIGH", "NetworkTimeout"),
    (5, r"No space left on device|DiskSpaceException|IOException.*disk", "Infra", "CRITICAL", "DiskFull"),
    (6, r"Driver.*crash|Driver.*exit.*error|SparkContext.*error|NullPointerException.*Driver", "Spark", "CRITICAL", "DriverCrash"),
    (7, r"Task.*failed.*attempt|Stage.*failed|Job aborted", "Spark", "HIGH", "TaskFailure"),
    (8, r"metastore|HiveException|TableLock|CatalogException", "Data", "MEDIUM", "MetastoreError"),
    (9, r"not serializable|SerializationException|Kryo.*Exception", "App", "MEDIUM", "Serialization"),
    (10, r"AnalysisException|UnresolvedException|ParseException", "App", "MEDIUM", "QueryError"),
    (11, r"Py4JJavaError|py4j\.protocol", "App", "HIGH", "PySpark-Py4J"),
    (12, r"SSLException|certificate.*error|ssl handshake", "Dependency", "MEDIUM", "SSL"),
    (13, r"Preempted|preemption|spot.*interrupt|Instance.*terminated", "Infra", "HIGH", "NodePreemption"),
    (14, r"WARN.*Retrying|Connection.*retry|Retry.*attempt", "Dependency", "LOW", "Retry"),
]

# FIXED VALUES: severity order, most severe first.
SEVERITY_ORDER: list[str] = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]

# FIXED VALUES: line-level patterns.
# Log line layout: timestamp? level? [thread]? logger? :? message
LOG_LINE_PATTERN = (
    r"^(\d{2}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2}|\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)?\s*"
    r"(ERROR|WARN|INFO|DEBUG|FATAL|TRACE)?\s*"
    r"(?:\[([^\]]+)\])?\s*"
    r"([A-Za-z0-9.$_]+(?:\.[A-Za-z0-9.$_]+)*)?\s*:?\s*"
    r"(.+)$"
)
LEVEL_ANYWHERE_PATTERN = r"\b(ERROR|WARN|INFO|DEBUG|FATAL)\b"
SPARK_VERSION_PATTERN = (
    r"Spark\s+version\s+(\d+\.\d+\.\d+)|Running\s+Spark\s+(?:version\s+)?(\d+\.\d+\.\d+)"
    r"|SparkContext.*Spark\s+(\d+\.\d+\.\d+)"
)
PLATFORM_PATTERN = r"(databricks|emr|yarn|kubernetes|k8s|gke|aks)"
STAGE_FAIL_PATTERN = r"Stage\s+(\d+)\s+(?:failed|aborted)"
EXECUTOR_LOST_PATTERN = r"(?:Lost|lost)\s+executor\s+(\d+)"
OOM_PATTERN = r"OutOfMemoryError|GC overhead"
SHUFFLE_FAIL_PATTERN = r"FetchFailed|shuffle.*fail"
TASK_RETRY_PATTERN = r"Task.*retry|Retry.*task"
STACK_FRAME_PATTERN = r"^\s+at\s+[\w.$<>]+\("
CAUSED_BY = "Caused by:"

# FIXED VALUES: limits.
EVIDENCE_CAP = 5            # evidence lines kept per signal in the signals row
STACK_WINDOW = 20           # non-blank lines searched after a first hit
SNIPPET_SIGNALS = 3
SNIPPET_EVIDENCE = 2
SNIPPET_STACK_CHARS = 500
PROMPT_EVIDENCE = 5
PROMPT_STACK_CHARS = 800
PROMPT_EXCERPT_CHARS = 1200
PROMPT_TAIL_CHARS = 2000
TAIL_LINES = 100
ERROR_SUBSET_LINES = 150
TAIL_BYTES = 512_000
MIN_LOG_CHARS = 50

# FIXED VALUES: alert defaults.
DEFAULT_RECIPIENTS = "data-engineering@company.com,sre-oncall@company.com"
DEFAULT_ALERT_SEVERITIES: list[str] = ["CRITICAL", "HIGH"]

# FIXED VALUES: rule-based triage (no model) texts.
RULE_TRIAGE_ROOT_CAUSE = (
    "(Mock) Pattern-matched failure detected. Set ANTHROPIC_API_KEY for full AI triage."
)
RULE_TRIAGE_MITIGATION = ["Review error logs", "Check cluster resources", "Retry job"]
RULE_TRIAGE_FIX = ["Fix root cause", "Add monitoring"]
RULE_TRIAGE_VERIFY = ["Confirm job succeeds on next run"]
RULE_TRIAGE_CONFIG = [("spark.sql.adaptive.enabled", "true")]
RULE_TRIAGE_NOTES = [
    ("impact", "Job failed"),
    ("resolution", "Under investigation"),
    ("preventive_actions", "Add alerts"),
    ("start_time", "Unknown"),
]

# FIXED VALUES: reply-parsing fallback and key defaults.
FALLBACK_MITIGATION = ["Review full logs manually"]
FALLBACK_FIX = ["Investigate further"]
FALLBACK_VERIFY = ["Check cluster health"]
FALLBACK_NOTES = [
    ("impact", "Unknown"),
    ("resolution", "Under investigation"),
    ("preventive_actions", "TBD"),
]

RULES_SCHEMA = T.StructType([
    T.StructField("prio", T.IntegerType(), False),
    T.StructField("pattern", T.StringType(), False),
    T.StructField("category", T.StringType(), False),
    T.StructField("severity", T.StringType(), False),
    T.StructField("label", T.StringType(), False),
])


#: Rules that a job's table may have in `classify`: it is collected, and compiled in blocks.
MAX_RULES = 2000


def rules_df(spark: SparkSession, rules: list[tuple] | None = None) -> DataFrame:
    """The rule table as a DataFrame (S11), so users can swap it."""
    return spark.createDataFrame(rules or DEFAULT_RULES, RULES_SCHEMA)


def rule_list(rules) -> list[tuple[int, str, str, str, str]]:
    """Normalise rules given as a list of tuples or as a (small) DataFrame."""
    if rules is None:
        return list(DEFAULT_RULES)
    if isinstance(rules, DataFrame):
        # The rule table is a job parameter (a few dozen rows), not data; one
        # beyond all use in a plan belongs in classify_join, which takes it block by block.
        rows = rules.orderBy("prio").limit(MAX_RULES + 1).collect()
        if len(rows) > MAX_RULES:
            raise ValueError(f"over {MAX_RULES} rules: classify with classify_join")
        return [(r["prio"], r["pattern"], r["category"], r["severity"], r["label"]) for r in rows]
    return sorted(rules, key=lambda r: r[0])
