"""Names, limits and texts that reports must reproduce exactly."""

# Names of checks, settings and metrics, and limits.
CHECK_TYPES = (
    "unused_indexes",
    "missing_indexes",
    "sequential_scans",
    "slow_queries",
    "table_bloat",
    "parameter_settings",
    "database_snapshot",
)
CHECK_STATUSES = ("pending", "running", "success", "error")
SNAPSHOT_CHECK = "database_snapshot"


REVIEWED_SETTINGS = (
    "shared_buffers",
    "work_mem",
    "effective_cache_size",
    "max_connections",
    "maintenance_work_mem",
    "checkpoint_completion_target",
)
SNAPSHOT_SETTINGS = REVIEWED_SETTINGS + (
    "wal_buffers",
    "random_page_cost",
    "seq_page_cost",
    "cpu_tuple_cost",
    "autovacuum",
    "autovacuum_max_workers",
    "max_wal_size",
    "min_wal_size",
)
NUMERIC_SETTINGS = (
    "shared_buffers",
    "work_mem",
    "effective_cache_size",
    "max_connections",
    "maintenance_work_mem",
    "wal_buffers",
    "max_wal_size",
    "min_wal_size",
    "autovacuum_max_workers",
)
SETTING_ADVICE = {
    "shared_buffers": "Recommended: 25% of total system RAM.",
    "work_mem": "Recommended: Based on RAM, connections, and query complexity. Default is often too low.",
    "effective_cache_size": "Recommended: 75% of total system RAM.",
    "max_connections": "Varies. Check your connection pooler settings.",
    "maintenance_work_mem": "Recommended: 10% of RAM (up to 2GB).",
    "checkpoint_completion_target": "Recommended: 0.9",
}

COMPARED_METRICS = (
    "cache_hit_rate",
    "avg_query_time",
    "p95_query_time",
    "bloated_tables",
    "total_connections",
    "active_connections",
    "high_seq_scan_tables",
)

FORBIDDEN_KEYWORDS = ("insert", "update", "delete", "alter", "drop", "create", "grant", "revoke")

CHECK_EXPIRY = "5 minutes"
SNAPSHOT_RETENTION_DAYS = 90
RESULT_RETENTION_DAYS = 30
MAX_ROWS = 1000
CHART_MAX_ROWS = 50
# Size texts and their units.
UNIT_EXPONENT = {"KB": 1, "MB": 2, "GB": 3, "TB": 4}
SIZE_TEXT = r"(?i)(\d+(?:\.\d+)?)\s*(kB|MB|GB|TB)"
# Fixed values of type inference.
TYPE_SHARE = 0.7
NUMBER_TEXT = r"^-?\d+(\.\d+)?$"
DATE_TEXT = r"^\d{4}-\d{2}-\d{2}"

# Bands of one number.  UPPER bands hold up to and including their
# bound, LOWER bands from their bound on, ABOVE bands for values over it; the
# last label is for everything else.
CLASS_BELOW = ((50, "performance-excellent"), (200, "performance-good"), (1000, "performance-fair"), "performance-poor")
RATING_UPPER = ((50, "Excellent"), (200, "Good"), (1000, "Fair"), "Slow")
BENCHMARK_UPPER = ((100, "Excellent"), (500, "Good"), (2000, "Acceptable"), (10000, "Slow"), "Very Slow")
COST_UPPER = ((1000, "Low"), (10000, "Medium"), (100000, "High"), "Very High")
MEMORY_UPPER = ((10000, "Low"), (50000, "Medium"), (200000, "High"), "Very High")
MEMORY_PER_ROW_UPPER = ((1, "Excellent"), (5, "Good"), (20, "Fair"), "Poor")
MEMORY_IMPACT_UPPER = ((1, "Very efficient"), (10, "Reasonable usage"), (100, "High consumption"), "Memory intensive")
PLAN_EFFICIENCY_LOWER = ((80, "Excellent"), (60, "Good"), (40, "Fair"), "Poor")
COMPARED_EFFICIENCY_LOWER = ((85, "Excellent"), (70, "Good"), (50, "Fair"), "Needs Review")
IO_LOWER = ((80, "Excellent"), (50, "Good"), (20, "Fair"), "Poor")
IO_IMPACT_LOWER = ((0.8, "Excellent selectivity"), (0.5, "Good filtering"), (0.1, "Moderate waste"), "Poor selectivity")
PARALLEL_LOWER = ((90, "Excellent"), (70, "Good"), (50, "Fair"), "Poor")
GRADE_LOWER = ((90, "A"), (80, "B"), (70, "C"), "D")
TIME_IMPACT_ABOVE = ((50, "Critical"), (25, "High"), (10, "Moderate"), "Low")
COST_IMPACT_ABOVE = ((100, "Very High"), (50, "High"), (20, "Moderate"), "Low")
HIT_STATUS_ABOVE = ((95, "excellent"), (85, "good"), (70, "ok"), "attention")
TIME_STATUS_BELOW = ((10, "excellent"), (50, "good"), (100, "ok"), "attention")
PLANNING_SHARE_ABOVE = ((0.5, "High planning overhead"), (0.2, "Moderate planning cost"))
PLANNING_SHARE_SMALL = (0.05, "Efficient planning", "Balanced timing")
DANGEROUS_BLOAT_PCT = 50

# Points added to a score of 100.
OVERALL_TIME_ABOVE = ((10000, -40), (5000, -25), (1000, -15), (500, -8), 0)
OVERALL_COST_ABOVE = ((1000000, -20), (100000, -10), 0)
OVERALL_POINTS = {"index": 5, "workers": 5, "disk_sort": -10}
OVERALL_UNKNOWN = 75
PLAN_IO_BELOW = ((20, -40), (50, -20), 0)
PLAN_POINTS = {"index": 10, "large_seq_scan": -20, "disk_sort": -15, "workers": 5}
COMPARED_TIME_ABOVE = ((5000, -40), (1000, -20), (500, -10), 0)
COMPARED_POINTS = {"workers": 10, "memory": -15, "index": 5, "seq_scan": -10, "disk_sort": -15}
OPTIMIZATION_TIME_ABOVE = ((1000, -30), (500, -15), (100, -5), 0)
OPTIMIZATION_COST_ABOVE = ((10000, -20), (1000, -10), 0)
OPTIMIZATION_THIN = (0.1, -15)

# Limits of the findings.
ISSUE_SEQ_ROWS = 1000
ISSUE_SORT_MS = 100
ISSUE_LOOP_MS = 50
SLOW_MS = 1000
VERY_SLOW_MS = 5000
JOIN_REVIEW_MS = 500
COMPARED_MEMORY_KB = 50000
HIGH_MEMORY_KB = 100000
SCANNED_ROWS = 10000
LARGE_SCAN_ROWS = 100000
FASTER_PCT = 20
STRATEGY_PCT = 50
SLOWER_BY_MS = 200
SCORE_GAP = 5
SMALLEST_DIFFERENCE_PCT = 1
SEQ_SCAN = "Seq Scan"
DISK_SORT = "external merge"

# Category of a metric, first match by pattern of its name.
METRIC_CATEGORIES = (
    ("cache|hit", "Memory"),
    ("query|time", "Performance"),
    ("connection", "Concurrency"),
    ("bloat|table", "Storage"),
    "Database",
)
# Class of a plan node, first match by pattern of its lower-case type.
NODE_CLASSES = (
    ("seq scan", "seq-scan"),
    ("index.*scan", "index-scan"),
    ("hash", "hash"),
    ("sort", "sort"),
    ("aggregate", "aggregate"),
    ("limit", "limit"),
    ("join", "join"),
    "other",
)

# Why a statement is refused.
REFUSED_EMPTY = "Please enter a SQL query"
REFUSED_START = "Only SELECT statements are allowed"
REFUSED_SEMICOLON = "Semicolons (;) are not allowed. Please use a single SELECT statement only."
REFUSED_KEYWORD = "%s statements are not allowed. Only SELECT queries are permitted."

# Findings on plan nodes as (slow operation, suggestion).
ISSUE_SEQ = ("Sequential scan on %s (%s rows)", "Consider adding an index on %s to avoid full table scan")
ISSUE_SORT = ("Expensive sort operation (%sms)", "Consider adding an index to avoid sorting, or increase work_mem")
ISSUE_LOOP = (
    "Potentially expensive nested loop join",
    "Consider adding indexes on join columns or using different join strategy",
)
ISSUE_SPILL = ("Hash join spilling to disk", "Consider increasing work_mem to avoid disk spilling")
PLAN_UNREADABLE = "Failed to parse execution plan"

# Texts on one execution.
TEXT_VERY_SLOW = "Very slow execution time (>5 seconds)"
TEXT_SLOW = "Slow execution time (>1 second)"
TEXT_MEMORY = "High memory usage (>100MB)"
TEXT_DISK_SORT = "Sorting spilled to disk"
TEXT_LARGE_SCAN = "Large sequential scan detected"
TEXT_WORKERS = "Worker shortage detected"
TEXT_NO_ISSUES = "No major performance issues detected"
TEXT_ADD_INDEXES = "Consider adding indexes to eliminate sequential scans"
TEXT_WORK_MEM = "Increase work_mem to avoid disk-based sorting"
TEXT_PARALLEL = "Query could benefit from parallel execution"
TEXT_INDEXES = "Add indexes to improve query performance"
TEXT_JOINS = "Review join strategy and column statistics"
TEXT_OPTIMIZED = "Query is well-optimized"
BOTTLENECK_NAMES = {
    "seq_scan": "Sequential Scans",
    "disk_sort": "Disk Sorting",
    "memory": "High Memory",
    "workers": "Worker Shortage",
    "indexes": "Missing Indexes",
}
INDEX_USE_LABELS = {"only": "Excellent", "mixed": "Good", "seq": "Poor"}
INDEX_USE_IMPACT = {"only": "Optimal access", "mixed": "Mixed access pattern", "seq": "Sequential scans", "none": "Unknown pattern"}
PARALLEL_IMPACT = {"none": "No parallelization", "full": "Full utilization", "part": "Partial utilization"}

# Texts on recommendations, by words they contain.
RECOMMENDATION_IMPACTS = (
    (("index", "avoid"), "~50-80% faster"),
    (("work_mem",), "~20-40% improvement"),
    (("parallel",), "~30-60% faster"),
    "Performance gain",
)
RECOMMENDATION_HINTS = (
    (("index", "order_items"), "CREATE INDEX ON order_items(...)"),
    (("work_mem",), "SET work_mem = '256MB'"),
    (("parallel",), "Adjust max_parallel_workers"),
    "See PostgreSQL docs",
)

# Texts on a pair of executions; %s is A or B, or a number where noted.
PAIR_FASTER = "Query %s is %s% faster in execution time"
PAIR_SCANS = "Query %s uses index scans while Query %s uses sequential scans"
PAIR_VERY_SLOW = "Query %s: Very slow execution (%sms)"
PAIR_SLOW = "Query %s: Slow execution time (%sms)"
PAIR_MEMORY = "Query %s: High memory usage (%sKB)"
PAIR_DISK_SORT = "Query %s: Sorting spilled to disk"
PAIR_WORKERS = "Query %s: Only %s/%s parallel workers launched"
PAIR_LARGE_SCAN = "Query %s: Large sequential scan (%s rows)"
PAIR_INDEXES = "Query %s: Uses %s index(es) - %s"
PAIR_NO_INDEXES = "Query %s: No indexes used (may cause performance issues)"
PAIR_BETTER_INDEXES = "Query %s has better index utilization than Query %s"
PAIR_BOTH_INDEXED = "Both queries efficiently use indexes"
PAIR_STRATEGY = "Query %s could benefit from Query %s's execution strategy"
PAIR_MORE_MEMORY = "Query %s uses significantly more memory - consider optimizing"
PAIR_PARALLEL = "Query %s could benefit from parallel execution"
PAIR_WORK_MEM = "Query %s: Increase work_mem to avoid disk-based sorting"
PAIR_ADD_INDEXES = "Query %s: Consider adding indexes to eliminate sequential scans"
PAIR_OPTIMIZED = "Both queries are well-optimized"
PAIR_SIMILAR = "Similar performance"
PAIR_HIGH = "Consider adding appropriate indexes to reduce sequential scans and improve query performance."
PAIR_MEDIUM = "Analyze Query %s's execution plan to optimize the slower query's performance."
PAIR_LOW = "Monitor query performance over time and consider query result caching for frequently accessed data."
