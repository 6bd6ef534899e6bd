"""Names, thresholds, lists and formats that results depend on."""

# --- Header hints per canonical field, in canonical order --------------------
CANONICAL_HINTS = {
    "customer_id": ("customer_id", "client_id", "account_id", "user_id"),
    "mrr": ("mrr", "monthly_recurring_revenue", "monthly_revenue", "revenue"),
    "plan": ("plan", "tier", "subscription_plan", "package"),
    "status": ("status", "subscription_status", "account_status"),
    "churned": ("churned", "is_churned", "churn", "cancelled"),
    "churn_date": ("churn_date", "cancelled_at", "end_date"),
    "start_date": ("start_date", "created_at", "subscription_start"),
    "churn_reason": ("churn_reason", "cancellation_reason", "reason"),
    "country": ("country", "country_code", "region"),
    "seats": ("seats", "users", "licenses", "quantity"),
}
DOMAIN_MIN_FIELDS = 3

# --- Column classes by lower-cased name --------------------------------------
DATE_NAMES = ("start_date", "churn_date", "created_at", "updated_at", "cancelled_at", "end_date")
DATE_SUFFIXES = ("_date", "_at")
FLAG_NAMES = ("churned", "is_churned", "churn", "cancelled", "active")
NUMBER_NAMES = ("mrr", "arr", "seats", "users", "licenses", "revenue", "amount", "price")
NUMBER_PREFIXES = ("mrr", "arr")
TRUE_TEXTS = ("true", "yes", "1")
# Forms of dates beside ISO, tried per column.
DATE_FORMATS = (
    "M/d/yyyy", "d/M/yyyy", "yyyy/M/d", "d.M.yyyy", "d-M-yyyy", "M-d-yyyy", "d MMM yyyy", "MMM d, yyyy", "yyyyMMdd",
    "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss",
)

# --- Cleaning ----------------------------------------------------------------
NULL_RATIO_LIMIT = 0.5
NUMERIC_TEXT_RATIO = 0.8
FILL_TEXT = "unknown"
CAP_IQR_MULTIPLIER = 3.0
CAP_EXEMPT = ("id", "row_id", "index")

# --- Derivation --------------------------------------------------------------
DAYS_PER_MONTH = 30.44
CHURNED_STATUSES = ("churned", "cancelled", "canceled")

# --- Quality rules for the subscription domain -------------------------------
# (name, column, check, limit, severity)
SUBSCRIPTION_RULES = (
    ("mrr_not_negative", "mrr", "min_value", 0, "error"),
    ("mrr_not_extreme", "mrr", "max_value", 1_000_000, "warning"),
    ("churn_rate_valid", "churned", "max_ratio_true", 0.95, "warning"),
    ("customer_id_not_null", "customer_id", "not_null_ratio", 0.99, "error"),
    ("customer_id_unique", "customer_id", "unique_ratio", 0.90, "warning"),
)

# --- Anomalies ---------------------------------------------------------------
ANOMALY_SKIP = ("id", "index", "row")
ANOMALY_MIN_VALUES = 10
ANOMALY_Z_LIMIT = 2.5
ANOMALY_IQR_MULTIPLIER = 1.5
SEVERITY_HIGH_Z = 4
SEVERITY_MEDIUM_Z = 3
PROMPT_CONTEXT_ITEMS = 8

# --- Enrichment labels and fallbacks -----------------------------------------
PLAN_LABELS = ("starter", "growth", "professional", "enterprise", "custom")
REASON_LABELS = ("price", "product", "competition", "support", "usage", "other")
INDUSTRY_LABELS = (
    "tech", "finance", "healthcare", "retail", "education", "manufacturing", "media", "other",
)
PLAN_FALLBACK = "unknown"
REASON_FALLBACK = "other"
INDUSTRY_FALLBACK = "other"
RISK_FALLBACK = 0.5
ENRICH_HEAD_ROWS = 50

# --- Read-only SQL -----------------------------------------------------------
BLOCKED_WORDS = (
    "insert", "update", "delete", "drop", "truncate", "alter", "create", "grant",
)
SQL_ROW_LIMIT = 100

# --- Sources -----------------------------------------------------------------
# Field texts that a delimited file uses for "no value".
NO_VALUE_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
FILE_SUFFIXES = (".csv", ".tsv")

# --- Histogram bounds --------------------------------------------------------
LATENCY_BOUNDS_MS = (100, 250, 500, 1000, 2000, 5000)
ETL_BOUNDS_SECONDS = (5, 15, 30, 60, 120, 300, 600)

# --- Texts of findings -------------------------------------------------------
HIGH_NULL_WARNING = "Column '%s' has %s%% nulls — consider dropping"
ID_LIKE_WARNING = "Column '%s' may be an ID column (all unique)"
DETAIL_MIN_VALUE = "%s values below %s"
DETAIL_MAX_VALUE = "%s values above %s"
DETAIL_NOT_NULL_RATIO = "not-null ratio = %s, required >= %s"
DETAIL_UNIQUE_RATIO = "unique ratio = %s, required >= %s"
DETAIL_TRUE_RATIO = "true ratio = %s, max allowed = %s"
DETAIL_UNKNOWN_CHECK = "unknown check"
DETAIL_NO_COLUMN = "Column '%s' not present — skipped"
EXPECTED_RANGE = "%.2f – %.2f"

REJECT_LINE = "more than %s fields"
REJECT_JSON = "no JSON"
REJECT_NO_RECORDS = "no records at the key"
REJECT_NO_OBJECT = "a record that is no object"
REJECT_DATE = "no date in the column's form"

# --- Report texts ------------------------------------------------------------
CHURNED_LINE = "- %s: $%s MRR | %s | reason: %s"
ANOMALY_LINE = "- [%s] %s: value=%.2f | %s"
TREND_HEADER = "period | MRR | churn_rate | active_customers"
NO_TREND = "No trend data available."
NO_CHURNED = "No churned customers found."
NO_ANOMALIES = "No significant anomalies detected."
NO_EXPLANATION = "No explanation"
REPORT_TYPE = "monthly_saas"

# --- Stored tables -----------------------------------------------------------
# Totals and counts are wide: they grow with the data, and a value that does not
# fit would be lost.
SUBSCRIPTIONS_DDL = (
    "id string, dataset_id string, customer_id string, customer_name string, plan string, "
    "plan_category string, mrr decimal(38,2), arr decimal(38,2), status string, "
    "churned boolean, churn_reason string, churn_reason_category string, "
    "churn_risk_score double, start_date timestamp_ntz, churn_date timestamp_ntz, "
    "lifetime_months double, country string, industry string, industry_category string, "
    "seats bigint, created_at timestamp_ntz"
)
METRICS_DDL = (
    "id string, dataset_id string, period string, mrr decimal(38,2), new_mrr decimal(38,2), "
    "expansion_mrr decimal(38,2), churned_mrr decimal(38,2), net_new_mrr decimal(38,2), "
    "active_customers bigint, new_customers bigint, churned_customers bigint, churn_rate double, "
    "nrr double, arpu double, created_at timestamp_ntz"
)
ANOMALIES_DDL = (
    "id string, dataset_id string, column_name string, method string, value double, "
    "score double, row_index bigint, row_key string, row_context string, llm_explanation string, "
    "severity string, created_at timestamp_ntz"
)
DATASETS_DDL = (
    "id string, name string, domain string, source_type string, row_count bigint, "
    "column_count int, status string, etl_config string, validation_report string, "
    "error_message string, run_id string, created_at timestamp_ntz, updated_at timestamp_ntz"
)
RUNS_DDL = "dataset_id string, table_name string, run_id string, published_at timestamp_ntz"
REJECTS_DDL = (
    "id string, dataset_id string, row_index bigint, line string, column_name string, value string, "
    "reason string, created_at timestamp_ntz"
)
JOBS_DDL = (
    "id string, dataset_id string, status string, progress int, stage string, "
    "rows_processed bigint, rows_cleaned bigint, rows_enriched bigint, started_at timestamp_ntz, "
    "finished_at timestamp_ntz, error_message string, created_at timestamp_ntz, "
    "updated_at timestamp_ntz"
)
QUERY_LOG_DDL = (
    "id string, question string, generated_sql string, result_rows bigint, answer string, "
    "latency_ms double, success boolean, truncated boolean, error_message string, created_at timestamp_ntz"
)
REPORTS_DDL = (
    "id string, dataset_id string, period string, report_type string, "
    "markdown_content string, pdf_path string, tokens_used int, created_at timestamp_ntz"
)
MONTH_PAIRS_DDL = (
    "dataset_id string, s timestamp_ntz, c timestamp_ntz, n bigint, v decimal(38,10), up bigint, down bigint"
)
REQUIRED_COLUMNS = {
    "subscriptions": ("customer_id", "plan", "mrr", "status"),
    "metrics": ("period", "mrr"),
    "anomalies": ("column_name", "method", "value", "score"),
    "datasets": ("name",),
}
