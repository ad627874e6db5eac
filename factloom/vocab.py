"""Vocabularies, as plain tables.  All of them are parameters of the functions that use them."""

from __future__ import annotations

# They must equal the published vocabulary for results to agree.
FORWARD = ("CALLS", "INVOKES_LAMBDA", "INVOKES_STEP_FUNCTION", "PUBLISHES_TO_SNS", "WRITES_TO_S3", "WRITES_DATABASE", "WRITES_DYNAMODB_TABLE", "WRITES_FILE", "RETURNS_RESPONSE", "FEEDS", "CALLS_HTTP_API", "IMPLEMENTED_BY", "HANDLED_BY", "IN_BUCKET")
REVERSED = ("READS_FROM_S3", "QUERIES_DATABASE", "READS_DYNAMODB_TABLE", "READS_FILE", "READS_CONFIG_FROM_S3", "EXPOSES_ENDPOINT", "RECEIVES_EVENT")
WRITES = ("WRITES_TO_S3", "WRITES_DATABASE", "WRITES_DYNAMODB_TABLE", "WRITES_FILE")
READS = ("READS_FROM_S3", "QUERIES_DATABASE", "READS_DYNAMODB_TABLE", "READS_FILE", "READS_CONFIG_FROM_S3")
ENTRIES = ("EXPOSES_ENDPOINT", "RECEIVES_EVENT")
OBSERVABLE = ("WRITES_TO_S3", "WRITES_DATABASE", "WRITES_DYNAMODB_TABLE", "WRITES_FILE", "READS_FROM_S3", "QUERIES_DATABASE", "READS_DYNAMODB_TABLE", "READS_FILE", "READS_CONFIG_FROM_S3", "EXPOSES_ENDPOINT", "INVOKES_STEP_FUNCTION", "PUBLISHES_TO_SNS", "RETURNS_RESPONSE")
#: predicate, table, kind
ROUTES = (
    ("WRITES_DATABASE", "app_tables", "written"),
    ("QUERIES_DATABASE", "app_tables", "read"),
    ("READS_DYNAMODB_TABLE", "app_tables", "read_dynamodb"),
    ("WRITES_DYNAMODB_TABLE", "app_tables", "written_dynamodb"),
    ("WRITES_TO_S3", "app_s3_paths", "written"),
    ("READS_FROM_S3", "app_s3_paths", "read"),
    ("READS_CONFIG_FROM_S3", "app_s3_paths", "config_read"),
    ("EXPOSES_ENDPOINT", "app_endpoints", "exposed"),
    ("CALLS_HTTP_API", "app_endpoints", "called"),
    ("INVOKES_LAMBDA", "app_service_invocations", None),
    ("INVOKES_STEP_FUNCTION", "app_service_invocations", None),
    ("PUBLISHES_TO_SNS", "app_service_invocations", None),
    ("HAS_JPA_RELATIONSHIP", "app_table_relationships", None),
    ("READS_SSM_PARAMETER", "app_parameters", "ssm"),
    ("READS_ENV_VAR", "app_parameters", "env_var"),
)
TYPES = ("Module", "Class", "Function", "Method", "Symbol", "Table", "S3Object", "Parameter", "APIEndpoint", "LambdaFunction", "StateMachine", "Step", "Dataframe", "WorkflowFile")
# Published stages, phrases and hints.
STAGES = ("bootstrap", "extract", "transform", "validate", "load", "monitor", "notify", "e2e", "general")
ACTION_PHRASES = (
    ("initialize", ("initialize", "bootstrap", "startup", "load configuration", "settings document", "configuration")),
    ("retrieve", ("retrieve", "extract", "pull rows", "ingest", "source data", "fetch", "connector")),
    ("transform", ("prepare", "transform", "merge", "convert", "shape", "rename", "cast", "consolidate", "duplicate")),
    ("validate", ("validate", "validation", "quality gate", "quality rules", "mandatory field", "schema check")),
    ("import", ("import", "load phase", "upload", "submit", "anaplan action", "model load", "push into anaplan")),
    ("monitor", ("monitor", "poll", "progress", "execution", "live progress", "terminal state")),
    ("notify", ("notify", "notification", "communique", "stakeholder", "feed owner")),
    ("retry", ("retry", "recovery", "transient", "attempt recovery")),
    ("reject", ("reject", "fail", "failure", "abort", "halt", "stop", "block", "terminate", "must not")),
    ("route", ("route", "dispatch", "based on", "connector registered", "path")),
    ("complete", ("complete", "success", "successfully", "happy path", "approved", "eligible")),
    ("history", ("history", "historical", "audit", "browse", "review")),
    ("summarize", ("summary", "metrics", "report", "gate report", "archived")),
)
STAGE_PHRASES = (
    ("bootstrap", ("initialize", "bootstrap", "startup", "configuration", "settings")),
    ("extract", ("retrieve", "extract", "source", "pull", "ingest", "connector", "feed")),
    ("transform", ("prepare", "transform", "shape", "merge", "convert", "consolidate")),
    ("validate", ("validate", "validation", "quality gate", "quality rules", "mandatory")),
    ("load", ("import", "load", "upload", "submit", "anaplan")),
    ("monitor", ("monitor", "poll", "progress", "status", "execution", "visibility")),
    ("notify", ("notify", "notification", "communique", "stakeholder")),
    ("e2e", ("end to end", "e2e", "full happy path", "workflow")),
)
POSITIVE = ("success", "successfully", "complete", "valid", "approved", "eligible", "healthy", "compliant", "clear", "resolve", "ready", "pass", "continues")
NEGATIVE = ("fail", "failure", "reject", "stop", "abort", "halt", "block", "missing", "absent", "unavailable", "empty", "zero", "timeout", "invalid", "cannot", "not continue", "must not", "no ", "terminate", "exhausted", "cancel")
#: (reference, candidate) stages that may cover each other, besides equal ones and a reference of "general".
COMPATIBLE = (("transform", "extract"), ("validate", "load"), ("load", "validate"), ("monitor", "e2e"), ("notify", "e2e"), ("e2e", "monitor"), ("e2e", "notify"))
# Published weights, sections, tiers and lifecycles.
WEIGHTS_FULL = {"manual_recall": 0.28, "manual_action": 0.10, "manual_positive": 0.06, "manual_negative": 0.08, "manual_stage": 0.04, "manual_feature": 0.04, "coverage_efficiency": 0.10, "suite_precision": 0.10, "requirement_recall": 0.12, "triangulation": 0.08}
WEIGHTS_MANUAL = {"manual_recall": 0.35, "manual_action": 0.125, "manual_positive": 0.075, "manual_negative": 0.10, "manual_stage": 0.05, "manual_feature": 0.05, "coverage_efficiency": 0.125, "suite_precision": 0.125}
SECTIONS = ("System Overview", "Input Specification", "Consolidated Requirements", "Output Specification", "Function Specification", "User Stories", "Traceability Matrix", "Confidence Mapping", "Gap Analysis")
TIERS = (("user stories", "primary"), ("consolidated requirements", "primary"), ("function specification", "secondary"), ("gap analysis", "secondary"), ("traceability matrix", "metadata"), ("confidence mapping", "metadata"), ("input specification", "metadata"), ("output specification", "metadata"), ("system overview", "metadata"))
ARTIFACTS, FEEDBACK_ACTIONS, STATUSES = ("spec", "test"), ("approve", "reject", "comment"), ("open", "applied", "closed", "stale")
GATE_ORDER = (1, 2, 4, 3, 5, 6, 7)
VERBS = ("GET", "POST", "PUT", "DELETE", "PATCH")
