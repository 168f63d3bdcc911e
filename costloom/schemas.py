"""Table and wire schemas (DDL strings, parsed by Spark)."""

OTLP_VALUE = "struct<stringValue:string,intValue:string,doubleValue:string>"
OTLP_ATTRS = f"array<struct<key:string,value:{OTLP_VALUE}>>"
# intValue/doubleValue are declared as strings so that both 5 and "5" parse.
OTLP_TRACE = (
    "resourceSpans array<struct<"
    f"resource:struct<attributes:{OTLP_ATTRS}>,"
    "scopeSpans:array<struct<spans:array<struct<"
    "name:string,startTimeUnixNano:string,endTimeUnixNano:string,"
    f"attributes:{OTLP_ATTRS}>>>>>>"
)
OTLP_LOGS = f"resourceLogs array<struct<resource:struct<attributes:{OTLP_ATTRS}>>>"

USAGE = (
    "struct<input_tokens:bigint,cache_read_input_tokens:bigint,"
    "cache_creation_input_tokens:bigint,output_tokens:bigint>"
)
LEDGER = (
    "ts string, handle string, persona string, model string, status string, session_id string, "
    "cost_usd string, duration_s double, hit_tokens bigint, miss_tokens bigint, "
    "output_tokens bigint, peak boolean"
)
RUN_LOG = (
    "type string, started double, handle string, persona string, session_id string, "
    f"is_error boolean, stop_reason string, usage {USAGE}"
)
TRANSCRIPT = (
    "type string, timestamp string, sessionId string, message string"
)
TRANSCRIPT_MESSAGE = f"role string, model string, content string, usage {USAGE}"
CONTENT_BLOCK = "type string, text string, name string"
USAGE_RING = (
    "record_type string, seq int, ts string, session_id string, handle string, model string, "
    f"usage {USAGE}, cost_usd string"
)

MONEY = "decimal(20,10)"

RUNS = (
    "id string, session_id string, agent_id string, source string, external_id string, "
    "parent_run_id string, workspace string, persona string, model_slug string, service string, "
    "status string, pricing_status string, started_at timestamp, ended_at timestamp, "
    "input_tokens bigint, cache_read_tokens bigint, cache_write_tokens bigint, output_tokens bigint, "
    f"cost_usd {MONEY}, reported_cost_usd {MONEY}, price_multiplier decimal(6,3), version int"
)
MESSAGES = (
    "id string, run_id string, sequence int, role string, content string, tool_name string, "
    "model_slug string, input_tokens bigint, cache_read_tokens bigint, cache_write_tokens bigint, "
    f"output_tokens bigint, cost_usd {MONEY}, occurred_at timestamp, version int"
)
FINDINGS = (
    "id string, run_id string, kind string, severity string, evidence string, evidence_hash string, "
    f"wasted_cost_usd {MONEY}, detected_at timestamp, acknowledged_at timestamp, version int"
)
AGGREGATE = (
    "bucket_day date, model_slug string, service string, run_count bigint, priced_run_count bigint, "
    "message_count bigint, input_tokens bigint, cache_read_tokens bigint, cache_write_tokens bigint, "
    f"output_tokens bigint, cost_usd {MONEY}"
)
PRICES = (
    f"slug string, service string, input_per_mtok {MONEY}, cache_read_per_mtok {MONEY}, "
    f"cache_write_per_mtok {MONEY}, output_per_mtok {MONEY}, context_window int, "
    "effective_from timestamp, effective_to timestamp"
)
ALIASES = "alias string, service string, slug string"


def columns(ddl: str) -> list[str]:
    """Top-level column names of a flat DDL string, in order."""
    depth, names, field = 0, [], ""
    for ch in ddl + ",":
        depth += ch in "(<"
        depth -= ch in ")>"
        if ch == "," and depth == 0:
            names.append(field.split()[0])
            field = ""
        else:
            field += ch
    return names
