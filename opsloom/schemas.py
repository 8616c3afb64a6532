"""Schemas of the landed tables and of the JSON envelopes."""

FUNCTIONS = (
    "region STRING, function_name STRING, runtime STRING, memory_size INT, "
    "code_size BIGINT, last_modified TIMESTAMP, timeout INT"
)
LOGS = (
    "region STRING, log STRING, log_stream STRING, ts TIMESTAMP, message STRING, "
    "memory_bytes BIGINT"
)
METRICS = "region STRING, namespace STRING, metric STRING, dims MAP<STRING,STRING>, ts TIMESTAMP, value DOUBLE"
SERIES = "label STRING, timestamps ARRAY<TIMESTAMP>, values ARRAY<DOUBLE>"
STREAMS = (
    "region STRING, stream_name STRING, arn STRING, status STRING, "
    "shards ARRAY<STRUCT<shard_id: STRING>>, shard_level_metrics ARRAY<STRING>"
)
PC_CONFIGS = "region STRING, function_name STRING, function_arn STRING, allocated BIGINT"
STREAM_RECORDS = "shard_id STRING, sequence_number STRING, data STRING"
ATTRIBUTES = "MAP<STRING, STRUCT<data_type: STRING, string_value: STRING, binary_value: BINARY>>"
MESSAGES = (
    "message_id STRING, receipt_handle STRING, body STRING, "
    f"attributes {ATTRIBUTES}, received_at TIMESTAMP"
)
RESOURCES = (
    "type STRING, region STRING, id STRING, name STRING, arn STRING, status STRING, "
    "parent STRING, path STRING, bytes BIGINT"
)
RESULTS = "type STRING, name STRING, region STRING, status STRING, reason STRING, attempt INT"
VERSIONS = "app STRING, version STRING"
STACKS = (
    "region STRING, stack STRING, status STRING, tags MAP<STRING,STRING>, "
    "outputs MAP<STRING,STRING>"
)
STACK_RESOURCES = "region STRING, stack STRING, resource_type STRING, physical_id STRING"

# Bodies of envelopes: the field names are those of the JSON text.
TOPIC_ENVELOPE = (
    "Subject STRING, Timestamp STRING, Message STRING, "
    "MessageAttributes MAP<STRING, STRUCT<Type: STRING, Value: STRING>>"
)
EVENT_ENVELOPE = (
    "region STRING, source STRING, time STRING, resources ARRAY<STRING>, "
    "`detail-type` STRING, detail STRING"
)
CHANGE_RECORD = (
    "eventID STRING, eventName STRING, eventSource STRING, "
    "dynamodb STRUCT<ApproximateCreationDateTime: STRING, "
    "Keys: MAP<STRING, MAP<STRING, STRING>>, NewImage: MAP<STRING, MAP<STRING, STRING>>, "
    "OldImage: MAP<STRING, MAP<STRING, STRING>>, SequenceNumber: STRING, SizeBytes: BIGINT, "
    "StreamViewType: STRING>"
)
