"""These must equal the services' own lists, prices and limits for right results."""

# Regions listed by the account-wide commands.
REGIONS = [
    "us-east-1",
    "us-east-2",
    "us-west-1",
    "us-west-2",
    "ap-south-1",
    "ap-northeast-1",
    "ap-northeast-2",
    "ap-southeast-1",
    "ap-southeast-2",
    "ca-central-1",
    "eu-central-1",
    "eu-west-1",
    "eu-west-2",
    "eu-west-3",
    "eu-north-1",
    "sa-east-1",
]

# Regions visited by the inventory scan.
SCAN_REGIONS = [
    "us-east-1",
    "us-east-2",
    "us-west-1",
    "us-west-2",
    "eu-central-1",
    "eu-west-1",
    "eu-west-2",
]

# Stack states from which a stack can be deleted.
DELETABLE_STACK_STATUS = [
    "CREATE_FAILED",
    "CREATE_COMPLETE",
    "ROLLBACK_FAILED",
    "ROLLBACK_COMPLETE",
    "DELETE_FAILED",
    "UPDATE_COMPLETE",
    "UPDATE_ROLLBACK_FAILED",
    "UPDATE_ROLLBACK_COMPLETE",
    "IMPORT_COMPLETE",
    "IMPORT_ROLLBACK_FAILED",
    "IMPORT_ROLLBACK_COMPLETE",
]

# Function prices, per request and per started 100 ms at 128 MB.
COST_PER_REQUEST = 0.0000002
COST_PER_100MS = 0.000000208

# Shard limits per second.
SHARD_WRITE_RECORDS = 1000
SHARD_WRITE_BYTES = 1024 * 1024
SHARD_READ_RECORDS = 2000
SHARD_READ_BYTES = 2048 * 1024

# Queue batch limits; the byte sum must stay below the limit.
BATCH_MAX_MESSAGES = 10
BATCH_MAX_BYTES = 256 * 1024

# Text that marks a cold start, in any case, and the log line patterns.
COLD_START_TEXT = "init duration"
INIT_DURATION_PATTERN = r"^REPORT.*Init Duration: (.*) ms.*"
DURATION_PATTERN = r"^REPORT.*?\bDuration: ([0-9.]+) ms"
LOG_FUNCTION_PATTERN = r"^.*/aws/lambda/(.*)"

# Metric names and statistics per shard.
SHARD_METRICS = [
    ("IncomingBytes", "Average"),
    ("IncomingRecords", "Average"),
    ("OutgoingRecords", "Average"),
    ("OutgoingBytes", "Average"),
    ("ReadProvisionedThroughputExceeded", "Sum"),
    ("WriteProvisionedThroughputExceeded", "Sum"),
    ("IteratorAgeMilliseconds", "Average"),
]

# Metric names per stream, all summed.
STREAM_METRICS = ["IncomingBytes", "IncomingRecords", "GetRecords.Bytes", "GetRecords.Records"]

# Capacity metrics per table and their statistic.
TABLE_METRICS = [
    ("ConsumedReadCapacityUnits", "Sum"),
    ("ConsumedWriteCapacityUnits", "Sum"),
    ("ProvisionedReadCapacityUnits", "Average"),
    ("ProvisionedWriteCapacityUnits", "Average"),
]

# Tag and output keys set by deployments.
VERSION_TAG = "serverlessrepo:semanticVersion"
DEPLOYMENT_BUCKET_OUTPUT = "ServerlessDeploymentBucketName"
STATE_MACHINE_OUTPUT = "StateMachineARN"
BUCKET_RESOURCE_TYPE = "AWS::S3::Bucket"
SERVICE_ROLE_PATH = "/aws-service-role/"

# Runtimes flagged as reaching end of life.
DEPRECATED_RUNTIMES = ["nodejs8.10"]
