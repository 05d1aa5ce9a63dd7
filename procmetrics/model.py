"""The record envelope and the identity of a series."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A datapoint: hot attributes are columns, so that filters on them reach the Parquet scan; the rest is a map.
DATAPOINT = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("host_name", T.StringType()),
        T.StructField("pid", T.LongType()),
        T.StructField("exe", T.StringType()),
        T.StructField("owner", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    ]
)

#: The same with the process's command line and its place in the process tree.
DATAPOINT_TREE = T.StructType([*DATAPOINT.fields[:-1], T.StructField("command_line", T.StringType()), T.StructField("parent_pid", T.LongType()), DATAPOINT.fields[-1]])

#: A pid is known by its host alone, so the host is part of the identity of a process and of a series.
PROCESS = ("host_name", "pid")
SERIES = ("host_name", "pid", "metric")
COUNTERS = ("process.cpu.time", "process.disk.io")
#: Disk I/O told apart by direction; each is a counter of its own.
DISK_IO = {"read": "process.disk.io.read", "write": "process.disk.io.write"}
ALL_COUNTERS = (*COUNTERS, *DISK_IO.values())

# The seven process metrics.
METRICS = (
    "process.cpu.time",
    "process.cpu.utilization",
    "process.memory.physical",
    "process.memory.virtual",
    "process.disk.io",
    "process.threads",
    "process.open_file_descriptors",
)

# Priority statements in their order; a later match wins, medium also asks for memory.
PRIORITY_RULES = (
    ("critical", "^(nginx|apache|haproxy|envoy)"),
    ("critical", "^(postgres|mysql|mongodb|redis|elasticsearch)"),
    ("critical", "^(kafka|rabbitmq|nats)"),
    ("critical", "^(kubelet|dockerd|containerd)"),
    ("high", "^(systemd|init|kernel)"),
    ("high", "^(sshd|chronyd|networkd)"),
    ("medium", "^(python|java|node|ruby|go)"),
)
MEDIUM_MEMORY = 100_000_000

# Category patterns in their order.
CATEGORY_RULES = (
    ("browsers", "^(chrome|firefox|safari|edge)"),
    ("dev_tools", "^(code|idea|eclipse|vim|emacs)"),
    ("communication", "^(slack|teams|zoom|discord)"),
    ("monitoring", "^(datadog|newrelic|prometheus)"),
    ("utilities", "^(grep|sed|awk|find|ls|ps)"),
)

CRITICAL = "|".join(p for level, p in PRIORITY_RULES if level == "critical")

PHASES = ("pending", "generating", "deploying", "running", "analyzing", "completed", "failed", "cancelled")


def series_id(name: str = "metric", labels: str = "attrs") -> Column:
    """64-bit identity of (name, label set); map entries are sorted, since the same map in two key orders is one series."""
    return F.xxhash64(F.col(name), F.array_sort(F.map_entries(labels)))


def bucket(ts: str | Column, seconds: int) -> Column:
    """Number of the time bucket of so many seconds since the epoch."""
    return F.floor(F.unix_seconds(F.col(ts) if isinstance(ts, str) else ts) / seconds)
