"""Reading and writing datapoints, tables and label sets."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procmetrics.functions import full_match, label_name, pick
from procmetrics.model import DATAPOINT, PROCESS, bucket


def read_datapoints(spark: SparkSession, path: str, schema: T.StructType = DATAPOINT, fmt: str = "parquet") -> DataFrame:
    """Datapoints in the fixed envelope; the schema is given, so nothing is inferred and unread columns are never decoded."""
    return spark.read.schema(schema).format(fmt).load(path)


def _name_test(column: str, names: Sequence[str], match_type: str) -> Column:
    if match_type == "strict":
        return F.col(column).isin(list(names))
    inner = [re.sub(r"^\(\?s:(.*)\)\\[zZ]$", r"\1", fnmatch.translate(n)) if match_type == "glob" else n for n in names]
    patterns = [f"^(?:{p})$" for p in inner]
    return F.coalesce(F.col(column).rlike("|".join(patterns)), F.lit(False))


def scrape_select(df: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), match_type: str = "regexp", column: str = "exe") -> DataFrame:
    """Processes whose name is included and not excluded; strict names are pushed to the scan. Without includes all are in."""
    if match_type not in ("regexp", "strict", "glob"):
        raise ValueError(match_type)
    if include:
        df = df.where(_name_test(column, include, match_type))
    if exclude:
        df = df.where(~F.coalesce(_name_test(column, exclude, match_type), F.lit(False)))
    return df


def select_metrics(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.where(F.col("metric").isin(list(names)))


def read_table(spark: SparkSession, path: str, name: str, jdbc: Mapping[str, str] | None = None) -> DataFrame:
    """A control-plane table, from Parquet or, with options, over JDBC."""
    if jdbc:
        return spark.read.format("jdbc").options(dbtable=name, **jdbc).load()
    return spark.read.parquet(f"{path}/{name}.parquet")


def parse_json_cols(df: DataFrame, schemas: Mapping[str, str]) -> DataFrame:
    return df.withColumns({c: F.from_json(F.col(c), s) for c, s in schemas.items()})


def _without(labels: Column, key: Column) -> Column:
    return F.map_filter(labels, lambda k, _: k != key)


def _outside(labels: Column, others: Column) -> Column:
    return F.map_filter(labels, lambda k, _: ~F.map_contains_key(others, k))


def relabel(df: DataFrame, rules: Sequence[Mapping], labels: str = "labels") -> DataFrame:
    """Applies keep, drop, replace and labelmap rules in order to a label map.

    keep and drop match the ';'-joined sources whole; replace writes target from the pattern's groups ($1, $2, also joined) where
    the sources match; labelmap renames matching keys to their first group, the renamed key winning over one there.
    """
    for rule in rules:
        action, regex = rule.get("action", "replace"), rule.get("regex", "(.*)")
        col = F.col(labels)
        source = F.concat_ws(";", *[F.coalesce(pick(col, s), F.lit("")) for s in rule.get("source", ())])
        if action in ("keep", "drop"):
            test = full_match(source, regex)
            df = df.where(test if action == "keep" else ~test)
        elif action == "replace":
            value = F.regexp_replace(source, f"^(?:{regex})$", rule.get("replacement", "$1"))
            others = _without(col, F.lit(rule["target"]))
            df = df.withColumn(labels, F.when(full_match(source, regex), F.map_concat(others, F.create_map(F.lit(rule["target"]), value))).otherwise(col))
        elif action == "labelmap":
            whole = f"^(?:{regex})$"
            renamed = F.transform_keys(F.map_filter(col, lambda k, _: k.rlike(whole)), lambda k, _: F.regexp_replace(k, whole, "$1"))
            df = df.withColumn(labels, F.map_concat(_outside(col, renamed), renamed))
        else:
            raise ValueError(action)
    return df


def parse_exposition(lines: DataFrame, column: str = "value") -> DataFrame:
    """(metric, labels, value) of exposition lines; comments and blank lines give none.

    Label values stand in quotes and may hold commas, braces and spaces; \\", \\\\ and \\n in them are escapes. Of a repeated label the first holds.
    """
    line = F.trim(F.col(column))
    rows = lines.where(~line.startswith("#") & (line != ""))
    label = r'([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*"([^"\\]*+(?:\\.[^"\\]*+)*+)"'
    pattern = rf"^([a-zA-Z_:][a-zA-Z0-9_:]*)\s*(?:\{{((?:\s*{label}\s*,?)*)\s*\}})?\s*(?<=[\s}}])(\S+)"
    body = F.regexp_extract(line, pattern, 2)
    keys, written = (F.regexp_extract_all(body, F.lit(label), F.lit(g)) for g in (1, 2))
    escapes = (("\\\\", "\0"), ('\\"', '"'), ("\\n", "\n"), ("\0", "\\"))  # no label value holds a zero byte

    def plain(v: Column) -> Column:
        for old, new in escapes:
            v = F.replace(v, F.lit(old), F.lit(new))
        return v

    entries = F.transform(keys, lambda k, i: F.struct(k.alias("k"), plain(F.get(written, i)).alias("v"), (F.array_position(keys, k) == i + 1).alias("first")))
    labels = F.map_from_entries(F.transform(F.filter(entries, lambda e: e["first"]), lambda e: F.struct(e["k"], e["v"])))
    return rows.select(F.regexp_extract(line, pattern, 1).alias("metric"), labels.alias("labels"), F.regexp_extract(line, pattern, 5).try_cast("double").alias("value")).where(F.col("metric") != "")


def read_exposition(spark: SparkSession, path: str) -> DataFrame:
    return parse_exposition(spark.read.text(path))


def read_hosts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_datapoints(df: DataFrame, path: str, mode: str = "append", ts: str = "ts", writers: int = 8) -> None:
    """Compressed Parquet by variant and date, rows of a date together, so that few files are made and dates prune.

    writers is how many tasks, and so files, a variant and date are spread over: about their size by that of a file.
    """
    dated = df.withColumn("date", F.to_date(ts))
    spread = F.pmod(F.xxhash64(*[f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]), F.lit(writers))  # the same when a task runs again
    dated.repartition("variant", "date", spread).write.mode(mode).partitionBy("variant", "date").option("compression", "gzip").parquet(path)


def to_prometheus(df: DataFrame, namespace: str = "", const_labels: Mapping[str, str] | None = None, resource: Sequence[str] = ("host_name",), labels: str = "attrs") -> DataFrame:
    """(name, labels, value, ts): dots to underscores, a namespace in front, resource columns and constant labels merged into the labels.

    On equal keys resource columns win over attributes and constants over both.
    """
    name = F.concat(F.lit(f"{namespace}_" if namespace else ""), label_name("metric"))
    extra = {**{r: F.col(r).cast("string") for r in resource}, **{k: F.lit(v) for k, v in (const_labels or {}).items()}}
    added = F.map_from_arrays(F.array(*[F.lit(k) for k in extra]), F.array(*extra.values()))
    own = F.transform_keys(F.coalesce(F.col(labels), F.create_map().cast("map<string,string>")), lambda k, _: label_name(k))
    merged = F.map_concat(F.map_filter(own, lambda k, _: ~k.isin(list(extra))), F.map_filter(added, lambda _, v: v.isNotNull()))
    return df.select(name.alias("name"), merged.alias("labels"), "value", "ts")


def benchmarks_to_series(df: DataFrame, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Long (ids, metric, value) rows of wide result rows."""
    return df.select(*ids, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(list(ids), list(values), "metric", "value")


def sample_initial_thereafter(df: DataFrame, keys: Sequence[str], first: int, then: int, seconds: int, order: Sequence[str]) -> DataFrame:
    """Of each key and interval the first rows, then every then-th."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(*keys, bucket("ts", seconds)).orderBy(*order))
    return df.withColumn("_n", n).where((F.col("_n") <= first) | ((F.col("_n") - first) % then == 0)).drop("_n")


def with_month_key(df: DataFrame, column: str, name: str = "month_key") -> DataFrame:
    """year*100+month, a partition key."""
    return df.withColumn(name, F.year(column) * 100 + F.month(column))


def write_log(df: DataFrame, column: str, path: str, mode: str = "append") -> None:
    with_month_key(df, column).write.mode(mode).partitionBy("month_key").parquet(path)


# Vendor names of metrics and attributes.
VENDOR_METRICS = {"process.cpu.utilization": "cpuPercent", "process.memory.physical": "memoryResidentSizeBytes", "process.disk.io": "ioBytesPerSecond"}
VENDOR_ATTRIBUTES = {"exe": "processDisplayName", "host_name": "hostname", "pid": "processId"}


def to_vendor_schema(df: DataFrame, seconds: int) -> DataFrame:
    """One row per process and bucket: gauges averaged, I/O deltas over the bucket's seconds."""
    wide = df.withColumn("bucket", bucket("ts", seconds)).groupBy(*VENDOR_ATTRIBUTES, "bucket")
    own = lambda m: F.when(F.col("metric") == m, F.col("value"))
    out = wide.agg(*[(F.sum(own(m)) / seconds if "io" in n else F.avg(own(m))).alias(n) for m, n in VENDOR_METRICS.items()])
    return out.withColumnsRenamed(VENDOR_ATTRIBUTES)


# The vendor's names of an entity's attributes and metrics in full.
VENDOR_ENTITY = {"exe": "processDisplayName", "command_line": "commandLine", "host_name": "hostname", "pid": "processId", "parent_pid": "parentProcessId"}
VENDOR_GAUGES = {"process.cpu.utilization": "cpuPercent", "process.memory.physical": "memoryResidentSizeBytes"}
VENDOR_RATES = {"process.disk.io.read": "ioReadBytesPerSecond", "process.disk.io.write": "ioWriteBytesPerSecond"}


def to_vendor_entities(df: DataFrame, seconds: int) -> DataFrame:
    """One row per process and bucket, of deltas with disk I/O told apart by direction (split_metric before cumulative_to_delta).

    Gauges are averaged, I/O is bytes over the bucket's seconds. Name, command line and parent are those of the process's last point in the
    bucket, so one that changes them stays one entity. What has no point in the bucket is null.
    """
    own = lambda m: F.when(F.col("metric") == m, F.col("value"))
    facts = [c for c in VENDOR_ENTITY if c not in PROCESS]
    order = F.struct(*[c for c in ("ts", "point_id") if c in df.columns])
    values = [F.avg(own(m)).alias(n) for m, n in VENDOR_GAUGES.items()] + [(F.sum(own(m)) / seconds).alias(n) for m, n in VENDOR_RATES.items()]
    out = df.groupBy(*PROCESS, bucket("ts", seconds).alias("bucket")).agg(F.max_by(F.struct(*facts), order).alias("_last"), *values)
    return out.select(*[(F.col("_last")[c] if c in facts else F.col(c)).alias(n) for c, n in VENDOR_ENTITY.items()], "bucket", *VENDOR_GAUGES.values(), *VENDOR_RATES.values())


def parse_variant(df: DataFrame, column: str, fields: Mapping[str, tuple[str, str]], rest: str | None = None) -> DataFrame:
    """Fields (name: path and type) of a column of JSON of any shape, each null where the path is absent or of another type.

    The text is parsed once, to a variant; text that doesn't begin with a JSON value counts as null. rest keeps the variant itself under that name.
    """
    out = df.withColumn("_variant", F.try_parse_json(column))
    out = out.withColumns({name: F.try_variant_get("_variant", path, kind) for name, (path, kind) in fields.items()})
    return out.withColumnRenamed("_variant", rest) if rest else out.drop("_variant")


def variant_fields(df: DataFrame, column: str) -> DataFrame:
    """(key, kind, n): which keys the objects of a JSON column have, of which types, and how often. Arrays, scalars and bad JSON have none."""
    parsed = df.select(F.try_parse_json(column).alias("_v"))
    fields = parsed.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_v").outer())).where(F.col("key").isNotNull())
    return fields.groupBy("key", F.schema_of_variant("value").alias("kind")).agg(F.count("*").alias("n"))


def stream_datapoints(spark: SparkSession, path: str, schema: T.StructType = DATAPOINT, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
