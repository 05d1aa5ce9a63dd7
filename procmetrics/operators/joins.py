"""Joins: vector matching, as-of, interval and set joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procmetrics.operators.ranking import latest_by
from procmetrics.operators.transforms import small
from procmetrics.sources.stored import shared_folder


def vector_match(left: DataFrame, right: DataFrame, on: Sequence[str] | None = None, ignoring: Sequence[str] = ("variant",), how: str = "inner", fill: float | None = None, value: str = "value") -> DataFrame:
    """(labels, left_value, right_value) of series that agree on the labels named, or on all common labels but those ignored."""
    keys = list(on) if on else [c for c in left.columns if c in right.columns and c != value and c not in ignoring]
    a = left.select(*keys, F.col(value).alias("left_value"))
    out = a.join(right.select(*keys, F.col(value).alias("right_value")), keys, how)
    return out if fill is None else out.fillna(fill, ["left_value", "right_value"])


def asof_eval(samples: DataFrame, keys: Sequence[str], start: str, end: str, step: int, lookback: int, value: str = "value") -> DataFrame:
    """(keys, step, value): at each step the latest sample at or before it, not older than the lookback (all in seconds).

    A sample holds for the steps from its own time on until the next sample of its series or the end of the lookback; so each row
    that is made is a row of the result, and no range join is needed. Of samples of one second the smallest value holds.
    """
    origin, last = (F.unix_seconds(F.lit(x).cast("timestamp")) for x in (start, end))
    second = samples.select(*keys, F.unix_seconds("ts").alias("at"), F.col(value).alias("value"))
    following = F.lead("at").over(Window.partitionBy(*keys).orderBy("at", F.desc_nulls_last("value")))
    first = origin + F.ceil(F.greatest(F.col("at") - origin, F.lit(0)) / step) * step
    until = F.least(F.col("at") + lookback, last, F.coalesce(F.col("next_at") - 1, last))
    held = second.withColumn("next_at", following).withColumns({"_first": first, "_until": until}).where("_first <= _until")
    return held.select(*keys, F.explode(F.sequence("_first", "_until", F.lit(step).cast("long"))).alias("step"), "value")


def match_patterns(df: DataFrame, patterns: DataFrame, name: str = "exe", pattern: str = "pattern") -> DataFrame:
    """Rows beside every pattern that their name matches. Distinct names meet the patterns, a list of bounded size, once."""
    names = df.select(F.col(name).alias("_name")).distinct()
    hits = names.join(small(patterns), F.expr(f"_name rlike {pattern}"))
    return df.join(hits, df[name] == hits._name).drop("_name")


#: Prefixes of patterns are compared up to this length.
PREFIX = 16
_LITERAL = "[A-Za-z0-9_#@/ -]"


def pattern_prefixes(patterns: DataFrame, pattern: str = "pattern") -> DataFrame:
    """(pattern, prefix) for every literal beginning that a match of the pattern must have; one row of a null prefix where none is known.

    ^abc[0-9] begins with abc, ^abc* with ab, ^(abc|de).* with abc or de. A pattern that isn't anchored, or that has other alternatives, may
    begin with anything.
    """
    p = F.col(pattern)
    run = F.regexp_extract(p, rf"^\^({_LITERAL}+)", 1)
    optional = F.regexp_extract(p, rf"^\^{_LITERAL}+([*?{{])", 1) != ""
    run = F.when(optional, F.substring(run, F.lit(1), F.length(run) - 1)).otherwise(run)
    either = F.regexp_extract(p, rf"^\^\(({_LITERAL}+(?:\|{_LITERAL}+)*)\)(?![*?{{])[^|]*$", 1)
    found = F.when(either != "", F.split(either, r"\|")).when(~p.contains("|") & (run != ""), F.array(run))
    cut = F.array_distinct(F.transform(found, lambda x: F.substring(x, 1, PREFIX)))
    return patterns.select(p.alias("pattern"), F.explode_outer(cut).alias("prefix")).distinct()


def match_indexed(df: DataFrame, patterns: DataFrame, name: str = "exe", pattern: str = "pattern") -> DataFrame:
    """Rows beside every pattern that their name matches, for many patterns.

    Patterns are indexed by their literal beginnings; a distinct name asks for its own beginnings, of the lengths that occur, by
    equality, and only pairs that meet so are tried. Patterns without a literal beginning, which should be few, are tried with every name.
    Null names and patterns match nothing; repeated rows stay repeated, repeated patterns count once.
    """
    index = pattern_prefixes(patterns.where(F.col(pattern).isNotNull()), pattern)
    keyed = index.where(F.col("prefix").isNotNull())
    lengths = keyed.agg(F.collect_set(F.length("prefix")).alias("_lengths"))  # PREFIX at most
    names = df.select(F.col(name).alias("_name")).where(F.col("_name").isNotNull()).distinct()
    asked = names.crossJoin(F.broadcast(lengths)).select("_name", F.explode(F.expr("transform(filter(_lengths, n -> n <= length(_name)), n -> substring(_name, 1, n))")).alias("prefix"))
    hits = asked.join(keyed, "prefix").select("_name", "pattern").distinct().where("_name rlike pattern")
    others = names.join(small(index.where(F.col("prefix").isNull()).select("pattern")), F.expr("_name rlike pattern"))
    hits = hits.unionByName(others)
    return df.join(hits, df[name] == hits._name).drop("_name")


def attribute_to_experiment(df: DataFrame, experiments: DataFrame, key: str = "host_name", slot: int = 86400) -> DataFrame:
    """Datapoints beside the experiments active on their host at that time; an open experiment has no end.

    Host and slot of time (so many seconds) are the join key: an experiment stands in each slot that it touches, from the first to the
    last that has any datapoint, so few points meet experiments of other times.
    """
    number = lambda at: F.floor(F.unix_micros(at) / (slot * 1_000_000))
    reach = df.agg(F.min(number("ts")).alias("_from"), F.max(number("ts")).alias("_to"))  # one row
    e = experiments.select(F.col("id").alias("experiment_id"), F.col(key).alias("_key"), "started_at", "completed_at").crossJoin(F.broadcast(reach))
    begin, end = F.greatest(number("started_at"), "_from"), F.least(F.coalesce(number("completed_at"), F.col("_to")), F.col("_to"))
    slots = e.withColumns({"_begin": begin, "_end": end}).where("_begin <= _end").withColumn("_slot", F.explode(F.sequence("_begin", "_end")))
    active = (F.col("ts") >= F.col("started_at")) & (F.col("completed_at").isNull() | (F.col("ts") <= F.col("completed_at")))
    met = df.withColumn("_at", number("ts")).join(slots, (df[key] == F.col("_key")) & (F.col("_at") == F.col("_slot")) & active)
    return met.drop("_key", "_at", "_slot", "_begin", "_end", "_from", "_to", "started_at", "completed_at")


def _covering(begin: Column, end: Column, levels: int) -> Column:
    """The fewest aligned blocks (level, number) that make up the whole numbers from begin to before end: two of each level at most. A block of level k has 2^k numbers."""

    def at(k: Column) -> Column:
        width = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        first, stop = (F.call_function("shiftright", x, k) for x in (begin + width - 1, end))
        block = lambda number: F.struct(k.alias("level"), number.alias("number"))
        low, high = F.when((first < stop) & (first % 2 == 1), block(first)), F.when((first < stop) & (stop % 2 == 1), block(stop - 1))
        return F.array_distinct(F.array_compact(F.array(low, high)))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), at))


def summarize_active(df: DataFrame, experiments: DataFrame, keys: Sequence[str] = ("point_id",), key: str = "host_name") -> DataFrame:
    """(keys, n, first_id, last_id): how many experiments are active on the host of a datapoint at its time, and the least and greatest id of them; datapoints without any give no row.

    What attribute_to_experiment counts, without its pairs, which are points times experiments where many are active at once. An experiment
    stands for its time in two aligned blocks of each power of two at most, counted from the first datapoint in microseconds; blocks are
    summed up over experiments, and a datapoint asks for the one block of each level that holds it. So work is in proportion to
    experiments and datapoints, whatever overlaps.
    """
    reach = df.agg(F.min(F.unix_micros("ts")).alias("_from"), F.max(F.unix_micros("ts")).alias("_to"))  # one row
    spans = experiments.where(F.col("started_at").isNotNull()).groupBy(F.col(key).alias("_key"), "started_at", "completed_at")
    spans = spans.agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).crossJoin(F.broadcast(reach))
    begin, end = F.greatest(F.unix_micros("started_at"), "_from"), F.least(F.coalesce(F.unix_micros("completed_at"), F.col("_to")), F.col("_to"))
    spans = spans.select("_key", "n", "first_id", "last_id", (begin - F.col("_from")).alias("_begin"), (end - F.col("_from") + 1).alias("_end")).where("_begin < _end")
    merge = (F.sum("n").alias("n"), F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"))
    blocks = spans.groupBy("_key", "_begin", "_end").agg(*merge).withColumn("_block", F.explode(_covering(F.col("_begin"), F.col("_end"), 62)))
    path = shared_folder(df.sparkSession, "blocks")
    blocks.groupBy("_key", F.col("_block.level").alias("_level"), F.col("_block.number").alias("_number")).agg(*merge).write.parquet(path)
    blocks = df.sparkSession.read.parquet(path)
    levels = blocks.agg(F.collect_set("_level").alias("_levels"))  # 62 at most
    at = F.unix_micros("ts") - F.col("_from")
    asked = df.select(*keys, F.col(key).alias("_own"), "ts").crossJoin(F.broadcast(reach)).crossJoin(F.broadcast(levels))
    asked = asked.select(*keys, "_own", at.alias("_at"), F.explode("_levels").alias("_asked")).withColumn("_place", F.expr("shiftright(_at, _asked)"))
    met = asked.join(small(blocks), (F.col("_own") == F.col("_key")) & (F.col("_asked") == F.col("_level")) & (F.col("_place") == F.col("_number")))
    return met.groupBy(*keys).agg(*merge)


def critical_kept(baseline: DataFrame, candidate: DataFrame, keys: Sequence[str]) -> DataFrame:
    return baseline.select(*keys).distinct().join(candidate.select(*keys), list(keys), "left_semi")


def critical_lost(baseline: DataFrame, candidate: DataFrame, keys: Sequence[str]) -> DataFrame:
    return baseline.select(*keys).distinct().join(candidate.select(*keys), list(keys), "left_anti")


def purge_children(children: DataFrame, experiments: DataFrame, key: str = "experiment_id", orphans: bool = False) -> DataFrame:
    """Children whose experiment is there; or those whose experiment is gone."""
    return children.join(experiments.select(F.col("id").alias(key)), key, "left_anti" if orphans else "left_semi")


def experiment_detail(experiments: DataFrame, events: DataFrame) -> DataFrame:
    """Each experiment with its number of events, and first and last event times; none counts as 0."""
    per = events.groupBy("experiment_id").agg(F.count("*").alias("n_events"), F.min("created_at").alias("first_event"), F.max("created_at").alias("last_event"))
    return experiments.join(per, experiments.id == per.experiment_id, "left").drop("experiment_id").fillna(0, ["n_events"])


def compare_variants(df: DataFrame, by: Sequence[str], metrics: dict[str, Column]) -> DataFrame:
    """baseline and candidate of every metric side by side, with difference and percentage."""
    side = {f"{v}_{n}": F.when(F.col("variant") == v, x) for n, x in metrics.items() for v in ("baseline", "candidate")}
    out = df.groupBy(*by, "variant").agg(*[x.alias(n) for n, x in metrics.items()]).groupBy(*by).agg(*[F.first(F.when(F.col("variant") == k.split("_", 1)[0], F.col(k.split("_", 1)[1])), True).alias(k) for k in side])
    for n in metrics:
        delta = F.coalesce(f"candidate_{n}", F.lit(0)) - F.coalesce(f"baseline_{n}", F.lit(0))
        out = out.withColumns({f"delta_{n}": delta, f"percent_{n}": F.try_divide(delta * 100.0, F.col(f"baseline_{n}"))})
    return out


def apply_updates(experiments: DataFrame, updates: DataFrame) -> DataFrame:
    """Experiments with the newest update's status and time; rows without updates as they are. Of updates of one time and seq that of the greatest status counts."""
    newest = latest_by(updates, ["id"], ["updated_at", "seq", "status"]).select("id", F.col("status").alias("_status"), F.col("updated_at").alias("_at"))
    out = experiments.join(newest, "id", "left").withColumns({"status": F.coalesce("_status", "status"), "updated_at": F.coalesce("_at", "updated_at")})
    return out.drop("_status", "_at")

