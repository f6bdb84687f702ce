"""Access, policies, audit, traces, health, overrides and the comparison of captures."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskwell.functions import words
from maskwell.functions.crypto import decrypt
from maskwell.operators.ordinal import with_ordinal

# Look-back of blocks, traces kept, failures until unhealthy, life of a probe, captures kept.
BLOCK_WINDOW = "15 minutes"
TRACES = 200
FAILURES = 3
PROBE_SECONDS = 5
CAPTURES = 200


def visible_workspaces(grants: DataFrame, workspaces: DataFrame, identity: Column) -> DataFrame:
    """Workspaces of an identity with its roles, sorted, and the display name."""
    mine = grants.where(F.col("identity") == identity).groupBy("workspace")
    roles = mine.agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))
    return roles.join(workspaces, "workspace", "left")


def has_role(rows: DataFrame, grants: DataFrame, role: str) -> DataFrame:
    """Rows whose ``identity`` holds ``role`` in their ``workspace``; roles have no hierarchy."""
    return rows.join(grants.where(F.col("role") == role).select("identity", "workspace").distinct(), ["identity", "workspace"], "left_semi")


def policies(workspaces: DataFrame, settings: DataFrame) -> DataFrame:
    """Flags of every workspace; defaults where nothing is set."""
    joined = workspaces.join(settings, "workspace", "left")
    deterministic = F.coalesce("deterministic_only", F.lit(False))
    return joined.select(
        "workspace",
        deterministic.alias("deterministic_only"),
        F.coalesce("phone_candidates_enabled", F.lit(True)).alias("phone_candidates_enabled"),
        (~deterministic).alias("fail_closed"),
    )


def reidentify(requests: DataFrame, grants: DataFrame, store: DataFrame, key: bytes, role: str = "re-identify") -> DataFrame:
    """``requests`` (``identity``, ``workspace``, ``surrogate``) with ``event`` and, where granted, ``real``."""
    allowed = grants.where(F.col("role") == role).select("identity", "workspace").distinct().withColumn("granted", F.lit(True))
    joined = requests.join(allowed, ["identity", "workspace"], "left").join(store, ["workspace", "surrogate"], "left")
    real = F.when(F.col("granted"), decrypt(F.col("ciphertext"), key, F.col("workspace")))
    event = F.when(F.col("granted").isNull(), "re-identify-denied").when(real.isNull(), "re-identify-failed").otherwise("re-identified")
    return joined.select(*requests.columns, real.alias("real"), event.alias("event"))


def audit(events: DataFrame, workspace: Column | None = None, kind: str | None = None, actor: Column | None = None, since: Column | None = None) -> DataFrame:
    """Audit rows with their ``kind``, by any of workspace, kind, actor and start (inclusive)."""
    rows = events.withColumn("kind", words.audit_kind(F.col("event")))
    if workspace is not None:
        rows = rows.where(F.col("workspace") == workspace)
    if kind is not None:
        rows = rows.where(F.col("kind") == kind)
    if actor is not None:
        rows = rows.where(F.col("identity") == actor)
    return rows if since is None else rows.where(F.col("ts") >= since)


def recent(rows: DataFrame, now: Column, window: str = BLOCK_WINDOW) -> DataFrame:
    """Rows of the last minutes, the border included."""
    return rows.where(F.col("ts") >= now - F.expr(f"INTERVAL {window}"))


def rolling_count(rows: DataFrame, key: str, seconds: int) -> DataFrame:
    """Number of rows of the same key in the seconds up to each row."""
    at = F.col("ts").cast("timestamp").cast("double")
    order = Window.partitionBy(key).orderBy(at).rangeBetween(-seconds, 0)
    return rows.withColumn("n_recent", F.count("*").over(order))


def last_per_key(rows: DataFrame, key: str, order: list[Column], n: int = TRACES) -> DataFrame:
    """The last ``n`` rows of each key: a ring buffer as a table."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def failure_runs(rows: DataFrame, key: str, order: list[str], ok: Column) -> DataFrame:
    """``rows`` with ``failures`` in a row so far and ``healthy``; a success starts again from 0."""
    by = Window.partitionBy(key).orderBy(*order)
    runs = rows.withColumn("_run", F.sum(F.when(ok, 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    failing = F.sum(F.when(ok, 0).otherwise(1)).over(Window.partitionBy(key, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return runs.withColumn("failures", failing).withColumn("healthy", F.col("failures") < FAILURES).drop("_run")


def probes(rows: DataFrame, key: str, seconds: int = PROBE_SECONDS) -> DataFrame:
    """Requests that really probe: the first, then each at least ``seconds`` after the last probe.

    A request that comes that long after the one before it probes for sure. So each key's time is
    cut into stretches without such a pause, by sums over slots of time rather than over
    requests, and the stretches are walked through apart from one another.
    """
    kind, clock = (rows.schema[c].dataType.simpleString() for c in (key, "ts"))
    width = seconds * 1_000_000
    times = rows.select(key, F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).where(F.col(key).isNotNull() & F.col("at").isNotNull())
    times = times.withColumn("slot", F.floor(F.col("at") / width))
    slots = times.groupBy(key, "slot").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    in_time = Window.partitionBy(key).orderBy("slot")
    fresh = F.coalesce(F.col("lo") - F.lag("hi").over(in_time) >= width, F.lit(True)).cast("int")
    slots = slots.withColumn("fresh", fresh).select(key, "slot", F.sum("fresh").over(in_time).alias("stretch"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_key, last = None, 0
        for batch in batches:
            keep = []
            for k, stretch, at in zip(batch[key].tolist(), batch["stretch"].tolist(), batch["at"].tolist(), strict=True):
                if (k, stretch) != last_key or at - last >= width:
                    last_key, last = (k, stretch), at
                    keep.append((k, at))
            yield pd.DataFrame(keep, columns=[key, "at"])

    walked = times.join(slots, [key, "slot"]).select(key, "stretch", "at").repartition(key, "stretch").sortWithinPartitions(key, "stretch", "at")
    taken = walked.mapInPandas(fold, f"{key} {kind}, at long")
    return taken.select(key, F.timestamp_micros("at").cast(clock).alias("probed_at"))


def overridden(exchanges: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """Exchanges that start inside a timed override of their workspace: ``start`` <= ts < ``end``."""
    o = overrides.select(F.col(key).alias("_k"), "start", "end")
    inside = (F.col(key) == F.col("_k")) & (F.col("ts") >= F.col("start")) & (F.col("ts") < F.col("end"))
    return exchanges.join(o, inside, "left_semi")


def evictable(captures: DataFrame, live: DataFrame, keep: int = CAPTURES) -> DataFrame:
    """Captures to delete: the oldest that are not live, until ``keep`` are left in all."""
    over = captures.agg(F.greatest(F.count("*") - keep, F.lit(0)).alias("over")).withColumn("_one", F.lit(0))
    idle = captures.select("capture_id", F.lit(0).alias("_one")).join(live, "capture_id", "left_anti")
    # One row is broadcast.
    ranked = with_ordinal(idle, ["_one"], ["capture_id"], "_n").join(F.broadcast(over), "_one")
    return ranked.where(F.col("_n") < F.col("over")).select("capture_id")


def compare(observed: DataFrame, reconstructed: DataFrame, graph: DataFrame) -> DataFrame:
    """Surrogates on one side only, with ``side`` and ``severity``.

    Both have ``capture_id``, ``surrogate``, ``real``. A real value of the graph is a defect,
    another real value or a reserved shape is expected, the rest is unknown. Captures without
    a reconstructed row cannot be compared and are left out.
    """
    able = reconstructed.select("capture_id").distinct()
    a = observed.join(able, "capture_id", "left_semi").select("capture_id", "surrogate", F.col("real").alias("a_real"), F.lit(True).alias("a"))
    b = reconstructed.select("capture_id", "surrogate", F.col("real").alias("b_real"), F.lit(True).alias("b"))
    one = a.join(b, ["capture_id", "surrogate"], "full_outer").where(F.col("a").isNull() | F.col("b").isNull())
    known = graph.select(F.col("real")).distinct().withColumn("known", F.lit(True))
    one = one.withColumn("real", F.coalesce("a_real", "b_real")).join(known, "real", "left")
    severity = (
        F.when(F.col("known"), "defect")
        .when(F.col("real").isNotNull(), "expected")
        .when(words.is_reserved_pii(F.col("surrogate")) | words.is_reserved_provisional(F.col("surrogate")), "expected")
        .otherwise("unknown")
    )
    side = F.when(F.col("a").isNotNull(), "observed").otherwise("reconstructed")
    return one.select("capture_id", "surrogate", side.alias("side"), severity.alias("severity"))


def lifecycle(surrogates: DataFrame, inbox: DataFrame, mapping: DataFrame) -> DataFrame:
    """``surrogates`` with ``state``: pending in the inbox, confirmed in the mapping, else rejected."""
    pending = inbox.select("surrogate").distinct().withColumn("_p", F.lit(True))
    confirmed = mapping.select("surrogate").distinct().withColumn("_c", F.lit(True))
    joined = surrogates.join(pending, "surrogate", "left").join(confirmed, "surrogate", "left")
    return joined.select(*surrogates.columns, F.when(F.col("_p"), "pending").when(F.col("_c"), "confirmed").otherwise("rejected").alias("state"))


def trace_roll_up(hops: DataFrame, key: str) -> DataFrame:
    """Per exchange: first provider, total time, number of hops and detections, outcome of the last hop."""
    return hops.groupBy(key).agg(
        F.min_by("provider", F.when(F.col("provider").isNotNull(), F.col("hop_index"))).alias("provider"),
        F.sum("duration_ms").alias("duration_ms"),
        F.count("*").alias("n_hops"),
        F.sum("detected").alias("detected"),
        F.max_by("outcome", "hop_index").alias("outcome"),
    )


def upstream_error(status: Column, error_class: Column) -> Column:
    """What a client sees of an upstream error: time-outs are 504, all else 502."""
    return F.struct(
        F.when(error_class == "timeout", 504).otherwise(502).alias("status"),
        F.when(error_class == "timeout", "timeout").when(status.isNotNull(), "http_status").otherwise("connection").alias("sub_reason"),
    )


def outcome(status: Column) -> Column:
    return F.when(status == 200, "passed").when(status == 503, "blocked").otherwise("upstream_error")


def dependency_state(rows: DataFrame, key: str, healthy: Column) -> DataFrame:
    """Protected if every dependency is healthy, else degraded."""
    return rows.groupBy(key).agg(F.when(F.bool_and(healthy), "protected").otherwise("degraded").alias("state"))
