"""Requests, routing, monitoring and key management as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dims import LATENCY_BOUNDS

MB = 1024 * 1024
LIMITS = {"lite": 10 * MB, "standard": 50 * MB, "full": 100 * MB}
# fixed values: headers that belong to one hop
HOP = ["connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailers", "transfer-encoding", "upgrade", "host", "content-length"]


def body_limit(tier: Column) -> Column:
    return F.when(tier == "lite", LIMITS["lite"]).when(tier == "standard", LIMITS["standard"]).otherwise(LIMITS["full"])


def within_endpoint(text: Column, most_bytes: int = 64 * 1024) -> Column:
    """Whether the detection endpoint takes a text: it refuses larger ones whole."""
    return F.coalesce(F.octet_length(text) <= most_bytes, F.lit(False))


def scanned_type(content_type: Column) -> Column:
    """Bodies without a content type, and JSON, are scanned."""
    ct = F.lower(content_type)
    return F.coalesce(ct.startswith("application/json") | ct.contains("+json"), F.lit(True))


def event_stream(content_type: Column) -> Column:
    return F.coalesce(F.lower(content_type).contains("text/event-stream"), F.lit(False))


def routed(requests: DataFrame, providers: list[tuple[str, str]]) -> DataFrame:
    """requests (path, ...) with provider, rest: the longest path prefix wins; nulls where none fits. providers: (prefix, name), a short list."""
    fits = [F.when(F.startswith("path", F.lit(p)), F.struct(F.lit(len(p)).alias("n"), F.lit(name).alias("provider"))) for p, name in providers]
    best = F.array_max(F.array(*fits))
    return requests.withColumn("provider", best["provider"]).withColumn("rest", F.when(best.isNotNull(), F.substring("path", best["n"] + 1, F.length("path"))))


def forwarded(headers: Column, strip: list[str]) -> Column:
    """Headers (map) without those of one hop and those named."""
    gone = [h.lower() for h in (*HOP, *strip)]
    return F.map_filter(headers, lambda k, v: ~F.lower(k).isin(gone))


def fetchable(url: Column, private_ip: Column) -> Column:
    """https, or http to localhost, and no private address."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))
    local = host.isin("localhost", "127.0.0.1", "[::1]")
    return F.when(F.regexp_like(url, F.lit("^https://")), ~private_ip & ~local).when(F.regexp_like(url, F.lit("^http://")), local).otherwise(F.lit(False))


# fixed values: names of the counters that a health report has
COUNTERS = ["pii_matches_total", "requests_total", "images_processed_total", "faces_redacted_total", "text_regions_total", "nsfw_blocked_total", "screenshots_detected_total", "ri_flags_total", "ri_scans_total", "fpe_unprotected_total", "onnx_panics_total"]


def counters(log: DataFrame) -> DataFrame:
    """One row: the sum of each counter over log (counter, n); 0 for those without an entry. Other names are ignored."""
    return log.agg(*(F.coalesce(F.sum(F.when(F.col("counter") == c, F.col("n"))), F.lit(0)).cast("long").alias(c) for c in COUNTERS))


def resumed(snapshots: DataFrame, log: DataFrame) -> DataFrame:
    """Counters that go on from the latest of appended snapshots (at and the counters)."""
    last = snapshots.agg(F.max_by(F.struct(*COUNTERS), "at").alias("s")).select(F.explode(F.array(*(F.struct(F.lit(c).alias("counter"), F.col(f"s.{c}").alias("n")) for c in COUNTERS))).alias("c")).select("c.*")
    return counters(log.select("counter", "n").unionByName(last.where("n IS NOT NULL")))


def timing_headers(timings: Column) -> Column:
    """The timings (map of name to microseconds) that took any time, as headers."""
    return F.transform_keys(F.map_filter(timings, lambda _, v: v > 0), lambda k, _: F.concat(F.lit("x-"), F.replace(k, F.lit("_"), F.lit("-"))))


def observed(df: DataFrame, name: str) -> tuple[DataFrame, "Observation"]:
    """df and an observation that has, once df was used, its rows and the first and last moment at which one was made (microseconds)."""
    from pyspark.sql import Observation

    seen = Observation(name)
    at = F.unix_micros(F.current_timestamp())
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.min(at).alias("began_us"), F.max(at).alias("ended_us")), seen


def latency(samples: DataFrame, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """metric, n, mean_us and p50, p95, ...: the bound of the first bucket whose running count reaches the share."""
    bound = F.coalesce(*(F.when(F.col("us") <= b, F.lit(b)) for b in LATENCY_BOUNDS), F.lit(LATENCY_BOUNDS[-1]))
    buckets = samples.groupBy("metric", bound.alias("bound")).agg(F.count(F.lit(1)).alias("n"), F.sum("us").alias("us"))
    w = Window.partitionBy("metric").orderBy("bound")
    runs = buckets.withColumn("run", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy("metric")))
    picks = [F.min(F.when(F.col("run") >= F.ceil(F.col("total") * s), F.col("bound"))).cast("long").alias(f"p{int(s * 100)}") for s in shares]
    return runs.groupBy("metric").agg(F.sum("n").cast("long").alias("n"), F.floor(F.sum("us") / F.sum("n")).cast("long").alias("mean_us"), *picks)


def unfinished(lines: DataFrame) -> DataFrame:
    """(id, at, n) of journal entries J|id|seconds|n|0/1 that no line ends. Other lines are ignored."""
    f = F.split("line", r"\|")
    rows = lines.where(F.regexp_like("line", F.lit(r"^J\|[^|]+\|[0-9]+\|[0-9]+\|[01]$"))).select(f[1].alias("id"), f[2].cast("long").alias("at"), f[3].cast("int").alias("n"), (f[4] == "1").alias("done"))
    return rows.where("NOT done").join(rows.where("done").select("id").distinct(), "id", "left_anti").groupBy("id").agg(F.min("at").alias("at"), F.max("n").alias("n"))


def tier(ram_mb: Column) -> Column:
    return F.when(ram_mb >= 3584, "full").when(ram_mb >= 1536, "standard").otherwise("lite")


def embedded_budget(ram_mb: Column) -> Column:
    """A fifth of the memory, 12 to 275 MB."""
    return F.greatest(F.lit(12), F.least(F.lit(275), F.floor(ram_mb / 5))).cast("int")


def heartbeat(beats: DataFrame) -> DataFrame:
    """beats (client, at, ok, passthrough) with state and passed: where a check leads, and the states it goes through.

    A failed check degrades. A good one leads to active, by way of recovering where the state before was degraded or
    passthrough. Clients begin active.
    """
    state = F.when(~F.col("ok"), "degraded").when(F.col("passthrough"), "passthrough").otherwise("active")
    before = F.coalesce(F.lag("state").over(Window.partitionBy("client").orderBy("at")), F.lit("active"))
    by_way = (F.col("state") == "active") & F.col("before").isin("degraded", "passthrough")
    passed = F.when(F.col("state") == F.col("before"), F.expr("CAST(array() AS array<string>)")).when(by_way, F.array(F.lit("recovering"), F.lit("active"))).otherwise(F.array("state"))
    return beats.withColumn("state", state).withColumn("before", before).withColumn("passed", passed).drop("before")


def key_at(uses: DataFrame, keys: DataFrame, overlap_s: int = 30, most_keys: int = 1000) -> DataFrame:
    """uses (use_id, at) with the version in force, and with_old: its predecessor's while that is still accepted. keys: (version, since); over `most_keys` is an error."""
    known = sorted(keys.select("since", "version").limit(most_keys + 1).collect())
    if len(known) > most_keys:
        raise ValueError(f"over {most_keys} keys")
    kind = keys.schema["version"].dataType
    history = F.array(*(F.struct(F.lit(since).alias("since"), F.lit(v).cast(kind).alias("version"), F.lit(old).cast(kind).alias("old")) for (since, v), old in zip(known, [None, *(v for _, v in known)], strict=False)))
    met = uses.withColumn("k", F.try_element_at(F.filter(history, lambda k: k["since"] <= F.col("at")), F.lit(-1)))
    return met.select(*uses.columns, F.col("k.version").alias("version"), F.when(F.col("at") < F.col("k.since") + overlap_s, F.col("k.old")).alias("with_old"))


def live(mappings: DataFrame, now: int, ttl_s: int) -> DataFrame:
    return mappings.where(F.col("created_at") + ttl_s > now)


def counted(mapping: DataFrame) -> DataFrame:
    """request_id, type, n: distinct ciphertexts, not matches."""
    return mapping.select("request_id", "type", "ciphertext").distinct().groupBy("request_id", "type").agg(F.count(F.lit(1)).alias("n"))
