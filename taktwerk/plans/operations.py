"""Metrics, traces, limits, observations and housekeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from taktwerk.functions.text import direction, metric_name, occupancy_code, platform, product_code, vehicle_number
from taktwerk.operators import operations as op
from taktwerk.operators.live import keys_with_prefix
from taktwerk.operators.summary import Measured
from taktwerk.operators.versioned import latest_version
from taktwerk.plans.registry import query
from taktwerk.sources.fixtures import AS_OF, DAY, VEHICLE, Fixtures
from taktwerk.sources.scratch import stored


@query("cancelled_on_day", f"SELECT count(*) AS cancelled FROM fahrten WHERE betriebstag = DATE '{DAY}' AND faelltaus = 1")
def cancelled_on_day(t: Fixtures):
    return t.trips.where((F.col("betriebstag") == F.lit(DAY).cast("date")) & (F.col("faelltaus") == 1)).agg(F.count("*").alias("cancelled"))


@query("has_cancelled_column", "SELECT true AS present")
def has_cancelled_column(t: Fixtures):
    """Whether the trips of a catalog have the column; older tables lack it."""
    return t.spark.range(1).select(F.lit("faelltaus" in t.trips.columns).alias("present"))


@query("latest_version_rows", "SELECT (SELECT count(*) FROM fh_raw) AS appended, (SELECT count(*) FROM fahrten_halte) AS merged")
def latest_version_rows(t: Fixtures):
    counts = [df.agg(F.count("*").alias("n")).withColumn("kind", F.lit(k)) for k, df in (("appended", t.raw_stop_events), ("merged", t.stop_events))]
    return counts[0].unionByName(counts[1]).agg(*[F.sum(F.when(F.col("kind") == k, F.col("n"))).alias(k) for k in ("appended", "merged")])


@query("stop_events_latest", "SELECT betriebstag, vgnkennung, fahrtnummer, produkt, haltepunkt, ankunft_soll, ankunft_v, abfahrt_soll, abfahrt_v FROM fahrten_halte")
def stop_events_latest(t: Fixtures):
    return t.stop_events.select("betriebstag", "vgnkennung", "fahrtnummer", "produkt", "haltepunkt", "ankunft_soll", "ankunft_v", "abfahrt_soll", "abfahrt_v")


_OBSERVED = (
    "SELECT ts AS timestamp, 'dev' || user_id AS device, (event_id % 256)::SMALLINT AS sequence, (value::INTEGER % 256)::SMALLINT AS rail_temperature, event_id AS version FROM events"
)


def observations(t: Fixtures):
    return t.events.select(F.col("ts").alias("timestamp"), F.concat(F.lit("dev"), "user_id").alias("device"), (F.col("event_id") % 256).cast("smallint").alias("sequence"), (F.round("value").cast("int") % 256).cast("smallint").alias("rail_temperature"), F.col("event_id").alias("version"), F.col("ts").alias("ingested_at"))


@query("latest_observation", f"SELECT timestamp, device, sequence FROM ({_OBSERVED}) ORDER BY timestamp DESC, device LIMIT 1", prelude=False)
def latest_observation(t: Fixtures):
    rows = latest_version(observations(t), ["device", "timestamp"], "version")
    return op.latest_observation(rows).select("timestamp", "device", "sequence")


@query("latest_observation_device", f"SELECT timestamp, device, sequence FROM ({_OBSERVED}) WHERE device = 'dev7' ORDER BY timestamp DESC, version DESC LIMIT 1", prelude=False)
def latest_observation_device(t: Fixtures):
    rows = latest_version(observations(t), ["device", "timestamp"], "version")
    return op.latest_observation(rows, "dev7").select("timestamp", "device", "sequence")


@query("observations_by_device", f"SELECT device, max(timestamp) AS latest, count(*) AS n FROM ({_OBSERVED}) GROUP BY 1", prelude=False)
def observations_by_device(t: Fixtures):
    return observations(t).groupBy("device").agg(F.max("timestamp").alias("latest"), F.count("*").alias("n"))


@query("metric_rate_avg_2s", "SELECT event_type, window_start, n, round(n / 2e0, 2) AS rate, round(mean) AS average FROM (SELECT event_type, time_bucket(INTERVAL 2 SECONDS, ts) AS window_start, count(*) AS n, avg(value) AS mean FROM events GROUP BY 1, 2)", prelude=False)
def metric_rate_avg_2s(t: Fixtures):
    return op.window_rates(t.events, "event_type", "ts", "value")


@query("status_code_counts", "SELECT event_type, json_extract(props, '$.k')::INTEGER AS code, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1, 2", prelude=False)
def status_code_counts(t: Fixtures):
    return op.status_counts(t.events.where("event_type = 'error'"), "event_type", F.get_json_object("props", "$.k").cast("int"))


@query("metric_key_counts", "SELECT CASE event_type WHEN 'view' THEN 'METRIC:' WHEN 'click' THEN 'METRICLIST:' WHEN 'error' THEN 'ERRORLIST:' END AS kind, count(*) AS n FROM events WHERE event_type IN ('view', 'click', 'error') GROUP BY 1", prelude=False)
def metric_key_counts(t: Fixtures):
    prefix = F.when(F.col("event_type") == "view", "METRIC:").when(F.col("event_type") == "click", "METRICLIST:").when(F.col("event_type") == "error", "ERRORLIST:").otherwise("OTHER:")
    return keys_with_prefix(t.events.select(F.concat(prefix, F.col("event_id").cast("string")).alias("key")), ["METRIC:", "METRICLIST:", "ERRORLIST:"])


@query("gauge_latest", "SELECT event_type AS key, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1", prelude=False)
def gauge_latest(t: Fixtures):
    """Gauges: the last value written to each key."""
    return latest_version(t.events.select(F.col("event_type").alias("key"), "value", "ts", "event_id"), ["key"], "ts", "event_id").select("key", "value")


_CAP = 3000
_RECENT = "(SELECT * FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOURS)"


@query("trace_retention_bytes", f"SELECT event_id FROM (SELECT event_id, sum(length(props)) OVER (ORDER BY ts DESC, event_id DESC) AS b FROM {_RECENT}) WHERE b <= {_CAP}", prelude=False)
def trace_retention_bytes(t: Fixtures):
    """Traces of the last day, the oldest evicted until the rest fits."""
    log = t.events.select("event_id", "ts", F.length("props").cast("bigint").alias("size"))
    newest = log.agg(F.max("ts").alias("newest"))
    rows = log.crossJoin(newest)
    return op.retained(rows, "ts", "size", "event_id", F.col("newest"), most_bytes=_CAP).select("event_id")


@query("trace_status", f"SELECT count(*) AS n, coalesce(sum(length(props)), 0)::BIGINT AS bytes FROM {_RECENT}", prelude=False)
def trace_status(t: Fixtures):
    newest = t.events.agg(F.max("ts").alias("newest"))
    rows = t.events.crossJoin(newest).where(F.col("ts") >= F.col("newest") - F.expr("interval 24 hours"))
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("props").cast("bigint")), F.lit(0)).alias("bytes"))


@query("trace_page", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 250", prelude=False)
def trace_page(t: Fixtures):
    return t.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(250).select("event_id", "ts")


@query("trace_page_after", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' ORDER BY ts, event_id LIMIT 250", prelude=False)
def trace_page_after(t: Fixtures):
    return t.events.where(F.col("ts") >= F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).orderBy("ts", "event_id").limit(250).select("event_id", "ts")


@query("trace_durations", "SELECT user_id AS request_id, epoch_us(max(ts) FILTER (WHERE event_type <> 'view')) - epoch_us(min(ts) FILTER (WHERE event_type = 'view')) AS duration_us FROM events GROUP BY 1", prelude=False)
def trace_durations(t: Fixtures):
    phase = F.when(F.col("event_type") == "view", "request").otherwise("response")
    return op.call_durations(t.events.select(F.col("user_id").alias("request_id"), phase.alias("phase"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us")))


@query("prometheus_lines", "SELECT name, pos::INTEGER AS pos, CASE pos WHEN 0 THEN '# HELP ' || name || ' Number of ' || event_type WHEN 1 THEN '# TYPE ' || name || ' gauge' ELSE name || ' ' || n END AS line FROM (SELECT 'Takt_Events_' || event_type AS name, event_type, count(*) AS n FROM events GROUP BY 2), (SELECT unnest([0, 1, 2]) AS pos)", prelude=False)
def prometheus_lines(t: Fixtures):
    counts = t.events.groupBy("event_type").agg(F.count("*").alias("value"))
    named = counts.select(metric_name(F.lit("Takt_"), F.lit("Events"), F.col("event_type")).alias("name"), F.concat(F.lit("Number of "), "event_type").alias("help"), F.lit("gauge").alias("kind"), "value")
    return op.exposition(named)


def _calls(t: Fixtures):
    return t.events.select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.lit(1.0).alias("cost"))


#: The leaky counter call by call, for DuckDB; {0} is the level that decides.
LIMITER = (
    "WITH RECURSIVE c AS (SELECT user_id, epoch_us(ts) // 1000 AS ts_ms, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),"
    " l AS (SELECT user_id, ts_ms, i, 1e0 AS level, false AS blocked FROM c WHERE i = 1"
    " UNION ALL SELECT n.user_id, n.ts_ms, n.i, greatest(0e0, n.drained) + CASE WHEN {0} + 1e0 >= 1e1 THEN 0e0 ELSE 1e0 END AS level, {0} + 1e0 >= 1e1 AS blocked"
    " FROM (SELECT c.user_id, c.ts_ms, c.i, l.level AS level, l.level - (c.ts_ms - l.ts_ms) / 6e4 * 1e1 AS drained FROM l JOIN c ON c.user_id = l.user_id AND c.i = l.i + 1) n)"
)


#: What a blocked call has above the room for a call of one, in milliseconds of draining.
_RETRY = "CASE WHEN blocked THEN round((level - 9e0) * 6e3)::BIGINT END AS retry_ms"


@query("rate_limiter_fold", LIMITER.format("n.drained") + " SELECT user_id, ts_ms, 1e0 AS cost, round(level, 6) AS level, blocked, " + _RETRY + " FROM l", prelude=False)
def rate_limiter_fold(t: Fixtures):
    return op.limited(_calls(t), "user_id", "ts_ms", "cost").withColumn("level", F.round("level", 6))


@query("rate_limiter_undrained", LIMITER.format("n.level") + " SELECT user_id, ts_ms, 1e0 AS cost, round(level, 6) AS level, blocked, " + _RETRY + " FROM l", prelude=False)
def rate_limiter_undrained(t: Fixtures):
    """The variant that compares the level as the last call left it."""
    return op.limited(_calls(t), "user_id", "ts_ms", "cost", undrained=True).withColumn("level", F.round("level", 6))


_CHECKED = (
    "WITH RECURSIVE c AS (SELECT user_id, epoch_us(ts) // 1000 AS ts_ms, CASE WHEN event_id % 5 <> 0 THEN 1e0 END AS cost, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id % 5 <> 0) AS i FROM events),"
    " l AS (SELECT user_id, ts_ms, cost, i, cost AS level, false AS blocked FROM c WHERE i = 1"
    " UNION ALL SELECT n.user_id, n.ts_ms, n.cost, n.i, CASE WHEN n.undrained IS NULL THEN n.cost ELSE n.drained + CASE WHEN n.drained + n.cost < 1e1 THEN 1e0 ELSE 0e0 END END AS level,"
    " CASE WHEN n.undrained IS NULL THEN false WHEN n.cost IS NULL THEN n.drained >= 9e0 ELSE n.undrained + 1e0 >= 1e1 END AS blocked"
    " FROM (SELECT c.*, greatest(0e0, l.level - (c.ts_ms - l.ts_ms) / 6e4 * 1e1) AS drained, l.level - (c.ts_ms - l.ts_ms) / 6e4 * 1e1 AS undrained FROM l JOIN c ON c.user_id = l.user_id AND c.i = l.i + 1) n)"
)


@query("rate_limiter_checked", _CHECKED + " SELECT user_id, ts_ms, cost, round(level, 6) AS level, blocked, " + _RETRY + " FROM l", prelude=False)
def rate_limiter_checked(t: Fixtures):
    """Every fifth call only asks whether it would be let through."""
    asks = t.events.select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.when(F.col("event_id") % 5 != 0, 1.0).alias("cost"))
    return op.limited(asks, "user_id", "ts_ms", "cost").withColumn("level", F.round("level", 6))


@query("coded_trips", "SELECT DISTINCT CASE produkt WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS produkt, (CASE besetzungsgrad WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 ELSE 0 END)::INTEGER AS besetzungsgrad, (CASE WHEN fahrzeugnummer = 0 THEN 0 WHEN fahrzeugnummer = -1 THEN -1 ELSE fahrzeugnummer END)::INTEGER AS fahrzeugnummer, richtung::INTEGER AS richtung FROM fahrten")
def coded_trips(t: Fixtures):
    """Texts of the upstream form brought to codes."""
    pick = lambda c, names: F.element_at(F.array(*[F.lit(n) for n in names]), c.cast("int"))
    texts = t.trips.select(
        pick(F.col("produkt"), ("Bus", "UBahn", "Tram")).alias("p"), pick(F.col("besetzungsgrad"), ("Unbekannt", "Schwachbesetzt", "Starkbesetzt", "Ueberfuellt", "Voll")).alias("b"),
        F.when(F.col("fahrzeugnummer") == 0, "PVU").when(F.col("fahrzeugnummer") == -1, None).otherwise(F.col("fahrzeugnummer").cast("string")).alias("v"), F.concat(F.lit("Richtung"), F.col("richtung").cast("string")).alias("r"),
    )
    return texts.select(product_code(F.col("p")).alias("produkt"), occupancy_code(F.col("b")).alias("besetzungsgrad"), vehicle_number(F.col("v")).alias("fahrzeugnummer"), direction(F.col("r")).alias("richtung")).distinct()


@query("platform_codes", "SELECT DISTINCT haltepunkt::INTEGER AS haltepunkt, haltepunkt::INTEGER AS platform FROM fahrten_halte")
def platform_codes(t: Fixtures):
    code = F.when(F.col("haltepunkt") == 0, "X").otherwise(F.concat(F.lit("X:"), F.col("haltepunkt").cast("string")))
    return t.stop_events.select(F.col("haltepunkt").cast("int").alias("haltepunkt"), platform(code).alias("platform")).distinct()


@query("vehicle_features", "SELECT DISTINCT fahrzeugnummer, CASE WHEN fahrzeugnummer % 3 = 0 THEN 'Vollklima' END AS air_conditioning, CASE WHEN fahrzeugnummer % 2 = 0 THEN 'Strom' END AS fuel_type, (fahrzeugnummer % 4)::VARCHAR AS wheelchair_spaces, CASE WHEN fahrzeugnummer % 2 = 0 THEN 1 ELSE 2 END AS accessible_doors FROM fahrten WHERE fahrzeugnummer > 0")
def vehicle_features(t: Fixtures):
    """Features read from free-form vehicle data."""
    n = F.col("fahrzeugnummer")
    doors = F.when(n % 2 == 0, "1").otherwise("2")
    info = F.map_from_arrays(F.array(*[F.lit(k) for k in ("typ", "Kraftstoffart", "Rollstuhlplaetze", "anzahl_tueren", "tuer_1_mit_aufstellflaeche", "tuer_2_mit_aufstellflaeche")]), F.array(F.when(n % 3 == 0, "Avenio").otherwise("Bus"), F.when(n % 2 == 0, "Strom").otherwise(""), (n % 4).cast("string"), doors, F.lit("ja"), F.lit("true")))
    rows = t.trips.where("fahrzeugnummer > 0").select("fahrzeugnummer").distinct()
    return op.features(rows.withColumn("info", info), F.col("info"), F.lit("Tram")).drop("info")


@query("migrations_to_apply", "SELECT id, sha256(body) AS checksum FROM (VALUES ('002_add_cancelled', 'add cancelled'), ('003_observations', 'create observations')) v(id, body)", prelude=False)
def migrations_to_apply(t: Fixtures):
    known = [("001_base_tables", "create tables"), ("002_add_cancelled", "add cancelled"), ("003_observations", "create observations")]
    return op.unapplied(known, t.spark.createDataFrame([("001_base_tables",)], "id string"))


@query("health", "SELECT 1 AS ok", prelude=False)
def health(t: Fixtures):
    return t.spark.sql("SELECT 1 AS ok")


@query("summary_metrics", f"SELECT count(*) AS read_rows FROM fahrten WHERE fahrzeugnummer = {VEHICLE} AND betriebstag < DATE '{AS_OF}'")
def summary_metrics(t: Fixtures):
    """Rows that a query reads, as its summary tells."""
    return t.trips.where((F.col("fahrzeugnummer") == VEHICLE) & (F.col("betriebstag") < F.lit(AS_OF).cast("date"))).agg(F.count("*").alias("read_rows"))


@query("stale_keys", "SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE user_id % 3 = 0)", prelude=False)
def stale_keys(t: Fixtures):
    """Index entries whose key is gone; here every third user has one."""
    alive = t.events.where("user_id % 3 = 0").select("user_id").distinct()
    return t.events.select("event_id", "user_id").join(alive, "user_id", "left_anti").select("event_id")


@query("values_of_keys", "SELECT event_id, json_extract(props, '$.k')::INTEGER AS k FROM events WHERE event_id % 10 = 0", prelude=False)
def values_of_keys(t: Fixtures):
    """The decoded values of some keys; what cannot be decoded is left out."""
    keys = t.events.where("event_id % 10 = 0").select("event_id")
    value = F.from_json("props", "k int", {"mode": "PERMISSIVE"})["k"]
    return t.events.select("event_id", value.alias("k")).join(keys, "event_id", "left_semi").where("k is not null")


@query("required_ids", "SELECT user_id FROM events WHERE event_type = 'error' UNION SELECT user_id FROM events WHERE event_type = 'signup'", prelude=False)
def required_ids(t: Fixtures):
    """A stored set and what a history adds to it."""
    return t.events.where("event_type = 'error'").select("user_id").union(t.events.where("event_type = 'signup'").select("user_id")).distinct()


@query("job_counts", "SELECT count(*) FILTER (WHERE event_type = 'view') AS waiting, count(*) FILTER (WHERE event_type = 'click') AS active, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events", prelude=False)
def job_counts(t: Fixtures):
    return t.events.agg(*[F.count_if(F.col("event_type") == e).alias(n) for e, n in (("view", "waiting"), ("click", "active"), ("error", "failed"))])


@query("filled_options", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 2 END AS n FROM events", prelude=False)
def filled_options(t: Fixtures):
    """Options that have a value."""
    options = F.create_map(F.lit("Line"), F.when(F.col("event_id") % 3 == 0, "").otherwise("U1"), F.lit("Product"), F.col("event_type"), F.lit("TimeSpan"), F.lit(None).cast("string"))
    left = F.map_filter(options, lambda k, v: v.isNotNull() & (v != ""))
    return t.events.select("event_id", F.size(left).alias("n"))


@query("rows_a_second", f"SELECT (SELECT count(*) FROM fahrten) AS read_rows, (SELECT count(*) FROM fahrten WHERE fahrzeugnummer = {VEHICLE} AND betriebstag < DATE '{AS_OF}') AS result_rows, true AS timed")
def rows_a_second(t: Fixtures):
    """The summary of a vehicle's history, measured while it is stored: rows read and given, and whether they make a rate."""
    measured = Measured()
    history = measured.counted(t.trips).where((F.col("fahrzeugnummer") == VEHICLE) & (F.col("betriebstag") < F.lit(AS_OF).cast("date")))
    _, summary = measured.run(history, lambda df: stored(df, "history"))
    row = (summary.read_rows, summary.result_rows, summary.elapsed_ns > 0 and summary.rows_a_second > 0)
    return t.spark.createDataFrame([row], "read_rows bigint, result_rows bigint, timed boolean")
