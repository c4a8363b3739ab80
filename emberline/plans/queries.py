"""Registered queries over the test tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline import schemas
from emberline.operators import ledger, logs, metrics, properties, rules, sessions
from emberline.plans.plant import Plant
from emberline.sources import fixtures as fx
from emberline.sources import metrics as sources
from emberline.sources.scratch import scratch_folder, written
from emberline.streaming import levels, pages, run, tail
from emberline.streaming import sessions as stream_sessions
from emberline.streaming.events import EventLog
from emberline.streaming.feed import ChangeFeed
from emberline.streaming.ledger_view import LedgerView
from emberline.streaming.monitor import LatestValues

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str]] = {}

START, END, NOW, SINCE = datetime(2024, 1, 3, 0, 7), datetime(2024, 1, 20, 10, 5), datetime(2024, 2, 1), datetime(2024, 1, 10)

M = "SELECT event_type AS topic, ts::TIMESTAMP AS ts, value, event_id AS seq FROM events"
SNAP = "SELECT user_id AS machine, ts::TIMESTAMP AS ts, event_id AS seq, 330 + value % 100 AS voltage, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS cosphi FROM events"
LEDGER = """
  o AS (SELECT user_id AS machine, event_id AS seq, ts::TIMESTAMP AS ts, event_type, CAST(value AS DECIMAL(28, 6)) AS amount FROM events),
  g AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY machine ORDER BY seq) AS segment FROM o),
  h AS (SELECT machine, seq, ts, CAST(sum(CASE WHEN event_type IN ('click', 'error') THEN -amount ELSE amount END)
        OVER (PARTITION BY machine, segment ORDER BY seq) AS DOUBLE) AS weight FROM g)"""
#: A start counts if the machine's last command was a stop or none; it ends at the stop that comes next.
SESSIONS = """
  sc AS (SELECT user_id AS machine, ts::TIMESTAMP AS ts, 3 * event_id AS seq, 'stop' AS cmd FROM events WHERE event_type = 'signup'
    UNION ALL SELECT user_id, ts::TIMESTAMP, 3 * event_id + 1, 'add' FROM events WHERE event_type = 'signup'
    UNION ALL SELECT user_id, ts::TIMESTAMP, 3 * event_id + 2, 'add' FROM events WHERE event_type = 'click'),
  sl AS (SELECT *, coalesce(lag(cmd) OVER (PARTITION BY machine ORDER BY seq), 'none') AS last FROM sc),
  st AS (SELECT *, lead(ts) OVER (PARTITION BY machine ORDER BY seq) AS "end" FROM sl WHERE (cmd = 'add' AND last <> 'add') OR (cmd = 'stop' AND last = 'add')),
  s AS (SELECT seq AS session, machine, ts AS "start", "end" FROM st WHERE cmd = 'add')"""


def _fixed(x: str, digits: int) -> str:
    scale, small = (4, "0.01") if digits == 1 else (8, "0.001")
    return f"CASE WHEN (abs({x}) * {scale}) % 2 = 1 THEN printf('%.{digits}f', {x} + sign({x}) * {small}) ELSE printf('%.{digits}f', {x}) END"


ISSUES = f"""
  SELECT *, 0 AS place, CASE WHEN voltage < 350 THEN 'Critical low voltage: ' || {_fixed("voltage", 1)} || 'V' WHEN voltage < 360 THEN 'Low voltage: ' || {_fixed("voltage", 1)} || 'V'
    WHEN voltage > 410 THEN 'Critical high voltage: ' || {_fixed("voltage", 1)} || 'V' WHEN voltage > 400 THEN 'High voltage: ' || {_fixed("voltage", 1)} || 'V' END AS message FROM n
  UNION ALL SELECT *, 1, CASE WHEN cosphi < 0.7 THEN 'Critical low power factor: ' || {_fixed("cosphi", 2)} WHEN cosphi < 0.8 THEN 'Low power factor: ' || {_fixed("cosphi", 2)} END FROM n
  UNION ALL SELECT *, 2, CASE WHEN voltage < 370 AND cosphi < 0.8 THEN 'Power quality issue detected' END FROM n"""


def registered(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        REGISTRY[f.__name__] = (f, sql)
        return f

    return add


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.round("value", 6))


def _downsample_sql(seconds: int, upper: str, start: datetime = START) -> str:
    first = metrics.bucket_start(start, seconds)
    return f"""WITH m AS ({M}) SELECT topic, time_bucket(INTERVAL '{seconds} seconds', ts, TIMESTAMP '1970-01-01') AS "timestamp", round(avg(value), 6) AS value
      FROM m WHERE ts >= TIMESTAMP '{first}' AND ts {upper} GROUP BY 1, 2"""


def _whole(seconds: int) -> str:
    return f"< time_bucket(INTERVAL '{seconds} seconds', TIMESTAMP '{END}', TIMESTAMP '1970-01-01') + INTERVAL '{seconds} seconds'"


# ------------------------------------------------------------------ metrics


@registered(_downsample_sql(3600, _whole(3600)))
def downsample_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.downsample(fx.metrics(spark, sf_dir), START, END, 3_600_000))


@registered(_downsample_sql(3600, f"<= TIMESTAMP '{END}'"))
def downsample_avg_clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.downsample(fx.metrics(spark, sf_dir), START, END, 3_600_000, clip_end=True))


@registered(_downsample_sql(7, _whole(7)))
def downsample_odd_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.downsample(fx.metrics(spark, sf_dir), START, END, 7_999))


@registered(f"WITH m AS ({M}) SELECT topic, ts AS \"timestamp\", value, seq, 'u' AS unit FROM m WHERE topic = 'click' AND ts BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'")
def raw_range_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.with_unit(metrics.measurements(metrics.of_topic(fx.metrics(spark, sf_dir), "click"), START, END), unit="u")


@registered(f"WITH m AS ({M}) SELECT topic, max(ts) AS \"timestamp\", arg_max(value, (ts, seq)) AS value FROM m GROUP BY topic")
def latest_per_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latest(fx.metrics(spark, sf_dir))


@registered(f"""WITH m AS ({M}), d(topic, unit) AS (VALUES ('view', 'm/s'), ('click', 'A'), ('error', 'n'), ('purchase', 'kW'), ('signup', 'V'), ('silent', 'K')),
  l AS (SELECT topic, max(ts) AS t, arg_max(value, (ts, seq)) AS v FROM m GROUP BY topic)
  SELECT topic, unit, coalesce(t, TIMESTAMP '{NOW}') AS "timestamp", coalesce(v, 0.0) AS value FROM d LEFT JOIN l USING (topic)""")
def latest_with_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latest_or_default(fx.metrics(spark, sf_dir), fx.sensors(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz"))


@registered(f"WITH m AS ({M}) SELECT * FROM m WHERE ts > TIMESTAMP '{SINCE}' ORDER BY ts, seq LIMIT 100")
def cursor_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.cursor_page(fx.metrics(spark, sf_dir), SINCE)


# ------------------------------------------------------------------- ledger


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.weight_history(fx.operations(spark, sf_dir), fx.machines(spark, sf_dir))


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two probes for each machine: fixed times, and one before all entries."""
    times = F.array(*[F.struct(F.lit(n).cast("bigint").alias("n"), F.lit(t).cast("timestamp_ntz").alias("at")) for n, t in enumerate((datetime(2024, 1, 12, 6), datetime(2023, 12, 1)))])
    return fx.machines(spark, sf_dir).select("machine", F.inline(times))


@registered(f"WITH {LEDGER} SELECT * FROM h")
def weight_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir)


@registered(f"WITH {LEDGER} SELECT * FROM h")
def ledger_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history, kept up by three parts of the operations."""
    view, ops, machines = LedgerView(spark, scratch_folder(spark)), fx.operations(spark, sf_dir), fx.machines(spark, sf_dir)
    upto = ops.agg(F.max("seq")).first()[0] or 0
    for n, (a, b) in enumerate(((0, 0.5), (0.5, 0.99), (0.99, 1))):
        view.extend(ops.where((F.col("seq") > a * upto if a else F.lit(True)) & (F.col("seq") <= b * upto)), machines, f"part:{n}", fold=not n)
    return view.history()


@registered(f"""WITH {LEDGER}, t(n, "at") AS (VALUES (0, TIMESTAMP '2024-01-12 06:00:00'), (1, TIMESTAMP '2023-12-01')), p AS (SELECT c_custkey AS machine, n, "at" FROM customer, t)
  SELECT p.machine, p.n, p."at", coalesce(arg_max(h.weight, h.seq), 0.0) AS weight FROM p LEFT JOIN h ON h.machine = p.machine AND h.ts <= p."at" GROUP BY ALL""")
def weight_at_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.weight_at(_history(spark, sf_dir), _probes(spark, sf_dir), fx.machines(spark, sf_dir))


def _ranges(spark: SparkSession, sf_dir: str, first: datetime, last: datetime) -> DataFrame:
    return fx.machines(spark, sf_dir).select(F.col("machine").alias("probe"), "machine", F.lit(first).cast("timestamp_ntz").alias("from"), F.lit(last).cast("timestamp_ntz").alias("to"))


def _range_sql(first: datetime, last: datetime) -> str:
    return f"""WITH {LEDGER}, b AS (SELECT machine, arg_max(weight, seq) AS base FROM h WHERE ts <= TIMESTAMP '{first}' GROUP BY machine),
      d AS (SELECT h.machine, CAST(weight AS DECIMAL(28, 6)) - CAST(coalesce(lag(weight) OVER (PARTITION BY h.machine ORDER BY seq), base, 0) AS DECIMAL(28, 6)) AS d
        FROM h LEFT JOIN b USING (machine) WHERE ts >= TIMESTAMP '{first}' AND ts < TIMESTAMP '{last}')
      SELECT c_custkey AS probe, c_custkey AS machine, TIMESTAMP '{first}' AS "from", TIMESTAMP '{last}' AS "to",
        CAST(coalesce(sum(greatest(d, 0)), 0) AS DOUBLE) AS loaded, CAST(coalesce(sum(greatest(-d, 0)), 0) AS DOUBLE) AS dispensed
      FROM customer LEFT JOIN d ON machine = c_custkey GROUP BY ALL"""


@registered(_range_sql(START, END))
def range_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.range_summary(_history(spark, sf_dir), _ranges(spark, sf_dir, START, END), fx.machines(spark, sf_dir))


@registered(_range_sql(END, START))
def range_summary_inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.range_summary(_history(spark, sf_dir), _ranges(spark, sf_dir, END, START), fx.machines(spark, sf_dir))


#: Operations of which every third was entered up to 12 days late: its time lies before that of entries before it.
LATE_LEDGER = LEDGER.replace("ts::TIMESTAMP AS ts", "CASE WHEN event_id % 3 = 0 THEN ts::TIMESTAMP - INTERVAL 1 DAY * (event_id * 7919 % 13) ELSE ts::TIMESTAMP END AS ts")


def _late_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.when(F.col("seq") % 3 == 0, -(F.col("seq") * 7919 % 13)).otherwise(0).cast("int")
    return ledger.weight_history(fx.operations(spark, sf_dir).withColumn("ts", F.timestamp_add("DAY", days, "ts").cast("timestamp_ntz")), fx.machines(spark, sf_dir))


@registered(_range_sql(START, END).replace(LEDGER, LATE_LEDGER))
def range_summary_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over ranges of ledgers whose order of insertion isn't that of time."""
    return ledger.range_summary(_late_history(spark, sf_dir), _ranges(spark, sf_dir, START, END), fx.machines(spark, sf_dir))


@registered(f"""WITH {LATE_LEDGER}, t(n, "at") AS (VALUES (0, TIMESTAMP '2024-01-12 06:00:00'), (1, TIMESTAMP '2023-12-01')), p AS (SELECT c_custkey AS machine, n, "at" FROM customer, t)
  SELECT p.machine, p.n, p."at", coalesce(arg_max(h.weight, h.seq), 0.0) AS weight FROM p LEFT JOIN h ON h.machine = p.machine AND h.ts <= p."at" GROUP BY ALL""")
def weight_at_points_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.weight_at(_late_history(spark, sf_dir), _probes(spark, sf_dir), fx.machines(spark, sf_dir))


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest voltage and cosphi of each machine, one topic for each."""
    return metrics.latest_or_default(fx.machine_metrics(spark, sf_dir), fx.machine_sensors(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz"))


@registered(f"""WITH {LEDGER}, n AS ({SNAP}), w AS (SELECT machine, arg_max(weight, seq) AS weight FROM h GROUP BY machine),
  l AS (SELECT machine, arg_max(voltage, (ts, seq)) AS v, arg_max(cosphi, (ts, seq)) AS c, max(ts) AS t FROM n GROUP BY machine)
  SELECT c_custkey AS machine, coalesce(weight, 0.0) AS weight, coalesce(v, 0.0) AS voltage, coalesce(c, 0.0) AS cosphi, coalesce(t, TIMESTAMP '{NOW}') AS "timestamp"
  FROM customer LEFT JOIN w ON w.machine = c_custkey LEFT JOIN l ON l.machine = c_custkey""")
def current_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    snap = ledger.current_snapshot(_history(spark, sf_dir), fx.machines(spark, sf_dir), _readings(spark, sf_dir), ["voltage", "cosphi"])
    return snap.select("machine", "weight", F.col("voltage.value").alias("voltage"), F.col("cosphi.value").alias("cosphi"), F.col("voltage.timestamp").alias("timestamp"))


@registered(f"""WITH {LEDGER}, n AS ({SNAP}), w AS (SELECT machine, arg_max(weight, seq) AS weight FROM h GROUP BY machine),
  l AS (SELECT machine, arg_max(voltage, (ts, seq)) AS v, arg_max(cosphi, (ts, seq)) AS c FROM n GROUP BY machine),
  r AS (SELECT machine, 'cosphi' AS sensor, c AS value FROM l UNION ALL SELECT machine, 'voltage', v FROM l), k(sensor, unit) AS (VALUES ('cosphi', ''), ('voltage', 'V'))
  SELECT c_custkey AS machine, coalesce(weight, 0.0) AS weight, k.sensor, k.unit, coalesce(r.value, 0.0) AS value
  FROM customer CROSS JOIN k LEFT JOIN w ON w.machine = c_custkey LEFT JOIN r ON r.machine = c_custkey AND r.sensor = k.sensor""")
def snapshot_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and values of each machine's snapshot, whatever sensors it has."""
    snap = ledger.snapshot_map(_history(spark, sf_dir), fx.machines(spark, sf_dir), _readings(spark, sf_dir))
    return snap.select("machine", "weight", F.explode("readings").alias("sensor", "r")).select("machine", "weight", "sensor", "r.unit", "r.value")


# ----------------------------------------------------------------- sessions


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.latest_sessions(sessions.fold_commands(fx.commands(spark, sf_dir)))


@registered(f"WITH {SESSIONS} SELECT * FROM s")
def sessions_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessions(spark, sf_dir)


@registered(f"WITH {SESSIONS} SELECT * FROM s WHERE \"end\" IS NOT NULL")
def sessions_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.query(_sessions(spark, sf_dir))


@registered(f"WITH {SESSIONS} SELECT * FROM s WHERE machine = 7")
def sessions_by_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.query(_sessions(spark, sf_dir), machine=7)


@registered(f"WITH {SESSIONS} SELECT * FROM s WHERE session = (SELECT 3 * min(event_id) + 1 FROM events WHERE event_type = 'signup')")
def session_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = fx.read(spark, sf_dir, "events").where("event_type = 'signup'").agg(F.min("event_id")).first()[0]
    return sessions.query(_sessions(spark, sf_dir), session=3 * first + 1)


@registered(f"WITH {SESSIONS} SELECT * FROM s")
def single_active_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.fold_starts_and_stops(fx.commands(spark, sf_dir))


@registered(f"""WITH {SESSIONS} SELECT * FROM s UNION ALL SELECT 3 * event_id + 2, user_id, ts::TIMESTAMP - INTERVAL 1 HOUR, ts::TIMESTAMP FROM events WHERE event_type = 'purchase'""")
def sessions_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A purchase adds a completed session of one hour, whether or not the machine has an active one."""
    c = fx.commands(spark, sf_dir)
    bought = fx.read(spark, sf_dir, "events").where("event_type = 'purchase'").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    done = bought.select(
        F.col("user_id").alias("machine"), "ts", (3 * F.col("event_id") + 2).alias("seq"), F.lit("add").alias("command"), F.lit(None).cast("bigint").alias("session"),
        F.expr("ts - interval 1 hour").alias("start"), F.col("ts").alias("end"),
    )
    return sessions.latest_sessions(sessions.fold_commands(c.select(done.columns).unionByName(done)))


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands, and after them an update of every session: those of even machines start an hour earlier, the others end at NOW."""
    c = fx.commands(spark, sf_dir)
    made = sessions.fold_starts_and_stops(c)
    even = F.col("machine") % 2 == 0
    update = made.select(
        "machine",
        F.lit(NOW).cast("timestamp_ntz").alias("ts"),
        (F.col("session") + F.lit(1 << 40)).alias("seq"),
        F.lit("update").alias("command"),
        "session",
        F.when(even, F.expr("start - interval 1 hour")).alias("start"),
        F.when(~even, F.lit(NOW).cast("timestamp_ntz")).alias("end"),
    )
    return c.select(update.columns).unionByName(update)


@registered(f"""WITH {SESSIONS} SELECT session, machine, CASE WHEN machine % 2 = 0 THEN "start" - INTERVAL 1 HOUR ELSE "start" END AS "start",
  CASE WHEN machine % 2 = 0 THEN "end" ELSE TIMESTAMP '{NOW}' END AS "end" FROM s""")
def session_updates_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.latest_sessions(sessions.fold_commands(_updates(spark, sf_dir)))


def _state_sql(at: str) -> str:
    return f"""WITH {LEDGER}, {SESSIONS}, q AS (SELECT *, {at} AS t FROM s),
      i AS (SELECT session, arg_max(weight, seq) AS initial FROM q JOIN h ON h.machine = q.machine AND h.ts <= q."start" GROUP BY session),
      w AS (SELECT session, arg_max(weight, seq) AS weight FROM q JOIN h ON h.machine = q.machine AND h.ts <= q.t GROUP BY session),
      d AS (SELECT session, CAST(h.weight AS DECIMAL(28, 6)) - CAST(coalesce(lag(h.weight) OVER (PARTITION BY session ORDER BY seq), initial, 0) AS DECIMAL(28, 6)) AS d
        FROM q JOIN h ON h.machine = q.machine AND h.ts >= q."start" AND h.ts < q.t LEFT JOIN i USING (session)),
      u AS (SELECT session, CAST(sum(greatest(d, 0)) AS DOUBLE) AS loaded, CAST(sum(greatest(-d, 0)) AS DOUBLE) AS dispensed FROM d GROUP BY session)
      SELECT session, machine, "start", "end", coalesce(initial, 0.0) AS initial, coalesce(weight, 0.0) AS weight, coalesce(loaded, 0.0) AS loaded, coalesce(dispensed, 0.0) AS dispensed
      FROM q LEFT JOIN i USING (session) LEFT JOIN w USING (session) LEFT JOIN u USING (session)"""


@registered(_state_sql(f"coalesce(\"end\", TIMESTAMP '{NOW}')"))
def session_state_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.session_states(_sessions(spark, sf_dir), _history(spark, sf_dir), fx.machines(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz"))


@registered(_state_sql(f"TIMESTAMP '{END}'"))
def session_state_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.lit(END).cast("timestamp_ntz")
    return sessions.session_states(_sessions(spark, sf_dir), _history(spark, sf_dir), fx.machines(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz"), at)


# ---------------------------------------------------------- rules and alerts


@registered(f"WITH n AS ({SNAP}) SELECT machine, seq, place, message FROM ({ISSUES}) WHERE message IS NOT NULL")
def threshold_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.threshold_issues(fx.snapshots(spark, sf_dir)).select("machine", "seq", "place", "message")


@registered(f"WITH n AS ({SNAP}) SELECT split_part(message, ':', 1) AS kind, count(*) AS n FROM ({ISSUES}) WHERE message IS NOT NULL GROUP BY 1")
def threshold_alert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.threshold_issues(fx.snapshots(spark, sf_dir)).groupBy(F.split_part("message", F.lit(":"), F.lit(1)).alias("kind")).agg(F.count("*").alias("n"))


E_LOG = "SELECT 'ev-' || event_id AS id, event_id AS seq, ts::TIMESTAMP AS ts, event_type AS label, user_id AS machine, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events"


@registered(f"WITH e AS ({E_LOG}) SELECT id, seq, ts, label FROM e WHERE label = 'purchase' AND k > 50")
def events_all_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = logs.every(fx.event_log(spark, sf_dir), logs.has_label("purchase"), logs.property_of("k", "int") > 50)
    return found.select("id", "seq", "ts", F.get("labels", F.lit(0)).alias("label"))


@registered(f"""WITH e AS ({E_LOG}) SELECT id, seq, ts, label, k, CASE WHEN seq % 3 = 0 THEN 'VARCHAR' WHEN seq % 3 = 1 THEN 'DOUBLE' END AS kind
  FROM e WHERE label IN ('purchase', 'view') AND k > 50 AND (seq % 3 = 0 OR seq % 3 = 1 AND value < 90 OR seq % 3 = 2)""")
def events_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters on properties of a stored log. One property is a text, a number or missing, by event."""
    folder, log = scratch_folder(spark), fx.event_log(spark, sf_dir)
    plain = F.expr("left(properties, length(properties) - 1)")
    number = F.get_json_object("properties", "$.value")
    more = F.when(F.col("seq") % 3 == 0, F.lit(', "mixed": "text"}')).when(F.col("seq") % 3 == 1, F.concat(F.lit(', "mixed": '), number, F.lit("}"))).otherwise("}")
    properties.write_events(properties.with_variant(log.withColumn("properties", F.concat(plain, more))), folder)
    stored = properties.read_events(spark, folder)
    number = properties.value_of("mixed", "double")
    found = logs.every(stored, F.get("labels", F.lit(0)).isin("purchase", "view"), properties.value_of("k", "int") > 50, F.coalesce(number < 90, F.lit(True)))
    kind = properties.kind_of("mixed")
    told = F.when(kind == "STRING", "VARCHAR").when(kind.isNotNull() & (kind != "VOID"), "DOUBLE")
    return found.select("id", "seq", "ts", F.get("labels", F.lit(0)).alias("label"), properties.value_of("k", "int").alias("k"), told.alias("kind"))


@registered(f"WITH e AS ({E_LOG}) SELECT id, seq, ts FROM e WHERE id = 'ev-42'")
def events_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.find(fx.event_log(spark, sf_dir), "ev-42").select("id", "seq", "ts")


@registered(f"WITH e AS ({E_LOG}) SELECT label, count(*) AS n, min(id) AS first_id FROM e WHERE label = 'error' GROUP BY label")
def events_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = logs.every(fx.event_log(spark, sf_dir), logs.has_label("error"))
    return found.groupBy(F.get("labels", F.lit(0)).alias("label")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def _rules() -> list[rules.Rule]:
    machine = F.concat(F.lit("Customer#"), F.lpad(F.get_json_object("properties", "$.machine"), 9, "0"))
    return [
        rules.Rule("error", logs.has_label("error"), F.concat(F.lit("Error on "), F.get_json_object("properties", "$.machine")), machine),
        rules.Rule("high", logs.property_of("value", "double") > 250, F.lit("High value"), machine),
        rules.Rule("edge", logs.property_of("k", "int") == 99, F.lit("Edge"), machine),
    ]


RULE_SQL = f"""e AS ({E_LOG}), r AS (
  SELECT id, seq, ts, machine, 0 AS place, 'Error on ' || machine AS message FROM e WHERE label = 'error'
  UNION ALL SELECT id, seq, ts, machine, 1, 'High value' FROM e WHERE value > 250
  UNION ALL SELECT id, seq, ts, machine, 2, 'Edge' FROM e WHERE k = 99),
  a AS (SELECT 'alert-' || (row_number() OVER w - 1) AS id, row_number() OVER w - 1 AS seq, message, ts, 'Customer#' || lpad(machine::VARCHAR, 9, '0') AS object, id AS event_id
    FROM r WINDOW w AS (ORDER BY ts, id, place))"""


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.trigger_alerts(rules.alerts_from_events(fx.event_log(spark, sf_dir), _rules()), order_by=["ts", "event_id", "place"])


@registered(f"WITH {RULE_SQL} SELECT *, false AS acknowledged FROM a")
def rule_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alerts(spark, sf_dir).drop("change")


@registered(f"WITH {RULE_SQL} SELECT id, seq, message, seq % 3 = 0 AS acknowledged FROM a")
def alerts_acknowledged(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _alerts(spark, sf_dir)
    done = logs.acknowledge(log, log.where("seq % 3 = 0").select("id"))
    return logs.latest_version(log.unionByName(done)).select("id", "seq", "message", "acknowledged")


@registered(f"WITH {RULE_SQL} SELECT c_custkey AS machine, count(*) AS n, min(a.seq) AS first_seq FROM a JOIN customer ON c_name = object GROUP BY 1")
def machine_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.alerts_of_machines(_alerts(spark, sf_dir), fx.machines(spark, sf_dir)).groupBy("machine").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


@registered(f"WITH {RULE_SQL} SELECT a.id, a.event_id, e.ts AS event_ts, e.label FROM a JOIN e ON e.id = a.event_id")
def alert_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = logs.with_source_event(_alerts(spark, sf_dir), fx.event_log(spark, sf_dir))
    return met.select("id", "event_id", F.col("event.ts").alias("event_ts"), F.get("event.labels", F.lit(0)).alias("label"))


@registered(f"WITH {RULE_SQL} SELECT id, object, message FROM a WHERE NOT seq % 3 = 0 AND message = 'High value' AND ts >= TIMESTAMP '{SINCE}'")
def alerts_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _alerts(spark, sf_dir)
    log = written(log.unionByName(logs.acknowledge(log, log.where("seq % 3 = 0").select("id"))))
    open_ = logs.every(logs.latest_version(log), ~F.col("acknowledged"), F.col("message") == "High value", F.col("ts") >= F.lit(SINCE).cast("timestamp_ntz"))
    return open_.select("id", "object", "message")


@registered(f"""WITH e AS ({E_LOG}), r AS (
  SELECT seq, ts, machine, 0 AS place, 'Error on ' || machine AS message FROM e WHERE label = 'error' UNION ALL SELECT seq, ts, machine, 1, 'High value' FROM e WHERE value > 250
  UNION ALL SELECT seq, ts, machine, 2, 'Edge' FROM e WHERE k = 99),
  b AS (SELECT *, ts >= TIMESTAMP '{SINCE}' AS later, row_number() OVER (ORDER BY ts) - 1 AS nth FROM e),
  a AS (SELECT r.*, 'ev-' || b.nth AS event_id, 'ev-' || b.nth AS eid, b.later FROM r JOIN b USING (seq))
  SELECT 'alert-' || (row_number() OVER (ORDER BY later, ts, event_id, place) - 1) AS id, message, 'Customer#' || lpad(machine::VARCHAR, 9, '0') AS object, event_id FROM a""")
def event_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events created in two calls, the second after a restart: ids go on, and rules alert on each call's events."""
    folder = scratch_folder(spark)
    raw = fx.event_log(spark, sf_dir).select("ts", "properties", "labels")
    early = F.col("ts") < F.lit(SINCE).cast("timestamp_ntz")
    for part in (raw.where(early), raw.where(~early)):
        log = EventLog(ChangeFeed(spark, f"{folder}/events", schemas.EVENT), ChangeFeed(spark, f"{folder}/alerts", schemas.ALERT), _rules())
        log.create(part)
    return log.alerts.rows().select("id", "message", "object", "event_id")


@registered(f"""WITH l AS (SELECT machine, arg_max(voltage, (ts, seq)) AS v, arg_max(cosphi, (ts, seq)) AS c FROM ({SNAP}) GROUP BY 1),
  n AS (SELECT c_name AS name, coalesce(v, 0) AS voltage, coalesce(c, 0) AS cosphi FROM customer LEFT JOIN l ON c_custkey = machine),
  i AS (SELECT name AS object, message FROM ({ISSUES}) WHERE message IS NOT NULL), t(tick) AS (VALUES (0), (1))
  SELECT 'alert-' || (row_number() OVER (ORDER BY tick, object, message) - 1) AS id, message, object, TIMESTAMP '{NOW}' AS ts FROM i, t""")
def monitor_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ticks of monitors over all machines, whose newest values follow the metrics as a stream; those of machines
    without readings are 0. The second monitor is another program's."""
    p, now, folder = plant(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz"), scratch_folder(spark)
    for _ in range(2):
        latest = LatestValues(spark, f"{folder}/latest")
        latest.follow(fx.machine_metrics_of(_events_stream(spark, sf_dir)), drain=True)
        p.monitor(ChangeFeed(spark, f"{folder}/alerts", schemas.ALERT), latest=latest).tick(now)
    return ChangeFeed(spark, f"{folder}/alerts", schemas.ALERT).rows().select("id", "message", "object", "ts")


@registered("""WITH o AS (SELECT user_id AS machine, count(*) AS n, sum(CASE WHEN event_type IN ('purchase', 'view') THEN CAST(value AS DECIMAL(28, 6)) ELSE 0 END) AS l,
    sum(CASE WHEN event_type IN ('click', 'error') THEN CAST(value AS DECIMAL(28, 6)) ELSE 0 END) AS d FROM events GROUP BY 1)
  SELECT n_regionkey AS plant, n_nationkey AS shop, count(*) AS machines, CAST(coalesce(sum(n), 0) AS BIGINT) AS operations,
    CAST(coalesce(sum(l), 0) AS DOUBLE) AS loaded, CAST(coalesce(sum(d), 0) AS DOUBLE) AS dispensed
  FROM customer LEFT JOIN o ON machine = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL""")
def plant_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plant(spark, sf_dir).rollup()


def plant(spark: SparkSession, sf_dir: str) -> Plant:
    """The test tables as a plant."""
    return Plant(
        fx.plants(spark, sf_dir), fx.shops(spark, sf_dir), fx.machines(spark, sf_dir), fx.machine_sensors(spark, sf_dir), fx.machine_metrics(spark, sf_dir),
        fx.operations(spark, sf_dir), fx.commands(spark, sf_dir), fx.event_log(spark, sf_dir), lambda: _alerts(spark, sf_dir),
    )


# ---------------------------------------------------------------- streaming


#: Rows of a page of the paged stream.
PAGE_ROWS = 1000


@registered(M)
def stream_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics through a stream of pages, each behind the (ts, seq) of the one before."""
    return pages.all_pages(spark, f"{sf_dir}/events.parquet", limit=PAGE_ROWS, topic="event_type", seq="event_id")


def _events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = fx.read(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _metrics_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events_stream(spark, sf_dir).select(F.col("event_type").alias("topic"), F.col("ts").cast("timestamp_ntz").alias("ts"), "value", F.col("event_id").alias("seq"))


@registered(f"WITH m AS ({M}) SELECT topic, time_bucket(INTERVAL '3600 seconds', ts, TIMESTAMP '1970-01-01') AS \"timestamp\", round(avg(value), 6) AS value FROM m GROUP BY 1, 2")
def stream_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(run.drain_updates(tail.downsample_stream(_metrics_stream(spark, sf_dir), 3_600_000), ["topic", "timestamp"]))


@registered(f"WITH m AS ({M}) SELECT * FROM m WHERE ts > TIMESTAMP '{SINCE}'")
def stream_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run.drain_appends(tail.after(_metrics_stream(spark, sf_dir), SINCE))


@registered(f"WITH {SESSIONS} SELECT * FROM s")
def stream_sessions_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark)
    commands = fx.commands(spark, sf_dir)
    commands.write.parquet(folder)
    stream = stream_sessions.fold_stream(spark.readStream.schema(commands.schema).parquet(folder))
    with stream_sessions.stateful(spark):
        return sessions.latest_sessions(run.drain_appends(stream))


#: Days of commands that one part of the late stream holds, days by which they come late, and the time to wait for them.
PART_DAYS, LATE_DAYS, LATENESS = 5, 3, "9 days"


@registered(f"WITH {SESSIONS} SELECT * FROM s")
def stream_sessions_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands that come up to LATE_DAYS days late, in parts that overlap in time, folded in their own order. The last
    part moves the watermark over all that is held back."""
    folder, first = scratch_folder(spark), F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz")
    commands = fx.commands(spark, sf_dir)
    part = F.floor((F.datediff("ts", first) + F.pmod(F.xxhash64("machine", "seq"), F.lit(LATE_DAYS + 1))) / PART_DAYS)
    dealt = written(commands.withColumn("_part", part))
    end = commands.limit(1).withColumn("ts", F.lit(datetime(2100, 1, 1)).cast("timestamp_ntz")).withColumn("machine", F.lit(-1).cast("bigint"))
    for (k,) in [*dealt.select("_part").distinct().orderBy("_part").collect(), (None,)]:
        (end if k is None else dealt.where(F.col("_part") == k).drop("_part")).coalesce(1).write.mode("append").parquet(folder)
    files = spark.readStream.schema(commands.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    with stream_sessions.stateful(spark):
        return sessions.latest_sessions(run.drain_appends(stream_sessions.fold_stream(files, LATENESS)))


def _in_parts(spark: SparkSession, rows: DataFrame, order: str, parts: int) -> DataFrame:
    """rows as a stream of files, each the rows of one stretch of `order`."""
    folder = scratch_folder(spark)
    dealt = written(rows.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()))
    for k in range(parts):
        dealt.where(F.col("_part") == k).drop("_part").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@registered(f"""WITH {LEDGER}, p AS (SELECT event_id AS probe, user_id AS machine, ts::TIMESTAMP - INTERVAL 1 DAY AS "at" FROM events WHERE event_type IN ('view', 'signup'))
  SELECT p.probe, p.machine, p."at", coalesce(arg_max(h.weight, h.seq), 0.0) AS weight FROM p JOIN customer ON c_custkey = machine LEFT JOIN h ON h.machine = p.machine AND h.ts <= p."at" GROUP BY ALL""")
def stream_weight_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights at a time before each view or signup, over streams of operations and probes; the last operation's time, far
    ahead, lets all probes be answered."""
    ops = fx.operations(spark, sf_dir)
    far = F.lit(datetime(2100, 1, 1)).cast("timestamp_ntz")
    end = ops.limit(1).select("machine", F.lit(1 << 40).alias("seq"), far.alias("ts"), "op", "amount")
    probes = fx.read(spark, sf_dir, "events").where("event_type in ('view', 'signup')").select(F.col("event_id").alias("probe"), F.col("user_id").alias("machine"), F.expr("cast(ts as timestamp_ntz) - interval 1 day").alias("at"))
    last = probes.limit(1).select(F.lit(-1).cast("bigint").alias("probe"), "machine", far.alias("at"))
    stream = levels.weight_at_stream(_in_parts(spark, ops.unionByName(end), "ts", 4), _in_parts(spark, probes.unionByName(last), "at", 4), fx.machines(spark, sf_dir), "20 days")
    with stream_sessions.stateful(spark):
        return run.drain_appends(stream).where("probe >= 0")


#: Metrics of a store that keeps one row for each topic and minute.
OVERWRITTEN = f"WITH m AS ({M}) SELECT topic, date_trunc('minute', ts) AS ts, arg_max(value, seq) AS value, max(seq) AS seq FROM m GROUP BY 1, 2"


def _by_minute(metrics_: DataFrame) -> DataFrame:
    return metrics_.withColumn("ts", F.date_trunc("minute", "ts").cast("timestamp_ntz"))


@registered(OVERWRITTEN)
def keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.keep_last(_by_minute(fx.metrics(spark, sf_dir)))


@registered(OVERWRITTEN)
def stream_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over a stream whose parts overlap in time: rows of one minute come in several batches."""
    shuffled = _by_minute(fx.metrics(spark, sf_dir)).withColumn("_order", F.col("seq") * 7919 % 1009)
    stream = _in_parts(spark, shuffled, "_order", 4).drop("_order")
    return run.drain_updates(levels.keep_last_stream(stream, "40 days"), ["topic", "ts"])
