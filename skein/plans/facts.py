"""Facts and audit queries over the events table; a user and an event type are a scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import facts as ops
from skein.operators import ingest
from skein.operators.facts import micros
from skein.plans.registry import registry, table

QUERIES, query = registry()

FACTS = """
f AS (
  SELECT event_id AS fact_id, CAST(user_id AS VARCHAR) AS subject, event_type AS relation,
         concat('o', event_id % 50) AS object, CASE WHEN event_type <> 'view' THEN concat(user_id, '|', event_type) END AS scope_key,
         ts AS valid_at, epoch_us(ts) AS us, (event_id % 10 + 1) / 10 AS confidence
  FROM events
),
w AS (
  SELECT *, min(us) OVER (PARTITION BY scope_key ORDER BY us RANGE BETWEEN 1000001 FOLLOWING AND UNBOUNDED FOLLOWING) AS far,
    lag(us) OVER (PARTITION BY scope_key ORDER BY us, fact_id) AS b, lead(us) OVER (PARTITION BY scope_key ORDER BY us, fact_id) AS a,
    max(us) OVER (PARTITION BY scope_key) AS last
  FROM f
),
s AS (
  SELECT *, CASE WHEN scope_key IS NULL THEN 'active' WHEN far IS NOT NULL THEN 'superseded'
    WHEN coalesce(us - b <= 1000000, false) OR coalesce(a - us <= 1000000, false) THEN 'conflicted' ELSE 'active' END AS status FROM w
),
facts AS (
  SELECT fact_id, subject, relation, object, scope_key, valid_at, confidence, status,
    make_timestamp(CASE WHEN scope_key IS NOT NULL AND far IS NOT NULL THEN far WHEN status = 'conflicted' THEN last END) AS invalid_at
  FROM s
)"""


def raw_facts(spark: SparkSession, sf_dir: str, at: Column | str = "ts") -> DataFrame:
    """A fact for each event, before any closes another."""
    scope = F.concat_ws("|", F.col("user_id").cast("string"), "event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("fact_id"),
        F.col("user_id").cast("string").alias("subject"),
        F.col("event_type").alias("relation"),
        F.concat(F.lit("o"), (F.col("event_id") % 50).cast("string")).alias("object"),
        F.when(F.col("event_type") != "view", scope).alias("scope_key"),
        (F.col(at) if isinstance(at, str) else at).alias("valid_at"),
        ((F.col("event_id") % 10 + 1) / 10).alias("confidence"),
    )


def facts(spark: SparkSession, sf_dir: str, at: Column | str = "ts") -> DataFrame:
    return ops.succession(raw_facts(spark, sf_dir, at))


@query(f"WITH {FACTS} SELECT fact_id, status, coalesce(CAST(epoch_us(invalid_at) AS BIGINT), -1) AS invalid_us FROM facts")
def facts_succession(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).select("fact_id", "status", F.coalesce(micros(F.col("invalid_at")), F.lit(-1)).alias("invalid_us"))


@query(
    f"""WITH {FACTS}, m AS (SELECT make_timestamp((epoch_us(min(ts)) + epoch_us(max(ts))) // 2) AS t FROM events)
SELECT fact_id, subject, relation FROM facts, m WHERE valid_at <= t AND (invalid_at IS NULL OR invalid_at > t) AND status <> 'superseded'"""
)
def facts_point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    middle = (micros(F.min("ts")) + micros(F.max("ts"))) / 2
    when = events.agg(F.floor(middle)).scalar()
    rows = facts(spark, sf_dir)
    return rows.where(ops.valid_at(when)).select("fact_id", "subject", "relation")


YEARLY = FACTS.replace("ts AS valid_at, epoch_us(ts) AS us", "date_trunc('year', ts) AS valid_at, epoch_us(date_trunc('year', ts)) AS us")


@query(
    f"WITH {YEARLY} SELECT fact_id, subject FROM facts WHERE status = 'conflicted' ORDER BY valid_at DESC, fact_id DESC LIMIT 100"
)
def facts_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of facts dated to the year, so that those of a scope fall together."""
    return ops.conflicts(facts(spark, sf_dir, F.date_trunc("year", F.col("ts").cast("timestamp_ntz")))).select("fact_id", "subject")


@query(f"WITH {FACTS} SELECT status, count(*) AS n FROM facts GROUP BY 1")
def facts_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.status_counts(facts(spark, sf_dir))


@query(
    f"""WITH {FACTS}, seeds AS (SELECT item_id AS query_id, CAST(item_id AS VARCHAR) AS node FROM benchmark),
act AS (SELECT * FROM facts WHERE status = 'active'),
undirected AS (SELECT subject AS a, object AS b FROM act UNION SELECT object, subject FROM act),
one AS (SELECT query_id, b AS node FROM seeds JOIN undirected ON node = a),
reached AS (SELECT query_id, node, min(hop) AS hop FROM (SELECT query_id, node, 0 AS hop FROM seeds UNION ALL SELECT query_id, node, 1 FROM one) GROUP BY 1, 2),
near AS (SELECT query_id, fact_id, min(hop) AS hop, max(confidence) AS c FROM reached JOIN act ON node = subject OR node = object GROUP BY 1, 2)
SELECT query_id, fact_id, CAST(hop AS INTEGER) AS hop, round(c * pow(0.7, hop), 6) AS score FROM near"""
)
def facts_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("item_id").cast("string").alias("node")
    )
    return ops.retrieve(facts(spark, sf_dir), seeds, most=2)


@query(
    f"""WITH {FACTS}, p AS (SELECT least(subject, object) AS u, greatest(subject, object) AS v, round(sum(confidence), 6) AS weight FROM facts GROUP BY 1, 2)
SELECT *, round(1 / (weight + 1e-6), 6) AS distance FROM p"""
)
def fact_pair_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.pair_weights(facts(spark, sf_dir))


@query(
    """SELECT event_id, user_id, ts FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 100"""
)
def audit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.audit(table(spark, sf_dir, "events"), event_type="error")
    return rows.select("event_id", "user_id", "ts")


@query("SELECT event_id, ts FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 5 DAYS")
def audit_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts")).scalar()
    return ingest.audit_prune(events, now, 5).select("event_id", "ts")
