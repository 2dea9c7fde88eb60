"""Request admission: client key from headers (P11), sliding-window
admission with feedback (W3, fold in ``folds``), sliding request count
without feedback (W3b), retryable-failure class (P14)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.sql import js_trim
from ledgerlens.operators.folds import sliding_window_admission

IPV4_RE = r"^((25[0-5]|2[0-4]\\d|[01]?\\d?\\d)\\.){3}(25[0-5]|2[0-4]\\d|[01]?\\d?\\d)$"
IPV6_RE = r"^[0-9a-fA-F:]+$"

# The app's two limits (requests, window) per client key.
EXTRACT_LIMIT = (20, 3_600_000_000)
INQUIRY_LIMIT = (10, 3_600_000_000)
DAY_US = 86_400_000_000


def valid_ip_sql(x: str) -> str:
    t = js_trim(x)
    return (f"CASE WHEN {t} RLIKE '{IPV4_RE}' THEN {t} "
            f"WHEN instr({t}, ':') > 0 AND {t} RLIKE '{IPV6_RE}' AND char_length({t}) <= 45 THEN {t} END")


def client_key_sql(xff: str = "x_forwarded_for", real: str = "x_real_ip") -> str:
    """First valid IPv4/IPv6-looking hop of ``x-forwarded-for``, else a
    valid ``x-real-ip``, else ``unknown``."""
    first = (f"try_element_at(filter(transform(split({xff}, ','), h -> {valid_ip_sql('h')}), "
             f"h -> h IS NOT NULL), 1)")
    return (f"coalesce(CASE WHEN {xff} IS NOT NULL AND {xff} <> '' THEN {first} END, "
            f"{valid_ip_sql(real)}, 'unknown')")


def admit(requests: DataFrame, key: str = "key", ts_us: str = "ts_us", order=("event_id",),
          limit: int = EXTRACT_LIMIT[0], window_us: int = EXTRACT_LIMIT[1]) -> DataFrame:
    """W3 over a request table."""
    return sliding_window_admission(requests, [key], ts_us, list(order), limit, window_us)


def sliding_count(requests: DataFrame, key: str = "key", ts_us: str = "ts_us", id_col: str = "event_id",
                  window_us: int = EXTRACT_LIMIT[1], num_partitions: int | None = None) -> DataFrame:
    """Requests of the key in ``(now - window, now]`` counting every
    call (monitoring: no feedback), as the RANGE frame ``count(*) OVER
    (PARTITION BY key ORDER BY ts RANGE BETWEEN window-1 PRECEDING AND
    CURRENT ROW)`` on epoch microseconds.

    Skew-proof form: count = rank(now) - rank(now - window), where rank(x)
    is the number of the key's requests at or before x. Each request adds
    two weight-0 probe rows (at now and now - window) ordered after the
    requests of the same instant; one distributed prefix sum over requests +
    probes (range partitions, no key in one task) gives both ranks."""
    from ledgerlens.operators.prefix import running_sum
    base = requests.selectExpr(f"{key} AS _k", f"{ts_us} AS _t", f"{id_col} AS _id")
    data = base.selectExpr("_k", "_t", "0 AS _kind", "_id", "0 AS _which", "1D AS _w")
    probes = base.selectExpr("_k", f"explode(array(named_struct('t', _t, 'which', 0), "
                                    f"named_struct('t', _t - {window_us}L, 'which', 1))) AS p", "_id").selectExpr(
        "_k", "p.t AS _t", "1 AS _kind", "_id", "p.which AS _which", "0D AS _w")
    rs = running_sum(data.unionByName(probes), "_w", ["_k"], ["_t", "_kind", "_id", "_which"], "_rank",
                     num_partitions=num_partitions)
    # equal requests (one key, instant and id) have equal probes, so the ranks are the same for each
    counts = (rs.filter("_kind = 1").selectExpr("_k", "_id", f"CASE WHEN _which = 0 THEN _t ELSE _t + {window_us}L END AS _at",
                                                "_which", "_rank").groupBy("_k", "_id", "_at")
              .agg(F.expr("CAST(max(CASE WHEN _which = 0 THEN _rank END) - max(CASE WHEN _which = 1 THEN _rank END) AS BIGINT)")
                   .alias("n_in_window")))
    same = [F.col(key).eqNullSafe(F.col("_k")), F.col(ts_us) == F.col("_at"), F.col(id_col) == F.col("_id")]
    return requests.join(counts, same).drop("_k", "_id", "_at")


def retry_class_sql(status: str = "status", message: str = "message", name: str = "error_name") -> str:
    """429 or 5xx -> retry; other API status -> no; abort -> no; else a
    message that looks like a network failure -> retry."""
    return (f"CASE WHEN {status} IS NOT NULL THEN ({status} = 429 OR ({status} >= 500 AND {status} < 600)) "
            f"WHEN {name} = 'AbortError' THEN false "
            f"ELSE coalesce({message} RLIKE '(?i)network|timeout|ECONN|fetch failed', false) END")


def backoff_ms_sql(attempt: str = "attempt") -> str:
    return f"CAST(400 * pow(2, {attempt}) AS BIGINT)"
