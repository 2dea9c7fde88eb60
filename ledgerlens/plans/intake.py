"""M5 - request logs, error taxonomy, retry class, client keys, URL guard,
box tags, custom fields, prompt rows, file triage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import admission as A
from ledgerlens.operators import errors as ER
from ledgerlens.plans.costs import priced_usage, with_usage
from ledgerlens.plans.registry import query

CODES = [c for c, _, _ in ER.ERROR_TAXONOMY]
_CODE_ARR = "array(" + ", ".join(f"'{c}'" for c in CODES) + ")"
_CODE_LIST = "[" + ", ".join(f"'{c}'" for c in CODES) + "]"
ROUTE_SQL = ("CASE event_type WHEN 'view' THEN 'extract' WHEN 'click' THEN 'extract-stream' "
             "WHEN 'purchase' THEN 'webhook' WHEN 'signup' THEN 'csv' ELSE 'extract' END")


def request_logs(spark, sf_dir):
    """Request-log rows from the usage rows: route by event type; error
    events carry an error code (by event id); latency from the value."""
    u = priced_usage(spark, sf_dir)
    logs = u.selectExpr(
        "event_id", "user_id", "ts", f"{ROUTE_SQL} AS route",
        f"CASE WHEN event_type = 'error' THEN element_at({_CODE_ARR}, CAST(event_id % 9 AS INT) + 1) "
        "ELSE 'success' END AS category",
        "CAST(floor(value * 10) AS BIGINT) AS duration_ms",
        "CAST(event_id % 3 AS BIGINT) AS retry_count",
        "CASE WHEN event_type = 'error' THEN CAST(NULL AS DOUBLE) ELSE cost END AS cost")
    return ER.describe_errors(logs, "category").selectExpr(
        "*", "coalesce(http_status, 200) AS status").drop("http_status").withColumnRenamed(
        "status", "http_status")


LOGS_CTE = f""",
logs AS (
  SELECT c.event_id, c.user_id, c.ts, {ROUTE_SQL.replace("event_type", "c.event_type")} AS route,
    CASE WHEN c.event_type = 'error' THEN {_CODE_LIST}[CAST(c.event_id % 9 AS INTEGER) + 1] ELSE 'success' END AS category,
    CAST(floor(e.value * 10) AS BIGINT) AS duration_ms, CAST(c.event_id % 3 AS BIGINT) AS retry_count,
    CASE WHEN c.event_type = 'error' THEN NULL ELSE c.cost END AS cost
  FROM costs c JOIN events e ON e.event_id = c.event_id),
tax AS (SELECT * FROM (VALUES {", ".join(f"('{c}', {s}, '{t.replace(chr(39), chr(39) * 2)}', '{ER.ERROR_HELP[c][0]}', '{ER.ERROR_HELP[c][1]}')" for c, s, t in ER.ERROR_TAXONOMY)}) t(code, http_status, title, message, next_step)),
logs2 AS (SELECT logs.*, coalesce(tax.http_status, 200) AS http_status, tax.title, tax.message, tax.next_step FROM logs LEFT JOIN tax ON tax.code = logs.category)"""


@query("log_rollup", with_usage(LOGS_CTE + """
SELECT route, category, count(*) AS requests, CAST(count_if(http_status >= 400) AS BIGINT) AS errors,
       round(count_if(http_status >= 400) / count(*), 6) AS error_share, CAST(sum(retry_count) AS BIGINT) AS retries,
       max(duration_ms) AS max_duration_ms,
       round(avg(duration_ms), 3) AS avg_duration_ms, round(coalesce(sum(cost), 0.0), 6) AS cost_usd
FROM logs2 GROUP BY route, category"""))
def q_log_rollup(spark, sf_dir):
    return ER.log_rollup(request_logs(spark, sf_dir))


def _exact(p: float) -> str:
    return f"CASE WHEN n <= {ER.SKETCH_K} THEN max(CASE WHEN rn = CAST(ceil({p}::DOUBLE * n) AS BIGINT) THEN duration_ms END) END"


@query("latency_percentiles", with_usage(LOGS_CTE + f""",
g AS (SELECT 'hour' AS level, route, category, strftime(ts, '%Y-%m-%d %H') AS period, duration_ms FROM logs2
      UNION ALL SELECT 'day', route, category, strftime(ts, '%Y-%m-%d'), duration_ms FROM logs2
      UNION ALL SELECT 'route', route, NULL, NULL, duration_ms FROM logs2
      UNION ALL SELECT 'all', NULL, NULL, NULL, duration_ms FROM logs2),
r AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY level, route, category, period) AS n FROM g WHERE duration_ms IS NOT NULL
      WINDOW w AS (PARTITION BY level, route, category, period ORDER BY duration_ms))
SELECT level, route, category, period, n, min(duration_ms) AS min_ms, max(duration_ms) AS max_ms, {_exact(0.5)} AS p50_ms,
       {_exact(0.95)} AS p95_ms, {_exact(0.99)} AS p99_ms, true AS within_bound
FROM r GROUP BY level, route, category, period, n"""))
def q_latency_percentiles(spark, sf_dir):
    """Latency percentiles from mergeable sketches per route, category and hour, merged to days, routes and the total. Every estimate's
    exact rank is within the bound; groups that a sketch holds whole show their (exact) values."""
    logs = request_logs(spark, sf_dir)
    ranked = ER.percentile_ranks(logs, ER.latency_percentiles(ER.latency_sketches(logs)))
    ps = "array(" + ", ".join(f"{p}D" for p in ER.PERCENTILES) + ")"
    near = f"forall(sequence(0, {len(ER.PERCENTILES) - 1}), i -> below[i] <= {ps}[i] + {ER.RANK_ERROR}D AND upto[i] >= {ps}[i] - {ER.RANK_ERROR}D)"
    whole = [f"CASE WHEN n <= {ER.SKETCH_K} THEN quantiles[{i}] END AS {name}_ms" for i, name in enumerate(("p50", "p95", "p99"))]
    return ranked.selectExpr("level", "route", "category", "period", "n", "min_ms", "max_ms", *whole, f"{near} AS within_bound")


@query("error_taxonomy_join", with_usage(LOGS_CTE + """
SELECT event_id, category AS code, CAST(http_status AS INTEGER) AS http_status, title, message, next_step FROM logs2
WHERE category <> 'success'"""))
def q_error_taxonomy(spark, sf_dir):
    return (request_logs(spark, sf_dir).filter("category <> 'success'")
            .selectExpr("event_id", "category AS code", "CAST(http_status AS INT) AS http_status", "title", "message", "next_step"))


BATCH_STATUS = ("CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'view' AND event_id % 2 = 0 "
                "THEN 'queued' WHEN event_type = 'view' THEN 'loading' ELSE 'success' END")


@query("batch_summary", with_usage(f"""
SELECT user_id AS batch_id,
  CAST(count_if(status = 'success') AS BIGINT) AS success, CAST(count_if(status = 'error') AS BIGINT) AS error,
  CAST(count_if(status IN ('queued', 'loading')) AS BIGINT) AS pending,
  round(coalesce(sum(cost), 0.0), 6) AS total_cost, bool_or(cost IS NOT NULL) AS any_cost
FROM (SELECT user_id, {BATCH_STATUS} AS status,
             CASE WHEN {BATCH_STATUS} = 'success' THEN cost END AS cost FROM costs) t
GROUP BY user_id"""))
def q_batch_summary(spark, sf_dir):
    """A8 with one batch per user; pending entries have no cost yet."""
    e = priced_usage(spark, sf_dir).selectExpr(
        "user_id AS batch_id", f"{BATCH_STATUS} AS status",
        f"CASE WHEN {BATCH_STATUS} = 'success' THEN cost END AS cost")
    return ER.batch_summary(e)


STATUS_SQL = ("CASE event_id % 7 WHEN 0 THEN 429 WHEN 1 THEN 500 WHEN 2 THEN 503 WHEN 3 THEN 400 "
              "WHEN 4 THEN 401 ELSE NULL END")
MSG_SQL = ("CASE event_id % 7 WHEN 5 THEN 'fetch failed: ECONNRESET' WHEN 6 THEN 'The operation was aborted' "
           "ELSE 'API error' END")
ERRNAME_SQL = "CASE WHEN event_id % 7 = 6 THEN 'AbortError' ELSE 'Error' END"


@query("retry_class", f"""
SELECT event_id, status, message,
  CASE WHEN status IS NOT NULL THEN (status = 429 OR (status >= 500 AND status < 600))
       WHEN error_name = 'AbortError' THEN false
       ELSE coalesce(regexp_matches(message, '(?i)network|timeout|ECONN|fetch failed'), false) END AS retryable,
  CAST(event_id % 3 AS BIGINT) AS attempt, CAST(400 * pow(2, event_id % 3) AS BIGINT) AS backoff_ms
FROM (SELECT event_id, {STATUS_SQL} AS status, {MSG_SQL} AS message, {ERRNAME_SQL} AS error_name
      FROM events WHERE event_type = 'error') t""")
def q_retry_class(spark, sf_dir):
    """P14 over failed calls (error events): provider status / message by id."""
    from ledgerlens.sources.tables import read_table
    f = read_table(spark, sf_dir, "events", "event_id", "event_type").filter("event_type = 'error'")
    f = f.selectExpr("event_id", f"{STATUS_SQL} AS status", f"{MSG_SQL} AS message",
                     f"{ERRNAME_SQL} AS error_name", "CAST(event_id % 3 AS BIGINT) AS attempt")
    return f.selectExpr("event_id", "status", "message", f"{A.retry_class_sql()} AS retryable", "attempt",
                        f"{A.backoff_ms_sql()} AS backoff_ms")


# ------------------------------------------------------------- client keys
from ledgerlens.operators import custom_fields as CF  # noqa: E402
from ledgerlens.operators import guards as G  # noqa: E402
from ledgerlens.operators import intake as IN  # noqa: E402
from ledgerlens.sources.tables import read_table  # noqa: E402

XFF_SQL = ("CASE event_id % 8 WHEN 0 THEN '203.0.113.' || CAST(user_id % 256 AS {s}) || ', 10.0.0.1' "
           "WHEN 1 THEN 'garbage, 198.51.100.' || CAST(user_id % 256 AS {s}) "
           "WHEN 2 THEN '2001:db8::' || CAST(user_id AS {s}) WHEN 3 THEN '<script>alert(1)</script>' "
           "WHEN 4 THEN '' WHEN 5 THEN NULL WHEN 6 THEN chr(9) || ' 192.0.2.' || CAST(user_id % 256 AS {s}) || ' ' "
           "ELSE '999.1.1.1, unknown' END")
REAL_SQL = "CASE event_id % 3 WHEN 0 THEN '198.51.100.7' WHEN 1 THEN 'not-an-ip' ELSE NULL END"
_V4 = r"^((25[0-5]|2[0-4]\d|[01]?\d?\d)\.){3}(25[0-5]|2[0-4]\d|[01]?\d?\d)$"


def _duck_valid(x: str) -> str:
    t = f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    return (f"CASE WHEN regexp_matches({t}, '{_V4}') THEN {t} WHEN contains({t}, ':') AND "
            f"regexp_matches({t}, '^[0-9a-fA-F:]+$') AND length({t}) <= 45 THEN {t} END")


@query("client_key", f"""
SELECT event_id, xff AS x_forwarded_for, xri AS x_real_ip,
  coalesce(CASE WHEN xff IS NOT NULL AND xff <> '' THEN
             list_filter(list_transform(string_split(xff, ','), lambda h: {_duck_valid('h')}), lambda h: h IS NOT NULL)[1] END,
           {_duck_valid('xri')}, 'unknown') AS client_key
FROM (SELECT event_id, {XFF_SQL.format(s='VARCHAR')} AS xff, {REAL_SQL} AS xri FROM events) t""")
def q_client_key(spark, sf_dir):
    """P11 over request headers derived per event (valid hops, injected
    text, IPv6, blanks)."""
    ev = read_table(spark, sf_dir, "events", "event_id", "user_id")
    h = ev.selectExpr("event_id", f"{XFF_SQL.format(s='STRING')} AS x_forwarded_for",
                      f"{REAL_SQL} AS x_real_ip")
    return h.selectExpr("*", f"{A.client_key_sql()} AS client_key")


# --------------------------------------------------------------- URL guard
# a URL per page beside its own, and the class it must have (ranges by the number in it)
_URLS = (
    ("'http://127.0.0.' || CAST(page_id % 250 AS {s}) || '/hook'", "'private-ip'"),
    ("'https://10.' || CAST(page_id % 250 AS {s}) || '.0.1/x'", "'private-ip'"),
    ("'http://172.' || CAST(10 + page_id % 30 AS {s}) || '.1.1/'", "CASE WHEN 10 + page_id % 30 BETWEEN 16 AND 31 THEN 'private-ip' ELSE 'public-ip' END"),
    ("'http://192.168.1.' || CAST(page_id % 250 AS {s})", "'private-ip'"),
    ("'http://169.254.169.254/latest/meta-data'", "'private-ip'"),
    ("'http://100.' || CAST(60 + page_id % 70 AS {s}) || '.0.1'", "CASE WHEN 60 + page_id % 70 BETWEEN 64 AND 127 THEN 'private-ip' ELSE 'public-ip' END"),
    ("'http://198.' || CAST(17 + page_id % 4 AS {s}) || '.0.1'", "CASE WHEN page_id % 4 IN (1, 2) THEN 'private-ip' ELSE 'public-ip' END"),
    ("'http://' || CAST(200 + page_id % 60 AS {s}) || '.0.0.1/'", "CASE WHEN 200 + page_id % 60 > 255 THEN 'invalid-url' WHEN 200 + page_id % 60 >= 224 THEN 'private-ip' ELSE 'public-ip' END"),
    ("'http://[::1]/'", "'private-ip'"), ("'http://[FE80::1]:8080/'", "'private-ip'"), ("'http://[::ffff:10.0.0.1]/'", "'private-ip'"),
    ("'http://[2001:db8::1]/'", "'public-ip'"), ("'ftp://files.example.com/x'", "'bad-scheme'"),
    ("'http://localhost:3000/hook'", "'blocked-host'"), ("'HTTP://Metadata.Google.Internal/'", "'blocked-host'"),
    ("'https://8.8.' || CAST(page_id % 250 AS {s}) || '.8/'", "'public-ip'"), ("'not a url'", "'invalid-url'"),
    ("'https://user:pw@93.184.216.34/x'", "'public-ip'"), ("'http://a@b@127.0.0.1/'", "'private-ip'"),
    ("'http://' || CAST(2130706432 + page_id % 1000 AS {s}) || '/'", "'private-ip'"), ("'http://0x7f.' || CAST(page_id % 99 AS {s}) || '/'", "'private-ip'"),
    ("'http://127.1/'", "'private-ip'"), ("'http://0177.0.0.1/'", "'private-ip'"), ("'http://0x08080808/'", "'public-ip'"), ("'http://1.2.3.4.5/'", "'invalid-url'"),
    ("'http://4294967296/'", "'invalid-url'"), ("'http://10.0.0.1./x'", "'private-ip'"), ("'http://127.0.0.1.example.com/'", "'needs-dns'"),
    ("'http://09.0.0.1/'", "'invalid-url'"), ("'http:///x'", "'invalid-url'"),
)


def _url_case(which: int, s: str) -> str:
    return f"CASE page_id % {len(_URLS)} " + " ".join(f"WHEN {i} THEN {u[which].format(s=s)}" for i, u in enumerate(_URLS)) + " END"


@query("url_guard", f"""
SELECT page_id, own, url, cls AS class,
  CASE cls WHEN 'bad-scheme' THEN '{G.MSG_SCHEME}' WHEN 'blocked-host' THEN '{G.MSG_HOST}'
           WHEN 'private-ip' THEN '{G.MSG_PRIVATE}' WHEN 'invalid-url' THEN 'Invalid URL.' END AS reason
FROM (SELECT page_id, false AS own, {_url_case(0, 'VARCHAR')} AS url, {_url_case(1, 'VARCHAR')} AS cls FROM pages
      UNION ALL SELECT page_id, true, url, CASE WHEN url IS NULL OR NOT regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]') THEN 'invalid-url'
        WHEN NOT regexp_matches(url, '^(?i)https?://') THEN 'bad-scheme' ELSE 'needs-dns' END FROM pages) t""")
def q_url_guard(spark, sf_dir):
    """P12 over the URL of every page and one webhook URL beside it
    (reserved ranges, spellings of addresses, schemes, blocked names)."""
    pages = read_table(spark, sf_dir, "pages", "page_id", "url")
    u = pages.selectExpr("page_id", f"inline(array(struct(false AS own, {_url_case(0, 'STRING')} AS url), struct(true AS own, url)))")
    return G.guard(u).selectExpr("page_id", "own", "url", "class").selectExpr("*", f"{G.reason_sql('class')} AS reason")


# ------------------------------------------------------------ file triage
PREFIX_HEX = ("CASE page_id % 7 WHEN 0 THEN '255044462D312E340A' WHEN 1 THEN 'FFD8FFE0' "
              "WHEN 2 THEN '89504E470D0A1A0A' WHEN 3 THEN '474946383961' WHEN 4 THEN '524946460000000057454250' "
              "WHEN 5 THEN '' ELSE '25504446' END")
MIME_SQL = ("CASE page_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'application/octet-stream' "
            "WHEN 2 THEN 'image/jpg' WHEN 3 THEN '' ELSE 'IMAGE/PNG' END")
NAME_SQL = "'doc' || CAST(page_id AS {s}) || CASE WHEN page_id % 3 = 0 THEN '.pdf' ELSE '.bin' END"
REPS_SQL = "CASE WHEN page_id % 50 = 4 THEN 4000 ELSE 1 END"


_TRIAGE = f"""
SELECT page_id, name, declared_mime, length, kind, image_mime, error_code, cap_bytes, kind = 'image' AS vision_used
FROM (SELECT *, CASE WHEN err IS NOT NULL THEN 'error' WHEN img IS NOT NULL THEN 'image' ELSE 'pdf' END AS kind,
             img AS image_mime, err AS error_code, cap AS cap_bytes
  FROM (SELECT *, CASE WHEN NOT looks_pdf AND img IS NULL THEN 'non-PDF' WHEN length > cap THEN 'oversized-PDF'
                       WHEN img IS NULL AND length = 0 THEN 'corrupt-PDF'
                       WHEN img IS NULL AND NOT starts_with(head, '255044462D') THEN 'non-PDF' END AS err
    FROM (SELECT *, CASE WHEN img IS NOT NULL THEN {IN.MAX_IMAGE_BYTES} ELSE {IN.MAX_PDF_BYTES} END AS cap
      FROM (SELECT *, CASE WHEN looks_pdf THEN NULL ELSE coalesce(
               CASE lower(declared_mime) WHEN 'image/jpeg' THEN 'image/jpeg' WHEN 'image/jpg' THEN 'image/jpeg'
                 WHEN 'image/png' THEN 'image/png' WHEN 'image/gif' THEN 'image/gif' WHEN 'image/webp' THEN 'image/webp' END,
               CASE WHEN length >= 3 AND starts_with(head, 'FFD8FF') THEN 'image/jpeg'
                    WHEN length >= 8 AND starts_with(head, '89504E47') THEN 'image/png'
                    WHEN length >= 6 AND starts_with(head, '47494638') THEN 'image/gif'
                    WHEN length >= 12 AND starts_with(head, '52494646') AND substr(head, 17, 8) = '57454250'
                    THEN 'image/webp' END) END AS img
        FROM (SELECT page_id, {NAME_SQL.format(s='VARCHAR')} AS name, {MIME_SQL} AS declared_mime,
                 CASE WHEN page_id % 11 = 0 THEN 0
                      ELSE CAST(length({PREFIX_HEX}) / 2 + octet_length(encode(html)) * {REPS_SQL} AS BIGINT) END AS length,
                 CASE WHEN page_id % 11 = 0 THEN '' ELSE substr({PREFIX_HEX} || hex(encode(html)), 1, 24) END AS head,
                 (lower({MIME_SQL}) = 'application/pdf' OR ends_with(lower({NAME_SQL.format(s='VARCHAR')}), '.pdf')) AS looks_pdf
              FROM pages) s0) s1) s2) s3) s4"""


@query("file_triage", _TRIAGE)
def q_file_triage(spark, sf_dir):
    """S1-S5, P19 over binary files built from the pages (magic-byte
    prefixes, declared types, empty files, an oversized image)."""
    t = IN.triage(page_files(spark, sf_dir))
    return t.select("page_id", "name", "declared_mime", "length", "kind", "image_mime", "error_code",
                    "cap_bytes", "vision_used")


def page_files(spark, sf_dir):
    """Files as ``read_files`` gives them, one for each page."""
    pages = read_table(spark, sf_dir, "pages", "page_id", "html")
    return pages.selectExpr(
        "page_id", f"{NAME_SQL.format(s='STRING')} AS name", f"{MIME_SQL} AS declared_mime",
        f"CASE WHEN page_id % 11 = 0 THEN X'' ELSE concat(unhex({PREFIX_HEX}), "
        f"encode(repeat(html, {REPS_SQL}), 'UTF-8')) END AS content").selectExpr(
        "*", "CAST(length(content) AS BIGINT) AS length")


_TEXT_SQL = "CASE WHEN page_id % 4 = 0 THEN ' ' || {nl} || '  ' WHEN page_id % 4 = 1 THEN NULL ELSE html END"


_ROUTING = f"""
SELECT page_id, outcome, error_code, input, input IN ('image', 'pdf') AS vision_used,
       CAST(CASE WHEN kind = 'pdf' AND input <> 'error' THEN coalesce(pages, 1) ELSE 1 END AS INTEGER) AS num_pages,
       CASE input WHEN 'image' THEN 'image-received' WHEN 'pdf' THEN 'pdf-vision-fallback' WHEN 'text' THEN 'pdf-parsed' ELSE error_code END AS category
FROM (SELECT page_id, kind, pages, outcome, CASE WHEN outcome = 'parse_failed' THEN 'corrupt-PDF' ELSE error_code END AS error_code,
        CASE WHEN error_code IS NOT NULL OR outcome = 'parse_failed' THEN 'error' WHEN kind = 'image' THEN 'image'
             WHEN outcome = 'image_only' THEN 'pdf' ELSE 'text' END AS input
      FROM (SELECT t.*, nullif(p.page_id % 6, 0) AS pages, CASE WHEN kind <> 'pdf' THEN NULL WHEN p.page_id % 10 = 3 THEN 'parse_failed'
              WHEN coalesce(regexp_replace({_TEXT_SQL.format(nl='chr(10)').replace('page_id', 'p.page_id').replace('html', 'p.html')}, '^\\s+|\\s+$', '', 'g'), '') = '' THEN 'image_only' END AS outcome
            FROM ({_TRIAGE}) t JOIN pages p ON p.page_id = t.page_id) a) b"""


@query("input_routing", _ROUTING)
def q_input_routing(spark, sf_dir):
    """The files of ``file_triage`` with a text layer beside each PDF (some blank, some missing, some unreadable)."""
    text = read_table(spark, sf_dir, "pages", "page_id", "html").selectExpr(
        "page_id", f"{_TEXT_SQL.format(nl='char(10)')} AS pdf_text", "CAST(nullif(page_id % 6, 0) AS INT) AS pdf_pages", "page_id % 10 = 3 AS pdf_failed")
    return IN.route(q_file_triage(spark, sf_dir).join(text, "page_id")).select(
        "page_id", "outcome", "error_code", "input", "vision_used", "num_pages", "category")


# ----------------------------------------------------------- custom fields
from ledgerlens.plans.evidence import TEXT_CTE  # noqa: E402
from ledgerlens.plans.oracle_base import with_base  # noqa: E402
from ledgerlens.operators.extraction import render_text  # noqa: E402
from ledgerlens.sources.invoices import AS_OF, invoice_records  # noqa: E402

_TYPE_LIST = "'string', 'number', 'date'"
_SPLIT = "[.,;:!?]+"


def definition_lists(spark, sf_dir):
    """Each turn of a conversation is one tenant's settings: a JSON array of custom-field definitions, one for each stretch between
    punctuation marks of the whole text. Names and descriptions that break a limit, unknown types and too long lists occur."""
    conv = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    defs = (f"transform(filter(split(coalesce(text, ''), '{_SPLIT}'), p -> trim(p) <> ''), (p, i) -> named_struct("
            "'id', concat('cf-', CAST(conv_id AS STRING), '-', CAST(turn AS STRING), '-', CAST(i AS STRING)), "
            "'name', CASE WHEN length(p) % 43 = 0 THEN concat(p, ' ', md5(p)) WHEN length(p) % 5 = 0 THEN concat('  Field ', substr(md5(p), 1, 8), ' ') "
            "ELSE concat('Field ', substr(md5(p), 1, 8)) END, "
            f"'type', CASE WHEN length(p) % 47 = 0 THEN 'text' ELSE element_at(array({_TYPE_LIST}), CAST((conv_id + turn + i) % 3 AS INT) + 1) END, "
            "'description', CASE WHEN length(p) % 41 = 0 THEN 'x' ELSE concat(coalesce(role, 'a'), ' turn, ', CAST(length(p) AS STRING), ' characters, ', md5(p)) END))")
    return conv.selectExpr("conv_id", "turn", f"to_json({defs}) AS defs_json")


def checked_definitions(spark, sf_dir):
    return CF.check_definitions(definition_lists(spark, sf_dir), "defs_json").drop("defs_json")


def numbered_tenants(spark, sf_dir, settings=None):
    """(conv_id, turn, tenant): every turn of a conversation once, numbered from 0 without gaps, with its ``settings`` (conv_id, turn,
    ...); and how many there are. Written to the shared folder, so that the planner knows its size when it chooses a join."""
    import uuid

    from ledgerlens.operators.prefix import running_sum
    from ledgerlens.session import ensure_checkpoint_dir
    turns = read_table(spark, sf_dir, "conversations", "conv_id", "turn").distinct().selectExpr("conv_id", "turn", "0 AS one", "1D AS w")
    found = running_sum(turns, "w", ["one"], ["conv_id", "turn"], "before").selectExpr("conv_id", "turn", "CAST(before AS BIGINT) AS tenant")
    if settings is not None:
        found = found.join(settings, ["conv_id", "turn"], "left")
    path = f"{ensure_checkpoint_dir(spark)}/tenants-{uuid.uuid4().hex}"
    found.write.parquet(path)
    stored = spark.read.schema(found.schema).parquet(path)
    return stored, stored.count()


def document_tenants(spark, sf_dir, docs, settings=None):
    """Deals the documents out to the tenants in turn (by order key); every document is kept, without tenants too. ``settings``
    (conv_id, turn, ...) come along, where a tenant has them."""
    tenants, n = numbered_tenants(spark, sf_dir, settings)
    return docs.withColumn("tenant", F.expr(f"order_key % nullif({n}L, 0)")).join(tenants, "tenant", "left").drop("tenant")


DEFS_CTE = f""",
d0 AS (SELECT conv_id, turn, role, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPLIT}'), lambda p: trim(p) <> '') AS ps FROM conversations),
d1 AS (SELECT conv_id, turn, role, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS i FROM d0),
d3 AS (SELECT conv_id, turn, i, 'cf-' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) || '-' || CAST(i AS VARCHAR) AS id,
         CASE WHEN length(p) % 43 = 0 THEN p || ' ' || md5(p) WHEN length(p) % 5 = 0 THEN '  Field ' || substr(md5(p), 1, 8) || ' '
              ELSE 'Field ' || substr(md5(p), 1, 8) END AS name,
         CASE WHEN length(p) % 47 = 0 THEN 'text' ELSE [{_TYPE_LIST}][CAST((conv_id + turn + i) % 3 AS INTEGER) + 1] END AS type,
         CASE WHEN length(p) % 41 = 0 THEN 'x' ELSE coalesce(role, 'a') || ' turn, ' || CAST(length(p) AS VARCHAR) || ' characters, ' || md5(p) END AS description,
         length(p) % 43 <> 0 AND length(p) % 47 <> 0 AND length(p) % 41 <> 0 AS ok FROM d1),
tenants AS (SELECT d0.conv_id, d0.turn, len(ps) AS n_fields,
              CASE WHEN len(ps) > 10 THEN 'too-many' WHEN coalesce(b.bad, false) THEN 'invalid-entry' END AS reason
            FROM d0 LEFT JOIN (SELECT conv_id, turn, bool_or(NOT ok) AS bad FROM d3 GROUP BY ALL) b ON b.conv_id = d0.conv_id AND b.turn = d0.turn),
tenant_no AS (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS n
              FROM (SELECT DISTINCT conv_id, turn FROM conversations) t),
doc_tenant AS (SELECT inv.k, z.conv_id, z.turn FROM inv
               LEFT JOIN tenant_no z ON z.n = inv.k % (SELECT count(*) FROM tenant_no))"""


@query("custom_fields", with_base(DEFS_CTE + """
SELECT conv_id, turn, CAST(n_fields AS INTEGER) AS n_fields, reason IS NULL AS valid, reason FROM tenants"""))
def q_custom_fields(spark, sf_dir):
    """P5 over each tenant's definition list (JSON text)."""
    return checked_definitions(spark, sf_dir).selectExpr(
        "conv_id", "turn", "size(defs) AS n_fields", "reason IS NULL AS valid", "reason")


def _shown_fields(spark, sf_dir):
    """The records with the values that custom fields show, and no others: they travel to their tenants."""
    return invoice_records(spark, sf_dir).selectExpr(
        "doc_id", "order_key", "named_struct('total', named_struct('value', record.total.value), 'due_date', named_struct('value', record.due_date.value), "
        "'vendor', named_struct('name', record.vendor.name)) AS record")


def _value_sql(kind: str, r: str = "record") -> str:
    from ledgerlens.functions.sql import js_number
    return (f"CASE {kind} WHEN 'number' THEN {js_number(f'{r}.total.value')} "
            f"WHEN 'date' THEN {r}.due_date.value ELSE {r}.vendor.name END")


@query("custom_field_values", with_base(DEFS_CTE + """
SELECT inv.doc_id, CAST(d3.i AS INTEGER) AS pos,
       coalesce(nullif(regexp_replace(d3.name, '^\\s+|\\s+$', '', 'g'), ''), d3.id) AS label,
       CASE d3.type WHEN 'number' THEN regexp_replace(CAST(inv.total AS VARCHAR), '\\.0$', '')
                    WHEN 'date' THEN inv.due ELSE inv.vendor_name END AS value
FROM inv JOIN doc_tenant dt ON dt.k = inv.k JOIN tenants t ON t.conv_id = dt.conv_id AND t.turn = dt.turn AND t.reason IS NULL
JOIN d3 ON d3.conv_id = t.conv_id AND d3.turn = t.turn
WHERE (inv.k + d3.i) % 5 <> 0"""))
def q_custom_field_values(spark, sf_dir):
    """J5 + P7: each document's extracted custom values with its tenant's valid definitions by id, in definition order. Every
    fifth field (by key and place) was not extracted and is absent; others may be present with a null value."""
    defs = (checked_definitions(spark, sf_dir).filter("reason IS NULL")
            .selectExpr("conv_id", "turn", "posexplode(defs) AS (pos, d)")
            .selectExpr("struct(conv_id, turn) AS tenant", "pos", "d.id AS id", "d.name AS name", "d.type AS type"))
    docs = document_tenants(spark, sf_dir, _shown_fields(spark, sf_dir)).selectExpr(
        "doc_id", "order_key", "struct(conv_id, turn) AS tenant", "record")
    values = (docs.join(defs.select("tenant", "pos", "id", "type"), "tenant").where("(order_key + pos) % 5 <> 0")
              .selectExpr("doc_id", "tenant", "id", f"{_value_sql('type')} AS value"))
    return CF.display_values(defs.select("tenant", "pos", "id", "name"), values).selectExpr(
        "doc_id", "CAST(pos AS INT) AS pos", "label", "value")


_HEAD = CF.CUSTOM_BLOCK_HEAD.replace("'", "''").replace("\n", "' || chr(10) || '")


@query("prompt_rows", with_base(TEXT_CTE + DEFS_CTE + f""",
blocks AS (SELECT t.conv_id, t.turn, '{_HEAD}' || string_agg('- ID "' || d3.id || '" (' || d3.type || ', displayed as "' ||
             regexp_replace(d3.name, '^\\s+|\\s+$', '', 'g') || '"): ' ||
             regexp_replace(d3.description, '^\\s+|\\s+$', '', 'g'), chr(10) ORDER BY d3.i) AS block
           FROM tenants t JOIN d3 ON d3.conv_id = t.conv_id AND d3.turn = t.turn WHERE t.reason IS NULL GROUP BY t.conv_id, t.turn),
p AS (SELECT texts.doc_id, '<today>{AS_OF}</today>' || chr(10) || '<invoice_text>' || chr(10) || texts.text || chr(10) ||
             '</invoice_text>' || chr(10) || chr(10) || '{CF.PROMPT_INSTRUCTION}' || coalesce(b.block, '') AS prompt
      FROM texts JOIN doc_tenant dt ON dt.k = texts.k LEFT JOIN blocks b ON b.conv_id = dt.conv_id AND b.turn = dt.turn)
SELECT doc_id, CAST(length(prompt) AS INTEGER) AS prompt_chars, md5(prompt) AS prompt_md5 FROM p"""))
def q_prompt_rows(spark, sf_dir):
    """Prompt per document for batch inference: today tag, document
    text, instruction, the tenant's custom-field block. One projection of the records; definitions join on the tenant."""
    blocks = checked_definitions(spark, sf_dir).filter("reason IS NULL").selectExpr(
        "conv_id", "turn", f"{CF.custom_block_sql('defs')} AS block")
    rec = document_tenants(spark, sf_dir, invoice_records(spark, sf_dir).select("doc_id", "order_key", "record"), blocks)
    p = render_text(rec, "block").selectExpr(
        "doc_id", f"{CF.prompt_sql('text', repr(AS_OF), "coalesce(block, '')")} AS prompt")
    return p.selectExpr("doc_id", "CAST(char_length(prompt) AS INT) AS prompt_chars", "md5(prompt) AS prompt_md5")


_LAYER = _TEXT_SQL.format(nl="chr(10)").replace("page_id", "p.page_id").replace("html", "p.html")
_ASK = "'<today>" + AS_OF + "</today>' || chr(10) || chr(10) || "


@query("prompt_parts", f"""
WITH routed AS ({_ROUTING}),
triaged AS ({_TRIAGE}),
files AS (SELECT r.page_id, r.input, t.image_mime, {_LAYER} AS layer,
            to_base64(unhex(CASE WHEN p.page_id % 11 = 0 THEN '' ELSE {PREFIX_HEX.replace("page_id", "p.page_id")} ||
              repeat(hex(encode(p.html)), {REPS_SQL.replace("page_id", "p.page_id")}) END)) AS data
          FROM routed r JOIN triaged t ON t.page_id = r.page_id JOIN pages p ON p.page_id = r.page_id WHERE r.input <> 'error')
SELECT page_id, input, CASE input WHEN 'text' THEN 1 ELSE 2 END AS n_parts,
  CASE input WHEN 'image' THEN image_mime WHEN 'pdf' THEN 'application/pdf' END AS media_type,
  CASE WHEN input <> 'text' THEN md5(data) END AS data_md5,
  md5(CASE input WHEN 'text' THEN '<today>{AS_OF}</today>' || chr(10) || '<invoice_text>' || chr(10) || layer || chr(10) || '</invoice_text>' ||
        chr(10) || chr(10) || '{CF.PROMPT_INSTRUCTION}'
      WHEN 'image' THEN {_ASK} '{CF.IMAGE_INSTRUCTION.replace("'", "''")}'
      ELSE {_ASK} '{CF.PDF_INSTRUCTION.replace("'", "''")}' END) AS text_md5
FROM files""")
def q_prompt_parts(spark, sf_dir):
    """P13 for the files of ``input_routing``: texts, images and scanned PDFs, each as the parts that a model is sent."""
    text = read_table(spark, sf_dir, "pages", "page_id", "html").selectExpr(
        "page_id", f"{_TEXT_SQL.format(nl='char(10)')} AS pdf_text", "CAST(nullif(page_id % 6, 0) AS INT) AS pdf_pages", "page_id % 10 = 3 AS pdf_failed")
    routed = IN.route(IN.triage(page_files(spark, sf_dir)).join(text, "page_id")).where("input <> 'error'")
    parts = routed.selectExpr("page_id", "input", f"{CF.prompt_parts_sql('input', 'pdf_text', 'image_mime', 'content', repr(AS_OF), chr(39) * 2)} AS parts")
    return parts.selectExpr("page_id", "input", "size(parts) AS n_parts", "parts[0].media_type AS media_type", "md5(parts[0].data) AS data_md5",
                            "md5(element_at(parts, -1).text) AS text_md5")


_SLOT = "(order_key + pos) % 11"



def custom_responses(spark, sf_dir, docs, defs):
    """Stand-in for a model's answers: JSON with a custom field for each definition of the document's tenant; some are absent, of a
    wrong kind, with an unknown confidence, without reasoning, null or no object."""
    from ledgerlens.functions.sql import json_string
    slot = _SLOT.replace("pos", "d.pos")
    value = (f"CASE d.type WHEN 'number' THEN coalesce(CAST(record.total.value AS STRING), 'null') WHEN 'date' THEN {json_string('record.due_date.value')} "
             f"ELSE {json_string('record.vendor.name')} END")
    wrong = "CASE d.type WHEN 'number' THEN '\"12\"' ELSE '12' END"
    body = f"""CASE {slot} WHEN 5 THEN '"x"' ELSE concat('{{"value":', CASE {slot} WHEN 1 THEN {wrong} WHEN 4 THEN 'null' ELSE {value} END,
               ',"confidence":"', CASE {slot} WHEN 2 THEN 'sure' ELSE 'high' END, '"', CASE {slot} WHEN 3 THEN '' ELSE ',"reasoning":"r"' END, '}}') END"""
    # a document meets its tenant's definitions as one array: no row for each field, nothing to gather again by document
    fields = docs.join(CF.definition_arrays(defs, "pos", "id", "type"), "tenant", "left").selectExpr(
        "doc_id", "tenant", "order_key", f"transform(filter(ds, d -> {slot} <> 0), d -> concat('\"', d.id, '\":', {body})) AS fs")
    return fields.selectExpr(
        "doc_id", "tenant", "CASE WHEN order_key % 29 = 0 THEN '{broken' WHEN coalesce(size(fs), 0) <= 0 THEN '{}' "
        "ELSE concat('{\"custom_fields\":{', array_join(sort_array(fs), ','), '}}') END AS response")


@query("custom_field_records", with_base(DEFS_CTE + """,
f AS (SELECT inv.doc_id, d3.i, d3.type, inv.k % 29 = 0 AS broken, (inv.k + d3.i) % 11 AS slot, inv.total, inv.due, inv.vendor_name
      FROM inv JOIN doc_tenant dt ON dt.k = inv.k JOIN tenants t ON t.conv_id = dt.conv_id AND t.turn = dt.turn AND t.reason IS NULL
      JOIN d3 ON d3.conv_id = t.conv_id AND d3.turn = t.turn),
r AS (SELECT *, CASE WHEN broken THEN 'invalid-json' WHEN slot IN (0, 3) THEN 'missing-key' WHEN slot IN (1, 5) THEN 'wrong-type'
                     WHEN slot = 2 THEN 'bad-enum' END AS reason FROM f)
SELECT doc_id, CAST(i AS INTEGER) AS pos, type, CASE WHEN reason IS NULL AND slot <> 4 AND type = 'number' THEN total END AS number_value,
       CASE WHEN reason IS NULL AND slot <> 4 THEN CASE type WHEN 'date' THEN due WHEN 'string' THEN vendor_name END END AS text_value, reason
FROM r"""))
def q_custom_field_records(spark, sf_dir):
    """P6 + U1: each document's custom fields read from JSON by its tenant's types; wrong ones rejected with a reason."""
    defs = (checked_definitions(spark, sf_dir).filter("reason IS NULL").selectExpr("conv_id", "turn", "posexplode(defs) AS (pos, d)")
            .selectExpr("struct(conv_id, turn) AS tenant", "pos", "d.id AS id", "d.type AS type"))
    docs = document_tenants(spark, sf_dir, _shown_fields(spark, sf_dir)).selectExpr(
        "doc_id", "order_key", "struct(conv_id, turn) AS tenant", "record")
    return CF.typed_values(custom_responses(spark, sf_dir, docs, defs), defs).selectExpr(
        "doc_id", "CAST(pos AS INT) AS pos", "type", "number_value", "text_value", "reason")
