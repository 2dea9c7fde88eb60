"""URL address guard (P12): scheme http/https only; two blocked host
names; literal IPv4 in reserved ranges; IPv6 loopback, unspecified,
link-local, unique-local and IPv4-mapped forms. Host names that need a DNS
lookup are classed ``needs-dns`` (resolution is network work, not built).
As a browser would, the last ``@`` ends the user part, and a host that ends
in a number is an IPv4 address in any of its spellings. No per-row Python."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Host names refused outright.
BLOCKED_HOSTS = ("localhost", "metadata.google.internal")

MSG_SCHEME = "Webhook URL must use http or https."
MSG_HOST = "Webhook URL host is not allowed."
MSG_PRIVATE = "Webhook URL resolves to a private or reserved address."

#: Scheme and authority; a backslash ends the authority as a slash does.
URL_RE = r"^([A-Za-z][A-Za-z0-9+.-]*):[/\\\\\\\\]{2}([^/?#\\\\\\\\]*)"
V4_RE = r"^(25[0-5]|2[0-4]\\d|1\\d\\d|[1-9]?\\d)(\\.(25[0-5]|2[0-4]\\d|1\\d\\d|[1-9]?\\d)){3}$"
#: A host whose last label is a number is an IPv4 address, in one to four parts, each decimal, octal or hexadecimal.
V4_LABEL = r"(0[xX][0-9a-fA-F]*|[0-9]+)"


def private_v4_sql(a: str, b: str) -> str:
    """Reserved ranges by the first two numbers."""
    return (f"({a} = 127 OR {a} = 10 OR ({a} = 172 AND {b} BETWEEN 16 AND 31) OR ({a} = 192 AND {b} = 168) "
            f"OR ({a} = 169 AND {b} = 254) OR ({a} = 100 AND {b} BETWEEN 64 AND 127) "
            f"OR ({a} = 198 AND {b} IN (18, 19)) OR {a} = 0 OR {a} >= 224)")


def guard(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``scheme``, ``host`` (as written, lower case, without user part and port) and ``class``. Each part is computed once, in
    a projection of its own."""
    cols = df.columns
    x = df.selectExpr("*", f"lower(nullif(regexp_extract({url}, '{URL_RE}', 1), '')) AS scheme",
                      f"regexp_replace(regexp_extract({url}, '{URL_RE}', 2), '^.*@', '') AS _at")
    x = x.selectExpr(*cols, "scheme", r"lower(regexp_extract(_at, '^(\\[[^\\]]*\\]|[^:]*)', 1)) AS host")
    x = x.selectExpr("*", r"split(regexp_replace(host, '\\.$', ''), '\\.') AS _parts")
    x = x.selectExpr("*", f"coalesce(element_at(_parts, -1) RLIKE '^{V4_LABEL}$', false) AS _v4", f"forall(_parts, p -> p RLIKE '^{V4_LABEL}$') AS _all")
    number = ("CASE WHEN p RLIKE '^0[xX]' THEN CAST(conv(concat('0', substr(p, 3)), 16, 10) AS DECIMAL(20, 0)) "
              "WHEN p RLIKE '^0[0-7]+$' THEN CAST(conv(p, 8, 10) AS DECIMAL(20, 0)) "
              "WHEN p RLIKE '^(0|[1-9][0-9]*)$' THEN try_cast(p AS DECIMAL(20, 0)) END")
    x = x.selectExpr("*", f"CASE WHEN _v4 AND _all AND size(_parts) <= 4 THEN transform(_parts, p -> {number}) END AS _n")
    fits = ("forall(_n, v -> v IS NOT NULL) AND forall(slice(_n, 1, size(_n) - 1), v -> v <= 255) "
            "AND element_at(_n, -1) < CAST(pow(256, 5 - size(_n)) AS DECIMAL(20, 0))")
    x = x.selectExpr("*", f"CASE WHEN {fits} THEN CAST(aggregate(slice(_n, 1, size(_n) - 1), 0D, (s, v) -> s * 256 + v) * pow(256, 5 - size(_n)) "
                          "+ element_at(_n, -1) AS BIGINT) END AS _ip")
    x = x.selectExpr("*", r"regexp_replace(host, '^\\[|\\]$', '') AS _bare").selectExpr(
        "*", f"CASE WHEN startswith(_bare, '::ffff:') AND substr(_bare, 8) RLIKE '{V4_RE}' THEN split(substr(_bare, 8), '\\\\.') END AS _mapped")
    blocked = ", ".join(f"'{h}'" for h in BLOCKED_HOSTS)
    v6 = ("_bare IN ('::1', '::') OR startswith(_bare, 'fe80:') OR startswith(_bare, 'fc') OR startswith(_bare, 'fd') "
          f"OR coalesce({private_v4_sql('CAST(_mapped[0] AS INT)', 'CAST(_mapped[1] AS INT)')}, false)")
    cls = ("CASE WHEN scheme IS NULL THEN 'invalid-url' WHEN scheme NOT IN ('http', 'https') THEN 'bad-scheme' "
           f"WHEN host = '' THEN 'invalid-url' WHEN host IN ({blocked}) THEN 'blocked-host' "
           f"WHEN startswith(host, '[') THEN CASE WHEN {v6} THEN 'private-ip' ELSE 'public-ip' END "
           "WHEN _v4 AND _ip IS NULL THEN 'invalid-url' "
           f"WHEN _v4 THEN CASE WHEN {private_v4_sql('(_ip div 16777216)', '(_ip div 65536 % 256)')} THEN 'private-ip' ELSE 'public-ip' END "
           "ELSE 'needs-dns' END")
    return x.selectExpr(*cols, "scheme", "host", f"{cls} AS class")


def reason_sql(cls: str) -> str:
    return (f"CASE {cls} WHEN 'bad-scheme' THEN '{MSG_SCHEME}' WHEN 'blocked-host' THEN '{MSG_HOST}' "
            f"WHEN 'private-ip' THEN '{MSG_PRIVATE}' WHEN 'invalid-url' THEN 'Invalid URL.' END")
