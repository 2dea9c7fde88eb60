"""The thin queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.sources.tables import read_table

from . import ctw, decontaminate, embed_dedup, html_extract, langid, line_spread, mixing, periodic_runs, simhash, token_align, token_files, topk_search, toxicity
from .common import WORD, documents, fold, no_text

QUERIES: dict = {}
ORACLES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_simhash(spark, sf_dir):
    return simhash.near_duplicates(documents(spark, sf_dir, "doc_id", "text"))


@query
def op2_embedding_dedup(spark, sf_dir):
    return embed_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


ORACLES["op2_embedding_dedup"] = f"""
WITH RECURSIVE r AS (SELECT row_number() OVER () AS rid, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
v AS (SELECT * FROM r WHERE label IS NOT NULL AND len(e) > 0
      AND len([x for x in e if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in e if x <> 0]) > 0),
links AS (SELECT a.rid AS u, b.rid AS w, b.vec_id FROM v a JOIN v b ON a.label = b.label AND a.rid <> b.rid AND len(a.e) = len(b.e)
          WHERE list_cosine_similarity(a.e, b.e) >= {embed_dedup.THRESHOLD}),
reach(u, w) AS (SELECT rid, rid FROM r UNION SELECT reach.u, links.w FROM reach JOIN links ON reach.w = links.u),
comp AS (SELECT reach.u AS rid, min(r.vec_id) AS component_id FROM reach JOIN r ON r.rid = reach.w GROUP BY reach.u),
n AS (SELECT u AS rid, count(*) AS n_links FROM links GROUP BY u)
SELECT r.vec_id, coalesce(n.n_links, 0) AS n_links, comp.component_id, coalesce(r.vec_id = comp.component_id, true) AS kept
FROM r JOIN comp USING (rid) LEFT JOIN n USING (rid)"""


@query
def op3_token_files(spark, sf_dir):
    return token_files.token_files(documents(spark, sf_dir, "doc_id", "text"))


def _held_out(k):
    return F.coalesce(fold("doc_id") == k, F.lit(False))


@query
def op4_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "text").select("doc_id", no_text().alias("text"))
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.score(docs, model).select(
        "doc_id", _held_out(0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op5_ctw(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "text")
    out = ctw.score(docs, fold("doc_id") != 1)
    return out.select("doc_id", _held_out(1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score",
                      "bits_per_byte")


@query
def op6_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    model = langid.train(docs.where(fold("doc_id") != 0))
    return langid.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", _held_out(0).alias("held_out"), "lang_pred", "score")


@query
def op7_html_extract(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages", "page_id", "url", "html")
    out = html_extract.extract(pages, html_extract.train(pages))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op8_mix(spark, sf_dir):
    return mixing.mix_report(documents(spark, sf_dir, "doc_id", "text", "source"))


@query
def op9_line_spread(spark, sf_dir):
    out = line_spread.remove_spread_lines(documents(spark, sf_dir, "doc_id", "text", "source"))
    return out.select("doc_id", "spread.n_lines", "spread.n_removed", F.length("text").cast("long").alias("n_chars"),
                      F.md5(F.col("text").cast("binary")).alias("text_md5"))


ORACLES["op9_line_spread"] = f"""
WITH lines AS (
  SELECT d.rid, u.pos, u.line, trim(u.line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)) AS cut, d.source
  FROM (SELECT row_number() OVER () AS rid, coalesce(text, '') AS text, source FROM documents) d,
       LATERAL (SELECT unnest(string_split(d.text, chr(10))) AS line,
                       generate_subscripts(string_split(d.text, chr(10)), 1) AS pos) u),
bad AS (SELECT cut FROM lines WHERE cut <> '' GROUP BY cut
        HAVING count(DISTINCT source) >= {line_spread.MIN_SITES}),
per AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (WHERE cut IN (SELECT cut FROM bad)) AS n_removed,
               coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE cut NOT IN (SELECT cut FROM bad)), '') AS kept
        FROM lines GROUP BY rid)
SELECT d.doc_id, per.n_lines, per.n_removed, CAST(length(per.kept) AS BIGINT) AS n_chars, md5(per.kept) AS text_md5
FROM (SELECT row_number() OVER () AS rid, doc_id FROM documents) d JOIN per USING (rid)"""


@query
def op10_decontaminate(spark, sf_dir):
    report = decontaminate.decontaminate_report(documents(spark, sf_dir, "doc_id", "text"),
                                                read_table(spark, sf_dir, "benchmark", "item_id", "text"))
    return report.select("doc_id", "n_words", "n_hit", "n_items",
                         decontaminate.items_digest(F.col("items")).alias("items_sha256"),
                         (F.col("n_hit") > 0).alias("contaminated"))


_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES["op10_decontaminate"] = f"""
WITH items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
                      regexp_extract_all({_LOWERED}, '{_PATTERN}') AS w FROM benchmark),
wins AS (SELECT DISTINCT item, w[s:s + 9] AS win FROM (
           SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS n FROM wins),
docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWERED}, '{_PATTERN}') AS w FROM documents),
spot AS (SELECT d.rid, p.s, z.n, d.w[p.s:p.s + z.n - 1] AS win FROM docs d, sizes z,
         LATERAL (SELECT unnest(range(1, len(d.w) - z.n + 2)) AS s) p),
hit AS (SELECT spot.rid, spot.s, spot.n, wins.item FROM spot JOIN wins ON spot.win = wins.win),
spots AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM hit) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(s.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items,
       sha256(coalesce(n.ids, '')) AS items_sha256, coalesce(s.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN spots s USING (rid) LEFT JOIN named n USING (rid)"""


@query
def op11_topk_search(spark, sf_dir):
    return topk_search.top_k(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 50 == 0)


ORACLES["op11_topk_search"] = f"""
WITH v AS (SELECT row_number() OVER () AS rid, vec_id,
                  [floor(256 * x) FOR x IN CAST(embedding AS DOUBLE[])] AS e
           FROM embeddings
           WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.rid AS cid, c.vec_id,
             CAST(CASE WHEN len(q.e) = 0 THEN 0 ELSE list_inner_product(q.e, c.e) END AS BIGINT) AS score
      FROM v q JOIN v c ON q.rid <> c.rid AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id ASC NULLS LAST, cid) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {topk_search.K}"""


def with_planted_period(docs):
    """The contract's stand-in input: in a document with h % 10 = 0, word a and all after it become the p words from a on, repeated."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).cast("long").alias("g"))
    docs = docs.withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    n = F.size("w")
    docs = docs.withColumn("a", F.when(n > 0, F.col("g") % n).cast("int"))
    docs = docs.withColumn("p", (F.lit(1) + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    period = F.slice("w", F.col("a") + 1, F.col("p"))
    rest = n - F.col("a")
    tail = F.slice(F.flatten(F.array_repeat(period, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    return docs.select("doc_id", F.when(F.col("a").isNull(), F.col("text")).otherwise(
        F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")).alias("text"))


@query
def op12_periodic_runs(spark, sf_dir):
    found = periodic_runs.collapse_runs(with_planted_period(documents(spark, sf_dir, "doc_id", "text")))
    found = found.withColumn("best", periodic_runs.greatest())
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


@query
def op13_token_align(spark, sf_dir):
    return token_align.alignment_report(documents(spark, sf_dir, "doc_id", "text"))
