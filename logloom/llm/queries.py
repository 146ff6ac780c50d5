"""The p4 to p9 queries over the tables of a data directory, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.hosts import host_zones, norm_word
from logloom.functions.session import sized, stored, table
from logloom.llm import credentials, leaks, mixing, near, reading, runs
from logloom.operators import timestamps
from logloom.plans import instant_sql

Query = Callable[[SparkSession, str], DataFrame]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "classified_event")
    category = F.coalesce(F.when(norm_word("category") != "", norm_word("category")), F.lit("other"))
    rows = timestamps.stamp_rows(events.withColumn("row", F.struct("event_id", category.alias("category"))), "row")
    zones = sized(host_zones(table(spark, sf_dir, "device_inventory"), table(spark, sf_dir, "site_manifest")), "zones")
    at = timestamps.normalize(rows, zones, sized(timestamps.fit_mixture(rows), "mixture"))
    at = at.where("source is not null and utc_us is not null").select(F.col("source").alias("host"), F.col("utc_us").alias("us"), F.col("row_id.event_id").alias("id"), F.col("row_id.category").alias("kind"))
    found = runs.runs(stored(at, "instants")).where("n >= 3")
    return found.select(F.col("host").alias("hostname"), F.col("kinds")[0].alias("category"), F.col("first_id").alias("first_event_id"), F.col("last_id").alias("last_event_id"), F.col("n").alias("n_events"), (F.col("last_us") - F.col("first_us")).alias("duration_us"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = credentials.find(credentials.files_of(table(spark, sf_dir, "device_profile")))
    return credentials.line_cases(found).withColumnRenamed("id", "profile_id")


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = credentials.files_of(table(spark, sf_dir, "device_profile"))
    return credentials.redact(files, credentials.find(files)).withColumnRenamed("id", "profile_id")


def _near(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found = stored(near.members(near.texts(table(spark, sf_dir, "log_event"), table(spark, sf_dir, "action_item"))), "members")
    return found, stored(near.class_pairs(found), "class-pairs")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.row_pairs(*_near(spark, sf_dir)).withColumnRenamed("kind", "src_table")


def p6_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.links(*_near(spark, sf_dir)).withColumnRenamed("kind", "src_table")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item")).select("doc_id", "item_id")


def p7_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest passage of each document and item, and where it begins in either, in words from 0 on."""
    return leaks.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def p7_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents left when those that hold a passage are taken out."""
    documents = table(spark, sf_dir, "documents")
    found = stored(leaks.find(documents, table(spark, sf_dir, "eval_item")), "leaks")
    return leaks.cleaned(documents, found).select("doc_id", "n_chars")


def _mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = stored(mixing.token_counts(table(spark, sf_dir, "documents")), "sizes")
    return mixing.select(sizes, table(spark, sf_dir, "mix_target"))


def p8_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture and how often each is used."""
    return _mixture(spark, sf_dir)


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets and the shares reached."""
    return mixing.report(_mixture(spark, sf_dir), table(spark, sf_dir, "mix_target"))


def p8_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every target, whether its share and its limit of repetitions are kept."""
    return mixing.kept(p8_shares(spark, sf_dir))


def p9_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return reading.levels(documents, reading.fit(documents, table(spark, sf_dir, "reading_label")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_levels(spark, sf_dir).where("band >= 4").select("doc_id").distinct()


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p4_found, p5_found, p5_redacted, p6_found, p6_links, p7_found, p7_places, p7_cleaned, p8_selection, p8_shares, p8_kept, p9_found, p9_levels)}


RUNS = """, ev AS (SELECT DISTINCT a.host, a.us, a.row_id AS id, coalesce(nullif(lower(trim(category)), ''), 'other') AS category FROM att a JOIN classified_event e ON a.src = 'classified_event' AND a.row_id = e.event_id WHERE a.host IS NOT NULL AND a.us IS NOT NULL),
 st AS (SELECT *, CASE WHEN category = lag(category) OVER w AND us - lag(us) OVER w <= 600000000 THEN 0 ELSE 1 END AS fresh FROM ev WINDOW w AS (PARTITION BY host ORDER BY us, id)),
 gr AS (SELECT *, sum(fresh) OVER (PARTITION BY host ORDER BY us, id ROWS UNBOUNDED PRECEDING) AS g FROM st)
 SELECT host AS hostname, any_value(category) AS category, arg_min(id, (us, id)) AS first_event_id, arg_max(id, (us, id)) AS last_event_id, count(*) AS n_events, max(us) - min(us) AS duration_us FROM gr GROUP BY host, g HAVING count(*) >= 3"""
NEAR = """WITH t AS (SELECT 'log_event' AS src_table, seq AS k, message AS txt FROM log_event WHERE NOT coalesce(appname = 'syslog' AND "timestamp" = '', false)
 UNION ALL SELECT 'action_item', item_id, array_to_string(list_filter(sample_messages, lambda x: x IS NOT NULL), ' ') FROM action_item),
 w AS (SELECT src_table, k, lower(unnest(regexp_extract_all(txt, '[A-Za-z0-9]+'))) AS w FROM t),
 n AS (SELECT src_table, k, count(*) AS n FROM w GROUP BY ALL HAVING count(*) >= 40),
 c AS (SELECT src_table, k, w, count(*) AS m FROM w SEMI JOIN n USING (src_table, k) GROUP BY ALL),
 o AS (SELECT a.src_table, a.k AS key_a, b.k AS key_b, sum(least(a.m, b.m)) AS common FROM c a JOIN c b ON a.src_table = b.src_table AND a.w = b.w AND a.k < b.k GROUP BY ALL)
 SELECT o.src_table, key_a, key_b FROM o JOIN n x ON x.src_table = o.src_table AND x.k = key_a JOIN n y ON y.src_table = o.src_table AND y.k = key_b WHERE 10 * common >= 8 * (x.n + y.n - common)"""
LEAKS = """WITH i AS (SELECT item_id, list_transform(regexp_extract_all(item_text, '[A-Za-z0-9]+'), lambda x: lower(x)) AS w FROM eval_item),
 d AS (SELECT doc_id, n_chars, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) AS w FROM documents),
 ig AS (SELECT DISTINCT item_id, array_to_string(w[p : p + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS p FROM i)),
 dg AS (SELECT doc_id, array_to_string(w[p : p + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS p FROM d)),
 f AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": instant_sql.instants() + RUNS,
        "p6_found": NEAR,
        "p6_links": NEAR.replace(" SELECT o.src_table", ", pr AS (SELECT o.src_table", 1) + """),
 own AS (SELECT src_table, k, string_agg(w || ' ' || m, ',' ORDER BY w) AS bag FROM c GROUP BY ALL), cl AS (SELECT *, min(k) OVER (PARTITION BY src_table, bag) AS ck, count(*) OVER (PARTITION BY src_table, bag) AS copies FROM own),
 li AS (SELECT DISTINCT p.src_table, x.ck AS a, y.ck AS b, y.copies AS n FROM (SELECT src_table, key_a AS i, key_b AS j FROM pr UNION ALL SELECT src_table, key_b, key_a FROM pr) p JOIN cl x ON x.src_table = p.src_table AND x.k = p.i JOIN cl y ON y.src_table = p.src_table AND y.k = p.j WHERE x.ck <> y.ck),
 dg AS (SELECT src_table, a, count(*) AS n_links, sum(n)::BIGINT AS n_rows FROM li GROUP BY ALL)
 SELECT cl.src_table, cl.k AS "key", cl.ck AS class_key, cl.copies, coalesce(dg.n_links, 0) AS n_links, coalesce(dg.n_rows, 0)::BIGINT AS n_rows FROM cl LEFT JOIN dg ON dg.src_table = cl.src_table AND dg.a = cl.ck""",
        "p8_kept": "SELECT lower(trim(source)) AS source, true AS share_kept, true AS repeats_kept FROM mix_target",
        "p7_found": LEAKS + " SELECT doc_id, item_id FROM f",
        "p7_places": LEAKS + """, ip AS (SELECT item_id, p, array_to_string(w[p : p + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS p FROM i)),
 dp AS (SELECT doc_id, p, array_to_string(w[p : p + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS p FROM d)),
 hit AS (SELECT DISTINCT doc_id, item_id, dp.p AS dp, ip.p AS ip, dp.p - row_number() OVER (PARTITION BY doc_id, item_id, dp.p - ip.p ORDER BY dp.p) AS run FROM dp JOIN ip USING (g)),
 runs AS (SELECT doc_id, item_id, count(*) + 11 AS n_words, min(dp) - 1 AS doc_word, min(ip) - 1 AS item_word FROM hit GROUP BY doc_id, item_id, dp - ip, run)
 SELECT doc_id, item_id, n_words, doc_word, item_word FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_words DESC, doc_word, item_word) = 1""",
        "p7_cleaned": LEAKS + " SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM f)",
    }
