"""Messages, list edits, snapshots and actions derived from the given tables by expressions that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import shared_folder, stored

__all__ = ["shared_folder", "stored"]
T0 = 1704067200
#: What a message says, by event_id % 16. {n} is the event's number.
CONTENT = (
    "concat('see https://site', n, '.example.com/docs')",
    "concat('join here https://discord.gg/code', k)",
    "concat('join https://discord.gg/code', k, ' now')",
    "'discord:/#/@%64%69%73%63%6F%72%64%2E%67%67%2F%61%62%63%31%32%33'",
    "concat('>', chr(10), 'ht', chr(10), 'tp', chr(10), '://bug', n, '.pages.dev')",
    "concat('https://site', n, chr(12290), 'example', chr(12290), 'com/docs')",
    "concat('http://bug', n, '.pages.dev')",
    "concat('need help? open a ticket at https://site', n, '.example.com')",
    "concat('https://dis', chr(8203), 'cord.gg/code', k)",
    "concat('> **https://site', n, '.example.com/a**')",
    "concat('(https://h', k, '.blocked.example.com/x), thanks!')",
    "concat('just words, number ', n)",
    "concat('go to www.site', n, '.example.org.')",
    "concat('https://discord.com/invite/code', k)",
    "concat('http://h', k, '.blocked.example.com')",
    "concat('https://site', n, '.example.com and https://h', k, '.allowed.example.com/b?c=1')",
)


#: How many sites the messages name where no number of pages is given.
SITES = 1009


def content_sql(sites: int | str = SITES) -> str:
    cases = " ".join(f"WHEN {i} THEN {c.replace('n,', f'CAST(event_id % {sites} AS VARCHAR(9)),').replace('n)', f'CAST(event_id % {sites} AS VARCHAR(9)))').replace('k)', 'CAST(event_id % 13 AS VARCHAR(9)))').replace('k,', 'CAST(event_id % 13 AS VARCHAR(9)),')}" for i, c in enumerate(CONTENT))
    return f"CASE event_id % 16 {cases} END"


def messages_sql(sites: int | str = SITES) -> str:
    return f"""SELECT event_id AS message_id, {T0} + event_id * 7 AS epoch, user_id % 20 AS guild_id, event_id % 50 AS channel_id, user_id,
        concat('user', CAST(user_id AS VARCHAR(19))) AS user_name, event_type = 'error' AS author_is_bot, {T0} + user_id * 100 - 700000 AS created, {content_sql(sites)} AS content FROM events"""


def ops_sql() -> str:
    """List edits: a domain or a server number, on one of two lists, added twice as often as removed."""
    return f"""SELECT event_id AS seq, {T0} + event_id * 7 AS epoch, CASE WHEN event_id % 4 = 3 THEN 'server' ELSE 'domain' END AS entry_type,
        CASE WHEN user_id % 2 = 0 THEN 'allowlist' ELSE 'blocklist' END AS list_name, CASE WHEN event_id % 3 = 2 THEN 'remove' ELSE 'add' END AS action,
        CASE WHEN event_id % 4 = 3 THEN CAST(event_id % 17 AS VARCHAR(9)) ELSE concat('h', CAST(event_id % 13 AS VARCHAR(9)), '.example.com') END AS value FROM events"""


def list_edits_sql() -> str:
    """Edits of the lists that verdicts go by: the same domains and servers as in domain_list and server_list come and go, at times on the other list."""
    n = "CAST((event_id - event_id % 100) / 100 AS BIGINT)"
    round_ = "CAST((event_id - event_id % 600) / 600 AS BIGINT)"
    value = f"CASE {n} % 6 WHEN 0 THEN 'blocked.example.com' WHEN 1 THEN 'allowed.example.com' WHEN 2 THEN 'site7.example.com' WHEN 3 THEN '40' WHEN 4 THEN '10' ELSE '20' END"
    return f"""SELECT event_id AS seq, {T0} + event_id * 7 AS epoch, CASE WHEN {n} % 6 < 3 THEN 'domain' ELSE 'server' END AS entry_type,
        CASE WHEN ({n} % 3 = 0) = ({round_} % 5 < 3) THEN 'blocklist' ELSE 'allowlist' END AS list_name, CASE WHEN {round_} % 3 = 2 THEN 'remove' ELSE 'add' END AS action, {value} AS value
        FROM events WHERE event_id % 100 = 3"""


def list_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, list_edits_sql()).withColumn("ts", F.timestamp_seconds("epoch"))


def _view(spark: SparkSession, sf_dir: str, sql: str, events: DataFrame | None = None) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet") if events is None else events
    return spark.sql(sql.replace("FROM events", "FROM {events}").replace("chr(12290)", "'。'").replace("chr(8203)", "'​'"), events=events)


def messages(spark: SparkSession, sf_dir: str, sites: int = SITES, events: DataFrame | None = None) -> DataFrame:
    """Messages of the events table, or of a stream of its rows."""
    df = _view(spark, sf_dir, messages_sql(sites), events)
    return df.withColumn("ts", F.timestamp_seconds("epoch")).withColumn("account_created_at", F.timestamp_seconds("created")).drop("created")


def list_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, ops_sql()).withColumn("ts", F.timestamp_seconds("epoch"))


#: Scripts put into some of the given pages, by page_id % 8.
SNIPPETS = {
    1: "window.location.href=\"https://discord.gg/code1\";",
    2: "var d=atob('aHR0cHM6Ly9kaXNjb3JkLmdnL2NvZGUy');setTimeout(function(){location.href=d;},9);",
    3: "location.replace('/next');",
    5: "var g=atob('SGVsbG8gd29ybGQ=');",
}


def crawled_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages whose addresses are numbered as the pages are (from 0, without gaps), so that they grow with pages.

    The number of sites is odd, so that each of the 16 kinds of message comes to name each page; it may be one more than there are pages.
    """
    return messages(spark, sf_dir, spark.read.parquet(f"{sf_dir}/pages.parquet").count() | 1)


def fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl outcomes for the addresses in the messages, with the given pages as bodies; each page serves the addresses whose number falls to it."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html", "url")
    snippet = F.coalesce(F.create_map(*(F.lit(x) for kv in SNIPPETS.items() for x in kv))[(F.col("page_id") % 8).cast("int")], F.lit(""))
    body = F.encode(F.replace("html", F.lit("track("), F.concat(snippet, F.lit("track("))), "utf-8")
    n = F.col("page_id").cast("string")
    requests = F.array(F.concat(F.lit("http://bug"), n, F.lit(".pages.dev")), F.concat(F.lit("https://site"), n, F.lit(".example.com/docs")), F.concat(F.lit("https://site"), n, F.lit(".example.com")))
    rows = pages.withColumn("body", body).select("page_id", "body", F.explode(requests).alias("request_url"))
    rows = rows.withColumn("method", F.explode(F.array(F.lit("HEAD"), F.lit("GET"))))
    head = F.col("method") == "HEAD"
    return rows.select(
        "request_url",
        "method",
        F.when(head, 405).otherwise(200).alias("status"),
        F.concat("request_url", F.lit("/")).alias("final_url"),
        F.lit(0).alias("history_len"),
        F.when(head, F.lit(None)).otherwise(F.lit("text/html; charset=utf-8")).alias("content_type"),
        F.when(~head, F.col("body")).alias("body"),
        F.when((F.col("page_id") % 8 == 7) & ~head, "timeout").alias("error"),
        F.timestamp_seconds(F.lit(T0) + F.col("page_id")).alias("fetched_at"),
    )


def invites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot of the invite codes in the messages."""
    k = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("event_id") % 13).alias("k")).distinct().where("k % 4 <> 3")
    return k.select(F.concat(F.lit("code"), F.col("k").cast("string")).alias("code"), (F.col("k") * 10).alias("guild_id"), F.lit(True).alias("resolved"), F.lit(None).cast("string").alias("error"))


def domain_list(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("blocklist", "blocked.example.com"), ("allowlist", "allowed.example.com"), ("allowlist", "site7.example.com")], "list_name string, domain string")


def server_list(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("blocklist", 40), ("allowlist", 10), ("allowlist", 20)], "list_name string, server_id long")


def config_changes_sql() -> str:
    """Changes of the block punishment, one for every hundredth event."""
    return f"""SELECT event_id AS seq, {T0} + event_id * 7 AS epoch, CASE event_id % 3 WHEN 0 THEN 'timeout' WHEN 1 THEN 'kick' ELSE 'ban' END AS punishment,
        CAST(event_id % 41 - 5 AS INT) AS minutes, CASE WHEN event_id % 2 = 0 THEN '  ' ELSE concat(' https://appeal.example.com/', CAST(event_id AS VARCHAR(19)), ' ') END AS appeal_form_url FROM events WHERE event_id % 100 = 7"""


def config_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, config_changes_sql()).withColumn("ts", F.timestamp_seconds("epoch"))


#: What the probe of a page says, by page_id % 10: before the page's own markup, its content type, where it lands, and redirects on the way.
PROBES = {
    0: ('<meta http-equiv="refresh" content="0; url=https://next.example.org/p">', "text/html", None, 0),
    1: ('<meta http-equiv="refresh" content="3;url=https://discord.gg/meta1">', "TEXT/HTML ; charset=utf-8", None, 0),
    2: ("<p>Please wait</p><script>location.replace('https://go.example.org/w');</script>", "text/html", None, 0),
    3: ("x" * 65_536 + ' <meta http-equiv="refresh" content="0; url=https://late.example.org/p"> https://discord.gg/late ', "text/html", None, 0),
    4: ("<p>https://discord.gg/ab\xffc1 </p>", "text/html", None, 0),
    5: ("", "text/html", None, 0),
    6: ("", "text/html", None, 0),
    7: ('<meta http-equiv="refresh" content="0; url=/next">', "application/xhtml+xml", None, 0),
    8: ('<meta http-equiv="refresh" content="0; url=https://next.example.org/p">', "text/plain", None, 0),
    9: ("", "text/html", "https://landed.example.org/x", 2),
}


def probe_deliveries(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Two deliveries of crawl outcomes of a probe of each page. The first has an old error of all, the second what is to be; for
    page_id % 10 = 6 the second is an older row that comes late."""
    k = (F.col("page_id") % 10).cast("int")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    pick = lambda i, kind: F.coalesce(*(F.when(k == n, F.lit(p[i]).cast(kind)) for n, p in PROBES.items()))
    before = F.coalesce(*(F.when(k == n, F.lit(p[0].encode("latin-1"))) for n, p in PROBES.items()))
    url = F.concat(F.lit("https://probe"), F.col("page_id").cast("string"), F.lit(".example.net/a"))
    rows = pages.select("page_id", url.alias("request_url"), F.concat(before, F.encode("html", "utf-8")).alias("page"), pick(1, "string").alias("kind"), pick(2, "string").alias("to"), pick(3, "int").alias("hops"))
    rows = rows.withColumn("method", F.explode(F.array(F.lit("HEAD"), F.lit("GET"))))
    head = F.col("method") == "HEAD"
    by_head = head & (F.col("page_id") % 10 == 5)

    def at(seconds: int, error: Column) -> DataFrame:
        fine = error.isNull()
        return rows.select(
            "request_url", "method", F.when(by_head & fine, 200).when(head, 405).otherwise(200).alias("status"),
            F.when(by_head, F.lit("https://discord.gg/head5")).otherwise(F.coalesce("to", "request_url")).alias("final_url"), F.when(by_head, 1).otherwise(F.col("hops")).alias("history_len"),
            F.when(~head, F.col("kind")).alias("content_type"), F.when(~head & fine, F.col("page")).alias("body"), error.alias("error"), F.timestamp_seconds(F.lit(T0 + seconds)).alias("fetched_at"),
        )

    first, last = at(50, F.when(~head, F.lit("timeout"))), at(100, F.lit(None).cast("string"))
    late = last.withColumn("fetched_at", F.timestamp_seconds(F.lit(T0 + 10)))
    is_odd = F.regexp_extract("request_url", r"probe(\d+)", 1).cast("long") % 10 == 6
    return [first, last.where(~is_odd).unionByName(late.where(is_odd))]
