"""The registered link-safety queries, and their SQL where DuckDB can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.extract import distinct_texts, explode_candidates, extract_invites_basic, invite_prefilter, parse_invite_url, plain_urls, scan_text
from ..functions.html import inspect_html
from ..operators import alerts as A
from ..operators import lists as L
from ..operators import resolve as R
from ..operators import risk
from ..sources.snapshots import bucketed, fetch_table, latest_rows
from ..sources.tables import human_messages, latest_snapshot, read_domain_list, read_list_documents, read_messages, read_server_list, runtime_config, set_punishment_config, write_lists
from ..streaming import jobs
from . import fixtures as X
from . import oracles

Query = Callable[[SparkSession, str], DataFrame]


def scan(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Every step from messages to verdicts. What follows from a text alone is worked out once for each distinct text, numbered as message_id of the
    tables `texts`, `of_texts` (its URLs) and `in_texts` (its invites), and meets the messages by text_id; `messages` has the text_id of each."""
    messages = human_messages(X.crawled_messages(spark, sf))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)  # texts are few bytes and much work
    texts = X.stored(scan_text(distinct_texts(messages).repartition(tasks)).withColumn("message_id", F.monotonically_increasing_id()))
    snapshot = X.stored(R.inspected_snapshot(latest_snapshot(X.fetches(spark, sf), ["request_url", "method"])))
    resolved = X.stored(R.resolve_urls(explode_candidates(texts), snapshot))
    direct = R.direct_invites(texts)
    found = X.stored(R.lookup_invites(direct.unionByName(R.redirect_invites(resolved, direct)), X.invites(spark, sf)))
    scored = X.stored(risk.score_texts(texts, resolved, found, X.domain_list(spark), X.server_list(spark)).withColumnRenamed("message_id", "text_id"))
    known = texts.select(F.col("content").alias("text"), F.col("message_id").alias("text_id"))
    messages = messages.withColumn("text", F.coalesce("content", F.lit(""))).join(known, "text").select("text_id", "message_id", "user_id", "ts", "account_created_at", "content")
    return {"messages": messages, "texts": texts, "of_texts": resolved, "in_texts": found, "verdicts": risk.judge_messages(messages, scored)}


def _by_message(s: dict[str, DataFrame], name: str) -> DataFrame:
    """A table by text for each message that has the text."""
    return s["messages"].select("text_id", "message_id").join(s[name].withColumnRenamed("message_id", "text_id"), "text_id").drop("text_id")


def verdict_counts(spark: SparkSession, sf: str) -> DataFrame:
    return scan(spark, sf)["verdicts"].groupBy("verdict", "alert_level").agg(F.count(F.lit(1)).alias("messages"), F.sum("score").alias("score"))


def _flat(df: DataFrame) -> DataFrame:
    return df.select(*(F.array_join(F.col(c).cast("array<string>"), "|").alias(c) if t.startswith("array") else F.unix_seconds(c).alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes))


def all_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(scan(spark, sf)["verdicts"].drop("content", "text_id"))


def verdicts_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts by the lists as they stood at each message's time, while edits come in between messages."""
    s = scan(spark, sf)
    found = s["texts"].select(F.col("message_id").alias("text_id"), "invite_detection", "url_detection")
    scanned = X.stored(s["messages"].join(found, "text_id").drop("text_id"))
    resolved, invites = (X.stored(_by_message(s, name)) for name in ("of_texts", "in_texts"))
    return _flat(risk.score_messages_as_of(scanned, resolved, invites, X.stored(X.list_edits(spark, sf))).drop("content"))


def resolved_urls(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(_by_message(scan(spark, sf), "of_texts"))


def reports(spark: SparkSession, sf: str) -> DataFrame:
    s = scan(spark, sf)
    lines = A.report_lines(A.assemble_scan(s["texts"], s["of_texts"], s["in_texts"])).withColumnRenamed("message_id", "text_id")
    return A.with_verdicts(X.stored(lines), s["verdicts"], "text_id")


def summaries(spark: SparkSession, sf: str) -> DataFrame:
    s = scan(spark, sf)
    of_texts = X.stored(A.summarize_scan(A.assemble_scan(s["texts"], s["of_texts"], s["in_texts"])).drop("urls_json"))
    out = _by_message(s | {"summaries": of_texts}, "summaries")
    ids = {c: F.array_join(F.col(c).cast("array<string>"), "|", "none") for c in ("guild_ids", "redirect_guild_ids")}
    return _flat(out.withColumns(ids))


def alert_table(spark: SparkSession, sf: str) -> DataFrame:
    actions = A.with_actions(scan(spark, sf)["verdicts"])
    return _flat(A.alert_payload(A.suppress_alerts(actions), actions))


def inspected_pages(spark: SparkSession, sf: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.col("url").alias("base_url"), F.col("html").alias("page"))
    return _flat(inspect_html(pages).drop("page"))


def crawl_probes(spark: SparkSession, sf: str) -> DataFrame:
    """Where a probe of each page leads, by crawl outcomes that came in two deliveries, of which the latest count."""
    paths = []
    for rows in X.probe_deliveries(spark, sf):
        paths.append(f"{X.shared_folder(spark)}/delivery-{uuid.uuid4().hex}")
        rows.write.parquet(paths[-1])
    snapshot = bucketed(R.inspected_snapshot(latest_rows(fetch_table(spark, paths), "request_url")), "request_url")
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    url = F.concat(F.lit("https://probe"), F.col("page_id").cast("string"), F.lit(".example.net/a"))
    asked = pages.select(F.col("page_id").alias("message_id"), F.lit(0).alias("pos"), url.alias("url"), F.array().cast("array<string>").alias("signals"), url.alias("normalized_url"))
    return _flat(R.resolve_urls(asked, snapshot).withColumnRenamed("message_id", "page_id").drop("pos", "normalized_url", "suspicious_redirector"))


def human(spark: SparkSession, sf: str) -> DataFrame:
    """Messages through their source: written as a table and read by its schema."""
    path = f"{X.shared_folder(spark)}/messages-{uuid.uuid4().hex}"
    X.messages(spark, sf).write.parquet(path)
    return read_messages(spark, path).withColumn("epoch", F.unix_seconds("ts")).select("message_id", "epoch", "guild_id", "channel_id", "user_id", "content")


def text_functions(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("content")
    return X.messages(spark, sf).select(
        "message_id",
        T.normalize_dots(c).alias("dots"),
        T.strip_decoration(c).alias("decoration"),
        T.collapse_whitespace(c).alias("collapsed"),
        T.remove_whitespace(c).alias("removed"),
        T.collapse_obfuscation(c).alias("obfuscation"),
        T.strip_trailing_punct(c).alias("stripped"),
        T.ensure_scheme(c).alias("scheme"),
        T.percent_unquote(c).alias("unquoted"),
        T.preview(c, 20).alias("preview"),
    )


def domains(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", T.normalize_domain(F.col("url")).alias("domain"), F.array_join(T.host_suffixes(T.normalize_domain(F.col("url"))), "|").alias("suffixes"))


def page_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links of a text that names each page, and another address in the next line."""
    text = F.concat("url", F.lit("\nor www.example.org/"), F.col("page_id").cast("string"), F.lit("."))
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.array_join(plain_urls(text), "|").alias("urls"))


def list_state(spark: SparkSession, sf: str) -> DataFrame:
    return L.apply_list_ops(X.list_ops(spark, sf))


def list_report(spark: SparkSession, sf: str) -> DataFrame:
    return L.list_report(list_state(spark, sf), 5)


def lists_as_of(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.messages(spark, sf).select("message_id", "ts", F.concat(F.lit("h"), (F.col("message_id") % 13).cast("string"), F.lit(".example.com")).alias("domain"))
    return L.lists_as_of(rows, X.list_ops(spark, sf), "domain", "ts", "domain").select("message_id", "list_name")


def matched_domains(spark: SparkSession, sf: str) -> DataFrame:
    """Hosts of pages against two lists: some hosts, the parents of others, and a name that none has."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", T.normalize_domain(F.col("url")).alias("domain"))
    hosts = pages.where("page_id % 5 = 0").select(F.lit("allowlist").alias("list_name"), "domain")
    parents = pages.where("page_id % 7 = 0").select(F.lit("blocklist").alias("list_name"), F.regexp_replace("domain", r"^[^.]*\.", "").alias("domain"))
    none = spark.createDataFrame([("blocklist", "nowhere.invalid")], "list_name string, domain string")
    return L.domain_matches(pages, hosts.unionByName(parents).unionByName(none).distinct())


def _blocked_parents(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A part of each page's host, for odd pages a name below it, and a list of some of these parts."""
    part = F.concat(F.lit("s"), (F.col("page_id") % 97).cast("string"), F.lit("."), T.normalize_domain(F.col("url")))
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", part.alias("domain"))
    asked = pages.withColumn("domain", F.when(F.col("page_id") % 2 == 1, F.concat(F.lit("deep."), "domain")).otherwise(F.col("domain")))
    return asked, pages.where("page_id % 11 = 3").select("domain")


def domains_on(spark: SparkSession, sf: str) -> DataFrame:
    return L.domains_on(*_blocked_parents(spark, sf))


def domains_off(spark: SparkSession, sf: str) -> DataFrame:
    return L.domains_off(*_blocked_parents(spark, sf))


def compatible_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with letters, digits and signs that have a plainer form, and what they are in it."""
    wide = F.translate(F.col("message_id").cast("string"), "0123456789", "０１２３４５６７８９")
    text = F.concat("content", F.lit(" ﬁｎｅ ①² ｶﾞ e\u0301 "), wide)
    return X.messages(spark, sf).select("message_id", T.nfkc(text).alias("nfkc"), T.normalize_text(F.concat(F.lit("ｗｗｗ．"), wide, F.lit("\u2060。"))).alias("normal"))


def matched_servers(spark: SparkSession, sf: str) -> DataFrame:
    return L.server_matches(X.messages(spark, sf).select("message_id", "guild_id"), X.server_list(spark))


def _suspicious(spark: SparkSession, sf: str) -> DataFrame:
    return X.messages(spark, sf).select("message_id", "user_id", "epoch", "ts", F.when(F.col("message_id") % 3 == 0, 10).otherwise(0).alias("base_score"))


def user_history(spark: SparkSession, sf: str) -> DataFrame:
    return risk.user_history(_suspicious(spark, sf)).select("message_id", F.col("earlier").cast("bigint").alias("earlier"))


def _actions(spark: SparkSession, sf: str) -> DataFrame:
    return X.messages(spark, sf).select("message_id", "user_id", "ts", "epoch", F.concat(F.lit("key"), (F.col("user_id") % 7).cast("string")).alias("alert_key"), F.element_at(F.array(*map(F.lit, ("review_low", "block", "review_high"))), (F.col("message_id") % 3 + 1).cast("int")).alias("action"))


def _alerts(df: DataFrame) -> DataFrame:
    return df.select("alert_key", "message_id", "emitted", F.col("suppressed_count").cast("bigint").alias("suppressed_count"), F.col("user_count").cast("bigint").alias("user_count"), "note")


def alert_cooldown(spark: SparkSession, sf: str) -> DataFrame:
    return _alerts(A.suppress_alerts(_actions(spark, sf)))


def recent(spark: SparkSession, sf: str) -> DataFrame:
    return A.recent_events(_actions(spark, sf)).select("event_id", "message_id", "user_id", "action")


def top(spark: SparkSession, sf: str) -> DataFrame:
    return A.top_recent(A.recent_events(_actions(spark, sf))).select("event_id", "message_id", "action")


def numbered(spark: SparkSession, sf: str) -> DataFrame:
    return A.numbered_events(_actions(spark, sf)).select("event_no", "message_id")


def routed(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("ignore", "allow", "review_low", "review_high", "block")))
    rows = X.messages(spark, sf).select("message_id", F.element_at(kinds, (F.col("message_id") % 5 + 1).cast("int")).alias("verdict"), F.when(F.col("message_id") % 2 == 0, "active").otherwise("monitor").alias("mode"))
    return rows.select("message_id", A.route_action(F.col("verdict"), F.col("mode")).alias("action"))


def punishments(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("message_id")
    rows = X.messages(spark, sf).select(
        "message_id", F.when(m % 2 == 0, "block").otherwise("review_high").alias("action"), (m % 11 != 0).alias("is_member"), (m % 7 == 0).alias("is_staff"), (m % 13 != 0).alias("bot_present"),
        F.element_at(F.array(*map(F.lit, ("none", "timeout", "kick", "ban"))), (m % 4 + 1).cast("int")).alias("block_punishment"), (m % 9).alias("top_role"), F.lit(5).alias("bot_top_role"),
        (m % 3 != 0).alias("bot_can_timeout"), (m % 5 != 0).alias("bot_can_kick"), F.lit(True).alias("bot_can_ban"), F.when(m % 6 == 0, F.lit("https://appeal")).alias("appeal_form_url"),
    )
    return A.plan_punishment(rows).select("message_id", "delete", "punish", "skip_reason", "notice")


def config_state(spark: SparkSession, sf: str) -> DataFrame:
    """The configuration after all changes, with its defaults. The changes are made of every hundredth event (event_id % 100 = 7): a community seldom changes it."""
    changed = set_punishment_config(X.config_changes(spark, sf))
    return runtime_config(changed.withColumns({"mod_log_channel_id": F.lit("77"), "mode": F.lit("monitor")}))


def status(spark: SparkSession, sf: str) -> DataFrame:
    actions = _actions(spark, sf)
    return L.status_summary(list_state(spark, sf), actions, actions, config_state(spark, sf))


def list_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Lists as documents, written whole, the allowlist once more with one entry alone, and read back."""
    state, out = X.stored(list_state(spark, sf)), []
    for kind, column, read in (("domain", "domain", read_domain_list), ("server", "server_id", read_server_list)):
        path = f"{X.shared_folder(spark)}/lists-{uuid.uuid4().hex}"
        own = state.where(F.col("entry_type") == kind).select("list_name", F.col("value").alias(column))
        write_lists(own, column, path)
        write_lists(spark.createDataFrame([("allowlist", "new.example.org" if kind == "domain" else "1_000")], f"list_name string, {column} string"), column, path)
        out.append(read(read_list_documents(spark, path)).select(F.lit(kind).alias("entry_type"), "list_name", F.col(column).cast("string").alias("value")))
    return out[0].unionByName(out[1])


def text_repair(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("content")
    return X.messages(spark, sf).select(
        "message_id", T.nfkc(c).alias("nfkc"), T.strip_invisible(c).alias("visible"), T.strip_quote_prefixes(c).alias("unquoted"), T.normalize_text(c).alias("normal"),
        T.normalize_candidate_url(F.concat(c, F.lit("\\)"))).alias("candidate"), invite_prefilter(c).alias("may_link"),
    )


def invite_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Invites of a text that names two, one in the long form, and again in its collapsed form."""
    text = F.format_string("see https://discord.gg/code%d, or discord.com/invite/x%d!", F.col("message_id") % 13, F.col("message_id"))
    first, every = parse_invite_url(text), F.transform(extract_invites_basic(text), lambda x: x["code"])
    return X.messages(spark, sf).select("message_id", first["code"].alias("first_code"), first["url"].alias("url"), F.array_join(every, "|").alias("codes"))


def moderators(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("message_id")
    flags = [F.when(m % k != 0, m % n == 0) for k, n in ((11, 10), (13, 4), (17, 6), (19, 15))]  # null at times
    return X.messages(spark, sf).select("message_id", A.is_moderator(*flags).alias("moderator"))


def quarantined(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("message_id")
    rows = X.messages(spark, sf).withColumns({"n": m, "message_id": F.when(m % 97 != 0, m), "ts": F.when(m % 89 != 0, F.col("ts"))})
    good, bad = jobs.quarantine(rows)
    return good.select("n", F.lit("").alias("error")).unionByName(bad.select("n", "error"))


def alert_channels(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts by the channel that they go to."""
    s = scan(spark, sf)
    actions = A.with_actions(s["verdicts"])
    payload = X.stored(A.alert_payload(A.suppress_alerts(actions), actions))
    main, quiet = A.split_main_quiet(payload)
    count = lambda df, name: df.groupBy("colour").agg(F.count(F.lit(1)).alias("alerts")).select(F.lit(name).alias("channel"), "colour", "alerts")
    return count(main, "main").unionByName(count(quiet, "quiet"))


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.replay(spark.read.parquet(f"{sf}/events.parquet"), "event_id", X.shared_folder(spark))


def stream_history(spark: SparkSession, sf: str) -> DataFrame:
    rows = _stream(spark, sf).where("event_id % 3 = 0").select(F.col("event_id").alias("message_id"), "user_id", F.timestamp_seconds(F.col("event_id") * 7 + X.T0).alias("ts"))
    out = jobs.run_available(jobs.stream_user_history(rows), X.shared_folder(spark))
    return out.select("message_id", F.col("earlier").cast("bigint").alias("earlier"))


def stream_cooldown(spark: SparkSession, sf: str) -> DataFrame:
    rows = _stream(spark, sf).select(F.col("event_id").alias("message_id"), "user_id", F.timestamp_seconds(F.col("event_id") * 7 + X.T0).alias("ts"), F.concat(F.lit("key"), (F.col("user_id") % 7).cast("string")).alias("alert_key"))
    return _alerts(jobs.run_available(jobs.stream_alert_suppression(rows), X.shared_folder(spark)))


def stream_verdict_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The verdicts of a stream of messages, joined with snapshots and lists, from its sink."""
    sites = spark.read.parquet(f"{sf}/pages.parquet").count() | 1
    events = jobs.replay(spark.read.parquet(f"{sf}/events.parquet"), "event_id", X.shared_folder(spark))
    snapshot = X.stored(R.inspected_snapshot(latest_snapshot(X.fetches(spark, sf), ["request_url", "method"])))
    static = jobs.Static(snapshot, X.stored(X.invites(spark, sf)), X.domain_list(spark), X.server_list(spark))
    path = jobs.stream_verdicts(X.messages(spark, sf, sites, events), static, X.shared_folder(spark))
    return spark.read.parquet(f"{path}/verdicts").groupBy("verdict", "alert_level").agg(F.count(F.lit(1)).alias("messages"), F.sum("score").alias("score"))


def stream_alert_channels(spark: SparkSession, sf: str) -> DataFrame:
    """Messages through verdicts, by the lists of each message's time, and the cooldown to the channels' sinks, in one stream of at least three micro-batches."""
    sites = spark.read.parquet(f"{sf}/pages.parquet").count() | 1
    table = spark.read.parquet(f"{sf}/events.parquet")
    events = jobs.replay(table, "event_id", X.shared_folder(spark), min(jobs.BATCH_ROWS, max(1, -(-table.count() // 3))))
    snapshot = X.stored(R.inspected_snapshot(latest_snapshot(X.fetches(spark, sf), ["request_url", "method"])))
    edits = X.stored(X.list_edits(spark, sf))
    static = jobs.Static(snapshot, X.stored(X.invites(spark, sf)), X.domain_list(spark), X.server_list(spark), lambda: edits)
    path = jobs.stream_verdicts(X.messages(spark, sf, sites, events), static, X.shared_folder(spark), alerts=True)
    sink = lambda name, kind: spark.read.parquet(f"{path}/{name}").groupBy(F.lit(name).alias("channel"), F.col(kind).alias("colour")).agg(F.count(F.lit(1)).alias("alerts"))
    return sink("main", "colour").unionByName(sink("quiet", "colour")).unionByName(sink("events", "action"))


def queries() -> dict[str, Query]:
    return {
        "config_state": config_state,
        "list_documents": list_documents,
        "text_repair": text_repair,
        "invite_codes": invite_codes,
        "moderators": moderators,
        "quarantined": quarantined,
        "alert_channels": alert_channels,
        "stream_verdict_counts": stream_verdict_counts,
        "stream_alert_channels": stream_alert_channels,
        "verdict_counts": verdict_counts,
        "verdicts": all_verdicts,
        "verdicts_as_of": verdicts_as_of,
        "resolved_urls": resolved_urls,
        "scan_reports": reports,
        "scan_summaries": summaries,
        "alert_payloads": alert_table,
        "inspected_pages": inspected_pages,
        "crawl_probes": crawl_probes,
        "human_messages": human,
        "text_functions": text_functions,
        "page_domains": domains,
        "page_links": page_links,
        "list_state": list_state,
        "list_report": list_report,
        "lists_as_of": lists_as_of,
        "domain_matches": matched_domains,
        "server_matches": matched_servers,
        "domains_on": domains_on,
        "domains_off": domains_off,
        "compatible_texts": compatible_texts,
        "user_history": user_history,
        "alert_cooldown": alert_cooldown,
        "recent_events": recent,
        "top_recent": top,
        "numbered_events": numbered,
        "routed_actions": routed,
        "punishments": punishments,
        "status_summary": status,
        "stream_user_history": stream_history,
        "stream_alert_cooldown": stream_cooldown,
    }


def oracle_sql() -> dict[str, str]:
    m, ops = f"({X.messages_sql()})", f"({X.ops_sql()})"
    host = r"regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/:?#]*)', 1), '^www\.', '')"
    effects = f"""SELECT seq, epoch, entry_type, value, list_name, action = 'add' AS present FROM {ops}
        UNION ALL SELECT seq, epoch, entry_type, value, CASE WHEN list_name = 'allowlist' THEN 'blocklist' ELSE 'allowlist' END, false FROM {ops} WHERE action = 'add'"""
    state = f"SELECT entry_type, list_name, value FROM ({effects}) GROUP BY ALL HAVING arg_max(present, seq)"
    config = f"""SELECT CAST(77 AS BIGINT) AS mod_log_channel_id, arg_max(punishment, seq) AS block_punishment, nullif(trim(arg_max(appeal_form_url, seq)), '') AS appeal_form_url,
        greatest(1, arg_max(minutes, seq)) AS action_timeout_minutes, 'monitor' AS mode FROM ({X.config_changes_sql()})"""
    history = f"""SELECT message_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch RANGE BETWEEN 600 PRECEDING AND CURRENT ROW) - 1 AS earlier FROM {m} WHERE message_id % 3 = 0"""
    acts = f"""SELECT message_id, user_id, epoch, concat('key', user_id % 7) AS alert_key, CASE message_id % 3 WHEN 0 THEN 'review_low' WHEN 1 THEN 'block' ELSE 'review_high' END AS action FROM {m}"""
    recent = f"""SELECT printf('evt-%04d', n) AS event_id, message_id, user_id, action FROM (SELECT *, row_number() OVER (ORDER BY epoch, message_id) AS n FROM ({acts})) QUALIFY row_number() OVER (ORDER BY n DESC) <= 25"""
    cooldown = f"{oracles.cooldown(acts)} SELECT * FROM alerts"
    below = f"""WITH p AS (SELECT page_id, concat('s', page_id % 97, '.', {host}) AS part FROM pages), h AS (SELECT page_id, CASE WHEN page_id % 2 = 1 THEN 'deep.' || part ELSE part END AS domain FROM p),
        listed AS (SELECT part AS entry FROM p WHERE page_id % 11 = 3)"""
    listed = "EXISTS (SELECT 1 FROM listed WHERE domain = entry OR ends_with(domain, '.' || entry))"
    return oracles.sql() | {
        "page_links": "SELECT page_id, concat(url, '|www.example.org/', page_id, '|', url, 'orwww.example.org/', page_id) AS urls FROM pages",
        "punishments": f"""SELECT message_id, action = 'block' AS delete, CASE WHEN skip_reason IS NULL THEN p END AS punish, skip_reason,
            CASE WHEN early IS NULL AND p IN ('kick', 'ban') THEN concat('You were removed after posting a blocked suspicious link. Action: ', p, '.', CASE WHEN message_id % 6 = 0 THEN concat(chr(10), 'Appeal form: https://appeal') ELSE '' END) END AS notice
            FROM (SELECT *, coalesce(early, CASE WHEN NOT CASE p WHEN 'timeout' THEN message_id % 3 <> 0 WHEN 'kick' THEN message_id % 5 <> 0 ELSE true END THEN 'missing permission' END) AS skip_reason FROM (
                SELECT *, CASE WHEN action <> 'block' THEN 'no block' WHEN message_id % 11 = 0 THEN 'no member' WHEN message_id % 7 = 0 THEN 'staff' WHEN message_id % 13 = 0 THEN 'bot absent'
                    WHEN p = 'none' THEN 'no punishment' WHEN message_id % 9 >= 5 THEN 'role hierarchy' END AS early
                FROM (SELECT message_id, CASE WHEN message_id % 2 = 0 THEN 'block' ELSE 'review_high' END AS action, CASE message_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'timeout' WHEN 2 THEN 'kick' ELSE 'ban' END AS p FROM {m})))""",
        "human_messages": f"SELECT message_id, epoch, guild_id, channel_id, user_id, content FROM {m} WHERE NOT author_is_bot AND guild_id IS NOT NULL",
        "text_functions": rf"""SELECT message_id, translate(content, chr(12290) || chr(65294) || chr(65377), '...') AS dots, regexp_replace(content, '[<>\[\](){{}}*_`|"''“”‘’]', '', 'g') AS decoration,
            trim(regexp_replace(content, '\s+', ' ', 'g')) AS collapsed, regexp_replace(content, '\s+', '', 'g') AS removed,
            regexp_replace(regexp_replace(content, '[\s\x{{200b}}-\x{{200f}}\x{{2060}}\x{{feff}}]+', '', 'g'), '[<>\[\](){{}}*`|]+', '', 'g') AS obfuscation,
            rtrim(content, '.,!?;:''")]>}}') AS stripped, CASE WHEN regexp_matches(lower(content), '^https?://') THEN content ELSE concat('https://', content) END AS scheme,
            url_decode(content) AS unquoted, CASE WHEN length(content) > 20 THEN concat(content[1:17], '...') ELSE content END AS preview FROM {m}""",
        "page_domains": f"""SELECT page_id, domain, array_to_string(list_transform(range(1, len(p) + 1), lambda k: array_to_string(p[k:], '.')), '|') AS suffixes
            FROM (SELECT page_id, {host} AS domain, string_split({host}, '.') AS p FROM pages)""",
        "list_state": state,
        "list_report": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entry_type, list_name ORDER BY CASE WHEN entry_type = 'server' THEN CAST(value AS BIGINT) END, value) AS rank FROM ({state})) WHERE rank <= 5""",
        "lists_as_of": f"""WITH i AS (SELECT *, lead(epoch) OVER (PARTITION BY entry_type, list_name, value ORDER BY seq) AS valid_to FROM ({effects})),
            k AS (SELECT * FROM i WHERE present AND entry_type = 'domain')
            SELECT message_id, k.list_name FROM (SELECT message_id, epoch, concat('h', message_id % 13, '.example.com') AS domain FROM {m}) m
            LEFT JOIN k ON k.value = m.domain AND m.epoch >= k.epoch AND (k.valid_to IS NULL OR m.epoch < k.valid_to)""",
        "domain_matches": f"""WITH h AS (SELECT page_id, {host} AS domain FROM pages),
            listed AS (SELECT 'allowlist' AS list_name, domain AS entry FROM h WHERE page_id % 5 = 0 UNION SELECT 'blocklist', domain[position('.' IN domain) + 1 :] FROM h WHERE page_id % 7 = 0 UNION SELECT 'blocklist', 'nowhere.invalid')
            SELECT DISTINCT page_id, domain, list_name FROM h JOIN listed ON domain = entry OR ends_with(domain, '.' || entry)""",
        "domains_on": f"{below} SELECT page_id, domain FROM h WHERE {listed}",
        "domains_off": f"{below} SELECT page_id, domain FROM h WHERE NOT {listed}",
        "compatible_texts": f"SELECT message_id, concat(content, ' fine 12 ', chr(12460), ' ', chr(233), ' ', message_id) AS nfkc, concat('www.', message_id, '.') AS normal FROM {m}",
        "inspected_pages": "SELECT page_id, url AS base_url, false AS html_redirect_detected, CAST(NULL AS VARCHAR) AS html_final_url, '' AS embedded_invites, false AS suspicious_interstitial, '' AS html_signals FROM pages",
        "server_matches": f"SELECT message_id, guild_id, CASE WHEN guild_id = 40 THEN 'blocklist' ELSE 'allowlist' END AS list_name FROM {m} WHERE guild_id IN (10, 20, 40)",
        "user_history": history,
        "stream_user_history": history,
        "alert_cooldown": cooldown,
        "stream_alert_cooldown": cooldown,
        "recent_events": recent,
        "top_recent": f"SELECT event_id, message_id, action FROM ({recent}) WHERE action IN ('block', 'review_high') ORDER BY message_id DESC LIMIT 5",
        "numbered_events": f"SELECT row_number() OVER (ORDER BY epoch, message_id) AS event_no, message_id FROM ({acts})",
        "routed_actions": f"""SELECT message_id, CASE message_id % 5 WHEN 2 THEN 'review_low' WHEN 3 THEN 'review_high' WHEN 4 THEN CASE WHEN message_id % 2 = 0 THEN 'block' ELSE 'block_detected' END END AS action FROM {m}""",
        "status_summary": f"""SELECT concat(entry_type, '_', list_name) AS name, CAST(count(*) AS VARCHAR) AS value FROM ({state}) GROUP BY ALL
            UNION ALL SELECT 'recent_events', CAST(least(25, count(*)) AS VARCHAR) FROM events UNION ALL SELECT 'alert_keys', CAST(count(DISTINCT user_id % 7) AS VARCHAR) FROM events
            UNION ALL SELECT name, value FROM (
                SELECT unnest(['scanning', 'mode', 'mod_log_channel', 'thresholds', 'punishment', 'timeout_minutes', 'appeal']) AS name,
                    unnest(['enabled', mode, '<#77>', '10/50', block_punishment, CAST(action_timeout_minutes AS VARCHAR), CASE WHEN appeal_form_url IS NULL THEN 'not set' ELSE 'set' END]) AS value FROM ({config}))""",
        "config_state": config,
        "list_documents": f"SELECT entry_type, list_name, value FROM ({state}) WHERE list_name <> 'allowlist' UNION ALL VALUES ('domain', 'allowlist', 'new.example.org'), ('server', 'allowlist', '1000')",
        "text_repair": rf"""SELECT message_id, content AS nfkc, replace(content, chr(8203), '') AS visible, regexp_replace(content, '^[ \t]*>[ \t]?', '', 'gm') AS unquoted,
            trim(regexp_replace(translate(replace(content, chr(8203), ''), chr(12290), '.'), '\s+', ' ', 'g')) AS normal, rtrim(rtrim(translate(content, chr(12290), '.') || chr(92) || ')', '.,!?;:''")]>}}'), chr(92)) AS candidate,
            regexp_matches(content, '[/%]|[^\x00-\x7f]') OR contains(content, 'www.') AS may_link FROM {m}""",
        "invite_codes": f"SELECT message_id, concat('code', message_id % 13) AS first_code, concat('https://discord.gg/code', message_id % 13) AS url, concat('code', message_id % 13, '|x', message_id) AS codes FROM {m}",
        "moderators": f"SELECT message_id, message_id % 11 <> 0 AND message_id % 10 = 0 OR message_id % 13 <> 0 AND message_id % 4 = 0 OR message_id % 17 <> 0 AND message_id % 6 = 0 OR message_id % 19 <> 0 AND message_id % 15 = 0 AS moderator FROM {m}",
        "quarantined": f"SELECT message_id AS n, CASE WHEN message_id % 97 = 0 THEN 'no message_id' WHEN message_id % 89 = 0 THEN 'no ts' ELSE '' END AS error FROM {m}",
    }
