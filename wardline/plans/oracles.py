"""SQL of the verdict path, for DuckDB.

What a text of each kind of message holds is worked out by hand, as fixed values; what follows from it (crawl outcomes, invites,
lists, scores, history, alerts) is plain SQL over the given tables.
"""

from __future__ import annotations

from ..operators.resolve import REDIRECTORS, UNRESOLVED
from ..operators.risk import ALLOWED, BLOCKS, HIGH, LOW, NEW_ACCOUNT, NEW_ACCOUNT_S, NOTHING, REPEAT, REPEATS, WEIGHTS, WINDOW_S
from . import fixtures as X

_FLAT = "invisible_characters unicode_dot_normalization unicode_normalization"
_HIDDEN = f"{_FLAT} obfuscated_url url_found"
#: By event_id % 16 the URL candidates in order (address, signals beyond url_found), the invite codes, whether the invites are
#: hidden, and the signals of the two detections. {n} and {k} stand for the event's site and code.
KINDS = {
    0: ([("https://site{n}.example.com/docs", "")], [], False, "", "url_found"),
    1: ([], ["code{k}"], False, f"{_FLAT} whitespace_flattening", "url_found"),
    2: ([], ["code{k}", "code{k}now"], True, f"{_FLAT} whitespace_flattening", f"embedded_url {_HIDDEN} whitespace_flattening"),
    3: ([], ["abc123"], True, "percent_decoding", ""),
    4: ([("http://bug{n}.pages.dev", "")], [], False, "", f"decoration_stripping embedded_url markdown_quote_stripping {_HIDDEN} whitespace_flattening"),
    5: ([("https://site{n}.example.com/docs", "")], [], False, "", _HIDDEN),
    6: ([("http://bug{n}.pages.dev", "")], [], False, "", "url_found"),
    7: ([("https://site{n}.example.com", "")], [], False, "", "url_found"),
    8: ([("https://dis​cord.gg/code{k}", "")], ["code{k}"], False, "invisible_characters unicode_normalization", "invisible_characters obfuscated_url unicode_normalization url_found"),
    9: ([("https://site{n}.example.com/a**", ""), ("https://site{n}.example.com/a", "")], [], False, "", "url_found"),
    10: (
        [("https://h{k}.blocked.example.com/x", ""), ("https://h{k}.blocked.example.com/x,thanks", ""), ("https://h{k}.blocked.example.com/x),thanks", f"{_FLAT} obfuscated_url whitespace_flattening")],
        [], False, "", f"decoration_stripping markdown_quote_stripping {_HIDDEN} whitespace_flattening",
    ),
    11: ([], [], False, "", ""),
    12: ([("www.site{n}.example.org", "")], [], False, "", "url_found"),
    13: ([("https://discord.com/invite/code{k}", "")], ["code{k}"], False, "", "url_found"),
    14: ([("http://h{k}.blocked.example.com", "")], [], False, "", "url_found"),
    15: (
        [("https://site{n}.example.com", ""), ("https://h{k}.allowed.example.com/b?c=1", ""), ("https://site{n}.example.comandhttps://h{k}.allowed.example.com/b?c=1", ""), ("https://site{n}.example.comandhttps", f"embedded_url {_FLAT} obfuscated_url whitespace_flattening")],
        [], False, "", f"embedded_url {_HIDDEN} whitespace_flattening",
    ),
}
#: By page_id % 8 what the page's script does: whether it redirects, the invite it leads to, its signals.
SCRIPTS = {
    1: (True, "https://discord.gg/code1", "embedded_invite javascript_redirect javascript_redirect_detected"),
    2: (True, "https://discord.gg/code2", "base64_payload_detected decoded_destination delayed_javascript_redirect embedded_invite javascript_redirect javascript_redirect_detected"),
    3: (True, None, "javascript_redirect javascript_redirect_detected"),
    5: (False, None, "base64_payload_detected"),
}


def _list(words: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in sorted(words.split())) + "]::VARCHAR[]"


def _filled(text: str) -> str:
    return "replace(replace('" + text + "', '{n}', CAST(n AS VARCHAR)), '{k}', CAST(k AS VARCHAR))"


def _host(url: str) -> str:
    return rf"regexp_replace(regexp_extract(lower({url}), '^[a-z]+://([^/?#:]*)', 1), '^www\.', '')"


def _on(domain: str, entries: tuple[str, ...]) -> str:
    return "coalesce(" + " OR ".join(f"{domain} = '{e}' OR ends_with({domain}, '.{e}')" for e in entries) + ", false)"


def _distinct(lists: str) -> str:
    return f"list_sort(list_distinct({lists}))"


def _held(value: str, name: str, kind: str) -> str:
    """Whether a list holds a value, or for domains a parent of it, at the message's time."""
    same = f"({value} = h.value OR ends_with({value}, '.' || h.value))" if kind == "domain" else f"CAST({value} AS VARCHAR) = h.value"
    return f"EXISTS (SELECT 1 FROM held h WHERE h.list_name = '{name}' AND h.entry_type = '{kind}' AND {same} AND h.since <= epoch AND epoch < h.upto)"


def held_lists() -> str:
    """since and upto of each stay of a value on a list, as common table held."""
    ops = f"({X.list_edits_sql()})"
    effects = f"""SELECT seq, epoch, entry_type, value, list_name, action = 'add' AS present FROM {ops}
        UNION ALL SELECT seq, epoch, entry_type, value, CASE WHEN list_name = 'allowlist' THEN 'blocklist' ELSE 'allowlist' END, false FROM {ops} WHERE action = 'add'"""
    return f"""held AS (SELECT * FROM (SELECT entry_type, value, list_name, epoch AS since, coalesce(lead(epoch) OVER (PARTITION BY entry_type, value, list_name ORDER BY seq), CAST(1 AS BIGINT) << 60) AS upto, present FROM ({effects})) WHERE present)"""


def scan_tables(as_of: bool = False) -> str:
    """The steps from messages to flags as common tables m, resolved, found, flags; with the lists of each message's time, or fixed ones."""
    on = (lambda d, name, entries: _held(d, name, "domain")) if as_of else (lambda d, name, entries: _on(d, entries))
    blocked, allowed = (_held("guild_id", "blocklist", "server"), _held("guild_id", "allowlist", "server")) if as_of else ("guild_id = 40", "guild_id IN (10, 20)")
    site = "(SELECT count(*) + (count(*) + 1) % 2 FROM pages)"
    urls = " UNION ALL ".join(
        f"SELECT message_id, {pos}::INTEGER AS pos, {_filled(url)} AS url, {_list('url_found ' + signals)} AS signals FROM m WHERE kind = {kind}" for kind, (found, *_) in KINDS.items() for pos, (url, signals) in enumerate(found)
    )
    codes = " UNION ALL ".join(f"SELECT message_id, {pos}::INTEGER AS pos, {_filled(code)} AS code FROM m WHERE kind = {kind}" for kind, (_, found, *_) in KINDS.items() for pos, code in enumerate(found))
    by_kind = lambda i, tail=_list: "CASE kind " + " ".join(f"WHEN {kind} THEN {tail(parts[i])}" for kind, parts in KINDS.items()) + " END"
    script = lambda i, tail, other: "CASE what " + " ".join(f"WHEN {at} THEN {tail(parts[i])}" for at, parts in SCRIPTS.items()) + f" ELSE {other} END"
    text = lambda x: f"'{x}'" if x else "NULL"
    return f"""
    {held_lists() + "," if as_of else ""}
    m AS (
        SELECT message_id, epoch, user_id, created, content, message_id % 16 AS kind, message_id % 13 AS k, message_id % {site} AS n
        FROM ({X.messages_sql(site)}) WHERE NOT author_is_bot AND guild_id IS NOT NULL
    ),
    crawl AS (
        SELECT unnest(['http://bug' || page_id || '.pages.dev', 'https://site' || page_id || '.example.com/docs', 'https://site' || page_id || '.example.com']) AS normalized_url,
            CASE WHEN page_id % 8 = 7 THEN 7 WHEN contains(html, 'track(') THEN page_id % 8 ELSE 0 END AS what FROM pages
    ),
    candidates AS (SELECT *, CASE WHEN starts_with(url, 'http') THEN url ELSE 'https://' || url END AS normalized_url FROM ({urls})),
    resolved AS (
        SELECT *, CASE WHEN resolved THEN {_host('final_url')} END AS final_domain, regexp_matches(original_domain, '(^|\\.)({'|'.join(r.replace('.', chr(92) + '.') for r in REDIRECTORS)})$') AS suspicious_redirector
        FROM (
            SELECT message_id, pos, url AS original_url, c.normalized_url, {_host('c.normalized_url')} AS original_domain, coalesce(what <> 7, false) AS resolved,
                CASE WHEN what <> 7 THEN coalesce({script(1, text, 'NULL')}, CASE what WHEN 3 THEN regexp_extract(c.normalized_url, '^[a-z]+://[^/]+') || '/next' ELSE c.normalized_url || '/' END) END AS final_url,
                {_distinct(f"list_concat(signals, {script(2, _list, '[]::VARCHAR[]')}, CASE WHEN {script(0, str, 'false')} THEN ['html_redirect_detected'] ELSE [] END)")} AS signals,
                {script(0, str, 'false')} AS html_redirect_detected, {script(1, text, 'NULL')} AS final_invite_url,
                CASE WHEN what IS NOT NULL THEN 200::INTEGER END AS status_code, CASE WHEN what = 7 THEN 'timeout' WHEN what IS NULL THEN '{UNRESOLVED}' END AS error
            FROM candidates c LEFT JOIN crawl ON c.normalized_url = crawl.normalized_url
        )
    ),
    direct AS (SELECT message_id, pos, 'direct' AS way, 'https://discord.gg/' || code AS url, code FROM ({codes})),
    led AS (
        SELECT message_id, min(pos) AS pos, 'redirect' AS way, final_invite_url AS url, regexp_extract(final_invite_url, '[^/]+$') AS code
        FROM resolved r WHERE final_invite_url IS NOT NULL AND NOT EXISTS (SELECT 1 FROM direct d WHERE d.message_id = r.message_id AND lower(d.url) = lower(r.final_invite_url))
        GROUP BY message_id, final_invite_url
    ),
    known AS (SELECT DISTINCT 'code' || (event_id % 13) AS code, event_id % 13 * 10 AS guild_id FROM events WHERE event_id % 13 % 4 <> 3),
    found AS (SELECT f.*, guild_id, guild_id IS NOT NULL AS known FROM (SELECT * FROM direct UNION ALL SELECT * FROM led) f LEFT JOIN known ON f.code = known.code),
    urls AS (
        SELECT message_id, count(*) AS n_urls, bool_or(has_invite) AS to_invite, bool_or(suspicious_redirector AND NOT resolved) AS redirector_unresolved,
            bool_or(suspicious_redirector AND html_redirect_detected) AS interstitial, bool_or(suspicious_redirector) AS redirector, bool_and(has_invite OR allowed) AS urls_allowed,
            {_distinct("flatten(list([CASE WHEN blocked_original THEN original_domain END, CASE WHEN blocked_final THEN final_domain END]))")} AS blocked_domains,
            {_distinct("list(CASE WHEN NOT has_invite AND allowed THEN shown END)")} AS allowed_domains, {_distinct("flatten(list([original_domain, final_domain]))")} AS review_domains,
            list_distinct(flatten(list(signals))) AS url_signals
        FROM (
            SELECT *, final_invite_url IS NOT NULL AS has_invite, coalesce(final_domain, original_domain) AS shown, {on('coalesce(final_domain, original_domain)', 'allowlist', ('allowed.example.com', 'site7.example.com'))} AS allowed,
                {on('original_domain', 'blocklist', ('blocked.example.com',))} AS blocked_original, {on('final_domain', 'blocklist', ('blocked.example.com',))} AS blocked_final
            FROM resolved JOIN (SELECT message_id, epoch FROM m) USING (message_id)
        ) GROUP BY message_id
    ),
    invites AS (
        SELECT message_id, count(*) AS n_invites, bool_or(NOT known) AS invite_unresolved, bool_and(coalesce(is_allowed, false)) AS invites_allowed,
            {_distinct('list(CASE WHEN is_blocked THEN guild_id END)')} AS blocked_servers, {_distinct('list(CASE WHEN is_allowed THEN guild_id END)')} AS allowed_servers, {_distinct('list(guild_id)')} AS review_servers
        FROM (SELECT *, {blocked} AS is_blocked, {allowed} AS is_allowed FROM found JOIN (SELECT message_id, epoch FROM m) USING (message_id)) GROUP BY message_id
    ),
    flags AS (
        SELECT *, len(list_intersect(signals, ['embedded_invite', 'percent_decoding', 'base64_payload_detected', 'decoded_destination'])) > 0 AS hidden_payload,
            len(list_intersect(signals, ['html_redirect_detected', 'javascript_redirect'])) > 0 AS client_redirect,
            hidden OR list_contains(signals, 'obfuscated_url') AS obfuscated, n_invites > 0 AND NOT invites_allowed AS invite_unlisted, n_urls > 0 AND NOT urls_allowed AS url_unlisted,
            len(blocked_domains) > 0 AS blocked_domain, len(blocked_servers) > 0 AS blocked_server, regexp_matches(lower(content), '(^|[^a-z0-9_])(ticket|support|help|assist|verify)([^a-z0-9_]|$)') AS wording
        FROM (
            SELECT m.*, coalesce(n_urls, 0) AS n_urls, coalesce(n_invites, 0) AS n_invites, coalesce(to_invite, false) AS to_invite, coalesce(redirector_unresolved, false) AS redirector_unresolved,
                coalesce(interstitial, false) AS interstitial, false AS interstitial_open, coalesce(redirector, false) AS redirector, coalesce(urls_allowed, true) AS urls_allowed,
                coalesce(invite_unresolved, false) AS invite_unresolved, coalesce(invites_allowed, true) AS invites_allowed,
                coalesce(blocked_domains, []) AS blocked_domains, coalesce(allowed_domains, []) AS allowed_domains, coalesce(review_domains, []) AS review_domains,
                coalesce(blocked_servers, []) AS blocked_servers, coalesce(allowed_servers, []) AS allowed_servers, coalesce(review_servers, []) AS review_servers,
                {by_kind(2, str)} AS hidden, list_concat({by_kind(3)}, {by_kind(4)}, coalesce(url_signals, [])) AS signals
            FROM m LEFT JOIN urls USING (message_id) LEFT JOIN invites USING (message_id)
        )
    )"""


def verdict_tables(as_of: bool = False) -> str:
    total = " + ".join(f"CASE WHEN {c} THEN {w} ELSE 0 END" for c, w, _ in WEIGHTS)
    reasons = ", ".join([*(f"CASE WHEN {c} THEN '{text}' END" for c, _, text in WEIGHTS), f"CASE WHEN again THEN '{REPEAT[1]}' END", f"CASE WHEN young THEN '{NEW_ACCOUNT[1]}' END"])
    blocks = " ".join(f"WHEN {c} THEN '{text}'" for c, text in BLOCKS)
    return f"""{scan_tables(as_of)},
    scored AS (SELECT *, CASE WHEN stage = 'score' THEN {total} ELSE 0 END AS base FROM (
        SELECT *, CASE WHEN n_urls + n_invites = 0 THEN 'ignore' WHEN to_invite OR blocked_domain OR blocked_server OR interstitial THEN 'block'
            WHEN n_invites > 0 AND invites_allowed AND urls_allowed THEN 'allow' ELSE 'score' END AS stage FROM flags)),
    history AS (SELECT message_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch RANGE BETWEEN {WINDOW_S} PRECEDING AND CURRENT ROW) - 1 AS earlier FROM scored WHERE base > 0),
    marked AS (SELECT s.*, base > 0 AND coalesce(earlier, 0) >= {REPEATS} AS again, base > 0 AND epoch - created <= {NEW_ACCOUNT_S} AS young FROM scored s LEFT JOIN history USING (message_id)),
    summed AS (SELECT *, base + CASE WHEN again THEN {REPEAT[0]} ELSE 0 END + CASE WHEN young THEN {NEW_ACCOUNT[0]} ELSE 0 END AS total FROM marked),
    judged AS (SELECT *, CASE WHEN stage <> 'score' THEN stage WHEN total >= {HIGH} THEN 'review_high' WHEN total >= {LOW} THEN 'review_low' ELSE 'allow' END AS verdict FROM summed),
    verdicts AS (
        SELECT message_id, user_id, epoch, content, verdict, CASE WHEN verdict = 'block' THEN 100 WHEN starts_with(verdict, 'review') THEN total ELSE 0 END::INTEGER AS score,
            CASE verdict WHEN 'block' THEN 'main' WHEN 'review_high' THEN 'main' WHEN 'review_low' THEN 'quiet' ELSE 'none' END AS alert_level,
            CASE verdict WHEN 'ignore' THEN ['{NOTHING}'] WHEN 'allow' THEN ['{ALLOWED}'] WHEN 'block' THEN [CASE {blocks} END] ELSE list_filter([{reasons}], lambda x: x IS NOT NULL) END AS reasons,
            CASE WHEN starts_with(verdict, 'review') THEN review_domains WHEN verdict = 'allow' THEN allowed_domains WHEN verdict <> 'block' OR to_invite THEN []
                WHEN blocked_domain THEN blocked_domains WHEN blocked_server THEN [] ELSE review_domains END AS matched_domains,
            CASE WHEN starts_with(verdict, 'review') THEN review_servers WHEN verdict = 'allow' THEN allowed_servers WHEN verdict = 'block' AND (to_invite OR NOT blocked_domain) THEN blocked_servers ELSE [] END AS matched_server_ids
        FROM judged
    )"""


#: By page_id % 10 where a probe leads (null: it stays), its invite, whether the page redirects, whether it makes one wait, and its signals.
PROBED = {
    0: ("https://next.example.org/p", None, True, False, "html_redirect_detected meta_refresh_redirect"),
    1: ("https://discord.gg/meta1", "https://discord.gg/meta1", True, False, "embedded_invite html_redirect_detected meta_refresh_redirect"),
    2: ("https://go.example.org/w", None, True, True, "html_redirect_detected interstitial_html javascript_redirect javascript_redirect_detected suspicious_interstitial"),
    3: (None, None, False, False, ""),
    4: (None, "https://discord.gg/abc1", False, False, "embedded_invite"),
    5: ("https://discord.gg/head5", "https://discord.gg/head5", False, False, "redirect_followed"),
    6: (None, None, False, False, ""),
    7: ("https://probe{id}.example.net/next", None, True, False, "html_redirect_detected meta_refresh_redirect"),
    8: (None, None, False, False, ""),
    9: ("https://landed.example.org/x", None, False, False, "redirect_followed"),
}


def probes() -> str:
    text = lambda x: "NULL" if x is None else "replace('" + x + "', '{id}', CAST(page_id AS VARCHAR))"
    pick = lambda i, made: "CASE page_id % 10 " + " ".join(f"WHEN {k} THEN {made(p[i])}" for k, p in PROBED.items()) + " END"
    return f"""SELECT page_id, original_url, CASE WHEN resolved THEN coalesce(led, original_url) END AS final_url, {_host('original_url')} AS original_domain,
            CASE WHEN resolved THEN {_host('coalesce(led, original_url)')} END AS final_domain, resolved, array_to_string(signals, '|') AS signals, page_id % 10 IN (5, 9) AS redirected,
            html_redirect_detected, final_invite_url, CASE WHEN page_id % 10 = 5 THEN '' ELSE coalesce(final_invite_url, '') END AS embedded_invites, suspicious_interstitial,
            200::INTEGER AS status_code, CASE WHEN NOT resolved THEN 'timeout' END AS error
        FROM (SELECT page_id, 'https://probe' || page_id || '.example.net/a' AS original_url, {pick(0, text)} AS led, {pick(1, text)} AS final_invite_url, {pick(2, str)} AS html_redirect_detected,
            {pick(3, str)} AS suspicious_interstitial, {pick(4, _list)} AS signals, page_id % 10 <> 6 AS resolved FROM pages)"""


def joined(column: str) -> str:
    return f"coalesce(array_to_string({column}, '|'), '') AS {column}"


def cooldown(actions: str, ctes: str = "") -> str:
    """The fold over each key's events: alert_key, message_id, emitted, suppressed_count, user_count, note. actions: alert_key, message_id, user_id, epoch."""
    return f"""WITH RECURSIVE {ctes} a AS (SELECT alert_key, message_id, user_id, epoch, row_number() OVER (PARTITION BY alert_key ORDER BY epoch, message_id) AS n FROM ({actions})),
        s AS (
            SELECT alert_key, n, message_id, true AS emitted, epoch AS sent, CAST(0 AS BIGINT) AS told, CAST(1 AS BIGINT) AS user_count, CAST(0 AS BIGINT) AS muted, [user_id] AS users FROM a WHERE n = 1
            UNION ALL
            SELECT a.alert_key, a.n, a.message_id, epoch - sent >= 300, CASE WHEN epoch - sent >= 300 THEN epoch ELSE sent END,
                CASE WHEN epoch - sent >= 300 THEN muted ELSE muted + 1 END, CAST(len(list_distinct(list_append(users, user_id))) AS BIGINT),
                CASE WHEN epoch - sent >= 300 THEN 0 ELSE muted + 1 END, CASE WHEN epoch - sent >= 300 THEN [user_id] ELSE list_distinct(list_append(users, user_id)) END
            FROM s JOIN a ON a.alert_key = s.alert_key AND a.n = s.n + 1
        ),
        alerts AS (
            SELECT alert_key, message_id, emitted, told AS suppressed_count, user_count,
                CASE WHEN emitted AND told > 0 THEN concat('Suppressed ', told, ' similar events in the last 5 minutes across ', user_count, ' user(s).') ELSE '' END AS note FROM s
        )"""


def sql() -> dict[str, str]:
    json = """concat('{"action":"', action, '","scope":"', scope, '","reasons":["', array_to_string(reasons, '","'), '"],"matched_server_ids":[', coalesce(array_to_string(matched_server_ids, ','), ''), ']}')"""
    scope = "coalesce(nullif(array_to_string(matched_domains, ','), ''), nullif(array_to_string(matched_server_ids, ','), ''), 'global')"
    acts = f"""verdict_actions AS (SELECT *, sha256({json}) AS alert_key FROM (SELECT *, verdict AS action, {scope} AS scope FROM verdicts WHERE verdict NOT IN ('ignore', 'allow'))),"""
    arrays = [joined(c) for c in ("reasons", "matched_domains", "matched_server_ids")]
    nested = lambda way, what: f"(SELECT array_to_string(list(coalesce(CAST({what} AS VARCHAR), 'none') ORDER BY pos), '|') FROM found f WHERE f.message_id = m.message_id AND way = '{way}')"
    number = lambda way: f"(SELECT count(*) FROM found f WHERE f.message_id = m.message_id AND way = '{way}')"
    by_kind = lambda i: "CASE kind " + " ".join(f"WHEN {kind} THEN '{'|'.join(sorted(parts[i].split()))}'" for kind, parts in KINDS.items()) + " END"
    hidden = "kind IN (" + ", ".join(str(kind) for kind, parts in KINDS.items() if parts[2]) + ")"
    colour = "CASE verdict WHEN 'block' THEN 'red' WHEN 'review_high' THEN 'orange' ELSE 'yellow' END"
    shown_by = lambda as_of=False: f"""{cooldown('SELECT * FROM verdict_actions', f'{verdict_tables(as_of)}, {acts}')}, shown AS (SELECT a.*, v.* EXCLUDE (alert_key, message_id), {colour} AS colour FROM alerts a JOIN verdict_actions v USING (message_id) WHERE emitted)"""
    emitted = shown_by()
    cut = lambda x, n=1024: f"(SELECT CASE WHEN length(t) > {n} THEN concat(t[1:{n - 3}], '...') ELSE t END FROM (SELECT {x} AS t))"
    field = lambda lists: cut(f"coalesce(nullif(array_to_string({lists}, chr(10)), ''), 'none')")
    flags = "concat_ws('/', CASE WHEN html_redirect_detected THEN 'html-redirect' END, 'invite ' || final_invite_url)"
    line = f"concat_ws(' ', original_url, CASE WHEN final_url <> original_url THEN '-> ' || final_url END, CASE WHEN {flags} <> '' THEN concat('(', {flags}, ')') END)"
    report = f"""WITH {verdict_tables()}, lines AS (SELECT message_id, list({line} ORDER BY pos) FILTER (pos < 5) AS urls FROM resolved GROUP BY message_id),
        named AS (SELECT message_id, list(url ORDER BY way, pos) AS invites FROM found GROUP BY message_id)
        SELECT v.message_id, {cut('v.content', 400)} AS text, {field('urls')} AS urls, {field('invites')} AS invites, {field(_distinct('signals'))} AS signals,
            CASE WHEN len(list_intersect(signals, ['percent_decoding', 'whitespace_flattening', 'embedded_invite', 'obfuscated_url'])) > 0 THEN 'Invite or URL only surfaced after normalization.'
                ELSE 'No extra normalization tricks were needed.' END AS note, concat(verdict, ' (score ', score, ')') AS verdict, {field('reasons')} AS reasons
        FROM verdicts v JOIN flags USING (message_id) LEFT JOIN lines USING (message_id) LEFT JOIN named USING (message_id)"""
    return {
        "scan_reports": report,
        "crawl_probes": probes(),
        "stream_verdict_counts": f"WITH {verdict_tables()} SELECT verdict, alert_level, count(*) AS messages, CAST(sum(score) AS BIGINT) AS score FROM verdicts GROUP BY ALL",
        "alert_channels": f"{emitted} SELECT alert_level AS channel, colour, count(*) AS alerts FROM shown GROUP BY ALL",
        "stream_alert_channels": f"{shown_by(True)} SELECT alert_level AS channel, colour, count(*) AS alerts FROM shown GROUP BY ALL UNION ALL SELECT 'events', action, count(*) FROM verdict_actions GROUP BY ALL",
        "resolved_urls": f"""WITH {scan_tables()} SELECT message_id, pos, original_url, normalized_url, final_url, original_domain, final_domain, resolved, {joined('signals')}, false AS redirected, html_redirect_detected,
            final_invite_url, coalesce(final_invite_url, '') AS embedded_invites, suspicious_redirector, false AS suspicious_interstitial, status_code, error FROM resolved""",
        "verdicts": f"WITH {verdict_tables()} SELECT message_id, user_id, epoch AS ts, verdict, {', '.join(arrays)}, score, alert_level FROM verdicts",
        "verdicts_as_of": f"WITH {verdict_tables(True)} SELECT message_id, user_id, epoch AS ts, verdict, {', '.join(arrays)}, score, alert_level FROM verdicts",
        "verdict_counts": f"WITH {verdict_tables()} SELECT verdict, alert_level, count(*) AS messages, CAST(sum(score) AS BIGINT) AS score FROM verdicts GROUP BY ALL",
        "scan_summaries": f"""WITH {scan_tables()} SELECT message_id, (SELECT count(*) FROM resolved r WHERE r.message_id = m.message_id) AS n_urls, {number('direct')} AS n_invites, {number('redirect')} AS n_redirect_invites,
            coalesce((SELECT array_to_string(list(coalesce(final_domain, original_domain) ORDER BY pos), '|') FROM resolved r WHERE r.message_id = m.message_id), '') AS domains,
            coalesce({nested('direct', 'guild_id')}, '') AS guild_ids, coalesce({nested('redirect', 'guild_id')}, '') AS redirect_guild_ids, {hidden} AS obfuscated_invites, {by_kind(4)} AS url_signals, {by_kind(3)} AS invite_signals FROM m""",
        "alert_payloads": f"{emitted} SELECT alert_key, message_id, 'Alert: ' || action AS title, colour, verdict, score, {', '.join(arrays)}, content AS preview, note, alert_level FROM shown",
    }
