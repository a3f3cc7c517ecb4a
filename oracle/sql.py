"""Plain SQL for every query, for a check by a second engine.

Written relationally (rows, windows, joins), not as a copy of the array
expressions of the package. Its regular expressions are those of RE2: ``\\b``
looks at ASCII characters only and there is no lookaround.
"""

import functools
import re

from mailsift.data import catalogue as cat
from mailsift.data import lists
from mailsift.functions.domains import typosquat_targets
from mailsift.operators.attachments import GROUP_RULES, ext_group
from mailsift.plans.queries import ADDED_COMBOS, ADDED_PATTERNS, ADDED_RULES, PART_RULES
from mailsift.sources.mail import GOLDEN_EXPECTED, GOLDEN_IDS, HOSTS, TEMPLATES

WS = r"\t\n\v\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"


def q(text):
    return "'" + str(text).replace("'", "''") + "'"


def rx(pattern):
    """A catalogue pattern as an RE2 literal."""
    return q("(?i)" + pattern.replace(r"\s", f"[{WS}]"))


def values(rows):
    cell = lambda v: "NULL" if v is None else (q(v) if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else str(v))
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + ")"


def among(expr, items):
    return f"{expr} IN ({', '.join(map(q, items))})"


def trim(x):
    return f"regexp_replace({x}, {q(f'^[{WS}]+|[{WS}]+$')}, '', 'g')"


def squeeze(x):
    return trim(f"regexp_replace({x}, {q(f'[{WS}]+')}, ' ', 'g')")


def registrable(host):
    h = trim(f"regexp_replace(lower({host}), '\\.$', '')")
    parts = f"string_split({h}, '.')"
    two = f"array_to_string({parts}[-2:], '.')"
    return (f"(CASE WHEN len({parts}) <= 2 THEN {h} WHEN {among(two, lists.MULTI_PART_SUFFIXES)} "
            f"THEN array_to_string({parts}[-3:], '.') ELSE {two} END)")


TLDS = "|".join(lists.all_tlds())
LABEL = r"(?:[a-z0-9](?:[a-z0-9_-]{0,61}[a-z0-9])?\.)+"
SCHEME = rx(r"""\b(?:hxxps?|https?|ftps?)\s*:\s*//[^\s<>"'`]+""".replace(r"[^\s", f"[^{WS}"))
BARE = q(rf"(?i)[@/]?\b{LABEL}(?:{TLDS})\b")
HOSTISH = q(rf"(?i)(?:https?://)?{LABEL}(?:{TLDS})\b")
FILE = rf"""(?i)(?:^|[{WS}"'\[(<>])(\w[\w .\-()]{{0,58}}\.(?:{'|'.join(lists.all_extensions())}))\b"""
ANCHOR = q(rf"""(?i)<a\b[^>]*href[{WS}]*=[{WS}]*(?:"([^"]*)"|'([^']*)'|([^{WS}>]+))[^>]*>([\s\S]*?)</a>""")
TAG = rx(r"<\s*/?\s*(?:html|head|body|table|tr|td|div|span|p|a|img|font|br|meta|style|form|input)\b[^>]*>")
FIELD = rf"^[A-Za-z][A-Za-z0-9\-]{{1,40}}[{WS}]*:"

CTE = {}


def cte(name, sql, materialized=False):
    CTE[name] = ("MATERIALIZED " if materialized else "", sql)


def count(x, pattern):
    return f"len(regexp_extract_all({x}, {pattern}))"


def parsed(name, source, column):
    """CTE chain that splits a link column into its parts."""
    dots = rx(r"\[\s*\.\s*\]|\(\s*\.\s*\)|\{\s*\.\s*\}|\[dot\]|\(dot\)")
    ats = rx(r"\[\s*@\s*\]|\(\s*@\s*\)|\[at\]")
    n = f"regexp_replace(regexp_replace({column}, '(?i)h(?:xx|tt)ps://', 'https://', 'g'), '(?i)h(?:xx|tt)p://', 'http://', 'g')"
    cte(f"{name}1", f"SELECT *, regexp_replace(regexp_replace({n}, {dots}, '.', 'g'), {ats}, '@', 'g') AS normalized FROM {source}")
    cte(f"{name}2", f"""SELECT *, regexp_replace(normalized, '(?i)^[a-z]+://', '') AS rest,
        lower(regexp_extract(normalized, '(?i)^([a-z]+)://', 1)) AS scheme0 FROM {name}1""")
    cte(f"{name}3", f"""SELECT *, CASE WHEN contains(rest, '@') THEN rest[:position('@' IN rest) - 1] ELSE '' END AS userinfo,
        CASE WHEN contains(rest, '@') THEN rest[position('@' IN rest) + 1:] ELSE rest END AS place FROM {name}2""")
    cte(f"{name}4", f"SELECT *, regexp_extract(place, '^[^/?#]*') AS authority FROM {name}3")
    cte(name, f"""SELECT *, CASE WHEN scheme0 = '' THEN 'http' ELSE scheme0 END AS scheme,
        regexp_replace(lower(regexp_replace(authority, ':\\d{{1,5}}$', '')), '\\.$', '') AS host,
        regexp_extract(authority, ':(\\d{{1,5}})$', 1) AS port, place[len(authority) + 1:] AS tail FROM {name}4""")


def placed(name, source, text, pattern, extra=""):
    """One row per match of a pattern with its 0-based start."""
    cte(f"{name}_gap", f"""SELECT msg_id, unnest(string_split_regex({text}, {pattern})) AS gap,
        generate_subscripts(string_split_regex({text}, {pattern}), 1) AS i FROM {source}""")
    cte(f"{name}_hit", f"""SELECT msg_id, unnest(regexp_extract_all({text}, {pattern})) AS hit,
        generate_subscripts(regexp_extract_all({text}, {pattern}), 1) AS i {extra} FROM {source}""")
    cte(name, f"""SELECT h.*, sum(len(g.gap) + coalesce(len(p.hit), 0)) OVER (PARTITION BY h.msg_id ORDER BY h.i) AS start_pos
        FROM {name}_hit h JOIN {name}_gap g USING (msg_id, i) LEFT JOIN {name}_hit p ON p.msg_id = h.msg_id AND p.i = h.i - 1""")


# ---- messages -------------------------------------------------------------------------------
cte("mails", f"""SELECT o_orderkey * 4 AS msg_id, o_orderdate AS ts, 'orders' AS source,
    replace(replace(template, '#k#', CAST(o_orderkey AS VARCHAR)), '#h#', host) AS raw FROM orders
    JOIN {values(enumerate(TEMPLATES))} t(template_id, template) ON o_orderkey % {len(TEMPLATES)} = template_id
    JOIN {values(enumerate(HOSTS))} h(host_id, host) ON o_custkey % {len(HOSTS)} = host_id""", True)
cte("corpus", """SELECT msg_id, ts, source, raw FROM mails
    UNION ALL SELECT doc_id * 4 + 1, NULL, 'documents', text FROM documents
    UNION ALL SELECT page_id * 4 + 2, NULL, 'pages', html FROM pages
    UNION ALL SELECT (conv_id * 10000 + turn) * 4 + 3, NULL, 'conversations', text FROM conversations""")
cte("prep", f"""SELECT msg_id, ts, source, coalesce(raw, '') AS text,
    len(coalesce(raw, '')) AS characters, len(coalesce(raw, '')) > {lists.MAX_CHARACTERS} AS truncated,
    NOT regexp_matches(coalesce(raw, ''), {q(f'[^{WS}]')}) AS is_empty FROM corpus""", True)

# ---- headers --------------------------------------------------------------------------------
cte("line", f"""SELECT msg_id, pos, line, CASE WHEN NOT regexp_matches(line, {q(f'[^{WS}]')}) THEN 'b'
    WHEN regexp_matches(line, '^[ \\t]') THEN 'l' WHEN regexp_matches(line, {q(FIELD)}) THEN 'f' ELSE 'o' END AS kind
    FROM (SELECT msg_id, unnest(string_split_regex(text, '\\r?\\n')) AS line,
    generate_subscripts(string_split_regex(text, '\\r?\\n'), 1) AS pos FROM prep)""", True)
cte("first_line", """SELECT msg_id, min(pos) AS first_pos, arg_min(kind, pos) AS first_kind FROM line WHERE kind <> 'b' GROUP BY msg_id""")
cte("stop_line", f"""SELECT f.msg_id, first_pos, coalesce(min(pos) FILTER (kind IN ('b', 'o') AND pos > first_pos), max(pos) + 1) AS stop_pos,
    arg_min(kind, pos) FILTER (kind IN ('b', 'o') AND pos > first_pos) AS stop_kind
    FROM first_line f JOIN line USING (msg_id) WHERE first_kind = 'f' GROUP BY ALL""")
cte("head_line", """SELECT l.* FROM line l JOIN stop_line s USING (msg_id) WHERE pos >= first_pos AND pos < stop_pos""")
cte("field_part", """SELECT *, sum(CASE WHEN kind = 'f' THEN 1 ELSE 0 END) OVER (PARTITION BY msg_id ORDER BY pos) AS field_no FROM head_line""")
cte("field", f"""SELECT msg_id, field_no, lower({trim("split_part(arg_min(line, pos), ':', 1)")}) AS key,
    string_agg(CASE WHEN kind = 'f' THEN {trim("line[position(':' IN line) + 1:]")} ELSE {trim('line')} END, ' ' ORDER BY pos) AS value
    FROM field_part GROUP BY msg_id, field_no""")
cte("header", "SELECT msg_id, key, arg_max(value, field_no) AS value FROM field GROUP BY msg_id, key", True)
cte("gate", f"""SELECT msg_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_strong, 0) AS n_strong,
    coalesce(n_lines, 0) >= 2 AND coalesce(n_strong, 0) >= 2 AS headers_found FROM prep
    LEFT JOIN (SELECT msg_id, count(*) AS n_lines FROM head_line GROUP BY msg_id) USING (msg_id)
    LEFT JOIN (SELECT msg_id, count(*) AS n_strong FROM header WHERE {among('key', lists.STRONG_HEADERS)} GROUP BY msg_id) USING (msg_id)""", True)
cte("body", """SELECT msg_id, source, CASE WHEN headers_found THEN array_to_string(string_split_regex(text, '\\r?\\n')
    [stop_pos + CASE WHEN stop_kind = 'b' THEN 1 ELSE 0 END:], chr(10)) ELSE text END AS body
    FROM prep JOIN gate USING (msg_id) LEFT JOIN stop_line USING (msg_id)""", True)
WIDE = ["from", "reply-to", "return-path", "message-id", "subject", "date", "authentication-results", "arc-authentication-results",
        "spf", "dkim", "dmarc", "received-spf", "x-spam-flag", "x-spam-status"]
col = lambda k: "h_" + k.replace("-", "_")
cte("wide", f"""SELECT msg_id, {', '.join(f"coalesce(max(value) FILTER (key = {q(k)}), '') AS {col(k)}" for k in WIDE)},
    count(*) AS header_count, bool_or(key = 'dkim-signature' AND value <> '') AS has_signature,
    bool_or({among('key', lists.FULL_MESSAGE_HEADERS)} AND value <> '') AS looks_full
    FROM header JOIN gate USING (msg_id) WHERE headers_found GROUP BY msg_id""")


def address(name, source, key):
    v = trim(col(key))
    cte(name, f"""SELECT msg_id, address, display, CASE WHEN contains(address, '@')
        THEN lower(string_split(address, '@')[-1]) ELSE '' END AS domain FROM (SELECT msg_id,
        {trim(f"CASE WHEN regexp_matches({v}, '<[^>]+>') THEN regexp_extract({v}, '<([^>]+)>', 1) ELSE regexp_replace({v}, '^\\[|\\]$', '', 'g') END")} AS address,
        CASE WHEN regexp_matches({v}, '<[^>]+>') THEN {trim(f"regexp_replace({trim(f"string_split_regex({v}, '<[^>]+>')[1]")}, {q('^["' + chr(39) + ']|["' + chr(39) + ']$')}, '', 'g')")}
        ELSE '' END AS display FROM {source})""")


address("addr_from", "wide", "from")
address("addr_reply", "wide", "reply-to")
address("addr_bounce", "wide", "return-path")


def auth(key):
    blob = "concat_ws(' ', " + ", ".join(f"nullif({col(k)}, '')" for k in ("authentication-results", "arc-authentication-results", key)) + ")"
    return f"lower(regexp_extract({blob}, {q(rf'(?i)\b{key}[{WS}]*=[{WS}]*([a-z]+)')}, 1))"


in_line = WS.replace(r"\n", "")
cte("sender", f"""SELECT w.msg_id, f.address AS from_address, f.display AS from_display, f.domain AS from_domain,
    {registrable('f.domain')} AS from_registrable, r.address AS reply_to, r.domain AS reply_to_domain, {registrable('r.domain')} AS reply_registrable,
    b.address AS return_path, b.domain AS return_path_domain, {registrable('b.domain')} AS return_registrable,
    h_subject AS subject, h_date AS date, h_message_id AS message_id,
    regexp_replace(lower(regexp_extract(h_message_id || ' ', {q(rf'(?i)@([a-z0-9.\-]+)[>{WS}]')}, 1)), '\\.$', '') AS message_domain,
    {count('p.text', q(rf'(?i)(?:^|\n)received[{in_line}]*:'))} AS received_count,
    coalesce(nullif({auth('spf')}, ''), lower(regexp_extract(h_received_spf, {q(rf'(?i)^[{WS}]*(pass|fail|softfail|neutral|none|permerror|temperror)')}, 1))) AS spf,
    {auth('dkim')} AS dkim, {auth('dmarc')} AS dmarc, h_authentication_results AS authentication_results, header_count,
    h_x_spam_flag AS spam_flag, h_x_spam_status AS spam_status, has_signature, looks_full
    FROM wide w JOIN prep p USING (msg_id) JOIN addr_from f USING (msg_id) JOIN addr_reply r USING (msg_id) JOIN addr_bounce b USING (msg_id)""", True)
BRAND_TOKENS = [(i, n, t) for i, (n, ts, _) in enumerate(lists.BRANDS, 1) for t in ts]
BRAND_DOMAINS = [(i, n, d) for i, (n, _, ds) in enumerate(lists.BRANDS, 1) for d in ds]
cte("brand_token", f"SELECT * FROM {values(BRAND_TOKENS)} t(brand_ord, brand, token)")
cte("brand_domain", f"SELECT *, row_number() OVER () AS domain_ord FROM {values(BRAND_DOMAINS)} t(brand_ord, brand, domain)")
cte("claimed", """SELECT msg_id, min(brand_ord) AS brand_ord FROM sender JOIN brand_token ON len(token) >= 4
    AND contains(lower(from_display), token) GROUP BY msg_id""")
differs = lambda c, r: f"from_domain <> '' AND {c} <> '' AND {r} <> from_registrable"
business = q(r"(?i)\b(?:finance|accounts|billing|hr|payroll|support|security|invoice|bank|remittance)\b")
HEADER_CHECKS = [
    ("reply_to_mismatch", differs("reply_to_domain", "reply_registrable"), "'From: ' || from_address || ' | Reply-To: ' || reply_to"),
    ("display_name_spoof", "c.brand_ord IS NOT NULL AND from_domain <> '' AND NOT EXISTS (SELECT 1 FROM brand_domain d "
     "WHERE d.brand_ord = c.brand_ord AND d.domain = from_registrable)", "'\"' || from_display || '\" <' || from_address || '>'"),
    ("free_mail_sender", f"from_domain <> '' AND {among('from_registrable', lists.FREE_MAIL_DOMAINS)} AND (c.brand_ord IS NOT NULL "
     f"OR regexp_matches(from_display || ' ' || subject, {business}))", "from_address"),
    ("return_path_mismatch", differs("return_path_domain", "return_registrable"), "'From: ' || from_address || ' | Return-Path: ' || return_path"),
    ("spf_fail", "spf IN ('fail', 'permerror')", "'spf=' || spf"),
    ("dkim_fail", "dkim = 'fail'", "'dkim=fail'"),
    ("dmarc_fail", "dmarc = 'fail'", "'dmarc=fail'"),
    ("spam_header", f"regexp_matches(spam_flag, {q(rf'(?i)^[{WS}]*yes')}) OR regexp_matches(spam_status[:40], '(?i)\\byes\\b')",
     "CASE WHEN spam_flag <> '' THEN 'X-Spam-Flag: ' || spam_flag ELSE 'X-Spam-Status: ' || spam_status[:60] END"),
    ("message_id_mismatch", differs("message_domain", registrable("message_domain")), "'Message-ID: ' || message_id[:90]"),
    ("missing_headers", "looks_full AND (date = '' OR message_id = '')",
     "CASE WHEN date = '' THEN 'Date header missing' ELSE 'Message-ID header missing' END"),
]
cte("header_finding", " UNION ALL ".join(
    f"SELECT msg_id, {q(r)} AS rule_id, {i} AS o1, {e} AS evidence FROM sender LEFT JOIN claimed c USING (msg_id) WHERE {w}"
    for i, (r, w, e) in enumerate(HEADER_CHECKS)), True)
note = lambda key, o, where, fill=None: "SELECT msg_id, {} AS o, {} FROM sender WHERE {}".format(o, ", ".join(
    (q(t) if fill is None else f"replace({q(t)}, '{{0}}', {fill})") + f" AS {n}" for t, n in zip(cat.NOTES[key], ("severity", "title", "text"))), where)
cte("note", " UNION ALL ".join([
    note("spf_pass", 1, "spf = 'pass'"), note("spf_other", 1, "spf NOT IN ('', 'pass', 'fail', 'permerror')", "spf"),
    note("dkim_pass", 2, "dkim = 'pass'"), note("dmarc_pass", 3, "dmarc = 'pass'"),
    note("no_auth", 4, "spf = '' AND dkim = '' AND dmarc = '' AND authentication_results = '' AND NOT has_signature"),
    "SELECT msg_id, 1, {} FROM gate WHERE NOT headers_found".format(", ".join(map(q, cat.NOTES["no_headers"])))]))

# ---- links ----------------------------------------------------------------------------------
placed("scheme_hit", "body", "body", SCHEME)
cte("scheme_raw", f"""SELECT msg_id, i, start_pos, regexp_replace(hit, {q('''[.,;:!?'")\\]}>]+$''')}, '') AS raw FROM scheme_hit""")
parsed("scheme_url", "scheme_raw", "raw")
cte("url1", """SELECT *, start_pos + len(raw) AS end_pos, row_number() OVER (PARTITION BY msg_id ORDER BY i) AS url_ord FROM
    (SELECT * FROM scheme_url WHERE raw <> '' AND host <> '' QUALIFY row_number() OVER (PARTITION BY msg_id, lower(normalized) ORDER BY i) = 1)""", True)
placed("bare_hit", "body", "body", BARE)
cte("url2", """SELECT b.msg_id, i, start_pos, hit AS raw, 'http://' || lower(hit) AS normalized, lower(hit) AS host FROM bare_hit b
    WHERE NOT regexp_matches(hit, '^[@/]')
    AND NOT EXISTS (SELECT 1 FROM url1 u WHERE u.msg_id = b.msg_id AND b.start_pos >= u.start_pos AND b.start_pos + len(hit) <= u.end_pos)
    AND NOT EXISTS (SELECT 1 FROM url1 u WHERE u.msg_id = b.msg_id AND lower(u.normalized) = 'http://' || lower(hit))
    QUALIFY row_number() OVER (PARTITION BY b.msg_id, lower(hit) ORDER BY i) = 1""")
cte("url", """SELECT msg_id, url_ord, raw, normalized, scheme, host, port, userinfo, tail, start_pos, end_pos, normalized <> raw AS defanged, FALSE AS bare FROM url1
    UNION ALL SELECT msg_id, coalesce(n, 0) + row_number() OVER (PARTITION BY msg_id ORDER BY i), raw, normalized, '(none)', host, '', '', '',
    start_pos, start_pos + len(raw), FALSE, TRUE FROM url2 LEFT JOIN (SELECT msg_id, count(*) AS n FROM url1 GROUP BY msg_id) USING (msg_id)""", True)
octet = "(?:25[0-5]|2[0-4]\\d|[01]?\\d{1,2})"
ip = "regexp_replace(host, '^\\[|\\]$', '', 'g')"
cte("host", f"""SELECT host, messages, {registrable('host')} AS registrable, string_split(lower(host), '.')[-1] AS tld,
    regexp_matches({ip}, '^{octet}(\\.{octet}){{3}}$') OR (contains({ip}, ':') AND regexp_matches({ip}, '(?i)^[0-9a-f:.]+$')) AS is_ip
    FROM (SELECT host, count(DISTINCT msg_id) AS messages FROM url GROUP BY host)""", True)
cte("host_core", f"""SELECT *, CASE WHEN {among('registrable', lists.MULTI_PART_SUFFIXES)} THEN registrable
    ELSE string_split(registrable, '.')[1] END AS core FROM host""")
cte("host_label", """SELECT host, label, i AS label_ord FROM (SELECT host, unnest(string_split(lower(host), '.')) AS label,
    generate_subscripts(string_split(lower(host), '.'), 1) AS i FROM host) WHERE label <> ''""")
cte("host_part", """SELECT host, label AS token, label_ord, 0 AS part_ord FROM host_label UNION ALL
    SELECT host, part, label_ord, j FROM (SELECT host, label_ord, unnest(string_split_regex(label, '[-_]+')) AS part,
    generate_subscripts(string_split_regex(label, '[-_]+'), 1) AS j FROM host_label) WHERE part <> ''""")
cte("host_brand", """SELECT host, min(brand_ord) AS brand_ord FROM host_part JOIN brand_token b
    ON CASE WHEN len(b.token) < 5 THEN host_part.token = b.token ELSE contains(host_part.token, b.token) END GROUP BY host""")
cte("candidate", f"""SELECT host, token, min(o) AS o FROM (SELECT host, token, label_ord * 1000 + part_ord AS o FROM host_part
    UNION ALL SELECT host, regexp_replace(core, '[-_]', '', 'g'), 1000000000 FROM host_core)
    WHERE len(token) >= 5 AND NOT {among('token', lists.HOST_STOPWORDS)} GROUP BY host, token""")
TARGETS = [(i, b, d, c) for i, (b, d, c) in enumerate(typosquat_targets(), 1)]
cte("typo", f"""SELECT host, t.brand, t.domain, levenshtein(token, t.core) AS distance FROM candidate JOIN host USING (host)
    JOIN {values(TARGETS)} t(target_ord, brand, domain, core) ON levenshtein(token, t.core) BETWEEN 1 AND 2
    WHERE registrable NOT IN (SELECT domain FROM brand_domain)
    QUALIFY row_number() OVER (PARTITION BY host ORDER BY target_ord, o) = 1""")
cte("brand", f"SELECT * FROM {values([(i, n, ', '.join(ds)) for i, (n, _, ds) in enumerate(lists.BRANDS, 1)])} t(brand_ord, brand, domains)")
cte("profile", """SELECT h.host, messages, registrable, core, tld, is_ip, coalesce(b.brand, '') AS brand, coalesce(b.domains, '') AS domains,
    EXISTS (SELECT 1 FROM brand_domain d WHERE d.brand_ord = hb.brand_ord AND d.domain = registrable) AS is_official,
    coalesce(t.brand, '') AS typo_brand, coalesce(t.domain, '') AS typo_domain, coalesce(t.distance, 0) AS typo_distance
    FROM host_core h LEFT JOIN host_brand hb USING (host) LEFT JOIN brand b USING (brand_ord) LEFT JOIN typo t USING (host)""", True)


FLAG_WHERE = {
    "ip_address_url": "is_ip", "shortened_url": among("registrable", lists.SHORTENERS), "risky_tld": among("tld", lists.RISKY_TLDS),
    "brand_lookalike_domain": "brand <> '' AND NOT is_official", "typosquat_domain": "typo_brand <> ''",
    "homoglyph_domain": "regexp_matches(host, '[^\\x00-\\x7F]') OR contains(host, 'xn--')",
    "many_subdomains": "len(string_split(host, '.')) >= 4", "at_sign_in_url": "userinfo <> ''", "no_https": "scheme = 'http'",
    "nonstandard_port": "port NOT IN ('', '80', '443')", "encoded_url_chars": count("normalized", "'(?i)%[0-9a-f]{2}'") + " >= 3",
    "defanged_link": "defanged", "bare_domain": "bare"}
FLAG_ARGS = {"risky_tld": ["tld"], "brand_lookalike_domain": ["brand", "domains"],
             "typosquat_domain": ["typo_brand", "typo_domain", "CAST(typo_distance AS VARCHAR)"], "nonstandard_port": ["port"]}


def flag_sql(i, key):
    tone, label, text = cat.LINK_FLAGS[key]

    def fill(t):
        s = q(t)
        for n, a in enumerate(FLAG_ARGS.get(key, [])):
            s = f"replace({s}, '{{{n}}}', {a})"
        return s
    return (f"SELECT msg_id, url_ord, raw, {i} AS o, {q(key)} AS flag_id, {q(tone)} AS tone, {fill(label)} AS label, "
            f"{fill(text)} AS note FROM url JOIN profile USING (host) WHERE {FLAG_WHERE[key]}")


cte("flag", " UNION ALL ".join(flag_sql(i, k) for i, k in enumerate(cat.LINK_FLAGS)), True)
cte("flag_note", """SELECT msg_id, flag_id, note, min(url_ord) AS u FROM flag GROUP BY ALL""")
cte("url_finding", f"""SELECT msg_id, flag_id AS rule_id, min(url_ord) * 100 + min(o) AS o1,
    array_to_string(list(raw ORDER BY url_ord)[:4], ' | ') AS evidence, any_value(extra) AS extra FROM flag
    JOIN (SELECT msg_id, flag_id, array_to_string(list(note ORDER BY u)[:2], ' ') AS extra FROM flag_note GROUP BY ALL) USING (msg_id, flag_id)
    WHERE {among('flag_id', [r.rule_id for r in cat.LINK_RULES])} GROUP BY msg_id, flag_id""")

# ---- files ----------------------------------------------------------------------------------
cte("file_body", "SELECT msg_id, body FROM body WHERE regexp_matches(body, {})".format(
    q(rf"(?i)\.(?:{'|'.join(lists.all_extensions())})\b")), True)
placed("file_hit", "file_body", "body", q(FILE))
cte("mention", f"""SELECT msg_id, i, lower(regexp_extract(hit, {q(FILE)}, 1)) AS name,
    start_pos + len(hit) - len(regexp_extract(hit, {q(FILE)}, 1)) AS start_pos, start_pos + len(hit) AS end_pos FROM file_hit""", True)
inside = "EXISTS (SELECT 1 FROM url u WHERE u.msg_id = m.msg_id AND m.start_pos >= u.start_pos AND m.end_pos <= u.end_pos)"
cte("file", f"""SELECT msg_id, name, row_number() OVER (PARTITION BY msg_id ORDER BY i) AS file_ord, regexp_extract(name, '\\.([a-z0-9]+)$', 1) AS ext
    FROM (SELECT msg_id, name, min(i) AS i FROM mention m WHERE NOT {inside} GROUP BY msg_id, name)""", True)
cte("ext_group", f"SELECT * FROM {values(ext_group())} t(ext, grp)")
double = "regexp_matches(name, {})".format(q(rf"\.(?:{'|'.join(lists.DOUBLE_EXTENSION_FIRST)})\.(?:{'|'.join(lists.DOUBLE_EXTENSION_LAST)})$"))
cte("file_rule", f"""SELECT msg_id, file_ord, name, 1 AS o, 'double_extension' AS rule_id FROM file WHERE {double}
    UNION ALL SELECT msg_id, file_ord, name, 2, g.rule_id FROM file JOIN ext_group USING (ext) JOIN {values(GROUP_RULES)} g(grp, rule_id) USING (grp) WHERE NOT {double}
    UNION ALL SELECT msg_id, file_ord, name, 3, 'unusual_attachment_name' FROM file
    WHERE regexp_matches(name, '\\d{{3,}}|^(?:document|doc|file|image|scan|attachment|copy|invoice|report)[ _-]?\\d*\\.')""")
cte("file_finding", """SELECT msg_id, rule_id, min(file_ord * 10 + o) AS o1, array_to_string(list(name ORDER BY file_ord)[:5], ' | ') AS evidence
    FROM file_rule GROUP BY msg_id, rule_id""")

# ---- HTML -----------------------------------------------------------------------------------
cte("html", f"SELECT msg_id, text FROM prep WHERE {count('text', TAG)} >= 3", True)
cte("anchor_hit", f"SELECT msg_id, unnest(regexp_extract_all(text, {ANCHOR})) AS a, generate_subscripts(regexp_extract_all(text, {ANCHOR}), 1) AS anchor_ord FROM html")
g = lambda i: f"regexp_extract(a, {ANCHOR}, {i})"
strip = f"regexp_replace({g(4)}, '<[^>]*>', ' ', 'g')"
for _e, _c in (("nbsp", " "), ("amp", "&"), ("lt", "<"), ("gt", ">")):
    strip = f"regexp_replace({strip}, '(?i)&{_e};', {q(_c)}, 'g')"
cte("anchor_raw", f"SELECT msg_id, anchor_ord, {trim(f'{g(1)} || {g(2)} || {g(3)}')} AS href, {squeeze(strip)} AS text FROM anchor_hit")
parsed("anchor", "anchor_raw", "href")
cte("anchor_shown", f"""SELECT *, lower(regexp_replace(regexp_replace(regexp_extract(text, {HOSTISH}), '(?i)^https?://', ''), '(?i)^www\\.', '')) AS shown,
    {registrable('host')} AS real_reg FROM anchor WHERE host <> ''""")
cte("mismatch", f"""SELECT msg_id, anchor_ord, CASE WHEN shown <> '' THEN '"' || text[:60] || '" actually points to ' || host
    ELSE '"' || text[:60] || '" is a shortened link to ' || host END AS evidence FROM anchor_shown WHERE real_reg <> '' AND
    ((shown <> '' AND {registrable('shown')} <> real_reg) OR (shown = '' AND {among('real_reg', lists.SHORTENERS)}))""")
remote = rx(r"""(?:src|href|background)\s*=\s*["']https?://([^"'/]+)""")
cte("remote", f"""SELECT msg_id, host, row_number() OVER (PARTITION BY msg_id ORDER BY i) AS ord FROM (SELECT msg_id, host, min(i) AS i FROM
    (SELECT msg_id, lower(unnest(regexp_extract_all(text, {remote}, 1))) AS host, generate_subscripts(regexp_extract_all(text, {remote}, 1), 1) AS i FROM html)
    GROUP BY msg_id, host)""")
hidden = rx(r"(?:display\s*:\s*none|visibility\s*:\s*hidden|font-size\s*:\s*0(?:px|pt|em|%)?|opacity\s*:\s*0(?:\.0+)?)")
zero = r"""\s*=\s*["']?[01]\b[^>]*"""
HTML_CHECKS = [
    ("hidden_content", f"regexp_matches(text, {hidden})", f"array_to_string(regexp_extract_all(text, {hidden})[:3], ' , ')"),
    ("embedded_login_form", "regexp_matches(text, '(?i)<form\\b[^>]*>') OR regexp_matches(text, {}) OR regexp_matches(text, {})".format(
        rx(r"""<input\b[^>]*type\s*=\s*["']?password"""), rx(r"""name\s*=\s*["']?(?:pass|password|pwd)["']?""")), "'password input field found in the source'"),
    ("tracking_pixel", f"regexp_matches(text, {rx(rf'<img\b[^>]*width{zero}height{zero}>|<img\b[^>]*height{zero}width{zero}>')})", "'a 1x1 image element'"),
    ("entity_obfuscation", f"{count('text', q('(?i)&#x?[0-9a-f]{2,4};'))} >= 12 OR {count('text', q('(?i)%3c|%3e'))} >= 3",
     f"{count('text', q('(?i)&#x?[0-9a-f]{2,4};'))} || ' HTML entity codes and ' || {count('text', q('(?i)%3c|%3e'))} || ' encoded tag characters'"),
    ("javascript_href", "regexp_matches(text, {})".format(rx(r"""href\s*=\s*["']?\s*javascript:""")), "'javascript: link found in the source'"),
    ("data_uri_link", "regexp_matches(text, {})".format(rx(r"""href\s*=\s*["']\s*data:""")), "'data: link found in the source'"),
]
ORDER_HTML = ["hidden_content", "embedded_login_form", "tracking_pixel", "remote_resources", "entity_obfuscation", "javascript_href", "data_uri_link", "misleading_link_text"]
cte("html_finding", " UNION ALL ".join(
    [f"SELECT msg_id, {q(r)} AS rule_id, {ORDER_HTML.index(r)} AS o1, {e} AS evidence FROM html WHERE {w}" for r, w, e in HTML_CHECKS]
    + ["SELECT msg_id, 'remote_resources', 3, array_to_string(list(host ORDER BY ord)[:4], ', ') FROM remote GROUP BY msg_id",
       "SELECT msg_id, 'misleading_link_text', 7, array_to_string(list(evidence ORDER BY anchor_ord)[:2], ' ; ') FROM mismatch GROUP BY msg_id"]), True)

# ---- language rules -------------------------------------------------------------------------
cte("text_hit", " UNION ALL ".join(
    f"SELECT msg_id, {q(r.rule_id)} AS rule_id, {i} AS o1 FROM body WHERE " + " OR ".join(f"regexp_matches(body, {rx(p)})" for p in r.patterns)
    for i, r in enumerate(cat.TEXT_RULES)), True)


def snippet(p):
    at = f"len(string_split_regex(body, {rx(p)})[1])"
    return squeeze(f"body[greatest({at} - 45, 0) + 1:{at} + len(regexp_extract(body, {rx(p)})) + 45]")


cte("snippet_all", " UNION ALL ".join(
    f"SELECT msg_id, {q(r.rule_id)} AS rule_id, {j} AS p, {snippet(p)} AS snippet, regexp_extract(body, {rx(p)}) AS hit FROM body JOIN (SELECT msg_id FROM text_hit WHERE rule_id = {q(r.rule_id)}) USING (msg_id) "
    f"WHERE regexp_matches(body, {rx(p)})" for r in cat.TEXT_RULES for j, p in enumerate(r.patterns)))
cte("snippet", "SELECT msg_id, rule_id, snippet, hit, row_number() OVER (PARTITION BY msg_id, rule_id ORDER BY p) AS ord FROM snippet_all QUALIFY ord <= 3", True)

# ---- findings -------------------------------------------------------------------------------
cte("rule", "SELECT *, row_number() OVER (ORDER BY points DESC, title COLLATE en) AS registry_rank FROM " + values([(r.rule_id, r.source, cat.REGISTRY_SOURCE[r.source], r.category, r.severity, r.points, r.title, r.advice, n,
                                       lists.SEVERITIES[r.severity][0], lists.SEVERITIES[r.severity][1])
    for n, r in enumerate(cat.ALL_RULES, 1)])
    + " t(rule_id, source, registry_source, category, severity, points, title, advice, place, rank_actual, rank_documented)")
cte("base", """SELECT msg_id, rule_id, 1 AS so, o1 FROM text_hit UNION ALL SELECT msg_id, rule_id, 2, o1 FROM url_finding
    UNION ALL SELECT msg_id, rule_id, 3, o1 FROM file_finding UNION ALL SELECT msg_id, rule_id, 4, o1 FROM html_finding
    UNION ALL SELECT msg_id, rule_id, 5, o1 FROM header_finding""", True)
CLAUSES = [(i, c, n, r) for i, (c, sets) in enumerate(cat.COMBO_CLAUSES.items()) for n, rules in enumerate(sets) for r in rules]
cte("combo", f"""SELECT msg_id, combo AS rule_id, combo_ord AS o1 FROM base JOIN {values(CLAUSES)} c(combo_ord, combo, clause, rule_id) USING (rule_id)
    GROUP BY msg_id, combo, combo_ord HAVING count(DISTINCT clause) = 2""")
cte("finding", """SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY so, o1) AS seq FROM
    (SELECT * FROM base UNION ALL SELECT msg_id, rule_id, 6, o1 FROM combo) JOIN rule USING (rule_id)""", True)
cte("hosts", "SELECT msg_id, host, row_number() OVER (PARTITION BY msg_id ORDER BY o) AS ord FROM (SELECT msg_id, host, min(url_ord) AS o FROM url GROUP BY ALL)")
cte("combo_evidence", """SELECT msg_id, rule_id, CASE WHEN rule_id = 'combo_credential_link' THEN coalesce(e, '') ELSE '' END AS evidence
    FROM combo LEFT JOIN (SELECT msg_id, string_agg(host, ' | ' ORDER BY ord) AS e FROM hosts WHERE ord <= 2 GROUP BY msg_id) USING (msg_id)""")
cte("evidence", """SELECT msg_id, rule_id, string_agg(snippet, ' | ' ORDER BY ord) AS evidence FROM snippet GROUP BY ALL
    UNION ALL SELECT msg_id, rule_id, evidence FROM url_finding UNION ALL SELECT msg_id, rule_id, evidence FROM file_finding
    UNION ALL SELECT msg_id, rule_id, evidence FROM html_finding UNION ALL SELECT msg_id, rule_id, evidence FROM header_finding
    UNION ALL SELECT msg_id, rule_id, evidence FROM combo_evidence""")
sev = ", ".join(f"count(*) FILTER (severity = '{s}') AS n_{s}" for s in lists.SEVERITIES)
cte("score", f"""SELECT msg_id, coalesce(raw_score, 0) AS raw_score, least(coalesce(raw_score, 0), 100) AS score, coalesce(raw_score, 0) > 100 AS capped,
    CASE WHEN coalesce(raw_score, 0) = 0 THEN 'clear' WHEN raw_score < 25 THEN 'low' WHEN raw_score < 55 THEN 'medium' ELSE 'high' END AS band,
    {', '.join(f'coalesce(n_{s}, 0) AS n_{s}' for s in lists.SEVERITIES)}, coalesce(n_counted, 0) AS n_counted
    FROM prep LEFT JOIN (SELECT msg_id, CAST(sum(points) AS BIGINT) AS raw_score, {sev}, count(*) FILTER (points > 0) AS n_counted FROM finding GROUP BY msg_id) USING (msg_id)""", True)
cte("counts", """SELECT msg_id, coalesce(u, 0) AS url_count, coalesce(f, 0) AS file_count, headers_found, msg_id IN (SELECT msg_id FROM html) AS html_found FROM gate
    LEFT JOIN (SELECT msg_id, count(*) AS u FROM url GROUP BY msg_id) USING (msg_id) LEFT JOIN (SELECT msg_id, count(*) AS f FROM file GROUP BY msg_id) USING (msg_id)""")
cte("ranked", """SELECT msg_id, rule_id, seq, points, title, row_number() OVER (PARTITION BY msg_id ORDER BY rank_actual, points DESC, seq) AS rank,
    row_number() OVER (PARTITION BY msg_id ORDER BY rank_documented, points DESC, seq) AS rank_documented, advice FROM finding""")
adv = lambda k: f"{q(cat.ADVICE[k][0])} AS tag, {q(cat.ADVICE[k][1])} AS text"
cte("advice1", f"""SELECT msg_id, 0 AS o, {adv('never_test')} FROM score UNION ALL SELECT msg_id, 1, {adv('acted_now')} FROM score WHERE band = 'high'
    UNION ALL SELECT msg_id, 1 + rank, {q(cat.FINDING_ADVICE_TAG)}, advice FROM ranked WHERE points > 0
    UNION ALL SELECT msg_id, 1000, {adv('verify')} FROM score UNION ALL SELECT msg_id, 1001, {adv('report')} FROM score""")
cte("advice2", f"""SELECT * FROM advice1 UNION ALL SELECT DISTINCT msg_id, 1002, {adv('bank_call')} FROM advice1 WHERE regexp_matches(text, '(?i)bank details|payment')
    UNION ALL SELECT DISTINCT msg_id, 1003, {adv('macro_care')} FROM advice1 WHERE regexp_matches(text, '(?i)macro')
    UNION ALL SELECT msg_id, 1004, {adv('quiet')} FROM score WHERE n_counted = 0 UNION ALL SELECT msg_id, 1005, {adv('keep_evidence')} FROM score""")
cte("advice", """SELECT msg_id, tag, text, row_number() OVER (PARTITION BY msg_id ORDER BY o) AS rank FROM (SELECT * FROM advice2
    QUALIFY row_number() OVER (PARTITION BY msg_id, lower(text)[:90] ORDER BY o) = 1) QUALIFY rank <= 8""")
cte("prevalence", "SELECT rule_id, count(*) AS messages, CAST(sum(points) AS BIGINT) AS points_given FROM finding GROUP BY rule_id")
cte("mail_score", "SELECT m.msg_id, ts, raw_score, score, band, coalesce(from_registrable, '') AS sender_domain FROM mails m JOIN score USING (msg_id) LEFT JOIN sender USING (msg_id)")

NEW = {r[1]: r for r in ADDED_RULES}
cte("own_rule", f"""SELECT rule_id, points, false AS is_new FROM rule WHERE NOT {among('rule_id', NEW)}
    UNION ALL SELECT * FROM {values([(i, r[5], i not in cat.RULE_BY_ID) for i, r in NEW.items()])} t(rule_id, points, is_new)""")
cte("own_base", "SELECT msg_id, rule_id FROM base UNION ALL " + " UNION ALL ".join(
    f"SELECT msg_id, {q(rule)} FROM body WHERE " + " OR ".join(f"regexp_matches(body, {rx(p)})" for r, _, p in ADDED_PATTERNS if r == rule)
    for rule in dict.fromkeys(r for r, _, _ in ADDED_PATTERNS)))
cte("own_combo", f"""SELECT msg_id, combo FROM own_base JOIN {values([(c, k, m) for c, k, _, m in ADDED_COMBOS])} c(combo, clause, rule_id)
    USING (rule_id) GROUP BY msg_id, combo HAVING count(DISTINCT clause) = 2""")
cte("own_all", """SELECT msg_id, rule_id, points, is_new FROM (SELECT * FROM own_base UNION ALL SELECT msg_id, rule_id FROM combo
    UNION ALL SELECT * FROM own_combo) JOIN own_rule USING (rule_id)""")

LOOKUP = [(n, v) for n, vs in (("multi_part_suffix", lists.MULTI_PART_SUFFIXES), ("risky_tld", lists.RISKY_TLDS),
                               ("shortener", lists.SHORTENERS), ("free_mail", lists.FREE_MAIL_DOMAINS),
                               ("host_stopword", lists.HOST_STOPWORDS), ("severity", lists.SEVERITIES),
                               ("category", lists.CATEGORY_ORDER)) for v in vs]
LOOKUP += [("brand", b) for b, _, _ in lists.BRANDS] + [("band", b[0]) for b in cat.BANDS]
LOOKUP += [(n, f"{b[0]}/{v}") for b in lists.BRANDS for n, vs in (("brand_token", b[1]), ("brand_domain", b[2])) for v in vs]
EXPECTED = [(i, g_, *GOLDEN_EXPECTED[g_]) for i, g_ in enumerate(GOLDEN_IDS)]

FINAL = {
    "messages_prepare": f"SELECT msg_id, characters, truncated, is_empty, {count('body', q(f'[^{WS}]+'))} AS words FROM prep JOIN body USING (msg_id)",
    "header_lines": "SELECT msg_id, pos, kind, line FROM head_line",
    "header_kv": "SELECT msg_id, key, value FROM header",
    "header_gate": "SELECT msg_id, n_lines, n_strong, headers_found, len(body) AS body_length, md5(body) AS body_md5 FROM gate JOIN body USING (msg_id)",
    "address_parse": "SELECT msg_id, from_address, from_display, from_domain, from_registrable, reply_to, reply_to_domain, return_path, return_path_domain FROM sender",
    "auth_verdict": "SELECT msg_id, spf, dkim, dmarc FROM sender",
    "sender_summary": """SELECT msg_id, from_address, from_display, from_domain, from_registrable, reply_to, reply_to_domain, return_path, subject, date,
        message_id, received_count, spf, dkim, dmarc, authentication_results, header_count FROM sender""",
    "auth_notes": "SELECT msg_id, row_number() OVER (PARTITION BY msg_id ORDER BY o) AS ord, severity, title, text FROM note",
    "url_extract": "SELECT msg_id, url_ord, raw, normalized, scheme, host, port, userinfo, tail, start_pos, end_pos, defanged FROM url WHERE NOT bare",
    "bare_host_extract": "SELECT msg_id, url_ord, raw, host, start_pos, end_pos FROM url WHERE bare",
    "url_parse": f"SELECT msg_id, scheme, host, port, userinfo, tail, {registrable('host')} AS registrable, string_split(host, '.')[-1] AS tld FROM page_url",
    "file_extract": "SELECT msg_id, file_ord, name, ext FROM file",
    "html_gate": "SELECT msg_id, msg_id IN (SELECT msg_id FROM html) AS html_found FROM prep",
    "anchor_extract": "SELECT msg_id, anchor_ord, href, text, host, scheme, userinfo FROM anchor",
    "remote_hosts": "SELECT msg_id, ord, host FROM remote",
    "content_profile": """SELECT source, count(*) AS messages, count(*) FILTER (headers_found) AS with_headers, count(*) FILTER (html_found) AS with_html,
        CAST(sum(url_count) AS BIGINT) AS links, CAST(sum(coalesce(f, 0)) AS BIGINT) AS files FROM prep JOIN counts USING (msg_id)
        LEFT JOIN (SELECT msg_id, count(DISTINCT name) AS f FROM mention GROUP BY msg_id) USING (msg_id) GROUP BY source""",
    "first_seen_dedupe": """SELECT msg_id, row_number() OVER (PARTITION BY msg_id ORDER BY first_pos) AS ord, name, first_pos, mentions
        FROM (SELECT msg_id, name, min(start_pos) AS first_pos, count(*) AS mentions FROM mention GROUP BY ALL)""",
    "span_containment": f"SELECT msg_id, name, start_pos, end_pos FROM mention m WHERE {inside}",
    "ext_group_join": "SELECT msg_id, name, ext, grp FROM file JOIN ext_group USING (ext)",
    "text_rules": "SELECT msg_id, rule_id FROM text_hit",
    "text_evidence": """SELECT msg_id, rule_id, ord, snippet, hit AS match,
        CAST(strpos(lower(snippet), lower(hit)) - 1 AS BIGINT) AS match_at FROM snippet""",
    "url_flags": "SELECT msg_id, url_ord, row_number() OVER (PARTITION BY msg_id, url_ord ORDER BY o) AS flag_ord, flag_id, tone, label, note FROM flag",
    "url_rules": "SELECT msg_id, rule_id, row_number() OVER (PARTITION BY msg_id ORDER BY o1) AS seq, evidence, extra FROM url_finding",
    "attachment_rules": "SELECT msg_id, rule_id, row_number() OVER (PARTITION BY msg_id ORDER BY o1) AS seq, evidence FROM file_finding",
    **{name: f"SELECT msg_id, rule_id, evidence FROM {part}_finding WHERE {among('rule_id', ids)}" for name, (part, ids) in PART_RULES.items()},
    "host_profile": "SELECT host, messages, registrable, core, tld, is_ip, brand, is_official, typo_brand, typo_domain, typo_distance FROM profile",
    "shortener_join": f"SELECT msg_id, url_ord, host, registrable FROM url JOIN host USING (host) WHERE {among('registrable', lists.SHORTENERS)}",
    "risky_tld_join": f"SELECT msg_id, url_ord, host, tld FROM url JOIN host USING (host) WHERE {among('tld', lists.RISKY_TLDS)}",
    "brand_lookalike": "SELECT host, registrable, brand, messages FROM profile WHERE brand <> '' AND NOT is_official",
    "typosquat": "SELECT host, typo_brand, typo_domain, typo_distance, messages FROM profile WHERE typo_brand <> ''",
    "homoglyph_subdomain_port_flags": "SELECT msg_id, url_ord, host, " + ", ".join(f"({FLAG_WHERE[k]}) AS {k}" for k in (
        "ip_address_url", "homoglyph_domain", "many_subdomains", "at_sign_in_url", "no_https", "nonstandard_port", "encoded_url_chars"))
        + " FROM url JOIN profile USING (host)",
    "distinct_hosts": "SELECT msg_id, ord, host FROM hosts",
    "finding_enrich": "SELECT msg_id, seq, rule_id, source, category, severity, CAST(points AS BIGINT) AS points, title FROM finding",
    "findings_union": "SELECT msg_id, rule_id, source, category, severity, CAST(points AS BIGINT) AS points, seq, evidence FROM finding JOIN evidence USING (msg_id, rule_id)",
    "combination_rules": "SELECT msg_id, rule_id, evidence FROM combo_evidence",
    "score": "SELECT msg_id, raw_score, score, capped FROM score",
    "band_lookup": "SELECT msg_id, score, band, label FROM score JOIN {} b(id, lo, hi, label, blurb) ON score BETWEEN lo AND hi".format(values(cat.BANDS)),
    "severity_stats": "SELECT msg_id, n_critical, n_high, n_medium, n_low, n_info, n_counted FROM score",
    "category_subtotals": """SELECT msg_id, category, category_ord, count(*) AS items, CAST(sum(points) AS BIGINT) AS points FROM finding
        JOIN {} c(category, category_ord) USING (category) GROUP BY ALL""".format(values([(c, i) for i, c in enumerate(lists.CATEGORY_ORDER, 1)])),
    "detection_counts": "SELECT msg_id, url_count, file_count, headers_found, html_found, n_counted FROM counts JOIN score USING (msg_id)",
    "score_breakdown": """SELECT msg_id, row_number() OVER (PARTITION BY msg_id ORDER BY o) AS line, label, CAST(points AS BIGINT) AS points FROM
        (SELECT msg_id, rank AS o, rule_id AS label, points FROM ranked WHERE points > 0 UNION ALL SELECT msg_id, 1000, 'Total before cap', raw_score FROM score WHERE n_counted > 0
        UNION ALL SELECT msg_id, 1001, CASE WHEN capped THEN 'Final score (capped at 100)' ELSE 'Final score' END, score FROM score WHERE n_counted > 0
        UNION ALL SELECT msg_id, 1002, 'No scoring rule matched this message.', 0 FROM score WHERE n_counted = 0)""",
    "finding_order": "SELECT msg_id, rank, rank_documented, seq, rule_id FROM ranked",
    "recommendations": "SELECT msg_id, rank, tag, text FROM advice",
    "top_evidence": """SELECT msg_id, rule_id, ord, snippet AS evidence FROM snippet
        UNION ALL SELECT msg_id, flag_id, row_number() OVER (PARTITION BY msg_id, flag_id ORDER BY url_ord) AS n, raw FROM flag WHERE %s QUALIFY n <= 4
        UNION ALL SELECT msg_id, rule_id, row_number() OVER (PARTITION BY msg_id, rule_id ORDER BY file_ord) AS n, name FROM file_rule QUALIFY n <= 5
        UNION ALL SELECT msg_id, rule_id, 1, evidence FROM html_finding
        UNION ALL SELECT msg_id, rule_id, 1, CASE WHEN rule_id IN ('reply_to_mismatch', 'return_path_mismatch') THEN split_part(evidence, ' | ', 1) ELSE evidence END FROM header_finding
        UNION ALL SELECT msg_id, rule_id, 2, split_part(evidence, ' | ', 2) FROM header_finding WHERE rule_id IN ('reply_to_mismatch', 'return_path_mismatch')
        UNION ALL SELECT msg_id, rule_id, ord, host FROM combo JOIN hosts USING (msg_id) WHERE rule_id = 'combo_credential_link' AND ord <= 2"""
        % among("flag_id", [r.rule_id for r in cat.LINK_RULES]),
    "verdict": """SELECT msg_id, raw_score, score, capped, band, n_critical, n_high, n_medium, n_low, n_info, n_counted, url_count, file_count,
        headers_found, html_found FROM score JOIN counts USING (msg_id)""",
    "report_fields": """SELECT msg_id, score, raw_score, capped, band, label, url_count, file_count, n_counted, characters, r.rule_id AS first_rule,
        title AS first_title, coalesce(n_findings, 0) AS n_findings, n_recommendations, first_advice
        FROM score JOIN {} b(id, lo, hi, label, blurb) ON score BETWEEN lo AND hi JOIN counts USING (msg_id) JOIN prep USING (msg_id)
        LEFT JOIN (SELECT msg_id, rule_id FROM ranked WHERE rank = 1) r USING (msg_id) LEFT JOIN rule ON rule.rule_id = r.rule_id
        LEFT JOIN (SELECT msg_id, count(*) AS n_findings FROM ranked GROUP BY msg_id) USING (msg_id)
        LEFT JOIN (SELECT msg_id, count(*) AS n_recommendations, arg_min(text, rank) AS first_advice FROM advice GROUP BY msg_id) USING (msg_id)
        """.format(values(cat.BANDS)),
    "rule_registry": "SELECT registry_rank, rule_id, registry_source, title, severity, CAST(points AS BIGINT) AS points, coalesce(messages, 0) AS messages FROM rule LEFT JOIN prevalence USING (rule_id)",
    "lookup_dims": f"""SELECT list, entry, count(DISTINCT msg_id) AS messages FROM {values(LOOKUP)} d(list, entry) LEFT JOIN (
        SELECT 'multi_part_suffix' AS list, array_to_string(string_split(registrable, '.')[-2:], '.') AS entry, msg_id FROM url JOIN host USING (host)
        UNION ALL SELECT 'risky_tld', tld, msg_id FROM url JOIN host USING (host) UNION ALL SELECT 'shortener', registrable, msg_id FROM url JOIN host USING (host)
        UNION ALL SELECT 'free_mail', from_registrable, msg_id FROM sender) USING (list, entry) GROUP BY list, entry""",
    "tld_union": f"""SELECT t.tld, {among('t.tld', lists.RISKY_TLDS)} AS is_risky, count(url_ord) AS links FROM {values([(t,) for t in lists.all_tlds()])} t(tld)
        LEFT JOIN (SELECT tld, url_ord FROM url JOIN host USING (host)) u ON u.tld = t.tld GROUP BY t.tld""",
    "ext_union": "SELECT ext, grp, count(msg_id) AS files FROM ext_group LEFT JOIN file USING (ext) GROUP BY ext, grp",
    "rule_coverage": f"""SELECT indicator, i.rule_id, severity IS NOT NULL AS registered, coalesce(severity, '') AS severity, CAST(coalesce(points, 0) AS BIGINT) AS points,
        coalesce(messages, 0) AS messages FROM {values(cat.REQUIRED_INDICATORS)} i(indicator, rule_id) LEFT JOIN rule USING (rule_id) LEFT JOIN prevalence USING (rule_id)""",
    "band_distribution": f"""SELECT b.id AS band, count(msg_id) AS messages, round(count(msg_id) / sum(count(msg_id)) OVER (), 6) AS share,
        round(coalesce(avg(score), 0), 6) AS avg_score FROM {values(cat.BANDS)} b(id, lo, hi, label, blurb) LEFT JOIN score s ON s.band = b.id GROUP BY b.id""",
    "rule_prevalence": "SELECT rule_id, coalesce(messages, 0) AS messages, coalesce(points_given, 0) AS points_given FROM rule LEFT JOIN prevalence USING (rule_id)",
    "rule_cooccurrence": """SELECT a.rule_id AS rule_a, b.rule_id AS rule_b, count(*) AS messages,
        round(count(*) * (SELECT count(*) FROM prep) / (any_value(pa.messages) * any_value(pb.messages)), 6) AS lift
        FROM finding a JOIN finding b ON a.msg_id = b.msg_id AND a.rule_id < b.rule_id JOIN prevalence pa ON pa.rule_id = a.rule_id
        JOIN prevalence pb ON pb.rule_id = b.rule_id GROUP BY a.rule_id, b.rule_id""",
    "domain_leaderboard": """SELECT registrable, count(DISTINCT msg_id) AS messages, count(flag_id) AS flags,
        CASE max(CASE tone WHEN 'bad' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) WHEN 2 THEN 'bad' WHEN 1 THEN 'warn' ELSE 'ok' END AS worst_tone
        FROM url JOIN host USING (host) LEFT JOIN (SELECT * FROM flag WHERE tone <> 'ok') USING (msg_id, url_ord) GROUP BY registrable
        ORDER BY messages DESC, registrable LIMIT 20""",
    "sender_profile": "SELECT from_registrable AS sender_domain, count(*) AS messages, " + ", ".join(
        f"count(*) FILTER ({c} = '{r}') AS {c}_{r}" for c in ("spf", "dkim", "dmarc") for r in ("pass", "fail"))
        + ", count(*) FILTER (band = 'high') AS high, round(sum(score) / count(*), 6) AS avg_score FROM sender JOIN score USING (msg_id) GROUP BY from_registrable",
    "duplicate_collapse": """SELECT c.msg_id, min(c.msg_id) OVER (PARTITION BY sha256(coalesce(raw, ''))) AS first_id,
        count(*) OVER (PARTITION BY sha256(coalesce(raw, ''))) AS copies, score, band FROM corpus c JOIN score USING (msg_id)""",
    "golden_check": f"""SELECT msg_id, golden, expected_band, band, raw_score, CAST(expected_raw AS BIGINT) AS expected_raw,
        band <> expected_band OR score < coalesce(min_score, 0) OR score > coalesce(max_score, 100) AS failed FROM orders
        JOIN {values(EXPECTED)} e(template_id, golden, expected_band, min_score, max_score, expected_raw) ON o_orderkey % {len(TEMPLATES)} = template_id
        JOIN score ON msg_id = o_orderkey * 4""",
    "stream_score": "SELECT msg_id, raw_score, score, band FROM mail_score",
    "stream_band_window": "SELECT time_bucket(INTERVAL 30 DAY, ts, TIMESTAMP '1970-01-01') AS window_start, band, count(*) AS messages FROM mail_score GROUP BY ALL",
    "stream_dedupe": """SELECT sha256(raw) AS text_hash FROM mails
        QUALIFY coalesce(ts - lag(ts) OVER (PARTITION BY raw ORDER BY ts) > INTERVAL 7 DAY, true)""",
    "sender_burst": """SELECT date_trunc('day', ts) - to_days(CAST(d AS INTEGER)) AS window_start, sender_domain, count(*) AS mails, count(*) FILTER (band = 'high') AS high
        FROM mail_score CROSS JOIN range(7) r(d) GROUP BY ALL""",
    "sender_session": """SELECT sender_domain, min(ts) AS session_start, max(ts) AS session_end, count(*) AS mails, count(*) FILTER (band = 'high') AS high FROM
        (SELECT *, sum(starts) OVER (PARTITION BY sender_domain ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER
        (PARTITION BY sender_domain ORDER BY ts) <= INTERVAL 7 DAY THEN 0 ELSE 1 END AS starts FROM mail_score)) GROUP BY sender_domain, session""",
    "custom_rules": f"""SELECT msg_id, raw_score, least(raw_score, 100) AS score, band, n_findings, coalesce(added, '') AS added FROM
        (SELECT msg_id, CAST(coalesce(sum(points), 0) AS BIGINT) AS raw_score, count(rule_id) AS n_findings,
         string_agg(CASE WHEN is_new THEN rule_id END, ',' ORDER BY rule_id) AS added FROM prep LEFT JOIN own_all USING (msg_id) GROUP BY msg_id)
        JOIN {values(cat.BANDS)} b(band, lo, hi, label, blurb) ON least(raw_score, 100) BETWEEN lo AND hi""",
    "stream_session": """SELECT sender_domain, min(ts) AS session_start, max(ts) AS session_end, count(*) AS mails, count(*) FILTER (band = 'high') AS high FROM
        (SELECT *, sum(starts) OVER (PARTITION BY sender_domain ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER
        (PARTITION BY sender_domain ORDER BY ts) <= INTERVAL 7 DAY THEN 0 ELSE 1 END AS starts FROM mail_score)) GROUP BY sender_domain, session
        HAVING max(ts) + INTERVAL 14 DAY <= (SELECT max(ts) FROM mail_score)""",
    "stream_domain_leaderboard": """SELECT registrable AS domain, count(DISTINCT msg_id) AS messages FROM url JOIN host USING (host) JOIN mails USING (msg_id)
        GROUP BY registrable ORDER BY messages DESC, registrable LIMIT 20""",
}
FINAL["report_export"] = FINAL["report_fields"] + " WHERE band = 'high'"
FINAL["maintained_reports"] = " UNION ALL ".join(f"SELECT '{report}' AS report, {name} AS name, CAST(messages AS BIGINT) AS messages, CAST({value} AS DOUBLE) AS value FROM ({FINAL[of]})"
    for report, name, value, of in (("band", "band", "avg_score", "band_distribution"), ("rule", "rule_id", "points_given", "rule_prevalence"),
                                    ("pair", "rule_a || '+' || rule_b", "lift", "rule_cooccurrence"), ("domain", "registrable", "flags", "domain_leaderboard"),
                                    ("sender", "sender_domain", "avg_score", "sender_profile")))

# ---- reports --------------------------------------------------------------------------------
cte("seen", FINAL["top_evidence"])
cte("shown", "SELECT msg_id, rule_id, list(evidence ORDER BY ord) AS evidence FROM seen GROUP BY msg_id, rule_id")
cte("reason", "SELECT * FROM " + values([(r.rule_id, r.why) for r in cat.ALL_RULES]) + " t(rule_id, why)")
cte("sign", """SELECT msg_id, rank, rule_id, rule.category, rule.severity, rule.points, rule.title, why, rule.advice, coalesce(evidence, []) AS evidence
    FROM ranked JOIN rule USING (rule_id) JOIN reason USING (rule_id) LEFT JOIN shown USING (msg_id, rule_id)""")
cte("link", """SELECT msg_id, url_ord, raw, host, registrable, coalesce(labels, []) AS labels FROM url JOIN host USING (host)
    LEFT JOIN (SELECT msg_id, url_ord, list(label ORDER BY o) AS labels FROM flag GROUP BY msg_id, url_ord) USING (msg_id, url_ord)""")
cte("whole", f"""SELECT msg_id, score, raw_score, capped, n_counted, band, label, blurb, lo, hi, characters, truncated, prep.text,
    {count('body', q(f'[^{WS}]+'))} AS words, counts.headers_found, html_found, url_count, file_count, coalesce(n_findings, 0) AS n_findings
    FROM score JOIN {values(cat.BANDS)} b(id, lo, hi, label, blurb) ON score BETWEEN lo AND hi JOIN counts USING (msg_id)
    JOIN prep USING (msg_id) JOIN body USING (msg_id) LEFT JOIN (SELECT msg_id, count(*) AS n_findings FROM sign GROUP BY msg_id) USING (msg_id)""")


def listed(name, source, item, order):
    """A list of ``item`` per message, empty where it has none."""
    return f"LEFT JOIN (SELECT msg_id, list({item} ORDER BY {order}) AS {name} FROM {source} GROUP BY msg_id) USING (msg_id)"


def json_of(**fields):
    return "json_object(" + ", ".join(f"{q(k)}, {v}" for k, v in fields.items()) + ")"


SENDER = ("from_address", "from_display", "from_domain", "from_registrable", "reply_to", "reply_to_domain", "return_path", "return_path_domain",
          "subject", "date", "message_id", "message_id_domain", "received_count", "spf", "dkim", "dmarc", "authentication_results", "header_count")


def json_report(with_sender):
    own = {"sender": json_of(**{c: "message_domain" if c == "message_id_domain" else c for c in SENDER}),
           "authentication": json_of(spf="spf", dkim="dkim", dmarc="dmarc")} if with_sender else {}
    parts = {n: f"coalesce({v}, [])" for n, v in (("findings", "findings"), ("links", "links"), ("attachments", "files"), ("notes", "notes"),
                                                 ("recommendations", "steps"))}
    return json_of(
        tool=q("mailsift"), score="score", rawScore="raw_score", capped="capped", band=json_of(id="band", label="label", min="lo", max="hi"),
        detection=json_of(headersFound="headers_found", htmlFound="html_found", urlCount="url_count", fileCount="file_count", countedFindings="n_counted"),
        meta=json_of(characters="characters", words="words", truncated="truncated"), **own, **parts)


FINAL["report_json"] = f"""SELECT msg_id, band, CAST(CASE WHEN headers_found THEN {json_report(True)} ELSE {json_report(False)} END AS VARCHAR) AS report
    FROM whole LEFT JOIN sender USING (msg_id)
    {listed("findings", "sign", json_of(**{c: "rule_id" if c == "id" else c for c in ("id", "category", "severity", "points", "title", "why", "advice", "evidence")}), "rank")}
    {listed("links", "link", json_of(address="raw", host="host", registrableDomain="registrable", flags="labels"), "url_ord")}
    {listed("files", "file", "name", "file_ord")}
    {listed("notes", "note", json_of(severity="severity", title="title", text="text"), "o")}
    {listed("steps", "advice", json_of(tag="tag", text="text"), "rank")}"""
yes_no = lambda c: f"CASE WHEN {c} THEN 'yes' ELSE 'no' END"
stated = lambda c: f"coalesce(nullif({c}, ''), 'unknown')"
optional = lambda label, c: f"CASE WHEN {c} <> '' THEN '  {label}: ' || {c} END"
FINAL["report_text"] = f"""SELECT msg_id, band, array_to_string(flatten([
    ['TRIAGE OF ONE MESSAGE', 'Signs are listed here; none of them is proof.', '', 'Score ' || score || ' of 100: ' || label, '  ' || blurb,
     '  points added up: ' || raw_score || CASE WHEN capped THEN ', more than the scale holds' ELSE '' END, '', 'INPUT',
     '  length: ' || characters || ' characters', '  header block: ' || {yes_no('headers_found')}, '  HTML: ' || {yes_no('html_found')},
     '  links: ' || url_count, '  file names: ' || file_count, ''],
    CASE WHEN headers_found THEN ['SENDER', '  from: ' || CASE WHEN from_display <> '' THEN '"' || from_display || '" <' || from_address || '>' ELSE from_address END,
     {optional('replies go to', 'reply_to')}, {optional('bounces go to', 'return_path')}, {optional('subject', 'subject')},
     '  checks: SPF ' || {stated('spf')} || ', DKIM ' || {stated('dkim')} || ', DMARC ' || {stated('dmarc')}, ''] ELSE [] END,
    ['FINDINGS: ' || n_findings], CASE WHEN n_findings = 0 THEN ['  No rule fired; a quiet message can still do harm.'] ELSE [] END, coalesce(flatten(signs), []),
    CASE WHEN notes IS NULL THEN [] ELSE flatten([['REMARKS WITHOUT POINTS'], notes, ['']]) END, ['NEXT STEPS'], coalesce(steps, []),
    ['', 'Names of files were read, files were not; links were not followed.', '']]), chr(10)) AS report
    FROM whole LEFT JOIN sender USING (msg_id)
    {listed("signs", "sign", "flatten([['  ' || CASE WHEN points > 0 THEN '+' || points ELSE '0' END || ' ' || title, '      rule ' || rule_id || ', ' || severity || ', ' || category, '      reason: ' || why], list_transform(evidence, lambda e: '      seen: ' || e), ['      advice: ' || advice, '']])", "rank")}
    {listed("notes", "note", "'  * ' || title || ' / ' || text", "o")}
    {listed("steps", "advice", "'  ' || rank || ') ' || tag || ': ' || text", "rank")}"""

cte("page_link", "SELECT page_id AS msg_id, url AS raw FROM pages")
parsed("page_url", "page_link", "raw")


def _reads(sql):
    """Names of the CTEs that a piece of SQL reads."""
    return [n for n in dict.fromkeys(re.findall(r"\b(?:FROM|JOIN) (\w+)", sql)) if n in CTE]


@functools.cache
def oracle_sql():
    reads = {name: _reads(sql) for name, (_, sql) in CTE.items()}
    built = {}
    for key, final in FINAL.items():
        order = []

        def visit(name):
            if name not in order:
                for other in reads[name]:
                    visit(other)
                order.append(name)
        for name in _reads(final):
            visit(name)
        head = ",\n".join(f"{n} AS {CTE[n][0]}({CTE[n][1]})" for n in order)
        built[key] = f"WITH {head}\n{final}"
    return built
