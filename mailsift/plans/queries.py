"""Named queries over a data directory; all of them read whole tables."""

import functools

from pyspark.sql import functions as F

from mailsift.data import lists
from mailsift.functions import domains
from mailsift.functions.columns import constant, runs, text_list
from mailsift.operators import attachments, findings, headers, html, messages, scoring, text_rules, urls
from mailsift.operators.rulebook import RuleBook
from mailsift.plans import corpus, dims, maintained, reports, tables
from mailsift.plans.analysis import VERDICT, analyse, verdict
from mailsift.plans.tables import each, file_table, finding_table, url_table
from mailsift.sources import files, mail
from mailsift.sources.shared import work_folder
from mailsift.streaming import jobs

QUERIES = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


def planned(build):
    """Analyse a shared plan once per session and directory; nothing is computed or stored."""
    plans = {}

    @functools.wraps(build)
    def get(spark, d, **options):
        key = (spark.sparkContext.applicationId, spark._jsparkSession.hashCode(), d, *options.values())
        if key not in plans:
            plans[key] = build(spark, d, **options)
        return plans[key]
    return get


@planned
def _prepared(spark, d):
    return messages.prepare(mail.messages(spark, d))


@planned
def _headers(spark, d):
    return headers.with_headers(_prepared(spark, d))


@planned
def _sender(spark, d):
    return headers.with_sender(_headers(spark, d))


@planned
def _urls(spark, d):
    return urls.with_urls(_headers(spark, d))


@planned
def _links(spark, d):
    return urls.with_url_flags(_urls(spark, d))


@planned
def _files(spark, d):
    return attachments.with_files(_urls(spark, d))


@planned
def _html(spark, d):
    return html.with_html(_prepared(spark, d))


@planned
def _analysed(spark, d, evidence=False):
    return analyse(mail.messages(spark, d), evidence)


def _when_found(df, column="sender"):
    """One row per message with a header block, without a filter below the extraction."""
    some = F.when(F.col("headers_found"), F.array(column)).otherwise(F.array())
    return each(df, some, "msg_id").select("msg_id", "x.*")


# ---- messages and headers -----------------------------------------------------

@query
def messages_prepare(spark, d):
    return messages.with_words(_headers(spark, d)).select("msg_id", "characters", "truncated", "is_empty", "words")


@query
def header_lines(spark, d):
    kind = F.transform(F.col("block")["lines"], lambda x, i: F.struct(
        (F.col("block")["leading"] + i + 1).cast("bigint").alias("pos"), headers.line_kind(x).alias("kind"), x.alias("line")))
    return each(_headers(spark, d), kind, "msg_id").select("msg_id", "x.*")


@query
def header_kv(spark, d):
    return each(_headers(spark, d), F.map_entries("headers"), "msg_id").select("msg_id", "x.key", "x.value")


@query
def header_gate(spark, d):
    strong = F.array_intersect(F.map_keys("headers"), text_list(lists.STRONG_HEADERS))
    return _headers(spark, d).select(
        "msg_id", F.coalesce(F.col("block")["collected"], F.lit(0)).cast("bigint").alias("n_lines"),
        F.size(strong).cast("bigint").alias("n_strong"), "headers_found",
        F.length("body").cast("bigint").alias("body_length"), F.md5("body").alias("body_md5"))


@query
def address_parse(spark, d):
    return _when_found(_sender(spark, d)).select(
        "msg_id", "from_address", "from_display", "from_domain", "from_registrable",
        "reply_to", "reply_to_domain", "return_path", "return_path_domain")


@query
def auth_verdict(spark, d):
    return _when_found(_sender(spark, d)).select("msg_id", "spf", "dkim", "dmarc")


@query
def sender_summary(spark, d):
    return _when_found(_sender(spark, d)).select(
        "msg_id", "from_address", "from_display", "from_domain", "from_registrable", "reply_to", "reply_to_domain",
        "return_path", "subject", "date", "message_id", "received_count", "spf", "dkim", "dmarc",
        "authentication_results", "header_count")


@query
def auth_notes(spark, d):
    return each(headers.with_notes(_sender(spark, d)), "notes", "msg_id").select("msg_id", "ord", "x.*")


# ---- links, files, HTML ---------------------------------------------------------

def _url_rows(spark, d, bare):
    kept = each(_urls(spark, d), "urls", "msg_id").select("msg_id", F.col("ord").alias("url_ord"), "x.*")
    return kept.filter(F.col("bare") == bare)


@query
def url_extract(spark, d):
    return _url_rows(spark, d, False).select(
        "msg_id", "url_ord", "raw", "normalized", "scheme", "host", "port", "userinfo", "tail",
        F.col("start").cast("bigint").alias("start_pos"), F.col("end").cast("bigint").alias("end_pos"), "defanged")


@query
def bare_host_extract(spark, d):
    return _url_rows(spark, d, True).select(
        "msg_id", "url_ord", "raw", "host", F.col("start").cast("bigint").alias("start_pos"),
        F.col("end").cast("bigint").alias("end_pos"))


@query
def url_parse(spark, d):
    return mail.page_links(spark, d).select("msg_id", urls.parse(F.col("raw")).alias("u")).select(
        "msg_id", "u.scheme", "u.host", "u.port", "u.userinfo", "u.tail",
        domains.registrable(F.col("u.host")).alias("registrable"), domains.last_label(F.col("u.host")).alias("tld"))


@query
def file_extract(spark, d):
    return file_table(_files(spark, d))


@query
def html_gate(spark, d):
    return _html(spark, d).select("msg_id", "html_found")


@query
def anchor_extract(spark, d):
    return each(_html(spark, d), "anchors", "msg_id", ord_name="anchor_ord").select("msg_id", "anchor_ord", "x.*")


@query
def remote_hosts(spark, d):
    return each(_html(spark, d), "remote_hosts", "msg_id").select("msg_id", "ord", F.col("x").alias("host"))


@query
def content_profile(spark, d):
    """What the sources contain before scoring; file names inside links count here."""
    df = html.with_html(_urls(spark, d))
    files = F.size(F.array_distinct(F.transform(attachments.mentions(F.col("body")), lambda f: f["name"])))
    return df.groupBy("source").agg(
        F.count("*").alias("messages"), F.count_if("headers_found").alias("with_headers"),
        F.count_if("html_found").alias("with_html"), F.sum(F.size("urls")).cast("bigint").alias("links"),
        F.sum(files).cast("bigint").alias("files"))


@query
def first_seen_dedupe(spark, d):
    """Of equal file names the first place counts."""
    seen = runs(F.col("found"), lambda f: f["name"], lambda f: f["start"])
    df = _headers(spark, d).withColumn("found", attachments.mentions(F.col("body")))
    return each(df, seen, "msg_id").select("msg_id", "ord", F.col("x.key").alias("name"), F.col("x.at").cast("bigint").alias("first_pos"),
                                           F.col("x.n").cast("bigint").alias("mentions"))


@query
def span_containment(spark, d):
    """File names that a link contains and that are therefore no files."""
    spans = F.transform("urls", lambda u: F.struct(u["start"].alias("start"), u["end"].alias("end")))
    df = _urls(spark, d).withColumn("found", attachments.mentions(F.col("body"))).withColumn("spans", spans)
    return each(df, attachments.inside(F.col("found"), F.col("spans")), "msg_id").select("msg_id", "x.name", F.col("x.start").cast("bigint").alias("start_pos"),
                                             F.col("x.end").cast("bigint").alias("end_pos"))


@query
def ext_group_join(spark, d):
    return (file_table(_files(spark, d)).join(F.broadcast(dims.extension(spark)), "ext")
            .select("msg_id", "name", "ext", "grp"))


# ---- rules ---------------------------------------------------------------------

def _rule_rows(df, column, *columns):
    return findings.rows(df, column, "msg_id").select("msg_id", "rule_id", *columns)




@query
def text_rules_(spark, d):
    df = text_rules.with_text_findings(text_rules.with_text_hits(_headers(spark, d)), evidence=False)
    return _rule_rows(df, "text_findings")


@query
def text_evidence(spark, d):
    df = text_rules.with_text_hits(_headers(spark, d)).withColumn("shown", text_rules.highlights_column())
    return each(df, "shown", "msg_id").select("msg_id", "x.rule_id", F.col("x.ord").cast("bigint").alias("ord"), "x.snippet",
                                              "x.match", F.col("x.match_at").cast("bigint").alias("match_at"))


@query
def url_flags(spark, d):
    flags = F.transform("links", lambda u: u["flags"])
    per_link = each(_links(spark, d), flags, "msg_id", ord_name="url_ord")
    return each(per_link, "x", "msg_id", "url_ord", ord_name="flag_ord").select(
        "msg_id", "url_ord", "flag_ord", F.col("x.id").alias("flag_id"), "x.tone", "x.label", "x.note")


@query
def url_rules(spark, d):
    return findings.rows(urls.with_url_findings(_links(spark, d)), "url_findings", "msg_id").select(
        "msg_id", "rule_id", "seq", F.array_join("evidence", " | ").alias("evidence"), "extra")


@query
def attachment_rules(spark, d):
    return findings.rows(attachments.with_attachment_findings(_files(spark, d)), "attachment_findings", "msg_id").select(
        "msg_id", "rule_id", "seq", F.array_join("evidence", " | ").alias("evidence"))


def _register(name, part, rule_ids):
    """A query for some rules of one part."""
    def build(spark, d):
        if part == "html":
            df, column = html.with_html_findings(_html(spark, d)), "html_findings"
        else:
            df, column = headers.with_header_findings(_sender(spark, d)), "header_findings"
        wanted = F.filter(column, lambda f: f["rule_id"].isin(rule_ids))
        return each(df, wanted, "msg_id").select(
            "msg_id", F.col("x.rule_id").alias("rule_id"), F.array_join("x.evidence", " | ").alias("evidence"))
    build.__name__ = name
    query(build)


PART_RULES = {
    "html_hidden": ("html", ["hidden_content"]), "html_form": ("html", ["embedded_login_form"]),
    "html_pixel": ("html", ["tracking_pixel"]), "html_obfuscation": ("html", ["entity_obfuscation"]),
    "html_script_links": ("html", ["javascript_href", "data_uri_link"]),
    "html_link_mismatch": ("html", ["misleading_link_text"]), "html_remote": ("html", ["remote_resources"]),
    "reply_to_rule": ("header", ["reply_to_mismatch"]), "return_path_rule": ("header", ["return_path_mismatch"]),
    "display_name_spoof": ("header", ["display_name_spoof"]), "free_mail_rule": ("header", ["free_mail_sender"]),
    "auth_fail_rules": ("header", ["spf_fail", "dkim_fail", "dmarc_fail"]),
    "spam_header_rule": ("header", ["spam_header"]), "message_id_rule": ("header", ["message_id_mismatch"]),
    "missing_headers_rule": ("header", ["missing_headers"]),
}
for _name, (_part, _ids) in PART_RULES.items():
    _register(_name, _part, _ids)


# ---- hosts ----------------------------------------------------------------------

@query
def host_profile(spark, d):
    return tables.host_profile(_urls(spark, d))


@query
def shortener_join(spark, d):
    short = dims.lookup(spark).filter("list = 'shortener'").select(F.col("entry").alias("registrable"))
    return (url_table(_links(spark, d)).join(F.broadcast(short), "registrable")
            .select("msg_id", "url_ord", "host", "registrable"))


@query
def risky_tld_join(spark, d):
    risky = dims.lookup(spark).filter("list = 'risky_tld'").select(F.col("entry").alias("tld"))
    links = url_table(_links(spark, d)).withColumn("tld", domains.last_label(F.col("host")))
    return links.join(F.broadcast(risky), "tld", "left_semi").select("msg_id", "url_ord", "host", "tld")


@query
def brand_lookalike(spark, d):
    return (tables.host_profile(_urls(spark, d)).filter("brand <> '' and not is_official")
            .select("host", "registrable", "brand", "messages"))


@query
def typosquat(spark, d):
    return (tables.host_profile(_urls(spark, d)).filter("typo_brand <> ''")
            .select("host", "typo_brand", "typo_domain", "typo_distance", "messages"))


@query
def homoglyph_subdomain_port_flags(spark, d):
    ids = ["ip_address_url", "homoglyph_domain", "many_subdomains", "at_sign_in_url", "no_https",
           "nonstandard_port", "encoded_url_chars"]
    shown = F.transform("flags", lambda f: f["id"])
    return url_table(_links(spark, d)).select(
        "msg_id", "url_ord", "host", *[F.array_contains(shown, F.lit(i)).alias(i) for i in ids])


@query
def distinct_hosts(spark, d):
    return each(scoring.with_hosts(_urls(spark, d)), "hosts", "msg_id").select("msg_id", "ord", F.col("x").alias("host"))


# ---- findings, score, advice --------------------------------------------------------

@query
def finding_enrich(spark, d):
    return finding_table(_analysed(spark, d), dims.rule(spark)).select(
        "msg_id", "seq", "rule_id", "source", "category", "severity", F.col("points").cast("bigint").alias("points"), "title")


@query
def findings_union(spark, d):
    return finding_table(_analysed(spark, d, evidence=True), dims.rule(spark)).select(
        "msg_id", "rule_id", "source", "category", "severity", F.col("points").cast("bigint").alias("points"), "seq", "evidence")


@query
def combination_rules(spark, d):
    added = F.slice("findings", F.size("base_findings") + 1, 5)
    return each(_analysed(spark, d), added, "msg_id").select(
        "msg_id", F.col("x.rule_id").alias("rule_id"), F.array_join("x.evidence", " | ").alias("evidence"))


@query
def score(spark, d):
    return _analysed(spark, d).select("msg_id", "raw_score", "score", "capped")


@query
def band_lookup(spark, d):
    return _analysed(spark, d).select("msg_id", "score", "band", reports.label_of(F.col("band")).alias("label"))


@query
def severity_stats(spark, d):
    return _analysed(spark, d).select("msg_id", *[c for c in VERDICT if c.startswith("n_")])


@query
def category_subtotals(spark, d):
    """Per message and category: entries and points. Summed inside the row, so no shuffle by message."""
    of = constant("map({})".format(", ".join(f"'{r.rule_id}', '{r.category}'" for r in dims.catalogue.ALL_RULES)))
    order = constant("map({})".format(", ".join(f"'{c}', {i}" for i, c in enumerate(lists.CATEGORY_ORDER, 1))))
    tagged = F.transform("findings", lambda f: F.struct(
        F.element_at(of, f["rule_id"]).alias("category"), f["points"].alias("points")))
    df = _analysed(spark, d).withColumn("tagged", tagged)
    per = F.transform(F.array_distinct(F.transform("tagged", lambda t: t["category"])), lambda c: F.struct(
        c.alias("category"), F.element_at(order, c).cast("bigint").alias("category_ord"),
        F.size(F.filter("tagged", lambda t: t["category"] == c)).cast("bigint").alias("items"),
        F.aggregate(F.filter("tagged", lambda t: t["category"] == c), F.lit(0).cast("bigint"),
                    lambda acc, t: acc + t["points"]).alias("points")))
    return each(df, per, "msg_id").select("msg_id", "x.*")


@query
def detection_counts(spark, d):
    return verdict(_analysed(spark, d)).select("msg_id", "url_count", "file_count", "headers_found", "html_found", "n_counted")


@query
def score_breakdown(spark, d):
    return reports.score_breakdown(_analysed(spark, d))


@query
def finding_order(spark, d):
    return tables.ordered_findings(_analysed(spark, d))


@query
def recommendations(spark, d):
    return tables.recommendation_table(_analysed(spark, d))


@query
def top_evidence(spark, d):
    found = findings.rows(_analysed(spark, d, evidence=True), "findings", "msg_id")
    return each(found, "evidence", "msg_id", "rule_id").select("msg_id", "rule_id", "ord", F.col("x").alias("evidence"))


@query
def verdicts(spark, d):
    return verdict(_analysed(spark, d))


@query
def report_fields(spark, d):
    return reports.report_fields(reports.report_json(_analysed(spark, d, evidence=True)))


@query
def report_export(spark, d):
    """Reports written by band, and those of the high band read back."""
    folder = work_folder(spark)
    files.write_reports(reports.report_json(_analysed(spark, d, evidence=True)), folder)
    return reports.report_fields(files.read_reports(spark, folder).filter("band = 'high'"))


@query
def report_json(spark, d):
    return reports.report_json(_analysed(spark, d, evidence=True))


@query
def report_text(spark, d):
    return reports.report_text(_analysed(spark, d, evidence=True))


# Rows that a user adds to the tables of rules: one rule over the text, one combination, one rule with other points.
ADDED_RULES = [
    (70, "note_reference", "body", "Money and payments", "medium", 7, "Names a numbered note",
     "Notes with numbers were used by one campaign.", "Ask the sender what the note is about."),
    (71, "combo_note_link", "combination", "Combination of findings", "high", 5, "Numbered note and a plain link",
     "Both together make up the campaign.", "Do not open the link."),
    (8, "urgency_pressure", "body", "Pressure tactics", "medium", 3, "Urgency and pressure language",
     "Deadlines are used to stop a reader from checking; honest reminders use them too.", "Take your time."),
]
ADDED_PATTERNS = [("note_reference", 1, r"\bnote\s+\d{2,}\b"), ("note_reference", 2, r"\bRef \d+[^.!?\n]{0,20}\bexample\b")]
ADDED_COMBOS = [("combo_note_link", 1, 1, "note_reference"), ("combo_note_link", 2, 1, "no_https"),
                ("combo_note_link", 2, 2, "reply_to_mismatch"), ("combo_note_link", 2, 3, "risky_tld")]


@query
def custom_rules(spark, d):
    """Verdicts by the built-in tables with rows added, and one rule replaced."""
    rows = lambda values, table: spark.createDataFrame(values, table.schema)
    rule, pattern, combo = dims.rule_table(spark), dims.rule_pattern(spark), dims.rule_combo(spark)
    added = rows(ADDED_RULES, rule)
    book = RuleBook.from_tables(rule.join(added, "rule_id", "left_anti").unionByName(added),
                                pattern.union(rows(ADDED_PATTERNS, pattern)), combo.union(rows(ADDED_COMBOS, combo)))
    new = F.array_sort(F.filter(F.transform("findings", lambda f: f["rule_id"]),
                                lambda i: i.isin("note_reference", "combo_note_link")))
    return analyse(mail.messages(spark, d), evidence=False, rules=book).select(
        "msg_id", "raw_score", "score", "band", F.size("findings").cast("bigint").alias("n_findings"),
        F.array_join(new, ",").alias("added"))


# ---- dimensions met with the data -----------------------------------------------------

@query
def rule_registry(spark, d):
    return corpus.rule_prevalence(spark, _analysed(spark, d)).select(
        "registry_rank", "rule_id", "registry_source", "title", "severity", "points", "messages")


@query
def lookup_dims(spark, d):
    """Entries of all lookup lists, with the messages that meet them for the lists of names and suffixes."""
    df = _links(spark, d)
    df = headers.with_sender(df)
    pair = lambda name, x: F.struct(F.lit(name).alias("list"), x.alias("entry"))
    met = F.array_distinct(F.concat(
        F.flatten(F.transform("links", lambda u: F.array(
            pair("multi_part_suffix", F.substring_index(u["registrable"], ".", -2)),
            pair("risky_tld", domains.last_label(u["host"])), pair("shortener", u["registrable"])))),
        F.when(F.col("headers_found"), F.array(pair("free_mail", F.col("sender")["from_registrable"])))
        .otherwise(F.array().cast("array<struct<list:string,entry:string>>"))))
    counts = each(df, met, "msg_id").groupBy("x.list", "x.entry").agg(F.count("*").alias("messages"))
    return dims.lookup(spark).join(counts, ["list", "entry"], "left").select(
        "list", "entry", F.coalesce("messages", F.lit(0).cast("bigint")).alias("messages"))


@query
def tld_union(spark, d):
    named = each(_urls(spark, d), F.transform("urls", lambda u: domains.last_label(u["host"])), "msg_id")
    counts = named.groupBy(F.col("x").alias("tld")).agg(F.count("*").alias("links"))
    return dims.tld(spark).join(counts, "tld", "left").select(
        "tld", F.col("tld").isin(lists.RISKY_TLDS).alias("is_risky"),
        F.coalesce("links", F.lit(0).cast("bigint")).alias("links"))


@query
def ext_union(spark, d):
    counts = file_table(_files(spark, d)).groupBy("ext").agg(F.count("*").alias("files"))
    return dims.extension(spark).join(counts, "ext", "left").select(
        "ext", "grp", F.coalesce("files", F.lit(0).cast("bigint")).alias("files"))


# ---- corpus and streams --------------------------------------------------------------------

@query
def rule_coverage(spark, d):
    return corpus.rule_coverage(spark, _analysed(spark, d))


@query
def band_distribution(spark, d):
    return corpus.band_distribution(spark, _analysed(spark, d))


@query
def rule_prevalence(spark, d):
    return corpus.rule_prevalence(spark, _analysed(spark, d)).select("rule_id", "messages", "points_given")


@query
def rule_cooccurrence(spark, d):
    return corpus.rule_cooccurrence(_analysed(spark, d))


@query
def domain_leaderboard(spark, d):
    return corpus.domain_leaderboard(_links(spark, d))


@query
def maintained_reports(spark, d):
    """Five reports from stored totals of four parts; one part is stored twice, the first time with other rows."""
    folder, corpus_ = work_folder(spark), mail.messages(spark, d)
    part = lambda name: analyse(corpus_.filter(F.col("source") == name), evidence=False)
    maintained.store(part("pages"), folder, "conversations")
    for name in ("orders", "documents", "pages", "conversations"):
        maintained.store(part(name), folder, name)
    return maintained.all_reports(spark, folder)


@query
def sender_profile(spark, d):
    return corpus.sender_profile(_analysed(spark, d))


@query
def duplicate_collapse(spark, d):
    return corpus.duplicate_collapse(mail.messages(spark, d), lambda texts: analyse(texts, evidence=False)).select(
        "msg_id", "first_id", "copies", "score", "band")


@query
def golden_check(spark, d):
    analysed = analyse(mail.golden_mails(spark, d), evidence=False)
    checked = corpus.golden_check(spark, analysed, mail.golden_expectation(spark, d))
    return checked.select("msg_id", "golden", "expected_band", "band", "raw_score",
                          F.col("expected_raw").cast("bigint").alias("expected_raw"), "failed")


def _mail_verdicts(messages_):
    analysed = analyse(messages_, evidence=False)
    return analysed.select("msg_id", "ts", "raw_score", "score", "band", F.coalesce(
        F.col("sender")["from_registrable"], F.lit("")).alias("sender_domain"))


@query
def stream_score(spark, d):
    return jobs.append_available(_mail_verdicts(mail.mails_of(jobs.order_stream(spark, d)))).select(
        "msg_id", "raw_score", "score", "band")


@query
def stream_band_window(spark, d):
    return jobs.update_available(jobs.band_window(_mail_verdicts(mail.mails_of(jobs.order_stream(spark, d)))),
                                 ["window_start", "band"])


@query
def stream_dedupe(spark, d):
    sighted = jobs.update_available(jobs.sightings(mail.mails_of(jobs.order_stream(spark, d))), ["text_hash", "bucket"])
    return jobs.fresh(sighted).select("text_hash")


@query
def sender_burst(spark, d):
    return jobs.update_available(jobs.sender_burst(_mail_verdicts(mail.mails_of(jobs.order_stream(spark, d)))),
                                 ["window_start", "sender_domain"])


@query
def stream_session(spark, d):
    return jobs.append_available(jobs.sender_session(_mail_verdicts(mail.mails_of(jobs.order_stream(spark, d)))))


@query
def stream_domain_leaderboard(spark, d):
    """Domains by messages over the stream; a message counts once for each domain that it names."""
    df = urls.with_urls(headers.with_headers(messages.prepare(mail.mails_of(jobs.order_stream(spark, d)))))
    named = each(df, F.array_distinct(F.transform("urls", lambda u: domains.registrable(u["host"]))), "ts")
    sketches = jobs.update_available(jobs.domain_sketch(named.select("ts", F.col("x").alias("domain"))), ["window_start"])
    return jobs.top_domains(sketches)


@query
def sender_session(spark, d):
    return corpus.sender_sessions(_mail_verdicts(mail.mails(spark, d)), gap_minutes=7 * 24 * 60).select(
        "sender_domain", "session_start", "session_end", "mails", "high")


QUERIES["text_rules"] = QUERIES.pop("text_rules_")
QUERIES["verdict"] = QUERIES.pop("verdicts")
