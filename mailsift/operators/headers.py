"""Header block: lines, fields, sender, authentication and the rules over them."""

from pyspark.sql import functions as F

from mailsift.data import catalogue, lists
from mailsift.functions import domains
from mailsift.functions.columns import among, compact, let, once, text_list, trim
from mailsift.functions.regex import HEADER_LINE, NOT_AFTER_WORD, NOT_BEFORE_WORD, WS, WS_IN_LINE
from mailsift.operators.findings import finding, no_findings

# Only blank lines may stand in front of the first field.
_STARTS_WITH_FIELD = rf"\A(?:[{WS}]*\n)?[A-Za-z][A-Za-z0-9\-]{{1,40}}[{WS}]*:"
# At least all lines of the block; their kinds decide where it ends.
_FRONT = (rf"\A(?:[{WS_IN_LINE}]*+\n)*+(?:(?:[A-Za-z][A-Za-z0-9\-]{{1,40}}[{WS_IN_LINE}]*+:|[ \t])[^\n]*+(?:\n|\z))*+")
_FIELD = "struct<pos:int,key:string,value:string>"
_BLOCK = f"struct<kinds:string,leading:int,collected:int,lines:array<string>,fields:array<{_FIELD}>,body:string>"


def line_kind(line):
    """b(lank), l(eading space), f(ield) or o(ther); blank is tested first."""
    return (F.when(~line.rlike(rf"[^{WS}]"), "b").when(line.rlike(r"^[ \t]"), "l")
            .when(line.rlike(HEADER_LINE), "f").otherwise("o"))


def _unfold(lines):
    """Fields of a block whose first line is a field: folds are joined to it by one space."""
    joined = F.array_join(F.transform(lines, lambda x: F.when(
        x.rlike(r"^[ \t]"), F.concat(F.lit(" "), trim(x))).otherwise(F.concat(
            F.lit("\n"), F.lower(trim(F.substring_index(x, ":", 1))), F.lit(":"),
            trim(F.substr(x, F.locate(":", x) + 1))))), "")
    fields = F.filter(F.split(joined, "\n"), lambda x: x != "")
    return F.transform(fields, lambda x, i: let(F.substring_index(x, ":", 1), lambda key: F.struct(
        (i + 1).alias("pos"), key.alias("key"),
        F.substr(x, F.length(key) + 2).alias("value"))))


@once
def _block():
    """Read the header block; the state machine over lines is a pattern over their kinds."""
    text = F.col("text")
    front = F.regexp_extract(text, _FRONT, 0)
    n = F.length(front) - F.length(F.replace(front, F.lit("\n"))) + 2

    def parse(all_lines):
        head = F.slice(all_lines, 1, F.size(all_lines))
        kinds = F.array_join(F.transform(head, line_kind), "")
        return let(kinds, lambda k: cut(all_lines, head, k))

    def cut(all_lines, head, kinds):
        leading = F.length(F.regexp_extract(kinds, "^(b*)", 1))
        collected = F.length(F.regexp_extract(kinds, "^b*(f[fl]*)", 1))
        size = F.struct(leading.alias("leading"), collected.alias("collected"))
        return let(size, lambda s: let(
            F.slice(head, s["leading"] + 1, s["collected"]), lambda block: F.struct(
                kinds.alias("kinds"), s["leading"].alias("leading"), s["collected"].alias("collected"),
                block.alias("lines"), _unfold(block).alias("fields"),
                F.replace(F.array_join(F.slice(head, s["leading"] + s["collected"] + 1 + F.when(
                    F.substr(kinds, s["leading"] + s["collected"] + 1, F.lit(1)) == "b", 1).otherwise(0),
                    F.size(head)), "\n"), F.lit("\r\n"), F.lit("\n")).alias("body")).cast(_BLOCK)))

    # the last of the lines is all that follows the block
    return F.when(text.rlike(_STARTS_WITH_FIELD), let(F.split(text, r"\r?\n", n), parse))


def _last_values(fields):
    """Map of the fields; of equal keys the last one wins."""
    keys = F.array_distinct(F.transform(fields, lambda x: x["key"]))
    return let(keys, lambda ks: F.map_from_arrays(ks, F.transform(ks, lambda k: F.element_at(
        F.filter(fields, lambda x: x["key"] == k), -1)["value"])))


@once
def _headers():
    return let(F.coalesce(F.col("block")["fields"], F.array().cast(f"array<{_FIELD}>")), _last_values)


@once
def _is_header_block():
    strong = F.size(F.array_intersect(F.map_keys("headers"), text_list(lists.STRONG_HEADERS)))
    return F.coalesce((F.col("block")["collected"] >= 2) & (strong >= 2), F.lit(False))


def with_headers(df):
    """Adds block, headers (map), headers_found and body."""
    df = df.withColumn("block", _block()).withColumn("headers", _headers())
    df = df.withColumn("headers_found", _is_header_block())
    return df.withColumn("body", F.when(F.col("headers_found"), F.col("block")["body"]).otherwise(F.col("text")))


def header(key):
    return F.coalesce(F.try_element_at("headers", F.lit(key)), F.lit(""))


def address(value):
    """struct(address, display, domain) of a header value such as ``"Name" <a@b.c>``."""
    def parse(v):
        angle = v.rlike("<[^>]+>")
        addr = trim(F.when(angle, F.regexp_extract(v, "<([^>]+)>", 1))
                    .otherwise(F.regexp_replace(v, r"^\[|\]\z", "")))
        shown = F.when(angle, trim(F.element_at(F.split(v, "<[^>]+>", 2), 1))).otherwise(F.lit(""))
        return let(addr, lambda a: F.struct(
            a.alias("address"), trim(F.regexp_replace(shown, r"""^["']|["']\z""", "")).alias("display"),
            F.when(F.contains(a, F.lit("@")), F.lower(F.substring_index(a, "@", -1)))
            .otherwise(F.lit("")).alias("domain")))
    return let(trim(value), parse)


def auth_verdict(key):
    blob = F.array_join(F.filter(F.array(
        header("authentication-results"), header("arc-authentication-results"), header(key)),
        lambda x: x != ""), " ")
    return F.lower(F.regexp_extract(blob, rf"(?i){NOT_AFTER_WORD}{key}[{WS}]*=[{WS}]*([a-z]+)", 1))


@once
def _sender():
    sender, reply, bounce = address(header("from")), address(header("reply-to")), address(header("return-path"))
    spf_line = F.lower(F.regexp_extract(
        header("received-spf"), rf"(?i)^[{WS}]*(pass|fail|softfail|neutral|none|permerror|temperror)", 1))
    spf = let(auth_verdict("spf"), lambda v: F.when(v != "", v).otherwise(spf_line))
    message_domain = F.regexp_replace(F.lower(F.regexp_extract(
        F.concat(header("message-id"), F.lit(" ")), rf"(?i)@([a-z0-9.\-]+)[>{WS}]", 1)), r"\.\z", "")
    fields = let(F.struct(sender.alias("f"), reply.alias("r"), bounce.alias("b")), lambda a: F.struct(
        a["f"]["address"].alias("from_address"), a["f"]["display"].alias("from_display"),
        a["f"]["domain"].alias("from_domain"), domains.registrable(a["f"]["domain"]).alias("from_registrable"),
        a["r"]["address"].alias("reply_to"), a["r"]["domain"].alias("reply_to_domain"),
        a["b"]["address"].alias("return_path"), a["b"]["domain"].alias("return_path_domain"),
        header("subject").alias("subject"), header("date").alias("date"),
        header("message-id").alias("message_id"), message_domain.alias("message_id_domain"),
        F.regexp_count("text", F.lit(rf"(?i)(?:\A|\n)received[{WS_IN_LINE}]*:")).cast("bigint")
        .alias("received_count"),
        spf.alias("spf"), auth_verdict("dkim").alias("dkim"), auth_verdict("dmarc").alias("dmarc"),
        header("authentication-results").alias("authentication_results"),
        F.size(F.map_keys("headers")).cast("bigint").alias("header_count")))
    return F.when(F.col("headers_found"), fields)


def with_sender(df):
    """Adds sender: one struct per message, null without a header block."""
    return df.withColumn("sender", _sender())


def business_words(text):
    return text.rlike(rf"(?i){NOT_AFTER_WORD}(?:finance|accounts|billing|hr|payroll|support|security|invoice|bank|"
                      rf"remittance){NOT_BEFORE_WORD}")


def _rules(s):
    reg = s["from_registrable"]
    known = s["from_domain"] != ""
    differs = lambda domain: known & (domain != "") & (domains.registrable(domain) != reg)
    prefixed = lambda label, value: F.concat(F.lit(label), value)
    from_line = prefixed("From: ", s["from_address"])
    spam_flag, spam_status = header("x-spam-flag"), header("x-spam-status")
    is_spam = (spam_flag.rlike(rf"(?i)^[{WS}]*yes")
               | F.substring(spam_status, 1, 40).rlike(rf"(?i){NOT_AFTER_WORD}yes{NOT_BEFORE_WORD}"))
    looks_full = F.exists(text_list(lists.FULL_MESSAGE_HEADERS),
                          lambda k: F.coalesce(F.try_element_at("headers", k), F.lit("")) != "")

    def build(brand):
        return compact(
            F.when(differs(s["reply_to_domain"]), finding(
                "reply_to_mismatch", [from_line, prefixed("Reply-To: ", s["reply_to"])])),
            F.when(brand.isNotNull() & known & ~domains.brand_owns(brand, reg), finding(
                "display_name_spoof", [F.concat(F.lit('"'), s["from_display"], F.lit('" <'),
                                                s["from_address"], F.lit(">"))])),
            F.when(known & among(reg, lists.FREE_MAIL_DOMAINS) & (brand.isNotNull() | business_words(
                F.concat_ws(" ", s["from_display"], s["subject"]))),
                finding("free_mail_sender", [s["from_address"]])),
            F.when(differs(s["return_path_domain"]), finding(
                "return_path_mismatch", [from_line, prefixed("Return-Path: ", s["return_path"])])),
            F.when(s["spf"].isin("fail", "permerror"), finding("spf_fail", [prefixed("spf=", s["spf"])])),
            F.when(s["dkim"] == "fail", finding("dkim_fail", [F.lit("dkim=fail")])),
            F.when(s["dmarc"] == "fail", finding("dmarc_fail", [F.lit("dmarc=fail")])),
            F.when(is_spam, finding("spam_header", [F.when(
                spam_flag != "", prefixed("X-Spam-Flag: ", spam_flag)).otherwise(
                    prefixed("X-Spam-Status: ", F.substring(spam_status, 1, 60)))])),
            F.when(differs(s["message_id_domain"]), finding(
                "message_id_mismatch", [prefixed("Message-ID: ", F.substring(s["message_id"], 1, 90))])),
            F.when(looks_full & ((header("date") == "") | (header("message-id") == "")), finding(
                "missing_headers", [F.when(header("date") == "", "Date header missing")
                                    .otherwise("Message-ID header missing")])))

    return let(domains.brand_in_display(s["from_display"]), build)


@once
def _findings():
    return F.when(F.col("headers_found"), let(F.col("sender"), _rules)).otherwise(no_findings())


def with_header_findings(df):
    return df.withColumn("header_findings", _findings())


def _notes(s):
    def note(key, arg=None):
        fill = lambda text: F.lit(text) if arg is None else F.concat_ws("", *_fill(text, [arg]))
        severity, title, text = catalogue.NOTES[key]
        return F.struct(F.lit(severity).alias("severity"), fill(title).alias("title"), fill(text).alias("text"))
    no_result = ((s["spf"] == "") & (s["dkim"] == "") & (s["dmarc"] == "")
                 & (header("authentication-results") == "") & (header("dkim-signature") == ""))
    return compact(
        F.when(s["spf"] == "pass", note("spf_pass"))
        .when((s["spf"] != "") & ~s["spf"].isin("fail", "permerror"), note("spf_other", s["spf"])),
        F.when(s["dkim"] == "pass", note("dkim_pass")),
        F.when(s["dmarc"] == "pass", note("dmarc_pass")),
        F.when(no_result, note("no_auth")))


def _fill(template, args):
    """Columns of a template's literal parts and its numbered places."""
    parts = []
    for piece in template.replace("}", "{").split("{"):
        parts.append(args[int(piece)] if piece.isdigit() else F.lit(piece))
    return parts


@once
def _notes_column():
    severity, title, text = catalogue.NOTES["no_headers"]
    absent = F.array(F.struct(F.lit(severity).alias("severity"), F.lit(title).alias("title"),
                              F.lit(text).alias("text")))
    return F.when(F.col("headers_found"), let(F.col("sender"), _notes)).otherwise(absent)


def with_notes(df):
    """Adds notes: zero-point context on authentication."""
    return df.withColumn("notes", _notes_column())
