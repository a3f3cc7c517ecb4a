"""HTML source: gate, anchors, remote hosts and the rules over them. Looks at the whole text, not the body."""

from pyspark.sql import functions as F

from mailsift.data import lists
from mailsift.functions import domains
from mailsift.functions.columns import among, collapse_spaces, compact, let, once, trim
from mailsift.functions.regex import ANCHOR, HOST_IN_TEXT, HTML_TAG, NOT_BEFORE_WORD, jvm
from mailsift.operators.findings import finding, no_findings
from mailsift.operators.urls import parse

ANCHOR_TYPE = "struct<href:string,text:string,host:string,scheme:string,userinfo:string>"

_HIDDEN = jvm(r"(?:display\s*:\s*none|visibility\s*:\s*hidden|font-size\s*:\s*0(?:px|pt|em|%)?|opacity\s*:\s*0(?:\.0+)?)")
_FORM = rf"(?i)<form{NOT_BEFORE_WORD}[^>]*>"
_PASSWORD_INPUT = jvm(rf"<input{NOT_BEFORE_WORD}[^>]*type\s*=\s*[\"']?password|name\s*=\s*[\"']?(?:pass|password|pwd)[\"']?")
_ZERO_OR_ONE = rf"\s*=\s*[\"']?[01]{NOT_BEFORE_WORD}[^>]*"
_PIXEL = jvm(rf"<img{NOT_BEFORE_WORD}[^>]*width{_ZERO_OR_ONE}height{_ZERO_OR_ONE}>"
             rf"|<img{NOT_BEFORE_WORD}[^>]*height{_ZERO_OR_ONE}width{_ZERO_OR_ONE}>")
_REMOTE = jvm(r"(?:src|href|background)\s*=\s*[\"']https?://([^\"'/]+)")
_ENTITY = "(?i)&#x?[0-9a-f]{2,4};"
_PERCENT_TAG = "(?i)%3c|%3e"
_SCRIPT_LINK = jvm(r"href\s*=\s*[\"']?\s*javascript:")
_DATA_LINK = jvm(r"href\s*=\s*[\"']\s*data:")


def is_html(text):
    return F.contains(text, F.lit("<")) & (F.regexp_count(text, F.lit(HTML_TAG)) >= 3)


def strip_tags(html):
    t = F.regexp_replace(html, "<[^>]*>", " ")
    for entity, char in (("nbsp", " "), ("amp", "&"), ("lt", "<"), ("gt", ">")):
        t = F.regexp_replace(t, f"(?i)&{entity};", char)
    return collapse_spaces(t)


def domain_in_text(text):
    """First thing in a text that looks like a host, without scheme and www."""
    host = F.regexp_extract(text, HOST_IN_TEXT, 0)
    return F.lower(F.regexp_replace(F.regexp_replace(host, "(?i)^https?://", ""), r"(?i)^www\.", ""))


def anchors(html):
    def anchor(m):
        group = lambda i: F.regexp_extract(m, ANCHOR, i)
        href = trim(F.concat(group(1), group(2), group(3)))
        return let(parse(href), lambda p: F.struct(
            p["raw"], strip_tags(group(4)), p["host"], p["scheme"], p["userinfo"]).cast(ANCHOR_TYPE))
    return F.transform(F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(0)), anchor)


@once
def _structure():
    hosts = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(_REMOTE), F.lit(1)), F.lower))
    return {
        "anchors": F.when(F.col("html_found"), anchors(F.col("text")))
        .otherwise(F.array().cast(f"array<{ANCHOR_TYPE}>")),
        "remote_hosts": F.when(F.col("html_found"), hosts).otherwise(F.array().cast("array<string>"))}


def with_html(df):
    """Adds html_found, anchors and remote_hosts."""
    return df.withColumn("html_found", is_html(F.col("text"))).withColumns(_structure())


def _mismatch(a):
    """Evidence that an anchor's text and target differ, else null."""
    shown = domain_in_text(a["text"])
    names = F.struct(F.when(shown != "", domains.registrable(shown)).otherwise("").alias("shown"),
                     domains.registrable(a["host"]).alias("real"))
    quoted = F.concat(F.lit('"'), F.substring(a["text"], 1, 60), F.lit('"'))
    return F.when(a["host"] != "", let(names, lambda n: F.when(
        (n["real"] != "") & (n["shown"] != "") & (n["shown"] != n["real"]),
        F.concat(quoted, F.lit(" actually points to "), a["host"])).when(
        (n["real"] != "") & (n["shown"] == "") & among(n["real"], lists.SHORTENERS),
        F.concat(quoted, F.lit(" is a shortened link to "), a["host"]))))


@once
def _findings():
    text = F.col("text")
    hidden = F.regexp_extract_all(text, F.lit(_HIDDEN), F.lit(0))
    codes = F.struct(F.regexp_count(text, F.lit(_ENTITY)).alias("entities"),
                     F.regexp_count(text, F.lit(_PERCENT_TAG)).alias("tags"))
    mismatches = F.filter(F.transform("anchors", _mismatch), lambda m: m.isNotNull())

    def build(x):
        return compact(
            F.when(F.size(x["hidden"]) > 0, finding(
                "hidden_content", [F.array_join(F.slice(x["hidden"], 1, 3), " , ")])),
            F.when(text.rlike(_FORM) | text.rlike(_PASSWORD_INPUT), finding(
                "embedded_login_form", [F.lit("password input field found in the source")])),
            F.when(text.rlike(_PIXEL), finding("tracking_pixel", [F.lit("a 1x1 image element")])),
            F.when(F.size(x["remote"]) > 0, finding(
                "remote_resources", [F.array_join(F.slice(x["remote"], 1, 4), ", ")])),
            F.when((x["codes"]["entities"] >= 12) | (x["codes"]["tags"] >= 3), finding(
                "entity_obfuscation", [F.concat(x["codes"]["entities"].cast("string"),
                                                F.lit(" HTML entity codes and "), x["codes"]["tags"].cast("string"),
                                                F.lit(" encoded tag characters"))])),
            F.when(text.rlike(_SCRIPT_LINK), finding(
                "javascript_href", [F.lit("javascript: link found in the source")])),
            F.when(text.rlike(_DATA_LINK), finding("data_uri_link", [F.lit("data: link found in the source")])),
            F.when(F.size(x["mismatches"]) > 0, finding(
                "misleading_link_text", [F.array_join(F.slice(x["mismatches"], 1, 2), " ; ")])))

    parts = F.struct(hidden.alias("hidden"), F.col("remote_hosts").alias("remote"), codes.alias("codes"),
                     mismatches.alias("mismatches"))
    return F.when(F.col("html_found"), let(parts, build)).otherwise(no_findings())


def with_html_findings(df):
    return df.withColumn("html_findings", _findings())
