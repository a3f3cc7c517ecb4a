"""Links: extraction with positions, parsing, flags and the rules over them.

All of it happens inside the row of the message. Nothing is exploded and no
shuffle is needed, so neither a message with thousands of links nor a host that
a third of all messages name can make one task larger than its own input.
"""

from pyspark.sql import functions as F

from mailsift.data import catalogue, lists
from mailsift.functions import domains
from mailsift.functions.columns import among, compact, first_of_each, gaps, is_first, let, offsets, once, text_list, where
from mailsift.functions.regex import BARE_HOST, NOT_BEFORE_WORD, SCHEME_URL, jvm
from mailsift.operators.findings import finding, no_findings
from mailsift.operators.headers import _fill

_PARSED = ("raw:string,normalized:string,scheme:string,host:string,port:string,userinfo:string,tail:string")
URL = f"struct<{_PARSED},start:int,end:int,defanged:boolean,bare:boolean>"
FLAG = "struct<id:string,tone:string,label:string,note:string>"
DETAIL = f"struct<{_PARSED},start:int,end:int,defanged:boolean,bare:boolean,registrable:string,flags:array<{FLAG}>>"

_DOT = jvm(r"\[\s*\.\s*\]|\(\s*\.\s*\)|\{\s*\.\s*\}|\[dot\]|\(dot\)")
_AT = jvm(r"\[\s*@\s*\]|\(\s*@\s*\)|\[at\]")
# Most prose has no dot in front of a suffix; this test is far cheaper than the host pattern.
_SUFFIX_SEEN = rf"(?i)\.(?:{'|'.join(lists.all_tlds())}){NOT_BEFORE_WORD}"


def normalize_defanged(text):
    """hxxps://a[.]b -> https://a.b; also lower-cases the scheme."""
    t = F.regexp_replace(text, "(?i)h(?:xx|tt)ps://", "https://")
    t = F.regexp_replace(t, "(?i)h(?:xx|tt)p://", "http://")
    return F.regexp_replace(F.regexp_replace(t, _DOT, "."), _AT, "@")


def parse(candidate):
    """Parts of a link. All text before the first at sign is user information, wherever it stands."""
    def split_rest(n):
        rest = F.regexp_replace(n, "(?i)^[a-z]+://", "")
        has_at = F.contains(rest, F.lit("@"))
        return let(F.struct(
            F.lower(F.regexp_extract(n, "(?i)^([a-z]+)://", 1)).alias("scheme"),
            F.when(has_at, F.substring_index(rest, "@", 1)).otherwise("").alias("userinfo"),
            F.when(has_at, F.substr(rest, F.locate("@", rest) + 1)).otherwise(rest).alias("place")),
            lambda p: finish(n, p))

    def finish(n, p):
        authority = F.regexp_extract(p["place"], "^[^/?#]*", 0)
        return let(authority, lambda a: F.struct(
            candidate.alias("raw"), n.alias("normalized"),
            F.when(p["scheme"] == "", "http").otherwise(p["scheme"]).alias("scheme"),
            F.regexp_replace(F.lower(F.regexp_replace(a, r":\d{1,5}\z", "")), r"\.\z", "").alias("host"),
            F.regexp_extract(a, r":(\d{1,5})\z", 1).alias("port"), p["userinfo"].alias("userinfo"),
            F.substr(p["place"], F.length(a) + 1).alias("tail")))

    return let(normalize_defanged(candidate), split_rest)


def _scheme_links(body):
    """struct(gaps, hits, links): texts around links, links as found, links parsed (null = no link)."""
    def build(s):
        return let(offsets(s["gaps"], s["hits"]), lambda starts: F.struct(
            s["gaps"].alias("gaps"), s["hits"].alias("hits"),
            F.transform(F.arrays_zip(s["hits"].alias("hit"), starts.alias("start")), link).alias("links")))

    def link(z):
        raw = F.regexp_replace(z["hit"], r"""[.,;:!?'")\]}>]+\z""", "")
        return let(parse(raw), lambda p: F.when((p["raw"] != "") & (p["host"] != ""), F.struct(
            p["raw"], p["normalized"], p["scheme"], p["host"], p["port"], p["userinfo"], p["tail"],
            z["start"].alias("start"), (z["start"] + F.length(p["raw"])).alias("end"),
            (p["normalized"] != p["raw"]).alias("defanged"), F.lit(False).alias("bare"))).cast(URL))

    found = F.struct(gaps(body, SCHEME_URL).alias("gaps"),
                     F.regexp_extract_all(body, F.lit(SCHEME_URL), F.lit(0)).alias("hits"))
    return F.when(F.contains(body, F.lit("//")), let(found, build))


def _bare_links(body, kept):
    """Hosts written without a scheme, looked for where no kept link stands; they may repeat links or each other.

    A host can neither begin before a link and end in it nor the other way
    round, so blanking the kept links is the same as testing every host against
    every link's span. ``kept`` has the texts around links and the blanks.
    """
    masked = F.when(kept.isNotNull(), F.array_join(kept, "")).otherwise(body)

    def build(s):
        return let(offsets(s["gaps"], s["hits"]), lambda starts: F.filter(
            F.transform(F.arrays_zip(s["hits"].alias("hit"), starts.alias("start")), link),
            lambda x: x.isNotNull()))

    def link(z):
        host = F.lower(z["hit"])
        blank = F.lit("")
        return F.when(~z["hit"].rlike("^[@/]"), F.struct(
            z["hit"], F.concat(F.lit("http://"), host), F.lit("(none)"), host, blank, blank, blank,
            z["start"], z["start"] + F.length(z["hit"]), F.lit(False), F.lit(True)).cast(URL))

    def search(text):
        return let(F.struct(gaps(text, BARE_HOST).alias("gaps"),
                            F.regexp_extract_all(text, F.lit(BARE_HOST), F.lit(0)).alias("hits")), build)

    hosts = let(masked, lambda m: F.when(m.rlike(_SUFFIX_SEEN), search(m)))
    return F.coalesce(hosts, F.array().cast(f"array<{URL}>"))


@once
def _urls():
    """Distinct links of the body: those with a scheme first, then bare hosts, each in text order."""
    body, no_urls = F.col("body"), F.array().cast(f"array<{URL}>")

    key = lambda u: F.lower(u["normalized"])

    def combine(s):
        links = F.coalesce(s["links"], no_urls)
        return let(is_first(links, key), lambda first: first_of_each(F.concat(
            where(links, first), _bare_links(body, pieces(s, first))), key))

    def pieces(s, first):
        """Texts around links, with kept links blanked and dropped ones left as they are."""
        return F.flatten(F.transform(
            F.arrays_zip(s["gaps"].alias("gap"), s["hits"].alias("hit"), first.alias("first")),
            lambda z: F.array(z["gap"], F.coalesce(F.when(
                z["first"], F.repeat(F.lit(" "), F.length(z["hit"]))).otherwise(z["hit"]), F.lit("")))))

    return let(_scheme_links(body), combine)


def with_urls(df):
    """Adds urls."""
    return df.withColumn("urls", _urls())


def _flags(u, reg):
    host = u["host"]

    def flag(flag_id, *args):
        tone, label, note = catalogue.LINK_FLAGS[flag_id]
        text = lambda t: F.concat(*_fill(t, args)) if args else F.lit(t)
        return F.struct(F.lit(flag_id).alias("id"), F.lit(tone).alias("tone"),
                        text(label).alias("label"), text(note).alias("note"))

    def build(x):
        brand, typo, suffix = x["brand"], x["typo"], domains.last_label(host)
        return compact(
            F.when(domains.is_ip(host), flag("ip_address_url")),
            F.when(among(reg, lists.SHORTENERS), flag("shortened_url")),
            F.when(among(suffix, lists.RISKY_TLDS), flag("risky_tld", suffix)),
            F.when(brand.isNotNull() & ~domains.brand_owns(brand, reg), flag(
                "brand_lookalike_domain", domains.brand_name(brand), domains.brand_domain_list(brand))),
            F.when(typo.isNotNull(), flag(
                "typosquat_domain", typo["brand"], typo["domain"], typo["distance"].cast("string"))),
            F.when(domains.has_lookalike_characters(host), flag("homoglyph_domain")),
            F.when(F.size(F.split(host, r"\.")) >= 4, flag("many_subdomains")),
            F.when(u["userinfo"] != "", flag("at_sign_in_url")),
            F.when(u["scheme"] == "http", flag("no_https")),
            F.when((u["port"] != "") & ~u["port"].isin("80", "443"), flag("nonstandard_port", u["port"])),
            F.when(F.regexp_count(u["normalized"], F.lit("(?i)%[0-9a-f]{2}")) >= 3, flag("encoded_url_chars")),
            F.when(u["defanged"], flag("defanged_link")),
            F.when(u["bare"], flag("bare_domain")))

    return let(F.struct(domains.brand_in_host(host).alias("brand"), domains.typosquat(host, reg).alias("typo")), build)


@once
def _links():
    detail = lambda u: let(domains.registrable(u["host"]), lambda reg: F.struct(
        *[u[f].alias(f) for f in ("raw", "normalized", "scheme", "host", "port", "userinfo", "tail",
                                  "start", "end", "defanged", "bare")],
        reg.alias("registrable"), _flags(u, reg).alias("flags")).cast(DETAIL))
    return F.transform("urls", detail)


def with_url_flags(df):
    """Adds links: the urls with registrable domain and flags."""
    return df.withColumn("links", _links())


@once
def _findings():
    scored = text_list([r.rule_id for r in catalogue.LINK_RULES])

    def build(links):
        shown = F.array_intersect(F.flatten(F.transform(links, lambda d: F.transform(d["flags"], lambda f: f["id"]))),
                                  scored)
        return F.transform(shown, lambda rule: let(F.filter(
            F.transform(links, lambda d: F.struct(d["raw"].alias("raw"), F.get(F.filter(
                d["flags"], lambda f: f["id"] == rule), F.lit(0))["note"].alias("note"))),
            lambda h: h["note"].isNotNull()), lambda hits: finding(
                rule, F.slice(F.transform(hits, lambda h: h["raw"]), 1, 4),
                F.array_join(F.slice(F.array_distinct(F.transform(hits, lambda h: h["note"])), 1, 2), " "))))

    return F.when(F.size("urls") > 0, let(F.col("links"), build)).otherwise(no_findings())


def with_url_findings(df):
    """Adds url_findings: one per rule, in order of the first link that shows it."""
    return df.withColumn("url_findings", _findings())
