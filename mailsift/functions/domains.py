"""Host and domain expressions."""

from pyspark.sql import functions as F

from mailsift.data import lists
from mailsift.functions.columns import among, constant, let, sql_text, text_list, trim

_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d{1,2})"


def registrable(host):
    """The part of a host that somebody registered: login.shop.co.uk -> shop.co.uk."""
    h = trim(F.regexp_replace(F.lower(host), r"\.\z", ""))
    return let(h, lambda x: F.when(among(F.substring_index(x, ".", -2), lists.MULTI_PART_SUFFIXES),
                                   F.substring_index(x, ".", -3))
               .otherwise(F.substring_index(x, ".", -2)))


def core_of(domain):
    """A registrable domain without its suffix; a bare two-part suffix stays whole."""
    return F.when(among(domain, lists.MULTI_PART_SUFFIXES), domain).otherwise(F.substring_index(domain, ".", 1))


def last_label(host):
    return F.substring_index(F.lower(host), ".", -1)


def is_ip(host):
    h = F.regexp_replace(host, r"^\[|\]\z", "")
    return h.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}\z") | h.rlike(r"(?i)^(?=.*:)[0-9a-f:.]+\z")


def has_lookalike_characters(host):
    return host.rlike(r"[^\x00-\x7F]") | F.contains(host, F.lit("xn--"))


def label_tokens(host):
    """Distinct labels of a host, each followed by its hyphen or underscore parts."""
    labels = F.filter(F.split(F.lower(host), r"\."), lambda x: x != "")
    return F.array_distinct(F.flatten(F.transform(
        labels, lambda x: F.concat(F.array(x), F.filter(F.split(x, "[-_]+"), lambda p: p != "")))))


# ---- brands -----------------------------------------------------------------

def python_core(domain):
    """``core_of(registrable(domain))`` for the listed brand domains."""
    labels = domain.split(".")
    two = ".".join(labels[-2:])
    if len(labels) <= 2:
        return domain if two in lists.MULTI_PART_SUFFIXES else labels[0]
    return labels[-3] if two in lists.MULTI_PART_SUFFIXES else labels[-2]


def official_domains():
    return sorted({d for _, _, domains in lists.BRANDS for d in domains})


def typosquat_targets():
    """(brand, domain, core) in list order. A core listed twice can only hit at its first place."""
    seen = {}
    for name, _, domains in lists.BRANDS:
        for d in domains:
            core = python_core(d)
            if len(core) >= 5 and core not in seen:
                seen[core] = (name, d, core)
    return list(seen.values())


def _one_of(words):
    """Pattern that finds one of the words, by common beginnings; a dot may be a hyphen or underscore."""
    if "" in words:
        return ""
    by_first = {}
    for w in sorted(words):
        by_first.setdefault(w[0], []).append(w[1:])
    shown = lambda c: "[-_.]" if c == "." else c if c.isalnum() else f"\\{c}"
    return f"(?:{'|'.join(shown(c) + _one_of(rest) for c, rest in by_first.items())})"


def _brand_seen(text, usable):
    """Whether a text has a token of any brand; tokens are few, so most texts are told at once."""
    return text.rlike(_one_of([t for _, tokens, _ in lists.BRANDS for t in tokens if usable(t)]))


def _brand_tokens(usable, needle):
    rows = [f"named_struct('brand', {n}, 'whole', {str(len(t) < 5).lower()}, 'needle', {sql_text(needle(t))})"
            for n, (_, tokens, _) in enumerate(lists.BRANDS, 1) for t in tokens if usable(t)]
    return constant(f"array({', '.join(rows)})")


def brand_in_host(host):
    """Position of the first brand with a token in the host, else null.

    A short token must be a whole label or part, a longer one may sit anywhere.
    """
    tokens = _brand_tokens(lambda t: True, lambda t: f".{t}." if len(t) < 5 else t)
    parts = F.concat(F.lit("."), F.translate(host, "-_", ".."), F.lit("."))
    return F.when(_brand_seen(host, lambda t: True), let(parts, lambda p: F.get(F.filter(tokens, lambda t: F.contains(
        F.when(t["whole"], p).otherwise(host), t["needle"])), F.lit(0))["brand"]))


def brand_in_display(display):
    """Position of the first brand with a token of four or more letters in a display name, else null."""
    usable = lambda t: len(t) >= 4
    tokens = _brand_tokens(usable, lambda t: t)
    return let(F.lower(display), lambda d: F.when(_brand_seen(d, usable), F.get(F.filter(
        tokens, lambda t: F.contains(d, t["needle"])), F.lit(0))["brand"]))


def brand_owns(number, domain):
    return among(F.concat_ws(" ", number.cast("string"), domain),
                 [f"{i} {d}" for i, (_, _, domains) in enumerate(lists.BRANDS, 1) for d in domains])


def brand_name(number):
    return F.try_element_at(text_list([b[0] for b in lists.BRANDS]), number)


def brand_domain_list(number):
    return F.try_element_at(text_list([", ".join(b[2]) for b in lists.BRANDS]), number)


def _no_targets():
    return constant("cast(array() as array<struct<place:int,brand:string,domain:string,core:string>>)")


def _targets_by_length():
    """At place n the targets that a word of n characters can be within two edits of, with their places in the list."""
    targets = list(enumerate(typosquat_targets()))
    rows = lambda n: ", ".join(
        f"named_struct('place', {i}, 'brand', {sql_text(b)}, 'domain', {sql_text(d)}, 'core', {sql_text(c)})"
        for i, (b, d, c) in targets if abs(len(c) - n) <= 2)
    kind = "array<struct<place:int,brand:string,domain:string,core:string>>"
    most = max(len(c) for _, (_, _, c) in targets) + 2
    return constant("array({})".format(", ".join(f"cast(array({rows(n)}) as {kind})" for n in range(most + 1))))


def typosquat(host, reg):
    """First brand domain within one or two edits of a word of the host, else null.

    Words are compared with the targets of about their length only; of all hits the first target counts, and of
    its words the first.
    """
    usable = lambda c: (F.length(c) >= 5) & ~among(c, lists.HOST_STOPWORDS)
    flat = F.regexp_replace(core_of(reg), "[-_]", "")
    words = F.array_distinct(F.filter(F.concat(label_tokens(host), F.array(flat)), usable))
    by_length = _targets_by_length()
    near = lambda w, core: F.levenshtein(w, core, 2)

    def search(ws):
        hits = F.flatten(F.transform(ws, lambda w, i: F.transform(
            F.filter(F.coalesce(F.get(by_length, F.length(w)), _no_targets()), lambda t: near(w, t["core"]).between(1, 2)),
            lambda t: F.struct(t["place"].alias("place"), i.alias("word"), t["brand"].alias("brand"),
                               t["domain"].alias("domain"), near(w, t["core"]).alias("distance")))))
        return let(F.array_min(hits), lambda t: F.when(t.isNotNull(), F.struct(
            t["brand"].alias("brand"), t["domain"].alias("domain"), t["distance"].alias("distance"))))

    return F.when(~among(reg, official_domains()), let(words, search))
