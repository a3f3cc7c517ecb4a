"""File names mentioned in a body and the rules over them."""

from pyspark.sql import functions as F

from mailsift.data import lists
from mailsift.functions.columns import among, compact, contained, gaps, let, offsets, once, where
from mailsift.functions.regex import FILE_NAME, NOT_BEFORE_WORD
from mailsift.operators.findings import finding, no_findings

FILE = "struct<name:string,start:int,end:int>"
# Ordered: the first group that holds an extension decides the rule.
GROUP_RULES = [("executable", "executable_attachment"), ("disk_image", "disk_image_attachment"),
               ("macro", "macro_attachment"), ("archive", "archive_attachment"), ("unusual", "risky_attachment")]

_EXTENSION_SEEN = rf"(?i)\.(?:{'|'.join(lists.all_extensions())}){NOT_BEFORE_WORD}"


def mentions(body):
    """Every file name with its position, as found (names may repeat)."""
    def build(s):
        return let(offsets(s["gaps"], s["hits"]), lambda starts: F.transform(
            F.arrays_zip(s["hits"].alias("hit"), s["names"].alias("name"), starts.alias("start")),
            lambda z: F.struct(F.lower(z["name"]),
                               z["start"] + F.length(z["hit"]) - F.length(z["name"]),
                               z["start"] + F.length(z["hit"])).cast(FILE)))

    found = F.struct(gaps(body, FILE_NAME).alias("gaps"),
                     F.regexp_extract_all(body, F.lit(FILE_NAME), F.lit(0)).alias("hits"),
                     F.regexp_extract_all(body, F.lit(FILE_NAME), F.lit(1)).alias("names"))
    return F.coalesce(F.when(body.rlike(_EXTENSION_SEEN), let(found, build)), F.array().cast(f"array<{FILE}>"))


def outside(files, spans):
    """Files that no span contains (anti join on an interval, inside the row)."""
    return let(files, lambda fs: where(fs, contained(fs, spans), False))


def inside(files, spans):
    """Files that a span contains."""
    return let(files, lambda fs: where(fs, contained(fs, spans)))


@once
def _files():
    spans = F.transform("urls", lambda u: F.struct(u["start"].alias("start"), u["end"].alias("end")))
    return F.array_distinct(F.transform(outside(mentions(F.col("body")), spans), lambda f: f["name"]))


def with_files(df):
    """Adds files: distinct names outside of links; needs urls."""
    return df.withColumn("files", _files())


def extension(name):
    return F.regexp_extract(name, r"\.([a-z0-9]+)\z", 1)


def is_double_extension(name):
    first, last = "|".join(lists.DOUBLE_EXTENSION_FIRST), "|".join(lists.DOUBLE_EXTENSION_LAST)
    return name.rlike(rf"\.(?:{first})\.(?:{last})\z")


def is_generic_name(name):
    return name.rlike(r"\d{3,}|^(?:document|doc|file|image|scan|attachment|copy|invoice|report)[ _-]?\d*\.")


def file_rules(name):
    """Rules that a file name shows, in the order they are tested."""
    by_group = F.when(F.lit(False), F.lit(""))
    for group, rule in GROUP_RULES:
        by_group = by_group.when(among(extension(name), lists.EXTENSION_GROUPS[group]), F.lit(rule))
    return compact(
        F.when(is_double_extension(name), F.lit("double_extension")),
        F.when(name.rlike("[\\u202D\\u202E]"), F.lit("rtl_override_filename")),
        F.when(~is_double_extension(name), by_group),
        F.when(is_generic_name(name), F.lit("unusual_attachment_name")))


@once
def _findings():
    def build(files):
        shown = F.array_distinct(F.flatten(F.transform(files, lambda f: f["rules"])))
        return F.transform(shown, lambda rule: finding(rule, F.slice(F.transform(
            F.filter(files, lambda f: F.array_contains(f["rules"], rule)), lambda f: f["name"]), 1, 5)))

    tagged = F.transform("files", lambda n: F.struct(n.alias("name"), file_rules(n).alias("rules")))
    return F.when(F.size("files") > 0, let(tagged, build)).otherwise(no_findings())


def with_attachment_findings(df):
    """Adds attachment_findings: one per rule, in order of the first file that shows it."""
    return df.withColumn("attachment_findings", _findings())


def ext_group():
    """(extension, group) pairs of all known extensions; harmless ones have their own group."""
    pairs = [(e, g) for g, exts in lists.EXTENSION_GROUPS.items() for e in exts]
    return pairs + [(e, "harmless") for e in lists.HARMLESS_EXTENSIONS]
