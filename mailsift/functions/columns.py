"""Column helpers shared by all operators."""

import functools

from pyspark import SparkContext
from pyspark.sql import functions as F

from mailsift.functions.regex import SPACE, WHITESPACE


def let(value, body):
    """Evaluate ``value`` once per row and use it many times in ``body``.

    The optimiser inlines a column that is named only once, also into a lambda,
    where it would run again for every array element. Binding it as a lambda
    variable keeps it at one evaluation.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def trim(text):
    return F.btrim(text, F.lit(WHITESPACE))


def collapse_spaces(text):
    return F.btrim(F.regexp_replace(text, f"{SPACE}+", " "), F.lit(" "))


def compact(*items):
    """Array of the items that are not null."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def first_of_each(items, key):
    """Keep the first array element per key; elements with a null key go.

    Sorted by key and place, an element is the first of its key if the one before it has another key.
    """
    rows = F.sort_array(F.transform(items, lambda x, i: F.struct(key(x).alias("key"), i.alias("at"), x.alias("item"))))
    first = let(rows, lambda rs: F.filter(rs, lambda r, i: r["key"].isNotNull() & (
        (i == 0) | ~r["key"].eqNullSafe(F.try_element_at(rs, F.greatest(i, F.lit(1)))["key"]))))
    return F.transform(F.sort_array(F.transform(first, lambda r: F.struct(r["at"].alias("at"), r["item"].alias("item")))),
                       lambda r: r["item"])


def is_first(items, key):
    """For every array element whether it is the first of its key; an element with a null key is not."""
    rows = F.sort_array(F.transform(items, lambda x, i: F.struct(key(x).alias("key"), i.alias("at"))))
    told = let(rows, lambda rs: F.transform(rs, lambda r, i: F.struct(r["at"].alias("at"), (r["key"].isNotNull() & (
        (i == 0) | ~r["key"].eqNullSafe(F.try_element_at(rs, F.greatest(i, F.lit(1)))["key"]))).alias("first"))))
    return F.transform(F.sort_array(told), lambda t: t["first"])


def runs(items, key, place):
    """Per key the place of its first element and the number of its elements, as (key, at, n) in order of place."""
    rows = F.sort_array(F.transform(items, lambda x: F.struct(key(x).alias("key"), place(x).alias("at"))))
    heads = let(rows, lambda rs: F.filter(F.transform(rs, lambda r, i: F.struct(
        F.when((i == 0) | ~r["key"].eqNullSafe(F.try_element_at(rs, F.greatest(i, F.lit(1)))["key"]), i).alias("row"),
        r["key"].alias("key"), r["at"].alias("at"), F.size(rs).alias("all"))), lambda h: h["row"].isNotNull()))
    return F.transform(F.sort_array(let(heads, lambda hs: F.transform(hs, lambda h, i: F.struct(
        h["at"].alias("at"), h["key"].alias("key"), (F.coalesce(F.get(hs, i + 1)["row"], h["all"]) - h["row"]).alias("n"))))),
        lambda x: F.struct(x["key"].alias("key"), x["at"].alias("at"), x["n"].alias("n")))


MARK = "\u0001"
STAND_IN = "\ufffd"


def gaps(text, pattern):
    """The texts between the matches of a pattern.

    ``split`` compiles its pattern again for every row, ``regexp_replace`` does
    not, so matches are replaced by a mark first. A mark in the text itself gives
    way to a character that all patterns treat alike.
    """
    return F.split(F.regexp_replace(F.replace(text, F.lit(MARK), F.lit(STAND_IN)), pattern, MARK), MARK)


def running(values, start, step, kind="int"):
    """What ``step`` makes of all values before each one; ``step`` is associative.

    Appending to an array copies it, so the values go in blocks of the square root of
    their number: first the totals of the blocks, then the values of each block.
    """
    def scan(items, first):
        state = F.struct(first.alias("now"), F.array().cast(f"array<{kind}>").alias("seen"))
        return F.aggregate(items, state, lambda acc, x: F.struct(
            step(acc["now"], x).alias("now"), F.array_append(acc["seen"], acc["now"]).alias("seen")),
            lambda acc: acc["seen"])

    def blocked(v):
        size = F.greatest(F.ceil(F.sqrt(F.size(v))), F.lit(1)).cast("int")
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / size).cast("int")),
                          lambda k: F.slice(v, k * size + 1, size))
        zero = F.lit(start).cast(kind)
        return let(cut, lambda blocks: F.flatten(F.zip_with(
            blocks, scan(F.transform(blocks, lambda b: F.aggregate(b, zero, lambda a, x: step(a, x))), zero), scan)))

    return let(values, lambda v: F.when(F.size(v) > 0, blocked(v)).otherwise(F.array().cast(f"array<{kind}>")))


def offsets(gaps, hits):
    """Start of every hit, from the texts between hits and the hits themselves."""
    return let(F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(
        F.length(g).alias("gap"), F.length(h).alias("hit"))), lambda z: F.zip_with(
        running(F.transform(z, lambda x: x["gap"] + x["hit"]), 0, lambda a, b: a + b), z, lambda at, x: at + x["gap"]))


def contained(items, spans):
    """For every item (start, end) whether one of the spans (start, end) holds it.

    A sweep over all starts in order: a span that starts no later holds the item if the furthest end of
    such spans is no earlier than the item's. Linear but for the sort, however many spans there are.
    """
    point = lambda x, kind, at: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"),
                                         x["end"].alias("end"), at.alias("at"))
    points = F.sort_array(F.concat(F.transform(spans, lambda s: point(s, 0, F.lit(-1))),
                                   F.transform(items, lambda x, i: point(x, 1, i))))
    told = let(points, lambda ps: F.zip_with(ps, running(F.transform(ps, lambda p: F.when(p["kind"] == 0, p["end"]).otherwise(-1)),
                                                         -1, lambda a, b: F.greatest(a, b)),
                                             lambda p, reach: F.struct(p["at"].alias("at"), (reach >= p["end"]).alias("held"))))
    return F.transform(F.sort_array(F.filter(told, lambda t: t["at"] >= 0)), lambda t: t["held"])


def where(items, flags, wanted=True):
    """The array elements whose flag is ``wanted``."""
    zipped = F.zip_with(items, flags, lambda x, f: F.struct(x.alias("item"), f.alias("flag")))
    return F.transform(F.filter(zipped, lambda z: z["flag"] == wanted), lambda z: z["item"])


def once(build):
    """Build a column expression once per Spark application.

    Expressions name columns, not data frames, so all plans can share them.
    Building one takes a call into the JVM per node, which adds up.
    """
    built = {}

    @functools.wraps(build)
    def get(*args):
        key = (SparkContext.getOrCreate().applicationId, *args)
        if key not in built:
            built[key] = build(*args)
        return built[key]
    return get


def sql_text(value):
    """A string as a Spark SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def among(value, values):
    """Whether a text is one of a list. The optimiser makes a hash set of a longer list."""
    return value.isin(list(values))


@once
def constant(sql):
    return F.expr(sql)


def text_list(values):
    return constant(f"array({', '.join(map(sql_text, values))})")
