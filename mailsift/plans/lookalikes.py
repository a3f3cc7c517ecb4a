"""Hosts that imitate brands, found over all distinct hosts of a corpus by index joins.

Within a message (``operators.urls``) a host is compared with every brand. Over a corpus that is the wrong
way round: here the brands are an index, hosts and words come to it by equality, and only what meets
is compared. The cost depends on hosts and hits, not on the number of brands, which is a table of any size.
"""

from pyspark.sql import functions as F

from mailsift.data import lists
from mailsift.functions import domains
from mailsift.functions.columns import among

GRAM = 5  # letters of the key of a brand token; shorter tokens must be a whole part of the host
SHORTEST = 5  # letters of a core or word that is compared
REACH = 2  # edits


def in_host(hosts, tokens):
    """(host, brand_ord): the first brand with a token in the host.

    ``tokens`` has brand_ord and token. A host comes under each of its parts and of its runs of ``GRAM``
    letters with their place; a token under itself or its first letters.
    """
    parts = F.transform(F.array_distinct(F.split(F.translate("host", "-_", ".."), r"\.")),
                        lambda p: F.struct(F.lit(0).alias("at"), F.concat(F.lit("="), p).alias("key")))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length("host") - GRAM + 1, F.lit(1))),
                        lambda i: F.struct(i.alias("at"), F.concat(F.lit("~"), F.substring("host", i, GRAM)).alias("key")))
    posted = hosts.select("host", F.explode(F.concat(parts, grams)).alias("x")).select("host", "x.*")
    long = F.length("token") >= GRAM
    index = tokens.select("brand_ord", "token", F.when(long, F.concat(F.lit("~"), F.left("token", F.lit(GRAM))))
                          .otherwise(F.concat(F.lit("="), "token")).alias("key"))
    met = posted.join(index, "key").filter((F.col("at") == 0) | (F.expr("substring(host, at, length(token))") == F.col("token")))
    return met.groupBy("host").agg(F.min("brand_ord").alias("brand_ord"))


def shortened(word):
    """SQL for all strings that ``word`` becomes by dropping up to two code points; it has two at least."""
    without = lambda w, i: f"concat(left({w}, {i} - 1), substring({w}, {i} + 1))"
    one = f"transform(sequence(1, length({word})), i -> {without(word, 'i')})"
    two = (f"flatten(transform({one}, (w, k) -> if(k < length(w), transform(sequence(k + 1, length(w)), "
           f"j -> {without('w', 'j')}), array())))")
    return f"array_distinct(concat(array({word}), {one}, {two}))"


def cores(brand_domains):
    """(target_ord, brand, domain, core) of domains whose core is long enough; a core stands once, at its first domain."""
    core = domains.core_of(domains.registrable(F.col("domain")))
    rows = brand_domains.withColumn("core", core).filter(F.length("core") >= SHORTEST)
    first = rows.groupBy("core").agg(F.min_by(F.struct("domain_ord", "brand", "domain"), "domain_ord").alias("x"))
    return first.select(F.col("x.domain_ord").alias("target_ord"), "x.brand", "x.domain", "core")


def near_words(words, targets):
    """(word, target_ord, brand, domain, distance) for words within one or two edits of a core.

    Both sides are posted under everything they become by dropping up to two letters: strings that
    close share such a form. Words far longer than any core are not posted. The distance confirms.
    """
    longest = targets.agg(F.max(F.length("core"))).first()[0] or 0
    usable = words.filter(F.length("word").between(SHORTEST, longest + REACH)).select("word").distinct()
    posted = usable.select("word", F.explode(F.expr(shortened("word"))).alias("form"))
    index = targets.select("*", F.explode(F.expr(shortened("core"))).alias("form"))
    met = posted.join(index, "form").drop("form").distinct()
    return met.withColumn("distance", F.levenshtein("word", "core", REACH)).filter("distance BETWEEN 1 AND 2").drop("core")


def typosquats(hosts, brand_domains):
    """(host, brand, domain, distance): the first brand domain near a word of the host, by its first such word.

    ``hosts`` has host and registrable; hosts of brand domains themselves are left out.
    """
    flat = F.regexp_replace(domains.core_of(F.col("registrable")), "[-_]", "")
    usable = lambda w: (F.length(w) >= SHORTEST) & ~among(w, lists.HOST_STOPWORDS)
    own = F.array_distinct(F.filter(F.concat(domains.label_tokens(F.col("host")), F.array(flat)), usable))
    others = hosts.join(brand_domains.select(F.col("domain").alias("registrable")), "registrable", "left_anti")
    words = others.select("host", F.posexplode(own).alias("place", "word"))
    met = words.join(near_words(words, cores(brand_domains)), "word")
    first = met.groupBy("host").agg(F.min_by(F.struct("brand", "domain", "distance"), F.struct("target_ord", "place")).alias("x"))
    return first.select("host", "x.*")
