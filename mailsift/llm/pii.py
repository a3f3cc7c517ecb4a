"""Personal data and what gives it away, with DataFrame functions only.

Base spans are found by pattern: e-mail addresses, IP addresses, card and phone numbers. The method
then adds terms that reveal them. The protected entities are the four kinds of personal data, and each
single value (one address, one number). From the corpus, with base spans taken out of the texts, it counts
in how many documents a term stands and in how many it stands with an entity. With p the share of documents,

    pointwise mutual information  PMI(entity; term) = ln(p(entity, term) / (p(entity) p(term)))
    information content           IC(entity)        = -ln p(entity)

and the disclosure of an entity by a term is PMI / IC: 0 for unrelated terms, 1 for a term that stands
only where the entity does. Terms at or above ``generalise`` are replaced by their class, those at or
above ``remove`` are taken out: those that reveal a kind in the documents that hold the kind, those that
reveal a single value in all documents. A term counts only if it stands with a kind in at least ``texts``
different texts (base spans taken out; fewer are met by chance), and with a single value in at least
``entity_texts``, else it would just identify copies of one text.

Plan: base spans need no shuffle, they are array expressions within the row. Term counts are hashed
and aggregated before the shuffle, so frequent words are no hot keys. Values that stand in one text only
can have no terms of their own, so their documents' terms are not counted against them. Only documents with
a term that passes a filter of fixed size, made from the terms that reveal, are joined with those terms; all
others pass in the map. Nothing is broadcast by hint.

Defined cases: a null or empty text has no spans; repeated rows and null ids are handled row by row
(a null id gets base spans only); an empty table gives none; other columns stay as they are, whatever
their names, but for those named ``base``, ``spans`` and ``sanitised``, which are replaced.
"""

from functools import reduce

from pyspark.sql import functions as F

from mailsift.functions.columns import let, offsets, running
from mailsift.llm.arrow import aside
from mailsift.sources.shared import cut_lineage

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"

KINDS = ("email", "ip", "card", "phone")
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
SPAN = "struct<start:int,rank:int,end:int,kind:string,text:string>"
TERM = r"\p{L}"
BITS = 7  # in a byte of a filter, so that every byte is a character
MARKS = BITS << 18  # bits of the largest filter of hashes


def digits(text):
    return F.regexp_replace(text, "[^0-9]", "")


#: Pattern, a cheap test that every text with a match passes, and what a match must fulfil.
FOUND_BY = {
    "email": (EMAIL, lambda t: t.contains("@"), lambda m: F.lit(True)),
    "ip": (IP, lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), lambda m: m.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")),
    "card": (CARD, lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
             lambda m: let(digits(m), lambda d: F.length(d).between(14, 19) & F.call_function("luhn_check", d))),
    "phone": (PHONE, lambda t: t.rlike(r"\+[0-9][\x20().0-9-]"), lambda m: F.length(digits(m)).between(10, 15)),
}


def spans_of(text, pattern, kind, rank, holds=lambda m: F.lit(True)):
    """Places of the matches of a pattern as an array, in code points."""
    found = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hits"))
    return let(found, lambda f: F.filter(
        F.zip_with(offsets(f["gaps"], f["hits"]), f["hits"], lambda at, hit: F.struct(
            at.cast("int").alias("start"), F.lit(rank).alias("rank"), (at + F.length(hit)).cast("int").alias("end"),
            F.lit(kind).alias("kind"), hit.alias("text"))),
        lambda s: holds(s["text"]))).cast(f"array<{SPAN}>")


def of_kind(kind):
    return lambda span: span["kind"] == kind


NONE = f"cast(array() as array<{SPAN}>)"


def base_spans(text):
    """All base spans of a text, by start and then kind."""
    parts = []
    for rank, kind in enumerate(KINDS):
        pattern, seen, holds = FOUND_BY[kind]
        parts.append(F.when(seen(text), spans_of(text, F.lit(pattern), kind, rank, holds)).otherwise(F.expr(NONE)))
    return F.array_sort(F.concat(*parts))


def as_text(spans):
    """``kind:start:end`` of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def terms(text):
    """Distinct lower-case runs of at least three letters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"{TERM}{{3,}}+"), F.lit(0)))


def without_base(text):
    for pattern, *_ in FOUND_BY.values():
        text = F.regexp_replace(text, pattern, " ")
    return text


def revealing_terms(marked, generalise=0.8, remove=0.95, texts=5, entity_texts=2):
    """``kind``, ``entity``, ``term``, ``disclosure`` and ``action`` of the terms that reveal a kind or a single entity.

    ``marked`` has ``text`` and its ``base`` spans. ``entity`` is a hash of kind and value; null for a whole kind.
    """
    rows = marked.select(F.coalesce("text", F.lit("")).alias("text"), "base")
    clean = F.when(F.size("base") > 0, without_base(F.col("text"))).otherwise(F.col("text"))
    # an inner explode would get a filter on the size of its array, which finds all terms a second time
    everywhere = rows.select(F.explode_outer(terms(clean)).alias("term")).filter("term is not null").groupBy(
        F.xxhash64("term").alias("hash")).agg(F.count("*").alias("n_term"))
    holding = rows.filter(F.size("base") > 0).select(without_base(F.col("text")).alias("text"), protected().alias("about"))
    met = holding.select(F.xxhash64("text").alias("of"), F.explode("about").alias("a"))
    about = cut_lineage(met.groupBy("a.kind", "a.entity").agg(
        F.count("*").alias("n_value"), F.count_distinct("of").alias("n_of")).filter(
        F.col("entity").isNull() | (F.col("n_of") >= entity_texts)))
    totals = {r.kind: r.n_value for r in about.filter("entity is null").collect()}
    documents = rows.count()
    n = F.lit(documents).cast("double")
    n_about = about.filter("entity is not null").select(F.col("entity").alias("key"), "n_value")
    known, several = marks(n_about.select(F.col("key").alias("hash")))
    met = holding.select(F.xxhash64("text").alias("of"), terms(F.col("text")).alias("terms"), F.explode_outer(let(
        F.struct(known.alias("known"), "about"), lambda x: F.filter(x["about"], lambda a: a["entity"].isNull() | several(
            x["known"], a["entity"])))).alias("a")).filter("a is not null")
    together = met.select("of", "a.kind", "a.entity", F.explode("terms").alias("term")).groupBy(
        "kind", "entity", "term", "of").agg(F.count("*").alias("n")).groupBy("kind", "entity", "term").agg(
        F.sum("n").alias("n_both"), F.count("*").alias("n_texts")).filter(
        F.col("n_texts") >= F.when(F.col("entity").isNull(), texts).otherwise(entity_texts))
    hashed = F.xxhash64("term")
    candidates = together.withColumns({"hash": hashed, "key": F.coalesce("entity", hashed)}).join(n_about, "key", "left")
    n_entity = F.when(F.col("entity").isNull(), F.coalesce(*[
        F.when(F.col("kind") == k, F.lit(totals.get(k, 0))) for k in KINDS])).otherwise(F.col("n_value")).cast("double")
    pmi = F.log(F.col("n_both") * n / (n_entity * F.col("n_term")))
    scored = candidates.join(everywhere, "hash").withColumn("disclosure", F.when(n_entity < n, pmi / F.log(n / n_entity)))
    return scored.filter(F.col("disclosure") >= generalise).select(
        "kind", "entity", "term", "disclosure",
        F.when(F.col("disclosure") >= remove, "remove").otherwise("generalise").alias("action"))


def protected():
    """What the base spans of a document are about: its kinds (null ``entity``) and its single entities."""
    of = lambda entity: F.array_distinct(F.transform("base", lambda s: F.struct(
        s["kind"].alias("kind"), entity(s).alias("entity"))))
    return F.concat(of(lambda s: F.lit(None).cast("long")), of(lambda s: F.xxhash64(s["kind"], s["text"])))


def marks(hashes):
    """A filter of bounded size for hashes: its bytes, and a test that no hash of ``hashes`` fails.

    The bytes are a literal that plans print, so an expression should hold them once, bound by ``let``.
    """
    size = min(MARKS, max(128 * hashes.count(), BITS << 6) // BITS * BITS)
    places = lambda h: [F.pmod(x, F.lit(size)).cast("int") for x in (h, F.shiftright(h, 24))]
    marked = bytearray(size // BITS)
    for r in hashes.select(F.explode(F.array(*places(F.col("hash")))).alias("at")).distinct().toLocalIterator():
        marked[r["at"] // BITS] |= 1 << r["at"] % BITS

    def passes(known, h):
        def bit(at):
            byte = F.ascii(F.substring(known, F.floor(at / BITS).cast("int") + 1, 1).cast("string"))
            return F.getbit(byte.cast("long"), F.pmod(at, F.lit(BITS))) == 1
        return reduce(lambda a, b: a & b, map(bit, places(h)))

    return F.lit(bytes(marked)), passes


def sanitise(docs, generalise=0.8, remove=0.95, texts=5, entity_texts=2):
    """``docs`` with ``base`` (base spans), ``spans`` (all spans) and ``sanitised`` (the text with its spans replaced)."""
    docs = docs.drop("base", "spans", "sanitised")
    docs, back = aside(docs, ("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    marked = docs.withColumn("base", base_spans(text))
    revealing = cut_lineage(revealing_terms(marked, generalise, remove, texts, entity_texts))
    # a term that reveals a kind counts where such data stand, one that reveals a value counts everywhere
    known, passes = marks(revealing.select(F.when(F.col("entity").isNull(), F.xxhash64("term", F.lit("kind"))).otherwise(
        F.xxhash64("term")).alias("hash")))
    holds = F.size("base") > 0
    named = let(F.struct(known.alias("known"), holds.alias("holds"), text.alias("text")), lambda x: F.filter(
        terms(F.when(x["holds"], without_base(x["text"])).otherwise(x["text"])), lambda t: passes(x["known"], F.xxhash64(t)) | (
            x["holds"] & passes(x["known"], F.xxhash64(t, F.lit("kind"))))))
    clear = marked.filter(F.size(named) == 0).withColumn("spans", F.col("base")).withColumn(
        "sanitised", F.when(holds, replaced(text, F.col("base"))).otherwise(F.col("text")))
    others = marked.filter(F.size(named) > 0).withColumn("text_hash", F.xxhash64("text"))
    own = marked.select("doc_id", F.xxhash64("text").alias("text_hash"), F.array_distinct(F.transform(
        "base", lambda s: s["kind"])).alias("kinds"), F.explode_outer(named).alias("term")).filter("term is not null")
    reveals = own.join(revealing, "term").filter(
        F.col("entity").isNotNull() | F.array_contains("kinds", F.col("kind"))).groupBy("doc_id", "text_hash", "term").agg(
        F.max("action").alias("action")).groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.struct("action", "term")).alias("reveals"))
    joined = others.join(reveals, ["doc_id", "text_hash"], "left").drop("text_hash")

    def found(action):
        words = F.transform(F.filter("reveals", lambda r: r["action"] == action), lambda r: r["term"])
        pattern = F.concat(F.lit(rf"(?iu)(?<!{TERM})(?:"), F.array_join(words, "|"), F.lit(rf")(?!{TERM})"))
        return F.when(F.size(words) > 0, let(F.struct(text.alias("t"), pattern.alias("p")), lambda x: spans_of(
            x["t"], x["p"], "term" if action == "generalise" else "removed", 4))).otherwise(F.expr(NONE))

    extra = let(F.col("base"), lambda base: F.filter(F.concat(found("generalise"), found("remove")), lambda s: ~F.exists(
        base, lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"]))))
    joined = joined.withColumn("spans", F.array_sort(F.concat("base", F.when(
        F.col("reveals").isNotNull(), extra).otherwise(F.expr(NONE)))))
    joined = joined.withColumn("sanitised", F.when(F.size("spans") > 0, replaced(text, F.col("spans"))).otherwise(
        F.col("text"))).drop("reveals")
    return back(clear.unionByName(joined))


def replaced(text, spans):
    """The text with every span, or run of overlapping spans, replaced by the label of its first kind."""
    label = F.create_map(*[F.lit(x) for pair in [*LABELS.items(), ("term", "[TERM]"), ("removed", "")] for x in pair])
    tops = running(F.transform(spans, lambda s: s["end"]), 0, lambda a, b: F.greatest(a, b))
    return let(F.struct(text.alias("t"), spans.alias("s"), tops.alias("before")), lambda x: F.concat(
        F.array_join(F.zip_with(x["s"], x["before"], lambda s, at: F.when(s["start"] >= at, F.concat(
            F.substring(x["t"], at + 1, s["start"] - at), label[s["kind"]])).otherwise("")), ""),
        F.substring(x["t"], F.array_max(F.transform(x["s"], lambda s: s["end"])) + 1, F.length(x["t"]))))
