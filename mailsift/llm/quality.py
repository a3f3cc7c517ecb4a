"""Quality classifier: interpolated modified Kneser-Ney n-gram model of trusted text, one per language.

Trained on documents that are labelled good and not toxic. Counts are made by Spark: n-grams of the
highest order by occurrence, combined per block of documents before they are shuffled, and lower orders
from those rows, by the number of distinct n-grams that continue them. Each order has three discounts
from its counts of counts. Sums over contexts are sharded by the context. Probabilities are built from
the unigrams up. Keys are hashes that a language has for itself.

All trusted documents of the training fold are trained on, whole (``trusted_sample`` draws fewer, for uses of
one's own). The model is packed into sorted pieces by ranges of its keys, in the shared folder. Documents take turns
by a hash of their text: the keys of a turn's documents, packed likewise, meet the pieces of their range in one task,
so neither the driver nor a task holds the model whole, and disk holds the keys of one turn only.

A document's score is its mean negative log-likelihood per word, drawn towards the mean of its language
as if it had ``PRIOR_WORDS`` words more, so that few words do not decide. It is rejected above the
quantile ``QUANTILE`` of the scores of trusted documents of its language. Labelled rows fall into two
folds by a hash of the id: the model trains on one, the quantiles are taken over all of the other.

Defined cases: a null or empty text has no words, no perplexity, and stays; so do documents of a
language without trusted documents, which has no model: its perplexity, score and threshold are null. A null language is one of its own. A label without a document,
or with a null, does not count; repeated rows count each. Keys of n-grams are 64-bit hashes.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from mailsift.llm.arrow import ODD, add_columns, as_bytes, aside, column, mix, word_hashes, written
from mailsift.sources.shared import cut_lineage, release, removed, work_folder

ORDER = 3
TRAIN_LABELS, TRAIN_CHARS = 5000, 16_000_000
PRIOR_WORDS, QUANTILE = 20, 0.995
BLOCK = 100_000  # words scored at once
TURN_CHARS, TURNS = 20_000_000, 6  # characters that are scored in one turn, and the most turns
LEAST_ROWS, SHARDS, SHARD_ROWS = 50_000, 16, 2_000_000  # rows of the model in a shard: at least with under SHARDS, about
PACKED, TOLD = 250_000, 50_000  # rows of the model packed at once; rows given back to Spark at once
PIECES = "shard int, context boolean, keys binary, values binary"
COUNTED = 1_000_000  # words whose n-grams a task counts together
WINDOW = 2000  # characters that a long document is trained on in one place
START = np.uint64(0x5BD1E995)


def seeded(lang, size):
    return word_hashes([b"%d " % max(size, 0) + (lang or "").encode()])[0]


def chained(out, columns):
    """Hashes ``out`` continued by columns of word hashes."""
    with np.errstate(over="ignore"):
        for c in columns:
            out = mix(out + c * ODD[0] + ODD[1])
    return out


def folded(lang, columns):
    """Hashes of n-grams given as columns of word hashes."""
    return chained(np.full(len(columns[0]), seeded(lang, len(columns))), columns)


def grams(lang, words, size):
    """Hashes of the ``size``-grams that end at each word, with start marks in front."""
    if size < 1:
        return np.full(len(words), seeded(lang, size))
    padded = np.concatenate([np.full(size - 1, START), words])
    return folded(lang, [padded[i:i + len(words)] for i in range(size)])


def contexts(lang, words, size):
    """Hashes of what precedes each word in its ``size``-gram."""
    padded = np.concatenate([[START], words[:-1]]) if len(words) else words
    return grams(lang, padded, size - 1)


def counted(trusted, order):
    """``lang``, the word hashes ``w1`` to ``w<order>`` and ``n``: distinct n-grams of the highest order.

    Tasks count whole blocks of documents before the shuffle. Lower orders follow from these rows alone.
    """
    names = [f"w{i}" for i in range(1, order + 1)]

    def table(block):
        for lang, documents in block.items():
            padded = [np.concatenate([np.full(order - 1, START), w]) for w in documents if len(w)]
            if not padded:
                continue
            columns = [np.concatenate([w[i:len(w) - order + 1 + i] for w in padded]) for i in range(order)]
            _, first, n = np.unique(folded(lang, columns), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(n), pa.string()), *(pa.array(c[first].view(np.int64)) for c in columns), pa.array(n)],
                names=["lang", *names, "n"])

    def run(batches):
        block, size = {}, 0
        for batch in batches:
            for lang, text in zip(column(batch, "lang").to_pylist(), as_bytes(batch)):
                words = word_hashes(text.split())
                block.setdefault(lang or "", []).append(words)
                size += len(words)
                if size > COUNTED:
                    yield from table(block)
                    block, size = {}, 0
        yield from table(block)

    schema = ", ".join(["lang string", *(f"{w} long" for w in names), "n long"])
    return within_contexts(trusted.select("lang", "text").mapInArrow(run, schema), order)


def within_contexts(rows, size):
    """n-grams of one order with ``n`` (its sum), and of their context the ``total`` of n, and how many have n of 1, 2 and more.

    Rows are dealt by context, so that counting and the sums over contexts take one shuffle and one sort. Unigrams
    have no context but the language, whose rows meet in one task only after they have been added up elsewhere.
    """
    names = [f"w{i}" for i in range(1, size + 1)]
    if size == 1:
        table = rows.groupBy("lang", "w1").agg(F.sum("n").alias("n"))
        of = Window.partitionBy("lang")
        return table.withColumns({"total": F.sum("n").over(of), "c1": F.count_if(F.col("n") == 1).over(of),
                                  "c2": F.count_if(F.col("n") == 2).over(of), "c3": F.count_if(F.col("n") > 2).over(of),
                                  "heads": F.row_number().over(of.orderBy("w1")) == 1})  # one row for its context

    def run(batches):
        rows = pa.Table.from_batches(batches).combine_chunks() if (batches := list(batches)) else None
        if rows is None or not rows.num_rows:
            return
        langs = rows.column("lang").combine_chunks().dictionary_encode()
        words = [rows.column(w).combine_chunks().to_numpy().view(np.uint64) for w in names]
        context = chained(np.array([seeded(x, size - 1) for x in langs.dictionary.to_pylist()], np.uint64)[langs.indices.to_numpy()], words[:-1])
        order = np.lexsort((words[-1], context))
        context, last = context[order], words[-1][order]
        head = np.concatenate([[True], context[1:] != context[:-1]])
        first = np.flatnonzero(head | np.concatenate([[True], last[1:] != last[:-1]]))
        n, head, order = np.add.reduceat(rows.column("n").combine_chunks().to_numpy()[order], first), head[first], order[first]
        at = np.flatnonzero(head)
        sums = [np.repeat(np.add.reduceat(x.astype(np.int64), at), np.diff(at, append=len(n))) for x in (n, n == 1, n == 2, n > 2)]
        out = pa.RecordBatch.from_arrays([langs.take(pa.array(order)).cast(pa.string()), *(pa.array(w[order].view(np.int64)) for w in words),
                                          pa.array(n), *map(pa.array, sums), pa.array(head)],
                                         names=["lang", *names, "n", "total", "c1", "c2", "c3", "heads"])
        for start in range(0, out.num_rows, TOLD):
            yield out.slice(start, TOLD)

    schema = ", ".join(["lang string", *(f"{w} long" for w in [*names, "n", "total", "c1", "c2", "c3"]), "heads boolean"])
    return rows.repartition("lang", *names[:-1]).mapInArrow(run, schema)


def keyed(table, size):
    """A table of n-grams with ``gram``, ``context`` and ``lower`` in place of the words."""
    def make():
        def run(batch):
            langs = column(batch, "lang").dictionary_encode()
            words = [column(batch, f"w{i}").to_numpy().view(np.uint64) for i in range(1, size + 1)]
            own, less = (np.array([seeded(lang, n) for lang in langs.dictionary.to_pylist()], np.uint64)[langs.indices.to_numpy()]
                         for n in (size, size - 1))
            keys = chained(own, words), chained(less, words[:-1]), chained(less, words[1:])
            return [pa.array(k.view(np.int64)) for k in keys]
        return run

    return add_columns(table, "gram long, context long, lower long", make).drop(*(f"w{i}" for i in range(1, size + 1)))


def discounts(table):
    """Modified Kneser-Ney discounts per language from the counts of counts."""
    rows = table.groupBy("lang").agg(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in range(1, 5)])
    y = F.try_divide("n1", F.col("n1") + 2 * F.col("n2"))
    of = lambda i: F.greatest(F.lit(0.1), F.least(F.lit(i - 0.05), F.coalesce(
        i - (i + 1) * y * F.try_divide(f"n{i + 1}", f"n{i}"), F.lit(0.75 * i))))
    found = rows.select("lang", *[of(i).cast("double").alias(f"d{i}") for i in (1, 2, 3)]).collect()
    return [by_language({r.lang: r[f"d{i}"] for r in found}) for i in (1, 2, 3)]


class Model:
    """``shards``, the packed tables of the model in ``n_shards`` ranges of keys, and per language what an unknown word adds."""

    def __init__(self, order, shards, n_shards, unknown):
        self.order, self.shards, self.n_shards, self.unknown = order, shards, n_shards, unknown


def planes(values):
    """The bytes of an array, first bytes first: what values have in common stands together and is compressed away."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def from_planes(data, kind):
    kind = np.dtype(kind)
    return np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1).T.copy().view(kind).ravel()


def split(keys, shards):
    """Where sorted keys fall into the next of ``shards`` equal ranges, and the ranges that have some."""
    shard = (keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
    found, first = np.unique(shard, return_index=True)
    return found.astype(np.int32), [*zip(first.tolist(), [*first[1:].tolist(), len(keys)])]


def packed(rows, shards, context):
    """Rows of ``key`` and ``value`` as sorted pieces: ``shard``, ``context``, ``keys`` (differences) and ``values``.

    Values keep 37 of the 53 bits of a double.
    """
    def table(keys, values):
        order = np.argsort(keys)
        keys, values = keys[order], ((values[order].view(np.uint64) + np.uint64(1 << 15)) >> np.uint64(16)) << np.uint64(16)
        found, ends = split(keys, shards)
        return pa.RecordBatch.from_arrays(
            [pa.array(found), pa.array([context] * len(found)),
             pa.array([planes(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in ends], pa.binary()),
             pa.array([planes(values[a:b]) for a, b in ends], pa.binary())], names=["shard", "context", "keys", "values"])

    def run(batches):
        for part in collected(batches, PACKED):
            yield table(column(part, "key").to_numpy().view(np.uint64), column(part, "value").to_numpy())

    return rows.select("key", "value").mapInArrow(run, PIECES)


def collected(batches, most):
    """The rows of many batches as batches of about ``most`` rows."""
    waiting, size = [], 0
    for batch in batches:
        waiting.append(batch)
        size += batch.num_rows
        if size >= most:
            yield pa.concat_batches(waiting)
            waiting, size = [], 0
    if size:
        yield pa.concat_batches(waiting)


def train(trusted, order=ORDER):
    """Model of documents with ``lang`` and ``text``, all of them; its tables stay in the shared folder.

    The log-likelihood of a word is that of its longest known n-gram, and the back-off weights of the contexts
    above. It is written as a sum that needs no order of look-ups: the unigram and the weights of all known
    contexts, and for every known n-gram what it changes, its own value less the weight of its context and less
    the value of the n-gram below, which is known if it is. The value of a unigram is what it adds to that of an
    unknown word.
    """
    spark = trusted.sparkSession
    folder = work_folder(spark)
    tables = {order: written(counted(trusted, order), f"{folder}/{order}")}
    for size in range(order - 1, 0, -1):  # how many distinct words precede an n-gram
        above = tables[size + 1].select("lang", *(F.col(f"w{i + 1}").alias(f"w{i}") for i in range(1, size + 1)))
        tables[size] = written(within_contexts(above.withColumn("n", F.lit(1).cast("long")), size), f"{folder}/{size}")
    n = 2 * sum(t.count() for t in tables.values())
    shards = max(1, min(-(-n // LEAST_ROWS), SHARDS), n // SHARD_ROWS)
    pieces, unknown, below = work_folder(spark), {}, None

    def keep(rows, name, context=False):
        packed(rows, shards, context).write.parquet(f"{pieces}/part={name}")

    for size in range(1, order + 1):
        for name in (size - 1, f"p{size - 2}"):  # what is left of them has been written
            removed(spark, f"{folder}/{name}")
        release(spark)
        one, two, three = discounts(tables[size])
        cut = F.when(F.col("n") == 1, one).when(F.col("n") == 2, two).otherwise(three)
        rows = tables[size].withColumn("own", (F.col("n") - cut) / F.col("total")).withColumn(
            "share", (one * F.col("c1") + two * F.col("c2") + three * F.col("c3")) / F.col("total"))
        words = [f"w{i}" for i in range(1, size + 1)]
        if size == 1:  # an equal share of what is left for every word of the language and an unknown one
            types = F.col("c1") + F.col("c2") + F.col("c3") + 1
            rows = rows.select("lang", "w1", "heads", (F.col("share") / types).alias("equal"), (F.col("own") + F.col("share") / types).alias("p"))
            unknown = {r.lang: float(np.log(r.equal)) for r in rows.filter("heads").select("lang", "equal").collect()}
            below = written(keyed(rows.select("lang", "w1", "p"), size).select("gram", "lang", "p"), f"{folder}/p1")
            keep(below.select(F.col("gram").alias("key"), (F.ln("p") - by_language(unknown)).alias("value")), "gram1")
            continue
        keep(keyed(rows.filter("heads").select("lang", *words, F.ln("share").alias("value")), size).select(
            F.col("context").alias("key"), "value"), f"context{size}", True)
        ratio, under = (F.col("own") / F.col("share")).alias("ratio"), F.col("p").alias("under")
        change = F.log1p(F.col("ratio") / F.col("under")).alias("value")
        if size < order:
            found = keyed(rows.select("lang", *words, "share", ratio), size).select("gram", "lower", "share", "ratio")
            joined = found.join(below.select(F.col("gram").alias("lower"), under), "lower")
            below = written(joined.select("gram", (F.col("share") * (F.col("ratio") + F.col("under"))).alias("p"), change), f"{folder}/p{size}")
            keep(below.select(F.col("gram").alias("key"), "value"), f"gram{size}")
        else:
            found = keyed(rows.select("lang", *words, ratio), size).select("gram", "lower", "ratio")
            keep(found.join(below.select(F.col("gram").alias("lower"), under), "lower").select(
                F.col("gram").alias("key"), change), f"gram{size}")
    removed(spark, folder)
    return Model(order, spark.read.schema(PIECES).parquet(pieces).drop("part"), shards, unknown)


def text_key():
    """What the likelihood of a document depends on, as one number: language and text."""
    return F.xxhash64(F.coalesce("lang", F.lit("")), F.coalesce("text", F.lit("")))


def asked(docs, model):
    """The keys of the model's sum in texts, by shard: of blocks of documents, sorted.

    ``shard``, ``of`` (the documents of the block that have keys there), ``keys`` (differences), ``at`` (of which of
    them) and how often the key stands there as an n-gram (``n``) and as a context (``m``).
    """
    order, shards, known = model.order, model.n_shards, set(model.unknown)

    def keys_of(lang, words):
        own = [grams(lang, words, size) for size in range(1, order + 1)]
        before = [contexts(lang, words, size) for size in range(2, order + 1)]
        keys, place = np.unique(np.concatenate(own + before), return_inverse=True)
        ends = order * len(words)
        return keys, np.bincount(place[:ends], minlength=len(keys)), np.bincount(place[ends:], minlength=len(keys))

    def table(block):
        of = np.array([of for of, _ in block], np.int64)
        at = np.repeat(np.arange(len(block), dtype=np.uint32), [len(keys) for _, (keys, _, _) in block])
        keys, n, m = (np.concatenate(c) for c in zip(*(found for _, found in block)))
        order = np.argsort(keys)
        keys, at, n, m = keys[order], at[order], n[order].astype(np.uint32), m[order].astype(np.uint32)
        found, ends = split(keys, shards)
        out = []
        for a, b in ends:
            some, place = np.unique(at[a:b], return_inverse=True)
            out.append((of[some].tobytes(), planes(np.diff(keys[a:b], prepend=np.uint64(0))), planes(place.astype(np.uint32)),
                        planes(n[a:b]), planes(m[a:b])))
        return pa.RecordBatch.from_arrays([pa.array(found), *(pa.array(c, pa.binary()) for c in zip(*out))],
                                          names=["shard", "of", "keys", "at", "n", "m"])

    def run(batches):
        block, size = [], 0
        for batch in batches:
            for of, lang, text in zip(column(batch, "of").to_pylist(), column(batch, "lang").to_pylist(), as_bytes(batch)):
                words = word_hashes(text.split())
                if not len(words) or (lang or "") not in known:
                    continue
                block.append((of, keys_of(lang, words)))
                size += len(words)
                if size > BLOCK:
                    yield table(block)
                    block, size = [], 0
        if block:
            yield table(block)

    return docs.select("of", "lang", "text").mapInArrow(
        run, "shard int, of binary, keys binary, at binary, n binary, m binary")


def answered(asks, shards):
    """(of, total): what the keys of a shard add to the documents that ask for them."""
    def look_up(keys, known, values):
        if not len(known):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, values[at], 0.0)

    def run(asks, pieces):
        known = []
        for context in (False, True):
            some = [(k, v) for c, k, v in zip(*(pieces.column(x).to_pylist() for x in ("context", "keys", "values"))) if c == context]
            keys = np.concatenate([np.empty(0, np.uint64), *(np.cumsum(from_planes(k, np.uint64), dtype=np.uint64) for k, _ in some)])
            values = np.concatenate([np.empty(0), *(from_planes(v, np.float64) for _, v in some)])
            by_key = np.argsort(keys)
            known.append((keys[by_key], values[by_key]))
        ofs, totals = [np.empty(0, np.int64)], [np.empty(0)]
        for of, keys, at, n, m in zip(*(asks.column(x).to_pylist() for x in ("of", "keys", "at", "n", "m"))):
            keys = np.cumsum(from_planes(keys, np.uint64), dtype=np.uint64)
            adds, of = np.zeros(len(keys)), np.frombuffer(of, np.int64)
            for times, (k, v) in zip((n, m), known):
                times = from_planes(times, np.uint32)
                some = np.flatnonzero(times)
                adds[some] += times[some] * look_up(keys[some], k, v)
            ofs.append(of)
            totals.append(np.bincount(from_planes(at, np.uint32), adds, len(of)))
        return pa.table({"of": pa.array(np.concatenate(ofs)), "total": pa.array(np.concatenate(totals))})

    return asks.groupBy("shard").cogroup(shards.groupBy("shard")).applyInArrow(run, "of long, total double")


def with_likelihood(docs, model):
    """``docs`` (``lang``, ``text``) with ``n_words`` and ``log_likelihood`` of each text, null without a model.

    Keys of texts meet the model in its shards. Texts take their turns by hash, so that the keys of all of them never
    lie on disk together. Equal texts share a sum, which is divided by their number.
    """
    def make():
        return lambda batch: [pa.array([len(t.split()) for t in as_bytes(batch)], pa.int64())]

    def turn(at):  # what it leaves on the driver goes with it
        asks = asked(docs.filter(F.pmod("of", F.lit(turns)) == at), model)
        answered(asks, model.shards).groupBy("of").agg(F.sum("total").alias("total")).write.parquet(f"{folder}/turn={at}")

    spark = docs.sparkSession
    docs = docs.withColumn("of", text_key())
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    turns = max(1, min(TURNS, -(-size // TURN_CHARS)))
    folder = work_folder(spark)
    for at in range(turns):
        release(spark)
        turn(at)
    docs = add_columns(docs, "n_words long", make)
    copies = docs.groupBy("of").agg(F.count("*").alias("copies"))
    sums = spark.read.schema("of long, total double").parquet(*(f"{folder}/turn={at}" for at in range(turns)))
    each = sums.join(copies, "of").select("of", (F.col("total") / F.col("copies")).alias("each"))
    floor = by_language(model.unknown)
    return docs.join(each, "of", "left").withColumn(
        "log_likelihood", F.col("n_words") * floor + F.coalesce("each", F.lit(0.0))).drop("of", "each")


def fold():
    """0 for labelled rows to train on, 1 for those that the thresholds are taken from."""
    return F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(2))


def level(sizes, total):
    """The largest bound on every size that keeps their sum within ``total``; infinite if all fit."""
    left, sizes = total, sorted(sizes)
    for i, size in enumerate(sizes):
        if size * (len(sizes) - i) > left:
            return left / (len(sizes) - i)
        left -= size
    return float("inf")


def trusted_sample(docs, labels, most=TRAIN_LABELS, chars=TRAIN_CHARS):
    """Trusted documents for training: about ``most`` of the first fold, of at most ``chars`` characters in all."""
    trusted = labels.filter(F.col("doc_id").isNotNull() & (fold() == 0)).filter("quality = 1 and toxic = 0").select(
        "doc_id").distinct()
    found = cut_lineage(docs.select("doc_id", "lang").join(trusted, "doc_id", "left_semi"))
    n = {r.lang: r.n for r in found.groupBy(F.coalesce("lang", F.lit("")).alias("lang")).agg(F.count("*").alias("n")).collect()}
    share = by_language({k: min(1.0, level(n.values(), most) / v) for k, v in n.items()})
    drawn = found.filter(F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 20)) < share * (1 << 20))
    good = docs.join(F.broadcast(drawn.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", "lang", "text")
    sizes = {}
    for r in good.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce(F.length("text"), F.lit(0)).alias("size")).collect():
        sizes.setdefault(r.lang, []).append(r.size)
    most_of = level([sum(v) for v in sizes.values()], chars)
    tops = {k: int(min(level(v, most_of), 2**31 - 1)) for k, v in sizes.items()}
    return good.withColumn("text", spread_windows(F.col("text"), by_language(tops)))


def spread_windows(text, most):
    """A text of at most ``most`` characters: itself, or windows spread evenly from its start to its end, spaces between."""
    size = F.least(F.lit(WINDOW), most)
    n = F.floor((most + 1) / (size + 1))
    step = (F.length(text) - size) / F.greatest(n - 1, F.lit(1))
    windows = F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.substring(
        text, (F.floor(i * step) + 1).cast("int"), size.cast("int")))
    return F.when(F.length(text) > most, F.array_join(windows, " ")).otherwise(text)


def trusted_documents(docs, labels):
    """All trusted documents of the first fold, whole."""
    trusted = labels.filter(F.col("doc_id").isNotNull() & (fold() == 0)).filter("quality = 1 and toxic = 0").select(
        "doc_id").distinct()
    return docs.select("doc_id", "lang", "text").join(trusted, "doc_id", "left_semi")


def limits(scored, labels, quantile=QUANTILE, prior=PRIOR_WORDS):
    """Per language: mean negative log-likelihood per word and the score above which documents go."""
    trusted = labels.filter("quality = 1 and toxic = 0").filter(fold() == 1).select("doc_id").distinct()
    rows = cut_lineage(scored.filter("n_words > 0 and log_likelihood is not null").join(trusted, "doc_id", "left_semi").select(
        F.coalesce("lang", F.lit("")).alias("lang"), "n_words", "log_likelihood"))
    means = {r.lang: r.m for r in rows.groupBy("lang").agg(
        (-F.sum("log_likelihood") / F.sum("n_words")).alias("m")).collect()}
    if not means:
        return {}
    tops = rows.groupBy("lang").agg(F.percentile_approx(
        drawn_to(by_language(means), prior), quantile, 100_000).alias("top")).collect()
    return {r.lang: (means[r.lang], r.top) for r in tops}


def by_language(values):
    """A number per language as a column; null for others. Languages are few."""
    known = {k or "": v for k, v in values.items()}
    if not known:
        return F.lit(None).cast("double")
    return F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), F.coalesce("lang", F.lit("")))


def drawn_to(mean, prior):
    return (-F.col("log_likelihood") + prior * mean) / (F.col("n_words") + prior)


def judged(scored, found, prior=PRIOR_WORDS):
    """``scored`` with ``perplexity``, ``score``, ``threshold`` and ``keep``."""
    mean = by_language({k: v[0] for k, v in found.items()})
    top = by_language({k: v[1] for k, v in found.items()})
    return scored.withColumn("perplexity", F.when(F.col("n_words") > 0, F.exp(
        -F.col("log_likelihood") / F.col("n_words")))).withColumn("score", drawn_to(mean, prior)).withColumn(
        "threshold", top).withColumn("keep", F.coalesce((F.col("score") <= F.col("threshold")) | (F.col("n_words") == 0),
                                                        F.lit(True)))


def classify(docs, labels):
    """Every document: ``doc_id``, ``lang``, ``n_words``, ``perplexity``, ``score``, ``threshold``, ``keep``."""
    model = train(trusted_documents(docs, labels))
    scored = cut_lineage(with_likelihood(docs.select("doc_id", "lang", "text"), model).drop("text"))
    return judged(scored, limits(scored, labels)).drop("log_likelihood")


def keep_good(docs, labels):
    """The documents that are not rejected, with their columns whatever their names; texts are read again."""
    docs, back = aside(docs, ("doc_id", "lang", "text"))
    model = train(trusted_documents(docs, labels))
    texts = docs.select("doc_id", "lang", "text")
    scored = cut_lineage(with_likelihood(texts, model).withColumn("of", text_key()).drop("text"))
    rejected = judged(scored, limits(scored, labels)).filter("not keep").select("of").distinct()
    return back(docs.withColumn("of", text_key()).join(rejected, "of", "left_anti").select(*docs.columns))
