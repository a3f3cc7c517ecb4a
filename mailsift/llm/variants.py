"""Spelling variants: near words by composing the vocabulary with a one-edit transducer and itself.

Near words differ by exactly one inserted, deleted or replaced code point. For two of them let L be the
length of the shorter one and e the length of their common prefix, the place of the edit. The composition
(acceptor, one edit, acceptor) is dealt by initial states: a partition holds the words of length L and
L + 1 that agree before ``a`` and after ``b``, and enumerates exactly the pairs with e in [a, b). At first
[0, L) is halved, so that every word stands in four partitions and every pair is accepted in one.

In a partition the words between the agreed ends form two minimised acyclic acceptors, of the shorter
and of the longer words, whose states are shared with those of other partitions of the batch. Up to the
edit both sides read the same prefix; at the edit the transducer replaces or inserts one code point;
behind it the common language of two states is read, which is the whole language of a state where
minimisation made the two equal.

Hot partitions: those of more than ``MOST`` words, and regions longer than ``LONG``, are counted
beforehand (8 bytes a posting, combined before the shuffle) and dealt anew with the region halved, until
none is left. A region of one place holds at most the square of the alphabet, so this ends, and no
partition ever grows with the corpus. Pairs are not written out: each partition returns one row per word
with its number of near words there and the most frequent of them.

Defined cases: a null or empty text has no words; a null id counts as an empty one in the drawn
deletion. Repeated rows count as often as they stand there. Of near words with equal counts the first
in code-point order is the form. Words may have any length. Empty tables give no rows. Other columns are ignored.
"""

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from mailsift.llm.arrow import as_bytes, column, small
from mailsift.sources.shared import cut_lineage

RUN = "a-zÀ-ÿ"
HELD = 200_000  # distinct words that a task counts before it passes them on
BYTES = 8 << 20  # of text that Python holds at once
MOST, LONG = 2000, 64  # words and places of a partition that is not dealt anew
SHARED = 200_000  # states that partitions of a task share
NEAR = "word string, n_near long, form_n long, form string"


def with_drawn_deletion(run, key, every):
    """The run without one code point if ``every`` divides its hash with the id."""
    drawn = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
    if drawn % every:
        return run
    at = drawn % len(run)
    return run[:at] + run[at + 1:]


def vocabulary(docs, shortest=7, least=2, every=None):
    """``word`` and its number ``n`` of occurrences: runs of letters, A-Z lower-cased, over whole texts.

    With ``every``, one run in so many loses a code point, drawn by the hash of document and run.
    Tasks count their words before the shuffle, so a frequent word reaches its key once per task.
    """
    runs = re.compile(f"[{RUN}]{{{shortest},}}")

    def sent(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                                          names=["word", "n"])

    def run(batches):
        counts = Counter()
        for whole in batches:
            for batch in small(whole, BYTES):
                for key, text in zip(column(batch, "doc_id").to_pylist(), as_bytes(batch)):
                    for word, n in Counter(runs.findall(text.lower().decode("utf-8", "replace"))).items():
                        if every:
                            word = with_drawn_deletion(word, key, every)
                        if len(word) >= shortest:
                            counts[word] += n
                    if len(counts) > HELD:
                        yield sent(counts)
                        counts.clear()
        yield sent(counts)

    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def minimised(words, states, register):
    """State that accepts the sorted ``words``, all of one length; equal states are one. State 0 accepts the end."""
    size, last = len(words[0]), words[0]
    open_ = [[] for _ in range(size)]

    def close(down_to):
        node = 0
        for i in range(size - 1, down_to - 1, -1):
            open_[i].append((last[i], node))
            if i > down_to or not i:
                key = tuple(open_[i])
                node = register.get(key)
                if node is None:
                    node = register[key] = len(states)
                    states.append(key)
                open_[i] = []
        return node

    for word in words[1:]:
        place = 0
        while last[place] == word[place]:
            place += 1
        if place:
            close(place)
        else:  # the first state stays open
            rest = open_[0]
            open_[0] = []
            node = close(0)
            open_[0] = rest + list(states[node])
        last = word
    return close(0)


def both(x, y, states):
    """All strings that two states accept."""
    found, todo = [], [(x, y, "")]
    while todo:
        x, y, read = todo.pop()
        if x == y == 0:
            found.append(read)
        elif x == y:
            todo += [(to, to, read + c) for c, to in states[x]]
        else:
            right = dict(states[y])
            todo += [(to, right[c], read + c) for c, to in states[x] if c in right]
    return found


def composed(short, long, states, register):
    """Pairs of ``short`` by one replacement, and of ``short`` and ``long`` by one insertion."""
    if len(short) > 1:
        todo = [(minimised(short, states, register), "")]
        while todo:
            state, read = todo.pop()
            moves = states[state]
            for i, (c, x) in enumerate(moves):
                for d, y in moves[:i]:
                    for rest in both(x, y, states):
                        yield read + d + rest, read + c + rest
                if x:
                    todo.append((x, read + c))
    if long:
        todo = [(minimised(short, states, register), minimised(long, states, register), "")]
        while todo:
            x, y, read = todo.pop()
            ahead = dict(states[x])
            for c, to in states[y]:
                for rest in both(x, to, states):
                    if not rest.startswith(c) or not c:
                        yield read + rest, read + c + rest
                if c in ahead:
                    todo.append((ahead[c], to, read + c))


def near_in(batches):
    """Per partition and word the number of near words there, and the most frequent one."""
    states, register = [()], {}
    for batch in batches:
        sizes, of = (column(batch, name).to_pylist() for name in ("l", "b"))
        starts = column(batch, "a").to_pylist()
        members = column(batch, "members")
        ends = members.value_lengths().to_pylist()
        flat = members.flatten()
        words, counts = flat.field("word").to_pylist(), flat.field("n").to_pylist()
        out, at = [], 0
        for size, a, b, n in zip(sizes, starts, of, ends):
            groups = {}
            for i in range(at, at + n):  # keys are hashes, so the agreed ends are compared
                word = words[i]
                stop = len(word) - size + b
                groups.setdefault((word[:a], word[stop:]), ({}, {}))[len(word) - size][word[a:stop]] = i
            at += n
            for short, long in groups.values():
                if not short or len(short) + len(long) < 2:
                    continue
                near = {}
                for one, two in composed(sorted(short), sorted(long), states, register):
                    if len(one) < len(two):
                        if len(one) == b - a and two.startswith(one) and b < size:
                            continue  # the edit stands behind the region
                        i, j = short[one], long[two]
                    else:
                        i, j = short[one], short[two]
                    for own, other in ((i, j), (j, i)):
                        known = near.get(own)
                        if known is None:
                            near[own] = [1, -counts[other], words[other]]
                        else:
                            known[0] += 1
                            known[1:] = min(known[1:], [-counts[other], words[other]])
                out += [(words[i], k, -m, form) for i, (k, m, form) in near.items()]
                if len(states) > SHARED:
                    states, register = [()], {}
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.string()))],
                names=["word", "n_near", "form_n", "form"])


def posted(words, regions):
    """Every word under each of its partitions; ``regions`` is an array of (l, a, b)."""
    rows = words.select("word", "n", F.explode(regions).alias("r")).select("word", "n", "r.*")
    return rows.withColumn("key", F.expr("xxhash64(l, a, b, left(word, a), right(word, l - b))"))


def near_words(words):
    """``word``, ``n_near``, ``form_n``, ``form`` of all words that have near words, the form being the most frequent."""
    half = "transform(filter(array(length(word), length(word) - 1), l -> l > 0), l -> array({}))"
    first = "struct(l AS l, 0 AS a, l div 2 AS b), struct(l AS l, l div 2 AS a, l AS b)"
    typed = "array<struct<l:int,a:int,b:int>>"
    postings = posted(words, F.expr(f"filter(cast(flatten({half.format(first)}) AS {typed}), r -> r.a < r.b)"))
    parts = []
    while True:
        hot = cut_lineage(postings.groupBy("key", "a", "b").agg(F.count("*").alias("held")).filter(
            (F.col("b") - F.col("a") > 1) & ((F.col("held") > MOST) | (F.col("held") > 1) & (F.col("b") - F.col("a") > LONG)))
            .select("key"))
        groups = postings.join(hot, "key", "left_anti").groupBy("key", "l", "a", "b").agg(
            F.collect_list(F.struct("word", "n")).alias("members")).filter(F.size("members") > 1)
        parts.append(groups.select("l", "a", "b", "members").mapInArrow(near_in, NEAR))
        if hot.isEmpty():
            break
        halves = "array(struct(l, a, (a + b) div 2 AS b), struct(l, (a + b) div 2 AS a, b))"
        postings = cut_lineage(posted(postings.join(hot, "key", "left_semi"), F.expr(f"cast({halves} AS {typed})")))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", (-F.col("best.less")).alias("form_n"), "best.form")


def roots(links):
    """``word`` and ``root`` where following ``form`` ends; every round doubles the steps, forms grow tenfold a step."""
    at = cut_lineage(links.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not at.filter("moved").isEmpty():
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = cut_lineage(at.join(ahead, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
    return at.select("word", "root")


def grouped(words, factor=10):
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of every row of ``words`` (``word``, ``n``, no word twice).

    The form is the most frequent near word if it is at least ``factor`` (over 1) times as frequent.
    """
    words = cut_lineage(words.select("word", "n"))
    taken = F.col("form_n") >= factor * F.col("n")
    judged = words.join(near_words(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(taken, F.col("form")).alias("form"), F.when(taken, F.col("form_n")).alias("form_n"))
    judged = cut_lineage(judged)
    return judged.join(roots(judged.filter("form IS NOT NULL")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
