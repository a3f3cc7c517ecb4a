"""Benchmark decontamination with a generalised suffix automaton of the test items.

Texts are words: A-Z lower-cased, runs of digits, letters and everything beyond ASCII. The automaton of
the items is built over word numbers inside Spark tasks. Documents stream through it word by word: the
state tells the longest stretch that ends here and stands in some item, so every stretch of ``window``
words or more is a hit as a whole, and so is an item of fewer words that ends here (states know the short
items among their suffixes). The items of a window are kept at the one state that holds it.

Plan: one map over the documents, whose texts are never shuffled. Items are cut into chunks that overlap
by ``window - 1`` words, which loses no window, and dealt by hash to blocks whose size is counted and at
most ``BLOCK`` bytes; a block becomes one automaton, which the driver passes on by broadcast. A larger
set of items takes one pass over the documents per block, ``TOGETHER`` passes in a stage, and the hits
of a document are merged in its row. So neither the broadcast nor a task grows with the items.

Defined cases: null and empty texts have no words, and items without words match nothing. Repeated items
count once by id; words of an item without an id are hits, but nothing is listed for it. Repeated
documents are judged alike, each in its row; ids of documents are not used. Without items nothing is hit.
"""

import pickle
import re

import pyarrow as pa
from pyspark.sql import functions as F

from mailsift.llm.arrow import add_columns, as_bytes, column
from mailsift.sources.shared import cut_lineage

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CHUNK = 2000  # words of a chunk of an item
BLOCK = 1 << 20  # bytes of words, and one byte a word, in an automaton
TOGETHER = 4  # automata that a stage passes documents through
BYTES = 4 << 20  # of text that Python holds at once
SPANS = "array<struct<first:long,last:long,start:long,end:long>>"
FOUND = f"n_words long, spans {SPANS}, items array<string>"


def lowered(text):
    """A text in bytes with A-Z lower-cased, as code points."""
    return text.lower().decode("utf-8", "replace")


class Automaton:
    """Suffix automaton of several word sequences; state 0 is the empty one."""

    def __init__(self, sequences, window):
        """``sequences`` are pairs of an id, which may be None, and a list of words; one shorter than ``window`` counts whole."""
        self.numbers, self.window = {}, window
        self.next, self.link, self.length = [{}], [-1], [0]
        coded = [(key, [self.numbers.setdefault(w, len(self.numbers)) for w in words]) for key, words in sequences if words]
        for _, words in coded:
            last = 0
            for word in words:
                last = self._extended(last, word)
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        self.holder = [0] * len(self.next)  # the state of the suffix of ``window`` words
        for state in order:
            if self.length[state] >= window:
                above = self.link[state]
                self.holder[state] = state if self.length[above] < window else self.holder[above]
        self.ids, self.whole = {}, {}  # ids by state of a window; ids by state and length of a short item
        for key, words in coded:
            state = 0
            for i, word in enumerate(words):
                state = self.next[state][word]
                if i + 1 >= window:
                    self.ids.setdefault(self.holder[state], set()).add(key)
            if len(words) < window:
                self.whole.setdefault(state, {}).setdefault(len(words), set()).add(key)
        self.short = {}  # by state the short items among its suffixes, as (length, state)
        for state in order:
            own = [(n, state) for n in sorted(self.whole.get(state, ()), reverse=True)]
            own += self.short.get(self.link[state], [])
            if own:
                self.short[state] = own
        self.tells = [bool(h) or s in self.short for s, h in enumerate(self.holder)]

    def _new(self, moves, link, length):
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, state, word, to):
        """The state that ``state`` reaches by ``word`` with the strings of exactly its length and shorter."""
        if self.length[to] == self.length[state] + 1:
            return to
        copy = self._new(dict(self.next[to]), self.link[to], self.length[state] + 1)
        self.link[to] = copy
        while state >= 0 and self.next[state].get(word) == to:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extended(self, last, word):
        """The state of all read so far and ``word``."""
        if word in self.next[last]:  # another sequence has it
            return self._split(last, word, self.next[last][word])
        new = self._new({}, 0, self.length[last] + 1)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, word, self.next[last][word])
        return new

    def scan(self, words):
        """Maximal runs (first, last) of hit words, and the ids of the items with windows among them."""
        read = list(map(self.numbers.get, words))
        spans, windows, shorts = [], set(), set()
        moves, link, lengths, tells, holder = self.next, self.link, self.length, self.tells, self.holder
        state = matched = 0
        for i, word in enumerate(read):
            if word is None:
                state = matched = 0
                continue
            to = moves[state].get(word)
            while to is None and state:
                state = link[state]
                matched = lengths[state]
                to = moves[state].get(word)
            if to is None:
                matched = 0
                continue
            state = to
            matched += 1
            if not tells[state]:
                continue
            reach = 0
            if matched >= self.window:
                reach = matched
                windows.add(holder[state])
            for n, at in self.short.get(state, ()):
                if n <= matched:
                    reach = max(reach, n)
                    shorts.add((at, n))
            if reach:
                spans.append((i - reach + 1, i))
        found = set().union(*(self.ids[s] for s in windows), *(self.whole[s][n] for s, n in shorts))
        return merged(spans), found - {None}


def merged(spans):
    """Maximal runs of the words that ``spans`` (first, last) cover."""
    out = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


def chunks(items, window, key, text):
    """``item_id`` (string), ``words`` and ``bytes`` of overlapping chunks of the items, without repeated ones."""
    def run(batches):
        for batch in batches:
            rows = []
            for own, content in zip(column(batch, "item_id").to_pylist(), as_bytes(batch)):
                words = WORD.findall(lowered(content))
                step = max(CHUNK, window) - window + 1
                for at in range(0, max(1, len(words) - window + 1), step):
                    part = words[at:at + step + window - 1]
                    if part:
                        rows.append((own, part, sum(len(w.encode()) + 1 for w in part)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(
                    zip(*rows), (pa.string(), pa.list_(pa.string()), pa.int64()))], names=["item_id", "words", "bytes"])

    read = items.select(F.col(key).cast("string").alias("item_id"), F.col(text).alias("text"))
    return read.mapInArrow(run, "item_id string, words array<string>, bytes long").distinct()


def automata(items, window=10, key="item_id", text="text"):
    """One row per block of items: ``block`` and the pickled ``automaton``."""
    parts = cut_lineage(chunks(items, window, key, text))
    blocks = max(1, -(-(parts.agg(F.sum("bytes")).first()[0] or 0) // BLOCK))
    while True:
        dealt = parts.withColumn("block", F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)))
        sizes = dealt.groupBy("block").agg(F.sum("bytes").alias("held"), F.count("*").alias("n"))
        if not sizes.filter(f"held > {2 * BLOCK} AND n > 1").limit(1).count():  # a chunk alone cannot be dealt anew
            break
        blocks *= 2

    def build(group):
        rows = zip(group.column("item_id").to_pylist(), group.column("words").to_pylist())
        return pa.table({"block": group.column("block")[:1], "automaton": [pickle.dumps(Automaton(rows, window))]})

    return dealt.groupBy("block").applyInArrow(build, "block long, automaton binary")


def scanned(docs, automaton, text="text"):
    """``docs`` with what one automaton finds, merged with what the ones before it found."""
    known = [name in docs.columns for name in ("spans", "items")]
    sent = docs.sparkSession.sparkContext.broadcast(automaton)

    def make():
        machine = pickle.loads(sent.value)

        def run(batch):
            texts = [lowered(t) for t in as_bytes(batch, text)]
            before = [column(batch, name).to_pylist() if k else [()] * len(texts) for name, k in zip(("spans", "items"), known)]
            rows = []
            for content, spans, items in zip(texts, *before):
                words = WORD.findall(content)
                found, ids = machine.scan(words)
                if found:
                    old = [(s["first"], s["last"]) for s in spans]
                    places = [m.span() for m in WORD.finditer(content)]
                    spans = [{"first": a, "last": b, "start": places[a][0], "end": places[b][1]}
                             for a, b in merged(old + [tuple(f) for f in found])]
                rows.append((len(words), list(spans), sorted(ids.union(items))))
            span = pa.struct([(name, pa.int64()) for name in ("first", "last", "start", "end")])
            return [pa.array(v, t) for v, t in zip(zip(*rows), (pa.int64(), pa.list_(span), pa.list_(pa.string())))]
        return run

    return add_columns(docs, FOUND, make, BYTES)


def contamination(docs, items, window=10, key="item_id", text="text"):
    """``docs`` with ``n_words``, ``spans`` (runs of hit words, with places in code points) and ``items`` (sorted ids).

    Columns of these names are replaced, all others kept.
    """
    built = cut_lineage(automata(items, window, key))
    out = docs.drop("n_words", "spans", "items")
    blocks = sorted(r.block for r in built.select("block").collect())  # numbers only
    for i, block in enumerate(blocks):
        if i and i % TOGETHER == 0:
            out = cut_lineage(out)
        out = scanned(out, bytes(built.filter(F.col("block") == block).first().automaton), text)
    return out if blocks else scanned(out, pickle.dumps(Automaton([], window)), text)


def clean(docs, items, window=10, longest=10, share=0.5, key="item_id", text="text"):
    """``docs`` without leaked spans: runs of ``longest`` hit words or more are cut out of the text.

    Documents of which more than ``share`` of the words are hit are dropped whole. The columns are those
    of ``docs``, and the text of other documents is as it was.
    """
    held = F.struct(*[F.col(c) for c in docs.columns]).alias("own")  # under one name, so that none clashes
    judged = contamination(docs.select(held, F.col(text).alias("text")), items, window, key)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    long = F.filter("spans", lambda s: s["last"] - s["first"] + 1 >= longest)

    def make():
        def run(batch):
            out = []
            for content, spans in zip(column(batch, "text").to_pylist(), column(batch, "cut").to_pylist()):
                at, kept = 0, []
                for span in spans:
                    kept.append(content[at:span["start"]])
                    at = span["end"]
                out.append("".join(kept) + content[at:] if spans else content)
            return [pa.array(out, pa.string())]
        return run

    kept = judged.filter(hit <= share * F.col("n_words")).select("own", "text", long.alias("cut"))
    return add_columns(kept, "text string", make, BYTES).select(
        *[F.col("text").alias(c) if c == text else F.col("own").getField(c).alias(c) for c in docs.columns])


def oracle_sql():
    """The same rows as one SQL statement, by joining windows as strings."""
    words = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
             r"'[0-9a-z\x{80}-\x{10FFFF}]+')")
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
placed AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM docs),
runs AS (SELECT r, p, list(word) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS run FROM placed),
tests AS (SELECT cast(item_id AS varchar) AS item_id, {words} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, w[p:p + 9] AS key
            FROM (SELECT *, unnest(range(1, greatest(len(w) - 8, 2))) AS p FROM tests WHERE len(w) > 0)),
hits AS (SELECT runs.r, p, size, item_id FROM runs JOIN windows ON run[1:size] = key),
covered AS (SELECT r, count(DISTINCT p + k) AS n_hit FROM (SELECT r, p, unnest(range(size)) AS k FROM hits) GROUP BY r),
listed AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
           FROM (SELECT DISTINCT r, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN listed USING (r)"""
