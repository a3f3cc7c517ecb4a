"""Fill-in-middle transformation on a piece table.

A document is a list of descriptors (buffer, start, end) over two immutable buffers: its own text and
the sentinels. Cutting splits descriptors, an arrangement permutes the three parts and puts the
descriptor of its sentinel before each, and restoring reads the parts' descriptors off the output and
applies the inverse permutation. Hashes and output read the slices the descriptors name, one after
another; no part is copied before that. Everything is one map over the rows: no shuffle, and where a
document is cut depends on its id only, so that a lost task gives the same rows again.

Defined cases: a null text is empty; an empty text, one that holds a sentinel, and those that ``rate``
leaves out stay plain (``prefix_chars`` and ``middle_chars`` null). A null id counts as an empty one.
Parts may be empty. Repeated rows give equal rows. A line is as long as it is, a text without line
feed is one line. All columns are kept; those with the names of new ones are replaced.
"""

import hashlib

import numpy as np
import pyarrow as pa

from mailsift.llm.arrow import add_columns, as_bytes, column

PREFIX, MIDDLE, SUFFIX = 0, 1, 2
MARKS = (b"<P>", b"<M>", b"<S>")  # of prefix, middle, suffix
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
TEXT, SENTINELS = 0, 1
BUFFER = b"".join(MARKS)
MARK = [(SENTINELS, 3 * i, 3 * i + 3) for i in range(3)]
BYTES = 4 << 20  # of text that Python holds at once


def whole(text):
    """The table of an untouched text."""
    return [(TEXT, 0, len(text))]


def cut(pieces, at):
    """The table in two, at a number of bytes from its start; the descriptor there is split."""
    left, right = [], []
    for buffer, start, end in pieces:
        take = min(max(at, 0), end - start)
        at -= end - start
        if take:
            left.append((buffer, start, start + take))
        if take < end - start:
            right.append((buffer, start + take, end))
    return left, right


def arranged(parts, form):
    """One table of the three parts in the order of ``form``, each after its sentinel."""
    return [piece for i in ORDERS[form] for piece in [MARK[i], *parts[i]]]


def parted(output, form):
    """Prefix, middle and suffix as tables over an output, by the places of the sentinels."""
    order = ORDERS[form]
    starts = [0]
    for i in order[1:]:
        starts.append(output.index(MARKS[i], starts[-1] + 3))
    ends = starts[1:] + [len(output)]
    return [[(TEXT, starts[k] + 3, ends[k])] for k in map(order.index, (PREFIX, MIDDLE, SUFFIX))]


def slices(pieces, text):
    buffers = memoryview(text), memoryview(BUFFER)
    return [buffers[buffer][start:end] for buffer, start, end in pieces]


def hashed(pieces, text):
    """SHA-256 over the slices of a table."""
    state = hashlib.sha256()
    for part in slices(pieces, text):
        state.update(part)
    return state.hexdigest()


def characters(pieces, text):
    """Code points of a table: bytes that continue none."""
    return sum(int(np.count_nonzero(np.frombuffer(part, np.uint8) & 0xC0 != 0x80)) for part in slices(pieces, text))


def line_ends(text):
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return ends if not text or text.endswith(b"\n") else np.append(ends, len(text))


def draws(seed, key):
    """Four numbers of 32 bits that depend on seed and id only."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]


def split(text, key, seed, rate, spm):
    """Form, number of lines, table of the output, and code points of prefix and middle of one text."""
    ends = line_ends(text)
    n = len(ends)
    one, two, drawn, kind = draws(seed, key)
    if not text or any(mark in text for mark in MARKS) or drawn % 100 >= rate:
        return "plain", n, whole(text), None, None
    low, high = (int(ends[k - 1]) if k else 0 for k in sorted((one % (n + 1), two % (n + 1))))
    rest, suffix = cut(whole(text), high)
    prefix, middle = cut(rest, low)
    form = "spm" if kind % 100 < spm else "psm"
    return form, n, arranged((prefix, middle, suffix), form), characters(prefix, text), characters(middle, text)


def transform(docs, key="doc_id", text="text", seed=7, rate=100, spm=50):
    """``docs`` with ``output`` and its ``output_sha256``, ``form``, ``n`` (lines), ``prefix_chars``, ``middle_chars``.

    ``rate`` per cent of the documents are rearranged, ``spm`` per cent of those with the suffix first.
    """
    def make():
        def run(batch):
            rows = []
            for own, content in zip(column(batch, key).to_pylist(), as_bytes(batch, text)):
                form, n, table, prefix, middle = split(content, own, seed, rate, spm)
                rows.append((b"".join(slices(table, content)), hashed(table, content), form, n, prefix, middle))
            output, *rest = zip(*rows)
            return [pa.array(output, pa.binary()).cast(pa.string())] + [
                pa.array(values, kind) for values, kind in zip(rest, [pa.string(), pa.string()] + [pa.int64()] * 3)]
        return run

    return add_columns(docs, "output string, output_sha256 string, form string, n long, prefix_chars long, "
                             "middle_chars long", make, BYTES)


def restore(transformed):
    """Rows of ``transform`` with ``restored``, the text rebuilt from ``output`` and ``form`` alone, and its hash."""
    def make():
        def run(batch):
            rows = []
            for output, form in zip(as_bytes(batch, "output"), column(batch, "form").to_pylist()):
                parts = parted(output, form) if form in ORDERS else [whole(output)]
                table = [piece for part in parts for piece in part]
                rows.append((b"".join(slices(table, output)), hashed(table, output)))
            texts, hashes = zip(*rows)
            return [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(hashes, pa.string())]
        return run

    return add_columns(transformed, "restored string, restored_sha256 string", make, BYTES)


def oracle_sql():
    """The same rows as one SQL statement, by splitting at line feeds."""
    return """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS lines,
                      sha256('7:' || coalesce(cast(doc_id AS varchar), '')) AS h FROM documents),
counted AS (SELECT *, cast(len(lines) - CASE WHEN lines[-1] = '' THEN 1 ELSE 0 END AS bigint) AS n,
                   list_transform([1, 9, 17, 25], lambda i: cast('0x' || substr(h, i, 8) AS bigint)) AS d FROM texts),
places AS (SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS low, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS high,
                  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
                       WHEN d[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM counted),
heads AS (SELECT *, CASE WHEN low = n THEN t WHEN low = 0 THEN '' ELSE array_to_string(lines[1:low], chr(10)) || chr(10) END AS p,
                 CASE WHEN high = n THEN t WHEN high = 0 THEN '' ELSE array_to_string(lines[1:high], chr(10)) || chr(10) END AS pm
          FROM places),
parts AS (SELECT *, substr(pm, length(p) + 1) AS m, substr(t, length(pm) + 1) AS s FROM heads)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts"""
