"""Byte-level BPE encoding and decoding by a tree reduction.

A text is halved until its parts are short. A part becomes a list of pieces (the matches of the
split pattern) with the ids of each piece. Two neighbours are joined by encoding again what lies
around their boundary: on the left all pieces whose match may have read past the end, on the right
a window that doubles until one of its piece starts coincides with a piece start that the right
part found by itself. The pattern looks ahead only, so from a common start on both readings agree
and the tokens outside of the window are final. The operation is associative, so any tree gives
the ids of one pass over the whole text. Decoding concatenates bytes up the same tree.

Why three characters suffice on the left: a match that starts at ``s`` reads at most up to ``s + 2``
(contractions), and otherwise up to the first character that ends its run, or that follows it.
Only a match that ends at the end of the part could have met that end while reading its run.

Defined cases: a null or empty text has no ids; a text without any break is one piece and is
encoded whole; repeated rows are encoded alike; tables may be empty and carry any extra columns.
"""

import array
import base64
import functools
import sys

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken

from mailsift.llm.arrow import add_columns, column

LEAF = 4096  # characters of a part that is no longer halved
READS = 3  # characters from its start that any match may read
REMEMBERED = 200_000  # pieces whose ids a task remembers

# The regex module's \s equals the White_Space property, as that of the tokenizer library does.
PIECES = regex.compile(public_tokenizers.PATTERN).findall


def little_endian(ids):
    packed = array.array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class Codec(dict):
    """Ids of pieces, as little-endian unsigned 32-bit integers, by rank file."""

    def __init__(self, path):
        super().__init__()
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.bytes_of[rank] = piece

    @functools.cached_property
    def encoding(self):
        """The library's encoding; tasks that only decode do without."""
        ranks = {piece: rank for rank, piece in enumerate(self.bytes_of) if piece}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, piece):
        ids = little_endian(self.encoding.encode_ordinary(piece))
        if len(self) >= REMEMBERED:
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def leaf(self, text):
        pieces = PIECES(text)
        return pieces, list(map(self.__getitem__, pieces))

    def tree(self, text):
        if len(text) <= LEAF:
            return self.leaf(text)
        half = len(text) // 2
        return self.join(self.tree(text[:half]), self.tree(text[half:]))

    def join(self, left, right):
        """Pieces and ids of two neighbouring parts as one part."""
        (pieces, ids), (after, after_ids) = left, right
        if not pieces or not after:
            return left if pieces else right
        keep = len(pieces) - 1
        open_ = len(pieces[keep])
        while keep and open_ + len(pieces[keep - 1]) < READS:
            keep -= 1
            open_ += len(pieces[keep])
        head, take = "".join(pieces[keep:]), 4
        while True:
            whole = take >= len(after)
            found = PIECES(head + "".join(after[:take]))
            at = self._meet(len(head), found, after[:take], whole)
            if at:
                break
            take *= 2
        new, resume = found[:at[0]], at[1]
        del pieces[keep:], ids[keep:]
        pieces += new
        ids += map(self.__getitem__, new)
        pieces += after[resume:]
        ids += after_ids[resume:]
        return pieces, ids

    @staticmethod
    def _meet(at, found, after, whole):
        """Numbers of new pieces and of old right pieces before the first common start, if it is certain."""
        starts = {}
        for i, piece in enumerate(after):
            starts[at] = i
            at += len(piece)
        end, at = at, 0
        if whole:
            starts[end] = len(after)
        for i, piece in enumerate(found):
            if at in starts and (whole or end - at >= READS):
                return i, starts[at]
            at += len(piece)
        return (len(found), len(after)) if whole else None

    def encode(self, text):
        """Ids of a text as bytes."""
        return b"".join(self.tree(text)[1])

    def decode(self, ids):
        """Bytes of an array of ids, concatenated up the tree."""
        if len(ids) <= LEAF:
            return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@functools.lru_cache(2)
def codec(path):
    return Codec(path)


def encode(docs, path, text="text"):
    """``docs`` with ``ids`` (binary, little-endian unsigned 32-bit integers) and ``n_tokens`` of its texts."""
    def make():
        known = codec(path)

        def run(batch):
            ids = [known.encode(t or "") for t in column(batch, text).to_pylist()]
            return [pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64())]
        return run

    return add_columns(docs, "ids binary, n_tokens long", make)


def decode(encoded, path):
    """``encoded`` with ``decoded``: the bytes of its ids."""
    def make():
        known = codec(path)
        return lambda batch: [pa.array([known.decode(np.frombuffer(i or b"", "<u4"))
                                        for i in column(batch, "ids").to_pylist()], pa.binary())]

    return add_columns(encoded, "decoded binary", make)
