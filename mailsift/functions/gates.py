"""Cheap necessary conditions in front of expensive patterns.

Evaluating 78 patterns on every message costs about a hundred times more than
scanning it for a few words. From each pattern we read which literal words any
match must contain and test for them first with ``contains``, which the JVM
does without decoding the text. The words come from the pattern itself, so a
new catalogue row gets its gate for free and a gate can never hide a match.
"""

from re import _constants as k
from re import _parser

from mailsift.functions.columns import sql_text

MAX_GROUPS = 2
MIN_WORD = 3


def _words(node):
    """All-of list of any-of word groups that every match of ``node`` contains."""
    groups, run = [], ""
    for op, arg in list(node) + [(None, None)]:
        if op is k.LITERAL and chr(arg).isascii():
            run += chr(arg).lower()
            continue
        if op is k.AT:
            continue
        if run:
            groups.append([run])
            run = ""
        if op is k.SUBPATTERN:
            groups += _words(arg[3])
        elif op is k.MAX_REPEAT and arg[0] > 0:
            groups += _words(arg[2])
        elif op is k.BRANCH:
            inner = [_best(_words(alt)) for alt in arg[1]]
            if all(inner):
                groups.append(sorted(set().union(*inner)))
    return groups


def _weight(group):
    return len(group) / min(len(w) for w in group)


def _best(groups):
    usable = [g for g in groups if g and min(map(len, g)) >= 1]
    return min(usable, key=_weight) if usable else None


def word_groups(pattern):
    """The most selective groups of a pattern: a match contains a word of each."""
    usable = [g for g in _words(_parser.parse(pattern)) if min(map(len, g)) >= MIN_WORD]
    return sorted(usable, key=_weight)[:MAX_GROUPS]


def gate(lowered, pattern):
    """Condition on the lower-cased text without which ``pattern`` cannot match, as SQL."""
    groups = [" or ".join(f"contains({lowered}, {sql_text(w)})" for w in g) for g in word_groups(pattern)]
    return " and ".join(f"({g})" for g in groups) or "true"
