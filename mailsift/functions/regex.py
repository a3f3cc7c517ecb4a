"""Rendering of catalogue patterns for the JVM regular-expression dialect.

Three differences matter for right results:

* ``\\b`` must look at ASCII word characters only. The JVM's own meaning
  changed between releases, so it is spelled out as lookarounds.
* ``\\s`` must include no-break, ideographic and other wide spaces.
* ``$`` must be the very end of the text, written ``\\z``.

A group repeat recurses once per round in the JVM and can overflow the stack, so
the labels of a long host are taken in atomic blocks, which leave no frames.
A label ends at its dot, so nothing inside of a block could match otherwise.
"""

import re

from mailsift.data import lists

WS = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
# The same class in a form that a plain ASCII character leaves after two tests.
SPACE = r"[\s[\u0080-\uFFFF&&[\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]]]"
WHITESPACE = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
WS_IN_LINE = WS.replace(r"\n", "")
NOT_AFTER_WORD = r"(?<![A-Za-z0-9_])"
NOT_BEFORE_WORD = r"(?![A-Za-z0-9_])"
BOUNDARY = (rf"(?:(?<=[A-Za-z0-9_]){NOT_BEFORE_WORD}|{NOT_AFTER_WORD}(?=[A-Za-z0-9_]))")
BLOCK = 64  # labels


def _boundary(match):
    before, after = match.string[:match.start()], match.string[match.end():]
    if re.match(r"[A-Za-z0-9]|\\d|\(\?:[A-Za-z0-9]", after) and (not before or before[-1] in "}])"):
        return NOT_AFTER_WORD
    if re.search(r"([A-Za-z]|[a-z]\?|[^?]\))$", before) and not re.match(r"[A-Za-z0-9]", after):
        return NOT_BEFORE_WORD
    return BOUNDARY


def jvm(pattern, ignore_case=True):
    """Render a catalogue pattern; ``\\s`` may only stand outside a class."""
    body = re.sub(r"\\b", _boundary, pattern).replace(r"\s", SPACE).replace(r"\/", "/")
    return ("(?i)" if ignore_case else "") + body


_LABEL = r"(?:[a-z0-9](?:[a-z0-9_-]{0,61}[a-z0-9])?\.)"
# The lookahead lets a label that is no known suffix fail before the long alternation is tried.
_KNOWN_TLD = rf"(?=[a-z]{{2,8}}{NOT_BEFORE_WORD})(?:{'|'.join(lists.all_tlds())}){NOT_BEFORE_WORD}"
HOST = rf"{_LABEL}(?>{_LABEL}{{{BLOCK}}})*{_LABEL}{{0,{2 * BLOCK - 2}}}{_KNOWN_TLD}"

SCHEME_URL = rf"""(?i){NOT_AFTER_WORD}(?:hxxps?|https?|ftps?)[{WS}]*:[{WS}]*//[^{WS}<>"'`]+"""
# A leading at sign or slash is taken along so that such hosts can be told apart.
BARE_HOST = rf"(?i)[@/]?{NOT_AFTER_WORD}{HOST}"
HOST_IN_TEXT = rf"(?i)(?:https?://)?{HOST}"
FILE_NAME = (rf"""(?i)(?:^|[{WS}"'\[(<>])(\w[\w .\-()]{{0,58}}\.(?:{'|'.join(lists.all_extensions())}))"""
             rf"{NOT_BEFORE_WORD}")
HEADER_LINE = rf"^[A-Za-z][A-Za-z0-9\-]{{1,40}}[{WS}]*:"
ANCHOR = (rf"""(?i)<a{NOT_BEFORE_WORD}[^>]*href[{WS}]*=[{WS}]*(?:"([^"]*)"|'([^']*)'|([^{WS}>]+))[^>]*>"""
          r"""([\s\S]*?)</a>""")
HTML_TAG = (rf"(?i)<[{WS}]*/?[{WS}]*(?:html|head|body|table|tr|td|div|span|p|a|img|font|br|meta|style|form|input)"
            rf"{NOT_BEFORE_WORD}[^>]*>")
