"""Host names outside ASCII: mapped by the rules of UTS 46 (not transitional), checked, and written in Punycode.

The mapping is what its definition derives it from: compatibility composition with folded case, less what is ignored; only what
differs from that is listed. Which characters there are is what Python's Unicode tables say; what is newer cannot be in a host.
Of the two joiners only those after a virama are taken, as Python has no joining types.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from functools import lru_cache

# Characters that are ignored (first, last), those that stay though folding would change them, and those that cannot be in a host.
IGNORED = ((0xAD, 0xAD), (0x34F, 0x34F), (0x180B, 0x180D), (0x180F, 0x180F), (0x200B, 0x200B), (0x2060, 0x2060), (0x2064, 0x2064), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0x1BCA0, 0x1BCA3), (0xE0100, 0xE01EF))
KEPT, JOINERS = "ßς‌‍", "‌‍"
MAPPED = {"ẞ": "ß", "。": "."}
NEVER = "≠≮≯￼�"
_FIRSTS = [a for a, _ in IGNORED]


@lru_cache(maxsize=4096)
def _one(c: str) -> str:
    """What a character is mapped to."""
    if c in KEPT:
        return c
    if c in MAPPED:
        return MAPPED[c]
    at = bisect_right(_FIRSTS, ord(c)) - 1
    if at >= 0 and ord(c) <= IGNORED[at][1]:
        return ""
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", c).casefold())
    return "".join(MAPPED.get(x, x) for x in folded)


def mapped(host: str) -> str:
    return unicodedata.normalize("NFC", "".join(map(_one, host)))


def _is_sound(label: str) -> bool:
    """Whether a label outside ASCII holds only what a host may hold."""
    if unicodedata.normalize("NFC", label) != label or unicodedata.category(label[0])[0] == "M":
        return False
    for k, c in enumerate(label):
        if c in JOINERS:
            if k == 0 or unicodedata.combining(label[k - 1]) != 9:
                return False
        elif c in NEVER or _one(c) != c or (ord(c) > 127 and unicodedata.category(c) in ("Cc", "Cf", "Cn", "Co", "Cs", "Zl", "Zp", "Zs")):
            return False
    return True


def _directions_fit(label: str) -> bool:
    """The rule for labels of a host in which something is written from right to left."""
    kinds = [unicodedata.bidirectional(c) for c in label]
    while kinds and kinds[-1] == "NSM":
        kinds.pop()
    if not kinds:
        return True
    neutral = {"EN", "ES", "CS", "ET", "ON", "BN", "NSM"}
    if kinds[0] == "L":
        return set(kinds) <= neutral | {"L"} and kinds[-1] in ("L", "EN")
    return kinds[0] in ("R", "AL") and set(kinds) <= neutral | {"R", "AL", "AN"} and kinds[-1] in ("R", "AL", "EN", "AN") and not {"EN", "AN"} <= set(kinds)


def _decoded(label: str) -> str | None:
    """A label without its xn--; none if it is not what it would be encoded to."""
    try:
        text = label[4:].encode("ascii").decode("punycode")
    except (UnicodeError, ValueError, OverflowError):
        return None
    return text if text and not text.isascii() and "xn--" + text.encode("punycode").decode() == label else None


def to_ascii(host: str) -> str | None:
    """A host in lower case and ASCII; none if a label is not sound."""
    if host.isascii() and "xn--" not in host.lower():
        return host.lower()
    labels, shown = mapped(host).split("."), []
    for k, label in enumerate(labels):
        text = _decoded(label) if label.startswith("xn--") else label
        if text is None or (not text.isascii() and not _is_sound(text)):
            return None
        shown.append(text)
        labels[k] = label if text.isascii() or label.startswith("xn--") else "xn--" + label.encode("punycode").decode()
    if any(unicodedata.bidirectional(c) in ("R", "AL", "AN") for text in shown for c in text) and not all(map(_directions_fit, filter(None, shown))):
        return None
    return ".".join(labels)


def to_unicode(host: str) -> str:
    """A host in ASCII as it is shown: labels that are Punycode decoded, others as they are."""
    return ".".join((_decoded(label) or label) if label.startswith("xn--") else label for label in host.split("."))
