"""Words as the contracts define them."""

import re
import string

_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def lower(text):
    return (text or "").translate(_LOWER)


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def worded(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
