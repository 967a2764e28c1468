"""Rules for secrets in texts, and their matches where a text is in Python already."""

from __future__ import annotations

import re

#: Our own rules for secrets in public formats: type, severity, pattern for both Java and RE2.
SECRET_RULES = (
    ("Hardcoded Password", "Critical", r"(?i)(?:password|passwd|pwd)[ \t]*=[ \t]*[\"'][^\"'\n]+[\"']"),
    ("OpenAI API Key", "Critical", r"sk-[A-Za-z0-9_-]{20,}"),
    ("AWS Access Key", "Critical", r"AKIA[0-9A-Z]{16}"),
    ("GitHub Token", "Critical", r"gh[pousr]_[A-Za-z0-9]{36}"),
    ("MongoDB URL", "Critical", r"mongodb(?:\+srv)?://[^ \t\n\"']+"),
    ("Database URL", "High", r"(?:postgres|postgresql|mysql|redis)://[^ \t\n\"':/@]+:[^ \t\n\"'@]+@[^ \t\n\"']+"),
    ("Private Key", "Critical", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("Hardcoded Token", "High", r"(?i)(?:token|api_key|apikey|secret)[ \t]*=[ \t]*[\"'][^\"'\n]{8,}[\"']"),
)
#: Lower-case words, one of which stands in the lower-cased text of whatever a rule matches.
SIGNS = {
    "Hardcoded Password": ("password", "passwd", "pwd"), "OpenAI API Key": ("sk-",), "AWS Access Key": ("akia",), "GitHub Token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "MongoDB URL": ("mongodb",), "Database URL": ("://",), "Private Key": ("private key-----",), "Hardcoded Token": ("token", "api_key", "apikey", "secret"),
}
# As in Java, letters are the same in either case only within A-Z.
_COMPILED = [(k, t, SIGNS[t], re.compile(p, re.A)) for k, (t, _, p) in enumerate(SECRET_RULES)]


def matches(text: str) -> list[tuple[int, str, int]]:
    """(place, type, number of matches) of the rules that a text matches."""
    low, out = text.lower(), []
    for k, kind, signs, pattern in _COMPILED:
        for x in signs:
            if x in low:
                if n := len(pattern.findall(text)):
                    out.append((k, kind, n))
                break
    return out


#: What was found in parts of texts up to a length, and in how many.
_LONGEST, _MOST = 4096, 20_000
_found: dict[str, list[tuple[int, str, int]]] = {}


def matches_by_lines(head: str, *parts: str) -> list[tuple[int, str, int]]:
    """The same of a text that was cut at ends of lines, which no match goes beyond. Parts after the first
    are remembered, as many texts share them."""
    out = matches(head)
    for part in parts:
        if not part:
            continue
        got = _found.get(part)
        if got is None:
            got = matches(part)
            if len(part) <= _LONGEST:
                if len(_found) >= _MOST:
                    _found.clear()
                _found[part] = got
        if got:
            out = out + got
    if len(out) < 2:
        return out
    numbers: dict[tuple[int, str], int] = {}
    for k, kind, n in out:
        numbers[k, kind] = numbers.get((k, kind), 0) + n
    return [(k, kind, n) for (k, kind), n in sorted(numbers.items())]
