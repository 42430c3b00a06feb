"""Patterns and templates written for POSIX tools, as Java and Python take them."""

from __future__ import annotations

import re

#: fixed values: POSIX classes and their Java names
POSIX = {"alnum": "Alnum", "alpha": "Alpha", "blank": "Blank", "cntrl": "Cntrl", "digit": "Digit", "graph": "Graph", "lower": "Lower", "print": "Print", "punct": "Punct", "space": "Space", "upper": "Upper", "xdigit": "XDigit"}
#: fixed values: the same as sets for Python
SETS = {"alnum": "0-9A-Za-z", "alpha": "A-Za-z", "blank": " \\t", "cntrl": "\\x00-\\x1f\\x7f", "digit": "0-9", "graph": "!-~", "lower": "a-z", "print": " -~", "punct": "!-/:-@\\[-`{-~", "space": "\\s", "upper": "A-Z", "xdigit": "0-9A-Fa-f"}


def java_pattern(pattern: str, python: bool = False) -> str:
    """POSIX bracket classes translated; the rest is common to both. ValueError if it isn't a pattern."""

    def named(m: re.Match) -> str:
        if m[1] not in POSIX:
            raise ValueError(f"unknown character class {m[0]}")
        return SETS[m[1]] if python else rf"\p{{{POSIX[m[1]]}}}"

    out = re.sub(r"\[:(\w+):\]", named, pattern)
    try:
        re.compile(re.sub(r"\[:(\w+):\]", lambda m: SETS[m[1]], pattern))
    except re.error as e:
        raise ValueError(f"not a pattern: {pattern}: {e}") from None
    return out


def anchored_to_rest(pattern: str) -> str:
    """``^`` stands for the end of the match before, where the rest of a line begins that is still to be split; in brackets and after a backslash it keeps its meaning."""
    parts = re.findall(r"\\.|\[\^?\]?(?:\[:\w+:\]|\\.|[^\]\\])*\]|.", pattern, re.S)
    return "".join(r"\G" if p == "^" else p for p in parts)


def quote_replacement(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", "\\$")


def parse_template(template: str) -> list[str | int]:
    """Literals and group numbers. ``$`` without digits is group 0, the whole line, as any text after it is literal."""
    out: list[str | int] = []
    for literal, number in re.findall(r"([^$]+)|\$(\d*)", template):
        if literal:
            out.append(literal)
        else:
            group = int(number or 0)
            if group > 99:
                raise ValueError("a template has groups 0 to 99")
            out.append(group)
    return out


def replaces_at_once(search: str, replacement: str) -> bool:
    """Whether replacing all matches at once equals replacing the first again and again: one class of characters, none of them in the replacement."""
    return bool(re.fullmatch(r"\[[^\[\]\\^]+\]\+?", search)) and not re.search(search, replacement)
