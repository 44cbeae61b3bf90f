"""Display order of mixed right-to-left and left-to-right lines: the Unicode bidirectional algorithm for one level of text.

The paragraph's direction is that of its first strong character; weak characters (numbers and their signs) and neutral ones
(spaces, punctuation, pairs of brackets) take theirs from what stands beside them; each character gets a level, and stretches
of a level or higher are turned around, the highest first. Explicit embeddings and isolates are not followed: their marks are
passed over like other characters without a direction. Turning a line in display order this way gives its reading order.
"""

from __future__ import annotations

import unicodedata

# Pairs of brackets, and characters that a right-to-left stretch shows mirrored.
BRACKETS = {"(": ")", "[": "]", "{": "}"}
MIRRORED = dict(zip("()[]{}<>«»", ")(][}{><»«", strict=True))
NEUTRAL = frozenset(["B", "S", "WS", "ON"])
SIGNS = frozenset(["ES", "ET", "CS"])


def _weak(kinds: list[str], base: str) -> list[str]:
    """Numbers and what belongs to them."""
    k = kinds[:]
    n = len(k)
    last, strong = base, base
    for i in range(n):
        if k[i] in ("NSM", "BN"):  # a mark goes with the character before it
            k[i] = last
        last = k[i]
        if k[i] in ("L", "R", "AL"):
            strong = k[i]
        elif k[i] == "EN" and strong == "AL":
            k[i] = "AN"
    k = ["R" if x == "AL" else x for x in k]
    for i in range(1, n - 1):  # one separator between two numbers of a kind
        if k[i - 1] == k[i + 1] and (k[i] == "CS" and k[i - 1] in ("EN", "AN") or k[i] == "ES" and k[i - 1] == "EN"):
            k[i] = k[i - 1]
    for order in (range(n), range(n - 1, -1, -1)):  # terminators beside a number
        before = ""
        for i in order:
            if k[i] == "ET" and before == "EN":
                k[i] = "EN"
            before = k[i]
    strong = base
    for i in range(n):
        if k[i] in SIGNS:
            k[i] = "ON"
        elif k[i] in ("L", "R"):
            strong = k[i]
        elif k[i] == "EN" and strong == "L":
            k[i] = "L"
    return k


def _pairs(line: str, kinds: list[str]) -> list[tuple[int, int]]:
    """Places of brackets that open and close each other."""
    out, open_at = [], []
    for i, c in enumerate(line):
        if kinds[i] != "ON":
            continue
        if c in BRACKETS:
            open_at.append(i)
        elif c in BRACKETS.values():
            for j in range(len(open_at) - 1, -1, -1):
                if BRACKETS[line[open_at[j]]] == c:
                    out.append((open_at[j], i))
                    del open_at[j:]
                    break
    return sorted(out)


def _side(kind: str) -> str:
    return "R" if kind in ("R", "EN", "AN") else kind


def _neutral(line: str, kinds: list[str], base: str) -> list[str]:
    """Brackets by what they hold and follow; other neutral stretches by both their sides, else the paragraph's way."""
    k = kinds[:]
    for i, j in _pairs(line, k):
        inside = {_side(x) for x in k[i + 1 : j]} & {"L", "R"}
        if base in inside:
            k[i] = k[j] = base
        elif inside:
            before = next((_side(x) for x in reversed(k[:i]) if _side(x) in ("L", "R")), base)
            k[i] = k[j] = before
    i = 0
    while i < len(k):
        if k[i] not in NEUTRAL:
            i += 1
            continue
        j = i
        while j < len(k) and k[j] in NEUTRAL:
            j += 1
        left, right = _side(k[i - 1]) if i else base, _side(k[j]) if j < len(k) else base
        k[i:j] = [left if left == right else base] * (j - i)
        i = j
    return k


def levels(line: str) -> list[int]:
    """Level of each character of one line: even is left-to-right."""
    kinds = [unicodedata.bidirectional(c) or "L" for c in line]
    base = next(("L" if x == "L" else "R" for x in kinds if x in ("L", "R", "AL")), "L")
    low = int(base == "R")
    k = _neutral(line, _weak(kinds, base), base)
    out = [low + (x != "R") if low else {"L": 0, "R": 1}.get(x, 2) for x in k]
    trailing = True  # white space at the end and before separators stays the paragraph's
    for i in range(len(line) - 1, -1, -1):
        if kinds[i] in ("B", "S"):
            out[i], trailing = low, True
        elif kinds[i] in ("WS", "BN") and trailing:
            out[i] = low
        else:
            trailing = False
    return out


def turned(line: str) -> str:
    """One line with its stretches turned around; a line with nothing right-to-left stays as it is."""
    if line.isascii():
        return line
    at = levels(line)
    if not any(at):
        return line
    chars = [MIRRORED.get(c, c) if v % 2 else c for c, v in zip(line, at, strict=True)]
    for v in range(max(at), 0, -1):
        i = 0
        while i < len(at):
            j = i
            while j < len(at) and at[j] >= v:
                j += 1
            if j > i:
                chars[i:j], at[i:j] = chars[i:j][::-1], at[i:j][::-1]
            i = max(j, i + 1)
    return "".join(chars)
