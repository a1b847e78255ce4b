"""Search patterns: checked, and rewritten so that Java matches what a linear-time engine with ASCII word bounds matches."""

from __future__ import annotations

import re

# Java's own \b follows Unicode; the engine searched for takes word characters as ASCII.
_BOUND = r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"
_NO_BOUND = r"(?:(?<![0-9A-Za-z_])(?![0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def validate(pattern: str) -> str:
    """Raises ValueError for what a linear-time engine can't do, and for the empty pattern."""
    if not pattern:
        raise ValueError("the pattern is empty")
    i, in_class = 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if i + 1 < len(pattern) and not in_class and (pattern[i + 1].isdigit() and pattern[i + 1] != "0" or pattern[i + 1] == "k"):
                raise ValueError("back-references aren't supported")
            i += 2
            continue
        if c == "[":
            in_class = True
        elif c == "]":
            in_class = False
        elif not in_class and pattern.startswith(("(?=", "(?!", "(?<=", "(?<!"), i):
            raise ValueError("look-around isn't supported")
        i += 1
    try:
        re.compile(re.sub(r"\(\?<([A-Za-z])", r"(?P<\1", pattern).replace(r"\z", r"\Z"))
    except re.error as e:
        raise ValueError(f"not a pattern: {e}") from None
    return pattern


def _bound_at(pattern: str, i: int) -> str:
    """A word bound beside a character that is surely a word character needs to look at one side only, which is several times faster."""
    word = lambda c: c.isascii() and (c.isalnum() or c == "_")
    after, then = pattern[i + 2 : i + 3], pattern[i + 3 : i + 4]
    if after and word(after) and then not in ("?", "*", "{", "|"):
        return "(?<![0-9A-Za-z_])"
    if i > 0 and word(pattern[i - 1]) and (i < 2 or pattern[i - 2] not in "\\") and pattern[i + 2 : i + 3] not in ("?", "*", "{"):
        return "(?![0-9A-Za-z_])"
    return _BOUND


def to_java(pattern: str, ignore_case: bool = False) -> str:
    validate(pattern)
    multiline = bool(re.match(r"\(\?[a-z]*m", pattern))
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            pair = pattern[i : i + 2]
            if pair == r"\b" and not in_class:
                out.append(_bound_at(pattern, i))
            else:
                out.append(_NO_BOUND if pair == r"\B" and not in_class else pair)
            i += 2
            continue
        if c == "[":
            in_class = True
        elif c == "]":
            in_class = False
        out.append(r"\z" if c == "$" and not in_class and not multiline else c)
        i += 1
    # d: only \n ends a line
    return "(?d)" + ("(?i)" if ignore_case else "") + "".join(out)


def line_local(java: str) -> bool:
    """True where every match surely lies within one line and needs no look at where texts begin and end, so that lines can be matched
    one by one. Anything that may match a line end, and every anchor, says no."""
    if re.search(r"\(\?[a-z]*s[a-z]*[):]", java):
        return False
    i, in_class = 0, False
    while i < len(java):
        c = java[i]
        if c == "\\":
            if java[i + 1 : i + 2] in tuple("sSDWHVNRXAzZGnrxuc0pPQvhk") and java[i + 1 : i + 2] != "S":
                return False
            i += 2
            continue
        if c == "[":
            if java[i + 1 : i + 2] == "^":
                return False
            in_class = True
        elif c == "]":
            in_class = False
        elif c == "\n" or not in_class and c in "^$":
            return False
        elif in_class and java[i + 1 : i + 2] == "-" and c < "\n" <= java[i + 2 : i + 3]:
            return False
        i += 1
    return True


def search_pattern(pattern: str, fixed: bool = False, word: bool = False) -> str:
    """The regular expression of a search: fixed strings are escaped first, whole words bounded next (as one group)."""
    if not pattern:
        raise ValueError("the pattern is empty")
    p = re.sub(r"([\\.+*?()|\[\]{}^$#&~-])", r"\\\1", pattern) if fixed else pattern
    return (rf"\b(?:{p})\b" if "|" in p else rf"\b{p}\b") if word else p


def is_plain_word(pattern: str) -> bool:
    """Alphanumerics, _ and - only: such a pattern may be expanded by related terms."""
    return bool(pattern) and all(c.isalnum() or c in "_-" for c in pattern)


def leading_flags(pattern: str) -> tuple[str, bool | None]:
    """The pattern without flags at its start, and whether they ignore case; None for flags that change more than case, lines or dots."""
    m = re.match(r"\(\?([a-zA-Z]+)\)", pattern)
    if not m:
        return pattern, False
    return pattern[m.end() :], ("i" in m[1]) if set(m[1]) <= set("ims") else None


def literals(pattern: str, most: int = 256, in_class: int = 10) -> list[str] | None:
    """Strings of which each match of the pattern contains one, or None where no useful set exists.

    The longest mandatory run of each alternative is taken; alternatives multiply out as far as `most`.
    """
    import re._parser as parser
    from re import _constants as op

    # flags inside, sets of sets and \p classes are read otherwise by this parser
    if re.search(r"(?<!\\)\(\?[a-zA-Z-]*[a-zA-Z][a-zA-Z-]*[):]|\[[^\]]*(?:\[|&&)", pattern):
        return None
    try:
        tree = parser.parse(re.sub(r"\\(.)", lambda m: r"\Z" if m[1] == "z" else m[0], pattern))
    except re.error:
        return None

    def best(sets: list[list[str] | None]) -> list[str] | None:
        found = [s for s in sets if s]
        return max(found, key=lambda s: (min(map(len, s)), -len(s))) if found else None

    def exact(items) -> list[str] | None:
        """All strings the items match, where they are few."""
        out = [""]
        for kind, value in items:
            more: list[str] | None
            if kind is op.LITERAL:
                more = [chr(value)]
            elif kind is op.IN and len(value) <= in_class and all(k is op.LITERAL for k, _ in value):
                more = [chr(v) for _, v in value]
            elif kind is op.SUBPATTERN:
                more = exact(value[3])
            elif kind is op.BRANCH:
                parts = [exact(b) for b in value[1]]
                more = None if any(p is None for p in parts) else [x for p in parts for x in p]
            else:
                more = None
            if more is None or len(out) * len(more) > most:
                return None
            out = [a + b for a in out for b in more]
        return out

    def need(items) -> list[str] | None:
        sets: list[list[str] | None] = []
        run: list = []

        def end() -> None:
            if run:
                sets.append(exact(list(run)))
                run.clear()

        for kind, value in items:
            if exact([(kind, value)]) is not None:
                run.append((kind, value))
                if exact(run) is None:
                    last = run.pop()
                    end()
                    run.append(last)
                continue
            end()
            if kind is op.SUBPATTERN:
                sets.append(need(value[3]))
            elif kind is op.BRANCH:
                parts = [need(b) for b in value[1]]
                sets.append(None if any(p is None for p in parts) else [x for p in parts for x in p])
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] >= 1:
                sets.append(need(value[2]))
        end()
        return best([s if s and all(s) else None for s in sets])

    found = need(tree)
    return sorted(set(found)) if found and len(found) <= most else None
