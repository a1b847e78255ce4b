"""Ignore files of a folder tree: which paths a walk leaves out."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

IGNORE_FILES = (".gitignore", ".ignore")


def _to_regex(pattern: str) -> str:
    """A glob in which * stays within a name, ** spans folders and [..] is a class."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out.append("(?:[^/]+/)*")
            i += 3
            continue
        if pattern.startswith("**", i) and (i == 0 or pattern[i - 1] == "/"):
            out.append(".*")
            i += 2
            continue
        end = pattern.find("]", i + 2) if c == "[" else -1
        if end > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append(f"[{'^' + body[1:] if body[0] in '!^' else body}]")
            i = end + 1
            continue
        if c == "\\" and i + 1 < len(pattern):
            out.append(re.escape(pattern[i + 1]))
            i += 2
            continue
        out.append("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c))
        i += 1
    return "".join(out)


@dataclass(frozen=True)
class Rule:
    pattern: re.Pattern
    folders_only: bool
    keep: bool


def rules_of(text: str) -> list[Rule]:
    """The rules of an ignore file, in order: of those that match a path, the last decides."""
    out = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        line = line[1:] if keep else line
        folders_only = line.endswith("/")
        body = line.rstrip("/")
        anchored = "/" in body
        body = body.removeprefix("/")
        if body:
            out.append(Rule(re.compile(("" if anchored else "(?:.*/)?") + _to_regex(body)), folders_only, keep))
    return out


def ignored(levels: list[tuple[str, list[Rule]]], path: str, folder: bool) -> bool:
    """levels: (folder below the root, its rules), outermost first; the innermost file with a matching rule decides."""
    for base, rules in reversed(levels):
        inside = path[len(base) + 1 :] if base else path
        for rule in reversed(rules):
            if (folder or not rule.folders_only) and rule.pattern.fullmatch(inside):
                return not rule.keep
    return False


def tree_files(root: str, excludes: set[str]) -> Iterator[str]:
    """Paths below root of its files, hidden ones, excluded folders and ignored paths left out; folders that can't be read are passed
    over. Git's ignore files count inside a repository only."""
    parents, at = [], os.path.abspath(root)
    while at not in parents:
        parents.append(at)
        at = os.path.dirname(at)
    in_git = any(os.path.exists(os.path.join(p, ".git")) for p in parents)
    names = IGNORE_FILES if in_git else IGNORE_FILES[1:]

    def read(path: str) -> list[Rule]:
        try:
            with open(path, encoding="utf-8", errors="replace") as f:
                return rules_of(f.read())
        except OSError:
            return []

    stack = [("", [("", read(os.path.join(root, ".git", "info", "exclude")))])]
    while stack:
        below, levels = stack.pop()
        here = os.path.join(root, below) if below else root
        mine = [(below, read(os.path.join(here, n))) for n in names]
        levels = levels + [x for x in mine if x[1]]
        try:
            entries = sorted(os.scandir(here), key=lambda e: e.name)
        except OSError:
            continue
        for e in entries:
            path = f"{below}/{e.name}" if below else e.name
            folder = e.is_dir(follow_symlinks=False)
            if e.name.startswith(".") or folder and e.name in excludes or ignored(levels, path, folder):
                continue
            if folder:
                stack.append((path, levels))
            elif e.is_file():
                yield path
