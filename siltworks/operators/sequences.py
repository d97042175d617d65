"""Rewrites that follow the lines of one file: text in, text out.

A file is one value, so none of these needs a shuffle or a group: each is an Arrow function over the column of
contents, to be used like any other column expression. What they share is that lines are read in order with a little
state, which no built-in expression has. Lines end at \\n, \\r\\n or \\r and are joined by \\n again.

Null contents stay null; empty ones are one empty line.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from siltworks.functions import fixed

NO_STATIC = "// JADX FIX: Static initializer not allowed in interface"
ORPHANED = "// ORPHANED:"
CALL_REMOVED = "// JADX FIX: Incomplete method call removed"
ARRAY_ADDED = "// JADX FIX: Added missing array declaration"
STUB_NOTES = ("// TODO: Decompilation failed - method body could not be restored", "// Original method contained invalid bytecode patterns (R8 optimization)")
#: Declarations at which commented code ends, on a trimmed line. Fixed values.
MEMBERS = tuple(map(re.compile, (
    r"(public|private|protected)\s+(static\s+)?(final\s+)?(synchronized\s+)?(native\s+)?[\w<>\[\],\s]+\s+\w+\s*\([^)]*\)\s*(throws\s+[\w,\s]+)?\s*\{.*",
    r"(public|private|protected)\s+\w+\s*\([^)]*\)\s*\{.*",
    r"(public|private|protected)?\s*(static)?\s*(final)?\s*(class|interface|enum)\s+.*",
)))
INTERFACE = re.compile(r"(public\s+)?interface\s+\w+.*\{.*")
STATIC_BLOCK = re.compile(r"static\s*\{.*")
OPEN_CALL = re.compile(r"\w\s*\($")
DECLARED = re.compile(r"(?:int|long|short|byte|float|double|char|boolean|String|Object)(?:\s*\[\s*\]\s*|\s+)(\w+)\s*=")
ARRAY_USE = re.compile(r"(\w+)\s*\[\s*\w+\s*\]\s*=")
ARRAY_SIZE = re.compile(r"new\s+int\s*\[\s*([^\]]+)\s*\]")
DECLARATION = re.compile(fixed.METHOD_DECLARATION)
INVALID = tuple(map(re.compile, fixed.INVALID))
LITERALS = re.compile(r""""(?:\\.|[^"\\])*(?:"|\\?$)|'(?:\\.|[^'\\])*(?:'|\\?$)""")
MODIFIERS = re.compile(r"(?:public|private|protected|static|final|synchronized|native|abstract)\s+")
RETURNED = re.compile(r"([\w<>\[\],\s]+)\s+\w+\s*\(")
#: What a stubbed method returns. Fixed values.
DEFAULTS = {"void": "", "boolean": "return false;", **dict.fromkeys(("int", "long", "short", "byte", "char"), "return 0;"), **dict.fromkeys(("float", "double"), "return 0.0;")}
#: Lines that a call's marker and a method's end are looked for, after the first.
CALL_REACH, METHOD_REACH = 99, 501


def split_lines(text: str) -> list[str]:
    return re.split("\r\n|\n|\r", text)


def indent(line: str) -> str:
    return line[: len(line) - len(line.lstrip())]


def net(code: str) -> int:
    """Opening minus closing braces."""
    return code.count("{") - code.count("}")


def has_interface(text: str) -> bool:
    return "public interface " in text or "\ninterface " in text


def unreachable(text: str) -> str:
    """Marks what follows a return or throw statement, up to the end of its block or the next branch."""
    out, dead = [], False
    for line in split_lines(text):
        t = line.strip()
        if dead and t.startswith(("}", "else", "case ", "default:", "catch", "finally")):
            dead = False
        mark = dead and t and not t.startswith("//")
        # A marked line is a comment from then on, so it can't end the flow itself.
        dead = dead or (t.startswith(("return ", "return;", "throw ")) and t.endswith(";"))
        out.append(f"// UNREACHABLE: {line}" if mark else line)
    return "\n".join(out)


def interface_static_blocks(text: str) -> str:
    """Comments static initialisers inside interfaces.

    The braces of a commented block aren't counted for the interface around it, but those of its first line are.
    """
    if not has_interface(text):
        return text
    out, inside, depth, block = [], False, 0, None
    for line in split_lines(text):
        t = line.strip()
        if block is not None:
            out.append(f"{indent(line)}// {t}")
            block += net(t)
        else:
            if INTERFACE.fullmatch(t):
                inside, depth = True, net(t[t.index("{") :])
            elif inside:
                depth += net(t)
                inside = depth > 0
            if inside and STATIC_BLOCK.fullmatch(t):
                block = net(t[t.index("{") :])
                line = indent(line) + NO_STATIC
            out.append(line)
        if block is not None and block <= 0:
            block = None
    return "\n".join(out)


class _Depth:
    """Braces of code that is being commented, and how many anonymous classes it is in."""

    def __init__(self) -> None:
        self.braces = self.anonymous = 0

    def enter(self, code: str) -> None:
        if "new " in code and "()" in code and "{" in code:
            self.anonymous += 1

    def read(self, code: str) -> None:
        for c in re.findall("[{}]", code):
            self.braces += 1 if c == "{" else -1
            if c == "}" and 0 < self.anonymous > self.braces:
                self.anonymous -= 1

    def at_class_level(self) -> bool:
        return self.anonymous == 0 and self.braces <= 0


def orphaned_code(text: str) -> str:
    """Comments the code that a commented static initialiser left behind, up to the next member of the class."""
    lines, changed, depth = split_lines(text), False, None
    for at, line in enumerate(lines):
        t = line.strip()
        if depth is None:
            depth = _Depth() if t.startswith("// JADX FIX: Static initializer") else None
        elif t.startswith("//"):
            if t.startswith(ORPHANED):
                code = t[len(ORPHANED) :].strip()
                depth.enter(code)
                depth.read(code)
        elif t:
            depth.enter(t)
            if t.startswith("/* JADX") or (depth.at_class_level() and any(m.fullmatch(t) for m in MEMBERS)):
                depth = None
                continue
            depth.read(t)
            lines[at], changed = f"{indent(line)}{ORPHANED} {t}", True
            if t == "}" and depth.braces < 0 and depth.anonymous == 0:
                depth = None
    return "\n".join(lines) if changed else text


def _thrown_after(lines: list[str], start: int) -> int | None:
    """The line at which a decompiler's marker after `start` is followed by its throw statement."""
    marked = False
    for at, line in enumerate(lines[start + 1 : start + 1 + CALL_REACH], start + 1):
        t = line.strip()
        marked = marked or "JADX ERROR:" in t or "JADX WARN:" in t
        if marked and t.startswith("throw new UnsupportedOperationException"):
            return at
        if not marked and t.startswith("*/"):
            return None
    return None


def incomplete_calls(text: str) -> str:
    """Comments a call without arguments or end, and what follows up to the throw statement that took its place."""
    lines, done = split_lines(text), -1
    for at in range(len(lines) - 1):
        if at > done and OPEN_CALL.search(lines[at].strip()) and (end := _thrown_after(lines, at)):
            lines[at] = indent(lines[at]) + CALL_REMOVED
            for k in range(at + 1, end):
                t = lines[k].strip()
                if t and not t.startswith("//"):
                    lines[k] = f"{indent(lines[k])}// {t}"
            done = end
    return "\n".join(lines)


def undeclared_arrays(text: str) -> str:
    """Declares arrays that are assigned to but nowhere declared, before their first use.

    A commented declaration before that gives the size, else it is 256.
    """
    lines = split_lines(text)
    declared = {name for line in lines for name in DECLARED.findall(line)}
    first: dict[str, int] = {}
    for at, line in enumerate(lines):
        for name in ARRAY_USE.findall(line):
            if name not in declared:
                first.setdefault(name, at)
    if not first:
        return text
    added: dict[int, list[str]] = {}
    for name, at in first.items():
        comment = next((x for x in reversed(lines[:at]) if "// " in x and name in x and "new int[" in x), None)
        size = ARRAY_SIZE.search(comment) if comment else None
        n = re.sub(r"\([^)]+\)\.length\(\)", "256", size.group(1)) if size else "256"
        added.setdefault(at, []).extend([indent(lines[at]) + ARRAY_ADDED, f"{indent(lines[at])}int[] {name} = new int[{n}];"])
    return "\n".join(x for at, line in enumerate(lines) for x in (*added.get(at, ()), line))


def is_method(trimmed: str) -> bool:
    """Whether a trimmed line declares a method."""
    return not trimmed.startswith(fixed.TYPE_WORDS) and not any(f" {w}" in trimmed for w in fixed.TYPE_WORDS) and bool(DECLARATION.search(trimmed))


def method_end(lines: list[str], start: int) -> int | None:
    """The first line at which the braces opened at `start` are closed; strings end with their line, comments count."""
    depth = 0
    for at, line in enumerate(lines[start : start + METHOD_REACH + 1], start):
        depth += net(LITERALS.sub("", line))
        if depth == 0:
            return at
    return None


def is_invalid(text: str) -> bool:
    return any(p.search(text) for p in INVALID) or any(x in text for x in fixed.INVALID_SHOWN)


def stub(declaration: str) -> list[str]:
    """A method with the given first line that only returns a default."""
    kind = RETURNED.search(MODIFIERS.sub("", declaration).strip())
    back = DEFAULTS.get(kind.group(1).strip() if kind else "void", "return null;")
    return [declaration.split("{")[0].rstrip() + " {", *[f"{indent(declaration)}    {x}" for x in (*STUB_NOTES, back) if x], f"{indent(declaration)}}}"]


def stub_methods(text: str) -> str:
    """Replaces the bodies of methods that hold invalid code; a method on one line stays."""
    if not is_invalid(text):
        return text
    lines, changed, at = split_lines(text), False, 0
    while at < len(lines):
        end = method_end(lines, at) if is_method(lines[at].strip()) else None
        if end is not None and end > at and is_invalid("\n".join(lines[at : end + 1])):
            lines[at : end + 1] = stub(lines[at])
            changed, at = True, at + 3
        else:
            at += 1
    return "\n".join(lines) if changed else text


def column(f: Callable[[str], str], content: Column) -> Column:
    """f over a column of whole files.

    It is declared as if its result could differ from call to call, so that the optimizer keeps what follows apart:
    else a filter on the result of several passes is moved below them with all their expressions written into it.
    """

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else f(t))

    return run.asNondeterministic()(content)
