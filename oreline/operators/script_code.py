"""JavaScript and TypeScript sources as table functions, by an own lexer and a pass over matched brackets.

There is no full grammar here: texts with an unterminated string, template, comment or
regular expression, or with unmatched brackets, are failures; what a grammar alone
would reject passes. Code is read, never run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import RESERVED, is_ambiguous
from .python_code import NOTHING, SCHEMA, dealt

LEX = re.compile(
    r"""(?P<doc>/\*\*(?!/)[\s\S]*?\*/)|(?P<comment>//[^\n\r  ]*|/\*[\s\S]*?\*/)|(?P<space>\s+)|(?P<number>\.?\d(?:[\w.]|(?<=[eE])[+-])*)|(?P<string>"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*')"""
    r"""|(?P<name>[#@]?[A-Za-z_$À-￿][\w$À-￿]*)|(?P<op>=>|\.\.\.|\?\.(?!\d)|\?\?=?|&&=?|\|\|=?|[=!]==?|\*\*=?|[+\-*%&|^<>/]=|\+\+|--|[{}()\[\];,<>+\-*%&|^!~?:=.])"""
)
REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
BEFORE_REGEX = frozenset("( , = : [ ! & | ? { } ; + - * % ^ ~ < > => && || ?? return typeof case in of delete void throw new do else instanceof yield await == === != !== += -= *= ...".split())
PAIRS = {")": "(", "]": "[", "}": "{"}
CONTROL = frozenset("if for while do catch switch".split())
HEADED = frozenset("if for while switch catch with".split())


class Problem(ValueError):
    pass


def lex(text: str) -> tuple[list[tuple[str, str, int, int]], list[tuple[int, int]]]:
    """((kind, text, line, end line) of every token, (token that follows, last line) of every doc comment)."""
    out: list[tuple[str, str, int, int]] = []
    docs: list[tuple[int, int]] = []
    at, line, braces = 0, 1, []
    while at < len(text):
        if text[at] == "`" or text[at] == "}" and braces and braces[-1] == 0:
            if text[at] == "}":
                braces.pop()
            end = at + 1
            while end < len(text) and text[end] != "`" and not text.startswith("${", end):
                end += 2 if text[end] == "\\" else 1
            if end >= len(text):
                raise Problem("template")
            if text[at] == "`":
                out.append(("template", "TEMPLATE", line, line))
            if text.startswith("${", end):
                braces.append(0)
                end += 1
            line += text.count("\n", at, end + 1)
            at = end + 1
            continue
        last = out[-1][1] if out else "("
        if text[at] == "/" and not text.startswith(("//", "/*"), at) and (last in BEFORE_REGEX or not out) and (m := REGEX.match(text, at)):
            out.append(("regex", "STRING", line, line))
            at = m.end()
            continue
        m = LEX.match(text, at) or (text.startswith("/", at) and re.compile("/").match(text, at))
        if not m or text.startswith("/*", at) and m[0] == "/":
            raise Problem("character")
        kind, value = m.lastgroup or "op", m[0]
        end_line = line + value.count("\n")
        if kind == "doc":
            docs.append((len(out), end_line))
        elif kind not in ("comment", "space"):
            if braces and value in "{}":
                braces[-1] += 1 if value == "{" else -1
            out.append((kind, "STRING" if kind == "string" else "NUMBER" if kind == "number" else value, line, end_line))
            if kind == "string":
                out[-1] = (kind, value, line, end_line)
        at, line = m.end(), end_line
    if braces:
        raise Problem("template")
    return out, docs


def match(tokens: list) -> list[int]:
    pair, stack = [-1] * len(tokens), []
    for i, (kind, t, *_) in enumerate(tokens):
        if kind != "op":
            continue
        if t in ("(", "[", "{"):
            stack.append(i)
        elif t in PAIRS:
            if not stack or tokens[stack[-1]][1] != PAIRS[t]:
                raise Problem("bracket")
            pair[i] = stack.pop()
            pair[pair[i]] = i
    if stack:
        raise Problem("bracket")
    return pair


class Script:
    def __init__(self, text: str):
        self.t, self.docs = lex(text)
        self.pair = match(self.t)
        self.functions = self.find_functions()

    def at(self, i: int) -> str:
        return self.t[i][1] if 0 <= i < len(self.t) and self.t[i][0] in ("name", "op") else ""

    def end_of(self, i: int) -> int:
        """The last token of the statement that starts at i."""
        stack = 0
        while i < len(self.t):
            word = self.at(i)
            if word == "{":
                return self.pair[i]
            if word in HEADED and self.at(i + 1) in ("(", "await"):
                close = self.pair[i + 1 + (self.at(i + 1) == "await")]
                end = self.end_of(close + 1)
                if word == "if" and self.at(end + 1) == "else":
                    return self.end_of(end + 2)
                return end
            if word == "do":
                end = self.end_of(i + 1)
                return self.pair[end + 2] if self.at(end + 1) == "while" else end
            break
        start = i
        while i < len(self.t):
            word = self.at(i)
            if word == ";":
                return i
            if word in PAIRS:
                return i - 1
            if i > start and not stack and self.t[i][2] > self.t[i - 1][3] and self.at(i - 1) not in BEFORE_REGEX and word not in (".", "?", ":", "=>", "&&", "||", "??", "+", "-"):
                return i - 1
            i = self.pair[i] + 1 if self.pair[i] > i else i + 1
        return len(self.t) - 1

    def find_functions(self) -> list[tuple[str, int, int, int]]:
        """(name, first token, body's first token, last token)."""
        out = []
        for i, (kind, word, *_) in enumerate(self.t):
            if kind == "name" and word == "function":
                j = i + 1 + (self.at(i + 1) == "*")
                name = self.t[j][1] if self.t[j][0] == "name" else self.given(i)
                j += self.t[j][0] == "name"
                if self.at(j) == "<":
                    j = self.angle(j)
                if self.at(j) == "(" and (body := self.body(self.pair[j] + 1)):
                    out.append((name, i, body, self.pair[body]))
            elif word == "=>" and kind == "op":
                start = self.pair[i - 1] if self.at(i - 1) == ")" else i - 1
                end = self.pair[i + 1] if self.at(i + 1) == "{" else self.expression_end(i + 1)
                out.append((self.given(start - (self.at(start - 1) == "async")), start, i + 1, end))
            elif word == "(" and kind == "op" and i and (self.t[i - 1][0] in ("name", "string") or self.at(i - 1) == "]"):
                name, before = self.t[i - 1][1], self.at(i - 2)
                if name in HEADED and not self.in_class(i - 1) or name in ("function", "super", "return", "typeof", "await", "import") or before in ("function", ".", "new", "?.", "=>", "=", "return") or before == "*" and self.at(i - 3) == "function":
                    continue
                if before not in ("{", "}", ";", ",", "async", "static", "get", "set", "*", "public", "private", "protected", "override", "readonly", "abstract", "]", ")", "") and self.t[i - 1][2] == self.t[i - 2][3]:
                    continue
                body = self.body(self.pair[i] + 1)
                if body and self.holds_methods(i):
                    out.append((name.strip("\"'"), i - 1, body, self.pair[body]))
        return out

    def holds_methods(self, i: int) -> bool:
        """Whether the innermost braces around i are those of a class or an object."""
        while i >= 0 and not (self.at(i) == "{" and self.pair[i] > i):
            i = self.pair[i] - 1 if self.at(i) in PAIRS and self.pair[i] >= 0 else i - 1
        j = i - 1
        if self.at(j) in ("=", "(", ",", ":", "return", "[", "?", "=>", "default"):
            return True
        while j >= 0 and self.at(j) not in ("{", "}", ";", ")", "=>"):
            if self.at(j) == "class":
                return True
            j -= 1
        return False

    def body(self, i: int) -> int | None:
        """The brace of a body, after an optional return type."""
        if self.at(i) == ":":
            i += 1
            while i < len(self.t) and self.at(i) not in ("{", ";", "=>", ")", "}", ","):
                i = self.pair[i] + 1 if self.at(i) in ("(", "[") else i + 1
            if self.at(i) == "{" and self.at(self.pair[i] + 1) in ("{", "|", "&"):
                i = self.pair[i] + 1
        return i if self.at(i) == "{" else None

    def angle(self, i: int) -> int:
        depth = 0
        while i < len(self.t):
            depth += (self.at(i) == "<") - (self.at(i) == ">")
            i += 1
            if not depth:
                break
        return i

    def given(self, i: int) -> str:
        if self.at(i - 1) in ("=", ":") and self.t[i - 2][0] in ("name", "string"):
            return self.t[i - 2][1].strip("\"'")
        return "anonymous"

    def expression_end(self, i: int) -> int:
        while i < len(self.t) and self.at(i) not in (",", ";", ")", "]", "}"):
            if self.pair[i] > i:
                i = self.pair[i]
            elif self.t[i][2] > self.t[i - 1][3] and self.at(i - 1) not in BEFORE_REGEX and self.at(i) not in (".", "?", ":", "&&", "||", "??", "+", "-", "*"):
                break
            i += 1
        return i - 1

    def is_ternary(self, i: int) -> bool:
        return self.at(i) == "?" and self.at(i + 1) not in (":", ")", ",", "=", ";", "(")

    def measure(self, fn: tuple, lines: list[int]) -> tuple:
        name, first, start, end = fn
        inner = sorted((f[1], f[3]) for f in self.functions if f[1] >= start and f[3] <= end and f is not fn and (f[1], f[3]) != (first, end))
        cyclomatic, nesting, handles = 1, 0, False
        open_: list[int] = []
        i = start
        while i <= end:
            open_ = [e for e in open_ if e >= i]
            nested = next((b for a, b in inner if a == i), None)
            if nested is not None:
                nesting = max(nesting, len(open_) + 1)
                i = nested + 1
                continue
            word = self.at(i)
            if self.at(i - 1) in (".", "?.") or self.at(i + 1) == ":" and word not in ("default",) and self.t[i][0] == "name":
                word = ""
            if word in ("if", "for", "catch", "case", "&&", "||", "??") or word == "while" and self.at(i - 1) != "}" or word == "while" and not self.closes_do(i) or self.is_ternary(i):
                cyclomatic += not (word == "while" and self.closes_do(i))
            cyclomatic += word == "do"
            handles |= word in ("try", "throw")
            if word in CONTROL and not (word == "while" and self.closes_do(i)):
                open_.append(self.end_of(i) if word != "catch" else self.end_of(i + 1 if self.at(i + 1) == "{" else self.pair[i + 1] + 1))
                nesting = max(nesting, len(open_))
            elif self.is_ternary(i):
                nesting = max(nesting, len(open_) + 1)
            i += 1
        a, b = self.t[first][2], self.t[end][3]
        return name, a, b, sum(a <= x <= b for x in lines), cyclomatic, nesting, handles

    def closes_do(self, i: int) -> bool:
        if self.at(i - 1) != "}":
            return False
        return self.at(self.pair[i - 1] - 1) == "do"

    def declares(self, i: int, last: int) -> bool:
        """Whether another declarator begins at i, after a comma."""
        if i > last or not (self.t[i][0] == "name" or self.at(i) in ("{", "[")):
            return False
        after = (self.pair[i] if self.pair[i] > i else i) + 1
        return after > last or self.at(after) in ("=", ":", ",", ";", "!")

    def in_class(self, i: int) -> bool:
        """Whether the innermost braces around i are a class's."""
        while i >= 0 and not (self.at(i) == "{" and self.pair[i] > i):
            i = self.pair[i] - 1 if self.at(i) in PAIRS and self.pair[i] >= 0 else i - 1
        j = i - 1
        while j >= 0 and self.at(j) not in ("{", "}", ";", ")", "=>"):
            if self.at(j) == "class":
                return True
            j -= 1
        return False

    def names(self) -> list[str]:
        """Declared names: variables and their patterns, functions, methods, classes, parameters, imports, catch bindings."""
        out = []

        def pattern(a: int, b: int) -> None:
            skip = 0
            braces: list[bool] = []  # whether they are a pattern's; others are a type's or a value's
            for j in range(a, b):
                word = self.at(j)
                renamed = self.at(j - 1) == ":" and self.at(j + 1) in ("}", ",", "=") and bool(braces) and braces[-1]
                if word == "{":
                    braces.append(not skip or self.at(j - 1) == ":" and bool(braces) and braces[-1])
                elif word == "}" and braces:
                    braces.pop()
                elif word in ("=", ":") and not skip:
                    skip = 1
                elif word == ",":
                    skip = 0
                if self.t[j][0] == "name" and word not in RESERVED and (renamed or not skip and self.at(j + 1) != ":" or not skip and not braces and self.at(j + 1) == ":"):
                    out.append(word)

        for i, (kind, word, *_) in enumerate(self.t):
            if kind != "name":
                continue
            if word in ("const", "let", "var"):
                last = self.end_of(i)
                j = i + 1
                while j <= last:  # a declarator each
                    stop = self.pair[j] + 1 if self.pair[j] > j else j + 1
                    pattern(j, stop)
                    j = stop
                    while j <= last and not (self.at(j) == "," and self.declares(j + 1, last)):
                        j = self.pair[j] + 1 if self.pair[j] > j else j + 1
                    j += 1
            elif word in ("function", "class") and i + 1 < len(self.t) and self.t[i + 1][0] == "name" and self.at(i + 1) != "extends":
                out.append(self.at(i + 1))
            elif word == "catch" and self.at(i + 1) == "(":
                pattern(i + 2, self.pair[i + 1])
            elif word == "import" and self.at(i + 1) not in ("(", "."):
                j = i + 1 + (self.at(i + 1) == "type" and self.at(i + 2) not in ("from", "=", ","))
                while j < len(self.t) and self.at(j) not in ("from", "=", ";") and self.t[j][0] != "string":
                    if self.t[j][0] == "name" and self.at(j + 1) != "as" and self.at(j) not in ("as", "type"):
                        out.append(self.at(j))
                    j += 1
        for _, first, start, _ in self.functions:
            if self.t[first][0] == "name" and self.at(first) != "function" and self.at(first + 1) in ("(", "<") and self.at(first - 1) != "function":
                out.append(self.at(first))  # a method's
            j = next((k for k in range(first, start) if self.at(k) == "("), None)
            if j is not None and self.pair[j] > j:
                pattern(j + 1, self.pair[j])
            elif self.t[first][0] == "name" and self.at(first + 1) == "=>":
                out.append(self.at(first))
        return out

    def imports(self) -> list[str]:
        found = set()
        for i, (kind, word, *_) in enumerate(self.t):
            if kind != "name" or self.at(i - 1) == ".":
                continue
            target = None
            if word in ("import", "export") and self.at(i + 1) not in ("(", "type"):
                j = i + 1
                if j < len(self.t) and self.t[j][0] == "string" and word == "import":
                    target = j
                while target is None and j < len(self.t) and self.t[j][2] - self.t[i][2] < 200 and self.at(j) not in (";", "=", "function", "class", "const", "let", "var", "default"):
                    if self.at(j) == "from" and j + 1 < len(self.t) and self.t[j + 1][0] == "string":
                        target = j + 1
                    j += 1
            elif word == "require" and self.at(i + 1) == "(" and self.at(i + 3) == ")" and self.t[i + 2][0] == "string" and not (self.at(i - 1) == "=" and self.at(i - 3) == "type" and self.at(i - 4) == "import"):
                target = i + 2
            if target is not None and (path := self.t[target][1][1:-1]).startswith(("./", "../")):
                found.add(path)
        return sorted(found)

    def exports(self) -> tuple[int, int]:
        """(exported declarations, those with a doc comment right before them)."""
        heads = frozenset("function class const let var interface type enum abstract async namespace declare".split())
        found = documented = 0
        for i, (kind, word, line, _) in enumerate(self.t):
            if kind == "name" and word == "export" and (self.at(i + 1) in heads or self.at(i + 1) == "default" and self.at(i + 2) in heads):
                found += 1
                documented += any(k == i and end < line for k, end in self.docs)
        return found, documented


def analyze(text: str, declaration: bool) -> dict:
    try:
        s = Script(text)
        names, imports = s.names(), s.imports()
        lines = sorted({x for _, _, a, b in s.t for x in range(a, b + 1)})
        functions = [] if declaration else sorted((s.measure(f, lines) for f in s.functions), key=lambda m: (m[1], m[2], m[0]))
        exported, documented = s.exports()
    except (Problem, IndexError, RecursionError) as e:
        return NOTHING | {"parsed": False, "problem": str(e) or type(e).__name__}
    if declaration:
        return NOTHING | {"parsed": True, "imports": imports}
    tokens = ["STRING" if k == "string" else t for k, t, *_ in s.t]
    return NOTHING | {
        "parsed": True, "imports": imports, "logical_lines": len(lines), "tokens": tokens, "functions": functions, "identifiers": len(names), "ambiguous": sum(is_ambiguous(n, RESERVED) for n in names), "exported": exported, "documented": documented,
    }


def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    for b in batches:
        rows = [{"repo_id": r.repo_id, "path": r.path} | analyze(r.text or "", r.path.lower().endswith(".d.ts")) for r in b.itertuples()]
        yield pd.DataFrame(rows, columns=columns)


def analyze_files(texts: DataFrame) -> DataFrame:
    """One row for each JavaScript or TypeScript file of (repo_id, path, text); other files are filtered before any Python runs."""
    own = texts.where(F.lower("path").rlike(r"\.[cm]?[jt]sx?$")).select(F.col("repo_id").cast("string").alias("repo_id"), "path", "text")
    return dealt(own).mapInPandas(_run, SCHEMA)
