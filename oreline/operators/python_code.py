"""Python sources as table functions: file metrics, functions, imports, tokens, from the standard parser.

Code is parsed, never run. Each text goes through one Arrow batch; a file that doesn't
parse is a failure row and affects nothing else.
"""

from __future__ import annotations

import ast
import io
import token as tk
import tokenize
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import is_ambiguous

SCHEMA = (
    "repo_id string, path string, parsed boolean, problem string, logical_lines long, tokens array<string>, imports array<string>, candidates array<string>, defined array<string>, identifiers long, ambiguous long, exported long, documented long, "
    "functions array<struct<name:string,start_line:int,end_line:int,logical_lines:long,cyclomatic:long,max_nesting:long,has_error_handling:boolean>>"
)
NESTED = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.IfExp, ast.Match)
LOOPS = (ast.For, ast.AsyncFor, ast.While, ast.IfExp)
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def tokens_of(text: str) -> tuple[list[str], set[int]]:
    """(normalised tokens, lines with code). Strings, f-strings and numbers become placeholders; an f-string's expressions follow it."""
    out, lines, depth = [], set(), 0
    for t in tokenize.generate_tokens(io.StringIO(text).readline):
        if t.type in (tk.COMMENT, tk.NL, tk.ENCODING, tk.ENDMARKER):
            continue
        if t.type in (tk.NEWLINE, tk.INDENT, tk.DEDENT):
            continue
        lines.update(range(t.start[0], t.end[0] + 1))
        if t.type == tk.FSTRING_START:
            out.append("TEMPLATE")
            depth += 1
        elif t.type == tk.FSTRING_END:
            depth -= 1
        elif t.type == tk.FSTRING_MIDDLE or depth and t.string in "{}!" and t.type == tk.OP:
            continue
        else:
            out.append("STRING" if t.type == tk.STRING else "NUMBER" if t.type == tk.NUMBER else t.string)
    return out, lines


def branches(node: ast.AST) -> int:
    if isinstance(node, (ast.If, *LOOPS)):
        return 1
    if isinstance(node, (ast.Try, ast.TryStar)):
        return len(node.handlers)
    if isinstance(node, ast.BoolOp):
        return len(node.values) - 1
    if isinstance(node, ast.match_case):
        plain = isinstance(node.pattern, ast.MatchAs) and node.pattern.pattern is None and node.pattern.name is None
        return 0 if plain and node.guard is None else 1
    return 0


def measure(fn: ast.AST, lines: list[int]) -> tuple:
    """Metrics of one function; what is nested in it counts by its depth only, lambdas not at all."""
    cyclomatic, nesting, handles = 1, 0, False
    todo = [(child, 0) for child in ast.iter_child_nodes(fn)]
    while todo:
        node, depth = todo.pop()
        if isinstance(node, FUNCTIONS):
            nesting = max(nesting, depth + 1)
            continue
        if isinstance(node, ast.Lambda):
            continue
        cyclomatic += branches(node)
        handles |= isinstance(node, (ast.Try, ast.TryStar, ast.Raise))
        if isinstance(node, ast.If) and len(node.orelse) == 1 and isinstance(node.orelse[0], ast.If) and node.orelse[0].col_offset == node.col_offset:
            nesting = max(nesting, depth + 1)  # an elif stands beside its if
            todo += [(c, depth + 1) for c in [node.test, *node.body]] + [(node.orelse[0], depth)]
            continue
        inner = depth + isinstance(node, (*NESTED, ast.ExceptHandler))
        nesting = max(nesting, inner)
        todo += [(c, inner) for c in ast.iter_child_nodes(node)]
    start, end = fn.lineno, fn.end_lineno
    return fn.name, start, end, sum(start <= x <= end for x in lines), cyclomatic, nesting, handles


def documented(node: ast.AST) -> bool:
    first = node.body[0] if node.body else None
    return isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str)


class Bindings(ast.NodeVisitor):
    """Declared names: functions, classes, parameters and imports anywhere, comprehension targets anywhere, other targets inside functions and lambdas only.

    A function's own global and nonlocal names aren't its names; those of classes,
    lambdas and functions inside it are another matter. What stands in a signature
    belongs to the scope around it.
    """

    def __init__(self) -> None:
        self.names: list[str] = []
        self.scopes: list[set[str] | None] = [None]  # names that aren't local; None where nothing is

    def add(self, name: str) -> None:
        if self.scopes[-1] is not None and name not in self.scopes[-1]:
            self.names.append(name)

    def _signature(self, a: ast.arguments) -> None:
        own = (*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg)))
        self.names += [x.arg for x in own]
        for part in (*(x.annotation for x in own), *a.defaults, *a.kw_defaults):
            if part is not None:
                self.visit(part)

    def _inside(self, scope: set[str] | None, nodes: list) -> None:
        self.scopes.append(scope)
        for n in nodes:
            self.visit(n)
        self.scopes.pop()

    def visit_FunctionDef(self, node) -> None:
        self.names.append(node.name)
        for part in (*node.decorator_list, *filter(None, (node.returns,))):
            self.visit(part)
        self._signature(node.args)
        own, todo = set(), list(node.body)
        while todo:
            s = todo.pop()
            if isinstance(s, (ast.Global, ast.Nonlocal)):
                own.update(s.names)
            elif not isinstance(s, (*FUNCTIONS, ast.ClassDef, ast.Lambda)):
                todo += ast.iter_child_nodes(s)
        self._inside(own, node.body)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Lambda(self, node) -> None:
        self._signature(node.args)
        self._inside(set(), [node.body])

    def visit_ClassDef(self, node) -> None:
        self.names.append(node.name)
        for part in (*node.decorator_list, *node.bases, *node.keywords):
            self.visit(part)
        self._inside(None, node.body)

    def visit_Name(self, node) -> None:
        if isinstance(node.ctx, ast.Store):
            self.add(node.id)

    def visit_AugAssign(self, node) -> None:
        self.visit(node.value)

    def visit_TypeAlias(self, node) -> None:
        pass

    def visit_comprehension(self, node) -> None:
        self.names += [n.id for n in ast.walk(node.target) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)]
        for part in (node.iter, *node.ifs):
            self.visit(part)

    def visit_MatchAs(self, node) -> None:
        if node.pattern is None and node.name:
            self.add(node.name)
        self.generic_visit(node)

    def visit_MatchStar(self, node) -> None:
        if node.name:
            self.add(node.name)

    def visit_MatchMapping(self, node) -> None:
        if node.rest:
            self.add(node.rest)
        self.generic_visit(node)

    def visit_ExceptHandler(self, node) -> None:
        if node.name:
            self.add(node.name)
        self.generic_visit(node)

    def visit_Import(self, node) -> None:
        self.names += [(a.asname or a.name.split(".")[0]) for a in node.names if a.name != "*"]

    visit_ImportFrom = visit_Import


class Flow:
    """Names that are bound on every way through the top level of a module; joins are intersections, a way that ends is None.

    In a package's own file a bare-dot import of a name doesn't bind that name; where
    the name is bound already, the import finds it and is no import of a submodule:
    such (statement, name) pairs are in `found`.
    """

    def __init__(self, package: bool) -> None:
        self.package = package
        self.found: set[tuple[int, str]] = set()
        self.left: list[list[set[str] | None]] = []

    @staticmethod
    def meet(ways) -> set[str] | None:
        open_ = [w for w in ways if w is not None]
        return set.intersection(*open_) if open_ else None

    @staticmethod
    def bound(node: ast.AST) -> set[str]:
        """Names that an expression or target binds; scopes of their own are left out."""
        names, todo = set(), [node]
        while todo:
            n = todo.pop()
            if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store):
                names.add(n.id)
            if isinstance(n, (ast.MatchAs, ast.MatchStar)) and n.name:
                names.add(n.name)
            if isinstance(n, ast.MatchMapping) and n.rest:
                names.add(n.rest)
            if not isinstance(n, (ast.Lambda, ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)):
                todo += ast.iter_child_nodes(n)
        return names

    def body(self, statements: list[ast.stmt], have: set[str] | None, points: list | None = None) -> set[str] | None:
        for s in statements:
            if have is None:
                break
            have = self.step(s, have)
            if points is not None and have is not None:
                points.append(have)
        return have

    def loop(self, s, have: set[str], first: set[str], endless: bool) -> set[str] | None:
        self.left.append([])
        once = self.body(s.body, first)
        none = None if endless else self.body(s.orelse, self.meet([have, once]) if once is not None else set(have))
        return self.meet([none, *self.left.pop()])

    def step(self, s: ast.stmt, have: set[str]) -> set[str] | None:
        if isinstance(s, (*FUNCTIONS, ast.ClassDef)):
            return have | {s.name}
        if isinstance(s, (ast.Import, ast.ImportFrom)):
            own = self.package and isinstance(s, ast.ImportFrom) and s.level == 1 and not s.module
            if own:
                self.found |= {(id(s), a.name) for a in s.names if a.name in have}
            return have | {a.asname or a.name.split(".")[0] for a in s.names if a.name != "*" and not (own and a.asname in (None, a.name))}
        if isinstance(s, ast.Delete):
            return have - {t.id for t in s.targets if isinstance(t, ast.Name)}
        if isinstance(s, ast.AnnAssign) and s.value is None:
            return have
        if isinstance(s, (ast.Return, ast.Raise)):
            return None
        if isinstance(s, (ast.Break, ast.Continue)):
            if self.left:
                self.left[-1].append(have)
            return None
        if isinstance(s, (ast.If, ast.While)):
            have = have | self.bound(s.test)
            known = bool(s.test.value) if isinstance(s.test, ast.Constant) else None
            if isinstance(s, ast.While):
                return self.body(s.orelse, have) if known is False else self.loop(s, have, have, known is True)
            ways = ([] if known is False else [self.body(s.body, have)]) + ([] if known is True else [self.body(s.orelse, have)])
            return self.meet(ways)
        if isinstance(s, (ast.For, ast.AsyncFor)):
            have = have | self.bound(s.iter)
            return self.loop(s, have, have | self.bound(s.target), False)
        if isinstance(s, (ast.With, ast.AsyncWith)):
            return self.body(s.body, have.union(*(self.bound(i) for i in s.items)))
        if isinstance(s, (ast.Try, ast.TryStar)):
            points = [have]
            done = self.body(s.orelse, self.body(s.body, have, points))
            failed = self.meet(points)
            handled = [self.body(h.body, failed | ({h.name} if h.name else set())) for h in s.handlers]
            handled = [w - ({h.name} if h.name else set()) if w is not None else None for w, h in zip(handled, s.handlers, strict=True)]
            out = self.meet([done, *handled])
            ended = self.body(s.finalbody, out if out is not None else failed)
            return ended if out is not None else None
        if isinstance(s, ast.Match):
            have = have | self.bound(s.subject)
            ways, whole = [], False
            for c in s.cases:
                whole |= c.guard is None and isinstance(c.pattern, ast.MatchAs) and c.pattern.pattern is None
                ways.append(self.body(c.body, have | self.bound(c.pattern)))
            return self.meet(ways if whole else [*ways, have])
        return have | self.bound(s)


def is_type_checking(node: ast.AST) -> bool:
    return isinstance(node, ast.If) and (isinstance(node.test, ast.Name) and node.test.id == "TYPE_CHECKING" or isinstance(node.test, ast.Attribute) and node.test.attr == "TYPE_CHECKING")


def relative_imports(tree: ast.Module, found: set[tuple[int, str]]) -> tuple[list[str], list[str]]:
    """(definite, candidates): './x' for each relative import outside type-checking blocks; bare-dot imports name candidate submodules, but for names that are found bound."""
    definite, candidates = [], []
    todo: list[ast.AST] = [tree]
    while todo:
        node = todo.pop()
        if is_type_checking(node):
            todo += node.orelse
            continue
        if isinstance(node, ast.ImportFrom) and node.level:
            up = "./" if node.level == 1 else "../" * (node.level - 1)
            if node.module:
                definite.append(up + node.module.replace(".", "/"))
            else:
                definite.append(up.rstrip("/") or ".")
                candidates += [up + a.name for a in node.names if a.name != "*" and (id(node), a.name) not in found]
        todo += list(ast.iter_child_nodes(node))
    return sorted(set(definite)), sorted(set(candidates))


NOTHING = {"problem": None, "imports": [], "candidates": [], "defined": [], "tokens": [], "functions": [], "logical_lines": 0, "identifiers": 0, "ambiguous": 0, "exported": 0, "documented": 0}


def analyze(text: str, path: str) -> dict:
    name = path.rpartition("/")[2].lower()
    stub, package = name.endswith(".pyi"), name in ("__init__.py", "__init__.pyi")
    try:
        tree = ast.parse(text)
        tokens, lines = tokens_of(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError, tokenize.TokenError) as e:
        return NOTHING | {"parsed": False, "problem": type(e).__name__}
    flow = Flow(package)
    defined = flow.body(tree.body, set()) or set()
    imports, candidates = relative_imports(tree, flow.found)
    out = NOTHING | {"parsed": True, "imports": imports, "candidates": candidates, "defined": sorted(defined)}
    if stub:
        return out
    ordered = sorted(lines)
    functions = [n for n in ast.walk(tree) if isinstance(n, FUNCTIONS)]
    api = [n for n in tree.body if isinstance(n, (*FUNCTIONS, ast.ClassDef))]
    api += [m for c in ast.walk(tree) if isinstance(c, ast.ClassDef) for m in c.body if isinstance(m, FUNCTIONS)]
    public = [n for n in api if not n.name.startswith("_")]
    names = Bindings()
    names.visit(tree)
    return out | {
        "logical_lines": len(lines), "tokens": tokens, "functions": sorted((measure(f, ordered) for f in functions), key=lambda m: (m[1], m[2], m[0])), "identifiers": len(names.names), "ambiguous": sum(map(is_ambiguous, names.names)),
        "exported": len(public), "documented": sum(map(documented, public)),
    }


def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    for b in batches:
        rows = [{"repo_id": r.repo_id, "path": r.path} | analyze(r.text or "", r.path) for r in b.itertuples()]
        yield pd.DataFrame(rows, columns=columns)


def dealt(texts: DataFrame) -> DataFrame:
    """texts (repo_id, path, text) by file in several parts for each core. A table of few bytes is read in few tasks, but parsing takes its time by the file; a stated number of parts is not merged by their bytes."""
    spark = texts.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return texts.repartition(parts, "repo_id", "path")


def analyze_files(texts: DataFrame) -> DataFrame:
    """One row for each Python file of (repo_id, path, text); other files are filtered before any Python runs."""
    own = texts.where(F.lower("path").rlike(r"\.pyi?$")).select(F.col("repo_id").cast("string").alias("repo_id"), "path", "text")
    return dealt(own).mapInPandas(_run, SCHEMA)


def function_rows(files: DataFrame) -> DataFrame:
    """(repo_id, path, function columns) of analysed files."""
    return files.select("repo_id", "path", F.explode("functions").alias("f")).select("repo_id", "path", "f.*")
