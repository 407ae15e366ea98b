"""Evidence in README text: headings, fenced commands and examples, usage prose."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import static as st

#: Names of fence languages that hold program code.
FENCES = frozenset(
    "javascript js jsx mjs cjs typescript ts tsx mts cts python py go golang rust rs c h cpp c++ cc cxx hpp java kotlin kt kts csharp cs fsharp fs fsx ruby rb php swift dart scala sc shell sh bash zsh fish lua r rscript elixir ex exs erlang erl hrl clojure clj cljs haskell hs lhs vue svelte astro".split()
)
#: What shows code inside a fence.
CODE = tuple(
    re.compile(p)
    for p in (
        r"""\bimport\s+(?:[\w$*{},\s]+\s+from\s+)?["'][^"'\n]+["']""",
        r"""(?:^|\n)\s*import\s+[A-Za-z_][\w.]*(?:\s+as\s+[A-Za-z_]\w*)?(?:\s*(?:,|;|$))""",
        r"""(?:^|\n)\s*from\s+[\w.]+\s+import\s+[\w*{}, ]+(?:\s*(?:;|$))""",
        r"""\b(?:const|let|var)\s+[A-Za-z_$][\w$]*\s*=""",
        r"""\b(?:function|def|fn)\s+[A-Za-z_$][\w$]*\s*\(""",
        r"""\bclass\s+[A-Za-z_$][\w$]*(?:\s*[:({]|\s+extends\s+)""",
        r"""\b[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*\s*\(""",
        r"""(?:^|[;\n])\s*[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*\s*=(?!=)""",
        r"""\([A-Za-z_+*/!?-][\w+*/!?-]*(?:\s|\))""",
        r"""=>""",
    )
)
FLAGS = ("install_heading", "install_command", "usage_heading", "usage_command", "usage_example", "usage_prose", "architecture_heading", "configuration_heading")
RESULT = T.StructType([*(T.StructField(f, T.BooleanType()) for f in (*FLAGS, "usage_concrete")), T.StructField("invocations", T.ArrayType(T.StringType()))])
HAN = re.compile("[㐀-䶿一-鿿]")


def plain(text: str) -> str:
    """Visible text of a line: link labels stay, images, tags and link targets go."""
    text = re.sub(r"!\[[^\]]*\](?:\([^\n)]*\)|\[[^\]]*\])", " ", text)
    text = re.sub(r"\[([^\]]*)\]\([^()\n]*(?:\([^()\n]*\)[^()\n]*)*\)", r"\1", text)
    return re.sub(r"""<(?:"[^"]*"|'[^']*'|[^>"'])*>""", "", text)


def normalized(heading: str) -> str:
    text = unicodedata.normalize("NFKC", re.sub(r"[*_~`]", "", plain(heading))).lower()
    return " ".join(re.findall(r"[^\W_]+", text))


def sections(heading: str) -> list[str]:
    have = f" {normalized(heading)} "
    return [name for name, phrases in st.HEADINGS.items() if any(f" {normalized(p)} " in have for p in phrases)]


def executable(word: str) -> str:
    return word.strip("\"'").rsplit("/", 1)[-1].lower()


def _is_code(lines: list[str], language: str) -> bool:
    if language and language not in FENCES:
        return False
    kept, comment = [], False
    for line in lines:
        bare = line.strip()
        if comment or bare.startswith("/*"):
            comment = "*/" not in bare
        elif bare and not bare.startswith(("//", "#", "*")):
            kept.append(line)
    code = "\n".join(kept)
    return bool(kept) and any(p.search(code) for p in CODE)


def _commands(lines: list[str]) -> list[list[str]]:
    clean = [re.sub(r"^\s*[$>]\s*", "", x).strip() for x in lines]
    clean = [x for x in clean if x and not x.startswith(("#", "//", ";"))]
    if not clean or re.match(r"[.,:;!?…。，：；！？、]", clean[0]) and not clean[0].startswith("./"):
        return []
    return [words for x in clean for part in re.split(r"\s*(?:&&|\|\||;)\s*", x) if (words := unicodedata.normalize("NFKC", part).split())]


def _is_prose(line: str) -> bool:
    if re.match(r"\s*\[[^\]]+\]:", line):
        return False
    text = unicodedata.normalize("NFKC", re.sub(r"^\s*(?:[-*+] |\d+[.)] |>\s*)", "", plain(re.sub(r"`+[^`\n]*`+", " ", line)))).strip()
    if not text:
        return False
    first = text.split()[0]
    shell = executable(first.rstrip(",:;")) in st.EXECUTABLES or first in ("sudo", "env") or re.match(r"(?:\.{1,2}|~)?/\S|[A-Za-z_]\w*=\S", first) or re.match(r"(?:curl|wget)\b.*https?://", text)
    code = re.match(r"""(?:import\s+["'\w]|from\s+[\w.]+\s+import\s|(?:export\s+)?(?:const|let|var)\s+\w+\s*=|(?:async\s+)?(?:def|function|fn)\s+\w+\s*\(|class\s+\w+\s*[:({]|[A-Za-z_$][\w$.]*\s*=(?!=)|[\w$.]+\([^()]*\)\s*;?$)""", text)
    return not shell and not code and (len(HAN.findall(text)) >= 4 or len(re.findall(r"[^\W_]+", text)) >= 2)


def evidence(text: str | None) -> tuple:
    found = dict.fromkeys(FLAGS, False)
    invocations: list[str] = []
    stack: list[tuple[int, list[str]]] = []
    fence, language, body, within = "", "", [], []
    comment = False
    active = lambda: next((s for _, s in reversed(stack) if s), [])
    for line in re.split(r"\r?\n", text or ""):
        if fence:
            if re.match(rf"^\s{{0,3}}{re.escape(fence[0])}{{{len(fence)},}}\s*$", line):
                commands = _commands(body)
                invocations += [" ".join(c) for c in commands]
                runs = any(executable(c[0]) in st.EXECUTABLES for c in commands)
                example = bool(commands) and _is_code(body, language)
                found["install_command"] |= "installation" in within and runs
                found["usage_command"] |= "usage" in within and runs
                found["usage_example"] |= "usage" in within and example
                fence = ""
            else:
                body.append(line)
            continue
        if comment:
            if "-->" not in line:
                continue
            line, comment = line.split("-->", 1)[1], False
        line = re.sub(r"<!--.*?-->", "", line)
        if "<!--" in line:
            line, comment = line.split("<!--", 1)[0], True
        if opened := re.match(r"^\s{0,3}(`{3,}|~{3,})(.*)$", line):
            fence, language, body, within = opened[1], (opened[2].split() or [""])[0].lower(), [], active()
        elif head := re.match(r"^\s{0,3}(#{1,6})\s+(.+?)\s*#*\s*$", line):
            level, own = len(head[1]), sections(head[2])
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, own))
            for name, flag in (("installation", "install_heading"), ("usage", "usage_heading"), ("architecture", "architecture_heading"), ("configuration", "configuration_heading")):
                found[flag] |= name in own
        elif line.strip() and "usage" in active() and _is_prose(line):
            found["usage_prose"] = True
    return *found.values(), found["usage_command"] or found["usage_example"], invocations


@F.pandas_udf(RESULT)
def markdown_evidence(text: pd.Series) -> pd.DataFrame:
    """Struct of evidence flags and of the commands in fences."""
    return pd.DataFrame([evidence(t) for t in text], columns=RESULT.names)
