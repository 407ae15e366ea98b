"""Prose of README files: which paragraphs explain a project, without markup, commands, HTML blocks and code.

A text is read once, line by line: `blocks` names what each line is, `paragraphs`
joins lines of prose under the heading they stand in.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

from . import static as st

#: Headings, tags, verbs and limits.
OVERVIEW = ("overview", "about", "what is", "简介", "概述", "关于")
OVERVIEW_STARTS = ("about ", "what is ", "关于")
CONTENTS = ("contents", "table of contents", "toc", "目录", "目录索引")
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
VERBS = frozenset("enables helps is lets makes offers provides supports uses".split())
PROGRAMS = frozenset((*st.EXECUTABLES, "nox", "ruff", "black", "git", "gh", "curl", "wget"))
MAX_TEXT_BYTES, MAX_HTML_DEPTH, MAX_PARENTHESES = 256 * 1024, 128, 128

PEM_START = re.compile(r"(?i)-----BEGIN(?: [A-Z0-9]+){0,4} PRIVATE KEY-----")
PEM_END = re.compile(r"(?i)-----END(?: [A-Z0-9]+){0,4} PRIVATE KEY-----")
UNSAFE = re.compile("[\x00-\x08\x0b-\x1f\x7f-\x9f\ud800-\udfff‪-‮⁦-⁩]")
URI = re.compile(r"(?<![A-Za-z0-9+._-])(?:[A-Za-z][A-Za-z0-9+.-]*:(?://)?|(?i:www\.))\S+|(?<![A-Za-z0-9+._:-])//\S+")
ANGLE = re.compile(r"""<(?:"[^"]*"|'[^']*'|[^"'>])*>""")
LABEL = re.compile(r"\[((?:\\.|[^\\\[\]])*)\]")
REFERENCE = re.compile(r"\[(?:\\.|[^\\\[\]])*\]")
HEADING = re.compile(r"^ {0,3}(#{1,6})(?:\s+(.*))?$")
UNDERLINE = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")
LIST_LINE = re.compile(r"^\s*(?:[-+*]|\d+[.)])\s")
DEFINITION = re.compile(r"^\s*\[[^\]\[]*\]:")
TABLE_RULE = re.compile(r"^:?-{3,}:?(?:\s*\|\s*:?-{3,}:?)+$")
BLOCK_TAG = re.compile(r"^\s*<([^\W_](?:[^\W_]|-)*|-(?:[^\W_]|-)*)(?=[\s/>]|$)")


def _link_end(text: str, start: int) -> int | None:
    """Place after the parenthesis that closes the link destination at start."""
    depth, quote, i = 0, "", start
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 1
        elif quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "(":
            depth += 1
            if depth > MAX_PARENTHESES:
                return None
        elif c == ")":
            depth -= 1
            if not depth:
                return i + 1
        i += 1
    return None


def _label(text: str) -> str | None:
    if re.search(r"(?<!\\)(?:\\\\)*<", text):
        return None
    plain = re.sub(r"\\(.)|[`*_~]", lambda m: m[1] or "", text)
    return URI.sub("", plain.strip()).strip()


def visible(line: str) -> str | None:
    """What a reader of the rendered line sees: no targets, code, tags, URLs and emphasis marks; None where the markup isn't closed or has an image."""
    if UNSAFE.search(line) or "![" in line:
        return None
    out: list[str] = []
    i = 0
    while i < len(line):
        c = line[i]
        if found := URI.match(line, i):
            i = found.end()
        elif c == "\\":
            if i + 1 == len(line):
                return None
            out.append(line[i + 1])
            i += 2
        elif c == "`":
            run = re.compile("`+").match(line, i).group()
            closed = re.compile(rf"(?<!`){run}(?!`)").search(line, i + len(run))
            if not closed:
                return None
            i = closed.end()
        elif c == "<":
            if not (tag := ANGLE.match(line, i)):
                return None
            i = tag.end()
        elif c == "[":
            found = LABEL.match(line, i)
            text = _label(found[1]) if found else None
            if text is None:
                return None
            out.append(text)
            i = found.end()
            if line[i : i + 1] == "(":
                end = _link_end(line, i)
            elif line[i : i + 1] == "[":
                more = REFERENCE.match(line, i)
                end = more.end() if more else None
            else:
                end = i
            if end is None:
                return None
            i = end
        else:
            if c not in "*_~":
                out.append(c)
            i += 1
    return " ".join("".join(out).split())


def is_command(text: str) -> bool:
    """A prompt, or a program's name in lower case that no verb of prose follows."""
    text = text.strip()
    if text[:1] in ("$", ">"):
        return True
    words = text.split()
    first = re.sub(r"^\./", "", words[0]) if words else ""
    second = re.sub(r"(?:[^\w-]|[\d_])+$", "", words[1]).lower() if len(words) > 1 else None
    return first in PROGRAMS and (second is None or second not in VERBS)


def meaningful(text: str) -> bool:
    return bool(re.search(r"[^\W_]", text)) and not is_command(text)


def heading_key(text: str) -> str:
    return " ".join(re.sub(r"[：:?!？!。．.]+$", "", unicodedata.normalize("NFKC", text).lower()).split())


class HtmlBlock:
    """The block of one tag, open until as many closing tags as opening ones were seen; comments inside don't count."""

    def __init__(self, tag: str) -> None:
        self.tag, self.depth, self.comment = tag, 1, False

    def feed(self, line: str, start: int = 0) -> bool:
        """Reads a line from start; true once the block is closed."""
        i = start
        while i < len(line) and self.depth <= MAX_HTML_DEPTH:
            if self.comment:
                end = line.find("-->", i)
                if end < 0:
                    return False
                self.comment, i = False, end + 3
            elif line.startswith("<!--", i):
                self.comment, i = True, i + 4
            elif line[i] == "<":
                tag = ANGLE.match(line, i)
                if not tag:
                    return False
                name = re.match(r"<(/?)([^\s/>]*)", tag.group())
                if name[2].lower() == self.tag:
                    if name[1]:
                        self.depth -= 1
                        if not self.depth:
                            return True
                    elif not re.search(r"/[ \t]*>$", tag.group()):
                        self.depth += 1
                i = tag.end()
            else:
                i += 1
        return False


def blocks(text: str) -> Iterator[tuple[str, object]]:
    """('heading', (level, text)), ('prose', text) or ('break', None) for the lines that matter; what is skipped ends a paragraph where it starts."""
    lines = text.split("\n")
    front, fence, block, comment, key, skip = lines[0].strip() == "---", None, None, False, False, False
    for n, line in enumerate(lines):
        bare = line.strip()
        if skip:
            skip = False
        elif key:
            key = not PEM_END.fullmatch(bare)
        elif PEM_START.search(bare):
            key = True
            yield "break", None
        elif front:
            front = not (n > 0 and bare in ("---", "..."))
        elif block:
            if block.feed(line):
                block = None
        elif comment:
            comment = "-->" not in line
        elif tag := BLOCK_TAG.match(line):
            yield "break", None
            name = tag[1].lower()
            opening = ANGLE.match(line, line.index("<"))
            open_ = HtmlBlock(name)
            closed = open_.feed(line, opening.end() if opening else len(line))
            if name in VOID_TAGS or opening and re.search(r"/[ \t]*>$", opening.group()):
                comment = open_.comment
            elif not closed:
                block = open_
        elif "<!--" in line:
            comment = "-->" not in line
            yield "break", None
        elif fence:
            closing = FENCE.match(line)
            if closing and closing[1].startswith(fence) and not closing[2].strip():
                fence = None
        elif opened := FENCE.match(line):
            fence = opened[1]
            yield "break", None
        elif (head := HEADING.match(line)) and (title := visible(re.sub(r"\s+#+\s*$", "", (head[2] or "").strip()))) is not None:
            yield "heading", (len(head[1]), title)
        else:
            indented = line.startswith(("    ", "\t"))
            odd = indented or bare.startswith(">") or bool(LIST_LINE.match(line)) or bool(DEFINITION.match(line)) or bare.startswith("|") or bare.endswith("|") or bool(TABLE_RULE.match(bare))
            under = UNDERLINE.match(lines[n + 1]) if n + 1 < len(lines) else None
            shown = None if odd else visible(line)
            if under and shown is not None and meaningful(shown):
                skip = True
                yield "heading", (1 if under[1][0] == "=" else 2, shown)
            elif not bare or odd or bare in ("---", "***", "___") or is_command(bare) or not shown:
                yield "break", None
            else:
                yield "prose", shown


def paragraphs(text: str | None, refuse=lambda t: False, limit: int = 2, points: int = 480) -> list[str]:
    """The first different paragraphs under overview headings, or else those that lead; refuse(text) names texts that must not be shown."""
    if text is None or len(text.encode("utf-8", "replace")) > MAX_TEXT_BYTES:
        return []
    text = unicodedata.normalize("NFKC", re.sub(r"\r\n?", "\n", text.removeprefix("﻿")))
    found: dict[bool, list[str]] = {False: [], True: []}
    held: list[str] = []
    overview = contents = titled = False

    def close() -> None:
        whole = " ".join(held)
        held.clear()
        if not whole or refuse(whole) or not (shown := visible(whole)) or refuse(shown) or not meaningful(shown):
            return
        shown, have = shown[:points], found[overview]
        if len(have) < limit and " ".join(shown.split()).lower() not in (" ".join(h.split()).lower() for h in have):
            have.append(shown)

    for kind, value in blocks(text):
        if kind == "prose" and not contents and not refuse(value):
            held.append(value)
            continue
        close()
        if kind == "heading":
            level, title = value
            if level == 1 and not titled:
                titled = True
                found[False].clear()
            name = heading_key(title)
            overview, contents = name in OVERVIEW or name.startswith(OVERVIEW_STARTS), name in CONTENTS
    close()
    return found[True] or found[False]
