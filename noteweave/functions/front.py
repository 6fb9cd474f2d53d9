"""Front matter: the YAML block at a note's start, read into JSON and written back.

The block, not the note, goes to Python, in Arrow batches; what comes back is JSON, which the JVM reads. Understood are
block and inline lists and mappings, quoted and plain scalars with YAML's types, folded and literal texts and comments.
Anchors, tags and anything malformed make the block count as empty.
"""

from __future__ import annotations

import datetime
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: YAML 1.1's plain scalars.
NULLS = ("", "~", "null", "Null", "NULL")
TRUE = ("yes", "Yes", "YES", "true", "True", "TRUE", "on", "On", "ON")
FALSE = ("no", "No", "NO", "false", "False", "FALSE", "off", "Off", "OFF")
INTEGER = re.compile(r"[-+]?(0b[01_]+|0x[0-9a-fA-F_]+|0[0-7_]*|[1-9][0-9_]*)")
CLOCK = re.compile(r"[-+]?[1-9][0-9_]*(:[0-5]?[0-9])+")
FLOAT = re.compile(r"[-+]?([0-9][0-9_]*\.[0-9_]*([eE][-+][0-9]+)?|\.[0-9][0-9_]*([eE][-+][0-9]+)?|\.(inf|Inf|INF))|\.(nan|NaN|NAN)")
DATE = re.compile(r"\d{4}-\d{2}-\d{2}")
TIMESTAMP = re.compile(r"\d{4}-\d{1,2}-\d{1,2}([Tt]|[ \t]+)\d{1,2}:\d{2}:\d{2}(\.\d*)?([ \t]*(Z|[-+]\d{1,2}(:?\d{2})?))?")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "f": "\f", "v": "\v", "a": "\a", "e": "\x1b", " ": " ", '"': '"', "\\": "\\", "/": "/", "N": "\x85", "_": "\xa0", "L": "\u2028", "P": "\u2029"}
HEX = {"x": 2, "u": 4, "U": 8}

_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s\-?:,\[\]{}#&*!|>'"%@`][^#]*?|[-?:][^\s#][^#]*?)\s*:(?=\s|$)""")


class Malformed(ValueError):
    """The block is not YAML as understood here."""


def plain(word: str):
    """A plain scalar by its type; dates stay as they are written."""
    if word in NULLS:
        return None
    if word in TRUE or word in FALSE:
        return word in TRUE
    if INTEGER.fullmatch(word):
        digits = word.replace("_", "").lstrip("+")
        bare = digits.lstrip("-")
        base = 2 if bare.startswith("0b") else 16 if bare.startswith("0x") else 8 if len(bare) > 1 and bare[0] == "0" else 10
        return int(digits, base)
    if CLOCK.fullmatch(word):
        sign, total = (-1 if word[0] == "-" else 1), 0
        for part in word.lstrip("+-").replace("_", "").split(":"):
            total = 60 * total + int(part)
        return sign * total
    if FLOAT.fullmatch(word):
        value = float(word.replace("_", "").lower().replace(".inf", "inf").replace(".nan", "nan"))
        return value if value == value and abs(value) != float("inf") else str(value)
    if word[0] in "&*!%@`|>" or word[0] in "-?:" and (len(word) == 1 or word[1] == " "):
        raise Malformed(word)
    return word


class Reader:
    """A block's lines, read by indentation."""

    def __init__(self, block: str):
        self.lines = re.split(r"\r\n|\r|\n", block)
        if len(self.lines) > 1 and not self.lines[-1]:
            self.lines.pop()  # a line's end, not a line
        self.at = 0

    def peek(self) -> int | None:
        """Indentation of the next line that says something."""
        while self.at < len(self.lines):
            line = self.lines[self.at]
            bare = line.lstrip(" ")
            if bare.strip() and not bare.startswith("#"):
                if bare[0] == "\t":
                    raise Malformed("tab")
                return len(line) - len(bare)
            self.at += 1
        return None

    def node(self, least: int):
        """The value that begins on the next line, indented by ``least`` or more; None without one."""
        indent = self.peek()
        if indent is None or indent < least:
            return None
        rest = self.lines[self.at][indent:]
        if rest.startswith("- ") or rest.rstrip() == "-":
            return self.items(indent)
        if _KEY.match(rest):
            return self.mapping(indent)
        self.at += 1
        return self.value(rest, indent - 1)

    def items(self, indent: int) -> list:
        out = []
        while self.peek() == indent:
            rest = self.lines[self.at][indent:]
            if not (rest.startswith("- ") or rest.rstrip() == "-"):
                break
            inner = rest[1:]
            gap = len(inner) - len(inner.lstrip(" "))
            inner = inner.strip()
            if not inner or inner.startswith("#"):
                self.at += 1
                out.append(self.node(indent + 1))
            elif _KEY.match(inner) or inner.startswith("- "):
                self.lines[self.at] = " " * (indent + 1 + gap) + inner
                out.append(self.node(indent + 1))
            else:
                self.at += 1
                out.append(self.value(inner, indent))
        return out

    def mapping(self, indent: int) -> dict:
        out = {}
        while self.peek() == indent:
            rest = self.lines[self.at][indent:]
            key = _KEY.match(rest)
            if not key:
                raise Malformed(rest)
            name, behind = key[1], rest[key.end() :].strip()
            name = self.quoted(name)[0] if name[0] in "\"'" else name
            self.at += 1
            if not behind or behind.startswith("#"):
                below = self.peek()
                same = below == indent and re.match(r"-( |$)", self.lines[self.at][indent:])  # a list may stand under its key
                out[name] = self.items(indent) if same else self.node(indent + 1)
            else:
                out[name] = self.value(behind, indent)
        if (self.peek() or 0) > indent:
            raise Malformed("indentation")
        return out

    def value(self, text: str, indent: int):
        """A scalar or inline value that begins with ``text`` and may go on in lines indented deeper."""
        if text[0] in "|>":
            return self.literal(text, indent)
        if text[0] in "\"'[{":
            while True:
                try:
                    value, rest = self.flow(text)
                    break
                except IndexError:  # it goes on in the next line
                    if self.at >= len(self.lines):
                        raise Malformed(text) from None
                    text += " " + self.lines[self.at].strip()
                    self.at += 1
            if rest.strip() and not rest.lstrip().startswith("#"):
                raise Malformed(rest)
            return value
        text = re.split(r"\s+#", text, maxsplit=1)[0].strip()
        more = False
        while (below := self.peek()) is not None and below > indent and text:
            line = re.split(r"\s+#", self.lines[self.at].strip(), maxsplit=1)[0]
            if _KEY.match(line):
                raise Malformed(line)
            text, more = f"{text} {line}", True
            self.at += 1
        if re.search(r":(\s|$)", text):
            raise Malformed(text)
        return text if more else plain(text)

    def literal(self, mark: str, indent: int) -> str:
        mark = mark.split("#")[0].strip()
        if not re.fullmatch(r"[|>][-+]?[1-9]?[-+]?", mark):
            raise Malformed(mark)
        held, depth = [], None
        while self.at < len(self.lines):
            line = self.lines[self.at]
            here = len(line) - len(line.lstrip(" "))
            if line.strip() and depth is None:
                depth = here
            if line.strip() and (here <= indent or here < depth):
                break
            held.append(line[depth:] if depth is not None else "")
            self.at += 1
        tail = len(held)
        while tail and not held[tail - 1].strip():
            tail -= 1
        text = "\n".join(held[:tail])
        if mark[0] == ">":
            text = re.sub(r"(?<=\S)\n(?=\S)", " ", text)
            text = re.sub(r"\n(\n+)", r"\1", text)
        return text + ("" if "-" in mark or not text else "\n" * (1 + len(held) - tail) if "+" in mark else "\n")

    def quoted(self, text: str) -> tuple[str, str]:
        """A quoted text at the start of ``text``, and what is behind it."""
        mark, out, i = text[0], [], 1
        while True:
            c = text[i]
            if c == mark:
                if mark == "'" and text[i + 1 : i + 2] == "'":
                    out.append("'")
                    i += 2
                    continue
                return "".join(out), text[i + 1 :]
            if c == "\\" and mark == '"':
                kind = text[i + 1]
                if kind in HEX:
                    out.append(chr(int(text[i + 2 : i + 2 + HEX[kind]], 16)))
                    i += 2 + HEX[kind]
                    continue
                if kind not in ESCAPES:
                    raise Malformed(text)
                out.append(ESCAPES[kind])
                i += 2
                continue
            out.append(c)
            i += 1

    def flow(self, text: str):
        """An inline value at the start of ``text``, and what is behind it; IndexError if it does not end there."""
        text = text.lstrip()
        if text[0] in "\"'":
            return self.quoted(text)
        if text[0] not in "[{":
            end = re.search(r"[,\[\]{}]|:(?=\s)", text)
            if end is None:
                raise IndexError
            return plain(text[: end.start()].strip()), text[end.start() :]
        close, out, text = "]" if text[0] == "[" else "}", [], text[1:].lstrip()
        while text[0] != close:
            name, text = self.flow(text)
            text = text.lstrip()
            if text[0] == ":":
                value, text = self.flow(text[1:]) if text[1:].lstrip()[0] not in ",}]" else (None, text[1:])
                out.append((name, value) if close == "}" else {str(name): value})
            else:
                out.append((name, None) if close == "}" else name)
            text = text.lstrip()
            if text[0] == ",":
                text = text[1:].lstrip()
            elif text[0] != close:
                raise Malformed(text)
        return ({str(k): v for k, v in out} if close == "}" else out), text[1:]


def parse(block: str) -> dict:
    """The mapping that a block holds; empty if it holds something else or is malformed."""
    try:
        reader = Reader(block)
        found = reader.node(0)
        return found if isinstance(found, dict) and reader.peek() is None else {}
    except (Malformed, ValueError, IndexError, RecursionError):
        return {}


@F.pandas_udf(StringType())
def _json(blocks: pd.Series) -> pd.Series:
    return blocks.map(lambda b: json.dumps(parse(b), ensure_ascii=False) if b else "{}")


def block(text: Column) -> Column:
    """What stands between the fences at the text's start; empty without them."""
    at = F.when(text.startswith("---"), F.locate("\n---", text, 4)).otherwise(F.lit(0))
    return F.when(at > 0, F.substr(text, F.lit(4), at - 4)).otherwise(F.lit(""))


def as_json(text: Column) -> Column:
    """The front matter as JSON, its keys in the order they are written; an empty object without one."""
    return F.coalesce(_json(block(text)), F.lit("{}"))


def meta(text: Column) -> Column:
    """The front matter as a variant, whose keys are sorted; an empty object without one."""
    return F.parse_json(as_json(text))


def value(found: Column, key: str) -> Column:
    """A scalar of ``meta`` as text: null where it is absent or null."""
    return F.try_variant_get(found, f"$.{key}", "string")


def values(found: Column, key: str) -> Column:
    """A list of ``meta`` as an array of texts, a scalar as a list of one; empty where it is absent, null or false."""
    many = F.try_variant_get(found, f"$.{key}", "array<string>")
    one = value(found, key)
    return F.when(many.isNotNull(), many).when(one.isNull() | one.isin("", "false", "0"), F.array().cast("array<string>")).otherwise(F.array(one))


def is_false(found: Column, key: str) -> Column:
    """Whether the key holds the boolean false, and nothing that only looks like it."""
    return F.coalesce((F.schema_of_variant(F.try_variant_get(found, f"$.{key}", "variant")) == "BOOLEAN") & ~F.try_variant_get(found, f"$.{key}", "boolean"), F.lit(False))


def scalar(value) -> str:
    """A scalar as it is written in front matter."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int | float):
        return str(value)
    if isinstance(value, datetime.date | datetime.datetime):
        return value.isoformat(" ") if isinstance(value, datetime.datetime) else value.isoformat()
    text = str(value)
    try:
        safe = DATE.fullmatch(text) or text and plain(text) == text and not TIMESTAMP.fullmatch(text) and not re.search(r"^[\s#\"'\[{>|]|:(\s|$)|\s#|[\n\r\t]|\s$|^-", text)
    except Malformed:
        safe = False
    return text if safe else json.dumps(text, ensure_ascii=False)


def line(key: str, value) -> str:
    """One entry; a list as a block."""
    if isinstance(value, list | tuple):
        return f"{key}: []" if not value else f"{key}:\n" + "\n".join(f"- {scalar(v)}" for v in value)
    return f"{key}: {scalar(value)}"


def write(meta: dict) -> str:
    """Front matter with its fences, and the blank line behind it."""
    return "---\n" + "".join(line(k, v) + "\n" for k, v in meta.items()) + "---\n\n"


_TOP = re.compile(r"^([A-Za-z_][\w-]*):")


def patch(text: str, updates: dict) -> str:
    """A note with entries of its front matter replaced, whatever lines they span, or added at its end."""
    end = text.find("\n---", 3) if text.startswith("---") else -1
    lines, body = (text[4:end].splitlines(), text[end + 4 :]) if end != -1 else ([], "\n\n" + text)
    entries: list[tuple[str | None, list[str]]] = []
    for row in lines:
        key = _TOP.match(row)
        if key or not entries:
            entries.append((key[1] if key else None, [row]))
        else:
            entries[-1][1].append(row)
    left = dict(updates)
    out = [line(key, left.pop(key)) if key in left else "\n".join(rows) for key, rows in entries]
    out += [line(k, v) for k, v in left.items()]
    return "---\n" + "\n".join(out) + "\n---" + body


def add_to_section(body: str, heading: str, entry: str) -> str:
    """A body with a line at the end of the section ``## heading``, which is begun at the end where there is none."""
    begin = re.search(rf"^## {re.escape(heading)}[ \t]*$", body, re.MULTILINE)
    if begin is None:
        return body.rstrip("\n") + f"\n\n## {heading}\n{entry}\n"
    following = re.search(r"^#{1,6} .*$", body[begin.end() :], re.MULTILINE)
    end = len(body) if following is None else begin.end() + following.start()
    inside = body[begin.end() : end].rstrip("\n")
    return body[: begin.end()] + inside + f"\n{entry}\n" + ("" if following is None else "\n" + body[end:])
