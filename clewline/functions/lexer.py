"""Script text read as a lexer reads it, for screening: what is code, and which literals it holds.

Whether a slash divides or starts a regular expression, and whether a brace ends a block or a template's insertion, depends
on what came before, so the text is read once with that state; nothing is parsed or run.
"""
from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

_TOKEN = re.compile(
    r"""(?P<string>"(?:[^"\\\n]|\\.)*+"?|'(?:[^'\\\n]|\\.)*+'?)|(?P<comment>/\*.*?(?:\*/|\Z)|//[^\n]*+)|(?P<space>\s++)|(?P<word>[\w$]++)|(?P<mark>.)""", re.S)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\]?)++/[A-Za-z]*+")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*+", re.S)
# Words after which a slash starts a regular expression, and words whose parentheses hold a condition.
BEFORE_REGEX = frozenset("await case delete do else in instanceof new of return throw typeof void yield".split())
CONDITIONS = frozenset("for if while with".split())


def read(source: str) -> tuple[str, list[str]]:
    """Code without comments whose literals are numbered, as ``"0"``, and the literals' texts.

    A template is one literal with the insertions of its code behind it in parentheses; regular expressions become ``/r/``.
    """
    out: list[str] = []
    texts: list[str] = []
    blocks: list[int] = []  # open braces: the literal that an insertion belongs to, or -1 for a block
    parens: list[bool] = []  # open parentheses: whether they hold a condition
    at, value, word, closed = 0, False, "", 0  # value: whether what came before is one, so that a slash divides it

    def template(own: int, at: int) -> int:
        end = _TEMPLATE.match(source, at).end()
        texts[own] += source[at:end]
        if source.startswith("${", end):
            blocks.append(own)
            out.append("+(")
            return end + 2
        return end + 1

    while at < len(source):
        if source[at] == "/" and not value and at >= closed and not source.startswith(("//", "/*"), at):
            if m := _REGEX.match(source, at):
                out.append("/r/")
                at, value, word = m.end(), True, ""
                continue
            # One that does not end on its line leaves no other to look for there.
            line = source.find("\n", at)
            closed = line if line >= 0 else len(source)
        m = _TOKEN.match(source, at)
        kind, text = m.lastgroup, m.group()
        at = m.end()
        if kind in ("space", "comment"):
            out.append(" " if kind == "comment" else text)
            continue
        before, word = word, text if kind == "word" else ""
        if kind == "string":
            out.append(f'"{len(texts)}"')
            texts.append(text[1:-1] if len(text) > 1 and text[-1] == text[0] else text[1:])
            value = True
        elif kind == "word":
            out.append(text)
            value = text not in BEFORE_REGEX
        elif text == "`":
            out.append(f'"{len(texts)}"')
            texts.append("")
            at = template(len(texts) - 1, at)
            value = out[-1] != "+("
        elif text == "}" and blocks and (own := blocks.pop()) >= 0:
            out.append(")")
            at = template(own, at)
            value = out[-1] != "+("
        else:
            out.append(text)
            if text == "{":
                blocks.append(-1)
            elif text == "(":
                parens.append(before in CONDITIONS)
            value = text == "]" or text == ")" and not (parens.pop() if parens else False)
            if text in "+-" and len(out) > 1 and out[-2] == text:
                value = True  # after a counting sign stands a value
    return "".join(out), texts


@arrow_udf(StructType([StructField("code", StringType()), StructField("texts", ArrayType(StringType()))]))
def _read(sources: pa.Array) -> pa.Array:
    got = [read(s.as_py()) if s.is_valid else (None, None) for s in sources]
    return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.list_(pa.string()))], names=["code", "texts"])


def lexed(source: Column) -> Column:
    """Struct (code, texts) of script text; see :func:`read`."""
    return _read(source)


def blanked(code: Column) -> Column:
    """Code of :func:`lexed` with its literals emptied."""
    return F.regexp_replace(code, r'"[0-9]+"', '""')
