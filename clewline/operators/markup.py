"""Page text cut into markup pieces, and what is open where.

One pattern reads a page from left to right, so a quoted ``>`` does not end a tag and nothing inside a comment, script or
style is a tag. Which elements enclose a piece needs the stack of open elements; tag names alone go through it.
"""
from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BooleanType

#: What follows the name of a tag, to its end; quoted text is read whole.
REST = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
TAG = r"</?[a-z][^\s/>\"'<]*+" + REST
# What is not closed runs to the end of the page.
RAW = r"<!--.*?(?:-->|\z)|<(script|style)\b" + REST + r".*?(?:</\1\s*>|\z)"
PIECE = rf"(?is){RAW}|<[!?][^>]*+>?|{TAG}|[^<]++|<"

# Elements without content, and elements whose text is never shown.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
UNSHOWN = ("head", "noscript", "template")
HIDDEN_STYLE = r"(?i)(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\s*(?:!important)?\s*(?:;|$)"

TEXT, OTHER = ".", "-"


def pieces(html: Column) -> Column:
    """Comments, scripts and styles with their content, tags, and stretches of text, in page order."""
    return F.regexp_extract_all(html, F.lit(PIECE), F.lit(0))


def name_of(piece: Column) -> Column:
    """Lower-case name of an opening or closing tag, with a slash before a closing one; empty for anything else."""
    return F.lower(F.regexp_extract(piece, r"^<(/?[a-zA-Z][^\s/>]*)", 1))


def follow(marks: Iterable[str]) -> list[bool]:
    """For each mark whether it is text that is shown. ``name`` opens, ``!name`` opens and hides, ``/name`` closes.

    A closing tag ends the nearest open element of its name and all that was opened in it; without one it ends nothing.
    Every mark is pushed and popped once at most, however deep elements lie.
    """
    stack: list[str] = []
    places: dict[str, list[int]] = {}
    hidden, out = -1, []
    for mark in marks:
        out.append(mark == TEXT and hidden < 0)
        if mark in (TEXT, OTHER):
            continue
        if mark[0] == "/":
            at = places.get(mark[1:])
            if at:
                first = at[-1]
                while len(stack) > first:
                    places[stack.pop()].pop()
                if hidden >= first:
                    hidden = -1
            continue
        name = mark.lstrip("!")
        if mark[0] == "!" and hidden < 0:
            hidden = len(stack)
        places.setdefault(name, []).append(len(stack))
        stack.append(name)
    return out


@arrow_udf(ArrayType(BooleanType()))
def _shown(marks: pa.Array) -> pa.Array:
    return pa.array([None if m is None else follow(m) for m in marks.to_pylist()], pa.list_(pa.bool_()))


def marks_of(parts: Column, hides) -> Column:
    """A mark for :func:`follow` of each piece; ``hides`` says of an opening tag whether it hides its content."""

    def mark(piece):
        name = name_of(piece)
        empty = name.isin(*VOID) | piece.rlike(r"/\s*>$")
        raw = piece.rlike(r"(?is)^<(?:script|style)\b")
        return (
            F.when(~piece.startswith("<") | (piece == "<"), TEXT)
            .when((name == "") | raw, OTHER)
            .when(name.startswith("/"), name)
            .when(empty, OTHER)
            .otherwise(F.concat(F.when(hides(name, piece), "!").otherwise(""), name)))

    return F.transform(parts, mark)


def shown_text(pages: DataFrame, hides, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the text pieces of ``html`` that no hiding element encloses, joined by spaces, references not decoded."""
    parts = pages.withColumn("_pieces", pieces(F.col(html)))
    others = [c for c in parts.columns if c != "_pieces"]
    held = parts.select(*others, F.explode_outer(F.array(F.struct("_pieces"))).alias("_held")).select(*others, "_held.*")
    seen = held.withColumn("_shown", _shown(marks_of(F.col("_pieces"), hides)))
    both = F.filter(F.arrays_zip(F.col("_pieces").alias("piece"), F.col("_shown").alias("shown")), lambda z: z["shown"])
    return seen.withColumn(out, F.array_join(F.transform(both, lambda z: z["piece"]), " ")).drop("_pieces", "_shown")


def page_tags(pages: DataFrame) -> DataFrame:
    """One row per opening or closing tag, script and style of pages with ``effective_base``: page_id, url, effective_base, pos, tag, tag_text, body.

    ``body`` is what a script or style holds. Write it once where several operators read it.
    """
    kept = F.filter(F.transform(pieces(F.col("html")), lambda p: F.struct(name_of(p).alias("tag"), p.alias("piece"))), lambda s: s["tag"] != "")
    t = pages.select("page_id", "url", "effective_base", F.posexplode(kept).alias("pos", "x")).select("page_id", "url", "effective_base", "pos", "x.*")
    raw = F.col("tag").isin("script", "style")
    opening = F.when(raw, F.regexp_extract("piece", r"(?is)^(<(?:script|style)\b" + REST + ")", 1)).otherwise(F.col("piece"))
    body = F.when(raw, F.regexp_extract("piece", r"(?is)^<(?:script|style)\b" + REST + r"(.*?)(?:</(?:script|style)\s*>)?\z", 1))
    return t.select("page_id", "url", "effective_base", "pos", "tag", opening.alias("tag_text"), body.alias("body"))
