"""Text expressions: regex dialect, offset-stable normal form, sentences, local units, quotes, masking.

All offsets are UTF-16 code units. ``stable`` gives every astral character two
placeholder characters of the basic plane, so that Spark's character functions and
Java's regex positions count the same units; ``original_slice`` goes back.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules

_EMOJI_PAIR, _OTHER_PAIR, _SENTINEL, _TAKEN = "", "", "", ""

# White space, pictographs (Unicode's Extended_Pictographic) and closers.
SPACE = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
_PICTO = (
    "\\u00A9\\u00AE\\u203C\\u2049\\u2122\\u2139\\u2194-\\u2199\\u21A9\\u21AA\\u231A\\u231B\\u2328\\u2388\\u23CF\\u23E9-\\u23F3\\u23F8-\\u23FA\\u24C2\\u25AA\\u25AB"
    "\\u25B6\\u25C0\\u25FB-\\u25FE\\u2600-\\u2605\\u2607-\\u2612\\u2614-\\u2685\\u2690-\\u2705\\u2708-\\u2712\\u2714\\u2716\\u271D\\u2721\\u2728\\u2733\\u2734\\u2744\\u2747"
    "\\u274C\\u274E\\u2753-\\u2755\\u2757\\u2763-\\u2767\\u2795-\\u2797\\u27A1\\u27B0\\u27BF\\u2934\\u2935\\u2B05-\\u2B07\\u2B1B\\u2B1C\\u2B50\\u2B55\\u3030\\u303D\\u3297\\u3299"
)
_ASTRAL_PICTO = (
    "\\x{1F000}-\\x{1F0FF}\\x{1F10D}-\\x{1F10F}\\x{1F12F}\\x{1F16C}-\\x{1F171}\\x{1F17E}\\x{1F17F}\\x{1F18E}\\x{1F191}-\\x{1F19A}\\x{1F1AD}-\\x{1F1E5}"
    "\\x{1F201}-\\x{1F20F}\\x{1F21A}\\x{1F22F}\\x{1F232}-\\x{1F23A}\\x{1F23C}-\\x{1F23F}\\x{1F249}-\\x{1F3FA}\\x{1F400}-\\x{1F53D}\\x{1F546}-\\x{1F64F}"
    "\\x{1F680}-\\x{1F6FF}\\x{1F774}-\\x{1F77F}\\x{1F7D5}-\\x{1F7FF}\\x{1F80C}-\\x{1F80F}\\x{1F848}-\\x{1F84F}\\x{1F85A}-\\x{1F85F}\\x{1F888}-\\x{1F88F}"
    "\\x{1F8AE}-\\x{1F8FF}\\x{1F90C}-\\x{1F93A}\\x{1F93C}-\\x{1F945}\\x{1F947}-\\x{1FAFF}\\x{1FC00}-\\x{1FFFD}"
)
_EMOJI = f"{_PICTO}\\uFE0F\\u200D\\uE000\\uE001"
_CLOSER = "'\")\\]}”’"
_START = "A-Z0-9'\"“‘"

_WORD = "[A-Za-z0-9_]"
BORDER = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def java(pattern: str, case: bool = False) -> str:
    """A rule's pattern in Java's dialect."""
    return ("" if case else "(?i)") + _spelt(pattern, {"\\s": SPACE, "\\w": "A-Za-z0-9_"}, {"\\b": BORDER}, "\\n\\r\\u2028\\u2029")


def re2(pattern: str) -> str:
    """A rule's pattern in RE2's dialect, case as it is; RE2 has no look-around and no back-reference."""
    braced = lambda chars: re.sub(r"\\u(\w{4})", r"\\x{\1}", chars)
    return _spelt(pattern, {"\\s": braced(SPACE)}, {}, braced("\\n\\r\\u2028\\u2029"))


def _spelt(pattern: str, classes: dict[str, str], known: dict[str, str], breaks: str) -> str:
    """The pattern with ends, dots and the given escapes spelt out."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        two, one = pattern[i : i + 2], pattern[i]
        if one == "\\":
            chars = classes.get(two)
            out.append((chars if in_class else f"[{chars}]") if chars else known.get(two, two))
            i += 2
            continue
        if one == "[" and not in_class:
            in_class = True
        elif one == "]" and in_class:
            in_class = False
        elif one == "$" and not in_class:
            one = "\\z"
        elif one == "." and not in_class:
            one = f"[^{breaks}]"
        out.append(one)
        i += 1
    return "".join(out)


def stable(text: Column) -> Column:
    """The text with two basic-plane characters for every astral one."""
    plain = F.regexp_replace(text, "[\\uE000-\\uE00F]", _TAKEN)
    paired = F.regexp_replace(F.regexp_replace(plain, f"[{_ASTRAL_PICTO}]", _EMOJI_PAIR), "[\\x{10000}-\\x{10FFFF}]", _OTHER_PAIR)
    return F.when(text.rlike("[\\uE000-\\uE00F\\x{10000}-\\x{10FFFF}]"), paired).otherwise(text)


def piece(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def original_slice(text: Column, stable_text: Column, start: Column, end: Column) -> Column:
    """The original characters at offsets of the stable form."""

    def pairs(upto: Column) -> Column:
        return F.length(F.regexp_replace(piece(stable_text, F.lit(0), upto), "[^\\uE001\\uE003]", ""))

    return F.when(stable_text == text, piece(text, start, end)).otherwise(piece(text, start - pairs(start), end - pairs(end)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def first_match(text: Column, pattern: str, *more: Column) -> Column:
    """struct<start, end, ...> of the first match of a Java pattern, else null."""
    p = F.lit(pattern)
    start = F.regexp_instr(text, p) - 1
    return F.when(text.rlike(pattern), F.struct(start.alias("start"), (start + F.length(F.regexp_extract(text, pattern, 0))).alias("end"), *more))


def match_sql(var: str, pattern: str, **fields: str) -> str:
    """SQL of named_struct of fields where var has a match of a Java pattern, else null. In fields, {start} and
    {end} stand for the match's bounds. Rule tables go through SQL text, which is parsed at once in the JVM."""
    p = f'r"{pattern}"'
    start = f"(regexp_instr({var}, {p}) - 1)"
    bounds = {"start": start, "end": f"({start} + length(regexp_extract({var}, {p}, 0)))"}
    inner = ", ".join(f"'{name}', {value.format(**bounds)}" for name, value in fields.items())
    return f"CASE WHEN {var} RLIKE {p} THEN named_struct({inner}) END"


def literals(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "\\'") + "'" for w in words)


_PIECE = "struct<start:int,end:int,hit:boolean>"


def cut_at(text: Column, pattern: str) -> Column:
    """array<struct<start, end, hit>>: the text in order, matches of the pattern (hit) and what lies between."""
    parts = F.split(F.regexp_replace(text, f"({pattern})", f"{_SENTINEL}$1{_SENTINEL}"), _SENTINEL)
    sized = F.transform(parts, lambda p, i: F.struct(F.length(p).alias("n"), (i % 2 == 1).alias("hit")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_PIECE}>").alias("out"))
    return F.aggregate(
        sized,
        empty,
        lambda acc, p: F.struct(
            (acc["at"] + p["n"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + p["n"]).alias("end"), p["hit"].alias("hit")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )


def _boundary() -> str:
    """A sentence's end with the white space after it: a terminator with its closers before white space and
    a sentence start (or the text's end), or a blank line."""
    known = "|".join(a.replace(".", "\\.") for a in rules.ABBREVIATIONS.split())
    not_known = f"(?<!(?<![A-Za-z.])(?i:{known}))"
    ending = f"(?:(?<!\\.)\\.{{2,}}+|{not_known}(?<!\\.)\\.(?!\\.)|[!?…])[{_CLOSER}{_EMOJI}]*+"
    return f"{ending}(?:\\z|[{SPACE}]++(?=\\z|[{_START}{_EMOJI}]))|\\n[ \\t]*+(?=\\n)[{SPACE}]*+"


BOUNDARY = _boundary()


def sentences(text: Column) -> Column:
    """array<struct<start, end>>: trimmed sentences of a stable text, empty ones left out."""
    parts = F.split(F.regexp_replace(text, BOUNDARY, f"$0{_SENTINEL}"), _SENTINEL)
    sized = F.transform(
        parts,
        lambda p: F.struct(
            F.length(p).alias("n"),
            (F.length(p) - F.length(F.regexp_replace(p, f"\\A[{SPACE}]+", ""))).alias("head"),
            (F.length(p) - F.length(F.regexp_replace(p, f"[{SPACE}]+\\z", ""))).alias("tail"),
        ),
    )
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    return F.aggregate(
        sized,
        empty,
        lambda acc, p: F.struct(
            (acc["at"] + p["n"]).alias("at"),
            F.when(
                p["head"] < p["n"],
                F.concat(acc["out"], F.array(F.struct((acc["at"] + p["head"]).alias("start"), (acc["at"] + p["n"] - p["tail"]).alias("end")))),
            ).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: acc["out"],
    )


LOCAL_DELIMITER = "(?i)[,;—]|" + BORDER + "but" + BORDER
_SUBJECT = "|".join(["[A-Z][a-z]*", *"I we they he she it you my our your his her their".split()])
EVENT_DELIMITER = f"[;—]|,[{SPACE}]+(?:and|but|so)[{SPACE}]+(?=(?:{_SUBJECT}){BORDER})"


def local_segments(clause: Column) -> Column:
    """Pieces between commas, semicolons, dashes and "but" (delimiters are the hits)."""
    return cut_at(clause, LOCAL_DELIMITER)


def event_units(clause: Column) -> Column:
    """Pieces of a masked sentence between semicolons, dashes and coordinated clauses (delimiters are the hits)."""
    return cut_at(clause, EVENT_DELIMITER)


def index_at(pieces: Column, position: Column) -> Column:
    """Number, among the pieces that aren't hits, of the one that holds a position; null on a delimiter."""
    solid = F.transform(F.filter(pieces, lambda p: ~p["hit"]), lambda p, i: F.struct(p["start"].alias("start"), p["end"].alias("end"), i.alias("i")))
    return F.get(F.filter(solid, lambda p: (position >= p["start"]) & (position < p["end"])), F.lit(0))["i"]


def quoted_spans(text: Column) -> Column:
    """Closed quotations, straight and curly, with their marks."""
    spans = [F.transform(F.filter(cut_at(text, q), lambda p: p["hit"]), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"))) for q in ('"[^"]*"', "“[^“”]*”")]
    return F.when(text.rlike('["“]'), F.concat(*spans)).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def in_quotation(clause: Column, start: Column, end: Column) -> Column:
    """Whether a quotation is open at the start and after the character at the end of a match."""

    def is_open(prefix: Column) -> Column:
        straight = (F.length(prefix) - F.length(F.regexp_replace(prefix, '"', ""))) % 2 == 1
        depth = F.aggregate(
            F.regexp_extract_all(prefix, F.lit("([“”])"), F.lit(1)), F.lit(0), lambda d, q: F.when(q == "“", d + 1).otherwise(F.greatest(d - 1, F.lit(0)))
        )
        return straight | (depth > 0)

    return F.when(clause.rlike('["“]'), is_open(piece(clause, F.lit(0), start)) & is_open(piece(clause, F.lit(0), end + 1))).otherwise(F.lit(False))


def blank(text: Column, spans: Column) -> Column:
    """Spaces in place of the spans' characters, line breaks kept; the length stays."""
    return F.aggregate(
        spans,
        text,
        lambda t, s: F.concat(piece(t, F.lit(0), s["start"]), F.regexp_replace(piece(t, s["start"], s["end"]), "[^\\n\\r]", " "), F.substring(t, s["end"] + 1, F.length(t))),
    )



def signature(clause: Column) -> Column:
    """Content words of a request, inflected action verbs as their base; order and repeats kept."""
    stop = F.expr(f"array({literals(rules.STOPWORDS.split())})")
    forms = F.expr(f"map({literals([x for pair in rules.action_forms().items() for x in pair])})")
    words = F.regexp_extract_all(F.lower(clause), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.transform(F.filter(words, lambda w: ~F.array_contains(stop, w)), lambda w: F.coalesce(F.element_at(forms, w), w))


def jaccard(a: Column, b: Column) -> Column:
    """Of two word lists as sets; 0 where one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def has_completion(text: Column) -> Column:
    lower = F.lower(text)
    found = F.lit(False)
    for word in rules.COMPLETION:
        found = found | lower.contains(word)
    return found
