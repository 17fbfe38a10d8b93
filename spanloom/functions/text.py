"""Scalar expressions on text: normal forms, shingles, spans. Offsets are 0-based, half-open, in code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(text: str | Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(col(text), r"(?U)^\s+|\s+$", "")


def normalise(text: str | Column) -> Column:
    """White space runs to one blank, trimmed, lower case; null is empty."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"(?U)\s+", " ")))


def bigrams(text: str | Column) -> Column:
    """Distinct pairs of neighbouring characters, without white space, in lower case, digits as 0.

    One character is its own only member; an empty text has none.
    """
    s = F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"(?U)\s+", "")), r"(?U)\d", "0")
    pairs = F.regexp_extract_all(s, F.lit("(?s)(?=(..))"), F.lit(1))  # a look-ahead takes nothing, so pairs overlap
    none = F.array().cast("array<string>")
    return F.when(F.length(s) > 1, F.array_distinct(pairs)).when(F.length(s) == 1, F.array(s)).otherwise(none)


def dice(a: str | Column, b: str | Column) -> Column:
    """Dice coefficient of two sets; 0 if either is empty."""
    a, b = col(a), col(b)
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 2.0 * both / (F.size(a) + F.size(b))).otherwise(F.lit(0.0))


def matches(text: str | Column, pattern: str, ignore_case: bool = True) -> Column:
    """All matches of a pattern that never matches empty, as structs (s, e, matched), in order.

    The places follow from the pieces between the matches, as regular-expression built-ins give none. Only texts
    that match at all are taken apart; null has no matches.
    """
    text = col(text)
    p = F.lit(f"(?{'i' * ignore_case}U){pattern}")
    found = F.regexp_extract_all(text, p, 0)
    steps = F.zip_with(F.slice(F.split(text, p, -1), F.lit(1), F.size(found)), found, lambda gap, m: F.length(gap) + F.length(m))
    ends = F.aggregate(steps, F.expr("cast(array() as array<int>)"), lambda a, n: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + n)))
    spans = F.zip_with(found, ends, lambda m, e: F.struct((e - F.length(m)).alias("s"), e.alias("e"), m.alias("matched")))
    return F.when(text.rlike(f"(?{'i' * ignore_case}U){pattern}"), spans).otherwise(F.expr("cast(array() as array<struct<s:int,e:int,matched:string>>)"))


def sentences(text: str | Column) -> Column:
    """Spans of sentences, each with its delimiter; a text without one is a single span."""
    text = col(text)
    ends = F.transform(matches(text, r"[.!?。]\s+|\n", False), lambda m: m["e"])
    ends = F.when(F.coalesce(F.array_max(ends), F.lit(0)) < F.length(text), F.concat(ends, F.array(F.length(text)))).otherwise(ends)
    ends = F.when(F.size(ends) > 0, ends).otherwise(F.array(F.length(text)))
    starts = F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.size(ends) - 1))
    return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e")))


def locate(text: str | Column, quote: str | Column) -> Column:
    """Span (s, e) of the first occurrence of a quote, else of one that differs in white space only, else null."""
    text, quote = col(text), col(quote)
    at = F.instr(text, quote)
    exact = F.struct((at - 1).alias("s"), (at - 1 + F.length(quote)).alias("e"))
    solid = F.filter(F.sequence(F.lit(1), F.length(text)), lambda i: ~F.substr(text, i, F.lit(1)).rlike(r"(?U)\s"))
    packed, bare = F.regexp_replace(text, r"(?U)\s+", ""), F.regexp_replace(quote, r"(?U)\s+", "")
    j = F.instr(packed, bare)
    loose = F.struct((F.element_at(solid, j) - 1).alias("s"), F.element_at(solid, j + F.length(bare) - 1).alias("e"))
    return F.when(F.coalesce(F.length(quote), F.lit(0)) == 0, None).when(at > 0, exact).when((F.length(bare) > 0) & (j > 0), loose)


def trimmed(text: str | Column, s: str | Column, e: str | Column) -> Column:
    """The span without white space at its ends; null stays null, and a span of white space alone ends where it starts."""
    text, s, e = col(text), col(s), col(e)
    inner = F.substr(text, s + 1, e - s)
    left = F.length(F.regexp_extract(inner, r"(?U)^\s*", 0))
    right = F.length(F.regexp_extract(F.substr(inner, left + 1), r"(?U)\s*$", 0))
    return F.when(s.isNotNull(), F.struct((s + left).cast("int").alias("s"), (e - right).cast("int").alias("e")))


def joined_lines(lines: str | Column) -> Column:
    """Lines as one text: nothing between two Hangul syllables or after white space, else one blank. Empty lines don't count."""
    hangul = "[\uac00-\ud7a3]"

    def step(a: Column, x: Column) -> Column:
        tight = (a.rlike(f"{hangul}$") & x.rlike(f"^{hangul}")) | a.rlike(r"(?U)\s$") | (a == "")
        return F.concat(a, F.when(tight, "").otherwise(" "), x)

    return F.aggregate(F.filter(col(lines), lambda x: F.length(x) > 0), F.lit(""), step)


def readable(text: str | Column, s: str | Column, e: str | Column, whole_below: int = 70) -> Column:
    """A short text whole, else the sentence around a span, else, if that is over 160 wide, 20 on either side."""
    text, s, e = col(text), col(s), col(e)
    ends = F.transform(matches(text, "[.!?。\n·]", False), lambda m: m["s"])
    left = F.coalesce(F.array_max(F.filter(ends, lambda x: x < s)) + 1, F.lit(0))
    right = F.coalesce(F.array_min(F.filter(ends, lambda x: x >= e)) + 1, F.length(text))
    near = F.struct(F.greatest(F.lit(0), s - 20).alias("s"), F.least(F.length(text), e + 20).alias("e"))
    wide = F.struct(left.alias("s"), right.alias("e"))
    whole = F.struct(F.lit(0).alias("s"), F.length(text).alias("e"))
    bare = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.when(F.length(bare) <= whole_below, whole).when(right - left > 160, near).otherwise(wide)


def snippet(text: str | Column, s: str | Column, e: str | Column, pad: int = 55) -> Column:
    """The span with ``pad`` characters on either side, line breaks as blanks, an ellipsis where the text goes on."""
    text, s, e = col(text), col(s), col(e)
    lo, hi = F.greatest(F.lit(0), s - pad), F.least(F.length(text), e + pad)
    inner = F.replace(F.substr(text, lo + 1, hi - lo), F.lit("\n"), F.lit(" "))
    return F.concat(F.when(lo > 0, "…").otherwise(""), inner, F.when(hi < F.length(text), "…").otherwise(""))


def colour_grade(colour: str | Column) -> Column:
    """(grade, risk) of a highlight colour RRGGBB: the nearest hue of 52 (A), 190 (B), 10 and 320 (B with risk).

    Greys and what is no colour are B without risk.
    """
    c = F.upper(col(colour))
    r, g, b = (F.conv(F.substr(c, F.lit(i), F.lit(2)), 16, 10).cast("double") / 255 for i in (1, 3, 5))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span, light = top - low, (top + low) / 2
    saturation = F.when(span == 0, 0.0).when(light <= 0.5, span / (top + low)).otherwise(span / (2.0 - top - low))
    turn = F.when(span == 0, 0.0).when(r == top, (g - b) / span).when(g == top, 2.0 + (b - r) / span).otherwise(4.0 + (r - g) / span)
    hue = F.pmod(turn * 60, F.lit(360.0))
    far = lambda h: F.least(F.abs(hue - h), 360 - F.abs(hue - h))
    yellow, blue, red, pink = far(52.0), far(190.0), far(10.0), far(320.0)
    nearest = F.least(yellow, blue, red, pink)
    flat = ~c.rlike("^[0-9A-F]{6}") | c.isNull() | (saturation < 0.15)
    kind = F.when(flat, "B").when(yellow == nearest, "A").otherwise("B")
    risk = F.when(flat, False).otherwise((yellow > nearest) & (blue > nearest))
    return F.struct(kind.alias("grade"), F.coalesce(risk, F.lit(False)).alias("risk"))
