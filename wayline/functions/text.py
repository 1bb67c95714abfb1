"""Repairing, splitting and parsing recognised position lines.

Everything is a JVM expression. The parse cascade runs each pattern at most once
per line: a match is rewritten to its six captured groups in one
``regexp_replace``, and a later, looser pattern is tried only on lines that all
stricter ones missed.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------

_MARK = "\u0001"

# Literal corrections, applied in this order.
CORRECTIONS = [
    ("Zore:", "Zone:"),
    ("SolarSystern", "SolarSystem"),
    ("So1arSystem", "SolarSystem"),
    ("SovarSysten", "SolarSystem"),
    ("SolarSysten", "SolarSystem"),
    ("Camdir", "CamDir"),
    ("CarmDir", "CamDir"),
    ("CarnDir", "CamDir"),
    ("Cam0ir", "CamDir"),
    ("CarnOir", "CamDir"),
    ("RoetPos", "RootPos"),
    ("Roet_Pos", "Root_Pos"),
    ("R0ot", "Root"),
    ("Rcot", "Root"),
    ("GGC", "OOC"),
    ("Micratech", "Microtech"),
    ("Ooc ", "OOC "),
    ("00c ", "OOC "),
    ("O0c ", "OOC "),
    ("0oc ", "OOC "),
    ("Zone;", "Zone:"),
    ("Zane:", "Zone:"),
    ("Zane;", "Zone:"),
    ("Zose;", "Zone:"),
    ("Zaner", "Zone:"),
    ("Zoner", "Zone:"),
]

# Pattern and replacement of each normalisation step, applied in this order.
NORMAL_FORM = [
    (r"(?<=[^\s])([Pp]os:)", " $1"),
    (r"(Pos:?)[\s_]+", "$1 "),
    # A misread keyword is marked first; what it becomes depends on its terminator.
    (r"(?<![A-Za-z])[Pp9][0oOaA9qQ][sSa56]([:\s;,.!iI|]?)", _MARK + "$1"),
    (_MARK + r"[:;,.!iI|]", "Pos:"),
    (_MARK + r"[ \t]", "Pos "),
    (_MARK + r"\s?", "Pos"),
    (r"(?<=[\d.])[GO](?=[\d.])", "0"),
    (r"(?<=\d)[GO](?=\s*km)", "0"),
    (r"(?<=[\d.])Z(?=[\dk])", "2"),
    (r"(?<=[-\s])Z(?=\d)", "2"),
    (r"(?<=\d)k[^\s\-\d](?=[\s\-\d]|$)", "km"),
    (r"(?<=\d)k(?=[\s\-]|$)", "km"),
    (r"(?<=\dkm)[a-zA-Z0-9](?=\s|$)", ""),
    (r"(?<=[\d.])[lLiI1]?[kK][mMnNhH](?=[\s_\-\d]|$)", "km"),
    (r"km[\s_]+(-?\d)", "km $1"),
    (r"(?<=\d),(?=\d)", "."),
    (r"(?<=[-\s])J(?=\d)", "7"),
    (r"(?<=[\d.])Z(?=[\dk])", "2"),
    (r"(?<=[-\s])Z(?=\d)", "2"),
    (r"(\d)\s+\.(\d)", "$1.$2"),
    (r"(?<=\d)\s+(\d{3,4})(?=\s*km)", ".$1"),
    (r"(?<=\s)-\s+(?=\d+\.)", "-"),
    (r"(?<=[Pp]os:)(-?\d)", " $1"),
]

# What steps of the normal form would change. A line in which a group's pattern finds nothing is
# left as it is by each of its steps, so these are looked for first: most lines need few steps.
# The first letters ahead of a pattern let most places be passed over at once.
_KEY = "[Pp9][0oOaA9qQ][sSa56]"
_KEYWORD_STEPS, _CHARACTER_STEPS = slice(0, 6), slice(6, None)
_UNIT_STEPS, _COMMA_STEP, _SPACE_STEPS = slice(10, 14), slice(15, 16), (14, 19, 20, 21, 22)
# Steps 0-5: a glued keyword, one with other space than a blank behind it, a misread one, a mark.
_TOUCHES_KEYWORD = (rf"(?=[Pp9{_MARK}])(?:" r"[Pp]os:(?<=\S[Pp]os:)|Pos:?(?! (?![\s_]))[\s_]"
                    rf"|{_KEY}(?<![A-Za-z]{_KEY})(?:(?<!Pos)|(?=[^\S ]|[;,.!iI|]))|{_MARK})")
# Steps 6-9 and 16-18: letters in place of digits. Step 15, commas, leaves what step 14 looks at.
_TOUCHES_CHARACTERS = r"(?=[JZGO])(?:J|Z[\dk]|[GO](?<=[\d.][GO]))"
_TOUCHES_COMMAS = ","
# Steps 10-13: misread units. An amount that already ends in "km" is not one, but for a 1 before it.
_TOUCHES_UNITS = (r"(?=[lLiI1kK])(?:k(?<=\dk)(?:[^\s\-\dm](?=[\s\-\d]|$)|(?=[\s\-]|$)|m[a-zA-Z0-9](?=\s|$))"
                  r"|(?:[lLiI1](?<=[\d.][lLiI1])[kK][mMnNhH]|k(?<=[\d.]k)[MnNhH]|K(?<=[\d.]K)[mMnNhH])(?=[\s_\-\d]|$))")
# Steps 14 and 19-22: space inside and between amounts.
_TOUCHES_SPACE = r"(?=[k\s\-Pp])(?:km(?! -?\d)[\s_]+-?\d|\s(?<=\d\s)\s*[.\d]|-(?<=\s-)\s|[Pp]os:-?\d)"

# One axis: kilometres with 3-4 decimals or metres with 1-2. The last axis may
# have lost its right edge and then keeps 2-4 decimals.
_AXIS = r"(?:(-?\d+\.\d{3,4})\s*km|(-?\d+\.\d{1,2})\s*m(?!k))"
_AXIS_CUT = r"(?:(-?\d+\.\d{2,4})\s*km|(-?\d+\.\d{1,2})\s*m(?!k))"
STRICT = rf"pos:?\s*{_AXIS}\s*{_AXIS}\s*{_AXIS}"
RELAXED = rf"pos:?\s*{_AXIS}\s*{_AXIS}\s*{_AXIS_CUT}"
HEADLESS = rf"{_AXIS}\s*{_AXIS}\s*{_AXIS_CUT}"
ZONE_HINT = (r"(?i)(?:[t5]\w{1,5}t[ao0]\w*?[n0o]|[ao4][r5]c\w?[cC50]\w*"
             r"|microt|hurst|crusad|cellin|stanton|tanton)")
# What a line must hold for the patterns above, and for the one below, to match at all.
THREE_DECIMALS = r"(?s)\.\d.*\.\d.*\.\d"
SIX_DIGITS = r"\d{6}"
UNDOTTED = r"(?i)(-?)(\d{6,9})\s*km"
ABSOLUTE_FRAME = r"(?i)(?=[rs])(?:(?<![a-zA-Z])r[o0e]{1,3}t(?![a-zA-Z])|solar\s*system)"
SYSTEM_ID = r"(?i)Zone:\s*SolarSystem[_-]?([\d\w]+?)(?:Pos|Zone|$|\s)"
ZONE_NAME = r"(?i)^(.*?)\s*pos:?\s*"
POS_LIKE = r"(?i)(?<![A-Za-z])[Pp9][0oOaA9qQ][sSa56][:\s;,.!iI|\-]"
METRE_SUBZONE = r"[Pp][0oOa9q][sSa56][:\s].*\d+\.?\d*\s*m\b"
PARTIAL_LINE = r"[Pp9][0oOaA9qQ][sSa56][:\s]\s*-?\d+\.\d|[Pp]os:?\s*-?\d+\.\d"

# Known system identifiers; the first entry that fits wins.
SYSTEM_NAMES = [("9948564368677", "Stanton"), ("Stanton", "Stanton")]

# Largest plausible coordinate in km.
COORD_MAX_KM = 30_000.0

# Tokens that make a transcript worth keeping.
USEFUL_TOKENS = "pos|zone|cam|fov|km"
KM_AMOUNT = r"(?i)\d+\.\d+\s*km\b"
METRE_AMOUNT = r"(?i)\d+\.\d+\s*m\b(?!\s*k)"


# ---------------------------------------------------------------------------
# Line level
# ---------------------------------------------------------------------------

def _any_literal(words: list[str]) -> str:
    """Pattern of any of ``words``, tried by first letter."""
    heads = sorted({w[0] for w in words})
    some = "|".join(f"{h}(?:{'|'.join(re.escape(w[1:]) for w in words if w[0] == h)})" for h in heads)
    return f"(?=[{''.join(heads)}])(?:{some})"


def correct_literals(text: Column) -> Column:
    wrong = _any_literal([pair[0] for pair in CORRECTIONS])
    return let(text, lambda t: F.when(t.rlike(wrong), reduce(
        lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), CORRECTIONS, t)).otherwise(t))


def normalize_line(line: Column) -> Column:
    """All steps of ``NORMAL_FORM`` in order; a group of steps runs only on lines that it changes."""
    def stepped(text: Column, steps: list) -> Column:
        return reduce(lambda c, step: F.regexp_replace(c, step[0], step[1]), steps, text)

    def where(text: Column, touches: str, steps: list) -> Column:
        return let(text, lambda t: F.when(t.rlike(touches), stepped(t, steps)).otherwise(t))

    def rest(text: Column) -> Column:
        dotted = where(where(text, _TOUCHES_UNITS, NORMAL_FORM[_UNIT_STEPS]), _TOUCHES_COMMAS, NORMAL_FORM[_COMMA_STEP])
        common = where(dotted, _TOUCHES_SPACE, [NORMAL_FORM[i] for i in _SPACE_STEPS])
        return F.when(text.rlike(_TOUCHES_CHARACTERS), stepped(text, NORMAL_FORM[_CHARACTER_STEPS])).otherwise(common)

    return let(where(line, _TOUCHES_KEYWORD, NORMAL_FORM[_KEYWORD_STEPS]), rest)


def in_range(x: Column, y: Column, z: Column) -> Column:
    limit = F.lit(COORD_MAX_KM)
    return (F.abs(x) < limit) & (F.abs(y) < limit) & (F.abs(z) < limit)


def is_absolute_frame(line: Column) -> Column:
    return line.rlike(ABSOLUTE_FRAME)


def is_metre_line(line: Column) -> Column:
    return (~line.rlike(KM_AMOUNT)) & line.rlike(METRE_AMOUNT)


def is_position_line(line: Column) -> Column:
    return F.lower(line).contains("pos:") & ~is_system_line(line)


def is_system_line(line: Column) -> Column:
    return line.contains("Zone:") & line.contains("SolarSystem")


def zone_name(line: Column) -> Column:
    found = F.trim(F.regexp_extract(line, ZONE_NAME, 1))
    return F.when(found == "", F.lit("Unknown")).otherwise(found)


def system_id(line: Column) -> Column:
    found = F.trim(F.regexp_extract(line, SYSTEM_ID, 1))
    return F.when(found == "", F.lit(None)).otherwise(found)


def system_location(found: Column) -> Column:
    """Name of the first known system whose id contains, or is contained in, ``found``."""
    out = None
    for known, name in SYSTEM_NAMES:
        fits = found.contains(known) | F.lit(known).contains(found)
        out = F.when(fits, F.lit(name)) if out is None else out.when(fits, F.lit(name))
    return F.when(found.isNotNull(), out.otherwise(F.lit("Unknown")))


def looks_useful(text: Column) -> Column:
    return (F.length(text) >= 3) & (text.rlike(r"\d") | F.lower(text).rlike(USEFUL_TOKENS))


def is_supported_label(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\A[\x20-\x7E\t]+\z"), F.lit(False))


def fits_media(width: Column, text: Column, px_per_char: int = 20) -> Column:
    return width.isNull() | (width >= px_per_char * F.length(text))


def partial_count(line: Column) -> Column:
    """Number of decimals on a line that looks like a position, else 0."""
    return F.when(line.rlike(PARTIAL_LINE), F.regexp_count(line, F.lit(r"-?\d+\.\d{2,4}"))
                  ).otherwise(F.lit(0))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# Fixed value: all characters that count as white space.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(value: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(value, F.lit(WHITE))


def without_spaces(value: Column) -> Column:
    """Without space characters at both ends; tabs and other controls stay, as SQL's ``trim`` leaves them."""
    return F.regexp_replace(value, r"\A\p{Zs}+|\p{Zs}+\z", "")


def position(line: Column) -> Column:
    """``{x, y, z, method}`` of a line in normal form; null when nothing matches.

    Methods, strictest first: strict, relaxed, headless, decimal_recovery. A
    looser pattern runs only on lines every stricter one missed.
    """
    marks = "".join(f"{_MARK}${i}" for i in range(1, 7))

    def axis(parts: Column, i: int) -> Column:
        km, m = parts[2 * i + 1], parts[2 * i + 2]
        return F.when(km != "", km.try_cast("double")).otherwise(m.try_cast("double") / 1000.0)

    def matched(text: Column, pattern: str, method: str) -> Column:
        found = F.regexp_replace(text, rf"(?is)\A.*?{pattern}.*\z", marks)
        return let(found, lambda g: F.when(g.startswith(_MARK), let(
            F.split(g, _MARK), lambda p: F.struct(
                axis(p, 0).alias("x"), axis(p, 1).alias("y"), axis(p, 2).alias("z"),
                F.lit(method).alias("method")))))

    def undotted(sign: Column, digits: Column) -> Column:
        amount = digits.try_cast("double") / 10000.0
        return F.when(amount < COORD_MAX_KM, F.when(sign == "-", -amount).otherwise(amount))

    def rescued(text: Column) -> Column:
        digits = F.regexp_extract_all(text, F.lit(UNDOTTED), F.lit(2))
        signs = F.regexp_extract_all(text, F.lit(UNDOTTED), F.lit(1))

        def built(d: Column) -> Column:
            return let(signs, lambda s: F.struct(
                undotted(s[0], d[0]).alias("x"), undotted(s[1], d[1]).alias("y"),
                undotted(s[2], d[2]).alias("z"), F.lit("decimal_recovery").alias("method")))

        found = let(digits, lambda d: F.when(F.size(d) >= 3, built(d)))
        return let(found, lambda p: F.when(
            p["x"].isNotNull() & p["y"].isNotNull() & p["z"].isNotNull(), p))

    def cascade(text: Column) -> Column:
        headless = let(matched(text, HEADLESS, "headless"), lambda p: F.when(
            in_range(p["x"], p["y"], p["z"]), p))
        dotted = F.coalesce(matched(text, STRICT, "strict"), matched(text, RELAXED, "relaxed"),
                            F.when(text.rlike(ZONE_HINT), headless))
        return F.coalesce(F.when(text.rlike(THREE_DECIMALS), dotted), F.when(text.rlike(SIX_DIGITS), rescued(text)))

    return let(line, cascade)


def reading(text: Column) -> Column:
    """Correct, classify and parse one line: the fields of ``reading_of``."""
    return let(correct_literals(text), reading_of)


def reading_of(line: Column) -> Column:
    """Classify and parse one corrected line.

    ``{fixed, is_position, location, ooc, x, y, z, method, accepted}``. Only lines
    that may be positions are normalised and parsed.
    """
    def described(fixed: Column) -> Column:
        usable = is_position_line(fixed) & ~is_absolute_frame(fixed)
        return let(usable, lambda ok: let(
            F.when(ok, position(normalize_line(fixed))), lambda p: F.struct(
                fixed.alias("fixed"), ok.alias("is_position"),
                F.when(is_system_line(fixed), let(system_id(fixed), system_location)).alias("location"),
                F.when(ok, zone_name(fixed)).alias("ooc"),
                p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"), p["method"].alias("method"),
                F.coalesce(in_range(p["x"], p["y"], p["z"]), F.lit(False)).alias("accepted"))))

    return let(line, described)


def with_parsed(df: DataFrame, line: str, parse, keep: str) -> DataFrame:
    """Attach ``parse(line)`` as column ``keep``.

    Goes through a one-element generator, so that a later filter on the outcome
    is not pushed below the parse and does not repeat it.
    """
    return df.select("*", F.explode_outer(F.transform(F.array(F.col(line)), parse)).alias(keep))


def parse_position(df: DataFrame, line: str, keep: str = "pos") -> DataFrame:
    return with_parsed(df, line, position, keep)


# ---------------------------------------------------------------------------
# Text level
# ---------------------------------------------------------------------------

def rejoin_orphans(text: Column) -> Column:
    """Glue position values back to the ``Pos:`` line they were split from.

    Every line first gets its own appetite, how many following lines it would
    absorb, from itself and the next two lines only. One fold over the lines then
    skips what an earlier line has taken.
    """
    def decimals(s: Column) -> Column:
        return F.regexp_count(s, F.lit(r"-?\d+\.\d{1,4}"))

    def follows(s: Column) -> Column:
        return s.rlike(r"^-?\d") & (decimals(s) > 0)

    def described(line: Column, head: Column, one: Column, two: Column) -> Column:
        empty_marker = F.lower(head).endswith("pos:") & one.rlike(r"\d")
        metres = ~F.lower(head).contains("km") & head.rlike(METRE_SUBZONE)
        takes_one = follows(one) & head.rlike(POS_LIKE) & ~metres & (decimals(head) < 3)
        takes_two = (decimals(head) + decimals(one) < 3) & follows(two)
        appetite = F.when(empty_marker, 1).when(takes_one, F.when(takes_two, 2).otherwise(1)).otherwise(0)
        appetite = F.when(one == "", 0).otherwise(appetite)
        return let(appetite, lambda n: F.struct(n.alias("n"), F.when(n == 2, F.concat_ws(" ", head, one, two))
                   .when(n == 1, F.concat_ws(" ", head, one)).otherwise(line).alias("t")))

    start = F.struct(F.lit(0).alias("skip"), F.array().cast("array<string>").alias("out"))

    def fold(acc: Column, item: Column) -> Column:
        return F.when(acc["skip"] > 0, F.struct((acc["skip"] - 1).alias("skip"), acc["out"].alias("out"))
                      ).otherwise(F.struct(item["n"].alias("skip"),
                                           F.concat(acc["out"], F.array(item["t"])).alias("out")))

    def joined(lines: Column) -> Column:
        def at(i: Column) -> Column:
            return F.coalesce(stripped(F.get(lines, i)), F.lit(""))
        told = F.transform(lines, lambda line, i: let(
            F.struct(F.rtrim(line, F.lit(WHITE)).alias("h"), at(i + 1).alias("o"), at(i + 2).alias("t")),
            lambda n: described(line, n["h"], n["o"], n["t"])))
        return F.array_join(F.aggregate(told, start, fold)["out"], "\n")

    # A single line and a text without any position-like token have nothing to rejoin.
    def rejoined(t: Column) -> Column:
        touched = t.contains("\n") & (F.lower(t).contains("pos:") | t.rlike(POS_LIKE))
        return F.when(touched, let(F.split(t, "\n"), joined)).otherwise(t)

    return let(text, rejoined)


def trimmed_lines(text: Column) -> Column:
    """The non-blank trimmed lines in order; null without a text."""
    return F.filter(F.transform(F.split(text, "\n"), stripped), lambda line: line != "")


def text_lines(df: DataFrame, text: str, line: str = "line", number: str = "line_no") -> DataFrame:
    """One row per non-blank trimmed line."""
    others = [c for c in df.columns if c != text]
    return (df.select(*others, F.posexplode(F.split(text, "\n")).alias(number, line))
            .withColumn(line, stripped(F.col(line))).filter(F.col(line) != ""))


# ---------------------------------------------------------------------------
# Names and paths
# ---------------------------------------------------------------------------

def file_stem(path: Column) -> Column:
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(base.rlike(r"^.+\.[^.]+$"), F.regexp_extract(base, r"^(.+)\.[^.]*$", 1)
                  ).otherwise(base)


def source_prefix(stem: Column) -> Column:
    """Stem without its last two ``_`` parts, null when it has fewer than three."""
    found = F.regexp_extract(stem, r"^(.*)_[^_]*_[^_]*$", 1)
    return F.when(stem.rlike(r"_[^_]*_"), found)


# Characters that get a spelled-out folder name. Capital letters
# follow the rule "_up" + letter.
FOLDER_NAMES = {
    "/": "_slash",
    "\\": "_bslash",
    ":": "_colon",
    "*": "_star",
    "?": "_qmark",
    '"': "_dquote",
    "<": "_lt",
    ">": "_gt",
    "|": "_pipe",
    ".": "_dot",
    "-": "_dash",
    " ": "_space",
}


def _pairs(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])


def encode_label(char: Column) -> Column:
    capital = char.rlike("^[A-Z]$")
    return F.when(capital, F.concat(F.lit("_up"), char)).otherwise(
        F.coalesce(F.try_element_at(_pairs(FOLDER_NAMES), char), char))


def decode_label(folder: Column) -> Column:
    names = {v: k for k, v in FOLDER_NAMES.items()}
    return F.when(folder.rlike("^_up[A-Z]$"), F.substring(folder, 4, 1)).otherwise(
        F.coalesce(F.try_element_at(_pairs(names), folder), folder))


def content_digest(data: Column, short: bool = False) -> Column:
    return F.substring(F.sha1(data), 1, 8) if short else F.sha2(data, 256)


VERSION = r"^v?(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)$"


def normalize_version(text: Column) -> Column:
    return F.when(text.rlike(VERSION), F.regexp_replace(text, "^v", ""))


def version_key(text: Column) -> Column:
    """Comparable ``{major, minor, patch}``; null when not strictly X.Y.Z."""
    parts = F.split(normalize_version(text), r"\.")
    return F.when(text.rlike(VERSION), F.struct(
        parts[0].cast("bigint").alias("major"), parts[1].cast("bigint").alias("minor"),
        parts[2].cast("bigint").alias("patch")))


def canonical_label(x: Column, y: Column, z: Column) -> Column:
    return F.when(x.isNotNull() & y.isNotNull() & z.isNotNull(), F.format_string(
        "Pos:%.4fkm %.4fkm %.4fkm", x, y, z))
