"""String functions of the corpus job.

Every function maps a Column to a Column and stays inside the JVM, so a scan
followed by any chain of them is one narrow stage.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofmill import constants as C

_BLANKS = " \t\r\n\x0b\x0c"

# First and later signs of an ASCII name, each told one by one: such a class is one look into a table, while every range or
# named class in it is a step of its own.
FIRST = f"[{string.ascii_letters}_$]"
LATER = f"[{string.ascii_letters}{string.digits}_$]"

# One Java token per match.  Comments are matched too, to be dropped, and the
# last branch takes any other visible character so that a bad one is noticed.
TOKEN_BRANCHES = (
    r"//[^\n]*",
    r"/\*(?s:.*?)\*/",
    r'"(?:[^"\\\n]|\\.)*{p}"',
    r"'(?:[^'\\\n]|\\.)+{p}'",
    r"0[xX][0-9a-fA-F_]+[lL]?",
    r"0[bB][01_]+[lL]?",
    r"(?:[0-9][0-9_]*(?:\.[0-9_]*)?|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9]+)?[fFdDlL]?",
    r"[\p{L}_$][\p{L}\p{N}_$]*",
    r">>>=|<<=|>>=|>>>|\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|&=|\|=|\^=|%=|<<|>>",
    r"[^\s]",
)
# What stands above a token, and the token or the end.  The branches begin with different signs, so what is frequent may be
# tried first: the ASCII part of a name, in a fast loop, and signs that begin nothing longer. Operators go by their first sign.
_ABOVE_TOKEN = r"\s*(?:(?://[^\n]*|/\*(?s:.*?)\*/)\s*)*+"
_OPERATORS = (
    r"\.(?:\.\.)?+", r"={1,2}+", r"\+[+=]?+", r"-[>=-]?+", r">{1,3}+=?+", r"<{1,2}+=?+", r"&[&=]?+", r"\|[|=]?+", r":{1,2}+", r"[!*/^%]=?+",
)
TO_TOKEN = (
    _ABOVE_TOKEN + rf"(?:({FIRST}{LATER}*" + r"(?:[\p{L}\p{N}_$]+)?|[(){}\[\];,@?~]|"
    + "|".join((*TOKEN_BRANCHES[4:7], *_OPERATORS, *TOKEN_BRANCHES[2:4], TOKEN_BRANCHES[7], TOKEN_BRANCHES[9])).replace("{p}", "+") + r")|\z)"
)
# ASCII signs that a bad token may begin with; most code has none.
_DOUBTFUL = "[\"'#`\\\\" + "".join(f"\\x{n:02X}" for n in (*range(9), *range(14, 32), 127)) + "]"
# A bad token is a single sign, and no token but a comment holds a line end.
BAD_LINE = r"""(?:^|\n)(?:["'#`\\]|[^\x00-\x7F\p{L}]|[\x00-\x08\x0E-\x1F\x7F])(?:\n|\z)"""
BAD_TOKEN = r"""^(?:["'#`\\]|[^\x00-\x7F\p{L}].*|[\x00-\x08\x0E-\x1F\x7F])$"""


# Possessive loops: they neither backtrack nor grow the stack on long literals. What is a single class inside one
# is left greedy, as it then runs in a tight loop and cannot give anything back.
OPAQUE = (
    r'"(?:[^"\\\n]+|\\.)*+"'
    r"|'(?:[^'\\\n]+|\\.)++'"
    r"|//[^\n]*"
    r"|/\*(?s:.*?)(?:\*/|\z)"
)
PIECES = OPAQUE + r"|[^\"'/]+|[\"'/]"


def lies_in(path: Column, folder: str) -> Column:
    """Whether a path is project/folder/..., not only somewhere below."""
    return F.startswith(F.substring(path, F.instr(path, "/"), F.length(path)), F.lit(f"/{folder}/"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Work ``value`` out once and use it several times inside an expression.

    The value is what a fold over nothing begins with, as a transform would copy the whole result once more.
    """
    return F.aggregate(F.array(), value, lambda acc, _: acc, body)


def strip(text: Column) -> Column:
    """Drop white space on both ends."""
    return F.btrim(text, F.lit(_BLANKS))


def strip_modifiers(code: Column) -> Column:
    first = "".join(sorted({m[0] for m in C.MODIFIERS}))  # looked at first, as that is quick
    return F.regexp_replace(code, rf"(?=[{first}])\b(" + "|".join(C.MODIFIERS) + r")\b", "")


def space_symbols(code: Column) -> Column:
    return F.regexp_replace(code, "(" + C.SPACED_SYMBOLS + ")", " $1 ")


def collapse_whitespace(code: Column) -> Column:
    return F.trim(F.regexp_replace(code, r"\s+", " "))


def normalize_chars(code: Column) -> Column:
    """Modifiers out, symbols spaced, white space collapsed."""
    return collapse_whitespace(space_symbols(strip_modifiers(code)))


def normalize_tokens(code: Column, drop_access: bool = False) -> Column:
    """Java tokens joined by one space; text that does not lex is kept as it is."""
    def render(both: Column) -> Column:
        source, lines = both["code"], both["lines"]
        joined = F.replace(F.rtrim(lines, F.lit("\n")), F.lit("\n"), F.lit(" "))
        if drop_access:
            joined = F.regexp_replace(joined, r"(?=p)\b(" + "|".join(C.ACCESS_MODIFIERS) + r")\s+", "")
        plain = (F.octet_length(source) == F.length(source)) & ~source.rlike(_DOUBTFUL)
        lexes = plain | ~lines.rlike(BAD_LINE)
        return F.when(lexes & (strip(source) != ""), joined).otherwise(source)

    # One token to a line. The code goes in as a value: a column named inside a lambda may be taken
    # for an alias of the same select.
    return let(code, lambda c: let(F.struct(c.alias("code"), F.regexp_replace(c, TO_TOKEN, "$1\n").alias("lines")), render))


def strip_semicolon(assertion: Column) -> Column:
    """Trailing white space, then trailing semicolons."""
    return F.regexp_replace(F.regexp_replace(assertion, r"\s+$", ""), r";+$", "")


def strip_semicolon_run(assertion: Column) -> Column:
    """Any trailing mix of blanks and semicolons."""
    return F.regexp_replace(assertion, r"[ ;]+$", "")


def line_comments_out(code: Column) -> Column:
    """Blank ``//`` comments outside literals and block comments; every other character keeps its place."""
    pieces = F.regexp_extract_all(code, F.lit(PIECES), F.lit(0))
    return F.array_join(
        F.transform(
            pieces, lambda p: F.when(p.startswith("//"), F.repeat(F.lit(" "), F.length(p))).otherwise(p)
        ), ""
    )


def first_assertion(code: Column, skip_comments: bool = False) -> Column:
    """First assertion, shortest reading; empty when there is none.

    The pattern cannot cross a line end, so one search over the whole text
    finds the same match as a line-by-line search.
    """
    source = line_comments_out(code) if skip_comments else code
    return F.regexp_extract(source, C.SHORT_ASSERTION, 0)


def longest_assertion(code: Column, skip_comments: bool = False) -> Column:
    """First line with an assertion, longest reading on it; empty when none."""
    source = line_comments_out(code) if skip_comments else code
    return F.regexp_extract(source, C.LONG_ASSERTION, 0)


def place_of(code: Column, part: Column, skip_comments: bool = False) -> Column:
    """Where ``part`` first stands in the code, from 1; with ``skip_comments`` not counting what is commented out."""
    return F.instr(line_comments_out(code) if skip_comments else code, part)


def before(text: Column, part: Column, skip_comments: bool = False) -> Column:
    """Text in front of the first occurrence of ``part``."""
    return F.substring(text, F.lit(1), place_of(text, part, skip_comments) - 1)


def prefix_lines(code: Column, assertion: Column, searched: Column | None = None) -> Column:
    """Stripped lines above the line that holds ``assertion``, joined by a blank.

    ``searched`` is the text to look in if it is not the code itself, of the same length.
    """
    at = F.instr(code if searched is None else searched, assertion)
    lines = F.split(F.substring(code, F.lit(1), at - 1), "\n", -1)
    above = F.slice(lines, F.lit(1), F.size(lines) - 1)
    return F.array_join(F.transform(above, strip), " ")


def package_name(code: Column) -> Column:
    """Package of the first package line; empty for the default package."""
    return F.regexp_extract(code, r"(?m)^[^\S\n]*" + C.PACKAGE.replace(r"\s", r"[^\S\n]"), 1)


def import_entries(code: Column) -> Column:
    """Array of (simple, fqn), one per simple name; a later line wins."""
    lines = F.regexp_extract_all(code, F.lit(r"(?dm)^[ \t\r\x0B\f]*+(import[^\n]*+)"), F.lit(1))
    fqns = F.transform(lines, lambda s: F.regexp_extract(F.btrim(strip(s), F.lit(";")), r"(\S+)\s*$", 1))
    pairs = F.transform(
        fqns, lambda q: F.struct(F.substring_index(q, ".", -1).alias("simple"), q.alias("fqn"))
    )

    def last_of_each(entries: Column) -> Column:
        names = F.array_distinct(F.transform(entries, lambda p: p["simple"]))
        return F.transform(
            names, lambda n: F.element_at(F.filter(entries, lambda p: p["simple"] == n), -1)
        )

    return let(pairs, last_of_each)


def exception_label(code: Column, skip_comments: bool = False) -> Column:
    """True when a ``fail(...)`` stands in front of a ``} catch``."""
    source = line_comments_out(code) if skip_comments else code
    return source.rlike(C.FAIL_THEN_CATCH)


def test_name(code: Column) -> Column:
    return F.regexp_extract(code, C.TEST_NAME, 1)


def render_sample(prefix: Column, focal: Column) -> Column:
    """Prefix, assertion placeholder and focal method on one line."""
    return F.concat(
        prefix, F.lit(f" {C.ASSERT_PLACEHOLDER} ; }} {C.FOCAL_MARKER} "), focal
    )


def retrieval_prefix(code: Column) -> Column:
    """Turn a test method into a retrieval prefix.

    Test annotation, ``try {``, ``fail(...)`` and the trailing catch go; the
    first assertion, or the end of the body when there is none, becomes the
    placeholder and the text is closed with a bracket.
    """
    no_annotation = F.regexp_replace(code, r"@Test\b(?:\s*\([^()]*\))?", "")
    no_try = F.regexp_replace(no_annotation, r"\btry\s*\{", "")
    no_fail = F.regexp_replace(no_try, r"\bfail\([^\n]*\);", "")
    no_catch = F.regexp_replace(no_fail, r"(?s)\}\s*catch\s*\(.*$", "")
    assertion = first_assertion(no_catch)
    head = F.when(assertion != "", before(no_catch, assertion)).otherwise(
        F.regexp_replace(no_catch, r"\s*\}\s*$", "")
    )
    return normalize_chars(head)


def retrieval_query(code: Column, focal: Column) -> Column:
    """Query line for retrieval: prefix, placeholder, closing bracket, focal."""
    return render_sample(retrieval_prefix(code), normalize_chars(focal))
