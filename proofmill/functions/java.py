"""Row-local reading of Java text.

A file is one row, so methods are cut out of it without a shuffle: the text is
read brace by brace, stepping over literals and comments, with a running depth;
only the heads of members are looked at more closely, and every member found
keeps its offsets into the original text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofmill import constants as C
from proofmill.functions.text import FIRST, LATER, OPAQUE, PIECES, let, line_comments_out, strip

# Everything up to and with the next brace that is code.  The anchor keeps a text
# without further braces from being tried again at every character.
_PLAIN = r"[^{}\"'/]+|" + OPAQUE + r"|[\"'/]"
_TO_BRACE = r"\G(?:" + _PLAIN + r")*+[{}]"


def _closed(levels: int) -> str:
    """A block of braces that closes and holds blocks of so many levels at most."""
    return r"\{(?:" + _PLAIN + ("|" + _closed(levels - 1) if levels else "") + r")*+\}"


# The same after the first brace, but a whole block in one piece; a deeper one, or one that never closes, goes brace by brace.
_TO_MEMBER = r"\A(?:" + _PLAIN + r")*+[{}]|\G(?:" + _PLAIN + r")*+(?:" + _closed(8) + r"|[{}])"
_EVEN = r"^[^{}]*+"
for _ in range(8):
    _EVEN = r"^[^{}]*+(?:\{" + _EVEN[1:] + r"\}[^{}]*+)*+"
_EVEN += r"\z"
_TYPE = rf"(?=[cier])\b(?:class|interface|enum|record)\s+({FIRST}{LATER}*)"
_PARAMS = r"\((?:[^()]|\([^()]*+\))*+\)"
_SIGNATURE = (
    rf"(?={FIRST})(?<!{FIRST})({FIRST}{LATER}*+)\s*+" + _PARAMS
    + r"\s*(?:\[\s*\]\s*)*+(?:throws\s[\w$.,<>\s?&\[\]@]++)?[{;]$"
)
_LEAD = (
    r"^(?:[\s)]++|@(?!interface\b)[\w$.]++(?:\s*+" + _PARAMS + r")?+|(?:"
    + "|".join(C.MODIFIERS) + r"|default)\b)*+"
)
_BARE_NAME = rf"^(?:<[^<>]*>\s*)?({FIRST}{LATER}*)\s*\("
_DOC = r"/\*\*(?!/)(?s:.*?)\*/"
# A call or a creation, not the head of a method that an anonymous class declares.
_CALL = (
    rf"(?={FIRST})\b(?<!super\.)({FIRST}{LATER}*+)\s*+\("
    r"(?:(?![^()]*\)\s*(?:throws\s[^(){};]*)?\{)|(?<=\bnew [\w$]{1,250}\())"  # the long look back last
)
_NOT_CALLS = (
    "if", "for", "while", "switch", "catch", "synchronized", "return", "super", "this",
    "try", "throw", "case", "new", "else", "do",
)

def blank_literals(code: Column) -> Column:
    """Blank strings, character literals and comments, keeping length and line ends."""
    def blank(p: Column) -> Column:
        opaque = p.startswith('"') | p.startswith("'") | p.startswith("//") | p.startswith("/*")
        # Many signs at once, then what is left of each line.
        lines = F.regexp_replace(F.regexp_replace(p, r"[^\n]{16}", " " * 16), r"[^\n ]", " ")
        lines = F.when(p.contains("\n"), lines).otherwise(F.repeat(F.lit(" "), F.length(p)))
        return F.when(opaque, lines).otherwise(p)

    def blanked(c: Column) -> Column:
        pieces = F.array_join(F.transform(F.regexp_extract_all(c, F.lit(PIECES), F.lit(0)), blank), "")
        return F.when(c.contains('"') | c.contains("'") | c.contains("/"), pieces).otherwise(c)

    return let(code, blanked)


def _newlines(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))


def _after_newline(text: Column) -> Column:
    return F.length(F.substring_index(text, "\n", -1))


# turn: 1 opens, -1 closes, 0 is a whole block; depth and line (from 1) before piece i, which has so many line ends; its text
# up to its first brace.
_EVENTS = "array<struct<turn:int,depth:int,i:int,line:int,lines:int,head:string>>"
# Pieces that are folded into one array: appending copies the array, so it has to stay short.
_BLOCK = 128
# A length that reaches to the end of any text.
_TO_END = 2**31 - 1


def _step(acc: Column, piece: Column) -> Column:
    turn, depth = piece["turn"], acc["depth"]
    event = F.struct(
        turn.alias("turn"), depth.alias("depth"), piece["i"].alias("i"), acc["line"].alias("line"), piece["lines"].alias("lines"),
        piece["head"].alias("head"),
    )
    kept = F.when(turn == 0, depth == 1).otherwise(depth * 2 <= 3 - turn)
    return F.struct(
        (acc["line"] + piece["lines"]).alias("line"), F.when(depth < 0, depth).otherwise(depth + turn).alias("depth"),
        F.when(kept, F.array_append(acc["events"], event)).otherwise(acc["events"]).alias("events"),
    )


def _folded(pieces: Column) -> Column:
    """Final depth and events of pieces (turn, i, lines, head), folded block by block, so that the work grows in proportion."""
    state = f"struct<line:int,depth:int,events:{_EVENTS}>"
    none = F.array().cast(_EVENTS)

    def fold(acc: Column, block: Column) -> Column:
        begin = F.struct(acc["line"], acc["depth"], none.alias("events"))
        return let(
            F.aggregate(block, begin, _step),
            lambda end: F.struct(
                end["line"].alias("line"), end["depth"].alias("depth"),
                F.concat(acc["blocks"], F.array(end["events"])).alias("blocks"),
            ),
        )

    last = F.floor((F.size(pieces) - 1) / _BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(pieces, b * _BLOCK + 1, F.lit(_BLOCK)))
    begin = F.expr("named_struct('line', 1, 'depth', 0, 'events', array())").cast(state)
    many = F.expr("named_struct('line', 1, 'depth', 0, 'blocks', array())").cast(f"struct<line:int,depth:int,blocks:array<{_EVENTS}>>")
    return F.when(F.size(pieces) > _BLOCK, let(
        F.aggregate(blocks, many, fold),
        lambda end: F.struct(end["line"].alias("line"), end["depth"].alias("depth"), F.flatten(end["blocks"]).alias("events")),
    )).otherwise(F.aggregate(pieces, begin, _step))


def read_structure(code: Column) -> Column:
    """Cut a file into pieces, and fold these into its final depth and the braces near the top.

    A piece is the text up to a brace.  Where the first brace opens a type, a later block is one piece with the text
    before it, so that what lies inside the body of a method is passed over as a whole.  An event is a piece that ends
    or holds a brace of file or type level, with its text up to its first brace.  ``top`` is the blanked head of a type
    that the first brace opens.  A depth that fell below zero stays there.
    """
    def top_of(pieces: Column) -> Column:
        first = F.try_element_at(pieces, F.lit(1))
        return let(F.when(first.endswith("{"), blank_literals(first)), lambda head: F.when(head.rlike(_TYPE), head))

    def cut(x: Column) -> Column:
        return F.struct(
            x["top"].alias("top"),
            F.when(x["top"].isNotNull(), x["pieces"]).otherwise(F.regexp_extract_all(x["code"], F.lit(_TO_BRACE), F.lit(0))).alias("pieces"),
        )

    def folded(x: Column) -> Column:
        def turned(s: Column, i: Column) -> Column:
            whole = x["top"].isNotNull() & s.endswith("}")
            return let(
                F.when(whole, F.regexp_extract(s, _TO_BRACE, 0)).otherwise(s),
                lambda head: F.struct(
                    F.when(s.endswith("{"), 1).when(head.endswith("{"), 0).otherwise(-1).alias("turn"), i.alias("i"),
                    _newlines(s).alias("lines"), head.alias("head"),
                ),
            )

        return let(
            let(F.transform(x["pieces"], turned), _folded),
            lambda end: F.struct(
                end["depth"].alias("depth"), end["events"].alias("events"), x["pieces"].alias("pieces"), x["top"].alias("top"),
            ),
        )

    found = let(
        F.regexp_extract_all(code, F.lit(_TO_MEMBER), F.lit(0)),
        lambda pieces: F.struct(code.alias("code"), pieces.alias("pieces"), top_of(pieces).alias("top")),
    )
    return let(let(found, cut), folded)


def first_type(structure: Column) -> Column:
    """Head of the first type of a file and its events (start and number); NULL when none."""
    heads = F.filter(
        F.transform(
            structure["events"],
            lambda e, i: F.when(
                (e["turn"] == 1) & (e["depth"] == 0),
                F.struct(i.alias("at"), blank_literals(e["head"]).alias("head")),
            ),
        ),
        lambda h: h["head"].rlike(_TYPE),
    )
    first = F.when(
        structure["top"].isNotNull(), F.struct(F.lit(0).alias("at"), structure["top"].alias("head"))
    ).otherwise(F.try_element_at(heads, F.lit(1)))
    ends = F.filter(
        F.transform(
            structure["events"],
            lambda e, i: F.when((e["turn"] == -1) & (e["depth"] == 1), i),
        ),
        lambda i: i.isNotNull(),
    )
    return let(
        F.struct(first.alias("h"), ends.alias("ends")),
        lambda x: F.when(
            x["h"].isNotNull(),
            F.struct(
                x["h"]["head"].alias("head"), x["h"]["at"].alias("at"),
                F.try_element_at(F.filter(x["ends"], lambda i: i > x["h"]["at"]), F.lit(1))
                .alias("end"),
            ),
        ),
    )


def parses(structure: Column, kind: Column) -> Column:
    """A file counts as readable when it holds a type and its braces balance."""
    return kind.isNotNull() & (structure["depth"] == 0)


def type_name(kind: Column) -> Column:
    return F.coalesce(F.regexp_extract(kind["head"], _TYPE, 1), F.lit(""))


def superclass_name(kind: Column) -> Column:
    """Simple name after ``extends`` of the first class; empty when none."""
    head = kind["head"]
    for _ in range(3):
        head = F.regexp_replace(head, r"<[^<>]*>", " ")
    return F.when(
        kind["head"].contains("extends"), F.regexp_extract(head, r"\bclass\s+\w+\s+extends\s+(\w+)", 1)
    ).otherwise("")


# Everything up to and with the next class declaration that is code; a literal or comment counts as a blank.
_TO_CLASS = (
    r"\G(?:[^c\"'/]+|" + OPAQUE + r"|(?<![.\w$])c(?!lass" + (blanks := r"(?:\s+|" + OPAQUE + r"|[\"'])++") + r"[A-Za-z_$])"
    r"|(?<=[.\w$])c|[\"'/])*+class" + blanks + r"[A-Za-z_$]"
)


def class_count(code: Column) -> Column:
    """Number of class declarations in a file, nested ones included; those in literals and comments do not count."""
    return F.regexp_count(code, F.lit(_TO_CLASS))


def members(structure: Column, kind: Column) -> Column:
    """Methods of the first type in text order, each with lines, text and doc comment.

    Every event is looked at once: what it holds is cut at semicolons, and a regular expression runs only on a part that is
    still in the running.  A member begins with its line, and its text is cut from its own pieces.
    """
    return let(
        F.struct(
            structure["pieces"].alias("pieces"), type_name(kind).alias("class_name"),
            F.slice(
                structure["events"], kind["at"] + 2,
                F.coalesce(kind["end"], F.size(structure["events"])) - kind["at"],
            ).alias("events"),
        ),
        _members,
    )


def _members(x: Column) -> Column:
    def members_of(e: Column, k: Column) -> Column:
        """Members whose heads end in an event: at a body or at a semicolon."""
        def at_part(parts: Column) -> Column:
            def member(part: Column, at: Column) -> Column:
                last = at == F.size(parts) - 1
                head = F.when(last, part).otherwise(F.concat(part, F.lit(";")))
                above = F.when(at == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), at), ";"), F.lit(";")))
                return F.when(
                    part.contains("(") & ((e["turn"] >= 0) | ~last),
                    let(
                        F.struct(head.alias("head"), F.regexp_extract(head, _SIGNATURE, 1).alias("name")),
                        lambda m: F.when(m["name"] != "", method(e, k, m, above, last)),
                    ),
                )

            return F.filter(F.transform(parts, member), lambda m: m.isNotNull())

        return let(F.split(blank_literals(e["head"]), ";", -1), at_part)

    def method(e: Column, k: Column, m: Column, above: Column, body: Column) -> Column:
        """A method by its head, without what is above it in its event; NULL when it is none."""
        def rest_of(lead: Column) -> Column:
            rest = F.substring(m["head"], F.length(lead) + 1, F.lit(_TO_END))
            return let(
                let(rest, lambda r: F.struct(r.alias("rest"), F.regexp_extract(r, _BARE_NAME, 1).alias("bare"))),
                lambda r: F.when(
                    ((r["bare"] == "") | (r["bare"] == x["class_name"]))
                    & ~r["rest"].contains("=") & ~r["rest"].rlike(r"^(?:new|record|return|throw)\b"),
                    let(
                        let(above, lambda a: F.struct(a.alias("above"), F.concat(a, lead).alias("before"))),
                        lambda p: describe(e, k, m, p, r["bare"], body),
                    ),
                ),
            )

        return let(F.regexp_extract(m["head"], _LEAD, 0), rest_of)

    def describe(e: Column, k: Column, m: Column, p: Column, bare: Column, body: Column) -> Column:
        following = F.try_element_at(x["events"], k + 2)
        whole = F.when(~body, F.substring(e["head"], F.lit(1), F.length(p["above"]) + F.length(m["head"]))).when(
            e["turn"] == 0, F.element_at(x["pieces"], e["i"] + 1)
        ).otherwise(F.array_join(F.slice(x["pieces"], e["i"] + 1, following["i"] - e["i"] + 1), ""))
        # The line may begin in an earlier piece.
        line = F.substring_index(F.array_join(F.slice(x["pieces"], F.lit(1), e["i"]), ""), "\n", -1)
        start = F.length(p["before"]) - _after_newline(p["before"]) + 1
        gap = F.substring(e["head"], F.length(p["above"]) + 1, F.length(F.regexp_extract(m["head"], r"^\s*+", 0)))
        return F.struct(
            m["name"].alias("method_name"),
            (bare == x["class_name"]).alias("is_ctor"),
            (e["line"] + _newlines(p["before"])).alias("start_n"),
            F.when(~body, e["line"] + _newlines(p["above"]) + _newlines(m["head"]))
            .when(e["turn"] == 0, e["line"] + e["lines"]).otherwise(following["line"] + following["lines"]).alias("end_n"),
            F.when(p["before"].contains("\n"), F.substring(whole, start, F.lit(_TO_END)))
            .otherwise(F.concat(line, whole)).alias("text"),
            F.when(
                e["head"].contains("/**"),
                let(gap, lambda g: F.try_element_at(F.regexp_extract_all(g, F.lit(_DOC), F.lit(0)), F.lit(-1))),
            ).alias("docstring"),
        )

    found = F.transform(
        x["events"], lambda e, k: F.when((e["depth"] == 1) & e["head"].contains("("), members_of(e, k))
    )
    return F.flatten(F.filter(found, lambda m: m.isNotNull()))


def constructors_first(methods: Column) -> Column:
    """Catalogue order; pass a column, as it is used several times."""
    return F.when(
        F.exists(methods, lambda m: m["is_ctor"]),
        F.concat(F.filter(methods, lambda m: m["is_ctor"]), F.filter(methods, lambda m: ~m["is_ctor"])),
    ).otherwise(methods)


def braces_balance(blanked: Column) -> Column:
    """True when the braces of a blanked piece of code open and close evenly."""
    def folded(code: Column) -> Column:
        end = F.aggregate(
            F.regexp_extract_all(code, F.lit(r"[{}]"), F.lit(0)),
            F.expr("named_struct('depth', 0, 'low', 0)"),
            lambda acc, m: F.struct(
                (acc["depth"] + F.when(m == "{", 1).otherwise(-1)).alias("depth"),
                F.least(acc["low"], acc["depth"] + F.when(m == "{", 1).otherwise(-1)).alias("low"),
            ),
        )
        return let(end, lambda e: (e["depth"] == 0) & (e["low"] == 0))

    def without(code: Column, brace: str) -> Column:
        return F.octet_length(F.replace(code, F.lit(brace), F.lit("")))

    # Nested blocks are seen at once, and an uneven number at a glance; braces are counted one by one for the rest.
    return let(
        blanked,
        lambda code: F.when(code.rlike(_EVEN), True).when(without(code, "{") != without(code, "}"), False).otherwise(folded(code)),
    )


def _call_text(blanked_method: Column) -> Column:
    """Body of a blanked method, with created types by their head."""
    opens = F.instr(blanked_method, "{")
    body = F.when(opens == 0, "").otherwise(F.substring(blanked_method, opens + 1, F.length(blanked_method)))
    # ``new a.B<C>(`` creates by the head of the type, as the other calls go by their first name
    return let(
        body,
        lambda b: F.when(
            b.contains("new"), F.regexp_replace(b, r"\bnew\s+([\w$]+)[\w$.]*+\s*(?:<[^()]*?>\s*)?\(", "new $1(")
        ).otherwise(b),
    )


def _may_be_focal(name: Column) -> Column:
    return ~name.isin(*_NOT_CALLS, *C.NON_FOCAL_CALLS) & ~name.contains(C.NON_FOCAL_PART)


def call_names(blanked_method: Column) -> Column:
    """Names called or created in the body of a blanked method, in text order."""
    names = F.regexp_extract_all(_call_text(blanked_method), F.lit(_CALL), F.lit(1))
    return F.filter(names, _may_be_focal)


# A call once its name and bracket are marked, after a dot or not; a field; a name; any other sign.
_MARKED = "\x01[\\w$]+\x02"
_PARTS = r"\.\s*(?:<[^<>()]*>\s*)?" + _MARKED + "|" + _MARKED + r"|\.\s*[\w$]+|[\w$]+|[^\s\w$]"
# What came last in a bracket: nothing that a call could go on from, a name, ``this``, or a closed bracket and its fields.
_NOTHING, _NAME, _THIS, _CLOSED = range(4)


def call_names_in_tree_order(blanked_method: Column) -> Column:
    """The same names in the order of a syntax tree.

    Both orders differ in chains alone: a tree has a chain's first call, then the calls that go on from it, each
    with its arguments, and then the first call's arguments, and an anonymous class's body after these.

    Brackets are kept on a stack. Every call gets a key, the path to it in the tree, so that keys sort like
    the tree: below its bracket the chain's number, then 0 for the first call, 1 and a number for
    one that goes on, 2 for the arguments of the first, 3 for a body. The condition of ``do``-``while`` counts after its body.
    """
    ints = "array<int>"

    def numbers(*values) -> Column:
        return F.array(*(F.lit(v) if isinstance(v, int) else v for v in values)).cast(ints)

    def frame(p: Column, n, j, last) -> Column:
        values = (F.lit(v) if isinstance(v, int) else v for v in (n, j, last))
        return F.struct(p.alias("p"), *(v.cast("int").alias(c) for v, c in zip(values, ("n", "j", "last"))))

    def step(acc: Column, part: Column) -> Column:
        top, below = F.element_at(acc["stack"], -1), F.slice(acc["stack"], 1, F.size(acc["stack"]) - 1)
        name = F.regexp_extract(part, "\x01([\\w$]+)\x02", 1)
        dotted, goes_on = part.startswith("."), part.startswith(".") & (top["last"] == _CLOSED)
        selector = dotted & (top["last"] != _NAME)
        n = F.when(goes_on, top["n"]).otherwise(top["n"] + 1)
        j = F.when(goes_on, top["j"] + 1).when(selector, 1).otherwise(0)

        def called(at: Column) -> Column:
            key = F.when(selector, F.concat(at["base"], numbers(1, at["j"]))).otherwise(F.concat(at["base"], numbers(0)))
            inside = F.when(selector, F.concat(at["base"], numbers(1, at["j"], 1))).otherwise(F.concat(at["base"], numbers(2)))
            return F.struct(
                F.concat(below, F.array(frame(top["p"], at["n"], at["j"], _CLOSED), frame(inside, 0, 0, _NOTHING))).alias("stack"),
                F.concat(acc["found"], F.array(F.struct(key.alias("key"), name.alias("name")))).alias("found"),
            )

        def with_top(*frames: Column) -> Column:
            return F.struct(F.concat(below, F.array(*frames)).alias("stack"), acc["found"].alias("found"))

        same = F.concat(top["p"], numbers(top["n"]))
        index = with_top(top, frame(F.concat(same, numbers(1, top["j"], 2)), 0, 0, _NOTHING))
        body = with_top(top, frame(F.concat(same, numbers(3)), 0, 0, _NOTHING))
        fresh = with_top(
            frame(top["p"], top["n"] + 1, 0, _CLOSED), frame(F.concat(top["p"], numbers(top["n"] + 1, 0)), 0, 0, _NOTHING)
        )
        closed = top["last"] == _CLOSED
        call = let(F.struct(n.cast("int").alias("n"), j.cast("int").alias("j"), F.concat(top["p"], numbers(n)).alias("base")), called)
        return (
            F.when(name != "", call)
            .when((part == "[") & closed, index).when((part == "{") & closed, body)
            .when(part.isin("(", "[", "{"), fresh)
            .when(part.isin(")", "]", "}") & (F.size(acc["stack"]) > 1), F.struct(below.alias("stack"), acc["found"].alias("found")))
            .when(dotted & (part != "."), with_top(frame(top["p"], top["n"], top["j"], F.when(closed, _CLOSED).otherwise(_NAME))))
            .when(part == "this", with_top(frame(top["p"], top["n"], top["j"], _THIS)))
            .when(part.rlike(r"^[\w$]"), with_top(frame(top["p"], top["n"], top["j"], _NAME)))
            .otherwise(with_top(frame(top["p"], top["n"], top["j"], _NOTHING)))
        )

    marked = F.regexp_replace(_call_text(blanked_method), _CALL, "\x01$1\x02")
    start = F.struct(
        F.array(frame(F.array().cast(ints), 0, 0, _NOTHING)).alias("stack"),
        F.array().cast("array<struct<key:array<int>,name:string>>").alias("found"),
    )
    found = F.aggregate(F.regexp_extract_all(marked, F.lit(_PARTS), F.lit(0)), start, step)["found"]
    return F.filter(F.transform(F.array_sort(found), lambda c: c["name"]), _may_be_focal)


def split_by_assertion(text: Column, start_n: Column, skip_comments: bool = False) -> Column:
    """One entry per assertion line, and a last one without any.

    An entry holds the non-assertion lines above, its own assertion line, a
    closing brace, and the line numbers that went in. With ``skip_comments`` a
    line whose assertion is commented out is no assertion line.
    """
    read = line_comments_out(text) if skip_comments else text
    numbered = F.transform(
        F.arrays_zip(F.split(text, "\n", -1).alias("s"), F.split(read, "\n", -1).alias("read")),
        lambda x, i: F.struct((start_n + i).alias("n"), x["s"].alias("s"), x["read"].contains("assert").alias("asserts")),
    ) if skip_comments else F.transform(
        F.split(text, "\n", -1),
        lambda s, i: F.struct((start_n + i).alias("n"), s.alias("s"), s.contains("assert").alias("asserts")),
    )
    visible = F.filter(numbered, lambda x: strip(x["s"]) != "")

    def line_text(x: Column) -> Column:
        return x["s"]

    def entries(lines: Column) -> Column:
        plain, asserting = lines["plain"], lines["asserting"]

        def entry(a: Column) -> Column:
            return let(
                F.concat(F.filter(plain, lambda x: x["n"] < a["n"]), F.array(a)),
                lambda taken: F.struct(
                    F.concat(F.array_join(F.transform(taken, line_text), "\n"), F.lit("\n}"))
                    .alias("text"),
                    F.transform(taken, lambda x: x["n"]).alias("line_nums"),
                    a["n"].alias("assert_n"),
                ),
            )

        rest = F.struct(
            F.array_join(F.transform(plain, line_text), "\n").alias("text"),
            F.transform(plain, lambda x: x["n"]).alias("line_nums"),
            F.lit(None).cast("int").alias("assert_n"),
        )
        return F.concat(F.transform(asserting, entry), F.array(rest))

    sides = let(
        visible,
        lambda v: F.struct(
            F.filter(v, lambda x: ~x["asserts"]).alias("plain"),
            F.filter(v, lambda x: x["asserts"]).alias("asserting"),
        ),
    )
    return let(sides, entries)
