"""SQL counterparts for DuckDB.

The code-based ones do not read any code: they work the expected rows out of
the order and customer keys, from what each of the five test bodies is known
to contain, and so check the readers independently.
"""

from __future__ import annotations

from proofmill import constants as C
from proofmill.functions import text
from proofmill.sources import starcode as S


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in columns.items())


def _q(value: str) -> str:
    return value.replace("'", "''")


# Orders, customers and tests with every derived column.
FACTS = f"""
WITH RECURSIVE f AS (
  SELECT *, {_select(S.ORDER_COLUMNS)}
  FROM (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS st FROM orders)
),
cu AS (SELECT *, {_select(S.CUSTOMER_COLUMNS)} FROM (SELECT c_custkey AS c FROM customer)),
t AS (
  SELECT f.*, CAST(j AS INT) AS j, {_select(S.TEST_COLUMNS)}
  FROM f, unnest(range(0, n_tests)) AS u(j)
)
"""
BODY = S.by_body(lambda _, lines: S.lines_sql(lines))
_TEST_CONTENT = f"""
, blocks AS (
  SELECT k, string_agg(concat('  @Test(timeout = 4000)', chr(10), {BODY}, chr(10)), chr(10) ORDER BY j) AS b
  FROM t GROUP BY k
)
, test_files AS (
  SELECT project, test_path AS path, concat({S.lines_sql(S.TEST_HEADER, S.ORDER_SLOTS)}, chr(10), blocks.b,
    CASE WHEN test_ok THEN concat('}}', chr(10)) ELSE '' END,
    CASE WHEN two_classes THEN concat({S.lines_sql(["", "class Helper$k {", "  void helper() { }", "}", ""])}) ELSE '' END
  ) AS content FROM f JOIN blocks USING (k)
)
"""
# The content template names the column b, which the join would make ambiguous.
_TEST_CONTENT = _TEST_CONTENT.replace(" AS b\n", " AS block_text\n").replace("blocks.b,", "block_text,")
_SOURCE_CONTENT = f"""
, source_files AS (
  SELECT project, src_path AS path, concat({S.lines_sql(S.SOURCE_LINES, S.ORDER_SLOTS)}, chr(10),
    CASE WHEN src_ok THEN concat('}}', chr(10)) ELSE '' END) AS content
  FROM f WHERE has_source
  UNION ALL
  SELECT project, src_path, concat({S.lines_sql(S.BASE_LINES, S.CUSTOMER_SLOTS)}, chr(10))
  FROM cu WHERE has_source
)
"""
_ALL_PATHS = """
, paths AS (
  SELECT project, test_path AS path, 'test' AS kind FROM f
  UNION ALL SELECT project, src_path, 'src' FROM f WHERE has_source
  UNION ALL SELECT project, src_path, 'src' FROM cu WHERE has_source
)
"""


def _member(lines: list[str], start: int) -> tuple[str, int, int]:
    return S.lines_sql(lines), start, start + len(lines) - 1


def _slice(lines, first: int, last: int):
    return _member(list(lines[first - 1:last]), first)


# Methods of the two kinds of source, in catalogue order: name, constructor?, lines, doc comment.
_CLASS_METHODS = [
    ("concat('C', k)", True, _slice(S.SOURCE_LINES, 20, 22), S.literal("\n".join(S.SOURCE_LINES[16:19]).strip())),
    ("concat('get', g)", False, _slice(S.SOURCE_LINES, 12, 15), None),
    ("'set'", False, _slice(S.SOURCE_LINES, 25, 28), S.literal(S.SOURCE_LINES[23].strip())),
]
_BASE_METHODS = [
    ("concat('describe', e)", False, _slice(S.BASE_LINES, 7, 9), None),
    ("'rank'", False, _slice(S.BASE_LINES, 12, 12), S.BASE_LINES[10].strip()),
    ("'shared'", False, _slice(S.BASE_LINES, 14, 16), None),
]


def _methods(table: str, where: str, class_name: str, rows) -> str:
    parts = []
    for ordinal, (name, ctor, (body, start, end), doc) in enumerate(rows):
        if doc is None:
            doc_sql = "CAST(NULL AS VARCHAR)"
        elif "$" in doc:
            doc_sql = S.template(doc)
        else:
            doc_sql = doc
        parts.append(
            f"SELECT project, src_path AS path, {class_name} AS class_name, {ordinal} AS ordinal,"
            f" {name} AS method_name, {str(ctor).lower()} AS is_ctor, {start} AS start_n,"
            f" {end} AS end_n, {body} AS text, {doc_sql} AS docstring FROM {table} WHERE {where}"
        )
    return " UNION ALL ".join(parts)


_CTOR_DOC = S.template("\n".join(S.SOURCE_LINES[16:19]).strip())
_CLASS_METHODS[0] = (*_CLASS_METHODS[0][:3], _CTOR_DOC)
_CATALOG = (
    "\n, cat AS ("
    + _methods("f", "has_source AND src_ok", "concat('C', k)", _CLASS_METHODS)
    + " UNION ALL "
    + _methods("cu", "has_source", "concat('Base', c)", _BASE_METHODS)
    + ")\n"
)

# What each body holds: the first assertion in its short reading, the splits
# with the lines that go in, the longest reading of their assertion, whether
# their braces balance, and the names called, in text order.
_SHORT = ("assertEquals($v, int0);", None, None, "assertNotNull(c0);", "assertEquals($v, c0.get$g());")
_UNCOMMENTED = (_SHORT[0], None, None, _SHORT[3], "assertSame(c0, c0);")
_FIRST_LINE = (4, None, None, 4, 3)
_CALLS = (
    ("C$k", "set", "get$g", "shared", "describe$d", "set"),
    ("C$k",),
    ("C$k", "set", "unknown$j", "set"),
    ("C$k", "set"),
    ("C$k", "missing$j", "rank", "describe$d", "absent$j"),
)
# (body, split number, line indexes, assertion, balanced, calls)
_SPLITS = (
    (0, 0, (0, 1, 2, 3, 4), "assertEquals($v, int0)", True, ("C$k", "set", "get$g")),
    (0, 1, (0, 1, 2, 3, 6), "assertTrue(c0.shared() > 0)", True, ("C$k", "set", "get$g", "shared")),
    (0, 2, (0, 1, 2, 3, 7, 8, 9), None, True, ("C$k", "set", "get$g", "describe$d", "set")),
    (1, 0, (0, 1, 2, 3, 4, 5, 6, 7, 8, 9), None, True, ("C$k",)),
    (2, 0, (0, 1, 2, 3, 5, 6, 7, 8, 9), None, True, ("C$k", "set", "unknown$j", "set")),
    (3, 0, (0, 1, 2, 3, 4), "assertNotNull(c0)", False, ("C$k", "set")),
    (3, 1, (0, 1, 2, 3, 5, 6, 7, 8, 9), None, True, ("C$k", "set")),
    (4, 0, (0, 1, 2, 3), "assertEquals($v, c0.get$g())", True, ("C$k",)),
    (4, 1, (0, 1, 2, 4), "assertSame(c0, c0)", True, ("C$k",)),
    (4, 2, (0, 1, 2, 5, 7), 'assertEquals("a;b", c0.describe$d())', True,
     ("C$k", "missing$j", "rank", "describe$d")),
    (4, 3, (0, 1, 2, 5, 8, 9), None, True, ("C$k", "missing$j", "rank", "absent$j")),
)
_START = f"({S.HEADER_LINES + 2} + {S.BLOCK_LINES} * j)"


def _per_body(values, null: str = "''") -> str:
    return "CASE m " + " ".join(
        f"WHEN {i} THEN {null if v is None else S.template(v)}" for i, v in enumerate(values)
    ) + " END"


def _split_rows() -> str:
    parts = []
    for body, number, picked, assertion, balanced, _ in _SPLITS:
        lines = [S.BODIES[body][i] for i in picked] + (["}"] if assertion else [])
        prefix = lines[:-1]
        if assertion:
            prefix = prefix[:-1] + [prefix[-1][: prefix[-1].index("assert")]]
        numbers = "concat_ws(',', " + ", ".join(f"{_START} + {i}" for i in picked) + ")"
        parts.append(
            f"SELECT t.*, {number} AS split_no, {S.lines_sql(lines)} AS split_text,"
            f" {S.lines_sql(prefix)} AS prefix,"
            f" {numbers} AS line_nums, {S.template(assertion) if assertion else chr(39) * 2} AS assertion,"
            f" {str(balanced).lower()} AS balanced,"
            f" {f'{_START} + {picked[-1]}' if assertion else 'NULL'} AS assert_n"
            f" FROM t WHERE m = {body}"
        )
    return "\n, sp AS (" + " UNION ALL ".join(parts) + ")\n"


_SPLIT_ROWS = _split_rows()

_CALL_ROWS = (
    "\n, calls AS ("
    + " UNION ALL ".join(
        f"SELECT t.*, {pos} AS pos, {len(names) - 1 - pos} AS rank, {S.template(name)} AS called"
        f" FROM t WHERE m = {body}"
        for body, names in enumerate(_CALLS) for pos, name in enumerate(names)
    )
    + ")\n"
)

_BY_NAME = (
    "CASE WHEN k % 101 = 0 THEN concat(project, '/src/main/java/', folder, 'p', k, '/.java')"
    " ELSE src_path END"
)
_PACKAGE_FOLDER = "CASE WHEN test_package = '' THEN '' ELSE concat(replace(test_package, '.', '/'), '/') END"
_BY_PACKAGE = (
    f"concat(project, '/src/main/java/', {_PACKAGE_FOLDER},"
    " CASE WHEN k % 101 = 0 THEN '' ELSE concat('C', k) END, '.java')"
)
_RUNAWAY = "(m = 2 AND k % 29 = 11)"
_USABLE_A = f"k % 101 <> 0 AND has_source AND test_ok AND src_ok AND NOT {_RUNAWAY}"

_FOCAL_A = _CATALOG + _CALL_ROWS + """
, firsts AS (
  SELECT project, method_name AS called, arg_min(text, path) AS focal_text, min(path) AS focal_path
  FROM cat GROUP BY 1, 2
)
, fa AS (
  SELECT k, j, arg_max(focal_text, pos) AS focal_text, arg_max(focal_path, pos) AS focal_path
  FROM calls JOIN firsts USING (project, called) GROUP BY k, j
)
"""


def _norm(sql: str) -> str:
    words = "|".join(C.MODIFIERS)
    return (
        f"trim(regexp_replace(regexp_replace(regexp_replace({sql}, '\\b({words})\\b', '', 'g'),"
        f" '({_q(C.SPACED_SYMBOLS)})', ' \\1 ', 'g'), '\\s+', ' ', 'g'))"
    )


_TOKEN = _q("|".join(text.TOKEN_BRANCHES).replace("{p}", ""))


def _tokens(sql: str, drop_access: bool = False) -> str:
    listed = f"list_filter(regexp_extract_all({sql}, '{_TOKEN}'), lambda x: NOT regexp_matches(x, '^/[/*]'))"
    joined = f"array_to_string({listed}, ' ')"
    if drop_access:
        joined = f"regexp_replace({joined}, '\\b({'|'.join(C.ACCESS_MODIFIERS)})\\s+', '', 'g')"
    bad = f"len(list_filter({listed}, lambda x: regexp_matches(x, '{_q(text.BAD_TOKEN)}'))) > 0"
    return f"CASE WHEN {bad} OR trim({sql}) = '' THEN {sql} ELSE {joined} END"


# Split-level resolution along the class chain.
_CHAIN = """
, up AS (
  SELECT project, src_path AS path, 'org.base.Base' || c AS fqn, c, 0 AS depth, c AS cur
  FROM cu WHERE has_source
  UNION ALL
  SELECT up.project, up.path, up.fqn, up.c, depth + 1, cu.p
  FROM up JOIN cu ON cu.c = up.cur
  WHERE cu.imports_base AND cu.extends_base
)
, class_chain AS (
  SELECT project, path, fqn AS class_fqn, depth, concat('org.base.Base', cur) AS ancestor_fqn,
    concat(project, '/src/main/java/org/base/Base', cur, '.java') AS ancestor_path FROM up
  UNION ALL
  SELECT project, src_path, concat(CASE WHEN folder = '' THEN '' ELSE concat('org.p', b, '.') END, 'C', k), 0,
    concat(CASE WHEN folder = '' THEN '' ELSE concat('org.p', b, '.') END, 'C', k), src_path
  FROM f WHERE has_source AND src_ok
  UNION ALL
  SELECT f.project, f.src_path,
    concat(CASE WHEN folder = '' THEN '' ELSE concat('org.p', b, '.') END, 'C', k), depth + 1,
    concat('org.base.Base', cur), concat(f.project, '/src/main/java/org/base/Base', cur, '.java')
  FROM f JOIN up ON up.c = f.c
  WHERE f.has_source AND f.src_ok AND f.extends_base AND f.imports_base
)
"""
_FILE_REASON = f"""CASE
  WHEN k % 101 = 0 THEN 'file_name_not_matched'
  WHEN NOT has_source OR (k % 19 = 3 AND k % 17 <> 5) THEN 'cannot_find_focal_unit_file'
  WHEN NOT test_ok THEN 'err_parse_test_file'
  WHEN NOT src_ok THEN 'err_parse_focal_file'
  WHEN two_classes THEN 'unexpected_class_structure' END"""
_USABLE_B = f"pid % 13 <> 0 AND {_FILE_REASON} IS NULL AND NOT {_RUNAWAY}"
_SPLIT_CALLS = (
    "\n, scalls AS ("
    + " UNION ALL ".join(
        f"SELECT k, j, project, src_path, {number} AS split_no, {pos} AS pos, {S.template(name)} AS called"
        f" FROM t WHERE m = {body}"
        for body, number, _, _, balanced, names in _SPLITS if balanced
        for pos, name in enumerate(names)
    )
    + ")\n"
)
_FOCAL_B = _CATALOG + _SPLIT_ROWS + _SPLIT_CALLS + _CHAIN + """
, reach AS (
  SELECT class_chain.path AS src_path, method_name AS called,
    arg_min(cat.text, depth) AS focal_text, arg_min(cat.path, depth) AS focal_path,
    arg_min(coalesce(cat.docstring, '<none>'), depth) AS doc
  FROM class_chain JOIN cat ON cat.path = class_chain.ancestor_path GROUP BY 1, 2
)
, fb AS (
  SELECT k, j, split_no, arg_max(focal_text, pos) AS focal_text, arg_max(focal_path, pos) AS focal_path,
    nullif(arg_max(doc, pos), '<none>') AS doc
  FROM scalls JOIN reach USING (src_path, called) GROUP BY k, j, split_no
)
"""
# A row without focal method has an empty docstring, one with an undocumented focal has none.
_SAMPLE_B = f"FROM sp LEFT JOIN fb USING (k, j, split_no) WHERE {_USABLE_B} AND name LIKE 'test%' AND assertion <> ''"
_DOC_B = "CASE WHEN focal_text IS NULL THEN '' ELSE doc END"
_FULL_NAME = (
    "concat(test_package, '.C', k, 'EvoSuiteTest::', name)"
)


def _rendered(prefix: str, focal: str) -> str:
    return f"concat({prefix}, ' {C.ASSERT_PLACEHOLDER} ; }} {C.FOCAL_MARKER} ', {focal})"


_QUERY_HEAD = (
    _norm(S.lines_sql(S.BODIES[0][:4])),
    _norm(S.lines_sql([S.BODIES[1][0], S.BODIES[1][1], S.BODIES[1][3]])),
    _norm(S.lines_sql(S.BODIES[2][:9])),
    _norm(S.lines_sql([S.BODIES[3][0], S.BODIES[3][1], S.BODIES[3][3]])),
    _norm(S.lines_sql([*S.BODIES[4][:3], "      //"])),
)
# The string in body 2 may hold an annotation or a fail, which the query builder takes out.
_R_CLEAN = "CASE WHEN k % 29 = 11 THEN ' ' ELSE 'fail(1) {' END"

_SAMPLES_A = f"""
SELECT project, split_part(project, '_', 1) AS project_id, test_path AS path, j AS ordinal,
  {_norm("rtrim(" + _per_body(_SHORT) + ", ';')")} AS assertion,
  {_rendered(
      "CASE m " + " ".join(
          f"WHEN {i} THEN " + _norm(S.template(" ".join(s.strip() for s in S.BODIES[i][:n])))
          for i, n in enumerate(_FIRST_LINE) if n is not None
      ) + " END",
      f"coalesce({_norm('focal_text')}, '{C.UNKNOWN_FOCAL}')",
  )} AS prefix_focal
FROM t LEFT JOIN fa USING (k, j)
WHERE {_USABLE_A} AND m IN (0, 3, 4)
"""

_DOC_FILES = """
WITH files AS (
  SELECT doc_id // 2 AS project_id, CASE doc_id % 2 WHEN 0 THEN 'assert' ELSE 'prefix_focal' END AS half,
    regexp_replace(text, '\\n\\z', '') AS content
  FROM documents WHERE text <> ''
),
lines AS (
  SELECT project_id, half, CAST(i AS INT) AS line_no,
    string_split(content, chr(10))[i] AS line
  FROM files, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS u(i)
)
"""

_TURNS = """
WITH l AS (SELECT conv_id, turn // 2 AS line_no, text AS assertion FROM conversations WHERE turn % 2 = 0),
r AS (SELECT conv_id, turn // 2 AS line_no, text AS prefix_focal FROM conversations WHERE turn % 2 = 1)
"""

_NEAREST = f"""
WITH q AS (SELECT item_id AS query_id, list_distinct(list_filter(string_split({_norm('text')}, ' '), lambda x: x <> '')) AS ts FROM benchmark),
d AS (SELECT doc_id AS corpus_id, list_distinct(list_filter(string_split({_norm('text')}, ' '), lambda x: x <> '')) AS ts FROM documents),
qt AS (SELECT query_id, len(ts) AS nq, unnest(ts) AS tok FROM q),
dt AS (SELECT corpus_id, len(ts) AS nd, unnest(ts) AS tok FROM d),
p AS (
  SELECT query_id, corpus_id, count(*) AS n_common, any_value(nq) + any_value(nd) - count(*) AS n_union
  FROM qt JOIN dt USING (tok) GROUP BY 1, 2
)
SELECT q.query_id, corpus_id, n_common, n_union FROM q LEFT JOIN (
  SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n_common / n_union DESC, corpus_id) = 1
) b ON b.query_id = q.query_id
"""

_CASES = "SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 5 AS g, o_orderkey % 97 AS v FROM orders"
_SECTIONS = (
    ("evosuite_prefix", "C$k c0 = new C$k($c);\n    c0.set($v);"),
    ("regression_oracle", "assertEquals($v, c0.get$g());"),
    ("dev_prefix", "C$k made = new C$k($v);"),
    ("dev_assertion", ""),
    ("true_assertion", "assertEquals($c, c0.get$g());"),
    ("notes", "- notes for $k, EVOSUITE PREFIX inside a line"),
)
_BAD = """
SELECT 'math' AS bug_project, o_orderkey AS bug_id, unnest([0, o_orderkey % 3]) AS test_no FROM orders
UNION ALL
SELECT 'time', o_custkey, unnest([o_orderkey % 5, 2, o_orderkey % 3]) FROM orders
"""

_LABELS = "m IN (1, 3)"

ORACLE_SQL: dict[str, str] = {
    "project_list": FACTS + _ALL_PATHS + """
SELECT DISTINCT project, project NOT LIKE 'lib%' AS numbered, split_part(project, '_', 1) AS project_id FROM paths""",
    "scan_tests": FACTS + _TEST_CONTENT + "SELECT project, path, content FROM test_files",
    "scan_sources": FACTS + _SOURCE_CONTENT + "SELECT project, path, content FROM source_files",
    "read_corpus": _DOC_FILES + """
SELECT project_id, line_no, max(CASE WHEN half = 'assert' THEN line END) AS assertion,
  max(CASE WHEN half <> 'assert' THEN line END) AS prefix_focal
FROM lines GROUP BY 1, 2""",
    "file_line_numbers": r"""
WITH t AS (
  SELECT doc_id, (doc_id // 2000) || CASE doc_id % 2 WHEN 0 THEN '_assert' ELSE '_prefix_focal' END AS name, text FROM documents
)
SELECT name, row_number() OVER (PARTITION BY name ORDER BY doc_id) AS line_no,
  concat_ws(':', doc_id, regexp_replace(text, '[\r\n]+', ' ', 'g')) AS line FROM t""",
    "combine_corpus": _DOC_FILES + "SELECT project_id, half, line_no, line FROM lines ORDER BY 1, 2, 3",
    "case_sections": " UNION ALL ".join(
        f"SELECT 'math' AS bug_project, k AS bug_id, '{name}' AS section, {i + 1} AS seq,"
        f" {S.template(body)} AS body FROM ({_CASES})"
        for i, (name, body) in enumerate(_SECTIONS)
    ),
    "bad_prefix_rows": f"SELECT bug_project, bug_id, CAST(test_no AS INT) AS test_no FROM ({_BAD})",
    "export_pairs": FACTS + _FOCAL_A + f"""
SELECT project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY path, ordinal) AS BIGINT) AS line_no,
  assertion, prefix_focal FROM ({_SAMPLES_A})""",
    "export_csv": FACTS + _FOCAL_B + f"""
SELECT coalesce(focal_text, '') AS focal_method, split_text AS test_prefix, coalesce({_DOC_B}, '') AS docstring {_SAMPLE_B}""",
    "export_hits_json": _NEAREST,
    "filter_projects": FACTS + _ALL_PATHS + """
SELECT project, path FROM paths WHERE project LIKE '%12\\_%' ESCAPE '\\' OR project LIKE '%Math%'""",
    "filter_sample_projects": FACTS + _ALL_PATHS + "SELECT project, path FROM paths WHERE "
    + " OR ".join(f"project LIKE '%{w}%'" for w in C.SAMPLE_PROJECTS),
    "path_parts": FACTS + """
SELECT test_path AS path, replace(project, 'lib', '') AS project_name, concat('C', k) AS class_name
FROM f WHERE k % 101 <> 0""",
    "source_path_by_name": FACTS + f"SELECT test_path AS path, {_BY_NAME} AS source_path FROM f",
    "source_path_by_package": FACTS + f"SELECT test_path AS path, {_BY_PACKAGE} AS source_path FROM f",
    "file_package": FACTS + "SELECT test_path AS path, test_package AS package FROM f",
    "file_imports": FACTS + """
SELECT project, test_path AS path, 'Test' AS simple, 'org.junit.Test' AS fqn FROM f
UNION ALL SELECT project, test_path, '*', 'org.junit.Assert.*' FROM f
UNION ALL SELECT project, test_path, concat('C', k), concat('org.p', b, '.C', k) FROM f
UNION ALL SELECT project, src_path, 'List', 'java.util.List' FROM f WHERE has_source
UNION ALL SELECT project, src_path, concat('Base', c), concat('org.base.Base', c) FROM f WHERE has_source AND imports_base
UNION ALL SELECT project, src_path, concat('Base', p), concat('org.base.Base', p) FROM cu WHERE has_source AND imports_base""",
    "full_test_name": FACTS + f"""
SELECT test_path AS path, j AS ordinal, CASE WHEN name LIKE 'test%' THEN {_FULL_NAME} END AS full_test_name
FROM t WHERE test_ok""",
    "strip_modifiers": "SELECT page_id, regexp_replace(html, '\\b(" + "|".join(C.MODIFIERS) + ")\\b', '', 'g') AS text FROM pages",
    "space_symbols": f"SELECT page_id, regexp_replace(html, '({C.SPACED_SYMBOLS})', ' \\1 ', 'g') AS text FROM pages",
    "collapse_ws": "SELECT page_id, trim(regexp_replace(html, '\\s+', ' ', 'g')) AS text FROM pages",
    "normalize_chars": f"SELECT doc_id, {_norm('text')} AS text FROM documents",
    "normalize_tokens": f"SELECT page_id, {_tokens('html')} AS text, {_tokens('html', True)} AS no_access FROM pages",
    "strip_semicolon": """
SELECT conv_id, turn, regexp_replace(regexp_replace(x, '\\s+$', ''), ';+$', '') AS semicolons,
  regexp_replace(x, '[ ;]+$', '') AS run
FROM (SELECT conv_id, turn, concat(text, repeat('; ', turn), ';; ') AS x FROM conversations)""",
    "first_assertion": FACTS + f"""
SELECT test_path AS path, j AS ordinal, {_per_body(_SHORT)} AS assertion, {_per_body(_UNCOMMENTED)} AS uncommented
FROM t WHERE test_ok""",
    "exception_label": FACTS + f"SELECT test_path AS path, j AS ordinal, {_LABELS} AS exception_lbl FROM t WHERE test_ok",
    "retrieval_query": FACTS + _FOCAL_A + f"""
SELECT path, ordinal, {_rendered("head", "focal_norm")} AS query FROM (
  SELECT test_path AS path, j AS ordinal,
    {_norm(f"coalesce(focal_text, '{C.UNKNOWN_FOCAL}')")} AS focal_norm,
    CASE m {" ".join(f"WHEN {i} THEN {h}" for i, h in enumerate(_QUERY_HEAD))} END AS head
  FROM (SELECT * REPLACE ({_R_CLEAN} AS r) FROM t) LEFT JOIN fa USING (k, j) WHERE {_USABLE_A})""",
    "code_lines": """
SELECT source AS project, doc_id AS path, CAST(i AS INT) AS n, string_split(x, chr(10))[i] AS line
FROM (SELECT source, doc_id, regexp_replace(text, '\\n\\z', '') AS x FROM documents) d,
  unnest(range(1, len(string_split(x, chr(10))) + 1)) AS u(i)""",
    "method_bodies": FACTS + f"""
SELECT test_path AS path, name AS method_name, {_START} AS start_n, {_START} + 9 AS end_n, {BODY} AS text
FROM t WHERE test_ok""",
    "method_catalog": FACTS + _CATALOG + """
SELECT project, path, class_name, ordinal, method_name, is_ctor, start_n, end_n, text FROM cat""",
    "method_docs": FACTS + _CATALOG + "SELECT path, method_name, docstring FROM cat",
    "drop_runaway_methods": FACTS + f"""
SELECT test_path AS path, name AS method_name FROM t WHERE test_ok AND NOT {_RUNAWAY}""",
    "split_first_assert": FACTS + f"""
SELECT test_path AS path, j AS ordinal, {_per_body(_SHORT)} AS assertion, {_per_body(
    [" ".join(s.strip() for s in S.BODIES[i][:n]) if n is not None else None for i, n in enumerate(_FIRST_LINE)]
)} AS prefix FROM t WHERE test_ok AND m IN (0, 3, 4)""",
    "split_per_assert": FACTS + _SPLIT_ROWS + """
SELECT test_path AS path, j AS ordinal, split_no, split_text, line_nums FROM sp WHERE test_ok""",
    "split_at_line": FACTS + _SPLIT_ROWS + f"""
SELECT test_path AS path, j AS ordinal, assert_n, split_text FROM sp WHERE test_ok AND assert_n = {S.HEADER_LINES + 6}""",
    "call_sites": FACTS + _CALL_ROWS + """
SELECT test_path AS path, j AS ordinal, rank, called AS name FROM calls WHERE test_ok""",
    "call_sites_tree": """
WITH t AS (
  SELECT o_orderkey, ['first' || o_orderkey, 'next', 'arg' || o_custkey, 'Made', 'deep', 'last', 'inner' || o_custkey,
    'Job', 'start', 'count', 'size', 'go', 'own', 'p', 'then', 'q'] AS names FROM orders
)
SELECT o_orderkey, CAST(16 - i AS INT) AS rank, names[i] AS name FROM t, unnest(range(1, 17)) AS u(i)""",
    "test_source_pairs": FACTS + f"SELECT test_path AS path, {_BY_NAME} AS source_path FROM f WHERE has_source AND k % 101 <> 0",
    "missing_sources": FACTS + f"SELECT test_path AS path, {_BY_NAME} AS source_path FROM f WHERE NOT has_source OR k % 101 = 0",
    "focal_project": FACTS + _FOCAL_A + f"""
SELECT test_path AS path, j AS ordinal, focal_path, focal_text FROM t LEFT JOIN fa USING (k, j) WHERE {_USABLE_A}""",
    "focal_inherited": FACTS + _FOCAL_B + f"""
SELECT test_path AS path, j AS ordinal, split_no, focal_path, focal_text, doc AS docstring
FROM sp LEFT JOIN fb USING (k, j, split_no) WHERE {_USABLE_B} AND name LIKE 'test%'""",
    "class_chain": FACTS + _CHAIN + "SELECT project, class_fqn, depth, ancestor_fqn FROM class_chain",
    "pair_by_position": _TURNS + "SELECT conv_id, line_no, assertion, prefix_focal FROM l FULL JOIN r USING (conv_id, line_no)",
    "alignment_audit": _TURNS + """
SELECT conv_id, count(assertion) AS n_assertions, count(prefix_focal) AS n_prefixes,
  count(*) FILTER (assertion IS NOT NULL AND prefix_focal IS NOT NULL) AS n_paired,
  bool_and(assertion IS NOT NULL AND prefix_focal IS NOT NULL) AS aligned
FROM l FULL JOIN r USING (conv_id, line_no) GROUP BY 1""",
    "retrieve_nearest": _NEAREST,
    "outcome_diff": """
WITH o AS (
  SELECT event_id // 2 % 106 AS bug, CASE WHEN event_id % 17 = 0 THEN concat('Only', event_id) ELSE concat('test', event_id // 2) END AS test,
    event_id % 2 = 0 AS buggy, event_type <> 'error' AS passed FROM events
), b AS (SELECT bug, test, passed AS on_buggy FROM o WHERE buggy), x AS (SELECT bug, test, passed AS on_fixed FROM o WHERE NOT buggy)
SELECT concat('Math-', bug) AS bug, test, on_buggy, on_fixed,
  CASE WHEN on_buggy IS NULL THEN 'only_fixed' WHEN on_fixed IS NULL THEN 'only_buggy'
    WHEN on_buggy AND on_fixed THEN 'passes_both' WHEN on_buggy THEN 'passes_then_fails'
    WHEN on_fixed THEN 'fails_then_passes' ELSE 'fails_both' END AS outcome,
  coalesce(on_buggy <> on_fixed, false) AS differs
FROM b FULL JOIN x USING (bug, test)""",
    "apply_oracles": FACTS + f"""
SELECT test_path AS path, j AS ordinal, CASE WHEN given THEN fresh ELSE old END AS assertion, given AS replaced,
  CASE WHEN given THEN replace(body, old, fresh) ELSE body END AS text
FROM (SELECT *, k % 4 = 0 AND j = 0 AS given, concat('assertEquals(', k, ', int0);') AS fresh,
  {_per_body(_SHORT)} AS old, {BODY} AS body FROM t WHERE test_ok AND m IN (0, 3, 4))""",
    "drop_bad_prefixes": f"""
SELECT 'math' AS bug_project, o_orderkey AS bug_id, CAST(j AS INT) AS test_no
FROM orders, unnest(range(0, o_orderkey % 3 + 1)) AS u(j)
WHERE j <> 0 AND j <> o_orderkey % 3""",
    "samples_first_assert": FACTS + _FOCAL_A + _SAMPLES_A,
    "samples_per_assert": FACTS + _FOCAL_B + f"""
SELECT project, test_path AS path, j AS ordinal, split_no, {_tokens("assertion")} AS assertion,
  {_rendered(_tokens("prefix", True), _tokens("coalesce(focal_text, '')"))} AS prefix_focal {_SAMPLE_B}""",
    "input_rows": FACTS + _FOCAL_B + f"""
SELECT project, test_path AS path, j AS ordinal, split_no, coalesce(focal_text, '') AS focal_method,
  split_text AS test_prefix, {_DOC_B} AS docstring {_SAMPLE_B}""",
    "meta_rows": FACTS + _FOCAL_B + f"""
SELECT test_path AS path, j AS ordinal, split_no, project, '0' AS bug_num, {_FULL_NAME} AS test_name,
  0 AS exception_bug, 0 AS assertion_bug, false AS exception_lbl, assertion AS assertion_lbl, '' AS assert_err {_SAMPLE_B}""",
    "reject_counts": FACTS + _SPLIT_ROWS + f"""
, files AS (SELECT {_FILE_REASON} AS reason FROM f WHERE pid % 13 <> 0)
, methods AS (SELECT CASE WHEN name NOT LIKE 'test%' THEN 'test_name_not_matched' END AS reason FROM t WHERE {_USABLE_B})
, splits AS (
  SELECT CASE WHEN assertion = '' THEN 'no_assertion' END AS reason, CASE WHEN NOT balanced THEN 'unable_to_parse_test' END AS warning
  FROM sp WHERE {_USABLE_B} AND name LIKE 'test%'
)
SELECT 'file' AS stage, reason, count(*) AS n FROM files WHERE reason IS NOT NULL GROUP BY 1, 2
UNION ALL SELECT 'method', reason, count(*) FROM methods WHERE reason IS NOT NULL GROUP BY 1, 2
UNION ALL SELECT 'split', reason, count(*) FROM splits WHERE reason IS NOT NULL GROUP BY 1, 2
UNION ALL SELECT 'split', warning, count(*) FROM splits WHERE warning IS NOT NULL GROUP BY 1, 2""",
    "project_counts": FACTS + _ALL_PATHS + """
SELECT project, count(*) FILTER (kind = 'test') AS n_tests, count(*) FILTER (kind = 'src') AS n_sources
FROM paths GROUP BY 1""",
    "oracle_kind": FACTS + """
SELECT test_path AS path, j AS ordinal,
  CASE m WHEN 0 THEN 'value' WHEN 1 THEN 'exception' WHEN 2 THEN 'none' WHEN 3 THEN 'both' ELSE 'value' END AS oracle_kind
FROM t WHERE test_ok""",
    "expected_exception": FACTS + """
SELECT test_path AS path, j AS ordinal,
  CASE m WHEN 1 THEN 'IllegalArgumentException' WHEN 3 THEN 'NullPointerException' ELSE '' END AS exception_type,
  CASE WHEN m IN (1, 3) THEN concat('org.p', b, '.C', k) ELSE '' END AS verified_class,
  CASE m WHEN 1 THEN concat('no message for ', k, ' {') ELSE '' END AS message
FROM t WHERE test_ok""",
    "oracle_edit_distance": f"""
SELECT 'math' AS bug_project, k AS bug_id,
  CAST(levenshtein({S.template(_SECTIONS[0][1])}, {S.template(_SECTIONS[2][1])}) AS INT) AS prefix_distance, CAST(1 AS INT) AS turn,
  CAST(levenshtein({S.template(_SECTIONS[1][1])}, {S.template(_SECTIONS[3][1])}) AS INT) AS assertion_distance,
  CAST(levenshtein({S.template(_SECTIONS[1][1])}, {S.template(_SECTIONS[4][1])}) AS INT) AS oracle_distance
FROM ({_CASES})""",
}

# The same rows as of other queries, counted or written out and read back.
ORACLE_SQL |= {
    "input_count": f"SELECT count(*) AS n_inputs FROM ({ORACLE_SQL['input_rows']})",
    "corpus_counts": f"SELECT half, count(DISTINCT project_id) AS n_files, count(*) AS n_lines FROM ({ORACLE_SQL['combine_corpus']}) GROUP BY half",
    "export_overall": f"SELECT row_number() OVER (ORDER BY path, ordinal, split_no) AS line_no, assertion, prefix_focal FROM ({ORACLE_SQL['samples_per_assert']})",
    "export_meta": "SELECT " + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in C.META_COLUMNS) + f" FROM ({ORACLE_SQL['meta_rows']})",
}
