"""These decide the produced corpus and must not drift."""

# Words removed from code when a sample is rendered.
MODIFIERS = (
    "public", "private", "protected", "static", "final", "synchronized",
    "abstract", "native", "transient", "volatile", "strictfp",
)

# Words removed from a token-normalised test prefix.
ACCESS_MODIFIERS = ("public", "private", "protected")

# Characters that get a space on both sides.
SPACED_SYMBOLS = r"[{}();.,=+\-*/<>!&|?:\[\]]"

# Projects taken by the small-sample switch.
SAMPLE_PROJECTS = ("Chart", "Cli", "Csv", "Gson", "Lang")

# Folder layout and file names.
TEST_DIR = "evosuite-tests"
SOURCE_DIR = "src/main/java"
TEST_SUFFIX = "EvoSuiteTest"
PROJECT_PATTERN = r"^\d+_\w+"
TEST_PATH_PATTERN = r"(\d+_\w+).*?([^/]+)EvoSuiteTest\.java$"
ASSERT_FILE_PATTERN = r"^(\d+)_assert\.txt"
PREFIX_FOCAL_FILE_PATTERN = r"^(\d+)_prefix_focal\.txt"

# Assertions: the shortest up to ");" and the longest on one line.
SHORT_ASSERTION = r"assert\w*\(.*?\);"
LONG_ASSERTION = r"assert\w*\(.*\)"
TEST_NAME = r"public void (test[0-9]*)\(\)"
PACKAGE = r"package\s+(\S+);"
FAIL_THEN_CATCH = r"(?s)fail\(.*\).*}\s*catch"

# Calls that never name a focal method.
NON_FOCAL_CALLS = ("fail", "verifyException")
NON_FOCAL_PART = "assert"

# Rendered sample.
ASSERT_PLACEHOLDER = '"<AssertPlaceHolder>"'
FOCAL_MARKER = '"<FocalMethod>"'
UNKNOWN_FOCAL = "<UnknownFocalMethodText>"

# Column order of the two CSV outputs.
INPUT_COLUMNS = ("focal_method", "test_prefix", "docstring")
META_COLUMNS = (
    "project", "bug_num", "test_name", "exception_bug", "assertion_bug",
    "exception_lbl", "assertion_lbl", "assert_err",
)
