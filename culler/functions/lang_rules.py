"""Per-language rule sets (D2-D5, §2.3) as data.

Each language has: file extensions, header patterns over the whole file (Java regex,
groups named in ``groups``), test markers, mock filters (literal substrings or
regexes), a comment symbol and an optional mock-subject pattern.  A user adds a
language with ``register_language`` (UF2); ``rules_frame`` exposes all rules
as a small dimension table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class LangRules:
    language: str
    extensions: list[str]
    headers: list[tuple[str, dict[str, int]]]  # (regex, {field: group})
    test_markers: list[str]
    mock_filters: list[str]
    mocks_are_regex: bool
    comment: str
    block: str  # "brace", "indent" or "end"
    subject_patterns: list[str] = field(default_factory=list)  # first hit wins; empty -> trimmed line
    subject_on_stripped: bool = False
    acts_as: str = ""  # a plug-in language that follows another's rules for attributes and visibility
    literals: str = ""  # strings, characters, comments, ...: what stands in them opens, closes and declares nothing (no capturing group but named ones)


# ---- fixed values that must equal the reference's for equal results ----
# Test markers, mock filters and mock-subject patterns per language, as stated by
# the reference's rule sets (header patterns below are our own forms over the whole file).
PY_MOCK_REGEX = [
    r"@\s*patch\b", r"@\s*mock\.patch\b", r"\bpatch\s*\(", r"\bmock\.patch\s*\(", r"\bMock\s*\(",
    r"unittest\.mock\.patch\b", r"unittest\.mock\.Mock\b", r"\.assert_called_with\b", r"\.assert_called_once_with\b",
    r"\.assert_any_call\b", r"\.assert_has_calls\b", r"\.assert_not_called\b", r"\.return_value\b", r"\.side_effect\b",
    r"\.spec\b", r"with\s+patch\b", r"with\s+mock\.patch\b",
]
PY_SUBJECT = r"(?:self\.)?([a-zA-Z_][a-zA-Z0-9_.]*?)\s*(?=\.assert_|\.return_value|\.side_effect|\.spec|=|\.call_args|\.assert_not_called)"
JAVA_SUBJECT = r"\.perform\s*\((?:[a-zA-Z0-9_.]*\.)?((?:get|post|put|delete|patch|head|options)\s*\(.*?\))"
CSHARP_MOCKS = ["new Mock<", ".Setup(", ".Verify(", ".Returns(", ".Throws(", "It.IsAny<", ".Object", "[Mock]", ".CallBase"]
JAVA_MOCKS = [".mock(", "@Mock", "verify(", "doReturn(", ".thenReturn(", "mock.", "mock_", "Mock.", "Mock<", "Bean", "mockMvc"]
GO_MOCKS = ["gomock.NewController(", "NewMock", ".EXPECT(", ".Return(", "testify/mock.Mock", ".On(", ".AssertCalled(",
            ".AssertExpectationsMet("]
JS_MOCKS = ["jest.mock(", "jest.fn(", ".mockReturnValue(", ".mockResolvedValue(", ".mockImplementation(", "sinon.stub(",
            "sinon.mock(", ".calledWith(", ".verify("]
PHP_MOCKS = ["$this->createMock(", "$this->getMockBuilder(", "->expects(", "->method(", "Mockery::mock(", "->shouldReceive(",
             "->andReturn(", "->once()", "->times("]
RUBY_MOCKS = ["allow(", "expect(", ".to receive(", ".and_return(", "mock(", "stub(", "stub_request("]
CSHARP_TESTS = [r"\[Test\]", r"\[TestMethod\]", r"\[Fact\]", r"\[Theory\]", r"\[TestCase.*?\]"]
JAVA_TESTS = [r"@Test", r"@TestMethod", r"@ParameterizedTest", r"@RepeatedTest", r"@DisplayName"]
GO_TESTS = [r"func Test", r"func Benchmark", r"func Example"]
JS_TESTS = [r"describe\(", r"it\(", r"test\(", r"@Test", r"jest\.", r"mocha\."]
PHP_TESTS = [r"@test", r"@Test", r"function test", r"@dataProvider", r"@depends"]
PY_TESTS = [r"pytest", r"unittest", r"def test_"]
RUBY_TESTS = [r"def test_", r"it\s+[\"']", r"describe\s+[\"']", r"context\s+[\"']", r"should\s+[\"']"]
# Extension -> language.
EXTENSIONS = {".cs": "csharp", ".py": "python", ".java": "java", ".js": "javascript", ".php": "php", ".rb": "ruby",
              ".go": "go"}
# Characters above a method that are searched for its doc block.
DOC_WINDOW = {"php": 500, "javascript": 200}
# Lines above a method whose first one that isn't blank decides whether it is documented.
DOC_LINES = {"go": 5, "ruby": 10}
# -------------------------------------------------------------------------

# Words that are statements, not method names.
RESERVED = ["if", "for", "while", "switch", "catch", "return", "new", "else", "do", "try", "using", "lock", "foreach",
            "function", "throw", "typeof", "await", "yield", "case", "sizeof"]

# Parts of the header patterns. They run over a whole file, so white space may hold line ends; possessive
# quantifiers keep them linear.
_NOT_RESERVED = r"(?!(?:" + "|".join(RESERVED) + r")\b)"
_PARAMS = r"([^(){};]*+(?:\([^()]*+(?:\([^()]*+\)[^()]*+)*+\)[^(){};]*+)*+)"
_JS_PARAMS = r"([^()]*+(?:\([^()]*+\)[^()]*+)*+)"
# Go types hold balanced braces (interface{}, struct{ a int }) and function types; a result's braces follow these two words only.
_GO_BRACES = r"\{[^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+\}"
_GO_PARENS = r"\((?:[^(){};]++|" + _GO_BRACES + r"|\((?:[^(){};]++|" + _GO_BRACES + r")*+\))*+\)"
_GO_PARAMS = r"((?:[^(){};]++|" + _GO_BRACES + r"|" + _GO_PARENS + r")*+)"
_GO_WORD = r"(?:\b(?:interface|struct)\s*+" + _GO_BRACES + r"|(?!\b(?:interface|struct)\s*+\{)[^(){}\s;]|" + _GO_PARENS + r")"
_GO_RESULT = r"((?:" + _GO_WORD + r"(?:[ \t]*+" + _GO_WORD + r")*+)?+)"
_GENERIC = r"<[^<>(){};]*+(?:<[^<>(){};]*+(?:<[^<>(){};]*+>[^<>(){};]*+)*+>[^<>(){};]*+)*+>"
_TYPE = _NOT_RESERVED + r"([\w.]++(?:\s*+" + _GENERIC + r")?+\??+(?:\s*+\[[\s,]*+\])*+)"
_NAME = _NOT_RESERVED + r"(\w+)"
_FRESH = r"(?<![\w.$@)\]>])"  # not in the middle of a name, a member access or an indexed or generic expression
_MODS_JAVA = r"((?:(?:public|private|protected|static|final|abstract|synchronized|default)\s+)*+)"
_MODS_CS = r"((?:(?:public|private|protected|internal|static|virtual|override|async|sealed|abstract)\s+)*+)"
_MODS_PHP = r"((?:(?:public|private|protected|static|final|abstract)\s+)*+)"
_ANNOTATIONS = r"((?:@\w+(?:\([^()]*+(?:\([^()]*+\)[^()]*+)*+\))?+\s*+)*+)"
_CS_ATTRIBUTES = r"((?:\[[^\[\]]*+(?:\[[^\[\]]*+\][^\[\]]*+)*+\]\s*+)*+)"
_DECORATORS = r"((?:@[^\n]*+\n(?:(?![ \t]*+(?:@|def\b|async\b|class\b))[^\n]*+\n)*+[ \t]*+)*+)"

# Literals and comments: one alternation per language, tried from left to right, so each is read in its own state.
# Loops are unrolled and possessive; a quote that never closes matches nothing and stays an ordinary character.
_DOUBLE = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'
_SINGLE = r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
_SLASHES = r"//[^\n]*+|/\*[\s\S]*?\*/"
_JS_REGEX = (r"/(?<=(?:\A|[(,=:\[!&|?{;+*%~^\n-]|\breturn|\btypeof|\bcase|=>)[ \t]{0,16}/)(?![*/])"
             r"[^/\\\[\n]*+(?:(?:\\.|\[[^\]\\\n]*+(?:\\.[^\]\\\n]*+)*+\])[^/\\\[\n]*+)*+/")
LITERALS = {
    "python": r'"""[^"\\]*+(?:(?:\\[\s\S]|"(?!""))[^"\\]*+)*+"""' + r"|'''[^'\\]*+(?:(?:\\[\s\S]|'(?!''))[^'\\]*+)*+'''"
              + r'|"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"' + r"|'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'" + r"|#[^\n]*+|\\\n",
    "java": r'"""[\s\S]*?(?<!\\)"""|' + "|".join((_DOUBLE, _SINGLE, _SLASHES)),
    "csharp": r'"""[\s\S]*?"""|(?:\$@|@\$?)"[^"]*+(?:""[^"]*+)*+"|' + "|".join((_DOUBLE, _SINGLE, _SLASHES)),
    "go": "`[^`]*+`|" + "|".join((_DOUBLE, _SINGLE, _SLASHES)),
    "javascript": "|".join((_DOUBLE, _SINGLE, r"`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`", _SLASHES, _JS_REGEX)),
    "php": (r"\A[\s\S]*?<\?(?:php\b|=)|\?>[\s\S]*?(?:<\?(?:php\b|=)|\z)|<<<[ \t]*+[\"']?(?<doc>\w+)[\"']?[ \t]*+\n[\s\S]*?\n[ \t]*+\k<doc>\b"
            r'|"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"' + r"|'[^'\\]*+(?:\\[\s\S][^'\\]*+)*+'" + r"|#(?!\[)[^\n]*+|" + _SLASHES),
}

RULES: dict[str, LangRules] = {
    "python": LangRules(
        "python", [".py"],
        [(r"(?m)^([ \t]*+)" + _DECORATORS + r"def\s+([A-Za-z_]\w*)\s*\(([^()]*+(?:\([^()]*+(?:\([^()]*+\)[^()]*+)*+\)[^()]*+)*+)\)\s*(?:->\s*([^:\n]+?)\s*)?:",
          {"indent": 1, "attrs": 2, "name": 3, "params": 4, "return_type": 5})],
        PY_TESTS, PY_MOCK_REGEX, True, "#", "indent", [PY_SUBJECT], False, literals=LITERALS["python"]),
    "java": LangRules(
        "java", [".java"],
        [(_FRESH + _ANNOTATIONS + _MODS_JAVA + r"(?:" + _GENERIC + r"\s*+)?+" + _TYPE + r"\s+" + _NAME + r"\s*\(" + _PARAMS
          + r"\)\s*(?:throws\s+[\w\s,.]+?)?\s*\{",
          {"attrs": 1, "modifiers": 2, "return_type": 3, "name": 4, "params": 5})],
        JAVA_TESTS, JAVA_MOCKS, False, "//", "brace", [JAVA_SUBJECT], True, literals=LITERALS["java"]),
    "csharp": LangRules(
        "csharp", [".cs"],
        [(_FRESH + _CS_ATTRIBUTES + _MODS_CS + _TYPE + r"\s+" + _NAME + r"\s*(?:" + _GENERIC + r"\s*)?\(" + _PARAMS + r"\)\s*(?:where\s[^{};]*+)?\{",
          {"attrs": 1, "modifiers": 2, "return_type": 3, "name": 4, "params": 5})],
        CSHARP_TESTS, CSHARP_MOCKS, False, "//", "brace", literals=LITERALS["csharp"]),
    "go": LangRules(
        "go", [".go"],
        [(r"(?m)^[ \t]*+func\s+(?:\(([^)]*)\)\s*)?(\w+)\s*(?:\[[^\]]*\]\s*)?\(" + _GO_PARAMS + r"\)[ \t]*+" + _GO_RESULT + r"\s*\{",
          {"receiver": 1, "name": 2, "params": 3, "return_type": 4})],
        GO_TESTS, GO_MOCKS, False, "//", "brace", literals=LITERALS["go"]),
    "javascript": LangRules(
        "javascript", [".js"],
        [(r"(?m)^[ \t]*+(?:it|test|describe)\s*\(\s*[\"'`]([^\"'`]*)[\"'`]\s*,\s*(?:async\s+)?(?:\(" + _JS_PARAMS + r"\)|function\s*\(" + _JS_PARAMS
          + r"\))\s*(?:=>)?\s*\{", {"name": 1, "params": 2}),
         (r"(?m)^[ \t]*+((?:(?:async|static|export|default)\s+)*)function\s+(\w+)\s*\(" + _JS_PARAMS + r"\)\s*\{", {"modifiers": 1, "name": 2, "params": 3}),
         (r"(?m)^[ \t]*+(?:export\s+)?(?:const\s+|let\s+|var\s+)?(?:[\w$]+\s*\.\s*)*+(\w+)\s*=\s*(async\s+)?(?:function\b\s*\*?\s*\w*\s*)?\(" + _JS_PARAMS
          + r"\)\s*(?:=>\s*)?\{", {"name": 1, "modifiers": 2, "params": 3}),
         (r"(?m)(?:^|(?<=[{,]))[ \t]*+(\w+)\s*:\s*(async\s+)?(?:function\b\s*\*?\s*\w*\s*)?\(" + _JS_PARAMS + r"\)\s*(?:=>\s*)?\{",
          {"name": 1, "modifiers": 2, "params": 3}),
         (r"(?m)(?:^|(?<=[{};,]))[ \t]*+((?:(?:async|static|get|set)\s+)*)(?:\*\s*)?" + _NOT_RESERVED + r"(#?[\w$]+)\s*\(" + _JS_PARAMS + r"\)\s*\{",
          {"modifiers": 1, "name": 2, "params": 3})],
        JS_TESTS, JS_MOCKS, False, "//", "brace", literals=LITERALS["javascript"]),
    "php": LangRules(
        "php", [".php"],
        [(r"(?<![\w$>])" + _MODS_PHP + r"function\s+&?\s*(\w+)\s*\(" + _PARAMS + r"\)\s*(?::\s*(\??[\w\\|]+))?\s*\{",
          {"modifiers": 1, "name": 2, "params": 3, "return_type": 4})],
        PHP_TESTS, PHP_MOCKS, False, "//", "brace", literals=LITERALS["php"]),
    "ruby": LangRules(
        "ruby", [".rb"],
        [(r"(?m)^[ \t]*+((?:private|protected|public)\s+)?def\s+(?:self\.)?(\w+[?!]?)[ \t]*(?:\(" + _PARAMS + r"\))?",
          {"modifiers": 1, "name": 2, "params": 3})],
        RUBY_TESTS, RUBY_MOCKS, False, "#", "end"),
}


def with_language(rules: LangRules, table: dict[str, LangRules] | None = None) -> dict[str, LangRules]:
    """The rule table with one language added; its extensions are taken from the languages that had them."""
    kept = {k: r for k, r in (table or RULES).items() if k == rules.language or not set(r.extensions) <= set(rules.extensions)}
    return kept | {rules.language: rules}


def register_language(rules: LangRules) -> None:
    """UF2: add (or replace) a language; its extensions take over detection."""
    RULES[rules.language] = rules


def extension_map(table: dict[str, LangRules] | None = None) -> dict[str, str]:
    out = {}
    for r in (table or RULES).values():
        for e in r.extensions:
            out[e] = r.language
    return out


def mock_regex(r: LangRules) -> str:
    """One alternation per language: regexes as they are, literals quoted."""
    parts = r.mock_filters if r.mocks_are_regex else [re.escape(f) for f in r.mock_filters]
    return "|".join(f"(?:{p})" for p in parts)


def marker_regex(r: LangRules) -> str:
    return "(?i)(?:" + "|".join(f"(?:{p})" for p in r.test_markers) + ")"


def rules_frame(spark: SparkSession) -> DataFrame:
    """The rule sets as a dimension table (language, kind, pattern, is_regex)."""
    rows = []
    for r in RULES.values():
        rows += [(r.language, "extension", e, False) for e in r.extensions]
        rows += [(r.language, "header", h, True) for h, _ in r.headers]
        rows += [(r.language, "test_marker", m, True) for m in r.test_markers]
        rows += [(r.language, "mock_filter", m, r.mocks_are_regex) for m in r.mock_filters]
        rows += [(r.language, "comment", r.comment, False)]
        rows += [(r.language, "subject", s, True) for s in r.subject_patterns]
    return spark.createDataFrame(rows, "language string, kind string, pattern string, is_regex boolean")
