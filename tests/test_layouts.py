"""Extraction on layouts that real files use: braces on their own line, inline attributes, wrapped signatures,
generics, nested functions, two methods on a line, doc blocks; and what commenting out does to them."""

from culler.operators import extract as X
from culler.operators import transform as T

FILES = {
    "A.cs": '''class K
{
    [TestCase(new[] { 1 }, "x")] public void SameLine() { a(); }

    /* c */
    [Test]
    [Category("slow")]
    public async Task<Dictionary<string, int>> NextLine<T>(
        int a,
        Func<int, int> f)
        where T : class
    {
        if (a > 0) { while (b) { c(); } }
    }
    public int[] One() { return x; } private int Two() { return y; }
}
''',
    "B.java": '''class T {
  @Test public void inline() { x(); }
  Map<String, Integer> gen() { return new HashMap<>() {{ put("a", 1); }}; }
  @ParameterizedTest(name = "n(1)")
  @CsvSource({"a"})
  public <T extends Comparable<T>> List<T> wrapped(
      List<Map<String, T>> a,
      int b) throws IOException,
      Other
  {
    for (;;) { if (a) { b(); } else { c(); } }
  }
}
''',
    "C.php": '''<?php
class C
{
    /**
     * @test
     * @dataProvider rows
     */
    public static function it_works(array $a, $b = []): ?string
    {
        return "x";
    }
    private function plain($x) { return $x; }
}
''',
    "d.go": '''package d

// Add adds.
func (s *Svc) Add(
	a int,
	b int,
) (int, error) {
	return a + b, nil
}
func helper[T any](x T) T { return x }
''',
    "e.js": '''/** doc */
export async function top(a, {b}) {
  return 1;
}
describe("group", () => {
  before();
  it("one", async () => {
    if (x) { y(); }
  });
  it('two', function () { z(); });
  after();
});
const arrow = async (a, b) =>
{
  return a;
};
''',
    "f.py": '''import x

@patch(
    "a.b",
)
@other
def test_long(self, x: Dict[str, int] = {}, *args,
              y: int = f(1, 2), s=",", **kw) -> Dict[str, int]:
    """doc"""

    def inner():
        return 1
    return inner()

class K:
    def a(self): return 1
    def b(
        self
    ):
        return 2
x = 1
''',
    "g.rb": '''# documented
def ok?(a, b = f(1))
  a
end
private def self.go! x
  y end
def test_z
  allow(svc).to receive(:go)
end
''',
}


def methods(spark, files=FILES):
    rows = [("s", p, c) for p, c in files.items()]
    return X.extract_methods(spark.createDataFrame(rows, "suite string, path string, content string"))


def test_layouts(spark):
    got = {(r.path, r.name): r for r in methods(spark).collect()}
    spans = {k: (r.line_start, r.header_line, r.line_end) for k, r in got.items()}
    assert spans == {
        ("A.cs", "SameLine"): (3, 3, 3), ("A.cs", "NextLine"): (6, 8, 14), ("A.cs", "One"): (15, 15, 15), ("A.cs", "Two"): (15, 15, 15),
        ("B.java", "inline"): (2, 2, 2), ("B.java", "gen"): (3, 3, 3), ("B.java", "wrapped"): (4, 6, 12),
        ("C.php", "it_works"): (8, 8, 11), ("C.php", "plain"): (12, 12, 12),
        ("d.go", "Add"): (4, 4, 9), ("d.go", "helper"): (10, 10, 10),
        ("e.js", "top"): (2, 2, 4), ("e.js", "group"): (5, 5, 12), ("e.js", "arrow"): (13, 13, 16),
        ("f.py", "test_long"): (3, 7, 13), ("f.py", "a"): (16, 16, 16), ("f.py", "b"): (17, 17, 20),
        ("g.rb", "ok?"): (2, 2, 4), ("g.rb", "go!"): (5, 5, 6), ("g.rb", "test_z"): (7, 7, 9),
    }
    a = {k: r.attributes for k, r in got.items()}
    assert a["A.cs", "SameLine"] == ['[TestCase(new[] { 1 }, "x")]'] and a["A.cs", "NextLine"] == ["[Test]", '[Category("slow")]']
    assert a["B.java", "inline"] == ["@Test"] and a["B.java", "wrapped"] == ['@ParameterizedTest(name = "n(1)")', '@CsvSource({"a"})']
    assert a["C.php", "it_works"] == ["@test", "@dataProvider", "static"] and a["C.php", "plain"] == []
    assert a["d.go", "Add"] == ["receiver: s *Svc"] and a["e.js", "top"] == ["/**...*/", "async"]
    assert a["f.py", "test_long"] == ['@patch(\n    "a.b",\n)', "@other"]
    assert a["g.rb", "ok?"] == ["# documented", "predicate"] and "mutating" in a["g.rb", "go!"]
    assert got["f.py", "test_long"].parameters == "self, x, *args, y, s, **kw" and got["f.py", "test_long"].return_type == "Dict[str, int]"
    assert got["A.cs", "NextLine"].return_type == "Task<Dictionary<string, int>>" and got["B.java", "gen"].return_type == "Map<String, Integer>"
    assert got["C.php", "it_works"].return_type == "?string"
    assert got["e.js", "group"].body.startswith("describe(") and "after();" in got["e.js", "group"].body
    keys = [(r.path, r.method_seq) for r in got.values()]
    assert len(set(keys)) == len(keys)


def test_headers_of_nested_functions(spark):
    rows = [("s", "e.js", FILES["e.js"])]
    h = X.method_headers(spark.createDataFrame(rows, "suite string, path string, content string")).collect()
    assert sorted((r.line_no, r.name) for r in h) == [(2, "top"), (5, "group"), (7, "one"), (10, "two"), (13, "arrow")]


def test_commenting_out_leaves_whole_methods(spark):
    m = methods(spark)
    picked = m.filter("name in ('group', 'One', 'b')").select("path", "method_seq")
    files = X.detect_language(spark.createDataFrame([("s", p, c) for p, c in FILES.items()], "suite string, path string, content string"))
    out = {}
    for r in T.comment_out(X.explode_lines(files), m, picked).collect():
        out.setdefault(r.path, {})[r.line_no] = r.line
    js = [out["e.js"][i] for i in sorted(out["e.js"])]
    assert js[4:12] == FILES["e.js"].split("\n")[4:12]  # the picked group is whole
    assert js[1] == "// export async function top(a, {b}) {" and js[15] == "// };"
    assert not out["A.cs"][15].startswith("//")  # a line that a picked method shares stays
    assert out["f.py"][16] == "#     def a(self): return 1" and out["f.py"][18] == "        self"


def test_suite_of_two_files_has_unique_keys(spark):
    m = methods(spark, {"a.go": "func A() {}\nfunc B() {}\n", "b.go": "func A() {}\n"})
    rows = [(r.suite, r.path, r.method_seq) for r in m.collect()]
    assert len(rows) == 3 and len(set(rows)) == 3


BRACED = {
    "h.go": '''package h

func A(v interface{}) error { return nil }
func B(m map[string]interface{}, c chan struct{}, f func(int) (interface{}, error)) {
	x := struct{}{}
}
func C() (interface{}, error) { return nil, nil }
func D() interface{} {
	return 1
}
func (s *S) E() map[string]struct{ a, b int } { return nil }
func F() func(int) error { return nil }
func stub(x int)
func G() myinterface { return y }
func H() { var a interface{} }
''',
    "i.js": '''const o = {
  prop: function (a) {
    return a;
  },
  arrow: async (b) => { c(); },
};
export const shared = (a, b) => {
  return a;
};
module.exports.member = function (x) { return x; };
K.prototype.run = async () => {
  go();
};
export default function main() { }
var old = function named() { if (x) { y(); } };
''',
}


def test_braces_in_go_types_and_function_values_in_javascript(spark):
    got = {(r.path, r.name): r for r in methods(spark, BRACED).collect()}
    assert {k: (r.line_start, r.line_end) for k, r in got.items()} == {
        ("h.go", "A"): (3, 3), ("h.go", "B"): (4, 6), ("h.go", "C"): (7, 7), ("h.go", "D"): (8, 10), ("h.go", "E"): (11, 11),
        ("h.go", "F"): (12, 12), ("h.go", "G"): (14, 14), ("h.go", "H"): (15, 15),
        ("i.js", "prop"): (2, 4), ("i.js", "arrow"): (5, 5), ("i.js", "shared"): (7, 9), ("i.js", "member"): (10, 10),
        ("i.js", "run"): (11, 13), ("i.js", "main"): (14, 14), ("i.js", "old"): (15, 15),
    }
    assert {n: got["h.go", n].return_type for n in "ABCDEFGH"} == {
        "A": "error", "B": "", "C": "(interface{}, error)", "D": "interface{}", "E": "map[string]struct{ a, b int }",
        "F": "func(int) error", "G": "myinterface", "H": ""}
    assert got["h.go", "A"].parameters == "v interface{}" and got["h.go", "D"].body.endswith("return 1\n}")
    assert got["i.js", "prop"].parameters == "a" and got["i.js", "shared"].parameters == "a, b"


LEXICAL = {
    "a.go": 'package a\nfunc TestA(t *testing.T) {\n\ts := "{"\n\tr := \'{\' // {\n\tq := `{{`\n}\nfunc TestB(t *testing.T) { m.EXPECT() }\n// func no() {\nfunc c() int { return 1 }\n',
    "b.js": 'it("a {b", () => {\n  x.replace(/{/, "");\n  y = a / 2; z = "}";\n});\nit("c", () => { const t = `}${u}{`; });\n'
            "class K {\n  get v() { return 1; } #p() { return 2; }\n  static async *gen(a) { yield a; }\n}\nfunction last() { return /[/}]/.test(q); }\n",
    "c.php": "<p>Don't {</p>\n<?php\nfunction a() { $x = '{'; $y = \"}}\"; # {\n  return <<<EOT\n}\nEOT;\n}\nfunction b() { return 1; }\n?>\nIt's {\n<?php function c() { }\n",
    "D.java": 'class D {\n  void a() { String s = "{"; char c = \'{\'; }\n  // void no() {\n  void b() { // }\n    x(); /* } */\n  }\n  String t() { return """\n}\n"""; }\n}\n',
    "E.cs": 'class E {\n  [Case("a)[")]\n  void A() { var s = $"{{"; var t = @"\\"; var u = @"""{"; }\n  void B() { var c = \'}\'; }\n}\n',
    "open.java": 'class O {\n  void never() { if (a) { b();\n  void after() { c(); }\n  void last() { d(); }\n',
    "f.py": 'def test_a(self):\n    q = """\nselect 1 (\ndef no():\n"""\n# column 0\n    r = [\n1,\n]\n    s = f(\\\n1)\n    m.assert_called_with(1)\n\n# outside\n'
            "def b():  # (\n    return ')'\nx = (\ndef c(s='('):\n    return 1\n",
}


def test_literals_and_comments_open_and_close_nothing(spark):
    got = {}
    for r in sorted(methods(spark, LEXICAL).collect(), key=lambda r: (r.path, r.line_start, r.method_seq)):
        got.setdefault(r.path, []).append((r.name, r.line_start, r.line_end))
    assert got["a.go"] == [("TestA", 2, 6), ("TestB", 7, 7), ("c", 9, 9)]
    assert got["b.js"] == [("a {b", 1, 4), ("c", 5, 5), ("v", 7, 7), ("#p", 7, 7), ("gen", 8, 8), ("last", 10, 10)]
    assert got["c.php"] == [("a", 3, 7), ("b", 8, 8), ("c", 11, 11)]
    assert got["D.java"] == [("a", 2, 2), ("b", 4, 6), ("t", 7, 9)]
    assert got["E.cs"] == [("A", 2, 3), ("B", 4, 4)]
    assert got["open.java"] == [("after", 3, 3), ("last", 4, 4)]
    assert got["f.py"] == [("test_a", 1, 12), ("b", 15, 16), ("c", 18, 19)]


def test_bodies_and_attributes_show_what_was_hidden(spark):
    by = {(r.path, r.name): r for r in methods(spark, LEXICAL).collect()}
    assert by["E.cs", "A"].attributes == ['[Case("a)[")]'] and '$"{{"' in by["E.cs", "A"].body
    assert by["f.py", "c"].parameters == "s" and "assert_called_with" in by["f.py", "test_a"].body
    assert by["b.js", "gen"].attributes == ["async", "static"]
    assert X.filter_mocks(X.filter_tests(methods(spark, {"f.py": LEXICAL["f.py"]}))).count() == 1


def test_rules_passed_along_reach_tests_mocks_and_comments(spark):
    import dataclasses

    from culler.functions import lang_rules as LR

    rules = LR.with_language(dataclasses.replace(LR.RULES["go"], language="gox", extensions=[".gx"], acts_as="go", comment=";;"))
    files = X.detect_language(spark.createDataFrame([("s", "a.gx", "func TestA(t *T) {\n  m.EXPECT()\n}\n")], "suite string, path string, content string"), rules=rules)
    found = X.extract_methods(files, rules=rules)
    assert X.filter_mocks(X.filter_tests(found, rules), rules).count() == 1
    assert [r.subject for r in X.mock_lines(found, rules).collect()] == ["m.EXPECT()"]
    out = T.comment_out(X.explode_lines(files), found, found.filter("false"), rules).collect()
    assert [r.line for r in sorted(out, key=lambda r: r.line_no)][:3] == [";; func TestA(t *T) {", ";;   m.EXPECT()", ";; }"]
