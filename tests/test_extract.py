"""Extraction on hand-written files (edge cases of FIXTURES §4)."""

from culler.operators import extract as X
from culler.operators import transform as T

PY = '''import x

@patch("a.b")
@other
def test_one(self, m):
    def inner():
        return 1
    self.svc.return_value = 3

    m.svc.assert_called_once_with(3)

class K:
    def _helper(self):
        return 2
'''

JAVA = '''class T {
  @Test
  public void testA() {
    if (a) { if (b) { if (c) { if (d) { x(); } } } }
    mockMvc.perform(post("/x")).andExpect(ok());
  }
  private int helper(int x) { return x; }
}
'''

RB = '''# documented
def test_x
  allow(svc).to receive(:go)
end
'''


def files(spark):
    return spark.createDataFrame([("s1", "a.py", PY), ("s2", "B.java", JAVA), ("s3", "c.rb", RB), ("s4", "d.txt", "x"),
                                  ("s5", "e.py", "")], "suite string, path string, content string")


def test_methods_spans_and_attributes(spark):
    m = {r["name"]: r for r in X.extract_methods(files(spark)).collect()}
    assert set(m) == {"test_one", "_helper", "testA", "helper", "test_x"}
    assert (m["test_one"]["line_start"], m["test_one"]["line_end"]) == (3, 10)
    assert m["test_one"]["attributes"] == ['@patch("a.b")', "@other"]
    assert m["_helper"]["access_modifier"] == "protected"
    assert (m["testA"]["line_start"], m["testA"]["line_end"]) == (2, 6)
    assert m["testA"]["attributes"] == ["@Test"] and m["testA"]["access_modifier"] == "public"
    assert m["helper"]["body"] == "private int helper(int x) { return x; }"
    assert m["test_x"]["attributes"] == ["# documented"] and m["test_x"]["line_end"] == 4


def test_filters_and_strip(spark):
    m = X.extract_methods(files(spark))
    tests = X.filter_mocks(X.filter_tests(m))
    got = {r["name"]: r["body"] for r in X.strip_to_interactions(tests).collect()}
    assert got == {"test_one": "svc\nm.svc", "testA": 'post("/x")', "test_x": "allow(svc).to receive(:go)"}


def test_comment_out(spark):
    f = X.detect_language(files(spark))
    m = X.extract_methods(f).filter("path = 'B.java'")
    picks = m.filter("name = 'testA'").select("path", "method_seq")
    lines = {r["line_no"]: r["line"] for r in T.comment_out(X.explode_lines(f), m, picks).collect()}
    assert lines[7] == "//   private int helper(int x) { return x; }"
    assert lines[4] == "    if (a) { if (b) { if (c) { if (d) { x(); } } } }"
