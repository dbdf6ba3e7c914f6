import os
import tempfile

from culler.streaming.files import watch_test_files


def test_stream_extracts_new_files(spark):
    src = tempfile.mkdtemp(prefix="culler-src-")
    out = tempfile.mkdtemp(prefix="culler-out-")
    with open(os.path.join(src, "t.py"), "w") as fh:
        fh.write("@patch('x')\ndef test_a(self, m):\n    m.x.return_value = 1\n")
    with open(os.path.join(src, "T.java"), "w") as fh:
        fh.write("@Test\npublic void testB() {\n  verify(m);\n}\n")
    q = watch_test_files(spark, src, out, trigger_once=True, checkpoint=os.path.join(out, "_ckpt"))
    q.awaitTermination(120)
    names = {r["name"] for r in spark.read.parquet(out).collect()}
    assert names == {"test_a", "testB"}
