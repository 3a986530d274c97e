import hashlib
import hmac
import json
import random

import pytest
from pyspark.sql import functions as F

from shirabe import sinks
from shirabe.detect import rules as R
from shirabe.detect.engine import Config, Detector, Finding, resolve
from shirabe.operators import baseline as B
from shirabe.operators import correlate as K
from shirabe.operators import evaluate as E
from shirabe.operators import scan as S
from shirabe.sources import config as C
from shirabe.sources import decode as X
from shirabe.sources import diff, files
from shirabe.streaming import scan_stream, write_findings

TEXT = "氏名: 山田太郎\r\nTEL: 090-1234-5678\nmail taro@gmail.com"


def test_scan_documents(spark):
    df = spark.createDataFrame([(1, TEXT, "a"), (2, None, "a"), (3, "", "a"), (4, "nothing here", "a"), (1, TEXT, "a"), (None, TEXT, "a")], "doc_id long, text string, line string")
    got = S.scan_documents(df).collect()
    assert {r.doc_id for r in got} == {1, None} and len(got) == 9 and {r.line_in for r in got} == {"a"}
    for r in got:
        assert TEXT[r.offset : r.end_offset] == r.match
    assert S.scan_documents(df.limit(0)).count() == 0
    lines = spark.createDataFrame([(1, "TEL: 090-1234-5678"), (2, None)], "i int, line_text string")
    assert [r.match for r in S.scan_lines(lines).collect()] == ["090-1234-5678"]


def test_gate_keeps_every_text_with_findings(spark):
    for c in (Config(), Config(high_recall=True), Config(custom=(R.custom_rule("own", "secret"),))):
        d = Detector(c)
        texts = ["full_name: Taro Yamada", "FULL_NAME: Taro Yamada", "０９０-1234-5678", "secret", TEXT, "x", "tel 12\n  \n \n3456", "date of birth: 1990-1-2", None]
        df = spark.createDataFrame([(t,) for t in texts], "text string")
        kept = {r.text for r in df.where(d.gate(F.col("text"))).collect()}
        assert {t for t in texts if t and d.scan(t)} <= kept


def test_resolution_same_as_in_the_matcher(spark):
    r = random.Random(5)
    rows = [(k, i, a, a + r.randint(1, 9), r.choice("xyz"), r.randint(1, 3), r.random() < 0.3, r.randint(40, 44)) for k in range(40) for i, a in enumerate(r.randint(0, 20) for _ in range(r.randint(1, 8)))]
    df = spark.createDataFrame(rows, "k int, o int, start int, end int, rule_id string, confidence int, fail_only boolean, score int")
    got = sorted(map(tuple, K.resolve_overlaps(df, ["k"], "o").select("k", "start", "end", "rule_id", "confidence", "score").collect()))
    want = []
    for k in range(40):
        want += [(k, f.start, f.end, f.rule_id, f.confidence, f.score) for f in resolve([Finding(x[4], 1, x[2], x[3], "", x[5], x[5], fail_only=x[6], score=x[7]) for x in rows if x[0] == k])]
    assert got == sorted(want)


def test_fingerprints_and_baseline(spark, tmp_path):
    salt = B.new_salt()
    df = spark.createDataFrame([("r", "ファイル", "値"), ("r", "f", "")], "rule_id string, file string, match string")
    df = df.withColumn("fingerprint", B.fingerprint(salt, F.col("rule_id"), F.col("file"), F.col("match")))
    want = {hmac.new(bytes.fromhex(salt), b"\0".join(x.encode() for x in v), hashlib.sha256).hexdigest() for v in (("r", "ファイル", "値"), ("r", "f", ""))}
    assert {r.fingerprint for r in df.collect()} == want
    B.write(df.limit(1).select("fingerprint"), salt, str(tmp_path / "b"))
    got_salt, known = B.read(spark, str(tmp_path / "b"))
    new, old = B.split(df, known)
    assert got_salt == salt and new.count() == old.count() == 1 and B.merge(known, df).count() == 2


def test_sinks(spark):
    df = S.scan_documents(spark.createDataFrame([("a:b,c.txt", TEXT)], "file string, text string"), path_col="file")
    text = [r.value for r in sinks.text_report(df).collect()]
    assert len(text) == 3 and "090-1234-5678" not in "".join(text) and text[1].startswith("a:b,c.txt:2:6 [high] jp-phone-number")
    doc = json.loads(sinks.json_report(df).first().value)
    assert doc["count"] == 3 and {f["rule_id"] for f in doc["findings"]} == {"person-name", "jp-phone-number", "email-address"}
    sarif = json.loads(sinks.sarif(df).first().value)
    one = next(r for r in sarif["runs"][0]["results"] if r["ruleId"] == "jp-phone-number")
    assert sarif["version"] == "2.1.0" and one["locations"][0]["physicalLocation"]["region"] == {"startLine": 2, "startColumn": 6, "endColumn": 19}
    assert one["partialFingerprints"]["primaryLocationLineHash"] == hashlib.sha256(b"jp-phone-number\0a:b,c.txt\x000").hexdigest()[:16]
    notes = [r.value for r in sinks.annotations(df).collect()]
    assert any(n.startswith("::error file=a%3Ab%2Cc.txt,line=2,col=6,") for n in notes)
    spans = {r.entity_type: (r.start, r.end) for r in sinks.entities(df).collect()}
    assert TEXT[slice(*spans["PHONE_NUMBER"])] == "090-1234-5678"
    assert sinks.summary(df).first().findings == 3 and K.exit_status(df, 3).first().status == 1 and K.exit_status(df.limit(0)).first().status == 0
    drops = S.dropped(spark.createDataFrame([("口座 1234567円",)], "text string"))
    assert json.loads(sinks.json_report(df, drops).first().value)["dropped_truncated"] is False


def test_decoding():
    t = "口座番号：1234567 テスト"
    assert X.decode(b"\xff\xfe" + t.encode("utf-16-le")) == t and X.decode(t.encode("utf-16-be") + "ab".encode("utf-16-be") * 9) is not None
    assert X.decode(t.encode("cp932")) == t and X.decode(t.encode("euc_jp")) == t and X.decode(t.encode("iso2022_jp")) == t and X.decode(t.encode()) == t
    assert X.decode(b"\0" + b"\7" * 9) is None and X.decode(b"\xff\xfea") is None and X.decode(None) is None and X.decode(b"") == ""
    assert X.json_escapes(r"山 \\u5c71 😀 \ud83d x \u000a") == r"山 \\u5c71 😀 \ud83d x \u000a"
    assert X.html_numbers("&#23665;&#x5C71;&#10;&#xD800;&amp;&#9999999;") == "山山&#10;&#xD800;&amp;&#9999999;"
    assert X.percent_runs("%E5%B1%B1 %20 %41%42 %E5%B1 %E5%B1%B1%0A") == "山 %20 %41%42 %E5%B1 %E5%B1%B1%0A"
    assert X.unescape(None) is None


PATCH = """diff --git a/x.txt b/x.txt
--- a/x.txt
+++ b/x.txt
@@ -1,3 +1,4 @@
 電話:
-old
+090-1234-5678
+++ looks like a header
 end
@@ -10 +12 @@ f
-a
+b
\\ No newline at end of file
--- a/gone.md
+++ /dev/null
@@ -3 +2,0 @@
-x
"""


def test_diffs(spark):
    got = list(diff.parse(PATCH))
    assert got == [("x.txt", 1, 1, ["電話:", "090-1234-5678", "++ looks like a header", "end"], [False, True, True, False]), ("x.txt", 2, 12, ["b"], [True])]
    h = diff.hunks(spark.createDataFrame([(7, PATCH), (8, None)], "i int, patch string"))
    assert [(r.i, r.file, r.line, r.text) for r in diff.added_lines(h).orderBy("line").collect()] == [(7, "x.txt", 2, "090-1234-5678"), (7, "x.txt", 3, "++ looks like a header"), (7, "x.txt", 12, "b")]
    assert [(r.file, r.line, r.match) for r in S.scan_hunks(h).select("file", "line", "match").collect()] == [("x.txt", 2, "090-1234-5678")]
    assert diff.post_revision("a..b") == "b" and diff.post_revision("a...") == "HEAD" and diff.post_revision("a") is None and diff.post_revision(None) == ""


def test_git(spark, tmp_path):
    import subprocess

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.csv").write_text("name,口座番号\nx,1\n", encoding="utf-8")
    run("add", ".")
    run("-c", "user.name=t", "-c", "user.email=t@t.org", "commit", "-qm", "one")
    (tmp_path / "a.csv").write_text("name,口座番号\nx,1\n" + "y,2\n" * 8 + "z,1234567\n", encoding="utf-8")
    run("add", ".")
    h = diff.hunks(diff.git_patch(spark, str(tmp_path)))
    images = diff.post_images(spark, str(tmp_path), ["a.csv"])
    got = S.scan_hunks(h.join(images, "file")).select("file", "line", "match").collect()
    assert [tuple(r) for r in got] == [("a.csv", 11, "1234567")]


def test_files(spark, tmp_path):
    for name, raw in (("a.txt", TEXT.encode("cp932")), ("b/c.txt", b"\0\1\2" * 9), ("node_modules/d.txt", TEXT.encode()), ("skip/e.txt", TEXT.encode()), ("f.txt", r"TEL: ０９０-1234-5678".encode())):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    found = files.scan_files(spark, str(tmp_path), config=Config(allow_paths=("skip/**",))).collect()
    assert {r.file.rpartition("/")[2] for r in found} == {"a.txt", "f.txt"}
    listed = files.list_files(spark, str(tmp_path), largest=59)
    assert {r.path.rpartition("/")[2] for r in listed.where(~files.binary(F.col("content"))).collect()} == {"a.txt", "f.txt"}
    texts, seen = files.observed(files.decoded(files.list_files(spark, str(tmp_path))))
    texts.collect()
    assert seen.get["files"] == 4 and seen.get["skipped"] == 1
    assert [r.match for r in files.scan_text(spark, TEXT).where("rule_id = 'jp-phone-number'").collect()] == ["090-1234-5678"]
    import re

    assert re.search(files.glob_pattern("**/*.md"), "/a/b/c.md") and not re.search(files.glob_pattern("*.md"), "/a/b.mdx") and files.glob_pattern("^a|b") == "^a|b"


def test_configuration(tmp_path):
    (tmp_path / ".shirabe.toml").write_text('min_confidence = "high"\n[rules]\ndisabled = ["jp-passport"]\nhigh_recall = true\n[[rules.custom]]\nid = "own"\npattern = "X[0-9]+"\n[allowlist]\nstopwords = ["x"]\n')
    (tmp_path / "deep").mkdir()
    c = C.load(str(tmp_path / "deep"))
    assert c.min_confidence == R.HIGH and c.high_recall and c.custom[0].id == "own" and "jp-passport" not in {r.id for r in Detector(c).rules}
    with pytest.warns(UserWarning, match="unknown key rules.x"):
        C.parse("[rules]\nx = 1")
    with pytest.raises(ValueError):
        C.parse('[[rules.custom]]\nid = "credit-card"\npattern = "x"')


def test_external(spark):
    df = spark.createDataFrame([("a", TEXT), ("b", "bad"), ("c", "good one")], "file string, text string")

    def recognize(path, text):
        return {"a": [{"rule_id": "x-own", "line": 3, "column": 1, "length": 4, "confidence": "low"}, {"rule_id": "x-own", "line": 2, "column": 6, "length": 13, "confidence": "low"}], "b": [{"rule_id": "x-own", "line": 1, "column": 1, "length": 99, "confidence": "low"}], "c": [{"rule_id": "x-own", "line": 1, "column": 1, "length": 4, "confidence": "high"}]}[path]

    got = {(r.file, r.rule_id, r.match) for r in S.external_candidates(df, recognize, path_col="file").collect()}
    assert got == {("a", "x-own", "mail"), ("a", "jp-phone-number", "090-1234-5678"), ("a", "person-name", "山田太郎"), ("a", "email-address", "taro@gmail.com"), ("c", "x-own", "good")}


def test_span_matching(spark):
    w = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (2, 0, 4), (3, 0, 1)], "c int, start int, end int")
    f = spark.createDataFrame([(1, 0, 9), (1, 4, 6), (2, 0, 4), (4, 0, 1)], "c int, start int, end int")
    got = {r.c: (r.exact, r.containment, r.relaxed, r.n_wanted, r.n_found) for r in E.span_matches(w, f, ["c"]).collect()}
    assert got == {1: (0, 1, 2, 2, 2), 2: (1, 1, 1, 1, 1), 3: (0, 0, 0, 1, 0), 4: (0, 0, 0, 0, 1)}


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, TEXT), (2, "x")], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "in"))
    stream = scan_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = write_findings(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 3 and "090-1234-5678" not in {r.match for r in got.collect()}


def test_columns_of_the_same_names_are_kept(spark):
    df = spark.createDataFrame([(1, TEXT, "a.txt", "mine", "theirs", 5)], "i int, text string, __file string, match string, match_in string, `Line` int")
    got = S.scan_documents(df)
    assert len(set(map(str.lower, got.columns))) == len(got.columns) and {"i", "__file", "match", "match_in_", "match_in", "Line_in"} <= set(got.columns) | {"match_in_"}
    r = got.first()
    assert r["__file"] == "a.txt" and r["Line_in"] == 5 and sorted(v for k, v in r.asDict().items() if k.startswith("match_in")) == ["mine", "theirs"]
    assert S.dropped(df).columns[:2] == ["i", "__file"]


def test_recognizers_that_fail_or_hang(spark):
    import time

    def odd(path, text):
        if "hang" in text:
            while True:
                time.sleep(0.05)
        if "fail" in text:
            raise RuntimeError("no")
        return [{"rule_id": "x-own", "line": 1, "column": 1, "length": 2, "confidence": "low"}]

    df = spark.createDataFrame([(1, "ok 090-1234-5678"), (2, "fail 090-1234-5678"), (3, "hang 090-1234-5678"), (4, None)], "i int, text string")
    got = sorted((r.i, r.rule_id) for r in S.external_candidates(df, odd, seconds=0.5).collect())
    assert got == [(1, "jp-phone-number"), (1, "x-own"), (2, "jp-phone-number"), (3, "jp-phone-number")]


def test_drops_are_counted_beyond_the_list(spark):
    df = spark.createDataFrame([(1, "\n".join(["口座番号 1111111"] * 30))], "i int, text string")
    listed = S.dropped(df, most=10)
    assert listed.count() == 10 and listed.first().truncated
    counts = {(r.rule_id, r.reason): r.n for r in S.dropped_counts(df).collect()}
    assert counts["jp-bank-account", "validate-failed"] >= 30 and not any(r.truncated for r in S.dropped(df, most=None).collect())
