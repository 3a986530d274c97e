from shirabe.__main__ import main
from shirabe.operators import evaluate as E


def test_cases(spark):
    rows = [
        ("1", "TEL: 090-1234-5678", None, None, None, ["jp-phone-number"], [("jp-phone-number", 1, 5, 18)], ["sep:hyphen"]),
        ("2", None, "口座番号:\n1234567", None, None, ["jp-bank-account"], None, None),
        ("3", None, None, [("電話:", False), ("090-1234-5678", True)], None, ["jp-phone-number", "credit-card"], [("jp-phone-number", 2, 0, 9)], ["x"]),
        ("4", "090-1234-5678", None, None, None, [], None, ["x"]),
        ("5", "090-1234-5678", None, None, None, [], None, ["x"]),
        ("6", "nothing", None, None, None, ["no-such-rule"], None, None),
    ]
    cases = spark.createDataFrame(rows, E.CASE)
    got = E.evaluate_cases(cases)
    rules = {r.rule_id: (r.tp, r.fp, r.fn) for r in got["rules"].collect()}
    assert rules == {"jp-phone-number": (2, 2, 0), "jp-bank-account": (1, 0, 0), "credit-card": (0, 0, 1), "no-such-rule": (0, 0, 1)}
    strata = {r.stratum: (r.tp, r.fp, r.fn) for r in got["strata"].collect()}
    assert strata == {"line": (1, 2, 1), "content": (1, 0, 0), "diff": (1, 0, 1), "sep:hyphen": (1, 0, 0), "x": (1, 2, 1)}
    spans = {r.rule_id: (r.exact, r.containment, r.relaxed) for r in got["spans"].collect()}
    assert spans["jp-phone-number"] == (1, 2, 2)
    a = got["averages"].first()
    assert (a.tp, a.fp, a.fn) == (3, 2, 2) and abs(a.macro_recall - 0.5) < 1e-9
    q = E.dataset_quality(cases, ["jp-phone-number", "jp-bank-account", "credit-card"]).first()
    assert (q.unknown_rules, q.repeated_cases, q.pairs_without_span) == (1, 1, 3)


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "a.txt").write_text("TEL: 090-1234-5678\n口座番号 1234567\n", encoding="utf-8")
    monkeypatch.chdir(tmp_path)
    assert main(["scan", str(tmp_path)]) == 1
    out = capsys.readouterr().out
    assert "jp-phone-number" in out and "jp-bank-account" in out and "5678" not in out
    assert main(["scan", "--format", "jsonl", str(tmp_path), "--min-confidence", "high"]) == 1
    assert capsys.readouterr().out.count("\n") == 1
    assert main(["baseline", str(tmp_path), "--baseline", str(tmp_path / "known")]) == 0
    (tmp_path / "known").rename(tmp_path.parent / "known-elsewhere")
    assert main(["scan", str(tmp_path), "--baseline", str(tmp_path.parent / "known-elsewhere")]) == 0
    assert main(["rules"]) == 0 and "jp-my-number\ton" in capsys.readouterr().out
