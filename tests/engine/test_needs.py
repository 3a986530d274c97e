"""Lines are searched only by patterns that can match in them."""

import random
import re
from re import _parser

from shirabe.detect.engine import Config, Detector
from shirabe.detect.needs import needs
from shirabe.functions.text import normalize_line

def sample(items, r: random.Random) -> str:
    """A text that a pattern's parse tree describes, by chance."""
    out = ""
    for op, x in items:
        name = str(op)
        if name == "LITERAL":
            out += chr(x)
        elif name == "IN":
            kind, y = r.choice(x)
            out += r.choice("、 x7") if str(x[0][0]) == "NEGATE" else chr(y) if str(kind) == "LITERAL" else chr(r.randint(*y)) if str(kind) == "RANGE" else " "
        elif name == "NOT_LITERAL":
            out += r.choice("、 x7")
        elif name == "BRANCH":
            out += sample(r.choice(x[1]), r)
        elif name == "SUBPATTERN":
            out += sample(x[3], r)
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            out += "".join(sample(x[2], r) for _ in range(min(x[1], x[0] + r.choice((0, 0, 1, 3)))))
    return out


def test_no_pattern_is_passed_over_that_matches():
    d, r = Detector(Config(high_recall=True)), random.Random(11)
    gates = {"": lambda s: True, "digit": lambda s: re.search("[0-9]", s), "at": lambda s: "@" in s, "cjk": lambda s: re.search("[　-\U0010ffff]", s)}
    every = [s.pattern for rule in d.rules for s in rule.shapes if isinstance(s.pattern, re.Pattern)]
    matched, passed = set(), 0
    for p in every * 40:
        parsed = _parser.parse(p.pattern, p.flags)
        line = normalize_line(r.choice(("", "", "x ", "12", "7 ", "番号:", "a\n")) + sample(parsed, r) + r.choice(("", "", " x", "3", " 4567", "円", "\nb")))
        n = sum(map(len, re.findall("[0-9]+", line)))
        kept = {id(s.pattern) for _, _, got in d._possible(line, n > 0) for s in got}
        for rule, plan in zip(d.rules, d.plans):
            for s in rule.shapes:
                if id(s.pattern) not in kept:
                    passed += 1
                    assert n < plan.least or not gates[rule.gate](line) or not s.pattern.search(line), (s.pattern.pattern, line)
        if p.search(line):
            matched.add(p)
    assert len(matched) > 0.9 * len(set(every)) and passed > 20 * len(every) ** 2


def test_what_patterns_need():
    what = lambda p: (lambda n, runs: (set(n.chars), n.digits, n.run, runs))(*needs(re.compile(p)))
    assert what("(?:^|[^0-9])([0-9]{4}-[0-9]{6})(?:[^0-9]|\\Z)") == ({"-"}, 10, 6, ((4, 4), (6, 6)))
    assert what("(?:^|[^0-9])0([0-9]{1,4})(?:[^0-9]|\\Z)") == (set(), 2, 2, ((2, 5),))
    assert what("[0-9]{3}-?[0-9]{4}") == (set(), 7, 4, ())
    assert what("(?:a1|b12)x*(?i:q)=") == ({"="}, 1, 1, ())
    assert what("\\d{5}[^0-9]") == (set(), 0, 0, ())


def test_few_patterns_are_searched_in_a_line():
    """Those of numbers of other lengths are not, nor is a line of letters by any of them."""
    d = Detector(Config())
    n = lambda line, digit: sum(len(s) for _, _, s in d._possible(line, digit))
    every = sum(len(r.shapes) for r in d.rules)
    assert n("個人番号:123456789018", True) < every / 3 and n("氏名: 山田太郎", False) < every / 6
    searched = []

    class Spy:
        groups = 1

        def search(self, *a):
            searched.append(a)

    only = Detector(Config(disabled=tuple({r.id for r in d.rules} - {"jp-bank-account"})))
    only.plans[0].shapes = [(type("Shape", (), {"pattern": Spy()}), *needs(s.pattern)) for s, *_ in only.plans[0].shapes]
    only.match_line("口座番号: 123456789012")
    assert not searched
    only.match_line("口座番号: 1234567")
    assert len(searched) == 1
