"""The matcher: candidates of all rules in a text, judged by their context, correlated and resolved."""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

from ..functions.text import IGNORE_MARKERS, normalize_line
from . import context as X
from . import rules as R
from . import structure as S
from . import validators as V
from . import vocabulary as W
from .needs import needs

GAP, NEAR_LINES, RETAINED = 3, 5, 2000
_BOOSTED = {"person-name", "person-name-high-recall"}
_ANCHORS = set("jp-residence-card jp-pension-number jp-passport jp-drivers-license credit-card email-address jp-postal-code jp-phone-number jp-my-number".split())
_BASE, _BANDS = {1: 20, 2: 50, 3: 80}, {1: (0, 39), 2: (40, 74), 3: (75, 100)}


@dataclass
class Config:
    min_confidence: int = R.LOW
    scan_min_confidence: int | None = None  # lower than min_confidence: found, but only for the exit status
    high_recall: bool = False
    disabled: tuple[str, ...] = ()
    custom: tuple[R.Rule, ...] = ()
    boost: bool = True
    path_demotion: bool = True
    exclude_kinds: tuple[str, ...] = ()
    stopwords: tuple[str, ...] = ()
    allow: tuple[str, ...] = ()  # regexes of values
    allow_paths: tuple[str, ...] = ()
    markers: tuple[str, ...] = IGNORE_MARKERS
    log_drops: bool = False
    retained: int = RETAINED  # low candidates that a text keeps for a boost


@dataclass(slots=True)
class Finding:
    rule_id: str
    line: int
    start: int
    end: int
    match: str
    confidence: int
    base: int
    about: str = ""
    whole: tuple[int, int] = (0, 0)
    mode: str = "all"
    keywords: list[str] = field(default_factory=list)
    promoted: bool = False
    required: bool = False
    window: int = 0
    validated: bool = False
    boosted: bool = False
    same_record: bool = False
    demoted: bool = False
    kind: str | None = None
    external: bool = False
    fail_only: bool = False
    retained: bool = False
    pair: bool = False
    bound: bool = False
    distance: int | None = None
    cross_line: bool = False
    structured: bool = False
    score: int = 0

    def rate(self) -> Finding:
        """The score: the confidence's base, more or less for the evidence, inside the confidence's band."""
        s = _BASE[self.confidence] - 20 * self.rule_id.endswith("-high-recall") + 5 * self.validated + 2 * self.required + 8 * self.pair + 8 * self.bound
        if self.keywords:
            s += 8 if self.structured else 2 if self.cross_line else 1 if self.distance is None or self.distance > R.NEAR else 6 if self.distance <= 8 else 4
        if self.boosted:
            s += 7 if self.same_record else 2
        low, high = _BANDS[self.confidence]
        self.score = min(max(s, low), high)
        return self

    def rank(self):
        return (-self.confidence, self.fail_only, -self.score, -(self.end - self.start), self.rule_id)


@dataclass
class Drop:
    rule_id: str
    line: int
    column: int
    reason: str
    confidence: int


def resolve(found: list[Finding]) -> list[Finding]:
    """In order: one that overlaps a kept one that is no worse goes; otherwise it evicts those it overlaps."""
    kept: list[Finding] = []
    for f in found:
        over = [k for k in kept if f.start < k.end and k.start < f.end]
        if all(f.rank() < k.rank() for k in over):
            kept = [k for k in kept if not any(k is o for o in over)] + [f]
    return kept


_HEX = set("0123456789abcdefABCDEF-")
_UUID = re.compile("[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-4[0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}|[0-9a-fA-F]{12}4[0-9a-fA-F]{3}[89abAB][0-9a-fA-F]{15}")


def in_uuid(s: str, start: int, end: int) -> bool:
    while start and s[start - 1] in _HEX:
        start -= 1
    while end < len(s) and s[end] in _HEX:
        end += 1
    return end - start in (32, 36) and _UUID.fullmatch(s[start:end]) is not None


def _nearest(norm: str, start: int, end: int, words: list[str]) -> tuple[int | None, bool]:
    """(characters to the nearest keyword, whether a line break lies between)."""
    best, cross, low = None, False, norm.lower()
    for w in words:
        w = w.lower()
        at = low.find(w)
        while w and at >= 0:
            z = at + len(w)
            d = start - z if z <= start else at - end if end <= at else 0
            if best is None or d < best:
                between = norm[z:start] if z <= start else norm[end:at]
                best, cross = d, "\n" in between
            at = low.find(w, at + 1)
    return best, cross


@lru_cache(maxsize=1024)
def is_test_path(path: str) -> bool:
    parts = path.replace("\\", "/").split("/")
    return any(p in W.TEST_FOLDERS for p in parts) or bool(re.search(r"_test\.go\Z|\.spec\.|\.test\.", parts[-1]))


_SIX, _HIGH, _DIGIT = re.compile("[0-9](?:[^0-9]{0,3}[0-9]){5}"), re.compile("[^\x00-\u2fff]"), re.compile("[0-9]")
_RUNS = re.compile("[0-9]+")
#: Fewer digits than these make no valid value of a rule.
_LEAST = {"jp-my-number": 12, "jp-phone-number": 9, "jp-postal-code": 7, "credit-card": 13, "jp-drivers-license": 12, "jp-passport": 7, "jp-pension-number": 10, "jp-residence-card": 8, "jp-bank-account": 7, "jp-yucho-account": 12, "jp-health-insurance": 6, "jp-employment-insurance": 11, "jp-kaigo-insurance": 10, "jp-juminhyo-code": 11, "jp-invoice-number": 13}


#: Kinds of lines of which it is kept what can match in them.
_KEPT = 10_000
#: Checks of values, up to so long, of which it is kept what they said.
_ASKED, _LONG = 256, 256
#: Rules of which each match has a digit among its first characters, at most so many before it, and none of any
#: length after its last one.
_NUMERIC, _LEAD = frozenset(_LEAST) - {"jp-yucho-account", "jp-health-insurance"}, 24


def _has(s: str, words) -> bool:
    for w in words:
        if w in s:
            return True
    return False


class _Plan:
    """What a line must have, by cheap tests, for a rule to find anything in it."""

    def __init__(self, r: R.Rule):
        self.numeric = r.id in _NUMERIC
        self.shapes = [(s, *needs(s.pattern)) for s in r.shapes]
        self.least = _LEAST.get(r.id, 0)
        self.required = bool(r.shapes) and all(s.required for s in r.shapes)
        self.needles = tuple({X.tokens(w)[0] if w.isascii() and X.tokens(w) else w for w in r.context})
        self.literals = tuple(w for e in r.evidence for w in e.literals)
        self.patterns = tuple(e.pattern for e in r.evidence if not e.literals)
        self.hints = {"jp-birthdate": (*W.BIRTH, "生まれ", "dob", "birth")}.get(r.id) or (W.MUNICIPALITY_ENDS if r.id.startswith("jp-address") else ())

    def hopeful(self, norm: str, low: str, line: S.Line) -> bool:
        if self.hints and not _has(low, self.hints):
            return False
        return not self.required or bool(line.spans) or _has(low, self.needles) or _has(norm, self.literals) or any(p.search(norm) for p in self.patterns)


class Detector:
    def __init__(self, config: Config | None = None):
        c = self.config = config or Config()
        self.rules = R.selected(c.high_recall, c.disabled, c.custom)
        self.floor = c.scan_min_confidence if c.scan_min_confidence and c.scan_min_confidence < c.min_confidence else c.min_confidence
        self.allow = [re.compile(p) for p in c.allow]
        self.stop = set(c.stopwords) | {normalize_line(w) for w in c.stopwords}
        mark = "|".join(map(re.escape, c.markers))
        self.marker = re.compile(f"(?<![\\w-])(?:{mark})(?![\\w-])") if mark else None
        self.names = next((r for r in self.rules if r.id == "person-name-structured"), None)
        self.yucho = next((r for r in self.rules if r.id == "jp-yucho-account"), None)
        self.by_id = {}
        for r in self.rules:
            self.by_id.setdefault(r.id, r)
        self.drops: list[Drop] = []
        self.plans = [_Plan(r) for r in self.rules]
        every = [(n, runs) for p in self.plans for _, n, runs in p.shapes]
        self.telling = frozenset(c for n, _ in every for c in n.chars)
        #: More digits than these tell nothing more.
        self.most = 1 + max([20, *_LEAST.values(), *(n.digits for n, _ in every), *(z for _, runs in every for _, z in runs if z < 100)])
        self.digital = all(r.gate == "digit" for r in self.rules)
        self.possible: dict[tuple, list] = {}
        self.checked: dict[tuple, bool] = {}
        own = [r for r in self.rules if not r.gate]
        #: Words, in lower case, that a line may have instead of signs; None: rules of the user's own may find anything.
        self.gate_words = None if any(not r.literals for r in own) else sorted({"dob", "birth", *(w.lower() for r in own for w in r.literals)})

    def gate(self, c):
        """Whether a text (a column) can have findings: an @, a number of six digits however written (over blank
        lines as well), anything from U+3000 on, or a word that an ungated rule asks for."""
        from pyspark.sql import functions as F

        if self.gate_words is None:
            return F.lit(True)
        out = F.contains(c, F.lit("@")) | c.rlike("[0-9](?:[^0-9]{0,3}\\s*[^0-9]{0,3}[0-9]){5}") | c.rlike("[\\x{3000}-\\x{10FFFF}]")
        low = F.lower(c)
        for w in self.gate_words:
            out = out | F.contains(low, F.lit(w))
        return out

    def opens(self, line: str, words: list[str] | None) -> bool:
        """The same of a line; ``words``: those of the gate that the text has at all."""
        if words is None or "@" in line or _SIX.search(line) or (not line.isascii() and _HIGH.search(line)):
            return True
        low = line.lower() if words else ""
        return any(w in low for w in words)

    def _words_in(self, text: str) -> list[str] | None:
        if self.gate_words is None:
            return None
        low = text.lower()
        return [w for w in self.gate_words if w in low]

    # --- one line --------------------------------------------------------------------------------------------
    def _drop(self, rule_id, line, column, reason, confidence):
        if self.config.log_drops:
            self.drops.append(Drop(rule_id, line, column, reason, confidence))

    def ignored(self, line: str) -> bool:
        return self.marker is not None and self.marker.search(line) is not None

    def allowed(self, value: str) -> bool:
        return value in self.stop or any(p.search(value) for p in self.allow)

    def _evidence(self, r, norm, start, end, window, line: S.Line):
        hay = norm if window <= 0 else norm[max(0, start - window) : end + window]
        words = X.keywords(hay, r.context) + X.evidence(hay, r.evidence)
        span = line.at(start, end)
        own = X.keywords(span.positive, r.context) + X.evidence(span.positive, r.evidence) if span and span.positive else []
        return words + own, bool(own)

    def _against(self, r, norm, start, end, mode, line: S.Line) -> bool:
        if not r.negative or mode == "none":
            return False
        span = line.at(start, end)
        if mode == "all" and span and span.negative:
            return True
        if span and span.positive and not span.negative and X.keywords(span.positive, r.context):
            return False
        return X.negative_near(norm, start, end, r.negative, r.context, mode)

    def match_line(self, text: str, number: int = 1, line: S.Line | None = None, near: int = R.NEAR, budget: list[int] | None = None, norm: str | None = None) -> list[Finding]:
        """All rules over one line (or two, joined), markers aside. norm: the line's normalised form, of a line that
        is known to pass the gate."""
        if norm is None:
            if not text or not self.opens(text, self.gate_words):
                return []
            norm = normalize_line(text)
        first = _DIGIT.search(norm)
        if first is None and self.digital:
            return []
        possible = self._possible(norm, first is not None)
        if not possible:
            return []
        line = line or S.Line()
        low = norm.lower()
        found: list[Finding] = []
        begin, stop = (max(0, first.start() - _LEAD), max(map(norm.rfind, "0123456789")) + 1 + _LEAD) if first else (0, 0)
        for r, plan, shapes in possible:
            if (not r.literals or _has(norm, r.literals) or _has(low, r.literals)) and (self.config.log_drops or plan.hopeful(norm, low, line)):
                for shape in shapes:
                    m = shape.pattern.search(norm, begin, stop) if plan.numeric else shape.pattern.search(norm)
                    if m is not None:
                        self._matches(r, shape, m, text, norm, stop if plan.numeric else len(norm), number, line, near, budget, found)
        out = resolve(found) if len(found) > 1 else found
        if self.config.log_drops:
            for f in found:
                if not any(f is k for k in out):
                    self._drop(f.rule_id, number, f.start + 1, "overlap-lost", f.confidence)
        return out

    def _possible(self, norm: str, digit: bool) -> list:
        """(rule, plan, shapes) that a line with these characters and digits can have a match of. Lines that are alike
        in this are many, so it is kept."""
        lengths = list(map(len, _RUNS.findall(norm))) if digit else []
        n, runs = min(sum(lengths), self.most), frozenset(min(x, self.most) for x in set(lengths))
        at, cjk = "@" in norm, not norm.isascii() and _HIGH.search(norm) is not None
        chars = self.telling.intersection(norm)
        key = (chars, n, runs, at, cjk)
        got = self.possible.get(key)
        if got is None:
            gates = {"": True, "digit": digit, "at": at, "cjk": cjk}
            run, got = max(runs, default=0), []
            whole = lambda bounds: all(any(a <= x <= z for x in runs) for a, z in bounds)
            for r, plan in zip(self.rules, self.plans):
                if gates[r.gate] and (self.config.log_drops or n >= plan.least):
                    shapes = [s for s, x, bounds in plan.shapes if x.digits <= n and x.run <= run and x.chars <= chars and whole(bounds)]
                    if shapes:
                        got.append((r, plan, shapes))
            if len(self.possible) >= _KEPT:
                self.possible.clear()
            self.possible[key] = got
        return got

    def _matches(self, r, shape, m, text, norm, stop, number, line, near, budget, found):
        """Every match of a shape in a line, ``m`` the first, judged."""
        at, shift, numeric = 0, 0, r.id in _NUMERIC
        while at < len(norm):
            if at:
                # The guards before a value may match at the start of what is left, so what is left is cut off.
                begin = at
                if numeric:  # what lies far from any digit needs no look
                    first = _DIGIT.search(norm, at)
                    if first is None:
                        return
                    begin = max(at, first.start() - _LEAD)
                if begin > at:
                    m, shift = shape.pattern.search(norm, begin, stop), 0
                else:
                    m, shift = shape.pattern.search(norm[at:stop]), at
                if m is None:
                    return
            group = 1 if m.re.groups and m.start(1) >= 0 else 0
            start, end, whole = m.start(group) + shift, m.end(group) + shift, (m.start() + shift, m.end() + shift)
            at = end if end > at else at + 1
            f, why = self._judge(r, shape, norm, start, end, whole, line, near, budget)
            if f is None:
                self._drop(r.id, number, start + 1, *why)
                continue
            f.line, f.match, f.about = number, text[start:end], r.about
            found.append(f.rate())

    def _passes(self, check, value: str) -> bool:
        """A check's word on a value, which a line and its pairs with its neighbours ask for again."""
        got = self.checked.get((check, value))
        if got is None:
            if len(value) > _LONG:
                return bool(check(value))
            if len(self.checked) >= _ASKED:
                self.checked.clear()
            got = self.checked[check, value] = bool(check(value))
        return got

    def _judge(self, r, shape, norm, start, end, whole, line, near, budget):
        value, base = norm[start:end], shape.base
        window = shape.window or r.window
        if in_uuid(norm, start, end):
            return None, ("uuid-token", base)
        words, structured, validated = [], False, False
        if shape.required:
            words, structured = self._evidence(r, norm, start, end, window, line)
            if not words:
                return None, ("require-context-missing", base)
        if self._against(r, norm, start, end, shape.mode, line):
            return None, ("negative-context", base)
        for check in (r.check, shape.check):
            if check is not None:
                if not self._passes(check, value):
                    return None, ("validate-failed", base)
                validated = True
        if shape.in_line is not None:
            if not shape.in_line(norm, start, end):
                return None, ("validate-line-failed", base)
            validated = True
        if self.allowed(value):
            return None, ("allowlisted", base)
        kind = r.kind(value) if r.kind is not None else None
        if kind is not None and kind in self.config.exclude_kinds:
            return None, ("kind-excluded", base)
        f = Finding(r.id, 0, start, end, "", base, base, whole=whole, mode=shape.mode, required=shape.required, window=window, kind=kind, validated=validated, keywords=words, structured=structured)
        f.bound = (start - whole[0]) + (whole[1] - end) > 1
        if shape.required:
            f.distance, f.cross_line = _nearest(norm, start, end, words)
        if not shape.required and base < R.HIGH:
            words, structured = self._evidence(r, norm, start, end, near, line)
            if words:
                f.keywords, f.structured, f.promoted, f.window, f.confidence = words, structured, True, near, R.HIGH
                f.distance, f.cross_line = _nearest(norm, start, end, words)
        if f.confidence < self.config.min_confidence:
            if budget and budget[0] > 0 and r.id in _BOOSTED and (f.validated or f.keywords):
                budget[0] -= 1
                f.retained = True
            if f.confidence < self.floor and not f.retained:
                return None, ("below-min-confidence", f.confidence)
            f.fail_only = not f.retained
        return f, None

    def scan_line(self, text: str, number: int = 1, line: S.Line | None = None, budget=None, norm: str | None = None) -> list[Finding]:
        return [] if not text or self.ignored(text) else self.match_line(text, number, line, budget=budget, norm=norm)

    # --- lines together ----------------------------------------------------------------------------------------
    def _adjacent(self, i: int, j: int, lines, norms, opened, contexts, added=None) -> list[Finding]:
        """Two neighbouring lines as one text; values that lie in one of them."""
        first, second = lines[i], lines[j]
        if not (opened[i] or opened[j]) and not (_DIGIT.search(first[-3:]) and _DIGIT.search(second[:3]) and _SIX.search(first[-24:] + "\n" + second[:24])):
            return []
        cut, out = len(first), []
        for f in self.match_line(first + "\n" + second, i + 1, norm=norms[i] + "\n" + norms[j]):
            if f.end <= cut:
                k, crosses = i, f.whole[1] > cut + 1
            elif f.start > cut:
                k, crosses = j, f.whole[0] < cut
                f.start, f.end = f.start - cut - 1, f.end - cut - 1
            else:
                continue
            if (f.rule_id == "person-name" and crosses) or self.ignored(lines[k]) or (added is not None and not added[k]):
                continue
            span = contexts[k].at(f.start, f.end)
            if f.mode == "all" and span and span.negative and self.by_id[f.rule_id].negative:
                continue
            f.line, f.match = k + 1, lines[k][f.start : f.end]
            out.append(f)
        return out

    def _pair(self, rule, line: int, text: str, start: int, end: int, confidence: int) -> Finding:
        return Finding(rule.id, line, start, end, text[start:end], confidence, confidence, rule.about, validated=True, pair=True).rate()

    def _yucho_pairs(self, pairs, lines, norms) -> list[Finding]:
        out = []
        for i, j in pairs if self.yucho else ():
            a, b = R.YUCHO_SYMBOL_LINE.match(norms[i]), R.YUCHO_NUMBER_LINE.match(norms[j])
            if a and b and V.yucho_pair(a[1], b[1]):
                out += [self._pair(self.yucho, k + 1, lines[k], *m.span(1), R.HIGH) for k, m in ((i, a), (j, b)) if not self.allowed(m[1])]
        return out

    def _name_pairs(self, pairs, lines, norms) -> list[Finding]:
        labelled, halves = [], []
        for i, j in pairs:
            m = R.NAME_VALUE_LINE.match(norms[j]) if R.NAME_LABEL_LINE.match(norms[i]) else None
            if m and V.structured_name(m[1]) and not self.allowed(m[1]):
                labelled.append(self._pair(self.names, j + 1, lines[j], *m.span(1), R.MEDIUM))
            a, b = R.SURNAME_LINE.match(norms[i]), R.GIVEN_LINE.match(norms[j])
            if a and b and V.surname_given_pair(a[1], b[1]):
                halves += [self._pair(self.names, k + 1, lines[k], *x.span(1), R.MEDIUM) for k, x in ((i, a), (j, b)) if not self.allowed(x[1])]
        return labelled + halves

    def _column_names(self, path, lines, norms) -> list[Finding]:
        kind, cells = S.kind_of(path), []
        if kind == "csv" and norms:
            d = S.delimiter_of(path)
            names = S.csv_header(norms[0], d) or []
            wanted = {k for k, n in enumerate(names) if R.NAME_HEADER.match(n)}
            if wanted:
                cells = [(i, a, z) for i, fields in S.csv_records(norms, d, 1) for k, (a, z) in enumerate(fields) if k in wanted and a < z]
        elif kind == "sql":
            for i, n in enumerate(norms):
                columns, tuples = S.sql_insert(n) or ((), ())
                wanted = {k for k, c in enumerate(columns) if R.NAME_HEADER.match(c)}
                cells += [(i, a, z) for values in tuples for k, (a, z) in enumerate(values) if k in wanted and a < z]
        out = []
        for i, a, z in cells:
            m = R.NAME_CELL.match(norms[i][a:z])
            if m and V.structured_name(m[1]) and not self.allowed(m[1]):
                out.append(self._pair(self.names, i + 1, lines[i], a + m.start(1), a + m.end(1), R.MEDIUM))
        return out

    def _against_neighbours(self, f: Finding, norms, contexts, before, after) -> bool:
        """The negative words once more, with the lines before and after."""
        r = self.by_id.get(f.rule_id)
        i = f.line - 1
        if r is None or not r.negative or f.mode == "none" or f.end > len(norms[i]):
            return False
        span = contexts[i].at(f.start, f.end)
        if span and span.positive and not span.negative and X.keywords(span.positive, r.context):
            return False
        head = norms[before[i]] + " " if before[i] >= 0 else ""
        tail = " " + norms[after[i]] if after[i] >= 0 else ""
        return X.negative_near((head + norms[i] + tail).replace("\n", " "), len(head) + f.start, len(head) + f.end, r.negative, r.context, f.mode)

    def _boost(self, found, contexts) -> None:
        """A name near a sure finding of another kind, best in the same record, gains a step."""
        anchors = [f for f in found if f.rule_id in _ANCHORS and f.confidence >= R.HIGH and (f.validated or f.required)]
        if not anchors:
            return
        record = lambda f: contexts[f.line - 1].record
        records = {record(f) for f in anchors if record(f)}
        every, loose = sorted(f.line for f in anchors), sorted(f.line for f in anchors if not record(f))

        def near(where, n):
            k = bisect.bisect_left(where, n - NEAR_LINES)
            return k < len(where) and where[k] <= n + NEAR_LINES

        for f in found:
            if f.fail_only or f.rule_id not in _BOOSTED or f.confidence >= R.HIGH or not (f.validated or f.keywords):
                continue
            same = record(f) in records if record(f) else False
            if same or near(loose if record(f) else every, f.line):
                f.confidence += 1
                f.boosted, f.same_record = True, same
                f.rate()

    def _finish(self, path: str, found: list[Finding]) -> list[Finding]:
        """Thresholds, paths of tests, overlaps by line, one of each, in order."""
        kept = []
        for f in found:
            if f.confidence < self.floor:
                self._drop(f.rule_id, f.line, f.start + 1, "below-min-confidence", f.confidence)
                continue
            if self.config.path_demotion and f.required and f.confidence == R.MEDIUM and is_test_path(path):
                f.confidence, f.demoted = R.LOW, True
                f.rate()
                if f.confidence < self.floor:
                    self._drop(f.rule_id, f.line, f.start + 1, "path-demotion-below-min", f.confidence)
                    continue
            f.fail_only = f.fail_only or f.confidence < self.config.min_confidence
            kept.append(f)
        return settle(kept, self._drop if self.config.log_drops else None)

    def scan(self, text: str, path: str = "") -> list[Finding]:
        """The findings of a whole text."""
        lines = [x.removesuffix("\r") for x in text.split("\n")]
        norms = [normalize_line(x) for x in lines]
        words = self._words_in(text)
        opened = [self.opens(x, words) for x in lines]
        contexts = S.line_contexts(path, norms)
        budget = [self.config.retained] if self.config.boost else None
        before, after = neighbours(lines)
        pairs = [(i, j) for i, j in enumerate(after) if j >= 0 and lines[i].strip()]
        found = [f for i, x in enumerate(lines) if opened[i] for f in self.scan_line(x, i + 1, contexts[i], budget, norms[i])]
        found += [f for i, j in pairs for f in self._adjacent(i, j, lines, norms, opened, contexts)]
        found += self._yucho_pairs(pairs, lines, norms)
        if self.names and R.MEDIUM >= self.floor:
            found += self._name_pairs(pairs, lines, norms) + self._column_names(path, lines, norms)
        if not found:
            return []
        kept = []
        for f in found:
            # A line that has no neighbours was judged by itself, to the same end.
            if (before[f.line - 1] >= 0 or after[f.line - 1] >= 0) and self._against_neighbours(f, norms, contexts, before, after):
                self._drop(f.rule_id, f.line, f.start + 1, "cross-line-negative-context", f.confidence)
            else:
                f.fail_only = f.fail_only or (f.confidence < self.config.min_confidence and not f.retained)
                kept.append(f)
        if self.config.boost:
            self._boost(kept, contexts)
        return self._finish(path, kept)

    def scan_hunk(self, path: str, first_line: int, texts: list[str], added: list[bool], header: str = "", post_image: str = "") -> list[Finding]:
        """The findings on the added lines of a hunk. Unchanged lines give context, but never against."""
        lines = [x.removesuffix("\r") for x in texts]
        norms = [normalize_line(x) for x in lines]
        opened = [self.opens(x, self.gate_words) for x in lines]
        contexts = S.diff_contexts(path, norms, added, header, post_image, first_line)
        before, after = neighbours(lines)
        pairs = [(i, j) for i, j in enumerate(after) if j >= 0 and lines[i].strip()]
        found = [f for i, x in enumerate(lines) if added[i] for f in self.scan_line(x, i + 1, contexts[i])]
        found += [f for i, j in pairs if added[i] or added[j] for f in self._adjacent(i, j, lines, norms, opened, contexts, added)]
        found += [f for f in self._yucho_pairs(pairs, lines, norms) if added[f.line - 1]]
        if not found:
            return []
        own = [n if a else "" for n, a in zip(norms, added)]
        b, a = neighbours(own)
        found = [f for f in found if not self._against_neighbours(f, own, contexts, b, a)]
        out = self._finish(path, found)
        for f in out:
            f.line += first_line - 1
        return out


def neighbours(lines: list[str]) -> tuple[list[int], list[int]]:
    """For each line the last one before and the first one after it that isn't blank, within three; else -1."""
    n = len(lines)
    before, after, last = [-1] * n, [-1] * n, -1
    for i in range(n):
        before[i] = last if last >= 0 and i - last <= GAP else -1
        if lines[i].strip():
            last = i
    last = -1
    for i in range(n - 1, -1, -1):
        after[i] = last if last >= 0 and last - i <= GAP else -1
        if lines[i].strip():
            last = i
    return before, after


def settle(found: list[Finding], drop: Callable | None = None) -> list[Finding]:
    """Overlaps resolved line by line, the best of equal spans of a rule, sorted by place."""
    by_line: dict[int, list[Finding]] = {}
    for f in found:
        by_line.setdefault(f.line, []).append(f)
    best: dict[tuple, Finding] = {}
    for n in sorted(by_line):
        kept = resolve(by_line[n])
        if drop:
            for f in by_line[n]:
                if not any(f is k for k in kept):
                    drop(f.rule_id, f.line, f.start + 1, "overlap-lost", f.confidence)
        for f in kept:
            k = (f.rule_id, f.line, f.start, f.end)
            if k not in best or f.rank() < best[k].rank():
                best[k] = f
    return sorted(best.values(), key=lambda f: (f.line, f.start, f.end))


def offsets(text: str, found: list[Finding]) -> list[tuple[int, int]]:
    """Where the findings stand in the whole text, in characters."""
    starts = [0]
    for line in text.split("\n"):
        starts.append(starts[-1] + len(line) + 1)
    return [(starts[f.line - 1] + f.start, starts[f.line - 1] + f.start + len(f.match)) for f in found]
