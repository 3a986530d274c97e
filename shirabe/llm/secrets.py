"""Secret scans through a trigram inverted index.

From each rule's regex a Boolean query over trigrams is derived (which trigrams every match must contain).
Each step of a task indexes its documents: postings of the trigrams that any query asks for. Queries
intersect and unite postings, and the regex runs over the candidates only. A rule whose matches need no
trigram scans every document. Trigrams are of bytes in ASCII lower case, so folding never loses a match.

Patterns are in the syntax that Python and RE2 share, without capturing groups; ``\\b`` and classes are ASCII.
An assigned secret is found from the known name on, whatever stands before it: of ``DB_PASSWORD=...``, ``DB_`` stays.

Defined results: null and empty texts have no findings; matches of one rule don't overlap (leftmost first);
each of several equal rows has its own findings; different rules may find overlapping spans, which redaction
unites. Offsets are in characters. Empty tables give empty results; only the id column is carried by
:func:`scan`, and every column by :func:`redact`.
"""

from __future__ import annotations

import hashlib
import re
import re._parser as sre
from re import _constants as C

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, map_text, slices, sorted_unique, utf8_parts

MASK = "[SECRET]"


def nocase(word: str) -> str:
    """A pattern for the ASCII letters of ``word`` in either case, without the folding of other alphabets."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else re.escape(c) for c in word)


_NAMES = "|".join(map(nocase, ("api_key", "apikey", "api-key", "secret_access_key", "secretaccesskey", "secret-access-key", "secret_key", "client_secret", "secret", "access_token", "auth_token", "token", "password", "passwd")))
_KEY_LABEL = "[A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
_BREAK = r"(?:\r?\n|(?:\\r)?\\n)[ \t]*"
#: What follows a key's first line if no last line does: headers and lines of base64, of which those that aren't
#: long or after a written ``\n`` must be alone on their line.
_KEY_CUT = (
    rf"(?:{_BREAK}(?:Proc-Type|DEK-Info|Version|Comment|Charset|Hash|MessageID): [^\r\n\\]*)*(?:{_BREAK})?"
    rf"(?:(?:{_BREAK}|[ \t]*)[A-Za-z0-9+/]{{32,}}={{0,2}}|(?:\\r)?\\n=?[A-Za-z0-9+/]+={{0,2}}|{_BREAK}=?[A-Za-z0-9+/]+={{0,2}}[ \t\r]*(?m:$))*"
)
RULES: dict[str, str] = {
    "aws-access-key": r"\b(?:AKIA|ASIA|AROA|AIDA)[A-Z0-9]{16}\b",
    "github-token": r"\bgh[pousr]_[A-Za-z0-9]{36,}\b",
    "github-fine-grained": r"\bgithub_pat_[A-Za-z0-9_]{22,}\b",
    "slack-token": r"\bxox[abprs]-[A-Za-z0-9-]{10,}",
    "google-api-key": r"\bAIza[0-9A-Za-z_-]{35}",
    "stripe-key": r"\b[sr]k_(?:live|test)_[0-9A-Za-z]{16,}\b",
    "sk-key": r"\bsk-[A-Za-z0-9_-]{20,}",
    "private-key": rf"-----BEGIN {_KEY_LABEL}(?:[^-]*(?:-{{1,4}}[^-]+)*-{{5,}}END {_KEY_LABEL}|{_KEY_CUT})",
    "json-web-token": r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
    "url-password": r"\b[a-z][a-z0-9+.-]+://[^ \t\r\n/:@]+:[^ \t\r\n/:@]{3,}@",
    "assigned-secret": rf"(?:{_NAMES})[\"']?[ \t]*[:=][ \t]*[\"']?[A-Za-z0-9_/+.-]{{16,}}[\"']?",
    "bot-token": r"\b[0-9]{8,10}:[A-Za-z0-9_-]{35}\b",  # needs no trigram: scans fully
}

# --- trigram queries -----------------------------------------------------------------------------------
#: A query is ALL, a frozenset of trigrams that all must occur, or ("and" | "or", queries).
ALL = frozenset()
_MANY, _LONG, _CLASS = 16, 12, 8


def _grams(s: bytes):
    return frozenset(s[i : i + 3] for i in range(len(s) - 2)) if len(s) >= 3 else ALL


def _and(a, b):
    if a == ALL:
        return b
    if b == ALL:
        return a
    if isinstance(a, frozenset) and isinstance(b, frozenset):
        return a | b
    return ("and", (a, b))


def _or(parts):
    parts = list(dict.fromkeys(parts))
    if not parts or any(p == ALL for p in parts):
        return ALL
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _any_of(strings):
    return _or(map(_grams, strings))


class _Info:
    """What is known of a sub-expression's matches: all of them (exact), or how they begin and end, and
    what they must contain."""

    def __init__(self, exact=None, prefix=frozenset({b""}), suffix=frozenset({b""}), need=ALL):
        self.exact, self.prefix, self.suffix, self.need = exact, prefix, suffix, need
        if exact is not None and (len(exact) > _MANY or max(map(len, exact), default=0) > _LONG):
            self.need = _and(self.need, _any_of(exact))
            self.prefix, self.suffix, self.exact = exact, exact, None
        if self.exact is None:
            self.prefix = frozenset(s[:2] for s in self.prefix)
            self.suffix = frozenset(s[-2:] for s in self.suffix)
            self.prefix = self.prefix if len(self.prefix) <= _MANY else frozenset({b""})
            self.suffix = self.suffix if len(self.suffix) <= _MANY else frozenset({b""})

    def begins(self):
        return self.exact if self.exact is not None else self.prefix

    def ends(self):
        return self.exact if self.exact is not None else self.suffix


_EMPTY = _Info(frozenset({b""}))
_ANY = _Info()


def _cross(a, b):
    return frozenset(x + y for x in a for y in b)


def _concat(x: _Info, y: _Info) -> _Info:
    need = _and(x.need, y.need)
    if x.exact is not None and y.exact is not None:
        return _Info(_cross(x.exact, y.exact), need=need)
    joint = _cross(x.ends(), y.begins())
    need = _and(need, _any_of(joint) if len(joint) <= _MANY * 4 else ALL)
    if x.exact is not None:  # a trigram inside an exact part is lost otherwise
        need = _and(need, _any_of(x.exact))
    if y.exact is not None:
        need = _and(need, _any_of(y.exact))
    prefix = _cross(x.exact, y.begins()) if x.exact is not None else x.prefix
    suffix = _cross(x.ends(), y.exact) if y.exact is not None else y.suffix
    return _Info(None, prefix, suffix, need)


def _either(infos) -> _Info:
    infos = list(infos)
    if all(i.exact is not None for i in infos):
        return _Info(frozenset().union(*(i.exact for i in infos)))
    need = _or(_and(i.need, _any_of(i.exact) if i.exact is not None else ALL) for i in infos)
    return _Info(None, frozenset().union(*(i.begins() for i in infos)), frozenset().union(*(i.ends() for i in infos)), need)


def _char(c: int) -> _Info:
    return _Info(frozenset({chr(c).encode("utf-8", "surrogatepass").lower() if c < 128 else chr(c).encode("utf-8", "surrogatepass")}))


def _analyse(tree) -> _Info:
    out = _EMPTY
    for op, arg in tree:
        if op is C.LITERAL:
            one = _char(arg)
        elif op is C.IN:
            chars: set[int] | None = set()
            for kind, x in arg:
                if kind is C.LITERAL:
                    chars.add(x)
                elif kind is C.RANGE and x[1] - x[0] < 64:
                    chars |= set(range(x[0], x[1] + 1))
                else:
                    chars = None
                    break
            folded = chars and {c | 32 if 65 <= c <= 90 else c for c in chars}
            one = _either(map(_char, folded)) if folded and len(folded) <= _CLASS else _ANY
        elif op is C.BRANCH:
            one = _either(map(_analyse, arg[1]))
        elif op is C.SUBPATTERN:
            one = _analyse(arg[3])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            least, most, body = arg
            inner = _analyse(body)
            one = _EMPTY
            for _ in range(min(least, 3)):
                one = _concat(one, inner)
            if least == 0 and most == 1:
                one = _either([_EMPTY, inner])
            elif most > min(least, 3):
                one = _concat(one, _ANY)
        elif op is C.AT:
            one = _EMPTY
        elif op in (C.ASSERT, C.ASSERT_NOT):
            one = _EMPTY
        else:  # NOT_LITERAL, ANY and what else: nothing is known
            one = _ANY
        out = _concat(out, one)
    return out


def trigram_query(pattern: str):
    """The Boolean trigram query of which every text that matches ``pattern`` is a result."""
    info = _analyse(sre.parse(pattern, re.ASCII))
    return _and(info.need, _any_of(info.exact) if info.exact is not None else ALL)


def trigrams(query) -> set[bytes]:
    return set(query) if isinstance(query, frozenset) else set().union(*map(trigrams, query[1]))


# --- index and scan ----------------------------------------------------------------------------------------
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Scanner:
    """Compiled rules and, for each, its query; made once for each task."""

    def __init__(self, rules: dict[str, str]):
        self.rules = {k: (re.compile(p, re.ASCII), trigram_query(p)) for k, p in rules.items()}
        self.wanted = sorted(set().union(*(trigrams(q) for _, q in self.rules.values())) if self.rules else ())
        self.number = np.zeros(1 << 24, np.uint16)
        for i, g in enumerate(self.wanted):
            self.number[g[0] << 16 | g[1] << 8 | g[2]] = i + 1

    def index(self, data: np.ndarray, off: np.ndarray) -> dict[bytes, np.ndarray]:
        """Postings: the sorted documents in which each wanted trigram occurs."""
        low = _LOWER[data].astype(np.uint32)
        if len(low) < 3:
            return {}
        found = self.number[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
        at = np.flatnonzero(found)
        doc = np.searchsorted(off, at, "right") - 1
        inside = at + 2 < off[doc + 1]
        at, doc = at[inside], doc[inside]
        pairs = sorted_unique(found[at].astype(np.int64) << 40 | doc)
        gram, doc = pairs >> 40, pairs & ((1 << 40) - 1)
        cut = np.flatnonzero(np.diff(gram, prepend=-1))
        return {self.wanted[g - 1]: d for g, d in zip(gram[cut], np.split(doc, cut[1:]))} if len(cut) else {}

    def candidates(self, query, postings: dict, n: int) -> np.ndarray:
        if query == ALL:
            return np.arange(n)
        if isinstance(query, frozenset):
            lists = sorted((postings.get(g, np.zeros(0, np.int64)) for g in query), key=len)
            out = lists[0]
            for x in lists[1:]:
                if not len(out):
                    break
                out = np.intersect1d(out, x, assume_unique=True)
            return out
        parts = [self.candidates(q, postings, n) for q in query[1]]
        out = parts[0]
        for x in parts[1:]:
            out = np.intersect1d(out, x, assume_unique=True) if query[0] == "and" else np.union1d(out, x)
        return out

    def find(self, text: pa.Array):
        """(document, rule, n-th of the rule in it, start, end, secret) of every finding."""
        data, off, valid = utf8_parts(text)
        postings = self.index(data, off)
        texts: dict[int, str] = {}
        for name, (rx, query) in self.rules.items():
            for i in self.candidates(query, postings, len(valid)).tolist():
                if i not in texts:
                    texts[i] = text[i].as_py() or ""
                for k, m in enumerate(rx.finditer(texts[i])):
                    yield i, name, k + 1, m.start(), m.end(), m.group()
                if query == ALL:
                    del texts[i]


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: dict[str, str] | None = None, step_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, rule, nth, start_char, end_char, masked, sha256) of every finding; one pass, no shuffle."""
    rules = RULES if rules is None else rules
    slim = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    id_type = slim.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("rule", T.StringType()), T.StructField("nth", T.IntegerType()), T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType()), T.StructField("masked", T.StringType()), T.StructField("sha256", T.StringType())])

    def run(batches):
        s = Scanner(rules)
        for batch in batches:
            for part in slices(batch, 1, step_bytes):
                found = list(s.find(part.column(1)))
                if not found:
                    continue
                doc, rule, nth, a, b, secret = zip(*found)
                ids = part.column(0).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(rule), *(pa.array(x, pa.int32()) for x in (nth, a, b)), pa.array([x[:4] + "****" for x in secret]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in secret])],
                    names=schema.names,
                )

    return slim.mapInArrow(run, schema)


def redact_arrow(text: pa.Array, s: Scanner) -> pa.Array:
    spans: dict[int, list[tuple[int, int]]] = {}
    for i, _, _, a, b, _ in s.find(text):
        spans.setdefault(i, []).append((a, b))
    if not spans:
        return text
    out = text.to_pylist()
    for i, found in spans.items():
        parts, at = [], 0
        merged: list[list[int]] = []
        for a, b in sorted(found):
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        for a, b in merged:
            parts += [out[i][at:a], MASK]
            at = b
        out[i] = "".join(parts) + out[i][at:]
    return pa.array(out, pa.string())


def redact(df: DataFrame, text_col: str = "text", rules: dict[str, str] | None = None, length_col: str | None = None) -> DataFrame:
    """``df`` with every secret in ``text_col`` replaced by ``[SECRET]``; columns and their order stay.
    length_col: a column that holds the text's length in characters, changed where the text is."""
    rules = RULES if rules is None else rules
    new = fresh(df.columns, "__redacted")

    def start():
        s = Scanner(rules)
        return lambda text: [redact_arrow(text, s)]

    done = map_text(df, text_col, [(new, T.StringType())], start)
    replaced = {text_col: F.col(new).alias(text_col)}
    if length_col:
        size = F.when(F.col(new) == F.col(text_col), F.col(length_col)).otherwise(F.length(new).cast(df.schema[length_col].dataType))
        replaced[length_col] = F.when(F.col(new).isNull(), F.col(length_col)).otherwise(size).alias(length_col)
    return done.select(*[replaced.get(c, F.col(f"`{c}`")) for c in df.columns])


def scan_sql(rules: dict[str, str] | None = None) -> str:
    """DuckDB SQL for :func:`scan` over ``documents``."""
    one = """SELECT doc_id, '{rule}' AS rule, CAST(i AS INTEGER) AS nth,
  CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS start_char,
  CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + list_sum(list_transform(hits[1:i], lambda x: length(x))) AS INTEGER) AS end_char,
  substr(hits[i], 1, 4) || '****' AS masked, sha256(hits[i]) AS sha256
FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS hits, regexp_split_to_array(text, '{p}') AS parts FROM documents WHERE regexp_matches(text, '{p}')))"""
    return "\nUNION ALL\n".join(one.format(rule=k, p=p.replace("'", "''")) for k, p in (RULES if rules is None else rules).items())
