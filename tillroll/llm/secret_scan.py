"""Secret scans by assignment-aware lexing.

A text is read as source or configuration: a lexer finds (name, value) pairs in
assignments, mappings, keyword arguments, attributes, elements, options and
calls with a name and a literal.  A value is one literal, literals joined by
``+``, or a reference; references are followed through the text's own
assignments (constant propagation, cycles end).  A pair whose target name has
sensitive words is scored by the name and the form of the literal; literals
with ``THRESHOLD`` or more become spans of kind ``assign``, where they stand.
The base patterns' spans always stay; a literal inside one adds nothing.

Every text is read by itself, so a row is a unit of work and nothing is
shuffled.  All patterns run in time linear in the text: names start at a word's
start and no part of a pattern is read twice.

Defined cases: null and empty texts have no spans; ties (two names for one
literal) go to the higher score; repeated rows are judged each by itself; very
long texts are read whole; an empty table gives no rows; other columns pass
through ``scan``, and columns named like the results are replaced.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame

from tillroll.llm.common import with_columns

THRESHOLD = 0.5
KINDS = ("assign", "access", "hex")
# The base patterns.
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # runs of 32 or more
_STEMS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# Words of a target name and their weights; two words count if they follow each other.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "passcode": 0.9, "pwd": 1.0, "pw": 0.9, "pass": 0.8, "secret": 1.0, "secrets": 0.9,
    "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "authorization": 0.8, "bearer": 0.8, "auth": 0.6,
    "api key": 1.0, "access key": 1.0, "secret key": 1.0, "private key": 1.0, "signing key": 1.0, "encryption key": 1.0,
    "account key": 0.9, "auth key": 0.9, "master key": 0.9, "service key": 0.8, "session key": 0.8, "shared key": 0.9, "webhook key": 0.8,
}
# A name that ends so speaks about a secret and does not hold it.
ABOUT = frozenset(
    "type count url uri endpoint name id length len size field label path file policy expiry expires ttl timeout limit hint prompt regex pattern min max required enabled".split()
)
_STEM = re.compile("|".join(("pass", "pwd", "pw", "secret", "token", "key", "cred", "auth", "bearer")), re.I)
_FILLER = re.compile(
    r"(?:change|replace|insert|enter|put|your|my|some|the|test|example|sample|dummy|fake|todo|none|null|undefined|true|false|redacted|hidden|masked|secret|password|passwd|token|key|here|me|value|xxx+|\*+|\.+|-+|_+|<|>|0+|1234567?8?9?0?)++",
    re.I,
)

_NAME = r"[A-Za-z_$@][\w.$-]*+"
_TYPE = r"(?:[ \t]*+:[ \t]*+[A-Za-z_][\w.]*+(?:\[[^\]\n]{0,80}\])?(?=[ \t]*+=))?"
_STRING = r"\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|`[^`\n]*+`"
_BARE = r"[^\s\"'`,;(){}\[\]<>]++"
_VALUE = rf"(?:[A-Za-z]{{0,3}}(?:{_STRING})(?:[ \t]*+\+?[ \t]*+(?:{_STRING}))*+|{_BARE}(?:[ \t]*+\+[ \t]*+(?:{_STRING}|{_BARE}))*+)"
_PAIR = re.compile(
    rf"(?<![\w.$-])(?P<name>{_NAME})[\"']?(?:[ \t]*+\])?{_TYPE}[ \t]*+(?::=|=>|=(?![=>~])|:(?![:=/]))[ \t]*+(?:(?:Bearer|Basic|Token)[ \t]++)?(?P<value>{_VALUE})"
)
_OPTION = re.compile(rf"(?<![\w-])--?(?P<name>[A-Za-z][\w-]*+)[ \t]++(?P<value>{_VALUE})")
_CALL = re.compile(rf"(?<![\w.$-])(?:(?:\w++\.)*+set_?(?P<setter>[A-Za-z]\w*+)\(|[\"'](?P<name>{_NAME})[\"'][ \t]*+,)[ \t]*+(?P<value>{_VALUE})")
_ELEMENT = re.compile(r"<(?P<name>[A-Za-z_][\w.-]*+)>(?P<value>[^<>\n]++)</(?P=name)>")
_PART = re.compile(rf"(?P<string>{_STRING})|(?P<bare>{_BARE})")
_REFERENCE = re.compile(r"\$\{(\w++)\}|\$(\w++)|%(\w++)%|\{(\w++)\}")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def name_weight(name: str) -> float:
    """How sensitive a target name is, 0 to 1."""
    words = [w.lower() for w in _WORDS.findall(name)]
    if not words or words[-1] in ABOUT:
        return 0.0
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
    return max((SENSITIVE.get(w, 0.0) for w in [*words, *pairs, "".join(words[-2:])]), default=0.0)


def literal_weight(s: str) -> float:
    """How much a literal looks like a secret, 0 to 1: its length, the entropy
    of its characters and their classes; 0 for fillers, short and monotonous
    ones."""
    if len(s) < 6 or any(c.isspace() for c in s) or _FILLER.fullmatch(s):
        return 0.0
    n = len(s)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(s).values())
    if entropy < 2:  # few different characters
        return 0.0
    classes = sum(any(t(c) for c in s) for t in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in s)
    if classes == 1 and not s.isdigit() and n < 16:  # a plain word
        return 0.3
    return min(1.0, 0.25 * min(1.0, n / 12) + 0.45 * min(1.0, entropy / 3.0) + 0.15 * classes)


class Lexed:
    """The (name, parts of the value) pairs of a text; a part is (start, end, quoted)."""

    def __init__(self, text: str):
        self.text = text
        self.pairs: list[tuple[str, list[tuple[int, int, bool]]]] = []
        for pattern in (_PAIR, _OPTION, _CALL, _ELEMENT):
            for m in pattern.finditer(text):
                self.pairs.append((m["name"] or m["setter"], self._parts(m.start("value"), m.end("value"))))
        # the last assignment of a name counts
        self.constants = {_plain(name): i for i, (name, _) in enumerate(self.pairs)}

    def _parts(self, start: int, end: int) -> list[tuple[int, int, bool]]:
        out = []
        for m in _PART.finditer(self.text, start, end):
            if m["string"]:
                q = 3 if m["string"][:3] in ('"""', "'''") and len(m["string"]) >= 6 else 1
                out.append((m.start() + q, m.end() - q, True))
            elif m["bare"] != "+":
                out.append((m.start(), m.end(), False))
        # a prefix such as f"..." or b'...' is no part of its own
        return [p for i, p in enumerate(out) if p[2] or i + 1 == len(out) or not out[i + 1][2] or out[i + 1][0] - p[1] != 1]

    def split(self, pair: int) -> tuple[list[int], list[tuple[int, int]]]:
        """The pairs that a pair's value refers to, and its own literals."""
        to, own = [], []
        for start, end, quoted in self.pairs[pair][1]:
            s = self.text[start:end]
            names = [g for m in _REFERENCE.finditer(s) for g in m.groups() if g]
            if not quoted and _plain(s) != _plain(self.pairs[pair][0]):
                names.append(_plain(s))
            found = [self.constants[n] for n in names if n in self.constants]
            to += found
            if start < end and not found and not _REFERENCE.fullmatch(s):
                own.append((start, end))
        return to, own


def _plain(name: str) -> str:
    return name.lstrip("$@").rsplit(".", 1)[-1]


def added(text: str) -> list[tuple[int, int]]:
    """Places of the literals that the method takes for secrets.

    A pair takes the greatest weight of the names that reach it; from the
    greatest on, every pair is visited once."""
    if not _STEM.search(text):
        return []
    lexed = Lexed(text)
    weights = [name_weight(name) for name, _ in lexed.pairs]
    done: set[int] = set()
    out = set()
    for first in sorted((i for i, w in enumerate(weights) if w > 0), key=lambda i: -weights[i]):
        todo = [first]
        while todo:
            i = todo.pop()
            if i in done:
                continue
            done.add(i)
            to, own = lexed.split(i)
            todo += to
            if own and weights[first] * literal_weight("".join(text[a:b] for a, b in own)) >= THRESHOLD:
                out.update(own)
    return sorted(out)


def base(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns' matches."""
    out = []
    low = text.lower()
    if any(s in low for s in _STEMS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _outside(places: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """``places`` (sorted) that no span (sorted by start) holds whole."""
    out, i, reach = [], 0, -1
    for start, end in places:
        while i < len(spans) and spans[i][0] <= start:
            reach = max(reach, spans[i][2])
            i += 1
        if end > reach:
            out.append((start, 0, end))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` (text) with n_assign, n_access, n_hex, base_sha256, spans."""

    def run(texts):
        out = {"n_assign": [], "n_access": [], "n_hex": [], "base_sha256": [], "spans": []}
        for t in texts:
            found = base(t or "")
            for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                out[name].append(sum(x[1] == k for x in found))
            out["base_sha256"].append(hashlib.sha256(_joined(found).encode()).hexdigest())
            out["spans"].append(_joined(sorted(found + _outside(added(t or ""), found))))
        return out

    return with_columns(docs, ["text"], "n_assign long, n_access long, n_hex long, base_sha256 string, spans string", run)


def op12_secrets(docs: DataFrame) -> DataFrame:
    """The contract's columns, one row per document."""
    return scan(docs.select("doc_id", "text")).drop("text")
