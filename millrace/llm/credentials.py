"""Secret scans: assignments lexed out of source and configuration text, constants propagated, literals scored by their targets' names.

Any text is read for pairs of a name and an expression: assignments and
comparisons of programming languages, keys of JSON, YAML, INI, properties and
shell files, elements and name/value attributes of markup, #define, long options,
SQL passwords and the user part of URLs. An expression is a row of literals and
names joined by a concatenation or a fallback. Names that other pairs define are
constants: what a sensitive target is made of counts with that target, however
many names lie between.

A literal's score is the sensitivity of the target's name times how much the
literal looks like a secret. Besides that, three plain patterns always count
(base spans).
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import slices, trimmed

SHAPE = "doc_id long, spans array<struct<kind:string,start:long,stop:long>>"

# --- fixed values: base patterns, with the least length of group 2 or of the match
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
}
KINDS = (*BASE, "named")
#: Any match of the base pattern "assign" has one of these, in small letters.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Words of a target's name, and how sure they make a literal a secret; two words are neighbours in the name.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 1.0, "pass": 0.9, "passcode": 0.9, "pw": 0.9, "pin": 0.6,
    "secret": 1.0, "secrets": 0.9, "token": 0.9, "tokens": 0.7, "jwt": 0.9, "bearer": 0.9, "authorization": 0.9, "auth": 0.6,
    "credential": 0.9, "credentials": 0.9, "creds": 0.9, "apikey": 1.0, "key": 0.55, "salt": 0.6, "signature": 0.55, "cookie": 0.55,
    "api key": 1.0, "private key": 1.0, "access key": 0.9, "secret key": 1.0, "encryption key": 0.9, "signing key": 0.9,
    "account key": 0.9, "master key": 0.9, "auth key": 0.9, "license key": 0.7, "session id": 0.7, "connection string": 0.7, "webhook url": 0.6,
}
#: A name that ends in one of these speaks about a secret and does not hold it.
ABOUT = set("name names file filename path dir url uri host id type kind length len size count min max policy hint label field column header prefix suffix regex pattern format expiry expires ttl timeout age limit version algorithm alg text title message error prompt public required enabled".split())
#: Literals that stand for a value.
PLACEHOLDER = re.compile(r"(?ix)(?: x+ | \*+ | \.+ | -+ | <.*> | \$.* | \{\{.*\}\} | \{\w*\} | %\(?\w*\)?[sd%]? | \#\{.*\} | @.*@ | (?:your|my|the|some|insert|enter|replace)[\W_].* | .*change.?(?:me|it).* | .*placeholder.* | .*example.* | none | null | nil | true | false | undefined | todo | tbd | n/?a | redacted | password | passwd | secret | token | optional | required | string | default )\Z")
#: Calls whose first argument names a value; the next ones stand in for it.
LOOKUPS = set("get getenv env environ getproperty getstring config lookup fetch pop setdefault secret".split())
THRESHOLD = 0.5
# ---

_NAME = r"[^\W\d][\w$]*+(?:-[\w$]++)*+(?:(?:\.|->|::)[\w$]++(?:-[\w$]++)*+|\[[ \t]*+[\"']?[\w$ .-]*+[\"']?[ \t]*+\])*+"
_PAIR = re.compile(
    rf"""(?:(?P<q>["'`])(?P<quoted>[\w$@./\x20-]++)(?P=q)\]?|(?<![\w$.])(?P<name>{_NAME}))[ \t]*+"""
    r"""(?P<op>:=|=>|===?|!==?|\?\?=|\|\|=|=|\+=|:(?![:/=]))[ \t]*+(?:(?P<type>(?<=:)[ \t]*+[^\W\d][\w.\[\]<>|]*+[ \t]*+=(?!=)[ \t]*+))?""",
)
_OTHER_PAIRS = [
    ("define", re.compile(r"#[ \t]*+define[ \t]++(?P<name>\w++)[ \t]++")),
    ("--", re.compile(r"(?<!\S)--(?P<name>[\w-]++)[ \t]++(?=[^\s-])")),
    ("'", re.compile(r"(?i:\bidentified[ \t]++by|\b(?P<name>password))[ \t]++(?=')")),
]
_ELEMENT = re.compile(r"<(?P<name>[\w:.-]++)>[ \t]*+(?P<value>[^<>\s]++)[ \t]*+</(?P=name)>")
_USER_PART = re.compile(r"://[^\s/:@\"'<>]*+:(?P<value>[^\s/@\"'<>]++)@")
_STRING = re.compile(r"""[rRbBuUfF@$]{0,2}(?:\"{3}(?s:(?P<a>.*?))\"{3}|'{3}(?s:(?P<b>.*?))'{3}|"(?P<c>(?:[^"\\\n]|\\.)*+)"|'(?P<d>(?:[^'\\\n]|\\.)*+)'|`(?P<e>[^`]*+)`)""")
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>]++""")
_WHOLE_NAME = re.compile(_NAME)
_CALL = re.compile(rf"""(?P<callee>{_NAME})[ \t]*+\((?P<inside>(?:"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|[^()"'\n])*+)\)""")
_JOIN = re.compile(r"[ \t]*+(?:\\\r?\n[ \t]*+|(?:\+|\.\.?|&|\|\||\?\?|\bor\b)\s*+)")
_SCHEME = re.compile(r"(?i:bearer|basic|token|digest)[ \t]++(?=[\w+/.=-]{8})")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\dA-Z_]+")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, stop) of the base patterns: leftmost matches that do not overlap, without those that are too short."""
    out, low = [], text.lower()
    for kind, (pattern, group, least) in BASE.items():
        if kind == "access" and "AKIA" not in text or kind == "assign" and not any(w in low for w in ASSIGN_WORDS):
            continue
        out += [(kind, *m.span()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return out


def sensitivity(name: str) -> float:
    """0 to 1: how sure a target's name makes its literal a secret."""
    words = [w.lower() for w in _WORDS.findall(name)]
    if not words or words[-1] in ABOUT and f"{' '.join(words[-2:])}" not in SENSITIVE:
        return 0.0
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
    return max((SENSITIVE.get(w, 0.0) for w in [*words, *pairs]), default=0.0) * (0.5 if "public" in words else 1.0)


def strength(value: str, quoted: bool) -> float:
    """0 to 1: how much a literal looks like a secret; by its bits of entropy, kinds of characters, and what it cannot be."""
    if len(value) < 6 or PLACEHOLDER.match(value) or "://" in value or value.startswith(("/", "./", "../", "~/")):
        return -1.0
    n = len(value)
    bits = -sum(c * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(map(bool, (re.search(r"[a-z]", value), re.search(r"[A-Z]", value), re.search(r"\d", value), re.search(r"[^\w\s]", value))))
    if re.search(r"\s", value) or kinds < 2:
        bits /= 2
    if not quoted and (kinds < 2 or not re.search(r"\d", value)):
        return -1.0  # a word of prose, a type, a name
    if re.fullmatch(r"[A-Z][A-Z\d]*(?:_[A-Z\d]+)+|[a-z]+(?:[._][a-z]+)+", value):
        return -1.0  # the name of a variable or of a function
    return min(1.0, bits / 56)


def _score(sure: float, looks: float) -> float:
    return sure * (0.4 + 0.6 * looks) if looks >= 0 else 0.0


class Pair:
    """A target's name with what it is made of: literals (start, stop, quoted) and names."""

    def __init__(self, name: str, binds: bool) -> None:
        self.name, self.binds = name, binds
        self.literals: list[tuple[int, int, bool]] = []
        self.names: list[tuple[str, int, int]] = []


def _string(m: re.Match) -> tuple[int, int, bool]:
    return (*m.span(m.lastgroup), True)


def _expression(text: str, at: int, pair: Pair) -> int:
    """Reads the expression at a place into pair; returns where its last literal or name ends."""
    end, inside = at, False
    while True:
        if text.startswith("(", at):
            inside, at = True, at + 1
            while text[at : at + 1].isspace():
                at += 1
        if m := _STRING.match(text, at):
            pair.literals.append(_string(m))
        elif m := _CALL.match(text, at):
            strings = [_string(s) for s in _STRING.finditer(text, *m.span("inside"))]
            pair.literals += strings[1:] if re.split(r"\W+", m["callee"])[-1].lower() in LOOKUPS else strings
        elif m := _BARE.match(text, at):
            if text[m.end() : m.end() + 1] == "(":
                return end
            pieces = m[0].split("+")
            if all(_WHOLE_NAME.fullmatch(p) for p in pieces):
                start = m.start()
                for p in pieces:
                    pair.names.append((p, start, start + len(p)))
                    start += len(p) + 1
            else:
                pair.literals.append((*m.span(), False))
        else:
            return end
        end = m.end()
        if join := _JOIN.match(text, end):
            at = join.end()
        elif inside or re.compile(r"""[ \t]*+["']""").match(text, end) and pair.literals and pair.literals[-1][2]:
            at = end  # literals that stand side by side are one
            while text[at : at + 1].isspace():
                at += 1
            if text[at : at + 1] not in ('"', "'"):
                return end
        else:
            return end


def pairs_of(text: str) -> list[Pair]:
    """The pairs of names and expressions in a text, in order of their kinds and places."""
    found = []

    def add(name: str, at: int, binds: bool) -> int:
        pair = Pair(name, binds)
        if m := _SCHEME.match(text, at):
            at = m.end()
        end = _expression(text, at, pair)
        if pair.literals or pair.names:
            found.append(pair)
        return end

    if "=" in text or ":" in text:
        at = 0
        while m := _PAIR.search(text, at):
            name = m["quoted"] or m["name"]
            end = add(name, m.end(), m["op"] in (":", "=", ":=", "=>", "??=", "||=", "+="))
            last = found[-1] if found else None
            # name = "X", value = "y" says X = y
            if last and name.lower() == "value" and len(found) > 1 and found[-2].name.lower() in ("name", "key", "id") and len(found[-2].literals) + len(found[-2].names) == 1:
                (lo, hi, *_), *_ = found[-2].literals or [n[1:] for n in found[-2].names]
                last.name = text[lo:hi]
            at = max(end, m.end())
            if last and last.names and not last.literals:
                at = m.end()  # the name may begin a pair of its own
    for mark, pattern in _OTHER_PAIRS:
        if mark in text:
            for m in pattern.finditer(text):
                add(m["name"] or "password", m.end(), mark == "define")
    whole = ([*_ELEMENT.finditer(text)] if "</" in text else []) + ([*_USER_PART.finditer(text)] if "://" in text else [])
    for m in whole:
        pair = Pair(m.groupdict().get("name") or "password", False)
        pair.literals.append((*m.span("value"), True))
        found.append(pair)
    return found


def named_spans(text: str) -> list[tuple[int, int]]:
    """(start, stop) of the literals that end up in sensitive targets and look like secrets."""
    pairs = pairs_of(text)
    if not any(sensitivity(p.name) for p in pairs):
        return []
    defined: dict[str, list[int]] = defaultdict(list)
    for i, p in enumerate(pairs):
        if p.binds:
            defined[p.name].append(i)
    made_of: list[list[str]] = []  # the constants in each pair's expression
    for p in pairs:
        known = []
        for name, lo, hi in p.names:
            short = re.split(r"\.|->|::", name)[-1]
            if name in defined or short in defined:
                known.append(name if name in defined else short)
            elif len(p.names) == 1 and not p.literals:  # a bare value, not a name of something else
                p.literals.append((lo, hi, False))
        made_of.append(list(dict.fromkeys(known)))

    def looks(i: int) -> float:
        """Of what an expression joins: its literals, and those of its constants as last defined before it (or first, if after)."""
        literals = set(pairs[i].literals)
        for name in made_of[i]:
            where = defined[name]
            literals.update(pairs[where[max(0, bisect_left(where, i) - 1)]].literals)
        one = sorted(literals)
        return strength("".join(text[lo:hi] for lo, hi, _ in one), any(q for *_, q in one)) if one else -1.0

    # from the surest targets down to all definitions of the constants they are made of; each is reached once
    score = [0.0] * len(pairs)
    seen: set[str] = set()
    for sure, joined, i in sorted(((s, looks(i), i) for i, p in enumerate(pairs) if (s := sensitivity(p.name))), key=lambda t: (-t[0], -t[1], t[2])):
        score[i] = max(score[i], _score(sure, joined))
        reached = [name for name in made_of[i] if name not in seen]
        seen.update(reached)
        while reached:
            for j in defined[reached.pop()]:
                score[j] = max(score[j], _score(sure, max(joined, looks(j))))
                more = [name for name in made_of[j] if name not in seen]
                seen.update(more)
                reached += more
    spans = {(lo, hi) for i, p in enumerate(pairs) if score[i] >= THRESHOLD for lo, hi, _ in p.literals if hi - lo >= 4 and not PLACEHOLDER.match(text[lo:hi])}
    return sorted(spans)


def secret_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans, and the named ones that lie in none of them; by start, then kind, then stop."""
    base = base_spans(text)
    starts = sorted((lo, hi) for _, lo, hi in base)
    extra, furthest, i = [], 0, 0
    for lo, hi in named_spans(text):
        while i < len(starts) and starts[i][0] <= lo:
            furthest, i = max(furthest, starts[i][1]), i + 1
        if hi > furthest:
            extra.append(("named", lo, hi))
    return sorted(base + extra, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _scan(batches):
    for part in slices(batches):
        spans = [secret_spans(t) if t else [] for t in part.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array([[{"kind": k, "start": lo, "stop": hi} for k, lo, hi in s] for s in spans], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])))], ["doc_id", "spans"])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans (kind, start, stop in code points; by start, then kind): secrets in each whole text.

    Kinds assign, access and hex are the base patterns' matches, which always
    stay. Kind named is a literal (without its quotes) that reaches a sensitive
    target, unless a base span holds all of it.

    A null or empty text has no spans. Repeated rows are scanned each for
    itself; ids are carried as they are, nulls too. Columns but the two named
    are left out, whatever their names; an empty table gives an empty one.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(trimmed(_scan), SHAPE)
