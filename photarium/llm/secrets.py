"""Operator 4: secrets in text, by pattern and by assignment-aware lexing."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photarium.llm.syntax import pairs

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
# A run of a character class matches once, from its start, so its length can stand in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "literal")

#: No length is bounded: runs are possessive, and the look-behind starts each of them once.
SIGN = r"""(?::=|=>|\+=|=(?![=>])|:(?![:/=]))"""
#: Type parameters or subscripts behind a name.
BRACKETS = r"""(?:\[["']?[A-Za-z0-9_.,|\x20-]*+["']?(?:\[[A-Za-z0-9_.,|\x20]*+\][A-Za-z0-9_.,|\x20]*+)?+\])*+"""
#: ``name =``, ``name: ``, ``"name": ``, ``name[..] =``, ``export NAME=``: what a value is assigned to.
TARGET = re.compile(rf"""(?<![A-Za-z0-9_.$-])["']?(?P<name>[A-Za-z_$][A-Za-z0-9_.$-]*+{BRACKETS})["']?[\x20\t]*+{SIGN}[\x20\t]*+""", re.ASCII)
STRING = re.compile(
    r"""(?:[rRbBuUfF]{0,2}+(?:\"{3}(?P<t>(?:\\.|"{1,2}+(?!")|[^\\"])*+)\"{3}|'{3}(?P<u>(?:\\.|'{1,2}+(?!')|[^\\'])*+)'{3}|"(?P<d>(?:\\.|[^\\"\r\n])*+)"|'(?P<s>(?:\\.|[^\\'\r\n])*+)')|`(?P<b>[^`\r\n]*+)`)""",
    re.DOTALL,
)
BARE = re.compile(r"[A-Za-z0-9_$+/.=@!%^&*~-]++")
CALL = re.compile(r"(?:new[\x20]++)?[A-Za-z_$][A-Za-z0-9_.$]*+\(")
#: An assignment sign behind a bare value makes that value a name (or a type before one).
NEXT = re.compile(rf"""{BRACKETS}["']?[\x20\t]*+{SIGN}|(?<==)["'`]""", re.ASCII)
SUBSCRIPT = re.compile(r"""(?:\[["'][^"'\r\n\]]*+["']\])++""")
PLUS = re.compile(r"[\x20\t]*+(?:\\?\r?\n[\x20\t]*+)?\+[\x20\t]*+(?:\\?\r?\n[\x20\t]*+)?")
ADJACENT = re.compile(r"""[\x20\t]*+(?:\\\r?\n[\x20\t]*+)?(?=["'])""")
NOTHING = re.compile(r"[\x20\t]*+(?:[{|>][-+]?+[\x20\t]*+)?(?:\#[^\r\n]*+)?(?=\r?\n|$)")
SECTION = re.compile(r"^[\x20\t]*+\[([A-Za-z0-9_.\x20-]++)\][\x20\t]*+\r?$", re.MULTILINE)
ELEMENT = re.compile(r"<(?P<name>[A-Za-z_][A-Za-z0-9_.:-]*+)(?:[\x20\t][^<>]*+)?>[\x20\t]*+(?P<body>[^<>\s](?:[^<>\r\n]*[^<>\s])?)[\x20\t]*+</")
LINE_COMMENT = re.compile(r"(?:^|(?<=[\x20\t;{}]))(?:\#|//)[^\r\n]*+", re.MULTILINE)
BLOCKS = (("/*", re.compile(r"/\*.*?\*/", re.DOTALL), "*/"), ("<!--", re.compile(r"<!--.*?-->", re.DOTALL), "-->"))
PARAMETER = re.compile(r"""[()\r\n]|(?=["'`])""")
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

# Weights of name parts: fixed values of this operator.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "private": 0.5, "auth": 0.6, "access": 0.3, "api": 0.4, "client": 0.1, "key": 0.5, "signing": 0.5, "encryption": 0.5, "bearer": 0.9, "salt": 0.5, "pin": 0.4, "dsn": 0.6, "connection": 0.3, "webhook": 0.6}
HARMLESS = {"public": -0.8, "name": -0.5, "file": -0.5, "path": -0.6, "url": -0.3, "count": -0.8, "length": -0.8, "size": -0.8, "type": -0.6, "id": -0.3, "expires": -0.8, "expiry": -0.8, "ttl": -0.8, "policy": -0.6, "field": -0.5, "max": -0.8, "min": -0.8, "limit": -0.8, "hint": -0.6, "label": -0.5}
PLACEHOLDERS = frozenset("changeme password secret token none null true false undefined example placeholder redacted your_password your_token your_api_key todo test default string required optional".split())
THRESHOLD = 0.9


def name_words(name: str) -> frozenset[str]:
    """The parts of a name that have a weight; a plural counts as its singular."""
    parts = {w.lower() for w in WORD.findall(name)}
    parts |= {p[:-1] for p in parts if p[-1] == "s" and p not in SENSITIVE and p not in HARMLESS}
    return frozenset(p for p in parts if p in SENSITIVE or p in HARMLESS)


def words_score(words: frozenset[str]) -> float:
    return max(0.0, sum(SENSITIVE.get(p, 0) + HARMLESS.get(p, 0) for p in sorted(words)))


def name_score(name: str) -> float:
    return words_score(name_words(name))


def literal_score(value: str) -> float:
    """From 0 to 1: long, mixed and unrepetitive literals score high, placeholders 0."""
    n = len(value)
    if n < 8 or value.lower() in PLACEHOLDERS or len(set(value)) < 4 or value.startswith(("${", "<", "{{", "$(")):
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in value)
    return min(1.0, entropy / 4) * (0.55 + 0.15 * kinds)


def _comments(text: str) -> list[tuple[int, int]]:
    found = [m.span() for m in LINE_COMMENT.finditer(text)] if "#" in text or "//" in text else []
    for start, pattern, stop in BLOCKS:
        if start in text:  # up to the last closing mark every comment is closed, so none is tried in vain
            found += [m.span() for m in pattern.finditer(text, 0, text.rfind(stop) + len(stop))]
    return sorted(found)


def _name(x: str) -> str:
    """``cfg["a"]`` and ``cfg.a`` are one name."""
    return ".".join(re.findall(r"[A-Za-z0-9_$-]+", x))


class _Assignment:
    """A target with the literals and names of its value. ``apart``: inside a comment or a string, where it binds nothing in the program."""

    __slots__ = ("name", "path", "literals", "uses", "apart", "at", "score")

    def __init__(self, name: str, path: str, apart: bool, at: int):
        self.name, self.path, self.apart, self.at = _name(name), path, apart, at
        self.literals: list[tuple[list[tuple[int, int]], str]] = []
        self.uses: list[str] = []
        self.score = name_score(path)


def _string(m: re.Match) -> tuple[int, int]:
    return m.span(m.lastgroup)


def _value(text: str, at: int, into: _Assignment) -> int:
    """Reads the value at ``at`` into literals (adjacent and added ones fold into one) and used names; returns its end."""
    spans: list[tuple[int, int]] = []
    while True:
        if m := STRING.match(text, at):
            spans.append(_string(m))
            at = m.end()
        elif m := CALL.match(text, at):
            depth, at = 1, m.end()
            while depth and (p := PARAMETER.search(text, at)):
                if p[0] in "()" and p[0]:
                    depth, at = depth + (1 if p[0] == "(" else -1), p.end()
                elif p[0]:
                    break
                elif q := STRING.match(text, p.end()):
                    into.literals.append(([_string(q)], text[slice(*_string(q))]))
                    at = q.end()
                else:
                    at = p.end() + 1
        elif m := BARE.match(text, at):
            if q := SUBSCRIPT.match(text, m.end()):
                into.uses.append(_name(text[at : q.end()]))
                at = q.end()
            else:
                spans.append(m.span())
                at = m.end()
                break
        else:
            break
        if not (m := PLUS.match(text, at) or ADJACENT.match(text, at)):
            break
        at = m.end()
    if spans:
        into.literals.append((spans, "".join(text[s:e] for s, e in spans)))
    return at


def assignments(text: str) -> list[_Assignment]:
    """Name-literal pairs of source, configuration and markup, in order.

    A bare value with an assignment sign behind it is a type, a remark or the
    next name of a chain: its target gets the value behind that sign too. A key
    whose line ends behind the sign, and a ``[section]``, lend their names to the
    deeper or following keys.
    """
    found, comments, c = [], _comments(text), 0
    sections, n, section = list(SECTION.finditer(text)) if "[" in text else [], 0, ""
    parents: list[tuple[int, str]] = []
    inside = at = 0  # the end of the string that is being searched
    waiting: list[_Assignment] = []
    while m := TARGET.search(text, at):
        start = m.start("name")
        if m.start() != at:
            waiting = []
        while n < len(sections) and sections[n].start() < start:
            section, parents, n = sections[n][1], [], n + 1
        while c < len(comments) and comments[c][1] <= start:
            c += 1
        apart = start < inside or c < len(comments) and comments[c][0] <= start
        line = text.rfind("\n", max(0, start - 200), start) + 1
        indent = start - line if line and not text[line:start].strip("\x20\t-\"'{") else 0
        parents = [p for p in parents if p[0] < indent] if parents and not apart else parents
        one = _Assignment(m["name"], ".".join([section, *(p[1] for p in parents), m["name"]]), apart, start)
        found.append(one)
        at = m.end()
        if not apart and NOTHING.match(text, at) and not waiting:
            parents.append((indent, m["name"]))
            continue
        bare = BARE.match(text, at)
        if bare and not STRING.match(text, at) and (follows := NEXT.match(text, bare.end())):
            waiting.append(one)
            if follows[0][-1] in ":\"'`":  # a colon or a quote may end the value as well
                one.literals.append(([bare.span()], bare[0]))
            continue
        end = _value(text, at, one)
        for other in waiting:
            other.literals, other.uses = other.literals + one.literals, other.uses + one.uses
        waiting = []
        if end > at and text[at : at + 1] in "\"'`rRbBuUfF" and STRING.match(text, at):
            inside = max(inside, end)
            while c < len(comments) and comments[c][0] < end:
                c += 1
            at += 1  # assignments inside the string are read on their own
        else:
            at = max(end, at)
    for m in ELEMENT.finditer(text) if "</" in text else ():
        one = _Assignment(m["name"], m["name"], True, m.start())
        one.literals.append(([m.span("body")], m["body"]))
        found.append(one)
    return found


def literal_spans(text: str, threshold: float = THRESHOLD) -> list[tuple[str, int, int]]:
    """Literals whose own or inherited name is sensitive enough.

    A bare value that is itself an assigned name is a reference: the assignment
    it means, the last one before the use or else the first after it, inherits
    the target's score. Scores are passed on until none rises, along any chain
    of names, so ``K = "x9..."`` scores for ``password = K``. Comments and
    strings bind no names of the program. What a value holds beyond its first
    part, in brackets, behind operators, in tuples, attributes or blocks, is
    read from tokens (``syntax.pairs``).
    """
    low = text.lower() if "=" in text or ":" in text or "</" in text else ""
    if not any(map(low.__contains__, SENSITIVE)):
        return []  # no pair, or no name that can score
    found = assignments(text)
    bound: dict[tuple[str, bool], list[_Assignment]] = {}
    for x in found:
        bound.setdefault((x.name, x.apart), []).append(x)

    def meant(name: str, user: _Assignment) -> _Assignment | None:
        for apart in (True, False) if user.apart else (False,):
            places = bound.get((name, apart), ())
            if places and (places[0] is not user or len(places) > 1):
                k = bisect_left(places, user.at, key=lambda x: x.at)
                return places[k - 1] if k else next((x for x in places if x is not user), None)
        return None

    edges: dict[int, list[_Assignment]] = {}
    for x in found:
        own = []
        for spans, value in x.literals:
            target = meant(_name(value.lstrip("$")), x) if len(spans) == 1 and not value.endswith("=") and text[spans[0][0] - 1] not in "\"'`" else None
            if target is None or target.at == spans[0][0]:  # a value with a colon behind it is no use of itself
                own.append((spans, value))
            else:
                x.uses.append(target.name)
                edges.setdefault(id(x), []).append(target)
        edges.setdefault(id(x), []).extend(t for t in (meant(u, x) for u in x.uses) if t is not None)
        x.literals = own
    rising = [x for x in found if x.score > 0]
    while rising:
        x = rising.pop()
        for target in edges[id(x)]:
            if target.score < x.score:
                target.score = x.score
                rising.append(target)
    best: set[tuple[str, int, int]] = set()
    for x in found:
        for spans, value in x.literals if x.score > 0 else ():
            worth = literal_score(value)
            if worth > 0.35 and x.score + worth * 0.6 >= threshold:
                best.update(("literal", s, e) for s, e in spans if e > s)
    for words, (start, stop) in pairs(text, name_words):
        if stop > start and (own := words_score(words)) > 0:
            worth = literal_score(text[start:stop])
            if worth > 0.35 and own + worth * 0.6 >= threshold:
                best.add(("literal", start, stop))
    return sorted(best, key=lambda s: s[1:])


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
    for batch in batches:
        base, more = [], []
        for t in batch.column(1):
            text = t.as_py() or ""
            own = base_spans(text)
            added = sorted(set(literal_spans(text)), key=lambda s: s[1:])
            base.append([dict(zip(("kind", "start", "stop"), s)) for s in own])
            more.append([dict(zip(("kind", "start", "stop"), s)) for s in added])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, span), pa.array(more, span)], names=["doc_id", "base", "literals"])


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, base, literals``: arrays of (kind, start, stop) in code points.

    One output row per row; null text counts as empty and has no spans; texts
    are lexed whole, however long; null and repeated ids and repeated rows stay
    as they are; extra columns are ignored; an empty table gives no rows.
    """
    span = "array<struct<kind:string,start:int,stop:int>>"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scan_batches, f"doc_id long, base {span}, literals {span}")


def _listed(spans: "F.Column") -> "F.Column":
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    found = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]]
    place = F.array(*(F.lit(k) for k in KINDS))
    ordered = F.array_sort(F.transform(F.concat("base", "literals"), lambda s: F.struct(s["start"].alias("start"), F.array_position(place, s["kind"]).alias("place"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(ordered).alias("spans"))
