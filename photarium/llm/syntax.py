"""Names and the literals of their values, read from tokens: brackets, tuples, operators, markup attributes, block scalars."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

#: One token; runs are possessive, so each character is looked at a few times whatever the text.
TOKEN = re.compile(
    r"""(?P<string>[rRbBuUfF]{0,2}+(?:\"{3}(?:\\.|"{1,2}+(?!")|[^\\"])*+\"{3}|'{3}(?:\\.|'{1,2}+(?!')|[^\\'])*+'{3}|"(?:\\.|[^\\"\r\n])*+"|'(?:\\.|[^\\'\r\n])*+')|`[^`\r\n]*+`)
    |(?P<comment>(?:(?<=[\s;{}(,])|^)(?:\#|//)[^\r\n]*+)
    |(?P<name>[^\W\d][\w$]*+(?:(?:\.|->|::)[^\W\d][\w$]*+)*+)
    |(?P<number>\d[\w.]*+)
    |(?P<sign>:=|=>|\+=|(?<![=!<>])=(?![=~])|:(?![:/]))
    |(?P<open>[(\[{])
    |(?P<close>[)\]}])
    |(?P<comma>[,;])
    |(?P<line>\\?\r?\n)
    |(?P<operator>\|\||\?\?|&&|[=!<>]=|[+?%|&.])
    |(?P<other>[^\s])""",
    re.DOTALL | re.VERBOSE | re.MULTILINE,
)
#: Words that join parts of a value or stand before them; fixed values.
JOINING = frozenset("or and not if else in is new await return lambda unless then default".split())
QUOTES = re.compile(r"""^[rRbBuUfF]{0,2}(\"{3}|'{3}|["'`])""")
TAG = re.compile(r"<[A-Za-z_][^<>]*+>")
ATTRIBUTE = re.compile(r"""([A-Za-z_:][\w:.-]*+)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)')""")
CDATA = re.compile(r"<([A-Za-z_][\w:.-]*+)(?:\s[^<>]*+)?><!\[CDATA\[([^\]]*+(?:\](?!\]>)[^\]]*+)*+)\]\]>")
BLOCK = re.compile(r"""^([\x20]*+)(?:-\x20+)?["']?([\w.-]++)["']?\x20*+:\x20*+[|>][-+0-9]*+[\x20\t]*+\r?\n""", re.MULTILINE)
LINE = re.compile(r"([\x20\t]*+)([^\r\n]*+)(?:\r?\n|\Z)")

#: The words of a name that count, and those of the names around it.
Words = frozenset[str]
Pair = tuple[Words, tuple[int, int]]


def _inside(m: re.Match) -> tuple[int, int]:
    """A string token without its quotes."""
    quote = QUOTES.match(m[0])
    return m.start() + quote.end(), m.end() - len(quote[1])


class _Frame:
    """A bracket, or the whole text, while it is open: names seen on the left, and whose value is being read. ``lender``: what the names around say."""

    __slots__ = ("kind", "lender", "left", "targets", "index", "typed", "bare", "listed")

    def __init__(self, kind: str, lender: Words):
        self.kind, self.lender = kind, lender
        self.clear()

    def clear(self) -> None:
        self.left: list[tuple[str, tuple[int, int] | None]] = []  # names, or strings that may be keys
        self.targets: list[Words] = []
        self.index = 0
        self.typed = False  # the last sign was a colon
        self.bare: str | None = None  # a name that ends what was read of the value
        self.listed = False  # the names on the left are a list

    def owner(self) -> Words:
        return self.targets[min(self.index, len(self.targets) - 1)] if self.targets else self.lender


def program_pairs(text: str, words: Callable[[str], Words]) -> Iterator[Pair]:
    """Every string of a value with the name it is assigned to, brackets' names before their members' names.

    ``a, b = x, y`` pairs by place, ``a: T = x`` and ``a = b = x`` hand the value
    on, a value goes on over operators and calls, in brackets over lines, and ends
    at a comma, a bracket's end, a line's end or where two words stand side by side.
    """
    frames = [_Frame("", frozenset())]
    broken = False  # a line has ended
    for m in TOKEN.finditer(text):
        kind, frame = m.lastgroup, frames[-1]
        if kind == "comment":
            continue
        if kind == "line":
            if m[0][0] != "\\" and frame.kind in ("", "{"):
                broken = True
            continue
        if broken:
            broken = False
            if kind == "sign" and frame.left and not frame.targets:
                pass  # name and sign on two lines
            elif frame.kind == "{" and kind == "operator":
                pass
            else:
                yield from _loose(frame)
                frame.clear()
        if kind == "sign":
            sign = m[0]
            if frame.targets and frame.typed and sign == "=":
                frame.typed = False
            elif frame.targets and frame.bare and sign == "=":
                frame.targets, frame.index = [frame.owner() | words(frame.bare)], 0
            elif frame.left:
                names = [n for n, _ in frame.left] if frame.listed and sign == "=" else [frame.left[-1][0]]
                frame.targets, frame.index, frame.typed = [frame.lender | words(n) for n in names], 0, sign == ":"
                frame.left = []
            frame.bare = None
        elif kind == "string":
            if frame.targets:
                yield frame.owner(), _inside(m)
                frame.bare = None
            else:
                if not frame.listed:
                    yield from _loose(frame)
                frame.left.append((m[0].strip("rRbBuUfF\"'`"), _inside(m)))
        elif kind in ("name", "number"):
            if frame.targets:
                if m[0] in JOINING:
                    frame.bare = None
                elif frame.bare:
                    frame.targets, frame.left = [], [(m[0], None)]  # prose
                else:
                    frame.bare = m[0]
            else:
                if not frame.listed:
                    yield from _loose(frame)
                frame.left.append((m[0], None))
        elif kind == "open":
            if m[0] == "[" and frame.left and not frame.targets and not frame.listed and frame.left[-1][1] is None:
                frames.append(_Frame("[]", frozenset()))  # a subscript belongs to the name
            else:
                frames.append(_Frame(m[0], frame.owner()))
        elif kind == "close":
            if len(frames) > 1:
                inner = frames.pop()
                if inner.kind == "[]" and frames[-1].left:
                    frames[-1].left[-1] = (".".join([frames[-1].left[-1][0], *(n for n, _ in inner.left)]), None)
                else:
                    yield from _loose(inner)
                    frames[-1].bare = None
        elif kind == "comma":
            if frame.kind == "" and m[0] == "," and (frame.left or len(frame.targets) > 1):
                frame.listed, frame.index, frame.bare = True, frame.index + 1, None
            elif frame.kind != "[]":
                yield from _loose(frame)
                frame.clear()
        elif kind == "operator":
            frame.bare = None
        else:
            frame.bare = frame.bare if frame.targets and m[0] in "@$-/~^*" else None
    for frame in frames:
        yield from _loose(frame)


def _loose(frame: _Frame) -> Iterator[Pair]:
    """Strings of a bracket that turned out to be no keys: members of the value that opened it."""
    if frame.lender and not frame.targets:
        yield from ((frame.lender, span) for _, span in frame.left if span)
    frame.left = [] if not frame.listed else frame.left


def markup_pairs(text: str, words: Callable[[str], Words]) -> Iterator[Pair]:
    """Attributes by their own name, ``value`` attributes by the key, name or id beside them, and CDATA by its element."""
    if "<" not in text:
        return
    for tag in TAG.finditer(text):
        if "=" not in tag[0]:
            continue
        found = {}
        for a in ATTRIBUTE.finditer(text, tag.start(), tag.end()):
            found.setdefault(a[1].lower(), a)
            yield words(a[1]), a.span(2 if a[2] is not None else 3)
        value = found.get("value")
        for name in ("key", "name", "id"):
            if value and name in found:
                yield words(found[name][2] or found[name][3] or ""), value.span(2 if value[2] is not None else 3)
    for m in CDATA.finditer(text, 0, text.rfind("]]>") + 3) if "CDATA" in text else ():  # up to there each is closed
        yield words(m[1]), m.span(2)


def block_pairs(text: str, words: Callable[[str], Words]) -> Iterator[Pair]:
    """Lines of block scalars (``name: |``), each by its key."""
    at = 0
    while m := BLOCK.search(text, at):
        at, depth = m.end(), None
        while at < len(text) and (line := LINE.match(text, at)):
            if line[2]:
                depth = len(line[1]) if depth is None else depth
                if len(line[1]) <= len(m[1]) or len(line[1]) < depth:
                    break
                yield words(m[2]), line.span(2)
            at = line.end()


def pairs(text: str, words: Callable[[str], Words]) -> Iterator[Pair]:
    """``(words, span)`` of every literal; ``words(name)`` are those parts of a name that count, so that nested names stay short."""
    for read in (program_pairs, markup_pairs, block_pairs):
        yield from read(text, words)
