"""The expression language of band and layer math, compiled to Spark columns.

From weakest to strongest: one comparison, sums, products, a sign, a power. A
sign is weaker than a power on its left and allowed on its right: -2^2 is -4 and
2^-1 is 0.5. Names are case-insensitive. Comparisons give 1 or 0.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from cubara.functions import nodata as N

_LEXEME = re.compile(r"\s*(?:(?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<op><=|>=|==|!=|[-+*/^<>(),]))")

_COMPARE: dict[str, Callable] = {
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
}
FUNCTIONS: dict[str, tuple[int, Callable]] = {
    "abs": (1, F.abs),
    "sqrt": (1, F.sqrt),
    "ln": (1, N.logarithm),
    "log10": (1, lambda x: N.logarithm(x, base_ten=True)),
    "exp": (1, F.exp),
    "sin": (1, F.sin),
    "cos": (1, F.cos),
    "min": (2, lambda a, b: F.least(N.known(a), N.known(b))),
    "max": (2, lambda a, b: F.greatest(N.known(a), N.known(b))),
    "pow": (2, N.power),
    "atan2": (2, F.atan2),
    "mask": (2, lambda x, c: N.mask(x, N.known(c))),
    "clamp": (3, N.clamp),
}


class ExpressionError(ValueError):
    pass


@dataclass(frozen=True)
class Node:
    """A number, a name or an operation on nodes."""

    kind: str
    value: object = None
    args: tuple[Node, ...] = ()

    def names(self) -> list[str]:
        """Inputs in use, each once, in order."""
        found = [self.value] if self.kind == "name" else []
        for a in self.args:
            found += a.names()
        return list(dict.fromkeys(found))

    def column(self, inputs: Mapping[str, Column]) -> Column:
        if self.kind == "num":
            return F.lit(float(self.value))
        if self.kind == "name":
            return inputs[self.value]
        a = [x.column(inputs) for x in self.args]
        if self.kind == "neg":
            return -a[0]
        if self.kind == "call":
            return FUNCTIONS[self.value][1](*a)
        if self.value in _COMPARE:
            return _COMPARE[self.value](N.known(a[0]), N.known(a[1])).cast("double")
        return {"+": lambda: a[0] + a[1], "-": lambda: a[0] - a[1], "*": lambda: a[0] * a[1], "/": lambda: N.divide(*a), "^": lambda: N.power(*a)}[self.value]()


def _lexemes(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _LEXEME.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected {text[at:].lstrip()[:1]!r} in {text!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Parser:
    #: Binding powers of binary operators; comparisons don't chain.
    _POWER = {**dict.fromkeys(_COMPARE, 1), "+": 2, "-": 2, "*": 3, "/": 3, "^": 5}
    _SIGN = 4

    def __init__(self, text: str, names: Mapping[str, str]):
        self.text, self.rest, self.names = text, _lexemes(text)[::-1], names

    def peek(self) -> str:
        return self.rest[-1][1] if self.rest else ""

    def take(self, want: str | None = None) -> tuple[str, str]:
        if not self.rest:
            raise ExpressionError(f"{self.text!r} ends too soon" + (f": {want!r} expected" if want else ""))
        got = self.rest.pop()
        if want is not None and got[1] != want:
            raise ExpressionError(f"{want!r} expected instead of {got[1]!r} in {self.text!r}")
        return got

    def parse(self, above: int = 0) -> Node:
        left = self.operand()
        while (power := self._POWER.get(self.peek(), 0)) > above and self.rest[-1][0] == "op":
            op = self.take()[1]
            # A power's right side takes signs and further powers; a comparison's takes no comparison.
            right = self.parse(self._SIGN - 1) if op == "^" else self.parse(power)
            left = Node("binary", op, (left, right))
            if op in _COMPARE and self.peek() in _COMPARE:
                raise ExpressionError(f"comparisons don't chain in {self.text!r}")
        return left

    def operand(self) -> Node:
        kind, word = self.take()
        if kind == "num":
            return Node("num", float(word))
        if word in ("-", "+"):
            inner = self.parse(self._SIGN)
            return Node("neg", None, (inner,)) if word == "-" else inner
        if word == "(":
            inner = self.parse()
            self.take(")")
            return inner
        if kind != "name":
            raise ExpressionError(f"unexpected {word!r} in {self.text!r}")
        if self.peek() == "(":
            return self.call(word)
        if word.lower() not in self.names:
            raise ExpressionError(f"unknown name {word!r}: there are {', '.join(self.names.values())}")
        return Node("name", self.names[word.lower()])

    def call(self, word: str) -> Node:
        name = word.lower()
        if name not in FUNCTIONS:
            raise ExpressionError(f"unknown function {word!r}: there are {', '.join(FUNCTIONS)}")
        self.take("(")
        args = [self.parse()]
        while self.peek() == ",":
            self.take()
            args.append(self.parse())
        self.take(")")
        if len(args) != FUNCTIONS[name][0]:
            raise ExpressionError(f"{name} takes {FUNCTIONS[name][0]} values, not {len(args)}")
        return Node("call", name, tuple(args))


def parse(text: str, names: list[str]) -> Node:
    """The tree of an expression over the given names."""
    parser = _Parser(text, {n.lower(): n for n in names})
    tree = parser.parse()
    if parser.rest:
        raise ExpressionError(f"unexpected {parser.peek()!r} after the end in {text!r}")
    return tree


def compile_expression(text: str, inputs: Mapping[str, Column], strict: bool = False, finite: bool = True) -> Column:
    """The expression over columns; NULL, NaN and infinite results are NULL. strict: NULL too where any used input is. Not finite: NaN and infinities stay as they are."""
    tree = parse(text, list(inputs))
    value = tree.column(inputs).cast("double")
    value = N.nd(value) if finite else value
    if strict:
        for name in tree.names():
            value = F.when(inputs[name].isNotNull(), value)
    return value


#: Expressions that apply where their names exist.
PRESETS = {
    "True color": ["b04", "b03", "b02"],
    "False color": ["b08", "b04", "b03"],
    "NDVI": ["(b08 - b04) / (b08 + b04)"],
    "NDWI": ["(b03 - b08) / (b03 + b08)"],
    "Dual-pol SAR (dB)": ["20 * log10(vv)", "20 * log10(vh)", "20 * log10(vv / vh)"],
    "OLCI": ["oa08_radiance", "oa06_radiance", "oa04_radiance"],
}


def presets(names: list[str]) -> list[str]:
    """The presets all of whose expressions parse over these names."""

    def fits(expressions: list[str]) -> bool:
        try:
            for e in expressions:
                parse(e, names)
        except ExpressionError:
            return False
        return True

    return [k for k, v in PRESETS.items() if fits(v)]


def identifier(path: str, taken: Mapping[str, int] | set[str] = frozenset(), index: int = 0) -> str:
    """A name for the expression language from a variable's path: its leaf, `Band 3` as b3, other characters as _."""
    leaf = path.rstrip("/").rpartition("/")[2].lower()
    if m := re.fullmatch(r"band\s*(\d+)", leaf):
        name = f"b{m[1]}"
    else:
        name = re.sub(r"[^a-z0-9_]", "_", leaf).strip("_")
        if name[:1].isdigit():
            name = "b" + name
    name = name or "v"
    return f"{name}_{index}" if name in taken else name


def letter(k: int) -> str:
    """The k-th layer's name: a to z, then l27, l28 and so on."""
    return chr(97 + k) if k < 26 else f"l{k + 1}"


def wind_speed(u: str, v: str) -> str:
    return f"sqrt(({u})^2 + ({v})^2)"
