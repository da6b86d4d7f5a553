"""Parser-expression rules as Java regular expressions.

A rule is written with Word, Literal, CaselessLiteral, Optional, + (sequence),
| (first match), ^ (longest match), .suppress() and lineStart or lineEnd. It is
read as a Python expression tree of just these and never evaluated. Tokens skip
white space before them and never give back what they took, so every token
becomes possessive and every choice atomic. A second lineEnd can't match at the
end of a text; strict=False drops it.
"""

from __future__ import annotations

import ast
import functools

SPACE = r"[ \n\t\r]*+"
SETS = {"printables": "!-~", "nums": "0-9", "alphas": "A-Za-z", "alphanums": "0-9A-Za-z", "hexnums": "0-9A-Fa-f"}
START, END = r"\A", r"[ \t\r]*+(?:\n|\z)"
NEVER = r"(?!)"


class RuleError(ValueError):
    """A rule that isn't of the language."""


def quote(text: str) -> str:
    return "\\Q" + text + "\\E"


def _charset(node: ast.expr) -> str:
    if isinstance(node, ast.Name) and node.id in SETS:
        return SETS[node.id]
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        return "".join(f"\\x{{{ord(c):x}}}" for c in node.value)
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
        return _charset(node.left) + _charset(node.right)
    raise RuleError("a Word needs a set of characters")


def _word(call: ast.Call) -> str:
    if len(call.args) != 1:
        raise RuleError("Word takes one set")
    n = {k.arg: k.value.value for k in call.keywords if isinstance(k.value, ast.Constant)}
    least, most = n.get("exact") or n.get("min", 1), n.get("exact") or n.get("max")
    times = f"{{{least}}}" if least == most else f"{{{least},{most or ''}}}+"
    return f"[{_charset(call.args[0])}]" + ("++" if (least, most) == (1, None) else times)


def _token(body: str) -> str:
    return SPACE + body


class _Reader:
    def __init__(self, strict: bool):
        self.strict = strict

    def read(self, node: ast.expr) -> str:
        if isinstance(node, ast.Constant) and isinstance(node.value, str):
            return self.literal(node.value, False)
        if isinstance(node, ast.Name) and node.id in ("lineStart", "lineEnd"):
            return "" if node.id == "lineStart" or not self.strict else r"[ \t\r]*+\n"
        if isinstance(node, ast.BinOp):
            sides = self.read(node.left), self.read(node.right)
            if isinstance(node.op, ast.Add):
                return "".join(sides)
            if isinstance(node.op, ast.BitOr):
                return f"(?>{sides[0]}|{sides[1]})"
            if isinstance(node.op, ast.BitXor):
                # Longest first: of two atomic branches the longer one is tried where it is a longer literal.
                order = sorted(sides, key=len, reverse=True)
                return f"(?>{order[0]}|{order[1]})"
        if isinstance(node, ast.Call):
            if isinstance(node.func, ast.Attribute) and node.func.attr == "suppress" and not node.args:
                return self.read(node.func.value)
            name = node.func.id if isinstance(node.func, ast.Name) else ""
            if name == "Word":
                return _token(_word(node))
            if name in ("Literal", "CaselessLiteral") and len(node.args) == 1 and isinstance(node.args[0], ast.Constant):
                return self.literal(node.args[0].value, name == "CaselessLiteral")
            if name == "Optional" and len(node.args) == 1:
                return f"(?>{self.read(node.args[0])})?+"
        raise RuleError(f"not part of the rule language: {ast.dump(node)[:60]}")

    @staticmethod
    def literal(text: str, caseless: bool) -> str:
        if text and not text.strip(" \n\t\r"):
            return NEVER  # its white space is skipped before it can be seen
        return _token(f"(?i:{quote(text)})" if caseless else quote(text))


@functools.lru_cache(maxsize=256)
def compile_rule(rule: str, strict: bool = True) -> str:
    """The regular expression that finds a match exactly where the rule, between line start and line end, parses."""
    try:
        tree = ast.parse(rule.strip(), mode="eval").body
    except SyntaxError as e:
        raise RuleError(f"{rule!r}: {e.msg}") from e
    return START + _Reader(strict).read(tree) + END
