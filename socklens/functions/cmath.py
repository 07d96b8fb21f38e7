"""Field math and field filters written as C expressions.

A math text is an operator suffix put after the field (``/1000``, ``>> 3``,
``* 8 + 1``); a filter is a condition over the field's own name
(``RTT < 1 || RTT > 60000``). Both mean what they mean in C: unsigned
arithmetic that wraps, 8- and 16-bit operands promoted to int, truncating
division. Arithmetic precedence is the same in C and Python, so Python's
``ast`` gives the tree and this module maps each node to a Spark column.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from socklens.functions.bits import pattern64, unsigned64

# C integer types: (bits, signed), ranked as in the usual conversions
_INT, _UINT, _LONG, _ULONG = (32, True), (32, False), (64, True), (64, False)
_RANK = [_INT, _UINT, _LONG, _ULONG]
_ARITHMETIC = re.compile(r"^[\s0-9a-fA-Fx+\-*/%<>&|^()]+$")


@dataclass(frozen=True)
class _Typed:
    """A C value: its type, and a Python int (literal) or a Column.

    Columns hold the mathematical value: BIGINT, or DECIMAL(20,0) for the
    unsigned 64-bit type.
    """

    ctype: tuple
    value: object

    @property
    def is_literal(self) -> bool:
        return isinstance(self.value, int)


def _wrap_int(value: int, ctype) -> int:
    bits, signed = ctype
    value %= 1 << bits
    return value - (1 << bits) if signed and value >> (bits - 1) else value


def _as_column(operand: _Typed) -> Column:
    if not operand.is_literal:
        return operand.value
    if operand.ctype == _ULONG:
        return F.lit(str(operand.value)).cast("decimal(20,0)")
    return F.lit(operand.value).cast("bigint")


def _pattern(operand: _Typed, ctype) -> Column:
    """Operand converted to ``ctype``, as a BIGINT bit pattern."""
    if operand.is_literal:
        return F.lit(_wrap_int(_wrap_int(operand.value, ctype), _LONG)).cast("bigint")
    column = operand.value
    if operand.ctype == _ULONG:
        column = pattern64(column)
    return _wrap32(column, ctype) if ctype[0] == 32 else column


def _wrap32(column: Column, ctype) -> Column:
    low = column.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
    return F.shiftright(F.shiftleft(low, 32), 32) if ctype[1] else low


def _convert(operand: _Typed, ctype) -> _Typed:
    """Usual arithmetic conversion of one operand."""
    if operand.ctype == ctype:
        return operand
    if operand.is_literal:
        return _Typed(ctype, _wrap_int(operand.value, ctype))
    column = _pattern(operand, ctype)
    return _Typed(ctype, unsigned64(column) if ctype == _ULONG else column)


def _literal(node: ast.Constant, text: str) -> _Typed:
    if type(node.value) is not int:
        raise ValueError("only integer constants are allowed in field math")
    digits = text[node.col_offset : node.end_col_offset].lower()
    if len(digits) > 1 and digits[0] == "0" and digits[1] != "x":
        raise ValueError(f"octal constant in field math: {digits}")
    choices = [_INT, _UINT, _LONG, _ULONG] if digits.startswith("0x") else [_INT, _LONG]
    for ctype in choices:
        if node.value < 1 << (ctype[0] - ctype[1]):
            return _Typed(ctype, node.value)
    raise ValueError(f"constant too large: {digits}")


def _wide_sum(op, a: Column, b: Column) -> Column:
    """+, -, * of 64-bit values without overflow, reduced modulo 2^64."""
    if isinstance(op, ast.Mult):
        # split one factor so that no partial product leaves DECIMAL(38,0)
        modulus = F.lit(str(2**64)).cast("decimal(38,0)")
        low = F.pmod(b, F.lit(str(2**32)).cast("decimal(20,0)"))
        high = (b - low) / F.lit(2**32).cast("decimal(20,0)")
        wide = F.pmod(a.cast("decimal(20,0)") * high.cast("decimal(18,0)"), modulus)
        wide = F.pmod(wide.cast("decimal(20,0)") * F.lit(2**32).cast("decimal(11,0)"), modulus)
        return F.pmod(wide.cast("decimal(21,0)") + (a.cast("decimal(20,0)") * low.cast("decimal(11,0)")), modulus)
    wide = a.cast("decimal(21,0)") + b if isinstance(op, ast.Add) else a.cast("decimal(21,0)") - b
    return F.pmod(wide, F.lit(str(2**64)).cast("decimal(21,0)"))


def _binary(op, left: _Typed, right: _Typed) -> _Typed:
    if isinstance(op, (ast.LShift, ast.RShift)):
        return _shift(op, left, right)
    ctype = max(left.ctype, right.ctype, key=_RANK.index)
    left, right = _convert(left, ctype), _convert(right, ctype)
    if isinstance(op, (ast.Div, ast.Mod)) and right.is_literal and right.value == 0:
        raise ValueError("division by zero in field math")
    if left.is_literal and right.is_literal:
        return _Typed(ctype, _wrap_int(_fold(op, left.value, right.value), ctype))

    if isinstance(op, (ast.BitAnd, ast.BitOr, ast.BitXor)):
        a, b = _pattern(left, ctype), _pattern(right, ctype)
        method = {ast.BitAnd: "bitwiseAND", ast.BitOr: "bitwiseOR", ast.BitXor: "bitwiseXOR"}[type(op)]
        return _from_pattern(getattr(a, method)(b), ctype)

    a, b = _as_column(left), _as_column(right)
    if isinstance(op, (ast.Div, ast.Mod)):
        rest = F.try_mod(a, b)  # zero divisor gives NULL
        if isinstance(op, ast.Mod):
            return _Typed(ctype, rest)
        if ctype == _ULONG:
            return _Typed(ctype, F.try_divide(a - rest, b).cast("decimal(20,0)"))
        return _Typed(ctype, F.call_function("div", a - rest, F.nullif(b, F.lit(0).cast("bigint"))))
    if ctype[0] == 64:
        wide = _wide_sum(op, *(_as_column(_convert(x, _ULONG)) for x in (left, right)))
        wide = wide.cast("decimal(20,0)")
        return _Typed(ctype, wide if ctype == _ULONG else pattern64(wide))
    # 32-bit values fit BIGINT; a product may reach 2^64, so it is built from halves
    if isinstance(op, ast.Mult):
        high, low = F.shiftright(b, 16), b.bitwiseAND(F.lit(0xFFFF).cast("bigint"))
        product = F.shiftleft(_wrap32(a * high, _UINT), 16) + a * low
    else:
        product = a + b if isinstance(op, ast.Add) else a - b
    return _Typed(ctype, _wrap32(product, ctype))


def _from_pattern(column: Column, ctype) -> _Typed:
    if ctype == _ULONG:
        return _Typed(ctype, unsigned64(column))
    return _Typed(ctype, _wrap32(column, ctype) if ctype[0] == 32 else column)


def _shift(op, left: _Typed, right: _Typed) -> _Typed:
    if not right.is_literal or not 0 <= right.value < left.ctype[0]:
        raise ValueError("shift distance must be a constant inside the operand's width")
    if left.is_literal:
        moved = left.value << right.value if isinstance(op, ast.LShift) else left.value >> right.value
        return _Typed(left.ctype, _wrap_int(moved, left.ctype))
    column = _pattern(left, left.ctype)
    if isinstance(op, ast.LShift):
        moved = F.shiftleft(column, right.value)
    else:
        moved = (F.shiftright if left.ctype[1] else F.shiftrightunsigned)(column, right.value)
    return _from_pattern(moved, left.ctype)


def _fold(op, a: int, b: int) -> int:
    if isinstance(op, ast.Add):
        return a + b
    if isinstance(op, ast.Sub):
        return a - b
    if isinstance(op, ast.Mult):
        return a * b
    if isinstance(op, (ast.Div, ast.Mod)):
        quotient = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
        return quotient if isinstance(op, ast.Div) else a - quotient * b
    return {ast.BitAnd: a & b, ast.BitOr: a | b, ast.BitXor: a ^ b}[type(op)]


_OPS = (ast.Add, ast.Sub, ast.Mult, ast.Div, ast.Mod, ast.LShift, ast.RShift, ast.BitAnd, ast.BitOr, ast.BitXor)


def _value(node: ast.AST, text: str, operand: _Typed, name: str) -> _Typed:
    if isinstance(node, ast.BinOp) and isinstance(node.op, _OPS):
        return _binary(
            node.op, _value(node.left, text, operand, name), _value(node.right, text, operand, name)
        )
    if isinstance(node, ast.Constant):
        return _literal(node, text)
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
        # as in C: zero minus the promoted operand
        return _binary(ast.Sub(), _Typed(_INT, 0), _value(node.operand, text, operand, name))
    if isinstance(node, ast.Name) and node.id.lower() == name.lower():
        return operand
    raise ValueError(f"not allowed in a field expression: {text.strip()!r}")


def _parse(text: str) -> ast.AST:
    try:
        return ast.parse(text, mode="eval").body
    except SyntaxError:
        raise ValueError(f"not an expression: {text.strip()!r}") from None


def _operand(column: Column, bits: int) -> _Typed:
    """A field value as C promotes it."""
    if bits == 64:
        return _Typed(_ULONG, column.cast("decimal(20,0)"))
    return _Typed(_INT if bits <= 16 else _UINT, column.cast("bigint"))


def _truncate(result: _Typed, bits: int) -> Column:
    """Store a value into an unsigned field of the given width."""
    if bits == 64:
        return _as_column(_convert(result, _ULONG))
    column = _pattern(result, _LONG)
    return column.bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))


def math(column: Column, bits: int, suffix: str) -> Column:
    """``(column) suffix`` stored back into an unsigned field of ``bits``.

    BIGINT, or DECIMAL(20,0) for 64-bit fields.
    """
    if not suffix.strip():
        return column
    if not _ARITHMETIC.match(suffix) or "//" in suffix or "**" in suffix:
        raise ValueError(f"not a field math suffix: {suffix!r}")
    text = "x " + suffix.strip()
    return _truncate(_value(_parse(text), text, _operand(column, bits), "x"), bits)


# -- filters ---------------------------------------------------------------

_COMPARE = {
    ast.Lt: "__lt__", ast.LtE: "__le__", ast.Gt: "__gt__", ast.GtE: "__ge__",
    ast.Eq: "__eq__", ast.NotEq: "__ne__",
}


_TOKEN = re.compile(
    r"""\s*(?:(?P<text>"[^"\\]*"|'[^'\\]*')|(?P<number>0[xX][0-9a-fA-F]+|[0-9]+)|(?P<name>[A-Za-z_]\w*)"""
    r"""|(?P<sign>&&|\|\||<<|>>|[<>=!]=|[-+*/%<>&|^!()]))"""
)
# C's logical signs in the grammar the text is parsed by; ! binds like ~ does
_SPELLED = {"&&": " and ", "||": " or ", "!": "~"}


def _tokens(text: str, name: str) -> str:
    """The condition with C's logical signs spelled out; quoted texts stay as they are."""
    out, at, text = [], 0, text.strip()
    while at < len(text):
        found = _TOKEN.match(text, at)
        if not found or (found["name"] and found["name"].lower() != name.lower()):
            raise ValueError(f"not a C condition: {text!r}")
        out.append(_SPELLED.get(found["sign"], found[0].strip()))
        at = found.end()
    # a sign never runs into the one before: "a & &b" and "a / /b" stay errors
    return " ".join(out)


def condition(column: Column, bits: int, name: str, text: str, is_text: bool = False) -> Column:
    """Boolean column of a C condition over one field.

    ``name`` is the only name in scope. Text fields (task, addresses) can be
    compared with quoted strings.
    """
    source = _tokens(text, name)
    operand = _Typed(None, column) if is_text else _operand(column, bits)
    return _boolean(_parse(source), source, operand, name, is_text)


def _parenthesised(node: ast.AST, text: str) -> bool:
    before, after = text[: node.col_offset].rstrip(), text[node.end_col_offset :].lstrip()
    return before.endswith("(") and after.startswith(")")


def _boolean(node, text, operand, name, is_text) -> Column:
    if isinstance(node, ast.BoolOp):
        parts = [_boolean(v, text, operand, name, is_text) for v in node.values]
        out = parts[0]
        for part in parts[1:]:
            out = out & part if isinstance(node.op, ast.And) else out | part
        return out
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Invert):
        return ~_boolean(node.operand, text, operand, name, is_text)
    if isinstance(node, ast.Compare):
        if len(node.ops) != 1 or type(node.ops[0]) not in _COMPARE:
            raise ValueError(f"chained comparison in filter: {text!r}")
        sides = [node.left, node.comparators[0]]
        for side in sides:
            # C compares before it masks, so a mask needs its parentheses
            masks = isinstance(side, ast.BinOp) and isinstance(side.op, (ast.BitAnd, ast.BitOr, ast.BitXor))
            if masks and not _parenthesised(side, text):
                raise ValueError(f"put parentheses around the mask in filter: {text!r}")
        method = _COMPARE[type(node.ops[0])]
        if is_text:
            a, b = (_text_value(s, text, operand, name) for s in sides)
        else:
            left, right = (_value(s, text, operand, name) for s in sides)
            ctype = max(left.ctype, right.ctype, key=_RANK.index)
            a, b = _as_column(_convert(left, ctype)), _as_column(_convert(right, ctype))
        return getattr(a, method)(b)
    if is_text:
        raise ValueError(f"a text field needs a comparison: {text!r}")
    value = _value(node, text, operand, name)
    return _as_column(value) != F.lit(0)


def _text_value(node, text, operand, name) -> Column:
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        return F.lit(node.value)
    if isinstance(node, ast.Name) and node.id.lower() == name.lower():
        return operand.value
    raise ValueError(f"not allowed in a filter on text: {text!r}")
