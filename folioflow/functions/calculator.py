"""Page-document functions as column expressions: sampled, exponential, stitching, and calculator programs.

A calculator program is run on a stack of columns while the plan is built, so Catalyst sees one
expression. Counts of stack operators must be constants; both branches of a choice must leave stacks of
the same depth. A program that breaks these rules gives the lower ends of the ranges.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamped(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def exponential(x: Column, c0: list[float], c1: list[float], n: float) -> list[Column]:
    return [F.lit(a) + F.pow(x, F.lit(n)) * (b - a) for a, b in zip(c0, c1, strict=True)]


def sampled(x: Column, samples: list[float], domain: tuple[float, float], decode: tuple[float, float]) -> Column:
    """One input: samples are in [0, 1], between them values are interpolated."""
    at = (clamped(x, *domain) - domain[0]) / (domain[1] - domain[0]) * (len(samples) - 1)
    low = F.least(F.floor(at), F.lit(len(samples) - 1)).cast("int")
    table = F.array(*map(F.lit, map(float, samples)))
    a, b = F.get(table, low), F.get(table, F.least(low + 1, F.lit(len(samples) - 1)))
    return decode[0] + (a + (b - a) * (at - low)) * (decode[1] - decode[0])


def stitched(x: Column, parts: list, bounds: list[float], domain: tuple[float, float], encode: list[tuple[float, float]]) -> Column:
    """The part (a function of a column) whose stretch of the domain holds the input."""
    held = clamped(x, *domain)
    edges = [domain[0], *bounds, domain[1]]
    out = None
    for i in reversed(range(len(parts))):
        low, high, (a, b) = edges[i], edges[i + 1], encode[i]
        inner = F.lit(float(a)) if high == low else a + (held - low) * (b - a) / (high - low)
        value = parts[i](inner)
        out = value if out is None else F.when(held < bounds[i], value).otherwise(out)
    return out


class _Wrong(Exception):
    """The program can't be run."""


def _parsed(source: str) -> list:
    stack: list[list] = [[]]
    for token in re.findall(r"[{}]|[^\s{}]+", source):
        if token == "{":
            stack.append([])
        elif token == "}":
            if len(stack) < 2:
                raise _Wrong
            body = stack.pop()
            stack[-1].append(body)
        else:
            stack[-1].append(token)
    if len(stack) != 1 or len(stack[0]) != 1:
        raise _Wrong
    return stack[0][0]


def _whole(x: Column) -> Column:
    return x.cast("long")


def _double(x: Column) -> Column:
    return x.cast("double")


_ZERO = 0.0
_TWO_NUMBERS = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": lambda a, b: F.when(b == 0, F.lit(_ZERO)).otherwise(a / F.when(b != 0, b)),
    "idiv": lambda a, b: F.when(_whole(b) == 0, F.lit(_ZERO)).otherwise(_double(F.floor(F.abs(_whole(a) / F.when(_whole(b) != 0, _whole(b))))) * F.signum(a * b)),
    "mod": lambda a, b: F.when(_whole(b) == 0, F.lit(_ZERO)).otherwise(_double(_whole(a) % F.when(_whole(b) != 0, _whole(b)))),
    "exp": lambda a, b: F.pow(a, b),
    "atan": lambda a, b: F.pmod(F.degrees(F.atan2(a, b)), F.lit(360.0)),
}
_ONE_NUMBER = {
    "neg": lambda a: -a,
    "abs": F.abs,
    "ceiling": lambda a: _double(F.ceil(a)),
    "floor": lambda a: _double(F.floor(a)),
    "round": lambda a: F.round(a),
    "truncate": lambda a: _double(_whole(a)),
    "cvi": lambda a: _double(_whole(a)),
    "cvr": lambda a: a,
    "sqrt": lambda a: F.sqrt(F.greatest(F.lit(_ZERO), a)),
    "sin": lambda a: F.sin(F.radians(a)),
    "cos": lambda a: F.cos(F.radians(a)),
    "ln": lambda a: F.log(F.greatest(a, F.lit(1e-300))),
    "log": lambda a: F.log10(F.greatest(a, F.lit(1e-300))),
}
_COMPARED = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b}
_LOGIC = {"and": (lambda a, b: a & b, "bitwiseAND"), "or": (lambda a, b: a | b, "bitwiseOR"), "xor": (lambda a, b: a != b, "bitwiseXOR")}

#: A value on the stack: its column, whether it is a truth value, and its number if it is a constant.
_Value = tuple[Column, bool, float | None]


def _run(body: list, stack: list[_Value]) -> list[_Value]:
    def pop(truth: bool | None = False) -> Column:
        if not stack:
            raise _Wrong
        value, is_truth, _ = stack.pop()
        if truth is not None and truth != is_truth:
            raise _Wrong
        return value

    def count() -> int:
        if not stack or stack[-1][2] is None:
            raise _Wrong
        return int(stack.pop()[2])

    i = 0
    while i < len(body):
        token = body[i]
        i += 1
        if isinstance(token, list):
            second = body[i] if i < len(body) and isinstance(body[i], list) else None
            i += second is not None
            if i >= len(body) or body[i] != ("if" if second is None else "ifelse"):
                raise _Wrong
            i += 1
            test = pop(True)
            yes, no = _run(token, list(stack)), _run(second, list(stack)) if second is not None else list(stack)
            if len(yes) != len(no) or any(a[1] != b[1] for a, b in zip(yes, no, strict=True)):
                raise _Wrong
            stack[:] = [a if a is b else (F.when(test, a[0]).otherwise(b[0]), a[1], None) for a, b in zip(yes, no, strict=True)]
        elif token in _TWO_NUMBERS:
            b, a = pop(), pop()
            stack.append((_TWO_NUMBERS[token](a, b), False, None))
        elif token in _ONE_NUMBER:
            stack.append((_ONE_NUMBER[token](pop()), False, None))
        elif token in _COMPARED:
            truth = bool(stack and stack[-1][1]) and token in ("eq", "ne")
            b, a = pop(truth), pop(truth)
            stack.append((_COMPARED[token](a, b), True, None))
        elif token in _LOGIC:
            truth = bool(stack and stack[-1][1])
            b, a = pop(truth), pop(truth)
            stack.append((_LOGIC[token][0](a, b), True, None) if truth else (_double(getattr(_whole(a), _LOGIC[token][1])(_whole(b))), False, None))
        elif token == "not":
            truth = bool(stack and stack[-1][1])
            a = pop(truth)
            stack.append((~a, True, None) if truth else (_double(-_whole(a) - 1), False, None))
        elif token == "bitshift":
            by = count()
            a = _whole(pop())
            stack.append((_double(F.shiftleft(a, by) if by >= 0 else F.shiftright(a, -by)), False, None))
        elif token in ("true", "false"):
            stack.append((F.lit(token == "true"), True, None))
        elif token == "pop":
            pop(None)
        elif token == "exch":
            if len(stack) < 2:
                raise _Wrong
            stack[-2:] = stack[-1], stack[-2]
        elif token == "dup":
            if not stack:
                raise _Wrong
            stack.append(stack[-1])
        elif token == "copy":
            n = count()
            if not 0 <= n <= len(stack):
                raise _Wrong
            stack += stack[len(stack) - n :]
        elif token == "index":
            n = count()
            if not 0 <= n < len(stack):
                raise _Wrong
            stack.append(stack[-1 - n])
        elif token == "roll":
            by, n = count(), count()
            if not 0 <= n <= len(stack):
                raise _Wrong
            if n:
                part = stack[-n:]
                stack[-n:] = part[-(by % n) :] + part[: n - by % n] if by % n else part
        else:
            try:
                stack.append((F.lit(float(token)), False, float(token)))
            except ValueError:
                raise _Wrong from None
    return stack


def calculator(source: str, inputs: list[Column], domain: list[tuple[float, float]], ranges: list[tuple[float, float]]) -> list[Column]:
    """The outputs of a calculator program in braces."""
    try:
        start: list[_Value] = [(clamped(_double(x), *d), False, None) for x, d in zip(inputs, domain, strict=True)]
        found = _run(_parsed(source), start)
        if len(found) < len(ranges) or any(v[1] for v in found[-len(ranges) :]):
            raise _Wrong
        return [clamped(F.coalesce(v[0], F.lit(float(r[0]))), *r) for v, r in zip(found[-len(ranges) :], ranges, strict=True)]
    except _Wrong:
        return [F.lit(float(r[0])) for r in ranges]
