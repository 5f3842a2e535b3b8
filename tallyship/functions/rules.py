"""User rules compiled to columns.

A rule is an expression of the small language that policies use: variables, literals,
comparison, arithmetic, ``&&``, ``||``, ``!``, ``? :``, ``in``, indexing, ``has()``, string
methods and host functions. It compiles once, on the driver, to a pair of columns
(value, failed); the plan then holds plain expressions. A value that SQL would make null
by accident (a missing map key, an omitted field) is a failure, and a rule that fails or
is no boolean ends its list undecided, which each kind of policy reads in its safe way.
"""

from __future__ import annotations

import ast
import keyword
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyship.functions import scalars


class RuleError(ValueError):
    """A rule that is blank or cannot be read; raised when it is compiled, not when it runs."""


@dataclass(frozen=True)
class Term:
    """A compiled part: its value, whether it failed, and what is known of its type."""

    value: Column
    failed: Column
    kind: str = "any"


def _ok(value: Column, kind: str, *parts: Term) -> Term:
    failed = F.lit(False)
    for p in parts:
        failed = failed | p.failed
    return Term(value, failed, kind)


@dataclass(frozen=True)
class Scope:
    """What rules may name.

    ``nullable``: variables that are always present, null included. ``optional``:
    variables that are left out when unset, so reading one that is null fails.
    ``maps``: map columns, in which a missing key fails. ``functions``: host functions
    from terms to a term. ``kinds``: types of variables, "string" unless given.
    """

    nullable: Mapping[str, Column] = field(default_factory=dict)
    optional: Mapping[str, Column] = field(default_factory=dict)
    maps: Mapping[str, Column] = field(default_factory=dict)
    functions: Mapping[str, Callable[..., Term]] = field(default_factory=dict)
    kinds: Mapping[str, str] = field(default_factory=dict)


#: Words that rules may use as names though Python's grammar keeps them; they get a mark while it reads them.
_KEPT = "|".join(set(keyword.kwlist) - {"and", "or", "not", "in", "if", "else", "True", "False", "None"})
_MARK = "_name_"

_WORDS = {"&&": " and ", "||": " or ", "true": "True", "false": "False", "null": "None"}


def _pythonic(rule: str) -> str:
    """The rule in the spelling of Python's expressions, of which its grammar is then a part."""
    token = r"""('(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*"|&&|\|\||!=|!|\?|:|\b(?:true|false|null)\b)"""
    parts = re.split(token, rule)
    marked = (p if p[:1] in "'\"" else re.sub(rf"\b({_KEPT})\b", rf"\1{_MARK}", p) for p in parts)
    out = "".join(_WORDS.get(p, " not " if p == "!" else p) for p in marked)
    return _conditional(out)


def _outside_quotes(text: str) -> list[tuple[int, str]]:
    """Places and characters that stand in no string literal."""
    out, quote, i = [], "", 0
    while i < len(text):
        ch = text[i]
        if quote:
            i += ch == "\\"  # the next character is escaped
            quote = "" if ch == quote else quote
        elif ch in "'\"":
            quote = ch
        else:
            out.append((i, ch))
        i += 1
    return out


def _conditional(text: str) -> str:
    """``a ? b : c`` as ``(b) if (a) else (c)``: inside brackets and arguments first, then on the level of the text itself."""
    flat, depth, begin = "", 0, 0
    opened: list[int] = []  # where arguments of the outermost bracket begin
    for i, ch in _outside_quotes(text):
        if ch in "([{":
            depth += 1
            if depth == 1:
                flat += text[begin : i + 1]
                opened = [i + 1]
        elif ch == "," and depth == 1:
            opened.append(i + 1)
        elif ch in ")]}":
            depth -= 1
            if depth == 0:
                stops = [x - 1 for x in opened[1:]] + [i]
                flat += ",".join(_conditional(text[a:b]) for a, b in zip(opened, stops, strict=True))
                begin = i
    flat += text[begin:]
    depth = nested = 0
    mark = -1
    for i, ch in _outside_quotes(flat):
        depth += (ch in "([{") - (ch in ")]}")
        if depth:
            continue
        if ch == "?":
            nested += mark >= 0
            mark = i if mark < 0 else mark
        elif ch == ":" and mark >= 0:
            if not nested:
                return f"({_conditional(flat[mark + 1 : i])}) if ({flat[:mark]}) else ({_conditional(flat[i + 1 :])})"
            nested -= 1
    return flat


_COMPARE = {ast.Eq: "__eq__", ast.NotEq: "__ne__", ast.Lt: "__lt__", ast.LtE: "__le__", ast.Gt: "__gt__", ast.GtE: "__ge__"}


def _name_of(node: ast.AST) -> str:
    return ast.unparse(node).replace(_MARK, "")


class _Compiler:
    def __init__(self, scope: Scope):
        self.scope = scope

    def term(self, node: ast.AST) -> Term:
        make = getattr(self, f"_{type(node).__name__.lower()}", None)
        if make is None:
            raise RuleError(f"not a part of a rule: {ast.unparse(node)}")
        return make(node)

    def _expression(self, node: ast.Expression) -> Term:
        return self.term(node.body)

    def _constant(self, node: ast.Constant) -> Term:
        kinds = {bool: "bool", int: "int", float: "float", str: "string", type(None): "null"}
        if type(node.value) not in kinds:
            raise RuleError(f"no literal of rules: {node.value!r}")
        value = F.lit(node.value).cast("bigint") if type(node.value) is int else F.lit(node.value)
        return Term(value, F.lit(False), kinds[type(node.value)])

    def _variable(self, name: str) -> Term:
        s, kind = self.scope, self.scope.kinds.get(name, "string")
        if name in s.nullable:
            return Term(s.nullable[name], F.lit(False), kind)
        if name in s.optional:
            return Term(s.optional[name], s.optional[name].isNull(), kind)
        raise RuleError(f"unknown variable: {name}")

    def _name(self, node: ast.Name) -> Term:
        return self._variable(node.id)

    def _attribute(self, node: ast.Attribute) -> Term:
        return self._variable(_name_of(node))

    def _subscript(self, node: ast.Subscript) -> Term:
        name, key = _name_of(node.value), self.term(node.slice)
        if name not in self.scope.maps:
            raise RuleError(f"not a map: {name}")
        value = F.try_element_at(self.scope.maps[name], key.value)
        return Term(value, key.failed | value.isNull())

    def _list(self, node: ast.List) -> Term:
        parts = [self.term(x) for x in node.elts]
        return _ok(F.array(*(p.value for p in parts)), "list", *parts)

    def _boolop(self, node: ast.BoolOp) -> Term:
        """Left to right; what comes after the deciding part is not looked at, so cannot fail."""
        decides = isinstance(node.op, ast.Or)
        parts = [self._boolean(self.term(x)) for x in node.values]

        def join(a: Term, b: Term) -> Term:
            done = ~a.failed & (F.coalesce(a.value, F.lit(not decides)) == decides)
            return Term(F.when(done, F.lit(decides)).otherwise(b.value), F.when(done, F.lit(False)).otherwise(a.failed | b.failed), "bool")

        return reduce(join, parts)

    def _boolean(self, t: Term) -> Term:
        """The term, failed unless it is a boolean."""
        if t.kind in ("bool", "any"):
            return Term(t.value.cast("boolean") if t.kind == "any" else t.value, t.failed | t.value.isNull(), "bool")
        return Term(F.lit(None).cast("boolean"), F.lit(True), "bool")

    def _unaryop(self, node: ast.UnaryOp) -> Term:
        t = self.term(node.operand)
        if isinstance(node.op, ast.Not):
            t = self._boolean(t)
            return Term(~t.value, t.failed, "bool")
        if isinstance(node.op, ast.USub):
            return Term(-t.value, t.failed, t.kind)
        raise RuleError(f"no operator of rules: {ast.unparse(node)}")

    def _binop(self, node: ast.BinOp) -> Term:
        a, b = self.term(node.left), self.term(node.right)
        if isinstance(node.op, ast.Add) and "string" in (a.kind, b.kind):
            return _ok(F.concat(a.value, b.value), "string", a, b)
        tries = {ast.Add: F.try_add, ast.Sub: F.try_subtract, ast.Mult: F.try_multiply, ast.Div: lambda x, y: F.try_divide(x, y).cast("bigint"), ast.Mod: F.try_mod}
        if type(node.op) not in tries:
            raise RuleError(f"no operator of rules: {ast.unparse(node)}")
        value = tries[type(node.op)](a.value, b.value)  # overflow and division by zero are failures
        return Term(value, a.failed | b.failed | value.isNull(), "int")

    def _compare(self, node: ast.Compare) -> Term:
        if len(node.ops) != 1:
            raise RuleError(f"one comparison at a time: {ast.unparse(node)}")
        op = node.ops[0]
        if isinstance(op, (ast.In, ast.NotIn)) and (held := self.scope.maps.get(_name_of(node.comparators[0]))) is not None:
            key = self.term(node.left)
            there = F.coalesce(F.map_contains_key(held, key.value), F.lit(False))
            return _ok(there if isinstance(op, ast.In) else ~there, "bool", key)
        a, b = self.term(node.left), self.term(node.comparators[0])
        if isinstance(op, (ast.In, ast.NotIn)):
            there = F.coalesce(F.array_contains(b.value, a.value), F.lit(False)) if b.kind == "list" else F.lit(None).cast("boolean")
            bad = F.lit(b.kind != "list")
            return Term(there if isinstance(op, ast.In) else ~there, a.failed | b.failed | bad, "bool")
        if type(op) not in _COMPARE:
            raise RuleError(f"no comparison of rules: {ast.unparse(node)}")
        if isinstance(op, (ast.Eq, ast.NotEq)):
            if {a.kind, b.kind} & {"string"} and {a.kind, b.kind} & {"int", "float", "bool"}:
                same = F.lit(False)  # values of unlike types are never equal
            else:
                same = a.value.eqNullSafe(b.value)
            return _ok(same if isinstance(op, ast.Eq) else ~same, "bool", a, b)
        if {"string", "int"} <= {a.kind, b.kind} or "null" in (a.kind, b.kind):
            return Term(F.lit(None).cast("boolean"), F.lit(True), "bool")
        value = getattr(a.value, _COMPARE[type(op)])(b.value)
        return Term(value, a.failed | b.failed | value.isNull(), "bool")

    def _ifexp(self, node: ast.IfExp) -> Term:
        test, yes, no = self._boolean(self.term(node.test)), self.term(node.body), self.term(node.orelse)
        value = F.when(test.value, yes.value).otherwise(no.value)
        return Term(value, test.failed | F.when(test.value, yes.failed).otherwise(no.failed), yes.kind if yes.kind == no.kind else "any")

    def _call(self, node: ast.Call) -> Term:
        if node.keywords:
            raise RuleError("rules have no keyword arguments")
        if isinstance(node.func, ast.Attribute):
            return self._method(node)
        name = _name_of(node.func)
        if name == "has":
            return self._has(node)
        if name == "size" and len(node.args) == 1:
            t = self.term(node.args[0])
            value = F.size(t.value) if t.kind == "list" else F.length(t.value)
            return Term(value.cast("bigint"), t.failed | t.value.isNull(), "int")
        if name not in self.scope.functions:
            raise RuleError(f"unknown function: {name}")
        return self.scope.functions[name](*(self.term(a) for a in node.args))

    def _has(self, node: ast.Call) -> Term:
        arg = node.args[0] if len(node.args) == 1 else None
        if isinstance(arg, ast.Attribute):
            name = _name_of(arg)
            if name in self.scope.optional:
                return Term(self.scope.optional[name].isNotNull(), F.lit(False), "bool")
            if name in self.scope.nullable:
                return Term(F.lit(True), F.lit(False), "bool")
            parent = _name_of(arg.value)
            if parent in self.scope.maps:
                return Term(F.coalesce(F.map_contains_key(self.scope.maps[parent], F.lit(arg.attr.replace(_MARK, ""))), F.lit(False)), F.lit(False), "bool")
        raise RuleError(f"has() takes a field: {ast.unparse(node)}")

    def _method(self, node: ast.Call) -> Term:
        t, args = self.term(node.func.value), [self.term(a) for a in node.args]
        if len(args) != 1:
            raise RuleError(f"one argument is needed: {ast.unparse(node)}")
        name, arg = node.func.attr, args[0]
        if name == "contains" and t.kind == "list":
            return _ok(F.array_contains(t.value, arg.value), "bool", t, arg)
        if name == "matches":
            if not isinstance(node.args[0], ast.Constant):
                raise RuleError("matches() takes a literal pattern")
            value = t.value.rlike(node.args[0].value)
        elif name in ("startsWith", "endsWith", "contains"):
            value = {"startsWith": F.startswith, "endsWith": F.endswith, "contains": F.contains}[name](t.value, arg.value)
        else:
            raise RuleError(f"unknown method: {name}")
        wrong = t.kind not in ("string", "any")
        return Term(value if not wrong else F.lit(None).cast("boolean"), t.failed | arg.failed | t.value.isNull() | F.lit(wrong), "bool")


def compile_rule(rule: str, scope: Scope) -> Term:
    """The rule's value and failure; a result that is no boolean is a failure."""
    if not rule.strip():
        raise RuleError("a blank rule")
    try:
        tree = ast.parse(_pythonic(rule).strip(), mode="eval")
    except SyntaxError as e:
        raise RuleError(f"cannot read rule {rule!r}: {e}") from e
    compiler = _Compiler(scope)
    return compiler._boolean(compiler.term(tree))


MATCHED, NO_MATCH, UNDECIDED = "matched", "no_match", "indeterminate"


def evaluate(rules: list[str], scope: Scope) -> Column:
    """struct(outcome, index) of an ordered list: the first true rule matches (index from 1); the first that fails ends it undecided."""
    outcome, index = F.lit(NO_MATCH), F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules, 1))):
        t = compile_rule(rule, scope)
        failed, true = t.failed | t.value.isNull(), F.coalesce(t.value, F.lit(False))
        outcome = F.when(failed, UNDECIDED).when(true, MATCHED).otherwise(outcome)
        index = F.when(failed | true, F.lit(k)).otherwise(index)
    return F.struct(outcome.alias("outcome"), index.alias("index"))


def allows(rules: list[str], scope: Scope, default_allow: bool) -> Column:
    """An access policy: a match turns the default around, undecided denies."""
    verdict = evaluate(rules, scope)["outcome"]
    return F.when(verdict == UNDECIDED, False).when(verdict == MATCHED, not default_allow).otherwise(default_allow)


def retains(rules: list[str], scope: Scope) -> Column:
    """A retention policy: no rules, a match, or undecided retain; no match deletes."""
    return F.lit(True) if not rules else evaluate(rules, scope)["outcome"] != NO_MATCH


def either_retains(global_rules: list[str], own_rules: list[str], scope: Scope) -> Column:
    """Both policies together: any that has rules and retains wins; if neither has rules, retain."""
    voices = [retains(r, scope) for r in (global_rules, own_rules) if r]
    return reduce(lambda a, b: a | b, voices) if voices else F.lit(True)


def uses_pull_time(rules: list[str]) -> bool:
    """Whether rules look at pulls, which then have to be recorded."""
    return any(re.search(r"\btop_pulled\s*\(|\blast_pulled_at\b", r) for r in rules)


def retention_scope(tag: Column, pushed: Column, pulled: Column, pushed_rank: Column, pulled_rank: Column, now: int) -> Scope:
    """The names of retention rules; times are seconds, ranks null where a tag has none."""

    def top(rank: Column) -> Callable[[Term], Term]:
        return lambda n: _ok(F.coalesce(rank <= F.greatest(n.value, F.lit(0)), F.lit(False)), "bool", n)

    span = lambda f: lambda n: _ok(f(n.value), "int", n)
    return Scope(
        nullable={"image.tag": tag, "image.pushed_at": pushed, "image.last_pulled_at": pulled},
        kinds={"image.pushed_at": "int", "image.last_pulled_at": "int"},
        functions={
            "now": lambda: Term(F.lit(now).cast("bigint"), F.lit(False), "int"),
            "days": span(scalars.days),
            "hours": span(scalars.hours),
            "minutes": span(scalars.minutes),
            "top_pushed": top(pushed_rank),
            "top_pulled": top(pulled_rank),
        },
    )


def access_scope(optional: Mapping[str, Column], nullable: Mapping[str, Column], maps: Mapping[str, Column], has_own_policy: Column, kinds: Mapping[str, str] | None = None) -> Scope:
    """The names of access rules: request fields are left out when unset, identity fields are null."""
    own = lambda: Term(has_own_policy, F.lit(False), "bool")
    return Scope(nullable=nullable, optional=optional, maps=maps, functions={"has_repository_policy": own}, kinds=kinds or {})
