"""Places of pattern matches in a text, as arrays of structs, by built-in functions only."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from re import _constants as C
from re import _parser
from string import ascii_lowercase
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions.lexicon import ENGLISH

#: Places of a block in running_totals().
BLOCK = 256
SPAN = "struct<start:int,end:int,value:string>"
EMPTY = "array<struct<start:int,end:int,value:string>>"


def rx(pattern: str, fold: bool = True) -> str:
    r"""A pattern with Unicode classes, in any case unless fold is false."""
    return ("(?iU)" if fold else "(?U)") + pattern


def any_of(patterns) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def _alternatives(pattern: str) -> list[str]:
    """What stands between the bars of a pattern, those of groups that are nothing but a choice included."""
    out, depth, inside, last = [], 0, False, 0
    for m in re.finditer(r"\\.|[\[\]()|]", pattern, re.S):
        c = m[0]
        if inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            out.append(pattern[last : m.start()])
            last = m.end()
    out.append(pattern[last:])
    if len(out) > 1:
        return [b for a in out for b in _alternatives(a)]
    inner = pattern[3:-1]
    if pattern.startswith("(?:") and pattern.endswith(")") and not pattern.endswith("\\)") and _closed(inner):
        return _alternatives(inner)
    return out


def _closed(pattern: str) -> bool:
    """Whether every bracket of a pattern is closed within it, and none that isn't opened there."""
    depth, inside = 0, False
    for m in re.finditer(r"\\.|[\[\]()]", pattern, re.S):
        c = m[0]
        if inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c in "()":
            depth += 1 if c == "(" else -1
            if depth < 0:
                return False
    return depth == 0 and not inside


def _firsts(parsed) -> tuple[set[str] | None, bool]:
    """What a match can begin with (None: anything), and whether it can be empty."""
    out: set[str] = set()
    for op, arg in parsed:
        if op in (C.AT, C.ASSERT, C.ASSERT_NOT):
            continue
        empty = False
        if op is C.LITERAL:
            found = {chr(arg)}
        elif op is C.IN and all(o in (C.LITERAL, C.RANGE) or (o, v) == (C.CATEGORY, C.CATEGORY_DIGIT) for o, v in arg):
            found = {"\\d" if o is C.CATEGORY else chr(x) for o, v in arg for x in (range(v[0], v[1] + 1) if o is C.RANGE else (v,))}
        elif op is C.SUBPATTERN:
            found, empty = _firsts(arg[-1])
        elif op is C.BRANCH:
            each = [_firsts(b) for b in arg[1]]
            found, empty = None if any(f is None for f, _ in each) else set().union(*(f for f, _ in each)), any(e for _, e in each)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            found, empty = _firsts(arg[2])
            empty = empty or arg[0] == 0
        else:
            return None, False
        if found is None:
            return None, False
        out |= found
        if not empty:
            return out, False
    return out, True


def _start(pattern: str) -> str:
    """A look at the first sign of a match, as a pattern; empty where that can be any."""
    try:
        signs, empty = _firsts(_parser.parse(pattern))
    except re.error:  # what only Java knows
        return ""
    return "" if empty or not signs else "(?=[" + "".join(c if c.isalnum() or c == "\\d" else re.escape(c) if c.isascii() else c for c in sorted(signs)) + "])"


@lru_cache(maxsize=None)
def quick(pattern: str) -> str:
    r"""A pattern that is found in the same texts, sooner. Not for places: alternatives change their order.

    Those that begin at a bound of words look at the next letter first and at the bound once, and not at the bound again for each of
    them at every place; the others stay as they are, behind a look at the first sign."""
    every = _alternatives(pattern)
    bounded = [a[2:] for a in every if a.startswith(r"\b")]
    rest = [a for a in every if not a.startswith(r"\b")]
    words = "|".join(bounded)
    return "|".join(([rf"{_start(words)}\b(?:{words})"] if bounded else []) + [f"{_start(a)}(?:{a})" for a in rest])


#: Letters of a word that first_letters() keeps.
LETTERS = 4
#: Beginnings of words that a look for a pattern asks for at most.
BEGINNINGS = 400
_COMMON = frozenset(w[:LETTERS] for w in ENGLISH)


def _inside(op, arg) -> list[str] | None:
    """The signs that a literal or a set of signs stands for, "\\s" for all kinds of space; None: too many to name."""
    if op is C.LITERAL:
        return [chr(arg)]
    out: list[str] = []
    for o, v in arg:
        if o is C.LITERAL:
            out.append(chr(v))
        elif o is C.RANGE and v[1] - v[0] < 64:
            out += map(chr, range(v[0], v[1] + 1))
        elif (o, v) == (C.CATEGORY, C.CATEGORY_DIGIT):
            out += "0123456789"
        elif (o, v) == (C.CATEGORY, C.CATEGORY_SPACE):
            out.append(r"\s")
        else:
            return None
    return out


class _Unnamed(Exception):
    """A word may begin with anything."""


def _beginnings(items: list, have: str, out: set[str], spaced: bool = False) -> None:
    """Adds to out how the first word of what items match can begin, where have was read of it: LETTERS letters, a shorter word as a whole,
    or the sign that stands there instead of a word."""
    if len(out) > BEGINNINGS:
        raise _Unnamed
    if len(have) == LETTERS:
        out.add(have)
        return
    if not items:
        raise _Unnamed  # the word may go on
    (op, arg), rest = items[0], items[1:]
    if op in (C.LITERAL, C.IN):
        signs = _inside(op, arg)
        if signs is None:
            raise _Unnamed
        for c in {c.lower() for c in signs}:
            if c == r"\s" or c.isspace():
                if have:
                    out.add(have)
                else:
                    _beginnings(rest, "", out, True)
            elif c.isascii():  # others don't stand in the texts that are asked
                if c.isalnum() or c == "_":
                    _beginnings(rest, have + c, out)
                else:
                    out.add(have or c)
    elif op is C.AT:
        if have:
            if arg is not C.AT_BOUNDARY:
                raise _Unnamed
            out.add(have)
        else:
            _beginnings(rest, have, out, spaced)
    elif op in (C.ASSERT, C.ASSERT_NOT):
        if have and op is C.ASSERT_NOT and arg[0] > 0 and _any_letter(arg[1]):
            out.add(have)
        else:
            _beginnings(rest, have, out, spaced)
    elif op is C.SUBPATTERN:
        _beginnings([*arg[-1], *rest], have, out, spaced)
    elif op is C.BRANCH:
        for b in arg[1]:
            _beginnings([*b, *rest], have, out, spaced)
    elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        least, most, sub = arg
        if least == 0:
            _beginnings(rest, have, out, spaced)
        if most and not (spaced and _blank(sub)):
            _beginnings([*sub, *([(op, (max(least - 1, 0), most - 1 if most is not C.MAXREPEAT else most, sub))] if most != 1 else []), *rest], have, out, spaced)
        elif most and least:
            _beginnings(rest, have, out, spaced)
    else:
        raise _Unnamed


def _any_letter(parsed) -> bool:
    """Whether a pattern is one sign, which can be any letter."""
    return len(parsed) == 1 and parsed[0][0] is C.IN and (C.CATEGORY, C.CATEGORY_WORD) in parsed[0][1]


def _blank(parsed) -> bool:
    """Whether a pattern is one sign of space."""
    return len(parsed) == 1 and parsed[0][0] in (C.LITERAL, C.IN) and all(c == r"\s" or c.isspace() for c in _inside(*parsed[0]) or ["x"])


def _opens(op, arg) -> bool:
    """Whether what follows this item begins a word, if it begins with a letter: a bound of words, the text's start, a space, or no letter before."""
    if op is C.AT:
        return arg in (C.AT_BOUNDARY, C.AT_BEGINNING)
    if op is C.ASSERT_NOT:
        return arg[0] < 0 and _any_letter(arg[1])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        return arg[0] > 0 and _blank(arg[2])
    return op in (C.LITERAL, C.IN) and _blank([(op, arg)])


def _needed(items: list) -> set[str] | None:
    """Beginnings of words of which each match of a sequence has one: the rarest that a place in it gives."""
    found: list[set[str]] = []
    for i, (op, arg) in enumerate(items):
        if op is C.SUBPATTERN:
            inner = _needed(list(arg[-1]))
        elif op is C.BRANCH:
            each = [_needed([*b]) for b in arg[1]]
            inner = None if None in each else set().union(*each)
        else:
            inner = {chr(arg)} if op is C.LITERAL and 32 < arg < 127 and not chr(arg).isalnum() and arg != ord("_") else None
        if inner is not None:
            found.append(inner)
        opened = i > 0 and _opens(*items[i - 1]) or i > 1 and items[i - 1][0] is C.MAX_REPEAT and _blank(items[i - 1][1][2]) and _opens(*items[i - 2])
        if opened:
            out: set[str] = set()
            try:
                _beginnings(items[i:], "", out)
                found.append(out)
            except _Unnamed:
                pass
    return min(found, key=lambda f: (len(f) + 50 * len(f & _COMMON), sorted(f)), default=None)


@lru_cache(maxsize=None)
def needed(pattern: str) -> frozenset[str] | None:
    """Beginnings as first_letters() gives them, of which every ASCII text that a pattern is found in has one, in any case; None: not known."""
    try:
        each = [_needed(list(_parser.parse(a))) for a in _alternatives(pattern)]
    except re.error:  # what only Java knows
        return None
    return None if None in each else frozenset().union(*each)


def _all_needed(patterns) -> frozenset[str]:
    return frozenset().union(*(needed(p) or () for p in patterns))


def first_letters(text: Column, patterns) -> Column:
    """How the words of an ASCII text begin, in small letters, and its signs, as far as these patterns need() them; null for other texts."""
    kept = sorted(_all_needed(patterns))
    return F.when(text.rlike(r"^\p{ASCII}*$"), F.filter(F.regexp_extract_all(F.lower(text), F.lit(rf"\b\w{{1,{LETTERS}}}|[^\w\s]"), F.lit(0)), lambda w: w.isin(*kept)))


class Words(NamedTuple):
    """A column of first_letters() and the patterns that it was made for."""

    column: Column
    patterns: tuple[str, ...]

    def may_have(self, patterns) -> Column:
        """Whether one of some patterns can be found in the text; always true of patterns that the column wasn't made for."""
        each = [needed(p) for p in patterns]
        if None in each or not frozenset().union(*each) <= _all_needed(self.patterns):
            return F.lit(True)
        signs = sorted(frozenset().union(*each))
        return F.coalesce(F.exists(self.column, lambda w: w.isin(*signs)), F.lit(True))


def _started_rx(pattern: str) -> str:
    """A pattern of rx() with the same matches, behind a look at their first sign; as it is where that can be any letter."""
    head = next((h for h in ("(?iU)", "(?U)") if pattern.startswith(h)), "")
    rest = pattern[len(head) :]
    look = _start(rest)
    return f"{head}{look}(?:{rest})" if look and not set(ascii_lowercase) <= set(look) else pattern


def no_spans() -> Column:
    return F.array().cast(EMPTY)


def _parts(text: Column, pattern: Column) -> Column:
    """What lies between the matches of a pattern that matches no empty text, and the matches, in turn; one more lies between than match.

    The pattern goes over the text once: its matches are put between signs that the text doesn't have. A single sign is no pattern
    to split(), which compiles any other for every row."""
    each = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)), lambda gap, v: F.when(v.isNull(), F.array(gap)).otherwise(F.array(gap, v)))
    return F.when(F.contains(text, F.lit("\0")), F.flatten(each)).otherwise(F.split(F.regexp_replace(text, pattern, F.lit("\0$0\0")), "\0", -1))


def located(text: Column, pattern: str | Column, may: Column | None = None) -> Column:
    """All matches, leftmost first and not overlapping, as (start, end, value) in code points.

    A match starts where all before it ends. The array grows by a place for each match: this is for messages, whose length is
    limited. Where may is false nothing is looked for.
    """
    parts = _parts(text, F.lit(_started_rx(pattern)) if isinstance(pattern, str) else pattern)
    begin = F.struct(F.lit(0).alias("at"), F.lit(False).alias("match"), no_spans().alias("out"))

    def step(acc: Column, part: Column) -> Column:
        end = acc["at"] + F.length(part)
        one = F.array(F.struct(acc["at"].alias("start"), end.alias("end"), part.alias("value")))
        return F.struct(end.alias("at"), (~acc["match"]).alias("match"), F.when(acc["match"], F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    there = text.isNotNull() if may is None else text.isNotNull() & may
    return F.when(there, F.aggregate(parts, begin, step, lambda acc: acc["out"])).otherwise(no_spans())


def located_any(text: Column, patterns, words: Words | None = None, fold: bool = True) -> Column:
    """Matches of several patterns, sorted and distinct. One look at all of them spares most texts the rest, and a look at each one
    the places of those that don't match: a pattern out of an array is compiled for every text."""
    each = F.array_compact(F.array(*[F.when(text.rlike(rx(quick(p), fold)), F.lit(_started_rx(rx(p, fold)))) for p in patterns]))
    found = F.flatten(F.transform(each, lambda p: located(text, p)))
    return F.when(has_any(text, patterns, words, fold), F.array_sort(F.array_distinct(found))).otherwise(no_spans())


def has(text: Column, pattern: str, words: Words | None = None, fold: bool = True) -> Column:
    """Whether a pattern is found in a text; words are the text's, which spare most texts the look."""
    return has_any(text, [pattern], words, fold)


def has_any(text: Column, patterns, words: Words | None = None, fold: bool = True) -> Column:
    found = text.rlike(rx(quick(any_of(patterns) if len(patterns) > 1 else patterns[0]), fold))
    return found if words is None else words.may_have(patterns) & found


def starts_in(span: Column, spans: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] <= span["start"]) & (span["start"] < s["end"]))


def shifted(spans: Column, by: Column) -> Column:
    return F.transform(spans, lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["value"].alias("value")))


def running_totals(values: Column) -> Column:
    """Sums of an int array up to each place, its own value included.

    Arrays grow within a block of BLOCK places and by a place for each block, never by one for each value: work is linear for all
    texts that fit a row."""
    none = F.array().cast("array<int>")
    grow = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"] + x)).alias("out"))
    run = lambda v, first: F.aggregate(v, F.struct(first.alias("sum"), none.alias("out")), grow, lambda acc: acc["out"])
    added = lambda v: F.aggregate(v, F.lit(0), lambda a, x: a + x)

    def of(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), F.lit(BLOCK)), lambda at: F.slice(v, at + 1, F.lit(BLOCK)))
        firsts = lambda b: F.concat(F.array(F.lit(0)), run(F.transform(b, added), F.lit(0)))
        return bound(blocks, lambda b: F.flatten(F.zip_with(b, F.slice(firsts(b), F.lit(1), F.size(b)), run)))

    return bound(values, of)


def bound(value: Column, make: Callable[[Column], Column]) -> Column:
    """make(value), with value computed once however often make names it."""
    return F.transform(F.array(value), make)[0]


def located_long(text: Column, pattern: str) -> Column:
    """located() for texts of any length: places come from running totals."""

    def placed(both: Column) -> Column:
        ends = running_totals(F.zip_with(both["gaps"], both["values"], lambda g, v: F.length(g) + F.length(v)))
        return F.zip_with(ends, both["values"], lambda e, v: F.struct((e - F.length(v)).alias("start"), e.alias("end"), v.alias("value")))

    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.struct(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(values)).alias("gaps"), values.alias("values"))
    return F.when(text.rlike(pattern), bound(both, placed)).otherwise(no_spans())


def message_clauses(text: Column, pattern: str) -> Column:
    """clauses() of messages, whose length is limited: a fold whose array grows by a place for each clause, and a smaller plan."""
    begin = F.struct(F.lit(0).alias("at"), F.lit(False).alias("break"), no_spans().alias("out"))

    def step(acc: Column, part: Column) -> Column:
        end = acc["at"] + F.length(part)
        one = F.array(F.struct(acc["at"].alias("start"), end.alias("end"), part.alias("value")))
        return F.struct(end.alias("at"), (~acc["break"]).alias("break"), F.when(~acc["break"] & (F.length(part) > 0), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(_parts(text, F.lit(pattern)), begin, step, lambda acc: acc["out"])


def clauses(text: Column, pattern: str) -> Column:
    """What lies between matches of a break, as (start, end, value); empty clauses are left out. Linear in the text."""

    def placed(both: Column) -> Column:
        ends = running_totals(F.zip_with(both["parts"], both["breaks"], lambda p, b: F.length(p) + F.length(F.coalesce(b, F.lit("")))))
        ends_of = lambda b, i: F.get(b["ends"], i) - F.length(F.coalesce(F.get(b["breaks"], i), F.lit("")))
        whole = F.struct(both["parts"].alias("parts"), both["breaks"].alias("breaks"), ends.alias("ends"))
        return bound(whole, lambda b: F.filter(F.transform(b["parts"], lambda p, i: F.struct((ends_of(b, i) - F.length(p)).alias("start"), ends_of(b, i).alias("end"), p.alias("value"))), lambda c: c["end"] > c["start"]))

    both = F.struct(F.split(text, pattern, -1).alias("parts"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("breaks"))
    return bound(both, placed)


def settled(df: DataFrame) -> DataFrame:
    """df with its columns computed here and once.

    Coalescing to more partitions than there are changes nothing, but the optimiser leaves projections above and below it apart,
    and still drops columns that nobody reads. Without it, an expression that is used once, inside a lambda, is copied there
    and evaluated for every element, and projections are merged into ever larger ones.
    """
    return df.coalesce(1 << 20)


def extended(df: DataFrame, name: str, kind: T.DataType, make: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    """df with one more column that a helper in Python makes from each Arrow batch. Not a function column: the optimiser
    would put that into lambdas that use it, where Python can't be called."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, make(b)], names=[*b.schema.names, name])

    return df.mapInArrow(extend, T.StructType([*df.schema.fields, T.StructField(name, kind)]))


def answered(df: DataFrame, name: str, kind: T.DataType, column: str, make: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """df with one more column that a helper in Python makes from one other. Only that column travels, and columns that nobody reads
    aren't made. Called nondeterministic, because the optimiser takes any other function along into lambdas and filters above it,
    where Python can't be called (rule_frequency) or is called again."""

    def one(values: pa.Array) -> pa.Array:
        return make(values)

    return df.withColumn(name, F.arrow_udf(one, kind).asNondeterministic()(F.col(column)))
