"""Text functions with one definition of white space, lines and size for the whole package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
#: The 29 white-space characters that stripping removes.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"
#: Ends of lines for splitlines().
LINE_ENDS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
#: Characters that end a sentence.
SENTENCE_ENDS = "。？！.!?\n"
CHARS_PER_TOKEN = 2


def bound(value: Column, body: Callable[[Column], Column], like: Column | None = None) -> Column:
    """body(value) with value computed once: a one-element array binds it to a lambda variable.

    Where body gives the state of a fold, like is that fold's state before, for its type.
    """
    if like is None:
        return F.get(F.transform(F.array(value), body), F.lit(0))
    return F.aggregate(F.array(value), like, lambda _, v: body(v))


def folded(items: Column, start: Column, none: Column, step: Callable[[Column, Column], Column], end: Callable[[Column], Column] | None = None) -> Column:
    """All that a fold over an array gives out. Its state is a struct whose first field, out, is an array to which step adds; end gives what the last state adds.

    Spark copies a fold's state with all that is in it at each step. So the items are taken in runs of about the square root of their
    number, and what a run gives out is put aside before the next: a step copies no more than its run's output. none is an empty array of out's type.
    """

    def runs(all_: Column) -> Column:
        state = lambda done, last: F.struct(done.alias("done"), last.alias("last"))

        def by_run(n: Column) -> Column:
            def one(acc: Column, k: Column) -> Column:
                return bound(F.aggregate(F.slice(all_, k * n + 1, n), acc["last"], step), lambda s: state(F.concat(acc["done"], F.array(s["out"])), s.withField("out", none)), acc)

            last = (lambda s: s["out"]) if end is None else (lambda s: F.concat(s["out"], end(s)))
            turns = F.sequence(F.lit(0), F.floor(F.greatest(F.size(all_) - 1, F.lit(0)) / n).cast("int"))
            return F.aggregate(turns, state(F.slice(F.array(none), 1, 0), start), one, lambda acc: F.concat(F.flatten(acc["done"]), last(acc["last"])))

        return bound(F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(all_))).cast("int")), by_run, none)

    return bound(items, runs, none)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def blank(text: Column) -> Column:
    return F.length(strip(text)) == 0


def tokens(text: Column) -> Column:
    """Estimated tokens: two characters each, rounded down; 0 for null."""
    return F.shiftright(F.coalesce(F.length(text), F.lit(0)).cast("long"), 1)


def lines(text: Column) -> Column:
    """Lines of the stripped text, split at line feeds only."""
    return F.split(strip(text), "\n")


def filled_lines(text: Column) -> Column:
    """The stripped lines that are not blank."""
    return F.filter(F.transform(lines(text), strip), lambda x: F.length(x) > 0)


def splitlines(text: Column) -> Column:
    """Lines at every kind of line end, without an empty one at the end."""
    parts = F.split(text, LINE_ENDS)
    return bound(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))


def escape_html(text: Column) -> Column:
    """The five characters that have a meaning in HTML; null gives the empty string."""
    out = F.coalesce(text, F.lit(""))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def uri_component(text: Column) -> Column:
    """Percent-encoding of UTF-8 for one component of a URI: ASCII letters, digits and - _ . ! ~ * ' ( ) stay."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for sign, code in (("!", "%21"), ("'", "%27"), ("(", "%28"), (")", "%29"), ("~", "%7E")):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return out


def mask(secret: Column) -> Column:
    """All but the last four characters as stars; secrets of up to four characters are masked as a whole."""
    n = F.length(secret)
    return F.when(n > 4, F.concat(F.repeat(F.lit("*"), n - 4), F.right(secret, F.lit(4)))).otherwise(F.repeat(F.lit("*"), n))


def preview(text: Column, n: int = 100) -> Column:
    return F.left(text, F.lit(n))
