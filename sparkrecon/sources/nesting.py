"""Cutting text at its outermost parentheses or commas, whatever the nesting.

Regular expressions can only count so far. Here the text is taken apart into runs that
hold opening or closing parentheses but not both, with the literals and the text between
them, so that calls nested hundreds deep are two runs. A running depth over the runs tells
where a group begins and ends. It goes over blocks of runs: what a block does to the depth
it starts with is ``max(depth + net, low)``, so the depths at the starts of all blocks
follow from those two numbers of each, and then every block is followed on its own. Only
the few runs in which the depth leaves or reaches zero are looked into.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkrecon.functions.rows import let

#: Runs of a block.
BLOCK = 64
#: A sign that no text should hold; if one does, it is written as ``SIGN + "0"``.
SIGN = "﷐"
BEGIN, END, CUT = f"{SIGN}1", f"{SIGN}2", f"{SIGN}3"
_INSIDE = f"((?:[^{SIGN}]++|{SIGN}0)*+)"


def _but(signs: str, token: str) -> str:
    """A token that is none of the signs."""
    return f"(?:(?![{signs}])(?:{token}))"


def _net(run: Column, token: str) -> Column:
    """What a run adds to the depth: its opening or, below zero, its closing parentheses."""
    bare = F.regexp_replace(run, F.lit(_but("()", token) + "++"), F.lit(""))
    return let(bare, lambda b: F.when(b.startswith("("), F.length(b)).otherwise(-F.length(b)))


def _after(depth: Column, net: Column) -> Column:
    """A parenthesis that closes nothing changes nothing."""
    return F.greatest(depth + net, F.lit(0))


def _starts(nets: Column) -> Column:
    """The depth each run starts at."""
    last = F.floor(F.greatest(F.size(nets) - 1, F.lit(0)) / BLOCK).cast("int")
    blocks = F.transform(
        F.sequence(F.lit(0), last), lambda i: F.slice(nets, i * BLOCK + 1, F.lit(BLOCK))
    )

    def effect(state: Column, net: Column) -> Column:
        return F.struct((state["net"] + net).alias("net"), _after(state["low"], net).alias("low"))

    def follow(depths: Column, e: Column) -> Column:
        last = F.element_at(depths, -1)
        return F.concat(depths, F.array(F.greatest(last + e["net"], e["low"])))

    def within(block: Column, depth: Column) -> Column:
        depths = F.aggregate(
            block, F.array(depth), lambda d, net: F.concat(d, F.array(_after(F.element_at(d, -1), net)))
        )
        return F.slice(depths, F.lit(1), F.size(block))

    def of_blocks(blocks: Column) -> Column:
        none = F.struct(F.lit(0).alias("net"), F.lit(0).alias("low"))
        effects = F.transform(blocks, lambda block: F.aggregate(block, none, effect))
        depths = F.slice(F.aggregate(effects, F.array(F.lit(0)), follow), F.lit(1), F.size(blocks))
        return F.flatten(F.zip_with(blocks, depths, within))

    return let(blocks, of_blocks)


def marked(text: Column, token: str) -> Column:
    """The text with marks at outermost parentheses and commas. The pattern ``token``
    must match all of the text, single parentheses and, where those count, commas."""
    commas = re.match(token, ",.").end() == 1

    def cut(outside: Column) -> Column:
        """Text at depth zero."""
        if not commas:
            return outside
        pattern = rf"\G({_but(',', token)}*+),"
        return F.regexp_replace(outside, F.lit(pattern), F.lit(f"$1{CUT}"))

    def after(run: Column, head: Column) -> Column:
        return F.substring(run, F.length(head) + 1, F.length(run))

    def opened(run: Column) -> Column:
        """A run that starts at depth zero, up to its first opening parenthesis, and on."""
        head = F.regexp_extract(run, rf"\A{_but('(', token)}*+", 0)

        def written(head: Column) -> Column:
            rest = after(run, head)
            begun = F.when(rest == "", rest).otherwise(F.concat(F.lit(BEGIN), rest))
            return F.concat(cut(head), begun)

        return let(head, written)

    def closed(run: Column, depth: Column) -> Column:
        """A run that comes down to depth zero, up to that place, and on."""
        pieces = F.regexp_extract_all(run, F.lit(rf"{_but(')', token)}*+\)"), F.lit(0))
        head = F.array_join(F.slice(pieces, F.lit(1), depth), "")
        return let(head, lambda h: F.concat(h, F.lit(END), cut(after(run, h))))

    def written(run: Column, net: Column, depth: Column) -> Column:
        return (
            F.when((depth == 0) & (net >= 0), opened(run))
            .when(depth == 0, cut(run))
            .when(depth + net <= 0, closed(run, depth))
            .otherwise(run)
        )

    def of_runs(runs: Column, nets: Column, starts: Column) -> Column:
        return F.array_join(
            F.transform(runs, lambda run, i: let(
                F.struct(F.get(nets, i).alias("net"), F.get(starts, i).alias("depth")),
                lambda at: written(run, at["net"], at["depth"]),
            )), "",
        )

    plain = F.replace(text, F.lit(SIGN), F.lit(f"{SIGN}0"))
    pattern = f"{_but(')', token)}++|{_but('(', token)}++"
    return let(F.regexp_extract_all(plain, F.lit(pattern), F.lit(0)), lambda runs: let(
        F.transform(runs, lambda run: _net(run, token)),
        lambda nets: let(_starts(nets), lambda starts: of_runs(runs, nets, starts)),
    ))


def _plain(text: Column) -> Column:
    return F.replace(text, F.lit(f"{SIGN}0"), F.lit(SIGN))


def groups(marked_text: Column) -> Column:
    """The closed outermost groups of a marked text, with their parentheses."""
    found = F.regexp_extract_all(marked_text, F.lit(f"{BEGIN}{_INSIDE}{END}"), F.lit(1))
    return F.transform(found, _plain)


def has_open_group(marked_text: Column) -> Column:
    """Whether the last outermost group of a marked text is never closed."""
    return marked_text.rlike(rf"{BEGIN}{_INSIDE}\z")


def parts(marked_text: Column) -> Column:
    """The text between the outermost commas of a marked text."""
    bare = F.replace(F.replace(marked_text, F.lit(BEGIN), F.lit("")), F.lit(END), F.lit(""))
    return F.transform(F.split(bare, CUT), _plain)
