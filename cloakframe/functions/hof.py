"""Array helpers written with Spark's higher-order functions.

Everything here stays inside one row: no shuffle, no Python worker. A column
that is used inside a lambda is always bound with :func:`let` first, so that it
is computed once per row and not once per array element.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a name inside an expression (evaluated once)."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def constant_array(values: list, element: str = "string") -> Column:
    """A long constant array in one expression; Catalyst folds it to a literal."""
    return F.from_json(F.lit(json.dumps(values, ensure_ascii=False)), f"array<{element}>")


def prefix_sums(values: Column) -> Column:
    """Inclusive running sums of a numeric array in O(n log n)."""

    def doubled(arr: Column, step: Column) -> Column:
        return F.transform(
            arr,
            lambda x, i: x + F.coalesce(F.get(arr, (i - step).cast("int")), F.lit(0).cast("bigint")),
        )

    def scan(arr: Column) -> Column:
        steps = F.filter(
            F.transform(F.sequence(F.lit(0), F.lit(30)), lambda d: F.expr("1").cast("bigint") * F.pow(F.lit(2), d).cast("bigint")),
            lambda s: s < F.size(arr),
        )
        return F.aggregate(steps, arr, doubled)

    as_long = F.transform(values, lambda x: x.cast("bigint"))
    return F.when(F.size(values) < 2, as_long).otherwise(let(as_long, scan))


def binary_search(sorted_structs: Column, key: Column, field: str) -> Column:
    """First element of ``sorted_structs`` whose ``field`` is >= ``key``.

    ``sorted_structs`` must be a bound lambda variable or a plain column,
    sorted by ``field`` in binary order.
    """

    def step(state: Column, _: Column) -> Column:
        lo, hi = state["lo"], state["hi"]
        mid = F.shiftright(lo + hi, 1)
        go_right = F.get(sorted_structs, mid)[field] < key
        return F.when(lo >= hi, state).otherwise(
            F.struct(
                F.when(go_right, mid + 1).otherwise(lo).alias("lo"),
                F.when(go_right, hi).otherwise(mid).alias("hi"),
            )
        )

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(sorted_structs) + F.lit(1))).cast("int"))
    found = F.aggregate(
        rounds,
        F.struct(F.lit(0).alias("lo"), F.size(sorted_structs).alias("hi")),
        step,
        lambda s: s["lo"],
    )
    return F.get(sorted_structs, found)


def lookup(sorted_structs: Column, key: Column, field: str, value: str) -> Column:
    """``value`` of the element whose ``field`` equals ``key``, else NULL."""
    return let(
        binary_search(sorted_structs, key, field),
        lambda hit: F.when(hit[field] == key, hit[value]),
    )


def count_matches(text: Column, literal: Column) -> Column:
    """Non-overlapping occurrences of a non-empty literal in ``text``."""
    removed = F.char_length(text) - F.char_length(F.replace(text, literal, F.lit("")))
    return F.when(F.char_length(literal) > 0, (removed / F.char_length(literal)).cast("bigint")).otherwise(
        F.lit(0).cast("bigint")
    )


FEW_KEYS = 16


def sort_by_key(values: Column, field: str) -> Column:
    """``sort_array`` of structs that begin with ``field`` and already stand in the order of their other fields.

    Few distinct keys are gathered one after the other in linear time, many are sorted; the order is the same.
    """

    def by_keys(arr: Column, keys: Column) -> Column:
        runs = F.flatten(F.transform(keys, lambda k: F.filter(arr, lambda x: x[field] == k)))
        return F.when(F.size(keys) <= FEW_KEYS, runs).otherwise(F.sort_array(arr))

    keys = lambda arr: F.sort_array(F.array_distinct(F.transform(arr, lambda x: x[field])))
    return let(values, lambda arr: let(keys(arr), lambda k: by_keys(arr, k)))


# --- sentinels -------------------------------------------------------------
# While rules run, every matched value is swapped for one private-use code
# point of planes 15 and 16; its rank is the rank of the rule. Later rules can
# then never look inside a value that is already masked.

SENTINEL_CLASS = "[\\x{F0000}-\\x{FFFFD}\\x{100000}-\\x{10FFFD}]"
SENTINEL_CAPACITY = 2 * 65534


def sentinel_char(rank: int) -> str:
    """Python twin of :func:`sentinel`."""
    if not 0 <= rank < SENTINEL_CAPACITY:
        raise ValueError(f"no sentinel for rule rank {rank}")
    return chr(0xF0000 + rank) if rank < 65534 else chr(0x100000 + rank - 65534)


def sentinel(rank: Column) -> Column:
    """The sentinel of a rank as an expression (UTF-8 bytes built by arithmetic)."""
    n = F.when(rank < 65534, rank).otherwise(rank - 65534).cast("bigint")
    base = F.when(rank < 65534, F.lit(0xF3B08080)).otherwise(F.lit(0xF4808080)).cast("bigint")
    code = (
        base
        + F.floor(n / 4096).cast("bigint") * 65536
        + (F.floor(n / 64).cast("bigint") % 64) * 256
        + n % 64
    )
    return F.unhex(F.hex(code)).cast("string")
