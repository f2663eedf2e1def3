"""Linear-cost array helpers, as SQL text for ``F.expr``.

``aggregate`` that appends to an array copies the array at every step, which is
quadratic in its length.  Working in blocks keeps each copy short, so a long array
costs little more than its length.

Nested lambdas are written as SQL because it parses in one step, where the Column API
needs a round trip to the JVM for every node.
"""

from __future__ import annotations

BLOCK = 256


def let(name: str, value: str, body: str) -> str:
    """Evaluate ``value`` once and use it in ``body`` as ``name``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def in_blocks(arr: str, block: int = BLOCK) -> str:
    """Cut an array into consecutive slices of at most ``block`` elements."""
    last = f"greatest(0, cast(floor((size({arr}) - 1) / {block}) as int))"
    return f"transform(sequence(0, {last}), b_ -> slice({arr}, b_ * {block} + 1, {block}))"


def running_state(arr: str, step: str, block: int = BLOCK) -> str:
    """Integer state *before* each element: 0 for the first, ``step`` of it after.

    ``step`` is SQL over ``s`` (state) and ``x`` (element): ``running_state('lengths',
    's + x')`` gives exclusive prefix sums.
    """
    fold = (
        f"aggregate(part_, "
        f"named_struct('state', coalesce(try_element_at(done_, -1).state, 0), 'before', cast(array() as array<int>)), "
        f"(acc_, x) -> named_struct("
        f"'state', {let('s', 'acc_.state', f'cast({step} as int)')}, "
        f"'before', concat(acc_.before, array(acc_.state))))"
    )
    blocks = (
        f"aggregate({in_blocks(arr, block)}, "
        f"cast(array() as array<struct<state:int,before:array<int>>>), "
        f"(done_, part_) -> concat(done_, array({fold})))"
    )
    return f"flatten(transform({blocks}, b_ -> b_.before))"
