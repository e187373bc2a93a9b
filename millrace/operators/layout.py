"""Layer layouts and what follows from them: counts, predicates, parameters, bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The names of the two kinds of layers.
ATTENTION, CONVOLUTION = "full_attention", "conv"


def interleaved(blocks: Column, attention: Column) -> Column:
    """Kinds of layers: ``attention`` of ``blocks`` spread evenly, from the third on where there are more than six; a place that is taken passes the layer on to the next free one."""
    start = F.when(blocks > 6, 2).otherwise(0)
    wished = F.transform(F.sequence(F.lit(1), attention), lambda i: F.least(F.greatest(start + F.bround(i * (blocks - start) / (attention + 1), 0).cast("int"), start), blocks - 1))

    def free(taken: Column, at: Column) -> Column:
        # places in the order in which they are tried: from the wished one to the end, then from the first
        order = F.concat(F.sequence(at, blocks - 1), F.sequence(F.lit(0), blocks - 1))
        return F.get(F.filter(order, lambda p: ~F.array_contains(taken, p)), F.lit(0))

    places = F.aggregate(wished, F.array().cast("array<int>"), lambda taken, at: F.concat(taken, F.array(free(taken, at))))
    every = F.sequence(F.lit(0), blocks - 1)
    return F.when(attention == blocks, F.array_repeat(F.lit(ATTENTION), blocks)).otherwise(F.transform(every, lambda p: F.when(F.array_contains(places, p), ATTENTION).otherwise(CONVOLUTION)))


def is_all_attention(kinds: Column) -> Column:
    return F.forall(kinds, lambda k: k == ATTENTION)


def parameters(kinds: Column, width: Column, inner: Column, vocabulary: Column) -> Column:
    """Parameters of a model with these layers, its embedding shared with its output."""
    attention = 4 * width * width
    convolution = 3 * width * width + 3 * width
    n = F.size(F.filter(kinds, lambda k: k == ATTENTION))
    return (vocabulary * width + width + n * attention + (F.size(kinds) - n) * convolution + F.size(kinds) * (3 * width * inner + 2 * width)).cast("long")
