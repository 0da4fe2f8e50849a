"""Arrow-batched functions whose types are given as DDL text, made when first called (DDL needs a session).

They are declared non-deterministic, although they aren't, so that the optimizer neither copies a call into each of its uses
nor moves one into a lambda, where it couldn't run: each text is folded once."""

from __future__ import annotations

from functools import wraps
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.sql import functions as F


def _declared(make, kind: str):
    def wrap(function):
        made = []

        @wraps(function)
        def call(*columns):
            if not made:
                made.append(make(function, kind).asNondeterministic())
            return made[0](*columns)

        return call

    return wrap


def arrow_udf(kind: str):
    """A function of pandas series."""
    return _declared(F.pandas_udf, kind)


def columnar_udf(kind: str):
    """A function of Arrow arrays, which rows never leave as objects of their own."""
    return _declared(F.arrow_udf, kind)


def each_distinct(texts: pa.Array, function) -> pa.Array:
    """``function`` of each text (null: null), called once for each distinct text of the batch."""
    coded = texts.dictionary_encode()
    return pa.array([function(x) for x in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)


def in_lists(lists: pa.Array, function) -> pa.Array:
    """``function`` of the values of all lists as one array; nulls stay."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
    values = function(lists.flatten())
    return pa.ListArray.from_arrays(offsets, values, mask=lists.is_null())


def once(build):
    """``build`` run once for each JVM and arguments. Columns that refer to others by name alone belong to no table, so that those of large
    expressions, thousands of calls to the JVM each, can serve all plans."""
    made = WeakKeyDictionary()

    @wraps(build)
    def call(*args):
        gateway = SparkContext._gateway
        if gateway is None:
            return build(*args)
        own = made.setdefault(gateway, {})
        if args not in own:
            own[args] = build(*args)
        return own[args]

    return call
