"""Small Column helpers."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(expr: Column, body) -> Column:
    """Evaluate ``expr`` once and pass it to ``body`` as a lambda variable.

    Inside a higher-order function a referenced *expression* is re-evaluated for
    every element; a lambda variable is not. ``let`` binds the value through a
    one-element ``transform`` so nested lambdas see a variable.
    """
    return F.get(F.transform(F.array(expr), body), 0)
