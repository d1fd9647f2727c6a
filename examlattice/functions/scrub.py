"""Secrets out of the details of an audit log."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Names whose values are hidden, what stands for them, and the most characters of a detail.
SECRET = r"(?i)pass(word|wd)?|secret|token|api[_-]?key|cookie|authorization|credential"
HIDDEN, MOST = "[hidden]", 4000


def scrubbed(detail: Column) -> Column:
    """A map from names to texts, with the values of telling names hidden."""
    return F.transform_values(detail, lambda k, v: F.when(k.rlike(SECRET), HIDDEN).otherwise(v))


def scrubbed_json(detail: Column, most: int = MOST) -> Column:
    """A JSON text with the values of telling names hidden at any depth, cut after `most` characters with an ellipsis. What is no JSON is
    cut only; null stays null."""
    telling = re.compile(SECRET)

    def clean(value):
        todo = [value]
        while todo:
            x = todo.pop()
            if isinstance(x, dict):
                x.update({k: HIDDEN for k in x if telling.search(k)})
            todo += [v for v in (x.values() if isinstance(x, dict) else x if isinstance(x, list) else ()) if isinstance(v, (dict, list))]
        return value

    def of(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                t = None if t is None else json.dumps(clean(json.loads(t)), ensure_ascii=False)
            except ValueError:
                pass
            out.append(t if t is None or len(t) <= most else t[:most] + "\u2026")
        return pd.Series(out, dtype="object")

    return F.pandas_udf(of, "string")(detail)
