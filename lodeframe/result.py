"""Answers as JSON: schema, nrows, bytes_read, ordering, and row-major data."""

import datetime
import json
import math

from .plans.planner import Answer


def value(x):
    """NaN and infinities as null, dates and datetimes as text with microseconds."""
    if isinstance(x, float) and not math.isfinite(x):
        return None
    if isinstance(x, datetime.datetime):
        return x.strftime("%Y-%m-%d %H:%M:%S.%f")
    if isinstance(x, datetime.date):
        return x.isoformat()
    return [value(y) for y in x] if isinstance(x, list) else x


def as_dict(answer: Answer, bytes_read: int = 0) -> dict:
    rows = [[value(x) for x in r] for r in answer.df.toLocalIterator(prefetchPartitions=True)]  # a partition at a time
    schema = [{"name": f.name, "dtype": f.dtype, "nullable": f.nullable} for f in answer.schema]
    return {"schema": schema, "nrows": len(rows), "bytes_read": bytes_read, "ordering": answer.ordering, "data": rows}


def as_json(answer: Answer, bytes_read: int = 0) -> str:
    return json.dumps(as_dict(answer, bytes_read))
