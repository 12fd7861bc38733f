"""Which byte ranges of a file to read in one request.

Wanted ranges that touch are one. Neighbours are read together where the gap
between them is small: each gap, all gaps of a request together, their share of
what is wanted, and the request as a whole are bounded.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from tidelake.contract import ErrorCode, QueryError, Resource, RuntimeLimits, invalid


@dataclass(frozen=True)
class RangePolicy:
    # The published bounds.
    gap: int = 16 * 1024
    gaps: int = 64 * 1024
    #: Gap bytes for each wanted byte.
    waste: float = 0.25
    request: int = 512 * 1024


def requests(wanted: list[tuple[int, int]], size: int | None = None, policy: RangePolicy = RangePolicy()) -> list[tuple[int, int, int, int]]:
    """(start, end, wanted bytes, ranges) of each request, by start.

    Where a range is empty or leaves a file of ``size`` bytes, all are read as they are asked for.
    """
    if any(b < a or a < 0 for a, b in wanted):
        raise invalid("a byte range ends before it starts")
    if any(a == b or (size is not None and b > size) for a, b in wanted):
        return [(a, b, b - a, 1) for a, b in wanted]
    out: list[list[int]] = []
    for start, end in sorted(wanted):
        if out and start <= out[-1][1]:
            last = out[-1]
            last[2] += max(0, end - last[1])
            last[1], last[3] = max(last[1], end), last[3] + 1
        else:
            out.append([start, end, end - start, 1])
    plan = out[:1]
    for start, end, used, count in out[1:]:
        last = plan[-1]
        length, both = end - last[0], last[2] + used
        fits = start - last[1] <= policy.gap and length - both <= policy.gaps and length <= policy.request and length - both <= policy.waste * both
        if fits:
            last[1:] = [end, both, last[3] + count]
        else:
            plan.append([start, end, used, count])
    return [tuple(p) for p in plan]


def within_overfetch(plan: list[tuple[int, int, int, int]], limits: RuntimeLimits) -> int:
    """Bytes that the requests read beyond what is wanted; raises above the limit."""
    extra = sum(end - start - wanted for start, end, wanted, _ in plan)
    if limits.max_scan_overfetch_bytes is not None and extra > limits.max_scan_overfetch_bytes:
        raise QueryError(ErrorCode.RESOURCE_EXHAUSTED, f"the requests read {extra} bytes too many; the limit is {limits.max_scan_overfetch_bytes}", resource=Resource.SCAN_BYTES)
    return extra


def plan_requests(ranges: DataFrame, policy: RangePolicy = RangePolicy()) -> DataFrame:
    """file, start, end, wanted_bytes, ranges: the requests for ``ranges`` (file, start, end, size), file by file."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        file, size = rows["file"].iat[0], rows["size"].iat[0]
        found = requests(list(zip(rows["start"].tolist(), rows["end"].tolist())), None if pd.isna(size) else int(size), policy)
        return pd.DataFrame([(file, *r) for r in found], columns=["file", "start", "end", "wanted_bytes", "ranges"])

    return ranges.groupBy("file").applyInPandas(one, "file string, start long, end long, wanted_bytes long, ranges long")
