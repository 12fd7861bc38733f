"""Which target runs a query, and where it goes when that target can't."""

from __future__ import annotations

from dataclasses import dataclass

from tidelake.contract import FallbackReason, QueryError, QueryRequest, Target


@dataclass(frozen=True)
class Route:
    target: Target
    fallback: FallbackReason | None = None


def first_route(request: QueryRequest) -> Route:
    return Route(request.preferred_target)


def reroute(request: QueryRequest, error: QueryError) -> Route:
    """The native target, if a restricted one failed for a reason that it names; else the error."""
    if request.preferred_target is Target.NATIVE or not error.requires_fallback:
        raise error
    return Route(Target.NATIVE, error.fallback)


def run(spark, request: QueryRequest):
    """Run on the preferred target, then on the native one where that is asked for."""
    from dataclasses import replace

    from tidelake.operators.session import execute_query

    try:
        return execute_query(spark, request)
    except QueryError as error:
        route = reroute(request, error)
        return execute_query(spark, replace(request, preferred_target=route.target, options=replace(request.options, limits=None)))
