"""Spark's errors as the contract's, without credentials in their messages."""

from __future__ import annotations

import re
from contextlib import contextmanager

from pyspark.errors import AnalysisException, ParseException, PySparkException

from tidelake.contract import ErrorCode, QueryError, Resource, Target

SECRETS = (
    re.compile(r"(?i)((?:x-amz-|x-goog-)?(?:signature|credential|security-token)|sig|access_?key(?:_?id)?|secret(?:_?key)?|token|password)=[^&\s\"']+"),
    re.compile(r"(?i)(authorization:\s*\w+\s+)\S+"),
    re.compile(r"(://)[^/@\s]+@"),
)


def redacted(text: str) -> str:
    text = SECRETS[0].sub(lambda m: f"{m[1]}=***", text)
    text = SECRETS[1].sub(lambda m: f"{m[1]}***", text)
    return SECRETS[2].sub(lambda m: f"{m[1]}***@", text)


def as_query_error(error: Exception, target: Target = Target.NATIVE) -> QueryError:
    text = redacted(str(error).split("\n\nJVM stacktrace")[0])
    condition = (error.getCondition() or "") if isinstance(error, PySparkException) else ""
    if condition.startswith(("PATH_NOT_FOUND", "FAILED_READ_FILE.FILE_NOT_EXIST")) or "FileNotFoundException" in text:
        return QueryError(ErrorCode.OBJECT_NOT_FOUND, text, target)
    if "AccessControlException" in text or "Permission denied" in text:
        return QueryError(ErrorCode.ACCESS_DENIED, text, target)
    if "OutOfMemory" in text or condition.startswith("UNABLE_TO_ACQUIRE_MEMORY"):
        return QueryError(ErrorCode.RESOURCE_EXHAUSTED, text, target, resource=Resource.OPERATOR_MEMORY)
    if "maxResultSize" in text:
        return QueryError(ErrorCode.RESOURCE_EXHAUSTED, text, target, resource=Resource.RESULT_OUTPUT)
    if "No space left on device" in text:
        return QueryError(ErrorCode.RESOURCE_EXHAUSTED, text, target, resource=Resource.SPILL_STORAGE)
    if isinstance(error, (AnalysisException, ParseException)):
        return QueryError(ErrorCode.INVALID_REQUEST, text, target)
    return QueryError(ErrorCode.EXECUTION_FAILED, text, target)


@contextmanager
def mapped(target: Target = Target.NATIVE):
    try:
        yield
    except PySparkException as error:
        raise as_query_error(error, target) from error
