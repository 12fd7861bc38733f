"""The public contract: requests, results, capabilities and structured errors."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum
from typing import Any

MAX_PAGE = 501  # a page of 500 and one row that says that more follow


# The names of the contract.
class CapabilityKey(Enum):
    BROWSER_EXTERNAL_MEMORY = "browser_external_memory"
    CHANGE_DATA_FEED = "change_data_feed"
    COLUMN_MAPPING = "column_mapping"
    DELETION_VECTORS = "deletion_vectors"
    MULTI_PARTITION_EXECUTION = "multi_partition_execution"
    PROXY_ACCESS = "proxy_access"
    RANGE_READS = "range_reads"
    SIGNED_URL_ACCESS = "signed_url_access"
    TIME_TRAVEL = "time_travel"
    TIMESTAMP_NTZ = "timestamp_ntz"
    UNKNOWN_PROTOCOL_FEATURES = "unknown_protocol_features"


class CapabilityState(Enum):
    SUPPORTED = "supported"
    NATIVE_ONLY = "native_only"
    UNSUPPORTED = "unsupported"
    EXPERIMENTAL = "experimental"


class FallbackReason(Enum):
    ACCESS_DENIED = "access_denied"
    BROWSER_RUNTIME_CONSTRAINT = "browser_runtime_constraint"
    NATIVE_REQUIRED = "native_required"
    NETWORK_FAILURE = "network_failure"
    RANGE_READ_UNAVAILABLE = "range_read_unavailable"
    SECURITY_POLICY = "security_policy"
    SIGNED_URL_EXPIRED = "signed_url_expired"
    CAPABILITY_GATE = "capability_gate"


class ErrorCode(Enum):
    ACCESS_DENIED = "access_denied"
    EXECUTION_FAILED = "execution_failed"
    FALLBACK_REQUIRED = "fallback_required"
    INVALID_REQUEST = "invalid_request"
    OBJECT_NOT_FOUND = "object_not_found"
    OBJECT_STORE_PROTOCOL = "object_store_protocol"
    RESOURCE_EXHAUSTED = "resource_exhausted"
    SECURITY_POLICY_VIOLATION = "security_policy_violation"
    UNSUPPORTED_FEATURE = "unsupported_feature"


class Resource(Enum):
    OPERATOR_MEMORY = "operator_memory"
    RESULT_OUTPUT = "result_output"
    SCAN_BYTES = "scan_bytes"
    SPILL_STORAGE = "spill_storage"


class Target(Enum):
    NATIVE = "native"
    SESSION = "session"
    NARROW = "narrow"


class QueryError(Exception):
    def __init__(self, code: ErrorCode, message: str, target: Target = Target.NATIVE, fallback: FallbackReason | None = None, capability: CapabilityKey | None = None, resource: Resource | None = None):
        super().__init__(message)
        self.code, self.message, self.target, self.fallback = code, message, target, fallback
        self.capability, self.resource = capability, resource

    @property
    def requires_fallback(self) -> bool:
        return self.fallback is not None


def invalid(message: str, target: Target = Target.NATIVE) -> QueryError:
    return QueryError(ErrorCode.INVALID_REQUEST, message, target)


@dataclass(frozen=True)
class ResultPage:
    limit: int
    offset: int = 0

    def __post_init__(self):
        if not 1 <= self.limit <= MAX_PAGE or self.offset < 0:
            raise invalid(f"a page takes 1 to {MAX_PAGE} rows from an offset of 0 or more")


@dataclass(frozen=True)
class RuntimeLimits:
    max_result_rows: int | None = None
    max_arrow_ipc_bytes: int | None = None
    max_preview_string_bytes: int | None = None
    max_scan_bytes: int | None = None
    max_scan_overfetch_bytes: int | None = None

    def within(self, other: RuntimeLimits | None) -> RuntimeLimits:
        """The tighter of each pair of limits."""
        if other is None:
            return self
        tight = {}
        for name in self.__dataclass_fields__:
            both = [x for x in (getattr(self, name), getattr(other, name)) if x is not None]
            tight[name] = min(both) if both else None
        return RuntimeLimits(**tight)


@dataclass(frozen=True)
class QueryOptions:
    include_explain: bool = False
    collect_metrics: bool = True
    page: ResultPage | None = None
    limits: RuntimeLimits | None = None
    #: Capabilities that the caller relies on; restricted targets check them.
    needs: frozenset[CapabilityKey] = frozenset()


@dataclass(frozen=True)
class QueryRequest:
    table_uri: str
    sql: str
    snapshot_version: int | None = None
    preferred_target: Target = Target.NATIVE
    options: QueryOptions = field(default_factory=QueryOptions)


@dataclass(frozen=True)
class ScanMetrics:
    files_touched: int = 0
    files_skipped: int = 0
    bytes_planned: int = 0
    rows_emitted: int | None = None


@dataclass(frozen=True)
class QueryResult:
    frame: Any
    metrics: ScanMetrics | None
    explain: list[str]
    capabilities: dict[CapabilityKey, CapabilityState]
