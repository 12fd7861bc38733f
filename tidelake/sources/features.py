"""Delta protocol features: which a table has, and what the engine does about them."""

from __future__ import annotations

import json
from dataclasses import dataclass

from tidelake.contract import CapabilityKey, CapabilityState, ErrorCode, QueryError

SUPPORTED, NATIVE_ONLY, TERMINAL = "supported", "native_only", "terminal"

# Fixed values of the protocol: name, class, least reader version (0: writer-only feature),
# least writer version, what switches it on (a table property, or a rule below).
FEATURES = (
    ("appendOnly", TERMINAL, 0, 2, "delta.appendOnly"),
    ("invariants", TERMINAL, 0, 2, "@invariants"),
    ("checkConstraints", TERMINAL, 0, 3, "@constraints"),
    ("changeDataFeed", NATIVE_ONLY, 0, 4, "delta.enableChangeDataFeed"),
    ("generatedColumns", TERMINAL, 0, 4, "@generated"),
    ("identityColumns", TERMINAL, 0, 6, "@identity"),
    ("inCommitTimestamp", TERMINAL, 0, 7, "delta.enableInCommitTimestamps"),
    ("rowTracking", TERMINAL, 0, 7, "@row_tracking"),
    ("domainMetadata", TERMINAL, 0, 7, "@always"),
    ("icebergCompatV1", TERMINAL, 0, 7, "delta.enableIcebergCompatV1"),
    ("icebergCompatV2", TERMINAL, 0, 7, "delta.enableIcebergCompatV2"),
    ("clustering", TERMINAL, 0, 7, "@always"),
    ("materializePartitionColumns", TERMINAL, 0, 7, "@always"),
    ("catalogManaged", TERMINAL, 3, 7, "@always"),
    ("catalogOwned-preview", TERMINAL, 3, 7, "@always"),
    ("columnMapping", NATIVE_ONLY, 2, 5, "@column_mapping"),
    ("deletionVectors", NATIVE_ONLY, 3, 7, "delta.enableDeletionVectors"),
    ("timestampNtz", NATIVE_ONLY, 3, 7, "@always"),
    ("typeWidening", TERMINAL, 3, 7, "delta.enableTypeWidening"),
    ("typeWidening-preview", TERMINAL, 3, 7, "delta.enableTypeWidening"),
    ("v2Checkpoint", SUPPORTED, 3, 7, "@always"),
    ("vacuumProtocolCheck", TERMINAL, 3, 7, "@always"),
    ("variantType", TERMINAL, 3, 7, "@always"),
    ("variantType-preview", TERMINAL, 3, 7, "@always"),
    ("variantShredding-preview", TERMINAL, 3, 7, "@always"),
)


@dataclass(frozen=True)
class Protocol:
    reader: int
    writer: int
    reader_features: frozenset[str]
    writer_features: frozenset[str]


def _fields(schema: dict):
    """Every field of a schema at any depth."""
    waiting = [schema]
    while waiting:
        kind = waiting.pop()
        if not isinstance(kind, dict):
            continue
        for f in kind.get("fields", []):
            yield f
            waiting.append(f.get("type"))
        waiting += [kind.get(k) for k in ("elementType", "keyType", "valueType")]


def _on(value: str | None) -> bool:
    return (value or "").lower() == "true"


def _switched_on(switch: str, schema: dict, properties: dict[str, str]) -> bool:
    notes = [f.get("metadata", {}) for f in _fields(schema)]
    if switch == "@always":
        return True
    if switch == "@invariants":
        return any("delta.invariants" in m for m in notes)
    if switch == "@generated":
        return any("delta.generationExpression" in m for m in notes)
    if switch == "@identity":
        return any(k.startswith("delta.identity.") for m in notes for k in m)
    if switch == "@constraints":
        return any(k.startswith("delta.constraints.") for k in properties)
    if switch == "@column_mapping":
        return properties.get("delta.columnMapping.mode", "none").lower() != "none"
    if switch == "@row_tracking":
        return _on(properties.get("delta.enableRowTracking")) and not _on(properties.get("delta.rowTrackingSuspended"))
    return _on(properties.get(switch))


def enabled(protocol: Protocol, schema_json: str, properties: dict[str, str]) -> dict[str, str]:
    """name -> class of the features that the table uses.

    From reader version 3 and writer version 7 a feature counts if it is listed;
    below them, if the version covers it. A reader-writer feature needs both.
    """
    schema, out = json.loads(schema_json), {}
    for name, kind, reader, writer, switch in FEATURES:
        covered = name in protocol.writer_features if protocol.writer >= 7 else protocol.writer >= writer
        if reader:
            covered &= name in protocol.reader_features if protocol.reader >= 3 else protocol.reader >= reader
        if covered and _switched_on(switch, schema, properties):
            out[name] = kind
    return out


def unknown(protocol: Protocol) -> list[str]:
    known = {f[0] for f in FEATURES}
    listed = (protocol.reader_features if protocol.reader >= 3 else frozenset()) | (protocol.writer_features if protocol.writer >= 7 else frozenset())
    return sorted(listed - known)


def capabilities(protocol: Protocol, schema_json: str, properties: dict[str, str], deletion_vectors: bool) -> dict[CapabilityKey, CapabilityState]:
    """The capability report; raises UnsupportedFeature for what the engine can't read."""
    K, S = CapabilityKey, CapabilityState
    report = {k: S.UNSUPPORTED for k in K} | {k: S.SUPPORTED for k in (K.MULTI_PARTITION_EXECUTION, K.RANGE_READS, K.TIME_TRAVEL)}
    used = enabled(protocol, schema_json, properties)
    if hard := sorted(n for n, kind in used.items() if kind == TERMINAL):
        raise QueryError(ErrorCode.UNSUPPORTED_FEATURE, f"the table uses unsupported Delta features: {', '.join(hard)}")
    fields = list(_fields(json.loads(schema_json)))
    present = (
        (K.CHANGE_DATA_FEED, "changeDataFeed" in used),
        (K.COLUMN_MAPPING, "columnMapping" in used or any("delta.columnMapping.id" in f.get("metadata", {}) for f in fields)),
        (K.DELETION_VECTORS, deletion_vectors or "deletionVectors" in used),
        (K.TIMESTAMP_NTZ, any("timestamp_ntz" in json.dumps(f.get("type")) for f in fields)),
        (K.UNKNOWN_PROTOCOL_FEATURES, bool(unknown(protocol))),
    )
    for key, there in present:
        if there:
            report[key] = S.UNSUPPORTED if key is K.UNKNOWN_PROTOCOL_FEATURES else S.EXPERIMENTAL
    for key, there in present:
        if there:
            raise QueryError(ErrorCode.UNSUPPORTED_FEATURE, f"the table requires {key.value}, which is {report[key].value}", capability=key)
    return report
