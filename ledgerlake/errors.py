"""Error classes. Each carries the ``code`` that error columns use."""


class StoreError(Exception):
    code = "error"


def _kind(name: str, code: str, base: type = StoreError) -> type:
    return type(name, (base,), {"code": code})


ClosedError = _kind("ClosedError", "closed")
KeyNotFoundError = _kind("KeyNotFoundError", "not_found")
InvalidOptionError = _kind("InvalidOptionError", "invalid_option")
EmptyFlushError = _kind("EmptyFlushError", "empty_flush")
FlushFailedError = _kind("FlushFailedError", "flush_failed")
CancelledError = _kind("CancelledError", "cancelled")
ReadOnlyError = _kind("ReadOnlyError", "read_only")
FencedError = _kind("FencedError", "fenced")
IteratorClosedError = _kind("IteratorClosedError", "iterator_closed", ClosedError)
InjectedFaultError = _kind("InjectedFaultError", "injected_fault")

CodecError = _kind("CodecError", "corrupt")
CorruptKeyError = _kind("CorruptKeyError", "corrupt_key", CodecError)
CorruptBatchError = _kind("CorruptBatchError", "corrupt_batch", CodecError)
BatchVersionError = _kind("BatchVersionError", "bad_version", CodecError)
UnknownOpError = _kind("UnknownOpError", "unknown_op", CodecError)
TruncatedBatchError = _kind("TruncatedBatchError", "truncated_batch", CodecError)
UnknownTagError = _kind("UnknownTagError", "unknown_tag", CodecError)
TruncatedEditError = _kind("TruncatedEditError", "truncated_edit", CodecError)
FieldTooLargeError = _kind("FieldTooLargeError", "field_too_large", CodecError)
CorruptBlockError = _kind("CorruptBlockError", "corrupt_block", CodecError)
CorruptIndexError = _kind("CorruptIndexError", "corrupt_index", CodecError)
CorruptFooterError = _kind("CorruptFooterError", "corrupt_footer", CodecError)
ChecksumError = _kind("ChecksumError", "checksum", CodecError)
KeyOrderError = _kind("KeyOrderError", "key_order", CodecError)

RecordError = _kind("RecordError", "corrupt_record", CodecError)
TruncatedRecordError = _kind("TruncatedRecordError", "truncated", RecordError)
RecordMagicError = _kind("RecordMagicError", "bad_magic", RecordError)
RecordVersionError = _kind("RecordVersionError", "bad_version", RecordError)
RecordTypeError = _kind("RecordTypeError", "bad_type", RecordError)
RecordTooLargeError = _kind("RecordTooLargeError", "too_large", RecordError)
RecordChecksumError = _kind("RecordChecksumError", "checksum", RecordError)

CorruptLogError = _kind("CorruptLogError", "corrupt_log")
CorruptManifestError = _kind("CorruptManifestError", "corrupt_manifest")
DuplicateFileError = _kind("DuplicateFileError", "duplicate_file", CorruptManifestError)
MissingFileError = _kind("MissingFileError", "missing_file", CorruptManifestError)
NoPointerError = _kind("NoPointerError", "no_pointer")
PointerNameError = _kind("PointerNameError", "bad_pointer_name")
