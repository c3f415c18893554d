"""What can go wrong, by the code that callers see."""


class EngineError(Exception):
    code = "error"


class ContractError(EngineError):
    code = "validation_error"


class MappingError(EngineError):
    code = "invalid_mapping"


class FileError(EngineError):
    code = "invalid_file"


class TooLargeError(EngineError):
    code = "file_too_large"


class NotFoundError(EngineError):
    code = "not_found"


class StateError(EngineError):
    code = "invalid_state"


class ConflictError(EngineError):
    code = "conflict"
