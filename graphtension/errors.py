"""Errors raised on the driver while a plan is being built or a handle is misused."""


class GraphTensionError(Exception):
    """Base of all errors of this package."""


class InvalidEvent(GraphTensionError, ValueError):
    """A batch holds events that fail validation."""


class InvalidConfig(GraphTensionError, ValueError):
    """A configuration value or an export format is not acceptable."""


class NodeNotFound(GraphTensionError, KeyError):
    """A node-level analysis was asked for a node that is not in the graph."""


class SnapshotClosed(GraphTensionError, RuntimeError):
    """A snapshot was used after close()."""


class EngineRunning(GraphTensionError, RuntimeError):
    """start() was called on a running engine."""


class EngineStopped(GraphTensionError, RuntimeError):
    """stop() was called on an engine that does not run."""


class NotConverged(GraphTensionError, ArithmeticError):
    """An iteration didn't reach its tolerance within its rounds."""
