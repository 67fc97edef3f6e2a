"""graphtension: anomaly analytics over event-derived graphs, as DataFrame plans."""

from graphtension.config import Config
from graphtension.errors import GraphTensionError, InvalidConfig, InvalidEvent, NodeNotFound, SnapshotClosed

__all__ = ["Config", "GraphTensionError", "InvalidConfig", "InvalidEvent", "NodeNotFound", "SnapshotClosed"]
