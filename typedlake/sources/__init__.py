"""Where tables come from and where new rows go."""

from .tables import Batch, Raw, Workspace, load, publish

__all__ = ["Batch", "Raw", "Workspace", "load", "publish"]
