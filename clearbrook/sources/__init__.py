from .files import get_adapter, load, register_adapter, save

__all__ = ["get_adapter", "load", "register_adapter", "save"]
