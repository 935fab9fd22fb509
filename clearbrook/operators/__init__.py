from .transforms import get_transformer, narrow, register_transformer, run_transformer, transform

__all__ = ["get_transformer", "narrow", "register_transformer", "run_transformer", "transform"]
