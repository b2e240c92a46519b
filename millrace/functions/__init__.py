from .semantics import Semantics

__all__ = ["Semantics"]
