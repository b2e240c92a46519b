from . import breaker, waits

__all__ = ["breaker", "waits"]
