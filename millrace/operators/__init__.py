from . import joins, schema, steps, stores

__all__ = ["joins", "schema", "steps", "stores"]
