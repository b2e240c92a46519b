from .mission import Action, Mission, Stage

__all__ = ["Action", "Mission", "Stage"]
