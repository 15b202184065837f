"""Plain loops that tests hold results against."""

from tidewatch.sources.dims import ALERT, URGENT, WEIGHT


class Fusion:
    """The window of one platform: events of less than window_s ago; empty again once an event went out."""

    def __init__(self, held: list, window_s: int = 120):
        self.held, self.window_s = held, window_s

    def add(self, t: int, sensor: str) -> dict | None:
        self.held = [h for h in self.held if t - h[0] < self.window_s] + [(t, sensor)]
        types = sorted({s for _, s in self.held})
        weight = sum(WEIGHT.get(s, 0) for s in types)
        if weight < ALERT:
            return None
        self.held = []
        return {"weight": weight, "sources": ",".join(types), "urgent": weight >= URGENT}
