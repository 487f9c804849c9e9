"""A bounded memory of what a worker has computed."""

from __future__ import annotations


class Kept:
    """A bounded map in two generations: entries not used while the younger one fills are dropped."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def missing(self, keys: set) -> set:
        """The keys that aren't kept; the others are in the younger generation afterwards."""
        lost = keys.difference(self.young)
        back = lost.intersection(self.old)
        for key in back:
            self.young[key] = self.old[key]
        return lost - back

    def turn(self) -> None:
        """Ends a step; in a step the younger generation may outgrow its bound by what the step needs."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
