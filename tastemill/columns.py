"""Column naming shared by the rating operators."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class RatingColumns:
    """Names of the rating columns.

    ``ties`` lists further columns which, appended to ``time``, make the order
    of one user's ratings total. Without them two ratings given in the same
    second would sort differently from run to run.
    """

    user: str = "userId"
    item: str = "movieId"
    rating: str = "rating"
    time: str = "timestamp"
    ties: tuple[str, ...] = field(default_factory=tuple)

    @property
    def order(self) -> list[str]:
        """Ascending order of one user's ratings."""
        tail = self.ties or (self.item, self.rating)
        return [self.time, *tail]

    @property
    def all(self) -> list[str]:
        """Every column, each once."""
        return list(dict.fromkeys([self.user, self.item, self.rating, self.time, *self.ties]))
