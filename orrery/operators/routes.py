"""Routes: named scoring functions from DataFrames to DataFrames, with a control and a map function each."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

Score = Callable[..., DataFrame]


@dataclass(frozen=True)
class Route:
    """``score(queries, bank, **settings)`` gives a score a row; ``control`` the same without what the route claims to
    use; ``maps`` turns scores into maps."""

    name: str
    score: Score
    control: Score | None = None
    maps: Callable[[DataFrame], DataFrame] | None = None
    settings: dict = field(default_factory=dict)


_ROUTES: dict[str, Route] = {}


def register(route: Route) -> Route:
    if route.name in _ROUTES:
        raise ValueError(f"route {route.name} is taken")
    _ROUTES[route.name] = route
    return route


def spec(name: str) -> Route:
    if name not in _ROUTES:
        raise KeyError(f"no route {name}; there are {', '.join(sorted(_ROUTES))}")
    return _ROUTES[name]


def evaluate(name: str, queries: DataFrame, bank: DataFrame, labels: DataFrame, key: str, metric: Callable[[DataFrame], DataFrame], control: bool = False, **settings) -> DataFrame:
    """``metric`` of the route's scores, which meet ``labels(key, ...)`` only after they are made."""
    route = spec(name)
    score = route.control if control else route.score
    if score is None:
        raise ValueError(f"route {name} has no control")
    scores = score(queries, bank, **{**route.settings, **settings})
    scores = route.maps(scores) if route.maps else scores
    return metric(scores.join(labels, key))
