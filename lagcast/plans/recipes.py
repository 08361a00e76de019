"""What each model is made of."""

from dataclasses import dataclass, replace

from lagcast import fixed
from lagcast.operators.trees import gbt, rf


@dataclass(frozen=True)
class Recipe:
    """Columns, features, weighting and trees of one model."""

    columns: str
    layout: str
    categories: tuple[str, ...]
    trees: str
    size: int
    invalid: str
    indicators: bool = False
    weighting: str | None = None
    scheme: str = "service"

    @property
    def weight_col(self) -> str | None:
        return {"ratio": "classWeight", "balanced": "class_weight", None: None}[self.weighting]

    def estimator(self, **params):
        """The tree estimator, untouched by earlier uses of the recipe."""
        if self.trees == "forest":
            return rf(self.weight_col, trees=self.size, **params)
        return gbt(self.weight_col, rounds=self.size, **params)

    def sized(self, size: int) -> "Recipe":
        """The same recipe with another number of trees or rounds."""
        return replace(self, size=size)


RECIPES = {
    "baseline": Recipe(
        "V1", "L1", ("Origin",), "forest", fixed.FOREST_TREES["baseline"],
        invalid="error", indicators=True, weighting="ratio", scheme="alert",
    ),
    "carrier": Recipe(
        "V2", "L2", ("Origin", "Carrier"), "forest", fixed.FOREST_TREES["carrier"],
        invalid="error", weighting="ratio", scheme="three",
    ),
    "route": Recipe(
        "V3", "L3", ("Origin", "Dest", "Carrier"), "boosted", fixed.BOOSTED_ROUNDS["route"],
        invalid="keep", scheme="extreme",
    ),
    "balanced": Recipe(
        "V3", "L3", ("Origin", "Dest", "Carrier"), "boosted", fixed.BOOSTED_ROUNDS["balanced"],
        invalid="keep", weighting="balanced", scheme="extreme",
    ),
    "service": Recipe(
        "V3", "L3", ("Origin", "Dest", "Carrier"), "boosted", fixed.BOOSTED_ROUNDS["service"],
        invalid="keep", scheme="service",
    ),
}
