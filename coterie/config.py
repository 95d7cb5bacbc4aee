"""Parameters of the pipeline as frozen dataclasses on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Link:
    """An identifier column that ties customers: its prior weight and the most customers that may share a value."""

    column: str
    prior: float
    max_df: int


#: Link columns from the strongest to the weakest.
LINKS = (
    Link("card_fingerprint", 1.00, 8),
    Link("device_fingerprint", 0.85, 25),
    Link("shipping_address_hash", 0.75, 35),
    Link("contact", 0.70, 6),
    Link("email_root", 0.65, 12),
    Link("ip", 0.35, 15),
)
#: The links of the public card data.
CARD_DATA_LINKS = (
    Link("card_fingerprint", 1.00, 40),
    Link("device_fingerprint", 0.85, 60),
    Link("shipping_address_hash", 0.60, 60),
    Link("email_root", 0.20, 25),
)


@dataclass(frozen=True)
class GraphConfig:
    links: tuple[Link, ...] = LINKS
    window_days: int = 45
    min_weight: float = 0.08
    max_degree: int = 500
    whole_below: int = 14
    whole_density: float = 0.40
    resolution: float = 0.92
    first_as_of: int = 0
    last_as_of: int = 149

    def __post_init__(self):
        if not 0 < self.resolution <= 1:
            raise ValueError("a resolution above 1 shatters tight groups; it must lie in (0, 1]")
        if self.window_days < 1 or self.last_as_of < self.first_as_of:
            raise ValueError("the window and the span of days must not be empty")


@dataclass(frozen=True)
class Splits:
    train: tuple[int, int] = (0, 89)
    val: tuple[int, int] = (90, 109)
    test: tuple[int, int] = (110, 149)


@dataclass(frozen=True)
class Profile:
    """What differs between sources: links, splits, and how much a fraud weighs in training."""

    links: tuple[Link, ...] = LINKS
    splits: Splits = field(default_factory=Splits)
    positive_weight: float = 6.0


#: The sources that differ from the default.
PROFILES = {
    "cards": Profile(CARD_DATA_LINKS, Splits((0, 119), (120, 149), (150, 181)), 3.0),
    "orders": Profile(splits=Splits((0, 1199), (1200, 1599), (1600, 2404))),
    "events": Profile(splits=Splits((0, 17), (18, 21), (22, 29))),
}


@dataclass(frozen=True)
class Maturity:
    dispute_window: int = 45
    as_of: int = 150


@dataclass(frozen=True)
class Costs:
    """Parameters of the cost curve; amounts in major units."""

    chargeback_fee: float = 1500.0
    recovery_rate: float = 0.12
    margin: float = 0.28
    churn_factor: float = 2.6
    review_cost: float = 45.0
    review_from: float = 0.35


@dataclass(frozen=True)
class Config:
    graph: GraphConfig = field(default_factory=GraphConfig)
    splits: Splits = field(default_factory=Splits)
    maturity: Maturity = field(default_factory=Maturity)
    costs: Costs = field(default_factory=Costs)
