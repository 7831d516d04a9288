"""Errors of the neighbour operators. All are ``ValueError`` so callers can catch one type."""


class NeighborError(ValueError):
    """Base of every input error raised here."""


# The texts of the messages are part of the interface.


class NonAsciiError(NeighborError):
    def __init__(self, position: int, text: str, side: str = "query"):
        super().__init__(f"non-ASCII input currently unsupported ('{text}' at {position})")
        self.position, self.text, self.side = position, text, side


class NullStringError(NeighborError):
    def __init__(self, count: int, side: str = "query"):
        super().__init__(f"{side} holds {count} rows whose id or string is null")
        self.count, self.side = count, side


class DistanceCapError(NeighborError):
    def __init__(self, got: int):
        super().__init__(f"max_distance is capped at 254, got {got}")
        self.got = got


class CacheDistanceError(NeighborError):
    def __init__(self, limit: int, got: int):
        super().__init__(
            f"CachedRef instance not compatible with max_distance above {limit}, got {got}"
        )
        self.limit, self.got = limit, got


class TooManyStringsError(NeighborError):
    """More strings than the 32-bit positions of numpy results can number."""

    def __init__(self, side: str, limit: int, got: int):
        super().__init__(f"{side} must not hold more than {limit} elements, got {got}")


class VariantBudgetError(NeighborError):
    def __init__(self, side: str, limit: int, got: float):
        super().__init__(
            f"{side} has a string with about {got:.3g} deletion variants, over the limit of {limit};"
            " lower max_distance or raise variant_limit"
        )
