from twinstring.operators.index import NeighborIndex
from twinstring.operators.join import neighbors_across, neighbors_within

__all__ = ["NeighborIndex", "neighbors_across", "neighbors_within"]
