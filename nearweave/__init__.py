"""nearweave: k-nearest-neighbour graphs over large collections of dense vectors, on Spark."""
