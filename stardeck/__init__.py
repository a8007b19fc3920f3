"""Analytics over sensor frames, stars, sky catalogues and exposure streams, as Spark relations."""
