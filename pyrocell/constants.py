"""Well-known column names."""

POLYGON_ID = "polygonID"
PIXEL_ID = "pixelID"
YEAR = "year"
YOUNG_AGE = "youngAge"
IGNITIONS = "ignitions"
ESCAPES = "escapes"
NOT_COVARIATES = (POLYGON_ID, PIXEL_ID)
