"""Fixed values that results depend on."""

# blockage physics
VOLUME_COEFFICIENT = 0.146
VOLUME_EXPONENT = 1.332
HEIGHT_EXPONENT = 1.0 / 3.0
DBI_STABLE_BELOW = 2.75
DBI_UNCERTAIN_UPTO = 3.08
VERDICT_BASE = {"stable": 0.05, "uncertain": 0.4, "breach_risk": 1.0}

# exposure
ASSET_WEIGHTS = {"bridge": 0.95, "health": 0.90, "power": 0.90, "school": 0.85, "settlement": 0.80, "road": 0.60, "building": 0.50}
OTHER_WEIGHT = 0.5
LATERAL_KM = 1.0
DECAY_KM = 8.0
EXPOSURE_RADIUS_KM = 10.0
EXPOSURE_ROWS = 50
HEALTH_AMENITIES = ("hospital", "clinic", "health_post", "doctors")
PLACES = ("city", "town", "village", "hamlet")

# terrain
RELIEF_WINDOW_KM = 1.0
METRES_PER_DEG = 111320.0
KM_PER_DEG = 111.32
WALK_KM = 20.0
CHANNEL_THRESHOLD = 1000
#: D8 code: (row step, column step), clockwise from north.
D8 = {64: (-1, 0), 128: (-1, 1), 1: (0, 1), 2: (1, 1), 4: (1, 0), 8: (1, -1), 16: (0, -1), 32: (-1, -1)}
POINT_MISMATCH_KM = 1.0

# rasters
NDWI_THRESHOLD = 0.0
MIN_CONTOUR_AREA_PX = 10.0
APPROX_FRACTION = 0.005
GREEN_BAND, NIR_BAND = 2, 4
STRETCH = (0.02, 0.98)
STRETCH_EPSILON = 1e-9
MASK_ABOVE = 127
REFLECTANCE_SCALE, REFLECTANCE_OFFSET = 0.0000275, -0.2

# detection
DEFAULT_GSD_M_PER_PX = 10.0
LANDSAT_GSD_M_PER_PX = 30.0
CONFIDENCE = 0.25
WEAKER_CONFIDENCES = (0.05, 0.01)
STUB_CENTRE, STUB_RADIUS, STUB_CONFIDENCE = (0.55, 0.5), (0.22, 0.16), 0.87
#: Corners of the stub's hexagon, in radii from its centre.
STUB_CORNERS = ((-1.0, -0.3), (-0.4, -1.0), (0.5, -0.6), (1.0, 0.2), (0.3, 1.0), (-0.6, 0.7))

# dataset hygiene
HASH_BITS = 5
SPLIT_TARGETS = {"train": 230, "validation": 35, "test": 10}
AUDIT_SAMPLE = 30
SPLIT_ORDER = ("train", "validation", "test")
