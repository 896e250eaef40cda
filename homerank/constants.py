"""Fixed values of the market model."""

# Rates, limits and weights of the ranking.
TABDIL_RATE = 0.03
CITY = {"min_lat": 35.55, "max_lat": 35.85, "min_lon": 51.10, "max_lon": 51.60}
ZONE = {"min_lat": 35.70, "max_lat": 35.735, "min_lon": 51.39, "max_lon": 51.435}
WALK_M_PER_MIN = 80.0
METERS_PER_DEGREE = 111_320.0
EARTH_KM = 6371.0
BUDGET_CEILING = 1.20
BUDGET_TOLERANCE = 1.15
AREA_BAND = 0.08
LEAST_SCORE = 0.45
HEAD_ROWS = 60
STORED_ROWS = 600
MIN_DEPOSIT_FRACTION = 0.20
WEIGHTS = {"budget": 0.26, "value": 0.12, "area": 0.16, "amenity": 0.09, "metro": 0.07, "commute": 0.07, "quality": 0.10, "freshness": 0.06, "soft": 0.07}
AMENITIES = {"has_parking": 0.40, "has_elevator": 0.35, "has_storage": 0.15, "has_balcony": 0.10}
FINANCIAL_DECAY = 5.0
VALUE_CAP = 1.2
BASEMENT_PENALTY = 0.80
LIFT_TOP_FLOOR = 7
LIFT_STRENGTH, LIFT_STRENGTH_ASKED, LIFT_MOST = 0.30, 0.60, 0.85
FRESHNESS_YEARS = 15.0
METRO_K, METRO_MIDPOINT = 0.25, 8.0
PLACEHOLDER_TMC, PLACEHOLDER_PER_SQM = 1_000_000, 100_000
FULL_DEPOSIT_RENT = 100_000
CELL_DEGREES = 0.01
FLOOR_SAMPLES, FLOOR_LOW, FLOOR_HIGH, FLOOR_MADS = 12, 0.12, 0.35, 3.0
BASELINE_SAMPLES = 5
AREA_LIMITS = (15, 2000)
FULL_SHRINK = 8
ACCESS_WALK_M, TRANSFER_WALK_M, STOP_MERGE_M = 1_500.0, 700.0, 150.0
RIDE_MINS = {"metro": 2.5, "brt": 2.0}
BRT_WAIT, METRO_WAIT, METRO_CHANGE = 5.0, 4.0, 1.0
METRO_WAIT_BY_LINE = {"1": 4.0, "2": 4.0, "3": 4.0, "4": 4.0, "5": 6.0, "6": 7.5, "7": 6.0}
DRIVE_KMH, CONGESTION = 22.0, 1.4
PRESTIGE_WEIGHT, MODERNITY_WEIGHT, PRIOR_SAMPLES = 0.72, 0.28, 5
QUOTA_POWER, LEAST_QUOTA, MOST_QUOTA, QUOTA_PASSES, RATE_DAYS = 0.75, 8, 400, 6, 14
TRADE_AREA, TRADE_BUDGET_PERCENT, TRADE_WALK, TRADE_WEIGHT = 0.25, 10, 7.0, 0.08
OPEN_CELL_ROWS, MOST_PINS, OPEN_ZOOM = 30, 400, 16
COMMUTE_K, COMMUTE_IMPORTANCE, MAX_COMMUTE = 0.20, 0.5, 45
IMPORTANCE = {"low": 0.4, "normal": 1.0, "high": 2.2}
NEUTRAL_QUALITY = 0.5
AREA_NEAR_M, AREAS_NEAR, MOST_AREA_KEYS = 700.0, 4, 60
LEAST_GAP_SQKM = 0.15
SAME_PLACE_M, SEAM_M = 60.0, 25.0
EMBEDDING_BUCKETS = 256
BM25_K1, BM25_B, TEXT_HITS = 1.2, 0.75, 500
