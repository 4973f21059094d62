"""Default settings and fixed values of the retail model."""

# Dataset layout and required columns.
DATA_TYPES = ["promotions", "sales", "customer_traffic", "store_events", "inventory"]
REQUIRED_COLUMNS = ["date", "store_id", "product_id", "quantity_sold", "revenue"]
TARGET = "sales"
DATE = "date"

# Feature settings.
DATE_FEATURES = [
    "year", "month", "day", "dayofweek", "quarter", "weekofyear", "is_weekend", "is_holiday",
]
LAGS = [1, 2, 3, 7, 14, 21, 30]
ROLLING_WINDOWS = [3, 7, 14, 21, 30]
ROLLING_FUNCTIONS = ["mean", "std", "min", "max", "median"]
CYCLES = {"day": 31, "month": 12, "dayofweek": 7}

# Validation and training settings.
VALUE_RANGES = {"sales": (0.0, 1000000.0)}
TRAIN_SIZE = 0.7
VAL_SIZE = 0.15
TUNING_TRIALS = 30
EARLY_STOP = 50
SEED = 42
SAMPLE_ROWS = 1000

# Demand model.
WEEKDAY_FACTORS = [0.9, 0.85, 0.85, 0.9, 1.1, 1.3, 1.2]  # Monday first
SIZE_FACTORS = {"large": 1.0, "medium": 0.7, "small": 0.5}
HOLIDAY_TRAFFIC_FACTOR = 1.3
CONVERSION_RATE = 0.003
PROMOTION_MULTIPLIER = 3.0
WEATHER_BOUNDS = (0.5, 1.2)

# Yearly promotion events as (name, month, day, duration, discount).
# A day of None marks the Friday after the fourth Thursday of the month.
PROMOTION_EVENTS = [
    ("Black Friday", 11, None, 5, 0.25),
    ("Cyber Monday", 11, 4, 2, 0.20),
    ("Christmas Sale", 12, 15, 10, 0.15),
    ("New Year Sale", 1, 1, 7, 0.20),
    ("Presidents Day", 2, 15, 3, 0.15),
    ("Memorial Day", 5, 25, 3, 0.15),
    ("July 4th Sale", 7, 1, 5, 0.15),
    ("Labor Day", 9, 1, 3, 0.15),
    ("Back to School", 8, 1, 14, 0.10),
]

# Interval width as (confidence level, z score) and the assumed relative deviation.
Z_SCORES = {"0.8": 1.28, "0.95": 1.96}
RELATIVE_DEVIATION = 0.1

# Thresholds of the diagnostic checks.
SHIFT_LIMIT = 0.2
LEAKAGE_LIMIT = 0.95
ZERO_SHARE_LIMIT = 0.1
MIN_TRAINING_ROWS = 1000
MAX_FEATURES = 50
MIN_ENSEMBLE_WEIGHT = 0.2

# Model comparison, metric name to direction, and the deciding metrics.
COMPARED_METRICS = {"rmse": "lower", "mae": "lower", "r2": "higher"}
KEY_METRICS = ["rmse", "mae"]
IMPROVEMENT_THRESHOLD = 0.01
