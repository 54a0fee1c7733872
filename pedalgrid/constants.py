"""Default parameters of the operators.

Fixed values: thresholds, codes and label texts that results must agree on.
Every operator takes them as keyword arguments; change them there, not here.
"""

# observation grid
BUCKET_MINUTES = 5
COVERAGE_CAP_MINUTES = 15
STALE_AFTER_SECONDS = 3600
BUCKETS_PER_HOUR = 12
LOCAL_ZONE = "America/Los_Angeles"

# event labels
NO_OBSERVATION = "no_observation"
FEED_ARTIFACT = "feed_artifact"
VAN_DROPOFF = "inferred_truck_dropoff"
VAN_PICKUP = "inferred_truck_pickup"
RIDER_CHURN = "rider_churn"
IDLE = "idle"
VAN_PREFIX = "inferred_truck"
VAN_MIN_BIKES = 5
VAN_SWEEP = (3, 4, 5, 6, 8, 10)

# surprise-based van thresholds
SURPRISE_ALPHA = 1e-4
SURPRISE_FLOOR = 3
SURPRISE_CAP = 60
CALIBRATION_ROUNDS = 6
ACTIVITY_BANDS = (
    ("no demand at all", -1.0, 0.001),
    ("quiet (<0.5/hr)", 0.001, 0.5),
    ("moderate (0.5-2/hr)", 0.5, 2.0),
    ("busy (>2/hr)", 2.0, 1e9),
)

# demand
SHRINK_BUCKETS = 12
MIN_AVAILABILITY = 0.15
MIN_EXPOSED_BUCKETS = 6

# outages and health
OUTAGE_MIN_MINUTES = 15
OUTAGE_MIN_DEMAND = 0.10
OUTAGE_SWEEP = (5, 10, 15, 30, 60)
CONCENTRATION_TARGETS = (0.25, 0.50, 0.80)
ACTION_WINDOW_MINUTES = 60

# forecast
HORIZONS_MINUTES = (15, 30, 60, 120, 240)
TRAIN_SHARE = 0.7
MIN_POSITIVES = 50
BOOSTING_ROUNDS = 120

# dispatch
DISPATCH_WINDOW_MINUTES = 60
EPOCH_MINUTES = 30
VAN_CAPACITY = 20
HANDLING_MINUTES = 6.0
VAN_SPEED_KMH = 18.0
SHIFT_MINUTES = 60.0
FLEET_SIZES = (0, 1, 2, 4, 8)
EARTH_RADIUS_KM = 6371.0

# export frames
FRAME_STRIDE = 2
EXPORT_DAYS = 7
RUNWAY_DOOMED_MINUTES = 60
RUNWAY_WATCH_MINUTES = 180
EBIKE_CAP = 35
PULSE_FRAMES = 4

# vehicles
MOVE_METERS = 25.0
RANGE_METERS = 150

# collection audit
SLOT_SECONDS = 300
COVERAGE_GATE_PCT = 98.0
GATE_DAYS = 7
KEEP_DAYS = 14
FRESHNESS_TOLERANCE_MINUTES = 90

# the inventory fields whose change makes a new log row
STATE_FIELDS = (
    "num_bikes_available",
    "num_ebikes_available",
    "num_bikes_disabled",
    "num_docks_available",
    "num_docks_disabled",
    "is_installed",
    "is_renting",
    "is_returning",
)
