"""Default parameters. They must be equal across runs for results to be comparable."""

HORIZON_BARS = 120
ENTRY_MAX_DELAY_MIN = 15
LABEL_QUANTILES = (0.10, 0.35, 0.65, 0.90)

RSI_PERIOD = 14
MACD_FAST, MACD_SLOW, MACD_SIGNAL = 12, 26, 9
BB_PERIOD, BB_STD = 20, 2.0
ATR_PERIOD = 14
MIN_HOURLY_BARS = 30
MIN_REGULAR_BARS = 500
VOL_SHORT_DAYS, VOL_LONG_DAYS = 5, 60
SMA_FAST, SMA_SLOW = 50, 200

SIGMA_WARMUP_BARS, SIGMA_STEP_BARS, SIGMA_MIN_ANCHORS = 60, 30, 30

NEAR_DUP_PREFIX, NEAR_DUP_MINUTES = 48, 10
STORY_MINUTES = 15
MAX_RETRIEVAL_LAG_MIN = 60
CA_SUPPRESSION_SESSIONS = 60

SLIPPAGE_BPS = 3
STOP_ATR_MULTIPLE = 1.0

HOLDOUT_EMBARGO_DAYS, CV_FOLDS, INITIAL_TRAIN_DAYS = 1, 3, 30
PRECISION_FLOOR = {"Sell": 0.55, "Buy": 0.50, "Strong Buy": 0.45}
MIN_FIRE_RATE, MAX_FIRE_RATE = 0.01, 0.05

STUDY_HORIZONS = (5, 20, 60)
HALT_GAP_DAYS = 15
BETA_WINDOW, BETA_MIN_EVENT, BETA_MIN_ROLLING = 250, 30, 100
EXCLUSION_DAYS, CLUSTER_DAYS = 30, 30

CLASSES_5 = ("Strong Sell", "Sell", "Neutral", "Buy", "Strong Buy")
CLASSES_4 = ("Sell", "Neutral", "Buy", "Strong Buy")
MERGE_5_TO_4 = (0, 0, 1, 2, 3)
DECISION_PRIORITY = ("Strong Buy", "Buy", "Sell")
LONG_CLASSES = ("Buy", "Strong Buy")

THIN_N = 30
MIN_ACTIVE_DAYS, MIN_FIRED = 40, 300
