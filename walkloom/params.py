"""Fixed values of the published method, and the run parameters derived from them.

Everything here is a value that results must agree on (windows, thresholds,
default rates). Values are plain so they can be read and overridden.
"""

from __future__ import annotations

# --- fixed values: horizons and windows, counted in observation rows -------------
HORIZONS = (7, 30, 60, 90)
LONG_HORIZONS = (30, 60, 90)
ZDEV_WINDOW = 150
ZDEV_MIN_ROWS = 60
MIN_TRAIN = 300
CONFIDENT_THRESHOLD = 0.65
REV_MEAN_WINDOW = 120
VOL_WINDOW = 60
Z_WINDOW = 60
WARMUP = 120
BREAKOUT_WINDOW = 60
EXTREME_WINDOW = 252
EXTREME_SHARE = 0.4
REGIME_WINDOW = 252
REGIME_VOL_WINDOW = 20
REGIME_MIN_FINITE = 100
COMPOSITE_WINDOW = 500
COMPOSITE_MIN_ROWS = 200
LABEL_HORIZON = 30
FLAT_HALF_WIDTH = 0.01
JUMP_THRESHOLD = 0.20
TREND_LOOKBACK = 60
TREND_HALF_WIDTH = 0.03

# --- fixed values: gates ---------------------------------------------------------
LONG_GATE = 0.70
WEAK_GATE = 0.55
MIN_BUCKET_N = 20
GATE_MIN_CONFIRMS = 2
WEAK_Z = 0.3
LONG_POLICY = {30: "moex_z", 60: "pure_rev", 90: "extreme_dist"}
POLICIES = ("pure_rev", "moex_z", "extreme_dist", "breakout", "weak_experimental",
            "resonance_only", "dual_pool", "off")

# --- fixed values: default confidence by horizon and |z| bucket --------------------
DEFAULT_BUCKET_RATE = {
    7: {"z15": 0.79, "z10": 0.72, "z05": 0.65, "z00": 0.62},
    30: {"z15": 0.75, "z10": 0.65, "z05": 0.60, "z00": 0.56},
    60: {"z15": 0.72, "z10": 0.65, "z05": 0.60, "z00": 0.54},
    90: {"z15": 0.71, "z10": 0.62, "z05": 0.57, "z00": 0.50},
}
DEFAULT_REVERSION_RATE = {7: 0.5386, 30: 0.5775, 60: 0.657, 90: 0.7482}
REVERSION_FEATURES = ("ma60_dev", "ma20_dev", "mom20", "pos60", "implied_mom20")

# --- fixed values: buckets -------------------------------------------------------
Z7_BUCKETS = ("z00", "z05", "z10", "z15")
Z30_BUCKETS = ("z00", "z03", "z05", "z10")
REV_BUCKETS = ("strong_down", "mid_down", "weak_down", "weak_up", "mid_up", "strong_up")

# --- fixed values: projection ----------------------------------------------------
ANCHOR_SCALE = 0.0161
BAND_MULTIPLIER = {30: 1.51, 60: 1.81, 90: 2.02}
SEGMENT_POWER = 0.7

# --- fixed values: health --------------------------------------------------------
HEALTH_THRESHOLDS = {7: (0.65, 0.55), 30: (0.58, 0.50), 60: (0.59, 0.48), 90: (0.70, 0.50)}
HEALTH_WINDOW_DAYS = 365
CALIBRATION_MAX_AGE_SEC = 48 * 3600
LONG_REPORT_MAX_AGE_SEC = 7 * 24 * 3600
FORECAST_STALE_SEC = 600
REVIEW_WINDOWS = (20, 50, 100)
MODEL_VERSION = "2026.09-gate2"
SHADOW_Z_NO_GATE = "shadow-30d-z-nogate"
SHADOW_EXTREME = "shadow-60d-edist"
SHADOW_RESONANCE = "shadow-60d-resonance"

# --- fixed values: (month, day) holidays -------------------------------------------
FIXED_HOLIDAYS = ("01-01", "01-02", "01-03", "01-04", "01-05", "01-06", "01-07", "01-08",
                  "02-23", "03-08", "05-01", "05-09", "06-12", "11-04")

# Era edges of the panel under study: (name, first date, first date after).
# The published study uses 2010-15 / 2016-20 / 2021+; eras are a parameter because
# other panels cover other years.
DEFAULT_ERAS = (("2010-2015", "2010-01-01", "2016-01-01"),
                ("2016-2020", "2016-01-01", "2021-01-01"),
                ("2021+", "2021-01-01", "2200-01-01"))
